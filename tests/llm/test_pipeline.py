"""The pipeline's stages on planted documents, and its rows as a whole."""
import corpus_pipeline as P
from tsq.llm import quality as Q
from tsq.llm.base import fold_of
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_stages_keep_clean_documents_and_drop_planted_ones(spark, tmp_path):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("item_id = 2").first().text
    # a long clean document of good quality
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = (base.join(labels.where("quality = 1 and toxic = 0"), "doc_id").where("n_chars > 2500 and n_chars < 6000 and lang = 'en'")
             .orderBy("doc_id").first())
    words = clean.text.split(" ")
    near = " ".join(w if i % 97 else "changed" for i, w in enumerate(words))
    own = base.where("doc_id >= 1000000").columns
    leak = "\n".join([" ".join(reversed(words[:200])), item, " ".join(reversed(words[200:400]))])
    fresh = " ".join(sorted(words))
    junk = " ".join(f"{w}$$$" for w in words)
    planted = spark.createDataFrame(
        [(2_000_001, clean.text, "en", "p", 1), (2_000_002, near, "en", "p", 1), (2_000_003, leak, "en", "p", 1),
         (2_000_004, fresh, "en", "p", 1), (2_000_005, junk, "en", "p", 1), (2_000_006, None, None, None, None), (None, "", "en", None, 0)], base.schema)
    docs = base.unionByName(planted)
    gone_at = {}
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == own
        docs = docs.cache()
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= before
        gone_at |= {i: name for i in before - now}
        before = now
    assert gone_at[2_000_001] == gone_at[2_000_002] == "n-gram Jaccard join"
    assert gone_at[2_000_003] == "benchmark decontamination" and gone_at[2_000_005] == "quality classifier"
    assert gone_at[2_000_006] in ("quality classifier", "language ID") and 2_000_004 in before
    pieces = P.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == before


def test_first_stage_is_the_classifier(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in Q.score_documents(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in P.good_quality(spark, docs, SF).collect()} == good
    fold = docs.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("f")).where("f").count()
    assert 0 < fold < docs.count() / 2


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF).cache()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, P.run(spark, SF).collect()), key=key) == sorted(map(tuple, docs.collect()), key=key)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
