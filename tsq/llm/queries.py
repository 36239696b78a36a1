"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tsq.llm import chat, crosspolytope, dac, decontam, fingerprint, jaccard, langid, licenses, merkle, negatives, packing, quality, urls
from tsq.llm.base import table
from tsq.session import scratch_path

QueryFn = Callable[[SparkSession, str], DataFrame]


def op1_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_notices(table(spark, sf_dir, "documents"))


def op4_line_field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    dac.write_ids(table(spark, sf_dir, "documents"), path)
    return dac.read_ids(spark, path)


def op6_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents")).drop("class")


def op7_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op8_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


#: The conversation that the query adds: control strings as text.
_TRIAL = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op10_chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    path = scratch_path(spark, "chats")
    chat.write_chats(turns.unionByName(spark.createDataFrame(_TRIAL, "conv_id long, turn long, role string, text string")), path)
    return chat.read_chats(spark, path)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_cross_polytope_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "manifest")
    stages = merkle.write_manifest(merkle.tampered(table(spark, sf_dir, "documents")), path)
    return merkle.check_copies(spark, path, stages).drop("tree")


QUERIES: dict[str, QueryFn] = {
    "op1_multiset_fingerprints": op1_multiset_fingerprints,
    "op2_benchmark_leaks": op2_benchmark_leaks,
    "op3_license_notices": op3_license_notices,
    "op4_line_field_quality": op4_line_field_quality,
    "op5_token_files": op5_token_files,
    "op6_jaccard_forest": op6_jaccard_forest,
    "op7_url_ratio": op7_url_ratio,
    "op8_curve_packing": op8_curve_packing,
    "op9_language_id": op9_language_id,
    "op10_chat_tokens": op10_chat_tokens,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_cross_polytope_neighbours": op12_cross_polytope_neighbours,
    "op13_merkle_manifest": op13_merkle_manifest,
}

# Every pair of documents that shares a shingle of five words; copies are pairs like others.
_JACCARD_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b, k = x.n AND k = y.n AS same
  FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * k >= 4 * (x.n + y.n)),
r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.root),
class AS (SELECT doc_id, min(root) AS class_id FROM r GROUP BY doc_id),
copy AS (
  SELECT d.doc_id, least(d.doc_id, coalesce(min(l.b), d.doc_id)) AS first, 1 + count(l.b) AS copies
  FROM documents d LEFT JOIN l ON l.a = d.doc_id AND l.same GROUP BY d.doc_id)
SELECT class.doc_id, class.class_id, count(l.b) AS n_links,
       count(DISTINCT CASE WHEN NOT l.same THEN other.first END) AS n_text_links, copy.copies
FROM class JOIN copy ON copy.doc_id = class.doc_id LEFT JOIN l ON l.a = class.doc_id LEFT JOIN copy other ON other.doc_id = l.b
GROUP BY class.doc_id, class.class_id, copy.copies
"""

_CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, length(regexp_replace(t, '([<\[])(\\*)(/?s>|/?(INST|SYS|ROLE)\])', '\1\2\\\3', 'g')) AS said,
         CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 7 WHEN 'system' THEN 14
              ELSE 20 + length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?(INST|SYS|ROLE)\])', '\1\2\\\3', 'g')) END AS marks
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, role) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(said + marks) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def _url_sql() -> str:
    """The rules, the two models level by level, and the threshold."""
    order = urls.ORDER
    fit = lambda r: f"((host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}'))"
    by_length = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda value: "CASE " + " ".join(f"WHEN {fit(r)} THEN '{value(r)}'" for r in by_length) + " END"
    sql = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
part AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
p AS (SELECT *, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS said FROM part),
d AS (SELECT DISTINCT host, path, said, repeat(chr(2), {order}) || host || path || chr(3) AS t FROM p),
spot AS (SELECT host, path, said, substr(t, i, {order + 1}) AS gram FROM (SELECT *, unnest(range(1, length(t) - {order} + 1)) AS i FROM d)),
gram AS (SELECT gram, count(*) FILTER (WHERE said = 'allow') AS a, count(*) FILTER (WHERE said = 'block') AS b FROM spot GROUP BY gram)"""
    base = repr(1.0 / urls.ALPHABET)
    for k in range(order + 1):
        def prob(x: str, below: str, less: int) -> str:
            low = f"w.{below}" if k else f"CAST({base} AS DOUBLE)"
            t = f"(c.t{x} - CASE WHEN l.{x} = 1 THEN {less} ELSE 0 END)"
            return (f"CASE WHEN c.c{x} - {less} > 0 AND l.{x} - {less} >= 0 THEN (l.{x} - {less} + {t} * {low}) / (c.c{x} - {less} + {t}) "
                    f"ELSE {low} END")
        sql += f""",
l{k} AS (SELECT right(gram, {k + 1}) AS g, left(right(gram, {k + 1}), {k}) AS ctx, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM gram GROUP BY ALL),
c{k} AS (SELECT ctx, sum(a) AS ca, sum(b) AS cb, count(*) FILTER (WHERE a > 0) AS ta, count(*) FILTER (WHERE b > 0) AS tb FROM l{k} GROUP BY ctx),
p{k} AS (SELECT l.g, {prob('a', 'pa', 0)} AS pa, {prob('b', 'pb', 0)} AS pb, {prob('a', 'la', 1)} AS la, {prob('b', 'lb', 1)} AS lb
  FROM l{k} l JOIN c{k} c ON c.ctx = l.ctx{f' JOIN p{k - 1} w ON w.g = right(l.g, {k})' if k else ''})"""
    return sql + f""",
s AS (
  SELECT host, path, said, avg(CASE said WHEN 'allow' THEN ln(la) - ln(pb) WHEN 'block' THEN ln(pa) - ln(lb) ELSE ln(pa) - ln(pb) END) AS score
  FROM spot JOIN p{order} ON g = gram GROUP BY host, path, said),
m AS (
  SELECT avg(score) FILTER (WHERE said = 'allow') AS ma, avg(score) FILTER (WHERE said = 'block') AS mb,
         stddev_pop(score) FILTER (WHERE said = 'allow') + 1e-6 AS sa, stddev_pop(score) FILTER (WHERE said = 'block') + 1e-6 AS sb FROM s)
SELECT page_id, p.host, p.path, p.rule,
       coalesce(p.said, CASE WHEN round(score - (ma * sb + mb * sa) / (sa + sb), 9) < 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM p CROSS JOIN m LEFT JOIN s ON s.host = p.host AND s.path = p.path
"""


_NEGATIVES_SQL = f"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % {negatives.FLIPPED} = 0 THEN (label + 1) % {negatives.LABELS} ELSE label END AS label,
         [floor({negatives.SCALE} * x::DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % {negatives.ANCHORS} = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {negatives.POSITIVES})
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND {negatives.LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {negatives.HIGH} * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= {negatives.NEGATIVES}
"""


def _merkle_sql() -> str:
    """All nodes level by level, each document's runs from leaf to root, and the fold along them."""
    def field(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    crc = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], [ascii(c)::BIGINT for c in string_split(coalesce(doc_id::VARCHAR, ''), '') if c <> '']),
      lambda acc, b: list_reduce(list_concat([xor(acc, b)], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, sha256({head} || {field('text')}) AS leaf,
         CASE WHEN {crc} % 3 = 0 THEN translate(text, '{merkle.UPPER}', '{merkle.UPPER.lower()}') ELSE text END AS copy, source, n_chars
  FROM documents),
p AS (
  SELECT doc_id, lang, leaf, sha256({head} || {field('copy')}) AS checked, row_number() OVER () AS doc,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
a(lang, level, pos, node, n) AS (
  SELECT lang, 0, pos, leaf, n FROM p
  UNION ALL
  SELECT lang, level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 7) // 8) FROM a WHERE n > 1 GROUP BY lang, level, pos // 8),
t AS (
  SELECT lang, node, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS pos, count(*) OVER () AS n FROM a WHERE n = 1),
b(level, pos, node, n) AS (
  SELECT 0, pos, node, n FROM t
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 7) // 8) FROM b WHERE n > 1 GROUP BY level, pos // 8),
run AS (
  SELECT doc, dense_rank() OVER (PARTITION BY doc ORDER BY kind, level) AS step, pos = own AS mine, pos, node FROM (
    SELECT p.doc, 0 AS kind, a.level, a.pos, a.node, p.pos // CAST(pow(8, a.level) AS BIGINT) AS own
    FROM p JOIN a ON a.lang IS NOT DISTINCT FROM p.lang AND a.n > 1 AND a.pos // 8 = p.pos // CAST(pow(8, a.level + 1) AS BIGINT)
    UNION ALL
    SELECT p.doc, 1, b.level, b.pos, b.node, t.pos // CAST(pow(8, b.level) AS BIGINT)
    FROM p JOIN t ON t.lang IS NOT DISTINCT FROM p.lang JOIN b ON b.n > 1 AND b.pos // 8 = t.pos // CAST(pow(8, b.level + 1) AS BIGINT))),
f(doc, step, node) AS (
  SELECT doc, 1, checked FROM p
  UNION ALL
  SELECT f.doc, f.step + 1, sha256(string_agg(CASE WHEN mine THEN f.node ELSE run.node END, '' ORDER BY pos))
  FROM f JOIN run ON run.doc = f.doc AND run.step = f.step GROUP BY f.doc, f.step),
proof AS (SELECT doc, sha256(string_agg(node, '' ORDER BY step, pos) FILTER (WHERE NOT mine)) AS proof, CAST(count(*) FILTER (WHERE NOT mine) AS INTEGER) AS n FROM run GROUP BY doc)
SELECT p.doc_id, p.leaf, t.node AS subroot, r.node AS root, coalesce(proof.proof, sha256('')) AS proof_sha256,
       f.node AS folded_root, f.node = r.node AS verified, coalesce(proof.n, 0) AS proof_nodes
FROM p JOIN t ON t.lang IS NOT DISTINCT FROM p.lang JOIN b r ON r.n = 1 LEFT JOIN proof ON proof.doc = p.doc
JOIN (SELECT doc, arg_max(node, step) AS node FROM f GROUP BY doc) f ON f.doc = p.doc
"""


ORACLES: dict[str, str] = {
    "op6_jaccard_forest": _JACCARD_SQL,
    "op7_url_ratio": _url_sql(),
    "op10_chat_tokens": _CHAT_SQL,
    "op11_hard_negatives": _NEGATIVES_SQL,
    "op13_merkle_manifest": _merkle_sql(),
}
