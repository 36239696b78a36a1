"""URL filter by a character language-model ratio (operator 7; DataFrame operations only).

URLs that a rule accepts or rejects teach two variable-order Markov models of
the characters of host and path: orders 0 to ``ORDER``, each interpolated with
the next lower one by Witten-Bell weights (the more different characters
follow a context, the more goes to the shorter context).  A URL's score is its
log-likelihood difference per character, end included.  The threshold lies
between the mean scores of the two kinds of learning URLs, as many of their
standard deviations from either; a learning URL is scored without its own
occurrence of each n-gram.

Every distinct URL counts once, however many pages have it.  Counts are
aggregated per n-gram before anything is joined; models are tables of
n-grams, joined by their shorter n-grams.

All joins but the one row of the threshold are merge joins: the n-grams of a
URL, exploded from its row in a compressed file, are estimated as a few bytes
of that file, so they would be broadcast whole through the driver.

Defined cases: a null URL or one without ``://`` has an empty host and path and
is judged as the empty string; without learning URLs of both kinds everything
that no rule fits is allowed; repeated rows are judged alike.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsq.llm.base import stored

ORDER = 4
#: Equally likely characters below order 0.
ALPHABET = 256
#: Verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_START, _END = "\u0002", "\u0003"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A to Z lower-cased) and path."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _fits(rule: tuple[str, str, str], host: Column, path: Column) -> Column:
    _, h, p = rule
    return ((host == h) | host.endswith(f".{h}")) & path.startswith(p)


def _first_fit(rules, host: Column, path: Column, value) -> Column:
    """Value of the longest rule that fits, null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1] + r[2])):
        out = F.when(_fits(rule, host, path), F.lit(value(rule))).otherwise(out)
    return out


def ngram_ratios(grams: DataFrame) -> DataFrame:
    """gram, ratio, ratio_a, ratio_b: log-ratio of the last character's
    probability under the two models, and the same without one occurrence from
    the accepted or the rejected URLs.  ``grams``: gram (ORDER + 1 characters),
    a, b (its counts)."""
    names = ("pa", "pb", "la", "lb")  # the last two without one occurrence
    lower = None
    for k in range(ORDER + 1):
        level = grams.select(F.expr(f"right(gram, {k + 1})").alias("g"), "a", "b").groupBy("g").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        level = level.withColumn("ctx", F.expr(f"left(g, {k})"))
        context = level.groupBy("ctx").agg(F.sum("a").alias("ca"), F.sum("b").alias("cb"),
                                           F.sum((F.col("a") > 0).cast("long")).alias("ta"), F.sum((F.col("b") > 0).cast("long")).alias("tb"))
        level = level.join(context.hint("merge"), "ctx")
        if lower is None:
            level = level.select("*", *[F.lit(1.0 / ALPHABET).alias(f"_{n}") for n in names])
        else:
            level = level.withColumn("tail", F.expr(f"right(g, {k})")).join(lower.hint("merge"), "tail")

        def p(x: str, below: str, less: int) -> Column:
            """Witten-Bell: (count + types * shorter) / (context + types)."""
            n, c = F.col(x) - less, F.col(f"c{x}") - less
            t = F.col(f"t{x}") - F.when(F.col(x) == 1, less).otherwise(0)
            return F.when((c > 0) & (n >= 0), (n + t * F.col(below)) / (c + t)).otherwise(F.col(below))

        lower = level.select(F.col("g").alias("tail"), p("a", "_pa", 0).alias("_pa"), p("b", "_pb", 0).alias("_pb"),
                             p("a", "_la", 1).alias("_la"), p("b", "_lb", 1).alias("_lb"))
    ratio = lambda a, b: F.log(F.col(a)) - F.log(F.col(b))
    return lower.select(F.col("tail").alias("gram"), ratio("_pa", "_pb").alias("ratio"), ratio("_la", "_pb").alias("ratio_a"), ratio("_pa", "_lb").alias("ratio_b"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row (page_id, url)."""
    host, path = parts(F.col("url"))
    p = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    p = p.select("page_id", "host", "path", _first_fit(rules, F.col("host"), F.col("path"), lambda r: f"{r[1]}{r[2]}").alias("rule"),
                 _first_fit(rules, F.col("host"), F.col("path"), lambda r: r[0]).alias("said"))
    # a path begins with a slash and a host has none: the pair is its concatenation
    distinct = stored(p.groupBy("host", "path").agg(F.first("said").alias("said")), "urls")
    text = F.concat(F.lit(_START * ORDER), "host", "path", F.lit(_END))
    spots = distinct.select("host", "path", "said", text.alias("t")).select(
        "host", "path", "said", "t", F.explode(F.sequence(F.lit(1), F.length("t") - ORDER)).alias("at")).select(
        "host", "path", "said", F.col("t").substr(F.col("at"), F.lit(ORDER + 1)).alias("gram"))
    grams = stored(spots.groupBy("gram").agg(F.sum((F.col("said") == "allow").cast("long")).alias("a"), F.sum((F.col("said") == "block").cast("long")).alias("b"))
                   .select("gram", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")), "url-grams")
    mine = F.when(F.col("said") == "allow", F.col("ratio_a")).when(F.col("said") == "block", F.col("ratio_b")).otherwise(F.col("ratio"))
    scored = stored(spots.join(ngram_ratios(grams).hint("merge"), "gram").groupBy("host", "path", "said").agg(F.avg(mine).alias("score")), "url-scores")
    is_a, is_b = F.col("said") == "allow", F.col("said") == "block"
    one = scored.agg(*[f(F.when(c, F.col("score"))).alias(n) for f, c, n in (
        (F.avg, is_a, "ma"), (F.avg, is_b, "mb"), (F.stddev_pop, is_a, "sa"), (F.stddev_pop, is_b, "sb"))])
    sa, sb = F.col("sa") + F.lit(1e-6), F.col("sb") + F.lit(1e-6)
    line = one.select(((F.col("ma") * sb + F.col("mb") * sa) / (sa + sb)).alias("line"))
    verdicts = (scored.where("said is null").crossJoin(F.broadcast(line))  # one row
                .select("host", "path", F.when(F.round(F.col("score") - F.col("line"), 9) < 0, "block").otherwise("allow").alias("model")))
    return p.join(verdicts.hint("merge"), ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("said", "model").alias("verdict"))
