"""URL filter: rules, and for what they don't judge the ratio of two character language models.

The models are variable-order Markov models over the bytes of host and path, orders 0 to 5, smoothed by Witten and
Bell's interpolation: a context gives its continuations the weight of their counts, and the next shorter context a
weight of as many as it has different continuations. One is counted over all URLs that rules allow, the other over all
that rules block. A URL's score is the mean over its bytes of the difference of the log-likelihoods; it is allowed from
a threshold on, which is where the balanced accuracy on rule-judged URLs that were left out of the counts is best.

A URL that many pages have is scored once. Counts, models and scores are tables joined by the bytes' 48-bit n-gram, so the models may grow with the corpus.

A null url, or one without `://`, has empty host and path: no rule fits, nothing can be scored, and it is blocked. If
rules allow or block nothing, there is no model to compare with, and what no rule judges is allowed. Rows are judged one
by one, whatever their page_id. A very long URL is read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexarbor.llm import common
from lexarbor.llm.kernels import pieces

ORDER = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): fits the host and its subdomains if the path starts so; the longest wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"\A[^/?#]*+", 0), UPPER, LOWER), F.regexp_extract(rest, r"\A[^/?#]*+([^?#]*+)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits best, as host and path in one string, and its verdict; both null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def gram_lister(order: int):
    """(row, text) to (row, grams): for each byte, it and the `order` bytes before it (0 before the first) in one long."""

    def run(batches):
        for batch in batches:
            for row, data, rows in pieces(batch.column(1)):
                n = len(rows) - 1
                padded = np.zeros(len(data) + order * n, np.int64)
                at = np.arange(len(data)) + order * (np.repeat(np.arange(n), np.diff(rows)) + 1)
                padded[at] = data
                grams = np.zeros(len(data), np.int64)
                for i in range(order + 1):
                    grams = (grams << 8) | padded[at - order + i]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(grams))], names=["row", "grams"])

    return run


def model(counts: DataFrame, order: int) -> DataFrame:
    """(gram, difference) from (gram, a, r): the log-likelihood of its last byte after the others, allowed minus blocked."""
    lower = None
    for k in range(order + 1):
        mask = (1 << (8 * (k + 1))) - 1
        at = counts.groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        context = W.partitionBy(F.shiftright("gram", 8))
        for c in "ar":
            at = at.withColumn(f"n{c}", F.sum(c).over(context)).withColumn(f"t{c}", F.sum((F.col(c) > 0).cast("long")).over(context))
        at = at.withColumn("low", F.col("gram").bitwiseAND(F.lit(mask >> 8)))
        at = at.join(lower, "low") if k else at.withColumn("pa", F.lit(1 / 256)).withColumn("pr", F.lit(1 / 256))
        for c in "ar":
            smooth = (F.col(c) + F.col(f"t{c}") * F.col(f"p{c}")) / (F.col(f"n{c}") + F.col(f"t{c}"))
            # a byte that this class never had keeps a share of the uniform one at order 0
            at = at.withColumn(f"p{c}", F.when(F.col(f"n{c}") > 0, smooth).otherwise(F.col(f"p{c}")))
        lower = at.select(F.col("gram").alias("low"), "pa", "pr")
    return lower.select(F.col("low").alias("gram"), (F.log("pa") - F.log("pr")).alias("difference"))


def _best_threshold(scored: DataFrame) -> float:
    """Over bins of a hundredth (4001 at most): the cut with the best mean of both classes' shares on their side; c: rows of each."""
    bins = scored.groupBy(F.round(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("score"))) * 100).cast("int").alias("bin")).agg(F.sum(F.expr("if(verdict = 'allow', c, 0)")).alias("a"), F.sum(F.expr("if(verdict = 'block', c, 0)")).alias("r")).collect()
    bins = sorted((b.bin, b.a, b.r) for b in bins)
    allowed, blocked = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not allowed or not blocked:
        return 0.0
    best, cut, a, r = -1.0, 0.0, 0, 0
    for i, (x, da, dr) in enumerate(bins):
        value = (allowed - a) / allowed + r / blocked
        if value > best:
            best, cut = value, (x - 0.5) / 100 if i == 0 else (x + bins[i - 1][0]) / 200
        a, r = a + da, r + dr
    return cut


def judge(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (null where nothing can be scored), threshold."""
    host, path = host_and_path(pages["url"].cast("string"))
    split = pages.select(pages["page_id"].cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = common.saved(split.select("*", name.alias("rule"), verdict.alias("known"), F.struct("host", "path").alias("at")), "judged")
    # a URL is read once however many pages have it
    left_out = F.conv(F.substring(F.md5(F.concat("at.host", "at.path")), 1, 8), 16, 10).cast("long") % 10 == 0
    urls = judged.groupBy("at", "known").agg(F.count("*").alias("c"))
    urls = common.saved(urls.select(F.monotonically_increasing_id().alias("row"), "at", "known", "c", left_out.alias("left_out")), "urls")
    grams = common.saved(urls.select("row", F.concat("at.host", "at.path").alias("text")).mapInArrow(gram_lister(order), "row long, grams array<long>"), "grams")
    each = urls.select("row", "known", "left_out", "c").join(grams, "row").select("row", "known", "left_out", "c", F.explode("grams").alias("gram"))
    each = common.saved(each, "each")
    counts = each.groupBy("gram").agg(F.sum(F.expr("if(known = 'allow' and not left_out, c, 0)")).alias("a"), F.sum(F.expr("if(known = 'block' and not left_out, c, 0)")).alias("r"), F.count("*").alias("n"))
    counts = common.saved(counts.select("gram", F.coalesce("a", F.lit(0).cast("long")).alias("a"), F.coalesce("r", F.lit(0).cast("long")).alias("r"), "n"), "counts")
    both = counts.agg(F.sum("a").alias("a"), F.sum("r").alias("r")).first()
    if not (both.a and both.r):
        return judged.select("page_id", "host", "path", "rule", F.coalesce("known", F.when(F.concat("host", "path") == "", "block").otherwise("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("threshold"))
    likely = common.saved(model(counts, order).join(counts.select("gram", "n"), "gram"), "model")
    scores = common.lookup(each.select("row", "gram"), likely, "gram").groupBy("row").agg(F.avg("difference").alias("score"))
    scored = common.saved(urls.join(scores, "row", "left"), "scored")
    cut = _best_threshold(scored.filter("left_out and known is not null and score is not null").select("score", "c", F.col("known").alias("verdict")))
    own = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return common.lookup(judged, scored.select("at", "score", F.col("c").alias("n")), "at").select("page_id", "host", "path", "rule", F.coalesce("known", own).alias("verdict"), "score", F.lit(cut).alias("threshold"))


def allowed(pages: DataFrame, **how) -> DataFrame:
    """The rows of pages that aren't blocked, each judged by its own URL, whatever ids it shares. Pages whose URL a fixed-size filter clears aren't shuffled."""
    bad = common.saved(judge(pages, **how).filter("verdict = 'block'").select("host", "path", F.xxhash64("host", "path").alias("_k")).distinct(), "blocked")
    host, path = host_and_path(pages["url"].cast("string"))
    packed = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("_row"), host.alias("host"), path.alias("path"))
    split = common.IdFilter(bad, "_k").split(packed, F.xxhash64("host", "path"))
    met = split.filter("_maybe").drop("_maybe").join(bad.drop("_k"), ["host", "path"], "left_anti")
    return split.filter(~F.col("_maybe")).select("_row").unionByName(met.select("_row")).select("_row.*")
