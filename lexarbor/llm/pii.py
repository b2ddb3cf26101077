r"""Personal data by bootstrapped contextual extraction. DataFrame functions only.

Seeds are what four patterns find and validate: email, ip (parts at most 255), card (16 to 19 digits, Luhn) and phone
(8 to 15 digits), leftmost and non-overlapping for each kind, in code points. They always stay.

Candidates are other tokens with four digits or an `@`. Seeds, candidates and the matches that failed validation are
instances; the words around an occurrence are its lexical patterns: the last one or two before it, the first one or two after it, and one on
either side together. The graph of patterns and instances is scored in generations. A pattern's confidence in a kind is the share
of its distinct instances that are known to be of the kind (one more counts against it), if `support` are. A candidate's score is the
noisy-or of the best confidence on its left and on its right. Candidates that reach `accept` are known from then on, so they induce patterns
as seeds do, until a generation adds none. They become spans of the kind wherever they occur and overlap no seed.

Null and empty texts have no spans. Rows are judged one by one, whatever their doc_id. Texts are read whole; the patterns
use possessive loops that begin at the edges of runs, so a run of any length costs linear time and no stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexarbor.llm import common

KINDS = ("email", "ip", "card", "phone")
#: Equal to the plain patterns in what they match; a match may begin where the last one ended (\G) or a run begins.
FINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Whether a kind can be in a text at all: cheap tests before the patterns above.
MAY = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
    "card": lambda t: F.rlike(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){15}")),
    "phone": lambda t: F.rlike(t, F.lit(r"\+[0-9]")),
}
CANDIDATE = r"(?<![A-Za-z0-9._/@+-])(?=[A-Za-z0-9._/+-]*+@|(?:[A-Za-z._/@+-]*+[0-9]){4})[A-Za-z0-9._/@+-]++"
#: The two words before an occurrence, and the two after it: whole ones, whatever their length.
BEFORE, AFTER = r"(?<!\S)(?:\S++\s++)?\S++\s*+\z", r"\A\s*+\S++(?:\s++\S++)?+"


def _hits(text: Column, kind: int, find: str, may: Column) -> Column:
    """array of (kind, i, gap, match, before, after): the i-th match, the length of the text since the one before it, and the texts around it."""

    def listed(gaps: Column) -> Column:
        after = F.slice(gaps, F.lit(2), F.size(gaps))
        zipped = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(find), F.lit(0)).alias("match"), after.alias("after"))
        return F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), x["match"].alias("match"), F.regexp_extract(x["gap"], BEFORE, 0).alias("before"), F.regexp_extract(x["after"], AFTER, 0).alias("after")))

    none = F.array().cast("array<struct<kind:int,i:int,gap:int,match:string,before:string,after:string>>")
    # the text is split once: a lambda binds what it is split into
    found = F.element_at(F.transform(F.array(F.split(text, find, -1)), listed), 1)
    return F.when(may, F.filter(found, lambda x: x["match"].isNotNull())).otherwise(none)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    doubled = lambda d: F.when(d > 9, d - 9).otherwise(d)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when((n - i) % 2 == 1, doubled(value(i) * 2)).otherwise(value(i)))
    return total % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, r"\A0++(?=[0-9])", ""))
    ip = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    digits = _digits(match)
    card = F.when(F.length(digits).between(16, 19), _luhn(F.when(F.length(digits) <= 19, digits).otherwise("0"))).otherwise(False)
    return F.when(kind == 0, True).when(kind == 1, ip).when(kind == 2, card).when(kind == 3, F.length(digits).between(8, 15)).otherwise(False)


def _patterns(before: Column, after: Column) -> Column:
    """The patterns of an occurrence, lower-cased, `_` standing for it; none from beyond a text's or another match's edge."""
    left, right = (F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "") for c in (before, after))
    l1, l2, r1, r2 = F.try_element_at(left, F.lit(-1)), F.try_element_at(left, F.lit(-2)), F.try_element_at(right, F.lit(1)), F.try_element_at(right, F.lit(2))
    # concat of a null is null: no such pattern
    made = [F.concat(l1, F.lit(" _")), F.concat(l2, F.lit(" "), l1, F.lit(" _")), F.concat(F.lit("_ "), r1), F.concat(F.lit("_ "), r1, F.lit(" "), r2), F.concat(l1, F.lit(" _ "), r1)]
    return F.array_compact(F.array(*made))


def occurrences(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id) of all rows, and (row, kind, start, end, value, before, after, seed) of all matches; kind 4: candidates."""
    t = F.col("text")
    texts = common.text_of(docs, "doc_id").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    some = F.rlike(t, F.lit("[0-9@]"))
    arrays = [_hits(t, k, FINDS[name], some & MAY[name](t)) for k, name in enumerate(KINDS)] + [_hits(t, len(KINDS), CANDIDATE, some)]
    found = common.saved(texts.select("row", "doc_id", F.concat(*arrays).alias("hits")), "hits")
    raw = found.select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    ahead = F.sum(F.col("gap") + F.length("match")).over(W.partitionBy("row", "kind").orderBy("i"))
    placed = raw.withColumn("end", ahead).withColumn("start", F.col("end") - F.length("match"))
    return found.select("row", "doc_id"), placed.select("row", "kind", "start", "end", F.col("match").alias("value"), "before", "after", valid(F.col("kind"), F.col("match")).alias("seed"))


def bootstrap(all_: DataFrame, support: int, accept: float) -> DataFrame:
    """(value, kind, score) of the candidates that high-confidence patterns discover, generation by generation until none is added."""
    instance = F.when(F.col("kind") == 2, _digits(F.col("value"))).otherwise(F.lower("value"))
    # card matches of a few digits are no failed cards
    told = all_.filter("kind = 4 or seed or kind in (1, 3) or length(value) >= 16")
    edges = told.select(instance.alias("value"), F.when(F.col("kind") < 4, F.col("kind")).alias("kind"), "seed", F.explode(_patterns(F.col("before"), F.col("after"))).alias("pattern"))
    edges = common.saved(edges.distinct(), "edges")
    known = common.saved(edges.filter("seed").select("value", "kind", F.lit(1.0).alias("score")).distinct(), "known")
    pairs = edges.select("value", "pattern").distinct()
    sizes = common.saved(pairs.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= support), "sizes")
    # patterns of too few instances never count
    pairs = common.saved(common.lookup(common.saved(pairs, "pairs"), sizes, "pattern"), "sized")
    matched = edges.filter("kind is not null").select("value").distinct()
    open_ = common.saved(edges.filter("kind is null").select("value", "pattern").distinct().join(matched, "value", "left_anti"), "open")
    accepted = 0
    while True:
        sure = pairs.join(known, "value").groupBy("pattern", "kind").agg(F.count("*").alias("sure"), F.min("n").alias("n")).filter(F.col("sure") >= support)
        sure = sure.select("pattern", "n", "kind", (F.col("sure") / (F.col("n") + 1)).alias("confidence"))
        strong = common.saved(sure.groupBy("pattern").agg(F.min("n").alias("n"), F.collect_list(F.struct("kind", "confidence")).alias("kinds")), "strong")
        reached = common.lookup(open_, strong, "pattern").select("value", F.expr("startswith(pattern, '_ ')").alias("right"), F.inline("kinds"))
        best = reached.groupBy("value", "kind").agg(*(F.coalesce(F.max(F.when(F.col("right") == side, F.col("confidence"))), F.lit(0.0)).alias(name) for name, side in (("l", False), ("r", True))))
        scores = best.select("value", "kind", (1 - (1 - F.col("l")) * (1 - F.col("r"))).alias("score")).filter(F.col("score") >= accept)
        # a candidate is of one kind, the likeliest when it was first accepted
        new = scores.groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"), F.max("score").alias("score")).join(known, "value", "left_anti")
        new = common.saved(new, "new")
        found = new.count()
        if not found:
            break
        known, accepted = common.saved(known.unionByName(new), "known"), accepted + found
    return known.join(matched, "value", "left_anti").select("value", F.col("kind").alias("as_kind"), "score")


def spans(docs: DataFrame, support: int = 5, accept: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id) of all rows, and (row, kind, start, end, base, score): seeds and what the patterns discover."""
    rows, all_ = occurrences(docs)
    all_ = common.saved(all_, "occurrences")
    discovered = bootstrap(all_, support, accept)
    # seeds have no gap inside a kind; of all kinds together, the furthest end so far and the next start bound a candidate
    by_start = W.partitionBy("row").orderBy("start", "end")
    edge = all_.filter("seed or kind = 4").withColumn("before_it", F.max(F.when(F.col("seed"), F.col("end"))).over(by_start.rowsBetween(W.unboundedPreceding, -1)))
    edge = edge.withColumn("after_it", F.min(F.when(F.col("seed"), F.col("start"))).over(by_start.rowsBetween(1, W.unboundedFollowing)))
    free = edge.filter("kind = 4").filter("(before_it is null or before_it <= start) and (after_it is null or after_it >= end)")
    free = common.saved(free.select("row", "start", "end", F.lower("value").alias("value")), "free")
    discovered = discovered.join(free.groupBy("value").agg(F.count("*").alias("n")), "value")
    added = common.lookup(free, common.saved(discovered, "discovered"), "value").select("row", F.col("as_kind").alias("kind"), "start", "end", F.lit(False).alias("base"), "score")
    return rows, all_.filter("seed").select("row", "kind", "start", "end", F.lit(True).alias("base"), F.lit(1.0).alias("score")).unionByName(added)


def report(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (seeds), base_sha256, spans (seeds and added), n_added."""
    rows, found = spans(docs, **how)
    listed = found.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("kind", "start", "end", "base"))).alias("all"),
        *(F.count(F.when((F.col("kind") == k) & F.col("base"), 1)).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.count(F.when(~F.col("base"), 1)).alias("n_added"),
    )
    names = F.array(*(F.lit(k) for k in KINDS))
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    none = F.array().cast("array<struct<kind:int,start:long,end:long,base:boolean>>")
    told = rows.join(listed, "row", "left").withColumn("all", F.coalesce("all", none))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return told.select("doc_id", *(zero(f"n_{name}") for name in KINDS), F.sha2(shown(F.filter("all", lambda s: s["base"])), 256).alias("base_sha256"), shown(F.col("all")).alias("spans"), zero("n_added"))
