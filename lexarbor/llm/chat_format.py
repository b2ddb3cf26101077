r"""Chat formatting in budgeted windows. DataFrame functions only.

A turn is written as

    ### role:
    text</turn>

and a window is a run of turns. Inside texts `\` becomes `\\`, a `#` that follows another becomes `\#` and `</turn>`
becomes `<\/turn>`. So no text holds `##` or `</turn>`, and none can end a turn or begin one; reading undoes it by dropping the backslash before
`\`, `#` and `/`. Roles are URL-encoded. A turn counts its words and two for the template.

Windows are chosen greedily from the running sums of a conversation's tokens. Every window begins with the system turn, if the
conversation begins with one; then come the last whole turns before the window's first, as many as fit `history` and leave room for that
first turn; then turns as long as all of it fits `budget`, one at least. So a window exceeds the budget only if the system
turn and a single turn do. The loss mask covers the texts of assistant turns in the one window that they belong to, never the
repeated ones.

Only the numbers of tokens of a conversation gather in one row for that, not its texts; these are joined to their windows once.

Turns are in order of turn (null first), then role and text; rows that repeat are turns of their own. Null roles and texts count as
empty. Rows with a null conv_id are one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexarbor.llm import common

END = "</turn>\n"
BUDGET, HISTORY = 512, 96


def escape(text: Column) -> Column:
    # what one pass leaves of a run of # are pairs with a backslash between, so the second one finds the rest
    for plain, safe in (("\\", "\\\\"), ("##", "#\\#"), ("##", "#\\#"), ("</turn>", "<\\/turn>")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#/])", "$1")


def numbered(conversations: DataFrame) -> DataFrame:
    """One row per turn: its number n, tokens, text as written (piece), the sums of tokens (begin) and characters (at) of the turns before
    it, the system turn apart."""
    c = conversations
    rows = c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"), F.coalesce(c["role"].cast("string"), F.lit("")).alias("role"), F.coalesce(c["text"].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long") - 1)
    head = F.concat(F.lit("### "), F.url_encode("role"), F.lit(":\n"))
    rows = rows.select(
        "conv_id", "n", ((F.col("n") == 0) & (F.col("role") == "system")).alias("is_system"), (F.col("role") == "assistant").alias("target"),
        F.length(head).alias("head"), F.concat(head, escape(F.col("text")), F.lit(END)).alias("piece"), (F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]++")) + 2).cast("long").alias("tokens"),
    )
    before = W.partitionBy("conv_id").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    own = lambda c: F.coalesce(F.sum(F.when(F.col("is_system"), 0).otherwise(c)).over(before), F.lit(0)).cast("long")
    return rows.withColumn("begin", own(F.col("tokens"))).withColumn("at", own(F.length("piece")))


def planned(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """(conv_id, window, first, own, last): the first turn of each window, the first that isn't repeated, the one after its last.

    turns: conv_id, n, is_system, tokens, begin; no texts.
    """
    reach = W.partitionBy("conv_id").orderBy("begin").rangeBetween(-history, 0)
    near = F.collect_list(F.when(~F.col("is_system"), F.struct("begin", "n"))).over(reach)
    system = F.max(F.when(F.col("is_system"), F.col("tokens")).otherwise(0)).over(W.partitionBy("conv_id"))
    rows = turns.withColumn("near", near).withColumn("system", system)
    # the turns repeated if a window begins here: of those near the ones that leave room for this turn
    room = F.col("begin") - F.least(F.lit(history), F.lit(budget) - F.col("system") - F.col("tokens"))
    rows = rows.withColumn("from", F.array_min(F.filter("near", lambda x: (x["begin"] >= room) | (x["n"] == F.col("n")))))
    t = F.struct("n", "tokens", "begin", "is_system", "from")
    held = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(t)).alias("t"), F.max("system").alias("system"))
    none = F.array().cast("array<struct<first:bigint,own:bigint>>")
    opened = lambda a, x: F.struct(F.concat(a["all"], F.array(F.struct(x["from"]["n"].alias("first"), x["n"].alias("own")))).alias("all"), (x["begin"] - x["from"]["begin"] + x["tokens"]).alias("used"))

    def step(a: Column, x: Column) -> Column:
        fits = (F.size(a["all"]) > 0) & (F.col("system") + a["used"] + x["tokens"] <= budget)
        first = F.struct(F.array(F.struct(x["n"].alias("first"), x["n"].alias("own"))).alias("all"), x["tokens"].alias("used"))
        return F.when(x["is_system"], a).when(fits, F.struct(a["all"].alias("all"), (a["used"] + x["tokens"]).alias("used"))).when(F.size(a["all"]) == 0, first).otherwise(opened(a, x))

    starts = F.aggregate("t", F.struct(none.alias("all"), F.lit(0).cast("long").alias("used")), step)["all"]
    held = held.select("conv_id", F.size("t").cast("long").alias("size"), starts.alias("starts"))
    # a system turn alone is a window
    held = held.withColumn("starts", F.when(F.size("starts") > 0, F.col("starts")).otherwise(F.array(F.struct(F.col("size").alias("first"), F.col("size").alias("own")))))
    placed = held.select("conv_id", "size", "starts", F.posexplode("starts").alias("window", "w"))
    return placed.select("conv_id", F.col("window").cast("long").alias("window"), "w.first", "w.own", F.coalesce(F.try_element_at("starts", F.col("window") + 2)["own"], F.col("size")).alias("last"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, text, n_repeated (turns at its begin that belong to other windows), loss.

    loss: array of (start, end) in code points of text, the end exclusive.
    """
    turns = common.saved(numbered(conversations), "turns")
    plan = planned(turns.select("conv_id", "n", "is_system", "tokens", "begin"), budget, history)
    inner = F.when(F.col("last") > F.col("first"), F.sequence("first", F.col("last") - 1)).otherwise(F.array().cast("array<bigint>"))
    # turn 0 opens every window if it is a system turn
    wanted = plan.select("*", F.explode(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), inner))).alias("_n"))
    wanted = wanted.select(F.col("conv_id").alias("_c"), "window", "first", "own", "_n")
    dealt = turns.join(wanted, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("n") == F.col("_n"))).filter("is_system or n >= first")
    mine = F.when(F.col("is_system"), F.col("window") == 0).otherwise(F.col("n") >= F.col("own"))
    start = F.col("at") + F.col("head")
    loss = F.struct(start.alias("start"), (F.col("at") + F.length("piece") - len(END)).alias("end"))
    packed = dealt.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("n", "piece"))).alias("turns"),
        F.array_sort(F.collect_list(F.when(F.col("target") & mine, loss))).alias("loss"),
        F.count(F.when(~mine, 1)).alias("n_repeated"),
        F.max(F.when(F.col("is_system"), F.length("piece")).otherwise(0)).alias("system"),
        F.min(F.when(~F.col("is_system"), F.col("at"))).alias("from"),
    )
    shift = F.col("system") - F.coalesce("from", F.lit(0))
    return packed.select("conv_id", "window", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("text"), "n_repeated", F.transform("loss", lambda s: F.struct((s["start"] + shift).alias("start"), (s["end"] + shift).alias("end"))).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from windows(): conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    pieces = F.split("text", F.lit(END), -1)
    body = lambda x: F.substr(x, F.instr(x, ":\n") + 2)
    turn = lambda x: F.concat(F.url_decode(F.regexp_extract(x, r"\A### ([^:]*+):\n", 1)), F.lit("\n"), unescape(body(x)), F.lit("\n"))
    # what belongs to this window: its turns after the system turn and the repeated ones
    turns = F.slice(pieces, 1, F.size(pieces) - 1)
    own = F.slice(turns, F.col("n_repeated").cast("int") + 1, F.size(turns))
    masked = F.transform("loss", lambda s: unescape(F.substring("text", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    read = formatted.select("conv_id", "window", F.size(own).alias("n"), F.array_join(F.transform(own, turn), "").alias("turns"), F.array_join(masked, "").alias("masked"), F.length("text").cast("long").alias("chars"))
    whole = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "masked"))).alias("all"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    joined = lambda f: F.array_join(F.transform("all", lambda x: x[f]), "")
    return whole.select("conv_id", "n_turns", F.sha2(joined("turns"), 256).alias("turns_sha256"), F.length(joined("masked")).cast("long").alias("loss_chars"), F.sha2(joined("masked"), 256).alias("loss_sha256"), "formatted_chars")
