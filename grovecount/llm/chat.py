"""Chat formatting into budgeted training windows.

A conversation becomes one or more windows of at most ``budget`` tokens whose
borders fall between turns:

* prefix sums of turn tokens place every turn on a line; the span of a window
  is all turns that start in the same stretch of that line, half as long as a
  window's body, so a span never outgrows the body.  A turn longer than a
  stretch is a window of its own; only such a turn, or a leading system turn
  of over a quarter of the budget, can exceed the budget
  (``over_budget``).  Turns are never cut;
* a leading system turn is repeated at the top of every window;
* up to ``history`` tokens of turns before the span are repeated;
* the loss mask covers the texts of assistant turns in the span only: repeated
  turns are masked, so each target is trained on once.

Template: ``### role: text</turn>`` and a line break per turn.  ``###``, ``</turn>``
and backslashes inside texts are escaped reversibly, so no text can forge a
marker.  Tokens are estimated as bytes / 4 plus ``MARKERS``.

No conversation is one task's work: prefix sums are taken within blocks of 256
turn numbers and the block totals are summed over, and only a window's own
turns (bounded by the budget) are ever collected.

Edge cases: null text and null role count as empty; a null conversation id is a
conversation of its own; null turn numbers come first; rows with equal turn
numbers are ordered by role and text and repeated rows are separate turns; a
conversation of nothing but a system turn is one window; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MARKERS = 6  # tokens of "### role: " and "</turn>\n"
END = "</turn>\n"
NO_ID = -(2**63)


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    # the backslash last: until then every backslash starts a code
    for plain, code in (("</turn>", "\\t"), ("###", "\\h"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


def _placed(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns with their position ``pos`` and the tokens ``c0`` before them."""
    rows = turns.select(
        F.coalesce(turns[conv].cast("long"), F.lit(NO_ID)).alias("conv"),
        F.coalesce(turns[turn].cast("long"), F.lit(NO_ID)).alias("turn"),
        F.coalesce(turns[role].cast("string"), F.lit("")).alias("role"),
        F.coalesce(turns[text].cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("blk", F.shiftright("turn", 8)).withColumn(
        "t", (F.lit(MARKERS) + F.ceil(F.octet_length("text") / 4)).cast("long")
    )
    inside = W.partitionBy("conv", "blk").orderBy("turn", "role", "text")
    rows = rows.withColumn("rn", F.row_number().over(inside) - 1).withColumn(
        "run", F.sum("t").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("t")
    )
    # one row per block of turn numbers
    totals = rows.groupBy("conv", "blk").agg(
        F.sum("t").alias("bt"), F.count("*").alias("bn"),
        F.max(F.when(F.col("rn") == 0, F.struct(F.col("role"), F.col("t")))).alias("head"),
    )
    over = W.partitionBy("conv").orderBy("blk")
    before = over.rowsBetween(W.unboundedPreceding, -1)
    # tokens of the leading system turn do not count on the line
    first = F.first("head").over(over.rowsBetween(W.unboundedPreceding, 0))
    system_t = F.when(first["role"] == "system", first["t"]).otherwise(F.lit(0))
    totals = totals.select(
        "conv", "blk", F.coalesce(F.sum("bt").over(before), F.lit(0)).alias("t_before"),
        F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("n_before"), system_t.alias("system_t"),
    )
    return rows.join(totals.hint("shuffle_hash"), ["conv", "blk"]).select(
        "conv", "role", "text", "t", "system_t",
        (F.col("n_before") + F.col("rn")).alias("pos"),
        F.greatest(F.lit(0), F.col("t_before") + F.col("run") - F.col("system_t")).alias("c0"),
    )


def format_windows(
    turns: DataFrame, budget: int = 2048, history: int = 256, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """``conv_id, first_turn, n_repeated, n_new, tokens, over_budget, formatted,
    loss_spans`` per window; ``loss_spans`` are (start, length) in code points of
    ``formatted``; windows of a conversation are ordered by ``first_turn``."""
    stretch = (budget - budget // 4 - history) // 2
    if history > stretch or stretch <= MARKERS:
        raise ValueError("history must fit half a window's body")
    placed = _placed(turns, conv_col, turn_col, role_col, text_col)
    head = F.concat(F.lit("### "), escape_role(F.col("role")), F.lit(": "))
    body = escape(F.col("text"))
    placed = placed.select(
        "conv", "pos", "t", "c0", F.floor(F.col("c0") / stretch).alias("b"),
        ((F.col("pos") == 0) & (F.col("system_t") > 0)).alias("system"),
        F.length(head).alias("n_head"), F.length(body).alias("n_body"),
        (F.col("role") == "assistant").alias("target"), F.concat(head, body, F.lit(END)).alias("piece"),
    )
    part = ["conv", "win", "pos", "t", "n_head", "n_body", "piece"]
    span = placed.where(~F.col("system")).withColumn("win", 2 * F.col("b") + (F.col("t") > stretch).cast("long"))
    new = span.select(*part, "target", F.lit(False).alias("repeated"))
    starts = span.groupBy("conv", "win").agg(F.min("c0").alias("start"))

    # a turn can be history of windows that start in its stretch or the next
    near = placed.where(~F.col("system") & (F.col("t") <= history)).drop("system", "target").withColumn(
        "at", F.explode(F.array(F.col("b"), F.col("b") + 1))
    ).drop("b")
    opened = starts.withColumn("at", F.floor(F.col("start") / stretch)).where("start > 0")
    repeated = near.join(opened.hint("merge"), ["conv", "at"]).where(
        (F.col("c0") < F.col("start")) & (F.col("c0") >= F.col("start") - history)
    ).select(*part, F.lit(False).alias("target"), F.lit(True).alias("repeated"))

    system = placed.where("system").drop("b", "c0", "system")
    retained = system.join(starts.hint("merge"), "conv", "left").select(
        "conv", F.coalesce("win", F.lit(0)).alias("win"), "pos", "t", "n_head", "n_body", "piece", "target",
        (F.coalesce("start", F.lit(0)) > 0).alias("repeated"),
    )
    parts = new.unionByName(repeated).unionByName(retained)
    running = W.partitionBy("conv", "win").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(running), F.lit(0)))
    item = F.struct(
        "pos", "piece", (F.col("target") & ~F.col("repeated")).alias("loss"),
        (F.col("at") + F.col("n_head")).alias("start"), F.col("n_body").cast("long").alias("length"),
    )
    windows = parts.groupBy("conv", "win").agg(
        F.min(F.when(~F.col("repeated"), F.col("pos"))).alias("first_turn"),
        F.count_if("repeated").alias("n_repeated"), F.count_if(~F.col("repeated")).alias("n_new"),
        F.sum("t").alias("tokens"), F.sort_array(F.collect_list(item)).alias("items"),
    )
    return windows.select(
        F.nullif("conv", F.lit(NO_ID)).alias("conv_id"), "first_turn", "n_repeated", "n_new", "tokens",
        (F.col("tokens") > budget).alias("over_budget"),
        F.array_join(F.transform("items", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(
            F.filter("items", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))
        ).alias("loss_spans"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Recover from formatted windows, per window: ``turns`` (role, text of the
    turns that are new in it) and ``targets`` (texts under the loss mask)."""
    pieces = F.split("formatted", END, -1)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, ": ", 1)
        return F.struct(
            unescape_role(F.substr(head, F.lit(5))).alias("role"),
            unescape(F.substr(piece, F.length(head) + 3)).alias("text"),
        )

    return windows.select(
        "conv_id", "first_turn", "formatted",
        F.transform(
            F.slice(pieces, F.col("n_repeated").cast("int") + 1, F.col("n_new").cast("int")), turn
        ).alias("turns"),
        F.transform(
            "loss_spans",
            lambda s: unescape(F.substr("formatted", s["start"].cast("int") + 1, s["length"].cast("int"))),
        ).alias("targets"),
    )


def op1(spark, sf_dir):
    """Digests of the formatted conversations, read back from the windows.  A
    SHA-256 runs over one conversation's text in order, so this digest (not the
    formatting) holds a conversation in one row."""
    from grovecount.sources.tables import read_table

    forged = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(forged).alias("text"),
    )
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(format_windows(rows))
    told = back.select(
        "conv_id", "first_turn", F.size("turns").cast("long").alias("n"),
        F.length("formatted").cast("long").alias("chars"),
        F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
        .alias("said"),
        F.array_join("targets", "").alias("loss"),
    )
    whole = told.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"),
        F.sort_array(F.collect_list(F.struct("first_turn", "said", "loss"))).alias("w"),
    )
    said = F.array_join(F.transform("w", lambda x: x["said"]), "")
    loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return whole.select("conv_id", "n_turns", "formatted_chars", "n_windows", said.alias("said"), loss.alias("loss")).select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )
