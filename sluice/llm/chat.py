"""Chat formatting by perspective rotation: each participant of a dialogue is the assistant of one rendering of it.

DataFrame functions only. A dialogue is rendered whole, whatever its length and its turn numbers. The turns of one of at most PART_TURNS turns meet by
a grouping on the conversation. A longer one is ordered by a range shuffle and numbered by sums over its partitions, cut into runs of PART_TURNS turns
by that number, and each run is rendered by itself for every participant of the conversation; so turns are ordered and rendered by many tasks, and only
finished texts, which the result holds in one row anyway, meet at the end. With part_turns set, those of more turns are left as
several rows, one for each run of that many turns, numbered from 0; each begins with the system turns of the runs before it (each wording once, at its
latest turn), so that it can be read alone.

Rendering: every turn is `<|im_start|>ROLE\nTEXT<|im_end|>\n`. ROLE is `assistant` for the speaker whose perspective it
is, `user name=SPEAKER` for the others, and `system` for system speakers, who are context and no participants. The mask
holds the character spans [start, end) of the assistant's texts, each with its <|im_end|>: what a loss may be taken on. So that no text forges a turn, `<|im_start|>`
and `<|im_end|>` within texts and names lose their first bar (`<im_start|>`), and line ends in names are blanks.

Cases: a null text is an empty turn; a null speaker is named `unknown`; a null turn number sorts first; ties are ordered by
speaker, then text; a repeated row is a repeated turn. A dialogue of system turns only gives no row; a
null conversation id is one conversation. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_broadcast, staged

#: Turns that are ordered and rendered together.
PART_TURNS = 1024
SYSTEM = ("system",)
#: Assumed bytes of a row of conversations, offsets or speakers in a broadcast.
ROW_BYTES = 256
_MASK = "array<struct<start:long,end:long>>"


def _matched(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    return left.join(bounded_broadcast(right, right.count(), ROW_BYTES), on, how)


def _plain(text: Column) -> Column:
    """The text with control strings broken."""
    return F.regexp_replace(text, r"<\|(im_start|im_end)\|>", "<$1|>")


def _runs(said: DataFrame, long: DataFrame, system: tuple[str, ...], run_turns: int, carry: bool) -> DataFrame:
    """(conv_id, part, turns, perspective) of the conversations in long (conv); said has (conv_id, t)."""
    same = lambda a, b="conv": F.col(a).eqNullSafe(F.col(b))
    own = _matched(said, long, same("conv_id")).drop("conv_id")
    order = ["conv", "t"]
    spread = own.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    spread = staged(spread.withColumn("range", F.shiftright("at", 33)), "chat-turns")
    runs = spread.groupBy(F.col("conv").alias("c"), F.col("range").alias("r")).agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = staged(runs.select("c", "r", (before - F.col("low")).alias("shift")), "chat-ranges")
    ranked = _matched(spread, runs, same("conv", "c") & (F.col("range") == F.col("r")))
    part = F.floor((F.col("at") + F.col("shift")) / run_turns)
    cut = staged(ranked.select("conv", part.cast("long").alias("part"), "t"), "chat-parts")

    every = cut
    if carry:
        parts = cut.select(F.col("conv").alias("c"), F.col("part").alias("p")).distinct()
        told = cut.where(F.col("t.speaker").isin(*system)).groupBy("conv", "part", "t.speaker", "t.text").agg(F.max("t").alias("t"))
        carried = _matched(told, parts, same("conv", "c") & (F.col("part") < F.col("p"))).groupBy("conv", "p", "speaker", "text").agg(F.max("t").alias("t"))
        every = cut.unionByName(carried.select("conv", F.col("p").alias("part"), "t"))
    talks = every.groupBy("conv", "part").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    speakers = cut.where(~F.col("t.speaker").isin(*system)).select(F.col("conv").alias("c"), F.col("t.speaker").alias("perspective")).distinct()
    return _matched(talks, staged(speakers, "chat-speakers"), same("conv", "c")).select(F.col("conv").alias("conv_id"), "part", "turns", "perspective")


def _rendered(each: DataFrame, system: tuple[str, ...]) -> DataFrame:
    """(conv_id, part, perspective, n_turns, text, mask) of (conv_id, part, perspective, turns)."""
    own = F.col("perspective")

    def head(t):
        role = F.when(t["speaker"] == own, F.lit("assistant")).when(t["speaker"].isin(*system), F.lit("system")).otherwise(F.concat(F.lit("user name="), _plain(F.regexp_replace(t["speaker"], "[\r\n]", " "))))
        return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"))

    body = lambda t: F.concat(_plain(t["text"]), F.lit("<|im_end|>"))
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), body(t).alias("body"), (t["speaker"] == own).alias("own")))
    cut = each.withColumn("pieces", pieces)

    def step(acc, p):
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        return F.struct((end + 1).alias("at"), F.when(p["own"], F.array_append(acc["spans"], F.struct(start.alias("start"), end.alias("end")))).otherwise(acc["spans"]).alias("spans"))

    mask = F.aggregate("pieces", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_MASK).alias("spans")), step, lambda acc: acc["spans"])
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "")
    return cut.select("conv_id", "part", "perspective", F.size("turns").cast("long").alias("n_turns"), text.alias("text"), mask.alias("mask"))


def _together(runs: DataFrame) -> DataFrame:
    """The renderings of a conversation's runs as one, their spans moved to where each run begins."""
    order = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = staged(runs, "chat-rendered")
    places = runs.select("conv_id", "perspective", "part", F.coalesce(F.sum(F.length("text")).over(order), F.lit(0)).alias("base"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("s")) & (F.col("part") == F.col("p"))
    placed = runs.join(places.select(F.col("conv_id").alias("c"), F.col("perspective").alias("s"), F.col("part").alias("p"), "base"), same)
    moved = F.transform("mask", lambda m: F.struct((m["start"] + F.col("base")).alias("start"), (m["end"] + F.col("base")).alias("end")))
    own = F.array_sort(F.collect_list(F.struct("part", "text", moved.alias("mask")))).alias("runs")
    whole = placed.groupBy("conv_id", "perspective").agg(F.sum("n_turns").alias("n_turns"), own)
    return whole.select("conv_id", F.lit(0).cast("long").alias("part"), "perspective", "n_turns", F.array_join(F.col("runs.text"), "").alias("text"), F.flatten(F.col("runs.mask")).alias("mask"))


def rotate_perspectives(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
    system: tuple[str, ...] = SYSTEM,
    part_turns: int | None = None,
) -> DataFrame:
    """(conv_id, part, perspective, n_turns, text, mask): one row per participant of each dialogue, part 0; n_turns counts the turns in its text.

    With part_turns, a dialogue of more turns than that becomes several rows a participant.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    said = turns.select(F.col(conv_col).alias("conv_id"), turn.alias("t"))
    most = part_turns or PART_TURNS
    long = said.groupBy(F.col("conv_id").alias("conv")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).drop("n")
    long = staged(long, "chat-long")
    some = long.count()
    short = said.join(bounded_broadcast(long, some, ROW_BYTES), F.col("conv_id").eqNullSafe(F.col("conv")), "left_anti") if some else said
    talks = short.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")).withColumn("part", F.lit(0).cast("long"))
    speakers = F.array_except(F.transform("turns", lambda t: t["speaker"]), F.array(*[F.lit(s) for s in system]))
    out = _rendered(talks.withColumn("perspective", F.explode(F.array_distinct(speakers))), system)
    if some:
        runs = _rendered(_runs(said, long, system, most, carry=part_turns is not None), system)
        out = out.unionByName(runs if part_turns else _together(runs))
    return out
