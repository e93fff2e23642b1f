"""Chat transcripts: snapshots of a growing conversation collapsed, the rest rendered.

A logger that writes the whole conversation after every turn leaves prefixes
of the final one.  Every turn gets the hash of the conversation up to it; a
conversation whose hash is some longer one's prefix hash is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm._shared import settled

#: Turns that are rendered into one row; longer conversations take several rows.
CHUNK_TURNS = 64
#: Turn numbers that one window of a conversation covers.
SPAN = 256


def _numbered(turns: DataFrame) -> DataFrame:
    """(rid, conv_id, place, p1, p2): number of the row, its place in the conversation and hash of it so far.

    Places and hashes are first made within spans of turn numbers and then
    carried over the spans before, so one very long conversation is many tasks'
    work.  The hash is the exclusive or of 128 bits for each place and turn.
    Texts are only hashed here, so none is shuffled.
    """
    text = F.col("text").cast("string")
    rows = turns.select(
        F.monotonically_increasing_id().alias("rid"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        text.isNull().alias("mute"), F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2"),
    ).withColumn("span", F.floor(F.col("turn") / SPAN))
    inside = Window.partitionBy("conv_id", "span").orderBy("turn", "role", F.desc("mute"), "t1", "t2")
    rows = rows.withColumn("in_span", F.row_number().over(inside))
    before = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("conv_id", "span").agg(F.count(F.lit(1)).alias("n"))
    spans = spans.select(F.col("conv_id").alias("c"), F.col("span").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("span").eqNullSafe(F.col("s"))
    rows = rows.join(spans, same).withColumn("place", F.col("in_span") + F.col("skip")).drop("c", "s", "skip")
    parts = [F.col("place"), F.col("role").isNull(), "role", "mute", "t1", "t2"]
    rows = rows.withColumn("h1", F.xxhash64(F.lit(1), *parts)).withColumn("h2", F.xxhash64(F.lit(2), *parts))
    to_here = Window.partitionBy("conv_id", "span").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("x1", F.bit_xor("h1").over(to_here)).withColumn("x2", F.bit_xor("h2").over(to_here))
    whole = rows.groupBy("conv_id", "span").agg(F.bit_xor("h1").alias("t1"), F.bit_xor("h2").alias("t2"))
    zero = F.lit(0).cast("long")
    whole = whole.select(F.col("conv_id").alias("c"), F.col("span").alias("s"), F.coalesce(F.bit_xor("t1").over(before_by("conv_id", "span")), zero).alias("b1"), F.coalesce(F.bit_xor("t2").over(before_by("conv_id", "span")), zero).alias("b2"))
    rows = rows.join(whole, same)
    return rows.select("rid", "conv_id", "place", F.col("x1").bitwiseXOR(F.col("b1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("b2")).alias("p2"))


def before_by(key: str, order: str):
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def rendered(role: Column, text: Column) -> Column:
    """One turn between markers; a null role is ``unknown`` and a null text is empty."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, kept, kept_by, chunk, text) from turns(conv_id, turn, role, text).

    A maximal conversation has one row for every CHUNK_TURNS turns, whose texts
    in order of chunk are the transcript.  A dropped one has a single row with
    no text; kept_by is the longest conversation that begins with it, of equals
    the one with the smallest conv_id.  Of equal conversations the smallest
    conv_id is kept.

    Turns are ordered by turn, role and the text's hash, nulls first; repeated
    turns and null roles, texts and turns are turns like others; rows with a
    null conv_id are one conversation, which comes after all ids.  Other columns
    are not read; an empty table gives an empty one.  ``turns`` is read twice
    and must give its rows in the same partitions both times, as a Parquet table
    does.
    """
    rows = settled(_numbered(turns))
    lengths = rows.groupBy("conv_id").agg(F.max("place").alias("n_turns")).withColumnRenamed("conv_id", "c")
    slim = rows.select("conv_id", "place", "p1", "p2").join(lengths, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    longest = F.max(F.struct(F.col("n_turns"), F.col("conv_id").isNotNull().alias("known"), (-F.col("conv_id")).alias("back"))).alias("top")
    prefixes = slim.groupBy("place", "p1", "p2").agg(longest)
    whole = slim.where("place = n_turns")
    # Only prefixes that something longer or smaller extends can drop a conversation.
    fate = whole.join(prefixes, ["place", "p1", "p2"]).select("conv_id", "n_turns", (-F.col("top.back")).alias("kept_by"))
    fate = settled(fate.withColumn("kept", F.col("conv_id").eqNullSafe(F.col("kept_by"))))
    gone = fate.where("not kept").select(F.col("conv_id").alias("c"))
    places = rows.select("rid", "conv_id", "place").join(gone, F.col("conv_id").eqNullSafe(F.col("c")), "left_anti")
    said = turns.select(F.monotonically_increasing_id().alias("rid"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    stay = said.join(places, "rid")
    chunk = F.floor((F.col("place") - 1) / CHUNK_TURNS)
    parts = stay.groupBy("conv_id", chunk.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("place", rendered(F.col("role"), F.col("text")).alias("t")))).alias("parts"))
    parts = parts.select(F.col("conv_id").alias("c"), "chunk", F.array_join(F.transform("parts", lambda x: x["t"]), "").alias("text"))
    shown = fate.join(parts, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("kept"), "left")
    return shown.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "kept", "kept_by", F.col("chunk").cast("long").alias("chunk"), "text")
