"""Exact duplicate documents with two passes of a Bloom filter.

Pass one sets bits for every text's hash and remembers which bits two rows
set.  Pass two asks those bits: a row with a bit that only it set can't have a
copy and goes straight through; the others are grouped by SHA-256.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm._shared import partitions, settled, shared_dir

#: Bits of the filter for each row.
BITS_PER_ROW = 16
#: Most that the driver collects and broadcasts at once.  Hashes of more rows
#: are tested range by range, each with a filter of its own.
MAX_FILTER_BYTES = 64 << 20
#: Bits that one task merges.
SEGMENT_BITS = 1 << 20
#: A group's rows are dealt to so many keys.
SALTS = 16


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a 64-bit hash; ``bits`` is a power of two below 2**32."""
    h = h.view(np.uint64)
    mask = np.uint64(bits - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def _occupied(bits: int):
    """Each task's distinct bits by segment, and which of them several of its rows set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _places(batch.column(0).to_numpy(zero_copy_only=False), bits)
            places = np.concatenate([a, b[a != b]])
            place, count = np.unique(places, return_counts=True)
            segment = (place // SEGMENT_BITS).astype(np.int64)
            for s in np.unique(segment):
                mine = segment == s
                local = (place[mine] % SEGMENT_BITS).astype(np.uint32)
                yield pa.record_batch([pa.array([int(s)]), pa.array([local.tobytes()]), pa.array([np.packbits(count[mine] > 1).tobytes()])], names=["segment", "places", "several"])

    return run


def _merged(least: int):
    """One bitmap a segment of the bits that ``least`` rows or more set, one or two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, places, several in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                local = np.frombuffer(places, np.uint32)
                if s not in once:
                    once[s], twice[s] = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
                many = np.unpackbits(np.frombuffer(several, np.uint8), count=len(local)).astype(bool)
                twice[s][local[once[s][local] | many]] = True
                once[s][local] = True
        for s, seen in (once if least == 1 else twice).items():
            yield pa.record_batch([pa.array([s]), pa.array([np.packbits(seen).tobytes()])], names=["segment", "bits"])

    return run


def bloom_test(hashes: DataFrame, n_rows: int, least: int = 2):
    """Column function: may ``least`` rows of ``hashes``, one or two, have this hash?

    ``hashes`` has one long column.  The filter grows with ``n_rows`` up to
    MAX_FILTER_BYTES, which is what the driver collects and broadcasts at most.
    """
    spark = hashes.sparkSession
    most = MAX_FILTER_BYTES * 8
    bits = SEGMENT_BITS
    while bits < min(most, BITS_PER_ROW * n_rows):
        bits *= 2
    blocks = hashes.mapInArrow(_occupied(bits), "segment long, places binary, several binary")
    n = max(1, min(bits // SEGMENT_BITS, partitions(spark)))
    found = blocks.repartition(n, "segment").mapInArrow(_merged(least), "segment long, bits binary")
    filled = np.zeros(bits // 8, np.uint8)
    for row in settled(found).collect():  # MAX_FILTER_BYTES in all
        at = row["segment"] * SEGMENT_BITS // 8
        filled[at : at + SEGMENT_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    held = spark.sparkContext.broadcast(filled)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        filled = held.value
        answers = [filled[p >> np.uint64(3)] >> (7 - (p & np.uint64(7))).astype(np.uint8) & 1 for p in _places(h.to_numpy(np.int64), bits)]
        return pd.Series((answers[0] & answers[1]).astype(bool))

    return test


def ranges_of(n_rows: int, most_bytes: int = MAX_FILTER_BYTES) -> int:
    """Into how many ranges the hashes of so many rows are cut, a power of two."""
    parts = 1
    while BITS_PER_ROW * n_rows > 8 * most_bytes * parts:
        parts *= 2
    return parts


def possible_copies(hashes: DataFrame, most_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """``hashes``, with a column ``h``, and ``maybe``: whether another row may have the same.

    One filter serves all rows if it may be as large; else the rows are written
    by ranges of their hashes, and every range has its filter, so the bits for
    a row and the rate of false alarms stay what they are at any size.
    """
    hashes = settled(hashes)
    n = hashes.count()
    parts = ranges_of(n, most_bytes)
    if parts == 1:
        test = bloom_test(hashes.select("h"), n)
        return hashes.withColumn("maybe", test("h"))
    spark = hashes.sparkSession
    at = f"{shared_dir(spark)}/hashes-{uuid.uuid4().hex}"
    of_range = F.shiftrightunsigned("h", 64 - parts.bit_length() + 1).cast("int")
    hashes.withColumn("part", of_range).write.partitionBy("part").parquet(at)
    out = None
    for part in range(parts):
        mine = spark.read.parquet(at).where(F.col("part") == part).drop("part")
        test = bloom_test(mine.select("h"), mine.count())
        tested = mine.withColumn("maybe", test("h"))
        out = tested if out is None else out.unionByName(tested)
    return out


def _digests(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.unhex(F.sha2(text, 256)).alias("sha"))


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(id, keep_id, group_size, kept, sha) of every row.

    Null texts count as empty.  Of equal texts the largest id is kept, null ids
    last; if several rows have that id, one of them.  A group of null ids only
    keeps one row and has a null keep_id.  Other columns are not read; an empty
    table gives an empty one.
    """
    rows = _digests(docs, id_col, F.coalesce(F.col(text_col), F.lit(""))).withColumn("rid", F.monotonically_increasing_id())
    flagged = settled(possible_copies(rows, most_bytes).drop("h"))
    alone = flagged.where("not maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    possible = flagged.where("maybe").withColumn("salt", F.pmod("rid", F.lit(SALTS)).cast("int"))
    groups = possible.groupBy("sha", "salt").agg(
        F.count(F.lit(1)).alias("n"),
        # The row that stays: largest id, then the first row written.
        F.max(F.struct(F.col("id").isNotNull().alias("known"), F.col("id").alias("id"), (-F.col("rid")).alias("back"))).alias("top"),
    )
    total = groups.groupBy("sha").agg(F.sum("n").alias("group_size"), F.max("top").alias("top"))
    dealt = groups.select("sha", "salt").join(total, "sha")
    grouped = possible.join(dealt, ["sha", "salt"]).select("id", F.col("top.id").alias("keep_id"), "group_size", (F.col("top.back") == -F.col("rid")).alias("kept"), "sha")
    return alone.unionByName(grouped)


def keep_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """``docs``, all columns, with one row of each text: that of the largest id.

    Only rows that the filter takes for possible copies shuffle, and only they
    are written down on the way; all others pass straight through.  If the
    hashes take several filters, the rows to drop are found from the digests
    and dropped by their number; ``docs`` then has to give its rows in the same
    partitions both times, as a Parquet table does.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.col("id").isNotNull().alias("known"), F.col("id"), (-F.col("rid")).alias("back"))

    def stays(possible: DataFrame) -> DataFrame:
        """``rid`` of the row of each sha that stays."""
        top = possible.groupBy("sha", F.pmod("rid", F.lit(SALTS)).alias("salt")).agg(F.max(key).alias("top"))
        return top.groupBy("sha").agg((-F.max("top")["back"]).alias("stays")).select("stays")

    hashes = settled(docs.select(F.xxhash64(text).alias("h")))
    n = hashes.count()
    if ranges_of(n, most_bytes) > 1:
        rows = _digests(docs, id_col, text).withColumn("rid", F.monotonically_increasing_id())
        possible = settled(possible_copies(rows, most_bytes).where("maybe").drop("h", "maybe"))
        gone = possible.join(stays(possible), F.col("rid") == F.col("stays"), "left_anti").select("rid")
        return docs.withColumn("__rid", F.monotonically_increasing_id()).join(gone, F.col("__rid") == F.col("rid"), "left_anti").drop("__rid")
    maybe = bloom_test(hashes, n)
    tested = docs.withColumn("__maybe", maybe(F.xxhash64(text)))
    alone = tested.where("not __maybe").drop("__maybe")
    possible = tested.where("__maybe").drop("__maybe")
    possible = settled(possible.withColumn("__rid", F.monotonically_increasing_id()).withColumn("__sha", F.unhex(F.sha2(text, 256))))
    kept = possible.join(stays(possible.select(F.col(id_col).cast("long").alias("id"), F.col("__sha").alias("sha"), F.col("__rid").alias("rid"))), F.col("__rid") == F.col("stays"), "left_semi")
    return alone.unionByName(kept.drop("__rid", "__sha"))
