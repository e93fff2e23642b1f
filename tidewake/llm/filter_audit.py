"""How filters of documents interact: what each removes, repeats and costs in every order.

Rows are range-sorted by text fingerprint, full text and id, so that a row's
copies stand before it; every row is compared with its predecessor, and texts
that a partition's bounds cut are settled by their least ids.  A row's
failures are a mask of five bits, masks are counted by part, and the counts of
every order and step are sums over masks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import vectext
from tidewake.llm._shared import partitions, settled

LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 2
SYMBOLS = b"#$%&*|"
FILTERS = "ABCDE"

_CAPITALS = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))


def text_mask(text: memoryview) -> int:
    """Bits of the filters A to D that a text fails; a long text is read in stretches."""
    n_words = capitals = points = symbols = 0
    distinct: set[bytes] = set()
    for _, piece, _ in vectext.stretches([text]):
        words = piece.split()  # bytes are split at the same six characters as words are
        n_words += len(words)
        distinct.update(words)
        capitals += len(piece) - len(piece.translate(None, _CAPITALS))
        points += len(piece.translate(None, _CONTINUED))
        symbols += len(piece) - len(piece.translate(None, SYMBOLS))
    fails = (n_words < LEAST_WORDS, 100 * len(distinct) < LEAST_DISTINCT * n_words, 100 * capitals > MOST_CAPITALS * points, symbols > 0)
    return sum(1 << i for i, failed in enumerate(fails) if failed)


def _mask_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition's (id, part, fp, sha, mask); the last bit is that of a smaller id before it here."""
    last_fp, last_text, low, mask, sha = None, None, None, 0, b""
    for batch in batches:
        ids, fps = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        masks, shas = np.zeros(len(ids), np.int32), []
        for i, text in enumerate(vectext.text_bytes(batch.column(3))):
            if fps[i] != last_fp or text.nbytes != len(last_text) or bytes(text) != last_text:
                last_fp, last_text, low = fps[i], bytes(text), ids[i]
                mask, sha = text_mask(text), hashlib.sha256(text).digest()
            copy = low is not None and (ids[i] is None or ids[i] > low)
            masks[i] = mask | copy << 4
            shas.append(sha)
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(shas, pa.binary()), pa.array(masks)], names=["id", "part", "fp", "sha", "mask"])


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask) of every row; bit i stands for the i-th of FILTERS.

    Ranges are cut by fingerprint and id, so a text of any number of copies is
    spread over many tasks and no text is sampled; inside a range rows are
    sorted by fingerprint, text and id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.xxhash64(text).alias("fp"), text.alias("text"))
    last = F.col("id").asc_nulls_last()
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), F.col("fp").asc(), last).sortWithinPartitions(F.col("fp").asc(), F.col("text").asc(), last)
    masked = settled(dealt.mapInArrow(_mask_batches, "id long, part string, fp long, sha binary, mask int"))
    ends = masked.groupBy(F.spark_partition_id().alias("p")).agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
    # At most two fingerprints a partition; those of two partitions are cut by a bound.
    cut = ends.select("p", F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.countDistinct("p").alias("n")).where("n > 1").select("fp")
    least = settled(masked.join(F.broadcast(cut), "fp").groupBy("fp", "sha").agg(F.min("id").alias("low")))
    found = masked.join(F.broadcast(least), ["fp", "sha"], "left")
    copy = F.col("low").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("low")))
    return found.select("id", "part", F.when(copy, F.col("mask").bitwiseOR(F.lit(16))).otherwise(F.col("mask")).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): the additive counters of all rows of a part that fail alike.

    Only rows that fail a filter meet the labels.  Several labels of one id
    count as one: good or toxic if any says so.
    """
    says = labels.select(F.col(id_col).cast("long").alias("id"), (F.col("quality") == 1).cast("int").alias("good"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    says = says.where("id is not null and (good = 1 or toxic = 1)").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    asked = F.col("id").isNotNull() & (F.col("mask") != 0)
    told = masks.where(asked).join(says, "id", "left").select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    rest = masks.where(~asked).select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return told.unionByName(rest).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))


def outcomes(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """What happens to a row of every mask at every step of every order: a table of fixed size."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    rows = []
    orders = list(permutations(filters))
    for order in orders:
        gone = 0
        for step, f in enumerate(order, 1):
            for mask in range(1 << len(filters)):
                fails, earlier = bool(mask & bit[f]), bool(mask & gone)
                # Of k failed filters each comes first in 1/k of the orders.
                share = len(orders) // mask.bit_count() if fails else 0
                rows.append((mask, "".join(order), step, int(not fails and not earlier), int(fails and not earlier), int(fails and earlier), int(mask == bit[f]), share))
            gone |= bit[f]
    return spark.createDataFrame(rows, "mask int, filter_order string, step int, kept int, removed int, redundant int, alone int, share int")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row for every part, order of the filters and step, with its counts.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley
    are long and never null.  A null text counts as empty, a null part as the
    empty string.  A row without id is no smaller than any other and has no
    labels; among copies it fails E if one of them has an id.  Rows of the same
    text and id don't fail each other.  An empty table gives no rows; parts
    without failures have zeros.  Other columns are not read.
    """
    counts = mask_counts(failure_masks(docs, id_col, text_col, part_col), labels, id_col)
    met = counts.join(F.broadcast(outcomes(docs.sparkSession)), "mask")

    def total(of: str, times: str = "n"):
        return F.sum(F.col(of) * F.col(times)).cast("long")

    return met.groupBy("part", "filter_order", "step").agg(
        total("kept").alias("kept"), total("removed").alias("removed"), total("redundant").alias("redundant"), total("alone").alias("unique_fails"),
        total("removed", "good").alias("good_lost"), total("removed", "toxic").alias("toxic_lost"), total("share").alias("shapley"),
    )
