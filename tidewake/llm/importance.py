"""Resampling by importance: documents drawn by how much likelier the target's distribution makes them.

Features are runs of words hashed to buckets.  The sparse matrix of documents
by buckets is written once, a row a document, and worked on as CSR blocks; its
column sums are the distribution of all documents, and its product with the
gains of the buckets gives every document's weight.  A seeded Gumbel draw turns weights into a
sample without replacement, ranked by a range sort.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm import vectext
from tidewake.llm._shared import partitions, removed, settled, shared_dir

BUCKETS = 10_000
MAX_RUN = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Rows of a CSR block at most, and bytes of their texts.
BLOCK_ROWS, BLOCK_BYTES = 4096, 1 << 24

#: Bytes between words: ASCII that is neither letter nor digit.
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

#: A row of the matrix; the lists of a batch of rows, laid end to end, are a CSR block.
_ROWS = "id long, words long, features long, indices array<int>, counts array<int>"


def csr_of(texts: list[memoryview], buckets: int = BUCKETS, max_run: int = MAX_RUN):
    """(words, features, indptr, indices, counts) of a list of texts."""
    n = len(texts)
    n_words, n_features = np.zeros(n, np.int64), np.zeros(n, np.int64)
    keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    tail: list[bytes] = []
    for rows, joined, more in vectext.stretches(texts):
        # A long text's stretch begins with the last words of the one before, for runs that span both.
        tail = tail if more else []
        words = vectext.words_of(rows, b" ".join([*tail, joined]), texts, _APART)
        row, old = np.asarray(rows, np.int64)[words.row], len(tail)
        if len(rows) == 1 and max_run > 1:
            tail = [words.data[a:b].tobytes() for a, b in zip(words.start[1 - max_run :], words.end[1 - max_run :], strict=True)]
        if len(words) == old:
            continue
        np.add.at(n_words, row[old:], 1)
        found = []
        for run in range(1, max_run + 1):
            first = np.arange(max(0, old - run + 1), len(words) - run + 1)
            first = first[row[first] == row[first + run - 1]]
            start, end = words.start[first], words.end[first + run - 1]
            np.add.at(n_features, row[first], 1)
            found.append(row[first] * buckets + (vectext.crc32(words.data, start, end - start) % np.uint32(buckets)).astype(np.int64))
        key, count = np.unique(np.concatenate(found), return_counts=True)
        keys.append(key)
        times.append(count)
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.zeros(len(key), np.int64)
    np.add.at(counts, back, np.concatenate(times))
    indptr = np.searchsorted(key, np.arange(n + 1) * buckets)
    return n_words, n_features, indptr, key % buckets, counts


def _cut(texts: list[memoryview]) -> Iterator[tuple[int, int]]:
    """Ranges of at most BLOCK_ROWS texts that hold at most BLOCK_BYTES, or one longer text."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if i > at and (i - at == BLOCK_ROWS or size + len(text) > BLOCK_BYTES):
            yield at, i
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)


def _matrix_batches(buckets: int, max_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = vectext.text_bytes(batch.column(1))
            for start, end in _cut(texts):
                words, features, indptr, indices, counts = csr_of(texts[start:end], buckets, max_run)
                ends = pa.array(indptr, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (indices, counts)]
                yield pa.record_batch([batch.column(0).slice(start, end - start), pa.array(words), pa.array(features), *lists], names=["id", "words", "features", "indices", "counts"])

    return run


def write_matrix(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, max_run: int = MAX_RUN) -> DataFrame:
    """The matrix of ``docs``, written to ``path`` and read back.

    A Parquet row is one row of the matrix, ``buckets`` numbers at most.  Readers
    and writers hold some thousand rows at once and look at their size only
    between rows, so rows that held whole blocks would add up by the partition.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows.mapInArrow(_matrix_batches(buckets, max_run), _ROWS).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _sum_batches(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            indices = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            counts = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(indices, counts, buckets).astype(np.int64)  # exact: sums of one batch lie far below 2**53
        live = np.flatnonzero(total)
        yield pa.record_batch([pa.array(live.astype(np.int32)), pa.array(total[live])], names=["bucket", "n"])

    return run


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all blocks, added up in each task before the shuffle."""
    parts = blocks.select("indices", "counts").mapInArrow(_sum_batches(buckets), "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket from the column sums of two matrices, one added to every count."""
    both = (
        source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
        .join(source.withColumnRenamed("n", "s"), "bucket", "left")
        .join(target.withColumnRenamed("n", "t"), "bucket", "left")
        .select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    )
    both = settled(both)
    total = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    odds = (F.col("t") + 1) * F.lit((total["s"] or 0.0) + buckets) / ((F.col("s") + 1) * F.lit((total["t"] or 0.0) + buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(odds)).alias("gain"))


def _product_batches(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in batches:
            indptr = batch.column(3).offsets.to_numpy().astype(np.int64)
            indices, counts = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (3, 4))
            upto = np.concatenate([[0], np.cumsum(gain[indices] * counts.astype(np.int64))])
            weight = upto[indptr[1:] - indptr[0]] - upto[indptr[:-1] - indptr[0]]
            yield pa.record_batch([*(batch.column(i) for i in range(3)), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    return run


def weights(blocks: DataFrame, gain: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, weight) of every row of the matrix: its product with the gains.

    The gains, ``buckets`` numbers, are the only thing sent to the tasks.
    """
    vector = np.zeros(buckets, np.int64)
    for row in gain.collect():  # a row a bucket
        vector[row["bucket"]] = row["gain"]
    held = blocks.sparkSession.sparkContext.broadcast(vector)
    return blocks.mapInArrow(_product_batches(held), "id long, n_words long, n_features long, weight long")


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """A seeded Gumbel draw of every id in thousandths, rounded down; a null id draws as no digits."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """``rows`` with ``rank``, 1 to ``most`` in the given order and null beyond.

    A range sort, whose partitions are counted (a number each on the driver),
    gives every row its place; no window holds all rows.
    """
    spark = rows.sparkSession
    dealt = settled(settled(rows).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order))
    dealt = dealt.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"))
    sizes = {r["__part"]: r["count"] for r in dealt.groupBy("__part").count().collect()}
    before, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    offset = F.broadcast(spark.createDataFrame(offsets, "__part int, __before long"))
    place = F.col("__before") + F.col("__at") + 1
    return dealt.join(offset, "__part").withColumn("rank", F.when(place <= most, place)).drop("__part", "__before", "__at")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    buckets: int = BUCKETS,
    max_run: int = MAX_RUN,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of ``docs``.

    ``percent`` of the rows with ``least_words`` words or more are drawn, by
    the highest score, ties to the smaller id; undrawn rows have a null rank.

    A null or empty text has no features and weighs 0.  Null ids come last
    among ties; rows of the same id and score follow the number of features
    and are otherwise alike.  Repeated rows are drawn each for itself.  Only
    the id and the text are read, so other columns may have any name.  An
    empty target gives every bucket the same odds as an unseen one; an empty
    ``docs`` gives an empty table.
    """
    spark = docs.sparkSession
    at = f"{shared_dir(spark)}/csr-{uuid.uuid4().hex}"
    blocks = write_matrix(docs, f"{at}/docs", id_col, text_col, buckets, max_run)
    aims = write_matrix(target.select(F.lit(None).cast("long").alias("id"), F.col(target_text_col).alias("text")), f"{at}/target", "id", "text", buckets, max_run)
    gain = gains(column_sums(blocks, buckets), column_sums(aims, buckets), buckets)
    scored = weights(blocks, gain, buckets).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    scored = settled(scored.withColumn("__fits", F.col("n_words") >= least_words))
    removed(spark, at)
    most = percent * scored.where("__fits").count() // 100
    order = [F.col("__fits").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features").asc()]
    return ranked(scored, order, most).drop("__fits")
