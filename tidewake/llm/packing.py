"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm._shared import n_words, settled

SIZES = (512, 1024, 2048, 4096, 8192)
#: What a sequence costs besides its words, in words.
BIN_COST = 32
#: Pieces that are packed together; one group is one task's memory.
GROUP_PIECES = 8192
SEED = 23


def pack_lengths(lengths: list[int], sizes: tuple[int, ...] = SIZES, bin_cost: float = BIN_COST) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of each length and the size of each bin.

    Lengths go from the longest to the shortest, each to the open bin with the
    least room that holds it.  If none does, every permitted size is tried: it
    is filled up with the longest lengths left, and the size that costs least
    for each word filled is opened, the larger one of equals.  In the end every
    bin shrinks to the smallest size that holds its contents.
    """
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    left: dict[int, int] = {}
    for x in lengths:
        left[x] = left.get(x, 0) + 1
    have = 0  # bit x: a length x is left
    for x in left:
        have |= 1 << x
    rooms: dict[int, list[int]] = {}
    free = 0  # bit r: a bin with room r is open
    room: list[int] = []
    fill: list[int] = []
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in order:
        x = lengths[i]
        left[x] -= 1
        if not left[x]:
            have &= ~(1 << x)
        fits = free >> x
        if fits:
            r = x + (fits & -fits).bit_length() - 1
            b = rooms[r].pop()
            if not rooms[r]:
                free &= ~(1 << r)
        else:
            best = None
            for c in sizes:
                if c < x:
                    continue
                rest, used, seen = c - x, {}, have
                while fitting := seen & ((1 << (rest + 1)) - 1):
                    y = fitting.bit_length() - 1
                    if not y:
                        break
                    n = min(left[y], rest // y)
                    rest -= n * y
                    seen &= (1 << y) - 1
                price = (c + bin_cost) / (c - rest)
                if best is None or price <= best[0]:
                    best = (price, c)
            b = len(room)
            room.append(best[1])
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += x
        room[b] -= x
        rooms.setdefault(room[b], []).append(b)
        free |= 1 << room[b]
    return bins, offsets, [next(c for c in sizes if c >= f) for f in fill]


SCHEMA = "id long, piece long, start long, length long, grp long, bin long, bin_offset long, bin_size long, bin_fill long"


def _pack_group(sizes: tuple[int, ...], bin_cost: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending"), ("start", "ascending")])
        lengths = table.column("length").to_pylist()
        bins, offsets, chosen = pack_lengths(lengths, sizes, bin_cost)
        which = np.asarray(bins, np.int64)
        fill = np.bincount(which, weights=lengths, minlength=len(chosen)).astype(np.int64)
        columns = [table.column(c) for c in ("id", "piece", "start", "length", "grp")]
        return pa.table([*columns, pa.array(which), pa.array(offsets, pa.int64()), pa.array(np.asarray(chosen, np.int64)[which]), pa.array(fill[which])], names=["id", "piece", "start", "length", "grp", "bin", "bin_offset", "bin_size", "bin_fill"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, ...] = SIZES, bin_cost: float = BIN_COST, seed: int = SEED) -> DataFrame:
    """Where each document's words go: id, piece, start, length and the bin that holds them.

    ``start`` and ``length`` are words of the document; texts over the largest
    size are cut into pieces of that size and a rest, so no word is lost.  A
    bin is named by ``grp`` and ``bin``; the piece begins at ``bin_offset`` in
    it.  Pieces are dealt by a seeded hash to groups of about GROUP_PIECES, so
    memory and the work of a task don't grow with the input, whichever ids or
    rows repeat.

    Texts that are null or without words give one row of length 0 with no bin
    (nulls from ``grp`` on).  Repeated rows are packed as often as they are
    given; null ids are packed; an empty table gives an empty one.
    """
    largest = sizes[-1]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), n_words(F.col(text_col)).alias("words"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("words") - 1, F.lit(0)), F.lit(largest).cast("long"))
    pieces = rows.select("id", "words", F.posexplode(starts).alias("piece", "start"))
    pieces = pieces.select("id", F.col("piece").cast("long").alias("piece"), "start", F.least(F.col("words") - F.col("start"), F.lit(largest)).alias("length"), F.monotonically_increasing_id().alias("row"))
    pieces = settled(pieces)
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    dealt = pieces.where("length > 0").withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "id", "piece", "row"), F.lit(groups)))
    packed = dealt.drop("row").groupBy("grp").applyInArrow(_pack_group(tuple(sizes), bin_cost), SCHEMA)
    none = [F.lit(None).cast("long").alias(c) for c in ("grp", "bin", "bin_offset", "bin_size", "bin_fill")]
    return packed.unionByName(pieces.where("length = 0").select("id", "piece", "start", "length", *none))
