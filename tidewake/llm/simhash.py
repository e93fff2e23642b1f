"""Near-duplicate documents by 64-bit SimHash fingerprints and Golay-code fuzzy hashing.

Every binary word of 23 bits lies within 3 bits of exactly one word of the
perfect Golay code, and two words that differ in at most 2 bits always have a
codeword within 4 bits of both.  A word has one codeword within 4 bits, or six
if its nearest is 3 bits away.  So the indices of the codewords within 4 bits
are a handful of keys that agree between any two words differing in 2 bits or
fewer.

A fingerprint is cut into four segments of 16 bits, each padded to 23.  When
two fingerprints differ in at most 4 bits, by pigeonhole one of these holds:

* two segments are equal: keys of both segments as they are;
* one segment is equal and the other three hold 1, 1 and at most 2 errors: of
  any two of those three one has a single error, so a key of the equal segment
  with the codeword indices of either of the next two segments agrees;
* every segment holds one error: the codeword indices of segment 0 with one
  clean byte of segment 1 and one of segment 2.

Rows that share a key are compared bit by bit, so the links are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm import vectext
from tidewake.llm._shared import partitions, settled
from tidewake.llm.components import connected_components

SHINGLE_WORDS = 4
MAX_BITS = 4
#: Generator polynomial of the binary Golay code of length 23 (a fixed value).
GENERATOR = 0b110001110101
#: Rows sharing a key are compared offset by offset up to this many, beyond it by pivots.
SMALL_GROUP = 24


def _syndrome(word: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word modulo the generator polynomial."""
    rest = word.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def codeword_table() -> np.ndarray:
    """For each 16-bit segment, the 12-bit indices of the codewords within 4 bits; -1 fills up to six."""
    patterns = {k: np.array([sum(1 << b for b in c) for c in combinations(range(23), k)], np.int64) for k in range(5)}
    leader, weight = np.zeros(2048, np.int64), np.zeros(2048, np.int64)
    for k in range(4):
        s = _syndrome(patterns[k])
        leader[s], weight[s] = patterns[k], k
    order = np.argsort(four := _syndrome(patterns[4]), kind="stable")
    further = np.zeros((2048, 5), np.int64)
    further[four[order][::5]] = patterns[4][order].reshape(-1, 5)
    segment = np.arange(1 << 16, dtype=np.int64)
    s = _syndrome(segment)
    table = np.full((1 << 16, 6), -1, np.int64)
    table[:, 0] = (segment ^ leader[s]) >> 11
    far = weight[s] == 3
    table[far, 1:] = (segment[far, None] ^ further[s[far]]) >> 11
    return table


_TABLE: list[np.ndarray] = []


def fuzzy_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position in ``fingerprints``) of every key; the kind of key is its top bits."""
    if not _TABLE:
        _TABLE.append(codeword_table())
    seg = [(fingerprints >> np.uint64(16 * k)).astype(np.int64) & 0xFFFF for k in range(4)]
    near = [_TABLE[0][s] for s in seg]
    at = np.arange(len(fingerprints))
    keys, rows = [], []

    def add(kind: int, payload: np.ndarray, where: np.ndarray) -> None:
        keys.append(payload | (kind << 40))
        rows.append(where)

    for kind, (a, b) in enumerate(combinations(range(4), 2)):
        add(kind, seg[a] << 16 | seg[b], at)
    for a in range(4):
        for step in (1, 2):
            codes = near[(a + step) % 4]
            for j in range(6):
                live = np.flatnonzero(codes[:, j] >= 0)
                add(8 + 2 * a + step, seg[a][live] << 12 | codes[live, j], live)
    for first in (0, 8):
        for second in (0, 8):
            clean = (seg[1] >> first & 255) << 8 | (seg[2] >> second & 255)
            for j in range(6):
                live = np.flatnonzero(near[0][:, j] >= 0)
                add(24 + first // 4 + second // 8, clean[live] << 12 | near[0][live, j], live)
    return np.concatenate(keys), np.concatenate(rows)


def fingerprints_of(texts: list[memoryview]) -> np.ndarray:
    """The SimHash of each text over its word shingles."""
    n = len(texts)
    ones, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    for rows, joined, more in vectext.stretches(texts, SHINGLE_WORDS - 1):
        words = vectext.words_of(rows, joined, texts)
        if not len(words):
            continue
        count = np.bincount(words.row, minlength=len(rows))
        begin = np.concatenate([[0], np.cumsum(count)[:-1]])
        shingles = np.maximum(count - (SHINGLE_WORDS - 1), np.minimum(count, 1))
        if more or len(texts[rows[0]]) > vectext.STRETCH:
            shingles = np.maximum(count - (SHINGLE_WORDS - 1), 0)  # the last words are carried on
        owner = np.repeat(np.arange(len(rows)), shingles)
        if not len(owner):
            continue
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
        first = begin[owner] + offset
        last = np.minimum(first + SHINGLE_WORDS - 1, begin[owner] + count[owner] - 1)
        h = vectext.xxh64(words.data, words.start[first], words.end[last] - words.start[first])
        live = np.flatnonzero(shingles)
        cuts = (np.cumsum(shingles) - shingles)[live]
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        to = np.asarray(rows)[live]
        ones[to] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
        total[to] += shingles[live]
    for i in np.flatnonzero(total == 0):  # long texts of fewer words than a shingle
        if len(texts[i]) > vectext.STRETCH and (left := b" ".join(bytes(texts[i]).split())):
            data = np.frombuffer(left + bytes(32), np.uint8)
            h = vectext.xxh64(vectext._LOWER[data], np.array([0]), np.array([len(left)]))
            ones[i] = np.unpackbits(h.view(np.uint8), bitorder="little")
            total[i] = 1
    over = (2 * ones > total[:, None]).astype(np.uint8)
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = fingerprints_of(vectext.text_bytes(batch.column(1)))
        yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; a null or wordless text has fingerprint 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "id long, fp long")


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(fps), 4096):
            part = fps[at : at + 4096]
            keys, rows = fuzzy_keys(part.view(np.uint64))
            yield pa.record_batch([pa.array(keys), pa.array(part[rows])], names=["k", "fp"])


def _close(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= max_bits


def group_links(fps: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what pairwise comparison of one group would connect, one per joined row.

    Each row visited is held against those not joined yet; what it finds close
    is joined to it and visited later.  A dense group is thus used up after few
    visits, and its links number fewer than its rows.
    """
    waiting, out = np.unique(fps), []
    while len(waiting) > 1:
        queue, waiting = [waiting[:1]], waiting[1:]
        while queue and len(waiting):
            pivots = queue.pop()
            for p in pivots:
                hit = _close(waiting, p, max_bits)
                if hit.any():
                    found = waiting[hit]
                    out.append((np.full(len(found), p), found))
                    waiting = waiting[~hit]
                    queue.append(found)
                    if not len(waiting):
                        break
    return out


def _link_batches(batches: Iterator[pa.RecordBatch], max_bits: int = MAX_BITS) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a group that a batch cuts is held over to the next."""
    hold_k, hold_f = np.zeros(0, np.int64), [np.zeros(0, np.uint64)]

    def links(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(k) < 2:
            return
        cuts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.concatenate([cuts, [len(k)]]))
        pairs = []
        for begin, n in zip(cuts[size > SMALL_GROUP], size[size > SMALL_GROUP], strict=True):
            pairs += group_links(f[begin : begin + n], max_bits)
        small = np.repeat(size <= SMALL_GROUP, size) & np.repeat(size > 1, size)
        k, f = k[small], f[small]
        for step in range(1, SMALL_GROUP):
            same = np.flatnonzero(k[step:] == k[:-step])
            if not len(same):
                break
            same = same[_close(f[same], f[same + step], max_bits)]
            pairs.append((f[same], f[same + step]))
        a = np.concatenate([x for x, _ in pairs] or [f[:0]]).view(np.int64)
        b = np.concatenate([x for _, x in pairs] or [f[:0]]).view(np.int64)
        if len(a):
            low, high = np.minimum(a, b), np.maximum(a, b)
            both = np.unique(np.stack([low, high], 1)[low != high], axis=0)
            yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    for batch in batches:
        k = batch.column(0).to_numpy(zero_copy_only=False)
        f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(k):
            continue
        if len(hold_k) and k[-1] == hold_k[0]:
            hold_f.append(f)
            continue
        f = np.concatenate([*hold_f, f])
        k = np.concatenate([np.full(len(f) - len(k), hold_k[0] if len(hold_k) else 0), k])
        last = int(np.searchsorted(k == k[-1], True)) if k[0] != k[-1] else 0
        yield from links(k[:last], f[:last])
        hold_k, hold_f = k[-1:], [f[last:]]
    f = np.concatenate(hold_f)
    yield from links(np.full(len(f), 0), f)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component) of every row of ``docs``.

    component is the smallest id reachable over links of at most MAX_BITS
    differing bits.  Only distinct fingerprints are keyed and shuffled, so a
    group of exact copies is one row; a key's group holds 8 bytes a fingerprint.

    Null and wordless texts have fingerprint 0 and link like any other.  A null
    id never becomes a component's id unless no other is there (then null).
    Repeated rows come back as often as they were given; an empty table gives
    an empty one; other columns of ``docs`` are not read.
    """
    rows = settled(fingerprint_table(docs, id_col, text_col))
    distinct = settled(rows.groupBy("fp").agg(F.min("id").alias("least")))
    n = max(partitions(docs.sparkSession), 1)
    keyed = distinct.select("fp").mapInArrow(_key_batches, "k long, fp long")
    dealt = keyed.repartition(n, "k").sortWithinPartitions("k")
    links = dealt.mapInArrow(_link_batches, "a long, b long")
    roots = connected_components(links)
    labelled = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = labelled.groupBy("label").agg(F.min("least").alias("component"))
    labelled = labelled.join(named, "label").select("fp", "component")
    return rows.join(labelled, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, without those that a row of a smaller id stands for.

    Rows with a null id are kept.
    """
    marked = near_duplicates(docs, id_col, text_col)
    dropped = marked.where("id <> component").select(F.col("id").alias("__dropped")).distinct()
    return docs.join(dropped, F.col(id_col) == F.col("__dropped"), "left_anti")
