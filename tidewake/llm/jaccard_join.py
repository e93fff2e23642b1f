"""Similarity join of documents by the Jaccard index of their word-shingle sets.

The universe of shingles is cut by hash into segments, more of them for a band
of larger sets.  If two sets differ in at most H shingles and segments i are
given budgets u_i that add up to H + 1, some segment differs in fewer shingles
than its budget.  A budget of 0 skips a segment, 1 asks for an equal subset, 2
for one that differs in one shingle at most, found by an index of the subsets
with one shingle deleted.

* Every set is indexed in its own band under all its subsets and, in some
  designated segments, under their one-deletion neighbours.
* Every set probes its own band and those of smaller sets that can still be
  similar.  Budgets go to the units that cost least: a subset costs as many
  rows as its rarest shingle has documents, by a count sketch over all
  documents; an empty one costs the table.  Costs are convex in the budget, so
  taking the cheapest units one by one is optimal.

Sets that share a key are verified on their whole shingles.  Only connected
components are asked for, so a crowded key first verifies all its sets against
one pivot.  Then, as long as that joins many, those outside the key's largest
component are verified against a few drawn members of it.  What is still of
different components is compared with each other block by block: each set has
a bitmap of the parities of its hashed shingles, and two bitmaps never differ
in more bits than their sets do in shingles, so only pairs that are similar or
nearly so go on to be verified.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm import vectext
from tidewake.llm._shared import partitions, removed, settled, shared_dir
from tidewake.llm.components import connected_components
from tidewake.llm.exact_dedup import bloom_test

SHINGLE_WORDS = 4
PERCENT = 85
#: Counters of the sketch of document frequencies.
SKETCH = 1 << 16
_CHUNK = 1024
#: In bands of more segments than this every 16th segment has a deletion index, else all have.
FEW_SEGMENTS = 8
#: Groups of up to this many sets are compared pair by pair at once.
SMALL_GROUP = 4
#: Sets of one block of a crowded key.
BLOCK = 4096
#: Bytes of a key.  Keys that agree by chance only cost a verification.
KEY_BYTES = 6
#: Members of a key's largest component that others are verified against in a turn.
ANCHORS = 3
#: Rows that a task works on at once.
SLICE = 512

#: Bits of a key's role: a one-deletion neighbour, a probe, one of budget 2, not an index entry.
DELETED, ACTIVE, REACHING, VISITING = 1, 2, 4, 8

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _hashed(words: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """64 bits for each run of ``count`` words, from the words' own hashes."""
    h = np.full(len(first), count, np.uint64)
    for j in range(count):
        h = (h ^ words[first + j]) * _MIX
        h ^= h >> np.uint64(31)
        h *= _ODD
        h ^= h >> np.uint64(29)
    return h


def shingle_sets(texts: list[memoryview], size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles of lower-cased words."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for rows, joined, more in vectext.stretches(texts, size - 1):
        words = vectext.words_of(rows, joined, texts)
        if not len(words):
            continue
        hashes = vectext.xxh64(words.data, words.start, words.end - words.start)
        count = np.bincount(words.row, minlength=len(rows))
        begin = np.cumsum(count) - count
        first = np.arange(len(words) - size + 1)
        first = first[words.row[first] == words.row[first + size - 1]] if len(first) else first
        h = _hashed(hashes, first, size)
        ends = np.cumsum(np.maximum(count - (size - 1), 0))
        for k in np.flatnonzero(count >= size):
            found[rows[k]].append(h[ends[k] - count[k] + size - 1 : ends[k]])
        if not more and len(texts[rows[0]]) <= vectext.STRETCH:  # else the last words are carried on
            for k in np.flatnonzero((count > 0) & (count < size)):
                found[rows[k]].append(_hashed(hashes, begin[k : k + 1], int(count[k])))
    for i, text in enumerate(texts):
        if not found[i] and len(text) > vectext.STRETCH and (left := bytes(text).split()):
            data = vectext._LOWER[np.frombuffer(b" ".join(left) + bytes(32), np.uint8)]
            length = np.array([len(w) for w in left])
            start = np.cumsum(length + 1) - length - 1
            found[i].append(_hashed(vectext.xxh64(data, start, length), np.array([0]), len(left)))
    none = np.zeros(0, np.uint64)
    return [np.unique(np.concatenate(x)) if x else none for x in found]


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class Bands:
    """Sizes of sets by band, and into how many segments each band cuts the universe."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.low: list[int] = [1]
        self.high: list[int] = []
        self.segments: list[int] = []

    def _grow(self, size: int) -> None:
        while not self.high or self.high[-1] < size:
            low = self.low[len(self.high)]
            high = max(low, low * 100 // self.percent)
            self.high.append(high)
            self.segments.append(self.most_apart(high + high * 100 // self.percent) + 1)
            self.low.append(high + 1)

    def most_apart(self, together: int) -> int:
        """Most shingles in which similar sets of so many shingles together differ."""
        return together * (100 - self.percent) // (100 + self.percent)

    def of(self, size: int) -> int:
        self._grow(size)
        return int(np.searchsorted(self.high, size))

    def probed(self, size: int) -> range:
        """Bands of sets of up to ``size`` shingles that can be similar to one of ``size``."""
        return range(self.of(max(1, -(-size * self.percent // 100))), self.of(size) + 1)

    def designated(self, band: int) -> int:
        m = self.segments[band]
        return m if m <= FEW_SEGMENTS else max(2, m // 16)


def budgets(cost: np.ndarray, second: np.ndarray, need: np.ndarray) -> np.ndarray:
    """0, 1 or 2 for every segment of every row, ``need`` in all, of least cost; ``second`` covers the first segments only.

    A second unit never costs less than the first of its segment.
    """
    m, d = cost.shape[1], second.shape[1]
    units = np.concatenate([cost, np.maximum(second, cost[:, :d])], axis=1)
    taken = np.zeros(units.shape, np.int64)
    np.put_along_axis(taken, np.argsort(units, axis=1, kind="stable"), (np.arange(m + d) < need[:, None]).astype(np.int64), axis=1)
    out = taken[:, :m]
    out[:, :d] += taken[:, m:]
    return out


def _band_keys(band: int, sets: list[np.ndarray], own: np.ndarray, bands: Bands, frequency: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``sets``, key, role) of sets that probe a band, which is some of them's own."""
    m, d, r = bands.segments[band], bands.designated(band), len(sets)
    size = np.array([len(t) for t in sets])
    tokens, doc = np.concatenate(sets), np.repeat(np.arange(r), size)
    cell = doc * m + ((tokens >> np.uint64(24)) % np.uint64(m)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    tokens, cell = tokens[order], cell[order]
    n = np.bincount(cell, minlength=r * m)
    end = np.cumsum(n)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens, dtype=np.uint64)])
    subset = upto[end] - upto[end - n]
    dear = float(n_docs) + 2
    cost, live = np.full(r * m, dear), np.flatnonzero(n)
    cost[live] = 1.0 + np.minimum.reduceat(frequency[(tokens & np.uint64(SKETCH - 1)).astype(np.int64)], (end - n)[live])
    cost, n = cost.reshape(r, m), n.reshape(r, m)
    # A deletion may leave nothing, or leave out the rarest shingle.
    second = np.where(n[:, :d] > 1, (n[:, :d] + 1) * cost[:, :d], 2 * dear)
    need = (size + np.minimum(size, bands.high[band])) * (100 - bands.percent) // (100 + bands.percent) + 1
    budget = budgets(cost, second, need)
    role = np.where(budget > 0, ACTIVE, 0) | np.where(budget > 1, REACHING, 0) | np.where(own, 0, VISITING)[:, None]
    place = (np.arange(m, dtype=np.uint64) << np.uint64(16) | np.uint64(band)) * _ODD
    shown, segment = np.nonzero((budget > 0) | own[:, None])
    budget = budget.ravel()
    less = np.flatnonzero((cell % m < d) & (own[cell // m] | (budget[cell] > 1)))
    at = cell[less]
    keys = np.concatenate([subset[shown * m + segment] ^ place[segment], (subset[at] - tokens[less]) ^ place[at % m]]) * _MIX
    roles = np.concatenate([role[shown, segment], DELETED | np.where(own[at // m], 0, VISITING) | np.where(budget[at] > 1, ACTIVE, 0)])
    return np.concatenate([shown, at // m]), (keys ^ keys >> np.uint64(29)) >> np.uint64(64 - 8 * KEY_BYTES), roles.astype(np.uint8)


def set_keys(sets: list[np.ndarray], bands: Bands, frequency: np.ndarray, n_docs: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(keys, roles) of each set, none of them empty, in its own band and the lower ones that it probes."""
    probing: dict[int, list[int]] = {}
    for i, t in enumerate(sets):
        for band in bands.probed(len(t)):
            probing.setdefault(band, []).append(i)
    of, keys, roles = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
    for band, members in probing.items():
        own = np.array([len(sets[i]) >= bands.low[band] and len(sets[i]) <= bands.high[band] for i in members])
        who, k, r = _band_keys(band, [sets[i] for i in members], own, bands, frequency, n_docs)
        of.append(np.asarray(members)[who])
        keys.append(k)
        roles.append(r)
    who = np.concatenate(of)
    order = np.argsort(who, kind="stable")
    cuts = np.cumsum(np.bincount(who, minlength=len(sets)))[:-1]
    return list(zip(np.split(np.concatenate(keys)[order], cuts), np.split(np.concatenate(roles)[order], cuts), strict=True)) if sets else []


def _may_meet(role_a: np.ndarray, role_b: np.ndarray) -> np.ndarray:
    """Whether a shared key of two roles asks for the pair."""
    plain_a, plain_b = role_a & DELETED == 0, role_b & DELETED == 0
    asks = (role_a & ACTIVE > 0) & plain_b | (role_b & ACTIVE > 0) & plain_a | (role_a & REACHING > 0) & ~plain_b | (role_b & REACHING > 0) & ~plain_a
    return asks & (plain_a | plain_b) & (role_a & role_b & VISITING == 0)


def _sizes_fit(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b).astype(np.int64) >= percent * np.maximum(a, b).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of so few rows that a task holds little beside its input."""
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            yield whole.slice(at, SLICE)


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every text and, at a task's end, its counts of the sketch in chunks."""
    names = ["id", "n", "h1", "h2", "chunk", "counts"]
    counts = np.zeros(SKETCH, np.int64)
    for batch in _slices(batches):
        sets = shingle_sets(vectext.text_bytes(batch.column(1)))
        counts += np.bincount((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        digests = [_digest(t) for t in sets]
        none = pa.nulls(len(sets), pa.int32())
        yield pa.record_batch(
            [batch.column(0), pa.array([len(t) for t in sets], pa.int32()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), none, pa.nulls(len(sets), pa.list_(pa.int64()))],
            names=names,
        )
    k = SKETCH // _CHUNK
    lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * _CHUNK, pa.int32()), pa.array(counts))
    yield pa.record_batch([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(np.arange(k), pa.int32()), lists], names=names)


def _key_batches(held, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, n_docs = held.value
        bands = Bands(percent)
        for batch in _slices(batches):
            sets = shingle_sets(vectext.text_bytes(batch.column(1)))
            live = [i for i, t in enumerate(sets) if len(t)]
            digests = [_digest(sets[i]) for i in live]
            packed = set_keys([sets[i] for i in live], bands, frequency, n_docs)
            sides = [
                batch.column(0).take(pa.array(live, pa.int64())), pa.array([len(sets[i]) for i in live], pa.int32()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                pa.array([k.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes() for k, _ in packed], pa.binary()), pa.array([r.tobytes() for _, r in packed], pa.binary()),
            ]
            yield pa.record_batch(sides, names=["id", "n", "h1", "h2", "ks", "roles"])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        packed = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, KEY_BYTES)
        k = np.pad(packed, ((0, 0), (0, 8 - KEY_BYTES))).view(np.int64).ravel()
        roles = batch.column(3).to_pylist()
        times = [len(x) for x in roles]
        sid, n = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), times) for i in (0, 1))
        yield pa.record_batch([pa.array(k), pa.array(sid), pa.array(n), pa.array(np.frombuffer(b"".join(roles), np.int8))], names=["k", "sid", "n", "role"])


def _pair_batches(percent: int):
    """Sets sorted by key, those that ask for pairs first: (a, b, null..) of candidates, (null, null, k, sid, n, role) of crowded keys."""
    names = ["a", "b", "k", "sid", "n", "role"]

    def pairs(a, b) -> pa.RecordBatch:
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        rest = [pa.nulls(len(both), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int8())]
        return pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1]), *rest], names=names)

    def small(k, sid, n, role) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for step in range(1, SMALL_GROUP):
            same = np.flatnonzero(k[step:] == k[:-step])
            if not len(same):
                break
            x, y = same, same + step
            met = (sid[x] != sid[y]) & _sizes_fit(n[x], n[y], percent) & _may_meet(role[x], role[y])
            a.append(sid[x[met]])
            b.append(sid[y[met]])
        if a and sum(map(len, a)):
            yield pairs(np.concatenate(a), np.concatenate(b))

    def crowd(pivot, k, sid, n, role) -> Iterator[pa.RecordBatch]:
        """Rows of a crowded key whose first row is ``pivot`` (sid, n)."""
        near = (sid != pivot[0]) & _sizes_fit(n, np.full(len(n), pivot[1]), percent)
        if near.any():
            yield pairs(np.full(int(near.sum()), pivot[0]), sid[near])
        m = len(sid)
        yield pa.record_batch([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(k), pa.array(sid), pa.array(n), pa.array(role)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.int64, np.int64, np.int32, np.int8)
        hold = [np.zeros(0, t) for t in kinds]
        open_key, pivot = None, None  # the crowded key whose rows go on, and its pivot
        for batch in _ended(batches):
            if batch is not None:
                new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
                if open_key is not None:
                    upto = int((new[0] == open_key).sum())  # rows are sorted
                    if upto and pivot is not None:
                        yield from crowd(pivot, *(x[:upto] for x in new))
                    new = [x[upto:] for x in new]
                    if len(new[0]):
                        open_key = None
                rows = [np.concatenate(x) for x in zip(hold, new, strict=True)]
            else:
                rows = hold
            if not len(rows[0]):
                hold = rows
                continue
            k = rows[0]
            cuts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.concatenate([cuts, [len(k)]]))
            last = batch is not None  # the last key may go on
            for begin, m in zip(cuts[size > SMALL_GROUP], size[size > SMALL_GROUP], strict=True):
                part = [x[begin : begin + m] for x in rows]
                asks = bool(part[3][0] & ACTIVE)  # askers come first
                pivot = (part[1][0], part[2][0]) if asks else None
                if asks:
                    yield from crowd(pivot, *part)
                if last and begin + m == len(k):
                    open_key = k[-1]
            alike = size <= SMALL_GROUP
            if last and alike[-1]:
                hold = [x[cuts[-1] :] for x in rows]
                alike[-1] = False
            else:
                hold = [x[:0] for x in rows]
            keep = np.repeat(alike & (size > 1), size)
            yield from small(*(x[keep] for x in rows))

    return run


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        sets = shingle_sets(vectext.text_bytes(batch.column(0)))
        digests = [_digest(t) for t in sets]
        yield pa.record_batch([pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array([t.tobytes() for t in sets], pa.binary())], names=["h1", "h2", "tokens"])


def _shared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that end in two packed sets, with the number of shingles in both and of both together."""
    for batch in batches:
        x_at, y_at = batch.num_columns - 2, batch.num_columns - 1
        shared, sizes = [], []
        for x, y in zip(batch.column(x_at).to_pylist(), batch.column(y_at).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            shared.append(int((y[at] == x).sum()))
            sizes.append(len(x) + len(y))
        kept = [batch.column(i) for i in range(x_at)]
        yield pa.record_batch([*kept, pa.array(shared, pa.int32()), pa.array(sizes, pa.int32())], names=[*batch.schema.names[:x_at], "shared", "together"])


def parities(tokens: np.ndarray) -> np.ndarray:
    """A bitmap of at least twice as many bits as shingles: a bit is set if an odd number of them hash to it."""
    bits = 1 << max(6, int(2 * max(len(tokens), 1) - 1).bit_length())
    odd = np.bincount((tokens >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _parity_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = [parities(np.frombuffer(x, np.uint64)).tobytes() for x in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(maps, pa.binary())], names=["sid", "bits"])


def _folded(maps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps of one length: the halves of longer ones are added, as parities add."""
    least = min(len(x) for x in maps)
    out = np.zeros((len(maps), least), np.uint64)
    for i, x in enumerate(maps):
        out[i] = np.bitwise_xor.reduce(x.reshape(-1, least), axis=0)
    return out


def _crossed(percent: int):
    """Pairs of one block, or of two, of a crowded key that are of different components and may be similar."""

    def run(group: pa.Table) -> pa.Table:
        sid, n, role, label, block = (group.column(c).to_numpy() for c in ("sid", "n", "role", "label", "block"))
        bits = _folded([np.frombuffer(x, np.uint64) for x in group.column("bits").to_pylist()])
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out = [np.zeros((4, 0), np.int64)]
        for x in left:
            y = right[right > x] if i == j else right
            y = y[(label[y] != label[x]) & _sizes_fit(n[y], np.full(len(y), n[x]), percent) & _may_meet(role[y], np.full(len(y), role[x]))]
            apart = np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1)
            y = y[apart <= (n[y].astype(np.int64) + n[x]) * (100 - percent) // (100 + percent)]
            out.append(np.stack([np.minimum(sid[x], sid[y]), np.maximum(sid[x], sid[y]), np.minimum(label[x], label[y]), np.maximum(label[x], label[y])]))
        return pa.table(dict(zip(("a", "b", "la", "lb"), np.concatenate(out, axis=1), strict=True)))

    return run


def verified(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pairs (a, b and other long columns) with ``shared``, their common shingles, and ``together``, both sizes added up."""
    first = pairs.join(tokens.select(F.col("sid").alias("a"), F.col("tokens").alias("x")), "a")
    both = first.join(tokens.select(F.col("sid").alias("b"), F.col("tokens").alias("y")), "b").select(*pairs.columns, "x", "y")
    return both.mapInArrow(_shared_batches, ", ".join(f"{c} long" for c in pairs.columns) + ", shared int, together int")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n, component) of every row of ``docs``.

    n is the size of the row's set of word shingles, component the smallest id
    reachable over sets whose common shingles are ``percent`` % of their union
    or more.  Shingles are compared by 64 bits of XXH64, whole sets by 128 bits.

    A null or wordless text has an empty set, is linked with nothing and is
    its own component.  Null ids never name a component unless no other id is
    there (then null).  Repeated rows come back as often as given.  Texts are
    read whole, long ones in stretches.  Other columns are not read; an empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    n_parts = partitions(spark)
    at = f"{shared_dir(spark)}/sets-{uuid.uuid4().hex}"
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    seen = settled(texts.mapInArrow(_set_batches, "id long, n int, h1 long, h2 long, chunk int, counts array<long>"))
    rows = seen.where("chunk is null").select("id", "n", "h1", "h2")
    frequency = np.zeros(SKETCH, np.int64)
    counted = seen.where("chunk is not null").select("chunk", F.posexplode("counts")).groupBy("chunk", "pos").agg(F.sum("col").alias("n"))
    for r in counted.collect():  # SKETCH rows
        frequency[r["chunk"] * _CHUNK + r["pos"]] = r["n"]
    held = spark.sparkContext.broadcast((frequency, rows.count()))

    keyed = texts.mapInArrow(_key_batches(held, percent), "id long, n int, h1 long, h2 long, ks binary, roles binary")
    one = keyed.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("ks").alias("ks"), F.first("roles").alias("roles"))
    one.withColumn("sid", F.monotonically_increasing_id()).write.parquet(f"{at}/sets")
    sets = spark.read.parquet(f"{at}/sets")
    dealt = sets.select("sid", "n", "ks", "roles").mapInArrow(_unpacked, "k long, sid long, n int, role byte").repartition(n_parts, "k")
    dealt = dealt.sortWithinPartitions("k", F.col("role").bitwiseAND(F.lit(ACTIVE)).desc(), "sid")
    met = settled(dealt.mapInArrow(_pair_batches(percent), "a long, b long, k long, sid long, n int, role byte"))

    pairs = settled(met.where("a is not null").select("a", "b").distinct())
    crowds = met.where("k is not null").select("k", "sid", "n", "role")
    asked = settled(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).union(crowds.select("sid")).distinct())
    wanted = settled(sets.select("sid", "h1", "h2", "least").join(asked, "sid"))
    ids = wanted.select(F.xxhash64("least").alias("h"))
    among = bloom_test(ids, wanted.count(), least=1)
    tokens = texts.where(among(F.xxhash64("id"))).select("text").mapInArrow(_token_batches, "h1 long, h2 long, tokens binary")
    tokens = tokens.join(wanted.select("sid", "h1", "h2"), ["h1", "h2"]).groupBy("sid").agg(F.first("tokens").alias("tokens"))
    tokens.write.parquet(f"{at}/tokens")
    tokens = spark.read.parquet(f"{at}/tokens")

    links = verified(pairs, tokens).where(_close(percent)).select("a", "b")
    roots = settled(asked.join(connected_components(links), F.col("sid") == F.col("node"), "left").select("sid", F.coalesce("label", "sid").alias("label")))
    roots = _joined_crowds(crowds.join(roots, "sid"), roots, tokens, percent)
    removed(spark, f"{at}/tokens")

    labelled = sets.select("sid", "h1", "h2", "least").join(roots, "sid", "left").select("h1", "h2", "least", F.coalesce("label", "sid").alias("label"))
    named = labelled.groupBy("label").agg(F.min("least").alias("component"))
    named = settled(labelled.join(named, "label").select("h1", "h2", "component"))
    removed(spark, at)
    alone = rows.where("n = 0").select("id", "n", F.col("id").alias("component"))
    return rows.where("n > 0").join(named, ["h1", "h2"]).select("id", "n", "component").unionByName(alone)


def _close(percent: int) -> Column:
    return F.col("shared") * 100 >= (F.col("together") - F.col("shared")) * percent


def _crowded(members: DataFrame, turn: int) -> DataFrame:
    """Keys of several components: (k, m, crossings, top, anchors), with the largest component and members drawn from it."""
    drawn = [F.min_by(F.struct("sid", "n"), F.xxhash64("sid", F.lit(turn * ANCHORS + i))).alias(f"anchor{i}") for i in range(ANCHORS)]
    parts = members.groupBy("k", "label").agg(F.count(F.lit(1)).alias("c"), *drawn)
    largest = F.max_by(F.struct("label", F.array(*[f"anchor{i}" for i in range(ANCHORS)]).alias("anchors")), F.struct("c", "label"))
    keys = parts.groupBy("k").agg(F.count(F.lit(1)).alias("labels"), F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("inside"), largest.alias("top"))
    crossings = ((F.col("m") * F.col("m") - F.col("inside")) / 2).cast("long")
    return keys.where("labels > 1").select("k", "m", crossings.alias("crossings"), F.col("top.label").alias("top"), F.col("top.anchors").alias("anchors"))


def _joined_crowds(members: DataFrame, roots: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """``roots`` (sid, label) with the links that crowded keys still hide.

    Every turn verifies a few pairs for each set outside its key's largest
    component.  When hardly more pairs than sets are left, or a turn joined too
    few of them, all pairs that are left are verified.
    """
    turn, before = 0, None
    while True:
        keys = settled(_crowded(members, turn))
        left = keys.agg(F.sum("m").alias("m"), F.sum("crossings").alias("crossings")).first()
        if left["m"] is None:
            return roots
        members = settled(members.join(keys, "k"))
        last = left["crossings"] <= 2 * left["m"] or (before is not None and left["crossings"] > before // 2)
        if last:
            blocks = F.ceil(F.col("m") / BLOCK).cast("int")
            dealt = members.withColumn("block", F.pmod(F.xxhash64("sid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            dealt = dealt.join(tokens.mapInArrow(_parity_batches, "sid long, bits binary"), "sid")
            dealt = dealt.select("k", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sid", "n", "role", "label", "bits")
            pairs = dealt.groupBy("k", "i", "j").applyInArrow(_crossed(percent), "a long, b long, la long, lb long")
        else:
            outside = members.where("label <> top").select("sid", "n", "label", "top", F.explode("anchors").alias("anchor"))
            fits = 100 * F.least("n", "anchor.n") >= percent * F.greatest("n", "anchor.n")
            pairs = outside.where(fits).select(F.least("sid", "anchor.sid").alias("a"), F.greatest("sid", "anchor.sid").alias("b"), F.least("label", "top").alias("la"), F.greatest("label", "top").alias("lb"))
        joined = connected_components(verified(pairs.distinct(), tokens).where(_close(percent)).select(F.col("la").alias("a"), F.col("lb").alias("b")))
        joined = joined.select(F.col("node").alias("label"), F.col("label").alias("to"))
        roots = settled(roots.join(joined, "label", "left").select("sid", F.coalesce("to", "label").alias("label")))
        if last:
            return roots
        members = members.drop("m", "crossings", "top", "anchors", "label").join(roots, "sid")
        turn, before = turn + 1, left["crossings"]
