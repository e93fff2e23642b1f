"""Lines within a few edits of each other, joined by segments.

A line is split into one segment more than edits are allowed, so a near line
holds one of them unchanged.  Each line is indexed under its length and every
segment; it probes the indexes of its own and of shorter lengths with its
substrings at the places where such a segment can stand.  Lines that meet are
candidates, verified with a banded bit-parallel edit distance.

A segment that very many lines share would make too many candidates.  Lines
that meet in it agree there, so what is left of them is within as many edits:
the rest is split and indexed again under that segment, and so on.  Every step
takes a part of the line away, so it ends, and no pair is lost by it.  Groups
that a task can hold are split there; larger ones are dealt out again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm._shared import partitions, settled, shared_dir
from tidewake.llm.components import connected_components
from tidewake.llm.exact_dedup import bloom_test

#: Edits that link two lines.
MOST_EDITS = 1
#: A group of more rows is split by what is left of its lines.
GROUP_ROWS = 32
#: A group of more rows or characters isn't held in one task.
HELD_ROWS, HELD_CHARS = 4096, 1 << 24
#: Characters that are hashed or compared at once, unless one line has more.
STRETCH = 1 << 21

# ---------------------------------------------------------------- hashes of substrings

_B = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_B, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n at least."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        both = []
        for b in (_B, _INVERSE):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS.clear()
        _POWERS[size] = tuple(both)
    return _POWERS[size]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Substrings:
    """Hashes of any substrings of a list of lines, from sums of the characters before each place."""

    def __init__(self, lines: list[str]):
        self.length = np.fromiter(map(len, lines), np.int64, len(lines))
        self.start = np.cumsum(self.length) - self.length
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        powers, self.inverse = _powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_mixed(codes.astype(np.uint64) + np.uint64(1)) * powers[: len(codes)], dtype=np.uint64, out=self.sums[1:])

    def hash(self, row: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        first = self.start[row] + at
        return (self.sums[first + length] - self.sums[first]) * self.inverse[first]


def _stretches(lengths: list[int], most: int = STRETCH) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` characters."""
    first, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield first, i
            first, size = i, 0
        size += n
    if lengths:
        yield first, len(lengths)


def keys(lines: list[str], salts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, role, at, length) of every segment and probe.

    Role 0 is a line's own segment, role 1 a substring that asks for a segment
    of its own or a shorter length.  ``at`` and ``length`` are the part of the
    line that the key agrees in.  Lines that can't be split all share one key
    (length 0), which lines that may be near them ask for.
    """
    found: list[tuple[np.ndarray, ...]] = []
    parts = most + 1
    with np.errstate(over="ignore"):
        for a, b in _stretches([len(x) for x in lines]):
            held = _Substrings(lines[a:b])
            n, salt = held.length, salts[a:b].astype(np.uint64)

            def give(rows: np.ndarray, n_index: np.ndarray, i: int, at: np.ndarray, length: np.ndarray, role: int) -> None:
                h = _mixed(held.hash(rows, at, length) ^ _mixed(salt[rows] + np.uint64(2 * i + 1)) ^ _mixed(n_index.astype(np.uint64) * np.uint64(_B)))
                found.append((rows + a, h.view(np.int64), np.full(len(rows), role, np.int8), at, length))

            nothing = np.zeros(len(n), np.int64)
            for role, rows in ((0, np.flatnonzero(n < parts)), (1, np.flatnonzero((n >= parts) & (n <= 2 * most)))):
                give(rows, nothing[: len(rows)], parts, nothing[: len(rows)], nothing[: len(rows)], role)
            for shorter in range(most + 1):
                rows = np.flatnonzero(n - shorter >= parts)
                size = n[rows] - shorter
                for i in range(parts):
                    p = i * size // parts
                    length = (i + 1) * size // parts - p
                    # At most i edits stand before the segment, at most most - i after it.
                    for shift in range(max(-i, shorter - (most - i)), min(i, shorter + most - i) + 1):
                        at = p + shift
                        ok = (at >= 0) & (at + length <= n[rows])
                        give(rows[ok], size[ok], i, at[ok], length[ok], int(shorter > 0 or shift != 0))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# ---------------------------------------------------------------- verification


def edits_within(a: list[str], b: list[str], most: int = MOST_EDITS) -> np.ndarray:
    """Whether each pair is within ``most`` edits.

    A column of the distance matrix is held as vertical differences in a word of
    2 * most + 1 bits that moves down the diagonal; all pairs advance together.
    Cells outside the band count as one more than their neighbour in it, so
    distances up to ``most`` come out exact.
    """
    out = np.zeros(len(a), bool)
    near = [p for p, (x, y) in enumerate(zip(a, b, strict=True)) if abs(len(x) - len(y)) <= most]
    order = sorted(near, key=lambda p: len(b[p]))
    lengths = [len(b[p]) for p in order]
    at = 0
    while at < len(order):
        until = at + 1
        while until < len(order) and (until + 1 - at) * lengths[until] <= STRETCH:
            until += 1
        _within(a, b, order[at:until], most, out)
        at = until
    return out


def _within(a: list[str], b: list[str], some: list[int], most: int, out: np.ndarray) -> None:
    """Sets ``out`` for the pairs ``some``, which come by the length of b."""
    m = np.array([len(a[p]) for p in some])
    n = np.array([len(b[p]) for p in some])
    width = int(max(n.max(), m.max()))
    rows = np.full((len(some), width + 2 * most + 1), 0xFFFFFFFF, np.uint32)  # row i stands at i + most - 1
    cols = np.full((len(some), width), 0xFFFFFFFE, np.uint32)
    for q, p in enumerate(some):
        rows[q, most : most + m[q]] = np.frombuffer(a[p].encode("utf-32-le", "surrogatepass"), np.uint32)
        cols[q, : n[q]] = np.frombuffer(b[p].encode("utf-32-le", "surrogatepass"), np.uint32)
    rows, cols = np.ascontiguousarray(rows.T), np.ascontiguousarray(cols.T)
    bits = 2 * most + 1
    full, low = (1 << bits) - 1, 2 * most
    vn = np.full(len(some), sum(1 << k for k in range(1, most + 1)), np.int64)
    vp = np.full(len(some), sum(1 << k for k in range(most + 1, bits)), np.int64)
    score = np.full(len(some), most, np.int64)
    result = np.full(len(some), most + 1, np.int64)

    def settle(done: np.ndarray) -> None:
        d = score[done].copy()
        for k in range(low, 0, -1):  # from the band's last row up to the last character's
            up = k > (m[done] - n[done] + most)
            d -= np.where(up, (vp[done] >> k & 1) - (vn[done] >> k & 1), 0)
        result[done] = d

    settle(np.flatnonzero(n == 0))
    for j in range(1, int(n.max()) + 1):
        first = int(np.searchsorted(n, j))  # pairs come by length: those before are done
        vp[first:] = vp[first:] >> 1 | 1 << low
        vn[first:] >>= 1
        p, q, c = vp[first:], vn[first:], cols[j - 1, first:]
        eq = np.zeros(len(p), np.int64)
        for k in range(bits):
            eq |= (rows[j - 1 + k, first:] == c).astype(np.int64) << k
        d0 = (((eq & p) + p) ^ p | eq | q) & full
        hp = (q | ~(d0 | p)) & full
        hn = p & d0
        score[first:] += 1 - (d0 >> low & 1)
        hp = (hp << 1 | 1) & full
        vp[first:] = ((hn << 1) | ~(d0 | hp)) & full
        vn[first:] = hp & d0
        ending = np.flatnonzero(n[first:] == j) + first
        if len(ending):
            settle(ending)
    out[some] = result <= most


# ---------------------------------------------------------------- the join

KEYED = "k long, no long, cut long"
MET = "a long, b long, k long, removed array<long>"


def _cut(at: np.ndarray, length: np.ndarray, role: np.ndarray) -> np.ndarray:
    """A key's place and role as one number; lines are shorter than 2**31."""
    return at << 32 | length << 1 | role


def _rest(line: str, removed: list[int]) -> str:
    """The line without the parts that its keys agreed in, one after the other."""
    for cut in removed:
        at, length = cut >> 32, (cut & 0xFFFFFFFF) >> 1
        line = line[:at] + line[at + length :]
    return line


def _keyed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines, no = batch.column(1).to_pylist(), batch.column(0).to_numpy(zero_copy_only=False)
        for a, b in _stretches([len(x) for x in lines]):
            row, k, role, at, length = keys(lines[a:b], np.zeros(b - a, np.uint64), most)
            yield pa.record_batch([pa.array(k), pa.array(no[a:b][row]), pa.array(_cut(at, length, role))], names=["k", "no", "cut"])


def _pairs(k: np.ndarray, i: np.ndarray, role: np.ndarray, most_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of different lines that share a key and aren't both asking; ``k`` is sorted."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, most_rows):
        same = np.flatnonzero((k[step:] == k[:-step]) & (role[step:] + role[:-step] < 2) & (i[step:] != i[:-step]))
        if not len(same) and not (k[step:] == k[:-step]).any():
            break
        a.append(np.minimum(i[same], i[same + step]))
        b.append(np.maximum(i[same], i[same + step]))
    both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
    return both[:, 0], both[:, 1]


def _sizes(k: np.ndarray) -> np.ndarray:
    """For each row of sorted keys the size of its group."""
    cuts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
    size = np.diff(cuts)
    return np.repeat(size, size)


def _met(batches: Iterator[pa.RecordBatch], group_rows: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of groups up to ``group_rows``; (no, null, key, cut) for the rows of larger ones.  Rows come sorted by key."""
    hold = [np.zeros(0, np.int64)] * 3
    open_key = None  # of a large group whose first rows have gone out

    def out(k: np.ndarray, no: np.ndarray, cut: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(k):
            return
        size = _sizes(k)
        large = size > group_rows
        if open_key is not None:
            large |= k == open_key
        if large.any():
            n = int(large.sum())
            cuts = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(cut[large]))
            yield pa.record_batch([pa.array(no[large]), pa.nulls(n, pa.int64()), pa.array(k[large]), cuts], names=["a", "b", "k", "removed"])
        small = ~large & (size > 1)
        a, b = _pairs(k[small], no[small], cut[small] & 1, group_rows)
        if len(a):
            yield pa.record_batch([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.list_(pa.int64()))], names=["a", "b", "k", "removed"])

    for batch in batches:
        hold = [np.concatenate([old, c.to_numpy(zero_copy_only=False)]) for old, c in zip(hold, batch.columns, strict=True)]
        k = hold[0]
        if not len(k):
            continue
        last = int(np.flatnonzero(k == k[-1])[0])
        yield from out(*(x[:last] for x in hold))
        hold = [x[last:] for x in hold]
        if open_key != k[-1]:
            open_key = None
        if len(hold[0]) > group_rows:
            open_key = k[-1]
            yield from out(*hold)
            hold = [x[:0] for x in hold]
    yield from out(*hold)


def _split(lines: list[str], no: np.ndarray, removed: list[list[int]], most: int, group_rows: int) -> np.ndarray:
    """Candidate pairs (as rows) of a group that meets in one key, by splitting what is left of its lines again and again."""
    found = [np.zeros((0, 2), np.int64)]
    todo = [(np.arange(len(lines)), [_rest(x, r) for x, r in zip(lines, removed, strict=True)])]
    while todo:
        member, rests = todo.pop()
        row, k, role, at, length = keys(rests, np.zeros(len(rests), np.uint64), most)
        order = np.argsort(k, kind="stable")
        row, k, role, at, length = (x[order] for x in (row, k, role, at, length))
        i = no[member[row]]
        size = _sizes(k) if len(k) else k
        # Where nothing is left to split, lines differ in a few characters at one place: what meets is near.
        whole = length == 0
        small = (size > 1) & ((size <= group_rows) | whole)
        if small.any():
            found.append(np.stack(_pairs(k[small], i[small], role[small], int(size[small].max())), 1))
        large = ~small & (size > 1)
        for key in np.unique(k[large]):
            mine = np.flatnonzero(k == key)
            todo.append((member[row[mine]], [rests[r][:p] + rests[r][p + n :] for r, p, n in zip(row[mine].tolist(), at[mine].tolist(), length[mine].tolist(), strict=True)]))
    return np.unique(np.concatenate(found), axis=0)


def _resolved(batches: Iterator[pa.RecordBatch], most: int, group_rows: int, held_rows: int) -> Iterator[pa.RecordBatch]:
    """Links of groups that a task can hold; the rows of larger ones with new keys.  Rows (k, no, removed, line) come sorted by k.

    A group that nothing is left of to split holds at most the lines that
    differ in a few characters at one place, and is always held.
    """
    rows: list[tuple[int, list[int], str]] = []
    chars, key, open_key = 0, None, None

    def smaller() -> pa.RecordBatch:
        lines, removed = [r[2] for r in rows], [r[1] for r in rows]
        row, k, role, at, length = keys([_rest(x, c) for x, c in zip(lines, removed, strict=True)], np.full(len(rows), key, np.int64).view(np.uint64), most)
        cuts = _cut(at, length, role).tolist()
        which = row.tolist()
        return pa.record_batch(
            [pa.array([rows[r][0] for r in which], pa.int64()), pa.nulls(len(which), pa.int64()), pa.array(k), pa.array([[*removed[r], c] for r, c in zip(which, cuts, strict=True)], pa.list_(pa.int64()))],
            names=["a", "b", "k", "removed"],
        )

    def close() -> Iterator[pa.RecordBatch]:
        if open_key is not None and key == open_key:
            if rows:
                yield smaller()
        elif len({r[0] for r in rows}) > 1:
            text = {r[0]: r[2] for r in rows}
            pairs = _split([r[2] for r in rows], np.array([r[0] for r in rows], np.int64), [r[1] for r in rows], most, group_rows)
            a, b = pairs[:, 0].tolist(), pairs[:, 1].tolist()
            pairs = pairs[edits_within([text[x] for x in a], [text[x] for x in b], most)]
            n = len(pairs)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], names=["a", "b", "k", "removed"])
        rows.clear()

    for batch in batches:
        for k, no, removed, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                yield from close()
                key, chars = k, 0
            rows.append((no, removed, line))
            chars += len(line)
            splits = removed[-1] & 0xFFFFFFFF > 1
            if splits and (len(rows) > held_rows or chars > HELD_CHARS and len(rows) > group_rows):
                open_key = key
                yield from close()
                chars = 0
    yield from close()


def _verified(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = pa.array(edits_within(batch.column(2).to_pylist(), batch.column(3).to_pylist(), most))
        yield pa.record_batch([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])


def line_links(lines: DataFrame, most_edits: int = MOST_EDITS, group_rows: int = GROUP_ROWS, held_rows: int = HELD_ROWS) -> DataFrame:
    """(a, b), a < b, for all rows of ``lines``, (no, line) with distinct lines, within ``most_edits`` edits."""
    n = max(1, partitions(lines.sparkSession))
    keyed = lines.select("no", "line").mapInArrow(partial(_keyed, most=most_edits), KEYED)
    found = settled(keyed.repartition(n, "k").sortWithinPartitions("k").mapInArrow(partial(_met, group_rows=group_rows), MET))
    pairs = settled(found.where("b is not null").select("a", "b").distinct())
    crowded = found.where("b is null").select(F.col("a").alias("no"), "k", "removed")
    asked = settled(pairs.select(F.col("a").alias("no")).union(pairs.select("b")).union(crowded.select("no")).distinct())
    test = bloom_test(asked, asked.count(), least=1)  # keeps most other texts from being shuffled
    texts = settled(lines.select("no", "line").where(test("no")).join(asked, "no", "left_semi"))
    both = pairs.join(texts.select(F.col("no").alias("a"), F.col("line").alias("la")), "a").join(texts.select(F.col("no").alias("b"), F.col("line").alias("lb")), "b")
    links = both.select("a", "b", "la", "lb").mapInArrow(partial(_verified, most=most_edits), "a long, b long")
    while crowded.limit(1).count():
        dealt = crowded.join(texts, "no").select("k", "no", "removed", "line").repartition(n, "k").sortWithinPartitions("k")
        found = settled(dealt.mapInArrow(partial(_resolved, most=most_edits, group_rows=group_rows, held_rows=held_rows), MET))
        links = links.union(found.where("b is not null").select("a", "b"))
        crowded = found.where("b is null").select(F.col("a").alias("no"), "k", "removed")
    return settled(links.distinct())


def line_name(line: Column) -> Column:
    """128 bits of the line's SHA-256."""
    return F.unhex(F.substring(F.sha2(line, 256), 1, 32))


def distinct_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(no, name, line, n_rows, first) of the distinct non-blank lines, written down once; ``no`` numbers them."""
    lines = docs.select(F.col(id_col).cast("long").alias("doc"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))
    blank = F.trim("line", F.lit(" \t\x0b\x0c\r")) == ""
    found = lines.where(~blank).groupBy(line_name(F.col("line")).alias("name")).agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.struct("doc", "line_no")).alias("first"), F.first("line").alias("line"))
    at = f"{shared_dir(docs.sparkSession)}/lines-{uuid.uuid4().hex}"
    found.withColumn("no", F.monotonically_increasing_id()).write.parquet(at)
    return docs.sparkSession.read.parquet(at)


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_edits: int = MOST_EDITS) -> DataFrame:
    """One row for each distinct non-blank line of all documents.

    line_id names it (128 bits of SHA-256 in hex digits), first_doc and
    first_line are where it first stands, n_chars its length, n_rows how often
    it is there, n_links how many other lines are within ``most_edits`` edits,
    and class_id the least line_id that links lead to.  Lines of any length
    take part.  Null texts have no lines, null ids come first, repeated rows
    count as often as given, an empty table gives an empty one, other columns
    are not read.
    """
    lines = distinct_lines(docs, id_col, text_col)
    links = line_links(lines, most_edits)
    ends = links.select(F.col("a").alias("no"), F.col("b").alias("other")).union(links.select("b", "a"))
    degree = ends.groupBy("no").agg(F.count(F.lit(1)).alias("n_links"))
    roots = connected_components(links).withColumnRenamed("node", "no")
    linked = settled(roots.join(degree, "no").join(lines.select("no", "name"), "no"))
    least = linked.groupBy("label").agg(F.min("name").alias("class"))
    out = lines.select("no", "name", "n_rows", "first", F.length("line").cast("long").alias("n_chars"))
    out = out.join(linked.join(least, "label").select("no", "n_links", "class"), "no", "left")
    return out.select(
        F.lower(F.hex("name")).alias("line_id"), F.col("first.doc").alias("first_doc"), F.col("first.line_no").cast("long").alias("first_line"), "n_chars",
        "n_rows", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.lower(F.hex(F.coalesce("class", "name"))).alias("class_id"),
    )
