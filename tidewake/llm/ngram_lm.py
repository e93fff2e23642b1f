"""Interpolated modified Kneser-Ney scores of documents.

Counting runs in three Spark jobs and leaves sorted arrays in the folder that
executors share; scoring maps those files into every worker's memory.

* words: sorted XXH64 hashes with counts, one file for each range of hashes.  A
  word's number is its place in that order; two more numbers stand for a
  text's begin and end.
* pairs: sorted keys ``context << 32 | word`` with counts, one file for each
  range of contexts, and for each context how many of its pairs were seen once,
  twice, or more often.
* continuations: for each word, in how many contexts it was seen.

Workers hold a bounded stretch of text and one file's arrays; only sums and file
sizes reach the driver.  Files are put in place by renaming, so a task that
runs again leaves the same file.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm import vectext
from tidewake.llm._shared import partitions, settled, shared_dir

#: Entries that a counting task combines before it hands them on.
FLUSH = 1 << 21
#: Files for each of words, pairs and continuations, at most.
MOST_FILES = 4096
FOLDS, HELD_FOLD = 7, 2
BLOCKS = "part long, keys binary, counts binary"


def local_path(folder: str) -> str:
    """The path of a folder on a mounted file system; others can't be mapped into memory."""
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"the model's files are memory-mapped: spark.checkpoint.dir must be a mounted path, not {folder}")
    return url.path


def _packed(values: np.ndarray, sorted_: bool = False) -> bytes:
    """Integers byte by byte, sorted ones as differences, compressed."""
    values = values.astype(np.uint64)
    if sorted_ and len(values):
        values = np.concatenate([values[:1], values[1:] - values[:-1]])
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, sorted_: bool = False) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd"), np.uint8)
    values = np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(values, dtype=np.uint64) if sorted_ else values


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts added up."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class _Tally:
    """Sums counts by key and gives blocks by part whenever it holds FLUSH keys."""

    def __init__(self, part_of: Callable[[np.ndarray], np.ndarray]):
        self.part_of, self.keys, self.counts, self.held = part_of, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            keys, counts = _summed(np.concatenate(self.keys), np.concatenate(self.counts))
            part = self.part_of(keys)
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist()
            rows = [(int(part[a]), _packed(keys[a:b], True), _packed(counts[a:b])) for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True)]
            yield pa.record_batch([pa.array([r[k] for r in rows]) for k in range(3)], names=["part", "keys", "counts"])
        self.keys, self.counts, self.held = [], [], 0


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, keys, summed counts) from blocks that come sorted by part."""
    part, keys, counts = None, [], []
    for batch in batches:
        for p, k, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if p != part and part is not None:
                yield part, *_summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts = [], []
            part = p
            keys.append(_unpacked(k, True))
            counts.append(_unpacked(c))
    if part is not None:
        yield part, *_summed(np.concatenate(keys), np.concatenate(counts))


def _put(path: str, array: np.ndarray) -> None:
    draft = f"{path}.{uuid.uuid4().hex}"
    array.tofile(draft)
    os.replace(draft, path)


def _word_hashes(texts: list[memoryview]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, bool]]:
    """(rows, row of each word, hash of each word, whether the row goes on) by stretch."""
    for rows, joined, more in vectext.stretches(texts):
        words = vectext.words_of(rows, joined, texts)
        h = vectext.xxh64(words.data, words.start, words.end - words.start) if len(words) else np.zeros(0, np.uint64)
        yield rows, words.row, h, more


@dataclass
class Model:
    """Where the arrays are, and the sums that scores need."""

    folder: str
    parts: int
    word_base: np.ndarray  # number of the first word of each file, then the number of words
    tokens: int
    texts: int
    distinct_pairs: int
    discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_rest: float  # mass that the words' discounts leave

    @property
    def begin(self) -> int:
        return int(self.word_base[-1])

    @property
    def end(self) -> int:
        return int(self.word_base[-1]) + 1

    def first_context(self, part: int) -> int:
        """The least context of a file of pairs; files split the numbers evenly."""
        return -(-part * (self.end + 1) // self.parts)

    def part_of_number(self, number: np.ndarray) -> np.ndarray:
        return (number.astype(np.uint64) * np.uint64(self.parts) // np.uint64(self.end + 1)).astype(np.int64)


_MAPPED: dict[tuple[str, str, int], np.ndarray] = {}


def _mapped(folder: str, name: str, part: int, dtype: type) -> np.ndarray:
    """A file's array in mapped memory; a part without entries has no file."""
    key = (folder, name, part)
    if key not in _MAPPED:
        for old in [k for k in _MAPPED if k[0] != folder]:
            del _MAPPED[old]
        path = f"{folder}/{name}-{part}"
        _MAPPED[key] = np.memmap(path, dtype, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, dtype)
    return _MAPPED[key]


def _find(folder: str, name: str, part: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Places of sorted queries in their parts' key files; -1 if absent."""
    out = np.full(len(queries), -1, np.int64)
    if not len(queries):
        return out
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(queries)], strict=True):
        keys = _mapped(folder, name, int(part[a]), np.uint64)
        if len(keys):
            at = np.searchsorted(keys, queries[a:b])
            at[at == len(keys)] = 0
            out[a:b] = np.where(keys[at] == queries[a:b], at, -1)
    return out


def _numbers(model: Model, hashes: np.ndarray) -> np.ndarray:
    """Numbers of words; -1 if a word isn't in the training texts."""
    unique, back = np.unique(hashes, return_inverse=True)
    part = (unique >> np.uint64(64 - model.parts.bit_length() + 1)).astype(np.int64) if model.parts > 1 else np.zeros(len(unique), np.int64)
    at = _find(model.folder, "word", part, unique)
    return np.where(at >= 0, at + model.word_base[part], -1)[back]


def _values(model: Model, name: str, numbers: np.ndarray, dtype: type) -> np.ndarray:
    """What a file family holds for sorted numbers, by their parts."""
    out = np.zeros(len(numbers), np.float64)
    if not len(numbers):
        return out
    part = model.part_of_number(numbers)
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(numbers)], strict=True):
        held = _mapped(model.folder, name, int(part[a]), dtype)
        if len(held):
            out[a:b] = held[numbers[a:b] - model.first_context(int(part[a]))]
    return out


def _count_words(parts: int):
    shift = np.uint64(64 - parts.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(lambda k: (k >> shift).astype(np.int64) if parts > 1 else np.zeros(len(k), np.int64))
        for batch in batches:
            for _, _, h, _ in _word_hashes(vectext.text_bytes(batch.column(0))):
                unique, n = np.unique(h, return_counts=True)
                yield from tally.add(unique, n.astype(np.uint64))
        yield from tally.flush()

    return run


def _store_words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keys, counts in _by_part(batches):
            _put(f"{folder}/word-{part}", keys)
            _put(f"{folder}/count-{part}", counts)
            yield pa.record_batch([pa.array([part]), pa.array([len(keys)]), pa.array([int(counts.sum())])], names=["part", "n", "tokens"])

    return run


def _sequences(model: Model, texts: list[memoryview]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, row, context, token) by stretch: every word and end of a text after what comes before it."""
    pending: dict[int, int] = {}  # last word of a row that goes on
    for rows, row, hashes, more in _word_hashes(texts):
        numbers = _numbers(model, hashes)
        n = len(rows)
        long = n == 1 and len(texts[rows[0]]) > vectext.STRETCH
        count = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)
        starts = np.cumsum(count + 1) - (count + 1)
        token = np.full(len(numbers) + n, model.end, np.int64)
        place = np.arange(len(numbers)) + row if len(row) else np.zeros(0, np.int64)
        token[place] = numbers
        context = np.concatenate([[0], token[:-1]])
        context[starts] = model.begin
        owner = np.repeat(np.arange(n), count + 1)
        if long:  # its end comes once, after the last stretch
            if more:
                context[0] = pending.get(rows[0], model.begin)
            pending = {rows[0]: int(numbers[-1]) if len(numbers) else int(context[0])}
            token, context, owner = token[:-1], context[:-1], owner[:-1]
        yield rows, owner, context, token
        if long:
            continue
    # Ends of long texts are asked for by their callers, which know the last word.


def _all_sequences(model: Model, texts: list[memoryview]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """As ``_sequences``, with the ends of texts that take several stretches."""
    open_row, last = -1, 0
    for rows, owner, context, token in _sequences(model, texts):
        if open_row >= 0 and rows[0] != open_row:
            yield [open_row], np.zeros(1, np.int64), np.array([last]), np.array([model.end])
            open_row = -1
        yield rows, owner, context, token
        if len(rows) == 1 and len(texts[rows[0]]) > vectext.STRETCH:
            last = int(token[-1]) if len(token) else (last if open_row == rows[0] else model.begin)
            open_row = rows[0]
    if open_row >= 0:
        yield [open_row], np.zeros(1, np.int64), np.array([last]), np.array([model.end])


def _count_pairs(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(lambda k: model.part_of_number(k >> np.uint64(32)))
        for batch in batches:
            for _, _, context, token in _all_sequences(model, vectext.text_bytes(batch.column(0))):
                if len(token):
                    key = context.astype(np.uint64) << np.uint64(32) | token.astype(np.uint64)
                    unique, n = np.unique(key, return_counts=True)
                    yield from tally.add(unique, n.astype(np.uint64))
        yield from tally.flush()

    return run


def _store_pairs(model: Model):
    """Files of pairs, and blocks of (word, contexts) on the way to the continuations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(model.part_of_number)
        for part, keys, counts in _by_part(batches):
            _put(f"{model.folder}/pair-{part}", keys)
            _put(f"{model.folder}/times-{part}", np.minimum(counts, 0xFFFFFFFF).astype(np.uint32))
            base = model.first_context(part)
            size = model.first_context(part + 1) - base
            context = (keys >> np.uint64(32)).astype(np.int64) - base
            for k in (1, 2, 3):
                which = counts == k if k < 3 else counts >= 3
                _put(f"{model.folder}/seen{k}-{part}", np.bincount(context[which], minlength=size).astype(np.uint32))
            _put(f"{model.folder}/total-{part}", np.bincount(context, weights=counts.astype(np.float64), minlength=size))
            levels = [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [len(keys)]
            yield pa.record_batch([pa.array([-1]), pa.array([b""]), pa.array([np.array(levels, np.int64).tobytes()])], names=["part", "keys", "counts"])
            word, n = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
            yield from tally.add(word, n.astype(np.uint64))
        yield from tally.flush()

    return run


def _store_continuations(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, word, n in _by_part(batches):
            base = model.first_context(part)
            dense = np.zeros(model.first_context(part + 1) - base, np.uint32)
            dense[word.astype(np.int64) - base] = n
            _put(f"{model.folder}/after-{part}", dense)
            levels = [int((n == k).sum()) for k in (1, 2, 3, 4)] + [int((n >= 3).sum())]
            yield pa.record_batch([pa.array([levels], pa.list_(pa.int64()))], names=["levels"])

    return run


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of what was seen once, twice and more often."""
    if not n1:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    out = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(d, 0.1), k + 1.0) for k, d in enumerate(out))  # some mass is always left


def _discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    cut = np.where(counts >= 3, d[2], np.where(counts >= 2, d[1], d[0]))
    return np.maximum(counts - cut, 0.0)


def train(texts: DataFrame) -> Model:
    """The model of all rows of ``texts``, which has one string column; null counts as empty."""
    spark = texts.sparkSession
    folder = f"{shared_dir(spark)}/ngram-{uuid.uuid4().hex}"
    path = local_path(folder)
    os.makedirs(path)
    parts = 16
    while parts < min(MOST_FILES, 8 * texts.rdd.getNumPartitions()):
        parts *= 2
    n = min(parts, max(1, partitions(spark)))

    def grouped(blocks: DataFrame) -> DataFrame:
        return blocks.repartition(n, "part").sortWithinPartitions("part")

    words = grouped(texts.mapInArrow(_count_words(parts), BLOCKS)).mapInArrow(_store_words(path), "part long, n long, tokens long")
    sizes, tokens = np.zeros(parts, np.int64), 0
    for row in settled(words).collect():  # a row a file
        sizes[row["part"]], tokens = row["n"], tokens + row["tokens"]
    count = texts.count()
    model = Model(path, parts, np.concatenate([[0], np.cumsum(sizes)]), tokens + count, count, 0, (0.0,) * 3, (0.0,) * 3, 1.0)
    if model.end >= 1 << 32:
        raise ValueError("over four billion different words")
    stored = settled(grouped(texts.mapInArrow(_count_pairs(model), BLOCKS)).mapInArrow(_store_pairs(model), BLOCKS))
    levels = np.zeros(5, np.int64)
    for row in stored.where("part < 0").select("counts").collect():  # a row a file
        levels += np.frombuffer(row["counts"], np.int64)
    model.distinct_pairs = int(levels[4])
    model.discounts = discounts(*levels[:4].tolist())
    after = grouped(stored.where("part >= 0")).mapInArrow(_store_continuations(model), "levels array<long>")
    word_levels = np.zeros(5, np.int64)
    for row in settled(after).collect():  # a row a file
        word_levels += np.array(row["levels"])
    model.word_discounts = discounts(*word_levels[:4].tolist())
    if model.distinct_pairs:
        d = model.word_discounts
        model.word_rest = (d[0] * word_levels[0] + d[1] * word_levels[1] + d[2] * word_levels[4]) / model.distinct_pairs
    return model


def _scored(model: Model, texts: list[memoryview]) -> tuple[np.ndarray, ...]:
    """Tokens, known tokens, unigram score and model score of each text."""
    n = len(texts)
    tokens, known = np.zeros(n, np.int64), np.zeros(n, np.int64)
    base, score = np.zeros(n), np.zeros(n)
    vocabulary = model.end - (0 if model.texts else 1)  # words and, if there was a text, the end
    for rows, owner, context, token in _all_sequences(model, texts):
        if not len(token):
            continue
        to = np.asarray(rows)
        # A word's own figures.
        unique, back = np.unique(token, return_inverse=True)
        live = unique >= 0
        inner = unique[live & (unique < model.begin)]
        counts = np.zeros(len(unique))
        if len(inner):
            part = np.searchsorted(model.word_base, inner, side="right") - 1
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist()
            got = np.zeros(len(inner))
            for a, b in zip(cuts, [*cuts[1:], len(inner)], strict=True):
                got[a:b] = _mapped(model.folder, "count", int(part[a]), np.uint64)[inner[a:b] - model.word_base[part[a]]]
            counts[live & (unique < model.begin)] = got
        counts[unique == model.end] = model.texts
        contexts = np.zeros(len(unique))
        contexts[live] = _values(model, "after", unique[live], np.uint32)
        lower = model.word_rest / (vocabulary + 1)
        if model.distinct_pairs:
            lower = lower + np.where(contexts > 0, _discounted(contexts, model.word_discounts), 0.0) / model.distinct_pairs
        lower = np.broadcast_to(lower, len(unique))[back]
        count = counts[back]
        # What the context adds.
        before, again = np.unique(context, return_inverse=True)
        lived = before >= 0
        total, rest = np.zeros(len(before)), np.zeros(len(before))
        if model.distinct_pairs:
            total[lived] = _values(model, "total", before[lived], np.float64)
            for k in (1, 2, 3):
                rest[lived] += model.discounts[k - 1] * _values(model, f"seen{k}", before[lived], np.uint32)
        total, rest = total[again], rest[again]
        p = lower.copy()
        at = np.flatnonzero(total > 0)
        p[at] = lower[at] * rest[at] / total[at]
        at = at[token[at] >= 0]
        if len(at):
            keys = context[at].astype(np.uint64) << np.uint64(32) | token[at].astype(np.uint64)
            pair, where = np.unique(keys, return_inverse=True)
            part = model.part_of_number(pair >> np.uint64(32))
            found = _find(model.folder, "pair", part, pair)
            times = np.zeros(len(pair))
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(pair)], strict=True):
                have = found[a:b] >= 0
                times[a:b][have] = _mapped(model.folder, "times", int(part[a]), np.uint32)[found[a:b][have]]
            p[at] += np.where(times > 0, _discounted(times, model.discounts), 0.0)[where] / total[at]
        tokens[to] += np.bincount(owner, minlength=len(rows))
        known[to] += np.bincount(owner, weights=count > 0, minlength=len(rows)).astype(np.int64)
        base[to] += np.bincount(owner, weights=np.log10((count + 1) / (model.tokens + vocabulary + 1)), minlength=len(rows))
        score[to] += np.bincount(owner, weights=np.log10(p), minlength=len(rows))
    return tokens, known, base, score


def _score_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _scored(model, vectext.text_bytes(batch.column(2)))
            yield pa.record_batch([batch.column(0), batch.column(1), *map(pa.array, out)], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def _held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_FOLD, F.lit(False))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from the rows that aren't held out; both scores are sums of
    log10 probabilities over a text's words and its end.  ``base_score`` is
    add-one smoothed unigrams.  Perplexity is 10 ** (-score / n_tokens).

    Null texts count as empty: one token, the end.  Rows with a null id are
    trained on.  Repeated rows count as often as given; without training rows
    every token has the same probability; an empty table gives an empty one.
    Other columns are not read.  The model's files go when the scores are written.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), _held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    model = train(rows.where("not held_out").select("text"))
    try:
        scored = settled(rows.mapInArrow(_score_batches(model), "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"))
    finally:
        shutil.rmtree(model.folder, ignore_errors=True)
    return scored.select("id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
