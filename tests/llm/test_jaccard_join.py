"""The similarity join against all pairs, and its key scheme at the limit of similarity."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm.test_dedup import Sets
from tidewake.llm import jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(400_000))
ODD = [
    (900001, None), (900002, ""), (900003, " \n\t"), (900004, "A b"), (900005, "a  B"), (900006, "one two three"), (900007, "one two three"), (900008, LONG), (900009, LONG + " more"), (None, "one two three"),
    (None, "nobody else"), (900010, "same words here again " * 40), (900010, "same words here again " * 40), (900011, "x" * 3_000_000), (900012, "x" * 3_000_000), (900013, "É É é É"), (900014, "é é é é"),
]


def families(seed=3):
    """Texts around three bases: close copies, and many that are too far from all others."""
    draw = random.Random(seed)
    out = []
    for base in range(3):
        words = [f"b{base}w{i}" for i in range(300)]
        for edits in [1] * 40 + [3] * 30 + [9] * 25 + [14] * 25:
            copy = list(words)
            for _ in range(edits):
                copy[draw.randrange(len(copy))] = f"e{draw.randrange(10**6)}"
            out.append(" ".join(copy))
    return list(enumerate(out, 800_000))


def shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    return frozenset(" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def all_pairs(rows, percent):
    """{(id, n): component} by comparing all sets that share a shingle."""
    of = {i: shingles(t) for i, t in enumerate(t for _, t in rows)}
    distinct = sorted(set(of.values()) - {frozenset()}, key=len)
    where = defaultdict(list)
    sets = Sets()
    for k, s in enumerate(distinct):
        sets.find(k)
        near = defaultdict(int)
        for w in s:
            for j in where[w]:
                near[j] += 1
            where[w].append(k)
        for j, both in near.items():
            if 100 * both >= percent * (len(s) + len(distinct[j]) - both):
                sets.join(k, j)
    number = {s: sets.find(k) for k, s in enumerate(distinct)}
    least = {}
    for i, (key, _) in enumerate(rows):
        if of[i] and key is not None:
            root = number[of[i]]
            least[root] = min(key, least.get(root, key))
    return sorted(((key, len(of[i]), least.get(number[of[i]]) if of[i] else key) for i, (key, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("percent", [85, 60])
def test_components_against_all_pairs(spark, percent):
    given = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(ODD + families(), "doc_id long, text string"))
    docs = given.withColumns({c: F.lit(1) for c in ("id", "n", "h1", "h2", "k", "sid", "a", "b", "label", "tokens", "component")}).repartition(5).cache()
    got = jaccard_join.similar_components(docs, percent=percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == all_pairs([(r["doc_id"], r["text"]) for r in docs.collect()], percent)


def test_an_empty_table(spark):
    assert jaccard_join.similar_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_blocks_of_a_crowded_key(spark, monkeypatch):
    """Crowds are cut to blocks of few sets; the components stay."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    rows = families(8)
    got = jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=80)
    assert sorted((tuple(r) for r in got.collect()), key=str) == all_pairs(rows, 80)


def meet(a, b, bands, often):
    by = defaultdict(list)
    of_a, of_b = jaccard_join.set_keys([a, b], bands, often, 10_000)
    for k, r in zip(*of_b, strict=True):
        by[int(k)].append(r)
    return any(jaccard_join._may_meet(np.array([r]), np.array([q]))[0] for k, r in zip(*of_a, strict=True) for q in by[int(k)])


@pytest.mark.parametrize("percent", [85, 70])
def test_similar_sets_always_share_a_key(percent):
    draw = np.random.default_rng(7)
    bands = jaccard_join.Bands(percent)
    often = np.where(draw.random(jaccard_join.SKETCH) < 0.05, 900, 1)
    tried = 0
    for trial in range(1500):
        n = int(draw.integers(1, 40 if trial % 3 else 300))
        a = np.unique(draw.integers(0, 2**64, n, dtype=np.uint64, endpoint=False))
        kept = draw.permutation(a)[int(draw.integers(0, max(1, n * (100 - percent) // 100) + 1)) :]
        extra = 100 * len(kept) // percent - n  # as many other shingles as the limit allows
        if extra < 0 or not len(kept):
            continue
        tried += 1
        b = np.unique(np.concatenate([kept, draw.integers(0, 2**64, extra, dtype=np.uint64, endpoint=False)]))
        assert meet(a, b, bands, often), (len(a), len(b), len(kept))
    assert tried > 500


def test_budgets_cost_least():
    draw = np.random.default_rng(1)
    for _ in range(200):
        m, d = int(draw.integers(1, 6)), 0
        d = int(draw.integers(0, m + 1))
        cost = draw.integers(1, 9, m).astype(float)
        second = cost[:d] + draw.integers(0, 9, d)
        need = int(draw.integers(1, m + 1))
        got = jaccard_join.budgets(cost[None, :], second[None, :], np.array([need]))[0]

        def price(b):
            return sum(cost[i] * (x > 0) + (second[i] if x > 1 else 0) for i, x in enumerate(b))

        best = min(price(b) for b in np.ndindex(*[3 if i < d else 2 for i in range(m)]) if sum(b) == need)
        assert got.sum() == need and price(got) == best


def test_parities_never_differ_more_than_sets():
    draw = np.random.default_rng(2)
    for _ in range(300):
        a = np.unique(draw.integers(0, 2**64, int(draw.integers(1, 400)), dtype=np.uint64, endpoint=False))
        b = np.unique(np.concatenate([a[int(draw.integers(0, len(a))) :], draw.integers(0, 2**64, int(draw.integers(0, 200)), dtype=np.uint64, endpoint=False)]))
        x, y = jaccard_join._folded([jaccard_join.parities(a), jaccard_join.parities(b)])
        assert int(np.bitwise_count(x ^ y).sum()) <= len(set(a.tolist()) ^ set(b.tolist()))
