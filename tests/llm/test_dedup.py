import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidewake.llm import exact_dedup, line_dedup, simhash
from tidewake.llm.components import connected_components

ODD = [(900001, None), (900002, ""), (900003, "A b"), (900004, "a  B"), (900005, " \n"), (900006, "x" * 7000 + " y z " + "w" * 50), (None, "null id"), (900007, "null id"), (900008, "same"), (900008, "same")]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    return d.unionByName(spark.createDataFrame(ODD, "doc_id long, text string")).withColumns({c: F.lit(1) for c in ("id", "fp", "sha", "h", "__x")}).cache()


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_simhash_against_all_pairs(spark, docs):
    rows = [(r["doc_id"], fingerprint(r["text"])) for r in docs.collect()]
    fps = sorted({f for _, f in rows})
    sets = Sets()
    for i, a in enumerate(fps):
        sets.find(a)
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                sets.join(a, b)
    least = defaultdict(list)
    for i, f in rows:
        least[sets.find(f)] += [i] if i is not None else []

    def known(x):
        return -1 if x is None else x

    got = sorted((known(r["id"]), r["fp"] % 2**64, known(r["component"])) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted((known(i), f, min(least[sets.find(f)], default=-1)) for i, f in rows)


def test_golay_keys_find_every_pair_within_four_bits():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 4000, dtype=np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
    a, b = (set(zip(*(v.tolist() for v in simhash.fuzzy_keys(z)), strict=True)) for z in (x, y))
    assert len({row for _, row in a & b}) == len(x)


def test_codewords_lie_within_four_bits():
    table = simhash.codeword_table()
    assert set(np.unique((table >= 0).sum(1)).tolist()) == {1, 6}
    words = np.arange(1 << 12) << 11
    code = words ^ simhash._syndrome(words)
    for segment in (0, 1, 0x1234, 0xFFFF, 0x8001):
        near = {int(c >> 11) for c in code if (int(c) ^ segment).bit_count() <= 4}
        assert near == set(table[segment][table[segment] >= 0].tolist())


def test_dense_groups_stay_connected():
    rng = np.random.default_rng(1)
    centre = np.uint64(0x0123456789ABCDEF)
    fps = np.array([centre ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3).astype(np.uint64)) for _ in range(400)] + rng.integers(0, 2**63, 50, dtype=np.uint64).tolist(), np.uint64)
    sets, fast = Sets(), Sets()
    distinct = np.unique(fps).tolist()
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 4:
                sets.join(a, b)
    links = 0
    for a, b in simhash.group_links(fps):
        links += len(a)
        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            assert (p ^ q).bit_count() <= 4
            fast.join(p, q)
    assert links < len(distinct) and [sets.find(f) for f in distinct] == [fast.find(f) for f in distinct]


def test_keep_one_keeps_columns(docs):
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns and 0 < out.count() < docs.count()


def test_exact_copies(docs):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r["text"] or ""].append(r["doc_id"])
    want = defaultdict(list)
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            want[i, hashlib.sha256(text.encode()).digest()].append((max(known, default=None), len(ids)))
    got, kept = defaultdict(list), defaultdict(int)
    for r in exact_dedup.mark_duplicates(docs).collect():
        got[r["id"], bytes(r["sha"])].append((r["keep_id"], r["group_size"]))
        kept[bytes(r["sha"])] += r["kept"]
        assert not r["kept"] or r["id"] == r["keep_id"]
    assert got == want and set(kept.values()) == {1}
    out = exact_dedup.keep_unique(docs)
    assert out.columns == docs.columns and out.count() == len(groups)


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    rows = spark.range(20000).select(F.xxhash64("id").alias("h")).union(spark.range(500).select(F.xxhash64("id").alias("h")))
    test = exact_dedup.bloom_test(rows, rows.count())
    assert spark.range(500).where(test(F.xxhash64("id"))).count() == 500
    assert spark.range(500, 20000).where(test(F.xxhash64("id"))).count() < 20000 * 0.05
    once = exact_dedup.bloom_test(rows, rows.count(), least=1)
    assert spark.range(20000).where(once(F.xxhash64("id"))).count() == 20000 and spark.range(20000, 40000).where(once(F.xxhash64("id"))).count() < 20000 * 0.05


def test_filters_by_range_give_the_same(spark, docs):
    """A filter too small for all hashes is split into many."""
    small = 2000 * exact_dedup.BITS_PER_ROW // 8 // 64
    assert exact_dedup.ranges_of(docs.count(), small) > 2
    want, got = (sorted(map(str, exact_dedup.mark_duplicates(docs, most_bytes=b).drop("sha").collect())) for b in (exact_dedup.MAX_FILTER_BYTES, small))
    assert got == want
    assert sorted(map(str, exact_dedup.keep_unique(docs, most_bytes=small).select("doc_id", "text").collect())) == sorted(map(str, exact_dedup.keep_unique(docs).select("doc_id", "text").collect()))


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(int(a), int(b)) for a, b in rng.integers(0, 90, (60, 2))] + [(200, 200), (201, 300), (201, 300)] + [(1000, 1001 + i) for i in range(80)]
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: sets.find(n) for e in edges for n in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def test_lines_against_all_pairs(spark):
    import random

    random.seed(1)

    def changed(x):
        i, c = random.randrange(len(x) + 1), random.choice("abc é")
        return random.choice([x[:i] + c + x[i:], x[:i] + x[i + 1 :], x[:i] + c + x[i + 1 :]])

    base = ["".join(random.choice("abcdé ") for _ in range(random.randrange(5, 40))) for _ in range(25)]
    lines = base + [changed(b) for b in base for _ in range(4)] + [changed(changed(b)) for b in base for _ in range(2)]
    hot = "the quick brown fox jumps over the lazy dog and runs away"
    lines += [changed(hot) for _ in range(120)] + [f"page number {i}" for i in range(60)]
    docs = spark.createDataFrame([(i, "\n".join(lines[i::20])) for i in range(20)] + [(100, None), (101, ""), (102, "\n \n"), (None, hot)], "doc_id long, text string")
    got = {r["line_id"]: r for r in line_dedup.line_classes(docs).collect()}

    def key(x):
        return hashlib.sha256(x.encode()).hexdigest()[:32]

    distinct = sorted({x for r in docs.collect() for x in (r["text"] or "").split("\n") if x.strip(" \t\x0b\x0c\r")})
    sets, links = Sets(), defaultdict(int)
    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            if within_one(x, y):
                sets.join(key(x), key(y))
                links[x] += 1
                links[y] += 1
    assert len(got) == len(distinct)
    for x in distinct:
        assert (got[key(x)]["n_links"], got[key(x)]["class_id"]) == (links[x], sets.find(key(x)))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_up_to_three():
    import random

    random.seed(4)
    a = ["".join(random.choice("ab") for _ in range(random.randrange(12))) for _ in range(600)]
    b = ["".join(random.choice("ab") for _ in range(random.randrange(12))) for _ in range(600)]
    for most in (1, 2, 3):
        assert line_dedup.edits_within(a, b, most).tolist() == [edits(x, y) <= most for x, y in zip(a, b, strict=True)]


def linked(spark, lines, most, **limits):
    lines = sorted(lines)
    table = spark.createDataFrame(list(enumerate(lines)), "no long, line string")
    return lines, {(r["a"], r["b"]) for r in line_dedup.line_links(table, most, **limits).collect()}


@pytest.mark.parametrize(("most", "limits"), [(1, {}), (1, {"group_rows": 8, "held_rows": 20}), (2, {}), (3, {})])
def test_links_of_any_threshold_and_group_size(spark, most, limits):
    """Small limits make groups split in tasks and between tasks."""
    rng = np.random.default_rng(3)
    lines = {"".join(rng.choice(list("ab1é"), rng.integers(1, 10))) for _ in range(150)} | {"Page 1", "Page 2", "Page 12", "Page 123", "Page 1234", "1234567", "12345678", "123456789"}
    lines |= {"Page " + chr(200 + i) for i in range(60)}
    hot = "the quick brown fox jumps over the lazy dog"
    for _ in range(60):
        x = hot
        for _ in range(rng.integers(1, 4)):
            i = rng.integers(0, len(x) + 1)
            x = x[:i] + rng.choice(list("xyz"))[0] * rng.integers(0, 2) + x[i + rng.integers(0, 2) :]
        lines.add(x)
    lines, got = linked(spark, lines, most, **limits)
    assert got == {(i, j) for j, y in enumerate(lines) for i, x in enumerate(lines[:j]) if abs(len(x) - len(y)) <= most and edits(x, y) <= most}


def test_very_long_lines_are_linked(spark):
    rng = np.random.default_rng(8)
    base = "".join(rng.choice(list("abcdef "), 200_000))
    lines = {base, base[:70_000] + "Z" + base[70_001:], base[:-1], base[:100] + base[101:], "Q" + base, base[:50] + "ZZ" + base[52:]}
    lines, got = linked(spark, lines, 1)
    assert got == {(i, j) for j, y in enumerate(lines) for i, x in enumerate(lines[:j]) if within_one(x, y)}


def test_line_classes_of_odd_tables(spark):
    rows = [(1, "same\nother one", "x", 3), (1, "same\nother one", "x", 3), (None, "same", None, None), (2, None, "y", 1), (3, "", "y", 1), (4, " \t", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line string, no int")
    got = sorted((r["first_doc"] or 0, r["first_line"], r["n_rows"], r["n_links"]) for r in line_dedup.line_classes(docs).collect())
    assert got == [(0, 0, 3, 0), (1, 1, 2, 0)]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert simhash.near_duplicates(none).count() == exact_dedup.mark_duplicates(none).count() == exact_dedup.keep_unique(none).count() == line_dedup.line_classes(none).count() == 0
