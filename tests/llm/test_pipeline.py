import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.test_dedup import Sets, fingerprint
from tests.llm.test_text_operators import statistics
from tidewake.llm import exact_dedup, mixing, packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
        if i == 1:
            assert exact_dedup.keep_unique(docs).count() == counts[-1]
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[4] > 0
    names = {"doc_id", "piece", "start", "length", "bin", "bin_size"}
    assert names <= set(docs.columns)
    bins = docs.where("bin is not null").groupBy("grp", "bin").agg({"length": "sum", "bin_size": "max"}).collect()
    assert all(r["sum(length)"] <= r["max(bin_size)"] <= packing.SIZES[-1] for r in bins)
    again = corpus_pipeline.run(spark, DATA)
    assert sorted(map(str, again.collect())) == sorted(map(str, docs.collect()))


def steps(spark, docs, tmp_path):
    """The table before the first stage and after each."""
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], DATA).write.parquet(str(tmp_path / str(i)))
        out.append(spark.read.parquet(str(tmp_path / str(i))))
    return out


def row_key(r):
    return r["doc_id"], r["text"], r["lang"], r["source"]


def check_stages(spark, docs, tmp_path):
    """Every stage's decision, made again from its own input without the operators."""
    tables = [t.collect() for t in steps(spark, docs, tmp_path)]
    start, good, unique, apart, mix, packed = tables
    # Quality: whatever fails the base rules goes; nothing is added or changed.
    assert not Counter(map(row_key, good)) - Counter(map(row_key, start))
    for r in good:
        n, _, _, _, repeated = statistics(r["text"])
        assert n >= 50 and 100 * repeated <= 50 * n
    # Exact copies: of each text one row of the largest id.
    best = {}
    for r in good:
        best[r["text"]] = max(best.get(r["text"], (False, 0)), (r["doc_id"] is not None, r["doc_id"] or 0))
    assert sorted((r["text"], r["doc_id"] is not None, r["doc_id"] or 0) for r in unique) == sorted((t, *b) for t, b in best.items())
    # Near copies: one document of each component of fingerprints within four bits.
    prints = [fingerprint(r["text"]) for r in unique]
    sets = Sets()
    for i, a in enumerate(prints):
        sets.find(i)
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                sets.join(i, j)
    groups = defaultdict(list)
    for i, r in enumerate(unique):
        groups[sets.find(i)].append(r)
    stays = Counter(r["text"] for r in apart)
    assert len(apart) == len(groups) and all(sum(stays[r["text"]] for r in g) == 1 for g in groups.values())
    # Mix: each source's words come near its target, whole words of its texts.
    size = defaultdict(int)
    for r in apart:
        size[r["source"]] += len(WORD.findall(r["text"]))
    taken = defaultdict(int)
    for r in mix:
        taken[r["source"]] += len(WORD.findall(r["text"]))
    plan = mixing.quotas(mixing.source_targets(spark.createDataFrame([(k, v) for k, v in size.items()] or [("x", 0)], "source string, size long"))).collect()
    for p in plan:
        if p["source"] in size:
            assert abs(taken[p["source"]] - p["target"]) <= max(2 * p["block"], 0.03 * p["target"])
    assert {w for r in mix for w in WORD.findall(r["text"])} <= {w for r in apart for w in WORD.findall(r["text"])}
    # Packing: every row's words lie once in bins that hold them.
    assert sum(r["length"] for r in packed) == sum(taken.values())
    fill = defaultdict(int)
    for r in packed:
        if r["bin"] is not None:
            fill[r["grp"], r["bin"], r["bin_size"]] += r["length"]
    assert all(v <= k[2] in packing.SIZES for k, v in fill.items())
    return tables


def test_stages_against_plain_versions(spark, tmp_path):
    tables = check_stages(spark, spark.read.parquet(f"{DATA}/documents.parquet"), tmp_path)
    assert [len(t) > 0 for t in tables] == [True] * 6


@pytest.mark.parametrize("rows", [0, 1])
def test_stages_of_odd_tables(spark, tmp_path, rows):
    """Nulls anywhere, empty and very long texts, repeated rows, extra columns; and no rows at all."""
    long = " ".join(f"w{i}x" for i in range(30_000))
    plain = " ".join(f"other{i}" for i in range(80))
    data = [(None, None, None, None, None, 1), (1, "", "en", "web", 0, 2), (2, long, "en", "web", len(long), 3), (2, long, "en", "web", len(long), 3), (None, plain, None, None, None, 4), (3, plain, "en", None, len(plain), 5)]
    docs = spark.createDataFrame(data if rows else [], "doc_id long, text string, lang string, source string, n_chars long, bin int")
    tables = check_stages(spark, docs, tmp_path)
    assert len(tables[1]) == 4 * rows and len(tables[2]) == 2 * rows and len(tables[-1]) > 0 or not rows
