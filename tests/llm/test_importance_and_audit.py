"""Importance resampling and the filter audit against plain versions, odd rows included."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidewake.llm import filter_audit, importance, vectext

LONG = ("Alpha beta-gamma " * 80000 + "#tail É ") * 2
ODD = [
    (900001, None, "src0"), (900002, "", None), (900003, "A b", ""), (900005, " \n", "src0"), (900006, LONG, "src1"), (900016, LONG, "src1"),
    (None, "null id", "src0"), (900007, "null id", "src0"), (None, "nobody's", None), (None, "nobody's", None), (900008, "same " * 250, "src2"), (900008, "same " * 250, "src2"), (900009, "same " * 250, None),
    (900010, "w" * 500 + " " + "é" * 300, "src0"), (900011, "-- !! ..", "src0"),
]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source")
    odd = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    names = ("id", "part", "fp", "mask", "n", "s", "t", "words", "rank", "score", "weight", "bucket", "__part", "low")
    return d.unionByName(odd).withColumns({c: F.lit(1) for c in names}).repartition(7).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"] or "", r["source"] or "") for r in docs.collect()]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def features(text, most):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def resampled(rows, target, buckets, most):
    known = {}

    def bucket(f):
        return known.setdefault(f, zlib.crc32(f.encode()) % buckets)

    found = [(i, *features(text, most)) for i, text, _ in rows]
    s, t = Counter(bucket(f) for _, _, fs in found for f in fs), Counter(bucket(f) for text in target for f in features(text, most)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in set(s) | set(t)}
    out = []
    for i, n, fs in found:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    rank = {}
    for k, r in enumerate(fit[: 10 * len(fit) // 100], 1):
        rank.setdefault(r, []).append(k)
    return sorted(((*r, rank[r].pop(0) if rank.get(r) else None) for r in out), key=str)


@pytest.mark.parametrize("most", [1, 3])
def test_resampling_against_plain_sums(spark, docs, rows, most):
    target = spark.read.parquet(f"{DATA}/benchmark.parquet").unionByName(spark.createDataFrame([(1, None), (2, "")], "item_id long, text string"))
    got = importance.resample(docs, target, buckets=1000, max_run=most)
    assert got.columns == ["id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == resampled(rows, [r["text"] or "" for r in target.collect()], 1000, most)


def test_resampling_of_empty_tables(spark, docs):
    none = docs.where("false")
    assert importance.resample(none, none).collect() == []
    few = importance.resample(docs.where("doc_id < 50"), none).collect()
    assert few and all(r["n_features"] >= 0 for r in few)


def test_no_row_of_the_matrix_holds_more_than_a_document(spark, docs, tmp_path):
    """Rows of whole blocks are added up by Parquet writers and readers, a partition's blocks at a time."""
    matrix = importance.write_matrix(docs, str(tmp_path / "matrix"))
    assert matrix.count() == docs.count()
    assert matrix.selectExpr("max(size(indices))").first()[0] <= importance.BUCKETS
    assert list(importance._cut([b"x" * importance.BLOCK_BYTES, b"y", b"z"])) == [(0, 1), (1, 3)]
    assert list(importance._cut([b""] * (importance.BLOCK_ROWS + 1))) == [(0, importance.BLOCK_ROWS), (importance.BLOCK_ROWS, importance.BLOCK_ROWS + 1)]


def test_ranks_follow_one_order_over_partitions(spark):
    n = 5000
    frame = spark.range(n).select((F.col("id") * 7919 % 1000).alias("score"), "id")
    got = [(r["score"], r["id"], r["rank"]) for r in importance.ranked(frame, [F.col("score").desc(), F.col("id").asc()], 700).collect()]
    want = sorted(((s, i) for s, i, _ in got), key=lambda x: (-x[0], x[1]))
    assert {(s, i): k for s, i, k in got} == {x: k if k <= 700 else None for k, x in enumerate(want, 1)}


def test_crc_of_words():
    words = [b"", b"a", b"123456789", b"x" * 64, b"y" * 65, b"z" * 5000]
    data = np.frombuffer(b"".join(words) + bytes(32), np.uint8)
    length = np.array([len(w) for w in words])
    assert vectext.crc32(data, np.cumsum(length) - length, length).tolist() == [zlib.crc32(w) for w in words]


def audited(rows, labels):
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text] = min(i, first.get(text, i))
    fails = []
    for i, text, part in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        e = text in first and (i is None or i > first[text])
        fails.append((i, part, {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": e}))
    out, shapley = {}, Counter()
    for order in permutations("ABCDE"):
        for i, part, f in fails:
            good, toxic = labels.get(i, (0, 0)) if i is not None else (0, 0)
            gone = False
            for step, x in enumerate(order, 1):
                c = out.setdefault((part, "".join(order), step), [0] * 6)
                c[0] += not gone and not f[x]
                c[1] += not gone and f[x]
                c[2] += gone and f[x]
                c[3] += f[x] and sum(f.values()) == 1
                c[4] += (not gone and f[x]) * good
                c[5] += (not gone and f[x]) * toxic
                shapley[part, x] += not gone and f[x]
                gone = gone or f[x]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_against_every_order(spark, docs, rows):
    told = [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()]
    told += [(900009, 1, 0), (900009, 0, 1), (900002, None, 1), (None, 1, 1), (900007, 1, None)]
    labels = {}
    for i, q, t in told:
        a, b = labels.get(i, (0, 0))
        labels[i] = (int(a or q == 1), int(b or t == 1))
    got = filter_audit.audit(docs, spark.createDataFrame(told, "doc_id long, quality int, toxic int"))
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got.collect()} == audited(rows, labels)
    assert dict(got.dtypes)["step"] == "int" and dict(got.dtypes)["shapley"] == "bigint"


def test_copies_over_many_partitions(spark):
    """One text in most rows: its copies lie in many ranges, and only the least id stays."""
    frame = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 > 0, F.lit("one text")).otherwise(F.concat(F.lit("own "), "id")).alias("text"), F.lit("s").alias("source"))
    masks = filter_audit.failure_masks(frame.orderBy(F.col("doc_id").desc()))
    assert masks.select(F.spark_partition_id()).distinct().count() > 1
    assert {r["id"] for r in masks.where("mask < 16").collect()} == {1} | set(range(0, 4000, 5))


def test_audit_of_an_empty_table(spark, docs):
    assert filter_audit.audit(docs.where("false"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
