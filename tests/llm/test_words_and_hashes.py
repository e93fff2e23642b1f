import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from tidewake.llm import vectext

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_words_and_hashes_against_the_plain_way():
    random.seed(2)
    texts = ["", " ", "\n\n", "a", "Ä b", " lead", "trail \t", "x" * 200, "a\x0bb\x0cc\rd"] + ["".join(random.choice("aB é\n\t ß日") for _ in range(random.randrange(300))) for _ in range(60)]
    views = vectext.text_bytes(pa.array([*texts, None]))
    got = {i: [] for i in range(len(views))}
    for rows, joined, _ in vectext.stretches(views):
        w = vectext.words_of(rows, joined, views)
        h = vectext.xxh64(w.data, w.start, w.end - w.start)
        for r, s, e, x in zip(w.row, w.start, w.end, h, strict=True):
            got[rows[r]].append((bytes(w.data[s:e]).decode(), int(x)))
    for i, t in enumerate([*texts, ""]):
        want = [(x, xxhash.xxh64_intdigest(x.encode(), 42)) for x in WORD.findall(lower(t))]
        assert got[i] == want


def test_long_texts_are_cut_at_white_space(monkeypatch):
    monkeypatch.setattr(vectext, "STRETCH", 64)
    text = " ".join(f"w{i}" for i in range(200)) + " " + "z" * 300 + " end"
    views = vectext.text_bytes(pa.array(["short", text, "after"]))
    seen = {0: [], 1: [], 2: []}
    for rows, joined, _ in vectext.stretches(views):
        w = vectext.words_of(rows, joined, views)
        for r, s, e in zip(w.row, w.start, w.end, strict=True):
            seen[rows[r]].append(bytes(w.data[s:e]).decode())
    assert seen[1] == text.split() and seen[0] == ["short"] and seen[2] == ["after"]


def test_sliced_arrays():
    a = pa.array(["a", None, "bcd", "e"]).slice(1, 2)
    assert [bytes(v) for v in vectext.text_bytes(a)] == [b"", b"bcd"]


def test_xxh64_of_every_length():
    data = np.frombuffer(bytes(range(256)) * 2 + bytes(8), np.uint8)
    n = np.arange(300)
    got = vectext.xxh64(data, np.full(300, 3), n, seed=7)
    assert got.tolist() == [xxhash.xxh64_intdigest(bytes(data[3 : 3 + k]), 7) for k in range(300)]
