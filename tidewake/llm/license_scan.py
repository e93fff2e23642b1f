"""Licence notices in documents: a trained paragraph classifier, confirmed by templates.

Features of a paragraph are the word pairs and triples that it shares with the
training notices, so a paragraph without any has the score of its class biases
and needs no further work.  The classifier is multinomial logistic regression
over the families, "unknown" and "none", trained here on varied templates, on
notices of licences that have no template, known and made up, and on a bounded
sample of paragraphs; its probabilities are calibrated by a temperature fitted
on held-out examples.  Lines up to the next without a word are one paragraph, so a
notice may be wrapped anywhere.  Every family is reported at each place that
holds most of one of its templates in order and that the classifier finds like
a notice.  A line without such a place that is like a notice, by itself or with
the next line, is "unknown": a licence's notice, but of none that is known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Paragraphs that the classifier learns "none" from: those with the least
#: hashes with their documents' ids, of those up to SAMPLE_CHARS long.
SAMPLE_PARAGRAPHS, SAMPLE_CHARS = 4000, 4000
#: Least part of a template's words that a paragraph must hold in order.
LEAST_MATCH = 0.8
#: Least calibrated probability of being a notice at all.
LEAST_PROBABILITY = 0.5
VARIANTS = 60
SEED = 5

# Usual short notices of each family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl-3.0": ("licensed under the gnu affero general public license version 3", "released under the gnu agpl version 3"),
    "apache-2.0": ("licensed under the apache license version 2.0", "released under the apache license 2.0", "distributed under the terms of the apache license version 2.0"),
    "bsd": ("released under the bsd license", "licensed under the 3 clause bsd license", "redistribution and use in source and binary forms with or without modification are permitted"),
    "cc-by-4.0": ("licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    "cc-by-nc-4.0": ("licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    "cc-by-sa-4.0": ("licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    "cc0-1.0": ("released under cc0 1.0", "to the extent possible under law the author has waived all copyright and related rights"),
    "gpl-2.0": ("this work is licensed under the gnu general public license version 2", "released under the gnu gpl version 2"),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", "released under the gnu gpl version 3"),
    "lgpl-3.0": ("this work is licensed under the gnu lesser general public license version 3", "released under the gnu lgpl version 3"),
    "mit": ("released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    "mpl-2.0": ("licensed under the mozilla public license version 2.0", "this source code form is subject to the terms of the mozilla public license"),
    "proprietary": ("all rights reserved", "confidential and proprietary unauthorized copying is prohibited"),
}
FAMILIES = (*sorted(TEMPLATES), "unknown", "none")
UNKNOWN, NONE = len(FAMILIES) - 2, len(FAMILIES) - 1
# Names of licences without a template, and how notices put a name.
OTHER_LICENCES = tuple(
    "boost software;eclipse public;isc;zlib;artistic;common development and distribution;european union public;universal permissive;academic free;open software;microsoft public;"
    "sil open font;python software foundation;postgresql;openssl;php;ruby;cecill;mulan permissive software;server side public;business source;elastic;commons clause;nasa open source;wtfpl".split(";")
)
NOTICE_FORMS = (
    "licensed under the {} license", "licensed under the {} license version {}", "released under the {} license", "distributed under the {} license version {}", "distributed under the terms of the {} license",
    "this work is licensed under the {} license version {}", "this software is made available under the {} license", "use of this source code is governed by the {} license", "subject to the terms of the {} license version {}",
    "this file may be used under the terms of the {} license", "provided under the {} license agreement",
)
#: Words that don't open the search for a template's pairs.
COMMON = frozenset("a all and any be by can for form from in is may of or other related source the this to under use with without work are any person".split())
TOKEN = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: A template of fewer words must end where a sentence or line does.
SHORT_TEMPLATE = 4


def tokens(paragraph: str) -> list[str]:
    return TOKEN.findall(paragraph.lower())


def ends(line: str) -> list[bool]:
    """For each token of a line, whether a sentence or the line ends after it."""
    line = line.lower()
    found = [m.end() for m in TOKEN.finditer(line)]
    starts = [m.start() for m in TOKEN.finditer(line)]
    return [k == len(found) - 1 or any(c in ".;:!?,()|" for c in line[e : starts[k + 1]]) for k, e in enumerate(found)]


def _grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)}


def _unknown_notices(rng: np.random.Generator, filler: list[str]) -> list[list[str]]:
    """Notices of licences without a template: those above, and as many with a made-up name."""
    made_up = [" ".join(str(w) for w in rng.choice(filler, rng.integers(1, 4))) for _ in OTHER_LICENCES]
    return [tokens(form.format(name, f"{rng.integers(1, 5)}.{rng.integers(0, 3)}")) for form in NOTICE_FORMS for name in (*OTHER_LICENCES, *made_up)]


def vocabulary() -> dict[str, int]:
    """Pairs and triples of the templates and of other notices' forms that hold a word that isn't common."""
    forms = [tokens(part) for form in NOTICE_FORMS for part in form.replace(" version {}", " version").split("{}")]
    named = [tokens(form.format(name, "")) for form in NOTICE_FORMS[:2] for name in OTHER_LICENCES]
    found = {g for words in (*(tokens(t) for ts in TEMPLATES.values() for t in ts), *forms, *named) for g in _grams(words) if not COMMON.issuperset(g.split())}
    return {g: i for i, g in enumerate(sorted(found))}


def in_order(template: list[str], words: list[str]) -> float:
    """Part of the template's words that the paragraph holds in order, in a stretch half as long again at most."""
    best, span = 0, len(template) + len(template) // 2
    first = set(template[: max(1, len(template) // 4 + 1)])
    for at in (i for i, w in enumerate(words) if w in first):
        row = [0] * (len(template) + 1)
        for w in words[at : at + span]:
            left = 0
            for j, t in enumerate(template):
                up = row[j + 1]
                row[j + 1] = left + 1 if w == t else max(up, row[j])
                left = up
        best = max(best, row[-1])
        if best == len(template):
            break
    return best / len(template)


def _own_words() -> dict[str, frozenset[str]]:
    """For each template, its words that no other family's templates have."""
    by_family = {f: {w for t in ts for w in tokens(t)} for f, ts in TEMPLATES.items()}
    return {t: frozenset(w for w in tokens(t) if not any(w in ws for g, ws in by_family.items() if g != f)) for f, ts in TEMPLATES.items() for t in ts}


OWN_WORDS = _own_words()


def match(family: str, words: list[str]) -> float:
    """The best of the family's templates; one whose own words are all missing doesn't count."""
    held = set(words)
    return max(in_order(tokens(t), words) if not OWN_WORDS[t] or OWN_WORDS[t] & held else 0.0 for t in TEMPLATES[family])


@dataclass
class Classifier:
    """Weights by feature and family, their biases, and the temperature of the probabilities."""

    features: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    @property
    def anchors(self) -> frozenset[str]:
        """Every feature holds one of these words."""
        return frozenset(max((w for w in g.split() if w not in COMMON), key=len) for g in self.features)

    def probabilities(self, words: list[str]) -> np.ndarray:
        hit = [self.features[g] for g in _grams(words) if g in self.features]
        z = (self.weights[hit].sum(axis=0) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _examples(negatives: list[str], rng: np.random.Generator) -> tuple[list[list[str]], np.ndarray]:
    """Templates with words dropped and put among others, and paragraphs without a template."""
    filler = [w for p in negatives[:200] for w in tokens(p)] or ["text"]
    words, labels = [], []
    for k, family in enumerate(FAMILIES[:UNKNOWN]):
        for template in TEMPLATES[family]:
            base = tokens(template)
            for v in range(VARIANTS):
                kept = base if v % 3 == 0 or len(base) < 5 else [w for w in base if rng.random() > 0.08]
                a, b = rng.integers(0, len(filler), 2)
                before, after = rng.integers(0, 12, 2) * (v % 2)
                words.append(filler[a : a + before] + kept + filler[b : b + after])
                labels.append(k)
    for notice in _unknown_notices(rng, filler):
        a, b = rng.integers(0, len(filler), 2)
        before, after = rng.integers(0, 12, 2) * rng.integers(0, 2)
        words.append(filler[a : a + before] + notice + filler[b : b + after])
        labels.append(UNKNOWN)
    for p in negatives:
        found = tokens(p)
        if not any(in_order(tokens(t), found) >= LEAST_MATCH for ts in TEMPLATES.values() for t in ts):
            words.append(found)
            labels.append(NONE)
    for _ in range(VARIANTS * 5):  # a template's words, shuffled and few, are no notice
        base = tokens(str(rng.choice([t for ts in TEMPLATES.values() for t in ts])))
        words.append([str(w) for w in rng.permutation(base)[: max(2, len(base) // 2)]])
        labels.append(NONE)
    return words, np.array(labels)


def fit(negatives: list[str], rounds: int = 300) -> Classifier:
    """Trains on three quarters of the examples and calibrates on the rest."""
    rng = np.random.default_rng(SEED)
    features = vocabulary()
    words, labels = _examples(negatives, rng)
    x = np.zeros((len(words), len(features)), np.float32)
    for i, w in enumerate(words):
        hit = [features[g] for g in _grams(w) if g in features]
        x[i, hit] = 1
    shuffled = rng.permutation(len(words))
    cut = len(words) * 3 // 4
    train, held = shuffled[:cut], shuffled[cut:]
    target = np.eye(len(FAMILIES), dtype=np.float32)[labels]
    share = target[train].mean(axis=0)
    importance = (1 / np.maximum(share, 1e-3) / len(FAMILIES))[labels[train]][:, None]
    w, b = np.zeros((len(features), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    mw, mb = np.zeros_like(w), np.zeros_like(b)

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    for _ in range(rounds):
        error = (softmax(x[train] @ w + b) - target[train]) * importance
        mw = 0.9 * mw + x[train].T @ error / cut + 1e-4 * w
        mb = 0.9 * mb + error.mean(axis=0)
        w -= 1.0 * mw
        b -= 1.0 * mb
    z = x[held] @ w + b
    grid = np.geomspace(0.25, 4, 41)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(held)), labels[held]], 1e-12)).mean() for t in grid]
    return Classifier(features, w.astype(np.float64), b.astype(np.float64), float(grid[int(np.argmin(loss))]))


#: Each template's family, words, and those that may begin it.
_SEARCHED = [(f, t, tokens(t), frozenset(tokens(t)[: len(tokens(t)) // 4 + 1])) for f in sorted(TEMPLATES) for t in TEMPLATES[f]]


#: Families that a short template can stand for.
SHORT_FAMILIES = frozenset(f for f, ts in TEMPLATES.items() if any(len(tokens(t)) < SHORT_TEMPLATE for t in ts))


@dataclass
class Place:
    """A stretch of words that holds most of a template."""

    family: str
    template: frozenset[str]
    first: int
    last: int
    similarity: float
    n: int
    probability: float = 0.0


def _best_from(template: list[str], words: list[str], at: int, span: int) -> tuple[int, int]:
    """How many of the template's words stand in order from ``at`` on, and the end of the shortest stretch that holds them."""
    row, most, end = [0] * (len(template) + 1), 0, at
    for k in range(at, min(at + span, len(words))):
        left = 0
        for j, t in enumerate(template):
            up = row[j + 1]
            row[j + 1] = left + 1 if words[k] == t else max(up, row[j])
            left = up
        if row[-1] > most:
            most, end = row[-1], k
            if most == len(template):
                break
    return most, end


def places(words: list[str], classifier: Classifier, stops: list[bool] | None = None) -> list[Place]:
    """Where templates stand in a paragraph, in order; what a better place of another family explains is left out."""
    hot = np.array([i for i in range(len(words) - 1) if f"{words[i]} {words[i + 1]}" in classifier.features])
    if not len(hot):
        return []
    held, found = set(words), []
    for family, text, template, opening in _SEARCHED:
        own = OWN_WORDS[text]
        if own and own.isdisjoint(held) or len(held.intersection(template)) < LEAST_MATCH * len(set(template)) - 1:
            continue
        span = len(template) + len(template) // 2
        at = 0
        best: Place | None = None
        while at < len(words):
            if best and at > best.last:
                found.append(best)
                best = None
            near = int(np.searchsorted(hot, at))
            if near == len(hot):
                break
            if hot[near] >= at + span:
                at = int(hot[near]) - span + 1
                continue
            if words[at] in opening:
                n, last = _best_from(template, words, at, span)
                open_end = len(template) < SHORT_TEMPLATE and stops is not None and not stops[last]
                if n >= LEAST_MATCH * len(template) and not open_end and (not own or not own.isdisjoint(words[at : last + 1])):
                    if not best or n > best.n or n == best.n and last - at < best.last - best.first:
                        best = Place(family, frozenset(template), at, last, n / len(template), n)
            at += 1
        if best:
            found.append(best)
    found.sort(key=lambda p: (-p.similarity, -p.n, p.first, p.family))
    kept: list[Place] = []
    for p in found:
        mine = p.template.intersection(words[p.first : p.last + 1])
        if any(q.first <= p.last and p.first <= q.last and (p.family == q.family or mine <= q.template) for q in kept):
            continue
        p.probability = float(1 - classifier.probabilities(words[p.first : p.last + 1])[NONE])
        if p.probability >= LEAST_PROBABILITY:
            kept.append(p)
    return sorted(kept, key=lambda p: (p.first, p.last, p.family))


def scan(text: str | None, classifier: Classifier, anchors: frozenset[str]) -> list[dict]:
    """Notices of one document, in order: number of the line where it begins, family, probability and match."""
    found: list[dict] = []
    if not text:
        return found
    block: list[tuple[int, list[str]]] = []
    written: list[str] = []

    def unknown(number: int, words: list[str]) -> bool:
        if anchors.isdisjoint(words):
            return False
        p = classifier.probabilities(words)
        # Not of a template, so what looks like a family counts for the unknown; a short template's words alone don't.
        like = p[UNKNOWN] >= LEAST_PROBABILITY or 1 - p[NONE] >= LEAST_PROBABILITY and FAMILIES[int(np.argmax(p))] not in SHORT_FAMILIES
        if like:
            best = max(range(UNKNOWN), key=lambda k: p[k])
            found.append({"paragraph": number, "family": "unknown", "probability": float(1 - p[NONE]), "similarity": match(FAMILIES[best], words)})
        return bool(like)

    def close() -> None:
        words = [w for _, ws in block for w in ws]
        if not anchors.isdisjoint(words):
            line_of = [k for k, (_, ws) in enumerate(block) for _ in ws]
            taken: set[int] = set()
            stops = [stop for line in written for stop in ends(line)]
            for p in places(words, classifier, stops):
                taken.update(range(line_of[p.first], line_of[p.last] + 1))
                found.append({"paragraph": block[line_of[p.first]][0], "family": p.family, "probability": p.probability, "similarity": p.similarity})
            taken.update([k for k, (number, ws) in enumerate(block) if k not in taken and unknown(number, ws)])
            for k in range(len(block) - 1):
                if k not in taken and k + 1 not in taken and unknown(block[k][0], block[k][1] + block[k + 1][1]):
                    taken.update((k, k + 1))
        block.clear()
        written.clear()

    for number, line in enumerate(text.split("\n")):
        if words := tokens(line):
            block.append((number, words))
            written.append(line)
        else:
            close()
    close()
    return sorted(found, key=lambda x: x["paragraph"])


FOUND = "array<struct<paragraph: long, family: string, probability: double, similarity: double>>"


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found) of every row; ``found`` is empty if a text has no notice.

    The classifier's sample is of lines.  Null texts have no notice; null ids and repeated rows come
    back as given; an empty table trains on templates alone; other columns are
    not read.
    """
    paragraphs = docs.select(F.col(id_col).alias("i"), F.explode(F.split(F.col(text_col), "\n")).alias("p")).where(F.length("p").between(1, SAMPLE_CHARS))
    # Hashes below this hold several times the sample; so each task sends few rows to be ordered.
    share = min(1.0, 4 * SAMPLE_PARAGRAPHS / max(paragraphs.count(), 1))
    if share < 1:
        paragraphs = paragraphs.where(F.xxhash64("p", "i") <= int(share * 2**64) - 2**63)
    sample = paragraphs.orderBy(F.xxhash64("p", "i"), "p").limit(SAMPLE_PARAGRAPHS)
    classifier = fit(list(dict.fromkeys(r["p"] for r in sample.select("p").collect())))
    anchors = classifier.anchors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]))
        for batch in batches:
            found = [scan(t, classifier, anchors) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, kind)], names=["id", "found"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id long, found {FOUND}")
