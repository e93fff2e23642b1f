import functools
import heapq
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidewake.llm import chat_format, html_text, license_scan, llm_queries, mixing, ngram_lm, packing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(900001, None, None, None, None), (900002, "", "en", "src1", 0), (900003, "The of unseenword the", "en", None, 21), (None, "null id here", "xx", "zz", 12), (900004, "long " * 3000 + "tail", "en", "src1", 15004), (900004, "long " * 3000 + "tail", "en", "src1", 15004)]
    return d.unionByName(spark.createDataFrame(odd, d.schema)).withColumns({c: F.lit(7) for c in ("size", "row", "target", "grp", "stratum", "x1")}).cache()


# ---------------------------------------------------------------- mixing


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out, live = 1.5 * sum(sizes.values()), {}, set(names)
    while live:
        unit = left / sum(w[s] for s in live)
        full = {s for s in live if w[s] * unit >= 2 * sizes[s]}
        if not full:
            out |= {s: w[s] * unit for s in live}
            break
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        live -= full
    return out


def test_mix_targets_and_takes(docs):
    rows = docs.collect()
    size = [len(WORD.findall(r["text"] or "")) for r in rows]
    totals = defaultdict(int)
    for r, n in zip(rows, size, strict=True):
        totals[r["source"]] += n
    want = brute_targets(totals)
    got = mixing.mix(docs).collect()
    assert sorted((r["id"] or -1, r["size"]) for r in got) == sorted((r["doc_id"] or -1, n) for r, n in zip(rows, size, strict=True))
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(p["last"] - p["first"] for p in r["pieces"])
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    assert sorted({(r["source_size"], round(r["target"], 4)) for r in got}) == sorted({(totals[s], round(want[s], 4)) for s in totals})
    for (n, target), words in taken.items():
        many = sum(1 for s in totals if totals[s] == n and abs(want[s] - target) < 1e-3)
        assert abs(words / many - target) <= max(1.0, 0.025 * target)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))


def test_mix_itself_holds_the_words_taken(docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words = out.select(F.sum(mixing.n_words(F.col("text")))).first()[0]
    assert words == sum(r["taken"] for r in mixing.mix(docs).collect())
    texts = {r["text"] for r in docs.collect()}
    plan = mixing.quotas(mixing.source_targets(docs.select("source", mixing.n_words(F.col("text")).alias("size")))).collect()
    # Only where a shard's run begins or ends, twice in each of two rounds at most, is a text cut.
    assert sum(r["text"] not in texts for r in out.collect()) <= 4 * sum(p["shards"] for p in plan)


def test_quotas_are_those_of_highest_quotients(spark):
    targets = [(1, "a", 500, 3.0, 733.0), (2, "b", 900, 1.0, 245.5), (3, "c", 80, 2.0, 119.0), (4, "d", 0, 1.0, 0.0)]
    got = {r["source"]: r for r in mixing.quotas(spark.createDataFrame(targets, "no int, source string, source_size long, weight double, target double"), shards=4, shard_blocks=8).collect()}
    block = got["a"]["block"]
    heap = [(-t / block, s, 0) for _, s, _, _, t in targets if t]
    heapq.heapify(heap)
    awards, total = Counter(), sum(r["quota"] for r in got.values())
    for _ in range(total):  # Sainte-Laguë one award at a time
        _, s, q = heapq.heappop(heap)
        awards[s] += 1
        t = next(x[4] for x in targets if x[1] == s)
        heapq.heappush(heap, (-t / block / (2 * q + 3), s, q + 1))
    assert {s: r["quota"] for s, r in got.items()} == {s: awards[s] for s in got}
    for r in got.values():
        assert sum(r["shard_quotas"]) == r["quota"] and min(r["shard_quotas"]) >= 0


def test_blocks_are_taken_shard_by_shard(docs):
    """Every word's block, and how often its shard takes it, one block at a time."""
    plan = {r["source"]: r for r in mixing.quotas(mixing.source_targets(docs.select("source", mixing.n_words(F.col("text")).alias("size")))).collect()}
    rows = mixing._rows(docs, "doc_id", "text", mixing.SEED).withColumn("arc", F.pmod("key", F.lit(mixing.ARCS))).collect()
    shift = {(r["no"], k): r["h"] for r in docs.sparkSession.range(20).selectExpr("cast(id as int) as k").crossJoin(docs.sparkSession.createDataFrame([(p["no"],) for p in plan.values()], "no int")).withColumn("h", F.xxhash64(F.lit(mixing.SEED), "no", "k")).collect() for k in [r["k"]]}
    want = Counter()
    for source, p in plan.items():
        times = []
        starts = [*p["shard_starts"], p["blocks"]]
        for k, quota in enumerate(p["shard_quotas"]):
            mine = starts[k + 1] - starts[k]
            took = [0] * mine
            at = shift[p["no"], k] % mine if mine else 0
            for _ in range(quota):
                took[at] += 1
                at = (at + 1) % mine
            times += took
        assert max(times) <= 2 and sum(times) == p["quota"]
        place = 0
        for r in sorted((r for r in rows if r["source"] == source), key=lambda r: (r["arc"], r["key"], r["id"] is not None, r["id"], r["size"], r["row"])):
            want[r["row"]] = sum(times[(place + w) // p["block"]] for w in range(r["size"]))
            place += r["size"]
    assert {r["row"]: r["taken"] for r in mixing.mix(docs).collect()} == {r["row"]: want[r["row"]] for r in rows}


# ---------------------------------------------------------------- packing


def plain_best_fit(lengths, sizes, cost):
    """The packing rule read word for word: lists of bins, searched one by one."""
    left = sorted(lengths, reverse=True)
    bins = []  # [size, contents], the one filled last at the end
    while left:
        x = left.pop(0)
        fits = [b for b in bins if b[0] - sum(b[1]) >= x]
        if fits:
            least = min(b[0] - sum(b[1]) for b in fits)
            b = [b for b in fits if b[0] - sum(b[1]) == least][-1]
            bins = [other for other in bins if other is not b] + [b]
            b[1].append(x)
            continue
        prices = []
        for c in (c for c in sizes if c >= x):
            room = c - x
            for y in left:  # the longest that still fits, again and again
                if y <= room:
                    room -= y
            prices.append(((c + cost) / (c - room), -c))
        bins.append([-min(prices)[1], [x]])
    return sorted((min(c for c in sizes if c >= sum(b)), sorted(b)) for _, b in bins)


def test_packing_against_plain_best_fit():
    rng = np.random.default_rng(6)
    for sizes, cost in (((8, 16, 32), 2), ((10, 25, 60), 5), ((64,), 1)):
        for _ in range(60):
            lengths = [int(v) for v in rng.integers(1, sizes[-1] + 1, rng.integers(1, 60))]
            bins, offsets, chosen = packing.pack_lengths(lengths, sizes, cost)
            held = defaultdict(list)
            for x, b in zip(lengths, bins, strict=True):
                held[b].append(x)
            got = sorted((chosen[b], sorted(v)) for b, v in held.items())
            want = plain_best_fit(lengths, sizes, cost)
            assert got == want
            assert len(set(zip(bins, offsets, strict=True))) == len(lengths)


def test_packing_loses_nothing_and_fits(docs):
    got = packing.pack(docs, sizes=(64, 256, 1024)).collect()
    by = defaultdict(list)
    bins = defaultdict(list)
    for r in got:
        by[r["id"]].append((r["start"], r["length"]))
        if r["length"]:
            bins[r["grp"], r["bin"]].append(r)
        else:
            assert r["bin"] is None
    want = defaultdict(list)
    for r in docs.collect():
        n = len(WORD.findall(r["text"] or ""))
        want[r["doc_id"]] += [(a, min(1024, n - a)) for a in range(0, max(n, 1), 1024)]
    assert {k: sorted(v) for k, v in by.items()} == {k: sorted(v) for k, v in want.items()}
    for rows in bins.values():
        size, fill = rows[0]["bin_size"], sum(r["length"] for r in rows)
        assert fill <= size and fill == rows[0]["bin_fill"] and size == min(c for c in (64, 256, 1024) if c >= fill)
        at = 0
        for r in sorted(rows, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["length"]


def test_packing_is_tight_and_prefers_cheap_sizes():
    random.seed(6)
    lengths = [random.randrange(1, 900) for _ in range(3000)]
    bins, _, sizes = packing.pack_lengths(lengths, (256, 512, 1024, 2048), 8)
    assert sum(sizes) < 1.01 * sum(lengths) and len(set(bins)) == len(sizes)
    assert packing.pack_lengths([300, 212], (256, 512, 4096), 0)[2] == [512]
    assert packing.pack_lengths([], (8,), 0) == ([], [], [])


# ---------------------------------------------------------------- chat


def test_chat(spark):
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", None)]
    rows = []
    for conv, t in ((1, turns[:1]), (2, turns[:2]), (3, turns), (4, turns), (5, [("user", "a"), ("assistant", "x")]), (6, [(None, "z")] * 200), (7, [(None, "z")] * 130), (None, [("user", "q")]), (9, [("user", "q")])):
        rows += [(conv, i, *x, "extra") for i, x in enumerate(t)]
    random.seed(1)
    random.shuffle(rows)
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")
    got = defaultdict(list)
    for r in chat_format.collapse(c).collect():
        got[r["conv_id"]].append(r)
    assert {k: (v[0]["kept"], v[0]["kept_by"]) for k, v in got.items()} == {1: (False, 3), 2: (False, 3), 3: (True, 3), 4: (False, 3), 5: (True, 5), 6: (True, 6), 7: (False, 6), None: (False, 9), 9: (True, 9)}
    whole = "".join(r["text"] for r in sorted(got[6], key=lambda r: r["chunk"]))
    assert whole == "<|unknown|>\nz<|end|>\n" * 200 and len(got[6]) == 4 and got[1][0]["text"] is None
    assert chat_format.collapse(c.limit(0)).count() == 0


# ---------------------------------------------------------------- pages


def test_extraction_on_given_pages(spark):
    import html

    for r in html_text.extract(spark.read.parquet(f"{DATA}/pages.parquet")).join(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def words(k, n=40):
    return " ".join(f"w{k}x{i}" for i in range(n))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<nav>menu</nav>", ""), ("plain &amp; simple", "plain & simple"), ("<p>a  b\n c<p>d &#233;<br>e", "a b c\nd é e"),
        (f"<body><header>H</header><div><h2>T</h2><p>{words(1)}</p><ul><li>{words(2, 8)}<li>x</ul></div><aside>s</aside><form><p>f</p></form><div class='comment-list'><p>{words(3)}</p></div><footer>F</footer></body>", f"T\n{words(1)}\n{words(2, 8)}\nx"),
        (f"<div id=cookie-notice>{words(9)}</div><main><p>{words(1)}</p><p class='x' hidden>no</p><script>var a='<p>';</script><style>p{{}}</style><!-- <p>c</p> --><table><tr><td>1<td>2</table></main><div role=navigation>{words(8)}</div>", f"{words(1)}\n1\n2"),
        (f"<article><p>{words(1)}</p></article><div class=sidebar>{words(2)}</div>", words(1)),
        (f"<div><div><p>{words(1)}<p>{words(2)}</div><div><p>{words(3)}</div></div><ul><li><a href=x>one</a><li><a href=y>two</a></ul>", f"{words(1)}\n{words(2)}\n{words(3)}"),
        ("<<p>a</b></p", "<\na"),
    ],
)
def test_extraction_of_small_pages(page, want):
    got = html_text.main_text(page)
    if page == "<<p>a</b></p":
        assert "a" in got
    else:
        assert got == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><div id=content><p>{words(1, 80)}<p>{words(2, 80)}<p>{words(3, 80)}</div><div><article><p>{words(4, 5)}</article></div></body>", f"{words(1, 80)}\n{words(2, 80)}\n{words(3, 80)}"),
        (f"<body><article><p>{words(1)}<p>{words(2)}<p>{words(3)}</article><article><p>{words(4)}<p>{words(5)}</article></body>", "\n".join(words(k) for k in range(1, 6))),
        (f"<body><div><h2>T</h2><article><p>{words(1, 80)}<p>{words(2, 80)}</article></div></body>", f"{words(1, 80)}\n{words(2, 80)}"),
    ],
)
def test_articles_dont_overrule_the_density(page, want):
    got = html_text.main_text(page).split("\n")
    assert set(want.split("\n")) <= set(got)


SIDE_FREE = [
    ("<script src=a.js/>var x=1;</script><p>yes", "yes"),
    ("<p>a<button>b<p>c", "a\nc"),
    ("<p>a<svg>b<p>c", "ab\nc"),
    ('<article><p>x1 y<p class="alert">keep me<div id="search-methods">and me</div><section class="related-work">me too</section><p>E<math>=mc</math></article>', "x1 y\nkeep me\nand me\nme too\nE=mc"),
    ('<article><p>text<div class="cookie-notice">we use cookies</div><div class="comments"><p>first!</div><form><input><select><option>a</select></form></article>', "text"),
]


@pytest.mark.parametrize(("page", "want"), SIDE_FREE)
def test_only_side_elements_are_cut(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("page", ["<b>" * 16000 + "</i>" * 16000, "<b>" * 16000 + "<hr>" * 16000, "<b>" * 8000 + "<tr>" * 8000, "<body>" * 16000])
def test_unclosed_tags_cost_little(page):
    import time

    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 5


def test_density_by_hand():
    """The densities of a small page, each by its own formula from the element's text and tags."""
    from math import e, log

    page = f"<body><div id=x><h1>Head</h1><p>{words(1)} <a href=#>{words(2, 3)}</a></p><p>{words(3)}</p></div><div><a href=#>one</a> <a href=#>two</a></div></body>"
    tree = html_text.parse(page)
    density, total = html_text._densities(tree)

    def below(i):
        kids = [x for x in tree.parts[i] if isinstance(x, int)]
        return kids + [y for k in kids for y in below(k)]

    def chars(i, linked=False):
        own = 0 if linked and tree.tag[i] != "a" else 1
        if own and linked:
            return chars(i)
        return sum((len("".join(x.split())) if own else 0) if isinstance(x, str) else chars(x, linked) for x in tree.parts[i])

    for i in range(len(tree.tag)):
        c, lc, t = chars(i), chars(i, True), len(below(i))
        lt = sum(tree.tag[k] == "a" for k in [i, *below(i)])
        base = log(c / max(c - lc, 1) * lc + chars(0, True) / chars(0) * c + e)
        want = c / max(t, 1) * log(c / max(lc, 1) * max(t, 1) / max(lt, 1) + 1e-9) / log(base)
        assert density[i] == pytest.approx(max(want, 0)) and total[i] == pytest.approx(sum(density[x] for x in tree.parts[i] if isinstance(x, int)))
    assert html_text.main_text(page) == f"Head\n{words(1)} {words(2, 3)}\n{words(3)}"


def test_extraction_of_odd_tables(spark):
    rows = [(1, "u", "<p>a", "x", 9), (1, "u", "<p>a", "x", 9), (None, None, None, None, None), (2, "v", "", "y", 1), (3, None, "<article><p>" + "long " * 200_000, "z", 1)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert sorted(((r["page_id"] or 0), r["n_chars"]) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 0), (3, 999_999)]


HOSTILE = [
    "<a " * 400_000, "<a '" * 400_000, "<a b='" * 400_000, '<a x="1>2" ' * 100_000 + "b='", "<a b=>'" * 100_000, "<script>" + "</script" * 200_000, "</a " * 400_000, "<a" + " " * 400_000, "<!" * 400_000,
    "<div>" * 50_000 + "x", "<li>" * 40_000 + "<p>" * 40_000, "<i><div>" * 30_000 + "</i>" * 30_000, "<!--" * 300_000, "&" * 400_000, "<p" * 400_000,
]


@pytest.mark.parametrize("page", HOSTILE, ids=lambda p: p[:12])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 8


def test_tags_that_never_end():
    assert html_text.main_text("<p>a text</p><p>more <a href=x") == "a text\nmore <a href=x"
    assert html_text.main_text("<p>one <a title='it's'>two</a> don't three</p>") == "one two don't three"
    assert html_text.main_text("<p title='open>first</p><p>second</p>") == "first\nsecond"


def plain_roots(tree):
    """The choice of main text with every sum made anew from the parents alone."""
    n = len(tree.tag)
    cut = [False] * n
    for i in range(n):
        cut[i] = tree.side[i] or i > 0 and cut[tree.parent[i]]

    def above(i):
        while i >= 0:
            yield i
            i = tree.parent[i]

    below = [[j for j in range(n) if not cut[j] and i in above(j)] for i in range(n)]
    own = [sum(len("".join(x.split())) for x in tree.parts[i] if isinstance(x, str)) for i in range(n)]
    chars = [sum(own[j] for j in b) for b in below]
    linked = [sum(own[j] for j in b if any(tree.tag[k] == "a" and i in above(k) for k in above(j))) for i, b in enumerate(below)]
    tags = [len(b) - (i in b) for i, b in enumerate(below)]
    links = [sum(tree.tag[j] == "a" for j in b) for b in below]

    def density(i):
        if not chars[i]:
            return 0.0
        lc, t, lt = max(linked[i], 1), max(tags[i], 1), max(links[i], 1)
        base = math.log(chars[i] / max(chars[i] - linked[i], 1) * linked[i] + linked[0] / max(chars[0], 1) * chars[i] + math.e)
        worth = math.log(chars[i] / lc * t / lt + 1e-9) / (math.log(base) if base > 1 else 1)
        return max(0.0, chars[i] / t * worth)

    dense = [density(i) for i in range(n)]
    total = [sum(dense[j] for j in range(n) if tree.parent[j] == i) for i in range(n)]

    def best(i):
        """The container of the largest sum at or below a node, the outer one of equals."""
        inside = [j for j in below[i] if tree.tag[j] in html_text.CONTAINERS]
        return min(inside, key=lambda j: (-round(total[j], 9), len(list(above(j))), j)) if inside else i

    top = best(0)
    threshold = min([dense[j] for j in above(top) if dense[j] > 0] or [0.0])
    roots = {top}
    for i in range(n):
        if not cut[i] and dense[i] > 0 and dense[i] >= threshold - 1e-9:
            roots.add(best(i) if total[best(i)] > 0 else i)
    return roots


def page_without_names(draw):
    """Nested elements with text, links and lists; no article, no class, no id."""

    def block(depth):
        kind = draw.random()
        if depth > 3 or kind < 0.45:
            words = " ".join("".join(draw.choice("abcdefg") for _ in range(draw.randrange(2, 8))) for _ in range(draw.randrange(1, 60)))
            return f"<{(t := draw.choice(['p', 'p', 'h2', 'blockquote']))}>{words}</{t}>"
        if kind < 0.6:
            return "<ul>" + "".join(f"<li><a href=x>{draw.choice(['more', 'all news', 'page'])} {k}</a></li>" for k in range(draw.randrange(1, 8))) + "</ul>"
        t = draw.choice(["div", "section", "table"])
        inner = "".join(block(depth + 1) for _ in range(draw.randrange(1, 5)))
        return f"<{t}>{f'<tr><td>{inner}</td></tr>' if t == 'table' else inner}</{t}>"

    return "<html><body>" + "".join(block(0) for _ in range(draw.randrange(1, 6))) + "</body></html>"


def test_choice_of_main_text_by_brute_force():
    draw = random.Random(11)
    chosen = 0
    for _ in range(300):
        tree = html_text.parse(page_without_names(draw))
        roots = html_text._content(tree)
        openings = {k for i, r in enumerate(roots) if r and i and tree.tag[i] in html_text.CONTAINERS for k in html_text._openings(tree, i)}
        assert {i for i, r in enumerate(roots) if r} == plain_roots(tree) | openings
        chosen += not roots[0]
    assert chosen > 200


def test_title_beside_the_densest_container():
    text = "word and word. " * 40
    page = f"<body><ul><li><a href=a>Home</a></li><li><a href=b>All news</a></li></ul><div id=wrap><h1>Title of it</h1><p>By A. Writer</p><div class=content><p>{text}</p><p>{text}</p></div></div><div class=discussion><p>{text}</p></div></body>"
    assert html_text.main_text(page) == f"Title of it\nBy A. Writer\n{text.strip()}\n{text.strip()}"


# ---------------------------------------------------------------- licences


def test_licences_held_out(docs):
    lines = sorted({p for r in docs.collect() for p in (r["text"] or "").split("\n") if p})
    c = license_scan.fit(lines[:600])
    families = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0", "All rights reserved.": "proprietary"}
    right = total = 0
    for p in lines[600:] + list(families):
        got = license_scan.scan(p, c, c.anchors)
        total += 1
        right += ([g["family"] for g in got] or [None])[0] == families.get(p)
    assert right == total
    around = "thing of licensed under the apache license version 2.0 and more"
    assert [g["family"] for g in license_scan.scan(f"x\n{around}\n\nfoo", c, c.anchors)] == ["apache-2.0"]
    assert [g["family"] for g in license_scan.scan("released under the zebra license version 7", c, c.anchors)] in ([], ["unknown"])
    assert license_scan.scan(None, c, c.anchors) == license_scan.scan("", c, c.anchors) == []


def test_wrapped_and_several_licences(docs):
    lines = sorted({p for r in docs.collect() for p in (r["text"] or "").split("\n") if p})
    c = license_scan.fit(lines[:600])

    def found(text):
        return [(g["paragraph"], g["family"]) for g in license_scan.scan(text, c, c.anchors)]

    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that"
    assert found(f"title\n\n{bsd}\n") == [(2, "bsd")]
    filler = " ".join(f"thing{i}" for i in range(80))
    names = ["Released under the MIT License", "licensed under the Apache License, Version 2.0", "released under the GNU GPL version 3", "licensed under CC BY-NC 4.0", "licensed under the Mozilla Public License version 2.0"]
    assert found(f" {filler} ".join(names)) == [(0, f) for f in ("mit", "apache-2.0", "gpl-3.0", "cc-by-nc-4.0", "mpl-2.0")]
    assert found("Released under the MIT License and the Apache License 2.0") == [(0, "mit"), (0, "apache-2.0")]
    assert found("Licensed under the\nMIT license\nLicensed under the MIT\nlicense") == [(0, "mit"), (2, "mit")]
    assert found("This work is licensed under the GNU Lesser General Public License, version 3.") == [(0, "lgpl-3.0")]
    assert found("Licensed under the GNU Affero General Public License version 3") == [(0, "agpl-3.0")]


def test_skipped_paragraphs_have_no_feature(docs):
    """The search by anchors gives what scoring every paragraph gives."""
    c = license_scan.fit(["some words of text", "other words here"])
    for r in docs.collect():
        for p in (r["text"] or "").split("\n"):
            w = license_scan.tokens(p)
            if c.anchors.isdisjoint(w):
                assert not [g for g in license_scan._grams(w) if g in c.features]


def test_licence_rows(docs):
    got = license_scan.scan_documents(docs).collect()
    assert len(got) == docs.count() and all(r["found"] == [] for r in got if r["id"] in (900001, 900002))
    assert license_scan.scan_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("All rights reserved seats are in row five.", []),
        ("Copyright 2020 Foo. All rights reserved.", ["proprietary"]),
        ("Distributed under the Boost Software License version 1.0", ["unknown"]),
        ("Licensed under the Frobnicate License version 3.1", ["unknown"]),
        ("Licensed under the Apache License,\nVersion 2.0.", ["apache-2.0"]),
        ("He is licensed to drive a car under the law of the land.", []),
        ("some text " * 50_000 + "\nReleased under the MIT License.\n\n" + "more words " * 50_000, ["mit"]),
    ],
)
def test_known_and_unknown_notices(text, want):
    c = classifier()
    assert [g["family"] for g in license_scan.scan(text, c, c.anchors)] == want


@functools.cache
def classifier():
    return license_scan.fit(sorted({p for (t,) in duckdb.sql(f"select text from '{DATA}/documents.parquet' where text is not null").fetchall() for p in t.split("\n") if p})[:600])


def test_unknown_licences_held_out():
    """Names that the training never saw, in forms that it did and did not see."""
    c = classifier()
    notices = [form.format(name) for name in ("quokka", "blue river source", "tandem community") for form in ("Licensed under the {} license.", "Released under the {} license version 2.", "This work is licensed under the {} license version 1.1", "Use of this file is governed by the {} license.")]
    found = [[g["family"] for g in license_scan.scan(n, c, c.anchors)] for n in notices]
    assert sum(f == ["unknown"] for f in found) >= 0.8 * len(found)


def test_probabilities_against_plain_sums():
    c = classifier()
    for text in ("released under the mit license", "licensed under the apache license version 2.0 and more", "use of this source code is governed by the elastic license", "plain words only", "under the"):
        w = license_scan.tokens(text)
        grams = {" ".join(w[i:j]) for i in range(len(w)) for j in (i + 2, i + 3) if j <= len(w)}
        z = [(c.bias[k] + sum(c.weights[c.features[g], k] for g in grams if g in c.features)) / c.temperature for k in range(len(license_scan.FAMILIES))]
        e = [math.exp(v - max(z)) for v in z]
        assert c.probabilities(w) == pytest.approx([v / sum(e) for v in e])


def test_scan_of_odd_tables(spark):
    rows = [(1, "Released under the MIT License.", "x", 1), (1, "Released under the MIT License.", "x", 1), (None, None, None, None), (2, "", "y", 1)]
    got = license_scan.scan_documents(spark.createDataFrame(rows, "doc_id long, text string, family string, found int")).collect()
    assert sorted((r["id"] or 0, [g["family"] for g in r["found"]]) for r in got) == [(0, []), (1, ["mit"]), (1, ["mit"]), (2, [])]


# ---------------------------------------------------------------- quality


FLOORS = np.array([0.08, 0.05, 0.15, 0.13]) * 65536


def estimated(core):
    return core.mean(axis=0), 1.487 * np.cov(core.T, bias=True).reshape(4, 4) + np.diag(FLOORS**2)


def far(rows, mean, cov):
    off = rows - mean
    return (off * np.linalg.solve(cov, off.T).T).sum(axis=1)


def from_every_start(m):
    """(half the logarithm of the determinant, mean, covariance) that each start leads to."""
    w = FLOORS / 64
    middle = np.array([next(k for k in sorted(set(col)) if 2 * (col <= k).sum() >= len(col)) for col in np.floor(m / w).T])
    off = ((m - (middle + 0.5) * w) / FLOORS) ** 2
    found = []
    for d2 in (off.sum(axis=1), far(m, *estimated(m)), off.max(axis=1)):
        before = None
        for _ in range(quality.MOST_STEPS):
            cell = np.floor(np.log(1 + d2) * 256)
            edge = next(k for k in sorted(set(cell)) if (cell <= k).sum() >= 0.75 * len(cell))
            mean, cov = estimated(m[cell <= edge])
            if before is not None and np.array_equal(before, cov):
                break
            before, d2 = cov, far(m, mean, cov)
        found.append((np.linalg.slogdet(cov)[1] / 2, mean, cov))
    return found


def test_verdicts_against_numpy(spark, docs):
    """The estimates anew, in NumPy, from the counts."""
    many = docs.select("doc_id", "text", "lang", "source").unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id") + 5_000_000, "text", "lang", F.when(F.col("doc_id") % 3 > 0, "web").otherwise(F.col("source"))).toDF("doc_id", "text", "lang", "source"))
    found = many.select(F.monotonically_increasing_id().alias("row"), "lang", "source").collect()
    place = {r["row"]: (r["lang"], r["source"]) for r in found}
    rows = [r for r in quality.judged(many).collect()]
    assert len(rows) == len(place)
    good = [r for r in rows if not r["base_failed"]]
    n, c, s, ln, dup, rep = (np.array([r[k] for r in good], float) for k in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"))
    x = np.floor(np.stack([np.log((c + 1) / (n + 1)), np.sqrt(s / (c + 1)), np.sqrt(dup / (ln + 1)), np.sqrt(rep / (n + 1))], 1) * 65536 + 0.5)
    pairs = [place[r["row"]] for r in good]
    by_lang, by_pair = Counter(p[0] for p in pairs), Counter(pairs)

    judged_by = [("p", p) if by_pair[p] >= 100 else ("l", p[0]) if by_lang[p[0]] >= 100 else ("a",) for p in pairs]
    known = {}
    for who in set(judged_by):
        members = np.array([who[0] == "a" or (who[0] == "l" and who[1] == p[0]) or (who[0] == "p" and who[1] == p) for p in pairs])
        _, mean, cov = min(from_every_start(x[members]), key=lambda f: round(f[0], 9))
        known[who] = far(x, mean, cov)
    for i, r in enumerate(good):
        want = known[judged_by[i]][i]
        assert r["distance2"] == pytest.approx(want, rel=1e-6, abs=1e-9) and r["kept"] == (want <= quality.CUTOFF)
    assert {w[0] for w in judged_by} >= {"p", "l"} and any(r["kept"] for r in good) and not all(r["kept"] for r in good)


def test_the_least_determinant_stays(spark):
    """Three clusters, from which the starts lead to different cores; each start is best somewhere or ties."""
    rows, want = [], {}
    for seed in (0, 2, 15, 18):
        g = np.random.default_rng(seed)
        n, a = 200, int(g.integers(90, 130))
        b = (n - a) // 2
        parts = [g.normal(0, 1, (a, 4)) * g.uniform(0.2, 3, 4)]
        parts += [g.normal(0, 1, (k, 4)) * g.uniform(0.2, 3, 4) + g.normal(0, 8, 4) for k in (b, n - a - b)]
        m = np.floor(np.concatenate(parts) * FLOORS)
        found = from_every_start(m)
        assert max(f[0] for f in found) - min(f[0] for f in found) > 0.05
        want[f"s{seed}"] = min(found, key=lambda f: round(f[0], 9))[1]
        rows += [(1000 * seed + i, f"s{seed}", *map(int, x)) for i, x in enumerate(m)]
    got = quality._concentrated(spark.createDataFrame(rows, "__row long, stratum string, x1 long, x2 long, x3 long, x4 long"), F.broadcast).collect()
    assert {r["stratum"] for r in got} == set(want)
    for r in got:
        assert [r[f"x{i}m"] for i in (1, 2, 3, 4)] == pytest.approx(want[r["stratum"]].tolist())


def ordinary(draw, n=120):
    return "\n".join(" ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 9))) for _ in range(12)) for _ in range(n // 12))


def test_every_coordinate_can_reject_alone(spark):
    draw = random.Random(4)
    rows = [(i, ordinary(draw), "en", "web") for i in range(150)]
    line = ordinary(draw, 12)
    half = ordinary(draw, 60)
    planted = {
        "x1": " ".join("k" * draw.randrange(24, 30) + str(i) for i in range(120)),
        "x2": " ".join(w + "##%" for w in ordinary(draw).split()),
        "x3": "\n".join([*["one two three"[: 3 + 4 * (i % 3)] for i in range(60)], *ordinary(draw, 240).split("\n")]),
        "x4": " ".join([*half.split()[:28], *ordinary(draw, 60).split(), *half.split()[:28]]),
    }
    rows += [(1000 + i, t, "en", "web") for i, t in enumerate(planted.values())]
    got = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(got[i]["kept"] for i in range(150)) >= 148 and line
    for i, name in enumerate(planted):
        r = got[1000 + i]
        assert not r["base_failed"] and not r["kept"], name


def test_strata_of_odd_names_stay_apart(spark):
    """Null is no name, and languages and sources don't run into each other."""
    draw = random.Random(9)
    names = [(None, None), ("?", "?"), ("x/y", "z"), ("x", "y/z"), ("", ""), ("none", "none"), ("all", None)]
    rows = [(1000 * k + i, " ".join(w * (k + 1) for w in ordinary(draw).split()), lang, source) for k, (lang, source) in enumerate(names) for i in range(110)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    together = {r["doc_id"]: r["distance2"] for r in quality.judged(docs).collect()}
    for k in range(len(names)):
        alone = quality.judged(docs.where((F.col("doc_id") >= 1000 * k) & (F.col("doc_id") < 1000 * k + 1000))).collect()
        assert all(together[r["doc_id"]] == pytest.approx(r["distance2"], rel=1e-9) for r in alone)


def test_each_row_is_kept_or_rejected_by_itself(spark):
    fine = plain_text(3)
    rows = [(None, "too short"), (None, fine), (7, "too short"), (7, fine), (7, fine)]
    docs = spark.createDataFrame([(i, t, "en", "web", 1) for i, t in rows], "doc_id long, text string, lang string, source string, row int")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0, r["text"] == fine) for r in kept.collect()) == [(0, True), (7, True), (7, True)]


def statistics(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, docs):
    extra = spark.createDataFrame([(1, "a b c a b c a"), (2, " \x0b"), (3, "é #\n\né #\n "), (4, "a b " * 40000), (5, "a b c")], "doc_id long, text string")
    for frame in (docs.select("doc_id", "text"), extra):
        texts = {(r["doc_id"], r["text"]) for r in frame.collect()}
        got = Counter((r["doc_id"], *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) for r in quality.base_statistics(frame).collect())
        assert set(got) == {(i, *statistics(t)) for i, t in texts}


def test_verdicts(spark, docs):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = quality.judged(docs).collect()
    assert len(got) == docs.count()
    passed = [r for r in got if not r["base_failed"] and r["doc_id"] in labels]
    assert all(r["kept"] == bool(labels[r["doc_id"]]) for r in passed) and not any(r["kept"] for r in got if r["base_failed"])
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.judged(docs.limit(0)).count() == 0 and quality.judged(docs.where("doc_id = 900002")).first()["kept"] is False


def plain_text(k, n=120):
    return "\n".join(" ".join(f"word{k * 7919 % 997}{chr(97 + (k + i + j) % 26)}{i + j}" for j in range(12)) for i in range(0, n, 12))


def test_rows_of_small_strata_are_judged_by_all_rows_of_their_language(spark):
    junk = " ".join(f"#{i}#$" for i in range(100))
    rows = [(k, plain_text(k), "en", "big") for k in range(300)]
    rows += [(1001, junk, "en", "new"), (1002, junk, "en", None), (1003, junk, None, None), (1004, junk, "rare", "big")]
    rows += [(2001, plain_text(11), "en", "other"), (2002, plain_text(12), None, None)]
    got = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows) and not any(r["base_failed"] for r in got.values())
    assert {i for i, r in got.items() if not r["kept"]} == {1001, 1002, 1003, 1004}


# ---------------------------------------------------------------- language model


def test_model_against_plain_counting(spark, docs, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = list(dict.fromkeys(rows)) + [(900004, rows[[i for i, _ in rows].index(900004)][1])]
    tokens = [[*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    count, pairs = Counter(), Counter()
    for t, h in zip(tokens, held, strict=True):
        if not h:
            count.update(t)
            pairs.update(zip(["<s>", *t], t, strict=False))
    n, v = sum(count.values()), len(count)
    total, seen, after = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
    for (a, b), k in pairs.items():
        total[a] += k
        seen[a][min(k, 3) - 1] += 1
        after[b] += 1
    levels, words_ = Counter(pairs.values()), Counter(after.values())
    d, e = (ngram_lm.discounts(*(x[k] for k in (1, 2, 3, 4))) for x in (levels, words_))
    rest = sum(e[min(k, 3) - 1] for k in after.values()) / len(pairs)

    def low(w):
        return (max(after[w] - e[min(after[w], 3) - 1], 0) / len(pairs) if after[w] else 0) + rest / (v + 1)

    def p(a, w):
        if not total[a]:
            return low(w)
        k = pairs[a, w]
        return (max(k - d[min(k, 3) - 1], 0) / total[a] if k else 0) + sum(x * y for x, y in zip(d, seen[a], strict=True)) / total[a] * low(w)

    for a in ("<s>", "the", "of"):
        assert abs(sum(p(a, w) for w in count) + p(a, "\0") - 1) < 1e-9
    want = sorted((i or -1, h, len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 4), round(sum(math.log10(p(a, w)) for a, w in zip(["<s>", *t], t, strict=False)), 4)) for (i, _), t, h in zip(rows, tokens, held, strict=True))
    got = sorted((r["id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 4)) for r in ngram_lm.score_documents(docs).collect())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 2e-3 and abs(g[6] - w[6]) < 2e-3


def test_model_without_training_texts(spark):
    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = ngram_lm.score_documents(spark.createDataFrame([(one, "a b")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(one, True, 3, 0, 0, 0.0, 0.0)]
    assert ngram_lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_only_mounted_folders():
    assert ngram_lm.local_path("file:///a/b") == "/a/b" and ngram_lm.local_path("/c") == "/c"
    with pytest.raises(ValueError):
        ngram_lm.local_path("hdfs://x/y")


# ---------------------------------------------------------------- SQL


@pytest.mark.parametrize("name", sorted(llm_queries.ORACLES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = llm_queries.QUERIES[name](spark, DATA)
    cur = con.execute(llm_queries.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    assert sorted(map(str, (tuple(r[c] for c in order) for r in df.collect()))) == sorted(map(str, (tuple(r[columns.index(c)] for c in order) for r in cur.fetchall())))


# ---------------------------------------------------------------- empty tables and tables without words


def test_nothing_to_mix_or_pack(spark, docs):
    blank = docs.where("doc_id in (900001, 900002)")
    assert mixing.mix(docs.limit(0)).count() == mixing.mixed(docs.limit(0)).count() == packing.pack(docs.limit(0)).count() == 0
    assert [(r["size"], r["taken"], r["target"]) for r in mixing.mix(blank).collect()] == [(0, 0, 0.0)] * 2
    assert mixing.mixed(blank).count() == 0 and [r["bin"] for r in packing.pack(blank).collect()] == [None, None]
    assert html_text.extract(spark.createDataFrame([(None, None, None)], "page_id long, url string, html string")).first()["n_chars"] == 0
