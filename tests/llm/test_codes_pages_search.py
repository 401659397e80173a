"""Vector codes, main texts and ranked search: brute force, planted pages, and the odd rows that each defines a result for."""

import hashlib
import html
import math
import random
import re

import numpy as np
import pytest

from corvane.llm import impact_bits, main_text, vector_codes
from corvane.llm.common import table

from ..conftest import DATA
from .test_llm import odd_texts

# 11: vector codes


def full_scan(points, entries):
    away = ((points[:, None, :].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
    return [min(range(len(entries)), key=lambda i: (row[i], i)) for row in away], [int(min(row)) for row in away]


@pytest.mark.parametrize("spread", [2, 40, 2**20, 2**27])
@pytest.mark.parametrize("width", [0, 1, 3, 16])
def test_nearest_as_a_full_scan(spread, width):
    rng = np.random.default_rng(width + spread)
    for n in (1, 5, 17, 120):
        entries = rng.integers(-spread, spread, (n, width), endpoint=True)
        entries[n // 2 :] = entries[: n - n // 2]  # equal entries: the lower index is to be found
        points = np.concatenate([rng.integers(-spread, spread, (60, width), endpoint=True), entries, (entries[:1] + entries[-1:]) // 2])
        found, away = vector_codes.Tree.of(entries).nearest(points)
        assert (found.tolist(), away.tolist()) == full_scan(points, entries)


def brute_codes(rows):
    """As the operator's contract says it, by full scans; rows of (vec_id, vector, label)."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((i, v) for i, v, _ in kept if i is not None)[:256]
    width = len(first[0][1])
    first = [v for _, v in first if len(v) == width]
    books, cuts = [], [(p * width // 4, (p + 1) * width // 4) for p in range(4)]
    for a, b in cuts:
        book = [v[a:b] for v in first]
        for _ in range(4):
            sums = {}
            for _, v, _ in kept:
                if len(v) == width:
                    e = min(range(len(book)), key=lambda e: (sum((x - y) ** 2 for x, y in zip(v[a:b], book[e], strict=True)), e))
                    sums.setdefault(e, []).append(v[a:b])
            book = [[sum(c) // len(sums[e]) for c in zip(*sums[e], strict=True)] if e in sums else x for e, x in enumerate(book)]
        books.append(book)
    out, by_label = [], {}
    for i, v, label in kept:
        code, error = None, None
        if len(v) == width:
            away = [min((sum((x - y) ** 2 for x, y in zip(v[a:b], entry, strict=True)), e) for e, entry in enumerate(book)) for (a, b), book in zip(cuts, books, strict=True)]
            code, error = "".join(f"{e:02x}" for _, e in away), sum(d for d, _ in away)
            by_label[label] = by_label.get(label, 0) + error
        out.append((i, code, error, label))
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted(((i, code, error, by_label.get(label), sha) for i, code, error, label in out), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, code string, n long, error double"


@pytest.mark.parametrize("width, n", [(8, 300), (6, 40), (70, 12)])
def test_codes_brute_force(spark, width, n):
    rng = random.Random(width)
    vector = lambda: [rng.choice([rng.gauss(0, 1), -0.5, 0.25]) for _ in range(width)]
    rows = [(i, vector(), None if i % 7 == 0 else i % 3) for i in range(n)]
    rows += [(n + i, rows[i][1], 1) for i in range(9)] + [(3, vector(), 2), (None, vector(), 1), (None, None, 1)]
    rows += [(900, None, 1), (901, [None] * width, 1), (902, [float("nan")] * width, 1), (903, [float("-inf")] + [0.0] * (width - 1), 1), (904, [1.0], 5), (905, [], None)]
    df = spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], VECTORS).repartition(5)
    got = sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in vector_codes.codes(spark, df).collect()), key=repr)
    assert got == brute_codes(rows)


def test_codes_empty_and_many_labels(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 5)] * 4, i % 9) for i in range(90)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.codes(spark, df.limit(0)).count() == 0
    want = sorted(map(tuple, vector_codes.codes(spark, df).collect()))
    monkeypatch.setattr(vector_codes, "MOST_LABELS", 2)
    assert sorted(map(tuple, vector_codes.codes(spark, df).collect())) == want


def test_codes_of_huge_components(spark):
    df = spark.createDataFrame([(0, [3e38] * 4, 1), (1, [-3e38] * 4, 1), (2, [0.0] * 4, 1)], "vec_id long, embedding array<float>, label int")
    rows = vector_codes.codes(spark, df).collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in rows) == [(0, "00000000", 0), (1, "01010101", 0), (2, "02020202", 0)]


# 12: main texts

SENTENCE = "Some words of a paragraph that is long enough to be read as text by anyone, with a stop. "


def plain_article(page):
    """The given pages' articles are known by their tag; their blocks are p, h1 and br."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner) if x.strip())


def test_given_pages(spark):
    pages = {r["page_id"]: r for r in table(spark, DATA, "pages").collect()}
    got = {r["page_id"]: r for r in main_text.extract(table(spark, DATA, "pages")).collect()}
    assert got.keys() == pages.keys()
    for i, r in got.items():
        want = plain_article(pages[i]["html"])
        assert (r["url"], r["text"], r["n_chars"]) == (pages[i]["url"], want, len(want))


def test_given_pages_without_names(spark):
    """No element says what it is: lengths of lines and the tree alone find the text, where it is far longer than the notices beside it."""
    for page in (r["html"] for r in table(spark, DATA, "pages").collect()):
        want = plain_article(page)
        if len(want) > 1000:
            assert main_text.main_text(re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", page).replace(' class="ad"', "")) == want


P, LONG = SENTENCE, SENTENCE * 3
PLANTED = {
    "semantic": (
        f"<html><head><title>T</title></head><body class='has-sidebar'><header><h1>Site</h1>{P}</header><div id='cookie-notice'>{LONG}</div><main><article class='post'><header><h1>Head</h1></header>"
        f"<p>{P}</p><aside>{P}</aside><p>Sh<b>or</b>t.</p><form><label>{P}</label><input></form><table><tr><td>a<td>b</table><ul><li>one<li>two</ul><p class='ad'>buy<p>{P}</p>"
        f"<p>End &lt;p&gt; &amp; &#233;&nbsp;x.</p><p><a href=x>Source</a></p><section id='comments'><h2>Comments</h2><article class='comment'>{LONG}</article></section></article><div class='sidebar'>{P}</div></main><footer>{P}</footer>",
        f"Head {P}Short. a b one two {P}End <p> & é x. Source",
    ),
    "open tags": (f"<body><div class=menu><a href=x>{P}</a></div><h1>Head</h1><p>{P}<p>{P}<p>End.<div id=footer>{P}</div><!-- {P} <p> --><script>if (a<b) '</p>' {P}</script>", f"Head {P}{P}End."),
    "odd name": (f"<div class='ad-content'>{LONG}</div>", LONG),
    "tables": (f"<body><div><a href=1>a</a> <a>b</a></div><table><tr><td><ul><li><a>x x x</a></ul></td><td><h2>T</h2><p>{LONG}</p><p>{P}</p><p>Fin</p></td></tr></table><div>(c) me</div>", f"T {LONG}{P}Fin"),
    "two columns": (f"<body><div><div>{'<p>News in brief.</p>' * 3}</div><div><p>Intro</p>{f'<p>{LONG}</p>' * 4}<p>Last.</p></div><div>{P}</div></div>", f"Intro {LONG * 4}Last."),
    "page in a form": (f"<body><form id='aspnetForm'><div class='site-header'>{P}</div><div class='content'><h1>T</h1><p>{LONG}</p><p>{LONG}</p><p>End.</p></div><div class='cookieBar'>{P}</div></form>", f"T {LONG}{LONG}End."),
    "headers": (f"<div id='header'>{P}</div><article class='has-sidebar'><div class='header'><h1>T</h1></div><p>{P}</p><form class='post'>{P}</form></article>", f"T {P}"),
    "menu inside": (f"<article><p>{LONG}</p><ul>{'<li><a href=x>Item</a></li>' * 5}</ul><p>{P}</p></article>", f"{LONG}{P}"),
    "no markup": ("plain  text\nonly", "plain text only"),
    "attributes": ("<article><p title='a>b' data-x=\"</p>\">x</p><p hidden>y</p><p style='display: none'>z</p></article>", "x"),
    "nothing": ("<p> <br></p>", ""),
    "unclosed comment": (f"<p>{P}</p><!-- {P}", P),
    "scripts only": ("<script>var x = 1;</script><style>p{}</style>", ""),
}


@pytest.mark.parametrize("name", PLANTED)
def test_planted_pages(name):
    source, want = PLANTED[name]
    assert main_text.main_text(source) == " ".join(want.split())


def test_surge_and_dive():
    assert main_text.stretches([0, 5, 0, 0, 0, 90, 40, 0, 60, 0, 0, 0, 3, 0, 200, 0]) == [(5, 6), (12, 14)]
    assert main_text.stretches([3, 4]) == [(0, 1)]
    assert main_text.stretches([0, 0]) == main_text.stretches([]) == []


def test_pages_odd_rows(spark):
    rows = [(1, "u", None, "x"), (None, None, "<p>a</p>", "x"), (2, "u", "", "x"), (2, "u", "<p>a</p>", "x"), (2, "u", "<p>a</p>", "x"), (3, "v", "<div>" * 5000 + "<p>w" * 20000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"], r["text"][:3], r["n_chars"]) for r in main_text.extract(df).collect()), key=repr)
    assert got == sorted([(1, "", 0), (None, "a", 1), (2, "", 0), (2, "a", 1), (2, "a", 1), (3, "w w", 39999)], key=repr)
    assert main_text.extract(df.limit(0)).count() == 0


# 13: ranked search

def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute_search(docs, items, k):
    texts = [(i, words_of(t)) for i, t in docs]
    texts = [(i, w) for i, w in texts if w]
    n, length = len(texts), sum(len(w) for _, w in texts)
    df = {}
    for _, w in texts:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(words_of(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, w in texts:
            m = 50 + 50 * len(w) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in terms if t in w)
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"SHARD_DOCS": 7, "GROUP_ITEMS": 3, "GROUP_TERMS": 5, "BLOCK_PAIRS": 20}, {"SHARD_POSTINGS": 10, "SHARD_DOCS": 130}])
def test_search_brute_force(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(impact_bits, name, value)
    rng = random.Random(13)
    docs = list(enumerate([*odd_texts(), *odd_texts(5)[13:], *["alpha beta alpha"] * 9, "Alpha-BETA_0 9é", "don't 한국어,한국어 \x7fÀB"]))
    docs += [(None, "alpha beta gamma"), (4, "gamma gamma"), (4, "gamma")]
    items = [(i, " ".join(rng.choices("alpha beta gamma delta Epsilon zeta unheard 한국어 don é".split(), k=rng.randint(0, 9)))) for i in range(20)]
    items += [(3, "mu nu"), (None, "alpha"), (50, None), (51, ""), (52, "nowhere"), (53, docs[6][1])]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, score long, n long").repartition(3)
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, rank string")
    for k in (5, 50):
        assert sorted(map(tuple, impact_bits.ranked(spark, frame, asked, k).collect())) == brute_search(docs, items, k)
    assert impact_bits.ranked(spark, frame.limit(0), asked).count() == impact_bits.ranked(spark, frame, asked.limit(0)).count() == 0


def test_carries_and_slices():
    rng = np.random.default_rng(2)
    for trial in range(30):
        docs, terms = int(rng.integers(1, 200)), int(rng.integers(1, 12))
        dense = rng.integers(0, 2 ** rng.integers(1, 40), (terms, docs)) * rng.integers(0, 2, (terms, docs))
        term, doc = np.nonzero(dense)
        ids_of = rng.permutation(docs) * 3
        shard = impact_bits.Shard(ids_of, doc, term, dense[term, doc])
        items = [np.sort(rng.choice(terms, rng.integers(1, terms + 1), replace=False)) for _ in range(6)]
        for k in (1, 4, 1000):
            item, ids, score = shard.best(items, k)
            for i, which in enumerate(items):
                want = sorted((-int(s), int(d)) for s, d in zip(dense[which].sum(axis=0), ids_of, strict=True) if s > 0)[:k]
                assert [(-int(s), int(d)) for s, d in zip(score[item == i], ids[item == i], strict=True)] == want
