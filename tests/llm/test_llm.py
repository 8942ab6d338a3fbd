"""Operators on training text against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assaysift.llm import bpe, decontaminate, html, licenses, lines, minhash, quality, topk, urls, warc
from assaysift.llm.graph import components

VOCABULARY = [f"w{i}" for i in range(400)]
PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, doc string, text2 string"


def _corpus():
    rng = np.random.default_rng(5)
    rows = [(None, None), (0, None), (1, ""), (2, " \n\t"), (3, "Just three words"), (4, "just THREE words"), (None, "no id")]
    base = [" ".join(rng.choice(VOCABULARY, 120)) for _ in range(6)]
    at = 10
    for text in base:
        for edits in (0, 0, 1, 2, 3, 4, 6):
            words = text.split()
            for i in rng.choice(len(words), edits, replace=False):
                words[i] = f"x{rng.integers(10**9)}"
            rows.append((at, " ".join(words)))
            at += 1
    shared = "A line that many of the documents hold, long enough to be counted"
    for i in range(8):
        rows.append((at, f"own {at}\n  {shared.upper() if i % 2 else shared} \nshort\n{'é' * 39}\n{'ü' * 40}\nown tail {at}\n{shared}"))
        at += 1
    rows.append((at, " ".join(rng.choice(VOCABULARY, 30_000))))
    rows += [rows[12], rows[12]]
    return rows


@pytest.fixture(scope="module")
def rows():
    return _corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", None) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", _lower(text)) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_components_of_a_long_path_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(7, 7), (None, 3), (50, 50)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(100, 161)} == {100} and {found[i] for i in range(1, 40)} == {1} and found[50] == 50


@pytest.mark.parametrize(("num", "den", "block"), [(85, 100, 128), (80, 100, 2)])
def test_near_duplicates(docs, rows, num, den, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
    sets = {i: _shingles(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and den * both >= num * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    want = Counter((i, len(_shingles(t)), None if i is None else top(i), i is None or top(i) == i) for i, t in rows)
    assert Counter(tuple(r) for r in minhash.near_duplicates(docs, num, den).collect()) == want


def test_signature_estimates_similarity():
    a, b = np.arange(900, dtype=np.uint64), np.arange(100, 1000, dtype=np.uint64)
    s = minhash.circulant_signature(np.concatenate((a, b)), np.array([0, 900]), 2000)
    assert abs((s[:, 0] == s[:, 1]).mean() - 0.8) < 0.04


def test_lines(docs, rows):
    key = lambda line: _lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                holders[key(line)].add(i)
    want = Counter()
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if i is None or len(holders[key(x)]) < 5 or i == max(holders[key(x)])]
        want[i, len(all_), len(all_) - len(kept), "\n".join(kept)] += 1
    assert sum(n for (_, _, dropped, _), n in want.items() if dropped) >= 7
    got = lines.dedup_lines(docs).select("row.doc_id", "lines.*").collect()
    assert Counter(tuple(r) for r in got) == want
    kept = lines.drop_common_lines(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_encoding_and_decoding(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(bpe, "HEAD_WORDS", 100)
    tokenizer = Tokenizer.from_file(PATH)
    odd = "x<|endoftext|>y <|ENDOFTEXT|> '''s 12a34 don't ΑΣ ΑΣ. İstanbul é J̌ \x1c a\x1db 漢字 ǅ ͸ ½"
    texts = spark.createDataFrame([(i, t) for i, t in rows] + [(900, odd)], "doc_id long, text string")
    want = Counter()
    for i, t in [*rows, (900, odd)]:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(ids), tokenizer.decode(ids, skip_special_tokens=False)] += 1
    encoded = bpe.encode(texts, PATH)
    assert Counter((r[0], tuple(r[1]), r[2]) for r in bpe.decode(spark, encoded, PATH).collect()) == want
    digest = lambda b: hashlib.sha256(b).hexdigest()
    got = Counter(tuple(r) for r in bpe.round_trip_digests(spark, encoded, PATH).collect())
    assert got == Counter({(i, len(x), digest(np.array(x, "<u4").tobytes()), digest(d.encode())): n for (i, x, d), n in want.items()})


def test_licenses(spark):
    texts = [
        "CC-BY and cc by, CC  BY. ccby",
        "Released under teh MIT Licence, all rights reserved",
        "This work is licensed under the GNU General Public License, version 3.",
        None,
        "",
        "nothing of the kind " * 4000,
        "Licensed under the Apache License, Version 2.0" + " pad" * 20000 + " All Rights Reserved.",
    ]
    scanned = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["doc_id"]: r for r in licenses.summary(scanned).collect()}
    assert (got[0]["n_words"], got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["labels"]) == (8, 3, 0, 5, "cc-by")
    assert got[1]["base_labels"] == "reserved" and got[1]["labels"] == "mit,reserved"
    assert got[2]["labels"] == "gpl,gpl-3.0" and got[2]["score"] == 1.0
    assert got[3]["n_words"] == 0 and got[3]["labels"] == "" and got[3]["first_word"] is None and got[3]["score"] == 0
    assert got[5]["score"] == 0 and got[6]["labels"] == "apache-2.0,reserved" and got[6]["last_word"] == 20008
    span = licenses.spans(scanned).filter("doc_id = 1 and not base").first()
    assert span["matched"] == "Released under teh MIT Licence" and 0 < span["edits"] <= 3


def test_every_notice_within_its_edits_is_found():
    """Pigeonhole: whatever the edits, the piece that stays leads to the place."""
    rng = np.random.default_rng(1)
    search = licenses.Searcher(licenses.NOTICES)
    for notice in licenses.NOTICES:
        for _ in range(20):
            text = list(notice)
            for i in rng.choice(np.arange(1, len(text) - 1), licenses.edits_allowed(notice), replace=False):
                text[i] = "q"
            assert search.search(f" before {''.join(text)} after ")


def test_adjacent_notices_of_unequal_edits_are_all_found(spark):
    """A better notice behind an edited one, of the same or a similar kind, does not hide it."""
    search = licenses.Searcher(licenses.NOTICES).search
    two, three = (f"licensed under the gnu general public license version {i}" for i in (2, 3))
    edited = two.replace("licensed", "lisenced")
    assert [(x[0], x[3]) for x in search(f" {edited} {three} x ")] == [("gpl-2.0", 2), ("gpl-3.0", 0)]
    assert [(x[0], x[3]) for x in search(f" {edited} {edited} {two} {edited} ")] == [("gpl-2.0", n) for n in (2, 2, 0, 2)]
    rng = np.random.default_rng(6)
    for notice, label in licenses.NOTICES.items():
        text, k = "", licenses.edits_allowed(notice)
        for n in range(k, -1, -1):  # each better than the one before
            chars = list(notice)
            for i in rng.choice([i for i in range(1, len(chars) - 1) if chars[i] != " "], n, replace=False):
                chars[i] = "q"
            text += " " + "".join(chars)
        assert [x[0] for x in search(f"{text} ")] == [label] * (k + 1), notice
    table = spark.createDataFrame([(1, f"{edited} {three}.")], "doc_id long, text string")
    assert licenses.summary(licenses.scan(table)).first()["labels"] == "gpl,gpl-2.0,gpl-3.0"


def test_contamination(spark):
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(rng.choice(VOCABULARY, n))
    items = [(i, word(30)) for i in range(5)] + [(5, "too short"), (6, None), (None, word(20)), (0, None)]
    edited = items[1][1].split()
    for i in (4, 11, 18, 25):
        edited[i] = "changed"
    rows = [(i, word(200)) for i in range(40)]
    rows += [(100, f"{word(50)}. {items[0][1].upper()}! {word(50)}"), (101, f"{word(9)} {' '.join(edited)} {word(9)}")]
    rows += [(102, items[2][1]), (102, items[2][1]), (103, None), (104, ""), (None, items[3][1]), (105, word(30_000) + " " + items[4][1])]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_contamination(table, bench).collect()}
    assert set(got) == {(100, 0), (101, 1), (102, 2), (105, 4)}
    assert got[100, 0]["score"] == 1 and got[100, 0]["first_word"] == 50 and got[100, 0]["n_words"] == 30
    assert got[101, 1]["score"] == pytest.approx((26 * 2 - 4) / 60) and got[101, 1]["first_word"] == 9
    kept = decontaminate.drop_contaminated(table, bench)
    assert kept.columns == table.columns and kept.count() == len(rows) - 5


def _damaged(rng, words, kind):
    """Return a copy of ``words`` with edits of a kind."""
    out = list(words)
    if kind in ("every third", "every fourth"):
        step = 3 if kind == "every third" else 4
        for i in range(step - 1, len(out), step):
            out[i] = f"other{rng.integers(1000)}"
        return out
    for _ in range(int(kind)):
        at = int(rng.integers(len(out)))
        out[at : at + 1] = [[], [f"other{rng.integers(1000)}"], [out[at], f"more{rng.integers(1000)}"]][rng.integers(3)]
    return out


def test_contamination_against_all_alignments(spark):
    """Every pair that reaches the score in a plain comparison of all documents with all items is found, and no other."""
    rng = np.random.default_rng(11)
    items = [list(rng.choice(VOCABULARY, n)) for n in (2, 3, 4, 6, 9, 12, 15, 20, 20, 30, 40, 70, 140) for _ in range(2)]
    rows, at = [], {}
    for kind in ("every third", "every fourth", "0", "1", "2", "4", "6"):
        for i, item in enumerate(items):
            if kind == "0" or len(item) >= 12:
                copy = _damaged(rng, item, kind)
                at.setdefault(kind, []).append((len(rows), i))
                rows.append([*rng.choice(VOCABULARY, 60), *copy, *rng.choice(VOCABULARY, 60)])
    table = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.find_contamination(table, bench).collect()}
    pairs = [(d, i) for d in range(len(rows)) for i in range(len(items))]
    scores = decontaminate.alignments([np.unique(items[i] + rows[d], return_inverse=True)[1][: len(items[i])] for d, i in pairs],
                                      [np.unique(items[i] + rows[d], return_inverse=True)[1][len(items[i]) :] for d, i in pairs])
    wanted = {p: s[0] for p, s in zip(pairs, scores) if s[0] >= 0.5}
    assert all(wanted[p] == pytest.approx(s) for p, s in got.items())
    # Of items of up to four words two or three words that happen to meet are half of a match; seeds do not look for these.
    missed = {p for p in wanted if p not in got and len(items[p[1]]) > 4}
    assert not missed & {p for planted in at.values() for p in planted}
    assert len(missed) <= 0.01 * len(wanted)
    for kind, planted in at.items():
        reached = [p for p in planted if p in wanted]
        assert sum(p in got for p in reached) >= 0.95 * len(reached), kind
    assert all(p in got for p in at["0"] if len(items[p[1]]) > 2)


def test_contamination_by_odd_benchmarks(spark):
    """No benchmark finds nothing; a very long item does not lengthen the passages of short ones; ids may stand at several."""
    rng = np.random.default_rng(12)
    short, long = list(rng.choice(VOCABULARY, 20)), list(rng.choice(VOCABULARY, 3000))
    docs = spark.createDataFrame(
        [(1, " ".join([*rng.choice(VOCABULARY, 500), *short])), (2, " ".join(long)), (3, " ".join(long[:1000])), (4, " ".join(long[:1600]))],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame([(7, " ".join(short)), (8, " ".join(long)), (7, "one")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["score"], 2) for r in decontaminate.find_contamination(docs, bench).collect()}
    assert got == {(1, 7): 1.0, (2, 8): 1.0, (4, 8): 0.53}
    assert decontaminate.find_contamination(docs, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == 4
    both = spark.createDataFrame([(7, " ".join(short)), (7, " ".join(long))], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.find_contamination(docs, both).collect()} == {1, 2, 4}


def _align(a, b):
    h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


def test_alignment_against_plain_recurrence():
    rng = np.random.default_rng(2)
    pairs = [(rng.integers(0, 6, rng.integers(1, 20)), rng.integers(0, 6, rng.integers(1, 40))) for _ in range(200)]
    got = decontaminate.alignments(*zip(*pairs))
    for (a, b), (score, start, end) in zip(pairs, got):
        best = _align(a, b)
        assert score == pytest.approx(best / (2 * len(a)))
        assert not best or _align(a, b[start:end]) == best


def test_top_k(spark):
    rng = np.random.default_rng(4)
    vectors = [[float(x) for x in rng.integers(-2, 3, 6)] for _ in range(120)]
    rows = list(enumerate(vectors)) + [(200, None), (201, [1.0, None]), (202, [float("nan")]), (203, [float("inf")]), (None, [1.0]), (204, [])]
    table = spark.createDataFrame(rows, "id long, v array<double>").select("id", topk.integer_vector(F.col("v"), 4).alias("v"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(table.filter("id % 20 = 0"), table, 7).collect()}
    whole = {i: [int(4 * x) for x in v] for i, v in enumerate(vectors)} | {204: []}
    want = {}
    for q in range(0, 120, 20):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:7]
        want |= {(q, k): (i, -s) for k, (s, i) in enumerate(scored, 1)}
    assert got == want
    assert topk.top_k(table.filter("false"), table).count() == 0 and topk.top_k(table, table.filter("id = 3")).count() == 120


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a = "<p>no</p>";</script></head><body class="has-sidebar">
<header>Site <a href=/>home</a></header><nav><ul><li><a href="/x">menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>
 text&nbsp;here<p>Second &lt;tag&gt; with 'a > b'<br>line<ul><li>one<li>two</ul><form><input value="x">search</form>
<aside>related</aside><p>Last.</p><div class="comments"><p>reader says hi at great length and more</p></div></article>
<div id="sidebar">links</div><!-- c --><footer>&copy; me</footer>"""


def test_main_text(spark):
    want = "Title & more\nFirst bold text here\nSecond <tag> with 'a > b' line\none\ntwo\nLast."
    assert html.main_text(PAGE) == want
    plain = "<div id=wrap><div><h2>Head</h2><p>" + "some words " * 30 + "</p><p>Es.</p></div><ul><li><a href=a>a</a><li><a href=b>b</a></ul></div>"
    assert html.main_text(plain) == "Head\n" + ("some words " * 30).strip() + "\nEs."
    assert [html.main_text(x) for x in (None, "", " ", "<p>", "<!--", "<script>x")] == [""] * 6
    assert html.main_text("no markup & all") == "no markup & all"
    table = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert [tuple(r)[2:] for r in html.extract(table).orderBy("page_id").collect()] == [("", 0), (want, len(want)), (want, len(want))]
    assert len(html.main_text("<article>" + "<p>word</p>" * 20_000)) == 5 * 20_000 - 1


STORY = "<h1>Head</h1>" + "".join(f"<p>{f'Sentence {i} of the story goes on. ' * 4}</p>" for i in range(4))
OTHER = "".join(f"<p>{f'Another part {i} goes on. ' * 6}</p>" for i in range(3))
AROUND = '<nav><a href=x>Home</a></nav><div class="sidebar">Side text to leave out</div><form>Search here</form><footer>foot words</footer>'


@pytest.mark.parametrize("tag", ["article", "main", "div"])
@pytest.mark.parametrize(
    "wrapper",
    [
        'div class="site has-sidebar"',
        'div id="page" class="nav-open"',
        'form action="./Default.aspx"',
        'div class="sticky-header"',
        'section class="post comments-open"',
        'div role="dialog" class="widget"',
    ],
)
def test_main_text_within_marked_wrappers(wrapper, tag):
    """A wrapper whose class, role or tag reads like a menu keeps its article; marked parts within it are left out."""
    page = f"<body><{wrapper}>{AROUND}<{tag}>{STORY}</{tag}>{AROUND}</{wrapper.split()[0]}>"
    assert html.main_text(page) == html.main_text(f"<article>{STORY}</article>") and "Sentence 3" in html.main_text(page)


def test_main_text_of_marks_shared_by_the_parts():
    parts = "".join(f'<div class="x-widget"><div class="x-widget-box"><p>{f"Block {i} is here. " * 8}</p></div></div>' for i in range(6))
    assert html.main_text(f"<body>{AROUND}<div>{parts}</div>") == "\n".join((f"Block {i} is here. " * 8).strip() for i in range(6))


def test_main_text_leaves_teasers_and_long_discussions_out():
    teasers = "<aside><article>Teaser one with words</article></aside><div class=related><article>Teaser two</article></div>"
    page = f'<body><article>{STORY}</article>{teasers}<div class="comments">{OTHER * 9}</div>'
    assert html.main_text(page) == html.main_text(f"<article>{STORY}</article>")


@pytest.mark.parametrize("wrapper", ["main", "div"])
def test_main_text_of_several_articles(wrapper):
    """Articles beside the densest one stay by threshold, as they do with <div>."""
    page = f"<body>{AROUND}<{wrapper}><article>{STORY}</article><article>{OTHER}</article></{wrapper}>"
    assert html.main_text(page) == html.main_text(page.replace("article>", "div>"))
    assert "Head\nSentence 0" in html.main_text(page) and html.main_text(page).endswith("Another part 2 goes on.")
    assert html.main_text(page.replace("<main>", "<main><p>Intro.</p>")).startswith("Intro." if wrapper == "main" else "Head")
    assert html.main_text("<main><p>intro</p><article>part 1</article><article>part 2</article></main>") == "intro\npart 1\npart 2"


def test_urls(spark):
    model = urls.train(urls.labelled_urls(spark))
    cases = {
        "http://a.example.net/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "HTTP://WWW.Example.NET/fr/1?x#y": ("www.example.net", "/fr/1", "net/", "block"),
        "https://example.com/de/9": ("example.com", "/de/9", "example.com/de/", "block"),
        "https://x.org/fr/": ("x.org", "/fr/", "org/fr/", "allow"),
        "https://best-casino-win.example.com/en/5": ("best-casino-win.example.com", "/en/5", None, "block"),
        "https://www.history-museum.example.com/en/5": ("www.history-museum.example.com", "/en/5", None, "allow"),
        "http://foo.net?x": ("foo.net", "", None, None),
        "no scheme": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
    }
    table = spark.createDataFrame([(1, u, "clash") for u in cases] + [(1, None, "again")], "page_id long, url string, host string")
    got = urls.judge(table, model).collect()
    assert len(got) == len(cases) + 1
    found = {(r["host"], r["path"]): (r["rule"], r["verdict"]) for r in got}
    for host, path, rule, verdict in cases.values():
        assert found[host, path][0] == rule and found[host, path][1] in ([verdict] if verdict else ["allow", "block"])


def test_fixity(spark):
    pages = [(i, f"http://h/{i}", f"<p>{'body ' * (i % 50)}</p>") for i in range(600)] + [(None, None, None), (None, "u", "x"), (700, "u", None), (0, "v", "")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    whole = warc.catalogue(table, per_file=100)
    assert whole.count() == len(pages) and warc.audit(whole, whole).count() == 0
    ends = whole.groupBy("file").agg(F.sum("length").alias("size"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert ends.filter("size <> end").count() == 0
    broken = whole.withColumn("leaf", F.when(F.col("record").isin(7, 311), F.lit("0")).otherwise(F.col("leaf")))
    broken = broken.filter("record is null or record not in (5, 599)")
    got = {(r["record"], r["status"]) for r in warc.audit(whole, broken).collect()}
    assert got == {(7, "changed"), (311, "changed"), (5, "missing"), (599, "missing")}
    assert {r["status"] for r in warc.audit(broken, whole).filter("record in (5, 599)").collect()} == {"extra"}
    assert warc.audit(whole.filter("false"), whole.filter("false")).count() == 0
    assert warc.audit(whole, whole.filter("false")).count() == len(pages)


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.classify(docs, labels)
    found = scored.filter("held_out").join(labels, "doc_id").select("predicted", "quality").toPandas()
    assert len(found) > 50 and (found.predicted == found.quality).mean() > 0.95
    assert scored.count() == docs.count()


def test_quality_without_texts_or_labels(docs, nothing, rows, spark):
    labels = spark.createDataFrame([(10, 1), (10, 1), (11, None), (None, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    blank = {r["score"] for r in got if r["doc_id"] in (0, 1)}
    assert len(blank) == 1
    assert {r["score"] for r in quality.classify(docs, labels.filter("false")).collect()} == {0.5}
    assert quality.classify(nothing, labels).count() == 0


def test_empty_tables(spark, nothing):
    assert minhash.near_duplicates(nothing).count() == 0
    assert lines.dedup_lines(nothing).count() == 0
    assert bpe.encode(nothing, PATH).count() == 0
    assert licenses.scan(nothing).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(nothing, bench).count() == 0


def test_pipeline(spark):
    """Each stage keeps the columns of documents and what its operator keeps; the last one's ids agree with the library."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tokenizer, seen = Tokenizer.from_file(PATH), docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        out = spark.createDataFrame(out.collect(), docs.schema)
        assert out.columns == docs.columns and 0 < out.count() <= seen, name
        docs, seen = out, out.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        assert got[i]["n_tokens"] == len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_pipeline_stages_against_brute_force(spark, rows, tmp_path):
    """Rows and texts that each stage keeps, one stage after the other."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    rng = np.random.default_rng(9)
    bench = [(i, " ".join(rng.choice(VOCABULARY, 20))) for i in range(6)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near = [(i, t) for i, t in rows if len(t or "") < 10_000]
    for i, (_, item) in enumerate(bench[:4]):  # whole, and with up to three words replaced
        words = item.split()
        for k in range(i):
            words[6 * k + 5] = "changed"
        near.append((500 + i, " ".join([*rng.choice(VOCABULARY, 60), *words, *rng.choice(VOCABULARY, 60)])))
    near.append((510, " ".join([*rng.choice(VOCABULARY, 60), *bench[5][1].split()[:8], *rng.choice(VOCABULARY, 60)])))
    schema = "doc_id long, text string, doc string"

    def run(name, texts):
        out = stages[name](spark, spark.createDataFrame([(i, t, "own") for i, t in texts], schema), str(tmp_path))
        assert out.columns == ["doc_id", "text", "doc"]
        return Counter((r["doc_id"], r["text"] or "", r["doc"]) for r in out.collect())

    counted = lambda texts: Counter((i, t or "", "own") for i, t in texts)

    key = lambda line: _lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in near:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                holders[key(line)].add(i)
    kept = []
    for i, t in near:
        lines_ = (t or "").split("\n")
        kept.append((i, "\n".join(x for x in lines_ if i is None or len(holders[key(x)]) < 5 or i == max(holders[key(x)]))))
    assert counted(kept) != counted(near) and run("line_dedup", near) == counted(kept)

    sets, up = {i: _shingles(t) for i, t in kept if i is not None}, {}
    for a in sorted(sets):
        up.setdefault(a, a)
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = up[a], up.setdefault(b, b)
                up = {i: min(x, y) if c in (x, y) else c for i, c in up.items()}
    single = [(i, t) for i, t in kept if i is None or up[i] == i]
    assert len(single) < len(kept) and run("near_duplicates", kept) == counted(single)

    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", _lower(t))
    number = defaultdict(lambda: len(number))
    items = [np.array([number[w] for w in split(t)]) for _, t in bench]
    clean = []
    for i, t in single:
        words = np.array([number[w] for w in split(t)], int)
        if i is None or all(_align(item, words) < len(item) for item in items):
            clean.append((i, t))
    assert {i for i, _ in single} - {i for i, _ in clean} == {500, 501, 502, 503}
    assert run("decontamination", single) == counted(clean)

    tokenizer = Tokenizer.from_file(PATH)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, t in clean:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        want[i, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(tokenizer.decode(ids, skip_special_tokens=False).encode())] += 1
    out = stages["encoding"](spark, spark.createDataFrame([(i, t, "own") for i, t in clean], schema), str(tmp_path))
    assert Counter(tuple(r) for r in out.collect()) == want


def test_pipeline_quality_stage_keeps_what_the_classifier_accepts(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scores = quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("predicted = 1").select("doc_id")
    want = {r[0] for r in scores.collect()}
    got = corpus_pipeline.STAGES[0][1](spark, docs, sf).collect()
    assert Counter(tuple(r) for r in got) == Counter(tuple(r) for r in docs.collect() if r["doc_id"] in want)
    assert 0 < len(got) < docs.count()
