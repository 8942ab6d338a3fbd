"""Pages and addresses of any length and alphabet, and plain versions of what their operators compute."""

import math
import random
import re
import time

from pyspark.sql import functions as F

from assaysift.llm import html, licenses, urls

ARTICLE = "<p>The harvest was larger than anyone in the valley remembered, and the mills ran through the night.</p>" * 4


def _page(title, body):
    return f"<html><head><title>{title}</title><script>if (a<b) x('</p>');</script></head><body>{body}</body></html>"


def test_letters_that_change_length_with_case_move_no_text():
    plain = html.main_text(_page("Istanbul", f"<h1>Title</h1><style>p > a {{}}</style>{ARTICLE}"))
    assert plain.count("harvest") == 4
    for title in ("İSTANBUL İZMİR İLİ İÇİN İLAN İİİİİİİİİİ", "ẞß ﬁ ŉ", "ΑΣ Σ", "K Å ſtyle"):
        assert html.main_text(_page(title, f"<h1>Title</h1><style>p > a {{}}</style>{ARTICLE}")) == plain
    for end in ("</SCRIPT>", "</Script >", "</script/>"):
        found = html.main_text(f"<body>İİİİ<script>var x = '<p>hidden</p>'{end}{ARTICLE}</body>")
        assert "hidden" not in found and found.count("harvest") == 4


def test_nested_and_unmatched_tags_take_time_in_proportion():
    for body in (
        "<div>" * 100_000 + ARTICLE,
        ARTICLE + "</section>" * 100_000,
        "<div>" * 50_000 + ARTICLE + "</span>" * 50_000,
        "<b>" * 50_000 + "<p>" * 50_000 + ARTICLE,
        "<header>" * 50_000 + "<article>" + ARTICLE,
        "<ul>" + "<li>" * 50_000 + ARTICLE,
    ):
        began = time.process_time()
        found = html.main_text(f"<html><body>{body}</body></html>")
        assert time.process_time() - began < 20
        assert found.count("harvest") == 4 or "<header>" in body or "<li>" in body


def _random_tree(rng, depth):
    """Return (tag, children), whose children are texts and trees."""
    if depth == 0:
        return rng.choice(["p", "span", "a"]), [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(0, 6)))]
    return rng.choice(["div", "section", "span"]), [_random_tree(rng, depth - 1) for _ in range(rng.randint(1, 3))]


def _markup(tree):
    return tree if isinstance(tree, str) else f"<{tree[0]}>{''.join(map(_markup, tree[1]))}</{tree[0]}>"


def _plain(tree, share=None):
    """Return (characters, link characters, tags, links) of a tree, and the densities of its nodes in page order."""
    if isinstance(tree, str):
        return (len("".join(tree.split())), 0, 0, 0), []
    parts = [_plain(x, share) for x in tree[1]]
    own = [x for x in tree[1] if not isinstance(x, str)]
    chars = sum(p[0][0] for p in parts)
    linked = chars if tree[0] == "a" else sum(p[0][1] for p in parts)
    tags = len(own) + sum(p[0][2] for p in parts)
    links = sum(x[0] == "a" for x in own) + sum(p[0][3] for p in parts)
    density = 0.0
    if chars and share is not None:
        base = math.log(chars / max(chars - linked, 1) * linked + share * chars + math.e)
        ratio = max(chars / max(linked, 1) * max(tags, 1) / max(links, 1), 1.0)
        density = chars / max(tags, 1) * math.log(ratio) / (math.log(base) if base > math.e else 1.0)
    return (chars, linked, tags, links), [density, *(d for p in parts for d in p[1])]


def test_densities_equal_the_plain_recursion():
    rng = random.Random(9)
    for _ in range(60):
        tree = ("body", [_random_tree(rng, rng.randint(1, 4)) for _ in range(3)])
        nodes, flow = html.parse(_markup(tree))
        html.densities(nodes, flow)
        (chars, linked, *_), _ = _plain(tree)
        _, wanted = _plain(tree, linked / max(chars, 1))
        found = [x.density for x in nodes if x.tag != "html"]
        assert len(found) == len(wanted) and all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(found, wanted, strict=True))
        for x in nodes:
            assert math.isclose(x.total, sum(c.density for c in x.children), rel_tol=1e-9, abs_tol=1e-9)


def test_no_pages(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).collect() == []
    none = spark.createDataFrame([], "page_id long, url string, rule string")
    assert urls.judge(none, urls.train(urls.labelled_urls(spark))).collect() == []


ADDRESSES = [
    None, "", "no scheme", "http://", "HTTPS://Sub.Example.NET/en/x?q#f", "http://example.net/EN/", "a://b://c/d", "http://net/x",
    "http://notexample.com/de/1", "http://x.example.com/de/1", "ftp://fr.org/fr/ü漢😀/end", "http://org/frx", "http://h?x/y", "http://h#x",
]


def _plain_judgement(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [
        r for r in urls.RULES
        if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])
    ]
    return host, path, max(fits, key=len, default=None)


def _plain_terms(host, path):
    host, path = f"^{host}$", f"^{path}$"
    grams = lambda text, mark, n: [mark + text[i : i + n] for i in range(len(text) - n + 1)]
    return [g for n in (3, 4, 5) for g in grams(host, "h", n)] + [g for n in (3, 4) for g in grams(path, "p", n)]


def test_addresses_equal_the_plain_version(spark):
    table = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(ADDRESSES)], "page_id long, url string, host string")
    found = urls.judge(table, urls.train(urls.labelled_urls(spark))).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in found} == {i: _plain_judgement(u) for i, u in enumerate(ADDRESSES)}
    assert all(r["verdict"] == urls.RULES[r["rule"]] for r in found if r["rule"])
    terms = urls._with_terms(table.select("page_id", "url"), F.col("url")).collect()
    assert {r["page_id"]: r["_terms"] for r in terms} == {i: _plain_terms(*_plain_judgement(u)[:2]) for i, u in enumerate(ADDRESSES)}


def test_a_very_long_address(spark):
    url = "data://host/" + "".join(random.Random(1).choice("abcdefgh/é") for _ in range(300_000))
    began = time.monotonic()
    row = urls.judge(spark.createDataFrame([(1, url)], "page_id long, url string"), urls.train(urls.labelled_urls(spark))).first()
    assert len(row["path"]) == 300_001 and time.monotonic() - began < 90


PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def test_license_phrases_equal_the_plain_count(spark):
    rng = random.Random(2)
    words = ["cc", "by", "General", "PUBLIC", "license", "all", "rights", "reserved", "öl", "x1"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ",", " -", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    rows = [*enumerate(texts), (None, "cc by"), (5, texts[5]), (900, None), (901, "cc by " * 4000)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, labels string")

    def plain(text):
        own = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = sorted((i, label) for p, label in PHRASES.items() for i in range(len(own)) if tuple(own[i : i + len(p)]) == p)
        return (len(own), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))

    fields = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    found = licenses.summary(licenses.scan(docs)).collect()
    assert sorted(((r["doc_id"], *(r[x] for x in fields)) for r in found), key=repr) == sorted(((i, *plain(t)) for i, t in rows), key=repr)
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in found)
