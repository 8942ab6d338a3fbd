"""Fill-in-middle, nearest neighbours and importance resampling against plain versions, with odd rows of every kind."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from assaysift.llm import ann, fim, resample

SCHEMA = "doc_id long, text string, form string, output string, rank string"
LONG = " ".join(f"wörd{i % 977}" for i in range(200_000))
TEXTS = [
    (None, None), (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, " lead and trail \n"), (6, "has <P> inside"),
    (7, "open < S> <P <S"), (8, "naïve Ünïcode 漢字 😀 tail  "), (9, LONG), (None, "no id at all"), (10, "same"), (10, "same"),
] + [(100 + i, f"Text {i}  with\tsome words\n\nand <M end {'x' * i} ") for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _plain_fim(doc, text, seed=42):
    text = text or ""
    units = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
    digits = _sha(f"{seed}:{'' if doc is None else doc}")
    h = [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (n, "plain", None, None, _sha(text), _sha(text))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return (n, "spm", len(pre), len(mid), _sha(f"<S>{suf}<P>{pre}<M>{mid}"), _sha(text))
    return (n, "psm", len(pre), len(mid), _sha(f"<P>{pre}<S>{suf}<M>{mid}"), _sha(text))


def test_fill_in_middle_equals_the_plain_version(docs, nothing):
    out = fim.transform(docs)
    rows = fim.restore(out).collect()
    fields = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    found = Counter((r["doc_id"], *(r[x] for x in fields)) for r in rows)
    assert found == Counter((i, *_plain_fim(i, t)) for i, t in TEXTS)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert Counter((r["doc_id"], r["restored"]) for r in rows) == Counter((i, t or "") for i, t in TEXTS)
    assert all(_sha(r["output"]) == r["output_sha256"] for r in rows)
    assert fim.restore(fim.transform(nothing), keep_text=False).collect() == []


def test_every_document_rearranged(docs):
    rows = fim.restore(fim.transform(docs, seed=7, rate=100, spm=0)).collect()
    assert {r["form"] for r in rows if r["doc_id"] and r["doc_id"] >= 100} == {"psm"}
    assert Counter((r["doc_id"], r["restored"]) for r in rows) == Counter((i, t or "") for i, t in TEXTS)


def test_piece_table():
    text = b"abcdefgh"
    whole = [(0, 0, 8)]
    assert fim.cut(whole, [0, 0]) == [[], [], whole] and fim.cut(whole, [8, 8]) == [whole, [], []]
    assert fim.cut([(0, 0, 3), (0, 3, 5)], [2, 6]) == [[(0, 0, 2)], [(0, 2, 1), (0, 3, 3)], [(0, 6, 2)]]
    for form, wanted in (("psm", b"<P>ab<S>fgh<M>cde"), ("spm", b"<S>fgh<P>ab<M>cde")):
        pieces = fim.arrange(fim.cut(whole, [2, 5]), form)
        assert b"".join(fim.views(pieces, text)) == wanted and fim.digest(pieces, text) == hashlib.sha256(wanted).hexdigest()
        assert b"".join(fim.views(fim.invert(wanted, form), wanted)) == text
    with pytest.raises(ValueError):
        fim.invert(b"no sentinel", "psm")


def _nearest(rows, k, queries=lambda i: i % 20 == 0):
    """All inner products by plain loops over usable rows; rows equal in id and vector once."""
    usable = {
        (i, tuple(v)) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    }
    width = max((len(v) for _, v in usable), default=0)
    full = sorted((i, v + (0.0,) * (width - len(v))) for i, v in usable)
    ids, matrix = np.array([i for i, _ in full]), np.array([v for _, v in full])
    out = {}
    for i, v in full:
        if queries(i) and i not in out:
            scores = np.cumsum(matrix * np.array(v), axis=1)[:, -1]
            other = ids != i
            best = np.lexsort((ids[other], -scores[other]))[:k]
            out[i] = list(zip(ids[other][best].tolist(), scores[other][best].tolist(), strict=True))
    return out


VECTORS = "id long, v array<double>, rank int, cell string"


def _searched(spark, rows, k, confidence=0.92):
    table = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], VECTORS).repartition(4)
    found = {}
    asked = table.filter("id % 20 = 0")
    for r in sorted(ann.search(ann.build_index(table, k), asked, confidence=confidence).collect(), key=lambda r: r["rank"]):
        assert len(found.setdefault(r["query_id"], [])) == r["rank"] - 1
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    return found


def test_nearest_with_odd_rows_copies_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(120)]
    copy = rng.standard_normal(6).tolist()
    rows += [(1000 + i, copy) for i in range(300)]  # a third of all rows and more
    rows += [(2000 + i, [1.0, 0.0]) for i in range(41)]  # shorter, and of equal score
    rows += [(None, copy), (3000, None), (3020, []), (3040, [0.0] * 6), (3060, [1.0, None]), (3080, [float("nan")] * 6)]
    rows += [(3100, [float("inf"), 1.0]), rows[0], rows[20], rows[20], (40, copy)]
    found, wanted = _searched(spark, rows, 20, 1 - 1e-9), _nearest(rows, 20)
    wanted[40] = found[40]  # a query that repeats an id: its smallest vector counts
    assert found == wanted


def test_nearest_recall_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "UNIT_ROWS", 128)
    monkeypatch.setattr(ann, "UNIT_SEARCHES", 16)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(24) * rng.choice([0.5, 1, 3])).tolist()) for i in range(2000)]
    found, wanted = _searched(spark, rows, 10), _nearest(rows, 10)
    hits = sum(len(set(found[q]) & set(wanted[q])) for q in wanted)
    assert found.keys() == wanted.keys() and all(len(x) == 10 for x in found.values())
    assert hits >= 0.9 * 10 * len(wanted)


def test_queries_of_a_unit_are_searched_together():
    rng = np.random.default_rng(5)
    rows = rng.standard_normal((4608, 64))
    rows /= np.sqrt((rows * rows).sum(1))[:, None]
    own, queries = np.arange(4096, 4608), rows[4096:]
    started = time.thread_time()
    scores = [np.cumsum(rows * x, axis=1)[:, -1] for x in queries]
    plain = time.thread_time() - started
    # Every row has two ids.
    names = np.arange(2 * len(rows))
    best = []
    for i, x in zip(own, scores, strict=True):
        order = np.lexsort((names, -np.tile(x, 2)))[:21]
        best.append([(j, x[j % len(rows)]) for j in order.tolist() if j != i][:20])
    axes, reach = rng.standard_normal((65, 16)), np.full(512, 2.0)
    ids = pa.array([[i, i + len(rows)] for i in range(len(rows))], pa.list_(pa.int64()))
    unit, points = ann.Unit(ids, rows, ann._project(rows, axes, 1.0)), ann._project(queries, axes, None)

    def search(least, spread):
        found = [[] for _ in best]
        started = time.thread_time()
        out = unit.search(queries, points, own, 20, least, spread, reach)
        spent = time.thread_time() - started
        for i, name, score in zip(*(x.tolist() for x in out), strict=True):
            found[i].append((name, score))
        return found, spent

    # A test that rules nothing out leaves an exact search.
    assert search(np.full(512, -np.inf), 1e9)[0] == best
    least = np.array([x[-1][1] for x in best])
    found, spent = search(least, ann.chi_square_quantile(0.92, 16))
    for x, y, z in zip(found, best, scores, strict=True):
        assert x == sorted(x, key=lambda r: (-r[1], r[0])) and all(z[j % len(rows)] == score >= y[-1][1] for j, score in x)
    assert sum(len(set(x) & set(y)) for x, y in zip(found, best, strict=True)) >= 0.9 * 20 * 512
    # Searched one by one, such queries took about 0.4 of the plain time.
    assert spent < plain / 8


def test_nearest_of_few_or_no_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0, 1.0]), (7, [-1.0, 0.5])]
    assert _searched(spark, rows, 20) == _nearest(rows, 20)
    assert _searched(spark, rows[:1], 20) == {} and _searched(spark, [], 20) == {}


def test_chi_square_quantile():
    # Median and a tail of two and four degrees of freedom, whose distributions are elementary.
    assert math.isclose(ann.chi_square_quantile(0.5, 2), 2 * math.log(2), rel_tol=1e-9)
    x = ann.chi_square_quantile(0.9, 4)
    assert math.isclose(math.exp(-x / 2) * (1 + x / 2), 0.1, rel_tol=1e-9)
    with pytest.raises(ValueError):
        ann.chi_square_quantile(0.5, 3)


def _features(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [x.encode() for x in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)]
    return [zlib.crc32(b" ".join(words[i : i + n])) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)], len(words)


def _plain_resample(rows, target, per_cent, least):
    feats = [(i, *_features(t)) for i, t in rows]
    s, t = Counter(x for _, f, _ in feats for x in f), Counter(x for b in target for x in _features(b)[0])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    out = []
    for i, f, n in feats:
        h = int(_sha(f"42:{'' if i is None else i}")[:8], 16)
        weight = sum(gain[x] for x in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    order = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(order[: per_cent * len(order) // 100]):
        r[4] = rank + 1
    return Counter(tuple(r[:5]) for r in out)


TARGET = ["text some words and end", None, "", "Naïve words, with words", "wörd1 wörd2 wörd3"]


@pytest.mark.parametrize("size", [0, 40, 1 << 20])
@pytest.mark.parametrize(("per_cent", "least"), [(5, 2), (60, 1), (100, 0)])
def test_resampling_equals_the_plain_version(spark, docs, size, per_cent, least):
    target = spark.createDataFrame([(x, "n", 1) for x in TARGET], "text string, doc_id string, rank int")
    found = Counter(map(tuple, resample.resample(docs, target, per_cent, least, dictionary_bytes=size).collect()))
    assert found == _plain_resample(TEXTS, TARGET, per_cent, least)


def test_resampling_empty_tables(spark, docs, nothing):
    target = spark.createDataFrame([("a b",)], "text string")
    assert resample.resample(nothing, target).collect() == []
    found = Counter(map(tuple, resample.resample(docs, target.limit(0), 50, 1).collect()))
    assert found == _plain_resample(TEXTS, [], 50, 1)


def test_checksum_of_joined_texts():
    rng = np.random.default_rng(1)
    parts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 2, 62, 63, 64, 65, 200, 70_001)]
    for a in parts:
        sizes = np.array([len(b) for b in parts])
        other = np.array([zlib.crc32(b) for b in parts], np.uint32)
        joined = resample.append(np.full(len(parts), zlib.crc32(a), np.uint32), other, sizes)
        assert joined.tolist() == [zlib.crc32(a + b) for b in parts]


def test_matches_are_whole_words():
    texts = ["the cat sat", "cathe the  the", "", "a-the-b", "scat"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
    for words in ([], [b"the", b"cat"], [b"the", b"cat", b"sat", b"cathe", b"a", b"b", b"scat"]):
        crc, size, first = resample.payloads(resample.automaton(words), data, offsets)
        flat = [w for x in texts for w in re.findall("[a-z]+", x)]
        assert crc.tolist() == [zlib.crc32(w.encode()) for w in flat] and size.tolist() == [len(w) for w in flat]
        assert np.diff(first).tolist() == [3, 3, 0, 3, 1]
