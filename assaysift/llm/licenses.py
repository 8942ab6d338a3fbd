"""Search for short licence notices that allows for edits, and for exact licence phrases.

By the pigeonhole principle an occurrence with at most k edits holds at least one of k + 1 pieces of the notice unchanged.
One automaton over the pieces of all notices finds such places; only there the bounded-error matching of ``regex`` runs.
Every text is handled whole and on its own, so nothing is shuffled.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases that are matched exactly, word by word, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices that are matched with edits, as lower-case words, with their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the mozilla public license version 2 0": "mpl-2.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "creative commons attribution 4 0 international license": "cc-by-4.0",
    "this work is dedicated to the public domain": "public-domain",
}
_OTHER = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def edits_allowed(notice: str) -> int:
    """Return how many characters of a notice may be inserted, deleted or replaced: one in ten."""
    return max(1, len(notice) // 10)


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """Split a notice into ``edits`` + 1 pieces of about equal length, each with its place."""
    bounds = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(i, notice[i:j]) for i, j in zip(bounds, bounds[1:])]


class Searcher:
    """Finds notices in normalised texts: lower-case words with one blank around each."""

    def __init__(self, notices: dict[str, str]) -> None:
        self.notices, self.patterns, found = [], [], {}
        for notice, label in notices.items():
            k = edits_allowed(notice)
            self.notices.append((notice, label, k))
            self.patterns.append(regex.compile(rf"(?b)(?<= )(?:{regex.escape(notice)}){{e<={k}}}(?= )"))
            for at, piece in pieces(notice, k):
                found.setdefault(piece, []).append((len(self.notices) - 1, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[str, int, int, int]]:
        """Return (label, start, end, edits) of every notice in ``text``, in order.

        Every place that a piece points to is searched in a window of its own, which has room for one notice only: a better
        one nearby does not hide it. Notices resemble one another: of overlapping places the best stands, and what it leaves
        of the others' windows is searched again.
        """
        windows: set[tuple[int, int, int]] = set()
        for last, (size, places) in self.automaton.iter(text):
            for which, at in places:
                notice, _, k = self.notices[which]
                start = last + 1 - size - at
                windows.add((which, max(0, start - k - 1), min(start + len(notice) + k + 1, len(text))))
        hits: list[tuple[int, int, int, str, int, int, int]] = []

        def find(which: int, low: int, high: int) -> None:
            notice, label, k = self.notices[which]
            if high - low < len(notice) - k + 2:
                return
            if found := self.patterns[which].search(text, low, high):
                i, j = found.span()
                heapq.heappush(hits, (sum(found.fuzzy_counts), i - j, i, label, which, low, high))

        for window in windows:
            find(*window)
        kept: list[tuple[int, int, str, int]] = []  # ordered by place, without overlaps
        while hits:
            edits, size, i, label, which, low, high = heapq.heappop(hits)
            j = i - size
            k = bisect.bisect_left(kept, j, key=lambda x: x[0])  # those before k start before the hit ends
            if k and kept[k - 1][1] > i:
                other = kept[k - 1]
                if other[:2] != (i, j) or other[2] != label:
                    find(which, low, min(high, other[0]))
                    find(which, max(low, other[1]), high)
                continue
            kept.insert(k, (i, j, label, edits))
        return [(label, i, j, edits) for i, j, label, edits in kept]


def normalised(text: str) -> str:
    """Return the words of a text (ASCII letters and digits, everything beyond ASCII), A-Z lower-cased, blanks around each."""
    words = _OTHER.sub(b" ", text.encode("utf-8", "surrogatepass").lower()).decode("utf-8", "surrogatepass").strip(" ")
    return f" {words} " if words else ""


_HIT = "struct<label:string,base:boolean,first_word:long,n_words:long,start:long,end:long,edits:int,matched:string>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] | None = None) -> DataFrame:
    """Return (doc_id, n_words, hits) for every row of ``docs``.

    A hit is a place of an exact phrase (``base``) or of a notice with edits: its label, its first word and number of
    words, its span of code points in the original text, the edits and the original text. Hits are ordered by place, then
    label. Of overlapping places of notices the one with fewest edits counts, then the longest, then the leftmost. Null and empty texts have no words
    and no hits; rows may repeat or lack an id; further columns are ignored.
    """
    notices = NOTICES if notices is None else notices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(notices)
        names = ["label", "base", "first_word", "n_words", "start", "end", "edits", "matched"]
        kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        hit = pa.struct(list(zip(names, kinds, strict=True)))
        for batch in batches:
            counts, hits = [], []
            for original in batch.column(1).to_pylist():
                text = normalised(original or "")
                counts.append(max(0, text.count(" ") - 1))
                found = []
                for phrase, label in PHRASES.items():
                    at = text.find(f" {phrase} ")
                    while at >= 0:
                        found.append((label, True, at + 1, at + 1 + len(phrase), 0))
                        at = text.find(f" {phrase} ", at + 1)
                found += [(label, False, i, j, edits) for label, i, j, edits in searcher.search(text)]
                rows = []
                if found:
                    words = [x.span() for x in _WORD.finditer(original)]
                    for label, base, i, j, edits in sorted(found, key=lambda x: (x[2], x[3], x[0])):
                        first, size = text.count(" ", 0, i) - 1, text.count(" ", i, j) + 1
                        begin, end = words[first][0], words[first + size - 1][1]
                        rows.append(dict(zip(names, (label, base, first, size, begin, end, edits, original[begin:end]), strict=True)))
                hits.append(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(hits, pa.list_(hit))], ["doc_id", "n_words", "hits"]
            )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id long, n_words long, hits array<{_HIT}>")


def spans(scanned: DataFrame) -> DataFrame:
    """Return one row per hit of ``scan``."""
    return scanned.select("doc_id", F.inline("hits"))


def summary(scanned: DataFrame) -> DataFrame:
    """Return counts, labels and a score per row of ``scan``: 1 less the share of edits in the best hit's characters, or 0."""
    base = F.filter("hits", lambda x: x["base"])
    joined = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda x: x["label"]))), ",")
    quality = F.transform("hits", lambda x: 1 - x["edits"] / F.greatest(F.lit(1), F.length(x["matched"])))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["first_word"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("hits")).alias("labels"),
        F.greatest(F.lit(0.0), F.coalesce(F.array_max(quality), F.lit(0.0))).alias("score"),
    )
