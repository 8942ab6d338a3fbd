"""Importance resampling towards a target distribution over hashed word n-grams.

Words are found by an Aho-Corasick automaton whose entries are distinct words between delimiters. Each entry carries the
CRC-32 and the length of its word, which a scan emits; the CRC-32 of two or three adjacent words follows from these
payloads alone, since appending bytes is a linear map of the checksum. Buckets of all n-grams are counted in Spark for both
sides, and each document is scored by the gains of its buckets plus seeded Gumbel noise, of which the highest are drawn.

The automaton holds the commonest distinct words of both sides, as many as a byte limit allows, so it can be sent to every
task. Words beyond it are recognised by the gaps between matches and get the same payload from their own bytes: the limit
decides about speed, never about results.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaysift.functions.ordering import row_positions
from assaysift.llm import words as W
from assaysift.session import reliable_checkpoint

BUCKETS = 10_000
#: Bytes of the words in the automaton at most, and of a word that may enter it.
DICTIONARY_BYTES, WORD_BYTES = 1 << 20, 48
#: Distinct words that a task's counter holds before it is emptied.
_COUNTED = 100_000
#: Delimiters become blanks and A-Z lower case.
_PLAIN = bytes((b + 32 if 65 <= b <= 90 else b) if W.ALNUM[b] else 32 for b in range(256))


def _shift_tables() -> np.ndarray:
    """Return, per power of two and byte of a checksum, what that byte becomes when so many bytes are appended."""
    out = np.zeros((32, 4, 256), np.uint32)
    # The step of one byte, taken from checksums of single bytes: c becomes (c >> 8) ^ step[c & 255].
    step = np.array([zlib.crc32(bytes([b ^ 0xFF])) ^ 0xFF000000 for b in range(256)], np.uint32)
    for byte in range(4):
        value = np.arange(256, dtype=np.uint32) << np.uint32(8 * byte)
        out[0, byte] = (value >> np.uint32(8)) ^ step[value & np.uint32(255)]
    for power in range(1, len(out)):
        for byte in range(4):
            out[power, byte] = _apply(out[power - 1], out[power - 1][byte])
    return out


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = tables[0][crc & np.uint32(255)]
    for byte in range(1, 4):
        out = out ^ tables[byte][(crc >> np.uint32(8 * byte)) & np.uint32(255)]
    return out


_SHIFT = _shift_tables()
#: The map of every short length as one set of tables.
_SHORT = np.zeros((64, 4, 256), np.uint32)
_SHORT[0] = np.arange(256, dtype=np.uint32) << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]
for _n in range(1, 64):
    for _byte in range(4):
        _SHORT[_n, _byte] = _apply(_SHIFT[0], _SHORT[_n - 1, _byte])
_BLANK = zlib.crc32(b" ")


def append(crc: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Return the CRC-32 of texts followed by others, from the CRC-32 of both and the length of the latter."""
    low = np.minimum(size, 63)
    out = np.zeros(len(crc), np.uint32)
    for byte in range(4):
        out ^= _SHORT[low, byte, (crc >> np.uint32(8 * byte)) & np.uint32(255)]
    far = np.flatnonzero(size > 63)
    if len(far):
        left, moved = size[far] - 63, out[far]
        for power in range(int(left.max()).bit_length()):
            on = (left >> power) & 1 == 1
            moved[on] = _apply(_SHIFT[power], moved[on])
        out[far] = moved
    return out ^ other


def _plain_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Return all rows as one text of words between blanks, with a blank at either end of each row, and the row starts."""
    raw = data.tobytes().translate(_PLAIN)
    starts = offsets[:-1] + np.arange(len(offsets) - 1)
    rows = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return b" " + b" ".join(rows) + b" ", starts


def word_counts(texts: DataFrame) -> DataFrame:
    """Return (word, n): every distinct word of ``texts`` (text) of up to WORD_BYTES bytes, as bytes, with its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            kept = {w: n for w, n in counts.items() if len(w) <= WORD_BYTES}
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for _, data, offsets in W.pieces(batch.column(0)):
                counts.update(_plain_rows(data, offsets)[0].split())
                if len(counts) > _COUNTED:
                    yield flush()
        yield flush()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(texts: DataFrame, most_bytes: int = DICTIONARY_BYTES) -> list[bytes]:
    """Return the commonest distinct words of ``texts`` (text), at most so many bytes of them.

    The cut runs along eighths of powers of two of the counts, so it takes a few hundred sums and no ordering.
    """
    table = reliable_checkpoint(word_counts(texts))
    level = F.floor(F.log2("n") * 8).cast("int")
    taken, least = 0, None
    sums = table.groupBy(level.alias("level")).agg(F.sum(F.octet_length("word")).alias("bytes")).collect()
    for row in sorted(sums, reverse=True):
        taken += row["bytes"]
        if taken > most_bytes:
            break
        least = row["level"]
    if least is None:
        return []
    return table.filter(level >= least).select("word").toArrow().column("word").to_pylist()


def automaton(words: list[bytes]) -> ahocorasick.Automaton | None:
    """Return the automaton of delimiter-bounded words; a match emits CRC-32 and length of its word as one number."""
    if not words:
        return None
    found = ahocorasick.Automaton()
    for word in words:
        # One character per byte, so places are byte places.
        found.add_word(f" {word.decode('latin-1')} ", zlib.crc32(word) << 16 | len(word))
    found.make_automaton()
    return found


_latest: list = []


def _automaton_of(broadcast) -> ahocorasick.Automaton | None:
    """Build a broadcast dictionary's automaton once per worker; only the latest is kept."""
    words = broadcast.value
    if not _latest or _latest[0] is not words:
        _latest[:] = []
        _latest[:] = [words, automaton(words)]
    return _latest[1]


def payloads(found: ahocorasick.Automaton | None, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Return CRC-32 and length of all words of all rows, and the index of each row's first word."""
    plain, starts = _plain_rows(data, offsets)
    start, end, _ = W.spans(np.frombuffer(plain, np.uint8), np.array([0, len(plain)]), W.ALNUM)
    first = np.searchsorted(start, np.append(starts, len(plain)))
    emitted = np.zeros((0, 2), np.int64)
    if found is not None and len(start):
        emitted = np.fromiter(chain.from_iterable(found.iter(plain.decode("latin-1"))), np.int64).reshape(-1, 2)
    # A match ends at the blank behind its word; matches come in order of their ends, one per word at most.
    crc, size = np.zeros(len(start), np.uint32), end - start
    at = np.searchsorted(end, emitted[:, 0])
    crc[at] = (emitted[:, 1] >> 16).astype(np.uint32)
    if len(at) < len(start):
        missing = np.ones(len(start), bool)
        missing[at] = False
        for i in np.flatnonzero(missing).tolist():
            crc[i] = zlib.crc32(plain[start[i] : end[i]])
    return crc, size, first


def bucketed(crc: np.ndarray, size: np.ndarray, first: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Return the bucket of every run of one to three words, and per run the index of the row that holds it."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    led = append(np.full(len(crc), _BLANK, np.uint32), crc, size)  # each word behind a blank
    found, owners = [crc], [rows]
    run = crc
    for n in (1, 2):
        run = append(run[:-1], led[n:], size[n:] + 1)
        inside = rows[n:] == rows[: len(rows) - n]
        found.append(run[inside])
        owners.append(rows[n:][inside])
    return (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), np.concatenate(owners)


def bucket_counts(texts: DataFrame, dictionary_, buckets: int = BUCKETS) -> np.ndarray:
    """Return how many features of ``texts`` (text) fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = _automaton_of(dictionary_), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in W.pieces(batch.column(0)):
                total += np.bincount(bucketed(*payloads(found, data, offsets), buckets)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(range(buckets), pa.int32()), pa.array(total)], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Return floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) per bucket of B, in doubles."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = [(t + 1) * (s_all + n) / ((s + 1) * (t_all + n)) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def resample(
    docs: DataFrame,
    target: DataFrame,
    per_cent: int = 5,
    least_words: int = 20,
    seed: int = 42,
    buckets: int = BUCKETS,
    dictionary_bytes: int = DICTIONARY_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Return (doc_id, n_features, weight, score, rank) for every row of ``docs``, as drawn towards ``target`` (text).

    Of the documents with ``least_words`` words or more, ``per_cent`` in a hundred are drawn by score, ties to the smaller
    doc_id; the rank of others is null. Null and empty texts have no features and weight 0. A row without an id is noised as
    an empty one and comes behind rows of its score that have one; rows that repeat are drawn like any others. An empty
    target leaves its counts at zero. Further columns are ignored.
    """
    spark = docs.sparkSession
    one = F.col(text_col).cast("string").alias("text")
    source, wanted = docs.select(one), target.select(F.col("text").cast("string").alias("text"))
    words = spark.sparkContext.broadcast(dictionary(source.unionByName(wanted), dictionary_bytes))
    gain = gains(bucket_counts(source, words, buckets), bucket_counts(wanted, words, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton_of(words)
        for batch in batches:
            for row, data, offsets in W.pieces(batch.column(1)):
                rows = len(offsets) - 1
                crc, size, first = payloads(found, data, offsets)
                bucket, owner = bucketed(crc, size, first, buckets)
                weight = np.bincount(owner, gain[bucket], rows)  # whole numbers far below 2 ** 53
                columns = [np.diff(first), np.bincount(owner, minlength=rows), weight]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, rows), *[pa.array(x.astype(np.int64)) for x in columns]],
                    ["doc_id", "n_words", "n_features", "weight"],
                )

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), one).mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long"
    )
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = scored.withColumn("score", F.col("weight") + noise).withColumn("open", F.col("n_words") >= least_words)
    return ranked(reliable_checkpoint(scored), per_cent).select("doc_id", "n_features", "weight", "score", "rank")


def ranked(scored: DataFrame, per_cent: int) -> DataFrame:
    """Add ``rank`` to the ``per_cent`` in a hundred highest scores of the open rows of (doc_id, score, open, ...).

    Counts per range of scores find the least score that can be drawn, so only rows down to it are put in order.
    """
    opened = scored.filter("open")
    row = opened.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    wanted, low, high, above = per_cent * row["n"] // 100, row["low"], row["high"], 0
    none = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return scored.select("*", none)
    while high > low:
        # A thousand ranges at a time; the one that holds the last drawn row is cut up further.
        width = -(-(high - low + 1) // 1000)
        part = F.floor((F.col("score") - low) / width).cast("long").alias("part")
        counts = opened.filter(F.col("score").between(low, high)).groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect()
        for row in sorted(counts, reverse=True):
            if above + row["n"] >= wanted:
                break
            above += row["n"]
        low += row["part"] * width
        high = min(high, low + width - 1)
    near = F.col("open") & (F.col("score") >= low)
    last = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias("last")
    drawn = scored.filter(near).select("*", last, F.monotonically_increasing_id().alias("own"))
    placed = row_positions(drawn, [], [("score", False), ("last", True), ("own", True)], "rank")
    rank = F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank")
    return scored.filter(~near).select("*", none).unionByName(placed.select(*scored.columns, rank))
