"""Training passages that copy, edit or paraphrase benchmark items.

Seeds are rare word n-grams of the items: three words out of at most four consecutive ones, so wherever a copy keeps three
of four words there is a seed. Rare means by chance: the frequencies of its words in the training texts make an n-gram
unlikely there, however often the passage itself has been copied. Bitmaps of fixed size, built from the seeds, travel to
all tasks, which keep only the surroundings of their hits; an exact join by n-gram then pairs passages with items, and a
local alignment of their words scores each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaysift.llm import words as W
from assaysift.llm.memory import giving_back
from assaysift.session import reliable_checkpoint

#: Bits of the bitmap that is sent to all tasks, whatever the number of items: 4 MB.
BITMAP_BITS = 1 << 25
_BLOCK_BITS = 1 << 15
#: An n-gram is rare if chance puts it into fewer documents than one in a hundred.
RARE = 0.01
#: Places of a seed's words from its first one on. Every choice of three out of four consecutive words is one of these.
SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: The one seed of an item of two words.
SHORT = (0, 1)
#: An item is aligned where one of so many of its seeds meets, at least one. With a third of its words replaced, an item of
#: n words keeps three of four words at n / 3 - 3 places or more, out of 3 n - 8 seeds.
SEEDS_PER_MEETING = 20
_MATCH, _MISS, _GAP = 2, -1, -1


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Return (item, words): hashed words of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in W.pieces(batch.column(1)):
                start, end, first = W.spans(data, offsets, W.ALNUM)
                words = W.word_hashes(data, start, end).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(words))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(offsets) - 1), lists], ["item", "words"])

    texts = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "item long, words array<long>")


def shaped(words: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Return hashes of the words at ``shape`` from every place on; rows are not told apart."""
    room = max(len(words) - shape[-1], 0)
    grams = np.full(room, len(shape) * 1000 + shape[-1] * 10 + shape[1], np.uint64)
    for i in shape:
        grams += words[i : i + room] * (W.mix(np.array([i + 1], np.uint64))[0] | np.uint64(1))
    return W.mix(grams)


def item_ngrams(items: DataFrame) -> DataFrame:
    """Return distinct (item, gram, parts) of ``items`` (item, words): n-grams with the single-word n-grams they hold.

    Items of two words have their whole sequence, all others every shape of three words that they have room for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            words = np.asarray(lists.flatten()).view(np.uint64)
            first = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            single, _ = W.ngrams(words, first, 1, False)
            for shape in (*SHAPES, SHORT):
                grams = shaped(words, shape)
                place = np.arange(len(grams))
                rows = np.searchsorted(first, place, "right") - 1
                fits = place + shape[-1] < first[rows + 1]
                fits &= (first[rows + 1] - first[rows] == 2) == (shape == SHORT)
                place, rows, n = place[fits], rows[fits], len(shape)
                parts = single[place[:, None] + np.array(shape)].reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)),
                        pa.array(grams[fits].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(parts) + 1, n, dtype=np.int32)), pa.array(parts.view(np.int64))),
                    ],
                    ["item", "gram", "parts"],
                )

    return items.mapInArrow(run, "item long, gram long, parts array<long>").distinct()


def _bitmaps(grams: DataFrame) -> dict[int, np.ndarray]:
    """Return a bitmap of the n-grams of each class of ``grams`` (gram, class), put together from blocks that Spark fills."""

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(_BLOCK_BITS, np.uint8)
        bits[rows["bit"].to_numpy() % _BLOCK_BITS] = 1
        head = {"class": [rows["class"].iloc[0]], "block": [int(rows["bit"].iloc[0]) // _BLOCK_BITS]}
        return pd.DataFrame({**head, "bits": [np.packbits(bits).tobytes()]})

    bit = F.shiftrightunsigned(F.col("gram"), 64 - (BITMAP_BITS.bit_length() - 1)).alias("bit")
    bits = grams.select("class", bit).distinct().withColumn("block", F.floor(F.col("bit") / _BLOCK_BITS))
    out: dict[int, np.ndarray] = {}
    for row in bits.groupBy("class", "block").applyInPandas(block, "class int, block long, bits binary").collect():
        low = row["block"] * _BLOCK_BITS // 8
        bitmap = out.setdefault(row["class"], np.zeros(BITMAP_BITS // 8, np.uint8))
        bitmap[low : low + _BLOCK_BITS // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out


def _hits(bitmap: np.ndarray, grams: np.ndarray) -> np.ndarray:
    bit = grams >> np.uint64(64 - (BITMAP_BITS.bit_length() - 1))
    return np.flatnonzero((bitmap[bit >> np.uint64(3)] >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8))) & np.uint8(1))


def word_counts(texts: DataFrame, bitmap) -> DataFrame:
    """Return (word, n): how often ``texts`` hold each word that the bitmap has; at null the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, total = bitmap.value, 0
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for _, data, offsets in W.pieces(batch.column(0)):
                start, end, first = W.spans(data, offsets, W.ALNUM)
                words, _ = W.ngrams(W.word_hashes(data, start, end), first, 1, False)
                total += len(words)
                found.append(words[_hits(bits, words)])
            words, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts, pa.int64())], ["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], ["word", "n"])

    return texts.select("text").mapInArrow(giving_back(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rare_seeds(grams: DataFrame, counts: DataFrame, documents: int) -> DataFrame:
    """Return (item, gram) of ``grams`` (item, gram, parts) with the n-grams that chance makes rare.

    Of every item the quarter that is least likely by chance is taken in any case, ties to the smaller hash, so an item
    made of common words alone has seeds as well. The pair of an item of two words has to be rare.
    """
    total = counts.filter("word is null").agg(F.sum("n")).first()[0] or 0
    known = counts.filter("word is not null").select("word", F.log(F.col("n") / F.lit(float(max(total, 1)))).alias("chance"))
    # A word that no text holds makes its n-grams useless as seeds, so an inner count of words drops them.
    likely = (
        grams.select("item", "gram", F.size("parts").alias("size"), F.explode("parts").alias("word"))
        .join(known, "word")
        .groupBy("item", "gram", "size")
        .agg(F.sum("chance").alias("chance"), F.count("*").alias("held"))
        .filter("held = size")
        .select("item", "gram", "size", (F.exp("chance") * float(total) / float(max(documents, 1))).alias("chance"))
    )
    # An item's n-grams are as many as its own words, so they are ranked within its row.
    ranked = likely.groupBy("item", "size").agg(F.array_sort(F.collect_list(F.struct("chance", "gram"))).alias("grams"))
    quarter = F.ceil(F.size("grams") / 4)
    kept = F.filter("grams", lambda x, i: (x["chance"] <= RARE) | ((i < quarter) & (F.col("size") > 2)))
    return ranked.select("item", F.explode(F.transform(kept, lambda x: x["gram"])).alias("gram"))


def passages(texts: DataFrame, anywhere, classes: list[tuple[int, int, int, object]], shapes: tuple[tuple[int, ...], ...]) -> DataFrame:
    """Return (doc, digest, class, first, words, grams): runs of words around hits, with the hits' n-grams.

    ``classes`` lists (class, reach, least, bitmap); the run around a hit of a class takes its reach on both sides, and runs
    of fewer than ``least`` hits are left out. ``anywhere`` is the bitmap of all classes.
    """

    def cut(batch: pa.RecordBatch, row: int, words: np.ndarray, first: np.ndarray, place: np.ndarray, grams: np.ndarray, kind: int, reach: int, least: int) -> pa.RecordBatch:
        rows = np.searchsorted(first, place, "right") - 1
        low = np.maximum(place - reach, first[rows])
        high = np.minimum(place + 4 + reach, first[rows + 1])
        new = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (low[1:] > high[:-1]))))
        last = np.concatenate((new[1:], [len(place)])) - 1
        enough = last - new + 1 >= least
        grams = grams[np.repeat(enough, last - new + 1)]
        new, last = new[enough], last[enough]
        held = np.concatenate(([0], np.cumsum(last - new + 1)))
        begin, stop = low[new], high[last]
        sizes = stop - begin
        bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)
        taken = words[np.repeat(begin, sizes) + at]
        # A passage is known by what it holds and where: rows that are alike in all that are one passage.
        digest = W.mix(np.add.reduceat(taken * (at.astype(np.uint64) | np.uint64(1)), bounds[:-1])) if len(new) else taken
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(row + rows[new])),
                pa.array(digest.view(np.int64)),
                pa.array(np.full(len(new), kind, np.int32)),
                pa.array(begin - first[rows[new]], pa.int64()),
                pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(taken.view(np.int64))),
                pa.ListArray.from_arrays(pa.array(held.astype(np.int32)), pa.array(grams.view(np.int64))),
            ],
            ["doc", "digest", "class", "first", "words", "grams"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in W.pieces(batch.column(1)):
                start, end, first = W.spans(data, offsets, W.ALNUM)
                words = W.word_hashes(data, start, end)
                places, found = [], []
                for shape in shapes:
                    grams = shaped(words, shape)
                    hits = _hits(anywhere.value, grams)
                    hits = hits[hits + shape[-1] < first[np.searchsorted(first, hits, "right")]]
                    places.append(hits)
                    found.append(grams[hits])
                place, grams = np.concatenate(places), np.concatenate(found)
                order = np.argsort(place, kind="stable")
                place, grams = place[order], grams[order]
                for kind, reach, least, bitmap in classes:
                    hits = _hits(bitmap.value, grams)
                    if len(hits):
                        yield cut(batch, row, words, first, place[hits], grams[hits], kind, reach, least)

    return texts.select("doc", "text").mapInArrow(
        giving_back(run), "doc long, digest long, class int, first long, words array<long>, grams array<long>"
    )


def _best_ends(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Return the best local alignment score of each pair and the index behind its last aligned word of the text.

    All pairs advance together, one item word at a time; gaps along a text are resolved by a running maximum.
    """
    m, w = max(map(len, items)), max(map(len, texts))
    text = np.zeros((len(items), w), np.int64)
    inside = np.zeros((len(items), w), bool)
    for i, x in enumerate(texts):
        text[i, : len(x)], inside[i, : len(x)] = x, True
    slope = -_GAP * np.arange(w, dtype=np.int32)
    row = np.zeros((len(items), w + 1), np.int32)
    best, ends = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    for k in range(m):
        here = np.array([k < len(x) for x in items])
        word = np.array([x[k] if k < len(x) else 0 for x in items], np.int64)
        score = np.where((text == word[:, None]) & inside, _MATCH, _MISS)
        new = np.maximum(np.maximum(row[:, :-1] + score, row[:, 1:] + _GAP), 0).astype(np.int32)
        new = np.maximum.accumulate(new + slope, axis=1) - slope
        row[here, 1:] = new[here]
        top = np.argmax(np.where(inside, row[:, 1:], 0), axis=1)
        value = row[np.arange(len(items)), top + 1]
        better = here & (value > best)
        best[better], ends[better] = value[better], top[better] + 1
    return best, ends


def alignments(items: list[np.ndarray], texts: list[np.ndarray]) -> list[tuple[float, int, int]]:
    """Return (score, start, end) per pair: the alignment score's share of a full match, and its words in the text."""
    order = sorted(range(len(items)), key=lambda i: len(items[i]) * len(texts[i]))
    out: list = [None] * len(items)
    at = 0
    while at < len(order):
        # Pairs of like size go together, as many as a few million cells hold.
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * max(len(texts[i]) for i in order[at : stop + 1]) <= 200_000:
            stop = min(len(order), stop + max(1, (stop - at) // 4))
        part = order[at:stop]
        best, ends = _best_ends([items[i] for i in part], [texts[i] for i in part])
        _, back = _best_ends([items[i][::-1] for i in part], [texts[i][:e][::-1] for i, e in zip(part, ends, strict=True)])
        for i, b, e, r in zip(part, best.tolist(), ends.tolist(), back.tolist(), strict=True):
            out[i] = (b / (_MATCH * max(len(items[i]), 1)), e - r, e)
        at = stop
    return out


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    least: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Return (doc_id, item_id, score, first_word, n_words) for every document and item aligned with ``least`` or more.

    Words are runs of ASCII letters and digits and everything beyond ASCII, A-Z lower-cased. The score is that of the best
    local alignment (2 for a match, -1 for a replaced, inserted or missing word) of an item with the document, as a share
    of a full match; the span of the document's words is that of the best passage, the first of equal ones. Items of two
    words count where chance makes the pair rare. Items of one word, empty and null ones are too short to tell and match
    nothing. Rows without an id are left out on both sides; rows that repeat an id count together. Further columns are
    ignored.
    """
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).filter("doc is not null")
    # Items of like length, by powers of two, share a reach: the longest of them.
    known = reliable_checkpoint(
        item_words(items, item_col, item_text_col)
        .filter((F.col("item").isNotNull()) & (F.size("words") >= 2))
        .distinct()
        .withColumn("class", F.ceil(F.log2(F.size("words"))).cast("int"))
    )
    grams = reliable_checkpoint(item_ngrams(known.select("item", "words")))
    none = np.zeros(BITMAP_BITS // 8, np.uint8)
    held = _bitmaps(grams.select(F.explode("parts").alias("gram"), F.lit(0).alias("class"))).get(0, none)
    counts = reliable_checkpoint(word_counts(texts, context.broadcast(held)))
    seeds = rare_seeds(grams, counts, texts.count()).join(known.groupBy("item").agg(F.collect_set("class").alias("class")), "item")
    # One id may stand at several items; each of their lengths is looked for.
    seeds = reliable_checkpoint(seeds.select("item", "gram", F.explode("class").alias("class")))
    # What one id holds beyond an item's own n-grams raises nothing for it.
    held = seeds.groupBy("item").agg(F.countDistinct("gram").alias("seeds"))
    own = F.least(F.col("seeds"), 3 * F.size("words") - 8)
    known = known.join(held, "item").withColumn("need", F.greatest(F.floor(own / SEEDS_PER_MEETING), F.lit(1)))
    known = reliable_checkpoint(known.select("item", "class", "words", "need"))
    # One row per power of two.
    sizes = known.groupBy("class").agg(F.max(F.size("words")).alias("reach"), F.min("need").alias("least"))
    sizes = sizes.orderBy("class").collect()
    shapes = (*SHAPES, SHORT) if sizes and sizes[0]["class"] == 1 else SHAPES
    bitmaps = _bitmaps(seeds)
    classes = [(r["class"], r["reach"], r["least"], context.broadcast(bitmaps[r["class"]])) for r in sizes]
    everywhere = np.bitwise_or.reduce([none, *bitmaps.values()])
    found = reliable_checkpoint(passages(texts, context.broadcast(everywhere), classes, shapes))
    key = ["doc", "digest", "class", "first"]
    met = (
        found.select(*key, F.explode(F.array_distinct("grams")).alias("gram"))
        .join(seeds, ["gram", "class"])
        .groupBy(*key, "item")
        .agg(F.countDistinct("gram").alias("met"))
    )
    pairs = met.join(known.withColumnRenamed("words", "item_words"), ["item", "class"]).filter("met >= need")
    joined = pairs.join(found.select(*key, "words").dropDuplicates(key), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                lists = [[np.asarray(x.values) for x in part.column(i)] for i in (3, 4)]
                done = alignments(lists[1], lists[0])
                score, begin, end = zip(*done, strict=True)
                first = np.asarray(part.column(2)) + np.array(begin)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(score, pa.float64()),
                        pa.array(first, pa.int64()),
                        pa.array(np.array(end) - np.array(begin), pa.int64()),
                    ],
                    ["doc_id", "item_id", "score", "first_word", "n_words"],
                )

    scored = joined.select("doc", "item", "first", "words", "item_words").mapInArrow(
        giving_back(run), "doc_id long, item_id long, score double, first_word long, n_words long"
    )
    rank = F.struct("score", -F.col("first_word"), "n_words")
    best = scored.filter(F.col("score") >= least).groupBy("doc_id", "item_id").agg(F.max(rank).alias("best"))
    return best.select(
        "doc_id", "item_id", "best.score", (-F.col("best.col2")).alias("first_word"), F.col("best.n_words").alias("n_words")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, least: float = 0.5) -> DataFrame:
    """Return the rows of ``docs`` that hold no passage of ``items``; rows without an id stay."""
    found = reliable_checkpoint(find_contamination(docs, items, least).select(F.col("doc_id").alias("found")).distinct())
    return docs.join(found.hint("shuffle_hash"), docs["doc_id"].cast("long") == found["found"], "left_anti")
