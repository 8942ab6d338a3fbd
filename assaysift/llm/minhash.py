"""Near-duplicate documents by circulant MinHash and exact Jaccard verification.

The universe of shingles is the ring of 32-bit integers. A first permutation scatters a document's shingles over it; a
second one is read at the k-th circular shift for the k-th coordinate, so two permutations give all coordinates. Bands of
coordinates propose candidates, and only exact comparisons of full shingle sets link documents.

* Copies with equal sets are one class before any candidate is formed, so a huge group of copies is one row from then on.
* Documents that meet in bands form candidate groups. Every member is compared with its group's centre, the document that
  meets most others. What that joins needs no further pairs.
* In groups that are not joined so, members outside the centre's part meet every other member, in blocks of bounded size
  whose intersections are counted as one product of incidence matrices. A unit returns at most a spanning forest, so no
  list of pairs exists anywhere. Documents of the centre's own part are never compared with one another again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaysift.llm import words as W
from assaysift.llm.graph import components
from assaysift.llm.memory import giving_back
from assaysift.session import reliable_checkpoint

#: Documents and shingles that one side of a block holds at most on average.
BLOCK_ROWS = 128
BLOCK_SHINGLES = 1_000_000
#: Chance of a pair at the threshold to share no band.
MISS = 1e-5


def band_count(threshold: float, rows: int, miss: float = MISS) -> int:
    """Return how many bands of ``rows`` coordinates find a pair at the threshold with a chance of 1 - ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def _permute(x: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """Scramble 32-bit numbers in place by a bijection."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, None)):
        np.right_shift(x, np.uint32(shift), out=scratch)
        np.bitwise_xor(x, scratch, out=x)
        if factor:
            np.multiply(x, np.uint32(factor), out=x)
    return x


def circulant_signature(shingles: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Return ``size`` coordinates per non-empty set; ``at`` holds each set's first index."""
    ring = (W.mix(shingles) >> np.uint64(32)).astype(np.uint32)  # the first permutation
    scratch, shifted = np.empty_like(ring), np.empty_like(ring)
    out = np.empty((size, len(at)), np.uint32)
    for k in range(size):
        # One step of the circular shift is an odd stride of the ring, itself a relabelling of single steps.
        np.add(ring, np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF), out=shifted)
        np.minimum.reduceat(_permute(shifted, scratch), at, out=out[k])
    return out


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, distinct shingles, offsets) of runs of rows."""
    for row, data, offsets in W.pieces(column):
        start, end, first = W.spans(data, offsets, W.SPACED)
        grams, at = W.ngrams(W.word_hashes(data, start, end), first, n, True)
        unique = [np.unique(grams[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
        bounds = np.zeros(len(at), np.int64)
        np.cumsum([len(x) for x in unique], out=bounds[1:])
        yield row, np.concatenate(unique), bounds


def sketch(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """Return (doc, n_shingles, s1, s2, bands): set size, a 128-bit digest of the set and one key per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.zeros(batch.num_rows, np.int64)
            one, two = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
            keys = np.zeros((batch.num_rows, bands), np.uint64)
            for row, grams, at in _sets(batch.column(1), n):
                counts = np.diff(at)
                full = np.flatnonzero(counts)
                size[row : row + len(counts)] = counts
                if not len(full):
                    continue
                begin = at[:-1][full]
                one[row + full] = np.add.reduceat(W.mix(grams), begin)
                two[row + full] = np.add.reduceat(W.mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begin)
                signature = circulant_signature(grams, begin, bands * rows)
                for b in range(bands):
                    key = np.full(len(full), b + 1, np.uint64)
                    for k in range(b * rows, (b + 1) * rows):
                        key = W.mix(key ^ signature[k].astype(np.uint64))
                    keys[row + full, b] = key
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists],
                ["doc", "n_shingles", "s1", "s2", "bands"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        giving_back(run), "doc long, n_shingles long, s1 long, s2 long, bands array<long>"
    )


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """Return (doc, shingles) with sorted distinct shingles of ``docs`` (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, grams, at in _sets(batch.column(1), n):
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(at) - 1), lists], ["doc", "shingles"])

    return docs.select("doc", "text").mapInArrow(giving_back(run), "doc long, shingles array<long>")


def _forest(unit: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Compare the members of one unit and return edges that join different parts, no cycle among them."""
    unit = unit.reset_index(drop=True)
    sizes = unit.shingles.map(len).to_numpy()
    owner = np.repeat(np.arange(len(unit)), sizes)
    values, which, often = np.unique(np.concatenate(unit.shingles.to_list()), return_inverse=True, return_counts=True)
    # Only shingles that several members hold can meet; they are renumbered and handled in slices of columns.
    rank = np.cumsum(often > 1) - 1
    common = often[which] > 1
    owner, column = owner[common], rank[which[common]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(unit), len(unit)), np.float64)
    width = 4096
    for low in range(0, int(rank[-1]) + 1, width):
        i, j = np.searchsorted(column, [low, low + width])
        matrix = np.zeros((len(unit), width), np.float32)
        matrix[owner[i:j], column[i:j] - low] = 1
        shared += matrix @ matrix.T
    shared = shared.astype(np.int64)
    linked = np.triu(shared * den >= num * (sizes[:, None] + sizes[None, :] - shared), 1)
    side = unit.side.to_numpy()
    linked &= ~((side[:, None] == 1) & (side[None, :] == 1))
    part = {x: x for x in unit.part}

    def top(x):
        while part[x] != x:
            part[x] = part[part[x]]
            x = part[x]
        return x

    out = []
    docs, parts = unit.doc.to_numpy(), unit.part.to_numpy()
    for x, y in zip(*np.nonzero(linked)):
        p, q = top(parts[x]), top(parts[y])
        if p != q:
            part[max(p, q)] = min(p, q)
            out.append((docs[x], docs[y]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def near_duplicates(
    docs: DataFrame,
    num: int = 80,
    den: int = 100,
    shingle_words: int = 5,
    band_rows: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Return (doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Two documents are linked when den * intersection >= num * union of their sets of distinct word shingles; A-Z are
    lower-cased and words end at ASCII white space. A text of fewer words has its whole sequence as one shingle; an empty
    or null one has an empty set and no link. ``component_id`` is the smallest id that links reach, ``kept`` tells whether
    it is the row's own. Rows that repeat an id each count as a document; a row without an id is linked with nothing, has
    no component and is kept. Further columns of ``docs`` are ignored.
    """
    bands = band_count(num / den, band_rows)
    sketches = reliable_checkpoint(sketch(docs, id_col, text_col, shingle_words, bands, band_rows))
    known = sketches.filter("doc is not null and n_shingles > 0")
    digest = ["n_shingles", "s1", "s2"]
    flat = known.select("doc", *digest, *[F.col("bands")[i].alias(f"b{i}") for i in range(bands)])
    # Equal sets have equal bands, so any member's will do; plain columns keep this a hash aggregate.
    classes = reliable_checkpoint(
        flat.groupBy(*digest).agg(
            F.min("doc").alias("doc"), F.count("*").alias("copies"), *[F.first(f"b{i}").alias(f"b{i}") for i in range(bands)]
        )
    )
    entries = classes.select(F.explode(F.array(*[f"b{i}" for i in range(bands)])).alias("band"), "doc")
    full = entries.groupBy("band").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n"))
    stars = reliable_checkpoint(entries.join(full.filter("low <> high").select("band", "low", "n"), "band").select("doc", "low", "n"))
    groups = components(stars.select(F.col("doc").alias("a"), F.col("low").alias("b")))
    # The centre of a group: the member with most meetings, the smallest id of several.
    meets = stars.groupBy("doc").agg(F.sum("n").alias("meets"))
    centred = reliable_checkpoint(groups.withColumnRenamed("node", "doc").join(meets, "doc"))
    centre = centred.groupBy("component").agg(F.min_by("doc", F.struct(-F.col("meets"), "doc")).alias("centre"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    members = groups.select(F.col("node").alias("doc"), F.col("component").alias("group"))
    # Only members of candidate groups are shingled again; the member table is hashed, so texts are not sorted.
    sets = shingle_sets(texts.join(members.select("doc").hint("shuffle_hash"), "doc", "left_semi"), shingle_words)
    sets = reliable_checkpoint(sets.join(members, "doc"))
    middle = sets.join(centre, (F.col("doc") == F.col("centre")) & (F.col("group") == F.col("component"))).select(
        "group", "centre", F.col("shingles").alias("inner")
    )
    shared = F.size(F.array_intersect("shingles", "inner"))
    union = F.size("shingles") + F.size("inner") - shared
    first = reliable_checkpoint(
        sets.join(middle, "group")
        .filter((F.col("doc") != F.col("centre")) & (shared * den >= union * num))
        .select(F.col("doc").alias("a"), F.col("centre").alias("b"))
    )
    # Parts after the first round: the centre's (side 1) and every member it did not join (side 0).
    part = members.join(first.select(F.col("a").alias("doc"), F.col("b").alias("joined")).distinct(), "doc", "left").join(
        centre.withColumnRenamed("component", "group"), "group"
    )
    part = part.select(
        "doc",
        "group",
        F.when(F.col("doc") == F.col("centre"), F.col("centre")).otherwise(F.coalesce("joined", "doc")).alias("part"),
        (F.col("joined").isNotNull() | (F.col("doc") == F.col("centre"))).cast("int").alias("side"),
    )
    weights = sets.groupBy("doc").agg(F.max(F.size("shingles")).alias("weight"))
    part = reliable_checkpoint(part.join(weights, "doc"))

    def blocks(side: int):
        rows, weight = F.sum((F.col("side") == side).cast("int")), F.sum(F.when(F.col("side") == side, F.col("weight")))
        return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(F.coalesce(weight, F.lit(0)) / BLOCK_SHINGLES)).cast("int")

    # The centre itself has been compared with every member, so it takes no part in blocks.
    others = part.filter("doc <> part or side = 0")
    open_groups = others.groupBy("group").agg(blocks(0).alias("outer"), blocks(1).alias("inner")).filter("outer > 0")
    units = others.join(open_groups, "group").withColumn(
        "block", F.pmod(F.xxhash64("doc"), F.when(F.col("side") == 0, F.col("outer")).otherwise(F.col("inner"))).cast("int")
    )
    both = F.when(
        F.col("side") == 0,
        F.concat(
            F.transform(
                F.sequence(F.lit(0), F.col("outer") - 1),
                lambda i: F.struct(
                    F.lit(0).alias("kind"), F.least(F.col("block"), i).alias("x"), F.greatest(F.col("block"), i).alias("y")
                ),
            ),
            F.when(
                F.col("inner") > 0,
                F.transform(
                    F.sequence(F.lit(0), F.greatest(F.col("inner"), F.lit(1)) - 1),
                    lambda i: F.struct(F.lit(1).alias("kind"), F.col("block").alias("x"), i.alias("y")),
                ),
            ).otherwise(F.array().cast("array<struct<kind:int,x:int,y:int>>")),
        ),
    ).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("outer") - 1),
            lambda i: F.struct(F.lit(1).alias("kind"), i.alias("x"), F.col("block").alias("y")),
        )
    )
    units = units.select("doc", "group", "part", "side", F.explode(both).alias("unit"))
    second = (
        units.join(sets.select("doc", "shingles"), "doc")
        .groupBy("group", "unit")
        .applyInPandas(lambda unit: _forest(unit, num, den), "a long, b long")
    )
    linked = components(first.unionByName(second))
    final = classes.select("doc", "copies", *digest).join(linked.withColumnRenamed("node", "doc"), "doc", "left")
    final = final.filter("copies > 1 or component is not null").select(
        *digest, F.coalesce("component", "doc").alias("component")
    )
    found = sketches.select("doc", *digest).join(final, digest, "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    return found.select(
        F.col("doc").alias("doc_id"),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """Return the rows of ``docs`` (doc_id, text, ...) that are the smallest id of their group; rows without an id stay.

    Rows that repeat an id are one document here: they stay or go together.
    """
    gone = reliable_checkpoint(near_duplicates(docs, num, den).filter("not kept").select(F.col("doc_id").alias("gone")).distinct())
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"].cast("long") == gone["gone"], "left_anti")
