"""Removal of lines that many documents share."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaysift.llm.memory import giving_back, release
from assaysift.session import reliable_checkpoint

_SPACE = b" \t\n\x0b\x0c\r"
#: Lines that one Arrow batch of a task holds at most.
_LINES = 100_000


def _long(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "surrogatepass")) >= least)


def _mark(position: int, key: bytes) -> bytes:
    return struct.pack("<i", position) + xxhash.xxh3_128_digest(key)


def line_marks(texts: DataFrame, least: int) -> DataFrame:
    """Explode ``texts`` (doc, text) into (doc, mark) for every line whose key has ``least`` code points or more.

    A mark holds the line's position in four bytes and a 128-bit hash of its key: the line stripped of ASCII white space
    with A-Z lower-cased.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, marks = [], []

            def flush(ids):
                return pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows, pa.int32())), pa.array(marks, pa.binary())], ["doc", "mark"]
                )

            for row, text in enumerate(batch.column(1).to_pylist()):
                for position, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
                    if len(line) >= least and _long(key := line.strip(_SPACE).lower(), least):
                        rows.append(row)
                        marks.append(_mark(position, key))
                if len(rows) >= _LINES:
                    yield flush(batch.column(0))
                    rows, marks = [], []
            yield flush(batch.column(0))

    return texts.mapInArrow(giving_back(run), "doc long, mark binary")


def dropped_lines(texts: DataFrame, least: int, documents: int) -> DataFrame:
    """Return (doc, marks) with the lines that each document of ``texts`` (doc, text) loses."""
    lines = line_marks(texts.filter("doc is not null"), least).withColumn("key", F.substring("mark", 5, 16))
    # Counting distinct documents groups by (key, doc) first, so a line in a third of all documents is spread over tasks.
    common = (
        lines.groupBy("key")
        .agg(F.count_distinct("doc").alias("documents"), F.max("doc").alias("keeper"))
        .filter(F.col("documents") >= documents)
        .select("key", "keeper")
    )
    # The few common keys are stored, so lines are dealt for this join alone and adaptive execution splits the partition
    # that a very common line fills, or needs no shuffle at all where the table is small.
    gone = lines.join(reliable_checkpoint(common), "key").filter("doc <> keeper")
    return gone.groupBy("doc").agg(F.collect_set("mark").alias("marks"))


_LINES_TYPE = T.StructType(
    [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())]
)


def _kept_lines(text: str | None, marks) -> tuple[int, int, str]:
    lines = (text or "").split("\n")
    total = len(lines)
    drop = {bytes(x) for x in marks} if marks is not None else set()
    for position in sorted((struct.unpack_from("<i", x)[0] for x in drop), reverse=True):
        # Rows that repeat an id may hold other lines at this position, so the line itself has to match as well.
        if position < len(lines):
            key = lines[position].encode("utf-8", "surrogatepass").strip(_SPACE).lower()
            if _mark(position, key) in drop:
                del lines[position]
    return total, total - len(lines), "\n".join(lines)


@F.pandas_udf(_LINES_TYPE)
def _reassemble(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for text, marks in batches:
        yield pd.DataFrame([_kept_lines(*x) for x in zip(text, marks, strict=True)], columns=["n_lines", "n_dropped", "kept"])
        del text, marks
        release()


def dedup_lines(
    docs: DataFrame, least: int = 40, documents: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Return (row, lines) for every row of ``docs``: its columns as a struct, and (n_lines, n_dropped, kept).

    Lines end at a line feed. Lines whose key (ASCII white space stripped at both ends, A-Z lower-cased) has ``least`` code
    points or more and occurs in ``documents`` distinct ids or more are dropped, except in the largest id that holds it.
    The other lines stay in their order, as they were, joined by line feeds in ``kept``. A null or empty text is one empty
    line. Rows without an id are not counted and lose nothing; rows that repeat an id count as one document and each lose
    the lines they hold. Other columns may have any names.
    """
    rows = docs.select(
        F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")
    )
    marks = dropped_lines(rows.select("doc", "text"), least, documents)
    return rows.join(marks, "doc", "left").select("row", _reassemble("text", "marks").alias("lines"))


def drop_common_lines(docs: DataFrame, least: int = 40, documents: int = 5) -> DataFrame:
    """Return ``docs`` with the text that ``dedup_lines`` keeps and, where there is such a column, its length."""
    out = dedup_lines(docs, least, documents)
    kept = {"text": F.col("lines.kept"), "n_chars": F.length("lines.kept")}
    return out.select(
        *[
            (kept[c].cast(docs.schema[c].dataType) if c in kept else F.col("row").getField(c)).alias(c)
            for c in docs.columns
        ]
    )
