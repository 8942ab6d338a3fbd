"""Fill-in-middle transformation on a piece table.

A document is a list of descriptors (buffer, start, length) over two buffers that never change: its text and the sentinels.
Cutting splits the descriptor of the text, an arrangement permutes the parts and puts sentinels between them, the inverse
permutation restores them. Bytes are copied only where a text is asked for; digests stream the descriptors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaysift.llm import words as W

SENTINELS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
#: Order of the parts (0 prefix, 1 middle, 2 suffix) per form, with the sentinel before each.
ARRANGEMENTS = {"psm": ((0, "prefix"), (2, "suffix"), (1, "middle")), "spm": ((2, "suffix"), (0, "prefix"), (1, "middle"))}
_SENTINEL_BYTES = b"".join(SENTINELS.values())
_SENTINEL_AT = {name: 3 * i for i, name in enumerate(SENTINELS)}
_TEXT, _FIXED = 0, 1

#: A piece: buffer, first byte and number of bytes.
Piece = tuple[int, int, int]


def cut(pieces: list[Piece], places: list[int]) -> list[list[Piece]]:
    """Split descriptors at ascending byte places of the text that they make up; return the parts."""
    parts: list[list[Piece]] = [[]]
    at, left = 0, list(places)
    for buffer, start, size in pieces:
        while left and left[0] <= at + size:
            head = left.pop(0) - at
            if head:
                parts[-1].append((buffer, start, head))
            parts.append([])
            start, size, at = start + head, size - head, at + head
        if size:
            parts[-1].append((buffer, start, size))
            at += size
    return parts + [[] for _ in left]


def arrange(parts: list[list[Piece]], form: str) -> list[Piece]:
    """Return the descriptors of prefix, middle and suffix in the order of a form, with sentinels."""
    out: list[Piece] = []
    for part, sentinel in ARRANGEMENTS[form]:
        out.append((_FIXED, _SENTINEL_AT[sentinel], 3))
        out += parts[part]
    return out


def invert(output: bytes, form: str) -> list[Piece]:
    """Return the descriptors of the original order over an arranged text, which becomes the text buffer."""
    starts = []
    for _, sentinel in ARRANGEMENTS[form]:
        found = output.find(SENTINELS[sentinel], starts[-1] if starts else 0)
        if found < 0:
            raise ValueError(f"no sentinel of the {sentinel} in a text of form {form}")
        starts.append(found + 3)
    ends = [x - 3 for x in starts[1:]] + [len(output)]
    places = {part: (_TEXT, a, b - a) for (part, _), a, b in zip(ARRANGEMENTS[form], starts, ends, strict=True)}
    return [places[part] for part in range(3) if places[part][2]]


def views(pieces: list[Piece], text: bytes) -> Iterator[memoryview]:
    """Return the bytes behind each descriptor, without copying."""
    buffers = (memoryview(text), memoryview(_SENTINEL_BYTES))
    return (buffers[buffer][start : start + size] for buffer, start, size in pieces)


def digest(pieces: list[Piece], text: bytes) -> str:
    """Return the SHA-256 of what the descriptors make up, as lower-case hexadecimal."""
    total = hashlib.sha256()
    for view in views(pieces, text):
        total.update(view)
    return total.hexdigest()


def _drawn(seed: int, id_column: Column) -> list[Column]:
    """Return the first four 32-bit numbers of the digest of ``<seed>:<id>``; a missing id counts as no digits."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    hashed = F.sha2(key.cast("binary"), 256)
    return [F.conv(F.substring(hashed, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


_FIELDS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def transform(
    docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Return (doc_id, n, form, prefix_chars, middle_chars, output, output_sha256) for every row of ``docs``.

    A text is cut into n units, a word with the white space before it or white space at the end. ``rate`` per cent of the
    ids draw a fill-in-middle form, and ``spm`` per cent of these the order suffix, prefix, middle. Empty and null texts
    and texts that hold a sentinel stay plain, with null lengths. Everything depends on id and text alone, so rows that
    repeat get equal results; a missing id draws as an empty one. Further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = np.stack([np.asarray(batch.column(i)) for i in range(2, 6)], axis=1).astype(np.int64)
            for first_row, data, offsets in W.pieces(batch.column(1)):
                rows = len(offsets) - 1
                _, ends, first = W.spans(data, offsets, W.SPACED)
                counts = np.diff(first)
                sizes = np.diff(offsets)
                # White space after the last word is a unit of its own.
                last = np.where(counts > 0, ends[np.maximum(first[1:] - 1, 0)] if len(ends) else 0, offsets[:-1])
                units = counts + (last < offsets[1:])
                # Bytes that do not continue a code point, up to every place.
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                fields: list[tuple] = []
                raw = data.tobytes()
                for i in range(rows):
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    text, n = raw[a:b], int(units[i])
                    h = drawn[first_row + i]
                    whole = [(_TEXT, 0, len(text))] if text else []
                    if not text or h[2] % 100 >= rate or any(x in text for x in SENTINELS.values()):
                        fields.append((n, "plain", None, None, text, digest(whole, text)))
                        continue

                    def place(unit: int) -> int:
                        if unit == 0:
                            return 0
                        return int(sizes[i]) if unit > counts[i] else int(ends[first[i] + unit - 1]) - a

                    low, high = sorted((int(h[0] % (n + 1)), int(h[1] % (n + 1))))
                    x, y = place(low), place(high)
                    form = "spm" if h[3] % 100 < spm else "psm"
                    pieces = arrange(cut(whole, [x, y]), form)
                    chars = int(points[a + x] - points[a]), int(points[a + y] - points[a + x])
                    fields.append((n, form, *chars, b"".join(views(pieces, text)), digest(pieces, text)))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), None, pa.string()]
                columns = [pa.array(x, k) if k else pa.array(x, pa.binary()).cast(pa.string(), safe=False) for x, k in zip(zip(*fields, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first_row, rows), *columns],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"],
                )

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), text, *_drawn(seed, F.col(id_col)))
    return wanted.mapInArrow(run, _FIELDS)


def restore(arranged: DataFrame, keep_text: bool = True) -> DataFrame:
    """Add ``restored`` and ``restored_sha256`` to a table with ``output`` and ``form``: the text before the arrangement.

    Null outputs count as empty. ``keep_text`` False leaves both texts out and returns digests only.
    """
    others = [x for x in arranged.columns if x not in ("output", "restored", "restored_sha256")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = batch.column(1)
            for first_row, data, offsets in W.pieces(batch.column(0)):
                rows, raw, out = len(offsets) - 1, data.tobytes(), []
                for i, form in enumerate(forms.slice(first_row, rows).to_pylist()):
                    text = raw[offsets[i] : offsets[i + 1]]
                    if form in ARRANGEMENTS:
                        pieces = invert(text, form)
                    else:
                        pieces = [(_TEXT, 0, len(text))] if text else []
                    out.append((b"".join(views(pieces, text)) if keep_text else None, digest(pieces, text)))
                texts, digests = zip(*out, strict=True)
                added = [pa.array(digests, pa.string())]
                if keep_text:
                    added = [batch.column(0).slice(first_row, rows), pa.array(texts, pa.binary()).cast(pa.string(), safe=False), *added]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(j + 2).slice(first_row, rows) for j in range(len(others))], *added],
                    [*others, *(["output", "restored"] if keep_text else []), "restored_sha256"],
                )

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in arranged.select(*[f"`{x}`" for x in others]).schema]
    schema += ["output string", "restored string"] if keep_text else []
    return arranged.select("output", "form", *[f"`{x}`" for x in others]).mapInArrow(run, ", ".join([*schema, "restored_sha256 string"]))
