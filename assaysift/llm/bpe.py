"""Encoding with a byte-pair vocabulary through a table of distinct words, and decoding through a table of pieces.

Words are counted in Spark and each distinct word is encoded once. The commonest words, at most ``HEAD_WORDS`` of them, go
to all tasks as a table of bounded size; the ids of all other words are joined back by word and by document. Pieces come
from the vocabulary file, whose size is fixed, and are looked up by id.

Supported are tokenizer files whose pre-tokenizer keeps the matches of one pattern, none of which holds white space, whose
words are then spelt in byte symbols, and which have no decoder, so pieces are joined by blanks.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assaysift.llm.memory import giving_back, release
from assaysift.session import reliable_checkpoint

#: Words of the broadcast table at most; with their ids they take about 12 MB.
HEAD_WORDS = 3 << 17
#: Longer words never enter that table.
HEAD_CHARS = 64
#: Distinct entries that a task's counter holds before it is emptied.
_COUNTED = 150_000
_ODD_SPACE = "\x1c\x1d\x1e\x1f"
_SPACE = regex.compile(r"\p{White_Space}+")
#: Beyond the old alphabets the character tables of libraries differ by edition; there the library's own are asked.
_NEWER = regex.compile("[^\0-\u04ff]")


class Splitter:
    """Splits texts as the tokenizer file says: special strings, Unicode form, case, then pattern."""

    def __init__(self, spec: str) -> None:
        spec = json.loads(spec)
        steps = spec["pre_tokenizer"]["pretokenizers"]
        normal = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if [x["type"] for x in steps] != ["Split", "ByteLevel"] or normal != ["NFC", "Replace", "Lowercase"] or spec["decoder"]:
            raise ValueError("unsupported kind of tokenizer file")
        # White space of the pattern is the Unicode property, without the four separators that Python adds.
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        bare = spec | {"added_tokens": [], "truncation": None, "padding": None, "pre_tokenizer": steps[0]}
        bare["model"] = spec["model"] | {"vocab": {}, "merges": []}  # only the rules of form and splitting are asked
        self.library = Tokenizer.from_str(json.dumps(bare))
        self.special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.split_special = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)")

    def chunks(self, text: str) -> list[str]:
        """Return runs between white space, lower-cased; special strings stand alone."""
        if not any(x in text for x in self.special):
            return self._chunks(text)
        out, at = [], 0
        for found in self.split_special.finditer(text):
            out += self._chunks(text[at : found.start()])
            out.append(" " + found[0])  # a blank occurs in no other chunk
            at = found.end()
        return out + self._chunks(text[at:])

    def _chunks(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")  # such texts are in composed form already
        except UnicodeEncodeError:
            if _NEWER.search(text):
                return [x for x in _SPACE.split(self.library.normalizer.normalize_str(text)) if x]
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return [x for x in _SPACE.split(text) if x] if any(x in text for x in _ODD_SPACE) else text.split()

    def words(self, chunk: str) -> list[str]:
        """Return the words of a chunk; special strings keep their mark."""
        if chunk[0] == " ":
            return [chunk]
        if not chunk.isascii() and _NEWER.search(chunk):
            return [chunk[i:j] for _, (i, j) in self.library.pre_tokenizer.pre_tokenize_str(chunk)]
        if chunk.isalpha():
            return [chunk]
        if chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.pattern.findall(chunk)


def word_encoder(spec: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Return a function from single words to their ids."""
    bare = json.loads(spec)
    special = {" " + x["content"]: x["id"] for x in bare["added_tokens"]}
    bare |= {"normalizer": None, "added_tokens": [], "truncation": None, "padding": None}
    # Many words are encoded as one text, a line each.
    lines = {"type": "Split", "pattern": {"String": "\n"}, "behavior": "Removed", "invert": False}
    bare["pre_tokenizer"]["pretokenizers"] = [lines, bare["pre_tokenizer"]["pretokenizers"][-1]]
    model = Tokenizer.from_str(json.dumps(bare))

    def encode(words: list[str]) -> list[np.ndarray]:
        found = model.encode("\n".join(words), add_special_tokens=False)
        ids, at = np.array(found.ids, "<i4"), np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(words) + 1))
        return [np.array([special[w]], "<i4") if w in special else ids[at[i] : at[i + 1]] for i, w in enumerate(words)]

    return encode


_made: dict = {}


def _once(kind: str, source, make):
    """Build what a broadcast value describes once per worker process; only the latest of a kind is kept."""
    if kind not in _made or _made[kind][0] is not source:
        _made.pop(kind, None)
        _made[kind] = (source, make(source))
    return _made[kind][1]


def count_words(texts: DataFrame, spec) -> DataFrame:
    """Return (word, n) with all distinct words of ``texts`` (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _made.pop("head", None)  # of an earlier run
        splitter = _once("split", spec.value, Splitter)
        chunks: Counter = Counter()

        def flush():
            words: Counter = Counter()
            for chunk, n in chunks.items():
                for word in splitter.words(chunk):
                    words[word] += n
            chunks.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for text in (x for low in range(0, batch.num_rows, 1000) for x in batch.column(0).slice(low, 1000).to_pylist()):
                chunks.update(splitter.chunks(text))
                if len(chunks) > _COUNTED:
                    yield flush()
        yield flush()

    return texts.select("text").mapInArrow(giving_back(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode_words(words: DataFrame, spec, kind: str) -> DataFrame:
    """Return ``words`` (word, n) with ``ids``, the ids of each word as little-endian integers of that kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _once("encode", spec.value, word_encoder)
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                ids = [x.astype(kind).tobytes() for x in encode(part.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], ["word", "n", "ids"])

    return words.select("word", "n").mapInArrow(giving_back(run), "word string, n long, ids binary")


def _head(table: DataFrame) -> tuple[str, bytes, bytes]:
    """Return the commonest words, joined by line feeds, with their ids and the byte lengths of these.

    The cut runs along eighths of powers of two of the counts, so it needs a few hundred sums and no sorting.
    """
    level = F.floor(F.log2("n") * 8).cast("int").alias("level")
    short = table.filter((F.length("word") <= HEAD_CHARS) & (F.length("ids") <= 16 * HEAD_CHARS))
    taken, least = 0, None
    for row in sorted(short.groupBy(level).count().collect(), reverse=True):
        taken += row["count"]
        if taken > HEAD_WORDS:
            break
        least = row["level"]
    if least is None:
        return "", b"", b""
    rows = short.filter(F.floor(F.log2("n") * 8) >= least).select("word", "ids").toArrow()
    ids = rows.column("ids").to_pylist()
    return "\n".join(rows.column("word").to_pylist()), b"".join(ids), np.array([len(x) for x in ids], "<u2").tobytes()


def _forget_encoder() -> None:
    """Free the vocabulary that a worker holds for encoding words, once these have been encoded."""
    if _made.pop("encode", None) is not None:
        release()


def _head_table(head: tuple[str, bytes, bytes]) -> dict[str, bytes]:
    _forget_encoder()
    words, ids, lengths = head
    out: dict[str, bytes] = {}
    if words:
        at = 0
        for word, n in zip(words.split("\n"), memoryview(lengths).cast("H"), strict=True):
            out[word] = ids[at : at + n]
            at += n
    return out


def _missing(splitter: Splitter, table: dict[str, bytes], text: str) -> list[str]:
    """Return the distinct words of a text that the table lacks, in order of code points."""
    other: set = set()
    for chunk in set(splitter.chunks(text)):
        # A chunk that is itself a word of the table consists of just that word.
        if chunk not in table:
            other.update(w for w in splitter.words(chunk) if w not in table)
    return sorted(other)


def _other_words(texts: DataFrame, spec, head) -> DataFrame:
    """Return (key, place, word): the words of each text that the broadcast table lacks, numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, table = _once("split", spec.value, Splitter), _once("head", head.value, _head_table)
        for batch in batches:
            rows, places, words = [], [], []

            def flush(keys):
                return pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(rows, pa.int32())), pa.array(places, pa.int32()), pa.array(words, pa.string())],
                    ["key", "place", "word"],
                )

            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_py()
                other = _missing(splitter, table, text)
                rows += [row] * len(other)
                places += range(len(other))
                words += other
                if len(rows) > _COUNTED:
                    yield flush(batch.column(0))
                    rows, places, words = [], [], []
            yield flush(batch.column(0))

    return texts.select("key", "text").mapInArrow(giving_back(run), "key long, place int, word string")


def _packed(texts: DataFrame) -> DataFrame:
    """Return (key, doc, packed) with compressed texts, which are what is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_encoder()
        press = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                packed = [press.compress(x.encode("utf-8", "surrogatepass")) for x in part.column(2).to_pylist()]
                columns = [*part.columns[:2], pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "doc", "packed"])

    return texts.select("key", "doc", "text").mapInArrow(giving_back(run), "key long, doc long, packed binary")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (doc_id, ids) for every row of ``docs``: the ids of its whole text, without special tokens of its own.

    A null or empty text has no ids. Strings of special tokens in a text become these tokens. Rows may repeat or lack an
    id; further columns are ignored.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # The key gathers a text's words; rows that are alike in id and text share one list. Should the keys of two others
    # ever meet, their lists no longer fit and the words are encoded on the spot.
    texts = texts.withColumn("key", F.xxhash64("doc", "text"))
    kind = "<u2" if len(piece_table(path)) <= 1 << 16 else "<i4"
    table = reliable_checkpoint(encode_words(count_words(texts, spec), spec, kind))
    head = spark.sparkContext.broadcast(_head(table))
    other = (
        _other_words(texts, spec, head)
        .join(table.select("word", "ids"), "word")
        .groupBy("key")
        .agg(F.array_sort(F.collect_set(F.struct("place", "ids"))).alias("other"))
        .select("key", F.col("other.ids").alias("ids"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, known = _once("split", spec.value, Splitter), _once("head", head.value, _head_table)
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            docs_, out, size = [], [], 0

            def flush():
                lengths = np.zeros(len(out) + 1, np.int32)
                np.cumsum([len(x) for x in out], out=lengths[1:])
                ids = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(out).astype(np.int32)))
                return pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), ids], ["doc_id", "ids"])

            for low in range(0, batch.num_rows, 1000):
                columns = [batch.column(i).slice(low, 1000).to_pylist() for i in range(3)]
                for doc, packed, ids in zip(*columns, strict=True):
                    text = open_.decompress(packed).decode("utf-8", "surrogatepass")
                    chunks = splitter.chunks(text)
                    parts = list(map(known.get, chunks))
                    if None in parts:
                        open_chunks = {i: splitter.words(chunks[i]) for i, found in enumerate(parts) if found is None}
                        # The same words in the same order as _missing gives them.
                        missing = sorted({w for words in open_chunks.values() for w in words if w not in known})
                        if len(missing) != len(ids or ()):
                            ids = [x.astype(kind).tobytes() for x in word_encoder(spec.value)(missing)]
                        own = dict(zip(missing, map(bytes, ids or ()), strict=True))
                        for i, words in open_chunks.items():
                            parts[i] = b"".join([known[w] if w in known else own[w] for w in words])
                    docs_.append(doc)
                    out.append(np.frombuffer(b"".join(parts), kind))
                    size += len(out[-1])
                    if size > 2 << 20:
                        yield flush()
                        docs_, out, size = [], [], 0
            if docs_:
                yield flush()
        _made.clear()  # workers live on, perhaps for other work

    joined = _packed(texts).join(other, "key", "left").select("doc", "packed", "ids")
    return joined.mapInArrow(giving_back(run), "doc_id long, ids array<int>")


def piece_table(path: str) -> list[str]:
    """Return the piece of every id of a tokenizer file; ids that it lacks have none."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pieces = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec["added_tokens"]}
    out = [""] * (max(pieces.values()) + 1)
    for piece, i in pieces.items():
        out[i] = piece
    return out


def _lookup(pieces: np.ndarray, ids: pa.ListScalar) -> tuple[np.ndarray, str]:
    """Return the ids of a row and the pieces that they stand for, joined by blanks."""
    ids = np.asarray(ids.values) if ids.is_valid else np.zeros(0, np.int32)
    known = ids[(ids >= 0) & (ids < len(pieces))]
    return ids, " ".join([x for x in pieces[known].tolist() if x])


def decode(spark: SparkSession, encoded: DataFrame, path: str) -> DataFrame:
    """Return ``encoded`` (doc_id, ids) with ``decoded``: the pieces of its ids, special ones included, joined by blanks.

    Null or no ids decode to an empty text; an id that the vocabulary lacks is left out.
    """
    pieces = spark.sparkContext.broadcast(piece_table(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(pieces.value, dtype=object)
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                text = [_lookup(table, x)[1] for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(giving_back(run), "doc_id long, ids array<int>, decoded string")


def round_trip_digests(spark: SparkSession, encoded: DataFrame, path: str) -> DataFrame:
    """Return (doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encoded`` (doc_id, ids) and what ``decode`` gives for it.

    Digests are lower-case hexadecimal SHA-256: of the ids as little-endian unsigned 32-bit integers, and of the decoded
    text in UTF-8.
    """
    pieces = spark.sparkContext.broadcast(piece_table(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(pieces.value, dtype=object)
        for batch in batches:
            sizes, one, two = [], [], []
            for x in batch.column(1):
                ids, text = _lookup(table, x)
                sizes.append(len(ids))
                one.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                two.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encoded.select("doc_id", "ids").mapInArrow(
        giving_back(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
