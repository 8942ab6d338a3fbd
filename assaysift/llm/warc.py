"""Fixity audit of web archives: hash trees over records and offset ranges, compared from the roots downwards.

Records are hashed where they are read; from then on only digests move. A tree's lowest nodes cover offset ranges of fixed
size, so they hold a bounded number of records whatever the size of a file, and each level above joins ``FANOUT`` nodes.
Two replicas are compared by the roots of their files, and only below nodes that differ is the next level looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as win

from assaysift.session import reliable_checkpoint

#: log2 of the bytes that a lowest node covers, and of the nodes below one node.
RANGE_BITS = 17
FANOUT_BITS = 4


def record_bytes(record_id: Column, url: Column, payload: Column) -> Column:
    """Return a resource record of the archive format as text; nulls count as empty."""
    payload = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, payload, F.lit("\r\n\r\n"))


def catalogue(pages: DataFrame, payload: Column | None = None, per_file: int = 2048) -> DataFrame:
    """Return (file, offset, length, record, leaf): where an archive of ``pages`` holds each record, and its digest.

    Pages are laid down by id, ``per_file`` ids to a file. Rows without an id are spread over files below zero by a digest.
    ``payload`` stands for other bytes of the same length at the same place.
    """
    record = record_bytes(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select(
        F.col("page_id").cast("long").alias("record"),
        F.octet_length(record).cast("long").alias("length"),
        F.sha2(record_bytes(F.col("page_id"), F.col("url"), F.col("html") if payload is None else payload), 256).alias("leaf"),
        F.sha2(record, 256).alias("tie"),
    )
    file = F.coalesce(F.floor(F.col("record") / per_file), -1 - F.pmod(F.xxhash64("tie"), F.lit(1 << 20)))
    ordered = win.Window.partitionBy("file").orderBy("record", "tie").rowsBetween(win.Window.unboundedPreceding, -1)
    placed = rows.withColumn("file", file.cast("long")).withColumn("offset", F.coalesce(F.sum("length").over(ordered), F.lit(0)))
    return placed.select("file", "offset", "length", "record", "leaf")


def _level(nodes: DataFrame, index: Column, parts: list[str]) -> DataFrame:
    """Return (file, node, digest): digests of ordered runs of ``nodes``."""
    listed = F.array_sort(F.collect_list(F.struct(*parts)))
    text = F.array_join(F.transform(listed, lambda x: F.concat_ws(":", *[x[p].cast("string") for p in parts])), "|")
    return nodes.groupBy("file", index.cast("long").alias("node")).agg(F.sha2(text, 256).alias("digest"))


def tree(records: DataFrame, levels: int) -> list[DataFrame]:
    """Return the levels of the hash trees of ``records``, lowest first; the last holds one root per file."""
    out = [reliable_checkpoint(_level(records, F.shiftright("offset", RANGE_BITS), ["offset", "length", "leaf"]))]
    for _ in range(levels):
        out.append(reliable_checkpoint(_level(out[-1], F.shiftright("node", FANOUT_BITS), ["node", "digest"])))
    return out


def _differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Return (file, node) of the nodes that one side lacks or whose digests differ."""
    key = ["file", "node"]
    both = left.join(right.withColumnRenamed("digest", "other"), key, "full")
    return both.filter(~F.col("digest").eqNullSafe(F.col("other"))).select(*key)


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Return (file, offset, length, record, status) of the places where replicas differ.

    Both sides are (file, offset, length, record, leaf). ``status`` is changed where both have a record of other bytes,
    missing where only the left side has one and extra where only the right side has. Rows that one side repeats count
    once; rows without a file or an offset are left out. Two empty sides do not differ.
    """
    columns = ["file", "offset", "length", "record", "leaf"]
    sides = [
        reliable_checkpoint(x.select(*columns).filter("file is not null and offset is not null").dropDuplicates(["file", "offset", "length", "leaf"]))
        for x in (left, right)
    ]
    furthest = max(x.agg(F.max("offset")).first()[0] or 0 for x in sides) >> RANGE_BITS
    levels = -(-furthest.bit_length() // FANOUT_BITS)
    trees = [tree(x, levels) for x in sides]
    suspects = reliable_checkpoint(_differing(trees[0][levels], trees[1][levels]))
    for level in range(levels - 1, -1, -1):
        above = suspects.select("file", F.col("node").alias("up"))
        below = [t[level].withColumn("up", F.shiftright("node", FANOUT_BITS)).join(above, ["file", "up"], "left_semi") for t in trees]
        suspects = reliable_checkpoint(_differing(*[x.select("file", "node", "digest") for x in below]))
    found = [
        x.withColumn("node", F.shiftright("offset", RANGE_BITS)).join(suspects, ["file", "node"], "left_semi").select(*columns) for x in sides
    ]
    other = found[1].select("file", "offset", *[F.col(c).alias(f"other_{c}") for c in ("length", "record", "leaf")])
    both = found[0].join(other, ["file", "offset"], "full")
    same = F.col("leaf").eqNullSafe(F.col("other_leaf")) & F.col("length").eqNullSafe(F.col("other_length"))
    status = F.when(F.col("other_leaf").isNull(), "missing").when(F.col("leaf").isNull(), "extra").otherwise("changed")
    return both.filter(~same).select(
        "file", "offset", F.coalesce("length", "other_length").alias("length"), F.coalesce("record", "other_record").alias("record"), status.alias("status")
    )
