"""Tanimoto similarity between sets of integers: nearest labelled neighbour, distance sums, k-medoids.

No pair table is ever materialised. For the nearest neighbour, a task holds a bounded block of reference sets and reduces
each of its rows against it at once, so a bit set in a third of all fingerprints costs no more than any other; up to
``BROADCAST_ELEMENTS`` reference elements are broadcast, beyond that blocks meet the rows in a keyed co-group. Sums of
distances work on pairs of packed blocks of the upper triangle, at every size. Medoids are compared with each point's
nearest one so far, as far as the triangle inequality does not rule them out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaysift.functions.numeric import col
from assaysift.functions.ordering import null_safe_join
from assaysift.functions.setindex import SetIndex
from assaysift.operators.keys import require_columns
from assaysift.session import reliable_checkpoint

BROADCAST_SETS = 20_000
BROADCAST_ELEMENTS = 8_000_000
BLOCK_SETS = 4_096
CHUNK_ROWS = 20_000
#: Blocks per cluster that distance sums go up to before blocks grow, and the elements of a block at most.
MOST_BLOCKS = 32
BLOCK_ELEMENTS = 1_000_000


def word_set(text: Column) -> Column:
    """Return the sorted distinct hashes of the whitespace-separated lower-case words of a text."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def positive_dimensions(vector: Column) -> Column:
    """Return the positions of the positive entries of a vector."""
    at = F.transform(vector, lambda x, i: F.when(x > 0, i.cast("long")))
    return F.filter(at, lambda i: i.isNotNull())


def tanimoto(a: Column, b: Column) -> Column:
    """Similarity of two sets held as arrays of distinct elements."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(F.try_divide(common, union))


def _fits(references: DataFrame, sets: str) -> bool:
    row = references.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(sets)).alias("e")).first()
    return row["n"] <= BROADCAST_SETS and (row["e"] or 0) <= BROADCAST_ELEMENTS


def _sets(column: pd.Series) -> list[np.ndarray]:
    return [np.asarray(v, dtype=np.int64) for v in column]


def _plain(column: pd.Series) -> np.ndarray:
    """Return objects with None for every missing value, which equals itself."""
    return np.array([None if pd.isna(v) else v for v in column] + [None], dtype=object)[:-1]


def _nearest(rows: pd.DataFrame, refs: pd.DataFrame, index: SetIndex) -> pd.DataFrame:
    """Return, per row, the most similar reference of its group and of its group and target.

    References come sorted by (group, id, target), so the first maximum is the smallest name.
    """
    n = len(rows)
    out = {
        "id_any": np.full(n, None, dtype=object),
        "target_any": np.full(n, None, dtype=object),
        "sim_any": np.full(n, np.nan),
        "id_same": np.full(n, None, dtype=object),
        "sim_same": np.full(n, np.nan),
    }
    ref_group, ref_target, ref_id = (_plain(refs[c]) for c in ("group", "target", "id"))
    groups, targets = _plain(rows["group"]), _plain(rows["target"])
    for at, similarity in index.tanimoto(_sets(rows["set"])):
        local = np.arange(at.start, min(at.stop, n))
        for group in dict.fromkeys(groups[local]):
            here = local[groups[local] == group]
            columns = np.flatnonzero(ref_group == group)
            if not len(columns):
                continue
            block = similarity[here - at.start][:, columns]
            best = columns[block.argmax(axis=1)]
            out["sim_any"][here] = block.max(axis=1)
            out["id_any"][here], out["target_any"][here] = ref_id[best], ref_target[best]
            for target in dict.fromkeys(targets[here]):
                mine = here[targets[here] == target]
                same = np.flatnonzero((ref_group == group) & (ref_target == target))
                if not len(same):
                    continue
                block = similarity[mine - at.start][:, same]
                out["sim_same"][mine] = block.max(axis=1)
                out["id_same"][mine] = ref_id[same[block.argmax(axis=1)]]
    keys = rows.drop(columns=["set"]).reset_index(drop=True)
    return pd.concat([keys, pd.DataFrame(out)], axis=1)


def _id_kinds(df: DataFrame, names: Sequence[str]) -> dict[str, str]:
    kinds = dict(df.dtypes)
    return {n: kinds[n] for n in names}


def nearest_labelled(
    queries: DataFrame,
    labelled: DataFrame,
    set_column: str,
    group: str = "target_class",
    force_blocks: bool = False,
) -> DataFrame:
    """Return the most similar labelled set per query, within its group and within its group and target.

    Ties go to the smallest (id, target). A query sharing no element with any labelled set still gets the first one,
    with similarity 0; a query whose group has no labelled sets gets NULLs. A missing group or target is a value of its
    own, equal to another missing one. (group, id, target) identifies a query; of labelled sets that repeat those, the
    smallest counts.
    """
    for frame, name in ((queries, "query table"), (labelled, "labelled table")):
        require_columns(frame, [group, "id", "target", set_column], name)
    q = queries.select(col(group).alias("group"), "id", "target", col(set_column).cast("array<bigint>").alias("set"))
    r = labelled.select(
        col(group).alias("group"), "id", "target", col(set_column).cast("array<bigint>").alias("set")
    )
    r = r.groupBy("group", "id", "target").agg(F.min("set").alias("set"))
    kinds = _id_kinds(q, ["group", "id", "target"])
    schema = (
        f"group {kinds['group']}, id {kinds['id']}, target {kinds['target']}, id_any {kinds['id']}, "
        f"target_any {kinds['target']}, sim_any double, id_same {kinds['id']}, sim_same double"
    )
    order = ["group", "id", "target"]
    if not force_blocks and _fits(r, "set"):
        refs = r.toPandas().sort_values(order, na_position="first").reset_index(drop=True)
        if refs.empty:
            found = q.select("group", "id", "target").selectExpr(
                "*",
                f"cast(null as {kinds['id']}) id_any",
                f"cast(null as {kinds['target']}) target_any",
                "cast(null as double) sim_any",
                f"cast(null as {kinds['id']}) id_same",
                "cast(null as double) sim_same",
            )
        else:
            shared = q.sparkSession.sparkContext.broadcast((refs.drop(columns=["set"]), SetIndex(_sets(refs["set"]))))

            def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                names, index = shared.value
                for batch in batches:
                    yield _nearest(batch, names, index)

            found = q.mapInPandas(scan, schema)
    else:
        found = _nearest_by_blocks(q, r, schema, order)
    return found.select(
        col("group").alias(group),
        "id",
        "target",
        col("id_any").alias("nearest_labeled_id"),
        col("target_any").alias("nearest_labeled_target"),
        F.nanvl(col("sim_any"), F.lit(None)).alias("nearest_labeled_tanimoto"),
        col("id_same").alias("nearest_labeled_same_target_id"),
        F.nanvl(col("sim_same"), F.lit(None)).alias("nearest_labeled_same_target_tanimoto"),
    )


def _parts(sets: DataFrame, rows: int) -> int:
    """Return into how many parts sets are cut, so that neither their rows nor their elements outgrow a task."""
    size = sets.agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.size("set"), F.lit(0)).cast("long")).alias("e")).first()
    return max(1, ceil(size["n"] / rows), ceil((size["e"] or 0) / BLOCK_ELEMENTS))


def _nearest_by_blocks(q: DataFrame, r: DataFrame, schema: str, order: list[str]) -> DataFrame:
    """Meet every query chunk with every block of references once and keep the best partial result per query."""
    blocks, chunks = _parts(r, BLOCK_SETS), _parts(q, CHUNK_ROWS)
    digest = F.xxhash64("group", "id", "target")
    rows = q.withColumn("chunk", F.pmod(digest, F.lit(chunks)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    refs = r.withColumn("block", F.pmod(digest, F.lit(blocks)).cast("int")).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    )

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.drop(columns=["block", "chunk"])
        right = right.sort_values(order, na_position="first").reset_index(drop=True)
        return _nearest(left, right, SetIndex(_sets(right["set"])))

    refs = refs.toDF(*refs.columns)  # both sides may come from the same table
    partial = rows.groupBy("chunk", "block").cogroup(refs.groupBy("chunk", "block")).applyInPandas(meet, schema)
    for c in ("sim_any", "sim_same"):
        partial = partial.withColumn(c, F.nanvl(col(c), F.lit(None)))
    # Highest similarity first, then smallest name: one ascending struct.
    best_any = F.min(F.when(col("sim_any").isNotNull(), F.struct(-col("sim_any"), "id_any", "target_any")))
    best_same = F.min(F.when(col("sim_same").isNotNull(), F.struct(-col("sim_same"), "id_same")))
    reduced = partial.groupBy("group", "id", "target").agg(best_any.alias("a"), best_same.alias("s"))
    first = null_safe_join(q.select("group", "id", "target"), reduced, ["group", "id", "target"], "left")
    return first.select(
        "group",
        "id",
        "target",
        F.col("a.id_any"),
        F.col("a.target_any"),
        (-F.col("a.col1")).alias("sim_any"),
        F.col("s.id_same"),
        (-F.col("s.col1")).alias("sim_same"),
    )


def _as_sets(values: pa.Array) -> list[np.ndarray]:
    """Return the rows of a list column as arrays."""
    at = np.asarray(values.offsets)
    flat = np.asarray(values.flatten(), dtype=np.int64)
    return [flat[a:b] for a, b in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=True)]


def _block_counts(sets: DataFrame, block_sets: int | None = None) -> DataFrame:
    """Return into how many blocks the sets of every code are dealt.

    Blocks hold ``block_sets`` sets at least, and more rather than that there are over MOST_BLOCKS of them, so what their pairs
    shuffle follows the input. Only at BLOCK_SETS * 4 sets, or BLOCK_ELEMENTS elements, a block is full.
    """
    least, most = float(block_sets or BLOCK_SETS), float(max(4 * BLOCK_SETS, block_sets or 0))
    each = F.least(F.lit(most), F.greatest(F.lit(least), F.col("sets") / MOST_BLOCKS))
    blocks = F.greatest(F.ceil(F.col("sets") / each), F.ceil(F.col("elements") / BLOCK_ELEMENTS)).cast("int")
    counts = sets.groupBy("code").agg(F.count(F.lit(1)).alias("sets"), F.sum(F.size("set").cast("long")).alias("elements"))
    return counts.select("code", blocks.alias("blocks"))


def _sum_units(sets: DataFrame, block_sets: int | None = None) -> DataFrame:
    """Return, per row of stored (code, sid, set, n), the sum of its distances to the n points of every set of its code.

    The sets of a code are dealt into blocks, and every block is packed into one stored row. A unit of work is a pair of
    blocks of the upper triangle: it counts each pair of sets once and adds its distance to both sides.
    """
    dealt = sets.join(_block_counts(sets, block_sets), "code").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    rows = dealt.groupBy("code", "block").agg(F.first("blocks").alias("blocks"), F.collect_list(F.struct("sid", "n", "set")).alias("r"))
    packed = reliable_checkpoint(
        rows.select("code", "block", "blocks", "r.sid", "r.n", F.transform("r", lambda x: x["set"]).alias("sets"))
    )
    # Each block meets itself and the blocks behind it; a block of its own stands for both sides.
    columns = ["sid", "n", "sets"]
    left = packed.select("code", F.col("block").alias("a"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("b"), F.lit(0).alias("side"), *columns)
    right = packed.where("block > 0").select("code", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("a"), F.col("block").alias("b"), F.lit(1).alias("side"), *columns)
    total = packed.agg(F.sum(F.col("blocks") - F.col("block"))).first()[0] or 1
    # A number of tasks of its own: units take long for their bytes.
    tasks = int(max(1, min(total, 8 * sets.sparkSession.sparkContext.defaultParallelism)))

    def unit(table: pa.Table) -> pa.Table:
        table = table.sort_by("side").combine_chunks()
        keys, weights, members = [], [], []
        for row in range(table.num_rows):
            keys.append(table.column("sid").chunk(0)[row].values.to_numpy())
            weights.append(table.column("n").chunk(0)[row].values.to_numpy().astype(np.float64))
            members.append(_as_sets(table.column("sets").chunk(0)[row].values))
        ours, theirs = members[0], members[-1]
        one, two = np.zeros(len(ours)), np.zeros(len(theirs))
        for at, similarity in SetIndex(theirs).tanimoto(ours):
            gap = np.subtract(1.0, similarity, out=similarity)
            one[at] = gap @ weights[-1]
            if len(members) > 1:
                two += weights[0][at] @ gap
        sums = [one, two][: len(members)]
        return pa.table({"sid": pa.array(np.concatenate(keys)), "total": pa.array(np.concatenate(sums))})

    met = left.unionByName(right).repartition(tasks, "code", "a", "b")
    parts = met.groupBy("code", "a", "b").applyInArrow(unit, "sid long, total double")
    return parts.groupBy("sid").agg(F.sum("total").alias("total"))


def _elements(set_column: str) -> Column:
    """Return sets in one order, so that equal ones are equal as values; a missing one is empty."""
    return F.array_sort(F.coalesce(col(set_column).cast("array<bigint>"), F.array().cast("array<bigint>")))


def distance_sums(
    points: DataFrame, key: str, set_column: str, cluster: str | None = None, block_sets: int | None = None
) -> DataFrame:
    """Return, per point, the sum of its Tanimoto distances to all points (of its cluster).

    Equal sets of a cluster are compared once and count as often as they occur. One plan serves every size; only units, blocks
    and one sum per set and unit are shuffled. A missing cluster is a value of its own, equal to another missing one; rows that
    repeat a key within a cluster add up to one row.
    """
    p = points.select(
        col(key).alias("key"),
        _elements(set_column).alias("set"),
        (col(cluster) if cluster else F.lit(0)).cast("int").alias("cluster"),
    )
    code = F.coalesce(F.col("cluster").cast("long"), F.lit(1 << 32)).alias("code")  # a missing one lies outside of int
    p = p.select("key", "set", code)
    distinct = p.groupBy("code", "set").agg(F.count(F.lit(1)).alias("n"))
    distinct = reliable_checkpoint(distinct.withColumn("sid", F.monotonically_increasing_id()))
    sums = distinct.join(_sum_units(distinct, block_sets), "sid").select("code", "set", "total")
    back = F.when(F.col("code") < (1 << 32), F.col("code")).cast("int").alias("cluster")
    found = p.join(sums, ["code", "set"]).groupBy("code", "key").agg(F.sum("total").alias("total"))
    return found.select(col("key").alias(key), back, "total")


def _distance(elements: Column, other: Sequence[int]) -> Column:
    """Return the Tanimoto distance of a set column to one set."""
    return 1.0 - tanimoto(elements, F.array(*[F.lit(int(x)) for x in other]).cast("array<bigint>"))


def _gap(a: Sequence[int], b: Sequence[int]) -> float:
    common = len(set(a) & set(b))
    union = len(set(a)) + len(set(b)) - common
    return 1.0 - (common / union if union else 1.0)


def assign_to_medoids(
    points: DataFrame, key: str, set_column: str, medoids: Sequence[tuple], former: Sequence[tuple] | None = None
) -> DataFrame:
    """Add ``cluster`` and ``distance``: the nearest of a few (key, set) medoids, the earlier one on ties.

    With ``former``, the medoids that the columns ``cluster`` and ``distance`` of ``points`` tell of, only what changed is
    scored: a point whose medoid stays is compared with medoids that are new, and with those alone that the triangle
    inequality of the distance lets come as near, which is when the two medoids are at most twice as far apart.
    """
    sets = col(set_column).cast("array<bigint>")
    every = [F.struct(_distance(sets, s).alias("distance"), F.lit(i).alias("cluster")) for i, (_, s) in enumerate(medoids)]
    best = F.array_min(F.array(*every))
    if former is not None:
        kept = [i for i, m in enumerate(former) if i < len(medoids) and medoids[i][0] == m[0]]
        fresh = [i for i in range(len(medoids)) if i not in kept]
        options = [F.struct(F.col("distance"), F.col("cluster"))]
        for i in fresh:
            # Rounding aside, no nearer than that: the slack keeps ties exact.
            apart = F.get(F.array(*[F.lit(_gap(m[1], medoids[i][1])) for m in former]), F.col("cluster"))
            options.append(F.when(apart <= 2 * F.col("distance") + F.lit(1e-9), every[i]))
        nearer = F.array_min(F.array(*options))
        best = F.when(F.col("cluster").isin(kept), nearer).otherwise(best) if kept else best
    found = points.withColumn("__near", best)
    return (
        found.withColumn("cluster", F.col("__near.cluster").cast("int")).withColumn("distance", F.col("__near.distance")).drop("__near")
    )


def k_medoids(
    points: DataFrame,
    key: str,
    set_column: str,
    n_clusters: int,
    max_iter: int = 100,
    block_sets: int | None = None,
) -> DataFrame:
    """Cluster sets around medoids under Tanimoto distance; returns key, cluster id and cluster size.

    The first medoid has the smallest total distance, each next one lies farthest from those chosen. Then clusters move
    to their best member until nothing changes or the cost stops falling. Every step stores each point's nearest medoid
    and its distance, and the next one scores new medoids only. Equal sets are one row until the end. Only medoids reach
    the driver.
    """
    if max_iter <= 0:
        raise ValueError("max_iter must be positive")
    p = reliable_checkpoint(points.select(col(key).alias("key"), _elements(set_column).alias("set")))
    n = p.count()
    if not 1 <= n_clusters <= n:
        raise ValueError("n_clusters must be between 1 and the number of points")
    number = F.monotonically_increasing_id().alias("sid")
    # Equal sets move together, led by their smallest key, unless a medoid has to be a copy of another one.
    near = reliable_checkpoint(p.groupBy("set").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n")).select("*", number))
    together = near.count() >= n_clusters
    if not together:
        near = reliable_checkpoint(p.select("set", "key", F.lit(1).cast("long").alias("n"), number))

    def centres(rows: DataFrame, cluster: Column) -> dict[int, tuple]:
        """Return per cluster the set with the smallest total distance to its members."""
        totals = _sum_units(rows.select(cluster.cast("long").alias("code"), "sid", "set", "n"), block_sets)
        first = F.struct(F.round("total", 9), "key")
        found = rows.withColumn("__cluster", cluster).join(totals, "sid").groupBy("__cluster").agg(F.min_by(F.struct("key", "set"), first).alias("m"))
        return {r["__cluster"]: (r["m"]["key"], r["m"]["set"]) for r in found.collect()}

    medoids = [centres(near, F.lit(0))[0]]
    near = reliable_checkpoint(assign_to_medoids(near, "key", "set", medoids))
    while len(medoids) < n_clusters:
        chosen = [k for k, _ in medoids]
        far = near.where(~col("key").isin(chosen))
        best = far.agg(F.min_by(F.struct("key", "set"), F.struct(-col("distance"), "key")).alias("m")).first()["m"]
        former, medoids = medoids, [*medoids, (best["key"], best["set"])]
        near = reliable_checkpoint(assign_to_medoids(near, "key", "set", medoids, former))
    cost = near.agg(F.sum(F.col("distance") * F.col("n"))).first()[0]
    for _ in range(max_iter):
        moved = centres(near, F.col("cluster"))
        # A cluster that lost all members keeps its medoid.
        candidate = [moved.get(i, m) for i, m in enumerate(medoids)]
        if [k for k, _ in candidate] == [k for k, _ in medoids]:
            break
        closer = reliable_checkpoint(assign_to_medoids(near, "key", "set", candidate, medoids))
        new_cost = closer.agg(F.sum(F.col("distance") * F.col("n"))).first()[0]
        if new_cost >= cost:
            break
        medoids, cost, near = candidate, new_cost, closer
    # One row per cluster.
    sizes = near.groupBy("cluster").agg(F.sum("n").alias("chem_cluster_size"))
    members = p.join(near.select("set", "cluster"), "set") if together else near
    out = members.join(F.broadcast(sizes), "cluster")
    return out.select(
        col("key").alias(key), col("cluster").alias("chem_cluster_id"), "chem_cluster_size"
    ).orderBy("chem_cluster_id", key)
