"""Orderings that scale: ranks, positions, prefix sums and exact quantiles inside groups.

A window partitioned by a low-cardinality group sorts the whole group in one task, so nothing here does that unless it is
told to. By default (``split``, at every size) rows are dealt by ranges of (group, order) and stored with the number of
their range as a slot; windows then run per (group, slot), and the few totals of earlier slots are added. Sums and
quantiles collapse rows of equal value to one row first (map-side combine); ranks deal equal values by row number and
settle the ends of slots in a small table. So a value shared by a third of all rows fills no task.

``window`` is the plain form, one shuffle by group, for callers who know that every group fits into a task.

Both give the same numbers. Placed rows are written to the shared checkpoint folder, so ranges are drawn once: a chain of
orderings costs a sum of passes, not a product, and lost executors only re-read files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaysift.functions.numeric import col
from assaysift.session import reliable_checkpoint

# A value held by more rows than this is replicated when its ranks go back to the rows.
COPY_ROWS = 4_000_000
ROW_NUMBER = "__row"


def choose(df: DataFrame, strategy: str) -> str:
    """Resolve ``auto`` to ``split``: one plan for every size."""
    if strategy == "auto":
        return "split"
    if strategy not in {"window", "split"}:
        raise ValueError(f"Unknown ordering strategy: {strategy}")
    return strategy


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where NULL matches NULL, keeping the left keys."""
    renamed = right.select(
        *[col(k).alias(f"__r_{i}") for i, k in enumerate(keys)],
        *[col(c) for c in right.columns if c not in set(keys)],
    )
    condition = [col(k).eqNullSafe(F.col(f"__r_{i}")) for i, k in enumerate(keys)]
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__r_{i}" for i in range(len(keys))])


def _place(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Deal rows by ranges of (group, order) and store them with the number of their range as ``__slot``.

    Equal keys share a range; a group may span several, in ascending order.
    """
    ranged = df.repartitionByRange(*[col(c) for c in (*group, *order)])
    return reliable_checkpoint(ranged.withColumn("__slot", F.spark_partition_id()))


def _slot_offsets(placed: DataFrame, group: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Return per (group, slot) the totals of earlier slots and of the whole group."""
    keys = [col(g) for g in group]
    per_slot = placed.groupBy(*keys, "__slot").agg(*[e.alias(f"__s_{m}") for m, e in sums.items()])
    # At most one row per slot of a group reaches this window.
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__slot")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    return per_slot.select(
        *keys,
        "__slot",
        *[F.coalesce(F.sum(f"__s_{m}").over(earlier), F.lit(0)).alias(f"__before_{m}") for m in sums],
        *[F.sum(f"__s_{m}").over(whole).alias(f"__total_{m}") for m in sums],
    )


def prefix_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    measures: Mapping[str, Column] | None = None,
    strategy: str = "auto",
) -> DataFrame:
    """Collapse rows to distinct (group, order) keys with running totals in ascending order of the key.

    The result holds, besides the keys, ``n``, ``n_before`` and ``n_total`` (rows at the key, strictly below it and in
    the group), and for each measure ``m`` the sums ``m``, ``m_before`` and ``m_total``.
    """
    measures = dict(measures or {})
    strategy = choose(df, strategy)
    keys = [*group, *order]
    base = df.groupBy(*[col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(m) for m, e in measures.items()]
    )
    names = ["n", *measures]
    parts = [col(g) for g in group] or [F.lit(0)]
    ascending = [col(o) for o in order]
    if strategy == "window":
        running = Window.partitionBy(*parts).orderBy(*ascending).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*parts)
        return base.select(
            *[col(k) for k in keys],
            *[col(m) for m in names],
            *[F.coalesce(F.sum(col(m)).over(running), F.lit(0)).alias(f"{m}_before") for m in names],
            *[F.sum(col(m)).over(whole).alias(f"{m}_total") for m in names],
        )
    placed = _place(base, group, order)
    offsets = _slot_offsets(placed, group, {m: F.sum(col(m)) for m in names})
    joined = null_safe_join(placed, offsets, [*group, "__slot"])
    running = (
        Window.partitionBy(*[col(g) for g in group], F.col("__slot"))
        .orderBy(*ascending)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return joined.select(
        *[col(k) for k in keys],
        *[col(m) for m in names],
        *[
            (F.col(f"__before_{m}") + F.coalesce(F.sum(col(m)).over(running), F.lit(0))).alias(f"{m}_before")
            for m in names
        ],
        *[F.col(f"__total_{m}").alias(f"{m}_total") for m in names],
    )


def attach_by_key(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    size_column: str | None = None,
    how: str = "left",
) -> DataFrame:
    """Join one lookup row to every row with the same keys, replicating the lookup rows of heavily shared keys.

    ``size_column`` tells how many rows share a lookup row. A lookup row with s rows gets s // COPY_ROWS + 1 copies,
    and the rows choose a copy by content hash, which leaves identical rows together. There are at most rows / COPY_ROWS
    such keys, which is what makes broadcasting their list safe.
    """
    if size_column is None:
        return null_safe_join(rows, lookup, keys, how)
    copies = F.floor(col(size_column) / F.lit(COPY_ROWS)).cast("int") + 1
    heavy = lookup.where(col(size_column) >= COPY_ROWS).select(*[col(k) for k in keys], copies.alias("__copies"))
    salted_rows = null_safe_join(rows, F.broadcast(heavy), keys, "left").withColumn(
        "__salt",
        F.pmod(F.xxhash64(*[col(c) for c in rows.columns]), F.coalesce("__copies", F.lit(1))).cast("int"),
    ).drop("__copies")
    salted_lookup = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    return null_safe_join(salted_rows, salted_lookup, [*keys, "__salt"], how).drop("__salt")


def average_rank(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    rank_column: str,
    total_column: str | None = None,
    strategy: str = "auto",
) -> DataFrame:
    """Add the 1-based average-tie rank of a nullable double inside its group; missing values rank NULL."""
    strategy = choose(df, strategy)
    parts = [col(g) for g in group] or [F.lit(0)]
    clean = F.nanvl(col(value).cast("double"), F.lit(None).cast("double"))
    if strategy == "window":
        ranked = df.withColumn("__v", clean)
        ordered = Window.partitionBy(*parts).orderBy(F.col("__v").asc_nulls_last())
        ties = Window.partitionBy(*parts, F.col("__v"))
        rank = F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)
        ranked = ranked.withColumn(rank_column, F.when(F.col("__v").isNotNull(), rank))
        if total_column:
            ranked = ranked.withColumn(total_column, F.count("__v").over(Window.partitionBy(*parts)))
        return ranked.drop("__v")
    rows = df if ROW_NUMBER in df.columns else numbered(df)
    ranked = _split_rank(rows.withColumn("__v", clean), group, "__v", rank_column, total_column)
    return ranked.select(*df.columns, *[c for c in (rank_column, total_column) if c and c not in df.columns])


def numbered(df: DataFrame) -> DataFrame:
    """Store rows with a number of their own, ``__row``, which later reads cannot change.

    Rankings of a frame that carries it store it no second time.
    """
    return reliable_checkpoint(df.withColumn(ROW_NUMBER, F.monotonically_increasing_id()))


def _split_rank(
    rows: DataFrame, group: Sequence[str], value: str, rank_column: str, total_column: str | None
) -> DataFrame:
    """Rank numbered rows where they lie.

    Rows are dealt by (group, value, row number), so a value of any frequency spreads over slots. Inside a slot ties are
    peers of a window; only its smallest and largest value can go on in other slots, and these two per slot are
    settled in a table of one row per (group, slot).
    """
    keys = [col(g) for g in group]
    known = _place(rows.where(col(value).isNotNull()), group, [value, ROW_NUMBER])
    by_value = Window.partitionBy(*keys, F.col("__slot")).orderBy(col(value))
    peers = by_value.rangeBetween(Window.currentRow, Window.currentRow)
    local = known.withColumn("__below", F.rank().over(by_value) - 1).withColumn("__same", F.count(F.lit(1)).over(peers))
    slots = local.groupBy(*keys, "__slot").agg(
        F.count(F.lit(1)).alias("__n"),
        F.min(col(value)).alias("__lo"),
        F.max(col(value)).alias("__hi"),
        F.max(F.when(F.col("__below") == 0, F.col("__same"))).alias("__n_lo"),
        F.max_by("__same", col(value)).alias("__n_hi"),
    )
    in_order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__slot")
    slots = slots.withColumn("__before", F.sum("__n").over(in_order) - F.col("__n"))
    ends = F.array(
        F.struct(F.col("__lo").alias("v"), F.col("__n_lo").alias("n"), F.col("__before").alias("at")),
        F.struct(F.col("__hi").alias("v"), F.col("__n_hi").alias("n"), (F.col("__before") + F.col("__n") - F.col("__n_hi")).alias("at")),
    )
    ends = F.when(F.col("__lo") == F.col("__hi"), F.slice(ends, 1, 1)).otherwise(ends)
    # The ends of all slots that share a value: where its run starts and how long it is.
    one_value = Window.partitionBy(*keys, F.col("__end.v"))
    spread = slots.withColumn("__end", F.explode(ends)).select(
        *keys,
        "__slot",
        "__lo",
        "__hi",
        "__before",
        (F.col("__end.v") == F.col("__lo")).alias("__low"),
        F.min("__end.at").over(one_value).alias("__at"),
        F.sum("__end.n").over(one_value).alias("__count"),
    )
    settled = spread.groupBy(*keys, "__slot").agg(
        *[F.first(c).alias(c) for c in ("__lo", "__hi", "__before")],
        *[F.max(F.when(F.col("__low"), F.col(c))).alias(f"{c}_lo") for c in ("__at", "__count")],
        *[F.max(F.when(~F.col("__low"), F.col(c))).alias(f"{c}_hi") for c in ("__at", "__count")],
    )
    if total_column:
        totals = slots.groupBy(*keys).agg(F.sum("__n").alias(total_column))
        if group:
            settled = null_safe_join(settled, totals, group)
        else:
            settled = settled.withColumn(total_column, totals.scalar())
    joined = null_safe_join(local, settled, [*group, "__slot"])

    def pick(stem: str, inside: Column) -> Column:
        at_end = F.when(col(value) == F.col("__lo"), F.col(f"{stem}_lo")).when(col(value) == F.col("__hi"), F.col(f"{stem}_hi"))
        return at_end.otherwise(inside)

    rank = pick("__at", F.col("__before") + F.col("__below")) + (pick("__count", F.col("__same")) + 1) / F.lit(2.0)
    added = [c for c in (rank_column, total_column) if c]
    ranked = joined.withColumn(rank_column, rank).select(*rows.columns, *[c for c in added if c not in rows.columns])
    missing = rows.where(col(value).isNull()).withColumn(rank_column, F.lit(None).cast("double"))
    if total_column:
        # One row per group.
        if group:
            missing = null_safe_join(missing, totals, group, "left")
        else:
            missing = missing.withColumn(total_column, totals.scalar())
        missing = missing.withColumn(total_column, F.coalesce(total_column, F.lit(0)))
    return ranked.unionByName(missing)


def pair_ranks(
    df: DataFrame, group: Sequence[str], values: Mapping[str, str], strategy: str = "auto"
) -> DataFrame:
    """Add average ranks of several complete double columns (no missing values) within the group."""
    strategy = choose(df, strategy)
    if strategy == "window":
        out = df
        for value, rank in values.items():
            out = average_rank(out, group, value, rank, strategy=strategy)
        return out
    rows = numbered(df)
    out = rows
    for value, rank in values.items():
        out = _split_rank(out, group, value, rank, None)
    return out.drop(ROW_NUMBER)


def percent_rank_average(
    df: DataFrame, group: Sequence[str], value: str, out: str, strategy: str = "auto"
) -> DataFrame:
    """Add average-tie rank divided by the number of non-missing values of the group."""
    ranked = average_rank(df, group, value, "__avg_rank", "__avg_count", strategy)
    share = F.try_divide(F.col("__avg_rank"), F.col("__avg_count"))
    return ranked.withColumn(out, share).drop("__avg_rank", "__avg_count")


def row_positions(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[tuple[str, bool]],
    position_column: str,
    total_column: str | None = None,
    strategy: str = "auto",
) -> DataFrame:
    """Add the 1-based position of each row in its group.

    ``order`` lists (column, ascending); descending columns must be numeric. Together the columns must identify a row,
    as a stable order needs a tie-break.
    """
    strategy = choose(df, strategy)
    keyed = df
    names = []
    for i, (name, ascending) in enumerate(order):
        keyed = keyed.withColumn(f"__o{i}", col(name) if ascending else -col(name))
        names.append(f"__o{i}")
    parts = [col(g) for g in group] or [F.lit(0)]
    ascending_keys = [F.col(n).asc_nulls_first() for n in names]
    if strategy == "window":
        ordered = Window.partitionBy(*parts).orderBy(*ascending_keys)
        out = keyed.withColumn(position_column, F.row_number().over(ordered).cast("long"))
        if total_column:
            out = out.withColumn(total_column, F.count(F.lit(1)).over(Window.partitionBy(*parts)))
        return out.drop(*names)
    placed = _place(keyed, group, names)
    offsets = _slot_offsets(placed, group, {"n": F.count(F.lit(1))})
    # Slots hold comparable row counts, so the few offset rows per group meet balanced partitions.
    joined = null_safe_join(placed, offsets, [*group, "__slot"])
    ordered = Window.partitionBy(*[col(g) for g in group], F.col("__slot")).orderBy(*ascending_keys)
    out = joined.withColumn(position_column, (F.row_number().over(ordered) + F.col("__before_n")).cast("long"))
    if total_column:
        out = out.withColumn(total_column, F.col("__total_n"))
    return out.drop(*names, "__slot", "__before_n", "__total_n")


def running_extreme(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str, maximise: bool = True, strategy: str = "auto"
) -> DataFrame:
    """Add the largest (or smallest) value up to and including each row, in ascending order of unique keys."""
    strategy = choose(df, strategy)
    extreme = F.max if maximise else F.min
    best = F.greatest if maximise else F.least
    keys = [col(g) for g in group]
    ascending = [col(o) for o in order]
    if strategy == "window":
        so_far = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*ascending).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, extreme(col(value)).over(so_far))
    placed = _place(df, group, order)
    per_slot = placed.groupBy(*keys, "__slot").agg(extreme(col(value)).alias("__m"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slot.select(*keys, "__slot", extreme("__m").over(earlier).alias("__carried"))
    joined = null_safe_join(placed, carried, [*group, "__slot"])
    here = Window.partitionBy(*keys, F.col("__slot")).orderBy(*ascending).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, best(F.col("__carried"), extreme(col(value)).over(here))).drop("__slot", "__carried")


def quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    strategy: str = "auto",
    count_column: str | None = None,
) -> DataFrame:
    """Return exact linearly interpolated quantiles per group with values, one column per named probability.

    ``count_column`` adds the number of non-missing values.
    """
    strategy = choose(df, strategy)
    clean = df.withColumn("__v", F.nanvl(col(value).cast("double"), F.lit(None).cast("double"))).where("__v IS NOT NULL")
    keys = [col(g) for g in group]
    if strategy == "window":
        # Map-side combined histogram per group; bounded because the whole input is.
        picked = clean.groupBy(*keys).agg(
            F.percentile("__v", F.array(*[F.lit(float(p)) for p in probabilities.values()])).alias("__q"),
            F.count(F.lit(1)).alias("__n"),
        )
        columns = [F.get("__q", i).alias(name) for i, name in enumerate(probabilities)]
        return picked.select(*keys, *columns, *([F.col("__n").alias(count_column)] if count_column else []))
    totals = prefix_totals(clean, group, ["__v"], strategy="split")
    picks = []
    for i, p in enumerate(probabilities.values()):
        at = (F.col("n_total") - 1) * F.lit(float(p))
        for side, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (index >= F.col("n_before")) & (index < F.col("n_before") + F.col("n"))
            picks.append(F.max(F.when(inside, F.col("__v"))).alias(f"__{side}{i}"))
    ends = totals.groupBy(*keys).agg(F.max("n_total").alias("__n"), *picks)
    columns = []
    for i, (name, p) in enumerate(probabilities.items()):
        at = (F.col("__n") - 1) * F.lit(float(p))
        fraction = at - F.floor(at)
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        # Between equal values the quantile is that value itself, without rounding.
        columns.append(F.when(low == high, low).otherwise(low * (1 - fraction) + high * fraction).alias(name))
    return ends.select(*keys, *columns, *([F.col("__n").alias(count_column)] if count_column else []))


def multi_quantiles(
    df: DataFrame,
    group: Sequence[str],
    wanted: Mapping[str, Mapping[str, float]],
    strategy: str = "auto",
    count_column: str | None = None,
) -> DataFrame:
    """Return named quantiles of several columns per group, and the number of rows.

    The window strategy needs a single aggregation for all of them.
    """
    strategy = choose(df, strategy)
    keys = [col(g) for g in group]
    rows = df.select(*keys, *[F.nanvl(col(v).cast("double"), F.lit(None).cast("double")).alias(v) for v in wanted])
    counted = [F.count(F.lit(1)).alias(count_column)] if count_column else []
    if strategy == "window":
        arrays = [
            F.percentile(col(v), F.array(*[F.lit(float(p)) for p in named.values()])).alias(f"__q{i}")
            for i, (v, named) in enumerate(wanted.items())
        ]
        picked = rows.groupBy(*keys).agg(*counted, *arrays)
        columns = [
            F.get(f"__q{i}", j).alias(name) for i, named in enumerate(wanted.values()) for j, name in enumerate(named)
        ]
        return picked.select(*keys, *([count_column] if count_column else []), *columns)
    # All columns in one ordering: a value is placed within (group, column).
    rows = reliable_checkpoint(rows)
    cells = F.array(*[F.struct(F.lit(i).alias("__c"), col(v).alias("__x")) for i, v in enumerate(wanted)])
    melted = rows.select(*keys, F.explode(cells).alias("__cell")).select(*keys, "__cell.*")
    shares = sorted({float(p) for named in wanted.values() for p in named.values()})
    found = quantiles(melted, [*group, "__c"], "__x", {f"__q{i}": p for i, p in enumerate(shares)}, strategy)
    picked = found.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("__c") == i, F.col(f"__q{shares.index(float(p))}"))).alias(name)
            for i, named in enumerate(wanted.values())
            for name, p in named.items()
        ]
    )
    out = rows.groupBy(*keys).agg(*(counted or [F.count(F.lit(1)).alias("__n")]))
    if group:
        out = null_safe_join(out, picked, group, "left")
    else:
        one = picked.withColumn("__all", F.lit(0))
        out = out.withColumn("__all", F.lit(0)).join(F.broadcast(one), "__all", "left").drop("__all")
    return out.select(*keys, *([count_column] if count_column else []), *[n for named in wanted.values() for n in named])


def exact_quantile(df: DataFrame, value: str, probability: float, strategy: str = "auto") -> float | None:
    """Return one global quantile to the driver."""
    row = quantiles(df, [], value, {"q": probability}, strategy).first()
    return None if row is None or row["q"] is None else float(row["q"])
