"""Windows, as-of joins, exact quantiles and other order-based building blocks.

Group sizes. Every window here is partitioned by an entity and ordered by its
date, over tables that hold one row per (entity, date); ``one_per_day`` makes
that true with a map-side combined aggregate. A group is then bounded by the
length of the calendar (about 36,500 rows for a century) however many raw rows
one entity has. Request tables of any size are reduced to distinct (entity,
date) pairs before they enter such a window and joined back afterwards on both
columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspring.functions.calendar import day_number
from wellspring.operators.lineage import cut_lineage
from wellspring.sources.writers import first_per_key

SMALL = 1 << 16
FENCES = 255

def one_per_day(df: DataFrame, key: str, date: str, order: Column) -> DataFrame:
    """One row per (key, date): the first by an explicit order."""
    return first_per_key(df, [key, date], order)


def by_day(key: str | list[str], date: str):
    """Entity window in date order; of a list of keys the last is the entity, the others say where it lies.

    The order is the plain date column: an expression would get a new name in
    every window and be sorted again for each.
    """
    return Window.partitionBy(*keys_of(key)).orderBy(date)


def keys_of(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else key


def by_day_number(key: str, date: str):
    """The same order as an integer, for frames that reach back some days."""
    return Window.partitionBy(key).orderBy(day_number(F.col(date)))


def running(key: str | list[str], date: str):
    return by_day(key, date).rowsBetween(Window.unboundedPreceding, 0)


def add_previous(df: DataFrame, key: str, date: str, value: str, k: int = 1) -> DataFrame:
    """The k previous values and dates, as ``lag_i`` / ``lag_date_i``."""
    w = by_day(key, date)
    cols = {}
    for i in range(1, k + 1):
        cols[f"lag_{i}"] = F.lag(value, i).over(w)
        cols[f"lag_date_{i}"] = F.lag(date, i).over(w)
    return df.withColumns(cols)


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_date: str,
    right_date: str,
    carry: list[str],
    strict: bool = False,
) -> DataFrame:
    """Each left row with the last right row at or before its date.

    Right rows must be unique per (key, date). Only the distinct (key, date)
    pairs of the left side enter the window, next to the right rows; the
    result is joined back, so a left side with many rows per day costs an
    equi-join on both columns and not a larger window.
    """
    payload = F.struct(F.col(right_date), *[F.col(c) for c in carry])
    rows = right.select(
        F.col(key), F.col(right_date).alias("_at"),
        F.lit(1 if strict else 0).alias("_side"), payload.alias("_hit"),
    )
    asks = (
        left.select(F.col(key), F.col(left_date).alias("_at"))
        .where(F.col("_at").isNotNull())
        .distinct()
        .withColumn("_side", F.lit(0 if strict else 1))
        .withColumn("_ask", F.lit(True))
    )
    w = (
        Window.partitionBy(key)
        .orderBy("_at", "_side")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    found = (
        rows.unionByName(asks, allowMissingColumns=True)
        .withColumn("_hit", F.last("_hit", ignorenulls=True).over(w))
        .where("_ask")
        .select(key, F.col("_at").alias(left_date), "_hit")
    )
    out = left.join(found, [key, left_date], "left")
    return out.select(
        *[F.col(c) for c in left.columns],
        *[F.col(f"_hit.{c}").alias(c) for c in [right_date, *carry]],
    )


def with_run(df: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Rows with ``run``: how many rows up to this one hold the same value without a break.

    The distance from the row where the value last changed, so one sort per key does.
    """
    w = by_day(key, date)
    at = F.row_number().over(w)
    same = F.lag(value).over(w).eqNullSafe(F.col(value)) & (at > 1)
    marked = df.withColumn("_at", at).withColumn("_new", F.when(~same, F.col("_at")))
    return marked.withColumn("run", F.col("_at") - F.max("_new").over(running(key, date)) + 1).drop("_at", "_new")


def longest_run(df: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Longest run of equal consecutive values per key."""
    return with_run(df, key, date, value).groupBy(key).agg(F.max("run").cast("long").alias("max_run"))


def largest_gap(df: DataFrame, key: str, date: str) -> DataFrame:
    """Largest calendar step inside each series, in days."""
    step = F.date_diff(F.col(date), F.lag(date).over(by_day(key, date)))
    return df.select(key, step.alias("_step")).groupBy(key).agg(F.max("_step").alias("max_gap_days"))


def value_counts(df: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    """Checkpointed counts of distinct values: several steps read them, and what
    is behind them should run once."""
    present = df.where(F.col(value).isNotNull())
    return cut_lineage(present.groupBy(*groups, value).agg(F.count(F.lit(1)).alias(name)))


def _below(cuts: Column, value: Column) -> Column:
    """How many of ``FENCES`` sorted cuts lie below a value, by halving."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(FENCES.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.element_at(cuts, at + step) < value, at + step).otherwise(at))


def _refined(counted: DataFrame, spans: DataFrame, ranks: DataFrame, groups: list[str]) -> DataFrame:
    """Parts of the spans that hold a wanted rank: about 1 / 256 of their values each."""
    key = [*groups, "_lo"]
    inside = _inside(counted, spans, groups)
    cuts = [i / (FENCES + 1) for i in range(1, FENCES + 1)]
    fences = inside.groupBy(*key).agg(F.percentile_approx("_v", cuts, F.lit(20 * FENCES)).alias("_cuts"))
    placed = _join_groups(inside, fences, key).withColumn("_part", _below(F.col("_cuts"), F.col("_v")))
    parts = placed.groupBy(*key, "_part").agg(
        F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_distinct"), F.min("_v").alias("_first"),
        F.max("_v").alias("_hi"), F.max("_before").alias("_start"),
    )
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.col("_start") + F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    return _holding(parts.withColumn("_lo", F.col("_first")), ranks, groups)


def _holding(spans: DataFrame, ranks: DataFrame, groups: list[str]) -> DataFrame:
    held = (ranks["_rank"] >= spans["_before"]) & (ranks["_rank"] < spans["_before"] + spans["_rows"])
    same = [spans[g].eqNullSafe(ranks[g]) for g in groups]
    return spans.join(ranks, [*same, held], "left_semi").select(*groups, "_lo", "_hi", "_before", "_rows", "_distinct")


def _inside(counted: DataFrame, spans: DataFrame, groups: list[str]) -> DataFrame:
    """Values with the span (first and last value, rows before it) that they lie in."""
    return _join_groups(counted, spans, groups).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))


def exact_quantiles(
    df: DataFrame,
    groups: list[str],
    value: str,
    shares: dict[str, float],
    weight: str | None = None,
    small: int = SMALL,
) -> DataFrame:
    """Exact linearly interpolated quantiles of groups too large for one task.

    ``percentile`` keeps every distinct value of a group in one buffer. Here
    values are first counted (map-side combined). A group with at most ``small``
    distinct values is sorted as it is. Of a larger one only the parts that hold
    a wanted rank are kept, cut by a mergeable sketch, and cut again until they
    are small: each round leaves about a 256th, so ten billion distinct values
    take three. The sketch decides how work is spread, never the result. With
    ``weight`` the frame already holds one row per distinct value
    (``value_counts``).
    """
    if weight is None:
        counted = value_counts(df, groups, value, "_n").withColumnRenamed(value, "_v")
    else:
        counted = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).alias("_v"), F.col(weight).alias("_n"))
    spans = cut_lineage(
        counted.groupBy(*groups).agg(
            F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.lit(0).cast("long").alias("_before"),
            F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_distinct"),
        )
    )
    wanted = F.array(*(F.struct(F.lit(n).alias("name"), ((F.col("_rows") - 1) * F.lit(float(s))).alias("pos")) for n, s in shares.items()))
    asked = spans.select(*groups, F.inline(wanted))
    ranks = asked.select("*", F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos")))).alias("_rank"))
    while True:
        large = spans.where((F.col("_distinct") > small) & (F.col("_lo") < F.col("_hi")))
        if large.isEmpty():
            break
        rest = spans.where(~((F.col("_distinct") > small) & (F.col("_lo") < F.col("_hi"))))
        spans = cut_lineage(rest.unionByName(_refined(counted, large, ranks, groups)))
    upto = Window.partitionBy(*groups, "_lo").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    per_group = ranks.groupBy(*groups).agg(F.collect_list(F.struct("name", "pos", "_rank")).alias("_asked"))
    sorted_ = _inside(counted, spans.join(per_group, groups), groups).withColumn("_upto", F.col("_before") + F.sum("_n").over(upto))
    placed = F.filter("_asked", lambda r: (r["_rank"] >= F.col("_upto") - F.col("_n")) & (r["_rank"] < F.col("_upto")))
    picked = sorted_.select(*groups, "_v", F.inline(placed))
    share_up = F.max("pos") - F.floor(F.max("pos"))
    low, high = F.min_by("_v", "_rank"), F.max_by("_v", "_rank")
    one_each = picked.groupBy(*groups, "name").agg((low + (high - low) * share_up).alias("_q"))
    return one_each.groupBy(*groups).pivot("name", list(shares)).agg(F.first("_q"))


def _join_groups(df: DataFrame, per_group: DataFrame, groups: list[str]) -> DataFrame:
    """Attach one row per group; a group may hold most rows, so both sides are salted."""
    salts = 32
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    spread = per_group.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, [*groups, "_salt"]).drop("_salt")


def stride_sample(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """``n`` rows spread evenly across the ordered set.

    Rows are numbered without a global sort in one task: range partitions are
    numbered locally and shifted by the sizes of the partitions before them.
    """
    numbered = number_rows(df, order)
    total = df.agg(F.count(F.lit(1)).alias("_total")).scalar()
    stride = F.greatest(total.cast("double") / F.lit(float(n)), F.lit(1.0))
    nth = F.ceil(F.col("row_no") / stride)
    return numbered.where((F.floor(nth * stride) == F.col("row_no")) & (nth < n)).drop("row_no")


def number_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """A global 0-based ``row_no`` in the given total order.

    The range-partitioned rows are checkpointed because both the rows and the
    partition sizes read them and must see the same boundaries.
    """
    cols = [F.col(c) for c in order]
    parted = cut_lineage(
        df.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id())
    )
    inside = Window.partitionBy("_part").orderBy(*cols)
    local = parted.withColumn("_local", F.row_number().over(inside) - 1)
    sizes = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(
        "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_shift")
    )
    joined = local.join(shift, "_part")
    return joined.withColumn("row_no", F.col("_local") + F.col("_shift")).drop("_part", "_local", "_shift")
