"""Global ranks, running totals and exact quantiles without a single-task window.

A window over a whole table (or over one huge group) runs in one task. These helpers cut the order
into buckets, run the window inside (group, bucket), and add what lies in earlier buckets from the
bucket totals. Bucket totals are aggregated map-side, so a group that holds most rows is spread over
all buckets. For hash keys the buckets are leading digits, as many as the rows ask for; for other orders
they are the parts of a range partitioning, written once, so nothing on the driver grows with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.session import collect_bounded, local_if_small, stage_table

# Below this many rows one window bucket is small enough for a single task.
BUCKET_ROWS = 200_000
# A key with more copies than this is numbered in several parts.
HOT_ROWS = 1_000_000
# Half width of the rank bracket searched for an exact quantile, and the sketch accuracy behind it.
BRACKET = 0.001
SKETCH_ACCURACY = 10_000


def _with_offsets(
    df: DataFrame,
    by: Sequence[str],
    bucket: str,
    totals: dict[str, F.Column],
    counted: DataFrame | None = None,
):
    """Join per (by, bucket) the sum of `totals` over all earlier buckets, as `_before_<name>`.

    The sums are one row per group and bucket; only if groups are very many does the join shuffle.
    """
    keys = [*by, bucket]
    renamed = [f"_k{i}" for i in range(len(keys))]
    source = df if counted is None else counted
    per_bucket = source.groupBy(*[F.col(k).alias(r) for k, r in zip(keys, renamed)]).agg(
        *[e.alias(f"_t_{n}") for n, e in totals.items()]
    )
    earlier = Window.partitionBy(*(renamed[:-1] or [F.lit(0)])).orderBy(renamed[-1])
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *renamed,
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in totals],
    )
    on = [F.col(k).eqNullSafe(F.col(r)) for k, r in zip(keys, renamed)]
    return df.join(local_if_small(offsets), on).drop(*renamed)


def dist_rank(df: DataFrame, key: str, rank_col: str, by: Sequence[str] = (), hex_digits: int = 3):
    """Dense 1-based row number in the order of an md5 `key`, within `by`.

    md5 keys are uniform, so their first hex digits are equal-sized buckets and need no statistics.
    `hex_digits` suit tables of up to 16^hex_digits * BUCKET_ROWS rows; larger ones take more, by their count.
    Only copies, rows with the same key, can make a bucket large. They show in the bucket counts;
    then the copies of such a key are numbered after all others, in parts of their own.
    """
    by = list(by)

    def bucketed(digits: int):
        b = df.withColumn("_bucket", F.substring(key, 1, digits))
        return b, local_if_small(b.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n")))

    b, counted = bucketed(hex_digits)
    rows = counted.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    if rows > BUCKET_ROWS * 16**hex_digits:
        hex_digits = math.ceil(math.log(rows / BUCKET_ROWS, 16))
        b, counted = bucketed(hex_digits)
    usual = rows / 16**hex_digits
    sizes = counted.groupBy("_bucket").agg(F.sum("_n").alias("n"))
    sizes = sizes.filter(F.col("n") > 4 * usual + HOT_ROWS).collect()  # few: each holds a million rows more than usual
    large = [r["_bucket"] for r in sizes]
    copies = []
    if large:
        same = b.filter(F.col("_bucket").isin(large)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        copies = collect_bounded(same.filter(F.col("n") > HOT_ROWS))
    if copies:
        parts = math.ceil(max(r["n"] for r in copies) / HOT_ROWS)
        # written once, so that a row keeps its part in every pass
        b = stage_table(b.withColumn("_part", F.monotonically_increasing_id() % parts), "rank")
        own = F.concat(F.lit("g"), F.col(key), F.lpad(F.col("_part").cast("string"), 12, "0"))
        hot = F.col(key).isin([r[key] for r in copies])
        b = b.withColumn("_bucket", F.when(hot, own).otherwise(F.col("_bucket"))).drop("_part")
        b = _with_offsets(b, by, "_bucket", {"n": F.count(F.lit(1))})
    else:
        b = _with_offsets(b, by, "_bucket", {"n": F.sum("_n")}, counted)
    inside = Window.partitionBy(*by, "_bucket").orderBy(key)
    return b.withColumn(rank_col, F.row_number().over(inside) + F.col("_before_n")).drop(
        "_bucket", "_before_n"
    )


def ranged_runs(df: DataFrame, order: Sequence[Column], name: str, runs: int | None = None) -> DataFrame:
    """The rows range-partitioned in `order` and written, with their partition as `_run`: runs follow each other.

    There are as many as the session's shuffles have partitions, or `runs`.
    """
    ranged = df.repartitionByRange(runs, *order) if runs else df.repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions(*order)
    return stage_table(ranged.withColumn("_run", F.spark_partition_id()), name)


def dist_position(df: DataFrame, order: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """0-based position `name` in the order of any column, within `by`; repeated values are numbered as they fall."""
    by = list(by)
    b = ranged_runs(df, [F.col(c) for c in (*by, order)], "positions")
    b = _with_offsets(b, by, "_run", {"n": F.count(F.lit(1))})
    inside = Window.partitionBy(*by, "_run").orderBy(order)
    return b.select(*df.columns, (F.row_number().over(inside) - 1 + F.col("_before_n")).alias(name))


def dist_cumsum(
    df: DataFrame,
    order: str,
    columns: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    runs: int | None = None,
) -> DataFrame:
    """Running totals `cum_<column>` in the order of a numeric column, within `by`.

    `order` must be unique within `by` (collapse ties first). The rows are range-partitioned by group and
    order and written once; a partition is a run, and its sums per group shift the runs after it.
    """
    by = list(by)
    direction = F.col(order).desc() if descending else F.col(order)
    b = ranged_runs(df, [*[F.col(c) for c in by], direction], "cumsum", runs)
    first, last = b.agg(F.min("_run"), F.max("_run")).first()
    if first == last:
        w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(direction)
        w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return b.select(*df.columns, *[F.sum(c).over(w).alias(f"cum_{c}") for c in columns])
    b = _with_offsets(b, by, "_run", {c: F.sum(c) for c in columns})
    w = Window.partitionBy(*by, "_run").orderBy(direction)
    w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return b.select(
        *df.columns,
        *[(F.sum(c).over(w) + F.col(f"_before_{c}")).alias(f"cum_{c}") for c in columns],
    )


def _marks(probs: Sequence[float]) -> list[float]:
    """Probabilities of the bracket ends, the ranks the sketch is asked for."""
    return sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-BRACKET, BRACKET)})


def sketch_aggregates(columns: Sequence[str], probs: Sequence[float] = (0.5,)) -> list:
    """The aggregates behind `exact_quantiles`, for a caller that has a pass over the table anyway."""
    marks = _marks(probs)
    counts = [F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)]
    return counts + [
        F.percentile_approx(F.col(c).cast("double"), marks, SKETCH_ACCURACY).alias(f"q_{i}")
        for i, c in enumerate(columns)
    ]


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float] = (0.5,),
    small_rows: int = 2_000_000,
    sketch=None,
) -> dict[str, list[float | None]]:
    """Exact quantiles (linear between the two middle ranks) of many columns at once.

    Pass one counts and sketches. Small tables take the built-in exact aggregate in pass two. Large
    ones keep only the values inside a narrow rank bracket around each quantile, collapse equal
    values, and look the exact ranks up in their running count; a hot value is one row there.
    """
    columns, probs = list(columns), list(probs)
    if not columns:
        return {}
    marks = _marks(probs)
    sketch = sketch or df.agg(*sketch_aggregates(columns, probs)).first()
    counts = [sketch[f"n_{i}"] for i in range(len(columns))]
    if max(counts) <= small_rows:
        row = df.agg(
            *[F.percentile(c, [float(p) for p in probs]).alias(f"c{i}") for i, c in enumerate(columns)]
        ).first()
        return {c: list(row[f"c{i}"] or [None] * len(probs)) for i, c in enumerate(columns)}

    def near(target):
        return min(range(len(marks)), key=lambda m: abs(marks[m] - min(1.0, max(0.0, target))))

    brackets = {
        (i, j): (sketch[f"q_{i}"][near(p - BRACKET)], sketch[f"q_{i}"][near(p + BRACKET)])
        for i in range(len(columns))
        for j, p in enumerate(probs)
        if counts[i]
    }
    found = _values_at(df, columns, probs, counts, brackets)
    missed = [k for k, v in found.items() if v is None]
    if missed:
        # the sketch's bracket did not hold the rank: search the whole range instead
        everything = {k: (-math.inf, math.inf) for k in missed}
        found.update(_values_at(df, columns, probs, counts, everything))
    return {c: [found.get((i, j)) for j in range(len(probs))] for i, c in enumerate(columns)}


def _values_at(df, columns, probs, counts, brackets) -> dict:
    """Quantiles of (column, probability) pairs, looking only inside their value brackets."""
    entries = []
    for (i, j), (low, high) in brackets.items():
        v = F.col(columns[i]).cast("double")
        # everything below the bracket collapses into one counted row
        kept = F.when(v < low, F.lit(-math.inf)).when(v <= high, v)
        entries.append(F.struct(F.lit(i).alias("c"), F.lit(j).alias("p"), kept.alias("v")))
    values = (
        df.select(F.explode(F.array(*entries)).alias("e"))
        .select("e.c", "e.p", "e.v")
        .filter("v is not null")
        .groupBy("c", "p", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranks = {}
    wanted = F.lit(False)
    for i, j in brackets:
        pos = (counts[i] - 1) * probs[j]
        lo, hi = math.floor(pos) + 1, math.ceil(pos) + 1
        ranks[i, j] = (lo, hi, pos - math.floor(pos))
        for r in {lo, hi}:
            hit = (F.col("cum_n") >= r) & (F.col("cum_n") - F.col("n") < r)
            wanted = wanted | ((F.col("c") == i) & (F.col("p") == j) & hit)
    spans: dict = {}
    for r in dist_cumsum(values, "v", ["n"], by=["c", "p"]).filter(wanted).collect():
        spans.setdefault((r["c"], r["p"]), []).append((r["cum_n"] - r["n"], r["cum_n"], r["v"]))
    out = {}
    for key, (lo, hi, frac) in ranks.items():
        at = [
            next((v for a, b, v in spans.get(key, ()) if a < rank <= b and v != -math.inf), None)
            for rank in (lo, hi)
        ]
        out[key] = None if None in at else at[0] + (at[1] - at[0]) * frac
    return out
