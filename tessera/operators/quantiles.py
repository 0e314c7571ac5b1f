"""Exact, distributed quantiles with linear interpolation (trap T8).

``percentile(col, p)`` keeps a value->count map per group inside one
task, which does not survive a column with billions of distinct values, and
sorting a column shuffles all of it.  Here two scans do without either:

1. a quantile sketch a key (``percentile_approx``), whose rank error is bounded, brackets every
   wanted position between two values;
2. values inside a bracket are counted one by one, all others only by the gap between
   brackets they fall into (combined map-side, so little is shuffled).

The cells in value order give every wanted position exactly.  A key with at most ``SMALL`` rows keeps
all its values.  Beyond that a bracket holds about 1/1000 of a key's rows.
Results equal ``numpy.percentile`` / DuckDB ``quantile_cont``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import dim_join
from ..sources.store import store
from .ranks import ordered_running

#: Accuracy of the sketch, and how many of its rank errors a bracket reaches to either side.
ACCURACY = 10_000
REACH = 5
SMALL = 10_000


def value_cells(raw: DataFrame, key_cols: list[str], probs: list[float], *, fences: tuple[int, int, float] | None = None,
                powers: bool = False) -> DataFrame:
    """Cells ``key_cols + [_exact, _n, _lo, _hi, ...]`` of the non-null values ``_v`` of ``raw``.

    A cell is one value inside a bracket (``_exact``) or all values of a gap between brackets, with its
    number of rows, smallest and largest value.  ``fences`` = (i, j, w) also brackets
    ``q_i - w (q_j - q_i)`` and ``q_j + w (q_j - q_i)``.  ``powers`` adds ``_shift``, the key's mean,
    and ``_p1`` to ``_p4``, the sums of powers of the values' distances from it.
    """
    reach = REACH / ACCURACY
    fracs = [min(1.0, max(0.0, p + d)) for p in probs for d in (-reach, reach)]
    sketch = raw.groupBy(*key_cols).agg(F.percentile_approx("_v", fracs, ACCURACY).alias("_b"), F.count("_v").alias("_rows"),
                                           *([F.avg("_v").alias("_shift")] if powers else []))
    if key_cols:
        # stored: the size check and the join read one row a key; broadcast, the values of a key stay where they are
        placed = dim_join(raw, store(sketch, "sketch"), key_cols)
        bound = [F.get("_b", F.lit(i)) for i in range(len(fracs))]
        rows, shift = F.col("_rows"), F.col("_shift")
    else:  # one row: constants instead of a join
        one = sketch.first()
        placed = raw
        bound = [F.lit(x).cast("double") for x in (one["_b"] or [None] * len(fracs))]
        rows, shift = F.lit(one["_rows"]), F.lit(one["_shift"] if powers else None).cast("double")
    v = F.col("_v")
    # a fraction cut off at 0 or 1 has all values on that side
    brackets = [(bound[2 * i], bound[2 * i + 1]) for i in range(len(probs))]
    if fences:
        i, j, w = fences
        (a, b), (c, d) = brackets[i], brackets[j]
        brackets += [(a - w * (d - a), b - w * (c - b)), (c + w * (c - b), d + w * (d - a))]
    inside = (rows <= SMALL)
    gap = F.lit(0)
    for n, (lo, hi) in enumerate(brackets):
        open_lo, open_hi = n < len(probs) and fracs[2 * n] == 0.0, n < len(probs) and fracs[2 * n + 1] == 1.0
        inside = inside | ((F.lit(True) if open_lo else v >= lo) & (F.lit(True) if open_hi else v <= hi))
        gap = gap + (F.lit(0) if open_hi else F.when(v > hi, 1).otherwise(0))
    d = v - F.col("_shift")
    extra = [F.first("_shift").alias("_shift"), *[F.sum(p).alias(f"_p{k}") for k, p in enumerate((d, d * d, d * d * d, d * d * d * d), 1)]] if powers else []
    return (placed.select(*key_cols, "_v", inside.alias("_exact"), gap.alias("_gap"), *([shift.alias("_shift")] if powers else []))
            .select("*", F.when(F.col("_exact"), v).alias("_x"), F.when(~F.col("_exact"), F.col("_gap")).alias("_g"))
            .groupBy(*key_cols, "_exact", "_g", "_x").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), *extra)
            .drop("_g", "_x"))


def with_quantiles(cells: DataFrame, key_cols: list[str], probs: list[float]) -> DataFrame:
    """Add ``n`` and the exact quantiles ``q0 ..`` of its key to every cell."""
    whole = Window.partitionBy(*key_cols)
    upto = whole.orderBy("_lo").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_e", F.sum("_n").over(upto) - 1).withColumn("n", F.sum("_n").over(whole))
    value = F.when(F.col("_exact"), F.col("_lo")).otherwise(F.raise_error("a quantile fell outside its bracket").cast("double"))
    out: list[Column] = []
    for i, p in enumerate(probs):
        h = (F.col("n") - 1).cast("double") * F.lit(float(p))
        at = [F.max(F.when(f(h).between(F.col("_e") - F.col("_n") + 1, F.col("_e")), value)).over(whole) for f in (F.floor, F.ceil)]
        out.append((at[0] + (h - F.floor(h)) * (at[1] - at[0])).alias(f"q{i}"))
    return cells.select("*", *out).drop("_e")


def exact_quantiles(df: DataFrame, key_cols: list[str], value_col: str,
                    probs: list[float], n_buckets: int | None = None) -> DataFrame:
    """Return ``key_cols + [n, q0 .. q{k-1}]`` for probabilities ``probs``.

    With ``n_buckets`` the distinct values are ordered in so many range buckets instead of bracketed."""
    key_cols = list(key_cols)
    raw = df.where(F.col(value_col).isNotNull()).select(*key_cols, F.col(value_col).cast("double").alias("_v"))
    keys = key_cols
    names = [f"q{i}" for i in range(len(probs))]
    if n_buckets:
        counts = raw.groupBy(*key_cols, "_v").agg(F.count(F.lit(1)).alias("_c")).withColumn("_all", F.signum("_c").cast("int"))
        return exact_quantiles_from_counts(counts, key_cols or ["_all"], probs, n_buckets).select(*key_cols, "n", *names)
    cells = value_cells(raw, key_cols, probs)
    if not keys:  # the cells of one column: one partition of a few brackets
        keys = ["_all"]
        cells = cells.withColumn("_all", F.signum("_n").cast("int"))
    return (with_quantiles(cells, keys, probs).groupBy(*keys).agg(F.first("n").alias("n"), *[F.first(q).alias(q) for q in names])
            .select(*key_cols, "n", *names))


def exact_quantiles_from_counts(d: DataFrame, key_cols: list[str], probs: list[float],
                                n_buckets: int | None = None, few_keys: bool = False) -> DataFrame:
    """Quantiles of a distinct-value table ``key_cols + [_v, _c]`` by its distributed ordering (``few_keys`` as there)."""
    key_cols = list(key_cols)
    r = ordered_running(d, "_v", part_cols=key_cols, weight_col="_c", n_buckets=n_buckets, few_keys=few_keys)
    # _pos = inclusive cumulative count: the value covers 0-based ranks [_pos-_c, _pos-1]
    targets = d.groupBy(*key_cols).agg(F.sum("_c").alias("n")).select(*key_cols, "n", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), ((F.col("n") - 1).cast("double") * F.lit(float(p))).alias("h")) for i, p in enumerate(probs)])).alias("t"))
    last, first = F.col("_pos") - 1, F.col("_pos") - F.col("_c")
    lo, hi = F.floor("t.h"), F.ceil("t.h")
    near = r.join(F.broadcast(targets) if few_keys else targets, key_cols).where(lo.between(first, last) | hi.between(first, last))
    per = near.groupBy(*key_cols, "n", F.col("t.i").alias("i"), F.col("t.h").alias("h")).agg(
        F.max(F.when(lo.between(first, last), F.col("_v"))).alias("vlo"), F.max(F.when(hi.between(first, last), F.col("_v"))).alias("vhi"))
    per = per.withColumn("q", F.col("vlo") + (F.col("h") - F.floor("h")) * (F.col("vhi") - F.col("vlo")))
    return per.groupBy(*key_cols, "n").agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(len(probs))])
