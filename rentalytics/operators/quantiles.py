"""Exact quantiles with bounded per-task memory (distributed selection).

Spark's exact ``percentile`` merges a value->count map of the WHOLE column in
one task: fine for small domains (beds, ratings, cent prices inside caps),
unbounded for continuous columns.  This selection finds the exact values at
the needed ranks instead:

1. one aggregate: count, infinities, min and max of the finite values
   (infinities are answered by rank alone);
2. while a target's bracket holds more than ``final_rows`` rows: one
   histogram aggregate (``buckets`` equal-width buckets per open bracket,
   count/min/max per bucket; partial aggregation, at most
   brackets x buckets rows come back) narrows every bracket to the bucket
   holding its rank;
3. all last brackets (<= ``final_rows`` rows each) are resolved in one job:
   a window partition per distinct bracket, ordered by value, keeps the
   rows at the needed ranks.

Interpolation is Spark's own formula, so results equal ``percentile``.
Typically 2-3 passes; a bracket of one repeated value ends at once.  The
ends of a bracket fall into its first and last bucket, so every pass makes it
smaller; a pass that does not raises an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FINAL_ROWS = 100_000
BUCKETS = 4096


def _inside(values: DataFrame, brackets: list[Column]) -> DataFrame:
    """Each row of ``values`` with every bracket (of, lo, hi, ...) of its own series
    that holds it: a lookup by series, so a row costs the same however many other
    series have brackets."""
    frame = values.sparkSession.range(0, 1, 1, 1).select(F.inline(F.array(*brackets)))
    here = (F.col("c") == F.col("of")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    return values.join(F.broadcast(frame), here)


def _select_ranks(values: DataFrame, targets: dict[tuple[int, int], tuple[float, float, int]],
                  final_rows: int, buckets: int) -> dict[tuple[int, int], float]:
    """Values at 0-based ranks.  ``values`` is long format (c: column id, v);
    ``targets`` maps (c, rank) -> (min, max, n) of that column."""
    # bracket per target: (lo, hi, rows of the column below lo, rows inside [lo, hi])
    state = {t: (mn, mx, 0, n) for t, (mn, mx, n) in targets.items()}
    v = F.col("v")
    while True:
        open_ = sorted({(t[0], lo, hi) for t, (lo, hi, _, inside) in state.items() if inside > final_rows and lo < hi})
        if not open_:
            break
        # halves where the width of a finite range is beyond the largest double
        hits = _inside(values, [F.struct(F.lit(i).alias("i"), F.lit(ci).alias("of"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"),
                                         F.lit(0.5 if math.isinf(hi - lo) else 1.0).alias("unit"))
                                for i, (ci, lo, hi) in enumerate(open_)])
        unit, lo_, hi_ = F.col("unit"), F.col("lo"), F.col("hi")
        width = hi_ * unit - lo_ * unit
        bucket = F.least(F.floor((v * unit - lo_ * unit) / width * buckets), F.lit(buckets - 1)).cast("int")
        hist = (hits.groupBy("i", bucket.alias("k"))
                .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx"))
                .collect())
        by_bracket: dict[int, list] = {}
        for row in hist:
            by_bracket.setdefault(row["i"], []).append(row)
        for t, (lo, hi, below, inside) in list(state.items()):
            key = (t[0], lo, hi)
            if inside <= final_rows or key not in open_:
                continue
            cum = below
            for row in sorted(by_bracket[open_.index(key)], key=lambda x: x["k"]):
                if cum + row["n"] > t[1]:
                    if row["n"] >= inside:
                        raise RuntimeError(f"quantile bracket [{lo}, {hi}] of {inside} rows did not shrink")
                    state[t] = (row["mn"], row["mx"], cum, row["n"])
                    break
                cum += row["n"]
    out = {t: lo for t, (lo, hi, _, _) in state.items() if lo == hi}
    rest = [t for t in state if t not in out]
    if rest:
        # all remaining brackets (each <= final_rows rows) in ONE job: one
        # window partition per distinct bracket, keep the rows at the needed ranks
        brackets = sorted({(t[0],) + state[t][:3] for t in rest})
        ks = {b: sorted({t[1] - b[3] + 1 for t in rest if (t[0],) + state[t][:3] == b}) for b in brackets}
        hits = _inside(values, [F.struct(F.lit(j).alias("j"), F.lit(b[0]).alias("of"), F.lit(b[1]).alias("lo"),
                                         F.lit(b[2]).alias("hi"), F.array(*[F.lit(k) for k in ks[b]]).alias("ks"))
                                for j, b in enumerate(brackets)])
        rn = F.row_number().over(Window.partitionBy("j").orderBy("v"))
        picked = hits.select("j", "v", rn.alias("rn"), "ks")
        for row in picked.where(F.array_contains(F.col("ks"), F.col("rn"))).collect():
            b = brackets[row["j"]]
            out[(b[0], b[3] + row["rn"] - 1)] = row["v"]
    return out


def exact_quantiles_long(values: DataFrame, probs: dict[int, list[float]], final_rows: int = FINAL_ROWS,
                         buckets: int = BUCKETS) -> dict[int, list[float | None]]:
    """Exact interpolated quantiles of each series ``c`` of the long frame (c int, v
    double); NULL and NaN are skipped.  All series share every pass."""
    values = values.where(F.col("v").isNotNull() & ~F.isnan("v"))
    infinity = float("inf")
    finite = F.when(F.abs("v") != infinity, F.col("v"))
    stats = {r["c"]: r for r in values.groupBy("c").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") == -infinity).alias("below"),
        F.count(finite).alias("finite"), F.min(finite).alias("mn"), F.max(finite).alias("mx")).collect()}
    values = values.where(F.abs("v") != infinity)
    targets, positions, at = {}, {}, {}
    for i in probs:
        st = stats.get(i)
        if st is None:
            continue
        positions[i] = [(st["n"] - 1) * p for p in probs[i]]
        for pos in positions[i]:
            for r in {int(math.floor(pos)), int(math.ceil(pos))}:
                if r < st["below"]:
                    at[(i, r)] = -infinity
                elif r >= st["below"] + st["finite"]:
                    at[(i, r)] = infinity
                else:
                    targets[(i, r - st["below"])] = (st["mn"], st["mx"], st["finite"])
    found = _select_ranks(values, targets, final_rows, buckets)
    at.update({(i, r + stats[i]["below"]): value for (i, r), value in found.items()})
    out: dict[int, list[float | None]] = {}
    for i in probs:
        if i not in positions:
            out[i] = [None for _ in probs[i]]
            continue
        res = []
        for pos in positions[i]:
            lower, higher = math.floor(pos), math.ceil(pos)
            a, b = at[(i, lower)], at[(i, higher)]
            res.append(float(a) if lower == higher or a == b else (higher - pos) * a + (pos - lower) * b)
        out[i] = res
    return out


def exact_quantiles_many(df: DataFrame, probs: dict[str, list[float]], final_rows: int = FINAL_ROWS,
                         buckets: int = BUCKETS) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles for several columns; the columns share
    every pass (one long-format frame with a column id)."""
    values = df.select(F.posexplode(F.array(*[F.col(name).cast("double") for name in probs])).alias("c", "v"))
    found = exact_quantiles_long(values, dict(enumerate(probs.values())), final_rows, buckets)
    return {name: found[i] for i, name in enumerate(probs)}


def exact_quantiles(df: DataFrame, col: str, probs: list[float], final_rows: int = FINAL_ROWS,
                    buckets: int = BUCKETS) -> list[float | None]:
    """Exact linearly interpolated quantiles of ``col`` (NULL/NaN skipped)."""
    return exact_quantiles_many(df, {col: list(probs)}, final_rows, buckets)[col]


def exact_median_row(df: DataFrame, cols: list[str], prefix: str = "", **kw) -> DataFrame:
    """1-row frame of exact medians (``prefix + col``), for ``stats.attach``."""
    values = exact_quantiles_many(df, {c: [0.5] for c in cols}, **kw)
    return df.sparkSession.range(1).select(
        *[F.lit(values[c][0]).cast("double").alias(prefix + c) for c in cols])
