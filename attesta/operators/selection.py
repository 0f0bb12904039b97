"""Exact ranks of large groups by distributed selection: split, count, narrow, count again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.sources.workspace import kept

#: Splitters of a round, and how many rows of a group may be put in order at last.
SPLITTERS, FEW = 100, 1_000_000


def nearest_ranks(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], few: int = FEW) -> DataFrame:
    """The ceil(n q)-th smallest finite, non-negative value of each key, one column a quantile.

    Each round cuts the interval that holds a rank at sketched splitters and counts
    its parts exactly, so that the interval holds a hundredth of its rows at the next;
    sketch and counts combine before they are shuffled.  What is left, ``few`` rows of
    a group or one value, is put in order.  No task has more of a group.

    Rows: nulls, negative values and those that aren't finite don't count; a group
    without others has no row; an empty table gives an empty table.
    """
    fine = rows.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v >= 0 AND NOT isnan(_v) AND _v < double('infinity')")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in quantiles.items())))
    sums = fine.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")).withColumn("_q", each)
    rank = F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("_q.q"))).cast("long")
    state = kept(sums.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_q.name").alias("name"), rank.alias("rank"), "n", "low", "high"), "ranks")
    own = [f"_k{i}" for i in range(len(keys))]
    if state.filter((F.col("n") > few) & (F.col("low") < F.col("high"))).isEmpty():
        # no group has more values than one task may hold
        return fine.groupBy(*keys).agg(*(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY _v)").alias(n) for n, q in quantiles.items()))

    def inside(state: DataFrame) -> DataFrame:
        same = [fine[k].eqNullSafe(state[f"_k{i}"]) for i, k in enumerate(keys)] or [F.lit(True)]
        for condition in same[1:]:
            same[0] = same[0] & condition
        return fine.join(state, same[0] & (F.col("_v") >= F.col("low")) & (F.col("_v") <= F.col("high"))).drop(*keys)

    while True:
        wide = state.filter((F.col("n") > few) & (F.col("low") < F.col("high")))
        if wide.isEmpty():
            break
        grid = ", ".join(str(i / SPLITTERS) for i in range(1, SPLITTERS))
        cuts = inside(wide).groupBy(*own, "name").agg(F.array_distinct(F.expr(f"approx_percentile(_v, array({grid}), 10000)")).alias("cuts"))
        cuts = kept(_same(wide, cuts, [*own, "name"]), "cuts")
        # part 2 i holds what lies between two cuts, part 2 i + 1 what equals a cut
        below = F.size(F.filter("cuts", lambda c: c < F.col("_v")))
        part = 2 * below + F.array_contains("cuts", F.col("_v")).cast("int")
        counts = inside(cuts).withColumn("part", part).groupBy(*own, "name", "rank", "part").agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*own, "name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        narrow = counts.withColumn("_b", before).filter((F.col("rank") > F.col("_b")) & (F.col("rank") <= F.col("_b") + F.col("n")))
        narrow = narrow.select(*own, "name", (F.col("rank") - F.col("_b")).alias("rank"), "n", "low", "high")
        state = kept(state.filter(~((F.col("n") > few) & (F.col("low") < F.col("high")))).unionByName(narrow), "ranks")
    single = state.filter("low = high").select(*own, "name", F.col("low").alias("value"))
    few_rows = inside(state.filter("low < high")).groupBy(*own, "name", "rank", "_v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*own, "name").orderBy("_v"))
    rest = few_rows.withColumn("_u", upto).filter((F.col("_u") >= F.col("rank")) & (F.col("_u") - F.col("c") < F.col("rank"))).select(*own, "name", F.col("_v").alias("value"))
    found = single.unionByName(rest).groupBy(*own).agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in quantiles))
    return found.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), *quantiles)


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """A join by names whose nulls are equal."""
    right = right.select(*(F.col(n).alias(f"_r_{n}") for n in names), *(c for c in right.columns if c not in names))
    same = left[names[0]].eqNullSafe(right[f"_r_{names[0]}"])
    for n in names[1:]:
        same = same & left[n].eqNullSafe(right[f"_r_{n}"])
    return left.join(right, same).drop(*(f"_r_{n}" for n in names))
