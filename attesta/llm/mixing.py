"""Mixing sources to target weights by Pareto order sampling.

A source's target is its weight's share of all sizes, at most MOST times its own
size; what is above that is shared anew by weight among the others until no
source is above.  Weights go round the sources in the order of their names.

A document's expected copies are its source's target over its size (times the
document's own weight, if there is one).  Whole copies are certain.  What is left
of the target is a sample of a fixed size in words: with u from a hash of the
row and p the fraction of a copy that is left, documents are ranked by their
random odds over their inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken
in that order as long as the words that are left allow.  Then the same is done
among the documents of at most half of what is left, which at least halves it as
long as there are such, until every source is within TOLERANCE of its target,
nothing more is found or ROUNDS are done; at last the one document that comes
nearest to what is left is taken where that is nearer than none.  A source whose documents are small beside its target
needs the first sample only.

No source is gathered or sorted: the rank at which a sample ends is found by
sums of words in GRAIN classes of ranks, then in GRAIN classes within the last
of them, and only documents of one such class are put in order.  The rest are
compared with their source's ends.  Only single sums and the number of sources
reach the driver.

Rows: a null or empty text has size 0; a null source is one, the last; a null
key is one like any other; rows of one key and text are taken all or none, as
they have one rank; texts of any length are read whole; a source without words
has the target 0; a table without words has all targets 0; an empty table gives
an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.llm.common import stored

WEIGHTS = (5, 2, 1)
#: The most copies of a document; words of a source's target that may be missing; further samples of what is left; classes of ranks.
MOST, TOLERANCE, ROUNDS, GRAIN = 3, 0.001, 8, 4096
SEED = 12
#: What orders the documents of a source; no two differing rows have it in common.
RANK = ("rank", "key", "row")


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None) -> DataFrame:
    """(key, source, size, row, weight) of every document; size is its number of words."""
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    own = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    return docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(F.lit(SEED), key, text).alias("row"), own.alias("weight"))


def numbered(names: DataFrame) -> DataFrame:
    """``names`` (source, ...), one row a source, with ``place`` from 0 in the order of source, null last.

    Ranges are sorted apart and their counts added up, so the table isn't brought together.
    """
    order = [F.col("source").isNull(), F.col("source")]
    parts = stored(names.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    earlier = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return parts.withColumn("inside", inside).join(earlier, "part").withColumn("place", F.col("before") + F.col("inside")).drop("part", "inside", "before")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, mean_weight, target) of every source in ``rows`` (sized())."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("weight")).alias("weighted"))
    placed = numbered(stored(sizes, "sources"))
    shares = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1)
    placed = stored(placed.withColumn("share", shares), "shares")
    cap = most * F.col("source_size")
    left, full = F.sum("source_size"), None
    total = placed.agg(left).first()[0] or 0
    level = 0.0
    while True:
        # sources whose share at this level is above their cap are full; the level of the others rises until none more is
        above = cap < F.col("share") * level
        words, share, n = placed.agg(F.sum(F.when(above, cap).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("share"))), F.sum(above.cast("long"))).first()
        if n == full or not share:
            break
        full, level = n, (total - words) / share
    target = F.least(cap.cast("double"), F.col("share") * F.lit(float(level)))
    mean = F.when(F.col("source_size") > 0, F.col("weighted") / F.col("source_size"))
    return placed.select("source", "source_size", mean.alias("mean_weight"), target.alias("target"))


def _odds(p: Column) -> Column:
    return p / (1 - p)


def ranked(rows: DataFrame, aims: DataFrame, most: int = MOST) -> DataFrame:
    """``rows`` with their source's target, certain ``copies`` and ``rank``, the latter from 0 to 1 and null where no copy is left to draw."""
    at = aims.withColumnRenamed("source", "its")
    both = rows.join(at, rows["source"].eqNullSafe(at["its"]), "left").drop("its")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = F.least(F.lit(float(most)), wanted * F.when(F.col("mean_weight") > 0, F.col("weight") / F.col("mean_weight")).otherwise(0.0))
    both = both.withColumn("wanted", wanted)
    both = both.withColumns({"copies": F.floor("wanted"), "p": F.col("wanted") - F.floor("wanted")})
    # 53 bits of the row's hash, never 0 or 1
    u = (F.shiftrightunsigned("row", 11).cast("double") + 0.5) / float(1 << 53)
    ratio = _odds(u) / _odds(F.col("p"))
    rank = F.when((F.col("p") > 0) & (F.col("size") > 0), ratio / (1 + ratio))
    return both.withColumn("rank", rank).drop("p", "wanted", "mean_weight", "weight", "source_size", "target")


def _last_class(parts: DataFrame, budget: str) -> DataFrame:
    """Of (source, class, words, budget): the class in which the budget runs out, and what is left of it there; classes that all fit give none."""
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = parts.withColumn("before", before).filter((F.col("before") <= F.col(budget)) & (F.col("before") + F.col("words") > F.col(budget)))
    return over.select(F.col("source").alias("its"), "class", (F.col(budget) - F.col("before")).alias("rest"))


def ends(units: DataFrame) -> DataFrame:
    """(source, over): the least of RANK, as a struct, that doesn't fit the budget when a source's ``units`` (source, RANK, size, budget) are taken in that order.

    Sources whose units all fit have no row.
    """
    units = units.select("source", *RANK, "size", "budget", F.floor(F.col("rank") * GRAIN).alias("coarse"), F.floor(F.col("rank") * GRAIN * GRAIN).alias("fine"))
    coarse = units.groupBy("source", F.col("coarse").alias("class"), "budget").agg(F.sum("size").alias("words"))
    first = stored(_last_class(coarse, "budget"), "coarse")
    inside = units.join(first, units["source"].eqNullSafe(first["its"]) & (units["coarse"] == first["class"])).drop("its", "class", "budget")
    fine = inside.groupBy("source", F.col("fine").alias("class"), "rest").agg(F.sum("size").alias("words"))
    second = stored(_last_class(fine, "rest"), "fine")
    few = inside.drop("rest").join(second, inside["source"].eqNullSafe(second["its"]) & (inside["fine"] == second["class"])).groupBy("source", *RANK, "rest").agg(F.sum("size").alias("size"))
    taken = F.sum("size").over(Window.partitionBy("source").orderBy(*RANK))
    return few.withColumn("taken", taken).filter("taken > rest").groupBy("source").agg(F.min(F.struct(*RANK)).alias("over"))


def _drawn(rounds: int) -> Column:
    """Whether one of the rounds took the row: it was small enough, and in front of that round's end."""
    me = F.struct(*RANK)
    rest = [F.col("rank").isNotNull() & (F.col("size") <= F.col(f"most_{k}")) & (F.col(f"over_{k}").isNull() | (me < F.col(f"over_{k}"))) for k in range(rounds)]
    return reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), rest, F.lit(False))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None) -> DataFrame:
    """(key, source, size, source_size, target, copies) of every document: how often the mix takes it."""
    rows = stored(sized(docs, key, text, source, weight), "sized")
    aims = stored(targets(rows), "targets")
    rows = stored(ranked(rows, aims), "ranked")

    def beside(found: DataFrame, state: DataFrame) -> DataFrame:
        """``found`` (source, ...) with ``state``'s columns of its source."""
        at = state.withColumnRenamed("source", "its")
        return found.join(at, found["source"].eqNullSafe(at["its"]), "left").drop("its")

    state, rounds, missing = aims.select("source", "source_size", "target"), 0, None
    while True:
        words = beside(rows, state).groupBy("source").agg(F.sum((F.col("copies") + _drawn(rounds).cast("long")) * F.col("size")).alias("words"))
        budget = F.floor(F.col("target") - F.coalesce("words", F.lit(0))).cast("long")
        state = stored(beside(state.drop("budget"), words).withColumn("budget", budget).drop("words"), "left")
        before, (missing, far) = missing, state.agg(F.sum("budget"), F.count_if(F.col("budget") > TOLERANCE * F.col("target"))).first()
        if rounds > ROUNDS or missing == before or not far:
            break
        most = F.when(F.col("budget") > 0, F.greatest(F.expr("budget div 2"), F.lit(1)) if rounds else F.lit((1 << 63) - 1)).otherwise(-1)
        state = state.withColumn(f"most_{rounds}", most)
        fitting = beside(rows, state).filter(F.col("rank").isNotNull() & (F.col("budget") > 0) & (F.col("size") <= F.col(f"most_{rounds}")) & ~_drawn(rounds))
        state = stored(beside(state, ends(fitting).withColumnRenamed("over", f"over_{rounds}")), "ends")
        rounds += 1
    off = F.abs(F.col("size") - F.col("budget"))
    nearest = beside(rows, state).filter(F.col("rank").isNotNull() & ~_drawn(rounds) & (off < F.col("budget"))).groupBy("source").agg(F.min(F.struct(off.alias("off"), *RANK)).alias("next"))
    state = stored(beside(state, nearest), "last")
    nearer = F.coalesce((F.struct(*RANK) == F.struct(*(F.col(f"next.{c}") for c in RANK))) & F.col("next").isNotNull(), F.lit(False))
    copies = F.col("copies") + (_drawn(rounds) | nearer).cast("long")
    return beside(rows, state).select(F.col("key").alias(key), F.col("source").alias("source"), "size", "source_size", "target", copies.alias("copies"))
