"""Mixing sources to target weights, by weighted fair queueing.  DataFrame operations only.

Every document of a source gets a place in a shuffled order of that source.  Its virtual finish time
is the source's cumulative words up to and including it, divided by the source's target; a second
copy follows after the whole source.  All copies, in order of finish time, are taken until the total
budget is spent, so that each source advances in proportion to its target.

Scale: the running sums are taken in two levels (slices of about ``slice_rows`` documents of a source,
then within a slice), so no task holds a source, however large.  Copies are sorted globally by ranges; the sums of the
ranges tell where the budget ends, and only the range that it ends in is sorted further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
#: Ranges of the global sort, at most.
RANGES = 512
#: Rows around the cut that one task may sort.
NEAR_ROWS = 20_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources: source, source_size.  Adds target.

    The budget is ``share`` of all sizes.  Sources in code-point order, null last, weigh ``weights`` in
    turn.  A target stops at ``most`` times its source's size and the excess goes to the others by
    weight: with caps c and weights w that is min(c, level * w) for the one level that spends the budget,
    found by a running sum in order of c / w.  The sources, not the documents, meet in one task.  An empty table gives an empty
    result."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    got = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    got = got.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    got = got.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everywhere))
    got = got.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    got = got.withColumn("open", F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    got = got.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everywhere)["level"]
    got = got.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))))
    return got.select("source", "source_size", "n", "target", "budget")


def _last_taken(copies: DataFrame, budget: float, n: int):
    """(finish, place, id) of the last copy within the budget and True, or of the first one beyond it and False; None if there
    are no copies.  n: about how many there are.

    All copies are sorted globally by ranges.  The sums of the ranges tell which one crosses the budget; that one is sorted
    by ranges again until few enough rows are left to sort in one task."""
    order, spent, inside = ["finish", "place", "id"], 0, copies
    while True:
        ranged = common.written(inside.repartitionByRange(max(2, min(RANGES, n // NEAR_ROWS)), *order).withColumn("range", F.spark_partition_id()), "mix-ranges")
        sums = ranged.groupBy("range").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.min("finish").alias("a"), F.max("finish").alias("b"))
        sums = sorted(sums.collect(), key=lambda r: r["range"])  # at most RANGES rows
        if not sums:
            return None
        for r in sums:
            if spent + r["s"] > budget or r is sums[-1]:
                break
            spent += r["s"]
        inside = ranged.where(F.col("range") == r["range"]).drop("range")
        n = r["n"]
        if n <= NEAR_ROWS or r["a"] == r["b"]:
            break
    runs = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cut = inside.withColumn("upto", F.lit(float(spent)) + F.sum("size").over(runs))
    # the copy that crosses the budget is taken if more than half of it fits
    fits = F.col("upto") - F.col("size") / 2 <= budget
    found = cut.agg(F.max(F.when(fits, F.struct(*order))).alias("last"), F.min(F.struct(*order)).alias("first")).first()
    return (found["first"], False) if found["last"] is None else (found["last"], True)


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: int = 2, slice_rows: int = 4096, keep: tuple[str, ...] = (), id_col: str = "doc_id") -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs (and a column ``row_key``
    that joins back to the rows: xxhash64 of the text).

    taken is 0, size or 2 * size: whole documents only.  The order is a hash of doc_id and text, so reruns
    agree.  Documents without words are never taken.  A null source is a source of its own; rows that are
    equal in doc_id and text share a place in the order and are each counted.  An empty table gives an empty
    result.  Other columns of docs are not read, whatever their names."""
    base = docs.select(F.col(id_col).alias("id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), F.xxhash64("text").alias("row_key"))
    base = common.written(base, "mix-sizes")
    per = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    per = common.written(source_targets(per, weights, share, most), "mix-targets")
    budget, n = per.agg(F.max("budget"), F.sum("n")).first()
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(20), "id", "row_key"), 11) / F.lit(float(1 << 53))
    placed = base.join(common.small_side(per.drop("budget")), base["source"].eqNullSafe(per["source"])).drop(per["source"])
    placed = placed.withColumn("place", unit).withColumn("slice", F.floor(F.col("place") * F.ceil(F.col("n") / slice_rows)))
    in_slice = Window.partitionBy("source", "slice").orderBy("place", "id", "row_key").rowsBetween(Window.unboundedPreceding, 0)
    slices = placed.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0))).select(F.col("source").alias("s_source"), F.col("slice").alias("s_slice"), "before")
    placed = placed.withColumn("within", F.sum("size").over(in_slice))
    placed = placed.join(slices, placed["source"].eqNullSafe(slices["s_source"]) & (placed["slice"] == slices["s_slice"])).drop("s_source", "s_slice")
    placed = common.written(placed.withColumn("cum", F.col("before") + F.col("within")).select("id", "source", "size", "row_key", "source_size", "target", "place", "cum"), "mix-order")
    finish = [F.try_divide(F.col("cum") + k * F.col("source_size"), F.col("target")) for k in range(most)]
    copies = placed.where("size > 0 and target > 0").select("id", "size", "place", F.explode(F.array(*finish)).alias("finish"))
    last = _last_taken(copies, budget or 0.0, most * (n or 0))
    taken = F.lit(0).cast("long")
    if last is not None:
        row, itself = last
        f, p, i = F.lit(row["finish"]), F.lit(row["place"]), F.lit(row["id"])
        # as in a sort, a null id comes first
        upto = F.lit(False) if row["id"] is None else F.col("id").isNull() | (F.col("id") < i)
        upto = upto | F.col("id").eqNullSafe(i) if itself else upto
        for x in finish:
            within = (x < f) | ((x == f) & ((F.col("place") < p) | ((F.col("place") == p) & upto)))
            taken = taken + F.when((F.col("size") > 0) & (F.col("target") > 0) & within, F.col("size")).otherwise(F.lit(0))
    return placed.select(F.col("id").alias(id_col), "source", "size", "source_size", F.col("target").cast("double").alias("target"), taken.cast("long").alias("taken"), "row_key")
