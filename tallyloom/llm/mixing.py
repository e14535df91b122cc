"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every document has a place in its source, by the md5 of its doc_id (a fixed shuffle). The source plays its
documents over and over; a copy's virtual finish time is the source's tokens up to its end divided by the
source's target. All copies are sorted by that time over ranges of it, and the mix is what comes before the total
budget is used up. A source's target is at most max_repeats times its size, so no document is taken more often than that.

Running sums are taken in two levels: within slots of the shuffle (rows spread evenly by a hash, so a source
that holds most rows has more slots) or ranges of time, and over their totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a slot holds about.
SLOT_ROWS = 4000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """source, source_size -> with target. Sources by code point, null last, weigh as in weights, repeating.

    Targets share all sizes by weight; one above max_repeats times its source's size stops there, and the excess is
    shared again by weight until none is above. With the sources in the order of size / weight, those that stop
    are a prefix. The level is that of the first that doesn't stop, the highest of all that fit. One row for each source is handled here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * max_repeats)
    ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(rest)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    return ranked.withColumn("level", level).withColumn("level", F.max(fits).over(whole)).select("source", "source_size", F.least(F.col("most").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("most").cast("double"))).alias("target"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, copies, taken, order (doc_id's place in the shuffle), the times of its copies, and row.

    row: a column that tells rows apart, carried along. Nulls: a null text has size 0, a null source is a source of its own,
    a null doc_id is shuffled as ''. Rows with a repeated doc_id are rows of their own, ties in doc_id and size any way round.
    Documents without words take part once, with size 0. An empty table gives an empty one; extra columns are ignored, texts are
    counted whole. Reruns agree.
    """
    spark = docs.sparkSession
    named = F.col(row) if row else F.lit(None).cast("bigint")
    sized = scratch.stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), named.alias("row")), "mix")
    files = scratch.files_for(sized.count(), 50_000)
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    per_source = per_source.withColumn("slots", F.greatest(F.lit(1), F.least(F.lit(1 << 20), (F.col("n") / SLOT_ROWS).cast("int") + 1)))
    aims = targets(per_source.select("source", "source_size"), weights=weights, max_repeats=max_repeats)
    aims = aims.select(F.col("source").alias("s"), "target")
    aims = scratch.stored(per_source.join(aims, F.col("source").eqNullSafe(F.col("s"))).select("s", "source_size", "target", "slots"), "aims", 8)
    few = scratch.small_enough(aims, 20_000)
    by_source = F.broadcast(aims) if few else aims
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = sized.join(by_source, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "row", "source_size", "target", key.alias("order"), "slots")
    rows = rows.withColumn("slot", F.floor(F.conv(F.substring("order", 1, 10), 16, 10).cast("double") / float(1 << 40) * F.col("slots")).cast("int")).drop("slots")
    # First level: sums of slots, and before each slot of its source; second level: within the slot.
    slots = rows.groupBy("source", "slot").agg(F.sum("size").alias("of_slot"))
    over = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(F.col("source").alias("s"), F.col("slot").alias("k"), F.coalesce(F.sum("of_slot").over(over), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "slot").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, 0)
    end = rows.withColumn("within", F.sum("size").over(within)).join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("slot") == F.col("k"))).withColumn("end", F.col("before") + F.col("within"))
    time = lambda k: (F.lit(float(k)) * F.col("source_size") + F.col("end")) / F.col("target")
    times = F.when((F.col("size") > 0) & (F.col("target") > 0), F.array(*[time(k) for k in range(max_repeats)]))
    placed = scratch.stored(end.select("doc_id", "source", "size", "row", "source_size", "target", "order", times.alias("times"), F.coalesce(F.try_divide(F.col("end").cast("double"), F.col("target")), F.lit(0.0)).alias("time")), "placed", files)
    budget = aims.agg(F.sum("source_size")).first()[0] or 0
    cut = _cut(placed.select("size", F.explode("times").alias("time")), budget, files)
    taken = F.when(F.col("times").isNull(), F.array("time")).otherwise(F.filter("times", lambda t: t <= F.lit(cut)))
    whole = placed.withColumn("times", taken).withColumn("copies", F.size("times"))
    return whole.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"), "order", "times", "row")


def _cut(copies: DataFrame, budget: int, files: int) -> float:
    """The last time up to which copies (size, time) add up to no more than budget; those of one time count together.

    The copies are sorted by time over ranges of it: a range's sums begin at the total of the ranges before it.
    """
    spark = copies.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sorted_ = scratch.stored(copies.repartitionByRange(n, "time").groupBy(F.spark_partition_id().alias("range"), "time").agg(F.sum("size").alias("size")), "times", files)
    over = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each task of the sort.
    ranges = sorted_.groupBy("range").agg(F.sum("size").alias("of_range")).select("range", F.coalesce(F.sum("of_range").over(over), F.lit(0)).alias("before"))
    within = Window.partitionBy("range").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    upto = sorted_.withColumn("within", F.sum("size").over(within)).join(F.broadcast(ranges), "range").where(F.col("before") + F.col("within") <= budget)
    last = upto.agg(F.max("time")).first()[0]
    return float("-inf") if last is None else float(last)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, sorted by virtual finish time over the partitions.

    Columns of docs stay, whatever their names; nulls, ties and empty tables as in mix().
    """
    row, key, at = scratch.private(docs, "row", "key", "time")
    # The number is written with the row: it stays what it is when a task runs again.
    whole = scratch.stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows", codec="zstd")
    plan = mix(whole, row=row, **how)
    copies = plan.select(F.col("row").alias(key), F.explode("times").alias(at))
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    mixed = whole.join(copies, F.col(row) == F.col(key))
    return mixed.repartitionByRange(n, at, row).sortWithinPartitions(at, row).select(*docs.columns)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = scratch.table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5(coalesce(doc_id::varchar, '')) as o from documents),
s as (select source, sum(size)::bigint as source_size, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight from d group by source),
r as (select *, 3 * source_size as most, (sum(source_size) over () - coalesce(sum(3 * source_size) over (order by 3 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (order by 3 * source_size / weight, source nulls last rows between current row and unbounded following) as level from s),
t as (select source, source_size, least(most::double, (max(case when level * weight <= most then level end) over ()) * weight) as target from r),
e as (select d.doc_id, d.size, t.source_size, t.target, sum(d.size) over (partition by d.source order by o, d.size rows unbounded preceding) as upto from d join t on d.source is not distinct from t.source),
c as (select size, (k * source_size + upto)::double / target as time from e, range(3) as x(k) where size > 0 and target > 0),
g as (select time, sum(sum(size)) over (order by time) as total from c group by time),
z as (select max(time) as cut from g where total <= (select sum(size) from d))
select doc_id, size, source_size::bigint as source_size, target, (case when size = 0 then 0 else size * ((upto / target <= cut)::int + ((source_size + upto) / target <= cut)::int + ((2 * source_size + upto) / target <= cut)::int) end)::bigint as taken from e, z
"""
