"""Mixing sources to target weights by weighted fair queueing.

Every source is a flow. Its documents, shuffled anew for every epoch, get a virtual finish time:
the source's cumulative tokens divided by its target. Documents are then sorted by finish time
over all sources and the sequence is cut at the total budget.

Both cumulative sums are two-level prefix sums: rows fall into about sqrt(rows) buckets of a
uniform key, bucket totals are summed up, and each bucket is summed by itself. So neither a hot
source nor the global order ever meets in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.llm.shared import table, word_count, written


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """One row per source: source, sid, rows, source_size, target.

    Sources by code point, null last, take the weights in turn. Targets are shares of
    share * all sizes; none exceeds cap * its source's size, and what is cut off goes to the
    others by weight: the water level is found with one pass over the sources by cap / weight.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    out = (
        sized.groupBy("source")
        .agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
        .withColumn("sid", F.row_number().over(every))
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("heavy", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("full", F.col("ratio") * F.col("heavy") <= F.col("left"))
    )
    # the first source that isn't full sees the level that holds for it and all after it
    first = F.min(F.when(~F.col("full"), F.struct("ratio", "sid", (F.col("left") / F.col("heavy")).alias("level")))).over(whole)
    out = out.withColumn("level", first["level"])
    return out.select("source", "sid", "rows", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def _prefix(rows: DataFrame, group: list[str], bucket: list[str], order: list[str]) -> DataFrame:
    """Adds cum: the running sum of size in each group by bucket, then order."""
    keys = [*group, *bucket]
    totals = rows.groupBy(*keys).agg(F.sum("size").alias("in_bucket"))
    over = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("in_bucket").over(over), F.lit(0))).drop("in_bucket")
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("run", F.sum("size").over(inside)).join(totals, keys).withColumn("cum", F.col("before") + F.col("run")).drop("before", "run")


def row_name() -> Column:
    """A hash of a document's values; those without a text, which no mix takes, may share it with others."""
    return F.xxhash64("doc_id", "source", "text")


def fair_mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 0, key: str | Column | None = None) -> DataFrame:
    """doc_id, copy_no, size, source_size, target, taken of every row of docs (doc_id, source, text).

    taken: words the mix takes of the row, a multiple of size up to ceil(cap) times. A null text
    has size 0; a null source is a source of its own, the last. Repeated doc_ids are rows of their
    own, told apart by copy_no. An empty table gives an empty result. Other columns are ignored.
    Reruns agree: the order within a source is that of an md5 of doc_id, copy_no, epoch and seed.
    key: a long column that tells all rows apart; it becomes copy_no, and the order is then that of an
    md5 of the row's values, so it doesn't depend on key but among equal rows. It is read once, so it need
    not be the same when docs are read again; the result then also has name, a hash of doc_id, source and text.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *([(F.col(key) if isinstance(key, str) else key).alias("copy_no"), row_name().alias("name")] if key is not None else []))
    names = ["name"] if key is not None else []
    if not names:
        sized = sized.withColumn("copy_no", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("source").asc_nulls_last(), "size"))).withColumn("name", F.col("copy_no"))
    sized = written(sized)
    targets = written(source_targets(sized, weights, share, cap), 1)
    sums = targets.agg(F.sum("rows"), F.sum("source_size")).first()
    rows, budget = (sums[0] or 0), (sums[1] or 0) * float(share)
    epochs = math.ceil(cap)
    buckets = max(1, math.isqrt(rows * epochs))
    sized = sized.join(targets.drop("rows"), sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "name", "epoch", F.lit(str(seed))))
    copies = (
        sized.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        .withColumn("h", key)
        .withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * F.lit(float(buckets))).cast("int"))
        .select("doc_id", "copy_no", "size", "sid", "target", "epoch", "h", "bucket")
    )
    queued = _prefix(copies, ["sid"], ["epoch", "bucket"], ["h", "doc_id", "copy_no"])
    queued = queued.filter((F.col("target") > 0) & (F.col("cum") - F.col("size") < F.col("target")))  # later ones start beyond the budget
    queued = queued.withColumn("finish", F.col("cum") / F.col("target")).drop("cum", "bucket")
    queued = queued.withColumn("slot", F.floor(F.least(F.col("finish"), F.lit(1e6)) * F.lit(float(buckets))))
    sorted_ = _prefix(queued, [], ["slot"], ["finish", "sid", "epoch", "h", "doc_id", "copy_no"])
    taken = sorted_.filter(F.col("cum") <= F.lit(budget)).groupBy(F.col("doc_id").alias("id_took"), F.col("copy_no").alias("no_took")).agg(F.sum("size").alias("took"))
    out = sized.join(taken, F.col("doc_id").eqNullSafe(F.col("id_took")) & (F.col("copy_no") == F.col("no_took")), "left")
    return out.select("doc_id", "copy_no", "size", "source_size", "target", F.coalesce("took", F.lit(0)).cast("long").alias("taken"), *names)


def op2_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents by source takes of each. See fair_mix() for every edge case; texts are only counted, so long ones are no case of their own."""
    return fair_mix(table(spark, sf_dir, "documents")).drop("copy_no")


#: Two sums that the engines add up in one order give one value: sizes are whole numbers below 2**53.
OP2_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), keyed as (
  select *, row_number() over (partition by doc_id order by source nulls last, size) as copy_no from sized
), per as (
  select source, sum(size)::bigint as source_size from sized group by source
), ranked as (
  select *, row_number() over (order by source nulls last) as sid from per
), weighed as (
  select *, [3.0::double, 1.0::double, 2.0::double][(sid - 1) % 3 + 1] as weight, source_size * 2.0::double as most from ranked
), filled as (
  select *, most / weight as ratio,
    (sum(source_size) over ())::double * 1.5::double - coalesce(sum(most) over (order by most / weight, sid rows between unbounded preceding and 1 preceding), 0) as room,
    sum(weight) over () - coalesce(sum(weight) over (order by most / weight, sid rows between unbounded preceding and 1 preceding), 0) as heavy
  from weighed
), level as (
  select min_by(room / heavy, (ratio, sid)) as level from filled where ratio * heavy > room
), targets as (
  select source, sid, source_size, case when ratio * heavy <= room then most else weight * (select level from level) end as target from filled
), copies as (
  select k.doc_id, k.copy_no, k.size, t.sid, t.target, e.epoch,
    md5(coalesce(k.doc_id::varchar, 'null') || ':' || k.copy_no || ':' || e.epoch || ':0') as h
  from keyed k join targets t on k.source is not distinct from t.source, (values (0), (1)) e(epoch)
), queued as (
  select *, sum(size) over (partition by sid order by epoch, h, doc_id, copy_no rows unbounded preceding) as cum from copies
), finished as (
  select *, cum / target as finish from queued where target > 0 and cum - size < target
), ordered as (
  select *, sum(size) over (order by finish, sid, epoch, h, doc_id, copy_no rows unbounded preceding) as total from finished
), taken as (
  select doc_id, copy_no, sum(size) as took from ordered where total <= (select sum(size) * 1.5::double from sized) group by all
)
select k.doc_id, k.size, t.source_size, t.target, coalesce(took, 0)::bigint as taken
from keyed k join targets t on k.source is not distinct from t.source
left join taken n on n.doc_id is not distinct from k.doc_id and n.copy_no = k.copy_no
"""
