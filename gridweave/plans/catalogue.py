"""All harness queries of the engine's own operators, with their DuckDB SQL.

Each applies a library operator to whole driver tables that stand for its own inputs: lineitem for
pixels (byte, truth), part for boxes, embeddings for rings and tiles, events for raster cells,
nations for experiment runs. Ratios and coordinates are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.functions import measures as M
from gridweave.operators import experiments, learning, matching, ordering, pixels, raster, scoring, tiles
from gridweave.operators.kernels import batches as many_polygons
from gridweave.operators.kernels import polygons
from gridweave.operators.scenes import spread
from gridweave.plans import reports, vectorise
from gridweave.sources.blocks import KEY, cells, to_rows
from gridweave.sources.tables import materialised, table
from gridweave.sources.vectors import is_polygon

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
THRESHOLDS = (0.25, 0.5, 0.75)


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r6(c: Column | str) -> Column:
    """Rounded to 6 places; -0 becomes 0."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


def _ratios6(df: DataFrame) -> DataFrame:
    return df.withColumns({c: r6(c) for c in ("precision", "recall", "f1", "iou") if c in df.columns})


# ---------------------------------------------------------------- pixels


def graded(spark: SparkSession, d: str) -> DataFrame:
    """Cells (region, nation, supp, byte, truth)."""
    lines = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_quantity") * 5).cast("int").alias("byte"), (F.col("l_returnflag") == "R").alias("truth"))
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    supp = table(spark, d, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    return lines.join(supp, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("s_suppkey").alias("supp"), "byte", "truth")


GRADED = """graded as (
  select r_name as region, n_name as nation, s_suppkey as supp, trunc(l_quantity * 5)::int as byte, l_returnflag = 'R' as truth
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
)"""
EPS = "1e-9::double"


def _sql_ratios(tp: str = "tp", fp: str = "fp", fn: str = "fn", only: tuple[str, ...] = ("precision", "recall", "f1", "iou")) -> str:
    p, r = f"({tp}::double / ({tp} + {fp} + {EPS}))", f"({tp}::double / ({tp} + {fn} + {EPS}))"
    every = {"precision": p, "recall": r, "f1": f"2 * {p} * {r} / ({p} + {r} + {EPS})", "iou": f"{tp}::double / ({tp} + {fp} + {fn} + {EPS})"}
    return ", ".join(f"round({every[c]}, 6) as {c}" for c in only)


COUNTS = """count(*) filter (byte >= 128 and truth) as tp, count(*) filter (byte >= 128 and not truth) as fp,
  count(*) filter (byte < 128 and truth) as fn, count(*) filter (byte < 128 and not truth) as tn"""


@query(f"with {GRADED}, c as (select coalesce(region, 'ALL') as grp, {COUNTS} from graded group by rollup (region)) select *, {_sql_ratios()} from c")
def confusion_by_region(spark: SparkSession, d: str) -> DataFrame:
    return _ratios6(pixels.summarised(pixels.counted(graded(spark, d), "region"), "region"))


CURVE = f"""{GRADED}, twice as (select region as grp, byte, truth from graded union all select 'ALL', byte, truth from graded),
h as (select grp, byte as bin, count(*) filter (truth) as pos, count(*) filter (not truth) as neg from twice group by all),
dense as (select g.grp, b.bin, coalesce(pos, 0) as pos, coalesce(neg, 0) as neg from (select distinct grp from h) g cross join (select unnest(range(256))::int as bin) b left join h on h.grp = g.grp and h.bin = b.bin),
curve as (select grp, bin, bin / 255.0::double as threshold, sum(pos) over w::bigint as tp, sum(neg) over w::bigint as fp, (sum(pos) over (partition by grp) - sum(pos) over w)::bigint as fn
  from dense window w as (partition by grp order by bin desc rows unbounded preceding))""".replace("over w::bigint", "over w")


@query(f"with {CURVE} select grp, bin, round(threshold, 6) as threshold, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, {_sql_ratios()} from curve")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _ratios6(pixels.curve(pixels.histogram(graded(spark, d), "region"))).withColumn("threshold", r6("threshold"))


@query(
    f"""with {CURVE}, s as (select grp, bin, tp::double / (tp + fp + fn + {EPS}) as iou from curve),
ranked as (select *, row_number() over (partition by grp order by iou desc, bin) as nth, max(iou) filter (bin = 128) over (partition by grp) as at128 from s)
select grp, bin as best_bin, round(iou, 6) as best_iou, round(at128, 6) as iou_default, round(iou - at128, 6) as gain from ranked where nth = 1"""
)
def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    found = pixels.best(pixels.curve(pixels.histogram(graded(spark, d), "region")))
    return found.withColumns({c: r6(c) for c in ("best_iou", "iou_default", "gain")})


@query(
    f"""with {GRADED}, c as (select region, nation, {COUNTS} from graded group by all),
u as (select region, count(*) as units, round(avg(tp::double / (tp + fp + fn + {EPS})), 6) as macro, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from c group by region)
select region, units, macro, round(tp::double / (tp + fp + fn + {EPS}), 6) as micro from u"""
)
def macro_vs_micro(spark: SparkSession, d: str) -> DataFrame:
    found = pixels.macro(pixels.counted(graded(spark, d), "region", "nation"), "region")
    return found.withColumns({c: r6(c) for c in ("macro", "micro")})


@query(
    """select channel, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, sum(tn)::bigint as tn, round((sum(tp) + sum(tn))::double / (sum(tp) + sum(fp) + sum(fn) + sum(tn) + 1e-9::double), 6) as accuracy
from (select 'int' as channel, (1 / (1 + exp(-(l_quantity - 25) / 10)) > 0.5 and l_returnflag = 'R')::int as tp, (1 / (1 + exp(-(l_quantity - 25) / 10)) > 0.5 and l_returnflag <> 'R')::int as fp,
  (not (1 / (1 + exp(-(l_quantity - 25) / 10)) > 0.5) and l_returnflag = 'R')::int as fn, (not (1 / (1 + exp(-(l_quantity - 25) / 10)) > 0.5) and l_returnflag <> 'R')::int as tn from lineitem
union all select 'bnd', (1 / (1 + exp(-(l_discount - 0.05) * 40)) > 0.5 and l_linestatus = 'F')::int, (1 / (1 + exp(-(l_discount - 0.05) * 40)) > 0.5 and l_linestatus <> 'F')::int,
  (not (1 / (1 + exp(-(l_discount - 0.05) * 40)) > 0.5) and l_linestatus = 'F')::int, (not (1 / (1 + exp(-(l_discount - 0.05) * 40)) > 0.5) and l_linestatus <> 'F')::int from lineitem) group by channel"""
)
def channel_counters(spark: SparkSession, d: str) -> DataFrame:
    """Training-time counters of two channels: strictly above 0.5 after the sigmoid."""
    lines = table(spark, d, "lineitem")
    channels = F.array(
        F.struct(F.lit("int").alias("channel"), ((F.col("l_quantity") - 25) / 10).alias("logit"), (F.col("l_returnflag") == "R").alias("truth")),
        F.struct(F.lit("bnd").alias("channel"), ((F.col("l_discount") - 0.05) * 40).alias("logit"), (F.col("l_linestatus") == "F").alias("truth")),
    )
    cells = lines.select(F.explode(channels).alias("c")).select("c.*")
    counts = cells.groupBy("channel").agg(*M.confusion(M.sigmoid(F.col("logit")) > 0.5, F.col("truth")))
    return counts.withColumn("accuracy", r6((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") + F.lit(M.EPS))))


@query(
    """select l_suppkey as tile, count(*) filter (b >= 153 and w < 102) as seeds, count(*) filter (b >= 128) as mask, count(*) filter (b >= 128 and l_linestatus = 'F') as kept
from (select *, trunc(l_quantity * 5)::int as b, trunc(l_tax * 2550)::int as w from lineitem) group by l_suppkey"""
)
def seed_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Seeds are confident inside and off the wall; compared as bytes."""
    b, w = (F.col("l_quantity") * 5).cast("int"), (F.col("l_tax") * 2550).cast("int")
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("tile")).agg(
        F.count_if(M.seed(b, w)).alias("seeds"), F.count_if(M.at_least(b, 0.5)).alias("mask"), F.count_if(M.at_least(b, 0.5) & (F.col("l_linestatus") == "F")).alias("kept")
    )


# ---------------------------------------------------------------- boxes


def boxes(spark: SparkSession, d: str, odd: bool) -> DataFrame:
    k = F.col("p_partkey")
    x, y = (k * 7919 % 997).cast("double"), (k * 10473 % 991).cast("double")
    rows = table(spark, d, "part").filter(k % 2 == (1 if odd else 0))
    return rows.select((k % 7).alias("scene"), k.alias("id"), x.alias("x0"), y.alias("y0"), (x + 10 + F.col("p_size")).alias("x1"), (y + 10 + k % 37).alias("y1"))


BOXES = """b as (select p_partkey % 7 as scene, p_partkey as id, (p_partkey * 7919 % 997)::double as x0, (p_partkey * 10473 % 991)::double as y0, p_size as w, p_partkey % 37 as h from part),
box as (select scene, id, x0, y0, x0 + 10 + w as x1, y0 + 10 + h as y1 from b),
pairs as (select p.scene, p.id as pred, g.id as gt, greatest(0, least(p.x1, g.x1) - greatest(p.x0, g.x0)) * greatest(0, least(p.y1, g.y1) - greatest(p.y0, g.y0)) as overlap,
  (p.x1 - p.x0) * (p.y1 - p.y0) as pa, (g.x1 - g.x0) * (g.y1 - g.y0) as ga
  from box p join box g on p.scene = g.scene and p.id % 2 = 0 and g.id % 2 = 1 and p.x0 <= g.x1 and g.x0 <= p.x1 and p.y0 <= g.y1 and g.y0 <= p.y1),
scored as (select scene, pred, gt, overlap, overlap / (pa + ga - overlap + 1e-9::double) as iou from pairs)"""


def box_candidates(spark: SparkSession, d: str) -> DataFrame:
    """(scene, pred, gt, overlap, iou) of even against odd boxes."""
    pairs = matching.grid_join(boxes(spark, d, False), boxes(spark, d, True), 64.0, "scene")
    return pairs.select("scene", F.col("l_id").alias("pred"), F.col("r_id").alias("gt"), matching.box_overlap().alias("overlap"), matching.box_iou().alias("iou"))


@query(f"with {BOXES} select scene, pred, gt, overlap, round(iou, 6) as iou from scored")
def box_iou_join(spark: SparkSession, d: str) -> DataFrame:
    return box_candidates(spark, d).withColumn("iou", r6("iou"))


LEVELS = "(values (0.25::double), (0.5::double), (0.75::double)) l(threshold)"
STRICT = f"""{BOXES}, cand as (select *, row_number() over (partition by scene order by iou desc, pred desc, gt desc) as nth from scored where iou > 0),
walk(scene, nth, ps, gs, hit) as (
  select distinct scene, 0::bigint, []::bigint[], []::bigint[], null::double from cand
  union all
  select c.scene, c.nth, case when list_contains(ps, c.pred) or list_contains(gs, c.gt) then ps else list_append(ps, c.pred) end,
    case when list_contains(ps, c.pred) or list_contains(gs, c.gt) then gs else list_append(gs, c.gt) end,
    case when list_contains(ps, c.pred) or list_contains(gs, c.gt) then null else c.iou end
  from walk w join cand c on c.scene = w.scene and c.nth = w.nth + 1
)"""


@query(
    f"""with recursive {STRICT}, n as (select scene, count(*) filter (id % 2 = 0) as np, count(*) filter (id % 2 = 1) as ng from box group by scene)
select n.scene, threshold, count(hit) filter (hit >= threshold) as tp, any_value(np) - count(hit) filter (hit >= threshold) as fp, any_value(ng) - count(hit) filter (hit >= threshold) as fn
from n cross join {LEVELS} left join walk w on w.scene = n.scene group by n.scene, threshold"""
)
def strict_match(spark: SparkSession, d: str) -> DataFrame:
    preds, gts = boxes(spark, d, False), boxes(spark, d, True)
    return matching.scored(matching.matched_boxes(preds, gts, 128.0, THRESHOLDS), preds, gts, THRESHOLDS)


@query(
    f"""with {BOXES}, best as (select *, row_number() over (partition by scene, pred order by iou desc, gt) as nth from scored)
select scene, pred, gt, round(iou, 6) as iou from best where nth = 1 and iou >= 0.1"""
)
def best_match(spark: SparkSession, d: str) -> DataFrame:
    return matching.best_boxes(boxes(spark, d, False), boxes(spark, d, True), 128.0, 0.1, "scene").withColumn("iou", r6("iou"))


def _terraces(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Large boxes, one for each four parts, and up to three disjoint strips in and around each."""
    k = F.col("p_partkey")
    cell = F.floor(k / 4)
    cx, cy = (cell % 40 * 60).cast("double"), (F.floor(cell / 40) * 120).cast("double")
    rows = table(spark, d, "part").withColumns({"scene": cell % 3, "cx": cx, "cy": cy})
    gts = rows.filter(k % 4 == 0).select("scene", k.alias("id"), F.col("cx").alias("x0"), F.col("cy").alias("y0"), (F.col("cx") + 50).alias("x1"), (F.col("cy") + 50).alias("y1"))
    x, y = F.col("cx") + (k % 4 - 1) * 17, F.col("cy") + k % 5 * 8
    preds = rows.filter(k % 4 != 0).select("scene", k.alias("id"), x.alias("x0"), y.alias("y0"), (x + 10 + k % 7).alias("x1"), (y + 10 + F.col("p_size")).alias("y1"))
    return preds, gts


TERRACES = """r as (select p_partkey as k, p_size, p_partkey // 4 as cell from part),
c as (select *, cell % 3 as scene, (cell % 40 * 60)::double as cx, (cell // 40 * 120)::double as cy from r),
gt as (select scene, k as id, cx as x0, cy as y0, cx + 50 as x1, cy + 50 as y1 from c where k % 4 = 0),
pred as (select scene, k as id, cx + (k % 4 - 1) * 17 as x0, cy + k % 5 * 8 as y0, cx + (k % 4 - 1) * 17 + 10 + k % 7 as x1, cy + k % 5 * 8 + 10 + p_size as y1 from c where k % 4 <> 0),
o as (select p.scene, g.id as gt, greatest(0, least(p.x1, g.x1) - greatest(p.x0, g.x0)) * greatest(0, least(p.y1, g.y1) - greatest(p.y0, g.y0)) as overlap, (p.x1 - p.x0) * (p.y1 - p.y0) as pa from pred p join gt g on p.scene = g.scene and p.x0 <= g.x1 and g.x0 <= p.x1 and p.y0 <= g.y1 and g.y0 <= p.y1),
grp as (select scene, gt, count(*) as members, sum(overlap) / (sum(pa) + 2500 - sum(overlap) + 1e-9::double) as iou from o where overlap > 0.5 * pa group by all)"""


@query(
    f"""with {TERRACES}, n as (select scene, sum(np) as np, sum(ng) as ng from (select scene, 1 as np, 0 as ng from pred union all select scene, 0, 1 from gt) group by scene)
select n.scene, threshold, count(gt) filter (iou >= threshold) as tp, (any_value(np) - coalesce(sum(members) filter (iou >= threshold), 0))::bigint as fp, (any_value(ng) - count(gt) filter (iou >= threshold))::bigint as fn
from n cross join {LEVELS} left join grp on grp.scene = n.scene group by n.scene, threshold"""
)
def merge_match(spark: SparkSession, d: str) -> DataFrame:
    preds, gts = _terraces(spark, d)
    pairs = matching.grid_join(preds, gts, 64.0, "scene")
    pairs = pairs.select("scene", F.col("l_id").alias("pred"), F.col("r_id").alias("gt"), matching.box_area("l_").alias("pred_area"), matching.box_area("r_").alias("gt_area"), matching.box_overlap().alias("overlap"))
    return matching.merge_scored(matching.merged_groups(pairs), preds, gts, THRESHOLDS)


@query(
    """with c as (select p_partkey as k, p_partkey // 4 as cell from part), g as (select cell, k as gt from c where k % 4 = 0),
m as (select cell, k % 4 as slot, lag(k % 4) over (partition by cell order by k) as before from c where k % 4 <> 0)
select 's' || (m.cell % 3) as scene, gt, count(*) as members, round(40 * (20 * count(*) - 8 * count(*) filter (slot = before + 1)) / 2500, 6) as iou from m join g using (cell) group by all"""
)
def merge_union(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping predictions inside a label count with their union."""
    k, cell = F.col("p_partkey"), F.floor(F.col("p_partkey") / 4)
    cx, cy = cell % 40 * 60, F.floor(cell / 40) * 120
    box = lambda x, y, w, h: F.array(F.array(*[F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]))
    layer = lambda rows, rings: rows.select(F.concat(F.lit("s"), cell % 3).alias("scene"), k.cast("int").alias("seq"), rings.alias("rings"))
    parts = table(spark, d, "part")
    gts = layer(parts.filter(k % 4 == 0), box(cx, cy, 50, 50))
    preds = layer(parts.filter(k % 4 != 0), box(cx + (k % 4 - 1) * 12, cy + 5, 20, 40))
    groups = vectorise.merged_unions(vectorise.candidates(preds, gts), preds, gts)
    return groups.select("scene", F.col("gt").cast("long").alias("gt"), "members", r6(F.col("iou")).alias("iou"))


# ---------------------------------------------------------------- rings


def rings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", M.ring_of(F.col("embedding")).alias("ring"))


RINGS = """pt as (select vec_id, label, i, embedding[2 * i + 1]::double as x, embedding[2 * i + 2]::double as y from embeddings, unnest(range(len(embedding) // 2)) t(i)),
e as (select vec_id, label, i, x, y, coalesce(lead(x) over w, first_value(x) over w) as bx, coalesce(lead(y) over w, first_value(y) over w) as qy,
  coalesce(lag(x) over w, last_value(x) over (w rows between unbounded preceding and unbounded following)) as px, coalesce(lag(y) over w, last_value(y) over (w rows between unbounded preceding and unbounded following)) as py from pt window w as (partition by vec_id order by i))"""


@query(
    f"""with {RINGS}, s as (select vec_id, count(*) as vertices, abs(sum(x * qy - bx * y)) / 2 as area, sum(sqrt((bx - x) * (bx - x) + (qy - y) * (qy - y))) as perimeter,
  atan2(sum(sqrt((bx - x) * (bx - x) + (qy - y) * (qy - y)) * sin(4 * atan2(qy - y, bx - x))), sum(sqrt((bx - x) * (bx - x) + (qy - y) * (qy - y)) * cos(4 * atan2(qy - y, bx - x)))) / 4 as a from e group by vec_id)
select vec_id, vertices, round(area, 6) as area, round(perimeter, 6) as perimeter, round(case when a < 0 then a + pi() / 2 else a end, 6) as angle from s"""
)
def ring_metrics(spark: SparkSession, d: str) -> DataFrame:
    ring = F.col("ring")
    return rings(spark, d).select("vec_id", F.size(ring).cast("long").alias("vertices"), r6(M.ring_area(ring)).alias("area"), r6(M.ring_length(ring)).alias("perimeter"), r6(M.dominant_angle(ring)).alias("angle"))


@query(
    f"""with {RINGS}, a as (select vec_id, degrees(acos(greatest(-1, least(1, ((px - x) * (bx - x) + (py - y) * (qy - y)) / (sqrt((px - x) * (px - x) + (py - y) * (py - y)) * sqrt((bx - x) * (bx - x) + (qy - y) * (qy - y))))))) as deg from e)
select vec_id, round(avg((abs(deg - 90) <= 10 or abs(deg - 180) <= 10)::int), 6) as orthogonality, round(min(deg), 4) as sharpest from a group by vec_id"""
)
def ring_orthogonality(spark: SparkSession, d: str) -> DataFrame:
    ring = F.col("ring")
    return rings(spark, d).select("vec_id", r6(M.orthogonality(ring)).alias("orthogonality"), (F.round(F.array_min(M.corner_angles(ring)), 4) + 0.0).alias("sharpest"))


DISPLACED = f"""{RINGS}, side as (select a.vec_id, 1 as s, a.i, min(sqrt(power(a.x - (b.x + t * (b.bx - b.x)), 2) + power(a.y - (b.y + t * (b.qy - b.y)), 2))) as dist
  from (select a.vec_id, a.i, a.x, a.y, b.vec_id as other, b.x as ex, b.y as ey from e a join (select distinct vec_id, 0 as x, 0 as y from e) b on b.vec_id = a.vec_id + 1) a join e b on b.vec_id = a.other,
  lateral (select greatest(0, least(1, coalesce(((a.x - b.x) * (b.bx - b.x) + (a.y - b.y) * (b.qy - b.y)) / nullif(power(b.bx - b.x, 2) + power(b.qy - b.y, 2), 0), 0))) as t) group by all
union all select a.other as vec_id, 2, a.i, min(sqrt(power(a.x - (b.x + t * (b.bx - b.x)), 2) + power(a.y - (b.y + t * (b.qy - b.y)), 2)))
  from (select a.vec_id, a.i, a.x, a.y, b.vec_id as other from e a join (select distinct vec_id from e) b on b.vec_id = a.vec_id - 1) a join e b on b.vec_id = a.other,
  lateral (select greatest(0, least(1, coalesce(((a.x - b.x) * (b.bx - b.x) + (a.y - b.y) * (b.qy - b.y)) / nullif(power(b.bx - b.x, 2) + power(b.qy - b.y, 2), 0), 0))) as t) group by all),
polis as (select vec_id, sum(m) / 2 as polis from (select vec_id, s, avg(dist) as m from side group by all) group by vec_id)"""


def displaced(spark: SparkSession, d: str) -> DataFrame:
    a = rings(spark, d)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("ring").alias("next"))
    return a.join(b, "vec_id").select("vec_id", "label", matching.ring_displacement(F.col("ring"), F.col("next")).alias("polis"))


@query(f"with {DISPLACED} select vec_id, round(polis, 6) as polis from polis")
def best_match_displacement(spark: SparkSession, d: str) -> DataFrame:
    return displaced(spark, d).select("vec_id", r6("polis").alias("polis"))


@query(f"with {DISPLACED} select count(*) as n, round(avg(polis), 5) as mean, round(quantile_cont(polis, 0.5), 5) as median, round(quantile_cont(polis, 0.9), 5) as p90 from polis")
def displacement_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return displaced(spark, d).agg(F.count("polis").alias("n"), F.round(F.avg("polis"), 5).alias("mean"), F.round(F.percentile("polis", 0.5), 5).alias("median"), F.round(F.percentile("polis", 0.9), 5).alias("p90"))


@query(
    f"""with {RINGS}, s as (select vec_id, any_value(label) as label, count(*) as v, abs(sum(x * qy - bx * y)) / 2 as area from e group by vec_id), g as (select label, count(*) as n, avg(area) as m from s group by label)
select sum(n)::bigint as rings, round(avg(m), 5) as macro_area, round((select avg(area) from s), 5) as mean_area from g"""
)
def shape_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean of scene means next to the mean over all rings."""
    shapes = rings(spark, d).select("label", M.ring_area(F.col("ring")).alias("area"))
    scenes = shapes.groupBy("label").agg(F.count("*").alias("n"), F.avg("area").alias("m"), F.sum("area").alias("s"))
    return scenes.agg(F.sum("n").alias("rings"), F.round(F.avg("m"), 5).alias("macro_area"), F.round(F.sum("s") / F.sum("n"), 5).alias("mean_area"))


@query(
    """with p as (select p_partkey as k, p_partkey % 7 as scene, 10 + p_size as w from part),
v as (select 'pred_reg' as variant, scene, 4 as v, 1.0::double as o from p where k % 11 <> 0
  union all select 'pred_raw', scene, 5, (2 + case when degrees(atan(4.0::double / w)) <= 10 then 2 else 0 end + case when 2 * degrees(atan(4.0::double / w)) <= 10 then 1 else 0 end) / 5.0::double from p where k % 11 <> 0
  union all select 'gt_traced', scene, 8, 1.0::double from p union all select 'gt_simplified', scene, 4, 1.0::double from p),
s as (select variant, scene, count(*) as n, avg(v) as v, avg(o) as o from v group by all)
select variant, sum(n)::bigint as buildings, round(avg(v), 6) as vertices, round(avg(o), 6) as orthogonality from s group by variant"""
)
def shape_variants(spark: SparkSession, d: str) -> DataFrame:
    """The four variants of one layer: squared, with a bump in a wall, traced with a corner in the middle of each wall, and that simplified. Missing shapes don't count."""
    k, w, h = F.col("p_partkey"), 10.0 + F.col("p_size"), 10.0 + F.col("p_partkey") % 23
    p = lambda x, y: F.struct((F.lit(0.0) + x).alias("x"), (F.lit(0.0) + y).alias("y"))
    zero = F.lit(0.0)
    shapes = {
        "pred_reg": [p(zero, zero), p(w, zero), p(w, h), p(zero, h)],
        "pred_raw": [p(zero, zero), p(w / 2, F.lit(2.0)), p(w, zero), p(w, h), p(zero, h)],
        "gt_traced": [p(zero, zero), p(w / 2, zero), p(w, zero), p(w, h / 2), p(w, h), p(w / 2, h), p(zero, h), p(zero, h / 2)],
    }
    rows = table(spark, d, "part")
    layers = {n: rows.select((k % 7).cast("string").alias("scene"), F.when((k % 11 != 0) | F.lit(n == "gt_traced"), F.array(F.array(*c))).alias("rings")) for n, c in shapes.items()}
    found = reports.shape_table(layers | {"gt_simplified": layers["gt_traced"]}, {"gt_simplified": 0.5})
    return found.withColumns({c: r6(c) for c in ("vertices", "orthogonality")})


@query("select r_name as region, round(quantile_cont(s_acctbal, 0.5), 4) as median, round(quantile_cont(s_acctbal, 0.9), 4) as p90, count(*) as n from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name")
def area_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles by linear interpolation."""
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("r_name").alias("region")).agg(F.round(F.percentile("s_acctbal", 0.5), 4).alias("median"), F.round(F.percentile("s_acctbal", 0.9), 4).alias("p90"), F.count("*").alias("n"))


@query(
    """select s_suppkey, round(x, 6) as x, round(y, 6) as y, round((x - 500000) / 0.3, 4) as col, round((4000000 - y) / 0.3, 4) as row
from (select s_suppkey, 500000 + 0.3 * (s_suppkey * 37 % 5000) as x, 4000000 - 0.3 * (s_suppkey * 91 % 5000) as y from supplier)"""
)
def affine_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    t = F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("abcdef", (0.3, 0, 500000, 0, -0.3, 4000000), strict=True)])
    rows = table(spark, d, "supplier").select("s_suppkey", t.alias("t"), M.to_map(t, k * 37 % 5000, k * 91 % 5000).alias("m"))
    back = M.to_pixel(F.col("t"), F.col("m.x"), F.col("m.y"))
    return rows.select("s_suppkey", r6("m.x").alias("x"), r6("m.y").alias("y"), (F.round(back["col"], 4) + 0.0).alias("col"), (F.round(back["row"], 4) + 0.0).alias("row"))


# ---------------------------------------------------------------- rasters


def lattice(spark: SparkSession, d: str, above: float) -> DataFrame:
    """Cells (scene, row, col): users by days."""
    e = table(spark, d, "events").filter(F.col("value") > above)
    return e.select(F.lit(0).alias("scene"), F.col("user_id").cast("int").alias("row"), F.dayofmonth("ts").alias("col")).distinct()


def _lattice_sql(above: float, name: str = "cell") -> str:
    return f"{name} as (select distinct user_id::int as row, day(ts)::int as col from events where value > {above})"


def _eroded_sql(cell: str, out: str, element: tuple[tuple[int, int], ...]) -> str:
    offsets = ", ".join(f"({r}, {c})" for r, c in element)
    return f"{out} as (select a.row, a.col from {cell} a cross join (values {offsets}) o(r, c) join {cell} b on b.row = a.row + o.r and b.col = a.col + o.c group by a.row, a.col having count(*) = {len(element)})"


@query(f"with {_lattice_sql(40)}, {_eroded_sql('cell', 'kept', raster.CROSS)} select 0 as scene, row, col from cell where (row, col) not in (select (row, col) from kept)")
def erode_band(spark: SparkSession, d: str) -> DataFrame:
    return raster.boundary_band(lattice(spark, d, 40), raster.CROSS)


def _band_sql(width: int) -> str:
    element = raster.ellipse(width)
    return f"""with {_lattice_sql(20, 'a')}, {_lattice_sql(35, 'b')}, {_eroded_sql('a', 'ka', element)}, {_eroded_sql('b', 'kb', element)},
ba as (select row, col from a except select row, col from ka), bb as (select row, col from b except select row, col from kb)
select 0 as scene, {width} as d, count(*) filter (x.row is not null and y.row is not null) as tp, count(*) filter (y.row is null) as fp, count(*) filter (x.row is null) as fn
from ba x full join bb y on x.row = y.row and x.col = y.col"""


@query(" union all ".join(f"({_band_sql(w)})" for w in (1, 2, 3)))
def boundary_counts(spark: SparkSession, d: str) -> DataFrame:
    a, b = lattice(spark, d, 20), lattice(spark, d, 35)
    one, two, three = (raster.band_counts(a, b, w) for w in (1, 2, 3))
    return one.unionByName(two).unionByName(three)


def _components_sql(near: str) -> str:
    return f"""with recursive {_lattice_sql(150)}, walk(id, row, col) as (
  select row::bigint * 2147483648 + col, row, col from cell
  union
  select w.id, c.row, c.col from walk w join cell c on {near}
) select 0 as scene, row, col, min(id) as label from walk group by row, col"""


@query(_components_sql("abs(w.row - c.row) + abs(w.col - c.col) = 1"))
def components4(spark: SparkSession, d: str) -> DataFrame:
    return raster.components(lattice(spark, d, 150))


@query(_components_sql("abs(w.row - c.row) <= 1 and abs(w.col - c.col) <= 1"))
def components8(spark: SparkSession, d: str) -> DataFrame:
    return raster.components(lattice(spark, d, 150), eight=True)


@query(
    _components_sql("abs(w.row - c.row) + abs(w.col - c.col) = 1").replace(") select 0", "), lab as (select 0").replace("from walk group by row, col", "from walk group by row, col)")
    + " select label, count(*) as cells from lab group by label having count(*) >= 3"
)
def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    kept = raster.without_small(raster.components(lattice(spark, d, 150)), 3)
    return kept.groupBy("label").agg(F.count("*").alias("cells"))


@query(
    """with v as (select event_type as scene, user_id::int as row, (hour(ts) + 24 * day(ts))::int as col, value from events),
p as (select scene, row // 8 as row, col // 8 as col, avg(value) as mean from v group by all)
select scene, row, col, round(mean, 5) as mean from (select *, row_number() over (partition by scene order by round(mean, 9) desc, row, col) as nth from p where mean > 0) where nth = 1"""
)
def mean_pool_top_window(spark: SparkSession, d: str) -> DataFrame:
    pooled = raster.mean_pool(hourly(spark, d), "value", 8).withColumn("mean", F.round("mean", 9))
    return raster.top_window(pooled).withColumn("mean", F.round("mean", 5))


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """Cells with values: a scene an event type, users by hours."""
    return table(spark, d, "events").select(F.col("event_type").alias("scene"), F.col("user_id").cast("int").alias("row"), (F.hour("ts") + 24 * F.dayofmonth("ts")).cast("int").alias("col"), "value")


@query(
    """with v as (select event_type as scene, user_id::int as row, (hour(ts) + 24 * day(ts))::int as col, value from events),
p as (select scene, row // 8 as row, col // 8 as col, avg(value) as mean from v group by all), z as (select scene, max(row) as bottom, max(col) as far from p group by scene),
w as (select z.scene, 2 * r.k as row, 2 * c.k as col from z, unnest(range(z.bottom // 2 + 1)) r(k), unnest(range(z.far // 2 + 1)) c(k) where (r.k = 0 or 2 * r.k < z.bottom - 3) and (c.k = 0 or 2 * c.k < z.far - 3)),
m as (select w.scene, w.row, w.col, round(sum(p.mean) / 16, 9) as mean from w join p on p.scene = w.scene and p.row >= w.row and p.row < w.row + 4 and p.col >= w.col and p.col < w.col + 4 group by all)
select scene, row::int as row, col::int as col, round(mean, 5) as mean from (select *, row_number() over (partition by scene order by mean desc, row, col) as nth from m where mean > 0) where nth = 1"""
)
def densest_half_stride(spark: SparkSession, d: str) -> DataFrame:
    found = raster.densest_window(raster.mean_pool(hourly(spark, d), "value", 8), 4)
    return found.select("scene", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.round("mean", 5).alias("mean"))


@query(
    """with t as (select distinct p_size * 100 + 512 as total from part), s as (select total, unnest(range(0, total - 512 + 1, 384)) as start from t union select total, total - 512 from t)
select total, count(*) as windows, max(start)::int as last, sum(start)::bigint as starts from s group by total"""
)
def window_starts(spark: SparkSession, d: str) -> DataFrame:
    totals = table(spark, d, "part").select((F.col("p_size") * 100 + 512).cast("int").alias("total")).distinct()
    starts = totals.select("total", F.explode(raster.window_starts(F.col("total"), 512, 384)).alias("start"))
    return starts.groupBy("total").agg(F.count("*").alias("windows"), F.max("start").alias("last"), F.sum("start").alias("starts"))


@query(
    """with strip as (select user_id as pos, avg(value) / 400 as v from events group by 1), total as (select max(pos) + 1 as n from strip),
w as (select unnest(range(0, greatest(n - 64, 0) + 1, 48)) as start from total union select greatest(n - 64, 0) from total),
c as (select pos, v * (1 + start % 97 / 1000.0::double) as value, least(pos - start, 63 - (pos - start)) as edge from strip join w on pos >= start and pos < start + 64),
g as (select pos, value, greatest(1e-3::double, case when edge < 16 then 0.5::double - 0.5::double * cos(pi() * edge / 31) else 1 end) as weight from c)
select pos, round(greatest(0, least(1, sum(value * weight) / greatest(sum(weight), 1e-6::double))), 6) as blend, count(*) as windows from g group by pos"""
)
def blend_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """A strip as long as there are users, seen by overlapping windows that differ in their values, blended by the taper that scenes are blended by."""
    strip = table(spark, d, "events").groupBy(F.col("user_id").alias("pos")).agg((F.avg("value") / 400).alias("v"))
    total = strip.agg((F.max("pos") + 1).cast("int").alias("n"))
    starts = total.select(F.explode(raster.window_starts(F.col("n"), 64, 48)).alias("start"))
    # a position lies in the windows of at most two regular starts and the last one
    cells = starts.select("start", F.explode(F.sequence(F.col("start"), F.col("start") + 63)).alias("pos")).join(strip, "pos")
    cells = cells.select("pos", (F.col("v") * (1 + F.col("start") % 97 / 1000.0)).alias("value"), raster.taper_column(F.col("pos") - F.col("start"), 64, 16).alias("weight"))
    return raster.blended(cells.withColumn("pos", F.col("pos").cast("long")), "pos").withColumn("blend", r6("blend"))


TRIPLES = "t as (select vec_id, label, i, embedding[3 * i + 1]::double as r, embedding[3 * i + 2]::double as g, embedding[3 * i + 3]::double as b from embeddings, unnest(range(len(embedding) // 3)) u(i))"


def triples(spark: SparkSession, d: str) -> DataFrame:
    at = F.sequence(F.lit(0), F.floor(F.size("embedding") / 3).cast("int") - 1)
    rows = table(spark, d, "embeddings").select("vec_id", "label", "embedding", F.explode(at).alias("i"))
    return rows.select("vec_id", "label", "i", *[F.get("embedding", 3 * F.col("i") + k).cast("double").alias(c) for k, c in enumerate("rgb")])


@query(
    f"""with {TRIPLES} select vec_id, i::int as i, round((r - avg(r) over w) / (stddev_pop(r) over w + 1e-6::double), 5) as r, round((g - avg(g) over w) / (stddev_pop(g) over w + 1e-6::double), 5) as g,
round((b - avg(b) over w) / (stddev_pop(b) over w + 1e-6::double), 5) as b from t window w as (partition by vec_id)"""
)
def tile_standardize(spark: SparkSession, d: str) -> DataFrame:
    return raster.standardised(triples(spark, d), ["vec_id"], ["r", "g", "b"]).select("vec_id", "i", *[(F.round(c, 5) + 0.0).alias(c) for c in "rgb"])


@query(f"with {TRIPLES} select label, round(avg(2 * g - r - b), 5) as exg, count(*) as n from t group by label")
def excess_green(spark: SparkSession, d: str) -> DataFrame:
    return triples(spark, d).groupBy("label").agg((F.round(F.avg(raster.excess_green(F.col("r"), F.col("g"), F.col("b"))), 5) + 0.0).alias("exg"), F.count("*").alias("n"))


@query("select vec_id, i // 8 as row, i % 8 as col, round(embedding[i + 1]::double, 6) as mean, 8 as ops from embeddings, unnest(range(64)) t(i)")
def tta_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Eight flips and turns of an 8 x 8 tile, undone and averaged: the tile itself."""
    cells = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", F.floor(F.col("i") / 8).cast("int").alias("row"), (F.col("i") % 8).cast("int").alias("col"), F.col("v").cast("double").alias("v"))
    views = []
    for op in range(8):
        row, col = raster.turned(8, op, F.col("row"), F.col("col"))
        back_row, back_col = raster.unturned(8, op, F.col("m.row"), F.col("m.col"))
        views.append((F.struct(row.alias("row"), col.alias("col"), F.lit(op).alias("op")), back_row, back_col))
    moved = cells.select("vec_id", "v", F.explode(F.array(*[v for v, _, _ in views])).alias("m"))
    pick = lambda k: F.coalesce(*[F.when(F.col("m.op") == op, v[k]) for op, v in enumerate(views)])
    undone = moved.select("vec_id", pick(1).cast("long").alias("row"), pick(2).cast("long").alias("col"), "v")
    return undone.groupBy("vec_id", "row", "col").agg(r6(F.avg("v")).alias("mean"), F.count("*").cast("int").alias("ops"))


# ---------------------------------------------------------------- experiments


RUNS = f"runs as (select nation as tag, round(tp::double / (tp + fp + fn + {EPS}), 6) as iou from (select nation, {COUNTS} from graded group by nation))"


def runs(spark: SparkSession, d: str) -> DataFrame:
    return pixels.finished(pixels.counted(graded(spark, d), "nation")).select(F.col("nation").alias("tag"), r6("iou").alias("iou"))


@query(f"with {GRADED}, {RUNS}, new as (select tag, iou + 1 as iou from runs where tag like '%A') select * from runs where tag not in (select tag from new) union all select * from new")
def upsert_by_tag(spark: SparkSession, d: str) -> DataFrame:
    rows = runs(spark, d)
    return experiments.upserted(rows, rows.filter(F.col("tag").endswith("A")).withColumn("iou", F.col("iou") + 1), "tag")


@query(f"with {GRADED}, {RUNS} select tag, iou, round(iou - (select iou from runs where tag = (select min(tag) from runs)), 6) as delta from runs")
def delta_vs_baseline(spark: SparkSession, d: str) -> DataFrame:
    rows = runs(spark, d)
    first = rows.agg(F.min("tag")).first()[0]
    return experiments.deltas(rows, "tag", first or "", "iou").withColumn("delta", r6("delta"))


ORDER = ["FRANCE", "BRAZIL", "CHINA", "NATION_0", "NATION_1", "NATION_2"]


@query(f"with {GRADED}, {RUNS} select tag, iou, coalesce(list_position({ORDER}, tag) - 1, 99)::int as place from runs")
def ladder_order(spark: SparkSession, d: str) -> DataFrame:
    return experiments.by_place(runs(spark, d), "tag", ORDER)


@query("select n_regionkey, n_nationkey, n_name, string_agg(n_name, ',') over (partition by n_regionkey order by n_nationkey rows unbounded preceding) as items from nation")
def cumulative_overrides(spark: SparkSession, d: str) -> DataFrame:
    return experiments.cumulative(table(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name"), "n_regionkey", "n_nationkey", "n_name")


@query(
    """with s as (select distinct p_partkey as step from part), n as (select count(*) as total from s)
select step, round(case when step < least(500, greatest(50, total // 2)) then step::double / least(500, greatest(50, total // 2))
  else 0.5 * (1 + cos(pi() * least(1, (step - least(500, greatest(50, total // 2)))::double / greatest(1, total - least(500, greatest(50, total // 2)))))) end, 6) as share from s, n"""
)
def lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "part").select(F.col("p_partkey").alias("step")).distinct()
    total = steps.count()
    return steps.select("step", r6(experiments.warmup_cosine(F.col("step"), min(500, max(50, total // 2)), total)).alias("share"))


@query(
    """with d as (select event_type, day(ts)::int as day, round(avg(value), 6) as v from events group by all), w as (select *, max(v) over (partition by event_type order by day rows between unbounded preceding and 1 preceding) as was from d)
select event_type, day, v, was is null or v > was as improved, greatest(v, coalesce(was, v)) as best from w"""
)
def running_best(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").groupBy("event_type", F.dayofmonth("ts").alias("day")).agg(r6(F.avg("value")).alias("v"))
    return experiments.running_best(days, "event_type", "day", "v")


LOSS = "c as (select l_suppkey as tile, l_discount * 10 as p, (l_returnflag = 'R')::int::double as y from lineitem)"


def loss_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("tile"), (F.col("l_discount") * 10).alias("p"), (F.col("l_returnflag") == "R").cast("double").alias("y"))


@query(f"with {LOSS} select tile, round(1 - (2 * sum(p * y) + 1) / (sum(p) + sum(y) + 1), 6) as loss from c group by tile")
def soft_dice(spark: SparkSession, d: str) -> DataFrame:
    return loss_cells(spark, d).groupBy("tile").agg(r6(experiments.soft_dice(F.col("p"), F.col("y"))).alias("loss"))


@query(f"with {LOSS} select tile, round(power(greatest(1 - (sum(p * y) + 1) / (sum(p * y) + 0.3::double * sum(p * (1 - y)) + 0.7::double * sum((1 - p) * y) + 1), 1e-7::double), 0.75::double), 6) as loss from c group by tile")
def focal_tversky(spark: SparkSession, d: str) -> DataFrame:
    return loss_cells(spark, d).groupBy("tile").agg(r6(experiments.focal_tversky(F.col("p"), F.col("y"))).alias("loss"))


@query("select n_name, n_regionkey, row_number() over (order by nth, n_regionkey) as turn, nth from (select *, row_number() over (partition by n_regionkey order by n_name) as nth from nation)")
def round_robin_pick(spark: SparkSession, d: str) -> DataFrame:
    picked = experiments.round_robin(table(spark, d, "nation").select("n_name", "n_regionkey"), "n_regionkey", "n_name")
    return picked.withColumns({"turn": F.col("turn").cast("long"), "nth": F.col("nth").cast("long")})


@query("select c_mktsegment as city, count(*) filter (c_custkey in (select o_custkey from orders)) as scored, count(*) filter (c_custkey not in (select o_custkey from orders)) as missing from customer group by 1")
def city_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    customers, done = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    have = customers.join(done, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("scored"))
    lack = experiments.remaining(customers, done, "c_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("missing"))
    return have.join(lack, "c_mktsegment", "full").select(F.col("c_mktsegment").alias("city"), F.coalesce("scored", F.lit(0)).alias("scored"), F.coalesce("missing", F.lit(0)).alias("missing"))


@query(f"with {GRADED}, {RUNS} select tag, printf('%.4f', iou) as cell from runs")
def metrics_markdown(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).select("tag", experiments.markdown_cell(F.col("iou")).alias("cell"))


# ---------------------------------------------------------------- limits, filters, learning


@query("select s_nationkey, s_suppkey, s_acctbal from (select *, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as nth from supplier) where nth <= 3")
def first_in_group(spark: SparkSession, d: str) -> DataFrame:
    """A limit by group in a total order."""
    rows = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return ordering.limited_by(rows, "s_nationkey", [F.desc("s_acctbal"), "s_suppkey"], 3)


@query("select n_nationkey, n_name from nation where n_name in ('FRANCE', 'NATION_1', 'NATION_12', 'CHINA')")
def name_filter(spark: SparkSession, d: str) -> DataFrame:
    return ordering.named(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_name", " FRANCE, NATION_1 ,NATION_12,CHINA,")


def _softplus(x: str) -> str:
    return f"(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"


HEADS = """h as (select l_suppkey as tile, (l_quantity - 25) / 10 as xi, (l_returnflag = 'R')::int::double as yi, (l_discount - 0.05) * 40 as xb, (l_linestatus = 'F')::int::double as yb from lineitem)"""


@query(
    f"""with {HEADS}, p as (select *, 1 / (1 + exp(-xi)) as pi, 1 / (1 + exp(-xb)) as pb from h),
s as (select tile, avg(yi * {_softplus("-xi")} + (1 - yi) * {_softplus("xi")}) as bi, avg(3 * yb * {_softplus("-xb")} + (1 - yb) * {_softplus("xb")}) as bb,
  1 - (2 * sum(pi * yi) + 1) / (sum(pi) + sum(yi) + 1) as di, 1 - (2 * sum(pb * yb) + 1) / (sum(pb) + sum(yb) + 1) as db from p group by tile)
select tile, round(bi, 6) as bce_int, round(bb, 6) as bce_bnd, round(0.5 * bi + 0.5 * di + 0.5 * (0.5 * bb + 0.5 * db), 6) as loss from s"""
)
def loss_total(spark: SparkSession, d: str) -> DataFrame:
    """Both heads' losses, boundary positives weighted by 3."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("tile"), ((F.col("l_quantity") - 25) / 10).alias("xi"), (F.col("l_returnflag") == "R").cast("double").alias("yi"),
        ((F.col("l_discount") - 0.05) * 40).alias("xb"), (F.col("l_linestatus") == "F").cast("double").alias("yb"),
    )
    i, b = (F.col("xi"), F.col("yi")), (F.col("xb"), F.col("yb"))
    loss = learning.total_loss(learning.head_loss(*i), learning.head_loss(*b, pos_weight=3.0))
    return rows.groupBy("tile").agg(r6(learning.bce(*i)).alias("bce_int"), r6(learning.bce(*b, 3.0)).alias("bce_bnd"), r6(loss).alias("loss"))


@query("select o_orderstatus, round(avg(m), 4) as loss from (select o_orderstatus, o_custkey, avg(o_totalprice) as m from orders group by all) group by o_orderstatus")
def epoch_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean of batch means, whatever the batches' sizes."""
    batches = table(spark, d, "orders").groupBy("o_orderstatus", "o_custkey").agg(F.avg("o_totalprice").alias("loss"))
    return learning.epoch_means(batches, "o_orderstatus", "loss").withColumn("loss", F.round("loss", 4))


@query(f"with {TRIPLES} select label, round(avg((r / 255 - 0.485) / 0.229), 5) as r, round(avg((g / 255 - 0.456) / 0.224), 5) as g, round(avg((b / 255 - 0.406) / 0.225), 5) as b from t group by label")
def fixed_normalize(spark: SparkSession, d: str) -> DataFrame:
    return triples(spark, d).groupBy("label").agg(*[(F.round(F.avg(learning.normalised(c)), 5) + 0.0).alias(c) for c in "rgb"])


@query("select c_custkey, (nth - 1) // 64 as batch, (nth - 1) % 64 as place from (select c_custkey, row_number() over (order by md5('7:' || c_custkey), c_custkey) as nth from customer)")
def shuffled_batches(spark: SparkSession, d: str) -> DataFrame:
    return ordering.batches(table(spark, d, "customer").select("c_custkey"), "c_custkey", 64, seed=7)


@query(f"with {BOXES} select scene, count(*) as polygons, count(*) filter (x1 >= 300 and x0 <= 556 and y1 >= 200 and y0 <= 456) as visible from box group by scene")
def crop_visibility(spark: SparkSession, d: str) -> DataFrame:
    """Every polygon counts, those whose box meets the crop are drawn."""
    corners = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    every = boxes(spark, d, False).unionByName(boxes(spark, d, True))
    return every.groupBy("scene").agg(F.count("*").alias("polygons"), F.count_if(raster.visible(corners, F.lit(200), F.lit(300), 256)).alias("visible"))


@query("select p_size, count(*) filter (p_partkey % 3 = 1) as polygons, count(*) as n from part group by p_size")
def polygon_filter(spark: SparkSession, d: str) -> DataFrame:
    """Geometries that are there and polygons, among missing ones and points."""
    k = F.col("p_partkey")
    wkb = F.when(k % 3 == 1, F.unhex(F.lit("010300000000000000"))).when(k % 3 == 2, F.unhex(F.lit("0101000000" + "00" * 16)))
    return table(spark, d, "part").groupBy("p_size").agg(F.count_if(is_polygon(wkb)).alias("polygons"), F.count("*").alias("n"))


@query("select coalesce(sum(p_size * (p_partkey % 7 + 1)) filter (p_partkey % 3 <> 0), 0)::bigint as n from part")
def parameter_count(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return learning.parameter_count(table(spark, d, "part").select(F.array(F.col("p_size").cast("int"), (k % 7 + 1).cast("int")).alias("shape"), (k % 3 != 0).alias("trainable")))


# ---------------------------------------------------------------- kernels, checked by tests and by their rows


@query(
    """with r as (select p_partkey as id, 10 + p_size as w, 10 + p_partkey % 23 as h, [0, 0.1, 0.2, 0.3, 0.4, 0.56, 0.66][p_partkey % 7 + 1]::double as bend from part)
select id, (case when bend > 0.6 then 8 else 4 end)::int as n_vertices, round(w * (h - case when bend > 0.5 then bend / 2 else 0 end) - case when bend > 0.6 then 2 * 5.98::double else 12 end, 2) as area_m2, 1.0::double as orthogonality from r"""
)
def rect_regularize(spark: SparkSession, d: str) -> DataFrame:
    """A turned rectangle with a bent wall and a hole near it for each part: bends up to the tolerance are thinned away, others squared, and a wall that moves into the hole cuts it."""
    k = F.col("p_partkey")
    bend = F.element_at(F.array(*map(F.lit, (0.0, 0.1, 0.2, 0.3, 0.4, 0.56, 0.66))), (k % 7 + 1).cast("int"))
    rows = table(spark, d, "part").select(k.alias("id"), (10.0 + F.col("p_size")).alias("w"), (10.0 + k % 23).alias("h"), F.radians(k % 90).alias("theta"), bend.alias("bend"))

    def square(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            w, h, theta, bend = (batch[c].to_numpy(float) for c in ("w", "h", "theta", "bend"))
            ring = lambda *corners: np.stack([np.stack(np.broadcast_arrays(x, y, w)[:2], 1) for x, y in corners], 1)  # noqa: B023, E731
            shells = ring((0, 0), (w / 2, bend), (w, 0), (w, h), (0, h))
            holes = ring((w - 2.5, 0.31), (w - 2.5, 6.31), (w - 0.5, 6.31), (w - 0.5, 0.31))
            turned = lambda rings: polygons.turned(rings, theta[:, None], np.zeros(2))  # noqa: B023, E731
            many = [list(p) for p in zip(turned(shells), turned(holes), strict=True)]
            got = [g for at in range(0, len(many), vectorise.TOGETHER) for g in many_polygons.cleaned(many[at : at + vectorise.TOGETHER], edge_least=1.0)]
            out = [(g["n_vertices"], g["area_m2"], g["orthogonality"]) if g else (0, 0.0, 0.0) for g in got]
            yield pd.DataFrame(out, columns=["n_vertices", "area_m2", "orthogonality"]).assign(id=batch["id"].to_numpy())

    return spread(rows, "id").mapInPandas(square, "id long, n_vertices int, area_m2 double, orthogonality double")


@query(
    """with b as (select p_partkey // 4 as g, p_partkey * 7 % 15 as x0, p_partkey * 11 % 13 as y0, p_size % 9 + 2 as w, p_partkey % 6 + 2 as h from part),
c as (select distinct g, x0 + i as x, y0 + j as y from b, range(11) u(i), range(8) v(j) where i < w and j < h),
q as (select g, x + i as x, y + j as y, count(*) as n, bool_or(i = j) and bool_or(i <> j) as beside from c, range(2) u(i), range(2) v(j) group by all)
select g, (select count(*) from c where c.g = q.g)::double as area, sum(case when n in (1, 3) then 1 when n = 2 and not beside then 2 else 0 end)::bigint as vertices,
  (sum(case when n = 1 then 1 when n = 3 then -1 when n = 2 and not beside then 2 else 0 end) // 4)::bigint as parts_less_holes from q group by g"""
)
def union_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Unions of four boxes as geometry: area, corners of all rings, and parts less holes."""
    k = F.col("p_partkey")
    boxes_ = table(spark, d, "part").select(F.floor(k / 4).alias("g"), (k * 7 % 15).alias("x0"), (k * 11 % 13).alias("y0"), (F.col("p_size") % 9 + 2).alias("w"), (k % 6 + 2).alias("h"))
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    found = vectorise.united_layer(boxes_.select("g", F.array(F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))).alias("rings")), "g")
    rings = F.flatten("parts")
    return found.select("g", r6("area").alias("area"), F.aggregate(rings, F.lit(0).cast("long"), lambda n, r: n + F.size(r)).alias("vertices"), (2 * F.size("parts") - F.size(rings)).cast("long").alias("parts_less_holes"))


def part_scenes(spark: SparkSession, d: str, faint: bool = False) -> tuple[DataFrame, DataFrame]:
    """Probability and label blocks: each part a building on a lattice, 256 a scene. faint predicts those in odd slots too low."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(F.concat(F.lit("s"), F.floor(k / 256)).alias("scene"), (k % 256).cast("int").alias("slot"), (F.col("p_size") % 20 + 12).cast("int").alias("w"), (k % 17 + 12).cast("int").alias("h"))

    def draw(kind: str):
        def one(batch: pd.DataFrame) -> pd.DataFrame:
            mask, wall = np.zeros((640, 640), np.uint8), np.zeros((640, 640), np.uint8)
            for _, slot, w, h in batch.itertuples(index=False):
                r, c = slot // 16 * 40, slot % 16 * 40
                mask[r : r + h, c : c + w] = 100 if faint and kind == "prob" and slot % 2 else 230
                wall[r : r + h, c : c + w] = 200
                wall[r + 1 : r + h - 1, c + 1 : c + w - 1] = 20
            scene = batch["scene"].iloc[0]
            found = to_rows(scene, 320, interior=mask, boundary=wall) if kind == "prob" else to_rows(scene, 320, v=mask)
            return pd.DataFrame(found, columns=["scene", "row0", "col0", "h", "w", *(("interior", "boundary") if kind == "prob" else ("v",))])

        return one

    groups = vectorise.by_scene(rows)
    return groups.applyInPandas(draw("prob"), f"{KEY}, interior binary, boundary binary"), groups.applyInPandas(draw("label"), f"{KEY}, v binary")


@query("select 's' || (p_partkey // 256) as scene, count(*) as tp, 0::bigint as fp, 0::bigint as fn from part group by 1")
def scene_to_matches(spark: SparkSession, d: str) -> DataFrame:
    """Blocks to instances to polygons to matches: every drawn building is found."""
    prob, label = part_scenes(spark, d)
    preds, gts = (materialised(x) for x in (vectorise.prediction_layer(prob, area_least=5.0, edge_least=1.0), vectorise.label_layer(label, area_least=5.0)))
    found = vectorise.candidates(preds, gts, 20.0)
    ids = lambda df: df.select("scene", F.col("seq").alias("id"))
    return matching.scored(matching.mutual_best(found.select("scene", "pred", "gt", "iou")), ids(preds), ids(gts), (0.75,)).drop("threshold")


@query(
    """with b as (select 's' || (p_partkey // 256) as scene, p_partkey % 256 as slot, p_size % 20 + 12 as w, p_partkey % 17 + 12 as h from part),
n as (select *, d, case when d = 0 then w * h else w * h - greatest(0, w - 2 * d) * greatest(0, h - 2 * d) end as cells from b, unnest([0, 1, 3, 7]) t(d))
select scene, d::int as d, coalesce(sum(cells) filter (slot % 2 = 0), 0)::bigint as tp, 0::bigint as fp, coalesce(sum(cells) filter (slot % 2 = 1), 0)::bigint as fn from n group by scene, d"""
)
def block_counts(spark: SparkSession, d: str) -> DataFrame:
    """Confusion of whole scenes (d = 0) and of boundary bands, counted in blocks with a halo."""
    prob, label = (materialised(x) for x in part_scenes(spark, d, faint=True))
    whole = tiles.confusion_of(tiles.graded_bytes(prob, label), "scene").select("scene", F.lit(0).alias("d"), "tp", "fp", "fn")
    return whole.unionByName(tiles.band_counts(prob, label, (1, 3, 7), size=320))


@query(
    """with n as (select n_nationkey as k, 200 + n_nationkey * 7 as tall, 150 + n_nationkey * 11 as wide from nation),
c as (select k, y, x, (y * 3 + x * 5 + (y // 9) * (x // 7) + k * 9) % 256 as grey from n, range(375) v(y), range(420) u(x) where y < tall and x < wide)
select 'n' || k as scene, count(*) as cells, min(grey)::int as low, max(grey)::int as high, sum(grey * ((y * 31 + x * 17) % 101))::bigint as placed from c group by k"""
)
def scene_inference(spark: SparkSession, d: str) -> DataFrame:
    """Windows, eight views and blending of one textured grey scene a nation, every cell of which must come out where it was and as it was."""
    k = F.col("n_nationkey")
    scenes = table(spark, d, "nation").select(F.concat(F.lit("n"), k).alias("scene"), (200 + k * 7).cast("int").alias("tall"), (150 + k * 11).cast("int").alias("wide"), (k * 9).cast("int").alias("shade"))

    def paint(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for scene, tall, wide, shade in batch.itertuples(index=False):
                y, x = np.mgrid[:tall, :wide]
                plane = ((y * 3 + x * 5 + (y // 9) * (x // 7) + shade) % 256).astype(np.uint8)
                yield pd.DataFrame(to_rows(scene, 128, r=plane, g=plane, b=plane), columns=["scene", "row0", "col0", "h", "w", "r", "g", "b"])

    images = scenes.mapInPandas(paint, f"{KEY}, r binary, g binary, b binary")
    found = cells(scoring.scored_blocks(images, scoring.excess_green_scorer, tile=96, overlap=32, size=128), "interior")
    placed = F.sum(F.col("interior") * ((F.col("row") * 31 + F.col("col") * 17) % 101)).cast("long")
    return found.groupBy("scene").agg(F.count("*").alias("cells"), F.min("interior").alias("low"), F.max("interior").alias("high"), placed.alias("placed"))
