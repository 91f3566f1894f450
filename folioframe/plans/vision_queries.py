"""Vision queries: embeddings as logits and probability maps, lineitem boxes as detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.boxes import CLASS_NAMES, CLASS_TYPES
from ..operators import vision as V
from ..registry import query, table
from .geometry_queries import BOXES, boxes

CHARS = "abcdefg"


@query("select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as integer) as best from embeddings")
def argmax(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", V.argmax(F.col("embedding")).alias("best"))


@query(
    """with s as (select vec_id, t, embedding[t * 8 + 1:t * 8 + 8] as r from embeddings, range(0, 8) as x(t)), c as (select vec_id, t, list_position(r, list_max(r)) - 1 as c, list_max(r)::double as p from s),
k as (select *, lag(c) over (partition by vec_id order by t) as b from c)
select e.vec_id, coalesce(string_agg(substr('abcdefg', c::integer, 1), '' order by t), '') as text, round(coalesce(avg(p), 0), 6) as confidence from embeddings e left join k on k.vec_id = e.vec_id and c <> 0 and c is distinct from b group by e.vec_id"""
)
def ctc_decode(spark, sf_dir):
    out = V.ctc_decode(F.col("embedding"), 8, 8, F.array(*map(F.lit, CHARS)))
    return table(spark, sf_dir, "embeddings").select("vec_id", out["text"].alias("text"), F.round(out["confidence"], 6).alias("confidence"))


@query(
    BOXES
    + """, d as (select doc_id, page, ord, cast(ord % 3 as integer) as class_id, ((ord * 37) % 1000) / 1000.0::double as confidence, x as x1, y as y1, x + width * 4 as x2, y + height * 400 as y2 from boxes),
g as (select doc_id, page, class_id, list({'c': -confidence, 'ord': ord, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} order by -confidence, ord) as ds from d group by all),
k as (select doc_id, page, class_id, list_reduce(list_transform(ds, lambda v: [v]), lambda a, v: case when len(list_filter(a, lambda k: least(k.x2, v[1].x2) > greatest(k.x1, v[1].x1) and least(k.y2, v[1].y2) > greatest(k.y1, v[1].y1)
  and (least(k.x2, v[1].x2) - greatest(k.x1, v[1].x1)) * (least(k.y2, v[1].y2) - greatest(k.y1, v[1].y1)) / ((k.x2 - k.x1) * (k.y2 - k.y1) + (v[1].x2 - v[1].x1) * (v[1].y2 - v[1].y1) - (least(k.x2, v[1].x2) - greatest(k.x1, v[1].x1)) * (least(k.y2, v[1].y2) - greatest(k.y1, v[1].y1))) > 0.45)) > 0 then a else list_concat(a, v) end) as kept from g)
select doc_id, page, class_id, u.ord as ord from (select doc_id, page, class_id, unnest(kept) as u from k)"""
)
def nms(spark, sf_dir):
    d = boxes(spark, sf_dir).selectExpr("doc_id", "page", "ord", "cast(ord % 3 as int) as class_id", "((ord * 37) % 1000) / 1000D as confidence", "x as x1", "y as y1", "x + width * 4 as x2", "y + height * 400 as y2")
    return V.suppressed(d).select("doc_id", "page", "class_id", "ord")


@query(BOXES + " select class_id, case class_id " + " ".join(f"when {k} then '{v}'" for k, v in CLASS_NAMES.items()) + " end as name, case class_id " + " ".join(f"when {k} then '{v}'" for k, v in CLASS_TYPES.items()) + " end as type, count(*) as n from (select cast(ord % 10 as integer) as class_id, ((ord * 37) % 1000) / 1000.0::double as confidence from boxes) where confidence >= 0.25 group by class_id")
def class_map(spark, sf_dir):
    d = boxes(spark, sf_dir).selectExpr("cast(ord % 10 as int) as class_id", "((ord * 37) % 1000) / 1000D as confidence").filter("confidence >= 0.25")
    of = lambda m: F.create_map(*(x for k, v in m.items() for x in (F.lit(k), F.lit(v))))[F.col("class_id")]
    return d.groupBy("class_id").agg(F.count("*").alias("n")).select("class_id", of(CLASS_NAMES).alias("name"), of(CLASS_TYPES).alias("type"), "n")


@query(
    """with recursive p as (select vec_id, i - 1 as i, (i - 1) % 8 as x, (i - 1) // 8 as y, embedding[i] as v from embeddings, range(1, 65) as r(i) where embedding[i] >= 0.0::float),
c(vec_id, i, root) as (select vec_id, i, i from p union select n.vec_id, n.i, c.root from c join p a on a.vec_id = c.vec_id and a.i = c.i join p n on n.vec_id = a.vec_id and abs(n.x - a.x) + abs(n.y - a.y) = 1),
l as (select vec_id, i, min(root) as root from c group by all), b as (select l.vec_id, root, min(x) as x1, min(y) as y1, max(x) + 1 as x2, max(y) + 1 as y2, avg(v::double) as score from l join p using (vec_id, i) group by all),
n as (select *, row_number() over (partition by vec_id order by root) as label from b)
select vec_id, cast(label as integer) as label, cast(x1 as integer) as x1, cast(y1 as integer) as y1, cast(x2 as integer) as x2, cast(y2 as integer) as y2, round(score, 6) as score from n where score >= 0.05 and least(x2 - x1, y2 - y1) >= 2"""
)
def mask_components(spark, sf_dir):
    return V.component_boxes(table(spark, sf_dir, "embeddings"), "embedding", 8, threshold=0.0, box_threshold=0.05, least=2, key="vec_id").withColumn("score", F.round("score", 6))


@query(
    "with b as (select vec_id, i, embedding[i + 1]::double as cx, embedding[i + 9]::double as cy, embedding[i + 17]::double as w, embedding[i + 25]::double as h, list_transform([4, 5, 6, 7], lambda f: embedding[f * 8 + i + 1]::double) as s from embeddings, range(0, 8) as r(i)) "
    "select vec_id, cast(i as integer) as i, round(cx - w / 2, 6) as x1, round(cy + h / 2, 6) as y2, round(greatest(list_max(s), 0), 6) as confidence, cast(case when list_max(s) > 0 then list_position(s, list_max(s)) - 1 else 0 end as integer) as class_id from b"
)
def yolo_head(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.yolo_boxes(F.col("embedding"), 8, 8)).alias("i", "b"))
    return rows.select("vec_id", "i", F.round("b.x1", 6).alias("x1"), F.round("b.y2", 6).alias("y2"), F.round("b.confidence", 6).alias("confidence"), "b.class_id")
