"""Queries of the question side: positions, texts and plans, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keepsight.functions import geometry as geo
from keepsight.functions import masks
from keepsight.functions import text as txt
from keepsight.operators import checks, joins, poses, ranking, sets, windows
from keepsight.operators.aggregates import quantised
from keepsight.operators.quantiles import exact_percentiles
from keepsight.plans import answers, contexts
from keepsight.plans.bindings import OBS_SQL, POINTS_SQL, observations, points, table
from keepsight.plans.queries import QUERIES, long, query
from keepsight.sources import providers, readers

__all__ = ["QUERIES"]

ROTATION = ((0.6, 0, -0.8), (0, 1, 0), (0.8, 0, 0.6))


def rotation():
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in ROTATION])


def q6(*names, digits=6):
    return [quantised(F.col(n), digits).alias(n) for n in names]


# Positions and cameras.


@query(f"WITH {POINTS_SQL} SELECT vec_id, floor(-(0.6 * x + 0.8 * z) * 1000000 + 0.5) / 1000000 AS x, floor(-y * 1000000 + 0.5) / 1000000 AS y, floor(-(-0.8 * x + 0.6 * z) * 1000000 + 0.5) / 1000000 AS z FROM pts")
def camera_centres(spark, sf_dir):
    c = geo.camera_centre(rotation(), geo.point(F.col("x"), F.col("y"), F.col("z")))
    return points(spark, sf_dir).select("vec_id", c.alias("c")).select("vec_id", *[quantised(F.col(f"c.{a}"), 6).alias(a) for a in "xyz"])


@query(f"WITH {POINTS_SQL} SELECT vec_id, floor((-0.28 * x - 0.96 * z + 1.4 - 1) * 1000000 + 0.5) / 1000000 AS x, floor((y + 3) * 1000000 + 0.5) / 1000000 AS y, floor((0.96 * x - 0.28 * z + 3) * 1000000 + 0.5) / 1000000 AS z FROM pts")
def composed_poses(spark, sf_dir):
    a, b = geo.point(F.lit(1.0), F.lit(1.0), F.lit(-1.0)), geo.point(F.lit(-1.0), F.lit(2.0), F.lit(2.8))
    r, t = geo.compose(rotation(), a, rotation(), b)
    p = points(spark, sf_dir).select("vec_id", geo.to_camera(r, t, geo.point(F.col("x"), F.col("y"), F.col("z"))).alias("c"))
    return p.select("vec_id", *[quantised(F.col(f"c.{k}"), 6).alias(k) for k in "xyz"])


FRAME_SQL = "f AS (SELECT p_partkey, p_size * 10 + 100 AS h, p_partkey % 400 + 200 AS w FROM part)"


def frames(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 10 + 100).alias("h"), (F.col("p_partkey") % 400 + 200).alias("w"))


@query(f"WITH {FRAME_SQL} SELECT p_partkey, greatest(h, w)::DOUBLE AS fx, greatest(h, w)::DOUBLE AS fy, w / 2.0::DOUBLE AS cx, h / 2.0::DOUBLE AS cy FROM f")
def default_intrinsics(spark, sf_dir):
    return frames(spark, sf_dir).select("p_partkey", geo.default_intrinsics(F.col("h"), F.col("w")).alias("k")).select("p_partkey", "k.*")


@query(f"""WITH {FRAME_SQL}, s AS (SELECT *, greatest(h, w)::DOUBLE / 518 AS s FROM f)
SELECT p_partkey, floor(500 * s * 1000000 + 0.5) / 1000000 AS fx, floor(510 * s * 1000000 + 0.5) / 1000000 AS fy, floor((259 * s - (greatest(h, w) - w) / 2.0::DOUBLE) * 1000000 + 0.5) / 1000000 AS cx, floor((259 * s - (greatest(h, w) - h) / 2.0::DOUBLE) * 1000000 + 0.5) / 1000000 AS cy FROM s""")
def unpadded_intrinsics(spark, sf_dir):
    k = F.struct(*[F.lit(float(v)).alias(n) for n, v in (("fx", 500), ("fy", 510), ("cx", 259), ("cy", 259))])
    return frames(spark, sf_dir).select("p_partkey", geo.unpadded_intrinsics(k, F.lit(518), F.col("w"), F.col("h")).alias("k")).select("p_partkey", "k.*").select("p_partkey", *q6("fx", "fy", "cx", "cy"))


@query(f"WITH {POINTS_SQL}, s AS (SELECT label, 1 + label / 10.0::DOUBLE AS s FROM (SELECT DISTINCT label FROM pts) WHERE label < 5) SELECT vec_id, x * coalesce(s, 1) AS x, y * coalesce(s, 1) AS y, z FROM pts LEFT JOIN s USING (label)")
def scaled_positions(spark, sf_dir):
    p = points(spark, sf_dir)
    scales = p.select("label").distinct().filter("label < 5").withColumn("scale", 1 + F.col("label") / 10.0)
    return poses.rescaled(p, scales, ["label"], ["x", "y"]).select("vec_id", "x", "y", "z")


@query("SELECT p_partkey, p_size = p_partkey % 50 AND p_partkey % 20 < 16 AND p_partkey % 17 < 16 AND p_partkey % 90 > 20 AS fisheye FROM part")
def fisheye_frames(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", checks.is_circular_fisheye(F.col("p_size"), k % 50, F.array(k % 20, k % 17, F.lit(3), F.lit(0)), k % 90).alias("fisheye"))


@query("SELECT l_suppkey AS clip, median(l_discount) AS median_mae, median(l_discount) < 0.05 AS ok FROM lineitem GROUP BY l_suppkey")
def frame_drift_check(spark, sf_dir):
    return checks.frame_drift(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("clip"), F.col("l_discount").alias("mae")), ["clip"], 0.05)


@query("SELECT l_suppkey AS clip, median(CASE WHEN l_linenumber > 1 THEN l_tax END) AS seam_median, max(CASE WHEN l_linenumber > 1 THEN l_tax END) AS seam_max FROM lineitem GROUP BY l_suppkey")
def seam_statistics(spark, sf_dir):
    return checks.seams(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("clip"), F.when(F.col("l_linenumber") > 1, F.col("l_tax")).alias("rmse")), ["clip"])


@query(f"WITH {OBS_SQL} SELECT o.pos, o.id, p.x, p.y FROM obs o JOIN (SELECT id, frame, max_by(x, pos) AS x, max_by(y, pos) AS y FROM obs WHERE tag = 'view' GROUP BY id, frame) p ON o.id = p.id AND o.frame = p.frame WHERE o.tag = 'click'")
def observation_poses(spark, sf_dir):
    o = observations(spark, sf_dir)
    at = o.filter("tag = 'view'").groupBy("id", "frame").agg(F.max_by("x", "pos").alias("x"), F.max_by("y", "pos").alias("y"))
    return poses.with_pose(o.filter("tag = 'click'").select("pos", "id", "frame"), at, ["id"]).select("pos", "id", "x", "y")


@query(f"""WITH {OBS_SQL}, p AS (SELECT id, tag, a.pos AS a, b.pos AS b, a.time_s AS ta, b.time_s AS tb, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS base FROM obs a JOIN obs b USING (id, tag) WHERE (a.time_s, a.pos) < (b.time_s, b.pos) AND b.time_s - a.time_s <= 86400)
SELECT a, b, floor(base * 1000000 + 0.5) / 1000000 AS base FROM p WHERE base > 1e-6""")
def observation_pairs(spark, sf_dir):
    return joins.observation_pairs(observations(spark, sf_dir), ["id", "tag"], 86400.0).select("a", "b", quantised(F.col("base"), 6).alias("base"))


@query("""WITH r AS (SELECT l_suppkey AS clip, l_linenumber AS frame, l_extendedprice / (l_quantity * 1000) AS r FROM lineitem WHERE l_quantity > 2), f AS (SELECT clip, frame, median(r) AS r FROM r GROUP BY clip, frame HAVING count(*) > 20)
SELECT clip, floor(median(r) * 1000000 + 0.5) / 1000000 AS scale, count(*) AS n_frames FROM f GROUP BY clip""")
def depth_scale(spark, sf_dir):
    px = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("clip"), F.col("l_linenumber").alias("frame"), F.col("l_extendedprice").alias("a"), (F.col("l_quantity") * 1000).alias("b"))
    return poses.depth_scale(px, ["clip"], least=2000.0, min_pixels=20).select("clip", quantised(F.col("scale"), 6).alias("scale"), "n_frames")


@query(f"""WITH {OBS_SQL}, c AS (SELECT *, 0.6 * x - 0.8 * z + 0.5 AS cx, y - 1 AS cy, 0.8 * x + 0.6 * z - 1.5 AS cz FROM obs)
SELECT pos, CASE WHEN cz >= 0 THEN 'ahead' ELSE 'behind' END AS ahead, CASE WHEN cx >= 0 THEN 'right' ELSE 'left' END AS side, printf('%.1f', sqrt(cx * cx + cy * cy + cz * cz)) AS far FROM c""")
def ego_positions(spark, sf_dir):
    cam = geo.to_camera(rotation(), geo.point(F.lit(0.5), F.lit(-1.0), F.lit(-1.5)), F.col("cam"))
    o = observations(spark, sf_dir).select("pos", cam.alias("c"))
    zero = geo.point(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return o.select("pos", F.when(F.col("c.z") >= 0, "ahead").otherwise("behind").alias("ahead"), F.when(F.col("c.x") >= 0, "right").otherwise("left").alias("side"), txt.python_format(".1f")(geo.distance(F.col("c"), zero)).alias("far"))


@query(f"WITH {OBS_SQL} SELECT pos, CASE WHEN k % 3 = 0 THEN x ELSE score END AS world_x, k % 3 = 0 AS first_kind FROM obs WHERE k % 3 < 2")
def world_positions(spark, sf_dir):
    k = F.col("k") % 3
    o = observations(spark, sf_dir).filter(k < 2).withColumns({"world_egoloc": F.when(k == 0, F.array("x", "y", "z")), "world_vggt": F.array("score", "y", "z")})
    w = o.withColumn("world", readers.world_position())
    return w.select("pos", F.col("world")[0].alias("world_x"), F.col("world_egoloc").isNotNull().alias("first_kind"))


# Masks.


@query(f"WITH {OBS_SQL} SELECT pos, floor(x1)::INT AS x1, floor(y1)::INT AS y1, floor(x1)::INT + 4 AS x2, floor(y1)::INT + 5 AS y2, 20::BIGINT AS area FROM obs WHERE x1 < 100 AND y1 < 50")
def box_masks(spark, sf_dir):
    o = observations(spark, sf_dir).filter("x1 < 100 and y1 < 50").select("pos", geo.box(F.col("x1"), F.col("y1"), F.col("x1") + 4, F.col("y1") + 5).alias("b"))
    h, w = F.lit(60), F.lit(110)
    m = o.select("pos", masks.box_mask(h, w, *[F.col(f"b.{k}") for k in ("x1", "y1", "x2", "y2")]).alias("m"))
    return m.select("pos", masks.mask_box(h, w, "m").alias("b"), masks.mask_iou(h, w, "m", "m").alias("self")).select("pos", *[F.col(f"b.{k}").alias(k) for k in ("x1", "y1", "x2", "y2")], (20 * F.col("self")).cast("long").alias("area"))


# Texts.


@query("SELECT o_orderkey, printf('%.1f', o_totalprice / 7) AS one, printf('%.0f', (o_orderkey % 100) / 2.0::DOUBLE) AS whole, round_even(o_orderkey % 1000 / 8.0::DOUBLE, 1) AS rounded FROM orders")
def formatted_numbers(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", txt.python_format(".1f")(F.col("o_totalprice") / 7).alias("one"), txt.python_format(".0f")((k % 100) / 2.0).alias("whole"), txt.python_round(1)((k % 1000) / 8.0).alias("rounded"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'on' WHEN 1 THEN 'left of' WHEN 2 THEN 'in front of' ELSE 'near' END AS rel, CASE o_orderkey % 4 WHEN 0 THEN 'under' WHEN 1 THEN 'right of' WHEN 2 THEN 'behind' ELSE 'near' END AS inverse FROM orders""")
def inverse_relations(spark, sf_dir):
    rel = F.element_at(F.array(*map(F.lit, ("on", "left of", "in front of", "near"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", rel.alias("rel"), geo.inverse_relation(rel).alias("inverse"))


@query("SELECT p_brand, '[' || string_agg('\"' || p_type || '\"', ',' ORDER BY p_type) || ']' AS labels, string_agg(p_type, ', ' ORDER BY p_type) AS line FROM (SELECT DISTINCT p_brand, p_type FROM part) GROUP BY p_brand")
def label_lists(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("l"))
    return g.select("p_brand", F.to_json("l").alias("labels"), F.array_join("l", ", ").alias("line"))


COMPARE = ["Which is closer to me, the {a} or the {b}?", "Is the {a} or the {b} larger?", "How many {a}s are there?", "What is between {a} or {b} now?"]
COMPARE_SQL = "CASE p_partkey % 4 " + " ".join("WHEN {} THEN '{}'".format(i, q.replace("{a}", "' || a || '").replace("{b}", "' || b || '")) for i, q in enumerate(COMPARE)) + " END"


def asked(spark, sf_dir):
    a, b = F.lower(F.split("p_name", " ")[0]), F.lower(F.split("p_type", " ")[0])
    text = F.lit(None)
    for i, q in reversed(list(enumerate(COMPARE))):
        parts = [a if x == "{a}" else b if x == "{b}" else F.lit(x) for x in q.replace("{a}", "\0{a}\0").replace("{b}", "\0{b}\0").split("\0") if x]
        text = F.when(F.col("p_partkey") % 4 == i, F.concat(*parts)).otherwise(text)
    return table(spark, sf_dir, "part").select("p_partkey", a.alias("a"), b.alias("b"), text.alias("question"))


@query(f"""WITH p AS (SELECT p_partkey, lower(string_split(p_name, ' ')[1]) AS a, lower(string_split(p_type, ' ')[1]) AS b FROM part)
SELECT p_partkey, {COMPARE_SQL} AS question, CASE p_partkey % 4 WHEN 0 THEN 'the ' || a || '|the ' || b WHEN 1 THEN 'the ' || a || '|the ' || b WHEN 2 THEN '' ELSE a || '|' || b END AS phrases, p_partkey % 4 = 2 AS counts FROM p""")
def phrase_pairs(spark, sf_dir):
    q = asked(spark, sf_dir)
    return q.select("p_partkey", "question", F.array_join(txt.pair_phrases(F.col("question")), "|").alias("phrases"), txt.is_counting(F.col("question")).alias("counts"))


@query("SELECT p_partkey, w, w || 's' AS plural, CASE WHEN w LIKE '%s' THEN left(w, len(w) - 1) ELSE w END AS singular FROM (SELECT p_partkey, lower(string_split(p_name, ' ')[1]) AS w FROM part)")
def plural_words(spark, sf_dir):
    w = F.lower(F.split("p_name", " ")[0])
    f = txt.plural_forms(w)
    return table(spark, sf_dir, "part").select("p_partkey", w.alias("w"), F.element_at(f, 2).alias("plural"), F.element_at(f, -1).alias("last"), F.size(f).alias("n"), F.col("p_name")).select("p_partkey", "w", "plural", F.when(F.col("n") == 3, F.col("last")).otherwise(F.col("w")).alias("singular"))


UNTIL_SQL = "u AS (SELECT id, median(time_s) AS until FROM obs GROUP BY id)"


def until(o):
    return o.groupBy("id").agg(F.median("time_s").alias("until"))


@query(f"""WITH {OBS_SQL}, {UNTIL_SQL}, s AS (SELECT id, time_s, x, y, z, row_number() OVER (PARTITION BY id ORDER BY time_s) - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM obs JOIN u USING (id) WHERE time_s <= until),
p AS (SELECT * FROM s WHERE n <= 6 OR i = n - 1 OR list_contains(list_transform(range(0, 5), lambda j: trunc(j * ((n - 1)::DOUBLE / 5))::BIGINT), i))
SELECT id, string_agg(printf('%.0fs (%.1f, %.1f, %.1f)', time_s, x, y, z), ' -> ' ORDER BY time_s) AS path FROM p GROUP BY id HAVING count(*) >= 2""")
def wearer_paths(spark, sf_dir):
    o = observations(spark, sf_dir)
    return contexts.wearer_path(o.join(until(o), "id"), "id", "time_s", "until")


DIRECT_SQL = f"""WITH {OBS_SQL}, {UNTIL_SQL}, l AS (SELECT u.id, until, v.time_s, x - 1 AS x, y - 1 AS y, z - 0.3 AS z FROM u ASOF LEFT JOIN (SELECT * FROM obs WHERE tag = 'view') v ON u.id = v.id AND u.until >= v.time_s),
d AS (SELECT *, until - time_s AS age, degrees(atan2(x, z)) AS az, degrees(atan2(-y, sqrt(x * x + z * z))) AS el, sqrt(x * x + y * y + z * z) AS far FROM l)"""


@query(DIRECT_SQL + """ SELECT id, age AS age_s, CASE WHEN time_s IS NULL THEN 'never' WHEN age < 1 THEN 'now' WHEN age > 7200 THEN 'stale' ELSE 'recent' END AS freshness,
  CASE WHEN time_s IS NULL THEN NULL WHEN age > 7200 THEN 'last seen ' || printf('%.0f', age) || ' s before, ' || printf('%.1f', far) || ' m away then; you have moved since'
       ELSE 'seen ' || CASE WHEN age < 1 THEN 'at the question time' ELSE printf('%.0f', age) || ' s before' END || ', ' || printf('%.1f', far) || ' m away (' || printf('%+.0f', az) || ' deg)' END AS line FROM d""")
def direct_observations(spark, sf_dir):
    o = observations(spark, sf_dir)
    v = o.filter("tag = 'view'").select("id", F.col("time_s").alias("vt"), geo.point(F.col("x") - 1, F.col("y") - 1, F.col("z") - 0.3).alias("v"))
    last = joins.asof_join(until(o), v.withColumns({"seen_s": F.col("vt"), "cam": F.col("v")}), ["id"], "until", "vt", ["seen_s", "cam"])
    return contexts.direct_observation(last, "seen_s", "until", 7200.0).select("id", "age_s", "freshness", "line")


OBJECTS_SQL = "objects AS (SELECT c_custkey - 1 AS id, lower(c_mktsegment) || ' thing' AS name, n_name AS more FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def objects(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("more"))
    return table(spark, sf_dir, "customer").join(n, "c_nationkey").select((F.col("c_custkey") - 1).alias("id"), F.concat(F.lower("c_mktsegment"), F.lit(" thing")).alias("name"), F.array("more").alias("tags"))


@query(f"""WITH {OBS_SQL}, {OBJECTS_SQL}, named AS (SELECT obs.*, o.name, o.more FROM obs JOIN objects o USING (id)), q AS (SELECT unnest(['automobile', 'buildings', 'machinery', 'china']) AS noun, (SELECT median(time_s) FROM obs) AS until),
forms AS (SELECT noun, until, unnest(list_distinct([noun, noun || 's', regexp_replace(noun, 's$', '')])) AS form FROM q),
hit AS (SELECT DISTINCT noun, until, pos, id, frame, time_s FROM forms JOIN named ON list_contains(regexp_extract_all(lower(name || ' ' || more), '[a-z]+'), form) WHERE time_s <= until),
fr AS (SELECT noun, max(n) AS most_at_once FROM (SELECT noun, frame, count(DISTINCT id) AS n FROM hit GROUP BY noun, frame) GROUP BY noun)
SELECT hit.noun AS qid, count(DISTINCT id) AS n_objects, count(DISTINCT CASE WHEN time_s >= until - 86400 THEN id END) AS n_recent, any_value(most_at_once) AS most_at_once FROM hit JOIN fr USING (noun) GROUP BY hit.noun""")
def counting_aids(spark, sf_dir):
    o = observations(spark, sf_dir)
    named = o.join(objects(spark, sf_dir), "id")
    nouns = spark.createDataFrame([("automobile",), ("buildings",), ("machinery",), ("china",)], "qid string")
    q = nouns.crossJoin(exact_percentiles(o, [], ["time_s"]).withColumnRenamed("time_s", "until")).withColumn("noun", txt.plural_forms(F.col("qid")))  # four rows and one
    return contexts.counting_aid(named, q, "noun", 86400.0)


@query(f"""WITH {OBS_SQL}, {OBJECTS_SQL}, s AS (SELECT id, count(*) AS n_obs, median(x) AS x, median(y) AS y, median(z) AS z FROM obs GROUP BY id)
SELECT id, '#1 ' || name || ' (' || n_obs || ' obs)' || CASE WHEN id % 3 > 0 THEN printf(' at (%.2f, %.2f, %.2f) m', x, y, z) ELSE '' END || CASE WHEN id % 2 = 0 THEN '; ahead' ELSE '' END AS line FROM s JOIN objects USING (id)""")
def candidate_texts(spark, sf_dir):
    from keepsight.operators.aggregates import object_summary

    s = object_summary(observations(spark, sf_dir), ["id"]).join(objects(spark, sf_dir), "id")
    s = s.withColumns({"x": F.when(F.col("id") % 3 > 0, F.col("x")), "rank": F.lit(1), "unit": F.lit("m"), "ego": F.when(F.col("id") % 2 == 0, "ahead")})
    return contexts.candidate_lines(s, "id").select("id", "line")


@query(f"""WITH {OBS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY time_s) - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM obs),
p AS (SELECT * FROM r WHERE n <= 8 OR i = n - 1 OR list_contains(list_transform(range(0, 7), lambda j: trunc(j * ((n - 1)::DOUBLE / 7))::BIGINT), i))
SELECT id, string_agg(printf('%.0fs-%.0fs: ', time_s, time_s + 90) || CASE WHEN tag = 'error' THEN 'seen' ELSE tag END, '; ' ORDER BY time_s) AS history FROM p GROUP BY id""")
def object_histories(spark, sf_dir):
    s = observations(spark, sf_dir).select("id", F.col("time_s").alias("t0"), (F.col("time_s") + 90).alias("t1"), F.nullif("tag", F.lit("error")).alias("description"))
    return contexts.history(s, ["id"])


@query(f"""WITH {OBS_SQL}, r AS (SELECT id, pos, row_number() OVER (PARTITION BY id ORDER BY time_s) - 1 AS i, count(*) OVER (PARTITION BY id) AS n, time_s, x, y, z FROM obs)
SELECT id, 'first' AS kind, string_agg(printf('%.1fs at (%.2f, %.2f, %.2f)', time_s, x, y, z), '; ' ORDER BY time_s, pos) AS line FROM r WHERE i < 8 GROUP BY id
UNION ALL SELECT id, 'last', string_agg(printf('%.1fs at (%.2f, %.2f, %.2f)', time_s, x, y, z), '; ' ORDER BY time_s, pos) FROM r WHERE i >= n - 6 GROUP BY id""")
def trajectory_texts(spark, sf_dir):
    o = observations(spark, sf_dir)
    first, last = contexts.trajectory_text(o, ["id"], 8), contexts.trajectory_text(o, ["id"], 6, last=True)
    return first.withColumn("kind", F.lit("first")).unionByName(last.withColumn("kind", F.lit("last"))).select("id", "kind", "line")


PLACES_SQL = f"""WITH {OBS_SQL}, {UNTIL_SQL}, v AS (SELECT id, tag, time_s AS t0, time_s + 900 AS t1, row_number() OVER (PARTITION BY id ORDER BY time_s DESC) AS back, until FROM obs JOIN u USING (id) WHERE time_s <= until)"""


@query(PLACES_SQL + """ SELECT id, 'now in ' || max(CASE WHEN back = 1 THEN tag || printf(' since %.0fs', t0) END) || '; before: ' || string_agg(printf('%s (%.0f-%.0fs)', tag, t0, least(t1, until)), ' -> ' ORDER BY t0) AS line FROM v WHERE back <= 12 GROUP BY id""")
def places_texts(spark, sf_dir):
    from keepsight.operators.places import current_visit

    o = observations(spark, sf_dir)
    v = o.select("id", F.col("tag").alias("label"), F.col("time_s").alias("t0"), (F.col("time_s") + 900).alias("t1"))
    return contexts.places_text(current_visit(v, until(o), ["id"], "until"), ["id"])


@query(f"""WITH {OBS_SQL} SELECT id, pos, CASE tag WHEN 'view' THEN 'cup' ELSE 'jar' END || ' is ' || CASE WHEN k % 2 = 0 THEN 'on' ELSE 'near' END || ' lamp (' || CASE WHEN k < 50 THEN printf('since %.0fs', time_s) ELSE printf('%.0f-%.0fs, not seen since', time_s, time_s + k) END || ')' AS line FROM obs""")
def relation_texts(spark, sf_dir):
    c = observations(spark, sf_dir).select("id", F.col("pos").alias("rank"), F.when(F.col("tag") == "view", "cup").otherwise("jar").alias("a_name"), F.lit("lamp").alias("b_name"), F.when(F.col("k") % 2 == 0, "on").otherwise("near").alias("rel"), F.col("time_s").alias("t0"), (F.col("time_s") + F.col("k")).alias("t1"), (F.col("k") < 50).alias("current"))
    return contexts.relation_lines(c, "id").select("id", F.col("rank").alias("pos"), "line")


@query(f"""WITH {OBS_SQL}, {OBJECTS_SQL}, c AS (SELECT id % 20 AS clip, id, name, count(*) AS n_obs, median(x) AS x, median(y) AS y, median(z) AS z FROM obs JOIN objects USING (id) GROUP BY id, name),
i AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY id) - 1 AS idx FROM c)
SELECT clip, string_agg(printf('[%d] %s, seen %dx at (%.2f, %.2f, %.2f)', idx, name, n_obs, x, y, z), chr(10) ORDER BY idx) AS listing FROM i GROUP BY clip""")
def match_texts(spark, sf_dir):
    return contexts.match_text(listed(spark, sf_dir), "clip")


def listed(spark, sf_dir):
    """Objects of a recording (a twentieth of all ids) with their index, name and summary."""
    from keepsight.operators.aggregates import object_summary

    s = object_summary(observations(spark, sf_dir), ["id"]).join(objects(spark, sf_dir), "id").withColumn("clip", F.col("id") % 20)
    return answers.listed_candidates(s, "clip", "id")


POINT_SQL = f"""WITH {OBS_SQL}, {OBJECTS_SQL}, c AS (SELECT id % 20 AS clip, id, name FROM objects WHERE id IN (SELECT id FROM obs)), i AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY id) - 1 AS idx FROM c),
q AS (SELECT s_suppkey AS q_id, s_suppkey % 20 AS clip, CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE s_suppkey % 9 END AS pick, CASE s_suppkey % 2 WHEN 0 THEN 'Automobile Thing' ELSE 'nothing' END AS title FROM supplier),
n AS (SELECT clip, lower(name) AS name, arg_min(id, idx) AS id FROM i GROUP BY clip, lower(name)), m AS (SELECT id, median(x) AS x, median(y) AS y, median(z) AS z FROM obs GROUP BY id),
p AS (SELECT q.q_id, q.clip, coalesce(i.id, n.id) AS id FROM q LEFT JOIN i ON q.clip = i.clip AND q.pick = i.idx LEFT JOIN n ON q.clip = n.clip AND lower(q.title) = n.name)"""


@query(POINT_SQL + """ SELECT q_id, id, x, y, z, floor(sqrt((x - 2) ** 2 + (y + 1) ** 2 + (z - 0.5) ** 2) * 1000 + 0.5) / 1000 AS l2, sqrt((x - 2) ** 2 + (y + 0.75) ** 2 + (z - 0.5) ** 2) < 6 * (0.5 + 1) AS success FROM p LEFT JOIN m USING (id)""")
def point_questions(spark, sf_dir):
    k = F.col("s_suppkey")
    ask = table(spark, sf_dir, "supplier").select(k.alias("q_id"), (k % 20).alias("clip"), F.when(k % 2 == 0, "Automobile Thing").otherwise("nothing").alias("title"))
    replies = table(spark, sf_dir, "supplier").select(k.alias("q_id"), F.when(k % 3 == 0, "none of them").otherwise(F.concat(F.lit('{"id": '), (k % 9).cast("string"), F.lit("}"))).alias("reply"))
    obs = observations(spark, sf_dir).withColumn("clip", F.col("id") % 20)
    truth = geo.point(F.lit(1.0), F.lit(2.0), F.lit(0.5)), geo.point(F.lit(0.5), F.lit(2.0), F.lit(0.5))
    got = answers.scored_points(answers.picked_points(ask, providers.Recorded(replies, ["q_id"]), listed(spark, sf_dir), obs), *truth)
    return got.select("q_id", "id", "x", "y", "z", quantised(F.col("l2"), 3).alias("l2"), "success")


# Questions with their context. An object of a recording is an event type of a user.

MEMORY_SQL = f"""WITH {OBS_SQL}, mem AS (SELECT id AS clip, list_position(['click', 'error', 'purchase', 'signup', 'view'], tag) AS id, tag AS name, pos, time_s, x, y, z, k FROM obs),
q AS (SELECT clip, pos AS qid, time_s AS t, CASE WHEN k % 2 = 0 THEN 'was the click after an error' ELSE 'where is the view' END AS question FROM mem WHERE name = 'purchase')"""


def memory(spark, sf_dir):
    o = observations(spark, sf_dir)
    tags = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    mem = o.select(F.col("id").alias("clip"), F.array_position(tags, F.col("tag")).alias("id"), F.col("tag").alias("name"), "pos", "time_s", "x", "y", "z", "k", "cam", "box")
    q = mem.filter("name = 'purchase'").select("clip", F.col("pos").alias("qid"), F.col("time_s").alias("t"), F.when(F.col("k") % 2 == 0, "was the click after an error").otherwise("where is the view").alias("question"))
    return mem, q


def named_objects(mem):
    return mem.select("clip", "id", "name").distinct().withColumn("description", F.concat(F.lit("a "), F.col("name"), F.lit(" of the user")))


@query(MEMORY_SQL + """, f AS (SELECT qid, t, question, m.clip, m.id, m.name, count(*) AS n_obs, min(t - time_s) AS best_dt, median(x) AS x, median(y) AS y, median(z) AS z FROM q JOIN mem m ON q.clip = m.clip AND m.time_s <= t GROUP BY ALL),
h AS (SELECT *, CASE WHEN list_contains(string_split(question, ' '), name) THEN 1 ELSE 0 END AS hits, best_dt <= 6 AS near FROM f),
s AS (SELECT *, floor((3.0::DOUBLE * hits + hits + 2.0::DOUBLE * near::INT + 1 / (1 + best_dt / 60.0::DOUBLE)) * 1000 + 0.5) / 1000 AS score FROM h WHERE hits > 0 OR near),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, best_dt, id) AS rank FROM s)
SELECT qid, id::BIGINT AS id, n_obs, best_dt, x, y, z, score, rank FROM r WHERE rank <= 4""")
def question_candidates(spark, sf_dir):
    mem, q = memory(spark, sf_dir)
    return answers.text_candidates(q, named_objects(mem), mem).select("qid", "id", "n_obs", "best_dt", "x", "y", "z", "score", F.col("rank").cast("long").alias("rank"))


@query()
def text_prompts(spark, sf_dir):
    """The whole text plan (Q1): its parts have SQL of their own, the whole a twin in the tests."""
    mem, q = memory(spark, sf_dir)
    segments = mem.filter("k < 40").select("clip", "id", F.col("time_s").alias("t0"), (F.col("time_s") + 60).alias("t1"), F.concat(F.lit("at "), F.col("name")).alias("description"))
    events = mem.select("clip", "time_s", F.concat(F.lit("user did "), F.col("name")).alias("text"))
    episodes = mem.filter("k < 30").select("clip", F.col("id").alias("a"), (F.col("id") % 5 + 1).alias("b"), F.when(F.col("k") % 2 == 0, "on").otherwise("near").alias("rel"), F.col("time_s").alias("t0"), (F.col("time_s") + 600).alias("t1"))
    centres = mem.select("clip", "time_s", "x", "y", "z")
    visits = mem.select("clip", F.col("name").alias("label"), F.col("time_s").alias("t0"), (F.col("time_s") + 900).alias("t1"))
    return answers.text_question(q, named_objects(mem), mem, segments, events, episodes, centres=centres, visits=visits)


@query(MEMORY_SQL + """, s AS (SELECT clip, pos AS qid, (pos % 60)::DOUBLE AS t FROM mem WHERE name = 'signup'),
n AS (SELECT qid, m.clip, m.id, min(sqrt((m.x - 1) ** 2 + (m.y - 1) ** 2 + (m.z - 0.2) ** 2)) AS d FROM s JOIN (SELECT *, (pos % 60)::DOUBLE AS at FROM mem) m ON s.clip = m.clip AND abs(m.at - s.t) <= 6 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM n)
SELECT qid, printf('%d', count(*)) || ' near' AS told FROM r WHERE rank <= 4 GROUP BY qid""")
def spatial_prompts(spark, sf_dir):
    """The spatial plan (Q2) on questions whose markup gives a time and a box; checked by how many objects it lists."""
    mem, _ = memory(spark, sf_dir)
    mem = mem.withColumn("time_s", (F.col("pos") % 60).cast("double"))
    q = mem.filter("name = 'signup'").select("clip", F.col("pos").alias("qid"), F.concat(F.lit("What is <BBOX 1 2 30 40> at <TIME 0:00:"), (F.col("pos") % 60).cast("string"), F.lit(" video 1>?")).alias("question"), geo.point(F.lit(1.0), F.lit(1.0), F.lit(0.2)).alias("point"))
    segments = mem.select("clip", "id", F.col("time_s").alias("t0"), (F.col("time_s") + 1).alias("t1"), F.col("name").alias("description")).dropDuplicates(["clip", "id"])
    told = answers.spatial_question(q, mem, segments)
    return told.select("qid", F.concat((F.size(F.split("context", "\n")) - 1).cast("string"), F.lit(" near")).alias("told"))


# Readers of nested documents.


def annotations(spark, sf_dir):
    """Suppliers as clips whose annotations are query sets of the parts that they sell."""
    l = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("video"), F.col("l_suppkey").cast("string").alias("clip_uid"), F.concat(F.lit("t"), (F.col("l_partkey") % 7).cast("string")).alias("title"), F.col("l_linenumber").cast("string").alias("k"), "l_orderkey").dropDuplicates(["clip_uid", "title", "k"])  # noqa: E741
    sets_ = l.groupBy("video", "clip_uid", "title").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct(F.col("title").alias("object_title"), F.array(F.struct(F.col("k").cast("long").alias("frame_number"), F.lit(1).cast("long").alias("video_frame_number"))).alias("response_track"))))).alias("query_sets"))
    clips = sets_.groupBy("video", "clip_uid").agg(F.collect_list(F.struct("query_sets")).alias("annotations"))
    return clips.groupBy("video").agg(F.collect_list(F.struct("clip_uid", "annotations")).alias("clips"))


@query("SELECT l_suppkey::VARCHAR AS clip_uid, string_agg(DISTINCT 't' || l_partkey % 7, ',' ORDER BY 't' || l_partkey % 7) AS titles FROM lineitem GROUP BY l_suppkey")
def annotated_titles(spark, sf_dir):
    return readers.scene_titles(annotations(spark, sf_dir)).select("clip_uid", F.array_join("titles", ",").alias("titles"))


@query("SELECT l_suppkey::VARCHAR AS clip_uid, 't' || l_partkey % 7 AS title, count(DISTINCT l_linenumber) AS n_tracks, sum(DISTINCT l_linenumber)::BIGINT AS frames FROM lineitem GROUP BY ALL")
def annotated_tracks(spark, sf_dir):
    t = readers.response_tracks(annotations(spark, sf_dir))
    return t.select("clip_uid", "title", F.size("tracks").cast("long").alias("n_tracks"), F.aggregate("tracks", F.lit(0).cast("long"), lambda s, x: s + x["track"][0]["frame_number"]).alias("frames"))


@query("SELECT s_suppkey AS clip, 640 + s_suppkey % 3 AS width, 480 AS height, s_suppkey * 37 AS n_frames, s_suppkey % 4 = 0 AS off_rate FROM supplier")
def video_metadata(spark, sf_dir):
    k = F.col("s_suppkey")
    v = table(spark, sf_dir, "supplier").select(k.alias("clip"), (640 + k % 3).alias("width"), F.lit(480).alias("height"), (k * 37).alias("n_frames"), (10 + F.when(k % 4 == 0, 0.2).otherwise(0.01)).alias("fps"))
    return readers.checked_metadata(v, 10.0).select("clip", "width", "height", "n_frames", "off_rate")


@query("SELECT s_suppkey::VARCHAR AS clip_uid, (s_suppkey * 37) AS \"N\", 10.0::DOUBLE AS fps, (1 + s_suppkey % 3)::INT AS clip_ratio, CASE WHEN length(s_suppkey::VARCHAR) = 5 THEN 'numeric5' ELSE 'other' END AS source, least(len(range(0, (s_suppkey * 37) // (1 + s_suppkey % 3), 40)), 1200)::BIGINT AS n_grid FROM supplier")
def grid_specs(spark, sf_dir):
    k = F.col("s_suppkey")
    clips = table(spark, sf_dir, "supplier").select(k.cast("string").alias("clip_uid"), (k * 37).alias("n_frames"), (1 + k % 3).alias("clip_ratio"), F.lit(10.0).alias("fps"))
    g = readers.grid_spec(clips, 40, 1200)
    return g.select("clip_uid", "N", "fps", "clip_ratio", "source", F.size("grid_clip_frames").cast("long").alias("n_grid"))


@query("SELECT s_suppkey::VARCHAR AS clip_uid, 0::BIGINT AS n FROM supplier")
def empty_truth(spark, sf_dir):
    clips = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("clip_uid"))
    return readers.empty_truth(clips).select("clip_uid", F.size("objects").cast("long").alias("n"))


@query("""WITH t AS (SELECT s_nationkey AS clip, s_suppkey AS pos, 'tag ' || s_suppkey % 9 AS tag FROM supplier), r AS (SELECT clip, pos, CASE WHEN floor(pos / 60) % 2 = 0 THEN 'kind ' || pos % 3 ELSE tag END AS tag FROM t)
SELECT clip, tag, min(pos)::BIGINT AS first_pos FROM r GROUP BY clip, tag""")
def canonical_vocabulary(spark, sf_dir):
    k = F.col("s_suppkey")
    tags = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("clip"), k.alias("pos"), F.concat(F.lit("tag "), (k % 9).cast("string")).alias("tag"))
    blocks = tags.withColumn("block", F.floor(F.col("pos") / 60)).filter("block % 2 = 0").groupBy("clip", "block").agg(F.array_sort(F.collect_list("pos")).alias("ps"))
    replies = blocks.select("clip", "block", F.array_join(F.transform("ps", lambda p: F.concat(F.lit("Kind "), (p % 3).cast("string"))), ", ").alias("reply"))
    got = answers.canonical_tags(tags, providers.Recorded(replies, ["clip", "block"]))
    at = tags.withColumn("block", F.floor(F.col("pos") / 60)).groupBy("clip", "block").agg(F.array_sort(F.collect_list("pos")).alias("ps"))
    return got.join(at, (got["clip"] == at["clip"]) & (got["first.block"] == at["block"])).select(got["clip"], "tag", F.element_at("ps", F.col("first.at") + 1).alias("first_pos"))


# SQL on registered views.


@query(f"WITH {OBS_SQL} SELECT tag, count(*) AS n, count(DISTINCT id) AS n_objects FROM obs GROUP BY tag")
def view_report(spark, sf_dir):
    from keepsight.plans.views import register

    register(spark, sf_dir)
    return spark.sql("SELECT tag, count(*) AS n, count(DISTINCT id) AS n_objects FROM memory_observations GROUP BY tag")


@query(f"""WITH {OBS_SQL}, isl AS (SELECT *, sum(brk) OVER (PARTITION BY id ORDER BY time_s ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN time_s - lag(time_s) OVER (PARTITION BY id ORDER BY time_s) > 43200 THEN 1 ELSE 0 END AS brk FROM obs))
SELECT id, min(time_s) AS t0, max(time_s) AS t1, count(*) AS n FROM isl GROUP BY id, island""")
def islands_in_sql(spark, sf_dir):
    from keepsight.plans.views import register

    register(spark, sf_dir)
    return spark.sql("SELECT key AS id, t0, t1, n FROM runs_of(TABLE(SELECT id AS key, time_s, 43200.0D AS gap FROM memory_observations) PARTITION BY key ORDER BY time_s)")
