"""Question plans, providers, masks, stages and readers on small cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsight.functions import masks
from keepsight.plans import answers, stages
from keepsight.sources import providers, readers


def test_masks(spark):
    rng = np.random.default_rng(0)
    a, b = rng.random((7, 9)) > 0.6, np.zeros((7, 9), bool)
    b[2:5, 1:4] = True
    assert (masks.decoded(7, 9, masks.encoded(a)) == a).all() and (masks.decoded(7, 9, masks.encoded(~b)) == ~b).all()
    df = spark.createDataFrame([(7, 9, masks.encoded(b), masks.encoded(a))], "h int, w int, b string, a string")
    r = df.select(masks.mask_box("h", "w", "b").alias("box"), masks.mask_iou("h", "w", "a", "b").alias("iou"), masks.mask_containment("h", "w", "a", "b").alias("c"), masks.box_mask("h", "w", F.lit(1.9), F.lit(2.2), F.lit(4.0), F.lit(5.0)).alias("m")).first()
    assert tuple(r["box"]) == (1, 2, 4, 5) and r["m"] == masks.encoded(b)
    assert r["iou"] == pytest.approx((a & b).sum() / (a | b).sum()) and r["c"] == pytest.approx((a & b).sum() / min(a.sum(), b.sum()))


def memory(spark):
    objects = spark.createDataFrame([("c", 1, "red mug", "on the table"), ("c", 2, "lamp", None), ("c", 3, "door", None)], "clip string, id long, name string, description string")
    obs = spark.createDataFrame([("c", 1, t, 1.0, 0.0, 2.0) for t in (0.0, 4.0, 8.0)] + [("c", 2, 4.0, 0.0, 0.0, 1.0), ("c", 3, 90.0, 5.0, 5.0, 5.0)], "clip string, id long, time_s double, x double, y double, z double")
    segments = spark.createDataFrame([("c", 1, 0.0, 50.0, "a mug by the sink"), ("c", 3, 90.0, 91.0, "later")], "clip string, id long, t0 double, t1 double, description string")
    events = spark.createDataFrame([("c", float(t), f"the mug moves {t}") for t in range(0, 40, 4)], "clip string, time_s double, text string")
    episodes = spark.createDataFrame([("c", 1, 2, "near", 0.0, 4.0), ("c", 1, 3, "near", 80.0, 90.0)], "clip string, a long, b long, rel string, t0 double, t1 double")
    return objects, obs, segments, events, episodes


def test_text_question_is_causal(spark):
    q = spark.createDataFrame([("q1", "c", "Where is the red mug?", 8.0)], "qid string, clip string, question string, t double")
    text = answers.text_question(q, *memory(spark)).first()["context"]
    assert "#1 red mug (3 obs) at (1.00, 0.00, 2.00) scene units" in text and "0s-8s: a mug by the sink" in text
    assert "red mug is near lamp (since 0s)" in text and "8s the mug moves 8" in text
    assert "door" not in text and "moves 12" not in text


def test_spatial_question(spark):
    q = spark.createDataFrame([("q1", "c", "Is <BBOX 0 0 9 9> at <TIME 0:00:04 video 1> full?", None)], "qid string, clip string, question string, point struct<x:double,y:double,z:double>")
    o = spark.createDataFrame([("c", 1, "mug", 4.0, (0.0, 0.0, 1.0), (0.0, 0.0, 9.0, 9.0))], "clip string, id long, name string, time_s double, cam struct<x:double,y:double,z:double>, box struct<x1:double,y1:double,x2:double,y2:double>")
    r = answers.spatial_question(q, o, memory(spark)[2]).first()
    assert r["plain"] == "Is the marked object at 0:00:04 full?" and "mug: 0s-50s: a mug by the sink" in r["context"]


def test_providers(spark):
    ask = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, request string")
    recorded = providers.Recorded(spark.createDataFrame([("a", "ANSWER: B")], "k string, reply string"), ["k"])
    got = answers.answered(ask.withColumn("n", F.lit(3)), recorded, "n")
    assert {r["k"]: r["answer"] for r in got.collect()} == {"a": "B", "b": None}
    assert [r["reply"] for r in providers.Function(lambda: lambda xs: [x.upper() for x in xs])(ask).orderBy("k").collect()] == ["X", "Y"]

    def broken(xs):
        raise RuntimeError

    assert [r["reply"] for r in providers.Function(lambda: broken, attempts=2, backoff_s=0)(ask).collect()] == [None, None]
    assert providers.Nothing()(ask).filter("reply is null").count() == 2


def test_point_answers_fall_back_to_the_name(spark):
    listed = spark.createDataFrame([("c", 0, 1, "mug"), ("c", 1, 2, "lamp")], "clip string, idx int, id long, name string")
    ask = spark.createDataFrame([("c", 1, "lamp", "pick 0"), ("c", 2, "Lamp", "none"), ("c", 3, "cup", "none")], "clip string, q_id int, title string, request string")
    replies = ask.select("q_id", F.col("request").alias("reply"))
    got = answers.picked_points(ask, providers.Recorded(replies, ["q_id"]), listed, memory(spark)[1])
    assert sorted((r["q_id"], r["id"], r["x"]) for r in got.collect()) == [(1, 1, 1.0), (2, 2, 0.0), (3, None, None)]


def test_tags_without_a_reply_stay(spark):
    tags = spark.createDataFrame([("c", 0, "Mug"), ("c", 1, "cup"), ("c", 2, "lamp")], "clip string, pos int, tag string")
    replies = spark.createDataFrame([("c", 0, "mug, mug")], "clip string, block long, reply string")
    got = answers.canonical_tags(tags, providers.Recorded(replies, ["clip", "block"]), block=2)
    assert [r["tag"] for r in got.orderBy("first").collect()] == ["mug", "lamp"]


def test_build_stops_at_failures_but_for_optional_stages(spark):
    bad = lambda t: t["missing"]
    build = stages.Build([stages.Stage("a", lambda t: t["x"].limit(1)), stages.Stage("scale", bad, optional=True), stages.Stage("b", lambda t: t["a"])])
    out = build.run({"x": spark.range(3)})
    assert out["b"].count() == 1 and "scale" in build.failed
    with pytest.raises(KeyError):
        stages.Build([stages.Stage("a", bad)]).run({})
    assert "b" not in build.run({"x": spark.range(3)}, only=["a"])


def test_pose_tracks_are_chosen_by_their_gate(spark):
    a, b = (spark.createDataFrame([("p", v), ("f", v)], "clip string, v int") for v in (1, 2))
    gate = spark.createDataFrame([("p", "PASS"), ("f", "FAIL")], "clip string, verdict string")
    assert sorted(map(tuple, stages.chosen_poses(a, b, gate, ["clip"]).collect())) == [("f", 2), ("p", 1)]


def test_documents(spark, tmp_path):
    doc = {"objects": None, "id": 3, "primary_tag": "mug", "trajectory": [{"time_s": 1.0, "clip_frame": 2, "box_2d": [0, 0, 1, 1], "world_vggt": [1, 2, 3]}, {"time_s": 2.0, "world_egoloc": [4.0, 5, 6], "world_vggt": [1, 2, 3]}]}
    (tmp_path / "o.json").write_text(json.dumps([doc]))
    got = readers.observations(readers.read_documents(spark, "objects", str(tmp_path / "o.json"))).orderBy("pos").collect()
    assert [(r["id"], r["tag"], r["time_s"], r["world"]) for r in got] == [(3, "mug", 1.0, [1, 2, 3]), (3, "mug", 2.0, [4, 5, 6])]
    assert readers.read_documents(spark, "relations", str(tmp_path / "none.json")).count() == 0
    for kind in readers.DOCUMENTS:
        assert readers.read_documents(spark, kind, str(tmp_path / "none.json")).columns[-1] == "path"


def test_stages_resume(spark, tmp_path):
    todo = spark.createDataFrame([("a", 1), ("b", 2)], "clip_uid string, v int")
    where = str(tmp_path / "stage")
    assert readers.remaining(todo, where, ["clip_uid"]).count() == 2
    readers.write_stage(todo.filter("v = 1"), where)
    assert [r["clip_uid"] for r in readers.remaining(todo, where, ["clip_uid"]).collect()] == ["b"]
    readers.write_stage(todo.filter("v = 2"), where)
    assert spark.read.parquet(where).count() == 2
    assert readers.work_list("a, ,b", []) == ["a", "b"] and readers.work_list("all", ["z"]) == ["z"]


def test_grid_specs_sql_says_the_rule_for_long_clips(spark, tmp_path):
    """Grids of over 1,200 frames are thinned to 1,200, and five digits name a source: the SQL must say so too."""
    import duckdb

    from keepsight.plans.memory_queries import grid_specs
    from keepsight.plans.queries import SQL

    keys = [1, 999, 1299, 1300, 5999, 9999, 10000, 10002, 99999, 100000]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
        want = c.execute(SQL["grid_specs"]).fetchall()
    got = [tuple(r) for r in grid_specs(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and max(r[-1] for r in got) == 1200 and {r[4] for r in got} == {"other", "numeric5"}


def test_grids_are_made_within_a_row(spark):
    """The frames that listing all and thinning them would give, also of a clip too long to list; no join or exchange that many clips could fill."""
    from keepsight.sources import readers

    clips = [("a", 40 * 1200, 1), ("b", 40 * 1200 + 1, 1), ("c", 300_007, 2), ("d", 0, 1), ("e", 2, 3), ("f", 1, 1), ("g", 41, 1), ("h", None, 1), (None, 81, 1), ("i", 80_000_000_000, 1)]
    df = spark.createDataFrame([(*c, 10.0) for c in clips], "clip_uid string, n_frames long, clip_ratio long, fps double")
    spec = readers.grid_spec(df)
    found = {r["clip_uid"]: r["grid_clip_frames"] for r in spec.collect()}

    def thinned(n, ratio):
        grid = range(0, n // ratio, 40)
        return list(grid) if len(grid) <= 1200 else [grid[int(k * ((len(grid) - 1) / 1199))] for k in range(1199)] + [grid[-1]]

    assert found == {c: thinned(n or 0, ratio) for c, n, ratio in clips}
    plan = spec._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Generate" not in plan
    assert sorted(r["clip_frame"] for r in readers.sampling_grid(df.filter("clip_uid = 'i'")).collect()) == thinned(80_000_000_000, 1)


def test_recall_until_is_recall_of_all_lines(spark):
    """Lines are taken by number, also where a kind has more than can be told, and where the recent ones are of it; null texts match nothing."""
    import random

    from pyspark.sql import functions as F

    from keepsight.functions.text import terms
    from keepsight.operators import ranking

    rng = random.Random(4)
    said = ["took red cup", "red lamp", "blue lamp", "nothing", None]
    lines = spark.createDataFrame([(c, float(t), rng.choice(said)) for c in range(3) for t in rng.sample(range(400), 120)] + [(3, 5.0, "red lamp")], "clip long, t double, text string")
    asked = spark.createDataFrame([(c, 10 * c + k, float(rng.randint(-5, 420)), rng.choice(["red cup", "lamp", "red red lamp", "absent"])) for c in range(5) for k in range(10)], "clip long, q long, until double, question string").withColumn("qt", terms(F.col("question")))
    all_lines = asked.join(lines, "clip").filter("t <= until").withColumn("hits", F.coalesce(F.size(F.array_intersect("qt", terms(F.col("text")))), F.lit(0)))
    want = ranking.recall_events(all_lines, ["q"], "t", "hits", "t")
    got = ranking.recall_until(asked, lines, ["clip"], "q", F.col("until"), "t", "qt", "text", terms)
    assert sorted((r["q"], r["t"]) for r in got.collect()) == sorted((r["q"], r["t"]) for r in want.collect())


def test_relations_of_a_question_meet_its_candidates_once(spark):
    """Two joins, one for each end of an episode, and one row of an (a, b, rel) leaves a task."""
    import random

    from keepsight.operators.relations import PRIORITY, relation_context

    rng = random.Random(11)
    eps = [(rng.randrange(6), rng.randrange(6), f"n{k % 3}", rng.choice(["on", "near", "left of"]), float(rng.randrange(40)), float(rng.randrange(40, 60))) for k in range(150)]
    eps = [(a, b, f"n{a}", r, t0, t1) for a, b, _, r, t0, t1 in eps]
    cand = [(q, float(10 * q), i) for q in range(6) for i in rng.sample(range(6), 1 + q % 3)]
    got = relation_context(spark.createDataFrame(eps + eps[:9], "a long, b long, a_name string, rel string, t0 double, t1 double"), spark.createDataFrame(cand + cand[:3], "q long, until double, id long"), "q", "until", 4)
    want = []
    for q in range(6):
        own, until, latest = {i for x, _, i in cand if x == q}, 10.0 * q, {}
        for a, b, name, rel, t0, t1 in eps:
            if t0 <= until and (rel == "on" and {a, b} & own or {a, b} <= own):
                latest[a, b, rel] = max(latest.get((a, b, rel), (-1, -1)), (t0, min(t1, until)))
        first = sorted((PRIORITY[rel], -t1, a, b, rel, t0) for (a, b, rel), (t0, t1) in latest.items())[:4]
        want += [(q, a, b, f"n{a}", rel, t0, -t1, k) for k, (_, t1, a, b, rel, t0) in enumerate(first, 1)]
    assert sorted((r["q"], r["a"], r["b"], r["a_name"], r["rel"], r["t0"], r["t1"], r["rank"]) for r in got.collect()) == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_questions_are_answered_in_shares(spark, monkeypatch):
    """Each recording's questions once, as when all are answered at a time; of a share only its answers stay on disk."""
    from keepsight.plans import answers, memory_queries
    from keepsight.sources.shared import shared_dir

    sf = "/root/testdata/sf0.001"
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda: {f.getPath().getName() for f in store.listStatus(folder)} if store.exists(folder) else set()
    rows = lambda: sorted(map(tuple, memory_queries.text_prompts(spark, sf).collect()))
    want, before = rows(), names()
    monkeypatch.setattr(answers, "AT_A_TIME", 400)
    assert rows() == want
    assert sorted(n.split("-")[0] for n in names() - before) == ["answers"] * 3


def test_lines_are_assembled_in_one_exchange(spark):
    from keepsight.plans import contexts

    part = lambda rows: spark.createDataFrame(rows, "q long, rank int, line string")
    parts = {"A": part([(1, 2, "two"), (1, 1, "one"), (2, 1, None)]), "B": part([(1, 5, "b"), (3, 1, "c")])}
    got = contexts.assembled(parts, "q", part([(1, 2, "y"), (1, 1, "x"), (4, 1, "z")]))
    assert sorted(map(tuple, got.collect())) == [(1, "A:\none\ntwo\n\nB:\nb", ["x", "y"], ["A", "B"]), (2, "A:\n", [], ["A"]), (3, "B:\nc", [], ["B"]), (4, "", ["z"], [])]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    assert sorted(map(tuple, contexts.assembled(parts, "q").collect())) == [(1, "A:\none\ntwo\n\nB:\nb"), (2, "A:\n"), (3, "B:\nc")]


def test_walked_path_is_the_path_of_all_positions(spark):
    from pyspark.sql import functions as F

    from keepsight.plans import contexts

    centres = spark.createDataFrame([(c, float(t), t / 7, 1.0, c / 3) for c in range(2) for t in range(1, 40, c + 1)], "clip long, time_s double, x double, y double, z double")
    asked = spark.createDataFrame([(c, 10 * c + k, 4.5 * k) for c in range(3) for k in range(10)], "clip long, q long, t double")
    want = contexts.wearer_path(asked.join(centres, "clip"), "q", "time_s", "t")
    got = contexts.walked_path(asked, centres, ["clip"], "q", "time_s", "t")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # What is read for a question doesn't grow with the recording: six rows of it, and no join by clip alone.
    assert got.count() and "_asks" in got._jdf.queryExecution().optimizedPlan().toString()
