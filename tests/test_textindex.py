"""Early-stopping retrieval gives what scoring every pair gives."""

import random

import pytest
from pyspark.sql import functions as F

from keepsight.operators import textindex
from keepsight.operators.textindex import build_index, scan, search


def corpus(n=300, seed=2):
    """Zipf-like words, so that some are in nearly all objects; names of a few words; empty and null-free sets."""
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"
    objects = [(i, sorted({word() for _ in range(rng.choice((0, 3, 20, 60)))}), sorted({word() for _ in range(rng.choice((0, 1, 4)))}), float(i % 17)) for i in range(n)]
    asked = [(q, sorted({word() for _ in range(rng.choice((0, 1, 5, 25)))})) for q in range(40)] + [(40, ["absent"]), (41, objects[7][1]), (42, objects[8][2])]
    return objects, asked


def plain(objects, asked, top_n):
    out = []
    for q, terms in asked:
        scored = []
        for i, text, name, age in objects:
            nh, th = len(set(terms) & set(name)), len(set(terms) & set(text))
            if nh or th:
                score = int((3.0 * nh + th + 2.0 * (age <= 6) + 1.0 / (1.0 + age / 60.0)) * 1000 + 0.5) / 1000
                scored.append((-score, age, i))
        out += [(q, i, rank, -s) for rank, (s, _, i) in enumerate(sorted(scored)[:top_n], 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "seeds", "top_n", "static"), ((1024, 64, 4, True), (4, 1, 4, True), (16, 30, 1, False), (3, 10**6, 9, False)))
def test_equals_scoring_every_pair(spark, monkeypatch, block, seeds, top_n, static):
    monkeypatch.setattr(textindex, "BLOCK", block)
    objects, asked = corpus()
    df = spark.createDataFrame(objects, "id long, text array<string>, name array<string>, age double")
    if static:
        df = df.withColumn("most", 2.0 * (F.col("age") <= 6).cast("double") + 1.0 / (1.0 + F.col("age") / 60.0))
    index = build_index(df, "id", "text", "name", "most" if static else None, buckets=3)
    q = spark.createDataFrame(asked, "q long, terms array<string>")
    got = search(index, q, "q", "terms", lambda pairs: pairs.withColumn("best_dt", (F.col("id") % 17).cast("double")), top_n, seeds=seeds)
    assert sorted((r["q"], r["id"], r["rank"], r["score"]) for r in got.collect()) == plain(objects, asked, top_n)
    if block == 4:
        sizes = index.postings.groupBy("list").agg(F.max(F.size("objects")).alias("n"), F.count("*").alias("blocks"), F.sum(F.size("objects")).alias("all")).orderBy(F.desc("all")).first()
        assert sizes["blocks"] > 20 and sizes["n"] < sizes["all"] / 10  # a common term is many rows


def test_common_lists_are_passed_over(spark):
    """One word is in every object; a question with rare words that decide reads none of its postings."""
    objects = [(i, ["common", f"own{i}", f"pair{i // 2}", f"four{i // 4}", f"five{i // 5}"], [f"own{i}"], 90.0) for i in range(400)]
    df = spark.createDataFrame(objects, "id long, text array<string>, name array<string>, age double").withColumn("most", F.lit(0.5))
    index = build_index(df, "id", "text", "name", "most", buckets=2)
    scored = []
    count = lambda pairs: scored.append(pairs.count()) or pairs.withColumn("best_dt", F.lit(90.0))
    q = spark.createDataFrame([(1, ["common", "own8", "pair4", "four2", "five1"])], "q long, terms array<string>")
    got = [r["id"] for r in search(index, q, "q", "terms", count, 2).orderBy("rank").collect()]
    assert got == [8, 9] and scored[-1] <= 10


@pytest.mark.parametrize("top_n", (1, 4, 9))
def test_a_scan_equals_scoring_every_pair(spark, top_n):
    objects, asked = corpus()
    df = spark.createDataFrame(objects, "id long, text array<string>, name array<string>, age double").repartition(3, "id")
    q = spark.createDataFrame(asked, "q long, terms array<string>")
    got = scan(df, "id", "text", "name", q, "q", "terms", lambda pairs: pairs.withColumn("best_dt", (F.col("id") % 17).cast("double")), top_n)
    assert sorted((r["q"], r["id"], r["rank"], r["score"]) for r in got.collect()) == plain(objects, asked, top_n)


def test_text_topk_moves_no_pairs(spark):
    """Documents are laid out by id once; of the pairs of a question and a document only the best of a task leave it."""
    from keepsight.plans.queries import QUERIES

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES["text_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert len(moved) == 2 and "item_id" in moved[0] and "doc_id" in moved[1]
    assert plan.count("WindowGroupLimit") >= 2


def test_empty_tables(spark):
    objects, asked = corpus(20)
    df = spark.createDataFrame(objects, "id long, text array<string>, name array<string>, age double")
    q = spark.createDataFrame(asked, "q long, terms array<string>")
    age = lambda pairs: pairs.withColumn("best_dt", F.lit(1.0))
    assert search(build_index(df.limit(0), "id", "text", "name"), q, "q", "terms", age).count() == 0
    assert search(build_index(df, "id", "text", "name"), q.limit(0), "q", "terms", age).count() == 0
