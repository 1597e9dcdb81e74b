"""Question plans: one plan for a batch of questions of many recordings.

A plan is given flat tables and ends in one text for each question; a provider
then answers. Nothing is done question by question.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsight.functions.geometry import point_score
from keepsight.functions.text import parse_id, parse_markup, parse_reply, plain_question, terms
from keepsight.operators import nearest, places, ranking, relations
from keepsight.plans import contexts
from keepsight.sources.shared import passing, written

#: Observations of the recordings whose questions are answered at a time.
AT_A_TIME = 4_000_000


@dataclass(frozen=True)
class Profile:
    """What the context of a question holds."""

    path: bool = True
    places: bool = True
    relations: bool = True
    events: bool = True
    max_relations: int = 10


def named_off(profile: Profile) -> list[str]:
    """Parts that a profile leaves out."""
    return [f.name for f in fields(profile) if getattr(profile, f.name) is False]


def candidates(objects: DataFrame) -> DataFrame:
    """Objects with a position, and all their names, the main one first."""
    named = objects.filter("x is not null")
    return named.withColumn("names", F.concat(F.array("primary_tag"), F.coalesce("secondary_tags", F.array().cast("array<string>"))))


def text_candidates(questions: DataFrame, objects: DataFrame, obs: DataFrame) -> DataFrame:
    """Ranked objects for text questions (qid, clip, question, t), from what was seen by t.

    objects: clip, id, name, description; obs: clip, id, time_s, x, y, z. An
    object's observations are laid out once as a track in time order; a question
    meets tracks, not observations, and reads each up to its time.
    """
    q = questions.select("qid", "clip", "t", terms(F.col("question")).alias("qt"))
    o = objects.select("clip", "id", "name", terms(F.col("name")).alias("nt"), terms(F.coalesce("description", F.lit(""))).alias("dt"))
    tracks = obs.groupBy("clip", "id").agg(F.array_sort(F.collect_list(F.struct("time_s", "x", "y", "z"))).alias("_p")).join(o, ["clip", "id"])
    hits = lambda c: F.size(F.array_intersect("qt", c))
    asked = q.join(tracks, "clip").withColumns({"name_hits": hits("nt"), "text_hits": hits("dt"), "_p": F.filter("_p", lambda p: p["time_s"] <= F.col("t"))})
    asked = asked.withColumn("n_obs", F.size("_p").cast("long")).filter("n_obs > 0").withColumn("best_dt", F.col("t") - F.try_element_at("_p", F.lit(-1))["time_s"])

    def middle(axis):
        v = F.array_sort(F.transform("_p", lambda p: p[axis]))
        half = F.floor((F.size(v) - 1) / 2).cast("int")
        low, high = F.get(v, half), F.get(v, F.size(v) - 1 - half)
        return low * 0.5 + high * 0.5

    # Tracks stay where they are read: what is ranked is one small row for each.
    placed = asked.filter((F.col("name_hits") > 0) | (F.col("text_hits") > 0) | (F.col("best_dt") <= ranking.DT)).withColumns({a: middle(a) for a in "xyz"})
    return ranking.rank_text(placed.drop("qt", "nt", "dt", "_p"), "qid", "id")


def text_question(questions: DataFrame, objects: DataFrame, obs: DataFrame, segments: DataFrame, events: DataFrame, episodes: DataFrame, centres: DataFrame | None = None, visits: DataFrame | None = None, profile: Profile = Profile()) -> DataFrame:
    """Context for text-anchored questions: the wearer's path and places, candidates, their history, relations and events up to t, with a trace.

    segments: clip, id, t0, t1, description; events: clip, time_s, text;
    episodes: clip, a, b, rel, t0, t1; centres: clip, time_s, x, y, z; visits:
    clip, label, t0, t1. What the profile switches off, or isn't given, is left
    out. Gives qid, context, retrieved (names in rank order), has_path.

    Recordings are answered in shares of about AT_A_TIME observations, one after
    another, so what lies on disk at a time but for the answers doesn't grow with
    the table.
    """
    given = [questions, objects, obs, segments, events, episodes, centres, visits]
    shares = ceil(obs.count() / AT_A_TIME)
    if shares <= 1:
        return question_context(*given, profile)
    told = []
    for k in range(shares):
        of = [None if df is None else df.filter(F.pmod(F.xxhash64("clip"), F.lit(shares)) == k) for df in given]
        with passing(obs.sparkSession):
            told.append(written(question_context(*of, profile), "answers", stays=True))
    return reduce(DataFrame.unionByName, told)


def question_context(questions: DataFrame, objects: DataFrame, obs: DataFrame, segments: DataFrame, events: DataFrame, episodes: DataFrame, centres: DataFrame | None, visits: DataFrame | None, profile: Profile) -> DataFrame:
    """text_question() of recordings that are answered at once."""
    ranked = written(text_candidates(questions, objects, obs), "candidates")
    lines = contexts.candidate_lines(ranked.withColumns({"unit": F.lit("scene units"), "ego": F.lit(None).cast("string")}), "qid")
    past = ranked.select("qid", "clip", "id", "rank", "name", "t").join(segments, ["clip", "id"]).filter(F.col("t0") <= F.col("t")).withColumn("t1", F.least("t1", "t"))
    told = contexts.history(past, ["qid", "id", "rank", "name"]).select("qid", "rank", F.concat_ws(": ", "name", "history").alias("line"))
    heard = events.select("clip", "time_s", "text")
    asks = questions.select("qid", "clip", "t", terms(F.col("question")).alias("qt"))
    recalled = ranking.recall_until(asks, heard, ["clip"], "qid", F.col("t") + 1e-6, "time_s", "qt", "text", terms)
    said = recalled.select("qid", (F.col("time_s") * 10).cast("long").alias("rank"), F.concat(contexts.seconds(F.col("time_s")), F.lit(" "), F.col("text")).alias("line"))
    names = objects.select("clip", F.col("id"), "name")
    asked = ranked.select("qid", "clip", "id", F.col("t").alias("until"))
    known = episodes.join(names.select("clip", F.col("id").alias("a"), F.col("name").alias("a_name")), ["clip", "a"]).join(names.select("clip", F.col("id").alias("b"), F.col("name").alias("b_name")), ["clip", "b"])
    parts, one = {}, lambda df, c="line": df.select("qid", F.lit(0).alias("rank"), F.col(c).alias("line"))
    if centres is not None and profile.path:
        walked = contexts.walked_path(questions.select("qid", "clip", "t"), centres, ["clip"], "qid", "time_s", "t")
        parts["PATH"] = one(walked, "path")
    if visits is not None and profile.places:
        seen = places.current_visit(visits, questions.select("qid", "clip", F.col("t").alias("until")), ["clip"], "until")
        parts["PLACES"] = one(contexts.places_text(seen, ["qid"]))
    parts |= {"CANDIDATES": lines, "HISTORY": told}
    if profile.relations:
        pairs = known.select(F.struct("clip", "a").alias("a"), F.struct("clip", "b").alias("b"), "a_name", "b_name", "rel", "t0", "t1")
        parts["RELATIONS"] = contexts.relation_lines(relations.relation_context(pairs, asked.select("qid", "until", F.struct("clip", "id").alias("id")), "qid", "until", profile.max_relations), "qid")
    if profile.events:
        parts["EVENTS"] = said
    out = contexts.assembled(parts, "qid", ranked.select("qid", "rank", F.col("name").alias("line")))
    return out.select("qid", "context", F.col("traced").alias("retrieved"), F.array_contains("told", "PATH").alias("has_path"))


def spatial_question(questions: DataFrame, obs: DataFrame, segments: DataFrame, dt: float = ranking.DT) -> DataFrame:
    """Context for questions (qid, clip, question, point) whose markup names a time and a box.

    With a lifted point objects are ranked by distance, else by box overlap.
    This path may look ahead of its time. obs: clip, id, name, time_s, cam, box.
    """
    m = parse_markup(F.col("question"))
    q = questions.select("qid", "clip", "point", plain_question(F.col("question")).alias("plain"), m["time_s"].alias("t"), m["box"].alias("qbox")).filter("t is not null")
    seen = obs.select("clip", "id", "time_s", "box", *[F.col(f"cam.{a}").alias(a) for a in "xyz"])
    pointed = q.filter("point is not null").select("clip", "qid", "t", *[F.col(f"point.{a}").alias(f"p{a}") for a in "xyz"])
    by_point = nearest.nearest_objects(pointed, seen, ["clip"], "qid", dt).select("qid", "id", "rank")
    by_box = nearest.overlapping_objects(q.filter("point is null and qbox is not null"), seen, ["clip"], "qid", dt).select("qid", "id", "rank")
    names = obs.groupBy("clip", "id").agg(F.min("name").alias("name"))
    ranked = by_point.unionByName(by_box).join(q.select("qid", "clip"), "qid").join(names, ["clip", "id"])
    told = contexts.history(ranked.join(segments, ["clip", "id"]), ["qid", "id", "rank", "name"]).select("qid", "rank", F.concat_ws(": ", "name", "history").alias("line"))
    return contexts.assembled({"OBJECTS": told}, "qid").join(q.select("qid", "plain"), "qid")


def answered(prompts: DataFrame, provider: Callable[[DataFrame], DataFrame], n_choices: str) -> DataFrame:
    """prompts (with `request`) and the letter that the provider's reply gives."""
    return provider(prompts).withColumn("answer", parse_reply(F.col("reply"), F.col(n_choices)))


def picked_points(prompts: DataFrame, provider: Callable[[DataFrame], DataFrame], listed: DataFrame, obs: DataFrame) -> DataFrame:
    """Positions of the objects that a provider picks for titles; listed: clip, idx, id, name."""
    picks = provider(prompts).withColumn("pick", parse_id(F.col("reply")))
    return contexts.point_answer(picks, listed, obs)


def listed_candidates(summary: DataFrame, clip: str, object_id: str) -> DataFrame:
    """The objects of each recording that have a position, numbered from 0 in order of their ids."""
    from pyspark.sql import Window

    return summary.filter("x is not null").withColumn("idx", (F.row_number().over(Window.partitionBy(clip).orderBy(object_id)) - 1).cast("int"))


def scored_points(answers: DataFrame, first: Column, second: Column) -> DataFrame:
    """answers (x, y, z) with their distance to the annotated point and whether they count as found; null where nothing was picked."""
    score = point_score(F.struct("x", "y", "z"), first, second)
    found = F.col("x").isNotNull()
    return answers.withColumns({"l2": F.when(found, score["l2"]), "success": F.when(found, score["success"])})


def synonym_groups(tags: DataFrame, provider: Callable[[DataFrame], DataFrame], block: int = 60) -> DataFrame:
    """Tags (clip, pos, tag) grouped as a provider says, a line of comma-separated tags for each group; a tag that no line names, or a block without a reply, is a group of its own."""
    blocked = tags.withColumn("block", F.floor(F.col("pos") / block)).groupBy("clip", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"]).alias("raw"))
    replied = provider(blocked.withColumn("request", F.array_join("raw", "\n")))
    lines = F.filter(F.transform(F.split(F.lower(F.coalesce("reply", F.lit(""))), "\n"), lambda x: F.filter(F.transform(F.split(x, ","), lambda y: F.trim(y)), lambda y: y != "")), lambda x: F.size(x) > 0)
    said = replied.select("clip", "block", F.posexplode(lines).alias("_g", "_tags")).select("clip", "block", "_g", F.explode("_tags").alias("_tag"))
    first = said.groupBy("clip", "block", "_tag").agg(F.min("_g").alias("_g"))
    own = tags.withColumns({"block": F.floor(F.col("pos") / block), "_tag": F.lower("tag")})
    return own.join(first, ["clip", "block", "_tag"], "left").select("clip", "pos", "tag", F.coalesce(F.concat_ws("-", "block", "_g"), F.lit("")).alias("_k"), "_g").select("clip", "pos", "tag", F.when(F.col("_g").isNull(), F.concat(F.lit("own "), F.col("tag"))).otherwise(F.col("_k")).alias("group"))


def canonical_tags(tags: DataFrame, provider: Callable[[DataFrame], DataFrame], block: int = 60) -> DataFrame:
    """Tags (clip, pos, tag) as a provider rewrites them, in blocks; a block without a reply keeps its own. Distinct, in order of first use."""
    blocked = tags.withColumn("block", F.floor(F.col("pos") / block)).groupBy("clip", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"]).alias("raw"))
    replied = provider(blocked.withColumn("request", F.array_join("raw", "\n")))
    lines = F.filter(F.transform(F.split(F.lower("reply"), "[\n,]"), lambda x: F.trim(x)), lambda x: x != "")
    out = replied.select("clip", "block", F.posexplode(F.when(F.size(lines) > 0, lines).otherwise(F.col("raw"))).alias("at", "tag"))
    return out.groupBy("clip", "tag").agg(F.min(F.struct("block", "at")).alias("first")).select("clip", "tag", "first")
