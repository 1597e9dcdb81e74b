"""Context of questions: what the memory says, as rows of text per question.

Numbers are written as Python writes them, by an Arrow UDF at the very end;
all ranking and lookup before it is plain columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsight.functions.geometry import azimuth, distance, elevation, sector_label
from keepsight.functions.sequences import even_indices
from keepsight.functions.text import python_format, terms
from keepsight.operators.windows import counted_until, even_sample, picked, top_k

STALE_S, MAX_SEGMENTS, WAYPOINTS = 20.0, 8, 6


def seconds(c: Column, digits: int = 0) -> Column:
    return F.concat(python_format(f".{digits}f")(c), F.lit("s"))


def ego_text(cam: Column, unit: Column, band: float = 15.0) -> Column:
    """Direction and distance of a point in camera axes; null without one."""
    origin = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return F.when(cam.isNotNull() & ~F.isnan(cam["x"] + cam["y"] + cam["z"]), F.concat(sector_label(cam["x"], cam["y"], cam["z"], band), F.lit(", "), python_format(".1f")(distance(cam, origin)), F.lit(" "), unit))


def history(segments: DataFrame, keys: list[str], most: int = MAX_SEGMENTS) -> DataFrame:
    """Up to `most` evenly spaced segments (t0, t1, description) of an object as one text."""
    picked = even_sample(segments, keys, ["t0"], most).withColumn("_line", F.concat(seconds(F.col("t0")), F.lit("-"), seconds(F.col("t1")), F.lit(": "), F.coalesce("description", F.lit("seen"))))
    return picked.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t0", "_line"))), lambda x: x["_line"]), "; ").alias("history"))


def candidate_lines(candidates: DataFrame, question: str) -> DataFrame:
    """One line for each candidate (rank, name, n_obs, x, y, z, unit, ego, where null positions are left out)."""
    number = python_format(".2f")
    where = F.when(F.col("x").isNotNull(), F.concat(F.lit(" at ("), F.concat_ws(", ", number("x"), number("y"), number("z")), F.lit(") "), F.col("unit")))
    return candidates.select(question, "rank", F.concat_ws("", F.lit("#"), F.col("rank").cast("string"), F.lit(" "), F.col("name"), F.lit(" ("), F.col("n_obs").cast("string"), F.lit(" obs)"), where, F.concat(F.lit("; "), F.col("ego"))).alias("line"))


def relation_lines(context: DataFrame, question: str) -> DataFrame:
    span = F.when(F.col("current"), F.concat(F.lit("since "), seconds(F.col("t0")))).otherwise(F.concat(python_format(".0f")("t0"), F.lit("-"), seconds(F.col("t1")), F.lit(", not seen since")))
    return context.select(question, "rank", F.concat(F.col("a_name"), F.lit(" is "), F.col("rel"), F.lit(" "), F.col("b_name"), F.lit(" ("), span, F.lit(")")).alias("line"))


def wearer_path(centres: DataFrame, question: str, time: str, until: str, n: int = WAYPOINTS) -> DataFrame:
    """Up to n evenly spaced positions of the wearer up to each question's time; questions with fewer than two are absent."""
    return path_text(even_sample(centres.filter(F.col(time) <= F.col(until)), [question], [time], n), question, time)


def walked_path(questions: DataFrame, centres: DataFrame, keys: list[str], question: str, time: str, until: str, n: int = WAYPOINTS) -> DataFrame:
    """wearer_path() of recordings and questions: a question meets the n positions that it tells, not all up to its time."""
    counted, numbered = counted_until(questions, centres, keys, F.col(until), [time])
    wanted = F.transform(even_indices(F.col("n_before"), n), lambda k: k.cast("long") + 1)
    return path_text(picked(counted, numbered, keys, wanted), question, time)


def path_text(points: DataFrame, question: str, time: str) -> DataFrame:
    number = python_format(".1f")
    line = F.concat(seconds(F.col(time)), F.lit(" ("), F.concat_ws(", ", number("x"), number("y"), number("z")), F.lit(")"))
    path = points.withColumn("_l", line).groupBy(question).agg(F.count("*").alias("_n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(time, "_l"))), lambda x: x["_l"]), " -> ").alias("path"))
    return path.filter("_n >= 2").drop("_n")


def direct_observation(last: DataFrame, time: str, until: str, stale: float = STALE_S) -> DataFrame:
    """Age and direction of an object's last camera-relative view (cam), stale beyond a limit."""
    age = F.col(until) - F.col(time)
    kind = F.when(F.col(time).isNull(), "never").when(age < 1, "now").when(age > stale, "stale").otherwise("recent")
    c, origin = F.col("cam"), F.struct(*[F.lit(0.0).alias(a) for a in "xyz"])
    number, far = python_format(".0f"), F.concat(python_format(".1f")(distance(c, origin)), F.lit(" m away"))
    when = F.when(age < 1, "at the question time").otherwise(F.concat(number(age), F.lit(" s before")))
    line = F.when(kind == "stale", F.concat(F.lit("last seen "), number(age), F.lit(" s before, "), far, F.lit(" then; you have moved since"))).when(kind != "never", F.concat(F.lit("seen "), when, F.lit(", "), far, F.lit(" ("), python_format("+.0f")(azimuth(c["x"], c["z"])), F.lit(" deg)")))
    return last.withColumns({"age_s": age, "freshness": kind, "direction": sector_label(c["x"], c["y"], c["z"]), "elevation": elevation(c["x"], c["y"], c["z"]), "line": line})


def trajectory_text(obs: DataFrame, keys: list[str], most: int, last: bool = False) -> DataFrame:
    """The first (or last) `most` points of an object that has no segments, as one text."""
    order = [F.desc("time_s"), F.desc("pos")] if last else ["time_s", "pos"]
    number = python_format(".2f")
    line = F.concat(seconds(F.col("time_s"), 1), F.lit(" at ("), F.concat_ws(", ", *[number(a) for a in "xyz"]), F.lit(")"))
    rows = top_k(obs, keys, order, most).withColumn("_l", line).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("time_s", "pos", "_l"))).alias("_l"))
    return rows.select(*keys, F.array_join(F.transform("_l", lambda x: x["_l"]), "; ").alias("line"))


def places_text(visits: DataFrame, keys: list[str]) -> DataFrame:
    """Where the wearer is and came from: visits (label, t0, t1, back), newest first by back."""
    now = F.concat(F.col("label"), F.lit(" since "), seconds(F.col("t0")))
    span = F.concat(F.col("label"), F.lit(" ("), python_format(".0f")("t0"), F.lit("-"), seconds(F.col("t1")), F.lit(")"))
    told = visits.withColumns({"_now": F.when(F.col("back") == 1, now), "_span": span}).groupBy(*keys).agg(F.max("_now").alias("_now"), F.array_sort(F.collect_list(F.struct("t0", "_span"))).alias("_all"))
    return told.select(*keys, F.concat(F.lit("now in "), F.col("_now"), F.lit("; before: "), F.array_join(F.transform("_all", lambda x: x["_span"]), " -> ")).alias("line"))


def match_text(listed: DataFrame, clip: str) -> DataFrame:
    """The candidates of a recording (idx, name, n_obs, x, y, z) as one listing."""
    number = python_format(".2f")
    line = F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] "), F.col("name"), F.lit(", seen "), F.col("n_obs").cast("string"), F.lit("x at ("), F.concat_ws(", ", *[number(a) for a in "xyz"]), F.lit(")"))
    rows = listed.withColumn("_l", line).groupBy(clip).agg(F.array_sort(F.collect_list(F.struct("idx", "_l"))).alias("_l"))
    return rows.select(clip, F.array_join(F.transform("_l", lambda x: x["_l"]), "\n").alias("listing"))


def counting_aid(obs: DataFrame, questions: DataFrame, noun: str, recent: float = 60.0) -> DataFrame:
    """For each question that counts: distinct objects with a noun among the words of their name or tags, the most in one frame, and those of the last minute.

    questions: qid, until, noun forms (array); obs: id, frame, time_s, name, and tags (array) if there are any.
    """
    q = questions.select("qid", "until", F.explode(noun).alias("_noun")).distinct()
    told = F.concat_ws(" ", "name", "tags") if "tags" in obs.columns else F.col("name")
    said = obs.select("id", told.alias("_told")).distinct().select("id", F.explode(terms(F.col("_told"), [])).alias("_noun"))
    named = q.join(said, "_noun").select("qid", "until", "id").distinct()
    seen = named.join(obs.select("id", "frame", "time_s"), "id").filter(F.col("time_s") <= F.col("until"))
    frames = seen.groupBy("qid", "frame").agg(F.count_distinct("id").alias("_n")).groupBy("qid").agg(F.max("_n").alias("most_at_once"))
    return seen.groupBy("qid").agg(F.count_distinct("id").alias("n_objects"), F.count_distinct(F.when(F.col("time_s") >= F.col("until") - recent, F.col("id"))).alias("n_recent")).join(frames, "qid")


def assembled(parts: dict[str, DataFrame], question: str, trace: DataFrame | None = None) -> DataFrame:
    """Lines of several parts as one text for each question, in the order given. With a trace (question, rank, line) also its lines (`traced`) and the titles that have any (`told`)."""
    rows = None
    for k, lines in enumerate([*parts.values(), *([] if trace is None else [trace])]):
        part = lines.select(question, F.lit(k).alias("_k"), F.col("rank").cast("long").alias("rank"), "line")
        rows = part if rows is None else rows.unionByName(part)
    # One exchange brings all lines of a question together.
    all_ = rows.groupBy(question).agg(F.array_sort(F.collect_list(F.struct("_k", "rank", "line"))).alias("_all"))
    of = lambda k: F.transform(F.filter("_all", lambda x: x["_k"] == k), lambda x: x["line"])
    each = all_.select(question, *[of(k).alias(f"_{k}") for k in range(len(parts) + (trace is not None))])
    some = [F.size(f"_{k}") > 0 for k in range(len(parts))]
    context = F.concat_ws("\n\n", *[F.when(s, F.concat(F.lit(f"{title}:\n"), F.array_join(f"_{k}", "\n"))) for k, (s, title) in enumerate(zip(some, parts))])
    if trace is None:
        return each.select(question, context.alias("context"))
    return each.select(question, context.alias("context"), F.col(f"_{len(parts)}").alias("traced"), F.array_compact(F.array(*[F.when(s, title) for s, title in zip(some, map(F.lit, parts))])).alias("told"))


def point_answer(picks: DataFrame, candidates: DataFrame, obs: DataFrame) -> DataFrame:
    """Median position of the object a reply picks: by index, else by exact name, else none. picks: q_id, title, pick; candidates: clip, idx, id, name."""
    by_index = candidates.select("clip", F.col("idx").alias("pick"), F.col("id").alias("_by_pick"))
    by_name = top_k(candidates, ["clip", "name"], ["idx"], 1).select("clip", F.lower("name").alias("_title"), F.col("id").alias("_by_name"))
    p = picks.withColumn("_title", F.lower("title")).join(by_index, ["clip", "pick"], "left").join(by_name, ["clip", "_title"], "left")
    chosen = p.withColumn("id", F.coalesce("_by_pick", "_by_name")).drop("_by_pick", "_by_name", "_title")
    centre = obs.groupBy("clip", "id").agg(*[F.median(a).alias(a) for a in "xyz"])
    return chosen.join(centre, ["clip", "id"], "left")
