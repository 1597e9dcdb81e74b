"""Retrieval and recall: ranked candidates for questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsight.operators.aggregates import quantised
from keepsight.operators.windows import counted_until, last_numbers, picked, top_k

DT, TOP_N, NAME_WEIGHT = 6.0, 4, 3.0


def term_hits(questions: DataFrame, objects: DataFrame, question_id: str, object_id: str, question_terms: str, object_terms: str, name: str) -> DataFrame:
    """Number of shared distinct terms of each question and object that share any, by an inverted index."""
    q = questions.select(question_id, F.explode(question_terms).alias("_term")).distinct()
    o = objects.select(object_id, F.explode(object_terms).alias("_term")).distinct()
    return q.join(o, "_term").groupBy(question_id, object_id).agg(F.count("*").alias(name))


def rank_text(candidates: DataFrame, question_id: str, pos: str, top_n: int = TOP_N, dt: float = DT, name_weight: float = NAME_WEIGHT) -> DataFrame:
    """Best top_n of candidates with name_hits, text_hits and best_dt (1e9 where never seen), those admitted by any hit or nearness."""
    near = F.col("best_dt") <= dt
    score = quantised(name_weight * F.col("name_hits") + F.col("text_hits") + 2.0 * near.cast("double") + 1.0 / (1.0 + F.col("best_dt") / 60.0), 3)
    admitted = candidates.filter((F.col("name_hits") > 0) | (F.col("text_hits") > 0) | near).withColumn("score", score)
    w = Window.partitionBy(question_id).orderBy(F.desc("score"), "best_dt", pos)
    return admitted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)


def rank_distance(pairs: DataFrame, question_id: str, object_id: str, distance: Column, top_n: int = TOP_N) -> DataFrame:
    """Objects by their least distance to the question's point, with 1/(1+d) as score."""
    d = pairs.groupBy(question_id, object_id).agg(F.min(distance).alias("distance"))
    w = Window.partitionBy(question_id).orderBy("distance", object_id)
    return d.withColumn("score", quantised(1.0 / (1.0 + F.col("distance")), 3)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)


def rank_overlap(pairs: DataFrame, question_id: str, object_id: str, overlap: Column, top_n: int = TOP_N) -> DataFrame:
    """Objects by their largest box overlap within the question's time window."""
    d = pairs.groupBy(question_id, object_id).agg(F.max(overlap).alias("overlap"))
    w = Window.partitionBy(question_id).orderBy(F.desc("overlap"), object_id)
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)


def recall_events(lines: DataFrame, keys: list[str], time: str, overlap: str, pos: str, recent: int = 6, match: int = 10) -> DataFrame:
    """Of each question's lines up to its time: the most recent, and the best-matching others (later first on ties) up to match more."""
    w = Window.partitionBy(*keys)
    ranked = lines.withColumn("_recent", F.row_number().over(w.orderBy(F.desc(time), F.desc(pos))) <= recent)
    order = Window.partitionBy(*keys, "_recent").orderBy(F.desc(overlap), F.desc(pos))
    ranked = ranked.withColumn("_rn", F.row_number().over(order))
    return ranked.filter(F.col("_recent") | ((F.col(overlap) > 0) & (F.col("_rn") <= match))).drop("_recent", "_rn")


def recall_until(questions: DataFrame, lines: DataFrame, keys: list[str], question: str, until: Column, time: str, terms: str, text: str, words: Callable[[Column], Column], recent: int = 6, match: int = 10) -> DataFrame:
    """What recall_events() gives of the lines up to each question's time; overlap is the number of common terms, words(text) a line's.

    Lines of one text are a kind, which matches a question as a whole. Of a kind
    only the latest recent + match lines can be told, so a question meets as many
    of each kind that it shares a term with, and not all lines of its key.
    """
    asked = questions.select(*keys, question, until.alias("_until"), F.col(terms).alias("_terms"))
    counted, numbered = counted_until(asked, lines, keys, F.col("_until"), [time])
    counted, numbered = counted.withColumnRenamed("n_before", "_n"), numbered.withColumnRenamed("i", "_at")
    fresh = picked(counted, numbered.withColumn("i", F.col("_at")), keys, last_numbers(F.col("_n"), recent))
    kinds = lines.select(*keys, text).distinct().withColumn("_words", words(F.col(text)))
    hit = counted.join(kinds, keys).withColumn("_hits", F.size(F.array_intersect("_terms", "_words"))).filter("_hits > 0").drop("_terms", "_words")
    sought, of_kind = counted_until(hit, numbered, [*keys, text], F.col("_until"), [time, "_at"])
    old = picked(sought, of_kind, [*keys, text], last_numbers(F.col("n_before"), recent + match)).filter(F.col("_at") <= F.col("_n") - recent)
    best = top_k(old, [question], [F.desc("_hits"), F.desc("_at")], match)
    return fresh.select(question, *lines.columns).unionByName(best.select(question, *lines.columns))


def latest_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return top_k(df, keys, order, 1)
