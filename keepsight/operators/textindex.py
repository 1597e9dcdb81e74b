"""Ranked text retrieval by an inverted index that stops early.

A term has a list of the objects that have it in their name and one of those that
have it in their text; being in a list adds the list's weight to a score. A list
lies in blocks of objects with similar bounds, at most BLOCK each, so a common
term is many rows and many tasks. A question reads its lists from the shortest
on. An object first met in some list is in none of those before it, so a block
can be passed over once the list's weight, the bound of the block's objects and
the weights of all later lists stay below the score of the top_n-th object known
so far. The known ones come from the shortest lists. Of the objects that are
met, those whose hits and all that was passed over could still get there are
scored exactly; no pair of a question and an object is made for a list that
can't matter.

An index pays when many questions use it. A batch of questions that is small
beside the objects is answered by scan(), which reads each object once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsight.operators import ranking
from keepsight.operators.windows import top_k
from keepsight.sources.shared import bucketed, written

#: Objects of a block, levels of bounds that blocks are made by, and postings that seed a question.
BLOCK, LEVELS, SEEDS = 1024, 8, 64
#: What a question's time can add to a score at most: near, and just seen.
MOST_OF_TIME = 3.0


@dataclass(frozen=True)
class TextIndex:
    """postings: list, weight, bound, block, objects (array); lists: list, weight, n_objects; objects: id, name_terms, text_terms."""

    postings: DataFrame
    lists: DataFrame
    objects: DataFrame
    id: str


def listed(terms: Column, field: str, weight: float) -> Column:
    return F.transform(terms, lambda x: F.struct(F.concat(F.lit(field), x).alias("list"), F.lit(weight).alias("weight")))


def build_index(objects: DataFrame, object_id: str, text_terms: str, name_terms: str, bound: str | None = None, name_weight: float = ranking.NAME_WEIGHT, buckets: int = 16) -> TextIndex:
    """The index of objects (arrays of distinct terms); bound: the most that anything but terms adds to an object's score, MOST_OF_TIME if not given."""
    most = F.col(bound) if bound else F.lit(MOST_OF_TIME)
    kept = written(objects.select(F.col(object_id), F.col(text_terms).alias("text_terms"), F.col(name_terms).alias("name_terms"), most.alias("_bound")), "index-objects")
    each = kept.select(object_id, "_bound", F.explode(F.concat(listed(F.col("text_terms"), "text ", 1.0), listed(F.col("name_terms"), "name ", name_weight))).alias("p")).select("p.list", object_id, "_bound", "p.weight")
    lists = written(each.groupBy("list").agg(F.first("weight").alias("weight"), F.count("*").alias("n_objects")), "index-lists")
    level = F.floor(F.col("_bound") * LEVELS / MOST_OF_TIME)
    blocked = each.join(lists.select("list", "n_objects"), "list").withColumn("block", F.pmod(F.xxhash64(object_id), F.ceil(F.col("n_objects") / BLOCK)))
    postings = blocked.groupBy("list", "weight", level.alias("level"), "block").agg(F.max("_bound").alias("bound"), F.collect_list(object_id).alias("objects")).drop("level")
    return TextIndex(bucketed(postings, "postings", "list", buckets), lists, kept, object_id)


def search(index: TextIndex, questions: DataFrame, question_id: str, terms: str, completed: Callable[[DataFrame], DataFrame], top_n: int = ranking.TOP_N, name_weight: float = ranking.NAME_WEIGHT, seeds: int = SEEDS) -> DataFrame:
    """The best top_n objects of each question among those that share a term with it, as ranking.rank_text() ranks them.

    completed adds best_dt to pairs (question_id, object id): how long ago the
    object was seen when the question was asked.
    """
    asked = written(questions.select(question_id, F.col(terms).alias("_qt")), "asked")
    w = Window.partitionBy(question_id).orderBy("n_objects", "list")
    known = asked.select(question_id, F.explode(F.concat(listed(F.col("_qt"), "text ", 1.0), listed(F.col("_qt"), "name ", name_weight))).alias("p")).select(question_id, "p.list").join(index.lists, "list")
    # What the lists after one can add, and the postings up to it.
    laid = known.withColumns({"later": F.coalesce(F.sum("weight").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0)), "read": F.sum("n_objects").over(w.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(w)})
    plan = written(laid.select(question_id, "list", "later", "read", "place"), "lists-of-questions")

    def scored(pairs: DataFrame) -> DataFrame:
        both = pairs.join(index.objects, index.id).join(asked, question_id)
        hits = {"name_hits": F.size(F.array_intersect("_qt", "name_terms")), "text_hits": F.size(F.array_intersect("_qt", "text_terms"))}
        return ranking.rank_text(completed(both.select(question_id, index.id, *[c.alias(k) for k, c in hits.items()])), question_id, index.id, top_n, name_weight=name_weight)

    first = plan.filter((F.col("read") <= seeds) | (F.col("place") == 1)).join(index.postings, "list")
    # The first list may be long: its best blocks alone make enough seeds.
    first = top_k(first, [question_id, "list"], [F.desc("bound"), "block"], 4).select(question_id, "weight", F.explode("objects").alias(index.id))
    met = first.groupBy(question_id, index.id).agg(F.sum("weight").alias("_hits"))
    seeded = scored(top_k(met, [question_id], [F.desc("_hits"), index.id], 4 * top_n).select(question_id, index.id))
    reached = written(seeded.filter(F.col("rank") == top_n).select(question_id, F.col("score").alias("_reached")), "reached-scores")
    # Scores are rounded to three digits, half up: a thousandth is room for that.
    worth = F.col("_reached").isNull() | (F.col("weight") + F.col("bound") + F.col("later") + 1e-3 >= F.col("_reached"))
    blocks = plan.join(reached, question_id, "left").join(index.postings, "list")
    # The most that passed-over lists can add to any object of a question.
    passed = blocks.filter(~worth).groupBy(question_id, "list").agg(F.first("weight").alias("_m")).groupBy(question_id).agg(F.sum("_m").alias("_missed"))
    read = blocks.filter(worth).select(question_id, "_reached", "weight", "bound", F.explode("objects").alias(index.id))
    found = read.groupBy(question_id, index.id).agg(F.first("_reached").alias("_reached"), F.sum("weight").alias("_hits"), F.max("bound").alias("bound"))
    enough = F.col("_reached").isNull() | (F.col("_hits") + F.coalesce("_missed", F.lit(0.0)) + F.col("bound") + 1e-3 >= F.col("_reached"))
    return scored(found.join(passed, question_id, "left").filter(enough).select(question_id, index.id))


def scan(objects: DataFrame, object_id: str, text_terms: str, name_terms: str, questions: DataFrame, question_id: str, terms: str, completed: Callable[[DataFrame], DataFrame], top_n: int = ranking.TOP_N, name_weight: float = ranking.NAME_WEIGHT) -> DataFrame:
    """What search() gives, by one pass over the objects (arrays of distinct terms) and no index.

    If objects are partitioned by their id and the questions' terms fit a broadcast,
    hits are counted where an object lies, and only the best top_n of a task leave it.
    """
    held = F.concat(*[F.transform(F.col(c), lambda x: F.struct(x.alias("_term"), F.lit(n).alias("_name"), F.lit(1 - n).alias("_text"))) for c, n in ((name_terms, 1), (text_terms, 0))])  # noqa: B023
    asked = questions.select(question_id, F.explode(terms).alias("_term"))
    met = objects.select(object_id, F.explode(held).alias("_h")).select(object_id, "_h.*").join(asked, "_term")
    hits = met.groupBy(question_id, object_id).agg(F.sum("_name").alias("name_hits"), F.sum("_text").alias("text_hits"))
    return ranking.rank_text(completed(hits), question_id, object_id, top_n, name_weight=name_weight)
