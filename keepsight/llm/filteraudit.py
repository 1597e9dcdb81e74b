"""How five filters interact: every order of them, replayed on every document (operator 11).

One pass over the texts gives each document its part and five failure flags, by
built-in functions. The table of flags, without texts, is crossed with the 120
orders, which are a broadcast table of fixed size; each document and order gets
the step at which the document first fails, is exploded into its five steps,
and conditional counts over (part, order, step) are combined in the task before
anything moves: 600 rows for each part leave a task, however many documents it
holds.

Whether a smaller doc_id has the same text is found from digests: of a digest
that several rows share, one row with its smallest doc_id meets the rows of it,
in a join of two plain exchanges that adaptive execution can split.

Defined cases: null text is empty, and fails A alone (and E, where a smaller
doc_id has an empty text too); null lang is the part ''; a null doc_id is after
every other one, so its text is a copy where any row with an id has it, and it
has no labels; rows of one doc_id are no copies of each other; of repeated
label rows of a doc_id any that says 1 counts, null says nothing; repeated
documents each count; a very long text costs one task the memory of its words;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsight.llm.quality import words_of
from keepsight.llm.tables import Table, own_columns

FILTERS = "ABCDE"
# Fixed values of the contract: the limits of filters A, B and C, and the characters of D.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, SYMBOLS = 200, 50, 3, "[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def own_flags(text: Column) -> list[Column]:
    """Whether a text fails A, B, C and D."""
    words = F.filter(words_of(text), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [n < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * n, 100 * upper > MAX_UPPER_PERCENT * F.length(text), text.rlike(SYMBOLS)]


def document_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each document: part, flags (bit i for the i-th filter), good, toxic."""
    text = F.coalesce("text", F.lit(""))
    bits = sum((F.when(fails, F.lit(1 << i)).otherwise(0) for i, fails in enumerate(own_flags(F.col("text")))), F.lit(0))
    texts = own_columns(docs, ["doc_id", "text", "lang"]).select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    seen = Table(texts.select("doc_id", "part", bits.alias("bits"), F.unhex(F.sha2("text", 256)).alias("digest")), "filter-flags").read()
    copies = seen.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).filter("n > 1 and least is not null")
    copies = Table(copies.select("digest", "least"), "copied-texts").read()
    marks = own_columns(labels, ["doc_id", "quality", "toxic"]).filter("doc_id is not null").groupBy("doc_id")
    marks = Table(marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).filter("good = 1 or toxic = 1"), "marks").read()
    both = seen.join(copies, "digest", "left").join(marks, "doc_id", "left")
    copy = F.col("least").isNotNull() & (F.col("doc_id").isNull() | (F.col("least") < F.col("doc_id")))
    said = lambda c: F.coalesce(F.col(c) == 1, F.lit(False)).alias(c)
    return both.select("part", (F.col("bits") + F.when(copy, F.lit(1 << FILTERS.index("E"))).otherwise(0)).alias("flags"), said("good"), said("toxic"))


def orders(spark: SparkSession) -> DataFrame:
    """The 120 orders: filter_order and the bit of the filter at each step."""
    rows = [("".join(p), *[1 << FILTERS.index(x) for x in p]) for p in permutations(FILTERS)]
    return spark.createDataFrame(rows, "filter_order string, " + ", ".join(f"bit{s} int" for s in range(1, len(FILTERS) + 1)))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step: how many documents the step keeps and removes, and what that costs.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley.
    """
    replayed = document_flags(docs, labels).crossJoin(F.broadcast(orders(docs.sparkSession)))
    first = F.lit(len(FILTERS) + 1)  # the step after the last: the document passes
    for s in range(len(FILTERS), 0, -1):
        first = F.when(F.col("flags").bitwiseAND(F.col(f"bit{s}")) != 0, s).otherwise(first)
    steps = F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.col(f"bit{s}").alias("bit")) for s in range(1, len(FILTERS) + 1)])).alias("at")
    each = replayed.withColumn("first", first).select("part", "filter_order", "flags", "good", "toxic", "first", steps).select("*", "at.*").drop("at")
    now, failing = F.col("first") == F.col("step"), F.col("flags").bitwiseAND(F.col("bit")) != 0
    wanted = [F.col("first") > F.col("step"), now, failing & (F.col("first") < F.col("step")), F.col("flags") == F.col("bit"), now & F.col("good"), now & F.col("toxic")]
    counts = Table(each.groupBy("part", "filter_order", "step").agg(*[F.count_if(c).alias(name) for name, c in zip(COUNTS, wanted, strict=True)]), "replayed").read()
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    shares = counts.groupBy("part", letter.alias("letter")).agg(F.sum("removed").alias("shapley"))
    return counts.withColumn("letter", letter).join(shares, ["part", "letter"]).select("part", "filter_order", "step", *COUNTS, "shapley")


#: By patterns of failed filters instead of by document.
SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text),
          regexp_matches(text, '[#$%&*|]'), least IS NOT NULL AND (m.doc_id IS NULL OR least < m.doc_id)] AS fails
  FROM m LEFT JOIN l USING (doc_id)),
p AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f GROUP BY ALL),
one AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS q FROM one a, one b, one c, one d, one e
  WHERE a.i NOT IN (b.i, c.i, d.i, e.i) AND b.i NOT IN (c.i, d.i, e.i) AND c.i NOT IN (d.i, e.i) AND d.i <> e.i),
r AS (
  SELECT part, q, s.i AS step, q[s.i] AS x, n, n_good, n_toxic, fails[q[s.i]] AS failing, list_bool_or(list_transform(q[1:s.i - 1], lambda y: fails[y])) AS before,
         failing AND len(list_filter(fails, lambda y: y)) = 1 AS alone
  FROM p, o, one s),
c AS (
  SELECT part, list_aggregate(list_transform(q, lambda y: chr(64 + y)), 'string_agg', '') AS filter_order, step, x,
         sum(CASE WHEN NOT coalesce(before, false) AND NOT failing THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN NOT coalesce(before, false) AND failing THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN coalesce(before, false) AND failing THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN NOT coalesce(before, false) AND failing THEN n_good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN NOT coalesce(before, false) AND failing THEN n_toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM r GROUP BY part, q, step, x)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM c
"""
