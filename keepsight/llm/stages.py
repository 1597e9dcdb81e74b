"""What the decisions of operators do to a table of documents.

Rows are told apart by doc_id and text, so neither repeated ids nor repeated
rows confuse a stage, and every column of the table passes through whatever its
name. A text moves only where the list of rows that go is too long to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsight.llm.exactdedup import exact_dedup
from keepsight.llm.mixing import mix_sources
from keepsight.llm.quality import base_measures, cascade_order, rules
from keepsight.llm.simhash import simhash_components
from keepsight.llm.tables import Table


def wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_key and the whole row as `row`."""
    return docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def pass_quality(docs: DataFrame) -> DataFrame:
    """Documents that the base and every rule pass."""
    conditions = rules()
    order = cascade_order(docs.select("text"), conditions)
    rejected = F.when(F.col("base_failed"), True)
    for name in order:
        rejected = rejected.when(conditions[name], True)
    return base_measures(wrapped(docs)).filter(rejected.isNull()).select("row.*")


def one_of_each(docs: DataFrame, decisions: DataFrame, group: str) -> DataFrame:
    """One document of each group: that with the smallest doc_id (null last), then the smallest text_key. decisions: group, doc_id, text_key."""
    best = decisions.groupBy(group).agg(F.min(F.struct(F.col("doc_id").isNull().alias("a"), "doc_id", "text_key")).alias("w")).select("w.doc_id", "w.text_key").withColumn("wins", F.lit(True))
    best = Table(best, "winners").read()
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_key") == F.col(f"{b}.text_key"))
    counted = decisions.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).alias("c").join(best.alias("b"), same("c", "b"), "left")
    out = Table(counted.select("c.doc_id", "c.text_key", "n", F.coalesce("wins", F.lit(False)).alias("wins")).filter("n > 1 or not wins"), "going").read()
    rows = wrapped(docs).drop("text")
    stay = rows.alias("d").join(out.alias("o"), same("d", "o"), "left_anti").select("row.*")
    again = out.filter("wins")
    if again.isEmpty():
        return stay
    return stay.union(rows.alias("d").join(again.alias("o"), same("d", "o"), "left_semi").dropDuplicates(["doc_id", "text_key"]).select("row.*"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    return one_of_each(docs, Table(exact_dedup(docs), "exact-decisions").read(), "text_sha256")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    return one_of_each(docs, Table(simhash_components(docs), "near-decisions").read(), "label")


def mixed(docs: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it; of the document at a source's cut, the last copy has the words up to it, and n_chars (if there) follows.

    Rows of one doc_id, text and source are one document with what the mix
    takes of all of them. Other texts move once, to the row that says how often
    they are taken.
    """
    key = ["doc_id", "text_key", "source"]
    took = mix_sources(docs).groupBy(*key).agg(F.count("*").alias("n"), F.max("size").alias("size"), F.sum("taken").alias("taken"))
    took = Table(took.filter("n > 1 or taken > 0"), "taken").read()
    rows = wrapped(docs).withColumn("source", F.col("row.source"))
    same = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("d.text_key") == F.col("t.text_key")) & F.col("d.source").eqNullSafe(F.col("t.source"))
    meets = lambda d, t: d.alias("d").join(t.filter("taken > 0").alias("t"), same).select("row", "text", "size", "taken")
    found = meets(rows, took.filter("n = 1"))
    repeated = took.filter("n > 1")
    if not repeated.isEmpty():
        found = found.union(meets(rows.alias("d").join(repeated.alias("t"), same, "left_semi").dropDuplicates(key), repeated))
    part = (F.col("taken") % F.col("size")).cast("int")
    words = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")  # each with the white space after it; white space before the first is by itself
    cut = F.regexp_replace(F.array_join(F.slice(words, 1, part + F.col("text").rlike(r"^[\x20\x09-\x0D]").cast("int")), ""), r"[\x20\x09-\x0D]+$", "")
    whole = found.select("row", "text", "size", "taken", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))).alias("copy"))
    out = whole.select("row", F.when(F.col("copy") * F.col("size") <= F.col("taken"), F.col("text")).otherwise(cut).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])
