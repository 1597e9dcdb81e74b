"""The generic tables as recordings: what stands in for observations, boxes, labels and questions.

Every stand-in is given twice, as a DataFrame and as SQL, so a query and its
oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsight.functions.geometry import box, point


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: an object is a user, a frame an hour."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    rows = e.select(
        F.lit("c").alias("clip"), F.col("event_id").alias("pos"), F.col("user_id").alias("id"), F.col("event_type").alias("tag"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time_s"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("frame"),
        F.col("value").alias("score"), k.alias("k"), (F.col("value") / 100).alias("x"), (k / 50).alias("y"), ((F.col("event_id") % 7) / 10.0).cast("double").alias("z"),
        k.alias("x1"), (F.col("event_id") % 50).cast("double").alias("y1"),
    )
    rows = rows.withColumns({"x2": F.col("x1") + 20 + F.col("pos") % 40, "y2": F.col("y1") + 30 + F.col("id") % 20})
    return rows.withColumns({"cam": point(F.col("x"), F.col("y"), F.col("z")), "box": box(*map(F.col, ("x1", "y1", "x2", "y2")))})


OBS_SQL = """
obs0 AS (
  SELECT 'c' AS clip, event_id AS pos, user_id AS id, event_type AS tag, epoch_us(ts) / 1e6 AS time_s,
         floor(epoch_us(ts) / 3.6e9)::BIGINT AS frame, value AS score, regexp_extract(props, '([0-9]+)', 1)::DOUBLE AS k,
         value / 100 AS x, regexp_extract(props, '([0-9]+)', 1)::DOUBLE / 50 AS y, (event_id % 7)::DOUBLE / 10 AS z,
         regexp_extract(props, '([0-9]+)', 1)::DOUBLE AS x1, (event_id % 50)::DOUBLE AS y1
  FROM events),
obs AS (SELECT *, x1 + 20 + pos % 40 AS x2, y1 + 30 + id % 20 AS y2 FROM obs0)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points in space."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")])


POINTS_SQL = "pts AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
