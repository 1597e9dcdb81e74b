"""Readers of JSON documents and files as flat tables, and the stage sinks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from keepsight.operators.sets import still_to_do
from keepsight.sources.schemas import DOCUMENTS

# Where a video comes from by its name, tried in order, and what makes positions metric.
SOURCE_PATTERNS = [
    ("ego4d", r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(-\d+)?$"), ("epic", r"^P\d\d_\d+$"), ("egolife", r"^egolife_"),
    ("egolife_raw", r"^D\d-P\d"), ("scannet", r"^scene0"), ("numeric5", r"^\d{5}$"),
]
METRIC_SOURCES = ["wilddet3d_pair_lsq", "da3_metric"]


def read_documents(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """JSON documents of a kind, one row each with their file as `path`; a missing file is an empty table, as the feature is off."""
    try:
        return spark.read.schema(DOCUMENTS[kind]).json(path, multiLine=True).withColumn("path", F.input_file_name())
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], DOCUMENTS[kind] + ", path STRING")


def world_position() -> Column:
    """The first of the two world positions that isn't empty."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    return F.coalesce(some("world_egoloc"), some("world_vggt"))


def observations(objects: DataFrame) -> DataFrame:
    """One row for each trajectory point of an object document; world is the first of its two positions."""
    points = objects.select("path", "id", "primary_tag", F.posexplode("trajectory").alias("pos", "o"))
    return points.select("path", "id", F.col("primary_tag").alias("tag"), "pos", "o.*").withColumn("world", world_position())


def episodes(relations: DataFrame) -> DataFrame:
    return relations.select("path", F.posexplode("episodes").alias("pos", "e")).select("path", "pos", "e.*")


def questions(documents: DataFrame) -> DataFrame:
    return documents.select("path", "dataset", F.posexplode("questions").alias("pos", "q")).select("path", "dataset", "pos", "q.*")


def multiple_choice(qa: DataFrame) -> DataFrame:
    """Questions with options in key order and the index of the right one; those without are dropped."""
    keys = F.array_sort(F.map_keys("options"))
    ok = qa.filter((F.size("options") > 0) & F.array_contains(F.map_keys("options"), F.col("answer_label")))
    kind = F.coalesce(F.nullif("subcategory", F.lit("")), F.nullif("category", F.lit("")), F.lit("unknown"))
    return ok.withColumns({"choices": F.transform(keys, lambda k: F.try_element_at("options", k)), "correct_idx": (F.array_position(keys, F.col("answer_label")) - 1).cast("int"), "type": kind})


def scene_titles(annotations: DataFrame) -> DataFrame:
    """Sorted distinct object titles of each clip."""
    sets = annotations.select(F.inline("clips")).select("clip_uid", F.explode("annotations").alias("a")).select("clip_uid", F.explode("a.query_sets").alias("k", "q"))
    return sets.groupBy("clip_uid").agg(F.array_sort(F.collect_set("q.object_title")).alias("titles"))


def response_tracks(annotations: DataFrame) -> DataFrame:
    """Frames of each annotated response, by clip and title."""
    sets = annotations.select(F.inline("clips")).select("clip_uid", F.posexplode("annotations").alias("n", "a")).select("clip_uid", "n", F.explode("a.query_sets").alias("k", "q"))
    return sets.groupBy("clip_uid", F.col("q.object_title").alias("title")).agg(F.collect_list(F.struct("n", "k", F.col("q.response_track").alias("track"))).alias("tracks"))


def source_of(video: Column) -> Column:
    found = F.lit("other")
    for name, pattern in reversed(SOURCE_PATTERNS):
        found = F.when(video.rlike(pattern), name).otherwise(found)
    return found


def is_metric(scale_source: Column) -> Column:
    return F.coalesce(scale_source.isin(METRIC_SOURCES), F.lit(False))


def segment_frames(stride_s: Column, seconds: float = 8.0) -> Column:
    """Frames that an object must stay away for to start a segment; rounds half to even."""
    return F.greatest(F.lit(1), F.bround(seconds / stride_s).cast("int") + 1)


def lift_budgets(n_frames: Column) -> Column:
    budget = F.greatest(F.lit(400), 12 * n_frames)
    return F.struct(budget.alias("scene"), F.greatest(F.lit(25), F.floor(n_frames / 4).cast("int")).alias("per_tag"))


def grid_frames(n_frames: Column, clip_ratio: Column, stride: int, max_frames: int) -> Column:
    """Frames of a clip at a stride, evenly thinned to max_frames, as an array in order; a long clip's are counted, never listed."""
    from keepsight.functions.sequences import even_indices

    last = F.floor(n_frames / clip_ratio) - 1
    count = F.when(last >= 0, F.floor(last / stride) + 1).otherwise(0)
    # Bound to a name of the inner lambda: else each element would count anew.
    return F.element_at(F.transform(F.array(count), lambda n: F.transform(even_indices(n, max_frames), lambda i: i.cast("long") * stride)), 1)


def sampling_grid(clips: DataFrame, stride: int = 40, max_frames: int = 1200) -> DataFrame:
    """Frames of each clip (clip_uid, n_frames, clip_ratio) at a stride, evenly thinned to max_frames."""
    return clips.withColumn("clip_frame", F.explode(grid_frames(F.col("n_frames"), F.col("clip_ratio"), stride, max_frames)))


def work_list(spec: str, catalog: list[str]) -> list[str]:
    """'all', or a comma-separated list; empty entries don't count."""
    return catalog if spec == "all" else [x for x in map(str.strip, spec.split(",")) if x]


def write_stage(df: DataFrame, path: str, partition: str = "clip_uid") -> None:
    """Writes the partitions that df has and leaves others as they are, so a stage can go on where it stopped."""
    df.write.option("partitionOverwriteMode", "dynamic").partitionBy(partition).mode("overwrite").parquet(path)


def commit_stage(df: DataFrame, path: str, partition: str = "clip_uid", attempts: int = 20) -> int:
    """Writes the partitions that df has as a new version of a table of committed versions, and gives the version's number.

    Files are staged in a folder of their own. A version is a manifest, one line
    for each partition: its folder's number and the folder it stands in. It
    becomes visible by one rename to a name that must not exist yet, so readers see
    all of a version or none of it, and a writer that dies leaves the old version as
    it was. Of two writers the slower takes the next number, on top of the other's
    partitions; where both wrote a partition, the later commit's stays. The store
    must refuse to rename onto a name that exists, as HDFS does.
    """
    spark = df.sparkSession
    new = f"data-{uuid.uuid4().hex}"
    kinds = df.schema[partition].dataType
    df.withColumn("_part", F.col(partition)).write.partitionBy("_part").parquet(f"{path}/{new}")
    fresh = {r[0]: new for r in df.sparkSession.read.parquet(f"{path}/{new}").select(F.col("_part").cast(kinds).cast("string")).distinct().collect()}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(conf)
    for _ in range(attempts):
        version, parts = committed(spark, path)
        staged = hadoop(f"{path}/{new}/manifest-{uuid.uuid4().hex}")
        out = fs.create(staged, False)
        out.write(bytearray(json.dumps(sorted((parts | fresh).items(), key=repr)).encode()))
        out.close()
        final = hadoop(f"{path}/version-{version + 1:09d}.json")
        if not fs.exists(final) and fs.rename(staged, final):
            return version + 1
        fs.delete(staged, False)
    raise RuntimeError(f"other writers were faster {attempts} times")


def committed(spark: SparkSession, path: str) -> tuple[int, dict[str | None, str]]:
    """The last committed version of a table and the folder of each of its partitions; (0, {}) without one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(s.getPath().getName() for s in fs.globStatus(hadoop(f"{path}/version-*.json")) or [])
    if not found:
        return 0, {}
    text = spark.read.text(f"{path}/{found[-1]}", wholetext=True).first()[0]
    return int(found[-1][8:-5]), {k: folder for k, folder in json.loads(text)}


def read_stage(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The last committed version of a table of commit_stage(), or an earlier one; empty without one. What no version names isn't read."""
    last, parts = committed(spark, path)
    if version is not None and version != last:
        text = spark.read.text(f"{path}/version-{version:09d}.json", wholetext=True).first()[0]
        parts = {k: folder for k, folder in json.loads(text)}
    folders: dict[str, list] = {}
    for key, folder in parts.items():
        folders.setdefault(folder, []).append(key)
    out = spark.createDataFrame([], schema)
    names = out.columns
    for folder, keys in folders.items():
        rows = spark.read.schema(f"{schema}, _part string").parquet(f"{path}/{folder}")
        named = F.col("_part").isin([k for k in keys if k is not None])
        out = out.unionByName(rows.filter(named | F.col("_part").isNull() if None in keys else named).select(*names))
    return out


def remaining(todo: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Units of todo that a stage's table doesn't hold yet."""
    try:
        return still_to_do(todo, todo.sparkSession.read.parquet(path), keys)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return todo


def checked_metadata(videos: DataFrame, fps: float, tolerance: float = 0.05) -> DataFrame:
    """Video metadata (clip, width, height, n_frames, fps), and off_rate where the frame rate isn't the one expected. A dimension table: cache it where many stages read it."""
    return videos.withColumn("off_rate", F.abs(F.col("fps") - fps) > tolerance)


def grid_spec(clips: DataFrame, stride: int = 40, max_frames: int = 1200) -> DataFrame:
    """The grid document of each clip (clip_uid, n_frames, clip_ratio, fps): its frames in order, their number in the video, rate, ratio and source."""
    frames = grid_frames(F.col("n_frames"), F.col("clip_ratio"), stride, max_frames)
    return clips.select("clip_uid", F.col("n_frames").alias("N"), "fps", F.col("clip_ratio").cast("int").alias("clip_ratio"), source_of(F.col("clip_uid")).alias("source"), frames.alias("grid_clip_frames"))


def empty_truth(clips: DataFrame) -> DataFrame:
    """Ground truth of recordings that have none: no objects and no names."""
    return clips.select("clip_uid", F.array().cast("array<bigint>").alias("objects"), F.array().cast("array<string>").alias("names"))
