"""Exact deduplication by content-defined chunk recipes (operator 9).

One pass over the text normalises white space, cuts each text at
content-defined boundaries and makes its recipe, the ordered list of its
chunks. Inside a task chunks are known by SHA-256 digest and texts are equal
when their recipes are; each distinct recipe leaves the task once. Across tasks
chunk keys become verified identifiers: a 64-bit key stands for a chunk only as
long as a single digest is known for it; where two digests share a key, each
gets an ordinal. Texts are equal when their ordered identifier lists are equal.
Only recipes, digests and ids move; no text does.

Verification compares digests (256 bits) rather than bytes, as comparing bytes
would move the whole corpus once.

Defined cases: null text counts as empty; empty texts are equal to each other
and differ from a text of white space only; a null doc_id sorts after every
other one; of rows that share a group's smallest doc_id one stays, the first of
the first task that has one; repeated rows each get an output row; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsight.llm.tables import Table, answer_groups, own_columns, text_key

SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
MIN_CHUNK, MAX_CHUNK, MASK_BITS = 512, 16384, 11


def gear_table() -> np.ndarray:
    """256 pseudo-random 32-bit numbers by the splitmix rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


def normalised(text: str | None) -> bytes:
    """UTF-8 of the text with each run of ASCII white space as one space."""
    b = (text or "").encode().translate(SPACES)
    while b"  " in b:
        b = b.replace(b"        ", b" ").replace(b"   ", b" ").replace(b"  ", b" ")
    return b


def cuts(b: bytes, gear: np.ndarray) -> list[int]:
    """Ends of the chunks of b. A boundary depends on the 16 bytes before it, so equal passages are cut alike."""
    n = len(b)
    if n <= MIN_CHUNK:
        return [n] if n else []
    h = gear[np.frombuffer(b, np.uint8)]
    for step in (1, 2, 4, 8):
        h = h[step:] + (h[:-step] << np.uint32(step))
    ends, last = [], 0
    for e in (np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 16).tolist():
        while e - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if e - last >= MIN_CHUNK and e < n:
            ends.append(e)
            last = e
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    return [*ends, n]


def recipes(key_bits: int = 64):
    """For mapInArrow over (doc_id, text): a row for each document; the first of each distinct recipe of the task carries it."""
    import xxhash

    gear, mask = gear_table(), (1 << key_bits) - 1

    def run(batches):
        pid, seen, known, number = TaskContext.get().partitionId(), {}, {}, 0
        for batch in batches:
            rows = {name: [] for name in SCHEMA.names}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                b = normalised(text)
                start, digests = 0, []
                for end in cuts(b, gear):
                    digests.append(hashlib.sha256(b[start:end]).digest())
                    start = end
                recipe = array("Q", [known.setdefault(d, len(known)) for d in digests]).tobytes()
                if (lid := seen.get(recipe)) is None:
                    lid, start, keys = seen.setdefault(recipe, len(seen)), 0, []
                    for end in cuts(b, gear):
                        key = xxhash.xxh3_64_intdigest(b[start:end]) & mask
                        keys.append(key - (1 << 64) if key >> 63 else key)
                        start = end
                else:
                    keys = digests = None
                for name, value in zip(rows, (pid, number, lid, doc, text_key(text), hashlib.sha256(b).hexdigest(), keys, digests), strict=True):
                    rows[name].append(value)
                number += 1
            yield pa.RecordBatch.from_pydict(rows, schema=SCHEMA)

    return run


SCHEMA = pa.schema([("pid", pa.int64()), ("row", pa.int64()), ("lid", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("text_sha256", pa.string()), ("keys", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary()))])
SQL_SCHEMA = "pid long, row long, lid long, doc_id long, text_key long, text_sha256 string, keys array<long>, digests array<binary>"


def exact_dedup(docs: DataFrame, key_bits: int = 64) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256, text_key (XXH64 of the text as it is).

    Of equal texts one row with the smallest doc_id is kept.
    """
    t = Table(own_columns(docs, ["doc_id", "text"]).mapInArrow(recipes(key_bits), SQL_SCHEMA), "recipes").read()
    leaders = t.filter("keys is not null").select("pid", "lid", "keys", "digests")
    chunks = leaders.select(F.explode(F.arrays_zip("keys", "digests")).alias("c")).select("c.keys", "c.digests").distinct()
    shared = Table(chunks.groupBy("keys").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("digests")).alias("digests")).filter("n > 1"), "shared-keys").read()
    if shared.isEmpty():  # every key has one digest: keys are identifiers as they stand
        ids = leaders.select("pid", "lid", F.col("keys").alias("recipe"))
    else:
        ranked = shared.select("keys", F.posexplode("digests").alias("ordinal", "digests"))
        each = leaders.select("pid", "lid", F.posexplode_outer(F.arrays_zip("keys", "digests")).alias("pos", "c")).select("pid", "lid", "pos", "c.keys", "c.digests")
        found = each.join(ranked, ["keys", "digests"], "left").groupBy("pid", "lid").agg(F.array_sort(F.collect_list(F.struct("pos", "keys", F.coalesce("ordinal", F.lit(0)).cast("long").alias("ordinal")))).alias("c"))
        ids = found.select("pid", "lid", F.when(F.col("c")[0]["pos"].isNotNull(), F.flatten(F.transform("c", lambda x: F.array(x["keys"], x["ordinal"])))).otherwise(F.array().cast("array<long>")).alias("recipe"))
    ids = Table(ids, "identifier-lists").read()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "pid", "row"))
    local = t.groupBy("pid", "lid").agg(first.alias("first"), F.count("*").alias("n"))
    groups = Table(ids.join(local, ["pid", "lid"]).groupBy("recipe").agg(F.min("first").alias("first"), F.sum("n").alias("group_size")), "groups").read()
    found = answer_groups(ids, groups, ["recipe"], ["first", "group_size"])
    kept = (F.col("first.pid") == F.col("pid")) & (F.col("first.row") == F.col("row"))
    return t.join(found, ["pid", "lid"]).select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", "text_key")
