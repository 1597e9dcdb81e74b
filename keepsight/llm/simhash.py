"""SimHash near-duplicates with pigeonring filtering (operator 1).

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word
shingles. Fingerprints that differ in few bits are linked, and documents get
the component of their fingerprint.

Candidates come from the pigeonring principle. The 64 bits are four segments on
a ring; two fingerprints within 3 bits have a start segment from which every
chain of l segments differs in at most l*3/4 bits: 0, then 1, 2 and 3. So they
agree in the start segment and in three of the four nibbles of the next one,
and each fingerprint is filed under 16 keys of 28 bits. A key with too many
fingerprints is refined along the ring (two nibbles of the third segment, one
of the fourth, then five of eight groups of the bits left), which bounds every
bucket by 512 distinct fingerprints at the last level and loses no pair.
Inside a bucket the chain sums are checked before the full Hamming distance,
and what is emitted is a path through each set of linked fingerprints, never
its pairs.

Defined cases: null and wordless texts have fingerprint zero, which is linked
like any other; a text of fewer words than a shingle has one shingle of all of
them; the component of documents without any doc_id is null; repeated rows each
get an output row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsight.llm.components import connected_components
from keepsight.llm.tables import Table, answer_groups, own_columns, text_key

SHINGLE, HASH_SEED, MAX_BITS = 3, 42, 3
#: Fingerprints that one bucket may hold before its key is refined.
MAX_BUCKET = 4096
FULL = (1 << 64) - 1


def fingerprint(text: str | None, byte_bits: np.ndarray, shingle: int = SHINGLE, seed: int = HASH_SEED) -> int:
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n).view(np.uint8).reshape(-1, 8)
    value = 0
    for j in range(8):
        ones = np.bincount(h[:, j], minlength=256) @ byte_bits
        value |= int(((2 * ones > n) << np.arange(8)).sum()) << 8 * j
    return value


def byte_bit_table() -> np.ndarray:
    return (np.arange(256)[:, None] >> np.arange(8)) & 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


ROWS = pa.schema([("pid", pa.int64()), ("lid", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.int64()), ("leads", pa.bool_()), ("least", pa.int64())])


def fingerprints(batches):
    """For mapInArrow over (doc_id, text): pid, lid (the fingerprint's number in the task), doc_id, fp; leads: the first row of each fingerprint has its smallest doc_id."""
    pid, bits = TaskContext.get().partitionId(), byte_bit_table()
    docs, fps, texts = [], [], []
    for batch in batches:
        docs += batch.column("doc_id").to_pylist()
        for t in batch.column("text"):
            fps.append(fingerprint(t.as_py(), bits))
            texts.append(text_key(t.as_py()))
    if not docs:
        return
    least: dict[int, int | None] = {}
    for doc, fp in zip(docs, fps, strict=True):
        old = least.setdefault(fp, doc)
        if doc is not None and (old is None or doc < old):
            least[fp] = doc
    number = {fp: i for i, fp in enumerate(least)}
    led: set[int] = set()
    for at in range(0, len(docs), 20_000):
        rows = {name: [] for name in ROWS.names}
        for doc, fp, key in zip(*(x[at : at + 20_000] for x in (docs, fps, texts)), strict=True):
            for name, value in zip(rows, (pid, number[fp], doc, key, signed(fp), fp not in led, least[fp]), strict=True):
                rows[name].append(value)
            led.add(fp)
        yield pa.RecordBatch.from_pydict(rows, schema=ROWS)


def segment(i: int, nibbles: tuple[int, ...] = (0, 1, 2, 3)) -> int:
    return sum(0xF << 16 * (i % 4) + 4 * j for j in nibbles)


def ring_masks(level: int) -> list[tuple[int, int]]:
    """(start segment, mask) of the variants of each level; those of a variant v at the next level have numbers from v times their count."""
    masks = [(i, segment(i) | segment(i + 1, keep)) for i in range(4) for keep in combinations(range(4), 3)]
    if level >= 1:
        masks = [(i, m | segment(i + 2, keep)) for i, m in masks for keep in combinations(range(4), 2)]
    if level >= 2:
        masks = [(i, m | segment(i + 3, (keep,))) for i, m in masks for keep in range(4)]
    if level >= 3:
        out = []
        for i, m in masks:
            free = [b for b in range(64) if not m >> b & 1]
            groups = [sum(1 << b for b in free[k : k + 3]) for k in range(0, 24, 3)]
            out += [(i, m | sum(keep)) for keep in combinations(groups, 5)]
        masks = out
    return masks


LEVELS = (16, 6, 4, 56)


def linked(fps: np.ndarray, start: int) -> list[np.ndarray]:
    """Sets of two or more linked fingerprints of a bucket, found by breadth-first search with chain sums checked first."""
    turned = (fps >> np.uint64(16 * start)) | (fps << np.uint64((64 - 16 * start) % 64)) if start else fps
    left, found = np.arange(len(fps)), []
    while len(left) > 1:
        group, queue, left = [left[0]], [left[0]], left[1:]
        while queue and len(left):
            x = turned[left] ^ turned[queue.pop()]
            near = np.bitwise_count(x & np.uint64(0xFFFFFFFF)) <= 1
            near &= np.bitwise_count(x & np.uint64(0xFFFFFFFFFFFF)) <= 2
            near &= np.bitwise_count(x) <= MAX_BITS
            new = left[near]
            group += new.tolist()
            queue += new.tolist()
            left = left[~near]
        if len(group) > 1:
            found.append(fps[np.array(group)])
    return found


def bucket_paths(starts: list[int]):
    """For mapInArrow over (variant, key, fp) sorted by all three: edges (a, b) along each set of linked fingerprints."""
    start_of = np.array(starts)

    def run(batches):
        kept = None
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def edges(v, k, f):
            change = np.flatnonzero((np.diff(v) != 0) | (np.diff(k) != 0)) + 1
            lo = np.concatenate([[0], change])
            hi = np.concatenate([change, [len(v)]])
            a, b = [], []
            for s, e in zip(lo[hi - lo > 1].tolist(), hi[hi - lo > 1].tolist(), strict=True):
                for path in linked(f[s:e].view(np.uint64), int(start_of[v[s]])):
                    ids = np.sort(path.view(np.int64)).tolist()
                    a += ids[:-1]
                    b += ids[1:]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

        for batch in batches:
            v, k, f = (np.asarray(batch.column(i)) for i in range(3))
            if kept is not None:
                v, k, f = (np.concatenate(x) for x in zip(kept, (v, k, f), strict=True))
            if not len(v):
                continue
            last = int(np.flatnonzero((v != v[-1]) | (k != k[-1]))[-1]) + 1 if (v[0], k[0]) != (v[-1], k[-1]) else 0
            kept = v[last:], k[last:], f[last:]
            if last:
                yield edges(v[:last], k[:last], f[:last])
        if kept is not None:
            yield edges(*kept)

    return run


def filed(rows: DataFrame, level: int, variant=None) -> DataFrame:
    """(variant, key, fp): under the keys of level 0, or refined from those of the level before."""
    masks = ring_masks(level)
    if level == 0:
        keys = F.array(*[F.struct(F.lit(v).alias("variant"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for v, (_, m) in enumerate(masks)])
    else:
        table = F.array(*[F.lit(signed(m)) for _, m in masks])
        keys = F.transform(F.sequence(F.lit(0), F.lit(LEVELS[level] - 1)), lambda c: F.struct((F.col("variant") * LEVELS[level] + c).alias("variant"), F.col("fp").bitwiseAND(F.element_at(table, F.col("variant") * LEVELS[level] + c + 1)).alias("key")))
    return rows.select("fp", F.explode(keys).alias("x")).select("x.variant", "x.key", "fp")


def similar_edges(nodes: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Edges (a, b) that connect exactly those of the distinct fingerprints fp that links connect."""
    edges, rows = None, filed(nodes, 0)
    for level in range(len(LEVELS)):
        crowded = None
        if level < len(LEVELS) - 1:
            full = Table(rows.groupBy("variant", "key").count().filter(F.col("count") > max_bucket).select("variant", "key"), "crowded").read()
            if not full.isEmpty():
                crowded = Table(rows.join(full, ["variant", "key"], "left_semi"), "crowded-rows").read()
                rows = rows.join(full, ["variant", "key"], "left_anti")
        paths = rows.repartition("variant", "key").sortWithinPartitions("variant", "key", "fp").mapInArrow(bucket_paths([i for i, _ in ring_masks(level)]), "a long, b long")
        edges = paths if edges is None else edges.union(paths)
        if crowded is None:
            break
        rows = filed(crowded, level + 1)
    return Table(edges.distinct(), "edges").read()


def simhash_components(docs: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """A row for each document: doc_id, fingerprint, component_id, label (of the component, never null), text_key (XXH64 of the text)."""
    t = Table(own_columns(docs, ["doc_id", "text"]).mapInArrow(fingerprints, "pid long, lid long, doc_id long, text_key long, fp long, leads boolean, least long"), "fingerprints").read()
    leaders = t.filter("leads")
    nodes = Table(leaders.groupBy("fp").agg(F.min("least").alias("least")), "nodes").read()
    labels = connected_components(similar_edges(nodes.select("fp"), max_bucket))
    labelled = Table(nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "labelled").read()
    smallest = Table(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "components").read()
    of_fp = Table(labelled.join(smallest, "label").select("fp", "component_id", "label"), "fp-components").read()
    found = answer_groups(leaders, of_fp, ["fp"], ["component_id", "label"])
    return t.join(found, ["pid", "lid"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "label", "text_key")
