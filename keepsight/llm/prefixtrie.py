"""Conversations as a trie of shared beginnings (operator 13).

Texts are read once: a turn becomes a 128-bit code of its role and text, and
the text's length. Conversations are then rebuilt (those that share a beginning
get it from the first of their hundred), equal ones become one sequence, and
sequences are hash-partitioned by the digest of their first turn. A first-turn
subtree of more than MAX_SEQUENCES sequences is partitioned again by the next
turn, what is still too large by two more turns, then four, and so on. Buckets
of small subtrees are built as pointer tries of dictionaries inside
applyInPandas, and summed from the last node made to the first, which is a
postorder without recursion. The few nodes above the subtrees (the root, and
those through which the large ones were split) are sums over subtrees, combined
in the tasks; what such a node adds to those above it goes along one of its
members' paths.

The ids of the conversations that end at a node are hashed in a stream: runs of
ids from a range sort, then one row for each run, so that the copies of one
conversation are never held in memory. One conversation is one row, of 40 bytes
for each of its turns, the only thing that a task holds whole.

Defined cases: turns of one number go by code, so repeated rows stay next to
each other; a null turn number is first; null role or text is empty; rows
without conv_id belong to no conversation; ids below zero share the beginning
of conversation c - c % 100 with the sign of c in the remainder; a conversation
without turns ends at the root; an empty table has no node, not even a root;
texts may be of any length; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsight.llm.tables import Table, own_columns

# Fixed values of the contract: who shares a beginning with whom, and how many turns of it at most.
FAMILY, SHARES = 100, 6

#: Sequences of a subtree that is built in one piece, and ids of a run that is hashed at once.
MAX_SEQUENCES, MAX_RUN = 512, 65_536
NO_IDS = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) of every rebuilt conversation; a turn is its code and size."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    code = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn", code.alias("code"), F.length(text).cast("long").alias("size"))
    each = own_columns(conversations, ["conv_id", "turn", "role", "text"]).filter("conv_id is not null").select("conv_id", turn.alias("t"))
    ordered = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["code"].alias("code"), t["size"].alias("size")))
    own = Table(each.groupBy("conv_id").agg(ordered.alias("turns")), "conversations").read()
    first = own.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.slice("turns", 1, SHARES - 1).alias("start"))
    c = own.withColumns({"family": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARES).cast("int")})
    start = F.coalesce(F.slice("start", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return c.join(first, "family", "left").select("conv_id", F.concat(start, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def prefix_key(codes: Column, depth) -> Column:
    return F.sha2(F.array_join(F.slice(codes, 1, depth), ""), 256)


RUNS = pa.schema([("seq", pa.string()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])


def id_runs(batches):
    """For mapInArrow over (seq, conv_id) sorted by both: runs of the ids of a sequence, joined by commas."""
    seq, ids = None, []
    for batch in batches:
        out = []
        for s, i in zip(batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (s != seq or len(ids) == MAX_RUN):
                out.append((seq, ids[0], len(ids), ",".join(map(str, ids))))
                ids = []
            seq = s
            ids.append(i)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), RUNS.types)], schema=RUNS)
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (seq, ids[0], len(ids), ",".join(map(str, ids)))], schema=RUNS)


def run_hashes(batches):
    """For mapInArrow over runs sorted by (seq, conv_id): of each sequence its smallest conv_id, number of conversations, and the digest of their ids."""
    schema = pa.schema([("conv_id", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])
    seq = None
    for batch in batches:
        out = []
        for s, i, k, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if s == seq:
                n += k
                digest.update(b"," + ids.encode())
            else:
                if seq is not None:
                    out.append((first, n, digest.hexdigest()))
                seq, first, n, digest = s, i, k, hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=schema)
    if seq is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (first, n, digest.hexdigest())], schema=schema)


def sequences(conversations: DataFrame) -> DataFrame:
    """Distinct rebuilt conversations: conv_id (the smallest), n, ends, codes, sizes."""
    every = rebuilt(conversations).select("conv_id", F.col("turns.code").alias("codes"), F.col("turns.size").alias("sizes"))
    every = Table(every.withColumn("seq", prefix_key(F.col("codes"), F.size("codes"))), "rebuilt").read()
    order = ["seq", "conv_id"]
    runs = every.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(id_runs, "seq string, conv_id long, n long, ids string")
    hashed = runs.repartition("seq").sortWithinPartitions(*order).mapInArrow(run_hashes, "conv_id long, n long, ends string")
    return Table(Table(hashed, "ends").read().join(every.drop("seq"), "conv_id"), "sequences").read()


def subtrees(seqs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Sequences under the key of a subtree of at most `most` of them, and those that end above all such subtrees.

    Both have path (keys) and path_sizes: the nodes above the key, from the root
    on, and for the second kind their own last node too.
    """
    up_to = lambda depth: {"path": F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), depth), lambda m: prefix_key(F.col("codes"), m))), "path_sizes": F.concat(F.array(F.lit(0).cast("long")), F.slice("sizes", F.lit(1), depth))}
    at_root = {"path": F.array(F.lit("")), "path_sizes": F.array(F.lit(0).cast("long"))}
    rows = seqs.filter(F.size("codes") > 0).withColumns({"depth": F.lit(1), "key": prefix_key(F.col("codes"), 1), **at_root})
    small, above, step = [], [seqs.filter(F.size("codes") == 0).withColumns({"depth": F.lit(0), "key": F.lit(""), **at_root})], 1
    while True:
        crowded = Table(rows.groupBy("key").count().filter(F.col("count") > most).select("key"), "crowded-subtrees").read()
        if crowded.isEmpty():
            small.append(rows)
            break
        small.append(rows.join(crowded, "key", "left_anti"))
        left = Table(rows.join(crowded, "key", "left_semi"), "crowded-sequences").read()
        n, deeper = F.size("codes"), F.col("depth") + step
        above.append(left.filter(n < deeper).withColumns({"depth": n, "key": prefix_key(F.col("codes"), n), **up_to(n)}))
        rows = left.filter(n >= deeper).withColumns({"depth": deeper, "key": prefix_key(F.col("codes"), deeper), **up_to(deeper - 1)})
        step *= 2
    whole = lambda parts: Table(_union(parts), "subtree-rows").read()
    return whole(small), whole(above)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def tries(pdf: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a bucket's subtrees; a subtree's top has its key and path, and no parent yet."""
    conv, depth, parent, count, size, ends, kids, tops = [], [], [], [], [], [], [], {}

    def node(d: int, s: int, up: int) -> int:
        for column, value in ((conv, None), (depth, d), (parent, up), (count, 0), (size, s), (ends, NO_IDS), (kids, {})):
            column.append(value)
        return len(conv) - 1

    for key, d, c, n, e, codes, sizes, path, path_sizes in zip(*(pdf[x] for x in ("key", "depth", "conv_id", "n", "ends", "codes", "sizes", "path", "path_sizes"))):
        if key not in tops:
            tops[key] = node(d, int(sizes[d - 1]), -1), list(path), list(map(int, path_sizes))
        at = tops[key][0]
        for i in range(d, len(codes) + 1):
            count[at] += n
            conv[at] = c if conv[at] is None else min(c, conv[at])
            if i == len(codes):
                ends[at] = e
            elif (below := kids[at].get(codes[i])) is not None:
                at = below
            else:
                at = kids[at].setdefault(codes[i], node(i + 1, int(sizes[i]), at))
    leaves, saved = [0] * len(conv), [0] * len(conv)
    for at in range(len(conv) - 1, -1, -1):  # a node is made after its parent
        leaves[at] += not kids[at]
        saved[at] += (count[at] - 1) * size[at]
        if (up := parent[at]) >= 0:
            leaves[up] += leaves[at]
            saved[up] += saved[at]
    out = pd.DataFrame({"conv_id": conv, "depth": depth, "parent_conv_id": pd.array([conv[p] if p >= 0 else None for p in parent], "Int64"), "n_convs": count, "n_children": [len(k) for k in kids], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends})
    marks = {at: (key, path, path_sizes) for key, (at, path, path_sizes) in tops.items()}
    for i, name in enumerate(("key", "path", "path_sizes")):
        out[name] = pd.Series([marks[at][i] if at in marks else None for at in range(len(conv))], dtype=object)
    return out


def upper_nodes(tops: DataFrame, above: DataFrame) -> DataFrame:
    """key, parent and the columns of a node, for every node above the subtrees."""
    ending = above.select(F.concat(F.lit("end "), "key").alias("member"), "path", "path_sizes", "conv_id", F.col("n").alias("n_convs"), F.lit(0).alias("n_leaves"), F.lit(0).alias("saved_tokens"), "ends")
    members = tops.select(F.col("key").alias("member"), "path", "path_sizes", "conv_id", "n_convs", "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends")).unionByName(ending)
    members = Table(members, "members").read()
    on_path = members.select("*", F.posexplode(F.arrays_zip("path", "path_sizes")).alias("depth", "at"))
    last = F.col("depth") == F.size("path") - 1
    grouped = on_path.withColumns({"key": F.col("at.path"), "parent": F.get("path", F.col("depth") - 1), "size": F.col("at.path_sizes"), "ends": F.when(last, F.col("ends"))}).groupBy("key")
    nodes = grouped.agg(F.first("depth").cast("long").alias("depth"), F.first("parent").alias("parent"), F.first("size").alias("size"), F.min("member").alias("member"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "saved_tokens")], F.max("ends").alias("ends"))
    nodes = Table(nodes, "upper-nodes").read()
    parents = tops.select(F.element_at("path", -1).alias("key")).unionByName(nodes.filter("parent is not null").select(F.col("parent").alias("key")))
    known = Table(nodes.join(parents.groupBy("key").agg(F.count("*").alias("n_children")), "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "upper-children").read()
    # What a node itself adds to its subtree goes to all nodes from it up to the root, along the path of one member.
    own = known.select("member", "depth", ((F.col("n_convs") - 1) * F.col("size")).alias("saves"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    added = own.join(members.select("member", "path"), "member").select("saves", "leaf", F.explode(F.slice("path", F.lit(1), F.col("depth").cast("int") + 1)).alias("key")).groupBy("key").agg(F.sum("saves").alias("saves"), F.sum("leaf").alias("leaf"))
    return known.join(added, "key").select("key", "parent", "conv_id", "depth", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved_tokens") + F.col("saves")).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, most: int = MAX_SEQUENCES) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    small, above = subtrees(sequences(conversations), most)
    buckets = max(small.count() // (2 * most) + 1, int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    built = small.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInPandas(tries, f"{NODES}, key string, path array<string>, path_sizes array<long>")
    nodes = Table(built, "trie-nodes").read()
    tops = nodes.filter("key is not null")
    upper = Table(upper_nodes(tops, above), "upper").read()
    names = [c.split()[0] for c in NODES.split(", ")]
    root = upper.filter("parent is null").select("conv_id").first()
    unlinked = tops.withColumn("parent", F.element_at("path", -1)).select(*names, "parent").unionByName(upper.select(*[c for c in names if c != "parent_conv_id"], "parent").withColumn("parent_conv_id", F.lit(None).cast("long")))
    ups = upper.filter("parent is not null").select(F.col("key").alias("parent"), F.col("conv_id").alias("up"))
    linked = unlinked.join(ups, "parent", "left").withColumn("parent_conv_id", F.when(F.col("parent") == "", F.lit(root["conv_id"] if root else None)).otherwise(F.col("up")))
    return nodes.filter("key is null").select(*names).unionByName(linked.select(*names))


#: Prefixes as strings of codes; CRC-32 by its table.
SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS tab),
own AS (
  SELECT conv_id, list({'code': code, 'size': size} ORDER BY turn NULLS FIRST, code) AS turns
  FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS size,
               substr(sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS code
        FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
h AS (
  SELECT conv_id, turns, conv_id - conv_id % 100 AS family,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                         lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 6 AS h
  FROM own, crc),
re AS (
  SELECT h.conv_id, list_concat(coalesce(own.turns[1:h], []), h.turns[h + 1:]) AS turns
  FROM h LEFT JOIN own ON own.conv_id = h.family),
s AS (SELECT conv_id, len(turns) AS n, list_aggregate(list_prepend('', list_transform(turns, lambda t: t.code)), 'string_agg', '') AS codes, list_prepend(0, list_transform(turns, lambda t: t.size)) AS sizes FROM re),
m AS (SELECT conv_id, n, left(codes, 32 * d::INT) AS node, d, sizes[d + 1] AS size FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM s)),
nodes AS (
  SELECT node, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saves,
         sha256(coalesce(string_agg(CASE WHEN n = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM m GROUP BY node),
kids AS (SELECT left(node, 32 * (depth - 1)::INT) AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
k AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (node)),
up AS (
  SELECT left(node, 32 * j::INT) AS node, sum(saves)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS j FROM k) GROUP BY 1)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, up.n_leaves, up.saved_tokens, k.ends_sha256
FROM k JOIN up USING (node) LEFT JOIN nodes p ON k.depth > 0 AND p.node = left(k.node, 32 * (k.depth - 1)::INT)
"""
