"""Removal of repeated byte strings by suffix arrays of shards (operator 12).

A window is a string of WIDTH bytes. It is filed under its minimizer, the
GRAM bytes in it of least hash (leftmost of equals), so equal windows share a
file whatever document or task they are in; the windows next to each other that
share a minimizer make one string of at most WIDTH + WIDTH - GRAM bytes. What
may be common is reduced in the task: of equal strings the first stays, the
others are removed at once. A file with two or more different strings is cut
from the texts and put into a shard, whose suffix array is sorted by induction
(suffixarray.py); windows with a common prefix of WIDTH are equal, and all but
the first of them are removed.

A minimizer seen in many documents of a bounded random sample has its windows
filed one by one, under their own bytes, and so has a file of more than
MAX_STRINGS different strings. Neither loses an equality; both keep a shard and
a task small. Texts move once to be cut and once to be hashed.

Defined cases: null text is empty; a text shorter than a window keeps all its
bytes; documents go by doc_id (null last), then by the XXH64 of their text, so
of rows with equal doc_id and text one is first and the others are later copies
of it; a text of any length is read in blocks; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsight.llm.suffixarray import equal_windows
from keepsight.llm.tables import Table, own_columns, text_key

# Fixed value of the contract: a repeated string has so many bytes.
WIDTH = 100

GRAM = 32
#: Different strings of a file, and bytes of a shard that whole files are gathered into.
MAX_STRINGS, SHARD_BYTES = 4096, 1 << 20
#: Windows read at once of a text.
BLOCK = 1 << 20
#: Expected documents of the sample, and in how many of them a minimizer is a frequent one. They never change a result.
SAMPLE_DOCS, FREQUENT = 2000, 20

PLACE = "doc_id long, text_key long, start long, n long"
PLACES = pa.schema([(name, pa.int64()) for name in ("doc_id", "text_key", "start", "n")])
NOTHING = hashlib.sha256(b"").hexdigest()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def joined(a: np.ndarray, b: np.ndarray, salt: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hashes of strings from the hashes of their two parts."""
    return mixed(a * np.uint64(salt) + b)


def gram_and_window_hashes(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the GRAM (32) and WIDTH (100) bytes from each position on."""
    h, powers, size = table[data], {}, 1
    while size <= WIDTH:
        powers[size] = h
        h = joined(h[:-size], h[size:])
        size *= 2
    whole, at = None, 0
    for bit in (64, 32, 4):
        part = powers[bit][at : at + len(data) - WIDTH + 1]
        whole, at = part if whole is None else joined(whole, part), at + bit
    return powers[GRAM], whole


def window_strings(text: bytes, table: np.ndarray):
    """(minimizer, hash of the string, start, windows, window hashes from its block, block start) of the strings of a text, a block at a time."""
    across = WIDTH - GRAM + 1
    low = np.uint64((1 << 21) - 1)  # more than the positions of a block
    for lo in range(0, len(text) - WIDTH + 1, BLOCK):
        data = np.frombuffer(text, np.uint8)[lo : lo + BLOCK + WIDTH - 1]
        grams, windows = gram_and_window_hashes(data, table)
        least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        size = 1
        while 2 * size <= across:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        rest = across - size
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        at = (least & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        n = np.diff(np.r_[first, len(at)])
        yield grams[at[first]], joined(joined(windows[first], windows[first + n - 1]), n.astype(np.uint64)), first, n, windows, lo


def sampled_minimizers(batches):
    """For mapInArrow over (text): each distinct minimizer of each text."""
    table = byte_table()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if parts := [s[0] for s in window_strings((text or "").encode(), table)]:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(parts)).view(np.int64))], names=["file"])


def frequent_minimizers(docs: DataFrame, sample_docs: int, frequent: int) -> np.ndarray:
    """Minimizers of at least `frequent` of about sample_docs documents, sorted: at most a `frequent`-th of the sample's."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    found = docs.select("text").sample(share, 1).mapInArrow(sampled_minimizers, "file long").groupBy("file").count().filter(F.col("count") >= frequent).select("file").collect()
    return np.sort(np.array([r["file"] for r in found], np.int64).view(np.uint64))


FILED = pa.schema([("file", pa.int64()), ("string", pa.int64()), ("gone", pa.bool_()), ("no_id", pa.bool_()), *PLACES])
FILED_SQL = f"file long, string long, gone boolean, no_id boolean, {PLACE}"


def filed(frequent: np.ndarray):
    """For mapInArrow over (doc_id, text): the task's strings, the first of equal ones under its file; the later ones, joined where they touch, as gone."""

    def run(batches):
        table, seen, docs = byte_table(), set(), []
        columns: list[list[np.ndarray]] = [[] for _ in range(5)]
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                key = (doc is None, doc or 0, text_key(text))
                if key in seen or len(text or "") * 4 < WIDTH:
                    continue
                seen.add(key)
                for file, string, first, n, windows, lo in window_strings(text.encode(), table):
                    hot = np.isin(file, frequent) if len(frequent) else np.zeros(len(file), bool)
                    if hot.any():
                        each = np.repeat(first[hot], n[hot]) + np.arange(n[hot].sum()) - np.repeat(np.cumsum(n[hot]) - n[hot], n[hot])
                        file, string, first, n = (np.concatenate(x) for x in ((file[~hot], windows[each]), (string[~hot], joined(windows[each], windows[each], 0xA0761D6478BD642F)), (first[~hot], each), (n[~hot], np.ones(len(each), np.int64))))
                    for column, x in zip(columns, (file, string, np.full(len(file), len(docs)), first + lo, n), strict=True):
                        column.append(x)
                docs.append(key)
        if not columns[0]:
            return
        file, string, doc, start, n = map(np.concatenate, columns)
        columns.clear()
        rank = np.empty(len(docs), np.int64)
        rank[sorted(range(len(docs)), key=docs.__getitem__)] = np.arange(len(docs))
        order = np.lexsort((start, rank[doc], string, file))
        later = np.zeros(len(order), bool)
        a, b = order[1:], order[:-1]
        later[a] = (file[a] == file[b]) & (string[a] == string[b])
        gone = np.flatnonzero(later)
        gone = gone[np.lexsort((start[gone], doc[gone]))]
        opens = np.r_[True, (doc[gone[1:]] != doc[gone[:-1]]) | (start[gone[1:]] > (start + n)[gone[:-1]])] if len(gone) else np.zeros(0, bool)
        heads, closes = gone[opens], gone[np.r_[opens[1:], True]] if len(gone) else gone
        keep = np.concatenate([np.flatnonzero(~later), heads])
        n[heads] = start[closes] + n[closes] - start[heads]
        file[heads] = mixed(joined(start[heads].astype(np.uint64), doc[heads].astype(np.uint64)))  # anywhere
        no_id, ids, keys = (np.array(x) for x in zip(*docs, strict=True))
        for at in range(0, len(keep), 100_000):
            k = keep[at : at + 100_000]
            d = doc[k]
            yield pa.RecordBatch.from_arrays([pa.array(file[k].view(np.int64)), pa.array(string[k].view(np.int64)), pa.array(later[k]), pa.array(no_id[d]), pa.array(ids[d].astype(np.int64), mask=no_id[d]), pa.array(keys[d].astype(np.int64)), pa.array(start[k]), pa.array(n[k])], schema=FILED)

    return run


FOUND = pa.schema([*PLACES, ("file", pa.int64()), ("alone", pa.bool_())])
FOUND_SQL = f"{PLACE}, file long, alone boolean"


def strings_to_compare(most: int):
    """For mapInArrow over filed strings sorted by file, string and place: gone ones (file null), and those of files with different strings.

    The strings of a file with more than `most` are marked alone. A file is held
    up to that many rows; beyond, its rows pass through one batch at a time.
    """
    names = FILED.names

    def rows(c: dict, pick: np.ndarray, file, alone) -> pa.RecordBatch:
        place = [pa.array(c["doc_id"][pick], mask=c["no_id"][pick]), *[pa.array(c[x][pick]) for x in PLACES.names[1:]]]
        return pa.RecordBatch.from_arrays([*place, pa.array(c["file"][pick], mask=~file[pick]), pa.array(alone[pick])], schema=FOUND)

    def judge(c: dict, before: tuple | None):
        """before: file, string and place of the row before these, if their first file is passing through."""
        file, string = c["file"], c["string"]
        if not len(file):
            return
        gone = c["gone"]
        new_file = np.r_[True, file[1:] != file[:-1]]
        new = new_file | np.r_[True, string[1:] != string[:-1]]
        places = [c[x] for x in ("no_id", "doc_id", "text_key", "start")]
        same_place = np.r_[False, np.logical_and.reduce([x[1:] == x[:-1] for x in places])] & ~new
        number = np.cumsum(new_file) - 1
        n = np.bincount(number, weights=new & ~gone)[number]
        alone = n > most
        if before is not None:
            passing = number == 0
            n[passing], alone[passing] = most + 1, True
            if before[1] == string[0]:
                new[0], same_place[0] = False, before[2] == tuple(x[0] for x in places)
        compare = new & (n > 1) & ~gone
        pick = np.flatnonzero(gone | compare | (~new & ~same_place))
        if len(pick):
            yield rows(c, pick, compare, alone & compare)

    def last_row(c: dict) -> tuple:
        return c["file"][-1], c["string"][-1], tuple(c[x][-1] for x in ("no_id", "doc_id", "text_key", "start"))

    def run(batches):
        held, before = None, None
        for batch in batches:
            c = {name: (x.fill_null(0) if name == "doc_id" else x).to_numpy(zero_copy_only=False) for name, x in zip(names, batch.columns, strict=True)}
            if not batch.num_rows:
                continue
            if held is not None:
                c = {name: np.concatenate([held[name], c[name]]) for name in names}
            split = int(np.searchsorted(c["file"], c["file"][-1]))  # where the last file starts
            head, held = ({name: x[part] for name, x in c.items()} for part in (slice(0, split), slice(split, None)))
            if split:
                yield from judge(head, before if before is not None and before[0] == head["file"][0] else None)
                before = before if before is not None and before[0] == held["file"][0] else None
            if len(held["file"]) > most:
                mark = last_row(held)
                yield from judge(held, before if before is not None else (held["file"][0], None, None))
                held, before = None, mark
        if held is not None:
            yield from judge(held, before)

    return run


CUT = pa.schema([("file", pa.int64()), ("alone", pa.bool_()), ("bytes", pa.binary()), ("no_id", pa.bool_()), *PLACES])
CUT_SQL = f"file long, alone boolean, bytes binary, no_id boolean, {PLACE}"


def cut(batches):
    """For mapInArrow over (doc_id, text_key, text, strings): the bytes of each string; of one marked alone, each window."""
    for batch in batches:
        for doc, key, text, strings in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "text_key", "text", "strings")), strict=True):
            b, out = text.encode(), []
            for s in strings:
                start, n = s["start"], s["n"]
                if s["alone"]:
                    out += [(s["file"], True, b[i : i + WIDTH], i, 1) for i in range(start, start + n)]
                else:
                    out.append((s["file"], False, b[start : start + n + WIDTH - 1], start, n))
            for at in range(0, len(out), 20_000):
                file, alone, pieces, starts, ns = zip(*out[at : at + 20_000], strict=True)
                k = len(file)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((file, alone, pieces, [doc is None] * k, [doc] * k, [key] * k, starts, ns), CUT.types, strict=True)], schema=CUT)


def shards(batches):
    """For mapInArrow over cut strings sorted by file: the windows of a file that equal an earlier one, by the suffix arrays of shards of whole files."""

    def repeated(strings: list[tuple]) -> pa.RecordBatch:
        strings = list({s[:4]: s for s in strings}.values())  # a repeated row cuts a string twice
        owner, offset, group = equal_windows([s[4] for s in strings], WIDTH)
        docs = sorted({s[:3] for s in strings})
        rank = {d: i for i, d in enumerate(docs)}
        doc, start = np.array([rank[s[:3]] for s in strings], np.int64), np.array([s[3] for s in strings], np.int64)
        at = start[owner] + offset
        order = np.lexsort((at, doc[owner], group))
        later = np.zeros(len(order), bool)
        later[order[1:]] = group[order[1:]] == group[order[:-1]]
        gone = np.flatnonzero(later)
        opens = np.r_[True, (owner[gone[1:]] != owner[gone[:-1]]) | (at[gone[1:]] != at[gone[:-1]] + 1)] if len(gone) else np.zeros(0, bool)
        heads = gone[opens]
        n = np.diff(np.r_[np.flatnonzero(opens), len(gone)])
        of = [docs[i] for i in doc[owner[heads]].tolist()]
        return pa.RecordBatch.from_arrays([pa.array([None if d[0] else d[1] for d in of], pa.int64()), pa.array([d[2] for d in of], pa.int64()), pa.array(at[heads]), pa.array(n.astype(np.int64))], schema=PLACES)

    whole, size, file, strings = [], 0, None, []
    for batch in batches:
        for f, b, no_id, doc, key, start in zip(*(batch.column(x).to_pylist() for x in ("file", "bytes", "no_id", "doc_id", "text_key", "start")), strict=True):
            if f != file:
                whole += strings
                strings, file = [], f
                if size >= SHARD_BYTES:
                    yield repeated(whole)
                    whole, size = [], 0
            strings.append((no_id, doc or 0, key, start, b))
            size += len(b)
    if whole or strings:
        yield repeated(whole + strings)


KEPT = pa.schema([("pid", pa.int64()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
KEPT_SQL = "pid long, nth long, doc_id long, text_key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def spans(gone: list[dict] | None) -> list[list[int]]:
    """Maximal runs of bytes covered by runs of windows."""
    out: list[list[int]] = []
    for start, n in sorted((g["start"], g["n"]) for g in gone or ()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + n + WIDTH - 1)
        else:
            out.append([start, start + n + WIDTH - 1])
    return out


def without(text: bytes, removed: list[list[int]]) -> bytes:
    edges = [0, *[x for span in removed for x in span], len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def kept(batches):
    """For mapInArrow over (doc_id, text_key, text, gone): what stays of each text; nth counts equal rows in the task."""
    pid, nth = TaskContext.get().partitionId(), {}
    for batch in batches:
        out = []
        for doc, key, text, gone in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "text_key", "text", "gone")), strict=True):
            b, removed = text.encode(), spans(gone)
            nth[doc, key] = nth.get((doc, key), -1) + 1
            out.append((pid, nth[doc, key], doc, key, len(b), sum(e - s for s, e in removed), len(removed), hashlib.sha256(without(b, removed)).hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), KEPT.types, strict=True)], schema=KEPT)


def per_document(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """A written table of (doc_id, text_key) and the list of its rows as `name`."""
    return Table(rows.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(*columns)).alias(name)), name).read()


def with_list(texts: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    on = (texts["text_key"] == lists["text_key"]) & texts["doc_id"].eqNullSafe(lists["doc_id"])
    return texts.join(lists, on, how).drop(lists["doc_id"], lists["text_key"])


def repeated_places(docs: DataFrame, texts: DataFrame, most: int, sample_docs: int, frequent: int) -> DataFrame:
    """(doc_id, text_key, start, n): runs of n windows that equal earlier ones."""
    order = ["file", "string", "no_id", "doc_id", "text_key", "start"]
    rows = docs.mapInArrow(filed(frequent_minimizers(docs, sample_docs, frequent)), FILED_SQL)
    found = Table(rows.repartition("file").sortWithinPartitions(*order).mapInArrow(strings_to_compare(most), FOUND_SQL), "strings").read()
    wanted = per_document(found.filter("file is not null"), "strings", "start", "n", "file", "alone")
    pieces = Table(with_list(texts, wanted, "inner").select("doc_id", "text_key", "text", "strings").mapInArrow(cut, CUT_SQL), "cut-strings").read()
    by_shard = pieces.filter("not alone").select("file", "bytes", "no_id", "doc_id", "text_key", "start").repartition("file").sortWithinPartitions("file").mapInArrow(shards, PLACE)
    gone = found.filter("file is null").select(*PLACES.names).unionByName(by_shard)
    alone = pieces.filter("alone")
    if not alone.isEmpty():
        place = F.struct("no_id", "doc_id", "text_key", "start")
        firsts = Table(alone.groupBy("bytes").agg(F.min(place).alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies"), "first-windows").read()
        gone = gone.unionByName(alone.join(firsts, "bytes").filter(~F.col("first").eqNullSafe(place)).select(*PLACES.names))
    return gone


def suffix_dedup(docs: DataFrame, most: int = MAX_STRINGS, sample_docs: int = SAMPLE_DOCS, frequent: int = FREQUENT) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = own_columns(docs, ["doc_id", "text"])
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    gone = per_document(repeated_places(docs, texts, most, sample_docs, frequent), "gone", "start", "n")
    results = Table(with_list(texts, gone, "left").select("doc_id", "text_key", "text", "gone").mapInArrow(kept, KEPT_SQL), "kept").read()
    again = Table(results.groupBy("doc_id", "text_key").agg(F.count("*").alias("copies"), F.min("pid").alias("least")).filter("copies > 1").drop("copies"), "repeated-rows").read()
    whole = F.col("least").isNotNull() & ((F.col("pid") != F.col("least")) | (F.col("nth") > 0)) & (F.col("n_bytes") >= WIDTH)
    r = with_list(results, again, "left")
    return r.select("doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(whole, 1).otherwise(F.col("n_spans")).cast("long").alias("n_spans"), F.when(whole, NOTHING).otherwise(F.col("kept_sha256")).alias("kept_sha256"))


#: Every window by itself, as hex digits.
SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS o, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT o, i, md5_number(substr(x, 2 * i + 1, 200)) AS h FROM (SELECT o, x, unnest(range(0, len(x) // 2 - 99)) AS i FROM d)),
g AS (
  SELECT o, i FROM (SELECT o, i, row_number() OVER (PARTITION BY h ORDER BY o, i) AS k FROM w) WHERE k > 1),
r AS (SELECT o, i, coalesce(i - lag(i) OVER (PARTITION BY o ORDER BY i), 101) AS gap FROM g),
runs AS (
  SELECT o, run, min(i) AS a, max(i) + 100 AS b FROM (SELECT o, i, sum(CASE WHEN gap > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY o ORDER BY i) AS run FROM r) GROUP BY o, run),
k AS (SELECT o, a, b, coalesce(lag(b) OVER (PARTITION BY o ORDER BY a), 0) AS from_byte FROM runs),
t AS (
  SELECT d.o, any_value(doc_id) AS doc_id, any_value(x) AS x, count(k.a) AS n_spans, coalesce(sum(k.b - k.a), 0)::BIGINT AS n_removed, coalesce(max(k.b), 0) AS rest,
         coalesce(string_agg(substr(x, 2 * from_byte + 1, 2 * (a - from_byte)), '' ORDER BY a), '') AS before
  FROM d LEFT JOIN k USING (o) GROUP BY d.o)
SELECT doc_id, len(x) // 2 AS n_bytes, n_removed, n_spans, sha256(unhex(before || substr(x, 2 * rest + 1))) AS kept_sha256
FROM t
"""
