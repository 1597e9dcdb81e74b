"""Best-fit packing of documents into sequences (operator 5).

One pass tokenises each text, cuts what is longer than a sequence and numbers
each piece among those of its length in its task. The plan needs the counts of
each length only, at most one for each possible length (binpack). A piece finds
its sequence from its number among all pieces of its length: that of its task's
first one, by prefix sums over (length, task), and its own. So no length, however
common, is one task's work, and neither texts nor ids are moved.

Defined cases: null text is empty, and an empty text is the end id alone; a
null doc_id stays null; repeated rows are packed each; an empty table gives no
rows; further columns are ignored; a text of any length is cut whole.
"""

from __future__ import annotations

import base64
import logging
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsight.llm.binpack import NODE_LIMIT, Plan, pack
from keepsight.llm.tables import Table, own_columns, worker_state

MAX_TOKENS, END_ID = 1024, 2
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}
#: Words whose ids a worker keeps.
CACHE_WORDS = 300_000


class Unsplittable(Exception):
    """A text with white space that the pattern of the tokenizer may join across single spaces."""


class WordIds(dict):
    """Ids, as little-endian bytes, of a space and a word after it."""

    def __init__(self, encode, prefix: str = " "):
        self.encode, self.prefix = encode, prefix

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise Unsplittable
        ids = self.encode(self.prefix + word)
        if len(self) < CACHE_WORDS and len(word) < 64:
            self[word] = ids
        return ids


class Tokenizer:
    """Ids of the tokenizer file, as little-endian bytes.

    No piece of the byte-level pattern reaches over a single space between two
    other characters, so such a text is the join of its words, each cached. The
    words themselves are encoded from the same vocabulary given as ranks, and by
    the tokenizer itself where they hold characters beyond Latin ones; texts
    that can't be split like this go to the tokenizer whole.
    """

    def __init__(self, path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken
        import tokenizers

        self.whole = tokenizers.Tokenizer.from_file(path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        self.heads, self.words = WordIds(self.piece, ""), WordIds(self.piece)

    def piece(self, text: str) -> bytes:
        ids = self.ranks.encode(text, allowed_special="all") if max(text) < "ɐ" else self.whole.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        head, *rest = text.split(" ")
        try:
            return (self.heads[head] if head else b"") + b"".join(map(self.words.__getitem__, rest))
        except Unsplittable:
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()


def logged(plan: Plan) -> None:
    logging.getLogger(__name__).info("packed into %d sequences, %d above the lower bound, after %d nodes", plan.bins, plan.gap, plan.nodes)


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("pid", pa.int64()), ("slot", pa.int64())])


def cut_pieces(paths: tuple[str, str], capacity: int, end_id: int):
    """For mapInArrow over (doc_id, text): the pieces of each document; slot numbers those of a length in this task."""

    def run(batches):
        state = worker_state()
        if ("tokenizer", paths) not in state:
            state["tokenizer", paths] = Tokenizer(*paths)
        encode, end = state["tokenizer", paths], array("I", [end_id]).tobytes()
        pid, slots = TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = {name: [] for name in PIECES.names}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                starts = [0, *range(n % capacity or capacity, n, capacity)]
                for piece, (start, stop) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    slot = slots.get(stop - start, 0)
                    slots[stop - start] = slot + 1
                    for name, value in zip(rows, (doc, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]), pid, slot), strict=True):
                        rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema=PIECES)

    return run


def placements(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first number, first sequence, pieces for each sequence and first offset of each run of pieces."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    numbers: dict[int, int] = {}
    sequence = 0
    for filling, times in plan:
        offset = 0
        for n in sorted(set(filling), reverse=True):
            each = filling.count(n)
            runs.setdefault(n, []).append((numbers.get(n, 0), sequence, each, offset))
            numbers[n] = numbers.get(n, 0) + each * times
            offset += n * each
        sequence += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for n, r in runs.items()}


def place(runs: dict[int, tuple[np.ndarray, ...]]):
    """For mapInArrow over the pieces and their numbers: sequence_id and offset."""

    def run(batches):
        for batch in batches:
            length, number = np.asarray(batch.column("length")), np.asarray(batch.column("number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                own = length == n
                first, seq, each, start = runs[n]
                r = np.searchsorted(first, number[own], "right") - 1
                at = number[own] - first[r]
                sequence[own], offset[own] = seq[r] + at // each[r], start[r] + at % each[r] * n
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, paths: tuple[str, str] | None = None, capacity: int = MAX_TOKENS, end_id: int = END_ID, node_limit: int | None = NODE_LIMIT, report: Callable[[Plan], None] = logged) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    node_limit bounds the search for a plan (None: until no plan can be better);
    report is told the plan with its gap to the lower bound.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, pid long, slot long"
    pieces = Table(own_columns(docs, ["doc_id", "text"]).mapInArrow(cut_pieces(paths or tokenizer_paths(), capacity, end_id), schema), "pieces").read()
    in_task = pieces.groupBy("length", "pid").agg((F.max("slot") + 1).alias("n"))
    earlier = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    firsts = Table(in_task.select("length", "pid", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")), "piece-numbers").read()
    counts = {r["length"]: r["n"] for r in firsts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    numbered = pieces.join(firsts.select("length", "pid", "first"), ["length", "pid"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("slot")).alias("number"))
    plan = pack(counts, capacity, node_limit)
    report(plan)
    return numbered.mapInArrow(place(placements(plan.fillings)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
