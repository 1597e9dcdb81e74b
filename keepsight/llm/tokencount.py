"""Token counts by a two-tier lookup on the map side (operator 8).

The SentencePiece model never joins characters across the start of a run of
spaces, so a text's count is the sum over its pre-tokens, each a run of spaces
with the characters up to the next one. Tier one is a broadcast table of the
token counts of frequent pre-tokens; tier two is a cache in each worker, filled
by encoding what the table misses. The frequent ones are those of a bounded
random sample of documents, counted in one place; no pre-token of a text is
ever shuffled. Which pre-tokens the table holds changes only how fast a text is
counted.

Defined cases: null text is empty and has no tokens; texts of any length are
counted whole; special strings inside texts are ordinary text; a null doc_id
stays null; repeated rows each get an output row; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from keepsight.llm.tables import own_columns, worker_state

MODEL, MAX_TOKENS = "piece_bpe_32k.model", 4096
#: Bounds of the broadcast table: entries, and characters of each.
TABLE_WORDS, TABLE_CHARS = 32_768, 40
#: Expected documents of the sample that frequent pre-tokens are taken from.
SAMPLE_DOCS = 4000
#: Entries of a worker's cache.
CACHE_WORDS = 300_000
SPACES = re.compile(" +[^ ]*")


def pretokens(text: str) -> list[str]:
    """Pre-tokens of a text, each without its first space; the text itself has one before it."""
    if "  " not in text and text[:1] != " ":
        return text.split(" ")
    return [x[1:] for x in SPACES.findall(" " + text)]


def frequent_pretokens(texts: DataFrame, sample_docs: int = SAMPLE_DOCS, most: int = TABLE_WORDS) -> list[str]:
    """The most frequent pre-tokens of a random sample of the texts. The sample (bounded by its parameters) is counted by one task, which gives at most `most` words."""
    total = texts.count()
    if not total:
        return []
    sample = texts.sample(min(1.0, sample_docs / total), seed=8).repartition(1)

    def count(batches):
        counts = Counter()
        for batch in batches:
            for text in batch.column("text"):
                counts.update(pretokens(text.as_py() or ""))
        words = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if 0 < len(w) <= TABLE_CHARS][:most]
        yield pa.RecordBatch.from_pydict({"word": words}, schema=pa.schema([("word", pa.string())]))

    return [r["word"] for r in sample.mapInArrow(count, "word string").collect()]


class Lengths(dict):
    """Tokens of a pre-token: the broadcast table, then what this worker has met."""

    def __init__(self, model, frequent: dict[str, int]):
        super().__init__(frequent)
        self.model, self.most = model, len(frequent) + CACHE_WORDS

    def __missing__(self, word: str) -> int:
        n = len(self.model.encode(word)) if word else 1
        if len(self) < self.most and len(word) < 64:
            self[word] = n
        return n


def load_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def count_batches(path: str, frequent, max_tokens: int):
    name = uuid.uuid4().hex  # of this table in the workers

    def run(batches):
        state = worker_state()
        if state.get("lengths", (None,))[0] != (path, name):  # one table for each worker: that of the latest query
            state["lengths"] = (path, name), Lengths(load_model(path), frequent.value)
        lengths = state["lengths"][1]
        for batch in batches:
            sizes, counts = [], []
            for text in batch.column("text"):
                t = text.as_py() or ""
                sizes.append(len(t.encode()))
                counts.append(0 if not t else len(lengths.model.encode(t)) if "▁" in t else sum(map(lengths.__getitem__, pretokens(t))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > max_tokens for n in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_tokens, over_limit."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    texts = own_columns(docs, ["doc_id", "text"])
    words, model = frequent_pretokens(texts.select("text")), load_model(path)
    frequent = docs.sparkSession.sparkContext.broadcast(dict(zip(words, map(len, model.encode(words)), strict=True)) if words else {})
    return texts.mapInArrow(count_batches(path, frequent, max_tokens), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
