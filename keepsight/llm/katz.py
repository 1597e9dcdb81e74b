"""Language-model scores by a Katz back-off model (operator 7).

The model is learnt from all training documents and scores every document. The
probability of a word after a history is its Good-Turing discounted share if
the n-gram was seen in training, else the back-off weight of the history times
the probability after the history without its first word, and so on down to
the words themselves; words never seen share what discounting leaves of them.
Weights are normalised exactly: over all known words and the unknown one,
probabilities after any history sum to one.

Counts are too many to broadcast and some words are too common to group by, so
the work is a dialogue between chunks (a few million tokens each) and buckets
(parts of the hashed keys), all of it in written tables of packed arrays:

1. texts become chunks; each sends each bucket the distinct n-grams that hash
   to it, with their counts; a common word is one entry of a chunk, not a row of
   each occurrence;
2. buckets add up counts, send them back, and name for each n-gram one chunk as
   its owner;
3. order by order, chunks send the buckets of histories what the n-grams they
   own contribute to back-off weights, and which weights they need; buckets send
   the weights back, and chunks know the probabilities of that order, which the
   next one backs off to;
4. at the highest order chunks score what they know, and add the weights that
   come back.

The threshold k of Good-Turing discounting is 5; counts above it are left as
they are. A history whose followers all lie above it would leave nothing to
back off with: it counts once more, and that once is what is left. Copies of
documents raise some counts of counts above their neighbours, at any size of a
corpus; where a discount from the plain counts of counts is not valid, all come
from a log-linear fit to those up to k + 1 (Simple Good-Turing). Half a count is
taken from each only where that line does not fall faster than 1/r, or has
fewer than two points.

An n-gram is known by its bucket and a 64-bit key from hashes that are
independent of those that choose the bucket. Buckets grow in number with the
input and hold about as many keys at any size, so the chance that two n-grams of
a bucket share a key stays near 1e-7, and in a corpus of 100 TB about one pair
does.

The first word of a document has one end token as its history, so every n-gram
of it begins there.

Defined cases: null text is empty and has the end token alone; a null doc_id
counts as empty text for the choice of training documents; without training
documents everything is unknown, with probability one; repeated rows count and
score each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsight.llm.tables import Table, own_columns, release

FOLDS, HELD_FOLD, K, ORDER = 7, 2, 5, 3
#: Sizes for workers of about 1 GB: tokens of a chunk, least number of buckets, and bytes of input for each. Messages are as
#: many as chunks times buckets, so on larger workers raise both sizes alike: ten times each makes a hundredth of the messages.
CHUNK_TOKENS, MIN_BUCKETS, BUCKET_BYTES = 1_000_000, 64, 16 << 20
#: Parts of the chunks that get their answers one after another, so that no exchange holds all chunks and answers a second time.
WAVES = 2
#: Unit of the masses that chunks send, which are numbers from 0 to 1.
MASS_BITS = 52
END = b"\n"  # no word can be this; also the history of a first word


def deltas(counts_of_counts: list[int], k: int = K) -> np.ndarray:
    """What discounting takes from a count r, at [min(r, k + 1)]; counts_of_counts[r - 1] for r up to k + 1."""
    n = [0, *counts_of_counts]
    if all(n[1 : k + 2]):
        a = (k + 1) * n[k + 1] / n[1]
        if a < 1:
            d = [((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                return np.array([0.0, *((1 - x) * r for r, x in enumerate(d, 1)), 0.0])
    slope = fitted_slope(n)
    if slope < -1:
        # With n_r = c r^slope, r* / r is (1 + 1/r)^(slope + 1), and what is taken falls between 0 and r for every r.
        taken = np.expm1((slope + 1) * np.log1p(1 / np.arange(1, k + 1))) / math.expm1((slope + 1) * math.log(k + 1))
        return np.array([0.0, *(taken * np.arange(1, k + 1)), 0.0])
    return np.array([0.0] + [0.5] * k + [0.0])


def fitted_slope(n: list[int]) -> float:
    """Slope of log n_r over log r, each n_r spread over half the gap to its neighbours that are not zero; 0 for fewer than two."""
    r = [i for i, x in enumerate(n) if i and x]
    if len(r) < 2:
        return 0.0
    gaps = [(after - before) / 2 for before, after in zip([0, *r], [*r[1:], 2 * r[-1] - r[-2]])]
    return float(np.polyfit(np.log(r), np.log([n[i] / g for i, g in zip(r, gaps, strict=True)]), 1)[0])


def packed(**arrays) -> bytes:
    """Arrays with their bytes in planes, compressed."""
    import zstandard

    planes = {}
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        planes[name] = a.dtype.str, len(a), a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes, 5))


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    import zstandard

    planes = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
    return {name: np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, n).T.copy().view(kind).reshape(n) if n else np.empty(0, kind) for name, (kind, n, b) in planes.items()}


def stepped(keys: np.ndarray) -> np.ndarray:
    """Differences of sorted keys, which pack better; np.cumsum gives the keys back."""
    return np.diff(keys, prepend=np.zeros(1, np.uint64))


def mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Keys of n-grams from those of their histories and last words."""
    x = h * np.uint64(0x9E3779B97F4A7C15) + (w ^ (w >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def mixed_sides(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The same for the hashes that choose buckets."""
    x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + w * np.uint32(0x297A2D39)
    x = (x ^ (x >> np.uint32(12))) * np.uint32(0x85EBCA77)
    return x ^ (x >> np.uint32(13))


def in_buckets(keys: np.ndarray, sides: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys by bucket and key, and where each bucket starts in it, with the end."""
    order = np.argsort(keys)
    of = (sides[order] % np.uint32(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    again = np.argsort(of, kind="stable")
    return order[again], np.append(np.searchsorted(of[again], np.arange(buckets)), len(keys))


class Ids(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Level:
    """The distinct n-grams of a chunk by bucket and key: for each its history and its shorter form, as places in the level below, and for each token its n-gram (-1: too near the start)."""

    def __init__(self, keys, sides, history, shorter, place, buckets):
        order, self.edges = in_buckets(keys, sides, buckets)
        self.keys, self.sides = keys[order], sides[order]
        self.history, self.shorter = (None if x is None else x[order] for x in (history, shorter))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.place = np.where(place < 0, -1, rank[place]) if len(order) else place

    def counts(self, train: np.ndarray) -> np.ndarray:
        return np.bincount(self.place[train & (self.place >= 0)], minlength=len(self.keys))


class Chunk:
    """Documents as arrays: hashes of words in order of first appearance, tokens (each document ends with END), lengths, ids, folds."""

    def __init__(self, hashes, sides, tokens, lengths, doc_ids, known_ids, held):
        self.hashes, self.sides, self.tokens, self.lengths, self.doc_ids, self.known_ids, self.held = hashes, sides, tokens, lengths, doc_ids, known_ids, held

    def levels(self, order: int, buckets: int) -> list[Level]:
        found = [Level(self.hashes, self.sides, None, None, self.tokens.astype(np.int64), buckets)]
        words = found[0].place
        ends = np.cumsum(self.lengths)
        position = np.arange(len(words)) - np.repeat(np.concatenate([[0], ends[:-1]]), self.lengths)
        for n in range(2, order + 1):
            below = found[-1]
            history = np.empty_like(words)
            history[1:] = below.place[:-1]
            if n == 2:
                history[position == 0] = words[ends[0] - 1]  # END
            there = position >= n - 2
            codes, first, inverse = np.unique(history[there] << 32 | words[there], return_index=True, return_inverse=True)
            h, w, place = codes >> 32, codes & 0xFFFFFFFF, np.full(len(words), -1, np.int64)
            place[there] = inverse
            found.append(Level(mixed(below.keys[h], found[0].keys[w]), mixed_sides(below.sides[h], found[0].sides[w]), h, below.place[there][first], place, buckets))
        return found

    def trained(self):
        return np.repeat(~self.held, self.lengths)


MESSAGES = pa.schema([("kind", pa.string()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])
MESSAGE_SQL = "kind string, chunk long, bucket int, data binary"


def messages(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: list(x) for n, x in zip(MESSAGES.names, zip(*rows), strict=True)} if rows else {n: [] for n in MESSAGES.names}, schema=MESSAGES)


def make_chunks(chunk_tokens: int):
    """For mapInArrow over (doc_id, text): the chunks of the task."""

    def run(batches):
        import xxhash

        pid = TaskContext.get().partitionId()
        number, ids, parts, docs, held, total = 0, Ids(), [], [], [], 0

        def ended():
            lengths = np.array([len(p) for p in parts], np.int64)
            digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, ids)), np.uint64).reshape(-1, 2)
            data = packed(hashes=digests[:, 0], sides=(digests[:, 1] >> np.uint64(32)).astype(np.uint32), tokens=np.concatenate(parts).astype(np.uint32), lengths=lengths, doc_ids=np.array([d or 0 for d in docs], np.int64), known_ids=np.array([d is not None for d in docs]), held=np.array(held, bool))
            return messages([("T", (pid << 24) + number, -1, data)])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = (text.as_py() or "").encode().lower().split()
                words.append(END)
                parts.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
                docs.append(doc)
                held.append(zlib.crc32(b"" if doc is None else str(doc).encode()) % FOLDS == HELD_FOLD)
                total += len(words)
                if total >= chunk_tokens:
                    yield ended()
                    number, ids, parts, docs, held, total = number + 1, Ids(), [], [], [], 0
        if parts:
            yield ended()

    return run


def send_counts(orders: list[int], buckets: int):
    """For mapInArrow over chunks: their n-grams of these orders, with counts in training text, for each bucket; kind is n."""

    def run(batches):
        for batch in batches:
            for chunk_id, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                chunk = Chunk(**unpacked(data.as_py()))
                train = chunk.trained()
                levels = chunk.levels(orders[-1], buckets)
                for n in orders:
                    level = levels[n - 1]
                    counts, held, edges = level.counts(train), level.counts(~train) > 0, level.edges.tolist()
                    yield messages([(f"{n}", chunk_id, b, packed(k=stepped(level.keys[s:e]), n=counts[s:e], held=held[s:e])) for b, (s, e) in enumerate(zip(edges[:-1], edges[1:])) if e > s])

    return run


STATS = ["n", "v", *(f"r{r}" for r in range(1, K + 2))]


def add_counts(table: pa.Table) -> pa.Table:
    """For applyInArrow over the messages of a bucket: counts for each chunk, which n-grams it owns, which may be asked for as histories, and counts of counts (chunk -1).

    Only histories that held-out documents have can back off, as every n-gram of
    training text is known; and only those of more than k occurrences may count
    once more.
    """
    kind, bucket = table["kind"][0].as_py(), table["bucket"][0].as_py()
    rows = sorted(zip(table["chunk"].to_pylist(), table["data"].to_pylist(), strict=True))
    parts = [unpacked(d) for _, d in rows]
    keys = np.concatenate([np.cumsum(p["k"], dtype=np.uint64) for p in parts])
    unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    total = np.zeros(len(unique), np.int64)
    np.add.at(total, inverse, np.concatenate([p["n"] for p in parts]))
    held = np.zeros(len(unique), bool)
    held[inverse[np.concatenate([p["held"] for p in parts])]] = True
    owner = np.zeros(len(keys), bool)
    owner[first] = total > 0
    ends = np.cumsum([len(p["k"]) for p in parts]).tolist()
    out = {"kind": [], "chunk": [], "bucket": [], "data": [], **{s: [] for s in STATS}}
    for (chunk, _), s, e in zip(rows, [0, *ends[:-1]], ends, strict=True):
        data = packed(n=total[inverse[s:e]], own=owner[s:e], wanted=(held | (total > K))[inverse[s:e]])
        for name, value in zip(out, (kind, chunk, bucket, data, *[0] * len(STATS)), strict=True):
            out[name].append(value)
    stats = [int(total.sum()), int((total > 0).sum()), *((total == r).sum().item() for r in range(1, K + 2))]
    for name, value in zip(out, (kind, -1, bucket, None, *stats), strict=True):
        out[name].append(value)
    return pa.Table.from_pydict(out, schema=pa.schema([*MESSAGES, *((s, pa.int64()) for s in STATS)]))


class Model:
    """What a chunk must know besides its own counts: totals and discounts of each order."""

    def __init__(self, stats: list[dict[str, int]]):
        words = stats[0]
        self.n, self.v = words["n"], words["v"]
        self.deltas = [deltas([s[f"r{r}"] for r in range(1, K + 2)]) for s in stats]
        left = float(np.dot([words[f"r{r}"] for r in range(1, K + 1)], self.deltas[0][1 : K + 1]))
        # Words that all lie above the threshold leave nothing to the unknown one but one more count.
        self.total = self.n + (left == 0)
        self.unknown = (left or 1.0) / self.total

    def word_probability(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, (c - self.deltas[0][np.minimum(c, K + 1)]) / self.total, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.n + self.v + 1))


def weight_of(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Back-off weights from what buckets send: the mass left over one less the mass of known followers, negative where a history counts once more."""
    return np.where(sums > 0, sums / counts, -sums / (counts + 1))


class Known:
    """What a chunk knows of its n-grams from the answers so far."""

    def __init__(self, model: Model, chunk: Chunk, order: int, buckets: int, answers: pa.Table):
        self.model, self.chunk, self.levels = model, chunk, chunk.levels(order, buckets)
        found: dict[str, list] = {}
        for kind, bucket, data in zip(*(answers[c].to_pylist() for c in ("kind", "bucket", "data")), strict=True):
            found.setdefault(kind, []).append((bucket, unpacked(data)))
        join = lambda kind, field: np.concatenate([x[field] for _, x in sorted(found[kind], key=lambda x: x[0])]) if kind in found else np.empty(0, np.int64)
        self.counts = [join(f"{n}", "n") for n in range(1, order + 1)]
        self.own, self.wanted = ([join(f"{n}", x).astype(bool) for n in range(1, order + 1)] for x in ("own", "wanted"))
        self.sums = {n: join(f"W{n}", "sums") for n in range(2, order + 1) if f"W{n}" in found}
        self.probability = [model.word_probability(self.counts[0])]
        for n in range(2, order):
            self.probability.append(self.probabilities(n))

    def asks(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n-grams that back off with a weight, seen ones whose history may count once more, and the histories of both, in order."""
        level, r, c = self.levels[n - 1], self.counts[n - 1], self.counts[n - 2]
        back = (r == 0) & (c[level.history] > 0)
        low = np.zeros(len(c), bool)
        low[level.history[(r > 0) & (r <= K)]] = True
        unsure = (r > K) & ~low[level.history]
        return back, unsure, np.unique(level.history[back | unsure])

    def probabilities(self, n: int) -> np.ndarray:
        """Of every n-gram of this order, once its weights have come."""
        level, r, c = self.levels[n - 1], self.counts[n - 1], self.counts[n - 2]
        back, unsure, asked = self.asks(n)
        sums = self.sums.get(n, np.empty(0))
        at = lambda which: np.searchsorted(asked, level.history[which])
        p = self.probability[n - 2][level.shorter]
        seen = r > 0
        p[seen] = (r[seen] - self.model.deltas[n - 1][np.minimum(r[seen], K + 1)]) / c[level.history[seen]]
        p[back] *= weight_of(sums[at(back)], c[level.history[back]])
        once = np.flatnonzero(unsure)[sums[at(unsure)] < 0]
        p[once] = r[once] / (c[level.history[once]] + 1)
        return p

    def contributions(self, n: int, buckets: int, chunk_id: int) -> list[tuple]:
        """Messages to the buckets of this order's histories: what owned n-grams give to their weights, and which weights are asked for."""
        level, below, r = self.levels[n - 1], self.levels[n - 2], self.counts[n - 1]
        own = self.own[n - 1] & self.wanted[n - 2][level.history]
        asked = self.asks(n)[2]
        given, at = np.unique(level.history[own], return_inverse=True)
        low = {f"r{k}": np.bincount(at[r[own] == k], minlength=len(given)) for k in range(1, K + 1)}
        mass = np.bincount(at, self.probability[n - 2][level.shorter[own]], len(given))
        ge, ae = np.searchsorted(given, below.edges).tolist(), np.searchsorted(asked, below.edges).tolist()
        rows = []
        for b in range(buckets):
            g, a = slice(ge[b], ge[b + 1]), slice(ae[b], ae[b + 1])
            if g.stop > g.start or a.stop > a.start:
                rows.append((f"H{n}", chunk_id, b, packed(given=stepped(below.keys[given[g]]), mass=np.rint(mass[g] * (1 << MASS_BITS)).astype(np.int64), asked=stepped(below.keys[asked[a]]), **{k: x[g] for k, x in low.items()})))
        return rows


def contribute(model: Model, n: int, buckets: int):
    """For cogrouped applyInArrow over a chunk and its answers so far: messages about the histories of order n (kind Hn)."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        known = Known(model, Chunk(**unpacked(left["data"][0].as_py())), n, buckets, right)
        return pa.Table.from_batches([messages(known.contributions(n, buckets, key[0].as_py()))])

    return run


def score_known(model: Model, order: int, buckets: int):
    """The same at the highest order, with the partial scores of the chunk's documents (kind D) and what they wait for."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        chunk_id, chunk = key[0].as_py(), Chunk(**unpacked(left["data"][0].as_py()))
        known = Known(model, chunk, order, buckets, right)
        c1, words = known.counts[0], known.levels[0].place
        starts = np.concatenate([[0], np.cumsum(chunk.lengths)[:-1]])
        add = lambda x: np.add.reduceat(x, starts)
        logs, waits = np.log10(known.probability[0])[words] if order == 1 else np.empty(len(words)), {}
        if order > 1:
            for n in range(2, order):  # tokens too near the start for longer n-grams
                near = (known.levels[n].place < 0) & (known.levels[n - 1].place >= 0)
                logs[near] = np.log10(known.probability[n - 1])[known.levels[n - 1].place[near]]
            if order > 2:
                first = known.levels[1].place < 0
                logs[first] = np.log10(known.probability[0])[words[first]]
            level, r, c = known.levels[-1], known.counts[-1], known.counts[-2]
            back, unsure, asked = known.asks(order)
            p = known.probability[-1][level.shorter]
            seen = r > 0
            p[seen] = (r[seen] - model.deltas[-1][np.minimum(r[seen], K + 1)]) / c[level.history[seen]]
            there = level.place >= 0
            logs[there] = np.log10(p)[level.place[there]]
            doc_of = np.repeat(np.arange(len(starts)), chunk.lengths)
            for name, which in (("back", back), ("unsure", unsure)):
                tokens = np.flatnonzero(there)[which[level.place[there]]]
                waits[f"{name}_doc"] = doc_of[tokens].astype(np.uint32)
                waits[f"{name}_for"] = np.searchsorted(asked, level.history[level.place[tokens]]).astype(np.uint32)
            waits["asked_count"] = c[asked]
        partial = packed(doc_ids=chunk.doc_ids, known_ids=chunk.known_ids, held=chunk.held, tokens=chunk.lengths, known=add((c1[words] > 0).astype(np.int64)), base=add(model.base(c1)[words]), score=add(logs), **waits)
        return pa.Table.from_batches([messages([("D", chunk_id, -1, partial), *(known.contributions(order, buckets, chunk_id) if order > 1 else [])])])

    return run


def weigh(model: Model, n: int):
    """For applyInArrow over the messages about the histories of a bucket: to each chunk that asked, what weight_of needs (kind Wn)."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        rows = sorted(zip(table["chunk"].to_pylist(), table["data"].to_pylist(), strict=True))
        parts = [unpacked(d) for _, d in rows]
        keys, inverse = np.unique(np.concatenate([np.cumsum(p["given"], dtype=np.uint64) for p in parts]), return_inverse=True)
        left, mass = np.zeros(len(keys)), np.zeros(len(keys), np.int64)
        np.add.at(left, inverse, np.concatenate([sum(model.deltas[n - 1][k] * p[f"r{k}"] for k in range(1, K + 1)) for p in parts]))
        np.add.at(mass, inverse, np.concatenate([p["mass"] for p in parts]))
        sums = np.where(left > 0, left, -1.0) / np.maximum(1 - mass / (1 << MASS_BITS), 1e-300)
        return pa.Table.from_batches([messages([(f"W{n}", chunk, bucket, packed(sums=sums[np.searchsorted(keys, np.cumsum(p["asked"], dtype=np.uint64))])) for (chunk, _), p in zip(rows, parts, strict=True) if len(p["asked"])])])

    return run


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def finish(model: Model):
    """For cogrouped applyInArrow over a chunk's partial scores and its weights."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        d = unpacked(left["data"][0].as_py())
        score = d["score"]
        if len(d.get("asked_count", ())):
            sums, counts = np.concatenate([unpacked(x)["sums"] for _, x in sorted(zip(right["bucket"].to_pylist(), right["data"].to_pylist(), strict=True))]), d["asked_count"]
            once = np.where(sums < 0, np.log10(counts / (counts + 1)), 0.0)
            score = score + np.bincount(d["back_doc"], np.log10(weight_of(sums, counts))[d["back_for"]], len(score)) + np.bincount(d["unsure_doc"], once[d["unsure_for"]], len(score))
        ids = pa.array(d["doc_ids"], mask=~d["known_ids"])
        return pa.Table.from_arrays([ids, pa.array(d["held"]), pa.array(d["tokens"]), pa.array(d["known"]), pa.array(np.full(len(score), model.n, np.int64)), pa.array(d["base"]), pa.array(score)], schema=SCORES)

    return run


#: Sizes from here on mean that the optimizer knows none.
UNKNOWN_SIZE = 1 << 60


def bucket_count(texts: DataFrame) -> int:
    """Buckets for the size of the texts as the optimizer knows it; where it knows nothing, they are measured."""
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= UNKNOWN_SIZE:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(MIN_BUCKETS, -(-size // BUCKET_BYTES))


def together(tables: list[Table]) -> DataFrame:
    found = tables[0].read()
    for t in tables[1:]:
        found = found.union(t.read())
    return found


SCORES_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def katz_scores(docs: DataFrame, buckets: int | None = None, chunk_tokens: int = CHUNK_TOKENS, order: int = ORDER, waves: int = WAVES) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, texts = docs.sparkSession, own_columns(docs, ["doc_id", "text"])
    buckets = buckets or bucket_count(texts)
    parts = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def dealt(df: DataFrame, *keys: str) -> DataFrame:
        """df by its keys; to as many tasks as there are buckets where Spark's own number is less."""
        return df.repartition(parts, *keys) if parts == buckets else df

    chunks = Table(texts.mapInArrow(make_chunks(chunk_tokens), MESSAGE_SQL), "katz-chunks", "none")
    used = [chunks]
    # One exchange after another, so that only one lies on the disks at a time.
    counted = None
    for orders in [list(range(1, min(order, 2) + 1)), *([n] for n in range(3, order + 1))]:
        sent = chunks.read().select("chunk", "data").mapInArrow(send_counts(orders, buckets), MESSAGE_SQL)
        some = Table(dealt(sent, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(add_counts, MESSAGE_SQL + "".join(f", {s} long" for s in STATS)), "katz-answers", "none")
        used.append(some)
        counted = some.read() if counted is None else counted.union(some.read())
        del sent
        release(spark)
    stats = {r["kind"]: r.asDict() for r in counted.filter("chunk = -1").groupBy("kind").agg(*[F.sum(s).alias(s) for s in STATS]).collect()}
    model = Model([stats.get(f"{n}", dict.fromkeys(STATS, 0)) for n in range(1, order + 1)])
    texts_of, answers, weights = chunks.read().select("chunk", "data"), counted.filter("chunk >= 0").select("kind", "chunk", "bucket", "data"), None
    for n in range(2, order + 1):
        step = contribute(model, n, buckets) if n < order else score_known(model, order, buckets)
        needed = answers.filter(F.col("kind").isin([*map(str, range(1, n + 1)), *(f"W{m}" for m in range(2, n))]))
        told = []
        for wave in range(waves):
            # Not the hash that deals rows to tasks, or a wave would leave some of them empty.
            of_wave = F.expr(f"pmod(xxhash64(chunk), {waves}) = {wave}")
            left, right = (dealt(x.filter(of_wave), "chunk").groupBy("chunk") for x in (texts_of, needed))
            told.append(Table(left.cogroup(right).applyInArrow(step, MESSAGE_SQL), "katz-partial", "none"))
            del left, right
            release(spark)
        if n == order:
            for t in used:
                t.drop()
            used = []
        sent = together(told)
        weights = Table(dealt(sent.filter(f"kind = 'H{n}'"), "bucket").groupBy("bucket").applyInArrow(weigh(model, n), MESSAGE_SQL), "katz-weights", "none")
        used.append(weights)
        if n < order:
            for t in told:
                t.drop()
            answers = answers.union(weights.read())
    done = sent.filter("kind = 'D'").groupBy("chunk").cogroup(weights.read().groupBy("chunk")).applyInArrow(finish(model), SCORES_SQL)
    scores = Table(done, "katz-scores").read()
    used += told
    for t in used:
        t.drop()
    return scores
