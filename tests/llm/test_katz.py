"""The Katz model against a plain Python version, and what its probabilities must add up to."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from keepsight.llm.katz import K, deltas, katz_scores


def plain(docs, order=3):
    """Katz's recursion word by word, over counters of tuples."""
    tokens = {k: [None, *(t or "").encode().lower().split(), None] for k, (_, t) in enumerate(docs)}
    held = {k: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for k, (i, _) in enumerate(docs)}
    counts = {n: Counter() for n in range(1, order + 1)}
    for k, ts in tokens.items():
        if not held[k]:
            counts[1].update((w,) for w in ts[1:])
            for n in range(2, order + 1):
                counts[n].update(tuple(ts[i : i + n]) for i in range(len(ts) - n + 1))
    words = Counter({w: c for (w,), c in counts[1].items()})
    total = sum(words.values())
    taken = {n: deltas([sum(x == r for x in c.values()) for r in range(1, K + 2)]) for n, c in counts.items()}
    discounted = lambda n, c: c - (taken[n][c] if c <= K else 0)
    left = sum(taken[1][c] for c in words.values() if c <= K)
    after = defaultdict(list)
    for n in range(2, order + 1):
        for g in counts[n]:
            after[g[:-1]].append(g[-1])

    def p(history, w):
        n = len(history) + 1
        if n == 1:
            if left:
                return discounted(1, words[w]) / total if words[w] else left / total
            return (words[w] or 1) / (total + 1)
        seen = sum(counts[n][(*history, x)] for x in after[history])
        if not seen:
            return p(history[1:], w)
        rest = sum(counts[n][(*history, x)] - discounted(n, counts[n][(*history, x)]) for x in after[history])
        more = 0 if rest else 1
        if c := counts[n][(*history, w)]:
            return discounted(n, c) / (seen + more)
        return (rest or 1) / (seen + more) / (1 - sum(p(history[1:], x) for x in after[history])) * p(history[1:], w)

    rows = []
    for k, (i, _) in enumerate(docs):
        ts = tokens[k]
        base = sum(math.log10((words[w] + 1) / (total + len(words) + 1)) for w in ts[1:])
        rows.append((i, held[k], len(ts) - 1, sum(words[w] > 0 for w in ts[1:]), total, base, sum(math.log10(p(tuple(ts[max(0, j - order + 1) : j]), ts[j])) for j in range(1, len(ts)))))
    return rows, words, p, after


def corpus(n, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    docs = []
    for i in range(n):
        words, at = [], 0
        for _ in range(rng.randint(0, 60)):
            at = (at * 7 + int(rng.paretovariate(0.7))) % 400
            words.append(rng.choice((str.upper, str))(vocabulary[at]) if rng.random() > 0.05 else f"rare{rng.randint(0, 999)}")
        docs.append((i, " ".join(words)))
    return docs + [(n, None), (n + 1, " \n"), (None, "W1 w2 w3"), (n + 2, "w1 w1 w1"), (n + 2, "w1 w1 w1"), (n + 3, "Ünknown ünknown " * 30), (n + 4, "the " * 5000)]


FREQUENT = [(i, "a b a c " * 9) for i in range(10)] + [(11, "b b d"), (2, "a c a d")]  # every count lies above the threshold


@pytest.mark.parametrize("docs", [corpus(60), [(0, "a b"), (1, "b a c")], [(9, "only held"), (9, None)], FREQUENT])
@pytest.mark.parametrize("order", [3, 2, 4])
def test_scores(spark, docs, order):
    want = plain(docs, order)[0]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, kind string, bucket int").repartition(3)
    got = katz_scores(df, buckets=3, chunk_tokens=500, order=order).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_scores_in_one_chunk(spark):
    docs = corpus(60)
    got = katz_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r["score"] for r in got) == pytest.approx(sorted(r[6] for r in plain(docs)[0]), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("docs", [corpus(60), FREQUENT])
def test_probabilities_add_up_to_one(docs):
    _, words, p, after = plain(docs)
    for h in [(), *list(after)[:25], (b"w1", b"never"), (b"never",)]:
        assert sum(p(h, w) for w in words) + p(h, b"never seen") == pytest.approx(1)


def test_good_turing_discounts():
    d = deltas([1000, 400, 200, 120, 80, 55])
    assert all(0 < d[r] < r for r in range(1, K + 1)) and deltas([5, 0, 1, 1, 1, 1])[1] == 0.5


# Words and pairs of the documents at two sizes; copies raise some counts of counts above their neighbours.
@pytest.mark.parametrize("n", [[207344, 59772, 25017, 14274, 13493, 7080], [1579638, 246704, 51653, 21705, 18939, 7580]])
def test_copies_leave_good_turing_discounts(n):
    d = deltas(n)
    left = [r - d[r] for r in range(1, K + 1)]
    assert d[0] == d[K + 1] == 0 and all(0 < d[r] < r for r in range(1, K + 1)) and left == sorted(left) and len(set(d[1:-1])) == K
    x, y = [math.log(r) for r in range(1, K + 2)], [math.log(c) for c in n]
    mx, my = sum(x) / len(x), sum(y) / len(y)
    slope = sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x)
    line = [0, *(r**slope for r in range(1, K + 2))]
    a = (K + 1) * line[K + 1] / line[1]
    for r in range(1, K + 1):  # Katz's discounts from the line
        assert d[r] == pytest.approx(r * (1 - ((r + 1) * line[r + 1] / (r * line[r]) - a) / (1 - a)))
    assert sum(line[r] * d[r] for r in range(1, K + 1)) == pytest.approx(line[1])


def test_copied_documents_are_scored_with_good_turing(spark):
    docs = [(i, t) for i, t in corpus(150)[:150]]
    docs += [(1000 + 10 * i + j, t) for i, t in docs[:60] for j in range(2)]
    rows, words, *_ = plain(docs)
    n = [sum(x == r for x in words.values()) for r in range(1, K + 2)]
    assert 3 * n[2] > 2 * n[1]  # 2* is above 2: the plain counts of counts give no valid discount
    assert len(set(deltas(n)[1:-1])) == K and all(0 < deltas(n)[r] < r for r in range(1, K + 1))
    got = katz_scores(spark.createDataFrame(docs, "doc_id long, text string"), buckets=3, chunk_tokens=500).collect()
    assert sorted(r["score"] for r in got) == pytest.approx(sorted(r[6] for r in rows), rel=1e-9, abs=1e-9)


def test_pairs_help_on_held_out_text(spark):
    got = katz_scores(spark.createDataFrame(corpus(600), "doc_id long, text string")).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


def test_empty_table(spark):
    assert katz_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
