"""The prefix trie against a plain version, at several limits of a subtree, with nulls, ties, repeated rows and long conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from keepsight.llm.prefixtrie import id_runs, prefix_trie, run_hashes

SCHEMA = "conv_id long, turn long, role string, text string, depth long, key string, n long, path string"


def code(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, code(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    convs = {}
    for c, turns in own.items():
        h, family = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        convs[c] = tuple(own.get(family, [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    kids = defaultdict(int)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1]) if p else 0
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(nodes[p]) if convs[c] == p).encode()).hexdigest()
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends(p)) for p, m in list(nodes.items())), key=key)


def got(spark, rows, **options):
    df = spark.createDataFrame([(*r, 7, "x", 8, "y") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, prefix_trie(df, **options).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def random_rows():
    """Conversations over few different turns, so that prefixes of all lengths are shared and split."""
    rng, rows = random.Random(5), []
    for c in [*range(0, 140), 205, 206, 301, 350, -3, -100, -150, 10**12]:
        for turn in range(rng.choice((1, 1, 2, 3, 4, 7))):
            rows.append((c, turn if turn else rng.choice((0, None)), rng.choice(("user", "system", None)), rng.choice(("hi", "", None, "ää𐐷", "same"))))
    rows += [(7, 0, "user", "hi"), (7, 0, "user", "hi"), (8, 1, "a", "b"), (8, 1, "b", "a"), (None, 0, "user", "lost"), (None, None, None, None)]
    rows += [(900 + k, t, "user", f"turn {t}") for k in (1, 2, 3) for t in range(40 + k)]  # each goes on where another ends
    rows += [(9, t, "user", "long" * 30_000) for t in range(3)]
    return rows


@pytest.mark.parametrize("most", (1, 3, 512))
def test_against_plain_version(spark, most):
    rows = random_rows()
    assert got(spark, rows, most=most) == plain(rows)


def test_conversations_without_turns_end_at_the_root(spark):
    rows = [(c, 0, "user", "x") for c in range(5101, 5120)]  # the first of their hundred is absent
    assert any(zlib.crc32(str(r[0]).encode()) % 6 for r in rows)
    assert got(spark, rows) == plain(rows)
    lone = [next(r for r in rows if zlib.crc32(str(r[0]).encode()) % 6)]
    assert got(spark, lone) == plain(lone) == [(lone[0][0], 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone[0][0]).encode()).hexdigest())]


def test_empty_tables(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "no id")]) == []


def test_ids_of_copies_are_hashed_in_runs(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr("keepsight.llm.prefixtrie.MAX_RUN", 3)
    ids = [("a", i) for i in range(10)] + [("b", 5), ("c", 6), ("c", 7)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], names=["seq", "conv_id"]) for part in (ids[:4], ids[4:5], ids[5:])]
    runs = list(id_runs(iter(batches)))
    assert sum(b.num_rows for b in runs) == 6
    found = [tuple(r.values()) for b in run_hashes(iter(runs)) for r in b.to_pylist()]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found == [(0, 10, digest("0,1,2,3,4,5,6,7,8,9")), (5, 1, digest("5")), (6, 2, digest("6,7"))]
