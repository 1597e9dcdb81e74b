"""Suffix-array dedup against brute force over all windows, and suffix arrays against sorting."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keepsight.llm import suffixdedup
from keepsight.llm.suffixarray import equal_windows, induced_by_value, suffix_array
from keepsight.llm.suffixdedup import strings_to_compare, suffix_dedup
from keepsight.llm.tables import text_key

SCHEMA = "doc_id long, text string, file long, start long, n long, gone string, text_key long"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randint(2, 8))) for _ in range(n))


def corpus():
    passage, line, short = prose(1, 40), prose(2, 22), prose(3, 7)
    rows = [(i, f"{prose(100 + i, 60)} {passage if i % 3 else ''} {prose(200 + i, 30)}\n{line}\n{short} {prose(300 + i, 9)}") for i in range(2, 40)]
    rows += [(50, rows[0][1]), (51, rows[0][1]), (51, rows[0][1]), (None, rows[1][1]), (None, rows[1][1]), (None, prose(9, 80)), (52, rows[2][1] + "x"), (1, rows[3][1][50:]), (1, rows[3][1][40:])]
    rows += [(60, None), (61, ""), (62, "x" * 99), (63, "x" * 100), (64, "x" * 350), (65, "ab" * 400), (66, "ba" * 60), (67, "é𐐷\u0000 " * 70), (68, prose(5, 9000)), (69, prose(6, 50) + prose(5, 9000)[4000:9000]), (70, (line + "\n") * 6), (63, "x" * 100)]
    return rows


def brute_force(rows, width=100):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, text_key(rows[k][1])))
    seen, out = set(), []
    for k in order:
        b = (rows[k][1] or "").encode()
        gone, new = bytearray(len(b)), set()
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if w in seen or w in new:
                gone[i : i + width] = b"\1" * width
            new.add(w)
        seen |= new
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((rows[k][0], len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 5, 6, 7, "x", 8) for r in corpus()], SCHEMA).repartition(4)


@pytest.mark.parametrize("options", ({}, {"most": 1}, {"most": 3, "frequent": 10**9}, {"frequent": 2}, {"frequent": 6, "most": 2}))
def test_against_brute_force(docs, options):
    assert sorted(map(tuple, suffix_dedup(docs, **options).collect()), key=repr) == brute_force(corpus())


def test_a_long_text_is_read_in_blocks(spark, monkeypatch):
    table = suffixdedup.byte_table()
    text = (prose(5, 300) + prose(6, 200) + prose(5, 300)).encode()
    covered = lambda: sorted(i + lo + k for _, _, first, n, _, lo in suffixdedup.window_strings(text, table) for i, m in zip(first.tolist(), n.tolist()) for k in range(m))
    assert covered() == list(range(len(text) - 99))
    monkeypatch.setattr(suffixdedup, "BLOCK", 130)
    assert covered() == list(range(len(text) - 99))
    got = {}
    for file, _, first, n, _, lo in suffixdedup.window_strings(text, table):
        for f, i, m in zip(file.tolist(), first.tolist(), n.tolist()):
            for k in range(m):
                w = text[lo + i + k : lo + i + k + 100]
                assert got.setdefault(w, f) == f  # equal windows are filed together, whatever the block


def test_empty_table(docs):
    assert suffix_dedup(docs.limit(0)).collect() == []


def test_large_files_pass_through_in_batches():
    """Rows of one file over many batches give what they give in one, whether or not it outgrows what is held."""
    import pyarrow as pa

    rng = random.Random(4)
    rows = sorted((rng.choice((1, 2, 2, 2, 3)), rng.randint(1, 9), False, False, rng.randint(1, 3), 0, rng.randint(0, 4), 1) for _ in range(300))
    rows += [(9, 0, True, True, None, 1, 2, 30)]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), suffixdedup.FILED.types)], schema=suffixdedup.FILED)
    for most in (1, 4, 1000):
        found = []
        for size in (1, 7, 400):
            batches = [batch(rows[i : i + size]) for i in range(0, len(rows), size)]
            found.append(sorted((tuple(r.values()) for b in strings_to_compare(most)(iter(batches)) for r in b.to_pylist()), key=repr))
        gone = [[r[:4] for r in f if r[4] is None] for f in found]
        assert gone[0] == gone[1] == gone[2] and len(gone[0]) == 1 + len({r[:7] for r in rows if not r[2]}) - len({r[:2] for r in rows if not r[2]})
        assert {r[:5] for r in found[2]} <= {r[:5] for r in found[0]}  # a file that passes through never has fewer strings to compare


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array_is_sorted(values):
    s = [*values, 0]
    want = sorted(range(len(s)), key=lambda i: s[i:])
    assert suffix_array(np.array(s), 4).tolist() == want
    dense = {v: i for i, v in enumerate(sorted(set(s)))}
    assert induced_by_value([dense[v] for v in s], len(dense)) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 2 for x in b)), min_size=1, max_size=6), st.integers(1, 20))
def test_equal_windows(strings, width):
    want, got = defaultdict(set), defaultdict(set)
    for i, s in enumerate(strings):
        for j in range(len(s) - width + 1):
            want[s[j : j + width]].add((i, j))
    for i, j, g in zip(*(x.tolist() for x in equal_windows(strings, width)), strict=True):
        got[g].add((i, j))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
