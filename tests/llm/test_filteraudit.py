"""The filter audit against a plain replay, with nulls, ties, repeated rows, empty and very long texts."""

import re
from collections import Counter
from itertools import permutations

import pytest

from keepsight.llm.filteraudit import COUNTS, filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GOOD = " ".join(f"word{i}" for i in range(230))
TEXTS = [
    (1, GOOD, "en"), (2, GOOD, "en"), (2, GOOD, "de"), (None, GOOD, "en"), (3, "a " * 300, "en"), (4, GOOD.upper(), "de"), (5, GOOD + " 50% | off", "fr"), (6, None, None), (7, "", "en"), (None, "", ""), (8, "A# " * 20, "en"),
    (9, "ÄÖ É   \x0b\x0c\r𐐷 " + GOOD, "de"), (10, " ".join(f"w{i % 70_000}" for i in range(120_000)), "en"), (10, " ".join(f"w{i % 70_000}" for i in range(120_000)), "en"), (None, "only here", "fr"), (None, "only here", "fr"), (11, " \t\n", "en"),
]
LABELS = [(1, 1, 0), (1, 0, None), (2, 0, 1), (3, 1, 1), (4, None, None), (6, 1, 0), (6, 1, 0), (None, 1, 1), (99, 1, 1), (10, 1, 0)]


def plain():
    least = {}
    for i, t, _ in TEXTS:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = []
    for i, t, lang in TEXTS:
        t = t or ""
        words = WORD.findall(t)
        copy = t in least and (i is None or least[t] < i)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(set("#$%&*|") & set(t)), "E": copy}
        good, toxic = (any(r[0] == i is not None and r[k] == 1 for r in LABELS) for k in (1, 2))
        docs.append((lang or "", {f for f, x in fails.items() if x}, good, toxic))
    found, shapley = Counter(), Counter()
    for order in map("".join, permutations("ABCDE")):
        for part, fails, good, toxic in docs:
            gone = False
            for step, f in enumerate(order, 1):
                now = f in fails and not gone
                for name, x in zip(COUNTS, (not gone and not now, now, f in fails and gone, fails == {f}, now and good, now and toxic), strict=True):
                    found[part, order, step, name] += x
                shapley[part, f] += now
                gone |= now
    return sorted((p, o, s, *[found[p, o, s, c] for c in COUNTS], shapley[p, o[s - 1]]) for p in {d[0] for d in docs} for o in map("".join, permutations("ABCDE")) for s in range(1, 6))


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, g, 1, 2, "x", 3) for i, t, g in TEXTS], "doc_id long, text string, lang string, part int, step int, digest string, good int").repartition(3)
    return docs, spark.createDataFrame([(*r, 5) for r in LABELS], "doc_id long, quality int, toxic int, part int")


def test_against_plain_replay(tables):
    got = filter_audit(*tables)
    assert got.columns == ["part", "filter_order", "step", *COUNTS, "shapley"]
    assert [k for _, k in got.dtypes] == ["string", "string", "int", *["bigint"] * 7]
    assert sorted(map(tuple, got.collect())) == plain()


def test_empty_tables(tables):
    docs, labels = tables
    assert filter_audit(docs.limit(0), labels).collect() == []
    unlabelled = filter_audit(docs, labels.limit(0)).collect()
    assert len(unlabelled) == 600 * 4 and not any(r["good_lost"] or r["toxic_lost"] for r in unlabelled)


def test_counts_combine_before_the_shuffle(tables, capsys):
    """The crossed rows never move: the cross is a broadcast, and a partial aggregate stands before the exchange."""
    from keepsight.llm.filteraudit import document_flags, orders
    from pyspark.sql import functions as F

    docs, labels = tables
    crossed = document_flags(docs, labels).crossJoin(F.broadcast(orders(docs.sparkSession)))
    crossed.groupBy("part", "filter_order").agg(F.count("*")).explain()
    plan = capsys.readouterr().out
    assert "BroadcastNestedLoopJoin" in plan and "CartesianProduct" not in plan and plan.index("partial_count") > plan.index("Exchange")
