"""Operators on documents against plain Python versions, edge cases included."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keepsight.llm.binpack import best_fit, lower_bound, pack
from keepsight.llm.exactdedup import exact_dedup
from keepsight.llm.mixing import mix_sources
from keepsight.llm.packing import Tokenizer, pack_documents, tokenizer_paths
from keepsight.llm.quality import quality_rules
from keepsight.llm.simhash import LEVELS, MAX_BITS, byte_bit_table, fingerprint, linked, ring_masks, similar_edges, simhash_components
from keepsight.llm.tokencount import Lengths, count_tokens, load_model, pretokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
TEXTS = [
    (1, "the same text of some words", "b"), (2, "the  same\ttext of\nsome words", "b"), (3, None, "a"), (4, "", None), (5, " \n\t ", "a"), (6, "One", "c"), (7, "Two words", "b"),
    (8, LONG, "b"), (9, LONG + " more", "b"), (10, "x y z\nx y z\n\nx y z\n \n", "a"), (None, "no id here at all", None), (12, "the same text of some words", "a"), (12, "the same text of some words", "a"),
    (13, "ÄÖ É ßtraße <s> <|endoftext|> ▁ 日本語 　 a b\r\nc   d ", "é"), (14, "### $$$ 12% a|b " * 30, "c"), (15, " leading", "c"), (16, "𐐷 \u0000 x", "Z"),
]
SCHEMA = "doc_id long, text string, source string, pid long, lid long, size long, w long, n long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, 9, 9, 9, 9, 9) for i, t, s in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_exact_dedup(docs, nothing):
    groups = defaultdict(list)
    for i, t, _ in TEXTS:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert rows(exact_dedup(docs).drop("text_key")) == sorted(want, key=repr)
    assert rows(exact_dedup(docs, key_bits=1).drop("text_key")) == sorted(want, key=repr)  # chunk keys that collide
    assert rows(exact_dedup(nothing)) == []


def test_one_row_of_equal_texts_stays(spark):
    given = [(5, "a  b", 1), (5, "a b", 2), (7, "a b", 3), (None, "a\tb", 4), (None, "c", 5), (None, "c", 6), (9, None, 7), (9, "", 8)]
    got = exact_dedup(spark.createDataFrame(given, "doc_id long, text string, row long").repartition(3)).collect()
    assert Counter(r["doc_id"] for r in got if r["kept"]) == {5: 1, None: 1, 9: 1} and len(got) == len(given)
    assert all(r["keep_id"] == (5 if r["group_size"] == 4 else 9 if r["doc_id"] == 9 else None) for r in got)


def plain_quality(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(zip(words, words[1:], words[2:]))
    twice = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(twice)


def test_quality_base_measures(docs, nothing):
    got = rows(quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    want = []
    for i, t, _ in TEXTS:
        m = plain_quality(t)
        want.append((i, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert got == sorted(want, key=repr)
    assert rows(quality_rules(nothing)) == []


def test_quality_order_does_not_change_the_verdict(spark):
    d = spark.createDataFrame([(i, ("### " * i + "plain words of no great interest, told once. ") + " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + i)}" for k in range(60))) for i in range(12)], "doc_id long, text string")
    names = ["symbols", "word_length", "dup_lines", "repeats", "exclamations", "capitals", "digits"]
    a, b = (rows(quality_rules(d, order).select("doc_id", "kept")) for order in (names, names[::-1]))
    assert a == b == rows(quality_rules(d).select("doc_id", "kept"))
    assert len({k for _, k in a}) == 2


def test_quality_main_path_has_no_python(docs):
    plan = quality_rules(docs.sparkSession.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


WORDY = [" ".join(f"w{i * i % k}" for i in range(n)) for n, k in ((3, 9), (4, 1), (5, 2), (60, 7), (200, 50), (300, 199), (1000, 400))]


def test_quality_base_measures_on_repeats(spark, monkeypatch):
    """Also where every window hash collides or has no room beside its position: the longer way gives the same."""
    from keepsight.llm import quality

    d = spark.createDataFrame(list(enumerate(WORDY)), "doc_id long, text string")
    want = sorted((i, plain_quality(t)[4]) for i, t in enumerate(WORDY))
    for bits in (20, 2, 60):
        monkeypatch.setattr(quality, "POSITION_BITS", bits)
        got = quality.base_measures(d).select("doc_id", "n_repeat_words").collect()
        assert sorted(map(tuple, got)) == want, bits


def test_each_kind_of_bad_text_is_rejected_by_its_rule(spark):
    from keepsight.llm.quality import rule_estimates, rules

    fine = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}word" for k in range(90)]
    bad = {
        "symbols": [*fine, *["a#b"] * 1, "#" * 12], "symbol_chars": [x if k % 20 else "<>|$%&*#" * 4 for k, x in enumerate(fine)], "word_length": [x * 4 for x in fine], "exclamations": [x + "!" * (k % 2) for k, x in enumerate(fine)],
        "capitals": [x.upper() for x in fine], "digits": [f"{k}7{k}" for k in range(90)], "one_word": [y for x in fine for y in (x, "the")][:120],
    }
    texts = {**{k: " ".join(v) for k, v in bad.items()}, "dup_lines": "\n".join([*fine[:20], *["same"] * 60]), None: " ".join(fine)}
    d = spark.createDataFrame([(k or "", t, i) for i, (k, t) in enumerate(texts.items())], "name string, text string, doc_id long")
    for name in rules():
        if name == "repeats":
            continue
        got = {r["doc_id"]: r["rejected_by"] for r in quality_rules(d, [name]).collect()}
        at = list(texts).index(name)
        assert got[at] in (name, "base") and got[len(texts) - 1] is None, (name, got)
    found = rule_estimates(d, rules(), 1000)
    assert set(found) == set(rules()) and all(cost >= 1 and 0 <= share <= 1 for cost, share in found.values())


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=12))
def test_one_word_rule_counts_the_most_frequent(spark, words):
    from pyspark.sql import functions as F

    from keepsight.llm.quality import one_word_fills

    row = spark.range(1).select(*[one_word_fills(F.array(*map(F.lit, words)), part).alias(f"p{part}") for part in (1, 2, 3, 5)]).first()
    assert list(row) == [part * max(Counter(words).values()) > len(words) for part in (1, 2, 3, 5)]


def plain_components(fps):
    label = {f: f for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= MAX_BITS:
            label[root(a)] = root(b)
    return {f: root(f) for f in fps}


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash(docs, nothing):
    fps = [(i, plain_fingerprint(t)) for i, t, _ in TEXTS]
    root = plain_components(sorted({f for _, f in fps}))
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = [(i, f"{f:016x}", least.get(root[f])) for i, f in fps]
    assert rows(simhash_components(docs).select("doc_id", "fingerprint", "component_id")) == sorted(want, key=repr)
    assert rows(simhash_components(nothing)) == []


def test_simhash_loses_no_link_when_buckets_are_refined(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = set(base.tolist())
    for f in base.tolist():
        x = f
        for _ in range(40):  # chains that drift, and stars
            x ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))
            fps |= {x, x ^ (1 << int(rng.integers(64)))}
    fps = sorted(fps)
    want = plain_components(fps)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for most in (1, 3, 4096):
        found = {f: f for f in fps}

        def root(x):
            while found[x] != x:
                x = found[x]
            return x

        for a, b in similar_edges(nodes, most).collect():
            found[root(a % (1 << 64))] = root(b % (1 << 64))
        groups, expected = defaultdict(set), defaultdict(set)
        for f in fps:
            groups[root(f)].add(f)
            expected[want[f]].add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, (1 << 64) - 1), st.lists(st.integers(0, 63), max_size=3))
def test_ring_keys_hold_every_pair_within_three_bits(a, bits):
    b = a
    for k in set(bits):
        b ^= 1 << k
    for level in range(len(LEVELS)):
        assert any(not (a ^ b) & m for _, m in ring_masks(level))
    starts = {i for i, m in ring_masks(0) if not (a ^ b) & m}
    if a != b:
        assert any(linked(np.array([a, b], np.uint64), i) for i in starts)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abC \n\tÉß<>|.1", max_size=60))
def test_fingerprint(text):
    assert fingerprint(text, byte_bit_table()) == plain_fingerprint(text)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer(*tokenizer_paths())


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" \n\t\r 　aZé1.,'-<|>endoftxé日́", max_size=60)))
def test_tokenizer_equals_the_library(tokenizer, text):
    want = tokenizer.whole.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokenizer(text), np.uint32).tolist() == want


def test_tokenizer_on_special_strings(tokenizer):
    for text in ("<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>b  c", " <|endoftext|>", "I'll don't x's 's"):
        assert np.frombuffer(tokenizer(text), np.uint32).tolist() == tokenizer.whole.encode(text, add_special_tokens=False).ids


def test_pack_documents(docs, nothing, tokenizer):
    got = pack_documents(docs).collect()
    want = Counter()
    for i, t, _ in TEXTS:
        ids = [*tokenizer.whole.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024)]
        for p, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)])):
            want[i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(sequences) == lower_bound(Counter(r["length"] for r in got), 1024)
    assert pack_documents(nothing).collect() == []


def plain_bins(items, capacity):
    items, best = sorted(items, reverse=True), len(items)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins) if b + items[i] <= capacity}.values():
            put(i + 1, [*bins[:j], bins[j] + items[i], *bins[j + 1 :]])
        put(i + 1, [*bins, items[i]])

    put(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.integers(8, 40), st.lists(st.integers(1, 40), max_size=9))
def test_packing_is_optimal_on_small_cases(capacity, items):
    counts = Counter(min(x, capacity) for x in items)
    for limit in (5000, None):
        plan, used = pack(dict(counts), capacity, limit), Counter()
        for filling, times in plan.fillings:
            assert sum(filling) <= capacity
            for n in filling:
                used[n] += times
        assert used == counts
        assert sum(t for _, t in plan.fillings) == plan.bins == plain_bins(list(counts.elements()), capacity) <= sum(t for _, t in best_fit(dict(counts), capacity))
        assert plan.gap >= 0 and (plan.complete or limit)


def test_packing_reports_its_gap():
    rng = np.random.default_rng(1)
    counts = Counter(rng.integers(200, 700, 3000).tolist())
    few, more = (pack(dict(counts), 1024, limit) for limit in (50, 5000))
    assert few.nodes <= 50 and not few.complete and few.gap >= more.gap > -1
    assert sum(n * t for f, t in more.fillings for n in f) == sum(n * c for n, c in counts.items())


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return load_model(public_tokenizers.path("piece_bpe_32k.model"))


def test_no_piece_reaches_over_the_start_of_spaces(model):
    assert not [p for p in map(model.id_to_piece, range(model.get_piece_size())) if "▁" in p.lstrip("▁")]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="  \n\tabcéthe<s>/unk日　", max_size=60)))
def test_pretoken_counts_equal_the_library(model, text):
    lengths = Lengths(model, {"the": 1})
    want = len(model.encode(text))
    assert (0 if not text else want if "▁" in text else sum(map(lengths.__getitem__, pretokens(text)))) == want


def test_count_tokens(docs, nothing, model):
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t, _ in TEXTS]
    assert rows(count_tokens(docs)) == sorted(want, key=repr)
    assert rows(count_tokens(nothing)) == []


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest, w = total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else weight[s] * rest / w for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix_sources(docs, nothing):
    sizes = defaultdict(int)
    for _, t, s in TEXTS:
        sizes[s] += len(WORD.findall(t or ""))
    target, got = plain_targets(sizes), mix_sources(docs).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"]) == sorted((i, len(WORD.findall(t or ""))) for i, t, _ in TEXTS if i)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == int(target[s]) for s in sizes)
    assert rows(mix_sources(docs)) == sorted(map(tuple, got), key=repr)
    assert rows(mix_sources(nothing)) == []


def test_mix_many_sources_and_none_with_words(spark):
    given = [(i, "w " * (i % 17 * (1 + i % 5)), f"s{i % 61:03d}" if i % 61 else None) for i in range(400)]
    for docs in (given, [(i, None, s) for i, _, s in given]):
        sizes = Counter()
        for _, t, s in docs:
            sizes[s] += len((t or "").split())
        target = plain_targets(dict(sizes)) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
        got = mix_sources(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
        assert all(r["target"] == pytest.approx(target[r["source"]]) for r in got) and len(got) == len(docs)


def test_tokenizer_on_whole_documents(spark, tokenizer):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in [*texts, LONG]:
        assert np.frombuffer(tokenizer(text or ""), np.uint32).tolist() == tokenizer.whole.encode(text or "", add_special_tokens=False).ids


def test_intermediate_tables_lie_in_one_folder(spark):
    from pathlib import Path

    from keepsight.llm.tables import Table, clear, keep, scope, shared_dir

    t = Table(spark.range(3).toDF("x"), "numbers")
    assert t.path.startswith(shared_dir(spark)) and t.read().count() == 3
    t.drop()
    assert not Path(t.path.removeprefix("file://")).exists()
    with scope():
        inner, outer = (Table(spark.range(3).toDF("x"), "numbers") for _ in range(2))
        keep(outer)
    assert not Path(inner.path.removeprefix("file://")).exists() and outer.read().count() == 3
    clear(spark)
    assert not Path(shared_dir(spark).removeprefix("file://")).exists()


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from keepsight.llm.tables import shared_dir

    none = SimpleNamespace(get=lambda *_: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(SimpleNamespace(conf=none, sparkContext=SimpleNamespace(getConf=lambda: none, applicationId="a", master=master)))
