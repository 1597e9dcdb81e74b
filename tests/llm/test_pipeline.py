"""Stages of the corpus pipeline on small documents."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tokenizers
from test_text_operators import plain_fingerprint, plain_targets

import corpus_pipeline
from keepsight.llm import stages
from keepsight.llm.packing import tokenizer_paths
from keepsight.llm.tables import text_key

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, row long, text_key long, taken long"


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."


def corpus():
    a, b = prose(1), prose(2, 3000)
    rows = [(1, a), (2, a.replace(" ", "\n", 3)), (3, a), (3, a), (4, b), (5, b + " tail"), (6, "### " * 80), (7, None), (8, ""), (9, prose(9, 30)), (None, prose(10)), (None, prose(10)), (12, "  " + prose(12)), (13, prose(13, 3000)), (14, prose(14)), (14, prose(15))]
    return [(i, t, "en", f"s{k % 3}" if k % 5 else None, len(t or ""), 1, 2, 3, 4) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def plain(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_keep_the_columns(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").schema.names == docs.schema.names, name
        assert stage(spark, docs.limit(0), "").collect() == []


def test_quality_keeps_clean_documents(docs):
    assert sorted(plain(stages.pass_quality(docs)).elements(), key=repr) == sorted((r for r in corpus() if r[1] and "###" not in r[1] and len(WORD.findall(r[1])) >= 50), key=repr)


def test_one_exact_copy_stays(docs):
    groups = defaultdict(list)
    for r in corpus():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r)
    got = list(plain(stages.drop_exact_copies(docs)).elements())
    assert sorted(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in got) == sorted(groups)
    assert {r[0] for r in got if r[1] and r[1][:20] == prose(1)[:20]} == {1}


def test_one_near_copy_stays(docs):
    got = list(plain(stages.drop_near_copies(docs)).elements())
    by_start = Counter((r[1] or "").split()[0] if (r[1] or "").split() else "" for r in got)
    assert max(by_start.values()) == 1 and by_start[""] == 1
    assert [r[0] for r in got if (r[1] or "").startswith(prose(2, 3000)[:20])] == [4]


def test_short_near_copies_go_only_within_three_bits(spark):
    """A word more in 120 changes 1, 2, 4 and 5 bits of these; those above three stay, as the README says."""
    rows = [(10 * seed + k, prose(seed) + tail) for seed in (20, 21, 22, 2) for k, tail in enumerate(("", " tail"))]
    got = stages.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == [20, 21, 200, 210, 220, 221]


def test_mix_takes_words_to_the_target(docs):
    from keepsight.llm.mixing import mix_sources

    taken = defaultdict(int)
    for r in mix_sources(docs).collect():
        taken[r["source"]] += r["taken"]
    got, texts = defaultdict(int), {r[1] for r in corpus()}
    for r in stages.mixed(docs).collect():
        got[r["source"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"]) and (r["text"] in texts or any(t and t.startswith(r["text"]) for t in texts))
    assert {s: n for s, n in taken.items() if n} == dict(got)


def plain_pipeline(rows):
    """(doc_id, piece, start, length, ids_crc32) of all pieces, by one plain step after another over lists of rows."""
    order = lambda r: (r[0] is None, r[0] or 0, text_key(r[1]))
    docs = [r for r in rows if r[1] and "###" not in r[1] and len(WORD.findall(r[1])) >= 50]
    groups = defaultdict(list)
    for r in docs:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1])].append(r)
    docs = [min(g, key=order) for g in groups.values()]
    fps = [plain_fingerprint(r[1]) for r in docs]
    label = list(range(len(docs)))
    for i, j in ((i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3):
        label = [label[j] if x == label[i] else x for x in label]
    groups = defaultdict(list)
    for r, x in zip(docs, label, strict=True):
        groups[x].append(r)
    docs = [min(g, key=order) for g in groups.values()]
    sources = defaultdict(list)
    for r in docs:
        sources[r[3]].append((hashlib.md5(f"mix-1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, len(WORD.findall(r[1])), text_key(r[1]), r))
    sizes = {s: sum(x[3] for x in xs) for s, xs in sources.items()}
    taken = []
    for s, target in plain_targets(sizes).items():
        epochs, rest = divmod(int(target), sizes[s])
        for x in sorted(sources[s], key=lambda x: x[:5]):
            part = min(x[3], rest)
            rest -= part
            taken += [(x[5][0], x[5][1])] * (epochs + (part == x[3]))
            if 0 < part < x[3]:
                taken.append((x[5][0], re.match(r"[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]*){%d}" % part, x[5][1])[0].rstrip(" \t\n\x0b\x0c\r")))
    whole, pieces = tokenizers.Tokenizer.from_file(tokenizer_paths()[0]), Counter()
    for doc, text in taken:
        ids = [*whole.encode(text, add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        for p, (start, end) in enumerate(zip(cuts, cuts[1:])):
            pieces[doc, p, start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes())] += 1
    return pieces


def test_run(spark, docs, tmp_path):
    """Every piece is the plain version's; sequences are full bins without gaps, as few as best fit needs."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out, want = corpus_pipeline.run(spark, str(tmp_path)).collect(), plain_pipeline(corpus())
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want and len(want) > 20
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in bins.values():
        assert [o for o, _ in sorted(placed)] == [0, *np.cumsum([n for _, n in sorted(placed)])[:-1]] and sum(n for _, n in placed) <= 1024
    room: list[int] = []
    for n in sorted((k[3] for k, times in want.items() for _ in range(times)), reverse=True):
        fits = [i for i, free in enumerate(room) if free >= n]
        i = min(fits, key=room.__getitem__) if fits else len(room)
        room[i:] = room[i:] or [1024]
        room[i] -= n
    assert len(bins) <= len(room)


def test_run_on_an_empty_table(spark, docs, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
