"""Each stage of the pipeline on what its predecessor kept, against brute force."""

import collections

import pytest

import corpus_pipeline
from tests.llm.test_contract import SPACE, WORD, brute_classes, naive_mix, naive_statistics
from voxmill.llm import quality_rules, queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    docs, out = queries.table(spark, sf, "documents"), {"documents": queries.table(spark, sf, "documents")}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{root}/{name}")
        docs = out[name] = spark.read.parquet(f"{root}/{name}")
    return out


def rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_order_and_columns(stages):
    assert list(stages) == ["documents", "quality_rules", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert all(df.columns == COLUMNS for name, df in stages.items() if name != "packing")


def test_quality(spark, sf, stages):
    verdict = quality_rules.fit_verdict(stages["documents"], queries.table(spark, sf, "labels"))
    found = {r.doc.doc_id: r.kept for r in quality_rules.judge(stages["documents"], verdict).collect()}
    left = {r.doc_id for r in stages["quality_rules"].collect()}
    assert left == {i for i, kept in found.items() if kept} and len(left) > 100
    for i, text, _ in rows(stages["documents"]):
        n, _, _, _, again = naive_statistics(text)
        assert i not in left or (n >= 50 and 100 * again <= 50 * n)


def test_exact(stages):
    groups = collections.defaultdict(list)
    for i, text, _ in rows(stages["quality_rules"]):
        groups[SPACE.sub(" ", text)].append(i)
    assert sorted(r.doc_id for r in stages["exact_dedup"].collect()) == sorted(min(x) for x in groups.values())


def test_near(stages):
    classes = brute_classes(rows(stages["exact_dedup"]))
    assert sorted(r.doc_id for r in stages["near_dedup"].collect()) == sorted({c for _, c, _ in classes})


def test_mix(stages):
    want = naive_mix(rows(stages["near_dedup"]), corpus_pipeline.MAX_REPETITION)
    assert sorted(r.doc_id for r in stages["mixing"].collect()) == sorted(i for i, _, _ in want)


def test_pack(stages):
    read = collections.Counter(r.doc_id for r in stages["mixing"].collect())
    lengths, ends = collections.Counter(), collections.Counter()
    for r in stages["packing"].collect():
        lengths[r.doc_id] += r.length
        ends[r.doc_id] += r.input_ids[-4:] == b"\2\0\0\0" and r.start + r.length == r.doc_tokens
    assert ends == read
    assert all(lengths[i] >= n for i, n in read.items())


def test_run_is_the_stages(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf)
    key = lambda r: (r.doc_id, r.start, r.length, r.doc_tokens)
    assert sorted(map(key, got.collect())) == sorted(map(key, stages["packing"].collect()))
    assert WORD.findall("a b") == ["a", "b"]


AWKWARD = [
    (None, None, None, None, None),
    (1, None, "en", "a", 0),
    (2, "", "en", None, 0),
    (None, "no id " * 60, "en", "a", 5),
    (None, "no id " * 60, "en", "a", 5),
    *((i, " ".join(f"w{i}x{k}" for k in range(80)) + ".", "en", "ab"[i % 2], 1) for i in range(3, 12)),
    (20, " ".join(f"long{k % 4001} end{k}" for k in range(60_000)), "en", "b", 1),
    (20, " ".join(f"long{k % 4001} end{k}" for k in range(60_000)), "en", "b", 1),
    (21, " ".join(f"long{k % 4001} end{k}" for k in range(60_000)) + " more", "en", None, 1),
]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_bear_awkward_rows(spark, sf, tmp_path, name):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, spark.createDataFrame([], schema), sf).count() == 0
    spark.createDataFrame(AWKWARD, schema).repartition(3).write.parquet(f"{tmp_path}/a")
    got = [(r.doc_id, None if name == "packing" else r.text) for r in stage(spark, spark.read.parquet(f"{tmp_path}/a"), sf).collect()]
    ids = collections.Counter(i for i, _ in got)
    if name == "quality_rules":
        assert not any(t is None or len(t.split()) < 50 for _, t in got) and all(ids[i] for i in range(3, 12))
    elif name == "exact_dedup":
        # texts: null and empty; "no id"; nine; two long ones
        assert len(got) == 2 + 9 + 2 and ids[1] == ids[20] == ids[21] == 1 and ids[None] == 1
    elif name == "near_dedup":
        assert sorted(i for i in ids if i is not None) == [1, *range(3, 12), 20] and len(got) == len(ids) == 12
    elif name == "mixing":
        assert all(ids[r[0]] >= 1 for r in AWKWARD) and len(got) >= len(AWKWARD)
    else:
        assert ids[1] == ids[2] == 1 and ids[None] == 3 and ids[20] == 2 * ids[21] > 2


def test_mixing_hands_its_order_on(spark, sf, tmp_path):
    docs = queries.table(spark, sf, "documents")
    from voxmill.llm import mixing

    want = mixing.mix_sources(docs, max_repetition=corpus_pipeline.MAX_REPETITION).orderBy("mix_slot", "mix_order", "doc_id")
    place = {}
    for r in want.collect():
        place.setdefault(r.doc_id, set()).add((r.mix_slot, r.mix_order))
    got = [r.doc_id for r in corpus_pipeline.mix(spark, docs, sf).collect()]
    at, bad = (0.0, ""), 0
    for i in got:
        later = sorted(p for p in place[i] if p >= at)
        bad += not later
        at = later[0] if later else at
    assert bad == 0
