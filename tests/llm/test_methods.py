"""The methods behind the operators: expectation-maximisation, forest, packing and offsets, against plain versions."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures
from voxmill.llm import chat, common, line_dedup, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, queries, secrets
from voxmill.llm.gazetteers import Gazetteers

SF01 = "/root/testdata/sf0.01"


# --- quality rules ---------------------------------------------------------------------------------------------------


def test_verdicts_do_not_depend_on_the_layout(spark, sf, tmp_path):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    twice = docs.union(docs.limit(40).withColumn("text", F.concat("text", F.lit(" again"))))  # ids that repeat
    twice.write.parquet(f"{tmp_path}/d")
    got = []
    for n in (1, 5, 13):
        moved = spark.read.parquet(f"{tmp_path}/d").repartition(n, F.xxhash64("text", F.lit(n)))
        verdict = quality_rules.fit_verdict(moved, labels.repartition(n + 1), fit_rows=60)
        judged = quality_rules.judge(moved, verdict).select("doc.doc_id", "n_words", "score", "kept")
        got.append((verdict.threshold, sorted(map(tuple, judged.collect()))))
    assert got[0] == got[1] == got[2] and got[0][0] < 1


def plain_score(forest, row):
    """Mean path length of one row, walked node by node, turned into a score."""

    def expected(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    total = 0.0
    for feature, cut, left, right, depth in forest.trees:
        at = 0
        while feature[at] >= 0:
            at = left[at] if row[feature[at]] < cut[at] else right[at]
        total += depth[at]
    return 2.0 ** (-total / len(forest.trees) / expected(forest.sample))


def test_forest_scores_like_a_plain_walk():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(300, 4))
    forest = quality_rules.IsolationForest(rows, trees=20, sample=64)
    probe = np.vstack([rows[:50], rows[:10] + 8])
    assert np.allclose(forest.score(probe), [plain_score(forest, r) for r in probe])
    assert forest.score(probe)[50:].min() > np.median(forest.score(rows))  # far rows are isolated early
    for feature, cut, left, right, depth in forest.trees:  # a leaf's depth is its level and what its rows would add
        level = {0: 0}
        for i in range(len(feature)):
            if feature[i] >= 0:
                level[left[i]] = level[right[i]] = level[i] + 1
        assert all(depth[i] >= level[i] for i in level if feature[i] < 0)


def test_threshold_holds_on_labels_not_seen(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    verdict = quality_rules.fit_verdict(docs, labels.filter(half == 0))
    judged = quality_rules.judge(docs, verdict).select("doc.doc_id", "kept", "base_failed").join(labels.filter(half == 1), "doc_id").collect()
    good = [r.kept for r in judged if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in judged if r.quality == 0]
    assert len(good) > 100 and sum(good) >= 0.97 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_threshold_is_the_least_that_spares_good_rows():
    scores, good = np.array([0.1, 0.2, 0.3, 0.35, 0.6, 0.9]), np.array([True, True, True, False, True, False])
    assert quality_rules.calibrated(scores, good, 0.0) == pytest.approx(0.75)
    assert quality_rules.calibrated(scores, good, 0.25) == pytest.approx(0.325)


def test_every_labelled_row_counts(spark):
    """Forest and threshold of 5000 labelled rows are those of all their ratios in one array."""
    rng = random.Random(11)
    words = ["oak", "river", "stone", "walks", "quietly", "Amber", "LOUD", "seven!", "#tag", "hill."]
    made = [(i, " ".join(rng.choices(words, k=rng.randint(8, 40))), int(i % 9 > 0)) for i in range(5000)]
    docs = spark.createDataFrame([r[:2] for r in made], "doc_id long, text string")
    verdict = quality_rules.fit_verdict(docs, spark.createDataFrame([r[::2] for r in made], "doc_id long, quality int"))
    values = np.array([quality_rules.ratios(quality_rules.statistics(t)) for _, t, _ in made])
    good = np.array([q == 1 for _, _, q in made])
    plain = quality_rules.IsolationForest(values[good])
    assert verdict.forest.sample == plain.sample == good.sum()
    assert all(np.array_equal(a, b) for x, y in zip(verdict.forest.trees, plain.trees, strict=True) for a, b in zip(x, y, strict=True))
    assert verdict.threshold == quality_rules.calibrated(plain.score(values), good)
    for feature, cut, left, right, depth in plain.trees[:3]:  # nodes hold the rows that a walk brings there
        count = collections.Counter()
        for row in values[good]:
            at = 0
            while feature[at] >= 0:
                at = left[at] if row[feature[at]] < cut[at] else right[at]
            count[at] += 1
        assert sum(count.values()) == good.sum()
        assert all(depth[at] == pytest.approx(int(math.log2(at + 1)) + quality_rules._mean_path(n)) for at, n in count.items())


def test_threshold_of_a_table_is_that_of_an_array(spark):
    rng = np.random.default_rng(5)
    for n, step in ((400, 1e-17), (400, 0.05), (9, 0.2)):  # close together, many ties, few
        scores, good = 0.5 + np.round(rng.random(n) / step) * step * 0.4, rng.random(n) < 0.8
        lines = [(int(g), int(b)) for g, b in zip(good, scores.view(np.int64), strict=True)]
        table = spark.createDataFrame(lines, "label int, bits long")
        for part in (0.0, 0.002, 0.3):
            assert quality_rules.calibrated_spread(table, part) == quality_rules.calibrated(scores, good, part)


# --- quality classifier ----------------------------------------------------------------------------------------------


def test_estimate_recovers_how_labellers_err():
    rng = np.random.default_rng(3)
    looks = [{0}, {0}, {0}, {1}, {1}, {1}]
    share = [0.85, 0.10, 0.05]
    true = np.array([[0.3, 0.02, 0.02, 0.02, 0.02, 0.02], [0.9, 0.8, 0.7, 0.05, 0.05, 0.05], [0.3, 0.05, 0.05, 0.8, 0.9, 0.7]])
    n = 20_000
    of = rng.choice(3, n, p=share)
    vote = np.where(rng.random((n, 6)) < 0.1, quality_classifier.NONE, np.where(rng.random((n, 6)) < true[of], 0, 1))
    counted = collections.Counter((vote @ 3 ** np.arange(5, -1, -1)).tolist())
    found = quality_classifier.estimate(sorted(counted), [counted[p] for p in sorted(counted)], looks, 2)
    assert np.abs(found.share - share).max() < 0.01 and np.abs(found.bad_rate - true)[:, :].max() < 0.06
    # The first labeller errs on 30 % of the good texts; where it alone objects, the text is good.
    assert dict(zip(sorted(counted), found.good, strict=True))[int("011111", 3)] > 0.95


def plain_em(votes, counts, first, prior, share, own_first, rounds):
    """Expectation-maximisation in plain loops; classes by rows of ``first``; vote 0 is bad, 1 good, 2 none."""
    rate, share = [list(r) for r in first], list(share)
    for _ in range(rounds):
        post = []
        for v in votes:
            like = []
            for c, s in enumerate(share):
                x = s
                for i, one in enumerate(v):
                    x *= {0: rate[c][i], 1: 1 - rate[c][i], 2: 1.0}[one]
                like.append(x)
            post.append([x / sum(like) for x in like])
        for c in range(len(share)):
            for i in range(len(first[0])):
                bad = sum(n * p[c] for v, n, p in zip(votes, counts, post, strict=True) if v[i] == 0)
                all_ = sum(n * p[c] for v, n, p in zip(votes, counts, post, strict=True) if v[i] != 2)
                rate[c][i] = (bad + prior * first[c][i]) / (all_ + prior)
            share[c] = (sum(n * p[c] for n, p in zip(counts, post, strict=True)) + 1) / (sum(counts) + len(share))
    return post, rate, share


def test_estimate_is_plain_expectation_maximisation():
    rng = random.Random(4)
    patterns = sorted(rng.sample(range(81), 30))
    counts = [rng.randrange(1, 50) for _ in patterns]
    looks = [{0}, {0}, {1}, {0, 1}]
    q = quality_classifier
    first = [[q.BAD_IN_GOOD] * 4] + [[q.BAD_IN_OWN if k in x else q.BAD_IN_OTHER for x in looks] for k in range(2)]
    votes = [[p // 27 % 3, p // 9 % 3, p // 3 % 3, p % 3] for p in patterns]
    post, rate, share = plain_em(votes, counts, first, q.PRIOR_TEXTS, [0.9, 0.05, 0.05], None, 12)
    found = q.estimate(patterns, counts, looks, 2, rounds=12)
    assert np.allclose(found.good, [p[0] for p in post]) and np.allclose(found.bad_rate, rate) and np.allclose(found.share, share)


# --- personal data ---------------------------------------------------------------------------------------------------


def test_reliability_is_plain_expectation_maximisation():
    rng = random.Random(5)
    votes = [[rng.randrange(3) for _ in pii.LABELLERS] for _ in range(40)]
    counts = [rng.randrange(1, 60) for _ in votes]
    first = [[1 - x for x in row] for row in zip(*pii.FIRST_RATES, strict=True)]  # plain_em counts vote 0, which is no
    post, rate, share = plain_em(votes, counts, first, pii.PRIOR_VOTES, [0.5, 0.5], None, 9)
    found = pii.reliability(np.array(votes), np.array(counts), rounds=9)
    assert np.allclose(found.posterior, [p[1] for p in post]) and np.allclose(1 - found.yes_rate, rate)
    assert found.share == pytest.approx(share[1])


def test_reliability_recovers_how_labellers_err():
    rng = np.random.default_rng(6)
    n, share = 30_000, 0.3
    true = np.array([[0.15, 0.4, 0.02, 0.5, 0.6], [0.97, 0.75, 0.6, 0.9, 0.98]])
    of = (rng.random(n) < share).astype(int)
    votes = np.where(rng.random((n, 5)) < 0.05, pii.NONE, (rng.random((n, 5)) < true[of]).astype(int))
    unique, counts = np.unique(votes, axis=0, return_counts=True)
    found = pii.reliability(unique, counts)
    assert abs(found.share - share) < 0.02 and np.abs(found.yes_rate - true).max() < 0.03


def planted_personal_data(n, seed=8):
    """Texts with personal data that no base pattern finds, and texts with what looks alike; (text, spans of the first)."""
    rng = random.Random(seed)
    given, family = sorted(Gazetteers().given), sorted(Gazetteers().family)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(3, 9)))
    fill = lambda: " ".join(word() for _ in range(rng.randrange(5, 15)))
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def iban():
        body = "50010517" + number(10)
        check = 98 - int(body + "131400") % 97
        return f"DE{check:02d} " + " ".join((body + "  ")[i : i + 4].strip() for i in range(0, 18, 4))

    real = [
        lambda: ("please call my phone ", f"({rng.randrange(2, 10)}{number(2)}) {rng.randrange(2, 10)}{number(2)}-{number(4)}"),
        lambda: ("my bank account is ", iban()),
        lambda: ("signed by ", f"{rng.choice(['Mr', 'Dr.', 'Frau'])} {rng.choice(given)} {rng.choice(family)}"),
        lambda: ("my email address is ", f"{word()} [at] {word()} [dot] com"),
    ]
    decoy = [
        lambda: ("the total was ", f"1{number(2)} {number(3)} {number(4)}"),
        lambda: ("the order number is ", f"QX{number(2)} {number(4)} {number(4)} {number(4)}"),
        lambda: ("so it went ", " ".join(word().capitalize() for _ in range(3))),
        lambda: ("meet me at ", f"{word()} at {word()} dot {word()[:4]}ab"),
    ]
    out = []
    for i in range(n):
        parts, spans, at = [], [], 0
        for make in rng.sample(real if i % 2 else decoy, 2):
            before, found = make()
            lead = f"{fill()} {before}"
            parts.append(f"{lead}{found} , ")
            if i % 2:
                spans.append((at + len(lead), at + len(lead) + len(found)))
            at += len(parts[-1])
        out.append(("".join(parts) + fill(), spans))
    return out


def test_precision_and_recall_of_added_spans(spark):
    planted = planted_personal_data(600)
    rows = [(i, t) for i, (t, _) in enumerate(planted)]
    found = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    got = {(i, s.start, s.end) for i, x in found.items() for s in x if not s.base}
    want = {(i, *s) for i, (_, spans) in enumerate(planted) for s in spans}
    hit = len(got & want)
    assert hit >= 0.95 * len(want) and hit >= 0.95 * len(got)


def test_all_spans_are_voted_on(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = pii.candidate_rows(docs, "doc_id", "text", Gazetteers()).collect()
    n_base = sum(x.r < len(pii.BASE_KINDS) for r in held for x in r.found)
    assert n_base == sum(len(pii.base_spans(r.text or "")) for r in docs.collect()) > 0
    assert sum(len(r.found) for r in held) > n_base
    spans = [s for r in pii.find_personal_data(docs).collect() for s in r.spans if s.base]
    assert len(spans) == n_base and min(s.score for s in spans) > 0.8  # the classifier learns them from the votes


def test_gazetteers_may_be_replaced(spark):
    docs = spark.createDataFrame([(i, f"then came Mr Zorblat Quux{'abcdefghij'[i % 10]} signed and left") for i in range(60)], "doc_id long, text string")
    lists = Gazetteers(given=frozenset(["Zorblat"]))
    with_it = pii.find_personal_data(docs, lists=lists).filter(F.size("spans") > 0).count()
    assert with_it == 60


# --- secrets ---------------------------------------------------------------------------------------------------------


def test_offsets_of_very_many_matches(spark):
    text = "é " + " ".join(f"😀 AKIA{i:020d} password = x{i}yz{i}a" for i in range(700))
    (got,) = secrets.find_secrets(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).collect()
    want = [(m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text)]
    assert [(s.start, s.end) for s in got.spans if s.kind == "access"] == want


def test_owners_and_repositories_decide(spark):
    key = lambda c: "AKIA" + c * 20
    rows = [(i, key("A"), "o1", f"r{i}") for i in range(9)]  # one owner, many repositories: live
    rows += [(10 + i, key("B"), f"o{i % 2}", f"r{i}") for i in range(6)]  # two owners, six repositories: copied
    rows += [(20 + i, key("C"), f"o{i}", "r") for i in range(2)]  # two owners, two repositories: live
    rows += [(30 + i, key("D"), f"o{i}", "r") for i in range(3)]  # three owners: copied
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    got = {r.doc_id: r.spans[0] for r in secrets.find_secrets(docs, repo_col="repo").collect()}
    assert [(got[i].live, got[i].n_owners, got[i].n_repos) for i in (0, 10, 20, 30)] == [(True, 1, 9), (False, 2, 6), (True, 2, 2), (False, 3, 3)]


def test_long_credentials_in_urls(spark):
    user, secret = "u" * 200, "p" * 500
    docs = spark.createDataFrame([(1, f"see ftp://{user}:{secret}@host", "s")], "doc_id long, text string, source string")
    (row,) = secrets.find_secrets(docs).collect()
    assert [(s.kind, s.start, s.end) for s in row.spans] == [("url", 7, 7 + 3 + 200 + 1 + 500 + 1)]


def test_hot_keys_join_like_others(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "HOT_LEAST", 2)
    monkeypatch.setattr(common, "FEW_ROWS", 0)
    monkeypatch.setattr(common, "HOT_PARTS", 4)
    left = spark.createDataFrame([(i, "a" if i < 40 else f"k{i % 7}" if i % 5 else None) for i in range(70)], "i long, k string")
    right = spark.createDataFrame([("a", 1), *((f"k{i}", i) for i in range(5))], "k string, v long")
    scratch = common.Scratch(spark, "test")
    left = scratch.put(left, "left")
    for how in ("inner", "left"):
        got = common.join_hot(left, right, ["k"], how)
        want = left.join(right, ["k"], how)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda *a: None)

    class Session:
        conf = Conf

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError):
        common.scratch_root(Session)


# --- packing ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 8, 97])
def test_little_padding_however_many_partitions(spark, sf, n):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(n)
    got = packing.pack_documents(docs, queries.word_tokenizer(), window=1024).collect()
    windows = collections.defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    for placed in windows.values():
        assert [o for o, _ in sorted(placed)] == [sum(x for _, x in sorted(placed)[:i]) for i in range(len(placed))]
    assert sum(r.length for r in got) >= 0.97 * 1024 * len(windows)


def test_groups_of_the_second_round(spark, sf, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 20)
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(31)
    got = packing.pack_documents(docs, queries.word_tokenizer()).collect()
    tokens = collections.Counter()
    for r in got:
        tokens[r.sequence_id] += r.length
    assert max(tokens.values()) <= 4096 and sum(r.start == 0 for r in got) == docs.count()
    assert len({s >> 32 for s in tokens if s < 0}) > 3


def test_packing_with_clashing_names(spark):
    docs = fixtures.awkward(spark).withColumn("start", F.lit(1)).withColumn("piece", F.lit(2)).withColumn("_piece", F.lit(3))
    got = packing.pack_documents(docs, queries.word_tokenizer())
    assert got.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "input_ids"]
    assert got.filter("start = 0").count() == docs.count()


# --- both sides of each switch that a size throws -------------------------------------------------------------------------


def test_joins_by_shuffle_give_what_broadcasts_give(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    work = {
        line_dedup: lambda: line_dedup.remove_repeated_chunks(docs).select("doc_id", "text", "line_n_removed"),
        near_dedup: lambda: near_dedup.near_classes(docs).select("doc_id", "class_id", "class_size", "kept"),
        mixing: lambda: mixing.mix_sources(docs, max_repetition=2.0).select("doc_id", "mix_epoch", "mix_order"),
    }
    for module, run in work.items():
        small = sorted(map(str, run().collect()))
        monkeypatch.setattr(module, "BROADCAST_ROWS", -1)
        assert sorted(map(str, run().collect())) == small


def test_places_are_cut_in_two_steps(spark, monkeypatch):
    """However many first digits are used, the same documents are read."""
    rows = [(i, "w " * (i % 13), "big" if i < 900 else f"small{i % 3}") for i in range(1100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = []
    for digits in (1, 4, 12):
        monkeypatch.setattr(mixing, "_DIGITS", digits)
        mixed = mixing.mix_sources(docs, target_entropy=1.9, budget=2500, n_blocks=3)
        got.append(sorted((r.doc_id, r.mix_epoch) for r in mixed.collect()))
    assert got[0] == got[1] == got[2] and 0 < len(got[0])


def test_too_many_epochs_are_an_error(spark):
    rows = [(1, "w", "tiny"), *((i, "w " * 5000, "big") for i in range(2, 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="read"):
        mixing.mix_sources(docs, target_entropy=1.0)


def test_digests_that_clash_are_told_apart(spark, monkeypatch):
    """If digests of repeated parts were alike, their bytes would be compared in the join, too."""
    from pyspark.sql import functions

    long = [" ".join(f"v{k}x{i}" for i in range(60)) for k in range(3)]
    docs = spark.createDataFrame([(i, f"a{i}\n{long[i % 3]}\nb{i}") for i in range(9)], "doc_id long, text string")
    want = sorted(map(tuple, line_dedup.remove_repeated_chunks(docs).select("doc_id", "text").collect()))
    real = functions.xxhash64
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long") if "body" in map(str, c) else real(*c))
    assert sorted(map(tuple, line_dedup.remove_repeated_chunks(docs).select("doc_id", "text").collect())) == want
    assert sum(len(t.split()) < 10 for _, t in want) == 6


# --- chat ------------------------------------------------------------------------------------------------------------


def test_chat_bears_awkward_tables(spark):
    schema = "conv_id long, turn long, role string, text string, example long, formatted string, _conv long, w string"
    assert chat.chat_examples(spark.createDataFrame([], schema)).count() == 0
    extra = (1, "x", 2, "y")
    rows = [(1, 0, "user", "hi", *extra), (1, 1, "assistant", "same", *extra), (1, 1, "assistant", "same", *extra), (2, None, None, None, *extra)]
    rows += [(3, 0, "user", "w" * 300_000, *extra), (3, 1, "assistant", "\\" * 5, *extra)]
    got = collections.defaultdict(list)
    for r in chat.chat_examples(spark.createDataFrame(rows, schema)).collect():
        got[r.conv_id].append(r)
    assert [(r.trainable, r.formatted[r.loss_start : r.loss_end]) for r in sorted(got[1], key=lambda r: r.example)] == [(True, "same")] * 2
    assert [(r.trainable, r.last) for r in got[2]] == [(False, True)] and got[2][0].formatted == "<|im_start|>\n<|im_end|>\n"
    assert len(got[3][0].formatted) > 300_000 and got[3][0].formatted[got[3][0].loss_start : got[3][0].loss_end] == "\\" * 10
    clash = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string").withColumn("line_n_lines", F.lit(0))
    with pytest.raises(ValueError, match="prefix"):
        line_dedup.remove_repeated_chunks(clash)
    assert "line_n_lines" in line_dedup.remove_repeated_chunks(clash, prefix="out_").columns
