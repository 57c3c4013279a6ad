"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document; each kind of junk is looked for by
several.  Expectation-maximisation over the counts of vote patterns estimates how each labeller errs, with a weak
prior of fixed weight, and gives every pattern a posterior.  A linear scorer over hashed words and word shapes is then
trained on the posteriors, and scores every document.

The counts cover all documents; there are at most ``3 ** len(LABELLERS)`` patterns.  The scorer is trained on
at most ``fit_rows`` documents, those with the least hash of their id, each reduced to at most ``2**HASH_BITS``
counts before it reaches the driver.

Edge cases: a null text counts as empty; on an empty text all labellers abstain, and its score is the bias alone;
repeated rows are scored alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices
from .textstats import SYMBOLS, WORDS, Statistics, ratios, statistics

FIT_ROWS = 4096
HASH_BITS = 14
BAD, GOOD, NONE = 0, 1, 2
#: Rates of bad votes before any is seen: among good texts, of a labeller on junk that it looks for, and on other junk.
#: They weigh as PRIOR_TEXTS texts would, however large the corpus is, so votes soon outweigh them.
BAD_IN_GOOD, BAD_IN_OWN, BAD_IN_OTHER = 0.02, 0.7, 0.1
PRIOR_TEXTS = 20.0
#: Kinds of junk that labellers look for; each kind is looked for by several, so their errors can be told from it.
KINDS = ("symbols", "shouting", "repetition")

_MARK = re.compile("[" + re.escape(SYMBOLS) + "]")


def _band(value: float, bad_below: float, good_from: float, good_to: float, bad_above: float) -> int:
    if value < bad_below or value > bad_above:
        return BAD
    return GOOD if good_from <= value <= good_to else NONE


#: Name, kinds of junk looked for, and vote of each labeller, on the statistics, ratios and further shares (words with a
#: symbol, words of letters alone, words equal to the one before) of a text with at least five words.
LABELLERS = [
    ("symbols", {0}, lambda s, r, x: _band(r[0], 0, 0, 0.005, 0.02)),
    ("marked words", {0}, lambda s, r, x: _band(x[0], 0, 0, 0.02, 0.15)),
    ("plain words", {0, 1}, lambda s, r, x: _band(x[1], 0.55, 0.70, 1.0, 1.0)),
    ("upper case", {1}, lambda s, r, x: _band(r[1], 0, 0, 0.15, 0.35)),
    ("shouting", {1}, lambda s, r, x: _band(r[6], 0, 0, 0.05, 0.25)),
    ("repeats", {2}, lambda s, r, x: _band(r[2], 0, 0, 0.10, 0.40)),
    ("repeated lines", {2}, lambda s, r, x: BAD if r[3] > 0.5 else NONE),
    ("variety", {2}, lambda s, r, x: _band(r[4], 0.65, 0.80, 1.0, 1.0) if s.n_words >= 20 else NONE),
    ("stutter", {2}, lambda s, r, x: _band(x[2], 0, 0, 0.02, 0.15)),
    ("word length", set(), lambda s, r, x: _band(r[5], 2.0, 3.0, 9.0, 14.0)),
    ("sentences", set(), lambda s, r, x: GOOD if 0.01 <= s.n_sentence_ends / s.n_words <= 0.35 else NONE),
]


def votes(words: list[str], s: Statistics) -> int:
    """The votes of all labellers on a text with these words and statistics, as one number in base 3."""
    if s.n_words < 5:
        return int("2" * len(LABELLERS), 3)
    shares = (
        sum(map(bool, map(_MARK.search, words))) / s.n_words if s.n_symbols else 0.0,
        sum(map(str.isalpha, words)) / s.n_words,
        sum(map(eq, words, islice(words, 1, None))) / s.n_words,
    )
    r, out = ratios(s), 0
    for _, _, vote in LABELLERS:
        out = 3 * out + vote(s, r, shares)
    return out


def _unpacked(patterns: list[int], n: int) -> np.ndarray:
    out = np.empty((len(patterns), n), np.int8)
    rest = np.array(patterns, np.int64)
    for i in range(n - 1, -1, -1):
        out[:, i] = rest % 3
        rest //= 3
    return out


class Estimate(NamedTuple):
    """What expectation-maximisation finds: each pattern's posterior of being good, the share of each class (good first,
    then the kinds of junk), and each labeller's rate of bad votes in each class (class by labeller)."""

    good: np.ndarray
    share: np.ndarray
    bad_rate: np.ndarray


def estimate(patterns: list[int], counts: list[int], looks_for: list[set[int]], n_kinds: int, rounds: int = 2000) -> Estimate:
    """Expectation-maximisation over the counts of vote patterns.

    A labeller that abstains says nothing.  There is one class of good texts and one for each kind of junk, and votes
    are independent given the class.  Every labeller has a rate of bad votes in every class, with a weak prior that is
    high where it looks for that kind.  A labeller that objects where the others of its kind do not is thus found to
    err, and so is one that misses what they see.
    """
    n = len(looks_for)
    own = np.array([[k in x for x in looks_for] for k in range(n_kinds)])
    first = np.vstack([np.full(n, BAD_IN_GOOD), np.where(own, BAD_IN_OWN, BAD_IN_OTHER)])
    rate, share = first.copy(), np.append(0.9, np.full(n_kinds, 0.1 / n_kinds))
    if not patterns:
        return Estimate(np.zeros(0), share, rate)
    vote, weight = _unpacked(patterns, n), np.array(counts, float)
    is_bad, is_good = (vote == BAD).astype(float), (vote == GOOD).astype(float)
    post = np.zeros((len(patterns), n_kinds + 1))
    for _ in range(rounds):
        log = np.log(share) + is_bad @ np.log(rate).T + is_good @ np.log1p(-rate).T
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        done = np.abs(new - post).max() < 1e-7
        post = new
        mass = weight[:, None] * post
        rate = (mass.T @ is_bad + PRIOR_TEXTS * first) / (mass.T @ (is_bad + is_good) + PRIOR_TEXTS)
        share = (mass.sum(0) + 1) / (weight.sum() + n_kinds + 1)
        if done:
            break
    return Estimate(post[:, 0], share, rate)


_SHAPE = re.compile("[a-zà-öø-ÿ]+")


def _slots(word: str) -> tuple[int, int]:
    """Where a word and its shape are counted."""
    shape = _SHAPE.sub("a", word)[:12]
    mask = (1 << HASH_BITS) - 1
    return zlib.crc32(word.encode()) & mask, zlib.crc32(b"\0" + shape.encode()) & mask


#: A text's word counts are divided by at least this, so that a few words alone decide nothing.
LEAST_WORDS = 20
#: All bucket marks of a text together weigh as 6 / BUCKET_SHARE words would.
BUCKET_SHARE = 6.0


def _bucket_slots(s: Statistics) -> list[int]:
    """Where the tenths of a text's ratios are counted; bags of words show no repetition."""
    if not s.n_words:
        return []
    marks = (f"{i}:{int(10 * min(2.0, x))}" for i, x in enumerate(ratios(s)) if i != 5)
    return [zlib.crc32(b"\1" + m.encode()) & ((1 << HASH_BITS) - 1) for m in marks]


class _Memo(dict):
    """Values of words, worked out once each; starts afresh when it is large."""

    def __init__(self, value):
        super().__init__()
        self._value = value

    def __missing__(self, word: str):
        if len(self) > 250_000:
            self.clear()
        out = self[word] = self._value(word)
        return out


class Scorer:
    """A logistic model over the mean counts of hashed words and shapes."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self._memo = None

    def __getstate__(self):
        return self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def score(self, words: list[str], found: Statistics) -> float:
        if self._memo is None:
            values = self.weights.tolist()
            self._memo = _Memo(lambda word: sum(values[i] for i in _slots(word)))
        total = sum(map(self._memo.__getitem__, words)) / max(LEAST_WORDS, len(words))
        total += sum(self.weights[i] for i in _bucket_slots(found)) / BUCKET_SHARE
        return 1 / (1 + math.exp(-min(500.0, max(-500.0, self.bias + total))))


def train(features: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 300, rate: float = 40.0) -> Scorer:
    """Gradient descent on soft labels, both classes weighing alike."""
    weights, bias = np.zeros(1 << HASH_BITS), 0.0
    if not len(target):
        return Scorer(weights, bias)
    row = np.repeat(np.arange(len(features)), [len(i) for i, _ in features])
    slot = np.concatenate([i for i, _ in features]) if features else np.zeros(0, int)
    value = np.concatenate([v for _, v in features]) if features else np.zeros(0)
    share = min(0.99, max(0.01, float(target.mean())))
    importance = np.where(target > 0.5, 0.5 / share, 0.5 / (1 - share)) / len(target)
    for _ in range(rounds):
        z = bias + np.bincount(row, value * weights[slot], len(target))
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target) * importance
        weights -= rate * (np.bincount(slot, value * error[row], len(weights)) + 1e-6 * weights)
        bias -= error.sum()
    return Scorer(weights, bias)


def _counts(words: list[str], found: Statistics) -> tuple[list[int], list[float]]:
    got: dict[int, float] = defaultdict(float)
    for word, n in Counter(words).items():
        for slot in _slots(word):
            got[slot] += n / max(LEAST_WORDS, len(words))
    for slot in _bucket_slots(found):
        got[slot] += 1 / BUCKET_SHARE
    return list(got), list(got.values())


def _measured(text: pa.Scalar) -> tuple[list[str], Statistics]:
    """The words and statistics of one text of a batch."""
    text = text.as_py() or ""
    words = WORDS.findall(text)
    return words, statistics(text, words)


def classify_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS
) -> DataFrame:
    """One row per document: id, votes (base 3), weak_posterior, score, good."""
    kind = docs.schema[id_col].dataType
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def pattern(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: Counter[int] = Counter()
        for batch in batches:
            got.update(votes(words, found) for words, found in map(_measured, batch.column(0)))
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.int64())], ["votes", "n"])

    counted = source.select("text").mapInArrow(pattern, "votes long, n long").groupBy("votes").agg(F.sum("n").alias("n"))
    rows = sorted(counted.collect())
    found = estimate([r[0] for r in rows], [r[1] for r in rows], [x[1] for x in LABELLERS], len(KINDS))
    posterior = dict(zip([r[0] for r in rows], found.good.tolist(), strict=True))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            target, got = [], []
            for words, found in map(_measured, batch.column(0)):
                target.append(posterior[votes(words, found)])
                got.append(_counts(words, found))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(target, pa.float64()),
                    pa.array([np.array(i, np.int32).tobytes() for i, _ in got], pa.binary()),
                    pa.array([np.array(v, np.float32).tobytes() for _, v in got], pa.binary()),
                    batch.column(1),
                ],
                ["target", "slots", "parts", "mark"],
            )

    # The bound is found on ids alone, so no text is sorted; texts become counts where they are read, before the limit.
    mark = F.xxhash64("id")
    edge = source.select(mark.alias("m")).orderBy("m").limit(fit_rows).agg(F.max("m")).first()[0]
    fit = []
    if edge is not None:
        fit = (
            source.filter(mark <= edge).select("text", mark.alias("mark"))
            .mapInArrow(features, "target double, slots binary, parts binary, mark long")
            .orderBy("mark", "target", "slots", "parts").limit(fit_rows).collect()
        )
    scorer = train(
        [(np.frombuffer(r["slots"], np.int32), np.frombuffer(r["parts"], np.float32)) for r in fit],
        np.array([r["target"] for r in fit]),
    )
    sent = docs.sparkSession.sparkContext.broadcast((scorer, posterior))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = sent.value
        for batch in slices(batches):
            found, scores = [], []
            for words, measured in map(_measured, batch.column(1)):
                found.append(votes(words, measured))
                scores.append(model.score(words, measured))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(found, pa.int32()),
                    pa.array([known.get(v, 0.5) for v in found], pa.float64()),
                    pa.array(scores, pa.float64()),
                    pa.array([x >= 0.5 for x in scores], pa.bool_()),
                ],
                [id_col, "votes", "weak_posterior", "score", "good"],
            )

    schema = T.StructType(
        [
            T.StructField(id_col, kind),
            T.StructField("votes", T.IntegerType()),
            T.StructField("weak_posterior", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("good", T.BooleanType()),
        ]
    )
    return source.mapInArrow(scored, schema)
