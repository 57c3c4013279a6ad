"""Quality rules: an isolation forest on rule statistics.

Every document gets the statistics of its whole text.  Random splits isolate odd documents early; a short
mean path over the trees marks an anomaly.  The forest is grown on the ratios of good labelled rows, so that
junk is odd to it, and the threshold is calibrated on labelled rows of both kinds: it rejects as much junk as
it can while at most ``max_false`` of the good rows go.

Every tree is grown on all good labelled rows, and the threshold is an exact rank among the scores of all labelled
rows.  Both take only counts, least and greatest values from the rows, a level of all trees or 16 bits of the scores at a
time; so the driver holds a forest and no rows, and neither the layout of the files nor a task that runs again changes
a verdict.  Statistics, scores and verdicts cover every document.

Edge cases: a null or empty text has no words and fails the base rule; without labelled rows of both kinds
only the base rule rejects; repeated rows are judged alike; rows with a null label are not used; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, slices
from .textstats import RATIOS, Statistics, ratios, statistics

TREES = 128
#: Levels of cuts; a tree of n rows has no more than log2(n), rounded up.
DEPTH = 8
MAX_FALSE = 0.002
MIN_WORDS = 50


def _mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


#: Of every node of a level, by tree: its rows, and the least and greatest value of the feature drawn for it.
Extents = tuple[np.ndarray, np.ndarray, np.ndarray]


class Growth:
    """Trees on their way: the features drawn for all nodes, and the cuts of all nodes above a level.

    The children of node i are 2i + 1 and 2i + 2, so level k begins at node 2^k - 1.
    """

    def __init__(self, feature: np.ndarray, cut: np.ndarray, level: int):
        self.feature, self.cut, self.level = feature, cut, level

    def none(self) -> Extents:
        shape = len(self.feature), 2**self.level
        return np.zeros(shape, np.int64), np.full(shape, np.inf), np.full(shape, -np.inf)

    def add(self, total: Extents, rows: np.ndarray, picked: list[np.ndarray] | None = None) -> None:
        """Adds rows to the extents; each tree takes those ``picked`` for it, or all."""
        first = 2**self.level - 1
        for t, (feature, cut) in enumerate(zip(self.feature, self.cut, strict=True)):
            mine = rows if picked is None else rows[picked[t]]
            index = np.arange(len(mine))
            at = np.zeros(len(mine), np.int64)
            for _ in range(self.level):
                at = 2 * at + 1 + (mine[index, feature[at]] >= cut[at])
            values = mine[index, feature[at]]
            total[0][t] += np.bincount(at - first, minlength=first + 1)
            np.minimum.at(total[1][t], at - first, values)
            np.maximum.at(total[2][t], at - first, values)


class IsolationForest:
    """Trees of random splits, kept as flat arrays (feature, cut, left, right, depth).

    Every tree is grown on all rows, or on ``sample`` of them.
    """

    #: Cuts are drawn from a node's range widened on both sides by this part of the column's whole range, and by
    #: at least LEAST_MARGIN; else a row outside everything seen would always stay with its nearest neighbours.
    MARGIN, LEAST_MARGIN = 0.25, 0.01

    def __init__(self, rows: np.ndarray, trees: int = TREES, sample: int | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = len(rows) if sample is None else min(sample, len(rows))

        def extents(growth: Growth) -> Extents:
            growth.add(total := growth.none(), rows, picked)
            return total

        grow = self._grow(n, rows.min(0), rows.max(0), trees, rng)
        picked = None if n == len(rows) else [rng.choice(len(rows), n, replace=False) for _ in range(trees)]
        grow(extents)

    @classmethod
    def spread(cls, rows: DataFrame, trees: int = TREES, seed: int = 7) -> IsolationForest:
        """The forest of all rows of a table of ratios, the same as of an array of them; the rows stay where they are."""
        ends = rows.agg(F.count(F.lit(1)), *(F.min(c) for c in RATIOS), *(F.max(c) for c in RATIOS)).first()
        low, high = np.array(ends[1:]).reshape(2, len(RATIOS))
        forest = cls.__new__(cls)
        forest._grow(ends[0], low, high, trees, np.random.default_rng(seed))(lambda growth: _extents(rows, growth))
        return forest

    def _grow(self, n: int, low: np.ndarray, high: np.ndarray, trees: int, rng: np.random.Generator) -> Callable:
        """Draws all that is random; what it returns grows the trees by the extents of one level after the other."""
        self.sample = n
        limit = min(DEPTH, max(1, math.ceil(math.log2(max(2, n)))))
        shape = trees, 2 ** (limit + 1) - 1
        drawn, place = rng.integers(len(low), size=shape), rng.random(shape)
        margin = np.maximum(self.MARGIN * (high - low), self.LEAST_MARGIN)

        def grow(extents: Callable[[Growth], Extents]) -> None:
            feature, cut, depth = np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape)
            for level in range(limit + 1):
                part = slice(2**level - 1, 2 ** (level + 1) - 1)
                count, least, most = extents(Growth(drawn, cut, level))
                depth[:, part] = level + np.array([_mean_path(x) for x in count.flat]).reshape(count.shape)
                if level < limit:
                    there, wider = count > 0, margin[drawn[:, part]]
                    least, most = np.where(there, least - wider, 0.0), np.where(there, most + wider, 0.0)
                    feature[:, part] = np.where(there, drawn[:, part], -1)
                    cut[:, part] = least + place[:, part] * (most - least)
            child = 2 * np.arange(shape[1], dtype=np.int32) + 1
            self.trees = [(f, c, child, child + 1, d) for f, c, d in zip(feature, cut, depth, strict=True)]

        return grow

    def score(self, rows: np.ndarray) -> np.ndarray:
        """From 0 to 1; anomalies come near 1."""
        total = np.zeros(len(rows))
        index = np.arange(len(rows))
        for feature, cut, left, right, depth in self.trees:
            at = np.zeros(len(rows), np.int32)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                less = rows[index, np.maximum(f, 0)] < cut[at]
                at = np.where(inner, np.where(less, left[at], right[at]), at)
            total += depth[at]
        return np.power(2.0, -total / len(self.trees) / max(1e-9, _mean_path(self.sample)))


class Verdict:
    """A forest and its threshold; without a forest nothing is an anomaly."""

    def __init__(self, forest: IsolationForest | None, threshold: float):
        self.forest, self.threshold = forest, threshold

    def scores(self, found: list[Statistics]) -> np.ndarray:
        if self.forest is None or not found:
            return np.zeros(len(found))
        return self.forest.score(np.array([ratios(s) for s in found]))


def _between(edge: float, beyond: float | None, top: float) -> float:
    return float((edge + beyond) / 2) if beyond is not None else float(np.nextafter(top, np.inf))


def calibrated(scores: np.ndarray, good: np.ndarray, max_false: float = MAX_FALSE) -> float:
    """The least threshold above which at most that part of the good rows lies, and in the middle of the
    gap to the next higher row."""
    kept = np.sort(scores[good])
    spare = int(max_false * len(kept))
    edge = kept[len(kept) - 1 - spare]
    beyond = scores[~good][scores[~good] > edge]
    return _between(edge, beyond.min() if len(beyond) else None, kept[-1])


def ranked(rows: DataFrame, rank: int) -> int:
    """The value of ``bits`` (longs from 0 on) that comes after ``rank`` rows when the greatest come first.

    Each pass counts 16 bits of those rows that agree with it in the bits above.
    """
    for shift in (48, 32, 16, 0):
        part = F.shiftright("bits", shift)
        counted = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
        for value, n in sorted(map(tuple, counted), reverse=True):
            if rank < n:
                break
            rank -= n
        rows = rows.filter(part == value)
    return value


def calibrated_spread(scored: DataFrame, max_false: float = MAX_FALSE) -> float:
    """``calibrated`` of a table of label and ``bits``, the bits of a score, which order as positive scores do."""
    good = scored.filter("label = 1")
    n, top = good.agg(F.count(F.lit(1)), F.max("bits")).first()
    edge = ranked(good, int(max_false * n))
    beyond = scored.filter((F.col("label") != 1) & (F.col("bits") > edge)).agg(F.min("bits")).first()[0]
    score = lambda bits: None if bits is None else np.int64(bits).view(np.float64)
    return _between(score(edge), score(beyond), score(top))


_STATS = [("n_words", 0), ("word_chars", 1), ("n_symbols", 2), ("n_dup_lines", 3), ("n_repeat_words", 4)]


def _values(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in RATIOS])


def _extents(rows: DataFrame, growth: Growth) -> Extents:
    """The extents of all rows of a table; a task sends one line for each node that it has rows of."""
    sent = rows.sparkSession.sparkContext.broadcast(growth)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sent.value.none()
        for batch in batches:
            sent.value.add(total, _values(batch))
        node = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, *(e.ravel()[node] for e in total))], ["node", "n", "least", "most"])

    lines = rows.mapInArrow(part, "node long, n long, least double, most double").groupBy("node")
    total = growth.none()
    for node, *found in lines.agg(F.sum("n"), F.min("least"), F.max("most")).collect():
        for all_nodes, value in zip(total, found, strict=True):
            all_nodes.flat[node] = value
    sent.unpersist()
    return total


def labelled_ratios(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int | None = None
) -> DataFrame:
    """Label and ratios of the rows of all labels, or of ``fit_rows`` labels.

    Texts are measured where they are; only their ratios are shuffled.
    """
    chosen = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")
    )
    if fit_rows is not None:
        chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "label").limit(fit_rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = np.array([ratios(statistics(t)) for t in batch.column(1).to_pylist()]).reshape(-1, len(RATIOS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, values.T)], ["_doc", *RATIOS])

    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    kinds = [T.StructField("_doc", texts.schema[0].dataType), *(T.StructField(c, T.DoubleType()) for c in RATIOS)]
    return texts.mapInArrow(measure, T.StructType(kinds)).join(chosen, F.col("_doc") == F.col("_id")).select("label", *RATIOS)


def _scored(rows: DataFrame, forest: IsolationForest) -> DataFrame:
    """The label and the bits of the score of every labelled row."""
    sent = rows.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = sent.value.score(_values(batch)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], ["label", "bits"])

    return rows.mapInArrow(score, "label int, bits long")


def fit_verdict(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    fit_rows: int | None = None,
    max_false: float = MAX_FALSE,
) -> Verdict:
    """The verdict that all labelled rows make, unless ``fit_rows`` names how many labels may be used."""
    scratch = Scratch(docs.sparkSession, "quality-rules")
    rows = scratch.put(labelled_ratios(docs, labels, id_col, text_col, label_col, fit_rows), "ratios")
    n, n_good = rows.agg(F.count(F.lit(1)), F.count_if(F.col("label") == 1)).first()
    verdict = Verdict(None, math.inf)
    if 8 <= n_good < n:
        forest = IsolationForest.spread(rows.filter("label = 1"))
        verdict = Verdict(forest, calibrated_spread(scratch.put(_scored(rows, forest), "scored"), max_false))
    scratch.drop("ratios", "scored")
    return verdict


def judge(docs: DataFrame, verdict: Verdict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The statistics, base_failed, score and kept of every document, beside all its columns under ``doc``."""
    sent = docs.sparkSession.sparkContext.broadcast(verdict)
    columns = docs.columns

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [statistics(t) for t in batch.column(columns.index(text_col)).to_pylist()]
            scores = sent.value.scores(found)
            base = [s.n_words < MIN_WORDS or 100 * s.n_repeat_words > 50 * s.n_words for s in found]
            kept = [not b and bool(x <= sent.value.threshold) for b, x in zip(base, scores, strict=True)]
            added = [pa.array([s[i] for s in found], pa.int64()) for _, i in _STATS]
            arrays = [*batch.columns, *added, pa.array(base, pa.bool_()), pa.array(scores, pa.float64()), pa.array(kept, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, [f"f{i}" for i in range(len(arrays))])

    names = [*(n for n, _ in _STATS), "base_failed", "score", "kept"]
    kinds = [T.LongType()] * len(_STATS) + [T.BooleanType(), T.DoubleType(), T.BooleanType()]
    fields = [f.dataType for f in docs.schema] + kinds
    out = docs.mapInArrow(measured, T.StructType([T.StructField(f"f{i}", t) for i, t in enumerate(fields)]))
    doc = F.struct(*(F.col(f"f{i}").alias(c) for i, c in enumerate(columns))).alias("doc")
    return out.select(doc, *(F.col(f"f{len(columns) + i}").alias(n) for i, n in enumerate(names)))


def filter_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """The documents that the rules keep, with their columns."""
    verdict = fit_verdict(docs, labels, id_col, text_col, **fit)
    return judge(docs, verdict, id_col, text_col).filter("kept").select("doc.*")
