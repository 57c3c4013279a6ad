"""Near duplicates by order MinHash.

The features of a text are its windows of five words, each labelled with how often it occurred before.  A sketch
takes the ``TUPLE`` windows with the least hash of one hash function and keeps them in text order, so two texts
share a sketch with a chance that falls with their edits and their order.  ``SKETCHES`` functions give as many
sketches; texts that share any are candidates.

Candidates are verified by banded alignment of their words: with L words in the longest common subsequence of two
texts of a and b words, similarity is L / (a + b - L), and 0.8 or more makes a link.  An alignment of that similarity
shifts no word by more than (a + b) / 9 places, so cells outside that band are not computed.  One minus the similarity is
a metric, which the search below relies on.

Scale: texts with the same words are one node.  All nodes with one sketch are a bucket.  In each round every bucket's
least node leads it and is compared with the others; those linked to it leave with it, the rest stay for the next round.
A node meets a leader once, however many buckets they share, and the members of a leader are dealt to several tasks.
That gives classes.  What could still link two of them is compared in full: a node that its leader is not linked to
but is 0.4 or more alike, with the leader's links (nodes less alike than that can't be linked to any of them, nor those
further from the leader than its furthest link and 0.2 more); and the
nodes that a bucket has left after ``ROUNDS`` rounds, with each other.  Both in pairs of bounded blocks of similar
lengths, and only where classes differ.  So no link among candidates is lost, no pairs of a group are listed, and no task
holds more than two blocks.  Classes are connected components of the links.

What is lost is a link whose texts share no sketch.  With c windows in common of u in all, the chance is
(1 - c (c - 1) / (u (u - 1))) ** 24: for c / u = 0.8 about 10 ** -11, for 0.6 2 in 10 ** 5, for 0.5 0.1 %, for 0.4 1.5 %,
for 0.3 10 %.  Edits that lie far apart cost most windows: 3 scattered edits in 100 words leave c / u = 0.73, 6 leave
0.53.  In a text under some twenty words one edit in its middle can cost all windows, so such links are often lost.

Edge cases: a null text counts as empty; texts without words are one node; a text with fewer than five words has one
window of all its words; a null id ranks behind all others; repeated rows fall into one class; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, content_key, join_hot, shielded, slices
from .textstats import WORDS

SHINGLE = 5
SIMILARITY = 0.8
#: Texts less alike than this can't both be linked to a third.
FAR = 3 * SIMILARITY - 2
SKETCHES = 24
TUPLE = 2
#: Rounds in which each bucket has a leader.
ROUNDS = 3
#: Members that one task compares with a leader.
MEMBERS = 100
#: A block holds about so many nodes, and about so many words, unless one node has more.
BLOCK_NODES = 2500
BLOCK_WORDS = 1_200_000
#: The keys of at most so many nodes (about 40 bytes each) are broadcast to the texts; more are joined by shuffle.
BROADCAST_ROWS = 500_000

# Multipliers of a public 64-bit finaliser; arrays of one element wrap around without a warning.
_M1, _M2, _M3 = (np.array([x], np.uint64) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return out


_WORD_HASH = _WordHash()


def word_hashes(text: str | None) -> np.ndarray:
    words = WORDS.findall(text or "")
    return np.fromiter(map(_WORD_HASH.__getitem__, words), np.uint64, len(words))


def labelled_windows(words: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows in text order, made distinct by how often each occurred before, and that number."""
    n = len(words)
    if not n:
        return words, np.zeros(0, np.uint64)
    k = min(size, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = _mixed(out * _M3 + words[i : n - k + 1 + i])
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    again = ranked[1:] == ranked[:-1]
    label = np.zeros(len(out), np.uint64)
    if again.any():
        first = np.flatnonzero(np.concatenate(([True], ~again)))
        times = np.arange(len(out)) - np.repeat(first, np.diff(np.append(first, len(out))))
        label[order] = times
        out = np.where(label > 0, _mixed(out + label * _M2), out)
    return out, label


def _seeds(n: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * _M3)


def sketches(windows: np.ndarray, n: int = SKETCHES, size: int = TUPLE) -> np.ndarray:
    """For each hash function one number: the least windows in text order."""
    size = min(size, len(windows))
    least = np.empty((n, size), np.int64)
    step = max(1, 250_000 // len(windows))
    for i in range(0, n, step):
        hashed = _mixed(windows ^ _seeds(n)[i : i + step, None])
        row = np.arange(len(hashed))
        for k in range(size):
            least[i : i + step, k] = at = hashed.argmin(1)
            hashed[row, at] = np.iinfo(np.uint64).max
    least.sort(axis=1)
    out = np.arange(n, dtype=np.uint64)
    for column in windows[least].T:
        out = _mixed(out * _M3 + column)
    return out


class Words:
    """A text's words as hashes, in text order and, labelled by how often each occurred before, sorted."""

    __slots__ = ("labelled", "n", "words")

    def __init__(self, text: str | None):
        self.words = word_hashes(text)
        self.n = len(self.words)
        self.labelled = np.sort(labelled_windows(self.words, 1)[0])


def common_words(a: Words, b: Words) -> int:
    """How many words two texts share, in any order; that bounds their alignment."""
    if not a.n or not b.n:
        return 0
    spot = np.minimum(np.searchsorted(b.labelled, a.labelled), b.n - 1)
    return int((b.labelled[spot] == a.labelled).sum())


def aligned(x: np.ndarray, y: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence in which no word is shifted by more than ``band`` places.

    Bit j of ``row`` says that column j adds nothing to the row; a row of the table is one addition of long integers as
    wide as the band.
    """
    least = min(len(x), len(y))
    differ = np.flatnonzero(x[:least] != y[:least])
    head = int(differ[0]) if len(differ) else least
    x, y = x[head:], y[head:]
    least -= head
    differ = np.flatnonzero(x[len(x) - least :] != y[len(y) - least :])
    tail = least - 1 - int(differ[-1]) if len(differ) else least
    x, y = x[: len(x) - tail].tolist(), y[: len(y) - tail].tolist()
    if not x or not y:
        return head + tail
    width = 2 * band + 1
    every, top = (1 << width) - 1, 1 << (width - 1)
    # Where each word stands in y, in stretches as wide as the band.
    spots: dict[tuple[int, int], int] = {}
    for j, word in enumerate(y):
        key = j // width, word
        spots[key] = spots.get(key, 0) | 1 << (j % width)
    at = spots.get
    row, count = every, 0
    for i, word in enumerate(x):
        if i:
            count += not row & 1
            row = row >> 1 | top
        stretch, skip = divmod(i - band, width)
        match = (at((stretch, word), 0) >> skip | at((stretch + 1, word), 0) << (width - skip)) & every
        if match:
            both = row & match
            row = (row + both | row - both) & every
    return head + tail + count + width - row.bit_count()


def similarity(a: Words, b: Words, least: float = SIMILARITY) -> float:
    """The aligned similarity; 0 where it is less than ``least``."""
    if not a.n or not b.n:
        return float(a.n == b.n)
    total = a.n + b.n
    if min(a.n, b.n) < least * max(a.n, b.n) or (c := common_words(a, b)) < least * (total - c):
        return 0.0
    # Of texts so alike at most this many words are unmatched, and no word is shifted by more.
    length = aligned(a.words, b.words, int((1 - least) / (1 + least) * total + 1e-9))
    found = length / (total - length)
    return found if found >= least else 0.0


class Classes:
    """Union-find."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


#: Cells of the dense table that counts shared words, filled column block by column block.
_TABLE_CELLS = 4_000_000


def likeness(left: list[Words], right: list[Words] | None = None) -> np.ndarray:
    """What each text of ``left`` and each of ``right`` (or of ``left``) are alike in words in any order, which bounds their
    similarity.

    Labelled words that only one text has are left out; the rest form a 0/1 table that is multiplied with itself.
    """
    held = left if right is None else [*left, *right]
    shared = np.zeros((len(left), len(left if right is None else right)), np.float32)
    row = np.repeat(np.arange(len(held)), [w.n for w in held])
    if len(row):
        _, name, times = np.unique(np.concatenate([w.labelled for w in held]), return_inverse=True, return_counts=True)
        common = times > 1
        number = np.cumsum(common) - 1
        keep = common[name]
        row, column = row[keep], number[name[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        width = max(1, _TABLE_CELLS // len(held))
        for first in range(0, int(common.sum()), width):
            lo, hi = np.searchsorted(column, (first, first + width))
            cells = np.zeros((len(held), min(width, int(common.sum()) - first)), np.float32)
            cells[row[lo:hi], column[lo:hi] - first] = 1
            shared += cells[: len(left)] @ (cells if right is None else cells[len(left) :]).T
    n, m = (np.array([w.n for w in x], np.float32) for x in (left, left if right is None else right))
    total = n[:, None] + m[None, :]
    np.subtract(total, shared, out=total)
    shared[total <= 0] = 1
    np.maximum(total, 1, out=total)
    return np.divide(shared, total, out=shared)


def block_links(ours: list[tuple], theirs: list[tuple] | None) -> list[tuple[int, int]]:
    """Links between two blocks of (node, label, side, words), or within one, that join classes which are apart; nodes of
    one side but 0 are not compared with each other.  The likeliest pairs are tried first."""
    like = likeness([x[3] for x in ours], None if theirs is None else [x[3] for x in theirs])
    able = like >= SIMILARITY - 1e-6
    if theirs is None:
        theirs = ours
        able = np.triu(able, 1)
    (p, u), (q, v) = (np.array([(x[1], x[2]) for x in side], np.int64).reshape(-1, 2).T for side in (ours, theirs))
    able &= (p[:, None] != q[None, :]) & ((u[:, None] != v[None, :]) | (u[:, None] == 0))
    a, b = np.nonzero(able)
    classes, out = Classes(), []
    for k in np.argsort(-like[a, b], kind="stable").tolist():
        x, y = ours[a[k]], theirs[b[k]]
        if classes.find(x[1]) != classes.find(y[1]) and similarity(x[3], y[3]):
            classes.join(x[1], y[1])
            out.append((x[0], y[0]))
    return out


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows by their first columns; equal keys follow each other.  Rows are read one by one, as they are asked for."""

    def rows() -> Iterator[tuple]:
        for batch in slices(batches):
            narrow = [c.to_pylist() for c in batch.columns[:-1]]
            for i, text in enumerate(batch.columns[-1]):
                yield (*(c[i] for c in narrow), text.as_py())

    for key, group in groupby(rows(), key=lambda r: r[:n_keys]):
        yield key, (r[n_keys:] for r in group)


def _grouped(df: DataFrame, keys: list[str], then: str | None = None) -> DataFrame:
    return df.repartition(*(F.col(k) for k in keys)).sortWithinPartitions(*keys, *([then] if then else []))


def _pairs(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names)


def components(nodes: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label): the least node of each component; ``links`` has both ends in ``nodes``.

    Labels spread to neighbours and then to whatever their label points to, until none changes.
    """
    both = scratch.put(
        links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), f"{name}-edges"
    )
    labels = scratch.put(nodes.select("node", F.col("node").alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        told = join_hot(both, labels.withColumnRenamed("node", "b"), ["b"])
        heard = told.groupBy(F.col("a").alias("_n")).agg(F.min("label").alias("_l"))
        moved = labels.join(heard, F.col("node") == F.col("_n"), "left").select(
            "node", F.col("label").alias("was"), F.least("label", F.coalesce("_l", "label")).alias("label")
        )
        moved = scratch.put(moved, f"{name}-{step}a")
        # Jump: the label of one's label; a label that many nodes have is joined apart.
        apart = scratch.put(moved.filter("label <> node"), f"{name}-{step}b")
        far = moved.select(F.col("node").alias("label"), F.col("label").alias("_l"))
        jumped = join_hot(apart, far, ["label"]).select("node", "was", F.col("_l").alias("label"))
        new = scratch.put(jumped.union(moved.filter("label = node")), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}", *(f"{name}-{step}{x}" for x in "habj"))
        labels = new.select("node", "label")
        if not new.filter("label <> was").take(1):
            scratch.drop(f"{name}-edges")
            return labels


def sketch_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_k1, _k2, _id, w1, w2, n, sketches) of every row: w1 and w2 name the sequence of words."""
    source = docs.select(*content_key(id_col, text_col), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, sizes, found = [], [], []
            for text in batch.column(3):
                words = word_hashes(text.as_py())
                place = np.arange(1, len(words) + 1, dtype=np.uint64) * _M3
                names.append([int(_mixed(words ^ place).sum(dtype=np.uint64)), int(_mixed(words + place).sum(dtype=np.uint64))])
                sizes.append(len(words))
                found.append(sketches(labelled_windows(words)[0]).view(np.int64).tolist() if len(words) else [])
            pair = np.array(names, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array(pair[:, 0].copy()),
                    pa.array(pair[:, 1].copy()),
                    pa.array(sizes, pa.int64()),
                    pa.array(found, pa.list_(pa.int64())),
                ],
                ["_k1", "_k2", "_id", "w1", "w2", "n", "sketches"],
            )
        _WORD_HASH.clear()  # the worker may go on with another operator

    fields = [("_k1", T.LongType()), ("_k2", T.LongType()), ("_id", docs.schema[id_col].dataType)]
    fields += [("w1", T.LongType()), ("w2", T.LongType()), ("n", T.LongType()), ("sketches", T.ArrayType(T.LongType()))]
    return source.mapInArrow(work, T.StructType([T.StructField(a, b) for a, b in fields]))


def _with_texts(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, text) of ``nodes``, which has the key (_f1, _f2) of a row of each."""
    k1, k2 = content_key(id_col, text_col)
    small = nodes.count() <= BROADCAST_ROWS
    texts = docs.select(k1, k2, F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(nodes) if small else nodes, (F.col("_k1") == F.col("_f1")) & (F.col("_k2") == F.col("_f2")))
    texts = scratch.put(texts.select("node", "text"), "texts")
    # Rows that agree in id and text share a key; one of them will do.
    return texts if texts.count() == nodes.count() else scratch.put(texts.dropDuplicates(["node"]), "texts1")


def _compared(pairs: DataFrame, texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(leader, node, n, alike) of the pairs (leader, node): the node's words, and their similarity, 0 if it is less than FAR."""
    counts = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    counts = scratch.put(counts, f"{name}-counts")
    dealt = join_hot(pairs, counts, ["leader"]).select(
        "leader", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node"
    )
    members = dealt.join(texts, "node").select("leader", "part", "node", "text")
    leaders = counts.join(texts, F.col("leader") == F.col("node")).select(
        "leader", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(None).cast("long").alias("node"), "text"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (leader, _), rows in _groups(batches, 2):
            first = Words(next(rows)[1])  # the leader's row has no node, so it comes first
            for node, text in rows:
                words = Words(text)
                # Most pairs are settled in the narrow band.
                out.append((leader, node, words.n, similarity(first, words) or similarity(first, words, FAR)))
            if len(out) > 10_000:
                yield told(out)
                out = []
        yield told(out)

    def told(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["leader", "node", "n", "alike"])

    found = _grouped(members.union(leaders), ["leader", "part"], "node").mapInArrow(compare, "leader long, node long, n long, alike double")
    return scratch.put(found, name)


def _in_blocks(groups: DataFrame, texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Links (a, b) within groups (g, side, node, label, n) between nodes of different labels and sides (or side 0)."""
    groups = scratch.put(groups, f"{name}-groups")
    sizes = groups.groupBy("g").agg(F.count(F.lit(1)).alias("held"), F.sum("n").alias("words"))
    sizes = scratch.put(sizes, f"{name}-sizes")
    # Texts linked differ in length by a quarter at most, so only neighbouring bands of lengths meet.
    one = (F.col("held") <= BLOCK_NODES) & (F.col("words") <= BLOCK_WORDS)
    band = F.when(one, 0).otherwise(F.floor(F.log(F.greatest("n", F.lit(1))) / math.log(1 / SIMILARITY) - 1e-9)).cast("int")
    banded = join_hot(groups, sizes, ["g"]).select("g", "side", "node", "label", "n", band.alias("band"))
    banded = scratch.put(banded, f"{name}-banded")
    parts = banded.groupBy("g", "band").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_WORDS)).cast("int").alias("p")
    )
    parts = scratch.put(parts.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("band", "p"))).alias("parts")), f"{name}-parts")
    held = join_hot(banded, parts, ["g"])
    held = held.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.expr("parts[band]")).cast("int"))
    place = F.expr(
        """concat(
          transform(sequence(0, parts[band] - 1), j -> struct(band as b1, least(block, j) as i, band as b2, greatest(block, j) as j)),
          if(parts[band + 1] is null, array(), transform(sequence(0, parts[band + 1] - 1), j -> struct(band as b1, block as i, band + 1 as b2, j as j))),
          if(parts[band - 1] is null, array(), transform(sequence(0, parts[band - 1] - 1), j -> struct(band - 1 as b1, j as i, band as b2, block as j))))"""
    )
    spread = held.withColumn("at", F.explode(place)).select("g", "at.*", "band", "block", "side", "node", "label")
    keys = ["g", "b1", "i", "b2", "j"]
    spread = spread.join(texts, "node").select(*keys, "band", "block", "side", "node", "label", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, b1, i, b2, j), rows in _groups(batches, len(keys)):
            held = [(node, label, side, band, block, Words(text)) for band, block, side, node, label, text in rows]
            ours, theirs = ([(*x[:3], x[5]) for x in held if x[3:5] == block] for block in ((b1, i), (b2, j)))
            yield _pairs(block_links(ours, None if (b1, i) == (b2, j) else theirs), ["a", "b"])

    return scratch.put(_grouped(spread, keys).mapInArrow(compare, "a long, b long"), name)


def _links(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect just the nodes of each class."""
    each = nodes.select("node", "n", F.explode("sketches").alias("sketch"))
    buckets = each.groupBy("sketch").agg(F.min(F.struct("node", "n")).alias("first"), F.count(F.lit(1)).alias("held")).filter("held > 1")
    buckets = scratch.put(buckets.select("sketch", F.col("first.node").alias("leader"), F.col("first.n").alias("nl"), "held"), "buckets")
    active = scratch.put(join_hot(each, buckets, ["sketch"], counted="held").drop("held"), "active0")
    wanted = nodes.join(active.select("node").distinct(), "node", "left_semi")
    wanted = wanted.select("node", F.col("first._k1").alias("_f1"), F.col("first._k2").alias("_f2"))
    texts = _with_texts(docs, id_col, text_col, scratch.put(wanted, "wanted"), scratch)

    links = maybe = None
    for r in range(ROUNDS):
        met = active.filter("node <> leader").select("leader", "node", "n", "nl").distinct()
        ratio = F.least("n", "nl") / F.greatest("n", "nl")
        met = scratch.put(met.withColumn("ratio", ratio), f"met{r}")
        found = _compared(met.filter(F.col("ratio") >= SIMILARITY).select("leader", "node"), texts, scratch, f"found{r}")
        # Texts of such different lengths are not compared; they are as alike as their lengths at most.
        found = found.unionByName(met.filter(F.col("ratio") < SIMILARITY).select("leader", "node", "n", F.col("ratio").alias("alike")))
        linked = F.col("alike") >= SIMILARITY
        new = found.filter(linked).select(F.col("leader").alias("a"), F.col("node").alias("b"), "n", "alike")
        links = new if links is None else links.union(new)
        # A text linked to one of the leader's links is at most so much shorter or longer than the leader.
        lengths = F.least("n", "nl") >= SIMILARITY**2 * F.greatest("n", "nl")
        near = found.filter(~linked & (F.col("alike") >= FAR)).join(met.filter(lengths).select("leader", "node"), ["leader", "node"], "left_semi")
        maybe = near if maybe is None else maybe.union(near)
        left = active.join(found.filter(~linked).select("leader", "node"), ["leader", "node"]).select("sketch", "node", "n")
        left = scratch.put(left, f"left{r}")
        leads = left.groupBy("sketch").agg(F.min(F.struct("node", "n")).alias("first"), F.count(F.lit(1)).alias("held")).filter("held > 1")
        leads = scratch.put(leads.select("sketch", F.col("first.node").alias("leader"), F.col("first.n").alias("nl"), "held"), f"leads{r}")
        active = join_hot(left, leads, ["sketch"], counted="held").drop("held")
        active = scratch.put(active, f"active{r + 1}")
        scratch.drop(f"active{r}", f"left{r}", f"leads{r}", f"hot{r}")
        if not active.take(1):
            break

    # What could still link two classes.
    labels = components(nodes.join(texts.select("node"), "node", "left_semi"), links, scratch, "first")
    labelled = scratch.put(labels.join(nodes.select("node", "n"), "node"), "labelled")
    # A leader's links that lie r from it at most can reach a text that lies r + 0.2 from it at most.
    stars = scratch.put(links.select(F.col("a").alias("leader"), F.col("b").alias("node"), "n", "alike"), "all-stars")
    reach = stars.groupBy("leader").agg(F.min("alike").alias("least"))
    maybe = join_hot(scratch.put(maybe, "perhaps"), reach, ["leader"])
    maybe = maybe.filter(F.col("alike") >= F.col("least") - (1 - SIMILARITY) - 1e-9).select("leader", "node", "n", "alike").distinct()
    maybe = scratch.put(maybe.join(labels, "node"), "maybe")
    of_leader = labels.select(F.col("node").alias("leader"), F.col("label").alias("ll"))
    maybe = join_hot(maybe, of_leader, ["leader"]).filter("label <> ll").withColumnRenamed("leader", "g")
    maybe = scratch.put(maybe, "apart")
    # A leader's links have its label; those too near to it reach none of these texts.
    wanted = maybe.groupBy(F.col("g").alias("leader")).agg(F.any_value("ll").alias("label"), F.max("alike").alias("most"))
    stars = join_hot(stars, wanted, ["leader"]).filter(F.col("alike") <= F.col("most") + (1 - SIMILARITY) + 1e-9)
    stars = stars.select(F.col("leader").alias("g"), F.lit(2).alias("side"), "node", "label", "n").distinct()
    members = maybe.select("g", F.lit(1).alias("side"), "node", "label", "n").union(stars)
    links = links.select("a", "b")
    if maybe.take(1):
        links = links.union(_in_blocks(members, texts, scratch, "members"))
    if active.take(1):
        rest = scratch.put(active.select(F.col("sketch").alias("g"), "node").join(labelled, "node"), "left-over")
        several = rest.groupBy("g").agg((F.min("label") < F.max("label")).alias("several"), F.count(F.lit(1)).alias("held"))
        several = scratch.put(several.filter("several").drop("several"), "several")
        rest = join_hot(rest, several, ["g"], counted="held")
        rest = rest.select("g", F.lit(0).alias("side"), "node", "label", "n")
        links = links.union(_in_blocks(rest, texts, scratch, "rest"))
    return links


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, class_id (least id of the class), class_size (rows), n_links (links of the row's words to
    other texts that the search verified; it verifies as many as connect the class), kept (one row a class, or all rows
    that agree in id and text with it), and the row's content key (_k1, _k2)."""
    scratch = Scratch(docs.sparkSession, "near")
    rows = scratch.put(sketch_rows(docs, id_col, text_col), "rows")
    first = F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_k1", "_k2")
    merged = rows.groupBy("w1", "w2", "n").agg(
        F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("sketches").alias("sketches")
    )
    nodes = scratch.put(merged.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
    links = scratch.put(_links(docs, id_col, text_col, nodes, scratch).distinct(), "links")
    ends = links.select(F.col("a").alias("node")).union(links.select("b"))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    classes = components(degree.select("node"), links, scratch, "classes").join(degree, "node")
    named = nodes.join(classes, "node", "left").select(
        "w1", "w2", "n", "first", "copies", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    named = scratch.put(named, "named")
    whole = scratch.put(named.groupBy("label").agg(F.min("first").alias("best"), F.sum("copies").alias("class_size")), "whole")
    result = join_hot(named, whole, ["label"]).select("w1", "w2", "n", "best", "class_size", "n_links")
    result = scratch.put(result, "result")
    held = scratch.put(rows.drop("sketches"), "held")
    scratch.drop("nodes", "named", "links", "texts", "texts1", "rows", "whole")
    return join_hot(held, result, ["w1", "w2", "n"]).select(
        F.col("_id").alias(id_col),
        F.col("best._id").alias("class_id"),
        "class_size",
        "n_links",
        ((F.col("_k1") == F.col("best._k1")) & (F.col("_k2") == F.col("best._k2"))).alias("kept"),
        "_k1",
        "_k2",
    )


@shielded
def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their columns, one row of each class."""
    kept = near_classes(docs, id_col, text_col).filter("kept").select(F.col("_k1").alias("_f1"), F.col("_k2").alias("_f2")).distinct()
    marked = docs.select("*", *content_key(id_col, text_col)).dropDuplicates(["_k1", "_k2"])
    joined = marked.join(kept, (F.col("_k1") == F.col("_f1")) & (F.col("_k2") == F.col("_f2")), "left_semi")
    return joined.select(*(F.col(c) for c in docs.columns))
