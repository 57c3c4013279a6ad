"""Exact duplicates by deterministic block naming.

Each normalised text is cut into fixed-size byte blocks.  Distinct blocks are sorted into integer names;
then adjacent names are paired and the distinct pairs are sorted into names again, until every document
is one integer.  Two documents of one level carry the same integer exactly when their bytes are equal.

Blocks travel as 128-bit fingerprints.  Every run proves, over the bytes of all distinct blocks, that no
two blocks share a fingerprint; if two did, the run starts over with another salt.  So the names are
collision-free, while the texts cross the network once, after map-side combination.

Names are ``bucket * 2**40 + rank``: the rank of a symbol in the sorted symbols of its hash bucket.  They
depend on the data only, so a task that runs again after a loss gives the same names.

Edge cases: a null text counts as empty; empty texts equal each other; a null id ranks behind every other
id; of rows that agree in id and text one stays; extra columns are passed by, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_CLASS, Scratch, join_hot, shielded, whole_text

BLOCK_BYTES = 4096
NAME_BUCKETS = 1 << 16
_RANK_BITS = 40


def normalised(text: str | Column) -> Column:
    """The text with each run of ASCII white space replaced by one space."""
    return F.regexp_replace(whole_text(text), SPACE_CLASS, " ")


def _blocks(docs: DataFrame, text_col: str, block_bytes: int) -> DataFrame:
    """Adds the normalised text, its length in bytes and its blocks (an empty text has one empty block)."""
    return (
        docs.withColumn("_norm", normalised(text_col))
        .withColumn("_size", F.octet_length("_norm"))
        .withColumn("_bin", F.col("_norm").cast("binary"))
        .withColumn(
            "_blocks",
            F.expr(
                f"transform(sequence(0, greatest(0, cast(ceil(_size / {block_bytes}) as int) - 1)), "
                f"i -> substring(_bin, i * {block_bytes} + 1, {block_bytes}))"
            ),
        )
    )


def _fingerprints(salt: int) -> str:
    return f"struct(xxhash64({salt}, b) as k1, xxhash64({-salt - 1}, b) as k2)"


def sorted_names(symbols: DataFrame, n_buckets: int = NAME_BUCKETS) -> DataFrame:
    """Integer names of the distinct pairs (k1, k2), and how often each occurs: equal pairs get equal names, others differ."""
    distinct = symbols.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("held"))
    bucketed = distinct.withColumn("_bucket", F.pmod(F.xxhash64("k1", "k2"), F.lit(n_buckets)))
    rank = F.dense_rank().over(Window.partitionBy("_bucket").orderBy("k1", "k2"))
    return bucketed.select(
        "k1", "k2", "held", (F.shiftleft(F.col("_bucket").cast("long"), _RANK_BITS) + rank).alias("name")
    )


def _spine(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, scratch: Scratch) -> DataFrame:
    """One row per document without its text: row number, id, digest and block fingerprints."""
    for salt in range(1, 64):
        cut = _blocks(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", block_bytes)
        blocks = cut.select(F.explode("_blocks").alias("b")).withColumn("f", F.expr(_fingerprints(salt)))
        clash = (
            blocks.select("f.k1", "f.k2", "b").distinct().groupBy("k1", "k2").count().filter(F.col("count") > 1)
        )
        if not clash.take(1):
            marks = cut.select(
                F.monotonically_increasing_id().alias("row_id"),
                "_id",
                F.sha2("_norm", 256).alias("text_sha256"),
                F.expr(f"transform(_blocks, b -> {_fingerprints(salt)})").alias("symbols"),
            )
            return scratch.put(marks, "spine")
    raise RuntimeError("no salt separates the blocks")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    scratch = Scratch(docs.sparkSession, "exact")
    spine = _spine(docs, id_col, text_col, block_bytes, scratch)
    most = spine.agg(F.max(F.size("symbols"))).first()[0] or 1
    levels = math.ceil(math.log2(most)) if most > 1 else 0

    rows = spine.select("row_id", F.size("symbols").alias("n"), F.posexplode("symbols").alias("pos", "s")).select(
        "row_id", "n", "pos", "s.k1", "s.k2"
    )
    finished = None
    for level in range(levels + 1):
        names = scratch.put(sorted_names(rows), f"names{level}")
        named = join_hot(rows, names, ["k1", "k2"], counted="held")
        named = scratch.put(named.select("row_id", "n", "pos", "name"), f"level{level}")
        scratch.drop(f"names{level}", f"hot{level}")
        if level:
            scratch.drop(f"pairs{level}")
        done = named.filter("n = 1").select("row_id", F.lit(level).alias("level"), "name")
        finished = done if finished is None else finished.unionByName(done)
        if level < levels:
            side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
            pairs = (
                named.filter("n > 1")
                .groupBy("row_id", "n", F.floor(F.col("pos") / 2).cast("int").alias("half"))
                .agg(side(0).alias("k1"), F.coalesce(side(1), F.lit(-1)).alias("k2"))
                .select("row_id", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.col("half").alias("pos"), "k1", "k2")
            )
            rows = scratch.put(pairs, f"pairs{level + 1}")

    identity = scratch.put(
        spine.select("row_id", "_id", "text_sha256").join(finished, "row_id"), "identity"
    )
    scratch.drop(*(f"level{i}" for i in range(levels + 1)), "spine")
    first = F.min(F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id"), F.col("row_id")))
    groups = scratch.put(
        identity.groupBy("level", "name").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")), "groups"
    )
    return join_hot(identity, groups, ["level", "name"], counted="group_size").select(
        F.col("_id").alias(id_col),
        F.col("first._id").alias("keep_id"),
        F.col("group_size"),
        (F.col("row_id") == F.col("first.row_id")).alias("kept"),
        F.col("text_sha256"),
    )


@shielded
def drop_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The documents with their columns, one row of each group of equal texts."""
    # Plain columns for the id, so that the rows without a twin and the rows to keep meet in one exchange.
    name = [F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_name"), F.col(id_col).isNull().alias("_no_id")]
    key = ["_name", "_no_id", "_sha"]
    kept = exact_groups(docs, id_col, text_col, block_bytes).filter("kept").select(*name, F.col("text_sha256").alias("_sha"))
    marked = docs.select("*", *name, F.sha2(normalised(text_col), 256).alias("_sha")).dropDuplicates(key)
    return marked.join(kept, key, "left_semi").select(*(F.col(c) for c in docs.columns))
