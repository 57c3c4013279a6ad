"""Mixing sources to target weights by temperature.

The token shares of the sources are raised to an exponent and normalised.  The exponent is bisected until
the weights meet a target entropy, or the greatest weight that keeps every source within a repetition limit.
The weights are then realised as budgeted block permutations: every source is dealt into blocks by a hash
of its documents; each epoch permutes the blocks anew, and a source runs through its permutations until its
token budget is spent.  In the block where it ends, documents count in hash order up to the budget.

With no ``budget`` the sources' budgets are scaled so that each source is read in full at least once: no
document is dropped, and small sources repeat.  With a ``budget`` the weights are realised within it, and a
source whose share is less than its tokens is read in part; that is the feature.

Statistics cover all documents.  Tables of blocks have ``n_blocks`` rows a source and epoch, however many
documents there are.

Edge cases: a null text counts as empty, with no tokens; a null source is a source; documents of a source
without tokens are read once; equal ids share a place in the order, and rows that agree in id and text are
taken or left together; an empty table gives no rows; columns named like the added ones are kept under
their own names if ``prefix`` is set apart from them.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, shielded, tokens_of, whole_text

N_BLOCKS = 256
#: A plan of at most so many rows (under 100 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
_GRID = 64
#: Leading hex digits by which the places in a block that is read in part are cut first.
_DIGITS = 4
#: A source that would be read more often than this is an error: give a budget or a repetition limit.
MAX_EPOCHS = 10_000


def _hash(*parts: str | Column) -> Column:
    """128 bits as 32 hex digits, which sort as text alike in every engine."""
    return F.md5(F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p for p in parts)).cast("binary"))


def source_shares(docs: DataFrame, source_col: str, text_col: str) -> DataFrame:
    return docs.groupBy(F.col(source_col).alias("src")).agg(F.sum(tokens_of(whole_text(text_col))).alias("tokens"))


def fit_exponent(
    shares: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None
) -> float:
    """The exponent in [0, 1] of the temperature.

    ``target_entropy`` in bits: the exponent whose weights have that entropy (which falls as the exponent
    rises), or the nearer end of [0, 1].  ``max_repetition``: the least exponent at which no source is read more
    often than that while the largest is read once.  Each step evaluates a grid of exponents in one small
    aggregation, so the sources never come to the driver.
    """
    if (target_entropy is None) == (max_repetition is None):
        raise ValueError("give either target_entropy or max_repetition")
    known = shares.filter("tokens > 0")
    low, high = 0.0, 1.0
    for _ in range(5):
        grid = [low + (high - low) * i / _GRID for i in range(_GRID + 1)]
        ln = F.log(F.col("tokens").cast("double"))
        if target_entropy is not None:
            sums = [x for a in grid for x in (F.sum(F.exp(a * ln)), F.sum(F.exp(a * ln) * a * ln))]
            got = list(known.agg(*sums).first())
            if got[0] is None:
                return 1.0
            entropy = [(log(z) - s / z) / log(2) for z, s in zip(got[::2], got[1::2], strict=True)]
            over = [h >= target_entropy for h in entropy]
        else:
            ends = known.agg(F.min(ln), F.max(ln)).first()
            if ends[0] is None:
                return 1.0
            over = [exp((1 - a) * (ends[1] - ends[0])) > max_repetition for a in grid]
        at = sum(over)  # both fall as the exponent rises
        if at == 0:
            return low
        if at > _GRID:
            return high
        low, high = grid[at - 1], grid[at]
    return high if max_repetition is not None else (low + high) / 2


@shielded
def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    target_entropy: float | None = None,
    max_repetition: float | None = None,
    budget: int | None = None,
    n_blocks: int = N_BLOCKS,
    seed: str = "mix",
    prefix: str = "mix_",
) -> DataFrame:
    """The documents with their columns, once for each time they are read, and the columns ``tokens``,
    ``epoch``, ``slot`` and ``order`` under ``prefix``.

    Reading in order of (slot, order) interleaves the sources at their weights: ``slot`` is the part of its
    source's budget that is spent before the row's block.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    block = F.pmod(F.conv(F.substring(_hash(seed, key), 1, 15), 16, 10).cast("long"), F.lit(n_blocks))
    marked = docs.select(
        F.col(source_col).alias("src"), key.alias("key"), block.alias("block"), tokens_of(whole_text(text_col)).alias("n")
    )
    blocks = scratch.put(marked.groupBy("src", "block").agg(F.sum("n").alias("tokens")), "blocks")
    shares = blocks.groupBy("src").agg(F.sum("tokens").alias("tokens"))
    alpha = fit_exponent(shares, target_entropy, max_repetition)

    weighed = shares.withColumn("w", F.when(F.col("tokens") > 0, F.exp(alpha * F.log(F.col("tokens").cast("double")))))
    totals = weighed.agg(F.sum("w").alias("z"), F.max(F.col("tokens") / F.col("w")).alias("scale")).first()
    if budget is None:
        # The source with the most tokens for its weight is read once; rounding must not cost it a document.
        wanted = F.greatest(F.col("tokens"), F.round(F.col("w") * F.lit(totals["scale"] or 0.0)).cast("long"))
    else:
        wanted = F.floor(F.col("w") / F.lit(totals["z"] or 1.0) * F.lit(float(budget))).cast("long")
    budgets = weighed.select(F.col("src").alias("_src"), F.col("tokens").alias("total"), F.coalesce(wanted, F.lit(0)).alias("wanted"))

    most = budgets.agg(F.max(F.expr("if(total > 0, wanted / total, 1)"))).first()[0]
    if most is not None and most > MAX_EPOCHS:
        raise ValueError(f"a source would be read {most:.0f} times; give a budget or a repetition limit")
    passes = "sequence(1, greatest(1, cast(ceil(if(total > 0, wanted / total, 1)) as int)))"
    spread = blocks.join(budgets, F.col("src").eqNullSafe(F.col("_src"))).select(
        "src", "block", "tokens", "total", "wanted", F.explode(F.expr(passes)).alias("epoch")
    )
    turn = Window.partitionBy("src").orderBy("epoch", "rank", "block").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        spread.withColumn("rank", _hash(seed, F.col("epoch").cast("string"), F.col("block").cast("string")))
        .withColumn("before", F.coalesce(F.sum("tokens").over(turn), F.lit(0)))
        # Where a source is read in full, blocks of empty texts alone that come last are read too.
        .filter("total = 0 or wanted > before or (epoch = 1 and wanted >= total)")
        .select(
            "src", "block", "epoch",
            F.coalesce(F.try_divide("before", "wanted"), F.lit(0.0)).alias("slot"),
            F.when(F.expr("total > 0 and before + tokens > wanted"), F.col("wanted") - F.col("before")).alias("rest"),
        )
    )
    plan = scratch.put(plan, "plan")

    # Where a block is read in part, the documents up to this hash are read.
    place = _hash(seed, F.col("epoch").cast("string"), F.col("key"))
    part = plan.filter("rest is not null").select(
        F.col("src").alias("_s"), F.col("block").alias("_b"), F.col("epoch"), F.col("rest")
    )
    if part.count() <= BROADCAST_ROWS:
        part = F.broadcast(part)
    cut = ["_s", "_b", "_e"]
    places = (
        marked.join(part, F.col("src").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
        .groupBy("_s", "_b", F.col("epoch").alias("_e"), "rest", place.alias("place"))
        .agg(F.sum("n").alias("n"))
    )
    # The places are cut in two steps, by their first digits and then among those with the same, so that no task sorts
    # a block whose documents are very many.
    digits = F.substring("place", 1, _DIGITS).alias("digits")
    places = scratch.put(places.select("*", digits), "places")
    steps = places.groupBy(*cut, "rest", "digits").agg(F.sum("n").alias("n"))
    steps = steps.withColumn("used", F.sum("n").over(Window.partitionBy(*cut).orderBy("digits")))
    edges = steps.groupBy(*cut, "rest").agg(
        F.max(F.when(F.col("used") <= F.col("rest"), F.col("digits"))).alias("whole"),
        F.min(F.when(F.col("used") > F.col("rest"), F.struct("digits", F.col("used") - F.col("n")))).alias("edge"),
    ).select(*(F.col(c).alias(f"{c}0") for c in cut), "whole", F.col("edge.digits").alias("edge"), F.col("edge.col2").alias("spent"))
    edges = scratch.put(edges, "edges")
    at = F.col("_s").eqNullSafe(F.col("_s0")) & (F.col("_b") == F.col("_b0")) & (F.col("_e") == F.col("_e0"))
    inside = places.join(edges, at & (F.col("digits") == F.col("edge"))).withColumn(
        "used", F.col("spent") + F.sum("n").over(Window.partitionBy(*cut).orderBy("place"))
    )
    inside = inside.filter("used <= rest").groupBy(*cut).agg(F.max("place").alias("until"))
    limits = edges.join(inside, at, "left").select(
        *(F.col(f"{c}0").alias(c) for c in cut), F.coalesce("until", F.concat("whole", F.lit("~"))).alias("until")
    )
    same = F.col("src").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")) & (F.col("epoch") == F.col("_e"))
    steps = plan.join(limits, same, "left").select(
        "src", "block", "epoch", "slot",
        F.when(F.col("rest").isNull(), F.lit("~")).otherwise(F.coalesce("until", F.lit(""))).alias("until"),
    )
    steps = scratch.put(steps, "steps")
    perblock = steps.groupBy("src", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", "slot", "until"))).alias("_steps"))
    perblock = perblock.select(F.col("src").alias("_src"), F.col("block").alias("_block"), "_steps")
    if steps.count() <= BROADCAST_ROWS:
        perblock = F.broadcast(perblock)

    full = docs.withColumns({"_key": key, "_at": block})
    joined = full.join(perblock, F.col(source_col).eqNullSafe(F.col("_src")) & (F.col("_at") == F.col("_block")))
    read = joined.withColumn("_step", F.explode("_steps")).withColumn(
        "_order", _hash(seed, F.col("_step.epoch").cast("string"), F.col("_key"))
    )
    return read.filter("_order <= _step.until").select(
        *(docs[c] for c in docs.columns),
        tokens_of(whole_text(docs[text_col])).alias(f"{prefix}tokens"),
        F.col("_step.epoch").alias(f"{prefix}epoch"),
        F.col("_step.slot").alias(f"{prefix}slot"),
        F.col("_order").alias(f"{prefix}order"),
    )
