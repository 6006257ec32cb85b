"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power alpha, normalised. Alpha is
bisected until the mix meets a target entropy or a limit on repetition. The
weights are then realised as block permutations under a token budget: a
source's documents are dealt into blocks by hash, each epoch runs through the
blocks in an order of its own (and through a block's documents likewise), and
a source goes on, epoch after epoch, until its budget is met.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, free_name

#: Sources up to this number are sent to every task (a row of a few numbers each).
BROADCAST_SOURCES = 100_000
#: Levels of the bisection that one pass over the sources evaluates, and passes.
LEVELS, PASSES = 5, 7
#: Stretches of the hash range in which the blocks of an epoch are put in order.
STRETCHES = 1024


@dataclass(frozen=True)
class Target:
    """``entropy`` (nats) or ``max_repeats`` (epochs of the most repeated source); one of them.

    ``budget``: tokens of the whole mix; None: as many as it takes for every
    document to appear at least once.
    """

    entropy: float | None = None
    max_repeats: float | None = None
    budget: float | None = None


def word_count(text: Column) -> Column:
    """Runs of non-white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def source_tokens(docs: DataFrame, source: Column, tokens: Column) -> DataFrame:
    """(source, tokens, rows) of each source; null is a source of its own."""
    return docs.select(source.alias("source"), tokens.alias("tokens")).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))


def _midpoints(low: float, high: float, levels: int) -> list[float]:
    n = 1 << levels
    return [low + (high - low) * k / n for k in range(1, n)]


def solve_exponent(sources: DataFrame, target: Target) -> float:
    """The exponent in [0, 1] at which the mix meets the target.

    Entropy falls and repetition falls as alpha grows. For an entropy target:
    the alpha with that entropy (an end of the range if none has it). For a
    repetition limit: the least alpha that keeps it (1 if none does). Each pass
    aggregates the source table once, for all exponents that the next levels of
    the bisection could ask for; only those figures come to the driver.
    """
    if (target.entropy is None) == (target.max_repeats is None):
        raise ValueError("give either entropy or max_repeats")
    shares = sources.filter("tokens > 0")
    total = shares.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    shares = shares.select((F.col("tokens") / F.lit(float(total))).alias("p"))

    def figures(exponents: list[float]) -> dict[float, tuple[float, float]]:
        tried = shares.select("p", F.explode(F.array(*(F.lit(a) for a in exponents))).alias("a"))
        rows = tried.groupBy("a").agg(
            F.sum(F.pow("p", F.col("a"))).alias("z"),
            F.sum(F.pow("p", F.col("a")) * F.ln("p")).alias("s"),
            F.max(F.pow("p", F.col("a") - 1)).alias("most"),
            F.min(F.pow("p", F.col("a") - 1)).alias("least"),
        )
        import math

        out = {}
        for r in rows.collect():
            entropy = math.log(r["z"]) - r["a"] * r["s"] / r["z"]
            repeats = r["most"] / r["least"] if target.budget is None else target.budget / total * r["most"] / r["z"]
            out[r["a"]] = (entropy, repeats)
        return out

    def too_flat(figure: tuple[float, float]) -> bool:
        return figure[0] > target.entropy if target.entropy is not None else figure[1] > target.max_repeats

    ends = figures([0.0, 1.0])
    if not too_flat(ends[0.0]):
        return 0.0
    if too_flat(ends[1.0]):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        points = _midpoints(low, high, LEVELS)
        found = figures(points)
        left, right = 0, len(points) + 1
        while right - left > 1:
            middle = (left + right) // 2
            if too_flat(found[points[middle - 1]]):
                left = middle
            else:
                right = middle
        step = (high - low) / (len(points) + 1)
        low, high = low + left * step, low + right * step
    return high


def weights(sources: DataFrame, target: Target) -> DataFrame:
    """(source, tokens, rows, weight, budget, repeats): the mix, one row per source.

    Sources without tokens have weight 0 and appear once.
    """
    alpha = solve_exponent(sources, target)
    total = sources.agg(F.sum("tokens")).first()[0] or 1
    share = F.col("tokens") / F.lit(float(total))
    raised = F.when(F.col("tokens") > 0, F.pow(share, F.lit(alpha))).otherwise(F.lit(0.0))
    norm = sources.agg(F.sum(raised).alias("z"), F.min(F.when(F.col("tokens") > 0, F.pow(share, F.lit(alpha - 1)))).alias("least")).first()
    z = norm["z"] or 1.0
    budget = target.budget if target.budget is not None else total * z / (norm["least"] or 1.0)
    mixed = sources.withColumn("weight", raised / F.lit(z)).withColumn("budget", F.col("weight") * F.lit(float(budget)))
    # The most common source has exactly one epoch; rounding must not turn it into a second.
    repeats = F.when(F.col("tokens") > 0, F.round(F.col("budget") / F.col("tokens"), 9)).otherwise(F.lit(1.0))
    return mixed.withColumn("repeats", repeats)


def block_starts(blocks: DataFrame, seed: int, stretches: int = STRETCHES) -> DataFrame:
    """(k, e, b, start): the tokens of source k's epoch e that come before its block b.

    ``blocks`` has k, b, e and tokens; each epoch has an order of its own, by
    hash. The range of the hash is cut into ``stretches``: sums are run within
    a stretch, and over the stretches of an epoch, so no task holds all blocks
    of a source.
    """
    order = F.xxhash64(F.lit(seed), "k", "e", "b")
    keyed = blocks.withColumn("h", order).withColumn("s", F.floor((F.col("h") / 2.0**64 + 0.5) * stretches))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy("k", "e", "s").agg(F.sum("tokens").alias("n"))
    sums = sums.select("k", "e", "s", F.coalesce(F.sum("n").over(before("k", "e").orderBy("s")), F.lit(0)).alias("base"))
    inside = keyed.withColumn("own", F.coalesce(F.sum("tokens").over(before("k", "e", "s").orderBy("h", "b")), F.lit(0)))
    return inside.join(sums, ["k", "e", "s"]).select("k", "e", "b", (F.col("base") + F.col("own")).alias("start"))


def mix(docs: DataFrame, target: Target, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens: Column | None = None, block_tokens: int = 100_000, mix_block_tokens: int = 1_000_000, seed: int = 7) -> DataFrame:
    """The mixed sequence: ``docs`` with epoch, mix_block, mix_tokens and mix_weight.

    A row appears once for each epoch in which its source's budget reaches it
    (the row that crosses the budget is kept, so a source exceeds its budget by
    less than one row). ``mix_block`` numbers the blocks of the training order;
    each holds all sources in the proportion of their weights, and the order
    within a block is left to the reader. Null sources form a source; rows
    without text count no tokens and are kept; null and repeated ids are
    allowed (their rows are ordered by text). Clashing column names are
    replaced by the result's.

    A hot source is dealt into as many blocks as its tokens ask for, and all
    sorting is within a block or, for the blocks of an epoch, within a stretch
    of their order.
    """
    own = [c for c in docs.columns if c.lower() not in {"epoch", "mix_block", "mix_tokens", "mix_weight"}]
    name = lambda n: free_name(docs, n)
    count, key, block, epoch, mark = name("__tokens"), name("__hash"), name("__block"), name("__epoch"), name("__src")
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    keyed = docs.select(*own).withColumns(
        {
            count: tokens if tokens is not None else word_count(F.col(text_col)),
            mark: source,
            key: F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)),
        }
    )
    # What the plan needs of a row, without its text: read twice below, so written once.
    narrow = checkpointed(keyed.select(F.col(mark).alias("source"), F.col(count).alias("tokens"), F.col(key).alias("hash")))
    sources = checkpointed(source_tokens(narrow, F.col("source"), F.col("tokens")))
    plan = weights(sources, target)
    total_budget = plan.agg(F.sum("budget")).first()[0] or 1.0
    mix_blocks = max(1, round(total_budget / mix_block_tokens))
    # Names of the plan's columns that clash with none of the documents'.
    s_key, s_tokens, s_weight, s_budget, s_epochs, s_blocks, r_start, at, k2, b2, e2, b_start = (
        name(f"__{n}") for n in ("key", "tokens_of", "weight", "budget", "epochs", "blocks", "r_start", "at", "k2", "b2", "e2", "b_start")
    )
    plan = plan.select(
        F.col("source").alias(s_key),
        F.col("tokens").alias(s_tokens),
        F.col("weight").alias(s_weight),
        F.col("budget").alias(s_budget),
        F.greatest(F.lit(1), F.ceil("repeats")).cast("int").alias(s_epochs),
        F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("long").alias(s_blocks),
    )
    plan = checkpointed(plan)
    few = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    dealt = keyed.join(few, F.col(mark) == F.col(s_key)).withColumn(block, F.pmod(F.col(key), F.col(s_blocks)))
    placed = narrow.join(few, F.col("source") == F.col(s_key)).withColumn("b", F.pmod(F.col("hash"), F.col(s_blocks)))
    blocks = placed.groupBy(F.col("source").alias("k"), "b").agg(F.sum(placed["tokens"]).alias("tokens"), F.first(s_epochs).alias("epochs"))
    epochs = blocks.select("k", "b", "tokens", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("e"))
    starts = checkpointed(block_starts(epochs, seed).select(F.col("k").alias(k2), F.col("b").alias(b2), F.col("e").alias(e2), F.col("start").alias(b_start)))

    out = dealt.withColumn(epoch, F.explode(F.sequence(F.lit(0), F.col(s_epochs) - 1)))
    in_block = Window.partitionBy(s_key, epoch, block).orderBy(F.xxhash64(F.lit(seed), epoch, key), key).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn(r_start, F.coalesce(F.sum(count).over(in_block), F.lit(0)))
    out = out.join(starts, (F.col(s_key) == F.col(k2)) & (F.col(epoch) == F.col(e2)) & (F.col(block) == F.col(b2)))
    out = out.withColumn(at, F.col(epoch) * F.col(s_tokens) + F.col(b_start) + F.col(r_start))
    first = (F.col(epoch) == 0) & (F.lit(target.budget is None) | (F.col(s_tokens) == 0))
    out = out.filter(first | (F.col(at) < F.col(s_budget) - 1e-6))
    spot = F.when(F.col(s_budget) > 0, F.floor(F.col(at) / F.col(s_budget) * F.lit(mix_blocks))).otherwise(F.lit(0))
    return out.select(
        *own,
        F.col(epoch).cast("long").alias("epoch"),
        F.least(spot, F.lit(mix_blocks - 1)).cast("long").alias("mix_block"),
        F.col(count).alias("mix_tokens"),
        F.round(s_weight, 9).alias("mix_weight"),
    )
