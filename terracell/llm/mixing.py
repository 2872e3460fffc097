"""Mixing sources to target weights by temperature.

Each source's share of all tokens is raised to an exponent and normalised. The
exponent is bisected until the weights reach a target entropy, then raised, if
need be, until no source repeats more often than a limit. The weights are
realised exactly, as budgeted block permutations: a source's rows are dealt in
hashed blocks; each epoch permutes the blocks anew and the rows within them. A
source's token quota is a number of whole epochs and the beginning of one more:
whole blocks in that epoch's order while the budget lasts, then rows of the block
in which it ends. What decides is a row's content and, among equal rows, a number,
so the mixture doesn't depend on how rows are dealt to files. Choosing rows moves
their hashes, counts by source and block, and the rows of one block a source; texts
move only where rows repeat, to meet their numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracell.plans.durable import discard, durable

#: Sources that the driver weighs; beyond that, jobs over the table of sources do.
MAX_SOURCES = 100_000
#: Blocks of a source (a power of two): a window sorts one block a source, and 4096 counts.
BLOCK_BITS = 12
#: Exponents that one job tries, and jobs: together they settle the exponent as finely as a double does.
TRIED, ROUNDS = 64, 9
ENTROPY, REPEATS = 0.92, 4.0
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text, its tokens here; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def weights(tokens: dict[str, int], alpha: float) -> dict[str, float]:
    """Token shares to the power ``alpha``, normalised; sources without tokens weigh nothing."""
    total = sum(tokens.values())
    raised = {s: (n / total) ** alpha if n else 0.0 for s, n in tokens.items()} if total else dict.fromkeys(tokens, 0.0)
    norm = math.fsum(raised.values())
    return {s: r / norm if norm else 0.0 for s, r in raised.items()}


def entropy(w: dict[str, float]) -> float:
    return -math.fsum(x * math.log(x) for x in w.values() if x > 0)


@dataclass(frozen=True)
class Mixture:
    alpha: float
    weights: dict[str, float]
    budget: int


def _bisect(fits, low: float, high: float) -> float:
    """The least exponent in (low, high] that fits, for a test that holds from some exponent on."""
    if fits(low):
        return low
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


def temperature(tokens: dict[str, int], budget: int | None = None, target_entropy: float = ENTROPY, max_repeats: float = REPEATS) -> Mixture:
    """Exponent and weights. ``target_entropy`` is a share of the most that the sources allow.

    Exponents lie between 0 (uniform) and 1 (natural shares); if natural shares
    already are as even as the target, they stay.
    """
    budget = sum(tokens.values()) if budget is None else budget
    live = {s: n for s, n in tokens.items() if n > 0}
    if len(live) < 2:
        return Mixture(1.0, weights(tokens, 1.0), budget)
    goal = target_entropy * math.log(len(live))
    even = _bisect(lambda a: entropy(weights(live, a)) <= goal, 0.0, 1.0) if entropy(weights(live, 1.0)) < goal else 1.0

    def within(a: float) -> bool:
        w = weights(live, a)
        return max(w[s] * budget / n for s, n in live.items()) <= max_repeats

    alpha = max(even, _bisect(within, 0.0, 1.0))
    return Mixture(alpha, weights(tokens, alpha), budget)


def _key(source: Column) -> Column:
    """Null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def temperature_of_table(sources: DataFrame, budget: int | None = None, target_entropy: float = ENTROPY, max_repeats: float = REPEATS) -> tuple[float, float, int]:
    """(exponent, ln of the norm, budget) as ``temperature`` finds them, for a durable table (n) of any number of sources.

    Instead of halving, each job tries TRIED exponents at once; rows of a few sums reach the driver.
    """
    total, live = sources.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1))).first()
    total = total or 0
    budget = total if budget is None else budget
    share = F.log(F.col("n") / F.lit(float(total or 1)))

    def at(exponents: list[float]) -> list[tuple[float, float, float]]:
        """(ln norm, entropy, most repeats) for each exponent; shares are scaled by the largest against underflow."""
        top = rows.agg(F.max("l")).first()[0]
        sums = []
        for k, a in enumerate(exponents):
            w = F.exp(F.lit(a) * (F.col("l") - F.lit(top)))
            sums += [F.sum(w).alias(f"z{k}"), F.sum(w * F.lit(a) * (F.col("l") - F.lit(top))).alias(f"e{k}"), F.max(w / F.col("n")).alias(f"r{k}")]
        found = rows.agg(*sums).first()
        out = []
        for k, a in enumerate(exponents):
            z = found[f"z{k}"]
            out.append((math.log(z) + a * top, math.log(z) - found[f"e{k}"] / z, found[f"r{k}"] / z * budget))
        return out

    rows = sources.where("n > 0").select("n", share.alias("l"))
    if live == 0:
        return 1.0, 0.0, budget
    if live == 1:
        return 1.0, at([1.0])[0][0], budget
    goal = target_entropy * math.log(live)

    def least(fits) -> float:
        low, high = 0.0, 1.0
        if fits(at([0.0])[0]):
            return 0.0
        for _ in range(ROUNDS):
            tried = [low + (high - low) * (k + 1) / TRIED for k in range(TRIED)]
            first = next((k for k, x in enumerate(at(tried)) if fits(x)), TRIED - 1)
            low, high = (tried[first - 1] if first else low), tried[first]
        return high

    even = least(lambda x: x[1] <= goal) if at([1.0])[0][1] < goal else 1.0
    alpha = max(even, least(lambda x: x[2] <= max_repeats))
    return alpha, at([alpha])[0][0], budget


def _numbered(base: DataFrame) -> DataFrame:
    """``base`` with ``_mix_uid``: the hash of a row's content and a number from 0 among the rows that share it.

    Which of equal rows gets which number makes no difference to the result. They are numbered task by task of the one
    that wrote ``base``, so a window holds the rows of one such task at most, or a count for each.
    """
    again = durable(base.groupBy("_mix_hash").count().where("count > 1").select("_mix_hash"))
    if again.isEmpty():
        return base.withColumn("_mix_uid", F.struct(F.col("_mix_hash").alias("hash"), F.lit(0).cast("long").alias("nth")))
    twins = durable(base.select("_mix_hash", "_mix_row", F.shiftright("_mix_row", 33).alias("part")).join(again, "_mix_hash"))
    before = Window.partitionBy("_mix_hash").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = durable(twins.groupBy("_mix_hash", "part").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))))
    nth = F.row_number().over(Window.partitionBy("_mix_hash", "part").orderBy("_mix_row")) - 1
    numbers = twins.withColumn("at", nth).join(starts, ["_mix_hash", "part"]).select("_mix_row", (F.col("at") + F.col("start")).alias("_mix_nth")).where("_mix_nth > 0")
    # Hashing the numbers spares a sort of the texts; rows are unique, so no partition is hot.
    found = base.join(durable(numbers).hint("shuffle_hash"), "_mix_row", "left")
    discard(again, twins, starts)
    return found.withColumn("_mix_uid", F.struct(F.col("_mix_hash").alias("hash"), F.coalesce("_mix_nth", F.lit(0)).cast("long").alias("nth"))).drop("_mix_nth")


def _permuted(block: Column, key: Column) -> Column:
    """A bijection of 0 .. 2 ** BLOCK_BITS - 1 that ``key`` chooses: three rounds of xor, odd factor and shift."""
    mask, half = F.lit((1 << BLOCK_BITS) - 1), BLOCK_BITS // 2
    x = block
    for k in range(3):
        bits = F.shiftright(key, 20 * k)
        x = x.bitwiseXOR(bits.bitwiseAND(mask))
        x = (x * F.shiftright(key, 20 * k + 7).bitwiseAND(mask).bitwiseOR(F.lit(1))).bitwiseAND(mask)
        x = x.bitwiseXOR(F.shiftright(x, half))
    return x


def _places(source: Column, epoch: Column) -> tuple[Column, Column]:
    """(place of a row's block, hash of the row) in an epoch of its source."""
    block = F.shiftrightunsigned(F.xxhash64(F.col("_mix_uid"), F.lit("block")), 64 - BLOCK_BITS)
    return _permuted(block, F.xxhash64(source, epoch)), F.xxhash64(F.col("_mix_uid"), epoch)


def mix(docs: DataFrame, budget: int | None = None, target_entropy: float = ENTROPY, max_repeats: float = REPEATS) -> DataFrame:
    """``docs`` mixed: a row for each time that a row is used, with ``epoch``, ``repeats`` and ``mix_key``.

    Sorting by mix_key (0 to 1) gives the mixture, every stretch of it in target
    proportion. ``budget`` is in words of ``text`` and defaults to all there are.
    A source's rows without words are used once an epoch; a source without any
    words is kept once; a null source is a source of its own. Every row is drawn
    for itself, also where it repeats another or has no id. Equal tables give equal
    mixtures, in whatever order their rows come (rows that differ in columns of maps
    alone count as equal there). Columns of the new names already there are
    replaced. The rows are written once, so that all steps agree on them.
    """
    spark, own = docs.sparkSession, [c for c in docs.columns if c not in ("epoch", "repeats", "mix_key")]
    content = F.xxhash64(*(c for c in own if "map<" not in docs.schema[c].dataType.simpleString()))
    added = {"_mix_s": _key(F.col("source")), "_mix_n": word_count(F.col("text")), "_mix_hash": content, "_mix_row": F.monotonically_increasing_id()}
    base = _numbered(durable(docs.select(*own, *(c.alias(name) for name, c in added.items()))))
    sources = durable(base.groupBy(F.col("_mix_s").alias("s")).agg(F.sum("_mix_n").alias("n")))
    few = sources.count() <= MAX_SOURCES
    if few:
        tokens = {r.s: r.n for r in sources.collect()}
        mixture = temperature(tokens, budget, target_entropy, max_repeats)
        weighed = spark.createDataFrame([(s, n, mixture.weights[s] * mixture.budget) for s, n in sorted(tokens.items())], "s string, n long, wanted double")
    else:
        alpha, norm, size = temperature_of_table(sources, budget, target_entropy, max_repeats)
        total = sources.agg(F.sum("n")).first()[0] or 1
        wanted = F.when(F.col("n") > 0, F.exp(F.lit(alpha) * F.log(F.col("n") / F.lit(float(total))) - F.lit(norm)) * F.lit(size)).otherwise(0.0)
        weighed = sources.select("s", "n", wanted.alias("wanted"))
    hint = F.broadcast if few else lambda df: df  # MAX_SOURCES rows at most are broadcast
    whole = F.when(F.col("n") > 0, F.floor(F.col("wanted") / F.col("n"))).otherwise(1).cast("int")
    plan = weighed.withColumn("whole", whole).select(
        F.col("s").alias("_mix_s"), "whole",
        F.when(F.col("n") > 0, (F.col("wanted") - F.col("whole") * F.col("n")).cast("long")).otherwise(0).alias("rest"),
        F.when(F.col("n") > 0, F.col("wanted") / F.col("n")).otherwise(1.0).alias("repeats"),
    )
    plan = durable(plan)
    place, h = _places(F.col("_mix_s"), F.col("whole"))
    drawn = base.select("_mix_s", "_mix_n", "_mix_uid").join(hint(plan), "_mix_s").withColumns({"place": place, "h": h})
    sums = drawn.groupBy("_mix_s", "rest", "place").agg(F.sum("_mix_n").alias("n"))
    by_source = Window.partitionBy("_mix_s").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = sums.withColumn("upto", F.sum("n").over(by_source)).where("upto > rest and upto - n <= rest").select("_mix_s", "place", (F.col("upto") - F.col("n")).alias("before"))
    in_block = Window.partitionBy("_mix_s").orderBy("h", "_mix_uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = drawn.join(hint(durable(edge)), ["_mix_s", "place"]).withColumn("upto", F.col("before") + F.sum("_mix_n").over(in_block)).where("upto > rest")
    cuts = over.groupBy("_mix_s").agg(F.min(F.struct("place", "h", "_mix_uid")).alias("cut"))
    chosen = durable(plan.select("_mix_s", F.col("whole").alias("_mix_whole"), F.col("repeats").alias("_mix_repeats")).join(cuts.withColumnRenamed("cut", "_mix_cut"), "_mix_s", "left"))
    discard(sources, plan)
    last, epoch, cut = F.col("_mix_whole"), F.col("_mix_epoch"), F.col("_mix_cut")
    uses = base.join(hint(chosen), "_mix_s").select("*", F.explode(F.sequence(F.lit(0), last)).alias("_mix_epoch"))
    place, h = _places(F.col("_mix_s"), epoch)
    uses = uses.withColumns({"_mix_place": place, "_mix_h": h})
    # In the last epoch rows before the cut are used. Without a cut nothing is: a rest is always less than an epoch.
    used = uses.where((epoch < last) | (F.struct(F.col("_mix_place").alias("place"), F.col("_mix_h").alias("h"), F.col("_mix_uid")) < cut))
    within = (F.col("_mix_place") + F.col("_mix_h").cast("double") / 2.0**64 + 0.5) / float(1 << BLOCK_BITS)
    at = F.least((epoch + within) / F.col("_mix_repeats"), F.lit(math.nextafter(1.0, 0.0)))
    return used.select(*own, epoch.alias("epoch"), F.col("_mix_repeats").alias("repeats"), at.alias("mix_key"))


def mixture_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, source, epoch, repeats, mix_key): the mixture without its texts."""
    return mix(docs).select("doc_id", "source", "epoch", "repeats", "mix_key")
