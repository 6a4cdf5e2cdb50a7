"""Mixing sources to target weights: tokens per source, a repetition rate for each, whole copies of documents.

The size of a document is its number of words. Sources in code point order, null last, have weights 5, 2, 1, 5, 2, ...
and share the size of all documents by weight; a target stops at three times its source's size and what it leaves is
shared out again by weight until no target is above. That is a water level L with target = min(3 size, L weight): with
the sources in order of 3 size / weight, the full ones are a prefix, found by running sums over one row per source.

Each document is taken floor(rate) times, and once more if a number drawn from a hash of its id lies below the rate's
fraction. For each source the draw is taken from the seed, out of ``SEEDS``, whose total comes nearest to the target
(the smaller seed on a tie): sums over narrow rows, worked out in one pass. Reruns agree because ids alone are hashed.

A null text has size 0. A null id is hashed as an empty one. Repeated rows count each time and are taken alike. Sources
without words have target 0. Other columns are ignored (``mix``) or pass through (``mixed_rows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptveil.llm.common import unused
from promptveil.session import written

WEIGHTS = (5, 2, 1)
MOST = 3
SEEDS = 32


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and \\t to \\r; null is 0."""
    led = F.ltrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.coalesce(F.length(F.regexp_replace(led, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")),
                      F.lit(0)).cast("bigint")


def draws(id_col: Column, seeds: int = SEEDS) -> list[Column]:
    """Numbers in [0, 1) from the MD5 of the id; four seeds share one digest."""
    text = F.coalesce(id_col.cast("string"), F.lit(""))
    digests = [F.md5(F.concat(text, F.lit(f":{n}")).cast("binary")) for n in range((seeds + 3) // 4)]
    return [F.conv(F.substring(digests[s // 4], 1 + 8 * (s % 4), 8), 16, 10).cast("double") / F.lit(2.0 ** 32)
            for s in range(seeds)]


def targets(sizes: DataFrame, source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
            most: int = MOST) -> DataFrame:
    """(source, source_size, target, rate), one row per source of (source, size)."""
    per = sizes.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")  # one row per source
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("bigint"))
    full = F.col("source_size") * most
    level = Window.orderBy(full / F.col("weight"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(full).over(before), F.lit(0))
    still = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = weighed.withColumn("level", left.cast("double") / still.cast("double"))
    fits = F.col("level") <= full / F.col("weight")
    final = F.min(F.when(fits, F.struct(full / F.col("weight"), "level"))).over(every)["level"]
    known = ranked.withColumn("final", final)
    target = F.least(full.cast("double"), F.coalesce(F.col("final"), F.col("level")) * F.col("weight"))
    return (known.withColumn("target", target)
            .select("source", "source_size", "target",
                    F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
                    .alias("rate")))


def seeded(sizes: DataFrame, rates: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """``rates`` with the seed whose draws bring each source nearest to its target."""
    part = F.col("rate") - F.floor("rate")
    drawn = sizes.join(rates.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    sums = drawn.groupBy("source").agg(*[F.sum(F.when(d < part, F.col("size")).otherwise(0)).alias(f"s{n}")
                                         for n, d in enumerate(draws(F.col("id"), seeds))])
    both = rates.join(sums.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    base = F.floor("rate") * F.col("source_size")
    best = F.least(*[F.struct(F.abs(base + F.col(f"s{n}") - F.col("target")).alias("off"), F.lit(n).alias("seed"))
                     for n in range(seeds)])
    return both.select("source", "source_size", "target", "rate", best["seed"].alias("seed"))


def copies(rate: Column, seed: Column, id_col: Column, seeds: int = SEEDS) -> Column:
    draw = F.element_at(F.array(*draws(id_col, seeds)), seed + 1)
    return F.floor(rate).cast("bigint") + F.when(draw < rate - F.floor(rate), 1).otherwise(0)


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Narrow rows (id, source, size) of all documents and the (source, ..., rate, seed) rows, both stored."""
    sizes = written(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                              word_count(F.col(text_col)).alias("size")), "mix-sizes")
    rates = written(targets(sizes, "source", weights, most), "mix-rates")
    return sizes, written(seeded(sizes, rates), "mix-seeds")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken) for every document."""
    sizes, rates = plan(df, id_col, text_col, source_col)
    return (sizes.join(rates.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
            .select(F.col("id").alias(id_col), "size", "source_size", "target",
                    (F.col("size") * copies(F.col("rate"), F.col("seed"), F.col("id"))).alias("taken")))


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``df`` as often as it is taken, its columns unchanged."""
    _, rates = plan(df, id_col, text_col, source_col)
    names = unused(df, "of", "rate", "seed", "copy")
    of, rate, seed, copy = names
    narrow = rates.select(F.col("source").alias(of), F.col("rate").alias(rate), F.col("seed").alias(seed))
    times = copies(F.col(rate), F.col(seed), F.col(id_col))
    return (df.join(narrow, F.col(source_col).eqNullSafe(F.col(of)))
            .withColumn(copy, F.explode(F.array_repeat(F.lit(1), times.cast("int")))).drop(*names))
