"""Order questions on token rings: neighbours and ranks.

A ring's tokens are cut into order-keeping ranges of like size. The cuts are quantiles of a
sample of the ring itself, so tokens that crowd in a narrow band are spread as well as
others. Windows run inside a range, and one more runs over the range summaries, of which a
ring has at most ``RANGES``; so even a ring with most of the rows is spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapops.functions.tokens import nearer_is_lower, sort_key, token_of

#: Most ranges of a ring.
RANGES = 256
#: Sampled tokens that make a range; a ring's sample has at most ``RANGES`` times as many.
PER_RANGE = 64
#: Tasks over which the tokens of one ring are spread where they meet its cuts.
SALTS = 16


def ring_cuts(keyed: DataFrame, by: list[str]) -> DataFrame:
    """``(by, cuts)``: the sorted keys at which each ring's ranges begin, the first range's left out.

    The sample has one key for each of 16,384 hash buckets, picked by a second hash: a partial
    aggregate, whatever the size of the ring. A ring of fewer tokens is its own sample.
    """
    bucket = F.pmod(F.xxhash64("key"), F.lit(RANGES * PER_RANGE)).alias("hashed")
    picked = keyed.groupBy(*by, bucket).agg(F.min_by("key", F.hash("key")).alias("key"))
    samples = picked.groupBy(*by).agg(F.sort_array(F.collect_list("key")).alias("sample"))
    size = F.size("sample")
    ranges = F.least(F.lit(RANGES), F.greatest(F.lit(1), F.expr(f"size(sample) div {PER_RANGE}"))).cast("int")
    starts = F.transform(F.sequence(F.lit(0), ranges - 1), lambda i: F.element_at("sample", (F.floor(i * size / ranges) + 1).cast("int")))
    return samples.select(*by, F.slice(starts, F.lit(2), F.lit(RANGES)).alias("cuts"))


def _cuts_below(cuts: Column, key: Column) -> Column:
    """How many of the sorted cuts are not above the key, by halving."""
    steps = F.sequence(F.lit(1), F.lit(RANGES.bit_length()))

    def halve(had: Column, _: Column) -> Column:
        middle = F.shiftright(had["low"] + had["high"], 1)
        up = F.try_element_at(cuts, middle + 1) <= key
        more = had["low"] < had["high"]
        return F.struct(
            F.when(more & up, middle + 1).otherwise(had["low"]).alias("low"), F.when(more & ~up, middle).otherwise(had["high"]).alias("high")
        )

    start = F.struct(F.lit(0).alias("low"), F.size(cuts).alias("high"))
    return F.aggregate(steps, start, halve, lambda had: had["low"])


def with_ranges(keyed: DataFrame, cuts: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``range``, the number of the range a key falls into; 0 in a ring without tokens."""
    spread = cuts.select(*by, "cuts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    met = salted.join(spread, [*by, "salt"], "left")
    place = F.when(F.col("cuts").isNull(), 0).otherwise(_cuts_below(F.col("cuts"), F.col("key")))
    return met.select(*keyed.columns, place.alias("range"))


def _keyed(tokens: DataFrame, by: list[str]) -> DataFrame:
    return tokens.select(*by, "token").distinct().select(*by, sort_key(F.col("token")).alias("key"))


def token_bounds(wanted: DataFrame, ring: DataFrame, by: list[str]) -> DataFrame:
    """``(by, token, lower, higher)``: the ring tokens next to each wanted one, itself included.

    Wanted tokens are made distinct first, so a token asked for by very many rows is one row.
    """
    asked, owned = _keyed(wanted, by), _keyed(ring, by)
    both = asked.withColumn("ring_key", F.lit(None).cast("string")).unionByName(
        owned.withColumn("ring_key", F.col("key"))
    )
    rows = with_ranges(both, ring_cuts(owned, by), by)
    up = Window.partitionBy(*by, "range").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by, "range").orderBy(F.desc("key")).rangeBetween(Window.unboundedPreceding, 0)
    near = rows.withColumns(
        {"below": F.max("ring_key").over(up), "above": F.min("ring_key").over(down)}
    ).filter(F.col("ring_key").isNull())

    summary = rows.groupBy(*by, "range").agg(
        F.min("ring_key").alias("first"), F.max("ring_key").alias("last")
    )
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*by).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    outside = summary.select(
        *by,
        "range",
        F.max("last").over(before).alias("range_below"),
        F.min("first").over(after).alias("range_above"),
    )
    found = near.join(outside, [*by, "range"])
    return found.select(
        *by,
        token_of(F.col("key")).alias("token"),
        token_of(F.coalesce("below", "range_below")).alias("lower"),
        token_of(F.coalesce("above", "range_above")).alias("higher"),
    )


def closest_token(wanted: DataFrame, ring: DataFrame, by: list[str]) -> DataFrame:
    """Each wanted row with the ring token nearest to its own.

    Distance is linear, the ring does not wrap; an exact hit wins and a tie goes to the higher
    token. A row whose ring is empty carries an error.
    """
    bounds = token_bounds(wanted, ring, by)
    token, lower, higher = F.col("token"), F.col("lower"), F.col("higher")
    nearest = (
        F.when(lower.isNull(), higher)
        .when(higher.isNull(), lower)
        .when(lower == higher, lower)
        .when(nearer_is_lower(token, lower, higher), lower)
        .otherwise(higher)
    )
    answers = bounds.select(*by, "token", nearest.alias("closest"))
    return wanted.join(answers, [*by, "token"], "left").withColumn(
        "error", F.when(F.col("closest").isNull(), "empty_ring")
    )


def ring_position(ring: DataFrame, by: list[str]) -> DataFrame:
    """Each instance with the number of smaller tokens in its ring and the ring's size."""
    return key_positions(ring.withColumn("key", sort_key(F.col("token"))), by)


def key_positions(keyed: DataFrame, by: list[str]) -> DataFrame:
    """Replaces ``key`` by ``position``, the number of smaller keys of its group, and ``ring_size``."""
    keyed = with_ranges(keyed, ring_cuts(keyed, by), by)
    counts = keyed.groupBy(*by, "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        *by,
        "range",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
        F.sum("n").over(Window.partitionBy(*by)).alias("ring_size"),
    )
    within = Window.partitionBy(*by, "range").orderBy("key")
    ranked = keyed.withColumn("within", F.rank().over(within) - 1)
    return (
        ranked.join(bases, [*by, "range"])
        .withColumn("position", F.col("base") + F.col("within"))
        .drop("range", "key", "within", "base")
    )
