"""Mixing sources to target weights by Poisson replication.  DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Sources up to which the table of their rates is broadcast (some MB); beyond it the
#: join is a shuffle, with each source dealt over so many salts.
MOST_BROADCAST, SALTS = 50_000, 256
#: Repeated ids up to which they are broadcast (some 100 MB at most); beyond it, a shuffle.
MOST_REPEATED = 1_000_000
#: The largest mean that one inversion handles; a larger one is a sum of several.
MEAN_STEP = 8.0


def unit_hash(*parts: Column | str) -> Column:
    """A double in [0, 1) from the md5 of the parts, written with ``|`` between; 52 bits."""
    text = F.concat_ws("|", *(F.coalesce((F.lit(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_inverse(u: Column, mean: Column) -> Column:
    """The least k with P(X <= k) > u for X of a Poisson distribution, mean at most MEAN_STEP.

    The loop is unrolled over an array: 64 terms, beyond which a mean of 8 leaves
    less than 2**-53, so that k is exact for every double u.
    """
    start = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("below"), F.lit(0).alias("k"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * mean / i
        return F.struct(term.alias("term"), (acc["below"] + term).alias("below"), F.when(u >= acc["below"], i).otherwise(acc["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step, lambda acc: acc["k"])


def told_apart(own: DataFrame) -> DataFrame:
    """Rows (row, id, src) with ``name``, what their numbers are hashed from: the id, or more where that isn't enough.

    Rows without an id, and those that share one, are written as a table; their names have
    their place in it as well, so that each is drawn on its own, has keys of its own, and is
    the same for a task that is repeated.
    """
    repeated = own.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    repeated = staged(repeated, "repeated")
    n = repeated.count()
    known = own.filter("id IS NOT NULL")
    some = own.filter("id IS NULL")
    if n:
        ids = F.broadcast(repeated) if n <= MOST_REPEATED else repeated
        some, known = some.unionByName(known.join(ids, "id", "left_semi").select(*own.columns)), known.join(ids, "id", "left_anti").select(*own.columns)
    elif some.isEmpty():
        return known.withColumn("name", F.col("id"))
    place = F.monotonically_increasing_id().cast("string")
    some = staged(some, "unnamed").withColumn("name", F.concat(F.coalesce("id", F.lit("")), F.lit("|row|"), place))
    return known.withColumn("name", F.col("id")).unionByName(some)


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", size_col: str | None = None, copy_col: str | None = None, key_col: str | None = None) -> DataFrame:
    """Replicate documents so that sources have their target weights, in global random order.

    A source's mean repetition rate is target weight x total size / its size, sizes
    being rows or the sum of ``size_col``; so the expected size of the result is that
    of the input.  ``weights`` maps sources to weights (a source without one gets none,
    hence no copy); without ``weights`` a source's weight is its size to the power
    ``temperature``.  A document's number of copies is the inverse of its Poisson
    distribution at a number hashed from ``seed`` and its id: the same at every run,
    whatever the partitions.  Copies are dealt over the whole cluster by a hash of seed, id
    and copy number and sorted by it within a partition: each partition is a random part of
    all copies, in random order.

    Returns the columns of ``docs``; ``copy_col`` adds the copy number from 0, ``key_col``
    the sort key.  Sizes are pre-aggregated per source; the driver gets their number and
    sums.  The rates are broadcast if there are at most MOST_BROADCAST sources; beyond it
    rows are joined by source and a salt from their id, which splits a hot source.

    Null source is a source of its own (``""`` in ``weights``); it is not the same as
    the empty string.  Rows with null or equal ids, identical ones too, are drawn each on
    its own, by their place in a table that is written of them (``told_apart``): as many
    copies are expected of them as of others, but a later run may draw others.  Null sizes
    count 0; a source whose size is 0 is given rate 0.  An empty table gives an empty result.  Columns of ``docs`` may have any
    names.
    """
    names = docs.columns
    own = docs.select(F.struct(*(F.col(f"`{x}`") for x in names)).alias("row"))
    source, doc_id = F.col("row").getField(source_col), F.col("row").getField(id_col)
    size = F.lit(1.0) if size_col is None else F.coalesce(F.col("row").getField(size_col).cast("double"), F.lit(0.0))
    own = own.select("row", doc_id.cast("string").alias("id"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")).alias("src"))
    sizes = own.groupBy("src").agg(F.sum(size).alias("size"))
    if weights is None:
        weight = F.pow(F.col("size"), F.lit(float(temperature)))
    else:
        known = F.create_map(*(x for k, v in weights.items() for x in (F.lit("null" if k == "" else f"s{k}"), F.lit(float(v)))))
        weight = F.coalesce(known[F.col("src")], F.lit(0.0))
    sizes = sizes.withColumn("weight", weight)
    totals = sizes.agg(F.count(F.lit(1)), F.sum("size"), F.sum("weight")).first()
    rate = F.col("weight") / (totals[2] or 1.0) * (totals[1] or 0.0) / F.col("size")
    rates = sizes.select("src", F.when(F.col("size") > 0, rate).otherwise(0.0).alias("rate"))
    own = told_apart(own)
    if totals[0] <= MOST_BROADCAST:
        own = own.join(F.broadcast(rates), "src")
    else:
        rates = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = own.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int")).join(rates, ["src", "salt"])
    n_steps = F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN_STEP)).cast("int")
    drawn = F.aggregate(F.sequence(F.lit(1), n_steps), F.lit(0), lambda acc, i: acc + poisson_inverse(unit_hash(seed, "n", F.col("name"), i), F.col("rate") / n_steps))
    copies = own.select("row", "name", F.when(F.col("rate") > 0, drawn).otherwise(0).alias("n"))
    each = copies.filter("n > 0").select("row", "name", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    out = each.select("row", "copy", unit_hash(seed, "order", F.col("name"), F.col("copy")).alias("key"))
    out = out.repartition("key").sortWithinPartitions("key")
    more = [F.col("copy").alias(copy_col)] if copy_col else []
    more += [F.col("key").alias(key_col)] if key_col else []
    return out.select(*(F.col("row").getField(x).alias(x) for x in names), *more)
