"""Helpers the operators share: written tables, gapless numbers, components, streamed groups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapops.session import shared_dir

#: A group is numbered in so many pieces, so that no task holds a whole group.
PIECES = 4096
#: Rows drawn by their hash for each row wanted, so that a draw falls short of it next to never.
SPARE = 8
#: Groups a draw may have, which bounds the table of their shares that is broadcast.
DRAWN_GROUPS = 65_536


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table written to the shared folder; what follows starts from its files."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... within each value of ``group``, nulls being one value.

    Each group is cut into 4,096 pieces by a hash of ``order``; rows are numbered within a
    piece and moved on by the sizes of the pieces before it, so a hot group is many tasks.
    """
    piece, at, start = "__piece", "__at", "__start"
    cut = df.withColumn(piece, F.pmod(F.xxhash64(*order), F.lit(PIECES)).cast("int"))
    sizes = cut.groupBy(F.col(group).alias("__group"), F.col(piece).alias("__in")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__group").orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__group", "__in", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(start))
    here = cut.withColumn(at, F.row_number().over(Window.partitionBy(group, piece).orderBy(*order)))
    joined = here.join(starts, here[group].eqNullSafe(starts["__group"]) & (here[piece] == starts["__in"]), "left")
    return joined.select(*df.columns, (F.col(start) + F.col(at) - 1).cast("long").alias(name))


def thinned(rows: DataFrame, keys: list[str], of: list[str], wanted: int) -> DataFrame:
    """About ``8 * wanted`` rows of each group of ``keys``, those whose hash of ``of`` is low; smaller groups whole.

    What is ranked later has that size whatever the input's, in one task a group. More than
    65,536 groups (labels, languages) raise an error; rows with a null key go. Of rows that
    are equal in all of ``of`` either all stay or none.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).limit(DRAWN_GROUPS + 1).collect()
    if len(sizes) > DRAWN_GROUPS:
        raise ValueError(f"more than {DRAWN_GROUPS} values of {keys}")
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    shares = [(*r[:-1], SPARE * wanted / r[-1]) for r in sizes]
    place = F.xxhash64(*of).cast("double") / 2.0**64 + 0.5
    kept = rows.join(F.broadcast(rows.sparkSession.createDataFrame(shares, f"{schema}, __share double")), keys)
    return kept.where(place <= F.col("__share")).select(*rows.columns)


def components(edges: DataFrame, name: str) -> DataFrame:
    """``(u, v)`` edges to ``(u, root)``: the smallest node each node other than a root reaches.

    Large-star and small-star steps in turn, each round written to the shared folder, until
    the edges stay as they are. Nodes without edges are not returned.
    """
    turned = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    current, seen = saved(turned, name), None
    while True:
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return current.select("u", F.col("v").alias("root"))
        seen = state
        both = current.select("u", "v").union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        current = saved(small.select("e.u", "e.v").where("u <> v").distinct(), name)


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, from batches sorted by the keys (long columns)."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table[k].to_numpy() for k in keys]
        changes = np.zeros(batch.num_rows, bool)
        for c in columns:
            changes[1:] |= c[1:] != c[:-1]
        bounds = [0, *np.flatnonzero(changes).tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of about a batch each in which no group of the sorted key is split."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        values = table[key].to_numpy()
        last = int(np.searchsorted(values, values[-1]))
        if last or (held and held[-1][key][-1].as_py() != values[0]):
            split = last if last else 0
            yield pa.concat_tables([*held, table.slice(0, split)])
            held = [table.slice(split)]
        else:
            held.append(table)
    if held:
        yield pa.concat_tables(held)
