"""Tables of keyspaces, compactions and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapops.constants import SYSTEM_KEYSPACES
from snapops.operators.filters import TableList


def is_system(keyspace: Column) -> Column:
    return F.lower(keyspace).isin(SYSTEM_KEYSPACES)


def tables_by_keyspace(tables: DataFrame) -> DataFrame:
    """Tables of each keyspace, one row each; the list of a keyspace has no fixed bound."""
    return tables.select("app", "keyspace", F.col("column_family")).distinct()


def compaction_targets(
    tables: DataFrame, include: str | None = None, exclude: str | None = None
) -> DataFrame:
    """Tables to compact: all but system keyspaces, less the excluded, of the included."""
    keyspace, table = F.col("keyspace"), F.col("column_family")
    rows = tables_by_keyspace(tables).filter(~is_system(keyspace))
    excluded, included = TableList.parse(exclude), TableList.parse(include)
    if excluded is not None:
        rows = rows.filter(~excluded.matches(keyspace, table))
    if included is not None:
        rows = rows.filter(included.matches(keyspace, table))
    return rows


def flush_targets(tables: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Keyspaces to flush, all or the ``wanted(app, keyspace)``; an unknown one is an error."""
    known = tables.select("app", "keyspace").distinct().withColumn("known", F.lit(True))
    asked = known.select("app", "keyspace") if wanted is None else wanted.select("app", "keyspace").distinct()
    rows = asked.join(known, ["app", "keyspace"], "left")
    error = F.when(F.col("known").isNull(), "no_such_keyspace")
    return rows.select("app", "keyspace", error.alias("error")).filter(
        F.col("error").isNotNull() | ~is_system(F.col("keyspace"))
    )


def compaction_progress(compactions: DataFrame) -> DataFrame:
    """Share done in percent with two digits, rounded half to even on exact integers."""
    total = F.col("total_bytes").cast("decimal(20,0)")
    scaled = F.col("bytes_complete").cast("decimal(20,0)") * F.lit(10_000)
    rest = (scaled % F.when(total != 0, total)).cast("decimal(38,0)")
    down = ((scaled - rest) / F.when(total != 0, total)).cast("decimal(38,0)")
    up = (rest * 2 > total) | ((rest * 2 == total) & (down % 2 == 1))
    hundredths = F.when(up, down + 1).otherwise(down).cast("bigint")
    percent = F.concat(
        F.expr("cast(hundredths div 100 as string)"),
        F.lit("."),
        F.lpad((F.col("hundredths") % 100).cast("string"), 2, "0"),
        F.lit("%"),
    )
    return (
        compactions.withColumn("hundredths", hundredths)
        .withColumn("progress", F.when(total == 0, "n/a").otherwise(percent))
        .drop("hundredths")
    )


def histogram_offsets(n: int = 90) -> list[int]:
    """Bucket offsets that grow by a fifth and by at least one."""
    offsets = [1]
    while len(offsets) < n:
        offsets.append(max(offsets[-1] + 1, int(offsets[-1] * 1.2 + 0.5)))
    return offsets


HISTOGRAMS = ["sstables", "write_latency", "read_latency", "row_size", "column_count"]


def cf_histogram_table(histograms: DataFrame, keys: list[str]) -> DataFrame:
    """One row per offset with the five histograms next to it; a shorter one ends in nulls."""
    rows = histograms.select(*keys, *HISTOGRAMS, F.posexplode("offsets").alias("bucket", "offset"))
    return rows.select(*keys, "bucket", "offset", *[F.get(name, F.col("bucket")).alias(name) for name in HISTOGRAMS])
