"""Column helpers for hashes, bounded JSON parts and clock text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_32 = 4_294_967_296


def string_hash(text: Column) -> Column:
    """Signed 32-bit polynomial hash (base 31) over the UTF-16 units of a string."""

    def signed(total: Column) -> Column:
        return F.when(total >= TWO_32 // 2, total - TWO_32).otherwise(total)

    def folded(units: Column, value) -> Column:
        start = F.lit(0).cast("bigint")
        return F.aggregate(units, start, lambda acc, unit: (acc * 31 + value(unit)) % TWO_32, signed)

    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit(".{4}"), F.lit(0))
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, folded(F.split(text, ""), F.ascii)).otherwise(
        folded(units, lambda unit: F.conv(unit, 16, 10).cast("bigint"))
    )


def hashed_cluster(cluster: Column) -> Column:
    """Cluster folder name of the v2 layout: ``<hash mod 10000>_<cluster>``."""
    return F.concat((string_hash(cluster) % 10_000).cast("string"), F.lit("_"), cluster)


def region_offset(region: Column) -> Column:
    """Token offset that keeps the nodes of two regions apart."""
    return F.abs(string_hash(region))


def part_of(text: Column, parts: Column) -> Column:
    """Deterministic part number in ``[0, parts)`` from a digest of ``text``."""
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("bigint") % parts


def minute_text(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyyMMddHHmm")


def day_text(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyyMMdd")


def instant_ms(text: Column) -> Column:
    """Epoch milliseconds of ``yyyyMMddHHmm`` or ``yyyyMMdd``, null for anything else."""

    def two(start: int) -> Column:
        return F.substring(text, start, 2)

    day = F.concat_ws("-", F.substring(text, 1, 4), two(5), two(7))
    full = F.concat(day, F.lit(" "), two(9), F.lit(":"), two(11), F.lit(":00"))
    written = F.when(F.length(text) == 12, full).when(F.length(text) == 8, day)
    return F.unix_millis(F.when(text.rlike("^[0-9]+$"), written).try_cast("timestamp"))


def before_last(text: Column, separator: str) -> Column:
    """Text before the last separator, null without one."""
    tail = F.length(F.substring_index(text, separator, -1)) + 1
    return F.when(text.contains(separator), F.substring(text, F.lit(1), F.length(text) - tail))


def floor_to(ms: Column, step_ms: int) -> Column:
    return ms - F.pmod(ms, F.lit(step_ms))


def computed_once(df: DataFrame, columns: list[Column | str]) -> DataFrame:
    """``df`` with the columns behind a one-row generator.

    A filter or a second use downstream then works on the computed value; behind a plain
    projection the optimizer would repeat the whole expression inside the filter.
    """
    return df.select(F.inline(F.array(F.struct(*columns))))
