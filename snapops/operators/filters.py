"""Row filters over the catalog, the manifests and the local files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapops.constants import (
    COMPACTION_GRACE_DAYS,
    DAY_MS,
    LEAVING_STATES,
    MANIFEST_V1_NAME,
    NEVER_BACKED_UP,
    TMP_LINK_PATTERN,
    TMP_SUFFIX,
)
from snapops.functions.text import minute_text
from snapops.ranges import DateRange
from snapops.session import kept


@dataclass(frozen=True)
class TableList:
    """A setting such as ``ks1.cf1,ks2.*``; a keyspace without tables stands for all of it."""

    whole: frozenset[str]
    tables: frozenset[tuple[str, str]]

    @staticmethod
    def parse(text: str | None) -> "TableList | None":
        if not text:
            return None
        named: dict[str, set[str]] = {}
        for entry in text.split(","):
            keyspace, dot, rest = entry.partition(".")
            if not (dot and keyspace and rest):
                raise ValueError(f"expected keyspace.table, got {entry!r}")
            table = rest.split(".")[0].split("-")[0]
            known = named.setdefault(keyspace, set())
            if table != "*":
                known.add(table)
        return TableList(
            frozenset(k for k, found in named.items() if not found),
            frozenset((k, t) for k, found in named.items() for t in found),
        )

    def keyspaces(self) -> list[str]:
        return sorted(self.whole | {k for k, _ in self.tables})

    def matches(self, keyspace: Column, table: Column) -> Column:
        names = F.concat_ws(".", keyspace, table)
        found = keyspace.isin(sorted(self.whole)) if self.whole else F.lit(False)
        if self.tables:
            found = found | names.isin(sorted(f"{k}.{t}" for k, t in self.tables))
        return F.coalesce(found, F.lit(False))


def is_filtered(keyspace: Column, table_dir: Column, include: str | None, exclude: str | None) -> Column:
    """True where the built-in list, the exclude list or a missing include entry drops a table."""
    table = F.substring_index(table_dir, "-", 1)
    never = TableList(
        frozenset(), frozenset((k, t) for k, ts in NEVER_BACKED_UP.items() for t in ts)
    ).matches(keyspace, table)
    excluded = TableList.parse(exclude)
    included = TableList.parse(include)
    drop = never
    if excluded is not None:
        drop = drop | excluded.matches(keyspace, table)
    if included is not None:
        drop = drop | ~included.matches(keyspace, table)
    unnamed = F.coalesce(keyspace, F.lit("")).isin("") | F.coalesce(table_dir, F.lit("")).isin("")
    return ~unnamed & drop


def filter_keyspace_table(df: DataFrame, include: str | None = None, exclude: str | None = None) -> DataFrame:
    drop = is_filtered(F.col("keyspace"), F.col("column_family"), include, exclude)
    return df.filter(~drop)


def in_open_range(time_ms: Column, span: DateRange) -> Column:
    """v1 rule: the start itself, or strictly between start and end."""
    return (time_ms == span.start_ms) | ((time_ms > span.start_ms) & (time_ms < span.end_ms))


def in_closed_range(time_ms: Column, span: DateRange) -> Column:
    """v2 rule: both ends belong to the range."""
    return time_ms.between(span.start_ms, span.end_ms)


def list_v1_range(catalog: DataFrame, span: DateRange) -> DataFrame:
    return catalog.filter(~F.col("is_v2") & in_open_range(F.col("time_ms"), span))


def list_by_type(catalog: DataFrame, span: DateRange, file_type: str = "", bucket: str = "") -> DataFrame:
    """Report rows of the v1 objects in a range with the number of rows of their node.

    For ``META`` an object is listed when its snapshot also has the final manifest file. The
    count per node is a partial aggregate, written down and joined back by its measured size,
    so no node's rows meet in one task.
    """
    listed = list_v1_range(catalog, span)
    node = ["cluster", "token"]
    if file_type:
        listed = listed.filter(F.col("file_type") == file_type)
    if file_type == "META":
        complete = (
            list_v1_range(catalog, span)
            .filter((F.col("file_type") == "META") & (F.col("file_name") == MANIFEST_V1_NAME))
            .select("base_dir", "region", *node, "time_ms")
        )
        listed = listed.join(complete, ["base_dir", "region", *node, "time_ms"], "left_semi")
    counts = kept(listed.groupBy(*node).agg(F.count(F.lit(1)).alias("num_files")), "node-counts")
    report = F.struct(
        F.lit(bucket).alias("bucket"),
        F.col("remote_path").alias("filename"),
        F.col("cluster").alias("app"),
        F.col("region"),
        F.col("token"),
        minute_text(F.col("time_ms")).alias("ts"),
    )
    rows = listed.select(*node, "remote_path", F.to_json(report).alias("file_json"))
    return rows.join(counts, node)


def find_manifests_v2(catalog: DataFrame, span: DateRange) -> DataFrame:
    """v2 manifests of a closed range, newest path first."""
    return catalog.filter(
        (F.col("file_type") == "META_V2") & in_closed_range(F.col("last_modified_ms"), span)
    ).orderBy(F.desc("remote_path"))


def find_manifests_v1(catalog: DataFrame, span: DateRange) -> DataFrame:
    """v1 manifests of a half-open range, newest path first."""
    return list_v1_range(catalog, span).filter(
        (F.col("file_type") == "META") & (F.lower("file_name") == MANIFEST_V1_NAME)
    ).orderBy(F.desc("remote_path"))


def incrementals_v2(catalog: DataFrame, span: DateRange) -> DataFrame:
    return catalog.filter(
        (F.col("file_type") == "SST_V2") & in_closed_range(F.col("last_modified_ms"), span)
    )


def incrementals_v1(catalog: DataFrame, span: DateRange) -> DataFrame:
    return list_v1_range(catalog, span).filter(F.col("file_type") == "SST")


def is_temporary(file_name: Column) -> Column:
    # every name the pattern matches contains "tmp", which is cheaper to look for
    link = file_name.contains("tmp") & file_name.rlike(TMP_LINK_PATTERN)
    return file_name.endswith(TMP_SUFFIX) | link


def orphan_candidates(
    files: DataFrame, snapshot_ms: int | Column, grace_days: int = COMPACTION_GRACE_DAYS
) -> DataFrame:
    """Settled table files old enough that a snapshot should have caught them."""
    moment = snapshot_ms if isinstance(snapshot_ms, Column) else F.lit(snapshot_ms)
    return files.filter(
        ~is_temporary(F.col("file_name")) & (F.col("modified_ms") <= moment - grace_days * DAY_MS)
    )


def drop_empty_incrementals(files: DataFrame) -> DataFrame:
    return files.filter(F.col("size") > 0)


def live_members(*groups: DataFrame) -> DataFrame:
    """Instances of all groups that are not on their way out, once each."""
    members = groups[0]
    for group in groups[1:]:
        members = members.unionByName(group)
    staying = ~F.lower("state").isin(LEAVING_STATES)
    return members.filter(staying).select("instance_id").distinct()
