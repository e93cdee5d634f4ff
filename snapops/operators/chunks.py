"""Multipart plans and part checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapops.constants import CHUNK_SIZE, MAX_PARTS, READ_STEP


def part_bytes(size: str, chunk_size: int = CHUNK_SIZE) -> Column:
    """Bytes of a full part: the first whole number of reads that reaches the part size."""
    return F.expr(
        f"((greatest({size} div {MAX_PARTS}, {chunk_size}) + {READ_STEP - 1}) div {READ_STEP}) * {READ_STEP}"
    )


def chunk_plan(files: DataFrame, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """Parts of each file: ``(key, size, part_no, part_offset, part_size, multipart)``.

    A file below the chunk size goes in one piece. Otherwise a trailing part follows the full
    ones and may be empty. A file has at most 9,996 parts, so a row never fans out further.
    """
    sized = files.withColumn("step", part_bytes("size", chunk_size))
    multipart = F.col("size") >= chunk_size
    numbers = F.when(multipart, F.sequence(F.lit(0).cast("bigint"), F.expr("size div step"))).otherwise(
        F.array(F.lit(0).cast("bigint"))
    )
    parts = sized.withColumns({"multipart": multipart, "n": numbers}).select(
        "key", "size", "multipart", "step", F.explode("n").alias("part_no")
    )
    offset = F.col("part_no") * F.col("step")
    length = F.when(F.col("multipart"), F.least(F.col("step"), F.col("size") - offset)).otherwise(
        F.col("size")
    )
    return parts.select(
        "key",
        "size",
        (F.col("part_no") + 1).alias("part_no"),
        offset.alias("part_offset"),
        length.alias("part_size"),
        "multipart",
    )


def chunk_md5(files: DataFrame, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """Checksum of every part of ``files(key, content)`` in hex and base64.

    The digests are computed inside the row and only they are exploded, so the content is
    never copied per part.
    """
    sized = files.withColumn("size", F.length("content").cast("bigint"))
    sized = sized.withColumn("step", part_bytes("size", chunk_size))
    last = F.when(F.col("size") >= chunk_size, F.expr("size div step")).otherwise(0)

    def digest(n: Column) -> Column:
        start = (n * F.col("step") + 1).cast("int")
        length = F.when(F.col("size") >= chunk_size, F.col("step")).otherwise(F.col("size"))
        part = F.substring(F.col("content"), start, length.cast("int"))
        return F.struct((n + 1).alias("part_no"), F.length(part).cast("bigint").alias("part_size"), F.md5(part).alias("md5_hex"))

    numbers = F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))
    digests = sized.select("key", F.explode(F.transform(numbers, digest)).alias("d"))
    return digests.select(
        "key",
        "d.part_no",
        "d.part_size",
        "d.md5_hex",
        F.base64(F.unhex("d.md5_hex")).alias("md5_base64"),
    )


def part_checksum_audit(expected: DataFrame, reported: DataFrame) -> DataFrame:
    """Per key: parts with a wrong tag, parts without a report, reports without a part."""
    keys = ["key", "part_no"]
    here = expected.select(*keys, "md5_hex")
    there = reported.select(*keys, "etag")
    joined = here.join(there, keys, "full_outer")
    known = F.col("md5_hex").isNotNull()
    told = F.col("etag").isNotNull()
    counts = joined.groupBy("key").agg(
        F.count_if(known).alias("parts_expected"),
        F.count_if(told).alias("parts_reported"),
        F.count_if(known & told & (F.col("md5_hex") != F.col("etag"))).alias("wrong_tag"),
        F.count_if(known & ~told).alias("not_reported"),
        F.count_if(~known).alias("not_expected"),
    )
    sound = (F.col("wrong_tag") + F.col("not_reported") + F.col("not_expected")) == 0
    return counts.withColumn("complete", sound)
