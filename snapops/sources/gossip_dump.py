"""Text dumps of the membership gossip to one row per reported node."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_dumps(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("dump_id"), F.col("value").alias("dump"))


def parse_gossip_dump(dumps: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(dump_id, public_ip, attributes)`` per block of more than two lines.

    ``tokens(public_ip, tokens)`` supplies the token text, which the dump itself hides. A
    later line replaces an earlier one of the same name.
    """
    blocks = dumps.select("dump_id", F.posexplode(F.split("dump", "/")).alias("block_no", "block"))
    lines = F.split(F.regexp_replace("block", r"(\r?\n)+$", ""), r"\r?\n")
    blocks = blocks.withColumn("lines", lines).filter(F.size("lines") > 2)
    blocks = blocks.withColumn("public_ip", F.trim(F.element_at("lines", 1)))
    blocks = blocks.join(tokens.select("public_ip", "tokens"), "public_ip", "left")

    def entry(line):
        fields = F.split(F.regexp_replace(line, ":+$", ""), ":")
        name = F.upper(F.trim(F.try_element_at(fields, F.lit(1))))
        last = F.trim(F.try_element_at(fields, F.lit(3)))
        value = (
            F.when(F.size(fields) == 2, F.trim(F.try_element_at(fields, F.lit(2))))
            .when((F.size(fields) == 3) & (name == "STATUS"), F.trim(F.substring_index(last, ",", 1)))
            .when((F.size(fields) == 3) & (name == "TOKENS"), F.col("tokens"))
            .when(F.size(fields) == 3, last)
        )
        return F.struct(name.alias("key"), value.alias("value"))

    found = F.filter(F.transform("lines", entry), lambda e: e["value"].isNotNull())
    blocks = blocks.withColumn("found", found)
    final = F.filter(
        "found",
        lambda e, i: ~F.exists(
            F.slice("found", i + 2, F.size("found")), lambda later: later["key"] == e["key"]
        ),
    )
    # a block's own PUBLIC_IP line would replace the address taken from its first line
    final = F.filter(final, lambda e: e["key"] != "PUBLIC_IP")
    own_ip = F.filter("found", lambda e: e["key"] == "PUBLIC_IP")
    address = F.coalesce(F.try_element_at(own_ip, F.lit(-1))["value"], F.col("public_ip"))
    entries = F.concat(F.array(F.struct(F.lit("PUBLIC_IP").alias("key"), address.alias("value"))), final)
    return blocks.select("dump_id", "block_no", "public_ip", F.map_from_entries(entries).alias("attributes"))
