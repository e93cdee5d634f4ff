"""Upload rate each transfer asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wanted_rates(transfers: DataFrame) -> DataFrame:
    """Rate each transfer asks for; null where pacing does not apply.

    ``transfers(node, ts_ms, seq, target_ms, in_snapshot, total_bytes, threads)``. Pacing needs
    a target other than the epoch, a snapshot file, a second left and a byte per thread.
    """
    seconds = F.expr("(target_ms - ts_ms) div 1000")
    per_thread = F.expr("total_bytes div threads")
    paced = transfers.filter(F.col("threads") > 0).withColumns({"left": seconds, "share": per_thread})
    applies = (
        (F.col("target_ms") != 0)
        & F.col("in_snapshot")
        & (F.col("target_ms") - F.col("ts_ms") >= 1000)
        & (F.col("share") >= 1)
    )
    rate = F.when(applies, F.col("share").cast("double") / F.when(F.col("left") > 0, F.col("left")))
    return paced.withColumn("wanted_rate", rate).select("node", "ts_ms", "seq", "wanted_rate")
