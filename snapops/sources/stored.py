"""Tables written once for a state of their inputs and read by every later job of the session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from snapops.session import fit_shuffles, shared_dir

_written: dict[tuple, str] = {}
_largest: dict[str, int] = {}


def forget_sizes() -> None:
    """Called as a query starts: its shuffles are fitted to its own inputs."""
    _largest.clear()


def files_state(spark: SparkSession, paths: list[str]) -> tuple[int, int, int]:
    """Number and bytes of the files below ``paths`` and a sum over their names, lengths and times; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    row = files.agg(F.count(F.lit(1)), F.sum("length"), F.sum(mark)).first()
    return row[0], row[1] or 0, int(row[2] or 0)


def stored(spark: SparkSession, name: str, inputs: list[str], write: Callable[[str], None]) -> str:
    """Folder ``write`` filled for the present state of the input files.

    The folder is below the shared folder. A file added, removed or replaced makes another
    state, so a job never reads a table that lags behind its inputs. The shuffles that write
    and use the table are fitted to the bytes of the inputs, or to the largest that the query
    asked for before: a small table looked up on the way takes no partitions from a large one.
    """
    state = files_state(spark, inputs)
    app = spark.sparkContext.applicationId
    _largest[app] = max(_largest.get(app, 0), state[1])
    fit_shuffles(spark, _largest[app])
    key = (app, name, *inputs, state)
    if key not in _written:
        path = shared_dir(spark, name)
        write(path)
        _written[key] = path
    return _written[key]
