"""Filter interaction audit: what each filter removes in each order, from sorted posting lists.

Rows come in as part, id, one bit for each filter failed, and the marks to count among them.
They are range-partitioned and sorted by part and id; a range is the rows of one part in one
Arrow batch. In a range each filter has a posting list, the sorted ordinals of the rows that
fail it. Unions grow list by list with galloping merges, one for each set of filters; a
filter's list less a union is what the filter removes after that set, in whatever order the
set was applied. Only sizes leave a range. They are added up, and the orders pick from them:
a step of an order is a filter and the set before it, so the 120 orders of five filters need
80 differences.

A part with a third of all rows is many ranges in many tasks, and what is shuffled after the
ranges is one row for each part, filter and set. The table of steps that is broadcast has
``k * k!`` rows for ``k`` filters.

Rows are counted one by one: repeated rows and ids count as often as they occur, and rows
without an id are rows like others. A null part is the empty string. A filter no row of a part
fails has zeros. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapops.llm.common import saved

FILTERS = "ABCDE"
#: Rows a task is meant to read.
TASK_ROWS = 2_000_000
#: Tasks over which the copies of one text are spread where they meet its smallest id.
SALTS = 32
SIZES = "part string, filter int, before int, removed long, good_lost long, toxic_lost long, gone_before long, failing long, documents long"


def _found(ids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each sorted id in a longer sorted list, galloping on from the place before, and whether it is there."""
    at = np.searchsorted(among, ids)
    here = at < len(among)
    here[here] = among[at[here]] == ids[here]
    return at, here


def union(lists: list[np.ndarray]) -> np.ndarray:
    """Ids of any of the sorted lists: the shortest gallops through the next longer, and so on."""
    merged = np.zeros(0, np.int64)
    for ids in sorted(lists, key=len):
        short, long = (merged, ids) if len(merged) <= len(ids) else (ids, merged)
        at, here = _found(short, long)
        merged = np.insert(long, at[~here], short[~here])
    return merged


def difference(ids: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Ids of a sorted list that are not in the other; the shorter gallops through the longer."""
    if len(ids) <= len(gone):
        return ids[~_found(ids, gone)[1]]
    at, here = _found(gone, ids)
    return np.delete(ids, at[here])


def shared(ids: np.ndarray, marked: np.ndarray) -> int:
    """How many ids two sorted lists have in common."""
    short, long = (ids, marked) if len(ids) <= len(marked) else (marked, ids)
    return int(_found(short, long)[1].sum())


def range_sizes(failed: np.ndarray, good: np.ndarray, toxic: np.ndarray, k: int) -> np.ndarray:
    """``filter, before, removed, good_lost, toxic_lost, gone_before, failing, documents`` of one range."""
    lists = [np.flatnonzero(failed >> f & 1) for f in range(k)]
    marks = [np.flatnonzero(good), np.flatnonzero(toxic)]
    unions = [np.zeros(0, np.int64)]
    for before in range(1, 1 << k):
        last = before.bit_length() - 1
        unions.append(union([unions[before ^ (1 << last)], lists[last]]))
    rows = []
    for f in range(k):
        for before in range(1 << k):
            if not before >> f & 1:
                left = difference(lists[f], unions[before])
                rows.append((f, before, len(left), *(shared(left, m) for m in marks), len(unions[before]), len(lists[f]), len(failed)))
    return np.array(rows, np.int64)


def _sizes(k: int):
    names = [c.split()[0] for c in SIZES.split(", ")]

    def batch(part: str, sizes: np.ndarray) -> pa.RecordBatch:
        types = [pa.int32(), pa.int32(), *[pa.int64()] * 6]
        return pa.RecordBatch.from_arrays([pa.array([part] * len(sizes), pa.string()), *(pa.array(sizes[:, i], t) for i, t in enumerate(types))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None
        for rows in batches:
            if not rows.num_rows:
                continue
            runs = rows["part"].dictionary_encode()
            codes = runs.indices.to_numpy()
            columns = [rows[c].to_numpy(zero_copy_only=False) for c in ("failed", "good", "toxic")]
            bounds = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                part = runs.dictionary[int(codes[a])].as_py()
                sizes = range_sizes(*(c[a:b] for c in columns), k)
                if part != held:
                    if total is not None:
                        yield batch(held, total)
                    held, total = part, sizes
                else:
                    total[:, 2:] += sizes[:, 2:]
        if total is not None:
            yield batch(held, total)

    return run


def steps(spark, filters: str) -> DataFrame:
    """One row for each order of the filters and step: the filter and the set before it."""
    rows = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(filters[i] for i in order), step, f, before))
            before |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, before int")


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order and step in every part, from ``part, doc_id, failed, good, toxic`` rows.

    Bit ``i`` of ``failed`` says that the row fails filter ``i``. ``removed`` are the rows the
    step removes, ``redundant`` those that fail its filter but went before, ``unique_fails``
    those that fail no other, ``shapley`` the filter's removals added up over all orders.
    """
    k = len(filters)
    rows = saved(rows.select("part", "doc_id", "failed", "good", "toxic"), "filter-audit-failures")
    tasks = max(1, -(-rows.count() // TASK_ROWS))
    ordered = rows.repartitionByRange(tasks, "part", "doc_id").sortWithinPartitions("part", "doc_id")
    names = ["removed", "good_lost", "toxic_lost", "gone_before", "failing", "documents"]
    sizes = ordered.select("part", "failed", "good", "toxic").mapInArrow(_sizes(k), SIZES).groupBy("part", "filter", "before").agg(*(F.sum(n).alias(n) for n in names))
    others = F.lit((1 << k) - 1).bitwiseXOR(F.call_function("shiftleft", F.lit(1), F.col("filter")))
    times = F.element_at(F.array(*(F.lit(factorial(n) * factorial(k - 1 - n)) for n in range(k))), F.bit_count("before") + 1)
    of_filter = sizes.groupBy("part", "filter").agg(
        F.sum(F.col("removed") * times).alias("shapley"),
        F.max(F.when(F.col("before") == others, F.col("removed"))).alias("unique_fails"),
        F.collect_list(F.struct("before", *names)).alias("sets"),
    )
    flat = of_filter.select("part", "filter", "shapley", "unique_fails", F.inline("sets"))
    picked = flat.join(F.broadcast(steps(rows.sparkSession, filters)), ["filter", "before"])
    return picked.select(
        "part",
        "filter_order",
        "step",
        (F.col("documents") - F.col("gone_before") - F.col("removed")).alias("kept"),
        "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails",
        "good_lost",
        "toxic_lost",
        F.col("shapley").cast("long").alias("shapley"),
    )


def _first_copies(rows: DataFrame) -> DataFrame:
    """Adds ``copied``: an earlier id has the same text digest. Copies of one text are spread over ``SALTS`` tasks."""
    several = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    spread = several.select(F.col("digest").alias("of"), "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = rows.join(spread, (F.col("digest") == F.col("of")) & (F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)) == F.col("salt")), "left")
    return met.select(*rows.columns, F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("copied"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, doc_id, failed, good, toxic`` of every whole text under the filters A to E.

    A: under 200 words; B: under half of the words distinct; C: more than 3 % of the code
    points are A-Z; D: one of ``#$%&*|`` occurs; E: the text (by SHA-256) is that of a smaller
    id. Several labels of an id count together; a null id has no label and is no copy.
    """
    text = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spaced = F.col("text")
    for space in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(space), F.lit(" "))
    split = text.select("*", F.array_remove(F.split(spaced, " "), "").alias("words"))
    points = F.length("text")
    tests = [
        F.size("words") < 200,
        F.size(F.array_distinct("words")) * 100 < F.size("words") * 50,
        (points - F.length(F.regexp_replace("text", "[A-Z]+", ""))) * 100 > points * 3,
        F.col("text").rlike("[#$%&*|]"),
    ]
    bits = lambda flags, first=0: sum((F.when(t, F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(flags, first)), F.lit(0))
    narrow = saved(split.select("doc_id", "part", bits(tests).alias("failed"), F.sha2("text", 256).alias("digest")), "filter-audit-rows")
    marks = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    joined = _first_copies(narrow).join(marks, F.col("doc_id") == F.col("labelled"), "left")
    none = F.lit(False)
    return joined.select("part", "doc_id", (F.col("failed") + bits([F.col("copied")], 4)).alias("failed"), F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))
