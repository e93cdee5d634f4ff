"""Near-duplicate documents by MinHash with tensored banding.

Instead of 196 independent tables, each document has two collections of 14 half keys, of
three minhashes each; a table's key is a pair of one half from either collection. So 84
minhashes serve 14 x 14 tables. Texts of similarity 0.85 meet in some table unless all halves
of one collection differ: 3 in 100,000 times, and far less for closer texts.

Half keys that only one document has cannot form a shared table key and go first. Documents
sharing a table key form clusters, and within a cluster links are confirmed on full shingle
sets. Large clusters are cut into blocks of about 256 documents of like set size; only pairs
of blocks whose sizes allow a link meet, in one task each, and yield a spanning forest of
their links, never all pairs. Documents with equal sets are one class from the start, so
copies cost nothing further.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapops.llm.common import components, groups, saved
from snapops.llm.words import mixed, shingle_sets, slices

#: Half keys in each of the two collections, and minhashes in a half key.
HALVES, IN_HALF = 14, 3
#: Link at 100 * intersection >= 85 * union.
PERCENT = 85
BLOCK = 256
#: Hash columns of a block pair's incidence matrix that are held at once.
COLUMNS = 4096

_N = 2 * HALVES * IN_HALF
_FACTORS = mixed(np.arange(1, _N + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_FLIPS = mixed(np.arange(1001, _N + 1001, dtype=np.uint64)).astype(np.uint32)


def half_keys(found: np.ndarray) -> np.ndarray:
    """The 28 half keys of one shingle set."""
    low = np.full(_N, 0xFFFFFFFF, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        np.minimum(low, ((short[at : at + 2048, None] ^ _FLIPS) * _FACTORS).min(axis=0), out=low)
    three = low.reshape(-1, IN_HALF).astype(np.uint64)
    key = np.arange(2 * HALVES, dtype=np.uint64)
    for k in range(IN_HALF):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + three[:, k])
    return key.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch.column("text"), lower=True):
            sets = shingle_sets(part)
            keys = [half_keys(s) if len(s) else np.zeros(0, np.int64) for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(part.first, len(sets)),
                    batch.column("text_key").slice(part.first, len(sets)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys))),
                ],
                ["doc_id", "text_key", "n_shingles", "set_hash", "halves"],
            )


def _overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all intersections of the left sets with the right ones, or with each other."""
    both = left + (right or [])
    flat = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    counts = np.zeros((len(left), len(right) if right else len(left)), np.int64)
    bounds = np.searchsorted(column, np.arange(0, int(shared.sum()) + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        matrix = np.zeros((len(both), COLUMNS), np.float32)
        matrix[owner[a:b], column[a:b] - k * COLUMNS] = 1
        counts += np.rint(matrix[: len(left)] @ (matrix[len(left) :] if right else matrix).T).astype(np.int64)
    return counts


def forest(ids: list[int], sets: list[np.ndarray], n_left: int | None = None) -> list[tuple[int, int]]:
    """Edges that join the linked documents: of all, or only across the first ``n_left`` and the rest."""
    if len(ids) < 2 or n_left in (0, len(ids)):
        return []
    sizes = np.array([len(s) for s in sets])
    if n_left is None:
        shared, union = _overlaps(sets, None), sizes[:, None] + sizes
        linked = 100 * shared >= PERCENT * (union - shared)
    else:
        shared = _overlaps(sets[:n_left], sets[n_left:])
        across = 100 * shared >= PERCENT * (sizes[:n_left, None] + sizes[n_left:] - shared)
        linked = np.zeros((len(ids), len(ids)), dtype=bool)
        linked[:n_left, n_left:], linked[n_left:, :n_left] = across, across.T
    np.fill_diagonal(linked, True)
    label = np.arange(len(ids))
    while True:
        lower = np.where(linked, label, len(ids)).min(axis=1)
        if (lower == label).all():
            break
        label = lower
    return [(ids[i], ids[r]) for i, r in enumerate(label.tolist()) if i != r]


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in groups(batches, ["cluster", "low", "high"]):
        ids, own = group["class_id"].to_pylist(), group["block"].to_numpy()
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        sets = [s for part in slices(group["text"], lower=True) for s in shingle_sets(part)]
        if low != high:
            order = np.argsort(own != low, kind="stable")
            ids, sets = [ids[i] for i in order], [sets[i] for i in order]
        edges = forest(ids, sets, None if low == high else int((own == low).sum()))
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in edges], pa.int64()), pa.array([v for _, v in edges], pa.int64())], ["u", "v"])


def _clusters(classes: DataFrame) -> DataFrame:
    """``class_id, cluster`` of classes that share a table key with others."""
    halves = classes.select("class_id", F.posexplode("halves").alias("place", "half"))
    common = halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    left, right = (F.sort_array(F.collect_set(F.when(cond, F.col("half")))) for cond in (F.col("place") < HALVES, F.col("place") >= HALVES))
    live = halves.join(common, "half").groupBy("class_id").agg(left.alias("left"), right.alias("right"))
    tables = saved(live.select("class_id", F.explode("left").alias("a"), "right").select("class_id", "a", F.explode("right").alias("b")).select("class_id", F.xxhash64("a", "b").alias("key")), "near-tables")
    first = tables.groupBy("key").agg(F.min("class_id").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "v")
    meet = tables.join(first, "key").where("class_id <> v").select(F.col("class_id").alias("u"), "v").distinct()
    roots = components(meet, "near-clusters")
    return roots.select(F.col("u").alias("class_id"), F.col("root").alias("cluster")).union(roots.select("root", "root").distinct())


def _links(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``u, v`` edges that span the links within clusters; ``members``: class_id, doc_id, text_key, cluster, n_shingles.

    A class's text is that of its smallest id; the key of the text tells which, where an id has several.
    """
    total = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("total"))
    grade = F.floor(F.log(F.col("n_shingles").cast("double")) / -math.log(PERCENT / 100) * (1 - 1e-9)).cast("int")
    graded = saved(members.join(total, "cluster").select("class_id", "doc_id", "text_key", "cluster", F.when(F.col("total") <= BLOCK, 0).otherwise(grade).alias("grade")), "near-graded")
    cuts = graded.groupBy("cluster", "grade").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cuts"))
    by_grade = cuts.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("grade", "cuts"))).alias("cuts"))  # a few dozen grades of size
    number = lambda g, i: g.cast("long") * 2**32 + i.cast("long")
    cuts_of = lambda g: F.coalesce(F.try_element_at("cuts", g), F.lit(0))
    own = number(F.col("grade"), F.pmod(F.xxhash64("class_id"), cuts_of(F.col("grade"))))
    beside = lambda g: F.when(cuts_of(g) > 0, F.transform(F.sequence(F.lit(0), cuts_of(g) - 1), lambda i: number(g, i))).otherwise(F.array().cast("array<bigint>"))
    others = F.explode(F.concat(*(beside(F.col("grade") + k) for k in (-1, 0, 1))))
    tasks = graded.join(by_grade, "cluster").withColumn("block", own).withColumn("other", others)
    tasks = tasks.select("class_id", "doc_id", "text_key", "cluster", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    text_of = ["doc_id", "text_key"]
    texts = docs.join(graded.select("doc_id"), "doc_id", "left_semi")
    texts = texts.groupBy(*text_of).agg(F.first("text").alias("text")).join(tasks, text_of)
    keys = ["cluster", "low", "high"]
    return texts.select(*keys, "block", "class_id", "text").repartition(*keys).sortWithinPartitions(*keys, "class_id").mapInArrow(_confirmed, "u long, v long")


def _of_one_id(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """``u, v`` edges between the classes that an id with several texts belongs to."""
    several = signed.groupBy("doc_id").agg(F.min("set_hash").alias("low"), F.max("set_hash").alias("high")).where("low <> high").select("doc_id", F.col("low").alias("first_hash"))
    pairs = signed.join(several, "doc_id").where("set_hash <> first_hash").select("set_hash", "first_hash").distinct()
    numbers = classes.select("set_hash", F.col("class_id").alias("u"))
    first = classes.select(F.col("set_hash").alias("first_hash"), F.col("class_id").alias("v"))
    return pairs.join(numbers, "set_hash").join(first, "first_hash").select("u", "v")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Words are lower-cased (A to Z). Defined cases: null and empty texts, and texts of spaces,
    have no shingles and are linked with nothing; texts of under five words have one shingle,
    the whole sequence; repeated rows are one class; an id that occurs with several texts is
    one document that has all their links; rows without an id take no part: they have no
    component and are kept; an empty table gives an empty result. Only the two columns are
    read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    signed = saved(rows.mapInArrow(_signatures, "doc_id long, text_key long, n_shingles long, set_hash binary, halves array<long>"), "near-signatures")
    usable = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    picked = usable.groupBy("set_hash").agg(F.min(F.struct("doc_id", "text_key", "n_shingles", "halves")).alias("r")).select("set_hash", "r.*")
    classes = saved(picked.withColumn("class_id", F.monotonically_increasing_id()), "near-classes")
    members = _clusters(classes).join(classes.select("class_id", "doc_id", "text_key", "n_shingles"), "class_id")
    links = _links(rows, saved(members, "near-members")).union(_of_one_id(usable, classes))
    roots = components(links, "near-links")
    placed = classes.join(roots, F.col("class_id") == F.col("u"), "left").select("set_hash", "doc_id", F.coalesce("root", "class_id").alias("root"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("least"))
    named = placed.join(least, "root").select("set_hash", F.col("least").alias("root"))
    joined = signed.select("doc_id", "n_shingles", "set_hash").join(named, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
