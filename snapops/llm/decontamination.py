"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

A window can be similar to an item only if it holds one of the item's shingles. So each
place where a document has a shingle of the benchmark is lined up with the item: the window
there, as long as the item, gets a 64-bit SimHash of its weighted shingles. Fingerprints are
cut into 21 blocks, one more than the radius: whatever lies within 20 bits of an item's
fingerprint equals it in some block, so joining on length, block and value loses nothing
within the radius. Texts of similarity 0.8 differ in 10 bits on average, in more than 20
about once in 10,000. Pairs within the radius are verified on their shingles themselves.

Shingles are five words, lower-cased; a shingle weighs as often as it occurs. The similarity
of two texts is the sum of the lower over the sum of the higher weights, and from 0.8 on the
window counts as a leak. Items of under five words have one shingle, the whole sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapops.llm.common import saved

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
BITS = 64
#: First bit and width of each block; one more block than the radius.
BLOCKS = [(BITS * k // (RADIUS + 1), BITS * (k + 1) // (RADIUS + 1) - BITS * k // (RADIUS + 1)) for k in range(RADIUS + 1)]
#: Benchmark shingles of three numbers each that may be broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    split = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.filter(split, lambda w: w != "")


def _shingles(sequence: Column, n: Column, of) -> Column:
    """Of each ``least(5, n)`` words in a row; empty for an empty sequence."""
    size = F.least(F.lit(SHINGLE), n)
    places = F.sequence(F.lit(1), n - size + 1)
    return F.when(n > 0, F.transform(places, lambda i: of(F.slice(sequence, i, size)))).otherwise(F.array())


def simhash(grams: Column) -> Column:
    """64 bits: each is the majority of that bit over the shingles' hashes, as often as they occur."""
    ones = lambda b: F.aggregate(grams, F.lit(0), lambda n, g: n + F.getbit(g, b).cast("int"))
    bit = lambda b: F.when(ones(b) * 2 > F.size(grams), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), lambda got, b: got.bitwiseOR(bit(b)))


def blocks(fingerprint: Column) -> Column:
    """Block number and value in one integer each."""
    value = lambda start, width: F.shiftrightunsigned(fingerprint, start).bitwiseAND((1 << width) - 1)
    return F.array(*(value(start, width) * len(BLOCKS) + k for k, (start, width) in enumerate(BLOCKS)))


def similarity(left: Column, right: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of shingles, equal shingles adding up."""
    times = lambda among, s: F.size(F.filter(among, lambda x: x == s))
    lower = F.aggregate(F.array_intersect(left, right), F.lit(0), lambda n, s: n + F.least(times(left, s), times(right, s)))
    return lower / (F.size(left) + F.size(right) - lower)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, text_hash, item_id, start, similarity``: windows of documents that repeat an item.

    ``start`` is the window's first word. Defined cases: null and empty texts and items leak
    nothing; a document shorter than the item is one window; repeated rows give the same
    leaks once; equal items each count; rows without an id are found by their text.
    """
    text = lambda of: F.concat_ws(" ", of)
    said = benchmark.select(F.col("item_id"), words(F.col("text")).alias("said")).withColumn("length", F.size("said")).where("length > 0")
    items = saved(said.select("item_id", "length", "said", _shingles(F.col("said"), F.col("length"), F.xxhash64).alias("grams")), "benchmark-items")
    printed = saved(items.select("item_id", "length", "said", simhash(F.col("grams")).alias("item_print")), "benchmark-prints")
    marks = saved(items.select(F.least(F.lit(SHINGLE), "length").alias("width"), "length", F.posexplode("grams").alias("offset", "gram")).distinct(), "benchmark-grams")
    n_marks = marks.count()
    hinted = F.broadcast if n_marks <= BROADCAST_ROWS else lambda df: df
    widths = sorted(r[0] for r in marks.select("width").distinct().collect())  # 1 to 5

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    found = None
    for width in widths or [SHINGLE]:
        grams = F.transform(F.sequence(F.lit(1), F.col("n") - width + 1), lambda i: F.xxhash64(F.slice("words", i, width)))  # noqa: B023
        places = rows.where(F.col("n") >= width).select("doc_id", "text_hash", "n", F.posexplode(grams).alias("place", "gram"))
        own = places.join(hinted(marks.where(F.col("width") == width)), "gram")
        found = own if found is None else found.union(own)
    start = F.greatest(F.lit(0), F.least(F.col("place") - F.col("offset"), F.col("n") - F.col("length")))
    lined = saved(found.select("doc_id", "text_hash", start.alias("start"), "length").distinct(), "benchmark-lined")

    by_doc = lined.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "length")).alias("windows"))  # of one document
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").dropDuplicates(["doc_id", "text_hash"])
    held = texts.alias("t").join(by_doc.alias("b"), F.expr("t.doc_id <=> b.doc_id AND t.text_hash = b.text_hash"))
    cut = held.select("t.doc_id", "t.text_hash", words(F.col("t.text")).alias("words"), "b.windows")
    each = cut.select("doc_id", "text_hash", F.inline(F.transform("windows", lambda w: F.struct(w["start"].alias("start"), w["length"].alias("length"), F.slice("words", w["start"] + 1, w["length"]).alias("words")))))
    windows = saved(each.withColumn("window_print", simhash(_shingles(F.col("words"), F.size("words"), F.xxhash64))), "benchmark-windows")
    keyed = windows.withColumn("block", F.explode(blocks(F.col("window_print"))))
    indexed = printed.withColumn("block", F.explode(blocks(F.col("item_print"))))
    # A pair that shares several blocks is taken at the first of them.
    indexed = indexed.withColumnRenamed("block", "item_block").withColumnRenamed("length", "item_length")
    pairs = keyed.join(indexed, (F.col("length") == F.col("item_length")) & (F.col("block") == F.col("item_block")))
    near = pairs.where(F.bit_count(F.col("window_print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    shared = F.array_min(F.transform(F.array_intersect(blocks(F.col("window_print")), blocks(F.col("item_print"))), lambda b: b % len(BLOCKS)))
    near = near.where(F.col("block") % len(BLOCKS) == shared)
    # Written, so that the shingles are columns and not worked out again for each comparison.
    spelled = saved(near.select("doc_id", "text_hash", "item_id", "start", _shingles(F.col("words"), F.size("words"), text).alias("own"), _shingles(F.col("said"), F.size("said"), text).alias("theirs")), "benchmark-near")
    scored = saved(spelled.select("doc_id", "text_hash", "item_id", "start", similarity(F.col("own"), F.col("theirs")).alias("similarity")), "benchmark-scored")
    return scored.where(F.col("similarity") >= SIMILARITY).select("doc_id", "text_hash", "item_id", "start", "similarity")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, contaminated, n_items, item_ids, similarity`` for each row of ``docs``.

    ``item_ids`` are those found in the row's text, ``similarity`` is that of the closest
    window, 0 without a leak. An empty table gives an empty result; with an empty benchmark
    every row is clean.
    """
    found = leaks(docs, benchmark).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("similarity"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    joined = rows.alias("d").join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id AND d.text_hash = f.text_hash"), "left")
    ids = F.coalesce("f.item_ids", F.array().cast("array<bigint>"))
    return joined.select("d.doc_id", F.col("f.item_ids").isNotNull().alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.coalesce("f.similarity", F.lit(0.0)).alias("similarity"))
