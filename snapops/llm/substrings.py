"""Substring deduplication by suffix trees over partitions of the suffixes.

Suffixes start at words. A window is the first 35 words of a suffix; a window that starts in
two places is an internal node of depth 35 or more in the tree of all suffixes. The tree is
built in parts: the prefix of a suffix, of up to 35 words, names its part.

* The prefix is reduced to its smallest hash over ten words in a row. Equal windows have
  equal such marks, and neighbouring suffixes mostly share theirs, so a run of suffixes is
  one row, about one for thirteen words.
* Marks that occur once cannot hold a repeat; their suffixes are leaves and go first.
* The words of the others are gathered by mark, if it has no more than 50,000 suffixes: a
  group that fits into memory. Its tree is built from the root down: the suffixes of a node
  split by their next words, nodes of one suffix are leaves and are dropped, and
  what is left at depth 35 is the repeats.
* A mark with more suffixes gets a longer prefix, all 35 words: the group of such a prefix is one
  node, and counting it, with partial counts before the shuffle, is all that is needed. So a
  passage in a third of all documents is no single task.

Words are compared by 64-bit hashes at each of the 35 places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapops.llm.common import saved, whole_groups
from snapops.llm.words import mixed, slices

WINDOW = 35
MARK = 10
#: Suffixes of one mark that are gathered in one tree; beyond, the prefix is longer.
GATHERED = 50_000

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` words in a row, from halves of power-of-two lengths."""
    if len(hashes) < n:
        return hashes[:0]
    out, done, part, length = None, 0, hashes, 1
    left = n
    while left:
        if left & 1:
            piece = part[done : done + len(hashes) - n + 1]
            out = piece if out is None else mixed(out * _STEP + piece)
            done += length
        left >>= 1
        if left:
            part = mixed(part[:-length] * _STEP + part[length:])
            length *= 2
    return out


def runs(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First suffix, number of suffixes and mark of each run of suffixes of one document with a common mark,
    and whether the mark stands at more than one place of the run.
    """
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, bool)
    grams = mixed(rolled(hashes, MARK) ^ _U(0x5851F42D4C957F2D))
    low = grams
    width, want = 1, WINDOW - MARK + 1
    while width < want:
        step = min(width, want - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    number, mark = np.diff(np.append(first, n)), low[first]
    again = np.zeros(len(first), bool)
    if len(np.unique(grams)) < len(grams):
        for k, (a, m, value) in enumerate(zip(first, number, mark, strict=True)):
            again[k] = np.count_nonzero(grams[a : a + m + WINDOW - MARK] == value) > 1
    return first, number, mark, again


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch.column("text")):
            ids = batch.column("doc_id").slice(part.first, len(part.counts)).to_numpy(zero_copy_only=False)
            at = part.offsets
            found = [runs(part.hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            owner = np.repeat(ids, [len(f[0]) for f in found])
            first, number, mark = (np.concatenate([f[k] for f in found]) for k in range(3))
            again = np.concatenate([f[3] for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(mark.view(np.int64)), pa.array(owner.astype(np.int64)), pa.array(first.astype(np.int32)), pa.array(number.astype(np.int32)), pa.array(again)], ["mark", "doc_id", "first", "number", "again"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's live runs with their words: as hashes of words, or of whole windows for long prefixes."""
    for batch in batches:
        runs_of = batch.column("runs").to_pylist()
        ids = batch.column("doc_id").to_pylist()
        for part in slices(batch.column("text")):
            rows: dict[str, list] = {"mark": [], "doc_id": [], "first": [], "number": [], "words": [], "long": []}
            at = part.offsets
            for k in range(len(part.counts)):
                own = part.hashes[at[k] : at[k + 1]]
                whole = None
                for run in runs_of[part.first + k]:
                    a, n = run["first"], run["number"]
                    if run["long"] and whole is None:
                        whole = rolled(own, WINDOW)
                    held = whole[a : a + n] if run["long"] else own[a : a + n + WINDOW - 1]
                    for name, value in (("mark", run["mark"]), ("doc_id", ids[part.first + k]), ("first", a), ("number", n), ("words", held.tobytes()), ("long", run["long"])):
                        rows[name].append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], list(rows))


def repeats(words: np.ndarray, starts: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Which suffixes share their first 35 words with another of their part; the trees grow from their roots.

    ``starts`` are the suffixes' places in ``words`` and ``parts`` names the part of each.
    Every step splits the suffixes of a node by their next words, eight at once.
    """
    live, node, depth = np.arange(len(starts)), parts.astype(_U), 0
    while depth < WINDOW and len(live):
        step = min(8, WINDOW - depth)
        key = mixed(node * _STEP + rolled(words, step)[starts[live] + depth])
        order = np.argsort(key)
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        child = np.empty(len(order), np.int64)
        child[order] = np.cumsum(new) - 1
        inner = np.bincount(child)[child] > 1
        live, node, depth = live[inner], key[inner], depth + step
    found = np.zeros(len(starts), bool)
    found[live] = True
    return found


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, "mark"):
        if not table.num_rows:
            continue
        numbers, first = table["number"].to_numpy().astype(np.int64), table["first"].to_numpy()
        held = [np.frombuffer(w.as_buffer(), _U) for w in table["words"]]
        base = np.concatenate([[0], np.cumsum([len(w) for w in held])])[:-1]
        within = np.arange(numbers.sum()) - np.repeat(np.cumsum(numbers) - numbers, numbers)
        found = repeats(np.concatenate(held), np.repeat(base, numbers) + within, np.repeat(table["mark"].to_numpy().view(_U), numbers))
        owner, place = np.repeat(table["doc_id"].to_numpy(), numbers)[found], (np.repeat(first, numbers) + within)[found]
        run = np.repeat(np.arange(len(numbers)), numbers)[found]
        yield _spans_batch(owner, place, run)


def _spans_batch(owner: np.ndarray, place: np.ndarray, run: np.ndarray) -> pa.RecordBatch:
    """Neighbouring windows of one run as one span of words."""
    ends = np.flatnonzero(np.concatenate([(np.diff(run) != 0) | (np.diff(place) != 1), np.ones(min(1, len(run)), bool)]))
    begins = np.concatenate([np.zeros(min(1, len(run)), np.int64), ends[:-1] + 1])
    columns = [owner[begins], place[begins].astype(np.int32), (place[ends] + WINDOW).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "start", "end"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers = batch.column("number").to_numpy()
        hashes = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(w.as_buffer(), np.int64) for w in batch.column("words"))])
        places = np.repeat(batch.column("first").to_numpy(), numbers) + np.arange(len(hashes)) - np.repeat(np.cumsum(numbers) - numbers, numbers)
        yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.repeat(batch.column("doc_id").to_numpy(), numbers)), pa.array(places.astype(np.int32))], ["window", "doc_id", "start"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, start, end``: word spans, which may overlap, covered by windows that start elsewhere too.

    ``docs`` has ``doc_id`` and ``text``; the id must tell its rows apart.
    """
    marks = saved(docs.mapInArrow(_marks, "mark long, doc_id long, first int, number int, again boolean"), "suffix-marks")
    counts = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.sum("number").alias("suffixes"), F.max("again").alias("again")).where("n > 1 OR again")
    live = marks.join(counts.select("mark", (F.col("suffixes") > GATHERED).alias("long")), "mark")
    by_doc = live.groupBy("doc_id").agg(F.collect_list(F.struct("mark", "first", "number", "long")).alias("runs"))  # of one document
    cut = saved(docs.join(by_doc, "doc_id").select("doc_id", "text", "runs").mapInArrow(_cut, "mark long, doc_id long, first int, number int, words binary, long boolean"), "suffix-runs")
    short = cut.where("NOT long").drop("long").repartition("mark").sortWithinPartitions("mark").mapInArrow(_trees, "doc_id long, start int, end int")
    windows = cut.where("long").select("doc_id", "first", "number", "words").mapInArrow(_windows, "window long, doc_id long, start int")
    again = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    long = windows.join(again, "window").select("doc_id", "start", (F.col("start") + WINDOW).alias("end"))
    return short.union(long)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, out = batch.column("text"), []
        for text, found in zip(texts, batch.column("spans").to_pylist(), strict=True):
            words = (text.as_py() or "").encode().split()
            keep = np.ones(len(words), bool)
            for span in found or ():
                keep[span["start"] : span["end"]] = False
            kept = b" ".join(words[i] for i in np.flatnonzero(keep)) if found else b" ".join(words)
            out.append((len(words), int(len(words) - keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text`` for each row of ``docs``.

    Windows are judged on the input: every copy of a repeat goes, also the first. Defined
    cases: null and empty texts have no words; a text of fewer than 35 words keeps them all;
    rows with equal ids are told apart by their place in the files, so equal rows repeat each
    other; an empty table gives an empty result. Only the two columns are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    doubles = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").limit(1).count()
    if doubles:
        rows = saved(rows.withColumn("doc_id", F.monotonically_increasing_id()), "suffix-rows")
    else:
        rows = rows.withColumn("doc_id", F.col("id"))
    keyed = rows.select("doc_id", "text")
    spans_of = repeated_spans(keyed).groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = rows.join(spans_of, "doc_id", "left").select(F.col("id").alias("doc_id"), "text", "spans")
    return joined.mapInArrow(_removed, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
