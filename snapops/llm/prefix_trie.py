"""Conversation prefix trie by truncation peeling.

A conversation is the path of its turns' digests (128 bits of SHA-256 over role and text).
Each distinct path prefix is a node. Peeling starts at the greatest depth: conversations that
end there are merged into nodes, the nodes lose their last turn and are regrouped with the
conversations that end one turn earlier, and so on to the root. A node's members, children,
leaves and saved bytes are added up in the same step that discovers it.

Paths are range-partitioned and sorted, so the members of a node stand in a row, and each task
peels its own rows. A node that holds neither the first nor the last row of its task is whole
and leaves as a result. The others, the prefixes of those two paths, leave with what they have
gathered so far, as two rows; in the next round the rows of 64 tasks are peeled in the same
way, until one group is left. So a prefix that a third of all conversations share is spread
over as many tasks as its rows need, and no group has more than 128 paths.

One conversation is one row of its digests, 24 bytes a turn; texts are not shuffled at all.
The digest of a node's own conversations runs over their sorted ids as a stream, in the one
task of that node, as SHA-256 demands; its memory is one Arrow batch.

Defined cases: a null role or text is the empty string; rows without a conversation id are
left out; null turns come first, equal turn numbers go in the order of the turns' digests, and
a repeated row is a turn like others; a conversation without turns ends at the root; an empty
table has no nodes, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapops.llm.common import saved

#: Turns a task is meant to peel in the first round.
TASK_TURNS = 2_000_000
#: Tasks whose outermost paths are peeled together in the next round.
FAN_IN = 64
#: Tasks over which the children of one unfinished node are spread to learn its smallest member.
SALTS = 32
NONE = np.iinfo(np.int64).max
SUMS = ("n", "ended", "children", "leaves", "saved")
LEAST = ("least", "first_end")
ADDS = "depth bigint, n bigint, ended bigint, children bigint, leaves bigint, saved bigint, least bigint, first_end bigint"
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ended bigint, first_end bigint, node_key string, parent_key string"
ROW = f"task bigint, side bigint, path array<binary>, sizes array<bigint>, adds array<struct<{ADDS.replace(' ', ':').replace(',:', ',')}>>"
TURN = 16


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, path, sizes``: each conversation's turn digests and text bytes, in turn order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, TURN)
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size")).alias("turn"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return listed.select("conv_id", F.col("turns.digest").alias("path"), F.col("turns.size").alias("sizes"))


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Offsets of a list column, and its values in one piece."""
    lengths = pc.list_value_length(lists).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(lists)
    return np.concatenate([[0], np.cumsum(lengths)]), values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values


def _turn_keys(values: pa.Array) -> np.ndarray:
    """The digests as two numbers each."""
    fixed = values.cast(pa.binary(TURN))
    return np.frombuffer(fixed.buffers()[1], np.uint64, 2 * len(fixed), TURN * fixed.offset).reshape(-1, 2) if len(fixed) else np.zeros((0, 2), np.uint64)


def _common(offsets: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How many first turns each path shares with the one before it; -1 for the first."""
    lengths = np.diff(offsets)
    shared = np.zeros(len(lengths), np.int64)
    shared[0] = -1
    alive, depth = np.arange(1, len(lengths)), 0
    while len(alive):
        alive = alive[(lengths[alive] > depth) & (lengths[alive - 1] > depth)]
        alive = alive[(keys[offsets[alive] + depth] == keys[offsets[alive - 1] + depth]).all(axis=1)]
        depth += 1
        shared[alive] = depth
    return shared


def _prefix_keys(turns: np.ndarray) -> list[str]:
    """A key for each prefix of one path, from the empty one on."""
    running = hashlib.blake2b(digest_size=TURN)
    keys = [running.hexdigest()]
    for turn in turns:
        running.update(turn.tobytes())
        keys.append(running.copy().hexdigest())
    return keys


class _Out:
    """Finished nodes and open paths, as batches of one schema."""

    def __init__(self, schema: pa.Schema, task: int):
        self.schema, self.task, self.parts = schema, task, []

    def nodes(self, depth: int, node: dict[str, np.ndarray], parent: np.ndarray, parent_key: list, node_key: list) -> None:
        count = len(parent)
        if not count:
            return
        first = pa.array(node["first_end"], mask=node["ended"] == 0)
        columns = [pa.array(node["least"]), pa.array(np.full(count, depth)), pa.array(parent, mask=parent == NONE), *(pa.array(node[c]) for c in ("n", "children", "leaves", "saved", "ended"))]
        columns += [first, pa.array(node_key, pa.string()), pa.array(parent_key, pa.string())]
        self.parts.append(pa.table([*columns, *(pa.nulls(count, f.type) for f in list(self.schema)[len(columns) :])], self.schema))

    def open(self, side: int, path: list, sizes: list, adds: list) -> None:
        fields = list(self.schema)
        values = [self.task, side, path, sizes, adds]
        empty = [pa.nulls(1, f.type) for f in fields[: -len(values)]]
        self.parts.append(pa.table([*empty, *(pa.array([v], f.type) for v, f in zip(values, fields[-len(values) :], strict=True))], self.schema))

    def table(self) -> pa.Table:
        return pa.concat_tables(self.parts) if self.parts else self.schema.empty_table()


def peel(rows: pa.Table, schema: pa.Schema, task: int, last: bool, keyed: bool) -> pa.Table:
    """Peel sorted paths from the greatest depth to the root.

    ``last``: there are no other rows, so every node is finished. ``keyed``: finished nodes
    carry their key, since nodes of an earlier round may be their children.
    """
    out = _Out(schema, task)
    offsets, path_values = _flat(rows["path"])
    lengths, keys = np.diff(offsets), _turn_keys(path_values)
    sizes = _flat(rows["sizes"])[1].to_numpy(zero_copy_only=False)
    add_offsets, structs = _flat(rows["adds"])
    adds = {f.name: c.to_numpy(zero_copy_only=False) for f, c in zip(structs.type, structs.flatten(), strict=True)}
    add_rows = np.repeat(np.arange(len(lengths)), np.diff(add_offsets))
    order = np.lexsort((add_rows, adds["depth"]))
    adds, add_rows = {k: v[order] for k, v in adds.items()}, add_rows[order]
    shared, end = _common(offsets, keys), len(lengths) - 1
    # Rows 0 to left[d] - 1 share the first d turns of the first path, rows right[d] on those of the last.
    from_first = np.minimum.accumulate(shared[1:])
    from_last = np.minimum.accumulate(shared[1:][::-1])
    path_keys = {r: _prefix_keys(keys[offsets[r] : offsets[r + 1]]) for r in (range(end + 1) if keyed else {0, end})}
    sides: dict[int, list[tuple]] = {0: [], 1: []}
    above = {c: np.zeros(0, np.int64) for c in ("row", *SUMS, *LEAST)}

    for depth in range(int(lengths.max()), -1, -1):
        a, b = np.searchsorted(adds["depth"], [depth, depth + 1])
        row = np.concatenate([add_rows[a:b], above["row"]])
        if not len(row):
            continue
        by = np.argsort(row, kind="stable")
        row = row[by]
        children = len(above["row"])
        zeros, ones, nones = np.zeros(children, np.int64), np.ones(children, np.int64), np.full(children, NONE)
        inherited = {"n": above["n"], "ended": zeros, "children": ones, "leaves": above["leaves"], "saved": above["saved"], "least": above["least"], "first_end": nones}
        left = 1 + int(np.searchsorted(-from_first, -depth, "right"))
        right = end - int(np.searchsorted(-from_last, -depth, "right"))
        starts = np.concatenate([[True], (row[1:] != row[:-1]) & (shared[row[1:]] < depth)])
        if not last and right < left:
            starts[1:] = False
        elif not last:
            at = int(np.searchsorted(row, right))
            if at < len(row):
                starts[at] = True
        heads = np.flatnonzero(starts)
        node = {"row": row[heads]}
        for c in (*SUMS, *LEAST):
            values = np.concatenate([adds[c][a:b], inherited[c]])[by]
            node[c] = (np.add if c in SUMS else np.minimum).reduceat(values, heads)
        first, final = node["row"] < left, node["row"] >= right
        whole = np.ones(len(heads), bool) if last else ~(first | final)

        group = (np.cumsum(starts) - 1)[np.argsort(by, kind="stable")][b - a :]
        parent = np.where(whole[group], node["least"][group], NONE)
        waits = [None if whole[g] else path_keys[0 if first[g] else end][depth] for g in group.tolist()] if not whole.all() else [None] * children
        own = [path_keys[r][depth + 1] for r in above["row"].tolist()] if keyed else [None] * children
        out.nodes(depth + 1, above, parent, waits, own)

        for g in np.flatnonzero(~whole).tolist():
            sides[0 if first[g] else 1].append((depth, *(int(node[c][g]) for c in (*SUMS, *LEAST))))
        node["leaves"] = node["leaves"] + (node["children"] == 0)
        if depth:
            node["saved"] = node["saved"] + (node["n"] - 1) * sizes[offsets[node["row"]] + depth - 1]
        above = {c: v[whole] for c, v in node.items()}

    if last:
        out.nodes(0, above, np.array([NONE]), [None], [path_keys[0][0]])
    names = ("depth", *SUMS, *LEAST)
    for side, r in ((0, 0), (1, end)):
        if sides[side]:
            turns = [t.tobytes() for t in keys[offsets[r] : offsets[r + 1]]]
            out.open(side, turns, sizes[offsets[r] : offsets[r + 1]].tolist(), [dict(zip(names, s, strict=True)) for s in sides[side]])
    return out.table()


def _schema(spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], f"{NODE}, {ROW}").schema)


def _first_round(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from peel(pa.Table.from_batches(held), schema, TaskContext.get().partitionId(), False, False).to_batches(max_chunksize=65_536)

    return run


def _next_round(schema: pa.Schema, last: bool) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        ordered = rows.sort_by([("task", "ascending"), ("side", "ascending")])
        return peel(ordered, schema, rows["block"][0].as_py(), last, True)

    return run


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest id and the digest of all ids of each key, from rows sorted by key and id."""
    names = ["first_end", "ends_sha256"]
    key, least, running = None, None, None
    for rows in batches:
        found = []
        ids, runs = rows["conv_id"].to_pylist(), rows["key"].dictionary_encode()
        codes = runs.indices.to_numpy()
        bounds = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a == b:
                continue
            here = runs.dictionary[int(codes[a])].as_py()
            text = ",".join(map(str, ids[a:b]))
            if here == key:
                running.update(f",{text}".encode())
                continue
            if running is not None:
                found.append((least, running.hexdigest()))
            key, least, running = here, ids[a], hashlib.sha256(text.encode())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names)
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([least]), pa.array([running.hexdigest()])], names)


def ends(paths: DataFrame) -> DataFrame:
    """``first_end, ends_sha256`` of each distinct path: its smallest conversation and the digest of all."""
    key = F.md5(F.array_join(F.transform("path", lambda turn: F.hex(turn)), ""))
    rows = paths.select(key.alias("key"), "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    return rows.mapInArrow(_end_digests, "first_end bigint, ends_sha256 string")


def prefix_trie(paths: DataFrame) -> DataFrame:
    """One row per node from ``conv_id, path, sizes`` rows, one for each conversation.

    ``conv_id`` and ``parent_conv_id`` are the smallest members of the node and its parent,
    ``saved_tokens`` the bytes a cache of each node's last text saves in the node's subtree.
    """
    spark = paths.sparkSession
    schema = _schema(spark)
    paths = saved(paths.select("conv_id", "path", "sizes"), "trie-paths")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    depth = F.size("path").cast("long")
    own = F.struct(depth.alias("depth"), one.alias("n"), one.alias("ended"), zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), F.col("conv_id").alias("least"), F.col("conv_id").alias("first_end"))
    turns = paths.agg(F.sum(depth + 1)).first()[0] or 0
    # The id is part of the range, so that copies of one conversation spread over tasks.
    rows = paths.select("path", "conv_id", "sizes", F.array(own).alias("adds")).repartitionByRange(max(1, -(-turns // TASK_TURNS)), "path", "conv_id")
    rows = rows.sortWithinPartitions("path").drop("conv_id")
    done = [saved(rows.mapInArrow(_first_round(schema), f"{NODE}, {ROW}"), "trie-round")]
    while (tasks := done[-1].where("path IS NOT NULL").agg(F.max("task")).first()[0]) is not None:
        left = done[-1].where("path IS NOT NULL").select(F.expr(f"task div {FAN_IN}").alias("block"), "task", "side", "path", "sizes", "adds")
        done.append(saved(left.groupBy("block").applyInArrow(_next_round(schema, tasks < FAN_IN), f"{NODE}, {ROW}"), "trie-round"))

    nodes = reduce(DataFrame.unionByName, (d.where("path IS NULL") for d in done))
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS))
    parents = nodes.where("node_key IS NOT NULL").select(F.col("node_key").alias("key"), F.col("conv_id").alias("found"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    waiting = nodes.where("parent_key IS NOT NULL")
    met = waiting.join(parents, (F.col("parent_key") == F.col("key")) & (salt == F.col("salt"))).withColumn("parent_conv_id", F.col("found"))
    whole = nodes.where("parent_key IS NULL").unionByName(met.select(*nodes.columns))

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ended = whole.where("ended > 0").join(ends(paths), "first_end").select(*columns, "ends_sha256")
    passed = whole.where("ended = 0").select(*columns, F.lit(hashlib.sha256(b"").hexdigest()).alias("ends_sha256"))
    return ended.unionByName(passed)


def with_borrowed_heads(convs: DataFrame) -> DataFrame:
    """Conversations rebuilt so that neighbours share their beginnings.

    Conversation ``c`` becomes the first ``h = crc32(c) % 9`` turns of conversation ``c - c % 5``
    and its own turns after its first ``h``.
    """
    head, own, after = "h", F.size("path"), F.col("h") + 1
    taken = convs.select("*", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int").alias(head), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    heads = convs.select(F.col("conv_id").alias("base_id"), F.slice("path", 1, 8).alias("base_path"), F.slice("sizes", 1, 8).alias("base_sizes"))
    joined = taken.join(heads, F.col("base") == F.col("base_id"), "left")

    def rebuilt(name: str):
        rest = F.slice(F.col(name), after, F.greatest(own - F.col(head), F.lit(0)))
        return F.concat(F.coalesce(F.slice(F.col(f"base_{name}"), F.lit(1), F.col(head)), F.slice(F.col(name), 1, 0)), rest).alias(name)

    return joined.select("conv_id", rebuilt("path"), rebuilt("sizes"))
