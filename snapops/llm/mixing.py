"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in random order, form blocks. Block j of a source of weight w is
released at slot floor(j / w) and due at ceil((j + 1) / w). At each slot the released block
with the earliest deadline is next, so after t slots every source has had w * t blocks, give
or take less than one. The mix ends where the first source would run out; what other sources
have beyond that is left out. The mix has at most 65,536 blocks, larger ones for larger
inputs, so the schedule is small at any size.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapops.llm.common import numbered

SLOTS = 65_536
#: Without given weights, sources keep their natural shares but none has more than this.
LARGEST_SHARE = Fraction(1, 4)


def capped_shares(counts: dict, largest: Fraction = LARGEST_SHARE) -> dict:
    """Shares in proportion to the counts, no more than ``largest``, or equal shares if that is more."""
    largest = max(largest, Fraction(1, max(1, len(counts))))
    shares, full = {}, {}
    while len(full) < len(counts):
        rest = sum(n for s, n in counts.items() if s not in full)
        left = 1 - sum(full.values(), Fraction(0))
        shares = {s: left * n / rest for s, n in counts.items() if s not in full}
        over = {s: largest for s, share in shares.items() if share > largest}
        if not over:
            break
        full |= over
    return {s: full[s] if s in full else shares[s] for s in counts}


def earliest_deadline_first(weights: dict, blocks: dict) -> list[tuple]:
    """``(source, block, release, deadline, slot)`` in order, until a source would run out."""
    live = {s: Fraction(w) for s, w in weights.items() if w > 0}
    if not live or any(blocks.get(s, 0) == 0 for s in live):
        return []
    total = sum(live.values())
    live = {s: w / total for s, w in live.items()}
    end = min(blocks[s] * w.denominator // w.numerator for s, w in live.items())
    names = sorted(live, key=repr)
    waiting, ready, made = [(0, k, 0) for k in range(len(names))], [], []
    heapq.heapify(waiting)
    for slot in range(end):
        while waiting and waiting[0][0] <= slot:
            release, k, j = heapq.heappop(waiting)
            w = live[names[k]]
            heapq.heappush(ready, (-(-(j + 1) * w.denominator // w.numerator), k, j, release))
        if not ready:
            continue
        deadline, k, j, release = heapq.heappop(ready)
        made.append((names[k], j, release, deadline, slot))
        w = live[names[k]]
        heapq.heappush(waiting, ((j + 1) * w.denominator // w.numerator, k, j + 1))
    return made


def mixed_sources(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """``docs`` with ``block, release, deadline, slot, position, in_mix``; these replace columns of the same names.

    ``position`` orders the mix; it and the slot are null for documents left out. Defined
    cases: null is a source of its own; sources without a given weight, or with weight 0, are
    left out; a weighted source without documents gives an empty mix; repeated rows are
    placed one by one; an empty table gives an empty result. The list of sources, with their
    counts, is held by the driver: more than 65,536 sources raise an error.
    """
    added = ["block", "release", "deadline", "slot", "position", "in_mix"]
    kept = [c for c in docs.columns if c.lower() not in added]
    base = docs.select(*kept)
    spark = docs.sparkSession
    found = base.groupBy("source").count().limit(SLOTS + 1).collect()
    if len(found) > SLOTS:
        raise ValueError(f"more than {SLOTS} sources: give a coarser source column")
    counts = {r[0]: r[1] for r in found}
    weights = capped_shares(counts) if weights is None else {s: Fraction(w).limit_denominator(10**6) for s, w in weights.items()}
    live = [s for s, w in weights.items() if w > 0]
    share = sum(weights[s] for s in live)
    length = min((counts.get(s, 0) * share / weights[s] for s in live), default=0)
    size = max(1, -(-int(length) // SLOTS))
    plan = earliest_deadline_first(weights, {s: -(-n // size) for s, n in counts.items()})
    schedule = spark.createDataFrame(plan, "__source string, __block long, release long, deadline long, slot long")
    ranked = numbered(base, "source", [F.xxhash64("doc_id"), F.col("doc_id")], "__rank")
    ranked = ranked.withColumn("block", F.floor(F.col("__rank") / size).cast("long"))
    joined = ranked.join(F.broadcast(schedule), F.col("source").cast("string").eqNullSafe(F.col("__source")) & (F.col("block") == F.col("__block")), "left")
    position = F.col("slot") * size + F.col("__rank") % size
    return joined.select(*kept, "block", "release", "deadline", "slot", position.alias("position"), F.col("slot").isNotNull().alias("in_mix"))
