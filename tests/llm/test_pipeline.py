"""The pipeline, stage by stage and as a whole, against plain-Python versions on a small fixture."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from math import ceil, floor

import pytest
import zstandard

import corpus_pipeline
from snapops.llm import langid

SPACE = re.compile(r"[\x20\x09-\x0D]+")
ITEM = "which of these four rivers carries the most water into the northern sea during the wet months of a year"
SAID = {
    "en": "the cat sat on mat and then went home with friends because night was cold under bright stars while music played near water".split(),
    "de": "der hund lief durch den wald und dann nach hause weil nacht kalt war unter hellen sternen neben dem alten haus am fluss".split(),
}


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def made():
    """``(doc_id, text, lang, source)``: a hot source, copies, near copies, leaks, nulls, empties, a long text."""
    draw = random.Random(11)
    rows = []
    for i in range(60):
        lang = ("en", "de")[i % 2]
        rows.append((i, " ".join(draw.choices(SAID[lang], k=draw.randint(50, 90))), lang if i % 5 else None, ("a", "a", "b", "c", None, "a")[i % 6]))
    rows += [(60 + i, rows[i][1], None, "b") for i in range(5)]
    for i in range(5, 9):
        w = rows[i][1].split()
        w[-1] = "changed"
        rows.append((60 + i, " ".join(w), "en", "c"))
    rows += [(70, f"{rows[10][1]} {ITEM} {rows[12][1]}", "en", "a"), (71, ITEM, "en", "b"), (72, None, "en", "a"), (73, "", None, "b"), (74, "12 !?", "de", "c")]
    return rows + [(75, " ".join(draw.choices(SAID["en"], k=20_000)), None, "d"), (76, rows[20][1], "en", "a"), (76, rows[20][1], "en", "a")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    rows = [(*r, len(r[1] or "")) for r in made()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def clear(rows, content):
    """Rows whose smallest encoding is below the next by the margin."""
    kept = []
    for row in rows:
        text = row[1]
        if text is None or not any(c.isalpha() for c in text):
            continue
        data = b" " + langid.reduced(text) + b" "
        sizes = []
        for blob in content.values():
            known = zstandard.ZstdCompressionDict(blob, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            if len(data) > langid.SHORT:
                known.precompute_compress(level=langid.LEVEL)
                coder = zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
            else:
                fine = zstandard.ZstdCompressionParameters.from_level(langid.SHORT_LEVEL, source_size=langid.SHORT, dict_size=len(blob), min_match=3, write_content_size=False)
                coder = zstandard.ZstdCompressor(dict_data=known, compression_params=fine)
            sizes.append(sum(len(coder.compress(data[a : a + langid.PIECE])) for a in range(0, len(data), langid.PIECE)))
        low, high = sorted(sizes)[:2]
        if (high - low) / high >= langid.MARGIN:
            kept.append(row)
    return kept


def one_of_each(rows):
    sets = {r[0]: frozenset(tuple(w[i : i + 5]) for w in [words(r[1].lower())] for i in range(max(1, len(w) - 4))) if words(r[1]) else frozenset() for r in rows}
    low = {i: i for i in sets}
    while True:
        found = {a: min(low[b] for b in sets if a == b or sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])) for a in sets}
        if found == low:
            return [r for r in rows if low[r[0]] == r[0]]
        low = found


def without_item(rows):
    def grams(w):
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    item = words(ITEM.lower())
    theirs = grams(item)

    def leaks(text):
        w = words(text.lower())
        windows = [w[i : i + len(item)] for i in range(max(1, len(w) - len(item) + 1))]
        return any(sum((grams(x) & theirs).values()) >= 0.8 * sum((grams(x) | theirs).values()) for x in windows if x)

    return [r for r in rows if not leaks(r[1])]


def in_mix(rows):
    """Documents a source has in the mix: at each slot the released block that is due first."""
    counts = Counter(r[3] for r in rows)
    largest, shares = max(Fraction(1, 4), Fraction(1, len(counts))), {}
    while True:
        rest = {s: n for s, n in counts.items() if s not in shares}
        left = 1 - sum(shares.values(), Fraction(0))
        natural = {s: left * n / sum(rest.values()) for s, n in rest.items()}
        over = {s: largest for s, w in natural.items() if w > largest}
        if not over:
            shares |= natural
            break
        shares |= over
        if len(shares) == len(counts):
            break
    total = sum(shares.values())
    shares = {s: w / total for s, w in shares.items()}
    had = dict.fromkeys(shares, 0)
    for slot in range(min(floor(counts[s] / w) for s, w in shares.items())):
        ready = [(ceil((had[s] + 1) / w), repr(s), s) for s, w in shares.items() if floor(had[s] / w) <= slot]
        if ready:
            had[min(ready)[2]] += 1
    return had


def test_each_stage_and_the_whole_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    key = lambda rows: sorted(r[0] for r in rows)
    content = langid.dictionaries(docs)

    def step(name, given):
        found = stages[name](spark, given, folder)
        assert found.columns == columns
        return spark.createDataFrame(found.collect(), docs.schema)

    expected = made()
    docs, expected = step("language_id", docs), clear(expected, content)
    assert key(docs.collect()) == key(expected) and len(expected) > 60
    docs, expected = step("near_dedup", docs), one_of_each(expected)
    assert key(docs.collect()) == key(expected)
    docs, expected = step("decontamination", docs), without_item(expected)
    assert key(docs.collect()) == key(expected) and not {70, 71} & {r[0] for r in expected}
    before = {r[0] for r in expected}
    docs, per_source = step("mix", docs), in_mix(expected)
    mixed = docs.collect()
    assert Counter(r["source"] for r in mixed) == Counter(per_source) and {r[0] for r in mixed} <= before

    texts = {r["doc_id"]: r["text"] for r in mixed}
    placed = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r["doc_id"] for r in placed) == sorted(r["doc_id"] for r in mixed)
    together: dict = {}
    for r in placed:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        together.setdefault(r["text"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in together.values())
    for shard in {r["shard"] for r in placed}:
        slots = sorted(r["slot"] for r in placed if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_an_empty_table_passes_through(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
