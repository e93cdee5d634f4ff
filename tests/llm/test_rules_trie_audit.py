"""Quality rules, the prefix trie and the filter audit against plain-Python versions, and their defined edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapops.llm import filter_audit, prefix_trie, quality_rules

SPACE = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, n_words string, failed string, words string, part string, kept string"
LONG = " ".join(f"w{i % 20_011}" for i in range(60_000))


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def sample():
    draw = random.Random(11)
    vocabulary = ["the", "of", "und", "la", "Cat", "dog#", "x|y", "run", "été", "SHOUT", "¿que", "日本"]
    made = ["\n".join(" ".join(draw.choices(vocabulary[: draw.randint(2, 12)], k=draw.randint(0, 40))) for _ in range(draw.randint(1, 9))) for _ in range(60)]
    made += [made[0], made[0], made[5], None, None, "", " \t\n", "a b", "a b c", "a b c a b c", "x " * 49, "the of " * 25, "one\n\none\n \none", "A\x0bB\x0cC\rD", LONG, LONG, "ABC " * 300]
    return made


@pytest.fixture(scope="module")
def rows():
    found = list(enumerate(sample()))
    return [(i, t, ("en", "de", None)[i % 3]) for i, t in found] + [(3, found[3][1], "en"), (None, found[0][1], "en"), (None, "", None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_measures(text):
    w, text = words(text), text or ""
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(windows)
    repeated = {p for i, g in enumerate(windows) if times[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_measures_equal_brute_force(docs, rows):
    found = quality_rules.judged(docs).collect()
    expected = Counter((i, *plain_measures(t)) for i, t, _ in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == expected
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.failed)


def test_rules_name_what_fails(spark, none):
    clean = " ".join(f"{w} word{i}" for i, w in enumerate(["the", "of", "and"] * 20))
    cases = {"clean": clean, "symbols": clean + " ##########" * 3, "bullets": "\n".join(f"- {w} the of" for w in clean.split()), "cut_lines": "\n".join(f"{a} {b} the of..." for a, b in zip(clean.split()[::2], clean.split()[1::2], strict=True))}
    found = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(list(cases.items()), "doc_id string, text string")).collect()}
    assert found["clean"].kept and not found["clean"].failed
    assert all(name in found[name].failed for name in ("symbols", "bullets", "cut_lines"))
    assert quality_rules.judged(none).count() == 0
    own = (quality_rules.Rule("many", "n_words", at_most=5),)
    assert [r.failed for r in quality_rules.judged(spark.createDataFrame([(1, clean)], "doc_id long, text string"), own, ()).collect()] == [["many"]]


def test_rules_stay_in_one_projection(docs):
    plan = quality_rules.judged(docs).where("kept")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and plan.count("array_remove") == 1


def plain_trie(convs):
    members, children, below = defaultdict(list), Counter(), defaultdict(lambda: [0, 0])
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, found in members.items():
        for d in range(len(k) + 1):
            below[k[:d]][0] += children[k] == 0
            below[k[:d]][1] += (len(found) - 1) * len(k[-1][1].encode()) if k else 0
    result = []
    for k, found in members.items():
        ended = ",".join(str(c) for c in sorted(found) if len(convs[c]) == len(k))
        result.append((min(found), len(k), min(members[k[:-1]]) if k else None, len(found), children[k], *below[k], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(result, key=repr)


TURNS = "conv_id long, turn long, role string, text string, path string, sizes string, depth string"


@pytest.mark.parametrize(("task_turns", "fan_in"), [(10**6, 64), (15, 2), (6, 3)])
def test_trie_equals_brute_force(spark, monkeypatch, task_turns, fan_in):
    monkeypatch.setattr(prefix_trie, "TASK_TURNS", task_turns)
    monkeypatch.setattr(prefix_trie, "FAN_IN", fan_in)
    draw = random.Random(task_turns)
    convs = {c * 3 - 40: [(draw.choice("ua"), "é" * draw.choice([0, 1, 1, 2])) for _ in range(draw.choice([1, 2, 3, 4, 40]))] for c in range(50)}
    convs |= {c: [("u", "same"), ("a", "same")] for c in range(1000, 1040)}
    turns = [(c, i, r, t, *["clash"] * 3) for c, all_ in convs.items() for i, (r, t) in enumerate(all_)]
    draw.shuffle(turns)
    found = prefix_trie.prefix_trie(prefix_trie.conversations(spark.createDataFrame(turns, TURNS)))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_trie(convs)


def test_trie_defined_cases(spark):
    def trie(turns):
        return prefix_trie.prefix_trie(prefix_trie.conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))

    assert trie([]).count() == 0
    # Null turns first, null role and text empty, repeated rows are turns, rows without an id stay out.
    found = sorted(tuple(r)[:5] for r in trie([(1, 5, "a", "x"), (1, None, None, None), (1, 5, "a", "x"), (2, 0, "", ""), (None, 0, "u", "z")]).fillna(-1).collect())
    assert found == [(1, 0, -1, 2, 1), (1, 1, 1, 2, 1), (1, 2, 1, 1, 1), (1, 3, 1, 1, 0)]
    # Ties give one order whatever the order of the rows.
    tied = [(1, 0, "u", "x"), (1, 0, "u", "y"), (2, 0, "u", "y"), (2, 0, "u", "x")]
    assert trie(tied).where("depth = 2").collect() == trie(tied[::-1]).where("depth = 2").collect()
    assert trie(tied).count() == 3
    empty = spark.createDataFrame([(4, [], []), (3, [], [])], "conv_id long, path array<binary>, sizes array<long>")
    assert [tuple(r)[:7] for r in prefix_trie.prefix_trie(empty).collect()] == [(3, 0, None, 2, 0, 1, 0)]


def test_borrowed_heads(spark):
    turns = [(c, t, "u", f"{c}-{t}") for c in (0, 1, 2, 3, 4, 11, 12) for t in range(c % 3 + 4)]
    convs = prefix_trie.conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    own = {r.conv_id: list(zip(r.path, r.sizes, strict=True)) for r in convs.collect()}
    import zlib

    for r in prefix_trie.with_borrowed_heads(convs).collect():
        h = zlib.crc32(str(r.conv_id).encode()) % 9
        assert list(zip(r.path, r.sizes, strict=True)) == own.get(r.conv_id - r.conv_id % 5, [])[:h] + own[r.conv_id][h:]


def plain_audit(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    parts = defaultdict(list)
    for i, t, lang in rows:
        w, text = words(t), t or ""
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), i is not None and least[text] < i]
        parts[lang or ""].append(({"ABCDE"[k] for k in range(5) if fails[k]}, *labels.get(i, (False, False))))
    result = []
    for part, found in parts.items():
        shapley = Counter()
        own = []
        for order in permutations("ABCDE"):
            left = list(found)
            for step, f in enumerate(order, 1):
                removed, redundant = [r for r in left if f in r[0]], sum(f in r[0] for r in found)
                left = [r for r in left if f not in r[0]]
                shapley[f] += len(removed)
                own.append((part, "".join(order), step, len(left), len(removed), redundant - len(removed), sum(r[0] == {f} for r in found), sum(r[1] for r in removed), sum(r[2] for r in removed)))
        result += [(*r, shapley[r[1][r[2] - 1]]) for r in own]
    return sorted(result)


def test_audit_equals_brute_force(spark, docs, rows, none, monkeypatch):
    labels = [(0, 1, 0), (1, 0, 1), (1, 1, None), (3, 1, 1), (7, 1, 0), (64, 1, 1), (None, 1, 1), (9, None, None)]
    marks = defaultdict(lambda: (False, False))
    for i, quality, toxic in labels:
        if i is not None:
            marks[i] = (marks[i][0] or quality == 1, marks[i][1] or toxic == 1)
    table = spark.createDataFrame([(*r, "clash") for r in labels], "doc_id long, quality int, toxic int, text string")
    expected = plain_audit(rows, marks)
    for task_rows in (10**6, 9):
        monkeypatch.setattr(filter_audit, "TASK_ROWS", task_rows)
        assert sorted(tuple(r) for r in filter_audit.audit(filter_audit.failures(docs, table)).collect()) == expected
    assert filter_audit.audit(filter_audit.failures(none, table)).count() == 0


def test_posting_lists_merge_like_sets():
    draw = np.random.default_rng(5)
    for _ in range(200):
        lists = [np.unique(draw.integers(0, 60, draw.integers(0, 50))) for _ in range(4)]
        a, b = (set(x.tolist()) for x in lists[:2])
        assert filter_audit.union(lists).tolist() == sorted(set().union(*(x.tolist() for x in lists)))
        assert filter_audit.difference(lists[0], lists[1]).tolist() == sorted(a - b)
        assert filter_audit.shared(lists[0], lists[1]) == len(a & b)


def test_other_filters_and_a_hot_part(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("hot").alias("part"), F.col("id").alias("doc_id"), (F.col("id") % 4).cast("int").alias("failed"), (F.col("id") % 2 == 0).alias("good"), F.lit(False).alias("toxic"))
    found = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(rows, "XY").collect()}
    assert len(found) == 2 * 2 * 2
    hot = found["hot", "XY", 2]
    assert (hot.kept, hot.removed, hot.redundant, hot.unique_fails, hot.good_lost, hot.shapley) == (5000, 5000, 5000, 5000, 5000, 15000)
