"""Small cases of each operator against plain-Python versions, and the defined edge cases."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from snapops.llm import chat, decontamination, exact_dedup, langid, mixing, near_dedup, shards, substrings, toxicity, warc
from snapops.llm.common import components, numbered

SPACE = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, size string, slot string, shard string, position string, component_id string, n_words string, score string, cluster string"
LONG = " ".join(f"w{i}" for i in range(30_000))


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def texts():
    """Random texts with near and exact copies, a shared passage, spaces, nulls and empties."""
    draw = random.Random(7)
    vocabulary = [f"v{i}" for i in range(300)]
    made = [" ".join(draw.choices(vocabulary, k=draw.randint(60, 140))) for _ in range(24)]
    made += made[:4] + [made[0]] * 3
    for i in range(6):
        w = made[i].split()
        w[draw.randrange(len(w))] = "changed"
        made.append(" ".join(w))
    passage = " ".join(f"p{i}" for i in range(50))
    made += [f"{made[8]} {passage} {made[9]}", f"{passage} x", f"{passage} y {passage}", "same " * 80]
    return made + [None, None, "", " \t\n", "a b", "A  B", "a b c d e", LONG, LONG]


@pytest.fixture(scope="module")
def rows():
    found = texts()
    return list(enumerate(found)) + [(3, found[3])]  # one row twice


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s" if i % 3 else None, *["clash"] * 8) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_equal_brute_force(docs, rows):
    sets = dict((i, shingle_set(t)) for i, t in rows)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    expected = sorted((i, len(sets[i]), find(i), find(i) == i) for i, _ in rows)
    assert sorted(tuple(r) for r in near_dedup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()) == expected


def test_substrings_equal_brute_force(docs, rows):
    starts = {}
    for k, (_, t) in enumerate(rows):
        w = words(t)
        for i in range(len(w) - 34):
            starts.setdefault(tuple(w[i : i + 35]), []).append((k, i))
    gone = [set() for _ in rows]
    for where in starts.values():
        if len(where) > 1:
            for k, i in where:
                gone[k].update(range(i, i + 35))
    expected = sorted(
        (i, len(words(t)), len(gone[k]), hashlib.sha256(" ".join(w for j, w in enumerate(words(t)) if j not in gone[k]).encode()).hexdigest()) for k, (i, t) in enumerate(rows)
    )
    unique = docs.select("doc_id", "text", "n_words", "cluster")
    found = substrings.without_repeats(unique).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    by_id = {}
    for row in expected:
        by_id.setdefault(row[0], set()).add(row)
    assert len(found) == len(rows)
    assert all(tuple(r) in by_id[r[0]] for r in found if r[0] != 3)


def test_exact_duplicates_equal_brute_force(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    same = {}
    for i, t in rows:
        same.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    expected = sorted((i, min(g), len(g), hashlib.sha256(SPACE.sub(" ", t or "").encode()).hexdigest()) for i, t in rows for g in [same[SPACE.sub(" ", t or "")]])
    found = exact_dedup.exact_duplicates(spark, str(tmp_path / "documents.parquet"))
    assert sorted(tuple(r) for r in found.select("doc_id", "keep_id", "group_size", "text_sha256").collect()) == expected
    # one row stays of each group; the row that occurs twice has one id
    assert found.where("kept").select("keep_id").distinct().count() == len(same)


def test_shards_are_whole_and_level(docs, rows):
    found = shards.sharded(docs, 4).collect()
    assert len(found) == len(rows)
    of_text = {}
    for r in found:
        assert (r["size"], r["text_crc32"]) == (len((dict(rows)[r["doc_id"]] or "").encode()) + 1, None if dict(rows)[r["doc_id"]] is None else zlib.crc32(dict(rows)[r["doc_id"]].encode()))
        of_text.setdefault(dict(rows)[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in of_text.values())
    for shard in range(4):
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_shards_are_as_level_as_longest_first_makes_them(spark):
    draw = random.Random(31)
    found = [f"t{i} " * draw.randint(1, 60) for i in range(120)]
    given = list(enumerate(found + draw.choices(found, k=150)))
    placed = shards.sharded(spark.createDataFrame(given, "doc_id long, text string"), 5).collect()
    of_text = {}
    for _, t in given:
        of_text[t] = of_text.get(t, 0) + len(t.encode()) + 1
    loads = sorted(sum(r["size"] for r in placed if r["shard"] == s) for s in range(5))
    assert sum(loads) == sum(of_text.values()) and loads[-1] - loads[0] <= max(of_text.values())
    plain = [0] * 5
    for size in sorted(of_text.values(), reverse=True):
        plain[plain.index(min(plain))] += size
    assert loads == sorted(plain), "every text is larger than a 4,096th of the whole, so each is an item of its own"


def test_longest_first_is_within_its_bound():
    draw = random.Random(1)
    items = [(i, draw.randint(1, 1000)) for i in range(500)]
    placed = shards.longest_first(items, 7)
    loads = [sum(n for i, n in items if placed[i] == s) for s in range(7)]
    assert max(loads) <= (4 / 3) * sum(loads) / 7 + 1000 / 3


def test_mix_deviates_by_less_than_one_block():
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    from fractions import Fraction

    weights = {s: Fraction(str(w)) for s, w in weights.items()}
    plan = mixing.earliest_deadline_first(weights, {"a": 50, "b": 30, "c": 20})
    assert [p[4] for p in plan] == list(range(100))
    had = dict.fromkeys(weights, 0)
    for source, block, release, deadline, slot in plan:
        assert release <= slot < deadline and block == had[source]
        had[source] += 1
        assert all(abs(had[s] - weights[s] * (slot + 1)) < 1 for s in weights)


def test_mixed_sources_keep_every_row(docs, rows):
    found = mixing.mixed_sources(docs).collect()
    assert len(found) == len(rows)
    positions = sorted(r["position"] for r in found if r["in_mix"])
    assert positions == sorted(set(positions))
    assert all((r["slot"] is None) == (not r["in_mix"]) for r in found)


def test_decontamination_finds_planted_items_only(spark):
    item = "what is the boiling point of water at sea level in degrees celsius when pressure is normal"
    draw = random.Random(3)
    filler = [" ".join(f"f{draw.randrange(500)}" for _ in range(80)) for _ in range(6)]
    made = [(0, f"{filler[0]} {item} {filler[1]}"), (1, item.upper()), (2, filler[2]), (3, None), (4, ""), (5, item), (6, "x"), (6, "x")]
    found = decontamination.contaminated(spark.createDataFrame([(i, t, "c") for i, t in made], "doc_id long, text string, similarity string"), spark.createDataFrame([(9, item), (8, None), (7, "")], spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").schema))
    got = sorted((r["doc_id"], r["contaminated"]) for r in found.collect())
    assert [(i, c) for i, c in got if i != 1] == [(0, True), (2, False), (3, False), (4, False), (5, True), (6, False), (6, False)]


def test_languages_are_told_apart(spark):
    draw = random.Random(5)
    said = {"en": "the cat sat on mat and then went home with friends because night was cold".split(), "de": "der hund lief durch den wald und dann nach hause weil nacht kalt war".split()}
    teach = [(i, " ".join(draw.choices(said[lang], k=60)), lang) for i, lang in enumerate(["en", "de"] * 20)]
    asked = [(100, " ".join(draw.choices(said["en"], k=50)), None), (101, " ".join(draw.choices(said["de"], k=50)), "en"), (102, None, "en"), (103, "123 !?", "de"), (104, "", None), (104, "", None)]
    schema = "doc_id long, text string, lang string"
    content = langid.dictionaries(spark.createDataFrame(teach + [(60, None, "en"), (61, "12", "de")], schema))
    found = langid.identified(spark.createDataFrame(asked, schema), content).collect()
    assert sorted((r["doc_id"], r["lang_pred"]) for r in found) == [(100, "en"), (101, "de"), (102, "und"), (103, "und"), (104, "und"), (104, "und")]
    assert all(0 <= r["score"] <= 1 for r in found)


def test_toxicity_folds_and_orders(spark):
    assert toxicity.folded("ІDІОT") == toxicity.folded("idiot")
    draw = random.Random(9)
    plain = "garden music river table window letter summer coffee paper bridge".split()
    made = [(" ".join(draw.choices(plain, k=20) + (["idiot", "moron"] if i % 2 else [])), i % 2) for i in range(200)]
    model = toxicity.learned(spark.createDataFrame(made, "text string, toxic int"))
    asked = spark.createDataFrame([(0, "river table idiot window"), (1, "river table music window"), (2, None), (3, ""), (3, "")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in toxicity.scored(asked, model).collect()}
    assert found[0]["predicted"] == 1 and found[1]["predicted"] == 0
    assert found[2]["score"] == found[3]["score"] <= found[0]["score"]


def test_warc_links_both_records_to_the_response(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<html><title>T</title><body><p>hi</p><script>no()</script></body></html>"), (2, None, None), (3, "http://b/", "")], "page_id long, url string, html string")
    responses = warc.responses(pages)
    ids = {r["page_id"]: dict(warc.parse(bytes(r["record"]))[0]) for r in responses.collect()}
    derived = warc.derivatives(responses)
    for r in derived.collect():
        raw = [bytes(v) for v in r if isinstance(v, (bytes, bytearray))][0]
        headers, block = warc.parse(raw)
        headers = dict(headers)
        assert headers["WARC-Refers-To"] == ids[r["page_id"]]["WARC-Record-ID"]
        assert int(headers["Content-Length"]) == len(block)
        if r["page_id"] == 1 and headers["WARC-Type"] == "conversion":
            assert b"hi" in block and b"no()" not in block
    assert derived.count() == 6


def test_warc_derivatives_equal_plain_ones(spark):
    draw = random.Random(3)
    letters = ["a", "é", "日", " ", "-"]
    made = [(i, draw.choice([None, f"http://h{i}/é"]), "".join(f"<p>{''.join(draw.choices(letters, k=9))}</p><!-- no -->" for _ in range(draw.randint(0, 5)))) for i in range(40)]
    pages = spark.createDataFrame([(*p, "clash") for p in [*made, made[0]]], "page_id long, url string, html string, record_id string")
    sources = {r["page_id"]: bytes(r["record"]) for r in warc.responses(pages).collect()}
    rows = warc.derivatives(warc.responses(pages)).collect()
    assert len(rows) == 82 and len({(r["page_id"], r["record_id"]) for r in rows}) == 80
    for r in rows:
        i, url, html = made[r["page_id"]]
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        origin = dict(line.split(": ", 1) for line in sources[i].partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
        assert rest[len(block) :] == b"\r\n\r\n" and fields["WARC-Refers-To"] == origin["WARC-Record-ID"] == r["refers_to"]
        assert r["target_uri"] == url and r["content_length"] == len(block)
        digest = "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        assert r["block_digest"] == digest
        if r["warc_type"] == "conversion":
            said = [p.removeprefix("<p>") for p in html.split("</p><!-- no -->") if p]
            assert block.decode().split() == " ".join(said).split()
            assert fields["WARC-Source-Payload-Digest"] == origin["WARC-Payload-Digest"]
        else:
            assert f"source-WARC-Record-ID: {origin['WARC-Record-ID']}".encode() in block


def test_chat_escapes_reverse():
    for text in ["", "<|im_end|>", "<*|x", "<**|", "a<|im_start|>b\n", "<|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n"]:
        assert chat.unescape(chat.escape(text)) == text
        marked, start, end = chat.formatted_turn("assistant", text)
        assert chat.parsed_turns(marked) == [("assistant", text)]
        assert chat.unescape(marked[start:end]) == text
    assert chat.field_paths({"a": [{"b": 1}], "c": None}) == chat.field_paths({"c": None, "a": [{"b": 2}, {"b": 3}]})


def test_components_and_numbers(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    assert {r["u"]: r["root"] for r in components(edges, "test").collect()} == {i: 0 for i in range(1, 41)} | {101: 100}
    df = spark.range(500).withColumn("g", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    for group in (None, 1, 2):
        got = sorted(r["n"] for r in numbered(df, "g", [F.col("id")], "n").where(F.col("g").eqNullSafe(F.lit(group))).collect())
        assert got == list(range(len(got)))


@pytest.mark.parametrize("operator", [near_dedup.near_duplicates, substrings.without_repeats, shards.sharded, mixing.mixed_sources], ids=lambda f: f.__name__)
def test_empty_tables(none, operator):
    assert operator(none).count() == 0


def test_an_id_with_several_texts_has_all_their_links(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(1, a), (1, b), (2, f"{a} z"), (3, f"{b} z"), (4, a), (4, c), (0, f"{c} z"), (9, "q r s t u v w")]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {*((i, 0) for i in range(5)), (9, 9)}


def test_records_without_a_field_are_no_turns(spark):
    raw = ["{}", '{"messages":[]}', '{"messages":[{}]}', '{"role":null,"text":null}', "[]", "x", None, '{"role":"user"}', '{"prompt":"p","response":"r"}']
    raw += ['{"system":"s","prompt":"p","response":"r"}', '{"prompt":"p","completion":"c"}', '{"instruction":"i","input":"n","output":"o"}']
    raw += ['{"messages":[{"role":"user","content":"u"},{"role":"assistant","content":"<|im_end|>"}]}', '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}']
    records = spark.createDataFrame([(i, 0, r) for i, r in enumerate(raw)], "conv_id long, turn long, record string")
    turns = {}
    for r in chat.chat_formatted(records).orderBy("conv_id", "part").collect():
        turns.setdefault(r.conv_id, []).extend(chat.parsed_turns(r.formatted) if r.layout else [])
    assert [turns[i] for i in range(7)] == [[]] * 7
    assert turns[7] == [("user", "")]
    assert turns[8] == [("user", "p"), ("assistant", "r")] and turns[9] == [("system", "s"), *turns[8]]
    assert turns[10] == [("user", "p"), ("assistant", "c")] and turns[11] == [("user", "i\n\nn"), ("assistant", "o")]
    assert turns[12] == [("user", "u"), ("assistant", "<|im_end|>")] and turns[13] == [("user", "h"), ("assistant", "g")]
