"""One registered query for each operator, over its whole table, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapops.llm import chat, decontamination, exact_dedup, filter_audit, langid, mixing, near_dedup, prefix_trie, quality_rules, shards, substrings, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(doc_id, of: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % of


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    content = langid.dictionaries(docs.where(~held_out))
    found = langid.identified(docs, content)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query()
def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.sharded(table(spark, sf_dir, "documents").select("doc_id", "text"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query(
    r"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
    e AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 85 * (nx.n + ny.n - shared)),
    r AS (WITH RECURSIVE reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y) SELECT x, min(y) AS low FROM reach GROUP BY x)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.low AS component_id, d.doc_id = r.low AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.x = d.doc_id
    """
)
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    r"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
    s AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w),
    h AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM s),
    r AS (SELECT doc_id, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
    c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM r) GROUP BY doc_id)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
    sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_transform(list_filter(range(1, len(words) + 1), lambda j: NOT list_contains(gone, j)), lambda j: words[j]) END, ' ')) AS kept_sha256 FROM w LEFT JOIN c USING (doc_id)
    """
)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query()
def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.learned(toxicity.drawn_sample(docs, labels.where(~held_out)))
    return toxicity.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "hits")


@query()
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    r"""
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256 FROM t WINDOW same AS (PARTITION BY t)
    """
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(spark, f"{sf_dir}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query()
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


@query(
    r"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
    f AS (SELECT *, length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_start|>') + length('<|im_end|>') + 2 AS formatted FROM c)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(formatted)::BIGINT AS formatted_chars FROM f GROUP BY conv_id
    """
)
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    said_by = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    records = rows.unionByName(own).select("conv_id", "turn", F.to_json(F.struct(*said_by)).alias("record"))
    return chat.conversation_digests(chat.chat_formatted(records))


@query(
    rf"""
    WITH t AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS bare FROM t),
    g AS (SELECT row_id, unnest(range(1, len(words) - 1)) AS i, words FROM w),
    g3 AS MATERIALIZED (SELECT row_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM g),
    r AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, g) AS n FROM g3) WHERE n > 1),
    c AS (SELECT row_id, count(DISTINCT p) AS n FROM (SELECT row_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY row_id),
    m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(bare)::BIGINT AS word_chars, len(regexp_extract_all(bare, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(list_intersect(words, [{", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)}]))::BIGINT AS n_stop_words, length(regexp_replace(bare, '[^\p{{L}}]+', '', 'g'))::BIGINT AS n_letters, len(lines)::BIGINT AS n_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^ *[•‣*·–-]')))::BIGINT AS n_bullet_lines, len(list_filter(lines, lambda x: regexp_matches(x, '(?:\.\.\.|…) *$')))::BIGINT AS n_cut_lines FROM w LEFT JOIN c USING (row_id)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT *, NOT (base_failed OR 100 * word_chars < 250 * n_words OR 100 * word_chars > 1200 * n_words OR 100 * n_symbols > 10 * n_words OR n_stop_words < 2 OR 100 * n_letters < 70 * word_chars
    OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_bullet_lines > 90 * n_lines OR 100 * n_cut_lines > 30 * n_lines) AS kept FROM b
    """
)
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents")).drop("failed")


@query(
    r"""
    WITH t AS (SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_key, turn, strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
    o AS (SELECT conv_id, list(left(turn_key, 32) ORDER BY turn NULLS FIRST, turn_key) AS path, list(size ORDER BY turn NULLS FIRST, turn_key) AS sizes FROM t GROUP BY conv_id),
    h AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda y, i: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)), 4294967295) % 9 AS h FROM o),
    c AS (SELECT h.conv_id, list_concat(coalesce(b.path[:h.h], []), h.path[h.h + 1:]) AS path, list_concat(coalesce(b.sizes[:h.h], []), h.sizes[h.h + 1:]) AS sizes FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 5),
    m AS (SELECT conv_id, len(path) AS n, d, array_to_string(path[:d], '') AS k, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM c)),
    n AS MATERIALIZED (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256 FROM m GROUP BY k, d),
    p AS (SELECT left(k, 32 * (d - 1)) AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
    j AS (SELECT n.*, parent.conv_id AS parent_conv_id, coalesce(p.n_children, 0) AS n_children FROM n LEFT JOIN p USING (k) LEFT JOIN n parent ON n.d > 0 AND parent.d = n.d - 1 AND parent.k = left(n.k, 32 * (n.d - 1))),
    s AS (SELECT left(k, 32 * e) AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM j) GROUP BY 1)
    SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n_convs, n_children::BIGINT AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256 FROM j JOIN s USING (k)
    """
)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.with_borrowed_heads(prefix_trie.conversations(table(spark, sf_dir, "conversations"))))


@query(
    r"""
    WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM t),
    l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l USING (doc_id)),
    m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, fails),
    i AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
    o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
    s AS (SELECT o, step, o[step] AS own, o[:step - 1] AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
    x AS (SELECT m.*, s.*, fails[own] AS now, len(list_filter(before, lambda b: fails[b])) > 0 AS gone FROM m, s),
    c AS (SELECT part, o, step, own, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT now), 0) AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND now), 0) AS removed, coalesce(sum(n) FILTER (WHERE gone AND now), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE now AND len(list_filter(fails, lambda y: y)) = 1), 0) AS unique_fails, coalesce(sum(good) FILTER (WHERE NOT gone AND now), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT gone AND now), 0) AS toxic_lost FROM x GROUP BY part, o, step, own)
    SELECT part, array_to_string(list_transform(o, lambda y: 'ABCDE'[y]), '') AS filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM c
    """
)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
