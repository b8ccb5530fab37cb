"""One query per operator, over whole tables with production parameters, and SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import (chat_format, exact_dedup, filter_audit, fingerprints, langid, line_dedup, minhash, mixing, pieces,
                         prefix_trie, repeats, secret_scan, token_files)

TOKENIZERS = "/opt/tokenizers"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(documents(spark, sf_dir)).select(
        F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


ORACLE["op1_exact_dedup"] = r"""
    SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
    FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
    WINDOW same AS (PARTITION BY norm)
"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@query
def op9_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir), labels(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken")


ORACLE["op9_mixing"] = r"""
    WITH weighted AS (
        SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END) AS weight
        FROM labels GROUP BY doc_id),
    docs AS (
        SELECT d.doc_id, source,
               coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
               -ln((('0x' || substr(md5('mix:' || d.doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
                   / coalesce(weight, 1.0) AS key
        FROM documents d LEFT JOIN weighted w ON d.doc_id = w.doc_id),
    sources AS (
        SELECT source, sum(size)::HUGEINT AS s, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
        FROM docs GROUP BY source),
    ordered AS (
        SELECT *, (SELECT sum(s) FROM sources)::HUGEINT AS total,
               coalesce(sum(3 * s) OVER (ORDER BY 3.0 * s / w, source ROWS BETWEEN UNBOUNDED PRECEDING
                                         AND 1 PRECEDING), 0)::HUGEINT AS caps,
               sum(w) OVER (ORDER BY 3.0 * s / w, source ROWS BETWEEN CURRENT ROW
                            AND UNBOUNDED FOLLOWING)::HUGEINT AS free
        FROM sources),
    marked AS (SELECT *, 3 * s * free <= w * (total - caps) AS capped FROM ordered),
    rest AS (SELECT (max(total) - coalesce(sum(3 * s) FILTER (capped), 0))::DOUBLE AS amount,
                    sum(w) FILTER (NOT capped)::DOUBLE AS free FROM marked),
    targets AS (
        SELECT source, s::BIGINT AS source_size, CASE WHEN capped THEN (3 * s)::DOUBLE ELSE amount * w / rest.free END AS target
        FROM marked, rest),
    epochs AS (
        SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS epochs
        FROM targets),
    placed AS (
        SELECT doc_id, size, source_size, target, epochs,
               coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING
                                        AND 1 PRECEDING), 0) + size / 2.0 AS middle
        FROM docs d JOIN epochs e ON d.source IS NOT DISTINCT FROM e.source)
    SELECT doc_id, size, source_size, target,
           (size * (epochs + CASE WHEN target - epochs * source_size > 0 AND middle <= target - epochs * source_size
                                  THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM placed
"""


@query
def op4_secret_scan(spark, sf_dir):
    """The table names no repositories: an owner is a source, a repository its documents of one language."""
    return secret_scan.secret_scan(documents(spark, sf_dir), F.col("source"), F.concat_ws("/", "source", "lang"))


def _secret_sql() -> str:
    """Matches by cutting each text at them; places are sums of the lengths of cuts and matches."""
    parts = []
    for no, kind in enumerate((*secret_scan.BASE, secret_scan.OPAQUE)):
        pattern = kind.pattern.replace("'", "''")
        also = "".join(f" AND regexp_matches(value, '{p}')" for p in kind.also)
        parts.append(f"""
        SELECT * FROM (
            SELECT doc_id, owner, repository, {no} AS kind_no, '{kind.name}' AS kind, value,
                   list_sum(list_transform(gaps[:i], lambda g: length(g)))
                   + list_sum(list_transform(found[:i], lambda f: length(f))) - length(found[i]) AS start,
                   length(found[i]) AS width
            FROM (SELECT doc_id, owner, repository, found, gaps, unnest(vals) AS value, generate_subscripts(vals, 1) AS i
                  FROM (SELECT *, regexp_extract_all(text, '{pattern}') AS found,
                               regexp_extract_all(text, '{pattern}', {kind.group}) AS vals,
                               string_split_regex(text, '{pattern}') AS gaps FROM docs)))
        WHERE length(value) >= {kind.least}{also}""")
    listed = ("string_agg(kind || ':' || start::BIGINT || ':' || (start + width)::BIGINT, ',' ORDER BY start, kind_no)")
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository,
                         coalesce(text, '') AS text FROM documents),
    matched AS ({" UNION ALL ".join(parts)}),
    apart AS (
        SELECT * FROM matched m WHERE kind_no < 3 OR NOT EXISTS (
            SELECT 1 FROM matched b WHERE b.doc_id = m.doc_id AND b.kind_no < 3 AND b.start < m.start + m.width
            AND m.start < b.start + b.width)),
    shared AS (SELECT value AS shared_value,
                      count(DISTINCT owner) <= 2 AND count(DISTINCT repository) <= 3 AS live FROM apart GROUP BY value),
    judged AS (SELECT * FROM apart JOIN shared ON value = shared_value),
    per_doc AS (
        SELECT doc_id, count(*) FILTER (kind_no = 0) AS a, count(*) FILTER (kind_no = 1) AS k,
               count(*) FILTER (kind_no = 2) AS h, {listed} FILTER (kind_no < 3) AS base,
               {listed} FILTER (kind_no < 3 OR live) AS spans, count(*) FILTER (live) AS n_live,
               count(*) FILTER (NOT live) AS n_example
        FROM judged GROUP BY doc_id)
    SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
           coalesce(n_example, 0) AS n_example
    FROM docs d LEFT JOIN per_doc p ON d.doc_id = p.doc_id
    """


ORACLE["op4_secret_scan"] = _secret_sql()


@query
def op3_token_files(spark, sf_dir):
    return token_files.token_files(documents(spark, sf_dir), f"{TOKENIZERS}/word_bpe_49k.json")


@query
def op7_sentencepiece(spark, sf_dir):
    return pieces.round_trip(documents(spark, sf_dir), f"{TOKENIZERS}/piece_bpe_32k.model")


#: A conversation whose texts are control strings of the format.
CONFLICT = "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]')"


@query
def op5_chat_format(spark, sf_dir):
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat_format.chat_format(conversations.union(spark.sql(CONFLICT)))


@query
def op8_minhash(spark, sf_dir):
    return minhash.near_duplicates(documents(spark, sf_dir), shingle_words=4).select(
        "doc_id", "n_shingles", "component_id", "kept")


@query
def op10_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(documents(spark, sf_dir))


@query
def op2_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = langid.fit(docs, ~langid.held_out(F.col("doc_id")))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        F.col("row.doc_id").alias("doc_id"), langid.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score",
        "ambiguous")


@query
def op6_substring_dedup(spark, sf_dir):
    return repeats.drop_repeats(documents(spark, sf_dir))


@query
def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(documents(spark, sf_dir), labels(spark, sf_dir))


ORACLE["op11_filter_audit"] = r"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    f AS (
        SELECT part, doc_id,
               (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END)
               + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
               + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END)
               + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
               + (CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY t),
                                     min(doc_id) OVER (PARTITION BY t) IS NOT NULL) THEN 16 ELSE 0 END) AS fails
        FROM d),
    lab AS (SELECT doc_id AS label_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                   max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    fl AS (SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
           FROM f LEFT JOIN lab ON f.doc_id = lab.label_id),
    letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, b)),
    orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
               FROM letters a, letters b, letters c, letters d, letters e WHERE a.b + b.b + c.b + d.b + e.b = 31),
    steps AS (SELECT filter_order, s AS step, substr(filter_order, s, 1) AS filter, bits[s] AS bit,
                     coalesce(list_sum(bits[1:s - 1]), 0) AS before FROM orders, range(1, 6) r(s))
    SELECT part, filter_order, step::INT AS step, filter,
           sum(CASE WHEN fails & (bit | before) = 0 THEN 1 ELSE 0 END)::BIGINT AS kept,
           sum(CASE WHEN fails & bit <> 0 AND fails & before = 0 THEN 1 ELSE 0 END)::BIGINT AS removed,
           sum(CASE WHEN fails & bit <> 0 AND fails & before <> 0 THEN 1 ELSE 0 END)::BIGINT AS redundant,
           sum(CASE WHEN fails = bit THEN 1 ELSE 0 END)::BIGINT AS unique_fails,
           sum(CASE WHEN fails & bit <> 0 AND fails & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
           sum(CASE WHEN fails & bit <> 0 AND fails & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
           sum(CASE WHEN fails & bit <> 0 THEN 120 // bit_count(fails) ELSE 0 END)::BIGINT AS shapley
    FROM fl, steps GROUP BY part, filter_order, step, filter
"""


@query
def op12_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(documents(spark, sf_dir)).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", "kept_sha256")


ORACLE["op12_line_dedup"] = r"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
    k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    r AS (SELECT key AS r_key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
    SELECT doc_id, count(*)::BIGINT AS n_lines, count(r_key)::BIGINT AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE r_key IS NULL), '')) AS kept_sha256
    FROM k LEFT JOIN r ON key = r_key GROUP BY doc_id
"""


@query
def op13_prefix_trie(spark, sf_dir):
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie.prefix_trie(conversations).drop("key")
