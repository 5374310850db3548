"""The queries that apply each corpus operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import divergence, html_extract, huffman, jaccard, mixing, neighbours, periods, pii, quality, sentencepieces, sharding, topk, warc
from tempora.llm.common import table, written


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = written(quality.ledger(table(spark, sf_dir, "documents"), ["doc_id"]), "quality-ledger")
    return quality.apply_policy(book).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda k: F.filter("spans", lambda s: s["base"] & (s["kind"] == k))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES = {f.__name__: f for f in (op2_quality_rules, op3_sharding, op6_pii, op8_mixing)}


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES |= {f.__name__: f for f in (op4_token_ids,)}


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.round_trip(table(spark, sf_dir, "pages")))


QUERIES |= {f.__name__: f for f in (op7_warc,)}


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES |= {f.__name__: f for f in (op5_sentencepiece,)}


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


QUERIES |= {f.__name__: f for f in (op9_html_extraction,)}


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).drop("mark", "component")


QUERIES |= {f.__name__: f for f in (op10_jaccard_join,)}


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


QUERIES |= {f.__name__: f for f in (op1_topk_search,)}


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.detect(table(spark, sf_dir, "documents"))


QUERIES |= {f.__name__: f for f in (op11_quality_classifier, op12_source_divergence, op13_periodic_runs)}
#: In the order of their numbers.
QUERIES = dict(sorted(QUERIES.items(), key=lambda x: int(x[0][2:].split("_")[0])))

ORACLES = {
    "op2_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
              list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
        n AS (SELECT *, list_transform(generate_series(1, greatest(len(w) - 7, 0)), lambda i: array_to_string(w[i:i + 7], ' ')) AS g FROM w),
        r AS (SELECT doc_id, unnest(g) AS g, generate_subscripts(g, 1) AS i FROM n),
        p AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM r),
        q AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM p, generate_series(0, 7) AS s(j) WHERE c > 1 GROUP BY doc_id),
        m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
              CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
              CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
              CAST(len(list_filter(generate_series(2, len(w)), lambda i: w[i] = w[i - 1])) AS BIGINT) AS n_stutter,
              CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper, CAST(length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS BIGINT) AS n_letters,
              CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_exclaim FROM n LEFT JOIN q USING (doc_id)),
        b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
              CAST(CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
              + CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_stutter > 25 * n_words THEN 8 ELSE 0 END
              + CASE WHEN 100 * n_upper > 60 * n_letters THEN 16 ELSE 0 END + CASE WHEN 100 * n_exclaim > 60 * n_words THEN 32 ELSE 0 END
              + CASE WHEN word_chars > 40 * n_words THEN 64 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 128 ELSE 0 END AS BIGINT) AS fail_bits FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, fail_bits & 127 = 0 AS kept, fail_bits FROM b""",
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
        e AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS b, d, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY d) ELSE page_id END AS m FROM p)
        SELECT page_id, b AS payload_bytes, d AS payload_digest, CASE WHEN m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN m <> page_id THEN m END AS refers_to FROM e""",
    "op1_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        e AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM v),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM e q JOIN e c ON q.d = c.d AND q.vec_id <> c.vec_id
              WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_source_divergence": r"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
              regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        e AS (SELECT row_number() OVER () AS r, * FROM d), t AS (SELECT r, lang, source, unnest(w) AS term FROM e),
        k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
        v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
        s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
              1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // CAST(s.n + 2 * v.v AS HUGEINT) AS p,
              1 + CAST(1000000000 AS HUGEINT) * (k.n + 2) // CAST(v.n + 2 * v.v AS HUGEINT) AS q
              FROM g JOIN s USING (lang, source) JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
        x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
              UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
        z AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM y)
        SELECT lang, source, part, item, value, rank FROM z WHERE part = 'pair' OR rank <= 10""",
}
