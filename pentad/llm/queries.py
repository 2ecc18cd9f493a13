"""The queries of this package, by name: thin digests of what its operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pentad.llm.common import table
from pentad.llm.kneser_ney import perplexity_scores
from pentad.llm.license_scan import license_scan
from pentad.llm.line_dedup import loss
from pentad.llm.mixing import mix
from pentad.llm.multi_index import multi_index_search
from pentad.llm.packing import pack
from pentad.llm.pivot_topk import pivot_topk
from pentad.llm.quote_links import link_quotes
from pentad.llm.simhash import simhash_groups
from pentad.llm.toxicity import toxicity


def op1_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))


def op2_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op4_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op5_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loss(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity_scores(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quote_links": op1_quote_links,
    "op2_pivot_topk": op2_pivot_topk,
    "op3_license_scan": op3_license_scan,
    "op4_pivotal_mix": op4_pivotal_mix,
    "op5_lexical_packing": op5_lexical_packing,
    "op6_multi_index": op6_multi_index,
    "op7_line_dedup": op7_line_dedup,
    "op8_simhash": op8_simhash,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quote_links": r"""
        WITH RECURSIVE m AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text, coalesce(conv_id::VARCHAR, 'null') AS conv,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) - 1 AS seq
            FROM conversations
        ), s AS (
            SELECT conv, seq, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS lines FROM m
        ), l AS (
            SELECT conv, seq, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM s
        ), p AS (
            SELECT *, length(regexp_replace(regexp_extract(line, '^([ \t]*>)+'), '[^>]', '', 'g')) AS level,
                   regexp_replace(line, '^([ \t]*>)+', '') AS body FROM l
        ), d AS (
            SELECT *, regexp_matches(line, '^[ \t]*On .+ wrote:[ \t]*$')
                      AND coalesce(lead(level) OVER (PARTITION BY conv, seq ORDER BY i), 0) > 0 AS dropped FROM p
        ), own AS (
            SELECT conv, seq, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0 AND NOT dropped), ''),
                                             '^[ \t\n]+|[ \t\n]+$', '', 'g') AS body
            FROM d GROUP BY conv, seq
        ), n AS (
            SELECT conv, seq, i, level, regexp_replace(regexp_replace(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(1) || chr(2) || chr(3),
                   'abcdefghijklmnopqrstuvwxyz'), '[ \t]+', ' ', 'g'), '^ | $', '', 'g') AS norm
            FROM d WHERE NOT dropped
        ), g AS (
            SELECT *, i - row_number() OVER (PARTITION BY conv, seq, level ORDER BY i) AS grp FROM n WHERE norm <> ''
        ), pa AS (
            SELECT conv, seq, level, grp, list(norm ORDER BY i) AS ls, string_agg(norm, ' ' ORDER BY i) AS whole FROM g GROUP BY ALL
        ), u AS (
            SELECT conv, seq, level, grp,
                   unnest(list_distinct(list_concat(ls, string_split(regexp_replace(whole, '([.!?]) ', '\1' || chr(1), 'g'), chr(1))))) AS unit
            FROM pa
        ), o AS (
            SELECT conv, unit, min(seq) AS origin FROM u WHERE level = 0 GROUP BY conv, unit
        ), f AS (
            SELECT u.conv, u.seq, u.level, u.grp, length(u.unit) AS chars, CASE WHEN o.origin < u.seq THEN o.origin END AS origin
            FROM u LEFT JOIN o ON u.conv = o.conv AND u.unit = o.unit WHERE u.level > 0
        ), e AS (
            SELECT conv, seq, level, origin, sum(chars) AS chars FROM f GROUP BY ALL
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY conv, seq ORDER BY level, chars DESC, origin DESC) AS best
            FROM e WHERE origin IS NOT NULL
        ), q AS (
            SELECT conv, seq, count(DISTINCT (level, grp))::BIGINT AS n_quoted, count(DISTINCT (level, grp)) FILTER (origin IS NOT NULL)::BIGINT AS n_linked
            FROM f GROUP BY conv, seq
        ), t AS (
            SELECT m.conv_id, m.turn, m.role, m.conv, m.seq, r.origin, coalesce(r.origin, CASE WHEN m.seq > 0 THEN m.seq - 1 END) AS reply_to,
                   coalesce(q.n_quoted, 0) AS n_quoted, coalesce(q.n_linked, 0) AS n_linked, own.body
            FROM m JOIN own USING (conv, seq) LEFT JOIN q USING (conv, seq)
            LEFT JOIN r ON r.conv = m.conv AND r.seq = m.seq AND r.best = 1
        ), x AS (
            SELECT conv, seq, 0::BIGINT AS depth FROM t WHERE reply_to IS NULL
            UNION ALL
            SELECT t.conv, t.seq, x.depth + 1 FROM t JOIN x ON t.conv = x.conv AND t.reply_to = x.seq
        )
        SELECT conv_id, turn, role, seq, reply_to,
               CASE WHEN origin IS NOT NULL THEN 'quote' WHEN seq > 0 THEN 'sequence' ELSE 'start' END AS link,
               n_quoted, n_linked, depth, row_number() OVER (PARTITION BY conv ORDER BY depth, seq) - 1 AS position, body
        FROM t JOIN x USING (conv, seq)
    """,
    "op2_pivot_topk": """
        WITH v AS (
            SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len([x for x in embedding if x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
}
