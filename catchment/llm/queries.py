"""The corpus operators on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from . import (exact_dedup, hard_negatives, jaccard_join, language_id, line_chunks, mixing, near_dedup, neighbours,
               piece_codec, pii, token_counts, toxicity, whitening)
from .common import id_crc, table

QUERIES, ORACLES = {}, {}

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op2_token_counts")
def op2(spark, sf_dir):
    """A cache of its own for each call, so that every distinct text is encoded."""
    import public_tokenizers
    counts = token_counts.count_tokens(
        table(spark, sf_dir, "documents"), scratch_path(spark, "token-cache"),
        public_tokenizers.path(TOKENIZER))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@query("op4_personal_data")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.find_personal_data(docs, pii.fit_field(docs))


@query("op6_exact_duplicates", r"""
    WITH texts AS (
      SELECT doc_id, length(coalesce(text, '')) AS points,
             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
      FROM documents),
    ranked AS (
      SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
             first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id
      FROM texts)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
    FROM ranked""")
def op6(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op9_language_id")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_crc("doc_id") % 3 == 1
    model = language_id.fit_languages(docs.filter(~held_out))
    out = language_id.identify(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "spans")


MIX_SQL = r"""
    WITH sized AS (
      SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
             md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS key
      FROM documents),
    sources AS (
      SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
      FROM sized GROUP BY source),
    levels AS (
      SELECT *, 2.0::DOUBLE * source_size AS most,
             coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
             sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
             1.5::DOUBLE * sum(source_size) OVER () AS everything
      FROM sources),
    level AS (
      SELECT arg_min((everything - below) / rest, most / weight) AS l FROM levels
      WHERE weight * ((everything - below) / rest) <= most),
    targets AS (
      SELECT source, source_size,
             CASE WHEN l IS NULL OR weight * l > most THEN most ELSE weight * l END AS target
      FROM levels LEFT JOIN level ON TRUE),
    placed AS (
      SELECT s.doc_id, s.size, t.source_size, t.target, t.source,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             row_number() OVER (PARTITION BY s.source
               ORDER BY CAST(floor(log2(s.size + 1) * 8) AS INTEGER), s.key) AS rank,
             CAST('0x' || substr(md5('mix|offset|' || coalesce(s.source, 'null|')), 1, 8) AS BIGINT)
               / 4294967296.0::DOUBLE AS start
      FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target, source,
           CAST(CASE WHEN size > 0 THEN least(CAST(floor(rank * rate + start) - floor((rank - 1) * rate + start) AS BIGINT), 2)
                ELSE 0 END * size AS BIGINT) AS taken
    FROM placed"""


@query("op10_mix_sources", MIX_SQL)
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.with_copies(docs).select(
        "doc_id", "__mix.size", "__mix.source_size", "__mix.target", "source",
        (F.col("__mix.copies") * F.col("__mix.size")).alias("taken"))


@query("op7_near_duplicates")
def op7(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


@query("op8_nearest_vectors")
def op8(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@query("op5_line_chunks")
def op5(spark, sf_dir):
    rows = line_chunks.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "__lines.n_lines", "__lines.n_removed", "__lines.removed",
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("op3_sentence_pieces")
def op3(spark, sf_dir):
    import public_tokenizers
    return piece_codec.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


@query("op1_toxicity")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_crc("doc_id") % 5 == 0
    labels = table(spark, sf_dir, "labels").filter(~held_out)
    machine = toxicity.fit_machine(docs, labels)
    out = toxicity.score_toxicity(docs, machine)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op13_hard_negatives", """
    WITH plain AS (
      SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    scored AS (
      SELECT a.id AS anchor, r.id AS id, a.label = r.label AS same,
             CAST(list_inner_product(a.x, r.x) AS BIGINT) AS score
      FROM plain a JOIN plain r ON a.id <> r.id WHERE a.id % 100 = 0),
    positive AS (
      SELECT anchor, id, score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
    SELECT p.anchor AS anchor_id, p.id AS positive_id,
           CAST(row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
           s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM positive p JOIN scored s ON s.anchor = p.anchor AND NOT s.same
      AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
    QUALIFY rank <= 5""")
def op13(spark, sf_dir):
    """Every seventh label is made wrong first, as the contract of this query has it."""
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows)


@query("op11_whiten_embeddings")
def op11(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op12_jaccard_join", r"""
    WITH RECURSIVE worded AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
      FROM documents),
    words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS total FROM worded),
    grams AS (
      SELECT doc_id, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o,
               lead(word, 4) OVER o) AS g
      FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i) QUALIFY i <= greatest(total - 4, 1)),
    sets AS (SELECT DISTINCT doc_id, g FROM grams),
    flat AS (SELECT doc_id, g, count(*) OVER (PARTITION BY doc_id) AS n FROM sets),
    pairs AS (
      SELECT a.doc_id AS a, b.doc_id AS b
      FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n
      HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
    reach AS (
      SELECT doc_id AS a, doc_id AS b FROM documents
      UNION
      SELECT r.a, l.b FROM reach r JOIN ways l ON r.b = l.a)
    SELECT d.doc_id, coalesce(f.n, 0) AS n_shingles, r.c AS component_id
    FROM documents d JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON d.doc_id = r.a
      LEFT JOIN (SELECT DISTINCT doc_id, n FROM flat) f ON d.doc_id = f.doc_id""")
def op12(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).drop("text_key")
