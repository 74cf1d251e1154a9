"""The llm queries and their oracle SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, fingerprints, language_id, lm_scoring, near_dedup, quality, sharding, token_counts, toxicity
from .shared import crc_remainder, documents, labels, ship, written


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited form, and their likeness."""
    docs = documents(spark, sf_dir)
    pairs = written(fingerprints.edits(docs), "op1-edits")
    clashing = fingerprints.clashes(pairs, docs)
    own = fingerprints.labelled(pairs, clashing, "fp", "sha", "fingerprint")
    both = fingerprints.labelled(own, clashing, "edited_fp", "edited_sha", "edited_fingerprint")
    return fingerprints.grouped(both).select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_id"
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text; a third of the ids is held out."""
    docs = documents(spark, sf_dir)
    known = labels(spark, sf_dir).where(crc_remainder("doc_id", 3) != 1)
    model = toxicity.learn(docs, known)
    return toxicity.classify(docs, model).select(
        "doc_id", (crc_remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted"
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of every whole text; a seventh of the ids is held out."""
    docs = documents(spark, sf_dir)
    held_out = crc_remainder("doc_id", 7) == 2
    return lm_scoring.score(docs, docs.where(~held_out)).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39, near equal in bytes (law ``bytes``)."""
    return sharding.shard(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_words"
    )


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates on three-word shingles at a similarity of 85 per cent."""
    return near_dedup.near_duplicates(documents(spark, sf_dir), words=3, percent=85)


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole text and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text, learned without labels."""
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.learn(docs))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it contains."""
    return decontamination.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text; a fifth of the ids is held out."""
    docs = documents(spark, sf_dir)
    held_out = crc_remainder("doc_id", 5) == 0
    model = language_id.learn(docs.where(~held_out).select("doc_id", "text", "lang"))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text."""
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def _shipped(query: Callable) -> Callable:
    """The query, run with this package on the executors' path."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: _shipped(f) for f in (op1_fingerprints, op2_toxicity, op3_lm_scoring, op4_sharding, op5_near_dedup, op6_bpe_codec, op7_quality, op8_decontamination, op9_language_id, op10_token_counts)}


def _words_sql(text: str) -> str:
    """DuckDB's form of ``decontamination.words``."""
    d = decontamination
    numbers, units = (", ".join(f"'{w}'" for w in some) for some in (d.NUMBER_WORDS, d.UNIT_WORDS))
    tokens = f"regexp_extract_all(coalesce({text}, ''), '{d.TOKEN}')"
    cores = f"list_transform({tokens}, lambda t: {{'t': t, 'core': CASE WHEN t < 'A' AND NOT (t >= '0' AND t < ':') THEN regexp_replace(t, '{d.BEFORE_WORD}', '') ELSE t END}})"
    w = "lower(x.core)"
    capital = f"substr(x.core, 1, 1) <> substr({w}, 1, 1) AND substr(x.core, 2, 1) = substr({w}, 2, 1) AND length(x.core) > 1"
    counted = f"i > 1 AND (({tokens}[i - 1] >= '0' AND {tokens}[i - 1] < ':') OR lower({tokens}[i - 1]) IN ({numbers}))"
    return f"""list_transform({cores}, lambda x, i: CASE
    WHEN {w} IN ({numbers}) OR (x.t >= '0' AND x.t < ':') THEN '{d.NUMBER}'
    WHEN {capital} THEN CASE WHEN i = 1 OR x.t < 'A' THEN '{d.FIRST}' ELSE '{d.NAME}' END
    WHEN {w} IN ({units}) AND {counted} THEN '{d.UNIT}' ELSE '' END || {w})"""


def _decontamination_sql() -> str:
    """Every window of every document against every window of every item, without an index."""
    d = decontamination

    def bare(x: str) -> str:
        return f"CASE WHEN {x} >= ' ' THEN {x} ELSE substr({x}, 2) END"

    def run(some: str, template: bool) -> str:
        marked = f"CASE WHEN x >= ' ' THEN x WHEN x < '{d.NUMBER}' THEN '{d.NAME}' WHEN x < '{d.UNIT}' THEN '{d.NUMBER}' ELSE '{d.UNIT}' END"
        return f"array_to_string(list_transform({some}, lambda x: {marked if template else bare('x')}), ' ')"

    slots, firsts = "len(list_filter(vs, lambda x: x < ' '))", f"len(list_filter(vs, lambda x: x < '{d.NAME}'))"
    loose = f"(x[1] < '{d.NAME}' OR x[2] < '{d.NAME}') AND ({bare('x[1]')}) <> ({bare('x[2]')})"
    return f"""
WITH iw AS MATERIALIZED (SELECT DISTINCT item_id AS item, {_words_sql("text")} AS ws FROM benchmark),
dw AS MATERIALIZED (SELECT DISTINCT doc_id AS id, {_words_sql("text")} AS ws FROM documents),
iq AS (SELECT item, ipos, list_slice(ws, ipos + 1, ipos + n) AS vs
  FROM (SELECT item, ws, least(len(ws), {d.WINDOW}) AS n, unnest(range(0, len(ws) - least(len(ws), {d.WINDOW}) + 1)) AS ipos FROM iw WHERE len(ws) > 0)),
totals AS (SELECT item, count(DISTINCT ipos) AS windows FROM iq GROUP BY item),
index AS (SELECT item, ipos, vs, {run("vs", False)} AS plain, {run("vs", True)} AS template, {slots} > {firsts} AND len(vs) - {slots} + {firsts} >= {d.LITERALS} AS narrow, {slots} > 0 AND len(vs) - {slots} >= {d.LITERALS} AS wide FROM iq),
sizes AS (SELECT DISTINCT len(vs) AS n FROM iq),
dq AS (SELECT id, pos, list_slice(ws, pos + 1, pos + n) AS got, n = {d.WINDOW} OR n = len(ws) AS templates
  FROM (SELECT id, ws, n, unnest(range(0, len(ws) - n + 1)) AS pos FROM dw, sizes WHERE n >= {d.LITERALS} OR n = len(ws))),
every AS (SELECT *, {run("got", False)} AS plain, CASE WHEN templates THEN {run("got", True)} END AS template FROM dq),
templates AS (SELECT *, count(*) OVER (PARTITION BY item, template) AS times FROM index WHERE narrow OR wide),
stand AS (SELECT id, item, ipos, pos - ipos AS shift, times, narrow, wide, list_zip(got, vs) AS z FROM every JOIN templates USING (template)),
by_templates AS (SELECT * FROM stand s WHERE times = 1 OR EXISTS (SELECT 1 FROM stand o WHERE o.times = 1 AND o.id = s.id AND o.item = s.item AND o.shift = s.shift)),
kinds AS (
  SELECT id, item, ipos, shift, {d.NARROW} AS kind, z FROM by_templates WHERE narrow AND len(list_filter(z, lambda x: {loose})) = 0
  UNION ALL SELECT id, item, ipos, shift, {d.WIDE}, z FROM by_templates WHERE wide),
slots AS (SELECT id, item, kind, shift, unnest(z) AS z FROM kinds),
bad AS (SELECT DISTINCT id, item, kind, shift FROM (
  SELECT id, item, kind, shift, ({bare("z[2]")}) AS own FROM slots WHERE z[2] < ' ' AND (kind = {d.WIDE} OR z[2] >= '{d.NAME}')
  GROUP BY ALL HAVING count(DISTINCT {bare("z[1]")}) > 1)),
judged AS (
  SELECT id, item, ipos, pos - ipos AS shift, false AS bad FROM every JOIN index USING (plain)
  UNION ALL SELECT k.id, k.item, k.ipos, k.shift, b.id IS NOT NULL FROM kinds k LEFT JOIN bad b USING (id, item, kind, shift))
SELECT id AS doc_id, j.item AS item_id, count(DISTINCT CASE WHEN NOT bad THEN ipos END) AS matched, any_value(t.windows) AS windows,
       count(DISTINCT CASE WHEN bad THEN shift END) AS conflicts,
       count(DISTINCT CASE WHEN NOT bad THEN ipos END)::double / any_value(t.windows) AS coverage
FROM judged j JOIN totals t ON t.item = j.item
GROUP BY id, j.item
HAVING count(DISTINCT CASE WHEN NOT bad THEN ipos END)::double / any_value(t.windows) >= {d.COVERAGE}
"""


ORACLE_SQL: dict[str, str] = {
    "op8_decontamination": _decontamination_sql(),
    "op5_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id,
         unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                     ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 85 * ((SELECT n FROM n WHERE n.doc_id = a.doc_id) + (SELECT n FROM n WHERE n.doc_id = b.doc_id) - count(*))),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN comp c USING (doc_id) LEFT JOIN n USING (doc_id)
""",
}
