"""Driver-bound queries of the text operators: thin bindings with production parameters, and DuckDB oracles."""

from __future__ import annotations

import os
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, licences, negatives, pieces, pii, quality, ranked, repeats, smallworld, tokens, toxicity, urls

TOKENIZERS = os.environ.get("COHORTLENS_TOKENIZERS", "/opt/tokenizers")
#: Session setting that holds the key of pseudonyms.
PSEUDONYM_KEY = "spark.cohortlens.pseudonymKey"
_OWN_KEY = secrets.token_bytes(32)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), tokens.read_ranks(f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"))


def op2_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(_table(spark, sf_dir, "documents"), pieces.read_vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"), urls.rules_table(spark, urls.RULES))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_table(spark, sf_dir, "documents"), licences.known_digests(spark))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.classes(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def pseudonym_key(spark: SparkSession) -> bytes:
    """The key in the session setting; where there is none, a random one of this driver process: values are linked within
    its runs, and nobody can undo them afterwards."""
    given = spark.conf.get(PSEUDONYM_KEY, None)
    return given.encode() if given else _OWN_KEY


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(_table(spark, sf_dir, "documents"), key=pseudonym_key(spark))


def held_out(doc_id) -> Column:
    """Rows that labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def toxicity_machine(spark: SparkSession, sf_dir: str) -> toxicity.Machine:
    """Fitted on labelled documents that aren't held out."""
    return toxicity.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(_table(spark, sf_dir, "documents"), toxicity_machine(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = quality.ledger(_table(spark, sf_dir, "documents"))
    base = F.col("failed_bits").bitwiseAND(F.lit(quality.POLICIES["base"].mask)) != 0
    return quality.apply_policy(marked, quality.POLICIES["v1"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        "kept", "failed_bits")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", noisy), F.col("id") % 100 == 0)


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smallworld.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_piece_encoding, op3_decontamination, op4_url_filter, op5_licence_scan, op6_jaccard_join,
                                     op7_repeated_bytes, op8_pseudonyms, op9_toxicity, op10_quality_rules, op11_hard_negatives,
                                     op12_nearest, op13_ranked_search)}

ORACLES = {
    "op3_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
       FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM d, (SELECT DISTINCT k FROM bw), unnest(range(1, len(w) - k + 2)) AS r(i)),
h AS (SELECT doc_id, i, k, item_id FROM dw JOIN (SELECT DISTINCT item_id, k, win FROM bw) USING (k, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM h GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op4_url_filter": r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
                       THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
r(action, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                 ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT p.page_id, r.host || r.path AS rule, r.action FROM p JOIN r
      ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path)),
b AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(action, length(rule)) AS action, count(*) AS n FROM m GROUP BY 1)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.action, 'allow') AS verdict, coalesce(n, 0) AS n_rules
FROM p LEFT JOIN b USING (page_id)""",
    "op5_licence_scan": r"""
WITH k(licence, raw) AS (VALUES """ + ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in licences.KNOWN) + r"""),
src AS (SELECT 0 AS kind, doc_id AS id, '' AS licence, coalesce(text, '') AS t FROM documents
        UNION ALL SELECT 1, row_number() OVER (), licence, raw FROM k),
c AS (SELECT kind, id, licence, regexp_replace(lower(t), '(?m)^[ \t]*(\(c\)|©)', 'copyright ', 'g') AS t FROM src),
x AS (SELECT kind, id, licence, array_to_string(flatten(list_transform(string_split(t, chr(10)),
        lambda s: CASE WHEN regexp_matches(s, '^[ \t]*copyright\b') AND NOT regexp_matches(s, '^[ \t]*copyright\W*(""" + licences.NO_CLAUSE.replace(" ", "|") + r""")\b')
                       THEN list_filter(regexp_split_to_array(s, '[.;][ \t]+'), lambda a, i: i >= coalesce(nullif(list_position(list_transform(
                         regexp_split_to_array(s, '[.;][ \t]+'), lambda b: regexp_matches(b, '\b(""" + licences.GRANTS.replace(" ", "|") + r""")')), true), 0), 1000000))
                       ELSE [s] END)), chr(10)) AS t FROM c),
m AS (SELECT kind, id, licence, ' ' || replace(regexp_replace(t, '[^\p{L}\p{N}\n]+', ' ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' ' AS t FROM x),
e AS (SELECT kind, id, licence, """
    + "replace(" * len(licences.EQUIVALENT) + "t"
    + "".join(f", ' {a} ', ' {b} ')" for a, b in licences.EQUIVALENT) + r""" AS t FROM m),
l AS MATERIALIZED (SELECT kind, id, licence, list_filter(list_transform(string_split(t, chr(10)), lambda s: trim(s)),
      lambda s: s <> '' AND NOT (regexp_matches(s, '^copyright\b') AND NOT regexp_matches(s, '^copyright\W*(""" + licences.NO_CLAUSE.replace(" ", "|") + r""")\b'))) AS lines FROM e),
t AS (SELECT licence, string_split(array_to_string(lines, ' '), ' ') AS w FROM l WHERE kind = 1),
entry AS MATERIALIZED (
  SELECT w, false AS open, min(licence) AS licence FROM t GROUP BY w
  UNION ALL SELECT w[1:""" + str(licences.OPENING) + r"""], true, array_to_string(list_sort(list(DISTINCT licence)), '|') FROM t WHERE len(w) > """ + str(licences.OPENING) + r""" GROUP BY 1),
pat AS MATERIALIZED (SELECT w[1] AS first, len(w) AS n, open, licence, array_to_string(w, ' ') AS canon,
        '^' || array_to_string(w, '[ \n]') || CASE WHEN open THEN '([ \n]|$)' ELSE '(\n|$)' END AS p FROM entry),
line AS (SELECT id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l WHERE kind = 0),
hit AS (SELECT id, i, open, licence, i = 1 AND NOT open AND array_to_string(lines, ' ') = canon AS whole
        FROM line JOIN pat ON string_split(lines[i], ' ')[1] = first WHERE regexp_matches(array_to_string(lines[i:i + n], chr(10)), p)),
h AS (SELECT id, min(licence) FILTER (WHERE whole) AS text_licence, count(DISTINCT i) AS n,
             array_to_string(list_sort(list(DISTINCT licence) FILTER (WHERE NOT open OR NOT EXISTS (
               SELECT 1 FROM hit o WHERE o.id = hit.id AND o.i = hit.i AND NOT o.open))), ',') AS line_licences FROM hit GROUP BY 1)
SELECT doc_id, text_licence, coalesce(line_licences, '') AS line_licences, coalesce(n, 0) AS n_licence_lines
FROM documents LEFT JOIN h ON doc_id = id""",
    "op6_jaccard_join": r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, l.b FROM reach JOIN l ON l.a = reach.other)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op10_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM w, unnest(range(1, len(ws) - 1)) AS r(i)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n >= 2),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY 1),
q AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
      FROM w LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, (n_words < 50)::INT AS r0, (100 * n_repeat_words > 50 * n_words)::INT AS r1, (n_words > 100000)::INT AS r2,
             (word_chars < 3 * n_words)::INT AS r3, (word_chars > 12 * n_words)::INT AS r4, (10 * n_symbols > n_words)::INT AS r5,
             (10 * n_dup_lines > 3 * n_lines)::INT AS r6 FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r0 + r1 > 0 AS base_failed,
       r0 + r1 + r2 + r3 + r4 + r5 + r6 = 0 AS kept, (r0 + 2*r1 + 4*r2 + 8*r3 + 16*r4 + 32*r5 + 64*r6)::INT AS failed_bits FROM f""",
    "op11_hard_negatives": r"""
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id,
       positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 5""",
    "op13_ranked_search": r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
g AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
f AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
t AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM f, g GROUP BY term, n_docs),
m AS (SELECT doc_id, 100 - 90 + ((90 * len(w)::BIGINT * n_docs) // n_terms) AS m FROM d, g WHERE len(w) > 0),
r AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN t USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""",
}
