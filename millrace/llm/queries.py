"""The registered query of each operator, with production parameters over its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, collocations, decontaminate, jaccard, licenses, manifest, planes, pseudonyms, quality, repeats, secrets, toxicity, wrapper
from millrace.session import shared_dir, ship


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.host_quality(_read(spark, sf_dir, "documents"))


def op3_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract_main_text(_read(spark, sf_dir, "pages"))


def op4_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(_read(spark, sf_dir, "documents"))


def op5_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_notices(_read(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_read(spark, sf_dir, "documents"))


#: The key of the registered query; a deployment passes its own.
PSEUDONYM_KEY = b"millrace"


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymize(_read(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op9_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit_on(docs, _read(spark, sf_dir, "labels")))


def op10_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_read(spark, sf_dir, "documents"))


def op11_merkle_midstates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of documents whose id's crc32 7 divides are folded with n_chars one higher, where it is known."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return manifest.merkle_manifest(_read(spark, sf_dir, "documents"), {"n_chars": F.col("n_chars") + 1}, tampered)


#: The id that ends every document.
END_ID = 2


def op12_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files hold once they have been written and read back."""
    path = f"{shared_dir(spark)}/millrace-ids-{uuid.uuid4().hex}"
    planes.write_ids(planes.encode(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID), path)
    return planes.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_spaced_seeds,
        op2_host_quality,
        op3_wrapper_induction,
        op4_secret_automaton,
        op5_bpe_segment_tree,
        op6_license_notices,
        op7_jaccard_join,
        op8_feistel_pseudonyms,
        op9_toxic_spans,
        op10_repeated_bytes,
        op11_merkle_midstates,
        op12_id_planes,
        op13_collocations,
    )
}

ORACLES = {
    "op2_host_quality": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
word AS (
  SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i
  FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k
        FROM (SELECT doc_id, regexp_split_to_array(t, '[\x20\x09-\x0D]+') AS ws FROM d))
  WHERE w <> ''),
words AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars FROM word GROUP BY doc_id),
win AS (
  SELECT doc_id, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g
  FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
dup AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win WHERE g IS NOT NULL) WHERE c > 1),
rep AS (SELECT doc_id, sum(CASE WHEN nxt IS NULL OR nxt - i > 5 THEN 5 ELSE nxt - i END) AS n_repeat_words FROM dup GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
stat AS (
  SELECT d.doc_id, d.source, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN words USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM stat),
host AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM base WHERE source IS NOT NULL GROUP BY source),
pool AS (SELECT sum(f) / sum(n) AS m, sum(n * (f / n) * (f / n)) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n)) - (sum(f) / sum(n)) * (1 - sum(f) / sum(n)) * count(*) / sum(n) AS v FROM host),
prior AS (SELECT m, CASE WHEN v > 0 THEN least(1e6, greatest(2.0, m * (1 - m) / v - 1)) ELSE 1e6 END AS k FROM pool),
rate AS (SELECT source, (f + m * k) / (n + k) AS r FROM host CROSS JOIN prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(r > 0.5, false) AS kept, round(r, 6) AS host_rate
FROM base LEFT JOIN rate USING (source)
""",
    "op7_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
word AS (
  SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, count(*) OVER (PARTITION BY doc_id) AS n
  FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k
        FROM (SELECT doc_id, regexp_split_to_array(t, '[\x20\x09-\x0D]+') AS ws FROM d))
  WHERE w <> ''),
gram AS (
  SELECT doc_id, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS g FROM word WHERE n >= 4 WINDOW o AS (PARTITION BY doc_id ORDER BY i)
  UNION ALL SELECT doc_id, string_agg(w, ' ' ORDER BY i) FROM word WHERE n < 4 GROUP BY doc_id),
member AS (SELECT DISTINCT doc_id, g FROM gram WHERE g IS NOT NULL),
size AS (SELECT doc_id, count(*) AS n FROM member GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM member a JOIN member b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN size x ON x.doc_id = a.doc_id JOIN size y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN size USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
""",
    "op11_merkle_midstates": r"""
WITH RECURSIVE crc AS (
  SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS c
  FROM (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s FROM documents WHERE doc_id IS NOT NULL)),
d AS (SELECT documents.*, coalesce(xor(c, 4294967295) % 7 = 0, false) AS hit FROM documents LEFT JOIN crc USING (doc_id)),
leaf AS (
  SELECT doc_id, lang, hit, sha256(CASE WHEN doc_id::VARCHAR IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars::VARCHAR IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR END || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS own,
    CASE WHEN hit THEN sha256(CASE WHEN doc_id::VARCHAR IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN (n_chars + 1)::VARCHAR IS NULL THEN '-' ELSE strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR END || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) END AS other
  FROM d),
node AS (
  SELECT lang, 0 AS level, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, own) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, own AS h FROM leaf
  UNION ALL
  SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY lang, level, n, i // 2),
sub AS (SELECT lang, level AS depth, h AS subroot, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS g, count(*) OVER () AS groups FROM node WHERE n = 1),
top AS (
  SELECT 0 AS level, g AS i, groups AS n, subroot AS h FROM sub
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, n, i // 2),
every AS (
  SELECT node.lang, level, i, h FROM node JOIN sub ON node.lang IS NOT DISTINCT FROM sub.lang WHERE level < depth
  UNION ALL SELECT sub.lang, depth + level, i, h FROM top CROSS JOIN sub WHERE n > 1),
start AS (SELECT doc_id, lang, own, other, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, own) - 1 AS i FROM leaf),
way AS (
  SELECT doc_id, start.lang, own, i AS leaf_i, g, depth, 0 AS level, CASE WHEN depth = 0 THEN g ELSE i END AS i, coalesce(other, own) AS v, '' AS proof
  FROM start JOIN sub ON start.lang IS NOT DISTINCT FROM sub.lang
  UNION ALL
  SELECT way.doc_id, way.lang, own, leaf_i, g, depth, way.level + 1, CASE WHEN way.level + 1 = depth THEN g ELSE way.i // 2 END,
    sha256(CASE WHEN s.h IS NULL THEN v WHEN way.i % 2 = 0 THEN v || s.h ELSE s.h || v END), proof || coalesce(s.h, '')
  FROM way JOIN every me ON me.lang IS NOT DISTINCT FROM way.lang AND me.level = way.level AND me.i = way.i
  LEFT JOIN every s ON s.lang IS NOT DISTINCT FROM way.lang AND s.level = way.level AND s.i = xor(way.i, 1)),
root AS (SELECT h AS root FROM top WHERE n = 1),
last AS (SELECT *, row_number() OVER (PARTITION BY lang, leaf_i ORDER BY level DESC) AS back FROM way)
SELECT doc_id, own AS leaf, subroot, root, sha256(proof) AS proof_sha256, v AS folded_root, v = root AS verified
FROM last JOIN sub ON last.lang IS NOT DISTINCT FROM sub.lang CROSS JOIN root WHERE back = 1
""",
    "op13_collocations": r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
word AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM piece),
place AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM word),
f AS (
  SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, k, count(*) AS f
  FROM place CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
cut AS (
  SELECT c.lang, c.phrase, c.a, x.cut, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) x JOIN cand c USING (lang, phrase)
  JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.cut], ' ')
  JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.cut + 1:], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM cut),
inner_phrase AS (
  SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(2, k)) AS m FROM cand), (SELECT unnest([1, 2, 3]) AS s) WHERE s + m - 1 <= k GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_phrase i USING (lang, phrase) WHERE o = 1 AND NOT coalesce(100::HUGEINT * longer >= 80::HUGEINT * a, false)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
""",
}
