"""One query per operator over the given tables, with SQL where SQL can state the result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.llm import decontaminate, lattice, lines, near_dup, packing, phrases, pii, quality, search, sharding, token_files, toxicity, urls
from tarnmill.session import checkpoint_dir


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_bagminhash_near_dup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf, "documents"))


def op2_repetition_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality(table(spark, sf, "documents"))


_SPACE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


def _grams(width: int) -> str:
    return f"""
g{width} AS (
  SELECT doc_id, i, nchars,
         max(CASE WHEN repeated THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW) AS inside
  FROM (
    SELECT doc_id, i, nchars, i + {width - 1} <= n AND count(*) OVER (PARTITION BY doc_id, list_slice(ws, i, i + {width - 1})) > 1 AS repeated
    FROM words)),
d{width} AS (SELECT doc_id, sum(inside) AS n{width}, sum(inside * nchars) AS c{width} FROM g{width} GROUP BY doc_id)"""


_LIMITS = " AND ".join(f"100 * coalesce(c{n}, 0) <= {limit} * word_chars" for n, limit in quality.LIMITS.items())

OP2_SQL = f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS ws FROM documents),
words AS (
  SELECT doc_id, ws, len(ws) AS n, unnest(generate_series(1, len(ws))) AS i, length(unnest(ws)) AS nchars FROM texts),
{",".join(_grams(n) for n in quality.LIMITS)},
lines AS (
  SELECT doc_id, line, length(regexp_replace(line, '[ \\x09-\\x0D]', '', 'g')) AS nchars,
         row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM texts)),
line_sums AS (
  SELECT doc_id, count(*) FILTER (nth > 1 AND nchars > 0) AS n_dup_lines, coalesce(sum(nchars) FILTER (nth > 1), 0) AS dup_line_chars
  FROM lines GROUP BY doc_id),
base AS (
  SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n{quality.BASE_WIDTH}, 0) AS BIGINT) AS n_repeat_words, CAST(dup_line_chars AS BIGINT) AS dup_line_chars,
         {", ".join(f"CAST(coalesce(c{n}, 0) AS BIGINT) AS c{n}" for n in quality.LIMITS)}
  FROM texts t JOIN line_sums USING (doc_id) {" ".join(f"LEFT JOIN d{n} USING (doc_id)" for n in quality.LIMITS)}),
judged AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.BASE_PERCENT} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars,
       {", ".join(f"c{n} AS dup_{n}gram_chars" for n in quality.LIMITS)}, base_failed,
       NOT base_failed AND 100 * dup_line_chars <= {quality.LINE_LIMIT} * word_chars AND {_LIMITS} AS kept
FROM judged"""


def op3_weak_supervision_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.personal_data(table(spark, sf, "documents"))


def op4_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    done = lines.drop_repeated_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = f"""
WITH rows AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM rows),
dropped AS (
  SELECT key, true AS gone FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= {lines.MIN_DOCS})
SELECT doc_id, count(*) AS n_lines, count(gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (gone IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN dropped USING (key) GROUP BY doc_id"""


def op5_rans_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-tokens-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf, "documents"), path)
    return token_files.read_token_files(spark, path)


def op6_nnls_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


def op7_nearest_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op8_latent_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op9_histogram_shards(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard(table(spark, sf, "documents"))


def op10_url_reputation(spark: SparkSession, sf: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf, "pages"))


def _case(value: str) -> str:
    """The longest rule first, as SQL."""
    longest = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    return " ".join(
        f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{host + path if value == 'rule' else action}'"
        for action, host, path in longest
    )


_RHO = f"least(greatest(CASE WHEN coalesce(sum(p * (1 - p) * (n - 1)), 0) = 0 THEN {urls.LEAST_RHO} ELSE sum(n * pow(good / n - p, 2) - p * (1 - p)) / sum(p * (1 - p) * (n - 1)) END, {urls.LEAST_RHO}), {urls.MOST_RHO})"

OP10_SQL = f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
judged AS (SELECT *, CASE {_case('rule')} END AS rule, CASE {_case('action')} END AS action FROM parts),
counted AS (
  SELECT host, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS parts, CAST(count(action) AS DOUBLE) AS n,
         CAST(count(*) FILTER (action = 'allow') AS DOUBLE) AS good FROM judged GROUP BY host),
levels AS (
  SELECT *, CASE WHEN len(parts) >= 3 AND length(parts[-1]) = 2 AND parts[-2] IN ({", ".join(f"'{x}'" for x in urls.SECOND_LABELS)}) THEN 2 ELSE 1 END AS k
  FROM counted),
hosts AS (
  SELECT host, n, good, array_to_string(parts[greatest(len(parts) - k + 1, 1):], '.') AS suffix,
         array_to_string(parts[greatest(len(parts) - k, 1):], '.') AS domain FROM levels),
p0 AS (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) AS p FROM hosts),
s1 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(p) AS p FROM hosts, p0 GROUP BY suffix),
r1 AS (SELECT 1 / {_RHO} - 1 AS s FROM s1 WHERE n > 0),
m1 AS (SELECT suffix, (good + s * p) / (n + s) AS mean FROM s1, r1),
s2 AS (SELECT h.suffix, domain, sum(n) AS n, sum(good) AS good, any_value(mean) AS p FROM hosts h JOIN m1 USING (suffix) GROUP BY h.suffix, domain),
r2 AS (SELECT 1 / {_RHO} - 1 AS s FROM s2 WHERE n > 0),
m2 AS (SELECT suffix, domain, (good + s * p) / (n + s) AS mean FROM s2, r2),
s3 AS (SELECT h.*, mean AS p FROM hosts h JOIN m2 USING (suffix, domain)),
r3 AS (SELECT 1 / {_RHO} - 1 AS s FROM s3 WHERE n > 0),
m3 AS (SELECT host, (good + s * p) / (n + s) AS mean, n + s + 1 AS size FROM s3, r3),
blocked AS (SELECT host, true AS blocked FROM m3 WHERE mean + {urls.BOUND} * sqrt(mean * (1 - mean) / size) < {urls.THRESHOLD})
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN blocked USING (host)"""


def op11_phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


_ASCII_LOWER = f"'{urls.UPPER}', '{urls.LOWER}'"

OP11_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_extract_all(translate(coalesce(text, ''), {_ASCII_LOWER}), '[^.,;:!?\\x0A-\\x0D]+')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws)) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, m, list_slice(ws, i, i + m - 1) AS g
  FROM (SELECT lang, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i FROM words, (SELECT unnest(generate_series(1, {phrases.LONGEST})) AS m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, g, count(*) AS f FROM grams GROUP BY lang, m, g HAVING count(*) >= {phrases.MIN_COUNT}),
inner_parts AS (
  SELECT DISTINCT lang, f, list_slice(g, i, i + w - 1) AS g
  FROM (SELECT lang, f, g, m, w, unnest(generate_series(1, m - w + 1)) AS i FROM f, (SELECT unnest(generate_series(2, {phrases.LONGEST - 1})) AS w) WHERE w < m)),
kept AS (
  SELECT * FROM f c WHERE m >= 2 AND NOT EXISTS (SELECT 1 FROM inner_parts p WHERE p.lang = c.lang AND p.g = c.g AND p.f >= c.f)),
cuts AS (SELECT lang, m, g, f AS a, unnest(generate_series(1, m - 1)) AS k FROM kept),
scored AS (
  SELECT c.lang, c.g, c.a, c.k, x.f AS l, y.f AS r, t.n,
         CAST((1000 * CAST(c.a AS HUGEINT) * CAST(t.n AS HUGEINT)) // (CAST(x.f AS HUGEINT) * CAST(y.f AS HUGEINT)) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, c.k)
  JOIN f y ON y.lang = c.lang AND y.g = list_slice(c.g, c.k + 1, c.m) JOIN totals t ON t.lang = c.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM worst)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked WHERE rank <= {phrases.FIRST}"""


def op12_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

OP12_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ASCII_LOWER}), '{_TERM}') AS ts FROM documents),
totals AS (SELECT count(*) FILTER (len(ts) > 0) AS big_n, sum(len(ts)) AS big_l FROM docs),
items AS (SELECT DISTINCT item_id, text FROM benchmark),
query_terms AS (
  SELECT item_id, text, term FROM (SELECT item_id, text, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), {_ASCII_LOWER}), '{_TERM}'))) AS term FROM items)),
tfs AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(ts) AS n, unnest(ts) AS term FROM docs)
  WHERE term IN (SELECT term FROM query_terms) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term),
valued AS (
  SELECT row, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // CAST(big_l AS BIGINT))) AS value FROM tfs, totals),
scored AS (
  SELECT item_id, text, row, doc_id, CAST(sum(w * value) AS BIGINT) AS score
  FROM query_terms JOIN valued USING (term) JOIN weights USING (term) GROUP BY item_id, text, row, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= {search.BEST}"""


def op13_lattice_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    return lattice.scored(table(spark, sf, "documents"))


QUERIES = {
    "op1_bagminhash_near_dup": op1_bagminhash_near_dup,
    "op2_repetition_quality": op2_repetition_quality,
    "op3_weak_supervision_pii": op3_weak_supervision_pii,
    "op4_line_dedup": op4_line_dedup,
    "op5_rans_token_files": op5_rans_token_files,
    "op6_nnls_packing": op6_nnls_packing,
    "op7_nearest_toxicity": op7_nearest_toxicity,
    "op8_latent_decontamination": op8_latent_decontamination,
    "op9_histogram_shards": op9_histogram_shards,
    "op10_url_reputation": op10_url_reputation,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_ranked_search": op12_ranked_search,
    "op13_lattice_likelihood": op13_lattice_likelihood,
}
ORACLES = {"op2_repetition_quality": OP2_SQL, "op4_line_dedup": OP4_SQL, "op10_url_reputation": OP10_SQL, "op11_phrase_collocations": OP11_SQL, "op12_ranked_search": OP12_SQL}
