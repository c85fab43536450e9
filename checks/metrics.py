"""Scores of predictions against targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as s
from tarnmill.operators import metrics
from tarnmill.operators.tokens import ids_to_pieces, pieces_to_ids

QUERIES, ORACLES, query = s.registry()


def _lower_pairs(spark, sf):
    pairs = s.conversation_pairs(spark, sf)
    return pairs.withColumns({side: metrics.normalise(F.col(side)) for side in ("hypothesis", "reference")})


_NORMAL = f"""{s.CONVERSATIONS},
normal AS (
  SELECT pair_id, lower(CASE WHEN hypothesis = '' THEN ' ' ELSE hypothesis END) AS hypothesis,
         lower(CASE WHEN reference = '' THEN ' ' ELSE reference END) AS reference FROM pairs)"""

_SPACED = "regexp_replace(trim({0}, ' ' || chr(9) || chr(10) || chr(13)), '\\s+', ' ', 'g')"


@query("aligned_pairs", f"WITH {s.CONVERSATIONS} SELECT pair_id, md5(hypothesis) AS hypothesis, md5(reference) AS reference FROM pairs")
def aligned_pairs(spark, sf):
    pairs = s.conversation_pairs(spark, sf)
    joined = metrics.align(pairs.select("pair_id", "hypothesis"), pairs.select("pair_id", "reference"), "pair_id")
    return joined.select("pair_id", F.md5("hypothesis").alias("hypothesis"), F.md5("reference").alias("reference"))


@query(
    "generated_pieces",
    f"""WITH {s.IDS} SELECT file_id, coalesce(string_agg(CASE WHEN id = 0 THEN '<EOL>' ELSE tok END, ' ' ORDER BY pos) FILTER (pos >= 20), '') AS prediction
    FROM ids GROUP BY file_id""",
)
def generated_pieces(spark, sf):
    vocab = s.vocabulary(spark, sf)
    ids = pieces_to_ids(s.token_files(spark, sf), vocab, drop=["tokens"]).select("file_id", "ids")
    pieces = ids_to_pieces(ids, vocab, "ids", "pieces")
    answer = pieces.withColumn("prediction", metrics.generated_pieces(F.col("pieces"), F.lit(20)))
    return answer.select("file_id", s.text_of("prediction").alias("prediction"))


@query("normalised_text", f"WITH {_NORMAL} SELECT pair_id, hypothesis, reference FROM normal")
def normalised_text(spark, sf):
    return _lower_pairs(spark, sf)


def _rouge_sql(n: int) -> str:
    def words(side: str) -> str:
        sentence = _SPACED.format("x")
        return f"flatten(list_transform(list_filter(string_split({side}, '.'), lambda x: x <> ''), lambda x: string_split({sentence}, ' ')))"

    def grams(side: str) -> str:
        if n == 1:
            return f"list_distinct({side})"
        return f"list_distinct(list_transform(range(1, len({side})), lambda i: {side}[i] || ' ' || {side}[i + 1]))"

    return f"""WITH {_NORMAL},
    worded AS (SELECT pair_id, {words('hypothesis')} AS h, {words('reference')} AS r FROM normal),
    gramed AS (SELECT pair_id, {grams('h')} AS h, {grams('r')} AS r FROM worded),
    counted AS (SELECT pair_id, len(h) AS nh, len(r) AS nr, len(list_intersect(h, r)) AS b FROM gramed),
    shares AS (SELECT pair_id, coalesce(CAST(b AS DOUBLE) / nullif(nh, 0), 0) AS p, coalesce(CAST(b AS DOUBLE) / nullif(nr, 0), 0) AS r FROM counted)
    SELECT pair_id, round(p, 6) AS p, round(r, 6) AS r, round(CAST(2 AS DOUBLE) * p * r / (p + r + CAST(1e-8 AS DOUBLE)), 6) AS f FROM shares"""


def _rouge(spark, sf, n: int):
    pairs = _lower_pairs(spark, sf).withColumn("s", metrics.rouge_n(F.col("hypothesis"), F.col("reference"), n))
    return pairs.select("pair_id", *[F.round(f"s.{c}", 6).alias(c) for c in "prf"])


@query("rouge_1", _rouge_sql(1))
def rouge_1(spark, sf):
    return _rouge(spark, sf, 1)


@query("rouge_2", _rouge_sql(2))
def rouge_2(spark, sf):
    return _rouge(spark, sf, 2)


@query("rouge_l")
def rouge_l(spark, sf):
    pairs = metrics.rouge_l(_lower_pairs(spark, sf))
    return pairs.select("pair_id", *[F.round(f"rouge_l.{c}", 6).alias(c) for c in "prf"])


@query("rouge_averages")
def rouge_averages(spark, sf):
    return metrics.rouge(_lower_pairs(spark, sf))


def _word_rows(side: str) -> str:
    return f"list_filter(string_split({_SPACED.format(side)}, ' '), lambda w: w <> '')"


_BLEU = f"""WITH {_NORMAL},
sides AS (
  SELECT pair_id, 'h' AS side, {_word_rows('hypothesis')} AS words FROM normal UNION ALL SELECT pair_id, 'r', {_word_rows('reference')} FROM normal),
word_rows AS (SELECT pair_id, side, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM sides),
shifted AS (
  SELECT pair_id, side, w AS g1, w || ' ' || lead(w, 1) OVER x AS g2, w || ' ' || lead(w, 1) OVER x || ' ' || lead(w, 2) OVER x AS g3,
         w || ' ' || lead(w, 1) OVER x || ' ' || lead(w, 2) OVER x || ' ' || lead(w, 3) OVER x AS g4
  FROM word_rows WINDOW x AS (PARTITION BY pair_id, side ORDER BY i)),
grams AS (
  SELECT pair_id, side, 1 AS n, g1 AS g FROM shifted UNION ALL SELECT pair_id, side, 2, g2 FROM shifted WHERE g2 IS NOT NULL
  UNION ALL SELECT pair_id, side, 3, g3 FROM shifted WHERE g3 IS NOT NULL UNION ALL SELECT pair_id, side, 4, g4 FROM shifted WHERE g4 IS NOT NULL),
gram_counts AS (SELECT pair_id, n, g, count_if(side = 'h') AS h, count_if(side = 'r') AS r FROM grams GROUP BY pair_id, n, g),
totals AS (
  SELECT n, CAST(sum(greatest(len(words) - n + 1, 1)) AS BIGINT) AS total FROM sides, (VALUES (1), (2), (3), (4)) AS orders(n) WHERE side = 'h' GROUP BY n),
matches AS (SELECT n, CAST(sum(least(h, r)) AS BIGINT) AS matched FROM gram_counts GROUP BY n),
sums AS (SELECT n, coalesce(matched, 0) AS matched, total FROM totals LEFT JOIN matches USING (n))"""


@query("bleu_counts", f"{_BLEU} SELECT CAST(n AS INTEGER) AS n, matched, total FROM sums")
def bleu_counts(spark, sf):
    return metrics.bleu_counts(_lower_pairs(spark, sf)).select("n", F.col("matched").cast("bigint").alias("matched"), "total")


@query(
    "corpus_bleu",
    f"""{_BLEU},
    lengths AS (SELECT sum(CASE WHEN side = 'h' THEN len(words) ELSE 0 END) AS h, sum(CASE WHEN side = 'r' THEN len(words) ELSE 0 END) AS r FROM sides),
    logs AS (SELECT sum(ln(CASE WHEN n = 1 THEN CAST(matched AS DOUBLE) / total ELSE CAST(matched + 1 AS DOUBLE) / (total + 1) END)) AS s FROM sums)
    SELECT round(CASE WHEN h > r THEN 1 ELSE exp(1 - CAST(r AS DOUBLE) / h) END * exp(s / 4), 6) AS bleu FROM lengths, logs""",
)
def corpus_bleu(spark, sf):
    return metrics.corpus_bleu(_lower_pairs(spark, sf)).select(F.round("bleu", 6).alias("bleu"))


@query(
    "character_bleu",
    f"""WITH {_NORMAL},
    counts AS (SELECT len(list_intersect(list_distinct(string_split(hypothesis, '')), list_distinct(string_split(reference, '')))) AS m, length(hypothesis) AS n FROM normal),
    sums AS (SELECT sum(m) AS m, sum(n) AS t1, sum(greatest(n - 1, 1)) AS t2, sum(greatest(n - 2, 1)) AS t3, sum(greatest(n - 3, 1)) AS t4 FROM counts)
    SELECT round(exp((ln(CAST(m AS DOUBLE) / t1) + ln(CAST(1 AS DOUBLE) / (t2 + 1)) + ln(CAST(1 AS DOUBLE) / (t3 + 1)) + ln(CAST(1 AS DOUBLE) / (t4 + 1))) / 4), 9) AS bleu FROM sums""",
)
def character_bleu(spark, sf):
    return metrics.character_bleu(_lower_pairs(spark, sf)).select(F.round("bleu", 9).alias("bleu"))


# DuckDB's distance counts bytes, so accented letters are first mapped one to one to
# unused one-byte characters, which leaves the distance in characters unchanged.
_ACCENTS = "äçèéêíñóöüßàáâëîïôùúûœæì"
_ONE_BYTE = " || ".join(f"chr({1 + i if i < 8 else 6 + i})" for i in range(len(_ACCENTS)))


def _distance(a: str, b: str) -> str:
    return f"levenshtein(translate({a}, '{_ACCENTS}', {_ONE_BYTE}), translate({b}, '{_ACCENTS}', {_ONE_BYTE}))"


@query(
    "edit_similarity",
    f"""WITH {_NORMAL} SELECT pair_id, round(1 - CAST({_distance('hypothesis', 'reference')} AS DOUBLE) / greatest(length(hypothesis), length(reference)), 6) AS similarity FROM normal""",
)
def edit_similarity(spark, sf):
    score = metrics.edit_similarity(F.col("hypothesis"), F.col("reference"))
    return _lower_pairs(spark, sf).select("pair_id", F.round(score, 6).alias("similarity"))


@query(
    "mean_edit_similarity",
    f"""WITH {_NORMAL} SELECT round(avg(1 - CAST({_distance('hypothesis', 'reference')} AS DOUBLE) / greatest(length(hypothesis), length(reference))), 6) AS levenshtein FROM normal""",
)
def mean_edit_similarity(spark, sf):
    return metrics.mean_edit_similarity(_lower_pairs(spark, sf)).select(F.round("levenshtein", 6).alias("levenshtein"))


_CHOSEN = f"""{_BLEU},
lengths AS (SELECT sum(CASE WHEN side = 'h' THEN len(words) ELSE 0 END) AS h, sum(CASE WHEN side = 'r' THEN len(words) ELSE 0 END) AS r FROM sides),
logs AS (SELECT sum(ln(CASE WHEN n = 1 THEN CAST(matched AS DOUBLE) / total ELSE CAST(matched + 1 AS DOUBLE) / (total + 1) END)) AS s FROM sums),
chars AS (SELECT len(list_intersect(list_distinct(string_split(hypothesis, '')), list_distinct(string_split(reference, '')))) AS m, length(hypothesis) AS n FROM normal),
char_sums AS (SELECT sum(m) AS m, sum(n) AS t1, sum(greatest(n - 1, 1)) AS t2, sum(greatest(n - 2, 1)) AS t3, sum(greatest(n - 3, 1)) AS t4 FROM chars)
SELECT 'bleu' AS metric, round(CASE WHEN h > r THEN 1 ELSE exp(1 - CAST(r AS DOUBLE) / h) END * exp(s / 4), 6) AS value FROM lengths, logs
UNION ALL
SELECT 'character_bleu', round(exp((ln(CAST(m AS DOUBLE) / t1) + ln(CAST(1 AS DOUBLE) / (t2 + 1)) + ln(CAST(1 AS DOUBLE) / (t3 + 1)) + ln(CAST(1 AS DOUBLE) / (t4 + 1))) / 4), 6) FROM char_sums
UNION ALL
SELECT 'levenshtein', round(avg(1 - CAST({_distance('hypothesis', 'reference')} AS DOUBLE) / greatest(length(hypothesis), length(reference))), 6) FROM normal"""


@query("chosen_metrics", _CHOSEN)
def chosen_metrics(spark, sf):
    found = metrics.evaluate(_lower_pairs(spark, sf), ["bleu", "character_bleu", "levenshtein"])
    return found.select("metric", F.round("value", 6).alias("value"))


def _rouge_average(n: int) -> str:
    return f"(SELECT 'rouge-{n}' AS metric, round(avg(p), 5) AS p, round(avg(r), 5) AS r, round(avg(f), 5) AS f FROM ({_rouge_sql(n)}))"


@query("rouge_n_averages", f"{_rouge_average(1)} UNION ALL {_rouge_average(2)}")
def rouge_n_averages(spark, sf):
    rows = metrics.rouge(_lower_pairs(spark, sf)).where(F.col("metric") != "rouge-l")
    return rows.select("metric", *[F.round(c, 5).alias(c) for c in "prf"])
