"""Context/target pairs, fine-tuning examples and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as s
from tarnmill.operators import sequences
from tarnmill.session import cut_lineage


QUERIES, ORACLES, query = s.registry()


@query(
    "comment_ends",
    f"""WITH {s.TOKENS} SELECT file_id, string_agg(CAST(pos + 1 AS VARCHAR), ' ' ORDER BY pos) AS ends FROM tok
    WHERE tok = '</COMMENT>' GROUP BY file_id""",
)
def comment_ends(spark, sf):
    found = s.token_files(spark, sf).withColumn("found", sequences.comment_ends(F.col("tokens"))).where(F.size("found") > 0)
    ends = F.transform("found", lambda c: (c["end"] + 1).cast("string"))
    return found.select("file_id", F.array_join(ends, " ").alias("ends"))


_FUNCTION_ROWS = f"""WITH {s.FUNCTIONS},
defs AS (SELECT d.file_id, d.line_no, d.pos AS head_start, e.pos AS head_end, x.pos AS body_end
  FROM tok d JOIN tok e ON e.file_id = d.file_id AND e.line_no = d.line_no AND e.tok = '<EOL>'
  JOIN tok x ON x.file_id = d.file_id AND x.line_no = d.line_no + 3 AND x.tok = '<DEDENT>' WHERE d.tok = '▁def'),
spans AS (SELECT file_id, head_start, head_end, head_end + 1 AS body_start, body_end FROM defs)"""


@query(
    "function_blocks",
    f"""{_FUNCTION_ROWS} SELECT file_id, CAST(head_start AS INTEGER) AS head_start, CAST(head_end AS INTEGER) AS head_end,
    CAST(body_start AS INTEGER) AS body_start, CAST(body_end AS INTEGER) AS body_end,
    CAST(coalesce(sum(body_end - body_start - 1) OVER (PARTITION BY file_id ORDER BY head_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS saved
    FROM spans""",
)
def function_blocks(spark, sf):
    files = s.function_files(spark, sf).select("file_id", sequences.function_blocks(F.col("tokens"), "▁def").alias("b"))
    return files.select("file_id", F.inline("b"))


def _pair_sql(extra: str, columns: str) -> str:
    return f"WITH {s.TOKENS},{s.PAIRS}{extra} {columns}"


_CONTEXT = """,
contexts AS (
  SELECT g.file_id, comment_no, string_agg(tok, ' ' ORDER BY t.pos) AS context, CAST(count(*) AS INTEGER) AS context_len
  FROM gated g JOIN tok t ON t.file_id = g.file_id AND t.pos >= lo AND t.pos < cut GROUP BY g.file_id, comment_no),
targets AS (
  SELECT g.file_id, comment_no, coalesce(string_agg(tok, ' ' ORDER BY t.pos), '') AS target
  FROM gated g LEFT JOIN tok t ON t.file_id = g.file_id AND t.pos >= cut AND t.pos < hi GROUP BY g.file_id, comment_no)"""


@query(
    "targets",
    _pair_sql(_CONTEXT, "SELECT file_id, CAST(comment_no AS INTEGER) AS comment_no, target FROM targets"),
)
def targets(spark, sf):
    return s.pairs(spark, sf).select("file_id", "comment_no", s.text_of("target").alias("target"))


@query(
    "targets_without_limit",
    _pair_sql("", "SELECT file_id, CAST(comment_no AS INTEGER) AS comment_no, CAST(hi - cut AS INTEGER) AS length FROM bounds WHERE hi > cut"),
)
def targets_without_limit(spark, sf):
    pairs = sequences.comment_pairs(s.token_files(spark, sf), max_target_length=-1)
    return pairs.select("file_id", "comment_no", F.size("target").alias("length"))


@query(
    "contexts",
    _pair_sql(_CONTEXT, "SELECT file_id, CAST(comment_no AS INTEGER) AS comment_no, context FROM contexts"),
)
def contexts(spark, sf):
    return s.pairs(spark, sf).select("file_id", "comment_no", s.text_of("context").alias("context"))


@query(
    "comment_pairs",
    _pair_sql(
        _CONTEXT, "SELECT c.file_id, CAST(c.comment_no AS INTEGER) AS comment_no, context, target FROM contexts c JOIN targets USING (file_id, comment_no)"
    ),
)
def comment_pairs(spark, sf):
    return s.pairs(spark, sf).select("file_id", "comment_no", s.text_of("context").alias("context"), s.text_of("target").alias("target"))


_FOLDED = f"""{_FUNCTION_ROWS},{s.PAIRS},
saved AS (
  SELECT *, coalesce(sum(body_end - body_start - 1) OVER (PARTITION BY file_id ORDER BY head_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS saved
  FROM spans),
folds AS (
  SELECT b.file_id, b.comment_no, body_start, body_end FROM bounds b JOIN saved s ON s.file_id = b.file_id
  WHERE cut - saved > 432 AND body_end < cut),
shown AS (
  SELECT b.file_id, b.comment_no, t.pos, CASE WHEN f.body_start IS NULL THEN t.tok ELSE '<MISSING>' END AS tok
  FROM bounds b JOIN tok t ON t.file_id = b.file_id AND t.pos < b.cut
  LEFT JOIN folds f ON f.file_id = b.file_id AND f.comment_no = b.comment_no AND t.pos >= f.body_start AND t.pos < f.body_end
  WHERE f.body_start IS NULL OR t.pos = f.body_end - 1),
tails AS (SELECT *, row_number() OVER (PARTITION BY file_id, comment_no ORDER BY pos DESC) AS back FROM shown)
SELECT file_id, CAST(comment_no AS INTEGER) AS comment_no, string_agg(tok, ' ' ORDER BY pos) AS context
FROM tails JOIN gated USING (file_id, comment_no) WHERE back <= 432 GROUP BY file_id, comment_no""".replace("JOIN gated USING (file_id, comment_no) WHERE", "SEMI JOIN gated USING (file_id, comment_no) WHERE")


@query("folded_contexts", _FOLDED)
def folded_contexts(spark, sf):
    pairs = sequences.comment_pairs(s.function_files(spark, sf), fold_functions=True)
    return pairs.select("file_id", "comment_no", s.text_of("context").alias("context"))


@query(
    "suitable_pairs",
    f"""WITH {s.TOKENS},{s.PAIRS},
    spoken AS (
      SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY line_no) - 1 AS comment_no, length(replace(line, ' ', '')) AS n
      FROM code WHERE is_comment),
    texts AS (SELECT g.file_id, g.comment_no, n FROM gated g JOIN spoken USING (file_id, comment_no))
    SELECT file_id, CAST(comment_no AS INTEGER) AS comment_no FROM texts WHERE n % 2 = 0 AND CAST(n % 10 AS DOUBLE) / CAST(10 AS DOUBLE) >= CAST(0.5 AS DOUBLE)""",
)
def suitable_pairs(spark, sf):
    def classify(pairs):
        length = F.length("text")
        label = F.when(length % 2 == 0, "positive").otherwise("negative")
        return pairs.withColumns({"label": label, "prob": length % 10 / F.lit(10.0)})

    kept = sequences.keep_suitable(s.pairs(spark, sf), classify, 0.5)
    return kept.select("file_id", "comment_no")


_EXAMPLES = f"""WITH {s.IDS},{s.PAIRS},
rows_of AS (
  SELECT g.file_id, comment_no, i.id, i.pos, i.pos < cut AS in_context FROM gated g JOIN ids i ON i.file_id = g.file_id AND i.pos >= lo AND i.pos < hi),
examples AS (
  SELECT file_id, CAST(comment_no AS INTEGER) AS comment_no, list(id ORDER BY pos) AS ids,
         list(CASE WHEN in_context THEN -100 ELSE id END ORDER BY pos) AS labels, CAST(count_if(in_context) AS INTEGER) AS context_len
  FROM rows_of GROUP BY file_id, comment_no)"""


def _examples(spark, sf):
    return sequences.finetune_examples(s.pairs(spark, sf), s.vocabulary(spark, sf))


@query("finetune_examples", f"{_EXAMPLES} SELECT file_id, comment_no, array_to_string(ids, ' ') AS ids, context_len FROM examples")
def finetune_examples(spark, sf):
    return _examples(spark, sf).select("file_id", "comment_no", s.text_of("ids").alias("ids"), "context_len")


@query("masked_labels", f"{_EXAMPLES} SELECT file_id, comment_no, array_to_string(labels, ' ') AS labels FROM examples")
def masked_labels(spark, sf):
    return sequences.with_labels(_examples(spark, sf)).select("file_id", "comment_no", s.text_of("labels").alias("labels"))


def _batch_sql(left: bool) -> str:
    def padded(column: str, fill: str) -> str:
        filler = f"list_transform(range(width - len(ids)), lambda x: {fill})"
        return f"array_to_string({f'{filler} || {column}' if left else f'{column} || {filler}'}, ' ')"

    return f"""{_EXAMPLES},
    placed AS (SELECT *, row_number() OVER (ORDER BY file_id, comment_no) - 1 AS place FROM examples),
    batched AS (SELECT *, CAST(floor(place / 16) AS BIGINT) AS batch_id, max(len(ids)) OVER (PARTITION BY floor(place / 16)) AS width FROM placed)
    SELECT batch_id, CAST(place % 16 AS INTEGER) AS "row", file_id, comment_no, {padded('ids', '3')} AS input_ids,
           {padded('labels', '-100')} AS labels, {padded('list_transform(ids, lambda x: 1)', '0')} AS attention_mask FROM batched"""


def _batches(spark, sf, left: bool):
    # the examples are a stored table between stages; batching reads it twice
    labelled = sequences.with_labels(cut_lineage(_examples(spark, sf)))
    batches = sequences.padded_batches(labelled, ["file_id", "comment_no"], 16, pad_left=left)
    arrays = ["input_ids", "labels", "attention_mask"]
    return batches.select("batch_id", "row", "file_id", "comment_no", *[s.text_of(a).alias(a) for a in arrays])


@query("left_padded_batches", _batch_sql(True))
def left_padded_batches(spark, sf):
    return _batches(spark, sf, True)


@query("right_padded_batches", _batch_sql(False))
def right_padded_batches(spark, sf):
    return _batches(spark, sf, False)
