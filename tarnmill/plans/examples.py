"""From token data sets to fine-tuning batches and scored predictions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from tarnmill.operators.textmodel import TextModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.operators import classify, lexing, metrics, sequences
from tarnmill.operators.prefix import take_fraction
from tarnmill.operators.tokens import decode_lines, decode_pieces, ids_to_pieces, pieces_to_ids
from tarnmill.session import cut_lineage


def finetune_batches(
    token_dataset: DataFrame,
    vocabulary: DataFrame,
    batch_size: int,
    model: TextModel | None = None,
    threshold: float = 0.5,
    fraction: float = 1.0,
    pad_left: bool = True,
    **lengths,
) -> DataFrame:
    """Padded batches of context/target examples; with a model only around comments it
    finds suitable."""
    pairs = sequences.comment_pairs(token_dataset, **lengths)
    if model is not None:
        pairs = sequences.keep_suitable(pairs, partial(classify.predict, model), threshold)
    # positions need several passes over the examples, so they are stored once
    examples = cut_lineage(sequences.finetune_examples(pairs, vocabulary))
    keys = ["file_id", "comment_no"]
    if fraction < 1.0:
        examples = cut_lineage(take_fraction(examples, keys, fraction))
    return sequences.padded_batches(sequences.with_labels(examples), keys, batch_size, pad_left)


def score_predictions(
    predictions: DataFrame,
    targets: DataFrame,
    key: str,
    chosen: Sequence[str] = metrics.DEFAULT_METRICS,
    case_sensitive: bool = False,
    untokenise: bool = False,
) -> DataFrame:
    """Scores of ``key, pieces`` predictions against ``key, pieces`` targets."""

    def text(side: DataFrame, name: str) -> DataFrame:
        if untokenise:
            source = side.withColumn("lines", decode_lines(F.col("pieces")))
            return source.select(key, lexing.untokenize(F.col("lines")).alias(name))
        return side.select(key, decode_pieces(F.col("pieces")).alias(name))

    pairs = metrics.align(text(predictions, "hypothesis"), text(targets, "reference"), key)
    sides = {side: metrics.normalise(F.col(side), case_sensitive) for side in ("hypothesis", "reference")}
    return metrics.evaluate(pairs.withColumns(sides), chosen)


def generated_pieces(generated: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """``key, pieces`` after the prompt, from ``key, prompt`` (pieces) and ``ids``."""
    known = ids_to_pieces(generated, vocabulary, "ids", "all")
    return known.select(key, metrics.generated_pieces(F.col("all"), F.size("prompt")).alias("pieces"))


def prompt_ids(pairs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Ids of the contexts, the input of a generator."""
    return pieces_to_ids(pairs, vocabulary, "context", "ids")
