"""Scores of predicted code against targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnmill.functions.arrays import cut, let
from tarnmill.functions.tasks import row_function
from tarnmill.markers import END_LINE, UNKNOWN

# Smoothing term of the F score and the longest n-gram of BLEU.
F_EPSILON = 1e-8
BLEU_ORDER = 4
METRICS = ("rouge", "bleu", "character_bleu", "levenshtein")
DEFAULT_METRICS = ("rouge", "bleu", "levenshtein")


def generated_pieces(pieces: Column, prompt_length: Column) -> Column:
    """Pieces after the prompt, with the unknown piece read as an end of line."""
    answer = cut(pieces, prompt_length, F.size(pieces))
    return F.transform(answer, lambda p: F.when(p == UNKNOWN, F.lit(END_LINE)).otherwise(p))


def align(predictions: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Predictions and targets of the same example; a failed prediction has no pair."""
    return predictions.join(targets, key)


def normalise(text: Column, case_sensitive: bool = False) -> Column:
    """Empty text becomes one space; lower case unless case matters."""
    filled = F.when(text == "", F.lit(" ")).otherwise(text)
    return filled if case_sensitive else F.lower(filled)


def rouge_words(text: Column) -> Column:
    """Words of the sentences, which periods separate."""
    sentences = F.filter(F.split(text, r"\."), lambda s: s != "")
    return F.flatten(F.transform(sentences, lambda s: F.split(_single_spaced(s), " ")))


def _single_spaced(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " ")


def _plain_words(text: Column) -> Column:
    return F.filter(F.split(_single_spaced(text), " "), lambda word: word != "")


def ngrams(words: Column, n: int) -> Column:
    return let(
        words,
        lambda w: F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))),
                lambda i: F.array_join(F.slice(w, i + 1, n), " "),
            )
        ),
    )


def _f_score(precision: Column, recall: Column) -> Column:
    return 2.0 * precision * recall / (precision + recall + F_EPSILON)


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def rouge_n(hypothesis: Column, reference: Column, n: int) -> Column:
    """Struct ``p, r, f`` over the sets of word n-grams; 0 where a side has none."""
    hyp = F.array_distinct(ngrams(rouge_words(hypothesis), n))
    ref = F.array_distinct(ngrams(rouge_words(reference), n))

    def score(s: Column) -> Column:
        both = F.size(F.array_intersect(s["h"], s["r"]))
        return F.struct(_ratio(both, F.size(s["h"])).alias("p"), _ratio(both, F.size(s["r"])).alias("r"))

    scored = let(F.struct(hyp.alias("h"), ref.alias("r")), score)
    return let(scored, lambda s: F.struct(s["p"].alias("p"), s["r"].alias("r"), _f_score(s["p"], s["r"]).alias("f")))


def _match_bits(hypothesis: Sequence[str]) -> dict[str, int]:
    """For every word, a number whose bit j is set where the hypothesis has it."""
    bits: dict[str, int] = {}
    for j, word in enumerate(hypothesis):
        bits[word] = bits.get(word, 0) | 1 << j
    return bits


def _common_words(reference: Sequence[str], bits: dict[str, int], n: int) -> set[str]:
    """Words of one longest common subsequence with a hypothesis of ``n`` words; ties prefer a shorter one.

    Bit j of the row of i is set where i words of the reference have a longer common subsequence with
    j + 1 words of the hypothesis than with j; a row follows from the one above by an addition
    over all columns at once. A set bit says that a step back must leave the reference's word.
    """
    every, flat = (1 << n) - 1, (1 << n) - 1
    steps, matches = [], []
    for word in reference:
        match = bits.get(word, 0)
        if match:
            flat = ((flat + (flat & match)) | (flat & ~match)) & every
        steps.append(every & ~flat)
        matches.append(match)
    common: set[str] = set()
    left = every
    for word, match, step in zip(reversed(reference), reversed(matches), reversed(steps)):
        # columns that neither match nor step are passed over at once
        j = ((match | step) & left).bit_length()
        if j == 0:
            break
        left = (1 << j) - 1
        if match >> (j - 1) & 1:
            common.add(word)
            left >>= 1
    return common


def _union_size(hypothesis: list[list[str]], reference: list[list[str]]) -> int:
    found: set[str] = set()
    for words in hypothesis:
        bits = _match_bits(words)
        for sentence in reference:
            if not bits.keys().isdisjoint(sentence):
                found |= _common_words(sentence, bits, len(words))
    return len(found)


_lcs_union = row_function(T.IntegerType(), lambda: _union_size)


def rouge_l(pairs: DataFrame, hypothesis: str = "hypothesis", reference: str = "reference") -> DataFrame:
    """Add ``rouge_l``, a struct ``p, r, f``: the words in the longest common
    subsequences of all sentence pairs, against the distinct words of each side."""

    def sentences(text: str) -> Column:
        parts = F.filter(F.split(text, r"\."), lambda s: s != "")
        return F.transform(parts, lambda s: F.split(_single_spaced(s), " "))

    common = pairs.withColumn("__common", _lcs_union(sentences(hypothesis), sentences(reference)))
    p = _ratio(F.col("__common"), F.size(F.array_distinct(rouge_words(F.col(hypothesis)))))
    r = _ratio(F.col("__common"), F.size(F.array_distinct(rouge_words(F.col(reference)))))
    scores = common.withColumns({"__p": p, "__r": r})
    built = F.struct(F.col("__p").alias("p"), F.col("__r").alias("r"), _f_score(F.col("__p"), F.col("__r")).alias("f"))
    return scores.withColumn("rouge_l", built).drop("__common", "__p", "__r")


def rouge(pairs: DataFrame, hypothesis: str = "hypothesis", reference: str = "reference") -> DataFrame:
    """Average precision, recall and F of ROUGE-1, -2 and -L: ``metric, p, r, f``."""
    scored = rouge_l(pairs, hypothesis, reference).withColumns(
        {f"rouge_{n}": rouge_n(F.col(hypothesis), F.col(reference), n) for n in (1, 2)}
    )
    names = ["rouge_1", "rouge_2", "rouge_l"]
    row = scored.agg(*[F.avg(f"{name}.{part}").alias(f"{name}_{part}") for name in names for part in "prf"])
    built = [
        F.struct(F.lit(name.replace("_", "-")).alias("metric"), *[F.col(f"{name}_{part}").alias(part) for part in "prf"])
        for name in names
    ]
    return row.select(F.inline(F.array(*built)))


def _bleu_row(words: Column) -> Column:
    """Counts of one pair, given as struct of word arrays ``h`` and ``r``: per n-gram length the
    clipped matches and the n-grams of the hypothesis, at least one; and both lengths."""

    def counts(n: int) -> list[Column]:
        def clipped(pair: Column) -> Column:
            def times(side: str, gram: Column) -> Column:
                return F.size(F.filter(pair[side], lambda g: g == gram))

            shared = F.array_intersect(pair["h"], pair["r"])
            return F.aggregate(shared, F.lit(0), lambda total, gram: total + F.least(times("h", gram), times("r", gram)))

        grams = F.struct(ngrams(words["h"], n).alias("h"), ngrams(words["r"], n).alias("r"))
        total = F.greatest(F.size(words["h"]) - (n - 1), F.lit(1))
        return [let(grams, clipped).alias(f"matched{n}"), total.alias(f"total{n}")]

    lengths = [F.size(words["h"]).alias("h"), F.size(words["r"]).alias("r")]
    return F.struct(*[c for n in range(1, BLEU_ORDER + 1) for c in counts(n)], *lengths)


def _bleu_sums(pairs: DataFrame, hypothesis: str, reference: str) -> DataFrame:
    """One row with the corpus sums of ``_bleu_row``, from one pass over the pairs."""
    words = F.struct(_plain_words(F.col(hypothesis)).alias("h"), _plain_words(F.col(reference)).alias("r"))
    rows = pairs.select(let(words, _bleu_row).alias("c"))
    names = [f"{kind}{n}" for n in range(1, BLEU_ORDER + 1) for kind in ("matched", "total")] + ["h", "r"]
    return rows.agg(*[F.coalesce(F.sum(f"c.{name}"), F.lit(0)).alias(name) for name in names])


def bleu_counts(pairs: DataFrame, hypothesis: str = "hypothesis", reference: str = "reference") -> DataFrame:
    """Corpus sums per n-gram length: ``n, matched, total``. A hypothesis counts for at
    least one n-gram, also if it is shorter than that."""
    sums = _bleu_sums(pairs, hypothesis, reference)
    rows = [F.struct(F.lit(n).alias("n"), F.col(f"matched{n}").alias("matched"), F.col(f"total{n}").alias("total")) for n in range(1, BLEU_ORDER + 1)]
    return sums.select(F.inline(F.array(*rows)))


def corpus_bleu(pairs: DataFrame, hypothesis: str = "hypothesis", reference: str = "reference") -> DataFrame:
    """Token BLEU-4 of the corpus, one row; n-gram precisions above one word are
    smoothed by adding one to both counts."""
    sums = _bleu_sums(pairs, hypothesis, reference)
    logs = F.log(_ratio(F.col("matched1"), F.col("total1")))
    for n in range(2, BLEU_ORDER + 1):
        logs = logs + F.log((F.col(f"matched{n}") + 1) / (F.col(f"total{n}") + 1))
    penalty = F.when(F.col("h") > F.col("r"), F.lit(1.0)).otherwise(F.exp(1 - F.col("r") / F.col("h")))
    score = F.when(F.col("matched1") == 0, F.lit(0.0)).otherwise(penalty * F.exp(logs / BLEU_ORDER))
    return sums.select(score.alias("bleu"))


def character_bleu(pairs: DataFrame, hypothesis: str = "hypothesis", reference: str = "reference") -> DataFrame:
    """BLEU over strings, as a call with untokenised text computes it, one row.

    Every character of the target is then a reference of its own: one match per
    distinct shared character, no longer matches, no brevity penalty.
    """

    def counts(s: Column) -> list[Column]:
        shared = F.size(F.array_intersect(s["h"], s["r"]))
        length = F.size(s["h"])
        return [shared, length, *[F.greatest(length - k, F.lit(1)) for k in range(1, BLEU_ORDER)]]

    chars = F.struct(F.split(hypothesis, "").alias("h"), F.split(reference, "").alias("r"))
    names = ["matched", "t1", "t2", "t3", "t4"]
    rows = pairs.select(let(chars, lambda s: F.struct(*[c.alias(n) for c, n in zip(counts(s), names)])).alias("c"))
    sums = rows.agg(*[F.sum(f"c.{name}").alias(name) for name in names])
    logs = F.log(F.col("matched") / F.col("t1"))
    for name in names[2:]:
        logs = logs + F.log(1 / (F.col(name) + 1))
    return sums.select(F.when(F.col("matched") == 0, F.lit(0.0)).otherwise(F.exp(logs / BLEU_ORDER)).alias("bleu"))


def edit_similarity(hypothesis: Column, reference: Column) -> Column:
    """One minus the edit distance over the longer length."""
    longest = F.greatest(F.length(hypothesis), F.length(reference))
    return 1 - F.levenshtein(hypothesis, reference) / longest


def mean_edit_similarity(pairs: DataFrame, hypothesis: str = "hypothesis", reference: str = "reference") -> DataFrame:
    return pairs.agg(F.avg(edit_similarity(F.col(hypothesis), F.col(reference))).alias("levenshtein"))


def evaluate(pairs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Long table ``metric, value`` of the chosen metrics; unknown names are rejected.

    ``bleu`` is over words, ``character_bleu`` what the same call makes of plain strings.
    """
    unknown = set(metrics) - set(METRICS)
    if unknown or not metrics:
        raise ValueError(f"metrics must be chosen from {METRICS}, not {sorted(unknown)}")
    parts = []
    if "rouge" in metrics:
        scores = rouge(pairs)
        stacked = "stack(3, concat(metric, '-p'), p, concat(metric, '-r'), r, concat(metric, '-f'), f)"
        parts.append(scores.select(F.expr(stacked).alias("metric", "value")))
    if "bleu" in metrics:
        parts.append(corpus_bleu(pairs).select(F.lit("bleu").alias("metric"), F.col("bleu").alias("value")))
    if "character_bleu" in metrics:
        parts.append(character_bleu(pairs).select(F.lit("character_bleu").alias("metric"), F.col("bleu").alias("value")))
    if "levenshtein" in metrics:
        mean = mean_edit_similarity(pairs)
        parts.append(mean.select(F.lit("levenshtein").alias("metric"), F.col("levenshtein").alias("value")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
