"""Context/target pairs around comments, fine-tuning examples and padded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnmill.functions.arrays import cut, let, mask_prefix, pad, positions_of
from tarnmill.functions.tasks import row_function
from tarnmill.markers import (
    BEGIN_COMMENT,
    CONTROL_IDS,
    DEDENT,
    END_COMMENT,
    END_LINE,
    IGNORED_LABEL,
    INDENT,
    MAX_CONTEXT_LENGTH,
    MAX_TARGET_LENGTH,
    MISSING,
    NUM_TARGET_LINES,
    PADDING,
)
from tarnmill.operators.prefix import with_position
from tarnmill.operators.tokens import decode_pieces, pieces_to_ids

_BLOCKS_TYPE = T.ArrayType(
    T.StructType([T.StructField(n, T.IntegerType()) for n in ("head_start", "head_end", "body_start", "body_end", "saved")])
)

COMMENTS_AT_ONCE = 1024


def comment_ends(tokens: Column) -> Column:
    """Array of ``begin, end, next_line`` for every end-of-comment marker.

    ``begin`` and ``end`` delimit the comment's words; ``next_line`` is the number of
    line ends up to and including the one that follows the comment. An end marker is
    normally followed by an end of line, so its number comes from the position in the
    array of line ends; only other markers need a count.
    """

    def found(arrays: Column) -> Column:
        items, line_ends, marks = arrays["tokens"], arrays["line_ends"], arrays["marks"]

        def describe(at: Column, j: Column) -> Column:
            before = F.get(marks, j - 1)
            begin = (
                F.when(j == 0, F.lit(0))
                .when(F.get(items, before) == BEGIN_COMMENT, before)
                .otherwise(
                    F.coalesce(
                        F.array_max(F.filter(F.slice(marks, 1, j), lambda p: F.get(items, p) == BEGIN_COMMENT)),
                        F.lit(0),
                    )
                )
            )
            known = F.array_position(line_ends, at + 1)
            next_line = F.when(known > 0, known).otherwise(F.size(F.filter(line_ends, lambda p: p <= at + 1)))
            return F.when(
                F.get(items, at) == END_COMMENT,
                F.struct(begin.cast("int").alias("begin"), at.alias("end"), next_line.cast("int").alias("next_line")),
            )

        return F.filter(F.transform(marks, describe), lambda c: c.isNotNull())

    def arrays(items: Column) -> Column:
        marks = F.filter(
            F.transform(items, lambda t, i: F.when(t.isin(BEGIN_COMMENT, END_COMMENT), i)), lambda i: i.isNotNull()
        )
        return F.struct(items.alias("tokens"), positions_of(items, END_LINE).alias("line_ends"), marks.alias("marks"))

    return let(let(tokens, arrays), found)


def _top_level_blocks(events: list[int] | None) -> list[dict]:
    """Function bodies at the outermost level, in closing order.

    ``events`` are positions times four plus a code: 0 function start, 1 indent,
    2 dedent, 3 line end. An open function remembers the depth at which it started and
    closes at the dedent that returns to that depth.
    """
    closed: list[dict] = []
    opened: list[list] = []
    depth = 0
    head_open = False
    saved = 0
    for event in events or []:
        at, code = divmod(event, 4)
        if code == 0:
            opened.append([depth, {"head_start": at, "head_end": 0, "body_start": 0, "body_end": 0}])
            head_open = True
        elif code == 1:
            depth += 1
        elif code == 2:
            depth -= 1
            if opened and opened[-1][0] == depth:
                _, block = opened.pop()
                block["body_end"] = at
                if not opened:
                    closed.append({**block, "saved": saved})
                    saved += at - block["body_start"] - 1
        elif head_open and opened:
            opened[-1][1].update(head_end=at, body_start=at + 1)
            head_open = False
        elif head_open:
            head_open = False
    return closed


def function_blocks(tokens: Column, start_token: str) -> Column:
    """Top-level function blocks of a token array: ``head_start, head_end, body_start,
    body_end`` and ``saved``, the tokens that folding all earlier blocks removes.

    Only the positions of the few tokens that matter leave the JVM.
    """
    coded = F.transform(
        tokens,
        lambda t, i: F.when(t == start_token, i * 4)
        .when(t == INDENT, i * 4 + 1)
        .when(t == DEDENT, i * 4 + 2)
        .when(t == END_LINE, i * 4 + 3),
    )
    events = F.filter(coded, lambda e: e.isNotNull())
    find = row_function(_BLOCKS_TYPE, lambda: _top_level_blocks)
    return find(events)


def truncated_context(tokens: Column, end: Column, max_length: int) -> Column:
    """The last ``max_length`` tokens before position ``end``."""
    return cut(tokens, F.greatest(end - max_length, F.lit(0)), end)


def folded_context(tokens: Column, blocks: Column, end: Column, max_length: int) -> Column:
    """As ``truncated_context``, but function bodies are first replaced by one marker
    each, from the start of the file, while the context is still too long.

    Later blocks only need folding if earlier ones do, so the bodies to fold are a
    filter. Only tokens inside the kept tail are copied.
    """

    def fold(folded: Column) -> Column:
        last = F.element_at(folded, -1)
        saved_all = last["saved"] + last["body_end"] - last["body_start"] - 1
        length = F.least(end, F.size(tokens)) - saved_all
        drop = F.greatest(length - max_length, F.lit(0))

        def piece(block: Column, k: Column) -> Column:
            start = F.when(k == 0, F.lit(0)).otherwise(F.get(folded, k - 1)["body_end"])
            kept = cut(tokens, F.greatest(start, drop + block["saved"]), block["body_start"])
            marker = F.when(block["body_start"] - block["saved"] >= drop, F.array(F.lit(MISSING)))
            return F.concat(kept, F.coalesce(marker, F.array().cast("array<string>")))

        tail = cut(tokens, F.greatest(last["body_end"], drop + saved_all), end)
        return F.concat(F.flatten(F.transform(folded, piece)), tail)

    needed = F.filter(blocks, lambda b: (end - b["saved"] > max_length) & (b["body_end"] < end))
    plain = cut(tokens, F.greatest(F.least(end, F.size(tokens)) - max_length, F.lit(0)), end)
    return let(needed, lambda folded: F.when(F.size(folded) > 0, fold(folded)).otherwise(plain))


def comment_pairs(
    files: DataFrame,
    max_context_length: int = MAX_CONTEXT_LENGTH,
    max_target_length: int = MAX_TARGET_LENGTH,
    num_target_lines: int = NUM_TARGET_LINES,
    fold_functions: bool = False,
    start_token: str = "▁def",
    key: str = "file_id",
) -> DataFrame:
    """One row per comment: ``comment_no, comment, context, target``.

    The target is the next complete lines after the comment. With ``max_target_length``
    -1 an empty target drops the pair; otherwise the target must be shorter than the
    maximum and may be empty. Slices are taken next to the token array, which is only
    repeated once per ``COMMENTS_AT_ONCE`` comments, so that no row grows without bound.
    """
    held = files.select(
        key,
        "tokens",
        comment_ends(F.col("tokens")).alias("comments"),
        positions_of(F.col("tokens"), END_LINE).alias("line_ends"),
    )
    if fold_functions:
        held = held.withColumn("blocks", function_blocks(F.col("tokens"), start_token))
    last_part = F.floor((F.size("comments") - 1) / COMMENTS_AT_ONCE).cast("int")
    parts = F.when(F.size("comments") > 0, F.sequence(F.lit(0), last_part))
    split = held.select("*", F.explode(parts).alias("part"))

    def pair(comment: Column, number: Column, file: Column) -> Column:
        tokens, line_ends = file["tokens"], file["line_ends"]
        end = comment["end"] + 2
        last_line = F.least(comment["next_line"] + num_target_lines, F.size(line_ends)) - 1
        has_line = comment["next_line"] < F.size(line_ends)
        target_end = F.when(has_line, F.get(line_ends, last_line) + 1).otherwise(F.lit(0))
        context = (
            folded_context(tokens, file["blocks"], end, max_context_length)
            if fold_functions
            else truncated_context(tokens, end, max_context_length)
        )
        return F.struct(
            number.alias("comment_no"),
            cut(tokens, comment["begin"] + 1, comment["end"]).alias("comment"),
            context.alias("context"),
            cut(tokens, end, target_end).alias("target"),
        )

    def pairs(file: Column) -> Column:
        first = file["part"] * COMMENTS_AT_ONCE
        some = F.slice(file["comments"], first + 1, F.lit(COMMENTS_AT_ONCE))
        return F.transform(some, lambda comment, i: pair(comment, first + i, file))

    fields = [c for c in split.columns if c != key]
    rows = split.select(key, F.inline(let(F.struct(*fields), pairs)))
    length = F.size("target")
    gate = (length > 0) if max_target_length == -1 else (length < max_target_length)
    return rows.where(gate)


def keep_suitable(pairs: DataFrame, classify, threshold: float = 0.5) -> DataFrame:
    """Pairs whose comment ``classify`` (adds ``label`` and ``prob`` for ``text``) calls
    positive with at least ``threshold``; all comments are scored in one pass."""
    scored = classify(pairs.withColumn("text", decode_pieces(F.col("comment"))))
    kept = scored.where((F.col("label") == "positive") & (F.col("prob") >= threshold))
    return kept.select(*pairs.columns)


def finetune_examples(pairs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Ids of context and target in one array, and the context length."""
    joined = pairs.withColumns({"__all": F.concat("context", "target"), "context_len": F.size("context")})
    return pieces_to_ids(joined, vocab, "__all", "ids", ["__all", "comment", "context", "target"])


def with_labels(examples: DataFrame) -> DataFrame:
    """Add ``labels``: the ids with the context masked out of the loss."""
    return examples.withColumn("labels", mask_prefix(F.col("ids"), F.col("context_len"), IGNORED_LABEL))


def padded_batches(
    examples: DataFrame, keys: list[str], batch_size: int, pad_left: bool = True, pad_id: int = CONTROL_IDS[PADDING]
) -> DataFrame:
    """Batches of consecutive examples padded to the longest in each batch.

    A batch has at most ``batch_size`` rows, which bounds the window groups.
    """
    placed = with_position(examples, keys)
    numbered = placed.withColumns(
        {
            "batch_id": F.floor(F.col("position") / batch_size),
            "row": F.pmod("position", F.lit(batch_size)).cast("int"),
        }
    )
    width = F.max(F.size("ids")).over(Window.partitionBy("batch_id"))
    sized = numbered.withColumn("__width", width)
    w = F.col("__width")
    mask = F.array_repeat(F.lit(1), F.size("ids"))
    return sized.select(
        "batch_id",
        "row",
        *keys,
        pad(F.col("ids"), w, pad_id, pad_left).alias("input_ids"),
        pad(F.col("labels"), w, IGNORED_LABEL, pad_left).alias("labels"),
        pad(mask, w, 0, pad_left).alias("attention_mask"),
    )
