"""From source files to packed blocks of token ids."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from tarnmill.operators.textmodel import TextModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.functions.arrays import join_lines, lines_containing
from tarnmill.markers import BEGIN_COMMENT, BLOCK_SIZE
from tarnmill.operators import classify, comments, dedup, lexing, packing, splits, subword, tokens, vocab
from tarnmill.sources.records import write_csv, write_splits


class CorpusBuild:
    """The stages of one build. ``folder`` must be reachable by all executors; every
    stage writes one table there and later stages read it, so a lost executor never
    repeats more than a stage and a stopped build can go on with the next stage."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _store(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(name))
        return df.sparkSession.read.parquet(self._path(name))

    def comments(self, files: DataFrame, keep: Callable | None = None) -> DataFrame:
        """``file_id, repo, text, blocks`` of files with comments (``file_id, repo, text``
        in). The text stays with its comments: sources are read once, and later stages
        that do not need it do not read the column."""
        found = comments.filter_blocks(comments.comment_blocks(lexing.lex_files(files)), keep)
        kept = found.select("file_id", "repo", "text", "blocks")
        return self._store("comments", kept.where(F.size("blocks") > 0))

    def classified(self, commented: DataFrame, model: TextModel) -> DataFrame:
        """One scored row per comment."""
        rows = comments.comment_rows(commented, "file_id", "repo")
        return self._store("classified", classify.predict(model, rows).drop("lines"))

    def selected(self, commented: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
        """Files with at least one suitable comment, with text and comment blocks."""
        return self._store("selected", classify.suitable_files(commented, scored, threshold))

    def tokenised(self, selected: DataFrame) -> DataFrame:
        """``file_id, repo, code, hash, num_lines, positions, num_comments``."""
        coded = lexing.code_lines(selected).where(F.col("code_error").isNull()).select("file_id", "repo", "code")
        measured = coded.withColumns(
            {
                "hash": dedup.simhash(join_lines(F.col("code"))),
                "num_lines": F.size("code"),
                "positions": lines_containing(F.col("code"), BEGIN_COMMENT),
            }
        )
        return self._store("tokenised", measured.withColumn("num_comments", F.size("positions")))

    def split(self, tokenised: DataFrame, **shares: float) -> DataFrame:
        """``split, repo, file_id`` of the distinct files, and the statistics as CSV."""
        meta = tokenised.select("file_id", "repo", "num_lines", "num_comments", "hash")
        unique = self._store("unique", dedup.unique_files(meta))
        budgets = splits.line_budgets(splits.corpus_totals(unique), **shares)
        assigned = self._store("repos", splits.assign_repos(splits.repo_totals(unique), budgets))
        write_csv(splits.split_statistics(assigned, dedup.duplicate_count(unique)), self._path("split_statistics"))
        write_splits(splits.split_files(unique, assigned), self._path("splits"))
        return tokenised.sparkSession.read.parquet(self._path("splits"))

    def vocabulary(
        self,
        tokenised: DataFrame,
        vocab_size: int = vocab.VOCAB_SIZE,
        num_reserved: int = 0,
        character_coverage: float = 1.0,
    ) -> DataFrame:
        """``piece, id, score`` from all lines."""
        lines = tokenised.select(F.transform("code", lambda line: F.array_join(line, " ")).alias("lines"))
        words = vocab.word_counts(lines, num_reserved=num_reserved)
        return self._store("vocabulary", vocab.fit_vocabulary(words, vocab_size, num_reserved, character_coverage=character_coverage))

    def split_lines(self, tokenised: DataFrame) -> DataFrame:
        """``file_id, lines, split``: the texts meet their split once and are stored by it."""
        wanted = tokenised.sparkSession.read.parquet(self._path("splits")).select("file_id", "split")
        lines = F.transform("code", lambda line: F.array_join(line, " ")).alias("lines")
        path = self._path("split_lines")
        tokenised.select("file_id", lines).join(wanted, "file_id").write.mode("overwrite").partitionBy("split").parquet(path)
        return tokenised.sparkSession.read.parquet(path)

    def token_dataset(self, split_lines: DataFrame, vocabulary: DataFrame, split: str, num_reserved: int = 0) -> DataFrame:
        """``file_id, tokens`` of one split; reads that split's partition only."""
        lines = split_lines.where(F.col("split") == split).select("file_id", "lines")
        pieces = lines.withColumn("lines", subword.encode_lines(F.col("lines"), vocab.piece_scores(vocabulary), num_reserved))
        return self._store(f"tokens_{split}", tokens.frame_files(pieces))

    def id_dataset(self, token_dataset: DataFrame, vocabulary: DataFrame, split: str) -> DataFrame:
        ids = tokens.pieces_to_ids(token_dataset, vocabulary, drop=["tokens"]).select("file_id", "ids")
        return self._store(f"ids_{split}", ids)

    def blocks(self, id_dataset: DataFrame, split: str, epoch: int = 0, fraction: float = 1.0, block_size: int = BLOCK_SIZE) -> DataFrame:
        packed = packing.pack_blocks(id_dataset, block_size, fraction, epoch)
        return self._store(f"blocks_{split}_{epoch}", packed)


def build_corpus(
    files: DataFrame,
    folder: str,
    model: TextModel,
    threshold: float,
    vocab_size: int = vocab.VOCAB_SIZE,
    shares: Mapping[str, float] | None = None,
    chosen: tuple[str, ...] = ("train", "validation", "test"),
    block_size: int = BLOCK_SIZE,
    num_reserved: int = 0,
) -> dict[str, DataFrame]:
    """All stages in order; returns the packed blocks per chosen split."""
    build = CorpusBuild(folder)
    commented = build.comments(files)
    scored = build.classified(commented, model)
    tokenised = build.tokenised(build.selected(commented, scored, threshold))
    build.split(tokenised, **(shares or {}))
    vocabulary = build.vocabulary(tokenised, vocab_size, num_reserved)
    lines = build.split_lines(tokenised)
    result = {}
    for split in chosen:
        ids = build.id_dataset(build.token_dataset(lines, vocabulary, split, num_reserved), vocabulary, split)
        result[split] = build.blocks(ids, split, block_size=block_size)
    return result
