"""Token-id files: all documents in ascending id order, entropy coded in blocks.

``write_token_files`` orders the documents once by a range exchange, tokenises them in place
and stores the ids; counts all ids for the one static frequency table; and codes blocks of
whole documents (``tarnmill.llm.rans``). A data set is three Parquet folders below its path:

- ``blocks``: start (ids before the block), doc_ids, sizes (ids per document), payload;
- ``frequencies``: id, frequency;
- ``header``: tokenizer end id and total ids.

``read_token_files`` decodes the blocks in parallel, each on its own. Rows are documents:
null texts count as empty and hold the end id alone, null ids sort first, repeated rows
and ids each keep a row (ordered by their texts' hash). A document is never cut, so a very long one makes a
large block of its own. An empty table gives empty folders. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.llm.common import chunks, staged
from tarnmill.llm.rans import Table, crc_of, decode_block, encode_block, frequency_table
from tarnmill.llm.tokens import TOKEN_CHUNK, encode_with_end, tokenizer_path

END_ID = 1
BLOCK_IDS = 1 << 18


def tokenised(docs: DataFrame, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Stored rows (part, doc_id, before, n_tokens, ids): parts follow each other in id
    order, ``before`` counts the ids ahead within the part, ``ids`` are packed u32."""
    path = path or tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part_no, before = encode_with_end(path, end_id), TaskContext.get().partitionId(), 0
        for part in chunks(batches, limit=TOKEN_CHUNK):
            ids, bounds = ids_of(part.column("text"))
            sizes = np.diff(bounds)
            packed = pack_ids(ids, bounds)
            columns = [pa.array([part_no] * len(sizes), pa.int32()), part.column("doc_id"), pa.array(before + bounds[:-1]), pa.array(sizes), packed]
            yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "before", "n_tokens", "ids"])
            before += int(bounds[-1])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    kind = dict(docs.dtypes)["doc_id"]
    return staged(ordered.mapInArrow(encode, f"part int, doc_id {kind}, before bigint, n_tokens bigint, ids binary"), "token-ids")


def pack_ids(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Each row's ids as little-endian bytes: two per id where the row has none above
    65,535, and otherwise four after a marker byte (an odd length tells them apart)."""
    if len(ids) == 0 or int(ids.max()) < 1 << 16:
        raw = ids.astype("<u2").tobytes()
        offsets = (bounds * 2).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
    return pa.array([b"\0" + ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())


def unpack_ids(packed: bytes) -> np.ndarray:
    if len(packed) % 2:
        return np.frombuffer(packed, "<u4", offset=1).astype(np.uint32)
    return np.frombuffer(packed, "<u2").astype(np.uint32)


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents (as many numbers as the largest id)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1, np.int64)
        for batch in batches:
            for packed in batch.column("ids").to_pylist():
                more = np.bincount(unpack_ids(packed)) if packed else np.zeros(1, np.int64)
                if len(more) > len(seen):
                    seen = np.pad(seen, (0, len(more) - len(seen)))
                seen[: len(more)] += more
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(seen[used], pa.int64())], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r["id"] for r in rows], default=0) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write_token_files(docs: DataFrame, path: str, end_id: int = END_ID, tokenizer: str | None = None) -> None:
    """Write the data set of ``docs`` (doc_id, text) below ``path``."""
    spark = docs.sparkSession
    tokens = tokenised(docs, end_id, tokenizer)
    freq = frequency_table(id_counts(tokens))
    # one row per part
    totals = {r["part"]: r["n"] for r in tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    bases, total = {}, 0
    for part in sorted(totals):
        bases[part] = total
        total += totals[part]
    shared = spark.sparkContext.broadcast((freq, bases))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, bases = shared.value
        table, current = Table(freq), None
        waiting: list[tuple[object, np.ndarray]] = []
        size, start, following = 0, 0, 0

        def block():
            ids = np.concatenate([w[1] for w in waiting])
            columns = [
                pa.array([start], pa.int64()),
                pa.array([[w[0] for w in waiting]], doc_ids_type),
                pa.array([[len(w[1]) for w in waiting]], pa.list_(pa.int64())),
                pa.array([encode_block(ids, table)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["start", "doc_ids", "sizes", "payload"])

        for batch in batches:
            doc_ids_type = pa.list_(batch.schema.field("doc_id").type)
            for part, doc_id, before, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "before", "ids"))):
                # a block holds neighbours only
                if waiting and (part != current or before != following or size >= BLOCK_IDS):
                    yield block()
                    waiting, size = [], 0
                ids = unpack_ids(packed)
                if not waiting:
                    start = bases[part] + before
                waiting.append((doc_id, ids))
                current, following = part, before + len(ids)
                size += len(ids)
        if waiting:
            yield block()

    kind = dict(docs.dtypes)["doc_id"]
    blocks = tokens.select("part", "doc_id", "before", "ids").mapInArrow(code, f"start bigint, doc_ids array<{kind}>, sizes array<bigint>, payload binary")
    blocks.write.parquet(f"{path}/blocks")
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq) if f], "id bigint, frequency bigint").coalesce(1).write.parquet(f"{path}/frequencies")
    spark.createDataFrame([(end_id, total, len(freq))], "end_id bigint, ids bigint, id_space bigint").write.parquet(f"{path}/header")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids."""
    freq = np.zeros(spark.read.parquet(f"{path}/header").first()["id_space"], np.int64)
    for r in spark.read.parquet(f"{path}/frequencies").collect():
        freq[r["id"]] = r["frequency"]
    shared = spark.sparkContext.broadcast(freq)
    blocks = spark.read.parquet(f"{path}/blocks")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                sizes = np.array(one.column("sizes")[0].as_py(), np.int64)
                ids = decode_block(one.column("payload")[0].as_py(), table)
                bounds = np.append(0, np.cumsum(sizes))
                crcs = [crc_of(ids[a:b]) for a, b in zip(bounds, bounds[1:])]
                columns = [one.column("doc_ids").flatten(), pa.array(one.column("start")[0].as_py() + bounds[:-1]), pa.array(sizes), pa.array(crcs, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(blocks.dtypes)["doc_ids"][len("array<") : -1]
    return blocks.mapInArrow(decode, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)
