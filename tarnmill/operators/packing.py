"""Fixed-size blocks cut from the concatenated ids of all files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmill.functions.arrays import cut, let
from tarnmill.markers import BLOCK_SIZE
from tarnmill.operators.prefix import running_total
from tarnmill.operators.splits import SEED


def pack_blocks(
    dataset: DataFrame,
    block_size: int = BLOCK_SIZE,
    fraction: float = 1.0,
    epoch: int = 0,
    seed: str = SEED,
    key: str = "file_id",
) -> DataFrame:
    """``block_id, input_ids`` of ``block_size`` ids each; labels equal the ids.

    Files are concatenated in key order, or, for ``epoch`` > 0, in an order seeded by
    the epoch. The first ``floor(fraction * total)`` ids are kept and the incomplete
    last block is dropped. A file emits one slice per block that it touches, so a large
    file spreads over many tasks and a block collects at most ``block_size`` slices.
    """
    files = dataset.select(key, "ids").where(F.size("ids") > 0)
    length = F.size("ids")
    if epoch == 0:
        placed = running_total(files, [key], {"start": length})
    else:
        order = F.md5(F.concat_ws(":", F.lit(seed), F.lit(epoch), F.col(key).cast("string")))
        placed = running_total(files.withColumn("order_key", order), ["order_key", key], {"start": length})
    kept = dataset.agg(F.floor(F.coalesce(F.sum(length), F.lit(0)) * F.lit(fraction)).alias("n")).scalar()
    usable = kept - F.pmod(kept, F.lit(block_size))

    bounded = placed.withColumn("stop", F.least(F.col("start") + length, usable)).where(F.col("start") < F.col("stop"))

    def slices_of(file: Column) -> Column:
        first = F.floor(file["start"] / block_size)
        last = F.floor((file["stop"] - 1) / block_size)

        def slice_of(block: Column) -> Column:
            low = F.greatest(file["start"], block * block_size)
            high = F.least(file["stop"], (block + 1) * block_size)
            part = cut(file["ids"], (low - file["start"]).cast("int"), (high - file["start"]).cast("int"))
            return F.struct(block.alias("block_id"), low.alias("at"), part.alias("part"))

        return F.transform(F.sequence(first, last), slice_of)

    slices = bounded.select(F.inline(let(F.struct("ids", "start", "stop"), slices_of)))
    gathered = slices.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))
    return gathered.select("block_id", F.flatten(F.transform("parts", lambda p: p["part"])).alias("input_ids"))
