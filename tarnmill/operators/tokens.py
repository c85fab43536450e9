"""Token data sets: framing, piece ids and decoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnmill.markers import BEGIN_FILE, CONTROL_IDS, END_FILE, END_LINE, UNKNOWN, WORD_START, reserved_symbols
from tarnmill.operators.skew import hot_keys, join_on_skewed_key
from tarnmill.session import stored

# So many pieces of a vocabulary are sent to every task; the rest of a larger one is joined.
MAX_SENT_PIECES = 1 << 20


def reserved_table(spark, num_reserved: int = 0) -> DataFrame:
    """Symbols with fixed ids: ``piece, id``."""
    rows = [(piece, i) for i, piece in enumerate(reserved_symbols(num_reserved))]
    return spark.createDataFrame(rows, "piece string, id int")


def frame_lines(lines: Column) -> Column:
    """One token array per file: begin, the pieces of each line and an end of line, end."""
    body = F.flatten(F.transform(lines, lambda line: F.concat(line, F.array(F.lit(END_LINE)))))
    return F.concat(F.array(F.lit(BEGIN_FILE)), body, F.array(F.lit(END_FILE)))


def frame_files(files: DataFrame, lines: str = "lines") -> DataFrame:
    """Replace ``lines`` (arrays of pieces) by ``tokens``; files without lines go."""
    kept = files.where(F.size(lines) > 0)
    return kept.withColumn("tokens", frame_lines(F.col(lines))).drop(lines)


def _offsets(batch: pa.Array) -> pa.Array:
    """Where each list begins once all are laid end to end; a null list is empty."""
    lengths = pc.fill_null(pc.list_value_length(batch), 0)
    return pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(lengths.cast(pa.int64()))]).cast(pa.int32())


def _spark_type(values: pa.Array) -> T.DataType:
    return T.IntegerType() if pa.types.is_integer(values.type) else T.StringType()


def _list_lookup(keys: pa.Array, values: pa.Array, missing) -> Callable[[Column], Column]:
    """Arrow function that maps the elements of string or int lists through a table."""
    held = {"keys": keys, "values": values}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = pc.index_in(batch.flatten(), value_set=held["keys"])
            yield pa.ListArray.from_arrays(_offsets(batch), pc.fill_null(pc.take(held["values"], found), missing))

    return F.arrow_udf(run, T.ArrayType(_spark_type(values))).asNondeterministic()


def _partial_lookup(keys: pa.Array, values: pa.Array, missing) -> Callable[[Column], Column]:
    """As ``_list_lookup``, with the places (``at``) and keys (``rest``) that the table lacks."""
    held = {"keys": keys, "values": values}
    fields = [("found", _spark_type(values)), ("at", T.IntegerType()), ("rest", _spark_type(keys))]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat, offsets = batch.flatten(), _offsets(batch)
            found = pc.index_in(flat, value_set=held["keys"])
            starts = offsets.to_numpy()
            place = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
            row = np.searchsorted(starts, place, "right") - 1
            ends = pa.array(np.searchsorted(place, starts).astype(np.int32))
            lists = [
                pa.ListArray.from_arrays(offsets, pc.fill_null(pc.take(held["values"], found), missing)),
                pa.ListArray.from_arrays(ends, pa.array((place - starts[row]).astype(np.int32))),
                pa.ListArray.from_arrays(ends, flat.take(pa.array(place))),
            ]
            yield pa.StructArray.from_arrays(lists, [name for name, _ in fields])

    schema = T.StructType([T.StructField(name, T.ArrayType(kind)) for name, kind in fields])
    return F.arrow_udf(run, schema).asNondeterministic()


def _patched(kind: T.DataType) -> Callable[[Column, Column, Column], Column]:
    """Arrow function that puts values into lists at their places."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lists, places, values in batches:
            flat, offsets, new = lists.flatten(), _offsets(lists), values.flatten()
            counts = np.diff(_offsets(places).to_numpy())
            at = places.flatten().to_numpy() + np.repeat(offsets.to_numpy()[:-1], counts)
            index = np.arange(len(flat))
            index[at] = len(flat) + np.arange(len(new))
            both = pa.concat_arrays([flat, new.cast(flat.type)])
            yield pa.ListArray.from_arrays(offsets, both.take(pa.array(index)))

    return F.arrow_udf(run, T.ArrayType(kind)).asNondeterministic()


def _sent(vocab: DataFrame) -> tuple[pa.Table, DataFrame | None]:
    """What is sent of a vocabulary, and the rest, if there is any: all of a small one, otherwise
    the lowest ids, which vocabularies give to the most frequent pieces."""
    table = vocab.select("piece", F.col("id").cast("int"))
    if table.limit(MAX_SENT_PIECES + 1).count() <= MAX_SENT_PIECES:
        return table.toArrow(), None
    low = F.col("id").between(0, MAX_SENT_PIECES - 1)
    return table.where(low).toArrow(), table.where(~low)


def _map_elements(df: DataFrame, column: str, out: str, vocab: DataFrame, key: str, value: str, missing, drop: Sequence[str]) -> DataFrame:
    """Map array elements through a vocabulary and leave out the columns in ``drop``.

    Elements outside the part that is sent, few by their frequency, are joined with the
    rest of the vocabulary and put back into their rows. Among them, those that hold more than
    their share of the places are counted first; their rows are spread and the table repeats
    only them.
    """
    rows, rest = _sent(vocab)
    keys, values = (rows[c].combine_chunks().cast(pa.int32() if c == "id" else pa.string()) for c in (key, value))
    if rest is None:
        return df.withColumn(out, _list_lookup(keys, values, missing)(F.col(column))).drop(*drop)
    kept = [c for c in df.columns if c not in drop and c != out]
    looked = df.select(*kept, F.monotonically_increasing_id().alias("__row"), _partial_lookup(keys, values, missing)(F.col(column)).alias("__l"))
    # the row numbers must not change between the readings below
    tagged = stored(looked.select(*kept, "__row", "__l.*"), "looked")
    parts = tagged.where(F.size("at") > 0).select("__row", F.inline(F.arrays_zip(F.col("at").alias("__at"), F.col("rest").alias(key))))
    hot = [found for found in hot_keys(parts.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "n") if found is not None]
    mapped = join_on_skewed_key(parts, rest, key, "__row", hot).groupBy("__row").agg(F.collect_list(F.struct("__at", value)).alias("__m"))
    joined = tagged.select(*kept, "__row", "found").join(mapped, "__row", "left")
    lists = [F.coalesce(F.transform("__m", lambda m: m[c]), F.array().cast(f"array<{kind}>")) for c, kind in (("__at", "int"), (value, dict(rest.dtypes)[value]))]
    return joined.select(*kept, "found", *[c.alias(name) for c, name in zip(lists, ("__places", "__values"))]).select(
        *kept, _patched(_spark_type(values))(F.col("found"), F.col("__places"), F.col("__values")).alias(out)
    )


def pieces_to_ids(df: DataFrame, vocab: DataFrame, column: str = "tokens", out: str = "ids", drop: Sequence[str] = ()) -> DataFrame:
    """Add the ids of an array of pieces; unknown pieces get the unknown id. Columns in
    ``drop`` are left out, which spares their way through a join."""
    return _map_elements(df, column, out, vocab, "piece", "id", CONTROL_IDS[UNKNOWN], drop)


def ids_to_pieces(df: DataFrame, vocab: DataFrame, column: str = "ids", out: str = "tokens", drop: Sequence[str] = ()) -> DataFrame:
    """Add the pieces of an array of ids; ids outside the vocabulary become unknown."""
    return _map_elements(df, column, out, vocab, "id", "piece", UNKNOWN, drop)


def decode_pieces(pieces: Column) -> Column:
    """Text of an array of pieces."""
    return F.trim(F.replace(F.array_join(pieces, ""), F.lit(WORD_START), F.lit(" ")))


def decode_lines(pieces: Column, num_reserved: int = 0) -> Column:
    """Lines of words of an array of pieces, with every reserved symbol as a word."""
    symbols = reserved_symbols(num_reserved)
    spaced = F.transform(
        pieces, lambda p: F.when(p.isin(symbols), F.concat(F.lit(WORD_START), p, F.lit(WORD_START))).otherwise(p)
    )
    lines = F.split(F.replace(F.array_join(spaced, ""), F.lit(WORD_START), F.lit(" ")), END_LINE)
    return F.transform(lines, lambda line: F.filter(F.split(line, " "), lambda word: word != ""))
