"""Near-duplicate documents by BagMinHash over weighted shingles.

A document is the multiset of its five-word shingles. A weight is discretised into the
unit steps below it, grouped in dyadic ranges (0,1], (1,2], (2,4], ...; every shingle runs one
Poisson process per range. A range wholly below the weight takes part as it is; the range
that the weight cuts is split in half again and again, each point falling to one half by
its own random bits, and only points below the weight stay. The earliest point in each of ``SLOTS`` slots is
the signature, so two signatures agree in a slot with probability sum(min) / sum(max).
Points later than a document can need are never drawn: the work is about one
draw per shingle plus ``SLOTS`` log ``SLOTS`` per document.

Then, with every step on classes of equal multisets instead of their copies:

1. ``BANDS`` bands of ``ROWS`` slots put classes in buckets; members are linked to the
   smallest id of their bucket, which is a pair for each member and not for each two.
2. Pairs are verified exactly by multiset overlap, and links are joined to components.
3. Within each bucket the components' smallest members are linked to the bucket's first,
   verified and joined again.
4. Buckets that still hold different components are joined to groups, and each group is
   compared completely, block by block inside tasks that return only links between
   different components. So no link between documents sharing a bucket is lost, and pairs
   are never written out. This last step compares all texts of a group: its work grows with the square of a
   group whose texts are alike but below the threshold.

The chance that a pair of similarity 0.8 shares no bucket is about 1 in 10,000, less above.

Result: one row per row of ``docs``: doc_id, class_id (the smallest id of its class, null if
no row of it has one) and n_shingles. Words are runs of code points outside
space and U+0009 to U+000D; texts of one to four words are one shingle. Null, empty and
wordless texts have no shingles and stay a class of their own. Rows are compared by row numbers: repeated
rows each keep a row, different texts under one id are compared apart, and rows with a null id like
any other. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.common import bytes_of, chunks, mixed, NOT_SPACE, small, span_hashes, staged, U64, window_hashes, with_ids, word_bounds

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
SLOTS = BANDS * ROWS
# size of a block in the complete comparison of a group
BLOCK_ROWS, BLOCK_ELEMENTS = 512, 400_000


# ---------------------------------------------------------------- shingles


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle and its row, rows ascending."""
    data, bounds = bytes_of(column)
    starts, stops, rows = word_bounds(data, bounds, NOT_SPACE)
    words = span_hashes(data, starts, stops)
    n = np.bincount(rows, minlength=len(column))
    long_windows = window_hashes(words, WIDTH)
    inside = np.flatnonzero(rows[: len(long_windows)] == rows[WIDTH - 1 :]) if len(long_windows) else np.zeros(0, int)
    hashes, owners = long_windows[inside], rows[inside]
    short = np.flatnonzero((n > 0) & (n < WIDTH))
    if len(short):
        first = np.cumsum(n) - n
        extra = np.array([mixed(np.array([np.bitwise_xor.reduce(mixed(words[first[r] : first[r] + n[r]] + np.arange(n[r], dtype=np.uint64)))], np.uint64))[0] for r in short], np.uint64)
        hashes, owners = np.concatenate([hashes, extra]), np.concatenate([owners, short])
        order = np.argsort(owners, kind="stable")
        hashes, owners = hashes[order], owners[order]
    return hashes, owners


def weighted(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles per row with their counts, ordered by row and hash."""
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    fresh = np.append(True, (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])) if len(hashes) else np.zeros(0, bool)
    at = np.flatnonzero(fresh)
    return hashes[at], owners[at], np.diff(np.append(at, len(hashes)))


def multisets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(elements, bounds): each row's multiset as distinct values, the k-th copy of a shingle
    being a value of its own, so that plain intersections count copies."""
    hashes, owners, counts = weighted(*shingles(column))
    again = np.repeat(np.arange(len(hashes)), counts)
    first = np.cumsum(counts) - counts
    copy = (np.arange(len(again)) - np.repeat(first, counts)).astype(np.uint64)
    elements = np.where(copy == 0, hashes[again], mixed(hashes[again] ^ mixed(copy)))
    sizes = np.bincount(owners[again], minlength=len(column))
    return elements, np.append(0, np.cumsum(sizes))


# ---------------------------------------------------------------- BagMinHash


def uniform(bits: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1] from 64 random bits."""
    return ((bits >> U64(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(hashes: np.ndarray, owners: np.ndarray, counts: np.ndarray, n_rows: int) -> np.ndarray:
    """``SLOTS`` values per row (rows without shingles: zeros)."""
    total = np.bincount(owners, weights=counts, minlength=n_rows)
    values = np.zeros((n_rows, SLOTS), np.uint64)
    waiting = np.flatnonzero(total > 0)
    horizon = np.zeros(n_rows)
    horizon[waiting] = SLOTS * (np.log(SLOTS) + 4) / total[waiting]
    while len(waiting):
        use = np.zeros(n_rows, bool)
        use[waiting] = True
        mine = np.flatnonzero(use[owners])
        found, filled = points(hashes[mine], owners[mine], counts[mine], horizon, n_rows)
        done = waiting[filled[waiting]]
        values[done] = found[done]
        waiting = waiting[~filled[waiting]]
        horizon[waiting] *= 2
    return values


def points(hashes: np.ndarray, owners: np.ndarray, counts: np.ndarray, horizon: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The earliest point of every slot up to each row's horizon, and rows with all slots hit."""
    when, slot_of, value = [], [], []
    level = 0
    part = np.arange(len(hashes))
    while len(part):
        # the range (low, low + width] of weights: (0,1], (1,2], (2,4], ...
        low, width = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
        part = part[counts[part] > low]
        state = mixed(hashes[part] ^ mixed(np.full(len(part), level + 1, np.uint64)))
        active, time = part, np.zeros(len(part))
        while len(active):
            state = mixed(state)
            time = time - np.log(uniform(state)) / width
            early = time <= horizon[owners[active]]
            active, state, time = active[early], state[early], time[early]
            if not len(active):
                break
            bits = mixed(state ^ U64(0x5851F42D4C957F2D))
            # halving the range bit by bit ends at one unit step; it counts if it lies below the weight
            step = low + ((bits >> U64(32)) & U64(width - 1)).astype(np.int64)
            inside = step < counts[active]
            place = ((bits & U64(0xFFFFFFFF)) * U64(SLOTS)) >> U64(32)
            when.append(time[inside])
            slot_of.append(owners[active][inside] * SLOTS + place[inside].astype(np.int64))
            value.append(bits[inside])
        level += 1
    values = np.zeros(n_rows * SLOTS, np.uint64)
    hit = np.zeros(n_rows * SLOTS, bool)
    if when:
        when, slot_of, value = (np.concatenate(x) for x in (when, slot_of, value))
        # later points first, so that each slot's earliest point is written last
        order = np.argsort(-when, kind="stable")
        values[slot_of[order]], hit[slot_of] = value[order], True
    return values.reshape(n_rows, SLOTS), hit.reshape(n_rows, SLOTS).all(axis=1)


def bands(signature: np.ndarray) -> np.ndarray:
    """``BANDS`` bucket numbers per row."""
    out = np.zeros((len(signature), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(signature), band + 1, np.uint64)
        for k in range(ROWS):
            key = mixed(key ^ signature[:, band * ROWS + k])
        out[:, band] = key
    return out


def digests(elements: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """A 128-bit digest of every multiset; no elements: null."""
    raw = memoryview(np.ascontiguousarray(elements)).cast("B") if len(elements) else b""
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(bounds.tolist(), bounds[1:].tolist())]


def sketched(docs: DataFrame) -> DataFrame:
    """Stored (doc_id, digest, n_shingles, bands) per row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            text = part.column("text")
            hashes, owners, counts = weighted(*shingles(text))
            elements, bounds = multisets(text)
            buckets = bands(signatures(hashes, owners, counts, len(text))).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, buckets.size + 1, BANDS), pa.int32()), pa.array(buckets.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(digests(elements, bounds), pa.binary()), pa.array(np.diff(bounds)), lists], ["doc_id", "digest", "n_shingles", "bands"])

    texts = docs.select("doc_id", "text")
    return staged(texts.mapInArrow(sketch, "doc_id bigint, digest binary, n_shingles bigint, bands array<bigint>"), "sketches")


# ---------------------------------------------------------------- links


class Verifier:
    """Exact multiset overlap of pairs of class representatives (a, b)."""

    def __init__(self, docs: DataFrame):
        self.docs = docs.select("doc_id", "text")

    def elements(self, ids: DataFrame) -> DataFrame:
        """Stored (node, elements) of the given representatives."""

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in chunks(batches):
                values, bounds = multisets(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["node", "elements"])

        wanted = with_ids(self.docs, ids.select(F.col("node").alias("doc_id")))
        found = wanted.mapInArrow(gather, "node bigint, elements array<bigint>")
        return staged(found.select("node", "elements"), "elements")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The stored pairs (a, b) that are similar enough."""
        ids = staged(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "pair-nodes")
        elements = self.elements(ids)
        left = elements.select(F.col("node").alias("a"), F.col("elements").alias("of_a"))
        right = elements.select(F.col("node").alias("b"), F.col("elements").alias("of_b"))
        both = F.size(F.array_intersect("of_a", "of_b"))
        # both >= 0.8 * (|a| + |b| - both), in whole numbers
        similar = both * 9 >= (F.size("of_a") + F.size("of_b")) * 4
        return staged(pairs.join(right, "b").join(left, "a").where(similar).select("a", "b"), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of the nodes of the stored links (a, b): the smallest node reachable.

    Every round hooks each node to its smallest smaller neighbour, follows the hooks to
    their roots and contracts the links to those between roots, which soon leaves none.
    """
    first = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    edges, steps = staged(first, "edges"), []
    while not edges.isEmpty():
        hooks = staged(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")), "hooks")
        moved = True
        while moved:
            up = hooks.select(F.col("node").alias("label"), F.col("label").alias("root"))
            jumped = staged(hooks.join(up, "label", "left").select("node", F.coalesce("root", "label").alias("label"), "root"), "hooks")
            moved = not jumped.where("root is not null").isEmpty()
            hooks = jumped.select("node", "label")
        steps.append(hooks)
        low = hooks.select(F.col("node").alias("a"), F.col("label").alias("x"))
        high = hooks.select(F.col("node").alias("b"), F.col("label").alias("y"))
        ends = edges.join(low, "a", "left").join(high, "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
        edges = staged(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    labels = nodes.withColumn("label", F.col("node"))
    for step in steps:
        labels = labels.join(step.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    return staged(labels, "labels")


def open_rows(shared: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """Stored (bucket, node, n, label, head) of the buckets that hold different components."""
    placed = shared.join(labels, "node", "left").select("bucket", "node", "n", "head", F.coalesce("label", "node").alias("label"))
    several = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
    return staged(placed.join(several, "bucket"), name)


def block_links(rows: DataFrame, nodes: DataFrame, verifier: Verifier) -> DataFrame:
    """Links (a, b) that join the components of each group of open buckets."""
    groups = components(rows.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct())
    members = staged(rows.select("node", "n", "label").distinct().join(groups.withColumnRenamed("label", "of"), "node"), "open-groups")
    sizes = members.groupBy("of").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_ROWS, F.col("total") / BLOCK_ELEMENTS)).cast("int")
    placed = members.join(sizes.select("of", blocks.alias("blocks")), "of").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    full = placed.join(nodes.select("node", "bands"), "node").join(verifier.elements(members.select("node")), "node")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = full.select("of", "node", "label", "block", "bands", "elements", other)
    keyed = spread.select("of", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "label", "block", "bands", "elements")
    return keyed.groupBy("of", "i", "j").applyInArrow(compare_blocks, "a bigint, b bigint")


def compare_blocks(table: pa.Table) -> pa.Table:
    """Links between the components of two blocks: one for each two components at most."""
    i, j = table.column("i")[0].as_py() if table.num_rows else 0, table.column("j")[0].as_py() if table.num_rows else 0
    node, label, block = (table.column(c).to_numpy() for c in ("node", "label", "block"))
    bands_of = np.array(table.column("bands").to_pylist(), np.int64).reshape(-1, BANDS)
    lists = table.column("elements").combine_chunks()
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    size = np.diff(offsets)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    # elements of the right block, each with its row
    spots = np.concatenate([np.arange(offsets[r], offsets[r + 1]) for r in right]) if len(right) else np.zeros(0, int)
    owner = np.repeat(np.arange(len(right)), size[right])
    order = np.argsort(flat[spots], kind="stable")
    values, owner = flat[spots][order], owner[order]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for r in left:
        fits = (label[right] != label[r]) & (size[right] * 5 >= size[r] * 4) & (size[r] * 5 >= size[right] * 4)
        fits &= (bands_of[right] == bands_of[r]).any(axis=1)
        if not fits.any():
            continue
        own = flat[offsets[r] : offsets[r + 1]]
        begin, end = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        counts = end - begin
        hits = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        both = np.bincount(owner[hits], minlength=len(right))
        for k in np.flatnonzero(fits & (both * 9 >= (size[right] + size[r]) * 4)):
            x, y = find(int(label[r])), find(int(label[right[k]]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append(sorted((int(node[r]), int(node[right[k]]))))
    return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, class_id, n_shingles.

    Rows are compared by row numbers, so rows with one id may hold different texts and rows without
    an id are compared like any other. ``class_id`` is the smallest id of the class, null if
    none of its rows has one.
    """
    numbered = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = staged(numbered, "rows")
    found = staged(classes_of_rows(rows.select(F.col("row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "row"), "row-classes")
    placed = staged(rows.select("row", "doc_id").join(found, "row"), "placed")
    named = staged(placed.groupBy("class_id").agg(F.min("doc_id").alias("name")), "class-names")
    return placed.join(small(named), "class_id").select("doc_id", F.col("name").alias("class_id"), "n_shingles")


def classes_of_rows(docs: DataFrame) -> DataFrame:
    """The same for rows whose ids are unique and not null (doc_id bigint, text)."""
    sketches = sketched(docs)
    with_text = sketches.where(F.col("digest").isNotNull())
    # a class of equal multisets, known by its smallest id; copies are counted per task first
    nodes = staged(with_text.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "nodes")
    members = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    heads = members.groupBy("bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket", "head")
    # only members of shared buckets go on
    shared = staged(members.join(heads, "bucket"), "shared-buckets")
    verifier = Verifier(docs)

    def fitting(pairs: DataFrame) -> DataFrame:
        # sizes alone rule out a similarity of 0.8
        return pairs.where("na * 5 >= nb * 4 and nb * 5 >= na * 4").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    sizes = nodes.select(F.col("node").alias("head"), F.col("n").alias("nb"))
    stars = shared.where("node <> head").select(F.col("node").alias("a"), "head", F.col("n").alias("na")).distinct()
    tried = staged(fitting(stars.join(sizes, "head").withColumnRenamed("head", "b")), "pairs-1")
    links = verifier.links(tried)

    # the smallest member of each component in a bucket, linked to the bucket's smallest
    rows = open_rows(shared, components(links), "open-2")
    firsts = rows.groupBy("bucket", "label").agg(F.min(F.struct("node", "n")).alias("first")).select("bucket", "first.*")
    first = firsts.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("other"))
    met = firsts.join(first, "bucket").where("node <> other.node")
    pairs = met.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("other.node").alias("b"), F.col("other.n").alias("nb"))
    new = staged(fitting(pairs).join(tried, ["a", "b"], "left_anti"), "pairs-2")
    if not new.isEmpty():
        links = staged(links.unionByName(verifier.links(new)), "links-2")
        rows = open_rows(shared, components(links), "open-3")
    if not rows.isEmpty():
        links = staged(links.unionByName(block_links(rows, nodes, verifier)), "links-3")
    of_node = nodes.select("digest", "node").join(components(links), "node", "left")
    classes = of_node.select("digest", F.coalesce("label", "node").alias("class_id"))
    known = with_text.select("doc_id", "digest", "n_shingles").join(classes, "digest").select("doc_id", "class_id", "n_shingles")
    wordless = sketches.where(F.col("digest").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), "n_shingles")
    return known.unionByName(wordless)
