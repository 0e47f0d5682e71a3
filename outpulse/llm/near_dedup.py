"""Near-duplicate groups by MinHash signatures in the manner of an LSH forest.

A text's signature is several short ones, a tree of the forest each. Nothing is sorted: equal hashes of prefixes of fixed
lengths stand in for the order of a tree, and regions of it in which the shortest prefix is common give candidates.
A dense region is parted by longer prefixes until it is small. Candidates are confirmed on the full shingle sets, and
linked texts are joined to groups.

Texts with equal shingle sets are one text with copies from the start. Candidates are confirmed in rounds: each text with
the first one of its region, which joins most of what belongs together, again so in the parts of dense regions that still
hold more than one group; then the texts of a small region that are still in different groups with each other; at last, in
each dense region, the texts outside its largest group with all of the region, in blocks. The last round makes up for links
that longer prefixes part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outpulse.llm.common import ROW, as_bytes, light, numbered, written
from outpulse.llm.rolling import prefix_hashes, stretches

TREES = 20
#: Values of a tree's own signature. Behind them its order goes on with those of the next tree.
OWN_VALUES = 8
#: Prefix lengths that part a region, from sparse to dense ones, up to twice ``OWN_VALUES``.
DEPTHS = (4, 6, 8, 11, 14)
#: Texts of a region that are compared with each other; a larger one is parted by the next prefix length.
REGION = 64
#: Texts of each side that are compared in one task, on average, when a dense region is compared in blocks.
BLOCK = 128

_SIGNED_DDL = f"{ROW} bigint, doc_id bigint, n_shingles bigint, d0 bigint, d1 bigint, signature binary"


def shingles(text: bytes, words: int) -> np.ndarray:
    """Hashes of the distinct shingles in ascending order. A-Z count as a-z; a shorter text is one shingle."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    plain = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    stops = np.cumsum(lengths + 1) - 1
    starts = stops - lengths
    n = max(1, len(parts) - words + 1)
    sums = prefix_hashes(np.frombuffer(plain, np.uint8))
    return np.unique(stretches(sums, starts[:n], stops[min(words, len(parts)) - 1 :]))


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (factors[:, None] * hashes[None, at : at + 2048]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _sign_batches(words: int, trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors(trees * OWN_VALUES)
        for batch in batches:
            counts, digests, signatures = [], [], []
            for text in as_bytes(batch.column(2)):
                found = shingles(text, words)
                counts.append(len(found))
                digests.append(np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64))
                signatures.append(signature(found, factors).tobytes() if len(found) else None)
            d = np.array(digests, np.int64).reshape(-1, 2)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(signatures, pa.binary())],
                [ROW, "doc_id", "n_shingles", "d0", "d1", "signature"],
            )

    return run


def _forest_batches(trees: int):
    """A row per text and tree: hashes of the prefixes of each length, with the tree in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, trees, OWN_VALUES)
            values = np.concatenate([values, np.roll(values, -1, axis=1)], axis=2)
            key = np.broadcast_to(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (n, trees)).copy()
            prefixes = []
            for depth in range(DEPTHS[-1]):
                key = (key ^ values[:, :, depth]) * np.uint64(0xD6E8FEB86659FD93)
                key ^= key >> np.uint64(32)
                if depth + 1 in DEPTHS:
                    prefixes.append(pa.array(key.ravel().view(np.int64)))
            nodes = pa.array(np.repeat(batch.column(0).to_numpy(), trees))
            yield pa.record_batch([nodes, *prefixes], ["node", *(f"p{i}" for i in range(len(DEPTHS)))])

    return run


def _confirm_batches(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first_set = None, np.empty(0, np.uint64)
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            texts_a, texts_b = batch.column("text_a"), batch.column("text_b")
            keep = []
            for i, node in enumerate(a):
                # The rows of a text come together.
                if node != last:
                    last, first_set = node, shingles(texts_a[i].as_py().encode(), words)
                other = shingles(texts_b[i].as_py().encode(), words)
                common = len(first_set) + len(other) - len(np.union1d(first_set, other))
                keep.append(100 * common >= percent * (len(first_set) + len(other) - common))
            yield pa.record_batch(
                [pa.array([x for x, k in zip(a, keep) if k], pa.int64()), pa.array([x for x, k in zip(b, keep) if k], pa.int64())], ["a", "b"]
            )

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough. ``texts(row_no, text)`` is read where it is needed only."""
    pairs = written(pairs, "candidates")
    ends = written(pairs.select(F.col("a").alias(ROW)).union(pairs.select("b")).distinct(), "ends")
    wanted = texts.join(light(ends), ROW)
    first = wanted.select(F.col(ROW).alias("a"), F.col("text").alias("text_a"))
    second = wanted.select(F.col(ROW).alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(second, "b").join(first, "a").select("a", "b", "text_a", "text_b")
    return written(both.mapInArrow(_confirm_batches(words, percent), "a bigint, b bigint"), "links")


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for all nodes of ``links(a, b)`` but the roots: the smallest node that each one reaches.

    Large-star and small-star rounds until nothing changes. Each is a grouping and a join by node, so links of a
    frequent node are spread like those of any other skewed key.
    """
    edges = written(
        links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "edges"
    )
    before = None
    while True:
        both = edges.select(F.col("v").alias("u"), F.col("m").alias("w")).union(edges.select("m", "v"))
        least = written(both.groupBy("u").agg(F.min("w").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = both.join(least, "u").filter("w > u").select(F.col("w").alias("v"), "m").distinct()
        large = written(large, "edges")
        low = written(large.groupBy("v").agg(F.min("m").alias("least")), "least")
        hooked = large.join(low, "v")
        small = hooked.filter("m <> least").select(F.col("m").alias("v"), F.col("least").alias("m")).union(low)
        edges = written(small.distinct(), "edges")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.select(F.col("v").alias("node"), F.col("m").alias("root"))
        before = state


def _regions(forest: DataFrame, depth: int) -> DataFrame:
    """The rows that share a prefix of this depth with another text, with ``region``, its ``size`` and ``first`` text."""
    prefix, longer = f"p{depth}", [f"p{i}" for i in range(depth + 1, len(DEPTHS))]
    forest = forest.select("node", prefix, *longer)
    sizes = forest.groupBy(prefix).agg(F.count("*").alias("size"), F.min("node").alias("first")).filter("size > 1")
    # Written by itself, as Spark splits a frequent key only where both sides come from a shuffle of their own.
    found = forest.join(written(sizes, "region-sizes"), prefix)
    return written(found.select("node", F.col(prefix).alias("region"), "size", "first", *longer), "regions")


def _firsts(regions: list[DataFrame]) -> DataFrame:
    """Pairs of each text with the first one of its region."""
    pairs = [found.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")) for found in regions]
    return reduce(DataFrame.union, pairs).distinct()


def _mixed(rows: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """The rows of regions of more than one group, with their ``root``. A region of one group has nothing left to compare."""
    placed = written(rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    mixed = placed.groupBy("region").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("region")
    return written(placed.join(written(mixed, "mixed-regions"), "region"), name)


def _neighbours(regions: list[DataFrame], roots: DataFrame) -> DataFrame:
    """Pairs of texts of a small region that are in different groups so far."""
    small = reduce(DataFrame.union, [found.filter(F.col("size") <= REGION).select("node", "region") for found in regions])
    placed = _mixed(small, roots, "open-regions")
    other = placed.select("region", F.col("node").alias("b"), F.col("root").alias("root_b"))
    return placed.join(other, "region").filter("node < b and root <> root_b").select(F.col("node").alias("a"), "b").distinct()


def _block_links(words: int, percent: int):
    """A link from each text that stands apart to every other group of the block in which it has one."""

    def run(members: pa.Table, apart: pa.Table) -> pa.Table:
        sets = [shingles(t, words) for t in as_bytes(members.column("shard_text").combine_chunks())]
        lengths = np.array([len(x) for x in sets], np.int64)
        links: tuple[list[int], list[int]] = ([], [])
        if sets and len(apart):
            known, codes = np.unique(np.concatenate(sets), return_inverse=True)
            begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            nodes, roots = members.column("shard_node").to_numpy(), members.column("shard_root").to_numpy()
            own = zip(*(apart.column(f"block_{c}").to_pylist() for c in ("node", "root")), as_bytes(apart.column("block_text").combine_chunks()))
            for node, root, text in own:
                one = shingles(text, words)
                common = np.add.reduceat(np.isin(known, one, assume_unique=True)[codes], begins, dtype=np.int64)
                near = (100 * common >= percent * (lengths + len(one) - common)) & (roots != root)
                _, at = np.unique(roots[near], return_index=True)
                links[0].extend([node] * len(at))
                links[1].extend(nodes[near][at].tolist())
        return pa.table({"a": pa.array(links[0], pa.int64()), "b": pa.array(links[1], pa.int64())})

    return run


def _dense_links(regions: DataFrame, roots: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between groups that meet in a region of the shortest prefix with more than ``REGION`` texts.

    Both sides are dealt into blocks by number, so a task holds some ``BLOCK`` texts of each however large the region is.
    """
    dense = regions.filter(F.col("n0") > REGION).select("node", F.col("p0").alias("region"))
    placed = written(dense.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "dense-regions")
    per_group = placed.groupBy("region", "root").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark"))
    largest = per_group.groupBy("region").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"), F.sum("mark").alias("mark")
    )
    # Trees often part the same texts; a set of texts is compared once.
    once = largest.filter("n > most").groupBy("n", "mark").agg(F.min("region").alias("region"), F.min_by("main", "region").alias("main"), F.min("most").alias("most"))
    blocks = [F.ceil(F.col("n") / BLOCK).cast("int").alias("shards"), F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("blocks")]
    once = written(once.select("region", "main", *blocks), "mixed-regions")
    open_rows = written(placed.join(once, "region"), "open-dense-regions")
    if open_rows.isEmpty():
        return written(open_rows.select(F.col("node").alias("a"), F.col("root").alias("b")), "links")
    wanted = written(open_rows.select(F.col("node").alias(ROW)).distinct(), "ends")
    wanted = written(texts.join(light(wanted), ROW).select(F.col(ROW).alias("node"), "text"), "open-texts")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        place = F.pmod(F.xxhash64("node"), F.col(f"{own}s")).cast("int").alias(own)
        cells = rows.select("region", "node", "root", place, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other))
        full = cells.join(wanted, "node").select(*[F.col(c).alias(f"{own}_{c}") for c in ("region", "shard", "block", "node", "root", "text")])
        return full.groupBy(*full.columns[:3])

    members, apart = dealt(open_rows, "shard", "block"), dealt(open_rows.filter("root <> main"), "block", "shard")
    return written(members.cogroup(apart).applyInArrow(_block_links(words, percent), "a bigint, b bigint"), "links")


def grouped(docs: DataFrame, text: str = "text", words: int = 5, percent: int = 80, trees: int = TREES) -> DataFrame:
    """A row per row of ``docs(row_no, doc_id, text)``: ``row_no, doc_id, n_shingles, component_id, keeper``.

    ``component_id`` is the smallest id of the group and ``keeper`` the row number of that document, or the least one
    among rows that repeat the id. A null id counts as the largest. Null and empty texts have no shingles and stay
    alone. Only columns named here are read.
    """
    texts = docs.select(ROW, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    signed = written(texts.mapInArrow(_sign_batches(words, trees), _SIGNED_DDL), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", ROW)
    classes = written(
        signed.filter("n_shingles > 0")
        .groupBy("d0", "d1")
        .agg(F.min(ROW).alias("node"), F.min(order).alias("least"), F.count("*").alias("copies"), F.first("signature").alias("signature")),
        "classes",
    )
    prefixes = ", ".join(f"p{i} bigint" for i in range(len(DEPTHS)))
    regions = _regions(classes.select("node", "signature").mapInArrow(_forest_batches(trees), f"node bigint, {prefixes}"), 0)
    links = confirmed(_firsts([regions]), texts, words, percent)
    roots = components(links)
    # Only dense regions of more than one group are parted by longer prefixes.
    dense = _mixed(regions.filter(F.col("size") > REGION).drop("first"), roots, "dense-regions")
    parted, deeper = dense, []
    for depth in range(1, len(DEPTHS)):
        if parted.isEmpty():
            break
        deeper.append(_regions(parted, depth))
        parted = deeper[-1].filter(F.col("size") > REGION)
    rest = confirmed(_firsts(deeper), texts, words, percent) if deeper else links.limit(0)
    if not rest.isEmpty():
        links = links.union(rest)
        roots = components(links)
    rest = confirmed(_neighbours([regions, *deeper], roots), texts, words, percent)
    if not rest.isEmpty():
        links = links.union(rest)
        roots = components(links)
    rest = _dense_links(dense.select("node", F.col("region").alias("p0"), F.col("size").alias("n0")), roots, texts, words, percent)
    if not rest.isEmpty():
        roots = components(links.union(rest))
    placed = classes.select("d0", "d1", "node", "least", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = placed.groupBy("root").agg(F.min("least").alias("group_least"), F.sum("copies").alias("members")).filter("members > 1")
    of_class = placed.join(written(groups, "groups"), "root").select("d0", "d1", "group_least")
    return (
        signed.select(ROW, "doc_id", "n_shingles", "d0", "d1")
        .join(of_class, ["d0", "d1"], "left")
        .select(
            ROW,
            "doc_id",
            "n_shingles",
            F.when(F.col("group_least").isNull(), F.col("doc_id")).otherwise(F.col("group_least.doc_id")).alias("component_id"),
            F.coalesce(F.col(f"group_least.{ROW}"), F.col(ROW)).alias("keeper"),
        )
    )


def near_duplicates(docs: DataFrame, text: str = "text", words: int = 5, percent: int = 80, trees: int = TREES) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs(doc_id, text)``; see ``grouped``."""
    rows = numbered(docs.select("doc_id", F.col(text).alias("text")))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return grouped(rows, "text", words, percent, trees).select("doc_id", "n_shingles", "component_id", kept)
