"""Conflict-constrained best-fit packing of texts into bins of CAPACITY bytes.

Texts longer than a bin are cut into full bins and a rest; pieces and texts are what is packed. Each open bin carries its
residual and what it holds: a bitmap of duplicate clusters (no two texts of one cluster in a bin) and one of sources,
in planes (at most PER_SOURCE texts of one source). Open bins are ordered by residual. An item goes to the tightest bin
that is compatible: the search starts at the least residual that holds it and goes on to the next larger one, past
bins with conflicts, until it finds one, else a new bin opens. Items come in descending size.

Rows are dealt to shards of about SHARD_ITEMS items by hash of doc_id and text, so neither a hot source nor a group of
copies gathers in one; each shard is packed alone. What is left open there, under REPACK full, is dealt and
packed once more, as many shards' leftovers together as make a shard, so that a shard's end costs nothing at scale. Only ids, sizes,
sources and cluster hashes move, never texts.

Defined results: a null text counts as empty; empty texts take no room and conflict with nothing, so they open no bins of
their own where another is open. Null sources are one source. Repeated rows are items of one cluster. An empty table gives an empty table. Whole texts are packed: the pieces
of a text, in order, are all of it.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

CAPACITY = 32_768
PER_SOURCE = 8
SHARD_ITEMS = 20_000
REPACK = 0.97

_PACKED = "shard long, bin long, slot int, offset long, doc_id long, piece int, start long, size long, source_hash long, cluster long, fill long"


class Bins:
    """Open bins in order of residual."""

    def __init__(self, capacity: int = CAPACITY, per_source: int = PER_SOURCE):
        self.capacity, self.per_source = capacity, per_source
        self.open: list[tuple[int, int]] = []  # (residual, bin)
        self.fill: list[int] = []
        self.count: list[int] = []
        self.sources: list[list[int]] = []  # planes: bit s of plane k says that the bin has more than k texts of source s
        self.clusters: list[int] = []
        self._source_bit: dict[int, int] = {}
        self._cluster_bit: dict[int, int] = {}

    def source_bit(self, source: int) -> int:
        return 1 << self._source_bit.setdefault(source, len(self._source_bit))

    def cluster_bit(self, cluster: int | None) -> int:
        """Clusters of one item can't conflict and get no bit."""
        return 0 if cluster is None else 1 << self._cluster_bit.setdefault(cluster, len(self._cluster_bit))

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bitmaps of one source and of one cluster or none -> (bin, offset in it)."""
        top = self.per_source - 1
        at = bisect_left(self.open, (size, -1))
        while at < len(self.open):  # the successor: the next larger residual
            b = self.open[at][1]
            if not (self.sources[b][top] & source or self.clusters[b] & cluster):
                residual = self.open.pop(at)[0] - size
                break
            at += 1
        else:
            b, residual = len(self.fill), self.capacity - size
            self.fill.append(0)
            self.count.append(0)
            self.sources.append([0] * self.per_source)
            self.clusters.append(0)
        offset = self.fill[b]
        self.fill[b] += size
        self.count[b] += 1
        self.clusters[b] |= cluster
        planes = self.sources[b]
        for k in range(self.per_source if source else 0):
            if not planes[k] & source:
                planes[k] |= source
                break
        if residual > 0:
            insort(self.open, (residual, b))
        return b, offset


def pack(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int = CAPACITY, per_source: int = PER_SOURCE, empty_conflict: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bin, slot and offset of each item, and each bin's fill. Items are taken by size, largest first, ties as they come.
    empty_conflict: whether items without any size count for sources and clusters as others do."""
    bins = Bins(capacity, per_source)
    _, number, times = np.unique(clusters, return_inverse=True, return_counts=True)
    several = (times > 1)[number].tolist()
    where, slot, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    size, source, cluster = sizes.tolist(), sources.tolist(), number.tolist()
    for i in np.argsort(-sizes, kind="stable").tolist():
        b, at = bins.put(size[i], bins.source_bit(source[i]), bins.cluster_bit(cluster[i] if several[i] else None)) if size[i] or empty_conflict else bins.put(0, 0, 0)
        where[i], offset[i], slot[i] = b, at, bins.count[b] - 1
    return where, slot, offset, np.array(bins.fill, np.int64)


def _pack_group(capacity: int, per_source: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = np.lexsort([table.column(c).to_numpy() for c in ("start", "cluster")] + [table.column("doc_id").fill_null(-(1 << 63)).to_numpy()])
        table = table.take(pa.array(order))
        where, slot, offset, fill = pack(table.column("size").to_numpy(), table.column("source_hash").to_numpy(), table.column("cluster").to_numpy(), capacity, per_source, empty_conflict=False)
        shard = pa.array(np.full(len(where), key[0].as_py(), np.int64))
        columns = [shard, pa.array(where), pa.array(slot.astype(np.int32)), pa.array(offset), *(table.column(c) for c in ("doc_id", "piece", "start", "size", "source_hash", "cluster")), pa.array(fill[where] if len(where) else where)]
        return pa.table(columns, names=["shard", "bin", "slot", "offset", "doc_id", "piece", "start", "size", "source_hash", "cluster", "fill"])

    return run


def items_of(docs: DataFrame, capacity: int = CAPACITY, cluster: str | None = None) -> DataFrame:
    """The items: a text of n bytes gives n // capacity full pieces and a rest; made in the JVM. cluster: as pack_documents has it."""
    text = text_of(docs)
    group = F.xxhash64(F.lower(text))
    if cluster is not None:
        group = F.when(docs[cluster].isNull(), group).otherwise(F.xxhash64(F.lit("class"), docs[cluster].cast("string")))
    one = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n"), F.xxhash64(F.coalesce(docs["source"].cast("string"), F.lit("\0"))).alias("source_hash"), group.alias("cluster"))
    pieces = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity).cast("int") - 1, F.lit(0)))).alias("piece")
    start = (F.col("piece") * capacity).cast("long")
    return one.select("doc_id", pieces, "n", "source_hash", "cluster").select("doc_id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(capacity)).cast("long").alias("size"), "source_hash", "cluster")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_items: int = SHARD_ITEMS, cluster: str | None = None) -> DataFrame:
    """One row per piece: bin_id, slot (order in the bin), offset (bytes before it), doc_id, piece, start, size (in bytes of
    the text), bin_fill. cluster: a column of docs that tells their duplicate clusters, such as the n-gram join's class_id;
    without one, or where it is null, texts that are equal but for case are a cluster."""
    items = written(items_of(docs, capacity, cluster), "items")
    full = items.where(F.col("size") >= capacity)  # these fill a bin by themselves
    rest = items.where(F.col("size") < capacity)
    shards = max(1, -(-rest.count() // shard_items))
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "piece"), F.lit(shards)))
    packed = written(dealt.groupBy("shard").applyInArrow(_pack_group(capacity, per_source), _PACKED), "packed")
    done = packed.where(F.col("fill") >= REPACK * capacity)
    left = packed.where(F.col("fill") < REPACK * capacity)
    groups = max(1, -(-left.count() // shard_items))
    again = left.withColumn("shard", F.pmod(F.xxhash64("cluster", "doc_id", "piece"), F.lit(groups))).select("doc_id", "piece", "start", "size", "source_hash", "cluster", "shard").groupBy("shard").applyInArrow(_pack_group(capacity, per_source), _PACKED)
    name = lambda level: F.concat(F.lit(level), F.col("shard").cast("string"), F.lit("-"), F.col("bin").cast("string"))
    columns = ["slot", "offset", "doc_id", "piece", "start", "size", F.col("fill").alias("bin_fill")]
    alone = full.select(F.concat(F.lit("f"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("-"), F.hex("cluster"), F.lit("-"), F.col("piece").cast("string"), F.lit("-"), F.monotonically_increasing_id().cast("string")).alias("bin_id"), F.lit(0).alias("slot"), F.lit(0).cast("long").alias("offset"), "doc_id", "piece", "start", "size", F.col("size").alias("bin_fill"))
    return done.select(name("a").alias("bin_id"), *columns).unionByName(again.select(name("b").alias("bin_id"), *columns)).unionByName(alone)
