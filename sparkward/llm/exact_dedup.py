"""Exact dedup by content-defined chunk recipes.

Texts are equal when identical after lower-casing A-Z. Each text is cut where a rolling hash of its last 32 bytes
says so, so equal stretches give equal chunks wherever they stand. A chunk gets a 64-bit identifier, which is verified
with SHA-256 over the whole table: if one identifier stands for two contents, those contents get further identifiers.
A text is then its recipe, the ordered list of verified identifiers, and whole recipes are compared, element by
element. Only recipes move between executors (some 8 bytes for 2 KB of text), never the texts.

Defined results: a null text counts as empty, and all empty texts are equal. Of equal rows the one with the largest
doc_id stays (a null doc_id is the smallest); if the very same doc_id and text come repeatedly, exactly one of these
rows stays. An empty table gives an empty table. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, ids_and_text, join_spread, keep_rows, shielded, written

WINDOW = 32
MASK = np.uint32((1 << 11) - 1 << 16)  # a cut every 2 KB on average
LONGEST = 1 << 16  # a longer stretch without a cut is cut at multiples of this length

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)

_SCHEMA = "uid long, doc_id long, text_sha256 string, raw_hash long, recipe array<long>, digests array<binary>"


def cut_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of all chunks but the last of each text, as sorted offsets in data; texts lie at starts[i]:ends[i]."""
    h = _GEAR[data]
    step = 1
    while step < WINDOW:  # h[i] = sum of gear[data[i-j]] << j, by doubling
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    at = np.flatnonzero((h & MASK) == 0) + 1
    doc = np.searchsorted(ends, at, "left")
    doc = np.minimum(doc, len(ends) - 1)
    return at[(at - starts[doc] >= WINDOW) & (at < ends[doc])]


def chunks_of(start: int, end: int, cuts: np.ndarray) -> list[tuple[int, int]]:
    edges = [start, *cuts.tolist(), end]
    out = []
    for a, b in zip(edges, edges[1:]):
        while b - a > LONGEST:
            out.append((a, a + LONGEST))
            a += LONGEST
        if b > a:
            out.append((a, b))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uid = TaskContext.get().partitionId() << 33
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            column = part.column("text").cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            raw = column.buffers()[2]
            base = int(offsets[0])
            data = np.frombuffer(raw, np.uint8)[base : int(offsets[-1])] if raw is not None else np.zeros(0, np.uint8)
            original, data = memoryview(data), _LOWER[data]
            starts, ends = offsets[:-1] - base, offsets[1:] - base
            cuts = cut_points(data, starts, ends) if len(data) else np.zeros(0, np.int64)
            first, last = np.searchsorted(cuts, starts, "right"), np.searchsorted(cuts, ends, "left")
            view = memoryview(data)
            texts, hashes, recipes, digests = [], [], [], []
            for s, e, a, b in zip(starts.tolist(), ends.tolist(), first.tolist(), last.tolist()):
                spans = chunks_of(s, e, cuts[a:b])
                recipes.append([_signed(xxhash.xxh3_64_intdigest(view[x:y])) for x, y in spans])
                digests.append([hashlib.sha256(view[x:y]).digest() for x, y in spans])
                texts.append(hashlib.sha256(view[s:e]).hexdigest() if len(spans) != 1 else digests[-1][0].hex())
                hashes.append(_signed(xxhash.xxh64_intdigest(original[s:e], seed=42)))
            n = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(uid, uid + n), pa.int64()), part.column("doc_id"), pa.array(texts, pa.string()), pa.array(hashes, pa.int64()), pa.array(recipes, pa.list_(pa.int64())), pa.array(digests, pa.list_(pa.binary()))],
                ["uid", "doc_id", "text_sha256", "raw_hash", "recipe", "digests"],
            )
            uid += n


def with_verified_recipes(recipes: DataFrame) -> DataFrame:
    """Replace identifiers that stand for several contents: the k-th content by SHA-256 becomes (identifier, k)."""
    pairs = recipes.select(F.explode(F.arrays_zip("recipe", "digests")).alias("c")).select("c.recipe", "c.digests").groupBy("recipe", "digests").agg(F.lit(1).alias("one"))
    # least and largest digest tell clashing identifiers, of which there are hardly any; only these are listed
    clashing = pairs.groupBy("recipe").agg(F.min("digests").alias("least"), F.max("digests").alias("largest")).where("least != largest").select("recipe")
    if clashing.isEmpty():
        return recipes.select("uid", "doc_id", "text_sha256", "raw_hash", "recipe", F.lit(None).cast("array<int>").alias("which"))
    several = pairs.join(clashing, "recipe", "left_semi").groupBy("recipe").agg(F.array_sort(F.collect_set("digests")).alias("contents"))
    one = recipes.select("uid", F.posexplode(F.arrays_zip("recipe", "digests")).alias("ord", "c")).select("uid", "ord", "c.recipe", "c.digests")
    ranked = one.join(several, "recipe").select("uid", F.struct("ord", F.array_position("contents", F.col("digests")).cast("int").alias("k")).alias("x"))
    which = ranked.groupBy("uid").agg(F.array_sort(F.collect_list("x")).alias("x")).select("uid", F.flatten(F.transform("x", lambda x: F.array(x["ord"], x["k"]))).alias("which"))
    return recipes.join(which, "uid", "left").select("uid", "doc_id", "text_sha256", "raw_hash", "recipe", "which")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and raw_hash, a hash of the text as it is."""
    recipes = written(ids_and_text(docs).mapInArrow(_recipes, _SCHEMA), "recipes")  # row numbers must stay as they are
    rows = with_verified_recipes(recipes)
    key = F.xxhash64("recipe", "which").alias("key")
    groups = rows.groupBy("recipe", "which").agg(F.max(F.struct("doc_id", "uid")).alias("best"), F.count("*").alias("group_size")).select(key, F.col("recipe").alias("r"), F.col("which").alias("w"), "best", "group_size")
    # a group of copies may have a third of all rows: these narrow rows are then spread
    keyed = rows.select(key, "*")
    joined = join_spread(keyed, groups, "key", hot_keys(keyed.select("key"), "key"), ["uid"]).where((F.col("recipe") == F.col("r")) & F.col("which").eqNullSafe(F.col("w")))
    return joined.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), "text_sha256", "raw_hash")


@shielded
def keep_one_of_equal(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns. Repeats of one doc_id with one text count as one row."""
    return keep_rows(docs, exact_dedup(docs).where("kept"))
