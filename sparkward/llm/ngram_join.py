"""N-gram Jaccard join by chosen paths.

A text's set holds its N-grams of words (lower case, punctuation aside). Two texts are linked if their sets' Jaccard
similarity is at least THRESHOLD. Texts with the same words are one class, which takes part once.

Search: minhashing turns each set into WIDTH tokens. A run starts with all sets in one node; a node splits its sets on
BRANCHES tokens, drawn by the node's path, so that sets which share such a token meet again in the child of that
token. A child of up to LIMIT sets is brute-forced, by 4-bit sketches of all tokens; a larger one is split again, except
where a few of its sets, drawn by hash, all resemble each other: splitting wouldn't part them, so its blocks are compared,
two at a time, in separate tasks. Texts at the threshold meet in one run with the probability p that solves
p = 1 - (1 - p * THRESHOLD)^BRANCHES, at any depth; there are as many runs as TARGET_RECALL needs. All runs go level
by level together. No child's sets are gathered beyond LIMIT: rows stream in order of paths, and children with more
than one in 10,000 of a level's rows (so at most 10,000) are known beforehand, from counts combined on the map side,
and are split where they stand, without any task receiving them. What DEPTH splits haven't parted is compared block by
block too, so nothing is ever dropped.

Verification: candidate pairs (distinct, after the sketches) are grouped by connected component, or by two blocks of
one where it is large (by texts or by bytes), each distinct text is sent there once, and the exact similarity of their
sets decides.

Defined results: a null text counts as empty. Texts without words are one class without links. A text of fewer than N
words has one N-gram, all its words. Repeated rows belong to one class. Null doc_ids count as the least. An empty
table gives an empty table. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_paths, hot_keys, ids_and_text, join_spread, keep_rows, shielded, tables_made, written
from .components import components

N = 3
THRESHOLD = 0.5
TARGET_RECALL = 0.995
WIDTH = 64
BRANCHES = 3
LIMIT = 1000
SHARE = 10_000  # a path with more than one in SHARE of a level's rows is known beforehand
GROUP = 1500  # texts in a block of those that are verified together, two blocks at a time
GROUP_BYTES = 8 << 20  # and their bytes
DEPTH = 40  # splits of a path before its sets are compared as they are; chance leaves a set far less
_FIRST = -(1 << 63)

_WORD = re.compile(r"[^\W_]+")
_rng = np.random.default_rng(77001)
_A = _rng.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, WIDTH, dtype=np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def survival(threshold: float = THRESHOLD, branches: int = BRANCHES) -> float:
    p = 1.0
    for _ in range(1000):
        p = 1 - (1 - p * threshold) ** branches
    return p


def runs_for(recall: float, threshold: float = THRESHOLD) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold)))


#: Tokens (of WIDTH) in which sketches must agree: the mean at the threshold less 4.2 deviations.
def least_agreement(threshold: float = THRESHOLD) -> int:
    p = 1 / 16 + threshold * 15 / 16
    return max(1, math.floor(WIDTH * p - 4.2 * math.sqrt(WIDTH * p * (1 - p))))


class Shingler:
    """Sets of hashed N-grams; words' hashes are remembered, the memo starts anew when it is full."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def words(self, text: str) -> list[str]:
        return _WORD.findall(text.lower())

    def set_of(self, words: list[str]) -> np.ndarray:
        if len(self.memo) > 500_000:
            self.memo.clear()
        memo = self.memo
        hashes = []
        for w in words:
            h = memo.get(w)
            if h is None:
                h = memo[w] = xxhash.xxh64_intdigest(w)
            hashes.append(h)
        x = np.array(hashes, np.uint64)
        if not len(x):
            return x
        n = min(N, len(x))
        g = np.zeros(len(x) - n + 1, np.uint64)
        for k in range(n):
            g = (g ^ x[k : k + len(g)]) * _M1
            g ^= g >> np.uint64(29)
        g *= _M2
        return np.unique(g ^ (g >> np.uint64(32)))


def minhash(grams: np.ndarray) -> np.ndarray:
    low = np.full(WIDTH, 0xFFFFFFFF, np.uint64)
    for lo in range(0, len(grams), 4096):
        low = np.minimum(low, ((grams[lo : lo + 4096, None] * _A + _B) >> np.uint64(32)).min(0))
    return low.astype(np.uint32)


def sketch(tokens: np.ndarray) -> bytes:
    """4 bits of each token."""
    x = (tokens.astype(np.uint64) * _M1 >> np.uint64(60)).astype(np.uint8)
    return (x[0::2] | x[1::2] << 4).tobytes()


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many tokens each row of a (sketches as rows of 4 numbers) agrees with each of b."""
    out = np.zeros((len(a), len(b)), np.uint8)
    ones = np.uint64(0x1111111111111111)
    for k in range(a.shape[1]):
        x = a[:, k, None] ^ b[None, :, k]
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        out += np.bitwise_count(x & ones).astype(np.uint8)
    return WIDTH - out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def children(paths: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The children of each row: paths (n), tokens (n, WIDTH) -> (n, BRANCHES) paths."""
    out = np.empty((len(paths), BRANCHES), np.uint64)
    start = _mix(paths)
    for k in range(BRANCHES):  # an odd step from a drawn start: no token twice
        at = ((start >> np.uint64(20)) + np.uint64(k) * ((start >> np.uint64(40)) * np.uint64(2) + np.uint64(1))) % np.uint64(WIDTH)
        out[:, k] = _mix(start + _mix(tokens[np.arange(len(paths)), at.astype(np.int64)].astype(np.uint64) + at * _M2))
    return out


_SETS = "uid long, doc_id long, raw_hash long, size long, cls binary, grams long, tokens binary, sketch binary"
_ROWS = "path long, uid long, sketch binary"
_FOUND = "a long, b long, path long, kind int"
PAIR, SPLIT, DENSE = 0, 1, 2


def _class_of(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uid, shingler = TaskContext.get().partitionId() << 33, Shingler()
    for batch in batches:
        rows = []
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            words = shingler.words(text)
            grams = shingler.set_of(words)
            tokens = minhash(grams)
            encoded = text.encode("utf-8", "surrogatepass")
            raw = xxhash.xxh64_intdigest(encoded, seed=42)
            rows.append((uid, i, raw - (raw >> 63 << 64), len(encoded), _class_of(words), len(grams), tokens.tobytes(), sketch(tokens)))
            uid += 1
        yield _batch(rows, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()], ["uid", "doc_id", "raw_hash", "size", "cls", "grams", "tokens", "sketch"])


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(types), types)], names=names)


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, width = rows.shape[0], rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _rows_of(uid: np.ndarray, sketches: np.ndarray, paths: np.ndarray) -> pa.RecordBatch:
    """paths: (n, BRANCHES), the children of each row."""
    return pa.RecordBatch.from_arrays([pa.array(paths.reshape(-1).view(np.int64)), pa.array(np.repeat(uid, BRANCHES)), _fixed(np.repeat(sketches, BRANCHES, 0))], ["path", "uid", "sketch"])


def _expand(runs: int, splits: list[np.ndarray]):
    """Sets to their rows on the level after these splits: level by level, only paths that were split there go on.

    Known paths are few and their lists are sent along, so every level is made from the sets anew, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4000):
                part = batch.slice(lo, 4000)
                tokens, sketches = _matrix(part.column("tokens"), np.uint32, WIDTH), _matrix(part.column("sketch"), np.uint64, 4)
                uid = part.column("uid").to_numpy(zero_copy_only=False)
                for r in range(runs):
                    at, paths = np.arange(len(uid)), np.full(len(uid), r + 1, np.uint64)
                    for split in splits:
                        next_ = children(paths, tokens[at]).reshape(-1)
                        keep = np.isin(next_.view(np.int64), split)
                        at, paths = np.repeat(at, BRANCHES)[keep], next_[keep]
                    if len(at):
                        yield _rows_of(uid[at], sketches[at], children(paths, tokens[at]))

    return run


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, uid, tokens, sketch) to their children."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 4000):
            part = batch.slice(lo, 4000)
            tokens, sketches = _matrix(part.column("tokens"), np.uint32, WIDTH), _matrix(part.column("sketch"), np.uint64, 4)
            paths = part.column("path").to_numpy(zero_copy_only=False).view(np.uint64)
            yield _rows_of(part.column("uid").to_numpy(zero_copy_only=False), sketches, children(paths, tokens))


def resemble(sketches: np.ndarray) -> bool:
    """Whether sets drawn from a node are mostly alike."""
    few = sketches[:: max(1, len(sketches) // 32)][:32]
    same = agreement(few, few)[np.triu_indices(len(few), 1)]
    return len(same) > 0 and np.quantile(same, 0.2) >= WIDTH * (1 / 16 + 0.3 * 15 / 16)


def _pairs(uid: np.ndarray, sketches: np.ndarray, other_uid: np.ndarray | None, other: np.ndarray | None, least: int) -> list[np.ndarray]:
    """Pairs (2, n) within the first, or between both."""
    out = []
    for lo in range(0, len(uid), 256):
        a = sketches[lo : lo + 256]
        i, j = np.nonzero(agreement(a, sketches if other is None else other) >= least)
        x, y = uid[lo + i], (uid if other is None else other_uid)[j]
        keep = (lo + i < j) if other is None else (x != y)
        x, y = x[keep], y[keep]
        out.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
    return out


def _found(a: np.ndarray, b: np.ndarray | None, path: np.ndarray | None, kind: int) -> pa.RecordBatch:
    n = len(a)
    empty = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a), empty if b is None else pa.array(b), empty if path is None else pa.array(path), pa.array(np.full(n, kind, np.int32))], ["a", "b", "path", "kind"])


def _brute_force(limit: int, least: int, deep: bool):
    """Rows sorted by path: pairs within each path of up to limit rows; the others' rows, tagged by what they need
    (never a further split, if deep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = np.zeros(0, np.int64)
        uid, sketches = np.zeros(0, np.int64), np.zeros((0, 4), np.uint64)
        kind, over = 0, None  # a path too large, and what became of it

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            """Deal with all whole paths held, and with the last one if it is too large or all has come."""
            nonlocal path, uid, sketches, kind, over
            edge = np.append(np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]])), len(path)) if len(path) else np.zeros(1, int)
            pairs, done = [], 0
            for k, (lo, hi) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
                whole = last or k < len(edge) - 2
                if over is not None and path[lo] == over or hi - lo > limit:
                    if over is None or path[lo] != over:
                        over, kind = path[lo], DENSE if deep or resemble(sketches[lo:hi]) else SPLIT
                    yield _found(uid[lo:hi], None, path[lo:hi], kind)
                elif not whole:
                    break
                elif hi - lo > 1:
                    pairs += _pairs(uid[lo:hi], sketches[lo:hi], None, None, least)
                done = hi
            if pairs:
                both = np.unique(np.concatenate(pairs, 1), axis=1)
                yield _found(both[0], both[1], None, PAIR)
            path, uid, sketches = path[done:], uid[done:], sketches[done:]

        for batch in batches:
            path = np.concatenate([path, batch.column("path").to_numpy(zero_copy_only=False)])
            uid = np.concatenate([uid, batch.column("uid").to_numpy(zero_copy_only=False)])
            sketches = np.concatenate([sketches, _matrix(batch.column("sketch"), np.uint64, 4)])
            yield from settle(False)
        yield from settle(True)

    return run


def _block_pairs(least: int):
    """Rows (path, i, j, block, uid, sketch) sorted by (path, i, j): pairs between block i and block j of a dense path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros((0, 4), np.uint64)]

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            keys, uid, sketches = held
            if not len(keys):
                return
            edge = np.append(np.flatnonzero(np.concatenate([[True], (keys[1:, :3] != keys[:-1, :3]).any(1)])), len(keys))
            done = 0
            for k, (lo, hi) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
                if not last and k == len(edge) - 2:
                    break
                _, i, j, _ = keys[lo]
                one = keys[lo:hi, 3] == i
                if i == j:
                    pairs = _pairs(uid[lo:hi], sketches[lo:hi], None, None, least)
                else:
                    pairs = _pairs(uid[lo:hi][one], sketches[lo:hi][one], uid[lo:hi][~one], sketches[lo:hi][~one], least)
                if pairs:
                    both = np.concatenate(pairs, 1)
                    yield _found(both[0], both[1], None, PAIR)
                done = hi
            held[:] = [keys[done:], uid[done:], sketches[done:]]

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("path", "i", "j", "block")], 1)
            held[:] = [np.concatenate([held[0], keys]), np.concatenate([held[1], batch.column("uid").to_numpy(zero_copy_only=False)]), np.concatenate([held[2], _matrix(batch.column("sketch"), np.uint64, 4)])]
            yield from settle(False)
        yield from settle(True)

    return run


def _dense_paths(rows: DataFrame, big: list[int]) -> set[int]:
    """Which of the big paths hold sets that are mostly alike, judged by 6 sets of each, drawn by least hash."""
    draws = [F.min(F.struct(F.xxhash64("uid", F.lit(k)), "sketch")).alias(f"d{k}") for k in range(6)]
    chosen = _where_path(rows, big, True).groupBy("path").agg(*draws).collect()  # at most SHARE rows
    dense = set()
    for r in chosen:
        x = np.array([np.frombuffer(r[f"d{k}"]["sketch"], np.uint64) for k in range(6)])
        same = agreement(x, x)[np.triu_indices(6, 1)]
        if (same >= WIDTH * (1 / 16 + 0.3 * 15 / 16)).sum() >= 12:
            dense.add(r["path"])
    return dense


def _where_path(rows: DataFrame, paths: list[int], inside: bool) -> DataFrame:
    """Rows inside or outside of at most SHARE paths, whose list is broadcast."""
    named = F.broadcast(rows.sparkSession.createDataFrame([(p,) for p in paths], "path long"))
    return rows.join(named, "path", "left_semi" if inside else "left_anti")


def candidates(reps: DataFrame, threshold: float, recall: float, limit: int, share: int = SHARE) -> DataFrame:
    """Pairs a < b of uids whose sketches agree enough, of all runs (so some come several times). reps: a written table of sets."""
    runs, least = runs_for(recall, threshold), least_agreement(threshold)
    sets = reps.where("grams > 0").select("uid", "tokens", "sketch")
    pairs: list[DataFrame] = []
    splits: list[np.ndarray] = []  # of each level, the known paths that were split
    more: DataFrame | None = None  # rows of paths that turned out too large only when they were streamed
    for level in itertools.count():
        deep = level >= DEPTH
        known = sets.mapInArrow(_expand(runs, splits), _ROWS) if not splits or len(splits[-1]) else None
        rows = known if more is None else more if known is None else known.unionByName(more)
        sizes = rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        counted = written(sizes.groupBy(F.when(F.col("n") > limit, F.col("path")).alias("path")).agg(F.sum("n").alias("n")), f"paths-{level}")
        total = counted.agg(F.sum("n")).first()[0] or 0
        big = [r["path"] for r in counted.where(F.col("path").isNotNull() & (F.col("n") > total // share)).select("path").collect()]
        dense = sorted(big if deep else _dense_paths(rows, big)) if big else []
        split = sorted(set(big) - set(dense))
        rest = _where_path(rows, big, False) if big else rows
        found = written(rest.repartition("path").sortWithinPartitions("path").mapInArrow(_brute_force(limit, least, deep), _FOUND), f"found-{level}")
        pairs.append(found.where(f"kind = {PAIR}").select("a", "b"))
        kinds = {r["kind"] for r in found.select("kind").distinct().collect()}
        blocks = found.where(f"kind = {DENSE}").select("path", F.col("a").alias("uid"))
        if dense:
            blocks = blocks.unionByName(_where_path(rows, dense, True).select("path", "uid"))
        if dense or DENSE in kinds:
            pairs.append(written(_in_blocks(blocks, sets, limit, least), f"blocks-{level}").select("a", "b"))
        again = [found.where(f"kind = {SPLIT}").select("path", F.col("a").alias("uid"))] if SPLIT in kinds else []
        if more is not None and split:
            again.append(_where_path(more, split, True).select("path", "uid"))
        splits.append(np.array(split if known is not None else [], np.int64))
        more = None
        if again:
            wanted = again[0] if len(again) == 1 else again[0].unionByName(again[1])
            more = written(wanted.join(sets, "uid").select("path", "uid", "tokens", "sketch").mapInArrow(_split, _ROWS), f"more-{level}")
        if more is None and not len(splits[-1]):
            break
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    return out  # of written tables


def _in_blocks(rows: DataFrame, sets: DataFrame, limit: int, least: int) -> DataFrame:
    """All pairs of dense paths, two blocks in a task: an exact way at any size, without ever gathering a path."""
    rows = written(rows, "dense")
    sizes = rows.groupBy("path").agg(F.ceil(F.count("*") / limit).cast("int").alias("blocks"))
    placed = rows.join(sizes, "path").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    to = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = placed.select("path", "uid", "block", to).select("path", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "uid")
    with_sketch = spread.join(sets.select("uid", "sketch"), "uid").select("path", "i", "j", "block", "uid", "sketch")
    return with_sketch.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j").mapInArrow(_block_pairs(least), _FOUND)


def _verify(threshold: float):
    """texts (key, uid, text) and pairs (key, a, b) of one group: the pairs that hold, with their similarity."""

    def run(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        shingler = Shingler()
        sets = {uid: shingler.set_of(shingler.words(text)) for uid, text in zip(texts.column("uid").to_pylist(), texts.column("text").to_pylist())}
        rows = []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                continue
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            if common >= threshold * (len(x) + len(y) - common):
                rows.append((a, b, common / (len(x) + len(y) - common)))
        return pa.Table.from_batches([_batch(rows, [pa.int64(), pa.int64(), pa.float64()], ["a", "b", "similarity"])])

    return run


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = TARGET_RECALL, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(rows, links). rows, one per row of docs: doc_id, text_id (least doc_id of its class, that is of all texts with
    the same words), class_id (least doc_id of all texts that links join), n_links (texts of other words linked to it),
    stays (one row of each class_id), raw_hash. links: a, b (text_ids), similarity: all linked pairs of classes.
    """
    with tables_made() as made:
        sets, reps, links, grouped = _grouped(ids_and_text(docs), threshold, recall, limit)
    drop_paths(docs.sparkSession, made, sets, reps, links, grouped)
    heads = grouped.groupBy("label").agg(F.min(F.struct("d", "uid", "text_id")).alias("head")).select("label", F.col("head.text_id").alias("class_id"), F.col("head.uid").alias("head"))
    named = join_spread(grouped, heads, "label", hot_keys(grouped.select("label"), "label"), ["uid"]).select("cls", "text_id", "class_id", "n_links", "head")
    hashed = sets.select("uid", "doc_id", "raw_hash", "cls")
    # a class may have a third of all rows: these narrow rows are then spread
    rows = join_spread(hashed, named, "cls", hot_keys(hashed.select("cls"), "cls"), ["uid"]).select("doc_id", "text_id", "class_id", "n_links", (F.col("uid") == F.col("head")).alias("stays"), "raw_hash")
    of = reps.select("uid", "doc_id")
    told = links.join(of.select(F.col("uid").alias("a"), F.col("doc_id").alias("doc_a")), "a").join(of.select(F.col("uid").alias("b"), F.col("doc_id").alias("doc_b")), "b")
    return rows, told.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"), "similarity")


def _grouped(docs: DataFrame, threshold: float, recall: float, limit: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Written tables: sets of all rows, one of each class, links between these, and each class with its component's label."""
    sets = written(docs.mapInArrow(_sets, _SETS), "sets")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(_FIRST)).alias("d"), "uid", "doc_id", "raw_hash", "size", "grams", "tokens", "sketch")).alias("r")
    reps = written(sets.groupBy("cls").agg(first).select("cls", "r.*"), "classes")
    pairs = candidates(reps, threshold, recall, limit)
    # each component's texts go to one group, or a large component's to one for each two blocks that have pairs
    label = written(components(pairs), "labels")
    of_size = label.join(reps.select(F.col("uid").alias("node"), "size"), "node")
    sizes = of_size.groupBy("label").agg(F.ceil(F.greatest(F.count("*") / GROUP, F.sum("size") / GROUP_BYTES)).cast("int").alias("blocks"))
    hot = hot_keys(label.select("label"), "label")  # a component may hold a third of all classes
    placed = join_spread(label, sizes, "label", hot, ["node"]).select(F.col("node").alias("a"), "label", "blocks")
    x, y = (F.pmod(F.xxhash64(c), F.col("blocks")) for c in ("a", "b"))  # both ends are of one component
    key = F.xxhash64("label", F.least(x, y), F.greatest(x, y)).alias("key")
    keyed = written(pairs.join(placed, "a").select("a", "b", key).dropDuplicates(["a", "b"]).select("key", "a", "b"), "keyed")
    needed = keyed.select("key", F.col("a").alias("uid")).unionByName(keyed.select("key", F.col("b").alias("uid"))).distinct()
    # each class's text is that of its representative: by id and text, so rows that share an id don't multiply
    wanted = needed.join(reps.select("uid", "d", "raw_hash"), "uid")
    named = docs.select(F.coalesce("doc_id", F.lit(_FIRST)).alias("d"), F.xxhash64("text").alias("raw_hash"), "text")
    once = named.join(wanted.select("d", "raw_hash").distinct(), ["d", "raw_hash"], "left_semi").dropDuplicates(["d", "raw_hash"])
    texts = once.join(wanted, ["d", "raw_hash"]).select("key", "uid", "text")
    links = written(texts.groupBy("key").cogroup(keyed.select(F.col("key").alias("k"), "a", "b").groupBy("k")).applyInArrow(_verify(threshold), "a long, b long, similarity double"), "links")
    # one row for each class that has links
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    names = reps.select("uid", "cls", "d", "doc_id")
    grouped = components(links).join(degree, "node").join(names, F.col("node") == F.col("uid"), "right")
    grouped = written(grouped.select("cls", "uid", "d", F.col("doc_id").alias("text_id"), F.coalesce("label", "uid").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "grouped")
    return sets, reps, links, grouped


@shielded
def keep_one_of_similar(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each class_id, with all their columns."""
    rows, _ = ngram_join(docs)
    return keep_rows(docs, rows.where("stays"))
