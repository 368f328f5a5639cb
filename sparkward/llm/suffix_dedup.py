"""Suffix-array dedup: remove every byte covered by a LENGTH-byte string that also starts earlier.

Texts are UTF-8 bytes, ordered by doc_id, then by position; strings never cross texts and are judged on the input.

1. Anchors. Each LENGTH-byte window owns the GRAM-byte string of least hash in it, its anchor: equal windows have equal
   anchors at equal places. Texts go to groups by content, so that of equal texts but one, the earliest, goes on: the
   others are covered whole. A group tells 40 bits of the hash of each run's anchors (one in some 40 bytes), and gets a
   bit for each back that says whether another run has it too; a window whose anchor stands only once is settled.
2. Shards. The stretches that stay get, shard by shard, a suffix array (Larsson-Sadakane refinement: only groups not yet
   told apart are sorted again, by the rank of the suffix twice as deep) and common prefixes (Kasai, in lanes). Windows
   with a common prefix of LENGTH are equal: all but the earliest of the shard are covered.
3. Merge. Each group sends its distinct windows, runs of one anchor as one piece of text, to that anchor's bucket. There
   the sorted fingerprints of one block after another are looked up in those merged so far by binary search, equal
   fingerprints are compared byte by byte, and all but the earliest are covered. Windows of an anchor that very many
   runs share go by a longer string of least hash, LONG_GRAM bytes, to that one's bucket, and are merged there for some
   groups at a time first, so that no task grows with one passage.
4. The covered stretches join the texts and are cut out. The texts move once: steps 1, 2 and 4 read one exchange, and no
   table is written in between.

A text longer than a part is taken in parts that overlap by LENGTH - 1 bytes: each window lies in one of them, and what
repeats between parts meets in step 3 like all else. A text whose copies are larger than a group is spread over several
by doc_id, and its earliest copies of these meet in step 3; rows that repeat both doc_id and text very often are taken
out beforehand, but for one, and get its result.

Defined results: a null text counts as empty; texts under LENGTH bytes lose nothing. A null doc_id comes before all
others. Rows of one doc_id with different texts are ordered by a hash of the text; rows equal in both count as one
document, and each gets its result. An empty table gives an empty table. Columns other than doc_id and text aren't
read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, ids_and_text, join_spread, partitions_for, total_text_bytes, written

LENGTH = 100
GRAM = 16
LONG_GRAM = 64  # of windows whose anchor is hot; a multiple of GRAM
SHARD_BYTES = 2 << 20  # of one suffix array
GROUP_BYTES = 8 << 20  # of text in one group of step 2 and 4
ANCHOR_BYTES = 96 << 20  # of text whose anchors meet in one bucket of step 1
MERGE_BYTES = 8 << 20  # of text whose pieces meet in one bucket of step 3
HOT = 2000  # runs that tell an anchor before its windows go by longer strings
HELD_BYTES = 32 << 20  # of pieces held in step 2 before they are packed
BLOCK = 1 << 18  # windows merged at a time
_FIRST = -(1 << 63)  # where a null doc_id stands

PART = 1 << 22  # bytes whose anchors are sought at a time


# --- bytes


def words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a big-endian number, zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), ">u8", padded, 0, (1,)).astype(np.uint64)


def owners(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts at starts[i]:ends[i] in data: the windows' starts, each one's anchor position, and all gram hashes."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w = words8(data)
    grams = n - GRAM + 1
    h = w[:grams] * np.uint64(0x9E3779B97F4A7C15) ^ (w[GRAM - 8 : GRAM - 8 + grams] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    inside = np.zeros(n + 1, np.int8)
    long = ends - starts >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.subtract.at(inside, ends[long] - LENGTH + 1, 1)
    at = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int32) > 0)
    return at, least_of_windows(h)[at], h


def long_owners(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows at `at`, where the string of LONG_GRAM bytes of least hash stands in each, and these strings' hashes by position. h: the gram hashes."""
    n = len(h) - LONG_GRAM + GRAM
    mixed = np.zeros(n, np.uint64)
    for k in range(0, LONG_GRAM, GRAM):
        mixed = (mixed ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    return least_of_windows(mixed, LONG_GRAM)[at], mixed


def least_of_windows(h: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """The position of the least hash in each window, of all positions where one may begin."""
    starts = len(h) + gram - LENGTH
    return np.concatenate([least_in_reach(h[lo : lo + PART + LENGTH - gram], LENGTH - gram + 1) + lo for lo in range(0, starts, PART)])


def least_in_reach(h: np.ndarray, reach: int) -> np.ndarray:
    """Where the least of h[i : i + reach] stands, the leftmost of equals, of every i."""
    low = np.uint64((1 << 24) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # hash above, position below
    have = 1
    while have < reach:
        step = min(have, reach - have)
        m = np.minimum(m[:-step], m[step:])
        have += step
    return (m & low).astype(np.int64)


def suffix_array(data: np.ndarray, depth: int, alike: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first depth bytes (at least), and each suffix's rank. Bytes beyond the end count as 0.

    alike, if given, is set where a suffix and the one before it in order have at least half of depth in common (told by
    the last refinement but one).
    """
    n = len(data)
    keys = words8(data)
    sa = np.argsort(keys).astype(np.int32)  # how equals stand is of no account, and the plain sort is the faster one
    ordered = keys[sa]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    del keys, ordered
    group = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0)).astype(np.int32)
    rank = np.empty(n, np.int32)
    rank[sa] = group
    h, near = 8, np.zeros(0, np.int64)
    while h < depth:
        # only groups of more than one suffix are sorted further
        single = new & np.append(new[1:], True)
        at = np.flatnonzero(~single)
        if not len(at):
            break
        if depth <= 2 * h:
            near = ~new
        suffix = sa[at]
        after = suffix.astype(np.int64) + h
        second = np.where(after < n, rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
        key = group[at].astype(np.int64) << 32 | second
        order = np.argsort(key)
        key = key[order]
        sa[at] = suffix[order]
        new[at] = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0)).astype(np.int32)
        rank[sa] = group
        h *= 2
    rank[sa] = np.arange(n, dtype=np.int32)
    if alike is not None:
        alike[sa[near]] = True  # groups keep their places in order while their suffixes are sorted
    return sa, rank


def common_prefixes(data: np.ndarray, sa: np.ndarray, rank: np.ndarray, most: int, alike: np.ndarray | None = None) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, at most `most`, by text position. alike: only of these
    suffixes, which have most // 2 in common at least, the others' are below that and given as 0.

    Kasai: the prefix at position i+1 is at least that at i less one. Lanes of positions run side by side. As suffixes
    equal to the sorted depth are in no order, this bound needs a check after a prefix that reached `most`.
    """
    n = len(data)
    lane = max(16, min(256, n >> 13))  # lanes enough for a step to be worth its call
    lanes = -(-n // lane)
    first = np.arange(lanes, dtype=np.int64) * lane
    padded = np.concatenate([data, np.zeros(most + 16, np.uint8)])
    words = np.ndarray((len(padded) - 8,), "<u8", padded, 0, (1,))
    out = np.zeros(n, np.int16)
    h, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    least = 0
    if alike is not None:
        least, padded_alike = most // 2, np.append(alike, np.zeros(lane, bool))
    for t in range(lane):
        i = first + t
        if alike is None:
            live = np.flatnonzero(i < n)
        else:
            known = padded_alike[i]
            live = np.flatnonzero(known)
            h[~known] = 0
            if not len(live):
                continue
        i = i[live]
        r = rank[i]
        j = np.where(r > 0, sa[np.maximum(r - 1, 0)], 0).astype(np.int64)
        k = np.maximum(h[live] - 1, least)
        follows = before[live] + 1
        k[(h[live] == most) & ((follows >= n) | (rank[np.minimum(follows, n - 1)] >= r))] = least
        room = np.minimum(n - np.maximum(i, j), most)
        k = np.minimum(k, room)
        open_ = np.flatnonzero((r > 0) & (k < room))
        while len(open_):
            a, b, c = i[open_], j[open_], k[open_]
            x = words[a + c] ^ words[b + c]
            same = x == 0
            # trailing zero bytes: equal bytes before the first that differs
            x = x & (~x + np.uint64(1))
            bits = np.where(same, 64, np.log2(np.maximum(x, np.uint64(1)).astype(np.float64)).astype(np.int64))
            c = c + bits // 8
            k[open_] = np.minimum(c, room[open_])
            open_ = open_[same & (c < room[open_])]
        k[r == 0] = 0
        h[live], before[live] = k, j
        out[i] = k
    return out


def merged_intervals(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of intervals sorted by start; intervals that touch are joined."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]


# --- what travels

KEY = np.dtype([("id", "<i8"), ("tag", "<i8")])
CROWD = np.dtype([("tag", "<i8"), ("salts", "<i8")])
SPAN = np.dtype([("doc", "<u4"), ("start", "<u4"), ("end", "<u4")])
PIECE = np.dtype([("group", "<u8"), ("doc", "<u4"), ("start", "<u4"), ("size", "<u4")])


def pack(keys: np.ndarray, rows: np.ndarray, rest: bytes = b"") -> bytes:
    """Rows with the keys of the documents that they name; documents are numbered anew, in their order."""
    used, number = np.unique(rows["doc"], return_inverse=True)
    rows = rows.copy()
    rows["doc"] = number
    # column by column, which compresses better; Spark's own codec is made for speed
    whole = b"".join([len(used).to_bytes(4, "little"), len(rows).to_bytes(4, "little"), keys[used].tobytes(), *(rows[f].tobytes() for f in rows.dtype.names), rest])
    return len(whole).to_bytes(8, "little") + pa.compress(whole, "zstd", asbytes=True)


def unpack(blob: bytes, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, memoryview]:
    blob = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    n, m = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
    keys = np.frombuffer(blob, KEY, n, 8)
    rows, at = np.empty(m, kind), 8 + n * KEY.itemsize
    for f in kind.names:
        rows[f] = np.frombuffer(blob, kind[f], m, at)
        at += m * kind[f].itemsize
    return keys, rows, memoryview(blob)[at:]


def unpack_all(blobs: list[bytes], kind: np.dtype) -> tuple[np.ndarray, np.ndarray, list[memoryview]]:
    parts = [unpack(b, kind) for b in blobs]
    if not parts:
        return np.zeros(0, KEY), np.zeros(0, kind), []
    base = 0
    for keys, rows, _ in parts:
        rows["doc"] += base
        base += len(keys)
    return np.concatenate([k for k, _, _ in parts]), np.concatenate([r for _, r, _ in parts]), [x for _, _, x in parts]


def shard_of(ids: np.ndarray, shards: int | np.ndarray, tags: np.ndarray | None = None) -> np.ndarray:
    """pmod(xxhash64(id, tag), shards), or of the id alone, as Spark has it."""
    p = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    h = np.full(len(ids), 42, np.uint64)
    for column in [ids] if tags is None else [ids, tags]:
        x = np.ascontiguousarray(column).astype(np.int64).view(np.uint64)
        h = turn((h + np.uint64(8) + p[4]) ^ (turn(x * p[1], 31) * p[0]), 27) * p[0] + p[3]
        h = (h ^ (h >> np.uint64(33))) * p[1]
        h = (h ^ (h >> np.uint64(29))) * p[2]
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64) % shards


def shards_of(keys: np.ndarray, shards: int, crowds: np.ndarray) -> np.ndarray:
    """The group of each document: by its text, and by its id too if the text is one of the crowds (CROWD, sorted)."""
    number = number_of(crowds["tag"], keys["tag"])
    salt = np.zeros(len(keys), np.int64)
    salted = number >= 0
    salt[salted] = shard_of(keys["id"][salted], crowds["salts"][number[salted]])
    return shard_of(keys["tag"], shards, salt)


def changes(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it; true at the first."""
    return np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)


def by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, indices of its members)."""
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0])) if len(part) else np.zeros(0, int)
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(part)]):
        yield int(part[order[a]]), order[a:b]


SPANS, HOT_PIECES = 1, 2
_ASKED = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("blob", pa.binary())])
_TRAVEL = pa.schema([("target", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("place", pa.int32()), ("blob", pa.binary())])
_HOME = pa.schema([("shard", pa.int32()), ("blob", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(schema), schema.types)], schema=schema)


def tag_of(text: bytes) -> int:
    """xxhash64(text), as Spark has it."""
    h = xxhash.xxh64_intdigest(text, seed=42)
    return h - (h >> 63 << 64)


def keys_of(ids: list[int | None], texts: list[bytes]) -> np.ndarray:
    keys = np.zeros(len(ids), KEY)
    keys["id"] = [_FIRST if i is None else i for i in ids]
    keys["tag"] = [tag_of(t) for t in texts]
    return keys


class Texts:
    """Some texts, or parts of them, one after another in data; keys says which they are, base where a part begins."""

    def __init__(self, keys: np.ndarray, texts: list[bytes], base: list[int] | None = None):
        self.keys = keys
        self.base = np.array(base if base is not None else [0] * len(texts), np.int64)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.data = np.frombuffer(b"".join(texts), np.uint8)


def some(keys: np.ndarray, texts: list[bytes], size: int) -> Iterator[tuple[int, int, Texts]]:
    """Texts a:b in runs of about size bytes; a longer text in parts, each a run of its own."""
    a = total = 0
    for b, t in enumerate(texts):
        if b > a and total + len(t) > size:
            yield a, b, Texts(keys[a:b], texts[a:b])
            a, total = b, 0
        if len(t) > size + LENGTH - 1:
            for lo in range(0, len(t) - LENGTH + 1, size):
                yield b, b + 1, Texts(keys[b : b + 1], [t[lo : lo + size + LENGTH - 1]], [lo])
            a, total = b + 1, 0
        else:
            total += len(t)
    if a < len(texts):
        yield a, len(texts), Texts(keys[a:], texts[a:])


# --- step 1


MARK_BYTES = 5  # of an anchor's hash; the bits above choose the bucket


def by_bucket(found: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices of its members in order) of sorted hashes."""
    return by_part(((found >> np.uint64(8 * MARK_BYTES)) % np.uint64(buckets)).astype(np.int64))


def report_anchors(buckets: int):
    def run(docs: pa.Table) -> pa.Table:
        keys, texts = unique_texts(docs)
        told: dict[int, list[bytes]] = {}
        for _, _, t in some(keys, texts, SHARD_BYTES):
            _, owner, hashes = owners(t.data, t.starts, t.ends)
            found = np.unique(hashes[owner[changes(owner)]])  # as places rise, so do their anchors
            marks = found.view(np.uint8).reshape(-1, 8)[:, :MARK_BYTES]
            for bucket, own in by_bucket(found, buckets):
                told.setdefault(bucket, []).append(marks[own].tobytes())
        home = docs.column("shard")[0].as_py()
        return pa.Table.from_batches([_table([(k, home, b"".join(x)) for k, x in told.items()], _ASKED)])

    return run


def count_anchors(hot: int):
    """For each mark, in the order in which they were told, a bit if several runs have it; if one of them is hot, a bit for that too."""

    def run(table: pa.Table) -> pa.Table:
        blobs = table.column("blob").to_pylist()
        n = np.array([len(b) // MARK_BYTES for b in blobs])
        marks = np.zeros((n.sum(), 8), np.uint8)
        marks[:, :MARK_BYTES] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, MARK_BYTES)
        marks = marks.view(np.uint64).ravel()
        order = np.argsort(marks)
        edge = np.append(np.flatnonzero(changes(marks[order])), len(marks))
        times = np.empty(len(marks), np.int64)
        times[order] = np.repeat(np.diff(edge), np.diff(edge))
        rows, ends = [], np.cumsum(n)
        for bucket, shard, lo, hi in zip(table.column("bucket").to_pylist(), table.column("shard").to_pylist(), (ends - n).tolist(), ends.tolist()):
            own = times[lo:hi]
            often = own > hot
            bits = np.packbits(own > 1).tobytes()
            bits = b"\1" + bits + np.packbits(often).tobytes() if often.any() else b"\0" + bits
            rows.append((bucket, shard, bits))
        return pa.Table.from_batches([_table(rows, _ASKED)])

    return run


class Answers:
    """What count_anchors says of a group's anchors, run by run, in the order in which report_anchors told them."""

    def __init__(self, table: pa.Table, buckets: int):
        self.buckets = buckets
        self.bits = {k: [np.unpackbits(x).astype(bool) for x in np.split(np.frombuffer(b, np.uint8, -1, 1), 1 + b[0])] for k, b in zip(table.column("bucket").to_pylist(), table.column("blob").to_pylist())}
        self.told = dict.fromkeys(self.bits, 0)

    def of_run(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the next run's sorted different anchor hashes: which other runs have too, and which are hot."""
        repeated, hot = np.zeros(len(found), bool), np.zeros(len(found), bool)
        for bucket, own in by_bucket(found, self.buckets):
            lo = self.told[bucket]
            self.told[bucket] = hi = lo + len(own)
            bits = self.bits[bucket]
            repeated[own] = bits[0][lo:hi]
            if len(bits) > 1:
                hot[own] = bits[1][lo:hi]
        return repeated, hot


# --- step 2


def earliest(table: pa.Table) -> dict[bytes, int]:
    """The least doc_id of each different text."""
    first: dict[bytes, int] = {}
    for i, t in zip(table.column("doc_id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist()):
        i = _FIRST if i is None else i
        if first.setdefault(t, i) > i:
            first[t] = i
    return first


def unique_texts(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Different texts in their order, each with its least doc_id: keys and texts."""
    rows = sorted((i, tag_of(t), t) for t, i in earliest(table).items())
    keys = np.zeros(len(rows), KEY)
    keys["id"], keys["tag"] = [i for i, *_ in rows], [h for _, h, _ in rows]
    return keys, [t for *_, t in rows]


def number_of(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted key in the sorted keys, -1 if it isn't there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def shard_windows(texts: Texts, answers: Answers) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """One suffix array: texts in order. The covered windows' documents and places, and the distinct ones' pieces, which
    of these are of hot anchors, and where they begin in the texts' data."""
    at, owner, hashes = owners(texts.data, texts.starts, texts.ends)
    new = changes(owner)
    found, which, times = np.unique(hashes[owner[new]], return_inverse=True, return_counts=True)
    repeated, hot = answers.of_run(found)
    number = np.cumsum(new) - 1  # of each window's anchor
    own = ((times > 1) | repeated)[which][number]
    single = hot[which][number][own]
    at, owner = at[own], owner[own]
    if not len(at):
        return (at, at), np.zeros(0, PIECE), np.zeros(0, bool), at
    a, b = merged_intervals(at, at + LENGTH)
    size = b - a
    to = np.cumsum(size) - size  # where each stretch begins in the shard's text
    data = texts.data[np.arange(size.sum()) + np.repeat(a - to, size)]
    place = at - np.repeat(a - to, np.diff(np.append(np.searchsorted(at, a), len(at))))  # of each window in it
    alike = np.zeros(len(data), bool)
    sa, rank = suffix_array(data, LENGTH, alike)
    prefix = common_prefixes(data, sa, rank, LENGTH, alike)
    order = np.argsort(rank[place])
    # between two windows next to each other in order, other suffixes may stand: the least common prefix counts
    breaks = np.cumsum(prefix[sa] < LENGTH)
    group = breaks[rank[place[order]]]
    new = np.concatenate([[True], group[1:] != group[:-1]])
    earliest = np.minimum.reduceat(place[order], np.flatnonzero(new))
    covered = np.zeros(len(at), bool)
    covered[order] = place[order] != np.repeat(earliest, np.diff(np.append(np.flatnonzero(new), len(order))))
    doc = np.searchsorted(texts.ends, at, "right")
    place = at - texts.starts[doc] + texts.base[doc]
    settled = doc[covered], place[covered]
    # distinct windows go to step 3: runs with one anchor as one piece, those of hot anchors by a longer string
    at, owner, doc, place, single = at[~covered], owner[~covered], doc[~covered], place[~covered], single[~covered]
    group = hashes[owner]
    if single.any():  # the same for all places of an anchor, wherever they are
        owner[single], long_hashes = long_owners(hashes, at[single])
        group[single] = long_hashes[owner[single]]
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (owner[1:] != owner[:-1]) | (single[1:] != single[:-1])]))
    last = np.append(edge[1:] - 1, len(at) - 1)
    pieces = np.zeros(len(edge), PIECE)
    pieces["doc"], pieces["start"], pieces["group"] = doc[edge], place[edge], group[edge]
    pieces["size"] = at[last] + LENGTH - at[edge]
    return settled, pieces, single[edge], at[edge]


def piece_rows(keys: np.ndarray, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int, part: int) -> list[tuple]:
    """Rows for step 3 of a group's pieces: pieces, which of them are of hot anchors, and their bytes."""
    if not found:
        return []
    pieces, single, data = (np.concatenate(x) for x in zip(*found))
    begin = np.cumsum(pieces["size"].astype(np.int64)) - pieces["size"]
    rows = []
    for kind, chosen in ((0, ~single), (HOT_PIECES, single)):
        which = np.flatnonzero(chosen)
        for bucket, own in by_part((pieces["group"][which] % np.uint64(buckets)).astype(np.int64)):
            own = which[own]
            own = own[np.argsort(pieces["group"][own], kind="stable")]
            # hot pieces of one bucket and part meet in some partition, of which one holds few
            target = (bucket * 7919 + part * 104_729) % buckets if kind else bucket
            rows.append((target, kind, bucket, part, pack_pieces(keys, pieces[own], data, begin[own])))
    return rows


def piece_bytes(pieces: np.ndarray, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    size = pieces["size"].astype(np.int64)
    ends = np.cumsum(size)
    return data[np.arange(size.sum()) + np.repeat(begin - ends + size, size)]


def pack_pieces(keys: np.ndarray, pieces: np.ndarray, data: np.ndarray, begin: np.ndarray) -> bytes:
    return pack(keys, pieces, piece_bytes(pieces, data, begin).tobytes())


def span_rows(keys: np.ndarray, doc: np.ndarray, start: np.ndarray, buckets: int, shards: int, crowds: np.ndarray) -> list[tuple]:
    """Rows with the bytes that windows at (doc, start), sorted, cover."""
    if not len(doc):
        return []
    wide = doc.astype(np.int64) << 33
    a, b = merged_intervals(wide + start, wide + start + LENGTH)
    spans = np.zeros(len(a), SPAN)
    low = (1 << 33) - 1
    spans["doc"], spans["start"], spans["end"] = a >> 33, a & low, b & low
    return [(shard % buckets, SPANS, shard % buckets, shard, pack(keys, spans[own])) for shard, own in by_part(shards_of(keys, shards, crowds)[spans["doc"]])]


def sort_shards(anchor_buckets: int, buckets: int, shards: int, crowds, parts: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not len(docs):
            return pa.Table.from_batches([_table([], _TRAVEL)])
        part = docs.column("shard")[0].as_py() % parts
        keys, texts = unique_texts(docs)
        answers = Answers(told, anchor_buckets)
        rows: list[tuple] = []
        found, held = [], 0
        for a, _, run_texts in some(keys, texts, SHARD_BYTES):
            (doc, place), pieces, single, begin = shard_windows(run_texts, answers)
            rows += span_rows(run_texts.keys, doc, place, buckets, shards, crowds.value)
            found.append((pieces, single, piece_bytes(pieces, run_texts.data, begin)))
            pieces["doc"] += a
            held += len(found[-1][2])
            if held > HELD_BYTES:
                rows += piece_rows(keys, found, buckets, part)
                found, held = [], 0
        return pa.Table.from_batches([_table(rows + piece_rows(keys, found, buckets, part), _TRAVEL)])

    return run


# --- step 3

_POWER = np.uint64(0x9E3779B97F4A7C15 | 1)


def fingerprints(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 bits of each LENGTH-byte string at at."""
    w = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,))
    h = np.zeros(len(at), np.uint64)
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        h = (h ^ w[at + k]) * _POWER
        h ^= h >> np.uint64(29)
    return h


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,))
    ok = np.ones(len(a), bool)
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        ok &= w[a + k] == w[b + k]
    return ok


def covered_places(keys: np.ndarray, pieces: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys, each piece's document among them, its begin in data, and the places (document << 33 | start) that are covered."""
    size = pieces["size"].astype(np.int64)
    begin = np.cumsum(size) - size
    # documents in their order, so that places compare as numbers
    sorted_keys, number = np.unique(keys, return_inverse=True)
    doc = number[pieces["doc"]].astype(np.int64)
    order = np.argsort(pieces["group"], kind="stable")
    group = pieces["group"][order]
    edge = np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(group))
    windows = np.concatenate([[0], np.cumsum(size[order] - LENGTH + 1)])
    a = 0
    covered: list[np.ndarray] = []
    while a < len(edge) - 1:  # whole groups, as many as make a block; a larger group is merged block by block
        b = max(a + 1, int(np.searchsorted(windows[edge], windows[edge[a]] + BLOCK, "right")) - 1)
        covered.append(merge_group(data, begin, size, doc, pieces["start"].astype(np.int64), order[edge[a] : edge[b]]))
        a = b
    return sorted_keys, doc, begin, np.sort(np.concatenate(covered))


def merge_pieces(buckets: int, shards: int, crowds, last: bool = False):
    """First the buckets, and hot pieces of some groups at a time, of which what isn't covered goes on; last what went on."""

    def run(table: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        together: dict[tuple[int, int, int], list[bytes]] = {}
        for kind, bucket, place, blob in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "place", "blob"))):
            if kind == SPANS:
                rows.append((bucket, kind, bucket, place, blob))
            else:
                together.setdefault((kind, bucket, place if kind and not last else 0), []).append(blob)
        for (kind, bucket, _), blobs in together.items():
            keys, pieces, bodies = unpack_all(blobs, PIECE)
            data = np.frombuffer(b"".join(bodies), np.uint8)
            sorted_keys, doc, begin, place = covered_places(keys, pieces, data)
            rows += span_rows(sorted_keys, place >> 33, place & ((1 << 33) - 1), buckets, shards, crowds.value)
            if kind and not last:
                pieces["doc"] = doc
                rows.append((bucket, kind, bucket, 0, pack_pieces(sorted_keys, *uncovered(pieces, data, begin, place))))
        return pa.Table.from_batches([_table([r[3:] for r in rows], _HOME) if last else _table(rows, _TRAVEL)])

    return run


def uncovered(pieces: np.ndarray, data: np.ndarray, begin: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces that the windows at other than the covered places make, data, and where they begin in it."""
    n = pieces["size"].astype(np.int64) - LENGTH + 1
    of = np.repeat(np.arange(len(pieces)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    stay = np.flatnonzero(~np.isin((pieces["doc"][of].astype(np.int64) << 33) + pieces["start"][of] + step, covered))
    of, step = of[stay], step[stay]
    edge = np.flatnonzero(changes(of) | changes(stay - np.arange(len(stay))))
    out = pieces[of[edge]]
    out["start"] += step[edge].astype(np.uint32)
    out["size"] = np.diff(np.append(edge, len(of))) + LENGTH - 1
    return out, data, begin[of[edge]] + step[edge]


def merge_group(data, begin, size, doc, start, members) -> np.ndarray:
    """Places (document << 33 | start) of the windows in the member pieces that an earlier equal window covers."""
    mark, place, at = (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64))  # merged so far, sorted by fingerprint
    covered = []
    total = np.concatenate([[0], np.cumsum(size[members] - LENGTH + 1)])
    lo = 0
    while lo < len(members):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + BLOCK, "right")) - 1)
        own = members[lo:hi]
        n = size[own] - LENGTH + 1
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        new_at = np.repeat(begin[own], n) + step
        new_place = np.repeat((doc[own] << 33) + start[own], n) + step
        new_mark = fingerprints(data, new_at)
        order = np.argsort(new_mark)
        new_mark, new_place, new_at = new_mark[order], new_place[order], new_at[order]
        # within the block, the first of equals stays
        new_mark, new_place, new_at = settle(data, new_mark, new_place, new_at, covered)
        # against what is merged: binary search
        if len(mark):
            found = np.minimum(np.searchsorted(mark, new_mark), len(mark) - 1)
            hit = mark[found] == new_mark
            if hit.any():
                both = np.concatenate([new_mark[hit], mark[found[hit]]]), np.concatenate([new_place[hit], place[found[hit]]]), np.concatenate([new_at[hit], at[found[hit]]])
                keep = np.ones(len(mark), bool)
                keep[found[hit]] = False
                order = np.argsort(both[0])
                both = settle(data, *(x[order] for x in both), covered)
                mark, place, at = mark[keep], place[keep], at[keep]
                new_mark, new_place, new_at = (np.concatenate([x[~hit], y]) for x, y in zip((new_mark, new_place, new_at), both))
            order = np.argsort(np.concatenate([mark, new_mark]), kind="stable")
            mark, place, at = (np.concatenate(x)[order] for x in ((mark, new_mark), (place, new_place), (at, new_at)))
        else:
            mark, place, at = new_mark, new_place, new_at
        lo = hi
    return np.concatenate(covered) if covered else np.zeros(0, np.int64)


def settle(data, mark, place, at, covered: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows sorted by fingerprint, drop those equal to an earlier one; their places join covered.

    Different windows of one fingerprint (which chance hardly makes) are kept apart by giving them other fingerprints.
    """
    if not len(mark):
        return mark, place, at
    edge = np.flatnonzero(changes(mark))
    if len(edge) == len(mark):
        return mark, place, at
    times = np.diff(np.append(edge, len(mark)))
    leads = place == np.repeat(np.minimum.reduceat(place, edge), times)  # one of each fingerprint, as places differ
    lead, rest = np.repeat(np.flatnonzero(leads), times), np.flatnonzero(~leads)
    same = same_bytes(data, at[rest], at[lead[rest]])
    if not same.all():
        mark = mark.copy()
        for k in rest[~same].tolist():
            mark[k] = xxhash.xxh3_64_intdigest(data[at[k] : at[k] + LENGTH].tobytes())
        order = np.argsort(mark)
        return settle(data, mark[order], place[order], at[order], covered)
    covered.append(place[rest])
    return mark[leads], place[leads], at[leads]


# --- step 4

_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("tag", pa.int64())])


def cut_spans(with_kept: bool, with_tag: bool = False):
    schema = pa.schema([f for f in _RESULT if f.name not in ("kept", "tag") or (f.name == "kept" and with_kept) or (f.name == "tag" and with_tag)])

    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        keys, found, _ = unpack_all(spans.column("blob").to_pylist(), SPAN)
        of: dict[tuple[int, int], list[int]] = {}
        named = keys.tolist()
        for d, members in by_part(found["doc"].astype(np.int64)):
            of.setdefault(named[d], []).extend(members.tolist())
        rows, first = [], earliest(docs)
        for i, t in zip(docs.column("doc_id").to_pylist(), docs.column("text").cast(pa.binary()).to_pylist()):
            key = _FIRST if i is None else i
            members = of.get((key, tag_of(t))) if of else None
            if key > first[t] and len(t) >= LENGTH:  # an equal text is earlier
                row = (i, len(t), len(t), 1, hashlib.sha256().hexdigest(), b"")
            elif not members:
                row = (i, len(t), 0, 0, hashlib.sha256(t).hexdigest(), t)
            else:
                own = found[members]
                own = own[np.argsort(own["start"], kind="stable")]
                a, b = merged_intervals(own["start"].astype(np.int64), own["end"].astype(np.int64))
                kept = b"".join(t[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(t)]))
                row = (i, len(t), len(t) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), kept)
            rows.append((row if with_kept else row[:5]) + ((tag_of(t),) if with_tag else ()))
        return pa.Table.from_batches([_table(rows, schema)])

    return run


def suffix_dedup(docs: DataFrame, with_kept: bool = False, hot: int = HOT) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_kept adds the bytes that stay."""
    docs = ids_and_text(docs)
    key = F.xxhash64(F.coalesce("doc_id", F.lit(_FIRST)), F.xxhash64("text"))
    repeated = hot_keys(docs.select(key.alias("key")), "key")
    if repeated is None:
        return _suffix_dedup(docs, with_kept, hot)
    keyed = docs.withColumn("key", key)
    often = keyed.join(F.broadcast(repeated), F.col("key") == F.col("__hot"), "left_semi")
    rest = keyed.join(F.broadcast(repeated), F.col("key") == F.col("__hot"), "left_anti").select("doc_id", "text")
    one = often.groupBy("doc_id", "text").agg(F.lit(0).alias("n")).select("doc_id", "text")
    result = written(_suffix_dedup(written(rest.unionByName(one), "suffix-rows"), with_kept, hot, with_tag=True), "suffix-result")
    told = result.withColumn("key", F.xxhash64(F.coalesce("doc_id", F.lit(_FIRST)), F.col("tag")))
    few = told.join(F.broadcast(repeated), F.col("key") == F.col("__hot"), "left_semi")
    few = few.select("key", F.col("doc_id").alias("of"), F.col("tag").alias("of_tag"), *result.columns[1:-1])
    rows = often.select("doc_id", F.xxhash64("text").alias("tag"), "key")
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tag") == F.col("of_tag"))
    again = join_spread(rows, few, "key", repeated, ["doc_id"]).where(same).select(*result.columns[:-1])
    return told.join(F.broadcast(repeated), F.col("key") == F.col("__hot"), "left_anti").select(*result.columns[:-1]).unionByName(again)


def _crowds(docs: DataFrame) -> np.ndarray:
    """Texts whose copies are larger than a group, and over how many groups they are spread: fewer than there are groups."""
    tag, size = F.xxhash64("text").alias("tag"), F.sum(F.octet_length("text"))
    many = docs.groupBy(tag).agg(F.count("*").alias("n"), F.ceil(size / GROUP_BYTES).alias("salts")).where("n > 1 AND salts > 1").select("tag", "salts").collect()
    return np.sort(np.array([(r["tag"], r["salts"]) for r in many], CROWD), order="tag")


def _suffix_dedup(docs: DataFrame, with_kept: bool, hot: int, with_tag: bool = False) -> DataFrame:
    spark = docs.sparkSession
    total, crowds = total_text_bytes(docs), _crowds(docs)
    shards, anchor_buckets, merge_buckets = partitions_for(total, GROUP_BYTES), partitions_for(total, ANCHOR_BYTES), partitions_for(total, MERGE_BYTES)
    # a group is a partition of its own number, so no task gets several by chance; their count grows with the data
    asked, travel, home = "bucket int, shard int, blob binary", "target int, kind int, bucket int, place int, blob binary", "shard int, blob binary"
    keyed, salt = docs.withColumn("tag", F.xxhash64("text")), F.lit(0)
    if len(crowds):
        known = spark.createDataFrame(crowds.tolist(), "of long, salts long")
        keyed = keyed.join(F.broadcast(known), F.col("tag") == F.col("of"), "left")
        salt = F.coalesce(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(_FIRST))), F.col("salts")), F.lit(0))
    shard = F.pmod(F.xxhash64("tag", salt.cast("long")), F.lit(shards)).cast("int")
    sharded = keyed.select("doc_id", "text", shard.alias("shard")).repartitionById(shards, "shard")
    spread = spark.sparkContext.broadcast(crowds)
    told = sharded.groupBy("shard").applyInArrow(report_anchors(anchor_buckets), asked)
    told = told.repartitionById(anchor_buckets, "bucket").groupBy("bucket").applyInArrow(count_anchors(hot), asked)
    told = told.repartitionById(shards, "shard").groupBy("shard")
    pieces = sharded.groupBy("shard").cogroup(told).applyInArrow(sort_shards(anchor_buckets, merge_buckets, shards, spread, math.isqrt(shards - 1) + 1), travel)
    for last, columns in ((False, travel), (True, home)):  # a bucket gets a hot string from some root of all groups at a time, then from as many such parts
        pieces = pieces.repartitionById(merge_buckets, "target").groupBy("target").applyInArrow(merge_pieces(merge_buckets, shards, spread, last), columns)
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_kept else "") + (", tag long" if with_tag else "")
    return sharded.groupBy("shard").cogroup(pieces.repartitionById(shards, "shard").groupBy("shard")).applyInArrow(cut_spans(with_kept, with_tag), result)
