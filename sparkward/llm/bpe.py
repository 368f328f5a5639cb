"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words, counted over the whole table, are compiled with their token ids into the minimal acyclic automaton of
the word list (equal suffixes share states). Each transition carries a number, and the numbers along a word's path add
up to the word's index, under which its ids are stored: the automaton is a transducer from words to ids. It is one
flat file of arrays, handed to the executors by Spark and memory-mapped there, so that workers of a machine share it.
Words that it doesn't hold are merged exactly, pair by pair in rank order. The lexicon only saves time: it holds what
merging gives.

Words of a batch are told apart first; each distinct word is walked or merged once, and the ids of all texts are then
gathered by index. Two passes over the texts, no shuffle of texts.

Words are counted wholly: a task hands its counts on whenever it holds PARTIAL_WORDS different words, and they are added up
by word, so the lexicon doesn't depend on how rows are dealt to tasks.

Defined results: a null text counts as empty and has no ids. Null and repeated doc_ids each give a row. An empty table
gives an empty table. Columns other than doc_id and text aren't read. Texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import array
import hashlib
import heapq
import io
import itertools
import json
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, ids_and_text, new_table_path, written

LEXICON_WORDS = 1 << 16
PARTIAL_WORDS = 200_000  # different words that a task counts before it hands the counts on
NO_RANK = 1 << 40
MEMO_WORDS = 200_000  # words merged by one worker that it remembers; the memo starts anew when full

_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

#: The same for texts of ASCII alone, which the plain expressions split in half the time.
_SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    table.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return table


def _pair_table(merges: dict[tuple[int, int], tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merges as an open-addressed table of keys, ranks and results, for lookups of many pairs at once."""
    slots = 1 << max(8, (4 * len(merges)).bit_length())
    keys, ranks, results = np.full(slots, -1, np.int64), np.full(slots, NO_RANK, np.int64), np.zeros(slots, np.int64)
    named = np.array([a << 32 | b for a, b in merges], np.int64)
    taken, places = set(), []
    for at in _slot(named, slots).tolist():
        while at in taken:
            at = (at + 1) & (slots - 1)
        taken.add(at)
        places.append(at)
    keys[places], ranks[places], results[places] = named, [r for r, _ in merges.values()], [t for _, t in merges.values()]
    return keys, ranks, results


def _slot(keys: np.ndarray, slots: int) -> np.ndarray:
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - (slots - 1).bit_length())).astype(np.int64)


class Vocabulary:
    """A byte-level BPE vocabulary as its file tells it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, table = told["model"], _byte_of_char()
        pieces = {i: bytes(table[c] for c in t) if all(c in table for c in t) else t.encode() for t, i in model["vocab"].items()}
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        pieces.update({i: s.encode() for s, i in self.special.items()})
        self.byte_ids = [vocab[c] for c, _ in sorted(table.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self._table = _pair_table(self.merges)
        self._of_byte = np.array(self.byte_ids, np.int64)
        size = max(pieces) + 1
        lengths = np.zeros(size, np.int64)
        for i, p in pieces.items():
            lengths[i] = len(p)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.bytes = np.frombuffer(b"".join(pieces.get(i, b"") for i in range(size)), np.uint8)
        self.words = regex.compile(_SPLIT)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def split(self, text: str) -> list[str]:
        """The words of a text; special tokens come as words of their own."""
        findall = _SPLIT_ASCII.findall if text.isascii() else self.words.findall
        if self.specials is None or not any(s in text for s in self.special):
            return findall(text)
        out = []
        for k, part in enumerate(self.specials.split(text)):
            out += [part] if k % 2 else findall(part)
        return out

    def merge(self, word: str) -> list[int]:
        """The ids of one word: always the pair of lowest rank is merged, the leftmost of equals."""
        if word in self.special:
            return [self.special[word]]
        ids = [self.byte_ids[b] for b in word.encode("utf-8", "surrogatepass")]
        if len(ids) > 40:
            return self._merge_long(ids)
        merges = self.merges
        while len(ids) > 1:
            best, at, to = 1 << 30, -1, 0
            for i, pair in enumerate(zip(ids, ids[1:])):
                found = merges.get(pair)
                if found is not None and found[0] < best:
                    best, at, to = found[0], i, found[1]
            if at < 0:
                break
            ids[at : at + 2] = [to]
        return ids

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NO_RANK if there is none) and result of the pairs a[i], b[i]."""
        keys, ranks, results = self._table
        key = a << 32 | b
        at = _slot(key, len(keys))
        open_ = np.flatnonzero((keys[at] != key) & (keys[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(keys) - 1)
            open_ = open_[(keys[at[open_]] != key[open_]) & (keys[at[open_]] >= 0)]
        hit = keys[at] == key
        return np.where(hit, ranks[at], NO_RANK), results[at]

    def merge_many(self, words: list[str]) -> list[np.ndarray]:
        """merge() of many words."""
        ids, lengths = self.merge_flat(words)
        return np.split(ids, np.cumsum(lengths)[:-1]) if words else []

    def merge_flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """merge() of many words: their ids, one word after another, and how many each has. Each round merges one pair in
        every word that still has one."""
        done: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]  # words and their ids
        short = []
        for k, w in enumerate(words):
            if not 0 < len(w) <= 40 or w in self.special:
                own = np.array(self.merge(w), np.int64)
                done.append((np.full(len(own), k), own))
            else:
                short.append(k)
        coded = [words[k].encode("utf-8", "surrogatepass") for k in short]
        ids = self._of_byte[np.frombuffer(b"".join(coded), np.uint8)]
        word = np.repeat(np.array(short, np.int64), np.fromiter(map(len, coded), np.int64, len(coded)))
        rank, to = np.full(len(ids), NO_RANK), np.zeros(len(ids), np.int64)
        if len(ids):
            rank[:-1], to[:-1] = self._ranks(ids[:-1], ids[1:])
            rank[:-1][word[1:] != word[:-1]] = NO_RANK
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            length = np.diff(np.append(first, len(word)))
            best = np.minimum.reduceat(rank, first)
            over = best == NO_RANK
            if over.any():
                live = ~np.repeat(over, length)
                done.append((word[~live], ids[~live]))
                ids, word, rank, to = ids[live], word[live], rank[live], to[live]
                best, length = best[~over], length[~over]
                if not len(ids):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, length))
            at = hits[np.concatenate([[True], word[hits][1:] != word[hits][:-1]])]  # the leftmost of each word
            ids[at] = to[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            ids, word, rank, to = ids[keep], word[keep], rank[keep], to[keep]
            touched = np.zeros(len(ids), bool)
            touched[at] = touched[np.maximum(at - 1, 0)] = True
            changed = np.flatnonzero(touched)
            follows = np.minimum(changed + 1, len(ids) - 1)
            rank[changed], to[changed] = self._ranks(ids[changed], ids[follows])
            rank[changed[(follows == changed) | (word[follows] != word[changed])]] = NO_RANK
        of, merged = (np.concatenate(x) for x in zip(*done))
        return merged[np.argsort(of, kind="stable")].astype(np.uint32), np.bincount(of, minlength=len(words)).astype(np.int64)

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over linked neighbours, in n log n."""
        n = len(ids)
        after, before, merges = [*range(1, n), -1], [-1, *range(n - 1)], self.merges
        heap = [(*found, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (found := merges.get((a, b)))]
        heap = [(rank, i, to, a, b) for rank, to, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, to, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = to, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := merges.get((to, ids[k])):
                    heapq.heappush(heap, (found[0], i, found[1], to, ids[k]))
            if (k := before[i]) >= 0 and (found := merges.get((ids[k], to))):
                heapq.heappush(heap, (found[0], k, found[1], ids[k], to))
        return [x for x in ids if x >= 0]


class Transducer:
    """keys: state * 256 + byte, sorted; to, add: the transition's target and number; final states; ids by word index."""

    FIELDS = ("keys", "to", "add", "final", "offsets", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, words: list[bytes], ids: Callable[[bytes], list[int]]) -> Transducer:
        """Incremental construction from sorted words: a finished suffix joins an equal one seen before."""
        words = sorted(set(words))
        edges: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path = [0]  # states along the last word
        last = b""

        def finish(down_to: int) -> None:
            while len(path) - 1 > down_to:
                state = path.pop()
                key = (final[state], *edges[state].items())
                same = register.setdefault(key, state)
                if same != state:
                    edges[path[-1]][last[len(path) - 1]] = same

        for word in words:
            common = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
            finish(common)
            for b in word[common:]:
                edges.append({})
                final.append(False)
                edges[path[-1]][b] = len(edges) - 1
                path.append(len(edges) - 1)
            final[path[-1]] = True
            last = word
        finish(0)
        count: dict[int, int] = {}  # words that can be completed from a state
        order, seen, stack = [], set(), [0]
        while stack:
            state = stack.pop()
            if state >= 0:
                if state not in seen:
                    seen.add(state)
                    stack += [~state, *edges[state].values()]
            else:
                order.append(~state)
        for state in order:
            count[state] = final[state] + sum(count[t] for t in edges[state].values())
        number = {s: k for k, s in enumerate(sorted(seen))}
        keys, to, add = [], [], []
        for state in sorted(seen):
            upto = int(final[state])
            for b in sorted(edges[state]):
                keys.append(number[state] * 256 + b)
                to.append(number[edges[state][b]])
                add.append(upto)
                upto += count[edges[state][b]]
        out = [ids(w) for w in words]
        arrays = {
            "keys": np.array(keys, np.int64), "to": np.array(to, np.int32), "add": np.array(add, np.int32), "final": np.array([final[s] for s in sorted(seen)], np.int8),
            "offsets": np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64), "ids": np.array([i for x in out for i in x], np.uint32),
        }
        return cls(arrays)

    def dump(self) -> bytes:
        """One flat file: a header of lengths, then the arrays, each at a multiple of 8 bytes."""
        out, head = io.BytesIO(), []
        for name in self.FIELDS:
            a = np.ascontiguousarray(getattr(self, name))
            head.append([name, a.dtype.str, len(a), out.tell()])
            out.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
        told = json.dumps(head).encode()
        return len(told).to_bytes(8, "little") + told + b"\0" * (-len(told) % 8) + out.getvalue()

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        whole = np.memmap(path, np.uint8, "r")
        n = int.from_bytes(whole[:8].tobytes(), "little")
        start = 8 + n + (-n % 8)
        head = json.loads(whole[8 : 8 + n].tobytes())
        return cls({name: whole[start + at : start + at + size * np.dtype(kind).itemsize].view(kind) for name, kind, size, at in head})

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """The index of each word, or -1; all words step at once."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        data = np.frombuffer(b"".join(words), np.uint8)
        state, index = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if not len(self.keys):
            return np.where((lengths == 0) & bool(len(self.final) and self.final[0]), 0, -1)
        live, at = np.flatnonzero(lengths > 0), 0
        while len(live):
            key = state[live] * 256 + data[starts[live] + at]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[found] == key
            state[live[~ok]] = -1
            live, found = live[ok], found[ok]
            state[live] = self.to[found]
            index[live] += self.add[found]
            at += 1
            live = live[lengths[live] > at]
        done = (state >= 0) & (self.final[np.maximum(state, 0)] == 1)
        return np.where(done, index, -1)


class Encoder:
    """Encodes lists of texts; ids of unseen words are merged and remembered, within MEMO_WORDS."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer | None = None):
        self.vocabulary = vocabulary
        self.lexicon = lexicon if lexicon is not None else Transducer.build([], lambda w: [])
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.memo_ids, self.memo_offsets = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        merged, lengths = self.vocabulary.merge_flat(words)
        self.memo.update(zip(words, range(len(self.memo), len(self.memo) + len(words))))
        self.memo_ids = np.concatenate([self.memo_ids, merged])
        self.memo_offsets = np.concatenate([self.memo_offsets, self.memo_offsets[-1] + np.cumsum(lengths)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, one after another, and the offsets at which each text's begin."""
        codes: dict[str, int] = defaultdict(itertools.count().__next__)  # a new word gets the next number
        sizes, sequence = [], array.array("q")
        for text in texts:
            words = self.vocabulary.split(text)
            sizes.append(len(words))
            sequence.extend(map(codes.__getitem__, words))
        seq = np.frombuffer(sequence, np.int64)
        words = list(codes)
        index = self.lexicon.lookup([w.encode("utf-8", "surrogatepass") for w in words])
        known = index >= 0
        unseen = [words[k] for k in np.flatnonzero(~known).tolist()]
        if len(self.memo) > MEMO_WORDS:
            self._forget()
        self._learn([w for w in unseen if w not in self.memo])
        slots = np.fromiter(map(self.memo.__getitem__, unseen), np.int64, len(unseen))
        own = self.lexicon.ids
        begin, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        begin[known], length[known] = self.lexicon.offsets[index[known]], np.diff(self.lexicon.offsets)[index[known]]
        begin[~known], length[~known] = self.memo_offsets[slots] + len(own), np.diff(self.memo_offsets)[slots]
        ids = gather(np.concatenate([own, self.memo_ids]), begin[seq], length[seq])
        word_ends = np.concatenate([[0], np.cumsum(length[seq])])
        return ids, word_ends[np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64)]


def gather(pool: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """pool[begin[i] : begin[i] + length[i]] of all i, one after another."""
    ends = np.cumsum(length)
    if not len(ends) or not ends[-1]:
        return pool[:0]
    return pool[np.arange(ends[-1]) + np.repeat(begin - ends + length, length)]


def decode_bytes(vocabulary: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that the ids stand for, and the offsets at which each text's begin."""
    lengths = vocabulary.offsets[ids + 1] - vocabulary.offsets[ids]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return gather(vocabulary.bytes, vocabulary.offsets[ids], lengths), ends[offsets]


_loaded: dict[str, Vocabulary] = {}


def load(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def frequent_words(docs: DataFrame, vocabulary_path: str, words: int = LEXICON_WORDS, at_once: int = PARTIAL_WORDS) -> list[str]:
    """The most frequent words of the whole table under 100 characters, at most that many: those of a count that no more words
    have or exceed. What reaches the driver is bounded by it."""
    shipped = share_vocabulary(docs.sparkSession, vocabulary_path)

    def told(counts: Counter) -> pa.RecordBatch:
        short = [(w, n) for w, n in counts.items() if len(w) < 100]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in short], pa.string()), pa.array([n for _, n in short], pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = load(SparkFiles.get(shipped)).split, Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(split(text))
                if len(counts) >= at_once:
                    yield told(counts)
                    counts.clear()
        yield told(counts)

    counted = ids_and_text(docs).select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    several = written(counted.where("n > 1"), "words")  # a word that stands once is merged once either way
    found = several.where(F.col("n") >= least_count(several, words)).collect()
    dropped(several)
    return [r["word"] for r in sorted(found, key=lambda r: (-r["n"], r["word"]))]


def least_count(counted: DataFrame, most: int, cells: int = 1000) -> int:
    """The least count which at most so many words have or exceed: by histograms of so many cells, each over the cell of
    the last one in which it lies, so that the driver gets no more than these, however many words there are."""
    low, high, above = 1, (counted.agg(F.max("n")).first()[0] or 0) + 1, 0
    while low < high:
        width = -(-(high - low) // cells)
        cell = F.floor((F.col("n") - low) / width).cast("long").alias("cell")
        sizes = {r["cell"]: r["n_words"] for r in counted.where(F.col("n").between(low, high - 1)).groupBy(cell).agg(F.count("*").alias("n_words")).collect()}
        for k in sorted(sizes, reverse=True):
            if above + sizes[k] > most:
                low, high = low + k * width, min(high, low + (k + 1) * width)
                break
            above += sizes[k]
        else:
            return low
        if width == 1:
            return low + 1
    return low


def share_file(spark: SparkSession, content: bytes, stem: str) -> str:
    """Put a small file into the shared folder and have Spark hand it to all executors; its name there."""
    jvm = spark.sparkContext._jvm
    path = new_table_path(spark, stem)
    to = jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(to)
    for i in range(0, len(content), 1 << 20):
        out.write(content[i : i + (1 << 20)])
    out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


_shared: dict[tuple[str, str], str] = {}


def share_vocabulary(spark: SparkSession, path: str) -> str:
    """Hand the driver's vocabulary file to all executors, once in an application; its name there."""
    with open(path, "rb") as f:
        content = f.read()
    key = spark.sparkContext.applicationId, hashlib.sha256(content).hexdigest()
    if key not in _shared:
        _shared[key] = share_file(spark, content, "vocabulary")
    return _shared[key]


def build_lexicon(docs: DataFrame, vocabulary_path: str, words: int = LEXICON_WORDS) -> str:
    vocabulary = load(vocabulary_path)
    often = [w.encode("utf-8") for w in frequent_words(docs, vocabulary_path, words)]
    return share_file(docs.sparkSession, Transducer.build(often, lambda w: vocabulary.merge(w.decode("utf-8"))).dump(), "lexicon")


def slices(batch: pa.RecordBatch, rows: int = 1000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most so many rows, and bytes of text unless one text has more."""
    lengths = pc.binary_length(batch.column("text").cast(pa.large_binary())).to_pylist()
    a = total = 0
    for b, n in enumerate(lengths):
        if b > a and (b - a == rows or total + n > size):
            yield batch.slice(a, b - a)
            a, total = b, 0
        total += n
    if a < len(lengths):
        yield batch.slice(a)


def bpe_round_trip(docs: DataFrame, vocabulary_path: str, with_ids: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids adds ids and the decoded text."""
    lexicon, shipped = build_lexicon(docs, vocabulary_path), share_vocabulary(docs.sparkSession, vocabulary_path)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if with_ids else []

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(SparkFiles.get(shipped))
        encoder = Encoder(vocabulary, Transducer.mapped(SparkFiles.get(lexicon)))
        for batch in batches:
            for part in slices(batch):
                ids, offsets = encoder.encode(part.column("text").to_pylist())
                data, ends = decode_bytes(vocabulary, ids, offsets)
                raw, text = memoryview(ids.astype("<u4", copy=False)).cast("B"), memoryview(data)
                spans, places = list(zip(offsets[:-1].tolist(), offsets[1:].tolist())), list(zip(ends[:-1].tolist(), ends[1:].tolist()))
                columns = [
                    part.column("doc_id"), pa.array([b - a for a, b in spans], pa.int64()),
                    pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in spans], pa.string()),
                    pa.array([hashlib.sha256(text[a:b]).hexdigest() for a, b in places], pa.string()),
                ]
                if with_ids:
                    columns += [pa.array([ids[a:b].tolist() for a, b in spans], pa.list_(pa.int32())), pa.array([bytes(text[a:b]).decode("utf-8", "replace") for a, b in places], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[n for n, _ in fields])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return ids_and_text(docs).mapInArrow(encode, schema)
