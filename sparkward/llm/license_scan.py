"""License scans: fuzzy search for short notices.

A notice that may have k edits is split into k+1 seeds; however the edits fall, one seed stays intact (pigeonhole), so
exact search for the seeds finds every candidate. The regex library's bounded-error matching then verifies a window
around a few neighbouring candidates, part by part (the part that names the license may have fewer edits than the words
around it), and gives the span and its edits. Windows are of bounded length, so a text takes time linear in its length,
however often it repeats a notice. Texts are compared as words: lower-cased A-Z, runs of letters, digits and non-ASCII
characters, joined by single spaces. One pass over the texts, no shuffle.

Exact phrases (BASE) are found beside this, at all places.

Defined results: a null text counts as empty: no words, no labels, score 0. Null and repeated doc_ids each give a row.
An empty table gives an empty table. Columns other than doc_id and text aren't read. Texts are searched whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import ids_and_text

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label, then the parts of a notice with the edits each may have.
NOTICES: list[tuple[str, list[tuple[str, int]]]] = [
    ("mit", [("released under the ", 2), ("mit", 0), (" license", 2)]),
    ("mit", [("licensed under the ", 2), ("mit", 0), (" license", 2)]),
    ("mit", [("permission is hereby granted free of charge to any person obtaining a copy", 6)]),
    ("apache-2", [("licensed under the ", 2), ("apache", 1), (" license version ", 2), ("2", 0)]),
    ("gpl-3", [("licensed under the ", 2), ("gnu general public", 2), (" license version ", 2), ("3", 0)]),
    ("gpl-2", [("licensed under the ", 2), ("gnu general public", 2), (" license version ", 2), ("2", 0)]),
    ("lgpl", [("gnu lesser general public", 3), (" license", 1)]),
    ("agpl", [("gnu affero general public", 3), (" license", 1)]),
    ("bsd", [("redistribution and use in source and binary forms with or without modification", 6)]),
    ("mpl-2", [("subject to the terms of the ", 2), ("mozilla public", 2), (" license v", 1), (" 2", 0)]),
    ("cc-by-nc", [("licensed under ", 2), ("cc by nc", 0), (" 4 0", 1)]),
    ("cc-by-sa", [("licensed under ", 2), ("cc by sa", 0), (" 4 0", 1)]),
    ("cc-by", [("licensed under ", 2), ("cc by 4", 0), (" 0", 1)]),
]


class Notice:
    def __init__(self, label: str, parts: list[tuple[str, int]]):
        self.label, self.text = label, "".join(t for t, _ in parts)
        self.edits = sum(k for _, k in parts)
        edges = [round(i * len(self.text) / (self.edits + 1)) for i in range(self.edits + 2)]
        self.seeds = [(self.text[a:b], a) for a, b in zip(edges, edges[1:])]
        self.pattern = regex.compile("(?b)" + "".join(f"(?:{regex.escape(t)}){{e<={k}}}" for t, k in parts))

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, edits) of all verified places, without overlaps: of places that overlap, that of fewest edits, then the leftmost."""
        starts = set()
        for seed, offset in self.seeds:
            at = text.find(seed)
            while at >= 0:
                starts.add(at - offset)
                at = text.find(seed, at + 1)
        if not starts:
            return []
        # candidates near the first of a window share it, so that a place is seldom searched twice
        reach, found = self.edits, set()
        first = last = None
        for s in [*sorted(starts), None]:
            if first is not None and (s is None or s - first > len(self.text)):
                found.update(self._within(text, max(0, first - reach), last + len(self.text) + 2 * reach))
                first = None
            first, last = s if first is None else first, s
        held = Held()
        return sorted(x for x in sorted(found, key=lambda x: (x[2], x)) if held.free(x[0], x[1]) and held.add(x[0], x[1], None))

    def _within(self, text: str, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """The best place of a window, then those before and after it."""
        stretches = [(a, min(b, len(text)))]
        least = len(self.text) - self.edits  # nothing shorter matches
        while stretches:
            a, b = stretches.pop()
            if b - a >= least and (m := self.pattern.search(text[a:b])):
                s, e = a + m.start(), a + m.end()
                yield s, e, sum(m.fuzzy_counts)
                stretches += (a, s), (e, b)


class Held:
    """Spans by their start, none longer than the longest notice with its edits."""

    LONGEST = max(sum(len(t) + k for t, k in parts) for _, parts in NOTICES)

    def __init__(self):
        self.spans: list[tuple[int, int, str | None]] = []

    def free(self, a: int, b: int, label: str | None = None) -> bool:
        """Whether no span of another label meets a:b."""
        for k in range(bisect_left(self.spans, (a - self.LONGEST,)), len(self.spans)):
            x, y, other = self.spans[k]
            if x >= b:
                return True
            if y > a and (label is None or other != label):
                return False
        return True

    def add(self, a: int, b: int, label: str | None) -> bool:
        insort(self.spans, (a, b, label))
        return True


_COMPILED = [Notice(label, parts) for label, parts in NOTICES]
_BASE = [(f" {phrase} ", label) for phrase, label in BASE.items()]


def scan_text(text: str) -> dict:
    """All that the operator reports of one text; spans are (label, start, end, edits) in code points of the text."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    words = _WORD.findall(low)
    joined = " ".join(words)
    padded = f" {joined} "
    places, base = [], set()
    starts: list[int] = []  # of words in joined

    def word_at(at: int) -> int:
        if not starts:
            starts.extend(accumulate((len(w) + 1 for w in words), initial=0))
        return bisect_right(starts, at) - 1

    for phrase, label in _BASE:
        at = padded.find(phrase)
        while at >= 0:
            places.append(word_at(at))
            base.add(label)
            at = padded.find(phrase, at + 1)
    found = []
    for notice in _COMPILED:
        found += [(notice, *x) for x in notice.search(joined)]
    # of notices that claim the same place, the one with the fewest edits for its length holds it
    found.sort(key=lambda x: (x[3] / len(x[0].text), x[1], -x[2], x[0].label))
    claimed = Held()
    held = [x for x in found if claimed.free(x[1], x[2], x[0].label) and claimed.add(x[1], x[2], x[0].label)]
    spans = []
    if held:
        where = [m.span() for m in _WORD.finditer(low)]
        for notice, a, b, edits in held:
            last = word_at(max(a, b - 1))
            spans.append((notice.label, where[word_at(a)][0], where[min(last, len(where) - 1)][1], edits))
    score = 1.0 if base else max([1 - edits / len(n.text) for n, _, _, edits in held], default=0.0)
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {n.label for n, *_ in held})), "score": score, "spans": sorted(spans, key=lambda s: (s[1], s[2], s[0])),
    }


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: int, end: int, edits: int>>"
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
_TYPES = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [scan_text(t) for t in batch.column("text").to_pylist()]
        spans = [[dict(zip(("label", "start", "end", "edits"), s)) for s in r["spans"]] for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in _TYPES.items()), pa.array(spans, _SPANS)], ["doc_id", *_TYPES, "spans"])


def license_scan(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, the base places and labels, labels, score (1 for an exact phrase, else the share of the best notice that is unedited), spans."""
    return ids_and_text(docs).mapInArrow(_scan, _SCHEMA)
