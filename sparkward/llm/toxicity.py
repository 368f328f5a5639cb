"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Labels are learnt only from rows whose crc32(doc_id as text) mod 3 is not 1. Of these a sample of at most SAMPLE_ROWS,
those with the least hashed ids, fits the classifier: first a lexicon of words and word stems that set toxic texts
apart, then trees over features computed with it, then an isotonic map from out-of-fold margins to probabilities: each
fold's margins come from a lexicon and trees that have seen none of its labels. Language, source and id are no
features. Then every whole text is scored in one pass, without a shuffle. What is broadcast or collected is bounded:
the sampled ids, their features, the lexicons (LEXICON_TERMS each) and the trees.

Features: lexicon densities (whole words, stems, weighted, distinct), second-person proximity, capitals, punctuation,
obfuscation (digits or symbols inside words, stretched letters, lexicon words that show after undoing these).

Defined results: a null text counts as empty and is scored too. Null and repeated doc_ids each give a row (a null
doc_id isn't held out); labels of null or unknown doc_ids, and null labels, teach nothing; if a doc_id is labelled
repeatedly its largest label counts, and of different texts under one doc_id the one of least hash teaches. Without any usable labels every score is 0. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, ids_and_text, written

SAMPLE_ROWS = 12_000
LEXICON_TERMS = 600
CANDIDATE_TERMS = 20_000
STEM_LENGTHS = (4, 5, 6)
FOLDS = 3
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[0-9@$*!|+]+(?=[^\W\d_])")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][.\-*_ ]){3,}[^\W\d_](?!\w)")
_LEET = str.maketrans("013457@$!|+", "oieastasiit")
_SECOND = frozenset("you your yours yourself ur u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
NEAR = 5

FEATURES = ["words", "stems", "weighted", "distinct", "density", "second_person", "near", "capitals", "shouted", "exclaims", "punctuation", "mixed", "stretched", "undone", "length", "word_length"]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


class Lexicon:
    """Words and stems (beginnings of longer words) with their log-odds of toxic text."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.lengths = sorted({len(s) for s in stems}, reverse=True)
        self.memo: dict[str, tuple[float, bool]] = {}

    def weight(self, word: str) -> tuple[float, bool]:
        """Weight, 0 outside of the lexicon, and whether the whole word is in it."""
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            found = self.memo[word] = self._weight(word)
        return found

    def _weight(self, word: str) -> tuple[float, bool]:
        if (w := self.words.get(word)) is not None:
            return w, True
        for n in self.lengths:
            if len(word) >= n and (w := self.stems.get(word[:n])) is not None:
                return w, False
        return 0.0, False


def features(text: str, lexicon: Lexicon) -> list[float]:
    raw = _WORD.findall(text)
    low = _WORD.findall(text.lower())
    n = len(low)
    count = Counter(low)
    hit = {w: x for w in count if (x := lexicon.weight(w))[0] > 0}
    words = sum(count[w] for w, x in hit.items() if x[1])
    stems = sum(count[w] for w, x in hit.items() if not x[1])
    weighted = sum(count[w] * x[0] for w, x in hit.items())
    seconds = sum(count[w] for w in _SECOND & count.keys())
    near = 0
    if hit and seconds:
        at = np.array([i for i, w in enumerate(low) if w in _SECOND])
        own = np.array([i for i, w in enumerate(low) if w in hit])
        left = np.searchsorted(at, own)
        gap = np.minimum(np.abs(own - at[np.maximum(left - 1, 0)]), np.abs(own - at[np.minimum(left, len(at) - 1)]))
        near = int((gap <= NEAR).sum())
    undone = mixed = end = 0
    for m in _MIXED.finditer(text):  # digits or symbols between letters: look at the whole word once
        if m.start() < end or m.start() == 0 or not text[m.start() - 1].isalpha():
            continue
        a = m.start()
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        end = m.end()
        while end < len(text) and not text[end].isspace():
            end += 1
        mixed += 1
        undone += lexicon.weight(re.sub(r"[\W\d_]+", "", text[a:end].lower().translate(_LEET)))[0] > 0
    if sum(len(w) == 1 for w in low) > 3:
        for m in _SPACED.finditer(text):
            undone += lexicon.weight(re.sub(r"[\W_]+", "", m.group().lower()))[0] > 0
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    triple = (codes[2:] == codes[1:-1]) & (codes[1:-1] == codes[:-2]) if len(codes) > 2 else np.zeros(0, bool)
    stretched = int((np.diff(np.concatenate([[0], (triple & (codes[2:] >= 65) & (((codes[2:] | 32) - 97) < 26)).astype(np.int8)])) == 1).sum()) if triple.any() else 0
    letters = sum(map(len, raw))
    mixed_case = [w for w in raw if not w.islower()]
    upper = sum(sum(map(str.isupper, w)) for w in mixed_case)
    marks = len(text) - letters - text.count(" ") - text.count("\n")
    per = 100 / (n or 1)
    return [
        float(words), float(stems), weighted, float(len(hit)), (words + stems) * per, seconds * per, float(near), upper / (letters or 1), sum(len(w) > 2 and w.isupper() for w in mixed_case) * per,
        (text.count("!") + text.count("?")) * per, marks / (len(text) or 1), mixed * per, stretched * per, float(undone), math.log1p(n), letters / (n or 1),
    ]


class Trees:
    """Boosted regression trees on binned features, logistic loss; complete trees of one depth, grown level by level."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, m = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)])
        rate = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.start = math.log(rate / (1 - rate))
        margin, self.trees = np.full(n, self.start), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, split = np.zeros(2**self.depth, np.int64), np.full(2**self.depth, self.bins, np.int64)
            for level in range(self.depth):
                width = 2**level
                best = np.full(width, 1e-9)
                for j in range(m):
                    cell = node * self.bins + binned[:, j]
                    gs = np.bincount(cell, g, width * self.bins).reshape(width, self.bins).cumsum(1)
                    hs = np.bincount(cell, h, width * self.bins).reshape(width, self.bins).cumsum(1)
                    ga, ha = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (ga - gs) ** 2 / (ha - hs + self.ridge) - ga**2 / (ha + self.ridge)
                    gain[(hs < self.least / 10) | (ha - hs < self.least / 10)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(width), at]
                    better = top > best
                    slots = width + np.flatnonzero(better)
                    feature[slots], split[slots], best[better] = j, at[better], top[better]
                slot = width + node
                node = node * 2 + (binned[np.arange(n), feature[slot]] > split[slot])
            leaves = 2**self.depth
            value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge)
            margin += value[node]
            self.trees.append((feature, split, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)]) if len(x) else np.zeros((0, x.shape[1]), np.int64)
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, split, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                slot = 2**level + node
                node = node * 2 + (binned[rows, feature[slot]] > split[slot])
            out += value[node]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (margin, probability) of the best non-decreasing map."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # weight, mean, first margin, last margin
    for x, v in zip(margin[order].tolist(), y[order].tolist()):
        blocks.append([1.0, float(v), x, x])
        while len(blocks) > 1 and (blocks[-2][1] >= blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            w, v2, _, b = blocks.pop()
            top = blocks[-1]
            top[1] = (top[0] * top[1] + w * v2) / (top[0] + w)
            top[0] += w
            top[3] = b
    xs = np.array([e for b in blocks for e in (b[2], b[3])])
    ps = np.array([b[1] for b in blocks for _ in range(2)])
    return xs, ps


class Model:
    def __init__(self, lexicon: Lexicon, trees: Trees | None, knots: tuple[np.ndarray, np.ndarray] | None):
        self.lexicon, self.trees, self.knots = lexicon, trees, knots

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(texts))
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(len(texts), len(FEATURES))
        margin = self.trees.margin(x)
        # a little of the margin itself keeps the order within a step of the map
        return np.clip(0.995 * np.interp(margin, *self.knots) + 0.005 / (1 + np.exp(-margin)), 0, 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most that many labelled rows that aren't held out."""
    usable = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    total = usable.count()
    if total > rows:  # thin by hash first, so that the sort sees little more than what it keeps
        usable = usable.where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * rows / total + 50 / total)))
    few = usable.orderBy("h", "doc_id").limit(rows).select("doc_id", "toxic")  # so broadcasting it is bounded
    texts = ids_and_text(docs).join(F.broadcast(few), "doc_id")
    one = texts.groupBy("doc_id").agg(F.min_by(F.struct("text", "toxic"), F.xxhash64("text")).alias("r")).select("doc_id", "r.*")
    return written(one.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int")), "toxicity-sample")


def learn_lexicons(sample: DataFrame) -> list[Lexicon]:
    """Lexicons from all folds but 0, but 1 and so on, and at last from the whole sample. Terms are counted once, by fold."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, bool], list[int]] = {}
        for batch in batches:
            for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold"))):
                words = {w.lower() for w in _WORD.findall(text)}
                stems = {w[:n] for w in words for n in STEM_LENGTHS if len(w) > n}
                for term in [(w, False) for w in words if len(w) > 2] + [(s, True) for s in stems]:
                    counts.setdefault(term, [0] * 2 * FOLDS)[2 * fold + toxic] += 1
        terms = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in terms], pa.string()), pa.array([s for _, s in terms], pa.bool_()), *(pa.array([counts[t][k] for t in terms], pa.int64()) for k in range(2 * FOLDS))], names)

    names = ["term", "stem", *(f"{kind}{k}" for k in range(FOLDS) for kind in ("clean", "toxic"))]
    totals = Counter({(r["fold"], r["toxic"]): r["count"] for r in sample.groupBy("fold", "toxic").count().collect()})
    schema = "term string, stem boolean, " + ", ".join(f"{c} long" for c in names[2:])
    terms = written(sample.select("text", "toxic", "fold").mapInArrow(count, schema).groupBy("term", "stem").agg(*[F.sum(c).alias(c) for c in names[2:]]), "toxicity-terms")
    lexicons = []
    for without in [*range(FOLDS), None]:
        folds = [k for k in range(FOLDS) if k != without]
        clean, toxic = (sum(totals[k, kind] for k in folds) for kind in (0, 1))
        summed = terms.select("term", "stem", *[sum((F.col(f"{kind}{k}") for k in folds), F.lit(0)).alias(kind) for kind in ("clean", "toxic")])
        odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
        rows = summed.where("toxic >= 3").withColumn("odds", odds).where("odds > 2.5").orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term", "stem").limit(LEXICON_TERMS).collect()
        lexicons.append(Lexicon({r["term"]: r["odds"] for r in rows if not r["stem"]}, {r["term"]: r["odds"] for r in rows if r["stem"]}))
    dropped(terms)
    return lexicons


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample = labelled_sample(docs, labels)
    lexicons = learn_lexicons(sample)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [[v for lexicon in lexicons for v in features(t, lexicon)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "toxic", "fold")), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "toxic", "fold", "x"])

    rows = sample.mapInArrow(compute, "doc_id long, toxic int, fold int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    dropped(sample)
    y, fold = rows["toxic"].to_numpy(np.float64), rows["fold"].to_numpy()
    if len(set(y.tolist())) < 2:
        return Model(lexicons[-1], None, None)
    x = np.array(rows["x"].tolist()).reshape(len(y), FOLDS + 1, len(FEATURES))
    margins = np.zeros(len(y))
    for k in range(FOLDS):
        train = fold != k
        if train.any() and not train.all():
            margins[~train] = Trees().fit(x[train, k], y[train]).margin(x[~train, k])
    return Model(lexicons[-1], Trees().fit(x[:, -1], y), isotonic(margins, y))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    model = fit(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = ids_and_text(docs).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
