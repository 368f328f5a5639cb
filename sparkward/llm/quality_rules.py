"""Quality rules with adaptive thresholds.

Fixed cutoffs give way to fences learned per language and source. Each text's ratios (word length, symbols, repeated
lines, repeated words, stutter) and sizes go into logarithmic quantile sketches: bucket k of a sketch counts the values
in (g^(k-1), g^k], so any quantile is known to a relative error of (g-1)/(g+1), two sketches merge by adding counts,
and the outcome doesn't depend on the order of rows. The sketches are one ordinary aggregation, partial on the map
side, which holds up when one source has a third of all rows. A second pass joins the fences to the texts and filters.

A group's fence comes from its own sketches alone: the median, a spread, and the median size of its texts. The spread is
twice the distance from the lower quartile to the median, which junk in the upper half cannot move, but at least the
width of a bucket there and the share of one symbol (line, word) in a text of median size, as no ratio is known more
finely. These three are drawn to the language's, and the language's to those of all texts, by weights n and PRIOR, so
that small groups lean on large ones without any switch; where a group is mostly junk, LOOSE spreads of its parent bound
its median and LOOSE times its parent's spread its own. A text of size n is rejected if base_failed, or if a ratio lies
more than SPREADS * spread * sqrt(1 + median size / n) above the median (word length: or below), since a short text's
ratios scatter more. No ratio has a fixed cutoff.

Defined results: a null text has no words; it fails the base rule. Null languages and sources are groups like any
other. Repeated rows each get a row. Texts of any length are taken whole. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shielded, text_of, written

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")

GAMMA = 1.04  # quantiles to 2 %
SCALE = 1000  # ratios are kept in thousandths
SPREADS = 8.0  # a fence lies this many spreads from the median
PRIOR = 200.0  # the parent group weighs as much as this many texts
LOOSE = 4.0  # a group's median and spread exceed its parent's by at most this many spreads, or times
#: Ratios, in thousandths, and the size of a text that tells how finely its ratio can be known. A repeated line repeats
#: all its words, so repeated words are counted by lines.
SIZE_OF = {"word_length": "n_words", "symbols": "word_chars", "repeated_lines": "n_lines", "repeated_words": "n_lines", "stutter": "n_words"}
SIZES = ("n_words", "word_chars", "n_lines")
#: Groups of thresholds are broadcast up to this many rows, joined by shuffle beyond.
BROADCAST_ROWS = 20_000
SALTS = 16

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutter"]


def count_text(text: str) -> tuple[int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word), n_stutter (words equal to the one before)."""
    words = _WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    repeated = 0
    if n > 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(windows)) < len(windows):
            first: dict = {}
            twice = set()
            for w in windows:
                if w in first:
                    twice.add(w)
                else:
                    first[w] = 1
            upto = 0
            for i, w in enumerate(windows):
                if w in twice:
                    repeated += i + 5 - max(upto, i)
                    upto = i + 5
    return n, sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated, len(lines), sum(map(eq, words, words[1:]))


def with_counts(docs: DataFrame) -> DataFrame:
    """docs with the counts of count_text added, under names starting with two underscores; one pass, no shuffle."""
    where = docs.columns.index("text")
    schema = docs.select("*", *[F.lit(0).cast("long").alias(f"__{c}") for c in COUNTS]).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [count_text(t or "") for t in batch.column(where).to_pylist()]
            added = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *(f"__{c}" for c in COUNTS)])

    return docs.mapInArrow(count, schema)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.floor(top * SCALE / F.greatest(bottom, F.lit(1)))


def ratios() -> dict[str, Column]:
    c = {x: F.col(f"__{x}") for x in COUNTS}
    return {
        "word_length": _ratio(c["word_chars"], c["n_words"]),
        "symbols": _ratio(c["n_symbols"], c["word_chars"]),
        "repeated_lines": _ratio(c["n_dup_lines"], c["n_lines"]),
        "repeated_words": _ratio(c["n_repeat_words"], c["n_words"]),
        "stutter": _ratio(c["n_stutter"], c["n_words"]),
    }


def base_failed() -> Column:
    return (F.col("__n_words") < 10) | (100 * F.col("__n_repeat_words") > 20 * F.col("__n_words"))


def sketches(counted: DataFrame) -> DataFrame:
    """The mergeable sketches: lang, source, metric, bucket, n. Texts that fail the base rule don't shape the fences."""
    told = ratios() | {k: F.col(f"__{k}") for k in SIZES}
    bucket = lambda v: F.when(v <= 0, F.lit(-1)).otherwise(F.ceil(F.log(v.cast("double")) / F.log(F.lit(GAMMA)))).cast("int")
    values = F.array(*[F.struct(F.lit(k).alias("metric"), bucket(v).alias("bucket")) for k, v in told.items()])
    one = counted.where(~base_failed()).select(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.explode(values).alias("v"))
    return one.groupBy("lang", "source", "v.metric", "v.bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Merge the sketches of each group by adding counts; n, q1, q2, q3 by group and metric."""
    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*by, "metric").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by, "metric")
    # a bucket's value is the middle of its range; bucket -1 holds the zeros. A group has a few hundred buckets at most.
    ranked = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(whole)).withColumn("value", F.when(F.col("bucket") < 0, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1)))
    q = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * p), F.col("value")))
    return ranked.groupBy(*by, "metric").agg(F.max("all").alias("n"), q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"))


STATS = ("median", "spread", "size")


def _stats(sketch: DataFrame, by: list[str]) -> DataFrame:
    """by..., n, and for each ratio its median, spread and median size, in one row per group."""
    q = quartiles(sketch, by)
    of = lambda metric, column: F.max(F.when(F.col("metric") == metric, F.col(column)))
    wide = q.groupBy(*by).agg(F.max("n").alias("n"), *[of(k, c).alias(f"{c}_{k}") for k in (*SIZE_OF, *SIZES) for c in ("q1", "q2")])
    columns = []
    for k, size in SIZE_OF.items():
        q1, q2, n = F.col(f"q1_{k}"), F.col(f"q2_{k}"), F.greatest(F.col(f"q2_{size}"), F.lit(1.0))
        finest = F.lit(0.0) if k == "word_length" else SCALE / n
        columns += [q2.alias(f"median_{k}"), F.greatest(2 * (q2 - q1), (GAMMA - 1) * q2, finest).alias(f"spread_{k}"), n.alias(f"size_{k}")]
    return wide.select(*by, "n", *columns)


def _leaning(own: DataFrame, parent: DataFrame, same: Column, by: list[str]) -> DataFrame:
    """own with its numbers drawn to its parent's, by n and PRIOR, and bounded by them."""
    names = [f"{s}_{k}" for k in SIZE_OF for s in STATS]
    joined = own.join(parent.select(F.col("key").alias("parent"), *[F.col(c).alias(f"of_{c}") for c in names]), same)
    out = []
    for k in SIZE_OF:
        median, spread, size = ((F.col("n") * F.col(f"{s}_{k}") + PRIOR * F.col(f"of_{s}_{k}")) / (F.col("n") + PRIOR) for s in STATS)
        above = F.col(f"of_spread_{k}") * LOOSE
        out += [F.least(median, F.col(f"of_median_{k}") + above).alias(f"median_{k}"), F.least(spread, above).alias(f"spread_{k}"), size.alias(f"size_{k}")]
    return joined.select(*by, "n", *out)


def fences(sketch: DataFrame) -> DataFrame:
    """lang, source, and what makes the fence of each ratio: median, spread and size, as __median_symbols and so on."""
    every = _stats(sketch, []).withColumn("key", F.lit("all"))  # a single row
    lang = _leaning(_stats(sketch, ["lang"]), every, F.col("parent") == "all", ["lang"]).withColumn("key", F.col("lang"))
    own = _leaning(_stats(sketch, ["lang", "source"]), lang, F.col("lang").eqNullSafe(F.col("parent")), ["lang", "source"])
    return own.select("lang", "source", *[F.col(f"{s}_{k}").alias(f"__{s}_{k}") for k in SIZE_OF for s in STATS])


def reach(metric: str) -> Column:
    """How far from the median a text's ratio may lie: wider for texts smaller than the group's."""
    size = F.greatest(F.col(f"__{SIZE_OF[metric]}"), F.lit(1))
    return SPREADS * F.col(f"__spread_{metric}") * F.sqrt(1.0 + F.col(f"__size_{metric}") / size)


def judged(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """counted with __base_failed and __kept. The fences are few and written; they are broadcast if they are known to be."""
    limits = limits.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    same = F.col("lang").cast("string").eqNullSafe(F.col("__lang")) & F.col("source").cast("string").eqNullSafe(F.col("__source"))
    if limits.count() <= BROADCAST_ROWS:
        joined = counted.join(F.broadcast(limits), same, "left")
    else:  # a hot source is spread over the salts
        limits = limits.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        salted = counted.withColumn("__of", F.pmod(F.xxhash64("doc_id", "__word_chars", "__n_words"), F.lit(SALTS)).cast("int"))
        joined = salted.join(limits, same & (F.col("__of") == F.col("__salt")), "left")
    beyond = F.lit(False)
    for k, v in ratios().items():
        beyond = beyond | F.coalesce(v > F.col(f"__median_{k}") + reach(k), F.lit(False))
    beyond = beyond | F.coalesce(ratios()["word_length"] < F.col("__median_word_length") - reach("word_length"), F.lit(False))
    return joined.withColumn("__base_failed", base_failed()).withColumn("__kept", ~F.col("__base_failed") & ~beyond)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, the counts, base_failed, kept."""
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"))
    counted = written(with_counts(narrow).drop("text"), "quality-counts")
    limits = written(fences(sketches(counted)), "quality-fences")
    return judged(counted, limits).select("doc_id", *[F.col(f"__{c}").alias(c) for c in COUNTS[:5]], F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


@shielded
def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with all their columns. Counts are made twice: once for the fences, once to filter."""
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"))
    limits = written(fences(sketches(with_counts(narrow).drop("text"))), "quality-fences")
    return judged(with_counts(docs), limits).where("__kept").select(*docs.columns)
