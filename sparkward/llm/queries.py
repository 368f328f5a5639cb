"""The registered queries of the text operators, with production parameters, and their SQL where it can be written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_table_path, read_table
from .bpe import bpe_round_trip
from .chat_format import chat_tree, read_back
from .exact_dedup import exact_dedup
from .license_scan import license_scan
from .ngram_join import ngram_join
from .packing import pack_documents
from .quality_rules import quality_rules
from .secret_scan import scan_secrets, update_ledger
from .suffix_dedup import suffix_dedup
from .toxicity import score_toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = ngram_join(read_table(spark, sf_dir, "documents"))
    return rows.drop("raw_hash")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = "</s>[INST] ok [/INST]"
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", added), (-7, 1, "assistant", added)], "conv_id long, turn long, role string, text string")
    return read_back(*chat_tree(rows.unionByName(own)))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"], s["end"], s["edits"]))
    return license_scan(read_table(spark, sf_dir, "documents")).withColumn("spans", F.array_join(told, ","))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two steps: the ledger takes up all blobs, then a scan of the same versions finds them there and scans nothing anew."""
    docs, ledger = read_table(spark, sf_dir, "documents"), new_table_path(spark, "secret-ledger")
    update_ledger(docs, ledger)
    return scan_secrets(docs, ledger).drop("blob")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_join": op2_ngram_join,
    "op3_bpe": op3_bpe,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_chat_format": op6_chat_format,
    "op7_license_scan": op7_license_scan,
    "op8_packing": op8_packing,
    "op9_secret_scan": op9_secret_scan,
    "op10_exact_dedup": op10_exact_dedup,
}

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ESCAPED = """length({0}) + len(regexp_extract_all({0}, '\\\\|<\\||</?s>|\\[/?INST\\]'))"""

#: Fences of the quality rules, as quality_rules.py defines them: counts, sketches by bucket, quartiles, then each group's
#: median, spread and size, drawn to its parent's and bounded by it.
_QUARTILES = """SELECT {by}, metric, max(total) AS n, min(CASE WHEN upto >= ceil(total * 0.25) THEN value END) AS q1, min(CASE WHEN upto >= ceil(total * 0.5) THEN value END) AS q2
    FROM (SELECT *, sum(n) OVER (PARTITION BY {by}, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}, metric) AS total, CASE WHEN bucket < 0 THEN 0.0 ELSE 2 * pow(1.04::DOUBLE, bucket) / 2.04 END AS value
          FROM (SELECT {by}, metric, bucket, sum(n) AS n FROM sketch GROUP BY {by}, metric, bucket)) GROUP BY {by}, metric"""
_STATS = f"""SELECT a.*, a.q2 AS median, greatest(b.q2, 1::DOUBLE) AS size,
           greatest(2 * (a.q2 - a.q1), (1.04::DOUBLE - 1) * a.q2, CASE WHEN metric = 'word_length' THEN 0::DOUBLE ELSE 1000 / greatest(b.q2, 1::DOUBLE) END) AS spread
    FROM ({_QUARTILES}) a JOIN kinds USING (metric) JOIN ({_QUARTILES.replace("metric,", "metric AS of_size,", 1)}) b USING ({{by}}, of_size)"""
_LEANING = """least((o.n * o.median + 200::DOUBLE * p.median) / (o.n + 200::DOUBLE), p.median + p.spread * 4::DOUBLE) AS median,
           least((o.n * o.spread + 200::DOUBLE * p.spread) / (o.n + 200::DOUBLE), p.spread * 4::DOUBLE) AS spread, (o.n * o.size + 200::DOUBLE * p.size) / (o.n + 200::DOUBLE) AS size"""
_REACH = "8::DOUBLE * spread * sqrt(1::DOUBLE + size / greatest(own_size, 1))"

ORACLE_SQL: dict[str, str] = {
    "op4_suffix_dedup": """
        WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
        w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 99, 0))) AS p FROM d)),
        c AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
        i AS (SELECT doc_id, p, sum(CASE WHEN p > last + 100 OR last IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS last FROM c)),
        r AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, g),
        k AS (SELECT r.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
              FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r) r JOIN d USING (doc_id) GROUP BY r.doc_id)
        SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op5_quality_rules": f"""
        WITH t AS (SELECT doc_id, coalesce(lang, chr(0)) AS lang, coalesce(source, chr(0)) AS source, coalesce(text, '') AS text FROM documents),
        x AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
        g AS (SELECT doc_id, i, w[i:i + 4] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM x)),
        m AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
        rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM m, (SELECT unnest([0, 1, 2, 3, 4]) AS o) GROUP BY doc_id),
        c AS (SELECT x.doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
                     len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter
              FROM x LEFT JOIN rep USING (doc_id)),
        f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
        kinds(metric, of_size) AS (VALUES ('word_length', 'n_words'), ('symbols', 'word_chars'), ('repeated_lines', 'n_lines'), ('repeated_words', 'n_lines'), ('stutter', 'n_words')),
        v AS (SELECT doc_id, lang, source, base_failed, unnest(['word_length', 'symbols', 'repeated_lines', 'repeated_words', 'stutter', 'n_words', 'word_chars', 'n_lines']) AS metric,
                     unnest([n_words, word_chars, n_lines, n_lines, n_words, 0, 0, 0]) AS own_size,
                     unnest([word_chars * 1000 // greatest(n_words, 1), n_symbols * 1000 // greatest(word_chars, 1), n_dup_lines * 1000 // greatest(n_lines, 1), n_repeat_words * 1000 // greatest(n_words, 1), n_stutter * 1000 // greatest(n_words, 1), n_words, word_chars, n_lines]) AS value FROM f),
        sketch AS (SELECT lang, source, 1 AS one, metric, CASE WHEN value <= 0 THEN -1 ELSE ceil(ln(value::DOUBLE) / ln(1.04::DOUBLE))::INT END AS bucket, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
        every AS ({_STATS.format(by="one")}),
        bylang AS (SELECT o.lang, o.metric, {_LEANING} FROM ({_STATS.format(by="lang")}) o JOIN every p USING (metric)),
        fences AS (SELECT o.lang, o.source, o.metric, {_LEANING} FROM ({_STATS.format(by="lang, source")}) o JOIN bylang p USING (lang, metric)),
        beyond AS (SELECT v.doc_id, bool_or(value > median + {_REACH} OR metric = 'word_length' AND value < median - {_REACH}) AS beyond FROM v JOIN fences USING (lang, source, metric) GROUP BY v.doc_id)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(beyond, false) AS kept FROM f LEFT JOIN beyond USING (doc_id)""",
    "op6_chat_format": f"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
               sum({_ESCAPED.format("role")} + {_ESCAPED.format("text")} + 23)::BIGINT AS formatted_chars
        FROM c GROUP BY conv_id""",
    "op10_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_ASCII_LOWER} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
}
