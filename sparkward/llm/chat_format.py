"""Chat formatting with a prefix tree: conversations that begin with the same turns share these turns' tokens.

Template: <|turn|>role<|text|>text<|end|> for each turn. Inside roles and texts a backslash goes before each backslash
and before whatever could begin a control string (this template's, <s>, </s>, [INST], [/INST]); that is undone by
dropping it. The loss mask covers the texts of assistant turns. Tokens are code points of the formatted text.

Each turn's node is named by a polynomial hash over the turns up to it, so equal beginnings have equal nodes, and the hash
of a stretch of turns can be put together from those of its parts. One depth-first sequence of all trees holds each node
once. A node has its place in that sequence, its position (the tokens before it in its conversation: shared turns have
equal ones), and the intervals of the sequence that it may attend to: its ancestors, neighbours joined into one.

Of a node's children the heavy one, which most conversations go through, comes first, so that a heavy path is one
stretch of the sequence. Each other child halves the conversations at least: a node's key, which the depth-first order
sorts by, and its intervals have no more entries than a binary logarithm of the number of turns, however conversations branch.

Conversations are ordered by range, not by hash, so one with a third of all rows is spread over many tasks: each task
goes through its stretch of the order, and what it hands on to the next one (a hash, a key, some intervals) is put
together once, a row per task, on the driver. Joins by node spread turns that very many conversations share. Texts move
twice: into order, and to their node. Only read_back(), whose digests can't be put together from parts, streams each
conversation through one task, in bounded memory.

Defined results: null texts and roles are empty. Rows with null conv_id are one conversation. Turns are ordered by turn
(null first), then role, then text; repeated rows are turns of their own. An empty table gives an empty table. Columns
other than conv_id, turn, role and text aren't read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, hot_keys, join_spread, written

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_CONTROL = re.compile(r"\\|<(?=\||/?s>)|\[(?=/?INST\])")
_ESCAPED = re.compile(r"\\(.)", re.S)
_PARTS = re.compile(r"<\|turn\|>((?:[^\\<]|\\.|<(?!\|))*)<\|text\|>((?:[^\\<]|\\.|<(?!\|))*)<\|end\|>", re.S)
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the part of it under the loss mask (start, end; equal if there is none)."""
    head = f"{TURN}{escape(role)}{TEXT}"
    body = escape(text)
    return head + body + END, len(head), len(head) + (len(body) if role == LOSS_ROLE else 0)


def parse_turn(formatted: str) -> tuple[str, str]:
    m = _PARTS.fullmatch(formatted)
    if m is None:
        raise ValueError("not a formatted turn")
    return unescape(m.group(1)), unescape(m.group(2))


_P = (1 << 61) - 1
_BASES = (1_152_921_504_606_846_883 % _P, 864_691_128_455_135_207 % _P)


def _in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """Conversations in order, spread over tasks wherever that order may be cut."""
    return df.repartitionByRange("conv", *order).sortWithinPartitions("conv", *order)


def _batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(types), types.types)], schema=types)


#: What each pass adds to its rows: its task, whether a row belongs to the task's first conversation (which may have begun
#: in an earlier one), and whether it is the task's last row of all, which tells what is handed on (first: that conversation).
_PASS = [("part", pa.int32()), ("head", pa.bool_()), ("last", pa.bool_()), ("first", pa.string()), ("conv", pa.string())]


def _pass(step, begin, tell, types: pa.Schema):
    """A pass over rows (conv, ...) in order. begin(head) -> state of a conversation, at its start or where the task cuts
    it; step(state, row) -> rows for out, changing the state; tell(state) -> the columns that the last row hands on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, conv, head, state = TaskContext.get().partitionId(), None, None, True, None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != conv:
                    head = conv is None
                    conv, state = row[0], begin(head)
                    first = conv if head else first
                out += [(part, head, False, None, conv, *x) for x in step(state, row)]
            yield _batch(out, types)
        if conv is not None:
            yield _batch([(part, head, True, first, conv, *tell(state))], types)

    return run


def _handed_on(table: DataFrame, columns: list[str], combine, empty: tuple) -> dict[int, tuple]:
    """For each task whose first conversation began earlier, what has come of it by then. One row for each task is collected."""
    carried, conv, now = {}, None, empty
    for r in table.where("last").select("part", "head", "first", "conv", *columns).orderBy("part").collect():
        own = tuple(r[c] for c in columns)
        if conv == r["first"]:
            carried[r["part"]] = now
        if r["head"]:
            own = combine(now if conv == r["first"] else empty, own)
        conv, now = r["conv"], own
    return carried


_LOCAL = pa.schema([*_PASS, ("uid", pa.int64()), ("n", pa.int64()), ("before1", pa.int64()), ("before2", pa.int64()), ("hash1", pa.int64()), ("hash2", pa.int64()), ("position", pa.int64()), ("size", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_LOCAL_SQL = "part int, head boolean, last boolean, first string, conv string, uid long, n long, before1 long, before2 long, hash1 long, hash2 long, position long, size long, role string, text string"


def _turn_hash(role: str, text: str) -> tuple[int, int]:
    told = role.encode("utf-8", "surrogatepass")
    x = xxhash.xxh3_128_intdigest(len(told).to_bytes(8, "little") + told + text.encode("utf-8", "surrogatepass"))
    return (x >> 64) % (_P - 1) + 1, (x & (1 << 64) - 1) % (_P - 1) + 1


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, turn, role, text) in order -> each turn with the hashes before and after it, counted from where the task begins."""
    uid = itertools.count(TaskContext.get().partitionId() << 40)

    def step(state, row):
        _, _, role, text = row
        n, before, position = state["n"], state["hash"], state["position"]
        state["hash"] = tuple((h * b + x) % _P for h, b, x in zip(before, _BASES, _turn_hash(role, text)))
        size = len(format_turn(role, text)[0])
        state.update(n=n + 1, position=position + size)
        return [(next(uid), n, *before, *state["hash"], position, size, role, text)]

    begin = lambda head: {"n": 0, "hash": (0, 0), "position": 0}
    yield from _pass(step, begin, lambda s: (None, s["n"], None, None, *s["hash"], s["position"], None, None, None), _LOCAL)(batches)


def _after(earlier: tuple, n: int, h1: int, h2: int, position: int) -> tuple:
    """(n, hash1, hash2, position) of a stretch that follows another one."""
    return earlier[0] + n, *((e * pow(b, n, _P) + h) % _P for e, b, h in zip(earlier[1:3], _BASES, (h1, h2))), earlier[3] + position


_NAMED = pa.schema([("uid", pa.int64()), ("conv", pa.string()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("position", pa.int64()), ("size", pa.int64())])


def _named(carried: dict[int, tuple]):
    """Turns of _chain, with what was handed on to their task, to their nodes and those nodes' parents (null at the top)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = lambda n, a, b: a.to_bytes(8, "big") + b.to_bytes(8, "big") if n else None
        for batch in batches:
            out = []
            for part, head, conv, uid, n, b1, b2, h1, h2, position, size in zip(*(c.to_pylist() for c in batch.columns)):
                if head and part in carried:
                    _, h1, h2, _ = _after(carried[part], n + 1, h1, h2, 0)
                    n, b1, b2, position = _after(carried[part], n, b1, b2, position)
                out.append((uid, conv, n, name(1, h1, h2), name(n, b1, b2), position, size))
            yield _batch(out, _NAMED)

    return run


_KEYS = pa.schema([*_PASS, ("node", pa.binary()), ("depth", pa.int64()), ("key", pa.binary())])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, depth, node, light, owned) in order -> the key of each path's light entries since the task began, of owned nodes."""

    def step(state, row):
        _, depth, node, light, owned = row
        if light:  # deeper ones first: all that hangs below a place of a heavy path then follows it without a gap
            state["key"] += b"\1" + ((1 << 63) - depth).to_bytes(8, "big") + node
        return [(node, depth, state["key"])] if owned else []

    yield from _pass(step, lambda head: {"key": b""}, lambda s: (None, None, s["key"]), _KEYS)(batches)


_SORTED = pa.schema([("key", pa.binary()), ("node", pa.binary()), ("size", pa.int64())])


def _sort_keys(carried: dict[int, tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield _batch([((carried[part][0] if head and part in carried else b"") + key + b"\0" + depth.to_bytes(8, "big"), node, size) for part, head, node, depth, key, size in rows], _SORTED)

    return run


def _place(batches):
    """Rows in depth-first order -> with the partition and the place in it."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        size = batch.column("size").to_numpy(zero_copy_only=False)
        ends = at + np.cumsum(size)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(ends - size), pa.array(size), pa.array(np.full(batch.num_rows, part, np.int32))], names=["node", "local", "size", "part"])
        at = int(ends[-1]) if batch.num_rows else at


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_INTERVALS = pa.schema([*_PASS, ("node", pa.binary()), ("attends", _SPANS)])
_ELSEWHERE = -1  # where the interval begins that an earlier task opened, or ends


def _attend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, depth, node, light, owned, start, size) in order -> the intervals of each owned node's ancestors."""

    def step(state, row):
        _, _, node, light, owned, start, size = row
        spans = state["spans"]
        out = [(node, [{"start": a, "end": b} for a, b in spans])] if owned else []
        if light or not spans:
            spans.append((start, start + size))
        else:  # along a heavy path the sequence goes on without a gap
            spans[-1] = (spans[-1][0], start + size)
        return out

    begin = lambda head: {"spans": [(_ELSEWHERE, _ELSEWHERE)] if head else []}
    yield from _pass(step, begin, lambda s: (None, [{"start": a, "end": b} for a, b in s["spans"]]), _INTERVALS)(batches)


def _joined_spans(earlier: list, own: list) -> list:
    """A task's intervals behind those handed on to it; its first one goes on from their last, where that was still open."""
    if not own or own[0]["start"] != _ELSEWHERE:
        return own
    if not earlier:
        return own[1:]
    first = {"start": earlier[-1]["start"], "end": earlier[-1]["end"] if own[0]["end"] == _ELSEWHERE else own[0]["end"]}
    return [*earlier[:-1], first, *own[1:]]


def _whole_spans(carried: dict[int, tuple]):
    types = pa.schema([("node", pa.binary()), ("attends", _SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield _batch([(node, _joined_spans(carried.get(part, ([],))[0] if head else [], own)) for part, head, node, own in rows], types)

    return run


_FORMATTED = pa.schema([("uid", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([(uid, *format_turn(role, text)) for uid, role, text in zip(*(c.to_pylist() for c in batch.columns))], _FORMATTED)


def chat_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sequence, members). sequence, one row per node: node, start (in the depth-first sequence), size, position,
    depth, formatted, loss_start, loss_end (within formatted), attends. members: conv_id, conv (its name here), depth, node.
    """
    c = conversations
    name = F.coalesce(F.concat(F.lit("c"), c["conv_id"].cast("string")), F.lit("null"))
    turns = c.select(name.alias("conv"), c["turn"].cast("long").alias("turn"), F.coalesce(c["role"].cast("string"), F.lit("")).alias("role"), F.coalesce(c["text"].cast("string"), F.lit("")).alias("text"))
    local = written(_in_order(turns, ["turn", "role", "text"]).mapInArrow(_chain, _LOCAL_SQL), "chat-turns")
    carried = _handed_on(local, ["n", "hash1", "hash2", "position"], lambda x, y: _after(x, *y), (0, 0, 0, 0))
    told = local.where("NOT last").select("part", "head", "conv", "uid", "n", "before1", "before2", "hash1", "hash2", "position", "size")
    chain = written(told.mapInArrow(_named(carried), "uid long, conv string, depth long, node binary, parent binary, position long, size long"), "chat-chain")
    # one row for each node; the first turn that has it is its owner
    nodes = written(chain.groupBy("node").agg(F.count("*").alias("n"), F.min("uid").alias("owner"), *[F.first(x).alias(x) for x in ("parent", "depth", "position", "size")]), "chat-nodes")
    heavy = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.max_by("node", F.struct("n", "node")).alias("node")).select("node", F.lit(False).alias("light"))
    known = nodes.select("node", "owner").join(heavy, "node", "left").select("node", "owner", F.coalesce("light", F.lit(True)).alias("light"))
    hot = hot_keys(chain.select("node"), "node")
    paths = written(join_spread(chain.select("conv", "depth", "node", "uid"), known, "node", hot, ["uid"]).select("conv", "depth", "node", "light", (F.col("uid") == F.col("owner")).alias("owned")), "chat-paths")
    keys = written(_in_order(paths, ["depth"]).mapInArrow(_keys, "part int, head boolean, last boolean, first string, conv string, node binary, depth long, key binary"), "chat-keys")
    carried = _handed_on(keys, ["key"], lambda x, y: (x[0] + y[0],), (b"",))
    sized = keys.where("NOT last").join(nodes.select("node", "size"), "node").select("part", "head", "node", "depth", "key", "size")
    ordered = sized.mapInArrow(_sort_keys(carried), "key binary, node binary, size long").repartitionByRange("key").sortWithinPartitions("key")
    placed = written(ordered.mapInArrow(_place, "node binary, local long, size long, part int"), "chat-placed")
    before, at = [], 0  # one number for each partition
    for r in placed.groupBy("part").agg(F.sum("size").alias("size")).orderBy("part").collect():
        before.append((r["part"], at))
        at += r["size"]
    spark = conversations.sparkSession
    based = placed.join(F.broadcast(spark.createDataFrame(before, "part int, base long")), "part").select("node", (F.col("base") + F.col("local")).alias("start"), "size")
    narrow = join_spread(paths, based, "node", hot, ["conv", "depth"]).select("conv", "depth", "node", "light", "owned", "start", "size")
    spans = written(_in_order(narrow, ["depth"]).mapInArrow(_attend, "part int, head boolean, last boolean, first string, conv string, node binary, attends array<struct<start: long, end: long>>"), "chat-spans")
    as_dicts = lambda x: [r.asDict() if hasattr(r, "asDict") else r for r in x]
    carried = {k: (as_dicts(x[0]),) for k, x in _handed_on(spans, ["attends"], lambda x, y: (_joined_spans(as_dicts(x[0]), as_dicts(y[0])),), ([],)).items()}
    attends = spans.where("NOT last").select("part", "head", "node", "attends").mapInArrow(_whole_spans(carried), "node binary, attends array<struct<start: long, end: long>>")
    texts = local.where("NOT last").select("uid", "role", "text").join(nodes.select(F.col("owner").alias("uid")), "uid", "left_semi")
    formatted = texts.select("uid", "role", "text").mapInArrow(_formatted, "uid long, formatted string, loss_start long, loss_end long")
    rows = nodes.join(based.select("node", "start"), "node").join(attends, "node").join(formatted, F.col("uid") == F.col("owner"))
    sequence = written(rows.select("node", "start", "size", "position", "depth", "formatted", "loss_start", "loss_end", "attends"), "chat-sequence")
    dropped(local, nodes, paths, keys, placed, spans)
    conv_id = F.when(F.col("conv") != "null", F.substring("conv", 2, 30)).cast("long").alias("conv_id")
    return sequence, chain.select(conv_id, "conv", "depth", "node")


_READ = pa.schema([("conv", pa.string()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, depth, position, formatted, loss_start, loss_end, start, size, attends) in order -> one row per conversation.

    What a turn may attend to must be the places of the turns before it, all of them and no others.
    """

    def result(s):
        return (s["conv"], s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"])

    s: dict = {}
    for batch in batches:
        out = []
        for conv, _, position, formatted, a, b, start, size, attends in zip(*(c.to_pylist() for c in batch.columns)):
            if conv != s.get("conv"):
                out += [result(s)] if s else []
                s = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "spans": []}
            if position != s["chars"] or size != len(formatted):
                raise ValueError(f"a turn of {conv} stands at {position}, not {s['chars']}")
            spans = s["spans"]
            if [(x["start"], x["end"]) for x in attends] != spans:
                raise ValueError(f"a turn of {conv} attends to {attends}, not {spans}")
            if spans and spans[-1][1] == start:
                spans[-1] = (spans[-1][0], start + size)
            else:
                spans.append((start, start + size))
            role, text = parse_turn(formatted)
            s["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            lost = unescape(formatted[a:b])
            s["loss"].update(lost.encode("utf-8", "surrogatepass"))
            s.update(n=s["n"] + 1, loss_chars=s["loss_chars"] + len(lost), chars=s["chars"] + len(formatted))
        yield _batch(out, _READ)
    if s:
        yield _batch([result(s)], _READ)


def read_back(sequence: DataFrame, members: DataFrame) -> DataFrame:
    """Per conversation, from the output alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    taken = sequence.select("node", "position", "formatted", "loss_start", "loss_end", "start", "size", "attends")
    rows = join_spread(members.select("conv", "depth", "node"), taken, "node", hot_keys(members.select("node"), "node"), ["conv", "depth"])
    streamed = rows.select("conv", "depth", "position", "formatted", "loss_start", "loss_end", "start", "size", "attends").repartition("conv").sortWithinPartitions("conv", "depth")
    read = streamed.mapInArrow(_read, "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    conv_id = F.when(F.col("conv") != "null", F.substring("conv", 2, 30)).cast("long").alias("conv_id")
    return read.select(conv_id, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
