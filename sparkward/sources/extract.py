"""Facts of TypeScript and JavaScript sources: calls, functions, variable declarations, and the parts of prompts.

A scanner splits a file into tokens (comments, strings, templates with their nested code, regular expressions,
punctuation); brackets are matched; calls, functions and declarations are read off the token structure. There is no full
grammar: decorators count as plain code, type assertions in angle brackets and JSX text are read as operators and names.
A file that can't be read (brackets that don't match) gives a row with an error and no facts.

Order follows a pre-order walk: by start, and of nodes with one start the longer first.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

_NAME = re.compile(r"[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*|#[A-Za-z_$][\w$]*")
_NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_PUNCT = re.compile(r"=>|\?\.(?!\d)|\.\.\.|===|!==|==|!=|<=|>=|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\+\+|--|\+=|-=|\*\*=|\*=|/=|%=|\*\*|[-+*/%&|^!~?:;,.<>=@(){}\[\]#]")
#: What most tokens are, past plain spaces: a name, or punctuation that begins no comment, number or private name.
_COMMON = re.compile(r"[ \t\r\n]*(?:([A-Za-z_$][\w$\u0080-\uffff]*)|(?![/#]|\.[^\x00-\x2f\x3a-\x7f])(" + _PUNCT.pattern + "))")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_OPEN = {"(": ")", "[": "]", "{": "}"}
_BEFORE_VALUE = frozenset("return typeof instanceof in of new delete void throw case do else await yield".split())
_NO_CALLEE = frozenset("if for while switch catch function return typeof with void delete throw case in of instanceof new await yield else do constructor".split())
_STATEMENT = frozenset("if for while switch catch with".split())


@dataclass(slots=True)
class Token:
    kind: str  # name, number, string, template, regex, punct
    text: str
    start: int
    end: int
    inner: list | tuple = ()  # of a template: the token lists of its ${} parts
    match: int = -1  # index of the other bracket


class Unreadable(ValueError):
    pass


def tokens_of(text: str, at: int = 0, closing: str | None = None) -> tuple[list[Token], int]:
    """Tokens from at on, up to the end or an unmatched closing brace; the index after them."""
    out: list[Token] = []
    stack: list[int] = []
    n = len(text)
    while at < n:
        m = _COMMON.match(text, at)
        if m is None:
            c = text[at]
            if c.isspace() or c == "\ufeff":
                at += 1
                continue
            if text.startswith("//", at) or (at == 0 and text.startswith("#!")):
                end = text.find("\n", at)
                at = n if end < 0 else end
                continue
            if text.startswith("/*", at):
                end = text.find("*/", at + 2)
                at = n if end < 0 else end + 2
                continue
            if c in "\"'":
                end = at + 1
                while end < n and text[end] != c and text[end] != "\n":
                    end += 2 if text[end] == "\\" else 1
                out.append(Token("string", text[at : end + 1], at, min(end + 1, n)))
                at = end + 1
                continue
            if c == "`":
                token, at = _template(text, at)
                out.append(token)
                continue
            if m := _NAME.match(text, at):
                out.append(Token("name", m.group(), at, m.end()))
                at = m.end()
                continue
            if c.isdigit() or (c == "." and text[at + 1 : at + 2].isdigit()):
                m = _NUMBER.match(text, at)
                out.append(Token("number", m.group(), at, m.end()))
                at = m.end()
                continue
            if c == "/" and _value_may_start(out) and (m := _REGEX.match(text, at)):
                out.append(Token("regex", m.group(), at, m.end()))
                at = m.end()
                continue
            m = _PUNCT.match(text, at)
            if m is None:
                at += 1
                continue
            p = m.group()
        elif m.lastindex == 1:
            at = m.end()
            out.append(Token("name", m[1], m.start(1), at))
            continue
        else:
            p = m[2]
            at = m.start(2)
        end = at + len(p)
        if p in ")]}":
            if not stack:
                if p == closing:
                    return out, at + 1
                raise Unreadable(f"unmatched {p} at {at}")
            first = stack.pop()
            if _OPEN[out[first].text] != p:
                raise Unreadable(f"{p} at {at} doesn't close {out[first].text}")
            out[first].match = len(out)
            out.append(Token("punct", p, at, end, (), first))
        else:
            if p in _OPEN:
                stack.append(len(out))
            out.append(Token("punct", p, at, end))
        at = end
    if stack or closing:
        raise Unreadable("a bracket isn't closed")
    return out, at


def _template(text: str, at: int) -> tuple[Token, int]:
    start, inner = at, []
    at += 1
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
        elif c == "`":
            return Token("template", text[start : at + 1], start, at + 1, inner), at + 1
        elif text.startswith("${", at):
            part, at = tokens_of(text, at + 2, "}")
            inner.append(part)
        else:
            at += 1
    raise Unreadable("a template isn't closed")


def _value_may_start(before: list[Token]) -> bool:
    if not before:
        return True
    t = before[-1]
    if t.kind == "punct":
        return t.text not in (")", "]", "}", "++", "--")
    return t.kind == "name" and t.text in _BEFORE_VALUE


class File:
    def __init__(self, text: str):
        self.text = text
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.calls: list[dict] = []
        self.functions: list[dict] = []
        self.decls: list[dict] = []
        self.nodes: list[dict] = []
        self._seen: dict[tuple[int, int, int], dict] = {}
        self._flat: dict[int, tuple[list[str], list[int]]] = {}
        tokens, _ = tokens_of(text)
        self._walk(tokens)
        self._number()

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    # --- structure of one token list

    def _walk(self, ts: list[Token]) -> None:
        for t in ts:
            for part in t.inner:
                self._walk(part)
        for i, t in enumerate(ts):
            if t.kind == "punct" and t.text == "(":
                self._paren(ts, i)
            elif t.kind == "name" and t.text in ("const", "let", "var") and not self._is_member(ts, i):
                self._declarations(ts, i + 1)
            elif t.kind == "punct" and t.text == "=>":
                self._arrow(ts, i)

    @staticmethod
    def _is_member(ts: list[Token], i: int) -> bool:
        return i > 0 and ts[i - 1].text in (".", "?.") or i + 1 < len(ts) and ts[i + 1].text == ":" and i > 0 and ts[i - 1].text in ("{", ",")

    def _paren(self, ts: list[Token], i: int) -> None:
        """A bracket opens: a call's arguments, a function's or method's parameters, or neither."""
        k = i - 1
        if k >= 0 and ts[k].text == ">":  # type arguments, as in f<T>(x), or type parameters
            opened = self._type_start(ts, k)
            if opened > 0:
                k = opened - 1
        if k < 0:
            return
        t = ts[k]
        close = ts[i].match
        if t.kind == "name" and t.text == "function" or t.text == "*" and k > 0 and ts[k - 1].text == "function" or k > 0 and t.kind == "name" and (ts[k - 1].text == "function" or ts[k - 1].text == "*" and k > 1 and ts[k - 2].text == "function"):
            first = k
            while ts[first].text != "function":
                first -= 1
            named = first < k and ts[k].kind == "name"
            if first > 0 and ts[first - 1].text == "async":
                first -= 1
            body = self._body(ts, close + 1)
            if body is not None:
                as_statement = named and (first == 0 or ts[first - 1].text in (";", "}", "{", "export", "default", ")") or self.text.rfind("\n", ts[first - 1].end, ts[first].start) >= 0 and ts[first - 1].text not in ("=", "(", ",", ":", "=>", "return"))
                self._function("function_declaration" if as_statement else "function_expression", ts[first].start, ts[body].end, self._params(ts, i))
            return
        if t.kind == "name" and t.text in _STATEMENT and not self._is_member(ts, k):
            return
        if t.text == "async" and close + 1 < len(ts) and ts[close + 1].text in ("=>", ":"):
            return
        if t.kind in ("name", "string", "number") or t.text == "]":
            body = self._body(ts, close + 1)
            if body is not None and self._is_method(ts, k):
                first = k if t.text != "]" else t.match
                if ts[first].text != "constructor" and not (first > 0 and ts[first - 1].text in ("get", "set") and ts[first - 1].kind == "name"):
                    while first > 0 and ts[first - 1].text in ("async", "*", "static", "public", "private", "protected", "override", "readonly"):
                        first -= 1
                    self._function("method", ts[first].start, ts[body].end, self._params(ts, i))
                return
        if t.kind == "name" and (t.text not in _NO_CALLEE or k > 0 and ts[k - 1].text in (".", "?.")) or t.text in (")", "]", "!", "?.") and k > 0 or t.kind == "template":
            self._call(ts, k, i)

    def _type_start(self, ts: list[Token], k: int) -> int:
        depth = 0
        while k >= 0:
            x = ts[k].text
            if x == ">":
                depth += 1
            elif x == "<":
                depth -= 1
                if depth == 0:
                    return k if k > 0 and ts[k - 1].kind == "name" else -1
            elif ts[k].kind not in ("name", "string", "number") and x not in (".", ",", "[", "]", "{", "}", "|", "&", ":", "?", ";"):
                return -1
            k -= 1
        return -1

    @staticmethod
    def _body(ts: list[Token], k: int) -> int | None:
        """Index of the brace that closes the block at k, past a return type."""
        if k < len(ts) and ts[k].text == ":":
            k += 1
            while k < len(ts) and ts[k].text not in (";", "=>", "=", ","):
                if ts[k].text == "{":
                    after = ts[k].match + 1
                    if not (after < len(ts) and ts[after].text in ("{", "|", "&", "[")):
                        return ts[k].match
                    k = after
                elif ts[k].match > k:
                    k = ts[k].match + 1
                else:
                    k += 1
            return None
        return ts[k].match if k < len(ts) and ts[k].text == "{" else None

    def _is_method(self, ts: list[Token], k: int) -> bool:
        """Whether name( at k may be a method's head: it follows a brace, a comma, a semicolon, or a modifier."""
        first = k if ts[k].text != "]" else ts[k].match
        if first == 0:
            return False
        before = ts[first - 1]
        if before.kind == "name":
            return before.text in ("async", "static", "get", "set", "public", "private", "protected", "override", "readonly")
        return before.text in ("{", "}", ",", ";", "*")

    def _params(self, ts: list[Token], i: int) -> list[dict]:
        out = []
        for a, b in self._parts(ts, i + 1, ts[i].match):
            while a < b and (ts[a].text in ("...", "public", "private", "protected", "readonly") and b - a > 1):
                a += 1
            if ts[a].text in ("{", "["):
                out.append({"text": self.text[ts[a].start : ts[ts[a].match].end], "is_identifier": False})
            else:
                out.append({"text": ts[a].text, "is_identifier": ts[a].kind == "name"})
        return out

    @staticmethod
    def _parts(ts: list[Token], a: int, end: int) -> list[tuple[int, int]]:
        """The stretches between top-level commas of ts[a:end]."""
        out, first, k = [], a, a
        while k < end:
            if ts[k].text == "," and ts[k].kind == "punct":
                if k > first:
                    out.append((first, k))
                first = k + 1
            elif ts[k].match > k:
                k = ts[k].match
            k += 1
        if end > first:
            out.append((first, end))
        return out

    def _function(self, kind: str, start: int, end: int, params: list[dict]) -> None:
        self.functions.append({"start": start, "end": end, "kind": kind, "params": params})

    def _arrow(self, ts: list[Token], i: int) -> None:
        k = i - 1
        if k < 0:
            return
        if ts[k].text != ")" and not (ts[k].kind == "name" and (k == 0 or ts[k - 1].text not in (":", ".", "|", "&"))):  # a return type stands between
            j = k
            while j > 0 and not (ts[j].text == ":" and ts[j - 1].text == ")"):
                j = ts[j].match - 1 if 0 <= ts[j].match < j else j - 1
            if j <= 0:
                return
            k = j - 1
        elif ts[k].kind == "name" and k > 1 and ts[k - 1].text == ":" and ts[k - 2].text == ")":
            k -= 2
        if ts[k].text == ")":
            first, params = ts[k].match, self._params(ts, ts[k].match)
        else:
            first, params = k, [{"text": ts[k].text, "is_identifier": True}]
        if first > 0 and ts[first - 1].text == ">":
            opened = self._type_open(ts, first - 1)
            first = opened if opened >= 0 else first
        if first > 0 and ts[first - 1].text == "async":
            first -= 1
        if i + 1 < len(ts) and ts[i + 1].text == "{":
            end = ts[ts[i + 1].match].end
        else:
            last = self._expression_end(ts, i + 1)
            end = ts[last].end if last >= 0 else ts[i].end
        self._function("arrow", ts[first].start, end, params)

    @staticmethod
    def _type_open(ts: list[Token], k: int) -> int:
        depth = 0
        while k >= 0:
            depth += (ts[k].text == ">") - (ts[k].text == "<")
            if depth == 0:
                return k
            k -= 1
        return -1

    def _expression_end(self, ts: list[Token], k: int) -> int:
        """Last token of the expression that begins at k."""
        last = k - 1
        while k < len(ts):
            t = ts[k]
            if t.kind == "punct" and t.text in (",", ";", ")", "]", "}"):
                break
            if k - 1 == last and last >= 0 and k > 0 and self._breaks(ts, k):
                break
            if t.match > k:
                k = t.match
            last = k
            k += 1
        return last

    def _breaks(self, ts: list[Token], k: int) -> bool:
        """Whether a statement ends at the line break before token k."""
        a, b = ts[k - 1], ts[k]
        if self.text.find("\n", a.end, b.start) < 0:
            return False
        ends = a.kind != "punct" and a.text not in _BEFORE_VALUE or a.text in (")", "]", "}", "++", "--")
        begins = b.kind in ("name", "string", "number") and b.text not in ("in", "of", "instanceof", "as", "satisfies") or b.text in ("{", "@", "++", "--", "!")
        return ends and begins

    def _callee_start(self, ts: list[Token], k: int) -> int:
        """First token of the member, call or index chain that ends at k."""
        while True:
            t = ts[k]
            if t.text == "!" and t.kind == "punct":
                k -= 1
                continue
            if t.text == "?.":
                k -= 1
                continue
            if t.text == ">" and t.kind == "punct":
                opened = self._type_start(ts, k)
                if opened > 0:
                    k = opened - 1
                    continue
                return k
            if t.text in (")", "]", "}") and t.kind == "punct":
                first = t.match
                before = ts[first - 1] if first > 0 else None
                if t.text == "}":
                    return first
                if before is not None and (before.kind == "name" and before.text not in _BEFORE_VALUE | {"if", "while", "for", "switch", "catch"} or before.text in (")", "]", "!", "?.", ">") or before.kind == "template"):
                    if before.text == ">" and self._type_start(ts, first - 1) <= 0:
                        return first
                    k = first - 1
                    continue
                return first
            if t.kind == "template" and k > 0 and (ts[k - 1].kind == "name" and ts[k - 1].text not in _BEFORE_VALUE or ts[k - 1].text in (")", "]")):
                k -= 1
                continue
            if k > 1 and ts[k - 1].text in (".", "?."):
                k -= 2
                continue
            if k > 0 and ts[k - 1].text == "new":
                return k - 1
            return k

    def _call(self, ts: list[Token], k: int, i: int) -> None:
        first = self._callee_start(ts, k)
        if ts[first].text == "new" and self._is_new(ts, first, i):
            return
        if ts[k].text == ")" and ts[k].match > 0 and ts[ts[k].match - 1].text in _STATEMENT and ts[ts[k].match - 1].kind == "name":
            return
        start, close = ts[first].start, ts[i].match
        callee = self.text[start : ts[k].end].rstrip()
        if callee.endswith("?."):
            callee = callee[:-2].rstrip()
        args = []
        for n, (a, b) in enumerate(self._parts(ts, i + 1, close)):
            args.append({"idx": n, **self._node(ts, a, b)})
        call = {"start": start, "end": ts[close].end, "callee_text": callee, "args": args}
        self.calls.append(call)
        if args:
            parts = self._parts(ts, i + 1, close)
            self._prompts(call, ts, parts)

    def _is_new(self, ts: list[Token], first: int, i: int) -> bool:
        """Whether the bracket at i is the one that belongs to new."""
        k = first + 1
        while k < i:
            if ts[k].text == "(":
                return False
            k += 1
        return True

    # --- nodes

    def _node(self, ts: list[Token], a: int, b: int) -> dict:
        key = id(ts), a, b  # arguments are looked at as parts of prompts too
        if key not in self._seen:
            self._seen[key] = self._make_node(ts, a, b)
        return self._seen[key]

    def _make_node(self, ts: list[Token], a: int, b: int) -> dict:
        text = self.text[ts[a].start : ts[b - 1].end]
        flat, upto = self._names(ts)
        names = flat[upto[a] : upto[b]]
        stringify = bool(re.search(r"(^|[^\w$])JSON\s*\.\s*stringify\s*(\?\.)?\(", text, re.I)) and self._has_stringify(ts[a:b])
        return {"kind": self._kind(ts, a, b), "text": text, "line": self.line(ts[a].start), "identifiers": names, "has_json_stringify": stringify, "at": ts[a].start}

    def _names(self, ts: list[Token]) -> tuple[list[str], list[int]]:
        """All names in a token list, and how many stand before each of its tokens; made once for each list."""
        found = self._flat.get(id(ts))
        if found is None:
            flat, upto = [], [0]
            for t in ts:
                if t.kind == "name" and t.text not in _KEYWORDS:
                    flat.append(t.text)
                for part in t.inner:
                    flat += self._names(part)[0]
                upto.append(len(flat))
            found = self._flat[id(ts)] = flat, upto
        return found

    def _has_stringify(self, ts: list[Token]) -> bool:
        for k, t in enumerate(ts):
            if t.text.lower() == "stringify" and k > 1 and ts[k - 1].text in (".", "?.") and ts[k - 2].text.lower() == "json" and k + 1 < len(ts) and ts[k + 1].text in ("(", "?."):
                return True
            if any(self._has_stringify(part) for part in t.inner):
                return True
        return False

    def _kind(self, ts: list[Token], a: int, b: int) -> str:
        if b - a == 1:
            t = ts[a]
            return {"name": "identifier" if t.text not in _LITERALS else "literal", "number": "literal", "string": "literal", "regex": "literal", "template": "template"}.get(t.kind, "other")
        if ts[a].text == "{" and ts[a].match == b - 1:
            return "object"
        if ts[a].text == "[" and ts[a].match == b - 1:
            return "array"
        weakest, k, k_plus = 99, a, False
        binds = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "in": 8, "instanceof": 8, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
        while k < b:
            t = ts[k]
            if t.kind == "punct" and t.text in ("=>", "?", "=", "+=", "-=", "*=", "/=", "||=", "&&=", "??="):
                return "other"
            if t.text in binds and k > a and (t.kind == "punct" or t.text in ("in", "instanceof")) and not (ts[k - 1].kind == "punct" and ts[k - 1].text not in (")", "]", "}", "++", "--")):
                if binds[t.text] <= weakest:  # left-associative: the last of the weakest is the top
                    weakest, k_plus = binds[t.text], t.text == "+"
            if t.match > k:
                k = t.match
            k += 1
        if weakest < 99:
            return "concat" if k_plus else "binary"
        if ts[b - 1].text == ")" and ts[b - 1].match > a:
            return "call"
        if ts[a].text not in ("await", "new", "typeof", "!", "-", "void", "...") and b - a >= 3 and ts[b - 2].text in (".", "?."):
            return "property"
        return "other"

    def _object_parts(self, ts: list[Token], a: int) -> Iterator[tuple[str, int, int]]:
        """(name, first, end) of each name: value in the object literal that opens at a."""
        for x, y in self._parts(ts, a + 1, ts[a].match):
            if ts[x].kind in ("name", "string", "number") and x + 1 < y and ts[x + 1].text == ":":
                yield ts[x].text.replace("'", "").replace('"', ""), x + 2, y

    def _prompts(self, call: dict, ts: list[Token], parts: list[tuple[int, int]]) -> None:
        """The nodes that AI001 looks at (first argument, or its prompt) and those that AI004 does."""
        a, b = parts[0]
        is_object = ts[a].text == "{" and ts[a].match == b - 1
        one = []
        if not is_object:
            one = [(a, b)]
        else:
            one = [(x, y) for name, x, y in self._object_parts(ts, a) if name == "prompt"][:1]
        four = []
        if is_object:
            for name, x, y in self._object_parts(ts, a):
                if name == "prompt":
                    four.append((x, y))
                if name == "messages" and ts[x].text == "[" and ts[x].match == y - 1:
                    for p, q in self._parts(ts, x + 1, y - 1):
                        if ts[p].text == "{" and ts[p].match == q - 1:
                            four += [(u, v) for key, u, v in self._object_parts(ts, p) if key == "content"][:1]
        for detector, found in (("AI001", one), ("AI004", four or parts)):
            for x, y in found:
                self.nodes.append({"call": call, "detector": detector, **self._node(ts, x, y)})

    # --- declarations

    def _declarations(self, ts: list[Token], k: int) -> None:
        while k < len(ts):
            first = k
            if ts[k].text in ("{", "[") and ts[k].match > k:
                name = self.text[ts[k].start : ts[ts[k].match].end]
                k = ts[k].match + 1
            elif ts[k].kind == "name":
                name = ts[k].text
                k += 1
            else:
                return
            if k < len(ts) and ts[k].text == "!":
                k += 1
            if k < len(ts) and ts[k].text == ":":
                while k < len(ts) and ts[k].text not in ("=", ",", ";", "of", "in", ")"):
                    k = ts[k].match + 1 if ts[k].match > k else k + 1
            if k < len(ts) and ts[k].text == "=":
                last = self._expression_end(ts, k + 1)
                if last > k:
                    node = self._node(ts, k + 1, last + 1)
                    text = node["text"]
                    access = bool(re.fullmatch(r"(req|request)\s*(\?\.|\.)\s*#?[\w$]+", text)) or node["kind"] == "property" and text.startswith("ctx.request")
                    self.decls.append({"start": ts[first].start, "end": ts[last].end, "name_text": name, "init_kind": node["kind"], "init_text": text, "init_is_req_access": access})
                    k = last + 1
            if k < len(ts) and ts[k].text == ",":
                k += 1
                continue
            return

    # --- positions

    def _number(self) -> None:
        everything = [("call", c) for c in self.calls] + [("function", f) for f in self.functions] + [("decl", d) for d in self.decls]
        everything.sort(key=lambda x: (x[1]["start"], -x[1]["end"]))
        for pos, (_, x) in enumerate(everything):
            x["pos"] = pos
        self.functions.sort(key=lambda f: f["pos"])
        open_: list[dict] = []
        for what, x in everything:
            while open_ and open_[-1]["end"] <= x["start"]:
                open_.pop()
            x["fn_path"] = [f["pos"] for f in open_ if f["end"] >= x["end"]]
            if what == "function":
                open_.append(x)


_KEYWORDS = frozenset("await async new typeof function return const let var if else for while do switch case break continue default try catch finally throw delete void in of instanceof yield this super class extends null true false import export".split()) - {"async", "of"}
_LITERALS = frozenset(["true", "false", "null"])

_NODE = "kind: string, text: string, line: int, identifiers: array<string>, has_json_stringify: boolean"
FACTS = (
    "repo string, file string, error string, "
    f"calls array<struct<call_pos: int, start_line: int, callee_text: string, args: array<struct<idx: int, {_NODE}>>, fn_path: array<int>>>, "
    "functions array<struct<fn_pos: int, kind: string, params: array<struct<text: string, is_identifier: boolean>>>>, "
    "decls array<struct<decl_pos: int, name_text: string, init_kind: string, init_text: string, init_is_req_access: boolean, fn_path: array<int>>>, "
    f"nodes array<struct<call_pos: int, detector: string, node_ord: int, node_line: int, node_kind: string, node_text: string, identifiers: array<string>, has_json_stringify: boolean, callee_text: string, fn_path: array<int>>>"
)


KINDS = ("calls", "functions", "decls", "nodes")


def facts_of(text: str, kinds: tuple[str, ...] = KINDS) -> dict:
    """The four relations of one file, as lists of rows; those that aren't among kinds are left empty."""
    f = File(text)
    keep = ("kind", "text", "line", "identifiers", "has_json_stringify")
    f.calls.sort(key=lambda c: c["pos"])
    f.nodes.sort(key=lambda n: n["call"]["pos"])
    of = {
        "calls": lambda: [{"call_pos": c["pos"], "start_line": f.line(c["start"]), "callee_text": c["callee_text"], "args": [{"idx": a["idx"], **{k: a[k] for k in keep}} for a in c["args"]], "fn_path": c["fn_path"]} for c in f.calls],
        "functions": lambda: [{"fn_pos": x["pos"], "kind": x["kind"], "params": x["params"]} for x in f.functions],
        "decls": lambda: [{"decl_pos": d["pos"], "name_text": d["name_text"], "init_kind": d["init_kind"], "init_text": d["init_text"], "init_is_req_access": d["init_is_req_access"], "fn_path": d["fn_path"]} for d in sorted(f.decls, key=lambda d: d["pos"])],
        "nodes": lambda: [{"call_pos": n["call"]["pos"], "detector": n["detector"], "node_ord": k, "node_line": n["line"], "node_kind": n["kind"], "node_text": n["text"], "identifiers": n["identifiers"], "has_json_stringify": n["has_json_stringify"], "callee_text": n["call"]["callee_text"], "fn_path": n["call"]["fn_path"]} for k, n in enumerate(f.nodes)],
    }
    return {k: of[k]() if k in kinds else [] for k in KINDS}


DEEPEST = 50_000  # frames; templates within templates take two each
AT_ONCE = 1000  # files whose facts a task holds before it passes them on
AT_ONCE_CHARS = 4 << 20  # and characters of them


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows over some tasks for each core, by their keys. A table of any number of sources may be one small file, which is
    one task; a given number of partitions isn't put together again by adaptive execution, as sizes in bytes would have it.
    """
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """An Arrow column of lists and dicts, field by field: many times as fast as Arrow's own way. Only plain values may be null."""
    if pa.types.is_list(kind):
        upto = pa.array([0, *accumulate(map(len, values))], pa.int32())
        return pa.ListArray.from_arrays(upto, _column(list(chain.from_iterable(values)), kind.value_type), type=kind)
    if pa.types.is_struct(kind):
        return pa.StructArray.from_arrays([_column([v[f.name] for v in values], f.type) for f in kind], fields=list(kind))
    return pa.array(values, kind)


def extract(source_files: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """One row of facts per source file (repo, file, text); a file that can't be read has its error there and no facts.
    Every file is read whole; kinds: the relations that are wanted, the others are left empty."""
    schema = to_arrow_schema(DataType.fromDDL(FACTS))

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_column([r[f.name] for r in rows], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEPEST))
        rows, chars = [], 0
        for batch in batches:
            for repo, file, text in zip(*(batch.column(c).to_pylist() for c in ("repo", "file", "text"))):
                try:
                    rows.append({"repo": repo, "file": file, "error": None, **facts_of(text or "", kinds)})
                except (Unreadable, RecursionError, IndexError) as e:
                    rows.append({"repo": repo, "file": file, "error": str(e)[:200], "calls": [], "functions": [], "decls": [], "nodes": []})
                chars += len(text or "")
                if len(rows) >= AT_ONCE or chars >= AT_ONCE_CHARS:
                    yield batch_of(rows)
                    rows, chars = [], 0
        if rows:
            yield batch_of(rows)

    return spread(source_files.select("repo", "file", "text"), "repo", "file").mapInArrow(run, FACTS)


def calls(facts: DataFrame) -> DataFrame:
    return facts.select("repo", "file", F.inline("calls"))


def functions(facts: DataFrame) -> DataFrame:
    return facts.select("repo", "file", F.inline("functions"))


def decls(facts: DataFrame) -> DataFrame:
    return facts.select("repo", "file", F.inline("decls"))


def call_prompt_nodes(facts: DataFrame) -> DataFrame:
    return facts.select("repo", "file", F.inline("nodes"))


def calls_named(calls: DataFrame, name: str) -> DataFrame:
    """Calls whose callee holds a name, in any case."""
    return calls.where(F.lower("callee_text").contains(name.lower()))


def concatenations(nodes: DataFrame) -> DataFrame:
    """Prompt nodes put together with +."""
    return nodes.where("node_kind = 'concat'")


def variable_origins(decls: DataFrame) -> DataFrame:
    """decls with origin: literal, identifier, call or unknown, by what a name was given."""
    kind = F.col("init_kind")
    return decls.withColumn("origin", F.when(kind.isin("literal", "identifier", "call"), kind).otherwise("unknown"))
