"""Secret scan by assignment-aware lexing.

A text is lexed into name-literal pairs wherever it holds source or configuration syntax
(``name = "x"``, ``name: x``, ``"name": "x"``, ``export NAME=x``, ``--name x``, ``<name>x</name>``).
What follows a name's operator is parsed: strings of every quotation, also triple, joined by ``+``
or side by side; indented blocks (``name: |``); bare values; names and calls.  A literal given to
a plain name is a constant, and names that are given that constant later pass on its literal;
a call gives none.  A literal is reported where the name it reaches is sensitive enough
and it looks like a value, not a placeholder; so is the password of a URL.  Three base
patterns (credentials after a key word, access keys, hex digests) are always reported.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicata.llm.common import text_bytes

# --- fixed values of the base rules: pattern, least length of the group, group ---
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "literal")

#: what a part of a name adds to its sensitivity
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.8, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "private": 0.5, "access": 0.3, "api": 0.3, "auth": 0.5, "bearer": 0.7, "signing": 0.4, "encryption": 0.4, "key": 0.5,
    "count": -0.8, "length": -0.8, "size": -0.8, "min": -0.5, "max": -0.5, "limit": -0.8, "name": -0.5, "path": -0.8, "file": -0.8,
    "type": -0.8, "url": -0.6, "public": -0.7, "id": -0.3, "policy": -0.8, "field": -0.6, "hint": -0.6, "label": -0.8,
}
#: words that a real value isn't
PLACEHOLDERS = {"changeme", "example", "placeholder", "password", "secret", "token", "none", "null", "true", "false", "todo", "redacted", "required", "optional"}
#: sensitivity and value score that a pair needs
NAME_LEAST, VALUE_LEAST = 0.8, 0.5
#: a text without any of these holds no sensitive name: the other parts alone don't reach NAME_LEAST
STEMS = ("pass", "pwd", "secret", "token", "key", "cred", "auth", "bearer", "private", "signing", "encryption")
#: words of instructions and labels, not of passphrases
PROSE = frozenset("a an and are be by can enter for here in is it my new not of on or please reset set that the this to type use with you your".split())

# a name is consumed whole, with its operator where it has one, so a long run costs one step
_HEAD = re.compile(
    r"""(?P<open><(?P<tag>[A-Za-z_][\w.-]*+)>(?P<body>[^<>]++)</(?P=tag)>)"""
    r"""|(?<![\w-])--?(?P<flag>[A-Za-z][\w-]*+)[ \t]++(?P<flagged>"[^"\n]*"|'[^'\n]*'|[^\s"',;)\]}=:(]++)(?![=:(])"""
    r"""|(?P<name>[A-Za-z_$][\w$.-]*+)(?:["'`]?[ \t]*+(?P<op>:=|=>|=|:)(?![=:])[ \t]*+)?""")
_STRING = re.compile(
    r"""[rRbBuUfF]{0,2}(?:\"{3}(?P<a>.*?)\"{3}|'{3}(?P<b>.*?)'{3}|"(?P<c>(?:[^"\\\n]|\\.)*+)"|'(?P<d>(?:[^'\\\n]|\\.)*+)'|`(?P<e>[^`\n]*+)`)""", re.DOTALL)
_JOIN = re.compile(r"(?:[ \t]|\\\n)*+(?:\+[ \t]*+\n?[ \t]*+)?")
_WORD = re.compile(r"[A-Za-z_$][\w$.]*+")
_BARE = re.compile(r"""[^\s"',;)\]}]++""")
_BLOCK = re.compile(r"[|>][+-]?[0-9]?[+-]?[ \t]*+(?:#[^\n]*+)?\n")
_URL = re.compile(r"""://[^\s:/@"'<>]*+:([^\s/@"'<>]++)@""")
#: a whole value that only stands for another one
_REFERENCE = re.compile(r"\$\{.*\}|\$[A-Za-z_]\w*|\$\(.*\)|%\w+%|\{\{.*\}\}|\{\w*\}|<[^<>]*>|\[[^\[\]]*\]|\*+|\.+|x+", re.DOTALL | re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base rules, each leftmost and non-overlapping per kind."""
    low, found = text.lower(), []
    if any(k in low for k in ("passw", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return found


# a run of the hex rule is as long as it can be, so the long ones can be looked for at once
_LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)


def name_score(name: str) -> float:
    """How sensitive a name is: the best part, plus what the others add or take."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    weights = [NAME_WEIGHTS.get(p, 0.0) for p in parts]
    if "api" in parts and "key" in parts or "private" in parts and "key" in parts:
        weights.append(0.6)
    return max((w for w in weights if w > 0), default=0.0) + 0.5 * sum(w for w in weights if w < 0) + 0.3 * (sum(w > 0 for w in weights) - 1) * (max(weights, default=0) > 0)


def value_score(value: str, quoted: bool = False) -> float:
    """How much a literal looks like a secret: length, spread of characters, no placeholder.  A quoted
    one may hold spaces: a key in lines counts without them, a passphrase by its words."""
    value = value.strip()
    if len(value) < 6 or value.lower() in PLACEHOLDERS or len(set(value)) < 4 or _REFERENCE.fullmatch(value) or re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", value):
        return 0.0
    if " " in value or "\n" in value or "\t" in value:
        words = value.split()
        plain = [w for w in words if re.fullmatch(r"[A-Za-z'.,!?:;-]+", w)]
        if not quoted or {w.lower().strip(".,!?:;") for w in plain} & (PROSE | PLACEHOLDERS):
            return 0.0
        if len(plain) == len(words):  # several words, none of them of a sentence
            return 0.6 if len(words) >= 3 and not value.endswith((".", "!", "?", ":")) else 0.0
        value = "".join(words)
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, entropy / 4) * (0.4 + 0.2 * min(kinds, 3)) * min(1.0, len(value) / 8)


class Literal(NamedTuple):
    """The parts of a literal (start, end), whether it was quoted, and those that were written where a
    name was given it (of a constant alone: the constant's), which the name passes on in turn: so a
    name that is joined to itself again and again doesn't grow."""

    parts: tuple[tuple[int, int], ...]
    quoted: bool
    own: tuple[tuple[int, int], ...] = ()

    def value(self, text: str) -> str:
        return "".join(text[a:b] for a, b in self.parts)


def value_at(text: str, at: int, op: str | None, constants: dict[str, Literal]) -> tuple[Literal | None, int, bool]:
    """The literal of the expression that begins at ``at``, where it ends, and whether it is a constant's.
    None for a call, an index, an unknown name or nothing."""
    parts: list[tuple[int, int]] = []
    own: list[tuple[int, int]] = []
    quoted = passed = False
    first, alias = True, ()
    while True:
        string = _STRING.match(text, at)
        word = None if string else _WORD.match(text, at)
        if string:
            parts.append(string.span(string.lastgroup))
            own.append(parts[-1])
            quoted, at = True, string.end()
        elif first and op == ":" and (block := _BLOCK.match(text, at)):
            return _block(text, at, block.end())
        elif word and text[word.end():word.end() + 1] in ("(", "["):
            return None, word.end(), False  # what a call returns, or a container holds, isn't there to read
        elif word and word[0] in constants:
            parts += constants[word[0]].parts
            alias = alias or constants[word[0]].parts
            quoted, passed, at = quoted or constants[word[0]].quoted, True, word.end()
        elif first:
            bare = _BARE.match(text, at)
            if not bare:
                return None, at, False
            call = re.match(r"[\w$.:>-]*+\(", bare[0])
            joined = re.match(r"[ \t]*+\+[ \t]*+[\"'`]", text[bare.end():bare.end() + 80])
            if not (word and joined):
                return (None if call else Literal((bare.span(),), False)), bare.end(), False
            at = word.end()  # an unknown name before what it is joined with
        elif word:
            at = word.end()
        else:
            break
        gap = _JOIN.match(text, at)
        plus = "+" in gap[0]
        if not (plus or string and _STRING.match(text, gap.end())):
            break
        first, at = False, gap.end()
    return (Literal(tuple(parts), quoted, tuple(own) or alias) if parts else None), at, passed


def _block(text: str, at: int, begin: int) -> tuple[Literal | None, int, bool]:
    """The lines from ``begin`` on that are indented more than the one of ``at``."""
    line = text.rfind("\n", 0, at) + 1
    indent = len(text[line:at]) - len(text[line:at].lstrip(" \t-"))
    start = end = None
    while begin < len(text):
        stop = text.find("\n", begin)
        stop = len(text) if stop < 0 else stop
        own = text[begin:stop]
        if own.strip():
            if len(own) - len(own.lstrip(" \t")) <= indent:
                break
            start = begin + len(own) - len(own.lstrip()) if start is None else start
            end = begin + len(own.rstrip())
        begin = stop + 1
    return (None if start is None else Literal(((start, end),), True)), begin, False


def literal_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, "literal") of literals that reach a sensitive name, directly or as a constant, part by
    part where they are joined; and of the passwords of URLs."""
    found: set[tuple[int, int, str]] = set()
    if "://" in text and "@" in text:
        found.update((*m.span(1), "literal") for m in _URL.finditer(text) if m[1].lower() not in PLACEHOLDERS and not _REFERENCE.fullmatch(m[1]))
    low = text.lower()
    if not any(s in low for s in STEMS) or not any(c in text for c in "=:<-"):
        return sorted(found)
    constants: dict[str, Literal] = {}
    at = 0
    while m := _HEAD.search(text, at):
        at, passed, name = m.end(), False, m["tag"] or m["flag"] or m["name"]
        if m["open"]:
            start, end = m.span("body")
            own = text[start:end]
            literal = Literal(((start + len(own) - len(own.lstrip()), end - (len(own) - len(own.rstrip()))),), "\n" in own.strip())
        elif m["flag"]:
            start, end = m.span("flagged")
            quoted = text[start] in "\"'"
            literal = Literal(((start + quoted, end - quoted),), quoted)
        elif m["op"]:
            literal, after, passed = value_at(text, at, m["op"], constants)
        else:
            continue
        if literal is None:
            continue
        constants[name] = Literal(literal.own or literal.parts, literal.quoted)
        value = literal.value(text)
        if name_score(name) >= NAME_LEAST and value_score(value, literal.quoted) >= VALUE_LEAST and (literal.quoted or passed or not _word(value)):
            found.update((a, b, "literal") for a, b in literal.parts if b > a)
            if m["op"]:
                at = after
        elif m["op"] and not literal.quoted:
            at = max(at, after)
    return sorted(found)


def _word(value: str) -> bool:
    """Bare text that reads as a word or a name rather than a value."""
    return bool(re.fullmatch(r"[A-Za-z_.,!?-]+", value))


def digest(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end, by start and then kind as listed, comma-joined."""
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


SPANS = "array<struct<start:int,end:int,kind:string>>"


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``spans`` (start, end, kind; code points, end
    exclusive; base and lexed), n_assign, n_access, n_hex, base_sha256, span_text.

    A null or empty text has no span.  Lexed literals that lie within one base
    span aren't reported again.  Every row is scanned by itself: null ids, repeated rows, ties and
    texts of any length need no care, an empty table gives an empty one, and columns of other names
    are left aside, whatever they are called."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out: list[list] = [[] for _ in range(6)]
                for raw in text_bytes(part.column(1)):
                    text = raw.decode("utf-8", "replace")
                    base = base_spans(text)
                    more = [x for x in literal_spans(text) if not any(b[0] <= x[0] and x[1] <= b[1] for b in base)]
                    kinds = Counter(k for _, _, k in base)
                    row = ([{"start": s, "end": e, "kind": k} for s, e, k in sorted(base + more)], kinds["assign"], kinds["access"], kinds["hex"],
                           hashlib.sha256(digest(base).encode()).hexdigest(), digest(base + more))
                    for into, value in zip(out, row):
                        into.append(value)
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(out[0], kind), *(pa.array(c, pa.int64()) for c in out[1:4]), *(pa.array(c, pa.string()) for c in out[4:])],
                    names=["doc_id", "spans", "n_assign", "n_access", "n_hex", "base_sha256", "span_text"])

    schema = f"doc_id long, spans {SPANS}, n_assign long, n_access long, n_hex long, base_sha256 string, span_text string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
