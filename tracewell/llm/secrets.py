"""Secret scans with a trigram inverted index.

A Boolean query over trigrams is derived from every rule's regular expression: trigrams that each
match must hold are joined by AND, alternatives by OR. Documents are indexed in segments of bounded
size (as a search engine does): postings, from trigram to documents, for the trigrams that any query
names. Queries intersect and unite postings, and only the documents left are scanned with the rule's
expression. A rule without mandatory trigrams, such as a run of hex digits, scans every document.
The index folds A-Z, so it also serves rules that ignore case. Segments live and die inside a task,
beside the texts they index; nothing is shuffled.

Defined results: a null text is empty; spans are in code points, end exclusive; a rule's matches
don't overlap each other, those of different rules may; repeated rows are scanned one by one; an
empty table gives no rows. Texts are scanned whole. Bytes that aren't UTF-8 count as one replacement
character each.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.words import LOWER

SEGMENT_BYTES = 4_000_000
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and what else a match must satisfy."""

    kind: str
    pattern: str
    flags: int = 0
    keep: Callable[[re.Match], bool] | None = None

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, self.flags)

    @cached_property
    def query(self):
        return trigram_query(self.pattern, self.flags)

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = self.regex.finditer(text)
        return [m.span() for m in found if self.keep is None or self.keep(m)]


def _long_value(m: re.Match) -> bool:
    return len(m[2]) >= 8


# The first three are given; for the runs, {16,} and {32,} find what dropping shorter runs would leave.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                   r"([A-Za-z0-9+/_.=-]+)", re.I | re.A, _long_value),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
ADDED = (
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + ADDED

# ---- from expressions to Boolean queries --------------------------------------------------------
# A query is True (no constraint), a trigram, ("and", parts) or ("or", parts).


def _all_of(parts):
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any_of(parts):
    parts = list(dict.fromkeys(parts))
    return True if True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _from_strings(strings: Iterable[str]):
    """What must hold if the text has one of the strings."""
    folded = {s.lower() for s in strings}
    return _any_of([_all_of(dict.fromkeys(s[i:i + 3] for i in range(len(s) - 2)))
                    for s in sorted(folded)])


def _class_strings(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg))
        elif op is sre.RANGE and arg[1] - arg[0] < 8:
            out |= {chr(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(parsed):
    """(strings that the part may be, or None if not known; query that holds beside them)."""
    known: set[str] = {""}  # what the text since the last unknown element may be
    parts: list = []
    exact = True

    for op, arg in parsed:
        strings, query = None, True
        if op is sre.LITERAL:
            strings = {chr(arg)}
        elif op is sre.IN:
            strings = _class_strings(arg)
        elif op is sre.SUBPATTERN:
            strings, query = _walk(arg[3])
        elif op is sre.BRANCH:
            walked = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in walked):
                strings = set().union(*[s for s, _ in walked])
            else:
                query = _any_of([q if s is None else _from_strings(s) for s, q in walked])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, sub = arg
            inner, inner_query = _walk(sub)
            if (low, high) == (0, 1) and inner is not None:
                strings = inner | {""}
            elif low >= 1:
                query = inner_query if inner is None else _from_strings(inner)
        elif op is sre.AT:
            strings = {""}
        parts.append(query)
        joined = None if strings is None else {a + b for a in known for b in strings}
        if joined is not None and len(joined) <= MOST_STRINGS:
            known = joined
        else:
            parts.append(_from_strings(known))
            known, exact = strings or {""}, False
    return (known, True) if exact else (None, _all_of([*parts, _from_strings(known)]))


def trigram_query(pattern: str, flags: int = 0):
    """The Boolean query that any text with a match satisfies, over text folded in A-Z."""
    strings, query = _walk(_parser.parse(pattern, flags))
    return query if strings is None else _from_strings(strings)


def query_trigrams(query) -> set[str]:
    if query is True:
        return set()
    if isinstance(query, str):
        return {query}
    return set().union(*[query_trigrams(q) for q in query[1]])


# ---- the index ----------------------------------------------------------------------------------


class Segment:
    """Postings of a few texts, for chosen trigrams of single-byte characters."""

    def __init__(self, texts: list[bytes], trigrams: list[str]):
        self.n = len(texts)
        folded = np.frombuffer(b"\0\0".join(texts).translate(LOWER) + b"\0\0", np.uint8)
        table = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(trigrams, 1):
            a, b, c = t.encode("latin-1")
            table[(a << 16) | (b << 8) | c] = i
        wide = folded.astype(np.uint32)
        found = table[(wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]]
        at = np.flatnonzero(found)
        ends = np.cumsum([len(t) + 2 for t in texts])
        pairs = np.unique(found[at].astype(np.int64) * (self.n + 1)
                          + np.searchsorted(ends, at, side="right"))
        which, docs = pairs // (self.n + 1), pairs % (self.n + 1)
        bounds = np.searchsorted(which, np.arange(1, len(trigrams) + 2))
        self.postings = {t: docs[bounds[i]:bounds[i + 1]] for i, t in enumerate(trigrams)}

    def find(self, query) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, str):
            return self.postings[query]
        sets = sorted((self.find(q) for q in query[1]), key=len)
        out = sets[0]
        for s in sets[1:]:
            out = np.intersect1d(out, s, True) if query[0] == "and" else np.union1d(out, s)
        return out


def scan(texts: list[bytes], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """Per text the (start, rule, end) of every match, in order."""
    queries = [r.query for r in rules]
    trigrams = sorted(set().union(*[query_trigrams(q) for q in queries]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= SEGMENT_BYTES):
            size += len(texts[end])
            end += 1
        segment, whole = Segment(texts[begin:end], trigrams), {}
        for number, rule in enumerate(rules):
            for i in segment.find(queries[number]).tolist():
                if i not in whole:
                    whole[i] = texts[begin + i].decode("utf-8", "replace")
                out[begin + i] += [(a, number, b) for a, b in rule.spans(whole[i])]
        begin = end
    return [sorted(x) for x in out]


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                     T.StructField("end", T.LongType())])


def secret_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All matches in a text, as an array of (kind, start, end) by start, then rule."""
    kinds = [r.kind for r in rules]

    @F.arrow_udf(T.ArrayType(SPAN))
    def find(col: pa.Array) -> pa.Array:
        found = scan([t or b"" for t in col.to_pylist()], rules)
        flat = [(kinds[k], a, b) for spans in found for a, k, b in spans]
        items = pa.StructArray.from_arrays(
            [pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.int64()),
             pa.array([x[2] for x in flat], pa.int64())], ["kind", "start", "end"])
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), items)

    return find(text.cast("binary"))
