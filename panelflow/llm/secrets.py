"""Secret scan over an inverted trigram index."""

from __future__ import annotations

import functools
import hashlib
import re
import re._parser as sre
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A query is a list of alternatives, each a list of literals all of which a match contains; an empty list asks nothing.
Query = list[list[str]]

MOST = 64  # alternatives of a query, at most; a part of a regex that needs more asks nothing
WIDEST = 8  # characters of a class that is spelled out


def _asked(strings: set[str]) -> Query:
    """Any of the strings, without those that hold another one; nothing where one is too short for a trigram."""
    if any(len(x) < 3 for x in strings):
        return []
    return [[x] for x in sorted(strings) if not any(y != x and y in x for y in strings)]


def _both(a: Query, b: Query) -> Query:
    """Both queries; where their product is too large, the one with fewer alternatives."""
    if not a or not b:
        return a or b
    if len(a) * len(b) > MOST:
        return min(a, b, key=len)
    return [sorted({*x, *y}) for x in a for y in b]


def _sequence(tree) -> tuple[set[str] | None, Query]:
    """The strings that a parsed sequence matches exactly, or None, and the query of what it holds besides."""
    strings, whole, query = {""}, True, []
    for op, arg in tree:
        exact, inner = _part(str(op), arg)
        query = _both(query, inner)
        if exact is not None and len(strings) * len(exact) <= MOST:
            strings = {x + y for x in strings for y in exact}
        else:  # the strings so far end here
            query = _both(_both(query, _asked(strings)), _asked(exact or {""}))
            strings, whole = {""}, False
    return (strings, query) if whole else (None, _both(query, _asked(strings)))


def _part(op: str, arg) -> tuple[set[str] | None, Query]:
    if op == "LITERAL":
        return {chr(arg).lower()}, []
    if op == "IN":
        if any(str(o) not in ("LITERAL", "RANGE") for o, _ in arg):
            return None, []
        size = sum(1 if str(o) == "LITERAL" else x[1] - x[0] + 1 for o, x in arg)
        if size > WIDEST:
            return None, []
        return {chr(c).lower() for o, x in arg for c in ([x] if str(o) == "LITERAL" else range(x[0], x[1] + 1))}, []
    if op == "SUBPATTERN":
        return _sequence(arg[3])
    if op == "BRANCH":
        parts = [_sequence(p) for p in arg[1]]
        if all(exact is not None and not inner for exact, inner in parts):
            return set().union(*(exact for exact, _ in parts)), []
        united = [inner or _asked(exact or {""}) for exact, inner in parts]
        return None, sum(united, []) if all(united) else []
    if op.endswith("_REPEAT"):
        least, most, part = arg
        exact, inner = _sequence(part)
        if (least, most) == (1, 1):
            return exact, inner
        if (least, most) == (0, 1) and exact is not None:
            return exact | {""}, []
        return None, (_both(inner, _asked(exact or {""})) if least else [])
    return ({""}, []) if op in ("AT", "ASSERT_NOT") else (None, [])


@functools.lru_cache(maxsize=None)
def _derived(pattern: str) -> tuple[tuple[str, ...], ...]:
    exact, query = _sequence(sre.parse(pattern))
    return tuple(map(tuple, _both(query, _asked(exact or {""}))))


def mandatory(pattern: str) -> Query:
    """Literals (lower case) that every match of a regex contains, derived from its parsed form.

    Concatenations join the exact strings of their parts, alternations unite them, optional parts add the empty
    string, small classes are spelled out; anything else ends a string, which is then asked for. Strings of
    fewer than three characters hold no trigram and ask nothing.
    """
    return [list(x) for x in _derived(pattern)]


@dataclass(frozen=True)
class Rule:
    """kind, regex and what a match must fulfil.

    A rule whose matches begin with a run of one character class may name an `anchor` instead: a regex
    for what follows the run, the run's characters, and a regex for where in the run a match begins. Anchors are searched
    and runs are walked back from them, so that a long run without an anchor is read once, not once from each of its places.
    """

    kind: str
    pattern: str
    keep: Callable[[re.Match], bool] = lambda m: True
    anchor: tuple[str, str, str] | None = None

    def trigrams(self) -> Query:
        """Boolean query: any of the alternatives, each of which needs all its trigrams. Empty: every text is scanned."""
        return [sorted({w[i:i + 3] for w in alt for i in range(len(w) - 2)}) for alt in mandatory(self.pattern)]

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Leftmost matches that do not overlap."""
        if self.anchor is None:
            yield from ((m.start(), m.end()) for m in _regex(self.pattern).finditer(text) if self.keep(m))
            return
        rest, run, head = _regex(self.anchor[0]), frozenset(self.anchor[1]), _regex(self.anchor[2])
        done = at = 0
        while m := rest.search(text, at):
            start = m.start()
            while start > done and text[start - 1] in run:
                start -= 1
            h = head.search(text, start, m.start())
            at = m.end() if h else m.start() + 1
            if h:
                yield h.start(), m.end()
                done = m.end()


_regex = functools.lru_cache(maxsize=None)(functools.partial(re.compile, flags=re.ASCII))

_LETTERS, _DIGITS = string.ascii_letters, string.digits
# The three base rules, then the rules added.
BASE = (
    Rule(
        "assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: len(m[2]) >= 8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    Rule("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
)
ADDED = (
    Rule("key_block", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
         anchor=(r"\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", _LETTERS + _DIGITS + "_-", r"eyJ(?=[A-Za-z0-9_-]{8,})")),
    Rule("url_login", r"[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s/@]+@",
         anchor=(r"://[^\s:/@]+:[^\s/@]+@", string.ascii_lowercase + _DIGITS + "+.-", r"[a-z]")),
)
RULES = BASE + ADDED
SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


CHUNK = 1 << 22  # bytes indexed at once


@functools.lru_cache(maxsize=4)
def _numbers(trigrams: tuple[str, ...]) -> np.ndarray:
    """Number (from 1) of each asked trigram by its three bytes; 0 for all others."""
    table = np.zeros(1 << 24, np.uint8 if len(trigrams) < 255 else np.uint16)
    for i, g in enumerate(trigrams, 1):
        a, b, c = g.encode()
        table[a << 16 | b << 8 | c] = i
    return table


class TrigramIndex:
    """Inverted index of one block of texts: for each trigram that the rules ask for, the texts that hold it.

    One pass over the bytes of the block reads every trigram of every text; A-Z count as a-z.
    """

    def __init__(self, texts: list[str], trigrams: list[str]):
        self.size = len(texts)
        held = np.zeros((len(trigrams) + 1, len(texts)), bool)
        table = _numbers(tuple(trigrams))
        # two zero bytes part the texts, so no trigram reaches across
        raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        begins = np.cumsum([0, *(len(r) + 2 for r in raw)])[:-1]
        data = np.frombuffer(b"\0\0".join(raw), np.uint8)
        for at in range(0, max(0, len(data) - 2), CHUNK):
            d = data[at:at + CHUNK + 2].astype(np.int32)
            found = table[d[:-2] << 16 | d[1:-1] << 8 | d[2:]]
            where = np.flatnonzero(found)
            held[found[where], np.searchsorted(begins, where + at, side="right") - 1] = True
        self.postings = {g: held[i] for i, g in enumerate(trigrams, 1)}

    def candidates(self, query: Query) -> np.ndarray:
        """Numbers of the texts that fulfil the query; all of them where it is empty."""
        if not query:
            return np.arange(self.size)
        hit = np.zeros(self.size, bool)
        for alternative in query:
            hit |= np.logical_and.reduce([self.postings[g] for g in alternative])
        return np.flatnonzero(hit)


def scan_block(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int, str]]]:
    """Spans (start, rank of the kind, end, kind) of each text, by start, then kind as listed."""
    wanted = [r.trigrams() for r in rules]
    index = TrigramIndex(texts, sorted({g for q in wanted for alt in q for g in alt}))
    found: list[list[tuple]] = [[] for _ in texts]
    for rank, (rule, query) in enumerate(zip(rules, wanted)):
        for i in index.candidates(query):
            found[i].extend((start, rank, end, rule.kind) for start, end in rule.spans(texts[i]))
    return [sorted(f) for f in found]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans.

    The parsed regex of each rule yields a Boolean query over trigrams (`mandatory`); every block of rows gets an inverted index of
    the trigrams asked for, a query intersects and unites postings, and only candidates meet the regex. The
    rule `hex` has no mandatory trigram and scans all texts. Blocks are Arrow batches of the scan: no
    shuffle, and a lost task rebuilds its block from the input.

    spans are kind:start:end (code points, end exclusive) by start, then by kind as the rules are listed;
    base_sha256 is the digest of the base rules' spans alone. Matches of one kind never overlap, those of
    different kinds may. Null and empty texts have no span (digest of the empty string). Repeated rows
    are scanned each, null ids pass through, an empty table gives an empty table.
    """
    base = {r.kind: i for i, r in enumerate(BASE)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                spans = scan_block([t or "" for t in part.column(1).to_pylist()])
                counts = np.zeros((len(base), len(spans)), np.int64)
                digests, shown = [], []
                for i, row in enumerate(spans):
                    named = [(f"{kind}:{a}:{b}", base.get(kind)) for a, _, b, kind in row]
                    for _, rank in named:
                        if rank is not None:
                            counts[rank, i] += 1
                    digests.append(hashlib.sha256(",".join(s for s, rank in named if rank is not None).encode()).hexdigest())
                    shown.append(",".join(s for s, _ in named))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(shown, pa.string())],
                    [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    rows = docs.select(F.col(id_col), F.col(text_col))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(scan, f"`{id_col}` {kind}, {SCHEMA}")
