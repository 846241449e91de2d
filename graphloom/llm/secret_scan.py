"""Secret scan by a trigram inverted index.

Each rule is a regular expression.  A Boolean query over trigrams that every
match must contain is derived from the expression's syntax tree.  Documents
are indexed in segments: for the trigrams that some rule asks for, a segment
has a sorted posting list of its documents.  A rule's query is answered by
intersecting and uniting postings, and only the candidates are verified with
the expression itself.  A rule without a mandatory trigram has the query ALL
and scans every document of the segment.

Segments make the index a map-side structure: nothing is shuffled, a segment
holds a bounded number of bytes, and a lost task rebuilds only its own.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._io import sha256_text, ship, span_text, tidy
from graphloom.llm._text import LOWER, slices, utf8

# The standard library's own parser of expressions; a test holds its trees.
if sys.version_info >= (3, 11):
    import re._constants as sre
    import re._parser as sre_parser
else:
    import sre_constants as sre
    import sre_parse as sre_parser

# --- queries -----------------------------------------------------------------

ALL = ("all",)
#: Sets of exact strings larger than this are turned into trigrams.
MAX_EXACT = 16
MAX_CLASS = 4


def _and(parts: list[tuple]) -> tuple:
    flat = [q for p in parts for q in (p[1] if p[0] == "and" else [p]) if q != ALL]
    flat = list(dict.fromkeys(flat))
    return ALL if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def _or(parts: list[tuple]) -> tuple:
    flat = list(dict.fromkeys(q for p in parts for q in (p[1] if p[0] == "or" else [p])))
    if not flat or ALL in flat:
        return ALL
    return flat[0] if len(flat) == 1 else ("or", tuple(flat))


def _grams(text: str) -> tuple:
    return _and([("tri", text[i : i + 3]) for i in range(len(text) - 2)])


def _grams_of_any(texts: set[str]) -> tuple:
    return _or([_grams(t) for t in texts]) if texts else ALL


@dataclass(frozen=True)
class _Info:
    """What is known of a subexpression's matches, in lower case.

    ``exact`` is the set of all matches if it is small; ``prefix`` and ``suffix``
    hold a possible beginning and end of every match; ``match`` is a query that
    every text with a match satisfies.
    """

    exact: frozenset[str] | None
    prefix: frozenset[str]
    suffix: frozenset[str]
    match: tuple


_ANY = _Info(None, frozenset({""}), frozenset({""}), ALL)


def _exact(texts: set[str] | frozenset[str]) -> _Info:
    texts = frozenset(texts)
    return _Info(texts, texts, texts, ALL)


def _spread(info: _Info) -> _Info:
    """Give up the exact set for trigrams and ends of two characters."""
    if info.exact is None:
        return info
    return _Info(None, frozenset(t[:2] for t in info.exact), frozenset(t[-2:] for t in info.exact), _and([info.match, _grams_of_any(set(info.exact))]))


def _join(a: _Info, b: _Info) -> _Info:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MAX_EXACT:
        return _exact({x + y for x in a.exact for y in b.exact})
    across = _grams_of_any({x + y for x in a.suffix for y in b.prefix}) if len(a.suffix) * len(b.prefix) <= 4 * MAX_EXACT else ALL
    if a.exact is not None and b.exact is None and len(a.exact) * len(b.prefix) <= MAX_EXACT:
        prefix = frozenset(x + y for x in a.exact for y in b.prefix)
    else:
        prefix = _spread(a).prefix
    if b.exact is not None and a.exact is None and len(b.exact) * len(a.suffix) <= MAX_EXACT:
        suffix = frozenset((x + y)[-2:] for x in a.suffix for y in b.exact)
    else:
        suffix = _spread(b).suffix
    return _Info(None, frozenset(p[:2] for p in prefix), suffix, _and([_spread(a).match, across, _spread(b).match]))


def _either(options: list[_Info]) -> _Info:
    if all(o.exact is not None for o in options) and sum(len(o.exact) for o in options) <= MAX_EXACT:
        return _exact({t for o in options for t in o.exact})
    options = [_spread(o) for o in options]
    return _Info(None, frozenset().union(*(o.prefix for o in options)), frozenset().union(*(o.suffix for o in options)), _or([o.match for o in options]))


def _analyse(nodes) -> _Info:
    info = _exact({""})
    for op, value in nodes:
        info = _join(info, _analyse_one(op, value))
    return info


def _analyse_one(op, value) -> _Info:
    if op is sre.LITERAL:
        return _exact({chr(value).lower()}) if value < 128 else _ANY
    if op is sre.IN:
        found: set[str] = set()
        for kind, x in value:
            if kind is sre.LITERAL and x < 128:
                found.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] < 128 and x[1] - x[0] < MAX_CLASS:
                found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return _ANY
        return _exact(found) if len(found) <= MAX_CLASS else _ANY
    if op is sre.SUBPATTERN:
        return _analyse(value[3])
    if op is sre.BRANCH:
        return _either([_analyse(branch) for branch in value[1]])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, body = value
        inner = _analyse(body)
        if low == 0:
            if high == 1 and inner.exact is not None and len(inner.exact) < MAX_EXACT:
                return _exact(inner.exact | {""})
            return _ANY
        if low == high == 1:
            return inner
        spread = _spread(inner)
        return _Info(None, spread.prefix, spread.suffix, spread.match)
    if op is sre.AT:
        return _exact({""})
    return _ANY


def trigram_query(pattern: str) -> tuple:
    """The Boolean trigram query of a regular expression, on lower-case text.

    ``("all",)``, ``("tri", "abc")``, ``("and", (...))`` or ``("or", (...))``.
    Every text in which the pattern matches satisfies it.
    """
    info = _analyse(sre_parser.parse(pattern))
    return _spread(info).match


def query_trigrams(query: tuple) -> set[str]:
    if query[0] == "tri":
        return {query[1]}
    return set().union(*(query_trigrams(q) for q in query[1])) if len(query) > 1 else set()


# --- rules -------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and without overlap; matches of which
    ``least`` characters are not reached by ``group`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


# The rules of the contract, in the order in which ties are listed.
ASSIGN_KEYS = ["password", "passwd", "secret", "token"]
ASSIGN = (
    "(" + "|".join(either_case(w) for w in ASSIGN_KEYS) + "|" + either_case("api") + "_?" + either_case("key") + ")"
    + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
BASE_RULES = [
    Rule("assign", ASSIGN, group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
]
# Published forms of further credentials.
EXTRA_RULES = [
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,250}"),
]
RULES = [*BASE_RULES, *EXTRA_RULES]


# --- the index ---------------------------------------------------------------


class Segment:
    """Postings of the asked trigrams over a run of documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, grams: list[str]) -> None:
        self.n = len(offsets) - 1
        wanted = np.array(sorted(int.from_bytes(g.encode(), "big") for g in grams), dtype=np.int32)
        self.postings: dict[str, np.ndarray] = {g: np.zeros(0, np.int64) for g in grams}
        if len(data) < 3 or not len(wanted):
            return
        slot = np.zeros(1 << 24, dtype=np.uint16) if _SLOTS.get("for") != tuple(wanted) else _SLOTS["table"]
        if _SLOTS.get("for") != tuple(wanted):
            slot[wanted] = np.arange(1, len(wanted) + 1)
            _SLOTS.update({"for": tuple(wanted), "table": slot})
        low = LOWER[data].astype(np.int32)
        found = slot[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        place = np.flatnonzero(found)
        doc = np.searchsorted(offsets, place, side="right") - 1
        whole = place + 3 <= offsets[doc + 1]  # not across two documents
        key = np.unique(found[place[whole]].astype(np.int64) * self.n + doc[whole])
        which, doc = key // self.n, key % self.n
        cuts = np.searchsorted(which, np.arange(1, len(wanted) + 2))
        for i, code in enumerate(wanted):
            self.postings[int(code).to_bytes(3, "big").decode()] = doc[cuts[i] : cuts[i + 1]]

    def candidates(self, query: tuple) -> np.ndarray:
        """Sorted places of the documents that satisfy a query."""
        if query[0] == "all":
            return np.arange(self.n)
        if query[0] == "tri":
            return self.postings[query[1]]
        if query[0] == "and":
            held = sorted((self.candidates(q) for q in query[1]), key=len)
            out = held[0]
            for other in held[1:]:
                if not len(out):
                    break
                out = np.intersect1d(out, other, assume_unique=True)
            return out
        return np.unique(np.concatenate([self.candidates(q) for q in query[1]]))


_SLOTS: dict = {}


def _full_scan(texts: pa.Array, rule: Rule) -> np.ndarray:
    """Documents of a rule without mandatory trigrams: a linear-time scan of every text."""
    pattern = rule.pattern
    if rule.group == 0 and pattern.endswith("+") and rule.least > 1:
        pattern = f"{pattern[:-1]}{{{min(rule.least, 1000)},}}"
    return np.flatnonzero(pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False))


def scan_batch(texts: pa.Array, rules: list[Rule]) -> list[list[tuple[int, int, int]]]:
    """Spans (start, place of the rule, end) in code points of each text."""
    if texts.null_count:
        texts = texts.fill_null("")
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted(set().union(*(query_trigrams(q) for q in queries)))
    data, offsets = utf8(texts)
    segment = Segment(data, offsets, grams)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    held: dict[int, str] = {}
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        places = _full_scan(texts, rule) if query == ALL else segment.candidates(query)
        verify = re.compile(rule.pattern)
        for d in places.tolist():
            text = held.get(d)
            if text is None:
                text = held[d] = texts[d].as_py()
            out[d] += [(m.start(), k, m.end()) for m in verify.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    for spans in out:
        spans.sort()
    return out


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """One row per input row: id, ``spans`` array<struct<kind, start, end>>.

    Null and empty texts give an empty array; a null id is kept; repeated rows
    give repeated rows; other columns are not read.  Spans are by start, then
    in the order of the rules.
    """
    ship(df.sparkSession)
    rules = RULES if rules is None else rules
    kinds = [r.kind for r in rules]
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for ids, spans in _scanned(batches, rules):
            rows = [[{"kind": kinds[k], "start": s, "end": e} for s, k, e in x] for x in spans]
            yield pa.RecordBatch.from_arrays([ids, pa.array(rows, type=pa.list_(span))], names=["id", "spans"])

    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = chosen.mapInArrow(tidy(run), f"id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return found.withColumnRenamed("id", id_col)


def _scanned(batches: Iterator[pa.RecordBatch], rules: list[Rule]) -> Iterator[tuple[pa.Array, list]]:
    for batch in batches:
        _, offsets = utf8(batch.column(1))
        for i, j in slices(offsets):
            yield batch.column(0).slice(i, j - i), scan_batch(batch.column(1).slice(i, j - i), rules)


def secret_digests(df: DataFrame, rules: list[Rule] | None = None, base: int = len(BASE_RULES)) -> DataFrame:
    """The contract's columns: counts and digest of the first ``base`` rules, and all spans as text.

    Null and empty texts have no spans; a null id is kept; repeated rows give
    repeated rows; an empty table gives an empty result.  Other columns are not read.
    """
    ship(df.sparkSession)
    rules = RULES if rules is None else rules
    kinds = [r.kind for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, spans in _scanned(batches, rules):
            counts = [pa.array([sum(k == b for _, k, _ in x) for x in spans], pa.int64()) for b in range(base)]
            own = [sha256_text(span_text([y for y in x if y[1] < base], kinds)) for x in spans]
            yield pa.RecordBatch.from_arrays(
                [ids, *counts, pa.array(own, pa.string()), pa.array([span_text(x, kinds) for x in spans], pa.string())],
                names=["doc_id", *(f"n_{k}" for k in kinds[:base]), "base_sha256", "spans"],
            )

    schema = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in kinds[:base]) + ", base_sha256 string, spans string"
    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), schema)

