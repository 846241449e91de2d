"""Personal data: expressions propose, checksums confirm, context adjusts.

For each kind a regular expression proposes spans, leftmost and without
overlap.  A validator (octet range, Luhn, mod-97, digit count) confirms them.
Words near a span raise or lower its score.  Spans of the base kinds are kept
whatever their score; spans of the added kinds are kept from ``KEEP`` on.

Every expression runs in time linear in the text: a digit run or a run of
e-mail characters is entered once, at its beginning.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._io import numbered, sha256_text, ship, span_text, tidy
from graphloom.llm._text import slices, utf8

BASE_KINDS = ["email", "ip", "card", "phone"]
EXTRA_KINDS = ["iban", "ssn"]
KINDS = [*BASE_KINDS, *EXTRA_KINDS]

#: Score in hundredths of a confirmed span without context.
PRIOR = {"email": 90, "ip": 60, "card": 70, "phone": 60, "iban": 70, "ssn": 30}
RAISE, LOWER = 25, 30
KEEP = 50
#: Code points before and after a span in which context words count.
BEFORE, AFTER = 48, 24

# Context words in lower case.
SUPPORT = {
    "email": ["contact", "email", "mail", "write"],
    "ip": ["address", "host", "ip", "login", "server"],
    "card": ["amex", "card", "credit", "mastercard", "payment", "visa"],
    "phone": ["call", "fax", "mobile", "phone", "tel", "telephone"],
    "iban": ["account", "bank", "iban", "konto", "transfer"],
    "ssn": ["security", "social", "ssn"],
}
AGAINST = {
    "email": ["noreply"],
    "ip": ["release", "section", "version"],
    "card": ["invoice", "isbn", "order", "serial"],
    "phone": ["isbn", "order", "serial"],
    "iban": ["part", "serial"],
    "ssn": ["part", "serial"],
}

# The proposals of the contract and of the added kinds.
EMAIL_LOCAL = r"[A-Za-z0-9._%+-]+"
EMAIL_DOMAIN = r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"[A-Z][A-Z][0-9][0-9]([\x20]?[A-Z0-9][A-Z0-9][A-Z0-9][A-Z0-9]){2,7}([\x20]?[A-Z0-9]{1,3})?"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
PATTERNS = {"email": EMAIL_LOCAL + EMAIL_DOMAIN, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN}

_EMAIL_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_EMAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LINEAR = {
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+"),
    "phone": re.compile(PHONE),
    "iban": re.compile(IBAN),
    "ssn": re.compile(SSN),
}
#: Linear-time scans that a text with a confirmed span can't fail.
_SCREEN = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
    "card": r"[0-9]([\x20-]?[0-9]){11}",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z][A-Z][0-9][0-9][\x20]?[A-Z0-9]{4}",
    "ssn": SSN,
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    rest = 0
    for c in moved:
        v = ord(c) - 48 if c <= "9" else ord(c) - 55
        rest = (rest * (10 if v < 10 else 100) + v) % 97
    return rest == 1


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _ip_ok(text: str, value: str, start: int, end: int) -> bool:
    parts = [p.lstrip("0") for p in value.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _card_ok(text: str, value: str, start: int, end: int) -> bool:
    return 12 <= len(d := _digits(value)) <= 19 and luhn(d)


def _phone_ok(text: str, value: str, start: int, end: int) -> bool:
    return 9 <= len(_digits(value)) <= 15


def _iban_ok(text: str, value: str, start: int, end: int) -> bool:
    return 15 <= len(v := value.replace(" ", "")) <= 34 and mod97(v)


def _ssn_ok(text: str, value: str, start: int, end: int) -> bool:
    around = text[max(0, start - 1) : start] + text[end : end + 1]
    return not any(c in "0123456789-" for c in around)


_VALID: dict[str, Callable[[str, str, int, int], bool]] = {"ip": _ip_ok, "card": _card_ok, "phone": _phone_ok, "iban": _iban_ok, "ssn": _ssn_ok}


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match holds one @, right after its local part, so the parts before an
    @ are looked for backwards, never past the match before."""
    done = 0
    for m in _EMAIL_AT.finditer(text):
        at = m.start()
        start = at
        while start > done and text[start - 1] in _EMAIL_CHARS:
            start -= 1
        if start < at:
            yield start, m.end()
            done = m.end()


def proposed(text: str, kind: str) -> Iterator[tuple[int, int]]:
    """Confirmed spans of one kind in code points."""
    if kind == "email":
        yield from _emails(text)
        return
    valid = _VALID[kind]
    for m in _LINEAR[kind].finditer(text):
        if valid(text, m.group(), m.start(), m.end()):
            yield m.span()


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_NEAR = {kind: tuple(re.compile("(^|[^a-z])(" + "|".join(words[kind]) + ")([^a-z]|$)") for words in (SUPPORT, AGAINST)) for kind in KINDS}


def score(text: str, kind: str, start: int, end: int) -> int:
    """0 to 100: the kind's prior, raised or lowered by words near the span."""
    before = text[max(0, start - BEFORE) : start].translate(_ASCII_LOWER)
    after = text[end : end + AFTER].translate(_ASCII_LOWER)
    support, against = _NEAR[kind]
    value = PRIOR[kind]
    if support.search(before) or support.search(after):
        value += RAISE
    if against.search(before) or against.search(after):
        value -= LOWER
    return max(0, min(100, value))


def find(text: str, kinds: list[str] | None = None) -> list[tuple[int, int, int, int]]:
    """(start, place of the kind in KINDS, end, score) of the spans kept."""
    out = []
    for k, kind in enumerate(KINDS):
        if kinds is not None and kind not in kinds:
            continue
        for s, e in proposed(text, kind):
            value = score(text, kind, s, e)
            if kind in BASE_KINDS or value >= KEEP:
                out.append((s, k, e, value))
    return sorted(out)


def _found(texts: pa.Array) -> list[list[tuple[int, int, int, int]]]:
    if texts.null_count:
        texts = texts.fill_null("")
    hits: dict[int, list[str]] = {}
    for kind, screen in _SCREEN.items():
        test = pc.match_substring(texts, screen) if kind == "email" else pc.match_substring_regex(texts, screen)
        for d in pc.indices_nonzero(test).to_pylist():
            hits.setdefault(d, []).append(kind)
    return [find(texts[d].as_py(), hits[d]) if d in hits else [] for d in range(len(texts))]


def _batches(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        _, offsets = utf8(batch.column(place))
        for i, j in slices(offsets):
            part = batch.slice(i, j - i)
            yield part, _found(part.column(place))


def pii_digests(df: DataFrame) -> DataFrame:
    """The contract's columns, and ``scores`` in the order of ``spans``.

    Null and empty texts have no spans; a null id is kept; repeated rows give
    repeated rows; an empty table gives an empty result.  Other columns are not read.
    """
    ship(df.sparkSession)
    base = range(len(BASE_KINDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _batches(batches, 1):
            own = [[(s, k, e) for s, k, e, _ in x] for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    *(pa.array([sum(k == b for _, k, _ in x) for x in own], pa.int64()) for b in base),
                    pa.array([sha256_text(span_text([y for y in x if y[1] in base], KINDS)) for x in own], pa.string()),
                    pa.array([span_text(x, KINDS) for x in own], pa.string()),
                    pa.array([",".join(str(v) for *_, v in x) for x in found], pa.string()),
                ],
                names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "scores"],
            )

    schema = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in BASE_KINDS) + ", base_sha256 string, spans string, scores string"
    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), schema)


def redact(text: str, spans: list[tuple[int, int, int, int]]) -> str:
    """Each span replaced by its kind in capitals and angle brackets; of
    overlapping spans the union is replaced under the first one's kind."""
    out, at = [], 0
    for s, k, e, _ in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``df`` with personal data in the text replaced.

    Null texts stay null, and so do null ids; repeated rows stay; an empty table
    gives an empty result.  The columns keep their order, names and types;
    ``text_col`` is a string.
    """
    ship(df.sparkSession)
    names = df.columns
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _batches(batches, place):
            columns = part.columns
            if any(found):
                texts = columns[place]
                columns[place] = pa.array([redact(texts[i].as_py(), x) if x else texts[i].as_py() for i, x in enumerate(found)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    plain, schema = numbered(df)
    return plain.mapInArrow(tidy(run), schema).toDF(*names)
