"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust a score."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.text import ship, whole

ship(__name__)

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match begins at the first digit of a run: from a later one the signs after the run are the same
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
LOOSE_PHONE = re.compile(r"(?<![0-9+(.])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "loose_phone", "national_id")
# A pattern alone gives a span its first score; a valid checksum or a word nearby that names the kind raises it, and a
# word that names another use lowers it. A span of an added kind is reported from 0.5.
FIRST = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.9, "loose_phone": 0.3, "national_id": 0.4}
NEAR = {
    "email": ("mail", "email", "contact", "write"), "ip": ("ip", "host", "address", "server"),
    "card": ("card", "visa", "credit", "payment"), "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"), "loose_phone": ("phone", "call", "tel", "mobile", "fax"),
    "national_id": ("ssn", "social", "security", "taxpayer"),
}
AGAINST = ("version", "order", "invoice", "isbn", "build", "release", "example", "serial")
AROUND = 48
WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an account number leaves 1 modulo 97, letters read as 10 to 35, its first four signs moved to the end."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the run of local signs before it: the leftmost match begins where the run or the last match ends."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The four base kinds: leftmost matches that don't overlap within a kind, those that fail their check dropped."""
    found = [(a, b, "email") for a, b in _emails(text)]
    found += [(*m.span(), "ip") for m in IP.finditer(text) if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            found.append((*m.span(), "card"))
    found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return found


def score(text: str, start: int, end: int, kind: str) -> float:
    """The pattern's first score, moved by the words within 48 characters on either side."""
    around = set(WORD.findall((text[max(0, start - AROUND):start] + " " + text[end:end + AROUND]).lower()))
    s = FIRST[kind] + 0.3 * bool(around.intersection(NEAR[kind])) - 0.3 * bool(around.intersection(AGAINST))
    return min(1.0, max(0.0, s))


def added_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """What the method adds: account numbers that pass mod 97, and local telephone and national numbers that the words
    nearby support. A span that overlaps one already taken is left out."""
    proposed = [(*m.span(), "iban") for m in IBAN.finditer(text) if mod97(m[0].replace(" ", ""))]
    for pattern, kind in ((LOOSE_PHONE, "loose_phone"), (NATIONAL, "national_id")):
        proposed += [(*m.span(), kind) for m in pattern.finditer(text) if score(text, *m.span(), kind) >= 0.5]
    if not proposed:
        return []
    # base spans by start with the furthest end so far; what is taken on the way ends where the next may begin
    base, out, free = sorted((a, b) for a, b, _ in base), [], 0
    starts, ends = [a for a, _ in base], list(accumulate((b for _, b in base), max))
    for a, b, kind in sorted(proposed, key=lambda x: x[0]):
        before = bisect_left(starts, b)  # base spans that begin before b
        if a >= free and (before == 0 or ends[before - 1] <= a):
            free = b
            out.append((a, b, kind))
    return out


def spans_of(text: str) -> tuple[list, list]:
    """(base, all) spans of a text, each by start and then by kind."""
    order = lambda x: (x[0], KINDS.index(x[2]), x[1])
    base = base_spans(text)
    return sorted(base, key=order), sorted(base + added_spans(text, base), key=order)


def _written(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: the id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and scores (one per span).

    Offsets are code points, the end exclusive. Null and empty texts have no spans: counts of 0 and the digest of the
    empty string. Rows that repeat get a result each. An empty table gives no rows; other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = (f"`{id_col}` {id_type}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
              "spans string, scores array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans, scores = {k: [] for k in BASE}, [], [], []
            for cell in batch.column(1):
                text = cell.as_py()
                base, every = spans_of(text)
                for k in BASE:
                    counts[k].append(sum(x[2] == k for x in base))
                digests.append(hashlib.sha256(_written(base).encode()).hexdigest())
                spans.append(_written(every))
                scores.append([score(text, *x) for x in every])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests, pa.string()),
                 pa.array(spans, pa.string()), pa.array(scores, pa.list_(pa.float64()))],
                names=[id_col, *(f"n_{k}" for k in BASE), "base_sha256", "spans", "scores"])

    return docs.select(F.col(id_col), whole(F.col(text_col)).alias("text")).mapInArrow(run, schema)
