"""Personal data: Aho-Corasick anchors, local parsers that expand and validate boundaries.

The automaton finds at-signs, schemes, plus signs, digits and identifier cues in one pass over a
text; each anchor is then expanded by a deterministic parser. No anchor, no further work: the cost
of a clean text is one automaton scan.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column

KINDS = ("email", "ip", "card", "phone")
ADDED = ("login_url", "iban", "account")
ORDER = {k: i for i, k in enumerate(KINDS + ADDED)}
CUES = ("account", "acct", "iban", "passport", "ssn")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"://[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+")
_AFTER_CUE = re.compile(r"(?: ?(?:number|no\.?|id|#))?(?: ?[:=#]| is)? {0,2}([A-Z]{0,4}[0-9](?:[ -]?[0-9A-Z]){5,33})(?![0-9A-Za-z])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")


@functools.lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    a.add_word("://", (":", 3))
    for d in "0123456789":
        a.add_word(d, ("0", 1))
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def find(text: str | None) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in code points, by start and then kind. Null counts as empty.

    Base kinds equal the leftmost non-overlapping matches of their patterns, each kind by itself,
    failing matches dropped with what they consumed. Added kinds never replace base ones.
    """
    if not text:
        return []
    spans: list[tuple[int, int, str]] = []
    mail_end = quad_end = chain_end = phone_end = 0
    for last, (what, size) in _automaton().iter(text):
        at = last - size + 1
        if what == "0":
            if at >= chain_end and (m := _CHAIN.match(text, at)):
                chain_end = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append((at, chain_end, "card"))
            if at >= quad_end and (at == quad_end or text[at - 1] not in DIGITS) and (m := _QUAD.match(text, at)):
                quad_end = m.end()
                if all(map(_octet, m.group().split("."))):
                    spans.append((at, quad_end, "ip"))
        elif what == "@":
            if at >= mail_end and (m := _DOMAIN.match(text, at)):
                start = at
                while start > mail_end and text[start - 1] in LOCAL:
                    start -= 1
                if start < at:
                    mail_end = m.end()
                    spans.append((start, mail_end, "email"))
        elif what == "+":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 10 <= sum(c in DIGITS for c in m.group()) <= 15:
                    spans.append((at, phone_end, "phone"))
        elif what == ":":
            if m := _LOGIN.match(text, at):
                start = at
                while start and text[start - 1].isascii() and text[start - 1].isalpha():
                    start -= 1
                if start < at:
                    spans.append((start, m.end(), "login_url"))
        else:
            before, m = text[at - 1 : at], _AFTER_CUE.match(text, last + 1)
            if m and not (before.isalnum() or before == "_"):
                code = m.group(1)
                joined = code.replace(" ", "").replace("-", "")
                if _IBAN.fullmatch(code) and mod97(joined):
                    spans.append((m.start(1), m.end(1), "iban"))
                elif sum(c in DIGITS for c in code) >= 6 and len(joined) <= 20:
                    spans.append((m.start(1), m.end(1), "account"))
    return sorted(set(spans), key=lambda s: (s[0], ORDER[s[2]], s[1]))


def render(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and `spans`, an array of (start, end, kind) structs.

    Rows are independent: no shuffle, repeated rows and null ids pass through, null and empty
    texts give an empty array, other columns are left out and so cannot clash.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"start": a, "end": e, "kind": k} for a, e, k in find(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, shape)], names=[id_col, "spans"])

    return docs.select(column(id_col), column(text_col)).mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<start:bigint,end:bigint,kind:string>>")


def digests(found: DataFrame) -> DataFrame:
    """The query's columns from detect(): counts and base digest of the base kinds, all spans as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[(s["start"], s["end"], s["kind"]) for s in r or ()] for r in b.column(1).to_pylist()]
            base = [[s for s in r if s[2] in KINDS] for r in rows]
            counts = [pa.array([sum(s[2] == k for s in r) for r in base], pa.int64()) for k in KINDS]
            shas = [hashlib.sha256(render(r).encode()).hexdigest() for r in base]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(shas, pa.string()), pa.array(map(render, rows), pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "spans").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
