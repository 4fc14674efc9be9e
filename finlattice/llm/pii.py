"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

Base kinds are email, ip, card and phone; every valid base span stays whatever its score. The method adds iban (mod 97)
and ssn spans, kept from ADDED_SCORE up. Defined cases: null and empty texts have no spans; extra columns are ignored;
repeated rows give repeated rows. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
ADDED_SCORE = 0.6
#: Code points on either side in which a context word counts.
CONTEXT = 48
# A match can only begin where a run begins, so look-behinds and possessive repeats keep long runs linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
_WORDS = {
    "email": re.compile(r"\b(e-?mail|contact|correo|courriel)\b", re.I),
    "ip": re.compile(r"\b(ip|address|host|server|login)\b", re.I),
    "card": re.compile(r"\b(card|visa|mastercard|credit|karte|tarjeta|carte)\b", re.I),
    "phone": re.compile(r"\b(phone|tel|call|mobile|fax|telefon)\b", re.I),
    "iban": re.compile(r"\b(iban|bank|account|konto|cuenta|compte)\b", re.I),
    "ssn": re.compile(r"\b(ssn|social security)\b", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    last = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        if start < m.start():
            yield start, m.end()
            last = m.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m.group()) if m.end() - m.start() >= 16 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def added_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("iban", m.start(), m.end()) for m in _IBAN.finditer(text) if 15 <= len(m.group().replace(" ", "")) <= 34 and mod97(m.group().replace(" ", ""))]
    return out + [("ssn", m.start(), m.end()) for m in _SSN.finditer(text)]


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
    return round(min(1.0, _PRIOR[kind] + 0.3 * bool(_WORDS[kind].search(near))), 3)


_SEED = re.compile(r"[0-9@]")


def spans_of(text: str) -> list[dict]:
    """All spans of a text, by kind as listed in KINDS and then by start."""
    if not _SEED.search(text):
        return []
    out = [{"kind": k, "start": s, "end": e, "score": score(text, k, s, e)} for k, s, e in base_spans(text)]
    extra = [{"kind": k, "start": s, "end": e, "score": score(text, k, s, e)} for k, s, e in added_spans(text)]
    out += [x for x in extra if x["score"] >= ADDED_SCORE]
    return sorted(out, key=lambda x: (KINDS.index(x["kind"]), x["start"]))


def find_pii(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, spans array<struct<kind,start,end,score>>: one row for each row of docs."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def one(batch: pa.RecordBatch):
        spans = [spans_of(t) if t else [] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return common.map_arrow(rows, one, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query, from the spans."""
    join = "array_join(transform({}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    base = "filter(spans, x -> x.kind in ('email', 'ip', 'card', 'phone'))"
    count = {f"n_{k}": F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)") for k in BASE}
    return found.select(
        "doc_id", *[c.alias(n) for n, c in count.items()], F.sha2(F.expr(join.format(base)), 256).alias("base_sha256"), F.expr(join.format("spans")).alias("spans"),
        F.expr("coalesce(array_max(transform(spans, x -> x.score)), 0D)").alias("top_score"),
    )
