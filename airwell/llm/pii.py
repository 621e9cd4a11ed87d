"""Personal data: patterns propose spans, validators confirm, context scores.

Patterns propose spans per kind, leftmost and non-overlapping in a kind.
Validators confirm them: parts of an ip up to 255, Luhn for cards, digit counts
for phones, mod 97 for bank account numbers.  An account number has the length of
its country, whatever tokens stand around it; where none of that length holds,
the token ends of the run are tried from the last (of a known country, the last
only).  A context word of the kind within ``CONTEXT`` characters raises a
span's score.  Kinds of ``BASE`` are kept whenever they are confirmed; ``iban`` is kept on its checksum, ``ssn`` (a
national number without a checksum) only with a context word.

All matchers take time in proportion to the text: runs are entered at their
start only.

Defined edge results: a null or empty text has no spans; spans of different
kinds may overlap and are ordered by start, then kind; redaction joins
overlapping spans and names the first; repeated rows agree; other columns are
ignored (redaction keeps them).
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airwell.llm._common import map_arrow, values_of

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
CONTEXT = 40
RAISE = 0.3
NEEDED = 0.5
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
# Context words per kind.
WORDS = {
    "email": ["email", "e-mail", "mail", "contact", "write", "courriel", "correo"],
    "ip": ["ip", "address", "host", "server", "login", "adresse", "dirección"],
    "card": ["card", "visa", "mastercard", "credit", "payment", "karte", "carte", "tarjeta"],
    "phone": ["phone", "call", "tel", "mobile", "fax", "whatsapp", "telefon", "téléphone", "teléfono"],
    "iban": ["iban", "account", "bank", "konto", "compte", "cuenta"],
    "ssn": ["ssn", "social security", "social-security", "tax id"],
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
# Characters of an account number per country.
_IBAN_CHARS = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 "
    "FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 "
    "LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 "
    "SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30").split()}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile("[0-9]")
_NEAR = {k: re.compile("|".join(re.escape(w) for w in ws)) for k, ws in WORDS.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    """Per at-sign: the run of name characters before it, if a domain follows."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _valid_ip(s: str) -> bool:
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in s.split(".")))


def _valid_card(s: str) -> bool:
    d = _only_digits(s)
    return 12 <= len(d) <= 19 and luhn(d)


def _valid_phone(s: str) -> bool:
    return 9 <= len(_only_digits(s)) <= 15


def _ibans(text: str):
    """Numbers of their country's length first; then other runs, in what those leave free."""
    held, others, free = [], [], 0
    m = _IBAN.search(text)
    while m:
        start, ends, chars = m.start(), {}, 0
        for i in range(start, m.end()):
            chars += text[i] != " "
            after = text[i + 1:i + 2]
            if chars >= 15 and not (after.isascii() and after.isalnum()):
                ends.setdefault(chars, i + 1)
        right = [ends[n] for n in sorted(ends, reverse=True) if mod97(text[start:ends[n]].replace(" ", ""))]
        known = _IBAN_CHARS.get(text[start:start + 2])
        if start >= free and ends.get(known) in right:
            free = ends[known]
            held.append((start, free))
        elif right:
            others.append((start, [e for e in right if known is None or e == max(ends.values())]))
        m = _IBAN.search(text, start + 1)
    taken = iter([*held, (len(text), len(text))])
    low, high = next(taken)
    free = 0
    for start, right in others:
        while high <= start and low < len(text):
            low, high = next(taken)
        end = next((e for e in right if e <= low), None)
        if start >= free and end:
            held.append((start, end))
            free = end
    return sorted(held)


def _score(kind: str, text: str, start: int, end: int) -> float:
    around = (text[max(0, start - CONTEXT):start] + " " + text[end:end + CONTEXT]).lower()
    return PRIOR[kind] + (RAISE if _NEAR[kind].search(around) else 0.0)


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of a text, by start, then kind."""
    if not text:
        return []
    out = []
    if "@" in text:
        out += [("email", *s) for s in _emails(text)]
    if _DIGIT.search(text):
        for kind, pattern, valid, needs in (
                ("ip", _IP, _valid_ip, "."), ("card", _CARD, _valid_card, None), ("phone", _PHONE, _valid_phone, "+"),
                ("ssn", _SSN, None, "-")):
            if needs is None or needs in text:
                out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid is None or valid(m.group())]
        out += [("iban", *s) for s in _ibans(text)]
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    scored = [(*s, _score(s[0], text, s[1], s[2])) for s in out]
    return [s for s in scored if s[0] in BASE or s[3] >= NEEDED]


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets."""
    spans = find_spans(text)
    if not spans:
        return text
    parts, last = [], 0
    for kind, start, end, _ in spans:
        if start >= last:
            parts += [text[last:start], f"<{kind.upper()}>"]
        last = max(last, end)
    return "".join([*parts, text[last:]])


_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                 ("score", pa.float64()), ("value", pa.string())]))


def _spans_of(batches):
    for batch in batches:
        rows = [[{"kind": k, "start": s, "end": e, "score": x, "value": t[s:e]} for k, s, e, x in find_spans(t)]
                for t in values_of(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPAN_TYPE)], names=["doc_id", "spans"])


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans) per row: an array of kind, start, end (code points, end exclusive), score and value."""
    t = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type = t.schema["doc_id"].dataType.simpleString()
    return map_arrow(t, _spans_of, f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,`end`:bigint,"
                                   "score:double,value:string>>")


def span_list(column: str, kinds=KINDS) -> Column:
    """kind:start:end of the listed kinds, comma-joined."""
    chosen = F.filter(column, lambda s: s["kind"].isin(list(kinds)))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _redactor(column: int):
    def run(batches):
        for batch in batches:
            texts = pa.array([redact(t) for t in values_of(batch.column(column))], batch.column(column).type)
            yield batch.set_column(column, batch.schema.field(column), texts)
    return run


def redact_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the spans in ``text`` masked; all other columns stay as they are."""
    return map_arrow(docs, _redactor(docs.columns.index(text)), docs.schema)
