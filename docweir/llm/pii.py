"""Personal data: expressions propose spans, checksums confirm them, context words move the score.

Kinds of the base, always reported: email, ip, card (Luhn), phone. Further kinds: iban (its country's length, mod 97),
national_id (Belgian register numbers of 11 digits and French ones of 15, whose last two are 97 less the rest mod 97;
United States numbers of three, two and four digits) and secret (a value, however long, after a word such as password).
A further span is reported from a score of THRESHOLD on: the kind's own score, plus NEAR if one of its context words
stands, as a word of its own, within WINDOW characters, minus NEAR if a word of ordinary numbering does. The word that
introduces a secret is part of its kind and no context.

All scanners are linear in the text: they anchor at a character that the kind can't do without, and quantifiers are
possessive, so that very long runs of letters or digits cost no more than other text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweir.llm.common import batch, id_text, ready, slices

BASE = ("email", "ip", "card", "phone")
FURTHER = ("iban", "national_id", "secret")
THRESHOLD = 0.5
WINDOW = 40

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z.-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{15}|[0-9]{11})(?![0-9A-Za-z-])")
_SECRET = re.compile(r"(?i)(?<![a-z])(?:password|passwd|secret|api[_-]?key|token)\x20?[=:]\x20?([!-~]{8,}+)")
_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# The length of an IBAN by country.
_IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_IBAN_REST = {n: re.compile(r"(?:\x20?[A-Z0-9]){%d}(?![A-Za-z0-9])" % (n - 4)) for n in set(_IBAN_LENGTH.values())}


def _words(*own: str) -> re.Pattern:
    return re.compile(rf"(?i)(?<![a-z])(?:{'|'.join(own)})s?(?![a-z])")


_CONTEXT = {
    "iban": _words("iban", "account", "bank", "konto", "compte", "cuenta"),
    "national_id": _words("ssn", "social", "national", "identity", "passport", "tax", "steuer", "ausweis"),
    "secret": _words("login", "user", "credential", "password", "secret", "key", "token"),
}
_AGAINST = _words("order", "invoice", "page", "version", "isbn", "serial")
_OWN = {"iban": 0.6, "national_id": 0.3, "secret": 0.6}
NEAR = 0.3

_DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[::-1][::2])) + sum(_DOUBLED[int(d)] for d in digits[::-1][1::2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    n = 0
    for ch in s[4:] + s[:4]:
        n = int(f"{n}{int(ch, 36)}") % 97
    return n == 1


def emails(text: str) -> list[tuple[int, int]]:
    out, after, at = [], 0, text.find("@")
    while at >= 0:
        first = at
        while first > after and text[first - 1] in _LOCAL:
            first -= 1
        if first < at and (m := _DOMAIN.match(text, at)):
            out.append((first, m.end()))
            after = m.end()
        else:
            # What stands before this sign can't begin a later match: that sign would have to be crossed.
            after = at + 1
        at = text.find("@", max(after, at + 1))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups())]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(map(m[0].count, "0123456789")) <= 15] if "+" in text else []


def _score(text: str, kind: str, i: int, j: int) -> float:
    around = text[max(0, i - WINDOW) : i] + " " + text[j : j + WINDOW]
    return round(_OWN[kind] + NEAR * bool(_CONTEXT[kind].search(around)) - NEAR * bool(_AGAINST.search(around)), 3)


def ibans(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _IBAN.finditer(text):
        n = _IBAN_LENGTH.get(m[0][:2])
        if n and (rest := _IBAN_REST[n].match(text, m.end())) and mod97(m[0] + rest[0]):
            out.append((m.start(), rest.end()))
    return out


def nationals(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _NATIONAL.finditer(text):
        d = m[0]
        if "-" in d:
            ok = d[:3] not in ("000", "666") and d[0] != "9" and d[4:6] != "00" and d[7:] != "0000"
        elif len(d) == 11:
            # From 2000 on a two stands before the year.
            ok = int(d[9:]) in (97 - int(d[:9]) % 97, 97 - int("2" + d[:9]) % 97) and d[2:4] <= "12" and d[4:6] <= "31"
        else:
            ok = d[0] in "12" and int(d[13:]) == 97 - int(d[:13]) % 97
        if ok:
            out.append(m.span())
    return out


def further(text: str) -> list[tuple[str, int, int, float]]:
    """Spans with their scores; the window of a secret begins before the word that introduces it."""
    found = []
    if _DIGIT.search(text):
        found += [("iban", i, j, i) for i, j in ibans(text)] + [("national_id", i, j, i) for i, j in nationals(text)]
    if "=" in text or ":" in text:
        found += [("secret", *m.span(1), m.start()) for m in _SECRET.finditer(text)]
    scored = [(k, i, j, _score(text, k, first, j)) for k, i, j, first in found]
    return [s for s in scored if s[3] >= THRESHOLD]


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, base kinds first, then by start; a base span scores 1."""
    scan = (emails, ips, cards, phones) if _DIGIT.search(text) else (emails,)
    base = [(k, i, j, 1.0) for k, f in zip(BASE, scan, strict=False) for i, j in f(text)]
    return base + further(text)


SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans, redacted): one row for each input row; redacted has <kind> in place of each span.

    Null text counts as empty and has no spans; repeated rows and ids are scanned each on its own; overlapping spans
    of different kinds are all reported, and redacted as one under the first one's kind.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        schema = pa.schema([("doc_id", pa.int64()), ("spans", kind), ("redacted", pa.string())])
        for b in slices(batches):
            spans, clean = [], []
            for text in b.column(1).to_pylist():
                found = find_spans(text)
                spans.append([{"kind": k, "start": i, "end": j, "score": s} for k, i, j, s in found])
                clean.append(redact(text, found))
            yield batch(schema, b.column(0), spans, clean)

    return id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, f"doc_id bigint, spans {SPANS}, redacted string")


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    out, at, last = [], 0, 0
    for k, i, j, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if i < last:
            if j > last:
                at = last = j
            continue
        out += [text[at:i], f"<{k}>"]
        at = last = j
    return "".join([*out, text[at:]])


def span_digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text."""
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.transform(base, said), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", said), ",").alias("spans"),
    )

