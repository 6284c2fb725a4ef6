"""Personal data: expressions propose spans, checksums confirm them, context words adjust scores."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import table
from granary.llm.spans import count_of, joined, scan_documents

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "ssn"]
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# An address can't begin inside a run of digits: if it failed at the run's start, it fails there too.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){12,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
#: Words that, near a span, make its kind likelier.
CONTEXT = {
    "email": ("mail", "contact", "write", "address", "send"),
    "ip": ("ip", "server", "host", "address", "login", "network"),
    "card": ("card", "visa", "credit", "debit", "payment", "amex", "mastercard"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "contact"),
    "iban": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
#: Scores of a confirmed span without such words, and what one of them adds.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
NEAR, BONUS = 40, 0.3
_WORDS = {k: re.compile("|".join(rf"\b{w}" for w in ws), re.I | re.A) for k, ws in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    """From each @ outwards, which takes time in proportion to the text."""
    out, at, floor = [], text.find("@"), 0
    while at >= 0:
        a = at
        while a > floor and _LOCAL.match(text, a - 1):
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    return out


def scan(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of the personal data of a text, by kind, then start."""
    found = [("email", a, b) for a, b in _emails(text)]
    if re.search("[0-9]", text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        found += [("iban", m.start(), m.end()) for m in _IBAN.finditer(text) if mod97(m[0].replace(" ", ""))]
        found += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text)]
    out = []
    for kind, a, b in found:
        near = text[max(0, a - NEAR) : a] + "\n" + text[b : b + NEAR]
        score = min(1.0, PRIOR[kind] + BONUS * bool(_WORDS[kind].search(near)))
        if score >= 0.5:
            out.append((kind, a, b, score))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): personal data of every whole text, with scores.

    A null text counts as empty and has no spans; null doc_ids and repeated rows are returned as
    they come; an empty table gives an empty result; further columns are ignored.
    """
    return scan_documents(docs, scan)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[count_of(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(BASE), 256).alias("base_sha256"), joined().alias("spans"), count_of("iban").alias("n_iban"), count_of("ssn").alias("n_ssn"))


QUERIES = {"op6_pii": op6_pii}
ORACLE: dict[str, str] = {}
