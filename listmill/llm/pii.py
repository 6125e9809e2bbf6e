"""Personal data: regular expressions propose spans, checks confirm them, words nearby move the score."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base kinds in the order of the contract, then the kinds this operator adds.
BASE_KINDS = ["email", "ip", "card", "phone"]
ADDED_KINDS = ["iban", "ssn", "local_phone", "spelled_email", "ipv6"]
KINDS = BASE_KINDS + ADDED_KINDS
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22,
    "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15,
    "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
CONTEXT = {
    "email": "mail email e-mail contact courriel correo", "ip": "ip address host server login adresse", "ipv6": "ip address host server login adresse",
    "card": "card visa mastercard amex credit debit carte karte tarjeta payment", "phone": "phone tel call mobile fax cell téléphone telefon teléfono",
    "local_phone": "phone tel call mobile fax cell téléphone telefon teléfono whatsapp", "iban": "iban account bank konto compte cuenta transfer",
    "ssn": "ssn social security", "spelled_email": "mail email e-mail contact courriel correo reach",
}
NEAR = 40
# score of a confirmed span without and with a context word nearby; spans under KEEP are not reported
SCORES = {
    "email": (0.9, 0.95), "ip": (0.7, 0.9), "card": (0.8, 0.98), "phone": (0.8, 0.95), "iban": (0.9, 0.99), "ssn": (0.3, 0.8), "local_phone": (0.3, 0.7),
    "spelled_email": (0.6, 0.8), "ipv6": (0.7, 0.9),
}
KEEP = 0.5

# The patterns of the contract. Emails are found from their @ sign outwards and addresses only at the start of a run of
# digits: the same matches, without trying every place of a long run.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![\w.-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w-])")
_LOCAL_PHONE = re.compile(r"(?<![\w+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3}[ .-]?[0-9]{2}[ .-]?[0-9]{2,3}(?![\w-])")
_SPELLED = re.compile(r"(?<![\w.])[A-Za-z0-9][\w.+-]{0,40} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,60}(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z]{2,20}){1,3}")
_IPV6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")


@dataclass(frozen=True, order=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    out, end = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            end = m.end()
    return out


def digits_of(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Confirmed matches of the contract's patterns, by kind and start."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def ibans(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _IBAN.finditer(text):
        size, plain, k = IBAN_LENGTHS.get(m[0][:2], 0), "", 0
        for k, c in enumerate(m[0], 1):
            plain += c.strip()
            if len(plain) == size:
                break
        follows = text[m.start() + k : m.start() + k + 1]
        if len(plain) == size and not (follows.isascii() and follows.isalnum()) and mod97(plain):
            out.append((m.start(), m.start() + k))
    return out


def has_context(text: str, kind: str, start: int, end: int) -> bool:
    around = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", (text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower())
    return not set(CONTEXT[kind].split()).isdisjoint(around)


def find(text: str | None) -> list[Span]:
    """All spans of a whole text (code points, end exclusive), by kind and start; none in a null or empty text.

    Base spans always stay, with their score. Added kinds must pass their check (mod 97 and the country's length for
    IBANs) and reach KEEP after context, and are dropped where they touch a base span.
    """
    if not text:
        return []
    base = base_spans(text)
    taken = [(s, e) for _, s, e in base]
    more: list[tuple[str, int, int]] = [("iban", *s) for s in ibans(text)]
    more += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    more += [("local_phone", *m.span()) for m in _LOCAL_PHONE.finditer(text) if 7 <= len(digits_of(m[0])) <= 11]
    if "at" in text:
        more += [("spelled_email", *m.span()) for m in _SPELLED.finditer(text)] if "[at]" in text or "(at)" in text else []
    more += [("ipv6", *m.span()) for m in _IPV6.finditer(text)] if ":" in text else []
    out = [Span(k, s, e, SCORES[k][has_context(text, k, s, e)]) for k, s, e in base]
    for k, s, e in more:
        score = SCORES[k][has_context(text, k, s, e)]
        if score >= KEEP and not any(s < te and ts < e for ts, te in taken):
            out.append(Span(k, s, e, score))
            taken.append((s, e))
    return sorted(out, key=lambda x: (KINDS.index(x.kind), x.start))


SPAN_TYPE = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``pii``, an array of (kind, start, end, score), for every row of ``docs``.

    Null and empty texts give an empty array; a null doc_id stays null; repeated rows are treated alike; other columns
    aren't read; no rows give no rows.
    """

    @F.pandas_udf(SPAN_TYPE)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score} for s in find(t)] for t in texts], dtype=object)

    return docs.select("doc_id", spans("text").alias("pii"))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
