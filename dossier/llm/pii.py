"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, scheme marks, digit pairs and identifier cues.
Each anchor starts a deterministic local parser, which expands to both sides, validates, and remembers how far it has
read, so that every character is read a bounded number of times however the text is built.

Base kinds equal a leftmost, non-overlapping search per kind: `email`, `ip` (parts at most 255), `card` (12 to 19
digits, Luhn) and `phone` (9 to 15 digits). The method adds `account` (a value behind a cue such as `password=`, a
valid IBAN behind `IBAN`, a number behind `SSN`) and `url` (only with user and password in it).

Null and empty texts have no spans. Repeated rows give repeated rows. Only `doc_id` and `text` are read; other columns
may have any names.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from dossier.llm.common import map_rows, table

# Kinds in the order of the contract, then the added ones.
KINDS = ("email", "ip", "card", "phone", "account", "url")
BASE = KINDS[:4]
SECRET_CUES = ("password", "passwd", "pwd", "secret", "api_key", "apikey", "access_token")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_URL_REST = re.compile(r"[^\s<>\"'`]*")
_LOGIN = re.compile(r"[^/?#@:]+:[^/?#@]+@.")
_SECRET = re.compile(r"[ \t]{0,2}[=:][ \t]{0,2}([^\s,;\"'<>]{4,})")
_IBAN = re.compile(r"[ :#=]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Z0-9])")
_SSN = re.compile(r"[ :#=]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban_end(text: str, start: int, end: int) -> int | None:
    """Where a valid number of 15 to 34 signs that begins at `start` ends: the longest that ends with a group of signs."""
    while end > start:
        s = text[start:end].replace(" ", "")
        if 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1:
            return end
        end = text.rfind(" ", start, end)
    return None


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    digits = "0123456789"
    a.add_word("@", ("email", 1))
    a.add_word("+", ("phone", 1))
    a.add_word("://", ("url", 3))
    for x in digits:
        a.add_word(f"{x}.", ("ip", 2))
        for sep in ("", " ", "-"):
            for y in digits:
                a.add_word(f"{x}{sep}{y}", ("card", 2 + len(sep)))
    for kind, cues in (("secret", SECRET_CUES), ("iban", ("iban",)), ("ssn", ("ssn",))):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


class Finder:
    """spans(text): list of (start, rank of the kind, end), sorted."""

    def __init__(self) -> None:
        self.anchors = _automaton()

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        if not text:
            return []
        found: list[tuple[int, int, int]] = []
        email_end = ip_end = card_end = url_end = account_end = 0
        for last, (kind, width) in self.anchors.iter(text):
            first = last - width + 1
            if kind == "card":
                if first >= card_end:
                    card_end = _CARD.match(text, first).end()
                    digits = text[first:card_end].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        found.append((first, 2, card_end))
            elif kind == "ip":
                if last >= ip_end:
                    start = first
                    while start > ip_end and "0" <= text[start - 1] <= "9":
                        start -= 1
                    chain = _CHAIN.match(text, start)
                    ip_end, at, parts = chain.end(), start, chain.group().split(".")
                    for i in range(0, len(parts) - 3, 4):
                        end = at + sum(map(len, parts[i : i + 4])) + 3
                        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts[i : i + 4]):
                            found.append((at, 1, end))
                        at = end + 1
            elif kind == "email":
                start = first
                while start > email_end and text[start - 1] in _LOCAL:
                    start -= 1
                if start < first and (domain := _DOMAIN.match(text, last + 1)):
                    email_end = domain.end()
                    found.append((start, 0, email_end))
            elif kind == "phone":
                if number := _PHONE.match(text, first):
                    if 9 <= sum(c.isdigit() for c in number.group()) <= 15:
                        found.append((first, 3, number.end()))
            elif kind == "url":
                if first >= url_end:
                    rest = _URL_REST.match(text, last + 1)
                    start, url_from, url_end = first, url_end, rest.end()
                    while start > url_from and text[start - 1] in _SCHEME:
                        start -= 1
                    if start < first and _LOGIN.match(text, last + 1, url_end):
                        found.append((start, 5, url_end))
            elif first >= account_end:
                parser = _SECRET if kind == "secret" else _IBAN if kind == "iban" else _SSN
                if value := parser.match(text, last + 1):
                    start, end = value.span(1)
                    end = iban_end(text, start, end) if kind == "iban" else end
                    if end is not None:
                        account_end = end
                        found.append((start, 4, end))
        found.sort()
        return found


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    if not spans:
        return text
    parts, done = [], 0
    for s, k, e in spans:
        if s >= done:
            parts += [text[done:s], f"[{KINDS[k].upper()}]"]
        done = max(done, e)
    return "".join(parts) + text[done:]


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of the base kinds, base_sha256, spans, n_added."""

    def make():
        finder = Finder()

        def step(given):
            all_spans = [finder.spans(t) for t in given["text"]]
            out = {"doc_id": given["doc_id"], "spans": [digest(x) for x in all_spans]}
            for k, kind in enumerate(BASE):
                out[f"n_{kind}"] = [sum(s[1] == k for s in x) for x in all_spans]
            out["n_added"] = [sum(s[1] >= len(BASE) for s in x) for x in all_spans]
            out["base_sha256"] = [
                hashlib.sha256(digest([s for s in x if s[1] < len(BASE)]).encode()).hexdigest() for x in all_spans
            ]
            yield out

        return step

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"
    return map_rows(docs.select("doc_id", "text"), schema, make)


def redact_pii(docs: DataFrame) -> DataFrame:
    """Documents with redacted texts; `n_chars` follows the new text. Other columns and all rows stay."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def clean(texts):
        finder = Finder()
        return texts.map(lambda t: None if t is None else redact(t, finder.spans(t)))

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
