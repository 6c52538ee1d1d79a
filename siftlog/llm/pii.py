"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton finds the anchors of a text: at-signs, schemes and identifier cues. At each
anchor a small parser expands to the left or right and validates the boundary: email addresses around an at-sign, web
addresses from a scheme, account numbers (IBAN, account, social security), passwords, tokens and access keys after a
cue. Numbers have no anchor of their own; four patterns that scan in linear time find IP addresses, cards and phones.

Kinds in order: email, ip, card, phone (the base kinds), then url, iban, account, ssn, secret. Spans are
``(kind, start, end)`` in code points, end exclusive; spans of one kind don't overlap.

Edge cases: null and empty texts have no spans (masking leaves null as null); very long texts are scanned whole, in
linear time; ties can't arise, since matches are leftmost; repeated rows are treated alike; other columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlog.llm.common import bounded_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account", "ssn", "secret")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried at its start only, and never given back, so long runs cost no more than short ones.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"[A-Za-z0-9.-]+(?::[0-9]{1,5})?(?:[/?#][^\s<>\"'{}|\\^`]*)?")
SCHEME = re.compile(r"(?:https?|ftps?|sftp|wss?)$", re.IGNORECASE)

#: What may stand between a cue and its value.
BETWEEN = re.compile(r"(?:\s?(?:number|no\.?|nr\.?|num|id|is|#))?[\s]{0,2}[:=#]?[\s]{0,2}[\"']?", re.IGNORECASE)
IBAN_VALUE = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
ACCOUNT_VALUE = re.compile(r"[0-9](?:[ -]?[0-9]){5,16}(?![0-9])")
SSN_VALUE = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9])")
SECRET_VALUE = re.compile(r"[A-Za-z0-9_+/=.-]{8,}")
ACCESS_KEY = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")

#: Cues, each with what it announces.
CUES = {
    "iban": "iban",
    "account": "account",
    "acct": "account",
    "konto": "account",
    "compte": "account",
    "cuenta": "account",
    "ssn": "ssn",
    "social security": "ssn",
    "password": "secret",
    "passwd": "secret",
    "token": "secret",
    "secret": "secret",
    "api_key": "secret",
    "apikey": "secret",
}

_automaton = None


def automaton():
    """The automaton of all anchors, made once in each worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for word, kind in {"@": "at", "://": "scheme", "www.": "www", "AKIA": "key", "ASIA": "key"}.items():
            a.add_word(word, (kind, len(word)))
        for cue, kind in CUES.items():
            for word in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                a.add_word(word, (kind, len(word)))
        a.make_automaton()
        _automaton = a
    return _automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _iban(value: str) -> bool:
    compact = value.replace(" ", "")
    turned = compact[4:] + compact[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text, by kind and then start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    ends = dict.fromkeys(KINDS, 0)

    def add(kind: str, start: int, end: int) -> None:
        if start >= ends[kind]:
            found[kind].append((start, end))
            ends[kind] = end

    for last, (kind, n) in automaton().iter(text):
        start, after = last + 1 - n, last + 1
        if kind == "at":
            left, least = start, ends["email"]
            while left > least and text[left - 1] in LOCAL:
                left -= 1
            if left < start and (m := DOMAIN.match(text, after)):
                add("email", left, m.end())
        elif kind in ("scheme", "www"):
            left = start
            if kind == "scheme":
                m = SCHEME.search(text[max(0, start - 6) : start])
                left = start - len(m.group()) if m else -1
            elif start and text[start - 1].isalnum():
                left = -1
            if left >= ends["url"] and (m := URL.match(text, after)):
                value = m.group().rstrip(".,;:!?)")
                if "." in re.split(r"[/?#:]", value, maxsplit=1)[0].strip(".-"):
                    add("url", left, after + len(value))
        elif kind == "key":
            if (not start or not text[start - 1].isalnum()) and (m := ACCESS_KEY.match(text, start)):
                add("secret", start, m.end())
        else:
            if start and text[start - 1].isalnum():
                continue
            at = BETWEEN.match(text, after).end()
            if at == after:
                continue
            if kind in ("iban", "account") and (m := IBAN_VALUE.match(text, at)):
                # The longest whole number of groups whose check digits agree.
                value = m.group()
                while len(value) >= 15 and not _iban(value):
                    value = value[:-1].rstrip()
                if len(value) >= 15:
                    add("iban", at, at + len(value))
            elif kind == "account" and (m := ACCOUNT_VALUE.match(text, at)):
                add("account", at, m.end())
            elif kind == "ssn" and (m := SSN_VALUE.match(text, at)):
                add("ssn", at, m.end())
            elif kind == "secret" and (m := SECRET_VALUE.match(text, at)):
                value = m.group().rstrip(".")
                if any(c.isdigit() for c in value) and len(value) >= 8:
                    add("secret", at, at + len(value))
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) < 4 and int(p or "0") < 256 for x in m.group().split(".")):
            add("ip", m.start(), m.end())
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            add("card", m.start(), m.end())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                add("phone", m.start(), m.end())
    return [(k, a, b) for k in KINDS for a, b in found[k]]


def _joined(rows: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in rows)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, their digest and all spans."""
    bounded_batches(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums, every = {k: [] for k in BASE}, [], []
            for text in batch.column(1).to_pylist():
                rows = spans(text)
                base = [r for r in rows if r[0] in BASE]
                for k in BASE:
                    counts[k].append(sum(r[0] == k for r in base))
                sums.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                every.append(_joined(rows))
            columns = [batch.column(0), *[pa.array(counts[k], pa.int64()) for k in BASE], pa.array(sums, pa.string()), pa.array(every, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(find, schema)


def masked(text: str) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans(text), key=lambda r: (r[1], -r[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with the personal data of ``text`` masked and, where there is one, ``n_chars`` renewed."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def hide(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else masked(t))

    out = docs.withColumn("text", hide("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
