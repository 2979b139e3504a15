"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
`://` and identifier cues (password, token, account, ...). At each anchor a
small deterministic parser expands to the left and right, validates, and keeps
or drops the span. Every parser only moves forward over its own alphabet, so
the time is linear in the text, whatever runs of letters or digits it holds.

Kinds, in the order used when two spans start together: email, ip, card,
phone (the base kinds), then url (an address with a user and password in it)
and account (a secret or account number after a cue).

A span is (kind, start, end) in code points, end exclusive. Null and empty
texts have none, an empty table gives no row. Of spans of one kind that could
overlap the leftmost stands. Rows that repeat are scanned each on its own;
further columns of the input are not touched, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.llm.common import ddl, small, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
ORDER = {k: i for i, k in enumerate(KINDS)}
CUES = ("password", "passwd", "secret", "token", "api_key", "apikey", "access key", "account", "acct", "iban", "passport")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS_AND_SEPARATORS = re.compile(r"[0-9](?:[ -]?[0-9])*")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
AUTHORITY = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+@[A-Za-z0-9.-]+")
VALUE = re.compile(r"""(?:[ ]?(?:number|no\.?|id))?[ ]?[:=#][ ]?["']?([A-Za-z0-9][A-Za-z0-9_-]{7,})""")
KEY_ID = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")

_automaton = None


def anchors():
    """The automaton, built once in each Python worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for c in "0123456789":
            _automaton.add_word(c, ("digit", 1))
        for word, kind in (("@", "email"), ("+", "phone"), ("://", "url"), ("AKIA", "key")):
            _automaton.add_word(word, (kind, len(word)))
        for cue in CUES:
            for form in {cue, cue.capitalize(), cue.title(), cue.upper()}:
                _automaton.add_word(form, ("account", len(form)))
        _automaton.make_automaton()
    return _automaton


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, by start and then kind."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    email_end = card_end = ip_end = phone_end = url_end = account_end = 0
    for last, (kind, length) in anchors().iter(text):
        at = last - length + 1
        if kind == "digit":
            if at >= card_end:
                run = DIGITS_AND_SEPARATORS.match(text, at)
                card_end = run.end()
                digits = run.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", at, card_end))
            if at >= ip_end:
                run = DOTTED.match(text, at)
                ip_end, begin = run.end(), at
                parts = run.group().split(".")
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k : k + 4]
                    end = begin + sum(map(len, four)) + 3
                    if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in four):
                        found.append(("ip", begin, end))
                    begin = end + 1
        elif kind == "email":
            begin = at
            while begin > email_end and text[begin - 1] in LOCAL:
                begin -= 1
            if begin < at and (domain := DOMAIN.match(text, at + 1)):
                email_end = domain.end()
                found.append(("email", begin, email_end))
        elif kind == "phone":
            if at >= phone_end and (run := PHONE.match(text, at)):
                phone_end = run.end()
                if 10 <= sum(c.isdigit() for c in run.group()) <= 15:
                    found.append(("phone", at, phone_end))
        elif kind == "url":
            begin = at
            while begin > url_end and (text[begin - 1].isascii() and text[begin - 1].isalnum() or text[begin - 1] in "+.-"):
                begin -= 1
            if begin < at and (rest := AUTHORITY.match(text, last + 1)):
                url_end = rest.end()
                found.append(("url", begin, url_end))
        elif kind == "key":
            if at >= account_end and not (at and text[at - 1].isalnum()) and (run := KEY_ID.match(text, at)):
                account_end = run.end()
                found.append(("account", at, account_end))
        elif at >= account_end and not (at and text[at - 1].isalnum()) and (run := VALUE.match(text, last + 1)):
            if any(c.isdigit() for c in run[1]):
                account_end = run.end(1)
                found.append(("account", run.start(1), account_end))
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]]))


def shown(some: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in some)


def redact(text: str | None) -> str | None:
    """The text with each span replaced by <KIND>; of overlapping spans the outermost text goes."""
    if not text:
        return text
    out, at = [], 0
    for kind, begin, end in spans(text):
        if begin >= at:
            out += [text[at:begin], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


SPANS = "array<struct<kind:string,start:long,end:long>>"


def find(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with one more column: its spans as an array of (kind, start, end).

    A column that already has that name is replaced.
    """
    kept = [c for c in docs.columns if c != out]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    where = kept.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in small(batches):
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] for t in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, item)], names=[*kept, out])

    return docs.mapInArrow(each, f"{ddl(docs)}, `{out}` {SPANS}" if kept else f"`{out}` {SPANS}")


def digest(docs: DataFrame) -> DataFrame:
    """One row a document: counts of the base kinds, the digest of the base spans, and all spans."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [spans(t) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in f) for f in found], pa.int64()) for k in BASE]
            sha = [hashlib.sha256(shown([s for s in f if s[0] in BASE]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(sha, pa.string()), pa.array(list(map(shown, found)), pa.string())],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        each, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def redacted(docs: DataFrame) -> DataFrame:
    """The documents, with personal data masked in text and n_chars set to the new length."""

    names = docs.columns
    where = names.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            columns = list(batch.columns)
            columns[where] = pa.array(list(map(redact, columns[where].to_pylist())), pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.mapInArrow(each, ddl(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


QUERIES = {"op10_pii": op10_pii}
ORACLE_SQL: dict[str, str] = {}
