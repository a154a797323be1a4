"""Personal data by anchors: one automaton finds at-signs, plus signs, digits and cue words in one pass over a text; a
local parser at each anchor finds the bounds of what stands there and validates it.

Every parser reads on from where its anchor is, or back to where the last match of its kind ended, so a text of any
length costs time in proportion.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans of one start are listed: the base ones, then those of the cues.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "account", "address", "secret", "login")
#: Cue words and what their parser looks for; each also with a capital first letter and in capitals.
CUES = {
    "account": ["account", "acct", "passport", "social security", "ssn", "tax id", "konto", "kontonummer", "cuenta", "compte"],
    "address": ["street", "avenue", "road", "lane", "drive", "boulevard", "straße", "strasse"],
    "secret": ["token", "password", "passwd", "passwort", "secret", "api key", "api_key", "apikey", "contraseña"],
    "login": ["://"],
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_RUN = re.compile(r"[0-9](?:[ -]?[0-9])*")
_DIALLED = re.compile(r"[ ().0-9-]+")
_IBAN = re.compile(r"[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:(?: number| no\.?| nr\.?| id)? ?[:#=]? ?| #)([0-9](?:[ -]?[0-9]){5,17})(?![0-9])", re.I)
_SECRET = re.compile(r"""s? {0,2}[:=] {0,2}["']?([A-Za-z0-9_./+=-]{8,})""")
_USER = re.compile(r"[A-Za-z0-9._%+-]+:[^\s/@:]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_HOUSE = re.compile(r"([0-9]{1,5}[A-Za-z]?)((?: [A-ZÀ-Þ][\w.'-]*){1,4} )\Z")
#: Characters before a street's name that are looked at for its number.
_BACK = 80


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48 << (k & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _mod97(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("@", 1))
    found.add_word("+", ("+", 1))
    for kind, words in CUES.items():
        for w in words:
            for form in {w, w[0].upper() + w[1:], w.upper()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


_automata: list = []


def spans_of(text: str | None) -> list[tuple[int, int, int]]:
    """Spans (start, number of the kind in ``KINDS``, end) of a text, in order; code points, end exclusive."""
    if not text:
        return []
    if not _automata:
        _automata.append(_automaton())
    out: list[tuple[int, int, int]] = []
    mail = digits = number = dialled = account = secret = login = 0  # where the last match, or what was read, ends
    for last, (kind, n) in _automata[0].iter(text):
        at = last - n + 1
        if kind == "digit":
            if at >= number:
                run = _RUN.match(text, at)
                number = run.end()
                if number - at >= 14:
                    plain = run[0].replace(" ", "").replace("-", "")
                    if 14 <= len(plain) <= 19 and luhn(plain):
                        out.append((at, 2, number))
            if at >= digits:
                ip = _IP.match(text, at)
                digits = ip.end() if ip else _DIGITS.match(text, at).end()
                if ip and all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in ip[0].split("."))):
                    out.append((at, 1, digits))
                if at > 1 and text[at - 2 : at].isascii() and text[at - 2 : at].isupper() and text[at - 2 : at].isalpha() and not text[at - 3 : at - 2].isalnum():
                    iban = _IBAN.match(text, at)
                    if iban and 15 <= len(code := text[at - 2 : iban.end()].replace(" ", "")) <= 34 and _mod97(code):
                        out.append((at - 2, 4, iban.end()))
        elif kind == "@":
            start = at
            while start > mail and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (domain := _DOMAIN.match(text, at + 1)):
                mail = domain.end()
                out.append((start, 0, mail))
        elif kind == "+":
            if at >= dialled and _DIGITS.match(text, at + 1, at + 2) and (run := _DIALLED.match(text, at + 2)):
                rest = run[0].rstrip(" ().-")
                if len(rest) >= 2:
                    dialled = at + 2 + len(rest)
                    if 10 <= 1 + sum(c.isdigit() for c in rest) <= 15:
                        out.append((at, 3, dialled))
        elif kind == "account":
            if at >= account and not text[at - 1 : at].isalnum() and (m := _ACCOUNT.match(text, last + 1)):
                account = m.end()
                out.append((m.start(1), 5, account))
        elif kind == "secret":
            if at >= secret and (m := _SECRET.match(text, last + 1)):
                secret = m.end()  # also where it has no digit: what was read isn't read again
                if _DIGITS.search(m[1]):
                    out.append((m.start(1), 7, secret))
        elif kind == "login":
            if at >= login and text[at - 1 : at].isalpha() and (m := _USER.match(text, last + 1)):
                login = m.end()
                out.append((last + 1, 8, login))
        elif not text[last + 1 : last + 2].isalnum():  # the end of a street's name
            before = max(0, at - _BACK)
            if (m := _HOUSE.search(text[before:at])) and not text[before + m.start() - 1 : before + m.start()].isalnum():
                out.append((before + m.start(), 6, last + 1))
    return sorted(out)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, offsets = [], [0]
        for text in batch.column(1).to_pylist():
            flat += spans_of(text)
            offsets.append(len(flat))
        starts, kinds, ends = zip(*flat, strict=True) if flat else ((), (), ())
        each = pa.StructArray.from_arrays([pa.array([KINDS[k] for k in kinds], pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["kind", "start", "end"])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each)], ["id", "found"])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and ``found``, the spans (kind, start, end) by start, then kind as in ``KINDS``;
    code points, end exclusive.

    Base kinds, leftmost and not overlapping within a kind, without retries after a match that fails its check: ``email``;
    ``ip`` (parts up to 255); ``card`` (14 to 19 digits, Luhn); ``phone`` (10 to 15 digits).  Further ones: ``iban`` (modulo
    97), ``account`` (6 to 18 digits after a cue such as account, passport, ssn), ``address`` (a number, one to four
    capitalised words and a street word), ``secret`` (8 characters or more with a digit after a cue such as token or
    password and a colon or equals sign), ``login`` (user and password in an address).  Spans of different kinds may
    overlap, as a card's and an account's.  Only ASCII digits and letters count in base kinds.

    Null and empty texts have none.  Null ids stay null; repeated rows each have a row; empty tables give empty results;
    columns other than the two named are ignored.  A text of any length is read whole.  Nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(_run, f"id {kind}, found array<struct<kind:string,start:bigint,end:bigint>>")


def query(spark, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    listed = lambda spans: f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    base = f"filter(found, x -> x.kind in ({', '.join(repr(k) for k in BASE)}))"
    return found.select(
        F.col("id").alias("doc_id"), *(F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE),
        F.sha2(F.expr(listed(base)), 256).alias("base_sha256"), F.expr(listed("found")).alias("spans"),
    )
