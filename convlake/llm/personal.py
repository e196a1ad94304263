"""Personal data by anchor expansion.

One Aho-Corasick automaton goes over each text and finds anchors: at-signs, plus signs and digits, dots
before digits, schemes of addresses, and cues of identifiers ("iban", "account no" and so on).  From each
anchor a local parser reads to the left and right as far as its form goes, and validates what it has read:
parts of numbers, check digits, the number of digits.  Texts are never searched otherwise.

Base kinds are those of the contract, leftmost and non-overlapping for each kind: a parser never goes back
behind the end of what it read last, whether that was kept or not.  Two kinds are added:

- ``address``: web addresses that tell a person (user information, ``~name``, a path such as ``/user/name``,
  a query key such as ``email``) and ``tel:`` numbers;
- ``account``: IBANs whose check digits are right, and numbers behind a cue, with 5 to 34 letters and digits.

An added span that a base span covers, or that touches an earlier added one, is left out.

Edge cases: a null or empty text has no spans; places count code points; texts of any length are read whole;
repeated rows are read each; an empty table gives an empty table; columns other than those named by the
parameters aren't looked at, and :func:`redact` keeps them all, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.llm.common import byte_slices, ship

KINDS = ("email", "ip", "card", "phone", "address", "account")
BASE = 4
DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOCAL = frozenset(LETTERS + DIGITS + "._%+-")
WORD = frozenset(LETTERS + DIGITS)

#: What the local parsers read, each from one place on.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
GROUPED = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ADDRESS = re.compile(r"""[^\s<>"'`{}|\\^\[\]]+""")
TEL = re.compile(r"\+?[0-9](?:[().-]?[0-9])+")
BEHIND_CUE = re.compile(r"(?:\x20?(?:no|nr|num|number|nummer|numéro|número|id)\b)?\.?\x20?[:#=]?\x20?", re.IGNORECASE)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?")
IDENTIFIER = re.compile(r"[A-Za-z]{0,3}[\x20-]?[0-9](?:[\x20./-]?[0-9])*[A-Za-z]?")

SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "tel:")
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "ssn", "social security", "passport", "passeport", "pasaporte", "reisepass", "steuer-id", "tax id", "dni")
#: Paths and query keys behind which a name stands.
NAMED = re.compile(r"/~[^/?#]+|/(?:users?|profiles?|people|members?|in|u)/[^/?#]+|[?&](?:e-?mail|phone|tel|user(?:name)?|name|account)=[^&#]+", re.IGNORECASE)
HOST = re.compile(r"(?:[^/@]+@)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(doubled) + sum(map(int, digits[-1::-2]))) % 10 == 0


def checked_iban(said: str) -> bool:
    said = said.replace(" ", "")
    return 15 <= len(said) <= 34 and int("".join(str(int(c, 36)) for c in said[4:] + said[:4])) % 97 == 1


def digits_of(said: str) -> str:
    return "".join(c for c in said if c in DIGITS)


class Finder:
    """The automaton with its parsers.

    A parser gets the text, where its anchor begins and ends, and from where on it may read; it gives the spans it
    found and from where on it may read next.
    """

    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        anchors: dict[str, list[Callable]] = {"@": [self.email]}
        for d in DIGITS:
            anchors[d], anchors[f".{d}"], anchors[f"+{d}"] = [self.card], [self.ip], [self.phone]
        for scheme in SCHEMES:
            anchors[scheme] = anchors[scheme.upper()] = [self.telephone if scheme == "tel:" else self.address]
        for cue in CUES:
            for form in (cue, cue.capitalize(), cue.title(), cue.upper()):
                anchors[form] = [self.account]
        for anchor, parsers in anchors.items():
            self.automaton.add_word(anchor, (len(anchor), parsers))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[Span]:
        """All spans by start, then kind."""
        base, more, free = [], [], {}
        for last, (size, parsers) in self.automaton.iter(text):
            for parser in parsers:
                name = parser.__name__
                begin = last + 1 - size
                if begin < free.get(name, 0):
                    continue
                found, free[name] = parser(text, begin, last + 1, free.get(name, 0))
                for s in found:
                    (base if s[1] < BASE else more).append(s)
        base.sort()
        if more:
            base += self.apart(sorted(more), base)
        return sorted(base)

    @staticmethod
    def apart(more: list[Span], base: list[Span]) -> list[Span]:
        """Those of ``more``, in order, that none of ``base`` covers and that touch none kept before."""
        kept, until, k, reach = [], 0, 0, 0
        for s in more:
            while k < len(base) and base[k][0] <= s[0]:
                reach = max(reach, base[k][2])
                k += 1
            if reach < s[2] and until <= s[0]:
                kept.append(s)
                until = s[2]
        return kept

    # ---- parsers --------------------------------------------------------------------------

    @staticmethod
    def email(text: str, at: int, end: int, free: int) -> tuple[list[Span], int]:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        domain = DOMAIN.match(text, end) if begin < at else None
        return ([(begin, 0, domain.end())], domain.end()) if domain else ([], free)

    @staticmethod
    def ip(text: str, at: int, end: int, free: int) -> tuple[list[Span], int]:
        begin = at
        while begin > free and text[begin - 1] in DIGITS:
            begin -= 1
        if begin == at:
            return [], free
        chain = DOTTED.match(text, begin)
        parts, place, found = chain[0].split("."), begin, []
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                found.append((place, 1, place + size))
            place += size + 1
        return found, chain.end()

    @staticmethod
    def card(text: str, at: int, end: int, free: int) -> tuple[list[Span], int]:
        chain = GROUPED.match(text, at)
        if not chain:
            return [], free
        digits = digits_of(chain[0])
        return ([(at, 2, chain.end())] if 14 <= len(digits) <= 19 and luhn(digits) else []), chain.end()

    @staticmethod
    def phone(text: str, at: int, end: int, free: int) -> tuple[list[Span], int]:
        dialled = DIALLED.match(text, at)
        if not dialled:
            return [], free
        return ([(at, 3, dialled.end())] if 10 <= len(digits_of(dialled[0])) <= 15 else []), dialled.end()

    @staticmethod
    def address(text: str, at: int, end: int, free: int) -> tuple[list[Span], int]:
        rest = ADDRESS.match(text, end)
        if not rest or at and text[at - 1] in WORD:
            return [], free
        said = rest[0].rstrip(".,;:!?)")
        host = HOST.match(said)
        tells = host and ("@" in host[0] or NAMED.search(said, host.end()))
        return ([(at, 4, end + len(said))] if tells else []), rest.end()

    @staticmethod
    def telephone(text: str, at: int, end: int, free: int) -> tuple[list[Span], int]:
        number = TEL.match(text, end)
        if not number or at and text[at - 1] in WORD:
            return [], free
        return ([(at, 4, number.end())] if 7 <= len(digits_of(number[0])) <= 15 else []), number.end()

    @staticmethod
    def account(text: str, at: int, end: int, free: int) -> tuple[list[Span], int]:
        if at and text[at - 1].isalnum() or text[end : end + 1].isalnum():
            return [], free
        begin = BEHIND_CUE.match(text, end).end()
        iban = IBAN.match(text, begin)
        if iban and checked_iban(iban[0]):
            return [(begin, 5, iban.end())], iban.end()
        if text[at:end].lower() == "iban":
            return [], free
        said = IDENTIFIER.match(text, begin)
        if not said or text[said.end() : said.end() + 1].isalnum() or not 5 <= len(digits_of(said[0])) <= 34:
            return [], free
        return [(begin, 5, said.end())], said.end()


def spelled(spans: list[Span]) -> str:
    """kind:start:end of each span, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; what overlaps is replaced once."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_personal(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, spans), one for each document: (kind, start, end) by start, then kind."""
    ship(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for some in byte_slices(batches):
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in finder.spans(t or "")] for t in some.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    narrow = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with all spans masked by their kinds; rows and columns stay, a null text stays null."""
    ship(docs.sparkSession)
    place, schema = docs.columns.index(text), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for some in byte_slices(batches):
            texts = [t and masked(t, finder.spans(t)) for t in some.column(place).to_pylist()]
            columns = list(some.columns)
            columns[place] = pa.array(texts, some.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=some.schema)

    return docs.mapInArrow(run, schema)


def op12_personal_data(documents: DataFrame) -> DataFrame:
    ship(documents.sparkSession)
    counts = [f"n_{k}" for k in KINDS[:BASE]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for some in byte_slices(batches):
            found = [finder.spans(t or "") for t in some.column(1).to_pylist()]
            n = [pa.array([sum(s[1] == k for s in spans) for spans in found], pa.int64()) for k in range(BASE)]
            base = [hashlib.sha256(spelled([s for s in spans if s[1] < BASE]).encode()).hexdigest() for spans in found]
            yield pa.RecordBatch.from_arrays([some.column(0), *n, pa.array(base), pa.array(map(spelled, found), pa.string())], ["doc_id", *counts, "base_sha256", "spans"])

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in counts)}, base_sha256 string, spans string")
