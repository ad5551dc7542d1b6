"""Personal data in texts: anchors found by one Aho-Corasick pass, expanded by local parsers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marlstone.llm.common import LOWER, row_slices, string_buffer, trimmed

#: Bytes of text at once.
_SLICE = 1 << 20

#: Kinds in the order of spans that start together; the first four have fixed patterns.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "mailbox", "url", "iban", "account", "secret")

#: What an anchor is.
_AT, _PLUS, _DIGIT, _SCHEME, _IBAN, _ACCOUNT, _SECRET = range(7)
#: Words before an account or identity number, and before a credential.
ACCOUNT_CUES = ("account", "acct", "konto", "kontonummer", "compte", "cuenta", "customer id", "passport", "ssn", "social security", "tax id", "routing")
SECRET_CUES = ("token", "password", "passwd", "pwd", "api_key", "api-key", "apikey", "secret", "access_key", "private_key")

_LOCAL = "abcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[a-z0-9-]++(?:\.[a-z0-9-]++)++")
_WIDE_DOMAIN = re.compile(r"[^\W_](?:[^\W_]|-){0,62}+(?:\.[^\W_](?:[^\W_]|-){0,62}+)++")
_WIDE_LOCAL = frozenset("'&_.%+-")
_DOTTED, _SPACED, _DIALLED = re.compile(r"[0-9]++(?:\.[0-9]++)*+"), re.compile(r"[0-9]++(?:[ -][0-9]++)*+"), re.compile(r"[ ().0-9-]++")
_AUTHORITY, _REST = re.compile(r"[^\s/?#<>\"'`]*+"), re.compile(r"[^\s<>\"'`]*+")
_SCHEME_CHARS = "abcdefghijklmnopqrstuvwxyz0123456789+.-"
_FILLER = re.compile(r"(?:[ \t]{0,3}(?:number|no|nr|num|id|code|is|n°|#|:|=|\.)){0,4}[ \t]{0,3}")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9]){5,19}+(?![0-9])")
_IBAN_VALUE = re.compile(r"[a-z]{2}[0-9]{2}(?: ?[a-z0-9]){11,30}+")
_ASSIGNED = re.compile(r"[\"']?[ \t]{0,3}(?:=>|[:=])[ \t]{0,3}[\"']?([a-z0-9_+/=.~-]{8,512}+)")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for words, kind in ((("@",), _AT), ([f"+{d}" for d in range(10)], _PLUS), (map(str, range(10)), _DIGIT), (("://",), _SCHEME), (("iban",), _IBAN), (ACCOUNT_CUES, _ACCOUNT), (SECRET_CUES, _SECRET)):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the ones before."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_ok(value: str) -> bool:
    """Whether the number that letters (10 to 35) and digits spell, the first four last, is 1 modulo 97."""
    turned = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


class Parser:
    """Spans of one text after the other; ``spans`` takes it with A-Z lower-cased, which moves no code point.

    Every kind has a place behind its last run, and anchors before that place
    are passed over, so that a text takes time in proportion to its length.
    """

    def __init__(self):
        self.anchors = _automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, number of the kind, end) in order."""
        out: list[tuple[int, int, int]] = []
        mail_from = after_at = dotted_from = spaced_from = url_from = 0
        for last, (kind, size) in self.anchors.iter(text):
            at = last + 1 - size
            if kind == _DIGIT:
                if at >= spaced_from:
                    spaced_from = _SPACED.match(text, at).end()
                    self._card(text, at, spaced_from, out)
                if at >= dotted_from:
                    dotted_from = _DOTTED.match(text, at).end()
                    self._ips(text, at, dotted_from, out)
            elif kind == _AT:
                mail_from = self._mail(text, max(mail_from, after_at), mail_from, at, out)
                after_at = at + 1
            elif kind == _PLUS:
                self._phone(text, at, out)
            elif kind == _SCHEME:
                if at >= url_from:
                    url_from = self._url(text, url_from, at, out)
            elif not (at and (text[at - 1].isalnum())) and not text[last + 1 : last + 2].isalnum():
                self._cued(text, kind, last + 1, out)
        out.sort()
        return out

    @staticmethod
    def _card(text: str, start: int, end: int, out: list) -> None:
        """A run of digits with single spaces or hyphens between."""
        if end - start >= 12:
            digits = text[start:end].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((start, 2, end))

    @staticmethod
    def _ips(text: str, start: int, end: int, out: list) -> None:
        """Digit runs joined by dots, taken in fours from the left; a four with a part over 255 is no address."""
        if end - start < 7:
            return
        parts = text[start:end].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            stop = start + sum(map(len, four)) + 3
            if all(len(x := p.lstrip("0")) < 4 and int(x or 0) <= 255 for p in four):
                out.append((start, 1, stop))
            start = stop + 1

    @staticmethod
    def _phone(text: str, at: int, out: list) -> None:
        """A plus, and digits with space, brackets, dots and hyphens between, up to the last digit."""
        run = _DIALLED.match(text, at + 2)
        said = run.group().rstrip(" ().-") if run else ""
        if len(said) >= 2 and 9 <= 1 + sum(map(said.count, "0123456789")) <= 15:
            out.append((at, 3, at + 2 + len(said)))

    @staticmethod
    def _mail(text: str, low: int, free: int, at: int, out: list) -> int:
        """The address around an at-sign, and the wider one where its boundaries lie further out; returns where the next may start."""
        before, start, end = text[low:at], at, at
        start -= len(before) - len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append((start, 0, end))
        wide = at
        while wide > low and at - wide <= 64 and (text[wide - 1].isalnum() or text[wide - 1] in _WIDE_LOCAL):
            wide -= 1
        local, host = text[wide:at], _WIDE_DOMAIN.match(text, at + 1)
        if 0 < len(local) <= 64 and host and (wide, host.end()) != (start, end) and local[0].isalnum() and local[-1] != "." and ".." not in local:
            labels = host.group().split(".")
            if len(labels[-1]) > 1 and labels[-1].isalpha() and not any(x.endswith("-") for x in labels):
                out.append((wide, 4, host.end()))
        return end if domain else free

    @staticmethod
    def _url(text: str, low: int, at: int, out: list) -> int:
        """A URL with a user before its host; returns where the next may start."""
        head = _AUTHORITY.match(text, at + 3).group()
        before = text[max(low, at - 32) : at]
        start = at - (len(before) - len(before.rstrip(_SCHEME_CHARS)))
        if head.rpartition("@")[0] and not head.endswith("@") and start < at and text[start].isalpha():
            end = at + len(_REST.match(text, at).group().rstrip(".,;:!?)]}"))
            out.append((start, 5, end))
            return end
        return at + 3

    @staticmethod
    def _cued(text: str, cue: int, at: int, out: list) -> None:
        """The value that a word such as ``account`` or ``token`` announces; all looks ahead are of bounded length."""
        if cue == _SECRET:
            if (m := _ASSIGNED.match(text, at)) and re.search("[0-9]", m[1]) and re.search("[a-z]", m[1]):
                out.append((m.start(1), 8, m.end(1)))
            return
        at = _FILLER.match(text, at).end()
        if cue == _ACCOUNT:
            if m := _NUMBER.match(text, at):
                out.append((at, 7, m.end()))
        elif m := _IBAN_VALUE.match(text, at):
            value, end = m.group(), m.end()
            while len(value) >= 15:  # words behind may look like a part of it
                if text[end : end + 1].isalnum() or not iban_ok(value.replace(" ", "")):
                    cut = value.rfind(" ")
                    value = value[: max(cut, 0)]
                    end = at + len(value)
                else:
                    out.append((at, 6, end))
                    return


def _redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Overlapping spans as one, by the name of the first."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = end
    return "".join([*out, text[at:]])


_open: list[Parser] = []


def personal_data(docs: DataFrame) -> DataFrame:
    """Adds pii (kind, start, end, base: in order of start, then kind) and redacted (spans as ``<KIND>``) to every document.

    Spans count code points, the end exclusive. ``base`` marks the kinds with
    fixed patterns (email, ip, card, phone), each found leftmost and without
    overlap; of other kinds are addresses whose boundaries lie beyond the email pattern
    (mailbox), URLs with a user (url), and values behind cues (iban, account,
    secret). Kinds may overlap each other. Null texts have no spans and a null
    redacted; empty ones none; texts of any length are taken whole in time
    proportional to it; repeated rows get the same; an empty table gives no rows. Columns
    of these two names are replaced, others pass through; nothing is shuffled.
    """
    docs = docs.drop("pii", "redacted")
    kinds = pa.array(KINDS)
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _open:
            _open.append(Parser())
        for batch in batches:
            for part in row_slices(batch, "text", _SLICE):
                data, offsets = string_buffer(part["text"])
                low, raw = LOWER[data].tobytes(), data.tobytes()
                found, ends, clean = [], [0], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    spans = _open[0].spans(low[a:b].decode("utf-8", "replace"))
                    found += spans
                    ends.append(len(found))
                    clean.append(_redacted(raw[a:b].decode("utf-8", "replace"), spans))
                start, kind, end = np.array(found, np.int32).reshape(-1, 3).T
                rows = pa.StructArray.from_arrays([kinds.take(pa.array(kind)), pa.array(start), pa.array(end), pa.array(kind < len(BASE))], fields=list(item))
                redacted = pa.array(clean, pa.string(), mask=part["text"].is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows), redacted], names=[*part.schema.names, "pii", "redacted"])

    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())])
    return docs.mapInArrow(trimmed(run), T.StructType([*docs.schema.fields, T.StructField("pii", T.ArrayType(span)), T.StructField("redacted", T.StringType())]))
