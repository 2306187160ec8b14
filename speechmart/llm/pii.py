"""Personal data by anchor expansion.

One automaton finds at-signs, digits, plus signs, scheme marks and identifier cues in a single pass;
local parsers expand each anchor to a full span and validate it. Spans of the kinds email, ip, card
and phone are leftmost and non-overlapping per kind; an invalid match is dropped and not retried.
Two further kinds need more evidence: ``url`` (an address that carries user information before its
host) and ``account`` (an identifier right behind a cue that stands as a word of its own). An account
behind ``iban`` has the length of its country and passes the check modulo 97; the shortest such reading
counts, so words behind it stay out. A routing number has nine digits and passes the check modulo 10.
Social security numbers lie in the ranges that are given out. Other numbers (passports, accounts) have no
check of their own: six to seventeen digits behind their cue are reported as they are.

Null counts as an empty text, which has no spans; texts are read whole, positions are code points;
repeated rows give repeated results; an empty table gives an empty result; columns other than the two
named are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
#: Words that announce an account number, in lower case, and what kind of number follows.
CUES = {
    "iban": "iban", "ssn": "ssn", "social security": "ssn", "social security number": "ssn", "routing number": "routing",
    "passport": "other", "passport number": "other", "passport no": "other", "account no": "other", "account number": "other", "acct": "other", "kontonummer": "other",
}
# The length of account numbers by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22,
    "VG": 24, "XK": 20,
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_URL_REST = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=:-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?(?:[/?#][^\s<>\"']*)?")
_AFTER_CUE = re.compile(r"[\x20:#.=-]{1,4}")
_IBAN = {c: re.compile(rf"{c}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for c, n in IBAN_LENGTH.items()}
_SSN = re.compile(r"([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_ROUTING = re.compile(r"[0-9]{9}(?![0-9A-Za-z])")
_NUMBER = re.compile(r"[A-Z]{0,2}[0-9]{6,17}(?![0-9A-Za-z])")


def luhn(digits: str) -> bool:
    """The check of card numbers."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v *= 2
            if v > 9:
                v -= 9
        total += v
    return total % 10 == 0


def _iban_valid(text: str) -> bool:
    t = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def _routing_valid(digits: str) -> bool:
    return sum(w * int(c) for w, c in zip((3, 7, 1) * 3, digits, strict=True)) % 10 == 0 and digits != "0" * 9


class Finder:
    """Finds the spans of one text after another."""

    def __init__(self) -> None:
        a = ahocorasick.Automaton()
        for c in "0123456789":
            a.add_word(c, "d")
        a.add_word("@", "@")
        a.add_word("+", "+")
        a.add_word("://", ":")
        for cue in CUES:
            for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                a.add_word(form, (cue, len(cue)))
        a.make_automaton()
        self.automaton = a

    def find(self, text: str) -> dict[str, list[tuple[int, int]]]:
        """Spans by kind, in order of their starts, ends exclusive."""
        out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        free = dict.fromkeys(KINDS, 0)
        run_end = 0
        for end, what in self.automaton.iter(text):
            if what == "d":
                if end >= run_end:
                    run_end = self._digits(text, end, out, free)
            elif what == "@":
                self._email(text, end, out, free)
            elif what == "+":
                if end >= free["phone"] and (m := _PHONE.match(text, end)):
                    free["phone"] = m.end()
                    if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                        out["phone"].append(m.span())
            elif what == ":":
                self._url(text, end, out, free)
            elif (start := end + 1 - what[1]) == 0 or not (text[start - 1].isalnum() or text[start - 1] == "_"):
                self._account(text, end + 1, CUES[what[0]], out, free)
        return out

    @staticmethod
    def _digits(text: str, at: int, out: dict, free: dict) -> int:
        """At the first digit of a run: address and card; gives the end of the run."""
        if at >= free["ip"] and (m := _IP.match(text, at)):
            free["ip"] = m.end()
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                out["ip"].append(m.span())
        if at >= free["card"] and (m := _CARD.match(text, at)):
            free["card"] = m.end()
            if 13 <= m.end() - m.start() <= 40:
                digits = _NOT_DIGIT.sub("", m[0])
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        n = len(text)
        while at < n and "0" <= text[at] <= "9":
            at += 1
        return at

    @staticmethod
    def _email(text: str, at: int, out: dict, free: dict) -> None:
        start, low = at, free["email"]
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out["email"].append((start, m.end()))
            free["email"] = m.end()

    @staticmethod
    def _url(text: str, at: int, out: dict, free: dict) -> None:
        start, low = at - 2, free["url"]
        while start > low and text[start - 1] in _SCHEME:
            start -= 1
        while start < at - 2 and not text[start].isalpha():
            start += 1
        if start < at - 2 and (m := _URL_REST.match(text, at + 1)):
            out["url"].append((start, m.end()))
            free["url"] = m.end()

    @staticmethod
    def _account(text: str, at: int, kind: str, out: dict, free: dict) -> None:
        """Behind a cue: an account number, a number of the cue's own kind, or for unchecked kinds any number."""
        if at < free["account"] or not (gap := _AFTER_CUE.match(text, at)):
            return
        at = gap.end()
        shape = _IBAN.get(text[at : at + 2])
        if shape and (m := shape.match(text, at)) and _iban_valid(m[0]):
            pass
        elif kind in ("ssn", "other") and (m := _SSN.match(text, at)):
            if m[1] in ("000", "666") or m[1] >= "900" or m[2] == "00" or m[3] == "0000":
                return
        elif kind == "routing" and (m := _ROUTING.match(text, at)):
            if not _routing_valid(m[0]):
                return
        elif kind != "other" or not (m := _NUMBER.match(text, at)):
            return
        out["account"].append(m.span())
        free["account"] = m.end()


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    """kind:start:end of the given kinds, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of the base kinds, base_sha256, spans, n_url and n_account."""
    d = pick(docs, [id_col, text_col])
    counts = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in slices(batches):
            found = [finder.find(t or "") for t in batch.column(1).to_pylist()]
            cols = [batch.column(0)]
            cols += [pa.array([len(f[k]) for f in found], pa.int64()) for k in KINDS]
            cols.append(pa.array([hashlib.sha256(joined(f, BASE_KINDS).encode()).hexdigest() for f in found], pa.string()))
            cols.append(pa.array([joined(f, KINDS) for f in found], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, *counts, "base_sha256", "spans"])

    kind = d.schema[id_col].dataType.simpleString()
    return d.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string")
