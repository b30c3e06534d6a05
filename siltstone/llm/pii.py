"""Personal data, also in disguise, by offset-preserving deobfuscation.

Base patterns find e-mail addresses, IPv4 addresses, card and phone numbers in the text as it stands.
Then a chain of transducers rewrites it: look-alike and full-width characters to ASCII, invisible ones
to nothing, spelled digits to digits, "at" and "dot" in their disguises to the signs.  Each keeps, for
every character of its output, where in its input that came from, so what the same patterns find in the
normalised text maps back to source characters.  A find counts only if it covers something rewritten.

Of an address with only its at said ("name at host.com") the local part must have parts, two digits at its end
or words like "mail:" before it; "name" alone is prose ("look at example.com") and is not found.

Scale: one scan without a shuffle.  Every pattern is linear in the text: runs are entered at their
start and taken whole, without retries.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, with_fields

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches that don't overlap: of each ``@``, the run before it and the domain after it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)  # no later match begins before a sign that ends no run
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[Span]:
    """By start, then by kind in the order of ``KINDS``."""
    found = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if "." in text:
        found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() < 64 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    if "+" in text:
        found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


class Mapped:
    """A text with, for each of its characters, where in the source it begins and ends, and whether it was rewritten."""

    def __init__(self, text: str, starts: array | None = None, ends: array | None = None, changed: bytearray | None = None):
        self.text = text
        self.starts = array("q", range(len(text))) if starts is None else starts
        self.ends = array("q", range(1, len(text) + 1)) if ends is None else ends
        self.changed = bytearray(len(text)) if changed is None else changed

    def rewritten(self, pattern: re.Pattern, to) -> Mapped:
        """``to`` gives the text for a match, or None to leave it; its characters all come from the whole match."""
        return self.edited((m.start(), m.end(), to(m)) for m in pattern.finditer(self.text))

    def edited(self, edits: Iterable[tuple[int, int, str | None]]) -> Mapped:
        """With (start, end, new text), in order and apart; None leaves what is there."""
        text, starts, ends, changed, done, gaps = [], array("q"), array("q"), bytearray(), 0, []
        for start, end, new in edits:
            if new is None or end == start:
                continue
            text.append(self.text[done:start])
            starts += self.starts[done:start]
            ends += self.ends[done:start]
            changed += self.changed[done:start]
            if len(new) == end - start:  # one for one
                starts += self.starts[start:end]
                ends += self.ends[start:end]
            else:
                starts += array("q", [self.starts[start]]) * len(new)
                ends += array("q", [self.ends[end - 1]]) * len(new)
            text.append(new)
            changed += b"\1" * len(new)
            if not new:
                gaps.append(len(changed))  # what follows a deletion counts as rewritten
            done = end
        if not text:
            return self
        changed += self.changed[done:]
        for k in gaps:
            if k < len(changed):
                changed[k] = 1
        return Mapped("".join(text) + self.text[done:], starts + self.starts[done:], ends + self.ends[done:], changed)

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


# Letters of other scripts that look like ASCII ones, and what they look like.
_LOOKS = dict(zip("аеорсухіјѕԁһАВЕКМНОРСТХІЈЅαοονρτυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhABEKMHOPCTXIJSaoovptuikABEZHIKMNOPTYX", strict=True))
_LOOKS |= dict(zip("кԛԝѵүҽӏвмнтгпһԁУҮԚԜѴԌӀҺεηχγωσϲϳϹͿօսոհյցզլՏՕՍԼᎪᎬᎻᎠᎡᎢᎥᎫᎳᎷᏃᏀᏚᏙᏞᏟᏢᏦᏴıɑɡɩᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ", "kqwvyelbmhtrnhdYYQWVGIhenxywocjCJounhjgqlSOULAEHDRTiJWMZGSVLCPKBiagiabcdefghijklmnoprstuvwyz", strict=True))
#: Negative circled and squared letters, which have no compatibility form.
_LOOKS |= {chr(first + k): chr(ord("A") + k) for first in (0x1F150, 0x1F170) for k in range(26)}
_INVISIBLE = "­​‌‍⁠﻿"
_SIGNS = {"﹫": "@", "｡": ".", "ꓸ": ".", "․": ".", "。": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ", " ": " "}
#: All characters with a decimal digit's value, or whose compatibility form is printable ASCII, but marks that follow a word.
_MARKS = frozenset("™℠")
_COMPATIBLE = [c for c in map(chr, range(0x80, 0x20000)) if c not in _MARKS and (unicodedata.digit(c, None) is not None or re.fullmatch(r"[ -~]+", unicodedata.normalize("NFKC", c)))]
_ALL_FOREIGN = sorted({*_LOOKS, *_SIGNS, *_INVISIBLE, *_COMPATIBLE})
#: Apart, since a class with characters beyond U+FFFF is no table and slow.
_FOREIGN_BASIC = f"[{''.join(re.escape(c) for c in _ALL_FOREIGN if c <= '\uffff')}]"
_FOREIGN_BEYOND = f"[{''.join(c for c in _ALL_FOREIGN if c > '\uffff')}]"
_BASIC, _BEYOND = re.compile(_FOREIGN_BASIC), re.compile(rf"(?=[\U00010000-\U0001ffff]){_FOREIGN_BEYOND}")
_FOREIGN = re.compile(rf"{_FOREIGN_BASIC}|{_BEYOND.pattern}")

# Names of digits and of signs.
_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_TIMES = {"double": 2, "triple": 3}
_NAME = rf"(?:(?:double|triple)[ -]+)?(?:{'|'.join(_DIGITS)})(?![A-Za-z0-9])"
#: Names of digits in a row, or among digits, that count: fewer are prose, unless there are three dots among them.
LEAST_SPELLED = 4
_DOT = r"(?:\.|[ \t]+dot[ \t]+)"
_BETWEEN = r"(?:[ \t,.()\[\]{}-]|(?<![A-Za-z])dot(?![A-Za-z]))++"
_STARTS = (rf"(?:plus{_BETWEEN}|\+[ \t]*+)?{_NAME}", rf"(?:plus{_BETWEEN}|\+[ \t]*+)[0-9]{{1,3}}(?={_BETWEEN}{_NAME})", rf"[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{0,2}}(?={_DOT}{_NAME})")
_SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:{'|'.join(_STARTS)})(?:{_BETWEEN}(?:{_NAME}|[0-9]++(?![A-Za-z])))*+", re.I)
_SPELLED_PART = re.compile(rf"(?P<name>{_NAME})|(?P<plus>plus|\+)|(?P<number>[0-9]+)|(?P<between>{_BETWEEN})", re.I)
_ENTITY = re.compile(r"&#0*64;|&#[xX]0*40;|&commat;|&#0*46;|&#[xX]0*2[eE];|&period;|%40")
#: Blanks before are entered where their run begins, or not at all.
_BRACKETED = re.compile(r"(?:(?<![ \t])[ \t]++|(?=[\[({<_-]))(?:\[[ \t]*+(?:at|@|dot|\.)[ \t]*+\]|\([ \t]*+(?:at|@|dot|\.)[ \t]*+\)|\{[ \t]*+(?:at|@|dot|\.)[ \t]*+\}|<[ \t]*+(?:at|@|dot|\.)[ \t]*+>|(?<=[ \t])_(?:at|dot)_|[-_]{1,2}(?:at|dot)[-_]{1,2})[ \t]*+", re.I)
_NUMBER_DOT = re.compile(r"(?<=[0-9])[ \t]+dot[ \t]+(?=[0-9])", re.I)
#: A whole address, as its signs are said aloud: its at, then what may stand before it, read backwards, and after it.
_SAID_AT = re.compile(r"(?<![ \t])[ \t]++(?:at[ \t]++|@[ \t]*+)|@[ \t]*+", re.I)
_SAID_LOCAL = re.compile(r"[A-Za-z0-9_%+-]++(?:(?:\.|[ \t]++tod[ \t]++)[A-Za-z0-9_%+-]++)*+", re.I)
_SAID_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:(?:[ \t]++dot[ \t]++|\.)[A-Za-z0-9-]++)*+", re.I)
_SAID_DOT = re.compile(r"[ \t]+dot[ \t]+|\.", re.I)
_LABEL = re.compile(r"(?!dot$)[A-Za-z]{2,63}", re.I)
#: Where only the at is said: locals that are no word of prose and no name of a file or host, or that are introduced as an address.
_MAILBOX = re.compile(r"[A-Za-z]+[0-9]*(?:[._+][A-Za-z0-9]+)*[._+](?!(?:js|py|net|io|com|org|md|txt|html?)$)[A-Za-z0-9]+|[A-Za-z]+[0-9]{2,}", re.I)
_INTRODUCED = re.compile(r"(?:mail|mailto|contact|address)[ \t]*(?:[:=]|[ \t]is)[ \t]*$", re.I)
_SAID_PLAINLY = re.compile(r"[ \t]at[ \t]+[A-Za-z0-9-]+\.[A-Za-z0-9]", re.I)
_PRONOUNS = frozenset(["me", "us", "him", "her", "them", "you", "it"])
_SAID_SIGN = re.compile(r"[ \t]+(at|dot)[ \t]+|[ \t]*@[ \t]*", re.I)
_LONG_DIGITS = re.compile(r"(?<![0-9+])[0-9]{10,15}(?![0-9])")
#: The same in groups, as spelled ones are left.
_GROUPED = re.compile(r"(?<![0-9+.(])\(?[0-9]{3}(?:\)|\)?\. ?)[0-9]{3}(?:\. ?)?[0-9]{4}(?![0-9])")


def _foreign(m: re.Match) -> str:
    c = m[0]
    if c in _INVISIBLE:
        return ""
    if c in _LOOKS:
        return _LOOKS[c]
    if c in _SIGNS:
        return _SIGNS[c]
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    return unicodedata.normalize("NFKC", c)


def _spelled(text: str) -> Iterator[tuple[int, int, str]]:
    """The edits that write spelled digits, and what stands between them: dots and brackets stay, in their signs."""
    for run in _SPELLED.finditer(text):
        parts = list(_SPELLED_PART.finditer(text, *run.span()))
        names = sum(m.lastgroup == "name" for m in parts)
        dots = sum(m.lastgroup == "between" and _between(m[0], False) == "." for m in parts)
        if names >= LEAST_SPELLED or names and dots >= 3:
            for m in parts:
                yield m.start(), m.end(), _between(m[0], dots >= 3) if m.lastgroup == "between" else _digits(m[0])


def _digits(part: str) -> str:
    *times, last = re.findall(r"[a-z]+|[0-9]+|\+", part.lower())
    return "+" if last in ("plus", "+") else _DIGITS.get(last, last) * (_TIMES[times[0]] if times else 1)


def _between(part: str, commas: bool) -> str:
    """Commas part an IP address from what follows; a full stop before a space is none of its dots."""
    if "dot" in part.lower():
        return "."
    signs = "".join("(" if c in "([{" else ")" if c in ")]}" else c if c == "." or c == "," and commas else "" for c in part)
    return signs + " " if "." in signs and part != "." else signs


def _sign(m: re.Match) -> str:
    return "@" if "at" in m[0].lower() or "@" in m[0] else "."


def _entity(m: re.Match) -> str:
    return "@" if "64" in m[0] or "40" in m[0] or "at" in m[0] else "."


def normalised(text: str) -> Mapped | None:
    """The text after all transducers; None if none of them applies."""
    low = text.lower()
    signs = "at" in low and any(c in text for c in "[({<-_")
    foreign = not text.isascii() and (_BASIC.search(text) or _BEYOND.search(text))
    spelled = "e" in low and next(_spelled(text), None)
    said = "dot" in low or "@" in text or _SAID_PLAINLY.search(text)
    entity = ("&" in text or "%40" in text) and _ENTITY.search(text)
    bracketed = (signs or said or any(x in text for x in ("[.", "(.", "{.", "[@", "(@"))) and _BRACKETED.search(text)
    if not (foreign or spelled or said or entity or bracketed):
        return None
    out = Mapped(text)
    if foreign:
        out = out.rewritten(_FOREIGN, _foreign)
    if entity:
        out = out.rewritten(_ENTITY, _entity)
    if bracketed or foreign:
        out = out.rewritten(_BRACKETED, _sign)
    out = out.edited(_spelled(out.text)) if spelled or foreign or bracketed else out
    return out.edited(_said(out)).rewritten(_NUMBER_DOT, lambda m: ".")


def _said(shown: Mapped) -> Iterator[tuple[int, int, str]]:
    """The edits that write the signs of said addresses.

    Linear: what is read backwards from an at ends at the at before, which is no part of it.
    """
    text, first = shown.text, 0
    for at in _SAID_AT.finditer(text):
        before, first = text[first : at.start()], max(first, at.end())
        local, domain = _SAID_LOCAL.match(before[::-1]), _SAID_DOMAIN.match(text, at.end())
        if not local or not domain:
            continue
        start, end = at.start() - local.end(), domain.end()
        dots = list(_SAID_DOT.finditer(domain[0]))
        while dots and not _LABEL.fullmatch(text, domain.start() + dots[-1].end(), end):
            end = domain.start() + dots.pop().start()
        words = text[start:end].lower().split()
        if dots and ("dot" in words or "at" in words and (any(shown.changed[start:end]) or _mailbox(text, start, at.start()))):
            yield from ((start + m.start(), start + m.end(), _sign(m)) for m in _SAID_SIGN.finditer(text[start:end]))
            first = max(first, end)


def _mailbox(text: str, start: int, end: int) -> bool:
    local = text[start:end]
    return bool(_MAILBOX.fullmatch(local)) or local.lower() not in _PRONOUNS and bool(_INTRODUCED.search(text[max(start - 20, 0) : start]))


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and these with the disguised ones."""
    base = base_spans(text)
    found = set(base)
    shown = normalised(text)
    if shown is not None:
        hidden = base_spans(shown.text) + [(*m.span(), "phone") for m in _LONG_DIGITS.finditer(shown.text) if all(shown.changed[m.start() : m.end()])]
        hidden += [(*m.span(), "phone") for m in _GROUPED.finditer(shown.text) if all(shown.changed[k] for k in range(*m.span()) if shown.text[k].isdigit())]
        for start, end, kind in hidden:
            if any(shown.changed[start:end]):
                found.add((*shown.source(start, end), kind))
    return base, sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


_FIELDS = [*[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_disguised", pa.int64())]


@F.arrow_udf(T.StructType([T.StructField(name, T.LongType() if kind == pa.int64() else T.StringType()) for name, kind in _FIELDS]))
def _found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct(_FIELDS)
    for batch in texts:
        out = []
        for text in batch:
            base, every = all_spans(text.as_py() or "")
            row = {f"n_{k}": sum(s[2] == k for s in base) for k in KINDS}
            out.append(row | {"base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "spans": joined(every), "n_disguised": len(every) - len(base)})
        yield pa.array(out, type=kind)


def find_pii(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_email``, ``n_ip``, ``n_card`` and ``n_phone`` of the base patterns, ``base_sha256``, ``spans`` (base and disguised) and ``n_disguised``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then by kind as listed, then by end.  A null text is
    empty: no spans.  Texts of any length are read whole, in linear time.  Repeated rows each get the same result; an empty table gives
    no rows.  No other column is read; columns named like the new ones are replaced.
    """
    return with_fields(docs, _found(F.col(quoted(text_col))), {name: name for name, _ in _FIELDS})
