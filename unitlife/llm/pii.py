"""Operator 3: personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, scheme separators, digits and identifier
cues. A local parser per anchor expands it to the left and right, in time that grows with the span, and
validates what it found. Base kinds are ``email``, ``ip``, ``card`` and ``phone``; the method adds ``url`` (from
``://``) and ``account`` (an identifier that follows a cue). Cues are found without regard to case; each has a parser that
sets the identifier's boundary: IBANs end where their check digits agree, social security numbers have nine digits in ranges
that are issued, passports one word, other identifiers 6 to 34 letters and digits, four digits at least, in words that all hold a digit.
Spans of one kind do not overlap; spans of different kinds may.

Every text is read whole, in the task that scanned it; nothing is shuffled. A null text is an empty one, which
has no span. All other columns pass through; input columns with the names of the new ones are replaced. Repeated
rows are handled alike, an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from unitlife.llm.shared import positional, values

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
# Words that announce an identifier, and words that do so with "id" or "number" behind them.
CUES = ("account", "acct", "iban", "ssn", "social security", "passport")
OWNERS = ("customer", "client", "user", "member", "patient", "employee", "taxpayer")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_SPACED = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]++")
_ADDRESS = re.compile(r"[^\s<>\"'`\\{}|^]++")
_HOST = re.compile(r"(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]+)")
_TAIL = re.compile(r"([ \t_-]{0,2}(?:id|number|num|no|nr)(?![A-Za-z]))?\.?(?:[ \t]+is(?![A-Za-z]))?[ \t]{0,3}[:=#]?[ \t]{0,3}", re.I | re.A)
_PLAIN = re.compile(r"[A-Za-z]*+[0-9][A-Za-z0-9]*+(?:[ -][A-Za-z]*+[0-9][A-Za-z0-9]*+)*+")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]{4}){2,7}(?:[ -]?[A-Za-z0-9]{1,3})?")
_IBAN_PART = re.compile(r"[ -]?[A-Za-z0-9]{1,4}")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}([ -]?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![A-Za-z0-9])")
_PASSPORT = re.compile(r"[A-Za-z]{0,3}[0-9]{6,9}(?![A-Za-z0-9])")
_DIGITS = frozenset("0123456789")

Span = tuple[int, int, str]


def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for sign in "@+":
        found.add_word(sign, sign)
    for digit in _DIGITS:
        found.add_word(digit, "0")
    found.add_word("://", "/")
    for cue in (*CUES, *OWNERS):
        found.add_word(cue, cue)
    found.make_automaton()
    return found


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign, not reaching left of ``floor``."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def ips_in(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Groups of four in a run of dotted numbers, from the left; a group with a part over 255 is dropped."""
    parts = text[start:end].split(".")
    for k in range(0, len(parts) - 3, 4):
        four = parts[k:k + 4]
        stop = start + sum(map(len, four)) + 3
        if all(map(_octet, four)):
            yield start, stop
        start = stop + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def is_card(run: str) -> bool:
    digits = run.replace(" ", "").replace("-", "")
    return 12 <= len(digits) <= 19 and luhn(digits)


def phone_at(text: str, at: int) -> tuple[int, int, bool] | None:
    """Start, end and validity of the number after a plus sign."""
    found = _PHONE.match(text, at)
    run = found[0].rstrip(" ().-") if found else ""
    if len(run) < 4:
        return None
    return at, at + len(run), 9 <= sum(c in _DIGITS for c in run) <= 15


def url_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around a scheme separator that begins at ``at``."""
    start = at
    while start > floor and text[start - 1] in _SCHEME:
        start -= 1
    while start < at and not (text[start].isascii() and text[start].isalpha()):
        start += 1
    rest = _ADDRESS.match(text, at + 3) if start < at else None
    tail = rest[0].rstrip(".,;:!?)]") if rest else ""
    return (start, at + 3 + len(tail)) if tail and _HOST.match(tail) else None


def _iban(text: str, at: int) -> int | None:
    """The furthest end of a word of the number at which its check digits agree."""
    run = _IBAN.match(text, at)
    if not run:
        return None
    end = None
    for part in _IBAN_PART.finditer(text, at + 4, run.end()):
        stop = part.end()
        compact = text[at:stop].replace(" ", "").replace("-", "").upper()
        if 15 <= len(compact) <= 34 and not (text[stop:stop + 1].isascii() and text[stop:stop + 1].isalnum()):
            if int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1:
                end = stop
    return end


def _plain(text: str, at: int) -> int | None:
    found = _PLAIN.match(text, at)
    compact = found[0].replace(" ", "").replace("-", "") if found else ""
    return found.end() if 6 <= len(compact) <= 34 and sum(c in _DIGITS for c in compact) >= 4 else None


def _matched(pattern: re.Pattern):
    def parse(text: str, at: int) -> int | None:
        found = pattern.match(text, at)
        return found.end() if found else None
    return parse


PARSERS = dict.fromkeys((*CUES, *OWNERS), _plain) | {
    "iban": _iban, "ssn": _matched(_SSN), "social security": _matched(_SSN), "passport": _matched(_PASSPORT)}


def account_after(text: str, cue: str, start: int, end: int) -> tuple[int, int] | None:
    """The identifier that follows the cue between ``start`` and ``end``."""
    if start and text[start - 1].isalnum():
        return None
    tail = _TAIL.match(text, end)
    if not tail[1] and (cue in OWNERS or text[end:end + 1].isalpha()):
        return None
    stop = PARSERS[cue](text, tail.end())
    return (tail.end(), stop) if stop else None


def folded(text: str) -> str:
    """Lower case, every character at its place."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def spans_of(text: str, automaton: ahocorasick.Automaton) -> list[Span]:
    """All spans as ``(start, end, kind)``, by start and then in the order of ``KINDS``."""
    out: list[Span] = []
    past = dict.fromkeys((*KINDS, "dotted", "spaced"), 0)  # where each parser has got to

    def keep(kind: str, start: int, end: int) -> None:
        out.append((start, end, kind))
        past[kind] = end

    for last, mark in automaton.iter(folded(text)):
        if mark == "0":
            if last >= past["dotted"]:
                end = past["dotted"] = _DOTTED.match(text, last).end()
                for start, stop in ips_in(text, last, end):
                    keep("ip", start, stop)
            if last >= past["spaced"]:
                run = _SPACED.match(text, last)
                past["spaced"] = run.end() if run else last + 1
                if run and is_card(run[0]):
                    keep("card", last, run.end())
        elif mark == "@":
            if found := email_at(text, last, past["email"]):
                keep("email", *found)
        elif mark == "+":
            if last >= past["phone"] and (number := phone_at(text, last)):
                past["phone"] = number[1]
                if number[2]:
                    keep("phone", *number[:2])
        elif mark == "/":
            if last - 2 >= past["url"] and (found := url_at(text, last - 2, past["url"])):
                keep("url", *found)
        else:
            start = last + 1 - len(mark)
            if start >= past["account"] and (found := account_after(text, mark, start, last + 1)):
                keep("account", *found)
    order = {kind: i for i, kind in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[0], order[s[2]]))


def masked(text: str, spans: list[Span]) -> str:
    """The text with its spans replaced by their kind; overlapping spans become one, named by the first."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find(df: DataFrame, text: str = "text", mask: str | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` (its columns ``keep``, or all) with ``spans``, an array of kind, start and end (code points, end
    exclusive), and, if ``mask`` names a column, the text with all spans replaced there."""
    added = ["spans", *([mask] if mask else [])]
    kept = [c for c in (df.columns if keep is None else keep) if c not in added]
    source = positional(df.select(df[text].cast("string"), *(df[c] for c in kept)))
    span = StructType([StructField("kind", StringType()), StructField("start", IntegerType()),
                       StructField("end", IntegerType())])
    schema = StructType([*(StructField(c, f.dataType) for c, f in zip(kept, source.schema.fields[1:], strict=True)),
                         StructField("spans", ArrayType(span)), *([StructField(mask, StringType())] if mask else [])])
    arrow_span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches):
        automaton = anchors()
        for batch in batches:
            found = [spans_of(t or "", automaton) for t in values(batch.column(0))]
            columns = [*batch.columns[1:], pa.array(
                [[{"kind": k, "start": s, "end": e} for s, e, k in row] for row in found], arrow_span)]
            if mask:
                texts = zip(values(batch.column(0)), found, strict=True)
                columns.append(pa.array([masked(t or "", s) for t, s in texts], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(scan, schema)
