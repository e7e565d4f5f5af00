"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, URL schemes, digits and
cue words of identifiers and secrets. From each anchor a small deterministic parser walks to the
borders of the address or account and validates what lies between. Positions are code points,
ends exclusive.

Base kinds (per kind leftmost, without overlap; a candidate that fails its test is dropped whole):

* ``email``  local part, at-sign, a domain of two labels or more
* ``ip``     four numbers joined by dots, none above 255
* ``card``   digits with at most one blank or hyphen between, 14 to 19 of them, Luhn sum right
* ``phone``  plus sign, digit, then digits, blanks, brackets, dots, hyphens up to a digit; 10 to 15 digits

Added kinds: ``account`` (a run of 14 to 19 digits with right Luhn sum inside a longer chain that
failed as a card), ``iban`` (cue: two letters and two check digits; as long as its country's numbers
are, or for other countries the longest that fits and ends with a group; remainder 1 of 97, no letter or
digit behind it), ``url``
(scheme to white space or quote) and ``secret`` (value after a cue such as ``password=``, or a key
that starts with a known prefix).

Defined results: null and empty texts have no spans; every row of the table gives one row,
repeated ones too; long texts are read whole; other columns take no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from rillwater.llm.tables import col, small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "iban", "url", "secret")

# Cue words and prefixes.
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
SECRET_CUES = ("password=", "passwd=", "secret=", "api_key=", "apikey=", "token=")
KEY_PREFIXES = {"AKIA": 20, "ASIA": 20, "ghp_": 40}

IBAN_LENGTHS = {country: int(length) for length, countries in (
    (15, "NO"), (16, "BE"), (18, "DK FI FK FO GL NL SD"), (19, "MK SI"), (20, "AT BA EE KZ LT LU MN XK"), (21, "CH HR LI LV"),
    (22, "BG BH CR DE GB GE IE ME RS VA"), (23, "AE GI IL IQ OM SO TL"), (24, "AD CZ ES MD PK RO SA SE SK TN VG"), (25, "LY PT ST"),
    (26, "IS TR"), (27, "BI DJ FR GR IT MC MR SM"), (28, "AL AZ BY CY DO GT HN HU LB NI PL SV"), (29, "BR EG PS QA UA"),
    (30, "JO KW MU YE"), (31, "MT SC"), (32, "LC"), (33, "RU")) for country in countries.split()}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
DIGIT = frozenset("0123456789")
PHONE = frozenset("0123456789 ().-")
IBAN_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
URL_STOPS = "\"'<>"
KEY = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")

Span = tuple[str, int, int]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in DIGIT:
        found.add_word(d, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for words, kind in ((SCHEMES, "scheme"), (SECRET_CUES, "cue"), (KEY_PREFIXES, "key")):
        for w in words:
            for form in {w, w.upper(), w.capitalize()} if kind != "key" else {w}:
                found.add_word(form, (kind, len(w)))
    found.make_automaton()
    return found


def _run(text: str, at: int, allowed: frozenset) -> int:
    """End of the run of allowed characters that starts at ``at``."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _ends(text: str, starts: Sequence[int], stops: str) -> Iterator[int]:
    """For ascending starts, where white space or a stop follows. Starts of one run share its end, so no run is walked twice."""
    end = -1
    for at in starts:
        if at > end:
            end = at
            while end < len(text) and not text[end].isspace() and text[end] not in stops:
                end += 1
        yield end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def _emails(text: str, anchors: list[int]) -> Iterator[Span]:
    done = 0
    for at in anchors:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        end = _run(text, at + 1, LABEL)
        if start == at or end == at + 1:
            continue
        labels = 0
        while end < len(text) and text[end] == ".":
            more = _run(text, end + 1, LABEL)
            if more == end + 1:
                break
            end, labels = more, labels + 1
        if labels:
            yield "email", start, end
            done = end


def _numbers(anchors: list[int]) -> list[tuple[int, int]]:
    """Digit positions as runs (start, end)."""
    runs: list[tuple[int, int]] = []
    start = last = -2
    for at in anchors:
        if at != last + 1:
            if start >= 0:
                runs.append((start, last + 1))
            start = at
        last = at
    if start >= 0:
        runs.append((start, last + 1))
    return runs


def _value_fits(digits: str) -> bool:
    plain = digits.lstrip("0")
    return len(plain) <= 3 and int(plain or "0") <= 255


def _ips(text: str, runs: list[tuple[int, int]]) -> Iterator[Span]:
    chain: list[tuple[int, int]] = []
    for run in runs:
        if chain and not (run[0] == chain[-1][1] + 1 and text[chain[-1][1]] == "."):
            chain = []
        chain.append(run)
        if len(chain) == 4:
            if all(_value_fits(text[a:b]) for a, b in chain):
                yield "ip", chain[0][0], chain[3][1]
            chain = []


def _cards(text: str, runs: list[tuple[int, int]]) -> Iterator[Span]:
    k = 0
    while k < len(runs):
        last = k
        while last + 1 < len(runs) and runs[last + 1][0] == runs[last][1] + 1 and text[runs[last][1]] in " -":
            last += 1
        digits = sum(b - a for a, b in runs[k:last + 1])
        start, end = runs[k][0], runs[last][1]
        if 14 <= digits <= 19 and luhn(re.sub("[ -]", "", text[start:end])):
            yield "card", start, end
        elif last > k:
            for a, b in runs[k:last + 1]:
                if 14 <= b - a <= 19 and luhn(text[a:b]):
                    yield "account", a, b
        k = last + 1


def _phones(text: str, anchors: list[int]) -> Iterator[Span]:
    for at in anchors:
        if at + 1 >= len(text) or text[at + 1] not in DIGIT:
            continue
        end = _run(text, at + 2, PHONE)
        while end > at + 3 and text[end - 1] not in DIGIT:
            end -= 1
        if end > at + 3 and 10 <= sum(c in DIGIT for c in text[at:end]) <= 15:
            yield "phone", at, end


def _iban_ends(text: str, start: int) -> list[int]:
    """Where an account number that starts at ``start`` may end, the longest first.

    Single blanks may lie between its signs. Of countries without a known length every end of a group counts.
    """
    wanted = IBAN_LENGTHS.get(text[start:start + 2])
    ends, signs, at = [], 4, start + 4
    while signs < (wanted or 34):
        if at + 1 < len(text) and text[at] == " " and text[at + 1] in IBAN_SIGNS:
            at += 1
        elif at >= len(text) or text[at] not in IBAN_SIGNS:
            break
        at, signs = at + 1, signs + 1
        if (signs == wanted or (not wanted and signs >= 15)) and (at == len(text) or not (text[at].isalnum() or text[at] == "_")):
            ends.append(at)
    return ends[::-1]


def _ibans(text: str, runs: list[tuple[int, int]]) -> Iterator[Span]:
    done = 0
    for a, b in runs:
        if b - a >= 2 and a - 2 >= done and re.fullmatch("[A-Z]{2}", text[a - 2:a]) and (a == 2 or text[a - 3] not in KEY):
            for end in _iban_ends(text, a - 2):
                plain = text[a - 2:end].replace(" ", "")
                if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                    yield "iban", a - 2, end
                    done = end
                    break


def spans(text: str, anchors: ahocorasick.Automaton) -> list[Span]:
    """All spans, by start and then by kind as listed in ``KINDS``."""
    found: dict[str, list[tuple[int, int]]] = {"digit": [], "at": [], "plus": [], "scheme": [], "cue": [], "key": []}
    for last, (kind, length) in anchors.iter(text):
        found[kind].append((last - length + 1, last + 1))
    starts = {k: [a for a, _ in v] for k, v in found.items()}
    runs = _numbers(starts["digit"])
    out = [*_emails(text, starts["at"]), *_ips(text, runs), *_cards(text, runs), *_phones(text, starts["plus"]),
           *_ibans(text, runs)]
    ends = _ends(text, [b for _, b in found["scheme"]], URL_STOPS)
    out += [("url", a, end) for (a, b), end in zip(found["scheme"], ends) if end > b]
    ends = _ends(text, [b for _, b in found["cue"]], "")
    out += [("secret", b, end) for (_, b), end in zip(found["cue"], ends) if end > b]
    for a, b in found["key"]:
        end = a + KEY_PREFIXES[text[a:b]]
        whole = end <= len(text) and (a == 0 or text[a - 1] not in KEY) and (end == len(text) or text[end] not in KEY)
        if whole and all(c in KEY for c in text[b:end]):
            out.append(("secret", a, end))
    return sorted(set(out), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find(docs: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``found``: an array of (kind, start, end) for every row."""
    given = docs.select(*keep, col(text_col).alias("_text_"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    schema = f"{fields}, found array<struct<kind: string, start: bigint, end: bigint>>"
    names = [*given.columns[:-1], "found"]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t.as_py() or "", anchors)] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], names=names)

    return small_batches(given).mapInArrow(run, schema)
