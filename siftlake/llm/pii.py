"""Personal data by anchor expansion.

An Aho-Corasick automaton walks each whole text once and finds anchors: at-signs, plus signs,
digits, schemes and identifier cues. Deterministic local parsers then expand each anchor to its
boundaries and validate it.

Base kinds, leftmost and non-overlapping per kind; a match that fails validation is dropped and
its text not tried again:
  email  local part, at-sign, at least two labels
  ip     four dotted runs of digits, each at most 255
  card   digits with single spaces or hyphens between, 14 to 19 of them, Luhn sum right
  phone  plus sign and 10 to 15 digits with spaces, brackets, dots and hyphens
Kinds that the method adds, beside the base ones:
  url      a scheme in any case and the characters up to white space, quotes or angle brackets, without the punctuation that
           closes a sentence and without a closing bracket that nothing in it opens
  iban     after the cue "iban": country, check digits and account, as long as the country's accounts are; remainder 1
           modulo 97. Of other countries' accounts the longest end of a word that gives this remainder
  account  after the cue "account" or "acct": 6 to 20 digits, hyphens allowed
  secret   after "password", "token", "secret" or "api_key": the value after = or :

Spans are in code points, the end exclusive. One pass over the input, no shuffle.

Defined results: null and empty texts have no spans; very long texts are scanned as a whole, a text at a time; rows with
equal or null doc_id are scanned as rows of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.llm import common

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account", "secret")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:")
CUES = {"iban": "iban", "account": "account", "acct": "account", "password": "secret", "token": "secret", "secret": "secret", "api_key": "secret"}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE_BODY = re.compile(r"[\x20().0-9-]*[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_URL_BODY = re.compile(r"[^\s\"'<>]+")
_IBAN = re.compile(r"[^A-Za-z0-9]{0,5}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
#: Characters that close a sentence behind a URL, and brackets that close what stands around it.
_CLOSING, _BRACKETS = ".,;:!?", {")": "(", "]": "[", "}": "{"}
# Length of an international account number by country.
IBAN_LENGTHS = {
    code: int(group[:2])
    for group in (
        "15 NO", "16 BE", "18 DK FI FK FO GL NL SD", "19 MK SI", "20 AT BA EE KZ LT LU MN XK", "21 CH HR LI LV", "22 BG BH CR DE GB GE IE ME RS VA", "23 AE GI IL IQ OM SO TL",
        "24 AD CZ ES MD PK RO SA SE SK TN VG", "25 LY PT ST", "26 IS TR", "27 BI DJ FR GR IT MC MR SM", "28 AL AZ BY CY DO GT HN HU LB NI PL SV", "29 BR EG PS QA UA", "30 JO KW MU YE", "31 MT SC", "33 RU",
    )
    for code in group[3:].split()
}
_ACCOUNT = re.compile(r"(?: ?(?:no|number|nr)\b\.?)?[ :#=]{1,3}([0-9](?:-?[0-9]){5,19})(?![0-9])", re.IGNORECASE)
_SECRET = re.compile(r"[\"']? ?[=:] ?[\"']?([A-Za-z0-9+/_.-]{8,})")

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", SPAN)])


def any_case(word: str) -> Iterator[str]:
    """The word in every mix of cases: the text is walked as it stands, as its places are those of its own characters."""
    return map("".join, itertools.product(*({c.lower(), c.upper()} for c in word)))


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    for sign in "@+":
        found.add_word(sign, (sign, 1))
    for scheme in SCHEMES:
        for form in any_case(scheme):
            found.add_word(form, ("url", len(form)))
    for cue, kind in CUES.items():
        for form in any_case(cue):
            found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def iban_valid(code: str) -> bool:
    compact = code.replace(" ", "")
    turned = compact[4:] + compact[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def iban_end(text: str, start: int, stop: int) -> int | None:
    """Where the account number that starts at `start` ends, at most at `stop`; None where none is valid."""
    ends = [at + 1 for at in range(start, stop) if text[at] != " "]  # after each of its characters
    length = IBAN_LENGTHS.get(text[start : start + 2])
    for n in [length] if length else range(min(34, len(ends)), 14, -1):
        if n <= len(ends) and not text[ends[n - 1] : ends[n - 1] + 1].isalnum() and iban_valid(text[start : ends[n - 1]]):
            return ends[n - 1]
    return None


def url_end(text: str, start: int, stop: int) -> int:
    """The end of a URL without what closes the sentence or the brackets around it."""
    while stop > start:
        last = text[stop - 1]
        if last not in _CLOSING and (last not in _BRACKETS or text.count(last, start, stop) <= text.count(_BRACKETS[last], start, stop)):
            break
        stop -= 1
    return stop


def _emails(text: str, ats: list[int]) -> Iterator[tuple[int, int]]:
    taken = 0
    for at in ats:
        start = at
        while start > taken and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            taken = domain.end()
            yield start, taken


def _digit_runs(places: list[int]) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    begin = last = places[0]
    for place in places[1:]:
        if place != last + 1:
            runs.append((begin, last + 1))
            begin = place
        last = place
    runs.append((begin, last + 1))
    return runs


def _addresses(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    i = 0
    while i + 3 < len(runs):
        four = runs[i : i + 4]
        if all(b[0] == a[1] + 1 and text[a[1]] == "." for a, b in zip(four, four[1:])):
            parts = [text[start:stop].lstrip("0") for start, stop in four]
            if all(len(part) <= 3 and int(part or 0) <= 255 for part in parts):
                yield four[0][0], four[3][1]
            i += 4
        else:
            i += 1


def _cards(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(runs):
        j, count = i, runs[i][1] - runs[i][0]
        while j + 1 < len(runs) and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] in " -":
            j += 1
            count += runs[j][1] - runs[j][0]
        if 14 <= count <= 19:
            start, stop = runs[i][0], runs[j][1]
            if luhn(_NOT_DIGIT.sub("", text[start:stop])):
                yield start, stop
        i = j + 1


def _phones(text: str, pluses: list[int]) -> Iterator[tuple[int, int]]:
    for plus in pluses:
        if text[plus + 1 : plus + 2] in tuple("0123456789") and (body := _PHONE_BODY.match(text, plus + 2)) and body.end() >= plus + 4:
            digits = _NOT_DIGIT.sub("", text[plus : body.end()])
            if 10 <= len(digits) <= 15:
                yield plus, body.end()


def find(text: str, found) -> list[tuple[str, int, int]]:
    """All spans as (kind, start, stop), by start, then kind in the order of KINDS."""
    ats, pluses, digits, cues = [], [], [], []
    for end, (what, length) in found.iter(text):
        if what == "digit":
            digits.append(end)
        elif what == "@":
            ats.append(end)
        elif what == "+":
            pluses.append(end)
        else:
            cues.append((what, end + 1 - length, end + 1))
    spans = [("email", *span) for span in _emails(text, ats)] + [("phone", *span) for span in _phones(text, pluses)]
    if digits:
        runs = _digit_runs(digits)
        spans += [("ip", *span) for span in _addresses(text, runs)] + [("card", *span) for span in _cards(text, runs)]
    taken: dict[str, int] = {}
    for kind, start, stop in cues:
        if start < taken.get(kind, 0):
            continue
        if kind == "url":
            if (body := _URL_BODY.match(text, stop)) and (end := url_end(text, stop, body.end())) > stop:
                taken[kind] = end
                spans.append((kind, start, end))
            continue
        value = {"iban": _IBAN, "account": _ACCOUNT, "secret": _SECRET}[kind].match(text, stop)
        end = value and (iban_end(text, *value.span(1)) if kind == "iban" else value.end(1))
        if end:
            taken[kind] = end
            spans.append((kind, value.start(1), end))
    return sorted(set(spans), key=lambda span: (span[1], KINDS.index(span[0]), span[2]))


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id and the spans found in each whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = automaton()
        for batch in batches:
            if not len(batch):
                continue
            spans = [[{"kind": k, "start": s, "stop": e} for k, s, e in find(text, found)] for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "spans": spans})

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_or_empty(docs).alias("text")).mapInPandas(run, SCHEMA)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find_spans(common.documents(spark, sf_dir))
    joined = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return spans.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
