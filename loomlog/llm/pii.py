"""Personal data by anchor expansion.

One Aho-Corasick automaton finds cues (at-signs, schemes, plus signs, digits, account words); at each
cue a deterministic local parser expands to the left and right, bounds the candidate and validates it.
Work is linear in the text: a parser never looks again at what a longer candidate has consumed.

Kinds: ``email``, ``ip``, ``card``, ``phone`` follow the base patterns exactly. Added by the method:
``url_user`` (credentials before the host of a scheme), ``iban`` (cut to the length of its country,
modulo 97) and ``account`` (a number of 6 to 17 digits behind an account cue).

Cases: null and empty texts have no spans; a null doc_id is kept; repeated rows give repeated rows; an
empty table gives an empty result; other columns of the input are ignored by ``find_pii`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url_user", "iban", "account")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]++")
_IBAN = re.compile(r"([A-Z]{2})[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_LETTER = re.compile(r" ?[A-Z0-9]")
_GAP = re.compile(r":? ?")
_USERINFO = re.compile(r"[^\s/?#@]++@")
_ACCOUNT = re.compile(r"(?:s|t)?(?: ?(?:no|number|nr|num)\b\.?)? ?[:#=]? ?([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.I)
#: Length of an IBAN by country, from the IBAN registry.
IBAN_LENGTHS = {
    country: length
    for length, countries in (
        (15, "NO"),
        (16, "BE"),
        (18, "DK FI FK FO GL NL SD"),
        (19, "MK SI"),
        (20, "AT BA EE KZ LT LU MN XK"),
        (21, "CH HR LI LV"),
        (22, "BG BH CR DE GB GE IE ME RS VA"),
        (23, "AE GI IL IQ OM SO TL"),
        (24, "AD CZ ES MD PK RO SA SE SK TN VG"),
        (25, "LY PT ST"),
        (26, "IS TR"),
        (27, "BI DJ FR GR IT MC MR SM"),
        (28, "AL AZ BY CY DO GT HN HU LB NI PL SV"),
        (29, "BR EG PS QA UA"),
        (30, "JO KW MU YE"),
        (31, "MT SC"),
        (32, "LC"),
        (33, "RU"),
    )
    for country in countries.split()
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ACCOUNT_CUES = ("account", "Account", "ACCOUNT", "acct", "Acct", "Konto", "konto", "compte", "cuenta")
_IBAN_CUES = ("IBAN", "iban")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for cue, kind in [("@", "at"), ("+", "plus"), ("://", "scheme"), *((str(d), "digit") for d in range(10)), *((c, "account") for c in _ACCOUNT_CUES), *((c, "iban") for c in _IBAN_CUES)]:
        a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


class Finder:
    def __init__(self) -> None:
        self.cues = _automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """All spans, by kind in the order of ``KINDS`` and then by start; ends are exclusive."""
        found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        email_end = ip_seen = card_seen = phone_seen = account_seen = 0
        for last, (cue, length) in self.cues.iter(text):
            at = last - length + 1
            if cue == "digit":
                if at >= card_seen:
                    m = _CARD.match(text, at)
                    if m:
                        card_seen = m.end()
                        digits = m[0].replace(" ", "").replace("-", "")
                        if 16 <= len(digits) <= 19 and luhn(digits):
                            found["card"].append(m.span())
                    else:
                        card_seen = at + 1
                if at >= ip_seen:
                    m = _IP.match(text, at)
                    if m:
                        ip_seen = m.end()
                        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                            found["ip"].append(m.span())
                    else:
                        ip_seen = _DIGITS.match(text, at).end()
            elif cue == "at":
                start = at
                while start > email_end and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at + 1)):
                    found["email"].append((start, m.end()))
                    email_end = m.end()
            elif cue == "plus":
                if at >= phone_seen and (m := _PHONE.match(text, at)):
                    phone_seen = m.end()
                    if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                        found["phone"].append(m.span())
            elif cue == "scheme":
                if m := _USERINFO.match(text, last + 1):
                    found["url_user"].append((last + 1, m.end() - 1))
            elif cue == "account":
                if at >= account_seen and (m := _ACCOUNT.match(text, last + 1)):
                    found["account"].append(m.span(1))
                    account_seen = m.end()
            elif (m := _IBAN.match(text, _GAP.match(text, last + 1).end())) and (end := iban_end(m)):
                found["iban"].append((m.start(), end))
        return [(k, *s) for k in KINDS for s in found[k]]


def iban_end(m: re.Match) -> int | None:
    """Where the IBAN that ``m`` begins with ends; None where there is none. A country without a length takes all of ``m``."""
    letters = [x.end() for x in _LETTER.finditer(m[0])]
    length = IBAN_LENGTHS.get(m[1], len(letters))
    return m.start() + letters[length - 1] if length <= len(letters) and iban_valid(m[0][: letters[length - 1]]) else None


def iban_valid(value: str) -> bool:
    value = value.replace(" ", "")
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id and ``spans``, an array of (kind, start, end) in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            spans = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in finder.spans(t.as_py() or "")] for t in b.column(1)], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), spans], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each stretch covered by spans becomes the name of its first kind in angle brackets."""
    out, at = [], 0
    merged: list[list] = []
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(e, merged[-1][2])
        else:
            merged.append([k, s, e])
    for k, s, e in merged:
        out += [text[at:s], f"<{k}>"]
        at = e
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the personal data in its text replaced; null texts stay null, all columns keep their names and order."""

    @F.pandas_udf("string")
    def replaced(texts):
        finder = Finder()
        return texts.map(lambda t: None if t is None else redact_text(t, finder.spans(t)))

    return docs.withColumn(text, replaced(F.col(text).cast("string")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(common.documents(spark, sf_dir))
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *(of(k) for k in BASE_KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def brute_force(text: str | None) -> dict:
    """The base patterns as the contract writes them; only for tests."""
    text = text or ""
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits) if digits else False, "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return {"spans": out, "sha": hashlib.sha256(join_spans(out).encode()).hexdigest()}
