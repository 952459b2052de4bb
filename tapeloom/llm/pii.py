"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

All of it is built-in functions over one row; the scan needs no shuffle.

Base spans are e-mail addresses, IP addresses, payment cards (Luhn) and phone
numbers; they are always reported.  The method adds account numbers in IBAN
form, confirmed by the remainder of 97, and US social security numbers, which
have no checksum and are reported only when their score, with a context word
nearby, reaches ``MIN_SCORE``.  A span's score is that of its kind, plus a bonus
if one of its kind's words stands within 48 code points and before the next
match of its kind, less a discount if a word for samples does.

Patterns are written so that each text is read in linear time: a look-behind
replaces the tries inside a run that fails, and possessive repeats those that
cannot succeed.

Defined results: a null text counts as empty; a text without spans gives counts
of zero, an empty ``spans`` and the digest of the empty string.  Repeated rows are
judged alike; an empty table gives an empty result; only the id and the text are
read, so other columns and their names do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import text_or_empty
from .spans import count_of, digest, listed, matches

# Patterns of the base spans.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Patterns of the added spans.
IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"

BASE = ["email", "ip", "card", "phone"]
ADDED = ["iban", "ssn"]
# Score of a confirmed span, words that raise it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "address|host|server|client|login",
    "card": "card|visa|credit|debit|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|taxpayer",
}
SAMPLE_WORDS = "example|sample|dummy|version"
BONUS, DISCOUNT = 0.2, 0.2
MIN_SCORE = 0.5


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    backwards = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: _luhn_digit(backwards, i))
    return F.aggregate(each, F.lit(0), lambda total, x: total + x) % 10 == 0


def _luhn_digit(backwards: Column, i: Column) -> Column:
    digit = F.substr(backwards, i, F.lit(1)).cast("int")
    doubled = 2 * digit
    return F.when(i % 2 == 1, digit).when(doubled > 9, doubled - 9).otherwise(doubled)


def passes_mod97(hit: Column) -> Column:
    """Remainder 1 after the first four characters moved to the end and letters became numbers."""
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    code = F.transform(
        F.sequence(F.lit(1), F.length(turned)), lambda i: F.conv(F.substr(turned, i, F.lit(1)), 36, 10).cast("int")
    )
    return F.aggregate(code, F.lit(0), lambda r, c: (F.when(c > 9, r * 100).otherwise(r * 10) + c) % 97) == 1


def _valid(kind: str, span: Column) -> Column:
    hit = span["hit"]
    if kind == "ip":
        return hit.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        n = F.length(digits_of(hit))
        return n.between(16, 19) & passes_luhn(digits_of(hit))
    if kind == "phone":
        return F.length(digits_of(hit)).between(8, 15)
    if kind == "iban":
        return F.length(F.replace(hit, F.lit(" "), F.lit(""))).between(15, 34) & passes_mod97(hit)
    if kind == "ssn":
        clear = ~F.right(span["before"], F.lit(1)).rlike("[0-9-]") & ~F.left(span["after"], F.lit(1)).rlike("[0-9-]")
        return clear & ~hit.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _score(kind: str, span: Column) -> Column:
    near = F.lower(F.concat_ws(" ", span["before"], span["after"]))
    bonus = F.when(near.rlike(CONTEXT[kind]), BONUS).otherwise(0.0)
    return F.round(SCORES[kind] + bonus - F.when(near.rlike(SAMPLE_WORDS), DISCOUNT).otherwise(0.0), 2)


def find(kind: str, pattern: str, text: Column) -> Column:
    """Confirmed spans of one kind as ``array<struct<kind, start, end, score>>``."""
    confirmed = F.filter(matches(text, pattern), lambda s: _valid(kind, s))
    return F.transform(
        confirmed, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"], s["end"], _score(kind, s).alias("score"))
    )


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``_p_base`` and ``_p_spans``, spans in the order of their kinds, then by start."""
    df = docs.withColumn("_p_text", text_or_empty(text_col))
    text, none = F.col("_p_text"), F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    # Cheap tests first; most texts hold none of these characters.
    digit = text.rlike("[0-9]")
    tests = {"email": text.contains("@"), "phone": text.contains("+"), "ip": digit, "card": digit, "iban": digit, "ssn": digit}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN}
    df = df.withColumns(
        {f"_p_{k}": F.when(tests[k], find(k, patterns[k], text)).otherwise(none) for k in patterns}
    ).drop("_p_text")
    strong = [F.filter(F.col(f"_p_{k}"), lambda s: s["score"] >= MIN_SCORE) for k in ADDED]
    df = df.withColumn("_p_base", F.concat(*[F.col(f"_p_{k}") for k in BASE]))
    return df.withColumn("_p_spans", F.concat("_p_base", *strong)).drop(*[f"_p_{k}" for k in patterns])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts, digest of the base spans, all spans and their scores."""
    df = with_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    spans = F.col("_p_spans")
    return df.select(
        F.col("id").alias(id_col),
        *[count_of(F.col("_p_base"), k).alias(f"n_{k}") for k in BASE],
        digest(listed(F.col("_p_base"))).alias("base_sha256"),
        listed(spans).alias("spans"),
        *[count_of(spans, k).alias(f"n_{k}") for k in ADDED],
        F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
