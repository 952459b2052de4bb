"""Secrets: strong patterns, and weak parts that count only next to their complement.

1. Base spans (assignments, access keys, long hex runs) are expressions over one
   row and are always reported.
2. Weak parts are identifiers (``user=``, ``client_id:``), random-looking keys and
   endpoints (addresses with a scheme).  On its own none is a finding.
3. Linking: parts of a text are rows; an interval join on the text and a bin of
   code points finds whether a complement lies within ``SCOPE`` code points: a key
   next to an identifier or an endpoint, and the reverse.  Base spans take part
   as strong identifiers and keys.  Only then is a weak part reported, as kind
   ``id``, ``key`` or ``endpoint``.

The join is a pair of semi joins with the range as residual, so it puts out each
part at most once however many complements are near.  Only texts that hold weak
parts on both sides reach it.

Defined results: a null text counts as empty; a text without spans gives zeros, an
empty ``spans`` and the digest of the empty string.  Equal texts have equal spans,
so rows are keyed by the digest of their text and repeated rows, repeated ids and
null ids need no care.  An empty table gives an empty result.  Only id and text
are read; names of other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import to_scratch
from .common import text_or_empty
from .spans import count_of, digest, listed, matches

# Patterns of the base spans.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
BASE = ["assign", "access", "hex"]
# Patterns of the weak parts.
ID = r"""(?i:user(?:name)?|login|account|client_?id|access_?id)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9@._-]{3,}+"""
KEY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}+"
ENDPOINT = r"""(?i:https?|ftp|ssh|amqp|redis|mysql|mongodb|postgres(?:ql)?|jdbc:[a-z0-9]{1,20})://[^\x20\x09-\x0D"'<>]+"""
WEAK = ["id", "key", "endpoint"]
SCOPE = 200

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def _spans(kind: str, pattern: str, text: Column, keep=None) -> Column:
    found = matches(text, pattern)
    found = found if keep is None else F.filter(found, keep)
    return F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"], s["end"]))


def _looks_random(span: Column) -> Column:
    hit = span["hit"]
    return hit.rlike("[0-9]") & hit.rlike("[a-z]") & hit.rlike("[A-Z]")


def with_parts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``_s_base`` and ``_s_weak``."""
    df = docs.withColumn("_s_text", text_or_empty(text_col))
    text, none = F.col("_s_text"), F.array().cast(SPANS)
    long_value = lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN_VALUE, 1)) >= 12
    sign = text.contains(":") | text.contains("=")
    found = {
        "assign": F.when(sign, _spans("assign", ASSIGN, text, long_value)),
        "access": F.when(text.contains("AKIA"), _spans("access", ACCESS, text)),
        "hex": _spans("hex", HEX, text),
        "id": F.when(sign, _spans("id", ID, text)),
        "key": _spans("key", KEY, text, _looks_random),
        "endpoint": F.when(text.contains("://"), _spans("endpoint", ENDPOINT, text)),
    }
    df = df.withColumns({f"_s_{k}": F.coalesce(v, none) for k, v in found.items()}).drop("_s_text")
    df = df.withColumn("_s_base", F.concat(*[F.col(f"_s_{k}") for k in BASE]))
    df = df.withColumn("_s_weak", F.concat(*[F.col(f"_s_{k}") for k in WEAK]))
    return df.drop(*[f"_s_{k}" for k in found])


def _in_order(spans: Column) -> Column:
    """By start, then by the order of the kinds."""
    kinds = F.array(*[F.lit(k) for k in [*BASE, *WEAK]])
    keyed = F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("no"), s["end"].alias("end"), s["kind"].alias("kind"))
    )
    return F.transform(F.sort_array(keyed), lambda s: F.struct(s["kind"], s["start"], s["end"])).cast(SPANS)


def _binned(parts: DataFrame, margin: int) -> DataFrame:
    """A row for each bin of ``SCOPE`` code points that a part, widened by ``margin``, touches."""
    bins = F.sequence(F.floor((F.col("start") - margin) / SCOPE), F.floor((F.col("end") + margin) / SCOPE))
    return parts.withColumn("bin", F.explode(bins))


def _near(parts: DataFrame, others: DataFrame) -> DataFrame:
    """Parts that have one of the others within the scope of the same text."""
    a, b = _binned(parts, SCOPE).alias("a"), _binned(others, 0).alias("b")
    close = (
        (F.col("a.digest") == F.col("b.digest"))
        & (F.col("a.bin") == F.col("b.bin"))
        & (F.col("a.start") <= F.col("b.end") + SCOPE)
        & (F.col("b.start") <= F.col("a.end") + SCOPE)
    )
    return a.join(b, close, "left_semi").drop("bin")


def _both_sides() -> Column:
    """Whether a text has a weak part and parts of both sides, so that something may link."""
    has = lambda spans, *kinds: F.exists(spans, lambda s: s["kind"].isin(*kinds))
    both = has(F.col("base"), "assign", "hex") | has(F.col("weak"), "key")
    return (F.size("weak") > 0) & both & (has(F.col("base"), "access") | has(F.col("weak"), "id", "endpoint"))


def linked(rows: DataFrame) -> DataFrame:
    """``(digest, spans)``: weak parts near a complement, for texts that have any."""
    parts = rows.dropDuplicates(["digest"])
    parts = parts.select("digest", F.explode(F.concat("base", "weak")).alias("s")).select("digest", "s.*")
    key = F.col("kind").isin("assign", "hex", "key")
    found = _near(parts.where(F.col("kind") == "key"), parts.where(~key)).unionByName(
        _near(parts.where(F.col("kind").isin("id", "endpoint")), parts.where(key))
    )
    return found.groupBy("digest").agg(F.collect_set(F.struct("kind", "start", "end")).alias("found"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts, digest of the base spans, all spans."""
    df = with_parts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    rows = df.select(
        "id", F.when(F.size("_s_weak") > 0, digest(text_or_empty())).alias("digest"), F.col("_s_base").alias("base"),
        F.col("_s_weak").alias("weak"),
    )
    rows = to_scratch(rows.withColumn("open", _both_sides()), "secret-parts")
    # Texts in which nothing can link never meet the join.
    open_ = rows.where("open")
    none = F.lit(None).cast("array<struct<kind:string,start:bigint,end:bigint>>")
    rows = rows.where("NOT open").withColumn("found", none).unionByName(open_.join(linked(open_), "digest", "left"))
    added = F.coalesce(F.col("found"), F.array().cast(SPANS))
    base, spans = _in_order(F.col("base")), _in_order(F.concat("base", added))
    return rows.select(
        F.col("id").alias(id_col),
        *[count_of(F.col("base"), k).alias(f"n_{k}") for k in BASE],
        digest(listed(base)).alias("base_sha256"),
        listed(spans).alias("spans"),
        *[count_of(added, k).alias(f"n_{k}") for k in WEAK],
    )
