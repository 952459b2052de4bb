"""Quality rules: repetition within a text, and divergence of a text from its language.

Everything is an expression over one row; only the language references are an
aggregate, and they join back as one short row per language.

Base rules count words, symbols, repeated lines and repeated five-word windows.
The verdict compares two histograms of the text with those of its language by
Jensen-Shannon distance (square root of the divergence in bits, 0 to 1):
character classes, and common words.  A language's reference is the mean
histogram over all of its texts that are long enough; texts below the length
guards are not judged by the histogram in question.

Defined results: a null text counts as empty (no words, base rule fails).  A null
language is a language of its own.  A histogram without any count, and a
language without a long enough text, give no distance and so no objection.
Repeated rows are judged alike; an empty table gives an empty result.  Whole
rows travel inside one struct, so names of other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import to_scratch
from .common import SPACES, field, packed, text_or_empty, unpacked, words_of

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
CHARS_GUARD = 200  # code points in words
COMMON_GUARD = 120  # words
CHARS_LIMIT = 0.33
COMMON_LIMIT = 0.27

# Frequent words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "que"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se"],
}
BINS = sorted({w for words in COMMON_WORDS.values() for w in words})


def _without(text: Column, characters: str) -> Column:
    return F.regexp_replace(text, f"[{characters}]+", "")


def with_histograms(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds words and the two histograms as arrays of counts."""
    # Each class is removed from what the classes before it left, so all but the first read little text.
    rest = {"whole": text_or_empty(text_col)}
    classes = {"lower": "a-z", "space": r"\x20\x09-\x0D", "symbol": "#*$%&|<>", "upper": "A-Z", "digit": "0-9",
               "mark": r"\x00-\x7F"}
    df, last = docs.withColumn("_q_whole", rest["whole"]), "_q_whole"
    for name, characters in classes.items():
        df = df.withColumn(f"_q_{name}", _without(F.col(last), characters))
        last = f"_q_{name}"
    names = ["whole", *classes]
    lengths = {n: F.length(f"_q_{n}") for n in names}
    counts = {b: lengths[a] - lengths[b] for a, b in zip(names, names[1:])} | {"other": lengths["mark"]}
    word_bins = F.array_join(F.filter("_q_lowered", lambda w: w.isin(BINS)), "  ")
    return (
        df.withColumn("_q_chars", F.array(*[counts[n].cast("double") for n in counts if n != "space"]))
        .withColumn("_q_n_symbols", counts["symbol"].cast("long"))
        .withColumn("_q_word_chars", (lengths["whole"] - counts["space"]).cast("long"))
        .withColumn("_q_words", words_of(F.col("_q_whole")))
        .drop(*[f"_q_{n}" for n in classes])
        .withColumn("_q_n_words", F.size("_q_words").cast("long"))
        .withColumn("_q_lowered", words_of(F.lower("_q_whole")))
        .withColumn("_q_common", F.concat(F.lit(" "), word_bins, F.lit(" ")))
        .drop("_q_lowered")
        .withColumn("_q_bins", F.array(*[_occurrences(F.col("_q_common"), w) for w in BINS]))
        .withColumn("_q_bins", _with_rest(F.col("_q_bins"), F.col("_q_n_words").cast("double")))
        .drop("_q_common")
    )


def _occurrences(spaced: Column, word: str) -> Column:
    """How often ``word`` stands in words that two blanks separate."""
    padded = f" {word} "
    return (F.length(spaced) - F.length(F.replace(spaced, F.lit(padded), F.lit("")))).cast("double") / len(padded)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _with_rest(bins: Column, total: Column) -> Column:
    return F.concat(bins, F.array(total - _sum(bins)))


def _shares(counts: Column) -> Column:
    """Shares of a histogram; null without any count."""
    return F.when(_sum(counts) > 0, F.transform(counts, lambda x: x / _sum(counts)))


def references(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """Mean histograms of each language over its texts that pass the guards."""
    df = with_histograms(docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")))
    shares = {
        "chars": (F.when(F.col("_q_word_chars") >= CHARS_GUARD, _shares(F.col("_q_chars"))), 6),
        "bins": (F.when(F.col("_q_n_words") >= COMMON_GUARD, _shares(F.col("_q_bins"))), len(BINS) + 1),
    }
    df = df.select("lang", *[s.alias(n) for n, (s, _) in shares.items()])
    means = {n: F.array(*[F.avg(F.get(F.col(n), F.lit(i))) for i in range(size)]) for n, (_, size) in shares.items()}
    return df.groupBy("lang").agg(*[m.alias(f"_q_ref_{n}") for n, m in means.items()])


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two lists of shares."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    both = _sum(F.zip_with(p, q, part)) + _sum(F.zip_with(q, p, part))
    return F.sqrt(F.greatest(both / 2, F.lit(0.0)))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window which stands twice or more in the text.

    Windows are compared by a 64-bit hash chained over their words.
    """
    spots = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.transform(spots, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))


def covered(hashes: Column, sorted_hashes: Column) -> Column:
    """How many words the repeated windows cover, from ``(hash, spot)`` in order."""

    def again(x: Column, i: Column) -> Column:
        before, after = F.get(sorted_hashes, i - 1), F.get(sorted_hashes, i + 1)
        return F.coalesce(x["h"] == before["h"], F.lit(False)) | F.coalesce(x["h"] == after["h"], F.lit(False))

    spots = F.sort_array(F.transform(F.filter(sorted_hashes, again), lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"))
    return F.aggregate(spots, start, step, lambda acc: acc["n"])


def with_verdict(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Adds ``_q_result``: the counts, distances and verdicts of each row."""
    known = to_scratch(references(docs, text_col, lang_col), "language-references")
    known = known.withColumnRenamed("lang", "_q_lang")
    df = with_histograms(docs, text_col)
    with_word = F.filter(F.split("_q_whole", "\n", -1), lambda x: x.rlike(f"[^{SPACES[1:]}"))
    df = df.withColumn("_q_lines", with_word).withColumn("_q_hashes", repeated_words(F.col("_q_words")))
    repeats = F.size(F.array_distinct("_q_hashes")) < F.size("_q_hashes")
    pairs = F.sort_array(F.transform("_q_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_q_sorted", F.when(repeats, pairs))
    df = df.withColumn(
        "_q_n_repeat",
        F.when(F.col("_q_sorted").isNotNull(), covered(F.col("_q_hashes"), F.col("_q_sorted"))).otherwise(0),
    )
    n_dup_lines = F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))
    df = df.withColumn("_q_n_dup_lines", n_dup_lines).drop("_q_lines", "_q_hashes", "_q_sorted", "_q_words", "_q_whole")

    df = df.join(known, F.col(lang_col).eqNullSafe(F.col("_q_lang")), "left")
    chars = F.when(F.col("_q_word_chars") >= CHARS_GUARD, distance(_shares(F.col("_q_chars")), F.col("_q_ref_chars")))
    bins = F.when(F.col("_q_n_words") >= COMMON_GUARD, distance(_shares(F.col("_q_bins")), F.col("_q_ref_bins")))
    n_words = F.col("_q_n_words")
    failed = (n_words < MIN_WORDS) | (100 * F.col("_q_n_repeat") > MAX_REPEAT_PERCENT * n_words)
    df = df.withColumn("_q_d_chars", chars).withColumn("_q_d_bins", bins)
    normal = (F.coalesce("_q_d_chars", F.lit(0.0)) <= CHARS_LIMIT) & (
        F.coalesce("_q_d_bins", F.lit(0.0)) <= COMMON_LIMIT
    )
    result = F.struct(
        n_words.alias("n_words"),
        F.col("_q_word_chars").alias("word_chars"),
        F.col("_q_n_symbols").alias("n_symbols"),
        F.col("_q_n_dup_lines").cast("long").alias("n_dup_lines"),
        F.col("_q_n_repeat").cast("long").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & normal).alias("kept"),
        F.round("_q_d_chars", 4).alias("chars_distance"),
        F.round("_q_d_bins", 4).alias("common_distance"),
    )
    # A filter on the result must not be pushed through the projections below: it would repeat their
    # expressions many times over.  It stays above a generator whose output it reads.
    return df.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode_outer(F.array(result)).alias("_q_result"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, the base counts, ``base_failed``, ``kept`` and the two distances."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return with_verdict(narrow).select(F.col("id").alias(id_col), "_q_result.*")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that are kept, with all their columns."""
    judged = with_verdict(packed(docs), field(docs, text_col), field(docs, lang_col))
    return unpacked(judged.where("_q_result.kept"), docs)
