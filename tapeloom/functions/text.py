"""Words, query strings, and size estimates of text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .let import let
from .strings import strip

# English words that the text index leaves out.
INDEX_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are
was were be been being have has had having do does did doing a an the and but if or because as until while
of at by for with about against between into through during before after above below to from up down in out
on off over under again further then once here there when where why how all any both each few more most
other some such no nor not only own same so than too very s t can will just don should now
""".split()
# Words that are dropped from a typed query besides those above.
QUERY_EXTRA_STOP_WORDS = """
you're you've you'll you'd she's it's that'll don't should've d ll m o re ve y ain aren aren't couldn
couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn
mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't like
""".split()
QUERY_STOP_WORDS = INDEX_STOP_WORDS + QUERY_EXTRA_STOP_WORDS

# Everything that is neither a letter nor a digit separates words.
WORD_BREAK = r"[^\p{L}\p{N}]+"

# The token estimate and the size limit of one text to embed.
CHARS_PER_TOKEN = 3.5
MAX_TOKENS = 7500
PREVIEW_CHARS = 50


def words(text: Column) -> Column:
    """Lowercase words in order; a word's index is its position in the text."""
    return split_lower(F.lower(text))


def split_lower(low: Column) -> Column:
    """`words` of a text that is lowercase already."""
    return F.filter(F.split(low, WORD_BREAK), lambda w: w != "")


def split_words(text: str) -> list[str]:
    """`words` for one typed query, on the driver."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def query_words(query: str) -> list[list[str]]:
    """Words of a typed query that are worth looking for.

    Each entry is one typed word; punctuation inside it makes it several parts
    that must stand side by side.
    """
    typed = [w for w in query.split() if w.lower() not in set(QUERY_STOP_WORDS)]
    stop = set(INDEX_STOP_WORDS)
    parts = [[p for p in split_words(w) if p not in stop] for w in typed]
    return [p for p in parts if p]


def phrase_words(query: str) -> list[tuple[int, str]]:
    """``(offset, word)`` of a phrase; stop words are dropped but keep their place."""
    stop = set(INDEX_STOP_WORDS)
    kept = [(i, w) for i, w in enumerate(split_words(query)) if w not in stop]
    return [(i - kept[0][0], w) for i, w in kept]


def or_query(text: Column, max_n: int = 3) -> Column:
    """Query string: every run of 1 to ``max_n`` kept words, runs joined by ``|``."""
    typed = F.filter(
        F.split(strip(text), r"(?U)\s+"),
        lambda w: (w != "") & ~F.lower(w).isin(*QUERY_STOP_WORDS),
    )
    empty = F.array().cast("array<string>")

    def runs(kept: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(kept) - (n - 1))
        joined = F.transform(starts, lambda i: F.array_join(F.slice(kept, i, n), " <-> "))
        return F.when(F.size(kept) >= n, joined).otherwise(empty)

    return let(typed, lambda kept: F.array_join(F.concat(*[runs(kept, n) for n in range(1, max_n + 1)]), " | "))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("int")


def truncate_for_embedding(text: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """Texts over the size limit are cut and marked with an ellipsis."""
    limit = int(max_tokens * CHARS_PER_TOKEN)
    cut = F.concat(F.substring(text, 1, limit), F.lit("..."))
    return F.when(token_estimate(text) > max_tokens, cut).otherwise(text)


def preview(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    """The start of a text for an error message."""
    return F.when(F.length(text) > chars, F.concat(F.left(text, F.lit(chars)), F.lit("..."))).otherwise(text)
