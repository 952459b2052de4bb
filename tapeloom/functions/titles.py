"""What a video's title and description say about it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .let import let
from .strings import strip

# Phrases looked for in the lowercase title, first match wins.
ALBUM_PHRASE = "album review"
TITLE_RULES: list[tuple[str, list[str]]] = [
    ("ep_review", ["ep review"]),
    ("track_review", ["track review"]),
    ("mixtape_review", ["mixtape review"]),
    ("yunoreview", ["yunoreview", "y u no review"]),
    ("weekly_track_roundup", ["weekly track roundup", "best & worst tracks"]),
    ("tnd_podcast", ["tnd podcast #"]),
    ("vinyl_update", ["vinyl update"]),
]
# Fixed value: a score out of ten, with the character before it.
SCORE_PATTERN = "[^0-9][0-9]{1,2}/10"


def is_album_review(title: Column) -> Column:
    return F.lower(title).contains(ALBUM_PHRASE)


def video_type(title: Column) -> Column:
    """One of nine types; an album review needs a dash between artist and album."""
    low = F.lower(title)
    rule = F.when(low.contains(ALBUM_PHRASE) & low.contains("-"), "album_review")
    for name, phrases in TITLE_RULES:
        hit = F.lit(False)
        for phrase in phrases:
            hit = hit | low.contains(phrase)
        rule = rule.when(hit, name)
    return F.when(title.isNotNull(), rule.otherwise("misc"))


def review_score(description: Column) -> Column:
    """The last score out of ten as an int, null when there is none.

    The character before the digits belongs to the number: white space and a
    plus sign are harmless, a minus sign negates, anything else spoils it.
    """
    found = F.regexp_extract_all(description, F.lit(SCORE_PATTERN), F.lit(0))

    def number(last: Column) -> Column:
        lead = F.substring(last, 1, 1)
        digits = F.regexp_extract(last, "([0-9]+)/10$", 1).try_cast("int")
        return F.when(lead == "-", -digits).when((lead == "+") | lead.rlike(r"^(?U)\s$"), digits)

    # Most descriptions have no score, and a substring test is cheaper than the pattern.
    scored = F.when(description.contains("/10"), F.try_element_at(found, F.lit(-1)))
    return let(scored, number)


def album_info(title: Column) -> Column:
    """``struct(artist, album_title)``, cut at the first dash before the phrase."""
    head = F.substring_index(F.lower(title), ALBUM_PHRASE, 1)
    dash = F.instr(head, "-")
    found = dash > 0
    artist = strip(F.substring_index(head, "-", 1))
    album = strip(F.substr(head, dash + 1))
    return F.struct(
        F.when(found, artist).alias("artist"),
        F.when(found, album).alias("album_title"),
    )
