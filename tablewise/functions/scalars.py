"""Column expressions for checks and defaults on single rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
NO_IMAGE = "https://example.com/default_image.jpg"
NO_PAGE_IMAGE = "https://t3.ftcdn.net/jpg/03/24/73/92/360_F_324739203_keeq8udvv0P2h1MLYJ0GLSlTBagoXS48.jpg"
IMAGE_URL_PARTS = ("https", "googleusercontent")
MISSING_FIELD = "Missing gmap_id or rating"
OUT_OF_RANGE = "Rating must be between 0 and 5"
NOT_A_NUMBER = "Invalid rating value. Rating must be a number."
INTEGER_TEXT = r"^\s*[+-]?[0-9]+\s*$"
DIGITS_ONLY = r"^[0-9]+$"
LOWEST_RATING, HIGHEST_RATING = 1, 5

# an attribute's value in quotes is passed over whole, so nothing inside one looks like ``src``; runs are
# possessive, since the engine would otherwise take a level of its stack for every character of a tag
IMG_SRC = (
    r"""(?i)<img\b(?:[^>"'\s]++|"[^"]*+"|'[^']*+'|\s++(?!src\s*=))*+"""
    r"""\s++src\s*=\s*("[^"]*+"|'[^']*+'|[^\s"'>]+)"""
)
LINK_HREF = r"""href="([^"]*)\""""


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rating_value(text: Column | str) -> Column:
    """The rating as int when the text is a valid one, else null."""
    text = col_of(text)
    number = F.when(text.rlike(INTEGER_TEXT), F.trim(text).try_cast("int"))
    return F.when(number.between(LOWEST_RATING, HIGHEST_RATING), number)


def rating_problem(item: Column | str, text: Column | str) -> Column:
    """Why a rating is not accepted, null when it is."""
    item, text = col_of(item), col_of(text)
    absent = item.isNull() | (item == "") | text.isNull() | (text == "")
    return (
        F.when(absent, MISSING_FIELD)
        .when(~text.rlike(INTEGER_TEXT), NOT_A_NUMBER)
        .when(rating_value(text).isNull(), OUT_OF_RANGE)
    )


def valid_user_id(user_id: Column | str) -> Column:
    return F.coalesce(col_of(user_id).rlike(DIGITS_ONLY), F.lit(False))


def not_blank(text: Column | str) -> Column:
    return F.length(F.trim(col_of(text))) > 0


def filled(c: Column | str, default) -> Column:
    """The value, or the default when it is missing."""
    return F.coalesce(col_of(c), F.lit(default))


def now_millis() -> Column:
    return F.unix_millis(F.current_timestamp())


def first_matching_url(
    html: Column | str, substrings: Sequence[str], default: str | None, pattern: str = IMG_SRC
) -> Column:
    """First url of a whole page that holds all ``substrings``, else the default.

    Quotes around a url are taken off, and ``&amp;`` is read as ``&``.
    """
    found = F.regexp_extract_all(col_of(html), F.lit(pattern), 1)
    urls = F.transform(found, lambda u: F.replace(F.btrim(u, F.lit("\"'")), F.lit("&amp;"), F.lit("&")))

    def holds_all(url: Column) -> Column:
        test = F.lit(True)
        for part in substrings:
            test = test & F.contains(url, F.lit(part))
        return test

    return F.coalesce(F.try_element_at(F.filter(urls, holds_all), F.lit(1)), F.lit(default))


def edits_by_item(edits: Column) -> tuple[Column, Column]:
    """The entries that edits put, by item, and the items they delete."""
    puts = F.filter(edits, lambda e: e["op"] != "delete")
    by_item = F.map_from_entries(F.transform(puts, lambda e: F.struct(e["gmap_id"], e["entry"])))
    return by_item, F.transform(F.filter(edits, lambda e: e["op"] == "delete"), lambda e: e["gmap_id"])


def edited_entries(ratings: Column, edits: Column, by_item: Column, gone: Column, chunk: Column) -> Column:
    """Nested array edit: entries replaced where they stand, removed, or appended in the last chunk.

    An edit has ``gmap_id, op, entry``, whether some chunk has ``held`` the item, and the ``last``
    chunk; without edits the array stays. ``by_item`` and ``gone`` are the edits' ``edits_by_item``, as columns,
    since what stands within a lambda is made again for every entry.
    """
    puts = F.filter(edits, lambda e: e["op"] != "delete")
    kept = F.filter(ratings, lambda r: ~F.coalesce(F.array_contains(gone, r["gmap_id"]), F.lit(False)))
    replaced = F.transform(kept, lambda r: F.coalesce(F.try_element_at(by_item, r["gmap_id"]), r))
    fresh = F.transform(F.filter(puts, lambda e: ~e["held"] & (e["last"] == chunk)), lambda e: e["entry"])
    return F.when(edits.isNull(), ratings).otherwise(F.concat(replaced, fresh))
