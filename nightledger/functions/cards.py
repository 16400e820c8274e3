"""Fixed-width header cards, laid out as the published FITS standard says for string values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CARD_WIDTH = 80
KEYWORD_WIDTH = 8
VALUE_WIDTH = 68


def _quoted(value: Column) -> Column:
    return F.replace(value, F.lit("'"), F.lit("''"))


def card_reason(keyword: Column, value: Column) -> Column:
    """Why a keyword and value make no card; null if they do."""
    return (
        F.when(F.length(keyword) > KEYWORD_WIDTH, "KEYWORD_TOO_LONG")
        .when(F.length(_quoted(value)) > VALUE_WIDTH, "VALUE_TOO_LONG")
        .when(keyword.isNull() | value.isNull(), "MISSING")
    )


def fits_card(keyword: Column, value: Column) -> Column:
    """An 80-character card, or null where ``card_reason`` names a reason. Nothing is ever cut off."""
    quoted = _quoted(value)
    padded = F.concat(quoted, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(KEYWORD_WIDTH) - F.length(quoted))))
    text = F.concat(F.rpad(keyword, KEYWORD_WIDTH, " "), F.lit("= '"), padded, F.lit("'"))
    return F.when(card_reason(keyword, value).isNull(), F.rpad(text, CARD_WIDTH, " "))
