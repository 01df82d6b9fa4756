"""String helpers for rendered text (fragments, capitalisation, word counts)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def fragments(sep: str, parts: Sequence[Column], default: str | None = None) -> Column:
    """Join the non-null fragments with ``sep``; ``default`` when none fire.

    Each part is usually ``F.when(cond, text)`` so a rule that does not fire
    contributes null, which ``concat_ws`` skips.
    """
    joined = F.concat_ws(sep, *parts)
    if default is None:
        return joined
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(default))


def capitalize(c: Column) -> Column:
    """Python ``str.capitalize``: first letter upper, the rest lower (not initcap)."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def word_count(c: Column) -> Column:
    """``len(text.split())``: runs of whitespace separate words, edges ignored.

    All white space becomes blanks first: a text is cut at a single character without a regular expression.
    """
    for space in "\t\n\x0b\f\r":
        c = F.replace(c, F.lit(space), F.lit(" "))
    return F.size(F.array_remove(F.split(c, " "), ""))


def int_text(c: Column) -> Column:
    return c.cast("bigint").cast("string")
