"""Lines, bytes and cuts of text columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value evaluated once: it is bound to a lambda's variable, so the plan holds it once too."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def lines(text: Column) -> Column:
    """Lines as an array: split at LF, one CR before it dropped, no line after a last LF; no line at all for ''."""
    split = F.split(F.regexp_replace(text, "\\r?\\n\\z", ""), "\\r?\\n")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(split)


def n_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def n_newlines(text: Column) -> Column:
    """What ``wc -l`` counts."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")


def lossless_compact(text: Column) -> Column:
    """Lines without trailing white space, empty ones dropped."""
    trimmed = F.transform(lines(text), lambda x: F.regexp_replace(x, "(?U)\\s+\\z", ""))
    return F.array_join(F.filter(trimmed, lambda x: x != ""), "\n")


def truncated(text: Column, most: int, marker: str) -> Column:
    """At most ``most`` bytes, never half a character, then the marker; unchanged if it fits."""
    raw = text.cast("binary")

    def inside(at: int) -> Column:
        """Whether the byte at a place (from 1) goes on a character that began before it."""
        return F.hex(F.substring(raw, max(at, 1), 1)).between("80", "BF") if at > 0 else F.lit(False)

    end = F.when(~inside(most + 1), most)
    for less in (1, 2, 3):
        end = end.when(~inside(most + 1 - less), max(most - less, 0))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.substring(raw, F.lit(1), end).cast("string"), F.lit(marker)))


def tail(text: Column, n: int = 60) -> Column:
    """The last n lines."""
    rows = lines(text)
    return F.array_join(F.slice(rows, F.greatest(F.size(rows) - n, F.lit(0)) + 1, n), "\n")


def with_newline(text: Column) -> Column:
    """Exactly as it is if it ends in LF, else with one."""
    return F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))
