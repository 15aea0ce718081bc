"""Markdown with embedded HTML to plain text; characters stay as they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import WS
from .normalize import strip

# What is replaced by what, in this order; (?d) lets only the line feed end a line.
TAG_STEPS = [(r"(?im)<br{ws}*/?>{ws}*", "\n"), (r"(?i)</t[dh]>{ws}*", "\t"), (r"(?i)</tr>{ws}*", "\n"), (r"<[^>]+>", "")]
STEPS = [
    (r"(?dm)^{ws}*(```|~~~)[^\n]*$", ""),
    *TAG_STEPS,
    (r"(?s)\$\$(.+?)\$\$", "$1"), (r"(?s)\\\[(.+?)\\\]", "$1"), (r"(?s)\\\((.+?)\\\)", "$1"), (r"(?s)\\begin\{(\w+)\}(.+?)\\end\{\1\}", "$2"), (r"(?<!\$)\$([^$\n]+?)\$(?!\$)", "$1"),
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"(?dm)^{ws}*(?:[-*_]{ws}*){3,}$", ""), (r"(?dm)^{ws}{0,3}#{1,6}{ws}*", ""), (r"(?dm)^{ws}{0,3}>{ws}?", ""), (r"(?dm)^{ws}*(?:[-*+]|\d+[.)]){ws}+", ""),
    *[(r"(?s)(\*\*|__|\*|_|`)(.+?)\1", "$2")] * 3,
    (r"(?dm)[ \t]+$", ""), (r"\n{3,}", "\n\n"),
]


def _apply(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        text = F.regexp_replace(text, F.lit(pattern.replace("{ws}", WS)), F.lit(to))
    return text


def md_to_plain(text: Column) -> Column:
    return strip(_apply(F.coalesce(text, F.lit("")), STEPS))


def tags_to_plain(text: Column) -> Column:
    """Only the steps for tags."""
    return _apply(F.coalesce(text, F.lit("")), TAG_STEPS)


def plain_stats(text: Column) -> list[Column]:
    """Characters and lines before and after."""
    plain = md_to_plain(text)
    lines = lambda t: F.size(F.split(t, "\n", -1))
    return [F.char_length(text).alias("raw_chars"), F.char_length(plain).alias("plain_chars"), lines(text).alias("raw_lines"), lines(plain).alias("plain_lines")]
