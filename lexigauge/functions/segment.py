"""Blocks of a text, as arrays; no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import WS
from .normalize import strip

SEG_MODES = ("whole", "para", "para_merge")
# Starts of structural blocks, and characters that end a paragraph.
HEADS = ("#", "|", "-", "*", ">", "```", "$$", "![")
TERMINATORS = "。．.!?！？；;:：”\"）)》」』]】"
TITLE_CHARS = 12


def unix_lines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def _ends(text: Column) -> Column:
    return F.instr(F.lit(TERMINATORS), F.right(text, F.lit(1))) > 0


def is_head(block: Column) -> Column:
    """Structural or title-like: never the continuation of a paragraph."""
    structural = F.lit(False)
    for head in HEADS:
        structural = structural | block.startswith(head)
    line = strip(block)
    return (block == "") | structural | ((F.instr(block, "\n") == 0) & (F.char_length(line) <= TITLE_CHARS) & ~((line != "") & _ends(line)))


def needs_merge(before: Column, after: Column) -> Column:
    """Whether a paragraph was cut off and goes on in the next."""
    last = strip(before)
    return (last != "") & (after != "") & ~_ends(last) & ~is_head(after)


def merge_truncated(paragraphs: Column) -> Column:
    """Paragraphs with those joined by a line feed that were cut off.

    Whether one goes on depends on the paragraph before it only, and no paragraph has an empty line in it, so all are joined at once, by a
    line feed or an empty line, and split at the empty lines: linear in the text.
    """

    def between(p: Column, x: Column, i: Column) -> Column:
        return F.when(i == 0, "").when(needs_merge(F.get(p, i - 1), x), "\n").otherwise("\n\n")

    # an array of one binds the paragraphs to a name, so that they are made once
    joined = lambda p: F.array_join(F.transform(p, lambda x, i: F.concat(between(p, x, i), x)), "")
    merged = lambda p: F.when(F.size(p) < 2, p).otherwise(F.split(joined(p), "\n\n", -1))
    return F.get(F.transform(F.array(paragraphs), merged), 0)


def split_blocks(text: Column, mode: str) -> Column:
    """Blocks of a text in one of the modes; none for null and blank text."""
    if mode not in SEG_MODES:
        raise ValueError(f"unknown segmentation {mode!r}")
    raw = strip(unix_lines(F.coalesce(text.cast("string"), F.lit(""))))
    none = F.array().cast("array<string>")
    if mode == "whole":
        return F.when(raw == "", none).otherwise(F.array(raw))
    parts = F.filter(F.transform(F.split(raw, f"\n{WS}*\n+"), strip), lambda b: b != "")
    return F.when(raw == "", none).otherwise(merge_truncated(parts) if mode == "para_merge" else parts)


def align_blocks(ref: Column, hyp: Column) -> Column:
    """Blocks side by side by position, as structs (ref, hyp); the shorter side is padded with nulls."""
    return F.arrays_zip(ref.alias("ref"), hyp.alias("hyp"))
