"""Levels and blocks of Python strings, for code that works on Arrow batches; the same as the columns of ``normalize`` and ``segment``."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

from .chars import FULL_WIDTH, PUNCTUATION, WS
from .normalize import CJK
from .segment import HEADS, SEG_MODES, TERMINATORS, TITLE_CHARS

_GAP = re.compile(f"\n{WS}*\n+")
_CJK_SPACE = re.compile(rf"(?<={CJK})[ \t]+(?={CJK})")
_ASCII_WS = [c for c in map(chr, range(128)) if c.isspace() and c != " "]
_ODD_WS = [c for c in _ASCII_WS if c != "\n"]
_HALF, _UNIFIED = str.maketrans(FULL_WIDTH), str.maketrans(PUNCTUATION)


def _goes_on(before: str, after: str) -> bool:
    """Whether a paragraph was cut off and goes on in the next; neither is empty."""
    if before[-1] in TERMINATORS or after.startswith(HEADS):
        return False
    return len(after) > TITLE_CHARS or "\n" in after or after[-1] in TERMINATORS


def _stripped(text: str | None) -> str:
    text = text or ""
    return (text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text).strip()


def _paragraphs(raw: str) -> list[str]:
    parts = [p.strip() for p in raw.split("\n\n")]
    if raw.count("\n") == 2 * len(parts) - 2 and all(parts):
        return parts
    return [p for p in map(str.strip, _GAP.split(raw)) if p]


def _spans(parts: list[str]) -> list[tuple[int, int]]:
    """First paragraph, and the one after the last, of each merged one."""
    starts = [i for i in range(len(parts)) if not i or not _goes_on(parts[i - 1], parts[i])]
    return list(zip(starts, [*starts, len(parts)][1:], strict=True))


def blocks(text: str | None, mode: str) -> list[str]:
    """Blocks of a text in one of the modes; none for None and blank text."""
    if mode not in SEG_MODES:
        raise ValueError(f"unknown segmentation {mode!r}")
    raw = _stripped(text)
    if mode == "whole" or not raw:
        return [raw] if raw else []
    parts = _paragraphs(raw)
    return parts if mode == "para" else ["\n".join(parts[a:b]) for a, b in _spans(parts)]


def collapsed(block: str) -> str:
    """White space at the ends dropped, other white space as single spaces."""
    block = block.strip()
    if not block.isascii() or any(map(block.__contains__, _ASCII_WS)):
        return " ".join(block.split())
    return _squeezed(block)


def _squeezed(text: str) -> str:
    """Runs of spaces as single ones."""
    while "  " in text:
        text = text.replace("  ", " ")
    return text


def _single(raw: str, parts: list[str], even: bool) -> tuple[list[str], bool]:
    """Paragraphs at P1, and whether they have no white space but spaces; then all are made at once."""
    if even and raw.isascii() and raw.count("\n") == 2 * max(0, len(parts) - 1) and not any(map(raw.__contains__, _ODD_WS)):
        return (_squeezed(raw).split("\n\n") if "  " in raw else parts), True
    return [collapsed(p) for p in parts], False


class Rules(NamedTuple):
    """What the levels from P1 on do to a block, and whether those from P3 on leave ASCII as it is."""

    steps: tuple[Callable[[str], str], ...]
    plain: bool


def rules(pairs: dict[str, str]) -> Rules:
    simple = str.maketrans(pairs)
    plain = not any(c.isascii() for c in pairs)
    return Rules((
        collapsed,
        str.casefold,
        lambda b: b.translate(_HALF),
        lambda b: b.translate(_UNIFIED),
        lambda b: _CJK_SPACE.sub("", b.translate(simple)),
    ), plain)


class Blocks(list):
    """Blocks of a text at a level, and their lengths, which are asked for with each text that they are held against."""

    __slots__ = ("sizes", "total", "longest")

    def __init__(self, blocks: Sequence[str]):
        super().__init__(blocks)
        self.sizes = list(map(len, self))
        self.total, self.longest = sum(self.sizes), max(self.sizes, default=0)


def _levels(found: list[str], by: Rules, single: list[str] | None = None, like: list[Blocks] | None = None) -> list[Blocks]:
    """Blocks at P0 to P5; from the level on at which they are those of ``like``, its own lists."""
    if like and found == like[0]:
        return like
    out = [Blocks(found)]
    for rule in by.steps:
        own = out[-1]
        if len(out) > 2 and by.plain and all(map(str.isascii, own)):
            return out + [own] * (6 - len(out))
        made = single if len(out) == 1 and single is not None else [rule(b) for b in own]
        if like and made == like[len(out)]:
            theirs = like[len(out) :]
            return [theirs[0] if b is own and made == own else b for b in out] + theirs
        out.append(own if made == own else Blocks(made))
    return out


def at_levels(found: list[str], pairs: dict[str, str]) -> list[list[str]]:
    """Blocks at P0 to P5; a level that changes none of them is the list of the level before."""
    return _levels(found, rules(pairs))


class Split(NamedTuple):
    """A text in one of the modes: its blocks at P0 to P5, the paragraphs that each is made of (from, to), whether at P0 too nothing but
    what the mode puts between paragraphs stands between them, and whether the paragraphs are known to have no white space but spaces."""

    levels: list[Blocks]
    spans: list[tuple[int, int]]
    even: bool
    spaced: bool


def splits(text: str | None, modes: Sequence[str], by: Rules, like: Sequence[Split] | None = None) -> list[Split]:
    """``at_levels`` of the blocks in each of the modes, by ``rules``; modes that split alike share their lists, and so do levels at which the
    blocks are those of ``like``, another text's in the same modes.

    White space is collapsed once, in the paragraphs: at P1 the other blocks are those with a space between them.
    """
    raw = _stripped(text)
    parts = _paragraphs(raw)
    even = not raw or sum(map(len, parts)) + 2 * len(parts) - 2 == len(raw)  # nothing but two line feeds is as short between paragraphs
    single, spaced = _single(raw, parts, even)
    each = [(i, i + 1) for i in range(len(parts))]
    out: list[Split] = []
    for at, mode in enumerate(modes):
        spans = [(0, len(parts))] if mode == "whole" and raw else _spans(parts) if mode == "para_merge" else each
        found = parts if spans == each else [raw] if mode == "whole" else ["\n".join(parts[a:b]) for a, b in spans]
        known = next((x.levels for x in out if x.spans == spans and x.levels[0] == found), None)
        levels = known or _levels(found, by, single if found is parts else [" ".join(single[a:b]) for a, b in spans], like[at].levels if like else None)
        out.append(Split(levels, spans, even or mode != "whole", spaced))
    return out
