"""Edit distance with its cost guard, and its substitutions, deletions and insertions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from itertools import repeat
from operator import contains

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CELLS = 4_000_000
OPS = "dist int, S int, D int, I int, ref_len int, hyp_len int, overflow boolean"


def overflows(ref: Column, hyp: Column) -> Column:
    return F.char_length(ref).cast("bigint") * F.char_length(hyp) > MAX_CELLS


#: Bands tried before the whole matrix: a distance within a band costs only the band.
BANDS = (48, 384)


def guarded_distance(ref: Column, hyp: Column) -> Column:
    """Levenshtein distance in code points; beyond the guard, the difference of lengths."""
    exact = F.levenshtein(ref, hyp)
    longer = F.greatest(F.char_length(ref), F.char_length(hyp))
    for band in reversed(BANDS):
        within = F.nullif(F.levenshtein(ref, hyp, band), F.lit(-1))
        # in a text hardly longer than a band is wide, the band is most of the matrix
        exact = F.coalesce(F.when(longer > 3 * band, within), exact)
    return F.when(ref == hyp, 0).when(overflows(ref, hyp), F.abs(F.char_length(ref) - F.char_length(hyp))).otherwise(exact)


def _places(long: str, short: str) -> dict[str, int]:
    """For each character of ``short``, a bit for every place in ``long`` that has it."""
    codes = np.frombuffer(long.encode("utf-32-le", "surrogatepass"), np.uint32)
    return {c: int.from_bytes(np.packbits(codes == ord(c), bitorder="little").tobytes(), "little") for c in set(short)}


def _columns(long: str, short: str, across: bool) -> tuple[list[bytes], list[bytes]]:
    """Bits over ``long`` for each character of ``short``: cells equal to their diagonal, and cells one above a neighbour.

    The neighbour is the cell before along ``short`` if ``across``, else the one before along ``long``. A whole column of the
    matrix is one integer, so a step costs a few operations on as many bits as ``long`` has characters.
    """
    n = len(long)
    size, ones, places = (n + 7) // 8, (1 << n) - 1, _places(long, short)
    up, down = ones, 0
    level, above = [], []
    for c in short:
        same = places[c]
        equal = ((((same & up) + up) ^ up) | same | down) & ones
        right, left = down | (ones & ~(equal | up)), equal & up
        if across:
            above.append(right.to_bytes(size, "little"))
        right = (right << 1 | 1) & ones
        up, down = (left << 1 & ones) | (ones & ~(equal | right)), equal & right
        if not across:
            above.append(up.to_bytes(size, "little"))
        level.append(equal.to_bytes(size, "little"))
    return level, above


def _shared(ref: str, hyp: str, at_end: bool) -> int:
    """Characters that two texts have in common at their start or end."""
    n, m, common, step, grows = len(ref), len(hyp), 0, 32, 2
    while step:
        reach = common + step
        fits = reach <= min(n, m)
        if fits and (ref[n - reach : n - common] == hyp[m - reach : m - common] if at_end else ref[common:reach] == hyp[common:reach]):
            common, step = reach, step * grows
        else:
            step, grows = step // 2, 1
    return common


def _codes(text: str | bytes) -> np.ndarray:
    """Code points; of ASCII, its bytes."""
    if isinstance(text, bytes):
        return np.frombuffer(text, np.uint8)
    return np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: From so many characters on, those beyond ASCII are counted in an array over their codes.
COUNT_BY_CODE = 4096
#: Where many places differ, those with codes beyond this are counted first: the small letters of ASCII.
UPPER = 96


def _lack(x: np.ndarray, y: np.ndarray) -> int:
    """Characters of one text that another has too few of: no fewer of them have to be dropped or replaced."""
    if x.dtype == y.dtype == np.uint8:
        more = np.bincount(x, minlength=128) - np.bincount(y, minlength=128)
        return int(more[more > 0].sum())
    if len(x) + len(y) >= COUNT_BY_CODE:
        size = 1 + int(max(x.max(initial=0), y.max(initial=0)))
        more = np.bincount(x, minlength=size) - np.bincount(y, minlength=size)
        return int(more[more > 0].sum())
    return (Counter(x.tolist()) - Counter(y.tolist())).total()


def _less(text: str | bytes, char: str | bytes) -> str | bytes:
    return text.translate(None, char) if isinstance(text, bytes) else text.replace(char, "")


def together(pairs: Sequence[tuple[str, str]]) -> tuple[int, int, int, int] | None:
    """dist, S, D and I of pairs that differ, summed, where a bound on all of them at once meets what some way takes, else None; linear in the texts.

    Pairs of one length each need no more than the places that differ, and no less than the characters that one side of all pairs lacks. If
    both are as many, every pair needs just its own: substitutions only. Where one side is left when some of a single character go from
    the other, in all pairs the same way, every pair is as far apart as its lengths differ.
    """
    refs, hyps = [r for r, _ in pairs], [h for _, h in pairs]
    ref, hyp = "".join(refs), "".join(hyps)
    n, m = len(ref), len(hyp)
    if n == m:
        return _replaced(ref, hyp) if list(map(len, refs)) == list(map(len, hyps)) else None
    if len(pairs) > 1:
        if "\0" in ref or "\0" in hyp:
            return None  # the character that parts the pairs is in a text
        ref, hyp = "\0".join(refs), "\0".join(hyps)
    long, short = (ref, hyp) if n > m else (hyp, ref)
    at = _shared(long, short, False)
    char = long[at]  # the first that differs has to be one of those that go
    if char == "\0" and len(pairs) > 1 or not _dropped(long, short, char):
        return None
    return abs(n - m), 0, max(0, n - m), max(0, m - n)


def _replaced(ref: str, hyp: str) -> tuple[int, int, int, int] | None:
    """Texts of one length, where as many characters as places differ are lacking in one: of one kind, of those from a code on, or of all kinds."""
    x, y = _codes(ref), _codes(hyp)
    if x.dtype != y.dtype:
        x, y = x.astype(np.uint32), y.astype(np.uint32)
    differ = x != y
    apart = int(np.count_nonzero(differ))
    if apart > 1:
        few = 4 * apart < len(x)
        if few:
            char = ref[int(differ.argmax())]
            known = ref.count(char) - hyp.count(char) == apart
        else:
            known = abs(int(np.count_nonzero(x > UPPER)) - int(np.count_nonzero(y > UPPER))) == apart
        if not known:
            if few:
                places = np.flatnonzero(differ)
                x, y = x[places], y[places]
            if apart != _lack(x, y):
                return None
    return apart, apart, 0, 0


def _dropped(long: str, short: str, char: str) -> bool:
    """Whether the shorter text is left when some of a character go from the longer one."""
    if long.isascii() and short.isascii():
        a, b = long.encode(), short.encode()
        code = char.encode()
        many, kept = a.count(code), b.count(code)
    else:
        a, b, code = long, short, None
        many, kept = a.count(char), b.count(char)
    if many - kept != len(long) - len(short) or (left := _less(a, code or char)) != _less(b, code or char):
        return False
    if not kept:
        return True
    # how many of it stand before each of the other characters
    runs, others = (np.bincount((p := (_codes(t) == ord(char)).nonzero()[0]) - np.arange(len(p)), minlength=len(left) + 1) for t in (a, b))
    return not np.any(runs < others)


def _within(short: str, long: str) -> bool:
    """Whether characters can be left out of ``long`` so that ``short`` is left."""
    # each search goes on behind the character found last
    return all(map(contains, repeat(iter(long)), short))


def certain(ref: str, hyp: str) -> tuple[int, int, int, int] | None:
    """dist, S, D and I in linear time where they can be known without the matrix, else None.

    A text that is left when characters of the other go is as far from it as their lengths differ, and there is no other way. Texts of one
    length are as far apart as the places that differ if as many characters of one are missing in the other; then the matrix is walked
    along its diagonal, since a substitution goes before a deletion and an insertion.
    """
    n, m = len(ref), len(hyp)
    if not n or not m:
        return n + m, 0, n, m
    known = together([(ref, hyp)])
    if known or n == m:
        return known
    short, long = (ref, hyp) if n < m else (hyp, ref)
    if _within(short, long):
        return abs(n - m), 0, max(0, n - m), max(0, m - n)
    return None


def distance(ref: str, hyp: str) -> int:
    """Levenshtein distance in code points: by ``certain``, else a column of the matrix at a time."""
    head = _shared(ref, hyp, False)
    ref, hyp = ref[head:], hyp[head:]
    tail = _shared(ref, hyp, True)
    ref, hyp = ref[: len(ref) - tail], hyp[: len(hyp) - tail]
    known = certain(ref, hyp)
    if known:
        return known[0]
    long, short = sorted((ref, hyp), key=len, reverse=True)
    n = len(long)
    places, ones, last = _places(long, short), (1 << n) - 1, n - 1
    up, down, total = ones, 0, n
    for c in short:
        same = places[c]
        equal = ((((same & up) + up) ^ up) | same | down) & ones
        right, left = down | (ones & ~(equal | up)), equal & up
        total += (right >> last) - (left >> last)
        right = (right << 1 | 1) & ones
        up, down = (left << 1 & ones) | (ones & ~(equal | right)), equal & right
    return total


def count_ops(ref: str, hyp: str) -> tuple[int, int, int, int, int, int, bool]:
    """dist, S, D, I, lengths and overflow; of equal ways, a match goes before a substitution, a deletion and an insertion.

    The matrix is held as bit columns over the longer text, and walked from its end.
    """
    n, m = len(ref), len(hyp)
    if n * m > MAX_CELLS:
        return abs(n - m), 0, max(0, n - m), max(0, m - n), n, m, True
    # a common end matches whatever stands before it
    common = _shared(ref, hyp, True)
    i, j = n - common, m - common
    known = certain(ref[:i], hyp[:j])
    if known:
        return *known, n, m, False
    turned = i < j
    level, above = _columns(hyp[:j], ref[:i], True) if turned else _columns(ref[:i], hyp[:j], False)
    swaps = drops = adds = 0
    while i and j:
        if ref[i - 1] == hyp[j - 1]:
            i, j = i - 1, j - 1
            continue
        column, row = (i - 1, j - 1) if turned else (j - 1, i - 1)
        at, bit = row >> 3, row & 7
        if not level[column][at] >> bit & 1:
            swaps, i, j = swaps + 1, i - 1, j - 1
        elif above[column][at] >> bit & 1:
            drops, i = drops + 1, i - 1
        else:
            adds, j = adds + 1, j - 1
    drops, adds = drops + i, adds + j
    return swaps + drops + adds, swaps, drops, adds, n, m, False


def _counted(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    pairs = list(zip(ref.fillna(""), hyp.fillna(""), strict=True))
    found = {pair: count_ops(*pair) for pair in set(pairs)}
    return pd.DataFrame([found[pair] for pair in pairs], columns=["dist", "S", "D", "I", "ref_len", "hyp_len", "overflow"])


def edit_ops(ref: Column | str, hyp: Column | str) -> Column:
    """Struct of ``count_ops`` for each pair; null counts as empty."""
    return F.pandas_udf(_counted, OPS)(ref, hyp)
