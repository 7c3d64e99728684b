"""Many sequences as one array, and what walk and unitig make of it without a step per base or per piece.

A sequence, or a block of one, is a row.  Rows lie one after the other, each with a
separator behind it, so a window never spans two.  A block has ``own`` characters
in front that belong to the block before; how many bases stand in one run just
before its first place and just behind its last (``before``, ``after``) is all
that it has to know of its neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from kmerspark.operators.edgebits import Bits
from kmerspark.operators.windows import _CODE, base_windows

#: Windows that are looked up at once.
PIECE = 1 << 20


class Flat:
    """Rows of text; place p of row r is ``begin[r] + p``, and its own places are first[r] to end[r]."""

    def __init__(self, texts: pa.Array, own: np.ndarray | None = None, before: np.ndarray | None = None, after: np.ndarray | None = None, opens: np.ndarray | None = None):
        n = len(texts)
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        size = np.diff(at)
        if len(raw) and raw.max() > 127:
            strings = texts.to_pylist()
            size = np.array([len(s) for s in strings], np.int64)
            raw = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n, self.begin = n, np.cumsum(size + 1) - size - 1
        self.chars = np.zeros(len(raw) + n, raw.dtype)
        self.chars[np.arange(len(raw)) + np.repeat(np.arange(n), size)] = raw
        self.base = _CODE[np.minimum(self.chars, 255)]
        zero = np.zeros(n, np.int64)
        self.first = self.begin + (zero if own is None else own)
        self.end = self.begin + size
        self.before, self.after = zero if before is None else before, zero if after is None else after
        self.opens = np.ones(n, bool) if opens is None else opens
        self.branch = np.zeros(len(self.chars), bool)

    def mark(self, branches: np.ndarray | Bits, kp1: int) -> None:
        """Marks own places at which an edge of the sorted codes, or of the bits, ends."""
        bits = isinstance(branches, Bits)
        for a in range(0, len(self.base) - kp1 + 1 if bits or len(branches) else 0, PIECE):
            at, code = base_windows(self.base[a : a + PIECE + kp1 - 1], kp1)
            own = branches.has(code) if bits else branches[np.minimum(np.searchsorted(branches, code), len(branches) - 1)] == code
            self.branch[at[own] + (a + kp1 - 1)] = True
        self.branch &= self.inside()

    def inside(self) -> np.ndarray:
        step = np.zeros(len(self.chars) + 1, np.int64)
        np.add.at(step, self.first, 1)
        np.add.at(step, self.end, -1)
        return np.cumsum(step[:-1]) > 0

    def row_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, place, "right") - 1

    def before_kind(self) -> np.ndarray:
        """Whether a base stands before each row's first place."""
        return self.before > 0


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1 and so on, size[i] of them, for each i in turn."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def strings(chars: np.ndarray, size: np.ndarray) -> pa.Array:
    """Strings of so many characters each, of characters one after the other."""
    ends = np.concatenate(([0], np.cumsum(size)))
    data = chars.tobytes()
    if chars.dtype != np.uint8:
        wide = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        ends = np.concatenate(([0], np.cumsum(wide)))[ends]
        data = data.decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def upper(chars: np.ndarray) -> np.ndarray:
    return np.where((chars >= 97) & (chars <= 122), chars - 32, chars).astype(chars.dtype)


@dataclass
class Segments:
    """In order: the row, the first place and the place behind the last, whether it is good, and whether it goes on from the block before."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    good: np.ndarray
    goes_on: np.ndarray


def segments(flat: Flat, kp1: int) -> Segments:
    """Maximal runs of at least kp1 bases, which are good, and what is between; an empty row is one empty segment."""
    clean = (flat.base < 4) & flat.inside()
    step = np.diff(np.concatenate(([0], clean.view(np.int8), [0])))
    a, b = np.flatnonzero(step > 0), np.flatnonzero(step < 0)
    row = flat.row_of(a)
    long = b - a + np.where(a == flat.first[row], flat.before[row], 0) + np.where(b == flat.end[row], flat.after[row], 0) >= kp1
    cuts = np.unique(np.concatenate((flat.first, a[long], b[long])))
    row = flat.row_of(cuts)
    own = (cuts < flat.end[row]) | (flat.first[row] == flat.end[row])
    cuts, row = cuts[own], row[own]
    begins = np.zeros(len(flat.chars) + 1, bool)
    begins[a[long]] = True
    good = begins[cuts]
    end = np.minimum(np.append(cuts[1:], len(flat.chars)), flat.end[row])
    # what stands before is good if its run is, which may go on here
    first = cuts == flat.first[row]
    on_clean = clean[np.minimum(cuts, len(clean) - 1)] & (end > cuts) if len(clean) else good
    was_good = flat.before_kind()[row] & np.where(on_clean, good, flat.before[row] >= kp1)
    return Segments(row, cuts, end, good, first & ~flat.opens[row] & (was_good == good))


def bodies(flat: Flat, s: Segments, kp1: int, kmer_format: bool) -> pa.Array:
    """The text of each segment's record, or of this block's part of it."""
    k, size = kp1 - 1, s.end - s.start
    place = spans(s.start, size)
    done = np.where(s.goes_on & s.good, flat.before[s.row], 0)
    good = np.repeat(s.good, size)
    item = good & flat.branch[place]
    head = good & (place - np.repeat(s.start - done, size) < k)
    kept = ~good | head | item
    times = np.where(item, kp1 if kmer_format else 1, 1)[kept]
    total = np.concatenate(([0], np.cumsum(np.bincount(np.flatnonzero(kept), times, len(place)).astype(np.int64)))) if len(place) else np.zeros(1, np.int64)
    ends = np.cumsum(size)
    place = place[kept]
    if kmer_format:
        place = spans(place - times + 1, times)
    return strings(upper(flat.chars[place]), total[ends] - total[ends - size])


@dataclass
class Pieces:
    """In order: the row, the first place and the place behind the last, and whether it goes on from the block before."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    goes_on: np.ndarray


def pieces(flat: Flat, kp1: int) -> Pieces:
    """Runs of bases, cut where a branch edge ends, with k - 1 bases of overlap, and runs of all else; an empty row is one empty piece."""
    clean, inside = flat.base < 4, flat.inside()
    kind = np.where(inside, 1 + clean, 0)
    step = np.concatenate(([True], kind[1:] != kind[:-1]))
    step[flat.first[flat.first < len(step)]] = True
    a = np.flatnonzero(step & (kind > 0))
    empty = np.flatnonzero(flat.first == flat.end)
    a = np.sort(np.concatenate((a, flat.first[empty])))
    row = flat.row_of(a)
    b = np.minimum(np.append(a[1:], len(flat.chars)), flat.end[row])
    goes_on = (a == flat.first[row]) & ~flat.opens[row] & (flat.before_kind()[row] == clean[np.minimum(a, len(clean) - 1)]) if len(a) else np.zeros(0, bool)
    cut = np.flatnonzero(flat.branch)
    run = np.searchsorted(a, cut, "right") - 1
    order = np.lexsort((np.concatenate((np.zeros(len(a), np.int64), np.ones(len(cut), np.int64))), np.concatenate((a, cut))))
    anchor, is_cut, run = np.concatenate((a, cut))[order], (order >= len(a)), np.concatenate((np.arange(len(a)), run))[order]
    cut_next = np.append(is_cut[1:], False)
    end = np.where(cut_next, np.append(anchor[1:], 0), b[run]) if len(a) else anchor
    return Pieces(row[run], np.where(is_cut, anchor - kp1 + 2, anchor), end, goes_on[run] & ~is_cut if len(a) else is_cut)
