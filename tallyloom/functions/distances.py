"""Edit distance and longest common subsequence of two sequences, a row of the table at a time as the bits of one number.

Neighbours in a row differ by one at most, so a row is kept as bits that tell where it rises or falls, and the next one
follows from a few additions and logical steps over the whole number, some tens of cells in each step of the machine.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence
from math import isqrt

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def _places(xs: Sequence[Hashable]) -> dict[Hashable, int]:
    """Where each item stands, as bits."""
    out: dict[Hashable, list[int]] = {}
    for i, x in enumerate(xs):
        out.setdefault(x, []).append(i)
    if len(xs) < 512:
        return {x: sum(1 << i for i in at) for x, at in out.items()}
    size = len(xs) // 8 + 1
    bits = {}
    for x, at in out.items():
        cells = bytearray(size)
        for i in at:
            cells[i >> 3] |= 1 << (i & 7)
        bits[x] = int.from_bytes(cells, "little")
    return bits


def edits(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """The least number of items to insert, delete or replace that makes b of a."""
    begin, end_a, end_b = 0, len(a), len(b)
    while begin < end_a and begin < end_b and a[begin] == b[begin]:
        begin += 1
    while end_a > begin and end_b > begin and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    a, b = a[begin:end_a], b[begin:end_b]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    at = _places(a)
    whole, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    rises, falls, last = whole, 0, len(a)  # of a column downwards, and its last cell
    for x in b:
        same = at.get(x, 0)
        level = same | falls
        met = (((same & rises) + rises) ^ rises) | same
        up = falls | (whole & ~(met | rises))  # from column to column
        down = rises & met
        last += bool(up & top) - bool(down & top)
        up = up << 1 | 1
        rises = (down << 1 | (whole & ~(level | up))) & whole
        falls = up & level & whole
    return last


def _rows(v: int, items: Sequence[Hashable], at: dict[Hashable, int], whole: int) -> Iterator[int]:
    """After each item the row of common lengths, as bits that are 0 where it rises."""
    for x in items:
        hit = v & at.get(x, 0)
        v = ((v + hit) | (v - hit)) & whole
        yield v


#: Cells up to which all rows are kept at once.
SHORT = 1 << 16


def common(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    """A longest common subsequence as index pairs. Walking back from the ends, equal items pair up; else a step back in a wins ties.

    Rows are kept at the ends of blocks and made again block by block on the way back, so memory grows with len(b) times the root of len(a), in bits;
    short sequences are one block. Equal ends pair up before any row is made.
    """
    n, m, out = len(a), len(b), []
    while n and m and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
        out.append((n, m))
    if not n or not m:
        return out[::-1]
    a, b = a[:n], b[:m]
    at, whole, step = _places(b), (1 << m) - 1, n if n * m <= SHORT else isqrt(n) + 1
    kept, v = [whole], whole
    for k in range(0, n - step, step):  # the last block's rows are made on the way back alone
        for v in _rows(v, a[k : k + step], at, whole):
            pass
        kept.append(v)
    j = m
    for k in range((len(a) - 1) // step, -1, -1):
        if not j:
            break
        block = a[k * step : (k + 1) * step]
        rows = [kept[k], *_rows(kept[k], block, at, whole)]
        i = len(block)
        here = j - (rows[i] & ((1 << j) - 1)).bit_count()  # the length at (i, j)
        while i and j:
            if block[i - 1] == b[j - 1]:
                i, j, here = i - 1, j - 1, here - 1
                out.append((k * step + i, j))
                continue
            if here == j - (rows[i - 1] & ((1 << j) - 1)).bit_count():
                i -= 1
                continue
            # Left in this row until it pairs or is no longer than the row before.
            j -= 1  # a step back in a would lose one here, so this one loses none
    return out[::-1]


#: Words that are numbered at once; what Python holds of a batch's words is that many, or one row's.
AT_ONCE = 50_000


def numbered(a: pa.Array, b: pa.Array) -> Iterator[tuple[list[int] | None, list[int] | None]]:
    """Pairs of lists of words with equal numbers for equal words, some rows of the batch after others."""
    sizes = [pc.fill_null(pc.list_value_length(x), 0) for x in (a, b)]
    begin = words = 0
    for i, n in enumerate(pc.add(*sizes).to_pylist()):
        if words and words + n > AT_ONCE:
            yield from _numbered(a[begin:i], b[begin:i])
            begin, words = i, 0
        words += n
    yield from _numbered(a[begin:], b[begin:])


def _numbered(a: pa.Array, b: pa.Array) -> Iterator[tuple[list[int] | None, list[int] | None]]:
    flat = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode().indices.to_pylist()
    sizes = [[n or 0 for n in pc.list_value_length(x).to_pylist()] for x in (a, b)]
    at = [0, sum(sizes[0])]
    for i, (x, y) in enumerate(zip(a.is_valid().to_pylist(), b.is_valid().to_pylist())):
        ends = [at[0] + sizes[0][i], at[1] + sizes[1][i]]
        yield (flat[at[0] : ends[0]] if x else None), (flat[at[1] : ends[1]] if y else None)
        at = ends


@F.arrow_udf(IntegerType())
def word_edits(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Word edits of two arrays of words; null where one is null."""
    return pa.array([None if a is None or b is None else edits(a, b) for a, b in numbered(ref, hyp)], pa.int32())


@F.arrow_udf(IntegerType())
def char_edits(a: pa.Array, b: pa.Array) -> pa.Array:
    """Edits of two texts by their characters; null where one is null."""
    return pa.array([None if x is None or y is None else edits(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())
