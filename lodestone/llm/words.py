"""Vectorised work on the words of whole texts.

A *word* is a maximal run of characters other than space and 0x09-0x0D. These
are single bytes in UTF-8, so words are found on the bytes of an Arrow string
column without decoding. Everything here works on slices of a batch that hold a
bounded number of bytes (a longer text is a slice of its own), so memory does
not depend on how many rows Spark puts in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 20
#: The prime 2**61 - 1, and a base below it for each lane (drawn at random once).
P61 = (1 << 61) - 1
_BASES = (0x0C3A5F6D1E2B4987, 0x17D80B3C95A2E46F)
#: Spans of bytes over this length are hashed one by one.
_LONG = 512
_TAKE = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], U)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _mix2(x: np.ndarray) -> np.ndarray:
    """Another such scramble (the finaliser of MurmurHash3), for the second lane."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


_LANES = (mix, _mix2)


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of the bytes data[s:e], by place and value: eight bytes at a time go through a scramble.

    Not linear in the bytes, so texts built to agree in a polynomial differ
    here; the lanes share nothing but the bytes.
    """
    size = ends - starts
    scramble = _LANES[lane]
    out = scramble(size.astype(U) + U(0xA24BAED4963EE407))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= _LONG))
    at, left, h = starts[live], size[live], out[live]
    while len(live):
        h = scramble(h ^ (eight[at] & _TAKE[np.minimum(left, 8)]))
        done = left <= 8
        if done.any():
            out[live[done]] = h[done]
            more = ~done
            live, at, left, h = live[more], at[more], left[more], h[more]
        at, left = at + 8, left - 8
    for k in np.flatnonzero(size > _LONG).tolist():
        out[k] = int.from_bytes(blake2b(data[starts[k] : ends[k]], digest_size=8, person=b"lane%d" % lane).digest(), "little")
    return out


def _times(a: np.ndarray, b) -> np.ndarray:
    """a * b modulo P61, for values below it."""
    low, b = U((1 << 31) - 1), U(b) if isinstance(b, int) else b
    a1, a0, b1, b0 = a >> U(31), a & low, b >> U(31), b & low
    middle = a1 * b0 + a0 * b1
    return _below((a1 * b1 << U(1)) + (middle >> U(30)) + ((middle & U((1 << 30) - 1)) << U(31)) + a0 * b0)


def _below(x: np.ndarray) -> np.ndarray:
    """x modulo P61, for any 64-bit values."""
    x = (x & U(P61)) + (x >> U(61))
    return np.where(x >= U(P61), x - U(P61), x)


def _made(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo P61, by doubling."""
    out = []
    for b in (base, pow(base, -1, P61)):
        p = np.ones(n, U)
        have = 1
        while have < n:
            more = min(have, n - have)
            p[have : have + more] = _times(p[:more], pow(b, have, P61))
            have += more
        out.append(p)
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers for n positions; those for ordinary slices are kept."""
    if n > 1 << 21:
        return _made(base, n)
    if base not in _powers or len(_powers[base][0]) < n:
        _powers[base] = _made(base, max(n, 1 << 16, 2 * len(_powers[base][0]) if base in _powers else 0))
    return _powers[base]


class Spans:
    """Hashes of spans of a row of values, of any length: equal spans hash alike wherever they stand.

    A polynomial modulo a prime: two different spans of n values agree for n of
    the 2**61 bases at most.
    """

    def __init__(self, values: np.ndarray, lane: int = 0):
        n = len(values)
        up, self.down = powers(_BASES[lane], n + 1)
        terms = _times(_below(values), up[:n])
        high, low = np.zeros(n + 1, U), np.zeros(n + 1, U)
        np.cumsum(terms >> U(32), out=high[1:])
        np.cumsum(terms & U(0xFFFFFFFF), out=low[1:])
        self.total = _below(_times(_below(high), 1 << 32) + _below(low))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        own = _below(self.total[ends] + U(P61) - self.total[starts])
        return mix(_times(own, self.down[starts]) + (ends - starts).astype(U) * U(0xA24BAED4963EE407))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    return Spans(values, lane).hashes(starts, ends)


def row_hashes(values: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the ``width`` (a few) values from each start."""
    out = np.full(len(starts), width, U)
    for k in range(width):
        out = mix(out ^ values[starts + k])
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], data[at[0] : at[-1]]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes together."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of a slice of texts: byte starts and ends, row of each, hash of each."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, lower: bool = False):
        self.offsets = offsets - offsets[0]
        self.data = data[offsets[0] : offsets[-1]]
        if lower:
            self.data = _LOWER[self.data]
        n = len(self.data)
        solid = ~_SPACE[self.data]
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        begins = solid.copy()
        if n:
            begins[1:] &= ~solid[:-1] | first[1:n]
        ends = solid.copy()
        if n:
            ends[:-1] &= ~solid[1:] | first[1:n]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.rows = np.searchsorted(self.offsets, self.starts, "right") - 1
        #: Word index at which each row begins; one more than rows.
        self.at = np.searchsorted(self.starts, self.offsets)
        self.solid = solid
        self._hash: dict[int, np.ndarray] = {}

    def hashes_of(self, lane: int) -> np.ndarray:
        if lane not in self._hash:
            self._hash[lane] = byte_hashes(self.data, self.starts, self.ends, lane)
        return self._hash[lane]

    @property
    def hashes(self) -> np.ndarray:
        return self.hashes_of(0)

    def counts(self) -> np.ndarray:
        return np.diff(self.at)


def windows(at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``width`` words inside one row, and their rows."""
    n = np.maximum(np.diff(at) - width + 1, 0)
    rows = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    return np.arange(n.sum()) - first[rows] + at[rows], rows
