"""Token ids of whole texts, a batch at a time.

Byte-level BPE first splits a text into pieces by a fixed pattern and then
encodes each piece by itself, so the pieces of a slice of texts are found with
array operations on code points, and only pieces that a worker has not met are
encoded, once each. Special strings in a text are split off first and give
their own id, as the tokenizers library does by default.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .words import byte_hashes, slices, text_bytes

U = np.uint64
#: Bytes in a slice of texts; a longer text is a slice of its own.
SLICE = 1 << 20
#: Pieces that a worker remembers; beyond, it forgets and starts again.
REMEMBERED = 1 << 20
_LETTER, _NUMBER, _SPACE, _OTHER, _END = 1, 2, 3, 0, 4
#: The endings that the split pattern takes together with an apostrophe, and Unicode's White_Space.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(1)
def _classes() -> np.ndarray:
    kind = np.array([{"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)] + [_END], np.uint8)
    kind[list(WHITE_SPACE)] = _SPACE
    return kind


def piece_starts(points: np.ndarray) -> np.ndarray:
    """Where pieces begin in code points; 0x110000 ends a segment and is a piece of its own.

    The pattern takes, in this order: an apostrophe with one of CONTRACTIONS;
    letters, numbers or other signs with a space before them; white space up to
    the last sign before something else; the rest of white space.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    before = np.concatenate([[_END], kind[:-1]])
    change = kind != before
    change |= kind == _END
    begins = change.copy()
    space = kind == _SPACE
    # The last sign of white space before something else stands apart; a plain space is joined to what follows.
    after = np.concatenate([kind[1:], [_END]])
    last = space & (after != _SPACE) & (after != _END)
    begins |= last
    joined = np.flatnonzero(last & (points == 0x20)) + 1
    begins[joined] = False
    quotes = np.flatnonzero((points == 0x27) & begins & (after == _LETTER))  # begins: no space is joined to it
    if len(quotes):
        padded = np.concatenate([points, np.full(2, 0x110000, points.dtype)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        long = np.zeros(len(quotes), np.int64)
        for end in CONTRACTIONS:
            fits = (one == ord(end[0])) & (two == ord(end[1]) if len(end) > 1 else True)
            long[fits & (long == 0)] = len(end)
        taken, long = quotes[long > 0], long[long > 0]
        begins[taken + 1] = False
        rest = taken + 1 + long
        begins[rest[rest < n]] = True
    return np.flatnonzero(begins)


class Pieces:
    """Encodes pieces with ``encode`` (list of str to lists of ids) and remembers them.

    Pieces are looked up by a 64-bit hash and compared sign by sign with what
    is remembered; a slice in which two pieces clash is worked on without.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], special: dict[str, int]):
        self.encode, self.special = encode, special
        self._forget()

    def _forget(self) -> None:
        """Keeps the pieces met again since the last time, unless those are many."""
        keep = np.flatnonzero(self.met) if len(getattr(self, "known", ())) else np.zeros(0, np.int64)
        if not 0 < len(keep) < REMEMBERED // 2:
            self.known = np.zeros(0, U)
            self.slot = np.zeros(0, np.int64)  # where the ids of known[i] begin
            self.count = np.zeros(0, np.int64)
            self.flat = np.zeros(0, np.uint32)
            self.sign_slot = np.zeros(0, np.int64)  # and its code points
            self.signs = np.zeros(0, np.int64)
            self.flat_signs = np.zeros(0, np.uint32)
            self.met = np.zeros(0, bool)
            return
        self.slot, self.count, self.flat = _packed(self.slot[keep], self.count[keep], self.flat)
        self.sign_slot, self.signs, self.flat_signs = _packed(self.sign_slot[keep], self.signs[keep], self.flat_signs)
        self.known = self.known[keep]
        self.met = np.zeros(len(keep), bool)

    def _learn(self, hashes: np.ndarray, points: np.ndarray, starts: np.ndarray, stops: np.ndarray, texts: list[str]) -> None:
        ids = self.encode(texts)
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for i in ids for x in i), np.uint32, int(count.sum()))
        slot = len(self.flat) + np.cumsum(count) - count
        _, signs, flat_signs = _packed(starts, stops - starts, points)
        sign_slot = len(self.flat_signs) + np.cumsum(signs) - signs
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        joined = lambda x, y: np.concatenate([x, y])[order]
        self.known, self.slot, self.count = known[order], joined(self.slot, slot), joined(self.count, count)
        self.sign_slot, self.signs = joined(self.sign_slot, sign_slot), joined(self.signs, signs)
        self.met = joined(self.met, np.zeros(len(hashes), bool))
        self.flat, self.flat_signs = np.concatenate([self.flat, flat]), np.concatenate([self.flat_signs, flat_signs])

    def _found(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        found = self.known[at] == hashes
        self.met[at[found]] = True
        return found

    def _looked_up(self, points: np.ndarray, joined: str, starts: np.ndarray, stops: np.ndarray, real: np.ndarray):
        """For each piece that is ``real``: number of ids, where they begin in the ids that are returned; None if pieces clash."""
        short = (points ^ points >> 16).astype(np.uint16)  # half the bytes to hash; clashes are found below
        hashes = byte_hashes(short.view(np.uint8), 2 * starts, 2 * stops)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        size = stops - starts
        if not _same(points, starts, size, points, starts[first][back], size[first][back]):
            return None
        wanted = real[first]
        found = self._found(distinct)
        new = wanted & ~found
        if new.any():
            if len(self.known) + int(new.sum()) > REMEMBERED:
                self._forget()
                found = self._found(distinct)
                new = wanted & ~found
            self._learn(distinct[new], points, starts[first[new]], stops[first[new]], [joined[i:j] for i, j in zip(starts[first[new]].tolist(), stops[first[new]].tolist(), strict=True)])
        if not len(self.known):
            return np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), self.flat
        at = np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)
        old = wanted & found
        if not _same(points, starts[first[old]], size[first[old]], self.flat_signs, self.sign_slot[at[old]], self.signs[at[old]]):
            return None
        return np.where(wanted, self.count[at], 0)[back], np.where(wanted, self.slot[at], 0)[back], self.flat

    def _plainly(self, joined: str, starts: np.ndarray, stops: np.ndarray, real: np.ndarray):
        """As _looked_up, without hashes."""
        place: dict[str, int] = {}
        names = [joined[i:j] if r else "" for i, j, r in zip(starts.tolist(), stops.tolist(), real.tolist(), strict=True)]
        back = np.array([place.setdefault(x, len(place)) for x in names])
        ids = [i if x else [] for x, i in zip(place, self.encode([x or " " for x in place]), strict=True)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        return count[back], (np.cumsum(count) - count)[back], np.fromiter((x for i in ids for x in i), np.uint32, int(count.sum()))

    def _segments(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Texts cut at special strings; the row of each segment, and the id that follows it (-1: none)."""
        if not any(s in t for s in self.special for t in texts):
            return texts, np.arange(len(texts)), np.full(len(texts), -1)
        out, rows, ids = [], [], []
        for row, text in enumerate(texts):
            while True:
                found = min(((at, -len(s), s) for s in self.special if (at := text.find(s)) >= 0), default=None)
                out.append(text if found is None else text[: found[0]])
                rows.append(row)
                ids.append(-1 if found is None else self.special[found[2]])
                if found is None:
                    break
                text = text[found[0] + len(found[2]) :]
        return out, np.array(rows), np.array(ids)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        return self._run(texts, False)[0]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids in a row."""
        return self._run(texts, True)

    def _run(self, texts: list[str], want_ids: bool):
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        segments, rows, follow = self._segments(texts)
        _, each, slot, flat, ending = self.located(segments, follow)
        total = np.concatenate([[0], np.cumsum(each)])
        seg_total = np.diff(np.concatenate([[0], total[ending + 1]]))
        lengths = np.bincount(rows, weights=seg_total, minlength=len(texts)).astype(np.int64)
        if not want_ids:
            return lengths, None
        source = np.repeat(slot - total[:-1], each) + np.arange(total[-1])
        marks = follow >= 0
        put = total[:-1][ending[marks]]
        source[put] = 0
        ids = flat[source] if len(flat) else np.zeros(total[-1], np.uint32)
        ids[put] = follow[marks]
        return lengths, ids

    def located(self, segments: list[str], follow: np.ndarray):
        """The pieces of segments one after another, each segment's end as a piece: starts, numbers of ids, slots in the ids, the ids, and which pieces are ends."""
        joined = "\0".join([*segments, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        ends = np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)) + 1) - 1
        points[ends] = 0x110000
        starts = piece_starts(points)
        stops = np.append(starts[1:], len(points))
        is_end = points[starts] == 0x110000
        found = self._looked_up(points, joined, starts, stops, ~is_end)
        each, slot, flat = self._plainly(joined, starts, stops, ~is_end) if found is None else found
        ending = np.flatnonzero(is_end)
        each[ending] = follow >= 0
        return starts, each, slot, flat, ending


def _packed(slot: np.ndarray, count: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches flat[slot:slot + count] one after another: new slots, counts, values."""
    ends = np.cumsum(count)
    return ends - count, count, flat[np.repeat(slot - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]


def _same(x: np.ndarray, x_at: np.ndarray, x_size: np.ndarray, y: np.ndarray, y_at: np.ndarray, y_size: np.ndarray) -> bool:
    """Whether all stretches x[x_at:x_at + x_size] equal y[y_at:y_at + y_size]."""
    if (x_size != y_size).any():
        return False
    ends = np.cumsum(x_size)
    steps = np.arange(ends[-1] if len(ends) else 0)
    own = ends - x_size
    return bool((x[np.repeat(x_at - own, x_size) + steps] == y[np.repeat(y_at - own, x_size) + steps]).all())


def sliced_texts(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, list[str]]]:
    """Rows i to j of a string column and their texts, a slice of about ``limit`` bytes at a time; nulls are empty."""
    for i, j in slices(text_bytes(column)[0], limit):
        yield i, j, [t or "" for t in column.slice(i, j - i).to_pylist()]


@lru_cache(4)
def byte_level(path: str) -> Pieces:
    """The tokenizers library's byte-level BPE file at ``path``; one for each worker.

    Checked: no normaliser, byte-level split with its pattern and no prefix
    space, no post-processor, special strings matched plainly.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    split = told["pre_tokenizer"] or {}
    plain = told["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    special = {t["content"]: t["id"] for t in told["added_tokens"]}
    if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in told["added_tokens"]):
        raise ValueError(f"{path} is not a plain byte-level BPE file")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    model = tokenizer.model
    model._resize_cache(0)  # pieces are remembered here

    def encode(texts: list[str]) -> list[list[int]]:
        tokenize = model.tokenize
        return [[t.id for t in tokenize(x)] for x in as_signs(texts)]

    return Pieces(encode, special)


@lru_cache(1)
def _signs() -> dict[int, str]:
    """The printable sign that stands for each byte in byte-level files: itself, or the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


def as_signs(texts: list[str]) -> list[str]:
    """Texts as byte-level files spell them; all at once, split at a byte that UTF-8 never has."""
    spelt = "\udfff".join(texts).encode("utf-8", "surrogatepass").replace(b"\xed\xbf\xbf", b"\xff")
    return spelt.decode("latin-1").translate(_signs()).split(_signs()[0xFF])


def sign_bytes(spelt: str) -> bytes:
    back = {ord(c): b for b, c in _signs().items()}
    return bytes(back[ord(c)] for c in spelt)
