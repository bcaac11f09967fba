"""Statistics of whole texts, counted on their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .words import Words, byte_hashes, mix, row_hashes, slices, text_bytes, windows

U = np.uint64
#: The signs that count as symbols.
SYMBOLS = "#*$%&|<>"
_KINDS = ("lower", "upper", "digit", "space", "newline", "symbol", "stop", "mark", "more", "lead")
_KIND = np.full(256, _KINDS.index("mark"), np.int64)
for _b in range(256):
    _c = chr(_b)
    if _b >= 0xC0:
        _KIND[_b] = _KINDS.index("lead")
    elif _b >= 0x80:
        _KIND[_b] = _KINDS.index("more")
    elif _c.islower():
        _KIND[_b] = _KINDS.index("lower")
    elif _c.isupper():
        _KIND[_b] = _KINDS.index("upper")
    elif _c.isdigit():
        _KIND[_b] = _KINDS.index("digit")
    elif _c == "\n":
        _KIND[_b] = _KINDS.index("newline")
    elif _b in (0x20, 0x09, 0x0B, 0x0C, 0x0D):
        _KIND[_b] = _KINDS.index("space")
    elif _c in SYMBOLS:
        _KIND[_b] = _KINDS.index("symbol")
    elif _c in ".!?":
        _KIND[_b] = _KINDS.index("stop")
WIDTH = 5


def _of_rows(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values[at[i]:at[i + 1]] for each row."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it is there twice or more; whether it is not the first of its kind."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    again[order[1:]] = same
    again[order[:-1]] |= same
    return again, later


def of_slice(offsets: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of the texts between offsets; all are counts of the whole text."""
    w = Words(offsets, data)
    n = len(offsets) - 1
    size = np.diff(w.offsets)
    row_of_byte = np.repeat(np.arange(n), size)
    kinds = np.bincount(row_of_byte * len(_KINDS) + _KIND[w.data], minlength=n * len(_KINDS)).reshape(n, -1)
    out = {f"n_{k}": kinds[:, i] for i, k in enumerate(_KINDS)}
    out["n_bytes"], out["n_words"], out["n_symbols"] = size, w.counts(), out.pop("n_symbol")
    signs = w.solid & ((w.data & 0xC0) != 0x80)
    upto = np.concatenate([[0], np.cumsum(signs)])
    length = upto[w.ends] - upto[w.starts]
    out["word_chars"] = _of_rows(length, w.at)
    out["long_words"] = _of_rows(length > 20, w.at)
    out["longest_word"] = np.zeros(n, np.int64)
    np.maximum.at(out["longest_word"], w.rows, length)
    salt = mix(np.arange(n, dtype=U) + U(1))
    again, later = _repeats(mix(w.hashes + salt[w.rows]))
    out["n_distinct_words"] = _of_rows(~later, w.at)
    starts, rows = windows(w.at, WIDTH)
    again, _ = _repeats(mix(row_hashes(w.hashes, starts, WIDTH) + salt[rows]))
    cover = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(cover, starts[again], 1)
    np.add.at(cover, starts[again] + WIDTH, -1)
    out["n_repeat_words"] = _of_rows(np.cumsum(cover[:-1]) > 0, w.at)
    # Lines: cut after each line feed, which is not a part of its line.
    cuts = np.unique(np.concatenate([w.offsets[:-1], np.flatnonzero(w.data == 0x0A) + 1]))
    cuts = cuts[cuts < len(w.data)]
    stops = np.append(cuts[1:], len(w.data))[: len(cuts)]
    stops = stops - (w.data[stops - 1] == 0x0A)
    worded = np.searchsorted(w.starts, stops) > np.searchsorted(w.starts, cuts)
    cuts, stops = cuts[worded], stops[worded]
    rows = np.searchsorted(w.offsets, cuts, "right") - 1
    at = np.searchsorted(cuts, w.offsets)
    _, later = _repeats(mix(byte_hashes(w.data, cuts, stops) + salt[rows]))
    out["n_lines"], out["n_dup_lines"] = np.diff(at), _of_rows(later, at)
    shout = w.data[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
    out["n_marked_words"] = _of_rows(np.isin(shout, np.frombuffer(b"!?#*$%&|<>", np.uint8)), w.at)
    out["n_ended_words"] = _of_rows(np.isin(shout, np.frombuffer(b".,;:", np.uint8)), w.at)
    return out


NAMES = tuple(of_slice(np.zeros(2, np.int64), np.zeros(0, np.uint8)))


def of_batch(texts: pa.Array) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """Rows i to j of a string column and their statistics, a slice at a time; null texts are empty."""
    offsets, data = text_bytes(texts)
    for i, j in slices(offsets):
        yield i, j, of_slice(offsets[i : j + 1], data)
