"""Exact token counts of every prefix of a text, by dynamic programming.

In byte-level BPE two tokens may stand next to each other in an encoding
exactly if merging the bytes of the two gives the two again, and an encoding is
right exactly if all its neighbours may stand so. Hence the encoding of a
prefix ends with one certain token: the one that ends there and may follow the
last token of the shorter prefix before it. Going through a piece once gives
the last token, and with it the count, of each of its prefixes. Counts of a
text's prefixes follow from those of its pieces, and answer truncation and
budget questions without encoding again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import CONTRACTIONS, Pieces, byte_level, piece_starts, sign_bytes, sliced_texts
from .words import text_bytes

#: Pairs of neighbours, and pieces with the counts of all their prefixes, that a worker remembers.
_PAIRS, _STORED = 1 << 20, 1 << 16


class PrefixTable:
    """Token counts of all prefixes of pieces, for a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        byte_level(path)  # checks the file's kind
        model = told["model"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.vocab = {sign_bytes(s): i for s, i in model["vocab"].items() if s not in self.special}
        self.spelt = {i: b for b, i in self.vocab.items()}
        # Tokens by their bytes from the last to the first; a token's id stands under -1.
        self.backwards: dict = {}
        for spelt, i in self.vocab.items():
            node = self.backwards
            for byte in reversed(spelt):
                node = node.setdefault(byte, {})
            node[-1] = i
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = [(self.vocab[sign_bytes(a)], self.vocab[sign_bytes(b)]) for a, b in pairs]
        self.rank = {a << 32 | b: r for r, (a, b) in enumerate(pairs)}
        made = {self.vocab[self.spelt[a] + self.spelt[b]]: (a, b, r) for r, (a, b) in reversed(list(enumerate(pairs)))}
        if any(made[x][2] > r for r, pair in enumerate(pairs) for x in pair if x in made):
            raise ValueError("a merge comes before the merges of its parts")
        self.right = {t: self._edge(t, made, 1) for t in self.spelt}
        self.left = {t: self._edge(t, made, 0) for t in self.spelt}
        self.may_follow: dict[int, bool] = {}
        self.pieces = Pieces(self._encode, self.special)
        self.stored: dict[str, list[int]] = {}

    @staticmethod
    def _edge(token: int, made: dict[int, tuple[int, int, int]], side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one end of ``token`` while it is merged, each with the rank at which it goes up in the next."""
        out, until = [(token, 1 << 60)], 0
        while token in made:
            until = made[token][2]
            token = made[token][side]
            out.append((token, until))
        return out

    def _fits(self, pair: int) -> bool:
        """Whether no merge crosses the border of the two tokens while each is merged for itself.

        Two that meet at the border merge if their rank comes before either
        goes up in a longer one; at the same rank the pair on the left is first.
        """
        rank = self.rank.get
        told = True
        for x, x_until in self.right[pair >> 32]:
            for y, y_until in self.left[pair & 0xFFFFFFFF]:
                r = rank(x << 32 | y)
                if r is not None and r < x_until and r <= y_until:
                    told = False
        if len(self.may_follow) >= _PAIRS:
            self.may_follow.clear()
        self.may_follow[pair] = told
        return told

    def last_tokens(self, piece: bytes, last: list[int] | None = None) -> list[int]:
        """The last token of each prefix of 1, 2, ... bytes; ``last`` has those of the first prefixes."""
        last = [] if last is None else last
        root, known, fits = self.backwards, self.may_follow, self._fits
        for end in range(len(last), len(piece)):
            node, start, found = root, end, []
            while start >= 0 and (node := node.get(piece[start])) is not None:
                if (t := node.get(-1)) is not None:
                    found.append((start, t))
                start -= 1
            for start, t in reversed(found):
                if not start:
                    break
                pair = last[start - 1] << 32 | t
                told = known.get(pair)
                if told or told is None and fits(pair):
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(t)
        return last

    def counts(self, piece: bytes) -> list[int]:
        """Tokens of each prefix of 0, 1, 2, ... bytes."""
        out = [0]
        for end, t in enumerate(self.last_tokens(piece), 1):
            out.append(out[end - len(self.spelt[t])] + 1)
        return out

    def ids(self, piece: bytes, last: list[int] | None = None) -> list[int]:
        last, end, out = self.last_tokens(piece) if last is None else last, len(piece), []
        while end:
            out.append(last[end - 1])
            end -= len(self.spelt[last[end - 1]])
        return out[::-1]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of pieces, gone through in order of bytes: what neighbours begin with is not done again."""
        data = [t.encode() for t in texts]
        out: list = [None] * len(data)
        before, last = b"", []
        for i in sorted(range(len(data)), key=data.__getitem__):
            piece, same = data[i], 0
            for x, y in zip(piece, before, strict=False):
                if x != y:
                    break
                same += 1
            last = self.last_tokens(piece, last[:same])
            out[i] = self.ids(piece, last)
            before = piece
        return out

    def _by_sign(self, piece: str) -> list[int]:
        """Tokens of each prefix of 0, 1, 2, ... code points; stored, as pieces come again and again."""
        found = self.stored.get(piece)
        if found is None:
            counts = self.counts(piece.encode())
            ends = np.cumsum([0, *(len(c.encode()) for c in piece)])
            found = [counts[e] for e in ends]
            if len(self.stored) >= _STORED:
                self.stored.clear()
            self.stored[piece] = found
        return found

    def _segment(self, text: str) -> np.ndarray:
        """As prefix_counts, for a text without special strings."""
        if not text:
            return np.zeros(1, np.int64)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        out = np.zeros(len(text) + 1, np.int64)
        starts = piece_starts(points).tolist()
        base = 0
        for start, stop in zip(starts, [*starts[1:], len(text)], strict=True):
            piece = text[start:stop]
            own = self._by_sign(piece)
            if piece[0] == "'" and piece[1:] in CONTRACTIONS and len(piece) == 3:
                own[2] = own[1] + self.counts(piece[1].encode())[-1]  # cut there, the letter is a piece of its own
            out[start + 1 : stop + 1] = base + np.array(own[1:])
            base += own[-1]
        # A prefix that ends in white space has all of that run as one piece.
        at = 0
        while at < len(text):
            if not text[at].isspace() or 0x1C <= ord(text[at]) <= 0x1F:
                at += 1
                continue
            run = at
            while run < len(text) and text[run].isspace() and not 0x1C <= ord(text[run]) <= 0x1F:
                run += 1
            if run - at > 1:
                out[at + 1 : run + 1] = out[at] + np.array(self._by_sign(text[at:run])[1:])
            at = run
        return out

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """Tokens of text[:0], text[:1], ... text; an entry more than code points. Null: empty."""
        text, begin, base, out = text or "", 0, 0, [np.zeros(1, np.int64)]
        while True:
            at, size, special = min(((at, -len(s), s) for s in self.special if (at := text.find(s, begin)) >= 0), default=(len(text), 0, None))
            head = base + self._segment(text[begin:at])
            out.append(head[1:])
            if special is None:
                return np.concatenate(out)
            out.append(np.array([base + self._segment(text[begin : at + i])[-1] for i in range(1, len(special))], np.int64))  # not yet the special string
            base = int(head[-1]) + 1
            out.append(np.array([base]))
            begin = at + len(special)

    def longest_within(self, text: str | None, limit: int) -> int:
        """Code points of the longest prefix of at most ``limit`` tokens."""
        return int(np.flatnonzero(self.prefix_counts(text) <= limit)[-1])

    def measured(self, texts: list[str], limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text, and code points of its longest prefix of at most ``limit`` tokens.

        The counts of whole pieces tell where the limit is passed; around that
        place the counts of all prefixes decide.
        """
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        segments, rows, follow = self.pieces._segments(texts)
        starts, each, _, _, ending = self.pieces.located(segments, follow)
        total = np.concatenate([[0], np.cumsum(each)])
        begins = np.concatenate([[0], ending[:-1] + 1])  # a segment's first piece
        n = np.bincount(rows, weights=total[ending + 1] - total[begins], minlength=len(texts)).astype(np.int64)
        kept = np.fromiter(map(len, texts), np.int64, len(texts))
        plain = np.bincount(rows, minlength=len(texts)) == 1
        first = np.searchsorted(rows, np.arange(len(texts)))
        for k in np.flatnonzero(n > limit).tolist():
            text = texts[k]
            if not plain[k]:  # it holds a special string
                kept[k] = self.longest_within(text, limit)
                continue
            lo, hi = int(begins[first[k]]), int(ending[first[k]])
            at = lambda p: int(starts[p] - starts[lo])  # noqa: B023, E731
            b = e = int(np.searchsorted(total[lo + 1 : hi + 1], total[lo] + limit, "right")) + lo  # the piece that passes the limit
            while b > lo and (b == e or text[at(b) - 1].isspace()):
                b -= 1
            while e + 1 < hi and text[at(e + 1) - 1].isspace():
                e += 1
            counts = int(total[b] - total[lo]) + self._segment(text[at(b) : at(e + 1)])
            kept[k] = at(b) + int(np.flatnonzero(counts <= limit)[-1])
        return n, kept


@lru_cache(2)
def table(path: str) -> PrefixTable:
    return PrefixTable(path)


def store_prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, prefix_tokens: array of the token counts of text[:0], text[:1], ... text (null: [0]).

    For use where many budgets are asked of one text: element_at(prefix_tokens,
    n + 1) is the count of the first n code points. Null ids are kept, repeated
    rows come as often as they occur; of an empty table nothing comes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, texts in sliced_texts(batch.column(1), 1 << 18):
                counts = [table(path).prefix_counts(t).astype(np.int32) for t in texts]
                offsets = np.cumsum([0, *map(len, counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids[i:j], pa.ListArray.from_arrays(offsets, np.concatenate(counts))], [id_col, "prefix_tokens"])

    source = docs.select(id_col, text_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, prefix_tokens array<int>")


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_bytes, n_tokens, over_limit (n_tokens > limit), kept_chars.

    The counts are those of the tokenizers library for the whole text, special
    strings in it included, without added tokens; they are the last entries of
    the prefix counts of all pieces of the text. kept_chars: code points of the
    longest prefix of at most ``limit`` tokens, from the prefix counts. Null
    texts are empty (0, 0, false, 0); null ids stay null; equal rows give equal
    rows; an empty table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            size = np.diff(text_bytes(batch.column(1))[0])
            for i, j, texts in sliced_texts(batch.column(1)):
                n, kept = table(path).measured(texts, limit)
                yield pa.RecordBatch.from_arrays([ids[i:j], pa.array(size[i:j]), pa.array(n), pa.array(n > limit), pa.array(kept)], [id_col, "n_bytes", "n_tokens", "over_limit", "kept_chars"])

    source = docs.select(F.col(id_col), F.col(text_col))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, kept_chars long")
