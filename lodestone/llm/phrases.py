"""Phrases whose words occur together far more often than their parts would.

Passes over the texts, each counted in shards (the texts of a task, or as
much of them as memory for a shard holds):

1. words, pairs and triples of neighbouring words, one pass for each: sorted
   counts of hashes, merged by range, give a bitmap of bounded size of those
   that may be frequent, and the next pass counts only what it has;
2. a count trie of depth five for each shard, of runs of words all of whose
   pairs and triples are in the bitmaps.

A part of a frequent phrase is frequent itself, so bitmaps take nothing away
that counts; what they let through besides only costs time. Each trie is cut by
ranges of its first two words and written sorted, level by level; a task gets
the pieces of its range from all shards and merges them, at most FAN pieces at a
time, in rounds where there are more. Walking a merged trie gives each phrase
the counts of its beginnings. The counts of its ends are those of the nodes that
its suffix links lead to: each link is a join with the table of nodes.

Words are known by 64-bit hashes of their bytes and language until the end: of
d different words of a language, two share one with a chance of about
d * d / 2**65.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import groups
from .staging import drop_staged, named, release, staged, tasks
from .words import _LOWER, byte_hashes, mix, slices, text_bytes

U = np.uint64
#: Words of the longest phrase.
DEPTH = 5
#: Words of texts that are counted in one shard; pieces that are merged at a time.
SHARD_WORDS, FAN = 1 << 21, 64
#: Values of the hash of a pair or triple for each ``least`` words of all texts. Those that share one are counted together; one
#: gets ``least`` / SLOTS occurrences on average, so few that are rare come to look frequent, and none is lost.
SLOTS = 16
#: Bits of a bitmap: so many for each member, between these powers of two.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 20, 30
_SOFT = np.zeros(256, bool)
_SOFT[[0x20, 0x09]] = True
_HARD = np.zeros(256, bool)
_HARD[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SOLID = ~(_SOFT | _HARD)
_MIXED = U(0x9E3779B97F4A7C15)


class Text:
    """Words of a slice of texts: bytes, hash with the language, and whether a word follows the one before it in one piece."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, langs: np.ndarray):
        offsets, data = offsets - offsets[0], _LOWER[data[offsets[0] : offsets[-1]]]
        n, solid = len(data), _SOLID[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        begins, ends = solid.copy(), solid.copy()
        if n:
            begins[1:] &= ~solid[:-1] | first[1:n]
            ends[:-1] &= ~solid[1:] | first[1:n]
        self.data, self.starts, self.ends = data, np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.rows = np.searchsorted(offsets, self.starts, "right") - 1
        self.hashes = mix(byte_hashes(data, self.starts, self.ends) ^ langs[self.rows])
        piece = np.concatenate([[0], np.cumsum(_HARD[data])])[self.starts]
        self.follows = np.zeros(len(self.starts), bool)
        self.follows[1:] = (piece[1:] == piece[:-1]) & (self.rows[1:] == self.rows[:-1])


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[Text, pa.Array]]:
    """Slices of a batch of lang, text, with the languages of their rows."""
    offsets, data = text_bytes(batch.column(1))
    lang_at, lang_data = text_bytes(batch.column(0))
    langs = byte_hashes(lang_data, lang_at[:-1], lang_at[1:])
    for i, j in slices(offsets):
        yield Text(offsets[i : j + 1], data, langs[i:j]), batch.column(0).slice(i, j - i)


# --- bitmaps


def _bitmap(members: DataFrame, key: str) -> tuple[int, np.ndarray]:
    """A bit for each value of the leading bits of a hash; ``key``: a long. At most 2**MOST_BITS bits come to the driver."""
    n = members.count()
    bits = min(max(int(n * BITS_EACH).bit_length(), LEAST_BITS), MOST_BITS)
    place = F.shiftrightunsigned(F.col(key), 64 - bits)
    blocks = members.select(F.shiftright(place, 15).alias("block"), (place.bitwiseAND((1 << 15) - 1)).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("map"))
    out = np.zeros((1 << bits) >> 3, np.uint8)
    for r in blocks.toLocalIterator():
        got = np.frombuffer(r["map"], np.uint8)
        out[r["block"] * 4096 : r["block"] * 4096 + len(got)] = got
    return bits, out


def _has(bitmap: tuple[int, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    bits, held = bitmap
    place = (hashes >> U(64 - bits)).astype(np.int64)
    return (held[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


# --- sorted pieces


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, byte by byte of all their values, compressed."""
    out = [np.array([len(arrays), *map(len, arrays)], np.int64).tobytes()]
    for a in arrays:
        out.append(np.ascontiguousarray(a.astype(U).view(np.uint8).reshape(-1, 8).T).tobytes())
    return zstandard.compress(b"".join(out), 1)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    count = int(raw[:8].view(np.int64)[0])
    sizes = raw[8 : 8 + 8 * count].view(np.int64)
    at, out = 8 + 8 * count, []
    for n in sizes.tolist():
        out.append(np.ascontiguousarray(raw[at : at + 8 * n].reshape(8, n).T).view(U).ravel())
        at += 8 * n
    return out


def _added(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct rows of the keys (first key first in order) with the sums of their counts, and for each row the place of its kind.

    The sort is stable and finds runs that are sorted already, so on pieces put
    one after the other it is a merge.
    """
    if not len(counts):
        return keys, counts, np.zeros(0, np.int64)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    ks = [k[order] for k in keys]
    new = np.ones(len(counts), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in ks], axis=0)
    at = np.flatnonzero(new)
    place = np.empty(len(counts), np.int64)
    place[order] = np.cumsum(new) - 1
    return [k[at] for k in ks], np.add.reduceat(counts[order], at), place


class Counts:
    """Counts of hashes, sorted, each with the least number of a shard that has it."""

    @staticmethod
    def piece(keys: np.ndarray, counts: np.ndarray, shards: np.ndarray) -> bytes:
        # low bits that no key has are left out of the differences
        used = int(np.bitwise_or.reduce(keys)) if len(keys) else 1
        low = (used & -used).bit_length() - 1
        return packed(np.diff(keys >> U(low), prepend=U(0)), counts, shards, np.array([low]))

    @staticmethod
    def merged(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [unpacked(p) for p in pieces]
        (keys,), counts, place = _added([np.concatenate([np.cumsum(p[0], dtype=U) << p[3][0] for p in parts])], np.concatenate([p[1] for p in parts]))
        shards = np.full(len(keys), ~U(0))
        np.minimum.at(shards, place, np.concatenate([p[2] for p in parts]))
        return keys, counts, shards

    @classmethod
    def together(cls, pieces: list[bytes]) -> bytes:
        return cls.piece(*cls.merged(pieces))


class Trie:
    """levels[k]: (parent's place in the level above, word, count) of the phrases of k + 2 words, sorted; the first level has its first word as parent."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    @classmethod
    def of(cls, first: np.ndarray, hashes: np.ndarray, length: np.ndarray) -> Trie:
        """Of runs that begin at ``first`` among ``hashes`` and have ``length`` words (2 to DEPTH)."""
        levels = []
        (a, b), n, place = _added([hashes[first], hashes[first + 1]], np.ones(len(first), U))
        levels.append((a, b, n))
        for k in range(2, DEPTH):
            go = length > k
            first, length, place = first[go], length[go], place[go]
            (a, b), n, place = _added([place.astype(U), hashes[first + k]], np.ones(len(first), U))
            levels.append((a, b, n))
        return cls(levels)

    def piece(self) -> bytes:
        return packed(*(x for p, w, n in self.levels for x in (np.diff(p, prepend=U(0)), w, n)))

    @classmethod
    def read(cls, piece: bytes) -> Trie:
        a = unpacked(piece)
        return cls([(np.cumsum(a[k], dtype=U), a[k + 1], a[k + 2]) for k in range(0, len(a), 3)])

    @classmethod
    def merged(cls, pieces: list[bytes]) -> Trie:
        tries = [cls.read(p) for p in pieces]
        levels, places = [], None
        for k in range(DEPTH - 1):
            parents = [t.levels[k][0] for t in tries]
            if k:  # parents by their places in the merged level above
                parents = [places[at : at + len(t.levels[k - 1][0])][p.astype(np.int64)].astype(U) for t, p, at in zip(tries, parents, starts, strict=True)]
            starts = np.cumsum([0, *(len(p) for p in parents)])[:-1]
            (a, b), n, places = _added([np.concatenate(parents), np.concatenate([t.levels[k][1] for t in tries])], np.concatenate([t.levels[k][2] for t in tries]))
            levels.append((a, b, n))
        return cls(levels)

    @classmethod
    def together(cls, pieces: list[bytes]) -> bytes:
        return cls.merged(pieces).piece()

    def frequent(self, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each level: words of the phrases that occur ``least`` times, their counts, the counts of their beginnings of
        two words or more, and the largest count among the phrases that go on after them (0: none)."""
        words = befores = None
        for k, (parent, word, n) in enumerate(self.levels):
            longer = np.zeros(len(n), U)
            if k + 1 < len(self.levels):
                below, _, m = self.levels[k + 1]
                np.maximum.at(longer, below.astype(np.int64), m)
            if k:
                up = parent.astype(np.int64)
                words = np.column_stack([words[up], word])
                befores = np.column_stack([befores[up], self.levels[k - 1][2][up]])
            else:
                words, befores = np.column_stack([parent, word]), np.zeros((len(n), 0), U)
            some = n >= least
            yield words[some], n[some], befores[some], longer[some]


# --- shards, and merging by range


_TOLD = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("piece", pa.binary()), ("totals", pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())]))), ("spelt", pa.list_(pa.struct([("hash", pa.int64()), ("lang", pa.string()), ("word", pa.string())])))])


def _shards(docs: DataFrame, ranges: int, collect: Callable, spell: Callable | None = None) -> DataFrame:
    """part, shard, piece: what ``collect`` makes of the words of a shard (hashes, follows), cut by range.

    Beside them, once a shard, totals (lang, n: words) and spelt (hash, lang,
    word): the words that ``spell`` (hashes, shard -> which) asks it for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        shard = Shard(task << 16, spell)
        for b in batches:
            for text, langs in _texts(b):
                if len(text.hashes):
                    shard.add(text, langs)
                if shard.n >= SHARD_WORDS:
                    yield shard.rows(collect, ranges)
                    count += 1
                    shard = Shard(task << 16 | count & 0xFFFF, spell)
        if shard.n:
            yield shard.rows(collect, ranges)

    return docs.mapInArrow(run, "part int, shard long, piece binary, totals array<struct<lang:string,n:long>>, spelt array<struct<hash:long,lang:string,word:string>>")


class Shard:
    """Words that are counted together."""

    def __init__(self, number: int, spell: Callable | None):
        self.number, self.spell = number, spell
        self.hashes, self.follows, self.n, self.totals, self.spelt = [], [], 0, {}, {}

    def add(self, text: Text, langs: pa.Array) -> None:
        h = text.hashes
        self.hashes.append(h)
        self.follows.append(text.follows)
        self.n += len(h)
        names = langs.to_pylist()
        for name, k in zip(names, np.bincount(text.rows, minlength=len(names)).tolist(), strict=True):
            self.totals[name] = self.totals.get(name, 0) + k
        if self.spell is not None:
            own, at = np.unique(h, return_index=True)
            asked = self.spell(own, self.number)
            for k, i in zip(own[asked].view(np.int64).tolist(), at[asked].tolist(), strict=True):
                if k not in self.spelt:
                    word = text.data[text.starts[i] : text.ends[i]].tobytes().decode()
                    self.spelt[k] = {"hash": k, "lang": names[text.rows[i]], "word": word}

    def rows(self, collect: Callable, ranges: int) -> pa.RecordBatch:
        parts, pieces = collect(np.concatenate(self.hashes), np.concatenate(self.follows), self.number, ranges)
        n = len(parts) + 1  # one without a piece, for totals and spellings
        totals = [{"lang": k, "n": v} for k, v in self.totals.items() if v]
        columns = [pa.array([*parts, None], pa.int32()), pa.array([self.number] * n, pa.int64()), pa.array([*pieces, None], pa.binary())]
        columns += [pa.array([None] * (n - 1) + [rows], _TOLD.field(name).type) for name, rows in (("totals", totals), ("spelt", list(self.spelt.values())))]
        return pa.RecordBatch.from_arrays(columns, schema=_TOLD)


def _merged(pieces: DataFrame, together: Callable[[list[bytes]], bytes], emit: Callable[[list[bytes]], pa.RecordBatch], schema: str) -> DataFrame:
    """Merges the pieces of each range of a staged table: in rounds of FAN while any range has more, then ``emit`` of what is left."""
    whole, pieces = pieces, pieces.where("part IS NOT NULL").select("part", "shard", "piece")
    while (pieces.groupBy("part").agg(F.count("*").alias("n")).agg(F.max("n")).collect()[0][0] or 0) > FAN:
        most = pieces.groupBy("part").agg(F.count("*").alias("n")).agg(F.max("n")).collect()[0][0]
        share = F.pmod(F.xxhash64("shard", "part"), F.lit(-(-most // (FAN // 2)))).alias("share")

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in groups(batches, 2):
                some = g.column(2).to_pylist()
                for k in range(0, len(some), FAN):
                    yield pa.RecordBatch.from_arrays([g.column(0).slice(0, 1), pa.array([g.column(1)[0].as_py() * 1_000_003 + k], pa.int64()), pa.array([together(some[k : k + FAN])], pa.binary())], names=["part", "shard", "piece"])

        dealt = pieces.select("part", share, "piece").repartition(tasks(pieces.sparkSession), "part", "share").sortWithinPartitions("part", "share")
        before, whole = whole, staged(dealt.mapInArrow(joined, "part int, shard long, piece binary"), "pieces")
        pieces = whole
        drop_staged(before)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 1):
            yield emit(g.column(1).to_pylist())

    n = tasks(pieces.sparkSession)
    out = pieces.select("part", "piece").repartition(n, "part").sortWithinPartitions("part").mapInArrow(last, schema)
    out = staged(out, "counts")
    drop_staged(whole)
    release(out.sparkSession)
    return out


def _cut(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of the leading bits begins in sorted hashes; one more than ranges."""
    edges = np.arange(ranges, dtype=U) << U(64 - ranges.bit_length() + 1)
    return np.append(np.searchsorted(keys, edges), len(keys))


class Grams:
    """Which words, pairs and triples may be frequent, by the bitmaps so far, and hashes of those of one word more.

    ``bits``: of the hashes of pairs and triples (see SLOTS).
    """

    def __init__(self, bitmaps: list, bits: int):
        self.bitmaps, self.rest = bitmaps, U(64 - bits)

    def chains(self, h: np.ndarray, follows: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """For each bitmap, the starts of what it has; and starts and hashes of what those let through next."""
        starts, keys = np.arange(len(h)), h
        found = []
        for size, bitmap in enumerate(self.bitmaps, 1):
            keys = keys[some := _has(bitmap, self.cut(keys, size))]
            starts = starts[some]
            found.append(starts)
            # longer by a word, where what begins a word later may be frequent too
            with_next = np.zeros(len(h) + 1, bool)
            with_next[starts] = True
            go = with_next[starts + 1] & np.append(follows, False)[starts + size]
            starts, keys = starts[go], keys[go]
            keys = mix(keys * _MIXED + h[starts + size])
        return found, starts, keys

    def cut(self, keys: np.ndarray, size: int) -> np.ndarray:
        return keys if size == 1 else keys >> self.rest << self.rest

    def counts(self, h: np.ndarray, follows: np.ndarray, shard: int, ranges: int) -> tuple[list[int], list[bytes]]:
        _, _, keys = self.chains(h, follows)
        (k,), n, _ = _added([self.cut(keys, len(self.bitmaps) + 1)], np.ones(len(keys), U))
        cuts = _cut(k, ranges)
        some = [p for p in range(ranges) if cuts[p] < cuts[p + 1]]
        return some, [Counts.piece(k[cuts[p] : cuts[p + 1]], n[cuts[p] : cuts[p + 1]], np.full(cuts[p + 1] - cuts[p], shard, U)) for p in some]

    def tries(self, h: np.ndarray, follows: np.ndarray, shard: int, ranges: int) -> tuple[list[int], list[bytes]]:
        (_, pairs, triples), _, _ = self.chains(h, follows)
        length, longer = np.ones(len(h) + 1, np.int64), np.zeros(len(h), bool)
        length[pairs], longer[triples] = 2, True
        for _ in range(DEPTH - 2):
            length[:-1] = np.where(longer, length[1:] + 1, length[:-1])
        key = mix(h[pairs] * _MIXED + h[pairs + 1])
        order = np.argsort(key, kind="stable")
        first, cuts = pairs[order], _cut(key[order], ranges)
        some = [p for p in range(ranges) if cuts[p] < cuts[p + 1]]
        return some, [Trie.of(first[cuts[p] : cuts[p + 1]], h, np.minimum(length[first[cuts[p] : cuts[p + 1]]], DEPTH)).piece() for p in some]


# --- the passes


def nodes(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """words (hash, lang, word, n), totals (lang, n: all words) and phrases (words: hashes; a; befores; longer), of those that occur ``least`` times."""
    spark: SparkSession = docs.sparkSession
    body = docs.select(F.coalesce(named("lang"), F.lit("und")).alias("lang"), F.coalesce(named("text"), F.lit("")).alias("text"))
    ranges = 1 << (2 * tasks(spark) - 1).bit_length()

    def often(pieces: list[bytes]) -> pa.RecordBatch:
        keys, n, shards = Counts.merged(_reduced(pieces, Counts.together))
        some = n >= least
        return pa.RecordBatch.from_arrays([pa.array(x[some].view(np.int64)) for x in (keys, n, shards)], names=["hash", "n", "shard"])

    sent: list = []  # bounded: see _bitmap
    bits, spell, words, totals = 64, None, None, None
    for size in (1, 2, 3):
        shards = staged(_shards(body, ranges, _counting(list(sent), bits), spell), "pieces")
        if size == 1:
            totals = staged(shards.select(F.inline("totals")).groupBy("lang").agg(F.sum("n").alias("n")), "totals")
            all_words = int(totals.agg(F.sum("n")).collect()[0][0] or 0)  # one row
            bits = min(64, max(LEAST_BITS, (SLOTS * all_words // least).bit_length()))
        if size == 2:
            spelt = staged(shards.select(F.inline("spelt")), "spelt")
        found = _merged(shards, Counts.together, often, "hash long, n long, shard long")
        sent.append(spark.sparkContext.broadcast(_bitmap(found, "hash")))
        if size == 1:
            words, spell = found, _spelling(spark, found)
        else:
            drop_staged(found)
    words = staged(_spelt(body, words, spelt), "words")

    def walked(pieces: list[bytes]) -> pa.RecordBatch:
        rows = [[], [], [], []]
        for w, n, befores, longer in Trie.merged(_reduced(pieces, Trie.together)).frequent(least):
            for out, x in zip(rows, (w.view(np.int64).tolist(), n.tolist(), befores.view(np.int64).tolist(), longer.tolist()), strict=True):
                out.extend(x)
        kinds = (pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=["words", "a", "befores", "longer"])

    shards = staged(_shards(body, ranges, _counting(sent, bits, "tries")), "pieces")
    return words, totals, _merged(shards, Trie.together, walked, "words array<long>, a long, befores array<long>, longer long")


def _counting(sent: list, bits: int, what: str = "counts") -> Callable:
    return lambda *shard: getattr(Grams([b.value for b in sent], bits), what)(*shard)


def _spelling(spark: SparkSession, words: DataFrame) -> Callable:
    """Each word is spelt by the first shard that has it alone: a bitmap of words with their shards."""


    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_with_shard(b.column(0).to_numpy().view(U), b.column(1).to_numpy().view(U)).view(np.int64))], names=["hash"])

    marks = spark.sparkContext.broadcast(_bitmap(words.select("hash", "shard").mapInArrow(own, "hash long"), "hash"))
    return lambda hashes, shard: _has(marks.value, _with_shard(hashes, U(shard)))


def _with_shard(hashes: np.ndarray, shard) -> np.ndarray:
    return mix(hashes ^ (shard + U(1)) * _MIXED)


def _spelt(body: DataFrame, words: DataFrame, spelt: DataFrame) -> DataFrame:
    """hash, lang, word, n. Should texts have come in other shards than in the first pass, words that nobody has spelt are looked for again."""
    rows = words.select("hash", "n")
    told = spelt.groupBy("hash").agg(F.min(F.struct("lang", "word")).alias("s"))
    missing = staged(rows.join(told, "hash", "left_anti"), "unspelt")
    if not missing.isEmpty():
        asked = body.sparkSession.sparkContext.broadcast(_bitmap(missing, "hash"))
        again = _shards(body, 1, lambda *_: ([], []), lambda hashes, shard: _has(asked.value, hashes))
        told = spelt.unionByName(again.select(F.inline("spelt"))).groupBy("hash").agg(F.min(F.struct("lang", "word")).alias("s"))
    return rows.join(told, "hash").select("hash", "s.lang", "s.word", "n")


def _reduced(pieces: list[bytes], together: Callable[[list[bytes]], bytes]) -> list[bytes]:
    """Few enough pieces that all of them can be laid out at once."""
    while len(pieces) > 16:
        pieces = [together(pieces[k : k + 16]) for k in range(0, len(pieces), 16)]
    return pieces


def collocations(docs: DataFrame, least: int = 100, best: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``best`` phrases of each language.

    A null language is ``und`` (with those that are called so), a null text is
    empty; repeated rows count as often as they occur; ties are settled by the
    order of score, a and phrase; a language without frequent phrases, or an
    empty table, gives nothing. Other columns are ignored.
    """
    words, totals, phrases = nodes(docs, least)
    # The suffix link: from a phrase to the node of its words without the first; a chain of k links is one join.
    counts = phrases.select("words", "a").unionByName(words.select(F.array("hash").alias("words"), F.col("n").alias("a")))
    counts = staged(counts.select(F.col("words").alias("part"), F.col("a").alias("part_a")), "nodes")
    size = F.size("words")
    cuts = phrases.select("words", "a", "befores", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("words", "a", "k", F.when(F.col("k") > 1, F.get("befores", F.col("k") - 2)).alias("l"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("part"))
    ends = staged(cuts.join(counts, "part").select("words", "a", "k", "l", F.col("part_a").alias("r"), F.element_at("words", 1).alias("hash")), "cuts")
    firsts = words.select("hash", "lang", F.col("n").alias("n1"))
    cuts = ends.join(firsts, "hash").join(totals, "lang")
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumn("l", F.coalesce("l", "n1")).withColumn("top", F.lit(1000).cast("decimal(4,0)") * whole("a") * whole("n")).withColumn("under", whole("l") * whole("r"))
    cuts = cuts.withColumn("score", F.expr("top div under"))
    lowest = cuts.groupBy("words").agg(F.min(F.struct("score", "k", "l", "r", "a", "lang", "n")).alias("c")).select("words", "c.*")
    # A phrase that is never seen without a word on its right (its trie tells) or on its left (its suffix link does) goes.
    left = phrases.where(size > 2).groupBy(F.slice("words", 2, size - 1).alias("words")).agg(F.max("a").alias("on_left"))
    right = phrases.select("words", "longer")
    lone = lowest.join(right, "words").join(left, "words", "left").where("longer < a AND coalesce(on_left, 0) < a").drop("longer", "on_left")
    lone = staged(lone, "candidates")
    spelt = lone.select("words", F.posexplode("words").alias("at", "hash")).join(words.select("hash", "word"), "hash")
    spelt = spelt.groupBy("words").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("s")).select("words", F.array_join(F.transform("s", lambda x: x["word"]), " ").alias("phrase"))
    rows = lone.join(spelt, "words")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # No task orders a whole language: each of many shares gives its best first.
    share = F.pmod(F.xxhash64("words"), F.lit(tasks(docs.sparkSession)))
    rows = rows.withColumn("share", share).withColumn("place", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).where(F.col("place") <= best)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
