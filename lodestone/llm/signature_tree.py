"""Documents linked by the Jaccard similarity of their word shingles, with signature trees.

Equal sets are one class. Classes that may be linked are put together first:
each set is cut into BINS parts by hash, the least hash of each part is taken,
and ROWS of these together are a key. Where fewer shingles differ than a set
has keys, two linked sets surely share one; larger linked sets miss all
BINS / ROWS keys with a chance below 1e-13, less than hashes of 64 bits clash.
Within a key, classes stay together if most of their least hashes agree (the
same bound). What is so connected is a family.

In a family, or a tile of a large one, a signature tree is laid over the sets in
order of size: leaves hold a bitmap of their shingles, nodes the OR of those
below and their range of sizes. Two trees are gone down together; a pair of
nodes is left if sizes, or the bits that both have, allow no link, or if all
below are connected already. Leaves are compared exactly. A large family is
split: all tiles hold its first class, so that one round connects what is
linked to it; only classes still apart meet the other tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, groups
from .staging import drop_staged, release, staged, tasks, whole_row
from .words import Words, mix, row_hashes, slices, span_hashes, text_bytes, windows

U = np.uint64
SHINGLE, SIMILAR = 4, 85  # words; per cent
BINS, ROWS = 126, 3
#: Share of agreeing least hashes below which two sets are not kept together.
ALIKE = 0.45
#: Classes in a tile of a hot key, and of a large family.
KEY_TILE, FAMILY_TILE = 512, 192
#: One in so many keys is looked at first.
EARLY = 5
_ARITY = 4
_LAST = (1 << 63) - 1


def shingle_sets(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, ascending, and where each row's begin; a shorter text is one shingle."""
    starts, rows = windows(w.at, width)
    n = np.diff(w.at)
    short = np.flatnonzero((n > 0) & (n < width))
    rows = np.concatenate([rows, short])
    values = np.concatenate([row_hashes(w.hashes, starts, width), span_hashes(w.hashes, w.at[short], w.at[short + 1])])
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    values, rows = values[new], rows[new]
    return values, np.searchsorted(rows, np.arange(len(n) + 1))


def _profile(values: np.ndarray, at: np.ndarray) -> dict[str, pa.Array]:
    """Name (128 bits), size, least hashes (a byte each; 0: empty part) and keys of each set."""
    k = len(at) - 1
    size = np.diff(at)
    rows = np.repeat(np.arange(k), size)
    total = lambda x: np.diff(np.concatenate([[U(0)], np.cumsum(x, dtype=U)])[at])
    one, two = total(mix(values + U(0x5851F42D4C957F2D))), total(mix(values ^ U(0x14057B7EF767814F)))
    name = np.stack([mix(one + size.astype(U)), mix(two ^ size.astype(U))], 1).view(np.uint8).reshape(k, 16)
    spread = mix(values + U(77))
    least = np.full(k * BINS, np.iinfo(U).max, U)
    np.minimum.at(least, rows * BINS + (spread % U(BINS)).astype(np.int64), spread // U(BINS))
    least = least.reshape(k, BINS)
    empty = least == np.iinfo(U).max
    signs = (mix(least) % U(255) + U(1)).astype(np.uint8)
    signs[empty] = 0
    part = mix(np.where(empty, U(0), least + U(1))).reshape(k, BINS // ROWS, ROWS)
    keys = part[:, :, 0].copy()
    for r in range(1, ROWS):
        keys = mix(keys * U(3) + part[:, :, r])
    keys = mix(keys + np.arange(BINS // ROWS, dtype=U))
    used = ~empty.reshape(k, BINS // ROWS, ROWS).all(2)
    cuts = np.concatenate([[0], np.cumsum(used.sum(1))]).astype(np.int32)
    return {"class": pa.array([x.tobytes() for x in name], pa.binary()), "n": pa.array(size.astype(np.int64)), "signs": pa.array([x.tobytes() for x in signs], pa.binary()), "keys": pa.ListArray.from_arrays(cuts, pa.array(keys[used].view(np.int64)))}


def _profiles(texts: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column(2))
            for i, j in slices(offsets):
                made = _profile(*shingle_sets(Words(offsets[i : j + 1], data, lower=True), width))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], *made.values()], ["doc", "body", *made])

    return texts.mapInArrow(run, "doc long, body long, class binary, n long, signs binary, keys array<long>")


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of y agree with the one row x in ALIKE of the parts that either has."""
    same = ((y == x) & (x > 0)).sum(1)
    return same >= ALIKE * ((x > 0) | (y > 0)).sum(1)


def _kept_together(blocks: DataFrame, across: bool) -> DataFrame:
    """key, i, j, side, class, signs, first -> key, a, b: classes of a group that are connected by likeness.

    ``across``: only classes of different sides are compared. Otherwise a row
    without b tells that a is not connected to ``first``, if there is one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, a, b = [], [], []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, a, b)], ["key", "a", "b"])
            for x in (key, a, b):
                x.clear()
            return made

        for g in groups(batches, 3):
            own, names, first = g.column(0)[0].as_py(), g.column(4).to_pylist(), g.column(6)[0].as_py()
            signs = np.frombuffer(b"".join(g.column(5).to_pylist()), np.uint8).reshape(-1, BINS)
            side = g.column(3).to_numpy()
            left = np.arange(len(names))
            while len(left):
                at, left = [int(left[0])], left[1:]
                whole = list(at)
                while at and len(left):
                    x = at.pop()
                    near = _alike(signs[x], signs[left])
                    if across:
                        near &= side[left] != side[x]
                    found, left = left[near], left[~near]
                    at += found.tolist()
                    whole += found.tolist()
                members = [names[k] for k in whole]
                a += [members[0]] * (len(members) - 1)
                b += members[1:]
                if first is not None and first not in members:
                    a += members
                    b += [None] * len(members)
            key += [own] * (len(a) - len(key))
            if len(a) >= 4096:
                yield out()
        yield out()

    return blocks.repartition(tasks(blocks.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "class").mapInArrow(run, "key long, a long, b long")


def _edges(rows: DataFrame, keys: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: what is kept together, from key, class and, for each key that counts, its size and first class.

    A hot key is cut in tiles, each with the key's first class, so one round
    connects all that are like it; only what is still apart meets other tiles.
    """
    # Keys that hold the same classes say the same: one of them is enough.
    keys = keys.groupBy("size", "x", "s").agg(F.min(F.struct("key", "first")).alias("k")).select("k.*", F.ceil(F.col("size") / KEY_TILE).cast("int").alias("tiles"))
    keys = staged(keys, "keys")
    rows = rows.join(keys, "key").withColumn("tile", F.pmod(F.xxhash64("class", F.lit(1)), F.col("tiles")).cast("int"))
    rows = staged(rows.join(classes.select("class", "signs"), "class"), "blocks")
    no = F.lit(0)
    copies = rows.where("tiles > 1 AND class = first").withColumn("tile", F.explode(F.filter(F.sequence(no, F.col("tiles") - 1), lambda t: t != F.col("tile"))))
    first = F.when(F.col("tiles") > 1, F.col("first")).alias("first")
    found = staged(_kept_together(rows.unionByName(copies).select("key", F.col("tile").alias("i"), no.alias("j"), no.alias("side"), "class", "signs", first), False), "kept-together")
    edges = found.where("b IS NOT NULL").select("a", "b")
    apart = staged(found.where("b IS NULL").select("key", F.col("a").alias("class")), "apart")
    if not apart.isEmpty():
        parts = staged(apart.groupBy("key").agg(F.ceil(F.count("*") / KEY_TILE).cast("int").alias("parts")), "parts")
        hot = rows.join(parts, "key")
        ours = hot.join(apart, ["key", "class"]).withColumn("j", F.explode(F.sequence(no, F.col("tiles") - 1))).withColumn("i", F.pmod(F.xxhash64("class", F.lit(2)), F.col("parts")).cast("int"))
        theirs = hot.withColumn("i", F.explode(F.sequence(no, F.col("parts") - 1))).withColumn("j", F.col("tile"))
        pairs = ours.withColumn("side", F.lit(1)).select("key", "i", "j", "side", "class", "signs").unionByName(theirs.withColumn("side", no).select("key", "i", "j", "side", "class", "signs"))
        edges = edges.unionByName(_kept_together(pairs.withColumn("first", F.lit(None).cast("long")), True).select("a", "b"))
    return edges


def _held(rows: DataFrame) -> DataFrame:
    """key, size, first, and x and s, a digest of its classes, of keys with two classes or more."""
    h = F.xxhash64("class")
    return rows.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 24)).alias("s"), F.min("class").alias("first")).where("size > 1")


def _families(classes: DataFrame) -> DataFrame:
    """node, root for every class that is kept together with another.

    A few keys of each class come first, and connect most of what belongs
    together. Of the other keys only those count under which classes of two
    roots stand. There the classes of the largest root stay where they are;
    only the others, the strangers, go on: once to the whole of that root,
    however many keys they share with it, and among themselves.
    """
    spark = classes.sparkSession
    early = lambda k: F.pmod(k, F.lit(EARLY)) == 0
    some = classes.select("class", F.explode(F.filter("keys", early)).alias("key"))
    done = staged(components(_edges(some, _held(some), classes)), "connected-early")
    release(spark)
    # A root's code orders it by the power of two of its classes, largest first: the least code of a key is its main root.
    sizes = staged(done.groupBy("root").agg((F.count("*") + 1).alias("n")), "root-sizes")
    nodes = done.unionByName(sizes.select(F.col("root").alias("node"), "root"))
    codes = nodes.join(sizes, "root").select("node", ((F.lit(62) - F.floor(F.log2("n"))).cast("long") * F.lit(1 << 57) + F.col("root")).alias("code"))
    rooted = classes.select("class", "keys").join(codes, F.col("class") == F.col("node"), "left")
    rooted = rooted.select("class", F.coalesce("code", F.lit(62 << 57) + F.col("class")).alias("code"), F.filter("keys", lambda k: ~early(k)).alias("keys"))
    rooted = staged(rooted, "rooted")
    known = rooted.select("class", "code", F.explode("keys").alias("key"))
    split = known.groupBy("key").agg(F.min("code").alias("main"), F.max("code").alias("high")).where("main < high").select("key", "main")
    split = staged(split, "split-keys")
    strangers = staged(known.join(split, "key").where("code <> main").select("class", "key", "code", "main"), "strangers")
    drop_staged(split, sizes)
    release(spark)
    to_main = _with_roots(strangers.select("class", "main").distinct(), rooted.select("class", F.col("code").alias("main")), classes)
    apart = strangers.groupBy("key").agg(F.min("code").alias("low"), F.max("code").alias("high")).where("low < high").select("key")
    among = strangers.select("class", "key").join(staged(apart, "apart-keys"), "key")
    among = staged(among, "among-strangers")
    edges = staged(to_main.unionByName(_edges(among, _held(among), classes)), "found-edges")
    drop_staged(rooted, strangers, among)
    release(spark)
    return components(edges.unionByName(done.select(F.col("root").alias("a"), F.col("node").alias("b"))))


def _with_roots(asks: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: strangers (class, main) that are like one of the members (class, main); both sides in tiles, so no task meets a whole root."""
    asks = staged(asks, "asks")
    parts = staged(asks.groupBy("main").agg(F.ceil(F.count("*") / KEY_TILE).cast("int").alias("parts")), "parts")
    members = staged(members.join(parts, "main"), "members")
    tiles = staged(members.groupBy("main").agg(F.ceil(F.count("*") / KEY_TILE).cast("int").alias("tiles"), F.max("parts").alias("parts")), "tiles")
    no, group = F.lit(0), F.xxhash64("main").alias("key")
    ours = asks.join(tiles, "main").withColumns({"side": F.lit(1), "i": F.pmod(F.xxhash64("class", F.lit(2)), F.col("parts")).cast("int"), "j": F.explode(F.sequence(no, F.col("tiles") - 1))})
    theirs = members.drop("parts").join(tiles, "main").withColumns({"side": no, "i": F.explode(F.sequence(no, F.col("parts") - 1)), "j": F.pmod(F.xxhash64("class", F.lit(1)), F.col("tiles")).cast("int")})
    columns = [group, "i", "j", "side", "class"]
    pairs = ours.select(*columns).unionByName(theirs.select(*columns)).join(classes.select("class", "signs"), "class")
    pairs = pairs.select("key", "i", "j", "side", "class", "signs", F.lit(None).cast("long").alias("first"))
    return _kept_together(pairs, True).where("b IS NOT NULL").select("a", "b")


class Tree:
    """Nodes over sets in order of size: first and last leaf, bitmap, least and most shingles, most shingles beyond bits."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        n = len(sets)
        size = np.array([len(s) for s in sets])
        maps = np.zeros((n, bits), bool)
        for k, s in enumerate(sets):
            maps[k, (s % U(bits)).astype(np.int64)] = True
        spare = size - maps.sum(1)
        self.levels = [(np.arange(n), np.arange(1, n + 1), np.packbits(maps, axis=1), size, size, spare)]
        while len(self.levels[-1][0]) > 1:
            first, last, maps, low, high, spare = self.levels[-1]
            cut = np.arange(0, len(first), _ARITY)
            ends = np.append(cut[1:], len(first)) - 1
            self.levels.append((first[cut], last[ends], np.bitwise_or.reduceat(maps, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(spare, cut)))


def linked(a: np.ndarray, b: np.ndarray, similar: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= similar * (len(a) + len(b) - both)


def connect(sets: list[np.ndarray], group: np.ndarray, similar: int, others: tuple[list[np.ndarray], np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that connect sets not yet of one group, as far as needed: (x, y) positions.

    ``others``: a second list of sets and their groups, gone through against the
    first; without it the sets are gone through against themselves.
    """
    own = others is None
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    right, right_group = (sets, group) if own else others
    right_order = order if own else np.argsort(np.array([len(s) for s in right]), kind="stable")
    bits = 1 << int(np.ceil(np.log2(4 * max(64, size.max(), *(len(s) for s in right)) if len(right) else 256)))
    bits = min(bits, 1 << 16)
    x_tree = Tree([sets[k] for k in order], bits)
    y_tree = x_tree if own else Tree([right[k] for k in right_order], bits)
    xg = group[order].copy()
    yg = xg if own else right_group[right_order].copy()
    out = []
    stack = [(len(x_tree.levels) - 1, 0, len(y_tree.levels) - 1, 0)]
    while stack:
        xl, x, yl, y = stack.pop()
        xf, xe, xm, x_low, x_high, x_spare = (c[x] for c in x_tree.levels[xl])
        yf, ye, ym, y_low, y_high, y_spare = (c[y] for c in y_tree.levels[yl])
        if own and xf >= ye:
            continue  # the mirrored pair
        if 100 * x_high < similar * y_low or 100 * y_high < similar * x_low:
            continue
        one = xg[xf]
        if (xg[xf:xe] == one).all() and (yg[yf:ye] == one).all():
            continue
        most = int(np.bitwise_count(xm & ym).sum()) + min(x_spare, y_spare)
        if (100 + similar) * most < similar * (x_low + y_low):
            continue
        if xl == 0 and yl == 0:
            if own and xf == yf:
                continue
            if linked(sets[order[xf]], right[right_order[yf]], similar):
                out.append((int(order[xf]), int(right_order[yf])))
                was, now = yg[yf], xg[xf]
                xg[xg == was] = now
                yg[yg == was] = now
            continue
        if yl == 0 or (xl > 0 and xl >= yl):
            children = range(x * _ARITY, min((x + 1) * _ARITY, len(x_tree.levels[xl - 1][0])))
            if own and xl == yl and x == y:
                stack += [(xl - 1, c, yl - 1, d) for c in children for d in children if d >= c]
            else:
                stack += [(xl - 1, c, yl, y) for c in children]
        else:
            stack += [(xl, x, yl - 1, c) for c in range(y * _ARITY, min((y + 1) * _ARITY, len(y_tree.levels[yl - 1][0])))]
    return out


def _sets(column: pa.Array, width: int) -> list[np.ndarray]:
    offsets, data = text_bytes(column)
    out = []
    for i, j in slices(offsets):
        values, at = shingle_sets(Words(offsets[i : j + 1], data, lower=True), width)
        out += [values[s:e].copy() for s, e in zip(at[:-1], at[1:], strict=True)]
    return out


def _first_round(tiles: DataFrame, width: int, similar: int) -> DataFrame:
    """family, tile, class, tiles, first, text -> class, root, tiles, first: connected inside each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 2):
            names, firsts = g.column(2).to_pylist(), g.column(4).to_pylist()
            kept = sorted(dict(zip(reversed(names), reversed(range(len(names))), strict=True)).values())  # equal rows of one class: once
            names = [names[k] for k in kept]
            sets = _sets(g.column(5).take(pa.array(kept)), width)
            group = np.arange(len(names))
            for x, y in connect(sets, group.copy(), similar):
                group[group == group[y]] = group[x]
            first = firsts[0]
            root: dict[int, int] = {}
            for k, name in zip(group.tolist(), names, strict=True):
                root[k] = first if first in (name, root.get(k)) else min(name, root.get(k, name))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([root[k] for k in group.tolist()], pa.int64()), pa.array([g.column(3)[0].as_py()] * len(names), pa.int32()), pa.array([first] * len(names), pa.int64())], ["class", "root", "tiles", "first"])

    return tiles.repartition(tasks(tiles.sparkSession), "family", "tile").sortWithinPartitions("family", "tile", "class").mapInArrow(run, "class long, root long, tiles int, first long")


def _second_round(pairs: DataFrame, width: int, similar: int) -> DataFrame:
    """family, i, j, apart, class, root, text -> a, b: roots that a link joins, of classes still apart with all of a tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for g in groups(batches, 3):
            apart = g.column(3).to_numpy(zero_copy_only=False).astype(bool)
            roots = g.column(5).to_pylist()
            number = {r: k for k, r in enumerate(sorted(set(roots)))}
            group = np.array([number[r] for r in roots])
            x, y = np.flatnonzero(apart), np.flatnonzero(~apart)
            if not len(x) or not len(y):
                continue
            sets = _sets(g.column(6), width)
            for p, q in connect([sets[k] for k in x], group[x], similar, ([sets[k] for k in y], group[y])):
                a.append(roots[x[p]])
                b.append(roots[y[q]])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return pairs.repartition(tasks(pairs.sparkSession), "family", "i", "j").sortWithinPartitions("family", "i", "j", "apart", "class").mapInArrow(run, "a long, b long")


def _connected(texts: DataFrame, classes: DataFrame, width: int, similar: int) -> DataFrame:
    """class, root: the connected classes of each family."""
    families = _families(classes).select(F.col("node").alias("class"), F.col("root").alias("family"))
    families = staged(families.unionByName(families.select(F.col("family").alias("class"), "family").distinct()), "families")
    size = staged(families.groupBy("family").agg(F.ceil(F.count("*") / FAMILY_TILE).cast("int").alias("tiles")), "family-sizes")
    members = families.join(size, "family").join(classes.select("class", "doc", "body"), "class")
    members = members.withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int"))
    members = staged(texts.join(members, ["doc", "body"]).select("family", "tile", "class", "tiles", "text").dropDuplicates(["class"]), "families-texts")
    # A family is named after its first class, which goes to all its tiles.
    all_tiles = F.when(F.col("class") == F.col("family"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("tile"))
    tiles = members.withColumn("tile", F.explode(all_tiles)).select("family", "tile", "class", "tiles", F.col("family").alias("first"), "text")
    found = staged(_first_round(tiles, width, similar).groupBy("class").agg(F.max_by("root", (F.col("root") == F.col("first")).cast("int")).alias("root"), F.max("tiles").alias("tiles"), F.max("first").alias("first")), "first-round")
    apart = staged(found.where("tiles > 1 AND root <> first").select("class", "first"), "apart")
    if apart.isEmpty():
        return found.select("class", "root")
    groups_apart = apart.groupBy("first").agg(F.ceil(F.count("*") / FAMILY_TILE).cast("int").alias("parts"))
    rows = members.where("tiles > 1").join(found.select("class", "root"), "class").join(groups_apart, F.col("family") == F.col("first")).drop("first")
    ours = rows.join(apart.select("class"), "class").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    ours = ours.select("family", F.pmod(F.xxhash64("class", F.lit(2)), F.col("parts")).cast("int").alias("i"), "j", F.lit(1).alias("apart"), "class", "root", "text")
    theirs = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("family", "i", F.col("tile").alias("j"), F.lit(0).alias("apart"), "class", "root", "text")
    joined = staged(components(_second_round(ours.unionByName(theirs), width, similar)).withColumnRenamed("root", "to"), "joined")
    return found.join(joined, found["root"] == joined["node"], "left").select("class", F.coalesce("to", "root").alias("root"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("body"), text.alias("text"))


def _rooted(docs: DataFrame, width: int, similar: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Profiles of all documents; class, doc, body (its first document) and root of all classes."""
    texts = _texts(docs, id_col, text_col)
    profiles = staged(_profiles(texts, width), "profiles")
    classes = profiles.where("n > 0").groupBy("class").agg(F.min(F.struct("doc", "body", "signs", "keys")).alias("x")).select("class", "x.*")
    # Classes are numbered for what follows; the numbers are pinned by the table.
    classes = staged(classes.withColumn("number", F.monotonically_increasing_id()), "classes")
    release(docs.sparkSession)
    roots = _connected(texts, classes.withColumn("class", F.col("number")), width, similar).select(F.col("class").alias("c"), F.col("root").alias("r"))
    roots = classes.select("class", "doc", "body", "number").join(roots, F.col("number") == F.col("c"), "left").select("class", "doc", "body", F.coalesce("r", "number").alias("root"))
    roots = staged(roots, "roots")
    drop_staged(classes)
    release(docs.sparkSession)
    return profiles, roots


def one_of_each(docs: DataFrame, width: int, similar: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one stays for each component: that of the least id; all columns, whatever their names.

    Texts without words, and null texts, are no copies of each other and stay.
    Null ids come after all others. Of rows alike in id and text one stays,
    that whose other columns have the least hash; an empty table gives no rows.
    """
    profiles, roots = _rooted(docs, width, similar, id_col, text_col)
    first = roots.groupBy("root").agg(F.min(F.struct("doc", "body")).alias("key")).select("key")
    first = first.unionByName(profiles.where("n = 0").select(F.struct("doc", "body").alias("key")).distinct())
    rows = docs.select(whole_row(docs).alias("row"), F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("body")).alias("key"))
    chosen = rows.join(first, "key").groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return chosen.select("row.*")


def link_documents(docs: DataFrame, width: int = SHINGLE, similar: int = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_shingles, component_id, class (binary).

    Words are lower-cased (A-Z); sets are of distinct ``width``-word shingles,
    or the whole of a shorter text; two documents are linked if the shared
    shingles are ``similar`` per cent of all of the two or more. component_id:
    the least id reachable by links. Texts that are null or without words have
    no shingles, no links and their own id. Null ids are the last in order, so
    a component has a null id only if all its ids are null. Equal rows are in
    one component; an empty table gives no rows. No other columns are read.
    """
    profiles, roots = _rooted(docs, width, similar, id_col, text_col)
    least = staged(roots.groupBy("root").agg(F.min("doc").alias("least")), "least")
    roots = staged(roots.join(least, "root").select("class", "least"), "least-of-class")
    rows = profiles.select("doc", "class", "n").join(roots, "class", "left")
    return rows.select(F.nullif("doc", F.lit(_LAST)).alias(id_col), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("least", "doc"), F.lit(_LAST)).alias("component_id"), "class")
