"""Plain versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def base_statistics(text):
    ws, text = words(text), text or ""
    windows = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    seen = Counter(windows)
    covered = {k for i, w in enumerate(windows) if seen[w] > 1 for k in range(i, i + 5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def without_repeats(rows, width=50):
    low = -(1 << 63)
    first = {}
    for i, text in rows:
        ws = words(text)
        for s in range(len(ws) - width + 1):
            w = tuple(ws[s : s + width])
            first[w] = min(first.get(w, 1 << 70), low if i is None else i)
    out = []
    for i, text in rows:
        ws = words(text)
        gone = set()
        for s in range(len(ws) - width + 1):
            if first[tuple(ws[s : s + width])] < (low if i is None else i):
                gone |= set(range(s, s + width))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, width):
    ws = words((text or "").translate(LOWER))
    return {tuple(ws[k : k + width]) for k in range(len(ws) - width + 1)} if len(ws) >= width else {tuple(ws)} if ws else set()


def linked(rows, width=4, similar=85):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= similar * (len(sets[a]) + len(sets[b]) - n):
                parent[find(a)] = find(b)
    last = 1 << 62
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), last), last if i is None else i)
    return [(i, len(sets[k]), None if least[find(k)] == last else least[find(k)]) for k, (i, _) in enumerate(rows)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def verdicts(rows, floors, cutoff, consistent, shrink, few):
    """kept and distance of (id, text, lang, source), by plain concentration steps on gathered groups."""
    floors = np.array(floors) ** 2
    stats = {k: base_statistics(t) for k, (_, t, _, _) in enumerate(rows)}
    lines = {k: sum(bool(WORD.search(x)) for x in (t or "").split("\n")) for k, (_, t, _, _) in enumerate(rows)}
    good = [k for k, s in stats.items() if s[0] >= 10 and 100 * s[4] <= 20 * s[0]]
    x = {k: np.array([np.log(stats[k][1] / stats[k][0]), *(np.sqrt(a / b) for a, b in ((stats[k][2], stats[k][0]), (stats[k][3], max(lines[k], 1)), (stats[k][4], stats[k][0])))]) for k in good}

    def floored(cov, n):
        own = np.maximum(np.diag(cov), 0)
        scale = np.sqrt(np.minimum(1, own / floors))
        cov = cov * np.outer(scale, scale) * n / (n + few)
        np.fill_diagonal(cov, np.maximum(own, floors))
        return cov

    def distances(v, mean, cov):
        d = v - mean
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)

    def least(v):
        h = len(v) * 0.5
        middle = np.median(v, axis=0)
        width = (np.quantile(v, 0.84, axis=0) - np.quantile(v, 0.16, axis=0)) / 2
        found = []
        for mean, cov in ((middle, np.diag(floors)), (middle, np.diag(np.maximum(width**2, floors))), (v.mean(0), floored(np.cov(v.T, bias=True) if len(v) > 1 else np.zeros((len(floors),) * 2), len(v)))):
            for _ in range(40):
                order = np.argsort(distances(v, mean, cov), kind="stable")
                w = np.zeros(len(v))
                w[order] = np.clip(h - np.arange(len(v)), 0, 1)
                mean = w @ v / h
                cov = floored(((v - mean).T * w) @ (v - mean) / h * consistent, h)
            found.append((np.linalg.slogdet(cov)[1], mean, cov))
        return min(found, key=lambda f: f[0])[1:]

    def mixed(n, own, to):
        w = n / (n + shrink)
        return w * own[0] + (1 - w) * to[0], w * own[1] + (1 - w) * to[1]

    groups = {}
    for k in good:
        for name in ((), rows[k][2:3], rows[k][2:4]):
            groups.setdefault(name, []).append(k)
    own = {name: least(np.stack([x[k] for k in ks])) for name, ks in groups.items()}
    out = {}
    for k in range(len(rows)):
        if k not in x:
            out[k] = (False, None)
            continue
        lang, both = rows[k][2:3], rows[k][2:4]
        mean, cov = mixed(len(groups[both]), own[both], mixed(len(groups[lang]), own[lang], own[()]))
        d = float(distances(x[k][None], mean, cov)[0])
        out[k] = (d <= cutoff, d)
    return out
