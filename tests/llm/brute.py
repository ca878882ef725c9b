"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def simhash(text, k=4):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(rows, k=4):
    """(doc_id, text) to {doc_id: (fingerprint, component)}."""
    prints = {i: simhash(t, k) for i, t in rows}
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def jaccard(rows, more=()):
    """(doc_id, text) to {doc_id: component} over all pairs of five-word similarity 0.8 at least, and more pairs."""
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}
    near_pairs = ((i, j) for i in sorted(sets) for j in sorted(sets) if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    for i, j in (*near_pairs, *more):
        if root[i] != root[j]:
            a, b = sorted((root[i], root[j]))
            root = {k: a if v == b else v for k, v in root.items()}
    return root


def near(rows):
    """The doc_ids that the near-dedup stage keeps: one of each group that SimHash classes and edited copies connect."""
    return set(jaccard(rows, [(c, i) for i, (_, c) in classes(rows, 5).items()]).values())


def substrings(texts, k=35):
    """n_words, n_removed and the digest of the kept words, for each text."""
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    seen = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    again = {j for i in range(n - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, dup, earlier = text.split("\n"), 0, set()
    for line in lines:
        if WORD.search(line):
            dup += line in earlier
            earlier.add(line)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again), n < 10 or 100 * len(again) > 20 * n


def url(u):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    host = path = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fit, key=lambda r: (len(r[1] + r[2]), len(r[1])), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


def wavelet(rows, encode, end=2):
    """(doc_id, text) in ascending order to (doc_id, start, n_tokens, crc)."""
    at, out = 0, []
    for i, t in rows:
        ids = [*encode(t or ""), end]
        out.append((i, at, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        at += len(ids)
    return out


def media(text):
    data = (text or "").encode()
    payload = data.ljust(max(1, -(-len(data) // 192)) * 192, b" ")
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])


def rake(cells, targets, rounds=40):
    """cells: {key tuple: tokens}; targets: for each position {value: mass}."""
    w = {k: float(v) for k, v in cells.items()}
    for _ in range(rounds):
        for d, goal in enumerate(targets):
            mass = defaultdict(float)
            for k, v in w.items():
                mass[k[d]] += v
            w = {k: v * goal[k[d]] / mass[k[d]] if mass[k[d]] else v for k, v in w.items()}
    return w
