"""Plain versions of the ten contracts, for small tables."""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from tokenizers import Tokenizer


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def cosine_links(vectors, threshold=0.95):
    """{vec_id: (n_links, component)}"""
    good = {i: np.array(v, float) for i, v in vectors.items() if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    width = max((len(good[i]) for i in ids), default=0)
    units = np.array([np.pad(good[i] / np.linalg.norm(good[i]), (0, width - len(good[i]))) for i in ids]).reshape(len(ids), width)
    near = units @ units.T >= threshold
    pairs = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a < b]
    counts = Counter(x for p in pairs for x in p)
    roots = components(vectors, pairs)
    return {i: (counts[i], roots[i]) for i in vectors}


def token_ids(texts, path):
    tokenizer = Tokenizer.from_file(path)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i: i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs, radius=3, width=3):
    """{doc_id: (fingerprint, component)}"""
    prints = {i: fingerprint(t, width) for i, t in docs.items()}
    ids = sorted(prints)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if (prints[a] ^ prints[b]).bit_count() <= radius]
    roots = components(ids, links)
    return {i: (f"{prints[i]:016x}", roots[i]) for i in ids}


def repeats(docs, window=50):
    """{doc_id: (n_words, n_removed, sha256)}"""
    words = {i: (t or "").encode().split() for i, t in docs.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k: k + window]), i)
    out = {}
    for i, w in words.items():
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k: k + window])] < i:
                gone[k: k + window] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest())
    return out


def base_scores(docs):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}"""
    words = {i: (t or "").encode().lower().split() for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    counts = Counter(x for i, w in words.items() if not held[i] for x in [*w, b"\n"])
    total, kinds = sum(counts.values()), len(counts)
    score = lambda t: math.log10((counts[t] + 0.1) / (total + 0.1 * (kinds + 1)))
    return {
        i: (held[i], len(w) + 1, sum(counts[t] > 0 for t in [*w, b"\n"]), total, sum(map(score, [*w, b"\n"])))
        for i, w in words.items()
    }


def targets(sizes, epochs=3):
    """{source: target} by resharing until none is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    free, left, out = set(names), float(sum(sizes.values())), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit > epochs * sizes[s]}
        for s in over or free:
            out[s] = float(epochs * sizes[s]) if over else weight[s] * unit
        left -= sum(out[s] for s in over)
        free = free - over if over else set()
    return out


RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [r for r in RULES if (host == r[0].split("/")[0] or host.endswith("." + r[0].split("/")[0])) and path.startswith(r[0][r[0].index("/"):])]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


def quality_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = defaultdict(list)
    for k in range(len(words) - 7):
        places[tuple(words[k: k + 8])].append(k)
    covered = {k + j for found in places.values() if len(found) > 1 for k in found for j in range(8)}
    n = len(words)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        n < 20 or 100 * len(covered) > 30 * n,
    )


def best_fit(lengths, capacity):
    """Number of bins of best-fit decreasing, by a sorted list of remaining capacities."""
    free: list[int] = []
    used = 0
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(free, x)
        left = free.pop(k) - x if k < len(free) else capacity - x
        used += k >= len(free) + 1 or left == capacity - x
        if left:
            bisect.insort(free, left)
    return used
