"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def licenses(text):
    """(n_words, n_base, first, last, labels) of the phrases."""
    w = ALNUM.findall(lower(text))
    hits = [
        (i, label)
        for phrase, label in PHRASES.items()
        for i in range(len(w))
        if w[i : i + len(phrase.split())] == phrase.split()
    ]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def tokens(rows, encode):
    """doc_id -> (start, n, crc), for distinct ids."""
    out, start = {}, 0
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        ids = [*encode(text or ""), 0]
        out[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    return out


def unigram(rows):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score)"""
    split = {i: [*SPACED.findall(lower(text)), None] for i, text in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in split}
    counts = Counter(w for i, ws in split.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {
        i: (held[i], len(ws), sum(counts[w] > 0 for w in ws), n,
            sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        for i, ws in split.items()
    }


def fingerprint(text):
    w = SPACED.findall(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, bits=4):
    """id -> smallest id reachable over links of at most ``bits`` bits."""
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], dtype=np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= bits):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def shingles(text, size=5):
    w = SPACED.findall(lower(text))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def linked(values, near):
    """id -> smallest id reachable over links of values that are near each other."""
    root = {i: i for i in values}
    for i in sorted(values):
        for j in sorted(values):
            if i < j and near(values[i], values[j]):
                old, new = sorted((root[i], root[j]))[::-1]
                root = {k: new if r == old else r for k, r in root.items()}
    return root


def repeats(rows, window=35):
    """Per row: (n_words, n_removed, sha256 of the kept words)."""
    split = [SPACED.findall(text or "") for _, text in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def passages(rows, items, window=13):
    """doc_id -> (n_words, n_hit, sorted item ids)"""
    places = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text))
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            places[tuple(w[i : i + n])].add(str(item))
    sizes = {len(p) for p in places}
    out = {}
    for doc, text in rows:
        w = ALNUM.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if at := places.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= at
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def buckets(text, size=10_000):
    """(n_words, bucket of every run of one to three words)"""
    w = ALNUM.findall(lower(text))
    runs = [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    return len(w), [zlib.crc32(r.encode()) % size for r in runs]


def resampled(rows, target, percent=5, least=20):
    """[(doc_id, n_features, weight, score, rank)], for distinct ids."""
    found = {i: buckets(t) for i, t in rows}
    s, t = Counter(b for _, bs in found.values() for b in bs), Counter(b for text in target for b in buckets(text)[1])
    all_s, all_t = s.total() + 10_000.0, t.total() + 10_000.0
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(10_000)]
    out = []
    for i, (n, bs) in found.items():
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs)
        out.append((i, n, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0]))
    rank = {r[0]: k for k, r in enumerate(able[: percent * len(able) // 100], start=1)}
    return sorted(((i, f, w, score, rank.get(i)) for i, _, f, w, score in out), key=str)


def rebuilt(rows):
    """conv_id -> its turns (role, text), with the head taken from conversation c - c % 100."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:]
    return out


def trie(sequences):
    """Sorted rows of the trie's nodes, in the order of the contract's columns."""
    members, ends = defaultdict(set), defaultdict(list)
    for c, ts in sequences.items():
        ends[tuple(ts)].append(c)
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].add(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, ms in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(ms) - 1) * len(k[-1][1]) if k else 0
    return sorted(
        (
            (min(ms), len(k), min(members[k[:-1]]) if k else None, len(ms), children[k], leaves[k], saved[k],
             hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())
            for k, ms in members.items()
        ),
        key=str,
    )
