"""Plain single-process versions of the operators' results, to hold the queries against."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LICENCE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def crc(x):
    return zlib.crc32(str(x).encode())


def licences(text):
    words = LICENCE_WORD.findall((text or "").translate(LOWER))
    at, labels = [], set()
    for phrase, label in PHRASES.items():
        want = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(want)] == want]
        at += hits
        labels |= {label} if hits else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def base_scores(docs):
    """doc_id -> (held_out, n_tokens, n_known, N, base_score)."""
    toks = {i: [*SPACED.findall((t or "").translate(LOWER)), None] for i, t in docs}
    counts = Counter(w for i, ws in toks.items() if crc(i) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {i: (crc(i) % 7 == 2, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in toks.items()}


def hidden_scores(texts, learnt, word_class, m, initial, rounds):
    """(n_tokens, log10 probability) of each text under a hidden Markov model of word classes, trained
    by unscaled forward and backward sums."""
    toks = [[*SPACED.findall((t or "").translate(LOWER)), ""] for t in texts]
    of = {w: word_class(w.encode()) for ws in toks for w in ws}
    counts = Counter(w for ws, k in zip(toks, learnt) if k for w in ws)
    c, v = np.zeros(m), np.zeros(m)
    for w, n in counts.items():
        c[of[w]] += n
        v[of[w]] += 1
    base = (c + 0.5) / (c + 0.5).sum()
    p = initial(base)
    start, move, emit = p.start, p.move, p.emit
    k = len(start)

    def forward(seq):
        out = [start * emit[:, seq[0]]]
        for x in seq[1:]:
            out.append((out[-1] @ move) * emit[:, x])
        return out

    for _ in range(rounds):
        begun, moved, emitted = np.zeros(k), np.zeros((k, k)), np.zeros((k, m))
        for ws, known in zip(toks, learnt):
            if not known:
                continue
            seq = [of[w] for w in ws]
            ahead, total = forward(seq), forward(seq)[-1].sum()
            back = np.ones(k)
            for t in range(len(seq) - 1, -1, -1):
                emitted[:, seq[t]] += ahead[t] * back / total
                if t:
                    moved += np.outer(ahead[t - 1], emit[:, seq[t]] * back) * move / total
                    back = move @ (emit[:, seq[t]] * back)
                else:
                    begun += ahead[0] * back / total
        emitted += 0.5 * k * base
        start, move, emit = ((x + a) / (x + a).sum(axis=-1, keepdims=True) for x, a in ((begun, 0.1), (moved, 0.1), (emitted, 0)))
    words = lambda w: math.log10((counts[w] + 1) / (c[of[w]] + v[of[w]] + 1))
    return [(len(ws), math.log10(forward([of[w] for w in ws])[-1].sum()) + sum(map(words, ws))) for ws in toks]


def quality(text):
    text = text or ""
    words = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def fingerprint(text):
    words = SPACED.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, linked):
    """Smallest id reachable for each id, given pairs."""
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def simhash_groups(docs):
    fps = [(i, fingerprint(t)) for i, t in docs]
    pairs = [(a, b) for k, (a, x) in enumerate(fps) for b, y in fps[k + 1 :] if (x ^ y).bit_count() <= 4]
    return dict(fps), groups([i for i, _ in fps], pairs)


def embedding_links(rows, threshold=0.93):
    """rows: (id, label, vector) -> id -> (n_links, component)."""
    good = []
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = np.array(v, np.float64)
        if x.any():
            good.append((i, label, x / np.sqrt(x @ x)))
    pairs = [(a, b) for k, (a, la, x) in enumerate(good) for b, lb, y in good[k + 1 :] if la == lb and len(x) == len(y) and x @ y >= threshold]
    links = Counter(i for p in pairs for i in p)
    return {i: (links[i], c) for i, c in groups([r[0] for r in rows], pairs).items()}


def chats(rows):
    """rows: (conv_id, turn, role, text) -> conv_id -> (n, turns digest, loss chars, loss digest)."""
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out
