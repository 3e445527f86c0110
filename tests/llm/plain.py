"""Plain single-process versions of the operators, for comparison on small tables."""

import math
import re
from collections import Counter, defaultdict

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTER_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern=SPACE_WORD, lower=True):
    text = text or ""
    return pattern.findall(text.translate(LOWER) if lower else text)


def contamination(docs, items, length=10):
    """docs, items: [(id, text)] -> [(id, n_words, n_hit, sorted item ids as strings)]"""
    windows = defaultdict(set)
    for item, text in items:
        w = words(text, LETTER_WORD)
        n = min(length, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for ident, text in docs:
        w, hit, found = words(text, LETTER_WORD), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                own = windows.get(tuple(w[i:i + n]))
                if own:
                    found |= own
                    hit |= set(range(i, i + n))
        out.append((ident, len(w), len(hit), sorted(found)))
    return out


def kept_lines(docs, min_chars=20, enough=3):
    """[(id, text)] -> [(id, n_lines, n_dropped, kept text)]"""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for ident, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(ident)
    rank = lambda i: (i is not None, i or 0)
    out = []
    for ident, text in docs:
        lines = (text or "").split("\n")
        keep = [x for x in lines if len(holders.get(key(x), ())) < enough or max(holders[key(x)], key=rank) == ident]
        out.append((ident, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def shingles(text, size=2):
    w = words(text)
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def components(docs, per_cent=80, size=2):
    """[(id, text)] with distinct ids -> {id: (n_shingles, component)}"""
    sets = {i: shingles(t, size) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= per_cent * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in sets}


def text_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    text = text or ""
    w = words(text, lower=False)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i:i + 3])].append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def base_scores(docs, held_out):
    """[(id, text)], a predicate -> ([(n_tokens, n_known, score)], N) with exact counts"""
    tokens = [[*words(t), None] for _, t in docs]
    c = Counter(x for (i, _), own in zip(docs, tokens) if not held_out(i) for x in own)
    n, v = sum(c.values()), len(c)
    d = n + 0.5 * (v + 1)
    return [(len(own), sum(c[x] > 0 for x in own), sum(math.log10((c[x] + 0.5) / d) for x in own)) for own in tokens], n


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """{source: size} -> {source: target} by repeated sharing of the excess"""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, full = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in full]
        left = budget - sum(full.values())
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total >= cap * sizes[s]]
        if not over:
            return full | {s: left * weight[s] / total for s in free}
        full |= {s: cap * sizes[s] for s in over}
        if len(full) == len(order):
            return full
