"""Plain restatements of the operators."""

import re
import string

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def word_list(text):
    return WORD.findall((text or "").translate(LOWER))


def shingle_set(text, k=5):
    w = word_list(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_groups(docs, t=0.8):
    """docs: (id, text) with different ids. id: (class_id, class_size, n_links, group_id)."""
    classes = {}
    for i, text in sorted(docs):
        s = shingle_set(text)
        classes.setdefault(s if s else (text or ""), []).append(i)
    reps = [(v[0], k, v) for k, v in classes.items()]
    links, root = {r[0]: 0 for r in reps}, {r[0]: r[0] for r in reps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(reps)):
        for b in range(a + 1, len(reps)):
            x, y = reps[a][1], reps[b][1]
            if isinstance(x, str) or isinstance(y, str) or min(len(x), len(y)) < t * max(len(x), len(y)):
                continue
            n = len(x & y)
            if n >= t * (len(x) + len(y) - n) - 1e-9:
                links[reps[a][0]] += 1
                links[reps[b][0]] += 1
                p, q = find(reps[a][0]), find(reps[b][0])
                root[max(p, q)] = min(p, q)
    return {i: (r, len(v), links[r], find(r)) for r, _, v in reps for i in v}


def hits(text, items, n=10):
    """(words, hit words, ids found) of a text; items: (id, text)."""
    w = word_list(text)
    hit, found = set(), set()
    for i, t in items:
        v = word_list(t)
        if not v:
            continue
        k = min(n, len(v))
        wins = {tuple(v[p : p + k]) for p in range(len(v) - k + 1)}
        for p in range(len(w) - k + 1):
            if tuple(w[p : p + k]) in wins:
                hit |= set(range(p, p + k))
                found.add(i)
    return len(w), len(hit), found
