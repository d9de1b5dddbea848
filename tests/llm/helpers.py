"""Brute-force versions of the operators."""

import hashlib
import re
from collections import Counter


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def classes(rows):
    """(n_shingles, component_id) by id."""
    sets = {}
    for d, t in rows:
        words = (t or "").encode().lower().split()
        sets.setdefault(d, set()).update(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)) if words)
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    holders = {}
    for d in ids:
        counts = {}
        for g in sets[d]:
            for other in holders.setdefault(g, []):
                counts[other] = counts.get(other, 0) + 1
            holders[g].append(d)
        for other, n in counts.items():
            if 100 * n >= 80 * (len(sets[d]) + len(sets[other]) - n):
                a, b = find(d), find(other)
                label[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in ids}


def blank(line):
    return not line.strip()


def lines_left(rows, least, threshold=lambda n: 1):
    """threshold: of edits, by the length of the shorter line."""
    first = {}
    for d, t in sorted((d, t) for d, t in rows if t is not None):
        for n, line in enumerate(t.split("\n")):
            if not blank(line):
                first.setdefault(line, (d, n))
    order = sorted((x for x in first if len(x) >= least), key=first.get)
    t = lambda x, y: threshold(min(len(x), len(y)))
    letters = {x: Counter(x) for x in order}
    apart = lambda x, y: max((letters[x] - letters[y]).total(), (letters[y] - letters[x]).total())  # no fewer edits than this
    near = {x for k, x in enumerate(order) if any(abs(len(x) - len(y)) <= t(x, y) and apart(x, y) <= t(x, y) and distance(x, y) <= t(x, y) for y in order[:k])}
    out = {}
    for d, text in rows:
        kept, seen = [], set()
        for line in (text or "").split("\n"):
            if not blank(line):
                if line in near or first[line][0] != d or line in seen:
                    continue
                seen.add(line)
            kept.append(line)
        out[d] = "\n".join(kept)
    return out


def copies(rows):
    norm = {d: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for d, t in rows}
    groups = {}
    for d, t in norm.items():
        groups.setdefault(t, []).append(d)
    return {d: (min(groups[t]), len(groups[t]), d == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in norm.items()}
