"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = [True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True, 12 <= len(d) <= 19 and luhn(d or "0"), 9 <= len(d) <= 15][kind]
            if good:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(rows, percent=75):
    """{doc_id: (n_shingles of each text, component_id)}"""
    sets = []
    for d, t in rows:
        w = words((t or "").translate(A_TO_Z))
        sets.append((d, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    inverse = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for g in s:
            inverse[g].append(i)
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, s) in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in inverse[g]:
                if j < i:
                    shared[j] += 1
        for j, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                a, b = find(d), find(sets[j][0])
                parent[max(a, b)] = min(a, b)
    return sorted((d, len(s), find(d)) for d, s in sets)


def repeats(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        covered = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                covered[i : i + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(c for c, v in zip(raw, covered, strict=True) if not v)
        spans = sum(1 for i in range(len(raw)) if covered[i] and (i == 0 or not covered[i - 1]))
        out[d] = (d, len(raw), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target} by resharing the excess until nothing is above its cap; sizes by source, in order."""
    w = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: most * sizes[s] for s in over}
