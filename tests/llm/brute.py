"""Plain versions of the operators' results, for small inputs."""

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fold_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(m):
    return re.sub(r"\D", "", m.group(0))


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0, lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0, lambda m: all(int(x) <= 255 for x in m.group(0).split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", 0, lambda m: 12 <= len(_digits(m)) <= 19 and luhn(_digits(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0, lambda m: 9 <= len(_digits(m)) <= 15),
}
SECRETS = {
    "assign": (r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m.group(1)) >= 6),
    "access": (r"AKIA[A-Z0-9]+", 0, lambda m: len(m.group(0)) >= 20),
    "hex": (r"[0-9a-f]+", 0, lambda m: len(m.group(0)) >= 24),
}


def spans(text, kinds):
    found, counts = [], []
    for rank, (kind, (pattern, flags, ok)) in enumerate(kinds.items()):
        own = [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "", flags) if ok(m)]
        counts.append(len(own))
        found += own
    return (*counts, sha(",".join(x[2] for x in sorted(found))))


def rules(text):
    text = text or ""
    words = WORD.findall(text)
    seen, covered = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7)), set()
    for k in range(len(words) - 7):
        if seen[tuple(words[k : k + 8])] > 1:
            covered.update(range(k, k + 8))
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def simhash(text):
    words = WORD.findall(fold_ascii(text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def wide_simhash(text, parts=3):
    """Three words of a SimHash over the set of five-word shingles, as one integer."""
    words = [w for w in re.split("[ \t\n\v\f\r]+", fold_ascii(text or "")) if w]
    shingles = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    out, full = 0, (1 << 64) - 1
    for part in range(parts):
        counts = [0] * 64
        for s in shingles:
            h = xxhash.xxh64_intdigest(s.encode(), 42)
            for _ in range(2 if part else 0):
                h = (h ^ h >> 32 ^ part) * 0xD6E8FEB86659FD93 & full
            h ^= h >> 32 if part else 0
            for b in range(64):
                counts[b] += h >> b & 1
        out |= sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles)) << 64 * part
    return out


def wide_link(a, b, parts=3, reach=6, limit=29):
    words = [(a ^ b) >> 64 * k & (1 << 64) - 1 for k in range(parts)]
    return min(w.bit_count() for w in words) <= reach and (a ^ b).bit_count() <= limit


def components(points, near):
    """Smallest member of each point's component; ``points``: sorted (id, value)."""
    up = {i: i for i, _ in points}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(points):
        for j, b in points[k + 1 :]:
            if near(a, b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in points}


def cut(docs, window=20):
    """(n_words, n_removed, sha) by id of ``docs`` {id: text}."""
    first, out = set(), {}
    for i in sorted(docs):
        words, gone = WORD.findall(docs[i] or ""), set()
        for k in range(len(words) - window + 1):
            t = tuple(words[k : k + window])
            if t in first:
                gone.update(range(k, k + window))
            first.add(t)
        out[i] = (len(words), len(gone), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


def contamination(docs, items, window=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut_ = lambda t: pattern.findall(fold_ascii(t or ""))
    wins = {}
    for i, t in items:
        w = cut_(t)
        size = min(len(w), window)
        for k in range(len(w) - size + 1 if w else 0):
            wins.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = {}
    for i, t in docs.items():
        w, hit, got = cut_(t), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if own := wins.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    got |= own
        out[i] = (len(w), len(hit), len(got), sha(",".join(sorted(got))), bool(hit))
    return out
