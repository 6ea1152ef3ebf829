"""Plain versions of the operators' contracts, row by row."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def decontaminate(docs, bench):
    wins = defaultdict(set)
    for item, text in bench:
        w = FOLDED.findall((text or "").translate(LOWER))
        m = min(13, len(w))
        for k in range(len(w) - m + 1) if m else ():
            wins[tuple(w[k : k + m])].update({str(item)} if item is not None else ())
    lens = {len(x) for x in wins}
    out = []
    for doc, text in docs:
        w = FOLDED.findall((text or "").translate(LOWER))
        hit, items = set(), set()
        for m in lens:
            for k in range(len(w) - m + 1):
                if (x := wins.get(tuple(w[k : k + m]))) is not None:
                    hit.update(range(k, k + m))
                    items |= x
        out.append((doc, len(w), len(hit), len(items), sha(",".join(sorted(items))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(docs):
    fps = [(d, fingerprint(t)) for d, t in docs]
    nodes = sorted({f for _, f in fps})
    up = {f: f for f in nodes}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                up[root(a)] = root(b)
    least = {}
    for d, f in fps:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return [(d, f"{f:016x}", least.get(root(f))) for d, f in fps]


def quality(docs):
    out = []
    for d, t in docs:
        t = t or ""
        w = WORD.findall(t)
        seen, dup = [], 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.append(line)
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        many = Counter(g)
        rep = len({j for i, x in enumerate(g) if many[x] > 1 for j in range(i, i + 3)})
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, rep, len(w) < 50 or 100 * rep > 50 * len(w)))
    return out


def quality_threshold(docs, labels, buckets_of):
    """The threshold of (doc_id, text) and (doc_id, quality): every labelled document that passes the base rules, its own counts taken out."""
    size = 10_000
    good, bad = ({d for d, q in labels if q == y and d is not None} for y in (1, 0))
    own = [np.bincount(buckets_of(t), minlength=size) for _, t in docs]
    raw, trusted = sum(own), sum((n for n, (d, _) in zip(own, docs) if d in good), np.zeros(size))
    scores = {1: [], 0: []}
    for n, (d, _), base in zip(own, docs, quality(docs)):
        if base[-1] or d not in good | bad:
            continue
        t, r = trusted - n * (d in good), raw - n
        s = (n * (np.log((t + 1) / (t.sum() + size)) - np.log((r + 1) / (r.sum() + size)))).sum() / n.sum()
        for y, ids in ((1, good), (0, bad)):
            scores[y] += [s] * (d in ids)
    spare = np.quantile(scores[1], 0.01)
    if not scores[0]:
        return spare
    at = sorted({*scores[1], *scores[0]})
    gain = [np.mean(np.array(scores[0]) < x) - np.mean(np.array(scores[1]) < x) for x in at]
    best = int(np.argmax(gain))
    return min(spare, (at[max(best - 1, 0)] + at[best]) / 2)


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def pii(docs):
    out = []
    for d, t in docs:
        spans, counts = [], []
        for kind, (rule, ok) in PII.items():
            found = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(rule, t or "") if ok(m[0])]
            counts.append(len(found))
            spans += found
        out.append((d, *counts, sha(",".join(spans))))
    return out
