"""Plain versions of what the operators do, a text at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def decontaminated(rows, items, window=10):
    held = defaultdict(set)
    for i, (_, t) in enumerate(items):
        w = ALNUM.findall(low(t or ""))
        for s in range(max(1, len(w) - window + 1) if w else 0):
            held[tuple(w[s : s + window])].add(i)
    for doc_id, text in rows:
        w, hit, found = ALNUM.findall(low(text or "")), set(), set()
        for n in {len(k) for k in held}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in held:
                    hit.update(range(s, s + n))
                    found |= held[k]
        ids = sorted(str(items[i][0]) for i in found if items[i][0] is not None)
        yield doc_id, len(w), len(hit), len(found), sha(",".join(ids)), bool(hit)


def near(text, phrase, slack):
    """Merged [begin, end) that hold all words of the phrase within its length and `slack` words more."""
    w, asked = ALNUM.findall(low(text or "")), ALNUM.findall(low(phrase))
    out = []
    for a in range(len(w)):
        b = next((b for b in range(a + 1, min(len(w), a + len(asked) + slack) + 1) if set(asked) <= set(w[a:b])), None)
        if asked and w[a] in asked and b is not None:
            if out and a <= out[-1][1]:
                out[-1] = out[-1][0], max(b, out[-1][1])
            else:
                out.append((a, b))
    return out


def without_repeats(rows, window=35):
    words = [PLAIN.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[s : s + window]) for w in words for s in range(len(w) - window + 1))
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = {p for s in range(len(w) - window + 1) if seen[tuple(w[s : s + window])] > 1 for p in range(s, s + window)}
        yield doc_id, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def shingles(text, n=5):
    w = PLAIN.findall(low(text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def similar(rows, threshold=0.8):
    """For each row: least id of its text, links, group."""
    texts = sorted({t or "" for _, t in rows})
    sets = {t: shingles(t) for t in texts}
    size = Counter(t or "" for _, t in rows)
    least = {t: min((d for d, x in rows if (x or "") == t and d is not None), default=None) for t in texts}
    near, root = defaultdict(set), {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in combinations(texts, 2):
        both = len(sets[a] & sets[b])
        if both and both >= threshold * len(sets[a] | sets[b]) - 1e-9:
            near[a].add(b)
            near[b].add(a)
            root[find(a)] = find(b)
    group = defaultdict(list)
    for t in texts:
        group[find(t)].append(t)
    for doc_id, t in rows:
        t = t or ""
        ids = [least[x] for x in group[find(t)] if least[x] is not None]
        yield doc_id, least[t], size[t] - 1 + sum(size[x] for x in near[t]), min(ids, default=None)


def base_scores(rows):
    count, ends = Counter(), 0
    held = [zlib.crc32(str(d if d is not None else "").encode()) % 7 == 2 for d, _ in rows]
    words = [PLAIN.findall(low(t or "")) for _, t in rows]
    for h, w in zip(held, words, strict=True):
        if not h:
            count.update(w)
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + (ends > 0)
    score = lambda c: math.log10((c + 1) / (n + v + 1))
    for (d, _), h, w in zip(rows, held, words, strict=True):
        yield d, h, len(w) + 1, sum(count[x] > 0 for x in w) + (ends > 0), n, sum(score(count[x]) for x in w) + score(ends)


def shape(word):
    """Number of a word's shape: its last byte's kind, its length's step, whether it has bytes outside ASCII."""
    data = word.encode()
    last = chr(data[-1]) if data[-1] < 128 else None
    kind = 36 if last is None else ord(last) - 97 if "a" <= last <= "z" else 26 if last in "0123456789" else 27 + ".,!$#*%&".index(last) if last in ".,!$#*%&" else 35
    return (kind * 3 + (len(data) >= 5) + (len(data) >= 9)) * 2 + any(b > 127 for b in data)


def posteriors(patterns, counts, rounds, votes, documents, label_error):
    """The posterior of good of each pattern (votes -1 or 0, then a label), a pattern and a class at a time."""
    n = len(patterns[0]) - 1
    told = {1: 1 - label_error, -1: label_error}

    def spread(p, weights, good):
        return [good, *[w / sum(weights) * (1 - good) for w in weights]]

    held = []
    for p in patterns:
        weights = [(v == -1) + 0.01 for v in p[:-1]]
        held.append(spread(p, weights, told.get(p[-1], 0.1 if -1 in p[:-1] else 0.95)))
    for _ in range(rounds):
        mass = [sum(c * h[k] for c, h in zip(counts, held, strict=True)) for k in range(n + 1)]
        begun = [documents[0], *[documents[1] / n] * n]
        share = [(m + b) / (sum(mass) + sum(begun)) for m, b in zip(mass, begun, strict=True)]
        rate = []
        for k in range(n + 1):
            row = []
            for h in range(n):
                bad, silent = votes[0] if k == 0 else votes[2] if h == k - 1 else votes[1]
                row.append((sum(c * x[k] for p, c, x in zip(patterns, counts, held, strict=True) if p[h] == -1) + bad) / (mass[k] + bad + silent))
            rate.append(row)
        for h in range(n):
            rate[h + 1][h] = max(rate[h + 1][h], rate[0][h])
        now = []
        for p in patterns:
            like = [share[k] * math.prod(rate[k][h] if p[h] == -1 else 1 - rate[k][h] for h in range(n)) for k in range(n + 1)]
            now.append(spread(p, like[1:], told.get(p[-1], like[0] / sum(like))))
        held = now
    return [h[0] for h in held]
