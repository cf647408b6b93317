"""Plain versions of the operators, over lists of (doc_id, text) rows, for small inputs."""

import collections
import hashlib
import math
import re
import zlib

SPACE_WORD = re.compile("[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def decontamination(rows, items, size=10):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = BENCH_WORD.findall(lower(text))
        n = min(size, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows[tuple(w[i:i + n])].add(item)
    sizes = {len(k) for k in windows}
    out = []
    for i, text in rows:
        w, hit, found = BENCH_WORD.findall(lower(text)), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= {str(x) for x in windows[tuple(w[s:s + n])] if x is not None}
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)))
    return out


def substrings(rows, size=20):
    least, texts = {}, [(i, SPACE_WORD.findall(t or "")) for i, t in rows]
    order = lambda i: -math.inf if i is None else i
    for i, w in texts:
        for s in range(len(w) - size + 1):
            k = tuple(w[s:s + size])
            least[k] = min(least.get(k, math.inf), order(i))
    out = []
    for i, w in texts:
        gone, seen = [False] * len(w), set()
        for s in range(len(w) - size + 1):
            k = tuple(w[s:s + size])
            if least[k] < order(i) or k in seen:
                gone[s:s + size] = [True] * size
            seen.add(k)
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return out


def katz(rows, k=5):
    texts = [SPACE_WORD.findall(lower(t)) + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    uni, pairs, context = collections.Counter(), collections.Counter(), collections.Counter()
    for t, h in zip(texts, held):
        if not h:
            uni.update(t)
            for a, b in zip([0, *t], t):
                pairs[a, b] += 1
                context[a] += 1
    total, distinct = sum(uni.values()), len(uni)

    def discounts(counts):
        n, f = collections.Counter(counts.values()), dict.fromkeys(range(1, k + 1), 1.0)
        if all(n[r] for r in range(1, k + 2)):
            a = (k + 1) * n[k + 1] / n[1]
            for r in f:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if a != 1 else 1.0
                f[r] = d if 0 < d < 1 else 1.0
        return f

    d1, d2 = discounts(uni), discounts(pairs)
    seen = lambda f, r: f.get(r, 1.0) * r
    free = sum(r - seen(d1, r) for r in uni.values() if d1.get(r, 1.0) < 1)
    free, all_n = (free, total) if free > 0 else (1, total + 1)
    p1 = lambda w: (seen(d1, uni[w]) if uni[w] else free) / all_n
    freed, taken = collections.Counter(), collections.Counter()
    for (a, b), r in pairs.items():
        if d2.get(r, 1.0) < 1:
            freed[a] += r - seen(d2, r)
        taken[a] += p1(b)

    def p2(a, b):
        if not context[a]:
            return p1(b)
        f, c = (freed[a], context[a]) if freed[a] > 0 else (1, context[a] + 1)
        return seen(d2, pairs[a, b]) / c if pairs[a, b] else f / c / (1 - taken[a]) * p1(b)

    out = []
    for (i, _), t, h in zip(rows, texts, held):
        base = sum(math.log10((uni[w] + 1) / (total + distinct + 1)) for w in t)
        out.append((i, h, len(t), sum(uni[w] > 0 for w in t), total, round(base, 6),
                    round(sum(math.log10(p2(a, b)) for a, b in zip([0, *t], t)), 6)))
    return out, (uni, context, p1, p2)


def shingles(text, n):
    w = SPACE_WORD.findall(lower(text))
    return {tuple(w[i:i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def jaccard(rows, n=3, num=90):
    sets, top = [shingles(t, n) for _, t in rows], list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for j, both in collections.Counter(j for x in s for j in where[x]).items():
            if 100 * both >= num * (len(s) + len(sets[j]) - both):
                top[find(i)] = find(j)
        for x in s:
            where[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
       ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
       ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def pii(rows):
    out = []
    for i, t in rows:
        counts, spans = [], []
        for kind, pattern in PII:
            n = 0
            for m in re.finditer(pattern, t or ""):
                digits = re.sub("[^0-9]", "", m[0])
                if (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))
                        or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits))
                        or kind == "phone" and not 9 <= len(digits) <= 15):
                    continue
                n += 1
                spans.append(f"{kind}:{m.start()}:{m.end()}")
            counts.append(n)
        out.append((i, *counts, sha(",".join(spans).encode())))
    return out


def rule_features(rows):
    out = []
    for i, t in rows:
        w = SPACE_WORD.findall(t or "")
        grams = [tuple(w[j:j + 5]) for j in range(len(w) - 4)]
        count, twice = collections.Counter(grams), set()
        for j, g in enumerate(grams):
            if count[g] > 1:
                twice.update(range(j, j + 5))
        lines = [x for x in (t or "").split("\n") if SPACE_WORD.search(x)]
        out.append((i, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)),
                    len(twice), len(w) < 10 or 100 * len(twice) > 20 * len(w)))
    return out


def suffixes(rows, size=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(b[s:s + size] for _, b in texts for s in range(len(b) - size + 1))
    out = []
    for i, b in texts:
        gone, upto = bytearray(len(b)), 0
        for s in range(len(b) - size + 1):
            if count[b[s:s + size]] > 1:
                gone[max(s, upto):s + size] = b"\1" * (s + size - max(s, upto))
                upto = s + size
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out
