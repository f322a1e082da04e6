"""Plain Python definitions the operators are tested against."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import tiktoken
import xxhash


def rows(spark, sf_dir, name):
    return [r.asDict() for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]


def fold(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ── SimHash ─────────────────────────────────────────────────────────────────
def simhash(text, k=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs, max_bits=2):
    """(id, fingerprint) list -> smallest id reachable, per row."""
    prints = sorted({f for _, f in pairs})
    arr = np.array(prints, dtype=np.uint64)
    low = {f: min((i for i, g in pairs if g == f and i is not None), default=math.inf) for f in prints}
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, f in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1:] ^ arr[i]) <= max_bits):
            a, b = find(f), find(prints[i + 1 + j])
            if a != b:
                root[max(a, b)] = min(a, b)
    best = defaultdict(lambda: math.inf)
    for f in prints:
        best[find(f)] = min(best[find(f)], low[f])
    return [None if best[find(f)] == math.inf else best[find(f)] for _, f in pairs]


# ── decontamination ─────────────────────────────────────────────────────────
def ngram_words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def contamination(docs, items, window=10):
    wins = defaultdict(set)
    for i, text in items:
        ws = ngram_words(text)
        n = min(window, len(ws))
        for k in range(len(ws) - n + 1 if n else 0):
            wins[tuple(ws[k:k + n])].add(i)
    sizes = {len(w) for w in wins}
    out = []
    for i, text in docs:
        ws, hit, found = ngram_words(text), set(), set()
        for n in sizes:
            for k in range(len(ws) - n + 1):
                if (w := tuple(ws[k:k + n])) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[w] - {None}
        out.append((i, len(ws), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


# ── personal data ───────────────────────────────────────────────────────────
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                  "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def written(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# ── tokens ──────────────────────────────────────────────────────────────────
def encoding(path, pattern):
    pairs = [line.split() for line in open(path, "rb") if line.strip()]
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


# ── BM25 ────────────────────────────────────────────────────────────────────
def bm25(docs, queries, k=10, k1=1.2, b=0.75):
    """docs, queries: (id, text) lists -> {query: [(doc, score), ...]}."""
    bags = [(i, Counter(ngram_words(t))) for i, t in docs]
    n, mean = len(bags), sum(sum(c.values()) for _, c in bags) / max(len(bags), 1)
    df = Counter(w for _, c in bags for w in c)
    out = {}
    terms = defaultdict(set)
    for i, t in queries:
        terms[i] |= set(ngram_words(t))
    for q, ws in terms.items():
        scored = []
        for i, c in bags:
            length = sum(c.values())
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * length / mean))
                    for w in sorted(ws & c.keys()))
            if s > 0 and i is not None:
                scored.append((-round(s, 9), i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


# ── n-gram Jaccard ──────────────────────────────────────────────────────────
def shingle_set(text, k=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard_groups(docs, percent=80, k=5):
    """(id, text) list -> (id, size, smallest id reachable) per row."""
    sets = [shingle_set(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    low = defaultdict(lambda: math.inf)
    for i, (name, _) in enumerate(docs):
        low[find(i)] = min(low[find(i)], math.inf if name is None else name)
    return [(name, len(sets[i]), None if low[find(i)] == math.inf else low[find(i)]) for i, (name, _) in enumerate(docs)]


# ── spelling variants ───────────────────────────────────────────────────────
def corpus_words(docs, min_length=6, min_count=5, every=199):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def spelling_variants(n, ratio=5):
    """{word: count} -> {word: (form, root, n, n_near, form_n)}."""
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None)
    return out


# ── clustering ──────────────────────────────────────────────────────────────
def kmeans(rows, dim=64, k=40, rounds=5, scale=256, seed=2):
    """(id, vector) list -> (id, cluster, distance, cluster inertia, inertia, sha) per kept row, in Python integers."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (sha(f"{seed}:{'' if r[0] is None else r[0]}"), r[1]))
    cents = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        members = defaultdict(list)
        for (_, v), (_, j) in zip(kept, assign()):
            members[j].append(v)
        cents = [[sum(x) // len(members[j]) for x in zip(*members[j])] if j in members else c for j, c in enumerate(cents)]
    last = assign()
    part = Counter()
    for d, j in last:
        part[j] += d
    return [(i, j, d, part[j], sum(part.values()), sha(",".join(map(str, cents[j])))) for (i, _), (d, j) in zip(kept, last)]


def word_counts(texts, pattern):
    import collections

    import regex

    return dict(collections.Counter(w for t in texts for w in regex.findall(pattern, t or "")))
