"""Plain versions of what the operators do, over Python lists."""

import hashlib
import re
import zlib
from collections import Counter


def components(n, pairs):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(texts):
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    return [len(s) for s in sets], components(len(texts), pairs)


ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def targets(sizes, weights=(1, 2, 3), cap=3):
    """Water-filling by repeated redistribution. sizes: source -> words."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full, out = sum(sizes.values()), set(), {}
    while True:
        total = sum(w[s] for s in names if s not in full)
        over = [s for s in names if s not in full and left * w[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in names if s not in full}
        for s in over:
            full.add(s)
            out[s] = cap * sizes[s]
        left = sum(sizes.values()) - sum(out.values())


def repeat_words(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len({i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)})


def runs(w):
    """(start, length, period) of maximal stretches of smallest period q and max(6, 4 * q) words at least."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if length >= max(6, 4 * q) and not any(all(w[j] == w[j + p] for j in range(s, s + length - p)) for p in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_of_text(text):
    words = (text or "").encode().split()
    found = runs(words) if len(set(words)) > 1 or len(words) < 6 else [(0, len(words), 1)]
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return found, b" ".join(x for i, x in enumerate(words) if i not in gone).decode()


def looped(doc_id, text):
    words, h = (text or "").encode().split(), zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[i if i < a else a + (i - a) % p] for i in range(n)).decode()


def run_digest(text):
    found, kept = runs_of_text(text)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept))


def collocations(texts, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for lang, text in texts:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, w), a in cand.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                key = (lang, w[i : i + m])
                inside[key] = max(inside[key], a)
    out = {}
    for (lang, w), a in cand.items():
        if 100 * inside[lang, w] >= 100 * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i): (p.decode(), -a, x, y, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)}
