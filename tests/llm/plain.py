"""Plain versions of the operators, straight from their definitions; small tables only."""

import hashlib
import re
import zlib

LOWER = {i: i + 32 for i in range(65, 91)}
WHITE = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(rows, items):
    windows = {}
    for item, text in items:
        words = item_words(text)
        size = min(10, len(words))
        if size:
            for i in range(len(words) - size + 1):
                windows.setdefault(tuple(words[i:i + size]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in rows:
        words, hit, names = item_words(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if (found := windows.get(tuple(words[i:i + size]))):
                    hit.update(range(i, i + size))
                    names |= found
        out.append((doc_id, len(words), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return out


def shingle_set(text, n):
    words = WHITE.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def near_duplicates(rows, n, percent):
    sets = [shingle_set(t, n) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and find(i) != find(j):
                if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                    common = len(a & b)
                    if 100 * common >= percent * (len(a) + len(b) - common):
                        top[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(d, len(s), least.get(find(i)), least.get(find(i)) == d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def repeats(rows, window):
    words = [WHITE.findall(t or "") for _, t in rows]
    first = {}
    for (doc_id, _), w in zip(rows, words):
        if doc_id is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i:i + window])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if doc_id is not None and first[tuple(w[i:i + window])] < doc_id:
                gone.update(range(i, i + window))
        out.append((doc_id, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def base_spans(text):
    text, found = text or "", []
    keyword = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
                       for w in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(rf"""({keyword})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 6:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m.group()) >= 20:
            found.append((m.start(), 1, f"access:{m.start()}:{m.end()}"))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m.group()) >= 24:
            found.append((m.start(), 2, f"hex:{m.start()}:{m.end()}"))
    return [f[2] for f in sorted(found)]


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def targets(sizes):
    """By filling up and sharing anew, source by source; None is last."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, full, out = sum(sizes.values()), set(), {}
    while True:
        rest = left - sum(3 * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s in share if share[s] > 3 * sizes[s]}
        if not over:
            return {**{s: 3.0 * sizes[s] for s in full}, **share}
        full |= over
