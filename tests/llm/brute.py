"""Plain Python forms of the operators' results, straight from their definitions."""

import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def statistics(text):
    w, text = words(text), text or ""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(text.count(s) for s in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeated),
    }


def base_failed(text):
    s = statistics(text)
    return s["n_words"] < 20 or 100 * s["n_repeat_words"] > 30 * s["n_words"]


def fingerprint(text):
    w = words(low(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += (h >> b) & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(prints, threshold=2):
    """Index -> least index reachable by links of at most ``threshold`` differing bits."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= threshold:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def similar_components(texts, shingle=5, least=0.8):
    """Index -> least index reachable by pairs of Jaccard similarity ``least`` of word shingles."""
    sets = []
    for text in texts:
        w = tuple(words(low(text)))
        n = min(shingle, len(w))
        sets.append({w[i : i + n] for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= least * len(a | sets[j]):
                small, large = sorted((root[i], root[j]))
                root = [small if r == large else r for r in root]
    return root


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def removed_lines(docs, min_words=1, near_words=10):
    """(doc_id, text) of distinct ids -> doc_id -> numbers of the lines that go."""
    first, places = {}, []
    for doc, text in sorted(docs):
        for k, line in enumerate((text or "").split("\n")):
            w = tuple(words(line))
            if len(w) >= min_words:
                first.setdefault(w, (doc, k))
                places.append((doc, k, w))
    bound = dict(first)
    long = [w for w in first if len(w) >= near_words]
    for i, a in enumerate(long):
        for b in long[:i]:
            if abs(len(a) - len(b)) <= 1 and len(set(a) ^ set(b)) <= 2 and edits(a, b) <= 1:
                bound[a] = min(bound[a], first[b])
                bound[b] = min(bound[b], first[a])
    out = defaultdict(list)
    for doc, k, w in places:
        if (doc, k) > bound[w]:
            out[doc].append(k)
    return out


def contamination(text, items, window=10):
    """(number of words, hit word places, items hit)."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    seq, hit, found = pattern.findall(low(text)), set(), set()
    for item, item_text in items:
        w = pattern.findall(low(item_text))
        wanted = [w[k : k + window] for k in range(len(w) - window + 1)] if len(w) >= window else [w] if w else []
        for part in wanted:
            for p in range(len(seq) - len(part) + 1):
                if seq[p : p + len(part)] == part:
                    found.add(item)
                    hit.update(range(p, p + len(part)))
    return len(seq), hit, found
