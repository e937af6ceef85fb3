"""Plain Python restatements of the contracts, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def substring_dedup(docs, size=13):
    """docs: list of (id, text) → {(id, n_words, n_removed, sha)} list in input order."""
    first = {}
    for i, t in docs:
        if i is None:
            continue
        w = words(t)
        for k in range(len(w) - size + 1):
            key = tuple(w[k:k + size])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in docs:
        w = words(t)
        cut = [False] * len(w)
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k:k + size])] < i:
                cut[k:k + size] = [True] * size
        kept = " ".join(x for x, c in zip(w, cut) if not c)
        out.append((i, len(w), sum(cut), hashlib.sha256(kept.encode()).hexdigest()))
    return out


LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, size=5):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1)))


def jaccard_classes(docs, per_cent=80):
    """docs: list of (id, text) → list of (id, n_shingles, component)."""
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    distinct = {}
    for i, s in sets:
        if s and i is not None:
            if s in distinct:
                a, b = find(distinct[s]), find(i)
                parent[max(a, b)] = min(a, b)
            else:
                distinct[s] = i
    by_shingle = {}
    items = list(distinct.items())
    for k, (s, _) in enumerate(items):
        for g in s:
            by_shingle.setdefault(g, []).append(k)
    for k, (s, i) in enumerate(items):
        common = {}
        for g in s:
            for j in by_shingle[g]:
                if j < k:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            t, other = items[j]
            if 100 * n >= per_cent * (len(s) + len(t) - n):
                a, b = find(i), find(other)
                parent[max(a, b)] = min(a, b)
    return [(i, len(s), find(i) if i is not None else None) for i, s in sets]


def quality_base(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    where = {}
    for k in range(len(w) - 2):
        where.setdefault(tuple(w[k:k + 3]), []).append(k)
    hit = set()
    for at in where.values():
        if len(at) > 1:
            for k in at:
                hit.update((k, k + 1, k + 2))
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def collocations(docs, min_count=10, top=2000, inside=50):
    """docs: list of (text, lang) → {(lang, rank, phrase, a, l, r, n, score)}, phrases of two and three words."""
    f, n = {}, {}
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            if w:
                n[lang] = n.get(lang, 0) + len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    key = (lang, tuple(w[i:i + k]))
                    f[key] = f.get(key, 0) + 1
    rows = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < min_count:
            continue
        score, _, left, right = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        rows.append((lang, p, a, left, right, score))
    longer = {}
    for lang, p, a, *_ in rows:
        if len(p) == 3:
            for q in (p[:2], p[1:]):
                longer[lang, q] = max(longer.get((lang, q), 0), a)
    rows = [r for r in rows if 100 * longer.get((r[0], r[1]), 0) < inside * r[2]]
    out = set()
    for lang in {r[0] for r in rows}:
        ranked = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[5], -r[2], " ".join(r[1]).encode()))
        out |= {(lang, k + 1, " ".join(p), a, left, right, n[lang], s) for k, (_, p, a, left, right, s) in enumerate(ranked[:top])}
    return out


def source_divergence(docs, least=3, top=200):
    """docs: list of (text, lang, source) → {(lang, source, part, item, value, rank)}."""
    count, seen, groups = {}, {}, set()
    for nr, (text, lang, source) in enumerate(docs):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)):
            count[lang, source, t] = count.get((lang, source, t), 0) + 1
            seen.setdefault((lang, t), set()).add(nr)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), at in seen.items() if x == lang and len(at) >= least]
        sources = sorted(s for x, s in groups if x == lang)
        table = {s: [count.get((lang, s, t), 0) for t in kept] for s in sources}
        share = lambda row: [1 + 1000000000 * (c + 1) // (sum(row) + len(kept)) for c in row]      # noqa: E731
        p = {s: share(row) for s, row in table.items()}
        q = share([sum(col) for col in zip(*table.values())])
        gap = lambda a, b: (a - b) * (a - b) // b                                                # noqa: E731
        for s in sources:
            pairs = sorted(((sum(map(gap, p[s], p[o])), o) for o in sources if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((gap(a, b), t) for a, b, c, t in zip(p[s], q, table[s], kept) if c > 0 and a > b), key=lambda x: (-x[0], x[1].encode()))[:top]
            out |= {(lang, s, part, item, v, k + 1) for part, rows in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(rows)}
    return out
