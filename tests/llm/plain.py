"""Plain versions to hold the operators against."""

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def base_stats(text):
    w = words(text)
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def line_runs(docs, min_words):
    """docs: texts in order; for each, the numbers of the lines that later copies of repeated runs make up."""
    seqs = [[(i, x.strip(" \t\n\x0b\x0c\r")) for i, x in enumerate((t or "").split("\n")) if WORD.search(x)] for t in docs]
    at = collections.defaultdict(list)
    out = []
    for d, seq in enumerate(seqs):
        runs = []
        for s in range(len(seq)):
            best = 0
            for d2, s2 in at[seq[s][1]]:
                n = 0
                while s + n < len(seq) and s2 + n < len(seqs[d2]) and seq[s + n][1] == seqs[d2][s2 + n][1]:
                    n += 1
                best = max(best, n)
            at[seq[s][1]].append((d, s))
            if best and (not runs or s + best > runs[-1][1]):
                runs.append((s, s + best))
        out.append({seq[k][0] for a, b in runs if sum(len(words(x)) for _, x in seq[a:b]) >= min_words for k in range(a, b)})
    return out


def shingles(text, n=5):
    w = words(lower(text))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def jaccard_links(texts, t=0.8):
    sets = [shingles(x) for x in texts]
    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    both = collections.Counter((a, b) for ids in where.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    return [(a, b) for (a, b), n in both.items() if n >= t * (len(sets[a]) + len(sets[b]) - n) - 1e-9]


def classes(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return [top(i) for i in range(n)]


def secrets(text, kinds):
    out = []
    for order, (_, pattern, least, group) in enumerate(kinds):
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m[group]) >= least:
                out.append((m.start(), order, m.end()))
    return sorted(out)
