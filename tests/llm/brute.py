"""Plain versions of what the operators compute, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def components(items, linked):
    """Index of the component of each item, by comparing all pairs."""
    label = list(range(len(items)))
    changed = True
    while changed:
        changed = False
        for i in range(len(items)):
            for j in range(i):
                if label[i] != label[j] and linked(items[i], items[j]):
                    a, b = max(label[i], label[j]), min(label[i], label[j])
                    label = [b if x == a else x for x in label]
                    changed = True
    return label


def simhash(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(rows):
    """doc_id -> fingerprint, smallest id, for rows of distinct ids."""
    prints = [simhash(t or "") for _, t in rows]
    label = components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    smallest = {}
    for (doc, _), k in zip(rows, label):
        smallest[k] = min(doc, smallest.get(k, doc))
    return {doc: (f"{p:016x}", smallest[k]) for (doc, _), p, k in zip(rows, prints, label)}


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


def secrets(text):
    """Spans of the three fixed kinds, found as they are defined: match first, then drop what is too short."""
    kinds = {"assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
                       r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
             "access": r"(AKIA)([A-Z0-9]+)", "hex": r"()([0-9a-f]+)"}
    fits = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    found = [(m.start(), k, name, m.end()) for k, (name, p) in enumerate(kinds.items())
             for m in re.finditer(p, text) if fits[name](m)]
    return [(name, start, end) for start, _, name, end in sorted(found)]


def mixed(text):
    """Runs of 20 or more of their characters with a digit, a small and a large letter, clear of the fixed kinds."""
    taken = {i for _, a, b in secrets(text) for i in range(a, b)}
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        v = m[0]
        if (len(v) >= 20 and any("0" <= c <= "9" for c in v) and any("a" <= c <= "z" for c in v) and any("A" <= c <= "Z" for c in v)
                and not taken & set(range(*m.span()))):
            out.append(("mixed", *m.span()))
    return out


def jaccard_components(rows):
    """doc_id -> smallest id of its component: all pairs of sets of five-word shingles, joined from a similarity of 0.8."""
    sets = []
    for _, text in rows:
        words = WORD.findall(lower(text))
        sets.append({" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))})

    def near(a, b):
        if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
            return False
        both = len(a & b)
        return 5 * both >= 4 * (len(a) + len(b) - both)

    label = components(sets, near)
    smallest = {}
    for (doc, _), k in zip(rows, label):
        smallest[k] = min(doc, smallest.get(k, doc))
    return {doc: smallest[k] for (doc, _), k in zip(rows, label)}


def concentrated(x, support, least, factor):
    """Centre and scatter of a minimum covariance determinant search from medians, with exactly the wanted number of rows."""
    import numpy as np

    def middle(values):
        values = np.sort(values)
        return values[-(-len(values) // 2) - 1]

    ridge = np.diag(np.square(least))
    h = math.ceil(support * len(x))
    centre = np.array([middle(c) for c in x.T])
    scatter = np.diag([max(d, 1.4826 * middle(np.abs(c - m))) ** 2 for c, m, d in zip(x.T, centre, least)])
    smallest = np.inf
    while True:
        off = x - centre
        far = np.einsum("ij,jk,ik->i", off, np.linalg.inv(scatter), off)
        near = x[np.argsort(far, kind="stable")[:h]]
        now = factor * np.cov(near.T, bias=True) + ridge
        if np.linalg.slogdet(now)[1] >= smallest - 1e-12:
            return centre, scatter
        centre, scatter, smallest = near.mean(axis=0), now, np.linalg.slogdet(now)[1]


def spans_digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def conversations(rows):
    """conv_id -> what the prefix trees must give back."""
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by_conv.items():
        turns.sort(key=lambda t: (t[0] is not None, t))
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(),
                     len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def runs(words, least=24):
    """``start, length, period`` of every run, by trying every period at every place."""
    found = []
    for q in range(1, len(words) // 3 + 1):
        start = None
        for i in range(len(words) - q + 1):
            if i < len(words) - q and words[i] == words[i + q]:
                start = i if start is None else start
            elif start is not None:
                length, first = i - start + q, start
                start = None
                if length >= max(least, 3 * q):
                    stretch = words[first:first + length]
                    if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                        found.append((first, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def with_planted_run(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def runs_row(doc_id, words):
    """What the query on runs returns for one document."""
    found = runs(words)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def alignment(text, a_ids, b_ids, a_bytes, b_bytes):
    """Groups as text and the number of times each pair is linked; nothing where bytes are not given back."""
    whole = (" " + text).encode()
    if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return [], Counter()
    ends = [[sum(map(len, of[:k + 1])) for k in range(len(of))] for of in (a_bytes, b_bytes)]
    groups, links, low = [], Counter(), 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        a, b = ([i for i, e in zip(ids, end) if low < e <= cut] for ids, end in zip((a_ids, b_ids), ends))
        groups.append(",".join(map(str, a)) + "|" + ",".join(map(str, b)))
        links.update((x, y) for x in a for y in b)
        low = cut
    return groups, links
