"""What the operators must give, computed the plain way."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(_LOWER))


def fold(id, folds):
    return None if id is None else zlib.crc32(str(id).encode()) % folds


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def line_dedup(rows, least=50):
    """(id, text) in order of (id, md5) -> kept text of each row: lines in a run of enough words that has an earlier copy go."""
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).digest())
    docs = sorted({r for r in rows if r[1] is not None}, key=key)
    first, out = {}, {}
    for d in docs:
        lines = d[1].split("\n")
        n = [len(WORD.findall(x)) for x in lines]
        gone = [False] * len(lines)
        for a in range(len(lines)):
            total = 0
            for z in range(a, len(lines)):
                total += n[z]
                if total >= least:
                    run = tuple(lines[a : z + 1])
                    if run in first:
                        gone[a : z + 1] = [True] * (z + 1 - a)
                    else:
                        first[run] = True
        out[d] = "\n".join(x for x, g in zip(lines, gone) if not g)
    return out


def language_model(rows, d=0.75, least=3):
    """(id, text) -> n_tokens, n_known, N, base score, score of each id, by an automaton of dictionaries that is walked
    word by word."""
    token = {i: [*words(t), "\n"] for i, t in rows}
    train = [i for i in token if fold(i, 7) != 2]
    c, count, arcs = Counter(), Counter(), defaultdict(Counter)
    for i in train:
        c.update(token[i])
        x = ["\t", *token[i]]
        for k in range(1, len(x)):
            arcs[x[k - 1],][x[k]] += 1
            count[x[k - 1],] += 1
            if k > 1:
                arcs[x[k - 2], x[k - 1]][x[k]] += 1
                count[x[k - 2], x[k - 1]] += 1
    n, v = sum(c.values()), len(c)
    states = {h for h in arcs if len(h) == 1 or count[h] >= least} | {()}

    def p(h, w):
        if not h:
            return (c[w] - d) / n if c[w] else d * v / n
        back = d * len(arcs[h]) / count[h]
        return ((arcs[h][w] - d) / count[h] if arcs[h][w] else 0) + back * p(h[1:], w)

    out = {}
    for i, x in token.items():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x)
        score, state = 0.0, ("\t",) if ("\t",) in states else ()
        for w in x:
            h = state
            while h and not arcs[h][w]:  # failure arcs
                score += math.log10(d * len(arcs[h]) / count[h])
                h = h[1:]
            score += math.log10(p(h, w))
            state = (*state, w)[-2:]
            while state not in states:
                state = state[1:]
        out[i] = len(x), sum(c[w] > 0 for w in x), n, base, score
    return out


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(rows, least=0.8):
    """(id, text) -> smallest id of the class and number of links of each row's id; ids differ."""
    sets = {i: shingles(t) for i, t in rows}
    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    root, links = {i: i for i in sets}, Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in where[g] if j > i).items():
            if n >= least * (len(s) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (find(i), links[i]) for i in sets}


def repeats(rows, size=400):
    """Texts of all rows -> n_bytes, n_removed, n_spans, digest of what is kept, by place in the list."""
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + size] for b in texts for i in range(len(b) - size + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = b"\x01" * size
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def quality(text):
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    window = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = Counter(window)
    twice = {k for i, x in enumerate(window) if count[x] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(twice)


def language(rows, size=300):
    """(id, text, lang) -> language and score of each row, by place in the list."""

    def grams(text):
        raw = text.lower().encode()
        x = b" " + bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in raw) + b" "
        return Counter(g for n in (1, 2, 3) for i in range(len(x) - n + 1) if (g := x[i : i + n]).strip() and b" " not in g[1:-1])

    def ranked(count):
        return {g: k for k, (g, _) in enumerate(sorted(count.items(), key=lambda c: (-c[1], int.from_bytes(c[0], "big")))[:size])}

    counted = defaultdict(Counter)
    for i, text, lang in rows:
        if fold(i, 3) != 1 and lang is not None and text is not None:
            counted[lang].update(grams(text))
    profiles = {lang: ranked(c) for lang, c in sorted(counted.items())}
    out = []
    for _, text, _ in rows:
        if not any(c.isalpha() for c in text or "") or not profiles:
            out.append(("und", 0.0))
            continue
        own = ranked(grams(text))
        far = sorted((sum(abs(p[g] - k) if g in p else size for g, k in own.items()), lang) for lang, p in profiles.items())
        out.append((far[0][1], 1 - far[0][0] / far[1][0] if far[1][0] else 0.0))
    return out


def quality_verdicts(rows, reach=6.0, least_rows=100, upper=0.9, events=3, window=8):
    """(text, lang, source) -> whether each row is kept, with exact quantiles."""
    of = []
    for text, lang, source in rows:
        n, chars, symbols, dups, repeated = quality(text)
        lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
        failed = n < 20 or 100 * repeated > 30 * n
        rates = {"word_length": chars / n, "symbol_rate": symbols / n, "dup_line_rate": dups / lines, "repeat_rate": repeated / n} if n else {}
        of.append((lang, source, failed, rates | {"n_words": n, "n_lines": lines}))
    least = {"word_length": 0.5, "symbol_rate": 0.0, "dup_line_rate": 0.0, "repeat_rate": 0.0}
    units = {"symbol_rate": "n_words", "dup_line_rate": "n_lines", "repeat_rate": "n_words"}

    def bounds(members):
        out = {}
        for r in least:
            q = lambda p, c=r: sorted(x[c] for x in members)[math.ceil(p * len(members)) - 1]
            width = reach * max(q(0.75) - q(0.25), least[r])
            high = q(0.75) + width
            if r in units:
                high = max(high, q(upper)) + events * (2 * window if r == "repeat_rate" else 1) / q(0.5, units[r])
            out[r] = q(0.25) - width if r == "word_length" else -math.inf, high
        return out

    good = [(lang, source, x) for lang, source, failed, x in of if not failed]
    known = {}
    kept = []
    for lang, source, failed, x in of:
        if failed:
            kept.append(False)
            continue
        if (lang, source) not in known:
            choices = ([y for a, b, y in good if (a, b) == (lang, source)], [y for a, _, y in good if a == lang])
            known[lang, source] = bounds(next((c for c in choices if len(c) >= least_rows), [y for _, _, y in good]))
        kept.append(all(a <= x[r] <= z for r, (a, z) in known[lang, source].items()))
    return kept
