"""Plain versions of the corpus operators, row by row in Python, that the tests compare with."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import regex

SPACE = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, k):
    words = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def components(docs, k, percent):
    """({doc: smallest doc reachable}, {doc: size of its set}) of (doc, text) pairs; only sets that share a shingle meet."""
    sets = {d: shingles(t, k) for d, t in docs}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for one in s:
            holders[one].append(d)
    met = Counter()
    for d, s in sets.items():
        met.clear()
        for one in s:
            met.update(x for x in holders[one] if x < d)
        for other, both in met.items():
            if 100 * both >= percent * (len(s) + len(sets[other]) - both):
                x, y = find(d), find(other)
                up[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}, {d: len(s) for d, s in sets.items()}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_marks(text):
    """(kind, start, end, entity) of the checked patterns, by kind and start."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda d=digits: 16 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 8 <= len(d) <= 15}
            if good[kind]():
                value = {"email": m[0].lower(), "ip": m[0]}.get(kind, digits)
                out.append((kind, m.start(), m.end(), f"{kind}:{value}"))
    return out


def base(text):
    return [f"{k}:{s}:{e}" for k, s, e, _ in base_marks(text)]


TERM = regex.compile(r"\p{L}{3,}+")


def marks(texts, disclose=0.6, remove=0.9):
    """For each text its (kind, start, end, how): the base spans, then the terms that reveal an entity of that text."""
    found = [base_marks(t) for t in texts]
    words = [Counter(w.lower() for w in TERM.findall(t)) for t in texts]
    held = [{x[3] for x in f} for f in found]
    n_t = sum(words, Counter())
    n_e, n_te, k = Counter(v for vs in held for v in vs), Counter(), Counter()
    for text, f, ws, vs in zip(texts, found, words, held, strict=True):
        for v in vs:
            for w, n in ws.items():
                n_te[v, w] += n
            places = [(s, e) for _, s, e, x in f if x == v]
            whole = [(m[0].lower(), m.start(), m.end()) for m in TERM.finditer(text)] if places else []
            cut = [m.span() for m in regex.finditer(r"\p{L}+", text)] if places else []
            run = lambda a: next((x for x in cut if x[0] <= a < x[1]), None)
            near = set()
            for s, e in places:
                head, tail = max(s - 64, 0), min(e + 64, len(text))
                first = run(head)  # letters at either edge are left out: they may be a part of a word
                low = first[1] if first and s > 64 else head
                last = run(tail - 1) if tail > e else None
                high = max(last[0], e) if last and e + 64 < len(text) else tail
                for part in (text[low:s], text[e:high]):
                    near |= {x.lower() for x in TERM.findall(part)}
            assert whole or not near
            for w in near:
                k[v, w] += 1
    told = {}
    for (v, w), both in n_te.items():
        if n_e[v] < len(texts):
            n = n_t[w] + 2 * k[v, w]
            p = (both + 2 * k[v, w]) / n
            share = (p + 0.5 / n - math.sqrt(p * (1 - p) / n + 0.25 / n**2)) / (1 + 1 / n)
            if share >= disclose:
                told[v, w] = share
    out = []
    for text, f, vs in zip(texts, found, held, strict=True):
        here = []
        for m in TERM.finditer(text) if f else ():
            best = max((told[v, m[0].lower()] for v in vs if (v, m[0].lower()) in told), default=None)
            if best is not None and not any(s < m.end() and m.start() < e for _, s, e, _ in f):
                here.append(("term", m.start(), m.end(), "remove" if best >= remove else "generalise"))
        out.append([*f, *here])
    return out


def cleaned(text, spans):
    """A text with its spans replaced; those that overlap are one, named by the first."""
    order = sorted(spans, key=lambda x: (x[1], [*PATTERNS, "term"].index(x[0])))
    out, at = "", 0
    for kind, s, e, how in order:
        if s >= at:
            out += text[at:s] + ("" if kind == "term" and how == "remove" else f"<{kind.upper()}>")
        at = max(at, e)
    return out + text[at:]


def mixed(docs, most=3, seed=17):
    """[(source's size, target, words taken)] of (doc_id, source, text) rows: clamp and reshare until none is above."""
    sizes = [len(SPACE.findall(t or "")) for _, _, t in docs]
    total = Counter()
    for (_, s, _), n in zip(docs, sizes, strict=True):
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target = {}
    while True:
        free = [s for s in names if s not in target]
        left = sum(total.values()) - sum(target.values())
        shares = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if shares[s] >= most * total[s]]
        if not over:
            target |= shares
            break
        target |= {s: most * total[s] for s in over}
    key = [hashlib.md5(f"{seed}:{'-' if d is None else d}:{n}".encode()).hexdigest() for (d, _, _), n in zip(docs, sizes, strict=True)]
    want = {s: math.floor(target[s] % total[s] + 0.5) if total[s] else 0 for s in names}
    taken = [0] * len(docs)
    for i in sorted(range(len(docs)), key=lambda i: key[i]):
        s = docs[i][1]
        give = min(sizes[i], want[s])
        want[s] -= give
        taken[i] = (int(target[s] // total[s]) if total[s] else 0) * sizes[i] + give
    return [(total[s], target[s], n) for (_, s, _), n in zip(docs, taken, strict=True)]
