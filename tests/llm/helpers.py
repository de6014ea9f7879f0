"""Brute-force versions of the operators, straight from their definitions."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

ASSIGN = r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def secrets(text):
    out = []
    kinds = (("assign", re.compile(ASSIGN.replace("(?:password", "(?i:password"), re.ASCII), 8, 2), ("access", re.compile("AKIA[A-Z0-9]+"), 16, 0), ("hex", re.compile("[0-9a-f]+"), 32, 0))
    for i, (kind, p, least, group) in enumerate(kinds):
        out += [(m.start(), i, kind, m.end()) for m in p.finditer(text or "") if len(m[group]) >= least]
    return sorted(out)


def secrets_digest(text):
    spans = secrets(text)
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
    return tuple(sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")), hashlib.sha256(joined.encode()).hexdigest()


def shingle_set(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(n, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def components(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return [root(i) for i in range(n)]


def jaccard(rows):
    """rows: (id, text), ids not null -> (id, set size, component) per row."""
    sets = [shingle_set(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    comp = components(len(rows), links)
    least = defaultdict(lambda: None)
    for (i, _), c in zip(rows, comp, strict=True):
        least[c] = i if least[c] is None else min(least[c], i)
    return sorted((i, len(s), least[c]) for (i, _), s, c in zip(rows, sets, comp, strict=True))


def repeats(rows, length=50):
    """rows: (id or None, text) -> sorted (id, bytes, removed, spans, sha256 of the rest)."""
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, x in data:
        if i is not None:
            for k in range(len(x) - length + 1):
                w = x[k : k + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, x in data:
        gone = [False] * len(x)
        for k in range(len(x) - length + 1):
            if i is not None and first[x[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        rest = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out.append((i, len(x), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def canonical(text):
    """(kind, word in lower case, whether it is capitalised) of each word: kinds are literal, number, name, unit."""
    from tideframe.llm.decontam import EDGE, UNITS

    out, begins = [], True
    for line in (text or "").split("\n"):
        for word in line.split():
            bare, was = word.strip(EDGE), begins
            begins = word[-1] in ".!?:…"
            if not bare:
                continue
            low = bare.lower()
            title = bare[0].isalpha() and bare[0].isupper() and bare[1:] == bare[1:].lower()
            quantity = re.fullmatch(r"\d[\d.,]*([a-z]{1,4})", low)
            if re.fullmatch(r"[+-]?\d[\d.,:/]*(st|nd|rd|th)?", low) or quantity and quantity[1] in UNITS:
                kind = "number"
            elif low in UNITS and len(low) > 1:
                kind = "unit"
            else:
                kind = "name" if title and not was else "literal"
            out.append((kind, low, title and kind in ("name", "literal")))
        begins = True
    return out


def contaminating(text, items):
    """(item id, covered words, whether re-parameterised) of the items that a text holds, by comparing windows word by word."""
    doc, out = canonical(text), []
    places = defaultdict(list)
    for n in range(1, 9):
        for p in range(len(doc) - n + 1):
            places["exact", tuple(w for _, w, _ in doc[p : p + n])].append(p)
            places["form", tuple(w if k == "literal" else (k,) for k, w, _ in doc[p : p + n])].append(p)
    for item_id, item_text in items:
        item = canonical(item_text)
        n = min(8, len(item))
        if item_id is None or not n:
            continue
        cover, evidence = set(), defaultdict(list)
        for at in range(len(item) - n + 1):
            window = item[at : at + n]
            if places["exact", tuple(w for _, w, _ in window)]:
                cover |= set(range(at, at + n))
            forms = [window]
            if at == 0 and window[0][0] == "literal" and window[0][2]:
                forms.append([("name", *window[0][1:]), *window[1:]])
            for form in forms:
                every = form[:1] + item[1:]
                literal = sum(k == "literal" for k, _, _ in form)
                if n < 4 or sum(k == "literal" for k, _, _ in (every if at == 0 else item)) < 3 or literal < min(5, n):
                    continue
                for p in places["form", tuple(w if k == "literal" else (k,) for k, w, _ in form)]:
                    evidence[p - at].append((at, [((k, w), doc[p + j][1]) for j, (k, w, _) in enumerate(form) if k != "literal"]))
        other = False
        for found in evidence.values():
            given = defaultdict(set)
            for _, slots in found:
                for slot, value in slots:
                    given[slot].add(value)
            steady = all(len(v) == 1 for v in given.values())
            other |= steady and any(v != {slot[1]} for slot, v in given.items())
            for at, slots in found:
                if steady or not slots:
                    cover |= set(range(at, at + n))
        runs = "".join("x" if j in cover else " " for j in range(len(item))).split()
        if cover and (max(map(len, runs)) >= 13 or 2 * len(cover) >= len(item)):
            out.append((item_id, len(cover), other))
    return out
