"""Plain versions of the operators, straight from their definitions."""

import hashlib
import re

WS = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def components(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    if len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def ngram_components(docs, n=3, num=90, den=100):
    sets = {d: shingle_set(t, n) for d, t in docs}
    ids = sorted(sets)
    links = []
    for i, a in enumerate(ids):
        x = sets[a]
        for b in ids[i + 1 :]:
            y = sets[b]
            if x and y and num * max(len(x), len(y)) <= den * min(len(x), len(y)):
                inter = len(x & y)
                if den * inter >= num * (len(x) + len(y) - inter):
                    links.append((a, b))
    found = components(links, ids)
    return {d: (len(sets[d]), found[d]) for d in ids}


def words13(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs, items, window=13):
    grams = {}
    for i, t in items:
        w = words13(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1) if n else ():
            grams.setdefault(n, {}).setdefault(tuple(w[j : j + n]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, found = words13(t), set(), set()
        for n, known in grams.items():
            for j in range(len(w) - n + 1):
                if (g := tuple(w[j : j + n])) in known:
                    hit.update(range(j, j + n))
                    found |= known[g]
        digest = sha(",".join(sorted(map(str, found))))
        out[d] = (len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    order = ["assign", "access", "hex"]
    return sorted(found, key=lambda s: (s[1], order.index(s[0])))


def linked_parts(text, patterns, reach=200, unlabelled=True):
    """Every part tested against every other; ``patterns`` by kind, BARE with the test of its matches."""
    text = text or ""
    base = base_spans(text)
    found = {k: [m.span() for m in re.finditer(p, text)] for k, p in patterns.items() if k not in ("bare", "mixed")}
    of = {k: [(a, b) for kind, a, b in base if kind == k] for k in ("assign", "access", "hex")}

    def meets(x, y):
        return x[0] < y[1] and y[0] < x[1]

    def any_of(x, spans):
        return any(meets(x, y) for y in spans)

    def scope(x):
        return sum(b[0] < x[0] for b in found["break"])

    def near(x, y):
        return scope(x) == scope(y) and x[0] - reach <= y[1] and y[0] - reach <= x[1]

    names = [("id", *x) for x in found["id"]] + [("access", *x) for x in of["access"]]
    keys = [("assign", *x) for x in of["assign"]] + [("weak", *x) for x in found["weak"] if not any_of(x, of["assign"])]
    if unlabelled:
        for m in re.finditer(patterns["bare"], text):
            x = m.span()
            taken = of["assign"] + of["access"] + found["id"] + found["weak"]
            address = any(y[0] < x[1] and x[0] <= y[1] for y in found["endpoint"])
            if re.search(patterns["mixed"], m[0]) and not any_of(x, taken) and not any(y[0] <= x[0] and x[1] <= y[1] for y in of["hex"]) and not address:
                keys.append(("bare", *x))
        keys += [("hex", *x) for x in of["hex"] if not any_of(x, found["id"])]
    held = [k for k in keys if any(near(k[1:], n[1:]) for n in names)]
    linked = [n for n in names if any(near(n[1:], k[1:]) for k in keys)] + held
    linked += [("endpoint", *p) for p in found["endpoint"] if any(near(p, k[1:]) for k in held)]
    return sorted((a, b, k) for k, a, b in linked if k in ("id", "weak", "bare", "endpoint"))


def dedup_lines(docs, min_points=40, min_docs=5):
    held = {}
    split = [(d, (t or "").split("\n")) for d, t in docs]
    for d, lines in split:
        for k in {x.strip(WS).translate(LOWER) for x in lines}:
            if len(k) >= min_points:
                held.setdefault(k, []).append(d)
    out = []
    for d, lines in split:
        kept = [x for x in lines if len(held.get(k := x.strip(WS).translate(LOWER), ())) < min_docs or max(held[k]) == d]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)
