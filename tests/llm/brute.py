"""Plain versions of the operators, one text or all pairs at a time."""

import hashlib
import re
from collections import Counter, defaultdict


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard_components(rows):
    """(doc_id, n, component) per row."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


def benchmark_hits(rows, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for name, text in items:
            b = words(text)
            size = min(window, len(b))
            grams = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)} if b else set()
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in grams:
                    hit |= set(range(i, i + size))
                    found.add(str(name))
        out.append((d, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def base_spans(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 16:
            out.append((m.start(), 1, "access", m.end()))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 32:
            out.append((m.start(), 2, "hex", m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def quality_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(rep)


def chat_digest(turns):
    """conv -> (n_turns, sha of turns, loss chars, sha of loss)."""
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        loss = "".join(t for _, r, t in rows if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(rows), sha("".join(f"{r}\n{t}\n" for _, r, t in rows)), len(loss), sha(loss))
    return out


def mixture(rows, weights=(5, 2, 1), share=1.5, copies=2):
    """rows: (doc_id, source, size) -> list of (doc_id, source, size, target, taken)."""
    total = Counter()
    for _, s, n in rows:
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, capped = share * sum(total.values()), set()
    while True:
        open_ = [s for s in names if s not in capped]
        unit = (budget - sum(2.0 * total[s] for s in capped)) / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if unit * weight[s] > 2.0 * total[s]}
        if not over:
            break
        capped |= over
    target = {s: 2.0 * total[s] if s in capped else unit * weight[s] for s in names}
    queue, run = [], Counter()
    key = lambda r: (hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), r[2])
    order = sorted(range(len(rows)), key=lambda i: (key(rows[i]), i))
    for copy in range(copies):
        for i in order:
            d, s, n = rows[i]
            run[s] += n
            if n and target[s]:
                queue.append((run[s] / target[s], s is None, (s or "").encode(), key(rows[i]), copy, i))
    taken, used = Counter(), 0
    for *_, i in sorted(queue):
        used += rows[i][2]
        if used > budget:
            break
        taken[i] += rows[i][2]
    return [(d, s, n, target[s], taken[i]) for i, (d, s, n) in enumerate(rows)]
