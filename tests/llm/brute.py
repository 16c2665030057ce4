"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict


def repeats(texts: list[str | None], length: int = 200) -> list[tuple[int, int, int, str]]:
    raws = [(t or "").encode() for t in texts]
    count: Counter = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def shingle_sets(texts: list[str | None], size: int = 4) -> list[set]:
    out = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return out


def near_duplicates(ids: list[int], texts: list[str | None], size: int = 4) -> dict[int, tuple[int, int, bool]]:
    sets = shingle_sets(texts, size)
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared: Counter = Counter()
    for h in holders.values():
        for a in range(len(h)):
            for b in range(a):
                shared[h[b], h[a]] += 1
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    least: dict[int, int] = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(sets[i]), least[find(i)], d == least[find(i)]) for i, d in enumerate(ids)}


def decontaminate(text: str | None, items: list[tuple[object, str | None]], window: int = 10) -> tuple[int, int, int, str, bool]:
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        x = words(t)
        m = min(window, len(x))
        if not m:
            continue
        windows = {tuple(x[i : i + m]) for i in range(len(x) - m + 1)}
        for i in range(len(w) - m + 1):
            if tuple(w[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again)


def base_secrets(text: str | None) -> tuple[int, int, int, str]:
    t, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    for k, p, least in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, t) if len(m[0]) >= least]
    names = ("assign", "access", "hex")
    n = [sum(x[1] == k for x in out) for k in range(3)]
    return *n, hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(out)).encode()).hexdigest()


def article_text(page: str) -> str:
    """The text of the first article of a well-formed page, less parts named as none of it."""
    from html.parser import HTMLParser

    blocks = {"p", "div", "h2", "article", "nav", "header", "footer", "aside", "form"}
    out: list[str] = []

    class Reader(HTMLParser):
        inside, off, stack = False, 0, ()

        def handle_starttag(self, tag, attrs):
            self.stack = (*self.stack, (tag, attrs))
            if tag == "article":
                self.inside = True
            names = {w for _, v in attrs for w in (v or "").replace("-", " ").split()}
            self.off += self.inside and (tag in {"nav", "header", "footer", "aside", "form", "script"} or bool(names & {"ad", "sidebar"}))
            if tag in blocks and not self.off:
                out.append(" ")

        def handle_endtag(self, tag):
            _, attrs = self.stack[-1]
            self.stack = self.stack[:-1]
            names = {w for _, v in attrs for w in (v or "").replace("-", " ").split()}
            self.off -= self.inside and (tag in {"nav", "header", "footer", "aside", "form", "script"} or bool(names & {"ad", "sidebar"}))
            if tag in blocks and not self.off:
                out.append(" ")
            if tag == "article":
                self.inside = False

        def handle_data(self, data):
            if self.inside and not self.off:
                out.append(data)

    Reader(convert_charrefs=True).feed(page)
    return " ".join("".join(out).split())


def rule_score(rules, intercept: float, row: dict) -> float:
    import math

    total = intercept + sum(w for rule, w in rules if all(row[f] <= c if op == "<=" else row[f] > c for f, op, c in rule))
    return 1 / (1 + math.exp(-total))


def audit(docs: list[tuple], labels: list[tuple]) -> dict[tuple, tuple]:
    """docs: (doc_id, source, text); labels: (doc_id, quality, toxic). Applies the five filters in every order."""
    from itertools import permutations

    rows = []
    for i, source, text in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        fails |= {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, _, u in docs) else set()
        own = [x for x in labels if x[0] == i and i is not None]
        rows.append((source or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            there, gone = [r for r in rows if r[0] == part], []
            for step, c in enumerate(order, 1):
                lost = [r for r in there if c in r[1]]
                late = sum(c in r[1] for r in gone)
                there, gone = [r for r in there if c not in r[1]], gone + lost
                alone = sum(r[0] == part and r[1] == {c} for r in rows)
                out[part, order, step] = (len(there), len(lost), late, alone, sum(r[2] for r in lost), sum(r[3] for r in lost))
                shapley[part, c] += len(lost)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def mix_targets(sizes: dict, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict:
    """sizes: words by source. The targets by sharing, capping and sharing the excess again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        if not rest:
            return {s: most * sizes[s] for s in order}
        level = (total - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in rest)
        above = {s for s in rest if level * weight[s] >= most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in order}
        full |= above
