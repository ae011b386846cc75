"""Plain versions of the operators, on Python lists."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text, k):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def components(docs, k, part, whole):
    """doc_id to (set size, smallest reachable doc_id), by comparing every pair."""
    sets = {i: shingles(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x + 1, len(ids)):
            a, b = sets[ids[x]], sets[ids[y]]
            common = len(a & b)
            if a and whole * common >= part * (len(a) + len(b) - common):
                p, q = find(ids[x]), find(ids[y])
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def kept_words(docs, window):
    """doc_id to (words, words kept)."""
    first = {}
    split = {i: words(t) for i, t in docs}
    for i in sorted(split):
        w = split[i]
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (i, s))
    out = {}
    for i, w in split.items():
        cut = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i, s):
                cut.update(range(s, s + window))
        out[i] = (w, [x for k, x in enumerate(w) if k not in cut])
    return out


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    often = Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fewest_bins(items, capacity):
    """Smallest number of bins, by trying everything."""
    best = [len(items)]
    items = sorted(items, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        tried = set()
        for b in range(len(bins)):
            if bins[b] + items[i] <= capacity and bins[b] not in tried:
                tried.add(bins[b])
                bins[b] += items[i]
                go(i + 1, bins)
                bins[b] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def marginals(emissions, moves):
    """P(state 1) of every token of a chain, by summing over all taggings."""
    import itertools
    import math

    n, total, on = len(emissions), 0.0, defaultdict(float)
    for tags in itertools.product((0, 1), repeat=n):
        weight = math.exp(sum(e for e, t in zip(emissions, tags, strict=True) if t) + sum(moves[a][b] for a, b in zip(tags, tags[1:], strict=False)))
        total += weight
        for k, t in enumerate(tags):
            on[k] += t * weight
    return [on[k] / total for k in range(n)]


def _sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _climb(row):
    """Levels of nodes from ``row`` to a single one."""
    levels = [row]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_sha(last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def merkle(rows, changed):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, source, lang, n_chars, text); ``changed``
    returns the row that folded_root starts from."""

    def leaf(row):
        return _sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = _climb([leaf(r) for r in groups[name]])
    over = _climb([trees[n][-1][0] for n in names])
    out = []
    for place, name in enumerate(names):
        for k, row in enumerate(groups[name]):
            siblings, node = [], leaf(changed(row))
            for levels, at in ((trees[name], k), (over, place)):
                for level in levels[:-1]:
                    run = level[at // 2 * 2 : at // 2 * 2 + 2]
                    siblings += [run[x] for x in range(len(run)) if x != at % 2]
                    run[at % 2] = node
                    node, at = _sha(run), at // 2
            root = over[-1][0]
            out.append((row[0], leaf(row), trees[name][-1][0], root, _sha(siblings), node, node == root))
    return out


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def infill(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output)."""
    text = text or ""
    units, digest = UNIT.findall(text), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


class _Article(HTMLParser):
    """Texts of the blocks inside article elements, by the parser of the standard library."""

    INLINE = set("a b br em i span strong".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks, self.parts, self.link = 0, [], [], False

    def border(self):
        text = " ".join("".join(self.parts).split())
        if text and self.depth:
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag not in self.INLINE:
            self.border()
        elif tag == "br":
            self.parts.append(" ")
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.border()
        self.depth -= tag == "article"

    def handle_data(self, data):
        self.parts.append(data)


def article(page):
    parser = _Article()
    parser.feed(page or "")
    parser.close()
    parser.border()
    return "\n".join(parser.blocks)


def em(texts, faults, rules, rounds=500):
    """(shares, chances[rule][class][vote + 1]) of the label model, by loops over every text."""
    kinds = [rules.ONE_SIDED if good is None else rules.TWO_SIDED for _, good, _ in rules.RULES.values()]
    before = [[k["good"], k["unknown"], *(k["seen"] if f[r] else k["good"] for f in faults)] for r, k in enumerate(kinds)]
    classes, n = 2 + len(faults), len(texts)
    share, chance = [0.85] + [0.15 / (classes - 1)] * (classes - 1), [[list(c) for c in row] for row in before]
    seen = Counter(map(tuple, texts))
    for _ in range(rounds):
        held = [[[rules.PRIOR_TEXTS * x for x in c] for c in row] for row in before]
        size = [1.0] * classes
        for votes, copies in seen.items():
            weight = list(share)
            for r, v in enumerate(votes):
                weight = [w * chance[r][c][v + 1] for c, w in enumerate(weight)]
            for c in range(classes):
                part = copies * weight[c] / sum(weight)
                size[c] += part
                for r, v in enumerate(votes):
                    held[r][c][v + 1] += part
        chance = [[[x / sum(cell) for x in cell] if c != 1 else list(before[r][1]) for c, cell in enumerate(row)] for r, row in enumerate(held)]
        share = [x / (n + classes) for x in size]
        share[0], share[1] = max(share[0], rules.LEAST_GOOD), max(share[1], rules.LEAST_UNKNOWN)
        share = [x / sum(share) for x in share]
    return share, chance
