"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import xxhash

WHITE = " \t\n\x0b\x0c\r"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def lower(text):
    return (text or "").translate(_LOWER)


def line_dedup(docs, least=20, documents=3):
    """(doc, text) pairs to (doc, lines, dropped, kept text)."""
    holders = defaultdict(set)
    key = lambda line: lower(line.strip(WHITE))
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= least:
                holders[key(line)].add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        gone = [doc is not None and len(holders.get(key(x), ())) >= documents and doc != max(holders[key(x)]) for x in lines]
        out.append((doc, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return out


def shingles(text, size):
    w = words(lower(text))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(docs, size, percent):
    """doc to the least doc that links reach."""
    sets = {doc: shingles(text, size) for doc, text in docs}
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {d: find(d) for d in keys}


def contaminated(docs, items, least=0.8, size=5):
    """(doc, item) to the similarity of its best window.

    Every window is compared, of an item's length or the whole of a shorter
    document.  Shingles count alike, or each by one over the number of different
    texts of the benchmark that hold it, whichever says more.
    """
    found, texts = {}, defaultdict(set)
    grams = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    split = {item: words(lower(text)) for item, text in items}
    for w in split.values():
        for g in grams(w, min(size, len(w))) if w else ():
            texts[g].add(tuple(w))
    for doc, text in docs:
        w = words(lower(text))
        for item, own in split.items():
            k = min(size, len(own))
            if not own or len(w) < k:
                continue
            b = grams(own, k)
            for at in range(max(1, len(w) - len(own) + 1)):
                a = grams(w[at : at + len(own)], k)
                if not a.keys() & b.keys():
                    continue
                weight = lambda g: 1 / len(texts[g]) if g in b else 1.0  # noqa: B023, E731
                ratios = [sum(v(g) * min(a[g], b[g]) for g in a | b) / sum(v(g) * max(a[g], b[g]) for g in a | b) for v in (lambda g: 1.0, weight)]
                if max(ratios) >= least - 1e-12:
                    found[doc, item] = max(found.get((doc, item), 0), *ratios)
    return found


def base_counts(text):
    """(words, characters in them, symbols, repeated lines, words in repeated windows)."""
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def base_spans(text):
    """kind:start:end of each pattern, one pattern after the other over the whole text."""
    text = text or ""
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found))


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- HTML: well-formed pages as trees, rules applied to each block by looking at all others ---------

_BLOCK_TAGS = set("article aside body div footer form h1 h2 h3 head header html li main nav ol p section table td tr ul".split())
_STRONG = {"ad", "ads", "sidebar", "comments", "menu", "cookie", "notice"}
_WEAK = {"related", "widget", "share"}


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path, self.blocks, self.nodes = [], [], 0
        self.new = True

    def handle_starttag(self, tag, attrs):
        self.nodes += 1
        self.path.append((tag, dict(attrs), self.nodes))
        self.new |= tag in _BLOCK_TAGS

    def handle_endtag(self, tag):
        self.path.pop()
        self.new |= tag in _BLOCK_TAGS

    def handle_data(self, data):
        if self.new:
            self.blocks.append([])
            self.new = False
        self.blocks[-1].append((data, tuple(self.path)))


def main_text(page, stop_words):
    """The main text of a page of the tags above, whose elements are all closed."""
    reader = _Reader()
    reader.feed(page)
    reader.close()
    paths = [path for block in reader.blocks for _, path in block]
    names = lambda node: set(re.findall("[a-z]+", node[1].get("class", "")))
    asides = lambda node: node[0] in ("nav", "footer", "aside", "head", "script", "style") or bool(names(node) & _STRONG) or node[0] == "form"

    def aside(path):
        """(strong, weak) by the elements around, but for those that hold an article or main element."""
        strong = weak = False
        for i, node in enumerate(path):
            inside = any(n[0] in ("article", "main") for n in path[:i])
            header = node[0] == "header" and not inside
            holds = any(node in p and any(n[0] in ("article", "main") and not names(n) & (_STRONG | _WEAK) for n in p[p.index(node) + 1 :]) for p in paths)
            fixed = node[0] in ("nav", "footer", "aside", "head", "script", "style") or "comments" in names(node)
            strong |= (asides(node) or header) and (fixed or not holds)
            weak |= bool(names(node) & _WEAK) and not names(node) & _STRONG and not fixed and not holds
        return strong, weak

    rows, where_of = [], {}
    for block in reader.blocks:
        path = min((p for _, p in block), key=len)
        path = path[: max((i + 1 for i, n in enumerate(path) if n[0] in _BLOCK_TAGS), default=0)]
        strong, weak = aside(path)
        parts = [x for x in block if strong or not aside(x[1])[0]]
        lean = [x for x in parts if not aside(x[1])[1]]
        if not weak and 0 < sum(len(x[0]) for x in parts if x not in lean) < 70:
            parts = lean
        text = " ".join("".join(x[0] for x in parts).split())
        linked = " ".join("".join(x[0] for x in parts if any(n[0] == "a" for n in x[1])).split())
        container = next((n[2] for i, n in enumerate(path) if n[0] in ("article", "main") and not names(n) & (_STRONG | _WEAK)), 0)
        if text:
            w = [x for x in re.findall(r"[^\W\d_]+", text.lower())]
            stops = sum(x in stop_words for x in w) / len(w) if w else 0.0
            rows.append({"text": text, "share": len(linked) / len(text), "strong": strong, "weak": weak, "where": container, "heading": any(n[0] in ("h1", "h2", "h3") for n in path), "stops": stops if len(text) >= 70 else 0.0})
    plain = {r["where"] for r in rows if not r["strong"] and r["share"] <= 0.3}
    for r in rows:
        r["where"] = r["where"] if r["where"] in plain else 0
        size = len(r["text"])
        if r["strong"] or (size < 70 and r["weak"]) or (not r["where"] and "©" in r["text"]):
            r["label"] = "bad"
        elif r["heading"] and r["where"] or r["share"] > 0.3:
            r["label"] = "short" if r["where"] and (size < 70 or r["heading"]) else "bad"
        elif size < 70:
            r["label"] = "short"
        elif r["stops"] >= 0.3:
            r["label"] = "good" if size >= 200 else "near"
        else:
            r["label"] = "near" if r["stops"] >= 0.15 or (r["where"] and not r["weak"]) else "bad"
    link = lambda r: r["label"] == "short" and not r["heading"] and r["share"] > 0.6
    menus = []
    for i in range(len(rows)):
        run = [j for j in range(len(rows)) if all(link(rows[k]) and rows[k]["where"] == rows[i]["where"] for k in range(min(i, j), max(i, j) + 1))]
        menus += [i] if len(run) >= 3 else []
    for i in menus:
        rows[i]["label"] = "bad"
    if not any(r["label"] == "good" for r in rows):
        for r in rows:
            r["label"] = "good" if r["label"] == "near" and r["stops"] >= 0.3 else r["label"]
    for kind in ("near", "short"):
        labels = {}
        for i, r in enumerate(rows):
            if r["label"] != kind:
                continue
            decided = [(abs(i - j), j > i, x["label"]) for j, x in enumerate(rows) if x["where"] == r["where"] and x["label"] in ("good", "bad") and not x["strong"]]
            before, after = (min((d for d in decided if d[1] is side), default=None) for side in (False, True))
            both = [x for x in (before, after) if x]
            nearest = min(both)[2] if both else None
            tie = len(both) == 2 and before[0] == after[0] and before[2] != after[2]
            if kind == "near":
                labels[i] = "good" if tie or not both else nearest
            elif r["where"] and len(both) < 2:
                labels[i] = "good"
            elif r["heading"] and both:
                labels[i] = (after or before)[2]
            else:
                labels[i] = "bad" if tie or not both else nearest
        for i, label in labels.items():
            rows[i]["label"] = label
    return " ".join(r["text"] for r in rows if r["label"] == "good")


# -- languages: all counts and products written out -------------------------------------------------


def _trigrams(text):
    plain = re.sub(rb"[^a-z\x80-\xff]+", b" ", (text or "").lower().encode()).strip(b" ")
    padded = b" " + plain + b" "
    return [((int.from_bytes(padded[i : i + 3], "big") * 2654435761) % 2**32) >> 16 for i in range(len(padded) - 2)] if plain else []


def languages(rows, suffixes, order=("en", "fr", "de", "es"), sample=400, least=0.5):
    """(id, text, declared, host) rows to (language or "und", posterior), in order."""
    primary = lambda tag: m[1].lower() if (m := re.match(r"\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", tag or "")) else ""
    digest = lambda x: int.from_bytes(xxhash.xxh64_digest(x.to_bytes(8, "little", signed=True), 42), "big", signed=True)
    counts = {x: Counter() for x in order}
    for lang in order:
        ids = sorted({r[0] for r in rows if r[0] is not None and primary(r[2]) == lang}, key=lambda i: (digest(i), i))[:sample]
        for i in ids:
            counts[lang].update(_trigrams(min((r[1] for r in rows if r[0] == i and primary(r[2]) == lang and r[1] is not None), default=None)))
    sums = {x: sum(c.values()) + 0.5 * 65536 for x, c in counts.items()}
    logs = lambda text, x: [float(np.float32(math.log((counts[x][t] + 0.5) / sums[x]))) for t in _trigrams(text)]

    def evidence(name, right):
        return [0.0 if name not in order else math.log(right if name == x else (1 - right) / (len(order) - 1)) for x in order]

    def soft(values):
        powers = [math.exp(v - max(values)) for v in values]
        return [p / sum(powers) for p in powers]

    told = []
    for _, text, declared, host in rows:
        suffix = m[1] if (m := re.search(r"\.([a-z]{2,})\.?$", host)) else ""
        mine = [logs(text, x) for x in order]
        said = [a + b for a, b in zip(evidence(primary(declared), 0.9), evidence(suffixes.get(suffix, ""), 0.8), strict=True)]
        told.append((len(mine[0]), [sum(m) / max(1, len(m)) for m in mine], [0.2 * sum(m) for m in mine], said, host, suffix))
    of_host, of_suffix, of_all = defaultdict(lambda: [0.0] * 4), defaultdict(lambda: [0.0] * 4), [1.0] * 4
    for size, _, mine, said, host, suffix in told:
        if size:
            for i, p in enumerate(soft([a + b for a, b in zip(mine, said, strict=True)])):
                of_host[suffix, host][i] += p
                of_suffix[suffix][i] += p
                of_all[i] += p
    out = []
    for size, mean, mine, said, host, suffix in told:
        prior = [math.log(0.25)] * 4
        if (suffix, host) in of_host:
            wide = [(of_suffix[suffix][i] + 50 * of_all[i] / sum(of_all)) / (sum(of_suffix[suffix]) + 50) for i in range(4)]
            prior = [math.log((of_host[suffix, host][i] + 10 * wide[i]) / (sum(of_host[suffix, host]) + 10)) for i in range(4)]
        p = soft([a + b + c for a, b, c in zip(mine, said, prior, strict=True)])
        best = p.index(max(p))
        known = size > 0 and mean[best] >= -math.log(65536) and max(p) >= least
        out.append((order[best] if known else "und", max(p)))
    return out
