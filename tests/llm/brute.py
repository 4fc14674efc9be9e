"""Plain single-machine versions of the contracts; each takes a list of rows and returns {id: row}."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def lower_ascii(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def op1(docs, n=50):
    first: dict[bytes, int] = {}
    for doc_id, text in docs:
        raw = (text or "").encode()
        for i in range(len(raw) - n + 1):
            w = raw[i : i + n]
            first[w] = min(first.get(w, doc_id), doc_id)
    out = {}
    for doc_id, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - n + 1):
            if first[raw[i : i + n]] < doc_id:
                gone[i : i + n] = b"\1" * n
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[doc_id] = (len(raw), sum(gone), runs, sha(bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def _luhn(d: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x // 10 + x % 10
    return total % 10 == 0


def op2(docs):
    out = {}
    for doc_id, text in docs:
        t, spans, counts = text or "", [], []
        for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
            n = 0
            for m in re.finditer(pattern, t):
                digits = re.sub(r"[^0-9]", "", m.group())
                ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 16 <= len(digits) <= 19 and _luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
                if ok:
                    n += 1
                    spans.append(f"{kind}:{m.start()}:{m.end()}")
            counts.append(n)
        out[doc_id] = (*counts, sha(",".join(spans)))
    return out


def op3(docs):
    out = {}
    for doc_id, text in docs:
        t, found = text or "", []
        for k, (kind, pattern) in enumerate((("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"))):
            for m in re.finditer(pattern, t):
                if {"assign": lambda: len(m.group(1)) >= 6, "access": lambda: len(m.group()) >= 20, "hex": lambda: len(m.group()) >= 24}[kind]():
                    found.append((m.start(), k, m.end(), kind))
        found.sort()
        out[doc_id] = (*[sum(f[1] == k for f in found) for k in range(3)], sha(",".join(f"{kind}:{s}:{e}" for s, _, e, kind in found)))
    return out


def op6(docs):
    key = lambda line: lower_ascii(line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(list)
    for doc_id, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                held[k].append(doc_id)
    out = {}
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= 5 and doc_id < max(held[key(x)]))]
        out[doc_id] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def op7(docs, bench, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(t or ""))
    windows = defaultdict(set)
    for item, text in bench:
        w = words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[i : i + m])].add(item)
    lengths = {len(w) for w in windows}
    out = {}
    for doc_id, text in docs:
        w, hit, items = words(text), set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if (got := windows.get(tuple(w[i : i + m]))) is not None:
                    hit.update(range(i, i + m))
                    items |= got
        out[doc_id] = (len(w), len(hit), len(items), sha(",".join(sorted(map(str, items)))), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def op8(docs):
    sets = {}
    for doc_id, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text or ""))
        sets[doc_id] = {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()
    links, ids = [], sorted(sets)
    holders = defaultdict(list)
    for d in ids:
        for s in sets[d]:
            holders[s].append(d)
    for n, a in enumerate(ids):
        if not sets[a]:
            continue
        common = defaultdict(int)
        for s in sets[a]:
            for b in holders[s]:
                if b > a:
                    common[b] += 1
        links += [(a, b) for b, c in common.items() if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c)]
    root = components(ids, links)
    return {d: (len(sets[d]), root[d], root[d] == d) for d in ids}


def op5(rows, least=0.98):
    import numpy as np

    good, unit = {}, {}
    for vec_id, v, label in rows:
        a = None if v is None or any(x is None for x in v) else np.array(v, float)
        good[vec_id] = label is not None and a is not None and a.size > 0 and np.isfinite(a).all() and np.linalg.norm(a) > 0
        if good[vec_id]:
            unit[vec_id] = a / np.linalg.norm(a)
    by = defaultdict(list)
    for vec_id, _, label in rows:
        if good[vec_id]:
            by[label].append(vec_id)
    links, n = [], defaultdict(int)
    for ids in by.values():
        sim = np.array([unit[i] for i in ids]) @ np.array([unit[i] for i in ids]).T
        for x, y in zip(*np.where(np.triu(sim >= least, 1))):
            links.append((ids[x], ids[y]))
            n[ids[x]] += 1
            n[ids[y]] += 1
    root = components([r[0] for r in rows], links)
    return {r[0]: (n[r[0]], root[r[0]], root[r[0]] == r[0]) for r in rows}


class _Tree:
    """A page as nested lists, for pages whose only unclosed elements are paragraphs."""

    INLINE = {"a", "b", "i", "em", "span", "strong"}

    def __init__(self, page):
        from html.parser import HTMLParser

        tree = self
        self.blocks, self.stack, self.raw, self.text = [], [{"tag": "", "attrs": {}, "up": None}], 0, []
        self.nodes = list(self.stack)

        class Parser(HTMLParser):
            def handle_starttag(self, tag, attrs):
                if tag in ("script", "style", "title", "select"):
                    tree.raw += 1
                elif tag not in ("br", "meta"):
                    if tag not in tree.INLINE:
                        tree.flush()
                        open_tags = [x["tag"] for x in tree.stack]
                        if "p" in open_tags and tag in ("p", "div", "ul", "section", "article", "aside", "form", "nav", "footer", "h1", "h2"):
                            del tree.stack[open_tags.index("p") :]
                    if attrs:
                        tree.flush()
                    tree.stack.append({"tag": tag, "attrs": dict(attrs), "up": tree.stack[-1]})
                    tree.nodes.append(tree.stack[-1])
                else:
                    tree.flush()

            def handle_endtag(self, tag):
                if tag in ("script", "style", "title", "select"):
                    tree.raw -= 1
                    return
                open_tags = [x["tag"] for x in tree.stack]
                if tag not in tree.INLINE:
                    tree.flush()
                if tag in open_tags and (tag not in tree.INLINE or all(t in tree.INLINE for t in open_tags[len(open_tags) - open_tags[::-1].index(tag) :])):
                    if tree.stack[len(open_tags) - 1 - open_tags[::-1].index(tag)]["attrs"]:
                        tree.flush()
                    del tree.stack[len(open_tags) - 1 - open_tags[::-1].index(tag) :]

            def handle_data(self, data):
                if not tree.raw:
                    tree.text.append((data, tree.stack[-1]))

        parser = Parser()
        parser.feed(page)
        parser.close()
        self.flush()

    def flush(self):
        text = " ".join("".join(t for t, _ in self.text).split())
        if text:
            total = sum(len(t) for t, _ in self.text)
            self.blocks.append((text, self.text[0][1], sum(len(t) for t, n in self.text if any(x["tag"] == "a" for x in self.chain(n))) / total))
        self.text = []

    @staticmethod
    def chain(node):
        out = []
        while node is not None:
            out.insert(0, node)
            node = node["up"]
        return out


def op10(page, scored=True):
    """The main text of a simple page, by the rules as they are described. scored=False: all ratios are one."""
    tree = _Tree(page or "")
    chain, blocks = _Tree.chain, tree.blocks
    punct = lambda t: sum(c in ".,;:!?。，؟¿¡" for c in t)

    def choose(live):
        paths = ["/".join(x["tag"] for x in chain(n) if x["tag"] not in _Tree.INLINE) for _, n, _ in live]
        groups = defaultdict(list)
        for p, (t, _, _) in zip(paths, live):
            groups[p].append(t)
        one, two = ([f(groups[p]) for p in paths] for f in (lambda g: sum(map(len, g)) / len(g), lambda g: sum(map(punct, g)) / len(g)))
        smooth = lambda x: [sum(w * x[min(max(k + d, 0), len(x) - 1)] for d, w in zip(range(-2, 3), (0.1, 0.2, 0.4, 0.2, 0.1))) for k in range(len(x))]
        fused = [a * (1 + b) if scored else 1 for a, b in zip(smooth(one), smooth(two))]
        least = min(sum(fused) / len(fused), max(fused) / 2) if fused else 0
        picked = [f >= least for f in fused]
        for k in range(len(live) - 2, -1, -1):
            if picked[k + 1] and any(x["tag"] in ("h1", "h2") for x in chain(live[k][1])):
                picked[k] = True
        return [b for b, p in zip(live, picked) if p], least, {id(b): f for b, f in zip(live, fused)}

    words = lambda x: set(re.findall("[a-z]+", " ".join(v or "" for k, v in x["attrs"].items() if k in ("class", "id"))))
    talk = lambda x: bool(words(x) & {"comment", "comments", "reply"})
    inner = lambda x: [y for y in tree.nodes if y is not x and any(z is x for z in chain(y))]
    under = lambda x, those: [b for b in those if any(y is x for y in chain(b[1]))]
    length = lambda those: sum(len(b[0]) for b in those)
    hard = lambda x: x["tag"] in ("nav", "footer", "menu")
    live = [b for b in blocks if not any(map(hard, chain(b[1])))]

    def comments(x):
        """An element with a word of comments that has like units inside, or such a word again."""
        if not talk(x):
            return False
        if any(talk(y) for y in inner(x)):
            return True
        kinds = defaultdict(list)
        for y in inner(x):
            if y["tag"] in ("div", "li", "article", "section") and under(y, live):
                kinds[id(y["up"]), y["tag"], " ".join(re.findall("[a-z]+", y["attrs"].get("class") or ""))].append(y)
        return any(len(v) > 1 for v in kinds.values())

    chatter = {id(x) for x in tree.nodes if comments(x)}
    live = [b for b in live if not any(id(x) in chatter for x in chain(b[1]))]
    content, least, scores = choose(live)
    marked = lambda x: bool(x["tag"] in ("aside", "form", "nav", "footer", "menu") or words(x) & {"ad", "sidebar", "menu", "footer", "cookie", "related", "share", "promo", "notice"} or talk(x))
    deepest = lambda those: [x for x in chain(those[0][1]) if all(any(x is y for y in chain(b[1])) for b in those)][-1]

    def block_of(x):
        while x["up"] is not None and x["tag"] in {*_Tree.INLINE, "p", "h1", "h2"}:
            x = x["up"]
        return x

    articles = [x for x in tree.nodes if x["tag"] == "article" and under(x, content)]
    core = max(articles, key=lambda x: length(under(x, content)), default=None)
    named = any(x["tag"] == "article" and under(x, live) for x in tree.nodes)
    if core is None:
        plain = choose([b for b in live if not any(map(marked, chain(b[1])))])[0]
        core = block_of(deepest(plain)) if plain else None
    ratio = lambda x: sum(scores[id(b)] for b in under(x, live)) / max(1, len(under(x, live)))
    richest = max((scores[id(b)] for b in under(core, live)), default=0) if core is not None else 0

    leaf = lambda b: [y["tag"] for y in chain(b[1]) if y["tag"] not in _Tree.INLINE][-1]
    own = {leaf(b) for b in under(core, content) if not any(map(marked, chain(b[1])))} if core is not None else set()

    def aside(x):
        if hard(x) or id(x) in chatter:
            return True
        if not marked(x) or core is not None and any(y is x for y in chain(core)) or x["tag"] == "article" and not any(y["tag"] == "article" for y in chain(x)[:-1]):
            return False
        mine = under(x, live)
        if not mine or ratio(x) < (1 - 1e-9) * least or 2 * sum(len(b[0]) * b[2] for b in mine) > length(mine):
            return True
        if x["tag"] in ("aside", "form") and (named or 2 * length(under(x, content)) <= length(content)):
            return True
        if core is not None and any(y is core for y in chain(x)):
            said = under(x, content)
            return not said or 2 * length([b for b in said if leaf(b) in own]) < length(said)
        return talk(x) or named or ratio(x) < (1 - 1e-9) * richest

    left = [b for b in blocks if not any(aside(x) for x in chain(b[1]))]
    live = left
    content = choose(live)[0]
    if not content:
        return ""
    inside = [b for b in live if any(x["tag"] == "article" for x in chain(b[1]))]
    held = [b for b in content if any(b is y for y in inside)]
    if held and 2 * length(held) >= length(content):
        return " ".join(b[0] for b in inside)
    common = block_of(deepest(content))

    def links(x):
        mine = under(x, live)
        return x["tag"] not in _Tree.INLINE and not under(x, content) and 2 * sum(len(b[0]) * b[2] for b in mine) > length(mine)

    return " ".join(b[0] for b in under(common, live) if not any(links(x) for x in chain(b[1])))
