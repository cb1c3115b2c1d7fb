"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is scanned into leaf blocks (runs of text between block-level tags). Features of a block are
its ancestors' tags, class and id words and roles, and the length, link share, and shape of its
text. The field labels the sequence of blocks as main text or not; it is trained by maximum
likelihood (forward-backward, Adam) on labelled pages and decoded by Viterbi. The labelled pages
are generated from a seed with the parts that pages have (menus, headers, adverts, notices,
sidebars, forms, reader comments, footers) in many mark-ups; ``train`` takes any others.

Character references are decoded, white space inside a block becomes one space, blocks are joined
in page order by one space. Scripts, styles, comments and the head never become blocks.

Defined results: null and empty pages give an empty text; broken and unclosed mark-up is read as
far as it goes; a page without tags is one block; equal scores of both labels give other text; rows
that repeat are answered each; further columns are left out; an empty table gives an empty result.
The cost is linear in the page, however deep its elements are nested.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quakeframe.llm.common import table, text_batches

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no mark-up, or is never shown.
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: End tags, found in the page itself: in lower case a page may have another length (U+0130).
RAW_END = {name: re.compile("</" + name, re.I | re.A) for name in RAW_TAGS}
HIDDEN_TAGS = frozenset("head template noscript svg math object canvas audio video select datalist".split())
#: What an opening tag ends if it is open.
ENDS = {"li": {"li", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head"}}
#: Where the search for an element to end stops.
SCOPES = frozenset("table ul ol dl div section article aside nav main header footer form body html button".split())
ENDED = frozenset("p".split()).union(*ENDS.values())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
TAG_END = re.compile(r"""(?>[^>"']++|"[^"]*+"|'[^']*+')*+>""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element:
    """An open element: what its descendants' blocks know of their ancestors. ``fresh`` are features
    that no ancestor has, so that a path's features are those of its elements in turn."""

    __slots__ = ("parent", "name", "fresh", "nearest", "total")

    def __init__(self, parent, name, fresh, nearest):
        self.parent, self.name, self.fresh, self.nearest, self.total = parent, name, fresh, nearest, None


class Block:
    """Raw text, the element around it (None at the top) and the number of characters inside links."""

    __slots__ = ("text", "path", "linked")

    def __init__(self, text, path, linked):
        self.text, self.path, self.linked = text, path, linked


#: Sections that a block is told to be in, the nearest one.
SECTIONS = frozenset("article main nav aside header footer form section table ul ol".split())
#: Features of a block without ancestors: its block element, the words next to it, its section, whether in a link.
NOWHERE = ("block:-", (), "last:-", False)


def tag_words(attributes: str) -> tuple[str, ...]:
    """Words of a tag's class, id and role, in lower case."""
    found = []
    for name, value in ATTRIBUTE.findall(attributes):
        kind = name.lower()
        value = value.strip("\"'")
        if kind in ("hidden", "aria-hidden"):
            if value.lower() != "false":
                found.append("hidden" if kind == "hidden" else "aria-hidden")
        else:
            found += ["role-" + w.lower() if kind == "role" else w.lower() for w in WORD.findall(value)]
    return tuple(dict.fromkeys(found))


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order; those without text are left out."""
    page = page or ""
    out: list[Block] = []
    stack: list[Element] = []
    opened: Counter[str] = Counter()  # open elements by name
    scopes: list[dict[str, int]] = [{}]  # of each open scope, the elements open in it that a tag may end
    held: Counter[str] = Counter()  # features by how many open elements brought them
    parts: list[str] = []
    linked = links = hidden = at = 0

    def end_block():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack[-1] if stack else None, linked))
            parts.clear()
        linked = 0

    def pop_to(k):
        nonlocal links, hidden
        for element in reversed(stack[k:]):
            if element.name in SCOPES:
                scopes.pop()
            elif element.name in ENDED:
                scopes[-1][element.name] -= 1
            links -= element.name == "a"
            hidden -= element.name in HIDDEN_TAGS
            opened[element.name] -= 1
            for f in element.fresh:
                del held[f]
        del stack[k:]

    def push(name, words):
        parent = stack[-1] if stack else None
        block, near, last, inside = parent.nearest if parent else NOWHERE
        features = [f"word:{w}" for w in words]
        if name not in ("html", "body"):
            features.append(f"in:{name}")
            block = f"block:{name}" if name in BLOCK_TAGS else block
            last = f"last:{name}" if name in SECTIONS else last
            inside = inside or name == "a"
        near = tuple(f"near:{w}" for w in words) or near
        fresh = tuple(f for f in features if f not in held)
        for f in fresh:
            held[f] = 1
        opened[name] += 1
        if name in SCOPES:
            scopes.append({})
        elif name in ENDED:
            scopes[-1][name] = scopes[-1].get(name, 0) + 1
        stack.append(Element(parent, name, fresh, (block, near, last, inside)))

    def add(piece):
        nonlocal linked
        if piece and not hidden:
            piece = unescape(piece) if "&" in piece else piece
            parts.append(piece)
            linked += len(piece) if links else 0

    n = len(page)
    while at < n:
        open_at = page.find("<", at)
        if open_at < 0:
            add(page[at:])
            break
        add(page[at:open_at])
        following = page[open_at + 1 : open_at + 2]
        if following == "!" or following == "?":
            if page.startswith("<!--", open_at):
                end = page.find("-->", open_at + 4)
                at = n if end < 0 else end + 3
            elif page.startswith("<![CDATA[", open_at):
                end = page.find("]]>", open_at)
                add(page[open_at + 9 : end if end >= 0 else n].replace("&", "&amp;"))
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", open_at)
                at = n if end < 0 else end + 1
            continue
        closing = following == "/"
        named = NAME.match(page, open_at + 1 + closing)
        if not named:
            if closing:  # a bogus comment
                end = page.find(">", open_at)
                at = n if end < 0 else end + 1
            else:
                add("&lt;")
                at = open_at + 1
            continue
        name = named[0].lower()
        ended = TAG_END.match(page, named.end())
        if ended:
            attributes, at = page[named.end() : ended.end() - 1], ended.end()
        else:  # a quote that never ends: up to the next bracket, or the page breaks off inside a tag
            end = page.find(">", named.end())
            attributes, at = page[named.end() : end if end >= 0 else n], n if end < 0 else end + 1
            if end < 0:
                break
        if closing:
            if name in BLOCK_TAGS or name in HIDDEN_TAGS:
                end_block()
            heading = name in HEADINGS
            if opened[name] or heading and any(opened[h] for h in HEADINGS):
                k = len(stack) - 1
                while stack[k].name != name and not (heading and stack[k].name in HEADINGS):
                    k -= 1
                pop_to(k)
            continue
        if name in RAW_TAGS:
            end = RAW_END[name].search(page, at)
            close = page.find(">", end.start()) if end else -1
            at = n if close < 0 else close + 1
            continue
        if name in BLOCK_TAGS:
            end_block()
            ends = ENDS.get(name, {"p"} if name != "option" else set())
            if any(scopes[-1].get(e) for e in ends):  # what is walked over is closed, so that each element costs once
                pop_to(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].name in ends))
        if name == "br":
            parts.append(" ")
        if name in VOID_TAGS:  # a slash ends no other element
            continue
        push(name, tag_words(attributes) if attributes else ())
        links += name == "a"
        hidden += name in HIDDEN_TAGS
    end_block()
    return out


def bucket(n: float, cuts: tuple) -> int:
    return sum(n >= c for c in cuts)


def nearest_features(path: Element | None) -> list[str]:
    """The nearest block element, the nearest words, the nearest section, and whether inside a link."""
    block, near, last, inside = path.nearest if path else NOWHERE
    return [block, *dict.fromkeys(near), last] + (["inside:a"] if inside else [])


def path_features(path: Element | None) -> list[str]:
    """Features of a block's ancestors: any of them, and the nearest ones."""
    found, element = nearest_features(path), path
    while element is not None:
        found += element.fresh
        element = element.parent
    return sorted(found)


def text_features(block: Block, i: int, n: int) -> list[str]:
    text = block.text
    words = text.count(" ") + 1
    share = block.linked / max(1, len(text))
    found = [
        f"words:{bucket(words, (2, 4, 8, 16, 32, 64))}",
        f"links:{bucket(share, (0.01, 0.34, 0.67, 0.95))}",
        f"end:{text[-1] if text[-1] in '.!?:…»' else 'a' if text[-1].isalnum() else '-'}",
        f"commas:{bucket(text.count(',') / words, (0.001, 0.1))}",
        f"place:{bucket(i / max(1, n - 1), (0.05, 0.2, 0.8, 0.95))}",
    ]
    if "©" in text:
        found.append("sign:c")
    if "|" in text or "·" in text:
        found.append("sign:bar")
    return found


class Field:
    """A chain of two labels: emission weights by feature (label 1 over label 0) and transitions."""

    def __init__(self, weights: dict[str, float], step: list[list[float]], bias: float):
        self.weights, self.step, self.bias = weights, step, bias

    def by_path(self, path: Element | None) -> float:
        """The part of a score that the ancestors give; each element is summed up once."""
        get, open_ones = self.weights.get, []
        element = path
        while element is not None and element.total is None:
            open_ones.append(element)
            element = element.parent
        total = element.total if element is not None else self.bias
        for element in reversed(open_ones):
            total = element.total = total + sum(get(f, 0.0) for f in element.fresh)
        return total + sum(get(f, 0.0) for f in nearest_features(path))

    def emissions(self, blocks: list[Block]) -> list[float]:
        """Scores of label 1 over label 0; blocks of a page belong to one field."""
        get, n = self.weights.get, len(blocks)
        return [self.by_path(b.path) + sum(get(f, 0.0) for f in text_features(b, i, n)) for i, b in enumerate(blocks)]

    def viterbi(self, scores: list[float]) -> list[int]:
        """The most likely labels."""
        (s00, s01), (s10, s11) = self.step
        zero, one, back = 0.0, 0.0, []
        for i, e in enumerate(scores):
            if i == 0:
                zero, one = 0.0, e
                continue
            to_zero, to_one = zero + s00 < one + s10, zero + s01 < one + s11
            zero, one = (one + s10 if to_zero else zero + s00), (one + s11 if to_one else zero + s01) + e
            back.append((to_zero, to_one))
        labels = [int(one > zero)] if scores else []
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]

    def main_text(self, page: str | None) -> str:
        blocks = blocks_of(page)
        labels = self.viterbi(self.emissions(blocks))
        return " ".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def log_likelihood(emit: np.ndarray, step: np.ndarray, labels: np.ndarray, mask: np.ndarray):
    """Mean log-likelihood a page, and its gradients by emission (label 1) and by transition.

    emit: pages x length, score of label 1 over label 0; labels and mask likewise.
    """
    pages, length = emit.shape
    e = np.stack([np.zeros_like(emit), emit], -1)
    alpha, beta = np.zeros((pages, length, 2)), np.zeros((pages, length, 2))
    alpha[:, 0] = e[:, 0]
    for t in range(1, length):
        new = np.logaddexp(alpha[:, t - 1, :1] + step[0], alpha[:, t - 1, 1:] + step[1]) + e[:, t]
        alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
    for t in range(length - 2, -1, -1):
        ahead = e[:, t + 1] + beta[:, t + 1]
        new = np.logaddexp(step[:, 0] + ahead[:, :1], step[:, 1] + ahead[:, 1:])
        beta[:, t] = np.where(mask[:, t + 1, None], new, beta[:, t])
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    p = np.exp(alpha[..., 1] + beta[..., 1] - z[:, None]) * mask
    both = mask[:, 1:] & mask[:, :-1]
    pair = np.exp(alpha[:, :-1, :, None] + step + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * both[..., None, None]
    a, b = labels[:, :-1], labels[:, 1:]
    told = np.array([[((a == i) & (b == j) & both).sum() for j in (0, 1)] for i in (0, 1)], float)
    value = (emit * labels * mask).sum() + (told * step).sum() - z.sum()
    return value / pages, ((labels - p) * mask) / pages, (told - pair.sum((0, 1))) / pages


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 160, rate: float = 0.15, decay: float = 3e-4, least: int = 3) -> Field:
    """The field that makes the labels of these pages likely; features of fewer than ``least`` blocks are left out."""
    pages = [(b, y) for b, y in pages if b]
    named = [[path_features(b.path) + text_features(b, i, len(blocks)) for i, b in enumerate(blocks)] for blocks, _ in pages]
    seen: dict[str, int] = {}
    for f in (f for page in named for block in page for f in block):
        seen[f] = seen.get(f, 0) + 1
    index = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    length = max((len(b) for b, _ in pages), default=1)
    mask, labels = np.zeros((len(pages), length), bool), np.zeros((len(pages), length))
    x = np.zeros((sum(len(b) for b, _ in pages), len(index) + 1), np.float32)
    x[:, -1] = 1
    row = 0
    for k, (page, (_, y)) in enumerate(zip(named, pages, strict=True)):
        mask[k, : len(page)], labels[k, : len(page)] = True, y
        for block in page:
            x[row, [index[f] for f in block if f in index]] = 1
            row += 1
    w, step = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for t in range(1, rounds + 1):
        emit = np.zeros(mask.shape)
        emit[mask] = x @ w.astype(np.float32)
        _, by_emit, by_step = log_likelihood(emit, step, labels, mask)
        g = np.r_[x.T @ by_emit[mask].astype(np.float32) - decay * w, by_step.ravel() - decay * step.ravel()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, step = w + move[:-4], step + move[-4:].reshape(2, 2)
    return Field({f: float(w[k]) for f, k in index.items()}, step.tolist(), float(w[-1]))


#: Marks of generated text: main and other. Private-use characters, taken out before features are made.
MAIN, OTHER = "\ue000", "\ue001"


class PageMaker:
    """Pages with marked text, from a seed."""

    CONTENT = ["content", "post-content", "entry-content", "article-body", "story", "main-content", "post", "text", "body-copy", "page-content", "article", "entry", "single-post"]
    PARTS = {
        "nav": ["nav", "navbar", "menu", "main-menu", "navigation", "topnav", "site-nav", "breadcrumb", "breadcrumbs", "pagination", "pager", "tabs"],
        "header": ["header", "site-header", "masthead", "top-bar", "page-header", "logo", "brand", "topbar"],
        "footer": ["footer", "site-footer", "page-footer", "bottom", "copyright", "colophon", "legal", "foot"],
        "aside": ["sidebar", "side", "widget", "related", "related-posts", "recommended", "trending", "popular", "more-stories", "rail", "aside", "tag-cloud"],
        "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot", "adsense", "sponsor", "promotion"],
        "notice": ["cookie", "cookie-banner", "cookie-notice", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "paywall", "warning", "banner", "disclaimer"],
        "form": ["search", "login", "signup", "newsletter", "subscribe", "contact-form", "search-form", "register"],
        "comments": ["comments", "comment-list", "comment", "reply", "responses", "discussion", "disqus", "user-comments", "comment-body", "replies"],
        "share": ["share", "social", "sharing", "share-buttons", "follow", "social-links", "toolbar", "actions"],
    }
    PLAIN = ["wrap", "wrapper", "container", "row", "col", "inner", "c", "x", "box", "outer", "layout", "grid", "page", "site", "section", "root", "app"]

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        letters = self.r.choice(["aeiourstln", "abcdefghiklmnoprstuv", "éèaçouirestnl", "äöüßenrstich", "óñíaeoslrcd", "абвгдеиклмнопрст"])
        self.syllables = ["".join(self.r.choices(letters, k=self.r.randint(1, 4))) for _ in range(40)]

    def word(self):
        return "".join(self.r.choices(self.syllables, k=self.r.randint(1, 3)))

    def sentence(self, n=None):
        words = [self.word() for _ in range(n or self.r.randint(3, 18))]
        words = [w + "," if self.r.random() < 0.06 else w for w in words]
        return words[0].capitalize() + " " + " ".join(words[1:]) + self.r.choice("...?!")

    def prose(self, most=7):
        r = self.r
        kind = r.random()
        if kind < 0.12:
            return self.word().capitalize() + r.choice([".", "", "!"])
        text = " ".join(self.sentence() for _ in range(r.randint(1, most)))
        if kind < 0.2:
            return " ".join(w + r.choice(["%%%", "###", "***", "&amp;&amp;"]) for w in text.split())
        if kind < 0.25:
            return text.upper()
        if kind < 0.3:
            return text.replace(" ", " | ")
        return text

    def attrs(self, names, chance=0.9):
        r = self.r
        if r.random() > chance:
            return ""
        name = r.choice(names) + r.choice(["", "", "", "-1", "__inner", " " + r.choice(self.PLAIN)])
        return r.choice([' class="{}"', " class='{}'", ' id="{}"', " class={}"]).format(name if " " not in name else name.replace(" ", "_"))

    def links(self, mark, n):
        return [f'<a href="/{self.word()}">{mark}{self.word()}{" " + self.word() if self.r.random() < 0.3 else ""}</a>' for _ in range(n)]

    def listed(self, mark, n):
        tag, items = self.r.choice(["ul", "ol", "div"]), self.links(mark, n)
        return f"<{tag}>" + "".join(f"<li>{x}</li>" if tag != "div" else self.r.choice(["{} ", "<span>{}</span>", "<div>{}</div>"]).format(x) for x in items) + f"</{tag}>"

    def other(self, kind):
        r, mark = self.r, OTHER
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "section" if r.random() < 0.3 else "div")
        own = tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.6
        tag = tag if own else "div" if tag not in ("section", "form") else tag
        attrs = self.attrs(self.PARTS[kind], 0.5 if own else 1.0)
        if kind == "nav":
            inside = self.listed(mark, r.randint(2, 9))
        elif kind == "header":
            inside = r.choice(["<h1>{}</h1>", "<div>{}</div>", "<a href='/'>{}</a>", "<p>{}</p>", "{}"]).format(mark + self.sentence(r.randint(1, 5))) + (self.listed(mark, 3) if r.random() < 0.4 else "")
        elif kind == "footer":
            inside = f"{mark}&copy; {self.word()} &middot; {self.sentence(r.randint(2, 9))}" if r.random() < 0.6 else f"<p>{mark}{self.sentence()}</p>" + self.listed(mark, r.randint(1, 6))
        elif kind == "aside":
            inside = f"<h3>{mark}{self.sentence(2)}</h3>" + (self.listed(mark, r.randint(2, 7)) if r.random() < 0.6 else f"<p>{mark}{self.prose(3)}</p>")
        elif kind == "ad":
            inside = r.choice(["{}", "<p>{}</p>", "<a href='http://x'>{}</a>", "<span>{}</span>"]).format(mark + self.sentence())
        elif kind == "notice":
            inside = r.choice(["{}", "<p>{}</p>", "<div>{}</div>"]).format(mark + self.prose(3)) + (f"<button>{mark}{self.word()}</button>" if r.random() < 0.5 else "")
        elif kind == "form":
            inside = f"<label>{mark}{self.sentence(2)}</label><input type=text><button>{mark}{self.word()}</button>" + (f"<p>{mark}{self.sentence()}</p>" if r.random() < 0.5 else "")
        elif kind == "share":
            inside = "".join(self.links(mark, r.randint(2, 5)))
        else:
            each = lambda: f"<{(t := r.choice(['div', 'li', 'article', 'p']))}{self.attrs(['comment', 'reply', 'comment-body', 'response'], 0.7)}>" + r.choice(["{}", "<p>{}</p>", "<b>{}</b> {}"]).replace("{}", mark + self.prose(3)) + f"</{t}>"
            inside = (f"<h3>{mark}{self.sentence(2)}</h3>" if r.random() < 0.6 else "") + "".join(each() for _ in range(r.randint(1, 5)))
        return f"<{tag}{attrs}>{inside}</{tag}>"

    def article(self):
        r, mark = self.r, MAIN
        parts = [r.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>", "<div class=title>{}</div>"]).format(mark + self.sentence(r.randint(2, 12)))] if r.random() < 0.85 else []
        for _ in range(r.randint(1, 16)):
            kind, text = r.random(), mark + self.prose()
            if kind < 0.62:
                parts.append(f"<p>{text}</p>" if r.random() < 0.8 else f"<p>{text}")
            elif kind < 0.7:
                parts.append(f"<p><b>{text}<br>{'<p>' if r.random() < 0.5 else ''}")
            elif kind < 0.76:
                parts.append(f"<h{r.randint(2, 4)}>{mark}{self.sentence(r.randint(1, 6))}</h2>")
            elif kind < 0.82:
                parts.append("<ul>" + "".join(f"<li>{mark}{self.sentence()}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.86:
                parts.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.9:
                parts.append(f"<div>{text}</div>")
            elif kind < 0.93:
                parts.append("<table><tr>" + "".join(f"<td>{mark}{self.word()}</td>" for _ in range(r.randint(2, 6))) + "</tr></table>")
            elif kind < 0.96:
                parts.append(f"<figure><img src=x><figcaption>{mark}{self.sentence()}</figcaption></figure>")
            else:
                parts.append(f"<p>{text} <a href='/y'>{self.word()}</a> <em>{self.word()}</em>.</p>")
            if r.random() < 0.15:
                parts.append(self.other(r.choice(["ad", "share", "aside", "notice", "form"])))
        if r.random() < 0.1:
            parts.append(self.other("comments"))
        inside = "".join(parts)
        shape = r.random()
        if shape < 0.45:
            return f"<article{self.attrs(self.CONTENT, 0.4)}>{inside}</article>"
        if shape < 0.6:
            return f"<main{self.attrs(self.CONTENT, 0.3)}>{inside}</main>"
        if shape < 0.9:
            return f"<div{self.attrs(self.CONTENT, 1.0)}>{inside}</div>"
        return f"<div{self.attrs(self.PLAIN, 0.6)}>{inside}</div>"

    def page(self) -> str:
        r = self.r
        before = r.sample(["nav", "header", "ad", "notice", "form", "share", "nav", "aside"], r.randint(1, 5))
        after = r.sample(["aside", "comments", "ad", "footer", "form", "share", "comments", "nav", "notice"], r.randint(0, 5))
        parts = [*map(self.other, before), self.article(), *map(self.other, after)] + ([self.other("footer")] if r.random() < 0.8 else [])
        body = "".join(x + r.choice(["", "\n", "<!-- x -->"]) for x in parts)
        for _ in range(r.randint(0, 2)):
            body = f"<div{self.attrs(self.PLAIN, 0.8)}>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{OTHER}{self.sentence(4)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}" + r.choice(["</body></html>", ""])


def labelled(page: str) -> tuple[list[Block], list[int]]:
    """Blocks and labels of a marked page; the marks are taken out."""
    blocks, labels = [], []
    for b in blocks_of(page):
        labels.append(int(MAIN in b.text))
        text = " ".join(b.text.replace(MAIN, "").replace(OTHER, "").split())
        if text:
            blocks.append(Block(text, b.path, b.linked))
        else:
            labels.pop()
    return blocks, labels


@lru_cache(maxsize=2)
def trained(pages: int = 600, seed: int = 1) -> Field:
    """The field trained on so many generated pages."""
    return train([labelled(PageMaker(seed * 100_003 + i).page()) for i in range(pages)])


def extracted(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``. Rows are independent; no shuffle."""
    field = field or trained()
    content = pages.sparkSession.sparkContext.broadcast((field.weights, field.step, field.bias))
    made: list[Field] = []

    def run(batches):
        if not made:
            made.append(Field(*content.value))
        for batch in batches:
            texts = [made[0].main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return text_batches(pages).select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
