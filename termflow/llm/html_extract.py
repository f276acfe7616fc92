"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into blocks: runs of text between block-level tags, with the open elements above them. Each block gets features
of its ancestors (tags, roles, words of class and id), its text (length, links, sentence ends) and its place; the chain adds
how labels follow each other. Weights are fitted by gradient ascent on the likelihood of labelled pages; Viterbi
decoding labels the blocks of a page, and the blocks labelled as content make the text.

Cases: null, empty or text-free html gives an empty text; broken markup is read as far as it goes (unclosed paragraphs end at
the next block, quotes count only in values, a bracket that opens no tag is text); scripts, styles, comments and hidden elements
have no text; any markup is read in linear time; elements nested over 512 deep are siblings; ties in decoding go to "not content"; repeated
rows give equal texts; an empty table gives an empty result; other columns stay.
"""
from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Element names of HTML.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math head object canvas audio video".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: Elements nested deeper than this become siblings, as in browsers.
MAX_DEPTH = 512

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: One attribute; quotes count only after the equals sign.
_ATTR = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_REST = re.compile(r"[\s/=]*")
_KNOWN = frozenset("class id role style hidden aria-hidden aria-label".split())
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Block:
    __slots__ = ("text", "tags", "names", "leaf", "linked")

    def __init__(self, text: str, tags: frozenset[str], names: frozenset[str], leaf: str, linked: int):
        self.text, self.tags, self.names, self.leaf, self.linked = text, tags, names, leaf, linked


@lru_cache(1 << 14)
def _names(attrs: str) -> tuple[frozenset[str], bool]:
    """Words of class, id and role; whether the element is hidden."""
    words, hidden = set(), False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if name not in _KNOWN:
            continue
        if name == "style":
            hidden |= bool(_HIDDEN.search(value.lower()))
        elif name == "hidden" or name == "aria-hidden":
            hidden |= name == "hidden" or value.lower() == "true"
        elif name == "role":
            words.add("role:" + value.lower())
        else:
            words.update(_WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()))
    return frozenset(words), hidden


class Scanner:
    """Tags of a page from left to right in linear time, whatever quotes and brackets are left open."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.dead: set[int] = set()  # ends of attributes from which no tag end follows
        self.ended: dict[str, int] = {}

    def tag_end(self, at: int) -> int:
        """Place of the bracket that closes the tag whose attributes start at `at`, -1 if none does."""
        seen = []
        while at <= self.last and at not in self.dead:
            seen.append(at)
            at = _REST.match(self.page, at).end()
            if at > self.last:
                break
            if self.page[at] == ">":
                return at
            at = _ATTR.match(self.page, at).end()
        self.dead.update(seen)
        return -1

    def find(self, what: str, at: int) -> int:
        """Next place of a fixed text, remembered, so that a missing one is sought once."""
        known = self.ended.get(what, -1)
        if known < at:
            known = self.page.find(what, at)
            self.ended[what] = known = len(self.page) if known < 0 else known
        return known

    def end_of(self, tag: str, at: int) -> re.Match | None:
        """The next end tag of a raw element."""
        if self.ended.get("</" + tag, 0) < 0:
            return None
        m = _end_tag(tag).search(self.page, at)
        if not m:
            self.ended["</" + tag] = -1
        return m


@lru_cache(64)
def _end_tag(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


_BODY = re.compile(r"<body[\s>]", re.I)
_NONE: frozenset[str] = frozenset()


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks in page order."""
    if not page:
        return []
    out: list[Block] = []
    # tag, whether it or an element above is hidden, all tags and all names down to it
    stack: list[tuple[str, bool, frozenset[str], frozenset[str]]] = []
    count: dict[str, int] = {}
    parts: list[tuple[str, bool]] = []
    scan = Scanner(page)

    def flush() -> None:
        if not parts:
            return
        text = _SPACE.sub(" ", html_lib.unescape("".join(p for p, _ in parts))).strip()
        if text:
            linked = sum(len(p.strip()) for p, a in parts if a)
            _, _, tags, names = stack[-1] if stack else ("", False, _NONE, _NONE)
            leaf = next((t[0] for t in reversed(stack) if t[0] in BLOCK), "body")
            out.append(Block(text, tags, names, leaf, linked))
        parts.clear()

    def close(upto: int) -> None:
        if any(t[0] in BLOCK for t in stack[upto:]):
            flush()
        for t in stack[upto:]:
            count[t[0]] -= 1
        del stack[upto:]

    def top(*tags: str) -> int:
        """Place of the innermost open element of these, -1 for none."""
        if not any(count.get(t) for t in tags):
            return -1
        return next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in tags)

    def say(text: str) -> None:
        if text and not (stack and stack[-1][1]):
            parts.append((text, count.get("a", 0) > 0))

    at, n = 0, len(page)
    while at < n:
        start = scan.find("<", at)
        say(page[at:start])
        if start >= n:
            break
        if page.startswith("<!--", start):
            at = min(n, scan.find("-->", start + 4) + 3)
            continue
        if page.startswith("<![CDATA[", start):
            end = scan.find("]]>", start)
            say(page[start + 9:end])
            at = min(n, end + 3)
            continue
        if page[start + 1:start + 2] in ("!", "?"):
            at = min(n, scan.find(">", start) + 1)
            continue
        closing = page[start + 1:start + 2] == "/"
        m = _NAME.match(page, start + 1 + closing)
        end = scan.tag_end(m.end()) if m else -1
        if end < 0:  # no tag
            say("<")
            at = start + 1
            continue
        at, tag, attrs = end + 1, m[0].lower(), page[m.end():end]
        if closing:
            i = top(tag)
            if i >= 0:
                close(i)
            elif tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            if not attrs.endswith("/"):
                stop = scan.end_of(tag, at)
                if stop:
                    at = stop.end()
                elif tag != "head":
                    at = n
                elif scan.ended.get("<body", 0) >= 0:  # the end tag of a head may be left out
                    body = _BODY.search(page, at)
                    at, scan.ended["<body"] = (body.start(), 0) if body else (at, -1)
            if tag in ("textarea", "iframe", "object", "svg", "math", "canvas", "audio", "video"):
                parts.append((" ", False))
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "wbr", "img"):
                parts.append(("" if tag == "wbr" else " ", False))
            continue
        if tag in BLOCK:
            flush()
            i = top("p")
            if i >= 0:
                close(i)
            if tag in CLOSES:
                outer = top("ul", "ol", "dl", "table", "select")
                i = next((i for i in range(outer + 1, len(stack)) if stack[i][0] in CLOSES[tag]), -1)
                if i >= 0:
                    close(i)
        if not attrs.endswith("/") or tag in BLOCK:
            if len(stack) >= MAX_DEPTH:
                close(MAX_DEPTH - 1)
            names, hidden = _names(attrs)
            _, above, tags, all_names = stack[-1] if stack else ("", False, _NONE, _NONE)
            stack.append((tag, above or hidden, tags if tag in tags else tags | {tag}, all_names if names <= all_names else all_names | names))
            count[tag] = count.get(tag, 0) + 1
    flush()
    return out


_END = re.compile(r"[.!?…。！？:;\"')»”]\s*$")


def features(blocks: list[Block]) -> list[list[str]]:
    """Feature names of each block."""
    out, n = [], len(blocks)
    for i, b in enumerate(blocks):
        words, size = b.text.count(" ") + 1, len(b.text)
        f = ["bias", "leaf=" + b.leaf, f"len={min(7, int(math.log2(words)))}"]
        f += ["in=" + t for t in b.tags] + ["name=" + w for w in b.names]
        share = b.linked / max(1, size)
        f.append("link=" + ("no" if share < 0.05 else "some" if share < 0.5 else "most"))
        if _END.search(b.text):
            f.append("ends")
        stops = b.text.count(". ") + b.text.count("? ") + b.text.count("! ") + b.text.count("。")
        f.append(f"stops={min(3, stops)}")
        if "©" in b.text or "(c)" in b.text.lower():
            f.append("copyright")
        if sum(c.isdigit() for c in b.text) * 4 > size:
            f.append("digits")
        f.append("place=" + ("first" if i == 0 else "last" if i == n - 1 else "early" if i * 5 < n else "late" if i * 5 >= 4 * n else "middle"))
        if "article" in b.tags or "main" in b.tags:
            f.append("inner=" + b.leaf)
        out.append(f)
    return out


class Crf:
    """Two labels (1: content); weights of each feature by label, of label pairs, of the first label."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.w = np.zeros((0, 2))
        self.pair, self.first = np.zeros((2, 2)), np.zeros(2)

    def _scores(self, seq: list[list[int]]) -> np.ndarray:
        return np.array([self.w[f].sum(axis=0) for f in seq])

    def _expect(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Marginals of labels and of pairs, log partition; forward-backward."""
        n = len(s)
        a, b = np.zeros((n, 2)), np.zeros((n, 2))
        a[0] = s[0] + self.first
        for i in range(1, n):
            x = a[i - 1][:, None] + self.pair
            top = x.max(axis=0)
            a[i] = s[i] + top + np.log(np.exp(x - top).sum(axis=0))
        for i in range(n - 2, -1, -1):
            x = self.pair + (s[i + 1] + b[i + 1])[None]
            top = x.max(axis=1)
            b[i] = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
        z = np.logaddexp(a[-1][0], a[-1][1])
        one = np.exp(a + b - z)
        two = np.zeros((2, 2))
        for i in range(1, n):
            two += np.exp(a[i - 1][:, None] + self.pair + (s[i] + b[i])[None] - z)
        return one, two, float(z)

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = 25, rate: float = 0.3, decay: float = 1e-3) -> Crf:
        """Adagrad ascent on the likelihood of labelled pages, one page a step."""
        for fs, _ in pages:
            for f in fs:
                for x in f:
                    self.index.setdefault(x, len(self.index))
        self.w = np.zeros((len(self.index), 2))
        g_w, g_p, g_f = np.full_like(self.w, 1e-2), np.full((2, 2), 1e-2), np.full(2, 1e-2)
        data = [([[self.index[x] for x in f] for f in fs], np.array(y)) for fs, y in pages if fs]
        order = random.Random(2)
        for _ in range(epochs):
            order.shuffle(data)
            for seq, y in data:
                one, two, _ = self._expect(self._scores(seq))
                diff = -one
                diff[np.arange(len(y)), y] += 1
                grad = np.zeros_like(self.w)
                np.add.at(grad, [i for f in seq for i in f], np.repeat(diff, [len(f) for f in seq], axis=0))
                used = np.unique([i for f in seq for i in f])
                step = grad[used] - decay * self.w[used]
                g_w[used] += step ** 2
                self.w[used] += rate * step / np.sqrt(g_w[used])
                seen = np.zeros((2, 2))
                np.add.at(seen, (y[:-1], y[1:]), 1)
                step = seen - two - decay * self.pair
                g_p += step ** 2
                self.pair += rate * step / np.sqrt(g_p)
                step = diff[0] - decay * self.first
                g_f += step ** 2
                self.first += rate * step / np.sqrt(g_f)
        return self

    def decode(self, fs: list[list[str]]) -> list[int]:
        """Most likely labels (Viterbi)."""
        if not fs:
            return []
        w, index = self.w, self.index
        p00, p01, p10, p11 = self.pair.ravel().tolist()
        back, score = [], None
        for f in fs:
            s0, s1 = w[[index[x] for x in f if x in index]].sum(axis=0).tolist()
            if score is None:
                score = (self.first[0] + s0, self.first[1] + s1)
                continue
            a, b = score
            from0 = 0 if a + p00 >= b + p10 else 1
            from1 = 0 if a + p01 >= b + p11 else 1
            score = ((a + p00 if from0 == 0 else b + p10) + s0, (a + p01 if from1 == 0 else b + p11) + s1)
            back.append((from0, from1))
        y = [0 if score[0] >= score[1] else 1]
        for step in reversed(back):
            y.append(step[y[-1]])
        return y[::-1]


def labelled_pages(count: int = 240, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Labelled training pages: (html, content blocks in order), composed from layouts of common kinds with invented words."""
    r = random.Random(seed)
    syllables = ["an", "be", "co", "da", "el", "fi", "ga", "hu", "in", "jo", "ka", "lo", "mi", "no", "or", "pa", "qui", "re", "sa", "tu", "un", "ve", "wo", "xi", "yo", "zu"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def sentence(lo: int = 3, hi: int = 16) -> str:
        return " ".join(word() for _ in range(r.randint(lo, hi))).capitalize() + r.choice("....?!")

    def prose(hi: int = 6) -> str:
        return " ".join(sentence() for _ in range(r.randint(1, hi)))

    few = lambda lo, hi: " ".join(word() for _ in range(r.randint(lo, hi)))
    links = lambda n: "".join(f'<li><a href="/{word()}">{few(1, 3)}</a></li>' for _ in range(n))
    out = []
    for _ in range(count):
        kept: list[str] = []

        def keep(tag: str, text: str, attrs: str = "", kept: list[str] = kept) -> str:
            kept.append(text)
            end = "" if tag == "p" and r.random() < 0.15 else f"</{tag}>"
            return f"<{tag}{attrs}>{'<b>' if r.random() < 0.1 else ''}{text}{'<br>' if r.random() < 0.1 else ''}{end}"

        def menu() -> str:
            body = f"<ul>{links(r.randint(3, 8))}</ul>"
            return r.choice([f"<nav>{body}</nav>", f'<div class="menu">{body}</div>', f'<div id="nav" role="navigation">{body}</div>', f'<ul class="breadcrumb">{links(3)}</ul>'])

        def advert() -> str:
            text = r.choice([sentence(), few(2, 9), prose(3)])
            return r.choice([f'<div class="ad">{text}</div>', f'<div class="advert sponsored"><p>{text}</p></div>', f'<aside class="promo">{text}</aside>', f'<div id="ads-{r.randint(1, 9)}" class="banner"><a href="/x">{text}</a></div>', f'<section class="advertisement"><h3>{few(1, 3)}</h3><p>{text}</p></section>'])

        def notice() -> str:
            return r.choice([f'<div class="cookie-notice"><p>{prose(2)}</p><button>{few(1, 2)}</button></div>', f'<div role="alert" class="notice">{prose(2)}</div>', f'<div id="consent" class="popup">{sentence()} <a href="/privacy">{few(1, 2)}</a></div>', f'<div class="alert warning"><p>{sentence()}</p></div>'])

        def side() -> str:
            inner = r.choice([f"<h3>{few(1, 3)}</h3><ul>{links(r.randint(2, 6))}</ul>", f"<h4>{few(1, 3)}</h4><p>{prose(3)}</p>", f"<p>{prose(4)}</p>"])
            return r.choice([f"<aside>{inner}</aside>", f'<div class="sidebar">{inner}</div>', f'<div id="sidebar" class="widget">{inner}</div>', f'<div class="related"><h3>{few(1, 2)}</h3><ul>{links(4)}</ul></div>', f'<aside class="sidebar">{inner}</aside>'])

        def form() -> str:
            return r.choice([f'<form><label>{few(1, 3)}</label><input name="q"><button>{few(1, 1)}</button></form>', f'<form class="newsletter"><p>{sentence()}</p><input type="email"><button>{few(1, 2)}</button></form>', f'<div class="search"><form>{few(1, 3)}<select><option>{word()}</option></select></form></div>'])

        def comments() -> str:
            one = lambda: r.choice([f'<div class="comment"><h4>{few(1, 2)}</h4><p>{prose(4)}</p></div>', f'<li class="comment"><b>{word()}</b><p>{prose(3)}</p></li>'])
            inner = "".join(one() for _ in range(r.randint(1, 5)))
            return r.choice([f'<section id="comments"><h2>{few(1, 2)}</h2>{inner}</section>', f'<div class="comments">{inner}</div>', f'<ol class="commentlist">{inner}</ol>', f'<section class="comments reader">{inner}{form()}</section>'])

        def head() -> str:
            return r.choice([f"<header><h1>{few(1, 3)}</h1>{menu()}</header>", f'<div class="header"><p>{few(2, 6)}</p></div>', f'<header class="site-header"><a href="/">{few(1, 2)}</a><p>{sentence()}</p></header>', menu()])

        def foot() -> str:
            text = r.choice([f"&copy; {word()}.example &middot; {sentence()}", f"{prose(2)}", f"<p>&copy; 20{r.randint(10, 29)} {few(1, 3)}</p><ul>{links(3)}</ul>"])
            return r.choice([f"<footer>{text}</footer>", f'<div class="footer">{text}</div>', f'<div id="footer" role="contentinfo">{text}</div>'])

        def story() -> str:
            parts = [keep("h1", few(3, 10) + r.choice(["", "."]))] if r.random() < 0.9 else []
            if r.random() < 0.15 and parts:
                parts = [f"<header>{parts[0]}</header>"]
            for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12])):
                x = r.random()
                if x < 0.78:
                    parts.append(keep("p", r.choice([prose(), prose(8), prose(60), sentence(1, 3)])))
                elif x < 0.85:
                    parts.append(keep(r.choice(["h2", "h3"]), few(2, 6)))
                elif x < 0.89:
                    parts.append("<ul>" + "".join(keep("li", r.choice([sentence(), few(2, 6)])) for _ in range(r.randint(2, 4))) + "</ul>")
                elif x < 0.92:
                    parts.append("<blockquote>" + keep("p", prose(2)) + "</blockquote>")
                elif x < 0.94:
                    parts.append("<figure><img src='/x'>" + keep("figcaption", sentence()) + "</figure>")
                elif x < 0.96:
                    parts.append("<table><tr>" + "".join(keep("td", r.choice([word(), str(r.randint(1, 999))])) for _ in range(3)) + "</tr></table>")
                elif x < 0.98:
                    parts.append(advert())
                else:
                    parts.append(r.choice([f'<div class="share">{few(1, 3)}</div>', f'<ul class="social">{links(3)}</ul>', form()]))
            body = "".join(parts)
            return r.choice([f"<article>{body}</article>"] * 4 + [f"<main>{body}</main>", f"<main><article>{body}</article></main>", f'<div class="post-content">{body}</div>', f'<div id="content" class="entry">{body}</div>', f"<section>{body}</section>", f'<div class="story-body">{body}</div>', f"<div>{body}</div>", body])

        before = [head(), *[r.choice([advert, notice, side, form])() for _ in range(r.randint(0, 3))]]
        bare = r.random() < 0.12
        page = [story()] if bare else before + [story()] + [r.choice([side, advert, comments, comments, form, notice])() for _ in range(r.randint(0, 3))] + ([foot()] if r.random() < 0.9 else [])
        title = f"<head><meta charset='utf-8'><title>{few(2, 6)}</title><style>p{{margin:0}}</style></head>" if r.random() < 0.9 else ""
        out.append((f"<!DOCTYPE html><html>{title}<body>{''.join(page)}</body></html>", kept))
    for _ in range(count // 5):  # pages that are nothing but a paragraph or two
        kept = [r.choice([prose(), prose(20), sentence()]) for _ in range(r.choice([1, 1, 1, 2]))]
        tag = r.choice(["p", "div", "section", ""])
        body = "".join(f"<{tag}>{k}</{tag}>" for k in kept) if tag else "<hr>".join(kept)
        out.append((r.choice(["<html><body>{}</body></html>", "<!DOCTYPE html><html><head><title>x</title></head><body>{}</body></html>", "<body>{}</body>", "{}"]).format(body), kept))
    return out


def label(page: str, content: list[str]) -> tuple[list[list[str]], list[int]]:
    """Features and labels of a page's blocks; content blocks are matched in order."""
    blocks, y, at = blocks_of(page), [], 0
    want = [_SPACE.sub(" ", html_lib.unescape(c)).strip() for c in content]
    for b in blocks:
        hit = at < len(want) and b.text == want[at]
        y.append(int(hit))
        at += hit
    return features(blocks), y


def train(pages: list[tuple[str, list[str]]] | None = None) -> Crf:
    """Model of labelled pages (html, content blocks); the library's own if none are given. They are few: a fixed, bounded set."""
    return Crf().fit([label(h, c) for h, c in pages or labelled_pages()])


def main_text(page: str | None, model: Crf) -> str:
    blocks = blocks_of(page)
    return "\n".join(b.text for b, y in zip(blocks, model.decode(features(blocks)), strict=True) if y)


def extract(pages: DataFrame, model: Crf, html: str = "html", text: str = "text") -> DataFrame:
    """pages with the main text in place of the html and its length in code points, n_chars."""
    shared, at = pages.sparkSession.sparkContext.broadcast(model), pages.columns.index(html)
    rest = [i for i, f in enumerate(pages.schema.fields) if i != at and f.name.lower() not in (text.lower(), "n_chars")]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(p, shared.value) for p in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in rest), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], [*(b.schema.names[i] for i in rest), text, "n_chars"])

    return pages.mapInArrow(job, T.StructType([*(pages.schema.fields[i] for i in rest), T.StructField(text, T.StringType()), T.StructField("n_chars", T.LongType())]))
