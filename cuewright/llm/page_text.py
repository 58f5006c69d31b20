"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read into leaf blocks: runs of text that no block element's tag interrupts. Each block has features of its
ancestors (tags, what their classes and ids speak of, the nearest landmark) and of its text. The chain labels blocks as
main text or not; its weights are trained on labelled pages and the best labelling is found by Viterbi's algorithm.
Labelled pages come from a generator of layouts (labelled_pages) or from the caller.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

# --- pages into blocks ----------------------------------------------------------------------------------------------

#: Inside a tag quotes count where a value begins, and only if they are closed. Nothing here ever goes back.
_IN_TAG = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+"


def _token(in_tag: str, plain: str) -> re.Pattern:
    """Comments; raw text, which ends with its end tag or the page; tags; declarations; text."""
    return re.compile(
        r"<!--.*?(?:-->|\Z)"
        rf"|<(script|style|iframe|textarea)\b({in_tag}>)(?:.*?</\1\s*>|.*\Z)"
        rf"|<(/?)([a-zA-Z][^\s/>{plain}]*+)({in_tag})>"
        rf"|<[!?][^>{plain}]*+>|([^<]++|<)",
        re.S | re.I,
    )


_TOKEN = _token(_IN_TAG, "")
#: For pages that end inside a tag: from there on no tag holds a further "<".
_PLAIN_TOKEN = _token(_IN_TAG.replace("[^", "[^<"), "<")
_UNENDED = re.compile(r"</?[a-zA-Z!?][^<]*+")
#: What may follow <head>: up to </head> or the first thing that cannot stand in a head.
_HEAD = re.compile(
    r"(?:\s+|<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    rf"|<(script|style|title|noscript|template|noframes)\b{_IN_TAG}>(?:.*?</\1\s*>|.*\Z)"
    rf"|</?(?:meta|link|base|basefont|bgsound)\b{_IN_TAG}>|</(?!head\b|body\b|html\b|br\b)[a-zA-Z]{_IN_TAG}>)*+(?:</head\s*>)?",
    re.S | re.I,
)
_END_NOSCRIPT = re.compile(r"</noscript\s*>", re.I)
#: Dropped up to their end tags; without one, the start tag alone is dropped.
_DROPPED = frozenset("noscript template svg object math canvas audio video select".split())
_FOREIGN = frozenset(("svg", "math"))
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PARTS = re.compile(r"[a-z]+")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LANDMARKS = frozenset("article main nav header footer aside form body".split())

#: What the words of classes, ids and roles speak of.
FAMILIES = {
    "advert": "ad ads adv advert adverts advertisement advertising adbox adslot banner promo promotion sponsor sponsored sponsors adsense dfp outbrain taboola",
    "notice": "cookie cookies consent gdpr notice notices alert alerts popup modal overlay disclaimer announcement toast paywall warning",
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs topbar toolbar tabs pagination pager skip toc sitemap navlinks",
    "header": "masthead siteheader topnav pageheader logo brand header",
    "footer": "footer foot copyright colophon legal bottom",
    "sidebar": "sidebar side aside rail widget widgets related recommended recommendations popular trending complementary more",
    "comment": "comment comments reply replies discussion respond disqus responses feedback reviews commentlist",
    "form": "form newsletter subscribe subscription signup login signin search register searchbox contact",
    "share": "share sharing social tags tag meta byline author bio date timestamp posted",
    "content": "content article post entry story body text main maincontent articlebody postcontent hentry prose copy",
}
_FAMILY = {w: f for f, ws in FAMILIES.items() for w in ws.split()}


@lru_cache(maxsize=20_000)
def _own_features(tag: str, attributes: str) -> tuple[frozenset[str], str | None]:
    """What an element's start tag says of it and its descendants, and the nearest family or landmark that it begins."""
    new, near = {"in:" + tag} if tag not in ("html", "body") else set(), tag if tag in _LANDMARKS else None
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes.strip(" /") else ():
        value, name = "".join(values).lower(), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "none" in value and "display" in value:
            new.add("hidden")
        elif name in ("class", "id", "role"):
            for w in _PARTS.findall(value):
                if f := _FAMILY.get(w):
                    new.add("of:" + f)
                    near = f
    return frozenset(new), near


@lru_cache(maxsize=20_000)
def _joined(inherited: frozenset[str], new: frozenset[str]) -> frozenset[str]:
    return inherited if new <= inherited else inherited | new


@lru_cache(maxsize=20_000)
def _inside(inherited: frozenset[str], near: str) -> list[str]:
    return [*inherited, "near:" + near]


#: Start tags with longer attributes are read anew each time, so that what is kept of pages is bounded in bytes too.
_KEPT_ATTRIBUTES = 400


class _Element:
    """An open element: its tag and the features that its descendants inherit. Nothing of a page outlives it but the bounded
    caches above, whose keys are start tags and sets of features."""

    __slots__ = ("tag", "inherited", "near")

    def __init__(self, tag: str, inherited: frozenset[str], near: str) -> None:
        self.tag, self.inherited, self.near = tag, inherited, near

    @property
    def inside(self) -> list[str]:
        return _inside(self.inherited, self.near)

    def child(self, tag: str, attributes: str) -> _Element:
        """The element of such a start tag."""
        new, near = (_own_features if len(attributes) <= _KEPT_ATTRIBUTES else _own_features.__wrapped__)(tag, attributes)
        return _Element(tag, _joined(self.inherited, new), near or self.near)


_ROOT = _Element("", frozenset(), "body")
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _tokens(page: str) -> list[re.Match]:
    """The page's tokens, without what stands in a head or a noscript element, in one pass over it.

    A tag that the page's end cuts off is dropped up to the next "<"; the rest of the page stays.
    """
    out, at, foreign, more, token = [], 0, 0, True, _TOKEN
    while m := token.match(page, at):
        if m[6] == "<" and (unended := _UNENDED.match(page, at)):
            at = unended.end() if token is _PLAIN_TOKEN else at  # else once more
            token = _PLAIN_TOKEN
            continue
        at = m.end()
        if m[1] and foreign and m[2].endswith("/>"):  # in svg and math such an element is empty
            at = m.end(2)
            continue
        out.append(m)
        if m[4] is None:
            continue
        tag = m[4].lower()
        if tag in _FOREIGN:
            foreign = max(0, foreign - 1) if m[3] else foreign + (not m[5].endswith("/"))
        elif m[3]:
            continue
        elif tag == "head":
            at = _HEAD.match(page, at).end()
        elif tag == "noscript" and more:
            end = _END_NOSCRIPT.search(page, at)
            at, more = (end.end(), True) if end else (at, False)
        elif tag in _BREAKS_OUT:
            foreign = 0
    return out


#: Elements that end an svg or math element that was left open.
_BREAKS_OUT = frozenset("body div p h1 h2 h3 h4 h5 h6 ul ol dl li table blockquote pre".split())


def _dropped(tokens: list[re.Match]) -> dict[int, int]:
    """For start tags of elements that are dropped: the place of the end tag, where there is one."""
    ends, waiting = {}, {t: [] for t in _DROPPED}
    for at, m in enumerate(tokens):
        if m[4] is None or (tag := m[4].lower()) not in _DROPPED:
            continue
        if m[3]:
            if waiting[tag]:
                ends[waiting[tag].pop()] = at
        elif not (tag in _FOREIGN and m[5].endswith("/")):
            waiting[tag].append(at)
    return ends


def blocks(page: str | None) -> list[tuple[str, list[str]]]:
    """(text, features) of each leaf block with text, in page order."""
    stack, out, piece, linked, heading = [_ROOT], [], [], 0, False
    links = 0

    def flush() -> None:
        nonlocal linked
        if piece:
            text = " ".join("".join(piece).split())
            if text:
                out.append((text, stack[-1], linked))
            piece.clear()
        linked = 0

    tokens = _tokens(page or "")
    ends, past = _dropped(tokens), 0
    opened = Counter()
    for at, m in enumerate(tokens):
        if at < past:
            continue
        text = m[6]
        if text is not None:
            if "&" in text:
                text = html.unescape(text)
            piece.append(text)
            if links:
                linked += len(text)
            continue
        if m[4] is None:
            if m[1]:
                piece.append(" ")
            continue
        tag = m[4].lower()
        if tag in _DROPPED or tag == "head":
            piece.append(" ")
            past = ends.get(at, at) + 1
            continue
        if tag in _INLINE:
            if tag == "a":
                links = 0 if m[3] else 1
            continue
        flush()
        if tag in _VOID:
            continue
        if m[3]:
            if opened[tag]:
                while stack[-1].tag != tag:
                    opened[stack.pop().tag] -= 1
                opened[stack.pop().tag] -= 1
                links = 0
            continue
        closing = _CLOSES.get(tag, ())
        if stack[-1].tag == "p" or stack[-1].tag in closing:
            opened[stack.pop().tag] -= 1
        stack.append(stack[-1].child(tag, m[5]))
        opened[tag] += 1
    flush()
    found, n = [], len(out)
    for k, (text, element, linked) in enumerate(out):
        heading = heading or element.tag == "h1"
        found.append((text, _text_features(text, linked, element.tag, k, n, heading) + element.inside))
    return found


_ENDS = (".", "!", "?", "…", '."', ".”", "。", "।", ":", ".)")


def _text_features(text: str, linked: int, tag: str, k: int, n: int, heading: bool) -> list[str]:
    size, share = text.count(" ") + 1, linked / len(text)
    f = [
        "tag:" + tag,
        "words:" + ("1" if size < 3 else "3" if size < 6 else "6" if size < 11 else "11" if size < 21 else "21" if size < 41 else "41"),
        "links:" + ("0" if not linked else "1" if share < 0.3 else "3" if share < 0.8 else "8"),
        "after-heading" if heading else "before-heading",
    ]
    if text.endswith(_ENDS):
        f.append("sentence")
    if "," in text:
        f.append("comma")
    if "©" in text or "copyright" in text.lower():
        f.append("copyright")
    if k == 0:
        f.append("first")
    if k >= n - 1:
        f.append("last")
    return f


# --- labelled pages -------------------------------------------------------------------------------------------------

_SYLLABLES = "an er in on re th st en at ou ing tion ea ti or ver ung ch ment eau que os ado la mi ción".split()


def _words(rng: random.Random, n: int) -> str:
    out = ["".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]
    for k in range(len(out)):
        if rng.random() < 0.08:
            out[k] += rng.choice([",", ".", ".", "&amp;"])
    return " ".join(out)


def _sentence(rng: random.Random, lo: int, hi: int) -> str:
    return _words(rng, rng.randint(lo, hi)).capitalize() + rng.choice(["."] * 7 + ["!", "?", ""])


def labelled_pages(n: int, seed: int = 3) -> list[list[tuple[list[str], int]]]:
    """Pages of many layouts as (features, label) of their blocks: 1 where the text belongs to the article."""
    rng, pages = random.Random(seed), []
    for _ in range(n):
        page = _layout(rng)
        rows = []
        for text, features in blocks(page):
            mark, _, _ = text.partition(" ")
            if mark in ("QQ1", "QQ0"):
                label = int(mark[2])
            else:
                raise ValueError(f"an unmarked block: {text[:60]!r}")
            rest = text[4:]
            size = [f for f in _text_features(rest or "x", 0, "x", 0, 9, True) if f.startswith("words:")]  # without the mark
            rows.append(([f for f in features if not f.startswith("words:")] + size, label))
        if rows:
            pages.append(rows)
    return pages


def _layout(rng: random.Random) -> str:
    """A page whose blocks each begin with a mark, QQ1 for article text and QQ0 for the rest."""
    no = lambda text: "QQ0 " + text
    yes = lambda text: "QQ1 " + text
    maybe = lambda p: rng.random() < p

    def links(k: int, wrap: str = "li") -> str:
        return "".join(f'<{wrap}><a href="/x">{no(_words(rng, rng.randint(1, 4)))}</a></{wrap}>' for _ in range(k))

    def named(*names: str) -> str:
        kind = rng.choice(["class", "class", "id"])
        return f' {kind}="{rng.choice(names)}"'

    def advert() -> str:
        return f"<div{named('ad', 'ad-slot', 'advert', 'banner', 'sponsored', 'promo-box', 'ads')}>{no(_sentence(rng, 3, 18))}</div>"

    def notice() -> str:
        return f"<div{named('cookie-notice', 'notice', 'consent', 'alert', 'popup', 'paywall')}><p>{no(_sentence(rng, 5, 25))}</p>{'<button>' + no('Ok') + '</button>' if maybe(0.5) else ''}</div>"

    def form() -> str:
        name = named("newsletter", "search-form", "signup", "login", "contact-form") if maybe(0.7) else ""
        return f"<form{name}><p>{no(_sentence(rng, 3, 12))}</p><label>{no(_words(rng, 2))}</label><input type=text><button>{no(_words(rng, 1))}</button></form>"

    def menu() -> str:
        tag, name = ("nav", named("menu", "nav", "main-nav") if maybe(0.4) else "") if maybe(0.7) else ("div", named("menu", "navbar", "navigation", "breadcrumbs"))
        return f"<{tag}{name}><ul>{links(rng.randint(2, 9))}</ul></{tag}>"

    def side() -> str:
        tag, name = ("aside", named("sidebar", "rail", "related") if maybe(0.4) else "") if maybe(0.6) else ("div", named("sidebar", "widget", "related", "popular", "right-rail"))
        inner = f"<h3>{no(_words(rng, 2))}</h3><ul>{links(rng.randint(1, 6))}</ul>" if maybe(0.6) else ""
        inner += "".join(f"<p>{no(_sentence(rng, 4, 40))}</p>" for _ in range(rng.randint(0 if inner else 1, 3)))
        return f"<{tag}{name}>{inner}</{tag}>"

    def comments() -> str:
        tag, name = rng.choice(["section", "div", "ul", "ol"]), named("comments", "comment-list", "discussion", "responses", "reader-comments")
        item = "li" if tag in ("ul", "ol") else rng.choice(["div", "article"])
        head = f"<h2>{no(_words(rng, 2))}</h2>" if tag in ("section", "div") and maybe(0.6) else ""
        inner = "".join(
            f"<{item}{named('comment', 'reply') if maybe(0.6) else ''}>" + (f"<b>{no(_words(rng, 2))}</b><br>" if maybe(0.4) else "") + f"<p>{no(_sentence(rng, 3, 60))}</p></{item}>"
            for _ in range(rng.randint(1, 5))
        )
        return f"<{tag}{name}>{head}{inner}{form() if maybe(0.2) else ''}</{tag}>"

    def head() -> str:
        tag, name = ("header", named("masthead", "site-header") if maybe(0.4) else "") if maybe(0.7) else ("div", named("header", "masthead", "logo", "topbar"))
        return f"<{tag}{name}>{'<p>' + no(_sentence(rng, 1, 14)) + '</p>' if maybe(0.7) else ''}{menu() if maybe(0.4) else ''}<div>{no(_words(rng, 2))}</div></{tag}>"

    def foot() -> str:
        tag, name = ("footer", named("footer") if maybe(0.3) else "") if maybe(0.75) else ("div", named("footer", "copyright", "colophon", "legal"))
        return f"<{tag}{name}>{no(rng.choice(['&copy; ', 'Copyright ', '']) + _sentence(rng, 2, 30))}{'<ul>' + links(3) + '</ul>' if maybe(0.3) else ''}</{tag}>"

    def share() -> str:
        return f"<div{named('share', 'social', 'byline', 'tags', 'meta', 'author', 'post-date')}>{no(_words(rng, rng.randint(1, 8)))}</div>"

    def body() -> str:
        out = []
        if maybe(0.85):
            title = f"<h1>{yes(_words(rng, rng.randint(2, 12)))}</h1>"
            out.append(f"<header>{title}</header>" if maybe(0.12) else title)
        if maybe(0.25):
            out.append(share())
        for _ in range(rng.choice([1, 2, 4, 6, 9, 14])):
            kind = rng.random()
            if kind < 0.08:
                out.append(f"<div{named('c1x', 'row', 'para') if maybe(0.5) else ''}>{yes(_sentence(rng, 6, 80))}</div>")
            elif kind < 0.11:
                out.append(f"<section><h3>{yes(_words(rng, 3))}</h3><div><p>{yes(_sentence(rng, 5, 60))}</p></div></section>")
            elif kind < 0.62:
                out.append(f"<p>{yes(_sentence(rng, 1, 90) + ' ' + _sentence(rng, 2, 40))}</p>" if maybe(0.7) else f"<p>{yes(_sentence(rng, 1, 12))}</p>")
            elif kind < 0.70:
                out.append(f"<p><b>{yes(_sentence(rng, 2, 30))}<br>")
            elif kind < 0.76:
                out.append(f"<h2>{yes(_words(rng, rng.randint(1, 8)))}</h2>")
            elif kind < 0.82:
                tag = rng.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{yes(_sentence(rng, 1, 25))}</li>" for _ in range(rng.randint(1, 5))) + f"</{tag}>")
            elif kind < 0.85:
                out.append(f"<blockquote><p>{yes(_sentence(rng, 4, 40))}</p></blockquote>")
            elif kind < 0.88:
                out.append(f"<pre>{yes(_words(rng, 9))}</pre>")
            elif kind < 0.91:
                out.append("<table>" + "".join(f"<tr><td>{yes(_words(rng, 2))}</td><td>{yes(_words(rng, 3))}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif kind < 0.94:
                out.append(f'<p>{yes(_sentence(rng, 4, 20))} <a href="/y">{_words(rng, 3)}</a> {_sentence(rng, 2, 9)}</p>')
            else:
                out.append(rng.choice([advert, side, form, notice, share])())
        if maybe(0.15):
            out.append(comments())
        if maybe(0.1):
            out.append(side())
        return "".join(out)

    wrap = rng.random()
    main = body()
    if wrap < 0.5:
        main = f"<article{named('post', 'entry', 'story') if maybe(0.3) else ''}>{main}</article>"
    elif wrap < 0.65:
        main = f"<main>{main}</main>"
    elif wrap < 0.75:
        main = f"<main><article>{main}</article></main>"
    else:
        main = f"<div{named('content', 'article-body', 'post-content', 'entry', 'story', 'main') if maybe(0.8) else ''}>{main}</div>"
    before = [f for f, p in ((head, 0.5), (menu, 0.8), (notice, 0.2), (advert, 0.4), (form, 0.15), (side, 0.2)) if maybe(p)]
    after = [f for f, p in ((comments, 0.35), (side, 0.4), (advert, 0.25), (form, 0.2), (menu, 0.15), (notice, 0.15), (foot, 0.8)) if maybe(p)]
    parts = "".join(f() for f in before) + main + "".join(f() for f in after)
    for name in rng.sample(["page", "wrapper", "container", "site", "layout"], rng.choice([0, 0, 1, 2])):
        parts = f'<div class="{name}">{parts}</div>'
    return f"<html><body>{parts}</body></html>"


# --- the chain ------------------------------------------------------------------------------------------------------


class Chain:
    """A two-label linear chain: a weight for each feature and label 1, and for each pair of neighbouring labels."""

    def __init__(self, weights: dict[str, float], bias: float, step: np.ndarray, start: np.ndarray) -> None:
        self.weights, self.bias, self.step, self.start = weights, bias, step.tolist(), start.tolist()

    def decode(self, features: Iterable[list[str]]) -> list[int]:
        """The likeliest labels, by Viterbi's algorithm."""
        get, back = self.weights.get, []
        (s00, s01), (s10, s11) = self.step
        a, b = self.start
        for k, f in enumerate(features):
            gain = self.bias + sum(get(x, 0.0) for x in f)
            if k:
                from0, from1 = a + s01 > b + s11, a + s00 > b + s10
                back.append((0 if from1 else 1, 0 if from0 else 1))
                a, b = max(a + s00, b + s10), max(a + s01, b + s11)
            b += gain
        labels = [int(b > a)]
        for before in reversed(back):
            labels.append(before[labels[-1]])
        return labels[::-1]


def train_chain(pages: list[list[tuple[list[str], int]]], *, rounds: int = 250, rate: float = 0.15, penalty: float = 2e-4, seed: int = 5) -> Chain:
    """Maximise the pages' penalised conditional likelihood by gradient ascent with momentum, all pages side by side."""
    names = sorted({f for page in pages for fs, _ in page for f in fs})
    number = {f: k for k, f in enumerate(names)}
    n, most = len(pages), max(map(len, pages))
    y, mask = np.zeros((n, most), dtype=int), np.zeros((n, most), dtype=bool)
    rows, cols = [], []
    for i, page in enumerate(pages):
        for t, (fs, label) in enumerate(page):
            y[i, t], mask[i, t] = label, True
            rows += [i * most + t] * len(fs)
            cols += [number[f] for f in fs]
    rows, cols = np.array(rows), np.array(cols)
    w, step, start = np.zeros(len(names) + 1), np.zeros((2, 2)), np.zeros(2)
    total = mask.sum()
    momentum = [np.zeros_like(x) for x in (w, step, start)]
    square = [np.zeros_like(x) for x in (w, step, start)]
    pair_true = np.zeros((2, 2))
    both = mask[:, 1:]
    np.add.at(pair_true, (y[:, :-1][both], y[:, 1:][both]), 1)
    for k in range(1, rounds + 1):
        emit = np.zeros((n, most, 2))
        emit[:, :, 1] = (np.bincount(rows, weights=w[cols], minlength=n * most) + w[-1]).reshape(n, most)
        ahead, back = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        ahead[:, 0] = start + emit[:, 0]
        for t in range(1, most):
            new = np.logaddexp(ahead[:, t - 1, 0, None] + step[0], ahead[:, t - 1, 1, None] + step[1]) + emit[:, t]
            ahead[:, t] = np.where(mask[:, t, None], new, ahead[:, t - 1])
        for t in range(most - 2, -1, -1):
            right = emit[:, t + 1] + back[:, t + 1]
            new = np.logaddexp(step[:, 0] + right[:, 0, None], step[:, 1] + right[:, 1, None])
            back[:, t] = np.where(mask[:, t + 1, None], new, 0)
        norm = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        chance = np.exp(ahead + back - norm[:, None, None])
        pair = np.exp(ahead[:, :-1, :, None] + step + (emit + back)[:, 1:, None, :] - norm[:, None, None, None])
        error = np.where(mask, y - chance[:, :, 1], 0).ravel()
        grads = [
            np.append(np.bincount(cols, weights=error[rows], minlength=len(names)), error.sum()) / total - penalty * w,
            (pair_true - pair[both].sum(axis=0)) / total - penalty * step,
            (np.bincount(y[:, 0], minlength=2) - chance[:, 0].sum(axis=0)) / n - penalty * start,
        ]
        for x, g, m, s in zip((w, step, start), grads, momentum, square, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            x += rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)
    return Chain({f: float(x) for f, x in zip(names, w, strict=False) if abs(x) > 1e-6}, float(w[-1]), step, start)


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page)
    if not found:
        return ""
    labels = chain.decode(f for _, f in found)
    return " ".join(text for (text, _), label in zip(found, labels, strict=True) if label)


@lru_cache(maxsize=4)
def _default_chain(training_pages: int) -> Chain:
    return train_chain(labelled_pages(training_pages))


def extract_text(pages: DataFrame, *, chain: Chain | None = None, training_pages: int = 600) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars.

    A null html is empty; a page without main text gives an empty text; repeated rows are answered each; other columns
    are ignored. Without a chain one is trained on labelled_pages(training_pages).
    """
    if chain is None:
        chain = _default_chain(training_pages)
    shared = pages.sparkSession.sparkContext.broadcast(chain)

    def make():
        c = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(p, c) for p in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

        return each

    return map_batches(pages.select("page_id", "url", "html"), make, "page_id long, url string, text string, n_chars long")
