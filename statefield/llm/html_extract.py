"""HTML main text: a linear-chain conditional random field over the leaf blocks of the page.

Features of a block are the elements above it with the words of their class, id and role names, its own element, and its text:
length, link share, punctuation, place; and whether the page has an element known to hold articles at all. Two labels (article or not) form a chain; weights come from labelled pages, which
labelled_pages() writes in many layouts, by gradient ascent on the penalised likelihood with forward-backward; pages are
decoded by Viterbi. Training takes seconds on the driver, its pages are bounded by TRAIN_PAGES, and the weights are small.

Defined results: null html counts as empty and gives an empty text; so do pages without article blocks. Null or clashing
other columns pass by; repeated rows give repeated results; empty tables give no rows. Whole pages are read whatever their length.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .dom import Block, blocks

#: Pages written to train on.
TRAIN_PAGES = 800
#: Words in class, id and role names that features name.
WORDS = (
    "content article main post entry story body text prose "
    "nav navigation menu breadcrumb toc header masthead logo footer sidebar aside widget rail secondary complementary "
    "ad ads advert advertisement sponsor sponsored promo promotion banner cookie consent gdpr notice popup modal overlay alert "
    "comment comments reply replies discussion disqus respond thread form login signup search subscribe newsletter "
    "share social related recommended more tags meta byline copyright legal pagination skip toolbar hidden contentinfo"
).split()
_LONG = [w for w in WORDS if len(w) >= 5]
_EXACT = frozenset(WORDS)


@functools.lru_cache(maxsize=50_000)
def named(names: str) -> tuple[str, ...]:
    """Known words in class, id and role names."""
    found = set()
    for part in re.split(r"[^a-z]+", names):
        if part in _EXACT:
            found.add(part)
        elif part:
            found.update(w for w in _LONG if w in part)
    return tuple(sorted(found))


#: Elements around what isn't an article, whatever their names.
_FRAMING = frozenset("nav aside header footer form button label select menu".split())


@functools.lru_cache(maxsize=20_000)
def path_features(path: tuple[tuple[str, str], ...]) -> tuple[str, ...]:
    tags = [t for t, _ in path if t not in ("html", "body")]
    out = {f"above={t}" for t in tags} | {f"own={tags[-1] if tags else 'body'}"}
    for i, (_, names) in enumerate(path):
        for w in named(names):
            out.add(f"name={w}")
            if i == len(path) - 1:
                out.add(f"ownname={w}")
    if not any(named(n) for _, n in path) and not _FRAMING & set(tags):
        out.add("plain")
    holders = [i for i, (t, n) in enumerate(path) if t in ("article", "main") or {"content", "article", "main", "post", "entry", "story"} & set(named(n))]
    if holders:
        out.add("held")
        inner = path[holders[-1] + 1 :]
        if all(t in ("p", "div", "h1", "h2", "h3", "h4", "ul", "ol", "li", "blockquote", "pre", "section", "table", "tbody", "tr", "td") and not named(n) for t, n in inner):
            out.add("held plainly")
    return tuple(sorted(out))


def text_features(b: Block) -> list[str]:
    t = b.text
    n = t.count(" ") + 1
    out = [f"words={min(6, n.bit_length())}", f"linked={min(4, 4 * b.linked // max(1, len(t)))}"]
    if t[-1] in ".!?…\"”»":
        out.append("ends")
    if ", " in t or ". " in t:
        out.append("sentences")
    if "©" in t or "copyright" in t[:200].lower():
        out.append("copyright")
    if n <= 12 and re.search(r"[0-9]{2,}", t):
        out.append("short with numbers")
    return out


def features(page: list[Block]) -> list[list[str]]:
    """Of each block; where no element that is known to hold articles is on the page, blocks say so, as more hangs on their text then."""
    last = len(page) - 1
    paths = [path_features(b.path) for b in page]
    without = not any("held" in p for p in paths)
    out = []
    for i, (b, path) in enumerate(zip(page, paths)):
        text = text_features(b)
        found = ["bias", *path, *text, *(["first"] if i == 0 else ()), *(["last"] if i == last else ())]
        if without:
            plain = "plain" if "plain" in path else "framed"
            found += ["unheld page", f"unheld {plain}", *(f"unheld {plain} {x}" for x in text if x in ("ends", "sentences") or x.startswith(("words", "linked")))]
        elif "held" not in path:
            found.append("outside")
        out.append(found)
    return out


class ChainCRF:
    """Two labels; unary weights by feature, a transition matrix and start weights."""

    def __init__(self, weights: dict[str, float], transition: list[list[float]], start: list[float]):
        self.weights, self.transition, self.start = weights, transition, start

    def decode(self, feats: list[list[str]]) -> list[int]:
        """The most likely labels, by Viterbi."""
        if not feats:
            return []
        get, (t00, t01), (t10, t11) = self.weights.get, *self.transition
        s0, s1 = self.start
        back: list[tuple[int, int]] = []
        for i, f in enumerate(feats):
            u = sum([get(x, 0.0) for x in f])
            if i:
                a, b = s0 + t00, s1 + t10
                c, d = s0 + t01, s1 + t11
                back.append((int(b > a), int(d > c)))
                s0, s1 = max(a, b), max(c, d)
            s1 += u
        label = int(s1 > s0)
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]

    @classmethod
    def fit(cls, pages: list[tuple[list[list[str]], list[int]]], steps: int = 150, rate: float = 0.15, penalty: float = 1e-4) -> ChainCRF:
        """Adam on the penalised conditional log-likelihood of all pages at once, padded to one length."""
        pages = [p for p in pages if p[0]]
        names = sorted({x for f, _ in pages for block in f for x in block})
        at = {x: i for i, x in enumerate(names)}
        n, longest, k = len(pages), max(len(f) for f, _ in pages), len(names)
        x = np.zeros((n, longest, k), np.float32)
        y, mask = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
        for i, (f, labels) in enumerate(pages):
            for j, block in enumerate(f):
                x[i, j, [at[name] for name in block]] = 1
            y[i, : len(f)], mask[i, : len(f)] = labels, True
        total = mask.sum()
        w, t, s = np.zeros(k), np.zeros((2, 2)), np.zeros(2)
        flat = x.reshape(-1, k)
        moments = [(np.zeros_like(v), np.zeros_like(v)) for v in (w, t, s)]
        pair_count = np.zeros((2, 2))
        np.add.at(pair_count, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), 1)
        start_count = np.bincount(y[:, 0], minlength=2)
        lengths = mask.sum(1)
        for step in range(1, steps + 1):
            u = np.zeros((n, longest, 2))
            u[:, :, 1] = (flat @ w.astype(np.float32)).reshape(n, longest)
            alpha, beta = np.zeros_like(u), np.zeros_like(u)
            alpha[:, 0] = u[:, 0] + s
            for j in range(1, longest):
                new = np.logaddexp(alpha[:, j - 1, 0, None] + t[0], alpha[:, j - 1, 1, None] + t[1]) + u[:, j]
                alpha[:, j] = np.where(mask[:, j, None], new, alpha[:, j - 1])
            for j in range(longest - 2, -1, -1):
                m = u[:, j + 1] + beta[:, j + 1]
                new = np.stack([np.logaddexp(t[c, 0] + m[:, 0], t[c, 1] + m[:, 1]) for c in (0, 1)], 1)
                beta[:, j] = np.where(mask[:, j + 1, None], new, 0.0)
            z = np.logaddexp(*alpha[np.arange(n), lengths - 1].T)
            p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]) * mask
            joint = np.exp(alpha[:, :-1, :, None] + t[None, None] + (u + beta)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
            p_start = np.exp(alpha[:, 0] + beta[:, 0] - z[:, None]).sum(0)
            grads = (((y * mask - p1).reshape(-1) @ flat) / total - penalty * w, (pair_count - joint.sum((0, 1))) / total - penalty * t, (start_count - p_start) / total - penalty * s)
            for v, g, (m1, m2) in zip((w, t, s), grads, moments):
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g * g - m2)
                v += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        return cls(dict(zip(names, w.tolist())), t.tolist(), s.tolist())


def labelled_page(rng: random.Random, holder: str | None = None) -> tuple[str, list[str]]:
    """A page in a layout drawn at random, and the blocks of its article. holder: markup around the article, at {}.

    A third of the pages have the article in no element that is known to hold one: in the body, in tables, under unknown names.
    """
    syllables = "an ber cha den er fo gel hi in ka lo men na or pre qui ra sen ti u ve wa zu é ción ß".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(1, 18).capitalize() + rng.choice(".....!?")
    prose = lambda: " ".join(sentence() for _ in range(rng.choice((1, 1, 2, 3, 5, 9))))
    pick = rng.choice
    cls = lambda *names: pick(("class", "class", "id")) + f'="{pick(names)}"'
    article: list[str] = []

    def main(tag: str, text: str) -> str:
        article.append(" ".join(text.split()))
        return pick((f"<{tag}>{text}</{tag}>", f"<{tag}>{text}</{tag}>", f"<{tag}>{text}" if tag == "p" else f"<{tag}>{text}</{tag}>"))

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(n)) + "</ul>"

    def nav() -> str:
        body = links(rng.randint(3, 8))
        return pick((f"<nav>{body}</nav>", f"<div {cls('menu', 'nav', 'main-menu', 'navbar', 'top-navigation')}>{body}</div>", f"<header><nav>{body}</nav></header>"))

    def header() -> str:
        inner = pick((f"<h1>{words(1, 3)}</h1>", f"<p>{words(1, 6)}</p>", f'<a href="/">{words(1, 2)}</a>', f"<div>{words(2, 8)}</div>"))
        return pick((f"<header>{inner}</header>", f"<div {cls('header', 'masthead', 'site-header', 'top-banner')}>{inner}</div>"))

    def aside() -> str:
        inner = pick((links(4), f"<p>{prose()}</p>", f"<h3>{words(1, 4)}</h3><p>{sentence()}</p>", f"<div>{sentence()}</div>"))
        return pick((f"<aside>{inner}</aside>", f"<div {cls('sidebar', 'widget', 'right-rail', 'secondary')}>{inner}</div>"))

    def advert() -> str:
        return pick((f"<div {cls('ad', 'ads', 'advert', 'ad-slot', 'sponsored', 'promo', 'banner-ad', 'advertisement')}>{pick((sentence(), f'<p>{prose()}</p>', words(2, 6)))}</div>",))

    def notice() -> str:
        return f"<div {cls('cookie', 'cookie-notice', 'consent', 'gdpr-banner', 'notice', 'alert', 'popup', 'modal')}>{pick((sentence(), f'<p>{prose()}</p>'))}{pick(('', '<button>OK</button>'))}</div>"

    def form() -> str:
        return pick((f"<form><label>{words(1, 2)}</label><input><button>{word()}</button></form>", f"<div {cls('newsletter', 'subscribe', 'login', 'search')}><p>{sentence()}</p><form><input><button>{word()}</button></form></div>", f"<form><p>{sentence()}</p><select><option>{word()}<option>{word()}</select></form>"))

    def comments() -> str:
        one = lambda: pick((f"<p>{prose()}</p>", f"<div class=\"comment-body\"><p>{prose()}</p></div>", f"<li><b>{word()}</b> <p>{prose()}</p></li>", f"<article class=\"comment\"><p>{prose()}</p></article>"))
        body = "".join(one() for _ in range(rng.randint(1, 5)))
        return pick((f"<section {cls('comments', 'comment-list', 'discussion', 'replies')}><h2>{words(1, 2)}</h2>{body}</section>", f"<div {cls('comments', 'comments-area', 'disqus_thread', 'responses comments')}>{body}</div>", f"<ol {cls('commentlist', 'comments')}>{body}</ol>"))

    def share() -> str:
        return pick((f"<div {cls('share', 'social', 'related', 'recommended', 'tags', 'more-stories related')}>{links(3)}</div>", f"<div {cls('related', 'related-posts')}><h3>{words(1, 3)}</h3>{links(3)}</div>"))

    def footer() -> str:
        inner = pick((f"&copy; {word()}.example &middot; {sentence()}", f"<p>&copy; 2020 {words(1, 3)}</p>{links(3)}", f"<p>{sentence()}</p>", links(4)))
        return pick((f"<footer>{inner}</footer>", f"<div {cls('footer', 'site-footer', 'page-footer', 'legal')}>{inner}</div>"))

    unknown = lambda: f'{pick(("class", "id"))}="{word()}{pick(("", f" {word()}", f"-{word()}"))}"'
    table = lambda first: f'<table><tr>{first}<td>{{}}</td></tr></table>'
    if holder is None and rng.random() < 0.34:
        cell = f"<td>{links(rng.randint(2, 7))}</td>" if rng.random() < 0.6 else ""
        holder = pick(("{}", "{}", "<div>{}</div>", f"<div {unknown()}>{{}}</div>", f"<div {unknown()}>{{}}</div>", f"<div {unknown()}><div {unknown()}>{{}}</div></div>", table(cell), table(cell), f"<table {unknown()}><tbody><tr>{cell}<td {unknown()}>{{}}</td></tr></tbody></table>"))
    prose_tag = pick(("p", "p", "p", "p", "div")) if holder else "p"
    body = [main("h1", words(2, 9))] if rng.random() < 0.8 else []
    for _ in range(pick((1, 2, 3, 5, 9, 14))):
        kind = rng.random()
        if kind < 0.72:
            body.append(main(prose_tag, prose()))
        elif kind < 0.78:
            body.append(main(pick(("h2", "h3")), words(1, 7)))
        elif kind < 0.82:
            body.append("<ul>" + "".join(main("li", words(2, 12)) for _ in range(3)) + "</ul>")
        elif kind < 0.85:
            body.append("<blockquote>" + main("p", prose()) + "</blockquote>")
        elif kind < 0.88:
            body.append(main("p", f'{words(2, 6)} <a href="/x">{words(1, 4)}</a> {sentence()}'))
            article[-1] = re.sub("<[^>]*>", "", article[-1])
        elif kind < 0.9:
            body.append(main("p", f"<b>{sentence()}<br>"))
            article[-1] = re.sub("<[^>]*>", "", article[-1])
        elif kind < 0.95:
            body.append(pick((advert, share, aside, form, notice))())
        else:
            body.append(main("pre", words(3, 9)))
    if rng.random() < 0.25:
        body.append(pick((comments, share, footer))())
    inside = "".join(body)
    holder = holder or pick(("<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", f"<div {cls('content', 'article', 'post', 'entry-content', 'story-body', 'main-content', 'post-body', 'article-text', 'main')}>{{}}</div>", f"<div {cls('wrapper', 'page', 'container')}><div {cls('content', 'article', 'main', 'post')}>{{}}</div></div>", f"<article {cls('post', 'hentry', 'story')}>{{}}</article>"))
    before = [f() for f in (notice, header, nav, nav, advert, form, aside) if rng.random() < 0.4]
    after = [f() for f in (comments, share, aside, advert, form, notice, footer, footer) if rng.random() < 0.4]
    page = "".join([*before, holder.replace("{}", inside), *after])
    return f"<!DOCTYPE html><html><head><title>{words(2, 5)}</title><script>var a='</p>';</script></head><body>{page}{pick(('</body></html>', ''))}", article


def labelled_pages(n: int, seed: int, holder: str | None = None) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels of n pages; a block is labelled as article if it is the article's next block."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        page, article = labelled_page(rng, holder)
        found = blocks(page)
        labels, at = [], 0
        for b in found:
            hit = at < len(article) and b.text == article[at]
            labels.append(int(hit))
            at += hit
        if at == len(article):
            out.append((found, labels))
    return out


@functools.lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, seed: int = 11) -> ChainCRF:
    return ChainCRF.fit([(features(b), y) for b, y in labelled_pages(pages, seed)])


def main_text(page: str, crf: ChainCRF) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, crf.decode(features(found))) if keep)


def extract(pages: DataFrame, crf: ChainCRF | None = None) -> DataFrame:
    """page_id, url, text for each row of pages."""
    crf = crf or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "html"):
            texts = [main_text(h, crf) if h else "" for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string")
