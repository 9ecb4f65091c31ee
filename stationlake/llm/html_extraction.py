"""Main-text extraction by a linear-chain conditional random field over a page's leaf blocks.

A page is a sequence of leaf blocks: runs of text between block tags. Features are the block's ancestors (tags, and
what their class, id and role names say), its length, links and punctuation. The field is trained on labelled pages of
many layouts, and Viterbi decoding picks the best joint labelling of each page; its content blocks are the text.
"""

from __future__ import annotations

import functools
import html
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

#: Fixed values of HTML: elements that break lines, have no end tag, or hold no text.
BLOCKS = frozenset("html head body title article main section aside nav header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption blockquote pre form fieldset legend button label select option address details summary hr center menu dialog iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style".split())  # end at their end tag or with the page
SILENT = RAW | frozenset("noscript template svg textarea object canvas audio video".split())  # without an end tag only the tag is left out
BROKEN = 8  # tags of a page whose quotes may be looked for in vain, before quotes are no longer looked at
CLOSES_P = BLOCKS - {"html", "head", "body", "button", "label", "option"}

TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>")  # where quotes don't close
NAMED = re.compile(r"</?[A-Za-z]")
ATTRIBUTE = re.compile(r"""(class|id|role|data-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HINTS = {
    "menu": "nav|menu|breadcrumb|pagination|pager|toc", "head": "header|masthead|topbar|logo|branding", "foot": "footer|copyright|legal|colophon",
    "side": "side|aside|widget|rail|complementary", "advert": r"\bads?\b|advert|sponsor|promo|banner-ad|outbrain|taboola", "notice": "cookie|consent|gdpr|notice|alert|popup|modal|banner|overlay|paywall",
    "comment": "comment|disqus|reply|replies|respond|discussion|reactions", "form": "form|newsletter|subscribe|signup|login|search|contact", "related": "related|recommend|share|social|tags|more-|trending|popular|read-next",
    "content": "content|article|post|entry|story|main|text|prose", "byline": "byline|author|meta|date|dateline",
}
HINT = {k: re.compile(v, re.I) for k, v in HINTS.items()}


@functools.lru_cache(maxsize=20_000)
def hints_of(tag: str, attributes: str) -> tuple[tuple[str, ...], str]:
    """What a tag says of the blocks below it, and the training label that it carries, if any."""
    names, label = [], ""
    for m in ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "data-label":
            label = value
        else:
            names.append(value)
    found = [f"in:{tag}"]
    if names:
        joined = " ".join(names)
        found += [f"hint:{k}" for k, pattern in HINT.items() if pattern.search(joined)]
    return tuple(found), label


class Markup:
    """The tags of a page, one after the other, in time linear in its length."""

    def __init__(self, page: str):
        self.page, self.broken, self.endless = page, 0, set()

    def next(self, at: int):
        """(where it begins, where it ends, match or None) of the next tag, comment or declaration; None if there is none."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at) or page.startswith("<![CDATA[", at):
                close = "-->" if page[at + 2] == "-" else "]]>"
                end = page.find(close, at + 4)
                return at, len(page) if end < 0 else end + len(close), None
            if page[at + 1 : at + 2] in ("!", "?") and page[at + 1 : at + 2]:
                end = page.find(">", at)
                return (at, end + 1, None) if end >= 0 else None
            if NAMED.match(page, at):
                m = TAG.match(page, at) if self.broken < BROKEN else None
                if m is None:
                    self.broken += 1
                    m = PLAIN_TAG.match(page, at)
                if m:
                    return at, m.end(), m
                if page.find(">", at) < 0:
                    return None
            at += 1
        return None

    def behind(self, tag: str, at: int) -> int:
        """Where the page goes on behind the end tag, or behind the start tag of an element that is never closed."""
        end = None if tag in self.endless else re.compile(rf"</{tag}(?=[\s/>])", re.I).search(self.page, at)
        if end is None and tag not in RAW:
            self.endless.add(tag)
            return at
        close = self.page.find(">", end.end()) if end else -1
        return close + 1 if close >= 0 else len(self.page)


#: An open element: its tag, the hints of it and those around it, and whether one of them carries a training label.
ROOT = ("", frozenset(), False)


def leaf_blocks(page: str) -> list[tuple[str, tuple[str, frozenset, bool], int]]:
    """(text, innermost open block element, characters in links) of every leaf block that has text."""
    out, stack, opened, pieces, linked, in_link = [], [ROOT], {}, [], 0, 0
    at, markup = 0, Markup(page)

    def close():
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            out.append((text, stack[-1], linked))
        pieces.clear()
        linked = 0

    def pop():
        opened[stack[-1][0]] -= 1
        return stack.pop()[0]

    while found := markup.next(at):
        begin, end, m = found
        if begin > at:
            pieces.append(page[at:begin])
            linked += (begin - at) if in_link else 0
        at = end
        if not m:
            continue
        tag = m[2].lower()
        if tag in SILENT:  # goes on behind its end tag, whatever stands in it
            if not m[1] and not m[3].endswith("/"):
                at = markup.behind(tag, at)
            continue
        if tag == "a":
            in_link = 0 if m[1] else 1
        if tag == "br":
            pieces.append(" ")
        if tag not in BLOCKS:
            continue
        close()
        in_link = in_link if tag in ("li", "div") else 0
        if m[1]:
            if opened.get(tag):
                while pop() != tag:
                    pass
            continue
        if tag in CLOSES_P and stack[-1][0] == "p":
            pop()
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == tag:
            pop()
        if tag not in VOID:
            hints, label = hints_of(tag, m[3])
            _, around, marked = stack[-1]
            stack.append((tag, around if around.issuperset(hints) else around.union(hints), marked or bool(label)))
            opened[tag] = opened.get(tag, 0) + 1
    if at < len(page):
        pieces.append(page[at:])
    close()
    return out


def features(text: str, element: tuple[str, frozenset, bool], linked: int, place: int, count: int) -> list[str]:
    n, words = len(text), text.count(" ") + 1
    found = set(element[1])
    found.add(f"own:{element[0] or 'none'}")
    found.add(f"length:{min(6, n.bit_length() - 3 if n > 8 else 0)}")
    found.add(f"words:{min(5, words.bit_length())}")
    share = linked / max(1, n)
    found.add("links:" + ("none" if not linked else "some" if share < 0.4 else "most"))
    found.add("ends:" + ("sentence" if text[-1] in ".!?…\"”»" else "open"))
    if "©" in text or "copyright" in text.lower():
        found.add("says:copyright")
    found.add("where:" + ("first" if place == 0 else "last" if place == count - 1 else "inner"))
    return sorted(found)


class Field:
    """A linear-chain conditional random field with labels 0 (aside) and 1 (content)."""

    def __init__(self, names: list[str], emit: np.ndarray, move: np.ndarray):
        self.place = {f: i for i, f in enumerate(names)}
        self.names, self.emit, self.move = names, emit, move

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        place = self.place
        return np.array([self.emit[[place[f] for f in row if f in place]].sum(axis=0) for row in rows]).reshape(-1, 2)

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The best labelling (Viterbi)."""
        if not rows:
            return []
        scores = self.scores(rows).tolist()
        (a, b), (c, d) = self.move.tolist()
        zero, one = scores[0]
        back = []
        for s0, s1 in scores[1:]:
            from0, from1 = one + c > zero + a, one + d > zero + b
            back.append((from0, from1))
            zero, one = max(zero + a, one + c) + s0, max(zero + b, one + d) + s1
        label = int(one > zero)
        out = [label]
        for pair in reversed(back):
            label = int(pair[label])
            out.append(label)
        return out[::-1]

    def gradient(self, rows: list[np.ndarray], labels: np.ndarray):
        """Log likelihood's gradient of one page, by forward-backward."""
        s = np.array([self.emit[r].sum(axis=0) for r in rows])
        n = len(rows)
        fore, aft = np.zeros((n, 2)), np.zeros((n, 2))
        fore[0] = s[0]
        for i in range(1, n):
            fore[i] = s[i] + np.logaddexp(fore[i - 1, 0] + self.move[0], fore[i - 1, 1] + self.move[1])
        for i in range(n - 2, -1, -1):
            aft[i] = np.logaddexp(self.move[:, 0] + s[i + 1, 0] + aft[i + 1, 0], self.move[:, 1] + s[i + 1, 1] + aft[i + 1, 1])
        total = np.logaddexp(*fore[-1])
        one = np.exp(fore + aft - total)
        emit, move = np.zeros_like(self.emit), np.zeros((2, 2))
        for i, r in enumerate(rows):
            emit[r] -= one[i]
            emit[r, labels[i]] += 1
        for i in range(n - 1):
            both = fore[i][:, None] + self.move + s[i + 1] + aft[i + 1] - total
            move -= np.exp(both)
            move[labels[i], labels[i + 1]] += 1
        return emit, move


def training_pages(count: int = 150, seed: int = 11) -> list[str]:
    """Labelled pages of many layouts: content carries data-label=1, all else is aside."""
    rng = random.Random(seed)
    pick = rng.choice

    def words(a, b):
        return " ".join("".join(pick("abdefghiklmnoprstuvwéäñ") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(a, b)))

    def text(a, b):
        return words(a, b).capitalize() + pick(["."] * 5 + ["", "!", "%%%", "?"])

    def links(n):
        return "".join(f'<li><a href="/{i}">{words(1, 4)}</a></li>' for i in range(n))

    def keep(tag, a, b):
        inner = text(a, b)
        if rng.random() < 0.2:
            inner = f"<b>{inner}</b> {text(3, 20)}"
        if rng.random() < 0.15:
            inner += f' <a href="x">{words(1, 4)}</a> {text(2, 20)}'
        return f"<{tag} data-label=1>{inner}</{tag}>"

    def body():
        out = [keep(pick(["h1", "h1", "h2"]), 2, 12)] if rng.random() < 0.9 else []
        for _ in range(rng.randrange(1, 9)):
            r = rng.random()
            if r < 0.72:
                out.append(keep("p", *pick([(1, 4), (5, 30), (20, 90)])))
            elif r < 0.8:
                out.append(keep(pick(["h2", "h3"]), 1, 8))
            elif r < 0.9:
                out.append("<ul>" + "".join(keep("li", 2, 15) for _ in range(rng.randrange(1, 5))) + "</ul>")
            elif r < 0.95:
                out.append(f"<blockquote>{keep('p', 5, 30)}</blockquote>")
            else:
                out.append("<table><tr>" + keep("td", 1, 5) + keep("td", 1, 5) + "</tr></table>")
        return out

    def aside():
        return pick([
            lambda: f"<nav><ul>{links(rng.randrange(2, 8))}</ul></nav>",
            lambda: f'<div class="{pick(["menu", "navbar", "breadcrumbs"])}"><ul>{links(rng.randrange(2, 6))}</ul></div>',
            lambda: f"<aside><h3>{words(1, 4)}</h3><p>{text(3, 30)}</p><ul>{links(3)}</ul></aside>",
            lambda: f'<div class="{pick(["sidebar", "widget", "side-col"])}"><h3>{words(1, 3)}</h3><p>{text(3, 30)}</p></div>',
            lambda: f'<div class="{pick(["ad", "ads", "advert", "sponsored", "promo"])}">{text(3, 25)}</div>',
            lambda: f'<div class="{pick(["cookie-notice", "consent", "notice", "alert banner"])}"><p>{text(5, 25)}</p><button>{words(1, 3)}</button></div>',
            lambda: f'<form action="/s"><label>{words(1, 3)}</label><input name=q><p>{text(3, 15)}</p><button>{words(1, 2)}</button></form>',
            lambda: f'<div class="newsletter"><h3>{words(1, 4)}</h3><p>{text(3, 20)}</p></div>',
            lambda: f'<div class="{pick(["related", "share-bar", "recommended", "tags"])}"><h3>{words(1, 3)}</h3><ul>{links(3)}</ul></div>',
            comments,
        ])()

    def comments():
        each = "".join(f'<div class="comment"><p>{words(1, 2)}</p><p>{text(3, 40)}</p></div>' for _ in range(rng.randrange(1, 5)))
        return pick([f'<section class="comments"><h2>{words(1, 3)}</h2>{each}</section>', f'<div id="{pick(["comments", "disqus_thread", "respond"])}"><h3>{words(1, 3)}</h3>{each}</div>', f'<ol class="comment-list">{each}</ol>'])

    pages = []
    for _ in range(count):
        core = body()
        for _ in range(rng.randrange(0, 3)):  # what stands in the middle of an article without being part of it
            core.insert(rng.randrange(len(core) + 1), aside())
        opened = pick(["<article>", "<main>", "<main><article>", '<div id="content">', '<div class="post-body">', '<section class="story">', "<div>", "<article>", '<div class="entry-content">'])
        tags = re.findall(r"<(\w+)", opened)
        centre = opened + "".join(core) + "".join(f"</{t}>" for t in reversed(tags))
        head = f"<html><head><title>{text(2, 10)}</title></head><body>"
        before = [pick([f"<header><h1>{words(1, 4)}</h1><p>{words(2, 8)}</p></header>", f'<div id="header"><p>{words(1, 5)}</p></div>', ""]), *(aside() for _ in range(rng.randrange(0, 3)))]
        after = [*(aside() for _ in range(rng.randrange(0, 3))), pick([f"<footer>© {words(2, 12)}.</footer>", f"<footer><p>{text(3, 15)}</p><ul>{links(3)}</ul></footer>", f'<div class="footer">&copy; {text(2, 12)}</div>'])]
        pages.append(head + "".join(before) + centre + "".join(after) + "</body></html>")
    return pages


@functools.lru_cache(maxsize=2)
def trained(count: int = 150, steps: int = 60) -> Field:
    """The field, trained on the labelled pages by Adam on the whole batch; the same at each run."""
    data = []
    for page in training_pages(count):
        blocks = leaf_blocks(page)
        rows = [features(t, s, k, i, len(blocks)) for i, (t, s, k) in enumerate(blocks)]
        data.append((rows, np.array([int(s[2]) for _, s, _ in blocks])))
    names = sorted({f for rows, _ in data for row in rows for f in row})
    place = {f: i for i, f in enumerate(names)}
    data = [([np.array([place[f] for f in row]) for row in rows], labels) for rows, labels in data]
    field = Field(names, np.zeros((len(names), 2)), np.zeros((2, 2)))
    moments = [np.zeros_like(x) for x in (field.emit, field.emit, field.move, field.move)]
    for step in range(1, steps + 1):
        grads = [field.gradient(rows, labels) for rows, labels in data]
        for k, (value, grad) in enumerate(((field.emit, sum(g[0] for g in grads)), (field.move, sum(g[1] for g in grads)))):
            grad = grad / len(data) - 1e-3 * value
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * grad
            moments[2 * k + 1] = 0.99 * moments[2 * k + 1] + 0.01 * grad * grad
            value += 0.2 * moments[2 * k] / (1 - 0.9**step) / (np.sqrt(moments[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    return field


def main_text(page: str | None, field: Field) -> str:
    blocks = leaf_blocks(page or "")
    rows = [features(t, s, k, i, len(blocks)) for i, (t, s, k) in enumerate(blocks)]
    return "\n".join(t for (t, *_), label in zip(blocks, field.decode(rows)) if label)


def extract_pages(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html; other columns are ignored).

    A map without shuffle. Null and empty pages and pages without content have the empty text; rows are kept one to one.
    """
    field = field or trained()
    model = pages.sparkSession.sparkContext.broadcast((field.names, field.emit, field.move))  # some hundred features

    def run(batches):
        import pyarrow as pa

        own = Field(*model.value)
        for whole in batches:
            for batch in slices(whole, "html"):
                texts = [main_text(h, own) for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    chosen = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
