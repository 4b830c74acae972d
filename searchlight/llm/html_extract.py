"""Main text of web pages by tag-path ratios.

A page becomes a sequence of blocks, each with its tag path from the root. For each tag path, text length
and punctuation are added up and divided by the number of its blocks; the two ratios are smoothed over
neighbouring blocks and multiplied. Blocks above the threshold (a share of their standard deviation) vote for
their paths, and chosen paths are fused: the innermost element that holds nearly all of their text is the
article, and the blocks in it count, short ones and links as well.

Names only weigh. An element whose class or id names boilerplate makes a path of its own, whose ratio is
multiplied by a weight, unless the element holds an article or (but for readers' comments) the larger part of the
page's plain text. So inside the article a part stays out only if all of its name is boilerplate and its path does not reach the
threshold; one that has such a word among others stays in. A button's text counts within a sentence, and not by itself. What HTML itself calls
no content (menus, footers, forms, scripts and so on, or what is hidden) has weight zero.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>
    |<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>
    |</?[a-zA-Z][^>]*\Z""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
PUNCTUATION = re.compile(r"[.,;:!?。，！？、…]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg object select".split())
#: Elements that are never part of the text.
OUT = RAW | frozenset("head nav footer aside form menu dialog audio video canvas map datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr data output button math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder semantics annotation".split())
#: An element of the key closes open elements of the value, up to the next container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("html body div article section main table ul ol dl blockquote figure details header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of a class or id that name boilerplate.
NAMES = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner sidebar
    sidebars aside comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices
    popup modal overlay newsletter subscribe subscription signup nav navbar navigation menu menus breadcrumb breadcrumbs
    masthead footer pagination pager share sharing social related recommended recommendations widget widgets toolbar login
    searchbox alert alerts topbar topmenu""".split()
)
#: Words that stand beside a name without making it another thing.
BESIDE = frozenset("list box bar area section block wrap wrapper container inner outer main top bottom left right page site header footer content item items body thread form text link links post posts id slot unit button buttons icons sticky".split())
#: Names of what readers wrote, which can be longer than the article.
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: What a path's ratio is multiplied by: left out by HTML, readers' comments, a class or id that is a name, one that has a name among other words.
WEIGHTS = {"-": 0.0, "~": 0.05, "!": 0.05, "?": 0.3}
#: Share of the standard deviation from which on a block's fused ratio counts, and of the chosen text that the article must hold.
THRESHOLD, HOLD = 0.5, 0.9


def mark(tag: str, attrs: str, inside: bool) -> str:
    """The mark of an element, a key of WEIGHTS or empty. inside: it stands within an article or main element."""
    if tag in OUT or tag == "header" and not inside:
        return "-"
    if not attrs or tag in ("html", "body", "article", "main"):
        return ""
    found = ""
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "role" and value.strip().lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return "-"
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return "-"
        if name in ("class", "id"):
            for token in value.split():
                words = [w.lower() for w in WORDS.findall(token)]
                if any(w in NAMES for w in words):
                    plain = all(w in NAMES or w in BESIDE or w.isdigit() for w in words)
                    kind = "?" if not plain else "~" if READERS.intersection(words) else "!"
                    found = min(found or kind, kind, key=list(WEIGHTS).index)
    return found


def parse(page: str) -> tuple[list[str], list[int], list[tuple[int, str, int]], set[int]]:
    """Labels (tag and mark) and parents of the elements, (element, text, characters in links) of each block in page order, and the elements that hold an article or main.

    Elements are numbered in page order, so parents come first; number 0 is the page. Inline elements without a mark are no
    parents and hold no blocks. Markup may be broken or cut off: ends without a beginning are passed over, and elements that
    stay open end with what holds them.
    """
    out: list[tuple[int, str, int]] = []
    labels, parents = [""], [0]
    stack: list[tuple[str, int, int]] = []  # tag, number, innermost element of the path
    links = articles = buttons = 0
    parts: list[tuple[str, bool, bool]] = []  # text, in a link, in a button
    around: set[int] = set()

    def flush():
        if parts:
            text = " ".join("".join(p for p, _, _ in parts).split())
            if text and any(p.strip() for p, _, button in parts if not button):
                out.append((stack[-1][2] if stack else 0, text, sum(len(" ".join(p.split())) for p, linked, _ in parts if linked)))
            parts.clear()

    def pop(to: int):
        nonlocal links, articles, buttons
        for tag, _, _ in stack[to:]:
            links -= tag == "a"
            buttons -= tag == "button"
            articles -= tag in ("article", "main")
        del stack[to:]

    at, size = 0, len(page)
    while at < size:
        token = TOKEN.search(page, at)
        begin = token.start() if token else size
        if begin > at:
            parts.append((html.unescape(page[at:begin]), links > 0, buttons > 0))
        if not token:
            break
        at = token.end()
        if token[0].startswith("<![CDATA["):
            parts.append((token[0][9:].removesuffix("]]>"), links > 0, buttons > 0))
        tag = (token["name"] or token["name2"] or "").lower()
        if not tag:
            continue
        attrs = token["attrs"] or token["attrs2"] or ""
        block = tag not in INLINE and tag != "br"
        if tag == "br":
            parts.append((" ", False, False))
            continue
        if token["end"] or token["end2"]:
            open_ = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if open_ < 0 or not block and any(t in CONTAINERS for t, _, _ in stack[open_ + 1 :]):
                continue
            if block:
                flush()
            pop(open_)
            continue
        if tag in RAW and not attrs.endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if block:
                flush()
            at = close.end() if close else size
            continue
        if block:
            flush()
            for closed in ({"p"}, CLOSES.get(tag, ())):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in closed:
                        pop(i)
                        break
                    if stack[i][0] in CONTAINERS and stack[i][0] not in closed:
                        break
        if tag in VOID or attrs.endswith("/"):
            continue
        number = len(labels)
        label = tag + mark(tag, attrs, articles > 0)
        if label != tag and not block:  # a marked span is a block of its own
            flush()
        labels.append(label)
        parents.append(stack[-1][2] if stack else 0)
        stack.append((tag, number, number if block or label != tag else parents[-1]))
        links += tag == "a"
        buttons += tag == "button"
        if tag in ("article", "main"):
            articles += 1
            for i in range(len(stack) - 2, -1, -1):
                if stack[i][1] in around:  # and so what holds it
                    break
                around.add(stack[i][1])
    flush()
    return labels, parents, out, around


def blocks_of(page: str) -> tuple[list[tuple[tuple, str, int]], set[int]]:
    """The blocks of a page with whole paths, whose elements are (tag and mark, number), and the elements that hold an article or main."""
    labels, parents, blocks, around = parse(page)

    def path(node: int) -> tuple:
        up = []
        while node:
            up.append((labels[node], node))
            node = parents[node]
        return tuple(reversed(up))

    return [(path(node), text, linked) for node, text, linked in blocks], around


def path_ratios(blocks: list[tuple], paths: list) -> np.ndarray:
    """Per block its tag path's plain characters and punctuation marks a block, smoothed over neighbours and fused."""
    sums = defaultdict(lambda: np.zeros(3))
    for path, (_, text, linked) in zip(paths, blocks):
        sums[path] += (len(text) - linked, len(PUNCTUATION.findall(text)), 1)
    ratios = np.array([sums[path][:2] / sums[path][2] for path in paths])
    if len(blocks) >= 3:
        padded = np.pad(ratios, ((1, 1), (0, 0)), mode="edge")
        ratios = 0.25 * padded[:-2] + 0.5 * padded[1:-1] + 0.25 * padded[2:]
    return ratios[:, 0] * (1 + ratios[:, 1])


def sums_below(parents: list[int], sizes) -> list[int]:
    """Per element the sum of the (element, size) in it and in all elements below it."""
    out = [0] * len(parents)
    for node, size in sizes:
        out[node] += size
    for i in range(len(parents) - 1, 0, -1):
        out[parents[i]] += out[i]
    return out


def main_text(page: str | None) -> str:
    """The text of the article; empty if there is none."""
    if not page:
        return ""
    labels, parents, blocks, around = parse(page)
    most = sum(len(text) - linked for _, text, linked in blocks) / 2
    plain = sums_below(parents, ((node, len(text) - linked) for node, text, linked in blocks))
    for i, label in enumerate(labels):
        # Without its mark if the element holds an article, or by its name alone is boilerplate but holds most of the page.
        if label and label[-1] in WEIGHTS and (i in around or label[-1] in "!?" and plain[i] > most):
            labels[i] = label[:-1]
    weight = [1.0] * len(labels)
    for i in range(1, len(labels)):
        weight[i] = weight[parents[i]] * WEIGHTS.get(labels[i][-1], 1.0)
    if any(weight[node] for node, _, _ in blocks):
        blocks = [b for b in blocks if weight[b[0]]]
    else:
        labels, weight = [label.rstrip("-~!?") for label in labels], [1.0] * len(labels)
    if not blocks:
        return ""
    # A path is a number: equal labels below equal paths are the same path.
    numbers: dict[tuple[int, str], int] = {}
    path_of, depth = [0] * len(labels), [-1] * len(labels)
    for i in range(1, len(labels)):
        path_of[i] = numbers.setdefault((path_of[parents[i]], labels[i]), len(numbers) + 1)
        depth[i] = depth[parents[i]] + 1
    paths = [path_of[node] for node, _, _ in blocks]
    fused = path_ratios(blocks, paths) * np.array([weight[node] for node, _, _ in blocks])
    chosen = fused >= THRESHOLD * fused.std()
    votes = defaultdict(list)
    for path, yes in zip(paths, chosen):
        votes[path].append(yes)
    good = {path for path, own in votes.items() if 2 * sum(own) >= len(own)}
    # Navigation that does not name itself finds no article.
    telling = [(node, len(text)) for path, (node, text, linked) in zip(paths, blocks) if path in good and linked <= 0.7 * len(text)]
    held, total = sums_below(parents, telling), sum(size for _, size in telling)
    around_all = [i for i in range(1, len(labels)) if held[i] and held[i] >= HOLD * total and labels[i].rstrip("~!?") in CONTAINERS]
    articles = [i for i in around_all if labels[i] in ("article", "main")]
    article = max(articles or around_all, key=lambda i: (depth[i], labels[i], i), default=0)
    narrow = labels[article] in ("", "html", "body")
    inside, named = [article == 0] * len(labels), [False] * len(labels)
    for i in range(1, len(labels)):
        inside[i] = i == article or inside[parents[i]]
        named[i] = i != article and inside[i] and (named[parents[i]] or labels[i][-1] in WEIGHTS and labels[i][-1] != "?")

    def belongs(path: int, node: int, text: str, linked: int) -> bool:
        if not inside[node] or named[node] and path not in good:
            return False
        return not narrow or (path in good or labels[node] in HEADINGS) and linked <= 0.7 * len(text)

    return " ".join(text for path, (node, text, linked) in zip(paths, blocks) if belongs(path, node, text, linked))


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars. A null or empty page, or one without an article, has an empty text; equal rows count apart."""

    def run(batches):
        for batch in batches:
            text = [main_text(value.as_py()) for value in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
