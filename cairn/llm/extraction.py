"""Main text of web pages by scoring the element tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul caption".split()
)
#: Elements whose text passes points upwards when it stands directly in them.
PARAGRAPH = frozenset("p pre td blockquote div section article main li dd h2 h3 h4 figcaption body".split())
DROPPED = frozenset(
    "script style noscript template button select option textarea iframe object svg canvas title head audio video input "
    "label datalist".split()
)
#: Dropped too, unless the page's only article stands inside.
ASIDE = frozenset("nav footer aside dialog menu search".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split()
)
#: Words of class and id values that mark furniture, comments and adverts.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist "
    "consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice "
    "overlay pagination paywall popup promo promotion recommended related remark replies respond rss share sharing "
    "sidebar signin signup social sponsor sponsored subscribe subscription tags teaser toolbar widget".split()
)
#: Of these, words that mark a class whatever follows them in it.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies disqus gdpr masthead modal nav navbar newsletter pagination paywall popup promo promotion respond sidebar "
    "sponsor sponsored subscribe subscription toolbar".split()
)
#: Words that say nothing of their own beside those of furniture.
NEUTRAL = frozenset(
    "area articles bar block body bottom box btn button buttons card container content entries form group holder icon "
    "icons inner item items left link links list main module outer page panel posts region right row section site slot "
    "stories text top unit wrap wrapper zone".split()
)
#: Words that make a class of "header" the head of a text.
TEXTUAL = frozenset("article content entry post story".split())
SAFE = frozenset("html body article main".split())
#: What an element is by its tag and attributes, and what marks of furniture leave of the points inside it.
PLAIN, MARKED, BESIDE, NO_TEXT, HINTED, LOWERED = 0, 1, 2, 3, 4, 0.25
#: An article outside is one with so many characters, or a fifth of the text of the element in question.
ARTICLE_CHARS = 140
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag that ends an open element of these names (up to a closer container).
ENDS = {
    **{t: ("p",) for t in BLOCK if t not in ("body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption")},
    "li": ("p", "li"),
    "dt": ("p", "dt", "dd"),
    "dd": ("p", "dt", "dd"),
    "td": ("p", "td", "th"),
    "th": ("p", "td", "th"),
    "tr": ("p", "td", "th", "tr"),
    "option": ("option",),
}
FENCE = frozenset("table ul ol dl div section article aside main nav header footer form blockquote body html".split())

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|(?P<open>\Z|[\"']))",
    re.S,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class _Tree:
    """Elements in page order (a parent before its children), their texts, and what they are."""

    def __init__(self, page: str):
        self.tag, self.parent, self.kind, self.classes = ["html"], [-1], [PLAIN], [frozenset()]
        self.events: list[tuple[int, str | None]] = []  # (element, text) or (element, None) at its start and end
        self._read(page)

    def _read(self, page: str) -> None:
        stack, open_tags = [0], {"html": 1}
        at, end = 0, len(page)

        def close(to: int) -> None:
            while len(stack) > to:
                gone = stack.pop()
                open_tags[self.tag[gone]] -= 1
                self.events.append((gone, None))

        def text(a: int, b: int) -> None:
            if a < b:
                self.events.append((stack[-1], page[a:b]))

        for m in iter(lambda: _TAG.search(page, at), None):
            text(at, m.start())
            at = m.end()
            if name := m["end"]:
                name = name.lower()
                if name not in ("html", "body") and open_tags.get(name):
                    k = len(stack) - 1
                    while self.tag[stack[k]] != name:
                        k -= 1
                    close(k)
            elif name := m["tag"]:
                if m["open"] is not None:
                    at = end  # the tag never ends: nothing after it is text
                    break
                name = name.lower()
                if name in VOID:
                    self.events.append((stack[-1], " " if name in ("br", "wbr", "hr") else ""))
                    continue
                if name in ("html", "body") and open_tags.get(name):
                    continue
                for ended in ENDS.get(name, ()):
                    if open_tags.get(ended):
                        k = len(stack) - 1
                        while k and self.tag[stack[k]] != ended and self.tag[stack[k]] not in FENCE:
                            k -= 1
                        if self.tag[stack[k]] == ended:
                            close(k)
                node = len(self.tag)
                self.tag.append(name)
                self.parent.append(stack[-1])
                inside = bool(open_tags.get("article") or open_tags.get("main"))
                self.kind.append(_kind(name, m["attrs"], inside))
                self.classes.append(_classes(m["attrs"]))
                if name in RAW:
                    found = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                    at = found.start() if found else end
                    if found:
                        at = page.find(">", found.end()) + 1 or end
                    continue
                if m["attrs"].endswith("/") and name in ("svg", "path", "use"):
                    continue
                stack.append(node)
                open_tags[name] = open_tags.get(name, 0) + 1
                self.events.append((node, None))
        text(at, end)
        close(0)


def _kind(name: str, attrs: str, inside: bool) -> int:
    if name in DROPPED:
        return NO_TEXT
    if name in ASIDE or (name == "header" and not inside):
        return BESIDE
    kind = MARKED if name in ("form", "fieldset") else PLAIN
    if name in SAFE or not attrs:
        return kind
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return BESIDE
        if key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return BESIDE
        if key == "role" and value.lower() in ROLES:
            return BESIDE
        if key == "class" or (key == "id" and name not in HEADINGS):
            # ids of sections, and of anything in an article, are often slugs of headings
            slug = key == "id" and (inside or name == "section")
            for found in (_marks(x, inside, slug) for x in value.split()):
                kind = found if kind == PLAIN or found == MARKED else kind
    return kind


def _marks(value: str, inside: bool, slug: bool) -> int:
    """What a class or id says: furniture, something that has a word of it in its name, or nothing."""
    words = _WORD.findall(_CAMEL.sub(" ", value).lower())
    found = FURNITURE.intersection(words)
    if not found or (found == {"header"} and (inside or TEXTUAL.intersection(words))):
        return PLAIN
    if all(w in FURNITURE or w in NEUTRAL for w in words) or (words[0] in STRONG and not slug):
        return MARKED
    return HINTED


def _classes(attrs: str) -> frozenset[str]:
    if "class" not in attrs.lower():
        return frozenset()
    return frozenset(x for m in _ATTR.finditer(attrs) if m[1].lower() == "class" for x in (m[2] or m[3] or m[4] or "").split())


def _left_out(tree: _Tree, low: list[int], high: list[int]) -> tuple[list[bool], list[float]]:
    """Whether each element is left out, and the share of points that counts in it.

    low, high: characters outside and inside links that stand directly in each element.  An element with
    a word of furniture in a longer name goes only if most of its text is in links.  Marked elements stay when they
    hold an article, or most of the text while no article stands outside; when all that would go
    hold most of the text together, none goes.
    """
    tag, parent, kind, n = tree.tag, tree.parent, tree.kind, len(tree.tag)
    article = [False] * n
    for i in range(n):
        article[i] = tag[i] in ("article", "main") or (i > 0 and article[parent[i]])
    gone = [False] * n

    def sums() -> tuple[list[int], list[int], list[bool]]:
        text = [0 if gone[i] else low[i] for i in range(n)]
        stated = [x if article[i] else 0 for i, x in enumerate(text)]
        holds = [False] * n
        for i in range(n - 1, 0, -1):
            text[parent[i]] += text[i]
            stated[parent[i]] += stated[i]
            if holds[i] or (tag[i] in ("article", "main") and text[i]):
                holds[parent[i]] = True
        return text, stated, holds

    def outside(stated: int, text: int) -> bool:
        return stated > 0 and stated >= min(ARTICLE_CHARS, text / 5)

    plain, links = low[:], high[:]
    for i in range(n - 1, 0, -1):
        plain[parent[i]] += plain[i]
        links[parent[i]] += links[i]
    for i in range(1, n):
        gone[i] = gone[parent[i]] or kind[i] == NO_TEXT or (kind[i] == HINTED and links[i] > plain[i])
    text, stated, holds = sums()
    for i in range(1, n):
        beside = kind[i] == BESIDE and not (holds[i] and not outside(stated[0] - stated[i], text[i]))
        gone[i] = gone[i] or gone[parent[i]] or beside
    text, stated, holds = sums()
    most = text[0] / 2
    out, cut, cut_stated = gone[:], 0, 0
    for i in range(1, n):
        if out[parent[i]]:
            out[i] = True
        elif not out[i] and kind[i] == MARKED and not holds[i]:
            if text[i] <= most or outside(stated[0] - stated[i], text[i]):
                out[i] = True
                cut, cut_stated = cut + text[i], cut_stated + stated[i]
    if cut > most and not outside(stated[0] - cut_stated, cut):
        out = gone
    counts = [1.0] * n
    for i in range(1, n):
        if tag[i] != "main":
            counts[i] = counts[parent[i]] * (LOWERED if kind[i] in (MARKED, BESIDE, HINTED) else 1)
    return out, counts


def main_text(page: str | None) -> str:
    """The article of a page: its blocks, one to a line.

    Each paragraph's own text passes 1 point, 1 for each comma and 1 for each 100 characters to its
    parent, half of it to the next ancestor and a third to the one above, less inside elements marked as
    furniture; a container's points are then lowered by the share of its text that stands in links.  The
    best container is kept together with siblings that have a fifth of its points or are long paragraphs
    with few links, and with short paragraphs and headings with few links next to or between kept ones.
    Of equal containers the first in the page wins.  A null or empty page, or one without text, gives "".
    """
    if not page:
        return ""
    tree = _Tree(page)
    tag, parent, n = tree.tag, tree.parent, len(tree.tag)
    own = [0] * n  # length of text directly in the element or its inline children
    commas, linked, length = [0] * n, [0] * n, [0] * n
    block, link = list(range(n)), [False] * n
    for i in range(1, n):
        if tag[i] not in BLOCK:
            block[i] = block[parent[i]]
        link[i] = tag[i] == "a" or link[parent[i]]
    low, high, heads = [0] * n, [0] * n, [0] * n
    for i, t in tree.events:
        if t:
            (high if link[i] else low)[i] += len(t.strip())
    skip, counts = _left_out(tree, low, high)
    for i, t in tree.events:
        if t and not skip[i] and (size := len(t.strip())):
            own[block[i]] += size
            commas[block[i]] += t.count(",")
            length[block[i]] += size
            if link[i]:
                linked[block[i]] += size
    points = [0.0] * n
    for i in range(n):
        if own[i] and tag[i] in PARAGRAPH:
            if link[i] or linked[i] > own[i] / 2:
                continue
            gain, up = counts[i] * (1 + commas[i] + own[i] / 100), i if tag[i] in ("div", "section", "article", "main", "body") else parent[i]
            for share in (1, 2, 3):
                if up < 0:
                    break
                points[up] += gain / share
                up = parent[up]
    for i in range(n - 1, 0, -1):
        heads[i] += length[i] * (tag[i] in HEADINGS)
        heads[parent[i]] += heads[i]
        length[parent[i]] += length[i]
        linked[parent[i]] += linked[i]
    for i in range(n):
        if points[i]:
            points[i] += 5 * counts[i] * (tag[i] in ("article", "main"))
            points[i] *= 1 - linked[i] / max(1, length[i])
    best = max((i for i in range(n) if tag[i] in BLOCK and not skip[i]), key=lambda i: (points[i], -i), default=0)
    if not points[best]:
        best = 0
    kept = {best}
    few = [linked[i] < 0.25 * length[i] for i in range(n)]
    stated = best
    while stated and tag[stated] != "article":
        stated = parent[stated]
    if stated and few[stated] and not skip[stated]:
        best = stated  # the page says itself what its article is
        kept = {best}
    if best and tag[best] not in ("body", "html"):
        children: dict[int, list[int]] = {}
        for i in range(1, n):
            if not skip[i] and (length[i] or i == best):
                children.setdefault(parent[i], []).append(i)
        top = points[:]
        for i in range(n - 1, 0, -1):
            top[parent[i]] = max(top[parent[i]], top[i])
        row = children[parent[best]]
        kept |= {i for i in row if points[i] >= points[best] / 5 or (tag[i] == "p" and length[i] > 80 and few[i])}
        for way in (row, row[::-1]):
            for before, i in zip(way, way[1:]):
                head = way is not row and heads[i] == length[i]
                if before in kept and few[i] and (tag[i] == "p" or tag[i] in HEADINGS or head):
                    kept.add(i)
        # columns and rows: what looks like an ancestor of the best and holds as much, and the title above it
        at = best
        while tag[at] not in ("article", "main", "body") and parent[at] > 0 and tag[parent[at]] != "html":
            at = parent[at]
            if tag[at] in ("article", "main", "body"):
                break
            row = children[parent[at]]
            for before, i in zip([0, *row], row):
                alike = tag[i] == tag[at] and (tree.classes[i] & tree.classes[at] or tree.classes[i] == tree.classes[at])
                if i != at and alike and few[i] and top[i] >= points[best] / 5:
                    kept.add(i)
                if i == at and before and heads[before] == length[before] and few[before] and tag[parent[at]] != "body":
                    kept.add(before)
    inside = [False] * n
    for i in range(n):
        inside[i] = not skip[i] and (i in kept or (i > 0 and inside[parent[i]]))
    lines, part = [], []
    for i, t in tree.events:
        if t is None:
            if tag[i] in BLOCK and part:
                lines.append(part)
                part = []
        elif inside[i]:
            part.append(t)
    lines.append(part)
    texts = (" ".join(unescape("".join(x)).split()) for x in lines)
    return "\n".join(x for x in texts if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page; repeated rows give repeated rows, null ids and urls stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(texts, pa.string()),
                        pa.array([len(x) for x in texts], pa.int64()),
                    ],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
