"""HTML extraction by consensus host paths.

Every page scores its containers; each container stands for its generalised path, the tags and
classes from the root with digits removed (``DEPTH`` steps; what is deeper counts for the element
there). In Spark the pages of a host vote, with the shares that they give their paths, and the
winning path is used to extract every page of the host. A page without text at that path falls
back on its own best container.

Inside a container, menus, adverts, forms and the like are left out. Names of layout parts only
raise a suspicion: an element with half the page's text is a wrapper and stays, if an article, main
part or title is in it or only a word of its class or id spoke against it; and on a page where nothing else is left they do not count.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import bounded, settle
from sextant.llm.url_filter import split_url

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][^\s=/>"']*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag.
_RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template".split())
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html legend li main menu nav ol optgroup option p pre search section summary table caption tbody td tfoot th thead tr ul".split()
)
#: Elements whose text belongs to the container around them.
_PART = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption address details summary br hr".split())
_ENDS_P = _BLOCK - frozenset("br body html head li dd dt td th tr tbody thead tfoot caption option optgroup legend summary".split())
#: A start tag closes an open element of these names, unless one of the second set lies between.
_CLOSES = {
    **dict.fromkeys(_ENDS_P, ({"p"}, frozenset("button table td th caption article aside section div main body".split()))),
    "li": ({"li"}, frozenset("ul ol menu table body".split())), "dt": ({"dt", "dd"}, frozenset(["dl", "body"])), "dd": ({"dt", "dd"}, frozenset(["dl", "body"])),
    "option": ({"option"}, frozenset(["select", "body"])), "tr": ({"tr"}, frozenset(["table", "body"])), "td": ({"td", "th"}, frozenset(["tr", "table", "body"])), "th": ({"td", "th"}, frozenset(["tr", "table", "body"])),
}
#: Never part of an article.
_OUT_TAGS = frozenset("head nav button select dialog menu object svg canvas audio video search".split()) | _RAW
#: Not part of an article unless they wrap it: by tag, by role, or by a word of class or id.
_SUSPECT_TAGS = frozenset("header footer aside form fieldset".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_COMMENT_WORDS = frozenset("comment comments disqus reply replies respond discussion".split())
_OUT_WORDS = _COMMENT_WORDS | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices notification"
    " popup modal overlay newsletter subscribe subscription share sharing social related recommend recommended recommendations sidebar aside menu nav navbar navigation"
    " breadcrumb breadcrumbs footer header masthead widget pagination pager toolbar login signup hidden".split()
)
#: A class or id that begins or ends so tells of a state of the page, not of a part.
_STATE_FIRST = frozenset("no not has with without is when show hide".split())
_STATE_LAST = frozenset("open opened closed visible active inactive enabled disabled collapsed expanded on off".split())
_GOOD_WORDS = frozenset("article content body entry main post story text".split())
_WEIGHT = {"article": 3.0, "main": 2.5, "body": 0.6, "html": 0.3}
#: Start tags that leave a head open.
_HEAD_TAGS = frozenset("head title meta link base script style noscript template".split())
DEPTH = 64


class _Element:
    __slots__ = ("comment", "depth", "key", "kind", "named", "out", "parent", "size", "step", "suspect", "tag")

    def __init__(self, tag: str, parent: _Element | None, own: dict[str, str]):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 1
        words: set[str] = set()
        names: set[str] = set()
        if own:
            for token in f"{own.get('class', '')} {own.get('id', '')}".split():
                parts = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()) if w]
                if parts and not (len(parts) > 1 and (parts[0] in _STATE_FIRST or parts[-1] in _STATE_LAST)):
                    words.update(parts)
            names = {re.sub(r"[\d/]+", "", c) for c in own.get("class", "").lower().split()} - {""}
        self.step = f"{tag}.{'.'.join(sorted(names))}" if names else tag
        self.out = tag in _OUT_TAGS or "hidden" in own
        stated = tag in _SUSPECT_TAGS or own.get("role", "").lower() in _OUT_ROLES
        self.suspect = stated or (tag not in ("body", "html") and bool(words & _OUT_WORDS))
        self.named = self.suspect and not stated  # only a word of its class or id says so
        self.comment = bool(words & _COMMENT_WORDS)
        self.kind = _WEIGHT.get(tag, 1.0) * (1.5 if words & _GOOD_WORDS else 1.0)
        self.key = tag in ("article", "main") or tag == "h1"  # whether a part that an article has lies in it
        self.size = 0  # characters of text in it

    @property
    def holds(self) -> bool:
        """Whether it is a container, which can be an article's."""
        if self.tag == "td":
            return self.kind > 1  # of a table that lays out the page
        return self.tag not in _PART and (self.tag in _BLOCK or not self.parent)


class Page:
    """``elements``, parents before children, and ``texts``: (element, text, within a link) in page order; text is None where a block starts or ends.

    Any input gives some tree, in linear time: unclosed elements end with what encloses them,
    stray end tags are passed over, and a comment, tag or raw element that never ends takes the
    rest of the page.
    """

    def __init__(self, html: str):
        self.elements: list[_Element] = [_Element("html", None, {})]
        self.texts: list[tuple[_Element, str | None, bool]] = []
        self._read(html)
        self._judge()

    def _read(self, html: str) -> None:
        at, links = 0, 0
        here, root = self.elements[0], self.elements[0]
        opened: Counter[str] = Counter(["html"])

        def up(top: _Element) -> None:
            """Close all elements below and including ``top``."""
            nonlocal here, links
            while True:
                closed, here = here, here.parent
                opened[closed.tag] -= 1
                links -= closed.tag == "a"
                if closed is top:
                    return

        def say(text: str) -> None:
            if here.tag == "head" and text.strip():
                up(here)
            self.texts.append((here, text, links > 0))

        while at < len(html):
            found = _TOKEN.search(html, at)
            stop = found.start() if found else len(html)
            if stop > at:
                say(unescape(html[at:stop]))
            if not found:
                return
            at = found.end()
            tag = (found["tag"] or found["tag2"] or "").lower()
            if not tag:
                if found[0].startswith("<![CDATA["):
                    say(found[0][9:].removesuffix("]]>"))
                continue
            if found["end"] or found["end2"]:
                if opened[tag] and not (tag == "html" and opened[tag] == 1):
                    top = here
                    while top.tag != tag:
                        top = top.parent
                    up(top)
                if tag in _BLOCK:
                    self.texts.append((here, None, False))
                continue
            if opened["head"] and tag not in _HEAD_TAGS:
                top = here
                while top.tag != "head":
                    top = top.parent
                up(top)
            attrs = found["attrs"] if found["tag"] else found["attrs2"]
            if tag in _BLOCK:
                self.texts.append((here, None, False))
            if tag in ("html", "head", "body") and opened[tag]:
                continue
            names, bars = _CLOSES.get(tag, ((), ()))
            if any(opened[n] for n in names):
                top = here
                while top is not root and top.tag not in names and top.tag not in bars:
                    top = top.parent
                if top.tag in names:
                    up(top)
            if tag in _VOID or (attrs or "").endswith("/") and tag not in _BLOCK:
                continue
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE).search(html, at)
                at = end.end() if end else len(html)
                continue
            here = _Element(tag, here, {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attrs)} if attrs else {})
            self.elements.append(here)
            opened[tag] += 1
            links += tag == "a"

    def _judge(self) -> None:
        """Which elements are out."""
        for e in self.elements[1:]:
            e.out = e.out or e.parent.out
        for e, text, _ in self.texts:
            if text and not e.out:
                e.size += len(text.strip())
        for e in reversed(self.elements[1:]):
            e.parent.size += e.size
            e.parent.key = e.parent.key or e.key
        whole = self.elements[0].size
        inside = {self.elements[0]: False}
        out: set[_Element] = set()
        for e in self.elements[1:]:
            inside[e] = inside[e.parent] or e.tag in ("article", "main")
            heading = e.tag == "header" and inside[e] and e.key  # an article's own title
            wraps = (e.key or e.named) and 2 * e.size >= whole and not e.comment
            if e.parent in out or (e.suspect and not heading and not wraps):
                out.add(e)
        if any(text and text.strip() and not e.out and e not in out for e, text, _ in self.texts):
            for e in out:
                e.out = True


def _scores(page: Page) -> dict[str, float]:
    worth = dict.fromkeys(page.elements, 0.0)
    for e, text, linked in page.texts:
        if text and not e.out:
            worth[e] += len(text.strip()) * (0.1 if linked else 1.0)
    scores: dict[str, float] = defaultdict(float)
    for e in reversed(page.elements):
        own = worth[e]
        if own and e.holds and e.depth <= DEPTH:
            steps, up = [], e
            while up:
                steps.append(up.step)
                up = up.parent
            scores["/".join(reversed(steps))] += own * e.kind
            own /= 2
        if e.parent:
            worth[e.parent] += own
    return dict(scores)


def container_scores(html: str) -> dict[str, float]:
    """Generalised path -> score: text outside links, in full for the nearest container, by halves further up."""
    return _scores(Page(html))


def _text_at(page: Page, path: str) -> str:
    """The text of all elements at ``path``."""
    steps = path.split("/")
    depth: dict[_Element | None, int] = {None: 0}  # how many steps of the path lead to it; all of them inside
    for e in page.elements:
        have = depth[e.parent]
        depth[e] = have if have in (-1, len(steps)) else have + 1 if e.step == steps[have] else -1
    kept = [" " if text is None else text for e, text, _ in page.texts if text is None or (not e.out and depth[e] == len(steps))]
    return " ".join("".join(kept).split())


def extract(html: str, path: str | None) -> str:
    """The text of all elements at ``path``, or at the page's own best path if it has none there."""
    page = Page(html)
    found = _text_at(page, path) if path else ""
    if not found and (scores := _scores(page)):
        found = _text_at(page, max(scores, key=lambda p: (scores[p], p)))
    return found


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    A null html is empty, as is the text of a page without any; a null URL, or one without
    ``://``, counts as the empty host. Rows may repeat. Votes are summed per (host, path) before
    their shuffle, so that a host with very many pages costs no more than others; the pages are
    not shuffled as long as the winners, one short row for each host, fit a broadcast.
    """
    host = split_url(F.col("url"))[0]
    rows = pages.select("page_id", "url", "html", host.alias("host"))

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: dict[tuple[str, str], float] = defaultdict(float)
            for h, page in zip(batch["host"], batch["html"], strict=True):
                scores = container_scores(page or "")
                whole = sum(scores.values())
                for path, score in scores.items():
                    sums[h, path] += score / whole
            yield pd.DataFrame([(h, p, s) for (h, p), s in sums.items()], columns=["host", "path", "share"])

    sums = rows.select("host", "html").mapInPandas(votes, "host string, path string, share double").groupBy("host", "path").agg(F.sum("share").alias("share"))
    best = sums.groupBy("host").agg(F.max(F.struct(F.round("share", 6).alias("share"), "path")).alias("best"))
    winners = settle(best.select(F.col("host").alias("voter"), F.col("best.path").alias("winner")), "winners")

    @F.pandas_udf("string")
    def text_at(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for html, path in batches:
            yield pd.Series([extract(h or "", p) for h, p in zip(html, path, strict=True)], dtype=object)

    joined = rows.join(bounded(winners), F.col("host") == F.col("voter"), "left")
    found = joined.select("page_id", "url", text_at("html", "winner").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
