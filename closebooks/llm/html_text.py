"""Main text of web pages by tree scoring.

A page is read into a tree (tolerant of unclosed and wrongly nested tags). Parts that are
never article text (scripts, menus, forms, elements named as adverts, notices, comments ...)
are left out. Every paragraph earns points for its length and its commas and passes them to
its ancestors, the farther the less; a container's points are discounted by the share of its
text that is links. The best container is kept, with the siblings that score enough.
Its blocks, in page order, are the text.

Defined cases: a null, empty or textless page gives the empty text; markup that ends in the
middle of a tag loses that tag alone; repeated rows are extracted each; nesting of any depth
is handled without recursion; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)"
    r"(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
SPACES = re.compile("[\x20\x09-\x0d]+")
NAMES = re.compile("[a-z]+")
QUOTED = re.compile("\"[^\"]*\"|'[^']*'")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
ABOUT = re.compile(r"\b(?:has|with|no|without)[-_][\w-]+")  # class names about other parts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements inside a line of text whose own text is none of the page's.
MUTE_TAGS = frozenset("button select svg math canvas audio video object map".split())
INLINE = MUTE_TAGS | frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
    "nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end a paragraph's reach: an open <p> outside of them stays open.
SCOPE = frozenset("table td th caption button object".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "a": {"a"}}
#: What an implied end of these cannot pass.
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"},
         "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "a": {"td", "table"}}
DROP_TAGS = frozenset("head template nav footer aside dialog menu form".split())
HEAD_TAGS = frozenset("header div section hgroup".split())  # heads by tag or by class name
DROP_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar "
    "form".split())
DROP_NAMES = frozenset(
    "ad ads adv advert advertisement adverts advertising adsense banner breadcrumb breadcrumbs "
    "comment comments commentlist consent cookie cookies discussion disqus footer gdpr "
    "login masthead menu menus modal nav navbar navigation newsletter notice notices notification "
    "overlay pager pagination paywall popup promo promotion recommended related replies reply "
    "respond search share sharing sidebar sidebars signup social sponsor sponsored subscribe "
    "subscription toolbar widget widgets".split())
ADVERT_NAMES = frozenset("ad ads advert advertisement adverts promo sponsored".split())
REPLY_NAMES = frozenset(
    "comment comments commentlist disqus replies reply respond".split())
LINKED = 0.5  # share of links from which a named container of an article is left out
GOOD_NAMES = frozenset("article blog body content entry main page post story text".split())
KEEPERS = frozenset(["article", "main"])
PRIOR = {"article": 30.0, "main": 20.0, "section": 3.0, "div": 5.0, "td": 3.0, "blockquote": 3.0,
         "pre": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "form": -3.0, "address": -3.0}
PARAGRAPHS = frozenset("p pre blockquote li td th dd dt figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REACH = 5  # ancestors that a paragraph's points go up to


class Page:
    """Elements in page order (a parent before its children) and the blocks of text."""

    def __init__(self, source: str):
        self.tag, self.parent, self.good = ["#"], [-1], [0]
        self.classes: list[str] = [""]
        self.drop, self.named = [False], [False]  # hidden; not article text by tag or name
        self.called = [""]  # by a name of DROP_NAMES: "name", or "sure" for adverts and comments
        self.head, self.mute = [False], [False]  # a head of its parent; silent inside a line
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters of links
        self._open = [0]
        self._text: list[str] = []
        self._links = 0
        self._in_link = self._muted = 0
        self._read(source)
        self._flush()

    def _flush(self) -> None:
        if self._text:
            text = SPACES.sub(" ", "".join(self._text)).strip(" ")
            if text:
                at = next(i for i in reversed(self._open) if self.tag[i] not in INLINE)
                self.blocks.append((at, text, min(self._links, len(text))))
            self._text = []
        self._links = 0

    def _say(self, text: str) -> None:
        if self._muted:
            return
        if "&" in text:
            text = html.unescape(text)
        self._text.append(text)
        if self._in_link:
            self._links += len(SPACES.sub("", text))

    def _pop_to(self, depth: int) -> None:
        gone = [self.tag[i] for i in self._open[depth:]]
        if any(t not in INLINE for t in gone):
            self._flush()
        self._in_link -= gone.count("a")
        self._muted -= sum(self.mute[i] for i in self._open[depth:])
        del self._open[depth:]

    def _find(self, wanted: set[str], stop: frozenset[str] | set[str]) -> int:
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[depth]]
            if tag in wanted:
                return depth
            if tag in stop:
                return 0
        return 0

    def _start(self, tag: str, rest: str) -> None:
        if tag == "br":
            self._text.append(" ")
        if tag in VOID:
            if tag not in INLINE:
                self._flush()
            return
        if tag not in INLINE:
            self._flush()
            # A paragraph ends where a block begins; only inline elements stand between.
            depth = self._find({"p"}, SCOPE) if self._has_p() else 0
            if depth:
                self._pop_to(depth)
        if tag in CLOSES and (depth := self._find(CLOSES[tag], HOLDS[tag])):
            self._pop_to(depth)
        up = self._open[-1]
        attributes = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(rest)} \
            if "=" in rest else {}
        classes = set(NAMES.findall(ABOUT.sub(" ", attributes.get("class", "").lower())))
        # Ids are often made of a heading's words: only a whole id, or its last word, is a name.
        ident = NAMES.findall(ABOUT.sub(" ", attributes.get("id", "").lower()))
        names = classes | set(ident)
        own = classes if tag in HEADINGS or tag in PARAGRAPHS else classes | set(ident[-1:])
        sure = own if len(ident) < 2 else classes
        role = attributes.get("role", "").lower()
        style = attributes.get("style", "").replace(" ", "").lower()
        hidden = "display:none" in style or "visibility:hidden" in style or (
            attributes.get("aria-hidden", "").lower() == "true") or (
            "hidden" in rest and bool(HIDDEN.search(QUOTED.sub('""', rest))))
        inline = tag in INLINE
        whole = tag in ("html", "body") or tag in KEEPERS
        self.tag.append(tag)
        self.classes.append(attributes.get("class") or "")
        self.parent.append(up)
        self.drop.append(hidden)
        self.head.append(tag == "header" or tag in HEAD_TAGS and "header" in names)
        self.mute.append(inline and (hidden or tag in MUTE_TAGS or bool(sure & ADVERT_NAMES)))
        self._muted += self.mute[-1]
        self.called.append(
            "" if whole or not own & DROP_NAMES
            else "sure" if sure & (ADVERT_NAMES | REPLY_NAMES) else "name")
        self.named.append(tag in DROP_TAGS or role in DROP_ROLES or (
            tag in KEEPERS and bool(names & {"comment", "comments", "reply", "teaser", "related"})))
        self.good.append(len(names & GOOD_NAMES))
        self._open.append(len(self.tag) - 1)
        self._in_link += tag == "a"

    def _has_p(self) -> bool:
        return any(self.tag[i] == "p" for i in self._open[-12:])

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            found = MARKUP.search(source, at)
            if not found:
                self._say(source[at:])
                return
            if found.start() > at:
                self._say(source[at:found.start()])
            at = found.end()
            tag = (found["tag"] or found["tag2"] or "").lower()
            if not tag or at == end and source[-1] != ">":
                continue
            if found["end"] or found["end2"]:
                if tag == "br":
                    self._text.append(" ")
                elif depth := self._find({tag}, {"td", "th"} if tag in INLINE else frozenset()):
                    self._pop_to(depth)
                continue
            if tag in RAW:  # no markup inside, and never text of the page
                close = re.compile(f"</{tag}[^>]*>?", re.I).search(source, at)
                at = close.end() if close else end
                continue
            self._start(tag, found["rest"] or found["rest2"] or "")

    def main_text(self) -> list[str]:
        n = len(self.tag)
        holds, titled, told = [t in KEEPERS for t in self.tag], [t == "h1" for t in self.tag], [0] * n
        for at, text, _ in self.blocks:
            told[at] += len(text) if self.tag[at] in PARAGRAPHS else 0
        for i in range(n - 1, 0, -1):
            holds[self.parent[i]] |= holds[i]
            titled[self.parent[i]] |= titled[i]
            told[self.parent[i]] += told[i]
        for i in range(n):  # the page's title with most of its paragraphs is the article
            holds[i] |= titled[i] and 2 * told[i] > told[0]
        size, linked_size = [0] * n, [0] * n
        for at, text, linked in self.blocks:
            size[at] += len(text)
            linked_size[at] += linked
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
            linked_size[self.parent[i]] += linked_size[i]
        in_keeper, drop = [False] * n, [False] * n
        for i in range(1, n):
            up = self.parent[i]
            in_keeper[i] = in_keeper[up] or self.tag[i] in KEEPERS
            named = self.named[i] or self.called[i] == "sure"
            if self.called[i] == "name":  # in an article, only a container of links
                named |= not in_keeper[up] or (
                    self.tag[i] not in HEADINGS and self.tag[i] not in PARAGRAPHS
                    and linked_size[i] >= LINKED * size[i])
            # An article's own head stays, but only its headings are kept below.
            named |= self.head[i] and not in_keeper[up]
            if self.tag[i] not in KEEPERS and holds[i]:
                named = False  # a wrapper around the article
            drop[i] = drop[up] or self.drop[i] or named
        heads = [False] * n
        for i in range(1, n):
            up = self.parent[i]
            heads[i] = heads[up] or self.head[i] and in_keeper[up] and not holds[i]
        blocks = [b for b in self.blocks if not drop[b[0]] and not (
            heads[b[0]] and self.tag[b[0]] not in HEADINGS)]
        if not blocks:
            return []
        chars, links, points, text_in = [0] * n, [0] * n, [0.0] * n, [False] * n
        for at, text, linked in blocks:
            chars[at] += len(text)
            links[at] += linked
            if self.tag[at] in HEADINGS:
                text_in[at] = True
                continue
            earned = 1 + text.count(",") + min(len(text) / 100, 3)
            up = self.parent[at] if self.tag[at] in PARAGRAPHS else at
            for level in range(REACH):
                if up < 0:
                    break
                points[up] += earned / (1 if level == 0 else 2 * level)
                text_in[up] = True
                up = self.parent[up]
        for i in range(n - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
            links[self.parent[i]] += links[i]

        def density(i: int) -> float:
            return links[i] / chars[i] if chars[i] else 0.0

        def score(i: int) -> float:
            prior = PRIOR.get(self.tag[i], 0.0) + min(self.good[i], 1) * 10.0
            return (points[i] + prior) * (1 - density(i))

        choice = [i for i in range(n) if chars[i] and text_in[i] and not drop[i]
                  and self.tag[i] not in PARAGRAPHS and self.tag[i] not in INLINE
                  and self.tag[i] not in HEADINGS] or [0]
        best = max(choice, key=lambda i: (score(i), -i))
        top = score(best)
        inside = best
        while inside > 0 and self.tag[inside] not in KEEPERS:
            inside = self.parent[inside]
        if inside > 0 and density(inside) < LINKED:
            best = inside  # all of the article that holds the best part
        keep = [False] * n
        keep[best] = True
        # What stands beside an article element is not the article; beside a plain container,
        # parts of the same text often are.
        alone = best == 0 or self.tag[best] in KEEPERS
        for i in range(n if alone else self.parent[best] + 1, n):
            if i == best or self.parent[i] != self.parent[best] or not chars[i]:
                continue
            if self.tag[i] == "p":
                keep[i] = density(i) < 0.25 and chars[i] > 80
            elif self.tag[i] in HEADINGS:
                keep[i] = i < best and density(i) < 0.25
            else:
                # The same kind of container as the best one goes on with its text, however
                # short; another kind has to earn its place.
                alike = self.tag[i] == self.tag[best] and self.classes[i] == self.classes[best]
                earned = points[i] >= 5 and score(i) >= max(10.0, top / 5)
                keep[i] = text_in[i] and density(i) < 0.25 and (alike or earned)
        for i in range(1, n):
            keep[i] |= keep[self.parent[i]]
        return [text for at, text, _ in blocks if keep[at]]


def extract(source: str | None) -> str:
    """The main text of a page, blocks joined by an empty line."""
    return "\n\n".join(Page(source).main_text()) if source else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
             pa.array(list(map(len, texts)), pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """Per page: its main text and the text's number of code points."""
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long")
