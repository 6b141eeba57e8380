"""A page's token stream: block elements with what their names say, and the text between them.

Tags are matched as they open and close, with the closings that HTML lets authors leave
out. Inline elements are part of the text around them; br is white space. A block is the
text between two borders of block elements, with character references decoded, white
space turned into single blanks, and trimmed.

An element's label is its tag, what its class, id and role say about its use (CUES), and,
for containers, its first class. Labels of the same use are so the same on every page.
"""

from __future__ import annotations

import re
from html import unescape
from zlib import crc32

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<[!?/][^>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMED = re.compile(r"\s(?:class|id|role|hidden|aria-hidden|style|itemprop)\b", re.I)
_WORD = re.compile(r"[A-Z]*[a-z]+|[A-Z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_INLINE = frozenset(
    "a abbr acronym b basefont bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr output picture q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_IN_HEAD = frozenset("head meta link base title style script noscript template".split())
#: What an opening tag closes, and where looking for it ends.
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
_LIST = frozenset(("ul", "ol", "menu", "dir"))
_TABLE = frozenset(("table",))
_ROW = frozenset(("table", "tr"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CLOSES = {
    "li": (frozenset(("li",)), _LIST), "dd": (frozenset(("dd", "dt")), frozenset(("dl",))), "dt": (frozenset(("dd", "dt")), frozenset(("dl",))),
    "td": (frozenset(("td", "th")), _ROW), "th": (frozenset(("td", "th")), _ROW), "tr": (frozenset(("tr",)), _TABLE),
    **{t: (frozenset(("thead", "tbody", "tfoot", "caption", "colgroup")), _TABLE) for t in ("thead", "tbody", "tfoot")},
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))), "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
}
#: An end tag closes nothing beyond these unless it is theirs.
_BARRIER = frozenset(("table", "td", "th", "body", "html"))
#: Deeper elements still divide blocks, but belong to the element at this depth.
MAX_DEPTH = 80
_CONTAINERS = frozenset("div section ul ol table form main article aside nav header footer td".split())

#: Uses, and the words in class, id or role that name them; "*" stands for any ending.
CUES = {
    "nav": "nav navbar navigation navi* menu menubar menus breadcrumb* pagination pager paginat* toc toolbar tablist skip topnav sitemap",
    "head": "top header* masthead topbar topheader banner* hero brand",
    "foot": "bottom footer* colophon bottombar contentinfo copyright legal imprint",
    "side": "sidebar* side aside rail complementary widget* gutter leftcol rightcol",
    "ad": "ad ads adbox adslot adunit adv advert* adsense adwords sponsor* promo* affiliate outbrain taboola dfp doubleclick commercial",
    "notice": "cookie* consent gdpr ccpa notice* alert* popup* modal* overlay lightbox newsletter* subscri* signup paywall toast dialog alertdialog announcement* disclaimer",
    "comment": "comment* disqus respond response* reply replies discussion* feedback guestbook talkback",
    "share": "share* sharing social* follow addthis sharethis",
    "related": "related* recommend* popular trending similar readmore morestories teaser* suggested",
    "form": "login search* form contactform register",
    "main": "main articlebody",
    "body": "article content contents post entry story text prose blog maincontent bodytext articletext posting fulltext page",
}
_EXACT = {w: use for use, words in CUES.items() for w in words.split() if not w.endswith("*")}
_PREFIX = {w[:-1]: use for use, words in CUES.items() for w in words.split() if w.endswith("*")}
_FOUND_BY = re.compile("|".join(sorted(_PREFIX, key=len, reverse=True)))
_labels: dict[tuple[str, str], str] = {}


def _uses(name: str) -> set[str]:
    words = [w.lower() for w in _WORD.findall(name)]
    found = set()
    for word in (*words, "".join(words)):
        if word in _EXACT:
            found.add(_EXACT[word])
        elif (m := _FOUND_BY.match(word)) is not None:
            found.add(_PREFIX[m[0]])
    return found


def label_of(tag: str, attributes: str) -> str:
    """tag, ':' and its uses, '.' and the first class of a container."""
    if not attributes or not _NAMED.search(" " + attributes):
        return tag
    if (held := _labels.get((tag, attributes))) is not None:
        return held
    uses, first = set(), ""
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop"):
            for word in value.split():
                uses |= _uses(word)
            if name == "class" and tag in _CONTAINERS and value.split():
                first = re.sub(r"\d+", "0", value.split()[0].lower())
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            uses.add("hidden")
    label = tag + (":" + ",".join(sorted(uses)) if uses else "") + ("." + first if first else "")
    if len(_labels) > 20_000:
        _labels.clear()
    _labels[tag, attributes] = label
    return label


class Page:
    """root: nested [label, children] with block numbers as leaves; texts and links (characters within links) by block."""

    def __init__(self, html: str):
        self.root: list = ["html", []]
        self.texts: list[str] = []
        self.links: list[int] = []
        #: Open elements: (tag, children), children of the element that holds their text.
        self.open: list[tuple[str, list]] = [("html", self.root[1])]
        self.names = ["html"]
        self.held: list[str] = []
        self.in_link = self.link_chars = 0
        self._read(html)

    def _border(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            self.held.clear()
            if text:
                self.open[-1][1].append(len(self.texts))
                self.texts.append(text)
                self.links.append(min(len(text), self.link_chars))
            self.link_chars = 0

    def _text(self, text: str) -> None:
        if "&" in text:
            text = unescape(text)
        if self.in_link:
            self.link_chars += len(text.strip())
        self.held.append(text)

    def _close(self, depth: int) -> None:
        del self.open[depth:], self.names[depth:]

    def _find(self, tags: frozenset[str], ends: frozenset[str]) -> int:
        for depth in range(len(self.names) - 1, 0, -1):
            if self.names[depth] in tags:
                return depth
            if self.names[depth] in ends:
                break
        return 0

    def _opened(self, tag: str, attributes: str) -> None:
        self._border()
        if tag in ("html", "body") and tag in self.names:
            return
        if "head" in self.names and tag not in _IN_HEAD:
            self._close(self.names.index("head"))
        if tag in _CLOSES_P and (depth := self._find(frozenset(("p",)), _BARRIER | {"button"})):
            self._close(depth)
        if tag in _CLOSES and (depth := self._find(*_CLOSES[tag])):
            self._close(depth)
        elif tag in _HEADINGS and self.names[-1] in _HEADINGS:
            self._close(len(self.names) - 1)
        if tag in _VOID:
            return
        children = self.open[-1][1]
        if len(self.names) <= MAX_DEPTH:
            children.append([label_of(tag, attributes), own := []])
            children = own
        self.open.append((tag, children))
        self.names.append(tag)

    def _closed(self, tag: str) -> None:
        self._border()
        if tag not in ("html", "body") and (depth := self._find(frozenset((tag,)), _BARRIER - {tag})):
            self._close(depth)

    def _read(self, html: str) -> None:
        at, scan = 0, _TAG.search
        while (m := scan(html, at)) is not None:
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    self._text(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
                continue
            tag, closing = m[2].lower(), m[1]
            if tag == "br":
                self.held.append(" ")
            elif tag in _RAW:
                if not closing:
                    end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
                    if end is not None:
                        at = end.end()
                    elif tag in ("script", "style", "textarea", "xmp", "iframe"):
                        at = len(html)
                    else:
                        after = html.find("<", at)
                        at = after if after >= 0 else len(html)
                    if tag != "script" and tag != "style":
                        self._border()
            elif tag in _INLINE:
                if tag == "a":
                    self.in_link = 0 if closing else 1
            elif closing:
                self._closed(tag)
            else:
                self._opened(tag, m[3])
        if at < len(html):
            self._text(html[at:])
        self._border()


def text_key(texts: list[str]) -> int:
    """A number for the texts of a place: the same for the same texts."""
    joined = "\n".join(texts).encode()
    return crc32(joined) << 24 | len(joined) & 0xFFFFFF
