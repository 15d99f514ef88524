"""Main-text extraction from HTML by parser events and text-to-tag ratios.

The standard library's parser is fed in pieces; its events cut the page into lines at block boundaries, each with its
text, its number of tags and the container it stands in. The text-to-tag ratio of each line is smoothed by a Gaussian
and split into two clusters by a threshold; lines above it mark the content. The marks choose the region:

* the articles that hold a marked line, or text outside links; in a main element around them also marked lines and headings;
* else the main elements;
* the whole page if it has neither, or if their text is less than OUTSIDE of the marked text outside them. There the marks
  tell unnamed menus, too: before the first and after the last marked line, lists without a marked line whose text is all
  links, and lines of two or more links and nothing else, are left out.

Inside the region only lines in menus, headers, footers, sidebars, notices, adverts, forms and reader comments are left
out: elements of that meaning, and those whose class or id is such a name, or ends in one but for words of layout.

Defined cases: null or empty html gives the empty text; a page cut off in a tag gives the text before it; repeated rows
each give a row; an empty table gives an empty one; a page without any block is one line.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillstone.llm.arrow import map_rows

# Element names of HTML, and words that name page furniture in class, id and role.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe object svg math head title".split())
FURNITURE = frozenset("nav header footer aside form menu dialog search button select textarea fieldset label".split())
IN_HEAD = frozenset("base basefont bgsound command head html link meta noframes noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
LISTS = frozenset("ul ol dl dir".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notices banner comment comments disqus respond reply replies share sharing social related newsletter subscribe subscription popup modal widget toolbar pagination pager login signup".split())
LAYOUT = frozenset("area bar block body bottom box button buttons card cell center col column container content fixed float form group holder icon icons inner item items layout left link links list main menu module outer panel part posts primary region right row secondary section slot sticky stories story strip text top unit widget widgets wrap wrapper zone".split())
STATES = frozenset("has is no not with without".split())
COMMENTS = frozenset("comment comments reply replies respond".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())

SIGMA, RADIUS = 1.0, 2
PIECE = 1 << 16
_KERNEL = np.exp(-np.arange(-RADIUS, RADIUS + 1) ** 2 / (2 * SIGMA**2))
#: Share of the marked text outside articles below which they are not the content.
OUTSIDE = 0.25
_WORD = re.compile(r"[a-z]{2,}")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_CUT = re.compile(r"<[A-Za-z/!?][^<>]*$")


def names_furniture(token: str, names: frozenset[str] = NAMES) -> bool:
    """Whether a class or id is the name of furniture: "cookie-banner", "navLeft", "sidebar_box", but not "social-history".

    A compound means what its last word says, but for words of layout; a wrapper that has a sidebar isn't one.
    """
    words = _WORD.findall(_CAMEL.sub("-", token).lower())
    if not words or not STATES.isdisjoint(words[:-1]):
        return False
    while len(words) > 1 and words[-1] in LAYOUT and words[-1] not in names:
        words.pop()
    return words[-1] in names


def is_furniture(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    if tag in FURNITURE and not (tag == "header" and in_article):
        return True
    if tag in ("html", "body", "main"):
        return False
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value and value.lower() in ROLES:
            return tag != "article"
        if name in ("class", "id") and value and any(names_furniture(x, COMMENTS if tag == "article" else NAMES) for x in value.split()):
            return True
    return False


class Lines(HTMLParser):
    """Collects lines: text, tags, whether they are page furniture, and the number of their article or main element.

    Of each line also the number of its innermost list, how many links it has text of, whether text stands outside links,
    and whether it is a heading. Of each region its kind, and the main element around an article.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, int]] = []
        self.links: list[tuple[int, int, bool, bool]] = []
        self.lists = 0
        self.within: list[tuple[int, int]] = [(0, -1)]  # depth and number of the open lists
        self.link = self.linked = 0  # depth of the open link, and links with text in this line
        self.fresh, self.plain = False, False
        self.kinds: list[str] = []
        self.around: list[int] = []
        self.held: list[str] = []
        self.tags = 0
        self.open: list[tuple[str, bool, bool, int]] = [("", False, False, -1)]  # tag, hidden, furniture, region

    def flush(self) -> None:
        if self.held:
            if text := " ".join("".join(self.held).split()):
                _, _, furniture, region = self.open[-1]
                self.lines.append((text, max(1, self.tags), furniture, region))
                self.links.append((self.within[-1][1], self.linked, self.plain, any(x[0] in HEADINGS for x in self.open)))
                self.tags = 0
            self.held = []
            self.linked, self.plain, self.fresh = 0, False, True
        elif self.tags and self.lines and self.tags > 64:
            self.tags = 64

    def leave_head(self, tag: str) -> None:
        """Closes a head that `tag` (empty for text) can't stand in; its end tag may be omitted."""
        if tag == "body" or self.open[-1][0] == "head" and tag not in IN_HEAD:
            for k in range(1, len(self.open)):
                if self.open[k][0] == "head":
                    del self.open[k:]
                    break

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.leave_head(tag)
        _, hidden, furniture, region = self.open[-1]
        block = tag in BLOCKS
        if block:
            self.flush()
            if self.open[-1][0] == "p" or self.open[-1][0] == tag in ("li", "dt", "dd", "tr", "td", "th"):
                self.open.pop()
                self.leave()
                _, hidden, furniture, region = self.open[-1]
        self.tags += 1
        if tag == "a":
            self.link, self.fresh = len(self.open), True
        if tag in VOID:
            if tag in ("br", "wbr", "hr"):
                self.held.append(" " if tag != "wbr" else "")
            return
        if tag in ("article", "main") and not furniture and not is_furniture(tag, attrs, False) and (region < 0 or self.kinds[region] == "main" and tag == "article"):
            self.around.append(region)
            region = len(self.kinds)
            self.kinds.append(tag)
        own = is_furniture(tag, attrs, region >= 0)
        furniture = furniture or own
        hidden = hidden or tag in HIDDEN or own and not block  # furniture inside a line isn't a line
        if block or hidden or (tag, hidden, furniture, region)[1:] != self.open[-1][1:]:
            self.open.append((tag, hidden, furniture, region))
            if tag in LISTS:
                self.within.append((len(self.open), self.lists))
                self.lists += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag == "a":
            self.link = 0
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                self.leave()
                break
            if tag not in BLOCKS and self.open[k][0] in BLOCKS:
                break  # an inline end tag closes nothing outside its block

    def handle_data(self, data: str) -> None:
        if self.open[-1][0] == "head" and data.strip():
            self.leave_head("")
        if not self.open[-1][1]:
            self.held.append(data)
            if not self.link:
                self.plain = self.plain or any(map(str.isalnum, data))
            elif self.fresh and data.strip():
                self.linked, self.fresh = self.linked + 1, False

    def leave(self) -> None:
        """Forgets links and lists whose element is closed."""
        if self.link > len(self.open):
            self.link = 0
        while self.within[-1][0] > len(self.open):
            self.within.pop()


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel is cut and weighed anew."""
    weight = np.convolve(np.ones(len(ratios)), _KERNEL)[RADIUS : RADIUS + len(ratios)]
    return np.convolve(ratios, _KERNEL)[RADIUS : RADIUS + len(ratios)] / weight


def threshold(values: np.ndarray) -> float:
    """The border between two clusters on a line (two means); the least value where all are equal."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        border = (low + high) / 2
        above = values >= border
        if above.all():
            return float(values.min())
        to = (float(values[~above].mean()), float(values[above].mean()))
        if to == (low, high):
            break
        low, high = to
    return (low + high) / 2


def main_text(html: str | None) -> str:
    if not html:
        return ""
    html = _CUT.sub("", html)  # a page cut off in a tag
    parser = Lines()
    for at in range(0, len(html), PIECE):
        parser.feed(html[at : at + PIECE])
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    ratio = smoothed(np.array([len(text) / tags for text, tags, _, _ in lines]))
    open_ = [k for k, x in enumerate(lines) if not x[2]]
    if not open_:
        return ""
    border = threshold(ratio[open_])
    marked = {k for k in open_ if ratio[k] >= border}
    inside = [k for k in open_ if lines[k][3] >= 0]
    if inside and sum(len(lines[k][0]) for k in inside) >= OUTSIDE * sum(len(lines[k][0]) for k in marked if lines[k][3] < 0):
        return "\n".join(lines[k][0] for k in in_region(parser, inside, marked))
    first, last = min(marked), max(marked)
    no_menus = {parser.links[k][0] for k in open_ if k in marked or any(parser.links[k][2:])}

    def is_menu(k: int) -> bool:
        group, linked, plain, heading = parser.links[k]
        return not plain and not heading and (linked > 1 or linked > 0 and group >= 0) and group not in no_menus - {-1}

    return "\n".join(lines[k][0] for k in open_ if first <= k <= last or not is_menu(k))


def in_region(parser: Lines, inside: list[int], marked: set[int]) -> list[int]:
    """The lines of the articles that count and of the main elements around them; of all main elements where there is no article."""
    region = {k: parser.lines[k][3] for k in inside}
    articles = {r for r in region.values() if parser.kinds[r] == "article"}
    if not articles:
        return inside
    kept = {region[k] for k in inside if region[k] in articles and (k in marked or parser.links[k][2])} or articles
    around = {parser.around[r] for r in kept}
    return [k for k in inside if region[k] in kept or region[k] in around and (k in marked or parser.links[k][3])]


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id_col, text (main text, empty if none) and n_chars (its code points). One pass, no shuffle."""

    def row(html: str | None) -> tuple[str, int]:
        text = main_text(html)
        return text, len(text)

    return map_rows(pages, [id_col, html_col], [pa.field("text", pa.string()), pa.field("n_chars", pa.int64())], lambda: row)
