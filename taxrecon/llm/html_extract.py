"""Main text of web pages by consensus host paths.

Every page scores its containers by their text; Spark counts, per host, which generalised tag-class path
wins on how many pages, and which containers below it the host's pages together show to be something else;
the pages are then read again with the winning path of their host. A page votes for the whole article around
its best container. Elements leave by tag and role alone; class and id names only lower a container's score,
and it is the host's pages together, with link text, repetition and size, that decide.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, table, written

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r">|=\s*([\"'])")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Character references that stand for no character.
_HUGE = re.compile(r"&#(?:\d{8,}|[xX][0-9a-fA-F]{7,});?")
# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe template noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img picture".split())
CONTAINERS = frozenset("article main section div td body blockquote center".split())
DROPPED = frozenset("head button select option input svg canvas object audio video map applet datalist".split()) | RAW
#: Dropped as well, unless they turn out to be around the article: Page._wrappers().
SUSPECT = frozenset("nav footer aside form dialog menu fieldset header".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
# Words of class and id names that hint at something other than the article.
MARKS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget widgets "
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login comment comments disqus replies respond share sharing "
    "social related recommended recommendations pagination pager tags toolbar copyright skip search form".split()
)
#: Words that a hinting name may have besides, those of the article's own parts, hints that say what a part of the
#: article's head is there, hints of readers' parts, and hints of layout, which may name a wrapper of all the text.
CARRIERS = frozenset(
    "the site page main top bottom left right upper lower primary secondary global local user reader box block area wrap wrapper container "
    "outer inner list item items row column col bar panel section region zone div holder group set button buttons btn link links icon icons "
    "widget text title content body web slot unit this info google facebook twitter wp js id".split()
)
PARTS, HEADS = frozenset("post posts article articles entry entries story stories".split()), frozenset("header masthead banner".split())
READERS = frozenset("comment comments disqus replies respond related recommended recommendations".split())
LAYOUT = frozenset("nav navbar navigation menu submenu header masthead topbar footer sidebar aside widget widgets toolbar search form skip tags".split())
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Parameters: containers below this depth count as part of the one there; characters of a path's step before it is
#: hashed; what a hinted container's text counts for in a score; pages that must repeat a part of few words.
DEPTH, STEP_CHARS, HINTED, REPEATS = 64, 100, 0.1, 4
#: Parameters: characters outside links from which on a block is prose; prose of a nav or header around an article without
#: article tags; characters, and of one block, from which on a part of an article is its own whatever its name; how many
#: times the host's path must fall short of the page's own for the latter to be taken.
PROSE_CHARS, WRAPPED, SECTION, PARAGRAPH, SHORT = 40, 600, 300, 60, 4


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): html_lib.unescape(_HUGE.sub("�", v[1:-1] if v[:1] in "\"'" else v)) for k, v in _ATTR.findall(text)} if text.strip() else {}


@lru_cache(1 << 16)
def _marks(name: str, inside: bool) -> frozenset[str]:
    """Hints of a class or id name. A name hints as a whole: one with any other word (with-sidebar, related-work)
    says something else. inside: of an article or main."""
    words = {w.lower() for w in _WORD.findall(name)}
    words = {w for w in words if not w.isdigit()}
    found = words & MARKS
    if not found or not words <= MARKS | CARRIERS | PARTS:
        return frozenset()
    return found - HEADS if inside or words & PARTS else found


def _hidden(tag: str, attrs: dict[str, str]) -> bool:
    """Whether an element, by its tag or visibility, holds no text to read."""
    if tag in DROPPED:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")) is not None


def _suspect(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether an element, by its tag or role, holds no article text unless it is around the article. inside: of an
    article or main, which have headers of their own."""
    if tag in SUSPECT and not (tag == "header" and inside):
        return True
    return bool(attrs) and tag not in ("html", "body", "article", "main") and attrs.get("role", "").lower() in ROLES


def _marked(tag: str, attrs: dict[str, str], inside: bool) -> frozenset[str]:
    """Hints of an element's names. Headings and paragraphs of an article have none, nor have headings' ids, which
    repeat their text."""
    if not attrs or tag in ("html", "body", "article", "main") or tag in PROSE and inside:
        return frozenset()
    names = attrs.get("class", "").split() + ([] if tag in PROSE and tag != "p" else attrs.get("id", "").split())
    return frozenset().union(*(_marks(n, inside) for n in names))


def _step(tag: str, attrs: dict[str, str], hinted: bool) -> str:
    """Tag and classes, generalised: sorted, with numbers as #; ! where a name hints."""
    names = sorted({re.sub(r"\d+", "#", c.lower()) for c in attrs.get("class", "").split()})
    step = ".".join([tag, *names]) + ("!" if hinted else "")
    return step if len(step) <= STEP_CHARS else f"{tag}.{xxhash.xxh64_hexdigest(step)}"


def _tag_end(page: str, at: int) -> int:
    """Place of the > that ends a tag, values in quotes skipped; -1 where a quote stays open."""
    while m := _STOP.search(page, at):
        if not m[1]:
            return m.start()
        at = page.find(m[1], m.end()) + 1
        if not at:
            return -1
    return -1


class Page:
    """One page, read once from front to back. Containers with equal paths are one node; nodes are numbered so that
    a parent comes before its children. blocks: per block of text its pieces (node, text, in a link, mark, article,
    suspect)."""

    def __init__(self, page: str):
        self.parent, self.step, self.depth, self.key = [-1], [""], [0], [0]
        self._at: dict[tuple[int, str], int] = {}
        self.blocks: list[list[tuple[int, str, bool, int, int, int]]] = []
        #: Hinting elements: names, the one around, article around; articles: whether a main, hint and article around.
        self.soft: list[tuple[frozenset[str], int, int]] = []
        self.articles: list[tuple[bool, int, int]] = []
        #: Elements that hold no article unless they are around it: tag, the one around, whether a name of readers' or
        #: other parts is on it, article around; and whether its end tag came.
        self.suspects: list[tuple[str, int, bool, int]] = []
        self.ended: list[bool] = []
        self._read(page)
        self._wrappers()
        self._measure()

    def _node(self, parent: int, step: str) -> int:
        if self.depth[parent] >= DEPTH:
            return parent
        got = self._at.get((parent, step))
        if got is None:
            got = self._at[parent, step] = len(self.parent)
            self.parent.append(parent), self.step.append(step), self.depth.append(self.depth[parent] + 1)
            self.key.append(xxhash.xxh64_intdigest(step, self.key[parent]) >> 1)
        return got

    def _read(self, page: str) -> None:
        """Unclosed and stray tags are read as browsers do. No step looks back or ahead further than what it then
        takes or closes, so the time is linear in the page."""
        stack: list[tuple[str, int, bool, int, int, int]] = []  # tag, node, hidden, hint, article and suspect around
        where: dict[str, list[int]] = defaultdict(list)  # places of open tags in the stack
        node, bad, mark, article, suspect = 0, False, -1, -1, -1
        pieces: list[tuple[int, str, bool, int, int, int]] = []
        links = 0

        def said(text: str) -> None:
            if text and not bad:
                if "&" in text:
                    text = html_lib.unescape(_HUGE.sub("�", text) if "&#" in text else text)
                pieces.append((node, text, links > 0, mark, article, suspect))

        def flush() -> None:
            nonlocal pieces
            if pieces:
                self.blocks.append(pieces)
                pieces = []

        def last(names) -> int:
            return max((where[x][-1] for x in names if where[x]), default=-1)

        def close(upto: int, ended: bool = False) -> None:
            nonlocal links, node, bad, mark, article, suspect
            if ended and (at := stack[upto][5]) >= 0 and at != (stack[upto - 1][5] if upto else -1):
                self.ended[at] = True
            if any(s[0] not in INLINE for s in stack[upto:]):
                flush()
            for s in stack[upto:]:
                where[s[0]].pop()
                links -= s[0] == "a"
            del stack[upto:]
            _, node, bad, mark, article, suspect = stack[-1] if stack else ("", 0, False, -1, -1, -1)

        at, size, plain = 0, len(page), False
        while at < size:
            lt = page.find("<", at)
            if lt < 0:
                break
            said(page[at:lt])
            c = page[lt + 1 : lt + 2]
            if c in ("!", "?"):
                if page.startswith("<!--", lt):
                    end = page.find("-->", lt + 4)
                    at = end + 3 if end >= 0 else size
                elif page.startswith("<![CDATA[", lt):
                    end = page.find("]]>", lt + 9)
                    said(page[lt + 9 : end if end >= 0 else size])
                    at = end + 3 if end >= 0 else size
                else:
                    end = page.find(">", lt)
                    at = end + 1 if end >= 0 else size
                continue
            m = _NAME.match(page, lt + (2 if c == "/" else 1))
            if not m:
                # </ before anything else is a comment, a lone < is text.
                end = page.find(">", lt) if c == "/" else -1
                if end < 0:
                    said("<")
                at = end + 1 if end >= 0 else lt + 1
                continue
            gt = page.find(">", m.end())
            if gt < 0:
                at = size  # an unfinished tag at the end of the page
                break
            inner = page[m.end() : gt]
            if not plain and c != "/" and ("'" in inner or inner.count('"') % 2):
                end = _tag_end(page, m.end())
                if end < 0:
                    plain = True  # a quote that nothing closes: tags end at their first > from here
                else:
                    gt, inner = end, page[m.end() : end]
            at, tag = gt + 1, m[0].lower()
            if c == "/":
                if tag == "br":
                    said(" ")
                elif tag == "p" and last(("p",)) <= last(CONTAINERS):
                    flush()
                elif (i := last((tag,))) >= 0 and (tag not in INLINE or i > last(CONTAINERS)):
                    close(i, True)
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    said(" ")
                continue
            attrs = _attributes(inner)
            if tag in CLOSES_P and (i := last(("p",))) > last(CONTAINERS):
                close(i)
            if tag in SIBLINGS:
                own, stops = SIBLINGS[tag]
                if (i := last(own)) > last(stops):
                    close(i)
            if tag == "body" and (i := last(("head",))) >= 0:
                close(i)
            if tag not in INLINE:
                flush()
            if tag in RAW:
                end = _raw_end(tag).search(page, at)
                at = end.end() if end else size
                continue
            new_node, new_bad, new_mark, new_article, new_suspect = node, bad or _hidden(tag, attrs), mark, article, suspect
            if not new_bad:
                names = _marked(tag, attrs, article >= 0)
                if _suspect(tag, attrs, article >= 0):
                    new_suspect = len(self.suspects)
                    self.suspects.append((tag, suspect, bool(names - LAYOUT), article))
                    self.ended.append(False)
                    names = frozenset()
                if names:
                    new_mark = len(self.soft)
                    self.soft.append((names, mark, article))
                if tag in ("article", "main"):
                    new_article = len(self.articles)
                    self.articles.append((tag == "main", mark, article))
                if names or tag in CONTAINERS:
                    new_node = self._node(node, _step(tag, attrs, bool(names)))
            links += tag == "a"
            where[tag].append(len(stack))
            stack.append((tag, new_node, new_bad, new_mark, new_article, new_suspect))
            node, bad, mark, article, suspect = new_node, new_bad, new_mark, new_article, new_suspect
        said(page[at:])
        flush()

    def _wrappers(self) -> None:
        """Drops the blocks of suspects, but for those that are around the article: where no article or main has prose
        outside of suspects, the ones around the articles with the most, if that is more than stands outside; else a form
        or fieldset with more than half of the page's prose, and a nav, header or element whose end tag never came with
        nearly all of it. A form round the whole page is common, and so is an end tag that is missing."""
        n = len(self.suspects)
        held, inside, free, outside, total = [0] * n, [0] * n, False, 0, 0
        for b in self.blocks if n else ():
            size = sum(len(p[1]) for p in b if not p[2])
            if size >= PROSE_CHARS:
                # A block lies where its first piece does.
                article, suspect = b[0][4:]
                total += size
                if suspect < 0:
                    outside += size
                    free = free or article >= 0
                else:
                    held[suspect] += size
                    # Of an article that is in it, not around it.
                    inside[suspect] += size * (article >= 0 and article != self.suspects[suspect][3])
        for i in range(n - 1, -1, -1):
            if self.suspects[i][1] >= 0:
                held[self.suspects[i][1]] += held[i]
        keep = [False] * n
        at = max(range(n), key=lambda i: (not self.suspects[i][2], inside[i]), default=-1)
        if n and not free and inside[at] > outside:
            while at >= 0:
                keep[at], at = True, self.suspects[at][1]
        elif not free:
            for i, (tag, around, named, _) in enumerate(self.suspects):
                most = 2 * held[i] > total if tag in ("form", "fieldset") else held[i] >= WRAPPED and 10 * held[i] >= 9 * total and (tag in ("nav", "header") or not self.ended[i])
                keep[i] = most and not named and (around < 0 or keep[around])
        kept = ([p[:5] for p in b if p[5] < 0 or keep[p[5]]] for b in self.blocks)
        self.blocks = [b for b in kept if b]

    def _measure(self) -> None:
        """Per node, of the whole text below it: characters, those in links, those in hinted elements, a hash that
        doesn't depend on order; and of its own text what it is worth to a score."""
        n = len(self.parent)
        self.chars, self.linked, self.hinted, self.hash, self.worth = [0] * n, [0] * n, [0] * n, [0] * n, [0.0] * n
        sized = [(node, len(" ".join(text.split())), link, mark, article, text, i) for i, b in enumerate(self.blocks) for node, text, link, mark, article in b]
        voided = self._misnamed(sized)
        for node, size, link, mark, _, text, _ in sized:
            if size:
                hinted = mark >= 0 and not voided[mark]
                self.chars[node] += size
                self.linked[node] += size * link
                self.hinted[node] += size * hinted
                self.hash[node] += xxhash.xxh64_intdigest(text)
                self.worth[node] += (-size if link else size) * (HINTED if hinted else 1)
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            self.chars[p] += self.chars[i]
            self.linked[p] += self.linked[i]
            self.hinted[p] += self.hinted[i]
            self.hash[p] += self.hash[i]

    def _misnamed(self, sized: list) -> list[bool]:
        """By hinting element, whether it holds the article all the same: it is around the page's main article, or
        it is a layout name with most of the page's text."""
        soft, articles = self.soft, self.articles
        out = [False] * len(soft)
        if not soft:
            return out
        area, held, free, total = [0] * len(articles), [0] * len(soft), [False] * len(soft), 0
        # By hinting element, its own text outside links and that of its longest block, less what is in links.
        own, most, linked, block, here = [0] * len(soft), [0] * len(soft), [0] * len(soft), -1, 0
        for _, size, link, mark, article, _, i in sized:
            worth = 0 if link else size
            total += worth
            if mark >= 0:
                block, here = i, worth + (here if i == block else 0)
                own[mark] += worth
                linked[mark] += size - worth
                most[mark] = max(most[mark], here)
            if article >= 0:
                area[article] += worth
            if mark >= 0:
                held[mark] += worth
                free[mark] = free[mark] or article < 0 and size > 0
        for i in range(len(articles) - 1, -1, -1):
            if articles[i][2] >= 0:
                area[articles[i][2]] += area[i]
        for i in range(len(soft) - 1, -1, -1):
            if soft[i][1] >= 0:
                held[soft[i][1]] += held[i]
                free[soft[i][1]] = free[soft[i][1]] or free[i]
        readers: list[bool] = []
        for names, around, _ in soft:
            readers.append(bool(names & READERS) or around >= 0 and readers[around])
        full = [i for i, x in enumerate(area) if x]
        # Where one stands in no hinting element, articles in others are teasers or comments.
        if full and all(articles[i][1] >= 0 for i in full):
            at = articles[max(full, key=lambda i: (not readers[articles[i][1]], articles[i][0], area[i]))][1]
            while at >= 0:
                out[at], at = True, soft[at][1]
        # Adverts, notices and comments may be longer than an article; layout outside of one isn't it.
        for i, (names, _, _) in enumerate(soft):
            out[i] = out[i] or 2 * held[i] > total and names <= LAYOUT and not (full and free[i])
        # Nor does a name alone say that a long part of an article with prose isn't its own.
        for i, (names, _, article) in enumerate(soft):
            out[i] = out[i] or article >= 0 and not readers[i] and own[i] >= max(SECTION, 2 * linked[i]) and most[i] >= PARAGRAPH
        # An element in a hinting one is hinted with it, so only whole chains are void.
        for i, (_, around, _) in enumerate(soft):
            out[i] = out[i] and (around < 0 or out[around])
        return out

    def path(self, node: int) -> str:
        steps = []
        while node > 0:
            steps.append(self.step[node])
            node = self.parent[node]
        return ">".join(reversed(steps))

    def scores(self) -> dict[int, float]:
        """Score per container: its own text outside links, and part of what lies up to three levels deeper."""
        total: dict[int, float] = defaultdict(float)
        for i, worth in enumerate(self.worth):
            share, at = max(0.0, worth), i
            for _ in range(4):
                if share <= 0 or at < 0:
                    break
                total[at] += share
                share, at = share * 0.6, self.parent[at]
        return {i: s * (1.5 if _tag(self.step[i]) in ("article", "main") else 1) for i, s in total.items()}

    def raised(self, node: int) -> int:
        """The container of the whole article whose best part is node: the outermost article or main around it, else
        the highest container below body up to which link lists and hinted parts add no more than a twentieth."""
        chain = [node]
        while self.parent[chain[-1]] > 0:
            chain.append(self.parent[chain[-1]])
        for x in ("article", "main"):
            for i in reversed(chain):
                if _tag(self.step[i]) == x:
                    return i
        kids: dict[int, list[int]] = defaultdict(list)
        above = set(chain)
        for i in range(1, len(self.parent)):
            if self.parent[i] in above:
                kids[self.parent[i]].append(i)
        now = branch = node
        for up in chain[1:]:
            if _tag(self.step[up]) == "body":
                break
            sides = [(self.chars[i], self.linked[i] + self.hinted[i]) for i in kids[up] if i != branch]
            own = self.chars[up] - sum(self.chars[i] for i in kids[up])
            alone = own and (own, self.linked[up] - sum(self.linked[i] for i in kids[up]))
            sides = [s for s in [*sides, alone or (0, 0)] if s[0]]
            if sum(n for n, m in sides if 3 * m > n) > 0.05 * self.chars[branch]:
                break
            if sides:
                now = up
            branch = up
        return now

    def vote(self) -> tuple[int, float]:
        """The node that the page votes for (-1: none), and its best part's score."""
        rated = self.scores()
        if not rated:
            return -1, 0.0
        most = max(rated.values())
        best = [i for i, s in rated.items() if s == most]
        best = min(best, key=self.path) if len(best) > 1 else best[0]
        return self.raised(best), most

    def below(self, node: int) -> list[int]:
        """The nodes with text below node."""
        inside = [False] * len(self.parent)
        out = []
        for i in range(1, len(self.parent)):
            p = self.parent[i]
            inside[i] = p == node or inside[p]
            if inside[i] and self.chars[i]:
                out.append(i)
        return out

    def _inside(self, key: int, skip: set[int]) -> tuple[list[bool], int]:
        """By node whether it is at or below the first with this path key, outside of skip; and that node, -1: none."""
        inside, found = [False] * len(self.parent), -1
        for i, k in enumerate(self.key):
            p = self.parent[i]
            if k == key and found < 0:
                inside[i], found = True, i
            else:
                inside[i] = p >= 0 and inside[p] and k not in skip
        return inside, found

    def worth_of(self, key: int, skip: set[int]) -> float:
        inside, _ = self._inside(key, skip)
        return sum(max(0.0, w) for w, x in zip(self.worth, inside, strict=True) if x)

    def text(self, key: int, skip: set[int]) -> str | None:
        """Text at and below the container with this path key, without what lies in containers of skip; None where
        the page has no such container or no text there."""
        inside, found = self._inside(key, skip)
        if found < 0 or not self.chars[found]:
            return None
        joined = (" ".join("".join(p[1] for p in b if inside[p[0]]).split()) for b in self.blocks)
        return "\n".join(t for t in joined if t)


@lru_cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


@lru_cache(1 << 14)
def _tag(step: str) -> str:
    return re.match(r"[^.!]*", step)[0]


def unlike(chars: int, hinted: int, whole: int) -> bool:
    """Whether a container below the winner is hinted at by most of its text and has no more than half of the
    article's: over the pages of a host, or on one page without a host."""
    return 2 * hinted > chars and 2 * chars <= whole


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without port and user; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(page: str, key: int | None, skip: set[int] = frozenset()) -> str:
    """Text of the container with this path key without the containers of skip; by the page's own vote if it has no
    text there, or hardly any beside what the page votes for."""
    read = Page(page)
    found = None if key is None else read.text(key, skip)
    if found is not None:
        # A page of another template may have little at the host's path, and its article elsewhere.
        node, _ = read.vote()
        if node < 0 or read.key[node] in skip or SHORT * read.worth_of(key, skip) >= read.worth_of(read.key[node], skip):
            return found
    return _own(read)


def _own(read: Page) -> str:
    """The text that a page by itself votes for."""
    node, _ = read.vote()
    if node < 0:
        return ""
    return read.text(read.key[node], {read.key[i] for i in read.below(node) if unlike(read.chars[i], read.hinted[i], read.chars[node])}) or ""


_SUBS = "array<struct<key:bigint,chars:bigint,hinted:bigint,hash:bigint>>"
_VOTE = f"host string, path string, key bigint, score bigint, chars bigint, hash bigint, subs {_SUBS}"


def votes(pages: DataFrame) -> DataFrame:
    """One row per page that has text: host, the path it votes for with its key, score, characters and hash of the
    text there, and the same of every container below."""
    sub = pa.struct([(c, pa.int64()) for c in ("key", "chars", "hinted", "hash")])
    schema = pa.schema([("host", pa.string()), ("path", pa.string()), *((c, pa.int64()) for c in ("key", "score", "chars", "hash")), ("subs", pa.list_(sub))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for host, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page = Page(text or "")
                node, score = page.vote()
                if node >= 0:
                    subs = [{"key": page.key[i], "chars": page.chars[i], "hinted": page.hinted[i], "hash": page.hash[i] & (2**63 - 1)} for i in page.below(node)]
                    rows.append((host, page.path(node), page.key[node], int(score), page.chars[node], page.hash[node] & (2**63 - 1), subs))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(7)], schema=schema)

    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, _VOTE)


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path, key, pages, skip: the container path that wins on most pages of the host, then by score, then by
    name; on how many pages any path won; and the keys of containers below it that aren't the article. Those are
    the ones that unlike() names over all pages that voted for the path, and those of at most a quarter of the
    text that say the same on at least REPEATS pages with different articles."""
    cast = written(votes(pages))
    # Scores are whole numbers, so that the order of rows can't matter.
    per_path = cast.groupBy("host", "path", "key").agg(F.count("*").alias("n"), F.sum("score").alias("s"))
    best = F.min(F.struct((-F.col("n")).alias("n"), (-F.col("s")).alias("s"), F.col("path").alias("path"), F.col("key").alias("key"))).alias("w")
    winners = per_path.groupBy("host").agg(best, F.sum("n").alias("pages")).select("host", F.col("w.path").alias("path"), F.col("w.key").alias("key"), "pages")
    subs = cast.select("host", "key", F.col("chars").alias("whole"), F.col("hash").alias("article"), F.explode("subs").alias("s"))
    # Equal parts of equal articles first, so that the distinct counts run over few rows a group.
    equal = subs.groupBy("host", "key", F.col("s.key").alias("sub"), F.col("s.hash").alias("said"), "article").agg(F.sum("s.chars").alias("chars"), F.sum("s.hinted").alias("hinted"), F.sum("whole").alias("whole"))
    shown = equal.groupBy("host", "key", "sub").agg(F.sum("chars").alias("chars"), F.sum("hinted").alias("hinted"), F.sum("whole").alias("whole"), F.count_distinct("said").alias("said"), F.count_distinct("article").alias("articles"))
    hinted = (2 * F.col("hinted") > F.col("chars")) & (2 * F.col("chars") <= F.col("whole"))
    repeated = (F.col("articles") >= REPEATS) & (2 * F.col("said") <= F.col("articles")) & (4 * F.col("chars") <= F.col("whole"))
    skip = shown.filter(hinted | repeated).groupBy("host", "key").agg(F.sort_array(F.collect_list("sub")).alias("skip"))
    return winners.join(skip, ["host", "key"], "left").select("host", "path", "key", "pages", F.coalesce("skip", F.array().cast("array<bigint>")).alias("skip"))


def extract_pages(pages: DataFrame, hot: int = 1000, salts: int = 64) -> DataFrame:
    """pages, every row and column kept, with text ('' if none) and n_chars (code points) added. Null html
    is empty; null or hostless urls share the host ''. Repeated rows vote and are extracted one by one. An empty
    table gives an empty one. The time for a page is linear in its length, whatever its markup.

    Hosts with more than one of hot pages, of which there are fewer than hot, are known to every task by a hash;
    their winners are there under each of salts, so their pages meet them in so many groups."""
    host, salt, key, skip, hot_at, text, n_chars, k1, k2 = (fresh(pages, c) for c in ("__host", "__salt", "__key", "__skip", "__hot", "text", "n_chars", "__k1", "__k2"))

    # Keys come as text: pandas has no 64-bit integers beside nulls.
    @F.pandas_udf("string")
    def again(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, keys, skips in batches:
            rows = zip(texts, keys, skips, strict=True)
            yield pd.Series([extract(t or "", None if k is None else int(k), set() if s is None else set(s)) for t, k, s in rows], dtype=object)

    winners = written(host_paths(pages))
    limit = (winners.agg(F.sum("pages")).first()[0] or 0) / hot
    frequent = winners.filter(F.col("pages") > limit).select(F.xxhash64("host").alias(hot_at)).distinct()
    is_hot = F.col(hot_at).isNotNull()
    spread = F.when(is_hot, F.pmod(F.xxhash64("url", "html"), F.lit(salts))).otherwise(F.lit(0)).cast("bigint")
    named = pages.withColumn(host, host_of(F.col("url"))).join(F.broadcast(frequent), F.xxhash64(F.col(host)) == F.col(hot_at), "left").withColumn(salt, spread).drop(hot_at)
    many = F.when(F.col("pages") > limit, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    sides = winners.select(F.col("host").alias(k1), F.col("key").cast("string").alias(key), F.col("skip").alias(skip), F.explode(many.cast("array<bigint>")).alias(k2))
    joined = named.join(sides, (F.col(host) == F.col(k1)) & (F.col(salt) == F.col(k2)), "left")
    return joined.withColumn(text, again("html", key, skip)).withColumn(n_chars, F.length(text).cast("bigint")).select(*pages.columns, text, n_chars)


def op8_extract_html(spark, sf_dir: str) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars. Null and empty html give '' and 0; repeated
    rows, null ids and null urls keep a row each; other columns of the table aren't read."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_pages(pages).select("page_id", "url", "text", "n_chars")
