"""Main text of web pages by composite text density.

A page is read into a whole tree of elements, without what is never read as
text (scripts, buttons and the like). Then what its tag or role marks as no
main text (navigation, asides) is left out, unless it is a wrapper that holds
the page's main element or one of its larger articles. Each element that is
left has a density: its characters for each tag, adjusted by how much of it is
link text compared with the whole body. The element whose children's densities
sum highest is the target; the least density on its path to the body is the
threshold. From the body down, in each element as dense as that, the subtree
with the highest sum is main text. In these subtrees, what names mark (notices,
forms, comments) goes too, as dense as it may be, but for wrappers: also those
that hold most of the body's text outside links. What is marked inside a
wrapper is looked at by itself. All steps take time linear in the page.

Null and empty pages give an empty text; repeated rows give equal texts. A
page that ends within a tag, comment or element is read as if it were closed.
Very long and very deep pages are read whole. Of subtrees with equal sums the
first counts. An empty table gives no row. Other columns stay; ``out_col``
replaces a column of its name.
"""

from __future__ import annotations

import html
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import python_workers

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
# Elements that are never text; elements, roles, and words of class and id that mark what is not main text.
NO_TEXT = frozenset("head script style noscript template button select input textarea iframe object svg canvas title".split())
ASIDE = frozenset("nav footer aside dialog menu search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr "
    "masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion related respond share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar widget".split())
CORE = frozenset("main article".split())
#: Names that say what an element has, or has not, rather than what it is: with-sidebar, no-sidebar, ad-free.
_HAS = re.compile(r"(?<![a-z])(?:(?:no|non|not|without|with|has|have)[-_]+[a-z]+|[a-z]+[-_]+free)(?![a-z])")
#: Share of the body's text outside links over which a form, or what a name marks, is a wrapper.
MOST = 0.5
#: Share of the longest article's text outside links from which an article makes what holds it a wrapper.
ARTICLE = 0.1
_ENDS_P = BLOCK - {"br", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "body", "html", "head", "title", "legend"}
#: Elements that a start tag of the same group ends, if open within the container.
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
             "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
             "option": ({"option"}, {"select", "datalist"})}

_MARKUP = re.compile(
    r"""<!--(?:.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))""", re.DOTALL)
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z]+")


#: How an element is marked: not at all, by its tag or role, by a name or as a form.
PLAIN, BY_TAG, BY_NAME = range(3)


def _marked(tag: str, attributes: str, inside_article: bool) -> tuple[int, str]:
    """How the element is marked, and main or article if it is one that no name marks."""
    if tag in ("html", "body"):
        return PLAIN, ""
    core, mark = tag if tag in CORE else "", BY_NAME if tag == "form" else PLAIN
    if tag in ASIDE or tag == "header" and not inside_article:
        mark = BY_TAG
    if "=" in attributes:
        for name, *values in _NAMED.findall(attributes):
            value = html.unescape("".join(values)).lower()
            if name.lower() == "role":
                value = value.strip()
                core = value if value in CORE else core
                mark = mark or (BY_TAG if value in ASIDE_ROLES else BY_NAME if value == "form" else PLAIN)
            elif name.lower() in ("class", "id") and not ASIDE_WORDS.isdisjoint(_SPLIT.split(_HAS.sub(" ", value))):
                mark = mark or BY_NAME
    if tag in CORE:
        return PLAIN, "" if mark else core
    return mark, core


class Page:
    """The elements of a page in page order, and its pieces of text."""

    def __init__(self, source: str):
        self.tag, self.parent, self.last = ["#page"], [-1], [0]  # last: the last element of the subtree
        self.events: list[tuple[int, str | None]] = []  # (element, text), or (element, None) where a block begins or ends
        self.marks, self.cores = [PLAIN], [""]
        self._read(source)
        self.inside = [True] * len(self.tag)

    def _read(self, source: str) -> None:
        open_, at, size = [0], 0, len(source)
        out_of, search = 0, _MARKUP.search  # out_of: depth in open_ at which what is never text began
        article = 0

        def close(depth: int) -> None:
            nonlocal out_of, article
            while len(open_) > depth:
                e = open_.pop()
                if out_of and len(open_) < out_of:
                    out_of = 0
                if e >= 0:
                    self.last[e] = len(self.tag) - 1
                    article -= self.tag[e] in ("article", "main")
                    if self.tag[e] in BLOCK:
                        self.events.append((e, None))

        names, depths = ["#page"], {}  # of open_, and by name where in it

        def opened(name: str) -> None:
            depths.setdefault(name, []).append(len(names))
            names.append(name)

        def cut(depth: int) -> None:
            close(depth)
            while len(names) > depth:
                depths[names.pop()].pop()

        def find(wanted, within=()) -> int:
            """The innermost open element of a wanted name, if none of the others stands within it."""
            deepest = lambda of: max((d[-1] for n in of if (d := depths.get(n))), default=0)
            d = deepest(wanted)
            return d if d >= deepest(within) else 0

        while at < size:
            m = search(source, at)
            if (m.start() if m else size) > at and not out_of:
                self.events.append((open_[-1], html.unescape(source[at:m.start() if m else size])))
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if d := find((tag,)):
                    cut(d)
                continue
            if tag in _ENDS_P and (d := find(("p",), ("table", "td", "th", "button", "object"))):
                cut(d)
            if tag in _SIBLINGS and (d := find(*_SIBLINGS[tag])):
                while d > 1 and names[d - 1] in _SIBLINGS[tag][0]:
                    d -= 1
                cut(d)
            raw_end = None
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(source, at)
                raw_end = end.start() if end else size
            if tag in VOID:
                if not out_of:
                    self.tag.append(tag), self.parent.append(open_[-1]), self.last.append(len(self.tag) - 1)
                    self.marks.append(PLAIN), self.cores.append("")
                    if tag in BLOCK:
                        self.events.append((open_[-1], None))
                continue
            if out_of or tag in NO_TEXT or raw_end is not None:
                if not out_of and tag in BLOCK:
                    self.events.append((open_[-1], None))
                opened(tag), open_.append(-1)
                out_of = out_of or len(open_) - 0
                at = at if raw_end is None else raw_end
                continue
            mark, core = _marked(tag, m[3], article > 0)
            self.marks.append(mark), self.cores.append(core)
            self.tag.append(tag), self.parent.append(open_[-1]), self.last.append(len(self.tag) - 1)
            open_.append(len(self.tag) - 1), opened(tag)
            article += tag in ("article", "main")
            if tag in BLOCK:
                self.events.append((open_[-1], None))
        close(1)
        self.last[0] = len(self.tag) - 1

    def _linked(self) -> list[bool]:
        linked = [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            linked[e] = self.tag[e] == "a" or linked[self.parent[e]]
        return linked

    def _leave_out(self, by_name: bool) -> None:
        """Takes out what is marked, by tag or role or else by a name, but for wrappers."""
        marked = [bool(m) and (m == BY_NAME) == by_name for m in self.marks]
        if by_name and not any(marked):
            return
        n, linked = len(self.tag), self._linked()
        free, chars = [0] * n, [0] * n  # characters outside links, and in all
        for e, text in self.events:
            if text is not None and (length := len(" ".join(text.split()))):
                chars[e] += length
                free[e] += 0 if linked[e] else length
        for e in range(n - 1, 0, -1):
            free[self.parent[e]] += free[e]
            chars[self.parent[e]] += chars[e]
        if not by_name:
            self.most = MOST * free[self.body()]  # of the whole page
        longest = {c: max((free[e] for e in range(n) if self.cores[e] == c), default=0) for c in CORE}
        holds = [bool(c) and chars[e] > 0 and free[e] >= ARTICLE * longest[c] for e, c in enumerate(self.cores)]
        for e in range(n - 1, 0, -1):
            holds[self.parent[e]] |= holds[e]
        # new: the element's number among those left; events of an element taken out: where its parent's text is broken
        new, left, e = [-1] * n, [], 0
        while e < n:
            if marked[e] and not holds[e] and not (by_name and free[e] > self.most):
                e = self.last[e] + 1
                continue
            new[e] = len(left)
            left.append(e)
            e += 1
        events = []
        for e, text in self.events:
            if new[e] >= 0:
                events.append((new[e], text))
            elif text is None and self.tag[e] in BLOCK and new[self.parent[e]] >= 0:
                events.append((new[self.parent[e]], None))
        count = [0] * (n + 1)  # elements left among the first
        for e in range(n):
            count[e + 1] = count[e] + (new[e] >= 0)
        self.last = [count[self.last[e] + 1] - 1 for e in left]
        self.parent = [new[self.parent[e]] if e else -1 for e in left]
        self.tag, self.events = [self.tag[e] for e in left], events
        self.marks, self.cores, self.inside = ([x[e] for e in left] for x in (self.marks, self.cores, self.inside))

    def densities(self) -> tuple[list[float], list[float]]:
        """Composite text density of each element, and the sum of its children's."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        linked = self._linked()
        for e, text in self.events:
            if text is not None and (length := len(" ".join(text.split()))):
                chars[e] += length
                if linked[e]:
                    link_chars[e] += length
        for e in range(n - 1, 0, -1):
            p = self.parent[e]
            chars[p] += chars[e]
            link_chars[p] += link_chars[e]
            tags[p] += tags[e] + 1
            link_tags[p] += link_tags[e] + (self.tag[e] == "a")
        body = self.body()
        ratio = link_chars[body] / max(1, chars[body])
        density, sums = [0.0] * n, [0.0] * n
        for e in range(n - 1, -1, -1):
            c, t, lc, lt = chars[e], max(1, tags[e]), link_chars[e], max(1, link_tags[e])
            if c:
                base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
                # a base just over 1 (no links at all) would divide by nothing; a lone character still weighs something
                density[e] = c / t * max(1e-3, math.log(c / max(1, lc) * t / lt) / max(1e-3, math.log(base)))
            if e:
                sums[self.parent[e]] += density[e]
        return density, sums

    def body(self) -> int:
        return next((e for e, t in enumerate(self.tag) if t == "body"), 0)

    def main(self) -> list[tuple[int, int]]:
        """Ranges of elements, first and last, that are main text."""
        density, sums = self.densities()
        body = self.body()

        # only elements that hold blocks can be main text: in a paragraph, marked-up words are no subtree of their own
        holds = [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            holds[self.parent[e]] |= self.tag[e] in BLOCK and self.tag[e] not in VOID

        # of each subtree the best that holds blocks, from the leaves up; without one the subtree itself
        best = [e if holds[e] else -1 for e in range(len(self.tag))]
        for e in range(len(self.tag) - 1, 0, -1):
            p, own = self.parent[e], best[e]
            if own >= 0 and (best[p] < 0 or (sums[own], -own) > (sums[best[p]], -best[p])):
                best[p] = own
        best = [e if own < 0 else own for e, own in enumerate(best)]
        target = best[body]
        threshold, e = density[target], target
        while e != body and e > 0:
            e = self.parent[e]
            threshold = min(threshold, density[e])
        out, e = [], body
        while e <= self.last[body]:
            if density[e] >= threshold > 0 and density[top := best[e]] > 0:
                # what stands before the best subtree, inside this element, is looked at by itself
                if not out or out[-1][0] != top:
                    out.append((top, self.last[top]))
                e = self.last[top] + 1 if top == e else e + 1
                while out and e <= out[-1][1] and e >= out[-1][0]:
                    e = out[-1][1] + 1
            else:
                e += 1
        return out

    def text(self) -> str:
        self._leave_out(by_name=False)
        self.inside = [False] * len(self.tag)
        for a, b in self.main():
            self.inside[a:b + 1] = [True] * (b - a + 1)
        # inside the main subtrees, what a name marks and density does not part from the article
        self._leave_out(by_name=True)
        inside, blocks, part = self.inside, [], []
        for e, text in self.events:
            if text is None:
                if part:
                    blocks.append(" ".join("".join(part).split()))
                    part = []
            elif inside[e]:
                part.append(text)
        blocks.append(" ".join("".join(part).split()))
        return " ".join(b for b in blocks if b)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def with_text(pages: DataFrame, out_col: str, html_col: str = "html") -> DataFrame:
    """``pages`` with the main text of each page."""
    python_workers(pages.sparkSession)

    @F.pandas_udf("string")
    def run(sources: pd.Series) -> pd.Series:
        return pd.Series([main_text(s) for s in sources], dtype=object)

    return pages.withColumn(out_col, run(F.col(f"`{html_col}`")))
