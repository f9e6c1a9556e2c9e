"""Pages as trees: elements numbered in document order, so that the elements below one are a range of numbers.

``parsed`` makes one lenient parse (Arrow); a tree is a record of arrays by element (tag, id, classes, attributes,
number of the element above, last number below) and by piece of text (text, its element). Selectors and texts are
Column expressions over it: below is a comparison of numbers, directly below an equality.

A selector is made of names, ``*``, ``#id``, ``.class``, ``[attr]`` and ``[attr op "value"]`` (=, ^=, $=, *=, ~=), put
together by blanks (below) or ``>`` (directly below); commas part alternatives. Anything else raises ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.functions.model import once
from docketlake.functions.urls import resolve
from docketlake.shipping import ship_package
from docketlake.sources.html import only_references

TREE = "struct<tag:array<string>,id:array<string>,classes:array<string>,attributes:array<map<string,string>>,parent:array<int>,last:array<int>,text:array<string>,owner:array<int>>"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An element of the name ends open ones of these names.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
#: Elements whose text isn't shown.
UNSEEN = ("script", "style", "template")

#: Where titles and contents are looked for, and what is no content.
TITLES = ("h1", "title", ".title", ".document-title")
CONTENTS = ("main", "article", ".content", ".document-body", ".regulation-content")
PAGE_CONTENTS = ("main", "article", ".content", "#content", ".main-content", ".document-content", ".regulation-text")
NO_CONTENT, NO_PAGE_CONTENT = ("nav", "footer"), ("nav", "header", "footer", "aside")
BODY_CHARS = 5000


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[int] = []
        self.out: dict[str, list] = {k: [] for k in ("tag", "id", "classes", "attributes", "parent", "last", "text", "owner")}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        o = self.out
        while self.open and o["tag"][self.open[-1]] in ENDS.get(tag, ()):
            self._end()
        at = {k: v or "" for k, v in reversed(attrs)}
        n = len(o["tag"])
        for k, v in (("tag", tag), ("id", at.get("id")), ("classes", f" {' '.join(at.get('class', '').split())} "), ("attributes", at), ("parent", self.open[-1] if self.open else -1), ("last", n)):
            o[k].append(v)
        if tag not in VOID:
            self.open.append(n)

    def handle_endtag(self, tag: str) -> None:
        if any(self.out["tag"][n] == tag for n in self.open):
            while self._end() != tag:
                pass

    def _end(self) -> str:
        n = self.open.pop()
        self.out["last"][n] = len(self.out["tag"]) - 1
        return self.out["tag"][n]

    def handle_data(self, data: str) -> None:
        if self.open and data.strip():
            self.out["text"].append(data.strip())
            self.out["owner"].append(self.open[-1])


def parse_tree(html: str | None, references: tuple[str, ...] | None = None) -> dict[str, list]:
    """The tree of a page. An end tag that nothing opened is ignored; text outside all elements is left out."""
    tree = Tree()
    tree.feed(only_references(html, references))
    tree.close()
    while tree.open:
        tree._end()
    return tree.out


def parsed(pages: DataFrame, html: str = "html", to: str = "tree", references: tuple[str, ...] | None = None) -> DataFrame:
    """``pages`` with the tree of each page. ``references``: the character references to read (``only_references``)."""
    ship_package(pages.sparkSession)

    @F.pandas_udf(TREE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = list(parse_tree(""))
        for s in batches:
            yield pd.DataFrame([parse_tree(x, references) for x in s], columns=names)

    return pages.withColumn(to, run(html))


# selectors
STEP = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[#.][\w-]+|\[[^\]]*\])*)")
PART = re.compile(r"([#.])([\w-]+)|\[\s*([\w:-]+)\s*(?:([~^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\]]*))\s*)?\]")


def numbers(tree: Column) -> Column:
    """The numbers of all elements."""
    n = F.size(tree["tag"])
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def condition(tree: Column, step: str) -> Callable[[Column], Column]:
    """Whether an element meets one step of a selector."""
    m = STEP.fullmatch(step)
    if not step or not m:
        raise ValueError(f"not a selector: {step!r}")
    tests: list[Callable[[Column], Column]] = []
    if m[1] and m[1] != "*":
        tests.append(lambda i, name=m[1].lower(): F.get(tree["tag"], i) == name)
    for p in PART.finditer(m[2]):
        kind, word, name, op = p[1], p[2], p[3], p[4]
        if kind == "#":
            tests.append(lambda i, w=word: F.get(tree["id"], i) == w)
        elif kind == ".":
            tests.append(lambda i, w=word: F.get(tree["classes"], i).contains(f" {w} "))
        else:
            value = next((x for x in (p[5], p[6], p[7]) if x is not None), "")
            held = lambda i, k=name.lower(): F.try_element_at(F.get(tree["attributes"], i), F.lit(k))
            if op and not value and op != "=":
                tests.append(lambda i: F.lit(False))
                continue
            tests.append({
                None: lambda i, h=held: h(i).isNotNull(), "=": lambda i, h=held, v=value: h(i) == v, "^=": lambda i, h=held, v=value: h(i).startswith(v), "$=": lambda i, h=held, v=value: h(i).endswith(v),
                "*=": lambda i, h=held, v=value: h(i).contains(v), "~=": lambda i, h=held, v=value: F.array_contains(F.split(h(i), r"\s+"), v),
            }[op])
    return lambda i: F.coalesce(reduce(lambda a, b: a & b, [t(i) for t in tests], F.lit(True)), F.lit(False))


def select(tree: Column, selector: str, within: Column | None = None) -> Column:
    """Numbers of the elements that a selector matches, in document order; below an element if ``within`` is given."""
    kinds = [_chain(tree, alternative) for alternative in _parted(selector)]
    out = kinds[0] if len(kinds) == 1 else F.array_sort(F.array_distinct(F.concat(*kinds)))
    return out if within is None else F.filter(out, lambda i: (i > within) & (i <= F.get(tree["last"], within)))


def _parted(selector: str) -> list[str]:
    return [x.strip() for x in re.split(r",(?![^\[]*\])", selector)]


def _steps(selector: str) -> list[tuple[str, str]]:
    """(how it follows on the one before, step) of each step."""
    out, by, rest = [], " ", selector.strip()
    while m := re.match(r"((?:[^\s>\[]|\[[^\]]*\])+)(\s*>\s*|\s+)?", rest):
        out.append((by, m[1]))
        by, rest = ">" if ">" in (m[2] or "") else " ", rest[m.end() :]
        if not m[2]:
            break
    if not out or rest or m is None:
        raise ValueError(f"not a selector: {selector!r}")
    return out


def _chain(tree: Column, selector: str) -> Column:
    steps = _steps(selector)
    found = None
    for by, step in steps:
        own = F.filter(numbers(tree), condition(tree, step))
        found = own if found is None else once(found, (_directly_below if by == ">" else _below)(tree, own))
    return found


def _directly_below(tree: Column, own: Column) -> Callable[[Column], Column]:
    return lambda up: F.filter(own, lambda i: F.array_contains(up, F.get(tree["parent"], i)))


def _below(tree: Column, own: Column) -> Callable[[Column], Column]:
    return lambda up: F.filter(own, lambda i: F.exists(up, lambda u: (u < i) & (i <= F.get(tree["last"], u))))


def first(tree: Column, *selectors: str) -> Column:
    """The first element of the first selector that matches any; null if none does."""
    return F.coalesce(*[F.get(select(tree, s), 0) for s in selectors])


def text(tree: Column, element: Column, sep: str = " ", without: tuple[str, ...] = ()) -> Column:
    """The element's pieces of text, as they are shown, without what stands in elements of the given names; '' for null."""
    n = F.size(tree["text"])
    pieces = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def of(e: Column) -> Column:
        unseen = F.filter(numbers(tree), lambda i: (i >= e) & (i <= F.get(tree["last"], e)) & F.get(tree["tag"], i).isin(*UNSEEN, *without) & (i != e))
        shown = once(unseen, lambda u: F.filter(pieces, lambda k: once(F.get(tree["owner"], k), lambda o: (o >= e) & (o <= F.get(tree["last"], e)) & ~F.exists(u, lambda x: (o >= x) & (o <= F.get(tree["last"], x))))))
        return F.array_join(F.transform(shown, lambda k: F.get(tree["text"], k)), sep)

    return F.coalesce(F.when(element.isNotNull(), once(element, of)), F.lit(""))


def attribute(tree: Column, element: Column, name: str) -> Column:
    return F.try_element_at(F.get(tree["attributes"], element), F.lit(name))


def title(tree: Column, selectors: tuple[str, ...] = TITLES) -> Column:
    """The first filled one of the selectors' first elements, else the page's title, else empty."""
    whole = [F.nullif(text(tree, F.get(select(tree, s), 0), " "), F.lit("")) for s in dict.fromkeys([*selectors, "title"])]
    return F.coalesce(*whole, F.lit(""))


def main_content(tree: Column, selectors: tuple[str, ...] = CONTENTS) -> Column:
    """The first content without navigation and footers, else the beginning of the body without them."""
    found = first(tree, *selectors)
    return F.when(found.isNotNull(), text(tree, found, " ", NO_CONTENT)).otherwise(F.left(text(tree, first(tree, "body"), " ", NO_CONTENT), F.lit(BODY_CHARS)))


def page_content(tree: Column, content: str | None = None, selectors: tuple[str, ...] = PAGE_CONTENTS) -> Column:
    """By an own selector, else the first content, else the body without what stands around it, else all; by lines."""
    found = first(tree, *([content] if content else []), *selectors)
    body = first(tree, "body")
    return F.when(found.isNotNull(), text(tree, found, "\n")).when(body.isNotNull(), text(tree, body, "\n", NO_PAGE_CONTENT)).otherwise(text(tree, F.when(F.size(tree["tag"]) > 0, F.lit(0)), "\n"))


def items(tree: Column, elements: Column, url: Column, limit: int = 20) -> Column:
    """(title, url) of the first elements that have a text, and an address of their own or of their first link."""

    def item(i: Column) -> Column:
        link = F.get(F.filter(numbers(tree), lambda j: (j > i) & (j <= F.get(tree["last"], i)) & (F.get(tree["tag"], j) == "a") & attribute(tree, j, "href").isNotNull()), 0)
        href = F.coalesce(F.nullif(attribute(tree, i, "href"), F.lit("")), attribute(tree, link, "href"))
        return F.struct(text(tree, i, "").alias("title"), F.when(href.startswith("/"), resolve(url, href)).otherwise(href).alias("url"))

    return F.filter(F.transform(F.slice(elements, 1, limit), item), lambda x: (x["title"] != "") & (F.coalesce(x["url"], F.lit("")) != ""))
