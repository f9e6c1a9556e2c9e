"""One lenient parse of each page into a record; every page operator is a projection of it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.shipping import ship_package

RECORD = (
    "struct<title:string,lang:string,headings:array<struct<level:int,text:string>>,links:array<struct<href:string,text:string>>,"
    "meta:map<string,string>,tags:map<string,int>,classes:map<string,int>,paragraphs:array<string>,items:array<string>,"
    "tables:array<array<array<string>>>,terms:array<struct<term:string,text:string>>,main_text:string,body_text:string,"
    "images:int,images_with_alt:int,aria:int,inline_script_chars:int,script_sources:array<string>,depth:int,"
    "marked:array<struct<tag:string,classes:string>>,attributes:map<string,int>,ids:array<string>,inputs:array<struct<type:string,name:string>>,search_forms:int,"
    "rels:array<string>,script_types:array<string>,grids:array<struct<rows:int,heads:int,parted:boolean,nested:boolean>>,flow:array<struct<tag:string,text:string>>,"
    "blocks:array<struct<tag:string,classes:string,id:string,heading:string,text:string,links:array<struct<href:string,text:string>>>>,linked_items:int>"
)
BLOCKS = {"section", "article", "main", "nav", "header", "footer", "aside"}
#: Elements of other names whose class or id holds one of these are blocks too.
BLOCK_WORDS = ("section", "article", "part", "chapter", "abstract", "summary", "overview", "appendix", "annex", "schedule", "ref", "citation", "metadata", "info", "content", "document-body", "breadcrumb", "title")
FLOW = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "div", "section"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "noscript", "template"}
CHROME = {"nav", "footer"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MAIN, HEADINGS = ("main", "article"), {"h1", "h2", "h3", "h4", "h5", "h6"}
BODY_CHARS = 5000


class Page(HTMLParser):
    """Keeps a stack of open elements; an end tag that nothing opened is ignored, what it skips is closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.tags, self.classes, self.meta = Counter(), Counter(), {}
        self.headings, self.links, self.paragraphs, self.items, self.terms = [], [], [], [], []
        self.tables: list[list[list[str]]] = []
        self.open: list[tuple[str, int, list[str], dict]] = []  # elements whose text is wanted
        self.main, self.body, self.title = [], [], None
        self.lang, self.images, self.alts, self.aria, self.script, self.sources, self.depth = None, 0, 0, 0, 0, [], 0
        self.marked, self.attributes, self.ids, self.inputs, self.rels, self.script_types = [], Counter(), [], [], [], []
        self.search_forms, self.grids, self.flow, self.blocks, self.linked_items = 0, [], [], [], 0
        self.forms: list[int] = []  # open forms: depth of each, negative once "search" was met
        self.tables_open: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = {k: v or "" for k, v in attrs}
        while self.stack and self.stack[-1] in CLOSES.get(tag, ()):
            self._close(self.stack[-1])
        self.tags[tag] += 1
        self.classes.update(at.get("class", "").lower().split())
        self.aria += any(k.startswith("aria-") for k in at)
        self.attributes.update(at.keys())
        self.attributes.update(f"{k}={at[k].lower()}" for k in ("loading", "id") if at.get(k))
        if at.get("class"):
            self.marked.append({"tag": tag, "classes": at["class"].lower()})
        if at.get("id"):
            self.ids.append(at["id"])
        if tag == "input":
            self.inputs.append({"type": at.get("type", "").lower(), "name": at.get("name", "").lower()})
        elif tag == "link":
            self.rels.append(at.get("rel", "").lower())
        elif tag == "script":
            self.script_types.append(at.get("type", "").lower())
        elif tag == "form":
            self.forms.append(0)
        if self.forms and "search" in (self.get_starttag_text() or "").lower():
            self.forms[-1] = 1
        if self.tables_open:
            grid = self.tables_open[-1]
            grid["rows"] += tag == "tr"
            grid["heads"] += tag == "th"
            grid["parts"] |= {tag} & {"thead", "tbody"}
            grid["nested"] |= tag == "table"
        if tag == "html":
            self.lang = at.get("lang") or self.lang
        elif tag == "meta":
            if (name := at.get("name") or at.get("property") or at.get("http-equiv")) and "content" in at:
                self.meta.setdefault(name, at["content"])
        elif tag == "img":
            self.images, self.alts = self.images + 1, self.alts + bool(at.get("alt"))
        elif tag == "script" and at.get("src"):
            self.sources.append(at["src"])
        elif tag == "table":
            self.tables.append([])
            self.tables_open.append({"rows": 0, "heads": 0, "parts": set(), "nested": False})
            self.grids.append(self.tables_open[-1])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        if tag in VOID:
            return
        self.stack.append(tag)
        self.depth = max(self.depth, len(self.stack))
        if tag in {"title", "a", "p", "li", "dt", "dd", "td", "th"} | HEADINGS:
            self.open.append((tag, len(self.stack), [], at))
        names = f"{at.get('class', '')} {at.get('id', '')}".lower()
        if tag in BLOCKS or names.strip() and any(w in names for w in BLOCK_WORDS):
            self.open.append(("block", len(self.stack), [], {"tag": tag, "classes": at.get("class", "").lower(), "id": at.get("id"), "heading": None, "links": []}))
        if tag in FLOW:
            self.open.append(("flow", len(self.stack), [], {"tag": tag, "at": len(self.flow)}))
            self.flow.append({"tag": tag, "text": ""})

    def handle_endtag(self, tag: str) -> None:
        if tag in self.stack:
            while self._close(self.stack[-1]) != tag:
                pass

    def _close(self, tag: str) -> str:
        depth = len(self.stack)
        self.stack.pop()
        while self.open and self.open[-1][1] == depth:
            name, _, parts, at = self.open.pop()
            self._take(name, " ".join((" " if name == "block" else "").join(parts).split()), at)
        if tag == "table" and self.tables_open:
            self.tables_open.pop()
        elif tag == "form" and self.forms:
            self.search_forms += self.forms.pop()
        return tag

    def _take(self, name: str, text: str, at: dict) -> None:
        if name == "title":
            self.title = self.title or text
        elif name == "block":
            self.blocks.append({"tag": at["tag"], "classes": at["classes"], "id": at["id"], "heading": at["heading"], "text": text, "links": at["links"]})
        elif name == "flow":
            self.flow[at["at"]]["text"] = text
        elif name in HEADINGS:
            self.headings.append({"level": int(name[1]), "text": text})
            for kind, _, _, block in self.open:
                if kind == "block":
                    block["heading"] = block["heading"] or text
        elif name == "a":
            self.linked_items += "li" in self.stack
            if at.get("href"):
                self.links.append({"href": at["href"], "text": text})
                for kind, _, _, block in self.open:
                    if kind == "block":
                        block["links"].append(self.links[-1])
        elif name == "p":
            self.paragraphs.append(text)
        elif name == "li":
            self.items.append(text)
        elif name == "dt":
            self.terms.append({"term": text, "text": ""})
        elif name == "dd":
            if self.terms and not self.terms[-1]["text"]:
                self.terms[-1]["text"] = text
        elif self.tables and self.tables[-1]:
            self.tables[-1][-1].append(text)

    def handle_data(self, data: str) -> None:
        if "script" in self.stack:
            self.script += len(data)
        if self.forms and "search" in data.lower():
            self.forms[-1] = 1
        for _, _, parts, _ in self.open:
            parts.append(data)
        if HIDDEN.isdisjoint(self.stack) and "title" not in self.stack and CHROME.isdisjoint(self.stack):
            self.body.append(data)
            if any(m in self.stack for m in MAIN):
                self.main.append(data)

    def record(self) -> dict:
        while self.stack:
            self._close(self.stack[-1])
        for grid in self.grids:
            grid["parted"] = len(grid.pop("parts")) == 2
        body = " ".join(" ".join(self.body).split())
        main = " ".join(" ".join(self.main).split())
        return {
            "title": self.title, "lang": self.lang, "headings": self.headings, "links": self.links, "meta": self.meta, "tags": dict(self.tags), "classes": dict(self.classes),
            "paragraphs": self.paragraphs, "items": self.items, "tables": self.tables, "terms": self.terms, "main_text": main or body[:BODY_CHARS], "body_text": body,
            "images": self.images, "images_with_alt": self.alts, "aria": self.aria, "inline_script_chars": self.script, "script_sources": self.sources, "depth": self.depth,
            "marked": self.marked, "attributes": dict(self.attributes), "ids": self.ids, "inputs": self.inputs, "search_forms": self.search_forms, "rels": self.rels, "script_types": self.script_types,
            "grids": self.grids, "flow": self.flow, "blocks": self.blocks, "linked_items": self.linked_items,
        }


def only_references(html: str | None, names: tuple[str, ...] | None) -> str:
    """``html`` in which a parse finds the named character references alone, each closed by a semicolon; None: all that
    HTML knows, closed or not. Scripts and styles have none."""
    if names is None or not html:
        return html or ""
    return re.sub(rf"(?is)<(script|style)\b.*?</\1\b|&(?!(?:{'|'.join(names)});)", lambda m: m[0] if m[1] else "&amp;", html)


def parse_page(html: str | None, references: tuple[str, ...] | None = None) -> dict:
    page = Page()
    page.feed(only_references(html, references))
    page.close()
    return page.record()


def parsed(pages: DataFrame, html: str = "html", to: str = "page", fields: list[str] | None = None, references: tuple[str, ...] | None = None) -> DataFrame:
    """``pages`` with the record of each page, or the named fields of it; Arrow batches, one parse. ``references``: see
    ``only_references``."""
    ship_package(pages.sparkSession)
    every = T.StructType.fromDDL(RECORD.removeprefix("struct<").removesuffix(">"))
    names = [f.name for f in every.fields if fields is None or f.name in fields]

    @F.pandas_udf(T.StructType([every[n] for n in names]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            records = [parse_page(x, references) for x in s]
            yield pd.DataFrame({n: pd.Series([r[n] for r in records], dtype=object) for n in names})

    return pages.withColumn(to, run(html))


def tag(page: Column, *names: str) -> Column:
    """How many elements of these names."""
    return sum((F.coalesce(F.try_element_at(page["tags"], F.lit(n)), F.lit(0)) for n in names[1:]), F.coalesce(F.try_element_at(page["tags"], F.lit(names[0])), F.lit(0)))


def title(page: Column) -> Column:
    """h1 ▸ title ▸ a default."""
    h1 = F.get(F.filter(page["headings"], lambda h: (h["level"] == 1) & (h["text"] != "")), 0)["text"]
    return F.coalesce(h1, F.nullif(page["title"], F.lit("")), F.lit("No title found"))


def language(page: Column) -> Column:
    """Primary subtag of html@lang ▸ meta language ▸ en."""
    return F.lower(F.split_part(F.coalesce(page["lang"], F.try_element_at(page["meta"], F.lit("language")), F.lit("en")), F.lit("-"), F.lit(1)))


def headings_in_order(page: Column, least: int = 2) -> Column:
    """Enough headings, the first at most level 2, and no step down of more than two levels."""
    levels = F.transform(page["headings"], lambda h: h["level"])
    jumps = F.zip_with(F.slice(levels, 2, F.greatest(F.size(levels) - 1, F.lit(0))), F.slice(levels, 1, F.greatest(F.size(levels) - 1, F.lit(0))), lambda a, b: a - b)
    return (F.size(levels) >= least) & (F.get(levels, 0) <= 2) & ~F.exists(jumps, lambda d: d > 2)


def structure(page: Column) -> Column:
    """Counts that the structure scores read."""
    return F.struct(*(tag(page, *names).alias(key) for key, names in {"sections": ("section", "article"), "headings": ("h1", "h2", "h3", "h4", "h5", "h6"), "paragraphs": ("p",), "lists": ("ul", "ol", "dl"), "tables": ("table",), "forms": ("form",), "inputs": ("input", "select", "textarea"), "navs": ("nav",), "scripts": ("script",)}.items()), F.size(page["links"]).alias("links"))


def document_links(page: Column, limit: int = 20) -> Column:
    return F.slice(F.filter(page["links"], lambda x: F.lower(x["href"]).rlike(r"\.(pdf|docx?|xml|txt)")), 1, limit)
