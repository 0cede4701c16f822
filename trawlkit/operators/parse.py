"""One parse per page: flattened text, title, description, anchors and coded addresses.

The walk is iterative and keeps only the open elements, so nesting of any depth
costs no recursion. Defined cases: null html is an empty page; unclosed elements
end with their parents, stray end tags are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame

from trawlkit.functions import rules
from trawlkit.operators.batches import frugal

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FOOTER, _NAV = re.compile("footer", re.I), re.compile(r"\b(?:header|menu|nav)", re.I)

PARSED = (
    "text string, title string, description string, noscript array<string>, "
    "anchors array<struct<seq:int,href:string,resolved:string,text:string,in_footer:boolean,in_nav:boolean>>, "
    "cfemails array<struct<seq:int,hex:string,from_href:boolean,in_footer:boolean>>"
)
_ANCHOR = pa.struct([("seq", pa.int32()), ("href", pa.string()), ("resolved", pa.string()), ("text", pa.string()), ("in_footer", pa.bool_()), ("in_nav", pa.bool_())])
_CODED = pa.struct([("seq", pa.int32()), ("hex", pa.string()), ("from_href", pa.bool_()), ("in_footer", pa.bool_())])
#: The columns of PARSED as Arrow has them.
_ARROW = {"text": pa.string(), "title": pa.string(), "description": pa.string(), "noscript": pa.list_(pa.string()), "anchors": pa.list_(_ANCHOR), "cfemails": pa.list_(_CODED)}


class _Walker(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base = base
        #: open elements: (tag, footer, nav, silent) for what is inside them
        self.open: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]
        self.depth: dict[str, int] = {}
        self.parts: list[str] = []
        self.anchors: list[dict] = []
        self.inside: list[tuple[int, dict, list[str]]] = []  # (depth, anchor, its texts)
        self.noscripts: list[list[str]] = []
        self.coded: list[tuple[str, bool]] = []
        self.titles: list[str] | None = None
        self.title: str | None = None
        self.meta: dict[str, str] = {}

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}
        _, footer, nav, silent = self.open[-1]
        if not silent and tag == "br":
            self.parts.append("\n")
        elif not silent and tag in rules.BLOCK_TAGS:
            self.parts.append("\n")
        if "data-cfemail" in a:
            self.coded.append((a["data-cfemail"], footer))
        if tag == "meta" and a.get("content"):
            if a.get("name", "").lower() == "description":
                self.meta.setdefault("description", a["content"])
            if a.get("property") in ("og:title", "og:description"):
                self.meta.setdefault(a["property"], a["content"])
        if tag == "a" and "href" in a and a["href"].strip():
            href = a["href"].strip()
            resolved = None
            if not href.lower().startswith(rules.NON_PAGE):
                try:
                    resolved = urljoin(self.base, href)
                except ValueError:
                    pass
            row = {"seq": len(self.anchors), "href": href, "resolved": resolved, "text": "", "in_footer": footer, "in_nav": nav}
            self.anchors.append(row)
            self.inside.append((len(self.open), row, []))
        if tag in _VOID:
            return
        marks = f"{' '.join(a.get('class', '').split())} {a.get('id', '')}"
        self.open.append((tag, footer or tag == "footer" or bool(_FOOTER.search(marks)), nav or tag in ("nav", "header") or bool(_NAV.search(marks)), silent or tag in rules.SILENT_TAGS))
        self.depth[tag] = self.depth.get(tag, 0) + 1
        if tag == "title" and self.title is None and self.titles is None:
            self.titles = []
        if tag == "noscript":
            self.noscripts.append([])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        while self.depth.get(tag):
            name, *_ = self.open.pop()
            self.depth[name] -= 1
            self._closed(name)
            if name == tag:
                break

    def _closed(self, name: str):
        if name in rules.BLOCK_TAGS and not self.open[-1][3]:
            self.parts.append("\n")
        if name == "title" and self.titles is not None:
            self.title, self.titles = "".join(self.titles), None
        while self.inside and self.inside[-1][0] >= len(self.open):
            _, row, texts = self.inside.pop()
            row["text"] = " ".join(texts)[:200]

    def handle_data(self, data):
        tag, _, _, silent = self.open[-1]
        if not silent:
            self.parts.append(data)
        if self.titles is not None:
            self.titles.append(data)
        if data.strip():
            if tag not in ("script", "style", "template"):
                for _, _, texts in self.inside:
                    texts.append(data.strip())
            if self.depth.get("noscript"):
                self.noscripts[-1].append(data.strip())

    def finish(self) -> None:
        self.close()
        while len(self.open) > 1:
            self._closed(self.open.pop()[0])


def _clean(value: str | None) -> str | None:
    return " ".join(value.split())[:1000] or None if value else None


def squeezed(text: str) -> str:
    text = re.sub(r"[ \t\xa0]+", " ", text)
    return re.sub(r"\n{2,}", "\n", re.sub(r" ?\n ?", "\n", text)).strip()


def parse_page(url: str | None, html: str | None) -> dict:
    w = _Walker(url or "")
    w.feed(html or "")
    w.finish()
    coded = [(c, False, f) for c, f in w.coded] + [(a["href"].split("#", 1)[1], True, a["in_footer"]) for a in w.anchors if "/cdn-cgi/l/email-protection#" in a["href"]]
    title = w.title if w.title and w.title.strip() else w.meta.get("og:title")
    return {
        "text": squeezed("".join(w.parts)),
        "title": _clean(title),
        "description": _clean(w.meta.get("description") or w.meta.get("og:description")),
        "noscript": [" ".join(t) for t in w.noscripts],
        "anchors": w.anchors,
        "cfemails": [{"seq": i, "hex": c, "from_href": h, "in_footer": f} for i, (c, h, f) in enumerate(coded)],
    }


def parse_pages(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with the parsed columns; the tree needs a real parser, so this is the one Python step per page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse_page(u.as_py(), h.as_py()) for u, h in zip(batch.column(url), batch.column(html))]
            parsed = [pa.array([r[c] for r in rows], type=kind) for c, kind in _ARROW.items()]
            del rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *parsed], names=[*batch.schema.names, *_ARROW])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    return pages.mapInArrow(frugal(run), f"{fields}, {PARSED}")
