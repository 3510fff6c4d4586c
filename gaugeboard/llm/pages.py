"""Main text of web pages: site templates found by counting element subtrees per host.

Every element's subtree is hashed (name, class, id, role, texts and children).  Spark counts in
how many different pages of its host each subtree stands; one that stands in at least MIN_PAGES
and a share SHARE of them is template and is cut.  A page's subtrees are counted once per
different page, so copies of one page do not turn its article into a template.  Since a
template subtree stands in a fifth of its host's pages, a host has at most five times as many as
a page has elements: the list that travels to the pages is bounded.

Page furniture that names itself (elements such as nav or form, class and id words such as
"cookie") goes too.  What is left of the article elements (of main, or of the body if there is none)
is the text: plain elements inside an article, without class, id or role, are never template.

NULL and empty html give an empty text; a url without a host belongs to the host "".  Broken
markup is read as far as it goes: open elements end with their parent, stray ends are passed
over.  Repeated rows give repeated results.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from gaugeboard.llm.texts import column, pieces, text_column
from gaugeboard.session import materialize

MIN_PAGES = 5
SHARE = 0.2
#: (host, subtree) rows up to which templates are broadcast, some megabytes.
BROADCAST_TEMPLATES = 100_000

# HTML's element kinds, and names that page furniture goes by.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = set(
    "nav footer aside form script style noscript template iframe svg canvas object button select textarea input dialog menu head title xmp noembed noframes".split()
)
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
FURNITURE_WORDS = set(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login sidebar menu navbar nav navigation breadcrumb breadcrumbs footer masthead "
    "comment comments reply replies disqus respond social share sharing related recommended recommendations widget pagination pager toolbar".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"},
}
#: Elements that an implied end does not reach beyond.
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
ENDS_P = BLOCKS - {"body", "html", "caption", "legend", "tbody", "td", "tfoot", "th", "thead", "tr", "summary"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[!?/][^>]*>", re.S)
_RAW_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in RAW}
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


class Element:
    __slots__ = ("children", "inside", "name", "names", "role")

    def __init__(self, name: str, attributes: str = "", inside: bool = False):
        self.name, self.children, self.inside = name, [], inside  # inside: in an article or main
        self.names = self.role = ""
        if "=" in attributes:
            for key, *value in _NAMES.findall(attributes):
                if key.lower() == "role":
                    self.role = "".join(value).strip().lower()
                else:
                    self.names += "".join(value) + " "

    def furniture(self) -> bool:
        if self.name in FURNITURE or self.role in ROLES or self.name == "header" and not self.inside:
            return True
        return bool(self.names) and self.name not in ("html", "body", "article", "main") and not FURNITURE_WORDS.isdisjoint(
            p.lower() for p in _PARTS.findall(self.names)
        )

    def template(self) -> bool:
        """Could it be template, by its place?"""
        if self.name in ("html", "body", "article", "main"):
            return False
        return not self.inside or bool(self.names or self.role)


class _Open:
    """The open elements, and for each name where they stand, so that none is searched for."""

    def __init__(self, root: Element):
        self.stack, self.places = [root], defaultdict(list)

    def push(self, element: Element) -> None:
        self.places[element.name].append(len(self.stack))
        self.stack.append(element)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            self.places[self.stack.pop().name].pop()

    def last(self, names) -> int:
        """The place of the innermost open element with one of the names, 0 without one."""
        return max((self.places[n][-1] for n in names if self.places[n]), default=0)


def parse(page: str) -> Element:
    """The element tree; texts are strings, still with character references.  Time grows with the page, however deep it is."""
    root = Element("")
    opened, at = _Open(root), 0
    stack = opened.stack
    while True:
        found = _TOKEN.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text:
            stack[-1].children.append(text)
        if not found:
            return root
        at, name = found.end(), (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            if place := opened.last((name,)):
                opened.cut(place)
            elif name == "p":  # a stray end of a paragraph still parts what is around it
                stack[-1].children.append(Element(name, "", stack[-1].inside))
            continue
        closed, scope = CLOSES.get(name, ()), SCOPES.get(name, ())
        if name in ENDS_P:
            closed, scope = {*closed, "p"}, {*scope, "td", "th", "table", "button"}
        if closed:
            wall = opened.last(set(scope) - set(closed))
            while (place := opened.last(closed)) > wall:
                opened.cut(place)
        above = stack[-1]
        element = Element(name, found[3], above.inside or above.name in ("article", "main"))
        above.children.append(element)
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            element.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif name not in VOID and not found[3].endswith("/"):
            opened.push(element)


def hashed(root: Element) -> dict[int, int]:
    """The 64-bit hash of each element's subtree, by the element's identity; children come first."""
    out: dict[int, int] = {}
    todo: list[tuple[Element, bool]] = [(root, False)]
    while todo:
        element, ready = todo.pop()
        if not ready:
            todo.append((element, True))
            todo += [(c, False) for c in element.children if not isinstance(c, str)]
            continue
        parts = [element.name, element.names, element.role]
        for child in element.children:
            parts.append(" ".join(child.split()) if isinstance(child, str) else f"\x00{out[id(child)]:x}")
        value = xxhash.xxh64_intdigest("\x01".join(parts))
        out[id(element)] = value - (1 << 64) if value >> 63 else value
    return out


def subtrees(root: Element) -> list[int]:
    """Distinct hashes of the subtrees that can be template; those inside furniture do not matter."""
    hashes, out, todo = hashed(root), set(), [c for c in root.children if not isinstance(c, str)]
    while todo:
        element = todo.pop()
        if element.furniture():
            continue
        if element.template():
            out.add(hashes[id(element)])
        todo += [c for c in element.children if not isinstance(c, str)]
    return sorted(out)


def _roots(root: Element, name: str) -> list[Element]:
    """Outermost elements of a name in page order, outside furniture."""
    out, todo = [], [root]
    while todo:
        element = todo.pop()
        if element.name == name:
            out.append(element)
        elif not (element.name and element.furniture()):
            todo += [c for c in reversed(element.children) if not isinstance(c, str)]
    return out


def main_text(root: Element, templates: set[int]) -> str:
    """Blocks of the content left, one a line."""
    hashes = hashed(root) if templates else {}
    tops = _roots(root, "article") or _roots(root, "main") or _roots(root, "body") or [root]
    lines, line = [], []

    def end() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            lines.append(text)
        line.clear()

    for top in tops:
        todo: list = [top]
        while todo:
            item = todo.pop()
            if item is None:
                end()
            elif isinstance(item, str):
                line.append(item)
            elif item is not top and (item.furniture() or templates and item.template() and hashes[id(item)] in templates):
                if item.name in BLOCKS:
                    end()
            elif item.name == "br":
                line.append(" ")
            else:
                block = item.name in BLOCKS
                if block:
                    end()
                    todo.append(None)
                todo += reversed(item.children)
        end()
    return "\n".join(lines)


def host(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _subtree_rows(batches):
    for batch in batches:
        for piece, texts in pieces(iter([batch]), "html"):
            urls = piece.column(piece.schema.get_field_index("url")).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(map(host, urls)), pa.string()),
                    pa.array([xxhash.xxh64_intdigest(t) >> 1 for t in texts], pa.int64()),
                    pa.array([subtrees(parse(t.decode())) for t in texts], pa.list_(pa.int64())),
                ],
                ["host", "page", "subtrees"],
            )


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """(host, templates): hashes of the subtrees that recur across different pages of the host; ``pages``: url, html."""
    seen = pages.mapInArrow(_subtree_rows, "host string, page long, subtrees array<long>")
    different = seen.groupBy("host", "page").agg(F.first("subtrees").alias("subtrees"))
    # The number 0 stands for the page itself, so that one pass counts pages and subtrees.
    counted = different.select("host", F.explode(F.array_append("subtrees", F.lit(0).cast("long"))).alias("subtree")).groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"))
    frequent = counted.filter(F.col("n") >= min_pages)
    sizes = frequent.filter("subtree = 0").select("host", F.col("n").alias("pages"))
    found = frequent.filter("subtree <> 0").join(sizes, "host").filter(F.col("n") >= F.lit(share) * F.col("pages"))
    return found.groupBy("host").agg(F.sort_array(F.collect_set("subtree")).alias("templates"))


def host_column(url):
    """Like ``host``, in Spark's functions."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _extract(batches):
    for batch in batches:
        for piece, texts in pieces(iter([batch]), "html"):
            known = piece.column(piece.schema.get_field_index("templates")).to_pylist()
            out = [main_text(parse(t.decode()), set(k or ())) if t else "" for t, k in zip(texts, known)]
            columns = {n: piece.column(i) for i, n in enumerate(piece.schema.names) if n not in ("html", "templates")}
            columns |= {"text": pa.array(out, pa.string()), "n_chars": pa.array(list(map(len, out)), pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def main_texts(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars per row."""
    page_id = column(pages, id_col)
    page_id = page_id if id_col in pages.columns else page_id.cast("long")
    rows = pages.select(page_id.alias("page_id"), text_column(pages, url_col).alias("url"), text_column(pages, html_col).alias("html"))
    found = materialize(templates(rows.select("url", "html"), min_pages, share), "templates")
    few = (found.agg(F.sum(F.size("templates") + 4)).first()[0] or 0) <= BROADCAST_TEMPLATES
    joined = rows.withColumn("host", host_column(F.col("url"))).join(F.broadcast(found) if few else found, "host", "left").drop("host")
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.schema if f.name != "html"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return joined.mapInArrow(_extract, schema)
