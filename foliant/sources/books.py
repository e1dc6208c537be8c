"""Book files as tables: plain text and EPUB, one row a file at the scan, one row a chapter after it."""

from __future__ import annotations

import io
import posixpath
import re
import urllib.parse
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.chunking import chapters_of_text

FORMATS = (".txt", ".epub")
#: Block elements whose text is read.
BLOCKS = ("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "td", "th")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BACK_MATTER = {"索引", "参考书目", "index", "bibliography"}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def files(spark: SparkSession, path: str) -> DataFrame:
    """Book files under a path as (path, content); files of other formats are refused."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    known = suffix(F.col("path")).isin(*FORMATS)
    return rows.where(F.when(known, True).otherwise(F.raise_error(F.concat(F.lit("unsupported format: "), "path")).isNull()))


class _Tree(HTMLParser):
    """Elements as (tag, children) with strings among the children."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: tuple[str, list] = ("", [])
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node: tuple[str, list] = (tag, [])
        self.open[-1][1].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1][1].append((tag, []))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1][1].append(data)


def _parsed(html: str) -> tuple[str, list]:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _walk(node: tuple[str, list]) -> Iterator[tuple[str, list]]:
    """All elements below, in document order, without recursion."""
    todo = [iter(node[1])]
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
        elif not isinstance(child, str):
            yield child
            todo.append(iter(child[1]))


def _text(node: tuple[str, list]) -> str:
    out: list[str] = []
    todo = [iter(node[1])]
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
        elif isinstance(child, str):
            out.append(child)
        else:
            todo.append(iter(child[1]))
    return "".join(out)


def block_text(html: str) -> str:
    """Texts of the innermost block elements, one a line; asides are left out.

    White space in a block becomes one space, but for preformatted blocks. Text outside the
    innermost blocks is lost.
    """
    root = _parsed(html)
    stack = [root]
    while stack:
        node = stack.pop()
        node[1][:] = [c for c in node[1] if isinstance(c, str) or c[0] != "aside"]
        stack += [c for c in node[1] if not isinstance(c, str)]
    out = []
    for node in _walk(root):
        if node[0] in BLOCKS and not any(x[0] in BLOCKS for x in _walk(node)):
            text = _text(node)
            text = (text if node[0] == "pre" else re.sub(r"\s+", " ", text)).strip()
            if text:
                out.append(text)
    return "\n".join(out)


def first_heading(html: str) -> str:
    return next((_text(n).strip() for n in _walk(_parsed(html)) if n[0] in ("h1", "h2", "h3")), "")


def html_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text``, the block text of the page, in place of its HTML."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.fillna("").map(block_text)

    return pages.withColumn("text", run(html)).drop(html)


def _key(href: str) -> str:
    return posixpath.basename(href.split("#")[0])


def _local(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _toc(archive: zipfile.ZipFile, items: dict[str, dict], base: str) -> dict[str, str]:
    """Titles by file name; of several for one file the first counts."""
    titles: dict[str, str] = {}
    for item in items.values():
        name = posixpath.normpath(posixpath.join(base, item["href"]))
        if name not in archive.namelist():
            continue
        if "nav" in item["properties"].split():
            for node in _walk(_parsed_links(archive.read(name).decode("utf-8", "ignore"))):
                if node[0].startswith("a ") and _text(node).strip():
                    titles.setdefault(_key(node[0][2:]), _text(node).strip())
        elif item["type"] == "application/x-dtbncx+xml":
            for point in ElementTree.fromstring(archive.read(name)).iter():
                if _local(point) == "navPoint":
                    text = next((e.text or "" for e in point.iter() if _local(e) == "text"), "").strip()
                    href = next((e.get("src", "") for e in point if _local(e) == "content"), "")
                    if text and href:
                        titles.setdefault(_key(urllib.parse.unquote(href)), text)
    return titles


def _parsed_links(html: str) -> tuple[str, list]:
    class Links(_Tree):
        def handle_starttag(self, tag: str, attrs: list) -> None:
            href = dict(attrs).get("href")
            super().handle_starttag(f"a {urllib.parse.unquote(href)}" if tag == "a" and href else tag, attrs)

        def handle_endtag(self, tag: str) -> None:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0].split(" ")[0] == tag:
                    del self.open[k:]
                    return

    tree = Links()
    tree.feed(html)
    tree.close()
    return tree.root


def parse_epub(content: bytes, skip_back_matter: bool = True) -> dict:
    """Title, author, language, chapters [(title, content)] and cover of one EPUB.

    Chapters are the spine's documents that the table of contents names, or all where there is
    none. Manifest items that the archive lacks are ignored.
    """
    archive = zipfile.ZipFile(io.BytesIO(content))
    names = set(archive.namelist())
    container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
    opf = next(e.get("full-path") for e in container.iter() if _local(e) == "rootfile")
    base = posixpath.dirname(opf)
    package = list(ElementTree.fromstring(archive.read(opf)).iter())
    meta = {"title": "", "creator": "", "language": ""}
    for e in reversed(package):
        if _local(e) in meta and e.text:
            meta[_local(e)] = e.text
    items = {
        e.get("id", ""): {"href": urllib.parse.unquote(e.get("href", "")), "type": e.get("media-type", ""), "properties": e.get("properties", "")}
        for e in package
        if _local(e) == "item"
    }
    place = {i: posixpath.normpath(posixpath.join(base, x["href"])) for i, x in items.items()}
    items = {i: x for i, x in items.items() if place[i] in names}
    titles = _toc(archive, items, base)
    chapters: list[tuple[str, str]] = []
    for ref in (e.get("idref", "") for e in package if _local(e) == "itemref"):
        item = items.get(ref)
        if item is None or item["type"] != "application/xhtml+xml" or "nav" in item["properties"].split():
            continue
        if titles and _key(item["href"]) not in titles:
            continue
        html = archive.read(place[ref]).decode("utf-8", "ignore")
        text = block_text(html)
        if not text:
            continue
        title = titles.get(_key(item["href"])) or first_heading(html) or meta["title"] or f"Chapter {len(chapters) + 1}"
        title = re.sub(r"\s+", "", title)
        if not (skip_back_matter and title.casefold() in BACK_MATTER):
            chapters.append((title, text))
    cover = _cover(package, items)
    return {
        "title": meta["title"],
        "author": meta["creator"],
        "language": meta["language"],
        "chapters": chapters or [(meta["title"] or "Untitled", "")],
        "cover": archive.read(place[cover]) if cover else b"",
        "cover_type": items[cover]["type"] if cover else "",
    }


def _cover(package: list, items: dict[str, dict]) -> str:
    """The item marked as cover, else that of the cover entry, else an image with cover in its name."""
    declared = next((e.get("content", "") for e in package if _local(e) == "meta" and e.get("name") == "cover"), "")
    marked = [i for i, x in items.items() if "cover-image" in x["properties"].split()]
    named = [i for i, x in items.items() if x["type"].startswith("image/") and "cover" in (i + x["href"]).lower()]
    return next(iter([*marked, *([declared] if declared in items else []), *named]), "")


def read_epub(rows: DataFrame, skip_back_matter: bool = True) -> DataFrame:
    """Chapters of EPUB rows (path, content), with the book's metadata in each row.

    A file that can't be read is one row with the reason in ``error`` and without content, and
    all other files go on.
    """
    columns = ["path", "book_title", "author", "language", "title", "level", "sort_order", "content", "cover", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    book = parse_epub(bytes(content), skip_back_matter)
                except Exception as e:  # whatever a broken archive or document raises is that book's
                    yield pd.DataFrame([(path, "", "", "", "", 1, 0, None, None, f"{type(e).__name__}: {e}")], columns=columns)
                    continue
                yield pd.DataFrame(
                    [
                        (path, book["title"], book["author"], book["language"], title, 1, order, text, book["cover"] if order == 0 else None, None)
                        for order, (title, text) in enumerate(book["chapters"])
                    ],
                    columns=columns,
                )

    return rows.mapInPandas(
        run,
        "path string, book_title string, author string, language string, title string, level int, sort_order int, "
        "content string, cover binary, error string",
    )


def read_text(rows: DataFrame, skip_back_matter: bool = True) -> DataFrame:
    """Chapters of text rows (path, content): bytes that are no UTF-8 are dropped, no content is an empty text."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for contents in batches:
            yield contents.map(lambda b: bytes(b or b"").decode("utf-8", "ignore"))

    books = rows.select(F.col("path").alias("book_id"), stem(F.col("path")).alias("title"), decode("content").alias("content"))
    parts = chapters_of_text(books, skip_back_matter)
    return parts.select(
        F.col("book_id").alias("path"),
        stem(F.col("book_id")).alias("book_title"),
        F.lit("").alias("author"),
        F.lit("").alias("language"),
        "title",
        "level",
        F.col("sort_order").cast("int").alias("sort_order"),
        "content",
        F.lit(None).cast("binary").alias("cover"),
        F.lit(None).cast("string").alias("error"),
    )


def read_books(spark: SparkSession, path: str, skip_back_matter: bool = True) -> DataFrame:
    """Chapters of all book files under a path, by the reader of each format."""
    rows = files(spark, path)
    text = read_text(rows.where(suffix(F.col("path")) == ".txt"), skip_back_matter)
    return text.unionByName(read_epub(rows.where(suffix(F.col("path")) == ".epub"), skip_back_matter))
