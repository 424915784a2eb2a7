"""EPUB books: zip archives of XHTML chapters in the order of their spine."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

# Elements that begin a block, those of headings, and those whose content no reader sees.
BLOCKS = set("p div section article ul ol li table tr blockquote pre hr br h1 h2 h3 h4 h5 h6 dt dd figure figcaption".split())
HEADINGS = {f"h{n}": "#" * n + " " for n in range(1, 7)}
UNSEEN = {"script", "style", "head"}
CHAPTERS = "path string, position int, title string, text string, error string"


class _Text(HTMLParser):
    """Paragraphs of a page as Markdown: headings and list items marked, blank lines between blocks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [""], 0

    def handle_starttag(self, tag, attrs) -> None:
        self.hidden += tag in UNSEEN
        if tag in BLOCKS:
            self.out.append(HEADINGS.get(tag, "- " if tag == "li" else ""))

    def handle_endtag(self, tag) -> None:
        self.hidden -= tag in UNSEEN
        if tag in BLOCKS:
            self.out.append("")

    def handle_data(self, data) -> None:
        if not self.hidden:
            self.out[-1] += data

    def text(self) -> str:
        return "\n\n".join(x for x in (" ".join(p.split()) for p in self.out) if x.strip("# -"))


def _chapters(content: bytes) -> Iterator[str]:
    """The pages of a book in reading order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        package = next(e.get("full-path") for e in container.iter() if e.tag.endswith("}rootfile"))
        opf = ElementTree.fromstring(z.read(package))
        items = {e.get("id"): e.get("href") for e in opf.iter() if e.tag.endswith("}item")}
        for ref in (e.get("idref") for e in opf.iter() if e.tag.endswith("}itemref")):
            yield z.read(posixpath.normpath(posixpath.join(posixpath.dirname(package), items[ref]))).decode("utf-8", "replace")


def read_epubs(files: DataFrame) -> DataFrame:
    """CHAPTERS of books (path, content): one row a page of the spine, its first heading as title; a file that is no sound EPUB gives one row with an error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    pages = []
                    for n, page in enumerate(_chapters(content)):
                        parser = _Text()
                        parser.feed(page)
                        text = parser.text()
                        head = next((x.lstrip("# ") for x in text.split("\n") if x.startswith("#")), None)
                        pages.append((path, n, head, text, None))
                    rows += pages
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError, TypeError) as e:
                    rows.append((path, -1, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "position", "title", "text", "error"]).astype({"position": "int32"})

    return files.select("path", "content").mapInPandas(read, CHAPTERS)


def epub_bytes(title: str, pages: list[str]) -> bytes:
    """A small book of XHTML bodies."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>')
        items = "".join(f'<item id="c{i}" href="c{i}.xhtml"/>' for i in range(len(pages)))
        spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(pages)))
        z.writestr("OEBPS/book.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><metadata/><manifest>{items}</manifest><spine>{spine}</spine></package>')
        for i, page in enumerate(pages):
            z.writestr(f"OEBPS/c{i}.xhtml", f"<html><head><title>{title}</title></head><body>{page}</body></html>")
    return out.getvalue()
