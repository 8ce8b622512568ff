"""Parsers: from a file's text or bytes to rows of blocks (ord, kind, level, parent, text, locator)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A block: kind, level, parent's place in the list, text, where it stands, and an attribute (an address, a language).
Block = tuple[str, int | None, int | None, str, str, str | None]
SCHEMA = "ord long, kind string, level int, parent long, text string, locator string, attribute string"
#: Parser names by suffix.
PARSERS = {"txt": "plain", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "docx": "word", "pptx": "slides", "xlsx": "sheets", "pdf": "layout", "doc": "legacy", "ppt": "legacy", "xls": "legacy"}
SKIPPED = {"script", "style", "nav", "footer", "aside", "noscript", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "ul", "ol", "li", "blockquote", "pre", "table"}


def parser_for(name: Column | str) -> Column:
    """The parser of a file by its suffix, null where there is none."""
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in PARSERS.items() for x in kv]), suffix)


def plain(text: str) -> list[Block]:
    """Paragraphs between blank lines, with lines and characters."""
    out: list[Block] = []
    for m in re.finditer(r"\S(?:.*?\S)??(?=[^\S\n]*(?:\n[^\S\n]*\n|\s*\Z))", text, re.DOTALL):
        first = text.count("\n", 0, m.start()) + 1
        out.append(("paragraph", None, None, m.group(), f"lines {first}-{first + m.group().count(chr(10))}; chars {m.start()}-{m.end()}", None))
    return out


def markdown(text: str) -> list[Block]:
    """Headings, fenced code, lists with nesting, quotes and paragraphs: the block structure of the common subset."""
    out: list[Block] = []
    lines, at = text.split("\n"), 0
    lists: list[tuple[int, int]] = []  # (indent, place of the list's block)
    item = re.compile(r"^(\s*)([-*+]|\d{1,9}[.)])\s+(.*)$")
    while at < len(lines):
        line, spot = lines[at], f"lines {at + 1}-"
        if not line.strip():
            at += 1
            continue
        if fence := re.match(r"^\s{0,3}(```+|~~~+)\s*(\S*)", line):
            end = next((k for k in range(at + 1, len(lines)) if lines[k].strip().startswith(fence.group(1)[:3])), len(lines))
            out.append(("code", None, None, "\n".join(lines[at + 1 : end]), f"{spot}{min(end, len(lines) - 1) + 1}", fence.group(2) or None))
            lists, at = [], end + 1
        elif head := re.match(r"^\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line):
            out.append(("heading", len(head.group(1)), None, head.group(2), f"{spot}{at + 1}", None))
            lists, at = [], at + 1
        elif m := item.match(line):
            indent, ordered = len(m.group(1).expandtabs(4)), m.group(2)[0].isdigit()
            while lists and lists[-1][0] > indent:
                lists.pop()
            if not lists or lists[-1][0] < indent:
                parent = next((k for k in range(len(out) - 1, -1, -1) if out[k][0] == "list_item"), None) if lists else None
                out.append(("list", None, parent, "", f"{spot}{at + 1}", "ordered" if ordered else "bullet"))
                lists.append((indent, len(out) - 1))
            body, at = [m.group(3)], at + 1
            while at < len(lines) and lines[at].strip() and not item.match(lines[at]) and lines[at].startswith(" "):
                body.append(lines[at].strip())
                at += 1
            out.append(("list_item", None, lists[-1][1], " ".join(body), f"{spot}{at}", None))
        else:
            quote = line.lstrip().startswith(">")
            end = at
            while end < len(lines) and lines[end].strip() and not re.match(r"^\s{0,3}(#{1,6}\s|```|~~~)", lines[end]) and not item.match(lines[end]):
                end += 1
            body = "\n".join(re.sub(r"^\s*>\s?", "", x) if quote else x.strip() for x in lines[at : max(end, at + 1)])
            out.append(("quote" if quote else "paragraph", None, None, body, f"{spot}{max(end, at + 1)}", None))
            lists, at = [], max(end, at + 1)
    return out


class Page(HTMLParser):
    """Blocks of a page. Within a list item, a table or preformatted text, inner blocks are text of the outer one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.title = ""
        self.stack: list[tuple[str, str]] = []  # (tag, its path)
        self.counts: list[dict[str, int]] = [{}]
        self.skip = 0
        self.open: list[dict] = []  # blocks being read, the innermost last
        self.lists: list[int] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.counts[-1][tag] = self.counts[-1].get(tag, 0) + 1
        path = (self.stack[-1][1] + " > " if self.stack else "") + f"{tag}:nth-of-type({self.counts[-1][tag]})"
        if tag in VOID:
            if tag == "br" and self.open:
                self.open[-1]["text"].append(" ")
            return
        self.stack.append((tag, path))
        self.counts.append({})
        if tag in SKIPPED:
            self.skip += 1
        if self.skip:
            return
        if self.open and tag in ("td", "th", "tr", "p", "div", "li"):
            self.open[-1]["text"].append(" ")
        inside = self.open[-1]["tag"] if self.open else ""
        if tag == "a" and self.open:
            href = dict(attrs).get("href")
            if href:
                self.open[-1]["links"].append(href)
        if tag not in BLOCKS or inside in ("table", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "p") or (inside == "li" and tag not in ("ul", "ol")) or (inside == "blockquote" and tag == "p"):
            return
        kind = {"ul": "list", "ol": "list", "li": "list_item", "blockquote": "quote", "pre": "code", "table": "table", "p": "paragraph"}.get(tag, "heading")
        level = int(tag[1]) if kind == "heading" else None
        parent = self.lists[-1] if kind == "list_item" and self.lists else next((b["at"] for b in reversed(self.open) if b["tag"] == "li"), None) if kind == "list" else None
        at = len(self.blocks)
        self.blocks.append((kind, level, parent, "", path, "ordered" if tag == "ol" else "bullet" if tag == "ul" else None))
        self.open.append({"tag": tag, "at": at, "text": [], "links": []})
        if kind == "list":
            self.lists.append(at)

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            top, _ = self.stack.pop()
            self.counts.pop()
            if top in SKIPPED:
                self.skip -= 1
            elif self.open and self.open[-1]["tag"] == top and not self.skip:
                self.close_block()
            if top == tag:
                break

    def close_block(self) -> None:
        done = self.open.pop()
        kind, level, parent, _, path, attribute = self.blocks[done["at"]]
        raw = "".join(done["text"])
        text = raw.strip("\n") if kind == "code" else " ".join(raw.split())
        self.blocks[done["at"]] = (kind, level, parent, "" if kind == "list" else text, path, attribute or (", ".join(dict.fromkeys(done["links"])) or None))
        if kind == "list" and self.lists:
            self.lists.pop()

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] == "title":
            self.title += data
        elif not self.skip and self.open:
            self.open[-1]["text"].append(data)


def html(text: str) -> list[Block]:
    page = Page()
    page.feed(text)
    page.close()
    while page.open:
        page.close_block()
    return page.blocks


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def words_of(node: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in node.iter() if local(x.tag) == "t")


def attribute(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if local(k) == name), None)


def rows_of(table: ElementTree.Element) -> str:
    return "\n".join("\t".join(words_of(c).strip() for c in row if local(c.tag) == "tc") for row in table if local(row.tag) == "tr")


def word(data: bytes) -> list[Block]:
    """Paragraphs, headings, list items and tables of a text document in the order of its body, then its footnotes."""
    out: list[Block] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(x for x in ElementTree.fromstring(z.read("word/document.xml")) if local(x.tag) == "body")
        for n, node in enumerate(body):
            if local(node.tag) == "tbl":
                out.append(("table", None, None, rows_of(node), f"table {n}", None))
            elif local(node.tag) == "p" and (text := words_of(node).strip()):
                style = next((attribute(x, "val") or "" for x in node.iter() if local(x.tag) == "pStyle"), "")
                level = re.match(r"heading\s*(\d)", style, re.IGNORECASE)
                out.append(("heading" if level else "list_item" if style.lower().startswith("list") else "paragraph", int(level.group(1)) if level else None, None, text, f"paragraph {n}", style or None))
        if "word/footnotes.xml" in z.namelist():
            for note in ElementTree.fromstring(z.read("word/footnotes.xml")):
                ident = attribute(note, "id") or "0"
                if ident.lstrip("-").isdigit() and int(ident) >= 1:
                    out.append(("footnote", None, None, words_of(note).strip(), f"footnote {ident}", None))
    return out


def slides(data: bytes) -> list[Block]:
    """A container for each slide, then its title, texts, tables and notes."""
    out: list[Block] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((x for x in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", x)), key=lambda x: int(re.findall(r"\d+", x)[-1]))
        for n, name in enumerate(names, 1):
            parent = len(out)
            out.append(("slide", None, None, "", f"slide {n}", None))
            for k, node in enumerate(x for x in ElementTree.fromstring(z.read(name)).iter() if local(x.tag) in ("sp", "tbl")):
                if local(node.tag) == "tbl":
                    out.append(("table", None, parent, rows_of(node), f"slide {n}, shape {k}", None))
                elif text := "\n".join(t for p in node.iter() if local(p.tag) == "p" and (t := words_of(p).strip())):
                    title = any(local(x.tag) == "ph" and attribute(x, "type") in ("title", "ctrTitle") for x in node.iter())
                    out.append(("heading" if title else "paragraph", 1 if title else None, parent, text, f"slide {n}, shape {k}", None))
            notes = name.replace("slides/slide", "notesSlides/notesSlide")
            if notes in z.namelist() and (text := words_of(ElementTree.fromstring(z.read(notes))).strip()):
                out.append(("note", None, parent, text, f"slide {n}, notes", None))
    return out


def sheets(data: bytes) -> list[Block]:
    """For each visible sheet a container and one table of its visible cells; formulas stand behind their values."""
    out: list[Block] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [words_of(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        listed = [x for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if local(x.tag) == "sheet"]
        for n, sheet in enumerate(listed, 1):
            if sheet.attrib.get("state", "visible") != "visible" or f"xl/worksheets/sheet{n}.xml" not in names:
                continue
            root = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{n}.xml"))
            hidden = {c for col in root.iter() if local(col.tag) == "col" and col.attrib.get("hidden") in ("1", "true") for c in range(int(col.attrib["min"]), int(col.attrib["max"]) + 1)}
            rows, spots = [], []
            for row in (x for x in root.iter() if local(x.tag) == "row" and x.attrib.get("hidden") not in ("1", "true")):
                cells: dict[int, str] = {}
                for cell in (x for x in row if local(x.tag) == "c"):
                    letters = re.sub(r"\d", "", cell.attrib.get("r", "A"))
                    at = 0
                    for ch in letters:
                        at = at * 26 + ord(ch) - 64
                    value = next((x.text or "" for x in cell if local(x.tag) == "v"), words_of(cell))
                    if cell.attrib.get("t") == "s" and value.isdigit():
                        value = shared[int(value)]
                    formula = next((x.text for x in cell if local(x.tag) == "f" and x.text), None)
                    if at not in hidden:
                        cells[at] = f"{value} (={formula})" if formula else value
                        if value:
                            spots.append(cell.attrib.get("r", ""))
                rows.append([cells.get(c, "") for c in range(1, max(cells, default=0) + 1) if c not in hidden])
            while rows and not any(rows[-1]):
                rows.pop()
            parent = len(out)
            out.append(("sheet", None, None, "", sheet.attrib.get("name", f"sheet {n}"), None))
            out.append(("logical_table", None, parent, "\n".join("\t".join(r) for r in rows), f"{spots[0]}:{spots[-1]}" if spots else "", None))
    return out


def parse(files: DataFrame, ident: str, content: str, parser: Callable[..., list[Block]], binary: bool = False) -> DataFrame:
    """ident and the blocks of each file. A file that can't be read gives one block of kind `error`."""
    kind = files.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, c in zip(batch["i"], batch["c"], strict=True):
                try:
                    blocks = parser((c or b"") if binary else (c or ""))
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration) as e:
                    blocks = [("error", None, None, type(e).__name__, "", None)]
                rows += [(i, n, *b) for n, b in enumerate(blocks)]
            out = pd.DataFrame(rows, columns=[ident, "ord", "kind", "level", "parent", "text", "locator", "attribute"])
            yield out.astype({"level": "Int32", "parent": "Int64"})

    return files.select(F.col(ident).alias("i"), F.col(content).alias("c")).mapInPandas(run, f"{ident} {kind}, {SCHEMA}")


# Lists of items as a layout service returns them.

DISCARDED = ("header", "footer", "page_number", "aside_text", "discarded")


def layout_blocks(items: DataFrame, document: str, order: str) -> DataFrame:
    """Decoded items (type, text, text_level, page_idx) as blocks: pages from 1, a container before a page's first block, headers and footers left out, unknown kinds as notes."""
    kept = items.filter(~F.col("type").isin(*DISCARDED))
    kind = F.when((F.col("type") == "text") & (F.coalesce("text_level", F.lit(0)) > 0), "heading").when(F.col("type") == "text", "paragraph").when(F.col("type").isin("table", "image", "equation", "code", "list"), F.col("type")).otherwise("note")
    own = kept.select(document, (F.col("page_idx") + 1).alias("page"), F.col(order).cast("double").alias("at"), kind.alias("kind"), F.when(kind == "heading", F.col("text_level")).alias("level"), "text")
    pages = own.groupBy(document, "page").agg((F.min("at") - 0.5).alias("at")).withColumns({"kind": F.lit("page"), "level": F.lit(None).cast("int"), "text": F.lit("")})
    return own.unionByName(pages)


def best_output(candidates: DataFrame, document: str) -> DataFrame:
    """Of several decodings (priority, items, tables_html, tables_image, expected_tables), the best by score, then the first by priority."""
    lacks = (F.col("expected_tables") > 0) & (F.col("tables_html") == 0)
    score = F.least(F.col("items"), F.lit(10000)) + 100 * F.col("tables_html") - 5000 * F.col("tables_image") + F.when(lacks, -100000).otherwise(100000)
    return candidates.withColumn("score", score).groupBy(document).agg(F.max_by("priority", F.struct("score", -F.col("priority"))).alias("priority"), F.max("score").alias("score"))
