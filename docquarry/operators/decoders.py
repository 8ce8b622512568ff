"""Decoders of a layout service's answers: several JSON shapes to one list of items."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM = "ord long, type string, text string, text_level int, page_idx int, bbox array<double>, html string, caption string"
#: What the service calls its kinds, and ours.
KINDS = {
    "title": "text", "text": "text", "paragraph": "text", "list": "list", "index": "list", "table": "table", "image": "image", "figure": "image", "chart": "image", "equation": "equation",
    "interline_equation": "equation", "code": "code", "algorithm": "code", "header": "header", "footer": "footer", "page_number": "page_number", "aside_text": "aside_text",
}


def text_of(value: Any) -> str:
    """All text within a value: strings joined by spaces; the fields that hold text, of what is nested."""
    if isinstance(value, str):
        return value.strip()
    if isinstance(value, list):
        return " ".join(t for t in map(text_of, value) if t)
    if isinstance(value, dict):
        fields = ("content", "text", "text_content", "spans", "lines", "blocks", "list_items", "paragraph_content", "title_content", "code_body", "item_content")
        return " ".join(t for name in fields if name in value and (t := text_of(value[name])))
    return ""


def find(value: Any, name: str) -> str | None:
    """The first text under a field's name, at any depth."""
    if isinstance(value, dict):
        if isinstance(value.get(name), str) and value[name]:
            return value[name]
        value = list(value.values())
    if isinstance(value, list):
        return next((f for x in value if (f := find(x, name)) is not None), None)
    return None


def whole(value: Any) -> int | None:
    """An integer, or a text of one; truth values aren't."""
    if isinstance(value, bool):
        return None
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def box(value: Any) -> list[float] | None:
    good = isinstance(value, list) and len(value) == 4 and all(isinstance(x, int | float) and not isinstance(x, bool) for x in value)
    return [float(x) for x in value] if good else None


def item(raw: dict[str, Any], page: int | None) -> tuple:
    kind = str(raw.get("type", "unknown"))
    level = whole(raw.get("text_level") or raw.get("level")) or (1 if kind == "title" else 0)
    table = raw.get("table_body") or find(raw, "html")
    caption = text_of(raw.get("table_caption") or raw.get("image_caption") or raw.get("caption") or [])
    at = whole(raw.get("page_idx"))
    return KINDS.get(kind, kind), text_of(raw), level, at if at is not None else page or 0, box(raw.get("bbox")), table, caption or None


def items_of(text: str | None) -> list[tuple]:
    """Of a flat list of items, a list of pages with items each, or a document with `pdf_info` pages of blocks. Anything else gives none."""
    try:
        data = json.loads(text or "")
    except ValueError:
        return []
    if isinstance(data, dict) and isinstance(data.get("pdf_info"), list):
        data = [(p.get("para_blocks") or p.get("preproc_blocks") or []) for p in data["pdf_info"] if isinstance(p, dict)]
    if not isinstance(data, list):
        return []
    if data and all(isinstance(p, list) for p in data):
        return [item(x, k) for k, page in enumerate(data) for x in page if isinstance(x, dict)]
    return [item(x, None) for x in data if isinstance(x, dict)]


def decode(outputs: DataFrame, ident: str, content: str) -> DataFrame:
    """ident and the items of each answer."""
    kind = outputs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, *x) for i, c in zip(batch["i"], batch["c"], strict=True) for n, x in enumerate(items_of(c))]
            yield pd.DataFrame(rows, columns=[ident, "ord", "type", "text", "text_level", "page_idx", "bbox", "html", "caption"])

    return outputs.select(F.col(ident).alias("i"), F.col(content).alias("c")).mapInPandas(run, f"{ident} {kind}, {ITEM}")
