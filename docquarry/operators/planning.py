"""Query plans: what a model answers about a query, bounded; variants of a query; merged signals of duplicate hits."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, StringType, StructField, StructType

#: Bounds of a plan.
LEXICAL, ITEMS, ITEM_CHARS, QUERY_CHARS, FILTER_CHARS = 2, 12, 200, 2000, 500
PLAN = StructType(
    [
        StructField("standalone", StringType()), StructField("semantic", StringType()), StructField("lexical", ArrayType(StringType())), StructField("entities", ArrayType(StringType())),
        StructField("facets", ArrayType(StringType())), StructField("filters", MapType(StringType(), StringType())), StructField("changed", BooleanType()), StructField("degraded", BooleanType()),
    ]
)


def bounded(value: Any, most: int = ITEMS, chars: int = ITEM_CHARS) -> list[str]:
    """Strings of a list, each once whatever its case, cut to the bounds."""
    out: dict[str, str] = {}
    for x in value if isinstance(value, list) else []:
        if isinstance(x, str) and x.strip():
            out.setdefault(x.strip().casefold(), x.strip()[:chars])
    return list(out.values())[:most]


def plan_of(original: str, answer: str | None) -> dict[str, Any]:
    """The plan in a model's answer (JSON, also in a code fence); what can't be read falls back to the query itself, `degraded`."""
    text = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", answer or "")
    try:
        data = json.loads(text)
    except ValueError:
        data = None
    ok = isinstance(data, dict)
    data = data if ok else {}

    def text_of(name: str, fallback: str) -> str:
        value = data.get(name)
        return value.strip()[:QUERY_CHARS] if isinstance(value, str) and value.strip() else fallback

    standalone = text_of("standalone_query", original)
    filters = data.get("filters")
    held = {str(k): str(v)[:FILTER_CHARS] for k, v in list(filters.items())[:ITEMS] if isinstance(v, str | int | float)} if isinstance(filters, dict) else {}
    return {
        "standalone": standalone, "semantic": text_of("semantic_query", standalone), "lexical": bounded(data.get("lexical_queries"), LEXICAL, QUERY_CHARS), "entities": bounded(data.get("entities")),
        "facets": bounded(data.get("answer_facets")), "filters": held, "changed": standalone.casefold() != original.casefold(), "degraded": not ok,
    }


@F.pandas_udf(PLAN)
def parse_plan(original: pd.Series, answer: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([plan_of(o or "", a) for o, a in zip(original, answer, strict=True)], columns=[f.name for f in PLAN])


def search_variants(original: Column, others: Column, facets: Column) -> Column:
    """The queries to search with: the original first, then others, then the original with its facets; each once whatever its case."""
    with_facets = F.when(F.size(facets) > 0, F.array(F.concat_ws(" ", original, F.array_join(facets, " ")))).otherwise(F.array().cast("array<string>"))
    every = F.filter(F.transform(F.concat(F.array(original), others, with_facets), lambda x: F.trim(x)), lambda q: q != "")
    keys = F.transform(every, F.lower)
    return F.filter(every, lambda q, i: F.array_position(keys, F.lower(q)) == i + 1)


def query_status(text: Column | str, most: int = QUERY_CHARS) -> Column:
    """ok, QUERY_EMPTY or QUERY_TOO_LONG, of a normalised query."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "QUERY_EMPTY").when(F.length(text) > most, "QUERY_TOO_LONG").otherwise("ok")


def merge_signals(hits: DataFrame, group: list[str], channels: list[str]) -> DataFrame:
    """Of hits with equal content, each channel's best rank with its score."""
    best = []
    for c in channels:
        first = F.min(F.when(F.col(f"{c}_rank").isNotNull(), F.struct(f"{c}_rank", f"{c}_score")))
        best += [first[f"{c}_rank"].alias(f"{c}_rank"), first[f"{c}_score"].alias(f"{c}_score")]
    return hits.groupBy(*group).agg(*best, F.count("*").alias("merged"))


def scope_match(entities: Column | str, title: Column, path: Column) -> Column:
    """The share of entities within a node's title and headings, letters and digits alone compared. Null: there are no entities."""
    def plain(c: Column) -> Column:
        return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}_]+", ""))

    scope = plain(F.concat_ws("", title, F.array_join(path, "")))
    asked = F.filter(F.transform(entities, plain), lambda e: e != "")
    return F.when(F.size(asked) > 0, F.size(F.filter(asked, lambda e: F.contains(scope, e))) / F.size(asked))
