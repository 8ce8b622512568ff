"""The candidate fold: a query's candidates in order, each kept or left out by what was kept before it.

A fold has to be sequential within a query; a query's candidates are one bounded group (the fused window, `search.FUSED_LIMIT`).
What a rule needs besides the candidates kept before (headings, keys of contents, shares of the best score) is
worked out as columns first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators.fusion import RERANK_LIMIT, RRF_SHARE, SIBLING_LIKE, low_information, similarity

#: Channels whose ranks and scores a duplicate hands on.
CHANNELS = ("document", "bm25", "dense", "graph")
#: Why a candidate is left out, in the order in which rules are tried.
WINDOW, HEADING, DUPLICATE, SCORE, SIBLING = "rerank_window_limit", "low_information_heading", "duplicate_content", "below_rrf_threshold", "sibling_near_duplicate"


def letters(text: str) -> frozenset[str]:
    """Runs of three characters without white space; a shorter text is one run."""
    solid = "".join(text.lower().split())
    return frozenset(solid[k : k + 3] for k in range(len(solid) - 2)) if len(solid) > 3 else frozenset([solid] if solid else [])


def alike(a: tuple[np.ndarray | None, str], b: tuple[np.ndarray | None, str]) -> float:
    """The cosine where both have vectors of one length, else the share of common runs of three characters."""
    if a[0] is not None and b[0] is not None and len(a[0]) == len(b[0]) > 0:
        return similarity(a[0], b[0])
    x, y = letters(a[1]), letters(b[1])
    return len(x & y) / len(x | y) if x and y else 0.0


def fold_candidates(
    candidates: DataFrame, query: str, ident: str, content: str = "content", parent: str = "parent_id", exact: str = "exact", vector: str | None = None,
    kinds: str | None = None, path: str | None = None, limit: int = RERANK_LIMIT, like: float = SIBLING_LIKE, share: float = RRF_SHARE,
) -> DataFrame:
    """The candidates with `reason` (null: kept), the signals they end with, and `merged` (duplicates that they took in).

    Candidates come in the order of rrf_score, best_rank (where there is one) and id. The first rule that holds
    decides: so many were kept before; a bare heading; the same content as one kept before, which takes over the
    better ranks of each channel with their scores, the graph path (`path`) where it has none, and the exact match; too small a share
    of the best score, without an exact match (one that the candidate itself has); nearly the same as one kept of its
    parent (a candidate without a parent is its own). A duplicate's signals go to the one kept, but don't change what was decided before.
    """
    order = [F.desc("rrf_score"), *([F.asc_nulls_last("best_rank")] if "best_rank" in candidates.columns else []), ident]
    held = [f"{c}_{x}" for c in CHANNELS for x in ("rank", "score") if f"{c}_{x}" in candidates.columns]
    heading = F.lit(False) if kinds is None else low_information(content) & (F.size(kinds) > 0) & F.forall(kinds, lambda x: F.lower(x) == "heading")
    top = F.max("rrf_score").over(Window.partitionBy(query))
    ready = candidates.select(
        "*",
        F.row_number().over(Window.partitionBy(query).orderBy(*order)).alias("__place"),
        F.coalesce(heading, F.lit(False)).alias("__heading"),
        T.dedupe_key(content).alias("__key"),
        F.coalesce((top > 0) & (F.col("rrf_score") / top < share), F.lit(False)).alias("__low"),
        F.coalesce(F.col(parent).cast("string"), F.col(ident).cast("string")).alias("__parent"),
    )
    whole = StructOf(candidates, "reason string, merged int")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("__place").to_dict("records")
        owner: dict[str, dict] = {}
        family: dict[str, list[tuple[np.ndarray | None, str]]] = {}
        room = limit
        for row in rows:
            own = (np.asarray(row[vector], np.float64) if vector and row[vector] is not None else None, row[content] or "")
            twin = owner.get(row["__key"] or "")
            if not room:
                row["reason"] = WINDOW
            elif row["__heading"]:
                row["reason"] = HEADING
            elif twin is not None:
                row["reason"] = DUPLICATE
                handed_on(row, twin)
            elif row["__low"] and not row[exact]:
                row["reason"] = SCORE
            elif any(alike(own, other) >= like for other in family.get(row["__parent"], ())):
                row["reason"] = SIBLING
            else:
                row["reason"], row["merged"] = None, 0
                room -= 1
                family.setdefault(row["__parent"], []).append(own)
                if row["__key"]:
                    owner[row["__key"]] = row
            row.setdefault("merged", 0)
        return pd.DataFrame(rows)[whole.names].astype({c: object for c in [*held, "reason"]})

    def handed_on(row: dict, twin: dict) -> None:
        for channel in CHANNELS:
            rank, score = f"{channel}_rank", f"{channel}_score"
            if rank in row and pd.notna(row[rank]) and (pd.isna(twin[rank]) or row[rank] < twin[rank]):
                twin[rank] = row[rank]
                if score in row:
                    twin[score] = row[score]
        if path and row[path] is not None and len(row[path]) and (twin[path] is None or not len(twin[path])):
            twin[path] = row[path]
        twin[exact] = bool(twin[exact]) or bool(row[exact])
        twin["merged"] += 1

    return ready.groupBy(query).applyInPandas(run, whole.ddl)


class StructOf:
    """The columns of a frame and some more."""

    def __init__(self, frame: DataFrame, more: str) -> None:
        self.ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema), more])
        self.names = [*frame.columns, *(x.split()[0] for x in more.split(", "))]
