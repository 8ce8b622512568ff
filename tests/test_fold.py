"""The candidate fold against a plain walk over the candidates, with siblings, duplicates and more of them than the window has room for."""

import random

import pytest

from docquarry.operators.fold import DUPLICATE, HEADING, SCORE, SIBLING, WINDOW, fold_candidates

SCHEMA = "q long, id long, parent_id long, content string, rrf_score double, best_rank long, bm25_rank long, bm25_score double, dense_rank long, dense_score double, graph_rank long, graph_score double, graph_path array<string>, exact boolean, vector array<double>, kinds array<string>"


def made(rng, q, n):
    rows = []
    for k in range(n):
        base = rng.randrange(12)
        content = rng.choice([f"text {base} of this parent and more", f"Text  {base} of THIS parent\nand more", f"own text {k} " + "x" * k, "Appendix 3", None, " "])
        vector = None if rng.random() < 0.3 else [1.0, base / 10, rng.choice([0.0, 0.01, 0.8])]
        ranks = [rng.choice([None, rng.randint(1, 60)]) for _ in range(3)]
        rows.append((q, k, rng.choice([None, base]), content, rng.choice([0.001, 0.004, 0.01, 0.03]), rng.choice([None, 1, 2, 3]), ranks[0], None if ranks[0] is None else ranks[0] / 7, ranks[1], 0.5, ranks[2], 0.1 * k, rng.choice([None, [], [f"p{k}"]]), rng.random() < 0.2, vector, rng.choice([["heading"], ["Heading", "text"], [], None])))
    return rows


def cosine(a, b):
    size = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    return min(1.0, max(0.0, sum(x * y for x, y in zip(a, b)) / size)) if size else 0.0


def grams(text):
    t = "".join((text or "").lower().split())
    return {t[i : i + 3] for i in range(len(t) - 2)} if len(t) > 3 else {t} - {""}


def plain(rows, limit, like=0.96, share=0.25):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    rows = [dict(zip(names, r)) for r in rows]
    rows.sort(key=lambda r: (-r["rrf_score"], 10**9 if r["best_rank"] is None else r["best_rank"], r["id"]))
    top = rows[0]["rrf_score"]
    kept = []
    for r in rows:
        key = " ".join((r["content"] or "").lower().split())
        r["merged"], r["key"] = 0, key
        same = [x for x in kept if key and x["key"] == key]
        kin = [x for x in kept if (x["parent_id"] if x["parent_id"] is not None else x["id"]) == (r["parent_id"] if r["parent_id"] is not None else r["id"])]

        def near(x):
            if x["vector"] and r["vector"]:
                return cosine(x["vector"], r["vector"])
            a, b = grams(x["content"]), grams(r["content"])
            return len(a & b) / len(a | b) if a and b else 0.0

        if len(kept) >= limit:
            r["reason"] = WINDOW
        elif r["content"] == "Appendix 3" and r["kinds"] and all(k.lower() == "heading" for k in r["kinds"]):
            r["reason"] = HEADING
        elif same:
            r["reason"], twin = DUPLICATE, same[0]
            for c in ("bm25", "dense", "graph"):
                if r[f"{c}_rank"] is not None and (twin[f"{c}_rank"] is None or r[f"{c}_rank"] < twin[f"{c}_rank"]):
                    twin[f"{c}_rank"], twin[f"{c}_score"] = r[f"{c}_rank"], r[f"{c}_score"]
            twin["graph_path"] = twin["graph_path"] or r["graph_path"] or twin["graph_path"]
            twin["exact"] |= r["exact"]
            twin["merged"] += 1
        elif not r["exact"] and top > 0 and r["rrf_score"] / top < share:
            r["reason"] = SCORE
        elif any(near(x) >= like for x in kin):
            r["reason"] = SIBLING
        else:
            r["reason"] = None
            kept.append(r)
    return {r["id"]: r for r in rows}


@pytest.mark.parametrize("limit", [5, 40])
def test_against_a_plain_walk(spark, limit):
    rng = random.Random(limit)
    rows = {q: made(rng, q, 60) for q in range(6)}
    frame = spark.createDataFrame([r for group in rows.values() for r in group], SCHEMA)
    got = fold_candidates(frame, "q", "id", vector="vector", kinds="kinds", path="graph_path", limit=limit).collect()
    assert len(got) == 360
    seen = set()
    for r in got:
        want = plain(rows[r["q"]], limit)[r["id"]]
        seen.add(r["reason"])
        for c in ("reason", "merged", "bm25_rank", "bm25_score", "dense_rank", "graph_rank", "graph_score", "exact"):
            assert r[c] == want[c], (r["q"], r["id"], c)
        assert (r["graph_path"] or None) == (want["graph_path"] or None)
    assert seen >= ({None, HEADING, DUPLICATE, SCORE, SIBLING} if limit == 40 else {None, DUPLICATE, WINDOW})


def test_a_dropped_sibling_leaves_room_for_the_next(spark):
    rows = [(1, k, 7 if k < 30 else None, f"alpha beta gamma {'' if k else ' '}delta {k // 30}" if k < 30 else f"other text number {k}", 1.0 - k / 100, 1, None, None, None, None, None, None, None, False, [1.0, 0.0] if k < 30 else None, None) for k in range(60)]
    got = fold_candidates(spark.createDataFrame(rows, SCHEMA), "q", "id", vector="vector", limit=31).collect()
    kept = {r["id"] for r in got if r["reason"] is None}
    assert 0 in kept and kept >= set(range(30, 60)) and len(kept) == 31


def test_empty_frame_and_single_candidates(spark):
    assert fold_candidates(spark.createDataFrame([], SCHEMA), "q", "id").count() == 0
    one = made(random.Random(1), 1, 1)
    assert fold_candidates(spark.createDataFrame(one, SCHEMA), "q", "id").count() == 1
