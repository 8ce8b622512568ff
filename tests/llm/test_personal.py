"""Personal data: the fixed patterns against a plain reading of them, and identifiers found by their contexts."""

import hashlib
import random
import re
import time

import pytest

from docquarry.llm.personal import KINDS, base, candidates, contexts, find_personal, learned, luhn, scanned
from docquarry.llm.queries import QUERIES
from tests.llm.helpers import SCHEMA, empty, table
from pyspark.sql import functions as F

MAIL, QUAD = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    text = text or ""

    def count(m):
        return sum(c in "0123456789" for c in m[0])

    out = [(m.start(), 0, m.end()) for m in MAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in QUAD.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= count(m) <= 19 and luhn(re.sub(r"[ -]", "", m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= count(m) <= 15]
    return sorted(out)


def said(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def card(rng, n=16):
    head = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(head + d for d in "0123456789" if luhn(head + d))


@pytest.mark.parametrize("number,right", [("4111111111111111", True), ("4111111111111112", False), ("79927398713", True), ("0", True)])
def test_checksum(number, right):
    assert luhn(number) is right


def test_fixed_patterns_against_a_plain_reading():
    rng = random.Random(11)
    bits = ["a@b.co", "x.y+z@mail5.example.com", "@", "a@b", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8.9", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+12", "++49 30 1234567", "é", "日", ".", "-", " ", "\n", "9", "00", "+", "_", "%", "a"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert base(text) == plain(text), text


@pytest.mark.parametrize("unit", ["1", "1.", "a", "a.", "a@", "@", "+1", "+1 ", "+1(", "1 ", "1-", "0:", ":", "(at)", "a[at]b", "AB1", "1.1.1.1", "(", "é"])
def test_time_is_linear_in_hostile_texts(unit):
    began = time.perf_counter()
    text = unit * (300_000 // len(unit))
    candidates(text, base(text))
    assert time.perf_counter() - began < 4


def test_candidates_do_not_overlap_spans_or_each_other():
    text = "call 020 7946 0958 or +44 20 7946 0958, card 4111 1111 1111 1112, jane (at) corp (dot) org, bob@localhost, fe80:0:0:0:1:2:3:4, AB123456C, 300.1.2.3"
    spans = base(text)
    found = candidates(text, spans)
    assert {text[a:b] for a, b, _ in found} >= {"020 7946 0958", "4111 1111 1111 1112", "jane (at) corp (dot) org", "bob@localhost", "fe80:0:0:0:1:2:3:4", "AB123456C", "300.1.2.3"}
    edges = sorted([(a, b) for a, b, _ in found] + [(a, b) for a, _, b in spans])
    assert all(x[1] <= y[0] for x, y in zip(edges, edges[1:]))


def test_contexts_are_the_words_before_in_the_line():
    assert contexts("First line\nPlease Call me at: +1", 30) == ["at :", "me at :", "call me at :"]
    assert contexts("one +1", 4) == []
    assert contexts("x" * 1000 + " a b +1", 1005) == ["a b"]


def corpus(rng, n=60):
    """Seeds behind `reach me at`, numbers behind the same words, and numbers behind words that stand anywhere."""
    rows = []
    for k in range(n):
        filler = " ".join(rng.choice(["alpha beta", "of the", "gamma of the", "and for"]) for _ in range(40))
        phone = "".join(rng.choice("0123456789") for _ in range(7))
        rows.append(f"{filler} reach me at +1 555 {phone} {filler} of the +1 444 {phone}")
        if k % 6 == 0:
            rows.append(f"{filler} reach me at (555) {phone} {filler}")
        if k % 10 == 0:
            rows.append(f"{filler} of the 9{phone}1 {filler}")
        if k % 7 == 0:
            rows.append(f"My card number is {card(rng)} {filler}\nMy card number is 41111111{phone[:5]}111 and")
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", "a", 0, 0, 0.0, "", 0, "", "", "", 0.0) for k, t in enumerate(rows)], SCHEMA)


def test_identifiers_behind_learned_patterns(spark):
    rng = random.Random(2)
    rows = corpus(rng)
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in find_personal(docs).collect()}
    for k, text in enumerate(rows):
        spans, first = got[k]["spans"].split(","), plain(text)
        assert set(said(first).split(",")) - {""} <= set(spans)
        m = re.search(r"reach me at (\(555\) [0-9]{7})", text)
        if m:
            assert f"phone:{m.start(1)}:{m.end(1)}" in spans
        m = re.search(r"of the (9[0-9]{8})", text)
        if m:
            assert not any(x.endswith(f":{m.start(1)}:{m.end(1)}") for x in spans)
        for m in re.finditer(r"number is ([0-9]{16})", text):
            assert f"card:{m.start(1)}:{m.end(1)}" in spans


def test_scores_against_a_plain_count(spark):
    rows = corpus(random.Random(4), 40)
    docs = frame(spark, rows)
    mentions = scanned(docs).select(F.explode("mentions").alias("m")).select("m.*")
    got = {(r["pattern"], r["kind"]): r["score"] for r in learned(docs, mentions).collect()}
    edges, totals = {}, {}
    for text in rows:
        spans = base(text)
        for a, b, kinds, seed in [(a, b, [k], True) for a, k, b in spans] + [(a, b, ks, False) for a, b, ks in candidates(text, spans)]:
            for k in kinds:
                digits = re.sub("[^0-9]", "", text[a:b])
                for p in contexts(text, a):
                    edges.setdefault((p, k), []).append((digits[-10:] if k == 3 else digits, seed))
        for line in text.lower().split("\n"):
            words = re.findall(r"[a-z0-9_]+|[^\s\w]", re.sub("[0-9]", "0", line))
            for n in (2, 3, 4):
                for i in range(len(words) - n + 1):
                    p = " ".join(words[i : i + n])
                    totals[p] = totals.get(p, 0) + 1
    edges = {p: e for p, e in edges.items() if len({v for v, s in e if s}) >= 3}
    seeds = {(k, v) for (p, k), e in edges.items() for v, s in e if s}
    conf = dict.fromkeys(seeds, 1.0)
    for _ in range(3):
        score = {p: min(1.0, sum(conf.get((p[1], v), 0.0) for v, _ in e) / (totals[p[0]] + 1)) for p, e in edges.items()}
        score = {p: s for p, s in score.items() if round(s, 9) >= 0.5}
        conf = dict.fromkeys(seeds, 1.0)
        for p, s in score.items():
            for v, _ in edges[p]:
                conf[p[1], v] = max(conf.get((p[1], v), 0.0), s)
    assert got and got.keys() == score.keys()
    assert all(abs(got[p] - score[p]) < 1e-6 for p in got)


def test_copies_of_one_text_are_one_seed(spark):
    rows = ["write to us at +1 555 1234567 now"] * 50 + ["write to us at 5559876543 now"]
    got = find_personal(frame(spark, rows)).collect()
    assert sum(r["n_found"] for r in got) == 0


def test_awkward_rows(spark):
    docs = table(spark)
    got = sorted(find_personal(docs).collect(), key=str)
    assert len(got) == docs.count()
    assert {r["n_found"] for r in got} == {0}
    assert {r["spans"] for r in got} == {""} and {r["base_sha256"] for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert find_personal(empty(spark)).count() == 0


def test_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op13_personal_data"](spark, folder).collect()}
    given = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(given)
    for r in given:
        spans, mine = plain(r["text"]), got[r["doc_id"]]
        assert [mine[f"n_{k}"] for k in KINDS] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert mine["base_sha256"] == hashlib.sha256(said(spans).encode()).hexdigest()
        assert set(said(spans).split(",")) <= set(mine["spans"].split(","))
        assert mine["n_found"] == len([x for x in mine["spans"].split(",") if x]) - len(spans)
    assert sum(r["n_email"] for r in got.values()) > 0
