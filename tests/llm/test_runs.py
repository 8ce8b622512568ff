"""Periodic runs against a search that tries every period and place."""

import hashlib
import random
import zlib

import pytest

from docquarry.llm.queries import QUERIES
from docquarry.llm.runs import RunConfig, batch_summaries, maximal_runs, planted, runs
from tests.llm.helpers import empty, table


def tried(words, least=6, periods=4):
    """start, length, period of all maximal runs that are long enough."""
    best = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                best.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted(((s, e - s, q) for (s, e), q in best.items() if e - s >= max(least, periods * q)), key=lambda r: (r[0], r[2]))


def plain(words, **least):
    found = tried(words, **least)
    lost = {k for s, n, q in found for k in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    said = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(w for k, w in enumerate(words) if k not in lost)
    return (len(found), *best, None if not found else 1000 * best[1] // best[2], hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def edited(doc_id, text):
    words = split(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_batches_against_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 5)):
            words = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(rng.randint(0, 40))]
            if words and rng.random() < 0.5:
                at, unit = rng.randint(0, len(words)), words[: rng.randint(1, 5)]
                words[at:at] = unit * rng.randint(2, 8)
            texts.append(words)
        for least, periods in ((6, 4), (2, 2)):
            got = batch_summaries([" ".join(t).encode() for t in texts], RunConfig(least, periods))
            assert got == [plain(t, least=least, periods=periods) for t in texts]


@pytest.mark.parametrize("text", [b"", b"one", b"all of these differ", b"two two", b"\xc3\xa9 \xc3\xa9 \xc3\xa9 \xc3\xa9 \xc3\xa9 \xc3\xa9"])
def test_short_texts(text):
    assert batch_summaries([text], RunConfig()) == [plain(split(text.decode()))]


def test_no_texts():
    assert batch_summaries([], RunConfig()) == []
    assert all(not len(x) for x in maximal_runs(__import__("numpy").zeros(0, "int64")))


def test_long_periodic_texts_in_little_time():
    words = [str(k % 1777) for k in range(200_000)]
    (n, start, length, period, milli, _, _), = batch_summaries([" ".join(words).encode()], RunConfig())
    assert (n, start, length, period, milli) == (1, 0, 200_000, 1777, 1000 * 200_000 // 1777)
    (one,) = batch_summaries([b"a " * 300_000], RunConfig())
    assert one[:5] == (1, 0, 300_000, 1, 300_000_000)


def test_ties_go_to_the_first_run():
    (one,) = batch_summaries([b"a a a a a a x b b b b b b"], RunConfig())
    assert one[:4] == (2, 0, 6, 1)


def test_awkward_rows(spark):
    docs = table(spark)
    got = runs(docs, "doc_id", text=planted())
    rows = {(r["doc_id"], r["collapsed_sha256"]): r for r in got.collect()}
    given = docs.select("doc_id", "text").collect()
    assert got.count() == len(given)
    for r in given:
        want = plain(edited(r["doc_id"], r["text"]))
        assert tuple(rows[r["doc_id"], want[-1]])[1:] == want
    assert runs(empty(spark), "doc_id", "key").columns[:3] == ["doc_id", "key", "n_runs"]
    assert runs(empty(spark), "doc_id").count() == 0


def test_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_periodic_runs"](spark, folder).collect()}
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert got.keys() == given.keys()
    few = {k: t for k, t in given.items() if len(split(t)) < 3000}
    assert len(few) > 0.9 * len(given)
    for k, text in few.items():
        words = edited(k, text)
        if len(words) < 800 or zlib.crc32(str(k).encode()) % 10 == 0:
            assert got[k] == plain(words)
    assert sum(v[0] for v in got.values()) > 0
