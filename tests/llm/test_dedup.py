"""SimHash links, line dedup and multiset fingerprints against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docquarry.llm import blooms, fingerprint, linededup, media, simhash, similar
from docquarry.llm.components import components
from tests.llm.helpers import empty, pairs, table


def plain_fingerprint(text):
    found = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=4):
    parent = list(range(len(prints)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_against_brute_force(spark):
    docs = table(spark)
    rows = pairs(docs)
    prints = [plain_fingerprint(t) for _, t in rows]
    groups = plain_components(prints)
    least = defaultdict(list)
    for (i, _), g in zip(rows, groups):
        if i is not None:
            least[g].append(i)
    want = Counter((i, f"{p:016x}", min(least[g], default=None)) for (i, _), p, g in zip(rows, prints, groups))
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def test_simhash_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).collect() == []
    assert simhash.representatives(empty(spark)).collect() == []


@pytest.mark.parametrize("entry", [4096, 8])
def test_links_lose_nothing_also_in_crowded_entries(spark, entry):
    rng = np.random.default_rng(5)
    center = int(rng.integers(0, 2**63))
    prints = {center}
    for _ in range(300):  # neighbours of one centre, and of these
        f = center
        for b in rng.integers(0, 64, rng.integers(1, 7)):
            f ^= 1 << int(b)
        prints.add(f)
    prints |= {int(x) for x in rng.integers(0, 2**63, 200)}
    own = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in own], "fp long")
    linked = {r["node"]: r["root"] for r in components(simhash.links(df, simhash.SimhashConfig(entry=entry))).collect()}
    groups = plain_components(own)
    signed = [int(np.uint64(p).astype(np.int64)) for p in own]
    got = defaultdict(set)
    for s in signed:
        got[linked.get(s, s)].add(s)
    want = defaultdict(set)
    for s, g in zip(signed, groups):
        want[g].add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_representatives_keep_one_row_of_each_group(spark):
    docs = table(spark)
    rows = pairs(docs)
    groups = plain_components([plain_fingerprint(t) for _, t in rows])
    least = {}
    for (i, _), g in zip(rows, groups):
        least[g] = min(least.get(g, (True, 0)), (i is None, i or 0))
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(None if none else i for none, i in least.values())


@pytest.mark.parametrize("module", [simhash, similar])
def test_representatives_of_repeated_rows_and_null_ids(spark, module):
    one, two, three, four = ("alpha beta gamma delta epsilon zeta " * 3, "other words stand here in this text " * 3, "third text of words that nothing else has " * 3, "x y z " * 9)
    rows = [(1, one), (1, one), (4, one), (None, one), (None, two), (None, two), (None, three), (7, three), (None, four)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(module.representatives(docs).collect(), key=str) == sorted([(1, one), (None, two), (7, three), (None, four)], key=str)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(100, 99)], "u long, v long")
    assert {r["node"]: r["root"] for r in components(edges).collect()} == {**{k: 0 for k in range(1, 41)}, 100: 99}
    assert components(edges.limit(0)).collect() == []


def plain_lines(rows):
    strip = "\x20\t\n\x0b\x0c\r"
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(strip))
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(-(2**63) if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        own = -(2**63) if i is None else i
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 3 and max(holders[key(x)]) != own)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("bits", [1 << 24, 1 << 9])  # with a saturated filter, too
def test_lines_against_brute_force(spark, bits):
    docs = table(spark)
    got = linededup.dedup_lines(docs, linededup.LineConfig(least_bits=bits, most_bits=bits, slices=64))
    assert Counter(map(tuple, got.collect())) == plain_lines(pairs(docs))
    assert sum(k[2] * n for k, n in plain_lines(pairs(docs)).items()) > 3


def test_drop_lines_keeps_columns_and_nulls(spark):
    docs = table(spark)
    out = linededup.drop_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.filter("text IS NULL").count() == 1
    assert linededup.drop_lines(empty(spark)).collect() == []
    assert linededup.dedup_lines(empty(spark)).collect() == []


def test_key_counts_code_points():
    assert linededup.key_of("é".encode() * 19, 20) is None
    assert linededup.key_of(b"\x0b " + "É".encode() * 20 + b"\r", 20) == "É".encode() * 20


def test_vectors_are_homomorphic():
    a, b = b"one line here\nanother line there", b"third line"
    assert (fingerprint.vector(a) + fingerprint.vector(b)).hex() == fingerprint.vector(b + b"\n" + a).hex()
    assert (fingerprint.vector(a + b"\n" + b) - fingerprint.vector(b)).hex() == fingerprint.vector(a).hex()
    assert fingerprint.vector(b"another line there\none line here").hex() == fingerprint.vector(a).hex()
    assert fingerprint.vector(b"another line there\none line her").hex() != fingerprint.vector(a).hex()
    assert fingerprint.vector(b"x\nx").hex() != fingerprint.vector(b"x").hex()
    assert fingerprint.vector(b"").like(fingerprint.vector(b"")) == 1.0


def test_vectors_tell_unlike_texts_apart():
    for size in (1024, 4096):  # the Thue-Morse string and its complement: sums of bytes times powers modulo 2**k are equal
        bits = [bin(k).count("1") & 1 for k in range(size)]
        a, b = (bytes(97 + (x ^ flip) for x in bits) for flip in (0, 1))
        assert fingerprint.vector(a).hex() != fingerprint.vector(b).hex()
        assert (fingerprint.vector(a).exact != fingerprint.vector(b).exact).all()
        assert fingerprint.vector(a).like(fingerprint.vector(b)) < 1
    assert fingerprint.vector(b"a\n\nb").hex() != fingerprint.vector(b"a\nb").hex()  # an empty paragraph counts
    assert fingerprint.vector(b"\na").hex() == fingerprint.vector(b"a\n").hex()
    lanes = np.stack([fingerprint.vector(f"p{k}".encode()).exact for k in range(200)])
    assert lanes.shape[1] == 8 and np.linalg.matrix_rank(lanes.astype(float)) == 8  # no lane follows from the others


def test_edits_are_deletions_and_insertions():
    texts = [b"", b"a", b"\n", b"a\n", b"\n\nb", b"one two\nthree four\nfive six seven eight", "é\nü ß\n日本 語\n".encode(), b"x\n" * 9]
    for text in texts:
        for after in texts:
            _, changed, same = fingerprint.edit(text, after)
            assert changed[:same] == text[:same]
            assert fingerprint.changed_vector(text, fingerprint.vector(text), changed, same).hex() == fingerprint.vector(changed).hex()


def test_word_hashes_differ():
    found = [bytes([x]) * n for x in (0, 1, 97, 255) for n in (1, 2, 3, 31, 32, 33, 500)] + [b"ab", b"ba", b"aab", b"aba"]
    raw = np.frombuffer(b" ".join(found), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    first = ends - [len(w) for w in found]
    assert len(set(fingerprint.word_hashes(raw, first, ends).tolist())) == len(found)
    alone = [fingerprint.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] for w in found]
    assert alone == fingerprint.word_hashes(raw, first, ends).tolist()


def test_edited_against_brute_force(spark):
    docs = table(spark)
    rows = sorted(pairs(docs), key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode()))
    want = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        n = len(t)
        want.append((i, n, hashlib.sha256((t[: n - n // 4] + after[: n // 4]).encode()).hexdigest()))
    got = fingerprint.edited(docs).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == Counter(want)
    by = defaultdict(set)
    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add(t or "")
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        for t in texts[r["doc_id"]]:
            by[t].add(r["fingerprint"])
    assert all(len(f) == 1 for f in by.values())


def test_edited_of_one_and_none(spark):
    one = table(spark, ["abcd efgh"]).filter("doc_id IS NOT NULL").limit(1)
    (row,) = fingerprint.edited(one).collect()
    assert row["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest()
    assert fingerprint.edited(empty(spark)).collect() == []


def test_likeness_follows_the_share_of_equal_windows():
    rng = np.random.default_rng(1)
    lines = [" ".join(f"w{x}" for x in rng.integers(0, 9999, 12)) for _ in range(200)]
    a = fingerprint.vector("\n".join(lines).encode())
    half = fingerprint.vector("\n".join(lines[:150] + [" ".join(f"u{x}" for x in rng.integers(0, 9999, 12)) for _ in range(50)]).encode())
    other = fingerprint.vector("\n".join(" ".join(f"v{x}" for x in rng.integers(0, 9999, 12)) for _ in range(200)).encode())
    assert a.like(half) > 0.5 and a.like(other) < 0.3


@pytest.mark.parametrize("lines", [5, 40, 400])
def test_few_lone_lines_are_suspected_however_many_a_document_has(spark, lines):
    """The filters are sized by lines: of lines that stand alone, under a twentieth reach the shuffle."""
    docs = spark.range(1, 40_000 // lines).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(lines)), lambda k: F.concat(F.lit("a line of its own, number "), F.col("id"), F.lit(" "), k)), "\n").alias("text"))
    config = linededup.LineConfig(least_bits=1 << 10)
    bits = blooms.filter_bits(linededup.lines_at_most(docs, 20), config.bits_per_key, config.least_bits, config.most_bits)
    twice = blooms.twice_seen(linededup.narrow(docs), 1, lambda text: linededup.digests(text, 20), bits, config.slices)
    keys = [linededup.digest(f"a line of its own, number {i} {k}".encode()) for i in range(1, 40_000 // lines) for k in range(1, lines + 1)]
    assert blooms.suspected(keys, twice, bits).mean() < 0.05


@pytest.mark.parametrize("size", [1_000, 100_000])
def test_few_lone_chunks_are_suspected_however_long_a_text_is(spark, size):
    rng = random.Random(size)
    texts = [rng.randbytes(size // 2).hex() for _ in range(2_000_000 // size)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    _, table = media.store(docs, media.MediaConfig(least_bits=1 << 8))
    config = media.MediaConfig()
    there = sum(len(media.chunks(media.payload_of(t.encode(), config.frame), config)) for t in texts)
    assert table.count() < 0.05 * there + 2
