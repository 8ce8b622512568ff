"""The pipeline's rows against a plain version of its stages."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from docquarry.llm import mixing, pieces
from tests.llm.helpers import words
from tests.llm.test_dedup import plain_components, plain_fingerprint

WORD = "[^\x20\x09-\x0d]+"


def documents():
    rng = random.Random(21)
    base = " ".join(words(rng, 150))
    near = base.split()
    near[-1] = "other"
    line = "a line that comes again and again in this corpus"
    texts = [base, base, " ".join(near), "12 34 %%", "", None] + [f"{line}\n{' '.join(words(rng, 40))}" for _ in range(6)] + [" ".join(words(rng, rng.randint(1, 60))) for _ in range(60)]
    return [(k, t, "en", f"s{k % 4}" if k % 9 else None, len(t or "")) for k, t in enumerate(texts)]


def plain_targets(sizes):
    """Shares by weight; what is above twice a source's size is shared again by weight, until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), dict.fromkeys(order, 0.0)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        share, left = {s: left * weight[s] / total for s in open_}, 0.0
        for s, x in share.items():
            target[s] += x
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return order, target


def number(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def plain_draws(plan, config=mixing.MixConfig()):
    """Slots that each rank draws: plan has (slots, blocks) by rank. A round draws three quarters of what is left, by what ranks lack."""
    total, got = sum(slots for slots, _ in plan), [0] * len(plan)
    for k in range(config.rounds):
        low, high = total - (total >> 2 * k), total if k == config.rounds - 1 else total - (total >> 2 * k + 2)
        lack = [max(0, slots - g) for (slots, _), g in zip(plan, got)]
        drew = Counter()
        for i in range(low, high):
            spot = number(config.seed, i) % sum(lack)
            rank = 0
            while spot >= lack[rank]:
                spot -= lack[rank]
                rank += 1
            drew[rank] += 1
        got = [min(g + drew[r], 2 * blocks) for r, (g, (_, blocks)) in enumerate(zip(got, plan))]
    return got


def plain_mix(rows):
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(re.findall(WORD, t))
    order, target = plain_targets(sizes)
    block, out = mixing.MixConfig().block_words, []
    blocks = [-(-sizes[s] // block) for s in order]
    drew = plain_draws([(min(2 * n, int(n * target[s] / sizes[s] + 0.5)) if n else 0, n) for s, n in zip(order, blocks)])
    for rank, (s, n, slots) in enumerate(zip(order, blocks, drew)):
        own = sorted((r for r in rows if r[3] == s), key=lambda r: r[0])
        if not n:
            continue
        prime = mixing.PRIMES[number("mix", rank) % 4]
        times = Counter((prime % n * (q % n) + number("mix+", rank) % n) % n for q in range(slots))
        at = 0
        for i, t, _, s_, _ in own:
            parts = re.findall(f"{WORD}[\x20\x09-\x0d]*", t)
            held = [times[(at + k) // block] for k in range(len(parts))]
            at += len(parts)
            out += [(i, s_, text) for p in (1, 2) if (text := "".join(x for x, m in zip(parts, held) if m >= p))]
    return out


def test_run_against_a_plain_version(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    kept = [r for r in rows if r[1] is not None and any(c.isalpha() for c in r[1])]
    holders = defaultdict(set)
    for i, t, *_ in kept:
        for x in t.split("\n"):
            if len(x.strip()) >= 20:
                holders[x.strip().lower()].add(i)
    kept = [(i, "\n".join(x for x in t.split("\n") if len(holders[x.strip().lower()]) < 3 or max(holders[x.strip().lower()]) == i), *r) for i, t, *r in kept]
    groups = plain_components([plain_fingerprint(t) for _, t, *_ in kept])
    first = {}
    for r, g in zip(kept, groups):
        first[g] = min(first.get(g, r[0]), r[0])
    kept = [r for r in kept if r[0] in first.values()]
    lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    want = Counter((i, s, tuple(lib.encode(t))) for i, s, t in plain_mix(kept))
    got = Counter((r["doc_id"], r["source"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and len(kept) < len(rows) - 3


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).collect() == []
