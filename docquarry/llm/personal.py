"""Personal data: fixed patterns, and identifiers that stand where such data stands (bootstrapped contextual extraction).

Seeds are the matches of the fixed patterns. Each induces lexical patterns: the two, three and four words before it in its
line (in lower case, digits as 0, punctuation a word by itself), for its kind. Other stretches that could be an identifier of
a kind are candidates: numbers without a country code or a right checksum, addresses without a dot or spelled out, hexadecimal
addresses, codes of letters and digits. Patterns and the values that stand behind them (instances) make a graph, whose edges
Spark counts. A second pass counts how often the words of each pattern stand anywhere, whatever follows. Then, round after round,

* a pattern's score is the share of its occurrences that are followed by an instance, each by its confidence, if enough
  different seeds stand behind it;
* an instance's confidence is the best score of its patterns; a seed has 1.

Candidates behind a pattern of the last round's score or more become spans of the pattern's kind. Words that stand before
anything (`of the`) have a low score whatever seeds follow them now and then; copies of one text count as one seed.

Kinds, in the order in which spans of one start are listed: email, ip, card, phone. Starts and ends are in code points,
ends exclusive. The fixed patterns match leftmost and without overlaps, a kind by itself; what fails its kind's test is dropped
after matching. A candidate overlaps no span of the fixed patterns, and is listed once, as the kind of its best pattern.

Defined cases: a null text is an empty one; repeated rows have equal spans; contexts reach back 400 characters at most; a table
without seeds gets no further spans; an empty table gives an empty result. doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import bounded_batches, materialize, named_rows
from docquarry.llm.phrases import MARK, Passed, bit_count, bitmap, coded, hashed, numbered, places

KINDS = ("email", "ip", "card", "phone")
#: The patterns and their bounds.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = {"card": (14, 19), "phone": (10, 15)}

#: What a candidate looks like, and how many digits make it one of a kind.
NUMBER = re.compile(r"\(?[0-9](?:[\x20().\-/]{0,2}[0-9])++")
HEXADECIMAL = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
CODE = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{1,6}-?[0-9]{4,}[A-Za-z0-9-]*+")
SPELLED = re.compile(r"\x20?[\[(]\x20?at\x20?[\])]\x20?(?=[A-Za-z0-9])", re.IGNORECASE)
SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?)[A-Za-z0-9-]++)+", re.IGNORECASE)
BARE_DOMAIN = re.compile(r"[A-Za-z0-9-]++")
LIKE = {"card": (12, 19), "phone": (7, 15)}

#: Words of a pattern; characters that it reaches back.
SIZES, REACH = (2, 3, 4), 400
PLAIN = bytes(MARK if b in (10, 11, 12, 13) else 32 if b == 9 else 48 if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in range(256))
SINGLE = np.array([b < 128 and not chr(b).isalnum() and b not in (32, 95) or b == MARK for b in range(256)])
TOKEN = re.compile(rb"[0-9a-z_\x80-\xfe]+|[^\x20\xff]")


@dataclass(frozen=True)
class PersonalConfig:
    rounds: int = 3
    #: Different seeds behind a pattern, and the score from which it finds candidates.
    least_seeds: int = 3
    least_score: float = 0.5
    #: Parts that a frequent pattern's edges, or a frequent value's, are dealt into.
    salts: int = 16


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Mail addresses: from each @ to the left as far as characters go, to the right a domain with a dot."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the fixed patterns."""
    out = [(a, 0, b) for a, b in addresses(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p[-3:]) <= 255 and not p[:-3].strip("0") for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= DIGITS["card"][0]:
            digits = digits_of(m[0])
            if DIGITS["card"][0] <= len(digits) <= DIGITS["card"][1] and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if DIGITS["phone"][0] <= len(digits_of(m[0])) <= DIGITS["phone"][1]]
    return sorted(out)


def value_of(kind: int, text: str) -> bytes:
    """What stands for an identifier in the graph: a digest of it, of a phone's last ten digits, of a card's digits."""
    if KINDS[kind] in LIKE:
        digits = digits_of(text)
        text = (digits[-10:] if KINDS[kind] == "phone" else digits) if not any(c.isalpha() for c in text) else text.upper()
    else:
        text = re.sub(r"\x20?[\[(]\x20?(at|dot)\x20?[\])]\x20?", lambda m: "@" if m[1].lower() == "at" else ".", text, flags=re.IGNORECASE).lower()
    return hashlib.blake2b(f"{kind}:{text}".encode(), digest_size=16).digest()


def mailish(text: str) -> Iterator[tuple[int, int]]:
    """Addresses that lack a dot, or are spelled out."""
    done = 0
    signs = [(m.start(), m.end(), SPELLED_DOMAIN) for m in SPELLED.finditer(text)] if "at" in text or "AT" in text or "At" in text else []
    at = text.find("@")
    while at >= 0:
        signs.append((at, at + 1, BARE_DOMAIN))
        at = text.find("@", at + 1)
    for at, after, right in sorted(signs):
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = right.match(text, after) if start < at else None
        if domain:
            done = domain.end()
            yield start, done


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, list[int]]]:
    """(start, end, kinds) of what could be an identifier and overlaps no span: leftmost, longest, without overlaps."""
    found = [(a, b, [0]) for a, b in mailish(text)]
    for m in NUMBER.finditer(text):
        if m.end() - m.start() >= LIKE["phone"][0]:
            n = len(digits_of(m[0]))
            quad = m[0].count(".") == 3 and n <= 12
            kinds = [1] * quad + [2] * (LIKE["card"][0] <= n <= LIKE["card"][1]) + [3] * (LIKE["phone"][0] <= n <= LIKE["phone"][1])
            if kinds:
                found.append((m.start(), m.end(), kinds))
    found += [(m.start(), m.end(), [2, 3]) for m in CODE.finditer(text)]
    if "::" in text or text.count(":") > 3:
        found += [(m.start(), m.end(), [1]) for m in HEXADECIMAL.finditer(text)]
    out, taken, done = [], iter([*sorted((a, b) for a, _, b in spans), (len(text) + 1, len(text) + 1)]), 0
    held = next(taken)
    for a, b, kinds in sorted(found, key=lambda x: (x[0], -x[1])):
        while held[1] <= a:
            held = next(taken)
        if a >= done and b <= held[0]:
            out.append((a, b, kinds))
            done = b
    return out


def contexts(text: str, start: int) -> list[str]:
    """The patterns before a place."""
    low = max(0, start - REACH)
    before = text[low:start].encode("utf-8", "replace").translate(PLAIN)
    tokens = TOKEN.findall(before[before.rfind(bytes([MARK])) + 1 :])
    if low and bytes([MARK]) not in before:
        tokens = tokens[1:]  # perhaps cut
    return [b" ".join(tokens[-size:]).decode("utf-8", "replace") for size in SIZES if len(tokens) >= size]


FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int8()), ("seed", pa.bool_()), ("value", pa.binary()), ("patterns", pa.list_(pa.string()))]))
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int8()), ("end", pa.int64())]))
FOUND_KIND = "array<struct<start: long, end: long, kind: byte, seed: boolean, value: binary, patterns: array<string>>>"
COLUMNS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start: long, kind: byte, end: long>>"


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scanned(docs: DataFrame) -> DataFrame:
    """Of each row: the counts, digest and spans of the fixed patterns, and its mentions (seeds and candidates) with their patterns."""
    bounded_batches(docs.sparkSession)
    keys = ("doc_id", "__dq_file", "__dq_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(3):
                text = text.as_py() or ""
                spans = base(text)
                mentions = [{"start": a, "end": b, "kind": k, "seed": True, "value": value_of(k, text[a:b]), "patterns": contexts(text, a)} for a, k, b in spans]
                for a, b, kinds in candidates(text, spans):
                    before = contexts(text, a)
                    mentions += [{"start": a, "end": b, "kind": k, "seed": False, "value": value_of(k, text[a:b]), "patterns": before} for k in kinds if before]
                kinds = [k for _, k, _ in spans]
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(listed(spans).encode()).hexdigest(), [{"start": a, "kind": k, "end": b} for a, k, b in spans], mentions))
            types = (*[pa.int64()] * 4, pa.string(), SPANS, FOUND)
            names = [*keys, *(c.split()[0] for c in COLUMNS.split(", ")[:6]), "mentions"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names)

    ident = docs.schema["doc_id"].dataType.simpleString()
    named = named_rows(docs.select("doc_id", "text"))
    return named.select(*keys, "text").mapInArrow(run, f"doc_id {ident}, __dq_file long, __dq_row long, {COLUMNS}, mentions {FOUND_KIND}")


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, total: how often the words of each pattern stand in the texts, whatever follows."""
    bits = bit_count(patterns)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(patterns.withColumn("none", F.lit("")), bits, "none", "pattern"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed, mark = Passed(shared.value, bits), bytes([MARK])
        for batch in batches:
            raw = np.frombuffer(mark.join([*(t for t in batch.column(0).to_pylist() if t), b""]).translate(PLAIN), np.uint8)
            if not len(raw):
                continue
            codes, words = coded(raw, SINGLE[raw])
            for size in SIZES:
                place = places(codes, size)
                place = place[passed(hashed(codes, words, place, size))]
                if len(place):
                    rank = codes[place]
                    for k in range(1, size):
                        rank = numbered(rank * len(words) + codes[place + k])[2]
                    first, n, _ = numbered(rank)
                    found = pc.binary_join_element_wise(*[words.take(pa.array(codes[place[first] + k])) for k in range(size)], b" ")
                    yield pa.RecordBatch.from_arrays([found.cast(pa.string()), pa.array(n, pa.int64())], ["pattern", "n"])

    texts = docs.select(F.col("text").cast("binary").alias("text"))
    counted = texts.mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("total"))
    return counted.join(patterns.select("pattern"), "pattern", "left_semi")


def salted(left: DataFrame, right: DataFrame, keys: list[str], deal: str, salts: int, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a key: rows of a frequent key are dealt by the column `deal`, and each part meets its own copy."""
    parts = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64(deal), F.lit(salts)).cast("int")).join(parts, [*keys, "__salt"], how).drop("__salt")


def learned(docs: DataFrame, mentions: DataFrame, config: PersonalConfig = PersonalConfig()) -> DataFrame:
    """pattern, kind, score: the patterns that find candidates. `mentions` has kind, seed, value, patterns."""
    edges = mentions.select("kind", "seed", "value", F.explode("patterns").alias("pattern")).groupBy("pattern", "kind", "value").agg(F.max("seed").alias("here"), F.count("*").alias("n"))
    edges = materialize(edges)
    supported = edges.filter("here").groupBy("pattern", "kind").count().filter(F.col("count") >= config.least_seeds).drop("count")
    supported = materialize(supported)
    total = occurrences(docs, supported.select("pattern").distinct())
    supported = materialize(supported.join(total, "pattern"))
    edges = materialize(salted(edges, supported, ["pattern", "kind"], "value", config.salts))
    seeds = materialize(mentions.filter("seed").select("kind", "value").distinct().withColumn("conf", F.lit(1.0)))
    known, score = seeds, None
    for k in range(config.rounds):
        weighed = salted(edges, known, ["kind", "value"], "pattern", config.salts)
        share = F.least(F.lit(1.0), F.sum(F.col("n") * F.col("conf")) / (F.first("total") + 1))
        score = materialize(weighed.groupBy("pattern", "kind").agg(F.round(share, 9).alias("score")).filter(F.col("score") >= config.least_score))
        if k < config.rounds - 1:
            said = salted(edges, score, ["pattern", "kind"], "value", config.salts).groupBy("kind", "value").agg(F.max("score").alias("conf"))
            known = materialize(said.unionByName(seeds).groupBy("kind", "value").agg(F.max("conf").alias("conf")))
    return score


def discovered(mentions: DataFrame, score: DataFrame, config: PersonalConfig = PersonalConfig()) -> DataFrame:
    """__dq_file, __dq_row, more: the spans of candidates behind a learned pattern, each of its best pattern's kind."""
    open_at = mentions.filter("NOT seed").select("__dq_file", "__dq_row", "start", "end", "kind", F.explode("patterns").alias("pattern"))
    hits = open_at.withColumn("__deal", F.struct("__dq_file", "__dq_row"))
    hits = salted(hits, score, ["pattern", "kind"], "__deal", config.salts)
    best = hits.groupBy("__dq_file", "__dq_row", "start", "end").agg(F.min(F.struct((-F.col("score")).alias("s"), "kind")).alias("x"))
    return best.groupBy("__dq_file", "__dq_row").agg(F.collect_list(F.struct("start", "x.kind", "end")).alias("more"))


def find_personal(docs: DataFrame, config: PersonalConfig = PersonalConfig()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (all of them) and n_found (those that the method adds) of every document."""
    rows = materialize(scanned(docs))
    mentions = rows.select("__dq_file", "__dq_row", F.explode("mentions").alias("m")).select("__dq_file", "__dq_row", "m.*")
    more = discovered(mentions, learned(docs, mentions, config), config)
    joined = rows.drop("mentions").join(more, ["__dq_file", "__dq_row"], "left")
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(rows.schema["base"].dataType))))
    names = F.array(*[F.lit(k) for k in KINDS])
    said = F.transform(every, lambda s: F.concat_ws(":", F.get(names, s["kind"].cast("int")), s["start"], s["end"]))
    return joined.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(said, ",").alias("spans"), F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_found"))
