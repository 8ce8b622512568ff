"""Language identification in two levels: the family first, then one-versus-one linear support vector machines within it.

Learned from a bounded sample of labelled rows (`LanguageConfig.sample`, documented bound: the rows with the smallest
hashes of doc_id, so many of each language); every document is scored over its whole text.

Defined cases: a null text, or one without a letter of any script, is `und` with score 0; null labels aren't learned
from; with no labelled row every text is `und`; with one language every text with letters has that one; repeated rows
get equal predictions; an empty table gives an empty result. Only doc_id, text and lang are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import flat, text_bytes
from docquarry.llm.grams import counted

#: Families of language codes. A code that isn't named is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "sr", "hr", "bs", "sl", "mk", "cs", "sk", "pl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
UNKNOWN = "und"
ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass(frozen=True)
class LanguageConfig:
    #: Labelled rows learned from, of each language, and languages: the bound of what the driver holds.
    sample: int = 400
    languages: int = 64
    bits: int = 12
    rounds: int = 300
    ridge: float = 1e-3


def fold() -> np.ndarray:
    """A byte's class: letters in lower case, bytes of other scripts as they are, anything else a space."""
    table = np.full(256, 32, np.uint8)
    table[128:] = np.arange(128, 256)
    for c in range(26):
        table[65 + c] = table[97 + c] = 97 + c
    return table


FOLD = fold()


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "ignore"))


def shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


def separator(x: np.ndarray, y: np.ndarray, rounds: int, ridge: float) -> np.ndarray:
    """A linear SVM with squared hinge loss (weights, then the bias) for y of +1 and -1, by accelerated gradient steps. Both classes weigh alike."""
    n, d = x.shape
    weigh = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    wide = np.hstack([x, np.ones((n, 1), np.float32)])
    rate = 1 / (2 * (weigh * (wide**2).sum(1)).sum() + ridge)
    w = look = np.zeros(d + 1, np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (wide @ look))
        slope = -2 * (weigh * slack * y) @ wide + ridge * np.append(look[:-1], 0)
        w, before = look - rate * slope, w
        look = w + k / (k + 3) * (w - before)
    return w


@dataclass
class LanguageModel:
    """classes of the first level, and of each of them its languages; scale and the stacked separators as one matrix."""

    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, int, int]]  # (family or "" for the first level, class a, class b), a column of weights each
    weights: np.ndarray
    bits: int

    def votes(self, margins: np.ndarray, family: str, n: int) -> np.ndarray:
        """The probabilities of n classes: products of the pairwise logistic margins, normalised."""
        out = np.zeros((len(margins), n))
        for k, (own, a, b) in enumerate(self.pairs):
            if own == family:
                z = np.clip(4 * margins[:, k], -30, 30)
                out[:, a] -= np.log1p(np.exp(-z))
                out[:, b] -= np.log1p(np.exp(z))
        out = np.exp(out - out.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = shares(counts) @ self.weights[:-1] + self.weights[-1]
        first = self.votes(margins, "", len(self.families))
        family, langs, scores = first.argmax(1), np.full(len(counts), UNKNOWN, object), np.zeros(len(counts))
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            if len(rows):
                inner = self.votes(margins[rows], name, len(self.members[name]))
                best = inner.argmax(1)
                langs[rows] = np.array(self.members[name], object)[best]
                scores[rows] = first[rows, f] * inner[np.arange(len(rows)), best]
        return list(langs), scores


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, config: LanguageConfig = LanguageConfig()) -> LanguageModel | None:
    """Learn from the rows that aren't held out. Null where no row has a label."""
    pool = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("__dq_h", "doc_id"))
    # a few hashes' worth of rows for each language and part of the input, then the smallest of them all
    dealt = pool.withColumn("__dq_h", F.xxhash64("doc_id")).withColumn("__dq_part", F.pmod("__dq_h", F.lit(997)))
    near = dealt.withColumn("__dq_r", F.row_number().over(Window.partitionBy("lang", "__dq_part").orderBy("__dq_h", "doc_id"))).filter(F.col("__dq_r") <= config.sample)
    ids = near.withColumn("__dq_r", rank).filter(F.col("__dq_r") <= config.sample).select(F.col("doc_id").alias("__dq_id"), F.col("lang").alias("__dq_lang"), "__dq_r")
    ids = ids.orderBy("__dq_r", "__dq_lang").limit(config.sample * config.languages).dropDuplicates(["__dq_id"])  # so many rows at most: small enough to broadcast
    picked = docs.join(F.broadcast(ids), (docs["doc_id"] == ids["__dq_id"]) & (docs["lang"] == ids["__dq_lang"])).select("doc_id", "lang", docs["text"].cast("binary").alias("text"))
    bits = config.bits

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = flat(batch.column("text"))
            rows = [r.astype(np.float16).tobytes() for _, _, c in counted(FOLD[raw], offsets, bits) for r in shares(c) * 64]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(rows, pa.binary())], ["doc_id", "lang", "x"])

    rows = picked.mapInArrow(features, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, x binary")
    rows = rows.groupBy("doc_id", "lang").agg(F.min("x").alias("x")).collect()  # a row for each id and language: the sample's bound
    rows.sort(key=lambda r: (r["doc_id"], r["lang"]))
    if not rows:
        return None
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32) / 64
    langs = np.array([r["lang"] for r in rows], object)
    scale = 1 / (np.sqrt((x**2).mean(0)) + 1e-4)
    scale /= np.sqrt(((x * scale) ** 2).sum(1).mean())
    x = x * scale
    members: dict[str, list[str]] = {}
    for code in sorted(set(langs)):
        members.setdefault(FAMILY.get(code, f"own-{code}"), []).append(code)
    families = sorted(members)
    of = np.array([families.index(FAMILY.get(c, f"own-{c}")) for c in langs])
    pairs, columns = [], []

    def compare(family: str, a: int, b: int, is_a: np.ndarray, is_b: np.ndarray) -> None:
        use = is_a | is_b
        pairs.append((family, a, b))
        w = separator(x[use], np.where(is_a[use], 1, -1).astype(np.float32), config.rounds, config.ridge)
        columns.append(np.append(w[:-1] * scale, w[-1]))

    for a in range(len(families)):
        for b in range(a + 1, len(families)):
            compare("", a, b, of == a, of == b)
    for name in families:
        own = members[name]
        for a in range(len(own)):
            for b in range(a + 1, len(own)):
                compare(name, a, b, langs == own[a], langs == own[b])
    weights = np.stack(columns, 1).astype(np.float32) if columns else np.zeros(((1 << bits) + 1, 0), np.float32)
    return LanguageModel(families, members, pairs, weights, bits)


def predict(docs: DataFrame, model: LanguageModel | None, *keep: str, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`keep` columns of every row, the text among them where named, and the language and score under `names`."""
    frame = text_bytes(docs, *[c for c in keep if c != "text"])
    given = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given) + f", {names[0]} string, {names[1]} double"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column("text")
            raw, offsets = flat(texts)
            raw_bytes = memoryview(raw)
            langs, scores = [], []
            if own is None:
                langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            else:
                for _, _, counts in counted(FOLD[raw], offsets, own.bits):
                    got, sure = own.predict(counts)
                    langs += got
                    scores += sure.tolist()
            for i in range(len(texts)):
                piece = raw_bytes[offsets[i] : offsets[i + 1]]
                if not (ASCII_LETTER.search(piece) or has_letter(bytes(piece))):
                    langs[i], scores[i] = UNKNOWN, 0.0
            columns = [texts.cast(pa.string()) if c == "text" else batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, *names])

    return frame.mapInArrow(run, schema)


def identify(docs: DataFrame, config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, by a model learned from the labels of `docs`."""
    out = predict(docs, fit(docs, config), "doc_id")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, config: LanguageConfig = LanguageConfig(), least: float = 0.0) -> DataFrame:
    """The rows of `docs` whose language is recognised: not `und`, and with a score of `least` or more."""
    out = predict(docs, fit(docs, config), *docs.columns, names=("__dq_lang", "__dq_sure"))
    return out.filter((F.col("__dq_lang") != UNKNOWN) & (F.col("__dq_sure") >= least)).select(*docs.columns)
