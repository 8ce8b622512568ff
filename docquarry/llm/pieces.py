"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

The words of a batch (a run of spaces and what follows it) are told apart once, and those of equal length advance
together: at each position, for each length of a last piece, the hash of the substring is looked up among the sorted
keys of the pieces, and a vectorised maximum over the lengths keeps the best score and a backpointer. For a unigram
model a step scores the piece's log probability. A BPE model's result is the one path on which every two neighbouring
pieces stay apart when they are merged by themselves (merging acts on neighbours only, so a piece boundary holds in a
text if and only if it holds between its two pieces alone); there a step scores 0, or minus infinity where the two
would not stay apart. Both give the ids of the SentencePiece library. Decoding gathers the bytes of the pieces.

Defined cases: a null text has null ids and decodes to null; an empty text has no ids; unknown characters become byte
pieces where the model has them, else the unknown id; U+2581 in a text is a space to the model, and decodes to one (so
such a text, alone, doesn't come back as it was); rows repeated are encoded alike; very long words are searched one by
one in the same way; an empty table gives an empty result. Only the columns that are named are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import bounded_batches

#: A public BPE vocabulary with byte pieces; another model's path can be given instead.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Letters; what looks like one but counts as a number is left out.
LETTER = r"[^\W\d_\u00b2\u00b3\u00b9\u2070-\u2089]"
#: Words, and within them runs of letters and of other characters: what may be told apart depends on the model's pieces.
WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
RUN = re.compile(f"{SPACE}*(?:{LETTER}+|(?:(?!{LETTER})[^{SPACE}])+)|{SPACE}+")
BASE = np.uint64(0x100000001B3)
#: Words remembered by a task, neighbours of pieces told apart, and the size of what is searched in groups.
WORDS_KEPT, PAIRS_KEPT, PAIRS_LOOSE, GROUP_LEAST, GROUP_LENGTH = 400_000, 2_000_000, 20_000, 12, 64


@dataclass
class PieceModel:
    """A model's pieces as they are sent to the workers: for each id its string, score and kind."""

    pieces: list[str]
    scores: list[float]
    kinds: str  # n: normal, b: byte, c: control, u: unknown
    bpe: bool
    prefix: bool
    digest: str = ""

    @classmethod
    def load(cls, path: str = MODEL_FILE) -> PieceModel:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            raw = f.read()
        model = proto.ModelProto()
        model.ParseFromString(raw)
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models that leave the text as it is are supported")
        read = sentencepiece.SentencePieceProcessor(model_proto=raw)
        ids = range(read.get_piece_size())
        kinds = "".join("b" if read.is_byte(i) else "c" if read.is_control(i) else "u" if read.is_unknown(i) else "n" for i in ids)
        return cls([read.id_to_piece(i) for i in ids], [read.get_score(i) for i in ids], kinds, model.trainer_spec.model_type == 2, norm.add_dummy_prefix, hashlib.sha256(raw).hexdigest())


def hashes(codes: np.ndarray) -> np.ndarray:
    """Of each row of code points, the hashes of its prefixes, the empty one first."""
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * BASE + codes[:, i].astype(np.uint64) + np.uint64(1)
    return out


@dataclass
class Searcher:
    """The tables of a model in a worker, and what it has found out so far."""

    model: PieceModel
    words: dict[str, tuple[int, ...]] = field(default_factory=dict)
    known: dict[int, bool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        m = self.model
        self.table = {p: s for p, s, k in zip(m.pieces, m.scores, m.kinds, strict=True) if k == "n"}
        self.ids = {p: i for i, (p, k) in enumerate(zip(m.pieces, m.kinds, strict=True)) if k == "n"}
        self.size = len(m.pieces)
        self.bytes_of = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(m.pieces, m.kinds, strict=True)) if k == "b"}
        self.unknown = m.kinds.index("u")
        # Merging by itself must give a piece back, or no text has it.
        usable = [p for p in self.ids if not m.bpe or self.merged(p) == [p]]
        self.usable = {p: self.ids[p] for p in usable}
        self.longest = max(map(len, usable), default=1)
        self.least = min(self.table.values(), default=0.0) - 10
        self.power = [np.uint64(pow(int(BASE), k, 2**64)) for k in range(self.longest + 1)]
        keys, at = [], []
        for k in range(1, self.longest + 1):
            same = [p for p in usable if len(p) == k]
            if same:
                codes = np.array([[ord(c) for c in p] for p in same], np.uint32)
                keys.append(self.salted(hashes(codes)[:, -1], k))
                at.append(np.array([self.ids[p] for p in same], np.int64))
        keys, at = np.concatenate(keys), np.concatenate(at)
        order = np.argsort(keys)
        self.keys, self.at = keys[order], at[order]
        self.score = np.array(m.scores)
        # No merge crosses a place that no piece has inside: texts can be told apart there.
        self.segment = next((cut for cut in (RUN, WORD) if all(cut.fullmatch(p) for p in usable)), None)
        self.pairs, self.holds = np.zeros(0, np.int64), np.zeros(0, bool)

    def forget(self) -> None:
        self.words.clear()
        self.known.clear()
        self.pairs, self.holds = np.zeros(0, np.int64), np.zeros(0, bool)

    @staticmethod
    def salted(h: np.ndarray, length: int) -> np.ndarray:
        h = h ^ np.uint64(length * 0x9E3779B97F4A7C15 & (2**64 - 1))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))

    def merged(self, text: str) -> list[str]:
        """BPE of a short string by itself: the best pair is merged, of equal ones the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, spot = None, -1
            for i in range(len(parts) - 1):
                s = self.table.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, spot = s, i
            if best is None:
                break
            parts[spot : spot + 2] = [parts[spot] + parts[spot + 1]]
        return parts

    def string(self, token: int) -> str:
        return self.model.pieces[token] if token < self.size else chr(token - self.size)

    def apart(self, left: int, right: int) -> bool:
        """Whether the pieces stay two when their string is merged by itself. Tokens from `size` on are unknown characters."""
        key = left << 32 | right
        found = self.known.get(key)
        if found is None:
            a, b = self.string(left), self.string(right)
            found = self.known[key] = self.merged(a + b) == [a, b]
        return found

    def apart_all(self, pairs: np.ndarray) -> np.ndarray:
        """`apart` of many pairs of tokens: those found before are in sorted arrays, new ones join them now and then."""
        if len(self.known) > PAIRS_LOOSE:
            fresh = np.array(list(self.known), np.int64)
            holds = np.array(list(self.known.values()), bool)
            if len(self.pairs) > PAIRS_KEPT:
                self.pairs, self.holds = self.pairs[:0], self.holds[:0]
            order = np.argsort(both := np.concatenate([self.pairs, fresh]))
            self.pairs, self.holds = both[order], np.concatenate([self.holds, holds])[order]
            self.known.clear()
        out = np.zeros(len(pairs), bool)
        rest = np.arange(len(pairs))
        if len(self.pairs):
            spot = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
            hit = self.pairs[spot] == pairs
            out[hit] = self.holds[spot[hit]]
            rest = np.flatnonzero(~hit)
        if len(rest):
            pair, inverse = np.unique(pairs[rest], return_inverse=True)
            out[rest] = np.array([self.apart(x >> 32, x & 0xFFFFFFFF) for x in pair.tolist()], bool)[inverse]
        return out

    def searched(self, words: list[str]) -> list[tuple[int, ...]]:
        """Paths of words of one length, all at once."""
        n, length = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(n, length)
        prefix = hashes(codes)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        token, back = np.zeros((length + 1, n), np.int64), np.zeros((length + 1, n), np.int32)
        for i in range(1, length + 1):
            for k in range(1, min(i, self.longest) + 1):
                key = self.salted(prefix[:, i] - prefix[:, i - k] * self.power[k], k)
                spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[spot] == key
                piece = self.at[spot]
                if k == 1:
                    piece = np.where(hit, piece, self.size + codes[:, i - 1].astype(np.int64))
                    hit = np.ones(n, bool)
                rows = np.flatnonzero(hit & (best[i - k] > -np.inf))
                if not len(rows):
                    continue
                piece = piece[rows]
                if not self.model.bpe:
                    step = np.where(piece < self.size, self.score[np.minimum(piece, self.size - 1)], self.least)
                elif i == k:
                    step = np.zeros(len(rows))
                else:
                    step = np.where(self.apart_all(token[i - k][rows] << 32 | piece), 0.0, -np.inf)
                score = best[i - k][rows] + step
                better = score > best[i][rows]
                rows = rows[better]
                best[i][rows], token[i][rows], back[i][rows] = score[better], piece[better], k
        out, rows, spot = [[] for _ in words], np.arange(n), np.full(n, length)
        while len(rows):
            for r, t in zip(rows.tolist(), token[spot[rows], rows].tolist(), strict=True):
                out[r].append(t)
            spot[rows] -= back[spot[rows], rows]
            rows = rows[spot[rows] > 0]
        return [tuple(reversed(x)) for x in out]

    def walked(self, word: str) -> tuple[int, ...]:
        """The same search for one long word."""
        length = len(word)
        best, token, back = [-np.inf] * (length + 1), [0] * (length + 1), [0] * (length + 1)
        best[0] = 0.0
        for i in range(1, length + 1):
            for k in range(1, min(i, self.longest) + 1):
                piece = self.usable.get(word[i - k : i])
                if piece is None:
                    if k > 1:
                        continue
                    piece = self.size + ord(word[i - 1])
                if best[i - k] == -np.inf:
                    continue
                if not self.model.bpe:
                    step = self.model.scores[piece] if piece < self.size else self.least
                else:
                    step = 0.0 if i == k or self.apart(token[i - k], piece) else -np.inf
                if best[i - k] + step > best[i]:
                    best[i], token[i], back[i] = best[i - k] + step, piece, k
        out, i = [], length
        while i:
            out.append(token[i])
            i -= back[i]
        return tuple(reversed(out))

    def final(self, path: tuple[int, ...]) -> tuple[int, ...]:
        """The ids of a path: unknown characters as bytes."""
        if max(path) < self.size:
            return path
        out: list[int] = []
        for t in path:
            if t < self.size:
                out.append(t)
            elif self.bytes_of:
                out += [self.bytes_of[b] for b in chr(t - self.size).encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return tuple(out)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin and end."""
        index: dict[str, int] = {}
        codes: list[int] = []
        counts = []
        for text in texts:
            found: list[str] = []
            if text:
                text = (SPACE if self.model.prefix else "") + text.replace(" ", SPACE)
                found = self.segment.findall(text) if self.segment else [text]
            codes += [index.setdefault(w, len(index)) for w in found]
            counts.append(len(found))
        fresh: dict[int, list[str]] = {}
        for w in index:
            if w not in self.words:
                fresh.setdefault(len(w), []).append(w)
        got: dict[str, tuple[int, ...]] = {}
        for length, same in fresh.items():
            if len(same) >= GROUP_LEAST and length <= GROUP_LENGTH:
                got.update(zip(same, map(self.final, self.searched(same)), strict=True))
            else:
                got.update((w, self.final(self.walked(w))) for w in same)
        paths = [self.words[w] if w in self.words else got[w] for w in index]
        if len(self.words) < WORDS_KEPT:  # the first words seen are the frequent ones
            self.words.update((w, p) for w, p in got.items() if len(w) <= GROUP_LENGTH)
        ids = np.array([t for p in paths for t in p], np.int32)
        ends = np.concatenate([[0], np.cumsum([len(p) for p in paths], dtype=np.int64)]) if paths else np.zeros(1, np.int64)
        return gathered(ids, ends, np.array(codes, np.int64), np.array(counts, np.int64))

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each text, from all ids one after another."""
        if not hasattr(self, "raw"):
            m = self.model
            each = [bytes([int(p[3:5], 16)]) if k == "b" else b"" if k == "c" else b" \xe2\x81\x87 " if k == "u" else p.replace(SPACE, " ").encode() for p, k in zip(m.pieces, m.kinds, strict=True)]
            self.raw, self.raw_ends = np.frombuffer(b"".join(each), np.uint8), np.concatenate([[0], np.cumsum([len(e) for e in each])])
        out, spots = gathered(self.raw, self.raw_ends, ids.astype(np.int64), np.diff(ends))
        data = out.tobytes()
        return [data[a + (self.model.prefix and data[a : a + 1] == b" ") : b] for a, b in zip(spots[:-1].tolist(), spots[1:].tolist(), strict=True)]


def gathered(values: np.ndarray, ends: np.ndarray, picks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of values that `picks` name, one after another; `counts` of them make a text. With where each text's begin and end."""
    length = np.diff(ends)[picks]
    total = np.concatenate([[0], np.cumsum(length)])
    take = np.repeat(ends[picks] - total[:-1], length)
    take += np.arange(total[-1])
    return values[take], total[np.concatenate([[0], np.cumsum(counts)])]


_SEARCHERS: dict[str, Searcher] = {}


@contextmanager
def searching(model: PieceModel, keep: bool = False) -> Iterator[Searcher]:
    """A worker's searcher for a task. The model's tables stay; the words and pairs that it remembers go with the task, as workers live on and later stages need their memory, unless they are to be kept for the next task."""
    if model.digest not in _SEARCHERS:
        _SEARCHERS.clear()
        _SEARCHERS[model.digest] = Searcher(model)
    own = _SEARCHERS[model.digest]
    try:
        yield own
    finally:
        if not keep:
            own.forget()


#: Characters of the texts that are encoded together.
STEP_CHARS = 4_000_000


def runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for hi, text in enumerate(texts):
        held += len(text or "")
        if held >= STEP_CHARS:
            yield lo, hi + 1
            lo, held = hi + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode(docs: DataFrame, keep: list[str], model: PieceModel | None = None, check: bool = False) -> DataFrame:
    """`keep` columns, n_tokens and ids of every row's text; to check, the ids are decoded too: whole says whether the text came back."""
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model or PieceModel.load())  # a model's own size, some MB
    given = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    names = [*keep, "n_tokens", "ids", *["whole"] * check]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with searching(shared.value) as own:
            for batch in batches:
                texts = batch.column(len(keep)).to_pylist()
                for lo, hi in runs(texts):
                    ids, ends = own.encode(texts[lo:hi])
                    gone = pa.array([t is None for t in texts[lo:hi]])
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()), mask=gone)
                    counts = pa.array(np.diff(ends), pa.int64(), mask=gone.to_numpy(zero_copy_only=False))
                    same = [pa.array([None if t is None else t.encode() == b for t, b in zip(texts[lo:hi], own.decode(ids, ends), strict=True)], pa.bool_())] if check else []
                    yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[: len(keep)]), counts, lists, *same], names)

    return docs.select(*keep, F.col("text").alias("__dq_text")).mapInArrow(run, f"{given}, n_tokens long, ids array<int>" + ", whole boolean" * check)


def decode(encoded: DataFrame, keep: list[str], model: PieceModel | None = None) -> DataFrame:
    """`keep` columns and the text of every row's ids."""
    spark = encoded.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model or PieceModel.load())
    given = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with searching(shared.value) as own:
            for batch in batches:
                lists = batch.column(len(keep))
                ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
                texts = own.decode(lists.flatten().to_numpy(zero_copy_only=False), ends)
                values = [None if gone else t.decode("utf-8", "replace") for t, gone in zip(texts, lists.is_null().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(values, pa.string())], [*keep, "text"])

    return encoded.select(*keep, F.col("ids").alias("__dq_ids")).mapInArrow(run, f"{given}, text string")


def round_trip(docs: DataFrame, model: PieceModel | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), decoded_sha256, whole (the text came back) of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model or PieceModel.load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with searching(shared.value, keep=True) as own:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for lo, hi in runs(texts):
                    part = texts[lo:hi]
                    ids, ends = own.encode(part)
                    back = own.decode(ids, ends)
                    sums = [None if t is None else hashlib.sha256(ids[a:b].tobytes()).hexdigest() for t, a, b in zip(part, ends[:-1], ends[1:], strict=True)]
                    again = [None if t is None else hashlib.sha256(b).hexdigest() for t, b in zip(part, back, strict=True)]
                    same = [None if t is None else t.encode() == b for t, b in zip(part, back, strict=True)]
                    gone = np.array([t is None for t in part], bool)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(ends), pa.int64(), mask=gone), pa.array(sums, pa.string()), pa.array(again, pa.string()), pa.array(same, pa.bool_())],
                        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "whole"],
                    )

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, whole boolean"
    return docs.select("doc_id", F.col("text").alias("__dq_text")).mapInArrow(run, kind)
