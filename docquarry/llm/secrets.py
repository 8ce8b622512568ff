"""Secret scans: fixed patterns, and assignment-aware lexing of source and configuration syntax.

The lexer reads a text as pairs of a name and what is assigned to it:

* names: `name`, `"name"`, `cfg["name"]`, `name: type` (annotated), `--name`, a call `name(...)`, an XML element
  `<name>...</name>`, attributes `key="name" value="..."`, and a literal before another one, `("name", "...")`;
* signs: `=`, `:=`, `=>`, `:`;
* values: strings (single, double, back-quoted, triple, with prefixes and escapes), bare values, YAML block scalars,
  concatenations (`+`, `.`, `..`, `&`, `||`, strings side by side, continued lines), references to other names, and the
  literals in a call's arguments, a list or brackets, each a value of its own.

Constants are propagated: a literal that reaches a sensitive name through other names is found where it stands; a name
has the value assigned last before its use, or else the first one assigned after it. The terms of a concatenation are
one value: its score is the sensitivity of the target's name (by its words, so `author` isn't `auth`) times how much
the value looks like a secret (length, variety, no placeholder, no plain words), and all literals it is made of are
found. A literal that scores by itself is found as well; where a term is an unknown name and a literal scores by
itself, the value is judged by such literals alone.

Kinds, in the order in which spans of one start are listed: assign, access, hex (the fixed patterns), literal (the
lexer's). Starts and ends are in code points, ends exclusive. Patterns match leftmost and without overlaps, a kind by
itself; matches that are too short are dropped after matching.

Defined cases: a null text is an empty one and has no spans; a literal that two names reach is listed once, with its
highest score; references in a circle end; repeated rows have equal spans; an empty table gives an empty result. Only
doc_id and text are read (`redact` keeps all columns).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import bounded_batches

KINDS = ("assign", "access", "hex", "literal")
#: The patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # of a maximal run of such characters, all: its first 32 begin the match
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

#: How sensitive a name is, by the word or words it ends with, also inside of a longer name.
SENSITIVE = (
    ("password", 1.0), ("passwd", 1.0), ("passphrase", 1.0), ("secret", 1.0), ("secretkey", 1.0), ("privatekey", 1.0), ("apikey", 1.0), ("accesskey", 1.0), ("accountkey", 0.9),
    ("token", 0.9), ("credential", 0.9), ("signingkey", 0.9), ("encryptionkey", 0.9), ("connectionstring", 0.8),
)
#: Short words, which have to stand alone.
SENSITIVE_WORDS = {"pwd": 0.9, "pass": 0.7, "bearer": 0.8, "auth": 0.7, "dsn": 0.6, "salt": 0.5}
#: Words of names that count or limit something, and words that may follow a sensitive one.
QUANTITIES = frozenset("max min num number count counter total limit size length len index offset position per budget usage used".split())
BESIDE = frozenset("value values old new prev current default primary secondary prod production dev test staging main env str string text raw plain data hex b encoded base for of".split())
PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|-+|_+|change_?me|example.*|placeholder|dummy|your[_-].*|test|null|none|true|false|undefined)$", re.IGNORECASE)
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

IDENT = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
#: What is assigned to. Names are whole runs of their characters, but for digits, dots and dashes in front; each run is read once.
TARGET = re.compile(
    rf"""<({IDENT})(?:\s[^<>]*+)?>\s*+([^<>]*[^<>\s])\s*+</\1\s*>"""
    rf"""|\b(?:key|name|id)=(["'])({IDENT})\3\s++value=(?=["'])"""
    rf"""|(["'])({IDENT})\5(?:[\x20\t]*+\])?[\x20\t]*+(:=|=>|=(?!=)|:(?![:/])|,(?=\s*["'`]))[\x20\t]*+"""
    rf"""|(?<![A-Za-z0-9_.\-])(--)?[0-9.\-]*+({IDENT})(?:[\x20\t]*+(:=|=>|=(?!=)|:(?![:/]))[\x20\t]*+|(\()|[\x20\t]++(?![\x20\t\-]))""",
    re.ASCII,
)
#: A type between a name and its value.
TYPED = re.compile(r"""([A-Za-z_][A-Za-z0-9_.]*+)(?:\[[^\]\n=]*+\]|<[^>\n=]*+>)?(?:[\x20\t]*+\|[\x20\t]*+[A-Za-z_][A-Za-z0-9_.]*+)*[\x20\t]*+=(?![=>])[\x20\t]*+""", re.ASCII)
STRING = re.compile(r"""(?:[A-Za-z@$]{1,2})?(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`)""", re.ASCII)
TRIPLE = re.compile(r"""(?:[A-Za-z]{1,2})?(\"{3}|'{3})""")
#: A bare value; signs of equality end it (as in base64), and stand before what goes on.
BARE = re.compile(r"[A-Za-z0-9+/_.\-]++(?:=++(?![A-Za-z0-9+/_.\-\"'`\x20\t]))?", re.ASCII)
BLOCK = re.compile(r"[|>][0-9+\-]*+[\x20\t]*+\r?\n((?:[\x20\t]++[^\n]*+\n?|[\x20\t]*+\r?\n)++)")
#: Between two terms of one value: signs of concatenation, with lines going on behind them, before them or by a backslash.
JOIN = re.compile(r"""\s*+(?:\+|\.concat\(|\.\.?(?=\s*["'`$])|&|\|\|)\s*+|[\x20\t]*+\\\r?\n[\x20\t]*+(?=["'`])""")
QUOTE = re.compile(r"""[\x20\t]*+(?=[A-Za-z]{0,2}["'`])""")
#: Between two values of which one is chosen: `x if y else z`, `y ? x : z`. The condition has so many characters at most.
CHOICE = re.compile(r"""[\x20\t]++if\b[^\n]{0,200}?\belse\b[\x20\t]*+|[\x20\t]*+[?:][\x20\t]*+(?=["'`])""")
#: A list in YAML, an item a line; what a name stands behind in a tuple of names.
ITEMS = re.compile(r"""[\x20\t]*+\r?\n((?:[\x20\t]*+-[\x20\t]++[^\n]++\n?)++)""")
ITEM = re.compile(r"""-[\x20\t]++(?:"([^"\n]*+)"|'([^'\n]*+)'|([^\s"'#:]++)(?=[\x20\t\r]*+(?:#|$)))""", re.MULTILINE)
NAMES_BEFORE = re.compile(r"""(?:^|\n)[\x20\t(]*+((?:[A-Za-z_][A-Za-z0-9_.]*+[\x20\t]*+,[\x20\t]*+)+)\Z""", re.ASCII)
#: Brackets in brackets that the value of a sensitive name, and of any other, is read in: a bound of the work on each character, far beyond what code nests.
DEPTH, DEPTH_OTHERS = 32, 8
OPEN, CLOSE = ("(", "[", "{"), (")", "]", "}")
#: Characters of a value that tell whether it is a placeholder.
HEAD = 64
#: Start, end, value, quoted.
Term = tuple[int, int, str, bool]
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*\Z", re.ASCII)


@dataclass(frozen=True)
class SecretConfig:
    least_score: float = 0.5
    least_length: int = 8


def sensitivity(name: str) -> float:
    """By the last words of the name, but for such as `value` or `old`: parts between signs, or between a small and a large letter. Names of quantities (`token_count`, `max_token`) aren't sensitive."""
    words = [w.lower() for w in WORDS.findall(name)]
    if not QUANTITIES.isdisjoint(words):
        return 0.0
    while len(words) > 1 and words[-1] in BESIDE:
        words.pop()
    if not words:
        return 0.0
    joined = "".join(words)
    plain = joined.removesuffix("s")
    best = SENSITIVE_WORDS.get(words[-1], 0.0)
    for part, weight in SENSITIVE:
        if weight > best and (joined.endswith(part) or plain.endswith(part)):
            best = weight
    return best


def suspicion(value: str) -> float:
    """How much a quoted literal looks like a secret, 0 to 1: by its entropy, in bits a character, and by its length."""
    return suspicion_of(Value(len(value), value, Counter(value), bare=False))


def suspicion_of(value: Value) -> float:
    # A placeholder is short, or known by how it begins, or one character again and again.
    if PLACEHOLDER.match(value.head) and (value.length == len(value.head) or value.head[0].isalpha() and value.head[0] not in "xX" or len(set(map(str.lower, value.counts))) == 1):
        return 0.0
    if value.head.startswith(("${", "{{", "<", "%(", "$(")):
        return 0.0
    n = value.length
    bits = -sum(p * math.log2(p) for c in value.counts.values() if (p := c / n) > 0)
    # Words alone are names and prose more often than secrets.
    words, spaced = all(c.isalpha() or c.isspace() or c in ",.;:!?'_-/" for c in value.counts), any(c.isspace() for c in value.counts)
    joined = any(c in "_-/." for c in value.counts)
    plain = 1.0 if not words else 0.6 if spaced and not value.bare else 0.45 if value.bare or joined else 1.0
    return min(1.0, bits / 3) * min(1.0, 0.5 + min(n, 16) / 32) * plain


class Reader:
    """Reads the pairs of one text."""

    def __init__(self, text: str) -> None:
        self.text, self.found = text, []
        #: Triple quotes that don't close any more from some place on.
        self.open_from: dict[str, int] = {}

    def string(self, at: int) -> Term | None:
        text = self.text
        if (m := TRIPLE.match(text, at)) is not None and m.end() < self.open_from.get(m.group(1), len(text) + 1):
            end = text.find(m.group(1), m.end())
            if end >= 0:
                self.after = end + 3
                return m.end(), end, text[m.end() : end], True
            self.open_from[m.group(1)] = m.end()
        if (m := STRING.match(text, at)) is not None:
            self.after = m.end()
            return (*m.span(m.lastindex), m.group(m.lastindex), True)
        return None

    def value(self, at: int, depth: int = 0, most: int = DEPTH) -> tuple[list[list[Term]], int, bool]:
        """The values that begin at `at`, where they end, and whether they were in brackets. One value outside of brackets, any number inside."""
        text, values, terms, nested = self.text, [], [], depth > 0
        while True:
            if depth:
                while at < len(text) and text[at].isspace():
                    at += 1
            if (term := self.string(at)) is not None:
                at = self.after
                if depth and (m := KEY.match(text, at)) is not None:  # the key of a map: its value stands by itself
                    values.append(terms)
                    terms, at = [], m.end()
                    continue
                terms.append(term)
            elif (m := BARE.match(text, at)) is not None and not depth:
                at = m.end()
                if text[at : at + 1] in OPEN[:2] and NAME.match(m.group()):
                    depth, nested, at = depth + 1, True, at + 1
                    continue
                terms.append((*m.span(), m.group(), False))
            elif depth and (m := NAMES.match(text, at)) is not None:
                at = m.end()
                if text[at : at + 1] in OPEN[:2]:
                    if depth == most:
                        break
                    depth, at = depth + 1, at + 1
                    continue
                if (m2 := SIGN.match(text, at)) is not None:  # a keyword: its value stands by itself
                    values.append(terms)
                    terms, at = [], m2.end()
                    continue
                terms.append((*m.span(), m.group(), False))
            elif depth and (m := DIGITS.match(text, at)) is not None:
                at = m.end()
            elif text[at : at + 1] in OPEN and depth < most and not terms:
                depth, nested, at = depth + 1, True, at + 1
                continue
            if (m := JOIN.match(text, at)) is not None and terms:
                at = m.end()
                continue
            if terms and terms[-1][3] and (m := (SPACED if depth else QUOTE).match(text, at)) is not None:
                at = m.end()
                continue
            if terms and (m := CHOICE.match(text, at)) is not None:
                values.append(terms)
                terms, at = [], m.end()
                continue
            if not depth:
                break
            while at < len(text) and text[at].isspace():
                at += 1
            sign = text[at : at + 1]
            if sign not in (",", ";", *CLOSE):
                break
            at += 1
            values.append(terms)
            terms = []
            if sign in CLOSE:
                depth -= 1
                if not depth:
                    break
        return [x for x in [*values, terms] if x], at, nested

    def pairs(self) -> list[tuple[str, list[Term]]]:
        """The names and the terms assigned to them, in order: (start, end, value, quoted) for each term."""
        text, out, at = self.text, [], 0
        while (m := TARGET.search(text, at)) is not None:
            at = m.end()
            if m.group(1):
                out.append((m.group(1), [(*m.span(2), m.group(2), True)]))
                continue
            if m.group(4):
                name, sign = m.group(4), "="
            elif m.group(6):
                name, sign = m.group(6), m.group(7)
            else:
                name, sign = m.group(9), m.group(10)
                if m.group(11):  # a call: its arguments are read again
                    if sensitivity(name):
                        out += [(name, [t for t in terms if t[3]]) for terms in self.value(at, 1)[0] if any(t[3] for t in terms)]
                    continue
                if sign is None:  # of names and values with only a blank between them, options count
                    if not m.group(8):
                        continue
                    sign = "--"
            if sign == ",":
                while text[at].isspace():
                    at += 1
                start = at
                if (term := self.string(at)) is not None and sensitivity(name):
                    out.append((name, [term]))
                at = start
                continue
            names = [name]
            if sign == ":":
                if (b := BLOCK.match(text, at)) is not None:
                    inner = b.group(1).strip()
                    if inner:
                        start = b.start(1) + b.group(1).index(inner)
                        out.append((name, [(start, start + len(inner), inner, True)]))
                    at = b.start(1)  # lines of a block may be pairs themselves
                    continue
                if (b := ITEMS.match(text, at)) is not None:
                    for i in ITEM.finditer(text, b.start(1), b.end(1)):
                        out.append((name, [(*i.span(i.lastindex), i.group(i.lastindex), i.lastindex < 3)]))
                    at = b.start(1)
                    continue
                if (t := TYPED.match(text, at)) is not None:
                    names.append(t.group(1))
                    at = t.end()
            values, end, nested = self.value(at, most=DEPTH if sensitivity(name) else DEPTH_OTHERS)
            if sign == "=" and sensitivity(name) and (before := NAMES_BEFORE.search(text[max(0, m.start() - 200) : m.start()])) is not None:
                for _ in range(before.group(1).count(",")):  # a tuple of names: the value at its place
                    if text[end : end + 1] != ",":
                        break
                    while text[end + 1 : end + 2] in (" ", "\t"):
                        end += 1
                    values, end, nested = self.value(end + 1)
            out += [(n, terms) for terms in values for n in names]
            # what is in brackets may hold pairs, and a bare value may itself begin one, as in `a: b = "c"`
            if not nested and values:
                terms = values[0]
                at = terms[0][0] if len(terms) == 1 and not terms[0][3] else end
            at = max(at, m.end())
        return out


NAMES = re.compile(IDENT, re.ASCII)
KEY = re.compile(r"[\x20\t]*+(?:=>|:(?![:/]))[\x20\t]*+")
DIGITS = re.compile(r"[0-9][0-9A-Za-z_.]*+")
SIGN = re.compile(r"[\x20\t]*+(?::=|=>|=(?!=)|:(?![:/]))[\x20\t]*+")
SPACED = re.compile(r"""\s*+(?=[A-Za-z]{0,2}["'`])""")


def pairs(text: str) -> list[tuple[str, list[Term]]]:
    return Reader(text).pairs()


@dataclass
class Value:
    """What is assigned to a name, with constants put in: its length, characters and beginning; complete: every term is known; bare: none is quoted."""

    length: int = 0
    head: str = ""
    counts: Counter[str] = field(default_factory=Counter)
    complete: bool = True
    bare: bool = True

    def add(self, other: Value) -> None:
        self.length += other.length
        self.head = (self.head + other.head)[:HEAD]
        for c, n in other.counts.items():
            self.counts[c] += n
        self.complete &= other.complete
        self.bare &= other.bare


def folded(name: str, terms: list[Term], latest: dict[str, list[Term]]) -> tuple[Value, list[Term]]:
    """The value of `terms`, and the literals that it is made of. Each name is valued once, so constants that double others don't grow."""
    values: dict[str, Value | None] = {name: None}  # None: being valued, so a reference to it is a circle
    literals: dict[tuple[int, int], Term] = {}
    stack: list[tuple[str, list[Term], int, Value]] = [(name, terms, 0, Value())]
    while True:
        own, of, at, value = stack.pop()
        while at < len(of):
            start, end, text, quoted = of[at]
            if not quoted and NAME.match(text) and text in latest:
                if text not in values:
                    values[text] = None
                    stack += [(own, of, at, value), (text, latest[text], 0, Value())]
                    break
                value.add(values[text] or Value(complete=False))
            else:
                literals[start, end] = of[at]
                unknown = not quoted and len(of) > 1 and NAME.match(text) is not None
                value.add(Value(complete=False) if unknown else Value(len(text), text[:HEAD], Counter(text), bare=not quoted))
            at += 1
        else:
            values[own] = value
            if not stack:
                return value, list(literals.values())


def lexed(text: str, config: SecretConfig = SecretConfig()) -> list[tuple[int, int, str, float]]:
    """(start, end, name, score) of literals that reach a sensitive name."""
    found = pairs(text)
    if not any(sensitivity(name) for name, _ in found):
        return []
    # Of a name that is used before it is assigned, the first value counts; from then on the latest one.
    latest = dict(reversed(found))
    best: dict[tuple[int, int], tuple[str, float]] = {}
    for name, terms in found:
        weight = sensitivity(name)
        if weight:
            value, literals = folded(name, terms, latest)
            scores = {(a, b): weight * suspicion_of(Value(len(x), x, Counter(x), bare=not quoted)) if len(x) >= config.least_length else 0.0 for a, b, x, quoted in literals}
            whole = weight * suspicion_of(value) if value.length >= config.least_length else 0.0
            # With a term unknown, literals that look like secrets by themselves stand for the value.
            if whole >= config.least_score and (value.complete or max(scores.values(), default=0.0) < config.least_score):
                for a, b, x, quoted in literals:
                    if x and (quoted or value.complete or not NAME.match(x)):
                        scores[a, b] = max(scores[a, b], whole)
            for span, score in scores.items():
                if score >= config.least_score and score > best.get(span, ("", 0.0))[1]:
                    best[span] = name, score
        latest[name] = terms
    return sorted((a, b, name, round(score, 4)) for (a, b), (name, score) in best.items())


def base(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of the fixed patterns."""
    out = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    return sorted(out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def found(text: str | None, config: SecretConfig = SecretConfig()) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str, float]]]:
    """The base spans, and what the lexer adds."""
    text = text or ""
    return base(text), lexed(text, config)


def scan(docs: DataFrame, config: SecretConfig = SecretConfig()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document, and literals: the lexer's spans with the target's name and the score."""
    bounded_batches(docs.sparkSession)
    literal = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                fixed, more = found(text.as_py(), config)
                first = listed(fixed)
                every = listed(sorted(fixed + [(a, 3, b) for a, b, _, _ in more])) if more else first
                kinds = [k for _, k, _ in fixed]
                out.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(first.encode()).hexdigest(), every, [{"start": a, "end": b, "name": name, "score": s} for a, b, name, s in more]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), literal)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate(types))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "literals"])

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, literals array<struct<start: long, end: long, name: string, score: double>>"
    return docs.select("doc_id", F.col("text").alias("__dq_text")).mapInArrow(run, kind)


def redact(docs: DataFrame, mask: str = "[secret]", config: SecretConfig = SecretConfig()) -> DataFrame:
    """The rows of `docs`, each span (overlapping ones together) replaced by `mask`. A null text stays null."""
    bounded_batches(docs.sparkSession)
    names, spot = docs.columns, docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        fixed, more = found(text, config)
        out, at = [], 0
        for a, b in sorted([(a, b) for a, _, b in fixed] + [(a, b) for a, b, _, _ in more]):
            if a >= at:
                out += [text[at:a], mask]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[spot] = pa.array([clean(t) for t in columns[spot].to_pylist()], columns[spot].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
