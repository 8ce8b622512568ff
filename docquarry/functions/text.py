"""Text functions as Columns; Arrow functions only where the JVM has no counterpart (NFKC, case folding, name-based ids, sequence similarity)."""

from __future__ import annotations

import difflib
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

WORD = r"[\p{L}\p{N}_]"
CJK = r"[\x{3400}-\x{9fff}]"
TOKEN = rf"{CJK}|[\p{{L}}\p{{N}}_&&[^\x{{3400}}-\x{{9fff}}]]+|[^\p{{L}}\p{{N}}_\s]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
CORRUPT = "[�□■]"
#: What may stand between words, as Python's \s and strip() see it.
SPACES = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def terms(text: Column | str) -> Column:
    """Search terms: lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}+"), F.lit(0))


def token_count(text: Column | str) -> Column:
    """Estimated tokens: CJK characters, other words, and single marks."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def language(text: Column | str) -> Column:
    """zh, en, zh-en-mixed or null, by the CJK and Latin letters."""
    cjk, latin = F.regexp_count(text, F.lit(CJK)), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when((cjk > 0) & (latin > 0), "zh-en-mixed").when(cjk > 0, "zh").when(latin > 0, "en")


def collapse(text: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACES}+", " "))


def dedupe_key(text: Column | str) -> Column:
    """What equal blocks have in common. Lower case stands for case folding; `folded` is exact."""
    return F.lower(collapse(text))


def without_controls(text: Column | str) -> Column:
    return F.regexp_replace(text, CONTROL, "")


def newlines(text: Column | str) -> Column:
    r"""\r\n and \r as \n, no-break spaces as spaces."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), " ", " ")


def tidy_lines(text: Column | str) -> Column:
    """Prose: tabs and spaces collapsed in each line, empty lines dropped."""
    lines = F.transform(F.split(column(text), "\n"), lambda x: F.trim(F.regexp_replace(x, "[\\t ]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def tidy_code(text: Column | str) -> Column:
    """Code: no white space behind lines, no line breaks at the ends."""
    lines = F.transform(F.split(column(text), "\n"), lambda x: F.regexp_replace(x, r"[\t ]+$", ""))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\n+|\n+$", "")


def tidy_table(text: Column | str) -> Column:
    """Tables as text: cells between tabs collapsed, blank lines dropped."""
    def cells(line: Column) -> Column:
        return F.array_join(F.transform(F.split(line, "\t"), lambda c: F.trim(F.regexp_replace(c, " +", " "))), "\t")

    lines = F.filter(F.split(column(text), "\n"), lambda x: F.trim(F.regexp_replace(x, "\t", " ")) != "")
    return F.array_join(F.transform(lines, cells), "\n")


def tidy(text: Column | str, block_type: Column | str) -> Column:
    kind = column(block_type)
    return F.when(kind == "code", tidy_code(text)).when(kind.isin("table", "logical_table", "table_row"), tidy_table(text)).otherwise(tidy_lines(text))


def information_density(text: Column | str) -> Column:
    """Letters, digits and underscores among the characters that aren't white space."""
    solid = F.regexp_count(text, F.lit(r"\S"))
    return F.regexp_count(text, F.lit(WORD)) / F.greatest(solid, F.lit(1))


def shingles(text: Column | str, n: int = 3) -> Column:
    """The distinct runs of n characters, white space left out; a shorter text is one."""
    plain = F.lower(F.regexp_replace(text, f"{SPACES}+", ""))
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.length(plain) - (n - 1), F.lit(1))), lambda i: F.substring(plain, i, F.lit(n)))
    return F.array_distinct(F.when(F.length(plain) > n, many).otherwise(F.array(plain)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two arrays of distinct values; 0 for two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """White space collapsed, case folded."""
    return text.map(lambda t: None if t is None else " ".join(t.split()).casefold())


@F.pandas_udf(StringType())
def entity_key(name: pd.Series) -> pd.Series:
    """An entity's name without control characters, punctuation and spaces as one space, NFKC and case folded."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        kept = (c for c in unicodedata.normalize("NFKC", text).casefold() if not unicodedata.category(c).startswith("C") or c.isspace())
        return " ".join("".join(" " if unicodedata.category(c)[0] in "PZ" or c.isspace() else c for c in kept).split())

    return name.map(one)


def entity_key_plain(name: Column | str) -> Column:
    """`entity_key` within the JVM, for text whose lower case is its folding."""
    return F.trim(F.regexp_replace(F.lower(name), r"[\p{P}\p{Z}\s]+", " "))


def uuid5_of(namespace: str):  # noqa: ANN201
    """A function of names: version 5 UUIDs in a namespace."""
    space = uuid.UUID(namespace)

    @F.pandas_udf(StringType())
    def make(name: pd.Series) -> pd.Series:
        return name.map(lambda n: None if n is None else str(uuid.uuid5(space, n)))

    return make


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The similarity of two texts by their longest matching blocks (Ratcliff and Obershelp)."""
    return pd.Series([difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


def normalize_query(text: Column | str) -> Column:
    """A search query: no zero-width spaces, white space collapsed, none before punctuation. Apply `nfkc` before where the text may need it."""
    return F.regexp_replace(collapse(F.regexp_replace(text, "​", "")), r" +([,.;:!?\x{3002}])", "$1")


def masked(text: Column | str) -> Column:
    """Bearer tokens and credentials in URLs, masked."""
    return F.regexp_replace(F.regexp_replace(text, r"(?i)\b(bearer)\s+[A-Za-z0-9._~+/=-]+", "$1 [REDACTED]"), r"://[^/\s:@]+:[^/\s@]+@", "://[REDACTED]@")
