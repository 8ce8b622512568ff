"""Files: scans with checks, safe names, types by content, and sinks for artifacts and reports."""

from __future__ import annotations

import io
import json
import os
import re
import unicodedata
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Suffixes that may be taken in, the largest file, and what files of a type begin with.
SUFFIXES = ("pdf", "docx", "doc", "pptx", "ppt", "xlsx", "xls", "md", "markdown", "txt", "html", "htm")
MOST_BYTES = 100 * 1024 * 1024
PDF, ZIP, OLE = "25504446", "504B0304", "D0CF11E0A1B11AE1"
OFFICE = {"word/": "docx", "ppt/": "pptx", "xl/": "xlsx"}
#: What a name may not have: anything but word characters, CJK characters and a few signs.
REFUSED = re.compile(r"[^\w.()\-\u4e00-\u9fff ]+")


def scan(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES, most: int = MOST_BYTES) -> DataFrame:
    """filename, suffix, file_size, sha256, content, status (ok, FILE_TOO_LARGE) of the files under a path. The reader itself lists files by suffix, and leaves empty files out: they are never taken in."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(path)
    status = F.when(F.col("length") > most, "FILE_TOO_LARGE").otherwise("ok")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("filename"), suffix_of(name).alias("suffix"), F.col("length").alias("file_size"), F.sha2("content", 256).alias("sha256"), "content", status.alias("status"))


def suffix_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def allowed(name: Column) -> Column:
    return suffix_of(name).isin(*SUFFIXES)


@F.pandas_udf(StringType())
def office_kind(content: pd.Series) -> pd.Series:
    """docx, pptx or xlsx by the names in an archive, else null."""

    def one(data: bytes | None) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                names = z.namelist()
        except zipfile.BadZipFile:
            return None
        return next((kind for prefix, kind in OFFICE.items() if any(n.startswith(prefix) for n in names)), None)

    return content.map(one)


def content_kind(content: Column | str) -> Column:
    """pdf, ole, docx, pptx, xlsx, text or unknown, by what a file begins with. Only archives are opened, in Python."""
    c = F.col(content) if isinstance(content, str) else content
    start = F.hex(F.substring(c, 1, 8))
    text = (F.position(F.lit(b"\x00"), c) == 0) & F.is_valid_utf8(c.cast("string"))
    return F.when(start.startswith(PDF), "pdf").when(start == OLE, "ole").when(start.startswith(ZIP), F.coalesce(office_kind(c), F.lit("unknown"))).when(text, "text").otherwise("unknown")


def safe_name(name: str, most_bytes: int = 200) -> str:
    """A file's name without folders: letters, digits, `_`, `.`, `-`, brackets and blanks, other runs as one `_`; the suffix in lower case. Stem and suffix together have `most_bytes` at most, cut at a character."""
    base = name.rstrip("/").rsplit("/", 1)[-1]
    plain = REFUSED.sub("_", unicodedata.normalize("NFKC", base).replace("\0", ""))
    plain = re.sub(" +", " ", plain).strip(" .") or "upload"
    stem, dot, suffix = plain.rpartition(".")
    stem, suffix = (stem, dot + suffix.lower()) if stem else (plain, "")
    room = max(1, most_bytes - len(suffix.encode()))
    return (stem.encode()[:room].decode("utf-8", "ignore") or "upload") + suffix


@F.pandas_udf(StringType())
def safe_names(name: pd.Series) -> pd.Series:
    return name.map(lambda n: None if n is None else safe_name(n))


def original_path(document: Column, version: Column, name: Column) -> Column:
    return F.concat_ws("/", F.lit("originals"), document, version, name)


def write_artifacts(df: DataFrame, path: str, *partitions: str) -> None:
    """Parquet, in folders by a few coarse columns (a bucket or a date, not one folder a document)."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_golden(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The samples of a JSON file with a list of them, with the dataset's version."""
    return spark.read.schema(f"version string, samples array<struct<{schema}>>").option("multiLine", True).json(path).select("version", F.inline("samples"))


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def sorted_json(columns: list[str]) -> Column:
    """A row as JSON with its fields in order, so that its hash doesn't depend on the schema's."""
    return F.to_json(F.struct(*sorted(columns)))


def markdown_report(title: str, metrics: DataFrame) -> str:
    """A short table (metric, value; a row for each metric) for people to read."""
    lines = [f"# {title}", "", "| metric | value |", "| - | - |"]
    return "\n".join([*lines, *(f"| {r['metric']} | {r['value']} |" for r in metrics.orderBy("metric").select("metric", "value").collect())]) + "\n"


# Services: what they need is a function of a batch; the stand-ins give the same results everywhere.

Provider = Callable[[list[str]], list[list[float]]]


def hashed_vectors(texts: list[str], dims: int = 64) -> list[list[float]]:
    """A stand-in for an embedding service: counts of hashed words, of length one."""
    out = []
    for text in texts:
        v = [0.0] * dims
        for w in text.lower().split():
            h = uuid.uuid5(uuid.NAMESPACE_OID, w).int
            v[h % dims] += 1.0 if h >> 64 & 1 else -1.0
        size = sum(x * x for x in v) ** 0.5
        out.append([x / size for x in v] if size else v)
    return out


def embed(df: DataFrame, ident: str, text: str, provider: Provider = hashed_vectors, dims: int = 64, batch: int = 128) -> DataFrame:
    """ident and embedding; a batch of texts at a time goes to the service, whose answer must fit."""
    kind = df.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            vectors: list[list[float]] = []
            for at in range(0, len(frame), batch):
                part = [t or "" for t in frame["t"].iloc[at : at + batch]]
                got = provider(part)
                if len(got) != len(part) or any(len(v) != dims for v in got):
                    raise ValueError("EMBEDDING_RESPONSE_INVALID")
                vectors += got
            yield pd.DataFrame({ident: frame["i"], "embedding": vectors})

    return df.select(F.col(ident).alias("i"), F.col(text).alias("t")).mapInPandas(run, f"{ident} {kind}, embedding array<double>")


def unavailable(name: str) -> Callable[..., None]:
    """A service that isn't configured: calling it fails with a stable code."""

    def fail(*args: object, **kwargs: object) -> None:
        raise RuntimeError(f"{name.upper()}_UNAVAILABLE")

    return fail


def sanitize(value: object, depth: int = 5, chars: int = 2048, items: int = 100) -> object:
    """A payload that may be logged: secrets masked by key, strings, lists and depth bounded."""
    if depth <= 0:
        return "[TRUNCATED]"
    if isinstance(value, dict):
        return {str(k): "[REDACTED]" if re.search(r"(?i)pass|secret|token|api_?key|authorization|credential", str(k)) else sanitize(v, depth - 1, chars, items) for k, v in list(value.items())[:items]}
    if isinstance(value, list | tuple):
        return [sanitize(v, depth - 1, chars, items) for v in value[:items]]
    if isinstance(value, str):
        text = re.sub(r"(?i)\b(bearer)\s+[A-Za-z0-9._~+/=-]+", r"\1 [REDACTED]", value)
        text = re.sub(r"://[^/\s:@]+:[^/\s@]+@", "://[REDACTED]@", text)
        return text if len(text) <= chars else text[:chars] + "…"
    return value


def scratch_path(name: str) -> str:
    return os.path.join(name, uuid.uuid4().hex)
