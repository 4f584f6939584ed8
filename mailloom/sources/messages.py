"""Read mail: raw messages, labelled corpora, pasted text, brand files; batch and stream."""

from __future__ import annotations

import re
from collections.abc import Iterator
from email import policy
from email.header import decode_header
from email.parser import BytesParser
from email.utils import getaddresses

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.functions.cleaning import clean_characters, html_text

PARSED = (
    "message_id string, reply_to string, return_path string, date_hdr string, from_addr string, to_addr string, cc string, bcc string, subject string, body string, "
    "mime_version string, content_type string, content_transfer_encoding string, attachments array<string>, received array<string>, body_type string, parse_error string"
)
_NAMES = [c.split()[0] for c in PARSED.split(", ")]


def _first(value) -> str | None:
    return next((a for _, a in getaddresses([str(value)]) if a), None) if value else None


def _decoded(subject: str) -> str:
    try:
        return "".join(p.decode(c or "utf-8") if isinstance(p, bytes) else str(p) for p, c in decode_header(subject))
    except Exception:  # noqa: BLE001 - an undecodable subject stays as it is
        return subject


def _bodies(message) -> tuple[str, list[str], str]:
    """Text of the plain and HTML parts joined by newlines, names of the other parts, type of the first text part."""
    texts, names, kind = [], [], ""
    if not message.is_multipart():
        payload = message.get_payload(decode=True)
        kind = message.get_content_type()
        if not payload:
            return "", [], kind
        text = payload.decode("utf-8", "ignore")
        return (clean_characters(html_text(text)) if kind == "text/html" else text), [], kind
    for part in message.walk():
        own, name = part.get_content_type(), part.get_filename()
        if name:
            names.append(name)
        elif own in ("text/plain", "text/html"):
            text = (part.get_payload(decode=True) or b"").decode("utf-8", "ignore")
            texts.append(html_text(text) if own == "text/html" else text)
            kind = kind or own
    return "\n".join(t for t in texts if t), names, kind


def _values(message, name: str) -> list:
    """All values of a header, parsed; bytes beyond ASCII are read as UTF-8."""
    found = [v for k, v in message.raw_items() if k.lower() == name.lower()]
    plain = ["".join(str(v).splitlines()).encode("utf-8", "surrogateescape").decode("utf-8", "replace") for v in found]
    return [policy.default.header_factory(name, v) for v in plain]


def parse_message(raw: bytes | None) -> dict:
    """The fields of one raw message. Missing headers have their defaults; whatever fails leaves parse_error."""
    out: dict = dict.fromkeys(_NAMES)
    try:
        m = BytesParser(policy=policy.default).parsebytes(raw or b"")
        value = lambda name: next(iter(_values(m, name)), None)
        text = lambda name, default="": default if (v := value(name)) is None else str(v)
        sender = value("From")
        body, names, kind = _bodies(m)
        out |= {
            "message_id": re.sub("[<>]", "", text("Message-ID").strip()) or None,
            "reply_to": _first(value("Reply-To")) or _first(sender),
            "return_path": re.sub("[<>]", "", text("Return-Path").strip()) or _first(value("Sender") or sender),
            "date_hdr": text("Date", "No Date"), "from_addr": text("From", "No Sender"), "to_addr": text("To", "No Recipients"), "cc": text("Cc"), "bcc": text("Bcc"),
            "subject": _decoded(text("Subject", "No Subject")), "body": body, "mime_version": text("Mime-Version"), "content_type": text("Content-Type"),
            "content_transfer_encoding": text("Content-Transfer-Encoding"), "attachments": names, "received": [str(r) for r in _values(m, "Received")], "body_type": kind,
        }
    except Exception as e:  # noqa: BLE001 - one bad message must not end the job
        out["parse_error"] = f"{type(e).__name__}: {e}"[:500]
    return out


def parse(raw: Column) -> Column:
    """struct of PARSED from a binary column: one Arrow-batched function for all fields."""

    @F.pandas_udf(f"struct<{', '.join(c.replace(' ', ':', 1) for c in PARSED.split(', '))}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([parse_message(x) for x in batch], columns=_NAMES)

    return run(raw)


def _with_parsed(files: DataFrame) -> DataFrame:
    p = files.select(F.col("path").alias("file"), parse(F.col("content")).alias("p"))
    return p.select("file", "p.*", F.array_join("p.attachments", "; ").alias("attachments_text"))


def read_eml(spark: SparkSession, path: str, repartition: int | None = None) -> DataFrame:
    """Every .eml file under path (upper-case extensions too), parsed; other files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").endswith(".eml"))
    return _with_parsed(files.repartition(repartition) if repartition else files)


def stream_eml(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of new files."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return _with_parsed(spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[eE][mM][lL]").load(path))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(path, label, text) of a corpus in folders ham and spam; text is what follows the first blank line, or
    all of it; malformed bytes are left out, line ends are \\n."""

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda b: b.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n"))

    files = spark.read.format("binaryFile").load(f"{path}/{{ham,spam}}")
    t = files.select("path", F.regexp_extract("path", "/(ham|spam)/[^/]*$", 1).alias("label"), decode("content").alias("t"))
    at = F.instr("t", "\n\n")
    return t.select("path", "label", F.when(at > 0, F.substring("t", at + 2, F.length("t"))).otherwise(F.col("t")).alias("text"))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """A mail dump in JSON lines, as it is."""
    return spark.read.json(path)


def pasted(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Messages that consist of a body only; every other field is ''."""
    empty = [F.lit("").alias(c) for c in ("from_addr", "reply_to", "return_path", "message_id", "subject", "attachments")]
    rows = spark.createDataFrame(list(enumerate(texts)), "email_id bigint, body string")
    return rows.select("email_id", *empty, "body", F.array().cast("array<string>").alias("received"))


def read_brand_file(spark: SparkSession, path: str) -> DataFrame | None:
    """(ord, value) of the lines of a brand file; None where there is no such file."""
    try:
        lines = spark.read.text(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return lines.select(F.monotonically_increasing_id().alias("ord"), "value")


def write(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Write results as parquet, or as one JSON object a row."""
    df.write.mode("overwrite").format(form).save(path)
