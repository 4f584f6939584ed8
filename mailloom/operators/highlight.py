"""Mark matched phrases and risky links in a body for display."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def marked(body: str, phrases: list[str], links: list[tuple[str, list[str]]]) -> str:
    """The body, HTML-escaped, with phrases (in any case) and then links wrapped in <mark>; the text stays."""
    out = html.escape(body)
    for p in phrases:
        out = re.sub(re.escape(p), lambda m: f'<mark title="Matched phishing keyword">{m[0]}</mark>', out, flags=re.IGNORECASE)
    for url, reasons in links:
        shown = html.escape(url)
        title = html.escape("; ".join(r for r in reasons if r)) or "Suspicious link"
        out = out.replace(shown, f'<mark title="{title}">{shown}</mark>')
    return out


def highlighted(scored: DataFrame, key: str) -> DataFrame:
    """(key, marked) of scored messages (body, matched_keywords, suspicious_urls): marked() in Arrow batches. NULL
    bodies stay NULL, NULL arrays count as empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[1:]))
            out = [None if b is None else marked(b, p or [], [(u["url"], u["reasons"] or []) for u in links or []]) for b, p, links in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["key", "marked"])

    kind = scored.schema[key].dataType.simpleString()
    return scored.select(key, "body", "matched_keywords", "suspicious_urls").mapInArrow(run, f"key {kind}, marked string").withColumnRenamed("key", key)
