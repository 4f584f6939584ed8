"""Evaluation texts leaking into training text (problem 7).

Method: every shard of the corpus gets a suffix array over its words; every suffix of
every test item is looked up in it by binary search; the hits are extended word by word
to the longest verbatim match. The corpus is never shuffled: a shard lives in one task.

Only suffixes that can match are sorted: the corpus is encoded in the vocabulary of the
test items, and a suffix whose first MIN_WORDS words are not all in it cannot begin a
match of that length. The array is ordered by the first MIN_WORDS words, which is all
that decides a leak; longer matches are told apart in the extension step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.plans.storage import spread

#: Words a document and an item must share in a row.
MIN_WORDS = 13
#: Words of a shard; a task builds one array after the other, so this bounds its memory.
SHARD_WORDS = 1_500_000
#: Characters of test items sent to the executors at once; more are taken in further passes.
BLOCK_CHARS = 32_000_000
#: Hits expanded at once.
HITS = 2_000_000

WORD = re.compile(r"[^\W_]+")
LEAKS = "doc_id bigint, item_id bigint, words int, doc_pos int, item_pos int"


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case; none for NULL."""
    return WORD.findall(text.lower()) if text else []


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for each start and count, one after the other."""
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return shift + np.arange(counts.sum())


class Items:
    """The encoded test items: one array of word numbers, 0 between items."""

    def __init__(self, rows: list[tuple[int, str | None]], least: int = MIN_WORDS):
        self.least, self.ids, self.vocabulary = least, [], {}
        flat: list[int] = []
        at: list[int] = []
        for item, text in rows:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            at.append(len(flat))
            self.ids.append(item)
            flat += own + [0]
        self.flat = np.array(flat or [0], dtype=np.uint32)
        self.start = np.array(at, dtype=np.int64)
        good = run_lengths(self.flat) >= least
        self.suffixes = np.flatnonzero(good)
        self.keys = keys(self.flat, self.suffixes, least)


def run_lengths(flat: np.ndarray) -> np.ndarray:
    """At each position, how many words follow (itself included) before the next 0."""
    zeros = np.flatnonzero(flat == 0)
    nxt = np.searchsorted(zeros, np.arange(len(flat)))
    ends = np.append(zeros, len(flat))
    return ends[nxt] - np.arange(len(flat))


def keys(flat: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """The first words of each suffix as bytes that sort like the words."""
    if not len(at):
        return np.empty(0, dtype=f"S{4 * least}")
    table = flat[at[:, None] + np.arange(least)].astype(">u4")
    return np.ascontiguousarray(table).view(f"S{4 * least}").ravel()


def search_shard(items: Items, docs: list, flat: np.ndarray, starts: np.ndarray) -> list[tuple]:
    """(doc, item, words, doc_pos, item_pos) of the longest match of each pair in one shard.

    flat holds the words of all documents of the shard, each followed by a 0."""
    least = items.least
    at = np.flatnonzero(run_lengths(flat) >= least)
    if not len(at) or not len(items.suffixes):
        return []
    array_keys = keys(flat, at, least)
    order = np.argsort(array_keys, kind="stable")
    suffix_array, array_keys = at[order], array_keys[order]
    low = np.searchsorted(array_keys, items.keys, "left")
    count = np.searchsorted(array_keys, items.keys, "right") - low
    best: dict[tuple[int, int], tuple] = {}
    hit = np.flatnonzero(count)
    bounds = np.searchsorted(np.cumsum(count[hit]), np.arange(HITS, count[hit].sum() + HITS, HITS)) if len(hit) else []
    begin = 0
    for end in bounds:
        part = hit[begin : end + 1]
        begin = end + 1
        if not len(part):
            continue
        d = suffix_array[_ranges(low[part], count[part])]
        t = np.repeat(items.suffixes[part], count[part])
        # a hit whose previous words agree too lies inside a longer match
        inner = (d > 0) & (t > 0) & (flat[d - 1] == items.flat[t - 1]) & (flat[d - 1] != 0)
        d, t = d[~inner], t[~inner]
        n = np.full(len(d), least)
        live = np.arange(len(d))
        while len(live):
            x, y = d[live] + n[live], t[live] + n[live]
            same = (flat[x] == items.flat[y]) & (flat[x] != 0)
            live = live[same]
            n[live] += 1
        doc = np.searchsorted(starts, d, "right") - 1
        item = np.searchsorted(items.start, t, "right") - 1
        first = np.lexsort((d, -n, item, doc))
        doc, item, n, d, t = doc[first], item[first], n[first], d[first], t[first]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
        for a, b, c, x, y in zip(*(v[new].tolist() for v in (doc, item, n, d - starts[doc], t - items.start[item]))):
            if (a, b) not in best or best[a, b][2] < c:
                best[a, b] = (docs[a], items.ids[b], c, x, y)
    return list(best.values())


def search(batches: Iterator[pa.RecordBatch], items: Items, shard_words: int = SHARD_WORDS) -> Iterator[pa.RecordBatch]:
    """All leaks of a partition, shard by shard; batches hold (id, text)."""
    code = items.vocabulary.get
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("words", pa.int32()), ("doc_pos", pa.int32()), ("item_pos", pa.int32())])
    docs: list = []
    parts: list[np.ndarray] = []
    starts: list[int] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        found = search_shard(items, docs, np.concatenate(parts), np.array(starts)) if docs else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = [code(w, 0) for w in words(text)]
            if len(own) < items.least:
                continue
            own.append(0)
            docs.append(i)
            starts.append(size)
            parts.append(np.array(own, dtype=np.uint32))
            size += len(own)
            if size >= shard_words:
                yield from flush()
                docs, parts, starts, size = [], [], [], 0
    yield from flush()


def find_leaks(documents: DataFrame, items: DataFrame, least: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, words, doc_pos, item_pos): the longest run of words (at least `least`)
    that document and item share, and where it begins in both, counted in words from 0.

    documents needs doc_id and text, items needs item_id and text; other columns are ignored.
    NULL or short texts match nothing; empty tables give an empty result; equal rows give one
    row; of matches of one length the first place in the document counts. The items are sent to
    the executors in blocks of about block_chars characters, so any number of them works.
    """
    docs = spread(documents.select("doc_id", "text"))
    size = items.select(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_chars))
    out = None
    for b in range(blocks):
        part = items.select("item_id", "text").where(F.col("text").isNotNull())
        part = part.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else part
        sent = documents.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in part.distinct().collect()], least))
        found = docs.mapInArrow(lambda it, sent=sent: search(it, sent.value), LEAKS)
        out = found if out is None else out.unionByName(found)
    best = F.max_by(F.struct("words", "doc_pos", "item_pos"), F.struct("words", -F.col("doc_pos"), -F.col("item_pos")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("m")).select("doc_id", "item_id", "m.words", "m.doc_pos", "m.item_pos")


def remove_leaked(documents: DataFrame, items: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """The documents without those that share a run of words with an item; columns as given.

    Documents with a NULL doc_id cannot be named by a leak and stay."""
    leaked = find_leaks(documents, items, least).select(F.col("doc_id").alias("_leaked")).distinct()
    return documents.join(leaked, documents["doc_id"] == F.col("_leaked"), "left_anti")
