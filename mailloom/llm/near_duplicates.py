"""Near-duplicate messages (problem 3).

Method: generalised pigeonhole. A text is a bit vector over all runs of k consecutive words. Two texts
of at least the similarity s share at least ceil(s n) of the n runs of either, so at most
TAU = n - ceil(s n) runs of a text are missing in the other.

Partitions: the 2 runs around k-1 words stand or fall together, so bits are grouped by such words: the
partition of a run is the rarer of the two (k-1)-word pieces that it holds, by counts over all texts. It
depends on the run alone, so all texts group alike.

Thresholds: if sum(t_w + 1) >= TAU + 1 over a text's partitions w, then for any similar text there is a w of
which it lacks at most t_w of the text's runs. t_w runs from -1 (skipped) to all runs but one; a dynamic
programme allocates the thresholds of each text by the estimated number of candidates of each partition and
threshold. Partitions are ranked by their counts, equal for all texts; a text allocates within, and is indexed
under, its partitions up to a rank R of its own, which hold more than TAU runs with SLACK to spare. Of two
similar texts the one with the lower R probes partitions that the other is indexed under: no pair is lost.

Probe and verify: texts that share a partition meet; those of fitting length, of which the one lacks
at most t_w runs by a bit mask of the partition, are candidates. Their bit sketches bound the Hamming
distance, and what is left is compared exactly, on the full sets of runs.

Counts come from one table of one byte a cell, counted on the executors by all texts and broadcast, with a size
that follows the number of texts within fixed bounds; collisions cost candidates, not pairs. Equal texts are
one class with one representative, and a partition with many texts is dealt out to several keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.llm import tables
from mailloom.llm.batches import slices
from mailloom.llm.tables import mixed as _mixed
from mailloom.plans.storage import cut, spread

#: Defaults of near-duplicate operators; the queries of problem 3 use 3 words, 0.6 and 40 words.
SHINGLE, SIMILARITY, LEAST_WORDS = 5, 0.8, 0
#: A chunk begins at a word whose hash is the smallest of so many words to each side; 4.7 words on average.
REACH = 2
#: Longs of a bit sketch.
LONGS = 8
#: Runs that the partitions of a text hold, as a multiple of what it must probe: the room of the dynamic programme.
SLACK = 1.2
#: Partitions that are allocated together, runs that may be dropped in each such block, and thresholds tried beside "all".
TOGETHER, DROPPED, THRESHOLDS = 64, 48, 3
#: What looking at a text of a partition costs, in candidates.
LOOK = 0.1
#: Cells of the table of counts per text.
CELLS_A_TEXT = 96
#: Texts of a partition from which it is dealt out to several keys.
HOT = 1 << 13


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and the number of words of each."""
    flat: list[str] = []
    n = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        own = t.split() if t else []
        n[i] = len(own)
        flat += own
    if not flat:
        return np.empty(0, np.uint64), n
    codes, uniques = pd.factorize(np.array(flat, dtype=object))
    return _mixed(pd.util.hash_array(uniques.astype(object), categorize=False))[codes], n


def word_runs(h: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words of all texts, and the number of runs of each. A text of fewer
    than k words has one run, the whole text, if it has words."""
    runs = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    begin = np.concatenate(([0], np.cumsum(n)[:-1]))
    at = np.repeat(begin - np.concatenate(([0], np.cumsum(runs)[:-1])), runs) + np.arange(runs.sum())
    end = np.repeat(begin + n, runs)
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out = _mixed(out * np.uint64(0x100000001B3) + np.where(at + j < end, h[np.minimum(at + j, max(len(h) - 1, 0))], np.uint64(0)))
    return out, runs


def chunk_keys(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the distinct chunks of all texts in the order of the texts, and the number of chunks of each."""
    if not len(h):
        return np.empty(0, np.uint64), np.zeros(len(n), np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    start = np.ones(len(h), bool)
    for s in range(1, REACH + 1):
        together = doc[s:] == doc[:-s]
        start[s:] &= ~together | (h[s:] <= h[:-s])
        start[:-s] &= ~together | (h[:-s] <= h[s:])
    start[np.concatenate(([0], np.cumsum(n)[:-1]))[n > 0]] = True
    at = np.flatnonzero(start)
    place = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
    keys = _mixed(np.add.reduceat(_mixed(h + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), at))
    order = np.lexsort((keys, doc[at]))
    d, k = doc[at][order], keys[order]
    new = np.ones(len(k), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    keep = np.sort(order[new])
    return keys[keep], np.bincount(doc[at][keep], minlength=len(n))


def distinct_runs(h: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of all texts, in ascending order within each, and the number of runs of each."""
    hashes, runs = word_runs(h, n, k)
    doc = np.repeat(np.arange(len(runs)), runs)
    order = np.lexsort((hashes, doc))
    d, x = doc[order], hashes[order]
    new = np.ones(len(x), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    return x[new], np.bincount(d[new], minlength=len(runs))


def sketches(hashes: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """(texts, LONGS) int64 of distinct runs: every run flips one bit, so two sketches differ in no more bits
    than the texts in runs."""
    bit = (_mixed(hashes ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(40)).astype(np.int64) % (64 * LONGS)
    out = np.zeros(len(runs) * LONGS, dtype=np.uint64)
    np.bitwise_xor.at(out, np.repeat(np.arange(len(runs)), runs) * LONGS + bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64))
    return out.reshape(len(runs), LONGS).view(np.int64)


def texts_hash(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the words of each text in order, whatever white space parts them."""
    ends = np.cumsum(n)
    place = (np.arange(len(h)) - np.repeat(ends - n, n)).astype(np.uint64)
    out = []
    for salt in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        x = _mixed(_mixed(h ^ np.uint64(salt)) + place * np.uint64(0xD6E8FEB86659FD93))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
        out.append(_mixed((total[ends] - total[ends - n]) ^ n.astype(np.uint64)))
    return out[0], out[1]


def run_pieces(h: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of all texts, the piece of k-1 words at the head of each and the one at its end, and the number of
    runs of each text. A run of one word, or a text shorter than a run, is its own piece."""
    runs, count = word_runs(h, n, k)
    if k < 2:
        return runs, runs, runs, count
    pieces, have = word_runs(h, n, k - 1)
    first = np.repeat((np.cumsum(have) - have) - (np.cumsum(count) - count), count) + np.arange(len(runs))
    short = np.repeat(have <= count, count)  # fewer words than a run has
    head = np.where(short, runs, pieces[np.minimum(first, max(len(pieces) - 1, 0))] if len(pieces) else runs)
    end = np.where(short, runs, pieces[np.minimum(first + 1, max(len(pieces) - 1, 0))] if len(pieces) else runs)
    return runs, head, end, count


def piece_keys(head: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The partition of each run: the rarer of its pieces, as level of its count (8 bits) and hash (56 bits). Sorting
    by this number ranks partitions alike for all texts."""
    bits = int(len(table)).bit_length() - 1
    rank = lambda x: (table[tables.cells(x, bits)].astype(np.uint64) << np.uint64(56)) | (_mixed(x) >> np.uint64(8))
    return np.minimum(rank(head), rank(end))


def allocate(cost: np.ndarray, look: np.ndarray, size: np.ndarray, parts: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Thresholds t of all partitions of all texts, one text after the other, so that the sum of t + 1 over each
    text is at least `need`.

    size: runs of each partition; cost: per run, in ascending order within its partition, the estimated texts
    that hold it (runs that go together are held by the same texts, so a text that lacks at most t of them holds the
    run t, and cost[t] estimates the candidates at t); look: texts of each partition; parts: partitions of each text.

    Dynamic programme over blocks of TOGETHER partitions. The state is the number of runs that may be dropped, the
    value the greatest saving against probing every partition at its highest threshold. A text whose partitions hold
    more runs than it needs may drop the difference, each block in proportion to its runs."""
    out = size - 1
    if not len(size):
        return out
    text = np.repeat(np.arange(len(parts)), parts)
    held = np.bincount(text, size, len(parts))
    spare = np.maximum(held - need, 0)
    first = np.repeat(np.cumsum(parts) - parts, parts)
    place = np.arange(len(size)) - first
    new = np.ones(len(size), bool)
    new[1:] = (place[1:] % TOGETHER == 0) | (text[1:] != text[:-1])
    block = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(size)))
    of = text[begin]
    may = np.minimum(np.floor(spare[of] * np.bincount(block, size) / np.maximum(held[of], 1)), DROPPED).astype(np.int64)
    asked = np.flatnonzero(may > 0)
    if not len(asked):
        return out
    asked = asked[np.argsort(-length[asked], kind="stable")]
    begin, length, may = begin[asked], length[asked], may[asked]
    states = int(may.max()) + 1
    drop_at = np.arange(states)
    run_at = np.cumsum(size) - size
    full = look * LOOK + cost[run_at + size - 1]
    best = np.zeros((len(asked), states))
    taken = np.zeros((int(length[0]), len(asked), states), np.int8)
    for j in range(int(length[0])):
        live = int(np.searchsorted(-length, -j, "left"))  # blocks with more than j partitions come first
        p = begin[:live] + j
        now = best[:live].copy()
        for t in range(-1, THRESHOLDS):
            allowed = t < size[p] - 1
            save = full[p] - (0 if t < 0 else look[p] * LOOK + cost[run_at[p] + np.minimum(t, size[p] - 1)])
            back = drop_at[None, :] - (size[p] - 1 - t)[:, None]
            value = np.where(allowed[:, None] & (back >= 0), np.take_along_axis(best[:live], np.clip(back, 0, states - 1), 1) + save[:, None], -1.0)
            better = value > now
            now = np.where(better, value, now)
            taken[j, :live][better] = t + 2
        best[:live] = now
    state = may.copy()
    rows = np.arange(len(asked))
    for j in range(int(length[0]) - 1, -1, -1):
        live = int(np.searchsorted(-length, -j, "left"))
        choice = taken[j, rows[:live], state[:live]].astype(np.int64)
        p = begin[:live] + j
        t = np.where(choice > 0, choice - 2, size[p] - 1)
        out[p] = t
        state[:live] -= size[p] - 1 - t
    return out


#: A row of the index: threshold + 1 (6 bits, ANY: whatever is lacking), whether it only probes (1 bit), runs of the
#: text (24 bits, the highest number: that or more), mask of the runs of the partition (32 bits).
ANY, MANY = 63, (1 << 24) - 1


def index_rows(h: np.ndarray, n: np.ndarray, k: int, share: float, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, packed) of the partitions that texts are indexed under and probe. Partitions that no other text
    has are left out: nothing can meet there, though their thresholds count."""
    bits = int(len(table)).bit_length() - 1
    runs, head, end, count = run_pieces(h, n, k)
    if not len(runs):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    part = piece_keys(head, end, table)
    level = table[tables.cells(runs ^ np.uint64(0x5851F42D4C957F2D), bits)]
    doc = np.repeat(np.arange(len(n)), count)
    order = np.lexsort((runs, level, part, doc))
    doc, part, runs, level = doc[order], part[order], runs[order], level[order]
    new = np.ones(len(runs), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (runs[1:] != runs[:-1]) | (part[1:] != part[:-1])
    doc, part, runs, level = doc[new], part[new], runs[new], level[new]
    total = np.bincount(doc, minlength=len(n))
    need = np.minimum(np.floor(share * total).astype(np.int64) + 1, total)
    # partitions, and the runs that those before them hold
    new = np.ones(len(runs), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(runs)))
    text, part = doc[at], part[at]
    before = at - np.repeat(np.cumsum(total) - total, np.bincount(text, minlength=len(n)))
    within = before < np.ceil(need * SLACK)[text]
    keep = np.repeat(within, size)
    runs, level = runs[keep], level[keep]
    text, part, size = text[within], part[within], size[within]
    found = tables.counts_of((part >> np.uint64(56)).astype(np.uint8))
    cost = np.maximum(tables.counts_of(level) - 1, 0)
    t = allocate(cost, np.maximum(found - 1, 0), size, np.bincount(text, minlength=len(n)), need)
    mask = np.bitwise_or.reduceat(np.uint64(1) << (_mixed(runs) & np.uint64(31)), np.cumsum(size) - size) if len(size) else np.empty(0, np.uint64)
    limit = np.where((t + 1 >= size) | (t + 1 >= ANY), np.where(t + 1 >= size, np.minimum(size, ANY), ANY), t + 1).astype(np.uint64)
    packed = (limit << np.uint64(57)) | (np.minimum(total[text], MANY).astype(np.uint64) << np.uint64(32)) | mask
    met = (part >> np.uint64(56)) > tables.ONCE
    text, part, packed, found = text[met], part[met], packed[met], found[met]
    hot = found >= HOT
    if not hot.any():
        return text, part, packed
    # a hot partition: indexed under one of several keys, probed under all of them
    keys = np.where(hot, np.ceil(found / HOT), 1).astype(np.int64)
    own = texts_hash(h, n)[0][text] % keys.astype(np.uint64)
    salted = lambda key, salt: _mixed(key ^ (salt + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25))
    index_key = np.where(hot, salted(part, own), part)
    index_packed = np.where(hot, packed & np.uint64((1 << 57) - 1), packed)
    probes = np.flatnonzero(hot & (packed >> np.uint64(57) > 0))
    times = np.repeat(probes, keys[probes])
    salt = np.arange(len(times)) - np.repeat(np.cumsum(keys[probes]) - keys[probes], keys[probes])
    return (
        np.concatenate((text, text[times])),
        np.concatenate((index_key, salted(part[times], salt.astype(np.uint64)))),
        np.concatenate((index_packed, packed[times] | np.uint64(1 << 56))),
    )


def _text(subject: Column, body: Column) -> Column:
    return F.lower(F.concat(F.coalesce(subject, F.lit("")), F.lit(" "), F.coalesce(body, F.lit(""))))


_SKETCH = [f"s{i}" for i in range(LONGS)]
#: Against rounding, where a bound is a whole number.
_SLACK = 1e-9


def _counted(texts: DataFrame, k: int, least: int) -> np.ndarray:
    """Levels of the counts of all runs and pieces, over all texts that count."""

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in slices(batches, 0):
            h, words = hashed_words(batch.column(0).to_pylist())
            short = np.repeat(words < least, words)
            h, words = h[~short], np.where(words < least, 0, words)
            runs, head, _, count = run_pieces(h, words, k)
            yield runs ^ np.uint64(0x5851F42D4C957F2D)
            # each piece once: all heads, and the end of each text's last run
            yield head if k < 2 else np.concatenate((word_runs(h, words, k - 1)[0], runs[np.repeat(words < k, count)]))

    n = texts.count()
    return tables.level_table(spread(texts.select("text")), keys_of, tables.bits_for(CELLS_A_TEXT * n))


def _hashed(texts: DataFrame, k: int, least: int) -> DataFrame:
    """(id, k1, k2, n, s0...) of the texts with words, and at least `least` of them: n distinct runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            h, words = hashed_words(batch.column(1).to_pylist())
            k1, k2 = texts_hash(h, words)
            hashes, n = distinct_runs(h, words, k)
            sketch = sketches(hashes, n)
            keep = pa.array(words >= max(least, 1))
            longs = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (k1, k2)]
            columns = [batch.column(0), *longs, pa.array(n.astype(np.int32)), *(pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(LONGS))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "k1", "k2", "n", *_SKETCH]).filter(keep)

    return spread(texts.select("id", "text")).mapInArrow(run, f"id bigint, k1 bigint, k2 bigint, n int, {', '.join(f'{c} bigint' for c in _SKETCH)}")


def _indexed(texts: DataFrame, k: int, least: int, table, share: float) -> DataFrame:
    """(key, k1, packed): the rows of index_rows. A task leaves out texts that it has met before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, met = table.value, np.empty(0, np.uint64)
        for batch in slices(batches, 0):
            h, words = hashed_words(batch.column(0).to_pylist())
            k1, _ = texts_hash(h, words)
            first = np.zeros(len(k1), bool)
            first[np.unique(k1, return_index=True)[1]] = True
            use = first & (words >= max(least, 1)) & ~np.isin(k1, met)
            met = np.concatenate((met, k1[use]))
            h, words, k1 = h[np.repeat(use, words)], words[use], k1[use]
            text, key, packed = index_rows(h, words, k, share, counts)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(k1[text].view(np.int64)), pa.array(packed.view(np.int64))], names=["key", "k1", "packed"])

    return spread(texts.select("text")).mapInArrow(run, "key bigint, k1 bigint, packed bigint")


def _met(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: hashes of the texts of which one probes a partition that the other is indexed under."""
    rows = rows.repartition("key").dropDuplicates(["key", "k1", "packed"])
    bit = lambda c, at, width: F.shiftrightunsigned(F.col(c), at).bitwiseAND(F.lit((1 << width) - 1))
    # a number that is set at run time keeps the two filters above the exchange, so that both sides read the same one
    above = lambda cond: F.when(F.spark_partition_id() >= 0, cond)
    probe = rows.where(above(bit("packed", 57, 6) > 0)).select("key", F.col("k1").alias("a"), F.col("packed").alias("p"))
    index = rows.where(above(bit("packed", 56, 1) == 0)).select(F.col("key").alias("_key"), F.col("k1").alias("b"), F.col("packed").alias("q"))
    lacks = F.bit_count(bit("p", 0, 32).bitwiseAND(F.bitwise_not(bit("q", 0, 32))))
    n, m = bit("p", 32, 24), bit("q", 32, 24)
    fits = (F.greatest(n, m) == MANY) | (F.least(n, m) + _SLACK >= similarity * F.greatest(n, m))
    limit = bit("p", 57, 6)
    pairs = probe.join(index, (F.col("key") == F.col("_key")) & (F.col("a") != F.col("b")) & ((limit == ANY) | (lacks < limit)) & fits)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _near(reps: DataFrame, candidates: DataFrame, similarity: float) -> DataFrame:
    """The candidates (a, b), as ids of representatives, whose numbers of runs and sketches allow the similarity."""
    side = lambda x: reps.select(F.col("k1").alias(x), F.col("id").alias(f"{x}_id"), *(F.col(c).alias(f"{x}_{c}") for c in ("n", *_SKETCH)))
    both = candidates.join(side("a"), "a").join(side("b"), "b")
    differ = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in _SKETCH), F.lit(0))
    longer, shorter = F.greatest("a_n", "b_n"), F.least("a_n", "b_n")
    most = (1 - similarity) / (1 + similarity) * (longer + shorter) + _SLACK
    near = both.where((shorter + _SLACK >= similarity * longer) & (differ <= most))
    return near.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))


def _verified(texts: DataFrame, candidates: DataFrame, k: int, similarity: float) -> DataFrame:
    """The candidate pairs (a, b) whose sets of runs are similar enough; with the similarity. Only texts of
    candidates are split and sent: a table of their ids, one byte a cell, tells them apart from most others."""
    spark = texts.sparkSession
    ids = lambda column: np.asarray(column.to_numpy(zero_copy_only=False), np.int64).view(np.uint64)

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield ids(batch.column(0))
            yield ids(batch.column(1))

    bits = tables.bits_for(32 * candidates.count())
    needed = spark.sparkContext.broadcast(tables.level_table(candidates.select("a", "b"), keys_of, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = needed.value
        for whole in batches:
            some = whole.filter(pa.array(table[tables.cells(ids(whole.column(0)), bits)] > 0))
            for batch in slices(iter([some]), 1):
                hashes, n = distinct_runs(*hashed_words(batch.column(1).to_pylist()), k)
                offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64)))], names=["id", "runs"])

    sets = spread(texts.select("id", "text")).mapInArrow(run, "id bigint, runs array<bigint>")
    left, right = (sets.select(F.col("id").alias(x), F.col("runs").alias(f"runs_{x}")) for x in "ab")
    pairs = candidates.join(left, "a").join(right, "b")
    both = F.size(F.array_intersect("runs_a", "runs_b"))
    j = both / (F.size("runs_a") + F.size("runs_b") - both)
    return pairs.select("a", "b", j.alias("similarity")).where(F.col("similarity") >= similarity)


def classes_and_links(texts: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY, least: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(id, rep) of every text with at least `least` words, and (a, b, similarity) for all similar pairs
    of representatives, a < b. Texts with the same words in the same order share a representative,
    the smallest id. texts: (id, text), ids unique; NULL and empty texts belong to no class."""
    spark, share = texts.sparkSession, 1 - similarity + _SLACK
    table = spark.sparkContext.broadcast(_counted(texts, k, least))
    hashed = cut(_hashed(texts, k, least))
    reps = hashed.groupBy("k1", "k2").agg(F.min_by(F.struct("id", "n", *_SKETCH), "id").alias("r")).select("k1", "k2", "r.*")
    members = hashed.select("id", "k1", "k2").join(hashed.groupBy("k1", "k2").agg(F.min("id").alias("rep")), ["k1", "k2"]).select("id", "rep")
    candidates = _met(_indexed(texts, k, least, table, share), similarity)
    return members, _verified(texts, cut(_near(reps, candidates, similarity)), k, similarity)


def texts_of(emails: DataFrame) -> DataFrame:
    """(id, text): subject and body in lower case, NULL as ''. Other columns are ignored."""
    return emails.select(F.col("email_id").alias("id"), _text(F.col("subject"), F.col("body")).alias("text")).where(F.col("id").isNotNull())


def similar_pairs(emails: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY, least: int = LEAST_WORDS) -> DataFrame:
    """(email_id_a, email_id_b), a < b, of all pairs of messages whose runs of k words have a Jaccard
    similarity of at least `similarity`, equal messages included. Empty tables give an empty result;
    messages without words, or with fewer than `least`, are in no pair."""
    members, links = classes_and_links(texts_of(emails), k, similarity, least)
    members, links = cut(members), links.select("a", "b")
    ma, mb = members.select(F.col("rep").alias("a"), F.col("id").alias("x")), members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    across = links.join(ma, "a").join(mb, "b").select("x", "y")
    within = ma.join(members.select(F.col("rep").alias("a"), F.col("id").alias("y")), "a").where(F.col("x") < F.col("y")).select("x", "y")
    both = across.unionByName(within)
    return both.select(F.least("x", "y").alias("email_id_a"), F.greatest("x", "y").alias("email_id_b")).distinct()


def link_counts(emails: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY, least: int = LEAST_WORDS) -> DataFrame:
    """One row per message with words: email_id, class_id (the smallest id among messages with the same
    words), copies (messages in the class) and links (other classes similar to it)."""
    members, links = classes_and_links(texts_of(emails), k, similarity, least)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    copies = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    out = members.join(copies.join(degree, "rep", "left"), "rep").na.fill(0, ["links"])
    return out.select(F.col("id").alias("email_id"), F.col("rep").alias("class_id"), "copies", "links")
