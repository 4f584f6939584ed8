"""Keyword-stuffed pages, link lists and tag lists (problem 9).

Method: for every term the gaps between its recurrences and, for lags up to the length of the
document, the autocorrelation of the word sequence; unnaturally dense or regular recurrence marks
stuffed words, and so do lists of many different words without function words, links and
tags. A document is a case if real sentences hold less than a quarter of its words and
stuffed words most of the rest. Words that recur at one distance all through a text are stuffed even where
function words are strewn among them. Lines of logs, orders and program code count for neither.
Texts written without spaces are read character by character.

Lags up to LAG are counted one by one. For longer ones, Fourier transforms of random signs of the
words estimate all lags of a document at once, and the highest are counted exactly.

The operator is a narrow map: words are split in Python once per batch, everything else is
numpy over the whole batch. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from mailloom.llm.batches import slices
from mailloom.plans.storage import spread

# Frequent function words of the languages in use. Left out are words that
# labels use too (in stock, near me, on sale).
FUNCTION_WORDS = """
the of and to is for that with we are this you it as by from be at has have was were will our your not or which who when
yet so if they their its than then between before after because about through into could would please how what my he she
but one per under an all been only also more than no any there while since until once instead
der die das den dem des und ist zu mit im von für am bitte wir auf ein eine einen einer aus bis nicht hat haben sind wird
um über ich sie es auch dass weil oder ob noch uns ihnen bei nach wenn seit möchte
le la les de du et que un une pour dans sur nous vous est au aux par avec pas se ne qui il elle mais été sera avant car vers
el los las una por para con del al se lo su está no más ya como pero desde porque hasta qué
o os a as um uma com na em do da dos das é são às foi que não fará até está segundo
и в на не что по из с до за его её он она мы вы я но а к у от для был была было только снова кто потому
het een zijn wij aan deze ook naar bij voor wordt hebben heeft niet maar
il di che non sono della delle nel gli questo anche più alla
się nie jest że jak ale przez oraz przed może
och att det som inte är på för av med har
""".split()
# Frequent function characters of Chinese and Japanese, whose texts are read character by character.
FUNCTION_CHARACTERS = "的了是在我有和就不人都也很到说要去你会着没看这个那他她它们为以与而の に は を た が で て と し れ さ も か ら".replace(" ", "")
#: Words to each side of a word that are looked at to tell whether it stands in a sentence.
REACH = 6
#: Function words within that window that make a sentence.
SENTENCE_WORDS = 2
#: Longest gap between recurrences that counts as stuffing in any document, and longest lag that is always counted.
LAG = 24
#: Autocorrelation, and places per different word outside sentences, from which recurrence at any gap counts.
REGULAR, REPEATS = 0.2, 3.0
#: Random signs of a word in the estimate of the autocorrelation, and lags counted after it.
SIGNS, TOP_LAGS = 4, 4
#: Autocorrelation from which words that recur at one distance are stuffed though function words stand among them,
#: and how often the distance must fit into the text: a text that is there twice is no stuffing.
PERIODIC, PERIODS = 0.5, 4
#: Share of the tokens of a line from which signs of program code make it a record.
CODE_SHARE = 0.2
#: Share of words in sentences below which a document can be a case.
SENTENCES = 0.25
#: Share of stuffed words from which it is one.
STUFFED = 0.5
COLUMNS = "words int, sentence_share double, stuffed_share double, link_share double, tag_share double, recurrence double, regularity double, listing double"

_LINK = re.compile(r"https?://|www\.|href=|\]\(|</?a\b")
_TAG = re.compile(r"#[^\W\d_]\w*$")
_RECORD = re.compile(r"\W*(?:<\w+>)?(?:\d{1,2}[:.]\d{2}|\d{1,3}$|\d{1,3}(?:x|[.)])$)")
_TIMED = re.compile(r"\W*(?:<\w+>)?\d{1,2}[:.]\d{2}")
#: Share of the words of a document's counted lines that recur in others of them, from which these are no records.
LISTED = 0.75
#: Words up to which a line that begins with a time or a count is a record.
RECORD_WORDS = 20
_MARK = re.compile(r"[/|»;,>·•、，；]$|^[/|»·•、，；]")
_EDGE = re.compile(r"^\W+|\W+$")
_CODE = re.compile(r"^[{}]+[;,]?$|^\w[\w.]*\(|[=!<>+*/-]=|^=$|=>|->|::|\)[;{:]$")
_UNSPACED = re.compile("([\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff])")
#: Stands for a line break among the words; a private-use character, read as a line break where a text holds it.
NEWLINE = "\ue00a"


def _token_traits(tokens: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per distinct token: number of its bare form (-1: none), and what it looks like."""
    bare = [_EDGE.sub("", t).lower() for t in tokens]
    functions = {*FUNCTION_WORDS, *FUNCTION_CHARACTERS}
    form = pd.factorize(np.array(bare, dtype=object))[0] if len(bare) else np.empty(0, int)
    traits = [
        np.array([t == NEWLINE for t in tokens], bool),
        np.array([b in functions and not _MARK.match(t) and not _LINK.search(t) for t, b in zip(tokens, bare)], bool),
        np.array([bool(_LINK.search(t)) for t in tokens], bool),
        np.array([bool(_TAG.match(t)) for t in tokens], bool),
        np.array([bool(_RECORD.match(t)) for t in tokens], bool),
        np.array([bool(_TIMED.match(t)) for t in tokens], bool),
        np.array([t[-1:] in ".!?…" and len(b) > 1 or t[-1:] in "。！？" for t, b in zip(tokens, bare)], bool),
        np.array([not b for b in bare], bool),
        np.array([bool(_MARK.search(t)) for t in tokens], bool),
        np.array([bool(_CODE.search(t)) and not _LINK.search(t) for t in tokens], bool),
        pd.util.hash_array(np.array(bare, dtype=object), categorize=False),
    ]
    return form, *traits


def _top_lags(hashed: np.ndarray, named: np.ndarray, total: np.ndarray) -> np.ndarray:
    """(TOP_LAGS, documents): the lags beyond LAG at which most words of a document seem to recur; 0 for none.
    Documents of like length are transformed together, padded so that no lag wraps around."""
    out = np.zeros((TOP_LAGS, len(total)), np.int64)
    begin = np.cumsum(total) - total
    size = np.where(total > LAG + TOP_LAGS, np.ceil(np.log2(np.maximum(total, 1))).astype(np.int64) + 1, 0)
    for k in np.unique(size[size > 0]):
        own = np.flatnonzero(size == k)
        row, place = np.repeat(np.arange(len(own)), total[own]), np.arange(total[own].sum()) - np.repeat(np.cumsum(total[own]) - total[own], total[own])
        at = begin[own][row] + place
        power = np.zeros((len(own), (1 << k) // 2 + 1), np.float32)
        for sign in range(SIGNS):
            x = np.zeros((len(own), 1 << k), np.float32)
            x[row, place] = ((hashed[at] >> np.uint64(sign + 7) & np.uint64(1)).astype(np.float32) * 2 - 1) * named[at]
            power += np.abs(np.fft.rfft(x)) ** 2
        estimate = np.fft.irfft(power)[:, : 1 << k - 1]
        lags, n = np.arange(1 << k - 1), total[own][:, None]
        estimate = np.where((lags > LAG) & (lags < n), estimate / np.maximum(n - lags, n / 2), -1.0)
        out[:, own] = np.argpartition(estimate, -TOP_LAGS, axis=1)[:, -TOP_LAGS:].T
    return out


def features(texts: list[str | None]) -> pd.DataFrame:
    """One row per text, in order; shares are of the words (split at white space), 0 for no words."""
    flat: list[str] = []
    n = np.zeros(len(texts), dtype=np.int64)
    for k, t in enumerate(texts):
        own = _UNSPACED.sub(r" \1 ", t).replace("\n", f" {NEWLINE} ").split() if t else []
        n[k] = len(own)
        flat += own
    if not flat:
        return pd.DataFrame({c.split()[0]: np.zeros(len(texts), "int32" if "int" in c else float) for c in COLUMNS.split(", ")})
    codes, uniques = pd.factorize(np.array(flat, dtype=object))
    form, newline, function, link, tag, record, timed, ends, mark_only, separator, code, hashed = (x[codes] for x in _token_traits(uniques))
    doc = np.repeat(np.arange(len(texts)), n)

    # lines that begin like a record (log, order list, agenda) hold neither sentences nor stuffing
    line = np.cumsum(newline) + doc
    first = np.ones(len(line), bool)
    first[1:] = (line[1:] != line[:-1]) | newline[:-1]
    word = ~newline
    starts = first & word
    line_id = np.cumsum(starts | newline)
    is_record = np.zeros(line_id[-1] + 1, bool)
    is_record[line_id[starts & record]] = True
    is_record &= np.bincount(line_id[word], minlength=len(is_record)) <= RECORD_WORDS
    in_record = is_record[line_id] & word & ~link
    # but where most words behind the counts recur line for line, they are keywords; times lead logs and agendas
    is_timed = np.zeros(len(is_record), bool)
    is_timed[line_id[starts & timed]] = True
    counted = in_record & ~is_timed[line_id] & ~starts
    told = np.flatnonzero(counted & (form >= 0) & ~function)
    at = pd.DataFrame({"d": doc[told], "f": form[told], "line": line_id[told]})
    across = at.groupby(["d", "f"]).line.transform("nunique").to_numpy() > 1
    share_across = np.bincount(at.d[across], minlength=len(texts)) / np.maximum(np.bincount(doc[counted], minlength=len(texts)), 1)
    in_record &= ~((share_across >= LISTED)[doc] & ~is_timed[line_id])
    # lines of program code are records too
    is_code = np.bincount(line_id[code & word], minlength=len(is_record)) >= CODE_SHARE * np.maximum(np.bincount(line_id[word], minlength=len(is_record)), 1)
    in_record |= is_code[line_id] & word & ~link

    # the word sequence without line breaks
    keep = np.flatnonzero(word)
    d, f = doc[keep], form[keep]
    total = np.bincount(d, minlength=len(texts))
    begin = np.concatenate(([0], np.cumsum(total)[:-1]))
    pos = np.arange(len(keep)) - begin[d]

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(d[flags], minlength=len(texts)) / np.maximum(total, 1)

    fw = (function[keep] & ~in_record[keep]).astype(np.int64)
    total_fw = np.concatenate(([0], np.cumsum(fw)))
    # windows end at sentence ends and at the ends of the text, so that lists do not borrow a neighbour's function words
    e = ends[keep]
    segment = np.cumsum(np.concatenate(([0], e[:-1].astype(np.int64)))) + d
    new = np.ones(len(segment), bool)
    new[1:] = segment[1:] != segment[:-1]
    seg_start = np.flatnonzero(new)
    seg = np.cumsum(new) - 1
    seg_end = np.append(seg_start[1:], len(keep))
    i = np.arange(len(keep))
    lo, hi = np.maximum(seg_start[seg], i - REACH), np.minimum(seg_end[seg], i + REACH + 1)
    near = total_fw[hi] - total_fw[lo]
    tags, links = tag[keep], link[keep]
    need = np.where(hi - lo <= REACH, 1, SENTENCE_WORDS)
    sentence = (near >= need) & ~in_record[keep] & ~tags & (~links | (near >= 2 * SENTENCE_WORDS))

    # recurrence: the gap to the last and to the next place of the same form within the document
    named = (f >= 0) & ~mark_only[keep]
    order = np.lexsort((i, f, d))
    gap = np.full(len(keep), 1 << 30)
    same = (d[order][1:] == d[order][:-1]) & (f[order][1:] == f[order][:-1])
    step = np.where(same, pos[order][1:] - pos[order][:-1], 1 << 30)
    gap[order[1:]] = step
    gap[order[:-1]] = np.minimum(gap[order[:-1]], step)
    # regularity: the highest autocorrelation over all lags; period: the lag that has it, of those that fit in PERIODS times
    regular, periodic, period = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)

    def seen(lag: np.ndarray, strength: np.ndarray) -> None:
        nonlocal regular
        regular = np.maximum(regular, strength)
        better = (strength > periodic) & (lag > 0) & (lag * PERIODS <= total)
        periodic[better], period[better] = strength[better], lag[better]

    for lag in range(1, LAG + 1):
        hit = np.zeros(len(keep), bool)
        hit[lag:] = (f[lag:] == f[:-lag]) & (d[lag:] == d[:-lag]) & named[lag:]
        seen(np.full(len(texts), lag), np.bincount(d[hit], minlength=len(texts)) / np.maximum(total - lag, 1))

    def met(lag: np.ndarray) -> np.ndarray:
        """Places of words that recur at the lag of their document."""
        to = np.minimum(i + lag[d], len(keep) - 1)
        return named & (lag[d] > 0) & (d[to] == d) & (pos + lag[d] == pos[to]) & (f[to] == f)

    for lag in _top_lags(hashed[keep], named, total):
        seen(lag, np.bincount(d[met(lag)], minlength=len(texts)) / np.maximum(np.maximum(total - lag, total / 2), 1))
    ahead = met(np.where(periodic >= PERIODIC, period, 0))
    beats = ahead.copy()
    beats[np.flatnonzero(ahead) + period[d[ahead]]] = True
    # an unnaturally regular beat is no sentence, whatever function words it holds
    sentence &= ~beats
    # places per different word, outside sentences and records
    loose = np.flatnonzero(named & ~sentence & ~in_record[keep] & ~fw.astype(bool))
    most = int(f.max()) + 1 if len(f) else 1
    forms = np.unique(d[loose] * most + f[loose]) // most
    repeats = np.bincount(d[loose], minlength=len(texts)) / np.maximum(np.bincount(forms, minlength=len(texts)), 1)
    anywhere = (regular >= REGULAR) | (repeats >= REPEATS)
    recurs = named & (((gap <= LAG) | (gap < 1 << 30) & anywhere[d]) & ~fw.astype(bool) | beats)
    # listings: words between list marks, line breaks included, without function words around
    breaks = np.zeros(len(keep), bool)
    breaks[:-1] = (np.diff(keep) > 1) & (d[1:] == d[:-1])
    marks = np.concatenate(([0], np.cumsum((separator[keep] | breaks).astype(np.int64))))
    listing = (marks[hi] - marks[lo] >= 2) & (near == 0)
    stuffed = ((recurs & ~sentence) | tags | links | (listing & ~sentence) | mark_only[keep] & ~sentence) & ~in_record[keep]
    # a keyword between recurring ones is stuffed too, where no function word stands near
    dense = np.concatenate(([0], np.cumsum(stuffed.astype(np.int64))))
    stuffed |= (near == 0) & ~in_record[keep] & (2 * (dense[hi] - dense[lo]) >= hi - lo)
    return pd.DataFrame(
        {
            "words": total.astype("int32"), "sentence_share": share(sentence), "stuffed_share": share(stuffed), "link_share": share(links), "tag_share": share(tags),
            "recurrence": share(recurs), "regularity": regular, "listing": share(listing),
        }
    )


def score_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, words, sentence_share, stuffed_share, link_share, tag_share, recurrence, regularity,
    listing, stuffed) of every document. NULL and empty texts have 0 words and are no cases; repeated
    rows give repeated rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            x = features(batch.column(1).to_pylist())
            x["stuffed"] = (x.words > 0) & (x.sentence_share < SENTENCES) & (x.stuffed_share >= STUFFED)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[c].to_numpy()) for c in x)], names=["doc_id", *x])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, f"doc_id bigint, {COLUMNS}, stuffed boolean")


def stuffed_pages(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents that consist mainly of keywords, links or tags; distinct."""
    return score_pages(documents).where("stuffed").select("doc_id").distinct()
