"""Visually identical text with different characters (problem 5).

Method: union-find over strings and code points puts everything that looks alike into one class
(presentation forms with their plain letters, separate accents with joined ones, spaces with the
space, letters of other scripts with those they resemble, transitively). Of each class the member
that is most frequent in the corpus is the representative, one per script where the class spans
several. Text is rewritten greedily, leftmost and longest first, with a multi-pattern automaton.

Letters of another script are rewritten only where they stand in for the letter they look like: in
a word that mixes scripts, or in a word made of look-alikes alone in a text that has no true word
of that script. Words properly written in their own script stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.llm.batches import slices
from mailloom.llm.encodings import Model
from mailloom.llm.twins import LATIN_LIKE, small_capitals
from mailloom.plans.storage import spread

#: Compatibility decompositions that make a letter or digit a presentation form; raised and lowered signs,
#: fractions and squared abbreviations are signs of their own.
FORMS = ("<wide>", "<narrow>", "<font>", "<circle>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Letters with such a decomposition that are signs or letters of their own.
OWN = set("µŉſĿŀϐϑϒϕϖϰϱϲϴϵϹ")
_WORD = re.compile(r"[^\W\d_]+")
_MARKS = "[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]"
#: A letter or digit with the separate accents behind it.
_CLUSTER = re.compile(rf"[^\W_]{_MARKS}+")
#: Scripts that have look-alikes of Latin letters, by the first word of their letters' names.
SCRIPTS = {"LATIN": "Latin", "CYRILLIC": "Cyrillic", "GREEK": "Greek", "ARMENIAN": "Armenian", "CHEROKEE": "Cherokee", "COPTIC": "Coptic"}
SMALL = small_capitals()
_OTHER = re.compile("[\u0370-\u058f\u13a0-\u13ff\u1f00-\u1fff\u2c80-\u2cff\uab70-\uabbf" + "".join(sorted(SMALL)) + "]")
#: Latin letters that have no small capital, or look like one as they are.
_NO_CAPITAL = set("qsxcovwzf")


def invisible(c: str) -> bool:
    o = ord(c)
    return unicodedata.category(c) == "Cf" or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)


def odd_space(c: str) -> bool:
    return c != " " and unicodedata.category(c) == "Zs"


def presentation_form(c: str) -> bool:
    """A letter or digit in a presentation form."""
    d = unicodedata.decomposition(c)
    if not d.startswith("<") or c in OWN or d.split()[0] not in FORMS or unicodedata.category(c)[0] not in "LN" and d.split()[0] not in ("<wide>", "<circle>"):
        return False
    return all(unicodedata.category(x)[0] in "LNM" for x in unicodedata.normalize("NFKC", c))


@lru_cache(None)
def script(c: str) -> str:
    """The script of a letter as far as it matters here: small capitals count as one of their own; '' for all others."""
    return "Small" if c in SMALL else SCRIPTS.get(unicodedata.name(c, "").split(" ")[0], "") if c.isalpha() else ""


class Classes:
    """Union-find over strings; a class is the set of strings that look alike."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def root(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a: str, b: str) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def classes(self) -> Iterator[list[str]]:
        by: dict[str, list[str]] = {}
        for x in sorted(self.parent):
            by.setdefault(self.root(x), []).append(x)
        yield from by.values()


class Rewriter:
    """Look-alike classes of a corpus, their representatives, and the rewriting of texts.

    A text is a case where rewriting its letters, digits, spaces and invisible characters changes it. Full-width signs
    and characters that are defined as equal to another (as the Kelvin sign) are brought to one form too, but make no case."""

    def __init__(self, counts: dict[str, int]):
        """counts: how often each character, and each letter with separate accents, occurs. What a text has and the
        corpus lacks joins the classes when it is met, as if it occurred 0 times."""
        self.counts = dict(counts)
        self._settle()

    def _settle(self) -> None:
        """Classes and representatives of all that is known so far."""
        letters, signs, across = Classes(), Classes(), Classes()
        for c in self.counts:
            if len(c) > 1:
                joined = unicodedata.normalize("NFC", c)
                if len(joined) < len(c):
                    letters.join(c, joined)
            elif invisible(c):
                letters.join(c, "")
            elif odd_space(c):
                letters.join(c, " ")
            elif presentation_form(c):
                letters.join(c, unicodedata.normalize("NFKC", c))
            elif unicodedata.decomposition(c).startswith("<wide>"):
                signs.join(c, unicodedata.normalize("NFKC", c))
            elif len(unicodedata.normalize("NFC", c)) == 1 and unicodedata.normalize("NFC", c) != c:
                signs.join(c, unicodedata.normalize("NFC", c))
        for a, b in (LATIN_LIKE | SMALL).items():
            across.join(a, b)
        self.forms, self.signs = self._representatives(letters), self._representatives(signs)
        self.across: dict[tuple[str, str], str] = {}
        for members in across.classes():
            for target in SCRIPTS.values():
                own = [m for m in members if script(m) == target]
                if own:
                    # one script may have several look-alikes of a class: the most frequent stands for them
                    best = max(own, key=lambda m: (self.counts.get(m, 0), m))
                    self.across |= {(m, target): best for m in members if script(m) != target}
        self._machines = [_machine(self.forms), _machine(self.signs)]

    def _representatives(self, classes: Classes) -> dict[str, str]:
        out: dict[str, str] = {}
        for members in classes.classes():
            plain = [m for m in members if not self._marked(m)] or members
            best = max(plain, key=lambda m: (self.counts.get(m, 0), m))
            out |= {m: best for m in members if m and m != best}
        return out

    def __reduce__(self):
        return Rewriter, (self.counts,)

    @staticmethod
    def _marked(m: str) -> bool:
        return any(invisible(c) or odd_space(c) or unicodedata.decomposition(c).startswith("<") for c in m) or unicodedata.normalize("NFC", m) != m

    def _learn(self, text: str) -> None:
        new = units(text) - self.counts.keys()
        if new:
            self.counts |= dict.fromkeys(new, 0)
            self._settle()

    def _replaced(self, text: str, which: int) -> str:
        """The text with all members of classes replaced, until none is left: a rewritten letter may take an accent
        that follows it. Representatives are no keys, so every round leaves fewer keys."""
        while True:
            self._learn(text)
            ends, automaton = self._machines[which]
            if ends.isdisjoint(text):
                return text
            out, at = [], 0
            for end, (n, new) in automaton.iter_long(text):
                out += [text[at : end - n + 1], new]
                at = end + 1
            if not out:
                return text
            text = "".join(out) + text[at:]

    def words_in_one_script(self, text: str) -> str:
        """The text with stand-in letters of other scripts replaced."""
        if not _OTHER.search(text):
            return text
        found = [(m.start(), m[0], {script(c) for c in m[0]} - {""}) for m in _WORD.finditer(text) if not m[0].isascii()]
        true = {s for _, w, kinds in found if len(kinds) == 1 for s in kinds if s != "Latin" and not all((c, "Latin") in self.across for c in w)}
        latin = re.search(r"[A-Za-z]{2}", text) is not None
        out, at = [], 0
        for start, w, kinds in found:
            new = w
            if "Small" in kinds:
                # a word in small capitals; single ones among ordinary letters are phonetic signs
                if kinds <= {"Small", "Latin"} and all(script(c) != "Latin" or c in _NO_CAPITAL for c in w) and len(w) > 2:
                    new = "".join(self.across.get((c, "Latin"), c) if c in SMALL else c for c in w)
            elif len(kinds) > 1:
                new = self._word(w, kinds, true)
            elif latin and kinds and not kinds & (true | {"Latin"}) and all((c, "Latin") in self.across for c in w):
                new = "".join(self.across[c, "Latin"] for c in w)
            if new != w:
                out += [text[at:start], new]
                at = start + len(w)
        return "".join(out) + text[at:] if out else text

    def _word(self, w: str, kinds: set[str], true: set[str]) -> str:
        """A word of several scripts in one of them: Latin, unless the text has true words of another one or the
        word has letters that only another one has; then the one with most letters."""
        by = Counter(script(c) for c in w)
        fits = [t for t in {*kinds, "Latin"} if all(script(c) in (t, "") or (c, t) in self.across for c in w)]
        if not fits:
            return w
        target = max(fits, key=lambda t: (t in true or t == "Latin", by[t], t == "Latin"))
        return "".join(self.across.get((c, target), c) if script(c) not in (target, "") else c for c in w)

    def case_form(self, text: str | None) -> str | None:
        """The text with letters, digits, spaces and invisible characters in their one form; NULL stays NULL."""
        if not text or text.isascii():
            return text
        return self.words_in_one_script(self._replaced(text, 0))

    def rewrite(self, text: str | None) -> str | None:
        """The one form of a text; NULL stays NULL."""
        if not text or text.isascii():
            return text
        return self._replaced(self.case_form(text), 1)

    def is_case(self, text: str | None) -> bool:
        """Whether a text has characters that look like others, as problem 5 defines it: rewriting changes it."""
        return self.case_form(text) != text


def _machine(forms: dict[str, str]):
    """(last characters of the keys, automaton) for the keys of forms."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, v in forms.items():
        a.add_word(k, (len(k), v))
    a.make_automaton()
    return frozenset(k[-1] for k in forms), a


def units(text: str) -> set[str]:
    """What classes are made of: characters beyond ASCII, and letters with the separate accents behind them."""
    return {c for c in set(text) if c > "\x7f"} | {m[0] for m in _CLUSTER.finditer(text)}


def char_counts(rows: DataFrame, fields: list[str]) -> dict[str, int]:
    """How often each character, and each letter with a separate accent, occurs in all values of the fields.
    Counted on the executors; the result is bounded by the number of characters there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, plain = Counter(), np.zeros(128, np.int64)
        for batch in slices(batches, *range(len(fields))):
            for k in range(len(fields)):
                values = [x for x in batch.column(k).to_pylist() if x]
                ascii_only = "".join(x for x in values if x.isascii())
                plain += np.bincount(np.frombuffer(ascii_only.encode(), np.uint8), minlength=128)
                text = "\n".join(x for x in values if not x.isascii())
                total.update(text)
                total.update(m[0] for m in _CLUSTER.finditer(text))
        total.update({chr(i): n for i, n in enumerate(plain.tolist()) if n})
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["c", "n"])

    some = rows.select(*fields).where(F.coalesce(*fields).isNotNull())
    got = spread(some).mapInArrow(run, "c string, n bigint").groupBy("c").agg(F.sum("n").alias("n")).collect()
    return {r["c"]: r["n"] for r in sorted(got)}


def _asked(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    cols = [F.when(F.col(f).rlike(r"[^\x00-\x7f]"), F.col(f)).alias(f) for f in fields]
    return rows.select(F.col(key), *cols).where(F.coalesce(*fields).isNotNull())


def find_cases(rows: DataFrame, key: str, fields: list[str], garbled: Model, garbled_fields: Iterable[str]) -> DataFrame:
    """(key, field, rewritten) of every value with characters that look like others. Values of garbled_fields
    that were decoded wrongly are left out. NULL and empty values are none; other columns are ignored."""
    sent = rows.sparkSession.sparkContext.broadcast((Rewriter(char_counts(rows, fields)), garbled, frozenset(garbled_fields)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewriter, model, also = sent.value
        for batch in slices(batches, *range(1, len(fields) + 1)):
            out: list[tuple] = []
            own = batch.column(0).to_pylist()
            for k, f in enumerate(fields, 1):
                for i, v in zip(own, batch.column(k).to_pylist()):
                    if rewriter.is_case(v) and not (f in also and model.restore(v)[1]):
                        out.append((i, f, rewriter.rewrite(v)))
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["key", "field", "rewritten"])

    return spread(_asked(rows, key, fields)).mapInArrow(run, "key bigint, field string, rewritten string").withColumnRenamed("key", key)


def one_form(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fields...) of every row, each value in its one form. Repeated rows stay, NULL stays NULL."""
    sent = rows.sparkSession.sparkContext.broadcast(Rewriter(char_counts(rows, fields)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewriter = sent.value
        for batch in slices(batches, *range(1, len(fields) + 1)):
            done = [pa.array([rewriter.rewrite(v) for v in batch.column(k).to_pylist()], pa.string()) for k in range(1, len(fields) + 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *done], names=["key", *fields])

    kinds = ", ".join(f"`{f}` string" for f in fields)
    return spread(rows.select(key, *fields)).mapInArrow(run, f"key bigint, {kinds}").withColumnRenamed("key", key)
