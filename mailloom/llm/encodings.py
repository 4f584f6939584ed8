"""Garbled text from wrong character encoding (problem 1).

Method: every candidate decoding of a line is compressed with zstandard dictionaries, one per
language, made of what is most frequent in all its texts; the chain of decodings with the smallest
description length, the cost of the chain included, wins. If no chain is shorter than the line as it
stands, the line stays unchanged.

Lines that hold something unusual are tried as a whole: a character that the clean texts do not
have, a sign in the middle of a word, or letters in an unusual order. In all lines, words with
letters beyond ASCII that the clean texts do not have are tried one by one, so that letters which
are right in another language or place hide nothing. Lines of known words cost one regular
expression and a look-up per word. The operator is a narrow map; the model has a fixed size and is
broadcast.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.llm import dictionaries
from mailloom.llm.batches import slices
from mailloom.llm.twins import LATIN_LIKE
from mailloom.plans.storage import spread

DICTIONARY_BYTES = 24_576
#: The share of all words with letters beyond ASCII, or of all characters beyond ASCII, from which a word or character counts as clean.
LEAST_SHARE = 2e-7
#: Entries of a task's counter before it is sent on.
COUNTED = 500_000
#: Description length in bytes: of one decoding step, of a character that clean texts lack, of a sign inside a word.
STEP_COST, FOREIGN_COST, INSIDE_COST = 0.75, 3.0, 1.5
#: Of a decoding step that the other lines of a value do not share.
RARE_COST = 8.0
#: What a word that clean texts have saves, where it takes the place of one that they lack; and the letters of such a
#: word that prove a decoding which nothing else in the value shows.
KNOWN_GAIN, PROOF_LETTERS = 1.5, 3
#: Of so many changed words one may mix scripts.
MIXED_WORDS = 5
#: Lines kept at each step of the search over chains, where no chain so far leaves a line without oddities.
BEAM = 3
LOST = "�"

# Single-byte encodings in which UTF-8 is commonly misread, as Python names.
UTF8_READ_AS = ["cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "gbk", "cp1253", "cp1254", "iso8859_2", "koi8_r", "cp1255", "cp1256", "cp1257"]
# Fixed values: (read as, written in) for misreadings among single-byte encodings.
READ_AS_WRITTEN_IN = [
    ("cp1252", "mac_roman"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("mac_roman", "cp1252"),
    ("cp1252", "cp1251"), ("cp1251", "cp866"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("cp1252", "koi8_r"),
    ("cp1252", "cp866"), ("cp1251", "cp1252"), ("cp1251", "iso8859_5"), ("cp1252", "iso8859_5"), ("mac_roman", "cp1251"), ("cp1251", "mac_cyrillic"),
]
# Signs that clean texts use beside letters.
SIGNS = "–—…’‘“”„«»€£¥§°№•·¿¡†®©™"


def _byte_table(name: str) -> dict[str, int]:
    """Character to byte; bytes without a character stand for the control of the same number, as lenient readers do."""
    out = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        if len(c) == 1:
            out.setdefault(c, b)
    for b in range(128, 160):
        out.setdefault(chr(b), b)
    return out


class _Codes(dict):
    """Characters as bytes of a code of our own: one byte for every letter of the clean texts, and one of a
    few for those that they lack. In UTF-8 a decoding could win by shorter characters alone."""

    def __init__(self, known: str):
        super().__init__({i: chr(i) for i in range(128)})
        for i, c in enumerate(known):
            self[ord(c)] = chr(0x80 + i) if i < 128 else "\x01" + chr(0x80 + i % 128) if i < 256 else "\x01\x01" + chr(i % 256)

    def __missing__(self, o: int) -> str:
        self[o] = v = chr(14 + o % 18)
        return v


# Encodings whose readers are known to drop bytes that stand for no character.
_DROPPING = ("cp1252", "cp1250")


class Utf8Reader:
    """Undo the reading of UTF-8 as another encoding, sequence by sequence."""

    def __init__(self, name: str):
        self.name, self.table = name, _byte_table(name) if name != "gbk" else {}
        #: a sequence needs one of these; checked before the pattern runs
        self.leads = frozenset(c for c, b in self.table.items() if b >= 0xC2)
        if name == "gbk":
            self.pattern = re.compile(r"[⺀-鿿€·-◿　-ヿ]+[ -~]?|[⺀-鿿]+")
            return
        self.dropped = [b for b in range(128, 192) if self._undefined(b)]
        cls = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in self.table.items() if lo <= b <= hi) + "]"
        two, three, four, tail = cls(0xC2, 0xDF), cls(0xE0, 0xEF), cls(0xF0, 0xF4), cls(0x80, 0xBF)
        # the no-break space of a sequence may have become a plain one
        self.pattern = re.compile(f"(?:{two}{tail}|{three}{tail}{tail}|{four}{tail}{tail}{tail})+")
        self.short = re.compile(f"({cls(0xC3, 0xC5)}|{cls(0xD0, 0xD1)})(?!{tail})(?=$|[A-Za-z\\s]|{two})") if name in _DROPPING else None

    def _undefined(self, b: int) -> bool:
        try:
            bytes([b]).decode(self.name)
        except UnicodeDecodeError:
            return True
        return False

    def _sub(self, m: re.Match) -> str:
        try:
            raw = m[0].encode("gbk") if self.name == "gbk" else bytes(self.table[c] for c in m[0])
            return raw.decode("utf-8")
        except (UnicodeError, KeyError):
            return self._partly(m[0]) if self.name == "gbk" else m[0]

    def _partly(self, s: str) -> str:
        """Two-byte readings swallow a neighbour or end in half a sequence; what cannot be told becomes LOST."""
        try:
            raw = s.encode("gbk")
        except UnicodeError:
            return s
        text = raw.decode("utf-8", "replace")
        return s if text.count(LOST) > len(text) // 3 + 1 else text

    def __call__(self, line: str, chars: set[str]) -> list[str]:
        if self.leads and self.leads.isdisjoint(chars):
            return []
        out = [self.pattern.sub(self._sub, line)]
        if self.name != "gbk" and self.short and self.short.search(line):
            # a byte that the encoding lacks was dropped: try each
            for b in self.dropped:
                fill = lambda m, b=b: self._filled(m[1], b)
                out.append(self.pattern.sub(self._sub, self.short.sub(fill, line)))
        return out

    def _filled(self, lead: str, b: int) -> str:
        try:
            return bytes([self.table[lead], b]).decode("utf-8")
        except UnicodeError:
            return lead


class Rereader:
    """Undo the reading of one single-byte encoding as another, in the words that need it."""

    def __init__(self, read: str, written: str):
        self.name = f"{written} read as {read}"
        back = _byte_table(read)
        self.map = {}
        for c, b in back.items():
            try:
                d = bytes([b]).decode(written)
            except UnicodeDecodeError:
                continue
            if d != c and len(d) == 1 and not unicodedata.category(d).startswith("C"):
                self.map[ord(c)] = d
        self.used = frozenset(map(chr, self.map))
        self.scripts = "cp1251" in (read, written) or written in ("koi8_r", "cp866", "iso8859_5", "mac_cyrillic")

    def __call__(self, line: str, chars: set[str], unusual) -> list[str]:
        if self.used.isdisjoint(chars):
            return []
        words = re.split(r"([ \t\r]+)", line)
        # what stands alone shows only beside its neighbours that it is odd
        alone = lambda w: not w.isascii() and len(w.strip(".,;:!?")) == 1
        some = "".join(w.translate(self.map) if unusual(w) or alone(w) else w for w in words)
        return list({line.translate(self.map), some} - {line} if self.scripts else {some} - {line})


class Model:
    """Alphabet and dictionaries of clean texts, by language. Pickles to its dictionaries alone."""

    def __init__(self, dictionaries: dict[str, bytes], alphabet: str, words: frozenset[str] = frozenset()):
        self.dictionaries, self.alphabet, self.words = dictionaries, alphabet, words
        cases = "".join(dict.fromkeys(c for x in alphabet for c in (x, x.lower(), x.upper()) if len(c) == 1))
        #: letters and signs of clean texts, with both cases of each letter
        self.known = "".join(dict.fromkeys(alphabet + cases + SIGNS))
        self.codes = _Codes(self.known)
        self.codes_known = frozenset(self.known) | frozenset(map(chr, range(128)))

    def __reduce__(self):
        return Model, (self.dictionaries, self.alphabet, self.words)

    @classmethod
    def train(cls, rows: Iterable[tuple[str | None, str]]) -> Model:
        """rows: (language, text). Works for few or no rows too."""
        counts = Counts()
        for lang, text in rows:
            counts.add(lang, text)
        return cls.of_counts(counts)

    @classmethod
    def of_counts(cls, counts: Counts) -> Model:
        chars, words = Counter(), counts[WORDS, ""]
        for (kind, _), own in list(counts.items()):
            if kind == LETTERS:
                chars.update({c: n for c, n in own.items() if c > "\x7f"})

        def enough(counts: Counter) -> list[str]:
            least = LEAST_SHARE * sum(counts.values())
            return sorted((c for c, n in counts.items() if n >= least and c != RARE), key=lambda c: (-counts[c], c))

        model = cls({}, "".join(enough(chars)), frozenset(enough(words)))
        for lang in sorted(lang for kind, lang in counts if kind == LETTERS):
            model.dictionaries[lang] = dictionaries.dictionary(counts[PIECES, lang], counts[LETTERS, lang], model.encode, DICTIONARY_BYTES)
        return model

    def encode(self, line: str) -> bytes:
        return line.translate(self.codes).encode("latin-1")

    @cached_property
    def compressors(self) -> list:
        out = []
        for raw in self.dictionaries.values():
            d = zstandard.ZstdCompressionDict(raw) if raw else None
            if d:
                d.precompute_compress(level=3)
            out.append(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) if d else zstandard.ZstdCompressor(level=3))
        return out or [zstandard.ZstdCompressor(level=3)]

    @cached_property
    def unusual(self) -> re.Pattern:
        """What makes a line worth trying. Letters beyond the clean ones, signs within words, letters in odd order.
        Invisible characters, spaces, presentation forms and accents are another operator's business."""
        known = re.escape(self.known)
        return re.compile(
            rf"[^\x00-\x7f{known}\xa0\xad\u200b-\u200f\u2060\ufeff\u2000-\u200a\u202f\u205f\u3000\U0001d400-\U0001d7ff\uff00-\uffef\u0300-\u036f]"
            r"|[^\W\d_][€£¥§°¿¡“„«•·†®©™]|[€¥§°№•·†®©™][^\W\d_]|[^\W\d_][–—…”‘»][^\W\d_]"
            r"|[a-zà-öø-ÿ][À-ÖØ-ÞŠŽŸŒ]|\d [À-ÖØ-Þ](?!\w)|(?<=[ ,]) [ùûÑÐÓÔ](?= )|[А-Яа-яёA-Za-z][ÕÔ][a-z]"
            r"|[а-яё][А-Я]|[А-Я]{3}|[À-ÖØ-öø-ÿ]{3}|[ÃÂ][\s\xa0]|[ÐÑ][^\x00-\x7f]"
            r"|[А-Яа-яё][A-Za-z]?[¤¦§«®°±µ¶·»\xad\xa0‚„…†‡‰‹‘’“”•–—™›№][А-Яа-яё]"
        )

    @cached_property
    def _foreign(self) -> re.Pattern:
        return re.compile(rf"[^\x00-\x7f{re.escape(self.known)}\u200b-\u200f\u2060\ufeff\xad\xa0]")

    # signs within words; capitals behind small letters; letters that stand alone where a dash or currency sign would
    _inside = re.compile(
        r"[^\W\d_][–—…”‘»€£¥§°№•·†®©™¿¡“„«÷×¸±´¯¨³²¹¼½¾][^\W\d_]|[^\W\d_][€£¥§°¿¡“„«•†®©™]|[€£¥°•†®©™¿](?=[А-Яа-я])"
        r"|[a-zà-öø-ÿа-яё][À-ÖØ-ÞŠŽŸŒА-Я]|\d [À-ÖØ-Þ](?!\w)|(?<=[ ,]) [ùûÑÐÓÔ](?= )|[A-Za-z]Õ[a-z]"
    )

    def compressed(self, line: str) -> int:
        """Bytes of a line in the language that describes it best."""
        raw = self.encode(line)
        return min(len(c.compress(raw)) for c in self.compressors)

    def length(self, line: str, packed: int | None = None) -> float:
        """Description length of a line: its bytes, and what its odd characters cost beyond them;
        signs at their place, which dictionaries cannot know beside changing numbers, earn that back."""
        packed = self.compressed(line) if packed is None else packed
        return packed + FOREIGN_COST * len(self._foreign.findall(line)) + INSIDE_COST * (len(self._inside.findall(line)) - len(_SIGNS_AT_PLACE.findall(line)))

    def _supported(self, old: str, new: str, old_bytes: int, name: str) -> float:
        """Description length of a candidate; infinite for a rereading that only trades rare letters for known ones:
        it must compress better, take an oddity out of a word, turn a letter into a sign that belongs there, or make
        words that clean texts have."""
        packed = self.compressed(new)
        if not name.startswith("utf-8") and packed >= old_bytes:
            fewer_signs = len(self._inside.findall(new)) < len(self._inside.findall(old))
            if not fewer_signs and len(_SIGNS_AT_PLACE.findall(new)) <= len(_SIGNS_AT_PLACE.findall(old)) and self._known_words(new) <= self._known_words(old):
                return float("inf")
        return self.length(new, packed)

    def _known_words(self, line: str) -> int:
        return sum(w in self.words for w in _WORDS.findall(line.lower()) if not w.isascii())

    @cached_property
    def readers(self) -> tuple[list[Utf8Reader], list[Rereader]]:
        return [Utf8Reader(n) for n in UTF8_READ_AS], [Rereader(*x) for x in READ_AS_WRITTEN_IN]

    def candidates(self, line: str) -> Iterator[tuple[str, str]]:
        utf8, rereaders = self.readers
        chars = {c for c in line if c > "\x7f"}
        seen = {line}
        for r in utf8:
            for c in r(line, chars):
                if c not in seen:
                    seen.add(c)
                    yield f"utf-8 read as {r.name}", c
        unusual = lambda w: bool(self.unusual.search(w))
        for s in rereaders:
            for c in s(line, chars, unusual):
                if c not in seen:
                    seen.add(c)
                    yield s.name, c

    def _plausible(self, old: str, new: str, odd: int) -> bool:
        """A decoding must leave fewer oddities, bring in no characters of scripts that clean texts do not use, and
        change few words into ones that mix scripts, and none that does so by look-alike letters alone."""
        if len(self.unusual.findall(new)) >= odd and LOST not in new:
            return False
        if any(c not in self.codes_known and not ("\xa0" <= c < "\u0250" or "\u2000" <= c < "\u2070" or c == LOST) for c in set(new) - set(old)):
            return False
        a, b = old.split(), new.split()
        if len(a) == len(b):
            changed = [(x, y) for x, y in zip(a, b) if x != y]
            # where bytes were lost, single words of a long passage may stay mixed
            mixed = sum(_MIXED.search(y) is not None for _, y in changed)
            return mixed * MIXED_WORDS <= len(changed) and not any(_MIXED.search(x) and _only_twins(x) for x, _ in changed)
        return len(_MIXED.findall(new)) <= len(_MIXED.findall(old))

    def repair(self, line: str, usual: frozenset[str] = frozenset()) -> tuple[str, list[str]]:
        """The line as it was written, as far as it can be told, and the decodings undone: the chain of least
        description length, the cost of its steps included; the line as it stands where none is shorter.

        The search goes on from the best line of each step while that gets shorter; where the best one still has
        oddities, also from the BEAM next ones, which need not be shorter themselves, as two wrong readings may hide
        each other. Decodings that are usual in the text around cost less, and all others more."""
        if line.isascii():
            return line, []
        odd = len(self.unusual.findall(line))
        if odd:
            packed = self.compressed(line)
            best = (self.length(line, packed), line, [])
            front, seen = [(best[0], line, [], odd, packed)], {line}
            while front:
                found = []
                for before, x, chain, left, plain in front:
                    for name, c in self.candidates(x):
                        if c in seen or not self._plausible(x, c, left):
                            continue
                        seen.add(c)
                        step = STEP_COST if not usual else 0.5 if name in usual else RARE_COST
                        cost = self._supported(x, c, plain, name) + step + STEP_COST * len(chain)
                        if cost < float("inf"):
                            found.append((cost, c, [*chain, name]))
                found.sort(key=lambda f: (f[0], f[2], f[1]))
                shorter = bool(found) and found[0][0] < best[0]
                if shorter:
                    best = found[0]
                left = 0 if best[1].isascii() else len(self.unusual.findall(best[1]))
                if not left or not found:
                    break
                onward = found[: 1 if shorter else BEAM]
                front = [(cost, c, chain, n, self.compressed(c)) for cost, c, chain in onward if not c.isascii() and (n := len(self.unusual.findall(c)))]
                if not shorter and len(found[0][2]) > len(best[2]) + 1:
                    break  # two steps on, and nothing shorter
            line, chain = best[1], best[2]
        else:
            chain = []
        line, name = self.reword(line, usual)
        return line, chain + [name] * bool(name)

    @cached_property
    def strange(self) -> Callable[[str], bool]:
        """Whether a word with letters beyond ASCII is none of the clean texts; those of problem 5 are left alone."""

        @lru_cache(1 << 16)
        def strange(token: str) -> bool:
            return not _DRESSED.search(token) and any(not w.isascii() and w not in self.words for w in _WORDS.findall(token.lower()))

        return strange

    def _proved(self, old: str, new: str, letters: int) -> bool:
        """Whether a rereading makes words that clean texts have, in the usual case, of all that they lack, or a
        letter a currency sign at its number."""
        if _AMOUNT.match(new) and not _AMOUNT.match(old):
            return True
        made = [w for w in _WORDS.findall(new) if not w.isascii()]
        return bool(made) and max(map(len, made)) >= letters and all(w.lower() in self.words and (w[1:].islower() or w.isupper() or len(w) == 1) for w in made)

    def reword(self, line: str, usual: frozenset[str] = frozenset(), only: bool = False) -> tuple[str, str]:
        """The line with its unknown words read anew where that proves right, and the decoding undone ('' for none).
        only: just the decodings `usual`, which other lines of the value prove."""
        tokens = [] if line.isascii() else _SPACES.split(line)
        strange = {t for t in tokens if not t.isascii() and self.strange(t)}
        if not strange:
            return line, ""
        chars = {c for t in strange for c in t if c > "\x7f"}
        utf8, rereaders = self.readers
        readings = [(f"utf-8 read as {r.name}", lambda t, r=r: r(t, set(t))) for r in utf8 if not r.leads or not r.leads.isdisjoint(chars)]
        readings += [(r.name, lambda t, r=r: [t.translate(r.map)]) for r in rereaders if not r.used.isdisjoint(chars)]
        options = []
        for name, read in readings:
            if only and name not in usual:
                continue
            made = [(t, c) for t in strange for c in read(t) if c != t and self._proved(t, c, 1)]
            if not made or not only and not any(self._proved(t, c, PROOF_LETTERS) for t, c in made):
                continue
            fixed = dict(made)
            new = "".join(fixed.get(t, t) for t in tokens)
            if self._plausible(line, new, len(self.unusual.findall(line)) + 1):
                gain = KNOWN_GAIN * (self._known_words(new) - self._known_words(line))
                options.append((self.length(new) - gain + (STEP_COST if not usual else 0.5 if name in usual else RARE_COST), name, new))
        best = min(options, default=None)
        return (best[2], best[1]) if best and best[0] < self.length(line) else (line, "")

    def restore(self, value: str | None) -> tuple[str | None, bool, str]:
        """(restored value, whether it was garbled, the chain of its lines)."""
        if not value or value.isascii():
            return value, False, ""
        lost = LOST in value or _CONTROLS.search(value) is not None
        if not lost and not self.unusual.search(value) and not any(self.strange(t) for t in value.split() if not t.isascii()):
            return value, False, ""
        lines = [(x, *self.repair(x)) for x in value.split("\n")]
        votes = Counter(name for _, _, chain in lines for name in chain)
        if len(votes) > 1:
            # one text was garbled in one or two ways: decodings of single lines must be clearly better
            most = max(votes.values())
            usual = frozenset(n for n, v in votes.items() if v == most or v > 2)
            lines = [(x, *(self.repair(x, usual) if not usual.issuperset(chain) else (fixed, chain))) for x, fixed, chain in lines]
        if votes:
            # what one line proves holds for single words of the others too
            found = frozenset(name for _, _, chain in lines for name in chain)
            for i, (x, fixed, chain) in enumerate(lines):
                again, name = self.reword(fixed, found, True)
                if name:
                    lines[i] = (x, again, [*chain, name])
        names = dict.fromkeys(name for _, _, chain in lines for name in chain)
        return "\n".join(x[1] for x in lines), bool(names) or bool(votes) or lost, "; ".join(names)


_WORDS = re.compile(r"[^\W\d_]+")
_SPACES = re.compile(r"([ \t\r]+)")
_AMOUNT = re.compile(r"\W{0,2}[€£¥]\d")
# invisible characters, spaces, presentation forms and accents
_DRESSED = re.compile("[\xad\u200b-\u200f\u2060\ufeff\u2000-\u200a\u202f\u205f\u3000\U0001d400-\U0001d7ff\uff00-\uffef\u0300-\u036f]")
# currency signs at numbers, dashes between words, ellipses and apostrophes where they belong
_SIGNS_AT_PLACE = re.compile(r"[€£¥]\d|\d [€£¥]| [–—] |\w…|\w’\w")


def _only_twins(word: str) -> bool:
    """Whether all letters of other scripts in a word look like Latin ones: the dirt of problem 5."""
    return all(c in LATIN_LIKE for c in word if "\u0370" <= c <= "\u052f")


_CONTROLS = re.compile(r"[\x80-\x9f]")
_MIXED = re.compile(r"[A-Za-zÀ-ɏ][\u0370-\u03ff\u0400-\u04ff]|[\u0370-\u03ff\u0400-\u04ff][A-Za-zÀ-ɏ]|[\u0370-\u03ff][\u0400-\u04ff]|[\u0400-\u04ff][\u0370-\u03ff]")


#: Kinds of counts: characters, by language; words beyond ASCII, in lower case; words and runs of words, by language.
LETTERS, WORDS, PIECES = 0, 1, 2
#: Stands among the words for all that are too rare to count as clean, so that shares are of all words.
RARE = ""


class Counts(dict):
    """(kind, language) -> item -> how often it occurs. The language is '' for words, and for texts without one."""

    def __missing__(self, key: tuple[int, str]) -> Counter:
        self[key] = made = Counter()
        return made

    def add(self, lang: str | None, text: str) -> None:
        self[LETTERS, lang or ""].update(text)
        pieces = self[PIECES, lang or ""]
        for line in text.split("\n"):
            dictionaries.count_pieces(line, pieces)
        if not text.isascii():
            self[WORDS, ""].update(w for w in _WORDS.findall(text.lower()) if not w.isascii())

    def size(self) -> int:
        return sum(map(len, self.values()))


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every kind and language the rows that a model can have: all characters, of words those that have LEAST_SHARE of
    the words here, which are no more than all words, and of pieces the ones of highest score."""
    most = np.array([1 << 62, 1 << 62, dictionaries.looked_at(DICTIONARY_BYTES)])

    def firsts(t: pa.Table) -> pa.Table:
        t = t.sort_by([("kind", "ascending"), ("lang", "ascending"), ("score", "descending"), ("item", "ascending")])
        kind, lang = t["kind"].to_numpy(), t["lang"].combine_chunks().dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (lang[1:] != lang[:-1])])
        rank = np.arange(len(kind)) - np.repeat(starts, np.diff(np.r_[starts, len(kind)]))
        word, n = kind == WORDS, t["n"].to_numpy()
        rare = word & ((n < LEAST_SHARE * n[word].sum()) | pc.equal(t["item"], RARE).to_numpy())
        kept = t.filter(pa.array((rank < most[kind]) & ~rare))
        if not rare.any():
            return kept
        total = int(n[rare].sum())
        return pa.concat_tables([kept, pa.table([[WORDS], [""], [RARE], [total], [float(total)]], schema=t.schema)])

    kept, new = [], 0
    for batch in batches:
        if batch.num_rows:
            kept.append(pa.table(batch))
            new += batch.num_rows
        if new > COUNTED:
            kept, new = [firsts(pa.concat_tables(kept))], 0
    if kept:
        yield from firsts(pa.concat_tables(kept)).to_batches()


def corpus_counts(documents: DataFrame) -> Counts:
    """What a model is made of, counted over all texts on the executors: all characters, all words beyond ASCII that can be
    clean, 1 / LEAST_SHARE at most, with the number of all others, and of each language the pieces that its dictionary can
    hold; all bounded. documents: lang, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(counts: Counts) -> pa.RecordBatch:
            kinds, langs, items, numbers = [], [], [], []
            for (kind, lang), own in counts.items():
                kinds += [kind] * len(own)
                langs += [lang] * len(own)
                items += own
                numbers += own.values()
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(langs, pa.string()), pa.array(items, pa.string()), pa.array(numbers, pa.int64())], names=["kind", "lang", "item", "n"])

        counts = Counts()
        for batch in slices(batches, 1):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.add(lang, text)
                if counts.size() > COUNTED:
                    yield sent(counts)
                    counts = Counts()
        yield sent(counts)

    texts = documents.where(F.col("text").isNotNull()).select("lang", "text")
    counts = spread(texts).mapInArrow(run, "kind int, lang string, item string, n bigint").groupBy("kind", "lang", "item").agg(F.sum("n").alias("n"))
    score = F.when(F.col("kind") == PIECES, dictionaries.score_column(F.col("item"), F.col("n"))).otherwise(F.col("n").cast("double"))
    # what occurs once tells nothing of other texts
    rows = counts.where((F.col("kind") != PIECES) | (F.col("n") > 1)).withColumn("score", score)
    shape = "kind int, lang string, item string, n bigint, score double"
    got = rows.mapInArrow(_firsts, shape).repartition("kind", "lang").mapInArrow(_firsts, shape).select("kind", "lang", "item", "n").toArrow()
    out = Counts()
    for kind, lang, item, n in zip(*(got.column(c).to_pylist() for c in ("kind", "lang", "item", "n"))):
        out[kind, lang][item] = n
    return out


def train(documents: DataFrame) -> Model:
    """A model of clean text, counted over all documents, with one dictionary for each lang value, and one for the texts
    whose lang is NULL. documents: lang, text; a NULL text counts for nothing."""
    return Model.of_counts(corpus_counts(documents))


def restore_fields(rows: DataFrame, key: str, fields: list[str], model: Model) -> DataFrame:
    """(key, field, restored, chain) of every value in `fields` that was decoded wrongly.

    NULL and empty values are never cases. chain names the decodings undone, '' where the value
    only holds characters that cannot be restored. Values are independent: repeated rows give
    repeated results, other columns are ignored. key must be a bigint column.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches, *range(1, len(fields) + 1)):
            ids, names, values, chains = [], [], [], []
            own = batch.column(0).to_pylist()
            for k, field in enumerate(fields, 1):
                for i, v in zip(own, batch.column(k).to_pylist()):
                    fixed, garbled, chain = m.restore(v)
                    if garbled:
                        ids.append(i), names.append(field), values.append(fixed), chains.append(chain)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(values, pa.string()), pa.array(chains, pa.string())], names=["key", "field", "restored", "chain"])

    # ASCII values are cleared in the JVM and never reach Python
    cols = [F.when(F.col(f).rlike(r"[^\x00-\x7f]"), F.col(f)).alias(f) for f in fields]
    asked = rows.select(F.col(key), *cols).where(F.coalesce(*fields).isNotNull())
    return spread(asked).mapInArrow(run, "key bigint, field string, restored string, chain string").withColumnRenamed("key", key)
