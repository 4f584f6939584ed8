"""Quoted history, signatures and notices in emails (problem 4).

Method: a body is segmented into paragraphs, and these into blocks of one kind of line. Every block is described
by contact density, quote depth, sender frequency, ancestor overlap, its shape and place, and how its words
read; gradient-boosted trees decide whether it is the sender's own new text.

Sender frequency: how many messages of the sender hold the lines of the block, digits aside. Ancestor overlap: the
share of the block's passages that messages of the same thread (subject without Re: and the like) hold unquoted. Both
are statistics over all messages, counted on the executors in one table that follows the size of the input within
fixed bounds, and broadcast.

How words read is learnt, not listed: for hashed words and their places in the block's lines, how often they stand in
blocks that are not new, and in blocks behind which nothing new follows (log-odds). These weights and the trees are fitted
on a bounded sample of messages (TRAIN_MESSAGES, a documented parameter). Its labels come from rules on conventions of
mail (prefixes, introductions, header blocks, closing phrases, delimiters, wordings of notices), of which the
trees see nothing but quote marks. Each half of the sample gets the weights of the other half, so that the trees
learn how far words can be relied on.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.llm import tables
from mailloom.llm.batches import slices
from mailloom.llm.boosting import Trees
from mailloom.llm.encodings import READ_AS_WRITTEN_IN, UTF8_READ_AS
from mailloom.llm.near_duplicates import chunk_keys, hashed_words
from mailloom.llm.tables import mixed
from mailloom.plans.storage import spread

#: Bound of the training sample.
TRAIN_MESSAGES = 4000
#: Cells of the table of counts per message.
CELLS_A_MESSAGE = 24
#: Weights of words, as a power of two; words of a line that are looked at from its begin and from its end.
WORD_BITS, HEAD_WORDS, TAIL_WORDS = 18, 14, 3

_INVISIBLE = re.compile("[\xad\u200b-\u200f\u2060\ufeff]+")
_SPACES = re.compile(r"[^\S\n\r\t ]")

# Conventions of mail in the languages in use.
_CLOSINGS = (
    "best regards|kind regards|warm regards|with best regards|many regards|regards|best wishes|all the best|best|many thanks|thanks a lot|thanks again|thanks|thank you|thx|cheers|"
    "yours sincerely|yours faithfully|sincerely yours|sincerely|yours|"
    r"(?:mit )?(?:viele|beste|liebe|sch\S{1,6}ne|freundliche|herzliche)n? gr\S{1,9}en?|gr\S{1,4}[ßs]e?n?|mfg|lg|vielen dank|danke|"
    r"(?:bien )?cordialement|bien \S{1,4} vous|(?:meilleures |sinc\S{1,4}res )?salutations|amicalement|merci(?: beaucoup)?|"
    r"(?:un )?(?:cordial )?saludos?(?: cordiales?)?|atentamente|(?:muchas )?gracias|un abrazo|"
    r"(?:um )?abra\S{1,6}os?|atenciosamente|(?:com os melhores )?cumprimentos|(?:muito )?obrigad[oa]|"
    "с уважением|с наилучшими пожеланиями|всего доброго|спасибо"
)
_NAME = r"(?:[ \t]+[^\W\d_a-zа-яё][\w.'’-]*){0,4}"
CLOSING = re.compile(rf"(?i:{_CLOSINGS})\s*[,.!–—-]?(?-i:{_NAME})\s*[,.]?$")
QUOTE = re.compile(r"\s{0,3}(?:[A-Z]{1,4}>|>|\|(?=\s|$))(?:\s?[>|])*")
DELIMITER = re.compile(r"(?:-- ?|[-_=*~#+]{3,}|[-~]{2,}[-~ ]+)$")
HEADER = re.compile(
    r"(?i)[*\s]{0,3}(?:from|sent|to|subject|cc|bcc|date|reply-to|von|gesendet|an|betreff|datum|de|envoy\S{1,9}|\S{1,6}|objet|enviad[oa](?: el)?|para|asunto|fecha|assunto|data|от|отправлено|кому|тема|дата|копия) ?:[*]? ?\S"
)
_HEAD_WORD = re.compile(r"(?i)[*\s]{0,3}(?:from|sent|to|subject|cc|bcc|date|von|gesendet|an|betreff|datum|de|envoy\S{1,9}|objet|enviad[oa](?: el)?|para|asunto|fecha|assunto|data|от|отправлено|кому|тема|дата|копия) ?:")
FORWARD = re.compile(
    r"(?i)[*>\s]{0,3}(?:-{2,}|_{2,}|={2,}) ?[^-_=\n]{0,60}?(?:message|nachricht|mensaje|mensagem|сообщение|origin|urspr|forward|weitergeleitet|transf|reenvi|encaminhad|пересл|исходн)[^\n]{0,40}(?:-{2,}|_{2,}|={2,})[*\s]{0,3}$"
    r"|begin forwarded message ?:|anfang der weitergeleiteten nachricht ?:|d\S{1,5}but du message (?:transf|r\S{1,6}exp)"
)


def _misread(phrases: list[str]) -> list[str]:
    """The phrases as common wrong encodings show them, in lower case, the longest first."""
    ways = [("utf-8", r) for r in UTF8_READ_AS] + [(w, r) for r, w in READ_AS_WRITTEN_IN]
    out = set()
    for p in phrases:
        for written, read in ways:
            try:
                out.add(p.encode(written).decode(read, "replace" if written == "utf-8" else "strict").lower())
            except UnicodeError:
                continue
    # bodies are read without invisible characters and with plain spaces
    out = {_SPACES.sub(" ", _INVISIBLE.sub("", x)) for x in out}
    return sorted({x for x in out if x not in {p.lower() for p in phrases} and len(x) > 3}, key=lambda x: (-len(x), x))


#: Closings and verbs with letters beyond ASCII, garbled: bodies may hold the dirt of problem 1.
_GARBLED_CLOSINGS = tuple(_misread(["С уважением", "С наилучшими пожеланиями", "Bien à vous", "Viele Grüße", "Beste Grüße", "Freundliche Grüße", "Liebe Grüße", "Mit freundlichen Grüßen", "Abraços"]))
_AFTER_CLOSING = re.compile(rf"\s*[,.!–—-]?{_NAME}\s*[,.]?$")
INTRODUCTION = re.compile(r"(?i)(?:\b(?:wrote|said|writes|schrieb|escreveu)\b|\ba \S{1,6}crit\b|\bescribi\S{1,6}|написал|" + "|".join(map(re.escape, _misread(["написал"]))) + ")")
_DATE = re.compile(r"\d{1,4}[-./]\d{1,2}[-./]\d{2,4}|\b(?:19|20)\d{2}\b|\d{1,2}:\d{2}|@")
DEVICE = re.compile(r"(?i)\*?(?:sent from|sent with|sent via|get [\w ]{2,30} for (?:pocket|mobile|ios|android|iphone|smart)\w*|written on the go|gesendet (?:von|mit)|von meinem .{2,30} gesendet|von unterwegs|envoy\S{1,8} (?:de|depuis)|enviado (?:desde|do|de)|отправлено с)\b")
NOTICE = (
    "confidential", "privileged", "vertraulich", "confidentiel", "confidencial", "конфиденциальн", "meant to write to", "meant only for", "intended recipient", "intended only for",
    "accepts no liability", "liability for damage", "managing director", "registered in", "think of the trees", "before you print", "views expressed", "without consent", "delete this mail",
    "nicht der empf", "nur für die genannten", "destiné aux seules", "have received this", "any use, copying", "unbefugt", "geschäftsführer",
)
LISTING = (
    "announce list", "mailing list", "to leave:", "unsubscribe", "as a member of", "you get this because", "abmelden", "désabonner", "darse de baja", "отписаться", "--~--~", "group settings", "list archive", "archive no",
)
GATEWAY = re.compile(r"(?i)^\[?external\]?|^\[extern|came from outside|^\*{3}.*\*{3}$|^caution ?:|scanned by|by the .{1,40} gateway|sender is not known")
_CONTACT = re.compile(r"\S+@\S+|https?://|www\.|(?:\+|\(0|\(\d{3}\)|\b(?:tel|phone|fax|mobile|t|f|m)\b[.:]?) ?[\d(]|\b555[ -]\d{3,4}")
_PERSONAL = re.compile(r"\S+@\S+|(?:\+|\(0|\(\d{3}\)|\b(?:tel|phone|fax|mobile|t|f|m)\b[.:]?) ?[\d(]|\b555[ -]\d{3,4}")
_MORE_THAN = re.compile(r"\s{0,3}> ?\d+(?:[.,]\d+)? ?(?:%|\w)")
_PS = re.compile(r"(?i)p\.? ?s\b")
_DIGITS = re.compile(r"\d+")

SHAPE = (
    "quote_depth contact_density sender_frequency ancestor_overlap quoted words_per_line longest_line lines words sentences short_lines from_start from_end paragraph_start "
    "quoted_number previous_quoted next_quoted after_quote"
).split()
_READ = [f"{what}_{how}" for what in ("old", "last") for how in ("sum", "mean", "most", "least")]
FEATURES = [*SHAPE, *_READ, *(f"{side}_{x}" for side in ("previous", "next") for x in ("old_mean", "old_most", "last_mean", "last_most")), "before_old_mean", "before_old_most", "any_last_before"]


class Block:
    __slots__ = ("kind", "lines", "texts", "paragraph")

    def __init__(self, kind: str, paragraph: int):
        self.kind, self.lines, self.texts, self.paragraph = kind, [], [], paragraph


def blocks_of(body: str) -> list[Block]:
    """The non-blank lines of a body in blocks of one kind, with their line numbers from 1."""
    out: list[Block] = []
    paragraph, fresh = 0, True
    if not body.isascii():
        body = _SPACES.sub(" ", _INVISIBLE.sub("", body))
    lines = body.split("\n")
    for no, line in enumerate(lines, 1):
        text = line.strip()
        if not text:
            paragraph, fresh = paragraph + 1, True
            continue
        if QUOTE.match(line):
            kind = "quoted"
        elif len(text) <= 60 and (CLOSING.match(text) or not text.isascii() and _garbled_closing(text)):
            kind = "closing"
        elif DELIMITER.match(text):
            kind = "delimiter"
        elif FORWARD.match(text):
            kind = "forward"
        elif GATEWAY.match(text):
            kind = "gateway"
        elif _HEAD_WORD.match(text):
            kind = "header"
        elif DEVICE.match(text):
            kind = "device"
        else:
            kind = "text"
        last = out[-1] if out else None
        if last and last.kind == "header" and kind == "text" and not fresh and len(last.lines) > 1 and HEADER.match(text):
            kind = "header"
        # a wrapped line goes on where the line above stopped
        if last and not fresh and kind == "text" and last.kind in ("gateway", "device"):
            kind = last.kind
        # a signature's lines below its closing or delimiter stay one block of text
        if last is None or fresh or kind != last.kind or kind in ("closing", "delimiter", "forward"):
            out.append(Block(kind, paragraph))
        out[-1].lines.append(no)
        out[-1].texts.append(text if kind != "quoted" else line)
        fresh = False
    return _with_introductions(out)


def _garbled_closing(text: str) -> bool:
    low = text.lower()
    return any(low.startswith(g) and _AFTER_CLOSING.match(text[len(g) :]) for g in _GARBLED_CLOSINGS)


def _with_introductions(blocks: list[Block]) -> list[Block]:
    """Split introductions ("... wrote:"), of up to four lines, off the end of the text blocks that they end."""
    out: list[Block] = []
    for i, b in enumerate(blocks):
        nxt = blocks[i + 1] if i + 1 < len(blocks) else None
        if b.kind == "header" and len(b.lines) == 1:
            b.kind = "text"  # one line with a colon is no header block
        if b.kind in ("text",):
            # lines of ordinary text may follow an introduction without a blank line: look at every line that ends in a colon
            for end in range(len(b.texts) - 1, -1, -1):
                if not b.texts[end].endswith(":"):
                    continue
                for start in range(end, max(end - 4, -1), -1):
                    joined = " ".join(b.texts[start : end + 1])
                    if len(joined) <= 260 and INTRODUCTION.search(joined) and (_DATE.search(joined) or nxt and nxt.kind == "quoted" and end == len(b.texts) - 1):
                        # go on upwards while the lines above belong to it: a name or a date cut off from its verb
                        while start > 0 and end - start < 3 and not re.search(r"[.!?:,]$", b.texts[start - 1]) and len(b.texts[start - 1]) < 75 and not _complete(" ".join(b.texts[start : end + 1])):
                            start -= 1
                        for kind, lo, hi in (("text", 0, start), ("introduction", start, end + 1), ("text", end + 1, len(b.texts))):
                            if hi > lo:
                                part = Block(kind, b.paragraph)
                                part.lines, part.texts = b.lines[lo:hi], b.texts[lo:hi]
                                out.append(part)
                        break
                else:
                    continue
                break
            else:
                out.append(b)
            continue
        out.append(b)
    return out


def _complete(s: str) -> bool:
    """Whether an introduction has a date and a name or address before or behind its verb."""
    return bool(re.match(r"(?i)(?:on|at|am|le|el|em|in)\b|\d", s) and re.search(r"\d", s)) or bool(re.match(r"[^\W\d_]+[ ,]+[^\W\d_]+.*(?:wrote|schrieb|said|написал)", s) and re.search(r"\d", s))


def label(blocks: list[Block]) -> np.ndarray:
    """1 for blocks that the sender did not newly write, by the conventions; the labels for training."""
    y = np.zeros(len(blocks), np.int8)
    forwarded = signature = False
    for i, b in enumerate(blocks):
        nxt = blocks[i + 1] if i + 1 < len(blocks) else None
        prev = blocks[i - 1] if i else None
        joined = " ".join(b.texts)
        notice = b.kind != "quoted" and any(_cues(joined))
        if forwarded:
            y[i] = 1
            continue
        if b.kind == "quoted":
            alone = len(b.lines) == 1 and _MORE_THAN.match(b.texts[0]) and not (prev and y[i - 1] and prev.kind in ("introduction", "quoted")) and not (nxt and nxt.kind == "quoted")
            y[i], signature = not alone, False
        elif b.kind == "introduction":
            y[i], signature = 1, False
        elif b.kind == "forward":
            y[i], forwarded = 1, True
        elif b.kind == "header":
            y[i], forwarded = 1, True
        elif b.kind in ("gateway", "device"):
            y[i] = 1
        elif b.kind == "closing":
            y[i], signature = 1, True
        elif b.kind == "delimiter":
            follows = nxt is not None and nxt.paragraph == b.paragraph
            y[i] = 1
            if follows and nxt.kind == "header":
                pass
            elif follows:
                signature = True
        elif notice:
            y[i], signature = 1, False
        elif signature and _signature_like(b):
            y[i] = 1
        elif prev is not None and prev.kind in ("delimiter",) and prev.paragraph == b.paragraph and (len(prev.texts[0]) >= 25 or _signature_like(b)):
            y[i] = 1
        elif _contact_card(b):
            y[i], signature = 1, True
        else:
            signature = False
    return y


@functools.cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in enumerate((NOTICE, LISTING)):
        for w in words:
            a.add_word(w, kind)
    a.make_automaton()
    return a


def _cues(text: str) -> tuple[int, int]:
    """How many wordings of notices, and of list footers, a text holds; one scan for all of them."""
    found = [0, 0]
    for _, kind in _automaton().iter(text.lower()):
        found[kind] += 1
    return found[0], found[1]


def _contacts(b: Block) -> int:
    return sum(bool(_CONTACT.search(t)) for t in b.texts)


def _signature_like(b: Block) -> bool:
    """Short lines: names, titles, numbers. A sentence or a postscript is none."""
    if len(b.lines) > 8 or _PS.match(b.texts[0]):
        return False
    for t in b.texts:
        n = t.count(" ") + 1
        if n > 7 and not _CONTACT.search(t) or n > 4 and t[-1:] in ".!?" and not _CONTACT.search(t):
            return False
    return True


def _contact_card(b: Block) -> bool:
    """Two or more short lines, one of them with a mail address or a phone number: a signature without a closing."""
    if len(b.texts) < 2 or b.kind == "quoted" or not _signature_like(b):
        return False
    found = [bool(_PERSONAL.search(t)) for t in b.texts]
    return any(found) and all(f or t.count(" ") < 5 for f, t in zip(found, b.texts))


_TO_ZERO = str.maketrans("123456789", "000000000")
_PUNCTUATION = ".,;:!?()[]*\"'<>„“”«»"


def shape(blocks: list[Block]) -> np.ndarray:
    """(blocks, SHAPE) of one message, without sender frequency and ancestor overlap."""
    n = len(blocks)
    x = np.zeros((n, len(SHAPE)), np.float32)
    after = False
    for i, b in enumerate(blocks):
        row, lines, quoted = x[i], len(b.lines), b.kind == "quoted"
        counts = [t.count(" ") + 1 for t in b.texts]
        words = sum(counts)
        if quoted:
            row[0] = sum(m[0].count(">") + m[0].count("|") for m in map(QUOTE.match, b.texts) if m) / lines
        row[1] = sum(bool(_CONTACT.search(t)) for t in b.texts) / words
        row[4], row[5], row[6], row[7], row[8] = quoted, words / lines, max(counts), lines, words
        row[9] = sum(t[-1:] in ".!?" and c > 5 for t, c in zip(b.texts, counts)) / lines
        row[10] = sum(c <= 7 for c in counts) / lines
        row[11], row[12] = i, n - 1 - i
        row[13] = i == 0 or blocks[i - 1].paragraph != b.paragraph
        row[14] = quoted and lines == 1 and _MORE_THAN.match(b.texts[0]) is not None
        row[15] = i > 0 and blocks[i - 1].kind == "quoted"
        row[16] = i + 1 < n and blocks[i + 1].kind == "quoted"
        row[17] = after
        after |= quoted
    return x


def tokens(b: Block) -> list[str]:
    """Words of the first two lines and the last one of a block, digits as 0, and how its lines begin and end."""
    out = [f"#{min(len(b.texts), 5)}"]
    for text in b.texts if len(b.texts) <= 3 else (b.texts[0], b.texts[1], b.texts[-1]):
        parts = text.lower().translate(_TO_ZERO).split()
        head = [t.strip(_PUNCTUATION) or t[:4] for t in parts[: 6 if b.kind == "quoted" else HEAD_WORDS]]
        out += head
        out += (f"^{head[0]}", f"^{head[0]} {head[1] if len(head) > 1 else ''}", f"${parts[-1][-1]}{len(parts) > 1}")
        if len(parts) > HEAD_WORDS:
            out += [t.strip(_PUNCTUATION) for t in parts[-TAIL_WORDS:]]
    return out


class Wording:
    """Log-odds of words for two questions on their block: is it old text, and does nothing new follow it."""

    def __init__(self, weights: np.ndarray):
        #: (2, words)
        self.weights = weights

    @classmethod
    def train(cls, cells: np.ndarray, n: np.ndarray, y: np.ndarray) -> Wording:
        """cells: words of all blocks, n: of each block, y: (2, blocks)."""
        size = 1 << WORD_BITS
        total = np.bincount(cells, minlength=size)
        held = np.stack([np.bincount(cells, np.repeat(t.astype(float), n), size) for t in y])
        share = (held + 0.5) / (total + 1)
        return cls(np.where(total > 0, np.log(share / (1 - share)), 0).astype(np.float32))

    def read(self, cells: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(blocks, _READ): sum, mean, highest and lowest weight of the words of each block. Every block has words."""
        if not len(n):
            return np.zeros((0, len(_READ)), np.float32)
        at = np.cumsum(n) - n
        out = []
        for w in self.weights:
            x = w[cells]
            total = np.add.reduceat(x, at)
            out += [np.clip(total, -60, 60), total / n, np.maximum.reduceat(x, at), np.minimum.reduceat(x, at)]
        return np.stack(out, axis=1).astype(np.float32)


def with_neighbours(x: np.ndarray, read: np.ndarray, message: np.ndarray) -> np.ndarray:
    """(blocks, FEATURES) from the shape, the reading of words, and that of the blocks around in the same message."""
    n = len(x)
    if not n:
        return np.zeros((0, len(FEATURES)), np.float32)
    some = read[:, [1, 2, 5, 6]]
    first = np.ones(n, bool)
    first[1:] = message[1:] != message[:-1]
    last = np.append(first[1:], True)
    previous, following = np.roll(some, 1, axis=0), np.roll(some, -1, axis=0)
    previous[first], following[last] = 0, 0
    before = np.roll(previous[:, :2], 1, axis=0)
    before[first] = 0
    highest = pd.Series(read[:, 5]).groupby(message).cummax().to_numpy()
    highest = np.roll(highest, 1)
    highest[first] = -20
    return np.concatenate([x, read, previous, following, before, highest[:, None]], axis=1).astype(np.float32)


_ADDRESS = re.compile(r"[^\s<>()\[\],;:\"]+@[^\s<>()\[\],;:\"]+")


def _hash(items: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(items, dtype=object), categorize=False) if items else np.empty(0, np.uint64)


def _sender(header: str | None) -> str:
    m = _ADDRESS.search(header) if header else None
    return m[0].lower() if m else ""


#: What mail programs put before the subject of a reply or a forwarded message (fixed values).
_REPLY = re.compile(r"\s*(?:(?:re|fwd?|fw|aw|antw|wg|tr|rv|res|enc|ref|sv|vs|отв|на)\s*(?:\[\d+\]|\(\d+\))?\s*:\s*)+", re.IGNORECASE)


def _thread(subject: str | None) -> str:
    return _REPLY.sub("", subject or "", count=1).strip().lower() if _REPLY.match(subject or "") else (subject or "").strip().lower()


def _spread_hash(names: list[str], times: np.ndarray, salt: int) -> np.ndarray:
    return np.repeat(mixed(_hash(names) ^ np.uint64(salt)), times)


def _line_keys(lines: list[str], senders: list[str], times: np.ndarray) -> np.ndarray:
    """Keys of (sender, line); times: lines of each sender in turn."""
    return mixed(_hash([t.lower().translate(_TO_ZERO) for t in lines])) ^ _spread_hash(senders, times, 0x51ED270B) if lines else np.empty(0, np.uint64)


def _passage_keys(texts: list[str], threads: list[str], times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of (thread, passage) of the texts, and passages of each; times: texts of each thread in turn."""
    keys, chunks = chunk_keys(*hashed_words(texts))
    own = _spread_hash(threads, times, 0x2545F491)
    return keys ^ np.repeat(own, chunks), chunks


def count_table(emails: DataFrame) -> np.ndarray:
    """Levels of the counts of (sender, line) and (thread, passage) over the unquoted lines of all messages."""

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in slices(batches, 2):
            senders, subjects, bodies = (c.to_pylist() for c in batch.columns)
            kept = [[t for x in body.split("\n") if (t := x.strip()) and not QUOTE.match(x)] for body in bodies]
            yield _line_keys([t for lines in kept for t in lines], list(map(_sender, senders)), np.array(list(map(len, kept))))
            yield _passage_keys([" ".join(lines) for lines in kept], list(map(_thread, subjects)), np.ones(len(kept), np.int64))[0]

    some = emails.select("from_addr", "subject", "body").where(F.length("body") > 0)
    return tables.level_table(spread(some), keys_of, tables.bits_for(CELLS_A_MESSAGE * some.count()))


class Described:
    """The blocks of a batch of messages, and what is known of them but for the reading of their words."""

    def __init__(self, senders: list, subjects: list, bodies: list, table: np.ndarray):
        self.messages = [blocks_of(body) if body else [] for body in bodies]
        count = np.array([len(b) for b in self.messages], np.int64)
        self.message = np.repeat(np.arange(len(count)), count)
        blocks = [b for m in self.messages for b in m]
        words = [tokens(b) for b in blocks]
        self.n = np.array(list(map(len, words)), np.int64)
        flat = [t for w in words for t in w]
        codes, distinct = pd.factorize(np.array(flat, dtype=object)) if flat else (np.empty(0, np.int64), [])
        self.cells = (mixed(_hash(list(distinct))) >> np.uint64(64 - WORD_BITS)).astype(np.int64)[codes] if flat else np.empty(0, np.int64)
        self.shape = np.concatenate([shape(m) for m in self.messages if m]) if blocks else np.zeros((0, len(SHAPE)), np.float32)
        if not blocks:
            return
        bits = int(len(table)).bit_length() - 1
        plain = [[QUOTE.sub("", t).strip() for t in b.texts] if b.kind == "quoted" else b.texts for b in blocks]
        lines = np.array(list(map(len, plain)))
        of_message = np.bincount(self.message, lines, len(count)).astype(np.int64)
        found = np.maximum(tables.counts_of(table[tables.cells(_line_keys([t for p in plain for t in p], list(map(_sender, senders)), of_message), bits)]) - 1, 0)
        self.shape[:, 2] = np.add.reduceat(np.log1p(found), np.cumsum(lines) - lines) / lines
        keys, chunks = _passage_keys([" ".join(p) for p in plain], list(map(_thread, subjects)), count)
        quoted = np.array([b.kind == "quoted" for b in blocks])
        shared = np.concatenate(([0], np.cumsum(table[tables.cells(keys, bits)] > np.where(np.repeat(quoted, chunks), 0, tables.ONCE))))
        ends = np.cumsum(chunks)
        self.shape[:, 3] = (shared[ends] - shared[ends - chunks]) / np.maximum(chunks, 1)

    def features(self, wording: Wording) -> np.ndarray:
        return with_neighbours(self.shape, wording.read(self.cells, self.n), self.message)


def fitted(d: Described, seed: int = 0) -> tuple[Wording, Trees]:
    """Words and trees from the labelled blocks of a sample of messages."""
    labels = [label(m) for m in d.messages if m]
    y = np.concatenate(labels) if labels else np.empty(0, np.int8)
    last = np.concatenate([np.minimum.accumulate(x[::-1])[::-1] for x in labels]) if labels else np.empty(0, np.int8)
    both, half = np.stack([y, last]), d.message % 2 == seed
    read = np.zeros((len(y), len(_READ)), np.float32)
    for own in (half, ~half):
        part = Wording.train(d.cells[np.repeat(~own, d.n)], d.n[~own], both[:, ~own])
        read[own] = part.read(d.cells[np.repeat(own, d.n)], d.n[own])
    return Wording.train(d.cells, d.n, both), Trees.train(with_neighbours(d.shape, read, d.message), y, rounds=100, depth=5)


def train(emails: DataFrame, table: np.ndarray, messages: int = TRAIN_MESSAGES) -> tuple[Wording, Trees]:
    """Words and trees from at most `messages` messages, chosen by a hash of email_id."""
    some = emails.select("from_addr", "subject", "body", F.xxhash64("email_id").alias("h")).where(F.length("body") > 0)
    n = some.count()
    share = min(1.0, 1.2 * messages / max(n, 1))
    rows = some.where(F.pmod("h", F.lit(1_000_000)) < int(share * 1_000_000)).orderBy("h").limit(messages).collect()
    return fitted(Described([r["from_addr"] for r in rows], [r["subject"] for r in rows], [r["body"] for r in rows], table))


def _old_lines(emails: DataFrame, train_messages: int):
    """A function of a batch (id, from_addr, subject, body): per message the numbers of its lines that are not new."""
    table = count_table(emails)
    sent = emails.sparkSession.sparkContext.broadcast((table, *train(emails, table, train_messages)))

    def of(batch: pa.RecordBatch) -> list[list[int]]:
        counts, wording, trees = sent.value
        d = Described(*(batch.column(c).to_pylist() for c in (1, 2, 3)), counts)
        old = iter((trees.probability(d.features(wording)) >= 0.5).tolist())
        return [[no for b in blocks if next(old) for no in b.lines] for blocks in d.messages]

    return of


def not_own_lines(emails: DataFrame, train_messages: int = TRAIN_MESSAGES) -> DataFrame:
    """(email_id, line_no) of the lines of body, split at newlines and numbered from 1, that are not blank
    and that the sender did not newly write. NULL and empty bodies give none; repeated rows give
    repeated results; other columns are ignored; a NULL from_addr counts as one unknown sender."""
    old_lines = _old_lines(emails, train_messages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            numbers = old_lines(batch)
            ids = np.repeat(np.arange(len(numbers)), [len(x) for x in numbers])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array([n for x in numbers for n in x], pa.int32())], names=["email_id", "line_no"])

    return spread(emails.select("email_id", "from_addr", "subject", "body").where(F.length("body") > 0)).mapInArrow(run, "email_id bigint, line_no int")


def own_text(emails: DataFrame, train_messages: int = TRAIN_MESSAGES) -> DataFrame:
    """(email_id, own) of every message: its body without the lines of not_own_lines and without blank lines at its
    ends; '' where nothing remains or the body is NULL. Nothing is shuffled; repeated rows give repeated results."""
    old_lines = _old_lines(emails, train_messages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            own = []
            for body, drop in zip(batch.column(3).to_pylist(), map(set, old_lines(batch))):
                own.append("\n".join(x for no, x in enumerate((body or "").split("\n"), 1) if no not in drop).strip())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.string())], names=["email_id", "own"])

    return spread(emails.select("email_id", "from_addr", "subject", "body")).mapInArrow(run, "email_id bigint, own string")
