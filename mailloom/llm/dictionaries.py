"""Dictionaries for zstandard made of counts over a whole corpus, where zstandard's own training takes samples.

Content: words and runs of three words in the order of the bytes that they save, the most valuable ones last, where they
are nearest; runs that overlap are joined. Literals get the code lengths of the letters of all other words, sequences the
distributions that the format defines as usual ones (RFC 8878, sections 3.1.1.3.2.2 and 5).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a match, and bytes that a run of three words saves beside its words: one match in place of three.
MATCH_BYTES, RUN_SAVES = 3, 6
#: Literals from which the code lengths are taken, fewer than a block of zstandard holds.
LITERALS = 100_000
# Accuracy and distribution of offsets, match lengths and literal lengths, as the format defines them.
USUAL = [(5, [1] * 6 + [2] * 3 + [1] * 15 + [-1] * 5), (6, [1, 4, 3] + [2] * 6 + [1] * 37 + [-1] * 7), (6, [4, 3] + [2] * 11 + [1] * 3 + [2] * 9 + [3, 2] + [1] * 5 + [-1] * 4)]
MAGIC, REPEATED = 0xEC30A437, (1, 4, 8)


def count_pieces(line: str, counts: Counter) -> None:
    """Add the words of a line, and its runs of three words."""
    words = line.split()
    counts.update(words)
    counts.update(map(" ".join, zip(words, words[1:], words[2:])))


def score(piece: str, n: int) -> float:
    """Bytes that a piece of n occurrences saves, for each byte it takes; a word has a space on both sides."""
    return n * (RUN_SAVES if " " in piece else len(piece) + 2 - MATCH_BYTES) / (len(piece) + 1)


def score_column(piece: Column, n: Column) -> Column:
    return n * F.when(F.contains(piece, F.lit(" ")), F.lit(RUN_SAVES)).otherwise(F.length(piece) + (2 - MATCH_BYTES)) / (F.length(piece) + 1)


def looked_at(size: int) -> int:
    """Pieces, best first, that a dictionary of a size can depend on: one that is added takes two bytes or more, and one
    that is passed over is a word of the dictionary and takes as many there."""
    return size + 2


def dictionary(pieces: dict[str, int], letters: dict[str, int], encode: Callable[[str], bytes], size: int) -> bytes:
    """A dictionary with about `size` bytes of content. pieces: counts of words and runs, those of the looked_at(size) best
    ones at least, others change nothing; letters: counts of all characters. It is empty without pieces that save anything."""
    scored = sorted((-score(x, n), x) for x, n in pieces.items() if n > 1 and score(x, n) > 0)[: looked_at(size)]
    chains: list[list[str]] = []
    starts: dict[tuple[str, str], int] = {}
    ends: dict[tuple[str, str], int] = {}
    words: set[str] = set()
    total = 0
    for _, x in scored:
        if total >= size:
            break
        if " " not in x:
            if x in words:
                continue
            chains.append([x])
            words.add(x)
            total += len(encode(x)) + 1
            continue
        a, b, c = x.split(" ")
        if (a, b) in ends:
            at, new = ends.pop((a, b)), c
            chains[at].append(c)
            ends[b, c] = at
        elif (b, c) in starts:
            at, new = starts.pop((b, c)), a
            chains[at].insert(0, a)
            starts[a, b] = at
        else:
            new = x
            starts[a, b] = ends[b, c] = len(chains)
            chains.append([a, b, c])
        total += len(encode(new)) + 1
        words |= {a, b, c}
    content = (b" " + b"".join(encode(" ".join(x) + " ") for x in reversed(chains)))[-size:] if chains else b""
    rest = Counter({c: n for c, n in letters.items() if c != "\n"})
    for w in words & {x for _, x in scored}:
        for c in w + " ":
            rest[c] -= pieces[w]
    literals = np.zeros(256)
    for c, n in rest.items():
        for b in encode(c):
            literals[b] += max(n, 0)
    tables = _literal_lengths(literals)
    if not tables or len(content) < max(REPEATED):
        return content
    numbers = [(MAGIC, 4), (1, 4)], [(x, 4) for x in REPEATED]
    head, last = (b"".join(x.to_bytes(k, "little") for x, k in part) for part in numbers)
    return head + tables + b"".join(_distribution(*x) for x in USUAL) + last + content


def _distribution(accuracy: int, counts: list[int]) -> bytes:
    """A distribution without zeros as the format writes it."""
    out, at = accuracy - 5, 4
    left, edge, bits = (1 << accuracy) + 1, 1 << accuracy, accuracy + 1
    for c in counts:
        most = 2 * edge - 1 - left
        left -= abs(c)
        c += 1
        c += most if c >= edge else 0
        out |= c << at
        at += bits - (c < most)
        while left < edge:
            bits, edge = bits - 1, edge >> 1
    return out.to_bytes((at + 7) // 8, "little")


def _literal_lengths(counts: np.ndarray) -> bytes:
    """Huffman code lengths of all 256 bytes as the format writes them; taken from a frame that zstandard makes of bytes in
    these proportions, without order. Nothing where no code is shorter than 8 bits."""
    if not counts.any():
        return b""
    n = np.maximum(1, np.round(counts / counts.sum() * LITERALS)).astype(np.int64)
    mixed = np.random.default_rng(0).permutation(np.repeat(np.arange(256, dtype=np.uint8), n)).tobytes()
    how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_FAST, min_match=7, window_log=17, hash_log=6, write_content_size=False, write_checksum=False, write_dict_id=False)
    frame = zstandard.ZstdCompressor(compression_params=how).compress(mixed)
    # a frame without sizes has six bytes of header, a block three
    block = frame[9:]
    if frame[4] or frame[6] >> 1 & 3 != 2 or block[0] & 3 != 2:
        return b""
    tree = block[(3, 3, 4, 5)[block[0] >> 2 & 3] :]
    return tree[: 1 + (tree[0] if tree[0] < 128 else (tree[0] - 126) // 2)]
