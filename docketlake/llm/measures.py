"""Measures of whole texts that the quality operators share: counts of words and lines, hashed byte n-grams."""

from __future__ import annotations

import math

import numpy as np

from docketlake.llm.common import BLANKS

SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
#: Names of ``shape``'s values.
SHAPE = ("bias", "log_words", "word_length", "symbols", "upper", "digits", "marks", "bars", "next_same", "distinct", "repeated_lines", "repeat_words")


def count_of(text: bytes, these: bytes) -> int:
    """How many bytes of ``text`` are among ``these``."""
    return len(text) - len(text.translate(None, these))


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more in the text, the first included."""
    n = len(words)
    if n < 4:
        return 0
    number = dict(zip(words, range(n)))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    pairs = ids[:-1] * n + ids[1:]
    if n > 2_000_000:  # three numbers don't fit in 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * n + ids[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def base_measures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    return len(words), len(text.translate(None, BLANKS + CONTINUATION)), count_of(text, SYMBOLS), len(lines) - len(set(lines)), repeat_words(words)


def shape(text: bytes) -> tuple[float, ...]:
    """Format of a text as ``SHAPE`` names it; all zero but the bias for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return (1.0,) + (0.0,) * (len(SHAPE) - 1)
    size = max(1, len(text.translate(None, BLANKS)))
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    return (
        1.0,
        math.log(n) / 10,
        min(2.0, size / n / 10),
        count_of(text, SYMBOLS) / size,
        count_of(text, UPPER) / size,
        count_of(text, DIGITS) / size,
        text.count(b"!") / size,
        text.count(b"|") / size,
        same / n,
        len(set(words)) / n,
        1 - len(set(lines)) / len(lines),
        repeat_words(words) / n,
    )


def gram_buckets(data: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of each byte n-gram; one for each position but the last ``order - 1``."""
    held = np.zeros(max(0, len(data) - order + 1), np.uint32)
    for k in range(order):
        held *= np.uint32(0x01000193)
        held ^= data[k : len(data) - order + 1 + k]
    held *= np.uint32(0x9E3779B1)
    return held >> np.uint32(32 - bits)


def gram_groups(texts: list[bytes], order: int, bits: int, size: int = 2_000_000):
    """Groups of texts: (number of the first, start and number of n-grams of each, buckets of all, which are inside one).

    Texts are parted by ``order - 1`` line ends, so that a text of n bytes has n n-grams and shares none."""
    gap = b"\n" * (order - 1)
    first, group, held = 0, [], 0
    for i, t in enumerate(texts):
        group.append(t)
        held += len(t)
        if held >= size or i == len(texts) - 1:
            sizes = np.fromiter(map(len, group), np.int64, len(group))
            starts = np.r_[0, np.cumsum(sizes + order - 1)[:-1]]
            buckets = gram_buckets(np.frombuffer(gap.join([*group, b""]) + gap, np.uint8), order, bits)
            inside = np.ones(len(buckets), bool)
            outside = ((starts + sizes)[:, None] + np.arange(order - 1)).ravel()
            inside[outside[outside < len(buckets)]] = False
            yield first, starts, sizes, buckets, inside
            first, group, held = i + 1, [], 0


def mean_weights(texts: list[bytes], weights: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Mean weight of each text's n-grams; zero for an empty text."""
    out = np.zeros(len(texts))
    for first, starts, sizes, buckets, _ in gram_groups(texts, order, bits):
        sums = np.r_[0.0, np.cumsum(weights[buckets], dtype=np.float64)]
        out[first : first + len(sizes)] = (sums[starts + sizes] - sums[starts]) / np.maximum(1, sizes)
    return out
