"""Byte-pair encoding and decoding as streaming transducers with bounded lookahead.

Encoder. Merges are applied in order of rank. If two inputs agree up to some
place, their encodings agree up to that place less a constant: processing the
rules by rank, the last boundary on which both agree can only retreat over a
token ``a`` when a rule ``(a, b)`` fires on one side, and it can retreat again
only by a later rule whose right part begins with what was retreated over.
``lookahead`` is the longest such retreat, found by one pass over the merge list
(compare Berglund and van der Merwe, "Formalizing BPE Tokenization", 2023). The
transducer keeps the symbols not yet emitted, runs the merges on them and emits
each token that ends at least ``lookahead`` symbols before what has been read, so
its memory does not depend on the length of a word.

A pre-token's end settles all its tokens, since no rule joins across it. So the
transducer of a text (``Stream``) reads pieces, emits up to the last place that
ends a pre-token whatever follows, and keeps the rest. What it emits at once is
encoded in lockstep as arrays, one transducer for each pre-token; those read so
far without an end emit by the lookahead. Texts of up to a piece are one piece.

Decoder. Token ids go to the bytes they stand for, and a state machine turns
bytes into text as soon as a character is complete; it reads the ids of a piece
at a time and carries an unfinished character over.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Regex, normalizers, pre_tokenizers

from docketlake.llm.common import BLANKS, map_batches, table, texts

WORD_END = "</w>"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class MergeList:
    """A vocabulary file of the tokenizers library, read for the transducers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in whole.get("added_tokens", [])}
        self.tokens = {v: k for k, v in (self.vocab | self.special).items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.final = [self.vocab[c + WORD_END] for c in letters]
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        self.sizes = dict.fromkeys(self.inner + self.final, 1)
        self.lookahead = self._lookahead(merges)
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        # what the file says of letters, for texts that the byte rules of ``Texts`` don't cover
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
        self.cut = pre_tokenizers.Split(Regex(whole["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]), "removed", invert=True)
        self.decimals = [str(i).encode() for i in range(max(self.tokens) + 1)]
        self.names = [self.tokens.get(i, "").encode() for i in range(max(self.tokens) + 1)]
        self.inner_of, self.final_of = np.array(self.inner), np.array(self.final)
        self._slots()

    def _lookahead(self, merges: list[tuple[str, str]]) -> int:
        """Read the rules in order; return how far back a change of what follows can reach."""
        retreat: dict[int, int] = {}  # left part of a rule: longest retreat that ends with it
        begins: dict[int, tuple[int, ...]] = {}  # token: itself and the tokens that its left edge was built from
        for t in self.sizes:
            begins[t] = (t,)
        longest = 0
        for rank, (a, b) in enumerate(merges):
            left, right, both = self.vocab[a], self.vocab[b], self.vocab[a + b]
            if left not in self.sizes or right not in self.sizes or both in self.sizes:
                raise ValueError(f"rule {rank} uses a token that no earlier rule makes, or makes one twice")
            self.rules[left, right] = rank, both
            self.sizes[both] = self.sizes[left] + self.sizes[right]
            begins[both] = (both, *begins[left])
            reach = self.sizes[left] + max([0, *(retreat.get(t, 0) for t in begins[right])])
            retreat[left] = max(retreat.get(left, 0), reach)
            longest = max(longest, reach)
        return longest

    def _slots(self) -> None:
        """The rules as a table with open addressing, for whole arrays of pairs."""
        self.bits = max(8, len(self.rules).bit_length() + 2)
        keys = np.array([a << 32 | b for a, b in self.rules], np.uint64)
        ranks, made = (np.array([r[i] for r in self.rules.values()], np.int64) for i in (0, 1))
        self.made = np.empty(len(keys), np.int64)
        self.made[ranks] = made
        self.slot_key, self.slot_rank = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, len(keys), np.int64)
        rest, slot = np.arange(len(keys)), self._slot(keys)
        while len(rest):
            _, first = np.unique(slot, return_index=True)
            first = first[self.slot_key[slot[first]] == 0]
            self.slot_key[slot[first]], self.slot_rank[slot[first]] = keys[rest[first]], ranks[rest[first]]
            left = np.ones(len(rest), bool)
            left[first] = False
            rest, slot = rest[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys):
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks(self, left, right):
        """Rank of each pair's rule; the number of rules where there is none."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        held = self.slot_key[slot]
        out = self.slot_rank[slot]
        lost = np.flatnonzero((held != keys) & (held != 0))
        out[held == 0] = len(self.made)
        while len(lost):
            slot[lost] = (slot[lost] + 1) & ((1 << self.bits) - 1)
            held = self.slot_key[slot[lost]]
            out[lost] = np.where(held == keys[lost], self.slot_rank[slot[lost]], len(self.made))
            lost = lost[(held != keys[lost]) & (held != 0)]
        return out

    def merge_flat(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many whole pre-tokens that lie end to end, none empty, and how many each has. In each round every
        pre-token applies its best rule everywhere, from the left; no rule joins a last symbol with what follows."""
        none, n = len(self.made), len(sizes)
        ends = np.cumsum(sizes) - 1
        s, w = self.inner_of[data], np.repeat(np.arange(n), sizes)
        s[ends] = self.final_of[data[ends]]
        done_s, done_w = [], []
        rank = np.full(len(s), none, np.int64)
        rank[:-1] = self._ranks(s[:-1], s[1:])
        while len(s):
            starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            best = np.minimum.reduceat(rank, starts)
            each = np.repeat(best, np.diff(np.r_[starts, len(s)]))
            over = each == none
            if over.any():
                done_s.append(s[over])
                done_w.append(w[over])
                live = ~over
                s, w, rank, each = s[live], w[live], rank[live], each[live]
                if not len(s):
                    break
            at = np.flatnonzero(rank == each)
            begins = np.r_[True, at[1:] != at[:-1] + 1]  # of runs that overlap, every other pair merges
            at = at[(at - at[begins][np.cumsum(begins) - 1]) % 2 == 0]
            s[at] = self.made[rank[at]]
            left = np.ones(len(s), bool)
            left[at + 1] = False
            s, w, rank = s[left], w[left], rank[left]
            at -= np.arange(len(at))  # where the merged symbols are now
            at = np.unique(np.r_[at, at[at > 0] - 1])
            inside = at[at < len(s) - 1]
            rank[at[at == len(s) - 1]] = none
            rank[inside] = self._ranks(s[inside], s[inside + 1])
        s, w = np.concatenate(done_s), np.concatenate(done_w)
        return s[np.argsort(w, kind="stable")].astype(np.uint32), np.bincount(w, minlength=n)

    def merge(self, symbols: list[int]) -> list[int]:
        """The encoding of a whole pre-token."""
        if len(symbols) > 40:
            return self._merge_long(symbols)
        rules = self.rules
        while len(symbols) > 1:
            best = None
            for pair in zip(symbols, symbols[1:]):
                rule = rules.get(pair)
                if rule is not None and (best is None or rule < best):
                    best, pair_of_best = rule, pair
            if best is None:
                break
            (left, right), made = pair_of_best, best[1]
            out, i, n = [], 0, len(symbols)
            while i < n:
                if symbols[i] == left and i + 1 < n and symbols[i + 1] == right:
                    out.append(made)
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same with a heap, for long pre-tokens."""
        rules, symbols = self.rules, list(symbols)
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap = [(*rule, i) for i, pair in enumerate(zip(symbols, symbols[1:])) if (rule := rules.get(pair))]
        heap = [(rank, i, made) for rank, made, i in heap]
        heapq.heapify(heap)
        n = len(symbols)
        while heap:
            rank, i, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j >= n or rules.get((symbols[i], symbols[j])) != (rank, made):
                continue
            symbols[i], symbols[j] = made, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if rule := rules.get((made, symbols[k])):
                    heapq.heappush(heap, (rule[0], i, rule[1]))
            if (h := before[i]) >= 0 and (rule := rules.get((symbols[h], made))):
                heapq.heappush(heap, (rule[0], h, rule[1]))
        return [x for x in symbols if x is not None]


class Encoder:
    """Streaming encoder: feed() takes bytes of one pre-token, close() ends it."""

    def __init__(self, merges: MergeList):
        self.merges, self.kept = merges, []
        self.step = max(256, 2 * merges.lookahead)

    def feed(self, piece: bytes) -> Iterator[int]:
        """Tokens that are stable once ``piece`` has been read. The last byte is held back: it may be the final one."""
        m = self.merges
        for at in range(0, len(piece), self.step):
            self.kept += piece[at : at + self.step]
            if len(self.kept) > m.lookahead + self.step:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        m, kept = self.merges, self.kept
        ready, end, limit = [], 0, len(kept) - 1 - m.lookahead
        for token in m.merge([m.inner[b] for b in kept[:-1]]):
            if end + m.sizes[token] > limit:
                break
            end += m.sizes[token]
            ready.append(token)
        self.kept = kept[end:]
        yield from ready

    def close(self) -> list[int]:
        m, kept, self.kept = self.merges, self.kept, []
        return m.merge([m.inner[b] for b in kept[:-1]] + [m.final[kept[-1]]]) if kept else []


class Decoder:
    """Incremental decoder: bytes in, text out as soon as a character is whole."""

    def __init__(self, merges: MergeList, byte_level: bool = False):
        """byte_level: give the bytes that the letters stand for, and a space for each word's end. Otherwise the
        tokens' own names joined by a space, as a vocabulary file without a decoder says."""
        self.merges, self.byte_level = merges, byte_level
        self.state, self.first = codecs.getincrementaldecoder("utf-8")("replace"), True
        self.byte = {c: b for b, c in enumerate(byte_letters())}

    def feed_all(self, tokens: list[int]) -> str:
        """As feed() for each: one step of the state machine over the bytes of all."""
        if self.byte_level or not tokens:
            return "".join(map(self.feed, tokens))
        data = b" " * (not self.first) + b" ".join(map(self.merges.names.__getitem__, tokens))
        self.first = False
        return self.state.decode(data)

    def feed(self, token: int) -> str:
        name = self.merges.tokens[token]
        if not self.byte_level:
            out = self.state.decode((b"" if self.first else b" ") + name.encode())
            self.first = False
            return out
        if token in self.merges.special.values():
            return self.state.decode(name.encode())
        ends = name.endswith(WORD_END)
        return self.state.decode(bytes(self.byte[c] for c in name.removesuffix(WORD_END)) + b" " * ends)

    def close(self) -> str:
        return self.state.decode(b"", True)


class Texts:
    """Encodes stretches of text, many at a time, with one transducer for each pre-token in lockstep.

    Bytes are classed and lowered as arrays. A pre-token of up to ``LONGEST`` bytes is looked up among those met last
    by a 64-bit tabulation hash, and its bytes are compared; new ones run through ``MergeList.merge_flat``, which ends
    them all; longer ones through ``Encoder``, which emits by the lookahead before they end. Texts with letters that
    these rules don't cover (``odd``) are cut by the pattern itself. At most ``LIMIT`` pre-tokens are kept; a group
    holds less than two pieces of text, which have fewer distinct ones."""

    LIMIT, LONGEST, BITS, PIECE = 500_000, 48, 20, 1_000_000

    def __init__(self, merges: MergeList):
        self.merges = merges
        rng = np.random.default_rng(42)
        self.table = rng.integers(1, 1 << 63, 256 * self.LONGEST, np.uint64, endpoint=True)
        kind = np.full(256, 3, np.uint8)  # 0 white space, 1 letter, 2 digit, 3 the rest
        kind[list(BLANKS)] = 0
        kind[list(range(97, 123))] = 1
        kind[list(range(48, 58))] = 2
        self.kind = kind
        self.rare = np.zeros(256, bool)
        self.rare[[*range(0x1C, 0x20), 0xC2, *range(0xC4, 0x100), ord("<")]] = True
        after_c2 = np.ones(256, bool)
        after_c2[[x for x in range(0xA1, 0xC0) if x not in {0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE}]] = False
        self.after_c2 = after_c2
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(1 << self.BITS, np.uint64)
        self.entry = np.zeros(1 << self.BITS, np.int32)
        self.n, self.held = 0, 0
        self.at, self.size = np.zeros(self.LIMIT + 1, np.int64), np.zeros(self.LIMIT + 1, np.int32)
        self.ids = np.zeros(6 * self.LIMIT, np.uint32)
        self.from_, self.length, self.bytes, self.n_bytes = np.zeros(self.LIMIT + 1, np.int64), np.zeros(self.LIMIT + 1, np.int32), np.zeros(8 * self.LIMIT, np.uint8), 0

    def stream(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """The ids of each text, in order, as uint32: (number of the text, ids), at least one part of each text. A text
        of more than a piece comes in parts of about a piece."""
        group, first, held = [], 0, 0
        for i, t in enumerate(texts):
            long = len(t) > self.PIECE
            if not long:
                group.append(t)
                held += len(t)
            if group and (long or held >= self.PIECE):
                yield from enumerate(self._group(group), first)
                group, held = [], 0
            if long:
                s = Stream(self)
                for at in range(0, len(t), self.PIECE):
                    yield i, s.feed(t[at : at + self.PIECE])
                yield i, s.close()
            if not group:
                first = i + 1
        if group:
            yield from enumerate(self._group(group), first)

    def of(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text, in order, as uint32."""
        for _, parts in groupby(self.stream(texts), lambda x: x[0]):
            parts = [x for _, x in parts]
            yield parts[0] if len(parts) == 1 else np.concatenate(parts)

    def _group(self, group: list[bytes]) -> list[np.ndarray]:
        sizes = np.fromiter(map(len, group), np.int64, len(group))
        begins = np.r_[0, np.cumsum(sizes + 1)[:-1]]
        data = np.frombuffer(b" ".join(group).lower() + b"    ", np.uint8)
        odd = self._odd(data, begins)
        if len(odd):
            left = [b"" if i in odd else t for i, t in enumerate(group)]
            out = self._group(left)
            for i in odd:
                out[i] = np.array(self._by_pattern(group[i].decode("utf-8", "replace")), np.uint32)
            return out
        starts, data, kept = self._cut(data)
        ids, bounds = self._encode(data, kept[starts])
        first = np.searchsorted(starts, begins)  # of each text, among the pre-tokens
        cut = bounds[first]
        return [ids[a:b] for a, b in zip(cut, [*cut[1:], bounds[-1]])]

    def _odd(self, data: np.ndarray, begins: np.ndarray) -> set[int]:
        """Numbers of the texts that need the pattern."""
        at = np.flatnonzero(self.rare[data])
        if not len(at):
            return set()
        x, y, z = data[at], data[np.minimum(at + 1, len(data) - 1)], data[np.minimum(at + 2, len(data) - 1)]
        fine = ((x == 0xC2) & ~self.after_c2[y]) | ((x == 0xE2) & (y == 0x80) & (z >= 0x90) & (z <= 0xA7)) | ((x == ord("<")) & (y != ord("|")))
        return set((np.searchsorted(begins, at[~fine], "right") - 1).tolist())

    def _cut(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where pre-tokens start; the bytes without white space; how many of these come before each byte."""
        kind = self.kind[data]
        at = np.flatnonzero(data == 0xC3)  # Latin-1 letters
        if len(at):
            data = data.copy()
            second = data[at + 1]
            letter = (second != 0x97) & (second != 0xB7)
            capital = letter & (second <= 0x9E)
            data[at[capital] + 1] += 0x20
            kind[at[letter]] = kind[at[letter] + 1] = 1
        start = np.empty(len(data), bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= kind == 2
        at = np.flatnonzero((data == ord("'")) & start)
        at = at[at + 3 < len(data)]
        if len(at):
            x, y = data[at + 1], data[at + 2]
            one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
            two = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
            start[at[one] + 1] = start[at[two] + 1] = False
            start[at[one] + 2], start[at[two] + 3] = True, True
        word = kind != 0
        start &= word
        kept = np.cumsum(word) - word
        return np.flatnonzero(start), data[word], kept

    def _encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens that lie end to end; where each one's ids begin."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        sizes = np.diff(np.r_[starts, len(data)])
        place = np.arange(len(data)) - np.repeat(starts, sizes)
        np.minimum(place, self.LONGEST - 1, out=place)
        keys = np.add.reduceat(self.table[data.astype(np.int64) * self.LONGEST + place], starts)
        keys[keys == 0] = 1
        long = np.flatnonzero(sizes > self.LONGEST)
        entry = self._find(keys)
        entry[long] = 0
        new = np.flatnonzero(entry < 0)
        if len(new):
            _, first = np.unique(keys[new], return_index=True)
            first = new[first]
            if self.n + len(first) >= self.LIMIT:
                self._reset()
                _, first = np.unique(keys, return_index=True)
                first = first[sizes[first] <= self.LONGEST]
            self._add(keys[first], data, starts[first], sizes[first])
            entry = self._find(keys)
            entry[long] = 0
        # pre-tokens whose bytes differ from those that their hash stands for are encoded on their own, as long ones
        wrong = self.length[entry] != sizes
        wrong[long] = False
        entry[wrong] = 0
        compared = self.length[entry].astype(np.int64)
        ends = np.cumsum(compared)
        index = np.arange(ends[-1])
        same = self.bytes[np.repeat(self.from_[entry] - ends + compared, compared) + index] == data[np.repeat(starts - ends + compared, compared) + index]
        if not same.all():
            wrong[np.searchsorted(ends, np.flatnonzero(~same), "right")] = True
            entry[wrong] = 0
        if wrong.any():
            long = np.sort(np.r_[long, np.flatnonzero(wrong)])
        counts, at = self.size[entry].astype(np.int64), self.at[entry]
        source = self.ids
        if len(long):
            made = []
            for i in long:
                e = Encoder(self.merges)
                made.append(np.array([*e.feed(data[starts[i] : starts[i] + sizes[i]].tobytes()), *e.close()], np.uint32))
            counts[long] = [len(x) for x in made]
            at[long] = self.held + np.r_[0, np.cumsum(counts[long])[:-1]]
            source = np.concatenate([self.ids[: self.held], *made])
        bounds = np.r_[0, np.cumsum(counts)]
        return source[np.repeat(at - bounds[:-1], counts) + np.arange(bounds[-1])], bounds

    def _find(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        held = self.keys[slot]
        out = self.entry[slot]
        out[held == 0] = -1
        lost = np.flatnonzero((held != keys) & (held != 0))
        while len(lost):
            slot[lost] = (slot[lost] + 1) & ((1 << self.BITS) - 1)
            held = self.keys[slot[lost]]
            out[lost] = np.where(held == keys[lost], self.entry[slot[lost]], -1)
            lost = lost[(held != keys[lost]) & (held != 0)]
        return out

    def _add(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        whole, bounds = np.r_[0, np.cumsum(sizes)], data
        parts = bounds[np.repeat(starts - whole[:-1], sizes) + np.arange(whole[-1])]
        ids, counts = self.merges.merge_flat(parts, sizes)
        while self.held + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros(len(self.ids), np.uint32)]
        self.ids[self.held : self.held + len(ids)] = ids
        numbers = self.n + 1 + np.arange(len(keys))
        self.size[numbers] = counts
        self.at[numbers] = self.held + np.r_[0, np.cumsum(counts)[:-1]]
        self.held += len(ids)
        while self.n_bytes + len(parts) > len(self.bytes):
            self.bytes = np.r_[self.bytes, np.zeros(len(self.bytes), np.uint8)]
        self.bytes[self.n_bytes : self.n_bytes + len(parts)] = parts
        self.from_[numbers], self.length[numbers] = self.n_bytes + whole[:-1], sizes
        self.n_bytes += len(parts)
        self.n += len(keys)
        slot = (keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        while len(keys):
            _, first = np.unique(slot, return_index=True)
            first = first[self.keys[slot[first]] == 0]
            self.keys[slot[first]], self.entry[slot[first]] = keys[first], numbers[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, numbers, slot = keys[left], numbers[left], (slot[left] + 1) & ((1 << self.BITS) - 1)

    def _by_pattern(self, text: str) -> list[int]:
        m, out, at = self.merges, [], 0

        def plain(x: str) -> None:
            parts = [p.encode() for p, _ in m.cut.pre_tokenize_str(m.normal.normalize_str(x))]
            if parts:
                sizes = np.fromiter(map(len, parts), np.int64, len(parts))
                ids, _ = self._encode(np.frombuffer(b"".join(parts), np.uint8), np.r_[0, np.cumsum(sizes)[:-1]])
                out.extend(ids.tolist())

        for hit in m.split_special.finditer(text) if m.split_special else ():
            plain(text[at : hit.start()])
            out.append(m.special[hit[0]])
            at = hit.end()
        plain(text[at:])
        return out


class Stream:
    """The transducer of a text: feed() takes bytes in pieces and gives the ids that are stable, close() the rest.

    What is kept ends no pre-token for sure: it is shorter than a piece, but where a text has no white space, digit or
    change between ASCII letters and marks for longer. Such a run of ASCII letters goes through ``Encoder``."""

    #: After white space; before a digit; between an ASCII letter and a mark that no contraction or special token has.
    SAFE = re.compile(rb"(?<=[\x20\t\n\r\x0b\x0c])|(?=[0-9])|(?<=[A-Za-z])(?=[#$%&()*+,./:;=?@\[\]^_{}~-])|(?<=[#$%&()*+,./:;=?@\[\]^_{}~-])(?=[A-Za-z])")
    ENDS = re.compile(SAFE.pattern + rb"|(?=<)")
    KEPT = 16

    def __init__(self, texts: Texts):
        self.texts, self.kept, self.run, self.searched = texts, b"", None, 0
        self.digits = any(c.isdigit() for x in texts.merges.special for c in x)

    def _stable(self) -> int:
        """Where the last pre-token ends that what follows can't change; 0 if none does. Read from the end, in steps."""
        kept, step = self.kept, 4096
        for end in range(len(kept) - 1, self.searched, -step):
            begin = max(0, end - step)
            found = [m.start() for m in self.SAFE.finditer(kept, begin, end + 1) if begin < m.start() <= end and not (self.digits and kept[m.start() : m.start() + 1].isdigit())]
            if found:
                return found[-1]
        self.searched = max(0, len(kept) - 1)
        return 0

    def _emit(self, stretch: bytes) -> np.ndarray:
        """Ids of a stretch that ends a pre-token; its beginning goes on with the open run, if there is one."""
        if self.run is None:
            return self.texts._group([stretch])[0]
        m, run, self.run = self.texts.merges, self.run, None
        end = self.ENDS.search(stretch, 1)
        head = stretch[: end.start()] if end else stretch
        parts = [p.encode() for p, _ in m.cut.pre_tokenize_str(m.normal.normalize_str(head.decode("utf-8", "replace")))]
        out = [*run.feed(parts[0]), *run.close()]
        if len(parts) > 1:
            sizes = np.fromiter(map(len, parts[1:]), np.int64, len(parts) - 1)
            out += self.texts._encode(np.frombuffer(b"".join(parts[1:]), np.uint8), np.r_[0, np.cumsum(sizes)[:-1]])[0].tolist()
        return np.concatenate([np.array(out, np.uint32), self.texts._group([stretch[len(head) :]])[0]])

    def feed(self, piece: bytes) -> np.ndarray:
        self.kept += piece
        cut = self._stable()
        out = []
        if cut:
            out.append(self._emit(self.kept[:cut]))
            self.kept, self.searched = self.kept[cut:], 0
        if len(self.kept) >= Texts.PIECE // 2 and self.kept.isascii() and self.kept.isalpha():
            self.run = self.run or Encoder(self.texts.merges)
            out.append(np.fromiter(self.run.feed(self.kept[: -self.KEPT].lower()), np.uint32))
            self.kept, self.searched = self.kept[-self.KEPT :], 0
        return np.concatenate([np.zeros(0, np.uint32), *out])

    def close(self) -> np.ndarray:
        kept, self.kept = self.kept, b""
        return self._emit(kept) if kept else np.zeros(0, np.uint32)


_MERGES: dict[str, MergeList] = {}
_TEXTS: dict[str, Texts] = {}


def vocabulary(path: str | None = None) -> str:
    """Place of a vocabulary file: a path, or the public file's name."""
    import public_tokenizers

    return path if path and "/" in path else public_tokenizers.path(path or "word_bpe_49k.json")


def merges(path: str | None = None) -> MergeList:
    place = vocabulary(path)
    if place not in _MERGES:
        _MERGES[place] = MergeList(place)
    return _MERGES[place]


def encoder(path: str | None = None) -> Texts:
    """The worker's encoder for a vocabulary."""
    place = vocabulary(path)
    if place not in _TEXTS:
        _TEXTS[place] = Texts(merges(place))
    return _TEXTS[place]


def encode(text: str | bytes | None, path: str | None = None) -> list[int]:
    """Ids of a whole text; null and empty texts have none."""
    data = text.encode() if isinstance(text, str) else text or b""
    return next(encoder(path).of([data])).tolist()


def decode(ids: Iterable[int], path: str | None = None, byte_level: bool = False) -> str:
    """Text of ids, one state machine for the whole sequence."""
    decoder = Decoder(merges(path), byte_level)
    return decoder.feed_all(list(ids)) + decoder.close()


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids. Extra columns stay; a column named as ``ids`` is replaced.

    Null and empty texts have an empty list; equal rows give equal rows; an empty table stays empty."""
    kept = docs.drop(ids)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{ids}` array<int>"])

    def run(batches):
        for b in batches:
            found = list(encoder(path).of(texts(b, text)))
            bounds = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint32), *found]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], names=[*b.schema.names, ids])

    return map_batches(kept, run, schema)


def decode_documents(docs: DataFrame, path: str | None = None, ids: str = "ids", to: str = "decoded", byte_level: bool = True) -> DataFrame:
    """``docs`` with the text of a column of ids (null: no ids, empty text)."""
    kept = docs.drop(to)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{to}` string"])

    def run(batches):
        for b in batches:
            out = [decode(x or [], path, byte_level) for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, to])

    return map_batches(kept, run, schema)


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the decoded text.

    Null and empty texts: no ids, digests of the empty text. Narrow: no shuffle; only digests leave the map."""

    def run(batches):
        m = merges(path)
        for b in batches:
            counts, ids_hash, text_hash = [], [], []
            for _, parts in groupby(encoder(path).stream(texts(b)), lambda x: x[0]):
                n, ids_sha, text_sha, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(m)
                for _, part in parts:
                    ids = part.tolist()
                    if n and ids:
                        ids_sha.update(b" ")
                    n += len(ids)
                    ids_sha.update(b" ".join(map(m.decimals.__getitem__, ids)))
                    text_sha.update(decoder.feed_all(ids).encode())
                text_sha.update(decoder.close().encode())
                counts.append(n)
                ids_hash.append(ids_sha.hexdigest())
                text_hash.append(text_sha.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"))
