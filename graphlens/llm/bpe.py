"""Byte-pair encoding by per-prefix dynamic programming, and decoding.

For each prefix of a pre-token there is exactly one token that its encoding can end with:
the token t, of those that are suffixes of the prefix, whose rest is a shorter prefix
ending with a token that is compatible with t (byte-pair encoding of the two tokens'
characters gives these two tokens). A trie of the vocabulary lists all tokens
that end at each position; the last token of every prefix is stored, and following the
back-pointers from the end emits the ids. This is done for all new pieces of a batch together, by
columns: their prefixes of one byte, then those of two, and so on. Pieces of more than some bytes, and
few pieces, are taken one by one, with an automaton over the vocabulary.

Texts are cut where the tokenizer's own pre-tokenizer cuts them, and around its special
tokens, which become their ids. A worker remembers the encodings of pieces it
has met, a bounded number of them. Null counts as the empty text, which has no ids. Each row is
handled by itself, so copies, ties and repeated or null ids make no difference. Texts are taken some
megabytes at a time; a longer one is taken whole, whose task needs some 20 times its bytes. Other columns
are not read, so their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

TOKENIZER = "byte_bpe_50k.json"
#: Words that a worker remembers.
REMEMBERED = 500_000
#: Bytes of text whose parts are looked at together.
TOGETHER = 16 << 20
#: Bytes of a piece up to which it is encoded together with others, of pieces that are encoded together, and number of pieces from which that pays.
MOST, AT_ONCE, FEW = 64, 1 << 17, 500
#: The power of two of the seams between tokens that a worker remembers.
SEAMS = 19
_NEVER = 1 << 60
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Recent(dict):
    """A mapping that remembers what was used lately: two generations, the older one dropped when the newer is full."""

    def __init__(self, make, most: int = REMEMBERED):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Lookup:
    """Whole numbers by keys, both from 0, for many keys at a time: a table in which a key that finds its place taken goes to the next one."""

    def __init__(self, of: dict[int, int]):
        self.bits = len(of).bit_length() + 2
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        keys, values = np.fromiter(of.keys(), np.int64, len(of)), np.fromiter(of.values(), np.int32, len(of))
        at = self.place(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            put = self.keys[at] == keys
            self.values[at[put]] = values[put]
            keys, values, at = keys[~put], values[~put], self.next(at[~put])

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _SPREAD >> np.uint64(64 - self.bits)).view(np.int64)

    def next(self, at: np.ndarray) -> np.ndarray:
        return at + 1 & (1 << self.bits) - 1

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; -1 where there is none."""
        at = self.place(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], np.int32(-1))
        todo = np.flatnonzero((held != keys) & (held >= 0))
        at = at[todo]
        while len(todo):
            at = self.next(at)
            held, want = self.keys[at], keys[todo]
            out[todo] = np.where(held == want, self.values[at], np.int32(-1))
            more = (held != want) & (held >= 0)
            todo, at = todo[more], at[more]
        return out


class Parts:
    """Encodes a batch of texts between their single spaces: each different part once.

    A space before a character that is not white space always starts a pre-token, so a text
    without white space after a space is its first part and parts with a space before
    them. A part of letters and final punctuation is two pre-tokens, so only its word is
    encoded, and words met lately are remembered. Texts of other forms are encoded whole.
    All but the encoding of new words is done by columns: pieces (words, marks, first parts, whole texts)
    stand in one array of ids, and the ids of the texts are gathered from it.
    """

    #: Marks that may follow a word; all are neither letters, digits nor white space.
    MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    #: Words longer than this are not remembered.
    LONGEST = 64

    def __init__(self, whole, many, tail, special: list[str], together: int = TOGETHER, remembered: int = REMEMBERED):
        """whole(text); many(parts) of parts that follow a space; tail(marks) of marks after a word."""
        self.together, self.remembered = together, remembered
        self.whole, self.many = whole, many
        self.tail, self.first = Recent(tail, 20_000), Recent(whole, 20_000)
        self.odd = "|".join([r" [ \t\n\r\v\f]", " $", *map(re.escape, special)])
        self.words = pa.array([], pa.large_string())
        self.ids, self.counts = np.empty(0, "<u4"), np.empty(0, np.int64)

    def plain(self, words: pa.Array) -> pa.Array:
        return pc.and_(pc.utf8_is_alpha(words), pc.match_substring_regex(words, "^[\\x00-\\x{24F}]+$"))

    def cut(self, parts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """What is encoded of each part, its word or all of it, and the marks that follow."""
        words = pc.utf8_rtrim(parts, self.MARKS)
        words = pc.if_else(self.plain(words), words, parts)
        more = pc.less(pc.binary_length(words), pc.binary_length(parts))
        marks = pc.replace_substring_regex(parts.filter(more), r"^[^!-/:-@\[-`{-~]+", "")
        return words, pc.replace_with_mask(pa.array([""], pa.large_string()).take(pa.array(np.zeros(len(parts), np.int64))), more, marks)

    def made(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are not remembered, one after the other, and how many of each."""
        return joined(self.many(words.to_pylist()))

    def heads(self, texts: list[str], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of first parts and, where ``odd``, whole texts, one after the other, and how many of each."""
        return joined([self.whole(t) if whole else self.first[t] for t, whole in zip(texts, odd.tolist(), strict=True)])

    def resolve(self, words: pa.Array, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words one after the other, and how many of each; what is new is remembered."""
        at = pc.index_in(words, self.words).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(np.isnan(at)) if at.dtype.kind == "f" else np.empty(0, np.int64)
        known = np.flatnonzero(~np.isnan(at)) if len(new) else np.arange(len(words))
        counts = np.empty(len(words), np.int64)
        made, counts[new] = self.made(words.take(pa.array(new)))
        old = at[known].astype(np.int64)
        counts[known] = self.counts[old]
        starts = np.empty(len(words), np.int64)
        held = np.concatenate([self.ids, made])
        starts[known] = (np.cumsum(self.counts) - self.counts)[old]
        starts[new] = len(self.ids) + np.cumsum(counts[new]) - counts[new]
        ids = gather(held, starts, counts)
        keep = new[(pc.binary_length(words.take(pa.array(new))).to_numpy(zero_copy_only=False) <= self.LONGEST)]
        if len(self.words) + len(keep) > self.remembered:  # what this batch has not met twice is forgotten
            keep = np.concatenate([keep, known])
            keep = np.sort(keep[times[keep] > 1])[: self.remembered]
            self.words, self.ids, self.counts = words.take(pa.array(keep)), gather(held, starts[keep], counts[keep]), counts[keep]
        elif len(keep):
            self.words = pa.concat_arrays([self.words, words.take(pa.array(keep))])
            self.ids, self.counts = np.concatenate([self.ids, gather(held, starts[keep], counts[keep])]), np.concatenate([self.counts, counts[keep]])
        return ids, counts

    def chunks(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, end, ids, counts) of runs of texts with a bounded number of bytes (or one text): their ids one after the other, and how many each has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // self.together
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield a, b, *self.encode_some(texts.slice(a, b - a))
                pa.default_memory_pool().release_unused()

    def encode_some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts, " ")
        coded = split.values.dictionary_encode()
        codes, ends, parts = coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64), coded.dictionary
        del coded, split
        blank = pc.or_(pc.equal(pc.binary_length(parts), 0), pc.utf8_is_space(pc.utf8_slice_codeunits(parts, 0, 1))).to_numpy(zero_copy_only=False)
        starts, stops = ends[:-1], ends[1:]
        lost = blank[codes]
        lost[starts[starts < stops]] = False  # a first part may be anything
        lost = np.concatenate([[0], np.cumsum(lost)])
        odd = odd | (lost[stops] > lost[starts]) | (starts == stops)
        # pieces: the words, the marks after them, the first parts, whole texts
        parts = pc.if_else(pa.array(blank), "", parts)
        times = np.bincount(codes, minlength=len(parts))
        words, marks = (x.dictionary_encode() for x in self.cut(parts))
        of, marked = words.indices.to_numpy(), marks.indices.to_numpy()
        some = words.dictionary
        empty = pc.equal(pc.binary_length(some), 0).to_numpy(zero_copy_only=False)
        order = np.cumsum(~empty) - 1
        ids, counts = self.resolve(some.filter(pa.array(~empty)), np.bincount(of, times, len(some))[~empty].astype(np.int64))
        rest = [self.tail[m] for m in marks.dictionary.to_pylist()]
        head_ids, head_counts = self.heads([texts[k].as_py() if whole else texts[k].as_py().partition(" ")[0] for k, whole in enumerate(odd.tolist())], odd)
        held = np.concatenate([ids, np.frombuffer(b"".join(rest), "<u4")])
        counts = np.concatenate([counts, [0], [len(x) // 4 for x in rest]]).astype(np.int64)  # the piece after the words is empty
        begin = np.cumsum(counts) - counts
        void = int((~empty).sum())
        pair = np.stack([np.where(empty[of], void, order[of]), void + 1 + marked], 1)
        part_ids, part_counts = gather(held, begin[pair].ravel(), counts[pair].ravel()), counts[pair].sum(1)
        # the texts: a first part or a whole text, then the other parts of those that are not odd
        held, counts = np.concatenate([part_ids, head_ids]), np.concatenate([part_counts, head_counts])
        begin = np.cumsum(counts) - counts
        inner = np.repeat(~odd, stops - starts)
        inner[starts[starts < stops]] = False
        many = np.where(odd, 0, stops - starts - 1)
        first = np.cumsum(many + 1) - many - 1
        piece = np.empty(int((many + 1).sum()), np.int64)
        at_first = np.zeros(len(piece), bool)
        at_first[first] = True
        piece[at_first], piece[~at_first] = len(part_counts) + np.arange(len(texts)), codes[inner]
        sizes = counts[piece]
        return gather(held, begin[piece], sizes), np.add.reduceat(sizes, first) if len(first) else sizes


def joined(made: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids one after the other, and how many of each."""
    return np.frombuffer(b"".join(made), "<u4"), np.array([len(x) // 4 for x in made], np.int64)


def gather(held: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of ``held`` that begin at ``starts`` and have ``counts`` values, one after the other."""
    shift = starts - (np.cumsum(counts) - counts)
    at = np.repeat(shift, counts)
    at += np.arange(len(at))
    return held[at]


def in_order(made: list[tuple[np.ndarray, np.ndarray]], last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of all pieces in their order, of those made first (not ``last``) and then of the others."""
    ids, counts = (np.concatenate([m[k] for m in made]) for k in (0, 1))
    if last.all() or not last.any():
        return ids, counts
    begin, back = np.cumsum(counts) - counts, np.argsort(np.argsort(last, kind="stable"))
    return gather(ids, begin[back], counts[back]), counts[back]


def binary_column(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A column of binary values of the ids of each text."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * ids.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())


def byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself if printable Latin-1, else the next from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class NewParts(Parts):
    """Parts whose new words, first parts and whole texts are encoded together: ``many`` and ``whole`` take all and return ids and counts."""

    def made(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.many(words)

    def heads(self, texts: list[str], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.whole(texts)


class Encoder:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        size = 1 + max([*self.vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # when a token is made (-1: a single byte), from which two, and what a pair makes when
        self.born, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.pair: dict[tuple[int, int], int] = {}
        for when, (a, b) in enumerate(merges):
            x, y, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.pair[x, y] = when
            if self.born[made] < 0:
                self.born[made], self.left[made], self.right[made] = when, x, y
        byte_of = {c: b for b, c in byte_characters().items()}
        # the trie: the node that a node and a byte lead to (the root is 0), and the token that ends at a node
        step: dict[int, int] = {}
        ends: dict[int, int] = {}
        for token, k in self.tokens():
            if all(c in byte_of for c in token):
                node = 0
                for c in token:
                    node = step.setdefault(node << 8 | byte_of[c], len(step) + 1)
                ends[node] = k
        self.step, self.seam = Lookup(step), Lookup({x << 32 | y: when for (x, y), when in self.pair.items()})
        self.ends = np.full(len(step) + 1, -1, np.int64)
        self.ends[list(ends)] = list(ends.values())
        self.made_of = np.array([self.born, self.left, self.right], np.int64)
        self.met, self.met_apart = np.full(1 << SEAMS, -1, np.int64), np.zeros(1 << SEAMS, bool)
        self.special = sorted(((t["content"], t["id"]) for t in spec["added_tokens"]), key=lambda t: -len(t[0]))
        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.apart = Recent(self._apart, 50_000)
        self.written = {b: c for b, c in byte_characters().items() if chr(b) != c}
        self.bytes = {ord(c): b for b, c in byte_characters().items()}
        self.parts = NewParts(self._encode_texts, self._encode_new, lambda marks: self._encode_piece(marks) if marks else b"", [t for t, _ in self.special], TOGETHER // 8, REMEMBERED // 2)

    def tokens(self) -> Iterator[tuple[str, int]]:
        """The tokens that encoding can make."""
        return ((token, k) for token, k in self.vocab.items() if len(token) == 1 or self.born[k] >= 0)

    @functools.cached_property
    def match(self):
        match = ahocorasick.Automaton()
        for token, k in self.tokens():
            match.add_word(token, (k, len(token)))
        match.make_automaton()
        return match

    def _apart(self, both: int) -> bool:
        """Whether two neighbours stay two tokens: undo their merges from the last to the first and look for a merge across the seam that would have come before the one undone."""
        x, y = both >> 32, both & 0xFFFFFFFF
        born, bound = self.born, _NEVER
        while True:
            if self.pair.get((x, y), _NEVER) < bound:
                return False
            if born[x] < 0 and born[y] < 0:
                return True
            if born[x] > born[y]:
                bound, x = born[x], self.right[x]
            else:  # of two equal merges the one at the left comes first, so one across the seam would precede this
                bound, y = born[y] + 1, self.left[y]

    def _encode_piece(self, piece: str) -> bytes:
        n = len(piece)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        apart = self.apart
        for end, (token, length) in self.match.iter(piece):
            end += 1
            start = end - length
            if last[end] < 0 and (start == 0 or (last[start] >= 0 and apart[last[start] << 32 | token])):
                last[end], back[end] = token, start
        ids = []
        while n:
            ids.append(last[n])
            n = back[n]
        return np.array(ids[::-1], "<u4").tobytes()

    def _all_apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``_apart`` of many neighbours; what was met lately is remembered, one pair in each place of a table."""
        both = x << 32 | y
        at = (both.view(np.uint64) * _SPREAD >> np.uint64(64 - SEAMS)).view(np.int64)
        out = self.met_apart[at]
        todo = np.flatnonzero(self.met[at] != both)
        born, left, right = self.made_of
        new, x, y, bound = todo, x[todo], y[todo], np.full(len(todo), _NEVER)
        while len(todo):
            when = self.seam.of(x << 32 | y)
            across = (when >= 0) & (when < bound)
            born_x, born_y = born[x], born[y]
            single = (born_x < 0) & (born_y < 0)
            out[todo] = single & ~across
            undo = born_x > born_y
            bound = np.where(undo, born_x, born_y + 1)
            x, y = np.where(undo, right[x], x), np.where(undo, y, left[y])
            more = ~(across | single)
            todo, x, y, bound = todo[more], x[more], y[more], bound[more]
        self.met[at[new]] = both[new]
        kept = new[self.met[at[new]] == both[new]]  # of pairs that share a place one stays
        self.met_apart[at[kept]] = out[kept]
        return out

    def _encode_together(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces that lie in ``raw`` one after the other, and how many of each; none is longer than MOST."""
        stops = np.cumsum(sizes)
        starts = stops - sizes
        begin, end = np.repeat(starts, sizes), np.repeat(stops, sizes)
        # all tokens that begin at each byte
        at, node, depth, found = np.arange(len(raw)), np.zeros(len(raw), np.int64), 0, []
        while len(at):
            node = self.step.of(node << 8 | raw[at + depth])
            at, node, depth = at[node >= 0], node[node >= 0].astype(np.int64), depth + 1
            token = self.ends[node]
            found.append((at[token >= 0], token[token >= 0]))
            more = at + depth < end[at]
            at, node = at[more], node[more]
        start, token = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        stop = start + np.repeat(np.arange(1, depth + 1), [len(f[0]) for f in found])
        # by the length of the prefix that they end, of one prefix the longest first
        place = stop - begin[start]
        order = np.argsort((place * (len(raw) + 1) + stop) * (MOST + 1) + MOST - (stop - start))
        start, token, stop, place = start[order], token[order], stop[order], place[order]
        cuts = np.searchsorted(place, np.arange(1, MOST + 2)).tolist()
        last, back = np.full(len(raw), -1, np.int64), np.zeros(len(raw), np.int64)
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = a + np.flatnonzero(np.diff(stop[a:b], prepend=-1))
            while len(now):
                s, t = start[now], token[now]
                fits = s == begin[s]
                inner = np.flatnonzero(~fits & (last[s - 1] >= 0))
                fits[inner] = self._all_apart(last[s[inner] - 1], t[inner])
                done = stop[now[fits]] - 1
                last[done], back[done] = t[fits], s[fits]
                now = now[~fits] + 1
                now = now[now < b]
                now = now[stop[now] == stop[now - 1]]
        if (last[stops - 1] < 0).any():
            raise ValueError("a byte has no token")
        ends, at, low = np.zeros(len(raw), bool), stops, starts
        while len(at):
            ends[at - 1] = True
            at = back[at - 1]
            more = at > low
            at, low = at[more], low[more]
        return last[ends].astype("<u4"), np.add.reduceat(ends, starts, dtype=np.int64)

    def _encode_pieces(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces that lie in ``raw`` one after the other, and how many of each; no piece is empty."""
        alone = (sizes > MOST) | (len(sizes) < FEW)
        stops, short, few = np.cumsum(sizes), raw[~np.repeat(alone, sizes)], sizes[~alone]
        at = np.cumsum(few)
        cuts = [0, *(np.flatnonzero(np.diff(at // AT_ONCE)) + 1).tolist(), len(few)]
        made = [self._encode_together(short[at[a] - few[a] : at[b - 1]], few[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        made.append(joined([self._encode_piece(raw[b - n : b].tobytes().decode("latin-1").translate(self.written)) for b, n in zip(stops[alone].tolist(), sizes[alone].tolist(), strict=True)]))
        return in_order(made, alone)

    def _encode_list(self, pieces: list[str | int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces as the pre-tokenizer writes them, each different one encoded once, and of ids of special tokens, and how many of each."""
        seen: dict[str | int, int] = {}
        of = np.array([seen.setdefault(p, len(seen)) for p in pieces], np.int64)
        special = np.array([isinstance(p, int) for p in seen], bool)
        texts = [p for p in seen if isinstance(p, str)]
        raw = np.frombuffer("".join(texts).translate(self.bytes).encode("latin-1"), np.uint8)
        known = np.array([p for p in seen if isinstance(p, int)], "<u4")
        ids, counts = in_order([self._encode_pieces(raw, np.array([len(p) for p in texts], np.int64)), (known, np.ones(len(known), np.int64))], special)
        begin = np.cumsum(counts) - counts
        return gather(ids, begin[of], counts[of]), counts[of]

    def _encode_cut(self, cut: list[list[str | int]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that are cut into pieces, one after the other, and how many of each."""
        ids, counts = self._encode_list([p for pieces in cut for p in pieces])
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *map(len, cut)])]
        return ids, np.diff(ends)

    def _encode_new(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that follow a space; a word of letters is one pre-token."""
        plain = self.parts.plain(parts).to_numpy(zero_copy_only=False).astype(bool)
        words = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), parts.filter(pa.array(plain)), pa.scalar(" ", pa.large_string()))
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: int(sizes.sum())]
        return in_order([self._encode_pieces(raw, sizes), self._encode_cut([[p for p, _ in self.cut(" " + part)] for part in parts.filter(pa.array(~plain)).to_pylist()])], ~plain)

    def _encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._encode_cut([self._cut_whole(t) for t in texts])

    def _cut_whole(self, text: str) -> list[str | int]:
        todo: list = [text]
        for content, k in self.special:
            if content in text:
                cut: list = []
                for t in todo:
                    if isinstance(t, str):
                        for j, plain in enumerate(t.split(content)):
                            cut += [k, plain] if j else [plain]
                    else:
                        cut.append(t)
                todo = cut
        return [p for t in todo for p in ([p for p, _ in self.cut(t)] if isinstance(t, str) else [t])]

    def chunks(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, end, ids, counts) of runs of texts."""
        return self.parts.chunks(texts)


class Decoder:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        byte_of = {c: b for b, c in byte_characters().items()}
        tokens = {k: bytes(byte_of[c] for c in t) for t, k in spec["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        size = 1 + max(tokens)
        lengths = np.array([len(tokens.get(k, b"")) for k in range(size)], np.int64)
        self.lengths, self.starts = lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(tokens.get(k, b"") for k in range(size)), np.uint8)

    def decode(self, ids: bytes) -> str:
        k = np.frombuffer(ids, "<u4")
        if not len(k):
            return ""
        n = self.lengths[k]
        shift = self.starts[k] - np.concatenate([[0], np.cumsum(n)[:-1]])
        return self.flat[np.repeat(shift, n) + np.arange(int(n.sum()))].tobytes().decode("utf-8", "replace")


def slices(batch: pa.RecordBatch, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


@functools.cache
def decoder(path: str) -> Decoder:
    return Decoder(path)


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) of each row; any row order, ids may repeat or be null."""
    path = path or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for whole in batches:
            for a, b, ids, counts in e.chunks(whole.column(1)):
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(a, b - a), pa.array(counts, pa.int64()), binary_column(ids, counts)], ["doc_id", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of ``encoded`` (with a binary column ids) and their decoded text; special tokens stand as their contents."""
    path = path or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = decoder(path)
        for batch in (b for whole in batches for b in slices(whole, 512)):
            text = pa.array([d.decode(x.as_py() or b"") for x in batch.column("ids")], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in encoded.schema)}, decoded string")

