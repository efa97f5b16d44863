"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

The arcs of an Aho-Corasick automaton lead to the longest token that starts at a place; its failure arcs aren't needed
there. The encoder takes the longest token, checks it against
the token before it in a table of compatible pairs, falls back to the token's longest prefix that is a token, and
takes back the last token where none fits. A pair is compatible if merging by rank would not merge across its border,
so a sequence of compatible pairs is what the merges give. A place that was taken back is never tried again, and no
match is longer than the longest token, so the time for a word is linear.

A word is a string of symbols: one for each byte, the last raised by 256 as the end of the word. Texts are split at
white space by Arrow, and the distinct runs of characters of some megabytes of text are encoded together in numpy: all
words take a step at once. ``Encoder`` does the same for one word after another. It serves words that are too long
for steps in common, and runs with letters beyond U+017F, which the library's own tables normalise.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .workers import frugal

#: Pairs that the scalar encoder keeps; places of the table of pairs that words in common use, a power of two.
MAX_KEPT, PLACES = 1_200_000, 1 << 21
#: Bytes of text that are encoded together; symbols from which on a word is encoded alone.
SLICE, ALONE = 4_000_000, 48
END = "</w>"
#: Below this code point composed letters are all that exists: NFC changes nothing and all libraries agree on classes.
PLAIN = "\u0180"
#: White space of the Unicode property, which leaves out \x1c to \x1f, on which str.split() also splits.
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ODD = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens in merge order. ``symbols[t]``, ``real[t]`` (the id), ``split[t]`` and ``pairs``."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model, letters = spec["model"], _byte_letters()

        def symbols(token: str) -> str:
            end, raw = token.endswith(END) and token != END, token
            raw = raw[: -len(END)] if end else raw
            s = "".join(chr(letters[c]) for c in raw)
            return s[:-1] + chr(ord(s[-1]) + 256) if end else s

        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = {a + b for a, b in merges}
        order = [t for t in sorted(vocab, key=vocab.get) if t not in made]
        base = len(order)
        order += [a + b for a, b in merges]
        own = {t: i for i, t in enumerate(order)}
        self.symbols = [symbols(t) for t in order]
        self.real = [vocab[t] for t in order]
        self.split = [(i, i) for i in range(base)] + [(own[a], own[b]) for a, b in merges]
        self.pairs = {x: base + i for i, x in enumerate(self.split[base:])}
        self.base = base
        self.text = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.one = {s: i for i, s in enumerate(self.symbols[:base])}
        #: Tokens that merging makes of their own symbols; no other can be part of an encoding.
        self.reached = [i < base or self.merged(s) == [i] for i, s in enumerate(self.symbols)]

    def merged(self, word: str) -> list[int]:
        """Encoding by rank, the plain way; it is needed to tell which tokens can be reached."""
        parts = [self.one[c] for c in word]
        while len(parts) > 1:
            best = min((self.pairs.get(x, 1 << 30) for x in zip(parts, parts[1:], strict=False)))
            if best == 1 << 30:
                break
            left, right = self.split[best]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == left and parts[i + 1] == right:
                    out.append(best)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts


class Encoder:
    """Words to ids. Made once in a worker from a vocabulary file's bytes."""

    def __init__(self, data: bytes, vocabulary: Vocabulary | None = None):
        self.data, v = data, vocabulary or Vocabulary(data)
        self.v, self.pairs, self.split, self.base, self.real = v, v.pairs, v.split, v.base, v.real
        self.lengths = [len(s) for s in v.symbols]
        self.longest = max(self.lengths)
        self.whole = {s: i for i, s in enumerate(v.symbols) if v.reached[i]}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.whole.items():
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.prefix = [next((self.whole[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.whole), -1) for s in v.symbols]
        self.fits: dict[int, bool] = {}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(v.special, key=len, reverse=True))) + ")") if v.special else None
        self.find = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.library: Tokenizer | None = None
        # Decoding: all token texts in one string, and where each begins.
        top = max(v.text) + 1
        self.letters = "".join(v.text.get(i, "") for i in range(top))
        self.offsets = [0, *accumulate(len(v.text.get(i, "")) for i in range(top))]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank keeps the border between tokens a and b.

        It walks both tokens' merge trees down along the border, latest merge first. ``bound`` is the rank of the
        merge that is taken apart: whatever could be made across the border before it would be made in its place.
        """
        key = a << 20 | b
        if (known := self.fits.get(key)) is not None:
            return known
        x, y, bound, ok = a, b, 1 << 30, True
        while True:
            over = self.pairs.get((x, y))
            if over is not None and over < bound:
                ok = False
                break
            if x < self.base and y < self.base:
                break
            # On equal ranks the left one was merged first, so the right one is taken apart first.
            if x > y:
                bound, x = x, self.split[x][1]
            else:
                bound, y = y + 1, self.split[y][0]
        if len(self.fits) >= MAX_KEPT:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def encode_symbols(self, word: str) -> list[int]:
        if (t := self.whole.get(word)) is not None:
            return [t]
        return self._with_steps_back(word)

    def _longest(self, word: str, at: int) -> int:
        size, whole = self.automaton.longest_prefix(word[at : at + self.longest]), self.whole
        while (t := whole.get(word[at : at + size])) is None:
            size -= 1
        return t

    def _with_steps_back(self, word: str) -> list[int]:
        """``t`` is the token to try next; -1 if none is left to try there."""
        n, lengths, prefix, fits = len(word), self.lengths, self.prefix, self.fits
        at, last, shut, out, t = 0, -1, set(), [], self._longest(word, 0)
        while at < n:
            while t >= 0:
                if (end := at + lengths[t]) not in shut:
                    key = last << 20 | t
                    if last < 0 or (fits[key] if key in fits else self.compatible(last, t)):
                        break
                t = prefix[t]
            if t >= 0:
                out.append(t)
                at, last = end, t
                if at < n:
                    t = self._longest(word, at)
            else:
                shut.add(at)
                t = out.pop()
                at -= lengths[t]
                t, last = prefix[t], out[-1] if out else -1
        return out

    def word(self, word: str) -> list[int]:
        """Ids of one word as the pattern splits it."""
        raw = word if word.isascii() else word.encode().decode("latin-1")
        real = self.real
        return [real[t] for t in self.encode_symbols(raw[:-1] + chr(ord(raw[-1]) + 256))]

    def pieces(self, chunk: str) -> list[str]:
        """Words of a chunk, normalised."""
        if chunk.isascii() or max(chunk) < PLAIN:
            return self.find(chunk.lower())
        if self.library is None:  # rare letters: the library's own tables
            self.library = Tokenizer.from_str(self.data.decode())
        letters = _byte_letters()
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
        return [bytes(letters[c] for c in p).decode() for p, _ in found]

    def is_plain(self, chunk: str) -> bool:
        return self.special is None or "<|" not in chunk

    def chunk(self, chunk: str) -> list[int]:
        """Ids of a run of characters without white space."""
        if self.is_plain(chunk):
            return [i for w in self.pieces(chunk) for i in self.word(w)]
        out: list[int] = []
        for k, part in enumerate(self.special.split(chunk)):
            if k % 2:
                out.append(self.v.special[part])
            elif part:
                out += [i for w in self.pieces(part) for i in self.word(w)]
        return out

    def decode(self, ids: list[int]) -> str:
        """As the library does without a decoder: the texts of the tokens, joined by spaces."""
        return " ".join([self.letters[self.offsets[i] : self.offsets[i + 1]] for i in ids])

    def encode(self, text: str) -> list[int]:
        return [i for c in chunks(text) for i in self.chunk(c)]


def chunks(text: str) -> list[str]:
    """``text`` split at white space. No token of the pattern crosses it, so chunks are encoded one by one."""
    return [c for c in SPACES.split(text) if c] if ODD.search(text) else text.split()


class Table:
    """Whole numbers (-1 if there is none) by keys, looked up many at once: open addressing, at most half full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = keys[free]  # of those with one place, one gets it
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask
        self.values[at] = values

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found != -1)]
        return out


def _segments(offsets: np.ndarray, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of the segments ``at``, one after another."""
    sizes = offsets[at + 1] - offsets[at]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    where = np.arange(total) + np.repeat(offsets[at] - (ends - sizes), sizes)
    return np.concatenate([[0], ends]), values[where]


class Lanes:
    """The encoder for many words at once: each step is taken by all words that aren't done."""

    def __init__(self, enc: Encoder):
        self.enc = enc
        self.lengths, self.prefix, self.real = np.array(enc.lengths), np.array(enc.prefix), np.array(enc.real)
        split = np.array(enc.split)
        self.left, self.right = split[:, 0].copy(), split[:, 1].copy()
        self.pairs = Table(np.array([a << 20 | b for a, b in enc.pairs], np.int64), np.array(list(enc.pairs.values()), np.int64))
        # The automaton's states are beginnings of tokens; a step is (state, symbol) to a state.
        steps: dict[int, int] = {}
        ends = {}
        for s, t in enc.whole.items():
            state = 0
            for c in s:
                state = steps.setdefault(state << 9 | ord(c), len(steps) + 1)
            ends[state] = t
        self.steps = Table(np.array(list(steps), np.int64), np.array(list(steps.values()), np.int64))
        self.token = np.full(len(steps) + 1, -1, np.int64)
        self.token[list(ends)] = list(ends.values())
        self.known, self.fit = np.full(PLACES, -1, np.int64), np.zeros(PLACES, bool)
        # Kinds of characters: 0 symbols, 1 letters, 2 numbers, each of which is a word, 3 the separator.
        letters = [chr(c) for c in range(0x400)]
        self.kind = np.array([3 if c == "\n" else 1 if regex.match(r"\p{L}", c) else 2 if regex.match(r"\p{N}", c) else 0 for c in letters], np.uint8)
        numbers = [f"{i} " for i in range(len(enc.offsets))]
        self.numbers = pa.array(numbers, pa.large_string())
        self.texts = pa.array([f"{enc.v.text.get(i, '')} " for i in range(len(enc.offsets))], pa.large_string())

    def _longest(self, symbols: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        best, state, live = np.full(len(at), -1, np.int64), np.zeros(len(at), np.int64), np.arange(len(at))
        while len(live):
            state = self.steps.get(state << 9 | symbols[at])
            on = state >= 0
            live, state, at, end = live[on], state[on], at[on] + 1, end[on]
            t = self.token[state]
            best[live[t >= 0]] = t[t >= 0]
            on = at < end
            live, state, at, end = live[on], state[on], at[on], end[on]
        return best

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As ``Encoder.compatible``. What is known of a pair is kept in its one place of a table of fixed size."""
        key = a << 20 | b
        place = ((key.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)).astype(np.int64) & (PLACES - 1)
        out = self.fit[place]
        miss = np.flatnonzero(self.known[place] != key)
        if len(miss):
            new, which = np.unique(key[miss], return_inverse=True)
            ok = self._walked(new >> 20, new & ((1 << 20) - 1))
            out[miss] = ok[which]
            at = ((new.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)).astype(np.int64) & (PLACES - 1)
            self.known[at] = new
            stays = self.known[at] == new
            self.fit[at[stays]] = ok[stays]
        return out

    def _walked(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok, live, bound, base = np.ones(len(x), bool), np.arange(len(x)), np.full(len(x), 1 << 30), self.enc.base
        while len(live):
            over = self.pairs.get(x << 20 | y)
            bad = (over >= 0) & (over < bound)
            ok[live[bad]] = False
            on = ~bad & ((x >= base) | (y >= base))
            live, x, y = live[on], x[on], y[on]
            first = x > y
            bound = np.where(first, x, y + 1)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return ok

    def words(self, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of words that follow one another in ``symbols``."""
        n = len(symbols)
        started, ended, shut = np.full(n, -1, np.int64), np.full(n + 1, -1, np.int64), np.zeros(n + 1, bool)
        long = np.flatnonzero(end - begin >= ALONE)
        for k in long.tolist():
            tokens = self.enc.encode_symbols("".join(map(chr, symbols[begin[k] : end[k]].tolist())))
            started[begin[k] + np.concatenate([[0], np.cumsum(self.lengths[tokens])[:-1]])] = tokens
        short = np.flatnonzero(end - begin < ALONE)
        first, at, stop = begin[short], begin[short], end[short]
        last, t = np.full(len(at), -1, np.int64), self._longest(symbols, at, stop)
        while len(at):
            there = at + self.lengths[t]
            ok = (t >= 0) & ~shut[np.minimum(there, n)]
            ask = np.flatnonzero(ok & (last >= 0))
            ok[ask] = self._compatible(last[ask], t[ask])
            back = t < 0
            k = np.flatnonzero(back)
            if len(k):
                shut[at[k]] = True
                taken = ended[at[k]]
                at[k] -= self.lengths[taken]
                started[at[k]] = -1
                last[k] = np.where(at[k] > first[k], ended[at[k]], -1)
                t[k] = self.prefix[taken]
            k = np.flatnonzero(~ok & ~back)
            t[k] = self.prefix[t[k]]
            k = np.flatnonzero(ok)
            started[at[k]], ended[there[k]], last[k] = t[k], t[k], t[k]
            at[k] = there[k]
            on = at < stop
            go = k[on[k]]
            t[go] = self._longest(symbols, at[go], stop[go])
            if not on.all():
                first, at, stop, last, t = first[on], at[on], stop[on], last[on], t[on]
        used = started >= 0
        return np.concatenate([[0], np.cumsum(used)])[np.append(begin, n)], self.real[started[used]]

    def _plain(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of chunks of plain letters."""
        low = "".join([f"{c}\n" for c in chunks]).lower()
        letters = np.frombuffer(low.encode("utf-32-le"), np.uint32)
        kind = self.kind[letters]
        starts = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] >= 2)])
        # 's 't 'm 'd 're 've 'll are words where the apostrophe begins a run of symbols.
        at = np.flatnonzero((letters == ord("'")) & starts)
        x, y = letters[at + 1], letters[np.minimum(at + 2, len(letters) - 1)]
        two = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
        size = np.where(np.isin(x, [ord(c) for c in "stmd"]), 2, np.where(two, 3, 0))
        at, size = at[size > 0], size[size > 0]
        starts[at + 1] = False
        starts[at + size] = True
        where = np.flatnonzero(starts)
        breaks = kind[where] == 3
        raw = np.frombuffer(low.encode(), np.uint8)
        place = np.concatenate([[0], np.cumsum(1 + (letters >= 0x80))])
        cuts = np.append(place[where], len(raw))
        found = pa.StringArray.from_buffers(len(where), pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())).filter(pa.array(~breaks)).dictionary_encode()
        of_piece, distinct = found.indices.to_numpy(), found.dictionary
        if not len(distinct):
            return np.zeros(len(chunks) + 1, np.int64), np.zeros(0, np.int64)
        ends = np.frombuffer(distinct.buffers()[1], np.int32)[: len(distinct) + 1].astype(np.int64)
        symbols = np.frombuffer(distinct.buffers()[2], np.uint8)[: ends[-1]].astype(np.int64)
        symbols[ends[1:] - 1] += 256
        offsets, ids = self.words(symbols, ends[:-1], ends[1:])
        offsets, ids = _segments(offsets, ids, of_piece)
        upto = np.concatenate([[0], np.cumsum(~breaks)[breaks]])  # pieces before the end of each chunk
        return offsets[upto], ids

    def chunks(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of chunks."""
        every, enc = distinct.to_pylist(), self.enc
        odd = ~pc.string_is_ascii(distinct).to_numpy(zero_copy_only=False)
        slow = np.zeros(len(every), bool)
        for k in np.flatnonzero(odd).tolist():
            slow[k] = max(every[k]) >= PLAIN
        if enc.special is not None:
            slow |= pc.match_substring(distinct, "<|").to_numpy(zero_copy_only=False)
        if not slow.any():
            return self._plain(every)
        offsets, ids = self._plain([c for c, s in zip(every, slow, strict=True) if not s])
        rare = [enc.chunk(every[k]) for k in np.flatnonzero(slow).tolist()]
        offsets = np.concatenate([offsets, offsets[-1] + np.cumsum([len(x) for x in rare])])
        place = np.empty(len(every), np.int64)
        place[~slow], place[slow] = np.arange((~slow).sum()), (~slow).sum() + np.arange(slow.sum())
        return _segments(offsets, np.concatenate([ids, *[np.array(x, np.int64) for x in rare]]), place)

    def texts_of(self, texts: pa.Array, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of slices of texts, of some ``size`` bytes: rows from and to, ends of texts in chunks, distinct chunk of each, and their offsets and
        ids."""
        texts = pc.fill_null(texts, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + (size or SLICE), side="right")))
            part = texts.slice(a, b - a)
            if pc.any(pc.match_substring_regex(part, "[\x1c-\x1f]")).as_py():
                lists = pa.array([chunks(t) for t in part.to_pylist()], pa.large_list(pa.string()))
            else:
                lists = pc.utf8_split_whitespace(part)
            runs = lists.flatten().dictionary_encode()
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            yield a, b, ends, runs.indices.to_numpy().astype(np.int64), *self.chunks(runs.dictionary)
            a = b

    def ids(self, texts: pa.Array, last: int | None = None, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Of slices of texts: rows from and to, offsets, and ids; after each text the id ``last``."""
        for a, b, ends, which, offsets, ids in self.texts_of(texts, size):
            at, flat = _segments(offsets, ids, which)
            at = at[ends]
            if last is not None:
                flat, at = np.insert(flat, at[1:], last), at + np.arange(len(at))
            yield a, b, at, flat

    def joined(self, forms: pa.Array, ends: np.ndarray, which: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> list[memoryview]:
        """Of each text the forms of its ids, without the last one's trailing space."""
        flat = forms.take(pa.array(ids))
        place, data = np.frombuffer(flat.buffers()[1], np.int64)[: len(flat) + 1], flat.buffers()[2]
        of_chunk = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(place[offsets].tobytes()), data or pa.py_buffer(b"")])
        every = of_chunk.take(pa.array(which))
        cuts = np.frombuffer(every.buffers()[1], np.int64)[: len(every) + 1][ends].tolist()
        view = memoryview(every.buffers()[2] or b"")
        return [view[a : b - 1] if b > a else view[:0] for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=2)
def _encoder(data: bytes) -> Encoder:
    return Encoder(data)


@lru_cache(maxsize=2)
def _lanes(data: bytes) -> Lanes:
    return Lanes(_encoder(data))


def shared_file(docs: DataFrame, vocabulary: str) -> Broadcast:
    """The vocabulary file's bytes (1.7 MB), read by the driver and sent to all executors."""
    return docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())


def bpe_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, n_tokens, and SHA-256 of the ids and of the decoded text.

    Null and empty texts have no tokens and decode to the empty text. Each row stands alone, so repeated rows, null
    ids and texts of any length need no special case; other columns are not read.
    """
    data = shared_file(docs, vocabulary)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = _lanes(data.value)
        sha = lambda views: pa.array([hashlib.sha256(v).hexdigest() for v in views], pa.string())
        for b in batches:
            for x, y, ends, which, offsets, ids in lanes.texts_of(b.column(1)):
                n = np.concatenate([[0], np.cumsum(np.diff(offsets)[which])])[ends]
                numbers, texts = (sha(lanes.joined(forms, ends, which, offsets, ids)) for forms in (lanes.numbers, lanes.texts))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), pa.array(np.diff(n), pa.int64()), numbers, texts], names=["id", "n", "i", "d"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n bigint, i string, d string")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.col("i").alias("ids_sha256"), F.col("d").alias("decoded_sha256"))


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id and ``ids``. Edge cases as for ``bpe_round_trip``."""
    data = shared_file(docs, vocabulary)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = _lanes(data.value)
        for b in batches:
            for x, y, at, ids in lanes.ids(b.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), lists], names=["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(rows: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row for each input row: id and ``text``. Null ids decode to the empty text."""
    data = shared_file(rows, vocabulary)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(data.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode(i.as_py() or []) for i in b.column(1)], pa.string())], names=["id", "text"])

    df = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def is_sentence_end(token: str) -> bool:
    """Whether a token's text is punctuation that ends a word and holds one of ``.!?``."""
    body = token.removesuffix(END)
    return token != body and any(c in ".!?" for c in body) and all(unicodedata.category(c)[0] in "PS" for c in body)
