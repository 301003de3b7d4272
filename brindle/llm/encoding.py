"""Token ids as the tokenizers library gives them, with repeated words encoded once.

The library's own normaliser, pre-tokeniser and model do the work; between them sits a bounded cache in each Python worker.
A text of plain letters, digits, marks and single spaces is cut into words here, as the pre-tokeniser would cut it, which is
checked by their lengths; only words that the cache does not have reach the library's model. Other texts go through the
library's normaliser and pre-tokeniser, and a text that holds a special string goes to the library whole.

``encode_all`` cuts a column of texts by its bytes, many texts at a time, and finds their words in one table of words of up to
24 bytes. A text that it can't cut so, or that is longer than ``GROUP``, goes through ``encode``.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Collection, Iterator

import numpy as np
import pyarrow as pa

from .common import kept

#: Bytes of the cache of words.
WORDS = 160 << 20
#: Bytes that an entry takes besides its letters and ids.
ENTRY = 200
#: Letters that are their own composed form; where lower-casing one gives other characters, its text goes to the library.
LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
MARK = r"!-/:-@\[-`{-~"
#: Fixed values of the pre-tokenisers: endings that are words.
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Bytes of texts that are cut at a time.
GROUP = 1 << 20
#: Places of the table of words, as a power of 2; it is emptied when half are taken.
PLACES = 21
#: Bytes of the longest word in the table.
LONGEST = 24
#: Classes of bytes. Bytes from 128 on are of letters only if ``LETTER`` has the letter; ``_Cut`` looks.
ODD, LETTERS, DIGITS, MARKS, SPACE, LINE, EDGE = range(7)
CLASSES = np.array([LETTERS if c.isalpha() else DIGITS if c.isdigit() else SPACE if c == " " else LINE if c == "\n" else MARKS if c.isprintable() else ODD for c in map(chr, range(128))] + [LETTERS] * 64 + [ODD] * 3 + [LETTERS] * 7 + [ODD] * 54, np.uint8)
#: Of the first, second and third eight bytes: those that a word of each length has.
OWN = [np.array([(1 << 8 * min(8, max(0, n - at))) - 1 for n in range(LONGEST + 1)], np.uint64) for at in (0, 8, 16)]


class TwoAges(dict):
    """A cache of about ``most`` bytes: when the young age has half of them it becomes the old one."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.size, self.old = make, most // 2, 0, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        cost = ENTRY + 2 * len(key) + (len(value) if isinstance(value, bytes) else 0)
        if cost * 64 > self.most:
            return value
        if self.size + cost > self.most:
            self.old = dict(self)
            self.clear()
            self.size = 0
        self.size += cost
        self[key] = value
        return value


class _Spelt(dict):
    """How the library's pre-tokeniser spells a letter, by its number."""

    def __init__(self, cut: Callable):
        super().__init__()
        self.cut = cut

    def __missing__(self, letter: int) -> str:
        self[letter] = spelt = self.cut(chr(letter))[0][0]
        return spelt


def cut_bytes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words of the texts ``data[at[k]:at[k + 1]]``, and whether each text could be cut; starts in others mean nothing."""
    edges = at[:-1][at[:-1] < len(data)]
    kind = CLASSES[data]
    before, after = np.empty_like(kind), np.empty_like(kind)
    before[1:], before[edges] = kind[:-1], EDGE
    after[:-1], after[edges - 1] = kind[1:], EDGE  # the last text's edge is at -1
    space, line, solid = kind == SPACE, kind == LINE, (after >= LETTERS) & (after <= MARKS)
    starts = space | (line & ((before != LINE) | solid)) | (~line & (before != kind) & (before != SPACE))
    odd = (kind == ODD) | (space & ~solid)
    for lead, low, high in ((0xC3, 0x97, 0x97), (0xC3, 0xB7, 0xB7), (0xC9, 0x90, 0xBF)):  # no letters, or later ones
        odd[:-1] |= (data[:-1] == lead) & (data[1:] >= low) & (data[1:] <= high)
    marks = np.flatnonzero((data == 39) & starts)
    if len(marks):  # an ending that is a word: the letters after it start another
        one, two = (np.where(marks + k < len(data), data[np.minimum(marks + k, len(data) - 1)], 0) for k in (1, 2))
        inside = after[marks] == LETTERS
        twice = inside & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        twice[twice] = after[marks[twice] + 1] == LETTERS
        once = inside & np.isin(one, list(b"stmd"))
        starts[marks[once | twice] + 1] = False
        rest = np.concatenate([marks[once] + 2, marks[twice] + 3])
        starts[rest[rest < len(data)]] = True
    firsts = np.flatnonzero(starts)
    wrong = np.searchsorted(at, np.flatnonzero(odd), "right") - 1
    sound = np.ones(len(at) - 1, bool)
    sound[wrong] = False
    return firsts, sound


class Table:
    """Ids of words of up to ``LONGEST`` bytes, found many at a time by their bytes, in a place for each word."""

    def __init__(self, kind: np.dtype):
        self.ids, self.kind = np.zeros(1 << 16, kind), kind
        self.clear()

    def clear(self) -> None:
        self.rows = np.zeros((1 << PLACES, 4), np.uint64)  # a word's bytes; start and number of its ids
        self.count = self.used = 0

    @staticmethod
    def keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The bytes of words as three numbers; ``data`` goes on for 32 bytes after the last word."""
        eights, first, shift = data.view("<u8"), starts >> 3, ((starts & 7) << 3).astype(np.uint64)
        keys, back = np.empty((len(starts), 3), np.uint64), np.uint64(64) - shift
        low = eights[first]
        for k, own in enumerate(OWN):
            high = eights[first + (k + 1)]
            keys[:, k] = (low >> shift | high << back) & own[sizes]
            low = high
        return keys

    @staticmethod
    def places(keys: np.ndarray) -> np.ndarray:
        mixed = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) + (keys[:, 1] ^ keys[:, 1] >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F) + keys[:, 2] * np.uint64(0x165667B19E3779F9)
        mixed ^= mixed >> np.uint64(31)
        return (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - PLACES)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Start << 24 | number of ids of each word; 0 where the table lacks it."""
        at, out, left = self.places(keys), np.zeros(len(keys), np.uint64), np.arange(len(keys))
        while len(left):
            rows = self.rows.take(at, axis=0)
            same = (rows[:, 0] == keys[:, 0]) & (rows[:, 1] == keys[:, 1]) & (rows[:, 2] == keys[:, 2])
            hit = rows[:, 3] * same
            out[left] = hit
            on = np.flatnonzero(~same & (rows[:, 3] != 0))
            at, keys, left = at[on] + 1 & (1 << PLACES) - 1, keys[on], left[on]
        return out

    def keep(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Put ids behind those in use; start << 24 | number of each word's."""
        ends = self.used + np.cumsum(sizes)
        if ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), int(ends[-1])), self.kind)])
        self.ids[self.used : ends[-1]] = ids
        return ((ends - sizes) << 24 | sizes).astype(np.uint64)

    def add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Add words that the table lacks, each once."""
        rows = np.column_stack([keys, self.keep(ids, sizes)])
        self.used += len(ids)
        self.count += len(rows)
        at = self.places(keys)
        while len(rows):
            free = self.rows[at, 3] == 0
            self.rows[at[free]] = rows[free]
            left = (self.rows[at] != rows).any(axis=1)
            at, rows = at[left] + 1 & (1 << PLACES) - 1, rows[left]


class Encoder:
    """Ids of whole texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` has them."""

    def __init__(self, path: str, words: int = WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.library.get_vocab_size() <= 65536 else np.dtype("<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        cut, self.tokenize = self.library.pre_tokenizer.pre_tokenize_str, self.library.model.tokenize
        self.lower = self.library.normalizer is not None and self.library.normalizer.normalize_str("A") == "a"
        self.spaced = cut(" b")[0][0] != cut("b")[0][0]  # a word takes the space before it along
        space, digits = " ?" if self.spaced else "", "[0-9]" if len(cut("12")) > 1 else "[0-9]+"
        lines = "|\n+(?=\n[^\\s])|\n(?=[^\\s])" if self.spaced else ""  # the last new line before a word stands alone
        self.cuts = re.compile(f"{space}[{LETTER}]+|{ENDINGS}|{space}{digits}|{space}[{MARK}]+{lines}").findall
        self.spelt = _Spelt(cut)
        self.words = TwoAges(lambda word: self._word(word.translate(self.spelt)), words * 3 // 4)
        self.others = TwoAges(self._word, words // 4)
        self.by_bytes = self.spaced and self.library.normalizer is None and not self.lower and len(cut("12")) == 1
        if self.by_bytes:
            self.table, self.letters = Table(self.kind), np.zeros(256, "<u4")  # the letter that spells each byte
            for plain in map(chr, range(1, 0x250)):
                self.letters[list(plain.encode())] = [ord(c) for c in cut(plain)[0][0]]

    def _word(self, word: str) -> bytes:
        """The ids of one word of the pre-tokeniser."""
        return array(self.code, [t.id for t in self.tokenize(word)]).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, self.kind)
        plain = text.lower() if self.lower else text
        if any(s in text or s in plain for s in self.specials):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind)
        words, ids = self.cuts(plain), self.words
        if len("".join(words)) + (0 if self.spaced else plain.count(" ") + plain.count("\n")) != len(plain):
            whole = text if self.library.normalizer is None else self.library.normalizer.normalize_str(text)
            words, ids = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(whole)], self.others
        return np.frombuffer(b"".join(map(ids.__getitem__, words)), self.kind)

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """``encode`` of each text of a column."""
        if not self.by_bytes or not len(texts):
            yield from (self.encode(t) for t in texts.to_pylist())
            return
        if texts.null_count:
            texts = texts.fill_null("")
        _, places, data = texts.buffers()
        at = np.frombuffer(places, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data, k = np.frombuffer(data or b"", np.uint8), 0
        while k < len(texts):
            last = max(k + 1, int(np.searchsorted(at, at[k] + GROUP, "right")) - 1)
            if at[last] - at[k] > GROUP:
                yield self.encode(texts[k].as_py())
            else:
                yield from self._group(data[at[k] : at[last]], at[k : last + 1] - at[k])
            k = last

    def _group(self, data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        if not len(data):
            yield from [np.zeros(0, self.kind)] * (len(at) - 1)
            return
        starts, sound = cut_bytes(data, at)
        raw = data.tobytes()
        for special in self.specials:
            found = raw.find(special.encode())
            while found >= 0:
                sound[np.searchsorted(at, found, "right") - 1] = False
                found = raw.find(special.encode(), found + 1)
        ends = np.append(starts[1:], len(data))
        if not sound.all():
            good = sound[np.searchsorted(at, starts, "right") - 1]
            starts, ends = starts[good], np.minimum(ends[good], at[np.searchsorted(at, starts[good], "right")])
        spans = self._spans(raw, starts, ends)
        sizes = (spans & np.uint64((1 << 24) - 1)).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.table.ids[np.repeat((spans >> np.uint64(24)).astype(np.int64) - total[:-1], sizes) + np.arange(total[-1])]
        cuts = total[np.searchsorted(starts, at)].tolist()
        for k, fine in enumerate(sound.tolist()):
            yield ids[cuts[k] : cuts[k + 1]] if fine else self.encode(raw[at[k] : at[k + 1]].decode())

    def _spans(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the table's ids have each word's."""
        table, sizes = self.table, ends - starts
        if table.count >> PLACES - 1:
            table.clear()
        short = sizes <= LONGEST
        all_short = bool(short.all())
        some = slice(None) if all_short else np.flatnonzero(short)
        keys = table.keys(np.frombuffer(raw + bytes(40 - len(raw) % 8), np.uint8), starts[some], sizes[some])
        found = table.find(keys)
        lacking = np.flatnonzero(found == 0)
        if len(lacking):
            fresh: dict[bytes, int] = {}
            for k, a, b in zip(lacking.tolist(), starts[some][lacking].tolist(), ends[some][lacking].tolist()):
                fresh.setdefault(raw[a:b], k)
            table.add(keys[list(fresh.values())], *self._words(fresh))
            found[lacking] = table.find(keys[lacking])
        if all_short:
            return found
        spans, long = np.empty(len(starts), np.uint64), np.flatnonzero(~short)
        spans[some] = found
        ids = [self.words[raw[a:b].decode()] for a, b in zip(starts[long].tolist(), ends[long].tolist())]
        spans[long] = table.keep(np.frombuffer(b"".join(ids), self.kind), np.array([len(x) // self.kind.itemsize for x in ids]))  # until the next words
        return spans

    def _words(self, words: Collection[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain words, one after the other, and their numbers."""
        spelt, at, ids, sizes = self.letters[np.frombuffer(b"".join(words), np.uint8)].tobytes().decode("utf-32-le"), 0, [], []
        for size in map(len, words):
            tokens = self.tokenize(spelt[at : at + size])
            ids += [t.id for t in tokens]
            sizes.append(len(tokens))
            at += size
        return np.array(ids, self.kind), np.array(sizes, np.int64)


def encoder(path: str) -> Encoder:
    """A worker's encoder; it goes when the worker turns to something else."""
    return kept(("encoder", path), lambda: Encoder(path))
