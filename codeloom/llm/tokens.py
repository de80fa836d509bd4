"""Whole texts to token ids with the `tokenizers` library, which sees each distinct pre-token once per worker.

A text of known characters (ASCII, Latin letters, common signs) is cut at its pre-token borders; each distinct pre-token
goes through the library, and a bounded memo keeps its ids. With the vocabulary that drops white space, many texts are cut
at once, over their bytes, and the memo is a table of numbers that is asked for many pre-tokens at once. Any other text, and
any text that holds the string of an added token, goes through the library whole. Either way the ids equal those that a fresh
tokenizer gives for the whole text with add_special_tokens=False, which tests compare: the string of an added token becomes
its id, as the library has it.
"""

from __future__ import annotations

import os
import re
from array import array
from operator import itemgetter

import numpy as np

from codeloom.llm.common import enter, worker_cache

# Without U+0130, whose lower case is two characters, and U+017F, which a pattern that ignores case takes for an s.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-įı-ž"
_DIGIT = "0-9"
_SIGN = r"!-/:-@\[-`{-~¡-©«¬®-±´¶-¸»¿×÷‐-‧‹›€"
_BLANK = r" \t\n\x0b\x0c\r"
#: The pre-token pattern of byte-level vocabularies, over known characters, commonest alternative first.
_BYTE_LEVEL = re.compile(rf" ?[{_LETTER}]+| ?[{_DIGIT}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_SIGN}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
#: The pattern of the vocabulary with word ends, which lowers case and drops white space; `word_borders` follows it.
_WORD_LEVEL = re.compile(rf"[{_LETTER}]+|[{_DIGIT}]|(?i:'s|'t|'re|'ve|'m|'ll|'d)|[{_SIGN}]+")
#: The characters that byte-level vocabularies write bytes as; printable ones stand for themselves.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_AS_CHAR = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_BLANKS = " \t\n\x0b\x0c\r"
_KNOWN = re.compile(rf"[{_LETTER}{_DIGIT}{_SIGN}{_BLANK}]*")
#: Kinds of bytes for `word_borders`; those of longer characters are signs until their second byte is looked at.
_IS_BLANK, _IS_SIGN, _IS_LETTER, _IS_DIGIT = range(4)
_KIND = np.full(256, _IS_SIGN, np.uint8)
_KIND[list(_BLANKS.encode())], _KIND[list(b"0123456789")] = _IS_BLANK, _IS_DIGIT
_KIND[[b for b in range(128) if chr(b).isalpha()]] = _IS_LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: What stands for each byte in the vocabulary, as UTF-32; a line break, which no piece holds, stands for itself.
_CHAR_OF = np.array([10 if b == 10 else ord(_AS_CHAR[b]) for b in range(256)], "<u4")
_SPREAD, _BLOCK = 4 << 20, 1 << 17  # characters of texts that are cut at once, if no text has more, and pieces looked up at once
_KEY = 24  # bytes of the longest pieces in `_Words`, a multiple of 8; longer ones are rare
#: What keeps the first k of eight bytes.
_UPTO = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_borders(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What `_WORD_LEVEL` finds in the UTF-8 bytes of known characters: for each byte, whether it is in a piece, and whether
    one begins there (the first blank of several begins something, too). The bytes end with three blanks or more."""
    kind = _KIND[data]
    at = np.flatnonzero(data >= 0xC2)
    at = at[data[at] <= 0xC5]  # characters of two bytes; all known ones of three are signs
    first, second = data[at], data[at + 1]
    letter = np.where(first == 0xC2, (second == 0xAA) | (second == 0xB5) | (second == 0xBA), (first != 0xC3) | (second != 0x97) & (second != 0xB7))
    at = at[letter]
    kind[at] = kind[at + 1] = _IS_LETTER
    begins = kind == _IS_DIGIT
    begins[1:] |= kind[1:] != kind[:-1]
    begins[0] = True
    # An apostrophe that is a run of its own takes s, t, m, d, re, ve or ll with it.
    at = np.flatnonzero(data == ord("'"))
    at = at[begins[at] & (kind[at + 1] == _IS_LETTER)]
    if len(at):
        one, two = data[at + 1] | 32, data[at + 2] | 32
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        at, n = at[short | long], np.where(short, 2, 3)[short | long]
        begins[at + 1] = False
        begins[at + n] = True
    return kind != _IS_BLANK, begins


class _Memo(dict):
    """Pre-token -> its ids as bytes. What is asked for and not there comes from the generation before, or is learnt: the
    library's model splits it, in the vocabulary's own characters."""

    def __init__(self, split, spaces: bool, form: str, old: dict[str, bytes]):
        super().__init__()
        self.split, self.spaces, self.form, self.old = split, spaces, form, old

    def __missing__(self, p: str) -> bytes:
        got = self.old.get(p)
        if got is None:
            s = p if self.spaces else p.lower()
            if not s.isascii() or s[0] in _BLANKS:  # other characters stand for themselves
                s = s.encode().decode("latin-1").translate(_AS_CHAR)
            got = array(self.form, [t.id for t in self.split(s)]).tobytes()
        self[p] = got
        return got


def _ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... n[0] of them, then those of the next."""
    ends = np.cumsum(n)
    return np.repeat(starts - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def _keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """The first _KEY bytes of each piece, in three numbers, zeros behind its end."""
    eights, at, low = data[: len(data) // 8 * 8].view("<u8"), starts >> 3, ((starts & 7) << 3).astype(np.uint64)
    high, out = np.uint64(64) - low, []
    left = eights[at]
    for k in range(_KEY // 8):
        right = eights[at + k + 1]
        out.append((left >> low | right << high) & _UPTO[np.clip(sizes - 8 * k, 0, 8)])
        left = right
    return tuple(out)


class _Words:
    """Pieces of at most _KEY bytes -> their ids, for many pieces at once: a hash table with linear probes. A row has the whole
    piece, so that equal hashes mix up nothing, and where its ids begin in `flat` (from 1 on) and how many they are. It takes
    limit + _BLOCK pieces; what is not in it comes from the generation before."""

    def __init__(self, limit: int, kind: str, old: _Words | None):
        self.bits = ((limit + _BLOCK) * 3 // 2).bit_length()
        self.rows, self.flat = np.zeros((1 << self.bits, 4), np.uint64), np.zeros(1 << 16, kind)
        self.size, self.used, self.old = 0, 1, old
        if old is not None:
            old.old = None

    def slots(self, keys: tuple[np.ndarray, ...]) -> np.ndarray:
        h = keys[0] * np.uint64(0x9E3779B97F4A7C15) + keys[1] * np.uint64(0xC2B2AE3D27D4EB4F) + keys[2] * np.uint64(0x165667B19E3779F9)
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _same(self, rows: np.ndarray, keys: tuple[np.ndarray, ...]) -> np.ndarray:
        return (rows[:, 0] == keys[0]) & (rows[:, 1] == keys[1]) & (rows[:, 2] == keys[2])

    def find(self, keys: tuple[np.ndarray, ...], slots: np.ndarray) -> np.ndarray:
        """begin << 8 | how many for each piece, 0 for one that isn't there."""
        rows = self.rows.take(slots, axis=0)
        same = self._same(rows, keys)
        out = np.where(same, rows[:, 3], np.uint64(0)).view(np.int64)
        at = np.flatnonzero(~same & (rows[:, 0] != 0))
        slots = slots[at]
        while len(at):
            slots = (slots + 1) & (1 << self.bits) - 1
            rows = self.rows.take(slots, axis=0)
            same = self._same(rows, tuple(k[at] for k in keys))
            out[at[same]] = rows[same, 3]
            on = ~same & (rows[:, 0] != 0)
            at, slots = at[on], slots[on]
        return out

    def claim(self, keys: tuple[np.ndarray, ...], slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gives each distinct one of these pieces, none of which is there, a row: which pieces got one, and their rows."""
        at, taken, places = np.arange(len(slots)), [], []
        while len(at):
            free = np.flatnonzero(self.rows[slots, 0] == 0)
            self.rows[slots[free], 3] = at[free].astype(np.uint64)  # of several that want a row, one stays
            won = free[self.rows[slots[free], 3] == at[free].astype(np.uint64)]
            for k in range(3):
                self.rows[slots[won], k] = keys[k][at[won]]
            self.rows[slots[won], 3] = 0
            taken.append(at[won])
            places.append(slots[won])
            on = ~self._same(self.rows.take(slots, axis=0), tuple(k[at] for k in keys))
            at, slots = at[on], (slots[on] + 1) & (1 << self.bits) - 1
        first, place = np.concatenate(taken), np.concatenate(places)
        self.size += len(first)
        return first, place

    def carry(self, keys: tuple[np.ndarray, ...], places: np.ndarray) -> None:
        """Fills the rows of pieces that the generation before knows."""
        if self.old is None:
            return
        found = self.old.find(keys, self.old.slots(keys))
        some = np.flatnonzero(found)
        n = found[some] & 255
        self.put(places[some], self.old.flat[_ranges(found[some] >> 8, n)], n)

    def put(self, places: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        begin = self.append(ids) + np.cumsum(n) - n
        self.rows[places, 3] = (begin << 8 | n).astype(np.uint64)

    def append(self, ids: np.ndarray, keep: bool = True) -> int:
        """Where these ids stand in `flat` now; without `keep`, until others come."""
        begin = self.used
        if begin + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(begin + len(ids), self.flat.dtype)])
        self.flat[begin : begin + len(ids)] = ids
        if keep:
            self.used += len(ids)
        return begin


class Encoder:
    """Ids of texts. `spaces` says whether white space belongs to tokens (byte-level) or is dropped. `kind` is how ids are
    written: little-endian, unsigned, of 16 bits where the vocabulary allows it, else of 32.

    Without `spaces`, `words` keeps the ids of all but long pre-tokens. Words and memo have two generations: a full one becomes
    the old one, from which entries in use move on, so that each holds at most about 2 * limit entries, and the pre-tokens of
    one text, or block of them.
    """

    def __init__(self, path: str, spaces: bool, limit: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        assert not any(t.normalized for t in self.tokenizer.get_added_tokens_decoder().values()), "added tokens are looked for in the raw text"
        self.spaces, self.limit, self.model = spaces, limit, self.tokenizer.model
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.form, self.kind = ("H", "<u2") if small else ("I", "<u4")
        self.memo = _Memo(self.model.tokenize, spaces, self.form, {})
        self.words: _Words | None = None

    def _encode(self, text: str) -> bytes:
        return array(self.form, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes of `kind`; null and empty texts have none."""
        out, spread, size = [b""] * len(texts), [], 0
        for i, t in enumerate(texts):
            if not t:
                continue
            if any(map(t.__contains__, self.added)) or not _KNOWN.fullmatch(t):
                out[i] = self._encode(t)
            elif self.spaces:
                self._turn()
                pieces = _BYTE_LEVEL.findall(t)
                out[i] = b"".join(itemgetter(*pieces)(self.memo)) if len(pieces) > 1 else self.memo[pieces[0]]
            else:
                if spread and size + len(t) > _SPREAD:
                    self._spread(texts, spread, out)
                    spread, size = [], 0
                spread.append(i)
                size += len(t)
        if spread:
            self._spread(texts, spread, out)
        return out

    def _turn(self) -> None:
        if len(self.memo) > self.limit:
            self.memo.old = {}
            self.memo = _Memo(self.model.tokenize, self.spaces, self.form, self.memo)

    def _spread(self, texts: list[str | None], some: list[int], out: list[bytes]) -> None:
        """Puts the ids of texts[i] into out[i] for each i of some: known texts, with white space dropped."""
        self._turn()
        encoded = [texts[i].encode() for i in some]
        upto = np.cumsum([len(t) + 1 for t in encoded])  # where the next text begins
        data = _LOWER[np.frombuffer(b"\n".join([*encoded, b"\n" * (_KEY + 16 - upto[-1] % 8)]), np.uint8)]
        inside, begins = word_borders(data)
        borders = np.flatnonzero(begins)  # white space between pieces begins something, too
        at = np.flatnonzero(inside[borders])
        starts, sizes = borders[at], borders[at + 1] - borders[at]
        if not len(starts):
            return
        done = [self._block(data, starts[k : k + _BLOCK], sizes[k : k + _BLOCK]) for k in range(0, len(starts), _BLOCK)]
        ids, n = b"".join(d[0] for d in done), np.concatenate([d[1] for d in done])
        cuts = (np.append(0, np.cumsum(n))[np.searchsorted(starts, upto)] * int(self.kind[-1])).tolist()
        for i, a, b in zip(some, [0, *cuts], cuts, strict=False):
            out[i] = ids[a:b]

    def _block(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The ids of some pieces of data, end to end, and how many each has."""
        if self.words is None or self.words.size > self.limit:
            self.words = _Words(self.limit, self.kind, self.words)
        words = self.words
        keys = _keys(data, starts, sizes)
        slots = words.slots(keys)
        found = words.find(keys, slots)
        long = sizes > _KEY
        new = np.flatnonzero((found == 0) & ~long)
        if len(new):
            own, own_slots = tuple(k[new] for k in keys), slots[new]
            first, places = words.claim(own, own_slots)
            words.carry(tuple(k[first] for k in own), places)
            left = words.rows[places, 3] == 0
            self._learn(data, starts[new[first[left]]], sizes[new[first[left]]], places[left])
            found[new] = words.find(own, own_slots)
        begin, n = found >> 8, found & 255
        if long.any():  # their ids stand behind those that are kept, for this block only
            held = [self.memo[data[a : a + k].tobytes().decode()] for a, k in zip(starts[long].tolist(), sizes[long].tolist(), strict=True)]
            n[long] = [len(h) // words.flat.itemsize for h in held]
            begin[long] = words.append(np.frombuffer(b"".join(held), self.kind), keep=False) + np.cumsum(n[long]) - n[long]
        return words.flat[_ranges(begin, n)].tobytes(), n

    def _learn(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> None:
        """Asks the model for the ids of these pieces and keeps them at these places of the words."""
        for k in range(0, len(starts), 2000):
            n = sizes[k : k + 2000] + 1
            line = data[_ranges(starts[k : k + 2000], n)]
            line[np.cumsum(n) - 1] = 10
            shown = line[:-1].tobytes()
            if not shown.isascii():
                shown = shown.decode().lower().encode()
            pieces = _CHAR_OF[np.frombuffer(shown, np.uint8)].tobytes().decode("utf-32-le").split("\n")
            tokens = [*map(self.model.tokenize, pieces)]
            n = np.fromiter(map(len, tokens), np.int64, len(tokens))
            ids = np.array([t.id for of in tokens for t in of], self.kind)
            self.words.put(places[k : k + 2000], ids, n)

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.batch([text])[0], self.kind).astype("<u4")


_encoders: dict[tuple[str, bool], Encoder] = {}
worker_cache("tokens", _encoders.clear)


def encoder(path: str, spaces: bool, limit: int = 300_000) -> Encoder:
    """One per worker process; called at the start of a task. `limit` is the memo's, of about 160 bytes an entry; `_Words` has
    32 bytes a row, and one and a half to three times as many rows as pieces."""
    enter("tokens")
    if (path, spaces) not in _encoders:
        _encoders[path, spaces] = Encoder(path, spaces, limit)
    found = _encoders[path, spaces]
    found.limit = limit
    return found
