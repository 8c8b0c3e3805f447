"""Ids of whole texts from a ``tokenizers`` file, with each repeated unit of text encoded once.

A text's bytes are cut where a token of these vocabularies always ends: before a single space or line break
between two visible characters, after such a break, and between a letter and a following mark. Units are known
by a 64-bit hash; the library itself encodes every unit that is new, and numpy puts the ids together. Texts that hold
the string of an added token (a control string) go to the library whole, which gives it that token's id.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_JOIN = 500
_U = np.uint64
_LETTER, _SPACE, _BREAK, _MARK = 1, 2, 4, 8


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for b in range(128):
        c = chr(b)
        table[
            b
        ] = _LETTER if c.isalpha() else _SPACE if c.isspace() else 0 if c.isdigit() or c == "'" or not c.isprintable() else _MARK
    return table


_CLASS = _classes()
_random = np.random.Generator(np.random.PCG64(20))
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            out = np.full(n + n // 4, base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def segment_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[begin:end] for each pair; data: bytes as uint8. Never 0."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    h = (sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)
    h = (h ^ (h >> _U(31))) * _U(0xD6E8FEB86659FD93)
    return (h ^ (h >> _U(32))) | _U(1)


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where units begin, ascending; starts: where texts begin, which always are among them."""
    kind = _CLASS[data]
    top = int(data.max())
    if top >= 0xC2:
        at = np.flatnonzero(data == 0xC3) + 1
        kind[at[(data[at] != 0x97) & (data[at] != 0xB7)]] = _LETTER
        # White space beyond ASCII, in full: no cut beside it.
        at = np.flatnonzero(data == 0xC2) + 1
        kind[at[(data[at] == 0x85) | (data[at] == 0xA0)]] = _SPACE
    if top >= 0xE1:
        for lead, follow in ((0xE1, (0x9A, 0x9A)), (0xE2, (0x80, 0x81)), (0xE3, (0x80, 0x80))):
            at = np.flatnonzero(data == lead)
            at = at[(data[at + 1] == follow[0]) | (data[at + 1] == follow[1])]
            for k in range(3):
                kind[at + k] = _SPACE
    spaces = kind == _SPACE
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = (kind[1:] == _MARK) & (kind[:-1] == _LETTER)
    at = np.flatnonzero(spaces)
    at = at[(at > 0) & (at < len(data) - 1)]
    value = data[at]
    at = at[((value == 32) | (value == 10)) & ~spaces[at - 1] & ~spaces[at + 1]]
    edge[starts] = True
    outside = np.zeros(len(data) + 1, bool)
    outside[starts] = True
    at = at[~outside[at] & ~outside[at + 1]]
    edge[at] = True
    edge[at[data[at] == 10] + 1] = True
    edge[len(data)] = False
    return np.flatnonzero(edge)


class UnitEncoder:
    """encode(texts) gives the ids of all texts, one after another, and the number of each text's ids.

    path: a tokenizers JSON file. spaces_count: a word's ids depend on the space before it (byte-level
    vocabularies); otherwise white space only separates. At most about ``keep`` units are remembered; when there are
    more, those met again since the last time stay, and the others are forgotten.
    control_as_text: added tokens' strings in texts are ordinary text; the library's default, and ours, is that they
    are those tokens.
    """

    def __init__(self, path: str, spaces_count: bool, keep: int = 1_000_000, control_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = control_as_text
        self.spaces_count, self.keep = spaces_count, keep
        added = () if control_as_text else self.tokenizer.get_added_tokens_decoder().values()
        #: In lower case, as a vocabulary may match some of them in any case: a text too many goes to the library at
        #: worst.
        self.control = tuple(t.content.lower().encode() for t in added)
        vocabulary = self.tokenizer.get_vocab()
        #: Tokens that begin a word (byte-level: those with the space before it) or, without spaces, end one.
        self.edges = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edges[
            [i for t, i in vocabulary.items() if (t.startswith("Ġ") if spaces_count else t.endswith("</w>"))]
        ] = True
        self._forget()

    def _forget(self) -> None:
        self.slots = 1 << 17
        self.keys, self.values = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int64)
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 0
        self.ends, self.n = np.zeros(1 << 16, np.int64), 0  # ends[k]: end of unit k's ids
        self.again = np.zeros(1 << 16, bool)  # again[k]: unit k was met in a later call, too

    def _thin(self) -> None:
        slots = np.flatnonzero(self.keys)
        slots = slots[self.again[self.values[slots]]]
        hashes, numbers = self.keys[slots], self.values[slots]
        begin = np.where(numbers > 0, self.ends[numbers - 1], 0)
        size = self.ends[numbers] - begin
        ids = self.ids[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]
        self._forget()
        if 2 * len(hashes) <= self.keep:
            self._grown(hashes, ids, size)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each unit, -1 for a new one."""
        out = np.full(len(hashes), -1, np.int64)
        mask = _U(self.slots - 1)
        slot = (hashes >> _U(8)) & mask
        rows, keys = np.arange(len(hashes)), hashes
        while len(rows):
            there = self.keys[slot]
            same = there == keys
            out[rows[same]] = self.values[slot[same]]
            more = ~same & (there != 0)
            rows, keys, slot = rows[more], keys[more], (slot[more] + _U(1)) & mask
        return out

    def _put(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """New and distinct hashes."""
        mask = _U(self.slots - 1)
        slot = (hashes >> _U(8)) & mask
        while len(hashes):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[free]  # the last of equal slots stays
            won = self.keys[slot] == hashes
            self.values[slot[won]] = numbers[won]
            hashes, numbers, slot = hashes[~won], numbers[~won], (slot[~won] + _U(1)) & mask

    def _grown(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        if 2 * (self.n + len(hashes)) > self.slots:
            old, numbers = self.keys, self.values
            while 2 * (self.n + len(hashes)) > self.slots:
                self.slots *= 4
            self.keys, self.values = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int64)
            self._put(old[old != 0], numbers[old != 0])
        self._put(hashes, np.arange(self.n, self.n + len(hashes)))
        for name, used, new in (
            ("ids", self.n_ids, ids),
            ("ends", self.n, np.cumsum(sizes) + self.n_ids),
            ("again", self.n, np.zeros(len(hashes), bool)),
        ):
            kept = getattr(self, name)
            if used + len(new) > len(kept):
                kept = np.concatenate([kept[:used], np.zeros(used + 2 * len(new), kept.dtype)])
                setattr(self, name, kept)
            kept[used : used + len(new)] = new
        self.n_ids += len(ids)
        self.n += len(hashes)

    def _learn(self, units: list[str], hashes: np.ndarray) -> None:
        """Spaced runs of letters are encoded together in long texts, others by themselves."""
        if self.spaces_count:
            plain = np.fromiter((u[:1] == " " and u[1:].isalpha() for u in units), bool, len(units))
            join, lead = "", ""
        else:
            plain = np.fromiter((u.strip(" ").isalpha() for u in units), bool, len(units))
            join, lead = " ", ""
        rest = np.flatnonzero(~plain).tolist()
        some = np.flatnonzero(plain).tolist()
        encode = self.tokenizer.encode_batch_fast
        parts = [some[i : i + _JOIN] for i in range(0, len(some), _JOIN)]
        for i in range(0, len(parts), 64):
            texts = [lead + join.join([units[k] for k in p]) for p in parts[i : i + 64]]
            for part, e in zip(parts[i : i + 64], encode(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                edge = np.flatnonzero(self.edges[ids])
                ends = np.append(edge[1:], len(ids)) if self.spaces_count else edge + 1
                if len(ends) == len(part):
                    self._grown(hashes[part], ids, np.diff(ends, prepend=0))
                else:  # the library cuts one of these units after all
                    rest += part
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            found = [e.ids for e in encode([units[k] for k in part], add_special_tokens=False)]
            self._grown(
                hashes[part],
                np.array([x for f in found for x in f], np.uint32),
                np.array([len(f) for f in found], np.int64),
            )

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        coded = [(t or "").encode() for t in texts]
        low = b"\n".join(coded).lower()
        odd = []
        if any(c in low for c in self.control):
            odd = [i for i, c in enumerate(coded) if any(x in c.lower() for x in self.control)]
        for i in odd:
            coded[i] = b""
        flat, size = self._by_units(coded)
        if odd:
            parts = np.split(flat, np.cumsum(size)[:-1])
            for i in odd:
                parts[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
                size[i] = len(parts[i])
            flat = np.concatenate(parts)
        return flat, size

    def _by_units(self, coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.n > self.keep:
            self._thin()
        length = np.array([len(c) for c in coded], np.int64)
        raw = b"".join(coded)
        if not raw:
            return np.empty(0, np.uint32), np.zeros(len(coded), np.int64)
        data = np.frombuffer(raw, np.uint8)
        starts = np.cumsum(length) - length
        begin = cuts(data, starts[length > 0])
        end = np.append(begin[1:], len(data))
        hashes = segment_hashes(data, begin, end)
        number = self._find(hashes)
        self.again[number[number >= 0]] = True
        new = np.flatnonzero(number < 0)
        if len(new):
            distinct, first = np.unique(hashes[new], return_index=True)
            at = new[first]
            self._learn(
                [raw[a:b].decode() for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)], distinct
            )
            number[new] = self._find(hashes[new])
        to = self.ends[number]
        size = to - np.where(number > 0, self.ends[number - 1], 0)
        total = np.cumsum(size)
        flat = self.ids[np.repeat(to - total, size) + np.arange(total[-1])]
        upto = np.concatenate([[0], total])[np.searchsorted(begin, np.append(starts, len(data)))]
        return flat, np.diff(upto)


@lru_cache(maxsize=2)
def encoder(path: str, spaces_count: bool) -> UnitEncoder:
    """One encoder for all tasks of a Python worker."""
    return UnitEncoder(path, spaces_count)


def groups(texts: list, chars: int = 200_000):
    """(from, to) of neighbouring texts with about so many characters, at least one text each."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t or "") > chars:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)
