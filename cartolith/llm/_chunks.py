"""Cuts a text into chunks that a byte-level BPE encodes independently.

The pre-tokenizer's pattern never lets a piece run over a position whose left
neighbour is no white space and that starts with one space or one line feed
before a further non-space.  Chunks between such positions repeat often, so each
distinct chunk is encoded once per worker and kept, in packed form, in a bounded
table.  Texts that only single spaces and line feeds cut, so most, are cut by their
bytes, all texts of a batch at once, and each distinct chunk is looked up once a batch.
"""

from __future__ import annotations

import re

import numpy as np

from ._spans import PAD, equal_spans, joined

_DOUBLE = re.compile(r"\s\s|\x00")
_SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)")

_SPACE, _LEAD = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True
#: White space beyond ASCII, and the first bytes that it has.
_WIDE = np.array([int.from_bytes(chr(c).encode()) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def plain_chunks(raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and length of each chunk of plain texts, and which of the texts are plain.

    Plain: no NUL, no white space beside white space or at either end, none beyond ASCII.
    """
    data = np.frombuffer(raw, np.uint8)
    space = _SPACE[data[:-PAD]]
    odd = data[:-PAD] == 0
    odd[:-1] |= space[:-1] & space[1:]
    full = np.flatnonzero(np.diff(bounds))
    first, last = bounds[:-1][full], bounds[1:][full] - 1
    odd[first] |= space[first]
    odd[last] |= space[last]
    lead = np.flatnonzero(_LEAD[data[:-PAD]])
    two = data[lead].astype(np.int64) << 8 | data[lead + 1]
    odd[lead[np.isin(np.where(data[lead] == 0xC2, two, two << 8 | data[lead + 2]), _WIDE)]] = True
    plain = np.ones(len(bounds) - 1, bool)
    plain[np.searchsorted(bounds, np.flatnonzero(odd), "right") - 1] = False
    edge = np.zeros(len(space) + 1, bool)
    edge[bounds] = True
    feed = data[:-PAD] == 10
    edge[:-1] |= feed | (data[:-PAD] == 32)
    edge[1:] |= feed
    edge = np.flatnonzero(edge)
    start, length = edge[:-1], np.diff(edge)
    keep = plain[np.searchsorted(bounds, start, "right") - 1]
    return start[keep], length[keep], plain


def chunks(text: str) -> list[str]:
    if not text:
        return []
    if _DOUBLE.search(text) or text[0].isspace() or text[-1].isspace():
        return _SAFE.split(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


class PackedEncoder:
    """Encodes batches of texts to little-endian unsigned 32-bit ids.

    ``encode_chunks(list of str) -> list of bytes`` encodes distinct chunks;
    ``special`` maps strings that the tokenizer takes as one id wherever they stand.
    At most ``most`` chunks are kept; beyond that the table starts anew.
    """

    def __init__(self, encode_chunks, special: dict[str, int], most: int = 700_000):
        self.encode_chunks, self.most, self.known = encode_chunks, most, {}
        self.special = {k: v.to_bytes(4, "little") for k, v in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def _parts(self, text: str) -> list[str]:
        if self.cut is None or not self.cut.search(text):
            return chunks(text)
        out = []
        for i, part in enumerate(self.cut.split(text)):
            out += [part] if i % 2 else chunks(part)
        return out

    def _learn(self, missing: list[str]) -> None:
        """Encode chunks; a comma or full stop after a letter is a piece of its own, so the rest may be known."""
        known, marks, bases, plain = self.known, {}, set(), []
        for c in missing:
            if c[-1:] in (",", ".") and c[-2:-1].isalpha():
                marks[c] = c[:-1]
                if c[:-1] not in known:
                    bases.add(c[:-1])
            else:
                plain.append(c)
        plain += bases.difference(plain)
        plain += {c[-1] for c in marks}.difference(known, plain)
        known.update(zip(plain, self.encode_chunks(plain)))
        known.update((c, known[base] + known[c[-1]]) for c, base in marks.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known = {}
        if not self.known:
            self.known.update(self.special)
        raw, bounds = joined(texts)
        start, length, plain = plain_chunks(raw, bounds)
        if any(s.encode() in raw for s in self.special):
            plain &= ~np.array([any(s in t for s in self.special) for t in texts], bool)
            keep = plain[np.searchsorted(bounds, start, "right") - 1]
            start, length = start[keep], length[keep]
        one, number = equal_spans(raw, start, length)
        distinct = [raw[a:b].decode() for a, b in zip(start[one].tolist(), (start + length)[one].tolist())]
        others = {i: self._parts(texts[i]) for i in np.flatnonzero(~plain).tolist()}
        found = [*map(self.known.get, distinct)]
        new = [i for i, x in enumerate(found) if x is None]
        missing = [distinct[i] for i in new]
        if others:
            missing = list(set(missing).union(*others.values()).difference(self.known))
        if missing:
            self._learn(missing)
        find = self.known.__getitem__
        for i in new:
            found[i] = find(distinct[i])
        ids, sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        count = sizes[number]
        ends = np.concatenate([[0], np.cumsum(count)])
        packed = ids[np.repeat((np.cumsum(sizes) - sizes)[number] - ends[:-1], count) + np.arange(ends[-1])].tobytes()
        at = (4 * ends[np.searchsorted(start, bounds)]).tolist()
        return [b"".join(map(find, others[i])) if i in others else packed[a:b] for i, (a, b) in enumerate(zip(at[:-1], at[1:]))]


def slices(texts: list[str | None], most: int = 4 << 20):
    """Index ranges of at most about ``most`` characters, to bound what one call holds."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
