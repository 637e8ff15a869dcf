"""Byte spans of many texts at once: where words stand, and which spans are equal."""

from __future__ import annotations

import numpy as np

from ._similar import mix

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
#: Zero bytes behind the texts, so that eight bytes can be read from any place; spans up to ``SHORT`` bytes are read so.
PAD, SHORT = 8, 32
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_WORD = np.ones(256, bool)
_WORD[list(b" \t\n\r\x0b\x0c")] = False


def joined(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    """The bytes of all texts with ``PAD`` zeros behind them, and where each text starts, with the end of the last."""
    raw = [(t or "").encode() for t in texts]
    return b"".join([*raw, bytes(PAD)]), np.cumsum([0, *map(len, raw)])


def words(raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after it; no word runs over the start of a text."""
    word = _WORD[np.frombuffer(raw, np.uint8, len(raw) - PAD)]
    edge = np.zeros(len(word) + 1, bool)
    edge[bounds] = True
    edge[1:] |= ~word
    start = word & edge[:-1]
    edge[bounds] = True
    edge[:-1] |= ~word
    return np.flatnonzero(start), np.flatnonzero(word & edge[1:]) + 1


def equal_spans(raw: bytes, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One span of each distinct content, and for each span the number of its content.

    Spans are sorted by a hash and held against the first of equal hash; longer ones, and
    those that differ from it, are told apart by their bytes.
    """
    eight = np.ndarray(len(raw) - PAD + 1, "<u8", raw, strides=(1,))
    short = np.flatnonzero(length <= SHORT)
    s, n = start[short], length[short]
    parts = [(at, eight[s[at] + k] & _LOW[np.minimum(n[at] - k, 8)]) for k in range(0, SHORT, 8) if len(at := np.flatnonzero(n > k)) or not k]
    key = np.zeros(len(s), np.uint64)
    with np.errstate(over="ignore"):
        for at, part in parts:
            key[at] = mix(key[at] * _MULTIPLY + part)
    order = np.argsort(key)
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    one, number = order[new], np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    like = one[number]
    differ = n != n[like]
    for at, part in parts:
        whole = np.zeros(len(s), np.uint64)
        whole[at] = part
        differ[at] |= part != whole[like[at]]
    out = np.empty(len(start), np.int64)
    out[short] = number
    rest, seen, more = np.sort(np.concatenate([np.flatnonzero(length > SHORT), short[differ]])), {}, []
    for i, a, b in zip(rest.tolist(), start[rest].tolist(), (start + length)[rest].tolist()):
        k = seen.setdefault(raw[a:b], len(seen))
        if k == len(more):
            more.append(i)
        out[i] = len(one) + k
    return np.concatenate([short[one], np.array(more, np.int64)]), out
