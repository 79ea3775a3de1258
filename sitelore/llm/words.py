r"""Words of texts as 64-bit hashes, many texts at a time.

Words are runs of bytes other than `[\x20\x09-\x0D]`; A-Z count as a-z.
"""

from __future__ import annotations

import numpy as np

from sitelore.llm.fingerprints import mix

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]
_BYTE[_SPACE] = 0
_BARE = _BYTE.copy()
_BARE[[c for c in range(33, 127) if not chr(c).isalnum()]] = 0
_PLACE = mix(np.arange(1, 1025, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
_NEAR = mix(np.zeros(1, np.uint64))[0] | np.uint64(1)
_STEP = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x165667B19E3779F9)) | np.uint64(1)


#: bytes hashed at a time; the temporaries take about 28 bytes for each
_PIECE = 1 << 18


def _weights(first: int, n: int) -> np.ndarray:
    """Odd factors of the places first, first + 1, ... of a word, without a period."""
    place = np.arange(first, first + n)
    return _PLACE[place & 1023] * (mix((place >> 10).astype(np.uint64)) | np.uint64(1))


def _sums(data: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The sum of byte value times place factor of the words that begin at `starts`; white space counts nothing."""
    out = np.empty(len(starts), np.uint64)
    ends = np.r_[starts[1:], len(data)]
    k = 0
    while k < len(starts):
        begin = int(starts[k])
        last = int(np.searchsorted(ends, begin + _PIECE, "right"))
        if last > k:
            own = starts[k:last]
            part = table[data[begin:int(ends[last - 1])]]
            place = np.arange(len(part)) - np.repeat(own - begin, ends[k:last] - own)
            far = place >> 10
            factor = _PLACE[place & 1023]
            if far.any():
                factor *= mix(far.astype(np.uint64)) | np.uint64(1)
            else:
                factor *= _NEAR
            out[k:last] = np.add.reduceat(part * factor, own - begin)
            k = last
        else:  # one word, with the white space behind it, is longer than a piece
            total = 0
            for at in range(begin, int(ends[k]), _PIECE):
                part = table[data[at:min(at + _PIECE, int(ends[k]))]]
                total += int((part * _weights(at - begin, len(part))).sum(dtype=np.uint64))
            out[k] = total % (1 << 64)
            k += 1
    return out


def word_hashes(texts: list[bytes], bare: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the words of text i are hashes[offsets[i]:offsets[i + 1]]. `bare` ignores ASCII punctuation
    at the end of words."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1  # words and white space take turns
    if not space[0]:
        edge = np.r_[0, edge]
    starts, stops = edge[::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    offsets = np.r_[0, np.searchsorted(starts, ends)]
    if not len(starts):
        return np.zeros(0, np.uint64), offsets
    sums = _sums(data, starts, _BARE if bare else _BYTE)
    if bare:
        return mix(sums), offsets
    return mix(sums + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), offsets


def combine(hashes: np.ndarray, places: list[int], tag: int = 0) -> np.ndarray:
    """One hash per position from the words at the given distances; positions that reach past the end are left out."""
    n = len(hashes) - places[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, tag + len(places), np.uint64)
    for d in places:
        out = out + hashes[d:d + n] * _STEP[d % 64]
    return mix(out)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Each text's distinct shingles, ascending; fewer words than a shingle make one, none make none."""
    hashes, offsets = word_hashes(texts)
    whole = combine(hashes, list(range(words)))
    out = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= words:
            out.append(np.unique(whole[a:b - words + 1]))
        elif b > a:
            out.append(combine(hashes[a:b], list(range(b - a)), 1 << 20))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
