"""Words and word shingles of whole texts, hashed for a whole batch at once."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

from gleaner.llm.common import SHINGLE_WORDS, mix

_BASE = 0x5DEECE66D1F3A9B5 | 1
_CHUNK = 1 << 16


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS, _INVERSE = _powers(_CHUNK, _BASE), _powers(_CHUNK, pow(_BASE, -1, 2**64))
#: Which bytes are white space: 0x20 and 0x09 to 0x0D; and the lower case of A to Z.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: For looser comparison: any ASCII byte but letters and digits separates words.
LOOSE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Scripts without spaces, in which every character is a word: Thai, Lao, Burmese, Khmer, Japanese, Chinese.
_UNSPACED = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))


@functools.lru_cache(1)
def _kinds() -> np.ndarray:
    """For each character: 1 if it separates words (punctuation, space, symbol), 2 if it is a word, else 0."""
    out = np.zeros(0x110000, np.uint8)
    for a, b in _UNSPACED:
        out[a : b + 1] = 2
    out[[c for c in range(128, 0x110000) if unicodedata.category(chr(c))[0] in "PSZ"]] = 1
    return out


def _beyond_ascii(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of separators that are not ASCII, and where one-character words begin and end."""
    gone, cuts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n, least, most in ((2, 0xC2, 0xDF), (3, 0xE0, 0xEF), (4, 0xF0, 0xF4)):
        at = np.flatnonzero((data[:size] >= least) & (data[:size] <= most))
        code = data[at].astype(np.int64) & (0x7F >> n)
        for k in range(1, n):
            code = code << 6 | (data[at + k] & 0x3F)
        kind = _kinds()[np.minimum(code, 0x10FFFF)]
        gone += [at[kind == 1] + k for k in range(n)]
        cuts += [at[kind == 2], at[kind == 2] + n]
    gone, cuts = np.concatenate(gone), np.concatenate(cuts)
    return gone[gone < size], cuts[cuts <= size]


def loose_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As words, but words are runs of letters and digits, and in scripts without spaces single characters."""
    return words(data, ends, LOOSE, *_beyond_ascii(data, int(ends[-1])))


def words(data: np.ndarray, ends: np.ndarray, separates: np.ndarray = _SPACE, gone: np.ndarray | None = None, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end of all words of a batch in order, and the number of the first word of each text
    (one more at the end). A word is a run of bytes that do not separate, by default of others than 0x20 and 0x09 to 0x0D;
    A to Z count as a to z. gone are more bytes that separate, cuts more places where a word ends and one begins."""
    size = int(ends[-1])
    space = np.ones(size + 2, bool)
    space[1 : size + 1] = separates[data[:size]]
    cut = np.zeros(size + 1, bool)
    cut[ends] = True
    if gone is not None:
        space[1 + gone] = True
        cut[cuts] = True
    solid = ~space[1:]
    begin = np.flatnonzero(solid[:size] & (space[:size] | cut[:size]))
    end = np.flatnonzero(solid[:size] & (space[2:] | cut[1:])) + 1
    hashes = np.empty(len(begin), np.uint64)
    s = 0
    while s < len(begin):  # as many words as fit a chunk
        at = int(begin[s])
        e = max(s + 1, int(np.searchsorted(end, at + _CHUNK - 1, "right")))
        b, z = begin[s:e] - at, end[s:e] - at
        if z[-1] >= _CHUNK:  # one word longer than a chunk
            hashes[s] = _long(_LOWER[data[at : at + int(z[0])]])
        else:
            total = np.zeros(int(z[-1]) + 1, np.uint64)
            np.cumsum(_LOWER[data[at : at + int(z[-1])]] * _POWERS[: int(z[-1])], dtype=np.uint64, out=total[1:])
            hashes[s:e] = mix((total[z] - total[b]) * _INVERSE[b], (z - b).astype(np.uint64))
        s = e
    return hashes, begin, end, np.searchsorted(begin, ends)


def _long(word: np.ndarray) -> np.uint64:
    total = np.uint64(0)
    for s in range(0, len(word), _CHUNK):
        part = word[s : s + _CHUNK]
        total = mix(np.array([total]), np.array([(part * _POWERS[: len(part)]).sum(dtype=np.uint64)]))[0]
    return mix(np.array([total]), np.array([len(word)], np.uint64))[0]


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row, over the bounds of texts too."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - n + 1]
    for k in range(1, n):
        out = mix(out, hashes[k : len(hashes) - n + 1 + k])
    return out


def shingle_sets(data: np.ndarray, ends: np.ndarray, n: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text. A text of fewer words is one shingle, an empty one has none."""
    hashes, _, _, first = words(data, ends)
    all_grams = grams(hashes, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(all_grams[a : b - n + 1]))
        elif b > a:
            out.append(mix(grams(hashes[a:b], b - a), np.array([b - a], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
