"""Words of whole texts as 64-bit codes, taken from Arrow buffers with numpy.

All functions work on the UTF-8 bytes of many texts at once, so no Python
object is made for a word. A chunk is a run of rows whose texts together have
a bounded number of bytes (one longer text is a chunk of its own), which bounds
memory whatever the batch size is.

A word's code is the sum, modulo 2**64, of a random value for each of its bytes
at its place, taken from prefix sums and mixed. Unlike a polynomial modulo a
power of two it has no pairs of words that collide by their pattern; among V
words about V**2 / 2**65 pairs collide by chance. Callers that need exact words
compare bytes as well (equal_words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_P = 0x9E3779B97F4A7C15
#: Places in a word whose values are kept in a table.
_PLACES = 64
#: A-Z to a-z on bytes; bytes of other characters stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of words [^\x20\x09-\x0D]+.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[9:14] = NONSPACE[32] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit codes that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is the empty text."""
    if array.null_count:
        array = array.fill_null("")
    if pa.types.is_string(array.type):
        kind = np.int32
    else:
        array, kind = array.cast(pa.large_string()), np.int64
    _, offsets, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(array: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) over all rows."""
    raw, at = utf8(array)
    i, n = 0, len(array)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_spans(low: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the total after them); no word crosses a text's end."""
    n = len(low)
    inside = kind[low]
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = at[:-1][at[:-1] < n]
        begins[edges] = inside[edges]
        edges = at[1:][at[1:] > 0] - 1
        ends[edges] = inside[edges]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, at)


def _values(key: np.ndarray, salt: int) -> np.ndarray:
    """Random values of places and bytes, given as place * 256 + byte."""
    return mix((key.astype(np.uint64) + np.uint64(1)) * np.uint64(_P) + np.uint64(salt * 0xD1342543DE82EF95 % (1 << 64)))


_tables: dict[int, np.ndarray] = {}


def word_codes(low: np.ndarray, starts: np.ndarray, stops: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit code for each word; another salt gives independent codes."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    if salt not in _tables:
        _tables[salt] = _values(np.arange(_PLACES << 8), salt)
    begin = int(starts[0])
    place = np.arange(begin, len(low))
    place -= np.repeat(starts, np.diff(starts, append=len(low)))
    far = np.flatnonzero(place >= _PLACES)
    key = place << 8 | low[begin:]
    values = _tables[salt].take(key, mode="clip")
    if len(far):
        values[far] = _values(key[far], salt)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    return mix(total[stops - begin] - total[starts - begin])


def _eights(raw: np.ndarray, padded: bool) -> np.ndarray:
    """The eight bytes from each place on, as one number; beyond the end there are zeros, or what raw was padded with."""
    raw = raw if padded else np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray(len(raw) - 7, dtype="<u8", buffer=raw, strides=(1,))


def equal_words(a: np.ndarray, a_at: np.ndarray, a_n: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_n: np.ndarray, b_padded: bool = False) -> np.ndarray:
    """For each pair of words, given by bytes, places and lengths, whether all bytes are equal.

    b_padded: b has eight bytes or more behind its last word, so it isn't copied.
    """
    out = a_n == b_n
    x = _eights(a, False)
    y = x if b is a else _eights(b, b_padded)
    left, done = np.flatnonzero(out), 0
    while len(left) and done < _PLACES:
        short = np.minimum(a_n[left] - done, 8)
        drop = ((8 - short) * 8).astype(np.uint64)
        same = (x[a_at[left] + done] ^ y[b_at[left] + done]) << drop == 0
        out[left[~same]] = False
        left = left[same & (short == 8) & (a_n[left] > done + 8)]
        done += 8
    for k in left.tolist():
        out[k] = np.array_equal(a[a_at[k] + done : a_at[k] + a_n[k]], b[b_at[k] + done : b_at[k] + b_n[k]])
    return out


def words(raw: np.ndarray, at: np.ndarray, kind: np.ndarray = ALNUM):
    """(lower-cased bytes, starts, ends, first word of each text, codes) of a chunk."""
    low = LOWER[raw]
    starts, stops, first = word_spans(low, at, kind)
    return low, starts, stops, first, word_codes(low, starts, stops)


def code_of(word: str | bytes) -> int:
    """The code of one word given in lower case."""
    raw = np.frombuffer(word.encode() if isinstance(word, str) else word, np.uint8)
    return int(word_codes(raw, np.array([0]), np.array([len(raw)]))[0])


def ngram_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """Codes of all runs of n words of the whole array; the caller drops those across texts."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(codes) - n + 1, dtype=np.uint64)
    for k in range(n):
        out *= np.uint64(_P)
        out += codes[k : len(codes) - n + 1 + k]
    return mix(out)


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each word, from the first word of each text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
