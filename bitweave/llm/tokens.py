"""Tokenizing whole texts with the tokenizers library, each distinct piece once.

Byte-level BPE splits a text before every single space between two characters
that aren't white space, and around a single line end between such characters,
so the ids of a text are the ids of its pieces in order: words with what stands
before them, a space, a line end or the text's start. Pieces are found and
numbered for many texts at once on their bytes, by 64-bit codes; a worker keeps
the ids of the codes it has met, and the library encodes the new ones of a
chunk in one call: pieces of letters as they are after the byte step, where
only a piece's first token holds the space it begins with, and others as texts
with a special token between them. Pieces of one code are compared byte by byte,
and a text with a piece that differs goes to the library whole. So does a text
with other white space or with the name of an added token, which the library
takes for that token. Tokenizers of another kind always do.
"""

from __future__ import annotations

import contextlib
import json
import os
import re

import numpy as np
import pyarrow as pa

from bitweave.llm import common
from bitweave.llm import textcodes as tc

#: Pieces and bytes of pieces that a worker keeps at most, about; then it starts again.
KEEP, KEEP_BYTES, RECENT = 1_500_000, 1 << 25, 100_000
#: New pieces that the library gets in a call, and bytes of texts taken together.
AT_ONCE, CHUNK = 20_000, 1 << 20
_HEAD = "\x01"
#: The name under which a worker keeps its encoder.
KEPT = "encoder"
#: Pieces of letters and a run of marks, which are two words of their own to the tokenizer.
_PLAIN = re.compile(r"^(\x01?)([^\W\d_]+)([.,;:!?)]*)$", re.M)


def vocabulary(path: str) -> str:
    """The tokenizer's JSON, to be sent to the executors."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class Encoder:
    """Texts to little-endian unsigned 32-bit ids."""

    def __init__(self, spec: str, keep: int = KEEP) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        self.keep, self.memo = keep, {}
        self._forget()
        kind = json.loads(spec)
        split, added = kind.get("pre_tokenizer") or {}, kind.get("added_tokens") or []
        self.pieces = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not kind.get("normalizer") and bool(added)
        self.added = [a["content"].encode() for a in added]
        if self.pieces:
            self.mark, self.mark_id = added[0]["content"], added[0]["id"]
            self.words = Tokenizer.from_str(json.dumps(kind | {"pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None, "added_tokens": []}))
            with contextlib.suppress(AttributeError):  # new pieces are never in the model's own cache
                self.words.model._resize_cache(0)
            self.bytes = _byte_letters()
            self.space = self.bytes[32]
            self.bytes[10] = " "  # parts the words
            self.begins = np.zeros(max(kind["model"]["vocab"].values()) + 1, dtype=bool)
            self.begins[[k for t, k in kind["model"]["vocab"].items() if t.startswith(self.space)]] = True

    def _ids(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _words(self, text: str) -> np.ndarray:
        """Ids of words parted by line feeds."""
        return np.array(self.words.encode_batch_fast([text.encode().decode("latin-1").translate(self.bytes)], add_special_tokens=False)[0].ids, dtype="<u4")

    def _keep(self, pieces: list[str], ids: np.ndarray, begins: np.ndarray, skip: int) -> None:
        """Ids from one begin to the next, after `skip` ids, are a piece's."""
        raw, ends = ids.tobytes(), [*(begins[1:] * 4).tolist(), len(ids) * 4]
        for piece, a, b in zip(pieces, (begins * 4).tolist(), ends, strict=True):
            self.memo[piece] = raw[a + 4 * skip : b]

    def _learn(self, new: set[str]) -> None:
        """Encode new pieces, many in one call."""
        if "\n" in new:
            new.discard("\n")
            self.memo["\n"] = self._ids("\n")
        found = _PLAIN.findall("\n".join(new))
        letters = "".join([w for _, w, _ in found])
        if letters and not (letters.isalpha() and max(letters) < "\u0250"):
            found = [f for f in found if f[1].isalpha() and max(f[1]) < "\u0250"]
        split = lambda rows: [f"{w}\n{m}" if m else w for _, w, m in rows]
        own = [f for f in found if not f[0]]
        at_head = [f for f in found if f[0]]
        plain, heads = [w + m for _, w, m in own], [h + w + m for h, w, m in at_head]
        inner, first = split(own), split(at_head)
        other, texts = [], []
        for piece in new.difference(plain, heads):
            bare = piece[1:] if piece[:1] == _HEAD else piece
            if bare and not bare[0].isspace() and not bare[-1].isspace() and self.mark not in bare and _HEAD not in bare:
                other.append(piece)
                texts.append(bare if piece[:1] == _HEAD else f" {bare}")
        if plain:
            ids = self._words(" " + "\n ".join(inner))
            self._keep(plain, ids, np.flatnonzero(self.begins[ids]), 0)
        if heads:  # a space alone before each
            ids = self._words(" \n" + "\n \n".join(first))
            self._keep(heads, ids, np.flatnonzero(self.begins[ids]), 1)
        if other:
            ids = np.array(self.whole.encode_batch_fast([self.mark + self.mark.join(texts)], add_special_tokens=False)[0].ids, dtype="<u4")
            self._keep(other, ids, np.flatnonzero(ids == self.mark_id), 1)

    def _forget(self) -> None:
        none = np.zeros(0, dtype=np.int64)
        # known codes in order with the numbers of their pieces: all, and the latest
        self.known = [(none.view(np.uint64), none.astype(np.int32))] * 2
        # of each piece: where its ids and its bytes begin, how many they are, and what stands before it
        self.rows = np.zeros((1 << 12, 5), dtype=np.int32)
        self.pool, self.bytes_pool = np.zeros(1 << 16, dtype="<u4"), np.zeros(1 << 16, dtype=np.uint8)
        self.n = self.used = self.used_bytes = 0

    def _add(self, codes: np.ndarray, ids: list[bytes], raw: np.ndarray, at: np.ndarray, size: np.ndarray, kind: np.ndarray) -> None:
        """Keep new pieces: their codes in order, ids, and bytes given by places in raw."""
        new, lens = np.frombuffer(b"".join(ids), "<u4"), np.array([len(i) // 4 for i in ids], dtype=np.int64)
        own = raw[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        self.pool = _room(self.pool, self.used + len(new))
        self.bytes_pool = _room(self.bytes_pool, self.used_bytes + len(own) + 8)
        self.rows = _room(self.rows, self.n + len(codes))
        self.pool[self.used : self.used + len(new)] = new
        self.bytes_pool[self.used_bytes : self.used_bytes + len(own)] = own
        self.rows[self.n : self.n + len(codes)] = np.stack([self.used + np.cumsum(lens) - lens, lens, self.used_bytes + np.cumsum(size) - size, size, kind], axis=1)

        def merged(a, b):
            keys, number = (np.concatenate(x) for x in zip(a, b, strict=True))
            order = np.argsort(keys, kind="stable")
            return keys[order], number[order]

        self.known[1] = merged(self.known[1], (codes, np.arange(self.n, self.n + len(codes), dtype=np.int32)))
        self.n, self.used, self.used_bytes = self.n + len(codes), self.used + len(new), self.used_bytes + len(own)
        if len(self.known[1][0]) > RECENT:
            self.known = [merged(*self.known), tuple(x[:0] for x in self.known[1])]

    def _find(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of the pieces of known codes; -1 for unknown ones."""
        out = np.full(len(codes), -1, np.int64)
        for keys, number in self.known:
            if len(keys):
                k = np.searchsorted(keys, codes)
                k[k == len(keys)] = 0
                hit = keys[k] == codes
                out[hit] = number[k[hit]]
        return out

    def chunk(self, raw: np.ndarray, at: np.ndarray, odd: np.ndarray | None = None) -> list[bytes]:
        """The ids of each text of a chunk, given as UTF-8 bytes and offsets; odd: texts to take whole."""
        whole = lambda k: self._ids(raw[at[k] : at[k + 1]].tobytes().decode())
        n = len(at) - 1
        if not self.pieces:
            return [whole(k) for k in range(n)]
        if self.n > self.keep or self.used_bytes > KEEP_BYTES:
            self._forget()
        odd = _odd_texts(raw, at, self.added) if odd is None else odd
        starts, stops, first = tc.word_spans(raw, at, tc.NONSPACE)
        before = raw[np.maximum(starts - 1, 0)]
        kind = np.where(before == 10, 2, 0)
        kind[np.searchsorted(starts, at[:-1][np.diff(first) > 0])] = 1
        codes = tc.mix(self._codes(raw, starts, stops) + kind.astype(np.uint64))
        owner = tc.owners(first)
        keep = ~odd[owner]
        starts, size, kind, codes, owner = starts[keep], (stops - starts)[keep], kind[keep], codes[keep], owner[keep]
        unique, where, inverse = np.unique(codes, return_index=True, return_inverse=True)
        number, same = where[inverse], self._find(unique)
        # a code stands for one piece: all its occurrences are compared with the first one, and that with the piece kept
        differ = ~tc.equal_words(raw, starts, size, raw, starts[number], size[number]) | (kind != kind[number])
        old = np.flatnonzero(same >= 0)
        rows = self.rows[same[old]].astype(np.int64)
        fine = tc.equal_words(raw, starts[where[old]], size[where[old]], self.bytes_pool, rows[:, 2], rows[:, 3], True) & (kind[where[old]] == rows[:, 4])
        if not fine.all():
            other = np.zeros(len(unique), dtype=bool)
            other[old[~fine]] = True
            differ |= other[inverse]
        if differ.any():
            odd[owner[differ]] = True
            return self.chunk(raw, at, odd)
        new = np.flatnonzero(same < 0)
        if len(new):
            w = where[new]
            pieces = [(_HEAD if k else "") + raw[a : a + b].tobytes().decode() for a, b, k in zip(starts[w].tolist(), size[w].tolist(), (kind[w] > 0).tolist(), strict=True)]
            self.memo.clear()
            for k in range(0, len(pieces), AT_ONCE):
                self._learn(set(pieces[k : k + AT_ONCE]))
            line = self.memo.get("\n") or self._ids("\n")
            found = [self.memo.get(p) or self._ids(p[1:] if p[0] == _HEAD else f" {p}") for p in pieces]
            self._add(unique[new], [line + f if k == 2 else f for f, k in zip(found, kind[w].tolist(), strict=True)], raw, starts[w], size[w], kind[w])
            same = self._find(unique)
            self.memo.clear()
        begin, lens = (self.rows[same, k].astype(np.int64)[inverse] for k in range(2))
        ids = self.pool[np.repeat(begin - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())].tobytes()
        pieces_of = np.where(odd, 0, np.diff(first))
        ends = np.concatenate([[0], np.cumsum(lens)])[np.cumsum(pieces_of)] * 4
        out, a = [], 0
        for k, b in enumerate(ends.tolist()):
            out.append(whole(k) if odd[k] else ids[a:b])
            a = b
        return out

    _codes = staticmethod(tc.word_codes)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null is the empty text."""
        return self.chunk(*tc.utf8(pa.array(texts, pa.large_string())))


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """a, with space for n rows at least."""
    while len(a) < n:
        a = np.concatenate([a, np.zeros_like(a)])
    return a


def _odd_texts(raw: np.ndarray, at: np.ndarray, names: list[bytes]) -> np.ndarray:
    """Texts with white space that is not a single space or line end between other characters, with the mark used here, or with one of the names."""
    odd = np.zeros(len(at) - 1, dtype=bool)
    if not len(raw):
        return odd
    space = ~tc.NONSPACE[raw]
    bad = space & (raw != 32) & (raw != 10) | (raw == 1)
    bad[1:] |= space[1:] & space[:-1]
    edges = np.concatenate([at[:-1], at[1:] - 1])[np.tile(np.diff(at) > 0, 2)]
    bad[edges] |= space[edges]
    # white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000
    lead = np.flatnonzero((raw == 0xC2) | (raw == 0xE1) | (raw == 0xE2) | (raw == 0xE3))
    if len(lead):
        a = raw[lead]
        b, c = raw[np.minimum(lead + 1, len(raw) - 1)], raw[np.minimum(lead + 2, len(raw) - 1)]
        wide = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        wide |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (a == 0xE2) & (b == 0x81) & (c == 0x9F)
        bad[lead[wide]] = True
    data = raw.tobytes()
    for name in names:
        k = data.find(name)
        while k >= 0:
            bad[k] = True
            k = data.find(name, k + 1)
    odd[np.searchsorted(at, np.flatnonzero(bad), side="right") - 1] = True
    return odd


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself if it can be seen, else one from 256 on."""
    seen = {b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in seen else next(hidden)) for b in range(256)}


def encoder(spec: str, keep: int = KEEP) -> Encoder:
    """One encoder for each worker and tokenizer, kept between the tasks that encode (lean with keep=KEPT)."""
    made = common.kept.setdefault(KEPT, {})
    key = hash(spec), keep
    if key not in made:
        made.clear()
        made[key] = Encoder(spec, keep)
    return made[key]


def encoded(texts: pa.Array, spec: str, end_id: int | None, size: int = CHUNK, keep: int = KEEP):
    """Yield the ids of each text of a string array with the end id, about size bytes at a time; null is empty.

    A worker keeps the ids of about `keep` pieces; fewer take less memory and more time.
    """
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
    codec = encoder(spec, keep)
    for _, _, raw, at in tc.chunks(texts, size):
        for ids in codec.chunk(raw, at):
            yield ids + end
