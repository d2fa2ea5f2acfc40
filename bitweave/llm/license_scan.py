"""License notices in whole texts: exact phrases, and short notices with a few errors.

A notice with at most k errors is split into k + 1 pieces. By the pigeonhole
principle one of them occurs unchanged wherever the notice does, so exact
searches for the pieces give all candidate places. There the regex library
matches the whole notice with bounded errors and reports the span.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitweave.llm import textcodes as tc
from bitweave.llm.common import bounded_batches, lean

#: Phrases of whole words, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices in lower case, and their labels.
NOTICES = {
    "all rights reserved": "reserved",
    "apache license, version 2.0": "apache",
    "apache software license": "apache",
    "attribution-noncommercial": "cc-by-nc",
    "attribution-noderivs": "cc-by-nd",
    "attribution-sharealike": "cc-by-sa",
    "boost software license": "bsl",
    "cc0 1.0 universal": "cc0",
    "common development and distribution license": "cddl",
    "creative commons attribution": "cc-by",
    "dedicated to the public domain": "public-domain",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "free documentation license": "gfdl",
    "gnu affero general public license": "agpl",
    "gnu general public license": "gpl",
    "lesser general public license": "lgpl",
    "licensed under a creative commons": "cc",
    "licensed under cc by-nc": "cc-by-nc",
    "licensed under cc by-sa": "cc-by-sa",
    "licensed under the apache license": "apache",
    "licensed under the bsd license": "bsd",
    "licensed under the mit license": "mit",
    "microsoft public license": "ms-pl",
    "mozilla public license": "mpl",
    "open database license": "odbl",
    "permission is hereby granted, free of charge": "mit",
    "permission to use, copy, modify, and/or distribute this software": "isc",
    "python software foundation license": "psf",
    "redistribution and use in source and binary forms": "bsd",
    "released into the public domain": "public-domain",
    "released under the bsd license": "bsd",
    "released under the mit license": "mit",
    "sil open font license": "ofl",
    "spdx-license-identifier:": "spdx",
    "the mit license (mit)": "mit",
    "this is free and unencumbered software": "unlicense",
    "used with permission": "permission",
}
#: A notice may have one error for so many characters, and so many at most.
CHARS_PER_ERROR, MOST_ERRORS = 9, 3

SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("score", T.DoubleType())])


def lower_ascii(text: str) -> str:
    """A-Z in lower case; all other characters stay, so places do."""
    return text.translate(_FOLD)


_FOLD = {c: c + 32 for c in range(65, 91)}


class Notices:
    """Compiled notices with the pieces that locate them."""

    def __init__(self, notices: dict[str, str], per_error: int = CHARS_PER_ERROR, most: int = MOST_ERRORS) -> None:
        import regex

        self.all, self.seeds = [], {}
        for notice, label in notices.items():
            k = min(most, len(notice) // per_error)
            pattern = regex.compile(f"(?:{regex.escape(notice)}){{e<={k}}}", regex.BESTMATCH)
            self.all.append((notice, label, k, pattern))
            cuts = [round(i * len(notice) / (k + 1)) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                self.seeds.setdefault(notice[a:b], []).append((len(self.all) - 1, a))

    def spans(self, low: str) -> list[tuple[str, int, int, int, float]]:
        """(label, start, end, edits, score) of all notices; of spans that overlap, those with fewer edits."""
        windows: set[tuple[int, int, int]] = set()
        for seed, uses in self.seeds.items():
            p = low.find(seed)
            while p >= 0:
                for n, at in uses:
                    notice, _, k, _ = self.all[n]
                    windows.add((n, max(0, p - at - k), min(len(low), p - at + len(notice) + k)))
                p = low.find(seed, p + 1)
        found = set()
        for n, a, b in windows:  # a window is too short for two places of a notice
            notice, label, k, pattern = self.all[n]
            if b - a >= len(notice) - k and (m := pattern.search(low, a, b)):
                edits = sum(m.fuzzy_counts)
                found.add((label, m.start(), m.end(), edits, 1 - edits / len(notice)))
        return sorted(_plain(_clear(found)), key=lambda s: (s[1], s[2], s[0]))


def _clear(found: Iterable[tuple]) -> list[tuple]:
    """Spans of a label that don't overlap, those with fewer edits first, then the earlier ones.

    The spans kept so far never overlap, so in the order of their starts only
    a span's two neighbours can touch it.
    """
    out: list = []
    kept: dict[str, list[tuple[int, int]]] = {}
    for s in sorted(found, key=lambda s: (s[0], s[3], s[1], s[2])):
        own = kept.setdefault(s[0], [])
        k = bisect_left(own, (s[1], s[2]))
        if (k == len(own) or own[k][0] >= s[2]) and (not k or own[k - 1][1] <= s[1]):
            own.insert(k, (s[1], s[2]))
            out.append(s)
    return out


def _plain(spans: list[tuple]) -> list[tuple]:
    """Spans without those that another label's span with fewer edits has half of: one notice has one label.

    Spans are short, so few stand before a span and reach into it.
    """
    spans = sorted(spans, key=lambda s: (s[1], s[2]))
    most = max((s[2] - s[1] for s in spans), default=0)
    begin, out = 0, []
    for s in spans:
        while spans[begin][1] + most <= s[1]:
            begin += 1
        worse, k = False, begin
        while not worse and k < len(spans) and spans[k][1] < s[2]:
            o = spans[k]
            worse = o[3] < s[3] and 2 * (min(s[2], o[2]) - max(s[1], o[1])) >= s[2] - s[1]
            k += 1
        if not worse:
            out.append(s)
    return out


def _places(phrases: list[tuple[list[bytes], np.ndarray]], low, starts, stops, first, codes):
    """For each phrase the first words of its places in a chunk; none crosses a text's end."""
    text = tc.owners(first)
    for words, known in phrases:
        n = len(words)
        at = np.flatnonzero(codes[: max(0, len(codes) - n + 1)] == known[0])
        for k in range(1, n):
            at = at[codes[at + k] == known[k]]
        at = at[text[at] == text[at + n - 1]] if len(at) else at
        yield np.array([i for i in at if all(low[starts[i + k] : stops[i + k]].tobytes() == words[k] for k in range(n))], dtype=np.int64)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """License phrases and notices of each text.

    Returns the id column, n_words, n_base (places of the exact phrases),
    first_word and last_word (their smallest and largest start, in words; null
    without any), base_labels and labels (distinct, ascending), spans (label,
    start, end, edits and score of each notice, in characters) and score (1 for
    an exact phrase, else the best span's share of unchanged characters, else 0).
    Null text is empty. Each row is scanned by itself: repeated rows give
    repeated results and an empty table gives none. Other columns are not read.
    Nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)
    phrases = PHRASES if phrases is None else phrases
    notices = NOTICES if notices is None else notices
    base = [([w.encode() for w in p.split(" ")], np.array([tc.code_of(w) for w in p.split(" ")], dtype=np.uint64)) for p in phrases]
    labels = list(phrases.values())

    def run(batches):
        fuzzy = Notices(notices)
        for batch in batches:
            n = batch.num_rows
            words, places, own = np.zeros(n, np.int64), [[] for _ in range(n)], [set() for _ in range(n)]
            for i, _, raw, at in tc.chunks(batch.column(1)):
                low, starts, stops, first, codes = tc.words(raw, at)
                words[i : i + len(at) - 1] = np.diff(first)
                for label, found in zip(labels, _places(base, low, starts, stops, first, codes), strict=True):
                    for t, w in zip((np.searchsorted(first, found, side="right") - 1).tolist(), found.tolist(), strict=True):
                        places[i + t].append(w - int(first[t]))
                        own[i + t].add(label)
            spans = [fuzzy.spans(lower_ascii(t)) if t else [] for t in batch.column(1).to_pylist()]
            every = [sorted(o | {s[0] for s in x}) for o, x in zip(own, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(words), pa.array([len(p) for p in places], pa.int64()), pa.array([min(p, default=None) for p in places], pa.int64()), pa.array([max(p, default=None) for p in places], pa.int64()),
                pa.array([sorted(o) for o in own], pa.list_(pa.string())), pa.array(every, pa.list_(pa.string())),
                pa.array([[dict(zip(("label", "start", "end", "edits", "score"), s, strict=True)) for s in x] for x in spans], pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("score", pa.float64())]))),
                pa.array([1.0 if p else max((s[4] for s in x), default=0.0) for p, x in zip(places, spans, strict=True)], pa.float64()),
            ], names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "spans", "score"])

    docs = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    strings = T.ArrayType(T.StringType())
    fields = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", strings), ("labels", strings), ("spans", T.ArrayType(SPAN)), ("score", T.DoubleType())]
    return docs.mapInArrow(lean(run), T.StructType([docs.schema[0], *(T.StructField(*f) for f in fields)]))
