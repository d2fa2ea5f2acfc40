"""Language-model scores by deleted interpolation of n-gram estimates.

The probability of a token is a mixture of its maximum-likelihood estimates
after the previous token and on its own, and a uniform share for unknown ones:

    P(w | h) = a2 c(h w) / c(h)  +  a1 c(w) / N  +  a0 / (V + 1)

The weights depend on how often the context h was seen, by powers of two. They
are learned by expectation-maximisation on a held-out slice of the training
documents, with estimates from which that slice's counts are deleted; the final
estimates count all training documents.

Counts grow with the corpus, so no node holds them all. The documents are first
written as files; a stretch of a file (a bounded number of tokens) is a
requester. Each requester sends its distinct n-grams, with its own training
counts, to the n-grams' hash buckets. A bucket adds up and answers with the
counts in the order of the request, so an answer holds no keys. A requester
then reads its answers and looks its own tokens up. A very common n-gram is
sent at most once by each requester. An n-gram is known by a 64-bit code: among
V distinct ones about V**2 / 2**65 pairs share a code and their counts by chance.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitweave.llm import textcodes as tc
from bitweave.llm.common import bounded_batches, lean, open_fs, scratch, tasks_of

#: Tokens of a requester; texts are never split, so one very long text may exceed it.
STRETCH = 2_000_000
ORDERS = 2
#: Codes of the begin mark (context of first tokens) and of the end token.
BEGIN, END = np.uint64(1), np.uint64(2)
#: Context-frequency buckets: 0, 1, 2-3, 4-7, ...
BUCKETS = 48
#: Held-out counts are gathered in bins of log10 of the estimates' ratio, this many to a unit.
FINE = 32
SPAN = 24


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys as byte planes of their differences, which compress well."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Unsigned counts as byte planes, without the planes above the largest."""
    width = max(1, (int(counts.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]).tobytes()


def unpack_counts(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((8, planes.shape[1]), np.uint8)
    out[:width] = planes
    return np.ascontiguousarray(out.T).view("<u8").ravel().astype(np.int64)


class Stretch:
    """The tokens of consecutive documents: each word, then one end token for each document."""

    def __init__(self, codes: list[np.ndarray], lens: list[np.ndarray], train: np.ndarray, held: np.ndarray) -> None:
        self.codes, lens = np.concatenate(codes), np.concatenate(lens)
        self.lens, self.train, self.held = lens, train, held
        self.first = np.concatenate([[0], np.cumsum(lens)])
        before = np.empty_like(self.codes)
        before[1:] = self.codes[:-1]
        before[self.first[:-1]] = BEGIN
        self.grams = (self.codes, tc.mix(before * np.uint64(0x9E3779B97F4A7C15) + self.codes))

    def distinct(self, order: int):
        """(distinct keys, index of each token's key)."""
        return np.unique(self.grams[order], return_inverse=True)

    def spread(self, flags: np.ndarray) -> np.ndarray:
        return np.repeat(flags, self.lens)


def _stretches(batches, size: int):
    """(part, number of the stretch, columns of its rows, Stretch) in the order of the rows.

    A stretch ends with the document that fills it, or with its part, so the
    same file always gives the same stretches however it is batched.
    """
    part = number = None
    codes, lens, rows, n = [], [], [], 0

    def close():
        nonlocal codes, lens, rows, n
        table = pa.Table.from_batches(rows).combine_chunks()
        out = part, number, table, Stretch(codes, lens, table.column("train").to_numpy(), table.column("held").to_numpy())
        codes, lens, rows, n = [], [], [], 0
        return out

    for batch in batches:
        parts = batch.column(batch.schema.get_field_index("part")).to_numpy()
        light = batch.drop_columns(["text"])
        for i, j, raw, at in tc.chunks(batch.column(batch.schema.get_field_index("text"))):
            _, starts, _, first, words = tc.words(raw, at, tc.NONSPACE)
            count = np.diff(first)
            own = np.insert(words, first[1:], END)  # after each document's last word
            edge = np.concatenate([[0], np.cumsum(count + 1)])
            k = i
            while k < j:
                if parts[k] != part:
                    if rows:
                        yield close()
                    part, number = parts[k], 0
                stop = k + int(np.argmax(np.append(parts[k:j] != part, True)))
                full = int(np.searchsorted(edge, edge[k - i] + size - n, side="left"))
                stop = min(stop, i + max(full, k - i + 1))
                codes.append(own[edge[k - i] : edge[stop - i]])
                lens.append(count[k - i : stop - i] + 1)
                rows.append(light.slice(k, stop - k))
                n += len(codes[-1])
                k = stop
                if n >= size:
                    yield close()
                    number += 1
    if rows:
        yield close()


def _borders(buckets: int) -> np.ndarray:
    """First key of each bucket but the first: buckets are ranges of keys, so sorted keys lie in runs."""
    return np.array([(1 << 64) * b // buckets for b in range(1, buckets)], dtype=np.uint64)


class Counts:
    """What the buckets answered to one stretch, in the order of its distinct keys."""

    def __init__(self, files, folder: str, number: int) -> None:
        import pyarrow.dataset as ds

        got = ds.dataset(folder, filesystem=files, format="parquet").to_table(filter=ds.field("number") == number)
        rows = sorted(zip(*(got.column(c).to_pylist() for c in ("n_order", "bucket", "every", "held")), strict=True), key=lambda r: r[:2])
        self.every = [self._joined(r[2] for r in rows if r[0] == k) for k in range(ORDERS)]
        self.held = [self._joined(r[3] for r in rows if r[0] == k) for k in range(ORDERS)]

    @staticmethod
    def _joined(blobs) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *map(unpack_counts, blobs)])


class Estimates:
    """Maximum-likelihood estimates of a stretch's tokens."""

    def __init__(self, s: Stretch, one: np.ndarray, two: np.ndarray, begins: int, total: int, kinds: int) -> None:
        context = np.empty_like(one)
        context[1:] = one[:-1]
        context[s.first[:-1]] = begins
        self.bucket = np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.p2 = np.where(context > 0, two / np.maximum(context, 1), 0.0)
        self.p1 = one / max(total, 1)
        self.p0 = 1.0 / (kinds + 1)


def _bins(e: Estimates, keep: np.ndarray) -> np.ndarray:
    """Bins of (context bucket, p2 / p0, p1 / p0) of the kept tokens; 0 stands for an estimate of 0."""
    def fine(p: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            x = np.round(np.log10(p / e.p0) * FINE)
        return np.where(p > 0, np.clip(x, -SPAN * FINE + 1, SPAN * FINE) + SPAN * FINE, 0).astype(np.int64)

    wide = 2 * SPAN * FINE + 1
    return (e.bucket[keep] * wide + fine(e.p2[keep])) * wide + fine(e.p1[keep])


def learn_weights(bins: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Mixture weights (a2, a1, a0) of each context bucket by expectation-maximisation.

    A bucket without held-out tokens takes those of the nearest lower one that
    has some. Unknown tokens keep a share: a0 is at least 1e-6.
    """
    wide = 2 * SPAN * FINE + 1
    bucket, two, one = bins // (wide * wide), bins // wide % wide, bins % wide
    value = lambda k: np.where(k > 0, 10.0 ** ((k - SPAN * FINE) / FINE), 0.0)
    p = np.stack([value(two), value(one), np.ones(len(bins))], axis=1)
    weights = np.tile(np.array([0.0, 0.9, 0.1]), (BUCKETS, 1))
    last = np.array([0.4, 0.5, 0.1])
    for b in range(BUCKETS):
        own = bucket == b
        start = np.array([0.0, 0.9, 0.1]) if b == 0 else last
        w = start / start.sum()
        if own.any():
            q, n = p[own], counts[own].astype(float)
            for _ in range(rounds):
                share = q * w
                share *= (n / share.sum(axis=1))[:, None]
                new = np.maximum(share.sum(axis=0) / n.sum(), [0.0, 1e-6, 1e-6])
                new /= new.sum()
                done = np.abs(new - w).max() < 1e-9
                w = new
                if done:
                    break
            if b:
                last = np.maximum(w, 1e-6)
        weights[b] = w
    return weights


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out=None, tune=None, add: float = 0.1, stretch: int = STRETCH) -> DataFrame:
    """Score whole texts with a model learned from those that aren't held out.

    held_out: a condition on docs, of the documents to learn nothing from
    (default: none). tune: of the others, those on which the weights are
    learned (default: by a hash of the id, one in eight). A token is a run of
    characters other than white space, lower-cased A-Z, and every document ends
    with an end token. Null texts are empty, with the end token alone.

    Returns the id column, held_out, n_tokens, n_known (tokens seen in
    training), train_tokens, base_score (log10 of the additively smoothed
    unigram probability) and score (log10 of the interpolated probability).
    Rows with equal or null ids are scored one by one. Without training
    documents all tokens are unknown. Empty tables give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    held_out = F.lit(False) if held_out is None else held_out
    tune = F.pmod(F.xxhash64(F.col(id_col)), F.lit(8)) == 0 if tune is None else tune
    folder = scratch(spark, "lm")
    flags = (~F.coalesce(held_out, F.lit(False))).alias("train"), F.coalesce(tune, F.lit(False)).alias("held")
    # one row group for each file, so a file is one requester and never split
    docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *flags).write.options(**{"parquet.block.size": 1 << 30, "compression": "zstd"}).parquet(f"{folder}/docs")
    read = spark.read.parquet(f"{folder}/docs").select("id", F.coalesce("text", F.lit("")).alias("text"), "train", (F.col("held") & F.col("train")).alias("held"), F.xxhash64(F.input_file_name()).alias("part"))
    buckets = max(tasks_of(spark), read.rdd.getNumPartitions())
    borders = _borders(buckets)

    def ask(batches):
        for part, number, _, s in _stretches(batches, stretch):
            train, held = s.spread(s.train), s.spread(s.held)
            for order in range(ORDERS):
                keys, inverse = s.distinct(order)
                every = np.bincount(inverse[train], minlength=len(keys))
                kept = np.bincount(inverse[held], minlength=len(keys))
                cut = np.concatenate([[0], np.searchsorted(keys, borders), [len(keys)]])
                rows = [(b, cut[b], cut[b + 1]) for b in range(buckets) if cut[b] < cut[b + 1]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([b for b, _, _ in rows], pa.int32()), pa.array([part] * len(rows), pa.int64()), pa.array([number] * len(rows), pa.int32()), pa.array([order] * len(rows), pa.int32()),
                    pa.array([pack_keys(keys[x:y]) for _, x, y in rows], pa.binary()), pa.array([pack_counts(every[x:y]) for _, x, y in rows], pa.binary()), pa.array([pack_counts(kept[x:y]) for _, x, y in rows], pa.binary()),
                ], names=["bucket", "part", "number", "n_order", "keys", "every", "held"])

    def answer(batches):
        names = ["part", "number", "n_order", "bucket", "every", "held"]
        run, group = [], None

        def add_up():
            keys = [unpack_keys(r["keys"]) for r in run]
            known, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            sums = [np.zeros(len(known), np.int64) for _ in range(2)]
            at = 0
            for r, k in zip(run, keys, strict=True):
                own = inverse[at : at + len(k)]
                sums[0][own] += unpack_counts(r["every"])
                sums[1][own] += unpack_counts(r["held"])
                at += len(k)
            at = 0
            for r, k in zip(run, keys, strict=True):
                own = inverse[at : at + len(k)]
                yield r["part"], r["number"], group[1], group[0], pack_counts(sums[0][own]), pack_counts(sums[1][own])
                at += len(k)
            # the model's totals, as a row of no part: tokens, kinds, held-out tokens, kinds without those, ends, held-out ends
            if group[1] == 0:
                end = np.flatnonzero(known == END)
                whole = [sums[0].sum(), (sums[0] > 0).sum(), sums[1].sum(), (sums[0] > sums[1]).sum(), sums[0][end].sum(), sums[1][end].sum()]
                yield None, 0, -1, group[0], pack_counts(np.array(whole)), b""

        def flush():
            if run:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*add_up(), strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=names)

        for batch in batches:
            for r in batch.to_pylist():
                if (r["bucket"], r["n_order"]) != group:
                    yield from flush()
                    run, group = [], (r["bucket"], r["n_order"])
                run.append(r)
        yield from flush()

    asked = read.mapInArrow(lean(ask), "bucket int, part long, number int, n_order int, keys binary, every binary, held binary")
    answers = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", "n_order").mapInArrow(lean(answer), "part long, number int, n_order int, bucket int, every binary, held binary")
    # a stretch's answers go together; the totals, a row of each bucket, are spread by it
    dealt = answers.repartition(buckets, F.coalesce("part", F.xxhash64("bucket")), "number").sortWithinPartitions("part")
    dealt.write.partitionBy("part").parquet(f"{folder}/counts")
    totals = np.zeros(6, dtype=np.int64)
    for r in spark.read.schema("number int, n_order int, bucket int, every binary, part string").parquet(f"{folder}/counts").where("n_order = -1").select("every").toLocalIterator():
        totals += unpack_counts(r["every"])  # one row for each bucket
    tokens, kinds, held_tokens, kept_kinds, ends, held_ends = map(int, totals)

    def counted(batches):
        for part, number, rows, s in _stretches(batches, stretch):
            files, at = open_fs(f"{folder}/counts/part={part}")
            yield rows, s, Counts(files, at, number)

    def tuned(batches):
        found: dict[int, int] = {}
        for _, s, c in counted(batches):
            if not s.held.any():
                continue
            one, two = ((c.every[k] - c.held[k])[s.distinct(k)[1]] for k in range(ORDERS))
            e = Estimates(s, one, two, ends - held_ends, tokens - held_tokens, kept_kinds)
            bins, n = np.unique(_bins(e, s.spread(s.held)), return_counts=True)
            for b, x in zip(bins.tolist(), n.tolist(), strict=True):
                found[b] = found.get(b, 0) + x
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["bin", "n"])

    # the number of bins is bounded, whatever the corpus
    bins = read.mapInArrow(lean(tuned), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    weights = learn_weights(bins["bin"].to_numpy(np.int64), bins["n"].to_numpy(np.int64))

    def scored(batches):
        for rows, s, c in counted(batches):
            one, two = (c.every[k][s.distinct(k)[1]] for k in range(ORDERS))
            e = Estimates(s, one, two, ends, tokens, kinds)
            w = weights[np.minimum(e.bucket, BUCKETS - 1)]
            p = w[:, 0] * e.p2 + w[:, 1] * e.p1 + w[:, 2] * e.p0
            base = np.log10((one + add) / (tokens + add * (kinds + 1)))
            total = lambda x: np.add.reduceat(x, s.first[:-1])
            n = len(s.lens)
            yield pa.RecordBatch.from_arrays([rows.column("id").combine_chunks() if rows.column("id").num_chunks != 1 else rows.column("id").chunk(0), pa.array(~s.train), pa.array(s.lens), pa.array(total((one > 0).astype(np.int64))), pa.array(np.full(n, tokens)), pa.array(total(base)), pa.array(total(np.log10(p)))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return read.mapInArrow(lean(scored), f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(log10_probability: float, tokens: int) -> float:
    return math.pow(10.0, -log10_probability / max(tokens, 1))
