"""Token-id shards with a minimal perfect hash index.

Documents are dealt to shards by ranges of their key, so the shards in order of
their first key hold the corpus in ascending key order. A shard is one file:

    8 bytes   magic BWTOKEN1
    1 byte    width of an id, 2 or 4 bytes (2 where the vocabulary allows it)
    ids       raw little-endian ids of the documents, one after the other

The index is a set of files, one for each bucket of the keys' hashes:

    8 bytes   magic BWINDEX1
    8 + 8     number of keys n and of displacement groups g, u64
    4 g       displacement of each group, u32
    24 n      slots: fingerprint u32, shard u32, first id u64, number of ids u64

A key's bucket, group and slot follow from its hash and the displacement of
its group; every slot is taken by exactly one key. The stored fingerprint tells
an unknown key from a known one. Looking a key up reads one displacement and
one slot, whatever the number of documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitweave.llm import tokens
from bitweave.llm.common import bounded_batches, estimated_bytes, lean, open_fs, put_file, scratch, stored, tasks_of
from bitweave.llm.textcodes import mix

SHARD, INDEX = b"BWTOKEN1", b"BWINDEX1"
SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("first", "<u8"), ("n", "<u8")])
#: Keys to a displacement group, on average.
GROUP = 4
#: Bytes of texts to a shard, by Spark's estimate; a session's shuffle partitions are the fewest shards.
SHARD_BYTES = 128 << 20


def _hashes(keys: np.ndarray, salt: int) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def _place(h1: np.ndarray, h2: np.ndarray, displacement, n: int) -> np.ndarray:
    d = np.asarray(displacement, dtype=np.uint64)
    return (mix(h1 + d * (h2 | np.uint64(1))) % np.uint64(n)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacements, slot of each key) of a minimal perfect hash over distinct keys.

    Groups are placed from the largest to the smallest, each with the first
    displacement that sends all its keys to free slots.
    """
    n = len(keys)
    groups = max(1, -(-n // GROUP))
    h1, h2 = _hashes(keys, 1), _hashes(keys, 2)
    group = (_hashes(keys, 3) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    count = np.bincount(group, minlength=groups)
    begin = np.cumsum(count) - count
    out, slot, taken = np.zeros(groups, dtype="<u4"), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    tries = np.arange(64, dtype=np.uint64)
    for g in np.argsort(-count, kind="stable"):
        if not count[g]:
            break
        own = order[begin[g] : begin[g] + count[g]]
        base = 0
        while True:
            at = _place(h1[own][None, :], h2[own][None, :], (tries + np.uint64(base))[:, None], n)
            free = ~taken[at].any(axis=1)
            if count[g] > 1:
                s = np.sort(at, axis=1)
                free &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if free.any():
                k = int(free.argmax())
                out[g], slot[own] = base + k, at[k]
                taken[at[k]] = True
                break
            base += len(tries)
    return out, slot


class Index:
    """One bucket's index file in memory."""

    def __init__(self, raw: bytes) -> None:
        if raw[:8] != INDEX:
            raise ValueError("not an index file")
        self.n, self.groups = (int(x) for x in np.frombuffer(raw, "<u8", 2, 8))
        self.displacement = np.frombuffer(raw, "<u4", self.groups, 24)
        self.slots = np.frombuffer(raw, SLOT, self.n, 24 + 4 * self.groups)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot of each key, whether its fingerprint agrees)."""
        if not self.n:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        d = self.displacement[(_hashes(keys, 3) % np.uint64(self.groups)).astype(np.int64)]
        at = _place(_hashes(keys, 1), _hashes(keys, 2), d, self.n)
        return at, self.slots["print"][at] == (_hashes(keys, 4) >> np.uint64(32)).astype(np.uint32)


def _bucket(col: str, n: int):
    return F.pmod(F.xxhash64(F.col(col)), F.lit(n)).cast("int")


def write_tokens(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, path: str | None = None, shards: int | None = None, null_keys: bool = False) -> dict:
    """Encode whole texts into shards in ascending key order and index them.

    docs: a key (integer) and a text; null text is empty, so it holds the end
    id alone. Rows with a null key can't be looked up; they are left out, or with
    null_keys stand before all others in the files and the catalog. Rows of
    one key are kept, next to each other in any order, and the index leads to
    the first of them. Extra columns are not read. An empty table gives no shards.

    Returns the path, the number of index buckets, and the catalog: a
    DataFrame of one row for each document in the files (shard, first, n, key,
    repeats). Shard files have names by their number and are moved into place
    whole, so a task that runs again leaves the same file.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    shards = shards or max(tasks_of(spark), estimated_bytes(docs.select(id_col, text_col)) // SHARD_BYTES)
    bounded_batches(spark)
    spec = spark.sparkContext.broadcast(tokens.vocabulary(tokenizer))
    docs = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    if null_keys:  # many rows without a key are spread by their texts
        dealt = docs.repartitionByRange(shards, F.col("key").asc_nulls_first(), F.when(F.col("key").isNull(), F.xxhash64("text")))
    else:
        dealt = docs.where("key is not null").repartitionByRange(shards, "key")
    dealt = dealt.sortWithinPartitions("key")

    def run(batches):
        from tokenizers import Tokenizer

        shard = TaskContext.get().partitionId()
        width = 2 if Tokenizer.from_str(spec.value).get_vocab_size() <= 1 << 16 else 4
        rows = {"key": [], "n": []}

        def payload():
            yield SHARD + bytes([width])
            for batch in batches:
                rows["key"].append(batch.column(0))
                held = []
                for ids in tokens.encoded(batch.column(1), spec.value, end_id):
                    rows["n"].append(len(ids) // 4)
                    held.append(ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())
                    if len(held) == 1000:
                        yield b"".join(held)
                        held = []
                yield b"".join(held)

        first_batch = next(batches, None)
        if first_batch is None:
            return
        batches = _chain(first_batch, batches)
        put_file(f"{path}/shard-{shard:08d}.bin", payload())
        key, n = pa.concat_arrays(rows["key"]), np.array(rows["n"], dtype=np.int64)
        first = np.cumsum(n) - n
        for i in range(0, len(key), 50_000):
            part = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[part]), shard)), key[part], pa.array(first[part]), pa.array(n[part])], names=["shard", "key", "first", "n"])

    catalog = stored(dealt.mapInArrow(lean(run, tokens.KEPT), "shard long, key long, first long, n long"), "catalog")
    buckets = shards

    def index(batches):
        parts = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not parts:
            return
        got = pa.concat_tables(parts)
        bucket, key, shard, first, n = (got.column(c).to_numpy() for c in ("bucket", "key", "shard", "first", "n"))
        for b in np.unique(bucket):
            own = np.flatnonzero(bucket == b)
            own = own[np.lexsort((first[own], shard[own], key[own]))]
            own = own[np.concatenate([[True], key[own][1:] != key[own][:-1]])]
            displacement, at = build(key[own])
            slots = np.zeros(len(own), dtype=SLOT)
            slots["print"][at] = (_hashes(key[own], 4) >> np.uint64(32)).astype(np.uint32)
            slots["shard"][at], slots["first"][at], slots["n"][at] = shard[own], first[own], n[own]
            head = INDEX + np.array([len(own), len(displacement)], dtype="<u8").tobytes()
            put_file(f"{path}/index-{int(b):08d}.bin", [head, displacement.tobytes(), slots.tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array([int(b)]), pa.array([len(own)])], names=["bucket", "n"])

    keyed = catalog.where("key is not null").withColumn("bucket", _bucket("key", buckets)).repartition(buckets, "bucket")
    made = keyed.mapInArrow(lean(index, tokens.KEPT), "bucket long, n long").agg(F.sum("n")).collect()[0][0] or 0
    return {"path": path, "buckets": buckets, "catalog": catalog, "keys": made}


def _chain(first, rest):
    yield first
    yield from rest


def locate(spark: SparkSession, keys: DataFrame, store: dict, *, key_col: str = "doc_id") -> DataFrame:
    """Look keys up in the index: key, shard, first, n of each known key; unknown keys go.

    A key whose hash meets another key's slot is told apart by the stored
    32-bit fingerprint, so one unknown key in four thousand million is taken
    for a known one. Null keys are unknown.
    """
    path, buckets = store["path"], store["buckets"]
    keys = keys.select(F.col(key_col).cast("long").alias("key")).where("key is not null")

    def run(batches):
        held: dict[int, Index | None] = {}
        for batch in batches:
            bucket, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out = []
            for b in np.unique(bucket):
                if b not in held:
                    held.clear()
                    files, at = open_fs(f"{path}/index-{int(b):08d}.bin")
                    try:
                        with files.open_input_file(at) as f:
                            held[b] = Index(f.read())
                    except FileNotFoundError:
                        held[b] = None
                if held[b] is not None:
                    own = key[bucket == b]
                    at, known = held[b].find(own)
                    s = held[b].slots[at[known]]
                    out.append((own[known], s["shard"].astype(np.int64), s["first"].astype(np.int64), s["n"].astype(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["key", "shard", "first", "n"])

    asked = keys.withColumn("bucket", _bucket("key", buckets)).select("bucket", "key")
    return asked.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(run, tokens.KEPT), "key long, shard long, first long, n long")


def read_tokens(located: DataFrame, store: dict, *, payload: bool = False) -> DataFrame:
    """Read the ids of located documents from the shards.

    Returns key, shard, first, n and the crc32 of the ids as little-endian
    unsigned 32-bit integers; with payload also the ids. A task takes the
    documents of a shard in the order of their place, so it reads it forwards.
    """
    path = store["path"]
    schema = "key long, shard long, first long, n long, ids_crc32 long" + ", ids array<long>" * payload

    def run(batches):
        name, f = None, None
        for batch in batches:
            key = batch.column(0)
            shard, first, n = (batch.column(c).to_numpy() for c in range(1, 4))
            crc, ids = np.zeros(len(key), np.int64), []
            for i in range(len(key)):
                if shard[i] != name:
                    files, at = open_fs(f"{path}/shard-{int(shard[i]):08d}.bin")
                    f, name = files.open_input_file(at), shard[i]
                    head = f.read(9)
                    if head[:8] != SHARD:
                        raise ValueError("not a token shard")
                    kind = np.dtype(f"<u{head[8]}")
                f.seek(9 + int(first[i]) * kind.itemsize)
                got = np.frombuffer(f.read(int(n[i]) * kind.itemsize), kind)
                if len(got) != n[i]:
                    raise ValueError("a token shard is cut off")
                crc[i] = zlib.crc32(got.astype("<u4").tobytes())
                if payload:
                    ids.append(got.astype(np.int64))
            yield pa.RecordBatch.from_arrays([key, *(pa.array(x) for x in (shard, first, n, crc))] + ([pa.array(ids, pa.list_(pa.int64()))] if payload else []), names=["key", "shard", "first", "n", "ids_crc32"] + ["ids"] * payload)

    spark = located.sparkSession
    return located.select("key", "shard", "first", "n").repartition(tasks_of(spark), "shard").sortWithinPartitions("shard", "first").mapInArrow(lean(run, tokens.KEPT), schema)


def token_files(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write token shards, then look every document up and read it back.

    Returns doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32, shard and first; see write_tokens for the handling of nulls,
    repeats and empty tables. Rows that repeat a key are read through the
    catalog, next to the one that the index leads to, and so are rows without one.
    """
    spark = docs.sparkSession
    store = write_tokens(docs, tokenizer, **options)
    id_col = options.get("id_col", "doc_id")
    found = locate(spark, docs.select(id_col).distinct(), store, key_col=id_col)
    whole = store["catalog"].groupBy("key").agg(F.count("*").alias("rows"))
    again = store["catalog"].join(whole.where("rows > 1"), "key").select("key", "shard", "first", "n")
    places = found.unionByName(again).distinct().unionByName(store["catalog"].where("key is null").select("key", "shard", "first", "n"))
    # one row for each shard
    totals = store["catalog"].groupBy("shard").agg(F.min("key").alias("lowest"), F.sum("n").alias("ids")).orderBy(F.col("lowest").asc_nulls_first(), "shard").collect()
    rows, at = [], 0
    for t in totals:
        rows.append((t["shard"], at))
        at += t["ids"]
    base = spark.createDataFrame(rows, "shard long, base long")
    return read_tokens(places, store).join(F.broadcast(base), "shard").select(F.col("key").alias("doc_id"), (F.col("base") + F.col("first")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32", "shard", "first")
