"""Exact top-k by inner product, with term-at-a-time accumulation.

Vectors are sparse rows of integer weights. A block of candidates is turned
into postings: for each term (dimension) the candidates that have it and their
weights. The terms are taken one at a time; each scatters the queries' weights
times its postings into a dense array of scores, queries by candidates. From
that array each query's best are selected, merged with its best so far, and the
tasks' bests are merged at the end. No score is skipped, so the result is exact.

Queries are written in blocks and candidates in files of a bounded number of
rows. Every pair of a block and a file is a cell, a small row that Spark deals
to a task; the task reads both from the shared folder. So neither the driver
nor a task holds more than a block, and the plan is the same at any size.
"""

from __future__ import annotations

from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitweave.llm.common import lean, open_fs, scratch, stored, tasks_of

#: Candidates scored at a time, queries that a block holds about, and candidates in a file at most.
CANDIDATES, QUERIES, FILE_ROWS = 1024, 2048, 1 << 18


class QueryBlock:
    """Queries as rows of (term, weight), turned by term."""

    def __init__(self, ids: np.ndarray, weights: list[np.ndarray]) -> None:
        self.ids = ids
        lens = np.array([len(w) for w in weights], dtype=np.int64)
        term = np.concatenate([np.arange(n) for n in lens]) if len(lens) else np.zeros(0, np.int64)
        weight, row = np.concatenate([np.zeros(0, np.int64), *weights]), np.repeat(np.arange(len(lens)), lens)
        keep = np.flatnonzero(weight)
        keep = keep[np.argsort(term[keep], kind="stable")]
        self.terms, begin = np.unique(term[keep], return_index=True)
        self.rows, self.weights = np.split(row[keep], begin[1:]), np.split(weight[keep], begin[1:])

    def scores(self, ids: np.ndarray, lens: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Inner products of all queries with a block of candidates, given as one flat array.

        What a query scores with its own id doesn't count. Numbers whose products might leave 64 bits are multiplied exactly; a
        score that does leave them is an OverflowError.
        """
        most = lambda x: float(np.abs(x.astype(float)).max(initial=0))
        wide = max(map(most, self.weights), default=0.0) * most(flat) * len(self.terms) >= 2.0**62
        out = np.zeros((len(self.ids), len(lens)), dtype=object if wide else np.int64)
        begin = np.cumsum(lens) - lens
        for term, rows, weights in zip(self.terms, self.rows, self.weights, strict=True):
            posting = np.flatnonzero(lens > term)
            value = flat[begin[posting] + term]
            posting, value = posting[value != 0], value[value != 0]
            if wide:
                weights, value = weights.astype(object), value.astype(object)
            if len(posting) == len(lens) and len(rows) == len(out):
                out += weights[:, None] * value
            elif len(posting):
                out[np.ix_(rows, posting)] += weights[:, None] * value
        if wide:
            out[self.ids[:, None] == ids] = 0
            if any(not -(1 << 63) <= x < 1 << 63 for x in out.flat):
                raise OverflowError("an inner product leaves 64 bits")
            out = out.astype(np.int64)
        return out


def best(scores: np.ndarray, ids: np.ndarray, usable: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest usable scores, ties to smaller ids, unordered."""
    at = np.flatnonzero(usable)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        sure, tied = at[scores[at] > least], at[scores[at] == least]
        at = np.concatenate([sure, tied[np.argsort(ids[tied], kind="stable")[: k - len(sure)]]])
    return at


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, weights): floor(scale * x) of each component, as long; vectors with null or non-finite parts go."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    fine = F.col("x").isNotNull() & F.col("id").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.coalesce(fine, F.lit(False))).select("id", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("weights"))


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, scale: float = 256.0, block: int = QUERIES, file_rows: int = FILE_ROWS) -> DataFrame:
    """Each query's k best candidates by integer inner product.

    Queries are the rows whose id is divisible by `every`; candidates are all
    rows with another id. Vectors that are null, hold null or non-finite
    components, or have a null id take no part; components beyond 64-bit
    integers after scaling are an error, and so are scores beyond them; a
    shorter vector has zeros at its end and an empty one scores 0. Rows that
    repeat an id are candidates each, and as queries one of them (the largest
    weights) counts. Ties go to the smaller id. A query with fewer candidates
    gets them all. An empty table gives no rows. Extra columns are not read.

    Returns query_id, rank from 1, vec_id and score.
    """
    spark = vectors.sparkSession
    folder = scratch(spark, "top-k")
    rows = quantised(vectors, id_col, vector_col, scale)
    rows.write.option("maxRecordsPerFile", file_rows).parquet(f"{folder}/candidates")
    rows = spark.read.schema(rows.schema).parquet(f"{folder}/candidates")
    queries = stored(rows.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.max("weights").alias("weights")), "queries")
    blocks = max(1, -(-queries.count() // block))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    dealt.repartition(blocks, "block").write.partitionBy("block").parquet(f"{folder}/queries")
    files = rows.select(F.input_file_name().alias("file")).distinct()
    cells = files.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = cells.repartition(max(tasks_of(spark), blocks)).mapInArrow(lean(_searcher(folder, k)), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(folder: str, k: int):
    def block_of(number: int) -> QueryBlock:
        import pyarrow.dataset as ds
        from pyarrow import fs

        files, at = open_fs(f"{folder}/queries/block={number}")
        if files.get_file_info(at).type == fs.FileType.NotFound:  # no query has this hash
            return QueryBlock(np.zeros(0, np.int64), [])
        got = ds.dataset(at, filesystem=files, format="parquet").to_table(columns=["id", "weights"]).sort_by("id")
        return QueryBlock(got.column("id").to_numpy(), [np.asarray(w, dtype=np.int64) for w in got.column("weights").to_pylist()])

    def search(queries: QueryBlock, file: str):
        import pyarrow.parquet as pq

        files, at = open_fs(file)
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries.ids]
        with files.open_input_file(at) as f:
            for part in pq.ParquetFile(f).iter_batches(CANDIDATES, columns=["id", "weights"]):
                ids, lists = part.column(0).to_numpy(), part.column(1)
                scores = queries.scores(ids, np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy())
                for q, own in enumerate(queries.ids):
                    usable = ids != own
                    if len(held[q][0]) == k:
                        usable &= scores[q] >= held[q][1].min()
                        if not usable.any():
                            continue
                    pick = best(scores[q], ids, usable, k)
                    both = np.concatenate([held[q][0], ids[pick]]), np.concatenate([held[q][1], scores[q][pick]])
                    keep = best(both[1], both[0], np.ones(len(both[0]), bool), k)
                    held[q] = both[0][keep], both[1][keep]
        return held

    def run(batches):
        queries, number = None, None
        for batch in batches:
            for file, block in sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True), key=lambda c: (c[1], c[0])):
                if block != number:
                    queries, number = block_of(block), block
                if not len(queries.ids):
                    continue
                held = search(queries, unquote(file))
                for q in range(0, len(held), 1000):
                    rows = held[q : q + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries.ids[q : q + 1000], [len(r[0]) for r in rows])), pa.array(np.concatenate([r[0] for r in rows])), pa.array(np.concatenate([r[1] for r in rows]))], names=["query_id", "vec_id", "score"])

    return run


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum([q.w[i] * c.w[i] FOR i IN range(1, least(len(q.w), len(c.w)) + 1)]), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
