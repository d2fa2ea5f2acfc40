"""N-gram Jaccard similarity join by MinHash banding, with exact verification.

Texts become sets of word n-grams; texts of equal words are one node, so copies
are compared once. A node's MinHash signature is cut into bands; the number of
bands and of rows in a band follow from the similarity and the recall asked
for: of all pairs of numbers that give that recall, the one that makes the
fewest candidates of pairs below the similarity. Nodes that
share a band hash are linked to the bucket's smallest node, which takes as many
links as nodes however full a bucket is, and the components of these links hold
all candidate pairs. Inside a component every pair is verified on the full
n-gram sets: members are dealt to blocks by hash and a task compares two blocks
with a matrix product, so a large group is spread over many tasks and no pair
of it is ever a row. What leaves a task is each node's number of links and a
spanning forest of the links.

A large component may be a chain of texts that are mostly unlike. Where fewer
sets have to be sent for it, each of its buckets is verified by itself instead
of the whole component; a pair counts in the first band that it shares.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitweave.llm import textcodes as tc
from bitweave.llm.common import bounded_batches, lean, stored, tasks_of
from bitweave.llm.components import components

N, SIMILARITY, RECALL = 5, 0.8, 0.9999
#: Hashes of a signature at most.
MOST_HASHES = 300
#: Nodes in a block, and matrix cells that a task makes at a time.
BLOCK, CELLS = 256, 1 << 23
#: Members up to which their ids are broadcast to fetch the texts; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000


def bands_for(similarity: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows) that find a pair of that similarity with that probability.

    More rows make fewer false candidates and need more bands; the hashes of
    both together are at most `most`, but a band of one row is always allowed.
    """
    options = []
    for rows in range(1, most + 1):
        chance = similarity**rows
        bands = 1 if chance >= recall else max(1, math.ceil(math.log(1 - recall) / math.log1p(-chance)))
        if rows > 1 and bands * rows > most:
            break
        below = np.linspace(0, similarity, 200, endpoint=False)
        options.append((float((1 - (1 - below**rows) ** bands).mean()), bands, rows))
    return min(options)[1:]


def _sets(raw: np.ndarray, at: np.ndarray, n: int):
    """(n-gram codes of a chunk, text of each, fingerprints, words) ; a text of fewer words is one n-gram.

    The two fingerprints of a text come from independent codes of its words.
    """
    low, starts, stops, first, codes = tc.words(raw, at)
    text, count = tc.owners(first), np.diff(first)
    grams = tc.ngram_codes(codes, n)
    place = np.arange(len(grams))
    inside = place + n <= first[text[: len(grams)] + 1]
    place = np.arange(len(codes)) - first[text]
    prints = []
    full = count > 0
    for salt, words in ((0x5851F42D4C957F2D, codes), (0x14057B7EF767814F, tc.word_codes(low, starts, stops, 1))):
        mixed = tc.mix(words + (place + 1).astype(np.uint64) * np.uint64(salt))
        out = np.zeros(len(count), dtype=np.uint64)
        if full.any():
            out[full] = np.add.reduceat(mixed, first[:-1][full])
        prints.append(out)
    short = np.flatnonzero(full & (count < n))
    own, owner = grams[inside], text[: len(grams)][inside]
    if len(short):
        own, owner = np.concatenate([own, tc.mix(prints[0][short])]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        own, owner = own[order], owner[order]
    return own, owner, prints, count


def _signature_bands(codes: np.ndarray, begin: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (texts by bands); begin: the first code of each text, none empty."""
    seeds = tc.mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros((bands, len(begin)), dtype=np.uint64)
    for b in range(bands):
        for r in range(rows):
            k = b * rows + r
            least = np.minimum.reduceat((codes ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1)), begin)
            out[b] = tc.mix(out[b] * np.uint64(31) + least + np.uint64(b))
    return out.T


def sketches(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(id, node, check, bands) of each text with a word; id and text are the columns of docs."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i, j, raw, at in tc.chunks(batch.column(1)):
                codes, owner, prints, count = _sets(raw, at, n)
                full = np.flatnonzero(count)
                if not len(full):
                    continue
                found = _signature_bands(codes, np.searchsorted(owner, full), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, bands), pa.int32()), pa.array(found.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(full)), pa.array(prints[0][full].view(np.int64)), pa.array(prints[1][full].view(np.int64)), lists], names=["id", "node", "check", "bands"])

    return docs.mapInArrow(lean(run), f"id {kind}, node long, check long, bands array<long>")


def linked(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, similarity: float) -> np.ndarray:
    """Which sets of a reach the similarity with which of b (of a itself if b is None); sets are sorted distinct codes."""
    both = sets_a if sets_b is None else [*sets_a, *sets_b]
    size = np.array([len(s) for s in both], dtype=np.int64)
    n = len(sets_a)
    owner, codes = np.repeat(np.arange(len(both)), size), np.concatenate(both)
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    new = np.concatenate([[True], codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, bool)
    times = np.diff(np.append(np.flatnonzero(new), len(codes)))
    term = np.cumsum(new) - 1
    keep = times[term] > 1 if len(codes) else np.zeros(0, bool)  # a code of one set is in no intersection
    owner, term = owner[keep], term[keep]
    _, term = np.unique(term, return_inverse=True)
    a_size, b_size = size[:n], size if sets_b is None else size[n:]
    common = np.zeros((n, len(b_size)), dtype=np.float64)
    wide = max(256, CELLS // max(1, len(both)))
    total = int(term.max()) + 1 if len(term) else 0
    for c in range(0, total, wide):
        lo, hi = np.searchsorted(term, [c, c + wide])
        cells = np.zeros((len(both), min(wide, total - c)), dtype=np.float32)
        cells[owner[lo:hi], term[lo:hi] - c] = 1
        common += cells[:n] @ (cells if sets_b is None else cells[n:]).T
    union = a_size[:, None] + b_size[None, :] - common
    out = common >= similarity * union - 1e-9
    if sets_b is None:
        np.fill_diagonal(out, False)
    return out


def _first_shared(links: np.ndarray, a: np.ndarray, b: np.ndarray, bucket: int) -> np.ndarray:
    """Of the links of a bucket, those whose ends share no earlier band; a and b: band hashes of the nodes."""
    i, j = np.nonzero(links)
    out = np.zeros_like(links)
    if len(i):
        out[i, j] = a[i, (a[i] == b[j]).argmax(axis=1)] == bucket
    return out


def _forest(links: np.ndarray, a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Links that connect what all links connect, one fewer than nodes at most."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in np.flatnonzero(links.any(axis=1)):
        for j in np.flatnonzero(links[i]):
            x, y = root(a[i]), root(b[j])
            if x != y:
                parent[x] = y
                out.append((a[i], b[j]))
    return out


def jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, similarity: float = SIMILARITY, recall: float = RECALL, block: int | None = None) -> DataFrame:
    """Classes of similar documents.

    Two texts are linked if the Jaccard similarity of their sets of n-word
    shingles reaches `similarity`; a class is what links connect. A text of
    fewer than n words is one shingle of all its words; a null text, or one
    without words, is linked to nothing and a class of its own.

    Returns one row for each row of docs: the id column, class_id (smallest id
    of the class), n_links (other texts, of different words, that it is linked
    to) and n_copies (other rows with the same words). Rows with a null id are
    compared with nothing and have a null class. Rows that repeat an id are
    each reported. Extra columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    tasks = tasks_of(spark)
    bounded_batches(spark)
    bands, rows, block = *bands_for(similarity, recall), block or BLOCK
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    sketch = stored(sketches(docs.where("id is not null"), n, bands, rows), "sketches")
    nodes = stored(sketch.groupBy("node", "check").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "nodes")

    banded = nodes.select("node", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count("*").alias("m")).where("last > hub").select("band", "hub", "m")
    near = banded.join(hubs, "band").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    candidates = stored(components(near), "candidates")

    def parts(m):
        return F.ceil(F.col(m) / block)

    # what a member is compared in: its component, or each of its buckets where that sends fewer sets
    sizes = candidates.groupBy("component").agg(F.count("*").alias("m"))
    cells = candidates.join(sizes, "component").select("node", F.col("component").alias("cell"), parts("m").cast("int").alias("parts"), F.lit(False).alias("split"))
    large = sizes.where(F.col("m") > block).select("component", (F.col("m") * parts("m")).alias("whole"))
    if not large.isEmpty():
        buckets = hubs.join(candidates.withColumnRenamed("node", "hub"), "hub").join(large, "component")
        split = stored(buckets.groupBy("component").agg(F.sum(F.col("m") * parts("m")).alias("sets"), F.first("whole").alias("whole")).where("sets < whole").select("component"), "split")
        if not split.isEmpty():
            inside = nodes.join(candidates.join(split, "component"), "node").select("node", F.explode("bands").alias("band"))
            cells = cells.join(split.withColumnRenamed("component", "cell"), "cell", "left_anti").select("node", "cell", "parts", "split")
            cells = cells.unionAll(inside.join(hubs, "band").select("node", F.col("band").alias("cell"), parts("m").cast("int"), F.lit(True)))
            cells = stored(cells, "cells")
    places = cells.groupBy("node").agg(F.collect_list(F.struct("cell", "parts")).alias("cells"), F.max("split").alias("split"))  # one, or at most one for each band
    members = stored(places.join(nodes.select("node", "check", F.col("rep").alias("id")), "node").select("id", "node", "check", "cells", "split"), "members")
    few = (members.agg(F.sum(F.size("cells"))).first()[0] or 0) <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(members) if few else members, "id").select("id", "text", "node", "check", "cells", "split")

    def spread(batches):
        names = ["split", "cell", "i", "j", "block", "node", "codes", "bands"]
        types = (pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        for batch in batches:
            for i, j, raw, at in tc.chunks(batch.column(1)):
                codes, owner, prints, _ = _sets(raw, at, n)
                begin = np.searchsorted(owner, np.arange(j - i + 1))
                out = []
                node, check, cells, split = (batch.column(c).slice(i, j - i).to_pylist() for c in (2, 3, 4, 5))
                for k in range(j - i):
                    if int(prints[0][k].view(np.int64)) != node[k] or int(prints[1][k].view(np.int64)) != check[k]:
                        continue  # another row of that id, with other words
                    full = codes[begin[k] : begin[k + 1]]
                    own = np.unique(full).tobytes()
                    hashes = _signature_bands(full, np.zeros(1, np.int64), bands, rows).tobytes() if split[k] else None
                    spot = tc.mix(np.array([node[k]], np.int64).view(np.uint64))[0]
                    for cell in cells[k]:
                        b = int(spot % np.uint64(cell["parts"]))
                        out += ((split[k], cell["cell"], min(b, o), max(b, o), b, node[k], own, hashes) for o in range(cell["parts"]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def verify(batches):
        name, run, hashes, out = None, {}, {}, []

        def flush():
            if len(run) > 1:
                order = sorted(run)  # by block, then node
                first, second = ([k for k in order if k[0] == b] for b in name[2:])
                same = name[2] == name[3]
                if first and second:
                    links = linked([run[k] for k in first], None if same else [run[k] for k in second], similarity)
                    if name[0]:
                        links = _first_shared(links, np.stack([hashes[k] for k in first]), np.stack([hashes[k] for k in second]), name[1])
                    left, right = [k[1] for k in first], [k[1] for k in second]
                    for ids, degree in ((left, links.sum(axis=1)),) if same else ((left, links.sum(axis=1)), (right, links.sum(axis=0))):
                        out.extend((x, None, int(d)) for x, d in zip(ids, degree, strict=True) if d)
                    out.extend((x, y, 0) for x, y in _forest(links, left, right))

        def rows_out():
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["u", "v", "links"])
            out.clear()

        for batch in batches:
            for split, cell, i, j, own, node, codes, bands_of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (split, cell, i, j) != name:
                    flush()
                    name, run, hashes = (split, cell, i, j), {}, {}
                    if len(out) > 10_000:
                        yield from rows_out()
                run[own, node] = np.frombuffer(codes, np.uint64)
                if split:
                    hashes[own, node] = np.frombuffer(bands_of, np.int64)
        flush()
        if out:
            yield from rows_out()

    blocks = texts.mapInArrow(lean(spread), "split boolean, cell long, i int, j int, block int, node long, codes binary, bands binary")
    dealt = blocks.repartition(tasks, "cell", "i", "j").sortWithinPartitions("split", "cell", "i", "j")
    links = stored(dealt.mapInArrow(lean(verify), "u long, v long, links long"), "links")

    degree = links.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("n_links"))
    groups = components(links.where("v is not null").select("u", "v"))
    named = stored(nodes.select("node", "check", "rep", "copies").join(groups, "node", "left").join(degree, "node", "left").select("node", "check", "rep", "copies", F.coalesce("component", "node").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "named")
    first = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    classes = named.join(first, "component").select("node", "check", "class_id", "n_links", (F.col("copies") - 1).alias("n_copies"))
    worded = sketch.select("id", "node", "check").join(classes, ["node", "check"]).select("id", "class_id", "n_links", "n_copies")

    def wordless(batches):
        for batch in batches:
            text = batch.column(1)
            bare = np.ones(batch.num_rows, bool)
            for i, j, raw, at in tc.chunks(text):
                low = tc.LOWER[raw]
                bare[i:j] = np.diff(tc.word_spans(low, at, tc.ALNUM)[2]) == 0
            ids = batch.column(0)
            keep = np.flatnonzero(bare | ids.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep))], names=["id"])

    alone = docs.mapInArrow(lean(wordless), f"id {kind}").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_copies"))
    return worded.unionAll(alone).withColumnRenamed("id", id_col)
