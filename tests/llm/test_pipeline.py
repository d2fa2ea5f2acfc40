"""The pipeline against a brute-force version of its stages."""

import re
import zlib

import numpy as np

import corpus_pipeline
from bitweave.llm.common import stored
from bitweave.llm.license_scan import lower_ascii
from bitweave.llm.queries import tokenizer_path

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_run(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    # every document of the four languages has letters and a sure label, so the first stage keeps them
    kept = {i for i, t in text.items() if any(map(str.isalpha, t))}
    words = {i: ALNUM.findall(lower_ascii(text[i])) for i in kept}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items() if w}
    root = {i: i for i in kept}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    kept = {i for i in kept if top(i) == i}
    items = [ALNUM.findall(lower_ascii(r.text or "")) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 8]) for w in items for k in range(len(w) - 7)}
    kept = {i for i in kept if not any(tuple(words[i][k : k + 8]) in windows for k in range(len(words[i]) - 7))}
    library = Tokenizer.from_file(tokenizer_path())
    want = {}
    for i in kept:
        ids = np.array([*library.encode(text[i], add_special_tokens=False).ids, 2], "<u4")
        cut = (len(ids) - 1) % 1024 + 1
        ends = [0, *range(cut, len(ids) + 1, 1024)]
        want |= {(i, k): (a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False))}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)


def test_odd_rows_go_through(spark, sf_dir):
    """Nulls, repeats and columns whose names clash; the columns of the input come back."""
    rows = [(1, "same words here again and again", "en", 0.5), (1, "same words here again and again", "en", 0.5), (2, None, "en", 0.1), (None, "some other words of a text", "en", 0.1), (3, "12 !", None, 0.2), (4, "Same words, here again and again", "fr", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").withColumn("class_id", docs_one())
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, sf_dir), name)
        assert out.columns == docs.columns
        docs = out
        seen.append(sorted((r.doc_id or 0) for r in docs.collect()))
    assert seen == [[0, 1, 1, 4], [0, 1], [0, 1]]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).isEmpty()


def test_short_benchmark_items(spark, tmp_path):
    """An item shorter than a window goes by its own whole occurrence, not by a number of words."""
    items = [(1, "alpha beta gamma"), (2, "one two three four five six seven"), (3, "k1 k2 k3 k4 k5 k6 k7 k8 k9"), (4, None), (None, "item without id")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "x Alpha, beta gamma y"), (2, "alpha beta x gamma"), (3, "one two three four five six seven"), (4, "one two three four five six seven8 alpha beta"), (5, "y k2 k3 k4 k5 k6 k7 k8 k9"), (6, "k1 k2 k3 k4 k5 k6 k7 x k8 k9"), (7, None), (8, "an item without id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.without_benchmarks(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [2, 4, 6, 7]


def docs_one():
    from pyspark.sql import functions as F

    return F.lit("clash")
