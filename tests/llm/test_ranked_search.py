"""Ranked search against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import pytest

from atomweave.llm import ranked_search as R

TERM = re.compile(R.TERM)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, k=20):
    """(item_id, rank, doc_id, score), sorted."""
    tf = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in tf if c), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in tf:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // total if c else 1
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, k, "x", 1) for k, (i, t) in enumerate(docs)], "doc_id long, text string, score int, terms string, segment int")
    return d, spark.createDataFrame([(i, t, 0, "y") for i, t in items], "item_id long, text string, rank int, doc_id string")


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def some_tables(seed, n=400):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(120)] + ["Été", "naïve", "日本", "x1", "A"]
    text = lambda most: " ".join(rnd.choice(vocabulary[: rnd.choice([5, 40, 125])]) + rnd.choice(["", ",", "-b", "_"]) for _ in range(rnd.randint(0, most)))
    docs = [(rnd.choice([None, *range(2 * n)]), rnd.choice([None, "", "--", text(12), text(60), text(300)])) for _ in range(n)]
    docs += [(7, "same w1 w2 text")] * 30 + [(None, "same w1 w2 text")] * 3 + [(900, "long " * 30_000 + "w3")]
    items = [(k % 12, text(40)) for k in range(16)] + [(50, None), (51, "..."), (52, "w1 " * 300), (None, "w2 same"), (53, "absent"), (54, "same W1 w2")]
    return docs, items


@pytest.mark.parametrize("block,segment", [(1, 5), (8, 1024), (3, 50)])
def test_results_are_those_of_plain_scoring(spark, block, segment):
    docs, items = some_tables(block)
    d, q = frames(spark, docs, items)
    index = R.build(d.repartition(5), block=block, segment_docs=segment)
    assert rows(R.search(index, q)) == plain_search(docs, items)
    r = R.search_report(index, q).first()
    assert 0 < r.pairs_scored <= r.pairs_above_0 <= r.pairs and r.blocks_scored <= r.blocks


def test_chunks_of_queries_and_whole_numbers(spark, monkeypatch):
    docs, items = some_tables(9, 100)
    monkeypatch.setattr(R, "CHUNK_QUERIES", 3)
    d, q = frames(spark, docs, items)
    assert rows(R.search(R.build(d), q)) == plain_search(docs, items)
    big = R.Queries([Counter({b"a": 10**7}), Counter({b"b": 1})])
    big.weigh({0: 1, 1: 1}, 100)
    assert big.weights.dtype == "int64" and int(big.weights[0, 0]) == 10**7 * R.weight(1, 100)


def test_blocks_below_the_threshold_are_skipped(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    q = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    index = R.build(d)
    assert rows(R.search(index, q)) == plain_search([tuple(r) for r in d.collect()], [(r.item_id, r.text) for r in q.collect()])
    r = R.search_report(index, q).first()
    assert r.pairs == r.blocks * 40 and r.pairs_scored < 0.4 * r.pairs_above_0


@pytest.mark.parametrize("docs,items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None), (2, "")], [(1, "a")]), ([(1, "a")], [(1, "a"), (1, "a")])])
def test_small_tables(spark, docs, items):
    d, q = frames(spark, docs, items)
    assert rows(R.rank(d, q)) == plain_search(docs, items)


def test_terms_of_bytes_are_those_of_characters():
    rnd = random.Random(4)
    for _ in range(500):
        t = "".join(chr(rnd.choice([rnd.randrange(128), rnd.randrange(128), rnd.randrange(128, 0x2FFF), rnd.randrange(0x10000, 0x10FFFF)])) for _ in range(40))
        assert [x.decode() for x in R.terms_of(t)] == plain_terms(t)


def test_names_of_queries_can_be_texts(spark):
    q = spark.createDataFrame([("a b", "w1")], "item_id string, text string")
    d = spark.createDataFrame([(1, "w1 w2"), (2, "w2"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in R.rank(d, q).select("item_id", "rank", "doc_id").collect()] == [("a b", 1, 1)]
