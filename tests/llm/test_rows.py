"""Stages that return the caller's rows: nulls, repeated identifiers, hot keys, clashing names and empty tables against brute force."""

import random

import pytest
from pyspark.sql import functions as F
from test_llm import naive_fingerprint, naive_targets

import corpus_pipeline
from atomweave.llm import exact_dedup, mixing, simhash, toxicity
from atomweave.llm.components import components

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, __at int, __row string, __copy int, __id int, __keep string, __own int, __times int, __time int, __n int, __fp string, __tie int, __hash int, `a.b` int"


def table(spark, rows):
    """rows of (doc_id, text, source); the number of a row stands in every clashing column, so that a row can be told from its copies."""
    return spark.createDataFrame([(i, t, "en", s, 1, k, str(k), k, k, str(k), k, k, k, k, str(k), k, k, k) for k, (i, t, s) in enumerate(rows)], CLASHING)


def odd_rows(seed):
    rnd = random.Random(seed)
    texts = [None, "", " ", "a", "A", "b c d", *(" ".join(rnd.choice("xyz") * rnd.randint(1, 3) for _ in range(40)) for _ in range(12))]
    texts += [t + " tail" for t in texts[6:9]]
    rows = [(rnd.choice([None, None, 1, 2, 3, *range(10, 60)]), rnd.choice(texts), rnd.choice(["a", "b", None])) for _ in range(300)]
    return rows + [(None, "hot hot hot", "a")] * 150 + [(7, "hot hot hot", "a")] * 20


@pytest.mark.parametrize("seed", range(2))
def test_exact_keeps_one_row_of_each_text(spark, seed):
    rows = odd_rows(seed)
    best = {}
    for i, t, _ in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    d = table(spark, rows).repartition(9)
    left = exact_dedup.drop_exact(d)
    assert left.columns == d.columns
    got = left.collect()
    assert sorted((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in got) == sorted(best.items())
    for r in got:  # a whole row, untouched
        i, t, s = rows[r["__at"]]
        assert (r.doc_id, r.text, r.source) == (i, t, s) and r["__copy"] == r["__at"] == r["a.b"] and r["__row"] == r["__keep"] == str(r["__at"])


def test_exact_groups_with_hot_texts_split_off(spark):
    rows = odd_rows(5)
    d = table(spark, rows).repartition(9)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.keep_id is None, r.keep_id or 0, r.group_size, r.kept, r.text_sha256)
    want = sorted(map(key, exact_dedup.exact_groups(d).collect()))
    assert sorted(map(key, exact_dedup.exact_groups(d, hot_rows=50).collect())) == want and len(want) == len(rows)


@pytest.mark.parametrize("parts", [1, 2, 8, 9, 70])
def test_runs_are_sorted_and_merged(spark, parts):
    rnd = random.Random(parts)
    rows = [(rnd.randint(0, 9), f"t{rnd.randint(0, 40)}" if rnd.random() < 0.7 else "hot") for _ in range(500)]
    d = spark.createDataFrame(rows, "__id long, text string").repartition(parts)
    light = d.select("__id", *exact_dedup.digests(F.col("text"))).withColumnRenamed("text", "t")
    got = exact_dedup.merge_runs(light, "min").withColumn("p", F.spark_partition_id()).collect()
    want = {}
    for i, t in rows:
        a, n = want.get(t, (99, 0))
        want[t] = min(a, i), n + 1
    assert sorted((r["__id"], r["__n"]) for r in got) == sorted(want.values())
    assert len({(r["__hash"], r["__sha"]) for r in got}) == len(got)


def test_sorted_packs_are_merged_without_sorting():
    import numpy as np
    import pyarrow as pa

    def run(seed, n):
        rng = np.random.default_rng(seed)
        h = np.sort(rng.choice([-(2**63), -5, 0, 7, 2**63 - 1, *range(-40, 40)], n)).astype(np.int64)
        sha = [f"{x}-{rng.integers(0, 2)}" for x in h]  # a hash may have two texts
        t = pa.table({"__hash": h, "__bytes": np.ones(n, np.int64), "__sha": pa.array(sha, pa.string()), "__id": pa.array([None if i % 9 == 0 else int(rng.integers(0, 50)) for i in range(n)], pa.int64()), "__n": np.ones(n, np.int64)})
        return t, exact_dedup.combined(t, "max")

    plain, runs = zip(*(run(s, n) for s, n in enumerate([0, 1, 5, 60, 200, 7])), strict=True)
    two = exact_dedup.merged_two(runs[3], runs[4]).column("__hash").to_pylist()
    assert two == sorted(two)
    want = {}
    for t in plain:
        for r in t.to_pylist():
            best, n = want.get(r["__sha"], (-1, 0))
            want[r["__sha"]] = max(best, -1 if r["__id"] is None else r["__id"]), n + 1
    got = exact_dedup.merged(list(runs), "max")
    assert {r["__sha"]: (-1 if r["__id"] is None else r["__id"], r["__n"]) for r in got.to_pylist()} == want and got.num_rows == len(want)
    h = got.column("__hash").to_pylist()
    assert h == sorted(h)
    for level in (1, 3):
        packs = list(exact_dedup.packed(got, 4, level))
        assert sum(exact_dedup.unpacked(p).num_rows for _, _, p in packs) == got.num_rows and len({s for _, s, _ in packs}) == len(packs)


@pytest.mark.parametrize("batch", [1, 2, 7])
def test_runs_of_many_batches(spark, batch):
    """A row is carried from one Arrow batch to the next."""
    rows = [(i, f"t{i % 5}") for i in range(60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = exact_dedup.exact_groups(d).collect()
        assert sorted(r.keep_id for r in got if r.kept) == [55, 56, 57, 58, 59] and all(r.group_size == 12 for r in got) and len(got) == 60
        assert exact_dedup.drop_exact(d).count() == 5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_same_hash_of_other_texts_stays_apart(spark):
    rows = spark.createDataFrame([(i, 5, 3, s) for i, s in enumerate("aabba")], "__id long, __hash long, __bytes long, __sha string").repartition(3)
    assert sorted((r["__sha"], r["__id"], r["__n"]) for r in exact_dedup.merge_runs(rows, "max").collect()) == [("a", 4, 3), ("b", 3, 2)]


def naive_components(fps):
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = sorted(parent)
    for k, x in enumerate(own):
        for y in own[:k]:
            if bin((x ^ y) & (2**64 - 1)).count("1") <= 2:
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in own}


@pytest.mark.parametrize("seed", range(2))
def test_near_keeps_one_row_of_each_component(spark, seed):
    rows = odd_rows(seed)
    root = naive_components({naive_fingerprint(t or "") for _, t, _ in rows})
    least = {}
    for i, t, _ in rows:
        c = root[naive_fingerprint(t or "")]
        least[c] = min(least.get(c, 10**9), 10**9 if i is None else i)
    d = table(spark, rows).repartition(7)
    left = simhash.drop_near(d)
    assert left.columns == d.columns
    got = left.collect()
    assert sorted((root[naive_fingerprint(r.text or "")], 10**9 if r.doc_id is None else r.doc_id) for r in got) == sorted(least.items())
    assert all((r.doc_id, r.text, r.source) == rows[r["__at"]] and r["__fp"] == r["__row"] for r in got)


def test_links_of_clusters_and_crowded_places(spark):
    rnd = random.Random(8)
    fps = {rnd.getrandbits(64) for _ in range(300)}
    centre = rnd.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(0, 64, 5)}  # dense
    for x in list(fps)[:60]:
        for _ in range(3):
            for bit in rnd.sample(range(64), rnd.choice([1, 2, 2, 3])):
                x ^= 1 << bit
            fps.add(x)
    own = [simhash.signed(x) for x in fps]
    d = spark.createDataFrame([(x,) for x in own], "__fp long")
    want = naive_components(own)
    for most in (0, 4, 10**6):
        edges = simhash.links(d, simhash.pivots(), most)
        root = {r.node: r.root for r in components(edges).collect()}
        assert all(root.get(x, x) == want[x] for x in own), most
    r = simhash.search_report(d, simhash.pivots(), 10**6).first()
    assert r.met == r.discarded + r.verified and r.discarded > 0 and r.linked <= r.verified and r.crowded == 0
    pairs = simhash.met(simhash.places_of(d, simhash.pivots(), 10**6)[0])
    assert pairs.filter((simhash.bits_apart() <= 2) & ~simhash.survives(simhash.N_PIVOTS)).count() == 0  # the table discards no link


@pytest.mark.parametrize("seed", range(2))
def test_mixed_rows_of_odd_rows(spark, seed):
    rows = odd_rows(seed)
    d = table(spark, rows).repartition(6)
    out = mixing.mixed_rows(d)
    assert out.columns == d.columns
    got = out.collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, words = naive_targets(sizes), dict.fromkeys(sizes, 0)
    times = {}
    for r in got:
        assert (r.doc_id, r.text, r.source) == rows[r["__at"]]
        times[r["__at"]] = times.get(r["__at"], 0) + 1
        words[r.source] += len((r.text or "").split())
    assert all(times[k] == 1 for k, (_, t, _) in enumerate(rows) if not (t or "").split()) and max(times.values()) <= 2
    longest = max(len((t or "").split()) for _, t, _ in rows)
    assert all(round(want[s]) <= words[s] < want[s] + longest + 1 for s in sizes)


def test_crowded_range_is_cut_again(spark, monkeypatch):
    rows = [(None, "one two three", "a")] * 900 + [(i, "w " * (i % 9), "ab"[i % 2]) for i in range(600)]
    d = table(spark, rows).repartition(5)
    want = {s: t for s, t in naive_targets({"a": 2700 + sum(i % 9 for i in range(0, 600, 2)), "b": sum(i % 9 for i in range(1, 600, 2))}).items()}
    monkeypatch.setattr(mixing, "ROWS_A_RANGE", 8)
    got = mixing.mix(d).collect()
    taken = {s: sum(r.taken for r in got if r.source_size == n) for s, n in (("a", 2700 + sum(i % 9 for i in range(0, 600, 2))), ("b", sum(i % 9 for i in range(1, 600, 2))))}
    assert all(abs(taken[s] - want[s]) <= 1 for s in want) and all(0 <= r.taken <= 2 * r.size for r in got) and len(got) == 1500


def test_every_stage_takes_empty_and_odd_tables(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for rows in ([], odd_rows(3), [(None, None, None)] * 4):
        d = table(spark, rows).repartition(3)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, str(tmp_path))
            assert out.columns == d.columns, name
            assert out.count() <= 2 * len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).count() == len(rows)
    d = table(spark, odd_rows(3))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    model = toxicity.learn(d, labels)
    texts = {r.text or "" for r in toxicity.drop_toxic(d, model).collect()}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns) and 0 < out.count() <= 2 * len(texts)
