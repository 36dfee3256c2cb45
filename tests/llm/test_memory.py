"""Memory of a task of the passage search on texts that repeat one byte, or two, for a megabyte."""

import hashlib
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]

PROBE = """
import resource, sys
import numpy as np, pyarrow as pa
from atomweave.llm import suffix_dedup as D
unit, n, hot = sys.argv[1].encode(), int(sys.argv[2]), sys.argv[3] == "hot"
texts = [unit * (n // len(unit)), b"some words before " + unit * 3000]
table = pa.table({"row": [0, 1], "id": [0, 1], "text": pa.array(texts, pa.binary())})
empty = pa.table({"bucket": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})
step = lambda it: D.as_table(it, D.PACKED_ARROW)
grams, sizes = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
if hot:
    grams = np.unique(D.gram_hashes(np.frombuffer(texts[0][:200], np.uint8)))
    sizes = np.ones(len(grams), np.uint8)
around = step(D.surroundings(table, step(D.repeated(step(D.find_anchors(table, empty, 4, grams, sizes)), 4)), 4))
for b in D.masked(table, step(D.covered(around, 4))):
    print(b.column("n_removed").to_pylist(), b.column("n_spans").to_pylist())
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


@pytest.mark.parametrize(("unit", "hot"), [("a", "plain"), ("a", "hot"), ("ab", "plain"), ("ab", "hot"), ("-=~", "hot")])
def test_long_runs_stay_within_a_gigabyte(unit, hot):
    done = subprocess.run([sys.executable, "-c", PROBE, unit, str(1 << 20), hot], cwd=ROOT, capture_output=True, text=True, timeout=300, check=True)
    counts, peak = done.stdout.strip().split("\n")
    period = len(unit)
    whole = (1 << 20) // period * period
    # strings that start at the first period places are new, whatever repeats after them goes
    run = 3000 * period
    assert counts == f"[{whole - period}, {run}] [1, 1]"
    assert int(peak) < 1000, peak


def test_a_run_in_spark(spark):
    from atomweave.llm import suffix_dedup

    texts = ["-" * 150_000, "x" + "-" * 5000 + "y", "- " * 20_000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.drop_repeats(rows, digest=True).collect()}
    assert [got[k].n_removed for k in range(3)] == [149_999, 5000, 39_998]
    assert got[1].kept_sha256 == hashlib.sha256(b"xy").hexdigest()
