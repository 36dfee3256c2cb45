"""Trees and paths against a plain recursive tree."""

import hashlib
import random
import zlib

import pytest

from atomweave.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, n string, tree int, node string"


def plain_hash(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return plain_hash("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text))


def plain_tree(nodes):
    """Levels of a tree."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([plain_hash(out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def plain_siblings(levels, k):
    out = []
    for level in levels[:-1]:
        run = level[k // 16 * 16 : k // 16 * 16 + 16]
        out.append((run[: k % 16], run[k % 16 + 1 :]))
        k //= 16
    return out


def plain_manifest(rows):
    """rows (doc_id, text, lang, source, n_chars) -> sorted rows of the manifest."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for i, t, g, s, n in rows:
        touched = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        leaf = plain_leaf(i, s, g, n, t)
        groups.setdefault(s, []).append(((i is not None, i or 0, leaf), i, leaf, plain_leaf(i, s, g, n, t and t.translate(lower)) if touched else leaf))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(groups[s], key=lambda x: x[0])]) for s in order}
    top = plain_tree([trees[s][-1][0] for s in order])
    out = []
    for p, s in enumerate(order):
        for k, (_, i, leaf, start) in enumerate(sorted(groups[s], key=lambda x: x[0])):
            path = plain_siblings(trees[s], k) + plain_siblings(top, p)
            node = start
            for a, b in path:
                node = plain_hash([*a, node, *b])
            out.append((i, leaf, trees[s][-1][0], top[-1][0], plain_hash([x for a, b in path for x in a + b]), node, node == top[-1][0]))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def frame(spark, rows):
    return spark.createDataFrame([(*r, k, "x", 1, "y") for k, r in enumerate(rows)], SCHEMA)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 33, 255, 256, 257, 300, 4095, 4096])
def test_traversal_gives_the_paths_of_the_tree(n):
    leaves = [plain_hash([str(k)]) for k in range(n)]
    levels = plain_tree(leaves)
    for more in (0, 1):  # a block below the top of a larger tree hashes runs of one as well
        own = levels + [[plain_hash(levels[-1])]] * more
        assert merkle.block_root(leaves, len(own) - 1) == own[-1][0]
        for k, path in enumerate(merkle.traverse(leaves, len(own) - 1)):
            assert [(run[:at], run[at + 1 :]) for at, run in path] == plain_siblings(own, k) and merkle.fold(leaves[k], path) == own[-1][0]


def test_traversal_holds_two_runs_a_level():
    leaves = [plain_hash([str(k)]) for k in range(4096)]
    most, t = 0, merkle.traverse(leaves, 3)
    for _ in t:
        ahead = t.gi_frame.f_locals["ahead"]
        most = max(most, sum(len(s) for x in ahead for s in x.stacks) + sum(map(len, t.gi_frame.f_locals["runs"])))
    assert most <= 2 * 3 * 16 + 3 * 16


def test_odd_rows(spark):
    rnd = random.Random(3)
    texts = [None, "", "Aé", "ABC def", "x" * 70_000, "ünï İ", "a:b"]
    rows = [(rnd.choice([None, *range(400)]), rnd.choice(texts), rnd.choice(["en", None]), rnd.choice([None, "", "a", "B", "é", "src0"]), rnd.choice([None, 3])) for _ in range(300)]
    rows += [(9, "same", "en", "a", 1)] * 20 + [(k, f"T{k}", "en", f"s{k}", 2) for k in range(40)]
    assert got(merkle.manifest(frame(spark, rows).repartition(7))) == plain_manifest(rows)


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", None, 1)], [(k, "T", "en", "one", 1) for k in range(16)]])
def test_small_tables(spark, rows):
    assert got(merkle.manifest(frame(spark, rows))) == plain_manifest(rows)


def test_a_tree_of_two_layers(spark):
    """The hot tree has more leaves than a block."""
    rows = [(k, f"Text {k}", "en", "hot" if k % 3 else f"s{k % 60}", k) for k in range(7000)]
    want = plain_manifest(rows)
    assert got(merkle.manifest(frame(spark, rows))) == want


def test_paths_fold_to_the_root(spark):
    rows = [(k, f"Text {k}", "en", f"s{k % 20}", k) for k in range(600)]
    d = merkle.authentication_paths(frame(spark, rows)).collect()
    assert len(d) == 600 and all(merkle.fold(r.leaf, [(s["at"], s["run"]) for s in r.path]) == r.root for r in d)
    assert len({r.root for r in d}) == 1 and len({r.subroot for r in d}) == 20
