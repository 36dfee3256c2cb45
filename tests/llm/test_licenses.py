"""License scans against a scorer in plain Python and a walk up the directories."""

import math
import random
import re
import textwrap
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_llm import ODD, docs

from atomweave.llm import license_scan as L

FULL = {}
for name, text in L.TEMPLATES:
    FULL[name] = max(FULL.get(name, ""), text, key=len)
WORD = re.compile(L.NOTICE)


def naive_terms(part):
    return [x for x in re.split(r"[^a-z0-9.]+|\.(?![a-z0-9])", part.lower()) if x]


def naive_parts(path, text):
    if not WORD.search(text):
        return set()
    lines = text.split("\n")
    header = []
    for x in lines:
        if not re.search(L.COMMENT, x):
            break
        header.append(x)
    parts = lines + re.split(r"\n[\s/#*;%-]*\n", text) + ["\n".join(header)]
    if re.search(L.LICENSE_FILE, (path or "/x").rsplit("/", 1)[-1]):
        parts.append(text)
    return {p.strip(" ") for p in parts if WORD.search(p)}


def naive_scan(files):
    """[(path, text)] -> [(own, score, license, from)]"""
    own = [naive_parts(p, t or "") for p, t in files]
    times = Counter(x for parts in own for x in parts)
    total = sum(times.values())
    df = Counter()
    for part, n in times.items():
        for t in set(naive_terms(part)):
            df[t] += n
    vector = lambda s: {t: n * (math.log((total + 1) / (df[t] + 1)) + 1) for t, n in Counter(naive_terms(s)).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(n, vector(t)) for n, t in L.TEMPLATES]
    best = {}
    for part in times:
        v = vector(part)
        found = [(-round(sum(x * w.get(t, 0.0) for t, x in v.items()) / (size(v) * size(w)), 6), n) for n, w in templates if v]
        if found and -min(found)[0] >= L.LEAST_COSINE:
            best[part] = min(found)
    mine = [min((best[p] for p in parts if p in best), default=None) for parts in own]
    given = {}
    for (path, _), hit in zip(files, mine, strict=True):
        if path is not None and hit and re.search(L.LICENSE_FILE, path.rsplit("/", 1)[-1]):
            d = path[: path.rfind("/") + 1]
            given[d] = min(given.get(d, hit[1]), hit[1])
    out = []
    for (path, _), hit in zip(files, mine, strict=True):
        near, d = None, None if path is None else path[: path.rfind("/") + 1]
        while d is not None and not hit:
            if d in given:
                near = d
                break
            d = None if d in ("", "/") else d[: d[:-1].rfind("/") + 1]
        out.append((hit and hit[1], hit and -hit[0], hit[1] if hit else given.get(near), near))
    return out


def check(spark, files, parts=3):
    d = docs(spark, [(k, t, p) for k, (p, t) in enumerate(files)]).repartition(parts)
    got = {r.doc_id: (r.own_license, r.own_score, r.license, r.inherited_from) for r in L.scan(d, F.col("source")).collect()}
    want = naive_scan(files)
    for k, w in enumerate(want):
        assert got[k][0] == w[0] and got[k][2:] == w[2:], (files[k][0], got[k], w)
        assert w[1] is None or abs(got[k][1] - w[1]) < 1e-5
    return got


def comment(text, mark):
    return "\n".join(mark + " " + x for x in textwrap.wrap(text, 76)) + "\n"


def test_real_headers_and_licence_files(spark):
    files = [
        ("LICENSE", "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + textwrap.fill(FULL["MIT"].split("(c) ", 1)[1], 80)),
        ("src/a.c", "int main() {}\n"),
        ("lib/one.py", comment(FULL["Apache-2.0"], "#") + "import os\n"),
        ("lib/two.js", "/*\n" + comment(FULL["GPL-3.0"], " *") + " */\nfoo();\n"),
        ("third/COPYING", "GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989 somebody\n"),
        ("third/deep/er/x.c", "/* nothing */"),
        ("/LICENSE", textwrap.fill(FULL["BSD-3-Clause"], 80)),
        ("/opt/b.c", "x"),
        ("/c.c", None),
        ("d.c", ""),
        (None, "x"),
        ("quote.txt", "the story of a man who read a license and of nothing else at all, and more words than that"),
        ("unlicense/UNLICENSE.md", FULL["Unlicense"]),
    ]
    got = check(spark, files)
    assert [got[k][2] for k in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)] == ["MIT", "MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "GPL-2.0", "BSD-3-Clause", "BSD-3-Clause", "BSD-3-Clause", "MIT", None, "MIT", "Unlicense"]
    assert got[1][3] == "" and got[5][3] == "third/" and got[7][3] == "/" and got[8][3] == "/"


@pytest.mark.parametrize("seed", range(2))
def test_random_trees(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    names = ["a", "b", "src", ""]
    files = []
    for _ in range(150):
        d = "/".join(rnd.choice(names[:3]) for _ in range(rnd.randint(0, 4)))
        path = rnd.choice(["", "", "/"]) + d + ("/" if d else "") + rnd.choice(["LICENSE", "COPYING.txt", "x.py", "y.c", "NOTICE-2"])
        bits = [rnd.choice([t for _, t in L.TEMPLATES] + ["just text", "", "a license of none", "// copyright"]) for _ in range(rnd.randint(0, 3))]
        text = rnd.choice(["\n", "\n\n", "\n#\n"]).join(rnd.choice([textwrap.fill(x, 60), x, comment(x, "//")]) for x in bits)
        files.append((None if rnd.random() < 0.03 else path, None if rnd.random() < 0.03 else text))
    check(spark, files + files[:10], 5)


def test_every_template_finds_itself(spark):
    lines = spark.createDataFrame([(t, t, 3) for _, t in L.TEMPLATES], "__p string, __part string, __n long")
    got = {r["__p"]: r.license for r in L.part_licenses(lines).collect()}
    assert got == {t: n for n, t in L.TEMPLATES}


def test_license_scan_of_odd_rows(spark):
    odd = docs(spark, ODD).repartition(3)
    assert L.scan(odd, F.col("source")).count() == len(ODD) and L.scan(docs(spark, []), F.col("source")).count() == 0
    comments = "# copyright\n" * 100_000
    assert L.scan(docs(spark, [(1, comments, "x/y"), (2, comments, None)]), F.col("source")).count() == 2
