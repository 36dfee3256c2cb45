"""Toxicity scores against a scorer without automaton, trie or arrays; the quality cascade against all rules."""

import math
import random
import re

import numpy as np
from conftest import SF
from test_llm import docs

from atomweave.llm import quality_rules, toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def naive_hit(word, terms, exceptions):
    fuzzy = {t for t in terms if t in toxicity.SEEDS or (len(t) >= 6 and t[-1] != "*")}

    def read(w):
        begins = [t for t in terms if t[-1] == "*" and w.startswith(t[:-1])]
        if begins:
            return 0, min(begins, key=len)
        found = [(d, t) for t in terms if t[-1] != "*" and (d := distance(w, t)) <= (0 if t not in fuzzy or len(t) < 5 else 1 if len(t) < 9 else 2)]
        return min(found, default=None)

    hit = read(word)
    plain = "".join(dict(zip("013457@$", "oieastas", strict=True)).get(c, c) for c in word)
    if hit is None and not word.isalpha() and plain != word and plain.isalpha() and (again := read(plain)):
        hit = max(1, again[0]), again[1]
    return None if hit and hit[0] and word in exceptions else hit


def naive_score(text, terms, exceptions, w):
    low, at, marks = text.lower(), [], []
    for line in re.finditer(r"[^\n]*", low):
        inside, first = False, 0
        for m in re.finditer("[\"“”„«»]", line.group()):
            if inside:
                marks.append((line.start() + first, line.start() + m.start()))
            inside, first = not inside, m.start()
    at = [(m.group(), m.start()) for m in re.finditer(r"[\w@$]+", low)]
    sums = [0.0] * 5
    for i, (word, p) in enumerate(at):
        hit = naive_hit(word, terms, exceptions)
        if hit is None:
            continue
        near = {x for x, _ in at[max(0, i - 6) : i + 7]}
        kind = {(True, True): 2, (True, False): 0, (False, True): 4, (False, False): 1}[hit[1] in toxicity.SEEDS, hit[0] > 0]
        if near & toxicity.REPORTING or any(a < p < b for a, b in marks):
            sums[3] += 1
            sums[kind] += 0.1
        else:
            sums[kind] += 1.5 if near & toxicity.YOU else 1
    return 1 / (1 + math.exp(-(w[0] + sum(x * math.log1p(s) for x, s in zip(w[1:], sums, strict=True)))))


def test_score_equals_a_naive_scorer():
    rnd = random.Random(9)
    learned = ["blorghast", "vexnor", "grub*", "tinker"]
    exceptions = {"idiom", "vexnot", "ideot"}
    weights = np.array([-3.0, 2.0, 1.5, 1.0, 0.5, 0.7])
    s = toxicity.Scorer(learned, exceptions, weights)
    vocabulary = ["idiot", "idiots", "idi0t", "ideot", "idiom", "m0ron", "mron", "trash", "scum", "scam", "disgustng", "disgustin", "blorghast", "blorgast", "blrghst", "vexnor", "vexnot", "vexnorr", "grubby", "grub", "gruby", "tinker", "tinkr", "fine", "day", "you", "your", "called", "word", '"', "“", "”", "\n", "und", "é", "@ss", "the", "of", "a"]
    for _ in range(300):
        text = "".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", ", ", ""]) for _ in range(rnd.randint(0, 60)))
        text = text.upper() if rnd.random() < 0.2 else text
        assert abs(s.score(text) - naive_score(text, sorted(set(toxicity.SEEDS) | set(learned)), exceptions, weights)) < 1e-9, text


def test_learned_scores_equal_the_naive_ones(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.learn(d, labels)
    texts = {r.doc_id: r.text for r in d.limit(40).collect()}
    got = {r.doc_id: r.score for r in toxicity.score(d, model).filter(f"doc_id in ({','.join(map(str, texts))})").collect()}
    terms = sorted(set(toxicity.SEEDS) | set(model.terms))
    assert all(abs(got[i] - naive_score(t, terms, model.exceptions, model.weights)) < 1e-9 for i, t in texts.items())


def test_weights_are_the_mode():
    rnd = np.random.default_rng(3)
    x = np.log1p(rnd.poisson(0.4, (3000, toxicity.KINDS)))
    y = (rnd.random(3000) < toxicity.logistic(np.array([-6.0, 9, 8, 2, 1, -2]), x)).astype(float)
    y[x[:, 0] > 1] = 1.0  # nearly separable
    w = toxicity.fit(x, y)
    x1 = np.hstack([np.ones((3000, 1)), x])
    slope = x1.T @ (toxicity.logistic(w, x) - y) + (w - toxicity.PRIOR)
    assert np.abs(slope).max() < 1e-2


def test_one_order_for_all_tasks(spark):
    rnd = random.Random(2)
    good = " ".join("".join(rnd.choice("abcdefg") for _ in range(5)) for _ in range(80))
    rows = [(k, good.replace(" ", "! ") if k % 2 else good, "a") for k in range(400)]
    d = docs(spark, rows).repartition(7)
    plan = quality_rules.measured(d)
    assert sorted(r.name for r in plan.rules) == sorted(r.name for r in quality_rules.RULES)
    assert plan.rules[0].name == "exclamations" and plan.report[0][0] == "exclamations"  # the only one that rejects
    out = quality_rules.quality(d, plan=plan).collect()
    assert all(r.kept == (r.doc_id % 2 == 0) and r.n_rules_run == (len(plan.rules) if r.kept else 1) for r in out)
    assert quality_rules.measured(d.limit(0)).rules == quality_rules.RULES


def test_order_is_greedy_on_what_is_left():
    rule = lambda n: quality_rules.Rule(n, lambda t: False)
    rules = [rule("a"), rule("b"), rule("c")]
    # a and b reject the same 60 rows, c other 30; b is dearer than a
    order = quality_rules.greedy(rules, {0b011: 60, 0b100: 30, 0: 10}, {"a": 1.0, "b": 2.0, "c": 1.5})
    assert [r.name for r, *_ in order] == ["a", "c", "b"]
