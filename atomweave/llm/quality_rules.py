"""Quality rules as a short-circuit cascade.

A first pass over SAMPLE rows of every partition of the corpus runs all rules on the rows that the base rule passes, and
measures each rule's seconds and which rules reject which rows together. From these sums the driver makes one order for all
tasks, greedily: next comes the rule with the most rejections per second among sample rows that no earlier rule rejects.
Then every document leaves the cascade at the first rule that rejects it. Counts that the base columns need are kept with the
text, so a rule that reads them again costs nothing, and the measured cost says so.

A document's verdict is the conjunction of all rules, so the order, and thus the sample, decides what the cascade costs and
never what it returns: reruns and lost executors change nothing.

Defined results: null text is the empty text (0 words, base_failed); every row gives one row, repeated rows too; a
null identifier is returned as null; a text of any length is read whole, by one task, which holds its words; other columns
are never read; an empty table gives an empty result, and the rules then stand in the order given.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 64
SPACE = b" \t\n\x0b\x0c\r"
WIDTH = 3
SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = UPPER + UPPER.lower()


class Text:
    """One document, its words, and counts that several rules share."""

    def __init__(self, text: str):
        self.text, self.raw = text, text.encode("utf-8", "surrogatepass")
        self.words = self.raw.split()
        self.n_words = len(self.words)
        self.word_chars = len(text) - self.count(SPACE)

    def count(self, of: bytes) -> int:
        return len(self.raw) - len(self.raw.translate(None, of))

    @cached_property
    def n_symbols(self) -> int:
        return self.count(SYMBOLS)

    @cached_property
    def n_repeated_lines(self) -> int:
        lines = self.text.split("\n")
        if len(set(lines)) == len(lines):
            return 0
        seen: set[str] = set()
        n = 0
        for x in lines:
            if x in seen:
                n += bool(x.strip(" \t\n\x0b\x0c\r"))
            else:
                seen.add(x)
        return n

    @cached_property
    def n_repeated_words(self) -> int:
        """Words inside windows of WIDTH words that stand twice or more in the text."""
        w = self.words
        windows = list(zip(*(w[i:] for i in range(WIDTH)), strict=False))
        if len(set(windows)) == len(windows):
            return 0
        times = Counter(windows)
        n, end = 0, 0
        for i, x in enumerate(windows):
            if times[x] > 1:
                n += i + WIDTH - max(end, i)
                end = i + WIDTH
        return n

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeated_words > 50 * self.n_words

    @property
    def base(self) -> tuple:
        return self.n_words, self.word_chars, self.n_symbols, self.n_repeated_lines, self.n_repeated_words, self.base_failed


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


#: The production rules. A share is of words unless said otherwise.
RULES = [
    Rule("symbols", lambda t: t.n_symbols > 0.1 * t.n_words),
    Rule("shouting", lambda t: t.count(UPPER) > 0.3 * t.count(LETTERS)),
    Rule("exclamations", lambda t: t.raw.count(b"!") > 0.1 * t.n_words),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
    Rule("repeated_lines", lambda t: 2 * t.n_repeated_lines > t.raw.count(b"\n") + 1),
    Rule("few_distinct", lambda t: len(set(t.words)) < 0.1 * min(t.n_words, 1000)),
]

SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_rules_run", pa.int64())])


@dataclass(frozen=True)
class Plan:
    """Rules in the order in which they run, and the sample's figures for each: (name, seconds a row, rows it rejects of those left)."""

    rules: list[Rule]
    report: list[tuple[str, float, int]]


def greedy(rules: list[Rule], together: dict[int, int], seconds: dict[str, float]) -> list[tuple[Rule, float, int]]:
    """together: rows by the set of rules that reject them, a bit each in the order of rules; seconds: what a rule costs a row."""
    out, rest = [], list(range(len(rules)))
    while rest:
        gain = {k: sum(n for mask, n in together.items() if mask >> k & 1) for k in rest}
        best = min(rest, key=lambda k: (-gain[k] / max(seconds.get(rules[k].name, 0.0), 1e-9), seconds.get(rules[k].name, 0.0), k))
        out.append((rules[best], seconds.get(rules[best].name, 0.0), gain[best]))
        together = {mask: n for mask, n in together.items() if not mask >> best & 1}
        rest.remove(best)
    return out


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, sample: int = SAMPLE) -> Plan:
    """The order learned from the first sample rows of every partition; the driver gets a row per rule and per set of rules that reject together."""
    rules = RULES if rules is None else rules

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, together, left, passed = dict.fromkeys((r.name for r in rules), 0.0), Counter(), sample, 0
        for batch in batches:
            for text in batch.column(1).slice(0, left).to_pylist():
                t = Text(text or "")
                if t.base[-1]:
                    continue
                mask, passed = 0, passed + 1
                for k, r in enumerate(rules):
                    began = time.perf_counter()
                    mask |= int(r.rejects(t)) << k
                    spent[r.name] += time.perf_counter() - began
                together[mask] += 1
            left -= min(left, batch.num_rows)
            if not left:
                break
        rows = [(name, None, passed, s) for name, s in spent.items()] + [(None, str(m), n, 0.0) for m, n in together.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.float64()))], names=["name", "mask", "n", "seconds"])

    found = texts(df, id_col, text_col).mapInArrow(measure, "name string, mask string, n long, seconds double").groupBy("name", "mask").agg(F.sum("n").alias("n"), F.sum("seconds").alias("seconds")).collect()
    seconds = {r.name: r.seconds / r.n for r in found if r.name is not None and r.n}
    order = greedy(rules, {int(r["mask"]): r.n for r in found if r["mask"] is not None}, seconds) if seconds else [(r, 0.0, 0) for r in rules]
    return Plan([r for r, *_ in order], [(r.name, s, n) for r, s, n in order])


def scored(batches: Iterator[pa.RecordBatch], rules: list[Rule]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = []
            for text in part.column(1).to_pylist():
                t = Text(text or "")
                run = 0
                good = not t.base[-1]
                for r in rules if good else ():
                    run += 1
                    if r.rejects(t):
                        good = False
                        break
                rows.append((*t.base, good, run))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], SCHEMA.field(k + 1).type) for k in range(8))], schema=SCHEMA)


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, plan: Plan | None = None) -> DataFrame:
    """One row per row of df: the identifier (a long), base counts, base_failed, kept, and how many rules ran; in the order of plan, or else one measured now."""
    order = (plan or measured(df, id_col, text_col, rules)).rules
    out = texts(df, id_col, text_col).mapInArrow(lambda it: scored(it, order), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_rules_run long")
    return out.withColumnRenamed("doc_id", id_col)
