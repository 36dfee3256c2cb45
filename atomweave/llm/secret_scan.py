"""Secret scans with corpus-wide ownership frequency. DataFrame functions only.

Spans come from regular expressions over whole texts: the base kinds assign, access and hex, tokens of known issuers
(known) and opaque strings of mixed characters (opaque). A kind's expression runs once over a text, and only over texts that hold
what every match of it holds (HINT): it sets a mark around each match, the text is split at the marks, and positions are
running sums of the lengths of the pieces. The value of each span is hashed; hashes are counted over the corpus by distinct
repositories and distinct owners, combined by (hash, owner, repository) before anything meets by hash, so a value that a third
of all rows hold is few rows. Both counts decide:
* copied: SHARED or more owners, or COPIES or more repositories: a widely copied example;
* live: one owner, and fewer than COPIES repositories: an owner's own credential;
* few: anything between.
Opaque strings become spans unless they are copied; all other kinds always are.

Defined results: null text has no spans; null owners or repositories count as one of their own; a null identifier is
returned as null; repeated rows each get their row; texts of any length are searched whole; other columns are never
read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, null_safe_key, text_of, told

SHARED = 3
COPIES = 6
BLOCK = 256
#: Stands around matches; where a text has it, it is read as another character that no expression takes either.
MARK, OTHER = "\x01", "\x02"


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(_either, ["password", "passwd", "secret", "token"])) + "|" + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind -> (expression, group that is the value, least characters of the value). The order breaks ties of position.
KINDS = {
    "assign": (ASSIGN, 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "known": (r"gh[pousr]_[A-Za-z0-9]{36,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+|-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "opaque": (r"[A-Za-z0-9+/_-]{32,}={0,2}", 0, 32),
}
BASE = ("assign", "access", "hex")


def holds(text: Column, *words: str) -> Column:
    return functools.reduce(operator.or_, [F.contains(text, F.lit(w)) for w in words])


#: What a text must hold for a kind's expression to be run at all: something cheaper to look for that every kept match contains.
HINT = {
    "assign": lambda t: holds(F.lower(t), "password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": lambda t: F.contains(t, F.lit("AKIA")),
    "hex": lambda t: t.rlike(r"[0-9a-f]{24}"),
    "known": lambda t: holds(t, "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk_live_", "sk_test_", "xox", "AIza", "eyJ", "-----BEGIN "),
    "opaque": lambda t: t.rlike(r"[A-Za-z0-9+/_-]{32}"),
}


def running_starts(lengths: Column) -> Column:
    """Where each piece begins, from the lengths of the pieces; in blocks, so long lists aren't copied for each element."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, n: a + n))

    def walk(items: Column, begin: Column) -> Column:
        zero = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, zero, lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")))["out"]

    return F.flatten(F.zip_with(blocks, walk(sums, F.lit(0)), walk))


NO_SPANS = "array<struct<start:int,order:int,end:int,kind:string,value:string>>"


def spans_of(text: Column, kind: str) -> Column:
    """Leftmost matches of a kind that don't overlap, without those of a too short value: array of (start, order, end, kind, value), in code points, end exclusive."""
    regex, group, least = KINDS[kind]
    marked = F.regexp_replace(F.translate(text, MARK, OTHER), regex, f"{MARK}$0{MARK}")
    pieces = F.split(marked, MARK, -1)  # gap, match, gap, match, ..., gap
    lengths = F.transform(pieces, F.length)
    at = F.arrays_zip(pieces.alias("t"), running_starts(lengths).alias("s"), lengths.alias("n"))
    matches = F.filter(at, lambda x, i: i % 2 == 1)
    order = list(KINDS).index(kind)
    value = (lambda t: F.regexp_extract(t, regex, group)) if group else (lambda t: t)
    out = F.transform(matches, lambda x: F.struct(x["s"].alias("start"), F.lit(order).alias("order"), (x["s"] + x["n"]).alias("end"), F.lit(kind).alias("kind"), value(x["t"]).alias("value")))
    out = F.filter(out, lambda x: F.length(x["value"]) >= least)
    if kind == "opaque":
        out = F.filter(out, lambda x: x["value"].rlike("[A-Z]") & x["value"].rlike("[a-z]") & x["value"].rlike("[0-9]"))
    return F.when(HINT[kind](text), out).otherwise(F.array().cast(NO_SPANS))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def ownership(found: DataFrame) -> DataFrame:
    """found(__value, __owner, __repo) -> (__value, __n, n_owners, n_repositories, __fate): rows, distinct owners and repositories of a value, and what they say."""
    counts = found.groupBy("__value", "__owner", "__repo").agg(F.count(F.lit(1)).alias("__n")).groupBy("__value", "__owner").agg(F.count(F.lit(1)).alias("r"), F.sum("__n").alias("__n"))
    counts = counts.groupBy("__value").agg(F.sum("__n").alias("__n"), F.count(F.lit(1)).alias("n_owners"), F.sum("r").alias("n_repositories"))
    copied = (F.col("n_owners") >= SHARED) | (F.col("n_repositories") >= COPIES)
    return counts.withColumn("__fate", F.when(copied, "copied").when(F.col("n_owners") == 1, "live").otherwise("few"))


def scan(df: DataFrame, owner: Column, repository: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: identifier, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, n_few (spans by their value's fate)."""
    rows = df.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"), null_safe_key(owner).alias("__owner"), null_safe_key(repository).alias("__repo"))
    hashed = lambda s: F.transform(s, lambda x: x.withField("value", F.sha2(x["value"], 256)))
    rows = rows.select("__id", "__owner", "__repo", *[hashed(spans_of(F.col("__text"), k)).alias(k) for k in KINDS])
    rows = checkpointed(rows).withColumn("__key", F.monotonically_increasing_id())  # a row's own number
    everything = F.concat(*[F.col(k) for k in KINDS])
    found = rows.filter(F.size(everything) > 0).select("__key", "__owner", "__repo", F.explode(everything).alias("__span")).withColumn("__value", F.col("__span.value"))
    judged = told(found.select("__key", "__span", "__value"), checkpointed(ownership(found)), ["__value"])
    judged = judged.filter((F.col("__span.kind") != "opaque") | (F.col("__fate") != "copied"))
    fates = ("live", "copied", "few")
    judged = judged.groupBy("__key").agg(F.collect_list("__span").alias("__all"), *[F.count_if(F.col("__fate") == f).alias(f"n_{f}") for f in fates])
    base = F.concat(*[F.col(k) for k in BASE])
    out = rows.join(judged, "__key", "left")
    n = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    return out.select(
        F.col("__id").alias(id_col),
        *[n(k) for k in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        F.coalesce(listed(F.col("__all")), F.lit("")).alias("spans"),
        *[F.coalesce(f"n_{f}", F.lit(0)).cast("long").alias(f"n_{f}") for f in fates],
    )
