"""URL filters: rules indexed by their rarest literal token.

A rule is a regular expression over host + path with the literal tokens that any match must contain. The index keeps each
rule under the one of its tokens that is rarest in the corpus of URLs (counted over all rows). Distinct URLs are cut into
tokens, the tokens fetch candidate rules by an equi-join, and only candidates run their regular expression. The rule
list is given by the caller on the driver, so the index side has as many rows as the list and is broadcast up to
MOST_BROADCAST rules; of longer lists only the rules under tokens of very many URLs are broadcast, and the other URLs meet
their rules by token (common.told). DataFrame functions only.

Defined results: a null URL, or one without ://, has empty host and path, fits no rule and is allowed; repeated rows each
get their row; URLs of any length are read whole; other columns are never read; an empty table, or an empty list of rules, gives
the same columns (no rows, or every URL allowed).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_of, told

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_BROADCAST = 20_000


@dataclass(frozen=True)
class Rule:
    """name: what is reported; rank: of the rules that fit, the largest decides; given: whether it is reported as the rule."""

    name: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    rank: int
    given: bool


def host_rule(host: str, path: str, action: str) -> Rule:
    """A rule for a host and its subdomains whose path begins with path."""
    whole = re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)
    return Rule(host + path, action, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(dict.fromkeys(re.findall(r"[A-Za-z0-9]+", host) + whole)), len(host + path), True)


def word_rule(topic: str, word: str) -> Rule:
    """A rule for hosts that have word as a whole token."""
    return Rule(f"{topic}:{word}", "block", rf"^(?:[^/]*[^/a-z0-9])?{word}(?:[^/a-z0-9][^/]*)?(?:/|$)", (word,), 0, False)


def phrase_rule(topic: str, first: str, second: str) -> Rule:
    """A rule for hosts that have two words side by side, with one mark between them."""
    return Rule(f"{topic}:{first}-{second}", "block", rf"^(?:[^/]*[^/a-z0-9])?{first}[^/a-z0-9]{second}(?:[^/a-z0-9][^/]*)?(?:/|$)", (first, second), 0, False)


#: The rules of the production query.
GIVEN = [host_rule("com", "/", "allow"), host_rule("example.com", "/en/", "block"), host_rule("www.example.com", "/en/", "allow"), host_rule("net", "/es/", "block"), host_rule("net", "/fr/", "block")]
#: Words of hosts by topic that a text corpus leaves out.
TOPICS = {
    "adult": ["adult", "camgirls", "escort", "escorts", "erotic", "hentai", "nude", "nudes", "porn", "porno", "sex", "sexcam", "webcams", "xxx", "xvideos"],
    "gambling": ["baccarat", "bet", "betting", "bingo", "blackjack", "bookmaker", "casino", "casinos", "jackpot", "jackpots", "poker", "roulette", "slots", "sportsbook"],
    "pills": ["cialis", "levitra", "pharma", "pharmacy", "pills", "steroids", "tramadol", "viagra", "xanax"],
    "advertising": ["ad", "ads", "adserver", "adservice", "adtrack", "banner", "banners", "clicks", "clicktrack", "popads", "popunder"],
    "piracy": ["crack", "cracked", "keygen", "nulled", "serialz", "torrent", "torrents", "warez"],
    "spam": ["backlinks", "linkfarm", "payday", "replica", "spam"],
}
#: Two words side by side.
PHRASES = {
    "gambling": [("free", "bets"), ("free", "spins"), ("win", "big")],
    "pills": [("cheap", "pills"), ("cheap", "meds"), ("weight", "loss")],
    "fraud": [("account", "verify"), ("login", "secure"), ("get", "rich"), ("prize", "winner"), ("verify", "wallet")],
    "spam": [("article", "spinner"), ("buy", "followers"), ("spam", "farm")],
}
PATTERNS = [word_rule(t, w) for t, words in TOPICS.items() for w in words] + [phrase_rule(t, a, b) for t, pairs in PHRASES.items() for a, b in pairs]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_index(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """(token, name, action, regex, rank, given, __n): each rule under its rarest token in urls(__tokens), and how many URLs have that token."""
    spark = urls.sparkSession
    own = spark.createDataFrame([(r.name, r.action, r.regex, list(r.tokens), r.rank, r.given) for r in rules], "name string, action string, regex string, tokens array<string>, rank int, given boolean")
    wanted = own.select("name", F.explode("tokens").alias("token"))
    seen = urls.select(F.explode("__tokens").alias("token")).join(F.broadcast(wanted.select("token").distinct()) if len(rules) <= MOST_BROADCAST else wanted.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rarest = wanted.join(seen, "token", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).cast("long").alias("n"), "token")).alias("b"))
    return own.join(rarest, "name").select("b.token", "name", "action", "regex", "rank", "given", F.col("b.n").alias("__n"))


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[Rule] | None = None) -> DataFrame:
    """One row per row of df: identifier, host, path, rule, verdict, n_candidates (rules whose expression ran)."""
    rules = GIVEN + PATTERNS if rules is None else rules
    urls = df.select(text_of(url_col).alias("__url")).distinct()
    urls = urls.select("__url", F.concat(host_of(F.col("__url")), path_of(F.col("__url"))).alias("__at"))
    urls = urls.withColumn("__tokens", F.array_distinct(F.split("__at", "[^A-Za-z0-9]+")))
    index = rule_index(urls, rules)
    held = urls.select("__url", "__at", F.explode("__tokens").alias("token"))
    found = held.join(F.broadcast(index), "token") if len(rules) <= MOST_BROADCAST else told(held, checkpointed(index), ["token"])
    found = found.withColumn("__fits", F.expr("__at rlike regex"))
    best = F.max(F.when(F.col("__fits") & F.col("given"), F.struct("rank", "name", "action")))
    found = found.groupBy("__url").agg(best.alias("__best"), F.max(F.col("__fits") & ~F.col("given")).alias("__hit"), F.count(F.lit(1)).alias("n_candidates"))
    rows = df.select(F.col(id_col).alias("__id"), text_of(url_col).alias("__url"))
    verdict = F.coalesce(F.col("__best.action"), F.when(F.col("__hit"), F.lit("block")), F.lit("allow"))
    return rows.join(found, "__url", "left").select(F.col("__id").alias(id_col), host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"), F.col("__best.name").alias("rule"), verdict.alias("verdict"), F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"))
