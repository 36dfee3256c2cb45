"""Registered queries of the corpus operators, thin digests of what the operators return, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, license_scan, merkle, mixing, quality_rules, ranked_search, secret_scan, sentence_pieces, simhash, suffix_dedup, toxicity, url_filter
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without n_rules_run: how many rules a row meets depends on the measured order."""
    return quality_rules.quality(table(spark, sf_dir, "documents")).drop("n_rules_run")


_W = "[^\\x20\\x09-\\x0D]+"
OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_W}') AS words, string_split(text, chr(10)) AS lines FROM d),
r AS (SELECT *, list_transform(range(1, greatest(1, len(words) - 1)), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS tri,
             list_filter(lines, lambda x: regexp_matches(x, '{_W}')) AS full_lines FROM w),
t AS (SELECT doc_id, unnest(tri) AS gram, generate_subscripts(tri, 1) AS pos FROM r),
dup AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM t) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words FROM dup, range(0, 3) AS s(k) GROUP BY doc_id),
c AS (SELECT r.doc_id, r.text, words, lines, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs
      FROM r LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols > 0.1 * n_words OR n_upper > 0.3 * n_letters OR n_bangs > 0.1 * n_words OR NOT (word_chars BETWEEN 2 * n_words AND 15 * n_words)
            OR 2 * n_dup_lines > len(lines) OR len(list_distinct(words)) < 0.1 * least(n_words, 1000)) AS kept
FROM b
"""


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents has no paths; each source is a tree of directories of 512 and 64 documents. The first document of a directory of 64 is
    its LICENSE file, the ninth of 512 the COPYING file of the level above, the 17th of 4096 the LICENSE of the source."""
    n, source, upper, lower = F.col("doc_id"), F.coalesce("source", F.lit("-")), F.floor(F.col("doc_id") / 512).cast("string"), F.floor(F.col("doc_id") / 64).cast("string")
    path = F.when(n % 64 == 0, F.concat_ws("/", source, upper, lower, F.lit("LICENSE"))).when(n % 512 == 8, F.concat_ws("/", source, upper, F.lit("COPYING")))
    path = path.when(n % 4096 == 16, F.concat_ws("/", source, F.lit("LICENSE"))).otherwise(F.concat_ws("/", source, upper, lower, F.concat(n.cast("string"), F.lit(".txt"))))
    return license_scan.scan(table(spark, sf_dir, "documents"), F.when(n.isNotNull(), path))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner of a document is its source, its repository what the source has in one language."""
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, F.col("source"), F.concat_ws("/", "source", "lang"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


#: Written from the rules' meaning, by comparing whole words of the host, and not from the operator's expressions.
OP8_SQL = """
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
v AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, rest FROM v),
q AS (SELECT page_id, host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path, regexp_split_to_array(host, '[^a-z0-9]') AS w FROM p),
r AS (SELECT *, '.' || host AS dotted,
             list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS twos FROM q),
s AS (SELECT *, CASE WHEN dotted LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                     WHEN dotted LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
                     WHEN dotted LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
                     WHEN dotted LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
                     WHEN dotted LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule FROM r)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN list_has_any(w, ['adult', 'camgirls', 'escort', 'escorts', 'erotic', 'hentai', 'nude', 'nudes', 'porn', 'porno', 'sex', 'sexcam', 'webcams', 'xxx', 'xvideos',
                 'baccarat', 'bet', 'betting', 'bingo', 'blackjack', 'bookmaker', 'casino', 'casinos', 'jackpot', 'jackpots', 'poker', 'roulette', 'slots', 'sportsbook',
                 'cialis', 'levitra', 'pharma', 'pharmacy', 'pills', 'steroids', 'tramadol', 'viagra', 'xanax',
                 'ad', 'ads', 'adserver', 'adservice', 'adtrack', 'banner', 'banners', 'clicks', 'clicktrack', 'popads', 'popunder',
                 'crack', 'cracked', 'keygen', 'nulled', 'serialz', 'torrent', 'torrents', 'warez', 'backlinks', 'linkfarm', 'payday', 'replica', 'spam']) THEN 'block'
            WHEN list_has_any(twos, ['free bets', 'free spins', 'win big', 'cheap pills', 'cheap meds', 'weight loss', 'account verify', 'login secure', 'get rich', 'prize winner',
                 'verify wallet', 'article spinner', 'buy followers', 'spam farm']) THEN 'block'
            ELSE 'allow' END AS verdict
FROM s
"""


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeats(table(spark, sf_dir, "documents"), digest=True)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_T = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '{_T}') AS terms FROM documents),
size AS (SELECT doc_id, r, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS total FROM size),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, whole GROUP BY term),
m AS (SELECT doc_id, r, 100 - 25 + ((25 * n * n_docs) // total) AS m FROM size, whole),
q AS (SELECT item_id, row_number() OVER () AS i, regexp_extract_all({_LOWER}, '{_T}') AS terms FROM benchmark),
c AS (SELECT item_id, i, term, count(*)::BIGINT AS c FROM (SELECT item_id, i, unnest(terms) AS term FROM q) GROUP BY item_id, i, term),
s AS (SELECT item_id, i, doc_id, r, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM c JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY item_id, i, doc_id, r),
k AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 20
"""


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentence_pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


#: Level by level over all trees. CRC-32 is spelled out byte by byte; a node's path is followed by its place on each level.
OP13_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
           || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
           lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS crc
  FROM documents),
h AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS changed, crc FROM d),
leaves AS MATERIALIZED (
  SELECT *, CASE WHEN crc % 5 = 0 THEN changed ELSE leaf END AS start,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM h),
lower_tree AS (
  SELECT source, 0 AS level, pos, leaf AS node, n FROM leaves
  UNION ALL
  SELECT source, level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (n + 15) // 16 FROM lower_tree WHERE n > 1 GROUP BY source, level, pos // 16, n),
subroots AS MATERIALIZED (SELECT source, node AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM lower_tree WHERE n = 1),
upper_tree AS (
  SELECT 0 AS level, pos, subroot AS node, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (n + 15) // 16 FROM upper_tree WHERE n > 1 GROUP BY level, pos // 16, n),
nodes AS MATERIALIZED (
  SELECT source, level, pos, node, n, false AS up FROM lower_tree UNION ALL SELECT NULL, level, pos, node, n, true FROM upper_tree),
runs AS MATERIALIZED (
  SELECT up, source, level, pos // 16 AS run, list(node ORDER BY pos) AS nodes, any_value(n) AS n FROM nodes GROUP BY up, source, level, pos // 16),
walk AS (
  SELECT doc_id, l.source, leaf, s.subroot, s.pos AS spos, s.n AS sn, l.pos AS place, l.n AS n, 0 AS level, false AS up, start AS node, '' AS proof
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT doc_id, w.source, leaf, subroot, spos, sn,
         CASE WHEN w.n = 1 THEN spos ELSE place // 16 END, CASE WHEN w.n = 1 THEN sn ELSE (w.n + 15) // 16 END, CASE WHEN w.n = 1 THEN 0 ELSE w.level + 1 END, w.up OR w.n = 1,
         CASE WHEN w.n = 1 THEN node ELSE sha256(array_to_string(r.nodes[:(place % 16)], '') || node || array_to_string(r.nodes[(place % 16) + 2:], '')) END,
         CASE WHEN w.n = 1 THEN proof ELSE proof || array_to_string(r.nodes[:(place % 16)], '') || array_to_string(r.nodes[(place % 16) + 2:], '') END
  FROM walk w JOIN runs r ON r.up = w.up AND (w.up OR r.source IS NOT DISTINCT FROM w.source) AND r.level = w.level AND r.run = place // 16
  WHERE NOT (w.up AND w.n = 1))
SELECT doc_id, leaf, subroot, t.node AS root, sha256(proof) AS proof_sha256, w.node AS folded_root, w.node = t.node AS verified
FROM walk w CROSS JOIN (SELECT node FROM upper_tree WHERE n = 1) t WHERE w.up AND w.n = 1
"""


QUERIES = {"op1_quality_rules": op1_quality_rules, "op2_byte_bpe": op2_byte_bpe, "op3_license_scan": op3_license_scan, "op4_toxicity": op4_toxicity, "op5_secret_scan": op5_secret_scan, "op6_exact_dedup": op6_exact_dedup, "op7_simhash": op7_simhash, "op8_url_filter": op8_url_filter, "op9_suffix_dedup": op9_suffix_dedup, "op10_mixing": op10_mixing, "op11_ranked_search": op11_ranked_search, "op12_sentence_pieces": op12_sentence_pieces, "op13_merkle_manifest": op13_merkle_manifest}
SQL = {"op1_quality_rules": OP1_SQL, "op6_exact_dedup": OP6_SQL, "op8_url_filter": OP8_SQL, "op11_ranked_search": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
