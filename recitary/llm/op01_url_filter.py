"""URL filter: a weighted vocabulary counted by an Aho-Corasick automaton, with
host and path rules that overrule it.

Edge cases. A null url, or one without "://", has an empty host and path, fits no
rule and is allowed with no hits counted for null; terms in a schemeless url still
count. Urls of any length are read whole. Terms that end at one place all count; a term counts
once a url. Empty tables give empty results; repeated rows are judged row by row; other
columns of the input pass through, and those named like a new one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules as (action, host suffix, path prefix), and the vocabulary.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
STRICT = (
    "bukkake", "camgirl", "camgirls", "casino", "casinos", "cialis", "escort", "escorts", "gangbang", "hardcoresex", "hentai", "jackpot",
    "jackpots", "keygen", "malware", "milf", "nudes", "onlinecasino", "phishing", "porn", "porno", "pornhub", "ransomware", "roulette",
    "sexcam", "sexchat", "sexshop", "sportwetten", "spyware", "viagra", "warez", "xxx",
)
SOFT = (
    "ad", "ads", "adult", "adults", "bet", "bets", "betting", "bonus", "cheap", "click", "clickbait", "clicks", "coupon", "coupons", "crack",
    "dating", "deal", "deals", "discount", "earn", "free", "gamble", "gambling", "hot", "loan", "loans", "lottery", "nude", "payday", "pills",
    "poker", "prize", "promo", "sexy", "slots", "spam", "sponsored", "torrent", "track", "tracker", "tracking", "win", "winner", "wins",
)
#: Distinct terms of this total weight block a url: one strict term, or SOFT_LIMIT soft ones.
SOFT_LIMIT = 2
VOCABULARY = {**dict.fromkeys(SOFT, 1.0), **dict.fromkeys(STRICT, float(SOFT_LIMIT))}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path:
    from there up to ? # or the end. Both empty without :// or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    return (
        F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit("")),
        F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")),
    )


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct<rule, action>, null where none fits. A rule
    list is code-sized; it becomes one CASE, longest first."""
    out = None
    for action, suffix, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        value = F.struct(F.lit(suffix + prefix).alias("rule"), F.lit(action).alias("action"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,action:string>")


def load_vocabulary(table: DataFrame, term: str = "term", weight: str = "weight") -> dict[str, float]:
    """A vocabulary from a table: lower-cased terms with their greatest weights; rows without a term or a
    weight are left out. The automaton is built on every worker, so the terms must fit there."""
    rows = table.where(f"{term} <> '' AND {weight} IS NOT NULL").select(F.translate(term, UPPER, LOWER).alias("t"), F.col(weight).cast("double").alias("w"))
    return {r["t"]: r["w"] for r in rows.groupBy("t").agg(F.max("w").alias("w")).toLocalIterator()}


def term_counter(vocabulary: dict[str, float], strict: float = SOFT_LIMIT):
    """Arrow UDF: url -> strict_hits and soft_hits, the distinct terms of weight `strict` or more and of
    less that occur with no ASCII letter or digit on either side, and their total weight. One
    automaton per task, one pass per url, however long."""

    @F.pandas_udf("struct<strict_hits:long,soft_hits:long,weight:double>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        auto = ahocorasick.Automaton()
        for t, w in vocabulary.items():
            auto.add_word(t, (t, w))
        if vocabulary:
            auto.make_automaton()

        def edge(s: str, i: int) -> bool:
            return not (0 <= i < len(s) and s[i].isascii() and s[i].isalnum())

        def hits(url) -> tuple[int, int, float]:
            s = url.translate(fold) if isinstance(url, str) and vocabulary else ""
            found = {v for end, v in auto.iter(s) if edge(s, end + 1) and edge(s, end - len(v[0]))} if s else set()
            n = sum(w >= strict for _, w in found)
            return n, len(found) - n, float(sum(w for _, w in found))

        fold = str.maketrans(UPPER, LOWER)
        for urls in batches:
            yield pd.DataFrame([hits(u) for u in urls], columns=["strict_hits", "soft_hits", "weight"]).astype({"strict_hits": "int64", "soft_hits": "int64", "weight": "float64"})

    return count


def filter_urls(df: DataFrame, url: str = "url", rules=RULES, vocabulary: dict[str, float] | None = None, limit: float = SOFT_LIMIT) -> DataFrame:
    """Adds host, path, rule, verdict, strict_hits, soft_hits and weight. A rule decides where one
    fits; otherwise distinct terms of the vocabulary block whose weights reach the limit together."""
    host, path = host_path(F.col(url))
    vocabulary = VOCABULARY if vocabulary is None else vocabulary
    out = df.withColumns({"host": host, "path": path, "__terms": term_counter(vocabulary, limit)(F.col(url))})
    out = out.withColumn("__rule", rule_column(F.col("host"), F.col("path"), rules))
    return out.withColumns(
        {
            "rule": F.col("__rule.rule"),
            "verdict": F.coalesce(F.col("__rule.action"), F.when(F.col("__terms.weight") >= limit, "block").otherwise("allow")),
            "strict_hits": F.col("__terms.strict_hits"),
            "soft_hits": F.col("__terms.soft_hits"),
            "weight": F.col("__terms.weight"),
        }
    ).drop("__terms", "__rule")


def query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits")


def oracle() -> str:
    low = f"translate(coalesce(url, ''), '{UPPER}', '{LOWER}')"
    hit = lambda terms: " + ".join(f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS BIGINT)" for t in terms)
    cases = " ".join(
        f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{a} {h}{p}'"
        for a, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    return f"""
WITH split AS (
  SELECT page_id, {low} AS u,
         coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest
  FROM pages),
parts AS (
  SELECT page_id, u, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
judged AS (
  SELECT *, CASE {cases} END AS hit, {hit(STRICT)} AS strict_hits, {hit(SOFT)} AS soft_hits FROM parts)
SELECT page_id, host, path, substr(hit, instr(hit, ' ') + 1) AS rule,
       coalesce(substr(hit, 1, instr(hit, ' ') - 1),
                CASE WHEN strict_hits > 0 OR soft_hits >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       strict_hits, soft_hits
FROM judged"""
