"""URL filter: pattern rules indexed by their rarest literal token (DataFrame operations only).

A rule is a pattern over ``host + path`` with an action:

``||``  at the start: the pattern begins at the start of the host or after a dot in it
``*``   any characters
``^``   one separator (anything but ASCII letters, digits and non-ASCII), or the start or the end

Rules are a table of any size. Unless a rule says otherwise (``fold``), A-Z match a-z in it. A URL is cut into tokens: maximal
runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. The literal tokens of a rule are the runs that the
pattern bounds on both sides, so any URL that fits holds each of them as a token. Every rule is filed under the one that the
URLs at hand hold least often; a URL meets a rule's regular expression only if it holds that token. Rules without a
literal token are filed under the empty token, which every URL then holds.

Of several rules that fit, the higher tier wins, then the longer pattern, then ``allow``, then the pattern
that sorts first. URLs that are null or have no ``://`` have an empty host and path and fit no rule. Rules with a null
pattern or action are none. Rows are kept one for one, repeated rows and null ids included.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, but, col, cut, hot_join, packed, table, unpacked

SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A separator in a pattern that isn't a star, on either side of a literal token.
_BOUND = r"[\x00-\x29\x2B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Above this many bytes of rules the index is joined by a shuffle.
BROADCAST_BYTES = 8 << 20


@dataclass(frozen=True)
class Rule:
    pattern: str
    action: str
    name: str | None = None
    tier: int = 0
    fold: bool = True


#: Words that mark a site or a page as unwanted when they stand alone in host or path.
UNWANTED = ("casino", "poker", "betting", "jackpot", "porn", "xxx", "viagra", "warez")
DEFAULT_RULES = tuple(Rule(f"^{word}^", "block") for word in UNWANTED)


def site_rule(site: str, action: str, tier: int = 1) -> Rule:
    """``host/path``: the host and its subdomains, with paths that start with the rule's."""
    return Rule("||" + site, action, site, tier, fold=False)


def rule_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """(pattern, action, name, tier, fold) of rules."""
    return spark.createDataFrame([astuple(r) for r in rules], "pattern string, action string, name string, tier int, fold boolean")


def literal_tokens(pattern: Column) -> Column:
    """The runs of a pattern that are bounded on both sides, lower-cased."""
    body = F.when(F.startswith(pattern, F.lit("||")), F.concat(F.lit("/"), F.substring(pattern, F.lit(3), F.lit(1 << 30)))).otherwise(pattern)
    return F.array_distinct(F.regexp_extract_all(ascii_lower(body), F.lit(f"(?<={_BOUND})({TOKEN})(?={_BOUND})"), F.lit(1)))


def regex_of(pattern: Column, fold: Column) -> Column:
    """For Java's matcher, to be found anywhere in host + path."""
    site = F.startswith(pattern, F.lit("||"))
    body = F.when(site, F.substring(pattern, F.lit(3), F.lit(1 << 30))).otherwise(pattern)
    body = F.regexp_replace(body, r"([\x00-\x29\x2B-\x2F\x3A-\x40\x5B-\x5D\x5F\x60\x7B-\x7F])", r"\\$1")
    body = F.replace(F.replace(body, F.lit("*"), F.lit("(?s:.*)")), F.lit("^"), F.lit(f"(?:{SEPARATOR}|^|$)"))
    return F.concat(F.when(fold, "(?i)").otherwise(""), F.when(site, r"^(?:[^/]*\.)?").otherwise(""), body)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased. Path: from there up to ``? #``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens_of(target: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(ascii_lower(F.col(target)), F.lit(f"({TOKEN})"), F.lit(1)))


def token_index(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """(token, regex, best) of the rules, filed under their rarest token over all targets, the empty one if they have none; written."""
    rules = rules.where("pattern IS NOT NULL AND action IS NOT NULL").distinct()
    order = F.struct(F.coalesce("tier", F.lit(0)).alias("tier"), F.char_length("pattern").alias("length"), (F.col("action") == "allow").alias("allows"), "pattern", "name", "action")
    rules = cut(rules.select("pattern", regex_of(F.col("pattern"), F.coalesce("fold", F.lit(True))).alias("regex"), order.alias("best"), F.explode_outer(literal_tokens(F.col("pattern"))).alias("token")))
    words = rules.where("token IS NOT NULL").select("token").distinct()
    small = (words.agg(F.sum(F.octet_length("token") + 16)).collect()[0][0] or 0) <= BROADCAST_BYTES
    seen = targets.select(F.explode(tokens_of("target")).alias("token")).join(F.broadcast(words) if small else words, "token").groupBy("token").agg(F.count("*").alias("n"))
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), -F.char_length("token"), "token")
    filed = rules.join(seen, "token", "left").groupBy("regex", "best").agg(F.min_by("token", rarity).alias("token"))
    return cut(filed.select(F.coalesce("token", F.lit("")).alias("token"), "regex", "best"))


def judge(df: DataFrame, rules: DataFrame | Iterable[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (the name of the rule that decides, if it has one) and ``verdict``.

    rules: (pattern, action, name, tier, fold). Columns of ``df`` that have one of the four names, in any case, are replaced.
    """
    rules = rules if isinstance(rules, DataFrame) else rule_table(df.sparkSession, rules)
    names = but(df, "host", "path", "rule", "verdict")
    host, path = host_and_path(col(url))
    rows = df.select(packed(df, names).alias("kept"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("target", F.when((F.col("host") != "") | (F.col("path") != ""), F.concat("host", "path")))
    targets = rows.where("target IS NOT NULL").select("target")
    index = token_index(targets, rules)
    size = index.agg(F.sum(F.octet_length("regex") + F.octet_length(F.col("best.pattern")) + 64), F.max(F.col("token") == "")).collect()[0]
    tokens = F.concat(tokens_of("target"), F.array(F.lit(""))) if size[1] else tokens_of("target")
    fits = targets.withColumn("token", F.explode(tokens)).join(F.broadcast(index) if (size[0] or 0) <= BROADCAST_BYTES else index, "token").where(F.expr("target rlike regex"))
    best = cut(fits.groupBy("target").agg(F.max("best").alias("best"), F.count("*").alias("n")))
    joined = hot_join(rows, best, "target", "best")
    return joined.select(*unpacked("kept", names), "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


#: The rules of the corpus query: site rules over the method's own.
SITE_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = (*(site_rule(site, action) for site, action in SITE_RULES), *DEFAULT_RULES)
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


_WORDS = "|".join(UNWANTED)
_SITES = "\n".join(f"      WHEN ({' OR '.join(f(*site.split('/', 1)) for f in (lambda h, p: f'host = {h!r}', lambda h, p: f'ends_with(host, {chr(39)}.{h}{chr(39)})'))}) AND starts_with(path, '/{site.split('/', 1)[1]}') THEN '{site}'" for site, _ in sorted(SITE_RULES, key=lambda r: -len(r[0])))
ORACLE = f"""
WITH cut AS (SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE
{_SITES}
      END AS rule FROM split)
SELECT page_id, host, path, rule, CASE
      WHEN rule IN ({', '.join(repr(s) for s, a in SITE_RULES if a == 'allow')}) THEN 'allow'
      WHEN rule IS NOT NULL THEN 'block'
      WHEN regexp_matches(host || translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^A-Za-z0-9\\x{{80}}-\\x{{10FFFF}}])({_WORDS})([^A-Za-z0-9\\x{{80}}-\\x{{10FFFF}}]|$)') THEN 'block'
      ELSE 'allow' END AS verdict
FROM ruled"""
