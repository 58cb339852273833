"""URL filters: pattern rules indexed by their rarest literal token.

Every rule names literal tokens (runs of ASCII letters and digits) that each
URL it fits must hold as whole tokens.  The rarest of them over all URLs
becomes the rule's key; the tokens of a URL fetch the rules filed under them,
and only those run their regular expression.  DataFrame functions only.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut, keep_columns, lower_ascii, prepare


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs on the URL after ``://`` with its host in lower case.
    ``named`` rules (a host and a path prefix) outrank the others; the
    longest one wins."""
    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    named: bool = False


def site_rule(verdict: str, site: str) -> Rule:
    """A rule for a host with its subdomains and a path prefix: ``host/path``."""
    host, _, path = site.partition("/")
    literal = f"{host}/{path}"
    # the last token of a prefix may go on in the URL: it is no whole token
    tokens = re.findall(r"[a-z0-9]+(?=[^A-Za-z0-9])", literal.lower())
    return Rule(literal, verdict, r"^(?:[^/?#]*\.)?" + re.escape(host.lower()) + "/" + re.escape(path),
                tuple(dict.fromkeys(tokens)), True)


SITE_RULES = (site_rule("allow", "org/"), site_rule("block", "example.org/es/"),
              site_rule("block", "example.org/en/1"), site_rule("allow", "com/fr/"),
              site_rule("block", "com/de/"))

#: The method's own verdict where no site rule fits: block what one of these
#: fits (advertising and tracking hosts, sessions, log-in and cart pages,
#: feeds, archives), allow the rest.
PATTERN_RULES = (
    Rule("ads", "block", r"^(?:[^/?#]*\.)?(?:ads|adserver)\.", ("ads",)),
    Rule("adserver", "block", r"^(?:[^/?#]*\.)?adserver\.", ("adserver",)),
    Rule("doubleclick", "block", r"^(?:[^/?#]*\.)?doubleclick\.net(?:[/?#]|$)", ("doubleclick", "net")),
    Rule("session", "block", r"[?&](?i:sessionid)=[A-Za-z0-9]{8,}", ("sessionid",)),
    Rule("login", "block", r"/login(?:[/?#.]|$)", ("login",)),
    Rule("cart", "block", r"/cart(?:[/?#.]|$)", ("cart",)),
    Rule("feed", "block", r"[?&]utm_source=feed(?:[&#]|$)", ("utm", "source", "feed")),
    Rule("archive", "block", r"\.zip(?:[?#]|$)", ("zip",)),
)


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null or without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(rest: Column) -> Column:
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.split(lower_ascii(c), "[^a-z0-9]+"))


def _rule_table(spark, rules: Sequence[Rule]) -> DataFrame:
    rows = [F.struct(F.lit(k).alias("_llm_rule"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("says"),
                     F.lit(r.pattern).alias("pattern"), F.lit(r.named).alias("named"),
                     F.array(*[F.lit(t) for t in r.tokens or ("",)]).alias("tokens")) for k, r in enumerate(rules)]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def filter_urls(pages: DataFrame, url_col: str = "url", rules: Sequence[Rule] = (*SITE_RULES, *PATTERN_RULES),
                default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (the longest named rule that fits,
    else null) and ``verdict`` to every row.

    Without a named rule the verdict is ``block`` if any other rule that
    fits says so, else ``default``.  A null URL or one without ``://`` has
    an empty host and path, no rule and the default verdict.  Each distinct
    URL is judged once; repeated rows stay; input columns named like an
    output are replaced; ties of length go to the greater rule name.
    """
    spark = pages.sparkSession
    prepare(spark)
    new = ["host", "path", "rule", "verdict"]
    url = F.col(f"`{url_col}`")
    rest = after_scheme(url)

    judged = (pages.select(url.alias("_llm_url"), rest.alias("rest")).filter(F.col("rest") != "").distinct()
              .select("_llm_url", F.concat(host_of(F.col("rest")), F.expr(
                  "substr(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1)")).alias("subject")))
    tokens = judged.select("_llm_url", "subject", F.explode(
        F.array_union(_tokens(F.col("subject")), F.array(F.lit("")))).alias("token"))

    # corpus frequency of the rules' tokens only, over all distinct URLs
    listed = _rule_table(spark, rules)
    wanted = listed.select("_llm_rule", F.explode("tokens").alias("token"))
    seen = (tokens.join(F.broadcast(wanted.select("token").distinct()), "token", "left_semi")
            .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    rarest = (wanted.join(seen, "token", "left")
              .groupBy("_llm_rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token")))
    # the index holds one row per rule of the caller's list: broadcast is as
    # large as that list, never as the pages
    index = listed.drop("tokens").join(rarest, "_llm_rule")
    fits = tokens.join(F.broadcast(index), "token").filter(F.expr("subject rlike pattern"))
    best = fits.groupBy("_llm_url").agg(
        F.max(F.when(F.col("named"), F.struct(F.length("name").alias("n"), F.col("name").alias("rule"), "says"))).alias("best"),
        F.max(F.when(~F.col("named"), F.col("says") == "block")).alias("blocked"))
    best = cut(best.select("_llm_url", F.col("best.rule").alias("rule"), F.coalesce(
        F.col("best.says"), F.when(F.col("blocked"), F.lit("block"))).alias("says")))
    return (pages.select(*keep_columns(pages, new), host_of(rest).alias("host"), path_of(rest).alias("path"),
                         url.alias("_llm_key"))
            .join(best, F.col("_llm_key") == F.col("_llm_url"), "left")
            .withColumn("verdict", F.coalesce("says", F.lit(default)))
            .drop("_llm_key", "_llm_url", "says"))


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: The same result in DuckDB: every rule against every URL.
ORACLE = f"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
  SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         substr(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1) AS tail FROM p),
rules(host_, path_, says) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
j AS (
  SELECT q.*, (SELECT arg_max(host_ || path_ || ' ' || says, length(host_ || path_)) FROM rules
    WHERE (q.host = host_ OR ends_with(q.host, '.' || host_)) AND starts_with(q.path, path_)) AS best FROM q)
SELECT page_id, host, path, split_part(best, ' ', 1) AS rule,
  CASE WHEN best IS NOT NULL THEN split_part(best, ' ', 2)
       WHEN {' OR '.join(f'regexp_matches(host || tail, {_quote(r.pattern)})' for r in PATTERN_RULES)} THEN 'block'
       ELSE 'allow' END AS verdict
FROM j"""
