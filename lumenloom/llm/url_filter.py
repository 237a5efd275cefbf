"""URL filtering by rules and by empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes (bad or not) are counted per host. Beta-binomial priors
shrink them from level to level: the whole set informs each suffix, the suffix
its registered domains, the domain its hosts. How strongly a level shrinks is
estimated from the spread of its groups (method of moments). A host is blocked
when a bound below its posterior bad rate is still over ``limit``.

A rule ``domain/path`` fits the domain and its subdomains when the url's path
starts with the rule's path; the longest fitting rule wins over the reputation.

Defined cases: a null url or one without ``://`` has an empty host and path, is
judged like a host without labels, and no rule fits it; outcomes that are null
or of unknown pages are ignored; a page listed twice is judged twice and its
outcome counts twice; with no outcomes at all everything not ruled is allowed;
other columns of either table are ignored.

Pages are counted per host before any shuffle by host, so a host with a third
of all pages costs one row per task. The table of hosts is broadcast when its
counted rows are few, else joined in salted form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.runtime import BROADCAST_ROW_LIMIT, broadcast_if_small

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: public suffixes of two labels that take a third label for a registered domain
SECOND_LEVEL = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "com.cn", "co.in", "co.kr", "co.za", "com.mx", "com.tr")
MIN_STRENGTH, MAX_STRENGTH = 1.0, 10_000.0
SALTS = 16


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def registered_domain(host: Column) -> Column:
    """Last two labels, or three under a two-label suffix; user and port are left out."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*SECOND_LEVEL), F.substring_index(name, ".", -3)).otherwise(two)


def suffix_of(domain: Column) -> Column:
    return F.when(F.instr(domain, ".") > 0, F.regexp_replace(domain, "^[^.]*[.]", "")).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct of the longest fitting rule and its verdict; null without one.

    ``rules`` is a short parameter list of (verdict, ``domain/path``).
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _strength(groups: DataFrame, level: str) -> DataFrame:
    """One row: how many labelled pages the prior of a level is worth."""
    s = groups.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("b"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("q")
    )
    p = F.col("b") / F.col("n")
    spread = (F.col("q") - F.col("b") * p) / (p * (1 - p)) - (F.col("k") - 1)
    room = F.col("n") - F.col("n2") / F.col("n") - (F.col("k") - 1)
    rho = F.when((room > 0) & (p > 0) & (p < 1), spread / room)
    strength = F.when(rho > 1 / (MAX_STRENGTH + 1), F.greatest(F.lit(MIN_STRENGTH), 1 / rho - 1)).otherwise(MAX_STRENGTH)
    return s.select(strength.cast("double").alias(level))


def reputation(pages: DataFrame, outcomes: DataFrame, page: str = "page_id", url: str = "url", bad: str = "bad", z: float = 1.645) -> DataFrame:
    """(host, bad_rate, bad_bound) of every host of ``pages``, labelled or not."""
    seen = pages.select(F.col(page).alias("_page"), host_of(F.col(url)).alias("host"))
    known = outcomes.select(F.col(page).alias("_page"), F.col(bad).cast("int").alias("_bad")).where("_page is not null and _bad is not null")
    counted = seen.join(known, "_page").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("_bad").alias("bad"))
    hosts = seen.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages")).join(counted, "host", "left")
    hosts = hosts.select("host", registered_domain(F.col("host")).alias("domain"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("domain")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # each is a single row from an aggregate without keys
    m = total.select(F.when(F.col("n") > 0, F.col("bad") / F.col("n")).otherwise(0.0).alias("m")).first()["m"]
    ks, kd, kh = (_strength(g.where("n > 0"), "k").first()["k"] or MAX_STRENGTH for g in (suffixes, domains, hosts))

    def posterior(prior: Column, strength: float) -> Column:
        return (prior * strength + F.col("bad")) / (strength + F.col("n"))

    top = suffixes.select("suffix", posterior(F.lit(m), ks).alias("of_suffix"))
    mid = domains.join(top, "suffix").select("domain", posterior(F.col("of_suffix"), kd).alias("of_domain"))
    mean = posterior(F.col("of_domain"), kh)
    sd = F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (kh + F.col("n") + 1))
    out = hosts.join(mid, "domain").withColumn("bad_rate", mean).withColumn("bad_bound", F.greatest(F.lit(0.0), F.col("bad_rate") - z * sd))
    return out.select("host", "bad_rate", "bad_bound")


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], page: str = "page_id", url: str = "url", bad: str = "bad", limit: float = 0.3, z: float = 1.645, broadcast_rows: int = BROADCAST_ROW_LIMIT
) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, bad_bound) of every page."""
    hosts = reputation(pages, outcomes, page, url, bad, z)
    parts = pages.select(F.col(page).alias(page), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    known = broadcast_if_small(hosts, broadcast_rows)
    if known is hosts:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        parts = parts.withColumn("_salt", F.pmod(F.xxhash64(page, "path"), F.lit(SALTS)).cast("int"))
        joined = parts.join(hosts.withColumn("_salt", salts), ["host", "_salt"])
    else:
        joined = parts.join(known, "host")
    ruled = joined.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("bad_bound") > limit, "block").otherwise("allow"))
    return ruled.select(page, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "bad_rate", "bad_bound")
