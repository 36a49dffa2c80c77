"""URL filter: explicit rules, then empirical-Bayes host reputation.

Outcomes of labelled pages (bad or not) are counted per host, registered
domain and suffix.  Each level's rate is shrunk towards its parent's by a
beta prior whose strength is estimated from the spread between the groups of
that level (beta-binomial moments).  A page is blocked when the lower
posterior bound of its host's bad rate exceeds the base rate of all labelled
pages by a factor.  DataFrame expressions only.

Defined cases: a null url or one without ``://`` has an empty host and path
and is judged as the host ''; user, port and a final dot belong to the host
that is returned, but not to the name that is judged; an address in numbers
or brackets is its own domain and suffix; a host without a dot is its own
domain and suffix; a host without a labelled page is judged by its domain's rate, else
its suffix's, else the base rate; no outcomes at all give the flat prior and
allow, without a bound; a page labelled
twice counts once, as bad if any label is; null labels count for nothing;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexicarta.llm.common import ascii_lower

#: (action, host and path prefix).
Rules = Sequence[tuple[str, str]]

#: Suffixes of two labels known besides plain last labels: fixed values.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk",
                      "org.uk")


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, else null."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, prefix = text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + prefix))
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def host_name(host: Column) -> Column:
    """The name or address in a host: without user, port and final dot."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    return F.regexp_replace(bare, r"\.$", "")


def host_levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a name; an address is both itself."""
    address = host.rlike(r"^[0-9]+(\.[0-9]+){3}$") | F.startswith(host, F.lit("["))
    domain, suffix = _name_levels(host)
    return F.when(address, host).otherwise(domain), F.when(address, host).otherwise(suffix)


def _name_levels(host: Column) -> tuple[Column, Column]:
    last2 = F.substring_index(host, ".", -2)
    two = last2.isin(*TWO_LABEL_SUFFIXES) & (F.substring_index(host, ".", -3) != last2)
    suffix = F.when(two, last2).otherwise(F.substring_index(host, ".", -1))
    return F.when(two, F.substring_index(host, ".", -3)).otherwise(last2), suffix


def _strength(groups: DataFrame) -> float:
    """Prior strength of one level: groups(n, bad, parent) by moments.

    E[n (rate - p)^2] = p (1 - p) (1 + (n - 1) rho) and strength = 1/rho - 1,
    held between 1 and 999."""
    p = F.col("parent")
    row = groups.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - p, 2) - p * (1 - p)).alias("over"),
        F.sum((F.col("n") - 1) * p * (1 - p)).alias("room")).first()
    rho = row.over / row.room if row.room else 0.0
    return 1 / min(0.5, max(0.001, rho)) - 1


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """``outcomes(host, bad)``, one row per page, ``bad`` null where it has no
    label: (host, n, bad, rate, low, base) with the posterior mean and its
    lower bound, of every host, and the base rate; hosts without a label
    (n = 0) weigh nothing.

    Counts are pre-aggregated; every further step is one row per host,
    domain or suffix.  Only four numbers come to the driver."""
    rate = lambda strength: (F.lit(strength) * F.col("parent") + F.col("bad")) / (F.lit(strength) + F.col("n"))
    domain, suffix = host_levels(F.col("host"))
    hosts = (outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("bigint")), F.lit(0)).alias("bad"))
             .withColumn("domain", domain).withColumn("suffix", suffix))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    base = ((total.bad or 0) + 0.5) / ((total.n or 0) + 1.0)

    def level(key: str, parents: DataFrame | None, up: str | None) -> tuple[DataFrame, float]:
        keys = [key] if up is None else [key, up]
        groups = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        groups = (groups.withColumn("parent", F.lit(base)) if parents is None
                  else groups.join(parents.select(up, F.col("rate").alias("parent")), up))
        strength = _strength(groups)
        return groups.withColumn("rate", rate(strength)), strength

    suffixes, _ = level("suffix", None, None)
    domains, _ = level("domain", suffixes, "suffix")
    found, strength = level("host", domains, "domain")
    weight = F.lit(strength) + F.col("n")
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (weight + 1))
    low = F.when(F.lit(bool(total.n)), F.col("rate") - F.lit(z) * spread)
    return found.select("host", "n", "bad", "rate", low.alias("low"), F.lit(base).alias("base"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Rules, excess: float = 1.0, z: float = 1.645,
                id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, low).  ``outcomes(page_id, bad)``.
    A host is blocked when its lower bound exceeds ``excess`` times the base
    rate.

    The pages meet their host's row in an equi-join; a hot host is a skewed
    key that adaptive execution splits on the side of the pages."""
    urls = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    known = outcomes.where("bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    urls = urls.withColumn("name", host_name(F.col("host")))
    judged = urls.select("page_id", "name").distinct().join(known, "page_id", "left").select(F.col("name").alias("host"), "bad")
    reputation = host_reputation(judged, z)
    rule, action = rule_columns(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("low") > F.lit(excess) * F.col("base"), "block").otherwise("allow")
    return (urls.join(reputation.select(F.col("host").alias("name"), "low", "base"), "name", "left")
            .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, method).alias("verdict"), "low"))
