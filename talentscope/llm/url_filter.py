"""URL filter: host rules first, then empirical-Bayes host reputation.

Built-in SQL functions only. Labelled page outcomes (bad = 1, good = 0) are
counted per host and shrunk through a chain of beta-binomial priors: the whole
table -> public suffix -> registered domain -> host. Each level's prior has the
parent's posterior mean and a concentration estimated from the spread of that
level's units (moments of the beta-binomial). A page is blocked when the lower
``z``-bound of its host's bad rate lies above ``max_bad``.

Defined cases: NULL url or no ``://`` gives an empty host and path (one "host"
of its own, judged by its own outcomes); repeated rows give one result each; an
empty table gives an empty result; pages without labels only use the priors;
other columns of the inputs are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentscope.llm.common import ascii_lower

#: Rules are configuration, compiled into one CASE expression.
MAX_RULES = 500
#: Suffixes of two labels; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "com.au", "co.jp", "com.br")
Z = 1.645
MAX_BAD = 0.35
CONCENTRATION = (1.0, 10000.0)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host with A-Z lower-cased, path up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_columns(host: Column, path: Column,
                 rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest fitting rule, NULL if none fits. A rule
    (action, host, path) fits its host and all subdomains where the url's path
    starts with the rule's path; among equally long rules the longer host wins."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    rule = action = None
    for act, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, action)


def domain_columns(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host without user info and port."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    last2 = F.substring_index(name, ".", -2)
    two = last2.isin(*TWO_LABEL_SUFFIXES)
    suffix = F.when(two, last2).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(two, F.substring_index(name, ".", -3)).otherwise(last2)
    return domain, suffix


def _concentration(units: DataFrame) -> tuple[float, float]:
    """(overall rate, concentration) of units (n, k) by the beta-binomial's
    moments. One row of sums reaches the driver."""
    u = units.filter("n > 0")
    tot = u.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("u"),
                F.sum(F.col("n") * F.col("n").cast("double")).alias("nn"),
                F.sum(F.col("k") * F.col("k").cast("double") / F.col("n")).alias("kk")).first()
    lo, hi = CONCENTRATION
    if not tot["n"]:
        return 0.0, hi
    n, k, m = float(tot["n"]), float(tot["k"]), tot["u"]
    p = k / n
    spread = tot["kk"] - n * p * p           # sum of n (rate - p)^2
    free = n - tot["nn"] / n
    if m < 2 or p in (0.0, 1.0) or free <= m - 1:
        return p, hi
    rho = (spread - p * (1 - p) * (m - 1)) / (p * (1 - p) * (free - (m - 1)))
    return p, min(hi, max(lo, 1 / rho - 1)) if rho > 0 else hi


def host_reputation(hosts: DataFrame) -> DataFrame:
    """Posterior of each host's bad rate.

    ``hosts`` has one row per host: (host, n labelled pages, k bad ones). Returns
    (host, n, k, bad_mean, bad_low, bad_high)."""
    domain, suffix = domain_columns(F.col("host"))
    h = hosts.select("host", "n", "k", domain.alias("domain"), suffix.alias("suffix"))
    domains = h.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    root, c_suffix = _concentration(suffixes)
    c_domain, c_host = _concentration(domains)[1], _concentration(h)[1]

    def mean(prior: Column, c: float) -> Column:
        return (prior * c + F.col("k")) / (F.col("n") + c)

    s = suffixes.select("suffix", mean(F.lit(root), c_suffix).alias("s_mean"))
    d = (domains.join(s, "suffix")
         .select("domain", "suffix", mean(F.col("s_mean"), c_domain).alias("d_mean")))
    a = F.col("d_mean") * c_host + F.col("k")
    b = (1 - F.col("d_mean")) * c_host + F.col("n") - F.col("k")
    post = h.join(d, ["domain", "suffix"]).select("host", "n", "k", a.alias("a"), b.alias("b"))
    m = F.col("a") / (F.col("a") + F.col("b"))
    sd = F.sqrt(m * (1 - m) / (F.col("a") + F.col("b") + 1))
    return post.select("host", "n", "k", m.alias("bad_mean"),
                       F.greatest(F.lit(0.0), m - Z * sd).alias("bad_low"),
                       F.least(F.lit(1.0), m + Z * sd).alias("bad_high"))


def url_verdicts(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = (),
                 max_bad: float = MAX_BAD) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_labelled, bad_low) per row of
    ``pages`` (page_id, url). ``outcomes`` has (host, bad): one row per labelled
    page; NULL outcomes do not count."""
    host, path = split_url(F.col("url"))
    rule, action = rule_columns(F.col("host"), F.col("path"), rules)
    parsed = (pages.select("page_id", host.alias("host"), path.alias("path"))
              .select("*", rule.alias("rule"), action.alias("action")))
    counted = outcomes.filter("bad is not null").groupBy("host").agg(
        F.count("*").alias("n"), F.sum("bad").alias("k"))
    hosts = (parsed.select("host").distinct().join(counted, "host", "left")
             .select("host", F.coalesce("n", F.lit(0)).alias("n"),
                     F.coalesce("k", F.lit(0)).alias("k")))
    rep = host_reputation(hosts).select("host", F.col("n").alias("n_labelled"), "bad_low")
    judged = F.when(F.col("bad_low") > max_bad, "block").otherwise("allow")
    return parsed.join(rep, "host").select(
        "page_id", "host", "path", "rule", F.coalesce("action", judged).alias("verdict"),
        "n_labelled", "bad_low")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) per page whose url names a labelled document
    (``/<language>/<doc_id>...``); a document's label is the majority of its
    label rows, a tie counts as good."""
    host, path = split_url(F.col("url"))
    number = F.regexp_extract(path, r"^/[a-z]+/([0-9]{1,18})(?:[./]|$)", 1)
    named = pages.select(host.alias("host"),
                         F.nullif(number, F.lit("")).cast("bigint").alias("doc_id"))
    majority = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(
        (F.avg("quality") < 0.5).cast("int").alias("bad"))
    return named.filter("doc_id is not null").join(majority, "doc_id").select("host", "bad")
