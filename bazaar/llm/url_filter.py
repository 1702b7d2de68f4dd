"""URL filters: allow and block rules by host and path, else the reputation of the host.

Reputation is empirical Bayes: the share of bad pages of a host is shrunk
towards its registered domain's, that towards its suffix's, and that towards
the share over all labelled pages.  How strongly each level shrinks is
estimated from the spread of the groups of that level (beta-binomial, method
of moments).  A host is blocked when the lower posterior bound of its share
of bad pages passes a limit.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.llm.common import cut

#: Public suffixes of more than one label known by default (fixed values; pass your own list for others).
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "org.uk")

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Parts that a host's pages are dealt to where they meet the blocked hosts: no host has to fit a task.
PARTS = 32

#: Least and greatest overdispersion a level may get: prior strengths from 1 to 9,999 pages.
RHO = (0.0001, 0.5)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _UPPER.lower())


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def _suffix_pattern(suffixes: Sequence[str]) -> str:
    return "|".join([s.replace(".", r"\.") for s in suffixes] + [r"[^.]*"])


def url_suffix(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The longest listed public suffix of a host, else its last label; an IPv4 address is its own."""
    return (F.when(host.rlike(r"^[0-9.]+(:[0-9]+)?$"), host)
            .otherwise(F.regexp_extract(host, rf"(?:^|\.)({_suffix_pattern(suffixes)})$", 1)))


def registered_domain(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The suffix and one label before it; a host without such a label is its own."""
    found = F.regexp_extract(host, rf"(?:^|\.)([^.]*\.(?:{_suffix_pattern(suffixes)}))$", 1)
    return F.when(host.rlike(r"^[0-9.]+(:[0-9]+)?$") | (found == ""), host).otherwise(found)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, null if none fits.

    ``rules`` are (verdict, "host/path") pairs, a caller's list that is part
    of the plan.  A rule fits its host and all subdomains where the path
    starts with the rule's.  Of equally long rules that fit, the one with
    the longer host wins, then the first by verdict and text.
    """
    ranked = sorted(set(rules), key=lambda r: (-len(r[1]), -r[1].index("/"), r))
    chain = None
    for verdict, rule in ranked:
        name, prefix = rule[:rule.index("/")], rule[rule.index("/"):]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, hit) if chain is None else chain.when(fits, hit)
    return chain if chain is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_outcomes(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(host, domain, suffix, n, bad) of every host with labelled pages.

    ``outcomes`` holds (id_col, bad 0/1); of repeated ids the worst counts,
    null ids and null outcomes do not.  Pages that repeat an id count once per row.
    Partial sums per host run in every map task, so a host with a third of
    all pages is one row per task in the shuffle.
    """
    worst = outcomes.where(F.col("bad").isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max("bad").alias("__bad"))
    seen = pages.select(F.col(id_col).alias("__id"), url_host(F.col(url_col)).alias("host")).where("host != ''")
    counts = (seen.join(worst, "__id").groupBy("host")
              .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("__bad").cast("double").alias("bad")))
    return counts.select("host", registered_domain(F.col("host"), suffixes).alias("domain"),
                         url_suffix(F.col("host"), suffixes).alias("suffix"), "n", "bad")


def _strength(groups: DataFrame) -> float:
    """Prior strength m = 1 / rho - 1 from groups (n, bad, p): p is the mean of the parent.

    Under a beta-binomial, (bad - n p)^2 has mean n p (1-p) (1 + (n-1) rho);
    both sides are summed over the groups (one row comes to the driver).
    """
    r = groups.select((F.col("n") * F.col("p") * (1 - F.col("p"))).alias("v"), "n", (F.col("bad") - F.col("n") * F.col("p")).alias("d")) \
        .agg(F.sum(F.col("d") * F.col("d") - F.col("v")).alias("over"), F.sum(F.col("v") * (F.col("n") - 1)).alias("scale")).first()
    rho = r["over"] / r["scale"] if r["scale"] else RHO[1]
    return 1.0 / min(max(rho, RHO[0]), RHO[1]) - 1.0


def _shrunk(groups: DataFrame, m: float) -> DataFrame:
    return groups.withColumn("mean", (F.col("bad") + F.lit(m) * F.col("p")) / (F.col("n") + F.lit(m)))


def reputation(counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, float, tuple[float, float, float]]:
    """Posterior means of bad pages: (hosts, domains, suffixes, overall share, prior strengths by level).

    ``counts`` as from ``host_outcomes``.  Each frame holds its key, n, bad,
    p (the parent's mean) and mean.  Without a labelled page the overall share
    is 1/2 and the frames are empty.
    """
    total = counts.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    overall = ((total["bad"] or 0.0) + 1.0) / ((total["n"] or 0.0) + 2.0)
    suffixes = counts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("p", F.lit(overall))
    m_suffix = _strength(suffixes)
    suffixes = _shrunk(suffixes, m_suffix)
    domains = (counts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
               .join(suffixes.select("suffix", F.col("mean").alias("p")), "suffix"))
    m_domain = _strength(domains)
    domains = _shrunk(domains, m_domain)
    hosts = counts.join(domains.select("domain", F.col("mean").alias("p")), "domain")
    m_host = _strength(hosts)
    return _shrunk(hosts, m_host), domains, suffixes, overall, (m_host, m_domain, m_suffix)


def host_reputation(hosts: DataFrame, counts: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, n, mean, bound) of every host of ``hosts`` (column ``host``, distinct).

    ``bound`` = mean - z standard deviations of the host's beta posterior, a
    one-sided 95 % lower bound by default (normal approximation).  A host
    without labelled pages has its domain's posterior mean, else its
    suffix's, else the overall share, with the host level's prior strength.
    """
    known, domains, suffixes, overall, (m, _, _) = reputation(counts)
    seen = hosts.select("host", "domain", "suffix")
    joined = (seen.join(known.select("host", "n", F.col("mean").alias("__h")), "host", "left")
              .join(domains.select("domain", F.col("mean").alias("__d")), "domain", "left")
              .join(suffixes.select("suffix", F.col("mean").alias("__s")), "suffix", "left"))
    n = F.coalesce("n", F.lit(0.0))
    mean = F.coalesce("__h", "__d", "__s", F.lit(overall))
    spread = F.sqrt(mean * (1 - mean) / (n + F.lit(m) + 1.0))
    return joined.select("host", n.alias("n"), mean.alias("mean"), (mean - F.lit(z) * spread).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (), id_col: str = "page_id",
          url_col: str = "url", suffixes: Sequence[str] = SUFFIXES, max_bad: float = 0.2, z: float = 1.645) -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row of ``pages``.

    The verdict is the longest fitting rule's; without a rule, ``block``
    where the lower posterior bound of the host's share of bad pages is
    above ``max_bad``, else ``allow``.  Null urls and urls without ``://``
    have empty host and path and are allowed; very long urls are read whole.  Repeated rows and
    null ids are judged row by row; an empty table gives an empty result.
    Only the two named columns are read, so other columns may have any name.

    The pages meet only the blocked hosts (a part of the hosts), by host and
    one of PARTS parts, so the pages of one host spread over as many tasks.
    """
    counts = cut(host_outcomes(pages, outcomes, id_col, url_col, suffixes), "hosts")
    parts = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    names = parts.where("host != ''").select("host").distinct()
    names = names.select("host", registered_domain(F.col("host"), suffixes).alias("domain"),
                         url_suffix(F.col("host"), suffixes).alias("suffix"))
    blocked = host_reputation(names, counts, z).where(F.col("bound") > F.lit(max_bad)).select(F.col("host").alias("__blocked"))
    hit = matched_rule(F.col("host"), F.col("path"), rules)
    spread = parts.withColumn("__hit", hit).withColumn("__part", F.pmod(F.xxhash64(F.col(id_col), "path"), F.lit(PARTS)).cast("int"))
    many = blocked.withColumn("__of", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    judged = spread.join(many, (F.col("host") == F.col("__blocked")) & (F.col("__part") == F.col("__of")), "left")
    method = F.when(F.col("__blocked").isNotNull(), "block").otherwise("allow")
    return judged.select(id_col, "host", "path", F.col("__hit.rule").alias("rule"),
                         F.coalesce(F.col("__hit.verdict"), method).alias("verdict"))
