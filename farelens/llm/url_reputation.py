"""URL filter: declared rules first, else the reputation of the host.

A host's share of bad pages is estimated from labelled pages by empirical Bayes. Each level's share
is a beta-binomial draw around the level above: suffix around the whole table, registered domain
around its suffix, host around its domain. How far a level scatters is fitted by moments over all
its members, so a host with few labels stays near its domain and one with many speaks for itself. A
page is blocked if the lower bound of its host's posterior lies above ``max_bad``.

Pages are counted by host first, with partial sums before the shuffle; what follows works on one row
per host, domain and suffix. The verdicts return to the pages by an equi-join, that splits a host
with very many pages by itself.

Defined cases: a null url, or one without ``://``, has empty host and path; such pages share one
reputation; an empty path starts with no rule's path; pages without any label fall back to the level
above, and without any labels at all to a share of 0; an empty list of suffixes leaves the last label;
an empty table gives an empty result; repeated
rows are judged alike; input columns named as the results are replaced, all others kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from farelens.llm.common import fold, store
from farelens.operators.joins import left_lookup

ALLOW, BLOCK = "allow", "block"
# Suffixes of two labels, below which names are registered, where no list is given.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
# Correlation of pages below one member: a prior weighs two pages at least, ten thousand at most.
RHO_RANGE = (1e-4, 1 / 3)


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def host_of(url: Column) -> Column:
    return fold(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.coalesce(F.locate("://", url), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def suffix_of(host: Column) -> Column:
    """The last label, or the last two of a listed suffix; empty for addresses and empty hosts."""
    name = F.regexp_replace(host, r":\d*$", "")
    two = F.substring_index(name, ".", -2)
    return (
        F.when(name.rlike(r"^[0-9.]*$|^\["), "")
        .when(two.isin(*TWO_LABEL_SUFFIXES), two)
        .otherwise(F.substring_index(name, ".", -1))
    )


def domain_of(host: Column) -> Column:
    """The suffix and one label more; the host itself where there is none."""
    name, suffix = F.regexp_replace(host, r":\d*$", ""), suffix_of(host)
    two = F.substring_index(name, ".", -2)
    return (
        F.when(suffix == "", name)
        .when(suffix.contains("."), F.substring_index(name, ".", -3))
        .otherwise(two)
    )


def suffix_rules(suffixes: DataFrame, column: str = "suffix") -> DataFrame:
    """Distinct rules of a public suffix list, one line a row: comments, blanks and nulls left out."""
    line = fold(F.regexp_extract(F.trim(F.col(column)), r"^\S+", 0)).alias("rule")
    return suffixes.select(line).filter("rule <> '' AND NOT startswith(rule, '//')").distinct()


def with_domains(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Adds suffix and domain to rows with one host each, by a list of public suffixes.

    A line of the list is a suffix (``co.uk``), a wildcard for one label (``*.ck``), or an exception to one
    (``!www.ck``). The longest that fits wins, an exception before all; where none fits it is the last
    label. Without a list, ``TWO_LABEL_SUFFIXES`` are taken. Hosts are looked up by their last labels, as
    many as the longest line has, by an equi-join.
    """
    if suffixes is None:
        return hosts.withColumns({"suffix": suffix_of(F.col("host")), "domain": domain_of(F.col("host"))})
    rules = store(suffix_rules(suffixes), "suffixes")
    depth = rules.agg(F.max(F.size(F.split("rule", r"\.")))).first()[0] or 1
    name = F.regexp_replace("host", r":\d*$", "")
    last = lambda n: F.substring_index(F.col("__name"), ".", -n)
    # An address, and a host that ends in a dot, have no suffix.
    named = hosts.withColumn("__name", name).withColumn("__plain", ~F.col("__name").rlike(r"^[0-9.]*$|^\[|\.$"))
    labels = F.size(F.split("__name", r"\."))
    fits = [
        F.when(labels >= n, F.struct(rule.alias("rule"), F.lit(exception).alias("exception"), F.lit(taken).alias("n")))
        for n in range(1, depth + 1)
        for rule, exception, taken in (
            (last(n), False, n),
            *([(F.concat(F.lit("*."), last(n - 1)), False, n)] if n > 1 else []),
            (F.concat(F.lit("!"), last(n)), True, n - 1),
        )
    ]
    asked = named.filter("__plain").select("host", F.explode(F.filter(F.array(*fits), lambda x: x.isNotNull())).alias("f"))
    found = left_lookup(asked.select("host", "f.*"), rules.withColumn("listed", F.lit(True)), "rule").filter("listed")
    best = store(
        found.groupBy("host").agg(F.max(F.struct("exception", "n")).alias("best")).select(
            F.col("host").alias("__host"), F.col("best.n").alias("__n")
        ),
        "host-suffixes",
    )
    n = F.when(F.col("__plain"), F.greatest(F.coalesce("__n", F.lit(1)), F.lit(1)))
    joined = named.join(best, F.col("host") == F.col("__host"), "left").withColumn("__n", n)
    tail = lambda more: F.expr(f"substring_index(__name, '.', -(__n + {more}))")
    return joined.withColumns(
        {"suffix": F.coalesce(tail(0), F.lit("")), "domain": F.coalesce(tail(1), F.col("__name"))}
    ).drop("__name", "__plain", "__host", "__n")


def longest_rule(rules: list[UrlRule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = rule.fits(host, path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def scatter(level: DataFrame, mean: str = "prior") -> float:
    """Prior strength of a level's beta distribution, by moments over all its members."""
    expected = F.col(mean)
    spread = expected * (1 - expected)
    r = level.agg(
        F.sum((F.col("k") - F.col("n") * expected) ** 2).alias("seen"),
        F.sum(F.col("n") * spread).alias("binomial"),
        F.sum(F.col("n") * (F.col("n") - 1) * spread).alias("pairs"),
    ).first()
    rho = (r.seen - r.binomial) / r.pairs if r.pairs else 0.0
    rho = min(max(rho, RHO_RANGE[0]), RHO_RANGE[1])
    return (1 - rho) / rho


def reputation(pages: DataFrame, z: float = 1.645, suffixes: DataFrame | None = None) -> DataFrame:
    """One row per host: pages labelled, bad among them, posterior mean and lower bound.

    ``pages`` has host and bad (0, 1 or null where a page has no label), ``suffixes`` the lines of a
    public suffix list (see ``with_domains``).
    """
    counted = pages.groupBy("host").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k")
    )
    if suffixes is not None:
        counted = store(counted, "host-counts")
    hosts = store(with_domains(counted, suffixes), "hosts")
    add = (F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = store(hosts.groupBy("domain", "suffix").agg(*add), "domains")
    suffixes = domains.groupBy("suffix").agg(*add)
    total = suffixes.agg(*add).first()
    overall = (total.k or 0) / total.n if total.n else 0.0

    def shrunk(level: DataFrame) -> DataFrame:
        strength = scatter(level)
        a = F.col("k") + strength * F.col("prior")
        b = F.col("n") - F.col("k") + strength * (1 - F.col("prior"))
        return level.withColumns({"a": a, "b": b}).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))

    by_suffix = shrunk(suffixes.withColumn("prior", F.lit(overall))).select("suffix", F.col("mean").alias("prior"))
    by_domain = store(shrunk(domains.join(by_suffix, "suffix")), "domain-means").select(
        "domain", F.col("mean").alias("prior")
    )
    leveled = store(hosts.join(by_domain, "domain"), "host-priors")
    size = F.col("a") + F.col("b")
    sd = F.sqrt(F.col("a") * F.col("b") / (size * size * (size + 1)))
    return shrunk(leveled).select(
        "host", F.col("n").alias("host_labels"), F.col("k").alias("host_bad"),
        F.col("mean").alias("bad_mean"), F.greatest(F.col("mean") - z * sd, F.lit(0.0)).alias("bad_low"),
    )


def judge_urls(
    pages: DataFrame,
    rules: list[UrlRule],
    max_bad: float = 0.5,
    z: float = 1.645,
    url: str = "url",
    suffixes: DataFrame | None = None,
) -> DataFrame:
    """Adds host, path, rule, verdict and the host's figures; ``pages`` has bad (0, 1 or null).

    The verdict is the longest rule's, else block where at least ``max_bad`` of the host's pages
    are bad with the certainty of ``z``. ``suffixes`` tells below which names domains are registered.
    """
    results = ("host", "path", "rule", "verdict", "host_labels", "host_bad", "bad_mean", "bad_low")
    parsed = pages.drop(*results).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    known = reputation(parsed.select("host", "bad"), z, suffixes)
    rule, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    by_host = F.when(F.col("bad_low") > max_bad, BLOCK).otherwise(ALLOW)
    return parsed.join(known, "host").withColumns({"rule": rule, "verdict": F.coalesce(verdict, by_host)})


def label_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds bad to pages whose url ends in the id of a labelled document: low quality or toxic."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 0)
    outcomes = labels.groupBy(F.col("doc_id").alias("__doc")).agg(F.max(bad).alias("bad"))
    number = F.regexp_extract(path_of(F.col("url")), r"/(\d{1,18})(?:\.[a-z]+)?$", 1)
    doc = F.when(number != "", number).cast("long")
    return pages.drop("bad").withColumn("__doc", doc).join(outcomes, "__doc", "left").drop("__doc")
