"""URL filters: a rule list first, then the reputation of the host.

The pages of a host that carry a label are drawn with the host's own share of bad pages. The
shares of the hosts of one registered domain scatter around the domain's, those of its domains around
the suffix's, those of the suffixes around the share of all. On each level the scatter is a beta
distribution whose strength is estimated from the counts themselves (sums of squares within the
parents, as in a nested analysis of variance). From the top down every share is shrunk towards its
parent's, and a host is blocked if the lower bound of its posterior lies above ``MOST_BAD``.

Only built-in functions. What reaches the driver is one row of sums for each level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import few, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of the query: (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Suffixes of two labels under which domains are registered; any other suffix is the last label.
SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "org.uk")
#: Share of bad pages that the bound must pass; standard deviations between mean and bound, which
#: is the 0.05 quantile of a normal; least and greatest strength of a prior, in pages.
MOST_BAD, Z, STRENGTH = 0.5, 1.645, (1.0, 10_000.0)
#: Pages from which a host is looked up by broadcast, so at most one host for so many pages is.
HOT = 1_000_000
LEVELS = [("suffix", None), ("domain", "suffix"), ("host", "domain")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null and where there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest fitting rule, or null. A rule fits its host and all hosts
    below it where the path starts with its own; of equal length the longer host wins."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0])))
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in reversed(ordered):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        chosen = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user and port. A host of one label is its
    own domain; an address in digits is a domain without suffix."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    names = F.split(bare, r"\.", -1)
    two = F.array_join(F.slice(names, F.greatest(F.size(names) - 1, F.lit(1)), 2), ".")
    address = bare.rlike(r"^[0-9.]+$") | bare.startswith("[")
    width = F.when(two.isin(*SUFFIXES), 2).otherwise(1)
    suffix = F.when(address, F.lit("")).otherwise(F.when(width == 2, two).otherwise(F.element_at(names, -1)))
    start = F.greatest(F.size(names) - width, F.lit(1))
    return F.when(address, bare).otherwise(F.array_join(F.slice(names, start, F.size(names)), ".")), suffix


def outcomes(labels: DataFrame) -> DataFrame:
    """(id, bad) for every labelled page: bad if a label calls it toxic or of low quality. Of
    several labels of a page one bad one counts; labels without a value or an id do not."""
    bad = F.greatest((F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int"))
    return labels.select(F.col("doc_id").cast("long").alias("id"), bad.alias("bad")).where(
        "id is not null and bad is not null").groupBy("id").agg(F.max("bad").alias("bad"))


def host_counts(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """(host, domain, suffix, pages, n, k): rows of ``pages`` (id, host), those with an outcome, and
    the bad ones. Rows are counted by (id, host) before they meet the outcomes, so that an id or a host
    that holds many rows is one row by then."""
    seen = pages.groupBy("host").agg(F.count("*").alias("pages"))
    met = pages.where("id is not null").groupBy("id", "host").agg(F.count("*").alias("c")).join(few(labelled), "id")
    hit = met.groupBy("host").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("bad")).alias("k"))
    zero = F.lit(0).cast("long")
    rows = seen.select("host", "pages", zero.alias("n"), zero.alias("k")).unionByName(
        hit.select("host", zero.alias("pages"), "n", "k"))
    whole = rows.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("pages", "n", "k")])
    domain, suffix = domain_and_suffix(F.col("host"))
    return whole.select("host", domain.alias("domain"), suffix.alias("suffix"), "pages", "n", "k")


def squares(k: str, n: str) -> Column:
    """k * k / n in millionths, whole numbers so that their sum does not depend on the order."""
    return F.round(F.lit(1e6) * F.col(k) * F.col(k) / F.col(n)).cast("long")


def strength(counts: DataFrame, parents: DataFrame) -> float:
    """Strength, in pages, of the prior that rows (n, k, parent) of ``counts`` share: large where
    they differ no more than chance makes them differ from ``parents`` (n, k, nn)."""
    own = counts.where("n > 0").agg(F.count("*"), F.sum("n"), F.sum("k"), F.sum(squares("k", "n"))).first()
    above = parents.where("n > 0").agg(F.count("*"), F.sum(squares("k", "n")), F.sum(
        F.round(F.lit(1e6) * F.col("nn") / F.col("n")).cast("long"))).first()
    return strength_of(*[x or 0 for x in own], *[x or 0 for x in above])


def strength_of(groups: int, n: int, k: int, within: int, parents: int, between: int, sizes: int) -> float:
    """The moment estimate from sums: groups and their n, k and k*k/n, parents and their k*k/n, and
    the sum of squared group sizes over the parent's size (sums of quotients in millionths)."""
    low, high = STRENGTH
    share, free = (k / n if n else 0.0), groups - parents
    chance = share * (1 - share)
    room = chance * (n - sizes / 1e6 - free)
    if room <= 0:
        return high
    scatter = ((within - between) / 1e6 - free * chance) / room
    return high if scatter <= 1 / (high + 1) else max(low, 1 / scatter - 1)


def reputation(counts: DataFrame) -> DataFrame:
    """``counts`` with ``bad_share``, the posterior mean of each host, and ``bound``, its lower bound.

    Hosts without outcomes get what their domain, suffix or the whole says. Without any outcome
    every share is 1/2 before shrinking and no bound passes ``MOST_BAD``.
    """
    counts = written(counts, "hosts")
    total = counts.agg(F.sum("n"), F.sum("k")).first()
    n, k = total[0] or 0, total[1] or 0
    above = None
    for level, parent in LEVELS:
        own = counts.groupBy(*[c for c in (level, parent) if c]).agg(
            F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("pages").alias("pages"))
        over = own.groupBy(*[c for c in (parent,) if c]).agg(
            F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum("n").alias("n"), F.sum("k").alias("k"))
        prior = strength(own, over)
        rows = own.withColumn("prior", F.lit((k + 0.5) / (n + 1.0))) if above is None else own.join(few(above), parent)
        a, b = F.col("k") + prior * F.col("prior"), F.col("n") - F.col("k") + prior * (F.lit(1.0) - F.col("prior"))
        if level == "host":
            mean = a / (a + b)
            bound = mean - Z * F.sqrt(mean * (F.lit(1.0) - mean) / (a + b + 1.0))
            return rows.select("host", "pages", "n", "k", mean.alias("bad_share"), bound.alias("bound"))
        above = written(rows.select(level, (a / (F.col("n") + prior)).alias("prior")), f"{level}-shares")


def judged(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url, ...).

    ``labels`` (doc_id, quality, toxic) are the outcomes of the pages with that id. Null urls and urls
    without ``://`` have an empty host, which has a reputation like any other; rows without page_id
    have no outcome. Repeated rows stay and count each. Urls of any length are whole. Empty
    tables give no rows, or no blocked host. Other columns play no part.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    counts = host_counts(rows.select(F.col("page_id").alias("id"), "host"), outcomes(labels))
    bad = written(reputation(counts).where(F.col("bound") > MOST_BAD).select("host", "pages"), "blocked")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("__rule", rule)
    for part, size in ((bad.where(F.col("pages") > HOT), "hot"), (bad.where(F.col("pages") <= HOT), "rest")):
        part = part.select(F.col("host").alias("__host"), F.lit(True).alias(f"__{size}"))
        part = F.broadcast(part) if size == "hot" else few(part)
        rows = rows.join(part, F.col("host") == F.col("__host"), "left").drop("__host")
    blocked = F.coalesce("__hot", "__rest", F.lit(False))
    return rows.select("page_id", "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce(
        "__rule.verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"))
