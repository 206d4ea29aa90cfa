"""URL filters by link-graph propagation.

Rules decide the urls they fit. The hosts of allowed urls are trusted seeds, the
hosts of blocked ones distrusted seeds. Trust follows links (personalised PageRank
from the trusted seeds), distrust follows them backwards (from the blocked seeds):
whom good hosts link to is good, who links to bad hosts is bad.

Two measures go through the links together. The verdict comes from ``seeds``, where
every seed has the weight 1, whatever the number of seeds and hosts: a host whose
distrust exceeds its trust by ``margin`` of one seed is blocked. It is divided once a
link, in units of 1 / ``SEED``, and rounds go on until all changes of a round come to
``BOUND`` or less; what could still come after is less than six times that, a
sixteenth of the margin. ``score``, whose sum over the seeds of a kind is UNIT, is
what the columns trust and distrust give, after ``rounds`` rounds.

Both are whole numbers and every division is whole, so that results do not depend
on the order of a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netpulse.sinks.tables import written

# Fixed values of the contract: (host, path, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
UNIT = 10**12
DAMPING = 85
ROUNDS = 10
MARGIN = UNIT // 1000  # of one seed, in units of UNIT
# A long holds what 92 million seeds would give to one host.
SEED = 10**11
BOUND = SEED // 10**5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules: tuple, value) -> Column:
    """``value(rule)`` of the longest rule that fits, null if none does."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])
        out = F.when(fits, F.lit(value(rule))) if out is None else out.when(fits, F.lit(value(rule)))
    return out if out is not None else F.lit(None).cast("string")


def judged(pages: DataFrame, rules: tuple) -> DataFrame:
    """page_id, url's host and path, the rule that fits and its verdict."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    return rows.withColumns({
        "rule": rule_column(host, path, rules, lambda r: r[0] + r[1]),
        "decided": rule_column(host, path, rules, lambda r: r[2]),
    })


def host_links(pages: DataFrame) -> DataFrame:
    """from_host, to_host, links: counted links between different hosts.

    Links in ``html`` with a scheme, or beginning with ``//``, lead to another
    host; others stay. Counts combine before the shuffle.
    """
    links = pages.select(
        host_of(F.col("url")).alias("from_host"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("link")
    )
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    ends = links.select("from_host", host_of(full).alias("to_host")).where("from_host <> '' AND to_host <> '' AND from_host <> to_host")
    return ends.groupBy("from_host", "to_host").agg(F.count(F.lit(1)).alias("links"))


def propagate(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """host, kind, score and seeds; kinds: ``trust`` along the links, ``distrust`` against them.

    ``seeds``: host, kind; the seeds of a kind share UNIT in ``score`` (after ``rounds``
    rounds) and have SEED each in ``seeds`` (after as many rounds as it takes). A host
    passes on 85 % of what it has by its link counts; what hosts without a way on hold
    is not passed on. Each round is written to the shared folder. ``seeds`` only grows
    from round to round and is bounded, so the rounds end.
    """
    ways = links.select(F.lit("trust").alias("kind"), F.col("from_host").alias("here"), F.col("to_host").alias("there"), "links").union(
        links.select(F.lit("distrust").alias("kind"), F.col("to_host").alias("here"), F.col("from_host").alias("there"), "links")
    )
    out = ways.groupBy("kind", "here").agg(F.sum("links").alias("all_links"))
    ways = written(ways.join(out, ["kind", "here"]), "host-ways")
    many = seeds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    start = written(seeds.join(F.broadcast(many), "kind").select("host", "kind", F.expr(f"{UNIT}L div n").alias("base")), "seeds")
    own = SEED * (100 - DAMPING) // 100
    scores = start.select("host", "kind", F.col("base").alias("score"), F.lit(own).cast("long").alias("seeds"))
    done = 0
    while True:
        sent = ways.join(scores.withColumnRenamed("host", "here"), ["kind", "here"])
        # score <= UNIT and links are divided first by their total in parts per million.
        share = F.expr(f"(score * {DAMPING} div 100) * (links * 1000000 div all_links) div 1000000")
        whole = F.expr(f"CAST(seeds AS DECIMAL(19)) * CAST(links * {DAMPING} AS DECIMAL(18)) div CAST(all_links * 100 AS DECIMAL(19))")
        heard = (
            sent.select(F.col("there").alias("host"), "kind", share.alias("part"), whole.alias("seeds_part"))
            .groupBy("host", "kind")
            .agg(F.sum("part").alias("part"), F.sum("seeds_part").alias("seeds_part"))
        )
        base = F.expr(f"base * {100 - DAMPING} div 100")
        grown = F.when(F.col("base").isNull(), 0).otherwise(own) + F.coalesce("seeds_part", F.lit(0))
        later = start.join(heard, ["host", "kind"], "full").select(
            "host", "kind", (F.coalesce(base, F.lit(0)) + F.coalesce("part", F.lit(0))).alias("score"), grown.cast("long").alias("seeds")
        )
        if done >= rounds:
            later = later.drop("score").join(scores.select("host", "kind", "score"), ["host", "kind"], "left")
            later = later.select("host", "kind", F.coalesce("score", F.lit(0)).cast("long").alias("score"), "seeds")
        later = written(later, "host-scores")
        old = scores.select("host", "kind", F.col("score").alias("before"), F.col("seeds").alias("seeds_before"))
        moved = later.join(old, ["host", "kind"], "full").agg(
            F.count_if(~F.col("score").eqNullSafe(F.col("before"))).alias("scores"),
            F.sum(F.coalesce("seeds", F.lit(0)) - F.coalesce("seeds_before", F.lit(0))).alias("seeds"),
        ).first()
        scores, done = later, done + 1
        still = moved["seeds"] or 0
        if (done >= rounds and still <= BOUND) or not (moved["scores"] or still):
            return scores


def url_verdicts(pages: DataFrame, rules: tuple = RULES, rounds: int = ROUNDS, margin: int = MARGIN) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page.

    Null url, or one without ``://``: empty host and path, no rule, allowed. Null
    html: no links. Hosts that nothing reaches are allowed. Repeated rows and null
    ids are pages of their own. An empty table gives no row. ``margin`` is in units of
    UNIT for one seed.
    """
    rows = judged(pages, rules)
    seeds = rows.where("decided IS NOT NULL AND host <> ''").groupBy("host").agg(F.max(F.col("decided") == "block").alias("bad"), F.max(F.col("decided") == "allow").alias("good"))
    # A host with both kinds of urls vouches for neither side.
    seeds = seeds.where("bad <> good").select("host", F.when(F.col("bad"), "distrust").otherwise("trust").alias("kind"))
    scores = propagate(host_links(pages), seeds, rounds)
    kinds = ("trust", "distrust")
    by_host = scores.groupBy("host").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("score"))).alias(k) for k in kinds],
        *[F.max(F.when(F.col("kind") == k, F.col("seeds"))).alias(f"{k}_seeds") for k in kinds],
    )
    columns = [*kinds, *[f"{k}_seeds" for k in kinds]]
    out = rows.join(by_host, "host", "left").withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in columns})
    method = F.when(F.col("distrust_seeds") > F.col("trust_seeds") + margin * SEED // UNIT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("decided", method).alias("verdict"), *kinds)
