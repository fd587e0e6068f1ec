"""URL verdicts: rules first, then trust and distrust spread over the links between hosts.

A host whose pages the rules allow more often than they block is a trusted seed, one whose pages they block more often a
blocked seed, each weighing the difference as a share of all its pages.  Personalised PageRank from the trusted seeds follows links; distrust from the blocked seeds follows them backwards (who links to a
blocked host is suspect).  A host is blocked where its distrust is at least that of a seed of weight ``LEAST`` and above
its trust.  Scores that do not settle are an error.

Cases: a null url or one without ``://`` has an empty host and path; no rule fits it and it is allowed.  A null page has
no links.  Repeated pages and links count as often as they occur in shares, once as edges.  Of rules that fit, the
longest wins, then the longer host, then the one that blocks.  Extra columns are ignored.  No rows give no rows.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendaflux.llm.common import text_of, written

#: (verdict, host and path of the rule), fixed values of the contract.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Rules become one expression; a longer list belongs into a table.
MAX_RULES = 1000
DAMPING, STEPS, TOLERANCE, WRITE_EVERY = 0.85, 400, 1e-6, 5
#: Least distrust of a blocked host, as the weight of a seed that no link reaches.
LEAST = 0.05
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(text_of(url), r"(?s)^.*?://([^/?#]*)", 1), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(text_of(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits, and its verdict; null where none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    parts = [(v, r, r[: r.index("/")], r[r.index("/"):]) for v, r in rules]
    rule = verdict = None
    for v, r, h, p in sorted(parts, key=lambda x: (-len(x[1]), -len(x[2]), x[0] != "block")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, r) if rule is None else rule.when(fits, r)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def host_edges(judged: DataFrame) -> DataFrame:
    """Links between different hosts, each once: ``src, dst`` of ``host, html``."""
    links = judged.where("host <> ''").select("host", F.explode(F.array_distinct(F.regexp_extract_all(text_of("html"), F.lit(LINK), F.lit(1)))).alias("to"))
    full = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))
    return (links.select(F.col("host").alias("src"), host_of(full).alias("dst"))
            .where("dst <> '' AND src <> dst").distinct())


def spread(seeds: DataFrame, edges: DataFrame, steps: int = STEPS, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Trust and distrust of hosts from ``host, trusted, blocked`` (seed weights) and ``src, dst``: ``kind, host, score``.

    Both run in the same jobs: an edge table that has each link forwards for trust and backwards for distrust."""
    def walks(kind: str, a: str, b: str) -> DataFrame:
        degree = edges.groupBy(F.col(a).alias("u")).agg(F.count("*").alias("d"))
        return edges.select(F.col(a).alias("u"), F.col(b).alias("v")).join(degree, "u").select(
            F.lit(kind).alias("kind"), F.col("u").alias("host"), "v", (F.lit(damping) / F.col("d")).alias("share"))

    step = written(walks("trust", "src", "dst").unionByName(walks("distrust", "dst", "src")), "url_edges")
    start = seeds.select(F.explode(F.array(F.struct(F.lit("trust").alias("kind"), "host", F.col("trusted").alias("s")),
                                           F.struct(F.lit("distrust").alias("kind"), "host", F.col("blocked").alias("s")))).alias("x"))
    start = written(start.select("x.kind", "x.host", (F.col("x.s") * (1 - damping)).alias("score")).where("score > 0"), "url_seeds")
    now = start
    for i in range(1, steps + 1):
        moved = now.join(step, ["kind", "host"]).select("kind", F.col("v").alias("host"), (F.col("score") * F.col("share")).alias("score"))
        new = start.unionByName(moved).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if i % WRITE_EVERY == 0 or i == 1 or i == steps:
            new = written(new, "url_scores")
            change = (new.unionByName(now.withColumn("score", -F.col("score"))).groupBy("kind", "host").agg(F.abs(F.sum("score")).alias("c"))
                      .agg(F.max("c")).first()[0])
            if (change or 0) <= tolerance:
                return new
        now = new
    raise RuntimeError(f"scores of hosts did not settle in {steps} steps")


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: ``page_id, host, path, rule, verdict``, and its host's ``trust`` and ``distrust`` where that is blocked."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    judged = (pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
              .withColumn("rule", rule).withColumn("by_rule", by_rule))
    share = lambda v: F.avg(F.when(F.col("by_rule") == v, 1.0).otherwise(0.0))
    hosts = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("a"), share("block").alias("b"))
    net = F.col("a") - F.col("b")
    seeds = hosts.select("host", F.greatest(net, F.lit(0.0)).alias("trusted"), F.greatest(-net, F.lit(0.0)).alias("blocked"))
    scores = spread(seeds, written(host_edges(judged), "url_links"))
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0))
    bad = (scores.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))
           .where((F.col("distrust") >= LEAST * (1 - DAMPING)) & (F.col("distrust") > F.col("trust"))))
    return (judged.drop("html").join(bad, "host", "left")
            .withColumn("verdict", F.coalesce("by_rule", F.when(F.col("distrust").isNotNull(), "block").otherwise("allow")))
            .select("page_id", "host", "path", "rule", "verdict", "trust", "distrust"))
