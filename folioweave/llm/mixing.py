"""Mixing sources to target weights: budgets down a domain-language-source tree, seeded token prefixes at the leaves.

What a subtree can give is the tokens of its leaves times the epochs allowed. A budget
goes down level by level: siblings share their parent's budget by weight, those that
cannot give their share give all they have, and the shortage is shared by weight among
the other siblings. As no node is asked for more than its subtree has, a shortage
reaches other branches only where all siblings are exhausted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.llm.common import checkpointed, free_names
from folioweave.session import shared_dir

LEVELS = ("domain", "lang", "source")
NONE = "(none)"
BUCKETS = 3  # leading hex digits of the order key: a leaf is summed in 16^3 slices


@dataclass(frozen=True)
class Mix:
    """Integer weights by level and name; a name without one has `default`. Weight 0 takes nothing."""

    domain: Mapping[str, int] = field(default_factory=dict)
    lang: Mapping[str, int] = field(default_factory=dict)
    source: Mapping[str, int] = field(default_factory=dict)
    default: int = 1
    budget: int | None = None  # tokens; None: half of what there is
    epochs: int = 4
    seed: int = 11

    def weight(self, level: str) -> Column:
        named = getattr(self, level)
        if any(w < 0 for w in [*named.values(), self.default]) or self.epochs < 1:
            raise ValueError("weights must not be negative, and there must be an epoch")
        out = F.lit(self.default)
        for name, w in named.items():
            out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
        return out.cast("bigint")


def domain_of_source(source: Column) -> Column:
    """Domain of a source by the number in its name; the tables have no column for it."""
    number = F.regexp_extract(F.coalesce(source.cast("string"), F.lit("")), "([0-9]{1,9})$", 1)
    at = F.coalesce(number.try_cast("int"), F.lit(0)) % 3
    return F.when(at == 0, "web").when(at == 1, "books").otherwise("reference")


def token_count(text: Column) -> Column:
    """Words between ASCII blanks."""
    return F.size(F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0)).cast("bigint")


def share_out(children: DataFrame, parent: Sequence[str], child: str) -> DataFrame:
    """Add `given` to rows of (parent..., child, weight, cap, budget): the parent's budget, shared.

    Children are taken in the order in which they would run dry if all were filled at
    a rate of their weight. Whole tokens; up to one token per child is left over.
    """
    dry = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), child).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*parent)
    upto, after = F.sum("cap").over(dry), F.sum("weight").over(all_) - F.sum("weight").over(dry)
    marked = children.where("weight > 0").withColumn("upto", upto).withColumn("after", after).withColumn(
        "all_used", F.col("upto") * F.col("weight") + F.col("cap") * F.col("after") <= F.col("budget") * F.col("weight"))
    rest = marked.withColumn("used", F.sum(F.when(F.col("all_used"), F.col("cap")).otherwise(0)).over(all_)).withColumn(
        "open", F.sum(F.when(F.col("all_used"), 0).otherwise(F.col("weight"))).over(all_))
    given = F.when(F.col("all_used"), F.col("cap")).otherwise(F.expr("(budget - used) * weight div open"))
    return rest.withColumn("given", given.cast("bigint")).drop("upto", "after", "all_used", "used", "open")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """domain, lang, source, have, given: tokens there are and tokens to take, of every leaf with a weight.

    `leaves`: domain, lang, source, have. One row per leaf; windows span siblings.
    """
    total = leaves.agg(F.coalesce(F.sum("have"), F.lit(0)).alias("n")).first()["n"]
    budget = total // 2 if mix.budget is None else mix.budget
    source = leaves.withColumn("cap", F.col("have") * mix.epochs).withColumn("weight", mix.weight("source"))
    lang = source.where("weight > 0").groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("weight", mix.weight("lang"))
    domain = lang.where("weight > 0").groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("weight", mix.weight("domain"))
    top = share_out(domain.withColumn("root", F.lit(0)).withColumn(
        "budget", F.least(F.sum(F.when(F.col("weight") > 0, F.col("cap")).otherwise(0)).over(Window.partitionBy("root")), F.lit(budget))),
        ["root"], "domain")
    mid = share_out(lang.join(top.select("domain", F.col("given").alias("budget")), "domain"), ["domain"], "lang")
    low = share_out(source.join(mid.select("domain", "lang", F.col("given").alias("budget")), ["domain", "lang"]), ["domain", "lang"], "source")
    return low.select(*LEVELS, "have", "given")


def _placed(docs: DataFrame, domain: Column | None, leaf: str, tokens: str) -> DataFrame:
    """`docs` with the leaf (a struct) and the number of tokens of each document, under names they do not have."""
    named = {c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)) if c in docs.columns else F.lit(NONE) for c in ("lang", "source")}
    where = domain if domain is not None else domain_of_source(F.col("source") if "source" in docs.columns else F.lit(None))
    return docs.select("*", F.struct(F.coalesce(where, F.lit(NONE)).alias("domain"), named["lang"].alias("lang"),
                                     named["source"].alias("source")).alias(leaf), token_count(F.col("text")).alias(tokens))


def _key(seed: int, full: str) -> Column:
    """Order of a leaf's documents in the epoch that is taken in part."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(full).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(NONE))).cast("binary"))


def mixed(docs: DataFrame, mix: Mix = Mix(), domain: Column | None = None) -> DataFrame:
    """`docs` that are taken, with mix_domain, mix_tokens and mix_copies (how many epochs take the document).

    A leaf with budget B and T tokens takes all its documents B div T times and, of the
    next epoch, those that come first in an order seeded by `seed`, the epoch and the
    id, as long as their tokens fit. Documents without tokens are never taken. Null
    languages and sources make leaves of their own; rows of equal id (and rows
    without one) keep together. Columns with the names added are replaced.

    The documents themselves are not moved: a narrow pass finds the order key up to
    which each leaf is taken, and a second one compares keys.
    """
    spark = docs.sparkSession
    plain = docs.drop("mix_domain", "mix_tokens", "mix_copies")
    leaf, tokens, of, full, end = free_names(plain.columns, "leaf", "tokens", "of", "full", "end")
    placed = _placed(plain, domain, leaf, tokens).where(F.col(tokens) > 0)
    narrow = checkpointed(placed.select(F.col("doc_id").cast("string").alias("doc_id"), f"{leaf}.*", F.col(tokens).alias("tokens")))
    leaves = leaf_budgets(narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("have")), mix)
    leaves = checkpointed(leaves.select(*LEVELS, F.expr("given div have").alias("full"), F.expr("given % have").alias("rest")))
    keyed = narrow.join(leaves, list(LEVELS)).withColumn("key", _key(mix.seed, "full")).withColumn("slice", F.substring("key", 1, BUCKETS))
    before = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        keyed.groupBy(*LEVELS, "slice").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
        .withColumn("upto", F.sum("n").over(before)).where("upto > rest and upto - n <= rest")
        .select(*LEVELS, "slice", (F.col("upto") - F.col("n")).alias("start"))
    )
    inside = Window.partitionBy(*LEVELS, "slice").orderBy("key")  # a range: rows of one key together
    last = (
        keyed.join(cut, [*LEVELS, "slice"]).withColumn("upto", F.col("start") + F.sum("tokens").over(inside))
        .groupBy(*LEVELS, "slice").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("key"))).alias("key"))
    )
    ends = leaves.join(last, list(LEVELS), "left").select(
        F.struct(*LEVELS).alias(of), F.col("full").alias(full), F.coalesce("key", "slice").alias(end))
    path = shared_dir(spark, "leaf-ends")
    ends.write.parquet(path)  # one row per leaf; from its size the planner decides whether to broadcast it
    ends = spark.read.parquet(path)
    here = placed.join(ends, F.col(leaf) == F.col(of))
    copies = (F.col(full) + F.when(_key(mix.seed, full) <= F.col(end), 1).otherwise(0)).cast("bigint")
    return here.withColumn("mix_copies", copies).where("mix_copies > 0").select(
        *[F.col(f"`{c}`") for c in plain.columns], F.col(leaf)["domain"].alias("mix_domain"), F.col(tokens).alias("mix_tokens"), "mix_copies")


def mix_sql(mix: Mix, docs: str = "documents") -> str:
    """The same selection in DuckDB SQL: doc_id, domain, lang, source, tokens, copies."""
    def weight(level: str) -> str:
        named = " ".join(f"WHEN '{k}' THEN {w}" for k, w in getattr(mix, level).items())
        return f"CASE {level} {named} ELSE {mix.default} END" if named else str(mix.default)

    def shared(name: str, source: str, parent: str, child: str) -> str:
        order = f"OVER (PARTITION BY {parent} ORDER BY cap / weight, {child} ROWS UNBOUNDED PRECEDING)"
        return f"""{name}_m AS (SELECT *, sum(cap) {order} * weight + cap * (sum(weight) OVER (PARTITION BY {parent})
    - sum(weight) {order}) <= budget * weight AS dry FROM {source} WHERE weight > 0),
{name} AS (SELECT *, CASE WHEN dry THEN cap ELSE (budget - sum(CASE WHEN dry THEN cap ELSE 0 END) OVER (PARTITION BY {parent}))
    * weight // sum(CASE WHEN dry THEN 0 ELSE weight END) OVER (PARTITION BY {parent}) END AS given FROM {name}_m)"""

    budget = "sum(have) // 2" if mix.budget is None else str(mix.budget)
    number = "coalesce(try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) AS INT), 0) % 3"
    return rf"""WITH d AS (SELECT doc_id, CASE {number} WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'reference' END AS domain,
    coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tokens FROM {docs}),
n AS (SELECT * FROM d WHERE tokens > 0),
leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS have FROM n GROUP BY ALL),
s AS (SELECT *, have * {mix.epochs} AS cap, {weight('source')} AS weight FROM leaf),
l AS (SELECT domain, lang, sum(cap) AS cap, {weight('lang')} AS weight FROM s WHERE weight > 0 GROUP BY domain, lang),
g AS (SELECT domain, sum(cap) AS cap, {weight('domain')} AS weight FROM l WHERE weight > 0 GROUP BY domain),
g2 AS (SELECT *, 0 AS root, least((SELECT sum(cap) FROM g WHERE weight > 0), (SELECT {budget} FROM leaf)) AS budget FROM g),
{shared('gs', 'g2', 'root', 'domain')},
l2 AS (SELECT l.*, gs.given AS budget FROM l JOIN gs USING (domain)),
{shared('ls', 'l2', 'domain', 'lang')},
s2 AS (SELECT s.*, ls.given AS budget FROM s JOIN ls USING (domain, lang)),
{shared('ss', 's2', 'domain, lang', 'source')},
k AS (SELECT n.*, given // have AS full_, given % have AS rest,
    md5('{mix.seed}:' || (given // have)::BIGINT || ':' || coalesce(doc_id::VARCHAR, '{NONE}')) AS key
    FROM n JOIN ss USING (domain, lang, source)),
c AS (SELECT *, full_ + CASE WHEN sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) <= rest THEN 1 ELSE 0 END AS copies FROM k)
SELECT doc_id, domain, lang, source, tokens, copies::BIGINT AS copies FROM c WHERE copies > 0"""


# The mix of the registered query and of the pipeline.
PRODUCTION = Mix(domain={"web": 5, "books": 3, "reference": 2}, lang={"en": 6, "de": 2, "fr": 1, "es": 1}, source={"src0": 2})
