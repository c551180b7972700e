"""Mixing sources to target weights (operator 10): hierarchical budgeting over a domain - language - source tree.

1. Leaves: the tokens (runs of characters other than space, tab, line feed, carriage return) of each (domain, lang, source).
   A leaf can give its tokens `max_epochs` times; the capacity of an inner node is the sum of its leaves' capacities.
2. Budgets go down the tree, each parent's to its children in proportion to their weights. A child whose capacity falls short
   gets its capacity, and the shortage is spread over its siblings by weight (water filling). As a parent's own allotment never
   exceeds its subtree's capacity, a shortage reaches an ancestor's siblings only after all siblings are full. Shares are
   rounded down to whole tokens, so fewer tokens than children of a node stay unused there.
3. A leaf with budget b and t tokens gives `b div t` whole epochs, then the longest prefix of the next epoch that fits into the
   rest. The order of an epoch is that of md5(seed:epoch:doc_id); rows with equal ids stand or fall together.

A leaf's prefix needs no sort of the leaf: tokens are summed by the first digits of the hash, the sums find the one range in
which the rest runs out, ranges are made finer until the one of each leaf holds at most `RANGE_ROWS` different hashes, and only
those are summed one by one. What comes out per leaf is a cut, the last hash that is in.

A child of weight 0 gets nothing and has no capacity; its siblings share what it would have got. Negative weights are refused.

Nulls: a null text has no tokens, a null lang or source is the empty one, a null doc_id hashes as `null`. Empty tables give no
rows. Documents without tokens are taken if they stand in the prefix. Further columns are passed on untouched by `mix()`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import stored, table

WORD = r"[^ \t\n\r]+"
RANGE_ROWS = 100_000


@dataclass(frozen=True)
class MixPlan:
    """budget: tokens, or else share of all tokens in thousandths. Weights that aren't named are 1."""

    seed: int = 17
    share: int = 600
    budget: int | None = None
    max_epochs: int = 2
    domains: dict[str, int] = field(default_factory=lambda: {"d0": 4, "d1": 3, "d2": 2, "d3": 1})
    langs: dict[str, int] = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 1})
    sources: dict[str, int] = field(default_factory=dict)
    #: Domains of sources; others get one by `domain_of`.
    source_domains: dict[str, str] = field(default_factory=dict)
    #: Hex digits of the hash by which a leaf is summed first; its ranges number 16 to this power. Results don't depend on it.
    digits: int = 2

    def __post_init__(self):
        if any(w < 0 for weights in (self.domains, self.langs, self.sources) for w in weights.values()):
            raise ValueError("a weight is negative")


PRODUCTION = MixPlan()


def domain_of(source: Column) -> Column:
    """Stands for a table of sources' domains: four domains by the first hex digit of the source's md5."""
    return F.concat(F.lit("d"), F.pmod(F.conv(F.substring(F.md5(source), 1, 1), 16, 10).cast("int"), F.lit(4)).cast("string"))


def _domain(source: Column, plan: MixPlan) -> Column:
    out = domain_of(source)
    for k, v in plan.source_domains.items():
        out = F.when(source == k, F.lit(v)).otherwise(out)
    return out


def _weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for k, v in weights.items():
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out.cast("bigint")


def _key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _tagged(docs: DataFrame, plan: MixPlan) -> DataFrame:
    source = F.coalesce(F.col("source"), F.lit(""))
    return docs.select(
        "doc_id",
        _domain(source, plan).alias("domain"),
        F.coalesce(F.col("lang"), F.lit("")).alias("lang"),
        source.alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("n_tokens"),
    )


def _fill(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds `share` to rows of (parent keys, child, weight, cap, budget): the parent's budget, water-filled."""
    # weight 0 comes with capacity 0: such a child is full at once and leaves the rest to the others
    children, w = children.withColumn("weight", F.greatest("weight", F.lit(1))), Window.partitionBy(*parent)
    before = w.orderBy(F.col("cap") / F.col("weight"), child).rowsBetween(Window.unboundedPreceding, -1)
    x = children.withColumns(
        {
            "left": F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "weight_left": F.sum("weight").over(w) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
            "n": F.row_number().over(w.orderBy(F.col("cap") / F.col("weight"), child)),
        }
    )
    full = F.col("cap") * F.col("weight_left") <= F.col("left") * F.col("weight")
    x = x.withColumn("first", F.min(F.when(~full, F.struct("n", "left", "weight_left"))).over(w))
    share = F.when(F.col("first").isNull() | (F.col("n") < F.col("first.n")), F.col("cap")).otherwise(F.expr("(first.left * weight) div first.weight_left"))
    return x.withColumn("share", share).drop("left", "weight_left", "n", "first")


def leaf_budgets(tagged: DataFrame, plan: MixPlan) -> DataFrame:
    """domain, lang, source, tokens, share: one row per leaf."""
    able = lambda cap, column, weights: F.when(_weight(column, weights) > 0, cap).otherwise(F.lit(0).cast("bigint"))
    leaves = tagged.groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("tokens"))
    leaves = leaves.withColumn("cap", able(F.col("tokens") * plan.max_epochs, "source", plan.sources))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    langs = langs.withColumn("cap", able(F.col("cap"), "lang", plan.langs))
    tops = langs.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    tops = tops.withColumn("cap", able(F.col("cap"), "domain", plan.domains))
    want = F.lit(plan.budget).cast("bigint") if plan.budget is not None else F.expr(f"(sum(tokens) over (partition by 1) * {plan.share}) div 1000")
    tops = tops.withColumns({"weight": _weight("domain", plan.domains), "budget": want, "root": F.lit(1)})
    tops = _fill(tops, ["root"], "domain").select("domain", F.col("share").alias("budget"))
    langs = langs.withColumn("weight", _weight("lang", plan.langs)).join(tops, "domain")
    langs = _fill(langs, ["domain"], "lang").select("domain", "lang", F.col("share").alias("budget"))
    leaves = leaves.withColumn("weight", _weight("source", plan.sources)).join(langs, ["domain", "lang"])
    return _fill(leaves, ["domain", "lang"], "source").select("domain", "lang", "source", "tokens", "share")


def _edge(keyed: DataFrame, edge: DataFrame, leaf: list[str], digits: int) -> DataFrame:
    """For each leaf whose rest runs out in its range of edge: the range of so many digits in which it does, the tokens before it,
    and about how many hashes it holds."""
    known = edge.select(*leaf, F.col("range").alias("outer"), F.col("before").alias("start"))
    inside = keyed.join(known, leaf).filter(F.col("key").startswith(F.col("outer")))
    ranges = inside.groupBy(*leaf, F.substring("key", 1, digits).alias("range")).agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest"), F.first("start").alias("start"), F.approx_count_distinct("key").alias("hashes"))
    before = F.col("start") + F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("range")) - F.col("tokens")
    full = ranges.withColumn("before", before).filter(F.col("before") + F.col("tokens") > F.col("rest"))
    return full.groupBy(*leaf).agg(F.min(F.struct("range", "before", "hashes")).alias("edge")).select(*leaf, "edge.*")


def leaf_cuts(tagged: DataFrame, plan: MixPlan) -> DataFrame:
    """domain, lang, source, epochs (whole ones), cut: the last hash of the next epoch that is taken."""
    leaf = ["domain", "lang", "source"]
    shares = leaf_budgets(tagged, plan).withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("share div tokens")).otherwise(F.lit(0).cast("bigint")))
    shares = stored(shares.withColumn("rest", F.col("share") - F.col("epochs") * F.col("tokens")).drop("share", "tokens"), "mix-leaves")
    keyed = tagged.join(shares, leaf).withColumn("key", _key(plan.seed, F.col("epochs"), F.col("doc_id")))
    digits, edge = plan.digits, shares.select(*leaf, F.lit("").alias("range"), F.lit(0).cast("bigint").alias("before"))
    while True:
        edge = stored(_edge(keyed, edge, leaf, digits), "mix-edges")
        if digits >= 32 or (edge.agg(F.max("hashes")).first()[0] or 0) <= RANGE_ROWS:
            break
        digits += 2
    inside = keyed.join(edge, leaf).filter(F.col("key").startswith(F.col("range")))
    inside = inside.groupBy(*leaf, "key").agg(F.sum("n_tokens").alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"), F.first("range").alias("range"))
    sums = F.col("before") + F.sum("n").over(Window.partitionBy(*leaf).orderBy("key"))
    cuts = inside.withColumn("sums", sums).groupBy(*leaf).agg(F.max(F.when(F.col("sums") <= F.col("rest"), F.col("key"))).alias("last"), F.first("range").alias("range"))
    # without an edge everything fits: `g` sorts behind all hashes; the bare range sorts before all hashes in it
    cut = F.when(F.col("range").isNull(), F.lit("g")).otherwise(F.coalesce("last", "range"))
    return shares.join(cuts, leaf, "left").select(*leaf, "epochs", cut.alias("cut"))


def copies(docs: DataFrame, plan: MixPlan = PRODUCTION) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, copies (how many epochs take the row; 0: left out), a row for each row."""
    tagged = stored(_tagged(docs, plan), "mix-docs")
    cuts = stored(leaf_cuts(tagged, plan), "mix-cuts")
    more = (_key(plan.seed, F.col("epochs"), F.col("doc_id")) <= F.col("cut")).cast("bigint")
    return tagged.join(cuts, ["domain", "lang", "source"]).select("doc_id", "domain", "lang", "source", "n_tokens", (F.col("epochs") + more).alias("copies"))


def mix(docs: DataFrame, plan: MixPlan = PRODUCTION) -> DataFrame:
    """The rows of docs with all their columns, each as often as the mixture takes it."""
    tagged = stored(_tagged(docs, plan), "mix-docs")
    cuts = stored(leaf_cuts(tagged, plan), "mix-cuts").select(*[F.col(c).alias(f"_mix_{c}") for c in ("domain", "lang", "source", "epochs", "cut")])
    source, lang = F.coalesce(docs["source"], F.lit("")), F.coalesce(docs["lang"], F.lit(""))
    taken = docs.join(cuts, (source == F.col("_mix_source")) & (lang == F.col("_mix_lang")) & (_domain(source, plan) == F.col("_mix_domain")))
    n = F.col("_mix_epochs") + (_key(plan.seed, F.col("_mix_epochs"), docs["doc_id"]) <= F.col("_mix_cut")).cast("bigint")
    out = taken.filter(n > 0).withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), n)))
    return out.select(*[docs[c] for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "documents"))


def _sql_weight(column: str, weights: dict[str, int]) -> str:
    return f"CASE {' '.join(f"WHEN {column} = '{k}' THEN {v or 1}" for k, v in weights.items())} ELSE 1 END" if weights else "1"


def _sql_cap(cap: str, column: str, weights: dict[str, int]) -> str:
    none = [f"'{k}'" for k, v in weights.items() if not v]
    return f"CASE WHEN {column} IN ({', '.join(none)}) THEN 0 ELSE {cap} END" if none else cap


def _sql_fill(name: str, source: str, parent: str, child: str, out: str) -> str:
    order = f"PARTITION BY {parent} ORDER BY cap::DOUBLE / weight, {child}"
    return f"""
{name}_a AS (SELECT *, budget - COALESCE(SUM(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bleft,
  SUM(weight) OVER (PARTITION BY {parent}) - COALESCE(SUM(weight) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wleft,
  ROW_NUMBER() OVER ({order}) AS n FROM ({source})),
{name}_b AS (SELECT *, MIN(CASE WHEN cap * wleft > bleft * weight THEN n END) OVER (PARTITION BY {parent}) AS n1 FROM {name}_a),
{name} AS (SELECT b.*, CASE WHEN b.n1 IS NULL OR b.n < b.n1 THEN b.cap ELSE (f.bleft * b.weight) // f.wleft END::BIGINT AS {out}
  FROM {name}_b b LEFT JOIN {name}_b f ON {' AND '.join(f'b.{p} = f.{p}' for p in parent.split(', '))} AND f.n = b.n1)"""


def oracle(plan: MixPlan = PRODUCTION) -> str:
    want = str(plan.budget) if plan.budget is not None else f"(SELECT SUM(tokens) * {plan.share} // 1000 FROM leaf)"
    domain = "'d' || (('0x' || substr(md5(COALESCE(source, '')), 1, 1))::INT % 4)"
    for k, v in plan.source_domains.items():
        domain = f"CASE WHEN COALESCE(source, '') = '{k}' THEN '{v}' ELSE {domain} END"
    return f"""WITH d AS (SELECT doc_id, {domain} AS domain, COALESCE(lang, '') AS lang,
  COALESCE(source, '') AS source, len(regexp_extract_all(COALESCE(text, ''), '[^ \\t\\n\\r]+'))::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, SUM(n_tokens)::BIGINT AS tokens, {_sql_cap(f'(SUM(n_tokens) * {plan.max_epochs})::BIGINT', 'source', plan.sources)} AS cap FROM d GROUP BY domain, lang, source),
lang AS (SELECT domain, lang, {_sql_cap('SUM(cap)::BIGINT', 'lang', plan.langs)} AS cap FROM leaf GROUP BY domain, lang),
top AS (SELECT 1 AS root, domain, {_sql_weight('domain', plan.domains)} AS weight, {_sql_cap('SUM(cap)::BIGINT', 'domain', plan.domains)} AS cap, {want}::BIGINT AS budget FROM lang GROUP BY domain),
{_sql_fill('tf', 'SELECT * FROM top', 'root', 'domain', 'share')},
{_sql_fill('lf', f"SELECT l.domain, l.lang, {_sql_weight('l.lang', plan.langs)} AS weight, l.cap, tf.share AS budget FROM lang l JOIN tf ON l.domain = tf.domain", 'domain', 'lang', 'share')},
{_sql_fill('sf', f"SELECT s.domain, s.lang, s.source, s.tokens, {_sql_weight('s.source', plan.sources)} AS weight, s.cap, lf.share AS budget FROM leaf s JOIN lf ON s.domain = lf.domain AND s.lang = lf.lang", 'domain, lang', 'source', 'share')},
e AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END AS epochs,
  share - CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END * tokens AS rest FROM sf),
k AS (SELECT d.*, epochs, rest, md5('{plan.seed}:' || epochs || ':' || COALESCE(doc_id::VARCHAR, 'null')) AS hkey
  FROM d JOIN e ON d.domain = e.domain AND d.lang = e.lang AND d.source = e.source),
c AS (SELECT *, SUM(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY hkey RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sums FROM k)
SELECT doc_id, domain, lang, source, n_tokens, (epochs + CASE WHEN sums <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM c"""
