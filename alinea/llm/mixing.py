"""Mixing sources to target weights: hierarchical budgeting in DataFrame operations alone.

Documents are leaves of a tree domain > language > source. The budget goes down from the root: at each node it is dealt out to
the children by weight, none gets more than its leaves can give, and what one cannot take goes to its siblings. As a node's
own share was bound in the same way, a shortage meets siblings first and reaches an ancestor's siblings only beyond them.
A leaf then takes the documents of a seeded order up to its quota; a quota above its tokens takes whole epochs first, each
in an order of its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEAF = ["domain", "language", "origin"]


@dataclass(frozen=True)
class Plan:
    """SQL expressions over the columns of documents; weights are integers from 0 to 10,000 (0: nothing is taken)."""

    domain: str = "concat('dom', cast(try_cast(regexp_extract(coalesce(source, ''), '[0-9]+$', 0) as int) % 4 as string))"
    domain_weight: str = "case domain when 'dom0' then 4 when 'dom1' then 3 when 'dom2' then 2 else 1 end"
    language_weight: str = "case language when 'en' then 5 when 'de' then 2 when 'fr' then 2 else 1 end"
    origin_weight: str = "1"
    percent: int = 60  # of all tokens
    epochs: int = 2  # that a document is taken in at most
    seed: str = "mix"
    per_bucket: int = 1000  # documents of a leaf that are put in order at once, about


def leaf_of(plan: Plan) -> dict[str, Column]:
    return {"domain": F.coalesce(F.expr(plan.domain), F.lit("")), "language": F.coalesce("lang", F.lit("")), "origin": F.coalesce("source", F.lit(""))}


def counted(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, domain, language, origin, n_tokens (runs of signs other than blank, tab and line ends)."""
    rows = docs.select(
        "doc_id",
        *(c.alias(k) for k, c in leaf_of(plan).items()),
        F.coalesce(F.regexp_count("text", F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long").alias("n_tokens"),
    )
    return rows


def dealt(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """nodes: parents, name, weight, room, budget (of the parent). Adds share: the node's own budget."""
    order = Window.partitionBy(*parents).orderBy((F.col("room").cast("double") / F.col("weight")).asc(), "name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    out = nodes.withColumn("left", F.col("budget") - zero(F.sum("room").over(before))).withColumn("weights", F.sum("weight").over(rest))
    out = out.withColumn("fills", F.when(F.col("room") * F.col("weights") <= F.col("weight") * F.col("left"), 0).otherwise(1))
    out = out.withColumn("open", F.max("fills").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    among = Window.partitionBy(*parents, "open").orderBy((F.col("room").cast("double") / F.col("weight")).asc(), "name")
    upto = among.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*parents, "open")
    out = out.withColumn("free", F.max("left").over(whole)).withColumn("total", F.sum("weight").over(whole)).withColumn("sofar", F.sum("weight").over(upto))
    part = F.expr("(free * sofar) div total - (free * (sofar - weight)) div total")
    return out.select(*parents, "name", F.when(F.col("open") == 0, F.col("room")).otherwise(F.least(part, F.col("room"))).alias("share"))


def quotas(leaves: DataFrame, plan: Plan) -> DataFrame:
    """leaves: domain, language, origin, tokens, docs. Adds quota; there are as many rows as sources in languages and domains."""
    weighted = leaves.withColumn("w1", F.expr(plan.domain_weight).cast("long")).withColumn("w2", F.expr(plan.language_weight).cast("long")).withColumn("w3", F.expr(plan.origin_weight).cast("long"))
    weighted = weighted.withColumn("room", F.when(F.expr("w1 > 0 and w2 > 0 and w3 > 0"), F.col("tokens") * plan.epochs).otherwise(F.lit(0).cast("long")))
    total = leaves.agg((F.sum("tokens") * plan.percent).alias("all")).select(F.expr("`all` div 100").alias("wanted"))
    level = weighted.filter("w1 > 0").groupBy("domain").agg(F.sum("room").alias("room"), F.max("w1").alias("weight"))
    root = level.agg(F.sum("room").alias("give")).crossJoin(total).select(F.least("give", "wanted").alias("budget"))  # one row
    top = dealt(level.crossJoin(root).select(F.lit(0).alias("root"), F.col("domain").alias("name"), "weight", "room", "budget"), ["root"])
    given = top.select(F.col("name").alias("domain"), F.col("share").alias("budget"))
    level = weighted.filter("w1 > 0 and w2 > 0").groupBy("domain", "language").agg(F.sum("room").alias("room"), F.max("w2").alias("weight"))
    middle = dealt(level.join(given, "domain").withColumnRenamed("language", "name"), ["domain"])
    given = middle.select("domain", F.col("name").alias("language"), F.col("share").alias("budget"))
    level = weighted.filter("w1 > 0 and w2 > 0 and w3 > 0").select(*LEAF, "room", F.col("w3").alias("weight"))
    last = dealt(level.join(given, ["domain", "language"]).withColumnRenamed("origin", "name"), ["domain", "language"])
    shares = last.select("domain", "language", F.col("name").alias("origin"), F.col("share").alias("quota"))
    return leaves.join(shares, LEAF, "left").withColumn("quota", F.coalesce("quota", F.lit(0).cast("long")))


def drawn(seed: str, epoch: Column | str) -> Column:
    """A document's place in the order of an epoch."""
    return F.md5(F.concat(F.lit(seed + ":"), F.col(epoch).cast("string") if isinstance(epoch, str) else epoch.cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def leaf_cuts(rows: DataFrame, plan: Plan) -> DataFrame:
    """For each leaf: quota, epochs (whole ones), cut and last: of the next epoch it takes draws below cut and up to last.

    rows: the table of counted(). Only sums of buckets of the order, and the rows of the one bucket in which a leaf's quota
    ends, go through windows.
    """
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    leaves = quotas(leaves, plan).withColumn("epochs", F.expr("if(tokens > 0, quota div tokens, 0)")).withColumn("left", F.expr("if(tokens > 0, quota % tokens, 0)"))
    leaves = written(leaves, "leaves")
    most = leaves.agg(F.max("docs")).first()[0] or 1
    digits = max(1, math.ceil(math.log(max(1, most / plan.per_bucket), 16)))
    placed = rows.join(leaves.filter("left > 0").select(*LEAF, "epochs", "left"), LEAF)
    placed = placed.withColumn("draw", drawn(plan.seed, "epochs")).withColumn("bucket", F.substring("draw", 1, digits))
    sums = placed.groupBy(*LEAF, "bucket").agg(F.sum("n_tokens").alias("tokens"), F.first("left").alias("left"))
    running = Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("upto", F.sum("tokens").over(running)).filter(F.col("upto") > F.col("left"))
    cuts = written(sums.groupBy(*LEAF).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("before"))).alias("at")).select(*LEAF, F.col("at.bucket").alias("cut"), "at.before"), "cuts")
    inside = placed.join(cuts.withColumnRenamed("cut", "bucket"), [*LEAF, "bucket"])
    running = Window.partitionBy(*LEAF).orderBy("draw").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("upto", F.col("before") + F.sum("n_tokens").over(running)).filter(F.col("upto") <= F.col("left"))
    last = inside.groupBy(*LEAF).agg(F.max("draw").alias("last"))
    return written(leaves.select(*LEAF, "quota", "epochs").join(cuts.drop("before"), LEAF, "left").join(last, LEAF, "left"), "leafcuts")


def taken(placed: DataFrame, plan: Plan) -> DataFrame:
    """placed: rows with their leaf's cuts. How often each is taken: once for each whole epoch, and for the next one up to the cut."""
    draw = drawn(plan.seed, "epochs")
    return placed.withColumn("copies", F.col("epochs") + F.when((draw < F.col("cut")) | (draw <= F.col("last")), 1).otherwise(0))


def mix(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, domain, lang, source, epoch (from 0), n_tokens: a row for each time that a document is taken.

    Documents are taken whole, in the seeded order of their leaf, while the quota is not exceeded. Null lang and source are
    leaves of their own (named by the empty text); null texts have no tokens; null doc_ids and rows that repeat a doc_id have
    one place in the order and are taken together. A leaf without tokens gives nothing. Other columns of docs are not read.
    """
    rows = written(counted(docs, plan), "counted")
    each = taken(rows.join(leaf_cuts(rows, plan), LEAF), plan).filter("copies > 0")
    each = each.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return each.select("doc_id", "domain", F.col("language").alias("lang"), F.col("origin").alias("source"), "epoch", "n_tokens")


def mixed_documents(docs: DataFrame, plan: Plan = Plan(epochs=1)) -> DataFrame:
    """The rows of docs that are taken, with all their columns; as often as they are taken."""
    rows = written(counted(docs, plan), "counted")
    names = dict(zip(LEAF, ("_domain", "_language", "_origin"), strict=True))
    cuts = leaf_cuts(rows, plan).withColumnsRenamed(names)
    own = docs.withColumns({names[k]: c for k, c in leaf_of(plan).items()})
    each = taken(own.join(cuts, list(names.values())), plan).filter("copies > 0")
    each = each.withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return each.select(*docs.columns)


def oracle(plan: Plan = Plan()) -> str:
    """The same rows in DuckDB's SQL."""

    def level(name: str, source: str, parents: str, key: str) -> str:
        by = f"partition by {parents}"
        return f"""
{name}_a as (select *, budget - coalesce(sum(room) over ({by} order by room::double / weight, {key} rows between unbounded preceding and 1 preceding), 0) as lft,
  sum(weight) over ({by} order by room::double / weight, {key} rows between current row and unbounded following) as weights from ({source})),
{name}_b as (select *, max(case when room * weights <= weight * lft then 0 else 1 end) over ({by} order by room::double / weight, {key} rows between unbounded preceding and current row) as opened from {name}_a),
{name}_c as (select *, max(lft) over ({by}, opened) as free, sum(weight) over ({by}, opened) as total,
  sum(weight) over ({by}, opened order by room::double / weight, {key} rows between unbounded preceding and current row) as sofar from {name}_b),
{name} as (select *, (case when opened = 0 then room else least((free * sofar)::hugeint // total::hugeint - (free * (sofar - weight))::hugeint // total::hugeint, room) end)::bigint as share from {name}_c)"""

    domain = plan.domain.replace("as string", "as varchar")
    return f"""with counted as (select doc_id, coalesce({domain}, '') as domain, coalesce(lang, '') as language, coalesce(source, '') as origin,
  coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0)::bigint as n_tokens from documents),
leaves as (select domain, language, origin, sum(n_tokens)::bigint as tokens from counted group by all),
weighted as (select *, {plan.domain_weight} as w1, {plan.language_weight} as w2, {plan.origin_weight} as w3, tokens * {plan.epochs} as room from leaves),
root as (select least(sum(room), sum(tokens) * {plan.percent} // 100)::bigint as budget from weighted),
{level("top", "select domain, sum(room)::bigint as room, max(w1) as weight, max(budget) as budget, 0 as root from weighted, root group by domain", "root", "domain")},
{level("mid", "select w.domain, w.language, sum(w.room)::bigint as room, max(w2) as weight, max(share) as budget from weighted w join top t on w.domain = t.domain group by all", "domain", "language")},
{level("low", "select w.domain, w.language, w.origin, w.room, w3 as weight, share as budget from weighted w join mid m on w.domain = m.domain and w.language = m.language", "domain, language", "origin")},
quota as (select l.*, case when tokens > 0 then share // tokens else 0 end as epochs, case when tokens > 0 then share % tokens else 0 end as more from leaves l join low using (domain, language, origin)),
placed as (select c.*, epochs, more, md5('{plan.seed}:' || epochs || ':' || coalesce(doc_id::varchar, '')) as draw from counted c join quota using (domain, language, origin)),
summed as (select *, sum(n_tokens) over (partition by domain, language, origin order by draw range between unbounded preceding and current row) as upto from placed)
select doc_id, domain, language as lang, origin as source, unnest(range(epochs + case when more > 0 and upto <= more then 1 else 0 end)) as epoch, n_tokens from summed"""
