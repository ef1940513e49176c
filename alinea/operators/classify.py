"""Statuses, tiers, votes and risk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alinea.config import DEFAULT, Config
from alinea.functions.text import js_round

SEVERITY = {"Red": 3, "Amber": 2, "Green": 1}


def severity(status: Column) -> Column:
    return F.coalesce(*[F.when(status == k, v) for k, v in SEVERITY.items()], F.lit(0))


def match_status(best: Column, runner_up: Column, cfg: Config = DEFAULT) -> Column:
    """Matched from the upper threshold on; Variation from the floor on unless the runner-up is within the margin; else Custom."""
    unclear = (best < cfg.matched) & (F.coalesce(runner_up, F.lit(0.0)) > 0) & (best - F.coalesce(runner_up, F.lit(0.0)) < cfg.margin)
    return F.when(best >= cfg.matched, "Matched").when((best >= cfg.variation_floor) & ~unclear, "Variation").otherwise("Custom")


def fast_status(similarity: Column, cfg: Config = DEFAULT) -> Column:
    return F.when(similarity >= cfg.matched, "Matched").when(similarity >= cfg.variation_floor, "Variation").otherwise("Not Matched")


def bucket(status: Column) -> Column:
    return F.when(status.isin("Matched", "Green"), "matched").when(status.isin("Amber", "Custom", "Variation"), "variation").when(status.isin("Red", "Missing", "Not Found", "Not Matched"), "missing")


def risk_score(red: Column, amber: Column, total: Column, cfg: Config = DEFAULT) -> Column:
    """0 to 100; total counts the planned rules, not the results that are there."""
    return F.when(total > 0, F.least(F.lit(100), js_round((red * 1.0 + amber * F.lit(cfg.amber_weight)) / total * 100).cast("int"))).otherwise(0)


def progress(base: Column, done: Column, total: Column) -> Column:
    return F.least(F.lit(99), F.floor(base + done * 9 / F.greatest(total, F.lit(1)))).cast("int")


def audit_status(status: Column, share: Column, stage: Column) -> Column:
    """Failed, completed, reviewing or pending; the order of the tests matters."""
    s = F.lower(F.coalesce(status, F.lit("")))
    failed = s.contains("fail") | s.contains("error")
    done = s.contains("complete") | (F.coalesce(share, F.lit(0)) >= 100) | F.coalesce(stage, F.lit("")).contains("complete")
    busy = s.contains("process") | s.contains("review") | s.contains("analy") | s.contains("extract") | s.contains("evaluat") | (F.coalesce(share, F.lit(0)) > 0)
    return F.when(failed, "failed").when(done, "completed").when(busy, "reviewing").otherwise("pending")


def audit_status_list(status: Column, done: Column, total: Column) -> Column:
    """As lists show it: reviewing is tested before completed (as many results as rules) and failed; cases count where they stand."""
    s = F.coalesce(status, F.lit(""))
    busy = F.lower(s).contains("reviewing")
    for word in ("Processing", "Neural", "Vetting", "Mapping"):  # Fixed values: the names of stages
        busy = busy | s.contains(word)
    complete = F.coalesce((total > 0) & (done >= total), F.lit(False))
    return F.when(busy, "reviewing").when(complete, "completed").when(s.contains("failed") | s.contains("Failed"), "failed").otherwise("pending")


def voted(votes: DataFrame, keys: list[str]) -> DataFrame:
    """votes: keys, status, confidence, and a record. The status of most votes (ties: the more severe one) and the record of the
    highest confidence (ties: the smallest record)."""
    counts = votes.groupBy(*keys, "status").agg(F.count("*").alias("n"))
    won = counts.groupBy(*keys).agg(F.max_by("status", F.struct("n", severity(F.col("status")).alias("s"))).alias("status"))
    w = Window.partitionBy(*keys).orderBy(F.desc("confidence"), "record")
    base = votes.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*keys, "record", "confidence")
    return won.join(base, keys)


def union_of(df: DataFrame, keys: list[str], ordinal: str, array: str, most: int = 30) -> DataFrame:
    """The distinct values of arrays in the order in which they are first seen, at most `most`."""
    lists = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(ordinal, array))).alias("_all"))
    return lists.select(*keys, F.slice(F.array_distinct(F.flatten(F.transform("_all", lambda x: x[array]))), 1, most).alias(array))


def tiered(candidates: DataFrame, by_name: DataFrame, by_code: DataFrame, by_meaning: DataFrame, key: str) -> DataFrame:
    """Each with key, item, similarity. By name before by code before by meaning."""
    parts = [df.select(key, F.struct(F.lit(t).alias("tier"), "item", "similarity").alias(f"_{t}")) for df, t in ((by_name, "name-ref"), (by_code, "code"), (by_meaning, "semantic"))]
    out = candidates
    for part in parts:
        out = out.join(part, key, "left")
    return out.withColumn("_hit", F.coalesce("_name-ref", "_code", "_semantic")).select(*candidates.columns, "_hit.tier", "_hit.item", "_hit.similarity")


@dataclass(frozen=True)
class Module:
    """A set of rules that goes with kinds of workspaces or of contracts."""

    name: str
    workspaces: tuple[str, ...] = ()
    contracts: tuple[str, ...] = ()


def modules_of_kinds(workspace: Column, contract: Column, modules: list[Module], default: str) -> Column:
    """The names of all modules that list the kind of workspace or of contract, in their order; the default where none does. Kinds are compared without case."""
    w, c = F.lower(F.coalesce(workspace, F.lit(""))), F.lower(F.coalesce(contract, F.lit("")))
    listed = lambda x, kinds: x.isin([k.lower() for k in kinds]) if kinds else F.lit(False)
    names = F.array_compact(F.array(*[F.when(listed(w, m.workspaces) | listed(c, m.contracts), m.name) for m in modules]))
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(default)))


@dataclass(frozen=True)
class Mandatory:
    """A provision that must be there: known by a pattern (without case), or by one of its keywords."""

    name: str
    pattern: str | None = None
    keywords: tuple[str, ...] = ()


def registry_names(text: Column, registry: list[Mandatory]) -> Column:
    """The names of the registry's provisions that a text has, in order; of a null text none."""

    def has(m: Mandatory) -> Column:
        found = text.rlike("(?i)" + m.pattern) if m.pattern else F.lit(False)
        for k in m.keywords:
            found = found | F.lower(text).contains(k.lower())
        return F.coalesce(found, F.lit(False))

    return F.array_compact(F.array(*[F.when(has(m), m.name) for m in registry]))
