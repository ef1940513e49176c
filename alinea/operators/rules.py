"""Rules over retrieved evidence: which apply, what they look for, how they are judged, and what is stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alinea.functions.text import library_key
from alinea.operators.patterns import found_items, found_parts
from alinea.operators.relations import once

BOLD = r"^[*]{2}([^*]+)[*]{2}"  # Fixed value: how a heading stands at the beginning of an evidence text
NO_EVIDENCE = "No relevant text was found for this rule."


def applicable(rules: DataFrame, doc: Column | None, selected: Column, kind, known_kinds: list, overrides: DataFrame, override_wins: bool = False) -> DataFrame:
    """rules: rule_id, category, status, version_id; overrides: rule_id, override. Those selected (all if none is), active, of the
    document's kind if their category is one, not switched off, and with a version. override_wins lets an override reactivate."""
    rows = rules.join(overrides, "rule_id", "left").withColumn("effective", F.coalesce("override", "status"))
    rows = rows.filter((F.size(selected) == 0) | F.array_contains(selected, F.col("rule_id")))
    active = F.col("effective") == "active"
    rows = rows.filter(active if override_wins else active & (F.col("status") == "active"))
    rows = rows.filter(~F.col("category").isin(*known_kinds) | F.lit(kind == "other") | (F.col("category") == kind))
    return rows.filter(F.col("version_id").isNotNull())


def search_queries(search: Column, checks: Column, name: Column) -> Column:
    """The rule's queries, else what it checks, else its name."""
    full = lambda a: F.when(F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0, a)
    return F.coalesce(full(search), full(checks), F.array(name))


def distinct_queries(rules: DataFrame, queries: str) -> DataFrame:
    return rules.select(F.explode(queries).alias("q")).select(F.trim("q").alias("query")).filter("query <> ''").distinct()


def module_of(rules: DataFrame, modules: DataFrame, default: str) -> DataFrame:
    """rules: rule_id, name, category, module_key; modules: module, place, words (array). The key that a rule names, else the
    first module one of whose words is in its name or category, else the default."""
    words = modules.select("module", "place", F.explode("words").alias("word")).withColumn("word", F.lower("word"))
    text = F.lower(F.concat_ws(" ", "name", "category"))
    hits = found_items(rules.select("rule_id", text.alias("t")), words, "rule_id", "t", "word")
    first = hits.groupBy("rule_id").agg(F.min_by("module", "place").alias("found"))
    return rules.join(first, "rule_id", "left").withColumn("module", F.coalesce("module_key", "found", F.lit(default))).drop("found")


def keyword_judge(evidence: DataFrame, keys: list[str], text: str, red: list[str], amber: list[str]) -> DataFrame:
    """Our default instead of a model: Red if a text has a red word, else Amber for an amber one, else Green; confidence is the
    share of texts that speak for the status."""
    has = lambda words: F.lower(text).rlike(r"\b(" + "|".join(words) + r")\b")
    each = evidence.withColumn("_s", F.when(has(red), 3).when(has(amber), 2).otherwise(1))
    counts = each.groupBy(*keys, "_s").agg(F.count("*").alias("_n"))  # three rows at most for each of keys
    out = counts.groupBy(*keys).agg(F.max("_s").alias("_top"), F.sum("_n").alias("n_evidence"), F.max_by("_n", "_s").alias("_agree"))
    status = F.when(F.col("_top") == 3, "Red").when(F.col("_top") == 2, "Amber").otherwise("Green")
    return out.select(*keys, status.alias("status"), (F.col("_agree") / F.col("n_evidence")).alias("confidence"), "n_evidence")


def judged(payloads: DataFrame, judge: Callable[[DataFrame], DataFrame] | None, keys: list[str], **words) -> DataFrame:
    """The place where an outside model is plugged in: judge maps payloads to keys, status, confidence, n_evidence."""
    return judge(payloads) if judge else keyword_judge(payloads, keys, "text", **words)


def with_no_hits(rules: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """results: keys, status, confidence, n_evidence. Rules without a result are Red with a fixed reasoning."""
    missing = rules.select(*keys).join(results, keys, "left_anti")
    missing = missing.select(*keys, F.lit("Red").alias("status"), F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("n_evidence"), F.lit(NO_EVIDENCE).alias("reasoning"))
    return results.withColumn("reasoning", F.lit(None).cast("string")).unionByName(missing)


def clean_evidence(texts: Column) -> Column:
    """Trimmed, of ten characters or more, with a letter."""
    return F.filter(F.transform(texts, lambda x: F.trim(x)), lambda t: (F.length(t) >= 10) & t.rlike("[A-Za-z]"))


def evidence_rows(results: DataFrame, library: DataFrame, key: str, default: str = "General") -> DataFrame:
    """results: key, evidence (array of struct<text, item>). A row for each: its section from a bold beginning (at most 255
    characters, of which clause_type has 100), the text after it, and the library item if the library has it."""
    rows = results.select(key, F.posexplode("evidence").alias("idx", "e")).select(key, "idx", "e.text", "e.item")
    bold = F.regexp_extract("text", BOLD, 1)
    section = F.when(bold != "", bold).otherwise(default)
    rows = rows.withColumns({"section": F.substring(section, 1, 255), "clause_type": F.substring(section, 1, 100), "text": F.regexp_replace("text", BOLD + r"\n\n", "")})
    known = library.select("item", F.lit(True).alias("_known"))
    return rows.join(known, "item", "left").withColumn("item", F.when(F.col("_known"), F.col("item"))).drop("_known")


def attributed(evidence: DataFrame, chunks: DataFrame, doc: str, least: int = 12) -> DataFrame:
    """evidence: doc, idx, text; chunks: doc, chunk_id, chunk_rank, chunk, similarity. The first chunk in order that has the text
    or whose first 100 characters the text has; a chunk's second use keeps the similarity but not its id."""
    a, b = evidence.alias("a"), chunks.alias("b")
    within = (F.length("a.text") >= least) & (F.col("b.chunk").contains(F.col("a.text")) | F.col("a.text").contains(F.substring("b.chunk", 1, 100)))
    hits = a.join(b, (F.col(f"a.{doc}") == F.col(f"b.{doc}")) & within, "left").select("a.*", "b.chunk_id", "b.chunk_rank", "b.similarity")
    first = hits.withColumn("_n", F.row_number().over(Window.partitionBy(doc, "idx").orderBy(F.asc_nulls_last("chunk_rank"), "chunk_id"))).filter("_n = 1")
    use = F.row_number().over(Window.partitionBy(doc, "chunk_id").orderBy("idx"))
    return first.withColumn("chunk_id", F.when(use == 1, F.col("chunk_id"))).drop("_n", "chunk_rank")


def evidence_stats(items: DataFrame, keys: list[str]) -> DataFrame:
    """items: keys, section, item, manual, confidence (items may be missing: nulls count as none)."""
    return items.groupBy(*keys).agg(
        F.count("section").alias("total"), F.countDistinct("section").alias("sections"), F.count_if(F.col("item").isNotNull()).alias("matched"),
        F.count_if(F.coalesce("manual", F.lit(False))).alias("manual"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average"),
    )


def finished(results: DataFrame, plans: DataFrame, key: str) -> DataFrame:
    """plans: key, total. Those with as many results as were planned."""
    counts = results.groupBy(key).agg(F.count("*").alias("done"))
    return plans.join(counts, key, "left").select(key, "total", F.coalesce("done", F.lit(0)).alias("done")).withColumn("complete", F.col("done") >= F.col("total"))


PREFIX = r"^(exclusion|clause|provision|article|section):\s*"  # Fixed value: what stands before a clause's own name


def bare_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.lower(c)), PREFIX, ""))


def whole_word(text: Column, word: Column) -> Column:
    """word, whatever signs it has, stands in text with no letter, digit or underscore on either side of its own."""
    escaped = F.regexp_replace(word, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    return F.rlike(F.lower(text), F.concat(F.lit(r"\b"), escaped, F.lit(r"\b")))


def name_matches(rules: DataFrame, clauses: DataFrame) -> DataFrame:
    """Pairs (rule_id, clause_id) of rules (rule_id, name, description, keywords) and clauses (clause_id, name) that speak of one thing.

    A clause's bare name (lower case, without a leading "clause:", three characters or more) and the rule's name or one of its
    keywords hold one another, or the rule's description holds the bare name, if that has over five characters. Null or empty
    names, descriptions and keywords match nothing. Both ways go through an automaton of the distinct names: no pair is tried.
    """
    names = clauses.select("clause_id", bare_name(F.col("name")).alias("c")).filter(F.length("c") >= 3)
    distinct = names.select("c").distinct()
    keywords = F.transform(F.coalesce("keywords", F.array().cast("array<string>")), bare_name)
    fields = F.concat(F.array(F.struct(F.lit(0).alias("kind"), F.lower("name").alias("t"))), F.transform(keywords, lambda k: F.struct(F.lit(1).alias("kind"), k.alias("t"))), F.array(F.struct(F.lit(2).alias("kind"), F.lower("description").alias("t"))))
    rows = rules.select("rule_id", F.explode(fields).alias("f")).select("rule_id", "f.kind", "f.t").filter(F.coalesce("t", F.lit("")) != "").distinct()
    texts = rows.select("t").distinct()
    held = found_parts(texts.withColumn("u", F.col("t")), distinct.withColumnRenamed("c", "part"), "t", "u").withColumnRenamed("part", "c")
    holds = found_parts(distinct.withColumn("u", F.col("c")), rows.filter("kind < 2").select(F.col("t").alias("part")), "c", "u").withColumnRenamed("part", "t")
    first = rows.join(held.select("t", "c"), "t").filter((F.col("kind") < 2) | (F.length("c") > 5))
    second = rows.filter("kind < 2").join(holds.select("t", "c"), "t")
    return first.select("rule_id", "c").unionByName(second.select("rule_id", "c")).distinct().join(names, "c").select("rule_id", "clause_id")


def matched_rules(rules: DataFrame, clauses: DataFrame) -> DataFrame:
    """rule_id, matched: whether any clause matches the rule by name_matches(), or one of its keywords is a whole word of its own name or description."""
    pairs = name_matches(rules, clauses).select("rule_id").distinct().withColumn("_hit", F.lit(True))
    keywords = F.filter(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), bare_name), lambda k: F.coalesce(k, F.lit("")) != "")
    own = F.exists(keywords, lambda k: whole_word(F.coalesce("name", F.lit("")), k) | whole_word(F.coalesce("description", F.lit("")), k))
    any_clause = clauses.select(bare_name(F.col("name")).alias("c")).filter(F.length("c") >= 3).limit(1).count() > 0
    rows = rules.select("rule_id", own.alias("_own")).join(pairs, "rule_id", "left")
    return rows.select("rule_id", (F.coalesce("_hit", F.lit(False)) | (F.col("_own") & F.lit(any_clause))).alias("matched"))


def chunks_of(rules: DataFrame, retrieved: DataFrame, detected: DataFrame, item: str, least: int = 20, confidence: float = 0.85) -> DataFrame:
    """rule_id, item, text, similarity, origin: what each rule is judged by, at least a row for each rule.

    retrieved: rule_id, item, similarity (similarity.retrieved). A rule that has none takes the detected clauses (clause_id,
    name, text, confidence) that name_matches() gives it, if their text has `least` characters; their similarity is the stored
    confidence, or ours where it is null. A rule without either has one row of nulls, of origin "none".
    """
    retrieved = once(retrieved)  # it is read by each job of name_matches() and several times by the result
    got = retrieved.select("rule_id", F.col(item).cast("long").alias("item"), F.lit(None).cast("string").alias("text"), "similarity", F.lit("retrieved").alias("origin"))
    rest = rules.join(retrieved.select("rule_id").distinct(), "rule_id", "left_anti")
    texts = detected.filter(F.length("text") >= least)
    pairs = name_matches(rest, texts).join(texts.select("clause_id", "text", "confidence"), "clause_id")
    named = pairs.select("rule_id", F.col("clause_id").cast("long").alias("item"), "text", F.coalesce("confidence", F.lit(confidence)).alias("similarity"), F.lit("detected").alias("origin"))
    nothing = rest.join(named.select("rule_id").distinct(), "rule_id", "left_anti")
    alone = nothing.select("rule_id", F.lit(None).cast("long").alias("item"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("similarity"), F.lit("none").alias("origin"))
    return got.unionByName(named).unionByName(alone)
