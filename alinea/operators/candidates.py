"""Candidate provisions: from sections, by-name references and coded references, without noise and near duplicates."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alinea.config import DEFAULT, Config
from alinea.functions.headings import is_label_heading, joined_heading
from alinea.functions.text import body_key, code_key, haystack_key, heading_key, name_key, squeeze
from alinea.operators.classify import tiered
from alinea.operators.docmap import is_fallback
from alinea.operators.patterns import found_items
from alinea.operators.relations import first_by
from alinea.operators.similarity import matched_texts

# The marks behind the name of a provision that is attached, and the lengths that names and codes may have.
ATTACHED = r"(?i)[(]\s*(as attached|as per attached|as expiring)\s*[)]"
NAME_CHARS, ATTACHED_CHARS, CODED_CHARS, LOOK_BACK, CODE_CHARS = 3, 70, 80, 80, 5

SMALL_WORDS = ["of", "and", "the", "for", "to", "in", "or", "by", "with", "on", "&", "/", "-"]


def last_name(lead: Column) -> Column:
    """The name that a text ends with. Its words are read from the last one back: those with a capital or digit, and small words
    between them; the end of a sentence, a label in capitals and any other word stop the reading."""
    words = F.reverse(F.filter(F.split(squeeze(lead), " "), lambda w: w != ""))

    def step(s: Column, w: Column) -> Column:
        ends = w.rlike(r"[.;:!?]$") | w.rlike(r"^[A-Z]{3,}$") | ~(w.rlike(r"^['(&]*[A-Z0-9]") | w.isin(SMALL_WORDS))
        return F.when(s["ended"] | ends, F.struct(F.lit(True).alias("ended"), s["name"].alias("name"))).otherwise(F.struct(F.lit(False).alias("ended"), F.concat_ws(" ", w, F.nullif(s["name"], F.lit(""))).alias("name")))

    name = F.aggregate(words, F.struct(F.lit(False).alias("ended"), F.lit("").alias("name")), step, lambda s: s["name"])
    name = F.regexp_replace(name, r"^((" + "|".join(w for w in SMALL_WORDS if w.isalpha()) + r"|[&/-]) )+", "")
    name = F.regexp_replace(name, r"(?i)^(\S+) \1\b", "$1")  # a label that is the name's first word again
    return F.regexp_replace(name, r"^[,.\-\s]+|[,.\-\s]+$", "")


def references(df: DataFrame, key: str, text: str, mark: str, longest: int) -> DataFrame:
    """key, idx, name, mark: what is named before each mark (group 1 of the pattern), where it reads like a provision's name."""
    t = F.coalesce(F.col(text), F.lit(""))
    leads, marks = F.split(t, mark), F.regexp_extract_all(t, F.lit(mark), F.lit(1))
    rows = df.select(key, F.posexplode(F.arrays_zip(F.slice(leads, F.lit(1), F.size(marks)).alias("lead"), marks.alias("mark"))).alias("idx", "x"))
    rows = rows.select(key, "idx", last_name(F.right("x.lead", F.lit(LOOK_BACK))).alias("name"), squeeze(F.col("x.mark")).alias("mark"))
    named = F.lower("name").rlike(r"\bclause\b") | (F.size(F.split("name", " ")) >= 2)
    return rows.filter(named & F.length("name").between(NAME_CHARS, longest))


def attached_references(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, idx, name: names before "(as attached)", one for each heading key, in order."""
    rows = references(df, key, text, ATTACHED, ATTACHED_CHARS).filter(F.length(F.regexp_replace(name_key(F.col("name")), " ", "")) >= 4)
    return first_by(rows.withColumn("_k", heading_key(F.col("name"))), [key, "_k"], F.col("idx")).select(key, "idx", "name")


def coded_references(df: DataFrame, key: str, text: str, cfg: Config = DEFAULT) -> DataFrame:
    """key, idx, name, code: names before "(CODE)", one for each code, in order."""
    mark = r"[(]\s*(" + cfg.code_pattern.replace(r"\b", "") + r")\s*[)]"
    rows = references(df, key, text, mark, CODED_CHARS).withColumn("_k", code_key(F.col("mark"))).filter(F.length("_k") >= CODE_CHARS)
    return first_by(rows, [key, "_k"], F.col("idx")).select(key, F.col("idx").cast("long").alias("idx"), "name", F.col("mark").alias("code"))


def without_label_headings(rows: DataFrame, key: str, running: DataFrame | None, cfg: Config) -> DataFrame:
    """rows: key, heading, _k (its key), ...; without those whose heading is a label or, if not protected, a running header."""
    if running is None:
        return rows.filter(~is_label_heading(F.col("heading"), None, cfg))
    told = rows.join(running.select(key, F.col("line_key").alias("_k"), F.lit(True).alias("_r")), [key, "_k"], "left")
    return told.filter(~is_label_heading(F.col("heading"), F.coalesce(F.col("_r"), F.lit(False)), cfg)).drop("_r")


def built(sections: DataFrame, key: str, running: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """sections: key, section, heading, body. Joined headings, without fallbacks and labels, once for each heading and body start."""
    rows = sections.withColumn("heading", joined_heading(F.col("heading"), F.coalesce("body", F.lit(""))))
    rows = rows.filter(~is_fallback(F.col("heading"), cfg)).withColumn("_k", heading_key(F.col("heading")))
    rows = without_label_headings(rows, key, running, cfg)
    w = Window.partitionBy(key, "_k", F.substring(heading_key(F.coalesce("body", F.lit(""))), 1, 160)).orderBy("section")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(key, "section", "heading", "body", "_k")


def with_references(candidates: DataFrame, attached: DataFrame, coded: DataFrame, key: str, running: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Candidates with code (null), and below them the references that are new: those by name, then those by code, in order.

    attached: key, idx, name; coded: key, idx, name, code. A reference goes if its name is a label or a running header, if it has no
    heading key, or if a candidate or a reference before it has that key.
    """
    of = lambda df, place, code: df.select(key, F.lit(place).alias("_place"), F.col("idx").cast("long").alias("section"), F.col("name").alias("heading"), F.lit("").alias("body"), heading_key(F.col("name")).alias("_k"), code.alias("code"))
    refs = of(attached, 0, F.lit(None).cast("string")).unionByName(of(coded, 1, F.col("code"))).filter("_k <> ''")
    refs = first_by(without_label_headings(refs, key, running, cfg), [key, "_k"], F.col("_place"), F.col("section")).drop("_place")
    known = candidates.select(F.col(key).alias("_key"), F.col("_k").alias("_known"))
    new = refs.join(known, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_k") == F.col("_known")), "left_anti")
    return candidates.withColumn("code", F.lit(None).cast("string")).unionByName(new)


class Kept:
    """Bodies of one name that are kept, in order as well, so that a common start is looked up and not compared with each."""

    def __init__(self) -> None:
        self.bodies: list[str] = []
        self.ordered: list[str] = []

    def has(self, own: str, start: str) -> bool:
        at = bisect_left(self.ordered, start)
        return (at < len(self.ordered) and self.ordered[at].startswith(start)) or any(own in k for k in self.bodies)

    def add(self, own: str) -> None:
        self.bodies.append(own)
        insort(self.ordered, own)


def without_near_duplicates(rows: DataFrame, key: str, name: str, ordinal: str, body: str, least: int = 60, share: float = 0.92) -> DataFrame:
    """Of rows with one name, longest body first: one goes if its squeezed body is short, inside a kept one, or has a common
    start of 92 % of the shorter with a kept one. It is compared with kept rows only, so the order matters: a fold by group.

    Tasks walk through sorted rows, many groups in one batch, and hold the kept bodies of one group at a time.
    """
    bare = F.regexp_replace(F.lower(F.coalesce(F.col(body), F.lit(""))), "[^a-z0-9]", "")
    dealt = rows.withColumn("_bare", bare).repartition(key, name).sortWithinPartitions(key, name, F.desc(F.length("_bare")), ordinal)
    columns = rows.columns

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept = None, Kept()
        for batch in batches:
            stays = []
            for *now, own in zip(*(batch.column(c).to_pylist() for c in (key, name, "_bare")), strict=True):
                if now != group:
                    group, kept = now, Kept()
                first = not kept.bodies
                good = first or (len(own) >= least and not kept.has(own, own[: ceil(max(1, share * len(own)))]))
                if good:
                    kept.add(own)
                stays.append(good)
            yield batch.filter(pa.array(stays, pa.bool_())).select(columns)

    return dealt.mapInArrow(walk, rows.schema)


def code_index(library: DataFrame, item: str, code: str) -> DataFrame:
    """code key, item: keys of five characters or more; of one key the global item of the smallest id counts."""
    rows = library.select(item, "is_global", code_key(F.col(code)).alias("code_key")).filter(F.length("code_key") >= 5)
    w = Window.partitionBy("code_key").orderBy(F.desc("is_global"), item)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("code_key", item)


def name_index(library: DataFrame, item: str, name: str) -> DataFrame:
    rows = library.select(item, "is_global", name_key(F.col(name)).alias("name_key")).filter(F.length(F.regexp_replace("name_key", " ", "")) >= 4)
    w = Window.partitionBy("name_key").orderBy(F.desc("is_global"), item)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("name_key", item)


def appendices(candidates: DataFrame, sections: DataFrame, key: str, least: int = 80) -> DataFrame:
    """For each candidate the longest section of its document with the same name and a body of over `least` characters."""
    a = candidates.select(key, "section", name_key(F.col("heading")).alias("name_key"))
    b = sections.select(key, F.col("section").alias("other"), name_key(F.col("heading")).alias("name_key"), "body").filter(F.length("body") > least)
    hits = a.join(b, [key, "name_key"]).filter("section <> other")
    return hits.groupBy(key, "section").agg(F.max_by(F.struct("other", "body"), F.struct(F.length("body"), -F.col("other"))).alias("x")).select(key, "section", "x.other", "x.body")


def attached_wordings(df: DataFrame, key: str, text: str, least: int = 80, most: int = 6000) -> DataFrame:
    """key, wording_key, body: lines below a heading in capitals up to the next, up to `most` characters; the longest of a key."""
    lines = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line"))
    letters = F.regexp_replace("line", "[^A-Za-z]", "")
    capitals = F.length(F.regexp_replace(letters, "[^A-Z]", "")) >= 0.8 * F.length(letters)
    lines = lines.withColumn("is_heading", F.length(F.trim("line")).between(4, 80) & (F.length(letters) > 0) & capitals)
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("block", F.sum(F.col("is_heading").cast("int")).over(w)).filter("block > 0")
    rows = lines.groupBy(key, "block").agg(F.max(F.when(F.col("is_heading"), F.col("line"))).alias("heading"), F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("pos", "line")))).alias("x"))
    rows = rows.select(key, body_key(F.col("heading")).alias("wording_key"), F.substring(F.array_join(F.transform("x", lambda v: v["line"]), "\n"), 1, most).alias("body")).filter(F.length("body") > least)
    return rows.groupBy(key, "wording_key").agg(F.max_by("body", F.length("body")).alias("body"))


def in_tiers(rows: DataFrame, library: DataFrame, key: str, cfg: Config = DEFAULT, head: int = 200) -> DataFrame:
    """rows (key, heading, body) with tier, item, similarity: by name before by code before by text; null without any.

    library: item, name, code, text, is_global. By name: the heading's name key is an item's. By code: the longest code key of
    five characters or more that the heading and the first `head` characters of the body have between them. By text: exact, or
    the nearest within the library distance. key and item are unique numbers.
    """
    names = name_index(library, "item", "name")
    by_name = rows.select(key, name_key(F.col("heading")).alias("name_key")).join(names, "name_key").select(key, F.col("item"), F.lit(1.0).alias("similarity"))
    codes = code_index(library, "item", "code").select("item", "code_key", F.length("code_key").alias("_n"))
    hay = rows.select(key, haystack_key(F.concat_ws(" ", "heading", F.substring("body", 1, head))).alias("_hay"))
    hits = found_items(hay, codes, key, "_hay", "code_key")
    by_code = hits.groupBy(key).agg(F.max_by("item", F.struct("_n", -F.col("item"))).alias("item")).withColumn("similarity", F.lit(1.0))
    near = matched_texts(rows.select(key, F.col("body").alias("text")), library.select("item", "text"), key, "item", 1, cfg)
    return tiered(rows, by_name, by_code, near.select(key, "item", "similarity"), key)
