"""Document maps: sections with heading, number and paragraphs, as rows (doc, section, ...) and nested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alinea.config import DEFAULT, Config
from alinea.functions.text import heading_key, squeeze
from alinea.operators.layout import heuristic_map


def blocks(df: DataFrame, key: str, text: str, split: str = r"\n{2,}") -> DataFrame:
    """key, pos, block: parts of over two characters with blanks squeezed."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), split), squeeze), lambda b: F.length(b) > 2)
    return df.select(key, F.posexplode(parts).alias("pos", "block"))


def heuristic_sections(df: DataFrame, key: str, text: str, split: str = r"\n{2,}") -> DataFrame:
    """key, section, heading, number, n_paragraphs, body: paragraphs belong to the heading above, the first to Introduction."""
    sections = heuristic_map(df, key, text, split)
    return sections.select(key, "section", "heading", "number", F.size("paragraphs").cast("long").alias("n_paragraphs"), F.array_join("paragraphs", "\n\n").alias("body"))


def is_fallback(heading: Column, cfg: Config = DEFAULT) -> Column:
    h = F.trim(F.coalesce(heading, F.lit("")))
    return (h == "") | h.isin(*cfg.fallback_headings)


def has_quality(sections: DataFrame, key: str, cfg: Config = DEFAULT) -> DataFrame:
    """key, quality: at least one section has a heading that is no fallback."""
    return sections.groupBy(key).agg(F.bool_or(~is_fallback(F.col("heading"), cfg)).alias("quality"))


def sanitized(sections: DataFrame, key: str, cfg: Config = DEFAULT) -> DataFrame:
    """Without fallback sections, unless that leaves a document none."""
    w = Window.partitionBy(key)
    good = ~is_fallback(F.col("heading"), cfg)
    return sections.withColumn("_any", F.max(good.cast("int")).over(w)).filter(good | (F.col("_any") == 0)).drop("_any")


def merged_maps(sections: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Sections of several maps of a document: one for each heading and number, paragraphs once, in the order first seen."""
    named = sections.withColumn("_h", F.lower(F.trim("heading"))).withColumn("_n", F.coalesce("number", F.lit("")))
    heads = named.groupBy(key, "_h", "_n").agg(F.min(F.struct(ordinal, "heading")).alias("_first"))
    places = named.select(key, "_h", "_n", ordinal, F.posexplode("paragraphs").alias("_at", "_p"))
    once = places.groupBy(key, "_h", "_n", "_p").agg(F.min(F.struct(ordinal, "_at")).alias("_at"))  # before any list is built
    lists = once.groupBy(key, "_h", "_n").agg(F.array_sort(F.collect_list(F.struct("_at", "_p"))).alias("_l"))
    both = heads.alias("a").join(lists.alias("b"), F.expr(f"a.{key} <=> b.{key} and a._h <=> b._h and a._n = b._n"), "left")
    paragraphs = F.coalesce(F.transform("_l", lambda x: x["_p"]), F.array().cast(sections.schema["paragraphs"].dataType))
    return both.select(f"a.{key}", F.col(f"_first.{ordinal}").alias(ordinal), F.col("_first.heading").alias("heading"), F.nullif("a._n", F.lit("")).alias("number"), paragraphs.alias("paragraphs"))


def chosen_map(ai: DataFrame, heuristic: DataFrame, key: str, cfg: Config = DEFAULT) -> DataFrame:
    """The sections of ai where it has quality, those of heuristic elsewhere."""
    good = has_quality(ai, key, cfg).filter("quality").select(key)
    return ai.join(good, key, "left_semi").unionByName(heuristic.join(good, key, "left_anti"))


def search_text(sections: DataFrame, key: str, most: int = 12_000) -> DataFrame:
    """Headings and paragraphs in order, up to `most` characters."""
    parts = F.array_sort(F.collect_list(F.struct("section", F.concat_ws("\n", "heading", "body").alias("t"))))
    return sections.groupBy(key).agg(F.substring(F.array_join(F.transform(parts, lambda x: x["t"]), "\n"), 1, most).alias("search_text"))


def shifted(segments: DataFrame, parts: DataFrame, doc: str, part: str) -> DataFrame:
    """Anchors of merged parts: each is moved by the length of the parts before it. segments: doc, part, start, end; parts: doc, part, n."""
    w = Window.partitionBy(doc).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    by = parts.select(doc, part, F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_by"))
    moved = segments.join(by, [doc, part])
    return moved.withColumns({"start": F.coalesce(F.col("start").cast("long"), F.lit(0)) + F.col("_by"), "end": F.col("end").cast("long") + F.col("_by")}).drop("_by")


def overlapping_segments(found: DataFrame, segments: DataFrame, doc: str) -> DataFrame:
    """found: doc, low, high (a substring's range); segments: doc, page, start, end. Pages with their segments in range."""
    hits = found.join(segments, doc).filter((F.col("start") < F.col("high")) & (F.col("end") > F.col("low")))
    return hits.groupBy(doc, "low", "page").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("segments"))


def running_headers(df: DataFrame, key: str, text: str, least: int = 4, longest: int = 60) -> DataFrame:
    """key, line_key, n: normalised lines of at most `longest` characters that a document has `least` times or more.

    A row's lines are sorted, so that equal ones stand together: a line that is the same so many places on is one of them.
    """
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), heading_key)
    ordered = df.select(key, F.array_sort(F.filter(lines, lambda x: (x != "") & (F.length(x) <= longest))).alias("_lines"))
    often = F.transform("_lines", lambda x, i: F.when((x == F.get("_lines", i + least - 1)) & ~x.eqNullSafe(F.get("_lines", i - 1)), F.struct(x.alias("line_key"), i.alias("at"))))
    found = ordered.select(key, "_lines", F.explode(F.filter(often, lambda x: x.isNotNull())).alias("x"))
    return found.select(key, "x.line_key", F.size(F.filter("_lines", lambda x: x == F.col("x.line_key"))).cast("long").alias("n"))
