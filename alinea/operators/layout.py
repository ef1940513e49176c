"""Document maps from layouts, outlines as trees, and where in them an evidence stands. All within a row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alinea.config import DEFAULT, Config
from alinea.functions.headings import is_heading, is_layout_heading, is_noise_line, is_orphan_label
from alinea.functions.text import cleaned, let, squeeze

ANCHOR = "textAnchor struct<textSegments: array<struct<startIndex: string, endIndex: string>>>"
#: What is read of a layout's JSON; offsets may be numbers or strings of digits.
LAYOUT = f"text string, entities array<struct<type: string, mentionText: string, text: string, {ANCHOR}>>, pages array<struct<paragraphs: array<struct<layout: struct<{ANCHOR}>>>>>"
PIECE = 1024  # characters; a text's parts are cut from pieces, as a part's place in a text is found by walking from its start
LONGEST = 20_000  # characters of a text without sections that become its one paragraph


def offset(segments: Column, name: str) -> Column:
    """The first segment's offset; one that is missing, or no number, is 0."""
    return F.coalesce(F.get(segments, F.lit(0))[name].try_cast("int"), F.lit(0))


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0))


def anchored(pieces: Column, segments: Column) -> Column:
    """The part of a text, given in pieces, that the first segment marks."""

    def part(low: Column, high: Column) -> Column:
        first, last = F.floor(low / PIECE).cast("int"), F.floor((high - 1) / PIECE).cast("int")
        some = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
        return F.when(high > low, F.substring(some, low % PIECE + 1, high - low)).otherwise("")

    ends = F.array(offset(segments, "startIndex"), offset(segments, "endIndex"))
    return let(ends, lambda e: part(F.greatest(F.array_min(e), F.lit(0)), F.array_max(e)))


def sectioned(items: Column, first: str) -> Column:
    """array<struct<section, heading, paragraphs>> of items (text, heads): paragraphs belong to the last heading above them.

    Those before any heading belong to section 0, which is named `first`; headings count from 1.
    """
    places = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))
    heads = F.filter(places, lambda i: F.get(items, i)["heads"])
    opens = lambda heads: (F.size(items) > 0) & ((F.size(heads) == 0) | (F.get(heads, F.lit(0)) > 0))

    def sections(starts: Column) -> Column:
        def one(s: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(items))
            heading = F.when(s < 0, F.lit(first)).otherwise(F.get(items, s)["text"])
            paragraphs = F.transform(F.slice(items, s + 2, end - s - 1), lambda x: x["text"])
            number = k + F.when(F.get(starts, F.lit(0)) < 0, 0).otherwise(1)
            return F.struct(number.cast("long").alias("section"), heading.alias("heading"), paragraphs.alias("paragraphs"))

        return F.transform(starts, one)

    return let(let(heads, lambda h: F.when(opens(h), F.concat(F.array(F.lit(-1)), h)).otherwise(h)), sections)


def without_labels(items: Column) -> Column:
    """A lone label goes before the item that follows; of two in a row the second counts, the last is lost."""

    def one(text: Column, i: Column) -> Column:
        before = F.get(items, i - 1)
        joined = F.when(F.coalesce(is_orphan_label(before), F.lit(False)), F.concat_ws(" ", before, text)).otherwise(text)
        return F.when(~is_orphan_label(text), joined)

    return F.filter(F.transform(items, one), lambda t: t.isNotNull())  # items is a name, as it is read for each


def clean_items(raw: Column, cfg: Config) -> Column:
    """Without noise, which is looked for before a text is cleaned."""
    kept = F.filter(raw, lambda t: F.coalesce(t != "", F.lit(False)) & ~is_noise_line(t, cfg))
    return F.filter(F.transform(kept, cleaned), lambda t: t != "")


def first_number(heading: Column) -> Column:
    return F.nullif(F.regexp_extract(heading, r"[0-9]+(?:[.][0-9]+)*", 0), F.lit(""))


def of_entities(layout: Column, cfg: Config) -> Column:
    """Sections of marked entities, in the order of their anchors: those of a heading's type open one."""
    placed = F.transform(layout["entities"], lambda e, i: F.struct(offset(e["textAnchor"]["textSegments"], "startIndex").alias("start"), i.alias("i"), F.lower(F.coalesce(e["type"], F.lit(""))).alias("type"), F.coalesce(F.nullif(e["mentionText"], F.lit("")), e["text"], F.lit("")).alias("text")))
    kept = F.filter(F.array_sort(placed), lambda e: (e["text"] != "") & ~is_noise_line(e["text"], cfg))
    heads = lambda e: F.exists(F.array(*[F.lit(x) for x in cfg.layout_types]), lambda x: e["type"].contains(x))
    items = F.filter(F.transform(kept, lambda e: F.struct(cleaned(e["text"]).alias("text"), heads(e).alias("heads"))), lambda x: x["text"] != "")
    sections = let(items, lambda x: sectioned(x, "Introduction"))
    return F.transform(sections, lambda s: s.withField("number", F.lit(None).cast("string")))


def of_pages(layout: Column, cfg: Config) -> Column:
    """Sections of the pages' paragraphs, by the stricter test for headings."""
    paragraphs = F.flatten(F.transform(layout["pages"], lambda p: F.coalesce(p["paragraphs"], F.array().cast("array<struct<layout: struct<" + ANCHOR + ">>>"))))
    raw = let(pieces(layout["text"]), lambda p: F.transform(paragraphs, lambda q: anchored(p, q["layout"]["textAnchor"]["textSegments"])))
    items = F.transform(let(clean_items(raw, cfg), without_labels), lambda t: F.struct(t.alias("text"), is_layout_heading(t, cfg).alias("heads")))
    sections = let(items, lambda x: sectioned(x, "General Provisions"))
    return F.transform(sections, lambda s: s.withField("number", F.when(s["section"] > 0, first_number(s["heading"]))))


def layout_map(df: DataFrame, key: str, layout: str, cfg: Config = DEFAULT) -> DataFrame:
    """key, title, section, heading, number, paragraphs: the map of each layout (JSON), a row a section.

    Marked entities come first, else page paragraphs; a section without paragraphs whose heading is noise goes. A layout
    without text, null or no JSON is told so in one section; one that leaves no section has its text's start as one.
    Offsets count code points.
    """
    parsed = df.select(key, F.from_json(F.col(layout), LAYOUT).alias("x"))
    found = F.when(F.size("x.entities") > 0, of_entities(F.col("x"), cfg)).when(F.col("x.pages").isNotNull(), of_pages(F.col("x"), cfg))
    parsed = parsed.select(key, F.col("x.text").alias("text"), found.alias("found"))
    kept = F.filter(F.coalesce("found", F.array().cast("array<struct<section: bigint, heading: string, paragraphs: array<string>, number: string>>")), lambda s: (F.size(s["paragraphs"]) > 0) | ~is_noise_line(s["heading"], cfg))
    lone = lambda heading, text: F.array(F.struct(F.lit(0).cast("long").alias("section"), F.lit(heading).alias("heading"), F.array(text).alias("paragraphs"), F.lit(None).cast("string").alias("number")))
    empty = F.coalesce(F.col("text") == "", F.lit(True))
    out = parsed.select(key, "text", empty.alias("empty"), kept.alias("kept"))
    title = F.when(F.col("empty"), "Document Content").when(F.size("kept") == 0, "Initial Extraction Map").otherwise("Document Map")
    sections = F.when(F.col("empty"), lone("Main Text", F.lit("No text extracted."))).when(F.size("kept") == 0, lone("Extracted Text", F.substring("text", 1, LONGEST))).otherwise(F.col("kept"))
    names = ("section", "heading", "number", "paragraphs")
    titled = F.transform(sections, lambda s: F.struct(title.alias("title"), *[s[n].alias(n) for n in names]))  # beside the array the whole map would be copied for each section
    return out.select(key, F.explode(titled).alias("s")).select(key, "s.title", *[f"s.{n}" for n in names])


def heuristic_map(df: DataFrame, key: str, text: str, split: str = r"\n{2,}", cfg: Config = DEFAULT) -> DataFrame:
    """key, section, heading, number, paragraphs: blocks of a text under the headings among them, a row a section."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), split), squeeze), lambda b: F.length(b) > 2)
    rows = df.select(key, F.transform(parts, lambda b: F.struct(b.alias("text"), is_heading(b, cfg).alias("heads"))).alias("items"))
    rows = rows.select(key, F.explode(let(F.col("items"), lambda x: sectioned(x, "Introduction"))).alias("s"))
    number = F.when(F.col("s.section") > 0, F.nullif(F.regexp_extract("s.heading", r"^([0-9]+(?:[.][0-9]+)*)", 1), F.lit("")))
    return rows.select(key, "s.section", "s.heading", number.alias("number"), "s.paragraphs")


# Outlines


def outline(sections: DataFrame, key: str) -> DataFrame:
    """sections (key, section, heading, number, ...) with depth, parent, last and path: the tree that their numbers make.

    A number of k levels has depth k, a heading without one depth 1. The parent is the last section above of a smaller depth
    (null at the top); last is the last section below it, so that section to last is the interval of all it holds; path
    has the headings from the top down to its own. Sections of one document are gathered as numbers and headings alone.
    """
    levels = F.when(F.col("number").isNull(), 1).otherwise(F.size(F.split("number", "[.]")))
    every = F.array_sort(F.collect_list(F.struct(F.col("section"), levels.alias("depth"), F.col("heading"))))
    nodes = sections.groupBy(key).agg(every.alias("nodes"))
    # the open branch at each node: one fold, in which a node closes what is as deep as it or deeper
    kind = "array<struct<section: bigint, depth: int, heading: string>>"

    def step(state: Column, node: Column) -> Column:
        branch = F.concat(F.filter(state["open"], lambda o: o["depth"] < node["depth"]), F.array(node))
        return F.struct(branch.alias("open"), F.concat(state["rows"], F.array(F.struct(node["section"].alias("section"), branch.alias("branch")))).alias("rows"))

    start = F.struct(F.array().cast(kind).alias("open"), F.array().cast(f"array<struct<section: bigint, branch: {kind}>>").alias("rows"))
    folded = nodes.select(key, F.aggregate(F.col("nodes").cast(kind), start, step)["rows"].alias("rows"))
    # a node is held by all of its branch; the last that a section holds closes its interval
    held = lambda rows, s: F.array_max(F.transform(F.filter(rows, lambda r: F.exists(r["branch"], lambda b: b["section"] == s)), lambda r: r["section"]))
    each = F.transform("rows", lambda r: F.struct(r["section"].alias("section"), F.size(r["branch"]).alias("depth"), F.get(r["branch"], F.size(r["branch"]) - 2)["section"].alias("parent"), held(F.col("rows"), r["section"]).alias("last"), F.array_join(F.transform(r["branch"], lambda b: b["heading"]), " > ").alias("path")))
    tree = folded.select(key, F.explode(each).alias("t")).select(key, "t.*")
    return sections.join(tree, [key, "section"])


def breadcrumbs(evidence: DataFrame, sections: DataFrame, key: str, text: str) -> DataFrame:
    """evidence with section, heading, number: the first section with a paragraph that holds the evidence or that it holds; null without one.

    A number that a section lacks is its parent's with a mark (outline() gives parent). Empty evidence stands nowhere.
    """
    parts = sections.select(key, "section", F.explode("paragraphs").alias("_p"))
    hits = evidence.filter(F.col(text) != "").select(key, text).join(parts, key).filter(F.col("_p").contains(F.col(text)) | F.col(text).contains(F.col("_p")))
    first = hits.groupBy(key, text).agg(F.min("section").alias("section"))  # by what the evidence says: numbers given to rows differ when rows are read again
    named = first.join(sections.select(key, "section", "heading", "number"), [key, "section"])
    return evidence.join(named, [key, text], "left").select(*evidence.columns, "section", "heading", "number")
