"""What a line is: noise, a heading, a label, half of a heading. Rules over a line's words; the word lists are in the config."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from alinea.config import DEFAULT, Config
from alinea.functions.text import heading_key, let, squeeze

DIGITS, CAPITALS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def consists_of(c: Column, signs: str) -> Column:
    """Nothing is left of c without these signs."""
    return F.translate(c, signs, "") == ""


def plain_words(c: Column) -> Column:
    """The words of a line in lower case, all other signs taken as blanks."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def has_phrase(c: Column, phrases: tuple[str, ...]) -> Column:
    """One of the phrases is among the line's words, in a row."""
    padded = F.concat(F.lit(" "), F.array_join(plain_words(c), " "), F.lit(" "))
    return F.exists(F.array(*[F.lit(f" {p} ") for p in phrases]), lambda p: padded.contains(p)) if phrases else F.lit(False)


def starts_with_any(c: Column, starts: tuple[str, ...]) -> Column:
    return c.rlike("^(?:" + "|".join(re.escape(s) for s in starts) + ")") if starts else F.lit(False)


def loose(s: str) -> str:
    """A pattern of s with any blanks between its signs: what recognition has run together or torn apart counts as well."""
    return " *".join(re.escape(x) for x in s.replace(" ", ""))


def n_words(c: Column) -> Column:
    return F.size(F.split(c, " "))


def is_noise_line(c: Column, cfg: Config = DEFAULT) -> Column:
    """Page numbers, separators, single letters, codes, marks and headers of pages, errors of recognition. Null is noise.

    Few patterns, which end at a line's first other sign: most lines are no noise, and there are many.
    """
    return let(squeeze(F.coalesce(c, F.lit(""))), lambda line: let(F.lower(line), lambda low: _is_noise(line, low, cfg)))


def _is_noise(line: Column, low: Column, cfg: Config) -> Column:
    bare = ~low.rlike("[a-z0-9]")
    single = (F.length(line) == 1) & low.rlike("[a-z]")
    shapes = [r"[0-9]+(?: of [0-9]+| [a-z]{2,4})?\z", r"[0-9.\- ]{1,10}\z", r"[a-z0-9]{2,} [a-z0-9]{2,} [a-z0-9]{2,}\z", *[" *" + loose(s) for s in cfg.noise_starts]]
    shaped = low.rlike("^(?:" + "|".join(shapes) + ")")
    told = (F.length(line) < 50) & low.contains("page") & low.contains("of")
    a_number = lambda w: (w != "") & consists_of(w, DIGITS)
    of_pages = lambda words: F.forall(words, lambda w: w.isin("page", "of") | a_number(w)) & F.array_contains(words, "page")
    paged = (low.startswith("page") | low.startswith("of ") | F.left(low, F.lit(1)).between("0", "9")) & let(F.split(low, " "), of_pages)
    dense = lambda d: reduce(or_, [d.contains(s.replace(" ", "")) for s in cfg.noise_contains], F.lit(False))
    return bare | single | shaped | told | paged | low.isin(*cfg.noise_lines) | let(F.replace(low, F.lit(" "), F.lit("")), dense)


def is_numbered(c: Column) -> Column:
    """A number with or without further levels, then, after dots or blanks, a capital."""
    return c.rlike(r"^[0-9][0-9.]*+(?: ++|(?<=[.]))[A-Z]")


def is_heading(c: Column, cfg: Config = DEFAULT) -> Column:
    """At most 150 characters and 22 words: a keyword and a number or word, a number and a capital, or up to 12 words in capitals.

    c has its blanks squeezed. A line of digits is none, nor are capitals with a verb of obligation.
    """
    words, low = n_words(c), F.split(F.lower(c), " ")
    second = F.coalesce(F.get(low, F.lit(1)), F.lit(""))
    keyword = low[0].isin(*cfg.heading_words) & second.rlike("^[.0-9a-z]")
    capitals = (F.length(c) >= 3) & consists_of(c, CAPITALS + DIGITS + " -/&") & consists_of(F.left(c, F.lit(1)), CAPITALS + DIGITS)
    capitals &= (words <= 12) & ~has_phrase(c, cfg.heading_verbs)
    return (F.length(c) <= 150) & (words <= 22) & ~consists_of(c, DIGITS) & (keyword | is_numbered(c) | capitals)


def is_layout_heading(c: Column, cfg: Config = DEFAULT) -> Column:
    """The stricter test for paragraphs of a layout: under 150 characters and 22 words, no code, a colon only after up to three words, no verb of obligation."""
    keyword = starts_with_any(F.lower(c), cfg.layout_starts)
    capitals = F.length(c).between(3, 100) & (F.upper(c) == c) & c.rlike("[A-Z]") & (n_words(c) < 10)
    before = F.substring_index(c, ":", 1)
    colon = ~c.contains(":") | (F.size(F.split(before, " ")) < 4)
    return (F.length(c) < 150) & (keyword | is_numbered(c) | capitals) & (n_words(c) < 22) & ~c.rlike(r"^[A-Z0-9]{8,}\z") & colon & ~has_phrase(c, cfg.layout_vetoes)


def is_orphan_label(c: Column) -> Column:
    """A single letter or digit in parentheses, or with the closing one alone."""
    bare = F.ltrim(F.lower(F.trim(c)), F.lit("("))
    return (F.length(F.trim(c)) <= 3) & (F.length(bare) == 2) & bare.endswith(")") & (F.regexp_replace(F.left(bare, F.lit(1)), "[a-z0-9]", "") == "")


def is_protected_heading(c: Column, cfg: Config = DEFAULT) -> Column:
    """A structural word with a figure or a roman one, or a library code, which an amount of money is not: such a heading is never noise."""
    words = F.split(F.lower(squeeze(c)), " ")
    coded = F.when(words[0].isin(*cfg.currencies), F.array_join(F.slice(F.split(squeeze(c), " "), 2, 99), " ")).otherwise(c).rlike(cfg.code_pattern)
    return (words[0].isin(*cfg.structural_words) & F.coalesce(F.get(words, F.lit(1)), F.lit("")).rlike("^[0-9ivxlcdm]")) | coded


def is_label_heading(c: Column, running: Column | None = None, cfg: Config = DEFAULT) -> Column:
    """A heading that is a field label, a running header, money, a number or an item of a list, and not protected."""
    h = F.regexp_replace(squeeze(F.lower(c)), r":+$", "")
    words = F.split(h, " ")
    last_two = F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2)), " ")
    ends = last_two.isin(*cfg.label_ends) | F.element_at(words, -1).isin(*cfg.label_ends)
    reference = F.regexp_replace(F.regexp_replace(h, r"\s*/\s*contact$", ""), r"[.]$", "").isin("ref", *[f"{p} ref" for p in cfg.label_references])
    party = h.isin([f"{a} {b}" for a in cfg.label_parties for b in cfg.label_fields])
    label = (h == "") | h.isin(*cfg.label_headings) | ends | reference | party
    money = F.when(words[0].isin(*cfg.currencies), F.array_join(F.slice(words, 2, 99), "")).otherwise(h)
    figures = F.translate(money, ",.%()- ", "")
    number = (figures != "") & (consists_of(figures, DIGITS) | consists_of(figures, DIGITS + "ivxlcdm"))
    item = F.trim(c).rlike(r"^[(]?[0-9]{1,3}[.)]\s+\S") & ((F.size(words) > 6) | has_phrase(c, cfg.prose_words))
    return label | (~is_protected_heading(c, cfg) & ((running if running is not None else F.lit(False)) | number | item))


def capital_run(c: Column, most: int) -> Column:
    """Up to so many words in capitals that a text begins with; a sign behind a word ends the run."""
    words = F.split(F.trim(c), r"\s+")
    bare = lambda w: F.rtrim(w, F.lit(".,:;)"))
    goes = lambda w: (F.length(bare(w)) >= 2) & consists_of(bare(w), CAPITALS)

    def step(state: Column, w: Column) -> Column:
        run = F.when(state["open"] & goes(w), F.concat(state["run"], F.array(bare(w)))).otherwise(state["run"])
        return F.struct(run.alias("run"), (state["open"] & goes(w) & (bare(w) == w)).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("run"), F.lit(True).alias("open"))
    return F.array_join(F.aggregate(F.slice(words, 1, most), start, step)["run"], " ")


def joined_heading(heading: Column, body: Column, cfg: Config = DEFAULT) -> Column:
    """A heading torn in two: what follows a short one in capitals that ends in a connecting word is taken from the body's start.

    That is a label before a colon, else up to three words; either in capitals, and not the heading said again.
    """
    h = squeeze(heading)
    torn = (F.length(h) <= 40) & consists_of(h, CAPITALS + DIGITS + " /&-") & F.element_at(plain_words(h), -1).isin(*[w.lower() for w in cfg.connecting_words])
    label = F.trim(F.when(F.trim(body).contains(":"), F.substring_index(F.trim(body), ":", 1)))
    label = F.when((F.length(label) <= 41) & consists_of(label, CAPITALS + "&/- ") & consists_of(F.left(label, F.lit(1)), CAPITALS) & consists_of(F.right(label, F.lit(1)), CAPITALS), label)
    own = heading_key(h)

    def new(part: Column) -> Column:
        k = heading_key(part)
        return F.when((k != "") & ~own.startswith(k) & ~k.startswith(own), squeeze(F.concat_ws(" ", h, part)))

    return F.when(torn, F.coalesce(new(label), new(capital_run(body, 3)), heading)).otherwise(heading)
