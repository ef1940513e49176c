"""Text to chunks: greedy folds inside one row, so nothing is shuffled. Input: any frame with a text column; output: array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alinea.config import DEFAULT, Config

EMPTY = "array<string>"


def pieces(text: Column, size: Column | int) -> Column:
    """A text cut every `size` characters."""
    n = F.lit(size) if isinstance(size, int) else size
    count = F.ceil(F.length(text) / n).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring(text, k * n + 1, n))).otherwise(F.array().cast(EMPTY))


def _state(chunks: Column, current: Column) -> Column:
    return F.struct(chunks.cast(EMPTY).alias("chunks"), current.alias("current"))


def split_text(text: Column, most: int = 1000) -> Column:
    """Paragraphs joined while their lengths (without separators) fit into `most`; longer ones are cut, the rest goes on."""
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\n+"), lambda x: F.trim(x)), lambda p: p != "")

    def step(s: Column, p: Column) -> Column:
        fits = F.length(s["current"]) + F.length(p) <= most
        both = F.when(s["current"] == "", p).otherwise(F.concat(s["current"], F.lit("\n\n"), p))
        done = F.when(s["current"] == "", s["chunks"]).otherwise(F.concat(s["chunks"], F.array(s["current"])))
        cut = pieces(p, most)
        return F.when(fits, _state(s["chunks"], both)).when(F.length(p) <= most, _state(done, p)).otherwise(_state(F.concat(done, F.slice(cut, F.lit(1), F.size(cut) - 1)), F.element_at(cut, -1)))

    end = lambda s: F.when(s["current"] == "", s["chunks"]).otherwise(F.concat(s["chunks"], F.array(s["current"])))
    return F.aggregate(paragraphs, _state(F.array(), F.lit("")), step, end)


def chunk_text(text: Column, most: int = 4000) -> Column:
    """Paragraphs of over 15 characters, long ones by line; joined up to `most`; what exceeds one and a half times that is cut."""
    blocks = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda x: F.trim(x)), lambda p: F.length(p) > 15)
    lines = F.flatten(F.transform(blocks, lambda b: F.when(F.length(b) > most, F.filter(F.transform(F.split(b, "\n"), lambda x: F.trim(x)), lambda x: x != "")).otherwise(F.array(b))))

    def step(s: Column, p: Column) -> Column:
        flush = (F.length(s["current"]) + F.length(p) > most) & (s["current"] != "")
        chunks = F.when(flush, F.concat(s["chunks"], F.array(F.trim(s["current"])))).otherwise(s["chunks"])
        joined = F.when(flush | (s["current"] == ""), p).otherwise(F.concat(s["current"], F.lit("\n\n"), p))
        # one part of `most` goes while more than one and a half times that is left
        over = F.greatest(F.lit(0), F.ceil((F.length(joined) - 1.5 * most) / most)).cast("int")
        cut = F.when(over > 0, F.transform(F.sequence(F.lit(0), over - 1), lambda k: F.trim(F.substring(joined, k * most + 1, F.lit(most))))).otherwise(F.array().cast(EMPTY))
        return _state(F.concat(chunks, cut), F.substring(joined, over * most + 1, F.length(joined)))

    end = lambda s: F.when(F.trim(s["current"]) == "", s["chunks"]).otherwise(F.concat(s["chunks"], F.array(F.trim(s["current"]))))
    return F.aggregate(lines, _state(F.array(), F.lit("")), step, end)


def semantic_chunks(text: Column, most: int = 3500, overlap: int = 200) -> Column:
    """Parts up to `most` tokens of four characters; the next one begins with the end of the last, `overlap` tokens long."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=\n\n)"), lambda p: p != "")
    parts = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > 4 * most, F.filter(F.split(p, r"(?<=\n)"), lambda x: x != "")).otherwise(F.array(p))))
    size = lambda c: F.ceil(F.length(c) / 4).cast("long")

    def state(chunks: Column, current: Column, n: Column) -> Column:
        return F.struct(chunks.cast(EMPTY).alias("chunks"), current.alias("current"), n.cast("long").alias("n"))

    def step(s: Column, p: Column) -> Column:
        flush = (s["n"] + size(p) > most) & (s["current"] != "")
        tail = F.concat(F.right(s["current"], F.lit(4 * overlap)), p)
        return F.when(flush, state(F.concat(s["chunks"], F.array(F.trim(s["current"]))), tail, size(tail))).otherwise(state(s["chunks"], F.concat(s["current"], p), s["n"] + size(p)))

    end = lambda s: F.when(F.trim(s["current"]) == "", s["chunks"]).otherwise(F.concat(s["chunks"], F.array(F.trim(s["current"]))))
    return F.aggregate(parts, state(F.array(), F.lit(""), F.lit(0)), step, end)


def store_chunks(text: Column, most: int = 720, limit: int = 496) -> Column:
    """split_text for a store with a token limit: parts over the limit (1.35 characters a token) are cut at 0.6 of `most`."""
    small = int(0.6 * most)
    parts = F.flatten(F.transform(split_text(text, most), lambda c: F.when(F.ceil(F.length(c) / 1.35) > limit, pieces(c, small)).otherwise(F.array(c))))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda c: c != "")


def truncated(text: Column, most: int = 720, limit: int = 512) -> Column:
    """Trimmed and cut to `most`, then to the share of it that keeps the limit, but not under 100."""
    t = F.substring(F.trim(text), 1, most)
    estimate = F.ceil(F.length(t) / 1.35)
    return F.when(estimate > limit, F.substring(t, F.lit(1), F.greatest(F.lit(100), F.floor(F.length(t) * limit / estimate)).cast("int"))).otherwise(t)


def windows(text: Column, cfg: Config = DEFAULT) -> Column:
    """Windows of fixed length and overlap; at most windows_most are used."""
    step = cfg.window_chars - cfg.window_overlap
    count = F.greatest(F.lit(1), F.ceil((F.length(text) - cfg.window_overlap) / step)).cast("int")
    found = F.transform(F.sequence(F.lit(0), F.least(count, F.lit(cfg.windows_most)) - 1), lambda k: F.substring(text, k * step + 1, F.lit(cfg.window_chars)))
    return F.filter(found, lambda w: w != "")


NOTHING_FOUND = "No relevant text was found."


def payloads(items: Column, limit: int, per: float = 4.0, base: int = 0) -> Column:
    """packed(), and one batch that says so where there is nothing to pack."""
    return F.when(F.size(F.coalesce(items, F.array().cast(EMPTY))) > 0, packed(items, limit, per, base)).otherwise(F.array(F.array(F.lit(NOTHING_FOUND))))


def packed(items: Column, limit: int, per: float = 4.0, base: int = 0) -> Column:
    """Array of strings into batches, in order: a batch is closed before the item that would exceed the limit of tokens."""
    size = lambda c: F.ceil(F.length(c) / F.lit(per)).cast("long")

    def state(done: Column, open_: Column, n: Column) -> Column:
        return F.struct(done.cast("array<array<string>>").alias("done"), open_.cast(EMPTY).alias("open"), n.cast("long").alias("n"))

    def step(s: Column, x: Column) -> Column:
        full = (s["n"] + size(x) > limit) & (F.size(s["open"]) > 0)
        return F.when(full, state(F.concat(s["done"], F.array(s["open"])), F.array(x), size(x) + base)).otherwise(state(s["done"], F.concat(s["open"], F.array(x)), s["n"] + size(x)))

    end = lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
    return F.aggregate(items, state(F.array(), F.array(), F.lit(base)), step, end)


def paragraphs(text: Column) -> Column:
    """Provisions: paragraphs of over 30 characters; without any, semantic chunks."""
    found = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\n+"), lambda x: F.trim(x)), lambda p: F.length(p) > 30)
    return F.when(F.size(found) > 0, found).otherwise(semantic_chunks(text))


def exploded(df: DataFrame, chunks: Column, *keys: str) -> DataFrame:
    """A row for each chunk, with its place."""
    return df.select(*keys, F.posexplode(chunks).alias("idx", "chunk"))
