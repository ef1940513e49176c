"""N-gram Jaccard join by a token-group matrix.

A document's set is that of its word shingles, as 63-bit hashes. Equal sets are one class. Similar classes are put into groups
and only a group whose token union can overlap a query enough is opened:

* Two sets of at least the wanted similarity share a token among the first few of either in any fixed order of tokens, and
  their sizes are close. A group is what shares one of these tokens and a size class; the key is one entry of the matrix of
  tokens and groups. Rare tokens come first in the order, so that groups are small.
* A group of two or more is opened: its sets are fetched and their overlaps counted at once, unless a bound on the overlap
  makes that needless.
* A group of more than `most` classes is dealt out into cells. A class's home is the largest group that it belongs to. Two
  rounds link what is alike in cells of one home; then each class that is not of a group's largest component (or not of the
  home that most of the group share, where these are compared) is a query against all cells of the group, which the union of a
  cell's tokens lets it skip.

Nothing is left out: cells and rounds decide where a pair is compared, not whether.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_groups, map_rows, perhaps_among, written
from .links import components


@dataclass(frozen=True)
class Params:
    words: int = 3
    percent: int = 90  # link when 100 * intersection >= percent * union
    most: int = 256  # classes that are compared in one task at once
    often: int = 16  # tokens of as many classes count as frequent
    frequent: int = 1 << 20  # frequent tokens that are told to all tasks at most (16 bytes each); beyond, `often` counts double
    rounds: int = 2
    cell: int = 512  # classes of a cell of a larger group
    few: int = 32  # a token of more sets of a group is a column of a matrix, others are counted pair by pair


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes: A-Z lower-cased, words between ASCII blanks; with fewer words, one for the whole sequence."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, "int64")
    n = max(1, len(found) - words + 1)
    each = np.fromiter(map(xxhash.xxh64_intdigest, found), "uint64", len(found))
    total = np.full(n, len(found) if len(found) < words else words, "uint64")
    for k in range(min(words, len(found))):
        total = total * np.uint64(0x9E3779B97F4A7C15) + each[k : k + n]
        total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    return np.unique((total >> np.uint64(1)).astype("int64"))


def prefix_size(n: int, percent: int) -> int:
    """So many first tokens that two linked sets share one of them."""
    return n - -(-percent * n // 100) + 1


def sets_of(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, n, key (equal for equal sets, null for none), low: the smallest tokens, enough to choose the first ones from."""
    limit = int(min(1.0, 1.5 * (1 - p.percent / 100)) * (1 << 63) - 1)

    def each(batch: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for text in batch["text"]:
            tokens = shingles(text, p.words)
            n = len(tokens)
            key = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if n else None
            rows.append((n, key, tokens[: max(prefix_size(n, p.percent), np.searchsorted(tokens, limit))] if n else tokens))
        out = pd.DataFrame(rows, columns=["n", "key", "low"])
        out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object))
        return out

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n long, key binary, low array<bigint>", lambda: each)


def frequent_tokens(classes: DataFrame, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that at least `often` classes have, or a higher number that leaves at most `frequent` of them, and how many have each."""
    limit = int(min(1.0, 1.5 * (1 - p.percent / 100)) * (1 << 63) - 1)
    counts = classes.select(F.explode("low").alias("token")).filter(F.col("token") < limit).groupBy("token").count().filter(F.col("count") >= p.often)
    counts = written(counts, "frequent")
    n, least = counts.count(), p.often
    while n > p.frequent:
        least *= 2
        n = counts.filter(F.col("count") >= least).count()
    found = np.array(sorted((r.token, r["count"]) for r in counts.filter(F.col("count") >= least).collect()), "int64").reshape(-1, 2)
    discard(counts)
    return np.ascontiguousarray(found[:, 0]), np.ascontiguousarray(found[:, 1])


def group_keys(classes: DataFrame, p: Params) -> DataFrame:
    """key, id: the groups of each class. The first tokens: rare ones by hash, frequent ones by their count, those beyond the limit."""
    limit = int(min(1.0, 1.5 * (1 - p.percent / 100)) * (1 << 63) - 1)
    frequent = classes.sparkSession.sparkContext.broadcast(frequent_tokens(classes, p))
    step = math.log(100 / p.percent) + 1e-9

    def each(batch: pd.DataFrame) -> pd.DataFrame:
        keys, (often, times) = [], frequent.value
        for n, low in zip(batch["n"], batch["low"], strict=True):
            frequent_ = inside(low, often)
            count = np.where(low < limit, 0, 1 << 60)
            count[frequent_] = times[np.searchsorted(often, low[frequent_])]
            first = low[np.argsort(count, kind="stable")][: prefix_size(n, p.percent)].astype("uint64")
            size = int(math.log(n) / step)
            larger = max(n, int(math.exp(step * (size + 1))) - 1)  # no set of the next size class is smaller
            other = n + 1 - -(-p.percent * (n + larger) // (100 + p.percent))
            both = [first[:k] * np.uint64(2) ^ np.uint64((c + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for c, k in ((size, len(first)), (size + 1, max(0, other)))]
            keys.append(np.concatenate(both).astype("int64"))
        return pd.DataFrame({"id": batch["id"], "keys": keys})

    return map_rows(classes, "id long, keys array<bigint>", lambda: each).select(F.explode("keys").alias("key"), "id")


def inside(some: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Which of some are in all_, which is sorted."""
    if not len(all_):
        return np.zeros(len(some), bool)
    at = np.searchsorted(all_, some)
    at[at == len(all_)] = 0
    return all_[at] == some


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    total = len(a) + len(b)
    least = -(-percent * total // (100 + percent))  # of the intersection
    if min(len(a), len(b)) < least:
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    return 100 * (i := int(inside(small, large).sum())) >= percent * (total - i)


def overlaps(sets: list[np.ndarray], few: int) -> np.ndarray:
    """How many tokens each two of the sets share (the diagonal is of no use)."""
    n = len(sets)
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, int)
    counts = np.diff(starts, append=len(tokens))
    each = np.repeat(counts, counts)
    some = (each > 1) & (each <= few)
    t, o = tokens[some], owner[some]
    pairs = np.zeros(n * n)
    for apart in range(1, few):
        same = t[apart:] == t[:-apart]
        if not same.any():
            break
        pairs += np.bincount(o[:-apart][same] * n + o[apart:][same], minlength=n * n)
    shared = pairs.reshape(n, n)
    shared = shared + shared.T
    o, column = owner[each > few], np.repeat(np.arange((counts > few).sum()), counts[counts > few])
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        here = (column >= at) & (column < at + 2048)
        matrix = np.zeros((n, 2048), "float32")
        matrix[o[here], column[here] - at] = 1
        shared += matrix @ matrix.T
    return shared


def smallest(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the first row that it reaches."""
    low = np.arange(len(near))
    while True:
        new = np.minimum(low, np.where(near, low[None, :], len(near)).min(1))
        new = new[new]
        if (new == low).all():
            return low
        low = new


def open_group(rows: dict[str, list], p: Params) -> list[tuple[int, int]]:
    """Links that join all that is linked in the group. Rows of role 1 are queries against the others, one row for each id and role."""
    asks = np.array(rows["role"], bool)
    sets = [np.asarray(t) for t in rows["tokens"]]
    stay = np.ones(len(sets), bool)
    if asks.any():
        union = np.unique(np.concatenate([np.zeros(0, "int64"), *(s for s, a in zip(sets, asks, strict=True) if not a)]))
        for i in np.flatnonzero(asks):  # whatever set of the cell it is held against, the overlap is too small
            stay[i] = 100 * int(inside(sets[i], union).sum()) >= p.percent * len(sets[i])
        if not stay[asks].any():
            return []
    ids, first = np.unique(np.array(rows["id"], "int64")[stay], return_index=True)
    sets = [s for s, k in zip(sets, stay, strict=True) if k]
    sets = [sets[k] for k in first]
    if len(sets) <= 8:
        return [(int(ids[i]), int(ids[j])) for i in range(len(sets)) for j in range(i) if linked(sets[i], sets[j], p.percent)]
    shared, n = overlaps(sets, p.few), np.array([len(s) for s in sets])
    near = 100 * shared >= p.percent * (n[:, None] + n[None, :] - shared)
    np.fill_diagonal(near, False)
    low = smallest(near)
    return [(int(ids[i]), int(ids[k])) for i, k in enumerate(low) if i != k]


def marks_of(low: np.ndarray, limit: int) -> bytes:
    """The tokens below the limit as 16-bit marks in ascending order, two bytes for a token's eight."""
    return (low[: np.searchsorted(low, limit)].astype("uint64") // np.uint64((limit >> 16) + 1)).astype("<u2").tobytes()


def told_apart(marks: bytes) -> np.ndarray:
    """Marks as distinct numbers, equal ones by how often they came before: what two sets share of them is no less than their common tokens."""
    found = np.frombuffer(marks, "<u2").astype("int64")
    return found << 32 | np.arange(len(found)) - np.searchsorted(found, found)


def may_link(a: tuple, b: tuple, percent: int) -> bool:
    """Whether two sets (size, what is known of them, complete below one limit) can be similar enough: a bound, never too low."""
    least = -(-percent * (a[0] + b[0]) // (100 + percent))
    same = int(inside(a[1], b[1]).sum())
    return min(a[0] - len(a[1]), b[0] - len(b[1])) + same >= least


def narrowed(members: DataFrame, classes: DataFrame, p: Params) -> DataFrame:
    """members: group, id. group, id of what is left of each group where the smallest tokens alone rule pairs out.

    Each group that a class belongs to gets its tokens, so these travel as marks.
    """
    limit = int(min(1.0, 1.5 * (1 - p.percent / 100)) * (1 << 63) - 1)

    def marked(batch: pd.DataFrame) -> pd.DataFrame:
        return batch[["id", "n"]].assign(marks=[marks_of(low, limit) for low in batch["low"]])

    def each(rows: dict[str, list]) -> list[tuple]:
        order = sorted(range(len(rows["id"])), key=lambda k: (rows["n"][k], rows["id"][k]))
        ids, top = [int(rows["id"][k]) for k in order], list(range(len(order)))

        def first(i: int) -> int:
            while top[i] != i:
                top[i] = i = top[top[i]]
            return i

        own = [told_apart(rows["marks"][k]) for k in order]
        if len(ids) <= 8:
            sets = [(rows["n"][k], known) for k, known in zip(order, own, strict=True)]
            for i in range(len(sets)):
                for j in range(i - 1, -1, -1):
                    if 100 * sets[j][0] < p.percent * sets[i][0]:
                        break
                    if first(i) != first(j) and may_link(sets[i], sets[j], p.percent):
                        top[first(i)] = first(j)
        else:  # the same bound for all pairs at once
            n, known = np.array([rows["n"][k] for k in order]), np.array([len(x) for x in own])
            total = n[:, None] + n[None, :]
            most = np.minimum(n[:, None] - known[:, None], n[None, :] - known[None, :]) + overlaps(own, p.few)
            near = (100 + p.percent) * most >= p.percent * total
            np.fill_diagonal(near, False)
            top = smallest(near).tolist()
        parts = defaultdict(list)
        for i in range(len(ids)):
            parts[first(i)].append(ids[i])
        out = []
        for part in parts.values():
            if len(part) > 1:
                name = xxhash.xxh64_intdigest(np.array(sorted(part), "int64").tobytes()) - (1 << 63)
                out += [(name, i) for i in part]
        return out

    marks = map_rows(classes.select("id", "n", "low"), "id long, n long, marks binary", lambda: marked)
    return map_groups(members.join(marks, "id"), "group", "group long, id long", each).distinct()


def opened(members: DataFrame, p: Params) -> DataFrame:
    """members: group, id, role, tokens. Pairs that join what is linked in each group."""
    return map_groups(members.select("group", "id", "role", "tokens"), "group", "a long, b long", lambda rows: open_group(rows, p))


def with_tokens(docs: DataFrame, rows: DataFrame, p: Params) -> DataFrame:
    """rows: id and other columns, one row for each id. Adds tokens, from the texts."""

    def each(batch: pd.DataFrame) -> pd.DataFrame:
        return batch.drop(columns="text").assign(tokens=[shingles(t, p.words) for t in batch["text"]])

    texts, _ = perhaps_among(docs.select(F.col("doc_id").alias("id"), "text"), "id", rows.select("id"))
    texts = texts.join(rows, "id")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "id")
    return map_rows(texts.select("id", "text", *[c for c in rows.columns if c != "id"]), f"id long, {kinds}, tokens array<bigint>", lambda: each)


def joined_groups(groups: DataFrame, p: Params) -> DataFrame:
    """group, id: groups that share members are one, so that a set is fetched once; only where that has over `most` members, they stay."""
    low = groups.groupBy("group").agg(F.min("id").alias("b"))
    whole = components(groups.join(low, "group").select(F.col("id").alias("a"), "b"))
    small = whole.groupBy("component").count().filter(F.col("count") <= p.most).select("component")
    one = whole.join(small, "component").select(F.xxhash64("component").alias("group"), "id")
    rest = groups.join(one.select("id"), "id", "left_anti").select("group", "id")
    return written(one.unionByName(rest), "groups")


def class_components(docs: DataFrame, classes: DataFrame, p: Params) -> DataFrame:
    """id, component of the classes that are linked with others. classes: id, n, low, in a table."""
    keys = written(group_keys(classes, p), "keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("low"), F.max("id").alias("high")).filter("size > 1")
    sizes = written(sizes, "sizes")
    two = sizes.filter("size = 2").select(F.array("low", "high").alias("ids"))
    several = sizes.filter("size > 2").select("key", "size")
    several = written(keys.join(several, "key").select("key", "size", "id"), "several")
    more = several.filter(f"size <= {p.most}").groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("ids")
    groups = written(two.unionByName(more).distinct().select(F.xxhash64("ids").alias("group"), F.explode("ids").alias("id")), "groups")
    hot = written(several.filter(f"size > {p.most}"), "hot")
    for old in (keys, sizes, several):
        discard(old)
    left = written(narrowed(groups, classes, p), "groups")
    discard(groups)
    left = joined_groups(left, p)
    wanted = left.groupBy("id").agg(F.collect_list("group").alias("groups"))
    members = with_tokens(docs, wanted, p).select(F.explode("groups").alias("group"), "id", F.lit(0).alias("role"), "tokens")
    links = written(opened(members, p), "found")
    discard(left)

    def joined() -> DataFrame:
        out = components(links)  # a table of its own
        discard(links)
        return out

    def with_more(groups: DataFrame) -> DataFrame:
        new = written(links.unionByName(opened(groups.join(sets, "id"), p)), "found")
        discard(links)
        return new

    if not hot.limit(1).count():
        discard(hot)
        return joined()
    sets = written(with_tokens(docs, hot.select("id", F.lit(1).alias("one")).distinct(), p).select("id", "tokens"), "sets")
    homes = written(hot.groupBy("id").agg(F.max(F.struct("size", "key")).alias("x")).select("id", F.col("x.key").alias("home"), "x.size"), "homes")
    cells = lambda n: F.ceil(n / p.cell).cast("int")
    for turn in range(p.rounds):
        cell = F.pmod(F.xxhash64("id", F.lit(turn)), cells(F.col("size")))
        members = homes.select(F.xxhash64("home", cell).alias("group"), "id", F.lit(0).alias("role"))
        links = with_more(members)
    marked = hot.join(homes.select("id", "home"), "id").join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    marked = written(marked, "marked")
    # of a group those go without a query that are joined already, or those whose home is another group, the same for all of them
    alike = marked.groupBy("key", F.lit(0).alias("kind"), F.col("component").alias("label")).count()
    alike = alike.unionByName(marked.filter("home <> key").groupBy("key", F.lit(1).alias("kind"), F.col("home").alias("label")).count())
    largest = alike.groupBy("key").agg(F.max(F.struct("count", "kind", "label")).alias("x")).select("key", "x.*")
    rest = marked.join(largest, "key").filter(F.col("size") > F.col("count"))
    rest = rest.select("key", "id", (F.when(F.col("kind") == 0, F.col("component")).otherwise(F.col("home")) != F.col("label")).alias("asks"), cells(F.col("size") - F.col("count")).alias("blocks"), cells(F.col("size")).alias("parts"))
    rest = written(rest, "rest")
    counted = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stay = rest.select("key", "id", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), counted("blocks").alias("block"), F.lit(0).alias("role"))
    ask = rest.filter("asks").select("key", "id", counted("parts").alias("part"), F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.lit(1).alias("role"))
    queries = stay.unionByName(ask).select(F.xxhash64("key", "part", "block").alias("group"), "id", "role")
    links = with_more(queries)
    for old in (hot, sets, homes, marked, rest):
        discard(old)
    return joined()


def jaccard_components(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    Null and empty texts and texts without words have no shingles and link with nothing. Rows that repeat a doc_id are rows of
    their own with the same result; if such rows differ in text, either text's links count for the id. Rows with a null
    doc_id are kept with a null component and link with nothing. Other columns of docs are not read.
    """
    first = written(sets_of(docs, p), "sets")
    all_sets = written(first.select("doc_id", "n", "key"), "sets")
    classes = first.filter("key is not null and doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "n", "low")).alias("first"))
    classes = written(classes.select("key", F.col("first.doc_id").alias("id"), "first.n", "first.low"), "classes")
    discard(first)
    found = class_components(docs.filter("doc_id is not null"), classes.select("id", "n", "low"), p)
    by_key = classes.select("key", "id").join(found, "id", "left").select("key", F.coalesce("component", "id").alias("component_id"))
    rows = all_sets.select("doc_id", F.col("n").alias("n_shingles"), "key").join(by_key, "key", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, p: Params = Params(words=5, percent=80)) -> DataFrame:
    """docs with one row of each group of near copies, that of the smallest doc_id; all columns stay. Repeated rows are one.

    Rows of one doc_id with different texts are different rows: they stay or go together, as links name the doc_id. Rows with a
    null doc_id link with nothing and all stay, as do single rows of null, empty or wordless texts. Of rows that repeat doc_id and
    text one stays; where their other columns differ, any of them.
    """
    own = F.col("doc_id") == F.col("component_id")
    ids = jaccard_components(docs, p).filter("doc_id is not null").groupBy("doc_id").agg(F.max(own).alias("stays"), F.count("*").alias("n"))
    some = written(ids.filter("not stays or n > 1"), "some")  # ids that go or come again; all other rows stay where they are
    seen, others = perhaps_among(docs, "doc_id", some)
    seen = seen.join(some.filter("not stays").select("doc_id"), "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return others.unionByName(seen)
