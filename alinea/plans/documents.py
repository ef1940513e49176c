"""Texts, chunks, document maps, candidates, matching, rules, streams and rewrites over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alinea.config import DEFAULT
from alinea.functions import dates
from alinea.functions import diff as D
from alinea.functions import headings as H
from alinea.functions import json as J
from alinea.functions import plugs
from alinea.functions import text as X
from alinea.functions import vectors as V
from alinea.operators import candidates, chunk, classify, docmap, layout, nearest, patterns, relations, rules, similarity
from alinea.plans.base import Tables, query
from alinea.streaming import jobs

# Provision-to-library alignment: sentences of documents against sentences of the library.

SENTENCES = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s, ' ')), lambda s: s <> '')"
KEY = r"trim(regexp_replace(regexp_replace(lower(s), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"
ALIGN = f"""p0 as (select doc_id, unnest({SENTENCES}) as s, unnest(range(0, len({SENTENCES}))) as idx from documents),
 p as (select doc_id * 100000 + idx as p, doc_id, {KEY} as k from p0 where length(s) > 30),
 l0 as (select item_id, unnest({SENTENCES}) as s, unnest(range(0, len({SENTENCES}))) as idx from benchmark),
 l as (select item_id * 1000 + idx as l, {KEY} as k from l0 where length(s) > 30),
 exact as (select distinct p, l, 1.0::double as sim from p join l using (k) where k <> ''),
 pt as (select p, t, count(*) as n from (select p, unnest(string_split(k, ' ')) as t from p where length(k) >= 8 and p not in (select p from exact)) where t <> '' group by all),
 lt as (select l, t, count(*) as n from (select l, unnest(string_split(k, ' ')) as t from l) where t <> '' group by all),
 pn as (select p, sqrt(sum(n * n)::double) as norm from pt group by p), ln as (select l, sqrt(sum(n * n)::double) as norm from lt group by l),
 near as (select p, l, sum(pt.n * lt.n)::double / (any_value(pn.norm) * any_value(ln.norm)) as sim from pt join lt using (t) join pn using (p) join ln using (l) group by p, l having sim > 1 - 0.6),
 ranked as (select *, row_number() over (partition by p order by round(sim, 9) desc, l) as rank from (select * from exact union all select * from near)),
 best as (select p, max(case when rank = 1 then sim end) as sim, max(case when rank = 2 then sim end) as second from ranked where rank <= 2 group by p),
 status as (select p.doc_id, p.p, sim, case when sim >= 0.98 then 'Matched' when sim >= 0.65 and not (sim < 0.98 and coalesce(second, 0) > 0 and sim - coalesce(second, 0) < 0.02) then 'Variation' else 'Custom' end as status from p left join best using (p))"""


def provisions(df: DataFrame, key: str, scale: int, name: str) -> DataFrame:
    rows = df.select(key, F.posexplode(X.sentences(F.col("text"))).alias("idx", "text")).filter(F.length("text") > 30)
    return rows.select(key, (F.col(key) * scale + F.col("idx")).alias(name), "text")


def aligned(t: Tables) -> DataFrame:
    """doc_id, p, similarity, status of each provision."""
    p, library = provisions(t.documents, "doc_id", 100_000, "p"), provisions(t.benchmark, "item_id", 1000, "l")
    hits = similarity.matched_texts(p, library, "p", "l", 2)
    best = hits.groupBy("p").agg(F.max(F.when(F.col("rank") == 1, F.col("similarity"))).alias("similarity"), F.max(F.when(F.col("rank") == 2, F.col("similarity"))).alias("second"))
    rows = p.select("doc_id", "p").join(best, "p", "left")
    return rows.select("doc_id", "p", "similarity", classify.match_status(F.coalesce("similarity", F.lit(0.0)), F.col("second")).alias("status"))


@query("cls_status3", f"with {ALIGN} select doc_id, status, count(*) as n from status group by all")
def flagship(t):
    return aligned(t).groupBy("doc_id", "status").agg(F.count("*").alias("n"))


@query("cls_legacy", f"with {ALIGN}, m as (select p, l, sim from ranked where rank = 1 and sim >= 0.65) select l, p from m qualify row_number() over (partition by l order by round(sim, 9) desc, p) = 1")
def _(t):
    p, library = provisions(t.documents, "doc_id", 100_000, "p"), provisions(t.benchmark, "item_id", 1000, "l")
    hits = similarity.matched_texts(p, library, "p", "l", 1).filter(F.col("similarity") >= DEFAULT.semantic_floor)
    return relations.first_by(hits, ["l"], F.desc(F.round("similarity", 9)), F.col("p")).select("l", "p")


@query("sim_exact", f"with {ALIGN} select p, l from exact")
def _(t):
    p, library = provisions(t.documents, "doc_id", 100_000, "p"), provisions(t.benchmark, "item_id", 1000, "l")
    return similarity.exact_matches(p, library, "p", "l").select("p", "l")


@query("sim_topk", f"with {ALIGN} select p, l, rank, round(sim, 6) as similarity from ranked where rank <= 2")
def _(t):
    p, library = provisions(t.documents, "doc_id", 100_000, "p"), provisions(t.benchmark, "item_id", 1000, "l")
    return similarity.matched_texts(p, library, "p", "l", 2).select("p", "l", "rank", F.round("similarity", 6).alias("similarity"))


# Dense vectors: every vector is a query and an item of the library.

PAIRS = "select a.vec_id as q, b.vec_id as item, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s, a.label = b.label as same from embeddings a, embeddings b where a.vec_id <> b.vec_id"


def dense(t: Tables, k: int, least: float, kind: str = "any", of_items: str = "true", **more) -> DataFrame:
    queries = t.embeddings.select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"), "label")
    library = t.embeddings.select(F.col("vec_id").alias("item"), F.col("embedding").alias("w"), "label").filter(of_items)
    return nearest.vector_top_k(queries, library, k, least, kind, **more)


@query("jn_vector_topk", f"select q, item, round(s, 6) as similarity from ({PAIRS}) where s > 0.4 qualify row_number() over (partition by q order by round(s, 9) desc, item) <= 5")
def _(t):
    return dense(t, 5, 0.4).select("q", "item", F.round("similarity", 6).alias("similarity"))


@query("win_topk_per_query", f"select q, item, rank from (select *, row_number() over (partition by q order by round(s, 9) desc, item) as rank from ({PAIRS}) where s > -2) where rank <= 3")
def _(t):
    return dense(t, 3, -2.0).select("q", "item", "rank")


@query("sim_cosine", "select vec_id, round(list_cosine_similarity(embedding::double[], list_reverse(embedding)::double[]), 6) as similarity from embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.round(V.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("similarity"))


@query("sim_store", f"select q, item from (select *, row_number() over (partition by q order by round(s, 9) desc, item) as rank from ({PAIRS})) where rank <= 5 and 1 - s < 0.5")
def _(t):
    return dense(t, 5, -2.0).filter(1 - F.col("similarity") < 0.5).select("q", "item")


@query("sim_war", f"select q, item from (select *, row_number() over (partition by q order by round(s, 9) desc, item) as rank from ({PAIRS}) where s > 0.4 and same) where rank <= 2")
def _(t):
    return dense(t, 2, 0.4, "same").select("q", "item")


@query("sim_gen", f"select q, item from (select *, row_number() over (partition by q order by round(s, 9) desc, item) as rank from ({PAIRS}) where item % 2 = 0) where rank <= 5")
def _(t):
    return dense(t, 5, -2.0, of_items="item % 2 = 0").select("q", "item")  # the kind that is searched for


@query("sim_match", f"""select q, item, round(s2, 3) as confidence, s2 >= 0.75 as recommended from (select *, row_number() over (partition by q order by round(s2, 9) desc, item) as rank
 from (select q, item, case when same then least(1.0::double, s * 1.1) else s end as s2 from ({PAIRS}) where s > 0.3) where s2 >= 0.5) where rank <= 5""")
def _(t):
    best = dense(t, 5, 0.3, "boosted", from_boosted=0.5)
    return best.select("q", "item", F.round("similarity", 3).alias("confidence"), (F.col("similarity") >= 0.75).alias("recommended"))


@query("sim_rag", f"""with h as ({PAIRS}), n as (select q % 1000 as g, q, item, s from h where 1 - s < 0.5 qualify row_number() over (partition by q order by round(s, 9) desc, item) <= 5),
 o as (select g, item, max(s) as s from n group by all) select g, item, row_number() over (partition by g order by round(s, 9) desc, item) as rank from o qualify rank <= 10""")
def _(t):
    hits = dense(t, 5, 0.0).withColumn("g", F.col("q") % 1000)
    return similarity.retrieved(hits.drop("rank"), "g", "q", "item").select("g", "item", "rank")


@query("sim_batch", f"select q, coalesce(max(s), 0) >= 0.98 as hit, count(s) filter (where s >= 0.9) as n from ({PAIRS}) group by q")
def _(t):
    """What every query of a batch hits from 0.9 on, counted; a query without a hit stays."""
    asked = t.embeddings.select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    hits = nearest.vector_counts(asked, t.embeddings.select(F.col("vec_id").alias("item"), F.col("embedding").alias("w")), 0.9)
    queries = t.embeddings.select(F.col("vec_id").alias("q"))
    return queries.join(hits, "q", "left").select("q", (F.coalesce("best", F.lit(0.0)) >= 0.98).alias("hit"), F.coalesce("n", F.lit(0)).alias("n"))


# Chunks: the counts and sums that SQL can state

LINES = "replace(text, chr(10), chr(10) || chr(10))"


def doubled(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


@query("chk_split")
def _(t):
    return chunk.exploded(doubled(t), chunk.split_text(F.col("text"), 1000), "doc_id")


@query("chk_text")
def _(t):
    return chunk.exploded(doubled(t), chunk.chunk_text(F.col("text"), 4000), "doc_id")


@query("chk_semantic")
def _(t):
    return chunk.exploded(doubled(t), chunk.semantic_chunks(F.col("text")), "doc_id")


@query("chk_vectorize")
def _(t):
    return chunk.exploded(doubled(t), chunk.store_chunks(F.col("text")), "doc_id")


@query("chk_truncate", """with t as (select doc_id, trim(text, ' ')[:720] as t from documents) select doc_id, case when ceil(length(t) / 1.35::double) > 512 then t[:greatest(100, floor(length(t) * 512 / ceil(length(t) / 1.35::double)))::int] else t end as cut from t""")
def _(t):
    return t.documents.select("doc_id", chunk.truncated(F.col("text")).alias("cut"))


@query("chk_window", "select doc_id, k as idx, text[k * 2250 + 1 : k * 2250 + 2500] as chunk from (select doc_id, text, unnest(range(0, least(8, greatest(1, ceil((length(text) - 250) / 2250.0)))::bigint)) as k from documents)")
def _(t):
    return chunk.exploded(t.documents, chunk.windows(F.col("text")), "doc_id").withColumn("idx", F.col("idx").cast("long"))


PIECED = "select doc_id, unnest(range(0, greatest(1, ceil(length(text) / 1000.0)::bigint))) as k, text from documents where text is not null"


@query("chk_token_pack", f"select doc_id, k // 2 as batch, count(*) as n, md5(string_agg(text[k * 1000 + 1 : k * 1000 + 1000], '|' order by k)) as items from ({PIECED}) where text <> '' group by all")
def _(t):
    """Pieces of a thousand characters, in batches of 500 tokens."""
    rows = t.documents.filter("text is not null").select("doc_id", F.posexplode(chunk.packed(chunk.pieces(F.col("text"), 1000), 500)).alias("batch", "items"))
    return rows.select("doc_id", F.col("batch").cast("long").alias("batch"), F.size("items").cast("long").alias("n"), F.md5(F.array_join("items", "|")).alias("items"))


@query("chk_prompt_pack", f"select doc_id, k // 4 as payload, case when text = '' then 0 else count(*) end as n, md5(case when text = '' then '{chunk.NOTHING_FOUND}' else string_agg(text[k * 1000 + 1 : k * 1000 + 1000], '|' order by k) end) as items from ({PIECED}) group by doc_id, k // 4, text")
def _(t):
    """The same pieces in payloads of 20,000 tokens, of which the prompt takes 19,000; a text without any is told so."""
    rows = t.documents.filter("text is not null").select("doc_id", F.posexplode(chunk.payloads(chunk.pieces(F.col("text"), 1000), DEFAULT.payload_tokens, base=19_000)).alias("payload", "items"))
    n = F.when(F.get("items", F.lit(0)) == chunk.NOTHING_FOUND, 0).otherwise(F.size("items"))
    return rows.select("doc_id", F.col("payload").cast("long").alias("payload"), n.cast("long").alias("n"), F.md5(F.array_join("items", "|")).alias("items"))


@query("chk_para", f"select doc_id, count(*) as n from (select doc_id, unnest(regexp_split_to_array({LINES}, '\\n\\n+')) as p from documents) where length(trim(p, ' ')) > 30 group by doc_id")
def _(t):
    found = F.filter(F.transform(F.split(F.col("text"), r"\n\n+"), lambda x: F.trim(x)), lambda p: F.length(p) > 30)
    return doubled(t).select("doc_id", F.explode(F.when(F.size(found) > 0, chunk.paragraphs(F.col("text"))).otherwise(F.array().cast("array<string>"))).alias("p")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("chk_fixed_batch", "select doc_id, doc_id // 5 as batch from documents")
def _(t):
    return t.documents.select("doc_id", F.expr("doc_id div 5").alias("batch"))


# Keys and scalar functions


@query("cnd_key", r"select doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) as k from documents")
def _(t):
    return t.documents.select("doc_id", X.heading_key(F.col("text")).alias("k"))


@query("cnd_namekey", r"select p_partkey, trim(regexp_replace(trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), '(^| )clauses?$', '')) as k from part")
def _(t):
    return t.part.select("p_partkey", X.name_key(F.concat("p_name", F.lit(" (as attached) Clause"))).alias("k"))


@query("cnd_codekey", "select p_partkey, regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') as k from part")
def _(t):
    return t.part.select("p_partkey", X.code_key(F.concat("p_brand", F.lit(" (old)"))).alias("k"))


@query("cnd_bodykey", "select p_partkey, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') as k from part")
def _(t):
    return t.part.select("p_partkey", X.body_key(F.concat("p_name", F.lit(" Agreement"))).alias("k"))


@query("fn_library_key", f"select item_id, {KEY.replace('lower(s)', 'lower(text)')} as k from benchmark")
def _(t):
    return t.benchmark.select("item_id", X.library_key(F.col("text")).alias("k"))


@query("fn_tokens", "select doc_id, ceil(length(text) / 4.0)::bigint as by_four, ceil(length(text) / 1.35::double)::bigint as by_store from documents")
def _(t):
    return t.documents.select("doc_id", X.tokens(F.col("text")).alias("by_four"), X.tokens(F.col("text"), 1.35).alias("by_store"))


@query("fn_hash", "select doc_id, sha256(text) as h from documents")
def _(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("h"))


@query("fn_cache_key", "select p_partkey, array_to_string(list_sort(list_transform(string_split(p_name, ' '), lambda w: lower(trim(w)))), '|') as k from part")
def _(t):
    return t.part.select("p_partkey", F.array_join(F.array_sort(F.transform(F.split("p_name", " "), lambda w: F.lower(F.trim(w)))), "|").alias("k"))


@query("fn_json_merge", "select event_id, (json_extract_string(props, '$.k')) as k, event_type as kind, 'x' as note from events")
def _(t):
    both = J.merged(F.col("props"), F.to_json(F.struct(F.col("event_type").alias("kind"), F.lit("x").alias("note"), F.lit(1).alias("gone"))))
    out = J.without(both, "gone")
    return t.events.select("event_id", *[J.field(out, k).alias(k) for k in ("k", "kind", "note")])


@query("fn_vector_fit", "select vec_id, len(embedding) as n, round(list_sum(embedding::double[]), 4) as total from embeddings")
def _(t):
    v = V.fitted(F.col("embedding"), 1024)
    return t.embeddings.select("vec_id", F.size(F.slice(v, 1, F.size("embedding"))).cast("long").alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("fn_dates", "select o_orderkey, case when o_orderkey % 5 <> 0 then strftime(o_orderdate, '%-d %b %Y') end as shown, case when o_orderkey % 5 <> 0 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') end as exchanged from orders")
def _(t):
    """Dates as texts, a fifth of them no dates: words, a day that no month has, nothing."""
    wrong = F.element_at(F.array(F.lit("soon"), F.lit("1998-02-30"), F.lit(" ")), (F.col("o_orderkey") / 5).cast("int") % 3 + 1)
    text = F.when(F.col("o_orderkey") % 5 == 0, wrong).otherwise(F.date_format("o_orderdate", " yyyy-MM-dd HH:mm:ss"))
    ts = dates.parsed(text)
    return t.orders.select("o_orderkey", dates.shown(ts).alias("shown"), dates.exchanged(ts).alias("exchanged"))


@query("fn_text_diff", "select conv_id, turn, md5(before) as before, md5(text) as after, before = text as same from (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn, text) as before from conversations) where before is not null and text is not null")
def _(t):
    """Edits between neighbouring turns: without the inserted text they are the turn before, without the deleted text the turn."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    rows = relations.dealt_out(t.conversations, "conv_id").select("conv_id", "turn", "text", F.lag("text").over(w).alias("before")).filter("before is not null and text is not null")
    ops = rows.select("conv_id", "turn", D.text_edits(F.col("before"), F.col("text")).alias("ops"))
    side = lambda other: F.md5(F.array_join(F.transform(F.filter("ops", lambda o: o["op"] != other), lambda o: o["text"]), ""))
    return ops.select("conv_id", "turn", side("insert").alias("before"), side("delete").alias("after"), F.forall("ops", lambda o: o["op"] == "equal").alias("same"))


PIECES = "select doc_id, unnest(range(0, ceil(length(x) / 1000.0)::bigint))::int as idx, x from (select doc_id, trim(text, ' ') as x from documents where not regexp_matches(text, '\\n\\n') and trim(text, ' ') <> '')"


@query("fn_chunks_sql", f"select doc_id, idx, md5(x[idx * 1000 + 1 : idx * 1000 + 1000]) as chunk from ({PIECES}) union all select doc_id, null, 'paragraphs' from documents where regexp_matches(text, '\\n\\n')")
def _(t):
    """The table function chunks in SQL, over all documents; those that have paragraphs (none in the given tables) are only named."""
    plugs.register(t.spark)
    t.documents.createOrReplaceTempView("alinea_documents")
    rows = t.spark.sql(r"SELECT d.doc_id, c.idx, md5(c.chunk) AS chunk FROM alinea_documents d, LATERAL chunks(d.text, 1000) c WHERE NOT d.text LIKE concat('%', chr(10), chr(10), '%')")
    return rows.unionByName(t.documents.filter(F.col("text").contains("\n\n")).select("doc_id", F.lit(None).cast("int").alias("idx"), F.lit("paragraphs").alias("chunk")))


# Document maps and candidates. Drafts and layouts are made of the sentences of all documents, with headings, noise and labels between them.

SAID = rf"said as (select doc_id, i, 'in words: ' || regexp_replace(x, '\s+', ' ', 'g') as p, n from (select doc_id, unnest({SENTENCES}) as x, unnest(range(0, len({SENTENCES}))) as i, len({SENTENCES}) as n from documents))"
DRAFT = f"""{SAID}, parts as (select doc_id, i // 2 + 1 as section, i // 6 + 1 as k, i // 2 % 3 as level, string_agg(p, chr(10) || chr(10) order by i) as body, count(*) as n_paragraphs from said group by all),
 draft as (select doc_id, section, level + 1 as depth, case level when 0 then k || ' Scope' when 1 then k || '.1 Terms' else k || '.1.1 Details' end as heading, k || repeat('.1', level::int) as number, n_paragraphs, body from parts)"""


def said(t: Tables) -> DataFrame:
    """doc_id, s: the sentences of each document as paragraphs."""
    return relations.dealt_out(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", F.transform(X.sentences(F.col("text")), lambda x: F.concat(F.lit("in words: "), X.squeeze(x))).alias("s"))


def drafts(t: Tables) -> DataFrame:
    """doc_id, text: two paragraphs below each heading, headings of three levels in turn."""

    def part(x, i):
        k, level = (F.floor(i / 6) + 1).cast("string"), F.floor(i / 2) % 3
        heading = F.when(level == 0, F.concat(k, F.lit(" Scope"))).when(level == 1, F.concat(k, F.lit(".1 Terms"))).otherwise(F.concat(k, F.lit(".1.1 Details")))
        return F.when(i % 2 == 0, F.concat_ws("\n\n", heading, x)).otherwise(x)

    return said(t).select("doc_id", F.array_join(F.transform("s", part), "\n\n").alias("text"))


def sections_of(t: Tables) -> DataFrame:
    return docmap.heuristic_sections(drafts(t), "doc_id", "text")


@query("map_heuristic", f"with {DRAFT} select doc_id, section, heading, number, n_paragraphs, body from draft")
def _(t):
    return sections_of(t)


@query("map_noise", f"with {SAID} select doc_id, i as pos, i % 5 <> 1 as noise from said")
def _(t):
    """A page number, a sentence, a rule, a count of pages and a mark, in turn."""
    text = lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("Page "), i.cast("string"))).when(i % 5 == 1, x).when(i % 5 == 2, "-----").when(i % 5 == 3, F.concat(i.cast("string"), F.lit(" of "), (i + 9).cast("string"))).otherwise("Confidential")
    lines = said(t).select("doc_id", F.posexplode(F.transform("s", text)).alias("pos", "line"))
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), H.is_noise_line(F.col("line")).alias("noise"))


@query("map_layout", f"""with {SAID} select doc_id, 'Document Map' as title, i // 3 + 1 as section, 'ARTICLE ' || (i // 3 + 1) as heading, (i // 3 + 1)::varchar as number, count(*) as n_paragraphs, max(i % 3) >= 1 as labelled from said group by all
 union all select doc_id, 'Document Content', 0, 'Main Text', null, 1, false from documents where len({SENTENCES}) = 0""")
def _(t):
    """Layouts in JSON, with an article for three sentences, a page mark and a lone label before the second of them, twenty paragraphs a page."""
    number = lambda i: (F.floor(i / 3) + 1).cast("string")
    part = lambda x, i: F.when(i % 3 == 0, F.array(F.concat(F.lit("ARTICLE "), number(i)), x)).when(i % 3 == 1, F.array(F.concat(F.lit("Page "), number(i), F.lit(" of 900")), F.lit("(a)"), x)).otherwise(F.array(x))
    rows = said(t).select("doc_id", F.flatten(F.transform("s", part)).alias("parts"))
    # where parts end: sums of 64 at a time, as an array that grows is copied for each
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.size("parts") - 1, F.lit(0)), F.lit(64)), lambda a: F.transform(F.slice("parts", a + 1, 64), lambda p: F.length(p) + 1))
    sums = lambda sizes, first: F.aggregate(sizes, F.array(first), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
    rows = rows.select("doc_id", "parts", groups.alias("groups"))
    rows = rows.select("doc_id", "parts", "groups", sums(F.transform("groups", lambda g: F.aggregate(g, F.lit(0), lambda s, n: s + n)), F.lit(-1)).alias("firsts"))
    ends = F.flatten(F.transform("groups", lambda g, i: F.slice(sums(g, F.get("firsts", i)), F.lit(2), F.size(g))))
    rows = rows.select("doc_id", "parts", F.concat(F.array(F.lit(-1)), ends).alias("ends"))
    segment = lambda p, i: F.struct(F.struct(F.struct(F.array(F.struct(F.nullif(F.get("ends", i) + 1, F.lit(0)).cast("string").alias("startIndex"), F.get("ends", i + 1).cast("string").alias("endIndex"))).alias("textSegments")).alias("textAnchor")).alias("layout"))
    rows = rows.select("doc_id", "parts", F.transform("parts", segment).alias("found"))
    pages = F.transform(F.sequence(F.lit(0), F.greatest(F.size("found") - 1, F.lit(0)), F.lit(20)), lambda a: F.struct(F.slice("found", a + 1, 20).alias("paragraphs")))
    layouts = rows.select("doc_id", F.to_json(F.struct(F.array_join("parts", "\n").alias("text"), pages.alias("pages"))).alias("layout"))
    sections = layout.layout_map(layouts, "doc_id", "layout")
    return sections.select("doc_id", "title", "section", "heading", "number", F.size("paragraphs").cast("long").alias("n_paragraphs"), F.exists("paragraphs", lambda p: p.startswith("(a) ")).alias("labelled"))


@query("map_clean")
def _(t):
    return t.documents.select("doc_id", X.cleaned(F.col("text")).alias("text"))


@query("map_quality", "select doc_id, bool_or(source <> 'src1') as quality from documents group by doc_id")
def _(t):
    rows = t.documents.select("doc_id", F.when(F.col("source") == "src1", " Raw Text ").otherwise(F.col("source")).alias("heading"))
    return docmap.has_quality(rows, "doc_id")


@query("map_sanitize", "select lang, doc_id from documents where source <> 'src1'")
def _(t):
    rows = t.documents.select("lang", "doc_id", F.when(F.col("source") == "src1", "Raw Text").otherwise(F.col("source")).alias("heading"))
    return docmap.sanitized(rows, "lang").select("lang", "doc_id")


@query("map_merge", "select lang, lower(source) as heading, min(doc_id) as place, count(distinct n_chars) as paragraphs from documents group by all")
def _(t):
    rows = t.documents.select("lang", "doc_id", F.col("source").alias("heading"), F.lit(None).cast("string").alias("number"), F.array(F.col("n_chars").cast("string")).alias("paragraphs"))
    return docmap.merged_maps(rows, "lang", "doc_id").select("lang", F.lower("heading").alias("heading"), F.col("doc_id").alias("place"), F.size("paragraphs").cast("long").alias("paragraphs"))


@query("map_choose", "select doc_id, case when source = 'src1' then 'rules' else 'model' end as origin from documents")
def _(t):
    ai = t.documents.select("doc_id", F.when(F.col("source") == "src1", "").otherwise(F.col("source")).alias("heading"), F.lit("model").alias("origin"))
    return docmap.chosen_map(ai, t.documents.select("doc_id", F.lit("h").alias("heading"), F.lit("rules").alias("origin")), "doc_id").select("doc_id", "origin")


WHOLE_ITEMS = "select doc_id, item_id, strpos(d.text, b.text) as at from documents d join benchmark b on contains(d.text, b.text)"


@query("map_coords", WHOLE_ITEMS)
def _(t):
    return patterns.found_items(t.documents, t.benchmark.select("item_id", F.col("text").alias("part")), "doc_id", "text", "part")


@query("map_coords_whole", WHOLE_ITEMS)
def _(t):
    """As map_coords, by the way that a larger library takes: in shares, which texts stream past."""
    return patterns.found_items(t.documents, t.benchmark.select("item_id", F.col("text").alias("part")), "doc_id", "text", "part", most=16, spread=8)


@query("map_offset", "select conv_id, turn, coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as start from conversations qualify count(*) over (partition by conv_id, turn) = 1")
def _(t):
    once = t.conversations.withColumn("_n", F.count("*").over(Window.partitionBy("conv_id", "turn")))
    parts = t.conversations.select("conv_id", "turn", F.length("text").alias("n"))
    out = docmap.shifted(once.filter("_n = 1").select("conv_id", "turn", F.lit(None).cast("string").alias("start"), F.length("text").cast("string").alias("end")), parts, "conv_id", "turn")
    return out.select("conv_id", "turn", F.col("start").cast("long").alias("start"))


@query("map_search_text", f"with {DRAFT} select doc_id, string_agg(heading || chr(10) || body, chr(10) order by section)[:12000] as search_text from draft group by doc_id")
def _(t):
    return docmap.search_text(sections_of(t), "doc_id")


@query("agg_outline", f"with {DRAFT} select doc_id, count(*) filter (depth = 1) as sections, count(*) filter (depth > 1) as subsections, max(depth)::int as deepest, count(*) as named, max(case when depth = 1 then least(section + 2, last) - section end)::bigint as widest from (select *, max(section) over (partition by doc_id) as last from draft) group by doc_id")
def _(t):
    """How many sections and subsections there are, how deep, how many have a heading of their own, and how many the widest section holds."""
    tree = layout.outline(layout.heuristic_map(drafts(t), "doc_id", "text"), "doc_id")
    top = F.col("depth") == 1
    return tree.groupBy("doc_id").agg(F.count_if(top).alias("sections"), F.count_if(~top).alias("subsections"), F.max("depth").alias("deepest"), F.count_if(~docmap.is_fallback(F.col("heading"))).alias("named"), F.max(F.when(top, F.col("last") - F.col("section"))).alias("widest"))


@query("srt_entities", "select o_custkey, string_agg(o_orderkey::varchar, ',' order by o_totalprice, o_orderkey) as ordered from orders group by o_custkey")
def _(t):
    rows = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_totalprice", "o_orderkey"))).alias("x"))
    return rows.select("o_custkey", F.array_join(F.transform("x", lambda v: v["o_orderkey"].cast("string")), ",").alias("ordered"))


@query("cnd_noise", f"with {SAID} select doc_id, i as pos, i % 5 in (0, 2, 4) as noise from said")
def _(t):
    """A field label, a short heading, an amount, an article and an item of a list, in turn."""
    n = lambda i: (i % 900 + 1).cast("string")
    text = lambda x, i: F.when(i % 5 == 0, "Client Name:").when(i % 5 == 1, F.concat(n(i), F.lit(". Definitions"))).when(i % 5 == 2, F.concat(F.lit("USD "), n(i), F.lit(",000.00"))).when(i % 5 == 3, F.concat(F.lit("ARTICLE "), n(i), F.lit(" which is kept"))).otherwise(F.concat(n(i), F.lit(") Policies which are covered")))
    lines = said(t).select("doc_id", F.posexplode(F.transform("s", text)).alias("pos", "line"))
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), H.is_label_heading(F.col("line")).alias("noise"))


@query("cnd_defrag", "select c_custkey, case c_custkey % 3 when 0 then 'LIMITS AND ' || c_mktsegment when 1 then 'LIMITS AND' else 'LIMITS FOR ' || c_mktsegment end as heading from customer")
def _(t):
    body = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_mktsegment", F.lit(": 100 each"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("limits and "), F.lower("c_mktsegment")))
    return t.customer.select("c_custkey", H.joined_heading(F.when(F.col("c_custkey") % 3 < 2, "LIMITS AND").otherwise(F.concat(F.lit("LIMITS FOR "), "c_mktsegment")), F.coalesce(body, F.lit("RETENTION: 1"))).alias("heading"))


SEGMENT = "upper(c_mktsegment[1]) || lower(c_mktsegment[2:])"


def referring(t: Tables, mark) -> DataFrame:
    """Texts with a name before a mark, after a label, prose or the end of a sentence; the name comes again; some have no mark."""
    lead = F.when(F.col("c_custkey") % 4 == 0, "PERIOD ").when(F.col("c_custkey") % 4 == 1, "as agreed under the ").when(F.col("c_custkey") % 4 == 2, "It ends. ").otherwise("")
    name = F.concat(F.initcap("c_mktsegment"), F.lit(" Clause"))
    return t.customer.select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, F.concat(lead, name, F.lit(" "), mark, F.lit(" and  "), name, mark, F.lit(". "), "c_name")).otherwise(F.concat(name, F.lit(" without a mark"))).alias("text"))


@query("cnd_asref", f"select c_custkey, 0 as idx, {SEGMENT} || ' Clause' as name from customer where c_custkey % 5 > 0")
def _(t):
    return candidates.attached_references(referring(t, F.when(F.col("c_custkey") % 2 == 0, "(As attached)").otherwise("( as  expiring )")).withColumn("text", F.replace("text", F.lit("as  exp"), F.lit("as exp"))), "c_custkey", "text")


@query("cnd_coderef", f"select c_custkey, 0::bigint as idx, {SEGMENT} || ' Clause' as name, 'LSW ' || (c_custkey % 900 + 100) as code from customer where c_custkey % 5 > 0")
def _(t):
    return candidates.coded_references(referring(t, F.concat(F.lit("(LSW "), (F.col("c_custkey") % 900 + 100).cast("string"), F.lit(")"))), "c_custkey", "text")


def contracts(t: Tables) -> DataFrame:
    """doc_id, text: an opening, two provisions, and a third with the first one's heading, which for even keys repeats it."""
    again = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("The limit is "), "c_custkey", F.lit(" in all."))).otherwise(F.repeat(F.lit("Another limit holds. "), F.lit(5)))
    name = F.initcap("c_mktsegment")
    parts = [F.concat(F.lit("Opening words of "), "c_name"), F.lit("LIMITS CLAUSE"), F.concat(F.lit("The limit is "), "c_custkey", F.lit(" in all.")), F.concat(F.lit("2. "), name, F.lit(" Notice")), F.concat(F.lit("It is told within days under the "), name, F.lit(" Clause (LSW 101).")), F.lit("LIMITS CLAUSE"), again]
    return relations.dealt_out(t.customer, "c_custkey").select(F.col("c_custkey").alias("doc_id"), F.concat_ws("\n\n", *parts).alias("text"))


@query("cnd_build", f"""select c_custkey as doc_id, 1::bigint as section, 'LIMITS CLAUSE' as heading, 'The limit is ' || c_custkey || ' in all.' as body from customer
 union all select c_custkey, 2, '2. ' || {SEGMENT} || ' Notice', 'It is told within days under the ' || {SEGMENT} || ' Clause (LSW 101).' from customer
 union all select c_custkey, 3, 'LIMITS CLAUSE', trim(repeat('Another limit holds. ', 5)) from customer where c_custkey % 2 = 1 union all select c_custkey, 0, {SEGMENT} || ' Clause', '' from customer""")
def _(t):
    docs = contracts(t)
    running = relations.once(docmap.running_headers(docs, "doc_id", "text"))
    found = candidates.built(docmap.heuristic_sections(docs, "doc_id", "text"), "doc_id", running)
    attached, coded = candidates.attached_references(docs, "doc_id", "text"), candidates.coded_references(docs, "doc_id", "text")
    return candidates.with_references(found, attached, coded, "doc_id", running).select("doc_id", "section", "heading", "body")


@query("cnd_build_documents")
def _(t):
    return candidates.built(sections_of(t), "doc_id", docmap.running_headers(t.documents, "doc_id", "text")).drop("_k")


@query("cnd_neardup")
def _(t):
    """Sections of one document whose headings have one name key: small groups, as many as there are names."""
    rows = sections_of(t).select("doc_id", X.name_key(F.col("heading")).alias("name_key"), "section", "body")
    return candidates.without_near_duplicates(rows.withColumn("part", F.concat_ws("/", F.col("doc_id").cast("string"), "name_key")), "part", "name_key", "section", "body").select("doc_id", "name_key", "section")


@query("cnd_codeindex", "select code_key, min(p_partkey) as p_partkey from (select regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') as code_key, p_partkey from part) where length(code_key) >= 5 group by code_key")
def _(t):
    return candidates.code_index(t.part.select("p_partkey", "p_brand", F.lit(True).alias("is_global")), "p_partkey", "p_brand")


@query("cnd_nameindex", r"select name_key, min(p_partkey) as p_partkey from (select trim(regexp_replace(trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), '(^| )clauses?$', '')) as name_key, p_partkey from part) where length(replace(name_key, ' ', '')) >= 4 group by name_key")
def _(t):
    return candidates.name_index(t.part.select("p_partkey", "p_name", F.lit(False).alias("is_global")), "p_partkey", "p_name")


@query("cnd_appendix", "select c_custkey as doc_id, 1::bigint as section, 3::bigint as other from customer where c_custkey % 2 = 1")
def _(t):
    s = docmap.heuristic_sections(contracts(t), "doc_id", "text")
    return candidates.appendices(s.select("doc_id", "section", "heading"), s, "doc_id").select("doc_id", "section", "other")


@query("cnd_attach")
def _(t):
    return candidates.attached_wordings(t.documents, "doc_id", "text")


@query("cnd_stage", "select doc_id, text[:4000] as staged from documents")
def _(t):
    return t.documents.select("doc_id", F.substring("text", 1, 4000).alias("staged"))  # the staged form is cut by definition


# Classes, rules, evidence


@query("cls_tiers", """select c_custkey, case c_custkey % 4 when 0 then 'name-ref' when 1 then 'code' when 2 then 'semantic' end as tier, case when c_custkey % 4 < 3 then c_nationkey::bigint end as item, case when c_custkey % 4 < 3 then 1.0::double end as similarity from customer""")
def _(t):
    """Candidates meet a library by name, by the longest code in heading or body, and by text; the first two names also hold a code."""
    library = t.nation.select(F.col("n_nationkey").cast("long").alias("item"), F.concat("n_name", F.lit(" Clause")).alias("name"), F.concat(F.lit("LSW"), (F.col("n_nationkey") + 100).cast("string")).alias("code"), F.concat(F.lit("the "), "n_name", F.lit(" risk is told within days")).alias("text"), F.lit(True).alias("is_global"))
    way, code = F.col("c_custkey") % 4, F.concat(F.lit("LSW "), (F.col("c_nationkey") + 100).cast("string"))
    nation = F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))
    heading = F.when(way == 0, F.concat(nation, F.lit(" Clause ("), code, F.lit(")"))).when(way == 1, F.concat(F.lit("Notice of "), code)).otherwise("Notice")
    body = F.when(way == 2, F.concat(F.lit("The "), nation, F.lit(" risk is told within days."))).when(way == 0, F.concat(F.lit("see "), code)).otherwise("unlike all else")
    return candidates.in_tiers(t.customer.select(F.col("c_custkey"), heading.alias("heading"), body.alias("body")), library, "c_custkey").select("c_custkey", "tier", "item", "similarity")


MODULES = "select 'metal' as module, 0 as place, ['steel', 'copper', 'tin'] as words union all select 'light', 1, ['small', 'promo']"


@query("cls_module", "select p_partkey as rule_id, case when contains(lower(p_name || ' ' || p_type), 'steel') or contains(lower(p_name || ' ' || p_type), 'copper') or contains(lower(p_name || ' ' || p_type), 'tin') then 'metal' when contains(lower(p_name || ' ' || p_type), 'small') or contains(lower(p_name || ' ' || p_type), 'promo') then 'light' else 'general' end as module from part")
def _(t):
    modules = t.spark.createDataFrame([("metal", 0, ["steel", "copper", "tin"]), ("light", 1, ["small", "promo"])], "module string, place int, words array<string>")
    rows = t.part.select(F.col("p_partkey").alias("rule_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.lit(None).cast("string").alias("module_key"))
    return rules.module_of(rows, modules, "general").select("rule_id", "module")


KINDS = "(select c_custkey, c_mktsegment in ('BUILDING', 'MACHINERY') as works, c_nationkey in (1, 2) or c_mktsegment = 'MACHINERY' as far from customer)"


@query("cls_module_auto", f"select c_custkey, case when works and far then 'works,far' when works then 'works' when far then 'far' else 'general' end as modules from {KINDS}")
def _(t):
    modules = [classify.Module("works", ("building", "Machinery")), classify.Module("far", ("MACHINERY",), ("nation_1", "nation_2"))]
    found = classify.modules_of_kinds(F.col("c_mktsegment"), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")), modules, "general")
    return t.customer.select("c_custkey", F.array_join(found, ",").alias("modules"))


REGISTRY = [classify.Mandatory("license", r"\blicen[sc]e\b", ("copyright",)), classify.Mandatory("rights", None, ("All rights", "reserved")), classify.Mandatory("numbers", "[0-9]{4}")]


@query("cls_registry", r"""select doc_id, name from (select doc_id, unnest(['license', 'rights', 'numbers']) as name, unnest([regexp_matches(text, '(?i)\blicen[sc]e\b') or contains(lower(text), 'copyright'), contains(lower(text), 'all rights') or contains(lower(text), 'reserved'), regexp_matches(text, '[0-9]{4}')]) as found from documents) where found""")
def _(t):
    """Which provisions of a registry of patterns and keywords each text has."""
    return t.documents.select("doc_id", F.explode(classify.registry_names(F.col("text"), REGISTRY)).alias("name"))


@query("cls_applicable", "select p_partkey as rule_id from part where p_size % 2 = 0 and p_partkey % 4 <> 0 and p_partkey % 9 <> 0 and (p_size not in (2, 4) or p_size = 2)")
def _(t):
    rows = t.part.select(F.col("p_partkey").alias("rule_id"), F.col("p_size").alias("category"), F.when(F.col("p_size") % 2 == 0, "active").otherwise("inactive").alias("status"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_partkey")).alias("version_id"))
    over = t.part.filter("p_partkey % 4 = 0").select(F.col("p_partkey").alias("rule_id"), F.lit("inactive").alias("override"))
    return rules.applicable(rows, None, F.array().cast("array<bigint>"), 2, [2, 4], over).select("rule_id")


@query("cls_registry", "select doc_id from documents where regexp_matches(text, '(?i)license|copyright|all rights reserved')")
def _(t):
    return t.documents.filter(F.col("text").rlike("(?i)license|copyright|all rights reserved")).select("doc_id")


@query("rul_queries", "select p_partkey, case when p_size % 3 = 0 then p_name when p_size % 3 = 1 then p_brand else p_type end as q from part")
def _(t):
    some = lambda k, c: F.when(F.col("p_size") % 3 == k, F.array(c)).otherwise(F.array().cast("array<string>"))
    return t.part.select("p_partkey", F.explode(rules.search_queries(some(0, "p_name"), some(1, "p_brand"), F.col("p_type"))).alias("q"))


@query("rul_chunks", f"""with h as ({PAIRS}), n as (select q % 50 as rule_id, q, item, s from h where 1 - s < 0.5 qualify row_number() over (partition by q order by round(s, 9) desc, item) <= 5),
 o as (select rule_id, item, max(s) as s from n group by all), got as (select rule_id, item::varchar as chunk, round(s, 6) as similarity from o qualify row_number() over (partition by rule_id order by round(s, 9) desc, item) <= 10),
 r as (select distinct vec_id % 50 as rule_id from embeddings), lost as (select rule_id from r where rule_id not in (select rule_id from got)),
 named as (select rule_id, 'detected-' || item_id as chunk, case when item_id % 3 = 0 then 0.85::double else 0.5::double end as similarity from lost join benchmark on item_id = rule_id where length(text) >= 20 and rule_id % 2 = 0)
 select * from got union all select * from named union all select rule_id, 'none', null from lost where rule_id not in (select rule_id from named)""")
def _(t):
    """Rules are groups of query vectors; a rule without hits takes the detected clauses that its name matches, or stands alone."""
    hits = similarity.retrieved(dense(t, 5, 0.0).withColumn("rule_id", F.col("q") % 50).drop("rank"), "rule_id", "q", "item")
    all_rules = t.embeddings.select((F.col("vec_id") % 50).alias("rule_id")).distinct()
    name = lambda c: F.concat(F.lit("rule <"), c.cast("string"), F.lit(">"))
    named = all_rules.select("rule_id", name(F.col("rule_id")).alias("name"), F.lit(None).cast("string").alias("description"), F.array().cast("array<string>").alias("keywords"))
    detected = t.benchmark.filter("item_id % 2 = 0").select(F.col("item_id").alias("clause_id"), F.concat(F.lit("Clause: "), name(F.col("item_id"))).alias("name"), "text", F.when(F.col("item_id") % 3 > 0, 0.5).alias("confidence"))
    found = rules.chunks_of(named, hits, detected, "item")
    chunk_id = F.when(F.col("origin") == "retrieved", F.col("item").cast("string")).when(F.col("origin") == "detected", F.concat(F.lit("detected-"), F.col("item").cast("string"))).otherwise("none")
    return found.select("rule_id", chunk_id.alias("chunk"), F.round("similarity", 6).alias("similarity"))


JUDGE = "case when regexp_matches(lower(text), '\\b(stupid|moron)\\b') then 3 when regexp_matches(lower(text), '\\b(license|rights)\\b') then 2 else 1 end"


@query("rul_llm", f"with e as (select source, {JUDGE} as s from documents), m as (select source, max(s) as top, count(*) as n from e group by source) select m.source, case top when 3 then 'Red' when 2 then 'Amber' else 'Green' end as status, round(count(*) filter (where s = top)::double / n, 6) as confidence, n as n_evidence from m join e using (source) group by m.source, top, n")
def _(t):
    out = rules.judged(t.documents, None, ["source"], red=["stupid", "moron"], amber=["license", "rights"])
    return out.withColumn("confidence", F.round("confidence", 6))


@query("rul_nohit", f"with r as (select distinct doc_id, case when toxic = 1 then 'Amber' else 'Green' end as status from labels) select d.doc_id, coalesce(r.status, 'Red') as status, case when r.status is null then '{rules.NO_EVIDENCE}' end as reasoning from documents d left join r using (doc_id)")
def _(t):
    found = t.labels.select("doc_id", F.when(F.col("toxic") == 1, "Amber").otherwise("Green").alias("status"), F.lit(0.5).alias("confidence"), F.lit(1).cast("long").alias("n_evidence"))
    return rules.with_no_hits(t.documents, found, ["doc_id"]).select("doc_id", "status", "reasoning")


@query("rul_war_ctx", "select p_partkey, case when contains(lower(p_name), 'an') or p_size > 45 then (p_name || ' ' || p_type)[:2000] end as context from part")
def _(t):
    wanted = F.lower("p_name").contains("an") | (F.col("p_size") > 45)
    return t.part.select("p_partkey", F.when(wanted, F.substring(F.concat_ws(" ", "p_name", "p_type"), 1, 2000)).alias("context"))


@query("rul_clean_evidence", "select doc_id, (length(trim(text, ' ')) >= 10 and regexp_matches(text, '[A-Za-z]'))::int::bigint as kept from documents")
def _(t):
    return t.documents.select("doc_id", F.size(rules.clean_evidence(F.array("text"))).cast("long").alias("kept"))


@query("rul_upsert", "select doc_id, coalesce(l.quality, 9) as quality, case when l.doc_id is null then 0 else 1 end as fresh, d.n_chars as bias from documents d left join labels l using (doc_id)")
def _(t):
    old = t.documents.select("doc_id", F.lit(9).alias("quality"), F.lit(0).alias("fresh"), F.col("n_chars").alias("bias"))
    new = t.labels.select("doc_id", "quality", F.lit(1).alias("fresh"), F.lit(None).cast("long").alias("bias"))
    return relations.upserted(old, new, ["doc_id"], keep=["bias"])


@query("rul_fail_placeholder", "select doc_id, toxic from labels union all select doc_id, 7 from documents where doc_id not in (select doc_id from labels)")
def _(t):
    return relations.inserted_if_absent(t.labels.select("doc_id", "toxic"), t.documents.select("doc_id", F.lit(7).alias("toxic")), ["doc_id"])


@query("rul_evidence_rows", """select p_partkey, 0 as idx, (p_name || repeat(' and on', p_size % 50))[:255] as section, (p_name || repeat(' and on', p_size % 50))[:100] as clause_type, p_type as text, case when p_size <= 25 then p_size end as item from part
 union all select p_partkey, 1, 'General', 'General', p_type, null from part""")
def _(t):
    heading = F.concat("p_name", F.repeat(F.lit(" and on"), F.pmod("p_size", F.lit(50))))
    one = F.struct(F.concat(F.lit("**"), heading, F.lit("**\n\n"), "p_type").alias("text"), F.col("p_size").alias("item"))
    two = F.struct(F.col("p_type").alias("text"), F.lit(None).cast("int").alias("item"))
    library = t.nation.select((F.col("n_nationkey") + 1).alias("item"))
    return rules.evidence_rows(t.part.select("p_partkey", F.array(one, two).alias("evidence")), library, "p_partkey").select("p_partkey", "idx", "section", "clause_type", "text", "item")


@query("jn_evidence_chunk", """with c as (select doc_id, k as chunk_id, text[k * 150 + 1 : k * 150 + 150] as chunk from (select doc_id, text, unnest(range(0, ceil(length(text) / 150.0)::bigint)) as k from documents)),
 e as (select doc_id, k as idx, text[k * 600 + 31 : k * 600 + 90] as text from (select doc_id, text, unnest(range(0, greatest(1, ceil(length(text) / 600.0))::bigint)) as k from documents)),
 m as (select e.doc_id, idx, min(chunk_id) as chunk_id from e left join c on e.doc_id = c.doc_id and length(e.text) >= 12 and (contains(c.chunk, e.text) or contains(e.text, c.chunk[:100])) group by all)
 select doc_id, idx, case when row_number() over (partition by doc_id, chunk_id order by idx) = 1 then chunk_id end as chunk_id from m""")
def _(t):
    """Evidence from every 600 characters of every document against its chunks of 150: missing, early and second matches occur."""
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / 600)).cast("int")
    evidence = t.documents.filter("text is not null").select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("idx"))
    evidence = evidence.select("doc_id", F.col("idx").cast("long").alias("idx"), F.substring("text", F.col("idx") * 600 + 31, F.lit(60)).alias("text"))
    parts = chunk.exploded(t.documents, chunk.pieces(F.col("text"), 150), "doc_id").select("doc_id", F.col("idx").cast("long").alias("chunk_id"), F.col("idx").alias("chunk_rank"), "chunk", F.lit(0.9).alias("similarity"))
    return rules.attributed(evidence, parts, "doc_id").select("doc_id", "idx", "chunk_id")


@query("jn_breadcrumb", f"""with {DRAFT}, e as (select doc_id, i, case i % 5 when 0 then p[6:40] when 1 then p || ' ' || coalesce(lead(p) over (partition by doc_id order by i), '') else 'nowhere ' || i end as e from said),
 hit as (select e.doc_id, e.i, min(q.i // 2 + 1) as section from e left join said q on q.doc_id = e.doc_id and (contains(q.p, e.e) or contains(e.e, q.p)) where e.i % 5 <= 2 group by all)
 select hit.doc_id, i, section, heading, number from hit left join draft using (doc_id, section)""")
def _(t):
    """Evidence inside a paragraph, evidence that holds one, and evidence that stands nowhere."""
    sections = layout.heuristic_map(drafts(t), "doc_id", "text")
    text = lambda p, i: F.when(i % 5 == 0, F.substring(p, 6, 35)).when(i % 5 == 1, F.concat_ws(" ", p, F.coalesce(F.get("s", i + 1), F.lit("")))).otherwise(F.concat(F.lit("nowhere "), i.cast("string")))
    evidence = said(t).select("doc_id", F.posexplode(F.transform("s", text)).alias("i", "e")).filter("i % 5 <= 2")
    found = layout.breadcrumbs(evidence, sections, "doc_id", "e")
    return found.select("doc_id", F.col("i").cast("long").alias("i"), "section", "heading", "number")


@query("rul_structured", f"with {ALIGN} select doc_id, count(*) as total, count(sim) as matched, round(coalesce(avg(sim), 0), 6) as average from status group by doc_id")
def _(t):
    return aligned(t).groupBy("doc_id").agg(F.count("*").alias("total"), F.count("similarity").alias("matched"), F.round(F.coalesce(F.avg("similarity"), F.lit(0.0)), 6).alias("average"))


@query("rul_manual", "select doc_id, case when doc_id % 10 = 0 then 1.0::double else 0.5 end as confidence, doc_id % 10 = 0 as manual from documents")
def _(t):
    old = t.documents.select("doc_id", F.lit(0.5).alias("confidence"), F.lit(False).alias("manual"))
    return relations.upserted(old, t.documents.filter("doc_id % 10 = 0").select("doc_id", F.lit(1.0).alias("confidence"), F.lit(True).alias("manual")), ["doc_id"])


@query("rul_manual_event", "select event_id, user_id, event_type from events where not (user_id = 3 and event_type = 'view') union all select -1, 3, 'view'")
def _(t):
    new = t.spark.createDataFrame([(-1, 3, "view")], "event_id long, user_id long, event_type string")
    rows = t.events.select("event_id", "user_id", "event_type")
    return relations.purged(rows, new.select("user_id", "event_type"), ["user_id", "event_type"]).select("event_id", "user_id", "event_type").unionByName(new)


@query("rul_recommend", "select p_partkey, exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R') as recommended from part")
def _(t):
    seen = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("r", F.lit(True))
    return t.part.select("p_partkey").join(seen, "p_partkey", "left").select("p_partkey", F.coalesce("r", F.lit(False)).alias("recommended"))


@query("rul_finalize", "select source, count(*) as total, count(l.doc_id) as done, count(l.doc_id) >= count(*) as complete from documents left join labels l using (doc_id) group by source")
def _(t):
    results = t.documents.select("doc_id", "source").join(t.labels.select("doc_id"), "doc_id")
    return rules.finished(results, t.documents.groupBy("source").agg(F.count("*").alias("total")), "source")


@query("rul_fast_meta", "select c_custkey, case when c_mktsegment = 'BUILDING' then c_name end as site, case when c_mktsegment <> 'BUILDING' then c_nationkey end as market from customer")
def _(t):
    meta = F.when(F.col("c_mktsegment") == "BUILDING", F.struct(F.col("c_name").alias("site"), F.lit(None).cast("int").alias("market"))).otherwise(F.struct(F.lit(None).cast("string").alias("site"), F.col("c_nationkey").alias("market")))
    return t.customer.select("c_custkey", meta.alias("m")).select("c_custkey", "m.site", "m.market")


# Streams, as batches; tests run the same functions on streams


@query("stm_fanout", "select l_orderkey, l_linenumber, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) - 1) // 50 as send from lineitem")
def _(t):
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.expr("0L").alias("z"), n.alias("n")).select("l_orderkey", "l_linenumber", F.floor((F.col("n") - 1) / 50).alias("send"))


@query("stm_debounce", "with g as (select *, case when ts - lag(ts) over w >= interval 15 seconds or lag(ts) over w is null then 1 else 0 end as first from events window w as (partition by user_id order by ts)), s as (select *, sum(first) over (partition by user_id order by ts) as burst from g) select user_id, count(*) as n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start from s group by user_id, burst")
def _(t):
    return jobs.debounced(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts").select("user_id", "n", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


@query("stm_collector", "select user_id, count(*) as done, 60::bigint as total, count(*) >= 60 as complete from events group by user_id")
def _(t):
    return jobs.collected(t.events, "user_id", t.events.select("user_id").distinct().withColumn("total", F.lit(60).cast("long")))


@query("stm_ratelimit", "select event_id, count(*) over (partition by user_id order by ts range between interval 60 seconds preceding and current row) as in_last from events")
def _(t):
    return jobs.in_last(t.events, "user_id", "ts", 60).select("event_id", "in_last")


@query("stm_tumbling", "select user_id, strftime(time_bucket(interval 60 seconds, ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from events group by all")
def _(t):
    return jobs.tumbling(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("stm_poll", "select event_id from (select event_id, lead(ts) over (partition by user_id order by ts, event_id) - ts as gap from events) where gap > interval 180 seconds")
def _(t):
    return jobs.stalls(t.events, "user_id", "ts", F.col("event_id")).select("event_id")


@query("stm_cron", "select event_id from events where ts < timestamp '2024-01-25' - interval 7 days")
def _(t):
    return jobs.expired(t.events, "ts", F.expr("timestamp_ntz'2024-01-25'")).select("event_id")


# Rewrites


@query("mut_version", "select o_custkey, count(*) + 1 as version, 'new' as text from orders group by o_custkey")
def _(t):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    versions = t.orders.select("o_custkey", n.alias("version"), F.lit("old").alias("text"))
    out = relations.new_versions(versions, t.orders.select("o_custkey").distinct().withColumn("text", F.lit("new")), "o_custkey")
    return out.withColumn("version", F.col("version").cast("long"))


@query("mut_copy", "select sha256('ws2:' || c_custkey) as id, sha256('ws2:' || max(o_orderkey)) as current_version_id from customer join orders on o_custkey = c_custkey group by c_custkey")
def _(t):
    versions = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version_id"))
    rows = versions.groupBy("id").agg(F.max("version_id").alias("current_version_id"))
    copies, own = relations.copied(rows, versions, "ws2")
    return copies.join(own.select(F.col("version_id").alias("current_version_id")), "current_version_id", "left_semi").select("id", "current_version_id")


@query("mut_seed_upsert", "select r_regionkey, case when r_regionkey < 2 then 'seed' else r_name end as r_name from region union all select 99, 'seed'")
def _(t):
    seeds = t.spark.createDataFrame([(0, "seed"), (1, "seed"), (99, "seed")], "r_regionkey int, r_name string")
    return relations.upserted(t.region.select("r_regionkey", "r_name"), seeds, ["r_regionkey"])


@query("mut_purge", "select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey = 3)")
def _(t):
    gone = t.customer.filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return relations.purged(t.orders.select("o_orderkey", "o_custkey"), gone, ["o_custkey"]).select("o_orderkey")


@query("mut_override", "select s_suppkey, case when s_nationkey = 2 then 'inactive' else 'active' end as status from supplier")
def _(t):
    old = t.supplier.select("s_suppkey", F.lit("active").alias("status"))
    return relations.upserted(old, t.supplier.filter("s_nationkey = 2").select("s_suppkey", F.lit("inactive").alias("status")), ["s_suppkey"])


@query("mut_save_clause", "select n_name as name, case when n_regionkey = 1 then 'changed' else 'old' end as text from nation union all select 'brand new', 'changed'")
def _(t):
    old = t.nation.select(F.col("n_name").alias("name"), F.lit("old").alias("text"))
    saved = t.nation.filter("n_regionkey = 1").select(F.col("n_name").alias("name")).unionByName(t.spark.createDataFrame([("brand new",)], "name string")).withColumn("text", F.lit("changed"))
    return relations.upserted(old, saved, ["name"])
