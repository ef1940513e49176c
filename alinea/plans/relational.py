"""Scans, filters, projections, joins, aggregates, windows, sorts and dedups over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from alinea.functions import json as J
from alinea.functions import text as X
from alinea.operators.patterns import found_items
from alinea.operators import classify, relations
from alinea.plans.base import query
from alinea.sources import tables as S

# Scans


@query("src_table", "select o_orderkey, o_custkey, o_orderstatus from orders")
def _(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")


@query("src_point", "select c_custkey, c_name, c_acctbal from customer where c_custkey = 7")
def _(t):
    return t.customer.filter("c_custkey = 7").select("c_custkey", "c_name", "c_acctbal").limit(1)


@query("src_rel", """select c_custkey, c_name, n_name, count(o_orderkey) as n_orders, coalesce(string_agg(o_orderkey::varchar, ',' order by o_orderdate desc, o_orderkey), '') as orders
 from customer join nation on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by all""")
def _(t):
    own = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("d"), (-F.col("o_orderkey")).alias("k"))), asc=False).alias("o"))
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(own, "c_custkey", "left")
    return rows.select("c_custkey", "c_name", "n_name", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce(F.array_join(F.transform("o", lambda x: (-x["k"]).cast("string")), ","), F.lit("")).alias("orders"))


@query("src_page_quality", r"""with p as (select doc_id, trim(text) as t from documents),
 q as (select doc_id, length(t) as n, len(regexp_extract_all(t, '[a-z]{2,}[A-Z][a-z]{2,}'))::double / greatest(len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')), 1) as glued,
  length(regexp_replace(t, '[A-Za-z0-9\s.,;:%/()\-''"&$£€@#*+=?!\[\]]', '', 'g'))::double / greatest(length(t), 1) as odd from p)
 select doc_id, n < 60 or glued > 0.06 or odd > 0.12 as dirty from q""")
def _(t):
    return t.documents.select("doc_id", X.is_dirty_page(F.col("text")).alias("dirty"))


@query("src_ocr_pick", "select page_id, case when length(html) > length(url) then html else url end as picked from pages")
def _(t):
    return t.pages.select("page_id", S.picked_text(F.col("url"), F.col("html")).alias("picked"))


@query("src_ocr_cap", "select doc_id, source from (select doc_id, source, row_number() over (partition by source order by doc_id) as n from documents) where n <= 40")
def _(t):
    return relations.top_k(t.documents.select("doc_id", "source"), ["source"], 40, F.col("doc_id")).select("doc_id", "source")


@query("src_route", "select doc_id, case when n_chars::double / 5 >= 100 then 'layout' else 'ocr' end as route from documents")
def _(t):
    return t.documents.select("doc_id", S.route(F.col("n_chars"), F.lit(5)).alias("route"))


PDFS = """f as (select doc_id, text, greatest(1, ceil(length(text) / 1000.0)::bigint) as n from documents where text is not null),
 b as (select *, octet_length(encode(text)) + 8 + n as size, case doc_id % 6 when 0 then 'base64' when 1 then 'path' when 2 then 'no pdf' when 3 then 'empty' when 4 then 'lost' else 'raw' end as way from f),
 p as (select *, case way when 'no pdf' then 'not a PDF' when 'empty' then 'empty' when 'lost' then 'no such file' else case when size > 20000 then 'too large' end end as problem from b)"""


def made_pdfs(t):
    """doc_id, content: a file for each document, a thousand characters a page."""
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / 1000)).cast("int")
    pages = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring("text", k * 1000 + 1, F.lit(1000)))
    return t.documents.filter("text is not null").select("doc_id", F.encode(F.concat(F.lit("%PDF-1.4\n"), F.array_join(pages, "\f")), "utf-8").alias("content"))


def pdf_intake(t):
    """Requests that carry a file in base64, name a stored one, are one, or are in one of three ways at fault."""
    from alinea.sources import pdf

    made = made_pdfs(t)
    stored = made.filter("doc_id % 6 = 1").select(F.concat(F.lit("in/"), F.col("doc_id").cast("string")).alias("path"), "content", pdf.problem_of(F.col("content"), 20_000).alias("problem"))
    way = F.col("doc_id") % 6
    path = F.to_json(F.struct(F.concat(F.when(way == 1, "in/").otherwise("out/"), F.col("doc_id").cast("string")).alias("storage_path")))
    body = F.when(way == 0, F.to_json(F.struct(F.base64("content").alias("pdf_base64")))).when(way.isin(1, 4), path).when(way == 2, F.to_json(F.struct(F.base64(F.lit(b"text")).alias("pdf_base64")))).when(way == 3, "").otherwise(F.decode("content", "utf-8"))
    return pdf.requested(made.select("doc_id", body.alias("body")), "doc_id", "body", stored, 20_000)


@query("src_pdf_in", f"with {PDFS} select doc_id, coalesce(problem, 'ok') as problem, case when problem is null then size end as size from p")
def _(t):
    taken = pdf_intake(t)
    return taken.select("doc_id", F.coalesce("problem", F.lit("ok")).alias("problem"), F.octet_length("content").cast("long").alias("size"))


@query("src_pdf", f"with {PDFS} select doc_id, unnest(range(1, n + 1)) as page, md5(text[(unnest(range(1, n + 1)) - 1) * 1000 + 1 : unnest(range(1, n + 1)) * 1000]) as text, null::varchar as problem from p where problem is null union all select doc_id, null, null, problem from p where problem is not null")
def _(t):
    from alinea.sources import pdf

    pages = pdf.pages(pdf_intake(t), "doc_id", pdf.plain_pages)
    return pages.select("doc_id", F.col("page").cast("long").alias("page"), F.md5("text").alias("text"), "problem")


@query("src_pdf_split", "select p_partkey, s::int as first_page, least(s + 5, p_size)::int as end_page from (select p_partkey, p_size, unnest(range(0, p_size, 5)) as s from part)")
def _(t):
    return t.part.select("p_partkey", F.explode(S.page_ranges(F.col("p_size"))).alias("r")).select("p_partkey", F.col("r.first").alias("first_page"), F.col("r.end").alias("end_page"))


@query("src_merge_text", """select conv_id, string_agg('--- PAGES ' || (turn * 5 + 1)::varchar || '-' || (turn * 5 + 5)::varchar || ' ---' || chr(10) || coalesce(text, ''), chr(10) || chr(10) order by turn, text) as text from conversations group by conv_id""")
def _(t):
    pages = t.conversations.select("conv_id", (F.col("turn") * 5 + 1).alias("first"), (F.col("turn") * 5 + 5).alias("last"), "text")
    return S.joined_chunks(pages, "conv_id", "first", "last", "text")


@query("src_merge_pages", """select conv_id, string_agg('--- PAGE ' || turn::varchar || ' ---' || chr(10) || coalesce(text, ''), chr(10) || chr(10) order by turn, text) as text from conversations group by conv_id""")
def _(t):
    return S.joined_pages(t.conversations, "conv_id", "turn", "text")


@query("src_table_filter", "select p_partkey, p_size % 6 >= 2 and p_partkey % 9 >= 2 and least(p_partkey % 7, p_partkey % 9)::double / (p_partkey % 9) >= 0.25 as kept from part")
def _(t):
    """Rows of p_partkey % 9 cells, of which up to p_partkey % 7 are filled and the others null or blank."""
    wide = (F.col("p_partkey") % 9).cast("int")
    full = F.least((F.col("p_partkey") % 7).cast("int"), wide)
    row = F.concat(F.array_repeat(F.lit("x"), full), F.array_repeat(F.when(F.col("p_partkey") % 2 == 0, "  "), wide - full))
    return t.part.select("p_partkey", F.coalesce(X.keeps_table(F.array_repeat(row, F.pmod("p_size", F.lit(6)))), F.lit(False)).alias("kept"))


@query("src_table_md", """select c_custkey, '| name | x y |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_name || ' | ' || case when c_nationkey % 3 = 0 then '' when c_nationkey % 3 = 1 then c_mktsegment else 'a ' || c_nationkey end || ' |' as md from customer""")
def _(t):
    value = F.when(F.col("c_nationkey") % 3 == 1, F.concat(F.lit("\n "), "c_mktsegment")).when(F.col("c_nationkey") % 3 == 2, F.concat(F.lit("a\n"), "c_nationkey"))
    row = F.when(F.col("c_nationkey") % 2 == 0, F.array(F.concat(F.lit("  "), "c_name"), value, F.lit("beyond the header"))).when(value.isNull(), F.array("c_name")).otherwise(F.array("c_name", value))
    return t.customer.select("c_custkey", X.table_markdown(F.array(F.array(F.lit(" name"), F.lit("x\ny ")), row)).alias("md"))


@query("src_ocr_repair", """select c_custkey, 'see LSW' || (c_custkey % 9900 + 10) || case when c_custkey % 2 = 0 then 'A' else '' end || ' and' || chr(10) || chr(10) || c_name || ' OIL SO85' as repaired from customer""")
def _(t):
    code = F.translate((F.col("c_custkey") % 9900 + 10).cast("string"), "0158", "OISB")
    text = F.concat(F.lit("\n see "), F.when(F.col("c_custkey") % 3 == 0, "LSW ").otherwise("Lsw"), code, F.when(F.col("c_custkey") % 2 == 0, "a").otherwise(""), F.lit(" and\n**__**\n\n| |\n\n"), "c_name", F.lit(" OIL SO85\n\n"))
    return t.customer.select("c_custkey", X.repaired_codes(text).alias("repaired"))


@query("snk_json_export", "select doc_id, lang, text from documents")
def _(t):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    rows = t.documents.select("doc_id", "lang", "text")
    line = rows.select(F.to_json(F.struct("doc_id", "lang", "text")).alias("line"))  # what a JSON sink writes, read again
    shape = StructType([StructField("doc_id", LongType()), StructField("lang", StringType()), StructField("text", StringType())])
    return line.select(F.from_json("line", shape).alias("r")).select("r.*")


@query("snk_bulk_import", "select count(*) filter (where toxic is not null) as good, count(*) filter (where toxic is null) as bad from documents left join labels using (doc_id)")
def _(t):
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    good, bad = S.imported(rows, "toxic")
    return good.agg(F.count("*").alias("good")).crossJoin(bad.agg(F.count("*").alias("bad")))  # one row each


@query("snk_null_vec", "select count(*) as n, 0::bigint as left_over from embeddings")
def _(t):
    return S.without_vectors(t.embeddings).agg(F.count("*").alias("n"), F.count("embedding").alias("left_over"))


# Filters and projections

SCOPE_ROWS = "select s_suppkey as id, s_nationkey % 5 = 0 as is_global, s_nationkey as org, case when s_suppkey % 3 = 2 then null else s_suppkey % 3 end as ws from supplier"
SCOPE_LINKS = "select distinct l_suppkey as id, l_linenumber::bigint as link_ws from lineitem where l_suppkey % 4 <> 0"


def scope_rows(t):
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 5 == 0).alias("is_global"), F.col("s_nationkey").alias("org"), F.when(F.col("s_suppkey") % 3 != 2, F.col("s_suppkey") % 3).alias("ws"))
    links = t.lineitem.filter("l_suppkey % 4 <> 0").select(F.col("l_suppkey").alias("id"), F.col("l_linenumber").cast("long").alias("link_ws")).distinct()
    return rows, links


@query("flt_scope", f"""with r as ({SCOPE_ROWS}), l as ({SCOPE_LINKS}) select distinct r.* from r left join l using (id)
 where is_global or (org = 3 and (ws = 1 or link_ws = 1 or (ws is null and link_ws is null)))""")
def _(t):
    return relations.in_scope(*scope_rows(t), org=3, workspace=1)


@query("flt_scope_global_ws", f"""with r as ({SCOPE_ROWS}), l as ({SCOPE_LINKS}), w as (select p_size::bigint as ws, p_partkey % 2 = 0 as is_global, p_brand as type from part)
 select r.* from r where exists (select 1 from l join w on l.link_ws = w.ws where l.id = r.id and w.is_global and w.type = (select min(p_brand) from part))""")
def _(t):
    rows, links = scope_rows(t)
    spaces = t.part.select(F.col("p_size").cast("long").alias("ws"), (F.col("p_partkey") % 2 == 0).alias("is_global"), F.col("p_brand").alias("type"))
    kind = t.part.agg(F.min("p_brand").alias("kind"))
    chosen = spaces.join(F.broadcast(kind), F.col("type") == F.col("kind"), "left_semi").select("ws", "is_global", F.lit("kind").alias("type"))  # one row
    return relations.in_global_workspaces(rows, links, chosen, "kind")


@query("flt_owner", """select c_custkey, case when c_nationkey = 0 then true when c_custkey % 3 = 0 then c_custkey % 10 = 4 else c_nationkey = 7 end as may_read from customer""")
def _(t):
    owner = F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 10)
    return t.customer.select("c_custkey", relations.may_read(F.col("c_nationkey") == 0, owner, F.col("c_nationkey"), 4, 7).alias("may_read"))


STATE = "select o_orderkey, case when o_orderkey % 7 = 0 then o_orderdate end as deleted, case when o_orderkey % 5 = 0 then o_orderdate end as archived from orders"


@query("flt_soft_delete", f"""select o_orderkey, case when deleted is not null then 'bin' when archived is not null then 'archive' else 'active' end as place from ({STATE})""")
def _(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderdate")).alias("deleted"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderdate")).alias("archived"))
    return rows.select("o_orderkey", F.when(F.col("deleted").isNotNull(), "bin").when(F.col("archived").isNotNull(), "archive").otherwise("active").alias("place"))


@query("flt_json_path", "select event_id, event_type from events where json_extract_string(props, '$.k') = '3'")
def _(t):
    return t.events.filter(J.field(F.col("props"), "k") == "3").select("event_id", "event_type")


@query("flt_in_list", "select p_partkey, p_name from part where p_size in (1, 5, 9)")
def _(t):
    return t.part.filter(F.col("p_size").isin(1, 5, 9)).select("p_partkey", "p_name")


@query("flt_status_set", "select event_id, user_id from events where event_type in ('view', 'click') and value >= 0")
def _(t):
    return t.events.filter(F.col("event_type").isin("view", "click") & (F.col("value") >= 0)).select("event_id", "user_id")


@query("flt_time_gte", "select event_id from events where ts >= (select max(ts) from events) - interval 3 days")
def _(t):
    last = t.events.agg(F.max("ts").alias("last"))
    return t.events.join(F.broadcast(last), F.expr("ts >= last - interval 3 days")).select("event_id")  # one row


@query("flt_expired", "select event_id from events where event_type = 'error' and ts < timestamp '2024-01-20' - interval 7 days")
def _(t):
    from alinea.streaming.jobs import expired

    return expired(t.events.filter("event_type = 'error'"), "ts", F.expr("timestamp_ntz'2024-01-20'")).select("event_id")


@query("flt_like", "select c_custkey, c_name from customer where c_name like 'Customer%' and c_name is not null")
def _(t):
    return t.customer.filter(F.col("c_name").like("Customer%") & F.col("c_name").isNotNull()).select("c_custkey", "c_name")


@query("flt_search_contracts", "select p_partkey from part where (lower(p_name) like '%an%' or lower(p_type) like '%an%') and coalesce(p_size >= 10, false) and coalesce(p_size <= 40, false)")
def _(t):
    return t.part.filter(relations.searched(" AN ", F.col("p_name"), F.col("p_type")) & F.coalesce(F.col("p_size") >= 10, F.lit(False)) & F.coalesce(F.col("p_size") <= 40, F.lit(False))).select("p_partkey")


@query("flt_search_clauses", "select p_partkey, p_brand from part where list_contains(list_transform(string_split(p_name, ' '), lambda k: contains(lower(k), 'e')), true) and p_brand = (select max(p_brand) from part)")
def _(t):
    top = t.part.agg(F.max("p_brand").alias("p_brand"))
    return t.part.filter(F.exists(F.split("p_name", " "), lambda k: F.lower(k).contains("e"))).join(F.broadcast(top), "p_brand").select("p_partkey", "p_brand")  # one row


@query("flt_search_rules", "select p_partkey, case when contains(lower(p_name || ' ' || p_type), 'st') then 'exclusion' else 'condition' end as kind from part where p_size > 5")
def _(t):
    kind = F.when(F.lower(F.concat_ws(" ", "p_name", "p_type")).contains("st"), "exclusion").otherwise("condition")
    return t.part.filter("p_size > 5").select("p_partkey", kind.alias("kind"))


@query("flt_search_admin", """with h as (select c_custkey, c_name from customer where contains(lower(c_name), '1') or contains(lower(c_mktsegment), '1'))
 select c_custkey, c_name, (select count(*) from h) as total from h order by c_custkey limit 250""")
def _(t):
    hits = t.customer.filter(relations.searched("1", F.col("c_name"), F.col("c_mktsegment"))).select("c_custkey", "c_name")
    total = hits.agg(F.count("*").alias("total"))
    return hits.orderBy("c_custkey").limit(250).crossJoin(F.broadcast(total))  # one row


@query("flt_hide_empty_red", "select doc_id from labels where not (toxic = 1 and quality = 0)")
def _(t):
    return t.labels.filter(~((F.col("toxic") == 1) & (F.col("quality") == 0))).select("doc_id")


@query("flt_notif", "select event_id from events where user_id = 5 or (user_id % 10 = 3 and event_type <> 'error') or event_type = 'error'")
def _(t):
    is_global = F.col("event_type") == "error"
    return t.events.filter((F.col("user_id") == 5) | ((F.col("user_id") % 10 == 3) & ~is_global) | is_global).select("event_id")


@query("flt_selected", "select s_suppkey from supplier where s_suppkey in (1, 2, 3)")
def _(t):
    chosen = F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)])
    return t.supplier.filter((F.size(chosen) == 0) | F.array_contains(chosen, F.col("s_suppkey"))).select("s_suppkey")


@query("prj_case_scope", "select c_custkey, case when c_nationkey = 0 then 'global' when c_custkey % 3 = 0 then 'user' when c_nationkey < 20 then 'org' else 'orphan' end as scope from customer")
def _(t):
    return t.customer.select("c_custkey", F.when(F.col("c_nationkey") == 0, "global").when(F.col("c_custkey") % 3 == 0, "user").when(F.col("c_nationkey") < 20, "org").otherwise("orphan").alias("scope"))


@query("prj_case_order", "select n_name from nation order by case when n_regionkey = 3 then 0 else 1 end, n_name limit 1")
def _(t):
    return t.nation.orderBy(F.when(F.col("n_regionkey") == 3, 0).otherwise(1), "n_name").limit(1).select("n_name")


@query("prj_audit_status", """select event_id, case when event_type = 'error' then 'failed' when value >= 100 then 'completed' when event_type = 'view' or value > 0 then 'reviewing' else 'pending' end as status from events""")
def _(t):
    name = F.when(F.col("event_type") == "view", "in review").otherwise(F.col("event_type"))
    return t.events.select("event_id", classify.audit_status(name, F.col("value"), F.lit(None).cast("string")).alias("status"))


@query("prj_audit_status_list", """select event_id, case when event_type = 'view' then 'reviewing' when user_id % 7 > 0 and value >= user_id % 7 then 'completed' when event_type = 'error' then 'failed' else 'pending' end as status from events""")
def _(t):
    name = F.when(F.col("event_type") == "view", "Neural Mapping failed").when(F.col("event_type") == "error", "has failed").otherwise(F.upper("event_type"))
    return t.events.select("event_id", classify.audit_status_list(name, F.col("value"), F.col("user_id") % 7).alias("status"))


@query("prj_initcap", "select event_id, upper(event_type[1]) || event_type[2:] as label from events")
def _(t):
    return t.events.select("event_id", X.first_upper(F.col("event_type")).alias("label"))


@query("prj_is_active_version", "select o_orderkey, o_custkey, row_number() over w as version, row_number() over w = count(*) over (partition by o_custkey) as is_active from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
def _(t):
    w = Window.partitionBy("o_custkey")
    n = F.row_number().over(w.orderBy("o_orderdate", "o_orderkey"))
    return t.orders.select("o_orderkey", "o_custkey", n.alias("version"), (n == F.count("*").over(w)).alias("is_active"))


@query("prj_plan_limit", "select o_custkey, count(*) >= case when o_custkey % 2 = 0 then 20 else 6 end as at_limit from orders group by o_custkey")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).select("o_custkey", (F.col("n") >= F.when(F.col("o_custkey") % 2 == 0, 20).otherwise(6)).alias("at_limit"))


@query("prj_daily_limit", "select user_id, day, n > case when user_id % 3 = 0 then 50 when user_id % 3 = 1 then 5 else 1 end as over from (select user_id, strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by all)")
def _(t):
    limits = F.element_at(F.create_map(*[F.lit(x) for x in (0, 50, 1, 5, 2, 1)]), (F.col("user_id") % 3).cast("int"))
    return t.events.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).select("user_id", "day", (F.col("n") > limits).alias("over"))


# Joins


@query("jn_inner_equi", "select l_orderkey, l_linenumber, o_orderstatus, p_brand from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey where l_quantity > 45")
def _(t):
    rows = t.lineitem.filter("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_partkey")
    return rows.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey").join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").select("l_orderkey", "l_linenumber", "o_orderstatus", "p_brand")


@query("jn_left", "select c_custkey, o_orderkey from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'F'")
def _(t):
    return t.customer.select("c_custkey").join(t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey", "left")


@query("jn_bridge", "select distinct s_suppkey, p_brand from supplier join lineitem on l_suppkey = s_suppkey join part on p_partkey = l_partkey")
def _(t):
    links = t.lineitem.select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey")).distinct()
    return t.supplier.select("s_suppkey").join(links, "s_suppkey").join(t.part.select("p_partkey", "p_brand"), "p_partkey").select("s_suppkey", "p_brand").distinct()


@query("jn_semi_or", """select event_id from events where (event_type = 'view' and user_id in (select c_custkey from customer where c_nationkey = 1))
 or (event_type = 'click' and user_id in (select s_suppkey from supplier where s_acctbal > 0)) or (event_type = 'purchase' and user_id in (select o_custkey from orders))""")
def _(t):
    known = [("view", t.customer.filter("c_nationkey = 1").select(F.col("c_custkey").alias("user_id"))), ("click", t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("user_id"))), ("purchase", t.orders.select(F.col("o_custkey").alias("user_id")))]
    pairs = [ids.distinct().select("user_id", F.lit(k).alias("event_type")) for k, ids in known]
    return t.events.join(pairs[0].unionByName(pairs[1]).unionByName(pairs[2]), ["user_id", "event_type"], "left_semi").select("event_id")


@query("jn_anti_exists", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def _(t):
    return t.customer.select("c_custkey").join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("jn_anti_not_in", "select p_partkey from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R')")
def _(t):
    return t.part.select("p_partkey").join(t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query("jn_anti_orphan", "select doc_id from labels l where doc_id not in (select doc_id from documents where doc_id % 2 = 0)")
def _(t):
    return t.labels.select("doc_id").join(t.documents.filter("doc_id % 2 = 0").select("doc_id"), "doc_id", "left_anti")


@query("jn_scalar_sub", "select n_nationkey, (select count(*) from customer where c_nationkey = n_nationkey) as customers, (select count(*) from supplier where s_nationkey = n_nationkey) as suppliers from nation")
def _(t):
    a = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return t.nation.select("n_nationkey").join(a, "n_nationkey", "left").join(b, "n_nationkey", "left").na.fill(0)


@query("jn_hydrate", "select l_partkey, p_name, max(l_extendedprice) as best from lineitem join part on p_partkey = l_partkey group by all order by best desc, l_partkey limit 20")
def _(t):
    hits = t.lineitem.groupBy("l_partkey").agg(F.max("l_extendedprice").alias("best")).orderBy(F.desc("best"), "l_partkey").limit(20)
    return hits.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").select("l_partkey", "p_name", "best")


@query("jn_override", "select d.doc_id, coalesce(case when l.toxic = 1 then 'inactive' end, 'active') as effective from documents d left join labels l using (doc_id)")
def _(t):
    over = t.labels.filter("toxic = 1").select("doc_id", F.lit("inactive").alias("override"))
    return t.documents.select("doc_id").join(over, "doc_id", "left").select("doc_id", F.coalesce("override", F.lit("active")).alias("effective"))


@query("jn_contains", """with q as (select n_nationkey, n_name || ' ' || p.t as t from nation join (select p_partkey % 25 as n_nationkey, string_agg(p_name, ' ' order by p_partkey) as t from part group by 1) p using (n_nationkey))
 select n_nationkey, arg_max(p_partkey, length(p_name) * 100000000 - p_partkey) as found from q join part on contains(t, p_name) group by n_nationkey""")
def _(t):
    joined = t.part.groupBy((F.col("p_partkey") % 25).alias("n_nationkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), " ").alias("names"))
    texts = t.nation.join(joined, "n_nationkey").select("n_nationkey", F.concat_ws(" ", "n_name", "names").alias("t"))
    hits = found_items(texts, t.part.select("p_partkey", F.length("p_name").alias("n"), "p_name"), "n_nationkey", "t", "p_name")
    return hits.groupBy("n_nationkey").agg(F.max_by("p_partkey", F.struct("n", -F.col("p_partkey"))).alias("found"))


RULES = """r as (select distinct p_name as rule_id, lower(p_name) as name, case when length(p_name) % 2 = 0 then split_part(p_name, ' ', 2) else 'zz ' || split_part(p_name, ' ', 2) end as k1, split_part(p_name, ' ', 1) || ' goods' as k2, 'all the ' || lower(p_name) || ' (x)' as description from part),
 c as (select p_partkey as clause_id, trim(lower(case p_partkey % 3 when 0 then p_name when 1 then p_name[3:8] || '.' else 'the ' || split_part(p_name, ' ', 2) || ' of ' || p_brand end)) as c from part), other as (select lower(case when p_type = 'ECONOMY' and length(p_name) = 9 then p_name else p_brand end) as c from part)"""
MATCH = "length(c) >= 3 and (contains(name, c) or contains(c, name) or contains(k1, c) or contains(c, k1) or contains(k2, c) or contains(c, k2) or (length(c) > 5 and contains(description, c)))"


def named_rules(t):
    """Rules are the names of parts, with a keyword that is a word of the name or not, and another after a prefix."""
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    keywords = F.array(F.when(F.length("p_name") % 2 == 0, second).otherwise(F.concat(F.lit("zz "), second)), F.concat(F.lit("Article:  "), first, F.lit(" goods")))
    return t.part.select(F.col("p_name").alias("rule_id"), F.col("p_name").alias("name"), keywords.alias("keywords"), F.concat(F.lit("All the "), "p_name", F.lit(" (x)")).alias("description")).distinct()


@query("jn_rule_clause", f"with {RULES} select rule_id, clause_id from r join c on {MATCH}")
def _(t):
    """Clauses are parts: named as a rule, by a piece of that and a dot, or by more than it, half of them after a prefix."""
    from alinea.operators.rules import name_matches

    more = F.concat(F.lit("the "), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" of "), "p_brand")
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.substring("p_name", 3, 6), F.lit("."))).otherwise(more)
    return name_matches(named_rules(t), t.part.select(F.col("p_partkey").alias("clause_id"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Clause: "), name)).otherwise(name).alias("name")))


@query("jn_rule_matched", f"with {RULES} select rule_id, bool_or({MATCH}) or regexp_matches(name, '\\b' || k1 || '\\b') as matched from r, (select distinct c from other) group by rule_id, name, k1")
def _(t):
    """Which rules a clause matches, or a whole word of their own: clauses have names of nine characters of one type of parts, else brands."""
    from alinea.operators.rules import matched_rules

    name = F.when((F.col("p_type") == "ECONOMY") & (F.length("p_name") == 9), F.col("p_name")).otherwise(F.col("p_brand"))
    return matched_rules(named_rules(t), t.part.select(F.col("p_partkey").alias("clause_id"), name.alias("name")))


@query("jn_interval", """with s as (select o_custkey as doc, o_orderkey as page, o_orderkey % 900 as a, o_orderkey % 900 + 60 as b from orders), f as (select c_custkey as doc, 100 as lo, 400 as hi from customer)
 select doc, page, a, b from f join s using (doc) where a < hi and b > lo""")
def _(t):
    from alinea.operators.docmap import overlapping_segments

    key = F.col("o_orderkey") % 900
    segments = t.orders.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page"), key.alias("start"), (key + 60).alias("end"))
    found = t.customer.select(F.col("c_custkey").alias("doc"), F.lit(100).alias("low"), F.lit(400).alias("high"))
    return overlapping_segments(found, segments, "doc").select("doc", "page", F.explode("segments").alias("x")).select("doc", "page", F.col("x.start").alias("a"), F.col("x.end").alias("b"))


# Aggregates


@query("agg_count_avg", "select count(*) as n, coalesce(floor(avg(toxic * 100) + 0.5), 0)::bigint as average from labels")
def _(t):
    return t.labels.agg(F.count("*").alias("n"), F.coalesce(X.js_round(F.avg(F.col("toxic") * 100)), F.lit(0)).alias("average"))


COLOUR = "case when toxic = 1 then 'Red' when quality = 0 then 'Amber' else 'Green' end"


def coloured(t):
    return t.labels.select("doc_id", F.when(F.col("toxic") == 1, "Red").when(F.col("quality") == 0, "Amber").otherwise("Green").alias("status"))


@query("agg_group_count", f"select count(*) filter (where s = 'Red') as red, count(*) filter (where s = 'Amber') as amber, count(*) filter (where s = 'Green') as green, count(*) as total from (select {COLOUR} as s from labels)")
def _(t):
    s = F.col("status")
    return coloured(t).agg(*[F.count_if(s == k).alias(k.lower()) for k in ("Red", "Amber", "Green")], F.count("*").alias("total"))


@query("agg_type_mix", "select coalesce(case when event_type = 'error' then null else event_type end, 'other') as kind, count(*) as n from events group by 1")
def _(t):
    return t.events.groupBy(F.coalesce(F.when(F.col("event_type") != "error", F.col("event_type")), F.lit("other")).alias("kind")).agg(F.count("*").alias("n"))


@query("agg_trending", "select p_partkey, p_name, count(*) as n from lineitem join part on p_partkey = l_partkey where l_returnflag = 'A' group by all order by n desc, p_partkey limit 10")
def _(t):
    top = t.lineitem.filter("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_partkey").limit(10)
    return top.join(t.part.select("p_partkey", "p_name"), "p_partkey").select("p_partkey", "p_name", "n")


@query("agg_health", "select count(*) filter (where quality = 1) as approved, count(*) filter (where quality = 0) as unapproved from labels")
def _(t):
    return t.labels.agg(F.count_if(F.col("quality") == 1).alias("approved"), F.count_if(F.col("quality") == 0).alias("unapproved"))


@query("agg_pct_red", f"select floor(100.0 * count(*) filter (where s = 'Red') / greatest(count(*), 1) + 0.5)::bigint as pct from (select {COLOUR} as s from labels)")
def _(t):
    return coloured(t).agg(X.js_round(F.lit(100.0) * F.count_if(F.col("status") == "Red") / F.greatest(F.count("*"), F.lit(1))).alias("pct"))


@query("agg_by_scope", "select case when c_nationkey = 0 then 'global' when c_custkey % 3 = 0 then 'user' else 'org' end as scope, count(*) as n from customer group by 1")
def _(t):
    return t.customer.groupBy(F.when(F.col("c_nationkey") == 0, "global").when(F.col("c_custkey") % 3 == 0, "user").otherwise("org").alias("scope")).agg(F.count("*").alias("n"))


@query("agg_recent_tags", """with r as (select event_id, ts, event_type || (user_id % 3)::varchar as tag, user_id from events), f as (select user_id, tag, max(ts) as last from r group by all)
 select user_id, string_agg(tag, ',' order by last desc, tag) as tags from (select *, row_number() over (partition by user_id order by last desc, tag) as n from f) where n <= 3 group by user_id""")
def _(t):
    last = t.events.groupBy("user_id", F.concat("event_type", (F.col("user_id") % 3).cast("string")).alias("tag")).agg(F.max("ts").alias("last"))
    best = relations.top_k(last, ["user_id"], 3, F.desc("last"), F.col("tag"))
    return best.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]), ",").alias("tags"))


@query("agg_compliance", "select greatest(0, 100 - avg(toxic * 100)) as compliance from labels")
def _(t):
    return t.labels.agg(F.greatest(F.lit(0.0), 100 - F.avg(F.col("toxic") * 100)).alias("compliance"))


@query("agg_count", "select count(*) as n from orders where o_orderstatus = 'O' and o_totalprice > 1000")
def _(t):
    return t.orders.filter("o_orderstatus = 'O' and o_totalprice > 1000").agg(F.count("*").alias("n"))


@query("agg_having_dup", "select o_custkey, o_orderpriority, count(*) as n from orders group by all having count(*) > 2")
def _(t):
    return t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n")).filter("n > 2")


@query("agg_risk_score", f"""with r as (select source, {COLOUR} as s from documents join labels using (doc_id)), p as (select source, count(*) as total from documents group by source)
 select source, coalesce(least(100, floor((count(*) filter (where s = 'Red') * 1.0 + count(*) filter (where s = 'Amber') * 0.4::double) / max(total) * 100 + 0.5)), 0)::int as risk from p left join r using (source) group by source""")
def _(t):
    planned = t.documents.groupBy("source").agg(F.count("*").alias("total"))
    found = t.documents.select("doc_id", "source").join(coloured(t), "doc_id").groupBy("source").agg(F.count_if(F.col("status") == "Red").alias("red"), F.count_if(F.col("status") == "Amber").alias("amber"))
    return planned.join(found, "source", "left").na.fill(0).select("source", classify.risk_score(F.col("red"), F.col("amber"), F.col("total")).alias("risk"))


@query("agg_checklist_buckets", f"select case s when 'Green' then 'matched' when 'Amber' then 'variation' else 'missing' end as bucket, count(*) as n from (select {COLOUR} as s from labels) group by 1")
def _(t):
    return coloured(t).groupBy(classify.bucket(F.col("status")).alias("bucket")).agg(F.count("*").alias("n"))


@query("agg_checklist_summary", f"""with r as (select source || '/' || lang as k, doc_id, {COLOUR} as s from documents join labels using (doc_id)), d as (select * from r qualify row_number() over (partition by k order by doc_id) = 1)
 select count(*) filter (where s = 'Green') as matched, count(*) filter (where s = 'Amber') as variation, count(*) filter (where s = 'Red') as missing, (select count(*) from r) as total from d""")
def _(t):
    rows = t.documents.select("doc_id", F.concat_ws("/", "source", "lang").alias("k")).join(coloured(t), "doc_id")
    s = F.col("status")
    once = relations.first_by(rows, ["k"], F.col("doc_id")).agg(F.count_if(s == "Green").alias("matched"), F.count_if(s == "Amber").alias("variation"), F.count_if(s == "Red").alias("missing"))
    return once.crossJoin(rows.agg(F.count("*").alias("total")))  # one row each


@query("agg_group_list", "select source, doc_id, count(*) over (partition by source) as n, min(doc_id) over (partition by source) as place from documents")
def _(t):
    """A row for each document below its source, with the source's count and place; no list of a whole source is built."""
    heads = t.documents.groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("place"))
    return t.documents.alias("d").join(heads.alias("h"), F.expr("d.source <=> h.source")).select("d.source", "d.doc_id", "h.n", "h.place")


@query("agg_evidence_stats", "select lang, count(source) as total, count(distinct source) as sections, count(*) filter (where doc_id % 3 = 0) as matched, count(*) filter (where doc_id % 10 = 0) as manual, round(coalesce(avg(case when doc_id % 3 = 0 then 0.5 end::double), 0), 6) as average from documents group by lang")
def _(t):
    from alinea.operators.rules import evidence_stats

    third = F.col("doc_id") % 3 == 0
    items = t.documents.select("lang", F.col("source").alias("section"), F.when(third, F.col("doc_id")).alias("item"), (F.col("doc_id") % 10 == 0).alias("manual"), F.when(third, 0.5).alias("confidence"))
    return evidence_stats(items, ["lang"]).withColumn("average", F.round("average", 6))


@query("agg_vote", """with v as (select user_id, case event_type when 'error' then 'Red' when 'click' then 'Amber' else 'Green' end as status, value, event_id from events),
 c as (select user_id, status, count(*) as n from v group by all), w as (select user_id, arg_max(status, n * 10 + case status when 'Red' then 3 when 'Amber' then 2 else 1 end) as status from c group by user_id)
 select w.user_id, w.status, b.event_id as record, b.value as confidence from w join (select * from v qualify row_number() over (partition by user_id order by value desc, event_id) = 1) b on b.user_id = w.user_id""")
def _(t):
    votes = t.events.select("user_id", F.when(F.col("event_type") == "error", "Red").when(F.col("event_type") == "click", "Amber").otherwise("Green").alias("status"), F.col("value").alias("confidence"), F.col("event_id").alias("record"))
    return classify.voted(votes, ["user_id"])


@query("agg_set_union", """with r as (select user_id, event_type, min(event_id) as first from events group by all) select user_id, string_agg(event_type, ',' order by first) as kinds from r group by user_id""")
def _(t):
    rows = t.events.select("user_id", "event_id", F.array("event_type").alias("kinds"))
    return classify.union_of(rows, ["user_id"], "event_id", "kinds").withColumn("kinds", F.array_join("kinds", ","))


@query("agg_max_version", "select c_custkey, coalesce(max(o_orderkey), 0) + 1 as next from customer left join orders on o_custkey = c_custkey group by c_custkey")
def _(t):
    last = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("last"))
    return t.customer.select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", (F.coalesce("last", F.lit(0)) + 1).alias("next"))


@query("agg_next_code", "select p_brand, printf('LIB-%03d', coalesce(max(p_partkey), 0) + 1) as next from part group by p_brand")
def _(t):
    return t.part.groupBy("p_brand").agg(X.next_code(F.concat(F.lit("LIB-"), F.col("p_partkey").cast("string")), "LIB").alias("next"))


@query("agg_run_header", r"""with l as (select doc_id, trim(regexp_replace(regexp_replace(lower(unnest(string_split(text, chr(10)))), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) as line_key from documents)
 select doc_id, line_key, count(*) as n from l where line_key <> '' and length(line_key) <= 60 group by all having count(*) > 3""")
def _(t):
    from alinea.operators.docmap import running_headers

    return running_headers(t.documents, "doc_id", "text")


@query("agg_quota", "select o_custkey, count(*) as n from orders where o_orderdate >= timestamp '1997-01-01' - interval 30 days and o_orderdate < timestamp '1997-01-01' group by o_custkey")
def _(t):
    return t.orders.filter("o_orderdate >= timestamp_ntz'1997-01-01' - interval 30 days and o_orderdate < timestamp_ntz'1997-01-01'").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("agg_progress", "select p_partkey, least(99, floor(90 + p_size * 9.0 / 50))::int as progress from part")
def _(t):
    return t.part.select("p_partkey", classify.progress(F.lit(90), F.col("p_size"), F.lit(50)).alias("progress"))


# Windows, sorts, dedups, sets


@query("win_latest_version", "select * from (select o_custkey, o_orderkey, o_orderdate from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1)")
def _(t):
    return relations.first_by(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))


@query("win_keep_newest_n", "select o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) > 10")
def _(t):
    return relations.archived_beyond(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], 10, F.desc("o_orderdate"), F.col("o_orderkey")).select("o_orderkey")


@query("win_best_vs_runner", "select l_partkey, l_orderkey, l_linenumber, l_extendedprice, runner_up from (select *, lead(l_extendedprice) over w as runner_up, row_number() over w as n from lineitem window w as (partition by l_partkey order by l_extendedprice desc, l_orderkey, l_linenumber)) where n = 1")
def _(t):
    rows = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return relations.best_and_margin(rows, ["l_partkey"], "l_extendedprice", F.col("l_orderkey"), F.col("l_linenumber"))


@query("win_best_per_key", "select user_id, event_id, value from events qualify row_number() over (partition by user_id order by value desc, event_id) = 1")
def _(t):
    return relations.first_by(t.events.select("user_id", "event_id", "value"), ["user_id"], F.desc("value"), F.col("event_id"))


@query("win_latest_membership", "select user_id, string_agg(event_id::varchar, ',' order by ts desc, event_id) as recent from (select * from events qualify row_number() over (partition by user_id order by ts desc, event_id) <= 5) group by user_id")
def _(t):
    best = relations.top_k(t.events.select("user_id", "event_id", "ts"), ["user_id"], 5, F.desc("ts"), F.col("event_id"))
    return best.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("recent"))


@query("win_version_pair", "select conv_id, turn, lag(length(text)) over (partition by conv_id order by turn, text) as before, length(text) as after from conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", F.lag(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn", "text")).alias("before"), F.length("text").alias("after"))


@query("win_section_fill", "select o_custkey, o_orderkey, count(*) filter (where o_orderpriority like '1%') over (partition by o_custkey order by o_orderkey rows unbounded preceding) as section from orders")
def _(t):
    rows = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderpriority").like("1%").alias("is_heading"))
    return relations.filled_sections(rows, ["o_custkey"], "o_orderkey", "is_heading").select("o_custkey", "o_orderkey", "section")


@query("win_pending_label", """with r as (select user_id, event_id, case when event_id % 5 = 0 then '(a)' else event_type end as t from events), l as (select *, lag(t) over (partition by user_id order by event_id) as b from r)
 select user_id, event_id, case when b = '(a)' then '(a) ' || t else t end as t from l where t <> '(a)'""")
def _(t):
    rows = t.events.select("user_id", "event_id", F.when(F.col("event_id") % 5 == 0, "(a)").otherwise(F.col("event_type")).alias("t"))
    return relations.labelled(rows, ["user_id"], "event_id", "t")


@query("srt_recent_n", "select event_id, ts from events order by ts desc, event_id limit 15")
def _(t):
    return t.events.select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(15)


@query("srt_bool_first", "select s_suppkey, s_acctbal > 0 as recommended, row_number() over (order by s_acctbal > 0 desc, s_suppkey) as place from supplier qualify place <= 50")
def _(t):
    top = t.supplier.select("s_suppkey", (F.col("s_acctbal") > 0).alias("recommended")).orderBy(F.desc("recommended"), "s_suppkey").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("recommended"), "s_suppkey")))  # 50 rows


@query("srt_page", "select c_custkey from customer order by c_name, c_custkey limit 50 offset 50")
def _(t):
    return relations.page(t.customer.select("c_custkey", "c_name"), 2, 50, F.col("c_name"), F.col("c_custkey")).select("c_custkey")


@query("srt_locale", "select distinct trim(p_type) as kind from part where trim(p_type) <> ''")
def _(t):
    return t.part.select(F.trim("p_type").alias("kind")).filter("kind <> ''").distinct().orderBy("kind")


@query("dst_first_by_id", "select l_orderkey, l_partkey from lineitem qualify row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) = 1")
def _(t):
    return relations.first_by(t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber"), ["l_orderkey"], F.col("l_linenumber"), F.col("l_partkey")).select("l_orderkey", "l_partkey")


@query("dst_last_by_key", "select user_id, min(event_id) as place, arg_max(event_type, event_id) as kind from events group by user_id")
def _(t):
    rows = t.events.select("user_id", F.col("event_id").alias("place"), F.col("event_type").alias("kind"))
    return relations.last_value_first_place(rows, "user_id", "place")


@query("dst_segments", "select doc_id from documents qualify row_number() over (partition by source || '::' || text[:100] order by doc_id) = 1")
def _(t):
    rows = t.documents.select("doc_id", F.concat("source", F.lit("::"), F.substring("text", 1, 100)).alias("k"))
    return relations.first_by(rows, ["k"], F.col("doc_id")).select("doc_id")


@query("dst_queries", "select distinct trim(unnest(string_split(p_name, ' '))) as query from part where p_name <> ''")
def _(t):
    from alinea.operators.rules import distinct_queries

    return distinct_queries(t.part.select(F.split("p_name", " ").alias("q")), "q")


@query("dst_file_hash", "select d.doc_id from documents d where exists (select 1 from documents e where md5(e.text) = md5(d.text) and e.doc_id < d.doc_id)")
def _(t):
    rows = t.documents.select("doc_id", F.md5("text").alias("h"))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("first"))
    return rows.join(first, "h").filter("first < doc_id").select("doc_id")


@query("set_flat", "select user_id, max(value) as best from (select user_id, value from events where event_type = 'view' union all select user_id, value from events where event_type = 'click') group by user_id order by best desc, user_id limit 10")
def _(t):
    both = t.events.filter("event_type = 'view'").select("user_id", "value").unionByName(t.events.filter("event_type = 'click'").select("user_id", "value"))
    return both.groupBy("user_id").agg(F.max("value").alias("best")).orderBy(F.desc("best"), "user_id").limit(10)


@query("set_models", "select p_partkey, array_to_string(list_distinct_order, ',') as models from (select p_partkey, [p_brand, p_type] as list_distinct_order from part)")
def _(t):
    return t.part.select("p_partkey", F.array_join(F.array_distinct(F.concat(F.array("p_brand", "p_type"), F.array("p_brand"))), ",").alias("models"))
