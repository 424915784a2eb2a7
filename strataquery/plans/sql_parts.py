"""Building blocks of the SQL counterparts (DuckDB dialect)."""

from __future__ import annotations

from ..functions.synonyms import SYNONYM_WEIGHT, table


def tok(x: str) -> str:
    """Tokens of a text, duplicates kept."""
    return rf"list_concat(list_concat(list_transform(regexp_extract_all(coalesce({x}, ''), '[a-zA-Z][a-zA-Z0-9]+'), lambda w: lower(w)), regexp_extract_all(coalesce({x}, ''), '\p{{Nd}}{{2,}}')), flatten(list_transform(regexp_extract_all(coalesce({x}, ''), '[一-鿿]+'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))))"


def first_seen(xs: str) -> str:
    """Distinct elements in order of first occurrence."""
    return f"list_reduce({xs}, lambda a, x: case when list_contains(a, x) then a else list_append(a, x) end, []::varchar[])".replace("list_reduce(" + xs, "list_reduce(list_transform(" + xs + ", lambda x: [x])", 1).replace("lambda a, x: case when list_contains(a, x) then a else list_append(a, x) end", "lambda a, x: case when list_contains(a, x[1]) then a else list_append(a, x[1]) end")


def norm(x: str) -> str:
    """Normal form for search."""
    t = f"coalesce({x}, '')"
    for sign, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("­", ""), (" ", " ")):
        t = f"replace({t}, '{sign}', '{letters}')"
    return rf"nfc_normalize(regexp_replace({t}, '([A-Za-z])\s*¨\s*([A-Za-z])', '\1\2' || chr(776), 'g'))"


def half_up(x: str, n: int) -> str:
    return f"floor(cast({x} as double) * {10**n} + 0.5) / {10**n}.0::double"


def bc(x: str) -> str:
    return f"coalesce(array_to_string({x}, ' '), '')"


_RULES = ", ".join(f"('{k}', [{', '.join(repr(t) for t in v)}], {i})" for i, (k, v) in enumerate(table()))

CTES: dict[str, tuple[list[str], str]] = {
    "c": ([], "select distinct on (chunk_id) chunk_id, doc_key, node_key, node_local_ordinal, local_id, title, breadcrumb, body, line_num, line_end, source_md, node_id, split_part(doc_key, ':', 1) as doc_type from chunks where chunk_id is not null and doc_key is not null order by chunk_id"),
    "ct": (["c"], f"select *, {tok('title')} as tt, {tok(bc('breadcrumb'))} as bt, {tok('body')} as dt from c"),
    "p": (["ct"], "select token, chunk_id, any_value(doc_key) as doc_key, any_value(node_key) as node_key, any_value(local_id) as local_id, any_value(lt) as len_title, any_value(lb) as len_breadcrumb, any_value(ld) as len_body, count(*) filter (f = 0) as title_tf, count(*) filter (f = 1) as breadcrumb_tf, count(*) filter (f = 2) as body_tf from (select chunk_id, doc_key, node_key, local_id, len(tt) as lt, len(bt) as lb, len(dt) as ld, unnest(list_concat(list_concat(list_transform(tt, lambda t: {'t': t, 'f': 0}), list_transform(bt, lambda t: {'t': t, 'f': 1})), list_transform(dt, lambda t: {'t': t, 'f': 2}))) as x from ct) cross join lateral (select x.t as token, x.f as f) group by token, chunk_id"),
    "st": (["p"], "select token, count(*) as df_any, count(*) filter (title_tf > 0 or breadcrumb_tf > 0) as df_nonbody, count(*) filter (body_tf > 0) as df_body from p group by token"),
    "tot": (["ct"], "select count(*) as n, count(distinct doc_key) as documents, coalesce(sum(len(tt)), 0) as lt, coalesce(sum(len(bt)), 0) as lb, coalesce(sum(len(dt)), 0) as ld from ct"),
    "q": ([], f"select query_id, query, norm, {first_seen(tok('norm'))} as tokens from (select distinct query_id, query, {norm('query')} as norm from judged_queries)"),
    "syn": ([], f"select * from (values {_RULES}) as r(k, v, i)"),
    "qt": (["q", "syn"], f"select query_id, token, min(ord) as ord, max(weight) as weight, max(weight) = 1.0 as original from (select query_id, unnest(tokens) as token, generate_subscripts(tokens, 1) - 1 as ord, 1.0 as weight from q union all select query_id, unnest(v) as token, 1000 + i * 100 + generate_subscripts(v, 1) as ord, {SYNONYM_WEIGHT} as weight from q, syn where len(tokens) > 0 and (instr(lower(norm), k) > 0 or list_contains(tokens, k))) group by query_id, token"),
    "known": (["qt", "st", "tot"], "select query_id, ord, token, weight, original, (df_body >= 256 and df_body * 10 >= n * 9) as hidden, case when df_body >= 256 and df_body * 10 >= n * 9 then df_nonbody else df_any end as df from qt join st using (token), tot"),
    "met": (["known", "p"], "select * exclude (body_tf), case when hidden then 0 else body_tf end as body_tf from known join p using (token) where title_tf + breadcrumb_tf + (case when hidden then 0 else body_tf end) > 0"),
    "scored": (["met", "tot"], f"select query_id, chunk_id, any_value(doc_key) as doc_key, any_value(node_key) as node_key, any_value(local_id) as local_id, min(ord) as ord, {half_up('sum(part)', 2)} as score from (select *, ln(1 + (n - df + 0.5) / (df + 0.5)) * weight * (case when title_tf > 0 then title_tf * 2.5 / (title_tf + 1.5 * (0.25 + 0.75 * len_title / (lt / n))) * 6 else 0 end + case when breadcrumb_tf > 0 then breadcrumb_tf * 2.5 / (breadcrumb_tf + 1.5 * (0.25 + 0.75 * len_breadcrumb / (lb / n))) * 3 else 0 end + case when body_tf > 0 then body_tf * 2.5 / (body_tf + 1.5 * (0.25 + 0.75 * len_body / (ld / n))) else 0 end) as part from met, tot) group by query_id, chunk_id having sum(part) > 0"),
    "few": (["scored"], "select *, row_number() over (partition by query_id order by score desc, ord, doc_key, local_id, chunk_id) as rank from (select *, row_number() over (partition by query_id, doc_key order by score desc, ord, doc_key, local_id, chunk_id) as n from scored) where n <= 3"),
    "pb": (["few"], "select query_id, chunk_id, doc_key, node_key, local_id, score, rank from few where rank <= 50"),
    "qg": (["q"], r"select query_id, list_concat(list_concat(list_transform(range(1, length(cj)), lambda i: substr(cj, i, 2)), list_transform(range(1, len(en)), lambda i: en[i] || ' ' || en[i + 1])), en) as grams, list_concat(list_transform(range(1, length(cj)), lambda i: substr(cj, i, 2)), list_transform(range(1, len(en)), lambda i: en[i] || ' ' || en[i + 1])) as pairs from (select query_id, array_to_string(regexp_extract_all(lower(norm), '[一-鿿]+'), '') as cj, regexp_extract_all(lower(norm), '[a-z][a-z0-9]+') as en from q)"),
    "ctitle": (["c"], f"select chunk_id, lower(coalesce(title, '') || ' ' || {bc('breadcrumb')}) as tt, title, breadcrumb, body from c"),
    "pa": (["few", "qg", "ctitle"], f"select * exclude (b), row_number() over (partition by query_id order by score desc, b) as rank from (select query_id, chunk_id, doc_key, node_key, local_id, rank as b, {half_up('share', 2)} as score from (select few.*, case when len(grams) > 0 then len(list_filter(grams, lambda g: contains(tt, g))) / len(grams) else 0 end as share from few join ctitle using (chunk_id) join qg using (query_id) where rank <= 60) where share > 0.3) qualify rank <= 20"),
    "docs5": (["met"], "select query_id, doc_key, route_score from (select query_id, doc_key, cast(sum(s) as double) as route_score, row_number() over (partition by query_id order by sum(s) desc, doc_key) as n from (select query_id, doc_key, token, 2 * max(case when title_tf > 0 then 1 else 0 end) + max(case when breadcrumb_tf > 0 then 1 else 0 end) as s from met where original and title_tf + breadcrumb_tf > 0 group by all) group by query_id, doc_key) where n <= 5"),
    "pe": (["docs5", "c"], "select query_id, chunk_id, doc_key, node_key, local_id, 0.1::double as score, row_number() over (partition by query_id order by doc_key, local_id, chunk_id) as rank from docs5 join c using (doc_key) qualify rank <= 20"),
    "paths": (["pa", "pb", "pe"], "select query_id, chunk_id, doc_key, node_key, local_id, score, rank, 0 as path from pa union all by name select *, 1 as path from pb union all by name select *, 2 as path from pe"),
    "fused": (["paths"], "select query_id, doc_key, node_key, round(sum(1.0::double / (60 + rank)), 12) as rrf_score, min(path * 1000000 + rank) as seen, arg_max({'chunk_id': chunk_id, 'local_id': local_id}, {'s': score, 'o': -(path * 1000000 + rank)}) as i from paths group by query_id, doc_key, node_key"),
    "hitlist": (["fused"], f"select query_id, row_number() over (partition by query_id order by rrf_score desc, seen) as rank, doc_key, node_key, i.chunk_id as chunk_id, i.local_id as local_id, {half_up('rrf_score', 3)} as score, rrf_score from (select *, row_number() over (partition by query_id, doc_key order by rrf_score desc, seen) as n from fused) where n <= 3 qualify rank <= 50"),
}


def sql(select: str, *names: str) -> str:
    """A statement that starts with the CTEs it needs."""
    order: list[str] = []

    def need(n: str) -> None:
        if n not in order:
            for d in CTES[n][0]:
                need(d)
            order.append(n)

    for n in names:
        need(n)
    return "with " + ",\n".join(f"{n} as materialized ({CTES[n][1]})" for n in order) + "\n" + select if order else select

CTES |= {
    "nd": (["c"], r"select doc_key, node_key, h.title as title, h.breadcrumb as breadcrumb, h.body as body, h.source_md as source_md, h.node_id as node_id, list_distinct_ordered as terms, coalesce(substr(h.body, 1, 200), '') as summary from (select doc_key, node_key, h, " + first_seen(r"list_filter(regexp_split_to_array(coalesce(h.title, ''), '[\s·\-—.,;:!?()\[\]{}]+'), lambda p: length(p) >= 2)") + " as list_distinct_ordered from (select doc_key, node_key, arg_min({'title': title, 'breadcrumb': breadcrumb, 'body': body, 'source_md': source_md, 'node_id': node_id}, {'o': node_local_ordinal, 'c': chunk_id}) as h from c group by doc_key, node_key))"),
    "np": (["nd"], f"select doc_key, node_key, field, token, count(*) as tf, any_value(length) as length from (select doc_key, node_key, x.field as field, len(x.ts) as length, unnest(x.ts) as token from (select doc_key, node_key, unnest([{{'field': 'title', 'ts': {tok('title')}}}, {{'field': 'breadcrumb', 'ts': {tok(bc('breadcrumb'))}}}, {{'field': 'terms', 'ts': {tok(bc('terms'))}}}, {{'field': 'summary', 'ts': {tok('summary')}}}]) as x from nd)) group by all"),
    "ndf": (["np"], "select token, count(*) as df from np group by token"),
    "nl": (["nd"], f"select count(*) as n, sum(len({tok('title')})) / count(*) as avg_title, sum(len({tok(bc('breadcrumb'))})) / count(*) as avg_breadcrumb, sum(len({tok(bc('terms'))})) / count(*) as avg_terms, sum(len({tok('summary')})) / count(*) as avg_summary, sum(len({tok('coalesce(title, chr(39)||chr(39)) || ' + bc('breadcrumb') + ' || ' + bc('terms') + ' || summary')})) / count(*) as avg_len from nd".replace("chr(39)||chr(39)", "''")),
    "eq": (["syn"], f"select distinct query_id, token from (select query_id, unnest({tok('query')}) as token from judged_queries union all select query_id, unnest(v) from (select distinct query_id, query, {tok('query')} as ts from judged_queries), syn where len(ts) > 0 and (instr(lower(query), k) > 0 or list_contains(ts, k)))"),
    "nscore": (["eq", "np", "ndf", "nl"], f"select query_id, doc_key, node_key, {half_up('sum(part)', 2)} as score from (select query_id, doc_key, node_key, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / case field when 'title' then avg_title when 'breadcrumb' then avg_breadcrumb when 'terms' then avg_terms else avg_summary end)) * case field when 'title' then 6 when 'breadcrumb' then 3 else 2 end as part from eq join ndf using (token) join np using (token), nl) group by all having sum(part) > 0"),
}
