"""Queries of the two general data problems (numbers 5 and 6), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental, table_diff
from ..session import load, scratch

KEYS = ["doc_key", "node_key", "node_local_ordinal"]
FIELDS = ["title", "breadcrumb", "line_num", "body_sha256"]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    now = incremental.listing(load(spark, d, "source_docs"))
    built = incremental.manifest_of_runs(load(spark, d, "segment_refs"), load(spark, d, "build_runs"))
    return incremental.pending(now, built, scratch(spark, "p5"))


def copies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Both copies under the same names; line_num as a number in both (what is no number is compared as text)."""
    number = F.coalesce(F.expr("cast(try_cast(trim(line_num) as bigint) as string)"), F.col("line_num").cast("string"))
    pick = lambda t, h: load(spark, d, t).select(*KEYS, "title", "breadcrumb", number.alias("line_num"), F.col(h).alias("body_sha256"))
    return pick("legacy_chunks", "legacy_body_sha256"), pick("generation_chunks", "generation_body_sha256")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    legacy, generation = copies(spark, d)
    return table_diff.diff(legacy, generation, KEYS, FIELDS, missing_right="missing_in_generation", missing_left="added_in_generation")


QUERIES = {"p5_found": p5_found, "p6_found": p6_found}

SQL = {
    "p5_found": """
with now as (
  select nfc_normalize(doc_key) as doc_key, lower(content_hash) as c, lower(segment_recipe_hash) as r, coalesce(deleted, false) as del,
         row_number() over (partition by nfc_normalize(doc_key) order by captured_at desc nulls last, arrived_at desc nulls last, lower(content_hash) desc nulls last, lower(segment_recipe_hash) desc nulls last, deleted desc nulls last) as rn
  from source_docs where doc_key is not null and (content_hash is not null or coalesce(deleted, false))),
built as (
  select nfc_normalize(doc_key) as doc_key, lower(content_hash) as c, lower(segment_recipe_hash) as r,
         row_number() over (partition by nfc_normalize(doc_key) order by stored_at desc nulls last, run_id desc, lower(content_hash) desc nulls last, lower(segment_recipe_hash) desc nulls last) as rn
  from segment_refs where doc_key is not null and run_id in (select run_id from build_runs where status = 'succeeded'))
select n.doc_key, case when b.doc_key is null then 'added' else 'changed' end as change
from (select * from now where rn = 1 and not del) n left join (select * from built where rn = 1) b on n.doc_key = b.doc_key
where b.doc_key is null or n.c is distinct from b.c or n.r is distinct from b.r""",
    "p6_found": """
with a as (select doc_key, node_key, node_local_ordinal, max(struct_pack(t := title, b := breadcrumb, l := try_cast(trim(line_num) as bigint), h := legacy_body_sha256)) as v from legacy_chunks group by all),
b as (select doc_key, node_key, node_local_ordinal, max(struct_pack(t := title, b := breadcrumb, l := cast(line_num as bigint), h := generation_body_sha256)) as v from generation_chunks group by all),
j as (select coalesce(a.doc_key, b.doc_key) as doc_key, coalesce(a.node_key, b.node_key) as node_key, coalesce(a.node_local_ordinal, b.node_local_ordinal) as node_local_ordinal, a.v as av, b.v as bv
      from a full join b on a.doc_key is not distinct from b.doc_key and a.node_key is not distinct from b.node_key and a.node_local_ordinal is not distinct from b.node_local_ordinal)
select doc_key, node_key, node_local_ordinal, 'missing_in_generation' as issue, '' as field from j where bv is null
union all select doc_key, node_key, node_local_ordinal, 'added_in_generation', '' from j where av is null
union all select doc_key, node_key, node_local_ordinal, 'changed', 'title' from j where av is not null and bv is not null and av.t is distinct from bv.t
union all select doc_key, node_key, node_local_ordinal, 'changed', 'breadcrumb' from j where av is not null and bv is not null and av.b is distinct from bv.b
union all select doc_key, node_key, node_local_ordinal, 'changed', 'line_num' from j where av is not null and bv is not null and av.l is distinct from bv.l
union all select doc_key, node_key, node_local_ordinal, 'changed', 'body_sha256' from j where av is not null and bv is not null and av.h is distinct from bv.h""",
}
