"""SQL of the ledger, report, audit and model-step queries, written apart from the operators."""

from __future__ import annotations

from weftline.operators.reasoning import DECOMPOSITION, EXTRACTION, FACT_CHECK, QUESTIONS
from weftline.plans.oracle import CANONICAL, CHUNKS, CITED, CLAIMS, GOLD, GRAPH, KEYS, LABELS, MENTIONS, PAIRS, RRF, SPANS, SQL as CORE, STAMPED, STATUS, TAGS, _id, _list, _raw_place, _toks, _verdict, ambiguous, canon, components, merge_pairs
from weftline.functions.text import PARTICLES

def _s(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _filled(template: str, **values: str) -> str:
    out, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        out += [_s(before), values[name]]
    return " || ".join([*out, _s(rest)])


_WEAK = f"(len(string_split(key, ' ')) = 1 or list_contains({_list(PARTICLES)}, string_split(key, ' ')[1]))"
_PARENTS = f"{CLAIMS}, pp as (select parent_claim_id as p, list(text order by claim_index, text) as parts from cl where parent_claim_id is not null group by 1)"
_ITEMS = "it as (select p, trim(unnest(parts)) as text, generate_subscripts(parts, 1) as i from pp where substr(p, 1, 1) not in ('0', '1', '2')), fi as (select * from it where text <> '' qualify row_number() over (partition by p, lower(text) order by i) = 1)"
_NUMBERED = "nu as (select p, text, row_number() over (partition by p order by i) - 1 as k, count(*) over (partition by p) as n from fi)"
_SHOWN = "sw as (select atomic_claim_id as claim_id, chunk_id, min(text) as text from fused_evidence where text is not null and atomic_claim_id is not null group by all), so as (select *, row_number() over (partition by claim_id order by chunk_id) as pos, count(*) over (partition by claim_id) as n from sw)"
_ASKED = f"{CLAIMS}, {_SHOWN}, qs as (select distinct claim_id, case when substr(claim_id, 1, 1) between '0' and '7' then substr(text, 3, 40) end as quote from so where pos = n and claim_id in (select claim_id from cl)), "
_ASKED += f"hi as (select qs.claim_id, min(pos) as pos from qs join so on so.claim_id = qs.claim_id where {canon('quote')} <> '' and contains({canon('so.text')}, {canon('quote')}) group by 1)"
_WINDOWS = (
    f"{CHUNKS}, me as (select chunk_id, local_id, name, case when type = 'OTHER' and length(name) % 3 = 0 then 'THING' else type end as type, evidence_quotes from raw_entity_mentions where mention_id is not null and chunk_id is not null "
    "qualify row_number() over (partition by mention_id order by chunk_id nulls first, local_id nulls first, name nulls first, type nulls first, evidence_quotes nulls first) = 1), "
    "fit as (select me.*, coalesce(regexp_matches(local_id, '^e[0-9]+$') and length(name) > 0 and type in ('PERSON', 'LOCATION', 'ORGANIZATION', 'OBJECT', 'OTHER') and len(evidence_quotes) > 0 and len(list_filter(evidence_quotes, lambda q: q is null)) = 0, false) as fit from me join c using (chunk_id)), "
    "wi as (select chunk_id, bool_and(fit) as fit from fit group by 1), gw as (select chunk_id from wi where fit and substr(chunk_id, 1, 1) not in ('0', '1'))"
)
_WQUOTES = (
    f"{_WINDOWS}, fa as (select distinct 'entity' as kind, chunk_id || ':' || local_id as fact_id, chunk_id, unnest(evidence_quotes) as quote from fit where chunk_id in (select chunk_id from gw) union "
    "select 'relation', chunk_id || ':' || local_id, chunk_id, unnest(case when substr(chunk_id, 1, 1) = '2' then ['words that stand nowhere'] else evidence_quotes end) from (select * from fit where chunk_id in (select chunk_id from gw) qualify row_number() over (partition by chunk_id order by local_id nulls first, name nulls first, type nulls first, evidence_quotes nulls first) = 1)), "
    f"pq as (select fa.*, text, source_id, char_start as w, {canon('quote')} as q, {canon('text')} as t from fa join c using (chunk_id)), pl as (select *, q <> '' and instr(t, q) > 0 as hit from pq)"
)
_PLACES = (
    f"sx as (select kind, fact_id, source_id, w + {_raw_place('substr(t, 1, instr(t, q) - 1)')} as s, w + {_raw_place('substr(t, 1, instr(t, q) + length(q) - 2)')} + 1 as e from pl where hit), "
    "px as (select distinct kind, fact_id, c.chunk_id, greatest(s, c.char_start) as char_start from sx join c on c.source_id = sx.source_id and c.char_start < e and s < c.char_end where c.char_end > c.char_start), "
    "ep as (select fact_id, chunk_id, char_start from px where kind = 'entity' qualify row_number() over (partition by fact_id order by char_start, chunk_id) = 1)"
)
_NOVEL = CANONICAL.replace(MENTIONS, f"{_WQUOTES}, {_PLACES}, m as (select ('0x' || substr(sha256(f.chunk_id || ':' || f.local_id), 1, 15))::bigint as mention_id, c.source_id, f.chunk_id || '/' || f.local_id as local_id, name, type, ep.char_start, [] as aliases, f.chunk_id as window_id, f.local_id as own from (select distinct chunk_id, local_id, name, type from fit where chunk_id in (select chunk_id from gw)) f join ep on ep.fact_id = f.chunk_id || ':' || f.local_id join c on c.chunk_id = f.chunk_id)")
_NOVEL_TIES = (
    "ne as (select distinct window_id as chunk_id, own as local_id, entity_id from mc join ce using (component)), go as (select chunk_id, local_id, name, type, evidence_quotes from fit where chunk_id in (select chunk_id from gw)), "
    "tr as (select chunk_id as window_id, arg_min(local_id, r) as s, arg_max(local_id, r) as o from (select *, row_number() over (partition by chunk_id order by local_id nulls first, name nulls first, type nulls first, evidence_quotes nulls first) as r from go) group by 1), "
    "rp as (select fact_id, chunk_id from px where kind = 'relation' qualify row_number() over (partition by fact_id order by char_start, chunk_id) = 1)"
)
_FACTS = (
    f"{MENTIONS}, f0 as (select * from m where local_id is not null and char_start is not null and chunk_id is not null), "
    "f1 as (select *, lead(local_id) over (partition by source_id order by char_start, mention_id) as nx, 'near ' || type as predicate from f0), "
    f"en as (select distinct source_id, local_id, {_id('source_id', 'local_id')} as entity_id from f0 where local_id not like '%7'), "
    "pr as (select mention_id, source_id, local_id, 'AGENT' as role from f1 union all select mention_id, source_id, nx, 'PATIENT' from f1 where nx is not null), "
    "pk as (select pr.*, entity_id from pr left join en using (source_id, local_id)), "
    "pe as (select mention_id, bool_or(entity_id is null) as dangling, list_sort(list(entity_id) filter (entity_id is not null)) as ids from pk group by 1), "
    f"ev as (select f1.*, case when not dangling then {_id('predicate', 'array_to_string(ids, ' + chr(39) + ':' + chr(39) + ')', 'chunk_id', 'char_start::varchar')} end as event_id from f1 join pe using (mention_id)), "
    "ee as (select event_id, predicate, arg_min(mention_id, (local_id, mention_id)) as fact_id, count(*) as n_facts from ev where event_id is not null group by all), "
    "pa as (select pk.entity_id, ev.event_id, role, count(distinct ev.chunk_id) as weight from pk join ev using (mention_id) where event_id is not null group by all)"
)
_FAMILIES = (
    "fm as (select distinct source_id, entity_id, canonical_name, string_split(canonical_name, ' ')[-1] as w, length(canonical_name) % 5 as k from entity_records where entity_type = 'PERSON'), "
    f"m as (select ('0x' || substr(sha256(source_id || ':' || entity_id), 1, 15))::bigint as mention_id, source_id, case k when 0 then 'Lord ' || w when 1 then 'Lady ' || w when 2 then 'Blind ' || w when 3 then w else canonical_name end as name, [canonical_name] as aliases from fm)"
)
_FTAGS = TAGS.replace(MENTIONS, _FAMILIES)
_FOUND = "fs as (select atomic_claim_id, chunk_id as evidence_chunk_id, list_sort(list_distinct(flatten(list(contributing_sources)))) as sources from fused_evidence where text is not null group by all)"
_EXPECTED = (
    "b2 as (select atomic_claim_id as claim_id, bool_or(label = 'CONTRADICTION' and score >= 0.92) as c, bool_or(label = 'ENTAILMENT' and score >= 0.6) as e from lb group by all), "
    "c2 as (select parent_claim_id, case when coalesce(c, false) then 'CONTRADICTED' when coalesce(e, false) then 'SUPPORTED' else 'UNRESOLVED' end as status from cl left join b2 using (claim_id) where parent_claim_id is not null), "
    "ex as (select parent_claim_id, case when count(*) filter (status = 'CONTRADICTED') > 0 then 'CONTRADICTORY' else 'CONSISTENT' end as gold from c2 group by 1)"
)
_VARIANTS = (
    f"{LABELS}, {_FOUND}, vn as (select unnest(['full', 'no_lexical', 'no_graph', 'no_semantic']) as variant, unnest([null, 'LEXICAL', 'GRAPH', 'SEMANTIC']) as lost), "
    "vl as (select variant, lb.* from lb join fs using (atomic_claim_id, evidence_chunk_id) cross join vn where lost is null or coalesce(sources <> [lost], true)), "
    "vb as (select variant, atomic_claim_id as claim_id, bool_or(label = 'CONTRADICTION' and score >= 0.95) as c, bool_or(label = 'ENTAILMENT' and score >= 0.5) as e from vl group by all), "
    "vc as (select vn.variant, parent_claim_id, case when coalesce(c, false) then 'CONTRADICTED' when coalesce(e, false) then 'SUPPORTED' else 'UNRESOLVED' end as status from cl cross join vn left join vb on vb.claim_id = cl.claim_id and vb.variant = vn.variant where parent_claim_id is not null), "
    f"vv as ({_verdict(True, 'vc', 'variant, parent_claim_id')})"
)


def _sizes(comp: str) -> str:
    return f"select source_id, sum(n)::bigint as n_mentions, count(*) as n_components, max(n) as largest from (select m.source_id, label, count(*) as n from {comp} join m on mention_id = node group by all) group by 1"


def _kept(strict_keys: bool) -> str:
    where = f"where not {_WEAK}" if strict_keys else ""
    return f"with recursive {KEYS}, e0 as (select mention_id as u, min(mention_id) over (partition by source_id, key) as v from (select distinct source_id, key, mention_id from ks {where})), no as (select distinct mention_id as id from ks), {components('e0', 'no')} {_sizes('cc')}"


_LEDGER = (
    f"{CITED}, {STAMPED}, vd as ({_verdict(True)}), kc as (select * from cl where parent_claim_id is not null), parts(parent_claim_id, part, item) as ("
    "select distinct parent_claim_id, 0, 'claim ' || parent_claim_id from kc union all select distinct parent_claim_id, 1, parent_claim_id from kc union all select parent_claim_id, 2, claim_id from kc "
    f"union all select parent_claim_id, 3, {_id('claim_id', chr(39) + '0' + chr(39), 't')} from (select *, 'Is it stated that ' || regexp_replace(text, '[.!?]+$', '') || '?' as t from kc) "
    "union all select parent_claim_id, 4, evidence_id from st join kc on claim_id = atomic_claim_id "
    "union all select parent_claim_id, 5, format('{}:{}:{:.6f}', atomic_claim_id, chunk_id, rrf_score) from (select distinct atomic_claim_id, chunk_id, rrf_score from fused_evidence where rrf_score is not null) join kc on claim_id = atomic_claim_id "
    "union all select parent_claim_id, 6, format('{}:{}:{}:{:.6f}', atomic_claim_id, evidence_chunk_id, label, score) from lb join kc on claim_id = atomic_claim_id "
    "union all select parent_claim_id, 7, evidence_chunk_id from ci join kc on claim_id = atomic_claim_id where kind = 'contradiction' "
    "union all select parent_claim_id, 8, evidence_chunk_id from ci join kc on claim_id = atomic_claim_id where kind = 'support' "
    "union all select parent_claim_id, 9, claim_id from cs where status = 'UNRESOLVED' union all select parent_claim_id, 10, verdict from vd union all select parent_claim_id, 11, fired_rule from vd), "
    "ev as (select parent_claim_id, unnest(range(12)) as part from (select distinct parent_claim_id from kc)), "
    "jo as (select ev.parent_claim_id, ev.part, coalesce(string_agg(item, ',' order by item), '') as t from ev left join parts using (parent_claim_id, part) group by all)"
)
_IDS = {
    "chunk": (f"select {_id('source_id', 'char_start::varchar', 'char_end::varchar', 'text')} as id from c"),
    "source_claim": f"select {_id(chr(39) + 'source' + chr(39), 'text')} as id from cl",
    "atomic_claim": f"select {_id('coalesce(parent_claim_id, ' + chr(39) * 2 + ')', 'claim_index::varchar', 'text')} as id from cl",
    "question": f"select {_id('claim_id', chr(39) + '0' + chr(39), 'text')} as id from cl",
    "query": f"select {_id('claim_id', chr(39) + 'CLAIM' + chr(39), chr(39) * 2, 'text')} as id from cl",
    "evidence": f"select {_id('query_id', 'source', 'chunk_id', 'rank::varchar')} as id from st",
    "raw_evidence": f"select {_id('query_id', 'chunk_id', 'rank::varchar')} as id from st",
    "entity": f"select {_id('canonical_name', 'entity_type')} as id from entity_records",
    "event": f"select {_id(chr(39) + 'appears' + chr(39), 'entity_id', 'provenance[1].chunk_id', 'provenance[1].char_start::varchar')} as id from entity_records",
    "mention_order": "select sha256(concat_ws(':', '1', 'None', local_id, name)) as id from m",
}
SQL = {
    "record_ids": f"with {CHUNKS}, {CLAIMS}, {STAMPED}, {MENTIONS} " + " union all ".join(f"select distinct '{k}' as kind, id from ({q}) where id is not null" for k, q in _IDS.items()),
    "token_cost": "select source, count(*) as calls, sum(greatest(1, length(text) // 4))::bigint as tokens, round(sum(greatest(1, length(text) // 4)) * 0.3 / 1e6 + count(*) * 200 * 2.5 / 1e6, 6) as cost from documents where text is not null group by source",
    "query_validation": f"select case when (origin = 'QUESTION') = (origin = 'QUESTION' and not starts_with(query_id, '0')) then 'valid' else 'origin and question differ' end as state, count(*) as n from ({CORE['query_builder']}) group by 1",
    "fused_records": f"with st as (select distinct evidence_id, atomic_claim_id, query_id, source, chunk_id, rank, recorded_at, text from retrieved_evidence where atomic_claim_id is not null and query_id is not null and rank is not null), bs as (select atomic_claim_id, chunk_id, source, min(rank) as best, sum(1.0 / (60 + rank)) as rr, min(recorded_at) as seen from st group by all), "
    "bq as (select atomic_claim_id, chunk_id, query_id, source, min(recorded_at) as seen from st group by all), nq as (select atomic_claim_id, chunk_id, string_agg(query_id, ',' order by seen, query_id) as query_ids from (select atomic_claim_id, chunk_id, query_id, min(seen) as seen from bq group by all) group by all), "
    "tx as (select atomic_claim_id, chunk_id, arg_min(text, (recorded_at, text)) as text from st where text is not null group by all), fu as (select atomic_claim_id, chunk_id, round(sum(rr), 9) as score, string_agg(source, ',' order by seen, source) as contributing_sources from bs group by all) "
    "select atomic_claim_id, chunk_id, round(score, 6) as rrf_score, contributing_sources, query_ids, sha256(text) as text_digest from fu join nq using (atomic_claim_id, chunk_id) left join tx using (atomic_claim_id, chunk_id) qualify row_number() over (partition by atomic_claim_id order by score desc, chunk_id) <= 10",
    "evidence_by_claim": f"with {STAMPED} select atomic_claim_id, row_number() over (partition by atomic_claim_id order by recorded_at nulls first, query_id, source nulls first, rank, chunk_id nulls first, evidence_id nulls first) as pos, evidence_id, chunk_id, query_id, source, rank from st",
    "unstamped_evidence": "select reason, count(*) as n from (select distinct evidence_id, case when atomic_claim_id is null then 'no claim' when query_id is null then 'no query' when rank is null then 'no rank' end as reason from retrieved_evidence) where reason is not null group by 1",
    "confusion_table": f"with {PAIRS} select gold, count(*) filter (predicted = 'CONSISTENT') as CONSISTENT, count(*) filter (predicted = 'CONTRADICTORY') as CONTRADICTORY, count(*) filter (predicted = 'INSUFFICIENT_EVIDENCE') as INSUFFICIENT_EVIDENCE from pa where predicted is not null group by gold",
    "claim_scores": f"with {LABELS}, b as (select atomic_claim_id as claim_id, count(*) as n, max(score) filter (label = 'CONTRADICTION') as c, max(score) filter (label = 'ENTAILMENT') as e from lb group by 1) select distinct claim_id, coalesce(n, 0) as n_results, c as best_contradiction, e as best_entailment, round(c - e, 6) as margin from cl left join b using (claim_id)",
    "gold_sanity": f"with {PAIRS} select sane, note, count(*) as n from (select gold = predicted or (gold = 'CONSISTENT' and predicted = 'INSUFFICIENT_EVIDENCE') as sane, case when gold = predicted then 'matched' when gold = 'CONSISTENT' and predicted = 'INSUFFICIENT_EVIDENCE' then 'not enough evidence, tolerated' when gold = 'CONSISTENT' then 'consistent claim contradicted' else 'expected ' || gold || ', got ' || predicted end as note from pa) group by all",
    "contradiction_recall": f"with {PAIRS} select round(count(*) filter (gold = 'CONTRADICTORY' and predicted = 'CONTRADICTORY') / nullif(count(*) filter (gold = 'CONTRADICTORY'), 0)::double, 6) as cdr from pa",
    "variant_accuracy": f"with {_VARIANTS}, {_EXPECTED}, mm as (select variant, count(*) as n, count(*) filter (gold = verdict) as correct, round(count(*) filter (gold = verdict) / count(*)::double, 6) as accuracy, round(count(*) filter (gold = 'CONTRADICTORY' and verdict = gold) / nullif(count(*) filter (gold = 'CONTRADICTORY'), 0)::double, 6) as cdr from vv join ex using (parent_claim_id) group by 1) select *, round((select accuracy from mm where variant = 'full') - accuracy, 6) as delta from mm",
    "verdict_changes": f"with {_VARIANTS} select a.parent_claim_id, a.verdict as before, b.verdict as after from vv a join vv b on a.parent_claim_id = b.parent_claim_id and a.variant = 'no_graph' and b.variant = 'full' where a.verdict <> b.verdict",
    "verifier_comparison": f"with {STATUS}, a as ({_verdict(True)}), b as ({_verdict(False)}), {_EXPECTED}, r as (select gold, a.verdict as a, b.verdict as b from a join b using (parent_claim_id) join ex using (parent_claim_id)) select count(*) as n, count(*) filter (a <> b) as changes, count(*) filter (a <> gold and b = gold) as corrections, count(*) filter (a = gold and b <> gold) as regressions, round(count(*) filter (a = gold) / nullif(count(*), 0)::double, 6) as accuracy_a, round(count(*) filter (b = gold) / nullif(count(*), 0)::double, 6) as accuracy_b from r",
    "missed_contradictions": f"with {LABELS}, {_EXPECTED}, b3 as (select atomic_claim_id as claim_id, bool_or(label = 'CONTRADICTION' and score >= 0.99) as c, bool_or(label = 'ENTAILMENT' and score >= 0.5) as e from lb group by all), c3 as (select parent_claim_id, bool_or(coalesce(c, false)) as hit from cl left join b3 using (claim_id) where parent_claim_id is not null group by 1), ne as (select parent_claim_id, count(chunk_id) as n from cl left join (select distinct atomic_claim_id, chunk_id from fused_evidence) on atomic_claim_id = claim_id where parent_claim_id is not null group by 1) select parent_claim_id, n as n_evidence, case when n = 0 then 'retrieval' else 'verifier' end as cause from ex join c3 using (parent_claim_id) join ne using (parent_claim_id) where gold = 'CONTRADICTORY' and not hit",
    "contradiction_grounding": f"with {CITED}, {GOLD}, {_EXPECTED}, gg as (select distinct parent_claim_id, chunk_id from go join cl on claim_id = atomic_claim_id where parent_claim_id is not null), cg as (select distinct parent_claim_id, evidence_chunk_id as chunk_id from ci join cl on claim_id = atomic_claim_id where kind = 'contradiction' and parent_claim_id is not null) select ex.parent_claim_id as example_id, case when gold = 'CONTRADICTORY' and ex.parent_claim_id in (select parent_claim_id from gg) then (exists (select 1 from cg join gg using (parent_claim_id, chunk_id) where cg.parent_claim_id = ex.parent_claim_id))::varchar else 'not asked' end as grounded from ex",
    "run_determinism": "select count(distinct parent_claim_id) as n, count(distinct parent_claim_id) as same, true as every_same from atomic_claims where parent_claim_id is not null",
    "ledger_integrity": f"with {CITED}, qb as ({CORE['query_builder']}), kq as (select query_id from qb union select query_id from retrieved_evidence where source = 'SEMANTIC') select 'question has a claim' as constraint, 0 as violations union all select 'evidence is stamped', count(*) from retrieved_evidence where atomic_claim_id is null or query_id is null union all select 'evidence has a claim', count(*) from retrieved_evidence e where atomic_claim_id is not null and query_id is not null and not exists (select 1 from cl where claim_id = e.atomic_claim_id) union all select 'evidence has a query', count(*) from retrieved_evidence e where atomic_claim_id is not null and query_id is not null and not exists (select 1 from kq where kq.query_id = e.query_id) "
    "union all select 'result has fused evidence', count(*) from lb where not exists (select 1 from fused_evidence f where rrf_score is not null and f.atomic_claim_id = lb.atomic_claim_id and f.chunk_id = lb.evidence_chunk_id) union all select 'cited evidence has a claim', 0 union all select 'unsupported claim is known', 0 union all select 'verdict', 0",
    "ledger_recorded": f"with {CLAIMS} select count(*) as n_recorded, count(distinct claim_id) as n_claims, count(*) filter (regexp_matches(claim_id, '^[0-9]')) as n_refused from cl",
    "ledger_fingerprint_full": f"with {_LEDGER} select parent_claim_id, substr(sha256(string_agg(t, '|' order by part)), 1, 16) as fingerprint from jo group by 1",
    "entity_provenance": f"with {SPANS.replace('select distinct entity_id, source_id, p.char_start', 'select distinct entity_id, p.chunk_id, p.char_start')} select entity_id, sha256(string_agg(chunk_id || ':' || s || ':' || e, ',' order by chunk_id, s, e)) as digest, count(*) as n_places from sp group by 1",
    "graph_neighbours": f"with {GRAPH}, b as (select subject_entity_id as a, object_entity_id as b, weight from ed union all select object_entity_id, subject_entity_id, weight from ed) select a as entity_id, count(distinct b) as degree, sum(weight)::bigint as weight from b group by 1",
    "entity_lookup": "with k as (select lower(canonical_name) as n, max(entity_id) as entity_id from entity_records where canonical_name is not null group by 1) select distinct mention_id, entity_id from raw_entity_mentions join k on lower(name) = n where entity_id is not null",
    "events_resolved": f"with {_FACTS} select * from ee",
    "event_participations": f"with {_FACTS} select * from pa",
    "event_rejects": f"with {_FACTS} select mention_id as fact_id, 'dangling reference' as reason from ev where event_id is null",
    "typed_edges": f"with {_FACTS}, r as (select source_id || '|' || local_id as s, source_id || '|' || nx as o, predicate as t, chunk_id, char_start from f1 where nx is not null and local_id <> nx), f as (select least(s, o) as lo, greatest(s, o) as hi, arg_min(s, (t, s, o)) as subject, arg_min(o, (t, s, o)) as object, min(t) as relation_type, count(*) as weight, count(distinct (chunk_id, char_start)) as n_places from r group by 1, 2) select subject, object, relation_type, weight, n_places from f",
    "graph_records_fingerprint": f"with {_FACTS}, rl as (select a.entity_id as s, b.entity_id as o, predicate as t, count(distinct chunk_id) as w from f1 join en a on a.source_id = f1.source_id and a.local_id = f1.local_id join en b on b.source_id = f1.source_id and b.local_id = nx where a.entity_id <> b.entity_id group by all), "
    "es as (select ee.*, source_id from ee join f1 on mention_id = fact_id), li as (select source_id, 1 as sec, entity_id as o, 'E:' || entity_id || ':' || local_id || ':OTHER' as l from en union all select source_id, 2, s || chr(0) || o || chr(0) || t, 'R:' || s || ':' || o || ':' || t || ':' || w from rl join en on s = entity_id "
    "union all select source_id, 3, event_id, 'V:' || event_id || ':' || predicate || ':NONE:' from es union all select source_id, 4, pa.entity_id || chr(0) || pa.event_id || chr(0) || role, 'P:' || pa.entity_id || ':' || pa.event_id || ':' || role || ':' || weight from pa join es using (event_id)) select source_id, sha256(string_agg(l, chr(10) order by sec, o, l)) as fingerprint from li group by 1",
    "records_fingerprint": "with li as (select entity_id as o, 'E:' || entity_id || ':' || canonical_name || ':' || entity_type as l from (select distinct source_id, entity_id, canonical_name, entity_type from entity_records)), b as (select substr(sha256(o || chr(0) || l), 1, 2) as p, sha256(string_agg(l, chr(10) order by o, l)) as h from li group by 1) select sha256(string_agg(h, chr(10) order by p)) as fingerprint from b",
    "key_kinds": f"with {KEYS}, mp as (select source_id, key, mention_id, min(pos) as pos from ks group by all), tc as (select mp.source_id, key, type, count(*) as n, min(pos) as pos from mp join m using (mention_id) group by all), pk as (select source_id, key, sum(n)::bigint as n_mentions, min(pos) = 0 as own from tc group by all), tt as (select * from tc qualify row_number() over (partition by source_id, key order by n desc, type nulls first) = 1) "
    f"select source_id, key, case when type = 'LOCATION' then 'location' when type = 'ORGANIZATION' then 'organization' when not own then 'alias' when len(string_split(key, ' ')) = 1 then 'surname' when list_contains({_list(PARTICLES)}, string_split(key, ' ')[1]) then 'surname with particle' when not list_contains({_list(PARTICLES)}, string_split(key, ' ')[-1]) then 'full name' else 'other' end as kind, n_mentions from pk join tt using (source_id, key)",
    "key_components": _kept(False),
    "strong_key_components": _kept(True),
    "ambiguous_families": f"with {_FTAGS} {ambiguous('tg')}",
    "family_components": f"with recursive {_FTAGS}, {merge_pairs()}, no as (select distinct mention_id as id from m), {components('e0', 'no')} select node as mention_id, label as component from cc",
    "decompose_replay": f"with {_PARENTS}, {_ITEMS}, {_NUMBERED} select {_id('p', 'k::varchar', 'text')} as claim_id, p as parent_claim_id, k as claim_index, text from nu where n <= 10",
    "decompose_errors": f"with {_PARENTS}, {_ITEMS}, {_NUMBERED}, r as (select case when substr(p, 1, 1) in ('0', '1') then 'ModelError: a call in a replay' when substr(p, 1, 1) = '2' then 'not a JSON array' when coalesce((select max(n) from nu where nu.p = pp.p), 0) > 10 then 'too many items' when not exists (select 1 from nu where nu.p = pp.p) then 'no items' end as reason from pp) select reason, count(*) as n from r where reason is not null group by 1",
    "cache_replay": f"with {_PARENTS} select count(*) filter (substr(p, 1, 1) not in ('0', '1')) as n_hits, count(*) filter (substr(p, 1, 1) in ('0', '1')) as n_misses from pp",
    "question_replay": f"with {CLAIMS}, q as (select distinct claim_id as atomic_claim_id, unnest(['Is it so that ' || claim_id || '?', 'Why?']) as text, unnest([0, 1]) as position from cl where substr(claim_id, 1, 1) not in ('0', '1')) select {_id('atomic_claim_id', 'position::varchar', 'text')} as question_id, atomic_claim_id, position, text from q",
    "fact_checks": f"with {_ASKED} select qs.claim_id, so.chunk_id, case when substr(qs.claim_id, 1, 1) between '0' and '7' then 'SUPPORTED' else 'NOT_MENTIONED' end as label, 0.75::double as confidence, (case when substr(qs.claim_id, 1, 1) between '0' and '7' then 1 else 0 end)::bigint as n_quotes from qs left join hi using (claim_id) join so on so.claim_id = qs.claim_id and so.pos = coalesce(hi.pos, 1) where (substr(qs.claim_id, 1, 1) between '0' and '7' and hi.pos is not null) or substr(qs.claim_id, 1, 1) in ('a', 'b', 'c')",
    "fact_check_errors": f"with {_ASKED}, r as (select case when substr(claim_id, 1, 1) between '0' and '7' and pos is null then 'a quote is in no evidence text' when substr(claim_id, 1, 1) in ('8', '9') then 'no quote' when substr(claim_id, 1, 1) = 'd' then 'a quote is in no evidence text' when substr(claim_id, 1, 1) = 'e' then 'unknown verdict' when substr(claim_id, 1, 1) = 'f' then 'ModelError: a call in a replay' end as reason from qs left join hi using (claim_id)) select reason, count(*) as n from r where reason is not null group by 1",
    "fact_pairs": f"with {CLAIMS}, {_SHOWN}, sh as (select so.claim_id, chunk_id, so.text as premise, cl.text as hypothesis, round(coalesce(len(list_intersect(list_distinct({_toks('cl.text')}), {_toks('so.text')}))::double / nullif(len(list_distinct({_toks('cl.text')})), 0), 0), 6) as share from so join (select distinct claim_id, text from cl) cl using (claim_id)) select claim_id as atomic_claim_id, chunk_id as evidence_chunk_id, case when share >= 0.5 then 'ENTAILMENT' when share < 0.1 then 'CONTRADICTION' else 'NEUTRAL' end as label, round(case when share < 0.1 then round(1 - share, 6) else share end, 6) as score, sha256(coalesce(nullif(premise, ''), '(no supporting quote)')) as premise_digest, length(hypothesis) as n_hypothesis from sh",
    "window_entities": f"with {_WINDOWS} select chunk_id as window_id, local_id, name, type from fit where chunk_id in (select chunk_id from gw)",
    "window_facts": f"with {_WINDOWS} select 'entity' as kind, count(*) as n_facts, count(distinct chunk_id) as n_windows from fit where chunk_id in (select chunk_id from gw) union all select 'relation', count(*), count(*) from gw union all select 'event', count(*), count(*) from gw",
    "window_errors": f"with {_WINDOWS}, r as (select case when substr(chunk_id, 1, 1) in ('0', '1') then 'ModelError: a call in a replay' when not fit then 'unfit entity' end as reason from wi) select reason, count(*) as n from r where reason is not null group by 1",
    "novel_provenance": f"with {_WQUOTES}, sp as (select kind, fact_id, source_id, w + {_raw_place('substr(t, 1, instr(t, q) - 1)')} as s, w + {_raw_place('substr(t, 1, instr(t, q) + length(q) - 2)')} + 1 as e from pl where hit) select distinct kind, fact_id, c.chunk_id from sp join c on c.source_id = sp.source_id and c.char_start < e and s < c.char_end where c.char_end > c.char_start",
    "novel_rejects": f"with {_WQUOTES} select kind, 'no quote resolves' as reason, count(*) as n from (select kind, fact_id from pl group by all having not bool_or(hit)) group by 1",
    "novel_entities": f"with recursive {_NOVEL} select entity_id, canonical_name, entity_type, n_mentions from ce",
    "novel_relations": f"with recursive {_NOVEL}, {_NOVEL_TIES} select a.entity_id as subject_entity_id, b.entity_id as object_entity_id, 'ALLY_OF' as relation_type, count(distinct rp.chunk_id) as weight from tr join ne a on a.chunk_id = tr.window_id and a.local_id = tr.s join ne b on b.chunk_id = tr.window_id and b.local_id = tr.o join rp on rp.fact_id = tr.window_id || ':' || tr.s where a.entity_id <> b.entity_id group by all",
    "novel_events": f"with recursive {_NOVEL}, {_NOVEL_TIES}, v as (select {_id(chr(39) + 'appears' + chr(39), 'ne.entity_id', 'ep.chunk_id', 'ep.char_start::varchar')} as event_id from tr join ne on ne.chunk_id = tr.window_id and ne.local_id = tr.s join ep on ep.fact_id = tr.window_id || ':' || tr.s) select event_id, 'appears' as predicate, count(*) as n_facts from v group by 1",
    "quote_anchors": f"with {CHUNKS}, mm as (select mention_id, chunk_id, evidence_quotes from raw_entity_mentions where mention_id is not null qualify row_number() over (partition by mention_id order by chunk_id nulls first, evidence_quotes nulls first) = 1), qq as (select mention_id, chunk_id, unnest(evidence_quotes) as quote, generate_subscripts(evidence_quotes, 1) as i from mm), ok as (select mention_id, i, {canon('quote')} <> '' and contains({canon('text')}, {canon('quote')}) as hit from qq join c using (chunk_id) where quote is not null), st as (select mention_id, bool_and(hit) as hit from ok group by 1) select mention_id, chunk_id from mm join c using (chunk_id) left join st using (mention_id) where coalesce(hit, true) and mention_id % 10 <> 3",
    "embedding_cache_fill": CORE["hashed_embedding_chunks"],
    "pair_cache_fill": f"with {LABELS} select * from lb",
    "vector_upsert": "select vec_id, (case when vec_id % 10 = 0 then label + 100 else label end)::bigint as label from embeddings union all select -i - 1, 7 from range(10) r(i)",
    "prompts": f"with {CLAIMS}, {CHUNKS} select 'decomposition' as kind, claim_id as id, sha256({_filled(DECOMPOSITION, most=_s('10'), text='text')}) as digest from cl union all select 'questions', claim_id, sha256({_filled(QUESTIONS, most=_s('5'), text='text')}) from cl union all select 'facts', claim_id, sha256({_filled(FACT_CHECK, text='text', passages=_s('[1] ') + ' || text || chr(10) || ' + _s('[2] ') + ' || claim_id')}) from cl union all select 'extraction', chunk_id, sha256({_filled(EXTRACTION, chapter=_s('1'), window=_s('-'), text='text')}) from c",
}
