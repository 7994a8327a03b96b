"""SQL of the same queries, written apart from the operators, for a second engine to check them by."""

from __future__ import annotations

from weftline.functions.text import FEMALE_MARRIED, FEMALE_UNMARRIED, GENERIC_TOKENS, MALE_JUNIOR, MALE_NEUTRAL, MALE_SENIOR, MENTION_STOPWORDS, PARTICLES, TITLE_PREFIXES

WS = r" \t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _clean(c: str) -> str:
    t = rf"regexp_replace({c}, '^\x{{FEFF}}', '')"
    t = rf"regexp_replace({t}, '\r\n?', chr(10), 'g')"
    t = rf"regexp_replace({t}, '[{WS}]+(\n|\z)', '\1', 'g')"
    t = rf"regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"regexp_replace({t}, '\A[\n{WS}]+|[\n{WS}]+\z', '', 'g')"


def _toks(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z0-9]+')"


def _id(*parts: str) -> str:
    return "substr(sha256(" + " || ':' || ".join(parts) + "), 1, 16)"


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


CHUNKS = "c as (select chunk_id, text, source_id, char_start, char_end from document_chunks qualify row_number() over (partition by chunk_id order by text nulls first, source_id nulls first, char_start nulls first, char_end nulls first) = 1)"
CLAIMS = "cl as (select distinct * from atomic_claims)"
STAMPED = "st as (select distinct evidence_id, atomic_claim_id, query_id, source, chunk_id, rank, recorded_at from retrieved_evidence where atomic_claim_id is not null and query_id is not null and rank is not null)"
RRF = (
    f"{STAMPED}, bs as (select atomic_claim_id, chunk_id, source, min(rank) as best, sum(1.0 / (60 + rank)) as rr, min(recorded_at) as seen from st group by all), "
    "nq as (select atomic_claim_id, chunk_id, count(distinct query_id) as n_queries from st group by all), "
    "fu as (select atomic_claim_id, chunk_id, round(sum(rr), 9) as score, min(best) as best, string_agg(source, ',' order by seen, source) as contributing_sources from bs group by all), "
    "ra as (select *, row_number() over (partition by atomic_claim_id order by score desc, chunk_id) as pos from fu join nq using (atomic_claim_id, chunk_id) qualify pos <= 10)"
)
LABELS = (
    f"{CLAIMS}, pr as (select distinct atomic_claim_id, chunk_id as evidence_chunk_id, text as premise from fused_evidence where text is not null), "
    f"sh as (select atomic_claim_id, evidence_chunk_id, round(coalesce(len(list_intersect(list_distinct({_toks('cl.text')}), {_toks('premise')}))::double / nullif(len(list_distinct({_toks('cl.text')})), 0), 0), 6) as share from pr join cl on claim_id = atomic_claim_id), "
    "lb as (select atomic_claim_id, evidence_chunk_id, case when share >= 0.5 then 'ENTAILMENT' when share < 0.1 then 'CONTRADICTION' else 'NEUTRAL' end as label, case when share < 0.1 then round(1 - share, 6) else share end as score from sh)"
)
STATUS = (
    f"{LABELS}, be as (select atomic_claim_id as claim_id, bool_or(label = 'CONTRADICTION' and score >= 0.95) as c, bool_or(label = 'ENTAILMENT' and score >= 0.5) as e from lb group by all), "
    "cs as (select claim_id, parent_claim_id, case when coalesce(c, false) then 'CONTRADICTED' when coalesce(e, false) then 'SUPPORTED' else 'UNRESOLVED' end as status from cl left join be using (claim_id) where parent_claim_id is not null)"
)
CITED = (
    f"{STATUS}, ci as (select atomic_claim_id, evidence_chunk_id, case when status = 'CONTRADICTED' then 'contradiction' else 'support' end as kind, score as nli_score from lb join cs on claim_id = atomic_claim_id "
    "where (status = 'CONTRADICTED' and label = 'CONTRADICTION' and score >= 0.95) or (status = 'SUPPORTED' and label = 'ENTAILMENT' and score >= 0.5))"
)


def _verdict(strict: bool, source: str = "cs", key: str = "parent_claim_id") -> str:
    blocked = "u > 0" if strict else "false"
    return (
        f"select {key}, c as n_contradicted, u as n_unresolved, n as n_claims, case when c > 0 then 'CONTRADICTORY' when {blocked} then 'INSUFFICIENT_EVIDENCE' else 'CONSISTENT' end as verdict, "
        f"case when c > 0 then 'rule_1_contradiction' when {blocked} then 'rule_2_unresolved' when u > 0 then 'rule_3_no_contradiction' else 'rule_3_all_supported' end as fired_rule "
        f"from (select {key}, count(*) filter (status = 'CONTRADICTED') as c, count(*) filter (status = 'UNRESOLVED') as u, count(*) as n from {source} group by {key})"
    )


GOLD = "go as (select distinct atomic_claim_id, chunk_id from fused_evidence where len(contributing_sources) >= 2)"
PAIRS = (
    "cr as (select distinct id, lower(trim(book_name)) as book, case lower(trim(label)) when 'consistent' then 'CONSISTENT' when 'contradict' then 'CONTRADICTORY' end as gold from claim_rows), "
    "bk as (select book, case when 2 * count(*) filter (gold = 'CONSISTENT') > count(*) then 'CONSISTENT' when 2 * count(*) filter (gold = 'CONSISTENT') < count(*) then 'CONTRADICTORY' else 'INSUFFICIENT_EVIDENCE' end as predicted from cr where gold is not null and book is not null group by book), "
    "pa as (select id, gold, coalesce(predicted, 'INSUFFICIENT_EVIDENCE') as predicted from cr left join bk using (book) where gold is not null)"
)
_STOP = _list(MENTION_STOPWORDS)


def _mentions(c: str) -> str:
    """Mentions of ASCII text; words of other letters are cut at them, so texts with such letters aren't compared."""
    runs = rf"regexp_extract_all({c}, '\b[A-Z][a-zA-Z]*\b(?:\s+[A-Z][a-zA-Z]*\b)*')"
    parts = rf"string_split(array_to_string(list_transform(regexp_split_to_array(r, '\s+'), lambda w: case when list_contains({_STOP}, w) then chr(10) else w end), ' '), chr(10))"
    return f"list_filter(list_transform(flatten(list_transform({runs}, lambda r: {parts})), lambda p: trim(p)), lambda m: length(m) >= 2)"


GRAPH = (
    f"{CHUNKS}, ex as (select chunk_id, source_id, char_start, unnest({_mentions('text')}) as surface, generate_subscripts({_mentions('text')}, 1) as p from c), "
    "en as (select lower(surface) as name, arg_min(surface, (source_id, char_start, chunk_id, p)) as canonical_name from ex group by 1), "
    f"ei as (select name, {_id('canonical_name', chr(39) + 'OTHER' + chr(39))} as entity_id from en), "
    "pl as (select distinct chunk_id, entity_id from ex join ei on name = lower(surface)), "
    "ed as (select a.entity_id as subject_entity_id, b.entity_id as object_entity_id, count(*) as weight from pl a join pl b on a.chunk_id = b.chunk_id and a.entity_id < b.entity_id group by all)"
)
BOTH = f"bo as (select subject_entity_id as a, object_entity_id as b, weight from ed union all select object_entity_id, subject_entity_id, weight from ed), q as (select distinct item_id as query_id, text from benchmark), h0 as (select distinct query_id, entity_id from (select query_id, lower(unnest({_mentions('text')})) as name from q) join ei using (name))"
_HOP1 = "r1 as (select query_id, b as entity_id, arg_min(weight, a) / 2.0 as gain from h0 join bo on a = entity_id group by all), n1 as (select * from r1 anti join h0 using (query_id, entity_id))"
_HOP2 = "r2 as (select query_id, b as entity_id, arg_min(weight, a) / 3.0 as gain from n1 join bo on a = entity_id group by all), n2 as (select * from r2 anti join h0 using (query_id, entity_id) anti join n1 using (query_id, entity_id))"


def _walk(hops: int) -> str:
    reached = "select query_id, entity_id, 1.0 as gain from h0 union all select query_id, entity_id, gain from n1" + (" union all select query_id, entity_id, gain from n2" if hops == 2 else "")
    return f"with {GRAPH}, {BOTH}, {_HOP1}{', ' + _HOP2 if hops == 2 else ''}, sc as (select query_id, chunk_id, round(sum(gain), 6) as raw_score from ({reached}) join pl using (entity_id) group by all) select query_id, chunk_id, raw_score from sc qualify row_number() over (partition by query_id order by raw_score desc, chunk_id) <= 10"


MENTIONS = "m as (select mention_id, source_id, local_id, name, type, char_start, chunk_id, coalesce(aliases, []) as aliases from raw_entity_mentions where mention_id is not null and source_id is not null qualify row_number() over (partition by mention_id order by source_id, local_id nulls first, name nulls first, type nulls first, char_start nulls first, chunk_id nulls first, coalesce(aliases, [])) = 1)"


def _norm(c: str) -> str:
    words = rf"list_filter(string_split(trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda w: w <> '')"
    return f"array_to_string(list_slice({words}, 1 + len(list_filter(list_transform(generate_series(1, len({words})), lambda i: len(list_filter(list_slice({words}, 1, i), lambda w: not list_contains({_list(TITLE_PREFIXES)}, w)))), lambda n: n = 0)), len({words})), ' ')"


_GENERIC = _list(GENERIC_TOKENS)
KEYS = (
    f"{MENTIONS}, sf as (select source_id, mention_id, 0 as pos, name as surface from m union all select source_id, mention_id, i, list_extract(aliases, i) from (select source_id, mention_id, aliases, unnest(generate_series(1, len(aliases))) as i from m)), "
    f"nk as (select *, {_norm('surface')} as key from sf where surface is not null), ok as (select * from nk where len(list_filter(string_split(key, ' '), lambda w: w <> '' and not list_contains({_GENERIC}, w))) > 0), "
    "kn as (select distinct source_id, key from ok where pos = 0), ks as (select * from ok where pos = 0 union all select ok.* from ok semi join kn using (source_id, key) where pos > 0)"
)
_WORDS = r"list_filter(string_split(trim(regexp_replace(lower(surface), '[^\p{L}\p{N}_]+', ' ', 'g')), ' '), lambda w: w <> '')"
_KEYED = "string_split(key, ' ')"
TAGS = (
    f"{KEYS}, pf as (select source_id, mention_id, key, pos, case when len({_WORDS}) >= len({_KEYED}) and {_WORDS}[len({_WORDS}) - len({_KEYED}) + 1:] = {_KEYED} then {_WORDS}[1:len({_WORDS}) - len({_KEYED})] else list_filter({_WORDS}, lambda w: not list_contains({_KEYED}, w)) end as prefix from ks), "
    f"te as (select *, list_sort(list_filter(prefix, lambda w: not list_contains({_list(MALE_SENIOR + MALE_JUNIOR + MALE_NEUTRAL + FEMALE_MARRIED + FEMALE_UNMARRIED)}, w) and not list_contains({_GENERIC}, w))) as telling from pf), "
    f"tt as (select source_id, mention_id, key, pos, case when len(telling) > 0 then 'other:' || array_to_string(telling, ' ') when list_has_any(prefix, {_list(MALE_JUNIOR)}) then 'male_junior' when list_has_any(prefix, {_list(MALE_SENIOR)}) then 'male_senior' when list_has_any(prefix, {_list(FEMALE_UNMARRIED)}) then 'female_unmarried' when list_has_any(prefix, {_list(FEMALE_MARRIED)}) then 'female_married' end as t from te), "
    "tg as (select source_id, key, mention_id, arg_min(t, pos) filter (t is not null) as tag from tt group by all)"
)
_CANON = rf"trim(regexp_replace(replace(translate(%s, '‘’“”–—', '''''\"\"--'), '…', '...'), '[\n{WS}]+', ' ', 'g'))".replace('\\"', '"')
QUOTES = f"{CHUNKS}, qu as (select distinct mention_id, chunk_id, unnest(evidence_quotes) as quote from raw_entity_mentions where mention_id is not null), qc as (select mention_id, quote, {_CANON % 'quote'} as q, {_CANON % 'text'} as t from qu join c using (chunk_id))"


def canon(c: str) -> str:
    """The form quotes are compared in."""
    return _CANON % c


def ambiguous(tags: str) -> str:
    """Weak keys more than one person goes by."""
    return f"select source_id, key from (select source_id, key, count(distinct tag) filter (not starts_with(tag, 'other:')) as r, count(distinct tag) filter (starts_with(tag, 'other:')) as o from {tags} where len(string_split(key, ' ')) = 1 or list_contains({_list(PARTICLES)}, string_split(key, ' ')[1]) group by all) where r >= 2 or o >= 2 or (r >= 1 and o >= 1)"


def merge_pairs() -> str:
    """e0 (u, v): mentions to merge, out of tg."""
    return (
        f"am as ({ambiguous('tg')}), hd as (select tg.* from tg semi join am using (source_id, key)), hc as (select source_id, key, tag, count(*) as n from hd where tag is not null group by all), ha as (select source_id, key, arg_min(tag, (-n, tag)) as anchor from hc group by all), "
        "hg as (select source_id, key, coalesce(tag, anchor) as g, mention_id from hd join ha using (source_id, key)), hs as (select a.source_id, a.key, b.key as key2, g, min(a.mention_id) as id from hg a join tg b on a.mention_id = b.mention_id and a.key <> b.key group by all), "
        "e0 as (select mention_id as u, min(mention_id) over (partition by source_id, key) as v from (select source_id, key, mention_id from tg anti join am using (source_id, key)) union select mention_id, min(mention_id) over (partition by source_id, key, g) from hg union select id, min(id) over (partition by source_id, key, key2) from hs)"
    )


def components(pairs: str, nodes: str) -> str:
    """cc (node, label): the smallest id each of the nodes is connected with; needs "with recursive"."""
    return (
        f"eb as (select u, v from {pairs} where u <> v union select v, u from {pairs} where u <> v union select id, id from {nodes}), cc(node, label) using key (node) as (select u, min(v) from eb group by u union "
        "select e.v, min(c.label) from cc c join eb e on e.u = c.node join recurring.cc r on r.node = e.v where c.label < r.label group by e.v)"
    )


RESOLVED = f"{TAGS}, {merge_pairs()}, no as (select mention_id as id from m), {components('e0', 'no')}"
CANONICAL = (
    f"{RESOLVED}, mc as (select m.*, label as component from m join cc on node = mention_id), nm as (select component, name, count(*) as n, min(char_start) as seen from mc group by all), n1 as (select component, name from nm qualify row_number() over (partition by component order by n desc, seen nulls first, name nulls first) = 1), n2 as (select component, sum(n)::bigint as n_mentions from nm group by 1), "
    "ty as (select component, type, count(*) as n from mc group by all), t1 as (select * from ty qualify rank() over (partition by component order by n desc) = 1), t2 as (select component, case when count(*) = 1 then min(type) else 'OTHER' end as entity_type from t1 group by 1), "
    f"ce as (select component, {_id('name', 'entity_type')} as entity_id, name as canonical_name, entity_type, n_mentions from n1 join n2 using (component) join t2 using (component)), "
    "le as (select source_id, local_id, min(entity_id) as entity_id from mc join ce using (component) group by all)"
)
SPANS = "sp as (select distinct entity_id, source_id, p.char_start as s, p.char_end as e from (select entity_id, source_id, unnest(provenance) as p from entity_records))"

_BLANK, _SOLID = rf"[\n{WS}]", rf"[^\n{WS}]"
# The headings' patterns with the blank that must follow taken in, as this engine's expressions can't look ahead.
_HEADS = (r"(?im)(^[ \t]*Chapter\s+[IVXLCDM]+\.?(?:\s|$))", r"(?im)(^[ \t]*Chapter\s+\d+\.?(?:\s|$))", r"(?im)(^[ \t]*Chapter\s+the\s+[A-Za-z]+\b)", r"(?m)(^[ \t]*(?:[IVXLCDM]+|\d+)\.\s+[A-Z])")
CHAPTERS = (
    "d as (select distinct source_id, translate(cleaned_text, chr(1), chr(2)) as t from raw_documents where length(cleaned_text) > 0), pc as ("
    + " union all ".join(f"select source_id, {i} as kind, string_split(regexp_replace(t, '{h}', chr(1) || '\\1', 'g'), chr(1)) as p from d" for i, h in enumerate(_HEADS))
    + "), bk as (select source_id, arg_min(p, kind) as p from pc where len(p) > 3 group by 1), ps as (select source_id, length(unnest(p)) as n, generate_subscripts(p, 1) - 1 as pos, length(p[1]) as pre from bk), cu as (select *, sum(n) over (partition by source_id order by pos)::bigint as e from ps), "
    "ch as (select source_id, case when pre > 0 then pos else pos - 1 end as chapter_index, e - n as char_start, e as char_end from cu where pos > 0 or n > 0)"
)


def _tokens_of(c: str) -> str:
    return f"regexp_extract_all({c}, '{_BLANK}*{_SOLID}{{1,4}}|{_BLANK}+')"


WINDOWS = (
    f"{CHAPTERS}, sp as (select source_id, chapter_index as ci, char_start as lo, substr(t, char_start + 1, char_end - char_start) as x, 6000 as most from ch join d using (source_id) union all select source_id, null, 0, t, 4000 from d where source_id not in (select source_id from ch)), "
    f"tt as (select *, {_tokens_of('x')} as toks from sp), tk as (select source_id, lo, length(unnest(toks)) as n, generate_subscripts(toks, 1) as k from tt), ta as (select source_id, lo, k, sum(n) over (partition by source_id, lo order by k)::bigint as e from tk), "
    "wi as (select source_id, ci, lo, x, most, len(toks) as total, unnest(range(0, 1 + greatest(0, ceil((len(toks) - most) / (most - 600.0))::bigint))) as w from tt), "
    "wb as (select *, least(most + w * (most - 600), total) as stop, case when w = 0 then 0 else greatest(least(most + (w - 1) * (most - 600), total) - 600, 0) end as first, w = max(w) over (partition by source_id, lo) as final from wi), "
    "wc as (select wb.*, coalesce(a.e, 0) as s, case when final then length(x) else b.e end as e from wb left join ta a on a.source_id = wb.source_id and a.lo = wb.lo and a.k = first left join ta b on b.source_id = wb.source_id and b.lo = wb.lo and b.k = stop), "
    r"cd as (select source_id, lo, w, s, e, x, most, greatest(0, e - 800) as ws, string_split(regexp_replace(substr(x, greatest(0, e - 800)::bigint + 1, (least(length(x), e + 800) - greatest(0, e - 800))::bigint), '(\n[ \t]*\n)', '\1' || chr(1), 'g'), chr(1)) as p from wc where not final), "
    "cp as (select source_id, lo, w, s, e, x, most, ws, length(unnest(p)) as n, generate_subscripts(p, 1) as i, len(p) as np from cd), cq as (select *, ws + sum(n) over (partition by source_id, lo, w order by i) as ends from cp), "
    "cr as (select source_id, lo, w, arg_min(ends, (abs(ends - e), i))::bigint as near, any_value(s) as s, any_value(x) as x, any_value(most) as most from cq where i < np group by all), "
    f"cs as (select source_id, lo, w, near from cr where near > s and len({_tokens_of('substr(x, s::bigint + 1, (near - s)::bigint)')}) <= most), "
    "wf as (select source_id, ci, lo, w, s, coalesce(near, e) as e, count(*) over (partition by source_id, lo) as n from wc left join cs using (source_id, lo, w))"
)


def _raw_place(at: str) -> str:
    """The text's position of a character of its compared form, by the word it is in."""
    k = f"(length({at}) - length(replace({at}, ' ', '')))"
    word = f"regexp_extract_all(text, '{_SOLID}+')"
    gaps = f"regexp_extract_all(text, '{_BLANK}+')"
    lead = rf"(case when regexp_matches(text, '^{_BLANK}') then 1 else 0 end)"
    start = f"(coalesce(list_sum(list_transform(list_slice({word}, 1, {k}), lambda z: length(z))), 0) + coalesce(list_sum(list_transform(list_slice({gaps}, 1, {k} + {lead}), lambda z: length(z))), 0))"
    off = f"(length({at}) - length(regexp_replace({at}, '[^ ]*$', '')))"
    inner = f"len(list_filter(range(1, length({word}[{k} + 1]) + 1), lambda i: length(replace(substr({word}[{k} + 1], 1, i), '…', '...')) <= {off}))"
    return f"({start} + {inner})::bigint"


BM25 = (
    f"{CHUNKS}, po as (select chunk_id, term, count(*) as tf, any_value(dl) as dl from (select chunk_id, unnest({_toks('text')}) as term, len({_toks('text')}) as dl from c) group by 1, 2), nn as (select count(*) as n, avg(len({_toks('text')})) as avgdl from c), "
    "ri as (select term, count(*) as df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from po, nn group by term), st as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from ri) else raw end as idf from ri)"
)

SQL = {
    "clean_text": f"select source_id, length(t) as n, sha256(t) as digest from (select source_id, {_clean('raw_text')} as t from (select distinct source_id, raw_text from raw_documents where raw_text is not null))",
    "clean_rejects": f"select coalesce(length({_clean('text')}), 0) = 0 as rejected, count(*) as n_docs from documents group by 1",
    "tokenize_counts": f"select doc_id, len({_toks('text')}) as n_tokens, len(list_distinct({_toks('text')})) as n_distinct from documents where text is not null",
    "chunk_spans": f"with d as (select distinct source_id, cleaned_text as t from raw_documents where length(cleaned_text) > 0), s as (select source_id, t, unnest(range(0, greatest(1, ceil((length(t) - 120) / 580.0)::bigint) * 580, 580)) as a from d) select {_id('source_id', 'a::varchar', 'least(a + 700, length(t))::varchar', 'substr(t, (a + 1)::bigint, 700)')} as chunk_id, source_id, a as char_start, least(a + 700, length(t)) as char_end from s",
    "content_ids": f"with {CLAIMS} select claim_id, {_id(chr(99) + 'oalesce(parent_claim_id, ' + chr(39) * 2 + ')', 'claim_index::varchar', 'text')} as made_id, {_id(chr(39) + 'source' + chr(39), 'text')} as source_claim_id, {_id('claim_id', chr(39) + 'CLAIM' + chr(39), chr(39) * 2, 'text')} as query_id from cl",
    "token_estimates": "select source, sum(greatest(1, length(text) // 4))::bigint as tokens from documents where text is not null group by source",
    "row_validation": "select case when char_end <= char_start then 'empty span' when length(text) <> char_end - char_start then 'length differs' else 'valid' end as state, count(*) as n from (select distinct chunk_id, text, char_start, char_end from document_chunks) group by 1",
    "claim_texts": "select id, 'Regarding ' || char || ': ' || content as claim_text, case lower(trim(label)) when 'consistent' then 'CONSISTENT' when 'contradict' then 'CONTRADICTORY' end as expected_verdict from (select distinct * from claim_rows) where char is not null",
    "passages_prompt": "select atomic_claim_id, sha256(string_agg('[' || i || '] ' || text, chr(10) order by i)) as digest from (select *, row_number() over (partition by atomic_claim_id order by chunk_id, text) as i from (select distinct atomic_claim_id, chunk_id, text from fused_evidence where text is not null)) group by 1",
    "parse_json_array": f"with {CLAIMS}, i as (select parent_claim_id, trim(text) as text, row_number() over (partition by parent_claim_id order by claim_index, text) as p from cl where parent_claim_id is not null), f as (select * from i where text <> '' qualify row_number() over (partition by parent_claim_id, lower(text) order by p) = 1) select parent_claim_id, row_number() over (partition by parent_claim_id order by p) - 1 as position, text from f",
    "bm25_stats": f"with {BM25} select term, df, round(idf, 6) as idf from st",
    "bm25_topk": f"with {BM25}, qt as (select query_id, term, count(*) as qtf from (select item_id as query_id, unnest({_toks('text')}) as term from (select distinct item_id, text from benchmark)) group by all), sc as (select query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as s from po join qt using (term) join st using (term), nn group by all) select query_id, chunk_id, round(coalesce(s, 0), 3) as raw_score from (select distinct item_id as query_id from benchmark) cross join c left join sc using (query_id, chunk_id) qualify row_number() over (partition by query_id order by coalesce(s, 0) desc, chunk_id) <= 10",
    "query_builder": f"with {CLAIMS}, q as (select claim_id as a, '' as qid, 'CLAIM' as origin, text from cl union all select claim_id, {_id('claim_id', chr(39) + '0' + chr(39), 't')}, 'QUESTION', t from (select claim_id, 'Is it stated that ' || regexp_replace(text, '[.!?]+$', '') || '?' as t from cl)) select distinct {_id('a', 'origin', 'qid', 'text')} as query_id, a as atomic_claim_id, origin, text from q",
    "evidence_grouped": f"with {STAMPED} select atomic_claim_id, count(*) as n, count(distinct chunk_id) as n_chunks, count(distinct query_id) as n_queries from st group by 1",
    "rrf_fusion": f"with {RRF} select atomic_claim_id, chunk_id, round(score, 6) as rrf_score, contributing_sources, n_queries from ra",
    "round_robin_fusion": f"with {STAMPED}, f as (select atomic_claim_id, chunk_id, round(1.0 / (1 + min(rank)), 9) as s from st group by all) select atomic_claim_id, chunk_id, round(s, 6) as rrf_score from f qualify row_number() over (partition by atomic_claim_id order by s desc, chunk_id) <= 10",
    "span_overlap": f"with {CHUNKS}, {SPANS} select distinct entity_id, chunk_id from sp join c on c.source_id = sp.source_id and char_start < e and s < char_end where e > s and char_end > char_start",
    "fact_provenance": f"with {CHUNKS}, {SPANS} select distinct entity_id, chunk_id, greatest(s, char_start)::bigint as char_start, least(e, char_end)::bigint as char_end from sp join c on c.source_id = sp.source_id and char_start < e and s < char_end where e > s and char_end > char_start",
    "knn_cosine": "with p as (select a.vec_id as query_id, b.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as s from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0) select query_id, vec_id, round(s, 4) as cosine from p qualify row_number() over (partition by query_id order by s desc, vec_id) <= 10",
    "hashed_embedding": f"with w as (select item_id, ('0x' || substr(sha256(w), 63, 2))::bigint % 64 as dim, count(*) as n from (select item_id, unnest({_toks('text')}) as w from (select distinct * from benchmark)) group by all), l as (select item_id, sqrt(sum(n * n)) as l from w group by 1) select item_id, dim, round(round(n / l, 9), 6) as weight from w join l using (item_id)",
    "hashed_embedding_chunks": f"with {CHUNKS}, w as (select chunk_id, ('0x' || substr(sha256(w), 63, 2))::bigint % 64 as dim, count(*) as n from (select chunk_id, unnest({_toks('text')}) as w from c) group by all), l as (select chunk_id, sqrt(sum(n * n)) as l from w group by 1) select chunk_id, dim, round(round(n / l, 9), 6) as weight from w join l using (chunk_id)",
    "embedding_cache_misses": "select count(*) as misses, sum(length(text))::bigint as characters from (select distinct text from retrieved_evidence where text is not null and text not in (select text from fused_evidence where text is not null))",
    "nli_labels": f"with {LABELS} select * from lb",
    "classify_claims": f"with {STATUS} select * from cs",
    "classified_evidence": f"with {CITED} select *, case when kind = 'contradiction' then format('NLI contradiction (score={{:.3f}}) against evidence chunk ''{{}}''.', nli_score, evidence_chunk_id) else format('NLI entailment (score={{:.3f}}) from evidence chunk ''{{}}''.', nli_score, evidence_chunk_id) end as explanation from ci",
    "verdict_strict": f"with {STATUS} {_verdict(True)}",
    "verdict_lenient": f"with {STATUS} {_verdict(False)}",
    "verdict_diff": f"with {STATUS}, a as ({_verdict(True)}), b as ({_verdict(False)}) select a.verdict as strict, b.verdict as lenient, count(*) as n from a join b using (parent_claim_id) group by all",
    "threshold_sweep": f"with {LABELS}, g as (select c / 100.0 as t_contradiction, e / 100.0 as t_entailment from range(90, 98) r1(c), range(50, 81, 5) r2(e)), b as (select atomic_claim_id as claim_id, max(score) filter (label = 'CONTRADICTION') as c, max(score) filter (label = 'ENTAILMENT') as e from lb group by 1), s as (select t_contradiction::double as t_contradiction, t_entailment::double as t_entailment, parent_claim_id, case when c >= t_contradiction then 'CONTRADICTED' when e >= t_entailment then 'SUPPORTED' else 'UNRESOLVED' end as status from cl left join b using (claim_id), g where parent_claim_id is not null), v as ({_verdict(True, 's', 't_contradiction, t_entailment, parent_claim_id')}) select t_contradiction, t_entailment, verdict, count(*) as n from v group by all",
    "score_histogram": f"with {LABELS} select label, round(floor(score * 10) / 10, 1) as bucket, count(*) as n from lb group by all",
    "confusion": f"with {PAIRS} select gold, predicted, count(*) as n from pa group by all",
    "verdict_metrics": f"with {PAIRS}, v as (select unnest(['CONSISTENT', 'CONTRADICTORY', 'INSUFFICIENT_EVIDENCE']) as verdict), k as (select verdict, count(*) filter (gold = verdict and predicted = verdict) as tp, count(*) filter (gold <> verdict and predicted = verdict) as fp, count(*) filter (gold = verdict and predicted <> verdict) as fn, count(*) filter (gold = predicted) / count(*)::double as acc from v, pa group by verdict), r as (select *, coalesce(tp / nullif(tp + fp, 0)::double, 0) as p, coalesce(tp / nullif(tp + fn, 0)::double, 0) as r from k), f as (select *, coalesce(2 * p * r / nullif(p + r, 0), 0) as f from r) select verdict, tp, fp, fn, tp + fn as support, round(p, 6) as precision, round(r, 6) as recall, round(f, 6) as f1, round(acc, 6) as accuracy, round(avg(f) over (), 6) as macro_f1 from f",
    "retrieval_metrics": f"with {RRF}, {GOLD}, n as (select atomic_claim_id, count(*) as g from go group by 1), h as (select ra.atomic_claim_id, pos, go.chunk_id is not null as hit from ra left join go on go.atomic_claim_id = ra.atomic_claim_id and go.chunk_id = ra.chunk_id), s as (select atomic_claim_id, min(pos) filter (hit) as first, count(*) filter (hit and pos <= 5) as h5, count(*) filter (hit and pos <= 10) as h10, count(*) filter (pos <= 5) as c5, count(*) filter (pos <= 10) as c10 from h group by 1) select atomic_claim_id, round(coalesce(1.0 / first, 0), 6) as mrr, round(coalesce(h5, 0) / g::double, 6) as recall_5, round(coalesce(h5 / nullif(c5, 0)::double, 0), 6) as precision_5, round(coalesce(h10, 0) / g::double, 6) as recall_10, round(coalesce(h10 / nullif(c10, 0)::double, 0), 6) as precision_10 from n left join s using (atomic_claim_id)",
    "citation_metrics": f"with {CITED}, {GOLD} select count(*) as cited, count(go.chunk_id) as grounded, round(count(go.chunk_id) / count(*)::double, 6) as citation_accuracy, round(1 - count(go.chunk_id) / count(*)::double, 6) as hallucination_rate from ci left join go on go.atomic_claim_id = ci.atomic_claim_id and go.chunk_id = ci.evidence_chunk_id",
    "stage_latency": "select event_type as stage, date_sub('millisecond', min(ts), max(ts)) as milliseconds from events group by grouping sets ((event_type), ())",
    "ablation_deltas": f"with {STAMPED}, {GOLD}, v as (select 'full' as variant, atomic_claim_id, chunk_id, rank from st union all select 'no_lexical', atomic_claim_id, chunk_id, rank from st where source <> 'LEXICAL' union all select 'no_graph', atomic_claim_id, chunk_id, rank from st where source <> 'GRAPH' union all select 'round_robin', atomic_claim_id, chunk_id, rank from st), s0 as (select variant, atomic_claim_id, chunk_id, min(rank) as mr, sum(1.0 / (60 + rank)) as sr from v group by 1, 2, 3), s as (select *, case when variant = 'round_robin' then round(1.0 / (1 + mr), 9) else round(sr, 9) end as s from s0), t as (select * from s qualify row_number() over (partition by variant, atomic_claim_id order by s desc, chunk_id) <= 10), n as (select atomic_claim_id, count(*) as g from go group by 1), vg as (select variant, atomic_claim_id, chunk_id, g from (select distinct variant from v) cross join go join n using (atomic_claim_id)), rr as (select vg.variant, vg.atomic_claim_id, round(count(t.chunk_id) / any_value(g)::double, 6) as rec from vg left join t on t.variant = vg.variant and t.atomic_claim_id = vg.atomic_claim_id and t.chunk_id = vg.chunk_id group by 1, 2), a as (select variant, avg(rec) as av from rr group by 1) select variant, round(av, 5) as recall_10, round((select av from a where variant = 'full') - av, 5) as delta from a",
    "retrieval_coverage": f"with {RRF}, g as (select atomic_claim_id, count(*) filter (contributing_sources like '%GRAPH%') as g, count(*) filter (contributing_sources = 'GRAPH') as o from ra group by 1) select count(*) as claims, count(*) filter (g > 0) as with_graph, count(*) filter (o > 0) as graph_only from g",
    "order_statistics": f"with {CHUNKS}, l as (select list_sort(list(length(text)::bigint)) as v from c) select len(v) as n, v[1] as least, v[floor(0.5 * len(v))::bigint + 1] as median, v[floor(0.95 * len(v))::bigint + 1] as p95, v[len(v)] as most, round(list_avg(v), 6) as mean from l",
    "failure_modes": f"with {STATUS}, a as (select atomic_claim_id as claim_id, bool_or(label <> 'NEUTRAL') as hit from lb group by 1) select case when status <> 'UNRESOLVED' then 'resolved' when hit is null then 'retrieval' when not hit then 'nli' else 'threshold' end as mode, count(*) as n_claims from cs left join a using (claim_id) group by 1",
    "ledger_fk_violations": f"with {CLAIMS} select 'evidence has a claim' as constraint, count(*) as violations from retrieved_evidence e where not exists (select 1 from cl where claim_id = e.atomic_claim_id) union all select 'fused evidence has a claim', count(*) from fused_evidence f where not exists (select 1 from cl where claim_id = f.atomic_claim_id) union all select 'fused evidence was retrieved', count(*) from fused_evidence f where not exists (select 1 from retrieved_evidence e where e.atomic_claim_id = f.atomic_claim_id and e.chunk_id = f.chunk_id) union all select 'evidence has a chunk', count(*) from retrieved_evidence e where not exists (select 1 from document_chunks c where c.chunk_id = e.chunk_id) union all select 'query has a claim', 0",
    "ledger_write_once": "select 'claim' as constraint, count(*) as violations from (select claim_id from atomic_claims group by 1 having count(*) > 1) union all select 'evidence', count(*) from (select evidence_id from retrieved_evidence group by 1 having count(*) > 1) union all select 'fused evidence', count(*) from (select atomic_claim_id, chunk_id from fused_evidence group by 1, 2 having count(*) > 1)",
    "ledger_fingerprint": f"with {STATUS}, {STAMPED}, v as ({_verdict(True)}), p as (select parent_claim_id, 0 as part, claim_id as item from cl where parent_claim_id is not null union all select parent_claim_id, 1, evidence_id from st join cl on claim_id = atomic_claim_id where parent_claim_id is not null union all select parent_claim_id, 2, verdict from v), j as (select parent_claim_id, part, string_agg(item, ',' order by item) as t from p group by all) select parent_claim_id, substr(sha256(string_agg(t, '|' order by part)), 1, 16) as fingerprint from j group by 1",
    "checkpoint_resume": "select distinct claim_id from atomic_claims where claim_id not in (select atomic_claim_id from fused_evidence where atomic_claim_id is not null)",
    "cooccurrence_edges": f"with {GRAPH} select * from ed",
    "graph_topology": f"with recursive {GRAPH}, e0 as (select subject_entity_id as u, object_entity_id as v from ed), no as (select entity_id as id from ei), {components('e0', 'no')}, n as (select (select count(*) from ei) as n, (select count(*) from ed) as m, (select count(distinct label) from cc) as k) select n as n_entities, m as n_relations, k as n_components, round(2.0 * m / (n * (n - 1))::double, 9) as density, round(2.0 * m / n::double, 6) as average_degree from n",
    "graph_bfs_1hop": _walk(1),
    "graph_bfs_2hop": _walk(2),
    "mentions": f"with b as (select distinct item_id, text from benchmark), x as (select item_id, unnest({_mentions('text')}) as mention, generate_subscripts({_mentions('text')}, 1) as p from b), f as (select item_id, mention, min(p) as p from x group by all) select item_id, row_number() over (partition by item_id order by p) - 1 as pos, mention from f",
    "relation_collapse": "with r0 as (select 'P' || l_partkey as a, 'S' || l_suppkey as b, l_returnflag as t, count(*) as w from lineitem group by all), r as (select case when t = 'R' then b else a end as s, case when t = 'R' then a else b end as o, t, w from r0) select arg_min(s, (t, s, o)) as subject, arg_min(o, (t, s, o)) as object, min(t) as relation_type, sum(w)::bigint as weight from r group by least(s, o), greatest(s, o)",
    "normalize_names": f"select name, k as normalised, len(list_filter(string_split(k, ' '), lambda w: w <> '' and not list_contains({_GENERIC}, w))) = 0 as generic, len(string_split(k, ' ')) = 1 or list_contains({_list(PARTICLES)}, string_split(k, ' ')[1]) as weak from (select name, {_norm('name')} as k from (select distinct name from raw_entity_mentions where name is not null))",
    "merge_keys": f"with {KEYS} select distinct mention_id, key from ks",
    "qualifier_tags": f"with {TAGS} select * from tg",
    "ambiguous_keys": f"with {TAGS} {ambiguous('tg')}",
    "er_components": f"with recursive {RESOLVED} select node as mention_id, label as component from cc",
    "canonical_entities": f"with recursive {CANONICAL} select * from ce",
    "local_entities": f"with recursive {CANONICAL} select * from le",
    "relations_resolved": f"with recursive {CANONICAL}, nx as (select *, lead(local_id) over (partition by source_id order by char_start nulls first, mention_id) as o from m) select a.entity_id as subject_entity_id, b.entity_id as object_entity_id, type as relation_type, count(distinct chunk_id) as weight from nx join le a on a.source_id = nx.source_id and a.local_id = nx.local_id join le b on b.source_id = nx.source_id and b.local_id = nx.o where a.entity_id <> b.entity_id group by all",
    "quote_exact": f"with {QUOTES} select mention_id, sha256(quote) as quote_digest, case when length(q) > 0 then instr(t, q) - 1 end as canon_start, case when length(q) > 0 then (length(t) - length(replace(t, q, ''))) // length(q) end as occurrences from qc",
    "chapter_spans": f"with {CHAPTERS} select source_id, chapter_index, char_start, char_end from ch",
    "extraction_windows": f"with {WINDOWS} select source_id, (case when ci is null then w else ci end)::integer as chapter_index, (case when ci is not null and n > 1 then w end)::integer as window_index, (lo + s)::bigint as char_start, (lo + e)::bigint as char_end from wf",
    "quote_places": f"with {QUOTES.replace('select mention_id, quote, ', 'select mention_id, chunk_id, text, quote, ')}, qp as (select *, length(q) > 0 and instr(t, q) > 0 as hit from qc) select mention_id, chunk_id, case when hit then 'EXACT' else 'FAILED' end as tier, case when hit then {_raw_place('substr(t, 1, instr(t, q) - 1)')} end as char_start, case when hit then {_raw_place('substr(t, 1, instr(t, q) + length(q) - 2)')} + 1 end as char_end, hit and (length(t) - length(replace(t, q, ''))) // greatest(length(q), 1) > 1 as ambiguous from qp",
    "quote_trust_boundary": f"with {QUOTES} select verified, count(*) as n_mentions from (select mention_id, bool_and(length(q) > 0 and instr(t, q) > 0) as verified from qc group by 1) group by 1",
    "graph_fingerprint": "select source_id, sha256(string_agg('E:' || entity_id || ':' || canonical_name || ':' || entity_type, chr(10) order by entity_id, canonical_name, entity_type)) as fingerprint from (select distinct source_id, entity_id, canonical_name, entity_type from entity_records) group by 1",
    "nli_premises": "select mention_id, sha256(coalesce(nullif(array_to_string(q, ' '), ''), '(no supporting quote)')) as premise_digest from (select mention_id, min(evidence_quotes) as q from raw_entity_mentions where mention_id is not null group by 1)",
    "stratified_sample": "with c as (select distinct id::bigint as id, split, label from claim_rows), s0 as (select split, label, count(*) as g from c group by 1, 2), s as (select *, row_number() over (order by split nulls first, label nulls first) as i from s0), q as (select *, round_even(100.0 * g / (select sum(g) from s), 0)::bigint as q, (select count(*) from s) as m from s), f as (select split, label, case when i = m then greatest(100 - coalesce(sum(q) over (order by i rows between unbounded preceding and 1 preceding), 0), 0) else q end as q from q) select id from (select id, split, label, row_number() over (partition by split, label order by id) as p from c) a join f on a.split is not distinct from f.split and a.label is not distinct from f.label where p <= q",
    "graph_entry": f"with {GRAPH}, {BOTH} select query_id, entity_id from h0",
    "label_map": f"with {LABELS} select label, case label when 'ENTAILMENT' then 'SUPPORTED' when 'CONTRADICTION' then 'CONTRADICTED' else 'NOT_MENTIONED' end as fact_label, count(*) as n from lb group by label",
    "parse_questions": f"with {CLAIMS}, q as (select claim_id as atomic_claim_id, 'Is it stated that ' || regexp_replace(text, '[.!?]+$', '') || '?' as t from cl), m as (select atomic_claim_id, trim(min(t)) as text from q group by 1) select atomic_claim_id, 0::bigint as position, text, {_id('atomic_claim_id', chr(39) + '0' + chr(39), 'text')} as question_id from m",
    "fact_verdicts": f"with {CITED} select atomic_claim_id, kind, count(*) as n, max(nli_score) as best, arg_min(evidence_chunk_id, (-nli_score, evidence_chunk_id)) as chunk_id from ci group by all",
}
SQL["macro_averages"] = f"select count(*) as n_claims, round(avg(mrr), 5) as mrr, round(avg(recall_5), 5) as recall_5, round(avg(precision_5), 5) as precision_5, round(avg(recall_10), 5) as recall_10, round(avg(precision_10), 5) as precision_10 from ({SQL['retrieval_metrics']})"
SQL["retrieve_stamped"] = (
    f"with {BM25}, qt as (select query_id, term, count(*) as qtf from (select item_id as query_id, unnest({_toks('text')}) as term from (select distinct item_id, text from benchmark)) group by all), "
    "sc as (select query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as s from po join qt using (term) join st using (term), nn group by all), "
    "rk as (select query_id::varchar as q, chunk_id, row_number() over (partition by query_id order by coalesce(s, 0) desc, chunk_id) as rank from (select distinct item_id as query_id from benchmark) cross join c left join sc using (query_id, chunk_id) qualify rank <= 10) "
    f"select {_id('q', chr(39) + 'LEXICAL' + chr(39), 'chunk_id', 'rank::varchar')} as evidence_id, q as atomic_claim_id, chunk_id, rank from rk"
)

_VERIFY = (
    "d as (select distinct source_id, cleaned_text as t from raw_documents where length(cleaned_text) > 0), s0 as (select source_id, t, unnest(range(0, greatest(1, ceil((length(t) - 120) / 580.0)::bigint) * 580, 580)) as a from d), "
    f"c as (select {_id('source_id', 'a::varchar', 'least(a + 700, length(t))::varchar', 'substr(t, (a + 1)::bigint, 700)')} as chunk_id, source_id, a as char_start, substr(t, (a + 1)::bigint, 700) as text from s0), "
    f"cm as (select distinct claim_id, text from atomic_claims where text is not null), qq as (select claim_id as a, '' as qid, 'CLAIM' as origin, text from cm union all select claim_id, {_id('claim_id', chr(39) + '0' + chr(39), 't')}, 'QUESTION', t from (select claim_id, 'Is it stated that ' || regexp_replace(text, '[.!?]+$', '') || '?' as t from cm)), "
    f"q as (select distinct {_id('a', 'origin', 'qid', 'text')} as query_id, a as atomic_claim_id, text from qq)"
)
_SEARCHED = (
    BM25.replace(CHUNKS + ", ", "")
    + f", qt as (select query_id, term, count(*) as qtf from (select query_id, unnest({_toks('text')}) as term from q) group by all), bs as (select query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as s from po join qt using (term) join st using (term), nn group by all), "
    "lx as (select query_id, chunk_id, row_number() over (partition by query_id order by coalesce(s, 0) desc, chunk_id) as rank from (select query_id from q) cross join c left join bs using (query_id, chunk_id) qualify rank <= 10), "
    f"dw as (select chunk_id as id, ('0x' || substr(sha256(w), 63, 2))::bigint % 64 as dim, count(*) as n from (select chunk_id, unnest({_toks('text')}) as w from c) group by all union all select query_id, ('0x' || substr(sha256(w), 63, 2))::bigint % 64, count(*) from (select query_id, unnest({_toks('text')}) as w from q) group by all), "
    "dl as (select id, sqrt(sum(n * n)) as l from dw group by 1), dv as (select id, dim, round(n / l, 9) as w from dw join dl using (id)), dn as (select id, sqrt(sum(w * w)) as l from dv group by 1), "
    "dp as (select a.id as query_id, b.id as chunk_id, sum(a.w * b.w) as dot from dv a join dv b using (dim) where a.id in (select query_id from q) and b.id in (select chunk_id from c) group by all), "
    "pr as (select query_id, chunk_id, row_number() over (partition by query_id order by round(coalesce(dot, 0) / (x.l * y.l), 6) desc, chunk_id) as rank from (select query_id from q) cross join (select chunk_id from c) left join dp using (query_id, chunk_id) join dn x on x.id = query_id join dn y on y.id = chunk_id qualify rank <= 10), "
    + GRAPH.replace(CHUNKS + ", ", "")
    + ", "
    + BOTH.replace(", q as (select distinct item_id as query_id, text from benchmark)", "")
    + f", {_HOP1}, gs as (select query_id, chunk_id, round(sum(gain), 6) as s from (select query_id, entity_id, 1.0 as gain from h0 union all select query_id, entity_id, gain from n1) join pl using (entity_id) group by all), gx as (select query_id, chunk_id, row_number() over (partition by query_id order by s desc, chunk_id) as rank from gs qualify rank <= 10)"
)
SQL["verify_claims"] = (
    f"with {_VERIFY}, {_SEARCHED}, hi as (select * from lx union all select * from pr union all select * from gx), f0 as (select atomic_claim_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) as s from hi join q using (query_id) group by all), fu as (select * from f0 qualify row_number() over (partition by atomic_claim_id order by s desc, chunk_id) <= 10), "
    f"sh as (select atomic_claim_id, round(coalesce(len(list_intersect(list_distinct({_toks('cm.text')}), {_toks('c.text')}))::double / nullif(len(list_distinct({_toks('cm.text')})), 0), 0), 6) as share from fu join c using (chunk_id) join cm on claim_id = atomic_claim_id), "
    "cl as (select claim_id, bool_or(share < 0.1 and round(1 - share, 6) >= 0.95) as c, bool_or(share >= 0.5) as e, count(share) as n from cm left join sh on atomic_claim_id = claim_id group by 1) "
    "select claim_id, case when coalesce(c, false) then 'CONTRADICTORY' when coalesce(e, false) then 'CONSISTENT' else 'INSUFFICIENT_EVIDENCE' end as verdict, case when coalesce(c, false) then 'rule_1_contradiction' when coalesce(e, false) then 'rule_3_all_supported' else 'rule_2_unresolved' end as fired_rule, n as n_evidence from cl"
)
