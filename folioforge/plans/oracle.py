"""SQL of the catalogue's queries, for a second engine over the same tables."""

from __future__ import annotations

WS = r"[\t\n\x0b\f\r ]"
STRIP = r"(^[\t\n\x0b\f\r ]+|[\t\n\x0b\f\r ]+$)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{STRIP}', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' ')"


def unescape(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&#160;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def norm(x: str) -> str:
    return collapse(unescape(f"coalesce({x}, '')"))


# --- pieces shared by several queries

# Fixed values, said again for the second engine: the keywords of headings, and the prefixes of each level in the order in which they are tried.
KEYWORDS = "ΜΕΡΟΣ|ΚΕΦΑΛΑΙΟ|ΑΡΘΡΟ|ΠΑΡΑΡΤΗΜΑ|ΕΝΟΤΗΤΑ|ΠΙΝΑΚΑΣ|PART|CHAPTER|ARTICLE|SECTION|SUBSECTION|ANNEX|APPENDIX|TABLE|FIGURE"
LETTERS = "list_filter(string_split(regexp_replace(t, '[^\\p{L}]', '', 'g'), ''), lambda c: c <> '')"
WORDS = f"len(list_filter(regexp_split_to_array(t, '{WS}+'), lambda w: w <> ''))"
IS_HEADING = f"""(length(t) between 3 and 180 and not contains(t, '|') and (regexp_matches(t, '(?i)^({KEYWORDS})([^\\p{{L}}\\p{{N}}_]|$)')
  or (len({LETTERS}) > 0 and len(list_filter({LETTERS}, lambda c: upper(c) = c)) >= 0.85 * len({LETTERS}) and {WORDS} <= 16 and not (t like '%.' and {WORDS} > 4))))"""
GUESS = """(case when starts_with(upper(t), 'ΜΕΡΟΣ') then 1 when starts_with(upper(t), 'ΚΕΦΑΛΑΙΟ') then 2 when starts_with(upper(t), 'ΑΡΘΡΟ') then 3
  when starts_with(upper(t), 'ΠΑΡΑΡΤΗΜΑ') then 1 when starts_with(upper(t), 'PART') or starts_with(upper(t), 'ANNEX') or starts_with(upper(t), 'APPENDIX') then 1
  when starts_with(upper(t), 'CHAPTER') then 2 when starts_with(upper(t), 'ARTICLE') or starts_with(upper(t), 'SECTION') or starts_with(upper(t), 'SUBSECTION') then 3
  when starts_with(upper(t), 'TABLE') or starts_with(upper(t), 'FIGURE') then 4 else 2 end)"""
ITEMS = f"list_filter(coalesce(list_items, []), lambda x: x is not null and x <> '')"
BODY = f"(case when block_type = 'list' then array_to_string(list_transform({ITEMS}, lambda x: '- ' || {collapse(unescape('x'))}), chr(10)) when block_type = 'code' then '' else t end)"
LAID = f"""raw as (select *, {norm('text')} t, page_idx + 1 page from blocks where doc_key is not null and coalesce(block_type, '') not in
  ('header','footer','page_header','page_footer','page_number','page_aside_text','aside_text')),
b as (select *, {BODY} body_text, case when t = '' then null when coalesce(text_level, 0) > 0 then least(text_level, 6) when {IS_HEADING} then {GUESS} end lv from raw),
b1 as (select *, lv is null and block_type in ('table','chart','image','seal') brk, sum(case when lv is not null then 1 else 0 end) over w i,
  sum(case when lv is not null or block_type in ('table','chart','image','seal') then 1 else 0 end) over w seg from b window w as (partition by doc_key order by ord)),
b2 as (select *, i + least(0, coalesce(min(case when lv is not null then lv - i end) over (partition by doc_key order by ord), 0)) depth from b1),
laid as (select *, [{', '.join(f"last_value(case when lv is not null and depth = {k} then t end ignore nulls) over (partition by doc_key order by ord rows between unbounded preceding and current row)" for k in range(1, 7))}][1:depth::int] path from b2)"""
TOKENS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda x: x <> '')"
INDEX = f"""tok as (select doc_id, {TOKENS} t from documents where doc_id is not null),
lengths as (select doc_id, len(t) dl from tok), post as (select doc_id, term, count(*) tf from (select doc_id, unnest(t) term from tok) group by all),
corpus as (select count(*) n, avg(dl) avgdl from lengths), raw as (select term, count(*) df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) raw from post, corpus group by term),
terms as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end idf from raw)"""
QUERIES = "q as (select item_id query_id, text from benchmark where item_id % 50 = 0 and text is not null)"


def bm25(queries: str, k: int, name: str) -> str:
    """CTEs that end in `name` (query_id, doc_id, score, rank)."""
    return f"""qt{name} as (select query_id, term, count(*) qf from (select query_id, unnest({TOKENS}) term from {queries}) group by all),
sc{name} as (select query_id, doc_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) score
  from qt{name} join terms using (term) join post using (term) join lengths using (doc_id), corpus group by all),
{name} as (select query_id, doc_id, score, (r - 1)::int rank from (select query_id, doc_id, coalesce(score, 0) score, row_number() over (partition by query_id order by coalesce(score, 0) desc, doc_id) r
  from (select distinct query_id from {queries}) cross join (select doc_id from lengths) left join sc{name} using (query_id, doc_id)) where r <= {k})"""


def fuse(v: str, x: str, key: str, k: int = 40) -> str:
    return f"""(select {key}, doc_id, round(score, 9) score, (row_number() over (partition by {key} order by score desc, first, doc_id) - 1)::int rank from
  (select {key}, doc_id, round(coalesce(0.55 / (a.rank + 60), 0) + coalesce(0.44999999999999996 / (b.rank + 60), 0), 12) score, coalesce(a.rank, 1048576 + b.rank) first from {v} a full join {x} b using ({key}, doc_id)) qualify rank < {k})"""


L2 = "round(list_distance(e.embedding::double[], q.embedding::double[]), 6)"
ANSWERS = f"""{INDEX}, {QUERIES}, q1 as (select * from q where query_id = (select min(query_id) from q)), {bm25('q1', 15, 'top')},
a as (select distinct conv_id || '/' || turn answer_id, text answer from conversations where msg_role = 'assistant' and text is not null),
ctx as (select rank + 1 number, coalesce(path, source, '') label, {strip("coalesce(text, '')")} quote from top join documents using (doc_id)),
nums as (select answer_id, n::int number, p from (select answer_id, unnest(l) n, generate_subscripts(l, 1) p from (select answer_id, regexp_extract_all(answer, '\\[S([0-9]{{1,9}})\\]', 1) l from a))),
firsts as (select answer_id, number, min(p) p from nums group by all),
entries as (select answer_id, row_number() over (partition by answer_id order by p) position, number, label, quote from firsts join ctx using (number))"""
LABEL = "case when coalesce(page_start, 0) <> 0 and coalesce(page_end, 0) <> 0 and page_start <> page_end then 'pages ' || page_start || '-' || page_end when coalesce(page_start, 0) <> 0 then 'page ' || page_start else 'page unknown' end"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"

SQL: dict[str, str] = {
    "normalize_text": f"select doc_id, {norm('text')} norm, {collapse(chr(39).join(['replace(coalesce(text, ', '', '), chr(0), ', ' ', ')']))} clean from documents",
    "strip_html": f"select id, {norm('regexp_replace(text, ' + chr(39) + '<[^>]+>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} plain from (select distinct id, text from chunks where id is not null)",
    "safe_filename": r"""select doc_id, case when title is null then null when trim(regexp_replace(title, '[^\p{L}\p{N}._-]', '_', 'g'), '._') = '' then 'document_' || substr(sha1(title), 1, 12)
        else substr(trim(regexp_replace(regexp_replace(title, '[^\p{L}\p{N}._-]', '_', 'g'), '_+', '_', 'g'), '._'), 1, 160) end as name,
        trim(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '_') as key, string_split(path, '/')[-1] base from documents""",
    "text_helpers": f"""select doc_id, replace(substr({strip('text')}, 1, 400), chr(10), ' ') snippet, (case when {strip("coalesce(text, '')")} = '' then 1 else length(text) end)::int embed_chars,
        case when lang = 'en' then 'true' else 'false' end english, coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as int), -1) source_no, sha1(text) digest from documents""",
    "split_paths": f"""select doc_key, (row_number() over (partition by doc_key, p order by k) - 1)::int pos, x path from (select doc_key, p, trim(unnest(l), ' ') x, generate_subscripts(l, 1) k from
        (select distinct doc_key, concat_ws(';', markdown_path, chunks_path, ' ', images_dir) p, regexp_split_to_array(concat_ws(';', markdown_path, chunks_path, ' ', images_dir), '[;,:]') l from manifest)) where x <> ''""",
    "key_values": "select source, channel as key, publisher as value from sources",
    "load_chunks": f"""select distinct id, {strip("case when coalesce(text, '') <> '' then text else content end")} as text, 'corpus' index_name from chunks
        where {strip("case when coalesce(text, '') <> '' then text else content end")} <> ''""",
    "detect_backend": """select source, coalesce(min_by(b, id) filter (b is not null), 'unknown') backend from (select coalesce(source_pdf, source_html) source, id,
        case when lower(parser) = 'mineru' then 'mineru' when lower(ingest_backend) like '%pypdf%' or lower(ingest_backend) like '%simple%' then 'simple' end b from chunks where id is not null) group by source""",
    "best_candidate": """select doc_key, path, score::int score from (select *, row_number() over (partition by doc_key order by score desc, length(path) desc, path) k, count(*) over (partition by doc_key) n from
        (select doc_key, path, (contains(string_split(lower(path), '/')[-1], s)::int * 100 + contains(lower(path), s)::int * 80 + contains(lower(path), lower(doc_key))::int * 40
        + (string_split(lower(path), '/')[-1] = s || '.md')::int * 30 + ends_with(lower(path), '_content_list_v2.json')::int * 10) score from
        (select doc_key, lower(regexp_replace(f, '\\.[a-z]+$', '')) s, unnest(ps) path from (select distinct doc_key, coalesce(source_pdf, source_html) f, [markdown_path, content_list_path, chunks_path] ps from manifest)) where path is not null))
        where k = 1 and (score > 0 or n = 1)""",
    "side_files": """with c as (select distinct id, chunk_type, table_csv_path p, text from chunks where id is not null), f as (select p, 'file of ' || min(id) md from c where p is not null group by p)
        select id, chunk_type, case when chunk_type = 'table' and md is not null then md else text end as text from c left join f using (p)""",
    "flat_styling": "select distinct id, styling['color'] css_color, styling['fontFamily'] css_font, styling['backgroundColor'] css_background from chunks where id is not null and styling is not null",
    "metadata_filter": "select distinct id, source_pdf, page_start, table_number from chunks where is_table and page_start between 2 and 9 and chunk_type = 'table' and id is not null",
    "redelivered": "select id, max(ingested_at) ingested_at, count(*) deliveries from chunks where id is not null group by id",
    "block_texts": f"""with {LAID} select doc_key, ord, coalesce(block_type, '') block_type, page, body_text,
        {collapse("array_to_string(list_transform(list_filter(list_concat(coalesce(table_caption, []), coalesce(image_caption, [])), lambda x: x is not null and x <> ''), lambda x: " + collapse(unescape('x')) + "), ' ')")} caption,
        coalesce(regexp_matches({strip('img_path')}, '(?i)[^/]\\.(jpe?g|png|webp|bmp|gif|tiff?)$'), false) is_image from laid""",
    "nested_blocks": f"""select doc_key || '#' || ord doc_key, case when block_type = 'list' then 'list' else 'text' end block_type, 0 page_idx, case when block_type = 'list' then '' else coalesce(text, '') end as text,
        text_level, case when block_type = 'list' then array_to_string(list_transform({ITEMS}, lambda x: {collapse(unescape('x'))}), '|') else '' end items from blocks where block_type in ('text', 'list')""",
    "markdown_blocks": f"""with c as (select distinct id doc_key, case when regexp_matches(text, '[^\\t\\n\\x0b\\f\\r ]') then text else content end as text from chunks where id is not null and chunk_type = 'chapter_text'),
        l as (select doc_key, unnest(ls) raw, generate_subscripts(ls, 1) - 1 n from (select doc_key, regexp_split_to_array(text, '{LINE_END}') ls from c)),
        k as (select doc_key, n, regexp_replace(raw, '{WS}+$', '') line from l),
        k1 as (select *, case when regexp_matches(line, '^#{{1,6}}{WS}+\\S') then 'heading' when line = '' then 'blank' when contains(line, '|') then 'table' else 'text' end kind from k),
        k2 as (select *, case when kind = 'heading' or kind is distinct from lag(kind) over (partition by doc_key order by n) then 1 else 0 end s from k1),
        k3 as (select *, sum(s) over (partition by doc_key order by n) run from k2),
        g as (select doc_key, run, any_value(kind) kind, min(n)::int ord, {strip("string_agg(line, chr(10) order by n)")} t from k3 where kind <> 'blank' group by all)
        select doc_key, ord, case when kind = 'table' then 'table' else 'text' end block_type, case when kind = 'heading' then regexp_extract(t, '^(#{{1,6}}){WS}+(.+)$', 2) when kind = 'text' then t end as text,
        case when kind = 'heading' then length(regexp_extract(t, '^(#{{1,6}})', 1))::int end text_level, case when kind = 'table' then t end table_body from g""",
    "looks_like_heading": f"with x as (select doc_key, ord, {norm('text')} t from blocks where text is not null) select doc_key, ord, {IS_HEADING} is_heading, {GUESS}::int guessed from x",
    "heading_path": f"with {LAID} select doc_key, ord, lv::int as level, depth::int depth, array_to_string(path, ' / ') path from laid",
    "chapter_chunks": f"""with {LAID}, r as (select * from laid where not brk and (lv is not null or body_text <> '')),
        g as (select doc_key, seg, min(ord) ord, string_agg(body_text, chr(10) || chr(10) order by ord) filter (lv is null) body, max(t) filter (lv is not null) own, max(lv) lv, any_value(path) path, any_value(depth) depth,
          arg_min(page, ord) filter (page is not null) page_start, arg_max(page, ord) filter (page is not null) page_end from r group by all)
        select doc_key, ord, {strip("repeat('#', coalesce(lv, least(greatest(depth, 1), 6))::int) || ' ' || coalesce(own, path[-1], doc_key) || chr(10) || chr(10) || body")} as text,
        array_to_string(case when len(path) > 0 then path else [coalesce(own, doc_key)] end, ' / ') path, coalesce(own, path[-1], doc_key) chapter_title, page_start::int page_start, page_end::int page_end from g where body is not null""",
    "image_chunks": f"""with {LAID}, i as (select *, {collapse("array_to_string(list_transform(list_filter(coalesce(image_caption, []), lambda x: x is not null and x <> ''), lambda x: " + collapse(unescape('x')) + "), ' ')")} cap from laid
        where lv is null and block_type in ('image', 'seal') and {strip("coalesce(img_path, '')")} <> '')
        select doc_key, ord, 'Caption: ' || cap as text, page::int page_start, {strip('img_path')} image_path from i where cap <> ''""",
    "table_grids": f"""with c as (select doc_key, ord, list_transform(regexp_extract_all(table_body, '<tr>(.*?)</tr>', 1), lambda r: list_transform(regexp_extract_all(r, '<td>(.*?)</td>', 1), lambda x: {norm('x')})) g from blocks where table_body is not null),
        f as (select doc_key, ord, list_filter(g, lambda r: array_to_string(r, '') <> '') g from c), m as (select *, list_max(list_transform(g, lambda r: len(r))) w from f),
        p as (select doc_key, ord, list_transform(g, lambda r: '| ' || array_to_string(list_transform(list_resize(r, w, ''), lambda x: replace(x, '|', chr(92) || '|')), ' | ') || ' |') l, w from m)
        select doc_key, ord, len(l)::int n_rows, coalesce(array_to_string(list_concat(list_concat(l[1:1], ['| ' || array_to_string(list_transform(range(w), lambda x: '---'), ' | ') || ' |']), l[2:]), chr(10)), '') markdown from p""",
    "markdown_table_rows": """select s_suppkey, unnest([0, 1])::int row_no, unnest(['key: ' || s_suppkey || chr(10) || 'name: ' || s_name || chr(10) || 'Column: x', 'key: a' || chr(10) || 'name: ' || chr(10) || 'Column: ']) as text from supplier""",
    "chunk_sliding_window": f"""with d as (select doc_id::varchar stem, {collapse(chr(39).join(['replace(coalesce(text, ', '', '), chr(0), ', ' ', ')']))} t from documents),
        w as (select stem, t, unnest(range(0, case when length(t) <= 1800 then 1 else ceil((length(t) - 1800) / 1550.0)::bigint + 1 end)) i from d where t <> '')
        select stem, 1 page, i::int chunk_index, stem || '-p1-c' || i id, {strip('substr(t, i * 1550 + 1, 1800)')} as text from w where {strip('substr(t, i * 1550 + 1, 1800)')} <> ''""",
    "page_windows": f"""with d as (select doc_key || '#' || ord stem, page_idx + 1 page, {collapse(chr(39).join(['replace(coalesce(text, ', '', '), chr(0), ', ' ', ')']))} t from blocks where text is not null and page_idx >= 1 and page_idx < 5),
        w as (select stem, page, t, unnest(range(0, case when length(t) <= 600 then 1 else ceil((length(t) - 600) / 500.0)::bigint + 1 end)) i from d where t <> '')
        select stem, page::int page, i::int chunk_index, stem || '-p' || page || '-c' || i id, {strip('substr(t, i * 500 + 1, 600)')} as text from w where {strip('substr(t, i * 500 + 1, 600)')} <> ''""",
    "chunk_references": """select distinct id, array_to_string(list_filter(['pdf:' || coalesce(source_pdf_path, '') || ':', case when table_csv_path <> '' then 'table_csv:' || table_csv_path || ':' end,
        case when image_path <> '' then 'image:' || image_path || ':' end, case when table_number is not null then 'table::' || table_number end], lambda x: x is not null), ' ') refs from chunks where id is not null and source_pdf is not null""",
    "manifest": """select source, count(*) chunk_count, count(distinct case when t in ('table', 'table_row') then n end) table_count, count(*) filter (t = 'image') image_count from
        (select coalesce(source_pdf, source_html) source, id, max(chunk_type) t, max(table_number) n from chunks where id is not null group by all) group by source""",
    "term_statistics": f"with {INDEX} select term, df, round(idf, 6) idf from terms",
    "bm25_topk": f"with {INDEX}, {QUERIES}, {bm25('q', 40, 'r')} select query_id, doc_id, score, rank from r",
    "vector_topk": f"""select query_id, vec_id, score, (r - 1)::int rank from (select q.vec_id query_id, e.vec_id, {L2} score, row_number() over (partition by q.vec_id order by {L2}, e.vec_id) r
        from embeddings e, embeddings q where q.vec_id % 50 = 0) where r <= 40""",
    "hybrid_retrieve": f"""with {INDEX}, {QUERIES}, h as (select q.* from q join embeddings e on e.vec_id = q.query_id % 1000 and e.vec_id % 50 = 0), {bm25('h', 40, 'r')},
        v as (select query_id, doc_id, (r - 1)::int rank from (select h.query_id, e.vec_id doc_id, row_number() over (partition by h.query_id order by {L2}, e.vec_id) r from h join embeddings q on q.vec_id = h.query_id % 1000, embeddings e) where r <= 40)
        select * from {fuse('v', 'r', 'query_id')}""",
    "rrf_fusion": f"""with d as (select distinct doc_id, source, n_chars, published_at from documents where n_chars is not null and published_at is not null),
        x as (select source, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) - 1 rank from d qualify rank < 40),
        y as (select source, doc_id, row_number() over (partition by source order by published_at desc, doc_id) - 1 rank from d qualify rank < 40) select * from {fuse('x', 'y', 'source')}""",
    "rerank_overlap": f"""with {INDEX}, {QUERIES}, {bm25('q', 40, 'r')}, s as (select r.*, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(q.text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) a,
        list_distinct(list_filter(regexp_split_to_array(lower(coalesce(d.text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) b from r join q using (query_id) join documents d using (doc_id)),
        t as (select query_id, doc_id, rank, case when len(a) > 0 then round(len(list_intersect(a, b)) / len(a), 6) else 0 end rerank_score from s)
        select query_id, doc_id, rerank_score, (row_number() over (partition by query_id order by rerank_score desc, rank) - 1)::int place from t qualify place < 15""",
    "rerank_permutation": f"""with {INDEX}, {QUERIES}, {bm25('q', 40, 'r')}, o as (select query_id, doc_id, rank, case rank when 3 then 0 when 1 then 1 when query_id % 7 then 2 else 3 end g from r)
        select query_id, doc_id, place, (40 - place)::double rerank_score from (select query_id, doc_id, (row_number() over (partition by query_id order by g, rank) - 1)::int place from o) where place < 15""",
    "union_distinct_iterations": f"""with {INDEX}, {QUERIES}, q2 as (select query_id, array_to_string(string_split(text, ' ')[1:8], ' ') as text from q), {bm25('q', 10, 'r')}, {bm25('q2', 10, 's')},
        u as (select query_id, doc_id, min(p) p from (select query_id, doc_id, rank p from r union all select query_id, doc_id, 100 + rank from s) group by all)
        select query_id, doc_id, row_number() over (partition by query_id order by p, doc_id)::int as position from u""",
    "document_identity": "select key, count(*) n from (select coalesce(nullif(id, ''), sha1(text)) as key from chunks where text is not null) group by key",
    "source_label": f"select id, string_split(coalesce(nullif(coalesce(source_pdf, source_pdf_path), ''), 'source'), '/')[-1] || ', ' || {LABEL} as label from (select distinct id, source_pdf, source_pdf_path, page_start, page_end from chunks where id is not null)",
    "style_note": """select distinct id, case when coalesce(html_tag, '') <> '' and css <> '' then ' [HTML_TAG: ' || html_tag || ' | CSS: ' || css || ']' else '' end note from
        (select id, html_tag, coalesce(array_to_string(list_transform(list_filter(map_entries(styling), lambda e: e.value is not null and e.value not in ('', 'none', 'rgba(0, 0, 0, 0)')), lambda e: e.key || ': ' || e.value), '; '), '') css
        from chunks where id is not null and styling is not null)""",
    "context_pack": f"""with recursive {INDEX}, {QUERIES}, {bm25('q', 15, 'r')}, k as (select query_id, rank, 'Source S' || (rank + 1) || ': ' || coalesce(path, source, '') h, {strip("coalesce(text, '')")} t from r join documents using (doc_id)),
        s as (select query_id, -1 rank, 0 used, '' context, 0 included, false done from (select distinct query_id from k) union all
          select s.query_id, s.rank + 1, case when room <= 0 then used else used + length(sec) end, case when room <= 0 then context when included = 0 then sec else context || chr(10) || chr(10) || sec end, case when room <= 0 then included else included + 1 end, room <= 0 from
          (select s.*, k.h, 60000 - used - length(h) - 8 room, '[' || h || ']' || chr(10) || case when length(t) > 60000 - used - length(h) - 8 then regexp_replace(substr(t, 1, greatest(60000 - used - length(h) - 8, 0)), '{WS}+$', '') || '...' else t end sec
           from s join k on k.query_id = s.query_id and k.rank = s.rank + 1 where not done) s)
        select query_id, context, included::int included, used::int used_chars from s qualify row_number() over (partition by query_id order by rank desc) = 1""",
    "cite_extract": f"""with {ANSWERS} select answer_id, coalesce(string_agg(number::varchar, ',' order by p) filter (number between 1 and 15), '') numbers from a left join firsts using (answer_id) group by answer_id""",
    "cite_sources": f"""with {ANSWERS} select answer_id, chr(10) || chr(10) || '---' || chr(10) || chr(10) || '**Sources**' || chr(10) || chr(10) || string_agg('[S' || number || '] ' || label || chr(10) || chr(10) || '> ' || quote || chr(10), chr(10) order by position) block
        from entries group by answer_id""",
    "cite_renumber": f"""with {ANSWERS}, g as (select answer_id, label, row_number() over (partition by answer_id order by min(position)) group_no from entries group by answer_id, label)
        select answer_id, number, group_no::int group_no, label from entries join g using (answer_id, label)""",
    "last_user_message": f"""select conv_id, turn, {strip("t")} question from (select conv_id, turn, coalesce(text, '') t, row_number() over (partition by conv_id order by turn desc, coalesce(text, '') desc) k from conversations where msg_role = 'user') where k = 1""",
    "validate_question": f"""select conv_id, case when q = '' then 'empty' when length(q) > 12000 then 'too_long' else 'ok' end status from
        (select conv_id, {strip("coalesce(text, '')")} q, row_number() over (partition by conv_id order by turn desc, coalesce(text, '') desc) k from conversations where msg_role = 'user') where k = 1""",
    "assistant_last": "select conv_id, turn from (select conv_id, arg_max(msg_role, turn) r, max(turn) turn from conversations group by conv_id) where r = 'assistant'",
}
SQL["manifest_check"] = f"""with f as ({SQL['manifest']}) select source, said, coalesce(chunk_count, 0) found, coalesce(said = coalesce(chunk_count, 0), false) agrees
    from (select distinct coalesce(source_pdf, source_html) source, chunk_count::bigint said from manifest) left join f using (source)"""
SQL["run_summary"] = f"with f as ({SQL['manifest']}) select count(*) documents, sum(chunk_count)::bigint chunks, sum(table_count)::bigint tables, sum(image_count)::bigint images from f"


def _joined(*cols: str) -> str:
    """Captions or footnotes of several columns as one line."""
    every = " || ".join(f"coalesce({c}, []::varchar[])" for c in cols)
    return collapse(f"array_to_string(list_transform(list_filter({every}, lambda x: x is not null and x <> ''), lambda x: {collapse(unescape('x'))}), ' ')")


GRID = f"list_filter(list_transform(regexp_extract_all(body, '<tr>(.*?)</tr>', 1), lambda r: list_transform(regexp_extract_all(r, '<td>(.*?)</td>', 1), lambda x: {norm('x')})), lambda r: array_to_string(r, '') <> '')"
MD = """coalesce(array_to_string(list_concat(list_concat(l[1:1], ['| ' || array_to_string(list_transform(range(w), lambda x: '---'), ' | ') || ' |']), l[2:]), chr(10)), '')"""
LINES = "list_transform(p, lambda r: '| ' || array_to_string(list_transform(r, lambda x: replace(x, '|', chr(92) || '|')), ' | ') || ' |')"
TABLES = f"""tb as (select *, coalesce(nullif({strip("coalesce(table_body, '')")}, ''), {strip("coalesce(text, '')")}) body, count(*) over (partition by doc_key order by ord) no, {_joined('table_caption', 'image_caption')} cap, {_joined('table_footnote')} foot
  from laid where lv is null and block_type in ('table', 'chart')),
tg as (select *, {GRID} g from tb), tw as (select *, list_max(list_transform(g, lambda r: len(r))) w from tg), tp as (select *, list_transform(g, lambda r: list_resize(r, w, '')) p from tw), tl as (select *, {LINES} l from tp),
tt as (select *, case when len(g) > 0 then {MD} else {norm("regexp_replace(body, '<[^>]+>', ' ', 'g')")} end grid_text, len(p) n, len(p) > 0 and (len(p) >= 25 or length(body) >= 4000) large from tl)"""
KV = """array_to_string(list_transform(range(1, w + 1), lambda k: case when n > 1 then (case when p[1][k] = '' then 'Column' else p[1][k] end) else 'Column ' || k end || ': ' || r[k]), chr(10))"""
CHUNKED = f"""{LAID}, {TABLES}, seg_rows as (select * from laid where not brk and (lv is not null or body_text <> '')),
chap as (select doc_key, seg, min(ord) ord, string_agg(body_text, chr(10) || chr(10) order by ord) filter (lv is null) body, max(t) filter (lv is not null) own, max(lv) lv, any_value(path) path, any_value(depth) depth,
  arg_min(page, ord) filter (page is not null) a, arg_max(page, ord) filter (page is not null) b from seg_rows group by all),
parts as (
  select doc_key, ord, 0 sub, 'table' chunk_type, concat_ws(chr(10) || chr(10), case when cap <> '' then 'Caption: ' || cap end, nullif(grid_text, ''), case when foot <> '' then 'Footnote: ' || foot end) txt, array_to_string(path, ' / ') path,
    coalesce(path[-1], doc_key) chapter_title, page a, page b, no table_number, null::int table_row_index, case when n > 0 then n end table_row_count, 'pdf,table' refs from tt where not large
  union all select doc_key, ord, k, 'table_row', concat_ws(chr(10), case when cap <> '' then 'Caption: ' || cap end, {KV}), array_to_string(path, ' / '), coalesce(path[-1], doc_key), page, page, no, k::int, n, 'pdf,table'
    from (select *, unnest(case when n > 1 then p[2:] else p end) r, unnest(range(1, greatest(n, 2))) k from tt where large)
  union all select doc_key, ord, 0, 'image', 'Caption: ' || {_joined('image_caption')}, array_to_string(path, ' / '), path[-1], page, page, null, null, null, 'pdf,image' from laid
    where lv is null and block_type in ('image', 'seal') and {strip("coalesce(img_path, '')")} <> '' and {_joined('image_caption')} <> ''
  union all select doc_key, ord, 0, 'chapter_text', repeat('#', coalesce(lv, least(greatest(depth, 1), 6))::int) || ' ' || coalesce(own, path[-1], doc_key) || chr(10) || chr(10) || body,
    array_to_string(case when len(path) > 0 then path else [coalesce(own, doc_key)] end, ' / '), coalesce(own, path[-1], doc_key), a, b, null, null, null, 'pdf' from chap where body is not null),
chunked as (select doc_key || ':' || lpad((row_number() over (partition by doc_key order by ord, sub))::varchar, 5, '0') id, doc_key, chunk_type, {strip('txt')} as text, path, chapter_title, a::int page_start, b::int page_end,
  table_number::int table_number, table_row_index, table_row_count::int table_row_count, refs from parts where {strip('txt')} <> '')"""
UWS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

SQL["block_chunks"] = f"with {CHUNKED} select id, chunk_type, text, path, chapter_title, page_start, page_end, table_number, table_row_index, table_row_count, refs from chunked"
SQL["json_lines"] = f"with {CHUNKED} select id, doc_key, text, chunk_type, page_start, table_number, refs from chunked"
SQL["table_files"] = f"""with b0 as (select doc_key, ord, page_idx, table_body body, {_joined('table_caption')} cap, {_joined('table_footnote')} foot from blocks where table_body is not null), g0 as (select *, {GRID} g from b0),
  g1 as (select *, list_max(list_transform(g, lambda r: len(r))) w from g0), g2 as (select *, list_transform(g, lambda r: list_resize(r, w, '')) p from g1), g3 as (select *, {LINES} l from g2)
  select doc_key || '/' || ord || '_table_0001' || case when page_idx is null then '' else '_page_' || lpad((page_idx + 1)::varchar, 3, '0') end as name,
  case when len(p) > 0 then array_to_string(list_transform(p, lambda r: array_to_string(list_transform(r, lambda x: case when regexp_matches(x, '["\r\n,]') then '"' || replace(x, '"', '""') || '"' else x end), ',') || chr(13) || chr(10)), '') end csv,
  case when len(p) > 0 then concat_ws(chr(10) || chr(10), case when cap <> '' then 'Caption: ' || cap end, {MD}, case when foot <> '' then 'Footnote: ' || foot end) end markdown, body html from g3"""
# folds: each cited number in turn by its group's
SQL["cite_rewrite"] = f"""with recursive {ANSWERS}, g as (select answer_id, label, row_number() over (partition by answer_id order by min(position)) no from entries group by answer_id, label),
  m as (select answer_id, list({{'n': number, 'g': no}}) l from entries join g using (answer_id, label) group by answer_id),
  f as (select answer_id, answer, l, 1 k from a left join m using (answer_id) union all select answer_id, replace(answer, '[S' || l[k].n || ']', '[' || l[k].g || ']'), l, k + 1 from f where k <= len(l)),
  z as (select answer_id, answer from f where k > coalesce(len(l), 0)),
  s as (select answer_id, answer, 0 k from z union all select answer_id, regexp_replace(answer, '\\](\\[[0-9]+\\])', '] \\1'), k + 1 from s where regexp_matches(answer, '\\]\\[[0-9]+\\]'))
  select answer_id, regexp_replace(coalesce(answer, ''), '{WS}+$', '') answer from s where not regexp_matches(answer, '\\]\\[[0-9]+\\]')"""
SQL["html_chunks"] = f"""with l as (select doc_id, unnest(ls) x, generate_subscripts(ls, 1) k from (select doc_id, string_split(text, chr(10)) ls from documents where text is not null)),
  e as (select doc_id, 0 k, 'h1' tag, 'Document' t from documents where text is not null union all select doc_id, k, 'p', regexp_replace(regexp_replace(x, '{UWS}+', ' ', 'g'), '^ | $', '', 'g') from l),
  d as (select doc_id, min(k) k, t, arg_min(tag, k) tag from e where length(t) >= 5 group by doc_id, t)
  select doc_id || ':' || lpad((row_number() over (partition by doc_id order by k))::varchar, 5, '0') id, case when tag = 'h1' then 'heading' else 'text' end chunk_type, tag html_tag, t as text from d"""
# constructed inputs: the expected text is said literally
SQL["html_cases"] = """select source || ':' || lpad(k::varchar, 5, '0') id, tag html_tag, kind chunk_type, replace(t, '#', source) as text, replace(rows, '#', source) table_rows from sources, (values
  (1, 'h2', 'heading', 'Title of #', ''), (2, 'p', 'text', 'Second part & more of #', ''), (3, 'p', 'text', 'Kept nav of #', ''), (4, 'li', 'text', 'An entry of # with words', ''),
  (5, 'p', 'text', '0123456 789 0123456789 ab cd', ''), (6, 'table', 'table', '#headcell', '#,head;cell,')) v(k, tag, kind, t, rows)"""
SQL["span_tables"] = """select n_nationkey, '| key | key | n |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || n_name || ' | b c | n |' || chr(10) || '| ' || n_name || ' |  |  |' || chr(10) || '| ' || n_name || ' |  |  |' markdown, 4 n_rows from nation"""
SQL["entities"] = """select source, source || ' é … ’ — © &lt; R&D &unknown; ½' decoded from sources"""
SQL["block_cases"] = """select n_name doc_key, k::int ord, kind block_type, page::int page_idx, replace(t, '#', n_name) as text, lv::int text_level, items, body, img, cap, code from nation, (values
  (0, 'text', 0, 'Head of #', 2, '', '', '', '', ''), (1, 'text', 0, 'One two', null, '', '', '', '', ''), (2, 'list', 0, '', null, 'a b|c', '', '', '', ''), (3, 'table', 2, '', null, '', '<table></table>', 't.png', 'cap 1|cap 2', ''),
  (4, 'image', 2, '', null, '', '', 'i.png', 'Figure', ''), (5, 'equation', 2, 'x = 1', null, '', '', '', '', ''), (6, 'code', 2, '', null, '', '', '', '', 'run it'), (7, 'seal', 2, '', null, '', '', 's.png', '', ''), (8, 'other', 2, 'free text', null, '', '', '', '', '')) v(k, kind, page, t, lv, items, body, img, cap, code)"""
SQL["caption_keys"] = """select n_name doc_key, 'Caption: A # B C' || chr(10) || chr(10) || n_name || chr(10) || chr(10) || 'Footnote: F G' as text from nation"""
SQL["caption_keys"] = SQL["caption_keys"].replace("'Caption: A # B C'", "'Caption: A ' || n_name || ' B C'")
SQL["scan_jsonl"] = f"""select distinct id, {strip("case when coalesce(text, '') <> '' then text else content end")} as text, chunk_type, 'corpus' index_name from chunks
  where id is not null and {strip("case when coalesce(text, '') <> '' then text else content end")} <> ''"""
SQL["page_reader"] = f"""with p as (select doc_id, unnest(l) t, generate_subscripts(l, 1) - 1 k from (select doc_id, string_split(text, chr(10) || chr(10)) l from documents where text is not null))
  select doc_id::varchar stem, k::int page_idx, {collapse("replace(t, chr(0), ' ')")} as text from p where k >= 1 and k < 4"""
SQL["message_texts"] = """select conv_id, turn, case when regexp_matches(text, '[^\t\n\x0b\f\r ]') then text || chr(10) || text else '' end || case when regexp_matches(text, '[^\t\n\x0b\f\r ]') then chr(10) else '' end || 'end' as text from conversations where text is not null"""
SQL["answer_chips"] = f"""with r as ({SQL['cite_rewrite']}), n as ({SQL['cite_renumber']}), c as (select answer_id, max(group_no)::int n from n group by answer_id) select answer_id, answer as content, n sources from r join c using (answer_id)"""
SQL["manifest_paths"] = f"""select source, chunk_count, '/out/chunks/' || source || '.jsonl' chunks_path, '/out/markdown/' || source || '.md' markdown_path, '/out/images/' || source images_dir, '/out/tables/' || source tables_dir from ({SQL['manifest']})"""
SQL["image_copies"] = "select source doc_key, p path, n as name from sources, (values ('a/i.png', 'i.png'), ('b/i.png', 'i_2.png'), ('c/i.png', 'i.png'), ('c/noext', 'noext')) v(p, n)"
SQL["rebased_markdown"] = "select source, '![a](../images/x.png) ![b](new.png) ![c](w2.png) ![d](own.png) [no image](w.png) ![e](../images/x.png)' markdown from sources"
SQL["html_table_files"] = """select 'table_' || n_name || '_' || lpad(n_nationkey::varchar, 5, '0') as name, chr(65279) || 'a|b;"c;d"' || chr(13) || chr(10) || n_name || chr(13) || chr(10) csv,
  '| a|b | c;d |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_name || ' |  |' markdown from nation"""
