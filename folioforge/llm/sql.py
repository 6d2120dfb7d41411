"""SQL of the training-data queries that can be said in SQL over whole tables."""

from __future__ import annotations

BODY = r"case when regexp_matches(text, '\S') then text else content end"
CHUNKS = f"c as (select distinct id, source_pdf, chunk_type, {BODY} body from chunks where id is not null and source_pdf is not null and chunk_type in ('chapter_text', 'text'))"
WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"

REPEATED = rf"""{CHUNKS}, l as (select id, source_pdf, unnest(ls) line, generate_subscripts(ls, 1) line_no from (select id, source_pdf, string_split(body, chr(10)) ls from c)),
n as (select id, source_pdf, line_no, regexp_replace(trim(regexp_replace(lower(line), '[\s\x0b]+', ' ', 'g'), ' '), '[0-9]+', '0', 'g') norm from l where regexp_matches(line, '\p{{L}}')),
size as (select source_pdf, count(distinct id) size from c group by source_pdf),
often as (select source_pdf, norm from n join size using (source_pdf) group by source_pdf, norm having count(distinct id) >= 6 and count(distinct id) >= 0.2 * any_value(size) - 1e-9),
found as (select distinct id, line_no::int line_no from n join often using (source_pdf, norm))"""

SQL: dict[str, str] = {
    "p4_found": f"select distinct id from chunks where id is not null and length({BODY}) > 1800",
    "p5_found": f"with {REPEATED} select id, line_no from found",
    "p5_clean": f"""with {REPEATED}, g as (select id, count(*)::int removed, list(line_no) gone from found group by id)
        select id, removed, coalesce((select string_agg(line, chr(10) order by line_no) from (select distinct id, line, line_no from l) l where l.id = g.id and not list_contains(gone, line_no)), '') clean from g""",
    "p6_found": f"""with {CHUNKS}, w as (select id, chunk_type, {WORDS.format('body')} w from c), w40 as (select * from w where len(w) >= 40),
        s as (select distinct id, chunk_type, hash(w[k], w[k + 1], w[k + 2]) h from (select id, chunk_type, w, unnest(range(1, len(w) - 1)) k from w40)), n as (select id, count(*) n from s group by id),
        p as (select a.id id_a, b.id id_b, count(*) m from s a join s b on a.h = b.h and a.chunk_type = b.chunk_type and a.id < b.id group by all)
        select id_a, id_b from p join n x on x.id = id_a join n y on y.id = id_b where m >= 0.7 * (x.n + y.n - m)""",
    "p8_found": f"""with d as (select doc_id, {WORDS.format('text')} w from documents where text is not null), i as (select item_id, {WORDS.format('text')} w from benchmark where text is not null),
        x as (select distinct item_id, array_to_string(w[k:k + 11], ' ') g from (select item_id, w, unnest(range(1, len(w) - 10)) k from i)),
        y as (select distinct doc_id, array_to_string(w[k:k + 11], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 10)) k from d)) select distinct doc_id, item_id from x join y using (g)""",
}
SQL["p8_report"] = f"""select item_id, count(*) documents, count(distinct source) sources from ({SQL['p8_found']}) join (select distinct doc_id, source from documents) using (doc_id) group by item_id"""
