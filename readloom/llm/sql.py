"""DuckDB SQL for the corpus queries that SQL can express over whole tables.

The others rest on trained models, tokens, hashes or edit distances that SQL lacks;
they are tested against brute force.
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {
    # these pages' main text is what their one article element holds
    "op1_html_extraction": r"""
with a as (select page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<[^>]*>', ' ', 'g') as t from pages),
b as (select page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) as text from a)
select page_id, url, text, length(text) as n_chars from b""",
    "op5_line_dedup": f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as i from d),
k as (select *, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_UPPER.lower()}') as key from l),
r as (select key, max(doc_id) as keeper from (select distinct doc_id, key from k where length(key) >= 20) group by key having count(*) >= 3),
m as (select k.doc_id, k.line, k.i, r.keeper is not null and r.keeper <> k.doc_id as gone from k left join r using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from m group by doc_id""",
    # every pair of documents that share a shingle, then all that is reachable over links
    "op7_minhash_near_dedup": f"""
with recursive d as materialized (select doc_id, {_WORDS} as w from documents),
s as materialized (select distinct doc_id, shingle from (select doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i + 1:i + 5], ' ') end as shingle
  from (select doc_id, w, unnest(range(greatest(1, len(w) - 4))) as i from d where len(w) > 0))),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
b as (select x.doc_id as a, y.doc_id as b, count(*) as shared from s x join s y using (shingle) where x.doc_id <> y.doc_id group by 1, 2),
l as materialized (select a, b from b join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * shared >= 85 * (na.n + nb.n - shared)),
r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on r.b = l.a),
c as (select a as doc_id, min(b) as component_id from r group by a)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from c left join n using (doc_id)""",
    # every run of 50 words, those that two documents hold, and what they cover
    "op8_suffix_dedup": f"""
with d as (select doc_id, {_WORDS} as w from documents),
p as materialized (select doc_id, i, array_to_string(w[i + 1:i + 50], ' ') as run from (select doc_id, w, unnest(range(len(w) - 49)) as i from d where len(w) >= 50)),
r as (select run from p group by run having min(doc_id) < max(doc_id)),
h as (select distinct doc_id, i from p semi join r using (run)),
g as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as begins from h),
k as (select doc_id, i, sum(begins) over (partition by doc_id order by i) as island from g)
select doc_id, cast(min(i) as int) as start_word, cast(max(i) + 50 as int) as end_word, cast(max(i) + 50 - min(i) as int) as n_words from k group by doc_id, island""",
}
