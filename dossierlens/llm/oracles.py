"""SQL that recomputes near-duplicate groups by comparing everything with everything."""

from __future__ import annotations

_GROUPS = """
linked as (select a, b from link union all select b, a from link),
reached as (select a, b from linked union select r.a, n.b from reached r join linked n on r.b = n.a),
smallest as (select a as id, min(b) as smallest from reached group by a)"""

NEAR_DUPLICATES = rf"""
with recursive word as (
  select doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
shingle as (
  select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[]
                                      when len(w) < 5 then [array_to_string(w, ' ')]
                                      else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
  from word),
size as (select doc_id, count(*) as n from shingle group by doc_id),
common as (select x.doc_id as a, y.doc_id as b, count(*) as n
           from shingle x join shingle y on x.s = y.s and x.doc_id < y.doc_id group by all),
link as (select a, b from common c join size x on x.doc_id = a join size y on y.doc_id = b
         where 100 * c.n >= 75 * (x.n + y.n - c.n)),
{_GROUPS}
select doc_id, coalesce(n, 0)::bigint as n_shingles, least(doc_id, coalesce(smallest, doc_id)) as component_id,
       doc_id <= coalesce(smallest, doc_id) as kept
from documents left join size using (doc_id) left join smallest on id = doc_id"""

NEAR_VECTORS = f"""
with recursive unit as (
  select vec_id, embedding::double[] as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (select x.vec_id as a, y.vec_id as b from unit x join unit y on x.vec_id < y.vec_id and len(x.v) = len(y.v)
         where list_cosine_similarity(x.v, y.v) >= 0.95),
{_GROUPS},
degree as (select a as id, count(*) as n from linked group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(smallest, vec_id)) as component_id,
       vec_id <= coalesce(smallest, vec_id) as kept
from embeddings left join degree d on d.id = vec_id left join smallest l on l.id = vec_id"""
