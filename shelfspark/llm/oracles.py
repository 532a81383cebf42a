"""SQL (DuckDB's) for the rows of the queries that SQL can express.  It works by brute force."""

from __future__ import annotations

from . import urls

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_filters(rules=urls.RULES, rounds: int = 10, damping: float = 0.85, threshold: float = 0.05) -> str:
    """The rounds of the propagation are written out one by one."""
    fits = "".join(f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then {{}}{chr(10)}" for r in sorted(rules, key=lambda r: (-len(r.name), r.name)))
    each = sorted(rules, key=lambda r: (-len(r.name), r.name))
    rule = "case " + fits.format(*[f"'{r.name}'" for r in each]) + "end"
    ruled = "case " + fits.format(*[f"'{r.verdict}'" for r in each]) + "end"
    link = urls.LINK.replace("'", "''")
    steps, last = [], "start"
    for k in range(rounds):
        steps.append(
            f"r{k} as (select kind, host, sum(rank) as rank from (select e.kind, e.b as host, {damping} * r.rank / e.degree as rank from e join {last} r on r.kind = e.kind and r.host = e.a"
            f" union all select kind, host, rank from start) group by kind, host)"
        )
        last = f"r{k}"
    return f"""
with p as (select page_id, html, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') as host,
                  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
j as (select page_id, host, path, {rule} as rule, {ruled} as ruled from p),
seeds as (select host, avg(case when ruled = 'allow' then 1.0 else 0.0 end) as trust, avg(case when ruled = 'block' then 1.0 else 0.0 end) as distrust from j where host <> '' group by host),
links as (select distinct host as src, translate(d, '{UPPER}', '{LOWER}') as dst from (select host, unnest(regexp_extract_all(html, '{link}', 1)) as d from p) where host <> '' and d <> ''),
both_ways as (select 'trust' as kind, src as a, dst as b from links where src <> dst union all select 'distrust', dst, src from links where src <> dst),
e as (select kind, a, b, count(*) over (partition by kind, a) as degree from both_ways),
start as (select 'trust' as kind, host, {1 - damping} * trust as rank from seeds where trust > 0 union all select 'distrust', host, {1 - damping} * distrust from seeds where distrust > 0),
{", ".join(steps)},
h as (select host, coalesce(sum(rank) filter (kind = 'trust'), 0) as trust, coalesce(sum(rank) filter (kind = 'distrust'), 0) as distrust from {last} group by host)
select page_id, j.host as host, path, rule, coalesce(ruled, case when coalesce(h.distrust, 0) - coalesce(h.trust, 0) > {threshold} then 'block' else 'allow' end) as verdict
from j left join h on h.host = j.host"""


TOP_K = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id as vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as score
      from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, cast(score as bigint) as score from r where rank <= 5"""

SUBSTRINGS = f"""
with d as (select doc_id, {WORDS} as w from documents),
windows as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d)),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as n from windows) where n > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as at from later),
each_word as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as at from d),
kept as (select k.doc_id, count(*) as n, string_agg(word, ' ' order by k.at) as t from each_word k anti join gone g on g.doc_id = k.doc_id and g.at = k.at group by k.doc_id)
select d.doc_id as doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
from d left join kept k on k.doc_id = d.doc_id"""

JACCARD = f"""
with recursive d as (select doc_id, {WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} as w from documents),
s as (select doc_id, list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                        when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
x as (select doc_id, len(g) as n, unnest(g) as t from s),
pairs as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from x a join x b on a.t = b.t and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from pairs where 100 * c >= 85 * (na + nb - c)),
e as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, e.b from reach r join e on e.a = r.other),
c as (select doc_id, min(other) as component_id from reach group by doc_id)
select s.doc_id as doc_id, cast(len(g) as bigint) as n_shingles, c.component_id as component_id from s join c on c.doc_id = s.doc_id"""
