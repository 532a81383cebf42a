"""DuckDB SQL for the rows of shelfspark.queries, written from the semantics and not from the Spark plans."""

from __future__ import annotations

from . import queries as q
from .functions.paths import RESERVED
from .functions.text import SMALL_WORDS

UPPERS = ", ".join(f"'{w}'" for w in RESERVED)
SMALL = ", ".join(f"'{w}'" for w in SMALL_WORDS)
PERSON = r"[A-Z][a-zA-Z''.-]*(\s+[A-Z][a-zA-Z''.-]*){1,3}"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g'))"


def clean(x: str) -> str:
    return rf"regexp_replace({x}, '[ \t.;]+$', '')"


def authors(x: str) -> str:
    return rf"regexp_replace({x}, '\s*;\s*', ', ', 'g')"


def year(x: str) -> str:
    return rf"regexp_extract({x}, '\b(1[5-9]\d{{2}}|20\d{{2}})\b', 1)"


def parsed(source: str, stem: str, keep: str = "*") -> str:
    """CTEs that end in hx: the columns of source and h_title, h_author, h_year."""
    tags = stem
    for t in q.TAGS:
        tags = f"regexp_replace({tags}, '(?i)_?{t.replace('.', chr(92) + '.')}_?', ' ', 'g')"
    person = lambda x: f"regexp_full_match({x}, '{PERSON}')"
    people = lambda x: f"(len(string_split({x}, ',')) >= 2 and list_bool_and(list_transform(string_split({x}, ','), lambda p: {person('trim(p)')})))"
    squeeze = rf"trim(regexp_replace(regexp_replace(regexp_replace(s0, '[\(\{{\[][^)\}}\]]*[\)\}}\]]', ' ', 'g'), '[+_.]+', ' ', 'g'), '\s+', ' ', 'g'))"
    return rf"""
h0 as (select {keep}, {tags} as s0 from {source}),
h1 as (select *, {year("s0")} as h_year, regexp_replace({squeeze}, '^[\s\-\x{{2013}}\x{{2014}}]+|[\s\-\x{{2013}}\x{{2014}}]+$', '', 'g') as s1 from h0),
h2 as (select *, position(' - ' in s1) as cut_at, trim(left(s1, position(' - ' in s1) - 1)) as a, trim(substr(s1, position(' - ' in s1) + 3)) as b from h1),
h3 as (select *, case when {people("a")} and not {people("b")} then true when {people("b")} and not {people("a")} then false else {person("a")} and not {person("b")} end as flip from h2),
hx as (select * exclude (s0, s1, cut_at, a, b, flip), {clean("case when cut_at = 0 then s1 when flip then b else a end")} as h_title,
              {authors(clean("case when cut_at = 0 then '' when flip then a else b end"))} as h_author from h3)"""


def files(path: str) -> str:
    return f"f as (select p_partkey as scan_ord, {path} as source_path, {q.SIZE} as size_bytes, {q.M_TITLE} as m_title, {q.M_AUTHOR} as m_author, {q.M_YEAR} as m_year, p_type as subject from part)"


BASE = "regexp_extract(source_path, '([^/]*)$', 1)"
STEM = rf"regexp_replace({BASE}, '\.[^.]*$', '')"


def resolved(path: str = q.PATH) -> str:
    """CTEs that end in rx: files with title, author, year and their sources."""
    one = lambda f: f"case when m_{f} <> '' then m_{f} else h_{f} end as {f}, case when m_{f} <> '' then 'Metadata' when h_{f} <> '' then 'Heuristic' else 'Unresolved' end as {f}_source"
    return f"{files(path)}, {parsed('f', STEM)}, rx as (select scan_ord, source_path, size_bytes, subject, {', '.join(map(one, ('title', 'author', 'year')))} from hx)"


def status(manual: str = "false", edited: str = "''") -> str:
    return (
        "case when title_source = 'Unresolved' then 'Unresolved' when author_source = 'Unresolved' or year_source = 'Unresolved' then 'Partial'"
        f" when {manual} or 'Edited' in (title_source, author_source, year_source, {edited}) then 'Edited' when 'Heuristic' in (title_source, author_source, year_source) then 'Heuristic' else 'Metadata' end"
    )


def category(part: int, title: str = "title", author: str = "author", subject: str = "subject", path: str = "source_path") -> str:
    """part: 0 category, 1 subcategory, 2 warning."""
    base = f"regexp_extract({path}, '([^/]*)$', 1)"
    cases = [
        (f"lower(trim({author})) = 'ann lee'", ("Fiction", "Sci-Fi", "")),
        (rf"regexp_matches({base}, '(?i)\bgear\b|ring_')", ("Technology", "Gears", 'rule matched undeclared subcategory "Gears" under category "Technology"')),
        (f"regexp_matches({title}, '^red w')", ("Crafts", "Red", 'rule matched undeclared category "Crafts"')),
        (f"lower(trim({subject})) = 'promo'", ("Technology", "", "")),
    ]
    declared: dict[str, tuple[str, str, str]] = {}
    for c, subs in q.CONFIG.categories.items():
        for s in subs:
            declared.setdefault(s.lower(), (c, s, ""))
    cases += [(f"lower({subject}) = '{k}'", v) for k, v in declared.items()]
    return "case " + " ".join(f"when {c} then '{v[part]}'" for c, v in cases) + f" else '{('Uncategorized', '', '')[part]}' end"


def named(title: str, yr: str, author: str) -> str:
    """The sanitised file name."""
    r = rf"regexp_replace(regexp_replace({title} || ' (' || {yr} || ') - ' || {author}, '\(\s*\)', '', 'g'), '\s+', ' ', 'g')"
    r = rf"case when {title} = '' then regexp_replace({r}, '^[\s\-\x{{2013}}\x{{2014}}]+', '') else {r} end"
    r = rf"trim(case when {author} = '' then regexp_replace({r}, '[\s\-\x{{2013}}\x{{2014}}]+$', '') else {r} end)"
    s = rf"regexp_replace(regexp_replace({r}, '[<>:""/\\|?*\x00-\x1f]', '', 'g'), '[ .]+$', '')".replace('""', '"')
    return f"case when upper({s}) in ({UPPERS}) then '_' || {s} when {s} = '' then 'Untitled' else {s} end"


def destination(title: str, yr: str, author: str, cat: str, sub: str, ext: str) -> str:
    """Titles are ASCII here, so a byte is a character."""
    folder = f"'{q.LIBRARY}/' || case when {cat} <> '' then {cat} || '/' else '' end || case when {sub} <> '' then {sub} || '/' else '' end"
    t = f"case when {title} = '' then 'Untitled' else {title} end"
    full, nameless = f"{folder} || {named(t, yr, author)} || {ext}", f"{folder} || {named(t, yr, chr(39) * 2)} || {ext}"
    cut = f"list_transform(range(1, cast(ceil(length({t}) / 10.0) as bigint) + 1), lambda k: {folder} || {named(f'left({t}, cast(greatest(length({t}) - 10 * k, 0) as bigint))', yr, chr(39) * 2)} || {ext})"
    return f"case when strlen({full}) <= 240 then {full} when strlen({nameless}) <= 240 then {nameless} else coalesce(list_filter({cut}, lambda p: strlen(p) <= 240)[1], {cut}[-1]) end"


def duplicate_status(source: str, key: str) -> str:
    """source: a table with id, title, author, format, size_bytes.  All pairs of a key are compared."""
    return f"""(select a.{key}, case when {norm("a.title")} || '|' || {norm("a.author")} = '|' or count(b.{key}) = 0 then 'NotDuplicate'
 when bool_or(a.format = b.format and case when a.size_bytes = 0 or b.size_bytes = 0 then a.size_bytes = b.size_bytes
              else abs(a.size_bytes - b.size_bytes) <= greatest(greatest(a.size_bytes, b.size_bytes) // 100, 1024) end) then 'LikelyDuplicate' else 'PossibleDuplicate' end as duplicate_status,
 case when {norm("a.title")} || '|' || {norm("a.author")} = '|' or count(b.{key}) = 0 then '' else 'dup-' || substr(sha256({norm("a.title")} || '|' || {norm("a.author")}), 1, 12) end as duplicate_group_id
 from {source} a left join {source} b on {norm("a.title")} = {norm("b.title")} and {norm("a.author")} = {norm("b.author")} and a.{key} <> b.{key} group by a.{key}, a.title, a.author)"""


CATALOGUE = f"c as (select p_partkey, p_name as title, p_brand as author, {q.FORMAT} as format, {q.SIZE} as size_bytes from part)"
EXT = r"regexp_extract(source_path, '(\.[^./]*)$', 1)"
NUMBERED = r"case when dest_path = '' or n = 1 then dest_path else regexp_replace(dest_path, '\.[^./]*$', '') || ' (' || n || ')' || regexp_extract(dest_path, '(\.[^./]*)$', 1) end"


def reviewed(path: str = q.PATH) -> str:
    """CTEs that end in vx: the rows of a review."""
    return f"""{resolved(path)},
cx as (select *, {category(0)} as category, {category(1)} as subcategory, lower(substr({EXT}, 2)) as format from rx),
dx as (select *, {destination("title", "year", "author", "category", "subcategory", EXT)} as dest_path from cx),
nx as (select *, row_number() over (partition by dest_path order by scan_ord) as n from dx),
ux as (select * exclude (dest_path), {NUMBERED} as dest_path from nx),
vx as (select ux.*, s.duplicate_status, {status()} as status from ux join {duplicate_status("ux", "scan_ord")} s on s.scan_ord = ux.scan_ord)"""


REVIEW = reviewed()
TITLE_SOURCE = "case p_partkey % 4 when 0 then replace(p_name, ' ', '-') when 1 then 'the_' || replace(p_name, ' ', '_') || '_of_a_' || p_type when 2 then 'on ' || p_name || ' in iOS-' || p_brand else upper(p_name) || ' and' end"


def titled(source: str, key: str, t: str) -> str:
    """CTEs that end in tx: key, title (formatted)."""
    spelled = "case lower(r) " + " ".join(f"when '{h.lower()}' then '{h}'" for h in q.HYPHENS) + " else replace(r, '-', ' ') end"
    word = (
        r"case when regexp_matches(w, '(?s)^\P{L}*\p{L}.*\p{Lu}') then w"
        rf" when i > 1 and i < len(ws) and lower(regexp_extract(w, '^[^a-zA-Z]*([a-zA-Z]+)[^a-zA-Z]*$', 1)) in ({SMALL}) then lower(w)"
        r" else regexp_extract(w, '^(\P{L}*)', 1) || upper(substr(w, length(regexp_extract(w, '^(\P{L}*)', 1)) + 1, 1)) || lower(substr(w, length(regexp_extract(w, '^(\P{L}*)', 1)) + 2)) end"
    )
    return rf"""
t0 as (select {key}, replace({t}, '_', ' ') as t from {source}),
t1 as (select {key}, string_split_regex(t, '[A-Za-z0-9]+(?:-[A-Za-z0-9]+)+') as p, list_transform(regexp_extract_all(t, '[A-Za-z0-9]+(?:-[A-Za-z0-9]+)+'), lambda r: {spelled}) as r from t0),
t2 as (select {key}, list_filter(string_split_regex(array_to_string(list_transform(list_zip(p, r), lambda z: z[1] || coalesce(z[2], '')), ''), '\s+'), lambda w: w <> '') as ws from t1),
tx as (select {key}, array_to_string(list_transform(ws, lambda w, i: {word}), ' ') as title from t2)"""


LOG = f"l as (select o_orderkey as log_ord, 'b' || ({q.ORDER_BATCH}) as batch_id, o_orderdate as ts, '/old/' || o_orderkey as old_path, '/new/' || o_orderkey as new_path, o_orderstatus = 'F' as undone from orders)"
CACHE = """d as (select '/library/' || lang || '/' || source || '/' || doc_id || '.epub' as source_path, doc_id * 1000 as mtime_ns, n_chars as size, doc_id from documents),
f as (select source_path, case when doc_id % 10 = 8 then mtime_ns + 1 else mtime_ns end as mtime_ns, case when doc_id % 10 = 4 then size + 1 else size end as size from d),
c as (select case when doc_id % 10 in (3, 5) then source_path || '.gone' else source_path end as source_path, mtime_ns, size, 't' || doc_id as title, doc_id % 10 not in (6, 7) as valid from d),
h as (select c.* from c join f using (source_path, mtime_ns, size) where valid),
m as (select f.* from f anti join h using (source_path, mtime_ns, size))"""
BOOKS = "b as (select '/library/' || p_partkey as source_path, p_name as title, p_brand as author, '' || (1950 + p_size) as year, case when p_size % 6 = 0 then '' else p_type end as category, case when p_size % 7 = 0 then '' else p_brand end as subcategory from part)"
SHELF = "case when subcategory = '' then '(No subcategory)' else subcategory end"
URL = "'/library/' || regexp_replace(url, '^[a-z]+://|[?#].*', '', 'g')"
PAGE_PARTS = "string_split(substr(p, 10), '/')"


def oracle_sql() -> dict[str, str]:
    flat = ", ".join(f"{f} as {f}_value, {f}_source" for f in ("title", "author", "year"))
    return {
        "dup_detect": f"with {CATALOGUE} select * from {duplicate_status('c', 'p_partkey')}",
        "review_filter": f"with {REVIEW} select source_path, status, duplicate_status from vx where duplicate_status <> 'NotDuplicate' and (contains(lower(title), 'ring') or contains(lower(author), 'ring') or contains(lower({BASE}), 'ring'))",
        "stem_parse": f"with {parsed('part', q.STEM, 'p_partkey')} select p_partkey, h_title as title, h_author as author, h_year as year from hx",
        "title_format": f"with {titled('part', 'p_partkey', TITLE_SOURCE)} select * from tx",
        "clean_fields": f"""with x as (select p_partkey, p_name || substr('. ;.; .', 1, p_size % 8) as t, p_brand || ' ;' || p_type || ';x' as a, 'v' || p_size || ' (' || (1480 + p_partkey % 700) || ')' as y from part)
select p_partkey, {clean("t")} as title, {authors("a")} as author, {year("y")} as year, {norm("a || y")} as dup_key from x""",
        "rule_categorise": f"with {resolved()} select scan_ord, {category(0)} as category, {category(1)} as subcategory, {category(2)} as category_warning from rx",
        "subject_categorise": f"""with x as (select doc_id, coalesce(text, '') as title, source as author, lang as subject, '/x/' || source as source_path from documents)
select doc_id, {category(0)} as category, {category(1)} as subcategory from x""",
        "provenance_status": f"with {resolved()} select scan_ord, {flat}, {status('scan_ord % 17 = 0')} as status from rx",
        "dest_path": f"""with x as (select p_partkey, {q.LONG_TITLE} as title, case when p_size % 2 = 0 then p_brand else '' end as author, case when p_size % 3 = 0 then '' || (1950 + p_size) else '' end as year, p_type as cat, case when p_size % 5 = 0 then '' else p_brand end as sub from part)
select p_partkey, {destination("title", "year", "author", "cat", "sub", "'.Epub'")} as dest_path from x""",
        "dest_disambiguate": f"""with x as (select p_partkey as scan_ord, case when p_partkey % 9 = 0 then '' else '/library/' || p_type || '/' || p_name || '.epub' end as dest_path from part),
y as (select *, row_number() over (partition by dest_path order by scan_ord) as n from x) select scan_ord, {NUMBERED} as dest_path from y""",
        "scan_review": f"with {REVIEW} select source_path, format, title, author, year, category, subcategory, dest_path, duplicate_status, status from vx",
        "recompute": f"""with {resolved()}, e as (select * exclude (title, title_source), title as old, 'the_' || title || '-of-a-kind' as raw, case when scan_ord % 7 = 0 then 'Edited' else title_source end as title_source from rx), {titled("e", "scan_ord", "raw")},
g as (select e.*, case when e.scan_ord % 7 = 0 then tx.title else old end as title from e join tx on tx.scan_ord = e.scan_ord)
select scan_ord, title, {status()} as status, {category(0)} as category from g""",
        "apply_split": f"with {reviewed(q.UNTITLED_PATH)} select source_path, status = 'Unresolved' as skipped from vx",
        "known_destinations": f"""with {resolved()}, k as (select {category(0)} as category, {category(1)} as subcategory from rx)
select category, subcategory, (category, subcategory) in ({", ".join(f"('{c}', '{s}')" for c, subs in q.CONFIG.categories.items() if c != "Uncategorized" for s in subs or [""])}) as known_destination, count(*) as n from k group by 1, 2, 3""",
        "batch_list": f"with {LOG} select batch_id, strftime(arg_min(ts, log_ord), '%Y%m%d') as first_day, count(*) as entry_count, count(*) filter (undone) as undone_count, count(*) filter (not undone) as remaining_count, min(log_ord) as first_ord from l group by batch_id",
        "batch_entries": f"with {LOG} select batch_id, strftime(arg_min(ts, log_ord), '%Y-%m-%dT%H:%M:%SZ') as timestamp_text, string_agg(log_ord || case when undone then '-' else '+' end, ',' order by log_ord) as entries from l group by batch_id",
        "batch_rows": f"""with {LOG}, b as (select batch_id, strftime(arg_min(ts, log_ord), '%Y%m%d') as first_day, count(*) as entry_count, count(*) filter (undone) as undone_count from l group by batch_id)
select log_ord, batch_id, first_day, entry_count, undone_count, undone from l join b using (batch_id)""",
        "batch_next_id": f"""with x as (select {q.EVENT_BATCH} as batch_id from events)
select '20240101-' || (1 + coalesce(max(try_cast(substr(batch_id, 10) as bigint)) filter (regexp_full_match(batch_id, '20240101-[+-]?[0-9]+')), 0)) as next_batch_id from x""",
        "undo_fold": f"""with {LOG},
e as (select l_orderkey * 10 + l_linenumber as ord, 'b' || ({q.ORDER_BATCH}) as batch_id, l_quantity > 25 as undone, l_returnflag = 'N' and l_linenumber = 1 as whole, '/old/' || l_orderkey as old_path, '/new/' || l_orderkey as new_path from lineitem join orders on l_orderkey = o_orderkey),
x as (select l.log_ord, l.batch_id, l.undone, e.ord, e.undone as now from l left join e on e.batch_id = l.batch_id and (e.whole or (e.old_path = l.old_path and e.new_path = l.new_path)))
select log_ord, batch_id, coalesce(arg_max(now, ord * 2 + cast(now as integer)), any_value(undone)) as undone from x group by log_ord, batch_id""",
        "undo_order": f"with {LOG} select cast(row_number() over (order by log_ord desc) as integer) as place, old_path, new_path from l where batch_id = 'b7' and not undone",
        "cache_hit": f"with {CACHE} select source_path, title from h",
        "cache_miss": f"with {CACHE} select source_path, size from m",
        "cache_keep": f"with {CACHE} select source_path, title from c where source_path in (select source_path from f)",
        "cache_next": f"with {CACHE}, n as (select * from m where size % 4 <> 0) select source_path, 'new' as title, size from n union all select source_path, title, size from c where source_path in (select source_path from f) and source_path not in (select source_path from n)",
        "shelves": f"with {BOOKS} select {SHELF} as shelf, cast(row_number() over (partition by {SHELF} order by year, source_path) as integer) as place, source_path from b",
        "shelf_counts": f"with {BOOKS} select {SHELF} as shelf, count(*) as books from b group by 1",
        "library_search": f"with {BOOKS} select source_path, title from b where category = 'ECONOMY' and contains(lower(title || '|' || author || '|' || category || '|' || subcategory), 'ring')",
        "library_categories": f"with {BOOKS} select distinct category from b where category <> ''",
        "library_subcategories": f"with {BOOKS} select distinct subcategory from b where subcategory <> '' and category = 'SMALL'",
        "cover_overrides": """select '/library/' || p_partkey as source_path, case when p_partkey % 3 <> 0 then '/covers/' || p_partkey when p_partkey % 2 = 0 then '/custom/' || p_partkey
 when p_size < 25 then '/pages/' || p_partkey || '-' || p_size else '' end as cover_path, p_partkey % 3 = 0 as cover_overridden from part""",
        "path_partition": rf"""with x as (select page_id, {URL} as p from pages), y as (select page_id, regexp_extract(p, '([^/]*)/*$', 1) as name, regexp_extract(p, '([^/]*)$', 1) as last, {PAGE_PARTS} as parts from x)
select page_id, case when len(parts) > 1 then parts[1] else '' end as category, case when len(parts) > 2 then parts[2] else '' end as subcategory, name,
 lower(regexp_extract(last, '\.([^.]*)$', 1)) as format, regexp_replace(name, '\.[^.]*$', '') as stem from y""",
        "cover_names": "select doc_id, sha256(source) || case doc_id % 3 when 0 then '.png' when 1 then '.jpg' else '.img' end as file, substr(sha256(text), 1, 8) as version from documents",
        "review_select": f"with {REVIEW} select source_path, status from vx where source_path in (select {q.PATH} from part where p_size < 25) and status = 'Partial' and (contains(lower(title), 'ring') or contains(lower(author), 'ring') or contains(lower({BASE}), 'ring'))",
        "review_all_checked": "select 'every' as checked, count(*) > 0 as all_checked from part union all select 'some', count(*) > 0 and bool_and(p_size < 25) from part",
        "swap_fields": f"with {resolved()} select scan_ord, author as title, title as author, 'Edited' as title_source, case when year_source = 'Unresolved' then 'Partial' else 'Edited' end as status from rx",
        "dest_split": rf"""with x as (select p_partkey, {q.SPLIT_CATEGORY} as c, {q.SPLIT_SUB} as s, list_filter(string_split(replace({q.SPLIT_PATH}, chr(92), '/'), '/'), lambda p: p <> '') as l from part)
select p_partkey, 'home/x/library' as prefix, c || case when s <> '' then '/' || s else '' end as folder, l[-1] as name from x""",
        "display_stems": rf"""with x as (select p_partkey, regexp_extract({q.DISPLAY_PATH}, '([^/]*)/*$', 1) as b from part)
select p_partkey, case when regexp_matches(b, '^\.[^.]*$') then b else regexp_replace(b, '\.[^.]*$', '') end as stem from x""",
        "apply_results": """with r as (select p_partkey as scan_ord, p_size from part)
select scan_ord, case when p_size < 40 then p_size % 3 <> 0 end as ok, case when p_size < 40 then p_size % 3 = 1 end as skipped, case when p_size < 40 then case when p_size % 3 = 0 then 'no space' else '' end end as error from r""",
        "redo_order": f"with {LOG} select cast(row_number() over (order by log_ord) as integer) as place, old_path, new_path from l where batch_id = 'b7' and undone",
        "warning_order": f"with {LOG} select cast(row_number() over (order by log_ord desc) as integer) as place, batch_id as message, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as timestamp_text from l",
        "filled_fields": f"with {resolved()} select scan_ord, title, author, year from rx",
        "extracted_fields": f"""with {titled("part", "p_partkey", "p_name")}, x as (select p.p_partkey, {q.FORMAT} as format, {q.BROKEN} as broken, tx.title as title, {authors(q.BOOK_AUTHOR)} as author, '' || (1950 + p_size) as year, p_type as subject from part p join tx on tx.p_partkey = p.p_partkey)
select '/in/' || p_partkey || '.' || format as source_path, not broken as ok, case when broken then '' else title end as title, case when broken then '' else author end as author, case when broken then '' else year end as year, case when broken then '' else subject end as subject from x""",
        "elapsed_text": "with x as (select p_partkey, cast(floor(p_size * p_size / 4) as bigint) as s from part) select p_partkey, case when s < 60 then s || 's' else (s // 60) || 'm ' || (s % 60) || 's' end as elapsed from x",
    }
