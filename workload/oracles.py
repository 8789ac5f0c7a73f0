"""The registered queries in SQL for DuckDB, over the same tables."""

from __future__ import annotations

from workload.corpus import CORPUS_SQL, FULL_TEXT, LINES_SQL, VOLUMES_SQL
from workload.queries import BUDGET, LIBRARY_CONFIDENCE, STORED_PATH, WINDOW

# The plain patterns: DuckDB's engine never backtracks.
_RUNS = {
    "isbn10": r"regexp_extract_all({text}, '[0-9\-\s]+[0-9Xx]')",
    "isbn13": r"regexp_extract_all({text}, '[0-9\-\s]+[0-9]')",
}

_BAD = ", ".join(["'0123456789'"] + [f"'{str(d) * 10}'" for d in range(10)])

# X counts only in last place, unweighted.
_VALID = {
    "isbn10": """(not contains({s}[1:length({s})-1], 'X') and
        list_sum(list_transform(range(1, length({s})+1), lambda i:
            case when {s}[i]='X' then 10 else (11-i)*cast({s}[i] as int) end)) % 11 = 0)""",
    "isbn13": """(list_sum(list_transform(range(1, length({s})+1), lambda i:
            (case when i%2=1 then 1 else 3 end)*(ascii({s}[i])-48))) % 10 = 0)""",
}


def _candidate(s: str) -> str:
    return f"(length({s}) in (10,13) and regexp_full_match({s}, '[0-9Xx]+') and {s} not in ({_BAD}))"


def _isbns(kind: str, text: str) -> str:
    runs = _RUNS[kind].format(text=text)
    cleaned = rf"list_transform({runs}, lambda r: upper(regexp_replace(r, '[\s\-]+', '', 'g')))"
    candidates = f"list_filter({cleaned}, lambda s: {_candidate('s')})"
    return f"list_filter({candidates}, lambda s: {_VALID[kind].format(s='s')})"


def _bar(xs: str) -> str:
    return f"coalesce(array_to_string({xs}, '|'), '')"


_EXT = r"regexp_extract(regexp_extract(filepath, '[^/]*$'), '(\.[^.]*)$', 1)"
_SUPPORTED = (
    f"{_EXT} in ('.pdf','.epub','.mobi','.chm','.htm','.html','.rst','.rtf','.txt','.doc','.docx')"
)

_CORPUS = f"""
volumes as ({VOLUMES_SQL}),
line as ({LINES_SQL}),
terms as (
  select l_orderkey, case when l_orderkey%7=0
         then string_agg(isbn,' '   order by l_linenumber,l_partkey,isbn)
         else string_agg(isbn,' | ' order by l_linenumber,l_partkey,isbn) end as terms
  from line group by l_orderkey),
corpus as ({CORPUS_SQL}),
files as (select * from corpus where {_SUPPORTED})
"""

_FOUND = f"""{_CORPUS},
texted as (select *, length(text) >= GATE as enough from files),
found as (select filepath, {_isbns('isbn10', 'text')} as isbn10s, {_isbns('isbn13', 'text')} as isbn13s
          from texted where enough)
"""

_TERMS = f"""{_FOUND},
listed as (select filepath, len(isbn10s) as n10, list_concat(isbn10s, isbn13s) as isbns from found),
asked as (
  select filepath, ord, case when ord < n10 then 'isbn10' else 'isbn13' end as kind, isbn
  from (select filepath, n10, unnest(range(len(isbns))) as ord, unnest(isbns) as isbn from listed))
"""

_LOOKUPS = f"""{_TERMS},
answers as (
  select unnest([isbn10, isbn13]) as isbn, status, total_items, title as name, p_brand, p_type, p_size,
         isbn10, isbn13 from volumes),
named as (select *, regexp_extract(filepath, '[^/]*$') as base from asked),
google as (
  select n.filepath, n.ord, n.kind, n.isbn, coalesce(status <> 200, true) as failed,
         coalesce(status = 200 and total_items > 0, false) as hit,
         levenshtein(name, base) as d_name, levenshtein(name || ' guide', base) as d_guide,
         name, p_brand, a.isbn10, a.isbn13
  from named n left join answers a on n.isbn = a.isbn),
google_lookups as (
  select filepath, ord, kind, isbn, failed, case when hit then 100.0::double else 0.0::double end as confidence,
         case when not hit then null when d_guide <= d_name then name || ' guide' else name end as title,
         case when hit then least(d_guide, d_name) end as distance,
         case when hit and d_guide > d_name then isbn10 end as isbn10,
         case when hit and d_guide > d_name then isbn13 end as isbn13,
         case when hit then p_brand end as author, 'google' as provider, 0 as provider_ord
  from google),
library_lookups as (
  select n.filepath, n.ord, n.kind, n.isbn, coalesce(p_size > 48, false) as failed,
         case when p_size <= 48 then {LIBRARY_CONFIDENCE}::double else 0.0::double end as confidence,
         case when p_size <= 48 then 'Library ' || name end as title,
         case when p_size <= 48 then levenshtein('Library ' || name, base) end as distance,
         null::varchar as isbn10, null::varchar as isbn13, null::varchar as author,
         'library' as provider, 1 as provider_ord
  from named n left join (select * from answers where p_type = 'ECONOMY') a on n.isbn = a.isbn),
both_lookups as (select * from google_lookups union all select * from library_lookups),
gated as (
  select * from (select *, bool_or(failed) over (partition by filepath, provider) as shut from both_lookups)
  where not shut),
gated_google as (select * from gated where provider = 'google')
"""


def _books(gated: str) -> str:
    """One row per supported file from the gated results of its providers."""
    return f"""
ranked as (
  select *, row_number() over (partition by filepath
      order by (confidence > 0) desc, confidence desc, provider_ord, ord) as place from {gated}),
books as (
  select t.filepath,
         case when not enough then 'no texts extracted'
              when r.filepath is null then 'error: no results found'
              when not r.confidence > 0 then 'could not collate: none of the results had a confidence'
         end as error,
         case when enough and r.confidence > 0 then r.title else '' end as title,
         case when enough and r.confidence > 0 then r.isbn10 end as isbn10,
         case when enough and r.confidence > 0 then r.isbn13 end as isbn13,
         case when enough and r.confidence > 0 and r.provider = 'google' then '1998'
              when enough and r.confidence > 0 then '' end as publish_date,
         case when enough and r.confidence > 0 then r.author end as authors
  from texted t left join (select * from ranked where place = 1) r on t.filepath = r.filepath)
"""


_CACHE = """
cached as (
  select filepath, case when o_orderpriority = '1-URGENT' then '' else 'Cached' end as title,
         case when o_orderpriority = '1-URGENT' then 'no texts extracted' end as error
  from corpus where o_orderstatus = 'F'),
kept as (select * from cached where error is null)
"""

_FLAT = "filepath, title, isbn10, isbn13, publish_date, error, authors"
_FLAT_CACHED = (
    "filepath, title, null::varchar as isbn10, null::varchar as isbn13, "
    "null::varchar as publish_date, error, null::varchar as authors"
)

_GOOGLE_BOOKS = f"with {_LOOKUPS}, {_books('gated_google')}"

_CATALOGUE = f"""{_LOOKUPS},
catalogue_lookups as (
  select n.filepath, n.ord, n.isbn,
         case when name is null then 0.0::double else 100.0::double end as confidence,
         case when d_name <= d_type then name else name || ' ' || p_type end as title,
         least(d_name, d_type) as distance, isbn10, isbn13, p_brand as author,
         'catalogue' as provider, 0 as provider_ord
  from (select n.*, a.name, a.p_type, a.p_brand, a.isbn10, a.isbn13,
               levenshtein(name, base) as d_name, levenshtein(name || ' ' || p_type, base) as d_type
        from named n left join answers a on n.isbn = a.isbn) n)
"""

# The reference's distance, row by row. Lists count from 1 here.
_COMPAT = """
case when strlen(a) < 2 then strlen(b) - 1 when strlen(b) = 1 then strlen(a) - 1 else
  list_reduce(range(0, strlen(a) - 1), lambda p, i:
    list_reduce(range(1, strlen(b)), lambda c, j:
      list_append(c, least(p[j+1] + 1, c[j] + 1,
        (case when i = 0 then p[j] else c[j] end) + case when a[i+1] = b[j] then 0 else 1 end)),
      [i + 1]),
    range(0, strlen(b)))[-1]
end
"""

_HTML = r"regexp_replace(html, '(?s)<!--.*?(?:-->|\z)', ' ', 'g')"
for _pattern in (
    r"(?is)<script\b.*?(?:</script\s*>|\z)",
    r"(?is)<style\b.*?(?:</style\s*>|\z)",
    "<[^<>]*>",
):
    _HTML = f"regexp_replace({_HTML}, '{_pattern}', ' ', 'g')"
for _entity, _char in (
    ("&#39;", "''"), ("&#x27;", "''"), ("&#45;", "-"), ("&#x2d;", "-"), ("&#160;", chr(160)), ("&#8211;", chr(0x2013)),
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&ndash;", chr(0x2013)),
    ("&mdash;", chr(0x2014)), ("&minus;", chr(0x2212)), ("&hyphen;", chr(0x2010)), ("&shy;", chr(0xAD)), ("&amp;", "&"),
):
    _HTML = f"replace({_HTML}, '{_entity}', '{_char}')"


ORACLES = {
    "isbn_runs": f"""
        select doc_id, len({_RUNS['isbn10'].format(text='text')})::int as isbn10_runs,
               len({_RUNS['isbn13'].format(text='text')})::int as isbn13_runs from documents""",
    "document_isbns": f"""
        select doc_id, {_bar(_isbns('isbn10', 'text'))} as isbn10s,
               {_bar(_isbns('isbn13', 'text'))} as isbn13s from documents""",
    "page_isbns": f"""
        select page_id, md5(text) as text_md5, {_bar(_isbns('isbn10', 'text'))} as isbn10s,
               {_bar(_isbns('isbn13', 'text'))} as isbn13s
        from (select page_id, {_HTML} as text from pages)""",
    "identifier_checks": f"""
        with keys as (select event_id, (event_id * 48611)::varchar as k from events),
        numbers as (
          select event_id, unnest([lpad(k, 10, '0'), lpad(k, 9, '0') || 'X',
                                   '978' || lpad(k, 10, '0'), k]) as number from keys)
        select event_id, number, {_candidate('number')} as candidate,
               {_VALID['isbn10'].format(s='number')} as valid10,
               {_VALID['isbn13'].format(s='number')} as valid13 from numbers""",
    "text_gate": f"""
        select doc_id, octet_length(encode(text))::int as n_bytes,
               octet_length(encode(text)) >= {WINDOW} as enough,
               md5(encode(text)[1:{WINDOW}]) as window_md5 from documents""",
    "title_distances": f"""
        select p_partkey, levenshtein(a, b)::int as distance, ({_COMPAT})::int as compat_distance
        from (select p_partkey, p_name as a, replace(p_brand, '#', ' ') || '.epub' as b from part)""",
    "supported_files": f"""
        with {_CORPUS}
        select filepath, regexp_extract(filepath, '[^/]*$') as name, {_EXT} as ext,
               {_SUPPORTED} as supported from corpus""",
    "isbn10_terms": f"""
        with {_FOUND}
        select filepath, unnest(range(len(isbn10s)))::int as ord, unnest(isbn10s) as isbn from found""",
    "isbn13_terms": f"""
        with {_FOUND}
        select filepath, unnest(range(len(isbn13s)))::int as ord, unnest(isbn13s) as isbn from found""",
    "search_terms": f"""
        with {_FOUND}
        select filepath, {_bar('isbn10s')} as isbn10s, {_bar('isbn13s')} as isbn13s from found""",
    "search_terms_size": f"""
        with {_FOUND}
        select len(isbn10s) + len(isbn13s) > 0 as has_terms, count(*) as files,
               sum(len(isbn10s))::bigint as isbn10s, sum(len(isbn13s))::bigint as isbn13s
        from found group by 1""",
    "lookup_terms": f"with {_TERMS} select filepath, ord::int as ord, kind, isbn from asked",
    "gather_texts": f"""
        with {_FOUND},
        second as (
          select c.filepath, {_isbns('isbn10', 't.text')} as isbn10s, {_isbns('isbn13', 't.text')} as isbn13s
          from files c join (
            select l_orderkey, string_agg(isbn, '; ' order by l_linenumber, l_partkey, isbn) as text
            from line where l_returnflag = 'R' group by l_orderkey) t on c.o_orderkey = t.l_orderkey)
        select c.filepath,
               array_to_string(list_concat(coalesce(f.isbn10s, []), coalesce(s.isbn10s, [])), '|') as isbn10s,
               array_to_string(list_concat(coalesce(f.isbn13s, []), coalesce(s.isbn13s, [])), '|') as isbn13s,
               case when f.filepath is null and s.filepath is null then 'no texts extracted' end as error
        from files c left join found f on c.filepath = f.filepath
             left join second s on c.filepath = s.filepath""",
    "lookup_outcomes": f"""
        with {_LOOKUPS}
        select filepath, ord::int as ord, kind, isbn, failed, confidence from google_lookups""",
    "lookup_cache": f"with {_TERMS} select isbn, count(*) as uses from asked group by isbn",
    "title_match": f"""
        with {_LOOKUPS}
        select filepath, ord::int as ord, title, distance::int as distance
        from google_lookups where title is not null""",
    "identifiers_pivot": f"""
        with volumes as ({VOLUMES_SQL}),
        hits as (select unnest([isbn10, isbn13]) as isbn, title, isbn10, isbn13 from volumes
                 where status = 200 and total_items > 0)
        select isbn, 0::bigint as ord, title || ' guide' as title, null::varchar as isbn10,
               null::varchar as isbn13, null::varchar as uom from hits
        union all
        select isbn, 1::bigint, title, isbn10, isbn13, null::varchar from hits""",
    "catalogue_join": f"""
        with {_CATALOGUE}
        select filepath, ord::int as ord, isbn, title, coalesce(distance, -1)::int as distance, confidence
        from catalogue_lookups""",
    "provider_gate": f"""
        with {_LOOKUPS}
        select filepath, provider, count(*) as results from gated group by all""",
    "gather_results": f"""
        with {_LOOKUPS}
        select filepath, provider as source_provider_name, ord::int as ord, title, isbn13, confidence
        from gated""",
    "choose_best": f"""
        with {_LOOKUPS},
        ranked as (
          select *, row_number() over (partition by filepath
              order by (confidence > 0) desc, confidence desc, provider_ord, ord) as place from gated)
        select filepath,
               case when confidence > 0 then provider end as source_provider_name,
               (case when confidence > 0 then ord else -1 end)::int as ord,
               case when confidence > 0 then title end as title,
               case when confidence > 0 then isbn10 end as isbn10,
               case when confidence > 0 then isbn13 end as isbn13,
               case when confidence > 0 then confidence else 0.0::double end as confidence
        from ranked where place = 1""",
    "unidentified": f"""
        with {_LOOKUPS}
        select title is null as unidentified, count(*) as results from google_lookups group by 1""",
    "plan_lookups": f"""
        with {_LOOKUPS},
        demand as (select isbn, count(distinct filepath) as files from asked group by isbn),
        answered as (select isbn from answers where p_type = 'ECONOMY' and p_size <= 48),
        wanted as (
          select 'google' as provider, isbn, files from demand
          where isbn not in (select isbn from answers where status = 200)
          union all
          select 'library', isbn, files from demand where isbn not in (select isbn from answered))
        select provider, isbn, files from wanted order by files desc, isbn, provider limit {BUDGET}""",
    "books_full": f"{_GOOGLE_BOOKS} select {_FLAT} from books",
    "books_compat": f"""
        {_GOOGLE_BOOKS}
        select {_FLAT} from books where error is null or error = 'no texts extracted'""",
    "books_two_providers": f"with {_LOOKUPS}, {_books('gated')} select {_FLAT} from books",
    "books_catalogue": f"""
        with {_CATALOGUE}, {_books('catalogue_lookups')}
        select filepath, title, isbn10, isbn13, case when publish_date is not null then '' end as publish_date,
               error, authors from books""",
    "books_cached": f"""
        {_GOOGLE_BOOKS}, {_CACHE}
        select {_FLAT_CACHED} from cached union all
        select {_FLAT} from books where filepath not in (select filepath from cached)""",
    "books_retried": f"""
        {_GOOGLE_BOOKS}, {_CACHE}
        select {_FLAT_CACHED} from kept union all
        select {_FLAT} from books where filepath not in (select filepath from kept)""",
    "outcomes_summary": f"""
        {_GOOGLE_BOOKS}
        select case when error = 'no texts extracted' then 'extract'
                    when error = 'error: no results found' then 'search' else 'collate' end as stage,
               case when error is null then 'ok' else 'failed' end as status, count(*) as files
        from books group by all""",
    "dry_run": f"""
        {_GOOGLE_BOOKS}, {_CACHE}
        select {_FLAT_CACHED} from cached union all
        select {_FLAT} from books
        where error = 'no texts extracted' and filepath not in (select filepath from cached)""",
    "best_identifier": f"""
        {_GOOGLE_BOOKS}
        select filepath, coalesce(nullif(isbn13, ''), nullif(isbn10, ''), nullif(title, ''), filepath) as identifier
        from books""",
    "book_json": f"""
        {_GOOGLE_BOOKS}
        select '"' || filepath || '"' as key,
               '{{"title":"' || title || '"' ||
               coalesce(',"authors":["' || authors || '"]', '') ||
               coalesce(',"isbn10":"' || isbn10 || '"', '') ||
               coalesce(',"isbn13":"' || isbn13 || '"', '') ||
               coalesce(',"publish_date":"' || nullif(publish_date, '') || '"', '') ||
               ',"filepath":"' || filepath || '"' ||
               coalesce(',"error":"' || error || '"', '') || '}}' as json
        from books""",
    "file_scan": """
        select page_id, case when page_id % 7 = 0 then '.kept/' else '' end || 'page_id=' || page_id as folder,
               '.txt' as ext, octet_length(encode(html))::bigint + 1 as n_bytes,
               md5(html || chr(10)) as text_md5, null::varchar as error from pages""",
    "skip_processed": f"""
        with {_CORPUS}, {_CACHE}
        select filepath from files where filepath not in (select filepath from cached)""",
    "retry_set": f"with {_CORPUS}, {_CACHE} select filepath, title from kept",
    "carry_through": f"""
        with {_CORPUS}, {_CACHE}
        select filepath, title from cached union all
        select filepath, 'New' from corpus where filepath not in (select filepath from cached)""",
    "processed_count": f"with {_CORPUS}, {_CACHE} select count(*) as processed from cached",
}
ORACLES["responses_read"] = f"""
        with volumes as ({VOLUMES_SQL})
        select 'google' as provider, unnest([isbn10, isbn13]) as isbn, status, status = 200 as has_body from volumes"""
ORACLES["two_extractors"] = """
        select page_id, md5(html || chr(10)) as text_md5,
               cast(octet_length(encode(html)) + 1 as varchar) as size, null::varchar as error from pages"""
ORACLES["stage_chain"] = ORACLES["search_terms"]
for _same in ("lines_round_trip", "incremental_stream", "own_writer", "disabled_provider"):
    ORACLES[_same] = ORACLES["books_full"]
ORACLES["object_round_trip"] = (
    f"{_GOOGLE_BOOKS} select {_FLAT.replace('filepath', f'{STORED_PATH} as filepath')} from books"
)

# only these take short texts for failures; the others search every text
_GATED = {"books_full", "books_compat", "outcomes_summary", "dry_run"}
ORACLES = {k: v.replace("GATE", str(FULL_TEXT if k in _GATED else 1)) for k, v in ORACLES.items()}
