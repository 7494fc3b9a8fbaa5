"""The same results in DuckDB SQL, written independently of the operators.

Each text runs on the given tables alone, so the derived views are spelled out as CTEs.
"""

from __future__ import annotations

from folioflow.functions.text import SPACE_CHARS
from folioflow.plans.queries import TEXT_THRESHOLD
from folioflow.plans.views import (
    BILL_FILES, DIM, EXTRACTED, STATUS_EVENTS, TEXT_CASE, UPLOAD_REQUESTS,
)

ORACLES: dict[str, str] = {}

_SP = r"\s\x0b\x1c-\x1f\x85\p{Z}"
_ND = r"\p{Nd}"
_MARKER = rf"(?:{_ND}+\.(?:{_ND}+\.?)*|\(?[a-z]\)|Article[{_SP}]+{_ND}+|Section[{_SP}]+{_ND}+)"
_CLAUSE = rf"(\n[{_SP}]*{_MARKER})"
_TRIM = "".join(f"||chr({ord(c)})" for c in SPACE_CHARS)[2:]


def _with(*ctes: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(ctes) + "\n"


def _trim(text: str) -> str:
    return f"trim({text}, {_TRIM})"


_EXTRACTED = "extracted as (" + EXTRACTED.format(
    table="documents", text=TEXT_CASE.format(mask="regexp_replace(text, '[a-z]', '#', 'g')")
) + ")"
_INDEXABLE = "indexable as (select * from extracted where status = 'success' and text <> '')"
_EVENTS = "status_events as (" + STATUS_EVENTS.format(table="events") + ")"
_UPLOADS = f"""upload_requests as ({UPLOAD_REQUESTS.format(table="orders")}),
checked as (
  select * replace (coalesce(mime_type, 'application/pdf') as mime_type),
    case when coalesce(user_id, '') = '' or coalesce(filename, '') = '' or coalesce(file_size, 0) = 0
        then 'Missing required fields'
      when not contains(coalesce(mime_type, 'application/pdf'), 'pdf') then 'Only PDF files are supported'
      when file_size > 52428800 then 'File size must be less than 50MB' end as reject_reason
  from upload_requests),
accepted as (
  select *, 'raw/' || user_id || '/' || doc_id || '/' || filename as storage_path from (
    select *, 'doc_' || substr(sha256(concat_ws(chr(1), user_id, filename,
        strftime(upload_time, '%Y-%m-%d %H:%M:%S'))), 1, 32) as doc_id
    from checked where reject_reason is null)
  qualify row_number() over (partition by doc_id order by file_size desc, mime_type desc) = 1)"""
_DOCS_META = """documents_meta as (
  select 'doc_' || doc_id as doc_id, source as user_id, 'uploaded' as status,
    'file_' || doc_id || '.pdf' as filename, n_chars as file_size, null::int as page_count,
    'raw/' || source || '/doc_' || doc_id || '/file_' || doc_id || '.pdf' as storage_path,
    null::varchar as ocr_result_path,
    timestamp '2024-01-01 00:00:00' + to_minutes(doc_id) as created_at,
    timestamp '2024-01-01 00:00:00' + to_minutes(doc_id) as updated_at,
    null::varchar as error_message, 0 as retry_count
  from documents)"""
_FLAT = ("doc_id, user_id, status, filename, file_size, page_count, storage_path, ocr_result_path, "
         "created_at, updated_at, error_message")
_LATEST = """latest as (
  select * from status_events
  qualify row_number() over (partition by doc_id order by updated_at desc, event_id desc) = 1)"""

# ---- clause and fixed-size chunks ----------------------------------------------------

_PARTS = f"""parts as (
  select doc_id, user_id, filename, string_split(
    regexp_replace(text, '{_CLAUSE}', chr(1) || '\\1' || chr(1), 'g'), chr(1)) as p
  from indexable)"""
_FOLD = f"""fold(doc_id, i, cur, st, done, done_st, n) as (
  select doc_id, 1, '', 0, null::varchar, null::bigint, 0 from parts
  union all
  select f.doc_id, i + 1,
    case when length(cur) + length(p[i]) > 500 then p[i] else cur || p[i] end,
    case when length(cur) + length(p[i]) > 500 then st + length(cur) else st end,
    case when length(cur) + length(p[i]) > 500 and {_trim('cur')} <> '' then {_trim('cur')} end,
    st + length(cur) - length(l{_trim('cur')}),
    n + case when length(cur) + length(p[i]) > 500 and {_trim('cur')} <> '' then 1 else 0 end
  from fold f join parts using (doc_id) where i <= len(p)),
pieces as (
  select doc_id, n - 1 as chunk_index, done as text, done_st as st from fold where done is not null
  union all
  select f.doc_id, n, {_trim('cur')}, st + length(cur) - length(l{_trim('cur')}) from fold f join parts using (doc_id)
  where i = len(p) + 1 and {_trim('cur')} <> '')"""
_CHUNKS = """chunks as (
  select doc_id || '_' || chunk_index as chunk_id, doc_id, user_id, filename,
    chunk_index::int as chunk_index, pieces.text as text
  from pieces join indexable using (doc_id))"""
# Lines are pages, so a chunk's page is the number of line ends before it, and one.
_PAGE_OF = "(1 + length(substr(text, 1, st)) - length(replace(substr(text, 1, st), chr(10), '')))::int"
_PAGED = f"""paged as (
  select doc_id || '_' || chunk_index as chunk_id, {_PAGE_OF.replace('(text', '(indexable.text')} as page_number
  from pieces join indexable using (doc_id))"""
_CLAUSE_CTES = (_EXTRACTED, _INDEXABLE, _PARTS, _FOLD, _CHUNKS)

_FIXED = f"""cut(doc_id, st, en) as (
  select doc_id, -1, 0 from indexable
  union all
  select doc_id, st, case when st + 500 >= length(text) then length(text)
      else st + coalesce(nullif(length(regexp_extract(substr(text, st + 1, 500), '^((?s:.)*[.\\n?])')), 0), 500)
    end
  from (
    select doc_id, text,
      case when cut.st = -1 then 0 when cut.en - 50 > cut.st then cut.en - 50 else cut.en end as st
    from cut join indexable using (doc_id) where cut.st = -1 or cut.en < length(text))),
fixed as (
  select doc_id, (row_number() over (partition by doc_id order by st) - 1)::int as chunk_index, piece as text,
    st + length(raw) - length(l{_trim('raw')}) as st
  from (select doc_id, st, raw, {_trim('raw')} as piece
        from (select doc_id, st, substr(text, st + 1, en - st) as raw from cut join indexable using (doc_id) where st >= 0))
  where piece <> '')"""


def _clause(select: str, *more: str) -> str:
    return _with(*_CLAUSE_CTES, *more, recursive=True) + select


# ---- hashed text vectors and hits ----------------------------------------------------


def _hashed(name: str, source: str, key: str, column: str) -> str:
    return f"""{name} as (
  select *, (w / sqrt(sum(w * w) over (partition by {key})))::float::double as weight from (
    select {key}, slot, sum(sign)::double as w from (
      select {key}, ((strpos('0123456789abcdef', h[1]) - 1) * 4096 + (strpos('0123456789abcdef', h[2]) - 1) * 256
          + (strpos('0123456789abcdef', h[3]) - 1) * 16 + strpos('0123456789abcdef', h[4]) - 1) % {DIM} as slot,
        case when h[5] < '8' then 1 else -1 end as sign
      from (select {key}, md5(token) as h from (
        select {key}, unnest(string_split_regex(lower({column}), '[{_SP}]+')) as token from {source})
        where token <> ''))
    group by all) where w <> 0)"""


_QUESTIONS = """questions as (
  select 'q' || item_id as query_id, text as query_text, 'src' || (item_id % 20) as user_id
  from benchmark)"""
_CHUNK_VECTORS = _hashed("chunk_vectors", "chunks", "chunk_id", "text")
_QUESTION_VECTORS = _hashed("question_vectors", "questions", "query_id", "query_text")
_HITS = f"""hits as (
  select *, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from (
    select query_id, chunk_id, round(dot / (sqrt(qq) * sqrt(cc)), 6) as score from (
      select query_id, chunk_id, sum(q.weight * c.weight) as dot
      from question_vectors q join questions qs using (query_id)
        join chunks ch on ch.user_id = qs.user_id
        join chunk_vectors c using (chunk_id, slot)
      group by query_id, chunk_id)
    join (select query_id, sum(weight * weight) as qq from question_vectors group by 1) using (query_id)
    join (select chunk_id, sum(weight * weight) as cc from chunk_vectors group by 1) using (chunk_id))
  where score >= {TEXT_THRESHOLD}
  qualify rank <= 5)"""
_HIT_CTES = (_PAGED, _QUESTIONS, _CHUNK_VECTORS, _QUESTION_VECTORS, _HITS)
_CONTEXTS = """contexts as (
  select query_id, string_agg('[Document ' || rank || ']' || chr(10) || text || chr(10) || 'Source: ' || doc_id
      || ', Page: ' || page_number || chr(10), chr(10) order by rank) as context
  from hits join chunks using (chunk_id) join paged using (chunk_id) group by query_id)"""
_PROMPT_HEAD = "Use the document excerpts below to answer the question.\n\nEXCERPTS\n"
_PROMPT_TAIL = (
    "\n\nRely on the excerpts alone and say so when they are not sufficient. Name the document\n"
    "and page behind each statement and explain how you reached the conclusion.\n"
    'Reply with one JSON object holding "answer", "reasoning", "confidence" (high, medium\n'
    'or low) and "requires_clarification" (true or false).\n'
)
_PROMPTS = f"""prompts as (
  select query_id, '{_PROMPT_HEAD}' || coalesce(context, '') || '\n\nQUESTION\n' || query_text
    || '{_PROMPT_TAIL}' as prompt
  from questions left join contexts using (query_id))"""


def _rag(select: str, *more: str) -> str:
    return _clause(select, *_HIT_CTES, *more)


# ---- quality -------------------------------------------------------------------------

_MILLI = """case when 2 * ((n * 1000) % l) > l then n * 1000 // l + 1
      when 2 * ((n * 1000) % l) < l then n * 1000 // l
      when gap > 0 then n * 1000 // l + 1 when gap < 0 then n * 1000 // l
      else n * 1000 // l + (n * 1000 // l) % 2 end"""


def _noise(source: str, where: str = "") -> str:
    """n noise characters of l; gap tells on which side of a tie the double lies."""
    return f"""counted as (
  select *, (hi * 2000 - (2 * (n * 1000 // l) + 1)) + (v - hi) * 2000 as gap from (
    select *, v * 134217729.0::double - (v * 134217729.0::double - v) as hi from (
      select *, n::double / l::double as v from (
        select *, length(regexp_replace(text, '[\\p{{L}}\\p{{N}}{_SP}]', '', 'g')) as n,
          greatest(length(text), 1) as l
        from {source} {where}))))"""


_REPORT = _noise("extracted") + f""",
measured as (
  select *, status = 'success' and text <> '' as usable, {_MILLI} as milli,
    len(regexp_extract_all(text, '[^{_SP}]+')) as words
  from counted),
rated as (
  select *, not usable or l < 100 as is_empty, usable and milli > 400 as is_noisy from measured),
report as (
  select doc_id, user_id, filename, status as ocr_status, page_count,
    case when usable then l else 0 end::int as text_length,
    case when usable then words else 0 end::int as word_count,
    case when usable then milli / 1000.0::double else 0 end as noise_ratio,
    case when usable then greatest(1, trunc(l / 500 * 1.1::double)) else 0 end::int as est_chunks,
    is_empty, is_noisy, is_empty or is_noisy as needs_review,
    case when not usable then 'ocr_failed: ' || status
      when is_empty and is_noisy then 'empty_and_noisy'
      when is_empty then 'too_short (' || l || ' chars)'
      when is_noisy then 'high_noise (' || round_even(milli / 1000.0::double * 100, 0)::int || '% non-alnum)'
      end as review_reason
  from rated)"""
_SUMMARY = """summary as (
  select count(*) as total_docs, count(*) filter (ocr_status = 'success') as success_docs,
    count(*) filter (ocr_status <> 'success') as failed_docs,
    count(*) filter (needs_review) as needs_review_docs,
    sum(page_count)::bigint as total_pages, avg(page_count) as avg_pages_per_doc,
    avg(text_length) as avg_text_length,
    quantile_disc(text_length, 0.5) as p50_text_length, quantile_disc(text_length, 0.95) as p95_text_length,
    avg(word_count) as avg_word_count,
    sum(round(noise_ratio * 1000)::bigint) / count(*) / 1000 as avg_noise_ratio,
    sum(est_chunks)::bigint as est_total_chunks, sum(text_length)::bigint as total_chars
  from report)"""
_COST = """select total_docs, success_docs, failed_docs, needs_review_docs,
  round(success_docs / total_docs * 100, 1) as success_rate_pct, total_pages,
  round(avg_pages_per_doc, 1) as avg_pages_per_doc, round(avg_text_length, 0) as avg_text_length,
  p50_text_length, p95_text_length, round(avg_word_count, 0) as avg_word_count,
  round(avg_noise_ratio, 3) as avg_noise_ratio, est_total_chunks,
  round(total_chars / 4.0::double, 0) as est_total_tokens,
  round(total_chars / 4.0::double / 1000000 * 0.02::double, 4) as est_cost_usd
from summary"""


def _quality(select: str, *more: str) -> str:
    return _with(_EXTRACTED, _REPORT, *more) + select


_STAGE = _with(_EXTRACTED) + (
    "select doc_id, user_id, page_count, status, error, md5(text) as text_md5 from extracted"
)
# What the built-in extractor makes of the derived files: lines are pages.
_OUTCOME = """outcome as (
  select 'doc_' || doc_id as doc_id, source as user_id, 'file_' || doc_id || '.pdf' as filename,
    'gs://bucket/raw/' || source || '/doc_' || doc_id || '/file_' || doc_id || '.pdf' as source_path,
    case when doc_id % 37 = 5 then '' else replace(text, chr(10), chr(10) || chr(10)) end as text,
    case when doc_id % 37 = 5 then 0 else len(string_split(text, chr(10))) end::int as page_count,
    case when doc_id % 37 = 5 then 'failed' else 'success' end as status
  from documents)"""

ORACLES["parse_storage_path"] = _with(
    _EXTRACTED,
    "given as (select source_path as path from extracted union all select url from pages)",
    "cut as (select path, list_filter(string_split(path, '/'), lambda x: x not in ('', 'gs:')) as p from given)",
    "found as (select *, coalesce(list_position(p, 'raw'), 0) as r from cut)",
) + """select path,
  case when r > 0 and len(p) >= r + 2 then p[r + 1] else 'unknown' end as user_id,
  case when r > 0 and len(p) >= r + 2 then p[r + 2] when len(p) >= 2 then p[len(p) - 1] else 'unknown' end as doc_id,
  coalesce(p[len(p)], 'unknown') as filename
from found"""
ORACLES["scan_extracted"] = _STAGE
ORACLES["scan_parquet_stage"] = _STAGE
ORACLES["write_extracted"] = _with(_OUTCOME) + "select doc_id, source_path, page_count, status from outcome"
ORACLES["write_doc_report"] = _quality("select * from report")
ORACLES["write_checkpoint"] = _clause(
    "select chunk_id, doc_id, user_id, filename, chunk_index, 'indexed' as status, md5(text) as text_md5 from chunks"
)
ORACLES["write_summary"] = _quality(_COST, _SUMMARY)
ORACLES["register_uploads"] = _with(_UPLOADS) + """select doc_id, user_id, filename, file_size, mime_type,
  upload_time, storage_path, 'uploaded' as status from accepted"""
ORACLES["rejected_uploads"] = _with(_UPLOADS) + "select * from checked where reject_reason is not null"
ORACLES["select_preferred_version"] = _with(
    "files as (" + BILL_FILES.format(table="orders join customer on o_custkey = c_custkey") + ")",
    r"named as (select path, regexp_extract(path, 'BILLS-118hr(\d+)([a-z]+)\.pdf$', ['bill', 'ver']) as b from files)",
    "ranked as (select b.bill as bill, path, list_position(['ih', 'enr', 'eh', 'rfs', 'rs'], b.ver) as rank from named)",
) + """select distinct bill, path, rank::bigint as rank from ranked where rank is not null
qualify row_number() over (partition by bill order by rank, path) = 1"""
ORACLES["flatten_struct"] = _with(_EXTRACTED) + (
    "select doc_id, length(text)::int as chars, page_count as pages, status as ocr_status from extracted"
)
ORACLES["filter_indexable"] = _with(_EXTRACTED, _INDEXABLE) + (
    "select doc_id, user_id, page_count, length(text)::int as chars from indexable"
)
ORACLES["filter_failed"] = _with(_OUTCOME) + """
select doc_id, source_path, '''utf-8'' codec can''t decode byte 0xff in position 0: invalid start byte' as error
from outcome where status = 'failed'"""
# The files as they are stored: form feeds for line ends, some not UTF-8.
_FILES = r"""files as (
  select 'file_' || doc_id || '.pdf' as filename,
    case when doc_id % 37 = 5 then '\xFF'::blob else ''::blob end || encode(replace(text, chr(10), chr(12))) as content
  from documents where text is not null)"""
ORACLES["scan_raw_files"] = _with(_FILES) + """
select filename, octet_length(content)::bigint as length, octet_length(content)::int as bytes_read,
  sha256(content) as digest from files"""
ORACLES["file_manifest"] = _with(_FILES) + """
select filename, 'legal_documents/' || filename as object_key, round(octet_length(content) / 1024.0::double, 1) as size_kb
from files"""
ORACLES["poll_trigger"] = _with(_FILES) + "select filename, octet_length(content)::bigint as length from files"
ORACLES["filter_flagged"] = _quality(
    """select doc_id, filename, ocr_status, text_length, noise_ratio, review_reason
from report where needs_review"""
)
_VPOINTS = """vpoints as (
  select 'c' || vec_id as chunk_id, 'doc_' || (vec_id % 50) as doc_id, 'u' || (label % 3) as user_id, label,
    embedding::double[] as vector from embeddings)"""
_VQUERIES = """vqueries as (
  select 'q' || vec_id as query_id, 'u' || (label % 3) as user_id, vec_id, label,
    embedding::double[] as vector from embeddings)"""
ORACLES["filter_searchable"] = _with(_VPOINTS, _EVENTS, _LATEST, _DOCS_META) + """
select chunk_id, p.doc_id, p.user_id from vpoints p
where p.doc_id in (select d.doc_id from documents_meta d left join latest l on l.doc_id = d.doc_id
                   where coalesce(l.status, d.status) in ('ready', 'indexed'))"""
ORACLES["null_defaults"] = """
select 'doc_' || d.doc_id as doc_id,
  case when quality = 1 then ceil(n_chars / 1800.0) else 1 end::int as page_count,
  length(coalesce(text, ''))::int as chars, coalesce(toxic, -1)::int as toxic,
  case when quality is null then 'unknown' else source end as user_id
from documents d left join labels l on l.doc_id = d.doc_id"""
ORACLES["extract_documents"] = _with(_OUTCOME) + """
select doc_id, user_id, filename, source_path, page_count, status, status = 'failed' as has_error,
  md5(text) as text_md5 from outcome"""
ORACLES["join_pages"] = """
select 'doc_' || doc_id as doc_id, count(*)::int as page_count,
  length(string_agg(page, chr(10) || chr(10) order by page_no))::int as chars,
  md5(string_agg(page, chr(10) || chr(10) order by page_no)) as text_md5
from (select doc_id, unnest(string_split(text, chr(10))) as page,
        unnest(range(len(string_split(text, chr(10))))) as page_no from documents)
group by doc_id"""
ORACLES["extraction_counts"] = _with(_OUTCOME) + """
select count(*) as total, count(*) filter (status = 'success') as success,
  count(*) filter (status <> 'success') as failed from outcome"""

ORACLES["split_clauses"] = _with(_EXTRACTED) + f"""
select doc_id, (row_number() over (partition by doc_id order by o) - 1)::int as part_no, part from (
  select doc_id, unnest(p) as part, unnest(range(len(p))) as o from (
    select doc_id, string_split(regexp_replace(text, '{_CLAUSE}', chr(1) || '\\1' || chr(1), 'g'), chr(1)) as p
    from extracted))"""
ORACLES["chunk_clauses"] = _clause("select doc_id, chunk_index, text from chunks")
ORACLES["chunk_fixed"] = _with(_EXTRACTED, _INDEXABLE, _FIXED, recursive=True) + (
    "select doc_id, chunk_index, text from fixed"
)


def _split_at(number: int, separator: str) -> str:
    """Pieces that are too long and hold the separator, cut before each of it."""
    return f"""level{number} as (
  select doc_id, flatten(list_transform(p, lambda x: case when length(x) > 500 and contains(x, {separator}) then
    list_filter(list_transform(string_split(x, {separator}), lambda y, i: case when i = 1 then y else {separator} || y end),
      lambda z: z <> '') else [x] end)) as p
  from level{number - 1})"""


# Pieces are gathered up to 500 characters; what stays of the last chunk has 50 at most and room for the next piece.
_GATHERED = """gather(doc_id, i, win, done) as (
  select doc_id, 1, []::varchar[], null::varchar from level4
  union all
  select doc_id, i + 1, case when over then list_append(win[1 + list_min(list_filter(range(0, len(win) + 1),
      lambda k: k = len(win) or (length(array_to_string(win[k + 1:], '')) <= 50
        and length(array_to_string(win[k + 1:], '')) + length(piece) <= 500))):], piece) else list_append(win, piece) end,
    case when over then array_to_string(win, '') end
  from (
    select doc_id, i, win, p[i] as piece, len(win) > 0 and length(array_to_string(win, '')) + length(p[i]) > 500 as over
    from gather join level4 using (doc_id) where i <= len(p))),
gathered as (
  select doc_id, i, done as piece from gather where done is not null
  union all
  select doc_id, i + 1, array_to_string(win, '') from gather join level4 using (doc_id) where i = len(p) + 1)"""
ORACLES["chunk_recursive"] = _with(
    _EXTRACTED, _INDEXABLE, "level0 as (select doc_id, [text] as p from indexable)",
    *[_split_at(i, x) for i, x in enumerate(("chr(10) || chr(10)", "chr(10)", "'.'", "';'"), 1)], _GATHERED, recursive=True,
) + f"""select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as chunk_index, {_trim('piece')} as text
from gathered where {_trim('piece')} <> ''"""
ORACLES["chunk_mode"] = _clause(
    """select doc_id, 'clause' as mode, count(*) as chunks, max(length(text))::int as longest from chunks group by 1
union all
select doc_id, 'fixed', count(*), max(length(text))::int from fixed group by 1""",
    _FIXED,
)
ORACLES["chunk_ids"] = _clause("select chunk_id, doc_id, chunk_index from chunks")
ORACLES["explode_chunks"] = _clause("select * from chunks")
ORACLES["chunk_counts"] = _clause(
    "select (select count(*) from indexable) as docs, (select count(*) from chunks) as chunks"
)
ORACLES["chunk_links"] = _clause(
    """select chunk_id, lag(chunk_id) over w as prev_chunk_id, lead(chunk_id) over w as next_chunk_id
from chunks window w as (partition by doc_id order by chunk_index)"""
)
ORACLES["chunk_pages"] = _clause(
    f"""select 'clause' as mode, chunk_id, page_number from paged union all
select 'fixed', fixed.doc_id || '_' || chunk_index, {_PAGE_OF.replace('(text', '(indexable.text').replace(', st', ', fixed.st')}
from fixed join indexable using (doc_id)""",
    _PAGED, _FIXED,
)
ORACLES["chunk_clause_meta"] = _clause(
    rf"""select chunk_id, clause as clause_number,
  case when starts_with(clause, 'Article') then 'article' when starts_with(clause, 'Section') then 'section'
    when regexp_matches(clause, '^{_ND}') then 'numbered' when clause is not null then 'lettered' end as section_type,
  coalesce(opening, last_value(inner_last ignore nulls) over (
    partition by doc_id order by chunk_index rows between unbounded preceding and 1 preceding)) as parent_section
from (
  select *, nullif(regexp_extract(text, '^({_MARKER})', 1), '') as clause,
    nullif(regexp_extract(text, '^((?:Article|Section)[{_SP}]+{_ND}+)', 1), '') as opening,
    regexp_extract_all(text, '(?:^|\n)[{_SP}]*((?:Article|Section)[{_SP}]+{_ND}+)', 1)[-1] as inner_last
  from chunks)"""
)

ORACLES["text_length"] = "select doc_id, length(text)::int as text_length from documents"
ORACLES["word_count"] = (
    f"select doc_id, len(regexp_extract_all(text, '[^{_SP}]+'))::int as word_count from documents"
)
_NOISE_RATIO = f"select doc_id, ({_MILLI}) / 1000.0::double as noise_ratio from counted"
ORACLES["noise_ratio"] = _with(_EXTRACTED, _noise("extracted")) + _NOISE_RATIO
ORACLES["est_chunks"] = """
select doc_id, greatest(1, trunc(length(text) / 500 * 1.1::double))::int as est_chunks from documents"""
ORACLES["quality_flags"] = _quality("select doc_id, is_empty, is_noisy, needs_review from report")
ORACLES["review_reason"] = _quality("select doc_id, review_reason from report")


def _uuid5(column: str) -> str:
    h = f"sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({column}))"
    return (
        f"substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||"
        f"substr('89ab', ((strpos('0123456789abcdef', substr({h},17,1)) - 1) % 4 + 1)::int, 1)"
        f"||substr({h},18,3)||'-'||substr({h},21,12)"
    )


ORACLES["point_id"] = _clause(f"select chunk_id, {_uuid5('chunk_id')} as point_id from chunks")
ORACLES["citation_snippet"] = "select doc_id, substr(text, 1, 200) || '...' as snippet from documents"
ORACLES["percent_label"] = _with(
    _EXTRACTED, _noise("extracted"), f"ratios as ({_NOISE_RATIO})"
) + """select doc_id, (floor(noise_ratio * 100 + 0.5))::decimal(12, 0) || '%' as label,
  (floor(noise_ratio * 100 * 10 + 0.5) / 10)::decimal(12, 1) || '%' as label_1 from ratios"""
ORACLES["status_label"] = _with(_EVENTS) + """
select event_id, status, case status when 'uploaded' then 'Uploaded' when 'ocr_processing' then 'Processing'
  when 'ocr_completed' then 'OCR Done' when 'indexed' then 'Ready' else 'Failed' end as label
from status_events"""
_DATA = """sent as (
  select doc_id, case when length(text) < 100 then filename else to_base64(encode(
    '{"doc_id":"' || doc_id || '","user_id":"' || user_id || '","storage_path":"' || source_path || '"}'))
    end as data, length(text) >= 100 as fine, user_id, source_path from extracted)"""
ORACLES["encode_event"] = _with(_EXTRACTED, _DATA) + "select doc_id, data from sent"
ORACLES["decode_event"] = _with(_EXTRACTED, _DATA) + """
select doc_id as sent_id, case when fine then doc_id end as doc_id, case when fine then user_id end as user_id,
  case when fine then source_path end as storage_path from sent"""
ORACLES["parse_answer_json"] = """
select 'q_' || conv_id || '_' || turn as query_id, case when kind > 1 then text end as answer,
  case when kind = 0 then '' else role end as reasoning,
  case when kind = 0 then 'Failed to parse JSON' when kind = 1 then '''answer''' end as error,
  case when kind = 0 then text end as raw, case when kind > 1 then 'success' else 'failed' end as status
from (select *, (conv_id + turn) % 5 as kind from conversations)"""

ORACLES["doc_quality"] = _quality("select * from report")
ORACLES["corpus_summary"] = _quality(
    """select * replace (round(avg_pages_per_doc, 6) as avg_pages_per_doc, round(avg_text_length, 6) as avg_text_length,
  round(avg_word_count, 6) as avg_word_count, round(avg_noise_ratio, 6) as avg_noise_ratio) from summary""",
    _SUMMARY,
)
ORACLES["cost_estimate"] = _quality(_COST, _SUMMARY)
ORACLES["user_breakdown"] = _quality(
    """select user_id, count(*) as doc_count, sum(est_chunks)::bigint as est_chunks,
  count(*) filter (needs_review) as flagged from report group by user_id"""
)
ORACLES["status_counts"] = _with(_OUTCOME) + "select status, count(*) as docs from outcome group by status"
ORACLES["quality_gate"] = _quality(
    "select doc_id, user_id, page_count from report where not needs_review"
)

ORACLES["embed_chunks"] = _clause(
    "select chunk_id, slot::int as slot, round(weight, 6) as weight from chunk_vectors", _CHUNK_VECTORS
)
ORACLES["embed_query"] = _with(_QUESTIONS, _QUESTION_VECTORS) + (
    "select query_id, slot::int as slot, round(weight, 6) as weight from question_vectors"
)
ORACLES["embed_checkpoint"] = _clause("select *, 'indexed' as status from chunks")
ORACLES["build_points"] = _clause(f"select {_uuid5('chunk_id')} as point_id, *, {DIM} as dim from chunks")
_LABELLED = f"""stored as (
  select {_uuid5('chunk_id')} as point_id, chunk_id, doc_id, label as value from vpoints),
incoming as (
  select {_uuid5('chunk_id')} as point_id, * from (
    select 'c' || (doc_id * 2) as chunk_id, 'doc_' || (doc_id % 50) as doc_id,
      (100 * 2 + 10 * quality + toxic)::int as value from labels))"""
_UPSERTED = _with(_VPOINTS, _LABELLED) + """
select * from stored where point_id not in (select point_id from incoming) union all select * from incoming"""
ORACLES["upsert_points"] = _UPSERTED
ORACLES["upsert_points_stored"] = _UPSERTED
ORACLES["delete_points"] = _with(_VPOINTS, _LABELLED) + (
    "select * from stored where point_id not in (select point_id from incoming)"
)
_SEARCHABLE = """searchable as (
  select d.doc_id, coalesce(l.status, d.status) as status from documents_meta d left join latest l on l.doc_id = d.doc_id)"""
ORACLES["collection_delete"] = _with(_VPOINTS, _EVENTS, _LATEST, _DOCS_META, _SEARCHABLE) + f"""
select {_uuid5('chunk_id')} as point_id, chunk_id, doc_id, label from vpoints
where label <> 3 and doc_id not in (select doc_id from searchable where status = 'ocr_failed')"""
ORACLES["reindex_doc"] = ORACLES["collection_reindex"] = _clause(
    """select chunk_id, doc_id, user_id, chunk_index, text from chunks where doc_id not in (select doc_id from redone)
union all
select fixed.doc_id || '_' || chunk_index, fixed.doc_id, user_id, chunk_index, fixed.text
from fixed join indexable using (doc_id) where fixed.doc_id in (select doc_id from redone)""",
    _FIXED,
    "redone as (select distinct 'doc_' || doc_id as doc_id from labels where quality = 1)",
)
ORACLES["create_collection"] = """
select len(embedding)::int as dim, count(*) as points, 'cosine' as metric from embeddings group by 1"""


def _nearest(
    score: str = "list_cosine_similarity(q.vector, p.vector)", where: str = "score >= 0",
    pairs: str = "true", order: str = "score desc", k: str = "5",
) -> str:
    return _with(_VPOINTS, _VQUERIES) + f"""
select query_id, chunk_id, doc_id, score,
  row_number() over (partition by query_id order by {order}, chunk_id)::int as rank
from (select q.query_id, q.vec_id, p.chunk_id, p.doc_id, round({score}, 6) as score
      from vqueries q join vpoints p on p.user_id = q.user_id where {pairs})
where {where} qualify rank <= {k}"""


ORACLES["collection_search"] = _with(_VPOINTS, _VQUERIES, _EVENTS, _LATEST, _DOCS_META, _SEARCHABLE) + """
select query_id, chunk_id, doc_id, score, row_number() over (partition by query_id order by score, chunk_id)::int as rank
from (select q.query_id, p.chunk_id, p.doc_id, round(list_distance(q.vector, p.vector), 6) as score
      from vqueries q join vpoints p on p.user_id = q.user_id
      where p.doc_id in (select doc_id from searchable where status in ('ready', 'indexed')))
where score <= 1.3 qualify rank <= 5"""
ORACLES["knn_rejected"] = """
select 'q' || vec_id as query_id, case when label = 4 then 'no vector' when vec_id % 20 < 3 then 'top_k out of range'
    else 'no tenant' end as reject_reason
from embeddings where label in (4, 5) or vec_id % 20 < 3"""
for _name in ("knn_cosine", "knn_cosine_blocks", "knn_approx_all_lists"):
    ORACLES[_name] = _nearest()
# Centres are given: the first vectors. Every point and question goes by its nearest ones.
_LISTED = """units as (
  select vec_id, list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as u
  from embeddings),
near as (
  select v.vec_id, c.vec_id as list, row_number() over (
    partition by v.vec_id order by round(list_dot_product(v.u, c.u) * -2, 12), c.vec_id) as n
  from units v, units c where c.vec_id < 16)"""
ORACLES["knn_approx"] = _with(_VPOINTS, _VQUERIES, _LISTED) + """
select query_id, chunk_id, doc_id, score, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank
from (select q.query_id, p.chunk_id, p.doc_id, round(list_cosine_similarity(q.vector, p.vector), 6) as score
      from vqueries q join near a on a.vec_id = q.vec_id and a.n <= 6
        join near b on b.list = a.list and b.n = 1
        join vpoints p on p.chunk_id = 'c' || b.vec_id and p.user_id = q.user_id)
where score >= 0 qualify rank <= 5"""
ORACLES["knn_dot"] = _nearest("list_dot_product(q.vector, p.vector)", k="1 + vec_id % 20")
ORACLES["knn_euclidean"] = _nearest("list_distance(q.vector, p.vector)", "score <= 1.3", order="score")
ORACLES["filter_eq"] = _nearest(where="score >= 0.1", pairs="p.label = 3")
ORACLES["filter_in"] = _nearest(
    pairs="q.label % 2 = 1 or list_contains(list_transform(range(10), "
    "lambda i: 'doc_' || ((q.vec_id % 50 + i) % 50)), p.doc_id)"
)
ORACLES["filter_range"] = _nearest(pairs="p.label > 2 and p.label <= 7")
ORACLES["score_threshold"] = _nearest(where="score >= 0.2")
ORACLES["top_k_bounds"] = """
select query_id, user_id, top_k, case when coalesce(query_text, '') = '' then 'Missing required fields'
    when top_k not between 1 and 20 then 'top_k out of range' end as reject_reason
from (select 'q_' || conv_id || '_' || turn as query_id, text as query_text,
    case when role = 'user' then 'u' || conv_id else 'bot' end as user_id,
    case when conv_id % 30 <> 7 then conv_id % 30 else 5 end::int as top_k
  from conversations)"""
ORACLES["format_hits"] = _rag(
    """select query_id, rank, chunk_id, text, score, doc_id, user_id, filename
from hits join chunks using (chunk_id)"""
)

ORACLES["build_context"] = _rag("select * from contexts", _CONTEXTS)
ORACLES["build_citations"] = _rag(
    """select query_id, (rank - 1)::int as position, doc_id, chunk_id, substr(text, 1, 200) || '...' as text,
  page_number, score as confidence
from hits join chunks using (chunk_id) join paged using (chunk_id)"""
)
_CONFIDENCE = """confidences as (
  select query_id, round(coalesce(avg(score), 0), 6) as confidence, count(score) as chunks_retrieved
  from questions left join hits using (query_id) group by query_id)"""
ORACLES["answer_confidence"] = _rag("select * from confidences", _CONFIDENCE)
ORACLES["confidence_band"] = _rag(
    """select query_id, rank,
  case when score >= 0.8 then 'High' when score >= 0.6 then 'Medium' else 'Low' end as band,
  (floor(score * 100 + 0.5))::decimal(12, 0) || '%' as label from hits"""
)
ORACLES["build_prompts"] = _rag("select * from prompts", _CONTEXTS, _PROMPTS)
ORACLES["clause_prompts"] = _clause(
    """select chunk_id, 'Study this contract clause.\n\nCLAUSE\n' || text ||
'\n\nReply in JSON with its type, the parties, their obligations, dates and deadlines,
conditions and exceptions, and possible risks or unclear wording.\n' as prompt from chunks"""
)
ORACLES["compare_prompts"] = _clause(
    """select chunk_id, 'Compare two contract clauses.\n\nFIRST CLAUSE\n' || before || '\n\nSECOND CLAUSE\n' || text ||
'\n\nDescribe what they share, where they differ, whom each favours, where they conflict,
and what you would recommend.\n' as prompt
from (select *, lag(text) over (partition by doc_id order by chunk_index) as before from chunks)
where before is not null"""
)
ORACLES["complete_prompts"] = _rag(
    """select query_id, 'prompt of ' || length(prompt) || ' characters' as answer, '' as reasoning,
  null::varchar as error, null::varchar as raw, 'success' as status from prompts""",
    _CONTEXTS, _PROMPTS,
)
ORACLES["assemble_results"] = _rag(
    """select query_id, query_text as query, 'prompt of ' || length(prompt) || ' characters' as answer,
  chunks_retrieved::int as citations, '' as reasoning, confidence,
  chunks_retrieved::varchar as chunks_retrieved, 'counting' as model, 'success' as status
from questions join prompts using (query_id) join confidences using (query_id)""",
    _CONTEXTS, _PROMPTS, _CONFIDENCE,
)

ORACLES["documents_put"] = _with(_DOCS_META, _UPLOADS) + f"""
select {_FLAT} , retry_count from (
  select * replace (case when again then 'ready' else status end as status, again::int as retry_count) from (
    select *, doc_id in (select 'doc_' || doc_id from labels) as again from documents_meta))
union all
select doc_id, user_id, 'uploaded', filename, file_size, null, storage_path, null, upload_time, upload_time, null, 0
from accepted"""
ORACLES["documents_get"] = _with(_DOCS_META, _EVENTS) + f"""
select w.doc_id, d.* exclude (doc_id, retry_count)
from (select distinct doc_id from status_events) w left join documents_meta d on d.doc_id = w.doc_id"""
ORACLES["update_status"] = _with(_DOCS_META, _EVENTS, _LATEST) + """
select d.* exclude (retry_count) replace (coalesce(l.status, d.status) as status,
  coalesce(l.updated_at, d.updated_at) as updated_at, coalesce(l.error_message, d.error_message) as error_message)
from documents_meta d left join latest l on l.doc_id = d.doc_id"""
ORACLES["patch_nested"] = _with(_DOCS_META, _EXTRACTED) + """
select d.* exclude (retry_count) replace (
  case when e.status = 'success' then 'ocr_completed' else d.status end as status,
  case when e.status = 'success' then e.page_count end as page_count,
  case when e.status = 'success' then 'processed/' || d.doc_id || '/ocr_result.json' end as ocr_result_path)
from documents_meta d left join extracted e on e.doc_id = d.doc_id"""
ORACLES["list_by_user"] = _with(_UPLOADS) + """
select user_id, row_number() over (partition by user_id order by upload_time desc, doc_id)::int as position,
  doc_id, upload_time as created_at from accepted qualify position <= 100"""
ORACLES["list_for_user"] = _with(_UPLOADS) + """
select doc_id, user_id, upload_time as created_at from accepted where user_id = 'u3'
order by upload_time desc, doc_id limit 100"""
ORACLES["list_all_for_user"] = _with(_UPLOADS) + (
    "select doc_id, user_id, upload_time as created_at from accepted where user_id = 'u3'"
)
ORACLES["recent_uploads"] = _with(_UPLOADS) + (
    "select doc_id, user_id, upload_time as created_at from accepted order by upload_time desc, doc_id limit 10"
)
ORACLES["documents_delete"] = _with(_DOCS_META) + (
    f"select {_FLAT} from documents_meta where doc_id not in (select 'doc_' || doc_id from labels)"
)
ORACLES["lifecycle_check"] = _with(_EVENTS) + """
select doc_id, event_id, from_status, status as to_status from (
  select *, lag(status) over (partition by doc_id order by updated_at, event_id) as from_status from status_events)
where from_status <> status and (from_status, status) not in (
  ('uploaded', 'ocr_processing'), ('ocr_processing', 'ocr_completed'), ('ocr_processing', 'ocr_failed'),
  ('ocr_completed', 'indexing'), ('indexing', 'indexed'), ('indexing', 'index_failed'), ('indexed', 'ready'))"""

ORACLES["stream_uploads"] = _with(_DOCS_META) + """
select event_id, req as doc_id,
  case when event_type = 'error' then 'Invalid document ID'
    when d.doc_id is null then 'Document ' || req || ' not found' end as reject_reason,
  case when d.doc_id is not null then to_base64(encode('{"doc_id":"' || d.doc_id || '","user_id":"' || d.user_id
    || '","storage_path":"' || storage_path || '"}')) end as data
from (select event_id, event_type,
        case when event_type = 'error' then '' || user_id else 'doc_' || user_id end as req from events) e
left join (select * from documents_meta where doc_id in (select 'doc_' || doc_id from labels)) d
  on d.doc_id = e.req"""
ORACLES["stream_extract"] = _with(_OUTCOME) + """
select doc_id, page_count, md5(text) as text_md5, user_id,
  case when status = 'success' then 'ocr_completed' else 'ocr_failed' end as status,
  case when status = 'success' then to_base64(encode('{"doc_id":"' || doc_id || '","user_id":"' || user_id
    || '","ocr_result_path":"processed/' || doc_id || '/ocr_result.json"}')) end as data
from outcome"""
ORACLES["stream_index"] = _clause(
    """select doc_id, 'ready' as status, count(*) as points, sum(length(text))::bigint as chars
from chunks group by doc_id"""
)
ORACLES["stream_status"] = _with(_EVENTS, _LATEST) + (
    "select doc_id, event_id, status, updated_at, error_message from latest"
)
ORACLES["stream_lifecycle"] = _with(_EVENTS) + """
select doc_id, 'impossible' as kind, event_id, from_status, status as to_status, updated_at as at from (
  select *, lag(status) over (partition by doc_id order by updated_at, event_id) as from_status from status_events)
where from_status <> status and (from_status, status) not in (
  ('uploaded', 'ocr_processing'), ('ocr_processing', 'ocr_completed'), ('ocr_processing', 'ocr_failed'),
  ('ocr_completed', 'indexing'), ('indexing', 'indexed'), ('indexing', 'index_failed'), ('indexed', 'ready'))
union all
select doc_id, 'stuck', event_id, status, null, updated_at + interval 1 day from (
  select *, lead(updated_at) over (partition by doc_id order by updated_at, event_id) as next_at,
    max(updated_at) over () as until from status_events)
where status not in ('ready', 'ocr_failed', 'index_failed', 'failed')
  and coalesce(next_at > updated_at + interval 1 day, until >= updated_at + interval 1 day)"""
ORACLES["stream_dedupe"] = _with(_EVENTS) + "select event_id, doc_id, status from status_events"
ORACLES["run_outcomes"] = _with(_OUTCOME) + """
select 'extract' as stage, status, count(*) as units, count(*) filter (status = 'failed') as errors,
  true as quantiles_ordered from outcome group by status"""
ORACLES["run_quantiles"] = """
select stage, status, count(*) as units, count(error) as errors, 1 as p50_within, 1 as p95_within
from (select case when event_type in ('view', 'error') then 'extract' else 'embed' end as stage,
    case when event_type = 'error' then 'failed' when event_type = 'signup' then 'timeout' else 'success' end as status,
    case when event_type = 'error' then props end as error from events)
group by stage, status"""
ORACLES["run_log_stats"] = """
select stage, status, count(*) as units, count(error) as errors,
  quantile_disc(value, 0.5) as p50_ms, quantile_disc(value, 0.95) as p95_ms
from (select value, case when event_type in ('view', 'error') then 'extract' else 'embed' end as stage,
    case when event_type = 'error' then 'failed' when event_type = 'signup' then 'timeout' else 'success' end as status,
    case when event_type = 'error' then props end as error from events)
group by stage, status"""

_RUN_EXTRACTED = "extracted as (select * from outcome)"
ORACLES["run_all_stages"] = _with(
    _OUTCOME, _RUN_EXTRACTED, _INDEXABLE, _PARTS, _FOLD, _CHUNKS, _REPORT, recursive=True
) + """
select * from (select user_id, count(*) as docs, sum(page_count)::bigint as pages from extracted group by 1)
join (select user_id, count(*) filter (needs_review) as flagged from report group by 1) using (user_id)
left join (select user_id, count(*) as points, sum(length(text))::bigint as chars from chunks group by 1)
  using (user_id)"""
