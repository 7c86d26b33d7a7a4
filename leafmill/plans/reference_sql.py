"""SQL oracles of the reference queries, in DuckDB's dialect over the same tables."""

from __future__ import annotations

from leafmill.operators.changed import RECIPE_FIELDS

U = "u as (select distinct on (page_id) * from pages)"
CHARS = "length(coalesce(text, ''))"
CONF = "case when not isnan(confidence) then confidence end"
WORDS = r"cast(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+'), lambda w: w <> '')) as bigint)"
STRIP = r"regexp_replace({0}, '^[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+|[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+$', '', 'g')"
BASE = "split_part({0}, '/', -1)"
PARENT = "regexp_extract({0}, '^(.*)/[^/]*$', 1)"
STEM = r"regexp_extract(split_part({0}, '/', -1), '^(.+?)(\.[^.]*)?$', 1)"
SUFFIX = r"lower(regexp_extract(split_part({0}, '/', -1), '^.+\.([^.]+)$', 1))"
NAT = (
    "list_transform(regexp_extract_all(lower({0}), '([0-9]+|[^0-9]+)'), lambda r: struct_pack(k := case when regexp_matches(r, '^[0-9]') then 0 else 1 end, "
    "d := case when regexp_matches(r, '^[0-9]') then length(ltrim(r, '0')) else 0 end, t := case when regexp_matches(r, '^[0-9]') then ltrim(r, '0') else r end))"
)
CUR = """
cur as (
  select f.*, r.recipe from (
    select run_id, relpath, unnest(max(struct_pack(seen_at := seen_at, work_dir := work_dir, file_index := file_index, size_bytes := size_bytes, modified := modified,
      sha256 := sha256, error := error, page_count := page_count))) from files group by 1, 2) f
  join (select distinct on (run_id) * from runs) r on r.run_id = f.run_id where f.error is null)"""
IDENTITY = "case when coalesce(sha256, '') = '' then concat_ws(':', 'path', relpath, cast(size_bytes as varchar), printf('%.3f', modified)) else sha256 end"
ENTRY = """
entry as (
  select work_dir, relpath, unnest(max(struct_pack(recorded_at := recorded_at, size := size, mtime := mtime, pages := pages, kinds := map_keys(outputs), recipe := recipe,
    run_id := run_id, sha256 := sha256))) from ledger group by 1, 2)"""
RECIPE_TEXT = "concat_ws(',', " + ", ".join(f"'{n}=' || coalesce(cast(recipe.{n} as varchar), 'null')" for n in sorted(RECIPE_FIELDS)) + ")"


def _dup(mode_sql: str) -> str:
    return f"""with {CUR}, k as (select run_id, relpath, file_index, {mode_sql} as k from cur)
select run_id, relpath, first_value(relpath) over (partition by run_id, k order by file_index, relpath) as "primary" from k"""


ORACLE = {
    "page_report": f"""with {U} select relpath as file, page_no as page, source,
  case when {CONF} is null then '' else printf('%.1f', round_even({CONF}, 1)) end as confidence, cast({CHARS} as bigint) as chars, {WORDS} as words,
  case when needs_review then 'yes' else '' end as needs_review, coalesce(review_reason, '') as review_reason,
  case when coalesce(rotation_applied, 0) = 0 then '' else cast(rotation_applied as varchar) end as rotated,
  printf('%.1f', round_even(greatest(coalesce(duration_ms, 0), 0) / 1000.0, 1)) as seconds, coalesce(error, '') as error from u""",
    "document_summary": f"""with {U} select file_id, count(*) filter (source = 'ocr') as ocr_pages, count(*) filter (source = 'text-layer') as text_layer_pages,
  coalesce(string_agg(cast(page_no as varchar), ',' order by page_no) filter (needs_review), '') as flagged, round_even(avg({CONF}), 1) as mean_confidence,
  cast(sum({CHARS}) as bigint) as chars, count(*) as pages_done from u group by 1""",
    "run_totals": """select run_id, count(*) as files_total, count(*) filter (status = 'failed') as files_failed, count(*) filter (status = 'skipped') as files_skipped,
  count(*) filter (status = 'copied') as files_copied, cast(coalesce(sum(page_count) filter (status = 'skipped'), 0) as bigint) as pages_skipped,
  cast(coalesce(sum(resumed_pages), 0) as bigint) as pages_resumed,
  cast(coalesce(sum(page_count - coalesce(resumed_pages, 0)) filter (status not in ('skipped', 'failed', 'copied')), 0) as bigint) as pages_total from file_results group by 1""",
    "all_page_totals": f"""with {U} select run_id, count(*) as pages_done, count(*) filter (needs_review) as pages_flagged, count(*) filter (source = 'failed') as pages_failed,
  count(*) filter (source = 'text-layer') as pages_from_text_layer, cast(sum({CHARS}) as bigint) as chars from u group by 1""",
    "flag_pages": f"""with {U}, r as (select page_id, case when {CONF} < 70 then 'mean confidence ' || printf('%.0f', round_even({CONF}, 0)) || ' below 70'
  when {CHARS} < 25 then 'almost no text on the page' end as review_reason from u) select page_id, review_reason is not null as needs_review, review_reason from r""",
    "route_text_layer": rf"""with {U}, a as (select page_id, cast(length(regexp_replace(coalesce(text, ''), '[^\p{{L}}\p{{N}}]', '', 'g')) as bigint) as alnum from u)
select page_id, case when alnum >= 100 then 'text-layer' else 'ocr' end as route, alnum from a""",
    "low_confidence_words": f"""with {U} select page_id, coalesce(array_to_string(list_transform(list_filter(words, lambda w: w.confidence < 60), lambda w: w.text)[1:80], ' '), '') as low_words
from u where words is not null""",
    "word_char_counts": f"with {U} select page_id, {WORDS} as words, cast({CHARS} as bigint) as chars from u",
    "tidy_text": rf"""with {U}, a as (select page_id, regexp_replace(text, '\r\n?', chr(10), 'g') as t from u),
b as (select page_id, regexp_replace(t, '[\t\x0b\f\r\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+(\n|$)', '\1', 'g') as t from a), c as (select page_id, regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g') as t from b)
select page_id, {STRIP.format('t')} as tidied from c""",
    "char_width_median": f"""with {U}, w as (select page_id, unnest(words) as w from u), m as (
  select page_id, median((w.x1 - w.x0) / length(w.text)) filter (length(w.text) > 0 and w.x1 > w.x0) as cw, median(w.y1 - w.y0) filter (w.y1 > w.y0) as lh from w group by 1)
select page_id, round_even(cw, 6) as char_width, round_even(coalesce(lh, cw * 2), 6) as line_height from m""",
    "document_json": f"""with {U}, p as (select file_id, page_no, source, {CONF} as c, needs_review from u)
select file_id, '[' || string_agg('{{' || concat_ws(',', '"page":' || page_no, '"source":' || to_json(source), '"confidence":' || cast(c as varchar), '"needs_review":' || cast(needs_review as varchar)) || '}}', ','
  order by page_no nulls first, source nulls first, c nulls first, needs_review nulls first) || ']' as pages from p group by 1""",
    "line_gaps": f"""with recursive {U}, x as (select page_id, unnest(words) as w from u where len(words) > 0),
m as (select page_id, median(case when length(w.text) > 0 and w.x1 > w.x0 then (w.x1 - w.x0) / length(w.text) end) as cw, median(case when w.y1 > w.y0 then w.y1 - w.y0 end) as lh from x group by 1),
o as (select x.page_id, (w.y0 + w.y1) / 2 as c, coalesce(lh, cw * 2) * 0.5::double as half, row_number() over (partition by x.page_id order by (w.y0 + w.y1) / 2, w.x0, w.text) as k from x join m on m.page_id = x.page_id),
r as (select page_id, k, c as centre, cast(0 as bigint) as line_no from o where k = 1
  union all select o.page_id, o.k, case when coalesce(abs(o.c - r.centre) <= o.half, false) then (r.centre + o.c) / 2 else o.c end,
    case when coalesce(abs(o.c - r.centre) <= o.half, false) then r.line_no else r.line_no + 1 end from r join o on o.page_id = r.page_id and o.k = r.k + 1),
l as (select page_id, line_no, arg_max(centre, k) as centre from r group by 1, 2)
select page_id, line_no, round_even(centre, 6) as centre, round_even(centre - lag(centre) over (partition by page_id order by line_no), 6) as gap from l""",
    "live_runs": "select distinct run_id, work_dir from runs where finished_at is null",
    "run_folders": """select x.run_id, coalesce(max(case when r.finished_at is null then r.work_dir end), max(r.work_dir)) as folder,
  coalesce(bool_or(r.run_id is not null and r.finished_at is null), false) as going from (select distinct run_id from file_results) x left join runs r on r.run_id = x.run_id group by 1""",
    "document_states": "select distinct run_id, file_id, status, status not in ('done', 'failed', 'skipped', 'copied', 'cancelled') as pending from file_results",
    "written_counts": """select run_id, count(*) filter (status in ('done', 'copied', 'skipped')) as written, count(*) as total
from (select distinct run_id, file_id, status from file_results) group by 1""",
    "unreadable_files": "select distinct run_id, relpath, error from files where error is not null",
    "upload_totals": """select run_id, count(*) as files, cast(coalesce(sum(size_bytes), 0) as bigint) as bytes
from (select run_id, relpath, max(struct_pack(seen_at := seen_at, size_bytes := size_bytes)).size_bytes as size_bytes from files group by 1, 2) group by 1""",
    "newest_log": "select event_id, ts, event_type from events order by ts desc, event_id desc limit 400",
    "run_estimate": """select run_id, round_even(cast(coalesce(sum(case when status not in ('skipped', 'failed', 'copied') then page_count - coalesce(resumed_pages, 0) end), 0) as bigint) * 1400 / 8000.0::double, 3) as seconds
from file_results group by 1""",
    "page_dpi": f"with {U} select page_id, cast(floor(300.0::double * least(1.0::double, 2000.0::double / greatest(width_px, height_px))) as int) as dpi from u where width_px > 0 and height_px > 0",
    "flipped_boxes": f"""with {U}, w as (select page_id, height_px, cast(unnest(generate_series(0, len(words) - 1)) as int) as word_pos, unnest(words) as w from u where len(words) > 0)
select page_id, word_pos, w.text as word, height_px - w.y1 as y0, height_px - w.y0 as y1 from w""",
    "preview_headline": """with r as (select run_id, count(*) filter (status in ('done', 'copied', 'skipped')) as d, count(*) filter (status not in ('done', 'copied', 'skipped')) as n
  from (select distinct run_id, file_id, status from file_results) group by 1)
select run_id, case when n = 0 and d = 0 then 'nothing to read' when n = 0 then 'everything here has been read'
  else n || case when n = 1 then ' document' else ' documents' end || ' to read' || case when d > 0 then ', ' || d || ' done' else '' end end as headline from r""",
    "shown_tree": f"""with f as (select distinct relpath, string_split(relpath, '/') as parts from files),
r as (select distinct parts[1] as path, 1 as depth, len(parts) > 1 as folder, parts[1] as top from f
  union select distinct parts[1] || '/' || parts[2], 2, len(parts) > 2, parts[1] from f where len(parts) > 1)
select path, cast(depth as int) as depth, folder, row_number() over (partition by top order by depth, case when folder then 0 else 1 end,
  list_transform(string_split(path, '/'), lambda p: {NAT.format('p')}), path) as place from r""",
    "supported_suffix": f"select distinct relpath, {SUFFIX.format('relpath')} in ('pdf', 'png', 'jpg', 'jpeg', 'tif', 'tiff', 'bmp', 'webp', 'gif') as supported from files",
    "reserved_dirs": "select distinct relpath, list_has_any(string_split(relpath, '/'), ['_runs', '_previews', '_uploads', '_cache']) as reserved from files",
    "lines_from_words": f"""with {U}, w as (select page_id, unnest(generate_series(0, len(words) - 1)) as pos, unnest(words) as w from u where len(words) > 0)
select page_id, cast(floor(w.y0 / 40) as bigint) as line_key, string_agg(w.text, ' ' order by pos) as line, min(w.x0) as x0, max(w.x1) as x1 from w group by 1, 2""",
    "natural_sort": f"""with f as (select distinct work_dir, relpath from files)
select work_dir, relpath, row_number() over (partition by work_dir order by list_transform(string_split(relpath, '/'), lambda p: {NAT.format('p')}), relpath) as place from f""",
    "tree_order": f"""with f as (select distinct work_dir, relpath, string_split(relpath, '/') as parts from files)
select work_dir, relpath, row_number() over (partition by work_dir order by
  list_transform(parts, lambda p, i: struct_pack(leaf := case when i = len(parts) then 1 else 0 end, name := {NAT.format('p')})), relpath) as place from f""",
    "words_from_chars": rf"""with {U}, t as (select page_id, unnest(regexp_extract_all(text, '([^\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+|[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+)')) as tok, unnest(generate_series(1, len(regexp_extract_all(text, '([^\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+|[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+)')))) as k
  from u where text is not null),
p as (select page_id, tok, k, sum(length(tok)) over (partition by page_id order by k rows between unbounded preceding and current row) as upto from t)
select page_id, tok as word, cast(10.0 * (upto - length(tok)) as double) as x0, cast(10.0 * upto as double) as x1 from p where not regexp_matches(tok, '^[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]')""",
    "path_parts": f"""with f as (select distinct relpath as r from files) select r as relpath, {BASE.format('r')} as name, {PARENT.format('r')} as folder, {STEM.format('r')} as stem, {SUFFIX.format('r')} as suffix from f""",
    "output_paths": "with f as (select distinct relpath as r from files), p as (select r, "
    + f"{STEM.format('r')} as s, nullif({PARENT.format('r')}, '') as d from f) select r as relpath, "
    + ", ".join(
        f"concat_ws('/', '/out', d, '{k}', s || '.{k}') as {k}_by_folder, concat_ws('/', '/out', '{k}', d, s || '.{k}') as {k}_by_type, concat_ws('/', '/out', d, s || '.{k}') as {k}_together"
        for k in ("pdf", "txt")
    )
    + " from p",
    "content_hash": "select doc_id, sha256(coalesce(text, '')) as sha256 from documents",
    "doc_key": f"""with {CUR} select run_id, relpath, substr(sha256(concat_ws('|', {IDENTITY}, {BASE.format('relpath')})), 1, 16) || '-' || substr(sha256({RECIPE_TEXT}), 1, 8) as doc_key from cur""",
    "dup_name": _dup(f"concat_ws('|', {IDENTITY}, {BASE.format('relpath')})"),
    "dup_content": _dup(IDENTITY),
    "dup_off": _dup(f"concat_ws('|', {IDENTITY}, relpath)"),
    "twin_fanout": f"""with {CUR}, n as (select relpath, arg_max(sha256, struct_pack(a := seen_at, b := run_id)) as sha256, min(file_index) as file_index from cur where coalesce(sha256, '') <> '' group by 1),
t as (select relpath, first_value(relpath) over (partition by sha256 order by file_index, relpath) as p from n), g as (select distinct relpath, page_no from pages)
select t.relpath, g.page_no from t join g on g.relpath = t.p where t.relpath <> t.p""",
    "ledger_skip": f"""with {CUR}, {ENTRY} select cur.run_id, cur.relpath, e.run_id as from_run from cur join entry e on e.work_dir = cur.work_dir and e.relpath = cur.relpath
where e.size = cur.size_bytes and (e.mtime < 0 or abs(e.mtime - cur.modified) <= 1.0) and e.recipe is not distinct from cur.recipe and list_has_all(e.kinds, ['pdf', 'txt'])""",
    "ledger_twin": f"""with {CUR}, {ENTRY} select cur.run_id, cur.relpath, min(e.relpath) as twin from cur join entry e
on e.sha256 = cur.sha256 and e.relpath <> cur.relpath and e.recipe is not distinct from cur.recipe
where coalesce(cur.sha256, '') <> '' and list_has_all(e.kinds, ['pdf', 'txt']) group by 1, 2""",
    "ledger_upsert": """select work_dir, relpath, v.size as size, v.mtime as mtime, v.pages as pages, v.run_id as run_id from (
  select work_dir, relpath, max(struct_pack(recorded_at := recorded_at, size := size, mtime := mtime, pages := pages, run_id := run_id)) as v from ledger group by 1, 2)""",
    "ledger_backfill": """with e as (select distinct r.work_dir, f.relpath, f.run_id, f.size_bytes, f.page_count from file_results f join runs r on r.run_id = f.run_id
  where f.status = 'done' and r.status in ('done', 'cancelled')),
m as (select work_dir, relpath, max(struct_pack(run_id := run_id, size_bytes := size_bytes, page_count := page_count)) as b from e group by 1, 2)
select work_dir, relpath, b.run_id as run_id, b.size_bytes as size, cast(-1.0 as double) as mtime, b.page_count as pages from m""",
    "page_expand": """select distinct file_id, cast(unnest(generate_series(1, page_count)) as int) as page_no from file_results
where page_count > 0 and status not in ('skipped', 'failed', 'copied')""",
    "resume_missing": """select distinct file_id, page_no from (select file_id, cast(unnest(generate_series(1, page_count)) as int) as page_no from file_results
  where page_count > 0 and status not in ('skipped', 'failed', 'copied')) x
where not exists (select 1 from pages p where p.file_id = x.file_id and p.page_no = x.page_no and p.source not in ('failed', 'skipped'))""",
    "merge_resumed": f"""with {U}, l as (select *, max(cast(read_at as date)) over (partition by file_id) as last_day from u),
r as (select *, row_number() over (partition by file_id, page_no order by case when cast(read_at as date) = last_day then 1 else 0 end desc) as k from l)
select file_id, page_no, source, page_id from r where k = 1""",
    "folder_tree": """with f as (select relpath, max(page_count) as pc from files group by 1), s as (select relpath, pc, string_split(relpath, '/') as parts from f),
a as (select array_to_string(parts[1:n], '/') as folder_path, pc, n from (select relpath, pc, parts, unnest(generate_series(0, len(parts) - 1)) as n from s))
select folder_path, count(*) as files, cast(coalesce(sum(pc), 0) as bigint) as pages, max(n) as depth from a group by 1""",
    "tree_new_done": """with f as (select relpath, max(page_count) as pc from files group by 1),
d as (select relpath, bool_or(status = 'done') as done, bool_or(status = 'running') as running from file_results group by 1),
s as (select f.relpath, pc, coalesce(done, false) as done, coalesce(running, false) as running, string_split(f.relpath, '/') as parts from f left join d on d.relpath = f.relpath),
a as (select array_to_string(parts[1:n], '/') as folder_path, pc, done, running from (select *, unnest(generate_series(0, len(parts) - 1)) as n from s))
select folder_path, count(*) as files, cast(coalesce(sum(pc), 0) as bigint) as pages, count(*) filter (not done) as new_files, count(*) filter (done) as done_files, bool_or(running) as running from a group by 1""",
    "filter_documents": f"""select distinct relpath from files where {SUFFIX.format('relpath')} in ('pdf','png','jpg','jpeg','tif','tiff','bmp','webp','gif')
and not list_has_any(string_split(relpath, '/'), ['_runs','_previews','_uploads','_cache']) and not starts_with({BASE.format('relpath')}, '.')""",
    "search_hits": f"""with {U}, h as (select *, instr(lower(text), 'evidence custodian') as p from u where contains(lower(text), 'evidence custodian'))
select file_id, relpath, page_no, source, cast(p - 1 as bigint) as position,
  case when p > 91 then '…' else '' end || replace(substr(text, greatest(1, p - 90), p - greatest(1, p - 90)), chr(10), ' ') as before, substr(text, p, 18) as match,
  replace(substr(text, p + 18, 90), chr(10), ' ') || case when length(text) >= p + 18 + 90 then '…' else '' end as after from h""",
    "search_top": f"""with {U}, h as (select file_id, page_no, cast(instr(lower(text), 'evidence custodian') - 1 as bigint) as position from u where contains(lower(text), 'evidence custodian'))
select *, (select count(*) > 200 from h) as truncated from h order by file_id, page_no limit 200""",
    "find_in_document": f"""with {U}, k as (select file_id, cast(len(string_split(lower(coalesce(text, '')), 'the')) - 1 as bigint) as k from u)
select file_id, cast(sum(k) as bigint) as occurrences, count(*) as pages from k where k > 0 group by 1""",
    "highlight": f"with {U} select page_id, regexp_replace(text, '(policy)', '«\\1»', 'gi') as marked from u where contains(lower(text), 'policy')",
    "eta_throughput": f"""with {U}, d as (select run_id, count(*) as done from u group by 1),
t as (select run_id, cast(coalesce(sum(page_count - coalesce(resumed_pages, 0)) filter (status not in ('skipped', 'failed', 'copied')), 0) as bigint) as total from file_results group by 1),
r as (select distinct on (run_id) run_id, epoch_us(finished_at) / 1e6 - epoch_us(started_at) / 1e6 as el from runs where finished_at is not null),
x as (select r.run_id, done, total, el, case when el > 0 and done > 0 then done / el else 0.0 end as rate from r join d on d.run_id = r.run_id join t on t.run_id = r.run_id)
select run_id, done, total, round_even(el, 1) as elapsed_s, round_even(rate, 2) as pages_per_second,
  case when rate > 0 then cast(round_even(greatest(0, total - done) / rate, 0) as bigint) end as eta_s,
  case when total > 0 then least(100.0, round_even(done * 100.0 / total, 1)) else 0.0 end as percent from x""",
    "running_progress": f"""with {U} select run_id, page_id, count(*) over w as pages_done, count(*) filter (needs_review) over w as pages_flagged from u
window w as (partition by run_id order by read_at, page_id rows between unbounded preceding and current row)""",
    "interrupted_status": """select distinct run_id, case when status in ('running', 'discovering', 'pending') then 'interrupted' else status end as status,
  status in ('running', 'discovering', 'pending') as was_live from runs""",
    "recents": """select distinct run_id, work_dir, started_at, case when status in ('running', 'discovering', 'pending') then 'interrupted' else status end as status
from runs order by started_at desc, run_id desc limit 20""",
    "duration_text": """with r as (select distinct run_id, file_id, duration_ms, size_bytes, coalesce(cast(floor(duration_ms / 1000) as bigint), 0) as s from file_results)
select run_id, file_id, duration_ms, size_bytes, case when s < 60 then s || 's' when s < 3600 then (s // 60) || 'm ' || (s % 60) || 's' else (s // 3600) || 'h ' || ((s % 3600) // 60) || 'm' end as took,
  case when size_bytes >= 1099511627776 then printf('%.1f', size_bytes / 1099511627776.0) || ' TB' when size_bytes >= 1073741824 then printf('%.1f', size_bytes / 1073741824.0) || ' GB'
  when size_bytes >= 1048576 then printf('%.1f', size_bytes / 1048576.0) || ' MB' when size_bytes >= 1024 then printf('%.1f', size_bytes / 1024.0) || ' KB' else coalesce(size_bytes, 0) || ' B' end as size from r""",
    "artefact_paths": f"with {U} select page_id, '_previews/' || relpath || printf('/p%04d.jpg', page_no) as preview_path, printf('p%05d.json', page_no) as cache_name from u",
    "safe_paths": """select distinct path, array_to_string(list_filter(string_split(replace('../\\' || replace(path, '/', '\\') || '/./', '\\', '/'), '/'), lambda p: p not in ('', '.', '..')), '/') as safe from files""",
    "document_text": f"""with {U}, p as (select file_id, page_no, page_id, '----- page ' || page_no || ' (' || source || ') -----' || chr(10) || {STRIP.format("coalesce(text, '')")} || chr(10) as part from u)
select file_id, {STRIP.format("string_agg(part, chr(10) order by page_no, page_id)")} || chr(10) as text from p group by 1""",
    "events_filter_log": "select event_id, user_id, event_type from events where event_type in ('purchase', 'signup', 'error')",
    "events_by_hour": "select date_trunc('hour', ts) as hour, event_type, count(*) as n, round_even(sum(value), 4) as total from events group by 1, 2",
    "events_stream_totals": "select event_type, count(*) as n, round_even(sum(value), 4) as total from events group by 1",
    "rescue_choice": f"""with {U}, w as (select page_id, text as t0, {CONF} as c0, lead(text, 1) over o as t1, lead({CONF}, 1) over o as c1, lead(text, 2) over o as t2, lead({CONF}, 2) over o as c2,
  lead(text, 3) over o as t3, lead({CONF}, 3) over o as c3 from u window o as (partition by file_id order by page_no, page_id)),
b as (select *, {", ".join(f"not regexp_matches(coalesce(t{k}, ''), '[^{chr(92)}s{chr(92)}p{{Z}}]') as b{k}" for k in range(4))} from w),
i as (select *, {", ".join(f"case when b{k} then false when b0 then true when c{k} is null or c0 is null then false else c{k} > c0 + 5 end as i{k}" for k in (1, 2, 3))} from b),
s1 as (select *, (b1 and b0) as dead, not (b1 and b0) and i1 as k1 from i),
s2 as (select *, case when k1 then 90 end as a1, case when k1 then c1 end as f1, dead or (k1 and not b1 and (c1 is null or c1 >= 70)) as o1 from s1),
s3 as (select *, not o1 and i2 and (a1 is null or coalesce(c2, 0) > coalesce(f1, 0)) as k2 from s2),
s4 as (select *, case when k2 then 180 else a1 end as a2, case when k2 then c2 else f1 end as f2, o1 or (k2 and not b2 and (c2 is null or c2 >= 70)) as o2 from s3)
select page_id, cast(case when not o2 and i3 and (a2 is null or coalesce(c3, 0) > coalesce(f2, 0)) then 270 else a2 end as int) as turn from s4""",
    "tsv_words": f"""with {U}, w as (select page_id, unnest(generate_series(0, len(words) - 1)) as pos, unnest(words) as w from u where len(words) > 0),
g as (select *, cast(floor(w.y0 / 40) as bigint) as ln from w where trim(w.text) <> '' and w.confidence >= 0),
l as (select page_id, ln, string_agg(trim(w.text), ' ' order by pos) as line, sum(w.confidence) as s, count(*) as k from g group by 1, 2)
select page_id, string_agg(line, chr(10) order by ln) as text, round_even(sum(s) / sum(k), 2) as confidence from l group by 1""",
    "osd_parse": f"""with {U}, o as (select page_id, rotation_applied as r, {CONF} as c from u)
select page_id, case when r in (0, 90, 180, 270) and c is not null then r end as rotate, case when r in (0, 90, 180, 270) and c is not null then c end as confidence,
  case when r in (0, 90, 180, 270) and c is not null then 'Latin' end as script from o""",
    "dpi_fit": f"""with {U} select page_id, cast(greatest(72, cast(trunc(least(300.0, 5000.0 / greatest(width_px / 72.0, height_px / 72.0))) as int)) as bigint) as dpi from u where width_px > 0 and height_px > 0""",
}
