"""Queries of the general training-data problems: changed records and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.operators.changed import ChangeState, changed_per_run
from leafmill.operators.nested import flat_files, flat_pages, flat_words, found_words
from leafmill.storage import new_path
from leafmill.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files", "run_id", "relpath", "size_bytes", "modified", "error", "seen_at")
    ledger = table(spark, sf_dir, "ledger", "work_dir", "relpath", "size", "mtime", "recipe", "recorded_at")
    runs = table(spark, sf_dir, "runs", "run_id", "work_dir", "started_at", "recipe")
    return changed_per_run(files, ledger, runs, ChangeState(spark, new_path(spark, "state"), ["work_dir", "relpath"], history=True))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_words(table(spark, sf_dir, "raw_results"))


def p5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_files(table(spark, sf_dir, "raw_results"))


def p5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_pages(table(spark, sf_dir, "raw_results"))


def p5_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with its box and its parents' positions."""
    return flat_words(table(spark, sf_dir, "raw_results"))


QUERIES = {"p1_found": p1_found, "p5_found": p5_found, "p5_files": p5_files, "p5_pages": p5_pages, "p5_words": p5_words}

_RECORDS = """
with valid as (select distinct record_id, payload from raw_results where payload is not null and json_valid(payload)),
bodies as (select record_id, case when json_type(payload) = 'VARCHAR' then json_extract_string(payload, '$') else payload end as body from valid),
objects as (select record_id, body from bodies where json_valid(body) and json_type(body) = 'OBJECT'),
lists as (
  select record_id, cast(case when json_type(body, '$.files') = 'ARRAY' then json_extract(body, '$.files')
    when json_type(body, '$.document') = 'OBJECT' then json_array(json_extract(body, '$.document'))
    else json_array(json(body)) end as json[]) as fs
  from objects),
f as (select record_id, unnest(generate_series(0, len(fs) - 1)) as file_pos, unnest(fs) as file from lists),
pl as (select record_id, file_pos, cast(json_extract(file, '$.pages') as json[]) as ps from f where json_type(file, '$.pages') = 'ARRAY'),
p as (select record_id, file_pos, unnest(generate_series(0, len(ps) - 1)) as page_pos, unnest(ps) as page from pl)
"""

ORACLE = {
    "p1_found": """
with f as (
  select run_id, relpath, max(struct_pack(seen_at := seen_at, ok := error is null, size_bytes := size_bytes, modified := modified)) as v
  from files where run_id is not null and relpath is not null group by 1, 2),
x as (
  select f.run_id, f.relpath, r.work_dir, r.started_at, r.recipe, v.size_bytes as size_bytes, v.modified as modified
  from f join runs r on r.run_id = f.run_id where v.ok),
l as (
  select x.run_id, x.relpath, arg_max(struct_pack(size := l.size, mtime := l.mtime, recipe := l.recipe), l.recorded_at) as s
  from x join ledger l on l.work_dir = x.work_dir and l.relpath = x.relpath and l.recorded_at < x.started_at group by 1, 2)
select x.run_id as run_id, x.relpath as relpath
from x left join l on l.run_id = x.run_id and l.relpath = x.relpath
where not coalesce(s.size = size_bytes and (s.mtime < 0 or abs(s.mtime - modified) <= 1.0) and s.recipe is not distinct from x.recipe, false)
""",
    "p5_words": _RECORDS
    + """, wl as (
  select record_id, file_pos, page_pos, cast(case when json_type(page, '$.word_boxes') = 'ARRAY' then json_extract(page, '$.word_boxes')
    when json_type(page, '$.words') = 'ARRAY' then json_extract(page, '$.words') end as json[]) as ws from p),
w as (select record_id, file_pos, page_pos, unnest(generate_series(0, len(ws) - 1)) as word_pos, unnest(ws) as word from wl where ws is not null)
select record_id, cast(file_pos as int) as file_pos, cast(page_pos as int) as page_pos, cast(word_pos as int) as word_pos,
  json_extract_string(word, '$.text') as word, try_cast(json_extract_string(word, '$.box[0]') as double) as x0,
  try_cast(json_extract_string(word, '$.box[1]') as double) as y0, try_cast(json_extract_string(word, '$.box[2]') as double) as x1,
  try_cast(json_extract_string(word, '$.box[3]') as double) as y1, try_cast(json_extract_string(word, '$.confidence') as double) as confidence from w
""",
    "p5_found": _RECORDS
    + """, wl as (
  select record_id, file_pos, page_pos, cast(case when json_type(page, '$.word_boxes') = 'ARRAY' then json_extract(page, '$.word_boxes')
    when json_type(page, '$.words') = 'ARRAY' then json_extract(page, '$.words') end as json[]) as ws from p),
w as (select record_id, file_pos, page_pos, unnest(generate_series(0, len(ws) - 1)) as word_pos, unnest(ws) as word from wl where ws is not null)
select record_id, cast(file_pos as int) as file_pos, cast(page_pos as int) as page_pos, cast(word_pos as int) as word_pos,
  json_extract_string(word, '$.text') as word from w
""",
    "p5_files": _RECORDS
    + """
select record_id, cast(file_pos as int) as file_pos, json_extract_string(file, '$.relpath') as relpath,
  json_extract_string(file, '$.source_path') as source_path, try_cast(json_extract_string(file, '$.size_bytes') as bigint) as size_bytes,
  try_cast(json_extract_string(file, '$.page_count') as int) as page_count, json_extract_string(file, '$.status') as status,
  json_extract_string(file, '$.error') as error, json_extract_string(file, '$.duplicate_of') as duplicate_of from f
""",
    "p5_pages": _RECORDS
    + """
select record_id, cast(file_pos as int) as file_pos, cast(page_pos as int) as page_pos,
  try_cast(json_extract_string(page, '$.page') as int) as page_no, json_extract_string(page, '$.source') as source,
  try_cast(json_extract_string(page, '$.chars') as bigint) as chars, try_cast(json_extract_string(page, '$.confidence') as double) as confidence,
  try_cast(json_extract_string(page, '$.needs_review') as boolean) as needs_review,
  try_cast(json_extract_string(page, '$.duration_ms') as bigint) as duration_ms,
  try_cast(json_extract_string(page, '$.size_px[0]') as int) as width_px, try_cast(json_extract_string(page, '$.size_px[1]') as int) as height_px
from p
""",
}
