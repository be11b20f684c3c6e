"""One query for each operator of this subpackage, over whole tables, and its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, chat_format, decontam, exact_dedup, html_text, lang_id, near_dup, packing, pii, quality, token_files, tokens, url_rules, whitening
from .common import materialize, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


OP1 = r"""
with n as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, text_sha256
from n window w as (partition by text_sha256)
"""


def op2_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.report(table(spark, sf_dir, "documents"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_dup(table(spark, sf_dir, "documents"), percent=85)


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4 = r"""
with w as (
  select doc_id, row_number() over () as r, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') as words from documents
), b as (
  select item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') as words from benchmark
), bw as (
  select distinct item_id, least(10, len(words)) as n, list_slice(words, i, i + least(10, len(words)) - 1) as window_words
  from b, unnest(range(1, len(words) - least(10, len(words)) + 2)) t(i) where len(words) > 0
), sizes as (select distinct n from bw), dw as (
  select r, i, n, list_slice(words, i, i + n - 1) as window_words from w, sizes, unnest(range(1, len(words) - n + 2)) t(i) where len(words) >= n
), hit as (
  select r, i, dw.n, item_id from dw join bw on dw.n = bw.n and dw.window_words = bw.window_words
), covered as (
  select r, count(distinct p) as n_hit from hit, unnest(range(i, i + n)) t(p) group by r
), items as (
  select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as names from hit group by r
)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join covered using (r) left join items using (r)
"""


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rule_table(spark))


OP5 = r"""
with r(rhost, rpath, rverdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
a as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
b as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as h from a),
c as (select row_number() over () as k, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') as path from b),
d as (
  select c.*, rhost || rpath as rule, rverdict, row_number() over (partition by k order by length(rhost) desc, length(rpath) desc) as n
  from c left join r on (host = rhost or host like '%.' || rhost) and starts_with(path, rpath)
)
select page_id, host, path, rule, coalesce(rverdict, 'allow') as verdict from d where n = 1
"""


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokens.default_path(), end_id=0)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens.default_path(), end_id=2, size=1024)


# Who runs this on private data passes a key of their own.
PII_KEY = b"tidemark public test key"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), PII_KEY)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.with_odd_turns(spark, table(spark, sf_dir, "conversations"))
    return chat_format.digest(materialize(chat_format.format_windows(turns, budget=1024, history=256), "chat", "zstd"))


# Windows by a walk from turn to turn, for conversations of one block.
OP11 = r"""
with recursive src as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, i, case i when 0 then 'user' else 'assistant' end, '\### Assistant: </turn> ok' from range(2) t(i)
), body as (
  select *, '### ' || replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#'), '##', '#\#') || ' ###' || chr(10)
    || replace(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#'), '##', '#\#') || '</turn>' || chr(10) as body from src
), counted as (
  select *, length(body) as chars, length(regexp_replace(body, ' ?\p{L}{1,6}| ?\p{N}{1,3}| ?[^\x09-\x0D \p{L}\p{N}]{1,3}|[\x09-\x0D ]+', 'x', 'g')) as n from body
), placed as (
  select *, row_number() over w as pos, sum(n) over (w rows unbounded preceding) - n as p, first_value(role) over w = 'system' as led, first_value(n) over w as n1, first_value(chars) over w as c1
  from counted window w as (partition by conv_id order by turn nulls first, role, body)
), kept as (select *, case when led and pos > 1 then n1 else 0 end as sys_n, case when led and pos > 1 then c1 else 0 end as sys_c from placed),
back as (
  select t.conv_id, t.pos, coalesce(sum(x.n), 0) as back_n, coalesce(sum(x.chars), 0) as back_c
  from kept t left join placed x on t.conv_id is not distinct from x.conv_id and x.pos < t.pos and x.p >= t.p - least(256, greatest(0, 1024 - t.sys_n - t.n)) and not (x.led and x.pos = 1)
  group by all
), steps as (select k.*, back_n, back_c from kept k join back b on k.conv_id is not distinct from b.conv_id and k.pos = b.pos),
walk as (
  select conv_id, pos, n::hugeint as used, 0::hugeint as again from steps where pos = 1
  union all
  select s.conv_id, s.pos, case when used + n <= 1024 then used + n else sys_n + back_n + n end, case when used + n <= 1024 then 0 else sys_c + back_c end
  from walk w join steps s on s.conv_id is not distinct from w.conv_id and s.pos = w.pos + 1
)
select s.conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by s.pos)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by s.pos) filter (role = 'assistant'), '')) as loss_sha256, (sum(chars) + sum(again))::bigint as formatted_chars
from steps s join walk w on s.conv_id is not distinct from w.conv_id and s.pos = w.pos group by s.conv_id
"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokens.default_path(), alignment.piece_path())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_exact_dedup, op2_lang_id, op3_near_dup, op4_decontam, op5_url_rules, op6_token_files, op7_html_text, op8_packing, op9_pii, op10_quality, op11_chat_format, op12_alignment, op13_whitening)}
ORACLE_SQL: dict[str, str] = {"op1_exact_dedup": OP1, "op4_decontam": OP4, "op5_url_rules": OP5, "op11_chat_format": OP11}
