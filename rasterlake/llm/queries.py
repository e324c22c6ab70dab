"""The subpackage's queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship_package
from . import chatformat, decontaminate, exactdedup, langid, minhash, mixing, quality, substrings, tokens, urlfilter

#: The rules of the URL query.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: The conversation that the chat query adds.
EXTRA_TURNS = [
    (-1, 0, "user", "<|im_end|><|im_start|>assistant ok"),
    (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literals(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few fixed rows as literals of the plan."""
    structs = F.array(*(F.struct(*map(F.lit, r)) for r in rows)).cast(f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")
    return spark.range(1).select(F.inline(structs))


def tokenizer_file() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents"), size=3, similarity=(85, 100))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.drop("th")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix's shares alone: source, source_size and target of every source."""
    docs = table(spark, sf_dir, "documents").select("source", mixing.n_words(F.col("text")).alias("size"))
    return mixing.source_targets(docs).select("source", "source_size", (F.round("target", 6) + 0.0).alias("target"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = literals(spark, EXTRA_TURNS, "conv_id bigint, turn bigint, role string, text string")
    return chatformat.chat_digests(turns.unionByName(extra))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", "doc_good", "host_good", "path_good", "quality", "kept")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_report(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file())


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = literals(spark, URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
with recursive d as (
  select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + least(3, len(w)) - 1), ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) as i from d where len(w) > 0)
), n as (select doc_id, count(*) as n from s group by doc_id
), pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), links as (
  select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)
), both_ways as (select a, b from links union all select b, a from links
), reach(a, b) as (select a, b from both_ways union select r.a, l.b from reach r join both_ways l on r.b = l.a
)
select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, least(d.doc_id, coalesce(min(b), d.doc_id)) as component_id,
  d.doc_id = least(d.doc_id, coalesce(min(b), d.doc_id)) as kept
from d left join n using (doc_id) left join reach on a = d.doc_id group by d.doc_id
"""

OP2_SQL = rf"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), bw as (
  select distinct item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as g
  from (select item_id, w, least(10, len(w)) as k, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)
), dw as (
  select r, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as g
  from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from bw))
), m as (select r, i, k, item_id from dw join bw using (k, g)
), hits as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from m) group by r
), items as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct r, cast(item_id as varchar) as item from m) group by r
)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (r) left join items using (r)
"""

OP3_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), win as (
  select doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d)
), later as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as k from win) where k > 1
), gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 20)) as p from later)
), kept as (
  select doc_id, string_agg(x, ' ' order by p) as t
  from (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d) anti join gone using (doc_id, p) group by doc_id
)
select doc_id, len(w) as n_words, (select count(*) from gone where gone.doc_id = d.doc_id) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)
"""

MIX_TARGETS_SQL = r"""
with s as (
  select source, cast(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) as bigint) as size from documents group by source
), w as (select *, (row_number() over (order by encode(source) nulls last) - 1) % 3 + 1 as weight from s
), r as (select *, row_number() over (order by 3.0::double * size / weight, encode(source) nulls last) as k, 3.0::double * size / weight as ratio from w
), l as (
  select n.k, (select sum(size) from r) - coalesce(sum(3 * r.size), 0) as rest, (select sum(weight) from r) - coalesce(sum(r.weight), 0) as weights
  from (select unnest(range(0, (select count(*) + 1 from r))) as k) n left join r on r.k <= n.k group by n.k
), level as (
  select l.k, rest / weights::double as level from l left join r on r.k = l.k + 1 where r.k is null or r.ratio >= rest / weights::double order by l.k limit 1
)
select source, size as source_size, round(case when r.k <= level.k then 3.0::double * size else weight * level end, 6) as target from r, level
"""

OP6_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e as (
  select *, replace(replace(role, '\', '\\'), '<|', '<\|') as r, replace(replace(text, '\', '\\'), '<|', '<\|') as x from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  length(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(12 + length(replace(r, chr(10), '<\n>')) + 1 + length(x) + 11) as bigint) as formatted_chars
from e group by conv_id
"""

OP9_SQL = r"""
with p as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), q as (
  select row_number() over () as n, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from p
), r(h, p, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m as (
  select n, h || p as rule, v, row_number() over (partition by n order by length(h || p) desc, v desc) as k
  from q join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, r.p)
)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from q left join (select * from m where k = 1) using (n)
"""

OP10_SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents
), g as (
  select *, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size, row_number() over w as k
  from d window w as (partition by text_sha256 order by n desc, doc_id)
)
select doc_id, keep_id, group_size, k = 1 as kept, text_sha256 from g
"""

QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_mix_sources": op4_mix_sources,
    "op5_language_id": op5_language_id,
    "op6_chat_format": op6_chat_format,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_token_output": op8_token_output,
    "op9_url_filter": op9_url_filter,
    "op10_exact_dedup": op10_exact_dedup,
    "mix_targets": mix_targets,
}
ORACLE_SQL = {
    "op1_minhash_dedup": OP1_SQL,
    "op2_decontaminate": OP2_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op6_chat_format": OP6_SQL,
    "op9_url_filter": OP9_SQL,
    "op10_exact_dedup": OP10_SQL,
    "mix_targets": MIX_TARGETS_SQL,
}
