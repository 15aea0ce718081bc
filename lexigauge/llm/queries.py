"""The subpackage's queries, each an operator with production parameters on its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, decontaminate, html_extract, line_dedup, lm_scoring, near_dedup, quality_rules, sharding, suffix_dedup

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[str, str]:
    """Path of the rank file and the pattern that splits text before it."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.stupid_backoff(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_recurring_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_format.reply_order(table(spark, sf_dir, "conversations"))
    digest = F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256")
    return out.select("conv_id", "turn", "role", "reply_to", "thread_root", "n_quoted_lines", "n_levels", "n_linked", digest)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digest(table(spark, sf_dir, "documents"), *tokenizer())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_quality_rules, op3_decontaminate, op4_near_dedup, op5_html_extract, op6_sharding, op7_suffix_dedup, op8_line_dedup, op9_chat_format, op10_byte_bpe, pipeline)}

#: Rounds that the SQL of op8 goes; those after the last that finds a line change nothing.
_ROUNDS = 6


def _line_dedup_sql() -> str:
    least, depth, v = line_dedup.LEAST_TEXTS, line_dedup.DEPTH, f"'{line_dedup.VARIABLE}'"
    parts = [rf"""texts as (select row_number() over () as t, text from (select distinct text from documents where text is not null)),
raw as (select t, i, regexp_replace(string_split(text, chr(10))[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as line
  from (select t, text, unnest(generate_series(1, len(string_split(text, chr(10))))) as i from texts)),
lines as (select t, i, list_transform(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: case when regexp_matches(x, '[0-9@]') then {v} else x end) as tokens
  from raw where line <> ''),
at0 as (select t, i, len(tokens) as n, tokens, len(tokens)::varchar as node, 0 as wild, 0 as found from lines)"""]
    for d in range(depth):
        parts.append(f"""side{d} as (select *, case when n > {d} and tokens[{d + 1}] <> {v} then node || chr(1) || tokens[{d + 1}] end as branch from at{d}),
common{d} as (select branch from side{d} where branch is not null group by branch having count(distinct t) >= {least}),
at{d + 1} as (select * from (
  select s.t, s.i, s.n, s.tokens, case when s.n <= {d} then s.node when c.branch is null then s.node || chr(1) || {v} else s.branch end as node,
    s.wild + (s.n > {d} and c.branch is null)::int as wild, s.found + (s.n > {d} and c.branch is null and s.branch is not null)::int as found
  from side{d} s left join common{d} c on s.branch = c.branch) where wild * 3 <= least(n, {depth}))""")
    parts.append(f"""live as (select * from at{depth} where node in (select node from at{depth} group by node having count(distinct t) >= {least})),
segments as (
  select *, tokens[{depth + 1} + p * (n - {depth}) // least(n - {depth}, {line_dedup.SEGMENTS}):{depth} + (p + 1) * (n - {depth}) // least(n - {depth}, {line_dedup.SEGMENTS})] as run
  from (select *, unnest(generate_series(0, least(n - {depth}, {line_dedup.SEGMENTS}) - 1)) as p from live where n > {depth})),
later as (select *, array_to_string(run, chr(1)) as cell, len(run) as size, len(list_filter(run, lambda x: x = {v})) as fields from segments),
constants as (select node, p, cell from later group by all having count(distinct t) >= {least}),
tails as (
  select l.t, l.i, l.n, l.node || chr(2) || string_agg(coalesce(c.cell, chr(4)), chr(2) order by l.p) as key, any_value(l.wild) + sum(case when c.cell is null then l.size else l.fields end) as wild,
    any_value(l.found) + sum((c.cell is null and l.fields < l.size)::int) as found
  from later l left join constants c on l.node = c.node and l.p = c.p and l.cell = c.cell group by l.t, l.i, l.n, l.node),
keyed as (
  select t, i, key from (select t, i, n, key, wild, found from tails union all select t, i, n, node, wild, found from live where n <= {depth})
  where wild * 2 <= n and (found = 0 or n - wild >= {line_dedup.LEAST_CONSTANTS})),
placed0 as (
  select l.t, l.i, len(l.tokens)::varchar || chr(1) || array_to_string(l.tokens[1:{line_dedup.AROUND}], chr(1)) as leaf, k.key
  from lines l left join (select * from keyed where key in (select key from keyed group by key having count(distinct t) >= {least})) k on l.t = k.t and l.i = k.i)""")
    for r in range(_ROUNDS):
        parts.append(f"""around{r} as (
  select t, i, key, coalesce(lag(leaf) over w, '') || chr(3) || coalesce(lead(leaf) over w, '') as near from placed{r} window w as (partition by t order by i)),
first{r} as (select key, t, min_by(near, i) as near from around{r} where key is not null group by key, t),
hot{r} as (
  select key from (select key, near, count(*) as texts from first{r} group by key, near) group by key having count(*) >= {least} and max(texts) * 2 <= sum(texts)),
placed{r + 1} as (select * from placed{r} where key is null or key not in (select key from hot{r}))""")
    hot = " union all ".join(f"select key from hot{r}" for r in range(_ROUNDS))
    parts.append(f"""gone as (select t, i from placed0 where key in ({hot})),
done as (
  select t, count(*) as n_lines, count(gone_i) as n_dropped, coalesce(string_agg(line, chr(10) order by i) filter (where gone_i is null), '') as kept
  from (select x.t, x.i, x.line, g.i as gone_i from (
    select t, i, string_split(text, chr(10))[i] as line from (select t, text, unnest(generate_series(1, len(string_split(text, chr(10))))) as i from texts)) x
    left join gone g on x.t = g.t and x.i = g.i) group by t)
select d.doc_id, coalesce(x.n_lines, 0) as n_lines, coalesce(x.n_dropped, 0) as n_dropped, case when d.text is not null then sha256(x.kept) end as text_sha256
from documents d left join texts on d.text = texts.text left join done x on texts.t = x.t""")
    return "with " + ",\n".join(parts)


SQL = {"op8_line_dedup": _line_dedup_sql()}
