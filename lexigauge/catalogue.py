"""All queries of the library by name, and the SQL that gives the same rows.

Texts come from ``documents``, whole, with characters beyond ASCII as ``?`` where distances are measured (SQL measures bytes)
and lines as paragraphs; models are known deviations of them. Ranking and stability work on error counts from ``lineitem``:
a region's suppliers are a model, the return flag a segmentation, the line number a level, the month of shipping a sample.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import audit as audit_fn
from .functions import flatten
from .functions.chars import FULL_WIDTH, PUNCTUATION
from .functions.edit import edit_ops, guarded_distance, overflows
from .functions.normalize import LEVELS, RULE_KINDS, enabled_rules, length_rules, normalize, punctuation_keeps_length
from .functions.segment import SEG_MODES, align_blocks, split_blocks
from .operators import bootstrap, layout, scoring, stability
from .plans import variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- normalisation -------------------------------------------------------------------------------------------------
# Characters that the levels act on are put in for ASCII ones, the same way on both sides.
_WIDE_FROM, _WIDE_TO = "0123456789aeiou", "０１２３４５６７８９ａｅｉｏｕ"
_PAIRS = {"體": "体", "檢": "检", "報": "报", "問": "问", "題": "题"}
_HAN_FROM, _HAN_TO = "hsntr", "體檢報問題"
_FULL = ("".join(FULL_WIDTH), "".join(FULL_WIDTH.values()))
_PUNCT = ("".join(PUNCTUATION), "".join(PUNCTUATION.values()))
_QUOTED = lambda t: t.replace("'", "''")
_WS = r"[\t-\r\x1c-\x20]"


def _dressed(text):
    """ASCII text with full-width letters, ideographs and wide punctuation."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x00-\x7f]", "?")
    return F.translate(F.translate(t, _WIDE_FROM + ".,", _WIDE_TO + "。，"), _HAN_FROM, _HAN_TO)


_DRESSED = f"translate(translate(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7f]', '?', 'g'), '{_WIDE_FROM}.,', '{_WIDE_TO}。，'), '{_HAN_FROM}', '{_HAN_TO}')"


def _level_sql(level: str) -> str:
    t = f"regexp_replace({_DRESSED}, '^{_WS}+|{_WS}+$', '', 'g')"
    steps = [
        lambda x: f"regexp_replace({x}, '{_WS}+', ' ', 'g')",
        lambda x: f"lower({x})",
        lambda x: f"translate({x}, '{_FULL[0]}', '{_QUOTED(_FULL[1])}')",
        lambda x: f"translate({x}, '{_PUNCT[0]}', '{_QUOTED(_PUNCT[1])}')",
        # without look-around, a second pass catches what shares an ideograph
        lambda x: f"regexp_replace(regexp_replace(translate({x}, '{''.join(_PAIRS)}', '{''.join(_PAIRS.values())}'), '([一-鿿])[ \\t]+([一-鿿])', '\\1\\2', 'g'), '([一-鿿])[ \\t]+([一-鿿])', '\\1\\2', 'g')",
    ]
    for step in steps[: LEVELS.index(level)]:
        t = step(t)
    return f"select doc_id, {t} as text from documents"


def _norm(level: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scoring.spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", normalize(_dressed(F.col("text")), level, _PAIRS).alias("text"))

    run.__name__ = f"norm_{level.lower()}"
    return run


for _level in LEVELS:
    query(_level_sql(_level))(_norm(_level))

_RULES = "(values ('P0', 0, 'strip'), ('P1', 1, 'collapse_ws'), ('P2', 2, 'casefold'), ('P3', 3, 'fullwidth_to_halfwidth'), ('P4', 4, 'punct_unify'), ('P5', 5, 'trad_to_simp'), ('P5', 6, 'drop_cjk_space')) as r(level, ord, rule)"


@query(f"select a.level, string_agg(b.rule, ',' order by b.ord) as rules from (select level, max(ord) as ord from {_RULES} group by level) a join {_RULES.replace('as r(', 'as b(')} on b.ord <= a.ord group by a.level")
def rules_enabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enabled_rules(spark).select("level", F.array_join("rules", ",").alias("rules"))


@query(f"select a.level, coalesce(string_agg(b.rule, ',' order by b.ord) filter (where b.rule in ('collapse_ws', 'drop_cjk_space')), '') as rules from (select level, max(ord) as ord from {_RULES} group by level) a join {_RULES.replace('as r(', 'as b(')} on b.ord <= a.ord group by a.level")
def rules_of_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_rules(spark).select("level", F.array_join("rules", ",").alias("rules"))


@query("select true as keeps_length, 25 as n")
def punctuation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit(punctuation_keeps_length()).alias("keeps_length"), F.lit(len(PUNCTUATION)).alias("n"))


# ---- segmentation --------------------------------------------------------------------------------------------------
def _plain(text):
    return F.replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x00-\x7f]", "?"), F.lit("\n"), F.lit("\n\n"))


_PLAIN = "replace(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7f]', '?', 'g'), chr(10), chr(10) || chr(10))"
_STRIP = lambda x: f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"
_HEAD = "(b = '' or starts_with(b, '#') or starts_with(b, '|') or starts_with(b, '-') or starts_with(b, '*') or starts_with(b, '>') or starts_with(b, '```') or starts_with(b, '$$') or starts_with(b, '![') or (not contains(b, chr(10)) and length(b) <= 12 and not regexp_matches(b, '[.!?;:\")]$')))"


def _blocks_sql(source: str, keys: str) -> str:
    """CTEs from ``source (keys, s)`` to ``blocks (keys, seg_mode, pos, b)``."""
    return f"""
stripped as (select {keys}, {_STRIP("s")} as s from {source}),
paras as (
  select {keys}, i as pos, {_STRIP("parts[i]")} as b
  from (select {keys}, parts, unnest(generate_series(1, len(parts))) as i from (select {keys}, string_split_regex(s, '\\n{_WS}*\\n+') as parts from stripped where s <> '')) where {_STRIP("parts[i]")} <> ''),
flagged as (
  select {keys}, pos, b, case when lag(b) over w is null then 1 when regexp_matches(lag(b) over w, '[.!?;:")]$') or {_HEAD} then 1 else 0 end as fresh
  from paras window w as (partition by {keys} order by pos)),
islands as (select {keys}, pos, b, sum(fresh) over (partition by {keys} order by pos) as island from flagged),
blocks as (
  select {keys}, 'whole' as seg_mode, 1 as pos, s as b from stripped where s <> ''
  union all select {keys}, 'para', row_number() over (partition by {keys} order by pos), b from paras
  union all select {keys}, 'para_merge', island, string_agg(b, chr(10) order by pos) from islands group by {keys}, island)"""


def _split(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split_blocks(_plain(F.col("text")), mode)).alias("pos", "block"))
        return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "block")

    run.__name__ = f"split_{mode}"
    return run


for _mode in SEG_MODES:
    query(f"with source as (select doc_id, {_PLAIN} as s from documents), {_blocks_sql('source', 'doc_id')} select doc_id, cast(pos - 1 as bigint) as pos, b as block from blocks where seg_mode = '{_mode}'")(_split(_mode))

_MODELS = {
    "clean": ("replace(ref, 'th', 't')", lambda r: F.replace(r, F.lit("th"), F.lit("t"))),
    "flat": ("replace(ref, chr(10), ' ')", lambda r: F.replace(r, F.lit("\n"), F.lit(" "))),
    "missing": ("case when source <> 'src0' then ref else '' end", lambda r: F.when(F.col("source") != "src0", r).otherwise("")),
    "space": ("replace(ref, ' ', '  ')", lambda r: F.replace(r, F.lit(" "), F.lit("  "))),
    "upper": ("upper(ref)", F.upper),
}


def ref_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (sample_id, ref, texts) with the texts of all virtual models, structs (model, text)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), "source", _plain(F.col("text")).alias("ref"))
    docs = scoring.spread(docs, 4)  # before there are rows of models, so that those of a text stay together; few partitions leave cores idle at the end
    cells = F.array(*(F.struct(F.lit(m).alias("model"), f(F.col("ref")).alias("text")) for m, (_, f) in _MODELS.items()))
    return docs.select("sample_id", "ref", cells.alias("texts"))


def model_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (model, sample_id, ref, text) of the virtual models."""
    return ref_texts(spark, sf_dir).select("sample_id", "ref", F.explode("texts").alias("m")).select("m.model", "sample_id", "ref", "m.text")


_SAMPLES = f"""
base as (select doc_id, source, {_PLAIN} as ref from documents),
texts as ({" union all ".join(f"select '{m}' as model, doc_id, 'h' as side, {e} as s from base" for m, (e, _) in _MODELS.items())} union all select 'ref', doc_id, 'r', ref from base),
{_blocks_sql("texts", "model, doc_id, side")},
grid as (select m.model, b.doc_id, s.seg_mode from (select distinct model from texts where side = 'h') m, base b, (values ('whole'), ('para'), ('para_merge')) as s(seg_mode)),
aligned as (
  select coalesce(h.model, g.model) as model, coalesce(r.doc_id, h.doc_id) as doc_id, coalesce(r.seg_mode, h.seg_mode) as seg_mode, coalesce(r.b, '') as r, coalesce(h.b, '') as h
  from (select m.model, x.* exclude (model, side) from blocks x, (select distinct model from texts where side = 'h') m where x.side = 'r') r
  full join (select * from blocks where side = 'h') h on r.model = h.model and r.doc_id = h.doc_id and r.seg_mode = h.seg_mode and r.pos = h.pos
  left join grid g on g.model = r.model and g.doc_id = r.doc_id and g.seg_mode = r.seg_mode),
leveled as (
  select model, doc_id, seg_mode, 'P0' as level, r, h, length(r) as fixed from aligned
  union all select model, doc_id, seg_mode, 'P1', regexp_replace(r, '{_WS}+', ' ', 'g'), regexp_replace(h, '{_WS}+', ' ', 'g'), length(r) from aligned
  union all select model, doc_id, seg_mode, 'P2', lower(regexp_replace(r, '{_WS}+', ' ', 'g')), lower(regexp_replace(h, '{_WS}+', ' ', 'g')), length(r) from aligned),
sums as (
  select model, doc_id, seg_mode, level, sum(case when r = h then 0 when cast(length(r) as bigint) * length(h) > 4000000 then abs(length(r) - length(h)) else levenshtein(r, h) end) as dist,
    sum(length(r)) as ref_len, sum(fixed) as fixed_len, max(case when cast(length(r) as bigint) * length(h) > 4000000 then 1 else 0 end) as overflow
  from leveled group by all),
samples as (
  select g.model, g.doc_id as sample_id, g.seg_mode, l.level, cast(coalesce(s.dist, 0) as bigint) as dist, cast(coalesce(s.ref_len, 0) as bigint) as ref_len,
    cast(coalesce(s.fixed_len, 0) as bigint) as fixed_len, coalesce(s.overflow, 0) as overflow
  from grid g cross join (values ('P0', 'P0'), ('P1', 'P1'), ('P2', 'P2'), ('P3', 'P2'), ('P4', 'P2'), ('P5', 'P2')) as l(level, same)
  left join sums s on s.model = g.model and s.doc_id = g.doc_id and s.seg_mode = g.seg_mode and s.level = l.same)"""


@query(f"with {_SAMPLES} select * from samples")
def sample_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.sample_scores(model_texts(spark, sf_dir), pairs={})


_GUARDED = "case when r = h then 0 when cast(length(r) as bigint) * length(h) > 4000000 then abs(length(r) - length(h)) else levenshtein(r, h) end"
_MISSING = lambda a, b: f"list_sum([greatest(0, length({a}) - length(replace({a}, chr(cast(c as int)), '')) - length({b}) + length(replace({b}, chr(cast(c as int)), ''))) for c in range(1, 128)])"
# Without the guard, all pairs have their distance. That of long ones is the sum over their words and gaps if it meets a lower bound (lengths, or characters that
# the other text lacks), else it is the function's.
_EXACT = f"""case when r = h then 0 when cast(length(r) as bigint) * length(h) <= 4000000 then levenshtein(r, h)
  when coalesce(high = greatest({_MISSING("r", "h")}, {_MISSING("h", "r")}), false) then high else levenshtein(r, h) end"""
_WORDS = lambda x: f"regexp_extract_all({x}, '[ \\n]+|[^ \\n]+')"
_HIGH = f"""case when r <> h and cast(length(r) as bigint) * length(h) > 4000000 and len({_WORDS("r")}) = len({_WORDS("h")})
  then list_sum([levenshtein(p[1], p[2]) for p in list_zip({_WORDS("r")}, {_WORDS("h")})]) end"""
_WHOLE_SAMPLES = _SAMPLES.replace(_GUARDED, _EXACT).replace("from leveled group by all", f"from (select *, {_HIGH} as high from leveled) group by all")

_FIXED = "greatest(1, case when fixed_len > 0 then fixed_len else ref_len end)"


@query(
    f"with {_WHOLE_SAMPLES} select seg_mode, level, model, round(sum(dist) / sum(greatest(1, ref_len)), 6) as cer, round(sum(dist) / sum({_FIXED}), 6) as cer_fixed, cast(sum(greatest(1, ref_len)) as bigint) as ref_len, cast(sum(overflow) as bigint) as overflow_samples from samples group by all"
)
def corpus_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a leaderboard for every segmentation and level."""
    return scoring.leaderboard(scoring.score_sums(ref_texts(spark, sf_dir), pairs={}, guard=False))


@query(f"with {_WHOLE_SAMPLES} select seg_mode, level, model, round(sum(dist) / sum(greatest(1, ref_len)), 6) as micro, round(avg(dist / greatest(1, ref_len)), 6) as macro from samples group by all")
def corpus_cer_macro_vs_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.macro_board(scoring.score_sums(ref_texts(spark, sf_dir), pairs={}, guard=False))


@query(f"with {_SAMPLES} select seg_mode, level, cast(sum(overflow) as bigint) as overflow_samples, count(*) as n from samples group by all")
def overflow_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.sample_overflow(model_texts(spark, sf_dir), pairs={})
    return rows.groupBy("seg_mode", "level").agg(F.sum("overflow").alias("overflow_samples"), F.count("*").alias("n"))


@query(f"with {_SAMPLES} select model, sample_id, dist, ref_len from samples where model = 'missing' and seg_mode = 'para' and level = 'P0'")
def missing_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join: what a model lacks counts as deleted."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), "source", _plain(F.col("text")).alias("ref"))
    there = docs.where("source != 'src0'").select(F.lit("missing").alias("model"), "sample_id", F.col("ref").alias("text"))
    joined = scoring.with_predictions(docs.select("sample_id", "ref"), there, spark.createDataFrame([("missing",)], "model string"))
    rows = scoring.sample_scores(joined, ["para"], ["P0"], {})
    return rows.select("model", "sample_id", "dist", "ref_len")


@query(
    "with t as (select conv_id, turn, role, text from conversations), u as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as pos, text as ref from t where role = 'user'), "
    "a as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as pos, text as hyp from t where role <> 'user') "
    "select conv_id, cast(pos as bigint) as pos, ref, hyp from u full join a using (conv_id, pos)"
)
def aligned_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and answers side by side by position."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    side = lambda user: F.transform(F.filter("t", lambda x: (x["role"] == "user") == F.lit(user)), lambda x: x["text"])
    rows = turns.select("conv_id", F.posexplode(align_blocks(side(True), side(False))).alias("pos", "x"))
    return rows.select("conv_id", F.col("pos").cast("bigint").alias("pos"), F.col("x.ref").alias("ref"), F.col("x.hyp").alias("hyp"))


_PART_PAIR = "select p_partkey, p_name as r, p_type as h from part"


@query(f"select p_partkey, levenshtein(r, h) as dist from ({_PART_PAIR})")
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", guarded_distance(F.col("p_name"), F.col("p_type")).cast("bigint").alias("dist"))


@query("select doc_id, cast(length(text) as bigint) * length(text) > 4000000 as overflow from documents")
def edit_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", overflows(F.col("text"), F.col("text")).alias("overflow"))


@query()
def edit_sdi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substitutions, deletions and insertions; no SQL counts them (tests hold them against a full matrix)."""
    return table(spark, sf_dir, "part").select("p_partkey", edit_ops("p_name", "p_type").alias("o")).select("p_partkey", "o.*")


@query()
def group_scores_sdi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rates of the leaderboard, paragraphs as blocks."""
    return scoring.group_scores(scoring.sample_ops(model_texts(spark, sf_dir), ["para"], ["P2"], {}))


# ---- ranking and stability -----------------------------------------------------------------------------------------
_SEG = {"A": "whole", "N": "para", "R": "para_merge"}
N_BOOT = 200


def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (seg_mode, level, model, ord, err, den): errors and characters per model, group and month."""
    line, supplier, nation, region = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "region"))
    rows = line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    seg = F.element_at(F.create_map(*(F.lit(x) for kv in _SEG.items() for x in kv)), F.col("l_returnflag"))
    return rows.groupBy(
        seg.alias("seg_mode"), F.concat(F.lit("P"), F.least(F.col("l_linenumber"), F.lit(6)) - 1).alias("level"), F.col("r_name").alias("model"), F.month("l_shipdate").cast("int").alias("m")
    ).agg(F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("err"), F.sum(F.round("l_quantity").cast("bigint")).alias("den")).withColumn("ord", F.col("m") - 1).drop("m")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group scores with bootstrap intervals over months; a few rows per group."""
    counts = error_counts(spark, sf_dir)  # the aggregate is one exchange, used again
    keys = ["seg_mode", "level", "model"]
    cis = bootstrap.intervals(counts, bootstrap.hashed(spark, 12, N_BOOT), keys, N_BOOT)
    rates = counts.groupBy(*keys).agg(F.round(F.sum("err") / F.sum("den"), 6).alias("cer"), F.sum("den").alias("ref_len"))
    # one more denominator that stays the same at all levels
    fixed = counts.where("level = 'P0'").groupBy("seg_mode").agg(F.sum("den").alias("fixed"))
    err = counts.groupBy(*keys).agg(F.sum("err").alias("err"))
    return rates.join(err, keys).join(F.broadcast(fixed), "seg_mode").join(cis, keys).withColumn("cer_fixed", F.round(F.col("err") / F.col("fixed"), 6)).drop("err", "fixed")


_LOW, _HIGH = bootstrap.picks(N_BOOT)
_SCORED = f"""
counts as (
  select case l_returnflag when 'A' then 'whole' when 'N' then 'para' when 'R' then 'para_merge' end as seg_mode, 'P' || cast(least(l_linenumber, 6) - 1 as varchar) as level, r_name as model, month(l_shipdate) - 1 as ord,
    cast(sum(cast(round(l_discount * 100) as bigint)) as bigint) as err, cast(sum(cast(round(l_quantity) as bigint)) as bigint) as den
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all),
resamples as (select b, pick as ord, count(*) as mult from (select b, (b * 7919 + i * 104729 + b * i * 31) % 12 as pick from generate_series(0, {N_BOOT - 1}) as x(b), generate_series(0, 11) as y(i)) group by b, pick),
rates as (select seg_mode, level, model, b, sum(mult * err) / sum(mult * den) as rate from counts join resamples using (ord) group by all),
cis as (select seg_mode, level, model, round(list_sort(list(rate))[{_LOW + 1}], 6) as ci_lo, round(list_sort(list(rate))[{_HIGH + 1}], 6) as ci_hi from rates group by all),
fixed as (select seg_mode, sum(den) as fixed from counts where level = 'P0' group by all),
scores as (
  select c.seg_mode, c.level, c.model, round(sum(err) / sum(den), 6) as cer, round(sum(err) / max(fixed), 6) as cer_fixed, cast(sum(den) as bigint) as ref_len, max(ci_lo) as ci_lo, max(ci_hi) as ci_hi
  from counts c join fixed using (seg_mode) join cis using (seg_mode, level, model) group by all),
ranks as (select seg_mode, level, model, cast(row_number() over (partition by seg_mode, level order by cer_fixed, model) as int) as rank, cer_fixed, cer from scores),
spans as (select model, round(max(cer_fixed) - min(cer_fixed), 6) as span from scores group by model),
ref as (select cast(row_number() over (order by cer_fixed, model) as int) as ref_rank, model, cer_fixed as ref_score, ci_lo, ci_hi from scores where seg_mode = 'para_merge' and level = 'P0'),
flips as (select a.model as model_a, b.model as model_b, count(*) filter (where b.cer_fixed < a.cer_fixed - 1e-12) as flips from scores a join scores b using (seg_mode, level) where a.model <> b.model group by all),
near as (
  select model, case when p is not null and (gs is null or gp <= gs) then p else s end as neighbour, case when p is not null and (gs is null or gp <= gs) then gp else gs end as gap_nearest, p is not null and (gs is null or gp <= gs) as before
  from (select model, lag(model) over w as p, lead(model) over w as s, round(abs(ref_score - lag(ref_score) over w), 6) as gp, round(abs(lead(ref_score) over w - ref_score), 6) as gs from ref window w as (order by ref_rank))),
adjacent as (
  select a.ref_rank as rank, a.model as model_a, b.model as model_b, a.ref_score as cer_a, b.ref_score as cer_b, a.ci_lo as lo_a, a.ci_hi as hi_a, b.ci_lo as lo_b, b.ci_hi as hi_b, x.span as span_a, y.span as span_b, round(b.ref_score - a.ref_score, 6) as gap
  from ref a join ref b on b.ref_rank = a.ref_rank + 1 join spans x on x.model = a.model join spans y on y.model = b.model)"""


def _of_scores(sql: str):
    """Register a query on the group scores."""

    def add(f: Callable[[DataFrame], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(scored(spark, sf_dir))

        run.__name__ = f.__name__
        query(f"with {_SCORED} {sql}")(run)
        return f

    return add


@_of_scores("select seg_mode, level, model, ci_lo, ci_hi from scores")
def bootstrap_ci(s: DataFrame) -> DataFrame:
    return s.select("seg_mode", "level", "model", "ci_lo", "ci_hi")


@_of_scores("select * from ranks")
def rank_matrix(s: DataFrame) -> DataFrame:
    return stability.rank_matrix(s)


@_of_scores("select * from ref")
def ref_order(s: DataFrame) -> DataFrame:
    return stability.ref_order(s)


@_of_scores("select * from spans")
def model_span(s: DataFrame) -> DataFrame:
    return stability.spans(s)


@_of_scores("select * from flips")
def flips(s: DataFrame) -> DataFrame:
    return stability.flips(s)


@_of_scores("select * from adjacent")
def adjacent_pairs(s: DataFrame) -> DataFrame:
    return stability.adjacent_pairs(s)


_VERDICT = "case when lo_a <= hi_b + 1e-12 and lo_b <= hi_a + 1e-12 then 'TIE' when flips > 0 then 'FRAGILE' when margin < 1 then 'FRAGILE' else 'STABLE' end"


@_of_scores(
    "select rank, model_a, model_b, cer_a, cer_b, gap, span_a, span_b, round(margin, 6) as margin, flips as flipped_groups, cast(lo_a <= hi_b + 1e-12 and lo_b <= hi_a + 1e-12 as int) as ci_overlap, "
    f"{_VERDICT} as verdict, 'para_merge/P0' as ref_group from (select *, case when span_a + span_b <= 0 then 'inf'::double else abs(gap) / (span_a + span_b) end as margin from adjacent join flips using (model_a, model_b))"
)
def verdicts(s: DataFrame) -> DataFrame:
    return stability.verdicts(s)


@_of_scores("select * from near")
def nearest_neighbour(s: DataFrame) -> DataFrame:
    return stability.nearest(s)


def _stability_sql(turned: str) -> str:
    return f"""select r.*, j.* exclude (model) from (
  select model, count(*) as n_groups, min(rank) as rank_min, max(rank) as rank_max, max(rank) - min(rank) as rank_shift, round(avg(rank), 3) as rank_mean, round(stddev_pop(rank), 3) as rank_std,
    min(cer_fixed) as cer_fixed_min, max(cer_fixed) as cer_fixed_max, round(max(cer_fixed) - min(cer_fixed), 6) as cer_fixed_spread, min(cer) as cer_min, max(cer) as cer_max from ranks group by model) r
join (select model, ref_score as ref_cer_fixed, lo_a as ref_ci_lo, hi_a as ref_ci_hi, gap_nearest, round(margin, 6) as margin, case when neighbour is null then 'N/A' else {_VERDICT} end as verdict from (
  select f.model, f.ref_score, f.ci_lo as lo_a, f.ci_hi as hi_a, g.ci_lo as lo_b, g.ci_hi as hi_b, n.gap_nearest, n.neighbour, x.flips, case when a.span + b.span <= 0 then 'inf'::double else abs(n.gap_nearest) / (a.span + b.span) end as margin
  from ref f join near n using (model) left join ref g on g.model = n.neighbour join spans a on a.model = f.model left join spans b on b.model = n.neighbour
  left join flips x on x.model_a = (case when {turned} then n.neighbour else f.model end) and x.model_b = (case when {turned} then f.model else n.neighbour end))) j using (model)"""


@_of_scores(_stability_sql("false"))
def stability_summary(s: DataFrame) -> DataFrame:
    return stability.stability(s)


@_of_scores(_stability_sql("n.before"))
def stability_oriented(s: DataFrame) -> DataFrame:
    return stability.stability(s, compat=False)


@_of_scores(
    "select *, round(\"P0\" - \"P5\", 6) as \"drop_P0_to_P5\" from (select model, "
    + ", ".join(f"round(avg(cer_fixed) filter (where level = '{v}'), 6) as \"{v}\"" for v in LEVELS)
    + " from scores group by model)"
)
def protocol_curve(s: DataFrame) -> DataFrame:
    return stability.protocol_curve(s)


@_of_scores(
    "select * from (select seg_mode, model, lag(level) over w as from_level, level as to_level, lag(cer_fixed) over w as before, cer_fixed as after from scores window w as (partition by seg_mode, model order by level)) where after > before + 1e-12"
)
def monotonicity(s: DataFrame) -> DataFrame:
    return stability.monotonicity(s)


@_of_scores("select a.model as model_a, b.model as model_b from ref a join ref b on a.model < b.model where a.ci_lo <= b.ci_hi + 1e-12 and b.ci_lo <= a.ci_hi + 1e-12")
def tied_pairs(s: DataFrame) -> DataFrame:
    return stability.tied_pairs(s)


@_of_scores("select a.model as model_a, b.model as model_b from ref a join ref b on a.model < b.model where (a.ci_hi < b.ci_lo or b.ci_hi < a.ci_lo) and a.ref_score <> b.ref_score")
def significant_pairs(s: DataFrame) -> DataFrame:
    return stability.significant_pairs(s)


@_of_scores("select count(*) filter (where verdict = 'STABLE') as stable, count(*) as pairs from (" + f"select {_VERDICT} as verdict from (select *, case when span_a + span_b <= 0 then 'inf'::double else abs(gap) / (span_a + span_b) end as margin from adjacent join flips using (model_a, model_b)))")
def verdict_counts(s: DataFrame) -> DataFrame:
    return stability.verdicts(s).agg(F.count_if(F.col("verdict") == "STABLE").alias("stable"), F.count("*").alias("pairs"))


@_of_scores("select count(distinct model) as n_models, count(distinct (seg_mode, level)) as n_groups, string_agg(distinct seg_mode, ',' order by seg_mode) as seg_modes from scores")
def run_meta(s: DataFrame) -> DataFrame:
    return s.agg(F.countDistinct("model").alias("n_models"), F.countDistinct("seg_mode", "level").alias("n_groups"), F.array_join(F.array_sort(F.collect_set("seg_mode")), ",").alias("seg_modes"))


# ---- audit, flattening, files --------------------------------------------------------------------------------------
_WIDE_DIGITS, _WIDE_LETTERS = "０１２３４５６７８９", "".join(chr(c) for c in [*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)])
_COUNT = lambda chars: f"len(list_filter(chars, lambda c: c <> '' and contains('{_QUOTED(chars)}', c)))"
_AUDIT = f"""
dressed as (select doc_id, {_DRESSED} as text from documents),
lists as (select doc_id, text, list_distinct(string_split(text, '')) as chars, string_split(text, chr(10)) as lines from dressed),
audited as (
  select doc_id, length(text) as n_chars, len(lines) as n_lines, {_COUNT("".join(_PAIRS))} as trad_only, {_COUNT(_WIDE_DIGITS)} as fullwidth_digit, {_COUNT(_WIDE_LETTERS)} as fullwidth_alpha,
    cast(regexp_matches(text, '[㐀-䶿一-鿿]') and regexp_matches(text, '[A-Za-z]') as int) as cjk_latin_mix, {_COUNT("".join(PUNCTUATION))} as fullwidth_punct, {_COUNT(audit_fn.ASCII_PUNCTUATION)} as ascii_punct,
    cast({_COUNT("".join(PUNCTUATION))} > 0 and {_COUNT(audit_fn.ASCII_PUNCTUATION)} > 0 as int) as punct_mixed, cast(regexp_matches(text, '[㐀-䶿一-鿿][ \\t][㐀-䶿一-鿿]') as int) as cjk_space,
    cast(contains(text, '  ') or contains(text, chr(9)) as int) as multi_space, cast(len(list_filter(lines, lambda l: regexp_matches(l, '^[ \\t].*\\S'))) > 0 as int) as indent,
    cast(regexp_matches(text, '[\\x{{1F300}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}\\x{{FE0F}}]') as int) as emoji
  from lists)"""


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scoring.spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", _dressed(F.col("text")).alias("text"))
    return docs.select("doc_id", *audit_fn.audit(F.col("text"), "".join(_PAIRS)))


@query(f"with {_AUDIT} select * from audited")
def audit_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir)


@query(
    f"with {_AUDIT}, u as (unpivot (select {', '.join(f'count(*) filter (where {f} > 0) as {f}' for f in audit_fn.FEATURES)} from audited) on {', '.join(audit_fn.FEATURES)} into name feature value hits) "
    "select feature, hits, case when hits = 0 then 'blank' when hits < 3 then 'sparse' else 'ok' end as state from u"
)
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_fn.summary(_audited(spark, sf_dir))


@query(
    f"select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<br{_WS}*/?>{_WS}*', chr(10), 'gi'), '</t[dh]>{_WS}*', chr(9), 'gi'), '</tr>{_WS}*', chr(10), 'gi'), '<[^>]+>', '', 'g') as text from pages"
)
def md_to_plain_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", flatten.tags_to_plain(F.col("html")).alias("text"))


@query()
def md_to_plain_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps; SQL's expressions lack back references and look-around (tests have the cases)."""
    return table(spark, sf_dir, "pages").select("page_id", flatten.md_to_plain(F.col("html")).alias("text"))


@query("select doc_id, contains(text, chr(13)) as dirty, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as text from documents")
def eol_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.contains("text", F.lit("\r")).alias("dirty"), F.regexp_replace("text", "\r\n?", "\n").alias("text"))


@query("select doc_id, sha256(text) as sha256 from documents")
def file_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("select coalesce(d.doc_id, l.doc_id) as doc_id, case when l.doc_id is null then 'only_a' else 'only_b' end as state from documents d full join (select distinct doc_id from labels) l on d.doc_id = l.doc_id where d.doc_id is null or l.doc_id is null")
def set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id").distinct()
    return a.join(b, "doc_id", "left_anti").withColumn("state", F.lit("only_a")).unionByName(b.join(a, "doc_id", "left_anti").withColumn("state", F.lit("only_b")))


@query("select string_agg(distinct coalesce(source, 'unknown'), ',' order by coalesce(source, 'unknown')) as sources from documents")
def data_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("source", F.lit("unknown")))), ",").alias("sources"))


@query()
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a text's words, laid out by their hashes, put into lines (a sequential fold; tests have the cases)."""
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("texts"))
    at = lambda w, i, k, n: F.pmod(F.xxhash64(w, i, F.lit(k)), F.lit(n)).cast("double")
    corner = lambda x, y: F.array(x, y)
    box = lambda w, i: F.array(corner(at(w, i, 1, 500), at(w, i, 2, 90)), corner(at(w, i, 1, 500) + 40, at(w, i, 2, 90)), corner(at(w, i, 1, 500) + 40, at(w, i, 2, 90) + 20), corner(at(w, i, 1, 500), at(w, i, 2, 90) + 20))
    return layout.reading_order(lines.withColumn("boxes", F.transform("texts", box)))


_ASCII = "".join(chr(c) for c in range(0x21, 0x7F))


@query(
    "select doc_id, translate(text, '" + _QUOTED(_ASCII) + "', '" + "".join(chr(ord(c) + 0xFEE0) for c in _ASCII) + "') as wide, replace(text, chr(10) || chr(10), chr(10)) as flat, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') as upper, "
    f"translate(text, '{''.join(_PAIRS.values())}', '{''.join(_PAIRS)}') as trad from documents"
)
def demo_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", variants.to_full_width(t).alias("wide"), variants.flattened(t).alias("flat"), variants.upper_latin(t).alias("upper"), variants.to_traditional(t, _PAIRS).alias("trad")
    )


@query("select rule, kind from (values " + ", ".join(f"('{r}', '{k}')" for r, k in RULE_KINDS.items()) + ") as r(rule, kind)")
def rule_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(RULE_KINDS.items()), "rule string, kind string")
