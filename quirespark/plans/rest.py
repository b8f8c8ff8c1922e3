"""Queries of tables, language, quizzes and run state, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import language
from ..operators import quiz, state, tables
from .fixtures import duck, spark_lines
from . import structure
from .passes import UPTO, ex, rm, rr, st

_CUT = lambda c: f"list_transform([list_transform(string_split({rr(st(c), r'^\\|+|\\|+$'.replace(chr(92) * 2, chr(92)))}, '|'), lambda x: {st('x')})], lambda z: z[1:coalesce(list_max(list_transform(z, lambda v, i: case when v <> '' then i end)), 0)])[1]"
_TAB = lambda is_table: f"a as (select *, {is_table} t from lines), b as (select *, sum((not t)::int) {UPTO} block from a), c as (select doc_id, block, line_no, line, {_CUT('line')} cells, {rm(st('line'), tables.DIVIDER)} divider from b where t)"
_T = _TAB(f"{st('line')} like '|%'")
_NORMAL = f"""{_TAB(f"{st('line')} like '|%' and {st('line')} like '%|'")}, d as (select *, len(list_filter(cells, lambda x: x <> '')) filled, row_number() over (partition by doc_id, block order by line_no) rn from c),
e as (select *, coalesce(max(filled) filter (rn = 1) over w = 1 and bool_or(divider) filter (rn = 2) over w and max(filled) filter (rn = 3) over w > 1, false) titled from d window w as (partition by doc_id, block)), f as (select *, not titled or rn > 2 body from e),
g as (select *, max(len(cells)) filter (body and not divider) over w width, coalesce(bool_or(divider) filter (body) over w, false) has from f window w as (partition by doc_id, block)), h as (select *, greatest(width, 2) wd from g),
i as (select *, '| ' || array_to_string(list_concat(cells, list_transform(range(greatest(wd - len(cells), 0)), lambda j: '')), ' | ') || ' |' padded, '| ' || array_to_string(list_transform(range(wd), lambda j: '---'), ' | ') || ' |' rule from h)"""

def _read(spark, d, t):
    return spark.read.parquet(f"{d}/{t}.parquet")


def _marks(spark, d):
    return _read(spark, d, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 7 == 0, (F.col("event_id") / 7).cast("int")).alias("question"),
        F.when(F.col("event_id") % 7 != 0, F.char(F.lit(65) + F.col("event_id") % 8)).alias("letter"),
    )


#: The whole text of a turn between the question's number and its options.
_QUIZ_SPARK = "select conv_id doc_id, cast(turn * 1000 + 1 + p as bigint) line_no, line from {c} lateral view posexplode(split(text, '\\\\n')) e as p, line union all select conv_id, cast(turn * 1000 + i as bigint), case i when 0 then 'Question ' || cast(turn + 1 as string) when 990 then '' when 991 then 'A. ' || role when 992 then 'B) second' else 'C third' end from {c} lateral view explode(array(0, 990, 991, 992, 993)) k as i"
_QUIZ = "select conv_id doc_id, (turn * 1000 + 1 + unnest(range(len(string_split(text, chr(10))))))::bigint line_no, unnest(string_split(text, chr(10))) line from conversations union all select conv_id, (turn * 1000 + i)::bigint, case i when 0 then 'Question ' || (turn + 1) when 990 then '' when 991 then 'A. ' || role when 992 then 'B) second' else 'C third' end from conversations cross join (select unnest([0, 990, 991, 992, 993]) i) k"


def _quiz(spark, d):
    return spark.sql(_QUIZ_SPARK, c=_read(spark, d, "conversations"))


def _plans(spark, d):
    return state.plan_chunks(_read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") * 7).alias("n_pages")))


_PLANS = f"select p_partkey doc_id, (a // 50)::int chunk_no, a || '-' || least(a + 50, p_size * 7) - 1 page_range from (select p_partkey, p_size, unnest(range(0, p_size * 7, {state.CHUNK_PAGES})) a from part)"
_DONE = "select p_partkey doc_id, '0-49' page_range, case when p_partkey % 3 = 0 then 'completed' else 'failed' end status from part"


def _calls(spark, d):
    return _read(spark, d, "events").select(F.col("event_type").alias("task"), (F.col("event_id") % 100).alias("tokens"), (F.col("event_id") % 9 > 0).alias("success"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"))


def _runs(spark, d):
    """Two runs over all orders: some files got another name, some another text."""
    o = _read(spark, d, "orders")
    old = o.select(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("path"), (F.col("o_custkey") % 50).alias("n_lines"), F.sha2("o_orderpriority", 256).alias("sha256"))
    moved = F.when(F.col("o_orderkey") % 7 == 0, "q").otherwise("p")
    new = o.select(F.concat(moved, F.col("o_orderkey").cast("string")).alias("path"), (F.col("o_custkey") % 50 + F.col("o_custkey") % 3).alias("n_lines"), F.when(F.col("o_custkey") % 4 == 0, F.lit("new")).otherwise(F.sha2("o_orderpriority", 256)).alias("sha256"))
    return old, new


def queries() -> dict:
    return {
        "table_blocks": lambda s, d: tables.table_blocks(spark_lines(s, d, "tab")),
        "table_normalize": lambda s, d: tables.normalize_tables(spark_lines(s, d, "tab")),
        "language_filter": lambda s, d: _read(s, d, "documents").select("doc_id", language.non_english(F.col("text")).cast("int").alias("dropped")),
        "answer_asof": lambda s, d: quiz.answers_asof(_marks(s, d)).withColumn("answers", F.array_join("answers", "")),
        "question_split": lambda s, d: quiz.question_runs(_quiz(s, d)).withColumn("options", F.array_join("options", "|")),
        "quiz_render": lambda s, d: quiz.render(quiz.question_runs(_quiz(s, d)).withColumn("answers", F.when(F.col("question") % 2 == 0, F.array(F.lit("B"))))),
        "plan_chunks": _plans,
        "chunk_resume_anti": lambda s, d: state.to_do(_plans(s, d), s.sql(_DONE.replace("from part", "from {p}"), p=_read(s, d, "part"))),
        "chunk_concat_order": lambda s, d: state.concat_chunks(_plans(s, d).withColumn("raw_md", F.concat(F.lit("pages "), "page_range"))),
        "llm_usage_rollup": lambda s, d: state.usage(_calls(s, d)),
        "baseline_diff": lambda s, d: state.baseline_diff(*_runs(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    runs = f"q as ({_QUIZ}), m as (select *, {ex('line', r'^Question (\d+)')} mark from q), r as (select *, sum((mark <> '')::int) {UPTO} run from m), o as (select *, case when mark = '' then {ex('line', r'^([A-H])[.)]? +(\S.*)$', 2)} end option from r where run > 0), n as (select *, max((option <> '')::int) over (partition by doc_id, run order by line_no rows between unbounded preceding and current row) seen from o), items as (select doc_id, max(mark)::int question, coalesce(string_agg(trim(line), ' ' order by line_no) filter (mark = '' and coalesce(seen, 0) = 0 and trim(line) <> ''), '') stem, list(option order by line_no) filter (option <> '') options from n group by doc_id, run)"
    return {
        "table_blocks": f"with {duck('tab')}, {_T} select doc_id, min(line_no) first_line, max(line_no) last_line, sum((not divider)::int) n_rows, max(len(cells)) n_cols from c group by doc_id, block",
        "table_normalize": f"with {duck('tab')}, {_NORMAL} select doc_id, line_no, 0 part, case when titled and rn = 1 then '**' || list_filter(cells, lambda x: x <> '')[1] || '**' when width is null then line when divider then rule else padded end line from i where body or rn = 1 union all select doc_id, line_no, 1, case when titled and rn = 1 then '' else rule end from i where titled and rn = 1 or (width is not null and body and not has and rn = case when titled then 3 else 1 end)",
        "language_filter": structure.language_sql("documents"),
        "answer_asof": "with a as (select user_id doc_id, event_id ord, case when event_id % 7 = 0 then (event_id // 7)::int end question, case when event_id % 7 <> 0 then chr((65 + event_id % 8)::int) end letter from events), b as (select *, last_value(question ignore nulls) over (partition by doc_id order by ord rows between unbounded preceding and current row) q from a) select doc_id, q question, string_agg(letter, '' order by ord) answers from b where letter is not null and q is not null group by 1, 2",
        "question_split": f"with {runs} select doc_id, question, stem, array_to_string(coalesce(options, []), '|') options from items",
        "quiz_render": f"with {runs} select doc_id, question, '### Question ' || question || case when stem <> '' then chr(10) || chr(10) || stem else '' end || chr(10) || chr(10) || array_to_string(list_transform(options, lambda x, i: '- ' || chr((64 + i)::int) || '. ' || x || case when question % 2 = 0 and i = 2 then ' ✓' else '' end), chr(10)) || case when question % 2 = 0 then chr(10) || chr(10) || '**Answer:** B' else '' end md from items",
        "plan_chunks": _PLANS,
        "chunk_resume_anti": f"with p as ({_PLANS}), d as ({_DONE}) select * from p where not exists (select 1 from d where d.doc_id = p.doc_id and d.page_range = p.page_range and status = 'completed')",
        "chunk_concat_order": f"with p as ({_PLANS}) select doc_id, string_agg('pages ' || page_range, chr(10) || chr(10) order by chunk_no) md from p group by 1",
        "llm_usage_rollup": "select event_type task, count(*) calls, sum(event_id % 100) tokens, sum((event_id % 9 = 0)::int) failed, string_agg(distinct 'm' || user_id % 3, ',' order by 'm' || user_id % 3) models from events group by rollup (event_type)",
        "baseline_diff": "with o as (select 'p' || o_orderkey path, o_custkey % 50 n_lines, o_orderpriority h from orders), n as (select case when o_orderkey % 7 = 0 then 'q' else 'p' end || o_orderkey path, o_custkey % 50 + o_custkey % 3 n_lines, case when o_custkey % 4 = 0 then 'new' else o_orderpriority end h from orders) select path, case when o.h is null then 'added' when n.h is null then 'removed' else 'changed' end change, coalesce(n.n_lines, 0) - coalesce(o.n_lines, 0) delta from o full join n using (path) where o.h is null or n.h is null or o.h <> n.h",
    }
