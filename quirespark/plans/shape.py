"""Queries of heading levels, outlines, contents and clean-up, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fragments as X
from ..functions import text as T
from ..operators import normalize as N
from ..operators import structure as Z
from ..session import spread
from .fixtures import duck, spark_lines
from .passes import UPTO, ex, rm, rr, st

TEMPLATED = """select doc_id, case doc_id % 4 when 0 then '| date | version | Description | Author |' || chr(10) || 'Delete all Instructional Text' || chr(10) when 1 then 'See (#_Toc3522) only' || chr(10) when 2 then '<Project Name> (#_Toc1) Remove blank rows' || chr(10) else '' end || case when doc_id % 3 = 0 then '## no' || chr(10) else '' end || '# ' || source || chr(10) || text md from documents"""
ENTITIES = """select doc_id, '&eacute;t&eacute; &amp;amp; &#39;x&#x27; &lt;b&gt; ' || text || chr(10) || '```' || chr(10) || '&amp; stays' || chr(10) || '```' || chr(10) || '&copy; &rarr;' md from documents"""
REPLIES = """select c_custkey doc_id, '1: ' || cast(c_nationkey % 9 as string) || chr(10) || ' 2 : 3 ' || chr(10) || 'three: 4' || chr(10) || '2: ' || cast(c_custkey % 7 as string) || chr(10) || '5: 9' || chr(10) || '4: 0 and more' reply from customer"""
EMBEDDED = """select o_orderkey doc_id, 'Order' || chr(10) || '<table>' || chr(10) || '<tr><th>Status</th><th>Priority</th></tr>' || chr(10) || '<tr><td>' || o_orderstatus || '</td><td><b>' || o_orderpriority || '</b></td></tr>' || chr(10) || '</table>' || chr(10) || '```' || chr(10) || '<table><tr><td>x</td></tr></table>' || chr(10) || '```' || chr(10) || '<img src="images/o.png" alt="' || o_orderpriority || '">' || chr(10) || 'in <table> a line' || chr(10) || '<table>' || chr(10) || 'never closed' md from orders"""


def _md(text: str, table: str, rows: int = 0, key: str = ""):
    """The texts of a table; with ``rows`` made in a task per so many."""
    read = lambda s, d: s.read.parquet(f"{d}/{table}.parquet")
    return lambda s, d: s.sql(text.replace(f"from {table}", "from {t}"), t=spread(read(s, d), rows, key) if rows else read(s, d))


_templated, _entities, _replies, _embedded = _md(TEMPLATED, "documents"), _md(ENTITIES, "documents"), _md(REPLIES, "customer"), _md(EMBEDDED, "orders", 50_000, "o_orderkey")


def _plan(lines):
    """Levels that a model might have given: by number, none for every seventh document's texts any more."""
    t = N.targets(N.headings(lines), structural=False)
    return t.where("idx % 3 <> 1").select("doc_id", "idx", F.when((F.col("doc_id") % 7 == 0) & (F.col("idx") == 2), F.lit("gone")).otherwise(F.col("text")).alias("text"), (F.col("idx") % 5).cast("int").alias("new_level"))


def queries() -> dict:
    noise = lambda s, d: spark_lines(s, d, "noise")
    return {
        "heading_list": lambda s, d: N.headings(noise(s, d)),
        "heuristic_levels": lambda s, d: N.heuristic_levels(N.headings(noise(s, d))),
        "apply_levels": lambda s, d: N.apply_levels(noise(s, d), _plan(noise(s, d)), structural=False),
        "normalize_levels": lambda s, d: N.normalize(noise(s, d)),
        "body_anchors": lambda s, d: N.body_anchors(noise(s, d)),
        "normalize_prompts": lambda s, d: N.prompts(noise(s, d), "Levels?\n", 400),
        "parse_reply": lambda s, d: _replies(s, d).select("doc_id", F.array_join(F.array_sort(F.transform(F.map_entries(N.parse_reply(F.col("reply"))), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string")))), " ").alias("levels")),
        "heading_cache_key": lambda s, d: N.cache_key(N.headings(noise(s, d)), "m", "llm_full", "3"),
        "mode_classify": lambda s, d: N.decide(noise(s, d), 2000),
        "strip_template_pages": lambda s, d: _templated(s, d).select("doc_id", Z.template_patterns(F.col("md")).alias("marks"), Z.strip_template_pages(F.col("md")).alias("md")),
        "regenerate_toc": lambda s, d: Z.regenerate_toc(spark_lines(s, d, "toc")),
        "promote_outline": lambda s, d: Z.promote_outline(spark_lines(s, d, "outl")),
        "decode_html_entities": lambda s, d: _entities(s, d).select("doc_id", X.decode_html_entities("md").alias("md")),
        "embedded_html": lambda s, d: _embedded(s, d).select("doc_id", X.convert_embedded("md").alias("md")),
        "clean_lines": lambda s, d: noise(s, d).select("doc_id", "line_no", T.clean_line(F.col("line")).alias("line")),
        "clean_lines_aggressive": lambda s, d: noise(s, d).select("doc_id", "line_no", T.clean_line(F.col("line"), True, "strip").alias("line")),
        "line_flags": lambda s, d: noise(s, d).select("doc_id", "line_no", T.is_image_only(F.col("line")).alias("image_only"), T.is_table_line(F.col("line")).alias("is_table"), T.is_structural(F.col("line")).alias("structural"), T.heuristic_level(F.col("line")).cast("int").alias("level"), T.clean_label(F.col("line")).alias("label"), T.source_id(F.col("line")).alias("source_id"), T.preserve_indent(F.col("line"), F.lit("- x")).alias("indented")),
        "cleanup_markdown": lambda s, d: Z.cleanup(s.sql("select doc_id, text md from {t}", t=s.read.parquet(f"{d}/documents.parquet"))),
    }


_POLLUTION = lambda c: st(rr(rr(rr(rr(c, '<span' + chr(92) + 's+id="[^"]*"' + chr(92) + 's*>' + chr(92) + 's*</span>'), r"\[([^\]]+)\]\(#page-\d+-\d+\)", r"\1"), r"\]\(#page-\d+-\d+\)"), r"\s+", " "))
_PAGE = r"(^|\W)\d{2,}\s*$"


def _structural(c: str) -> str:
    t = st(c)
    ch, num = st(ex(t, r"(?i)^Chapter\s+\d+\b(.*)$")), st(ex(t, r"^\d+(?:\.\d+)+\b(.*)$"))
    return f"(case when {rm(t, r'(?i)\bp\.\s*\d+\s*$')} then false when {rm(t, r'(?i)^Chapter\s+\d+\b')} then not ({ch} <> '' and {rm(ch, _PAGE)}) when {rm(t, r'^\d+(?:\.\d+)+\b')} then not ({num} <> '' and {rm(num, _PAGE)}) else false end)"


def _level(c: str) -> str:
    t = st(c)
    n = ex(t, r"^\d+(?:\.\d+)+\b", 0)
    return f"(case when {rm(t, r'(?i)^Chapter\s+\d+\b')} then 1 when {n} <> '' then least(length({n}) - length(replace({n}, '.', '')) + 1, 6) when {rm(t, r'^\d+\.\s+\S')} then 1 end)"


_H = f"h0 as (select doc_id, line_no, length({ex('line', N.HEADING)})::int level, {ex('line', N.HEADING, 2)} \"text\" from lines where {rm('line', N.HEADING)}), h1 as (select *, {_POLLUTION(chr(34) + 'text' + chr(34))} clean from h0), hd as (select *, {_structural('clean')} structural, row_number() over (partition by doc_id order by line_no)::int h_no from h1)"
_TARGET = "tg as (select *, row_number() over (partition by doc_id order by line_no)::int idx from (select *, count(*) over (partition by doc_id) m from (select *, count(*) over (partition by doc_id) n from hd) where n >= 2 and {0}) where m >= 2)"
_BODY = f"b0 as (select *, {rm('line', N.HEADING)} h from lines), b1 as (select *, sum(h::int) {UPTO} k from b0), b2 as (select doc_id, k, max(length({ex('line', N.HEADING)})) filter (h) level, max({_POLLUTION(ex('line', N.HEADING, 2))}) filter (h) clean, {st('coalesce(string_agg(line, chr(10) order by line_no) filter (not h), ' + chr(39) * 2 + ')')} body from b1 where k > 0 group by 1, 2), an as (select doc_id, k::int h_no, level::int level, clean, case when length(body) > {N.ANCHOR_CHARS} then {rr(f'left(body, {N.ANCHOR_CHARS})', r'\s+$')} else body end anchor from b2)"
_PROMPT = "pr as (select doc_id, string_agg(h_no || ': ' || level || ' ' || clean, chr(10) order by h_no) plain, string_agg(h_no || ': ' || level || ' ' || clean || case when anchor = '' then '' else chr(10) || array_to_string(list_transform(string_split(anchor, chr(10)), lambda x: '    ' || x), chr(10)) end, chr(10) order by h_no) \"full\" from an group by 1)"
_STRIP_HASH = lambda c: rr(c, r"^(\s*)#{1,6}\s+(.*)$", r"\1\2")


def oracle_sql() -> dict[str, str]:
    marks = " + ".join(f"{rm('c', p)}::int" for p in Z.TEMPLATE)
    at = f"length({ex('md', r'^((?s:.*?))(?m:^)#' + chr(92) + 's+' + chr(92) + 'S', 1)})"
    title = st(rr(st(ex("line", Z.TOC_HEADING, 2)), r"\*+$"))
    slug = rr(rr(rr(rr(f"lower({rr(st(rr(st('line'), '<span id=' + chr(34) + 'page-' + chr(92) + 'd+-' + chr(92) + 'd+' + chr(34) + '></span>')), '^#+' + chr(92) + 's*')})", r"\s+", "-"), "[^a-z0-9-]"), "-+", "-"), "^-+|-+$")
    om = lambda i: ex("line", Z.OUTLINE_LINE, i)
    return {
        "heading_list": f"with {duck('noise')}, {_H} select * from hd",
        "heuristic_levels": f"with {duck('noise')}, {_H}, {_TARGET.format('structural')} select doc_id, idx, \"text\", {_level(chr(34) + 'text' + chr(34))}::int new_level from tg where {_level(chr(34) + 'text' + chr(34))} <> level",
        "apply_levels": f"with {duck('noise')}, {_H}, {_TARGET.format('true')}, td as (select doc_id, line_no, case when idx % 5 = 0 then \"text\" else repeat('#', idx % 5) || ' ' || \"text\" end new from tg where idx % 3 <> 1 and idx % 5 <> level and not (doc_id % 7 = 0 and exists (select 1 from tg t2 where t2.doc_id = tg.doc_id and t2.idx = 2 and t2.\"text\" <> 'gone'))) select doc_id, line_no, coalesce(new, line) line from lines left join td using (doc_id, line_no)",
        "normalize_levels": f"with {duck('noise')}, {_H}, {_TARGET.format('structural')}, td as (select doc_id, line_no, repeat('#', {_level(chr(34) + 'text' + chr(34))}) || ' ' || \"text\" new from tg where {_level(chr(34) + 'text' + chr(34))} <> level) select doc_id, line_no, coalesce(new, line) line from lines left join td using (doc_id, line_no)",
        "body_anchors": f"with {duck('noise')}, {_BODY} select * from an",
        "normalize_prompts": f"with {duck('noise')}, {_BODY}, {_PROMPT}, q as (select doc_id, 'Levels?' || chr(10) || plain p, 'Levels?' || chr(10) || \"full\" f from pr) select doc_id, case when length(f) // 4 <= 400 then f else p end prompt, length(f) // 4 <= 400 with_anchors from q",
        "parse_reply": "select c_custkey doc_id, array_to_string(list_sort(list_filter([case when c_nationkey % 9 <= 6 then '1=' || c_nationkey % 9 end, case when c_custkey % 7 <= 6 then '2=' || c_custkey % 7 else '2=3' end], lambda x: x is not null)), ' ') levels from customer",
        "heading_cache_key": f"with {duck('noise')}, {_H} select doc_id, left(sha256(string_agg(level || '|' || clean, chr(10) order by line_no) || '|m|llm_full|3'), 16) key from hd group by 1",
        "mode_classify": f"with {duck('noise')}, {_H}, {_BODY}, {_PROMPT}, g as (select doc_id, count(*) n, greatest({', '.join(f'count(*) filter (level = {k})' for k in range(1, 7))}) dominant, sum(structural::int) numbered from hd group by 1), a as (select doc_id, coalesce(n, 0) n, coalesce(dominant, 0) dominant, coalesce(numbered, 0) numbered, length(\"full\") // 4 tokens from (select distinct doc_id from lines) left join g using (doc_id) left join pr using (doc_id)), r as (select *, case when n < 6 then 'too_few_headings' when numbered >= 0.4 * n then 'numbered' when dominant < 40 then 'shape_ok' when tokens <= 2000 then 'collapsed_non_numbered' else 'needs_full_but_oversized' end reason from a) select doc_id, case when reason = 'collapsed_non_numbered' then 'llm_full' else 'heuristic' end mode, reason, n n_headings, dominant, numbered from r",
        "strip_template_pages": f"with a as ({TEMPLATED}), p as (select doc_id, md, length(regexp_extract(chr(10) || md, '^((?s:.*?))\\n#\\s+\\S', 1)) lead from a), q as (select *, substr(md, 1, lead) c from p) select doc_id, (select {marks.replace('c,', 'md,')})::int marks, case when lead > 0 and {marks} >= 2 then substr(md, lead + 1) else md end md from q",
        "regenerate_toc": f"with {duck('toc')}, a as (select *, min(line_no) filter ({rm('line', Z.TOC)}) over (partition by doc_id) toc from lines), b as (select *, min(line_no) filter (line_no > toc and {rm('line', Z.TOC_HEADING)}) over (partition by doc_id) nx from a), c as (select *, case when line_no >= nx and {rm('line', Z.TOC_HEADING)} and not {rm('line', Z.TOC)} and {title} <> '' then length({ex('line', Z.TOC_HEADING)}) end depth from b), d as (select *, min(depth) over (partition by doc_id) least_ from c), e as (select doc_id, list(repeat('  ', depth - least_) || '- ' || case when {slug} <> '' then '[' || {title} || '](#' || {slug} || ')' else {title} end order by line_no) made from d where depth is not null group by 1), f as (select d.doc_id, line_no, case when line_no = toc then list_concat(['## Table of Contents', ''], list_concat(coalesce(made, []), case when made is not null then [''] else [] end)) when line_no > toc and line_no < coalesce(nx, 1099511627776) then [] else [line] end ls from d left join e using (doc_id)) select doc_id, line_no, unnest(range(len(ls)))::int part, unnest(ls) line from f",
        "promote_outline": f"with {duck('outl')}, a as (select *, ({rm('line', Z.ATX)} or {st('line')} = '') edge, {rm('line', Z.OUTLINE_LINE)} it from lines), b as (select *, it and not edge item, sum(edge::int) {UPTO} block, coalesce(last_value(case when {rm('line', Z.ATX)} then length({ex('line', Z.ATX)}) end ignore nulls) {UPTO}, 0) h from a), i as (select *, length({om(1)}) + length({om(2)}) col, {om(1)} <> '' marked from b where item), k as (select i.*, 1 + (select count(*) from i j where j.doc_id = i.doc_id and j.block = i.block and j.line_no < i.line_no and j.col < (select min(z.col) from i z where z.doc_id = i.doc_id and z.block = i.block and z.line_no > j.line_no and z.line_no <= i.line_no)) depth from i), g as (select doc_id, (bool_or(marked) or (bool_or(h = 0 and depth = 1) and not bool_or(h > 0 and depth = 1))) and count(*) filter (depth = 1) >= 3 and bool_or(depth >= 2) ok from k group by 1), t as (select k.*, ok, {om(3)} || '. ' || {om(4)} tx from k join g using (doc_id)) select doc_id, line_no, case when t.ok and depth <= 2 then repeat('#', least(t.h + depth, 6)::int) || ' ' || tx when t.ok then repeat('  ', (depth - 3)::int) || '- ' || tx else lines.line end line, coalesce(t.ok and depth <= 2, false)::int promoted from lines left join t using (doc_id, line_no)",
        "decode_html_entities": "select doc_id, 'été &amp; ''x'' <b> ' || text || chr(10) || '```' || chr(10) || '&amp; stays' || chr(10) || '```' || chr(10) || '© →' md from documents",
        "embedded_html": "select o_orderkey doc_id, 'Order' || chr(10) || '| Status | Priority |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_orderstatus || ' | **' || o_orderpriority || '** |' || chr(10) || '```' || chr(10) || '<table><tr><td>x</td></tr></table>' || chr(10) || '```' || chr(10) || '![' || o_orderpriority || '](images/o.png)' || chr(10) || 'in <table> a line' || chr(10) || '<table>' || chr(10) || 'never closed' md from orders",
        "line_flags": f"with {duck('noise')} select doc_id, line_no, {rm('line', r'^\s*!\[\]\([^)]+\)\s*$')} image_only, {st('line')} like '|%' and {st('line')} like '%|' is_table, {_structural('line')} structural, {_level('line')}::int \"level\", {st(rr(rr('line', '[_-]+', ' '), r'\s+', ' '))} \"label\", {rr(rr(f'lower({rr(rr(chr(108) + "ine", "^.*/"), chr(92) + ".[^.]*$")})', '[^a-z0-9]+', '-'), '^-+|-+$')} source_id, case when {ex('line', r'^[ \t]*', 0)} <> '' then {ex('line', r'^[ \t]*', 0)} || '- x' else '- x' end indented from lines",
    }
