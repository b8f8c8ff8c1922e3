"""Queries of quiz exports, broken tables, captions and run state, each with its SQL.

Exports are made from the plain tables, so that what the parser must find is what the tables hold.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..operators import state as S
from ..operators import table_repair as B
from ..operators import vision as V
from ..session import spread
from ..sources import office as Y
from ..sources import qti as Q
from .fixtures import duck, spark_lines
from .passes import UPTO, ex, rm, rr, st
from .rest import _read

_META = lambda kind, points: f"<itemmetadata><qtimetadata><qtimetadatafield><fieldlabel>question_type</fieldlabel><fieldentry>{kind}</fieldentry></qtimetadatafield><qtimetadatafield><fieldlabel>points_possible</fieldlabel><fieldentry>{points}</fieldentry></qtimetadatafield></qtimetadata></itemmetadata>"
_TEXT = lambda html: f'<material><mattext texttype="text/html">{html}</mattext></material>'
_OPT = lambda ident, html: f'<response_label ident="{ident}">{_TEXT(html)}</response_label>'
_EQ = lambda resp, value: f'<varequal respident="{resp}">{value}</varequal>'
#: A quiz with an item of each type; NAME, TYPE, SIZE and BRAND stand for a part's columns.
QUIZ = (
    '<questestinterop xmlns="http://quiz.example/ims"><assessment><section>'
    f'<item>{_META("multiple_choice_question", "2.0")}<presentation>{_TEXT("&lt;p&gt;Which is &lt;b&gt;NAME&lt;/b&gt;? &lt;img src=&quot;media/a%20b.png&quot;&gt;&lt;/p&gt;")}<response_lid ident="response1"><render_choice>{_OPT("1", "&lt;i&gt;TYPE&lt;/i&gt;")}{_OPT("2", "BRAND")}</render_choice></response_lid></presentation><resprocessing><respcondition><conditionvar>{_EQ("response1", "2")}</conditionvar></respcondition></resprocessing></item>'
    f'<item>{_META("multiple_answers_question", "1")}<presentation>{_TEXT("Choose")}<response_lid ident="response1"><render_choice>{_OPT("x", "one")}{_OPT("y", "TYPE")}{_OPT("z", "NAME")}</render_choice></response_lid></presentation><resprocessing><respcondition><conditionvar><and>{_EQ("response1", "y")}<not>{_EQ("response1", "x")}</not>{_EQ("response1", "z")}</and></conditionvar></respcondition></resprocessing></item>'
    f'<item>{_META("matching_question", "SIZE")}<presentation>{_TEXT("Match")}<response_lid ident="r1">{_TEXT("NAME")}<render_choice>{_OPT("5", "TYPE")}{_OPT("6", "BRAND")}</render_choice></response_lid><response_lid ident="r2">{_TEXT("other")}<render_choice>{_OPT("5", "TYPE")}{_OPT("6", "BRAND")}</render_choice></response_lid></presentation><resprocessing><respcondition><conditionvar>{_EQ("r1", "6")}</conditionvar></respcondition><respcondition><conditionvar>{_EQ("r2", "5")}</conditionvar></respcondition></resprocessing></item>'
    f'<item>{_META("fill_in_multiple_blanks_question", "x")}<presentation>{_TEXT("Fill")}<response_lid ident="response_a">{_TEXT("a")}<render_choice>{_OPT("7", "TYPE")}{_OPT("8", "BRAND")}</render_choice></response_lid></presentation><resprocessing><respcondition><conditionvar>{_EQ("response_a", "7")}{_EQ("response_a", "8")}</conditionvar></respcondition></resprocessing></item>'
    f'<item>{_META("short_answer_question", "0.5")}<presentation>{_TEXT("Say")}</presentation><resprocessing><respcondition><conditionvar>{_EQ("response1", "BRAND")}{_EQ("response1", "NAME")}</conditionvar></respcondition></resprocessing></item>'
    f'<item>{_META("essay_question", "10")}<presentation>{_TEXT("Write about NAME")}</presentation></item>'
    f'<item>{_META("text_only_question", "0")}<presentation>{_TEXT("Read TYPE")}</presentation></item>'
    "</section></assessment></questestinterop>"
)
META = '<quiz xmlns="http://quiz.example/meta"><title>Quiz on NAME</title><points_possible>SIZE</points_possible><description>&lt;p&gt;Read &lt;b&gt;all&lt;/b&gt;.&lt;/p&gt;</description></quiz>'
MANIFEST = (
    '<manifest xmlns="http://quiz.example/cp"><metadata><title><string>Export for course "NAME"</string></title></metadata><resources>'
    '<resource identifier="qSIZE" type="imsqti_xmlv1p2"><file href="qSIZE/qSIZE.xml"/><dependency identifierref="mSIZE"/></resource><resource identifier="mSIZE" type="associatedcontent/imscc_xmlv1p1/learning-application-resource" href="qSIZE/meta.xml"/>'
    '<resource identifier="p" type="imsqti_xmlv1p2"><file href="p/p.xml"/><dependency identifierref="gone"/></resource><resource identifier="bad" type="imsqti_xmlv1p2"><file href="../bad.xml"/></resource>'
    '<resource identifier="w1" type="webcontent" href="media/a%20b.png"/><resource identifier="w2" type="webcontent" href="media/../../c.png"/></resources></manifest>'
)
_FILLED = lambda text: f"replace(replace(replace(replace('{text}', 'NAME', p_name), 'TYPE', p_type), 'SIZE', cast(p_size as string)), 'BRAND', p_brand)"


#: Rows of parts whose files one task makes and parses.
PARTS = 2000


def _xml(s, d, text: str):
    return s.sql(f"select p_partkey doc_id, {_FILLED(text)} xml from {{p}}", p=spread(_read(s, d, "part"), PARTS))


def _items(s, d):
    return Q.parse_items(_xml(s, d, QUIZ))


_FIELDS = "cast(p_retailprice as bigint) % 3"
_CAP = "select doc_id, 'f' || cast(doc_id % 5 as string) || '.png' basename, text alt from documents"
_SAID = "select doc_id, 'f' || cast(doc_id % 5 as string) || '.png' basename, case when doc_id % 3 = 0 then text when doc_id % 3 = 1 then 'something else entirely' end caption from documents"
_REPLY = "select c_custkey id, case c_custkey % 5 when 0 then 'I see: ```json {\"is_diagram\": true, \"caption\": \"A map of ' || c_name || '\", \"diagram_type\": \"map\", \"mermaid\": \"graph TD\"} ``` done' when 1 then '{\"is_diagram\": false, \"mermaid\": \"x\"}' when 2 then 'no json' when 3 then '{broken' else '' end reply, 'i' || cast(c_custkey as string) || '.png' name, case when c_custkey % 2 = 0 then c_name else 'short' end alt from customer"
_CALLS = "select case when event_id % 11 = 0 then null else event_type end task, event_id % 9 > 0 success, cast(event_id % 100 as bigint) prompt_tokens, cast(event_id % 7 as bigint) completion_tokens, cast(event_id % 5 as bigint) cost_usd, cast(event_id % 13 as bigint) duration_ms, case when user_id % 4 = 0 then '' else 'm' || cast(user_id % 4 as string) end model, 'b' || cast(user_id % 2 as string) backend from events"
_STAGES = "select o_orderkey doc_id, o_orderpriority stem, case o_orderkey % 9 when 0 then 'ingest' when 1 then 'cleanup' when 2 then 'decorations' when 3 then 'normalize' when 4 then 'repair' when 5 then 'structure' when 6 then 'vision' when 7 then 'split' else 'nothing' end stage from orders"
_DELIVER = "select p_partkey doc_id, case p_partkey % 9 when 0 then p_brand || '.md' when 1 then p_brand || '.raw.md' when 2 then 'sections/a/b.md' when 3 then 'images/x.png' when 4 then 'chunks/0-49.md' when 5 then '.vision-cache/x.json' when 6 then 'exam/' || p_brand || '.visioned.md' when 7 then 'exam/' || p_brand || '.md' else 'manifest.json' end path from part"
_JOBS = "select o_orderkey doc_id, o_orderkey % 4 > 0 runs, case o_orderkey % 3 when 0 then 'anthropic' when 1 then 'openrouter' else 'local' end backend, o_custkey % 2 = 0 confirmed from orders"
_IMAGES = "select l_orderkey doc_id, l_partkey % 3 = 0 hit from lineitem where l_orderkey % 5 > 0"
_SNAPS = "select o_orderkey doc_id, o_custkey source_time, case when o_orderkey % 7 > 0 then o_custkey + o_orderkey % 3 - 1 end raw_time, case when o_orderkey % 5 > 0 then o_custkey + o_orderkey % 4 - 1 end cleaned_time, o_orderkey % 6 f from orders"
#: Tables of which some are torn, and the same tables as another reader sees them.
_TORN = """select cast(doc_id as bigint) doc_id, row_number() over (partition by doc_id order by a, b, line) - 1 line_no, line from (
 select c_nationkey doc_id, 0 a, 0 b, 'Before' line from k where i = 1
 union all select c_nationkey, 1, 0, '| Name | Address and phone of the customer |' from k where i = 1
 union all select c_nationkey, 1, 1, '|---|---|' from k where i = 1
 union all select c_nationkey, 1, 1 + i, '| ' || c_name || ' | ' || c_mktsegment || ' stands for ' || c_phone || ' |' || case when i = 2 then ' ' else '' end from k where i < 9
 union all select c_nationkey, 1, 20, '| | wrapped words of the row |' from k where i = 1 and c_nationkey % 2 = 0
 union all select c_nationkey, 2, 0, '' from k where i = 1
 union all select c_nationkey, 3, 0, '| ' || repeat(c_name || '<br>', 31) || c_phone || ' |' from k where i = 2 and c_nationkey % 3 = 0
 union all select c_nationkey, 4, 0, 'After' from k where i = 1) x"""
_TORN_WITH = "k as (select c_nationkey, c_name, c_mktsegment, 'phone ' || cast(c_custkey * 7919 as string) c_phone, row_number() over (partition by c_nationkey order by c_custkey) i from customer)"
_PAGES = "select c_nationkey doc_id, cast(c_custkey % 2 as int) page, c_name || ' ' || c_mktsegment || ' stands for phone ' || cast(c_custkey * 7919 as string) || ' ' || repeat(c_name, 3) || ' Address and phone of the customer' text from customer"
_SECOND = "select c_nationkey doc_id, cast(c_custkey % 2 as int) page, cast(c_custkey % 4 as int) block, '| ' || c_name || ' | ' || c_mktsegment || ' stands for phone ' || cast(c_custkey * 7919 as string) || ' |' text from customer"


def _sql(text: str, table: str):
    return lambda s, d: s.sql(text.replace("{", "{{").replace("}", "}}").replace(f"from {table}", "from {t}"), t=_read(s, d, table))


def _torn(s, d):
    return s.sql(f"with {_TORN_WITH} {_TORN}".replace("from customer", "from {t}"), t=_read(s, d, "customer")).withColumn("line_no", F.col("line_no").cast("bigint"))


def _second(s, d):
    """Pages as texts, and their tables with all rows of a page."""
    pages = _sql(_PAGES, "customer")(s, d).groupBy("doc_id", "page").agg(F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("text"))
    rows = _sql(_SECOND, "customer")(s, d).groupBy("doc_id", "page").agg(F.concat(F.lit("| Name | Address and phone of the customer |\n|---|---|\n"), F.array_join(F.sort_array(F.collect_list("text")), "\n")).alias("text")).withColumn("block", F.lit(0))
    return pages, rows


@F.pandas_udf(BinaryType())
def _docx(xml: pd.Series) -> pd.Series:
    """A word processor's file around a body."""

    def one(x: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{x}</w:body></w:document>')
            z.writestr("word/media/fig.png", x.encode()[:4])
        return out.getvalue()

    return xml.map(one)


_PARA = lambda text, style="": f"<w:p><w:pPr>{style}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
_BODY = (
    _PARA("NAME", '<w:pStyle w:val="Title"/>') + _PARA("About TYPE", '<w:pStyle w:val="Heading 2"/>') + _PARA("BRAND", '<w:numPr><w:ilvl w:val="0"/></w:numPr>') + _PARA("size SIZE", '<w:numPr><w:ilvl w:val="1"/></w:numPr>')
    + "<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>NAME</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t> TYPE</w:t></w:r><w:r><w:t> ends.</w:t></w:r></w:p>"
    + f"<w:tbl><w:tr><w:tc>{_PARA('Brand')}</w:tc><w:tc>{_PARA('Size')}</w:tc></w:tr><w:tr><w:tc>{_PARA('BRAND')}{_PARA('a|b')}</w:tc></w:tr></w:tbl>"
)


def _office(s, d):
    return _xml(s, d, _BODY).select("doc_id", F.lit("docx").alias("suffix"), _docx("xml").alias("content"))


def _sheets(s, d):
    return s.sql("select p_partkey doc_id, case when p_partkey % 9 = 8 then 'xyz' else 'csv' end suffix, encode(concat('Name,Size', char(10), '\"', p_name, ', ', p_type, '\",', cast(p_size as string), char(10), p_brand, '|x', char(10)), 'UTF-8') content from {p}", p=spread(_read(s, d, "part"), PARTS))


def queries() -> dict:
    flat = lambda c, f: F.array_join(F.transform(c, f), ";")
    snaps = lambda s, d: _sql(_SNAPS, "orders")(s, d).withColumn("flags", F.when(F.col("f") > 0, F.map_from_arrays(F.array(F.lit("cleanup"), F.lit("cross_refs")), F.array(F.when(F.col("f") == 1, "off").otherwise("basic"), F.when(F.col("f") == 2, F.lit(None).cast("string")).otherwise("keep"))))).drop("f")
    cap = lambda s, d: (_sql(_CAP, "documents")(s, d), _sql(_SAID, "documents")(s, d))
    return {
        "qti_items": lambda s, d: _items(s, d).select(
            "doc_id", "number", "qtype", "points", "stem", flat("options", lambda o: F.concat(o["text"], F.lit("="), o["correct"].cast("string"))).alias("options"), flat("matches", lambda m: F.concat(m["left"], F.lit("="), m["right"])).alias("matches"),
            flat("blanks", lambda b: F.concat(b["name"], F.lit("="), F.array_join(b["texts"], "/"))).alias("blanks"), F.array_join("accepted", ";").alias("accepted"), F.array_join("images", ";").alias("images"),
        ),
        "qti_render_key": lambda s, d: Q.render_items(_items(s, d)),
        "qti_render_blank": lambda s, d: Q.render_items(_items(s, d), key=False),
        "qti_meta": lambda s, d: Q.parse_meta(_xml(s, d, META)),
        "qti_quiz_md": lambda s, d: Q.render_quizzes(Q.parse_meta(_xml(s, d, META)), _items(s, d).where("number = 6")),
        "qti_manifest": lambda s, d: Q.parse_manifest(_xml(s, d, MANIFEST)),
        "qti_quizzes": lambda s, d: Q.quizzes(Q.parse_manifest(_xml(s, d, MANIFEST))),
        "qti_media": lambda s, d: Q.media(Q.parse_manifest(_xml(s, d, MANIFEST))),
        "qti_names": lambda s, d: _read(s, d, "part").select("p_partkey", Q.image_name(F.concat("p_name", F.lit(" (1)__x.png"))).alias("image"), Q.quiz_title(F.concat("p_type", F.lit(': a/b? <"'), "p_name", F.lit('">'))).alias("title")),
        "question_files": lambda s, d: Q.question_files(Q.render_quizzes(Q.parse_meta(_xml(s, d, META)), _items(s, d).where("number = 6")), F.lit("Course"), F.lit("Exam"), F.lit("")),
        "office_documents": lambda s, d: Y.read_office(_office(s, d)),
        "office_media": lambda s, d: Y.media(_office(s, d)).select("doc_id", "name", F.decode("data", "UTF-8").alias("data")),
        "office_sheets": lambda s, d: Y.read_office(_sheets(s, d)),
        "collapsed_cells": lambda s, d: B.collapsed_cells(B.blocks(_torn(s, d))),
        "split_tables": lambda s, d: B.split_tables(B.blocks(_torn(s, d))),
        "table_repair_records": lambda s, d: B.repair(_torn(s, d), *_second(s, d))[1],
        "table_repair_lines": lambda s, d: B.repair(_torn(s, d), *_second(s, d))[0],
        "caption_divergence": lambda s, d: V.divergence(*cap(s, d)),
        "vision_audit": lambda s, d: V.audit(*cap(s, d)),
        "vision_report": lambda s, d: V.report(V.divergence(*cap(s, d))),
        "vision_replies": lambda s, d: _sql(_REPLY, "customer")(s, d).select("id", V.parse_reply(F.col("reply"), F.col("name")).alias("p"), V.failure_caption(F.col("name"), F.col("alt")).alias("fallback"), V.prompt(F.col("alt")).alias("prompt")).select("id", "p.*", "fallback", "prompt"),
        "task_summary": lambda s, d: S.task_summary(_sql(_CALLS, "events")(s, d)),
        "invalidate_cascade": lambda s, d: S.invalidated(_sql(_STAGES, "orders")(s, d)),
        "resume_points": lambda s, d: S.resume_points(snaps(s, d), {"cleanup": "basic", "cross_refs": "keep"}),
        "deliverables": lambda s, d: S.deliverables(_sql(_DELIVER, "part")(s, d)),
        "cost_gate": lambda s, d: S.gate(_sql(_JOBS, "orders")(s, d), _sql(_IMAGES, "lineitem")(s, d)),
        "vision_slices": lambda s, d: _read(s, d, "orders").select("o_orderkey", S.vision_runs(F.element_at(F.array(*map(F.lit, S.PHASES)), (F.col("o_orderkey") % 7 + 1).cast("int")), F.when(F.col("o_custkey") % 3 > 0, F.element_at(F.array(*map(F.lit, S.PHASES)), (F.col("o_custkey") % 7 + 1).cast("int"))), F.col("o_orderkey") % 5 > 0, F.col("o_custkey") % 5 == 0).alias("runs")),
        "run_records": lambda s, d: S.read_run_record(S.run_record(_read(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("version"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("sections"))).withColumn("record", F.when(F.col("doc_id") % 6 == 0, F.lit("{broken")).when(F.col("doc_id") % 6 == 1, F.lit("[1]")).otherwise(F.col("record"))), "version string, sections bigint").select("doc_id", "run.version", "run.sections"),
        "source_identity": lambda s, d: S.source_identity(s.sql("select p_partkey doc_id, p_name || '.v2.PDF' name, case when p_partkey % 3 > 0 then p_type end content from {p}", p=_read(s, d, "part")), s.sql("select p_partkey doc_id, 'known-' || cast(p_size as string) source_id, 'h' sha256 from {p} where p_partkey % 2 = 0", p=_read(s, d, "part"))),
        "baselines": lambda s, d: S.latest_baselines(s.sql("select o_custkey doc_id, o_orderpriority label, o_orderkey taken_at from {o}", o=_read(s, d, "orders"))),
        "version_snapshots": lambda s, d: S.to_snapshot(s.sql("select o_orderkey doc_id, case when o_orderkey % 4 > 0 then o_orderpriority end version from {o}", o=_read(s, d, "orders")), "3-MEDIUM"),
    }


_NL = " || chr(10) || "
_Q7 = """i as (select p_partkey doc_id, p_name, p_type, p_brand, p_size from part), q as (
 select doc_id, 1 number, 'multiple_choice_question' qtype, 2.0::double points, 'Which is **' || p_name || '**? ![](media/a%20b.png)' stem, '*' || p_type || '*=false;' || p_brand || '=true' options, '' matches, '' blanks, '' accepted, 'a b.png' images from i
 union all select doc_id, 2, 'multiple_answers_question', 1, 'Choose', 'one=false;' || p_type || '=true;' || p_name || '=true', '', '', '', '' from i
 union all select doc_id, 3, 'matching_question', p_size, 'Match', '', p_name || '=' || p_brand || ';other=' || p_type, '', '', '' from i
 union all select doc_id, 4, 'fill_in_multiple_blanks_question', 0, 'Fill', '', '', 'a=' || p_type || '/' || p_brand, '', '' from i
 union all select doc_id, 5, 'short_answer_question', 0.5, 'Say', '', '', '', p_brand || ';' || p_name, '' from i
 union all select doc_id, 6, 'essay_question', 10, 'Write about ' || p_name, '', '', '', '', '' from i
 union all select doc_id, 7, 'text_only_question', 0, 'Read ' || p_type, '', '', '', '', '' from i)"""


def _rendered(key: bool) -> str:
    yes = lambda x: x if key else ""
    body = {
        1: f"'- A. *' || p_type || '*'{_NL}'- B. ' || p_brand" + yes(f" || ' ✓'{_NL}''{_NL}'**Correct answer:** B. ' || p_brand"),
        2: f"'- A. one'{_NL}'- B. ' || p_type || '{yes(' ✓')}'{_NL}'- C. ' || p_name || '{yes(' ✓')}'" + yes(f"{_NL}''{_NL}'**Correct answers:** B. ' || p_type || '; C. ' || p_name"),
        3: f"'| Item | Correct match |'{_NL}'|---|---|'{_NL}'| ' || p_name || ' | ' || p_brand || ' |'{_NL}'| other | ' || p_type || ' |'" if key else f"'Items:'{_NL}'- ' || p_name{_NL}'- other'{_NL}''{_NL}'Match with:'{_NL}'- ' || p_brand{_NL}'- ' || p_type",
        4: "'**Answers:** a = ' || p_type || ' / ' || p_brand" if key else "''", 5: "'**Accepted answer(s):** ' || p_brand || ' / ' || p_name" if key else "''", 6: "''", 7: "''",
    }
    label = "case number when 1 then 'Multiple choice · 2 pts' when 2 then 'Multiple answers · 1 pt' when 3 then 'Matching · ' || p_size || case when p_size = 1 then ' pt' else ' pts' end when 4 then 'Fill in multiple blanks · 0 pts' when 5 then 'Fill in the blank · 0.5 pts' when 6 then 'Essay · 10 pts' else 'Text only · 0 pts' end"
    cases = " ".join(f"when {n} then {b}" for n, b in body.items())
    return f"b as (select doc_id, number, '## Question ' || number || chr(10) || chr(10) || '_' || {label} || '_' || chr(10) || chr(10) || stem h, case number {cases} end body from q join i using (doc_id)), r as (select doc_id, number, h || case when body <> '' then chr(10) || chr(10) || body else '' end md from b)"


_ALT_WORDS = "list_filter(regexp_extract_all(lower(alt), '[a-z][a-z\\-]{2,}')[1:18], lambda w: not list_contains(" + "[" + ", ".join(f"'{w}'" for w in V.GENERIC) + "]" + ", w) and length(w) >= 4)"
_DIV = f"a as (select doc_id, basename, {st('alt')} alt from ({_CAP})), w as (select *, {_ALT_WORDS} w from a), s as ({_SAID}), ok as (select w.*, length(alt) >= 60 and len(w) > 0 assess, caption from s join w using (doc_id, basename)), dv as (select doc_id, basename, alt, caption, array_to_string(w[1:6], ', ') dropped from ok where assess and len(list_filter(w, lambda x: contains(lower(coalesce(caption, '')), left(x, 5)))) = 0)"
_TORN_SQL = f"{_TORN_WITH}, lines as ({_TORN}), ta as (select *, {st('line')} like '|%' t from lines), tb as (select *, sum((not t)::int) {UPTO} run from ta), bl as (select doc_id, min(line_no) first_line, max(line_no) last_line, string_agg(line, chr(10) order by line_no) \"text\" from tb where t group by doc_id, run)"
_CELLS = lambda c: f"list_transform(string_split({rr(st(c), '^' + chr(92) + '|+|' + chr(92) + '|+$')}, '|'), lambda x: {st('x')})"
_REST = lambda x: f"len(list_filter({x}[2:], lambda c: c <> '')) > 0"
_BROKEN = f"""mg as (select doc_id, first_line, first_line + i line_no, cell, br_count from (select *, list_max(list_transform({_CELLS('line')}, lambda c, j: (len(regexp_extract_all(c, '(?i)<br\\s*/?>')), -j, c))) w from (select doc_id, first_line, unnest(string_split("text", chr(10))) line, unnest(range(len(string_split("text", chr(10))))) i from bl)) z, lateral (select w[1]::int br_count, w[3] cell) where w[1] >= 30),
sp as (select * from bl where len(list_filter(list_transform(string_split("text", chr(10))[2:], lambda x: {_CELLS('x')}), lambda r: len(r) >= 2 and (r[1] = '') = ({_REST('r')}))) > 0)"""


def oracle_sql() -> dict[str, str]:
    tok = lambda c: f"list_filter(list_transform(regexp_extract_all({rr(c, '(?i)<br' + chr(92) + 's*/?>', ' ')}, '[A-Za-z0-9.]+'), lambda t: lower(t)), lambda t: length(t) > 1)"
    big = lambda c: f"list_distinct(list_transform(range(1, len({c})), lambda i: {c}[i] || ' ' || {c}[i + 1]))"
    stages = ", ".join(f"({i}, '{n}', [{', '.join(repr(f) for f in files)}]::varchar[], [{', '.join(repr(c) for c in caches)}]::varchar[])" for i, (n, files, caches) in enumerate(S.STAGE_FILES))
    phases = "[" + ", ".join(f"'{p}'" for p in S.PHASES) + "]"
    repaired = f"""with {_TORN_SQL}, {_BROKEN},
lg as (select doc_id, first_line, line_no, br_count, cell "text", left(list_max(list_transform(list_filter(list_transform(regexp_split_to_array(cell, '(?i)<br\\s*/?>'), lambda s: {st('s')}), lambda s: length(s) >= 6), lambda s, i: (length(s), -i, s)))[3], 48) snip from mg
 union all select doc_id, first_line, first_line, 0, "text", left(list_max(list_transform(list_filter(flatten(list_transform(string_split("text", chr(10)), lambda x: {_CELLS('x')})), lambda c: length(c) >= 8 and not contains(c, '---')), lambda s, i: (length(s), -i, s)))[3], 48) from sp where not exists (select 1 from mg where mg.doc_id = sp.doc_id and mg.first_line = sp.first_line)),
pg as (select doc_id, page, string_agg("text", chr(10) order by "text") pt from ({_PAGES}) group by 1, 2), sc as (select doc_id, page, '| Name | Address and phone of the customer |' || chr(10) || '|---|---|' || chr(10) || string_agg("text", chr(10) order by "text") mt from ({_SECOND}) group by 1, 2),
pl as (select lg.*, page from lg join pg using (doc_id) where contains(pt, snip)),
vals as (select pl.*, list_transform(case when {st('"text"')} like '|%' then flatten(list_transform(string_split("text", chr(10)), lambda x: list_filter({_CELLS('x')}, lambda c: c <> '' and not contains(c, '---')))) else list_filter(list_transform(regexp_split_to_array("text", '(?i)<br\\s*/?>'), lambda s: {st('s')}), lambda s: s <> '') end, lambda v: {tok('v')}) vt, list_distinct({tok('"text"')}) bt from pl),
cd as (select doc_id, page, mt, {tok('mt')} ct from sc), cand as (select v.doc_id, v.first_line, v.page, mt, least(len(list_intersect(bt, list_distinct(ct)))::double / len(bt), len(list_intersect(bt, list_distinct(ct)))::double / len(list_distinct(ct))) score, len(list_filter(list_transform(vt, lambda w: {big('w')}), lambda b: len(b) >= 4 and len(list_intersect(b, {big('ct')})) < 0.5 * len(b))) > 0 drops from vals v join cd using (doc_id, page)),
fd as (select doc_id, first_line, arg_min(page, (-score, page)) page, arg_min(mt, (-score, page)) mt from cand where score >= 0.5 and not drops group by 1, 2)"""
    return {
        "qti_items": f"with {_Q7} select * from q",
        "qti_render_key": f"with {_Q7}, {_rendered(True)} select * from r",
        "qti_render_blank": f"with {_Q7}, {_rendered(False)} select * from r",
        "qti_meta": "select p_partkey doc_id, 'Quiz on ' || p_name title, p_size::double points, 'Read **all**.' instructions from part",
        "qti_quiz_md": f"with {_Q7}, {_rendered(True)} select doc_id, '# Quiz on ' || p_name || chr(10) || chr(10) || '_1 questions · ' || p_size || ' points_' || chr(10) || chr(10) || 'Read **all**.' || chr(10) || chr(10) || md || chr(10) md from r join i using (doc_id) where number = 6",
        "qti_manifest": "with r as (select p_partkey doc_id, p_name course, unnest([('q' || p_size, 'imsqti_xmlv1p2', 'q' || p_size || '/q' || p_size || '.xml', 'm' || p_size), ('m' || p_size, 'associatedcontent/imscc_xmlv1p1/learning-application-resource', 'q' || p_size || '/meta.xml', null), ('p', 'imsqti_xmlv1p2', 'p/p.xml', 'gone'), ('bad', 'imsqti_xmlv1p2', '../bad.xml', null), ('w1', 'webcontent', 'media/a%20b.png', null), ('w2', 'webcontent', 'media/../../c.png', null)]) x from part) select doc_id, x[1] identifier, x[2] \"type\", x[3] href, x[4] depends, course from r",
        "qti_quizzes": "select p_partkey doc_id, 'q' || p_size quiz_id, 'q' || p_size || '/q' || p_size || '.xml' qti_href, 'q' || p_size || '/meta.xml' meta_href from part union all select p_partkey, 'p', 'p/p.xml', 'p/assessment_meta.xml' from part",
        "qti_media": "select p_partkey doc_id, 'a b.png' name, 'media/a%20b.png' href from part",
        "qti_names": f"select p_partkey, {rr(rr('p_name', '[^A-Za-z0-9._-]+', '_'), '_{2,}', '_')} || '_1_x.png' image, p_type || ' - a - b (' || p_name || ')' title from part",
        "question_files": f"with {_Q7}, {_rendered(True)} select doc_id, 'Question 006.md' file, '---' || chr(10) || 'source_type: \"quiz\"' || chr(10) || 'source_label: \"Course\"' || chr(10) || 'course: \"Course\"' || chr(10) || 'exam: \"Exam\"' || chr(10) || 'question_number: 6' || chr(10) || 'question_type: \"Essay\"' || chr(10) || 'points: \"10 pts\"' || chr(10) || '---' || chr(10) || chr(10) || md || chr(10) \"content\" from r where number = 6",
        "office_documents": "select p_partkey doc_id, '# ' || p_name || chr(10) || chr(10) || '## About ' || p_type || chr(10) || chr(10) || '- ' || p_brand || chr(10) || '  - size ' || p_size || chr(10) || '**' || p_name || ' ' || p_type || '** ends.' || chr(10) || chr(10) || chr(10) || '| Brand | Size |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_brand || '<br>a' || chr(92) || '|b |  |' || chr(10) md, 'ok' status from part",
        "office_media": "select p_partkey doc_id, 'fig.png' name, '<w:p' \"data\" from part",
        "office_sheets": "select p_partkey doc_id, case when p_partkey % 9 < 8 then '| Name | Size |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_name || ', ' || p_type || ' | ' || p_size || ' |' || chr(10) || '| ' || p_brand || chr(92) || '|x |  |' || chr(10) end md, case when p_partkey % 9 < 8 then 'ok' else 'unsupported' end status from part",
        "collapsed_cells": f"with {_TORN_SQL}, {_BROKEN} select doc_id, first_line, line_no, cell, br_count from mg",
        "split_tables": f"with {_TORN_SQL}, {_BROKEN} select doc_id, first_line, last_line, \"text\" from sp",
        "table_repair_records": f"{repaired}, p0 as (select doc_id, line_no, min(page) page0 from pl group by 1, 2) select lg.doc_id, lg.line_no + 1 line, br_count, case when page0 is not null then coalesce(fd.page, page0) end page, case when page0 is null then 'no-page' when fd.page is null then 'no-match' else 'repaired' end status from lg left join p0 using (doc_id, line_no) left join fd on fd.doc_id = lg.doc_id and fd.first_line = lg.first_line",
        "table_repair_lines": f"{repaired}, sg as (select fd.doc_id, fd.first_line, last_line, mt from fd join bl using (doc_id, first_line)), ln as (select lines.doc_id, line_no, case when sg.mt is null then [line] when line_no = first_line then string_split(mt, chr(10)) else [] end ls from lines left join sg on sg.doc_id = lines.doc_id and line_no between first_line and last_line) select doc_id, line_no, unnest(range(len(ls)))::int part, unnest(ls) line from ln",
        "caption_divergence": f"with {_DIV} select * from dv",
        "vision_audit": f"with {_DIV}, n as (select doc_id, count(*) f from dv group by 1), g as (select doc_id, sum(assess::int) assessed from ok group by 1) select doc_id, assessed, coalesce(f, 0) findings from g left join n using (doc_id)",
        "vision_report": f"with {_DIV} select doc_id, 1 n, '  ' || basename || '  (source names: ' || dropped || ')' || chr(10) || '    ALT: ' || left(alt, 120) || chr(10) || '    CAP: ' || left(caption, 120) line from dv",
        "vision_replies": f"with r as ({_REPLY}) select id, id % 5 < 2 parsed, id % 5 = 0 is_diagram, case when id % 5 = 0 then 'map' end diagram_type, case id % 5 when 0 then 'A map of ' || alt2 when 1 then 'Image at ' || name || '.' else 'Image at ' || name || ' (description unavailable).' end caption, case when id % 5 = 0 then 'graph TD' end mermaid, case when length(alt) >= 12 then alt else 'Image at ' || name || ' (extraction failed).' end fallback, 'Describe the image.' || chr(10) || 'The source describes it as: ' || alt prompt from r join (select c_custkey id, c_name alt2 from customer) using (id)",
        "task_summary": f"with c as ({_CALLS}), d as (select * replace (coalesce(nullif(task, ''), 'unknown') as task) from c) select task, count(*) calls, sum(success::int) successful, sum(prompt_tokens) prompt_tokens, sum(completion_tokens) completion_tokens, sum(cost_usd) cost_usd, sum(duration_ms) duration_ms, coalesce(string_agg(distinct model, ',' order by model) filter (model <> ''), '') models, coalesce(string_agg(distinct backend, ',' order by backend) filter (backend <> ''), '') backends from d group by rollup (task)",
        "invalidate_cascade": f"with st(i, n, f, c) as (values {stages}), r as ({_STAGES}), o as (select r.*, st.i, st.c from r join st on st.n = r.stage) select doc_id, replace(u, '{{stem}}', stem) \"path\" from (select doc_id, stem, unnest(c) u from o union all select doc_id, stem, unnest(st.f) from o join st on st.i >= o.i)",
        "resume_points": f"with s as ({_SNAPS}), x as (select *, coalesce(raw_time >= source_time, false) r, coalesce(cleaned_time >= raw_time, false) and f > 2 c from s) select doc_id, case when r and c then 'cleaned' when r then 'raw' else 'source' end resume from x",
        "deliverables": f"select * from ({_DELIVER}) where doc_id % 9 in (0, 2, 3, 7)",
        "cost_gate": f"with j as ({_JOBS}), n as (select doc_id, count(*) images, sum(hit::int) cached from ({_IMAGES}) group by 1) select doc_id, images, cached, images - cached misses, case when not runs then 'go' when images is null and backend <> 'local' then 'blocked' when confirmed then 'go' else 'confirm' end decision from j left join n using (doc_id)",
        "vision_slices": f"select o_orderkey, o_orderkey % 5 > 0 and o_custkey % 5 <> 0 and o_orderkey % 7 <= 5 and coalesce(case when o_custkey % 3 > 0 then o_custkey % 7 end, 6) >= 5 runs from orders where len({phases}) = 7",
        "run_records": "select o_orderkey doc_id, case when o_orderkey % 6 > 1 then o_orderpriority end version, case when o_orderkey % 6 > 1 and o_custkey % 2 = 0 then o_custkey end sections from orders",
        "source_identity": f"select p_partkey doc_id, case when p_partkey % 3 > 0 then {rr(rr('lower(p_name || ' + chr(39) + '.v2' + chr(39) + ')', '[^a-z0-9]+', '-'), '^-+|-+$')} when p_partkey % 2 = 0 then 'known-' || p_size end source_id, case when p_partkey % 3 > 0 then sha256(p_type) when p_partkey % 2 = 0 then 'h' end sha256 from part",
        "baselines": "select o_custkey doc_id, o_orderpriority \"label\", o_orderkey taken_at, row_number() over (partition by o_custkey order by o_orderkey desc, o_orderpriority desc)::int place from orders",
        "version_snapshots": "select o_orderkey doc_id, 'v' || o_orderpriority \"label\" from orders where o_orderkey % 4 > 0 and o_orderpriority <> '3-MEDIUM'",
    }
