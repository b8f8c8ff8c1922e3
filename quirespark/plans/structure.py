"""Queries of sections, audit and pages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as X
from ..functions import language
from ..functions import text as T
from ..operators import audit as A
from ..operators import lines as L
from ..operators import sections as S
from ..session import spread
from .fixtures import duck, spark_lines
from .passes import UPTO, ex, rm, rr, st


def q(x: str) -> str:
    return x.replace("'", "''")


_B = st(ex("line", S.ANY, 2))
_CH, _REST = ex(_B, S.CHAPTER), st(ex(_B, S.CHAPTER, 2))
_PARSED = f"""p as (select doc_id, line_no, line, {rm('line', S.ANY)} is_any, length({ex('line', S.ANY)}) lv, {ex('line', S.ANY, 2)} b, {rm('line', S.MEASURE)} or {rm('line', S.UNIT)} meas,
 {rm('line', S.NUMBERED)} bn, {ex('line', S.NUMBERED, 2)} nn, {ex('line', S.NUMBERED, 3)} nt, {_CH} ch, {_REST} rest from lines),
h as (select *, bn and not (lv = 2 and not contains(nn, '.')) and not meas hn, is_any and ch <> '' and not bn hc, is_any and {rm('b', S.PREFIX)} and not meas pf, case when rest <> '' then rest else 'Chapter ' || ch end ct from p),
m as (select *, case when hn or hc then lv end nl, case when hn then nn when hc then ch end nno, case when hn then nt when hc then ct end nti,
 case when is_any then lv end al, case when pf then {ex('b', S.PREFIX)} when hc then ch end ano, case when pf then {st(ex('b', S.PREFIX, 2))} when hc then ct when is_any then {st('b')} end ati from h)"""
_NEXT = lambda f: f"list_filter([1,2,3,4,5,6], lambda d: d > {f} and c[d] > 0)[1]"
_STEP = lambda i: f"o{i + 1} as (select *, case when c[f{i}] = 2 and c[{_NEXT(f'f{i}')}] >= 3 * c[f{i}] then {_NEXT(f'f{i}')} else f{i} end f{i + 1} from o{i})"
_OUTLINE = f"""{_PARSED}, k as (select doc_id, coalesce(min(nl) <= min(al), false) representative, [{', '.join(f'count(*) filter (al = {d})' for d in range(1, 7))}] c, count(al) n_headings from m group by doc_id),
o0 as (select *, coalesce(list_filter([1,2,3,4,5,6], lambda d: c[d] >= 2)[1], list_filter([1,2,3,4,5,6], lambda d: c[d] > 0)[1]) f0 from k), {', '.join(_STEP(i) for i in range(5))},
ol as (select doc_id, representative, f5::int min_level, n_headings from o5)"""
_SECTIONS = f"""{_OUTLINE}, r as (select m.*, ol.representative rep, min_level, case when ol.representative then nl else al end level, case when ol.representative then nno else ano end number, case when ol.representative then nti else ati end title from m join ol using (doc_id)),
g as (select *, sum((level is not null)::int) over (partition by doc_id order by line_no rows between unbounded preceding and current row) sec_no from r),
a as (select doc_id, sec_no, min(line_no) line_no, max(level) level, max(number) filter (level is not null) number, max(title) filter (level is not null) title,
 max((level is not null and not rep and number is null and level < min_level)::int) ancestor_only, coalesce(string_agg(line, chr(10) order by line_no) filter (level is null), '') body, count(*) filter (level is null) n_body,
 max((level is null and {st('line')} <> '')::int) some_, max((level is null and {st('line')} <> '' and not {rm(st('line'), r'^(?:!\[|\[\s*\]$)')})::int) prose from g group by 1, 2),
b as (select *, max(sec_no) over (partition by doc_id) last_, lag(sec_no) over w ps, lag(body) over w pb, lag(some_) over w pso, lag(prose) over w pp, lag(n_body) over w pn from a window w as (partition by doc_id order by sec_no)),
sections as (select doc_id, sec_no::int sec_no, line_no, (case when sec_no = 0 then 1 else level end)::int level, number, case when sec_no = 0 then 'Front Matter' else title end title, coalesce(ancestor_only, 0)::int ancestor_only, (sec_no = 0)::int preamble,
 case when sec_no = 1 and ps = 0 and pso = 1 and pp = 0 then pb || case when n_body > 0 then chr(10) || body else '' end else body end body, n_body + case when sec_no = 1 and ps = 0 and pso = 1 and pp = 0 then pn else 0 end n_lines from b where last_ > 0 and (sec_no > 0 or prose = 1))"""
_PARENTS = f"""{_SECTIONS}, tree as (select s.*, (case when preamble = 1 then null
 when number is null then (select max(c.sec_no) from sections c where c.doc_id = s.doc_id and c.preamble = 0 and c.sec_no < s.sec_no and c.level < s.level)
 when not contains(number, '.') then (select max(c.sec_no) from sections c where c.doc_id = s.doc_id and c.preamble = 0 and c.sec_no < s.sec_no and c.level < s.level and c.number is null)
 else (select max(c.sec_no) from sections c where c.doc_id = s.doc_id and c.sec_no < s.sec_no and c.level < s.level and c.number = regexp_replace(s.number, '\\.\\d+$', '')) end)::int parent_sec_no from sections s)"""
_NAME = "(case when number is not null then number || '. ' || title else title end)"
_T = st(_NAME)
_PAGE = r"(^|\W)\d{2,}\s*$"
_PHANTOM = f"({rm(_T, r'(?i)\bp\.\s*\d+\s*$')} or {rm(st(ex(_T, r'(?i)^Chapter\s+\d+\b(.*)$')), _PAGE)} or {rm(st(ex(_T, r'^\d+(?:\.\d+)+\b(.*)$')), _PAGE)} or ({rm(st(ex(_T, r'^(\d+)\.\s+(.+)$', 2)), _PAGE)} and lower({st(ex(_T, r'^(\d+)\.\s+(.+)$', 2))}) <> 'chapter ' || {ex(_T, r'^(\d+)\.\s+(.+)$')}))"
_CHARS = f"length({st(rr('body', q(S.PAGE_ANCHOR.replace(chr(94), '(?m)^')), ''))})"
_FREE = lambda c: f"list_reduce(list_prepend({c}, list_transform(range(len(regexp_extract_all({c}, '\\]\\('))), lambda i: '')), lambda a, b: regexp_replace(a, '{T.LINK}', '\\1', 'g'))"
_PSLUG = lambda c: rr(rr(f"lower({c})", r"[^\p{L}\p{N}$]+", "-"), "^-+|-+$")
_STEM = lambda c: f"list_transform([{_PSLUG(_FREE(c))}], lambda z: case when z = '' then 'section' when length(z) > 200 then {rr('left(z, 200)', '^-+|-+$')} else z end)[1]"
_CLEAN = lambda c: f"list_transform([{st(rr(rr(_FREE(c), r'[|' + chr(92) + '[' + chr(92) + r']()<>' + chr(92) * 2 + r'\n\r\t]+', ' '), r'\s+', ' '))}], lambda z: case when z = '' then '…' when length(z) > 50 then {rr('left(z, 50)', r'\s+$')} || '…' else z end)[1]"
_BODY_LINES = f"list_filter(string_split(body, chr(10)), lambda x: {st('x')} <> '')"
_HEAD = "repeat('#', level) || ' ' || case when number is not null then number || '. ' else '' end || title"
#: All sections with flags, the path of their ancestors and its open end.
_PATHS = f"""{_PARENTS}, fl as (select *, {_PHANTOM} phantom, ancestor_only = 1 and {st('body')} = '' shell, len(list_filter({_BODY_LINES}, lambda x: {rm('x', S.NAV_LINE)})) links, len({_BODY_LINES}) nb from tree),
f2 as (select *, links >= 2 and links >= 0.8 * nb and not phantom nav from fl),
w as (select doc_id, sec_no, parent_sec_no at_, []::int[] path, []::int[] open, false closed from f2 union all
 select w.doc_id, w.sec_no, p.parent_sec_no, case when p.nav then path else list_prepend(p.sec_no, path) end, case when p.nav or closed or p.phantom or p.shell then open else list_prepend(p.sec_no, open) end, closed or (not p.nav and (p.phantom or p.shell)) from w join f2 p on p.doc_id = w.doc_id and p.sec_no = w.at_),
pa as (select f2.*, path, open from f2 join w using (doc_id, sec_no) where at_ is null)"""
_KEPT = f"""{_PATHS}, kp as (select distinct doc_id, unnest(list_append(open, sec_no)) sec_no from pa where {_CHARS} >= {S.MIN_BODY} and not phantom and not shell), kept as (select pa.* from pa join kp using (doc_id, sec_no))"""


def _files(nested: bool = False) -> str:
    """Files of the kept sections: f3 with dir, file, section_id and ord."""
    names = f"case when number is not null then {_PSLUG('number')} else {_STEM('title')} end"
    chain = f"list_transform(range(1, greatest(len(string_split(s.number, '.')), 2)), lambda i: {_PSLUG(chr(97) + 'rray_to_string(string_split(s.number, ' + chr(39) + '.' + chr(39) + ')[1:i], ' + chr(39) + '.' + chr(39) + ')')})"
    where = f"case when s.number is not null then {chain} when len(s.path) = 0 then [{_STEM('s.title')}] else (select list(nm order by n.sec_no) from nms n where n.doc_id = s.doc_id and list_contains(s.path, n.sec_no)) end" if nested else "[]::varchar[]"
    return f"""{_KEPT}, nms as (select doc_id, sec_no, {names} nm from pa), f0 as (select s.*, {where} dir, {_STEM(_NAME.replace('number', 's.number').replace('title', 's.title'))} stem, {st(rr('s.body', r'\s+', ' '))} b from kept s),
f1 as (select *, first_value(b) over x fb, row_number() over x rn from f0 window x as (partition by doc_id, dir, stem order by sec_no)),
f4 as (select *, stem || case when row_number() over x > 1 then '-' || row_number() over x else '' end || '.md' file from f1 where rn = 1 or b <> fb window x as (partition by doc_id, dir, stem order by sec_no)),
f3 as (select *, array_to_string(list_append(dir, file), '/') section_id, row_number() over (partition by doc_id order by sec_no)::int ord from f4)"""


#: Crumbs and parents of the files, flat.
_IDENT = f"""{_files()}, st as (select doc_id, sec_no, unnest(path) a, unnest(range(len(path))) pos from f3),
tr as (select s.doc_id, s.sec_no, string_agg(case when g.file is not null then '[' || {_CLEAN(_NAME.replace('number', 'p.number').replace('title', 'p.title'))} || '](' || g.file || ')' else {_CLEAN(_NAME.replace('number', 'p.number').replace('title', 'p.title'))} end, ' / ' order by pos) t, arg_max(g.file, pos) filter (g.file is not null) parent_id,
 list({_FREE(_NAME.replace('number', 'p.number').replace('title', 'p.title'))} order by pos) section_path, arg_max(s.a, pos) up from st s join pa p on p.doc_id = s.doc_id and p.sec_no = s.a left join f3 g on g.doc_id = s.doc_id and g.sec_no = s.a group by 1, 2),
idt as (select f3.*, '> ↑ ' || t crumb, parent_id, coalesce(section_path, []) section_path, up, {_FREE(_NAME)} shown from f3 left join tr using (doc_id, sec_no)),
kids as (select doc_id, up sec_no, string_agg('- [' || shown || '](' || section_id || ')', chr(10) order by ord) children from idt where up is not null group by 1, 2)"""
_ANCH = f"list_filter(range(1, len(bl) + 1), lambda i: not {rm('bl[i]', S.PAGE_ANCHOR)})"
_CONTENT = f"""{_IDENT}, b1 as (select idt.*, children, case when n_lines > 0 then string_split(body, chr(10)) else [] end bl from idt left join kids using (doc_id, sec_no)), b2 as (select *, coalesce({_ANCH}[1] - 1, len(bl)) na from b1),
b3 as (select *, {st("array_to_string(bl[na + 1:], chr(10))")} rest from b2)"""
_FRONT = "'---' || chr(10) || concat_ws(chr(10), 'doc_id: ' || to_json(doc_id::varchar), 'section_id: ' || to_json(section_id), 'parent_id: ' || to_json(parent_id), 'section_title: ' || to_json({free}), case when len(section_path) > 0 then 'section_path: [' || array_to_string(list_transform(section_path, lambda x: to_json(x)::varchar), ', ') || ']' end, 'section_number: ' || to_json(number), 'heading_level: ' || level, 'depth: ' || len(section_path), 'order: ' || ord) || chr(10) || '---' || chr(10) || chr(10)".replace("{free}", _FREE("title"))
#: English subtrees: texts of the sections below, in order.
_ENGLISH = f"""{_PATHS}, lo as (select doc_id, sec_no, {_HEAD} || chr(10) || body t, list_append(path, sec_no) up from pa where not phantom), bel as (select doc_id, sec_no n, unnest(up) sec_no, t from lo), docs_ as (select doc_id, sec_no, string_agg(t, chr(10) order by n) "text" from bel group by 1, 2)"""
#: Sections put together up to PACK characters.
PACK = 3000
_PACKED = f"""{_KEPT}, qo1 as (select *, length({_HEAD}) + 1 + case when n_lines > 0 then length(body) + 1 else 0 end own from kept), sb as (select doc_id, unnest(list_append(open, sec_no)) sec_no, own from qo1), sz as (select doc_id, sec_no, sum(own) size from sb group by 1, 2),
fits as (select doc_id, list(sec_no) ok from sz where size <= {PACK} group by 1), qo2 as (select qo1.*, size <= {PACK} fit, coalesce(list_filter(list_append(open, sec_no), lambda n: list_contains(ok, n))[1], sec_no) head from qo1 join sz using (doc_id, sec_no) left join fits using (doc_id)),
qo3 as (select doc_id, head, string_agg(case when head = sec_no then case when n_lines > 0 then body end else chr(10) || {_HEAD} || case when n_lines > 0 then chr(10) || body else '' end end, chr(10) order by sec_no) body, max(case when head = sec_no then own end) own, bool_or(fit and head = sec_no) fit from qo2 group by 1, 2),
l1 as (select doc_id, head, unnest(string_split(body, chr(10))) line, unnest(range(len(string_split(body, chr(10))))) i from qo3 where not fit and own > {PACK} and body is not null), l2 as (select *, {rm(rr('line', r'^\s+'), '^(```|~~~)')}::int mk from l1),
l3 as (select *, coalesce(sum(mk) over (partition by doc_id, head order by i rows between unbounded preceding and 1 preceding), 0) % 2 = 1 inside from l2), l4 as (select *, not inside and {st('line')} = '' sep from l3), l5 as (select *, sum(sep::int) over (partition by doc_id, head order by i) blk from l4),
bk as (select doc_id, head, row_number() over (partition by doc_id, head order by blk) n, string_agg(line, chr(10) order by i) t, sum(length(line) + 1) + 1 size from l5 where not sep group by doc_id, head, blk),
fill as (select doc_id, head, n, t, size cur, 1 part from bk where n = 1 union all select b.doc_id, b.head, b.n, b.t, case when f.cur + b.size > {PACK} then b.size else f.cur + b.size end, case when f.cur + b.size > {PACK} then f.part + 1 else f.part end from fill f join bk b on b.doc_id = f.doc_id and b.head = f.head and b.n = f.n + 1),
pt as (select doc_id, head, part, string_agg(t, chr(10) || chr(10) order by n) body, max(part) over (partition by doc_id, head) parts from fill group by doc_id, head, part),
pk as (select doc_id, head sec_no, part, parts, body from pt where parts > 1 union all select doc_id, head, 1, 1, coalesce(body, '') from qo3 where not exists (select 1 from pt where pt.doc_id = qo3.doc_id and pt.head = qo3.head and parts > 1))"""


def markdown_sql(c: str) -> str:
    for pattern, to in X.MARKDOWN:
        c = f"regexp_replace({c}, '{q(pattern)}', '{q(to).replace('{1}', chr(92) + '1').replace('{2}', chr(92) + '2')}', 'g')"
    for e, char in X.ENTITIES:
        c = f"replace({c}, '{q(e)}', '{q(char)}')"
    for pattern, to in X.SQUEEZE:
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return st(c)


def language_sql(table: str, also: str | None = None) -> str:
    """(doc_id, dropped) of texts by the rule of ``language.non_english``."""
    known = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    more = f"{also}, " if also else ""
    return f"""with la as (select doc_id, {more}{rr('"text"', language.IMAGE, ' ')} t from {table}), lb as (select doc_id, {more}regexp_extract_all(t, '\\p{{L}}') ls, list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{Nl}}\\p{{No}}]+'), lambda w: w <> '') ws from la),
 lc as (select doc_id, {more}len(ls) l, len(list_filter(ls, lambda c: {rm('c', language.OTHER_RANGE)})) o, len(ws) n, len(list_filter(ws, lambda w: list_contains({known(language.ENGLISH)}, w))) e, len(list_filter(ws, lambda w: list_contains({known(language.FOREIGN)}, w))) f from lb)
 select doc_id, {more}(case when l < 12 then false when o > 0.3 * l then true when l < 30 or n < 20 then false when e >= {language.SHARE} * n then false else f >= {language.SHARE} * n end)::int dropped from lc"""


_PAGES = f"md as (select page_id doc_id, string_split({markdown_sql('html')}, chr(10)) ls from pages), lines as (select doc_id, unnest(range(len(ls)))::bigint line_no, unnest(ls) line from md)"


def _hidden_sql(c: str) -> str:
    for pattern, to in (*X.MARKDOWN[1:3], *X.MARKDOWN[6:8]):
        c = f"regexp_replace({c}, '{q(pattern)}', '{to}', 'g')"
    return c


_MARK = f"({rr('line', r'^\s+')} like '```%')::int"
_PROSE = f"f0 as (select *, {_MARK} mk, sum({_MARK}) {UPTO} nf from lines), pl as (select doc_id, line_no, {rr('line', r'`[^`\n]+`', ' ')} line from f0 where mk = 0 and nf % 2 = 0)"
_CELLS = f"string_split({rr(st('line'), r'^\|+|\|+$')}, '|')"


def _find(check: str, severity: str, message: str, frm: str) -> str:
    return f"select doc_id, '{check}' \"check\", '{severity}' severity, line_no + 1 line, {message} message from {frm}"


_AUDIT = {
    "collapsed_table": ("tab", f"c as (select *, list_max(list_transform({_CELLS}, lambda c: len(regexp_extract_all(c, '(?i)<br\\s*/?>')))) worst from pl where {st('line')} like '|%')", ("error", "'table cell of ' || worst || ' joined lines'", f"c where worst >= {A.BR_MIN}")),
    "misaligned_table": ("tab", f"""t0 as (select *, {st('line')} like '|%' tb from pl), t1 as (select *, sum((not tb)::int) {UPTO} run from t0), t2 as (select doc_id, run, line_no, list_transform({_CELLS}, lambda c: {st('c')}) cells from t1 where tb),
 t3 as (select *, count(*) over (partition by doc_id, run) nr from t2 where len(list_filter(cells, lambda c: not {rm('c', r'^:?-{3,}:?$|^$')})) > 0), t4 as (select doc_id, run, line_no, len(list_filter(cells, lambda c: c <> '')) filled, unnest(cells) cell, unnest(range(len(cells))) col from t3 where nr >= 3),
 t5 as (select *, sum((cell like '%:')::int) over (partition by doc_id, run, col) labels, count(*) over (partition by doc_id, run, col) n from t4 where cell <> '')""", ("warning", "'two labels in a cell: ' || left(cell, 60)", f"t5 where labels >= 3 and labels * 2 >= n and {rm('cell', r'\S:\s+\S')} and filled > 1")),
    "html_fragment": ("noise", f"c as (select *, {rr('line', r'\]\(<[^>\n]*>\)', ']()')} l2 from pl), d as (select *, case when {ex('l2', A.TABLE_TAG, 0)} <> '' then {ex('l2', A.TABLE_TAG, 0)} else {ex('l2', A.EMPTY_ATTRIBUTE, 0)} end hit from c)", ("error", "'left-over HTML of a table: ' || hit", "d where hit <> ''")),
    "html_entity": ("noise", f"c as (select *, len(regexp_extract_all(line, '{A.ENTITY}')) n from pl)", ("error", "n || ' entities left'", "c where n > 0")),
    "replacement_char": ("noise", "c as (select doc_id, min(line_no) line_no, sum(length(line) - length(replace(line, '\ufffd', ''))) n from lines where contains(line, '\ufffd') group by 1)", ("error", "n || ' replacement characters'", "c")),
    "shattered_emphasis": ("noise", "", ("error", "'four or more emphasis marks in a row'", f"pl where {rm('line', r'\*{4,}')} and not {rm('line', r'^\s*\*+\s*$')}")),
    "duplicate_heading": ("book", f"c as (select *, {ex('line', r'^(#{1,6})\s+(.+?)\s*$', 2)} title from pl), d as (select doc_id, min(line_no) line_no, arg_min(title, line_no) title, count(*) n from c where title <> '' and lower(title) <> 'subsections' group by doc_id, lower(title))", ("warning", "'heading ''' || title || ''' ' || n || ' times'", "d where n >= 4")),
    "empty_section": ("shells", f"""e0 as (select *, {st('line')} s, sum(({st('line')} = '---')::int) {UPTO} nth, max((line_no = 0 and {st('line')} = '---')::int) over (partition by doc_id) fronted, sum(({st('line')} = '---')::int) over (partition by doc_id) ends from lines), e1 as (select *, fronted = 1 and ends > 1 and (nth < 2 or nth = 2 and s = '---') head from e0),
 c as (select doc_id, 0 line_no, max((not head and s <> '' and not s like '#%' and not s like '> ↑%' and not {rm('s', '^<span id="page-' + chr(92) + 'd+-' + chr(92) + 'd+"></span>$')})::int) body, max((not head and s = '## Subsections')::int) sub from e1 group by 1)""", ("warning", "'no body'", "c where body = 0 and sub = 0")),
}


def _audit_sql(name: str, corpus: str | None = None) -> str:
    own, ctes, (severity, message, frm) = _AUDIT[name]
    return f"with {duck(corpus or own)}, {_PROSE}{', ' + ctes if ctes else ''} {_find(name, severity, message, frm)}"


_NOISE = "noise"


def _joined(df):
    return df.withColumn("body", F.array_join("body", "\n"))


def _tree(lines):
    return S.find_parents(S.parse_sections(lines))


#: Pages whose sections one task makes.
PAGES = 1000


def page_lines(spark, sf_dir: str):
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"), PAGES, "page_id")
    return L.explode_lines(pages.select(F.col("page_id").alias("doc_id"), X.html_to_markdown(F.col("html")).alias("md")))


def queries() -> dict:
    out = {
        "outline": lambda spark, d: S.outline(spark_lines(spark, d, "book")),
        "outline_noise": lambda spark, d: S.outline(spark_lines(spark, d, "noise")),
        "html_to_markdown": lambda spark, d: spark.read.parquet(f"{d}/pages.parquet").select("page_id", X.html_to_markdown(F.col("html")).alias("md")),
        "html_drop_hidden": lambda spark, d: spark.read.parquet(f"{d}/pages.parquet").select("page_id", X.drop_hidden(F.col("html")).alias("html")),
        "page_sections": lambda spark, d: S.chunks(page_lines(spark, d)).select("doc_id", "sec_no", "level", "title", "crumb", "text"),
        "audit_summary": lambda spark, d: A.summary(A.audit(spark_lines(spark, d, "noise"))),
        "audit_topk": lambda spark, d: A.report(A.html_entity(spark_lines(spark, d, "noise"))),
    }
    for c in ("out", "book", "noise"):
        out[f"section_parse_{c}"] = lambda spark, d, c=c: _joined(S.parse_sections(spark_lines(spark, d, c)))
        out[f"section_parent_{c}"] = lambda spark, d, c=c: _tree(spark_lines(spark, d, c)).select("doc_id", "sec_no", "number", "title", "parent_sec_no")
        out[f"min_body_keep_{c}"] = lambda spark, d, c=c: S.keep_sections(S.tree(spark_lines(spark, d, c))).select("doc_id", "sec_no", "title")
        out[f"breadcrumbs_{c}"] = lambda spark, d, c=c: S.breadcrumbs(S.tree(spark_lines(spark, d, c)))
    for c in ("book", "links"):
        out[f"section_content_{c}"] = lambda spark, d, c=c: S.section_files(spark_lines(spark, d, c))
        out[f"section_index_{c}"] = lambda spark, d, c=c: S.index(spark_lines(spark, d, c))
        out[f"nested_paths_{c}"] = lambda spark, d, c=c: S.identified(S.tree(spark_lines(spark, d, c)), nested=True).select("doc_id", "sec_no", "section_id")
    out["section_links"] = lambda spark, d: S.linked_sections(S.tree(spark_lines(spark, d, "links")))
    out["nav_list_paths"] = lambda spark, d: S.tree(spark_lines(spark, d, "links")).select("doc_id", "sec_no", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"), F.array_join(F.col("open").cast("array<string>"), ",").alias("open"))
    out["english_subtrees"] = lambda spark, d: S.english_sections(S.tree(spark_lines(spark, d, "noise"))).select("doc_id", "sec_no")
    out["pack_sections"] = lambda spark, d: S.pack_sections(S.keep_sections(S.tree(spark_lines(spark, d, "noise", together=True))), PACK).select("doc_id", "sec_no", "part", "parts", F.array_join("body", "\n").alias("body"))
    out["toc_phantom_drop"] = lambda spark, d: S.drop_toc_phantoms(S.parse_sections(spark_lines(spark, d, "book"))).select("doc_id", "sec_no", "title")
    out["section_files"] = lambda spark, d: S.file_names(S.parse_sections(spark_lines(spark, d, "noise"))).select("doc_id", "sec_no", "file")
    for name, (corpus, _, _) in _AUDIT.items():
        out[f"audit_{name}"] = lambda spark, d, name=name, corpus=corpus: A.CHECKS[name](spark_lines(spark, d, corpus))
    return out


def oracle_sql() -> dict[str, str]:
    out = {
        "outline": f"with {duck('book')}, {_OUTLINE} select * from ol",
        "outline_noise": f"with {duck('noise')}, {_OUTLINE} select * from ol",
        "html_to_markdown": f"select page_id, {markdown_sql('html')} md from pages",
        "html_drop_hidden": f"select page_id, {_hidden_sql('html')} html from pages",
        "page_sections": f"with recursive {_PAGES}, {_IDENT} select doc_id, sec_no, level, title, crumb, {_HEAD} || chr(10) || chr(10) || {st('body')} \"text\" from idt",
        "toc_phantom_drop": f"with {duck('book')}, {_SECTIONS} select doc_id, sec_no, title from sections where not {_PHANTOM}",
        "section_files": f"with {duck('noise')}, {_SECTIONS}, n as (select doc_id, sec_no, {_STEM(_NAME)} slug, {st(rr('body', r'\s+', ' '))} b from sections), f as (select *, first_value(b) over w fb, row_number() over w rn from n window w as (partition by doc_id, slug order by sec_no)), kk as (select *, row_number() over (partition by doc_id, slug order by sec_no) k from f where rn = 1 or b <> fb) select doc_id, sec_no, slug || case when k > 1 then '-' || k else '' end || '.md' file from kk",
        "section_links": f"with recursive {duck('links')}, {_IDENT}, ch as (select *, list_reverse(list_append(path, sec_no)) chain from idt), wn as (select distinct doc_id, sec_no, chain, unnest(regexp_extract_all(body, '\\[[^\\]]+\\]\\(#([^)]+)\\)', 1)) slug from ch), hv as (select doc_id, {rr(rr(rr(rr(rr(f'lower({_HEAD})', '^#+' + chr(92) + 's*'), chr(92) + 's+', '-'), '[^a-z0-9-]'), '-+', '-'), '^-+|-+$')} slug, ord, section_id target, chain other from ch), pr as (select w.doc_id, w.sec_no, w.slug, arg_min(target, (coalesce(list_filter(range(len(w.chain)), lambda i: list_contains(h.other, w.chain[i + 1]))[1], 1073741824), h.ord)) target from wn w join hv h on h.doc_id = w.doc_id and h.slug = w.slug where h.slug <> '' group by 1, 2, 3) select * from pr",
        "nav_list_paths": f"with recursive {duck('links')}, {_PATHS} select doc_id, sec_no, array_to_string(path, ',') path, array_to_string(open, ',') \"open\" from pa",
        "english_subtrees": f"with recursive {duck('noise')}, {_ENGLISH}, lg as ({language_sql('docs_', 'sec_no')}), bad as (select doc_id, list(sec_no) b from lg where dropped = 1 group by 1) select lo.doc_id, lo.sec_no from lo left join bad using (doc_id) where b is null or not list_has_any(b, up)",
        "pack_sections": f"with recursive {duck('noise')}, {_PACKED} select doc_id, sec_no, part::int part, parts::int parts, body from pk",
        "audit_topk": f"with {duck('noise')}, {_PROSE}, {_AUDIT['html_entity'][1]}, x as ({_find('html_entity', *_AUDIT['html_entity'][2])}), y as (select *, row_number() over (partition by doc_id order by line, message) rn, count(*) over (partition by doc_id) n from x) select doc_id, \"check\", severity, line, message, greatest(n - 3, 0) more from y where rn <= 3",
    }
    for c in ("out", "book", "noise"):
        out[f"section_parse_{c}"] = f"with {duck(c)}, {_SECTIONS} select * exclude (n_lines) from sections"
        out[f"section_parent_{c}"] = f"with {duck(c)}, {_PARENTS} select doc_id, sec_no, number, title, parent_sec_no from tree"
        out[f"min_body_keep_{c}"] = f"with recursive {duck(c)}, {_KEPT} select doc_id, sec_no, title from kept"
        out[f"breadcrumbs_{c}"] = f"with recursive {duck(c)}, {_IDENT} select doc_id, sec_no, crumb from idt"
    for c in ("book", "links"):
        out[f"section_content_{c}"] = f"with recursive {duck(c)}, {_CONTENT} select doc_id, section_id, {_FRONT} || {rr("concat_ws(chr(10) || chr(10), array_to_string(list_prepend(" + _HEAD + ", bl[1:na]), chr(10)), crumb, case when rest <> '' then rest end, '## Subsections' || chr(10) || chr(10) || children)", chr(92) + "s+$")} || chr(10) content from b3"
        out[f"section_index_{c}"] = f"with recursive {duck(c)}, {_IDENT} select doc_id, '# Split Sections: ' || doc_id || chr(10) || chr(10) || '## Top-level Sections' || chr(10) || chr(10) || string_agg('- [' || shown || '](' || section_id || ')', chr(10) order by ord) || chr(10) md from idt where parent_id is null group by doc_id"
        out[f"nested_paths_{c}"] = f"with recursive {duck(c)}, {_files(True)} select doc_id, sec_no, section_id from f3"
    out["audit_summary"] = f"select \"check\", severity, count(*) n, count(distinct doc_id) n_docs from ({' union all '.join(f'(select * from ({_audit_sql(n, _NOISE)}))' for n in _AUDIT)}) group by 1, 2"
    for name in _AUDIT:
        out[f"audit_{name}"] = _audit_sql(name)
    return out
