"""Queries of line rules and heading passes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import headings as H
from ..operators import lines as L
from ..operators import repair as R
from .fixtures import duck, spark_lines

W = "partition by doc_id order by line_no"
UPTO = f"over ({W} rows between unbounded preceding and current row)"
BEFORE = f"over ({W} rows between unbounded preceding and 1 preceding)"
AFTER = "over (partition by doc_id order by line_no desc rows between unbounded preceding and 1 preceding)"
DOC = "over (partition by doc_id)"


def rr(c: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({c}, '{pattern}', '{to}', '{flags}')"


def st(c: str) -> str:
    return rr(c, r"^\s+|\s+$")


def ex(c: str, pattern: str, group: int = 1, flags: str = "") -> str:
    return f"regexp_extract({c}, '{pattern}', {group}{', ' + chr(39) + flags + chr(39) if flags else ''})"


def rm(c: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({c}, '{pattern}'{', ' + chr(39) + flags + chr(39) if flags else ''})"


def dots(c: str) -> str:
    return f"(length({c}) - length(replace({c}, '.', '')))"


def demoted(c: str, marks: str = "#{1,6}") -> str:
    return rr(c, rf"^(\s*){marks}\s+(.*)$", r"\1\2")


PROSE_TITLE = "(length({t}) > 120 or (length({t}) > 10 and regexp_matches(left({t}, length({t})-10), '\\. [A-Z]')) or (length({t}) > 40 and regexp_matches({t}, '[.?!]$')) or regexp_matches({t}, '^\\p{{Ll}}'))"

_S = st("line")
_TRIM = lambda c: st(rr(c, r"^[* ]+|[* ]+$"))
_LOCK = r"^(\s*)#+\s+(\d+\.\d+(?:\.\d+)*[a-z]?\.?\s+.+?)\s*$"
_NUM = r"^(#+)\s+(\d+(?:\.\d+)*\.)\s+(.+?)$"

FREE = f"list_reduce(list_prepend(line, list_transform(range(len(regexp_extract_all(line, '\\]\\('))), lambda i: '')), lambda a, b: regexp_replace(a, '{T.LINK}', '\\1', 'g'))"

#: name -> (column rule, SQL of the new line)
RULES = {
    "collapse_emphasis": (T.collapse_emphasis, f"case when {rm('line', r'^\s*\*{3,}\s*$')} then line else {rr('line', r'\*{4,}', '**')} end"),
    "decode_entities": (T.decode_entities, "replace(replace(replace(replace(line, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"),
    "strip_control": (T.strip_control, rr("line", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]")),
    "strip_non_ascii": (T.strip_non_ascii, rr("line", r"[^\x09\x0A\x0D\x20-\x7E]")),
    "strip_inline_tags": (T.strip_inline_tags, rr("line", r"</?(i|b|strong)>", "", "gi")),
    "strip_page_spans": (T.strip_page_spans, rr("line", r'<span id="page-\d+-\d+"></span>')),
    "strip_page_refs": (T.strip_page_refs, rr("line", r"\[([^\]]+)\]\(#page-\d+-\d+\)", r"\1")),
    "repair_cross_ref": (T.repair_cross_ref, "array_to_string(list_transform(string_split(" + rr("line", f"({T.CROSS_REF})", "__").replace("'__'", "chr(1) || chr(2) || '~1' || chr(1)".replace("~", chr(92))) + f", chr(1)), lambda s: case when not starts_with(s, chr(2)) then s when not contains({ex('substr(s, 2)', T.CROSS_REF)}, '[') or {rm(ex('substr(s, 2)', T.CROSS_REF), chr(94) + r'[^\[]* \[')} then substr(s, 2) else '[' || replace({ex('substr(s, 2)', T.CROSS_REF)}, '[', '') || '](#' || {ex('substr(s, 2)', T.CROSS_REF, 2)} || ')' end), '')"),
    "unescape_underscores": (T.unescape_underscores, r"replace(line, '\_', '_')"),
    "collapse_spaces": (T.collapse_spaces, rr("line", r"\s{2,}", " ")),
    "list_bullet": (T.list_bullet, rr(rr(rr("line", r"^(\s*)-\s*o\s+(.+)$", r"\1  - \2", "i"), r"^(\s*)-\s*([a-z])\.\s+(.+)$", r"\1  - \2) \3", "i"), r"^(\s*)-\s*([ivxlcdm]+)\.\s+(.+)$", r"\1    - \2) \3", "i")),
    "heading_emphasis": (T.heading_emphasis, f"case when {rm('line', r'^\s*#{1,6}\s+.*$')} then {ex('line', r'^(\s*#{1,6}\s+)(.*)$')} || {st(rr(rr(ex('line', r'^(\s*#{1,6}\s+)(.*)$', 2), r'\*\*|__'), r'\s{2,}', ' '))} else line end"),
    "marker_pollution": (T.marker_pollution, st(rr(rr(rr(rr("line", r'<span\s+id="[^"]*"\s*>\s*</span>'), r"\[([^\]]+)\]\(#page-\d+-\d+\)", r"\1"), r"\]\(#page-\d+-\d+\)"), r"\s+", " "))),
    "lock_depth": (T.lock_depth, f"case when {ex('line', _LOCK, 2)} = '' then line else {ex('line', _LOCK, 1)} || repeat('#', least({dots(ex(ex('line', _LOCK, 2), r'^(\d+(?:\.\d+)+)'))} + 1 + length({ex(ex('line', _LOCK, 2), r'^\d+(?:\.\d+)+([a-z])?')}), 6)) || ' ' || {ex('line', _LOCK, 2)} end"),
    "promote_numbered": (T.promote_numbered, f"case when {_S} like '#%' then case when {ex(_S, r'^(#+)\s*(.+?)$')} = '' then line else repeat('#', least(length({ex(_S, r'^(#+)\s*(.+?)$')}), 6)) || ' ' || {_TRIM(ex(_S, r'^(#+)\s*(.+?)$', 2))} end when {dots(ex(_S, r'^(\d+(?:\.\d+)*)\.\s+.+$'))} = 0 then line else repeat('#', least({dots(ex(_S, r'^(\d+(?:\.\d+)*)\.\s+.+$'))} + 1, 6)) || ' ' || {ex(_S, r'^(\d+(?:\.\d+)*)\.\s+.+$')} || '. ' || {_TRIM(ex(_S, r'^\d+(?:\.\d+)*\.\s+(.+)$'))} end"),
    "prose_demote": (T.demote_prose, f"case when {_S} not like '#%' then line when {rm(_S, _NUM)} then case when {PROSE_TITLE.format(t=ex(_S, _NUM, 3))} then {ex(_S, _NUM, 2)} || ' ' || {ex(_S, _NUM, 3)} else line end when {ex(_S, r'^(#+)\s+(.+?)$', 2)} = '' then line when {rm(ex(_S, r'^(#+)\s+(.+?)$', 2), r'^(?:Figure|Fig\.|Table|Tbl\.|Eq\.|Equation)\s+\d', 'i')} then {ex(_S, r'^(#+)\s+(.+?)$', 2)} when {rm(ex(_S, r'^(#+)\s+(.+?)$', 2), r'\p{Lu}')} and not {rm(ex(_S, r'^(#+)\s+(.+?)$', 2), r'\p{Ll}')} then line when (length({ex(_S, r'^(#+)\s+(.+?)$', 2)}) > 40 and {rm(ex(_S, r'^(#+)\s+(.+?)$', 2), r'[.?!]$')}) or (length({ex(_S, r'^(#+)\s+(.+?)$', 2)}) > 10 and {rm('left(' + ex(_S, r'^(#+)\s+(.+?)$', 2) + ', length(' + ex(_S, r'^(#+)\s+(.+?)$', 2) + ') - 10)', r'\. [A-Z]')}) then {ex(_S, r'^(#+)\s+(.+?)$', 2)} else line end"),
    "heading_slug": (T.slug, rr(rr(rr(rr("lower(" + rr(st(rr(_S, r'<span id="page-\d+-\d+"></span>')), r"^#+\s*") + ")", r"\s+", "-"), r"[^a-z0-9-]"), r"-+", "-"), r"^-+|-+$")),
    "file_slug": (T.file_slug, f"list_transform([{rr(rr(f'lower({FREE})', r'[^\p{L}\p{N}$]+', '-'), r'^-+|-+$')}], lambda z: case when z = '' then 'section' when length(z) > 200 then {rr('left(z, 200)', r'^-+|-+$')} else z end)[1]"),
    "strip_links": (T.strip_links, FREE),
}
_CRUMB = st(rr(rr("line", r"[|" + "\\" + "[" + "\\" + "]()<>" + "\\\\" + r"\n\r\t]+", " "), r"\s+", " "))
RULES["breadcrumb_label"] = (T.crumb, f"list_transform([{_CRUMB}], lambda z: case when length(z) > 50 then {rr('left(z, 50)', r'\s+$')} || '…' else z end)[1]")

_HH = f"regexp_matches({_S}, '^#.')"
_LEVEL = f"length({ex(_S, r'^(#+)\s*(.+?)$')})"
_TEXT = ex(_S, r"^(#+)\s*(.+?)$", 2)
_G = f"g as (select *, {_HH} h, {_LEVEL} level, {st(_TEXT)} t, sum(({_HH})::int) {UPTO} grp from lines)"


def _case(when: str, to: str) -> str:
    return f"doc_id, line_no, case when {when} then {to} else line end line, coalesce({when}, false)::int changed"


_KEY = f"replace(lower({st(rr(rr(st(rr('t', r'\s+\d{1,4}\s*$')), r'^\d+(?:\.\d+)*\.?\s+'), r'\s+', ' '))}), 'ß', 'ss')"
_ATX = r"^(\s*)(#{1,6})\s+(\S.*?)\s*$"
_AT = ex("line", _ATX, 3)


def _listish(h: str, p: str) -> str:
    return f"g as (select *, {rm('line', h)} h, sum(({rm('line', h)})::int) {DOC} nh, sum(({rm('line', p)})::int) {DOC} np from lines) select {_case('h and np > nh', rr('line', h, r'\1\2'))} from g"


_FT = ex(_S, r"^(#{1,6})\s+(.+?)\s*$", 2)
_FB = st(rr("line", r'<span id="page-\d+-\d+"></span>'))
_EN = rm("t", r"\(\s*(?:step\s+)?\d+(?:\.\d+)?\s*\)\s*$", "i")

#: name -> (pass, corpus, SQL behind the corpus' common table expressions)
PASSES = {
    "front_matter": (H.demote_front_matter, "book", f"g as (select *, {_HH} h, {_LEVEL} level from lines), d as (select *, min(case when h and level = 1 then line_no end) {DOC} first, sum((h and level = 1)::int) {DOC} n1, sum(h::int) {DOC} n from g), e as (select *, sum((h and line_no < first)::int) {DOC} pre from d) select {_case('h and n1 >= 3 and pre > 0 and pre < n * 0.3 and line_no < first', demoted('line'))} from e"),
    "toc_outline": (H.demote_toc_outline, "book", f"{_G}, d as (select *, sum((not h and {rm('line', r'^\s*-\s+\d+\.\d+[a-z]?\s+\S.*?\d{1,4}\s*$')})::int) over (partition by doc_id, grp) toc, sum((h and level = 1)::int) {DOC} n1 from g) select {_case('h and n1 >= 3 and toc >= 2', demoted('line'))} from d"),
    "toc_phantom": (H.demote_toc_phantoms, "book", f"g as (select *, {_HH} h, {_TEXT} t from lines), k as (select *, {_KEY} key, {rm('t', r'\s+\d{1,4}\s*$')} page from g), w as (select *, max((h and not page and key <> '')::int) over (partition by doc_id, key) twin from k) select {_case(chr(104) + ' and page and key <> ' + chr(39) * 2 + ' and twin = 1', ex('line', r'^\s*', 0) + ' || t')} from w"),
    "empty_shell": (H.demote_empty_shells, "book", f"g as (select *, case when {rm('line', _ATX)} then length({ex('line', _ATX, 2)}) end level, {_S} s from lines), d as (select *, last_value(case when s <> '' then coalesce(level, 99) end ignore nulls) {AFTER} nxt from g) select {_case('level is not null and nxt <= level', rr('line', _ATX, r'\1\3'))} from d"),
    "recurring_scaffold": (H.demote_scaffold, "book", f"{_G}, z as (select *, sum(case when h then 0 else length({rr('line', r'\s+')}) end) over (partition by doc_id, grp) size from g), d as (select *, count(*) over (partition by doc_id, h, t) n, sum((size > 80)::int) over (partition by doc_id, h, t) real from z) select {_case('h and n >= 3 and (real = 0 or (real = 1 and size <= 80))', demoted('line', '#+'))} from d"),
    "bare_int": (H.demote_bare_int, "book", _listish(r"^(\s*)#{1,6}\s+(\d+\s+\S.*?)\s*$", r"^\s*\d+\s+\S")),
    "dotted_int": (H.demote_dotted_int, "book", _listish(r"^(\s*)#{1,6}\s+(\d+\.\s+\S.*?)\s*$", r"^\s*\d+\.\s+\S")),
    "orphan_fragments": (H.demote_fragments, "book", f"g as (select *, {rm(_S, r'^(#{1,6})\s+(.+?)\s*$')} h, length({ex(_S, r'^(#{1,6})\s+(.+?)\s*$')}) level, {st(rr(rr(_FT, r'<span id="page-\d+-\d+"></span>'), r'\s+', ' '))} t, {_FB} b from lines), d as (select *, max(case when h then level end) {DOC} deep, min(case when h then level end) {DOC} least_, sum(h::int) {UPTO} grp from g), e as (select *, max((b <> '' and not h and not {rm('b', r'^\s*!\[[^\]]*\]\([^)]+\)\s*$')} and {rm('b', r'[\p{L}\p{N}_]')})::int) over (partition by doc_id, grp) body, h and level = deep and (length(t) <= 3 or not {rm('t', r'[\p{L}\p{N}_]')}) frag from d), f as (select *, sum((h and not frag)::int) {UPTO} run from e), z as (select *, sum(frag::int) over (partition by doc_id, run) size from f) select {_case('frag and deep > least_ and body = 0 and size < 5', ex('line', r'^(\s*)#{1,6}\s+(.*)$') + ' || ' + st(ex('line', r'^(\s*)#{1,6}\s+(.*)$', 2)))} from z"),
    "span_strip": (R.strip_heading_spans, "noise", f"g as (select *, {_AT} t, {st(rr(_AT, r'</?span[^>]*>'))} c from lines) select {_case('t <> ' + chr(39) * 2 + ' and c <> ' + chr(39) * 2 + ' and c <> t', ex('line', _ATX, 1) + ' || ' + ex('line', _ATX, 2) + ' || chr(32) || c')} from g"),
    "number_only": (R.demote_number_only, "noise", f"g as (select *, {_AT} t from lines) select {_case(rm('t', r'^\d+$'), ex('line', _ATX, 1) + ' || t')} from g"),
    "doubled_text": (R.dedupe_doubled, "noise", f"g as (select *, {_AT} t from lines), d as (select *, list_filter(range(2, greatest(length(t) // 2 + 1, 2)), lambda n: length({st('substr(t, 1, n)')}) >= 2 and {rm('substr(t, n + 1)', r'^\s')} and {rr('substr(t, n + 1)', r'^\s+')} = substr(t, 1, n))[1] n from g) select {_case('n is not null', ex('line', _ATX, 1) + ' || ' + ex('line', _ATX, 2) + ' || chr(32) || substr(t, 1, n)')} from d"),
    "spaced_letters": (R.demote_spaced_letters, "noise", rf"g as (select *, {_AT} t, regexp_split_to_array({_AT}, '\s+') w from lines), d as (select *, len(list_filter(w, lambda x: length(x) = 1)) one from g) select {_case(chr(116) + ' <> ' + chr(39) * 2 + ' and one >= 4 and one / len(w) >= 0.6', ex('line', _ATX, 1) + ' || t')} from d"),
    "close_level_gaps": (R.close_level_gaps, "out", None),
    "enumerated_nest": (R.nest_enumerated, "noise", f"g as (select *, {rm('line', r'^(#{1,6})\s+(.*?)\s*$')} h, length({ex('line', r'^(#{1,6})\s+(.*?)\s*$')}) level, {ex('line', r'^(#{1,6})\s+(.*?)\s*$', 2)} t from lines), k as (select *, case when h and level = 1 then ({_EN})::int end kind from g), d as (select *, last_value(kind ignore nulls) {UPTO} state, max(case when kind = 0 then 1 end) {UPTO} seen from k) select {_case('h and level < 6 and state = 1 and seen = 1', chr(39) + '#' + chr(39) + ' || line')} from d"),
    "flat_h1_runs": (R.demote_flat_runs, "noise", f"g as (select *, {rm('line', r'^#{1,6}\s+\S')} h, {rm('line', r'^#\s+\S')} one from lines), r as (select *, sum((h and not one)::int) {UPTO} run from g), d as (select *, sum(one::int) over (partition by doc_id, run) size, sum(one::int) over (partition by doc_id, run order by line_no rows between unbounded preceding and current row) nth from r) select {_case('one and size >= 5 and nth > 1', chr(39) + '#' + chr(39) + ' || line')} from d"),
    "orphan_h1_rebalance": (R.rebalance_orphans, "noise", f"g as (select *, {rm('line', r'^#{1,6}\s+\S')} h, {rm('line', r'^#\s+\S')} one from lines), r as (select *, sum(one::int) {UPTO} grp from g), c as (select *, max((h and not one)::int) over (partition by doc_id, grp) child from r), o as (select *, one and grp > 1 and child = 0 orphan from c), d as (select *, sum(orphan::int) {DOC} n, sum(one::int) {DOC} ones from o) select {_case('orphan and ones >= 2 and floor(n * 100 / nullif(ones - 1, 0)) >= 70', chr(39) + '#' + chr(39) + ' || line')} from d"),
}

# Parents of the outline's headings by level, for the clamp: 1, 3, 5 become 1, 2, 3.
_GAP = f"""g as (select *, case when {rm('line', _ATX)} then length({ex('line', _ATX, 2)}) end level from lines),
p as (select *, {', '.join(f'max(case when level = {k} then line_no end) {BEFORE} p{k}' for k in range(1, 7))} from g),
c as (select *, list_filter([{', '.join('case when p%d is not null and %d < level%s then %d end' % (k, k, ''.join(f' and coalesce(p{k} > p{j}, true)' for j in range(1, k)), k) for k in range(1, 7))}], lambda x: x is not null) up from p),
nw as (select *, case len(up) when 0 then level when 1 then least(level, up[1] + 1) when 2 then least(level, least(up[2], up[1] + 1) + 1) else least(level, least(up[3], least(up[2], up[1] + 1) + 1) + 1) end new from c)
select {_case('level is not null and new <> level', ex('line', _ATX, 1) + " || repeat('#', new::int) || ' ' || " + _AT)} from nw"""
PASSES["close_level_gaps"] = (R.close_level_gaps, "out", _GAP)


def queries() -> dict:
    out = {}
    for name, (rule, _) in RULES.items():
        out[name] = lambda spark, d, rule=rule: spark_lines(spark, d, "noise").select("doc_id", "line_no", rule(F.col("line")).alias("line"))
    for name, (rule, corpus, _) in PASSES.items():
        out[name] = lambda spark, d, rule=rule, corpus=corpus: rule(spark_lines(spark, d, corpus))
    out["consecutive_dedupe"] = lambda spark, d: H.dedupe_consecutive(spark_lines(spark, d, "book"))
    out["fence_flags"] = lambda spark, d: L.fence_flags(spark_lines(spark, d, "book"))
    out["blank_run_squeeze"] = lambda spark, d: L.squeeze_blanks(spark_lines(spark, d, "book"))
    out["line_explode"] = lambda spark, d: spark_lines(spark, d, "raw").withColumn("n", F.length("line"))
    out["line_collect_roundtrip"] = lambda spark, d: L.collect_lines(spark_lines(spark, d, "raw")).withColumnRenamed("md", "text")
    out["cleanup_chain"] = lambda spark, d: H.heading_passes(spark_lines(spark, d, "book"))
    out["repair_chain"] = lambda spark, d: R.repair_headings(spark_lines(spark, d, "noise"))
    return out


def _chain_sql() -> str:
    """The heading passes as nested common table expressions."""
    parts, at = [duck("book").replace("lines as (", "l0 as (", 1)], 0
    rules = [RULES["lock_depth"][1], RULES["heading_emphasis"][1], RULES["prose_demote"][1]]
    for r in rules:
        parts.append(f"l{at + 1} as (select doc_id, line_no, {r} line from l{at})")
        at += 1
    for name in ("front_matter", "toc_outline", "toc_phantom", "empty_shell", "recurring_scaffold", "bare_int", "dotted_int", "orphan_fragments"):
        body = PASSES[name][2].replace("from lines", f"from l{at}")
        parts.append(f"l{at + 1} as (with {body})")
        at += 1
    return f"with {', '.join(parts)} select doc_id, line_no, line from l{at}"


def oracle_sql() -> dict[str, str]:
    out = {name: f"with {duck('noise')} select doc_id, line_no, {sql} line from lines" for name, (_, sql) in RULES.items()}
    out |= {name: f"with {duck(corpus)}, {sql}" for name, (_, corpus, sql) in PASSES.items()}
    out["consecutive_dedupe"] = f"with {duck('book')}, a as (select *, {_S} s from lines), b as (select *, last_value(case when s <> '' then s end ignore nulls) {BEFORE} prev from a), c as (select *, s like '#%' and coalesce(s = prev, false) gone from b), d as (select *, last_value(case when s <> '' then gone end ignore nulls) {AFTER} ng from c) select doc_id, line_no, line from d where not gone and not (s = '' and coalesce(ng, false))"
    out["fence_flags"] = f"with {duck('book')}, a as (select *, ({rm(_S, '^(```|~~~)')})::int m from lines) select doc_id, line_no, line, greatest(m, (sum(m) {UPTO}) % 2)::int fenced from a"
    out["blank_run_squeeze"] = f"with {duck('book')}, a as (select *, {_S} = '' b, lag({_S} = '') over ({W}) p from lines) select doc_id, line_no, line from a where not (b and coalesce(p, false))"
    out["line_explode"] = f"with {duck('raw')} select doc_id, line_no, line, length(line)::int n from lines"
    out["line_collect_roundtrip"] = "select doc_id, text from documents"
    out["cleanup_chain"] = _chain_sql()
    return out
