"""Queries of references and what they point to, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import refs as R
from ..operators import links as K
from ..operators import tables
from .fixtures import duck, spark_lines
from .passes import UPTO, ex, rm, rr, st

#: Texts with references of every kind; both engines run it.
FIG = """select doc_id, text || chr(10) || chr(10) || '![Photo of ' || source || ' number ' || cast(doc_id % 7 as string) || '](images/p' || cast(doc_id % 7 as string) || '.png) next ![](media/d' || cast(doc_id % 5 as string) || '.jpg) and ![x](https://e.example/s/images/u/' || cast(doc_id % 3 as string) || '.png) again ![y](https://e.example/s/images/u/' || cast(doc_id % 3 as string) || '.png), ![z](http://e.example/a/b/c.pdf)' || chr(10) || chr(10) || '![](data:image/png;base64...)' || chr(10) || chr(10) || 'See [part](#page-' || cast(doc_id % 4 as string) || '-1) <span id="page-' || cast(doc_id % 4 as string) || '-1"></span> <!-- image --> then <!-- image --> and ![a](my%20fig.png) and ![ old one ](<gone.png>)' md from documents"""
CAPTIONS = "select doc_id, 'p' || cast(doc_id % 7 as string) || '.png' basename, 'A [map] of ' || source caption, case when doc_id % 2 = 0 then 'graph TD; A-->B' end mermaid from documents where doc_id % 3 <> 0 union all select doc_id, 'unused.png', 'never', 'x' from documents"
FILES = "select doc_id, 'images/p' || cast(doc_id % 7 as string) || '.png' path from documents where doc_id % 2 = 0 union all select doc_id, 'my fig.png' from documents where doc_id % 3 = 0"
#: Hashes that differ in a few bits within a group, and in many between groups.
HASHES = "select l_orderkey doc_id, 'i' || cast(l_partkey as string) || '-' || cast(l_linenumber as string) || '.png' basename, (l_linenumber % 2) * 1311768467294899695 + (l_partkey % 3) * 1024 + (l_linenumber % 3) * 5 phash from lineitem"
_FIGURES = "select conv_id doc_id, turn page, 'f' || cast(turn as string) || role figure from conversations"
_MARKERS = "select conv_id doc_id, turn page, cast(turn * 7 % 5 as double) top, turn * 10 + case when role = 'user' then 1 else 2 end question from conversations where turn % 2 = 1"
_CACHE = "select phash, 'c' || cast(min(basename) as string) caption from (HASHES) h where phash % 3 = 0 group by phash".replace("HASHES", HASHES)


def _sql(text: str, *tables: str):
    for t in tables:
        text = text.replace(f"from {t}", f"from {{{t}}}")
    return lambda s, d: s.sql(text, **{t: s.read.parquet(f"{d}/{t}.parquet") for t in tables})


_fig, _captions, _files, _hashes = _sql(FIG, "documents"), _sql(CAPTIONS, "documents"), _sql(FILES, "documents"), _sql(HASHES, "lineitem")


def _col(name: str, f):
    return lambda s, d: _fig(s, d).select("doc_id", f(F.col("md")).alias(name))


def _urls(s, d):
    return s.sql("select page_id, url from {p}", p=s.read.parquet(f"{d}/pages.parquet"))


_RANGE = "case when p_size % 3 = 0 then cast(p_size as string) || '-' || cast(p_size + 3 as string) || ', ' || cast(p_size % 7 as string) when p_size % 3 = 1 then cast(p_size as string) || ',,' || cast(p_size as string) else '' end"


def queries() -> dict:
    page_range = lambda s, d: s.sql(f"select p_partkey, {_RANGE} spec from {{p}}", p=s.read.parquet(f"{d}/part.parquet"))
    return {
        "image_refs": lambda s, d: K.image_refs(_fig(s, d)),
        "alt_by_basename": lambda s, d: K.alt_by_basename(_fig(s, d)),
        "inject_captions": lambda s, d: K.inject_captions(_fig(s, d), _captions(s, d)),
        "inject_captions_keep_alt": lambda s, d: K.inject_captions(_fig(s, d), _captions(s, d), keep_alt=True),
        "missing_image_refs": lambda s, d: K.degrade_missing_images(_fig(s, d), _files(s, d)),
        "retarget_images": lambda s, d: K.retarget_images(_fig(s, d), s.sql("select doc_id, concat('d', cast(doc_id % 5 as string), '.jpg') name from {t} where doc_id % 2 = 1", t=s.read.parquet(f"{d}/documents.parquet"))),
        "append_image_refs": lambda s, d: K.retarget_images(s.sql("select doc_id, text md from {t}", t=s.read.parquet(f"{d}/documents.parquet")), s.sql("select doc_id, explode(array('b.png', 'a.png')) name from {t} where doc_id % 2 = 1", t=s.read.parquet(f"{d}/documents.parquet"))),
        "prefix_image_basenames": _col("md", lambda c: R.prefix_images(c, F.lit("50-99"))),
        "absolute_page_anchors": _col("md", lambda c: R.absolute_pages(c, F.col("doc_id") % 9)),
        "fill_placeholders": _col("md", lambda c: R.fill_placeholders(c, F.slice(F.array(F.lit("![](1.png)"), F.lit("![](2.png)"), F.lit("![](3.png)"), F.lit("![](4.png)")), 1, (F.col("doc_id") % 5).cast("int")))),
        "drop_dead_images": _col("md", R.drop_dead_images),
        "download_targets": _col("urls", lambda c: F.array_join(R.download_targets(c), " ")),
        "local_image_names": lambda s, d: _urls(s, d).select("page_id", R.local_name(F.col("url")).alias("name"), R.is_image_url(F.col("url")).alias("image")),
        "page_ranges": lambda s, d: page_range(s, d).select("p_partkey", F.array_join(R.parse_page_range(F.col("spec")).cast("array<string>"), " ").alias("pages"), R.one_based_range(F.col("spec"))[0].alias("first"), R.one_based_range(F.col("spec"))[1].alias("last")),
        "blocked_addresses": lambda s, d: s.sql("select p_partkey, concat(cast(p_partkey % 260 as string), '.', cast(p_size % 256 as string), '.', cast(p_partkey * 7 % 256 as string), case when p_partkey % 50 = 0 then '' else '.9' end) a from {p}", p=s.read.parquet(f"{d}/part.parquet")).select("p_partkey", R.address_is_blocked(F.col("a")).alias("blocked")),
        "image_suffixes": lambda s, d: s.sql("select p_partkey, unhex(case p_partkey % 7 when 0 then '89504E470D0A1A0A00' when 1 then 'FFD8FFE000' when 2 then '474946383961' when 3 then '524946460000000057454250' when 4 then hex('  <SVG x>') when 5 then '00FF' else '' end) b from {p}", p=s.read.parquet(f"{d}/part.parquet")).select("p_partkey", R.image_suffix(F.col("b")).alias("suffix")),
        "anchor_map": lambda s, d: K.anchor_map(spark_lines(s, d, "noise")),
        "remap_page_refs": lambda s, d: K.remap_page_refs(spark_lines(s, d, "noise")),
        "figure_page_asof": lambda s, d: K.figures_by_page(_sql(_FIGURES, "conversations")(s, d), _sql(_MARKERS, "conversations")(s, d)),
        "cache_hits_misses": lambda s, d: K.cache_lookup(_hashes(s, d), s.sql(_CACHE.replace("from lineitem", "from {l}"), l=s.read.parquet(f"{d}/lineitem.parquet"))),
        "decoration_clusters": lambda s, d: K.decorations(_hashes(s, d), 2),
        "strip_decorations": lambda s, d: K.strip_decorations(_fig(s, d), s.sql("select doc_id, concat('p', cast(doc_id % 7 as string), '.png') basename from {t} where doc_id % 2 = 0", t=s.read.parquet(f"{d}/documents.parquet"))),
        "lines_in_tables": lambda s, d: K.lines_in_tables(spark_lines(s, d, "tab"), tables.table_blocks(spark_lines(s, d, "tab"))),
    }


def _seg(md: str, pattern: str) -> str:
    return f"string_split(regexp_replace({md}, '({pattern})', chr(1) || chr(2) || '\\1' || chr(1), 'g'), chr(1))"


def _rewrite(md: str, pattern: str, rule: str) -> str:
    """``rule`` is SQL over x, a match."""
    return f"array_to_string(list_transform({_seg(md, pattern)}, lambda s: case when starts_with(s, chr(2)) then list_transform([substr(s, 2)], lambda x: {rule})[1] else s end), '')"


_ALT, _TO = ex("x", r"^!\[([^\]]*)\]\(([^)]+)\)$", 1, "s"), ex("x", r"^!\[([^\]]*)\]\(([^)]+)\)$", 2, "s")
_BASE = lambda c: ex(c, "([^/]*)$")
_LABEL, _ANCHOR = ex("x", r"^\[([^\]]+)\]\(#([^)]+)\)$", 1, "s"), ex("x", r"^\[([^\]]+)\]\(#([^)]+)\)$", 2, "s")
_REFS = f"fig as ({FIG}), r0 as (select doc_id, unnest(regexp_extract_all(md, '{R.IMAGE}')) x, unnest(range(len(regexp_extract_all(md, '{R.IMAGE}')))) pos from fig), refs as (select doc_id, pos::int pos, {_ALT} alt, {_TO} target, {_BASE(_TO)} basename from r0)"
_MAP = "map_from_entries(list(struct_pack(k := {k}, v := {v})))"


def _inject(own: str) -> str:
    d = f"known[{_BASE(_TO)}]"
    rule = f"case when known is null or {d} is null then x when coalesce({d}.mermaid, '') <> '' then {own} || chr(10) || chr(10) || '```mermaid image=\"' || {_TO} || '\"' || chr(10) || {d}.mermaid || chr(10) || '```' else {own} end"
    return f"with fig as ({FIG}), cap as ({CAPTIONS}), m as (select doc_id, {_MAP.format(k='basename', v='struct_pack(caption := caption, mermaid := mermaid)')} known from cap group by 1) select doc_id, {_rewrite('md', R.IMAGE, rule)} md from fig left join m using (doc_id)"


_SLUG = rr(rr(rr(rr(f"lower({rr(st(rr(st('line'), '<span id=\"page-\\d+-\\d+\"></span>')), r'^#+\s*')})", r"\s+", "-"), "[^a-z0-9-]"), "-+", "-"), "^-+|-+$")
_BARE = st(rr(st("line"), r'<span id="page-\d+-\d+"></span>'))
_ANCHORS = f"""a0 as (select doc_id, line_no, regexp_extract_all(line, '{K.ANCHOR_SPAN}', 1) anchors, case when ({_BARE} like '#%' or {rm(_BARE, r'^\s*(\d+(?:\.\d+)*\.)\s+(.+?)\s*$')}) and {_SLUG} <> '' then {_SLUG} end s from lines),
a1 as (select *, last_value(s ignore nulls) over (partition by doc_id order by line_no desc rows between unbounded preceding and current row) slug from a0),
a2 as (select doc_id, line_no, slug, unnest(anchors) anchor, unnest(range(len(anchors))) p from a1 where slug is not null and len(anchors) > 0), anchors as (select doc_id, anchor, arg_max(slug, (line_no, p)) slug from a2 group by 1, 2)"""


def oracle_sql() -> dict[str, str]:
    strip_rule = f"case when coalesce(b = {_BASE(_TO)}, false) then '' else x end"
    target = f"(case when {st(_TO)} like '<%>' then {st(f'substr({st(_TO)}, 2, length({st(_TO)}) - 2)')} else {st(_TO)} end)"
    have = f"(coalesce(list_contains(paths, {target}), false) or coalesce(list_contains(paths, url_decode({target})), false))"
    gone = f"not ({rm(target, '^(https?://|data:)')} or {target} = '' or {have})"
    ip = [f"try_cast(string_split(a, '.')[{i}] as int)" for i in (1, 2, 3, 4)]
    return {
        "image_refs": f"with {_REFS} select * from refs",
        "alt_by_basename": f"with {_REFS} select doc_id, basename, arg_min(alt, pos) alt from refs group by 1, 2",
        "inject_captions": _inject(f"'![' || trim(replace(replace(replace({f'known[{_BASE(_TO)}]'}.caption, '[', '('), ']', ')'), chr(10), ' ')) || '](' || {_TO} || ')'"),
        "inject_captions_keep_alt": _inject("x"),
        "missing_image_refs": f"with fig as ({FIG}), fl as ({FILES}), p as (select doc_id, list(path) paths from fl group by 1) select doc_id, {_rewrite('md', R.IMAGE, f'case when not ({gone}) then x when trim({_ALT}) = {chr(39) * 2} then {chr(39) * 2} else {chr(39)}_{chr(39)} || trim({_ALT}) || {chr(39)}_{chr(39)} end')} md, len(list_filter(regexp_extract_all(md, '{R.IMAGE}'), lambda x: {gone}))::int degraded from fig left join p using (doc_id)",
        "retarget_images": f"with fig as ({FIG}) select doc_id, {_rewrite('md', R.IMAGE, f'case when doc_id % 2 = 1 and {_BASE(_TO)} = {chr(39)}d{chr(39)} || doc_id % 5 || {chr(39)}.jpg{chr(39)} then {chr(39)}![{chr(39)} || {_ALT} || {chr(39)}](images/{chr(39)} || {_BASE(_TO)} || {chr(39)}){chr(39)} else x end')} md from fig",
        "append_image_refs": "select doc_id, case when doc_id % 2 = 1 and not (contains(text, '![') and contains(text, '](')) then text || chr(10) || chr(10) || '## Extracted Images' || chr(10) || chr(10) || '![a.png](images/a.png)' || chr(10) || chr(10) || '![b.png](images/b.png)' || chr(10) else text end md from documents",
        "prefix_image_basenames": f"with fig as ({FIG}) select doc_id, {_rewrite('md', R.IMAGE, f'case when {_TO} like {chr(39)}images/%{chr(39)} then replace(x, {chr(39)}images/{chr(39)}, {chr(39)}images/50-99-{chr(39)}) else x end')} md from fig",
        "absolute_page_anchors": f"with fig as ({FIG}) select doc_id, {_rewrite('md', R.PAGE_MARK, f'{ex(chr(120), chr(94) + r"(.*page-)\d+")} || ({ex(chr(120), r"page-(\d+)-")}::bigint + doc_id % 9) || {ex(chr(120), r"page-\d+(-.*)$")}')} md from fig",
        "fill_placeholders": f"with fig as ({FIG}), p as (select doc_id, string_split(md, '{R.PLACEHOLDER}') ps from fig) select doc_id, array_to_string(list_transform(ps, lambda x, i: x || case when i <= doc_id % 5 and i <= 4 then '![](' || i || '.png)' else '' end), '') md from p",
        "drop_dead_images": f"with fig as ({FIG}) select doc_id, {rr(f'array_to_string(list_filter(string_split(md, chr(10)), lambda x: not {rm(chr(120), R.DEAD_IMAGE)}), chr(10))', r'\n{3,}', '__').replace(chr(39) + '__' + chr(39), 'chr(10) || chr(10)')} md from fig",
        "download_targets": f"with fig as ({FIG}), u as (select doc_id, unnest(regexp_extract_all(md, '!\\[[^\\]]*\\]\\((https?://[^)\\s]+)\\)', 1)) u, unnest(range(len(regexp_extract_all(md, '!\\[[^\\]]*\\]\\((https?://[^)\\s]+)\\)', 1)))) i from fig), f as (select doc_id, u, min(i) i from u where regexp_matches(lower(u), '\\.(png|jpg|jpeg|gif|svg|webp)$') or not regexp_matches(u, '/[^/.][^/]*\\.[^/.]+/*$') group by 1, 2) select doc_id, coalesce(string_agg(u, ' ' order by i), '') urls from fig left join f using (doc_id) group by 1",
        "local_image_names": f"with a as (select page_id, url, list_filter(string_split({ex('url', r'^[a-z]+://[^/?#]*([^?#]*)')}, '/'), lambda p: p <> '' and p <> '.') ps, lower({ex(rr(ex('url', r'^[a-z]+://[^/?#]*([^?#]*)'), '/+$'), r'[^/.][^/]*(\.[^./]+)$')}) sfx from pages) select page_id, array_to_string(case when list_position(ps, 'images') > 0 then ps[list_position(ps, 'images') + 1:] when len(ps) >= 2 then ps[-2:] else ps end, '-') name, sfx = '' or sfx in {R.IMAGE_SUFFIXES} image from a",
        "page_ranges": "with a as (select p_partkey, list_sort(list_distinct(case p_size % 3 when 0 then list_concat(range(p_size, p_size + 4), [(p_size % 7)::bigint]) when 1 then [p_size::bigint] else [] end)) pages from part) select p_partkey, array_to_string(pages, ' ') pages, (list_min(pages) + 1)::int \"first\", (list_max(pages) + 1)::int \"last\" from a",
        "blocked_addresses": f"with q as (select p_partkey, (p_partkey % 260) || '.' || (p_size % 256) || '.' || (p_partkey * 7 % 256) || case when p_partkey % 50 = 0 then '' else '.9' end a from part), w as (select p_partkey, {', '.join(f'{x} b{i}' for i, x in enumerate(ip))} from q) select p_partkey, coalesce(b0 in (0, 10, 127) or b0 >= 224 or b3 is null or b0 = 172 and b1 between 16 and 31 or b0 = 192 and b1 = 168 or b0 = 169 and b1 = 254 or b0 = 192 and b1 = 0 and b2 in (0, 2) or b0 = 198 and b1 in (18, 19) or b0 = 198 and b1 = 51 and b2 = 100 or b0 = 203 and b1 = 0 and b2 = 113, true) blocked from w",
        "image_suffixes": "select p_partkey, case p_partkey % 7 when 1 then '.jpg' when 2 then '.gif' when 3 then '.webp' when 4 then '.svg' else '.png' end suffix from part",
        "anchor_map": f"with {duck('noise')}, {_ANCHORS} select * from anchors",
        "remap_page_refs": f"with {duck('noise')}, {_ANCHORS}, m as (select doc_id, map_from_entries(list(struct_pack(k := anchor, v := slug))) known from anchors group by 1) select doc_id, line_no, {_rewrite('line', R.PAGE_LINK, f'case when known is null or known[{_ANCHOR}] is null then {_LABEL} else {chr(39)}[{chr(39)} || {_LABEL} || {chr(39)}](#{chr(39)} || known[{_ANCHOR}] || {chr(39)}){chr(39)} end')} line from lines left join m using (doc_id)",
        "figure_page_asof": f"with f as ({_FIGURES}), m as ({_MARKERS}), x as (select f.doc_id, f.figure, f.page, arg_max(m.question, (m.page, -m.top, m.question)) question from f left join m on m.doc_id = f.doc_id and m.page <= f.page group by all) select doc_id, figure, question::int question from x",
        "cache_hits_misses": f"with h as ({HASHES}), c as ({_CACHE}) select doc_id, basename, h.phash, c.phash is not null hit, caption from h left join c using (phash)",
        "decoration_clusters": f"with recursive h as ({HASHES}), u as (select distinct doc_id, phash from h), near as (select a.doc_id, a.phash, b.phash o from u a join u b on a.doc_id = b.doc_id and bit_count(xor(a.phash, b.phash)) <= {K.HAMMING}), reach as (select * from near union select r.doc_id, r.phash, n.o from reach r join near n on n.doc_id = r.doc_id and n.phash = r.o), c as (select doc_id, phash, min(o) cluster from reach group by 1, 2), k as (select h.doc_id, basename, cluster, count(*) over (partition by h.doc_id, cluster) n from h join c using (doc_id, phash)) select doc_id, basename, cluster from k where n >= 2",
        "strip_decorations": f"with fig as ({FIG}), d as (select *, case when doc_id % 2 = 0 then 'p' || doc_id % 7 || '.png' end b from fig) select doc_id, case when b is null then md else {rr(_rewrite('md', R.IMAGE, strip_rule), r'\n{3,}', '__').replace(chr(39) + '__' + chr(39), 'chr(10) || chr(10)')} end md from d",
        "lines_in_tables": f"with {duck('tab')}, a as (select *, {st('line')} like '|%' t from lines), b as (select *, sum((not t)::int) {UPTO} block from a) select doc_id, line_no, min(line_no) over (partition by doc_id, block) first_line from b where t",
    }
