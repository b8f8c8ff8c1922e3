"""Structured corpora made from the plain tables by SQL that both engines run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

RAW_SPARK = "select doc_id, cast(p as bigint) line_no, line from {documents} lateral view posexplode(split(text, '\\\\n')) e as p, line"
RAW_DUCK = "select doc_id, unnest(range(len(string_split(text, chr(10)))))::bigint line_no, unnest(string_split(text, chr(10))) line from documents"

NOISE = """select doc_id, line_no, case
 when line_no % 5 <> 0 then case when (doc_id+line_no) % 11 = 1 then line || ' T3 &lt; 34F &amp; ****bold****'
                                 when (doc_id+line_no) % 11 = 2 then '- a. ' || line
                                 when (doc_id+line_no) % 11 = 3 then 'See [x](#page-' || cast(line_no as string) || '-1) and <b>y</b> a~_b'
                                 when (doc_id+line_no) % 11 = 4 then '<span id="page-' || cast(line_no as string) || '-2"></span>'
                                 when (doc_id+line_no) % 11 = 5 then 'Se[e Part](#page-3-4) of ' || line
                                 when (doc_id+line_no) % 11 = 6 then '<td class="" >' || line || '</td> � �'
                                 when (doc_id+line_no) % 11 = 7 and line_no % 3 = 0 then '```' else line end
 when (doc_id+line_no) % 13 = 0 then '# ' || cast(700+line_no as string)
 when (doc_id+line_no) % 13 = 1 then '## Summary Part Summary Part'
 when (doc_id+line_no) % 13 = 2 then '# S K E L E T O N'
 when (doc_id+line_no) % 13 = 3 then '## In This Chapter'
 when (doc_id+line_no) % 13 = 4 then '#### ' || cast(1+line_no%7 as string) || '.' || cast(1+doc_id%5 as string) || ' Section'
 when (doc_id+line_no) % 13 = 5 then '#### Chapter ' || cast(1+line_no%9 as string) || ' Basics'
 when (doc_id+line_no) % 13 = 6 then '### Basics 31'
 when (doc_id+line_no) % 13 = 7 then '### Figure 3.1 A caption'
 when (doc_id+line_no) % 13 = 8 then '# Connect (Step ' || cast(1+line_no%4 as string) || ')'
 when (doc_id+line_no) % 13 = 9 then '## **Bold** title'
 when (doc_id+line_no) % 13 = 10 then cast(1+line_no%3 as string) || '.' || cast(1+doc_id%4 as string) || '. Promoted title'
 when (doc_id+line_no) % 13 = 11 then '## <span id="page-9-' || cast(line_no as string) || '"></span>Anchored [part](#page-9-1)'
 else repeat('#', cast(1+(doc_id*7+line_no*3)%4 as int)) || ' ' || line end line
from raw"""

OUT = """select cast(doc_id as bigint) doc_id, row_number() over (partition by doc_id order by a,b,c)-1 line_no, line from (
 select r_regionkey doc_id, 0 a, 0 b, 0 c, '# ' || cast(r_regionkey+1 as string) || '. ' || r_name line from region
 union all select r_regionkey, 0,0,1, 'Region ' || r_name || ' overview paragraph for the structural corpus.' from region
 union all select r, j,0,0, '### ' || cast(r+1 as string) || '.' || cast(j as string) || '. ' || n_name from n
 union all select r, j,0,1, 'Nation ' || n_name || ' has its own body text of reasonable length.' from n
 union all select n.r, n.j, s.i, 0, '##### ' || s.s_name from n join s on s.s_nationkey=n.k
 union all select n.r, n.j, s.i, 1, 'Supplier ' || s.s_name || ' see [' || n.n_name || '](#' || lower(n.n_name) || ').' from n join s on s.s_nationkey=n.k) x"""
OUT_WITH = """n as (select n_nationkey k, n_name, n_regionkey r, row_number() over (partition by n_regionkey order by n_nationkey) j from nation),
s as (select s_suppkey, s_name, s_nationkey, row_number() over (partition by s_nationkey order by s_suppkey) i from supplier)"""

TAB = """select cast(doc_id as bigint) doc_id, row_number() over (partition by doc_id order by a,b,line)-1 line_no, line from (
 select distinct doc_id, 0 a, 0 b, '| A title of the table' || case when doc_id % 2 = 0 then ' | |' else ' |' end line from l where doc_id % 5 = 0
 union all select distinct doc_id, 0, 1, '|:--|' line from l where doc_id % 5 = 0
 union all select distinct doc_id, 1, 0, '| Flag | Status | Qty | |' line from l
 union all select distinct doc_id, 2, 0, '|---|---|---|' from l where doc_id % 3 <> 0
 union all select doc_id, 3, i, '| ' || f || ' | ' || st || case when (doc_id+i) % 4 = 0 then ' |' when (doc_id+i) % 17 = 3 then ' | ' || q else ' | ' || q || ' |' end from l
 union all select doc_id, 3, 10 + i, '| key' || q || ': | value: a' || q || ' |' from l where doc_id % 6 = 1
 union all select doc_id, 3, 30 + i, '| more' || q || ': | z |' from l where doc_id % 6 = 1
 union all select distinct doc_id, 3, 20, '| first: second: third | word: more text |' from l where doc_id % 6 = 1
 union all select doc_id, 4, 0, '| ' || repeat('Spec: value<br>', 32) || 'end |' from l where doc_id % 50 = 1 and i = 1
 union all select distinct doc_id, 5, 0, '' from l
 union all select doc_id, 6, i, '| | wrapped ' || q || ' |' from l where doc_id % 9 = 2) x"""
TAB_WITH = "l as (select l_orderkey doc_id, l_linenumber i, l_returnflag f, l_linestatus st, cast(cast(l_quantity as bigint) as string) q from lineitem)"

_LONG = "'This body text of the section is long enough to be more than a stub, with more than eighty characters that are no white space at all.'"
BOOK = f"""select cast(doc_id as bigint) doc_id, row_number() over (partition by doc_id order by a, b, c)-1 line_no, line from (
 select s_suppkey doc_id, 0 a, 0 b, 0 c, '## ' || s_name || ' Manual' line from supplier
 union all select s_suppkey, 0, 0, 1, 'Copyright notice of the publisher.' from supplier
 union all select k, 1, i, 0, '# Chapter ' || cast(i as string) from ch
 union all select k, 1, i, 1, '- ' || cast(i as string) || '.1 Intro topic ' || cast(10*i as string) from ch
 union all select k, 1, i, 2, '- ' || cast(i as string) || '.2 Next topic ' || cast(10*i+5 as string) from ch
 union all select k, 2, i, 0, '## ' || cast(i as string) || '.1 Introduction ' || cast(10*i as string) from ch
 union all select k, 3, i, 0, '#### Chapter ' || cast(i as string) from ch
 union all select k, 3, i, 1, '# Working with ' || nm from ch
 union all select k, 3, i, 2, '## ' || cast(i as string) || '.1 Introduction' from ch
 union all select k, 3, i, 3, {_LONG} from ch
 union all select k, 3, i, 4, '### In This Chapter' from ch
 union all select k, 3, i, 5, 'short' from ch
 union all select k, 3, i, 6, '### Specifications' from ch
 union all select k, 3, i, 7, {_LONG} from ch
 union all select k, 3, i, 8, '##### EN' from ch
 union all select k, 3, i, 9, '' from ch
 union all select k, 3, i, 10, '### 3 Press the button' from ch
 union all select k, 3, i, 11, '1 Do this' from ch
 union all select k, 3, i, 12, '2 Do that' from ch
 union all select k, 3, i, 13, '#### 2. Click it' from ch
 union all select k, 3, i, 14, '1. First' from ch
 union all select k, 3, i, 15, '2. Second' from ch
 union all select k, 3, i, 16, '```' from ch where i = 2
 union all select k, 3, i, 17, '# not a heading' from ch where i = 2
 union all select k, 3, i, 18, '```' from ch where i = 2
 union all select k, 4, i, 0, '## Same' from ch where i < 3
 union all select k, 4, i, 1, '' from ch where i < 3) x"""
BOOK_WITH = "ch as (select s_suppkey n_nationkey, s_suppkey k, s_name nm, r_regionkey + 1 i from supplier cross join region)"

#: Sections that refer to each other by anchors of which several are equal, a list of links above the sections, an entry of a contents page with a child, and a heading above the split's depth.
LINKS = """select cast(doc_id as bigint) doc_id, row_number() over (partition by doc_id order by a, b, c)-1 line_no, line from (
 select c_nationkey doc_id, 0 a, 0 b, 0 c, '# Handbook [of](x.md) nation | ' || cast(c_nationkey as string) line from cu
 union all select c_nationkey, 0, 0, 1, 'An opening paragraph that is long enough to be kept.' from cu
 union all select c_nationkey, 0, 0, 2, '## Contents' from cu
 union all select c_nationkey, 0, 0, 3 + i, '- [' || c_name || '](#' || lower(c_name) || ')' from cu
 union all select c_nationkey, 1, i, 0, '### ' || c_name from cu
 union all select c_nationkey, 1, i, 1, '<span id="page-' || cast(i as string) || '-1"></span>' from cu
 union all select c_nationkey, 1, i, 2, 'Account of ' || c_name || ', see [the notes](#notes) and [no place](#nowhere) there.' from cu
 union all select c_nationkey, 1, i, 3, '#### Notes' from cu where i % 3 <> 2
 union all select c_nationkey, 1, i, 4, 'Notes on number ' || cast(i as string) || ' with [its account](#' || lower(c_name) || ').' from cu where i % 3 <> 2
 union all select c_nationkey, 1, i, 5, '#### 1.1 Intro ' || cast(30 + i as string) from cu where i % 4 = 1
 union all select c_nationkey, 1, i, 6, '##### Child of an entry' from cu where i % 4 = 1
 union all select c_nationkey, 1, i, 7, 'The text of a child whose parent is an entry of contents.' from cu where i % 4 = 1
 union all select c_nationkey, 1, i, 8, '#### 2.' || cast(i as string) || ' Numbered [part](#notes) of it' from cu where i % 4 = 2
 union all select c_nationkey, 1, i, 9, 'A numbered part has a text of its own here.' from cu where i % 4 = 2
 union all select c_nationkey, 1, i, 10, '' from cu) x"""
LINKS_WITH = "cu as (select c_nationkey, c_name, row_number() over (partition by c_nationkey order by c_custkey) i from customer)"

#: Files of sections: with and without a text below their front matter, crumb and anchors.
SHELLS = """select cast(doc_id as bigint) doc_id, cast(line_no as bigint) line_no, line from (
 select p_partkey doc_id, 0 line_no, '---' line from part where p_partkey % 2 = 0
 union all select p_partkey, 1, 'title: "' || p_name || '"' from part where p_partkey % 2 = 0
 union all select p_partkey, 2, '---' from part where p_partkey % 2 = 0
 union all select p_partkey, 3, '# ' || p_name from part
 union all select p_partkey, 4, '<span id="page-' || cast(p_partkey as string) || '-1"></span>' from part where p_partkey % 3 = 0
 union all select p_partkey, 5, '> ↑ [Parts](parts.md)' from part
 union all select p_partkey, 6, p_brand || ' ' || p_type from part where p_partkey % 5 < 2
 union all select p_partkey, 7, '## Subsections' from part where p_partkey % 5 = 2) x"""

#: Numbered lists as a word processor's outline leaves them: indents, stacked bullets, headings and blanks between.
OUTL = """select cast(l_orderkey as bigint) doc_id, row_number() over (partition by l_orderkey order by l_linenumber, p, line) - 1 line_no, line from (
 select l_orderkey, l_linenumber, 0 p, case when l_orderkey % 5 = 1 and l_linenumber = 1 then '* + ' else '' end || repeat('  ', cast((l_linenumber * (1 + l_orderkey % 3)) % 4 as int)) || cast(l_linenumber as string) || '. ' || l_returnflag || ' item' line from l
 union all select l_orderkey, l_linenumber, 1, repeat(' ', cast(l_linenumber % 3 as int)) || '1. ' || l_linestatus from l where l_orderkey % 2 = 0
 union all select l_orderkey, l_linenumber, 2, 'plain text' from l where l_linenumber = 2
 union all select l_orderkey, l_linenumber, 3, '' from l where l_linenumber % 3 = 0
 union all select l_orderkey, l_linenumber, 4, '## Heading' from l where l_orderkey % 4 = 3 and l_linenumber = 2
 union all select l_orderkey, l_linenumber, 5, '1. again' from l) x"""
OUTL_WITH = "l as (select l_orderkey, l_linenumber, l_returnflag, l_linestatus from lineitem)"
#: A book with a contents heading, sometimes without anything behind it.
TOCS = """select cast(doc_id as bigint) doc_id, row_number() over (partition by doc_id order by i, p) - 1 line_no, line from (
 select c_nationkey doc_id, 0 i, 0 p, '# Before' line from k where i = 1
 union all select c_nationkey, 0, 1, '## table of contents' from k where i = 1 and c_nationkey % 5 <> 4
 union all select c_nationkey, 0, 2 + i, '| ' || c_name || ' | 12 |' from k
 union all select c_nationkey, i, 1000, repeat('#', cast(2 + i % 4 as int)) || ' ' || c_name || case when i % 3 = 0 then '**' else '' end from k where c_nationkey % 7 <> 6
 union all select c_nationkey, i, 1001, 'text' from k where c_nationkey % 7 <> 6
 union all select c_nationkey, i, 1002, '### 漢字' from k where i = 2 and c_nationkey % 7 <> 6) x"""
TOCS_WITH = "k as (select c_nationkey, c_name, row_number() over (partition by c_nationkey order by c_custkey) i from customer)"

_SOURCES = {"noise": (NOISE, "", ("documents",)), "out": (OUT, OUT_WITH, ("region", "nation", "supplier")), "tab": (TAB, TAB_WITH, ("lineitem",)), "book": (BOOK, BOOK_WITH, ("supplier", "region")), "outl": (OUTL, OUTL_WITH, ("lineitem",)), "toc": (TOCS, TOCS_WITH, ("customer",)), "shells": (SHELLS, "", ("part",)), "links": (LINKS, LINKS_WITH, ("customer",))}


def duck(name: str) -> str:
    """The corpus as common table expressions for DuckDB, without the leading WITH; it is called ``lines``."""
    if name == "raw":
        return f"lines as ({RAW_DUCK})"
    body, with_, _ = _SOURCES[name]
    if name == "noise":
        return f"raw as ({RAW_DUCK}), lines as ({body.replace('~', chr(92))})"
    return f"{with_ + ', ' if with_ else ''}lines as ({body})"


#: Corpora whose documents grow in number with a table: that table, as many of its rows as one task's lines are made from, and the document's column in the lines' sources.
_SPREAD = {"book": ("supplier", 50, "doc_id"), "tab": ("lineitem", 50_000, "doc_id"), "outl": ("lineitem", 50_000, "l_orderkey")}


#: Documents whose lines one task holds, where they are put together.
DOCUMENTS = 2000


def spark_lines(spark: SparkSession, sf_dir: str, name: str, together: bool = False) -> DataFrame:
    """(doc_id, line_no, line) of the corpus. With ``together`` the documents go to a task each so many before they are cut into lines, so that what needs a document's lines in one place moves none of them and no task's share grows with the corpus."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    if name in ("raw", "noise"):
        docs = read("documents").select("doc_id", "text")
        docs = spread(docs, DOCUMENTS, "doc_id") if together else docs
        raw = spark.sql(RAW_SPARK, documents=docs)
        if name == "raw":
            return raw
        return spark.sql(NOISE.replace("~", "\\\\").replace("from raw", "from {raw}"), raw=raw)
    body, with_, tables = _SOURCES[name]
    if name in _SPREAD:  # small tables make many lines, so partitions are as many as rows ask for
        table, rows, key = _SPREAD[name]
        n = max(1, -(-read(table).count() // rows))
        head, tail = body.split("line from (\n", 1)
        body = f"{head}line from (select /*+ repartition({n}, {key}) */ * from (\n{tail.removesuffix(') x')}) y) x"
    sql = f"with {with_} {body}" if with_ else body
    for t in tables:
        sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: read(t) for t in tables}).withColumn("line_no", F.col("line_no").cast("bigint"))
