"""What the queries don't show: sources, sinks, the stream, formulas, edge cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quirespark import session
from quirespark.functions import fragments, html, mathml, text
from quirespark.operators import audit, lines, links, sections, structure, table_repair, tables
from quirespark.plans import convert, registry
from quirespark.sources import documents
from quirespark.streaming import inbox

MD = "# 1. Alpha\n\n" + "Body of the first chapter. " * 4 + "\n\n## 1.1. Beta\n\n" + "Body of the second part. " * 4 + "\n"


def as_lines(spark, *texts):
    return lines.explode_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, md string"))


def test_formulas():
    f = mathml.convert
    assert f("a <math><mfrac><mi>x</mi><msup><mi>y</mi><mn>2</mn></msup></mfrac></math> b") == r"a $\frac{x}{y^{2}}$ b"
    assert f('<math display="block"><msqrt><mi>a</mi><mo>+</mo><mn>1</mn></msqrt></math>') == r"$$\sqrt{a + 1}$$"
    assert f("<math><mroot><mi>x</mi><mn>3</mn></mroot></math>") == r"$\sqrt[3]{x}$"
    assert f("<math><broken></math>") == "<math><broken></math>" and f("") == ""


def test_udfs(spark):
    df = spark.createDataFrame([("a &eacute; <math><mn>1</mn></math>",), (None,)], "x string")
    rows = df.select(html.unescape_udf("x").alias("u"), mathml.mathml_to_latex("x").alias("m")).collect()
    assert (rows[0].u, rows[0].m) == ("a é <math><mn>1</mn></math>", "a &eacute; $1$") and rows[1].u is None and rows[1].m is None


def test_sections_of_odd_documents(spark):
    got = sections.chunks(as_lines(spark, MD, "", None, "no heading at all", "# Only\n", "intro text that is long enough\n# A\nbody of A that is long enough")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert sorted(by) == [0, 5]
    a, b = sorted(by[0], key=lambda r: r.sec_no)
    assert (a.number, a.title, a.crumb, a.file) == ("1", "Alpha", None, "1-alpha.md")
    assert (b.number, b.crumb) == ("1.1", "> ↑ [1. Alpha](1-alpha.md)")
    assert [r.title for r in sorted(by[5], key=lambda r: r.sec_no)] == ["Front Matter", "A"]


def test_audit_of_dangling_images(spark):
    ls = as_lines(spark, "![a](images/a.png) ![b](b%20c.png) ![x](gone.png) ![w](https://e.example/x.png)")
    files = spark.createDataFrame([(0, "images/a.png"), (0, "b c.png"), (1, "gone.png")], "doc_id bigint, path string")
    assert [(r.check, r.line) for r in audit.dangling_images(ls, files).collect()] == [("dangling_image", 1)]
    assert audit.audit(as_lines(spark, "# T\n\ntext &amp; more ****x****")).count() == 2


def test_matching_of_tables(spark):
    schema = "doc_id bigint, page int, id int, tokens array<string>"
    broken = spark.createDataFrame([(1, 1, 1, ["a", "b", "c"]), (1, 2, 2, ["q"])], schema)
    whole = spark.createDataFrame([(1, 1, 7, ["a", "b", "x", "y"]), (1, 1, 8, ["a", "b", "c", "d"]), (1, 2, 9, ["z"])], schema)
    assert [(r.id, r.match_id, r.overlap) for r in tables.match_tables(broken, whole).collect()] == [(1, 8, 1.0)]


def test_files_in_and_chunks_out(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.md").write_text(MD)
    (tmp_path / "in/sub/b.HTML").write_text("<p>x</p>")
    (tmp_path / "in/c.unknown").write_text("?")
    files = {r.path.rpartition("/")[2]: r for r in documents.read_files(spark, f"{tmp_path}/in").collect()}
    assert {k: r.backend for k, r in files.items()} == {"a.md": "markdown", "b.HTML": "html", "c.unknown": None}
    md = documents.read_markdown(spark, f"{tmp_path}/in")
    out = documents.write_chunks(md, f"{tmp_path}/out")
    assert out.count() == 2 and out.where(F.col("content").startswith("---\n")).count() == 2
    assert documents.index_entries(out).first().md == "# Index\n\n- [1. Alpha](1-alpha.md)\n  - [1.1. Beta](1-1-beta.md)"


def test_the_inbox_reads_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = f"{tmp_path}/out"

    def add(n):
        spark.createDataFrame([(n, MD)], "doc_id bigint, md string").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        q = inbox.chunk_stream(inbox.watch(spark, f"{tmp_path}/in"), out, f"{tmp_path}/state")
        q.awaitTermination(120)
        return spark.read.parquet(out).count()

    assert [add(1), add(2)] == [2, 4]


def test_non_english_has_the_reference_lists_and_scripts(spark):
    from pyspark.sql import functions as F

    from quirespark.functions import language

    german, plain = "für den Motor auch dem Werk zum Start ", "Motor Pumpe Ventil Sensor Kabel Platte Schraube "
    caption = "![the pump and the valve that you have with this unit, which is for you and your work](x.png) "
    rows = [
        (1, german * 4, True), (2, german * 4 + caption * 2, True), (3, plain * 4, False), (4, "la pompe en a le que de in to on " * 4, False),
        (5, "this is what you should have when they were there " * 4, False), (6, "\u0561\u0562\u0563\u0564\u0565 " * 8, False), (7, "насос и клапан работают", True), (8, "για την αντλία", False), (9, "short", False),
    ]
    got = {r.i: r.v for r in spark.createDataFrame(rows, "i int, t string, w boolean").select("i", language.non_english(F.col("t")).alias("v")).collect()}
    want = {i: w for i, _, w in rows}
    want[8] = True  # Greek letters, twelve of them
    assert len(language.ENGLISH) == 51 and got == want


# -- cases of the behaviour that is matched, as literals


def one(spark, column, *values):
    """What a column rule makes of texts."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_labels_and_file_names(spark):
    assert one(spark, text.crumb, "a|b", "a\\b (c)", "x" * 60, "[]") == ["a b", "a b c", "x" * 50 + "…", ""]
    assert one(spark, text.file_slug, "[Foo](#bar) Baz", "Ünïcode & Co. $5", "***", "a" * 199 + " bc") == ["foo-baz", "ünïcode-co-$5", "section", "a" * 199]
    assert one(spark, text.strip_links, "[a[b](c)](d) e", "no", "a[b](c)d") == ["ab e", "no", "abd"]
    assert one(spark, text.repair_cross_ref, "Se[e Foo](#page-1-2)", "see [Foo](#page-1-2)", "[Foo](#page-1-2)") == ["[See Foo](#page-1-2)", "see [Foo](#page-1-2)", "[Foo](#page-1-2)"]


def table(spark, *rows):
    got = tables.normalize_tables(as_lines(spark, "\n".join(rows))).orderBy("line_no", "part").collect()
    return [r.line for r in got]


def test_tables_as_they_should_be(spark):
    assert table(spark, "| Title |", "|---|", "| a | b |", "| 1 | 2 | |") == ["**Title**", "", "| a | b |", "| --- | --- |", "| 1 | 2 |"]
    assert table(spark, "| a | b | c |", "| 1 |") == ["| a | b | c |", "| --- | --- | --- |", "| 1 |  |  |"]
    assert table(spark, "| only |", "|:--|", "| x |") == ["| only |  |", "| --- | --- |", "| x |  |"]
    assert table(spark, "| open", "text") == [] and table(spark, "|---|", "| --- |") == ["|---|", "| --- |"]


def test_crumbs_of_dropped_parents(spark):
    """A parent that is an entry of a contents page has no file, but its name stays in the crumb."""
    body = "A body that is long enough to be kept as a file."
    got = {r.title: r for r in sections.chunks(as_lines(spark, f"# Part\n{body}\n## 1.1 Intro 32\n### Child\n{body}\n"), 20).collect()}
    assert got["Child"].crumb == "> ↑ 1.1. Intro 32" and "Intro 32" not in got


def test_a_list_of_links_is_no_parent(spark):
    body = "A body that is long enough to be kept as a file."
    md = f"# Top\n{body}\n## Contents\n- [A](#a)\n- [B](#b)\n### A\n{body}\n### B\n{body}\n"
    got = {r.title: r.crumb for r in sections.chunks(as_lines(spark, md)).collect()}
    assert got["A"] == got["B"] == "> ↑ [Top](top.md)"


def test_packing_to_a_size(spark):
    para = "word " * 20
    small = f"# A\n{para}\n## B\n{para}\n"
    large = "# Big\n" + "\n\n".join([para] * 10) + "\n\n```\n" + para + "\n\n" + para + "\n```\n"
    s = sections.keep_sections(sections.tree(as_lines(spark, small, large)))
    got = sorted((r.doc_id, r.sec_no, r.part, r.parts, r.title, "\n".join(r.body)) for r in sections.pack_sections(s, 400).collect())
    assert got[0][:5] == (0, 1, 1, 1, "A") and "## B" in got[0][5] and len([x for x in got if x[0] == 0]) == 1
    parts = [x for x in got if x[0] == 1]
    assert len(parts) == parts[0][3] > 2 and parts[1][4] == f"Big (part 2 of {len(parts)})"
    assert sum(p[5].count("```") for p in parts) == 2 and all(p[5].count("```") in (0, 2) for p in parts)
    assert "\n\n".join(p[5] for p in parts).split() == large.split()[2:]


def test_relative_paths(spark):
    df = spark.createDataFrame([(["a", "b", "f.md"], ["a", "c"]), (["f.md"], []), (["a", "f.md"], ["a"]), (["f.md"], ["x", "y"])], "t array<string>, s array<string>")
    assert sorted(r.r for r in df.select(sections.relative(F.col("t"), F.col("s")).alias("r")).collect()) == ["../../f.md", "../b/f.md", "f.md", "f.md"]


def test_fragments_of_html():
    f = fragments.to_markdown
    assert f("") == f("   ") == "" and f("<p>Some <b>bold <strong>in</strong></b> H<sub>2</sub>O</p>") == "Some **bold in** H2O"
    assert f("<h2>Title</h2><p>text</p>") == "**Title**\n\ntext"
    assert f('<img class="equation_image" alt="LaTeX: x^2">') == "$x^2$" and f('<img class="equation_image" data-equation-content="y" alt="z">') == "$y$"
    assert f("<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>") == "* a\n* b\n  + c"
    assert f("<p>x</p><script>z</script><div style='display: none'>h</div>") == "x"
    assert f('<img src="m/a.png" alt="pic">', media=lambda s: "") == "pic" and f('<img src="m/a.png">', media=lambda s: "images/a.png") == "![](images/a.png)"
    assert f("<table><tr><th>A</th></tr><tr><td>1<br>2</td></tr></table>") == "| A |\n| --- |\n| 1 2 |"
    assert fragments.embedded("```\n<table>\n</table>\n```") == "```\n<table>\n</table>\n```"


def test_the_clean_up_as_a_whole(spark):
    md = "<table>\n<tr><th>A</th><th>B</th></tr>\n<tr><td>1</td><td>2</td></tr>\n</table>\n1.2. Numbered\n\n\n\nText &amp; <b>more</b> a\\_b\n## **Bold** one\nbody\n- a. item\n"
    want = "| A | B |\n| --- | --- |\n| 1 | 2 |\n## 1.2. Numbered\n\nText & more a_b\n## Bold one\nbody\n  - a) item\n"
    df = spark.createDataFrame([(1, md), (2, None), (3, "")], "doc_id bigint, md string")
    assert {r.doc_id: r.md for r in structure.cleanup(df).collect()}[1] == want
    assert {r.doc_id: r.md for r in structure.cleanup(df, "off").collect()} == {1: md, 2: None, 3: ""}


def test_outlines_become_headings(spark):
    md = "* + 1. First\n    1. Sub\n        1. Leaf\n2. Second\n3. Third\n"
    lines_ = [r.line for r in structure.promote_outline(as_lines(spark, md)).orderBy("line_no").collect()]
    assert [x for x in lines_ if x.startswith("#")] and not any(x.startswith("* +") for x in lines_)


def test_documents_to_chunks_in_one_call(spark):
    docs = spark.createDataFrame([(1, MD), (2, None), (3, ""), (4, "# A\n\n![x](images/p.png) and a body that is long enough.\n")], "doc_id bigint, md string")
    got = {(r.doc_id, r.title): r for r in convert.convert(spark, docs).collect()}
    assert sorted(got) == [(1, "Alpha"), (1, "Beta"), (4, "A")] and got[1, "Beta"].parent_id == got[1, "Alpha"].section_id
    caption = spark.createDataFrame([(4, "p.png", "a map", None)], "doc_id bigint, basename string, caption string, mermaid string")
    assert any("![a map](images/p.png)" in r.text for r in convert.convert(spark, docs, convert.options("flat", target_chars=2000), caption).collect())
    assert convert.options("flat").nested is False and convert.options("flat", cleanup=None).cleanup == "basic"
    with pytest.raises(ValueError):
        convert.options("none")
    with pytest.raises(ValueError):
        convert.options("flat", colour=1)


def test_decorations_through_chains_of_any_length(spark):
    rng = random.Random(5)
    chain = [rng.getrandbits(64)]
    for _ in range(400):  # each within 12 bits of the one before it
        chain.append(chain[-1] ^ sum(1 << b for b in rng.sample(range(64), 12)))
    rows = [(1, f"c{i}", h) for i, h in enumerate(chain)] + [(2, f"r{i}", rng.getrandbits(64)) for i in range(300)] + [(3, f"s{i}", h) for i, h in enumerate(chain[:20])] + [(4, "alone", 7), (5, "none", None), (5, "none", None)]
    rows = [(d, n, h if h is None or h < 1 << 63 else h - (1 << 64)) for d, n, h in rows]
    got = {}
    for r in links.decorations(spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id bigint, basename string, phash bigint"), 2).collect():
        got[r.doc_id, r.basename] = r.cluster
    want = {}
    for doc in {d for d, _, _ in rows}:
        own = [(n, h) for d, n, h in rows if d == doc and h is not None]
        left = sorted(h for _, h in own)
        while left:
            group, at = [], [left.pop(0)]
            while at:
                x = at.pop()
                group.append(x)
                at += [y for y in left if ((x ^ y) & (1 << 64) - 1).bit_count() <= 12]
                left = [y for y in left if y not in at]
            want |= {(doc, n): min(group) for n, h in own if h in group and len(group) > 1}
    assert got == want and len({c for (d, _), c in got.items() if d == 1}) == 1 and (4, "alone") not in got


def test_pairs_of_a_long_text_in_linear_time(spark):
    words = " ".join(f"w{i}" for i in range(60_000))  # the old form made the words anew for each pair
    df = spark.createDataFrame([(words,), ("one",), ("",)], "t string").select(table_repair.bigrams(table_repair.tokens(F.col("t"))).alias("b"))
    assert [len(r.b) for r in df.collect()] == [59_999, 0, 0]


def test_plain_fragments_are_as_parsed(spark):
    for x in ("a  b\n c", "  - x  ", "1. y\u00a0z", "\t", "a > b", None):
        p = fragments._Tree()
        p.feed(x or "")
        p.close()
        assert fragments.to_markdown(x) == " ".join(fragments._children(p.root, None, 0).split())


def test_spread(spark, small):
    df = spark.read.parquet(f"{small}/part.parquet")
    assert session.spread(df, 20).rdd.getNumPartitions() == -(-df.count() // 20) and session.spread(df.where("false"), 20).rdd.getNumPartitions() == 1
    made = registry.queries()["qti_items"](spark, small)
    assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().toString()


def test_sections_below_one_that_is_no_file_of_its_own(spark):
    same = "## Same\n\nThis text is long enough to be a file.\n\n"
    doc = f"# A\n\n{same}### X\n\nA text of the first child, long enough.\n\n{same}### Y\n\nA text of the second child, see [x](#x) and [y](#y).\n"
    tree = sections.tree(as_lines(spark, doc))
    assert {r.sec_no: r.crumb for r in sections.breadcrumbs(tree).collect()} == {2: "> ↑ A", 3: "> ↑ A / [Same](same.md)", 5: "> ↑ A / Same"}
    assert {(r.slug, r.target) for r in sections.linked_sections(tree).collect()} == {("x", "x.md"), ("y", "y.md")}


def test_what_a_section_is_told_is_there_once(spark):
    rows = spark.range(1, 3001).selectExpr("0L doc_id", "cast(id as int) sec_no")
    got = sections.told(rows, F.array(F.lit(1)), F.col("sec_no"), "below", F.collect_list)
    assert got.agg(F.sum(F.size("below"))).first()[0] == 3000 and got.count() == 3000 and "Window" not in got._jdf.queryExecution().toString()


def test_contents_are_made_without_a_list_of_all_headings(spark):
    text = "\n".join(["# Book", "## Table of Contents", "old", *[f"{'#' * (2 + i % 3)} Part {i}" for i in range(500)]])
    df = structure.regenerate_toc(as_lines(spark, text, "## Table of Contents\nold", "# no contents"))
    assert "collect_list" not in df._jdf.queryExecution().toString()
    rows = sorted((r.doc_id, r.line_no, r.part, r.line) for r in df.collect())
    made = [r[3] for r in rows if r[:2] == (0, 1)]
    assert made == ["## Table of Contents", "", *[f"{'  ' * (i % 3)}- [Part {i}](#part-{i})" for i in range(500)], ""]
    assert [r[2] for r in rows if r[:2] == (0, 1)] == list(range(503)) and sum(r[0] == 0 for r in rows) == 1 + 503 + 500
    assert [r for r in rows if r[0]] == [(1, 0, 0, "## Table of Contents"), (1, 0, 1, ""), (2, 0, 0, "# no contents")]


def test_references_are_sought_near_their_addresses_only(spark):
    rng = random.Random(7)
    bits = ["Se[e ", "[", "]", "](#page-3-4)", "(#page-12-1)", "(#page-", "(#page-1)", ")", " ", "é", "a", "1", "word " * 7, "x" * 79, "x" * 83, "漢" * 90, "long text " * 30, "\u0001", "\n"]
    cases = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    cases += [f"{'b' * i}(#page-1-2) {'c' * j}](#page-3-4)" for i in range(76, 90) for j in range(76, 90)]
    df = spark.createDataFrame([(c,) for c in [*cases, None]], "x string")
    rows = df.select(text.repair_cross_ref(F.col("x")).alias("a"), text._repaired(F.col("x")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]
    line = spark.createDataFrame([("word " * 100_000 + "Se[e Part](#page-3-4) of " + "word " * 100_000 + "[b](#page-1-1)" + "word " * 100_000,)], "x string")
    sought = line.select(F.split(text._near_addresses(F.col("x")), "\u0001").alias("p")).first().p
    assert "".join(sought) == line.first().x and sum(map(len, sought[::2])) < 250


def test_strip_takes_what_the_pattern_took(spark):
    cases = ["", " ", "\t\n\x0b\f\r a \r\f\x0b\n\t", "a ", "　é ", "a b", "\x1ca ", " \x00 ", None]
    rows = spark.createDataFrame([(c,) for c in cases], "x string").select("x", text.strip(F.col("x")).alias("s"), text.rstrip(F.col("x")).alias("r"), F.regexp_replace("x", r"^\s+|\s+$", "").alias("ps"), F.regexp_replace("x", r"\s+$", "").alias("pr")).collect()
    assert [(r.s, r.r) for r in rows] == [(r.ps, r.pr) for r in rows]


def test_fragments_that_come_again_are_parsed_once_and_small_tables_are_spread(spark):
    md = "<table><tr><td>once</td></tr></table>\ntext\n<img src='a.png' alt='x'>"
    fragments._kept.cache_clear()
    first = fragments.embedded(md)
    assert fragments.embedded(md) == first and "once" in first and "![x](a.png)" in first
    assert (fragments._kept.cache_info().hits, fragments._kept.cache_info().misses) == (2, 2)
    assert registry.queries()["embedded_html"](spark, "/root/testdata/sf0.1").rdd.getNumPartitions() == 3  # of 150,000 orders in one row group


def test_sections_are_made_in_tasks_of_a_share_that_does_not_grow(spark):
    from quirespark.plans import fixtures, structure as plans

    pages, docs = plans.page_lines(spark, "/root/testdata/sf0.1"), fixtures.spark_lines(spark, "/root/testdata/sf0.1", "noise", together=True)
    assert (pages.rdd.getNumPartitions(), docs.rdd.getNumPartitions()) == (3, 5)  # of 2,500 pages and 10,000 documents in one row group each
    plan = sections.parse_sections(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # lines stay where their documents were put
