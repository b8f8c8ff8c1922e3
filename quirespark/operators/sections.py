"""Lines to sections: headings, bodies, parents, what is kept, breadcrumbs, files.

A document's lines stay in one partition: parsing is one exchange on doc_id, and all that
follows keeps that partitioning. Sections tell their ancestors (``told``) or look them up in
arrays of their document by number, so nothing is joined with itself. A document is at most one
row of arrays, so it must fit a task's memory; the corpus need not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.language import non_english
from ..functions.text import crumb, file_slug, frontmatter, is_toc_phantom, path_slug, slug, strip, strip_links
from .lines import upto, whole

ANY = r"^(#{1,6})\s+(.+?)\s*$"
NUMBERED = r"^(#{1,6})\s+(\d+(?:\.\d+)*)\.?\s+(.+?)\s*$"
PREFIX = r"^(\d+(?:\.\d+)*)\.?\s+(.+?)$"
CHAPTER = r"(?i)^Chapter\s+(\d+)(?:[\s.:]+(.+))?$"
MEASURE = r"^#{1,6}\s+\d+(?:\.\d+)?\s+[a-z]"
UNIT = r"^#{1,6}\s+[-+]?\d+(?:\.\d+)?\s+(?:THz|GHz|MHz|Hz|Vpp|Vrms|VA|V|Wh|Wb|W|MPa|Pa|Nm|MΩ|Ω|Sv|Gy|Bq)(?:[^A-Za-z].*)?$"
PREAMBLE = "Front Matter"
SPARSE, RATIO = 2, 3
MIN_BODY = 20
PAGE_ANCHOR = r'^<span id="page-\d+-\d+"></span>\s*$'


def parsed(line: Column) -> dict[str, Column]:
    """Level, number and title of a heading line as the numbered and the mixed reading see it; level is null where it is no heading."""
    hashes, body = F.regexp_extract(line, ANY, 1), F.regexp_extract(line, ANY, 2)
    is_any = line.rlike(ANY)
    measure = line.rlike(MEASURE) | line.rlike(UNIT)
    number, title = F.regexp_extract(line, NUMBERED, 2), F.regexp_extract(line, NUMBERED, 3)
    chapter, rest = F.regexp_extract(strip(body), CHAPTER, 1), strip(F.regexp_extract(strip(body), CHAPTER, 2))
    by_number = line.rlike(NUMBERED)
    two = (F.length(hashes) == 2) & ~F.contains(number, F.lit("."))
    has_number = by_number & ~two & ~measure
    is_chapter = is_any & (chapter != "") & ~by_number
    prefix = is_any & body.rlike(PREFIX) & ~measure
    chapter_title = F.when(rest != "", rest).otherwise(F.concat(F.lit("Chapter "), chapter))
    level = F.length(hashes)
    return {
        "num_level": F.when(has_number | is_chapter, level), "num_number": F.when(has_number, number).when(is_chapter, chapter), "num_title": F.when(has_number, title).when(is_chapter, chapter_title),
        "any_level": F.when(is_any, level), "any_number": F.when(prefix, F.regexp_extract(body, PREFIX, 1)).when(is_chapter, chapter),
        "any_title": F.when(prefix, strip(F.regexp_extract(body, PREFIX, 2))).when(is_chapter, chapter_title).when(is_any, strip(body)),
    }


def fallback_level(count: Column) -> Column:
    """Depth of a document's chapters from its headings per depth (an array of six): the shallowest with two or more, but not a pair right above a group three times as large."""
    depths = F.filter(F.sequence(F.lit(1), F.lit(6)), lambda d: F.element_at(count, d) > 0)
    several = F.filter(depths, lambda d: F.element_at(count, d) >= 2)
    first = F.when(F.size(several) > 0, F.element_at(several, 1)).otherwise(F.element_at(depths, 1))
    step = F.aggregate(
        depths, F.struct(first.alias("at"), F.lit(False).alias("done")),
        lambda a, d: F.when(a["done"] | (d <= a["at"]), a)
        .when((F.element_at(count, a["at"]) <= SPARSE) & (F.element_at(count, a["at"]) >= 2) & (F.element_at(count, d) >= RATIO * F.element_at(count, a["at"])), F.struct(d.alias("at"), F.lit(False).alias("done")))
        .otherwise(F.struct(a["at"].alias("at"), F.lit(True).alias("done"))),
        lambda a: a["at"],
    )
    return F.when(F.size(depths) > 0, step)


def outline(lines: DataFrame) -> DataFrame:
    """(doc_id, representative, min_level, n_headings) per document: whether its numbered headings are its structure, and the fallback depth."""
    p = parsed(F.col("line"))
    df = lines.select("doc_id", p["num_level"].alias("nl"), p["any_level"].alias("al"))
    df = df.groupBy("doc_id").agg(F.min("nl").alias("nl"), F.min("al").alias("al"), F.count("al").alias("n_headings"), *[F.count(F.when(F.col("al") == k, 1)).alias(f"c{k}") for k in range(1, 7)])
    return df.select("doc_id", F.coalesce(F.col("nl") <= F.col("al"), F.lit(False)).alias("representative"), fallback_level(F.array(*[F.col(f"c{k}") for k in range(1, 7)])).alias("min_level"), "n_headings")


def parse_sections(lines: DataFrame, min_level: int | None = None, max_level: int | None = None, auto: bool = True) -> DataFrame:
    """(doc_id, sec_no, line_no, level, number, title, ancestor_only, preamble, body array of lines).

    Without ``min_level`` a document is read by its numbered headings if they are its
    structure, else by all headings with the fallback depth (``auto``). Lines before the
    first heading are a section 0 if they hold prose, else they begin the first body.
    Documents without a section have no row.
    """
    p = parsed(F.col("line"))
    df = lines.select("doc_id", "line_no", "line", *[c.alias(n) for n, c in p.items()])
    w = whole()
    if min_level is None and auto:
        df = df.withColumn("rep", F.coalesce(F.min("num_level").over(w) <= F.min("any_level").over(w), F.lit(False)))
        counts = F.array(*[F.count(F.when(F.col("any_level") == k, 1)).over(w) for k in range(1, 7)])
        df = df.withColumn("counts", counts).withColumn("least", fallback_level(F.col("counts")))
    else:
        df = df.withColumn("rep", F.lit(min_level is None)).withColumn("least", F.lit(min_level or 1))
    pick = lambda n: F.when(F.col("rep"), F.col(f"num_{n}")).otherwise(F.col(f"any_{n}"))
    df = df.withColumn("level", pick("level")).withColumn("number", pick("number")).withColumn("title", pick("title"))
    if max_level is not None:
        deep = F.col("level") > max_level
        df = df.withColumn("level", F.when(~deep, F.col("level")))
    df = df.withColumn("sec_no", F.sum(F.col("level").isNotNull().cast("int")).over(upto()))
    head = F.col("level").isNotNull()
    sec = df.groupBy("doc_id", "sec_no").agg(
        F.min("line_no").alias("line_no"), F.max(F.when(head, F.col("level"))).alias("level"), F.max(F.when(head, F.col("number"))).alias("number"), F.max(F.when(head, F.col("title"))).alias("title"),
        F.max(F.when(head & ~F.col("rep") & F.col("number").isNull() & (F.col("level") < F.col("least")), 1).otherwise(0)).alias("ancestor_only"),
        F.transform(F.array_sort(F.collect_list(F.when(~head, F.struct("line_no", "line")))), lambda x: x["line"]).alias("body"),
        F.max((~head & (strip(F.col("line")) != "")).cast("int")).alias("some"),
        F.max((~head & (strip(F.col("line")) != "") & ~strip(F.col("line")).rlike(r"^(?:!\[|\[\s*\]$)")).cast("int")).alias("prose"),
    )
    by = Window.partitionBy("doc_id").orderBy("sec_no")
    last = F.max("sec_no").over(Window.partitionBy("doc_id"))
    sec = sec.withColumn("last", last).withColumn("before", F.lag(F.struct("sec_no", "body", "some", "prose")).over(by))
    folded = (F.col("sec_no") == 1) & (F.col("before.sec_no") == 0) & (F.col("before.some") == 1) & (F.col("before.prose") == 0)
    sec = sec.withColumn("body", F.when(folded, F.concat("before.body", "body")).otherwise(F.col("body")))
    sec = sec.where((F.col("last") > 0) & ((F.col("sec_no") > 0) | (F.col("prose") == 1)))
    pre = F.col("sec_no") == 0
    return sec.select(
        "doc_id", F.col("sec_no").cast("int").alias("sec_no"), "line_no", F.when(pre, 1).otherwise(F.col("level")).cast("int").alias("level"), "number",
        F.when(pre, F.lit(PREAMBLE)).otherwise(F.col("title")).alias("title"), F.col("ancestor_only").cast("int").alias("ancestor_only"), pre.cast("int").alias("preamble"), "body",
    )


def display_name(number: Column, title: Column) -> Column:
    return F.when(number.isNotNull(), F.concat(number, F.lit(". "), title)).otherwise(title)


def find_parents(sections: DataFrame) -> DataFrame:
    """Adds parent_sec_no: for an unnumbered section the nearest earlier of a lower level, for a single number the nearest earlier unnumbered one, for a longer number the nearest earlier section of its prefix."""
    w = Window.partitionBy("doc_id").orderBy("sec_no").rowsBetween(Window.unboundedPreceding, -1)
    real = F.col("preamble") == 0
    near = lambda extra: F.greatest(F.lit(None).cast("int"), *[F.when(F.col("level") > k, F.last(F.when((F.col("level") == k) & real & extra, F.col("sec_no")), ignorenulls=True).over(w)) for k in range(1, 6)])
    df = sections.withColumn("by_level", near(F.lit(True))).withColumn("by_plain", near(F.col("number").isNull()))
    df = df.withColumn("prefix", F.when(F.contains("number", F.lit(".")), F.regexp_replace("number", r"\.\d+$", "")))
    # Each section is there as one that seeks its prefix and as one that has a number; the latest above a seeker that has its prefix wins.
    both = F.array(F.struct(F.col("prefix").alias("key"), F.lit(False).alias("has")), F.struct(F.col("number").alias("key"), F.lit(True).alias("has")))
    df = df.select("*", F.explode(F.filter(both, lambda x: ~x["has"] | x["key"].isNotNull())).alias("x"))
    k = Window.partitionBy("doc_id", "x.key").orderBy("sec_no", "x.has").rowsBetween(Window.unboundedPreceding, -1)
    found = F.greatest(F.lit(None).cast("int"), *[F.when(F.col("level") > n, F.last(F.when((F.col("level") == n) & F.col("x.has"), F.col("sec_no")), ignorenulls=True).over(k)) for n in range(1, 6)])
    df = df.withColumn("by_prefix", found).where(~F.col("x.has"))
    parent = F.when(F.col("preamble") == 1, F.lit(None)).when(F.col("number").isNull(), F.col("by_level")).when(F.col("prefix").isNull(), F.col("by_plain")).otherwise(F.col("by_prefix"))
    return df.withColumn("parent_sec_no", parent.cast("int")).drop("by_level", "by_plain", "by_prefix", "prefix", "x")


def body_chars(body: Column) -> Column:
    """Characters of a body without lines that are page anchors only."""
    return F.length(strip(F.array_join(F.filter(body, lambda x: ~strip(x).rlike(PAGE_ANCHOR)), "\n")))


NAV_LINE = r"^\s*(?:[-*+]\s+)?\[[^\]]+\]\([^)\s]*\)\s*$"


def is_nav_list(body: Column) -> Column:
    """At least two lines that are links, and four fifths of all that aren't blank."""
    lines = F.filter(body, lambda x: strip(x) != "")
    links = F.size(F.filter(lines, lambda x: x.rlike(NAV_LINE)))
    return (links >= 2) & (links >= 0.8 * F.size(lines))


def is_phantom() -> Column:
    return is_toc_phantom(display_name(F.col("number"), F.col("title")))


def drop_toc_phantoms(sections: DataFrame) -> DataFrame:
    return sections.where(~is_phantom())


def is_shell() -> Column:
    """A heading above the split's depth without a text of its own: an ancestor, but no file."""
    return (F.col("ancestor_only") == 1) & ~F.exists("body", lambda x: strip(x) != "")


def _rows_of(sections: DataFrame, order: str = "sec_no") -> DataFrame:
    """(doc_id, secs): a document's sections as one array in their order, and back with ``inline``."""
    rest = [c for c in sections.columns if c not in ("doc_id", order)]
    return sections.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(order, *rest))).alias("secs"))


def _at(n: Column) -> Column:
    """A document's section by its number, in ``secs`` of all sections; numbers of a document have no gap, so this is a place and no search."""
    return F.get("secs", n - F.element_at("secs", 1)["sec_no"])


def ancestors(sections: DataFrame, rounds: int = 8) -> DataFrame:
    """Adds ``path``: the sec_no of every ancestor, root first, lists of links left out; and ``open``: those of them up to the first that is no file of its own (a phantom or a shell). A parent is less deep than its child, so eight steps reach every root."""
    flags = sections.withColumn("nav", is_nav_list(F.col("body")) & ~is_phantom()).withColumn("blocked", is_phantom() | is_shell())
    d, at = _rows_of(flags), _at

    def path(x: Column) -> Column:
        def climb(p: Column, _: Column) -> Column:
            top = at(F.get(p, F.lit(0)))["parent_sec_no"]
            return F.when(top.isNotNull(), F.concat(F.array(top), p)).otherwise(p)

        start = F.when(x["parent_sec_no"].isNotNull(), F.array(x["parent_sec_no"])).otherwise(F.array().cast("array<int>"))
        return F.filter(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, climb), lambda n: ~at(n)["nav"])

    d = d.withColumn("paths", F.transform("secs", path))
    opened = lambda p: F.aggregate(p, F.array().cast("array<int>"), lambda a, n: F.when(at(n)["blocked"], F.array().cast("array<int>")).otherwise(F.concat(a, F.array(n))))
    row = F.zip_with("secs", "paths", lambda x, p: F.struct(*[x[c].alias(c) for c in flags.columns if c != "doc_id"], p.alias("path"), opened(p).alias("open")))
    return d.select("doc_id", F.inline(row))


def told(rows: DataFrame, to: Column, value: Column, name: str, how=F.max) -> DataFrame:
    """Rows with ``name``: what is said to them, put together; each row says ``value`` to the sections of its document that ``to`` lists. One grouping of the partitioning there is, no join; what a section is told is there once, and not with every message."""
    own = F.struct(*[F.col(c) for c in rows.columns if c not in ("doc_id", "sec_no")])
    to_all = rows.select("doc_id", F.col("sec_no").alias("me"), own.alias("r"), value.alias("v"), to.alias("to"))
    said = F.concat(F.array(F.struct(F.col("me").alias("sec_no"), F.col("r"), F.lit(None).cast(to_all.schema["v"].dataType).alias("v"))), F.transform("to", lambda n: F.struct(n.alias("sec_no"), F.lit(None).cast(to_all.schema["r"].dataType).alias("r"), F.col("v"))))
    df = to_all.select("doc_id", F.inline(said)).groupBy("doc_id", "sec_no").agg(F.first("r", ignorenulls=True).alias("r"), how("v").alias(name))
    return df.where("r is not null").select("doc_id", "sec_no", "r.*", name)


def keep_sections(sections: DataFrame, min_body: int = MIN_BODY) -> DataFrame:
    """Sections with a body of enough characters, or with a kept descendant up to which all are files; needs ``path`` and ``open``."""
    real = (body_chars(F.col("body")) >= min_body) & ~F.col("blocked")
    rows = told(sections, F.when(real, F.concat("open", F.array("sec_no"))).otherwise(F.array().cast("array<int>")), F.lit(1), "kept")
    return rows.where("kept = 1").drop("kept")


def english_sections(sections: DataFrame) -> DataFrame:
    """Sections outside of every subtree that is not English; needs ``path``. A subtree's text is that of its sections in their order, phantoms left out."""
    text = F.concat(heading_line(), F.lit("\n"), F.array_join("body", "\n"))
    rows = told(sections.where(~is_phantom()), F.concat("path", F.array("sec_no")), F.struct(F.col("sec_no").alias("n"), text.alias("t")), "below", F.collect_list)
    whole_text = F.array_join(F.transform(F.array_sort("below"), lambda x: x["t"]), "\n")
    rows = rows.withColumn("foreign", non_english(whole_text)).drop("below")
    d = _rows_of(rows)
    bad = F.transform(F.filter("secs", lambda x: x["foreign"]), lambda x: x["sec_no"])
    d = d.withColumn("bad", bad).select("doc_id", "bad", F.inline("secs"))
    return d.where(~F.array_contains("bad", F.col("sec_no")) & ~F.arrays_overlap("bad", "path")).drop("bad", "foreign")


def heading_line(title: Column | None = None) -> Column:
    return F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.when(F.col("number").isNotNull(), F.concat("number", F.lit(". "))).otherwise(F.lit("")), F.col("title") if title is None else title)


def blocks_of(body: Column) -> Column:
    """Blocks of lines between blanks; a code fence is one block with the blanks in it."""
    state = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(False).alias("fence"))

    def step(a: Column, x: Column) -> Column:
        ends = ~a["fence"] & (strip(x) == "")
        mark = F.regexp_replace(x, r"^\s+", "").rlike(r"^(```|~~~)")
        closed = F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"])
        return F.struct(
            F.when(ends, closed).otherwise(a["done"]).alias("done"), F.when(ends, F.array().cast("array<string>")).otherwise(F.concat(a["now"], F.array(x))).alias("now"),
            F.when(mark & ~ends, ~a["fence"]).otherwise(a["fence"]).alias("fence"),
        )

    return F.aggregate(body, state, step, lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))


def filled(blocks: Column, most: int) -> Column:
    """Parts of a body: blocks are added while a part's characters stay within ``most``; a larger block is a part of its own."""
    size = lambda b: F.aggregate(b, F.lit(1), lambda n, x: n + F.length(x) + 1)
    empty = F.array().cast("array<string>")
    state = F.struct(F.array().cast("array<array<string>>").alias("done"), empty.alias("now"), F.lit(0).alias("n"))

    def step(a: Column, b: Column) -> Column:
        full = (F.size(a["now"]) > 0) & (a["n"] + size(b) > most)
        now = F.when(full | (F.size(a["now"]) == 0), b).otherwise(F.concat(a["now"], F.array(F.lit("")), b))
        return F.struct(F.when(full, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]).alias("done"), now.alias("now"), (F.when(full, 0).otherwise(a["n"]) + size(b)).alias("n"))

    return F.aggregate(blocks, state, step, lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))


def pack_sections(sections: DataFrame, most: int) -> DataFrame:
    """(doc_id, sec_no, part, parts, level, number, title, path, body): sections put together up to ``most`` characters.

    The topmost section whose whole subtree fits takes in its descendants; what fits nowhere
    keeps its own text, cut at block borders where that is longer. Needs ``path`` and ``open``; a
    subtree hangs together by sections that are there, so of the path only the end that is kept counts.
    """
    own = F.length(heading_line()) + 1 + F.aggregate("body", F.lit(0), lambda n, x: n + F.length(x) + 1)
    up = told(sections.withColumn("own", own), F.concat("open", F.array("sec_no")), F.col("own").cast("bigint"), "subtree", F.sum)
    d = _rows_of(up).withColumn("fits", F.map_from_arrays(F.transform("secs", lambda x: x["sec_no"]), F.transform("secs", lambda x: x["subtree"] <= most)))
    df = d.select("doc_id", "fits", F.inline("secs"))
    head = F.filter(F.concat("open", F.array("sec_no")), lambda n: F.try_element_at("fits", n))
    df = df.withColumn("head", F.when(F.size(head) > 0, F.element_at(head, 1)).otherwise(F.col("sec_no")))
    mine = F.when(F.col("head") == F.col("sec_no"), F.col("body")).otherwise(F.concat(F.array(F.lit(""), heading_line()), "body"))
    df = df.withColumn("mine", mine).withColumn("fit", F.try_element_at("fits", F.col("sec_no"))).drop("fits")
    got = df.groupBy("doc_id", "head").agg(
        F.min(F.struct("sec_no", "level", "number", "title", "path", "own", "fit")).alias("h"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sec_no", "mine"))), lambda x: x["mine"])).alias("body"),
    )
    cut = F.when(~F.col("h.fit") & (F.col("h.own") > most), filled(blocks_of(F.col("body")), most)).otherwise(F.array("body"))
    got = got.withColumn("cut", F.when(F.size(cut) > 1, cut).otherwise(F.array("body"))).withColumn("parts", F.size("cut"))
    out = got.select("doc_id", F.col("head").alias("sec_no"), "parts", "h.level", "h.number", "h.title", "h.path", F.posexplode("cut").alias("p", "text"))
    title = F.when(F.col("p") > 0, F.concat("title", F.lit(" (part "), (F.col("p") + 1).cast("string"), F.lit(" of "), F.col("parts").cast("string"), F.lit(")"))).otherwise(F.col("title"))
    return out.select("doc_id", "sec_no", (F.col("p") + 1).alias("part"), "parts", "level", "number", title.alias("title"), "path", F.col("text").alias("body"))


def folder(x: Column, above: Column) -> Column:
    """Folders of a section's file: of a number its prefixes, else its ancestors' numbers or names, root first; ``above`` has number and title of each."""
    parts = F.split(x["number"], r"\.")
    chain = F.when(F.size(parts) <= 1, F.array(path_slug(F.element_at(parts, 1)))).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: path_slug(F.array_join(F.slice(parts, F.lit(1), i), "."))))
    own = lambda a: F.when(a["number"].isNotNull(), path_slug(a["number"])).otherwise(file_slug(a["title"]))
    return F.when(x["number"].isNotNull(), chain).when(F.size(above) == 0, F.array(file_slug(x["title"]))).otherwise(F.transform(above, own))


def relative(target: Column, start: Column) -> Column:
    """A path (array of folders and file) as seen from a folder."""
    n = F.least(F.size(target) - 1, F.size(start))
    same = F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.slice(target, F.lit(1), i) == F.slice(start, F.lit(1), i)))).otherwise(0)
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(start) - same), F.slice(target, same + 1, F.size(target))), "/")


def folders(sections: DataFrame, nested: bool = False) -> DataFrame:
    """Adds ``dir``, the folders of a section's file, none unless nested; takes all sections, of which some become files."""
    if not nested:
        return sections.withColumn("dir", F.array().cast("array<string>"))
    rows = _rows_of(sections.withColumn("all", F.lit(True)))
    row = F.transform("secs", lambda x: F.struct(x.alias("x"), folder(x, F.transform(x["path"], _at)).alias("dir")))
    return rows.select("doc_id", F.inline(row)).select("doc_id", "x.*", "dir").drop("all")


def _named(sections: DataFrame, wanted: Column) -> DataFrame:
    """Adds ``file`` to the sections that are wanted; null for the others, and for those with the body of the first that shares their path."""
    name = file_slug(display_name(F.col("number"), F.col("title")))
    if "dir" not in sections.columns:
        sections = folders(sections)
    named = sections.withColumn("stem", name).withColumn("b", strip(F.regexp_replace(F.array_join("body", "\n"), r"\s+", " ")))
    named = named.withColumn("wanted", wanted)
    w = Window.partitionBy("doc_id", "dir", "stem", "wanted").orderBy("sec_no").rowsBetween(Window.unboundedPreceding, 0)
    named = named.withColumn("first", F.first("b").over(w)).withColumn("rn", F.row_number().over(w))
    named = named.withColumn("is_file", F.col("wanted") & ((F.col("rn") == 1) | (F.col("b") != F.col("first")))).withColumn("n", F.sum(F.col("is_file").cast("int")).over(w))
    file = F.concat("stem", F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise(F.lit("")), F.lit(".md"))
    return named.withColumn("file", F.when(F.col("is_file"), file)).drop("stem", "b", "first", "rn", "n", "wanted", "is_file")


def file_names(sections: DataFrame) -> DataFrame:
    """Adds ``file``: slug of the section's name; of sections that share a path (``dir``), those with the first one's body go and the others get -2, -3 behind."""
    return _named(sections, F.lit(True)).where("file is not null")


def identified(sections: DataFrame, nested: bool = False, min_body: int = MIN_BODY) -> DataFrame:
    """(doc_id, sec_no, level, number, title, body, path, crumb, section_id, parent_id, section_path, order, children): what becomes a file, and where it stands.

    Takes all sections with ``path``. The crumb links ancestors that are files and names the others;
    children are links of the files right below.
    """
    real = (body_chars(F.col("body")) >= min_body) & ~F.col("blocked")
    rows = told(sections, F.when(real, F.concat("open", F.array("sec_no"))).otherwise(F.array().cast("array<int>")), F.lit(1), "kept").withColumn("kept", F.col("kept").isNotNull())
    rows = folders(rows, nested)
    # Sections without a file, those with the body of another among them, stay as names in their document's array.
    upto_here = Window.partitionBy("doc_id").orderBy("sec_no").rowsBetween(Window.unboundedPreceding, 0)
    files = _named(rows, F.col("kept")).withColumn("order", F.sum(F.col("file").isNotNull().cast("int")).over(upto_here).cast("int"))
    d, at = _rows_of(files.withColumn("shown", display_name(F.col("number"), F.col("title")))), _at
    whole_path = lambda x: F.concat(x["dir"], F.array(x["file"]))
    label = lambda x: F.when(crumb(strip_links(x["shown"])) == "", F.lit("…")).otherwise(crumb(strip_links(x["shown"])))
    link = lambda name, x, start: F.concat(F.lit("["), name, F.lit("]("), relative(whole_path(x), start), F.lit(")"))

    def row(x: Column) -> Column:
        trail = F.transform(x["path"], lambda n: F.when(at(n)["file"].isNotNull(), link(label(at(n)), at(n), x["dir"])).otherwise(label(at(n))))
        above = F.filter(x["path"], lambda n: at(n)["file"].isNotNull())
        return F.struct(
            *[x[c].alias(c) for c in ("sec_no", "level", "number", "title", "body", "path", "order")],
            F.when(F.size(x["path"]) > 0, F.concat(F.lit("> ↑ "), F.array_join(trail, " / "))).alias("crumb"), F.array_join(whole_path(x), "/").alias("section_id"),
            F.when(F.size(above) > 0, F.array_join(whole_path(at(F.element_at(above, -1))), "/")).alias("parent_id"), F.transform(x["path"], lambda n: strip_links(at(n)["shown"])).alias("section_path"),
            F.element_at(F.concat(F.array(F.lit(None).cast("int")), x["path"]), -1).alias("up"), strip_links(x["shown"]).alias("shown"), x["dir"].alias("dir"), whole_path(x).alias("whole_path"),
        )

    rows = d.select("doc_id", F.inline(F.transform(F.filter("secs", lambda x: x["file"].isNotNull()), row)))
    listed = told(rows, F.when(F.col("up").isNotNull(), F.array("up")).otherwise(F.array().cast("array<int>")), F.struct("order", "shown", "whole_path"), "below", F.collect_list)
    children = F.transform(F.array_sort("below"), lambda x: F.concat(F.lit("- ["), x["shown"], F.lit("]("), relative(x["whole_path"], F.col("dir")), F.lit(")")))
    return listed.withColumn("children", children).drop("below", "up", "dir", "whole_path")


def tree(lines: DataFrame) -> DataFrame:
    """All sections with their ancestors."""
    return ancestors(find_parents(parse_sections(lines)))


def breadcrumbs(sections: DataFrame, min_body: int = MIN_BODY) -> DataFrame:
    """(doc_id, sec_no, crumb) of the sections that become files."""
    return identified(sections, min_body=min_body).select("doc_id", "sec_no", "crumb")


def section_files(lines: DataFrame, nested: bool = False, min_body: int = MIN_BODY) -> DataFrame:
    """(doc_id, section_id, content): the files of a document's sections, with their identity in front matter, the crumb, the text and the list of subsections."""
    return section_contents(identified(tree(lines), nested, min_body)).select("doc_id", "section_id", "content")


def section_contents(s: DataFrame) -> DataFrame:
    """Files (``identified``) with their ``content``."""
    head = frontmatter(
        ("section_path",), doc_id=F.col("doc_id").cast("string"), section_id=F.col("section_id"), parent_id=F.col("parent_id"), section_title=strip_links(F.col("title")), section_path=F.when(F.size("section_path") > 0, F.col("section_path")),
        section_number=F.col("number"), heading_level=F.col("level"), depth=F.size("section_path"), order=F.col("order"),
    )
    anchors = F.coalesce(F.array_position(F.transform("body", lambda x: ~x.rlike(PAGE_ANCHOR)), True) - 1, F.lit(0)).cast("int")
    anchors = F.when(F.forall("body", lambda x: x.rlike(PAGE_ANCHOR)), F.size("body")).otherwise(anchors)
    body = strip(F.array_join(F.slice("body", anchors + 1, F.greatest(F.size("body") - anchors, F.lit(0))), "\n"))
    parts = F.filter(
        F.array(
            F.array_join(F.concat(F.array(heading_line()), F.slice("body", F.lit(1), anchors)), "\n"), F.col("crumb"), F.when(body != "", body),
            F.when(F.size("children") > 0, F.concat(F.lit("## Subsections\n\n"), F.array_join("children", "\n"))),
        ),
        lambda x: x.isNotNull(),
    )
    return s.withColumn("content", F.concat(head, F.regexp_replace(F.array_join(parts, "\n\n"), r"\s+$", ""), F.lit("\n"))).drop("body", "children")


def index(lines: DataFrame, nested: bool = False, min_body: int = MIN_BODY) -> DataFrame:
    """(doc_id, md): a document's index, a link for each file without an ancestor that is one."""
    s = identified(tree(lines), nested, min_body).where("parent_id is null")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("order", F.concat(F.lit("- ["), "shown", F.lit("]("), "section_id", F.lit(")")).alias("line")))), lambda x: x["line"])
    return s.groupBy("doc_id").agg(F.concat(F.lit("# Split Sections: "), F.first(F.col("doc_id").cast("string")), F.lit("\n\n## Top-level Sections\n\n"), F.array_join(rows, "\n"), F.lit("\n")).alias("md"))


def chunks(lines: DataFrame, min_body: int = MIN_BODY, nested: bool = False) -> DataFrame:
    """(doc_id, sec_no, level, number, title, crumb, file, text): a row per file that would be written."""
    s = identified(tree(lines), nested, min_body)
    text = F.concat(heading_line(), F.lit("\n\n"), strip(F.array_join("body", "\n")))
    return s.select("doc_id", "sec_no", "level", "number", "title", "crumb", F.col("section_id").alias("file"), text.alias("text"))


def linked_sections(sections: DataFrame, min_body: int = MIN_BODY) -> DataFrame:
    """(doc_id, sec_no, slug, target): for each anchor that a section's text refers to the file it means: of the sections whose heading has this slug the one nearest in the tree (the fewest steps up to a common ancestor), the first of equals. Takes all sections with ``path``."""
    s = identified(sections, min_body=min_body).withColumn("chain", F.reverse(F.concat("path", F.array("sec_no"))))
    # A slug's targets are put together per ancestor (-1 is the document), so that what is joined is a step up of a section, and no pair of sections.
    want = s.select("doc_id", "sec_no", "chain", F.explode(F.array_distinct(F.regexp_extract_all(F.array_join("body", "\n"), F.lit(r"\[[^\]]+\]\(#([^)]+)\)"), 1))).alias("slug"))
    have = s.select("doc_id", slug(heading_line()).alias("slug"), F.col("order"), F.col("section_id").alias("target"), F.explode(F.concat("chain", F.array(F.lit(-1)))).alias("up")).where("slug <> ''")
    have = have.groupBy("doc_id", "slug", "up").agg(F.min(F.struct("order", "target")).alias("best"))
    steps = want.select("doc_id", "sec_no", "slug", F.posexplode(F.concat("chain", F.array(F.lit(-1)))).alias("i", "up"))
    far = F.when(F.col("up") == -1, 1 << 30).otherwise(F.col("i"))
    found = steps.join(have, ["doc_id", "slug", "up"]).select("doc_id", "sec_no", "slug", F.struct(far.alias("far"), "best.order", "best.target").alias("t"))
    return found.groupBy("doc_id", "sec_no", "slug").agg(F.min("t").alias("t")).select("doc_id", "sec_no", "slug", "t.target")
