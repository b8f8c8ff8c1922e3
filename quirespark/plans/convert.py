"""From documents to chunks in one call, by a preset or by single options.

The stages are those of a conversion: clean-up, levels, repair, structure, captions, split. Each takes and
gives (doc_id, md); a stage that the options leave out passes its input on. Between clean-up, heading stages and
split the texts are written to the checkpoint folder, so that a lost executor costs a stage and no plan holds them all.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import links, normalize, repair, sections, structure
from ..operators.lines import collect_lines, explode_lines
from ..session import checkpointed


@dataclass(frozen=True)
class Options:
    """What a conversion does. ``min_body`` is the least text of a file; ``target_chars`` packs sections up to a size."""

    cleanup: str = "basic"
    cross_refs: str = "keep"
    strip_templates: bool = True
    normalize_headings: bool = True
    repair_headings: bool = True
    regenerate_toc: bool = False
    nested: bool = True
    min_level: int | None = None
    min_body: int = sections.MIN_BODY
    english_only: bool = False
    target_chars: int | None = None


PRESETS = {
    "rag-default": Options(), "flat": Options(nested=False, normalize_headings=False), "textbook": Options(cleanup="aggressive", min_level=3),
    "archival": Options(cleanup="off", strip_templates=False, normalize_headings=False, repair_headings=False, min_level=1), "qti": Options(cleanup="off", strip_templates=False, normalize_headings=False, repair_headings=False, nested=False, min_level=1),
}


def options(preset: str = "rag-default", **changes) -> Options:
    """A preset with changes; options given as None keep the preset's value."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}; there are {', '.join(sorted(PRESETS))}")
    known = asdict(PRESETS[preset])
    if wrong := set(changes) - set(known):
        raise ValueError(f"unknown options {sorted(wrong)}; there are {', '.join(known)}")
    return replace(PRESETS[preset], **{k: v for k, v in changes.items() if v is not None})


def structured(docs: DataFrame, o: Options, captions: DataFrame | None = None) -> DataFrame:
    """(doc_id, md) after all stages before the split."""
    df = docs.select("doc_id", "md")
    if o.strip_templates:
        df = df.withColumn("md", structure.strip_template_pages(F.col("md")))
    df = structure.cleanup(df, o.cleanup, o.cross_refs)
    lines = explode_lines(checkpointed(df))
    if o.normalize_headings:
        lines = normalize.normalize(lines)
    if o.repair_headings:
        lines = repair.repair_headings(lines).select("doc_id", "line_no", "line")
    if o.regenerate_toc:
        lines = structure._renumbered(structure.regenerate_toc(lines))
    df = collect_lines(lines)
    return links.inject_captions(df, captions) if captions is not None else df


def convert(spark: SparkSession, docs: DataFrame, config: str | Options = "rag-default", captions: DataFrame | None = None) -> DataFrame:
    """(doc_id, sec_no, part, level, number, title, crumb, section_id, parent_id, text): the chunks of documents (doc_id, md).

    ``config`` is a preset's name or options; ``captions`` (doc_id, basename, caption, mermaid) go to their images.
    Documents without text, or without a section of enough text, have no chunk.
    """
    o = options(config) if isinstance(config, str) else config
    lines = explode_lines(checkpointed(structured(docs.where("md is not null"), o, captions)))
    tree = sections.ancestors(sections.find_parents(sections.parse_sections(lines, min_level=o.min_level)))
    if o.english_only:
        tree = sections.english_sections(tree)
    found = sections.identified(tree, o.nested, o.min_body)
    text = F.concat(sections.heading_line(), F.lit("\n\n"), F.regexp_replace(F.array_join("body", "\n"), r"^\s+|\s+$", ""))
    if o.target_chars is None:
        return found.select("doc_id", "sec_no", F.lit(1).alias("part"), "level", "number", "title", "crumb", "section_id", "parent_id", text.alias("text"))
    found = checkpointed(found)
    packed = sections.pack_sections(sections.keep_sections(tree, o.min_body), o.target_chars)
    ids = found.select("doc_id", "sec_no", "crumb", "section_id", "parent_id")
    return packed.join(ids, ["doc_id", "sec_no"]).select("doc_id", "sec_no", "part", "level", "number", "title", "crumb", "section_id", "parent_id", text.alias("text"))
