"""Quiz items as rows: options, answers by as-of lookup, markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def answers_asof(marks: DataFrame) -> DataFrame:
    """(doc_id, question, answers): letters under the last question marker before them; earlier letters are nobody's.

    ``marks`` has doc_id, ord, question (null on letters) and letter (null on markers).
    """
    w = Window.partitionBy("doc_id").orderBy("ord", F.col("question").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    df = marks.withColumn("q", F.last("question", ignorenulls=True).over(w)).where("letter is not null and q is not null")
    return df.groupBy("doc_id", F.col("q").alias("question")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "letter"))), lambda x: x["letter"]).alias("answers"))


def question_runs(lines: DataFrame, marker: str = r"^Question (\d+)") -> DataFrame:
    """(doc_id, question, stem, options): lines between markers; lines ``A ...`` to ``H ...`` are options, what comes before the first is the stem."""
    up = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    df = lines.withColumn("mark", F.regexp_extract("line", marker, 1)).withColumn("run", F.sum((F.col("mark") != "").cast("int")).over(up)).where("run > 0")
    option = F.regexp_extract("line", r"^([A-H])[.)]? +(\S.*)$", 2)
    df = df.withColumn("option", F.when(F.col("mark") == "", option)).withColumn("seen", F.max((F.col("option") != "").cast("int")).over(Window.partitionBy("doc_id", "run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    text = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["x"])
    stem = F.when((F.col("mark") == "") & (F.coalesce("seen", F.lit(0)) == 0) & (F.trim("line") != ""), F.struct("line_no", F.trim("line").alias("x")))
    return df.groupBy("doc_id", "run").agg(
        F.max("mark").cast("int").alias("question"), F.array_join(text(stem), " ").alias("stem"), text(F.when(F.col("option") != "", F.struct("line_no", F.col("option").alias("x")))).alias("options"),
    ).drop("run")


def render(questions: DataFrame, key: bool = True) -> DataFrame:
    """(doc_id, question, md) of doc_id, question, stem, options and answers (letters or null)."""
    letter = lambda i: F.char(F.lit(65) + i)
    has = lambda i: F.coalesce(F.array_contains("answers", letter(i)), F.lit(False))
    mark = (lambda i: F.when(has(i), F.lit(" ✓")).otherwise(F.lit(""))) if key else (lambda i: F.lit(""))
    rows = F.array_join(F.transform("options", lambda x, i: F.concat(F.lit("- "), letter(i), F.lit(". "), x, mark(i))), "\n")
    answer = F.when(F.size("answers") > 0, F.concat(F.lit("**Answer:** "), F.array_join("answers", ", "))) if key else F.lit(None)
    return questions.select("doc_id", "question", F.concat_ws("\n\n", F.concat(F.lit("### Question "), F.col("question").cast("string")), F.nullif("stem", F.lit("")), F.nullif(rows, F.lit("")), answer).alias("md"))
