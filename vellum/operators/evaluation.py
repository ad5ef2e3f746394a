"""Preparing and reading evaluations: labelled questions, variants of a corpus, settings, logs and headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_heading
from .metrics import nearest_rank

QUESTIONS = "id long, kind string, question string, source string, answer_span string, type string, note string, variants array<string>, answer_spans array<string>"
#: Bold text up to so many characters may be a heading.
SHORT = 40


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Labelled questions of a JSON-lines file; blank lines are none, lines that aren't JSON an error."""
    return spark.read.schema(QUESTIONS).option("mode", "FAILFAST").json(path)


def admitted_questions(made: DataFrame, texts: DataFrame) -> DataFrame:
    """Generated questions (source, question, answer_span) that aren't empty, and whose span stands in the text (source, text) word for word."""
    whole = (F.trim("question") != "") & (F.trim("answer_span") != "")
    return made.where(F.coalesce(whole, F.lit(False))).join(texts, "source").where(F.contains("text", F.col("answer_span"))).drop("text")


def paraphrased(questions: DataFrame, n: int = 2) -> DataFrame:
    """Questions with their first ``n`` variants, trimmed; those without any are left out."""
    kept = F.slice(F.filter(F.transform("variants", lambda v: F.trim(v)), lambda v: F.coalesce(v != "", F.lit(False))), 1, n)
    return questions.withColumn("variants", kept).where(F.size("variants") > 0)


def shifted_numbers(line: Column, offset: Column) -> Column:
    """A line of which every whole number is larger by ``offset``."""
    gaps, numbers = F.split(line, r"\d+"), F.regexp_extract_all(line, F.lit(r"\d+"), 0)
    moved = F.transform(numbers, lambda n: (n.cast("decimal(38,0)") + offset).cast("string"))
    return F.array_join(F.zip_with(gaps, moved, lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")


def department_variants(texts: DataFrame, departments: DataFrame) -> DataFrame:
    """(file, department, text): each text for each department, its title prefixed and its numbers moved by the department's offset.

    ``departments`` (department, offset) is a list of the organisation's units, tens of rows; it travels as an array.
    """
    listed = departments.agg(F.collect_list(F.struct("department", "offset")).alias("units"))
    units = [r.asDict() for r in listed.first()["units"]]
    if not units:
        return texts.select("file", F.lit(None).cast("string").alias("department"), "text").limit(0)
    each = texts.withColumn("unit", F.explode(F.array(*[F.struct(F.lit(u["department"]).alias("department"), F.lit(u["offset"]).alias("offset")) for u in units])))
    moved = F.transform(F.split("text", "\n"), lambda line, i: F.when(i == 0, F.concat(F.col("unit.department"), F.lit(" "), line)).otherwise(shifted_numbers(line, F.col("unit.offset"))))
    return each.select(F.concat(F.lit("dept_"), "unit.department", F.lit("_"), "file").alias("file"), F.col("unit.department").alias("department"), F.array_join(moved, "\n").alias("text"))


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """(event, n) of a log whose lines hold JSON objects with the key event, among other text."""
    event = F.get_json_object(F.regexp_extract("value", r"\{.*\}", 0), "$.event")
    return spark.read.text(path).select(event.alias("event")).where("event IS NOT NULL").groupBy("event").agg(F.count(F.lit(1)).alias("n"))


def compared_settings(example: DataFrame, defaults: DataFrame) -> DataFrame:
    """(name, state): whether an example of settings (name, value) has a default's value, another one, or lacks it."""
    both = defaults.select("name", F.col("value").alias("_default")).join(example.select("name", F.col("value").alias("_given"), F.lit(True).alias("_there")), "name", "left")
    return both.select("name", F.when(F.col("_there").isNull(), "missing").when(F.col("_given").eqNullSafe(F.col("_default")), "same").otherwise("different").alias("state"))


def layered(*levels: str) -> Column:
    """A property said on several levels, the nearest first: run, paragraph mark, style, document."""
    return F.coalesce(*map(F.col, levels))


def heading_candidates(paragraphs: DataFrame) -> DataFrame:
    """By file: paragraphs (file, text, bold, size) that are bold, bold and short, and larger than the middle of the others."""
    middle = paragraphs.where("NOT bold AND size IS NOT NULL").groupBy("file").agg(F.median("size").alias("_middle"))
    rows = paragraphs.join(middle, "file", "left")
    short, larger = F.length("text") <= SHORT, F.coalesce(F.col("size") > F.col("_middle"), F.lit(False))
    return rows.groupBy("file").agg(
        F.count_if("bold").alias("bold"), F.count_if(F.col("bold") & short).alias("bold_short"), F.count_if(F.col("bold") & is_heading(F.col("text"))).alias("bold_title"), F.count_if(larger).alias("larger"), F.count_if(larger & short).alias("larger_short")
    )


def table_lengths(chunks: DataFrame, size: int = 512) -> DataFrame:
    """Lengths of table chunks (source_file, kind, content) by file and, with file "total", over all."""
    tables = chunks.where("kind = 'table'").select("source_file", F.length("content").alias("n"))
    return tables.rollup("source_file").agg(F.count(F.lit(1)).alias("tables"), nearest_rank("n", 0.5).alias("p50"), nearest_rank("n", 0.9).alias("p90"), F.max("n").alias("longest"), F.count_if(F.col("n") > 2 * size).alias("long")).withColumn("source_file", F.coalesce("source_file", F.lit("total")))


def judged_at_levels(pool: DataFrame, snippets: tuple[int, ...]) -> DataFrame:
    """A fixed pool of candidates (question_id, rank, content), formatted for a judge at each length of snippet."""
    entry = F.concat(F.col("rank").cast("string"), F.lit(". "), F.left("content", F.col("level")))
    at = pool.withColumn("level", F.explode(F.array(*map(F.lit, snippets))))
    return at.groupBy("question_id", "level").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))), lambda x: x["e"]), "\n").alias("candidates"))


def scan_of(df: DataFrame, table: str) -> list[dict[str, str]]:
    """The scans of ``df``'s plan that read ``table``, a folder or file: columns read, filters, and filters pushed down.

    What is read comes from the scan's own relation, as Spark shortens long paths in the text of a plan.
    """
    leaves, found = df._jdf.queryExecution().sparkPlan().collectLeaves(), []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if "FileSourceScan" in leaf.getClass().getSimpleName():
            roots = leaf.relation().location().rootPaths()
            names = [roots.apply(k).toString().rstrip("/").rsplit("/", 1)[-1] for k in range(roots.size())]
            if table in {n.removesuffix(".parquet") for n in names} | set(names):
                found.append({"columns": leaf.requiredSchema().simpleString(), "filters": leaf.dataFilters().mkString(" AND "), "pushed": leaf.metadata().apply("PushedFilters")})
    return found
