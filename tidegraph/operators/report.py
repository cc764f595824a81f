"""The report of a benchmark as lines of text. Figures halfway between two round up, as the JVM formats them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .metering import means

#: The heads of the report's sections.
INDEXING, QUERYING, EACH = "== Indexing (one-off)", "== Querying (mean per question)", "== Per question"
INDEXING_HEAD = "pipeline  calls    in_tok  out_tok       USD  seconds"
QUERYING_HEAD = "pipeline  recall  judge   in_tok  out_tok       USD  seconds"


def indexing_lines(usage: DataFrame) -> DataFrame:
    """usage (pipeline and usage columns), a row a pipeline: (pipeline, line)."""
    numbers = F.format_string("%-8s %6d %9d %8d %9.5f %8.1f", "pipeline", *[F.col(c).cast("long") for c in ("calls", "input_tokens", "output_tokens")], F.col("usd").cast("double"), F.col("seconds").cast("double"))
    return usage.select("pipeline", numbers.alias("line"))


def querying_lines(rows: DataFrame) -> DataFrame:
    """rows of `benchmark`: (pipeline, line) with the means of each pipeline; without a judge a dash."""
    mean = means(rows).join(rows.groupBy("pipeline").agg((F.count("judge") > 0).alias("judged")), "pipeline")
    judge = F.when(F.col("judged"), F.format_string("%.2f", F.col("judge").cast("double"))).otherwise("-")
    double = [F.col(c).cast("double") for c in ("input_tokens", "output_tokens", "usd", "seconds")]
    return mean.select("pipeline", F.format_string("%-8s %7.2f %6s %8.0f %8.0f %9.5f %8.2f", "pipeline", F.col("recall").cast("double"), judge, *double).alias("line"))


def answer_lines(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """rows of `benchmark` and questions (question_id, type): (question_id, pipeline, line), the answer under a line of its figures."""
    judged = F.when(F.col("judge").isNotNull(), F.concat(F.lit(" judge="), F.col("judge").cast("string"))).otherwise("")
    recall = F.coalesce(F.col("recall"), F.lit(0)).cast("double")
    head = F.concat(F.format_string("--- %s [%s] %s recall=%.2f", F.col("question_id").cast("string"), "type", "pipeline", recall), judged, F.format_string(" %.2fs", F.col("seconds").cast("double")))
    out = rows.join(questions.select("question_id", "type"), "question_id")
    return out.select("question_id", "pipeline", F.concat(head, F.lit("\n"), strip(F.coalesce("answer", F.lit("")))).alias("line"))


def report(title: str, indexing: DataFrame, rows: DataFrame, questions: DataFrame) -> DataFrame:
    """(section, question_id, pipeline, line): the whole report; ordered by the first three it reads from top to bottom."""
    spark = rows.sparkSession
    heads = [(0, title + "\n"), (1, INDEXING), (2, INDEXING_HEAD), (4, "\n" + QUERYING), (5, QUERYING_HEAD), (7, "\n" + EACH)]
    out = spark.createDataFrame(heads, "section int, line string").select("section", F.lit(None).cast("string").alias("question_id"), F.lit(None).cast("string").alias("pipeline"), "line")
    blank = F.lit(None).cast("string").alias("question_id")
    out = out.unionByName(indexing_lines(indexing).select(F.lit(3).alias("section"), blank, "pipeline", "line"))
    out = out.unionByName(querying_lines(rows).select(F.lit(6).alias("section"), blank, "pipeline", "line"))
    return out.unionByName(answer_lines(rows, questions).select(F.lit(8).alias("section"), F.col("question_id").cast("string"), "pipeline", "line"))


def write_report(lines: DataFrame, folder: str) -> None:
    """The report as text, its parts in order of their names."""
    lines.orderBy("section", "question_id", "pipeline").select("line").write.mode("overwrite").text(folder)
