"""Files in and tables out: Markdown, JSON, DOCX through a converter, definitions, resumable sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.markdown import clean
from ..functions.text import without_nan

ARTICLE = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "number", "title", "hierarchy", "section", "chapter", "paragraph", "context")])
DEFINITION = "keyword string, keyword_kz string, relation string, definition_ru string, definition_kz string, language string"


def _name(df: DataFrame) -> DataFrame:
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    known = F.regexp_extract(stem, r"^(.*)_(ru|kz)$", 2)
    return df.withColumn("code", F.when(known != "", F.regexp_replace(stem, r"_(ru|kz)$", "")).otherwise(stem)).withColumn("lang", F.when(known != "", known).otherwise("unknown"))


def texts(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, text) of whole files, at any depth."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(path, code, lang, text) of Markdown files; code and language come from the name."""
    return _name(texts(spark, folder, "*.md"))


def cleaned_markdown(files: DataFrame) -> DataFrame:
    """Files with their texts cleaned again."""
    return files.withColumn("text", clean(F.col("text")))


def docx(spark: SparkSession, folder: str, convert: Callable[[bytes], str], done: DataFrame | None = None) -> DataFrame:
    """(path, text, error) of DOCX files through a converter to Markdown, cleaned.

    Lock files are passed over, and paths that ``done`` has.  A file that the converter
    cannot read gives a row with its error; the others go on.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(folder).select("path", "content")
    found = found.where(~F.regexp_extract("path", r"([^/]+)$", 1).startswith("~$"))
    if done is not None:
        found = found.join(done.select("path"), "path", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((path, convert(bytes(content)), None))
                except Exception as error:  # one file's failure is a row, not the job's
                    rows.append((path, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    out = found.mapInPandas(run, "path string, text string, error string")
    return out.withColumn("text", clean(F.col("text")))


def articles(spark: SparkSession, folder: str, schema: T.StructType = ARTICLE) -> DataFrame:
    """(path, code, lang, pos, *schema) from JSON lists of articles; a file that is no list fails the read."""
    raw = _name(texts(spark, folder, "*.json"))
    listed = F.from_json("text", T.ArrayType(schema), {"mode": "FAILFAST"})
    return raw.select("path", "code", "lang", F.posexplode(listed).alias("pos", "a")).select("path", "code", "lang", "pos", "a.*")


def pairs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Codes that have files of both languages, and the files of other codes."""
    both = files.where(F.col("lang").isin("ru", "kz")).groupBy("code").agg(F.count_distinct("lang").alias("_n")).where(F.col("_n") == 2).select("code")
    return both, files.join(both, "code", "left_anti")


def common(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keys in both tables, in the first alone, and in the second alone."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.intersect(y), x.exceptAll(y), y.exceptAll(x)


def definitions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Definitions of one-object files, and the paths of files that have none.

    Unreadable files, lists, and objects without keyword or Russian definition are
    rejected.
    """
    raw = texts(spark, folder, "*.json").withColumn("d", F.when(~F.trim("text").startswith("["), F.from_json("text", DEFINITION)))
    filled = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rows = raw.select(
        "path", filled(F.col("d.keyword")).alias("keyword_ru"), filled(F.col("d.keyword_kz")).alias("keyword_kz"), filled(F.col("d.definition_ru")).alias("definition_ru"),
        filled(F.col("d.definition_kz")).alias("definition_kz"), F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file"),
    )
    ok = (F.col("keyword_ru") != "") & (F.col("definition_ru") != "")
    return rows.where(ok).drop("path"), rows.where(~ok).select("path")


def single_text_article(files: DataFrame) -> DataFrame:
    """Plain-text files as one article each."""
    blank = F.lit("")
    return files.select(F.col("code").alias("id"), blank.alias("number"), F.col("code").alias("title_ru"), blank.alias("title_kz"), F.col("text").alias("body_ru"), blank.alias("body_kz"), F.lit("0").alias("has_kz"))


def pandoc(content: bytes, command: str = "pandoc") -> str:
    """Markdown of a DOCX file by the pandoc program, which has to be installed where the workers run."""
    import subprocess
    import tempfile

    with tempfile.NamedTemporaryFile(suffix=".docx") as f:
        f.write(content)
        f.flush()
        made = subprocess.run([command, "--from=docx", "--to=markdown", "--wrap=none", "--markdown-headings=atx", f.name], capture_output=True, check=True)
    return made.stdout.decode()


def finite(value: Column, kind: T.DataType) -> Column:
    """The value with null for not-a-number and infinities, at any depth."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return without_nan(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: finite(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[finite(value[f.name], f.dataType).alias(f.name) for f in kind]))
    return value


def write(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """Replace a table; Spark's commit makes it whole or leaves it out.  Not-a-number becomes null in JSON, at any depth."""
    if kind == "json":
        df = df.select(*[finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).format(kind).save(path)


def remaining(todo: DataFrame, spark: SparkSession, path: str, key: str) -> DataFrame:
    """Rows whose key the table at ``path`` lacks; all rows where there is no readable table."""
    from pyspark.errors import AnalysisException

    try:
        done = spark.read.parquet(path).select(key)
    except AnalysisException:
        return todo
    return todo.join(done, key, "left_anti")


def write_unique(df: DataFrame, path: str, keys: list[str], buckets: int = 0) -> None:
    """Replace a table whose keys are unique and not null; rows that break that are an error and nothing is replaced.

    With ``buckets`` the rows are cut by the keys, so that look-ups read a part.
    """
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) | missing)
    if found := twice.drop("_n").first():
        raise ValueError(f"not a unique key: {found.asDict()}")
    cut = df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))) if buckets else df
    write(cut, path, by=["bucket"] if buckets else None)


def clear(spark: SparkSession, path: str) -> int:
    """Empty the table at ``path``, which keeps its columns; returns how many rows it had."""
    from pyspark.errors import AnalysisException

    try:
        held = spark.read.parquet(path)
    except AnalysisException:
        return 0
    n = held.count()
    spark.createDataFrame([], held.schema).write.mode("overwrite").parquet(path)
    return n


def append(df: DataFrame, path: str) -> None:
    """Add finished rows to a checkpoint table."""
    df.write.mode("append").parquet(path)


def first_rows(df: DataFrame, order: str, limit: int | None) -> DataFrame:
    """The first rows in order, or all of them: a limit for trial runs."""
    return df.orderBy(order).limit(limit) if limit else df


def alive(spark: SparkSession) -> bool:
    """Whether the session answers."""
    return spark.sql("select 1 as ok").first()["ok"] == 1
