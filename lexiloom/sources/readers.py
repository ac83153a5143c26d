"""Readers. Paths may lie in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions.text import strip_right
from lexiloom.operators.documents import ARTICLE, documents_of_lines
from lexiloom.sources.sinks import CSV
from lexiloom.storage import ranked

CHOICE_SCHEMA = "context string, choice_a string, choice_b string, choice_c string, choice_d string, label string"
READING_SCHEMA = "qid string, question string, answer string, timestamp string, documents array<struct<text:string,score:int>>"


def blank_line_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc_idx, sentences) of text files whose blank lines end documents; a file is read whole, so its order holds."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.posexplode(documents_of_lines(F.col("value"))).alias("doc_idx", "sentences"))


def articles(spark: SparkSession, path: str) -> DataFrame:
    """(path, article_idx, article) of marked-up text files: each article from its marker's line to the next; a file is read whole."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parts = F.filter(F.split("value", f"(?m)^(?={ARTICLE}$)"), lambda x: x.startswith(ARTICLE))
    return files.select("path", F.posexplode(parts).alias("article_idx", "article")).withColumn("article", F.concat(F.lit("\n"), F.regexp_replace("article", "\n+\\z", "")))


def lines(spark: SparkSession, path: str | None = None, directory: str | None = None) -> DataFrame:
    """(value) lines of one file or, if none is named, of a directory's text files."""
    if not path and not directory:
        raise ValueError("name a file or a directory")
    return spark.read.text(path or f"{directory}/*.txt")


def json_splits(spark: SparkSession, directory: str, schema: str | T.StructType = CHOICE_SCHEMA, names: dict[str, str] | None = None) -> DataFrame:
    """JSON lines of a directory's split files, plain or gzipped, with their split."""
    names = names or {"train": "train.jsonl", "dev": "development.jsonl", "test": "test.jsonl"}
    parts = [spark.read.schema(schema).json(f"{directory}/{file}").withColumn("split", F.lit(split)) for split, file in names.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def json_rows(spark: SparkSession, path: str, schema: str | T.StructType = READING_SCHEMA) -> DataFrame:
    """JSON lines; gzip by file name."""
    return spark.read.schema(schema).json(path)


def first_match(spark: SparkSession, pattern: str) -> str | None:
    """The first path by name that matches a pattern, in whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    return min((str(x.getPath()) for x in found or []), default=None)


def kind_of(spark: SparkSession, path: str) -> str:
    """What a file's name ends in, or that of a directory's first part file."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return (name if "." in name else first_match(spark, f"{path}/part-*") or name).rpartition(".")[2].lower()


def evaluation_splits(spark: SparkSession, directory: str, steps: tuple[str, ...] = ("train", "dev", "test"), **files: str) -> dict[str, DataFrame]:
    """{split: rows} of a directory's first train*, dev* and test* file by name, of the directories of part files that write_splits makes, or of files or directories named by split; dev is called validation.

    All must be of one kind, csv or json, which file names tell, also those of splits
    that steps leaves out; a split without a file is left out.
    """
    found = lambda s: first_match(spark, f"{directory}/{s}*") or first_match(spark, f"{directory}/split={s}")
    paths = {s: files.get(s) or found(s) for s in ("train", "dev", "test")}
    kinds = {kind_of(spark, p) for p in paths.values() if p}
    if len(kinds) != 1 or not kinds <= {"csv", "json"}:
        raise ValueError(f"the files of {directory} must be of one kind, csv or json, not {sorted(kinds)}")
    read = (lambda p: csv_rows(spark, p)) if kinds == {"csv"} else spark.read.json
    return {("validation" if s == "dev" else s): read(p) for s, p in paths.items() if p and s in steps}


def csv_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with a header as write_splits gives it: quotes within fields doubled, fields with separators and line breaks; an empty field is null, a quoted empty one is an empty string."""
    return spark.read.csv(path, multiLine=True, nullValue="\0", **{k: v for k, v in CSV.items() if k not in ("emptyValue", "lineSep")}, emptyValue="")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a vocabulary file: a token a line, up to the first tab; the line number is its id; of duplicates the last line counts."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("id", "line"))
    return rows.groupBy(F.split("line", "\t")[0].alias("token")).agg(F.max("id").alias("id"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word) lines of a list, right-trimmed, blanks gone."""
    return spark.read.text(path).select(strip_right(F.col("value")).alias("word")).where("word <> ''")


def rule_table(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(class, key, value) of a nested JSON table {class: {key: value}}; value is the SQL type of the innermost."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,map<string,{value}>>").alias("t"))
    outer = whole.select(F.explode("t").alias("class", "inner"))
    return outer.select("class", F.explode("inner").alias("key", "value"))


def prediction_logs(spark: SparkSession, root: str, stage: str, schema: str = "index string, label string, prediction string") -> DataFrame:
    """Rows of every setting's prediction file, or directory of part files, under a root, with setting, its directory's name, and stage."""
    rows = spark.read.schema(schema).csv(f"{root}/*/{stage}_predictions.tsv", sep="\t", header=True)
    return rows.withColumn("setting", setting_of(f"{stage}_predictions.tsv")).withColumn("stage", F.lit(stage))


def setting_of(file: str) -> Column:
    """The name of the directory that holds a file, or a directory of part files, of the given name."""
    return F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)/{file.replace('.', '[.]')}(/|$)", 1)


def metric_files(spark: SparkSession, root: str, stage: str) -> DataFrame:
    """exact and f1 of every setting's metrics file."""
    rows = spark.read.schema("exact double, f1 double").json(f"{root}/*/{stage}_metrics.json", multiLine=True)
    return rows.withColumn("setting", setting_of(f"{stage}_metrics.json")).withColumn("stage", F.lit(stage))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, sentences): a document a conversation, in the order of its turns."""
    pairs = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return turns.groupBy("conv_id").agg(F.transform(pairs, lambda p: p["text"]).alias("sentences"))


def numbered(rows: DataFrame, order: str, name: str = "doc_id") -> DataFrame:
    """Dense ids from 0 in a unique order."""
    return ranked(rows, [], [order], name, "numbered").withColumn(name, F.col(name) - 1)
