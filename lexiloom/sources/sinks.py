"""Writers. Directories of part files unless said otherwise; none overwrites unless told to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.storage import discard, materialize

#: How csv is written and read: a quote within quotes is doubled.
CSV = {"header": True, "quote": '"', "escape": '"', "emptyValue": '""', "lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


#: Documents a file holds at most, as readers that take a file whole hold all of it.
FILE_DOCUMENTS = 2000


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_corpus(docs: DataFrame, path: str, order: Sequence[str], overwrite: bool = False) -> None:
    """Sentences on lines, a blank line after each document, the last of a part file too, so that reading back loses none; part files in order."""
    text = docs.repartitionByRange(*order).sortWithinPartitions(*order).select(F.array_join("sentences", "\n").alias("value"))
    text.write.mode(_mode(overwrite)).option("maxRecordsPerFile", FILE_DOCUMENTS).text(path, lineSep="\n\n")


def write_articles(articles: DataFrame, path: str, overwrite: bool = False) -> None:
    """Marked-up articles, one a row (value), each from its marker's line on; files of FILE_DOCUMENTS at most."""
    articles.select("value").write.mode(_mode(overwrite)).option("maxRecordsPerFile", FILE_DOCUMENTS).text(path)


def write_shards(docs: DataFrame, path: str, order: Sequence[str], overwrite: bool = False) -> None:
    """A directory a shard_id (see operators.documents.shard_ids), documents in order within."""
    rows = docs.repartition("shard_id").sortWithinPartitions("shard_id", *order)
    rows.select("shard_id", F.array_join("sentences", "\n").alias("value")).write.mode(_mode(overwrite)).partitionBy("shard_id").text(path, lineSep="\n\n")


def write_lines_and_info(lines: DataFrame, info: DataFrame, path: str, overwrite: bool = False) -> None:
    """A raw corpus, a line a row in the order of `order`, and its description as JSON."""
    lines.repartitionByRange("order").sortWithinPartitions("order").select("value").write.mode(_mode(overwrite)).text(f"{path}/corpus")
    info.write.mode(_mode(overwrite)).json(f"{path}/info")


def write_splits(rows: DataFrame, path: str, kind: str, overwrite: bool = False) -> None:
    """A directory a split, as csv or JSON lines. Fields of csv may hold quotes, separators and line breaks; an empty string stays apart from null."""
    if kind not in ("csv", "json"):
        raise ValueError(f"unknown kind {kind!r}: csv or json")
    writer = rows.write.mode(_mode(overwrite)).partitionBy("split")
    writer.csv(path, **CSV) if kind == "csv" else writer.json(path)


def vocabulary_lines(vocab: DataFrame) -> DataFrame:
    """(id, token) with a blank token at every id that no token has, so that line numbers are ids again."""
    span = vocab.agg(F.explode(F.sequence(F.lit(0).cast("long"), F.max("id").cast("long"))).alias("id"))
    return span.join(vocab.select(F.col("id").cast("long").alias("id"), "token"), "id", "left").select("id", F.coalesce("token", F.lit("")).alias("token"))


def write_vocabulary(vocab: DataFrame, path: str, overwrite: bool = False) -> None:
    """One text file; a vocabulary has a bounded number of lines."""
    vocabulary_lines(vocab).coalesce(1).sortWithinPartitions("id").select(F.col("token").alias("value")).write.mode(_mode(overwrite)).text(path)


def write_predictions(rows: DataFrame, path: str, order: Sequence[str], overwrite: bool = False, labels: Sequence[str] | None = None) -> None:
    """Prediction logs with a header; with labels, the ids in label and prediction become the labels they stand for."""
    if labels is not None:
        known = F.array(*[F.lit(x) for x in labels])
        named = lambda c: F.when(F.col(c).cast("int") >= 0, F.get(known, F.col(c).cast("int"))).otherwise(F.col(c).cast("string"))
        rows = rows.withColumns({c: named(c) for c in ("label", "prediction")})
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(_mode(overwrite)).csv(path, sep="\t", header=True)


def write_answers(nbest: DataFrame, path: str, overwrite: bool = False) -> None:
    """predictions and n-best lists of operators.qa.answers as JSON lines, keyed by id."""
    nbest = materialize(nbest, "nbest")  # found once for the three
    nbest.select("id", F.col("chosen").alias("prediction")).distinct().write.mode(_mode(overwrite)).json(f"{path}/predictions")
    lists = F.array_sort(F.collect_list(F.struct("rank", "text", "score", "probability")))
    nbest.groupBy("id").agg(lists.alias("nbest")).write.mode(_mode(overwrite)).json(f"{path}/nbest_predictions")
    nulls = nbest.where("text = ''").groupBy("id").agg(F.max("score").alias("null_score"))
    best = nbest.where("text <> ''").groupBy("id").agg(F.max("score").alias("best_score"))
    nulls.join(best, "id", "left").select("id", (F.col("null_score") - F.coalesce("best_score", F.lit(0.0))).alias("null_odds")).write.mode(_mode(overwrite)).json(f"{path}/null_odds")
    discard(nbest)


def write_summary(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    rows.write.mode(_mode(overwrite)).csv(path, **CSV)
