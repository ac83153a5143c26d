"""Evaluation datasets: column roles, splits, conversion and batches."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Mapping, Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexiloom.functions.text import SPACES, drop_spaces
from lexiloom.operators.documents import flatten_documents
from lexiloom.storage import fresh, ranked


def select_columns(rows: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Only the mapped columns, renamed."""
    return rows.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()])


def split_by_range(column: Column, train_below: str, test_from: str) -> Column:
    """train, dev or test by string comparison: before train_below, between, from test_from on."""
    return F.when(column < train_below, "train").when(column < test_from, "dev").otherwise("test")


def shuffled_order(key: Column, seed: int | None) -> Column:
    """An order for a seeded shuffle that doesn't depend on partitions; the key's own without a seed."""
    return key if seed is None else F.xxhash64(key, F.lit(seed))


def shuffled(rows: DataFrame, key: str, seed: int | None) -> DataFrame:
    """Add place, from 0: rows in an order that the seed and a unique key alone decide; in the key's own without a seed."""
    order = fresh(rows, "order")
    out = ranked(rows.withColumn(order, shuffled_order(F.col(key), seed)), [], [order, key], "place", "shuffled")
    return out.withColumn("place", F.col("place") - 1).drop(order)


def ratios(spec: str) -> tuple[int, int, int]:
    parts = [int(x) for x in spec.split("/")]
    if len(parts) != 3 or parts[0] <= 0 or parts[1] < 0 or parts[2] <= 0:
        raise ValueError(f"bad ratio {spec!r}: train and test must be positive, dev not negative")
    return parts[0], parts[1], parts[2]


def split_by_ratio(rows: DataFrame, order: str, spec: str = "8/1/1") -> DataFrame:
    """Add split: contiguous parts of the order, train first; a dev part of 0 leaves two splits. Shares of the held part round up for test."""
    train, dev, test = ratios(spec)
    place = fresh(rows, "place")
    out = ranked(rows, [], [order], place, "ratio")
    n = out.count()
    held = -(-n * (dev + test) // (train + dev + test))
    tests = -(-held * test // (dev + test))
    split = F.when(F.col(place) <= n - held, "train").when(F.col(place) <= n - tests, "dev").otherwise("test")
    return out.withColumn("split", split).drop(place)


def letter_index(label: Column, letters: str = "abcd") -> Column:
    return F.instr(F.lit(letters), label) - 1


def label_ids(rows: DataFrame, column: str = "label") -> DataFrame:
    """(label, id): distinct labels by ascending label; the ids of a sorted list, unlike those of an unordered one."""
    return rows.select(column).distinct().withColumn("id", F.row_number().over(Window.orderBy(column)) - 1)


def convert_reviews(rows: DataFrame, text: str, stars: str) -> DataFrame:
    """Classification rows (sentence1, label)."""
    return select_columns(rows, {text: "sentence1", stars: "label"})


def convert_choices(rows: DataFrame) -> DataFrame:
    """Multiple-choice rows: texts without white space, choice_a..choice_d as choice_0..choice_3, the label's index."""
    choices = [drop_spaces(F.col(f"choice_{c}")).alias(f"choice_{i}") for i, c in enumerate("abcd")]
    return rows.select(drop_spaces(F.col("context")).alias("context"), *choices, letter_index(F.col("label")).alias("label"))


def convert_reading(rows: DataFrame) -> DataFrame:
    """Question answering over retrieved documents: (id, title, context, question, answers, split).

    A row a document, from 1; ids append its number in four digits. Scores under 2
    mean that the document doesn't answer; else the answer starts at its first
    occurrence, which must exist.
    """
    flat = flatten_documents(rows, "documents")
    context, score = F.col("`documents.text`"), F.col("`documents.score`")
    start = F.instr(context, F.col("answer")) - 1
    checked = F.when(start >= 0, start.cast("int")).otherwise(F.raise_error(F.concat(F.lit("answer not in document of "), "qid")).cast("int"))
    text, at = F.array().cast("array<string>"), F.array().cast("array<int>")
    answers = F.when(score < 2, F.struct(text.alias("text"), at.alias("answer_start"))).otherwise(F.struct(F.array("answer").alias("text"), F.array(checked).alias("answer_start")))
    return flat.select(
        F.format_string("%s%04d", "qid", F.col("doc_id")).alias("id"),
        F.col("qid").alias("title"),
        context.alias("context"),
        "question",
        answers.alias("answers"),
        split_by_range(F.col("timestamp"), "2009", "2010").alias("split"),
    )


def shortest_run(surfaces: Sequence[str], answer: str) -> tuple[int, int] | None:
    """The first of the shortest runs of parts whose concatenation holds an answer: (first, end)."""
    whole, ends = "".join(surfaces), list(accumulate(map(len, surfaces)))
    best, at = None, whole.find(answer)
    while at >= 0:
        run = bisect_right(ends, at), bisect_left(ends, at + len(answer)) + 1
        if best is None or run[1] - run[0] < best[1] - best[0]:
            best = run
        at = whole.find(answer, at + 1)
    return best


@F.pandas_udf(T.StringType())
def run_forms(surfaces: pd.Series, forms: pd.Series, answer: pd.Series) -> pd.Series:
    def one(own: Sequence[str] | None, other: Sequence[str] | None, text: str | None) -> str | None:
        run = shortest_run(own, text) if own is not None and text else None
        return None if run is None else "".join(other[run[0] : run[1]])

    return pd.Series(list(map(one, surfaces, forms, answer)), dtype="object")


def relocated_answer(answer: Column, context: Column, normalized_answer: Column, surfaces: Column, forms: Column) -> Column:
    """The answer as it stands in a normalized context: the raw one if it is there, else the normalized one, else the
    word forms of the shortest run of morphemes whose surfaces hold it, the first of equals; null if none does."""
    there, also = F.contains(context, answer), F.contains(context, normalized_answer)
    missing = F.when(~(there | also), surfaces)  # only rows that need it are searched
    return F.when(there, answer).when(also, normalized_answer).otherwise(run_forms(missing, forms, answer))


def spaced_span(context: Column, answer: Column) -> Column:
    """struct<start, end> of an answer in a context, both without regard to white space; null where it isn't."""
    chars = F.transform(F.split(context, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    solid = F.filter(chars, lambda x: (x["c"] != "") & ~x["c"].rlike(f"[{SPACES}]"))
    bare = drop_spaces(answer)
    at = F.instr(F.array_join(F.transform(solid, lambda x: x["c"]), ""), bare)
    first, last = F.get(solid, at - 1)["i"], F.get(solid, at + F.char_length(bare) - 2)["i"]
    return F.when((at > 0) & (bare != ""), F.struct(first.cast("int").alias("start"), (last + 1).cast("int").alias("end")))


def limit_rows(rows: DataFrame, order: Sequence[str], n: int | None) -> DataFrame:
    return rows if n is None else rows.orderBy(*order).limit(n)


def column_roles(columns: Sequence[str], task: str) -> dict[str, str | list[str] | None]:
    """Which columns play which role, by name first and by place where names say nothing."""
    if task == "classification":
        label = "label" if "label" in columns else columns[-1]
        texts = [c for c in columns if c.startswith("sentence")] or [c for c in columns if c != label][:2]
        return {"label": label, "texts": texts}
    if task == "multiple_choice":
        choices = [c for c in columns if c.startswith("choice")]
        rest = [c for c in columns if c not in choices]
        return {"choices": choices, "context": "context" if "context" in columns else rest[0], "label": "label" if "label" in columns else rest[-1]}
    if task == "qa":
        return {role: role if role in columns else columns[i] for i, role in enumerate(("question", "context", "answers"))}
    raise ValueError(f"unknown task {task!r}")


def explode_choices(rows: DataFrame, choices: Sequence[str], context: str = "context") -> DataFrame:
    """A row a choice, with choice_idx: the context and the choice as a pair to encode."""
    others = [c for c in rows.columns if c not in (*choices, context)]
    return rows.select(*others, F.col(context).alias("text_a"), F.posexplode(F.array(*choices)).alias("choice_idx", "text_b"))


def regroup_choices(rows: DataFrame, keys: Sequence[str], encoded: Sequence[str]) -> DataFrame:
    """The inverse: encoded columns as arrays in the order of choice_idx; each group has as many rows as a question has choices."""
    one = F.array_sort(F.collect_list(F.struct("choice_idx", *encoded)))
    grouped = rows.groupBy(*keys).agg(one.alias("__all"))
    return grouped.select(*keys, *[F.col("__all")[c].alias(c) for c in encoded])


def padded_batches(rows: DataFrame, order: str, ids: str, size: int, pad: int = 0, drop_remainder: bool = False, length: int | None = None) -> DataFrame:
    """Add batch, and pad ids to its batch's longest row or, where given, to a constant length. order must be unique."""
    place, longest, n = fresh(rows, "place"), fresh(rows, "longest"), fresh(rows, "n")
    placed = ranked(rows, [], [order], place, "batches").withColumn("batch", F.floor((F.col(place) - 1) / size).cast("long")).drop(place)
    own = Window.partitionBy("batch")
    placed = placed.withColumn(longest, F.max(F.size(ids)).over(own)).withColumn(n, F.count(F.lit(1)).over(own))
    placed = placed.where(F.col(n) == size) if drop_remainder else placed
    most = F.col(longest) if length is None else F.lit(length)
    return placed.withColumn(ids, F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(most - F.size(ids), F.lit(0))))).drop(longest, n)


def parameter_grid(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """All combinations of the axes' values, in order: a few hundred rows."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out
