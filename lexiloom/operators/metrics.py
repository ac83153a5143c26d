"""Metrics of predictions, and summaries over hyper-parameters."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions.text import SPACES, strip


def argmax(logits: Column) -> Column:
    """0-based place of the greatest number, the first of equals."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def accuracy(label: Column, prediction: Column) -> Column:
    return F.avg((label == prediction).cast("double"))


def label_number(label: Column) -> Column:
    return F.regexp_replace(label.cast("string"), "^LABEL_", "").cast("double")


def squared_error(label: Column, prediction: Column) -> Column:
    return F.avg(F.pow(label_number(label) - label_number(prediction), 2))


def absolute_error(label: Column, prediction: Column) -> Column:
    return F.avg(F.abs(label_number(label) - label_number(prediction)))


def _squeezed(s: Column) -> Column:
    return strip(F.regexp_replace(s, f"[{SPACES}]+", " "))


def answer_words(s: Column) -> Column:
    """Lower-cased words of an English answer without punctuation and articles."""
    bare = F.regexp_replace(F.lower(s), r"[!-/:-@\[-`{-~]", "")
    return F.filter(F.split(_squeezed(F.regexp_replace(bare, r"\b(a|an|the)\b", " ")), " "), lambda w: w != "")


def answer_text(s: Column) -> Column:
    """An answer lower-cased, white space squeezed, the final full stop gone."""
    return _squeezed(F.regexp_replace(F.lower(s), "。+$", ""))


def answer_characters(s: Column) -> Column:
    """Characters of an answer's text."""
    return F.filter(F.split(answer_text(s), ""), lambda c: c != "")


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("same", "a", "b")]))
def common_parts(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """How many parts two bags share - strings, of characters, or arrays -, each as often as both have it, and how many each has."""
    found = [(None, None, None) if x is None or y is None else (_shared(x, y), len(x), len(y)) for x, y in zip(a, b)]
    return pd.DataFrame(found, columns=["same", "a", "b"], dtype="Int32")


def _shared(a: str | Sequence, b: str | Sequence) -> int:
    if not isinstance(a, str):
        return (Counter(a) & Counter(b)).total()
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    if not len(x) or not len(y):
        return 0
    size = int(max(x.max(), y.max())) + 1
    if size <= len(x) + len(y) + 1024:  # counts by code point, where there aren't many more of these than characters
        return int(np.minimum(np.bincount(x, minlength=size), np.bincount(y, minlength=size)).sum())
    return (Counter(a) & Counter(b)).total()


def exact_match(gold: Column, predicted: Column, parts: Callable[[Column], Column] = answer_words) -> Column:
    return (F.array_join(parts(gold), " ") == F.array_join(parts(predicted), " ")).cast("int")


def overlap_f1(gold: Column, predicted: Column, parts: Callable[[Column], Column] = answer_words) -> Column:
    """F1 of two bags of parts; where either is empty, whether both are."""
    whole = parts is answer_characters  # a text stands for the bag of its characters
    bags = (answer_text(gold), answer_text(predicted)) if whole else (parts(gold), parts(predicted))
    found = common_parts(*bags)  # sizes come along: no bag is made twice
    same, a, b = found["same"], found["a"], found["b"]
    precision, recall = same / b, same / a
    empty = (a == 0) | (b == 0)
    return F.when(empty, (a == b).cast("double")).when(same == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def summary(rows: DataFrame, keys: Sequence[str], stage: str, stages: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row a hyper-parameter setting, one column a stage and metric, averages where several rows meet."""
    return rows.groupBy(*keys).pivot(stage, list(stages)).agg(*[F.avg(m).alias(m) for m in metrics])


def best_setting(rows: DataFrame, setting: str, metric: str, highest: bool = True) -> DataFrame:
    """The setting with the best metric, the first by name of equals."""
    order = F.desc(metric) if highest else F.asc(metric)
    return rows.orderBy(order, setting).limit(1).select(F.col(setting).alias("setting"), F.col(metric).alias("value"))
