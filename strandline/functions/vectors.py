"""Vectors and distributions in arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def mean(array: Column) -> Column:
    """Null for an empty array."""
    return F.try_divide(total(array), F.size(array).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, floor: float = 1e-12) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(floor))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    shifted = F.transform(logits, lambda x: F.exp((x - F.array_max(logits)) / temperature))
    return F.transform(shifted, lambda x: x / total(shifted))


def entropy(logits: Column) -> Column:
    """Of the softmax, in nats: log of the sum less the mean logit, which needs no second array."""
    top = F.array_max(logits)
    weight = total(F.transform(logits, lambda x: F.exp(x - top)))
    weighted = total(F.transform(logits, lambda x: F.exp(x - top) * (x - top)))
    return F.ln(weight) - weighted / weight


def hourglass(values: Column) -> Column:
    """Mean of the two ends less the least of the middle third; 0 for none."""
    n = F.size(values)
    first, last = F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int")
    middle = F.when(last > first, F.array_min(F.slice(values, first + 1, F.greatest(last - first, F.lit(1))))).otherwise(F.try_element_at(values, (F.floor(n / 2) + 1).cast("int")))
    return F.when(n == 0, 0.0).otherwise((F.try_element_at(values, F.lit(1)) + F.try_element_at(values, F.lit(-1))) / 2 - middle)


def top_k(probabilities: Column, k: int = 3) -> Column:
    """The k largest as (label index from 0, probability), ties to the lower index."""
    keyed = F.transform(probabilities, lambda p, i: F.struct((-p).alias("order"), i.alias("label"), p.alias("p")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: F.struct(x["label"], x["p"]))


def relative_difference(a: Column, b: Column, floor: float = 1e-9) -> Column:
    """Of two feature vectors: differences over sizes."""
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / (total(F.zip_with(a, b, lambda x, y: F.abs(x) + F.abs(y))) + floor)
