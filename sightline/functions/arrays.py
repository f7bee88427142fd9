"""Array and vector expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it.

    A column mentioned inside a lambda is otherwise computed again for every element.
    """
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def distinct_ignore_case(names: Column) -> Column:
    """Keep the first spelling of each name, in order. Repeats go first, other spellings meet by sorting, so long lists stay cheap."""
    spelled = F.transform(F.filter(F.array_distinct(names), lambda n: n.isNotNull()), lambda n, i: F.struct(F.lower(n).alias("key"), i.alias("at"), n.alias("name")))

    def firsts(ordered: Column) -> Column:
        kept = F.filter(ordered, lambda x, k: (k == 0) | (F.get(ordered, k - 1)["key"] != x["key"]))
        return F.transform(F.sort_array(F.transform(kept, lambda x: F.struct(x["at"], x["name"]))), lambda x: x["name"])

    return bind(F.sort_array(spelled), firsts)


def ordered_name_union(first: Column, second: Column) -> Column:
    return distinct_ignore_case(F.concat(F.coalesce(first, F.array()), F.coalesce(second, F.array())))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    exps = bind(top, lambda m: F.transform(logits, lambda x: F.exp(x - m)))
    return bind(exps, lambda e: bind(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total)))


def argmax(values: Column) -> Column:
    """Zero-based position of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def max_prob(logits: Column) -> Column:
    """Largest softmax value, without building the whole distribution."""
    top = F.array_max(logits)
    return 1 / F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))


def cross_entropy(logits: Column, label: Column) -> Column:
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.log(total) + top - F.element_at(logits, label + 1)


# Channel statistics used by the classifier.
CHANNEL_MEAN = [0.485, 0.456, 0.406]
CHANNEL_STD = [0.229, 0.224, 0.225]


def _channel(values: list[float], i: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), i % len(values))


def normalize_channels(pixels: Column) -> Column:
    """Pixels as red, green, blue, red, ...: each number less its channel's mean, by its deviation."""
    return F.transform(pixels, lambda x, i: (x - _channel(CHANNEL_MEAN, i)) / _channel(CHANNEL_STD, i))


def denormalize_channels(pixels: Column) -> Column:
    return F.transform(pixels, lambda x, i: x * _channel(CHANNEL_STD, i) + _channel(CHANNEL_MEAN, i))


def top_k(values: Column, k: int) -> Column:
    """The k largest values as (position, value) structs, earlier positions first on ties."""
    ranked = F.sort_array(F.transform(values, lambda x, i: F.struct(x.alias("value"), (-i).alias("neg"))), asc=False)
    return F.transform(F.slice(ranked, 1, k), lambda r: F.struct((-r["neg"]).alias("position"), r["value"].alias("value")))
