"""Column expressions shared by the operators."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CLASSES = 1000


def required(name: str) -> Column:
    """The feature as double; a null stops the job with the column's name."""
    return F.coalesce(
        F.col(name).cast("double"),
        F.raise_error(F.lit(f"null in feature column {name}")).cast("double"),
    )


def feature_array(features) -> Column:
    """One array<double> from a list of columns, or from a single array column."""
    if isinstance(features, str):
        return F.coalesce(
            F.col(features).cast("array<double>"),
            F.raise_error(F.lit(f"null in feature column {features}")).cast("array<double>"),
        )
    return F.array(*[required(f) for f in features])


def literal_array(values, element="double") -> Column:
    """A list of numbers as one folded literal, whatever its length."""
    values = list(values)
    if not values:
        return F.array().cast(f"array<{element}>")
    text = ",".join(repr(float(v)) if element == "double" else str(int(v)) for v in values)
    return F.split(F.lit(text), ",").cast(f"array<{element}>")


def label_array(classes) -> Column:
    return F.array(*[F.lit(c) for c in classes])


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def log_sum_exp(array: Column) -> Column:
    top = F.array_max(array)
    return top + F.log(F.aggregate(array, F.lit(0.0), lambda s, v: s + F.exp(v - top)))


def argmax_label(scores: Column, classes) -> Column:
    """Class of the highest score; the first class in sorted order wins a tie."""
    return F.element_at(label_array(classes), F.array_position(scores, F.array_max(scores)).cast("int"))


def distinct_labels(df: DataFrame, label: str, limit: int = MAX_CLASSES) -> list:
    """Sorted classes. More than ``limit`` of them is an error, never a cut."""
    rows = df.select(label).distinct().limit(limit + 1).collect()
    values = [r[0] for r in rows]
    if any(v is None for v in values):
        raise ValueError(f"null in label column {label}")
    if len(values) > limit:
        raise ValueError(f"label column {label} has more than {limit} classes")
    if not values:
        raise ValueError("no rows to learn from")
    return sorted(values)


def label_code(label: str, classes) -> Column:
    """Position of the label among the sorted classes, from 0; unknown is null."""
    return F.nullif(F.array_position(label_array(classes), F.col(label)), F.lit(0)).cast("int") - 1


def plus_minus(label: str, classes) -> Column:
    """-1 for the smaller class, +1 for the larger."""
    if len(classes) != 2:
        raise ValueError(f"need two classes, found {len(classes)}")
    return F.when(F.col(label) == F.lit(classes[1]), F.lit(1.0)).otherwise(F.lit(-1.0))
