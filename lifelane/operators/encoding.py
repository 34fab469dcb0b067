"""Pivots, one-hot and multi-hot columns, top codes, melts."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pivot_last(df: DataFrame, keys: list[str], name: str, value: str, order: Column, names: list[str], prefix: str = "") -> DataFrame:
    """One row per keys with a column for each of names: its last value by order. names are given, so nothing is scanned for them."""
    return df.groupBy(*keys).agg(*[F.max_by(F.when(F.col(name) == n, F.col(value)), F.when(F.col(name) == n, order)).alias(prefix + n) for n in names])


def top_codes(df: DataFrame, tokens: str, n: int = 200, sep: str = ",") -> DataFrame:
    """code, n of the n commonest tokens of a joined list; empty tokens don't count, ties go by the code."""
    rows = df.select(F.explode(F.split(tokens, sep)).alias("code")).where("trim(code) <> ''")
    return rows.groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(n)


def multi_hot(df: DataFrame, tokens: str, codes: list[str], prefix: str = "", sep: str = ",") -> DataFrame:
    has = F.split(F.coalesce(tokens, F.lit("")), sep)
    return df.withColumns({prefix + c: F.array_contains(has, c).cast("int") for c in codes})


def multi_hot_vector(df: DataFrame, tokens: str, codes: list[str], out: str, sep: str = ",") -> DataFrame:
    """df with a sparse 0/1 vector of the codes that a joined list has; the codes' names are the vector's metadata.

    One column however many codes there are, and a row takes as much room as it has codes; models take it as it is, and
    VectorAssembler keeps the names. Codes that aren't listed don't count, a null list has none.
    """
    model = CountVectorizerModel.from_vocabulary(codes, "_tokens", out).setBinary(True)
    names = {"ml_attr": {"attrs": {"binary": [{"idx": i, "name": c} for i, c in enumerate(codes)]}, "num_attrs": len(codes)}}
    rows = model.transform(df.withColumn("_tokens", F.split(F.coalesce(tokens, F.lit("")), sep)))
    return rows.drop("_tokens").withMetadata(out, names)


def one_hot(df: DataFrame, column: str, levels: list, prefix: str = "") -> DataFrame:
    """A 0/1 column for each level, none left out; a null is in no level."""
    return df.withColumns({f"{prefix}{v}": F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for v in levels})


def any_of(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """df with out: 1 where any of the 0/1 columns is set, else 0; nulls and an empty list count as 0."""
    return df.withColumn(out, F.greatest(F.lit(0), F.lit(0), *[F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in columns]))


def retyped(df: DataFrame, none: str = "None") -> DataFrame:
    """The text none becomes null, truth values 1 and 0, and so do the texts True and False in columns that hold no others.

    One pass over the text columns finds which those are.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    truth = lambda c: F.bool_and(F.col(f"`{c}`").isin("True", "False") | (F.col(f"`{c}`") == none))
    found = df.agg(*[truth(c).alias(f"c{i}") for i, c in enumerate(texts)]).collect()[0] if texts else {}
    two = {c for i, c in enumerate(texts) if found[f"c{i}"]}

    def typed(field):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.BooleanType):
            return c.cast("int")
        if field.name in two:
            return F.when(c == "True", 1).when(c == "False", 0)
        return F.nullif(c, F.lit(none)) if field.name in texts else c

    return df.select(*[typed(f).alias(f.name) for f in df.schema])


def prettified(name: str, names: dict[str, str]) -> str:
    """The name to show for a column: its own, or that of the column it is a level of, with the level; else as it is."""
    if name in names:
        return names[name]
    found = next((raw for raw in names if name.startswith(f"{raw}_")), None)
    return f"{names[found]}: {name[len(found) + 1:]}" if found is not None else name


def with_shown_names(df: DataFrame, column: str, names: dict[str, str], out: str = "shown") -> DataFrame:
    """prettified() of a column of names, for tables with a row for each feature; the first fitting entry of names decides."""
    shown = F.col(column)
    for raw, pretty in reversed(names.items()):
        shown = F.when(F.startswith(F.col(column), F.lit(f"{raw}_")), F.concat(F.lit(f"{pretty}: "), F.substr(F.col(column), F.lit(len(raw) + 2)))).otherwise(shown)
    for raw, pretty in names.items():
        shown = F.when(F.col(column) == raw, F.lit(pretty)).otherwise(shown)
    return df.withColumn(out, shown)


def melt(df: DataFrame, ids: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def levels(df: DataFrame, column: str, most: int = 1000) -> list:
    """The distinct values of a column that has few, sorted; more than most raise."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(found)


