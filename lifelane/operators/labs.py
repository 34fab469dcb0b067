"""Laboratory results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ABNORMAL = ("Høj", "Lav")


def normalized(df: DataFrame, ts: str, test: str, flag: str, value: str | None = None, abnormal_flags=ABNORMAL) -> DataFrame:
    """Test names of letters and digits only, flags that aren't abnormal as Normal, and abnormal (0/1).

    Rows without instant, or without value where one is named, are dropped; so are normal rows whose value has letters
    but no digit.
    """
    out = df.where(F.col(ts).isNotNull())
    if value:
        out = out.where(F.col(value).isNotNull())
    bad = F.coalesce(F.col(flag).isin(*abnormal_flags), F.lit(False))
    out = out.withColumns({test: F.regexp_replace(test, "[^a-zA-Z0-9]", ""), "abnormal": bad.cast("int"), flag: F.when(bad, F.col(flag)).otherwise(F.lit("Normal"))})
    if value:
        text = F.col(value).cast("string")
        words = text.rlike(r"\p{L}") & ~text.rlike(r"[0-9]")
        out = out.where(~(words & (F.col("abnormal") == 0)))
    return out
