"""The query language's functions: name (lower case) to a builder that takes compiled columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import distance as D


def _duration(x: Column) -> Column:
    """Seconds, nanoseconds aside, of an ISO 8601 duration of days and less ("P1DT2H3M4.5S"); null for any other text."""
    good = F.regexp_like(x, F.lit(r"^P(?=.)([0-9]+D)?(T(?=.)([0-9]+H)?([0-9]+M)?([0-9]+(\.[0-9]+)?S)?)?$"))
    part = lambda unit: F.coalesce(F.regexp_extract(x, rf"([0-9.]+){unit}", 1).try_cast("double"), F.lit(0.0))
    return F.when(good, part("D") * 86400 + part("H") * 3600 + part("M") * 60 + part("S"))


SCALAR: dict[str, Callable[..., Column]] = {
    "toupper": F.upper, "upper": F.upper, "tolower": F.lower, "lower": F.lower, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim, "reverse": F.reverse,
    "substring": lambda s, a, n=None: F.substring(s, a + 1, F.length(s) if n is None else n),
    "left": lambda s, n: F.substring(s, F.lit(1), n), "right": lambda s, n: F.when(n <= 0, F.lit("")).otherwise(F.right(s, n)),
    "replace": lambda s, a, b: F.replace(s, a, b), "split": lambda s, by: F.split(s, F.concat(F.lit("\\Q"), by, F.lit("\\E")), -1),
    "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "sqrt": F.sqrt, "sign": F.signum, "exp": F.exp, "log": F.log, "log10": F.log10,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "round": lambda x, n=None: F.round(x, 0 if n is None else n),
    "coalesce": F.coalesce, "nullif": F.nullif, "head": lambda x: F.get(x, F.lit(0)), "last": lambda x: F.try_element_at(x, F.lit(-1)), "tail": lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))),
    "range": lambda a, b, step=None: F.when((b - a) * (F.lit(1) if step is None else step) < 0, F.array().cast("array<bigint>")).otherwise(F.sequence(a.cast("long"), b.cast("long"), (F.lit(1) if step is None else step).cast("long"))),
    "tointeger": lambda x: F.coalesce(x.try_cast("long"), x.try_cast("double").cast("long")), "tofloat": lambda x: x.try_cast("double"), "tostring": lambda x: x.cast("string"), "toboolean": lambda x: x.try_cast("boolean"),
    "date": lambda x: x.try_cast("date"), "datetime": lambda x: x.try_cast("timestamp"), "localdatetime": lambda x: x.try_cast("timestamp_ntz"), "time": lambda x: F.date_format(F.concat(F.lit("1970-01-01 "), x).try_cast("timestamp_ntz"), "HH:mm:ss.SSSSSS"),
    "duration": lambda x: _duration(x), "point": lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")),
    "year": F.year, "month": F.month, "day": F.day, "hour": F.hour, "minute": F.minute, "second": F.second,
    "vector_distance": lambda a, b: D.cosine(a, b), "vector_similarity": lambda a, b: 1.0 - D.cosine(a, b), "euclid_distance": D.euclid, "dot_distance": D.dot,
}



def _all(x: Column, distinct: bool) -> Column:
    if distinct:
        raise ValueError("stdev and stdevp take no DISTINCT: collect the distinct values first")
    return x


#: name to a builder that takes the column and whether only distinct values count.
AGGREGATE: dict[str, Callable[[Column, bool], Column]] = {
    "count": lambda x, distinct: F.count_distinct(x) if distinct else F.count(x),
    "sum": lambda x, distinct: F.sum_distinct(x) if distinct else F.sum(x),
    "avg": lambda x, distinct: F.try_divide(F.sum_distinct(x), F.count_distinct(x)) if distinct else F.avg(x),
    "min": lambda x, distinct: F.min(x),
    "max": lambda x, distinct: F.max(x),
    # sorted, so that results don't depend on the partitions
    "collect": lambda x, distinct: F.array_sort(F.collect_set(x) if distinct else F.collect_list(x)),
    "stdev": lambda x, distinct: F.stddev_samp(_all(x, distinct)),
    "stdevp": lambda x, distinct: F.stddev_pop(_all(x, distinct)),
}


def register(name: str, builder: Callable[..., Column]) -> None:
    """Add a scalar function, for example a pandas UDF, to the query language."""
    SCALAR[name.lower()] = builder
