"""Column expressions shared by the operators. All are built-in functions, so Catalyst sees through them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded, with minus zero as zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def crop(series: Column | str, first: int, last: int) -> Column:
    """Drop the first and last so many volumes; empty where nothing is left."""
    c = F.col(series) if isinstance(series, str) else series
    return F.slice(c, first + 1, F.greatest(F.size(c) - F.lit(first + last), F.lit(0)))


def reverse_sign(series: Column | str, flip: Column) -> Column:
    c = F.col(series) if isinstance(series, str) else series
    return F.when(flip, F.transform(c, lambda x: -x)).otherwise(c)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def mean_of(series: Column | str) -> Column:
    return F.aggregate(series, F.lit(0.0), lambda a, x: a + x) / F.size(series)


def l2_normalised(series: Column | str) -> Column:
    """Divided by its length; a zero series stays."""
    c = F.col(series) if isinstance(series, str) else series
    length = F.sqrt(dot(c, c))
    return F.when(length > 0, F.transform(c, lambda x: x / length)).otherwise(c)


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays of one length; null where one of them is constant."""
    n = F.size(a).cast("double")
    mean_a, mean_b = (F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n for x in (a, b))
    ca, cb = F.transform(a, lambda v: v - mean_a), F.transform(b, lambda v: v - mean_b)
    scale = F.sqrt(dot(ca, ca) * dot(cb, cb))
    return F.when(scale > 0, dot(ca, cb) / scale)


def normal_subject(c: Column | str) -> Column:
    """Subject ids without the prefix "sub-", trimmed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.trim(c), "^sub-", "")


def positive_trait(c: Column | str) -> Column:
    """Whether a flag column says yes."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "1.0", "true", "yes", "t", "y"), F.lit(False))


def category(c: Column | str) -> Column:
    """A category's name, with the ways to write a missing one made one."""
    c = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.when(c.isNull() | F.lower(F.trim(c)).isin("", "nan", "none"), "Unknown/None").otherwise(F.trim(c))


def joined_category(names: list[str]) -> Column:
    """Several columns as one category, "a: v | b: w"."""
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{n}: "), category(n)) for n in names])


def train_label(group: Column, zero: str, one: str, in_set: Column) -> Column:
    """0, 1 or null: the class of a row in a pair of groups. Against "mus", "NM" is 0 and all others 1."""
    if {zero, one} == {"NM", "mus"}:
        value = F.when(group == "NM", 0).otherwise(1)
    else:
        value = F.when(group == zero, 0).when(group == one, 1)
    return F.when(in_set, value)


def voxel_coordinates(index: Column, ny: int, nz: int) -> list[Column]:
    """x, y, z of a C-order index in a volume of any x and ny by nz."""
    return [F.floor(index / (ny * nz)).alias("x"), (F.floor(index / nz) % ny).alias("y"), (index % nz).alias("z")]


def voxel_index(x: Column, y: Column, z: Column, ny: int, nz: int) -> Column:
    return (x * ny + y) * nz + z


def sparse_peak(y: Column, before: Column, after: Column) -> Column:
    """y where it is a strict local extremum, else 0."""
    peak = ((y > before) & (y > after)) | ((y < before) & (y < after))
    return F.when(peak, y).otherwise(F.lit(0.0))


def pair_parts(folder: Column) -> tuple[Column, Column]:
    """The two groups in a folder name "ml_<a>_vs_<b>"; empty strings where it has another form."""
    return F.regexp_extract(folder, "ml_(.+?)_vs_(.+)", 1), F.regexp_extract(folder, "ml_(.+?)_vs_(.+)", 2)
