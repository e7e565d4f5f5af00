"""Schema and cell cleaning of sample tables."""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from rillwater.config import Roles
from rillwater.functions import dates, keys, numbers

# Characters removed from, and replaced in, column names.
NAME_REMOVED = "°()"
NAME_TO_UNDERSCORE = " /"


def normal_name(name: str) -> str:
    table = {ord(c): None for c in NAME_REMOVED} | {ord(c): "_" for c in NAME_TO_UNDERSCORE}
    return str(name).lower().translate(table).strip("_")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Lower-case names without blanks and signs; two names may not collide."""
    names = [normal_name(c) for c in df.columns]
    doubled = sorted(n for n, k in Counter(names).items() if k > 1)
    if doubled:
        raise ValueError(f"column names collide after cleaning: {doubled}")
    return df.toDF(*names)


def find_column(df: DataFrame, part: str) -> str:
    """First column whose name contains ``part``."""
    for name in df.columns:
        if part in name:
            return name
    raise ValueError(f"no column contains {part!r}")


def rename_containing(df: DataFrame, part: str, new_name: str) -> DataFrame:
    return df.withColumnRenamed(find_column(df, part), new_name)


def existing(df: DataFrame, names: Iterable[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def select_existing(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.select(*[F.col(f"`{n}`") for n in existing(df, names)])


def numeric_columns(df: DataFrame, names: Iterable[str] | None = None) -> list[str]:
    wanted = set(df.columns if names is None else names)
    return [f.name for f in df.schema.fields
            if f.name in wanted and isinstance(f.dataType, NumericType)]


def text_columns(df: DataFrame, without: Iterable[str] = ()) -> list[str]:
    skip = set(without)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, StringType) and f.name not in skip]


def infer_features(df: DataFrame, without: Iterable[str]) -> list[str]:
    """Feature names of a table: its numeric columns minus the given ones."""
    skip = set(without)
    return [c for c in numeric_columns(df) if c not in skip]


def blank_sentinels(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    names = text_columns(df) if names is None else existing(df, names)
    return df.withColumns({c: numbers.blank_sentinels(F.col(c)) for c in names})


def to_numeric(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Named columns as double, bad cells null; absent columns are skipped."""
    texts = set(text_columns(df))
    parsed = {c: numbers.parse_number(F.col(c)) if c in texts else numbers.finite(F.col(c))
              for c in existing(df, names)}
    return df.withColumns(parsed) if parsed else df


def texts_to_numeric(df: DataFrame, keep: Iterable[str]) -> DataFrame:
    """Every text column to double except the ones to keep."""
    return to_numeric(df, text_columns(df, without=keep))


def parse_dates(df: DataFrame, name: str, formats: Sequence[str] = ()) -> DataFrame:
    """Serial numbers or text to timestamps; text may also hold serials."""
    if name not in df.columns:
        warnings.warn(f"no date column {name!r}")
        return df
    col = F.col(name)
    if name in numeric_columns(df):
        value = dates.from_serial(col)
    elif name in text_columns(df):
        value = F.coalesce(dates.from_serial(numbers.parse_number(col)),
                           dates.from_text(col, formats))
    else:
        value = col.cast("timestamp_ntz")
    return df.withColumn(name, value)


def clean_keys(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: keys.clean_key(F.col(n)) for n in names})


def present_shares(df: DataFrame) -> dict[str, float]:
    """Percentage of non-null cells of every column, in one aggregate."""
    row = df.agg(*[numbers.share_present(F.col(f"`{c}`")).alias(f"c{i}")
                   for i, c in enumerate(df.columns)]).first()
    return {c: row[i] if row[i] is not None else 0.0 for i, c in enumerate(df.columns)}


def drop_empty(df: DataFrame) -> DataFrame:
    """Drop columns without any value, then rows without any value."""
    found = df.agg(*[F.max(F.col(f"`{c}`").isNotNull()).alias(f"c{i}")
                     for i, c in enumerate(df.columns)]).first()
    kept = [c for i, c in enumerate(df.columns) if found[i]]
    return df.select(*[F.col(f"`{c}`") for c in kept]).dropna("all")


def drop_sparse(df: DataFrame, limit: float = 0.99, keep: Iterable[str] = ()) -> DataFrame:
    """Drop columns whose share of nulls exceeds ``limit``; ``keep`` always stays."""
    always = set(keep)
    shares = present_shares(df)
    return df.select(*[F.col(f"`{c}`") for c in df.columns
                       if c in always or 1 - shares[c] / 100 <= limit])


def require_columns(df: DataFrame, roles: Roles) -> DataFrame:
    """Station and date must exist; warn when no date is known at all."""
    missing = [c for c in (roles.station, roles.date) if c not in df.columns]
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    if df.where(F.col(roles.date).isNotNull()).limit(1).count() == 0:
        warnings.warn("no row has a date")
    return df


def fill_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna({k: v for k, v in values.items() if k in df.columns})


def round_numeric(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every floating column; whole-number columns have nothing to round."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: numbers.round_to(F.col(c), digits) for c in floats})


def clean_samples(df: DataFrame, roles: Roles) -> DataFrame:
    """The standard cleaning chain for a raw, all-text sample table."""
    return (
        df.transform(normalize_columns)
        .transform(blank_sentinels)
        .transform(parse_dates, roles.date)
        .transform(to_numeric, [roles.target, *roles.features])
        .transform(clean_keys, roles.station)
    )
