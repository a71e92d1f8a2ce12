"""Writers of results and plain-text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def fixed_decimals(df: DataFrame, decimals: dict[str, int]) -> DataFrame:
    """Columns rounded as a result file shows them."""
    return df.withColumns({c: F.round(c, n) for c, n in decimals.items()})


def csv(df: DataFrame, path: str, order: list, decimals: dict[str, int] | None = None, mode: str = "errorifexists") -> None:
    """Rows in order, with a header and fixed decimals."""
    fixed_decimals(df, decimals or {}).orderBy(*order).write.mode(mode).option("header", True).csv(path)


def json_object(df: DataFrame, key: str, value: str, path: str, mode: str = "errorifexists") -> None:
    """Rows (key, value) as one JSON object in one file, keys in order; for maps that fit a row, such as registries."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))))
    one = df.where(F.col(key).isNotNull()).agg(F.to_json(F.map_from_entries(entries)).alias("value"))
    one.coalesce(1).write.mode(mode).text(path)


def whole_files(df: DataFrame, name: str, value: str, path: str, mode: str = "errorifexists") -> None:
    """A file for each row, its value as it is, in a folder `name=...` of its own."""
    df.select(F.col(name).alias("name"), F.col(value).alias("value")).write.mode(mode).partitionBy("name").text(path)


def report(df: DataFrame, title: str, columns: list[str], rows: int = 100) -> str:
    """A small result as an aligned table; numbers with four decimals. Of more than `rows` rows the last line says so."""
    found = df.select(*columns).limit(rows + 1).collect()
    shown = [[f"{v:.4f}" if isinstance(v, float) else "-" if v is None else str(v) for v in r] for r in found[:rows]]
    widths = [max(len(x) for x in col) for col in zip(columns, *shown, strict=True)]
    line = lambda r: "  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip()
    more = [f"... more than {rows} rows"] if len(found) > rows else []
    return "\n".join([title, line(columns), "  ".join("-" * w for w in widths), *map(line, shown), *more])
