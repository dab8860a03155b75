"""Text tables: delimiter, column profiles, fixed-width and quoted rows, searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELIMITERS = {"comma": ",", "semicolon": ";", "tab": "\t", "pipe": "|", "space": " "}


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, line): the lines of every text, without a trailing CR."""
    rows = docs.select(F.col(id_col), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("n", "line"))
    return rows.withColumn("line", F.regexp_replace("line", "\r$", ""))


def is_comment(line: Column) -> Column:
    return line.rlike(r"^\s*(#|;|$)")


def count_of(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def sniff_delimiter(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, delimiter, n): the most frequent candidate of a text, the first in order of equals; null if there is none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    options = F.array(*[F.struct(count_of(text, c).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, c) in enumerate(DELIMITERS.items())])
    best = F.array_max(options)
    return docs.select(F.col(id_col), F.when(best["n"] > 0, best["name"]).alias("delimiter"), best["n"].cast("long").alias("n"))


def fixed_width(text: Column, fields: dict[str, tuple[int, int]]) -> list[Column]:
    """Trimmed fields of 0-based, end-exclusive columns; empty ones are null."""
    return [F.nullif(F.trim(F.substring(text, a + 1, b - a)), F.lit("")).alias(name) for name, (a, b) in fields.items()]


def split_quoted(line: Column, delimiter: str = ",") -> Column:
    """Cells of a line; double quotes hold delimiters, and two of them inside quotes stand for one. Cells keep their white space.

    The line is cut at its quotes, so that every other part lies inside them; what an empty part between two quoted ones stands for
    is a quote. Linear in the line."""
    mark = F.lit("\uffff\ufffe")  # no characters of any text
    parts = F.split(line, '"')
    last = F.size(parts) - 1

    def read(part: Column, i: Column) -> Column:
        doubled = (part == "") & (i > 0) & (i < last)
        return F.when(i % 2 == 1, part).when(doubled, F.lit('"')).otherwise(F.replace(part, F.lit(delimiter), mark))

    return F.split(F.array_join(F.transform(parts, read), ""), "\uffff\ufffe")


def number(text: Column) -> Column:
    """The leading number of a text, as lenient readers take it."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).try_cast("double")


def profile(rows: DataFrame, column: str, *groups: str) -> DataFrame:
    """Counts, empties, distinct values, lengths and numeric share of a text column."""
    c = F.col(column)
    return rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c.isNull() | (F.trim(c) == "")).alias("empty"), F.countDistinct(c).alias("different"), F.min(F.length(c)).alias("shortest"), F.max(F.length(c)).alias("longest"),
        F.count_if(number(c).isNotNull()).alias("numeric"))


def search(rows: DataFrame, key: str, name: str, query: str, limit: int = 60) -> DataFrame:
    """The best matches of a query: whole name, prefix, part, then each word; a top-k report."""
    n, q = F.lower(F.col(name)), query.lower()
    words = [w for w in q.split() if w]
    hits = sum((F.when(F.contains(n, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    score = F.when(n == q, 1000).when(F.startswith(n, F.lit(q)), 200).when(F.contains(n, F.lit(q)), 100).when(hits == len(words), 40 + 5 * hits).otherwise(0)
    return rows.select(key, name, score.cast("long").alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(limit)


def tolerance_join(left: DataFrame, right: DataFrame, on: list[str], near: dict[str, float]) -> DataFrame:
    """Pairs equal in ``on`` and within a tolerance in the columns of ``near`` (right's are named r_...).

    The first of them is cut into cells of its tolerance, so that the join is by equality."""
    col, tol = next(iter(near.items()))
    cell = lambda c: F.floor(F.col(c) / tol).cast("long")
    l = left.withColumn("__c", F.explode(F.array(*[cell(col) + d for d in (-1, 0, 1)])))
    r = right.select(*on, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in on], cell(col).alias("__c"))
    rows = l.join(r, [*on, "__c"])
    for c, t in near.items():
        rows = rows.where(F.abs(F.col(c) - F.col(f"r_{c}")) <= t)
    return rows.drop("__c")
