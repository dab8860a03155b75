"""Queries over files that Spark writes from the tables' traces into the shared folder and reads again, with SQL over the tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shotframe.sources import ranges, seg2, segd, segy, tape
from shotframe.sources.files import shared_folder, write_files

from .portfolio import query, table

#: Traces of a file.
FILE = 400


def _whole_traces(spark, d):
    """(file, trace_idx, vec_id, label, samples): the tables' traces as whole numbers that every format holds."""
    e = table(spark, d, "embeddings")
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * 10_000 + 0.5).cast("float"))
    return e.select(F.floor(F.col("vec_id") / FILE).cast("int").alias("file"), (F.col("vec_id") % FILE).cast("int").alias("trace_idx"), F.col("vec_id").cast("int").alias("vec_id"), F.col("label").cast("int").alias("label"), x.alias("samples"))


def _files(spark, d, name: str, encode) -> str:
    """The folder of the files that encode makes of the traces of each file number."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("trace_idx")
        k = int(rows["file"].iloc[0])
        return pd.DataFrame({"file": [f"{k:06d}.{name}"], "content": [encode(k, rows)]})

    folder = shared_folder(spark, name)
    write_files(_whole_traces(spark, d).groupBy("file").applyInPandas(run, "file string, content binary"), folder)
    return folder


def _segy(k: int, rows: pd.DataFrame) -> bytes:
    named = rows.assign(seq_file=rows["vec_id"], channel=rows["trace_idx"] + 1, ensemble=rows["label"])
    return segy.encode_file(named, code=(5, 2, 3, 7)[k % 4], interval_us=500)


_SUMS = "CAST(sum(x) AS BIGINT) AS total, CAST(sum(x * x) AS BIGINT) AS energy"
_LONG = "s AS (SELECT vec_id, label, i - 1 AS i, floor(CAST(embedding[i] AS DOUBLE) * 10000 + 0.5) AS x FROM embeddings, generate_series(1, 64) g(i))"


def _sums(samples: str):
    add = lambda f: F.aggregate(F.transform(samples, f), F.lit(0).cast("long"), lambda a, b: a + b.cast("long"))
    return [F.size(samples).alias("n"), add(lambda v: v.cast("double")).alias("total"), add(lambda v: v.cast("double") * v).alias("energy")]


@query(f"""WITH {_LONG} SELECT vec_id, CAST(vec_id // {FILE} AS INTEGER) AS file, CAST(vec_id % {FILE} AS BIGINT) AS trace_idx, CAST(count(*) AS INTEGER) AS n, {_SUMS}, CAST(NULL AS VARCHAR) AS error FROM s GROUP BY vec_id""")
def segy_ranges(spark, d):
    folder = _files(spark, d, "sgy", _segy)
    ranges.register(spark)
    rows = spark.read.format("segy").option("splitBytes", 20_000).load(folder)
    file = F.regexp_extract("path", r"(\d+)\.sgy$", 1).cast("int")
    return rows.select(F.col("seq_file").cast("long").alias("vec_id"), file.alias("file"), "trace_idx", *_sums("samples"), "error")


@query(f"""SELECT label AS ensemble, count(*) AS n, CAST(min(vec_id) AS INTEGER) AS first_id, CAST(max(vec_id % {FILE}) + 1 AS INTEGER) AS last_channel, CAST(64 AS INTEGER) AS n_samples, CAST(500 AS INTEGER) AS interval_us FROM embeddings GROUP BY label""")
def segy_headers(spark, d):
    """Only headers are read: the schema has no samples."""
    folder = _files(spark, d, "sgy", _segy)
    ranges.register(spark)
    rows = spark.read.format("segy").option("splitBytes", 20_000).schema("seq_file int, channel int, ensemble int, n_samples int, interval_us int").load(folder)
    return rows.groupBy("ensemble").agg(F.count("*").alias("n"), F.min("seq_file").alias("first_id"), F.max("channel").alias("last_channel"), F.max("n_samples").alias("n_samples"), F.max("interval_us").alias("interval_us"))


def _segd(k: int, rows: pd.DataFrame) -> bytes:
    return segd.encode(list(rows["samples"]), code=(8058, 8036, 8015)[k % 3], revision=1 + k % 3, file_number=9990 + k, interval_us=1000, line=7, first_point=int(rows["vec_id"].iloc[0]) + 1)


@query(f"""WITH {_LONG} SELECT vec_id, CAST(vec_id // {FILE} + 9990 AS INTEGER) AS file_number, CAST(1 + vec_id // {FILE} % 3 AS INTEGER) AS revision, CAST([8058, 8036, 8015][1 + vec_id // {FILE} % 3] AS INTEGER) AS format_code, CAST(vec_id % {FILE} + 1 AS INTEGER) AS trace_number,
  CAST(7 AS INTEGER) AS receiver_line, CAST(count(*) AS INTEGER) AS n, {_SUMS}, CAST(NULL AS VARCHAR) AS error FROM s GROUP BY vec_id""")
def segd_traces(spark, d):
    rows = segd.read_traces(spark, _files(spark, d, "segd", _segd))
    return rows.select((F.col("receiver_point") - 1).cast("long").alias("vec_id"), "file_number", "revision", "format_code", "trace_number", "receiver_line", *_sums("samples"), "error")


def _seg2(k: int, rows: pd.DataFrame) -> bytes:
    said = [{"SHOT_SEQUENCE_NUMBER": str(v), "CHANNEL_NUMBER": str(c + 1), "SAMPLE_INTERVAL": "0.0005", "RECEIVER_LOCATION": f"{c}.25 {v} 0", "DELAY": f"{-c / 1000}", "TRACE_TYPE": "SEISMIC_DATA" if c % 2 else "DEAD"} for v, c in zip(rows["vec_id"], rows["trace_idx"], strict=True)]
    return seg2.encode(list(rows["samples"]), said, kind=1 + k % 5, chained=k % 2 == 0)


@query(f"""WITH {_LONG} SELECT vec_id, CAST(1 + vec_id // {FILE} % 5 AS INTEGER) AS format, CAST(vec_id % {FILE} + 1 AS INTEGER) AS channel, CAST(500 AS INTEGER) AS interval_us, CAST(nullif(-(vec_id % {FILE}), 0) AS INTEGER) AS delay_ms, CAST(CASE WHEN vec_id % {FILE} % 2 = 1 THEN 1 ELSE 2 END AS INTEGER) AS trace_id,
  CAST(-100 AS INTEGER) AS coordinate_scalar, CAST(vec_id % {FILE} * 100 + 25 AS INTEGER) AS receiver_x, CAST(vec_id * 100 AS INTEGER) AS receiver_y, CAST(count(*) AS INTEGER) AS n, {_SUMS}, CAST(NULL AS VARCHAR) AS error FROM s WHERE vec_id > 0 GROUP BY vec_id""")
def seg2_traces(spark, d):
    # Header words of 0 are null, so the trace of id 0 has none to be known by.
    rows = seg2.header_words(seg2.read_traces(spark, _files(spark, d, "sg2", _seg2))).where("field_record IS NOT NULL")
    return rows.select(F.col("field_record").cast("long").alias("vec_id"), "format", "channel", "interval_us", "delay_ms", "trace_id", "coordinate_scalar", "receiver_x", "receiver_y", *_sums("samples"), "error")


def _tape(k: int, rows: pd.DataFrame) -> bytes:
    """A SEG-Y record of each fourth of the traces, with a SEG-2 record between the second and the third."""
    parts = [rows[rows["trace_idx"] % 4 == q].assign(trace_idx=np.arange((rows["trace_idx"] % 4 == q).sum())) for q in range(4)]
    files = [(f"LINE {q}", segy.encode_file(p.assign(seq_file=p["vec_id"]), code=(5, 3, 2, 7)[q], interval_us=500)) for q, p in enumerate(parts) if len(p)]
    files.insert(2, ("NOISE", _seg2(k, rows.head(3))))
    return tape.encode(files, labels=k % 3 > 0, ebcdic=k % 3 == 2)


@query(f"""SELECT CAST(vec_id // {FILE} AS INTEGER) AS file, kind, count(DISTINCT part) AS blocks, CAST(max(CASE WHEN vec_id // {FILE} % 3 > 0 THEN 1 ELSE 0 END * CASE WHEN kind = 'segy' THEN 1 ELSE 0 END) AS INTEGER) AS named, CAST(0 AS BIGINT) AS faults
  FROM (SELECT vec_id, vec_id % 4 AS part, 'segy' AS kind FROM embeddings UNION ALL SELECT vec_id, 0, 'seg2' FROM embeddings) GROUP BY ALL""")
def tape_blocks(spark, d):
    found = tape.blocks(spark, _files(spark, d, "tpimage", _tape))
    file = F.regexp_extract("path", r"(\d+)\.tpimage$", 1).cast("int").alias("file")
    return found.groupBy(file, "kind").agg(F.count("*").alias("blocks"), F.max(F.coalesce(F.startswith("name", F.lit("LINE")), F.lit(False)).cast("int")).alias("named"), F.count("error").alias("faults"))


@query(f"""WITH {_LONG} SELECT vec_id, CAST(vec_id % 4 + CASE WHEN vec_id % 4 >= 2 THEN 1 ELSE 0 END AS INTEGER) AS record, CAST(count(*) AS INTEGER) AS n, {_SUMS} FROM s GROUP BY vec_id""")
def tape_traces(spark, d):
    folder = _files(spark, d, "tpimage", _tape)
    ranges.register(spark)
    rows = spark.read.format("segy").option("splitBytes", 10_000).load(folder).where("error IS NULL")
    return rows.select(F.col("seq_file").cast("long").alias("vec_id"), "record", *_sums("samples"))
