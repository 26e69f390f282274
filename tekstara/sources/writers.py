"""Writers: JSON lines, resumable appends, staged replacement, CoNLL-U, label files, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    """Columns in the order of their names; those that begin with an underscore are private and left out."""
    df.select(*sorted(c for c in df.columns if not c.startswith("_"))).write.mode(mode).json(path)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Append rows whose key the table doesn't hold yet: a broken job can be run again."""
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    new = df.join(spark.read.parquet(path).select(key), key, "left_anti") if there else df
    new.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Write beside the table, then rename: readers see the old rows or the new ones."""
    spark = df.sparkSession
    Path = spark._jvm.org.apache.hadoop.fs.Path
    new, old, at = Path(path + ".new"), Path(path + ".old"), Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(path + ".new")
    fs.delete(old, True)
    if fs.exists(at):
        fs.rename(at, old)
    fs.rename(new, at)
    fs.delete(old, True)


def conllu_blocks(tokens: DataFrame, key: str = "sent") -> DataFrame:
    """key, value: each sentence's ten-column lines, in order of id."""
    u = F.lit("_")
    line = F.concat_ws("\t", F.col("id").cast("string"), *[F.coalesce(F.col(c), u) for c in ("form", "lemma", "upos", "xpos", "feats")], u, u, u, u)
    rows = F.array_sort(F.collect_list(F.struct("id", line.alias("line"))))
    return tokens.groupBy(key).agg(F.concat(F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), F.lit("\n")).alias("value"))


def markdown(df: DataFrame, most: int = 200) -> str:
    """A table for a report; meant for small aggregates, and refused above ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows are no report")
    body = ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *body])
