"""Readers: JSON lines, CoNLL-U, word lists, tables of counts, feeds, page paragraphs. Schemas are given, never inferred."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False, where: str | None = None) -> DataFrame:
    """One object a line; blank lines don't count. ``strict`` fails on a bad line, else it gives nulls."""
    df = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    return df.where(where) if where else df


def json_lines_within(spark: SparkSession, path: str, schema: str, least: int = 200, share: float = 0.01) -> DataFrame:
    """Good rows, unless more than max(least, share of all) lines are bad, which raises ValueError."""
    df = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).cache()
    n = df.agg(F.count("*").alias("n"), F.count("_bad").alias("bad")).first()
    if n["bad"] > max(least, share * n["n"]):
        df.unpersist()
        raise ValueError(f"{n['bad']} of {n['n']} lines are bad")
    return df.where("_bad is null").drop("_bad")


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """file, sent, id, form, lemma, upos, xpos, feats of every token; comments, ranges (1-2) and empty nodes (2.1) don't count.

    Sentences end at blank lines. Files are read in blocks between blank lines, so one file may be split over tasks.
    """
    blocks = spark.read.option("lineSep", "\n\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("sent"), "value")
    return conllu_tokens(blocks)


def conllu_tokens(blocks: DataFrame) -> DataFrame:
    """The same from columns file, sent and value (a sentence's lines)."""
    lines = blocks.select("file", "sent", F.explode(F.split("value", "\n")).alias("line"))
    c = F.split(F.trim("line"), "\t")
    rows = lines.select("file", "sent", c.alias("c")).where((F.size("c") >= 6) & F.get("c", 0).rlike("^[0-9]+$"))
    return rows.select("file", "sent", F.get("c", 0).cast("int").alias("id"), *[F.get("c", i).alias(n) for i, n in ((1, "form"), (2, "lemma"), (3, "upos"), (4, "xpos"), (5, "feats"))])


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """form, freq of ``word freq`` lines; lines without a positive number don't count."""
    c = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.get(c, 0).alias("form"), F.get(c, 1).try_cast("long").alias("freq"))
    return rows.where((F.col("form") != "") & (F.col("freq") > 0))


def bigram_list(spark: SparkSession, path: str) -> DataFrame:
    """w1, w2, n of tab-separated lines with a positive count."""
    rows = spark.read.schema("w1 string, w2 string, c string").option("sep", "\t").option("quote", "").csv(path)
    return rows.select("w1", "w2", F.col("c").try_cast("long").alias("n")).where((F.col("n") > 0) & F.col("w1").isNotNull() & F.col("w2").isNotNull())


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (its number within the file's task order), text of non-blank lines."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("text")).where(F.trim("text") != "")


def feed_items(df: DataFrame, xml: str = "xml", pattern: str = ".*") -> DataFrame:
    """url, title of feed items whose url matches, one row a url."""
    items = df.select(F.explode(F.arrays_zip(F.xpath(xml, F.lit("//item/link/text()")).alias("url"), F.xpath(xml, F.lit("//item/title/text()")).alias("title"))).alias("i"))
    found = items.select(F.trim("i.url").alias("url"), F.trim("i.title").alias("title")).where(F.col("url").rlike(pattern))
    return found.groupBy("url").agg(F.min("title").alias("title"))


class _Paragraphs(HTMLParser):
    """Texts of p elements outside scripts, styles, headers, footers, navigation, asides and forms."""

    SKIP = frozenset("script style header footer nav aside form figure figcaption noscript".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.held: list[str] | None = None
        self.depth = 0

    def close_p(self) -> None:
        if self.held is not None:
            text = " ".join("".join(self.held).split())
            if text:
                self.out.append(text)
        self.held = None

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in self.SKIP:
            self.depth += 1
        elif tag == "p" and not self.depth:
            self.close_p()
            self.held = []
        elif tag == "br" and self.held is not None:
            self.held.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.depth = max(0, self.depth - 1)
        elif tag in ("p", "article", "body", "div"):
            self.close_p()

    def handle_data(self, data: str) -> None:
        if self.held is not None and not self.depth:
            self.held.append(data)


def paragraphs_of(page: str | None) -> list[str]:
    p = _Paragraphs()
    p.feed(page or "")
    p.close()
    p.close_p()
    return p.out


def html_paragraphs(df: DataFrame, id_col: str = "page_id", page: str = "html") -> DataFrame:
    """id, n, text of every paragraph of every page."""

    @F.pandas_udf("array<string>")
    def split(s: pd.Series) -> pd.Series:
        return s.map(paragraphs_of)

    return df.select(id_col, F.posexplode(split(page)).alias("n", "text"))
