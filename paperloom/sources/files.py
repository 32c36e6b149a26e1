"""Readers and writers of files: JSON lines, tables of text, articles."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_shards(spark: SparkSession, paths: list[str], schema: str, pattern: str = "*.jsonl.gz") -> DataFrame:
    """Rows of all sealed shards of JSON lines; unfinished ``.part`` files do not match the pattern.

    A shard that can't be split is one task; a folder named twice is read once.  No shard is an error.
    """
    folders = list(dict.fromkeys(p.rstrip("/") for p in paths))
    df = spark.read.schema(schema).option("pathGlobFilter", pattern).json(folders)
    if not df.inputFiles():
        raise FileNotFoundError(f"no shard {pattern} in {folders}")
    return df


def read_json_lines(spark: SparkSession, path: str, schema: str, keep_broken: bool = False) -> DataFrame:
    """Rows of JSON lines.  Broken lines are left out, or with ``keep_broken`` kept as text in ``_broken``."""
    if not keep_broken:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    wide = f"{schema}, _broken string"
    return spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)


def read_table(spark: SparkSession, path: str, columns: list[str], header: bool = True) -> DataFrame:
    """Rows of a tab-separated file with the named columns; absent ones are null."""
    raw = spark.read.option("sep", "\t").option("header", str(header).lower()).csv(path)
    if not header:
        raw = raw.toDF(*columns[: len(raw.columns)])
    return raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in columns])


def cutoffs(spark: SparkSession, text: str) -> DataFrame:
    """task, cutoff from JSON text: a map of years, one row or an array of rows with task and cutoff.

    Years outside 1900..2100 are an error.
    """
    data = json.loads(text)
    rows = [(r["task"], int(r["cutoff"])) for r in (data if isinstance(data, list) else [data])] if isinstance(data, list) or "cutoff" in data else [(k, int(v)) for k, v in data.items()]
    if bad := [r for r in rows if not 1900 <= r[1] <= 2100]:
        raise ValueError(f"cutoff out of range: {bad[:3]}")
    return spark.createDataFrame(rows, "task string, cutoff int")


def write_if_changed(df: DataFrame, path: str, keys: list[str]) -> bool:
    """Replace the parquet table at ``path`` unless it holds the same rows; whether it was written.

    Tables are compared by count and an order-free hash; the new one is written beside the old one
    by Spark's commit protocol and so is never seen half done.
    """
    spark = df.sparkSession
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.pmod(F.xxhash64(*sorted(d.columns)), F.lit(1 << 30))), F.lit(0))).first())
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if there and set((old := spark.read.parquet(path)).columns) == set(df.columns) and mark(old) == mark(df):
        return False
    df.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
    return True


_ARTICLE = T.StructType(
    [
        T.StructField("pmid", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("ord", T.IntegerType()),
        T.StructField("parent", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("refs", T.ArrayType(T.StringType())),
    ]
)


def parse_article(xml: str) -> list[tuple]:
    """Rows (pmid, kind, ord, parent, level, text, refs) of one structured article.

    Kinds: title, author (at most 50), section, paragraph, reference.  ``parent`` is the ord of the
    section that holds a section or paragraph; ``refs`` the reference ids a paragraph cites.  Text that
    is no well-formed article gives no rows.
    """
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return []
    flat = lambda e: re.sub(r"\s+", " ", "".join(e.itertext())).strip()
    pmid = next((e.text for e in root.iter("article-id") if e.get("pub-id-type") == "pmid"), None)
    rows: list[tuple] = []
    if (title := root.find(".//article-title")) is not None:
        rows.append((pmid, "title", 0, None, None, flat(title), None))
    for i, name in enumerate(list(root.iterfind(".//contrib//name"))[:50]):
        rows.append((pmid, "author", i, None, None, " ".join(x.text or "" for x in name), None))
    count = {"section": 0, "paragraph": 0}

    def walk(node: ET.Element, parent: int | None, level: int) -> None:
        for child in node:
            if child.tag == "sec":
                me = count["section"]
                count["section"] += 1
                head = child.find("title")
                rows.append((pmid, "section", me, parent, level, flat(head) if head is not None else None, None))
                walk(child, me, level + 1)
            elif child.tag == "p":
                refs = [r for x in child.iter("xref") if x.get("ref-type") == "bibr" for r in (x.get("rid") or "").split()]
                rows.append((pmid, "paragraph", count["paragraph"], parent, level, flat(child), refs))
                count["paragraph"] += 1

    if (body := root.find(".//body")) is not None:
        walk(body, None, 1)
    for i, ref in enumerate(root.iterfind(".//ref-list/ref")):
        ids = {e.get("pub-id-type"): e.text for e in ref.iter("pub-id")}
        rows.append((pmid, "reference", i, None, None, flat(ref), [x for x in (ref.get("id"), ids.get("pmid"), ids.get("doi")) if x]))
    return rows


def articles(df: DataFrame, xml: str) -> DataFrame:
    """The rows of all articles in column ``xml``; null and broken ones give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for x in pdf[xml] if isinstance(x, str) for r in parse_article(x)]
            out = pd.DataFrame(rows, columns=_ARTICLE.names)
            for c in ("parent", "level"):
                out[c] = out[c].astype("Int32")
            yield out

    return df.select(xml).mapInPandas(run, _ARTICLE)
