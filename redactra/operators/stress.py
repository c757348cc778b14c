"""Perturbation: spans' surfaces change by a rule, offsets are recomputed; and long documents packed from short rows."""

from __future__ import annotations

import re
import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import surface
from ..functions.text import SPACE
from .dataset import GOLD

_PLAIN, _WIDE = "0123456789", "".join(chr(0xFF10 + i) for i in range(10))

#: Variant -> what becomes of a surface.
VARIANTS: dict[str, Callable[[Column], Column]] = {
    "sep_dot": lambda v: F.translate(v, "-", "."),
    "sep_space": lambda v: F.translate(v, "-", " "),
    "sep_none": lambda v: F.translate(v, "-", ""),
    "fullwidth": lambda v: F.translate(v, _PLAIN, _WIDE),
    "spaced": lambda v: F.array_join(F.split(v, ""), " "),
    "nospace": lambda v: F.regexp_replace(v, f"[{SPACE}]+", ""),
}


def perturb(df: DataFrame, variant: str, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Rows that the variant changes, with new text and spans; rows whose spans overlap are dropped."""
    rule, text = VARIANTS[variant], F.col(text_col)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("cur"), F.array().cast(GOLD).alias("spans"), F.lit(False).alias("changed"), F.lit(True).alias("ok"))

    def step(a: Column, s: Column) -> Column:
        v = surface(text, s)
        new = rule(v)
        before = F.concat(a["out"], F.substring(text, a["cur"] + 1, s["start"] - a["cur"]))
        moved = F.struct(F.length(before).alias("start"), (F.length(before) + F.length(new)).alias("end"), s["label"].alias("label"))
        return F.struct(F.concat(before, new).alias("out"), s["end"].alias("cur"), F.concat(a["spans"], F.array(moved)).alias("spans"), (a["changed"] | (new != v)).alias("changed"), (a["ok"] & (s["start"] >= a["cur"])).alias("ok"))

    ordered = F.array_sort(F.col(spans_col), lambda a, b: a["start"] - b["start"])
    end = lambda a: F.struct(F.concat(a["out"], F.substring(text, a["cur"] + 1, F.length(text))).alias("text"), a["spans"].alias("spans"), (a["changed"] & a["ok"]).alias("keep"))
    out = df.filter(F.size(spans_col) > 0).withColumn("_p", F.aggregate(ordered, start, step, end)).filter("_p.keep")
    out = out.withColumn(text_col, F.col("_p.text")).withColumn(spans_col, F.col("_p.spans")).drop("_p")
    return out.withColumn("aug", F.lit("stress")) if "aug" in df.columns else out


def base_of(df: DataFrame, variant_rows: DataFrame, id_col: str = "id") -> DataFrame:
    """The original rows of a variant: what it is compared with."""
    return df.join(variant_rows.select(id_col).distinct(), id_col, "left_semi")


def _chunk_table(n: np.ndarray, target: int) -> tuple[list[int], list[int], list[int]]:
    """(upto, docs, off) of a chunk of rows of ``n`` characters: how the accumulator leaves it, by how it enters.

    A chunk entered with x characters ends its first document at the first row where the sum reaches target - x. The first
    entry with ``upto`` >= target - x holds the documents ended and the characters left; later ones follow from row to row.
    """
    total = np.concatenate([[0], np.cumsum(n)])
    rows = len(n)
    # Where a document that begins at each row ends: the row after its last one; rows + 1 if it doesn't end here.
    after = np.searchsorted(total, total + target)
    docs, off = [0] * (rows + 1), [0] * (rows + 1)
    for i in range(rows - 1, -1, -1):
        j = int(after[i])
        docs[i], off[i] = (docs[j] + 1, off[j]) if j <= rows else (0, int(total[rows] - total[i]))
    # First ends are at rows that target characters or less reach.
    out: list[tuple[int, int, int]] = []
    for i in range(1, min(rows, int(np.searchsorted(total, target))) + 1):
        entry = (int(total[i]), docs[i] + 1, off[i])
        if out and out[-1][1:] == entry[1:]:
            out.pop()
        out.append(entry)
    upto, d, o = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [])
    return upto, d, o


def long_documents(df: DataFrame, order: str, target: int = 1800, sep: str = "\n", stream: str | None = None) -> DataFrame:
    """Rows joined in order into documents until ``target`` characters are reached; (id, text, lang, source, aug, spans, valid, bad).

    The last, shorter document is made only if it has spans. The accumulator starts again after each document. Rows form one
    stream, or one for each value of ``stream``, whose documents are named ``long-<stream>-<k>``. A stream is a task of its own.
    One stream over all rows is cut into chunks in order: each chunk says how the accumulator leaves it for all ways to enter
    it, these few numbers are followed from chunk to chunk on the driver, and then all chunks are packed at once.
    """
    if stream:
        return _streams(df, order, target, sep, stream)
    spark = df.sparkSession
    rows = df.select(F.col(order).alias("o"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("spans").cast(GOLD), F.array().cast(GOLD)).alias("spans"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "o").sortWithinPartitions("o")
    # Places must not change between the two passes, so they are written with the rows.
    path = f"{_shared(spark)}/longdoc-{uuid.uuid4().hex}"
    dealt.select(F.spark_partition_id().alias("chunk"), F.monotonically_increasing_id().alias("pos"), "text", "spans").write.option("compression", "zstd").parquet(path)
    placed = spark.read.schema(f"chunk int, pos long, text string, spans {GOLD}").parquet(path)

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        size = pdf.sort_values("pos")["n"].to_numpy(np.int64)
        upto, docs, off = _chunk_table(size, target)
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "total": [int(size.sum())], "upto": [upto], "docs": [docs], "off": [off]})

    sizes = placed.select("chunk", "pos", (F.length("text") + len(sep)).cast("long").alias("n"))
    # At most target / len(sep) entries for each chunk, of which there are as many as shuffle partitions.
    tables = sizes.groupBy("chunk").applyInPandas(table, "chunk int, total long, upto array<long>, docs array<long>, off array<long>").collect()
    enter, k, off = {}, 0, 0
    for t in sorted(tables, key=lambda t: t["chunk"]):
        enter[t["chunk"]] = (k, off)
        if off + t["total"] < target:
            off += t["total"]
        else:
            i = bisect_left(t["upto"], target - off)
            k, off = k + t["docs"][i], t["off"][i]
    last = k

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each chunk's part of each document: k, chunk, text, spans in the document's places."""
        now, k, off, buf, spans = None, 0, 0, [], []

        def made() -> dict:
            return {"k": k, "chunk": now, "text": sep.join(buf), "spans": spans}

        for pdf in batches:
            out = []
            for c, text, own in zip(pdf["chunk"], pdf["text"], pdf["spans"], strict=True):
                if c != now:
                    if buf:
                        out.append(made())
                    now, (k, off), buf, spans = c, enter[c], [], []
                spans = spans + [{"start": x["start"] + off, "end": x["end"] + off, "label": x["label"]} for x in own]
                buf.append(text)
                off += len(text) + len(sep)
                if off >= target:
                    out.append(made())
                    k, off, buf, spans = k + 1, 0, [], []
            if out:
                yield pd.DataFrame(out)
        if buf:
            yield pd.DataFrame([made()])

    parts = placed.repartition("chunk").sortWithinPartitions("chunk", "pos").mapInPandas(pieces, f"k long, chunk int, text string, spans {GOLD}")
    whole = parts.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("chunk", "text", "spans"))).alias("p"))
    spans = F.flatten(F.col("p.spans")).cast(GOLD)
    out = whole.select("k", F.array_join(F.col("p.text"), sep).alias("text"), spans.alias("spans")).filter((F.col("k") < last) | (F.size("spans") > 0))
    return out.select(
        F.concat(F.lit("long-"), F.col("k").cast("string")).alias("id"),
        "text",
        F.lit("ko").alias("lang"),
        F.lit("kdpii-longdoc").alias("source"),
        F.lit("concat").alias("aug"),
        "spans",
        F.lit(True).alias("valid"),
        F.array().cast("array<string>").alias("bad"),
    )


def _shared(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; on one machine a temporary one, if none is set."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="redactra-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def _streams(df: DataFrame, order: str, target: int, sep: str, stream: str) -> DataFrame:
    schema = f"id string, text string, lang string, source string, aug string, spans {GOLD}, valid boolean, bad array<string>"
    rows = df.select(F.col(stream).cast("string").alias("stream"), F.col(order).alias("o"), "text", F.col("spans").cast(GOLD).alias("spans"))
    rows = rows.repartition("stream").sortWithinPartitions("stream", "o")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, k, buf, spans, off = None, 0, [], [], 0

        def made() -> dict:
            return {"id": f"long-{now}-{k}", "text": sep.join(buf), "lang": "ko", "source": "kdpii-longdoc", "aug": "concat", "spans": spans, "valid": True, "bad": []}

        for pdf in batches:
            out = []
            for s, text, own in zip(pdf["stream"], pdf["text"], pdf["spans"], strict=True):
                if s != now:
                    if spans:
                        out.append(made())
                    now, k, buf, spans, off = s, 0, [], [], 0
                spans = spans + [{"start": x["start"] + off, "end": x["end"] + off, "label": x["label"]} for x in (own if own is not None else [])]
                buf.append(text or "")
                off += len(text or "") + len(sep)
                if off >= target:
                    out.append(made())
                    k, buf, spans, off = k + 1, [], [], 0
            if out:
                yield pd.DataFrame(out)
        if spans:
            yield pd.DataFrame([made()])

    return rows.mapInPandas(run, schema)


def occurrences(text: Column, needle: str, label: str) -> Column:
    """Gold spans of all places of a needle, overlapping ones too."""
    n = len(needle)
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.length(text) - n, F.lit(0))), lambda i: F.substring(text, i + 1, F.lit(n)) == needle)
    return F.transform(places, lambda i: F.struct(i.alias("start"), (i + n).alias("end"), F.lit(label).alias("label")))


def scenarios(df: DataFrame, text_col: str = "text", needles_col: str = "needles") -> DataFrame:
    """``df`` with ``gold``: every place of every needle (value, label), in order; needles that are missing or overlap fail the job."""
    text = F.col(text_col)

    def places(n: Column) -> Column:
        last = F.greatest(F.length(text) - F.length(n["value"]), F.lit(0))
        at = F.filter(F.sequence(F.lit(0), last), lambda i: F.substring(text, i + 1, F.length(n["value"])) == n["value"])
        spans = F.transform(at, lambda i: F.struct(i.alias("start"), (i + F.length(n["value"])).alias("end"), n["label"].alias("label")))
        return F.when(F.size(at) > 0, spans).otherwise(F.raise_error(F.concat(F.lit("no such text: "), n["label"])).cast(GOLD))

    gold = F.sort_array(F.flatten(F.transform(needles_col, places)))
    apart = F.forall(F.sequence(F.lit(1), F.size("gold")), lambda i: F.get("gold", i).isNull() | (F.get("gold", i)["start"] >= F.get("gold", i - 1)["end"]))
    out = df.withColumn("gold", gold)
    return out.withColumn("gold", F.when(apart, F.col("gold")).otherwise(F.raise_error(F.lit("gold spans overlap")).cast(GOLD)))
