"""Sources: JSON Lines, JSON arrays, Parquet, text, templates, label files and result files, all with explicit schemas."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.spans import SPANS
from ..operators.dataset import UNIFIED
from ..operators.reports import RESULT

SENTENCES = "sentence string, sent_idx string, PII_set array<struct<label:string,form:string,begin:int,end:int>>"
TEMPLATES = "genre string, style string, text string"
#: Result files that a run before a repair has left.
STALE = ".pre_fix"


def read_rows(spark: SparkSession, *paths: str) -> DataFrame:
    """Unified rows from JSON Lines; blank lines are skipped, a missing ``valid`` is true."""
    return spark.read.schema(UNIFIED).json(list(paths)).withColumn("valid", F.coalesce("valid", F.lit(True)))


def with_order(df: DataFrame) -> DataFrame:
    """``ord``: grows by file, in the order of their paths, and then by place in the file; ``df`` reads files as they are.

    Spark deals files and their splits to tasks by size, so a split gets its number from a small table of all splits; inside a
    split rows come in order.
    """
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    seen = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), place.alias("_place"))
    # A row for each split: far fewer than rows, and put in order by one task.
    splits = df.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start")).distinct()
    splits = splits.withColumn("_split", F.row_number().over(Window.orderBy("_path", "_start")).cast("long"))
    numbered = seen.join(splits, ["_path", "_start"]).withColumn("ord", F.col("_split") * (1 << 33) + F.col("_place"))
    return numbered.select(*df.columns, "ord")


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """The sentence corpus: one JSON array; ``ord`` is a row's place."""
    return with_order(spark.read.schema(SENTENCES).option("multiLine", True).json(path))


def read_masked(spark: SparkSession, path: str) -> DataFrame:
    """The masked corpus: Parquet, masks as JSON text or as an array."""
    return spark.read.parquet(path)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    return with_order(spark.read.schema(TEMPLATES).json(path)).withColumn("template_id", F.md5("text"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one document: (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_results(spark: SparkSession, root: str, pattern: str = "eval_*.json") -> DataFrame:
    """Evaluation results below ``root``; a result without a model has its folder's name."""
    df = spark.read.schema(RESULT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(root)
    path = F.col("_metadata.file_path")
    named = df.select("*", path.alias("path")).filter(~F.contains(F.col("path"), F.lit(STALE)))
    return named.withColumn("model", F.coalesce("model", F.element_at(F.split("path", "/"), -2)))


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """One result file, or None where there is none or it has no figures by label."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    df = spark.read.schema(RESULT).option("multiLine", True).json(path)
    return df if df.filter(F.size(F.coalesce("per_entity", F.create_map())) > 0).take(1) else None


def read_labels(path: str) -> dict[str, str]:
    """label -> kind from a label file: lines ``NAME: {kind: x}`` below ``labels:``. Only this part of YAML is read."""
    out, inside = {}, False
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        bare = line.split("#")[0].rstrip()
        if bare and not bare[0].isspace():
            inside = bare == "labels:"
        elif inside and bare.strip():
            name, _, rest = bare.strip().partition(":")
            out[name.strip()] = rest.strip(" {}").removeprefix("kind:").strip()
    return out


class HttpDetector:
    """A detector behind HTTP: batches of texts are posted as JSON by the executors; the reply has a list of spans for each.

    The service takes texts of at most ``longest`` characters: longer ones go in parts that overlap by ``overlap`` characters,
    and spans come back in the whole text's places; of spans that overlap the first one stays. ``tries`` calls are made while
    it answers 429.
    """

    def __init__(self, url: str, batch: int = 5, longest: int = 5000, tries: int = 6, timeout: float = 60.0, headers: dict[str, str] | None = None, overlap: int = 200):
        self.step = max(1, longest - overlap)
        self.url, self.batch, self.longest, self.tries, self.timeout, self.headers = url, batch, longest, tries, timeout, headers or {}

    def call(self, texts: list[str]) -> list[list[dict]]:
        import time
        import urllib.error
        import urllib.request

        ask = urllib.request.Request(self.url, data=json.dumps({"texts": texts}).encode(), headers={"Content-Type": "application/json", **self.headers})
        for i in range(self.tries):
            try:
                with urllib.request.urlopen(ask, timeout=self.timeout) as r:
                    return json.loads(r.read())["spans"]
            except urllib.error.HTTPError as e:
                if e.code != 429:
                    raise
                time.sleep(2 + 3 * i)
        raise RuntimeError("the service keeps answering 429")

    def parts(self, text: str) -> list[tuple[int, str]]:
        """(place, part) of a text."""
        last = max(0, len(text) - self.longest)
        return [(at, text[at : at + self.longest]) for at in [*range(0, last, self.step), last]]

    def joined(self, found: list[tuple[int, list[dict]]]) -> list[dict]:
        """The parts' spans in places of the whole text, in order, without those that overlap one before."""
        out: list[dict] = []
        for s in sorted((s | {"start": s["start"] + at, "end": s["end"] + at} for at, spans in found for s in spans), key=lambda s: (s["start"], -s["end"])):
            if not out or s["start"] >= out[-1]["end"]:
                out.append(s)
        return out

    def spans(self, text):
        @F.pandas_udf(SPANS)
        def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in series:
                asked = [(row, at, part) for row, t in enumerate(texts) for at, part in self.parts(t or "")]
                found: list[list[tuple[int, list[dict]]]] = [[] for _ in texts]
                for i in range(0, len(asked), self.batch):
                    some = asked[i : i + self.batch]
                    for (row, at, _), spans in zip(some, self.call([x[2] for x in some]), strict=True):
                        found[row].append((at, spans))
                yield pd.Series([self.joined(x) if len(x) > 1 else x[0][1] for x in found], index=texts.index, dtype=object)

        return run(text)


def dataset_path(root: str, name: str) -> str:
    """Where the unified rows of a dataset lie."""
    return f"{root.rstrip('/')}/{name}.jsonl"


def read_dataset(spark: SparkSession, root: str, name: str, lang: str | None = None) -> DataFrame:
    """Unified rows of a dataset by name, of one language if asked for."""
    df = read_rows(spark, dataset_path(root, name))
    return df.filter(F.col("lang") == lang) if lang else df
