"""Command line: ``python -m redactra detect|mask|info`` over a file, a folder or standard input."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions.masking import audit_summary
from .operators.detect import REGISTRY, detect, mask
from .sources.readers import read_text
from .sources.writers import as_json, span_lines


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("redactra", description="Find and mask personal information in texts.")
    p.add_argument("command", choices=["detect", "mask", "info"])
    p.add_argument("--file", help="a file or folder; standard input without it")
    p.add_argument("--detector", default="rules", choices=sorted(REGISTRY))
    p.add_argument("--policy", default="default", choices=["default", "hash", "partial"])
    p.add_argument("--json", action="store_true")
    a = p.parse_args(args)
    if a.command == "info":
        print(json.dumps({"version": __version__, "detectors": sorted(REGISTRY)}))
        return 0
    spark = SparkSession.builder.appName("redactra").getOrCreate()
    df = read_text(spark, a.file) if a.file else spark.createDataFrame([(sys.stdin.read(),)], "text string")
    if a.command == "detect":
        found = detect(df, a.detector)
        if a.json:
            for (line,) in found.select(as_json(F.col("spans"), audit_summary(F.col("spans")))).toLocalIterator():
                print(line)
        else:
            for r in span_lines(found).toLocalIterator():
                print(*r, sep="\t")
        return 0
    # Tokens of the hash policy agree between runs only with a salt of one's own.
    salt = os.environ.get("REDACTRA_SALT", "").encode() or os.urandom(32)
    out = mask(df, a.detector, a.policy, salt=salt)
    for r in out.select("masked", F.to_json("summary").alias("summary")).toLocalIterator():
        print(json.dumps({"text": r["masked"], "summary": json.loads(r["summary"])}, ensure_ascii=False) if a.json else r["masked"])
    return 0
