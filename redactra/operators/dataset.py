"""Dataset construction: unifying sources, joining dialogues, assembling and auditing training sets, splitting and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions import labels as L
from ..functions import spans as S
from ..functions.text import char_grams, collapse_space, dialogue_id, hash_tenth, let, source_prefix
from ..functions.validators import check, invalid_labels

GOLD = "array<struct<start:int,end:int,label:string>>"
UNIFIED = f"id string, text string, lang string, source string, aug string, spans {GOLD}, valid boolean, bad array<string>"
MASKS = "array<struct<label:string,value:string,start:int,end:int>>"


def flagged(df: DataFrame) -> DataFrame:
    """``bad`` (distinct labels whose values fail their validators) and ``valid`` of unified rows."""
    out = df.withColumn("bad", invalid_labels(F.col("text"), F.col("spans"), F.col("lang")))
    return out.withColumn("valid", F.size("bad") == 0).select("id", "text", "lang", "source", "aug", "spans", "valid", "bad")


def mask_array(df: DataFrame, column: str = "privacy_mask") -> Column:
    """The masks as an array, whether the column is JSON text or an array already."""
    return F.from_json(column, MASKS) if isinstance(df.schema[column].dataType, StringType) else F.col(column).cast(MASKS)


def unify_masked(df: DataFrame, split: str, name: str = "bccard", prefix: str = "bc") -> DataFrame:
    """Rows (uid, source_text, language, source_dataset, augmentation_type, privacy_mask) in the unified schema.

    A label outside the schema fails the job, since it would be scored as noise later.
    """
    known = lambda m: F.when(m["label"].isin(L.LABELS), m["label"]).otherwise(F.raise_error(F.concat(F.lit("unknown label "), m["label"])).cast("string"))
    spans = F.transform(mask_array(df), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), known(m).alias("label")))
    return flagged(
        df.select(
            F.concat(F.lit(f"{prefix}-{split}-"), F.col("uid").cast("string")).alias("id"),
            F.col("source_text").alias("text"),
            F.col("language").alias("lang"),
            F.concat(F.lit(f"{name}/"), "source_dataset").alias("source"),
            F.col("augmentation_type").alias("aug"),
            F.coalesce(spans, F.array().cast(GOLD)).alias("spans"),
        )
    )


def number_run(text: Column, s: Column) -> Column:
    """Card and account spans shrink to the first run of digits with its separators; others stay."""
    v = F.substring(text, s["start"] + 1, s["end"] - s["start"])
    run = F.regexp_extract(v, r"(?U)\d[\d\-\. ]*\d", 0)

    def shrunk(r: Column) -> Column:
        # The run has no look-around, so its first place as a text is its place.
        at = s["start"] + F.position(r, v) - 1
        return s.withField("start", at.cast("int")).withField("end", (at + F.length(r)).cast("int"))

    return F.when(s["label"].isin("CARD_NUMBER", "ACCOUNT_NUMBER") & (F.length(run) > 0), let(run, shrunk)).otherwise(s)


def unify_sentences(df: DataFrame, split: str, name: str = "kdpii", prefix: str = "kd") -> DataFrame:
    """Rows (sentence, sent_idx, PII_set[label, form, begin, end]) in the unified schema, spans in order of starts."""
    text = F.col("sentence")
    mapped = F.transform("PII_set", lambda p: F.struct(p["begin"].cast("int").alias("start"), p["end"].cast("int").alias("end"), L.map_label(p["label"], L.SENTENCE_CORPUS).alias("label")))
    kept = F.filter(F.transform(F.filter(mapped, lambda s: s["label"].isNotNull()), lambda s: number_run(text, s)), lambda s: s["end"] > s["start"])
    # sort_array is by start first; ties go by end, which the corpus doesn't have.
    spans = F.coalesce(F.sort_array(kept), F.array().cast(GOLD))
    return flagged(df.select(F.concat(F.lit(f"{prefix}-{split}-"), "sent_idx").alias("id"), text.alias("text"), F.lit("ko").alias("lang"), F.lit(name).alias("source"), F.lit("none").alias("aug"), spans.alias("spans")))


def concat_rows(df: DataFrame, group: str, order: str, sep: str = "\n", text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """(group, text, spans) with each group's texts joined in order and their spans moved along.

    A group is one document and is gathered as such.
    """
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    off = F.coalesce(F.sum(F.length(text_col) + len(sep)).over(w), F.lit(0)).cast("int")
    moved = df.withColumn("_off", off).withColumn("_moved", F.transform(spans_col, lambda s: F.struct((s["start"] + F.col("_off")).alias("start"), (s["end"] + F.col("_off")).alias("end"), s["label"].alias("label"))))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text_col).alias("t"), F.col("_moved").alias("s"))))
    out = moved.groupBy(group).agg(parts.alias("_p"))
    return out.select(group, F.array_join("_p.t", sep).alias("text"), F.flatten("_p.s").alias("spans"))


def dialogues(sentences: DataFrame, split: str, order: str, prefix: str = "kd", name: str = "kdpii") -> DataFrame:
    """Unified sentence rows (with ``order``, the place in the file) as one row for each dialogue."""
    head = f"{prefix}-{split}-"
    keyed = sentences.withColumn("did", dialogue_id(F.substring("id", len(head) + 1, 1 << 20)))
    joined = concat_rows(keyed, "did", order)
    text = F.regexp_replace("text", r"\n+\z", "")
    return flagged(joined.select(F.concat(F.lit(f"{head}dlg-"), "did").alias("id"), text.alias("text"), F.lit("ko").alias("lang"), F.lit(f"{name}-dialogue").alias("source"), F.lit("concat").alias("aug"), "spans"))


def leak_suspects(rows: DataFrame, tests: DataFrame, least: int = 3, n: int = 12, step: int = 3, id_col: str = "id", test_id: str = "id") -> DataFrame:
    """(id, n_shared) of rows that share ``least`` distinct grams with any test text.

    Grams are distinct within a row and across tests before the join; a gram that is common in the rows is a skewed key of a
    semi join, which adaptive execution splits.
    """
    grams = rows.select(id_col, F.explode(char_grams(F.col("text"), n, step)).alias("gram"))
    known = tests.select(F.explode(char_grams(F.col("text"), n, step)).alias("gram")).distinct()
    return grams.join(known, "gram", "left_semi").groupBy(id_col).agg(F.count("*").alias("n_shared")).filter(F.col("n_shared") >= least)


def assemble(masked: DataFrame, sentences: DataFrame, synthetic: DataFrame, tests: DataFrame, clean: bool) -> DataFrame:
    """The training set: masked rows (valid ones if ``clean``) and what of the other sources shares no grams with the tests."""
    first = masked.filter(F.coalesce("valid", F.lit(True))) if clean else masked
    rest = sentences.unionByName(synthetic)
    return first.unionByName(rest.join(leak_suspects(rest, tests).select("id"), "id", "left_anti").select(*rest.columns))


def summary(df: DataFrame) -> DataFrame:
    """One row: rows, valid rows and their share, spans, labels."""
    spans = F.coalesce(F.size("spans"), F.lit(0))
    rows = df.agg(F.count("*").alias("rows"), F.count_if(F.coalesce("valid", F.lit(True))).alias("valid"), F.sum(spans).alias("spans"))
    names = df.select(F.explode("spans").alias("s")).agg(F.countDistinct("s.label").alias("labels"))
    return rows.crossJoin(names).withColumn("valid_share", F.coalesce(F.try_divide("valid", "rows"), F.lit(0.0)))  # one row each


def by_source(df: DataFrame) -> DataFrame:
    return df.groupBy(source_prefix(F.col("source")).alias("source")).agg(F.count("*").alias("rows"))


def rarest_label(df: DataFrame) -> DataFrame:
    """(label, n) of the label with the fewest spans."""
    each = df.select(F.explode("spans").alias("s")).groupBy(F.col("s.label").alias("label")).agg(F.count("*").alias("n"))
    return each.agg(F.min_by("label", F.struct("n", "label")).alias("label"), F.min("n").alias("n"))


def integrity_violations(df: DataFrame) -> DataFrame:
    """One row: spans that leave their text or hold white space alone."""
    bad = F.size(F.filter("spans", lambda s: ~S.inside(F.col("text"), F.array(s))))
    return df.agg(F.coalesce(F.sum(bad), F.lit(0)).alias("violations"))


def audit(df: DataFrame, examples: int = 3) -> DataFrame:
    """(lang, label, total, failed, examples) of spans by their validators; values shown are the first by id and place."""
    each = df.select("id", "lang", F.posexplode("spans").alias("k", "s"), "text")
    v = S.surface(F.col("text"), F.col("s"))
    judged = each.select("id", "lang", "k", F.col("s.label").alias("label"), v.alias("v"), check(F.col("s.label"), v, F.col("lang")).alias("ok"))
    totals = judged.groupBy("lang", "label").agg(F.count("*").alias("total"), F.count_if(~F.col("ok")).alias("failed"))
    w = Window.partitionBy("lang", "label").orderBy("id", "k")
    # row_number <= examples is cut down in each task before the shuffle.
    shown = judged.filter(~F.col("ok")).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= examples)
    kept = shown.groupBy("lang", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]).alias("examples"))
    return totals.join(kept, ["lang", "label"], "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))


def audit_rows(df: DataFrame) -> DataFrame:
    """(lang, aug, rows, bad_rows)."""
    return df.groupBy("lang", "aug").agg(F.count("*").alias("rows"), F.count_if(F.size("bad") > 0).alias("bad_rows"))


def first_wins(df: DataFrame, order: str, text_col: str = "text") -> DataFrame:
    """Rows that are the first of their collapsed text; ``order`` tells rows apart.

    Keys and orders alone are aggregated, on the map side first, so a hot text costs a row for each task; the rows are then
    looked up by their order.
    """
    least = df.groupBy(F.md5(collapse_space(F.col(text_col)))).agg(F.min(order).alias("_least")).select("_least")
    return df.join(least, F.col(order) == F.col("_least"), "left_semi")


def split_templates(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(training, held out): a text's side hangs on its hash alone, whatever the version of the set."""
    marked = df.withColumn("_tenth", hash_tenth(F.col(text_col)))
    return marked.filter("_tenth != 0").drop("_tenth"), marked.filter("_tenth = 0").drop("_tenth")


def shuffled(df: DataFrame, seed: int, limit: int | None = None, id_col: str = "id") -> DataFrame:
    """Rows in an order given by seed and id."""
    out = df.orderBy(F.xxhash64(F.lit(seed), id_col), id_col)
    return out.limit(limit) if limit else out


def weighted(df: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times."""
    return df.withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_") if times > 0 else df.limit(0)


def bioes(offsets: Column, spans: Column) -> Column:
    """The tag of each token (start, end): tokens that a span overlaps become S-, or B-, I-..., E-; later spans win.

    Tokens without width get null (they take no part in training).
    """

    def one(s: Column, e: Column, i: Column) -> Column:
        start = F.lit("O")

        def step(tag: Column, sp: Column) -> Column:
            hit = lambda o: (o["end"] > o["start"]) & (o["start"] < sp["end"]) & (o["end"] > sp["start"])
            mine = (e > s) & (s < sp["end"]) & (e > sp["start"])
            before = F.exists(F.slice(offsets, F.lit(1), i), hit)
            after = F.exists(F.slice(offsets, i + 2, F.size(offsets)), hit)
            kind = F.when(before & after, "I-").when(before, "E-").when(after, "B-").otherwise("S-")
            return F.when(mine, F.concat(kind, sp["label"])).otherwise(tag)

        return F.when(e > s, F.aggregate(spans, start, step))

    return F.transform(offsets, lambda o, i: one(o["start"], o["end"], i))
