"""Registered queries over the driver's tables, each with DuckDB SQL for the same rows where SQL can express them.

Rules that no text of the tables ever meets (phones, resident numbers, ...) are run on texts made of table keys, in both
forms, so that no comparison is empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import masking as M
from ..functions import spans as S
from ..functions import text as T
from ..functions import validators as V
from ..operators import dataset, decode, leakage, reports, scoring, stress, synth
from ..operators.detect import RULES, both_spans, counts_by_label, detect, entities, rule_spans

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EMAIL, IP, CARD = RULES["EMAIL"], RULES["IPADDRESS"], RULES["CARD_NUMBER"]
LIVE = ["EMAIL", "IPADDRESS", "CARD_NUMBER"]
#: A telephone number made of a customer's key, in DuckDB and in Spark.
PHONE_SQL = "('+1 020-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '-' || lpad(CAST(c_custkey * 7 % 10000 AS VARCHAR), 4, '0'))"
CUSTOMERS = f"(SELECT *, {PHONE_SQL} AS c_phone FROM customer)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumn("c_phone", F.expr(PHONE_SQL.replace("VARCHAR", "STRING")))


def found(spark: SparkSession, sf_dir: str, rules: list[str] | None = None, validate: bool = True) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("spans", rule_spans(F.col("text"), validate, rules))


# DuckDB: whether a string of digits passes the modulo-10 checksum.
LUHN = """(list_sum(list_transform(range(1, length({d}) + 1), lambda i:
    CASE WHEN (length({d}) - i) % 2 = 0 THEN CAST(substr({d}, i, 1) AS INT)
         ELSE (CAST(substr({d}, i, 1) AS INT) * 2) // 10 + (CAST(substr({d}, i, 1) AS INT) * 2) % 10 END)) % 10 = 0)"""
HITS = f"""
    emails AS (SELECT doc_id, lang, 'EMAIL' AS label, unnest(regexp_extract_all(text, '{EMAIL}')) AS value FROM documents),
    ips AS (SELECT doc_id, lang, 'IPADDRESS' AS label, unnest(regexp_extract_all(text, '{IP}')) AS value FROM documents),
    cards AS (SELECT doc_id, lang, 'CARD_NUMBER' AS label, unnest(regexp_extract_all(text, '{CARD}')) AS value FROM documents),
    hits AS (SELECT * FROM emails UNION ALL SELECT * FROM ips UNION ALL
             SELECT * FROM cards WHERE {LUHN.format(d="regexp_replace(value, '[^0-9]', '', 'g')")})"""


def _values(df: DataFrame) -> DataFrame:
    each = df.select("doc_id", "lang", F.posexplode("spans").alias("k", "s"), "text")
    return each.select("doc_id", "lang", F.col("s.label").alias("label"), S.surface(F.col("text"), F.col("s")).alias("value"))


@query(f"WITH {HITS} SELECT doc_id, value FROM hits WHERE label = 'EMAIL'")
def detect_email(spark, sf_dir):
    return _values(found(spark, sf_dir, ["EMAIL"])).select("doc_id", "value")


@query(f"WITH {HITS} SELECT doc_id, value FROM hits WHERE label = 'IPADDRESS'")
def detect_ip(spark, sf_dir):
    return _values(found(spark, sf_dir, ["IPADDRESS"])).select("doc_id", "value")


@query(f"WITH {HITS} SELECT doc_id, value FROM hits WHERE label = 'CARD_NUMBER'")
def detect_card_luhn(spark, sf_dir):
    return _values(found(spark, sf_dir, ["CARD_NUMBER"])).select("doc_id", "value")


@query("SELECT page_id, count(*) AS n_urls FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?:https?://|www\\.)[^\\s,]+')) AS v FROM pages) GROUP BY page_id")
def detect_url_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", rule_spans(F.col("html"), rules=["URL"]).alias("spans"))
    return pages.filter(F.size("spans") > 0).select("page_id", F.size("spans").cast("long").alias("n_urls"))


@query(f"WITH {HITS} SELECT lang, label, count(*) AS n_spans FROM hits GROUP BY lang, label")
def detect_counts_by_label(spark, sf_dir):
    """The flagship: scan, offsets, checksums, overlaps, counts."""
    return counts_by_label(found(spark, sf_dir, LIVE), by=["lang"]).select("lang", "label", "n_spans")


@query(
    f"""WITH {HITS}, nth AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label, value) AS k FROM hits),
    put AS (SELECT doc_id, label, value, CAST(list_sum(list_transform(list_slice(string_split(d.text, value), 1, k), lambda x: length(x))) + (k - 1) * length(value) AS INT) AS p FROM nth JOIN documents d USING (doc_id))
    SELECT doc_id, p AS "start", CAST(p + length(value) AS INT) AS "end", label, CAST(1 AS DOUBLE) AS score FROM put"""
)
def detect_all_rules(spark, sf_dir):
    """All twelve rules, through normalization, with offsets."""
    each = detect(table(spark, sf_dir, "documents")).select("doc_id", F.explode("spans").alias("s"))
    return each.select("doc_id", "s.*")


@query(
    r"""WITH t AS (SELECT c_custkey, 'tel 010-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '-' || lpad(CAST(c_custkey * 7 % 10000 AS VARCHAR), 4, '0')
        || ' pass M' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || ' mac 00:1a:2b:3c:4d:' || lpad(CAST(c_custkey % 90 + 10 AS VARCHAR), 2, '0') || ' biz 123 45 ' || lpad(CAST(c_custkey AS VARCHAR), 5, '1') AS text FROM customer)
    SELECT c_custkey, 'PHONE' AS label, 5 AS "start", 18 AS "end" FROM t UNION ALL
    SELECT c_custkey, 'PASSPORT', 24, 33 FROM t UNION ALL
    SELECT c_custkey, 'MACADDRESS', 38, 55 FROM t UNION ALL
    SELECT c_custkey, 'ACCOUNT_NUMBER', 60, 72 FROM t"""
)
def detect_made_texts(spark, sf_dir):
    """Rules that the tables never meet, on texts made of keys; an account beats a business number, being the earlier rule."""
    k = F.col("c_custkey")
    pad = lambda x, n, c="0": F.lpad(x.cast("string"), n, c)
    text = F.concat(F.lit("tel 010-"), pad(k % 10000, 4), F.lit("-"), pad(k * 7 % 10000, 4), F.lit(" pass M"), pad(k, 8), F.lit(" mac 00:1a:2b:3c:4d:"), pad(k % 90 + 10, 2), F.lit(" biz 123 45 "), pad(k, 5, "1"))
    each = table(spark, sf_dir, "customer").select(k, F.explode(rule_spans(text)).alias("s"))
    return each.select("c_custkey", "s.label", (F.col("s.start") + 1).alias("start"), (F.col("s.end") + 1).alias("end"))


# One pattern for all three live rules: alternatives never overlap in the tables, and RE2 and Java agree on them.
def _masked_sql(put: str) -> str:
    return f"""WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '{EMAIL}') AS e, regexp_extract_all(text, '{IP}') AS i FROM documents)
        SELECT doc_id, {put} AS masked FROM p WHERE len(e) + len(i) > 0"""


@query(_masked_sql(f"regexp_replace(regexp_replace(text, '{EMAIL}', '[EMAIL]', 'g'), '{IP}', '[IPADDRESS]', 'g')"))
def mask_default(spark, sf_dir):
    df = found(spark, sf_dir, ["EMAIL", "IPADDRESS"]).filter(F.size("spans") > 0)
    return df.select("doc_id", M.anonymize(F.col("text"), F.col("spans")).alias("masked"))


@query(
    f"""WITH {HITS}, parts AS (SELECT doc_id, label, value, regexp_extract(value, '^([^@]+)(@.+)$', 1) AS local, regexp_extract(value, '^([^@]+)(@.+)$', 2) AS domain FROM hits)
    SELECT doc_id, label, CASE label
        WHEN 'EMAIL' THEN substr(local, 1, 1) || repeat('*', greatest(length(local) - 1, 1)) || domain
        WHEN 'IPADDRESS' THEN regexp_replace(value, '[0-9]+\\.[0-9]+$', '*.*')
        ELSE (SELECT string_agg(CASE WHEN c BETWEEN '0' AND '9' AND n BETWEEN 7 AND length(regexp_replace(value, '[^0-9]', '', 'g')) - 4 THEN '*' ELSE c END, '' ORDER BY i)
              FROM (SELECT i, substr(value, CAST(i AS INT), 1) AS c, length(regexp_replace(substr(value, 1, CAST(i AS INT)), '[^0-9]', '', 'g')) AS n FROM range(1, length(value) + 1) AS r(i))) END AS shown
    FROM parts"""
)
def mask_partial_values(spark, sf_dir):
    v = _values(found(spark, sf_dir, LIVE))
    return v.select("doc_id", "label", M.replacement(F.col("value"), F.col("label"), "partial").alias("shown"))


SALT = b"fixed salt"


def _hmac_sql(value: str) -> str:
    """HMAC-SHA256 by its definition, in DuckDB."""
    inner, outer = (bytes(b ^ pad for b in SALT.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}' || sha256(unhex('{inner}' || hex(encode({value}))))))"


@query(f"WITH {HITS} SELECT doc_id, label, value, '[' || label || ':' || substr({_hmac_sql('value')}, 1, {M.HASH_LENGTH}) || ']' AS put FROM hits")
def mask_hash(spark, sf_dir):
    """Keyed hashes: each value as a text of its own that is masked as a whole."""
    v = _values(found(spark, sf_dir, LIVE))
    span = F.array(S.span(F.lit(0), F.length("value"), F.col("label"), F.lit(1.0)))
    return v.select("doc_id", "label", "value", M.anonymize(F.col("value"), span, "hash", SALT).alias("put"))


@query(f"WITH {HITS} SELECT doc_id, '<' || CASE label WHEN 'EMAIL' THEN 'EMAIL_ADDRESS' WHEN 'IPADDRESS' THEN 'IP_ADDRESS' ELSE 'CREDIT_CARD' END || '>' AS entity, sha256(value) AS token FROM hits")
def mask_entities(spark, sf_dir):
    v = _values(found(spark, sf_dir, LIVE))
    entity = M.anonymize_entities(F.col("value"), F.array(S.span(F.lit(0), F.length("value"), F.col("label"), F.lit(1.0))))
    return v.select("doc_id", entity.alias("entity"), F.sha2("value", 256).alias("token"))


@query(f"WITH {HITS} SELECT doc_id, count(*) AS total, count(*) FILTER (label = 'CARD_NUMBER') AS sensitive FROM hits GROUP BY doc_id")
def audit_summary(spark, sf_dir):
    df = found(spark, sf_dir, LIVE).filter(F.size("spans") > 0).select("doc_id", M.audit_summary(F.col("spans")).alias("a"))
    return df.select("doc_id", F.col("a.total").cast("long").alias("total"), F.col("a.sensitive").cast("long").alias("sensitive"))


@query(f"WITH {HITS} SELECT doc_id, count(*) AS n FROM hits WHERE label IN ('EMAIL', 'CARD_NUMBER') GROUP BY doc_id")
def entity_filter(spark, sf_dir):
    df = found(spark, sf_dir, LIVE).select("doc_id", F.size(entities(F.col("spans"), ["EMAIL_ADDRESS", "CREDIT_CARD"], 0.5)).cast("long").alias("n"))
    return df.filter("n > 0")


@query("SELECT 'AES' AS kind, count(*) AS n, count(*) AS same FROM customer")
def encrypt_round_trip(spark, sf_dir):
    key = bytes(range(16))
    v = customers(spark, sf_dir).select(F.col("c_phone").alias("v"), M.encrypt(F.col("c_phone"), key).alias("e"))
    return v.agg(F.lit("AES").alias("kind"), F.count("*").alias("n"), F.count_if(M.decrypt(F.col("e"), key) == F.col("v")).alias("same")).select("kind", "n", "same")


# Leakage: every tenth document, by a multiple of its id, against the others.
_TEST = "(doc_id * 7919) % 10 = 0"


def _leak_sql(key: str) -> str:
    return f"""WITH k AS (SELECT doc_id, {key} AS k, {_TEST} AS held FROM documents)
        SELECT doc_id FROM k WHERE held AND k IN (SELECT k FROM k WHERE NOT held)"""


_NORM = r"lower(regexp_replace(text, '[\s]+', '', 'g'))"


def _leaks(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), F.expr(_TEST)
    return leakage.marked(docs.filter(~held), docs.filter(held), levels=(level,)).filter(f"leak_{level}").select("doc_id")


@query(_leak_sql("md5(text)"))
def leakage_exact(spark, sf_dir):
    return _leaks(spark, sf_dir, "exact")


@query(_leak_sql(f"md5({_NORM})"))
def leakage_norm(spark, sf_dir):
    return _leaks(spark, sf_dir, "norm")


@query(_leak_sql(f"md5(regexp_replace({_NORM}, '[0-9]', '0', 'g'))"))
def leakage_masked(spark, sf_dir):
    return _leaks(spark, sf_dir, "masked")


@query(
    r"""WITH b AS (SELECT doc_id, regexp_replace(text, '[\s]+', '', 'g') AS t FROM documents),
    s AS (SELECT regexp_replace(text, '[\s]+', '', 'g') AS t FROM benchmark),
    g AS (SELECT DISTINCT doc_id, substr(t, CAST(i AS INT) + 1, 12) AS g FROM b, range(0, greatest(length(t) - 12, 0) + 1, 3) AS r(i)),
    k AS (SELECT DISTINCT substr(t, CAST(i AS INT) + 1, 12) AS g FROM s, range(0, greatest(length(t) - 12, 0) + 1, 3) AS r(i))
    SELECT doc_id, count(*) AS n_shared FROM g WHERE g IN (SELECT g FROM k) GROUP BY doc_id HAVING count(*) >= 3"""
)
def leakage_ngram12(spark, sf_dir):
    return dataset.leak_suspects(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), id_col="doc_id")


@query(r"SELECT min(doc_id) AS doc_id FROM (SELECT doc_id, trim(regexp_replace(text, '[\s]+', ' ', 'g')) AS k FROM documents) GROUP BY k")
def dedup_first_wins(spark, sf_dir):
    return dataset.first_wins(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id")


@query(
    r"""WITH h AS (SELECT doc_id, md5(trim(regexp_replace(text, '[\s]+', ' ', 'g'))) AS h FROM documents)
    SELECT doc_id, CAST((6 * list_sum(list_transform(range(1, 32), lambda i: instr('0123456789abcdef', substr(h, i, 1)) - 1)) + instr('0123456789abcdef', substr(h, 32, 1)) - 1) % 10 AS INT) AS tenth FROM h"""
)
def hash_split_10pct(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.hash_tenth(F.col("text")).cast("int").alias("tenth"))


@query(
    """WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)
    SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, sum(length(text) + 1) - 1 AS n FROM t GROUP BY conv_id"""
)
def dialogue_concat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).withColumn("spans", F.array().cast(dataset.GOLD))
    return dataset.concat_rows(rows, "conv_id", "turn").select("conv_id", "text", F.length("text").cast("long").alias("n"))


@query(
    """WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\x0B\\f]+')) AS n FROM documents)
    SELECT doc_id, CAST(w AS INT) AS win, CAST(w * 382 AS INT) AS "start", CAST(least(n - w * 382, 510) AS INT) AS n_tokens
    FROM t, range(0, 1 + CAST(ceil(greatest(n - 510, 0) / 382.0) AS INT)) AS r(w) WHERE n > 0"""
)
def windows_512_128(spark, sf_dir):
    tokens = F.filter(F.split("text", "[ \t\n\r\x0b\f]+"), lambda t: t != "")
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(decode.windows(tokens)).alias("w"))
    return each.select("doc_id", "w.win", "w.start", F.size("w.tokens").alias("n_tokens"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked spans as gold, unchecked ones as found."""
    return both_spans(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "gold", "spans", LIVE)


_SCORE = f"""WITH {HITS}, tp AS (SELECT label, count(*) AS tp FROM hits GROUP BY label),
    p AS (SELECT label, count(*) AS p FROM (SELECT * FROM emails UNION ALL SELECT * FROM ips UNION ALL SELECT * FROM cards) GROUP BY label),
    c AS (SELECT p.label, coalesce(tp, 0) AS tp, p - coalesce(tp, 0) AS fp FROM p LEFT JOIN tp USING (label))"""


@query(f"{_SCORE} SELECT label, tp AS support, CAST(tp AS DOUBLE) / (tp + fp) AS p, CASE WHEN tp > 0 THEN 1.0 ELSE 0.0 END AS r, 2.0 * tp / (2 * tp + fp) AS f1 FROM c")
def score_exact(spark, sf_dir):
    return scoring.per_label(scoring.counts(_scored(spark, sf_dir))).select("label", "support", "p", "r", F.round("f1", 12).alias("f1"))


SQL["score_exact"] = SQL["score_exact"].replace("2.0 * tp / (2 * tp + fp) AS f1", "round(2.0 * tp / (2 * tp + fp), 12) AS f1")


@query(f"{_SCORE} SELECT sum(tp)::DOUBLE / sum(tp + fp) AS p, 1.0::DOUBLE AS r, round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp)), 12) AS f1, sum(tp)::BIGINT AS support FROM c")
def score_micro(spark, sf_dir):
    return scoring.micro(scoring.counts(_scored(spark, sf_dir))).select("p", "r", F.round("f1", 12).alias("f1"), F.col("support").cast("long").alias("support"))


@query(f"{_SCORE} SELECT label, round(2.0 * tp / (2 * tp + fp), 12) AS partial_f1 FROM c")
def score_partial(spark, sf_dir):
    """Cards that fail their checksum overlap no checked one, so greedy partial matching leaves them as false alarms."""
    return scoring.per_label(scoring.counts(_scored(spark, sf_dir))).select("label", F.round("partial_f1", 12).alias("partial_f1"))


@query(f"WITH {HITS}, bad AS (SELECT doc_id, count(*) AS n FROM cards WHERE NOT {LUHN.format(d=chr(114) + 'egexp_replace(value, ' + chr(39) + '[^0-9]' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')} GROUP BY doc_id) SELECT doc_id AS id, n AS n_fp, CAST(0 AS BIGINT) AS n_fn FROM bad")
def score_errors(spark, sf_dir):
    return scoring.errors(_scored(spark, sf_dir)).select("id", F.size("fp").cast("long").alias("n_fp"), F.size("fn").cast("long").alias("n_fn"))


@query(
    f"""{_SCORE} SELECT label, tp AS support, round(tp::DOUBLE / (tp + fp), 12) AS p, 1.0::DOUBLE AS r, round(2.0 * tp / (2 * tp + fp), 12) AS f1, round(2.0 * tp / (2 * tp + fp), 12) AS partial_f1,
    round((SELECT 2.0 * sum(tp) / (2 * sum(tp) + sum(fp)) FROM c), 12) AS micro_f1, (SELECT count(*) FROM documents) AS n_rows, 'rules' AS tag FROM c WHERE tp > 0"""
)
def score_evaluate(spark, sf_dir):
    """The report row, unrolled by label."""
    row = scoring.evaluate(_scored(spark, sf_dir), "rules").select(F.explode("per_entity").alias("label", "v"), F.round("micro.f1", 12).alias("micro_f1"), F.col("n_rows").cast("long").alias("n_rows"), "tag")
    return row.select("label", F.col("v.support").cast("long").alias("support"), *(F.round(f"v.{c}", 12).alias(c) for c in ("p", "r", "f1", "partial_f1")), "micro_f1", "n_rows", "tag").filter("support > 0")


@query(f"{_SCORE} SELECT avg(tp::DOUBLE / (tp + fp)) AS p, 1.0::DOUBLE AS r, round(avg(2.0 * tp / (2 * tp + fp)), 12) AS f1, count(*) AS labels FROM c WHERE tp > 0")
def score_macro(spark, sf_dir):
    m = scoring.macro(scoring.per_label(scoring.counts(_scored(spark, sf_dir))))
    return m.select("p", "r", F.round("f1", 12).alias("f1"), F.col("labels").cast("long").alias("labels"))


@query(f"{_SCORE} SELECT round(sum(tp)::DOUBLE / sum(tp + fp), 9) AS p, 1.0::DOUBLE AS r, round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp)), 9) AS f1 FROM c WHERE label IN ('EMAIL', 'CARD_NUMBER')")
def score_restricted(spark, sf_dir):
    """Micro figures over two labels, from the figures by label alone."""
    r = scoring.restricted(scoring.per_label(scoring.counts(_scored(spark, sf_dir))), ["EMAIL", "CARD_NUMBER"])
    return r.select(F.round("p", 9).alias("p"), F.round("r", 9).alias("r"), F.round("f1", 9).alias("f1"))


# Stress: the phone of each customer inside a text of its own.
_STRESS = {
    "sep_dot": ("replace(c_phone, '-', '.')", "c_phone LIKE '%-%'"),
    "sep_space": ("replace(c_phone, '-', ' ')", "c_phone LIKE '%-%'"),
    "sep_none": ("replace(c_phone, '-', '')", "c_phone LIKE '%-%'"),
    "fullwidth": ("translate(c_phone, '0123456789', '０１２３４５６７８９')", "regexp_matches(c_phone, '[0-9]')"),
    "spaced": ("array_to_string(string_split(c_phone, ''), ' ')", "length(c_phone) > 1"),
    "nospace": ("replace(c_phone, ' ', '')", "c_phone LIKE '% %'"),
}


def _stress_query(variant: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = F.col("c_phone")
        gold = F.array(F.struct(F.lit(4).alias("start"), (F.length(p) + 4).alias("end"), F.lit("PHONE").alias("label"))).cast(dataset.GOLD)
        rows = customers(spark, sf_dir).select("c_custkey", F.concat(F.lit("tel "), p, F.lit(" end")).alias("text"), gold.alias("spans"))
        return stress.perturb(rows, variant).select("c_custkey", "text", F.col("spans")[0]["end"].cast("int").alias("end"))

    run.__name__ = f"stress_{variant}"
    return run


for _name, (_new, _if) in _STRESS.items():
    query(f"SELECT c_custkey, 'tel ' || {_new} || ' end' AS text, CAST(4 + length({_new}) AS INT) AS \"end\" FROM {CUSTOMERS} WHERE {_if}")(_stress_query(_name))


@query(
    """WITH RECURSIVE t AS (SELECT row_number() OVER (ORDER BY conv_id, turn, coalesce(text, '')) AS k, length(coalesce(text, '')) AS n FROM conversations),
    r(k, doc, off, n, held) AS (SELECT 0::BIGINT, 0, 0::BIGINT, 0::BIGINT, 0::BIGINT UNION ALL
        SELECT t.k, CASE WHEN r.held >= 1800 THEN r.doc + 1 ELSE r.doc END, CASE WHEN r.held >= 1800 THEN 0 ELSE r.held END, t.n, CASE WHEN r.held >= 1800 THEN 0 ELSE r.held END + t.n + 1 FROM r JOIN t ON t.k = r.k + 1)
    SELECT 'long-' || doc AS id, CAST(max(held) - 1 AS BIGINT) AS n, count(*) FILTER (n > 0) AS n_spans, CAST(coalesce(sum(off) FILTER (n > 0), 0) AS BIGINT) AS starts FROM r WHERE k > 0
    GROUP BY doc HAVING max(held) >= 1800 OR count(*) FILTER (n > 0) > 0"""
)
def longdoc_pack(spark, sf_dir):
    """One stream over all conversations, a span on each text's first character; the text orders rows of the same turn."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    span = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("CVC").alias("label"))).cast(dataset.GOLD)
    rows = rows.withColumn("spans", F.when(F.col("text") != "", span).otherwise(F.array().cast(dataset.GOLD)))
    packed = stress.long_documents(rows.withColumn("ord", F.struct("conv_id", "turn", "text")), "ord")
    starts = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["start"])
    return packed.select("id", F.length("text").cast("long").alias("n"), F.size("spans").cast("long").alias("n_spans"), starts.alias("starts"))


@query(f"WITH {HITS}, found AS (SELECT * FROM emails UNION ALL SELECT * FROM ips UNION ALL SELECT * FROM cards) SELECT label, count(*) AS n, CAST(sum(length(value)) AS BIGINT) AS chars FROM found GROUP BY label")
def overlap_resolve(spark, sf_dir):
    """Unchecked spans of all rules, where cards, accounts and phones compete."""
    each = found(spark, sf_dir, None, False).select("doc_id", F.explode("spans").alias("s"))
    return each.groupBy("s.label").agg(F.count("*").alias("n"), F.sum(F.col("s.end") - F.col("s.start")).cast("long").alias("chars"))


@query("SELECT lang, label, count(*) AS n FROM (SELECT lang, CASE WHEN lower(source) LIKE '%1%' THEN 'one' ELSE 'other' END AS label FROM documents) GROUP BY lang, label")
def source_groups(spark, sf_dir):
    label = F.coalesce(L.map_by_part(F.col("source"), {"1": "one"}), F.lit("other"))
    return table(spark, sf_dir, "documents").groupBy("lang", label.alias("label")).agg(F.count("*").alias("n"))


@query("SELECT label, entity FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in (("PERSON", "PERSON"), ("EMAIL", "EMAIL_ADDRESS"), ("IPADDRESS", "IP_ADDRESS"), ("CARD_NUMBER", "CREDIT_CARD"), ("PHONE", "PHONE_NUMBER"))) + ") t(label, entity)")
def label_dimension(spark, sf_dir):
    return L.dimension(spark).filter(F.col("label").isin("PERSON", "EMAIL", "IPADDRESS", "CARD_NUMBER", "PHONE")).select("label", "entity")


@query(
    f"""WITH {HITS}, e(label, entity, grp) AS (VALUES ('EMAIL', 'EMAIL_ADDRESS', 'contact'), ('IPADDRESS', 'IP_ADDRESS', 'contact'), ('CARD_NUMBER', 'CREDIT_CARD', 'financial'))
    SELECT grp, entity, count(*) AS n FROM hits JOIN e USING (label) GROUP BY grp, entity"""
)
def label_join(spark, sf_dir):
    spans = found(spark, sf_dir, LIVE).select(F.explode("spans").alias("s")).select("s.label")
    return spans.join(F.broadcast(L.dimension(spark)), "label").groupBy("grp", "entity").agg(F.count("*").alias("n"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' results by label: checked and unchecked rules against unchecked ones."""
    rows = both_spans(table(spark, sf_dir, "documents").select("text"), "checked", "unchecked", LIVE)
    each = F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("spans")) for m in ("checked", "unchecked")))
    rows = rows.select(F.col("unchecked").alias("gold"), F.explode(each).alias("m")).select("gold", "m.*")
    return scoring.evaluate(rows, "all", by=["model"]).withColumn("dataset", F.lit("documents"))


@query(
    f"""{_SCORE}, every(label) AS (VALUES {", ".join(f"('{x}')" for x in L.LABELS)})
    SELECT label, coalesce(tp + fp, 0) AS support, round(2.0 * tp / (2 * tp + fp), 12) AS checked, CASE WHEN tp IS NOT NULL THEN 1.0::DOUBLE END AS unchecked FROM every LEFT JOIN c USING (label)"""
)
def pivot_report(spark, sf_dir):
    out = reports.comparison(reports.by_label(_results(spark, sf_dir)), "documents", ["checked", "unchecked"])
    return out.select("label", F.col("support").cast("long").alias("support"), F.round("checked", 12).alias("checked"), F.round("unchecked", 12).alias("unchecked"))


@query(f"{_SCORE} SELECT label, round((tp::DOUBLE / (tp + fp) - 1) * 100, 9) AS delta FROM c WHERE fp > 0 ORDER BY delta LIMIT 3")
def topk_drops(spark, sf_dir):
    out = reports.drops(reports.by_label(_results(spark, sf_dir)), "documents", "unchecked", "checked")
    return out.select("label", F.round("delta", 9).alias("delta"))


# Validators on values made of keys.
_PART = {
    "RRN": ("lpad(CAST(p_partkey % 1000000 AS VARCHAR), 6, '9') || '-' || lpad(CAST(p_partkey * 31 % 10000000 AS VARCHAR), 7, '3')", r"CAST(substr(v, 3, 2) AS INT) BETWEEN 1 AND 12 AND CAST(substr(v, 5, 2) AS INT) BETWEEN 1 AND 31 AND substr(v, 8, 1) IN ('1', '2', '3', '4')"),
    "FRN": ("'900101-' || lpad(CAST(p_partkey * 31 % 10000000 AS VARCHAR), 7, '7')", "substr(v, 8, 1) IN ('5', '6', '7', '8')"),
    "IPADDRESS": ("CAST(p_partkey % 400 AS VARCHAR) || '.1.2.3'", "CAST(split_part(v, '.', 1) AS INT) < 256"),
    "PORT": ("CAST(p_partkey * 100 AS VARCHAR)", "CAST(v AS BIGINT) BETWEEN 1 AND 65535"),
    "CARD_EXPIRY": ("lpad(CAST(p_partkey % 20 AS VARCHAR), 2, '0') || '/27'", "CAST(substr(v, 1, 2) AS INT) BETWEEN 1 AND 12"),
    "CVC": ("CAST(p_partkey AS VARCHAR)", "length(v) BETWEEN 3 AND 4"),
    "ZIPCODE": ("CAST(p_partkey * 7 AS VARCHAR)", "length(v) = 5"),
    "SSN": ("lpad(CAST(p_partkey AS VARCHAR), 3, '1') || '-45-' || CAST(p_partkey AS VARCHAR)", r"regexp_full_match(v, '\d{3}-?\d{2}-?\d{4}') OR regexp_full_match(v, '\d{9,11}')"),
    "EMAIL": ("'u' || CAST(p_partkey AS VARCHAR) || CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE '' END || '@x.org'", "p_partkey % 3 != 0"),
    "CARD_NUMBER": ("repeat('4', CAST(p_partkey % 24 AS INT))", "length(v) BETWEEN 13 AND 19"),
    "IMEI": ("repeat('4', CAST(p_partkey % 24 AS INT))", "length(v) = 15"),
    "DRIVER_LICENSE": ("lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '1') || '-22-' || CAST(p_partkey * 997 AS VARCHAR) || '-10'", r"regexp_full_match(v, '\d{2}-\d{2}-\d{6}-\d{2}')"),
    "PASSPORT": ("CASE WHEN p_partkey % 2 = 0 THEN 'M' ELSE 'm' END || lpad(CAST(p_partkey * 31337 AS VARCHAR), 8, '0')", "p_partkey % 2 = 0 AND length(v) = 9"),
    "BUSINESS_ID": ("'123-' || CAST(p_partkey % 120 AS VARCHAR) || '-45678'", "p_partkey % 120 BETWEEN 10 AND 99"),
    "VIRTUAL_CARD_NUMBER": ("repeat('4', CAST(p_partkey % 24 AS INT))", "length(v) BETWEEN 10 AND 19"),
    "MACADDRESS": ("'00:1a:2b:3c:4d:' || CAST(p_partkey % 130 AS VARCHAR)", "p_partkey % 130 BETWEEN 10 AND 99"),
    "VEHICLE_PLATE": ("CAST(p_partkey % 1200 AS VARCHAR) || '가' || ' 1234'", "p_partkey % 1200 BETWEEN 10 AND 999"),
    "URL": ("CASE WHEN p_partkey % 2 = 0 THEN 'https://x/' ELSE 'ftp:x/' END || CAST(p_partkey AS VARCHAR)", "p_partkey % 2 = 0"),
    "PHONE": ("CASE WHEN p_partkey % 5 = 0 THEN '(010) ' WHEN p_partkey % 5 = 1 THEN 'tel ' ELSE '' END || repeat('1', CAST(p_partkey % 12 AS INT))", "p_partkey % 5 > 1 AND p_partkey % 12 >= 7"),
    "PERSON": ("CASE WHEN p_partkey % 2 = 0 THEN '김' ELSE 'A' END || repeat('x', CAST(p_partkey % 25 AS INT))", "CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 25 = 0 ELSE length(v) <= 20 END"),
    "ACCOUNT_NUMBER": ("repeat('4', CAST(p_partkey % 30 AS INT)) || CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE '' END", "p_partkey % 7 != 0 AND length(v) BETWEEN 8 AND 24"),
}


@query("\nUNION ALL ".join(f"SELECT p_partkey, '{k}' AS label, v, CAST({ok} AS BOOLEAN) AS ok FROM (SELECT p_partkey, {v} AS v FROM part)" for k, (v, ok) in _PART.items()))
def validate_labels(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    each = F.array(*(F.struct(F.lit(k).alias("label"), F.expr(v.replace("VARCHAR", "STRING")).alias("v")) for k, (v, _) in _PART.items()))
    rows = part.select("p_partkey", F.explode(each).alias("x")).select("p_partkey", "x.*")
    return rows.withColumn("ok", V.check(F.col("label"), F.col("v"), F.lit("ko")))


@query(f"SELECT c_custkey, d AS digits, length(d) >= 12 AND {LUHN.format(d='d')} AS ok FROM (SELECT c_custkey, regexp_replace(c_phone, '[^0-9]', '', 'g') || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS d FROM {CUSTOMERS})")
def card_checksum(spark, sf_dir):
    d = F.concat(T.digits(F.col("c_phone")), F.lpad(F.col("c_custkey").cast("string"), 6, "0"))
    return customers(spark, sf_dir).select("c_custkey", d.alias("digits"), V.card_checksum(d).alias("ok"))


@query("SELECT doc_id, length(text) AS n, text AS normalized FROM documents")
def normalize_keeps_length(spark, sf_dir):
    """No text of the tables changes; the tests have texts that do."""
    return table(spark, sf_dir, "documents").select("doc_id", F.length(T.normalize(F.col("text"))).cast("long").alias("n"), T.normalize(F.col("text")).alias("normalized"))


@query("SELECT CAST(id AS INT) AS id, CAST(e AS INT) AS \"end\" FROM (VALUES (1, 3), (2, 2), (3, 2), (4, 2), (5, 13), (6, 12), (7, 15)) t(id, e)")
def particle_strip(spark, sf_dir):
    rows = [(1, "김철수는", "PERSON"), (2, "지훈아", "PERSON"), (3, "철수야", "PERSON"), (4, "수아", "PERSON"), (5, "010-9876-5432로", "PHONE"), (6, "2024년 3월 15일에", "DATE"), (7, "a@example.com으로", "EMAIL")]
    df = spark.createDataFrame(rows, "id int, text string, label string")
    spans = F.array(S.span(F.lit(0), F.length("text"), F.col("label"), F.lit(1.0)))
    return df.select("id", S.drop_particles(F.col("text"), spans)[0]["end"].alias("end"))


@query(
    """WITH t AS (SELECT c_custkey, list_transform(range(0, 12), lambda i: i * 6) AS places, c_custkey % 40 AS a, c_custkey % 40 + 1 + c_custkey % 23 AS b FROM customer),
    o AS (SELECT c_custkey, list_transform(places, lambda s: s < b AND a < s + 5) AS hit FROM t)
    SELECT c_custkey, list_transform(range(1, 13), lambda i: CASE WHEN NOT hit[i] THEN 'O'
        WHEN (i = 1 OR NOT hit[i - 1]) AND (i = 12 OR NOT hit[i + 1]) THEN 'S-ADDRESS' WHEN i = 1 OR NOT hit[i - 1] THEN 'B-ADDRESS'
        WHEN i = 12 OR NOT hit[i + 1] THEN 'E-ADDRESS' ELSE 'I-ADDRESS' END) AS tags FROM o"""
)
def bioes_tags(spark, sf_dir):
    """Twelve tokens of five characters with a span whose place and length follow from the key."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.struct((i * 6).alias("start"), (i * 6 + 5).alias("end")))
    k = F.col("c_custkey")
    start = (k % 40).cast("int")
    spans = F.array(F.struct(start.alias("start"), (start + 1 + (k % 23).cast("int")).alias("end"), F.lit("ADDRESS").alias("label")))
    return table(spark, sf_dir, "customer").select("c_custkey", dataset.bioes(tokens, spans).alias("tags"))


# Unified rows made of customers: a telephone in a text, its mask as JSON; every third mask is cut short, so that it fails.
_MASK_END = "CASE WHEN c_custkey % 3 = 0 THEN 9 ELSE 4 + length(c_phone) END"


@query(f"SELECT 'bc-t-' || c_custkey AS id, 'bccard/made' AS source, c_custkey % 3 != 0 AS valid, CASE WHEN c_custkey % 3 = 0 THEN ['PHONE'] ELSE [] END AS bad, CAST({_MASK_END} AS INT) AS \"end\" FROM {CUSTOMERS}")
def unify_masked_rows(spark, sf_dir):
    end = F.expr(_MASK_END)
    mask = F.concat(F.lit('[{"label":"PHONE","value":"","start":4,"end":'), end.cast("string"), F.lit("}]"))
    rows = customers(spark, sf_dir).select(F.col("c_custkey").alias("uid"), F.concat(F.lit("tel "), "c_phone").alias("source_text"), F.lit("en").alias("language"), F.lit("made").alias("source_dataset"), F.lit("none").alias("augmentation_type"), mask.alias("privacy_mask"))
    return dataset.unify_masked(rows, "t").select("id", "source", "valid", "bad", F.col("spans")[0]["end"].cast("int").alias("end"))


def _assembly(clean: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        gold = F.array().cast(dataset.GOLD)
        docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("k")).withColumn("spans", gold)
        masked = docs.filter("k % 3 = 0").withColumn("valid", F.col("k") % 2 == 0).drop("k")
        others = docs.filter("k % 3 = 1").withColumn("valid", F.lit(True)).drop("k")
        held = docs.filter("k % 30 = 2").drop("k")
        return dataset.assemble(masked, others, others.limit(0), held, clean).select(F.col("id").cast("long").alias("doc_id"), "valid")

    run.__name__ = f"assemble_{'clean' if clean else 'full'}"
    return run


for _clean in (True, False):
    query(
        rf"""WITH b AS (SELECT doc_id, regexp_replace(text, '[\s]+', '', 'g') AS t FROM documents),
        g AS (SELECT DISTINCT doc_id, substr(t, CAST(i AS INT) + 1, 12) AS g FROM b, range(0, greatest(length(t) - 12, 0) + 1, 3) AS r(i) WHERE doc_id % 3 = 1 OR doc_id % 30 = 2),
        held AS (SELECT DISTINCT g FROM g WHERE doc_id % 30 = 2), leaky AS (SELECT doc_id FROM g WHERE doc_id % 3 = 1 AND g IN (SELECT g FROM held) GROUP BY doc_id HAVING count(*) >= 3)
        SELECT doc_id, doc_id % 2 = 0 AS valid FROM documents WHERE doc_id % 3 = 0 {"AND doc_id % 2 = 0" if _clean else ""} UNION ALL
        SELECT doc_id, true FROM documents WHERE doc_id % 3 = 1 AND doc_id NOT IN (SELECT doc_id FROM leaky)"""
    )(_assembly(_clean))


# The rules that no text of the tables meets, each in a text made of a key: hits need borders, checks and separators.
_RRN_HEAD = "'9001011' || lpad(CAST(c_custkey AS VARCHAR), 5, '0')"
_RRN_SUM = "(" + " + ".join(f"{w} * CAST(substr({_RRN_HEAD}, {i + 1}, 1) AS INT)" for i, w in enumerate((2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5))) + ")"
_RULE_TEXTS = {
    "RRN": (f"'no 900101-1' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') || CAST((11 - {_RRN_SUM} % 11) % 10 AS VARCHAR) || '.'", 3, 17),
    "DRIVER_LICENSE": ("'id 11 22 ' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || ' 44.'", 3, 18),
    "PORT": ("'host:' || CAST(1000 + c_custkey % 9000 AS VARCHAR) || '.'", 5, 9),
    "PASSPORT": ("'pass M' || lpad(CAST(c_custkey AS VARCHAR), 8, '0')", 5, 14),
}


def _rule_text(k: str, to: str) -> str:
    return _RULE_TEXTS[k][0].replace("VARCHAR", to)


@query("\nUNION ALL ".join(f"SELECT c_custkey, '{k}' AS label, {_rule_text(k, 'VARCHAR')} AS text, {a} AS \"start\", {b} AS \"end\" FROM customer" for k, (_, a, b) in _RULE_TEXTS.items()))
def detect_rare_rules(spark, sf_dir):
    """One rule at a time, so that no earlier one takes its match; resident numbers pass their checksum."""
    out = None
    for k in _RULE_TEXTS:
        text = F.expr(_rule_text(k, "STRING"))
        each = table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"), F.explode(rule_spans(text, True, [k])).alias("s")).select("c_custkey", "s.label", "text", "s.start", "s.end")
        out = each if out is None else out.unionByName(each)
    return out


@query()
def synth_fill(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("template_id"), F.lit("note").alias("genre"), F.lit("고객 {PERSON}, 연락처 {PHONE}, 카드 {CARD_NUMBER} 확인. 감사합니다.").alias("text"))
    return synth.fill(rows, 4, 42).select("id", "text", F.size("spans").alias("n_spans"))


@query("SELECT label, CAST(20 AS BIGINT) AS made, CAST(20 AS BIGINT) AS passed FROM (VALUES " + ", ".join(f"('{x}')" for x in L.LABELS) + ") t(label)")
def synth_values(spark, sf_dir):
    """Each label's values pass its validator: generators and validators agree."""
    passes = V.check(F.col("label"), F.col("value"), F.lit("ko")).cast("long")
    return synth.generated(spark, list(L.LABELS), 20).groupBy("label").agg(F.count("*").alias("made"), F.sum(passes).alias("passed"))


@query(f"SELECT lang, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (length(v) NOT BETWEEN 7 AND 15) AS BIGINT) AS failed FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'en' ELSE 'fr' END AS lang, regexp_replace(c_phone, '[^0-9]', '', 'g') || repeat('1', CAST(c_custkey % 9 AS INT)) AS v FROM {CUSTOMERS}) GROUP BY lang")
def audit_labels(spark, sf_dir):
    v = F.concat(T.digits(F.col("c_phone")), F.expr("repeat('1', cast(c_custkey % 9 as int))"))
    rows = customers(spark, sf_dir).select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "en").otherwise("fr").alias("lang"), v.alias("text"))
    rows = rows.withColumn("spans", F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.lit("PHONE").alias("label"))))
    return dataset.audit(rows).select("lang", "total", "failed")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
