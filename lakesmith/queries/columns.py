"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, demographics, ids, labels, paths, pii, text
from .inputs import load, sql

# The whitespace class for the checking database's regular expressions.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip_sql(value: str) -> str:
    return f"regexp_replace({value}, '^{_WS}+|{_WS}+$', '', 'g')"


def _collapse_sql(value: str) -> str:
    return f"trim(regexp_replace({value}, '{_WS}+', ' ', 'g'))"


def _ascii_sql(value: str) -> str:
    return f"replace(strip_accents({value}), 'ß', 'ss')"


def clean_text(spark, sf):
    """T1-T5 over whole document texts; results as digests of the full text."""
    df = load(spark, sf, "documents")
    digest = lambda c: F.sha2(c, 256)
    return df.select(
        "doc_id",
        digest(text.collapse_spaces("text")).alias("collapsed"),
        digest(text.null_if_blank("text")).alias("not_blank"),
        digest(text.strip_accents("text")).alias("ascii_text"),
        digest(text.normalize_text("text")).alias("normalized"),
        digest(text.normalize_text("text", upper=False, accents=True)).alias("display_form"),
        digest(text.digits_only("text")).alias("digits"),
    )


_STRIPPED = _strip_sql("text")
CLEAN_TEXT = f"""
    WITH base AS (
      SELECT doc_id, text,
             CASE WHEN {_STRIPPED} = '' OR upper({_STRIPPED}) IN ('NA', 'N/A', 'NULL', 'NONE', '-', '--')
                  THEN NULL ELSE {_STRIPPED} END AS kept
      FROM documents)
    SELECT doc_id, sha256({_collapse_sql('text')}) AS collapsed, sha256(kept) AS not_blank,
           sha256({_ascii_sql('text')}) AS ascii_text,
           sha256(upper({_ascii_sql(_collapse_sql('kept'))})) AS normalized,
           sha256({_collapse_sql('kept')}) AS display_form,
           sha256(nullif(regexp_replace(text, '[^0-9]+', '', 'g'), '')) AS digits
    FROM base"""


def clean_names(spark, sf):
    """Blank markers and padded names of every customer."""
    raw = F.expr(
        """CASE c_nationkey % 6 WHEN 0 THEN ' n/a ' WHEN 1 THEN '--' WHEN 2 THEN '   '
           WHEN 3 THEN '  ' || c_name || '   ' || c_mktsegment || ' ' ELSE c_name END"""
    )
    df = load(spark, sf, "customer").withColumn("raw", raw)
    return df.select(
        "c_custkey", text.normalize_text("raw").alias("normalized"),
        text.null_if_blank("raw").alias("kept"), text.digits_only("raw").alias("digits"),
    )


CLEAN_NAMES = """
    WITH base AS (
      SELECT c_custkey, CASE c_nationkey % 6 WHEN 0 THEN ' n/a ' WHEN 1 THEN '--' WHEN 2 THEN '   '
             WHEN 3 THEN '  ' || c_name || '   ' || c_mktsegment || ' ' ELSE c_name END AS raw
      FROM customer),
    kept AS (
      SELECT c_custkey, raw, CASE WHEN upper(trim(raw)) IN ('', 'N/A', '--') THEN NULL ELSE trim(raw) END AS kept
      FROM base)
    SELECT c_custkey, upper(regexp_replace(kept, ' +', ' ', 'g')) AS normalized, kept,
           nullif(regexp_replace(raw, '[^0-9]', '', 'g'), '') AS digits
    FROM kept"""

_ID_TEXTS = """
    SELECT l_orderkey, l_partkey, l_linenumber,
           '' || lpad('' || l_orderkey, 9, '0') || '-' || lpad('' || (l_partkey % 100), 2, '0') AS cpf_text,
           CASE WHEN l_linenumber <= 3
                THEN '7' || lpad('' || l_partkey, 7, '0') || ' ' || lpad('' || l_orderkey, 7, '0')
                WHEN l_linenumber = 7 THEN '3' || lpad('' || l_orderkey, 14, '0')
                ELSE '1' || lpad('' || l_orderkey, 10, '0') || '.' ||
                     CASE WHEN l_suppkey % 11 = 0 THEN '0018' ELSE '000' || (l_suppkey % 10) END
           END AS cns_text,
           '' || (l_orderkey * (CASE WHEN l_linenumber > 5 THEN 100000 ELSE 1 END)) AS cnes_text,
           substring('aBcDeFgHi', l_linenumber, 1) || CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE '.' END
               || (l_partkey % 1500) AS cid_text
    FROM {lineitem}"""


def validate_ids(spark, sf):
    """I1-I7 on numbers built from every line item."""
    df = spark.sql(_ID_TEXTS, lineitem=load(spark, sf, "lineitem"))
    return df.select(
        "l_orderkey", "l_partkey", "l_linenumber",
        ids.validate_cpf("cpf_text").alias("cpf_valid"), ids.normalize_cpf("cpf_text").alias("cpf"),
        ids.validate_cns("cns_text").alias("cns_valid"), ids.normalize_cns("cns_text").alias("cns"),
        ids.validate_cnes("cnes_text").alias("cnes_valid"), ids.normalize_cnes("cnes_text").alias("cnes"),
        ids.normalize_cid10("cid_text").alias("cid10"),
    )


def _digit_sum(digits: str, count: int, first_weight: int) -> str:
    terms = [f"CAST(substr({digits}, {i + 1}, 1) AS INT) * {first_weight - i}" for i in range(count)]
    return "(" + " + ".join(terms) + ")"


VALIDATE_IDS = f"""
    WITH ids AS ({_ID_TEXTS.replace('{lineitem}', 'lineitem')}),
    d AS (
      SELECT *, regexp_replace(cpf_text, '[^0-9]', '', 'g') AS p, regexp_replace(cns_text, '[^0-9]', '', 'g') AS s,
             regexp_replace(cnes_text, '[^0-9]', '', 'g') AS e,
             upper(regexp_replace(cid_text, '[^A-Za-z0-9]', '', 'g')) AS c
      FROM ids),
    n AS (
      SELECT *, length(p) = 11 AND p <> repeat(p[1], 11)
                AND ({_digit_sum('p', 9, 10)} * 10) % 11 % 10 = CAST(p[10] AS INT)
                AND ({_digit_sum('p', 10, 11)} * 10) % 11 % 10 = CAST(p[11] AS INT) AS cpf_valid,
             11 - {_digit_sum('s', 11, 15)} % 11 AS check_digit
      FROM d),
    v AS (
      SELECT *, CASE WHEN s[1] IN ('7', '8', '9') THEN {_digit_sum('s', 15, 15)} % 11 = 0
                     WHEN s[1] NOT IN ('1', '2') THEN false
                     WHEN check_digit = 11 THEN s[12:15] = '0000'
                     WHEN check_digit = 10
                       THEN s[12:15] = '001' || (11 - ({_digit_sum('s', 11, 15)} + 2) % 11)
                     ELSE s[12:15] = '000' || check_digit END AS cns_valid
      FROM n)
    SELECT l_orderkey, l_partkey, l_linenumber, cpf_valid, CASE WHEN cpf_valid THEN p END AS cpf,
           cns_valid, CASE WHEN cns_valid THEN s END AS cns,
           length(e) = 7 AS cnes_valid, CASE WHEN length(e) <= 7 THEN lpad(e, 7, '0') END AS cnes,
           CASE WHEN regexp_full_match(c, '[A-Z][0-9]{{2}}[0-9]?') THEN c END AS cid10
    FROM v"""

_DATE_TEXTS = """
    SELECT o_orderkey,
           CASE o_orderkey % 13
             WHEN 0 THEN d || '/' || m || '/' || y  WHEN 1 THEN y || '-' || m || '-' || d
             WHEN 2 THEN d || '-' || m || '-' || y  WHEN 3 THEN y || m || d
             WHEN 4 THEN d || '/' || m || '/' || substring(y, 3, 2)
             WHEN 5 THEN d || '/' || m || '/' || y || ' ' || h || ':05:09'
             WHEN 6 THEN y || '-' || m || '-' || d || ' ' || h || ':59:59'
             WHEN 7 THEN y || '-' || m || '-' || d || 'T' || h || ':00:01'
             WHEN 8 THEN d || '/' || m || '/' || y || ' ' || h || ':30'
             WHEN 9 THEN ' ' || y || '-' || m || '-' || d || ' ' || h || ':30 '
             WHEN 10 THEN '31/' || m || '/' || y  WHEN 11 THEN 'sem data ' || o_orderkey
             ELSE '' || (extract(day FROM o_orderdate)) || '/' || (extract(month FROM o_orderdate)) || '/' || y
           END AS raw
    FROM (SELECT o_orderkey, o_orderdate, lpad('' || extract(day FROM o_orderdate), 2, '0') AS d,
                 lpad('' || extract(month FROM o_orderdate), 2, '0') AS m,
                 '' || extract(year FROM o_orderdate) AS y, lpad('' || (o_custkey % 24), 2, '0') AS h
          FROM {orders}) AS parts"""


def parse_dates(spark, sf):
    """D-1, D-2 on order dates written in every accepted form, and junk."""
    df = spark.sql(_DATE_TEXTS, orders=load(spark, sf, "orders"))
    return df.select(
        "o_orderkey", dates.parse_date_br("raw").alias("as_date"), dates.parse_timestamp_br("raw").alias("as_stamp")
    )


_DATE_LIST = "['%d/%m/%Y', '%Y-%m-%d', '%d-%m-%Y', '%Y%m%d']"
_STAMP_LIST = (
    "['%d/%m/%Y %H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%d/%m/%Y %H:%M', '%Y-%m-%d %H:%M']"
)
PARSE_DATES = f"""
    WITH texts AS ({_DATE_TEXTS.replace('{orders}', 'orders')}),
    days AS (
      SELECT o_orderkey, trim(raw) AS raw,
             CASE WHEN regexp_full_match(trim(raw), '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2}}')
                  THEN try_strptime(trim(raw), '%d/%m/%y') ELSE try_strptime(trim(raw), {_DATE_LIST}) END AS day
      FROM texts)
    SELECT o_orderkey, CAST(day AS DATE) AS as_date, coalesce(try_strptime(raw, {_STAMP_LIST}), day) AS as_stamp
    FROM days"""


def to_utc(spark, sf):
    """D-3 to D-7 over years with and without daylight saving, at noon."""
    noon = F.col("o_orderdate") + F.expr("INTERVAL '12' HOUR")
    df = load(spark, sf, "orders").withColumn("wall", noon)
    start, end = dates.day_window("wall", days=3)
    return df.select(
        "o_orderkey", dates.sp_to_utc("wall").alias("utc_clock"),
        dates.sp_to_lake_ntz(dates.utc_instant("wall")).alias("back"),
        start.alias("window_start"), end.alias("window_end"),
    )


TO_UTC = """
    WITH w AS (SELECT o_orderkey, o_orderdate + INTERVAL '12' HOUR AS wall FROM orders)
    SELECT o_orderkey, timezone('UTC', timezone('America/Sao_Paulo', wall)) AS utc_clock, wall AS back,
           wall - INTERVAL '3' DAY AS window_start, wall AS window_end
    FROM w"""

_AGES = """
    SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size * 2 END AS age,
           CASE p_partkey % 7 WHEN 0 THEN 'minuto' WHEN 1 THEN 'hora' WHEN 2 THEN ' Dia ' WHEN 3 THEN 'mes'
                WHEN 4 THEN 'ano' WHEN 5 THEN 'ANO' ELSE p_brand END AS unit
    FROM {part}"""


def age_bands(spark, sf):
    df = spark.sql(_AGES, part=load(spark, sf, "part"))
    code = demographics.age_band("age", "unit")
    return df.select(
        "p_partkey", code.alias("band"), demographics.age_band_label(code).alias("label"),
        demographics.age_band(F.col("age").cast("string"), "unit").alias("band_of_text"),
    )


_BAND = """CASE WHEN age IS NULL THEN 14
    WHEN u IN ('minuto', 'hora', 'dia') THEN CASE WHEN age <= 6 THEN 0 WHEN age <= 27 THEN 1 ELSE 2 END
    WHEN u = 'mes' THEN 2
    WHEN u = 'ano' THEN CASE WHEN age < 1 THEN 2 WHEN age <= 2 THEN 3 WHEN age <= 5 THEN 4
        WHEN age <= 9 THEN 5 WHEN age >= 80 THEN 13 ELSE CAST(floor(age / 10) AS INT) + 5 END
    ELSE 14 END"""
_BAND_LABELS = ", ".join("'" + v + "'" for v in demographics.AGE_BANDS.values())
AGE_BANDS = f"""
    WITH ages AS ({_AGES.replace('{part}', 'part')}),
    bands AS (SELECT p_partkey, {_BAND} AS band FROM (SELECT *, lower(trim(unit)) AS u FROM ages))
    SELECT p_partkey, band, ([{_BAND_LABELS}])[band + 1] AS label, band AS band_of_text FROM bands"""


def hash_ids(spark, sf):
    df = load(spark, sf, "customer")
    blank = F.when(F.col("c_nationkey") == 3, "  ").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" ")))
    return df.select(
        "c_custkey", pii.hash_value("c_custkey", "pepper").alias("key_hash"),
        pii.hash_value(blank, "pepper").alias("name_hash"),
    )


HASH_IDS = """
    SELECT c_custkey, sha256('pepper' || c_custkey) AS key_hash,
           CASE WHEN c_nationkey <> 3 THEN sha256('pepper' || c_name) END AS name_hash
    FROM customer"""


def lake_paths(spark, sf):
    """G2-G6, P12, P13 on every object."""
    df = load(spark, sf, "objects").withColumn("table_uri", paths.delta_uri_from_object_key("bucket", "key"))
    uri = F.concat(F.lit(" s3a://"), "bucket", F.lit("/"), "key")
    return df.select(
        "bucket", "key", "size", "table_uri", paths.delta_uri(uri).alias("short_uri"),
        paths.uri_from_parts("bucket", F.concat(F.lit("/"), "key", F.lit("/"))).alias("long_uri"),
        paths.bucket_from_uri(uri).alias("bucket_of_uri"),
        paths.uri_to_root_prefix("table_uri", "bucket").alias("root"),
        paths.is_ephemeral_delta_uri("table_uri").alias("ephemeral"),
        paths.is_temp_object_key("key").alias("temp"),
    )


LAKE_PATHS = """
    WITH o AS (
      SELECT *, CASE WHEN contains(key, '/_delta_log')
                     THEN regexp_extract(key, '^(.*?)/_delta_log', 1) END AS root
      FROM {objects})
    SELECT bucket, key, size, 's3a://' || bucket || '/' || root AS table_uri,
           's3://' || bucket || '/' || key AS short_uri, 's3a://' || bucket || '/' || key AS long_uri,
           bucket AS bucket_of_uri, root, contains(root, 'run_id=') AS ephemeral, key LIKE '%/_TMP/%' AS temp
    FROM o"""


def report_texts(spark, sf):
    """G1, G7-G9 on order prices and run records."""
    orders = load(spark, sf, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    size = cents * F.pow(F.lit(2), F.col("o_orderkey") % 5 * 8).cast("long")
    growth = labels.growth_pct(cents, (F.col("o_custkey") % 50) * 400000)
    return orders.select(
        "o_orderkey", labels.format_bytes(size).alias("size_text"), growth.alias("growth"),
        labels.format_growth_pct(growth).alias("growth_text"),
    )


REPORT_TEXTS = """
    WITH o AS (
      SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
             CAST((o_custkey % 50) * 400000 AS DOUBLE) AS before,
             CAST(round(o_totalprice * 100) AS BIGINT) * CAST(pow(2, o_orderkey % 5 * 8) AS BIGINT) AS size
      FROM orders),
    g AS (SELECT *, CASE WHEN before > 0 THEN (CAST(cents AS DOUBLE) - before) / before * 100.0
                         WHEN cents > 0 THEN 100.0 END AS growth FROM o)
    SELECT o_orderkey,
           CASE WHEN size < 1024 THEN size || ' B'
                WHEN size < 1024 ** 2 THEN printf('%.1f KiB', size / 1024.0::DOUBLE)
                WHEN size < 1024 ** 3 THEN printf('%.1f MiB', size / (1024.0::DOUBLE ** 2))
                WHEN size < 1024 ** 4 THEN printf('%.1f GiB', size / (1024.0::DOUBLE ** 3))
                WHEN size < 1024 ** 5 THEN printf('%.1f TiB', size / (1024.0::DOUBLE ** 4))
                ELSE printf('%.1f PiB', size / (1024.0::DOUBLE ** 5)) END AS size_text,
           growth, CASE WHEN growth IS NULL THEN 'sem base anterior'
                        ELSE (CASE WHEN growth > 0 THEN '+' ELSE '' END) || printf('%.1f%%', growth) END AS growth_text
    FROM g"""

QUERIES = {
    "clean_text": (clean_text, CLEAN_TEXT),
    "clean_names": (clean_names, CLEAN_NAMES),
    "validate_ids": (validate_ids, VALIDATE_IDS),
    "parse_dates": (parse_dates, PARSE_DATES),
    "to_utc": (to_utc, TO_UTC),
    "age_bands": (age_bands, AGE_BANDS),
    "hash_ids": (hash_ids, HASH_IDS),
    "lake_paths": (lake_paths, sql(LAKE_PATHS)),
    "report_texts": (report_texts, REPORT_TEXTS),
}
