"""Registered queries of the privacy engine, each with DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions import checks
from maskwright.functions.let import once
from maskwright.functions.strings import preview, safe_file_name
from maskwright.operators import detectors, names
from maskwright.operators.engine import detect, raw_detections
from maskwright.operators.registry import capabilities, default_registry
from maskwright.operators.resolve import resolve_overlaps
from maskwright.plans import analytics
from maskwright.plans.options import TYPES, AnalyzeOptions, BlockedWord, CustomPattern, analyze_options
from maskwright.plans.pipeline import analyze, gate, sanitize
from maskwright.sources import assembly, docx, files, formats, pdf
from maskwright.sources.arrow import with_columns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(found: DataFrame, *keys: str) -> DataFrame:
    """Detections as flat rows."""
    own = found.withColumn("found", once(F.col("found")))
    return own.select(*keys, F.explode("found").alias("d")).select(*keys, F.col("d.start").cast("long").alias("start_at"), F.col("d.end").cast("long").alias("end_at"), F.col("d.value").alias("value"), F.col("d.confidence").alias("confidence"))


def spans_sql(source: str, pattern: str, key: str = "doc_id", group: int = 0) -> str:
    """DuckDB SQL for (key, start_at, value) of all matches; with a group, of the part in it."""
    p = pattern.replace("'", "''")
    value = f"regexp_extract(m[i], '{p}', {group})" if group else "m[i]"
    shift = f" + strpos(m[i], {value}) - 1" if group else ""
    return f"""
      SELECT {key}, text, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0){shift} AS BIGINT) AS start_at, {value} AS value
      FROM (SELECT {key}, text, g, m, unnest(range(1, len(m) + 1)) AS i
            FROM (SELECT {key}, text, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}') AS m FROM {source}) WHERE len(m) > 0)"""


def luhn_sql(d: str) -> str:
    return f"(list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST({d}[length({d}) - i + 1] AS INT) ELSE (CAST({d}[length({d}) - i + 1] AS INT) * 2) // 10 + (CAST({d}[length({d}) - i + 1] AS INT) * 2) % 10 END)) % 10 = 0)"


def flat_sql(inner: str, confidence: str, key: str = "doc_id", where: str = "true") -> str:
    return f"SELECT {key}, start_at, CAST(start_at + length(value) AS BIGINT) AS end_at, value, CAST({confidence} AS DOUBLE) AS confidence FROM ({inner}) WHERE {where}"


EMAIL_SQL = f"""SELECT doc_id, text, start_at, regexp_replace(value, '[.-]+$', '') AS value FROM ({spans_sql("documents", "[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:[.][A-Za-z0-9-]{1,63}){1,8}")}) WHERE regexp_matches(regexp_replace(value, '[.-]+$', ''), '[.][A-Za-z]{{2,24}}$')"""
OCTET_SQL = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4_SQL = f"""SELECT * FROM ({spans_sql("documents", "[0-9.]+")}) WHERE regexp_full_match(value, '{OCTET_SQL}(?:[.]{OCTET_SQL}){{3}}')"""
JS_SPACE = r"[\s\x{000B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}.-]"
NANP_SQL = spans_sql("documents", rf"(?:^|[^0-9(])((?:\+?1{JS_SPACE}*)?(?:\([0-9]{{3}}\){JS_SPACE}*|[0-9]{{3}}{JS_SPACE}+)[0-9]{{3}}{JS_SPACE}+[0-9]{{4}})(?:[^0-9]|$)", group=1)


@query(flat_sql(EMAIL_SQL, "0.95"))
def detect_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(table(spark, sf_dir, "documents").select("doc_id", detectors.email(F.col("text")).alias("found")), "doc_id")


@query(flat_sql(IPV4_SQL, "0.85"))
def detect_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(table(spark, sf_dir, "documents").select("doc_id", detectors.ip_address(F.col("text")).alias("found")), "doc_id")


@query(flat_sql(NANP_SQL, "0.8"))
def detect_phone_nanp(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detectors.detections(detectors.spans(F.col("text"), detectors.NANP), "PHONE", 0.8, "phone")
    return rows_of(table(spark, sf_dir, "documents").select("doc_id", found.alias("found")), "doc_id")


NETWORK_SQL = """CASE WHEN length(d) IN (13, 16, 19) AND d LIKE '4%' THEN 'Visa'
  WHEN length(d) = 16 AND (d[1:2] BETWEEN '51' AND '55' OR d[1:4] BETWEEN '2221' AND '2720') THEN 'Mastercard'
  WHEN length(d) = 15 AND d[1:2] IN ('34', '37') THEN 'American Express'
  WHEN length(d) IN (16, 19) AND (d LIKE '6011%' OR d LIKE '65%' OR d[1:6] BETWEEN '622126' AND '622925') THEN 'Discover'
  WHEN length(d) IN (16, 17, 18, 19) AND d[1:4] BETWEEN '3528' AND '3589' THEN 'JCB'
  WHEN length(d) IN (14, 16, 19) AND (d[1:3] BETWEEN '300' AND '305' OR d[1:2] IN ('36', '38', '39')) THEN 'Diners Club'
  WHEN length(d) IN (16, 17, 18, 19) AND d LIKE '62%' THEN 'UnionPay' END"""
IMPLAUSIBLE_SQL = "(d = repeat(d[1:1], length(d)) OR strpos('0123456789', d) > 0)"
#: Runs of at most 19 digits read as a whole, and 16 digits from each place of longer ones.
CARD_SQL = f"""
WITH c AS ({spans_sql("documents", "[0-9](?:[ -]?[0-9]){11,21}")}),
w AS (
  SELECT doc_id, start_at AS run, start_at, value, 0 AS ord FROM c WHERE length(regexp_replace(value, '[ -]', '', 'g')) <= 19
  UNION ALL
  SELECT doc_id, start_at, CAST(start_at + length(regexp_extract(value, '^((?:[0-9][ -]?){{' || k || '}})', 1)) AS BIGINT), regexp_extract(value, '^(?:[0-9][ -]?){{' || k || '}}([0-9](?:[ -]?[0-9]){{15}})', 1), k + 1
  FROM c, (SELECT unnest(range(0, 7)) AS k) WHERE length(regexp_replace(value, '[ -]', '', 'g')) > 19
),
j AS (SELECT *, regexp_replace(value, '[ -]', '', 'g') AS d FROM w WHERE value <> ''),
k AS (SELECT *, {NETWORK_SQL} AS brand, {luhn_sql("d")} AS luhn FROM j WHERE length(d) BETWEEN 13 AND 19 AND NOT {IMPLAUSIBLE_SQL}),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY ord) AS n FROM k WHERE luhn OR (brand IS NOT NULL AND regexp_matches(value, '[ -]')))
SELECT doc_id, start_at, CAST(start_at + length(value) AS BIGINT) AS end_at, value, CAST(CASE WHEN NOT luhn THEN 0.86 WHEN brand IS NULL THEN 0.75 ELSE 0.98 END AS DOUBLE) AS confidence, brand, d[length(d) - 3:] AS last4
FROM f WHERE n = 1"""


@query(CARD_SQL)
def detect_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", once(detectors.credit_card(F.col("text"))).alias("found")).select("doc_id", F.explode("found").alias("d"))
    return found.select("doc_id", F.col("d.start").cast("long").alias("start_at"), F.col("d.end").cast("long").alias("end_at"), "d.value", "d.confidence", F.col("d.metadata")["cardBrand"].alias("brand"), F.col("d.metadata")["last4"].alias("last4"))


URL_SQL = spans_sql("(SELECT page_id, 'see <' || url || '>, or ' || url || '.' AS text FROM pages)", r"https?://[^\s\x{000B}\x{00A0}\x1f<>\x22'\x60]+", "page_id")


@query(f"SELECT page_id, start_at, CAST(start_at + length(v) AS BIGINT) AS end_at, v AS value, CAST(0.9 AS DOUBLE) AS confidence FROM (SELECT *, regexp_replace(value, '[.,;:!?)\\]}}>\"'']+$', '') AS v FROM ({URL_SQL}))")
def detect_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("see <"), F.col("url"), F.lit(">, or "), F.col("url"), F.lit("."))
    return rows_of(table(spark, sf_dir, "pages").select("page_id", detectors.url(text).alias("found")), "page_id")


MASK_SQL = "CASE WHEN length(x) <= 1 THEN x ELSE x[1:1] || repeat('•', least(length(x) - 1, 4)) END"


@query(f"""SELECT page_id, regexp_extract(url, '^(https?)://', 1) || '://' || array_to_string(list_transform(h[1:len(h) - 1], lambda x: {MASK_SQL}), '.') || '.' || h[len(h)] AS preview
FROM (SELECT page_id, url, string_split(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '.') AS h FROM pages)""")
def preview_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", preview(F.lit("URL"), F.col("url"), F.lit(None).cast("map<string,string>")).alias("preview"))


@query(r"""SELECT page_id, CASE WHEN c = '' THEN 'document' ELSE c END || '.txt' AS safe_name FROM (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '[.][^.]*$', ''), '[^A-Za-z0-9._-]', '_', 'g'), '[.]{2,}', '.', 'g'), '^[._-]+', '')[1:80] AS c FROM pages)""")
def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", safe_file_name(F.col("url"), F.lit(".txt")).alias("safe_name"))


# Texts made from keys, alike in both engines, for detectors that the tables have nothing for.
DERIVED = {
    "sin": "concat('SIN: ', lpad({k} % 1000, 3, '0'), '-', lpad(({k} * 7) % 1000, 3, '0'), '-', lpad(({k} * 13) % 1000, 3, '0'), ' end')",
    "us_ssn": "concat('ref ', lpad(({k} * 3) % 1000, 3, '0'), '-', lpad({k} % 100, 2, '0'), '-', lpad(({k} * 11) % 10000, 4, '0'), '.')",
    "bare": "concat(CASE {k} % 3 WHEN 0 THEN 'Social  Insurance Number ' WHEN 1 THEN 'ssn: ' ELSE 'reference ' END, lpad(({k} * 7919) % 1000000000, 9, '0'), ' x')",
    "masked": "concat('card ***-**-', lpad({k} % 10000, 4, '0'), CASE {k} % 4 WHEN 0 THEN '-' ELSE ' ' END, '***-***-', lpad({k} % 1000, 3, '0'))",
    "routing": "concat(CASE {k} % 2 WHEN 0 THEN 'ABA routing ' ELSE 'number ' END, lpad(({k} * 104729) % 1000000000, 9, '0'))",
    "account": "concat(CASE {k} % 3 WHEN 0 THEN 'Account Number ' WHEN 1 THEN 'acct. ' ELSE 'acct:' END, lpad({k}, cast(5 + {k} % 14 AS INT), '0'), CASE {k} % 5 WHEN 0 THEN '-1' ELSE ' ' END)",
    "address": "concat('at ', {k} % 99999, ' Old Mill Road', CASE {k} % 2 WHEN 0 THEN ', Suite 4B' ELSE '' END, ', Spring Field, ', CASE {k} % 3 WHEN 0 THEN 'or' ELSE 'OR' END, ' ', lpad({k} % 100000, 5, '0'), CASE {k} % 4 WHEN 0 THEN '-1234' ELSE '' END)",
    "ipv6": "concat('on ', lpad({k} % 10000, 4, '0'), ':db8:', {k} % 7, ':', lpad({k} % 100, CASE {k} % 4 WHEN 0 THEN 5 ELSE 3 END, '0'), ':ffff up')",
    "phone": "concat('call ', CASE {k} % 5 WHEN 0 THEN '+44 20 7946 ' WHEN 1 THEN '+1 (415) 555-' WHEN 2 THEN '(415) 555-' WHEN 3 THEN '115 555 ' ELSE '415555' END, lpad({k} % 10000, 4, '0'), ' now')",
    "names": "CASE {k} % 4 WHEN 0 THEN 'met Mary Von Stone Quality Assurance' WHEN 1 THEN 'paid Acme Widgets Inc today' WHEN 2 THEN 'the file of Dr. Smith now' ELSE 'met nobody at all' END",
    "vanity": "concat('call 1-8', lpad({k} % 100, 2, '0'), '-', lpad({k} % 1000, 3, '0'), '-', CASE {k} % 2 WHEN 0 THEN 'DATA' ELSE 'DATAS' END, ' now')",
}


def derived_sql(name: str) -> str:
    text = DERIVED[name].format(k="o_orderkey")
    # the first argument of lpad is text in DuckDB
    out, at = "", 0
    while (i := text.find("lpad(", at)) >= 0:
        j, depth = i + 5, 0
        while text[j] != "," or depth:
            depth += {"(": 1, ")": -1}.get(text[j], 0)
            j += 1
        out += text[at : i + 5] + f"CAST({text[i + 5 : j]} AS VARCHAR)"
        at = j
    return f"(SELECT o_orderkey, {out + text[at:]} AS text FROM orders)"


def derived(spark: SparkSession, sf_dir: str, name: str, detector: Callable[[Column], Column]) -> DataFrame:
    texts = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(DERIVED[name].format(k="o_orderkey")).alias("text"))
    return rows_of(texts.select("o_orderkey", detector(F.col("text")).alias("found")), "o_orderkey")


def whole_runs_sql(name: str, members: str, pattern: str) -> str:
    """Matches that no member of a class adjoins: whole runs of the class."""
    return f"SELECT * FROM ({spans_sql(derived_sql(name), f'[{members}]+', 'o_orderkey')}) WHERE regexp_full_match(value, '{pattern}')"


DIGITS_SQL = "regexp_replace(value, '[^0-9]', '', 'g')"
US_SQL = "regexp_full_match({d}, '[0-9]{{9}}') AND {d}[1:3] NOT IN ('000', '666') AND {d}[1:1] <> '9' AND {d}[4:5] <> '00' AND {d}[6:9] <> '0000'"
SIN_SQL = "{d} <> '000000000' AND {luhn}"


@query(flat_sql(whole_runs_sql("sin", "0-9-", "[0-9]{3}-[0-9]{3}-[0-9]{3}"), "0.95", "o_orderkey", SIN_SQL.format(d=DIGITS_SQL, luhn=luhn_sql(DIGITS_SQL))))
def detect_sin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "sin", detectors.social_number)


@query(flat_sql(whole_runs_sql("us_ssn", "0-9-", "[0-9]{3}-[0-9]{2}-[0-9]{4}"), "0.9", "o_orderkey", US_SQL.format(d=DIGITS_SQL)))
def detect_us_ssn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "us_ssn", detectors.social_number)


@query(flat_sql(whole_runs_sql("bare", "0-9-", "[0-9]{9}"), f"CASE WHEN {luhn_sql('value')} THEN 0.8 ELSE 0.7 END", "o_orderkey", f"NOT text LIKE 'reference%' AND value <> '000000000' AND ({luhn_sql('value')} OR {US_SQL.format(d='value')})"))
def detect_compact_ssn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "bare", detectors.social_number)


@query(
    f"SELECT o_orderkey, start_at, CAST(start_at + 11 AS BIGINT) AS end_at, value, CAST(0.85 AS DOUBLE) AS confidence FROM (SELECT * FROM ({spans_sql(derived_sql('masked'), '[*]{3}-[*]{2}-[0-9]{4}', 'o_orderkey')}) WHERE text[start_at + 12:start_at + 12] NOT IN ('-') UNION ALL SELECT * FROM ({spans_sql(derived_sql('masked'), '[*]{3}-[*]{3}-[0-9]{3}', 'o_orderkey')}))"
)
def detect_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "masked", detectors.social_number)


ABA_SQL = "(3 * (CAST(value[1] AS INT) + CAST(value[4] AS INT) + CAST(value[7] AS INT)) + 7 * (CAST(value[2] AS INT) + CAST(value[5] AS INT) + CAST(value[8] AS INT)) + CAST(value[3] AS INT) + CAST(value[6] AS INT) + CAST(value[9] AS INT)) % 10 = 0"


@query(flat_sql(whole_runs_sql("routing", "0-9-", "[0-9]{9}"), "0.9", "o_orderkey", f"text LIKE 'ABA%' AND {ABA_SQL} AND value <> '000000000'"))
def detect_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "routing", detectors.bank_account)


@query(flat_sql(spans_sql(derived_sql("account"), r"(?i)(?:account number|acct[.]?)\s+([0-9]{6,17})(?:[^0-9-]|$)", "o_orderkey", 1), "0.85", "o_orderkey"))
def detect_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    # bare nine-digit routing numbers need wording that these texts lack
    return derived(spark, sf_dir, "account", detectors.bank_account)


@query(flat_sql(spans_sql(derived_sql("address"), r"\b[0-9]{1,6}\s+[A-Z][\p{L}.'-]*(?:\s+[A-Z][\p{L}.'-]*){0,5}(?:,\s*(?:Suite|Ste[.]?|Apt[.]?|Unit)\s+[0-9A-Za-z_-]+)?,\s*[A-Z][\p{L}.'-]*(?:\s+[A-Z][\p{L}.'-]*)*,\s*[A-Z]{2}\s+[0-9]{5}(?:-[0-9]{4})?\b", "o_orderkey"), "0.7", "o_orderkey"))
def detect_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "address", detectors.address)


@query(flat_sql(whole_runs_sql("ipv6", ":A-Za-z0-9_", "(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}"), "0.9", "o_orderkey"))
def detect_ipv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "ipv6", detectors.ip_address)


@query(flat_sql(spans_sql(derived_sql("vanity"), r"\b1[\s.-]?8[0-9]{2}[\s.-][0-9]{3}[\s.-][A-Z]{4}\b", "o_orderkey"), "0.8", "o_orderkey"))
def detect_vanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "vanity", detectors.phone)


@query(f"""SELECT o_orderkey, CAST(5 AS BIGINT) AS start_at, CAST(5 + length(value) AS BIGINT) AS end_at, value, CAST(CASE o_orderkey % 5 WHEN 0 THEN 0.7 WHEN 3 THEN 0.8 ELSE 0.95 END AS DOUBLE) AS confidence
FROM (SELECT o_orderkey, text[6:length(text) - 4] AS value FROM {derived_sql("phone")})""")
def detect_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """International, national and formatted numbers, with a region."""
    return derived(spark, sf_dir, "phone", lambda text: detectors.phone(text, "US"))


SPACE_SQL = JS_SPACE.replace(".-]", "]")
PARTICLE_SQL = names.PARTICLE.replace("'", "''")
QUOTED = lambda words: ", ".join(f"'{w}'" for w in words)
HEADING_SQL = f"(x IN ({QUOTED(names.HEADINGS)}) OR x IN ({QUOTED(names.NAME_ENDS)}) OR (length(x) > 1 AND x = upper(x) AND x <> lower(x)))"
NAMED_SQL = r"regexp_full_match(x, '\p{Lu}[\p{L}-]+(?:''[\p{L}-]+)?')"
#: Names are cut out of their runs by list functions, then looked for in the whole text by splitting it at each.
PERSON_SQL = f"""
WITH m AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '\\b\\p{{Lu}}[\\p{{L}}-]+(?:{SPACE_SQL}+(?:{PARTICLE_SQL}{SPACE_SQL}+)?\\p{{Lu}}[\\p{{L}}-]+){{1,5}}\\b')) AS raw FROM documents),
w AS (SELECT doc_id, text, raw, string_split_regex(raw, '{SPACE_SQL}+') AS ws FROM m),
f AS (SELECT *, list_position(list_transform(ws, lambda x: NOT {HEADING_SQL} AND {NAMED_SQL}), true) AS k FROM w),
g AS (SELECT *, ws[k:] AS rest FROM f WHERE k > 0),
h AS (SELECT *, coalesce(list_position(list_transform(rest, lambda x: {HEADING_SQL} OR NOT (regexp_full_match(x, '{PARTICLE_SQL}') OR {NAMED_SQL})), true), 0) AS stop FROM g),
i AS (SELECT *, CASE WHEN stop > 0 THEN rest[1:stop - 1] ELSE rest END AS kept FROM h),
v AS (
  SELECT DISTINCT doc_id, text, array_to_string(kept, ' ') AS value FROM i
  WHERE len(kept) >= 2 AND contains(raw, array_to_string(kept, ' ')) AND len(list_filter(kept, lambda x: NOT regexp_full_match(x, '{PARTICLE_SQL}'))) > 0
    AND len(list_filter(kept, lambda x: NOT ({HEADING_SQL} OR regexp_full_match(x, '{PARTICLE_SQL}')))) > 0),
p AS (SELECT doc_id, text, value, parts, unnest(range(1, len(parts))) AS n FROM (SELECT *, string_split(text, value) AS parts FROM v)),
o AS (SELECT *, CAST(list_sum(list_transform(parts[1:n], lambda x: length(x))) + (n - 1) * length(value) AS BIGINT) AS start_at FROM p)
SELECT doc_id, start_at, CAST(start_at + length(value) AS BIGINT) AS end_at, value, CAST(0.58 AS DOUBLE) AS confidence FROM o
WHERE NOT regexp_matches(text[start_at:start_at], '[\\p{{L}}\\p{{N}}_]') AND NOT regexp_matches(text[start_at + length(value) + 1:start_at + length(value) + 1], '[\\p{{L}}\\p{{N}}_]')"""


@query(PERSON_SQL)
def detect_person_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(table(spark, sf_dir, "documents").select("doc_id", names.person_sequences(F.col("text")).alias("found")), "doc_id")


@query("SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 5 ELSE 12 END AS BIGINT) AS start_at, CAST(CASE o_orderkey % 4 WHEN 0 THEN 18 ELSE 21 END AS BIGINT) AS end_at, CASE o_orderkey % 4 WHEN 0 THEN 'Mary Von Stone' WHEN 1 THEN 'Acme Widgets Inc' ELSE 'Dr. Smith' END AS value, CAST(CASE o_orderkey % 4 WHEN 1 THEN 0.55 ELSE 0.6 END AS DOUBLE) AS confidence FROM orders WHERE o_orderkey % 4 < 3")
def detect_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon people and organisations, in texts made from keys."""
    return derived(spark, sf_dir, "names", names.lexicon_names)


WORDS = AnalyzeOptions(("CUSTOM",), (CustomPattern("ARTICLE", r"\bthe\s+of\b", True), CustomPattern("NUMBER", r"\b\d{3,5}\b")))


@query(
    f"SELECT doc_id, start_at, CAST(start_at + length(value) AS BIGINT) AS end_at, value, CAST(1 AS DOUBLE) AS confidence FROM (SELECT * FROM ({spans_sql('documents', JS_SPACE.join([r'(?i)' + chr(92) + 'bthe', '+of' + chr(92) + 'b']).replace('.-]', ']'))}) UNION ALL SELECT * FROM ({spans_sql('documents', chr(92) + 'b[0-9]{3,5}' + chr(92) + 'b')}))"
)
def detect_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(table(spark, sf_dir, "documents").select("doc_id", detectors.custom(F.col("text"), WORDS.custom_patterns).alias("found")), "doc_id")


BLOCKED = analyze_options(("CUSTOM",), [BlockedWord("the", True), BlockedWord("and", True)], "blocked word")


@query(r"""SELECT conv_id, turn, count(*) AS hits, count(DISTINCT w) AS distinct_values FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '(?i)\b(?:the|and)\b')) AS w FROM conversations) GROUP BY conv_id, turn""")
def blacklist_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", once(detect(F.col("text"), BLOCKED)).alias("found")).select("conv_id", "turn", F.explode("found").alias("d"))
    return found.groupBy("conv_id", "turn").agg(F.count("*").alias("hits"), F.countDistinct("d.value").alias("distinct_values"))


EMAIL_ONLY = AnalyzeOptions(("EMAIL",))
EMAIL_NUMBERED = f"""(SELECT *, '[EMAIL_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END || ']' AS placeholder FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY first) AS n FROM (SELECT *, min(start_at) OVER (PARTITION BY doc_id, lower(value)) AS first FROM ({EMAIL_SQL}))))"""


@query(f"SELECT doc_id, placeholder, arg_min(value, start_at) AS preview_raw, CAST(count(*) AS BIGINT) AS occurrences, CAST(0.95 AS DOUBLE) AS confidence FROM {EMAIL_NUMBERED} GROUP BY doc_id, placeholder")
def placeholder_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    analyzed = analyze(table(spark, sf_dir, "documents").select("doc_id", "text"), EMAIL_ONLY)
    return analyzed.select("doc_id", F.explode("groups").alias("g")).select("doc_id", "g.placeholder", "g.preview_raw", "g.occurrences", "g.confidence")


@query(f"SELECT doc_id, start_at, placeholder, n AS number FROM {EMAIL_NUMBERED}")
def placeholder_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The allocation by window functions, over exploded rows."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(detectors.email(F.col("text"))).alias("d")).select("doc_id", "d.*")
    return analytics.placeholder_numbers(found).select("doc_id", F.col("start").cast("long").alias("start_at"), "placeholder", "number")


def redact_sql(numbered: str) -> str:
    """Text rewritten piece by piece: what lies before each value, its placeholder, and the rest."""
    return f"""SELECT d.doc_id, coalesce(r.sanitized, d.text) AS sanitized FROM documents d LEFT JOIN (
      SELECT doc_id, string_agg(text[since + 1:start_at] || placeholder, '' ORDER BY start_at) || any_value(text[stop + 1:]) AS sanitized FROM (
        SELECT *, coalesce(lag(start_at + length(value)) OVER (PARTITION BY doc_id ORDER BY start_at), 0) AS since, max(start_at + length(value)) OVER (PARTITION BY doc_id) AS stop FROM {numbered}) GROUP BY doc_id) r ON d.doc_id = r.doc_id"""


@query(redact_sql(EMAIL_NUMBERED))
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitize(analyze(table(spark, sf_dir, "documents").select("doc_id", "text"), EMAIL_ONLY)).select("doc_id", "sanitized")


@query(redact_sql(f"(SELECT * FROM {EMAIL_NUMBERED} WHERE placeholder <> '[EMAIL_001]')"))
def redact_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    analyzed = analyze(table(spark, sf_dir, "documents").select("doc_id", "text"), EMAIL_ONLY)
    return sanitize(analyzed, F.array(F.lit("[EMAIL_001]"))).select("doc_id", "sanitized")


ALL_NATIVE = AnalyzeOptions(("EMAIL", "PHONE", "CREDIT_CARD", "SSN", "IP_ADDRESS", "URL", "BANK_ACCOUNT", "ADDRESS"))


@query("SELECT doc_id, 'pass' AS status FROM documents")
def verify_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, rewritten by the checksummed detectors, passes verification."""
    return sanitize(analyze(table(spark, sf_dir, "documents").select("doc_id", "text"), EMAIL_ONLY)).select("doc_id", "status")


@query(f"SELECT d.doc_id, CASE WHEN r.doc_id IS NULL THEN 'pass' ELSE 'fail' END AS status FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM ({EMAIL_SQL}) WHERE length(trim(value)) >= 4) r ON d.doc_id = r.doc_id")
def verify_unreplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verification of texts that were not rewritten fails wherever there was something to replace."""
    from maskwright.operators import verify

    own = analyze(table(spark, sf_dir, "documents").select("doc_id", "text"), EMAIL_ONLY)
    own = own.withColumn("hay", verify.haystack(F.col("text"))).withColumn("forms", F.transform("detections", lambda x: x["value"]))
    left = verify.residual(F.col("hay"), F.col("detections"), F.col("forms"))
    return own.select("doc_id", F.when(F.size(left) > 0, "fail").otherwise("pass").alias("status"))


@query()
def verify_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sanitized = sanitize(analyze(table(spark, sf_dir, "documents").select("doc_id", "text"), ALL_NATIVE))
    return sanitized.groupBy("status").agg(F.count("*").alias("documents"), F.sum("replaced_occurrences").alias("replaced"))


@query()
def sanitize_released(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline with all types, through the gate."""
    options = AnalyzeOptions(tuple(t for t in TYPES if t != "CUSTOM"))
    parts = gate(sanitize(analyze(table(spark, sf_dir, "documents").select("doc_id", "text"), options)))
    return parts.released.select("doc_id", "sanitized", F.col("replaced_groups").cast("long"), F.col("replaced_occurrences").cast("long"))


@query()
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate holds back where a placeholder's value is kept in one place only by over-narrow patterns."""
    options = AnalyzeOptions(("CUSTOM",), (CustomPattern("LOWER", r"\bthe of\b"),))
    parts = gate(sanitize(analyze(table(spark, sf_dir, "documents").select("doc_id", "text"), options)))
    return parts.quarantined.select("doc_id", "error_code", "http_status", F.size("offending").cast("long").alias("offending"))


TWO_SQL = f"(SELECT doc_id, 'EMAIL' AS type, value, CAST(0.95 AS DOUBLE) AS confidence FROM ({EMAIL_SQL}) UNION ALL SELECT doc_id, 'IP_ADDRESS', value, CAST(0.85 AS DOUBLE) FROM ({IPV4_SQL}))"


def two_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = F.concat(detectors.email(F.col("text")), detectors.ip_address(F.col("text")))
    return docs.select("doc_id", "lang", "source", once(found).alias("found")).select("doc_id", "lang", "source", F.explode("found").alias("d")).select("doc_id", "lang", "source", "d.*")


@query(f"SELECT lang, type, count(*) AS detections, count(DISTINCT f.doc_id) AS documents, round(avg(confidence), 6) AS confidence FROM {TWO_SQL} f JOIN documents d ON f.doc_id = d.doc_id GROUP BY lang, type")
def pii_by_type_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.by_type(two_types(spark, sf_dir), "lang")


@query(f"SELECT CASE WHEN grouping(source) = 1 THEN 'ALL' ELSE source END AS source, CASE WHEN grouping(type) = 1 THEN 'ALL' ELSE type END AS type, count(*) AS detections FROM {TWO_SQL} f JOIN documents d ON f.doc_id = d.doc_id GROUP BY CUBE (source, type)")
def pii_by_source_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.cube(two_types(spark, sf_dir), "source", "type")


@query(f"SELECT doc_id, count(*) AS detections, count(DISTINCT value) AS distinct_values FROM {TWO_SQL} GROUP BY doc_id ORDER BY detections DESC, doc_id LIMIT 10")
def top_docs_by_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_documents(two_types(spark, sf_dir), 10)


@query(f"SELECT DISTINCT type, lower(value) AS key FROM {TWO_SQL}")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = two_types(spark, sf_dir)
    return found.select("type", analytics.canonical_key(F.col("type"), F.col("value"), F.col("metadata")).alias("key")).distinct()


@query(f"SELECT type, lower(value) AS key, count(DISTINCT doc_id) AS documents, count(*) AS occurrences, min(doc_id) AS first_doc FROM {TWO_SQL} GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 2")
def shared_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.shared_values(two_types(spark, sf_dir))


@query(f"SELECT coalesce(CAST(toxic AS VARCHAR), 'unlabelled') AS toxic, count(*) AS documents, CAST(sum(n) AS BIGINT) AS detections FROM (SELECT d.doc_id, l.toxic, coalesce(f.n, 0) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM {TWO_SQL} GROUP BY doc_id) f ON d.doc_id = f.doc_id) GROUP BY 1")
def toxic_vs_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = F.size(F.concat(detectors.email(F.col("text")), detectors.ip_address(F.col("text"))))
    joined = docs.select("doc_id", n.alias("n")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy(F.coalesce(F.col("toxic").cast("string"), F.lit("unlabelled")).alias("toxic")).agg(F.count("*").alias("documents"), F.sum("n").alias("detections"))


@query("SELECT event_id, true AS valid FROM events")
def json_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", formats.json_valid(F.col("props")).alias("valid"))


SHAPES = "concat(c_custkey, ',', c_custkey % 7, CASE c_custkey % 5 WHEN 0 THEN ',x' ELSE '' END, '\n', c_custkey % 3, ',b', CASE c_custkey % 4 WHEN 0 THEN '\n\n' ELSE '\n' END, 'q,r')"


@query(f"SELECT c_custkey, c_custkey % 5 <> 0 AS is_csv FROM (SELECT c_custkey, {SHAPES} AS text FROM customer)")
def csv_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(SHAPES.replace("\n", "\\n"))
    return table(spark, sf_dir, "customer").select("c_custkey", formats.looks_like_csv(text).alias("is_csv"))


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'json' WHEN 3 THEN 'csv' WHEN 4 THEN 'txt' END AS format, CASE WHEN c_custkey % 6 = 5 THEN 'UNSUPPORTED_FORMAT' END AS error_code FROM customer")
def sniff_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*(x for i, v in enumerate(["%PDF-1.7 x", "PK\x03\x04 word/document.xml", ' {"a": [1, 2]}', "a,b\n1,2\n", "plain words", "PK\x03\x04 other"]) for x in (F.lit(i), F.lit(v))))
    made = table(spark, sf_dir, "customer").select("c_custkey", kinds[(F.col("c_custkey") % 6).cast("int")].cast("binary").alias("content"))
    return formats.sniffed(made, extension=None).select("c_custkey", "format", "error_code")


CARD_DIGITS = "concat(CASE o_orderkey % 9 WHEN 0 THEN '4' WHEN 1 THEN '51' WHEN 2 THEN '2300' WHEN 3 THEN '37' WHEN 4 THEN '6011' WHEN 5 THEN '3530' WHEN 6 THEN '301' WHEN 7 THEN '62' ELSE '9' END, {pad})"


@query(f"SELECT o_orderkey, d AS digits, {NETWORK_SQL} AS network, length(d) BETWEEN 12 AND 19 AND {luhn_sql('d')} AS luhn, {IMPLAUSIBLE_SQL} AS implausible FROM (SELECT o_orderkey, {CARD_DIGITS.format(pad='lpad(CAST(o_orderkey AS VARCHAR), CAST(10 + o_orderkey % 8 AS INT), chr(55))')} AS d FROM orders)")
def card_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.expr(CARD_DIGITS.format(pad="lpad(o_orderkey, cast(10 + o_orderkey % 8 as int), '7')"))
    own = table(spark, sf_dir, "orders").select("o_orderkey", digits.alias("digits"))
    d = F.col("digits")
    return own.select("o_orderkey", "digits", checks.card_network(d).alias("network"), checks.luhn(d).alias("luhn"), checks.implausible(d).alias("implausible"))


@query(f"SELECT o_orderkey, {ABA_SQL} AND value <> '000000000' AS aba, {US_SQL.format(d='value')} AS us_ssn, value <> '000000000' AND {luhn_sql('value')} AS sin FROM (SELECT o_orderkey, lpad(CAST((o_orderkey * 104729) % 1000000000 AS VARCHAR), 9, '0') AS value FROM orders)")
def number_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr("lpad((o_orderkey * 104729) % 1000000000, 9, '0')")
    own = table(spark, sf_dir, "orders").select("o_orderkey", value.alias("v"))
    return own.select("o_orderkey", checks.aba_routing(F.col("v")).alias("aba"), checks.us_ssn(F.col("v")).alias("us_ssn"), checks.canadian_sin(F.col("v")).alias("sin"))


@query(
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{t}', '{label}', '{m}', '{'|'.join(d)}')"
        for t, label, m, d in ((t, TYPES[t], m, d) for t, m, d in default_registry().coverage())
    )
    + ", ('CUSTOM', 'Custom patterns', 'stub', '')) AS v(type, label, maturity, detectors)"
)
def capability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capabilities(spark).withColumn("detectors", F.array_join("detectors", "|"))


THE_SQL = spans_sql("(SELECT conv_id, string_agg(coalesce(text, ''), chr(12) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)", chr(92) + "b(?i:the)" + chr(92) + "b", "conv_id")
CONVERSATION_SQL = f"""
WITH whole AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(12) ORDER BY turn) AS text, list(turn ORDER BY turn) AS turns FROM conversations GROUP BY conv_id),
n AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY first) AS k FROM (SELECT *, min(start_at) OVER (PARTITION BY conv_id, value) AS first FROM ({THE_SQL}))),
p AS (SELECT *, coalesce(lag(start_at + length(value)) OVER (PARTITION BY conv_id ORDER BY start_at), 0) AS since, max(start_at + length(value)) OVER (PARTITION BY conv_id) AS stop FROM n),
r AS (SELECT conv_id, string_agg(text[since + 1:start_at] || '[REDACTED_' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END || ']', '' ORDER BY start_at) || any_value(text[stop + 1:]) AS sanitized FROM p GROUP BY conv_id),
s AS (SELECT w.conv_id, w.turns, string_split(coalesce(r.sanitized, w.text), chr(12)) AS parts FROM whole w LEFT JOIN r ON w.conv_id = r.conv_id)
SELECT conv_id, turns[i] AS turn, parts[i] AS sanitized, 'pass' AS status FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM s)"""


@query(CONVERSATION_SQL)
def conversation_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation share its placeholders: they are analysed as one text and cut again."""
    turns = table(spark, sf_dir, "conversations")
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    joined = whole.withColumn("text", F.array_join(F.transform("turns", lambda t: F.coalesce(t["text"], F.lit(""))), assembly.BLOCK_BREAK))
    done = sanitize(analyze(joined, analyze_options(("EMAIL", "PHONE"), [BlockedWord("the", True)])))
    parts = assembly.split_blocks(F.col("sanitized"), F.size("turns"))
    return done.select("conv_id", F.posexplode(parts).alias("n", "sanitized"), "status", "turns").select("conv_id", F.get("turns", F.col("n"))["turn"].alias("turn"), "sanitized", "status")


LAYOUT = "SELECT CAST(l_orderkey AS BIGINT) AS page, CAST(l_linenumber AS INT) AS seq, concat('w', l_linenumber, CASE l_partkey % 5 WHEN 0 THEN '-' ELSE '' END) AS str, CAST(10 + (l_linenumber % 3) * 40 AS DOUBLE) AS x, CAST(700 - 12 * floor((l_linenumber - 1) / 3) - (l_partkey % 2) AS DOUBLE) AS y, CAST(CASE l_suppkey % 6 WHEN 0 THEN 14 ELSE 10 END AS DOUBLE) AS height, CAST(20 + l_partkey % 15 AS DOUBLE) AS width FROM lineitem"


ASSEMBLY_SQL = f"""
WITH r AS ({LAYOUT}),
p AS (SELECT *, (seq - 1) // 3 AS line, x - lag(x + width) OVER (PARTITION BY page, (seq - 1) // 3 ORDER BY seq, str, x, y, height, width) AS gap FROM r),
l AS (SELECT page, line, first(y ORDER BY seq, str, x, y, height, width) AS y, max(height) AS height, string_agg(CASE WHEN gap >= 16 THEN chr(31) ELSE '' END || str, '' ORDER BY seq, str, x, y, height, width) AS text FROM p GROUP BY page, line),
w AS (SELECT *, lag(y) OVER o - y AS step, lag(height) OVER o AS above FROM l WINDOW o AS (PARTITION BY page ORDER BY line)),
g AS (SELECT *, sum(CASE WHEN above < 12 AND height < 12 AND step > 0 AND step <= above * 1.65 THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY line) AS paragraph FROM w),
j AS (SELECT *, CASE WHEN line = max(line) OVER (PARTITION BY page, paragraph) OR text LIKE '%-' THEN '' ELSE ' ' END AS joiner FROM g),
q AS (SELECT page, paragraph, string_agg(text || joiner, '' ORDER BY line) AS text FROM j GROUP BY page, paragraph)
SELECT page, string_agg(text, chr(10) || chr(10) ORDER BY paragraph) AS text FROM q GROUP BY page"""


@query(ASSEMBLY_SQL)
def text_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs from positioned pieces, made from line items."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("maskwright_lineitem")
    return assembly.pages(spark.sql(LAYOUT.replace("lineitem", "maskwright_lineitem", 10).replace("l_maskwright_lineitem", "l_lineitem")), "page")


@query("SELECT doc_id, length(text) + 1 + length(source) AS size, CAST(length(text) + 1 AS BIGINT) AS second_start, replace(text, chr(10), ' ') AS flat FROM documents")
def flatten_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = lambda name, text: F.struct(F.lit(name).alias("locator"), F.lit("body").alias("region"), text.alias("text"))
    flat = assembly.flattened(F.array(block("a", F.col("text")), block("b", F.col("source"))))
    docs = table(spark, sf_dir, "documents").withColumn("flat", flat)
    return docs.select("doc_id", F.length("flat.text").cast("long").alias("size"), F.get(F.col("flat.segments"), F.lit(1))["start"].cast("long").alias("second_start"), assembly.for_detection(F.col("text")).alias("flat"))


@query("SELECT supplier.s_suppkey AS s_suppkey, 'Mail [EMAIL_001] now' AS text, 'pass' AS status FROM supplier")
def docx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word files made from keys are read, rewritten, written and read again."""

    def document(key: int) -> bytes:
        body = f'<w:p><w:r><w:t>Mail s{key}@ex</w:t></w:r><w:r><w:t>ample.org now</w:t></w:r></w:p>'
        return docx.write_zip({"word/document.xml": f"<w:document><w:body>{body}</w:body></w:document>".encode()})

    made = with_columns(table(spark, sf_dir, "supplier").select("s_suppkey"), lambda key: (document(key),), ("s_suppkey",), content=T.BinaryType())
    done = sanitize(analyze(docx.extracted(made).select("s_suppkey", "content", "text"), EMAIL_ONLY))
    again = docx.extracted(docx.rewritten(done).select("s_suppkey", "bytes", "status"), "bytes")
    return again.select("s_suppkey", "text", "status")


CLAIMS = "SELECT DISTINCT l_orderkey, l_partkey % 40 AS start_at, l_partkey % 40 + 1 + l_suppkey % 9 AS end_at, CASE l_linenumber % 3 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'PHONE' ELSE 'PERSON' END AS kind, 0.5 + (l_suppkey % 2) * 0.25 AS confidence FROM lineitem"
CLAIMS_SQL = f"""
WITH RECURSIVE c AS ({CLAIMS}),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY end_at - start_at DESC, confidence DESC, CASE kind WHEN 'EMAIL' THEN 70 WHEN 'PHONE' THEN 65 ELSE 30 END DESC, start_at) AS k FROM c),
s AS (
  SELECT l_orderkey, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(a BIGINT, b BIGINT, t VARCHAR)[]) AS taken FROM (SELECT DISTINCT l_orderkey FROM c)
  UNION ALL
  SELECT s.l_orderkey, r.k, CASE WHEN len(list_filter(taken, lambda x: x.a < r.end_at AND r.start_at < x.b)) > 0 THEN taken ELSE list_append(taken, CAST({{'a': r.start_at, 'b': r.end_at, 't': r.kind}} AS STRUCT(a BIGINT, b BIGINT, t VARCHAR))) END
  FROM s JOIN r ON s.l_orderkey = r.l_orderkey AND r.k = s.k + 1)
SELECT l_orderkey, x.a AS start_at, x.b AS end_at, x.t AS kind FROM (SELECT l_orderkey, unnest(arg_max(taken, k)) AS x FROM s GROUP BY l_orderkey)"""


@query(CLAIMS_SQL)
def overlap_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims made from line items, resolved order by order."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("maskwright_claims")
    claims = spark.sql(CLAIMS.replace("FROM lineitem", "FROM maskwright_claims"))
    span = F.struct(F.col("kind").alias("type"), F.col("start_at").cast("int").alias("start"), F.col("end_at").cast("int").alias("end"), F.lit("").alias("value"), F.col("confidence").cast("double").alias("confidence"), F.lit("x").alias("detector"), F.lit(None).cast("map<string,string>").alias("metadata"))
    found = claims.groupBy("l_orderkey").agg(F.collect_list(span).alias("found"))
    kept = found.select("l_orderkey", F.explode(resolve_overlaps(F.col("found"))).alias("d"))
    return kept.select("l_orderkey", F.col("d.start").cast("long").alias("start_at"), F.col("d.end").cast("long").alias("end_at"), F.col("d.type").alias("kind"))


FILES_SQL = """SELECT s_suppkey, CASE k WHEN 0 THEN 'txt' WHEN 1 THEN 'csv' WHEN 2 THEN 'json' WHEN 3 THEN 'docx' WHEN 4 THEN 'pdf' END AS format,
  CASE WHEN k < 5 THEN 'sanitized-f' || s_suppkey || CASE k WHEN 0 THEN '.txt' WHEN 1 THEN '.csv' WHEN 2 THEN '.json' WHEN 3 THEN '.docx' ELSE '.pdf' END END AS sanitized_name,
  CASE k WHEN 0 THEN 'to [EMAIL_001] and [EMAIL_001]' WHEN 1 THEN 'name,mail' || chr(10) || 'x,[EMAIL_001]' || chr(10) WHEN 2 THEN '{"mail": "[EMAIL_001]"}' END AS said,
  CASE k WHEN 5 THEN 'UNSUPPORTED_FORMAT' END AS error_code FROM (SELECT s_suppkey, s_suppkey % 6 AS k FROM supplier)"""


@query(FILES_SQL)
def process_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of every format, made from keys, through reading, rewriting, writing, reading back and the gate."""

    def made(key: int) -> tuple[str, bytes]:
        mail = f"s{key}@example.org"
        word = docx.write_zip({"word/document.xml": f"<w:document><w:p><w:t>s{key}@exa</w:t><w:t>mple.org</w:t></w:p></w:document>".encode()})
        kinds = (f"to {mail} and {mail.upper()}".encode(), f"name,mail\nx,{mail}\n".encode(), f'{{"mail": "{mail}"}}'.encode(), word, pdf.write_pdf(f"Mail {mail}\n\nagain {mail}\x0cpage")[0], b"\xff\xfe")
        return f"f{key}.{('txt', 'csv', 'json', 'docx', 'pdf', 'bin')[key % 6]}", kinds[key % 6]

    keys = table(spark, sf_dir, "supplier").select("s_suppkey")
    done = files.process(with_columns(keys, made, ("s_suppkey",), file_name=T.StringType(), content=T.BinaryType()), EMAIL_ONLY)
    said = F.when(~F.col("format").isin("docx", "pdf"), F.col("bytes").cast("string"))
    return done.select("s_suppkey", "format", "sanitized_name", said.alias("said"), "error_code")


@query()
def resolve_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of all checksummed detectors before and after resolution."""
    docs = table(spark, sf_dir, "documents").select("doc_id", once(raw_detections(F.col("text"), ALL_NATIVE)).alias("raw"))
    return docs.select("doc_id", F.size("raw").cast("long").alias("claims"), F.size(resolve_overlaps(F.col("raw"))).cast("long").alias("standing")).filter("claims > 0")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all native detectors, rewritten and verified."""
    done = sanitize(analyze(table(spark, sf_dir, "documents").select("doc_id", "text"), ALL_NATIVE))
    return done.select("doc_id", "sanitized", F.col("replaced_groups").cast("long"), F.col("replaced_occurrences").cast("long"), "status")


