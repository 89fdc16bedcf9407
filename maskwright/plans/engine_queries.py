"""Registered queries of the engine as a whole: overlaps, verification, the gate, and what guards files.

Texts are made from keys or taken from tables, alike in both engines, and every answer is computed in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions.let import once
from maskwright.functions.strings import encodable, preview
from maskwright.operators import anonymize, names, verify
from maskwright.operators.engine import detect, raw_detections, well_formed
from maskwright.operators.resolve import resolve_overlaps
from maskwright.plans.options import AnalyzeOptions, InvalidInput, check_pattern, redaction_tag
from maskwright.plans.pipeline import analyze, gate, sanitize
from maskwright.plans.queries import CARD_SQL, EMAIL_NUMBERED, EMAIL_ONLY, EMAIL_SQL, IPV4_SQL, OCTET_SQL, query, redact_sql, spans_sql, table
from maskwright.sources import assembly, docx, formats
from maskwright.sources.arrow import with_columns


def resolved_sql(claims: str, key: str) -> str:
    """DuckDB SQL: the claims (key, type, start_at, end_at, value, confidence, detector) that stand, by recursion over the strongest first."""
    rank = "CASE type WHEN 'CREDIT_CARD' THEN 90 WHEN 'EMAIL' THEN 70 WHEN 'URL' THEN 60 WHEN 'IP_ADDRESS' THEN 55 END"
    return f"""(
      WITH RECURSIVE c AS ({claims}),
      r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY end_at - start_at DESC, confidence DESC, {rank} DESC, start_at, detector) AS k FROM c),
      s AS (
        SELECT {key}, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(a BIGINT, b BIGINT, k BIGINT)[]) AS taken FROM (SELECT DISTINCT {key} FROM c)
        UNION ALL
        SELECT s.{key}, r.k, CASE WHEN len(list_filter(taken, lambda x: x.a < r.end_at AND r.start_at < x.b)) > 0 THEN taken ELSE list_append(taken, CAST({{'a': r.start_at, 'b': r.end_at, 'k': r.k}} AS STRUCT(a BIGINT, b BIGINT, k BIGINT))) END
        FROM s JOIN r ON s.{key} = r.{key} AND r.k = s.k + 1),
      u AS (SELECT {key}, unnest(arg_max(taken, k)) AS x FROM s GROUP BY {key})
      SELECT r.* FROM r JOIN u ON r.{key} = u.{key} AND r.k = u.x.k)"""


MIXED = "concat('see https://u', o_orderkey % 50, '.example.org/a?m=x', o_orderkey % 7, '@ex.org and 10.', o_orderkey % 300, '.0.7 or http://10.1.2.', o_orderkey % 260, '/p, mail m', o_orderkey % 11, '@ex.org.')"
MIXED_SOURCE = f"(SELECT o_orderkey, {MIXED} AS text FROM orders)"
MIXED_CLAIMS = f"""
SELECT o_orderkey, 'EMAIL' AS type, start_at, CAST(start_at + length(v) AS BIGINT) AS end_at, v AS value, CAST(0.95 AS DOUBLE) AS confidence, 'email' AS detector
FROM (SELECT *, regexp_replace(value, '[.-]+$', '') AS v FROM ({spans_sql(MIXED_SOURCE, "[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:[.][A-Za-z0-9-]{1,63}){1,8}", "o_orderkey")})) WHERE regexp_matches(v, '[.][A-Za-z]{{2,24}}$')
UNION ALL
SELECT o_orderkey, 'URL', start_at, CAST(start_at + length(v) AS BIGINT), v, CAST(0.9 AS DOUBLE), 'url'
FROM (SELECT *, regexp_replace(value, '[.,;:!?)\\]}}>\"'']+$', '') AS v FROM ({spans_sql(MIXED_SOURCE, "https?://[^ ]+", "o_orderkey")}))
UNION ALL
SELECT o_orderkey, 'IP_ADDRESS', start_at, CAST(start_at + length(value) AS BIGINT), value, CAST(0.85 AS DOUBLE), 'ip-address'
FROM ({spans_sql(MIXED_SOURCE, "[0-9.]+", "o_orderkey")}) WHERE regexp_full_match(value, '{OCTET_SQL}(?:[.]{OCTET_SQL}){{3}}')"""
WEB = AnalyzeOptions(("EMAIL", "URL", "IP_ADDRESS"))


@query(f"""SELECT o_orderkey, 'd' || lpad(CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY start_at) - 1 AS VARCHAR), 5, '0') AS id, type, start_at, end_at, value, confidence, detector, true AS sound
FROM {resolved_sql(MIXED_CLAIMS, "o_orderkey")}""")
def engine_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands of web and mail addresses within each other, with ids, and whether it agrees with the text."""
    texts = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(MIXED).alias("text"))
    found = texts.withColumn("found", once(detect(F.col("text"), WEB))).withColumn("sound", well_formed(F.col("text"), F.col("found")))
    d = found.select("o_orderkey", "sound", F.explode("found").alias("d"))
    return d.select("o_orderkey", "d.id", "d.type", F.col("d.start").cast("long").alias("start_at"), F.col("d.end").cast("long").alias("end_at"), "d.value", "d.confidence", "d.detector", "sound")


@query(f"""SELECT c.o_orderkey, c.claims, s.standing FROM (SELECT o_orderkey, count(*) AS claims FROM ({MIXED_CLAIMS}) GROUP BY o_orderkey) c
JOIN (SELECT o_orderkey, count(*) AS standing FROM {resolved_sql(MIXED_CLAIMS, "o_orderkey")} GROUP BY o_orderkey) s ON c.o_orderkey = s.o_orderkey""")
def claims_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims before and after resolution."""
    texts = table(spark, sf_dir, "orders").select("o_orderkey", once(raw_detections(F.expr(MIXED), WEB)).alias("raw"))
    return texts.select("o_orderkey", F.size("raw").cast("long").alias("claims"), F.size(resolve_overlaps(F.col("raw"))).cast("long").alias("standing")).filter("claims > 0")


CHECKED = AnalyzeOptions(("EMAIL", "IP_ADDRESS", "CREDIT_CARD"))
CHECKED_CLAIMS = f"""
SELECT doc_id, 'EMAIL' AS type, start_at, CAST(start_at + length(value) AS BIGINT) AS end_at, value, CAST(0.95 AS DOUBLE) AS confidence, 'email' AS detector FROM ({EMAIL_SQL})
UNION ALL SELECT doc_id, 'IP_ADDRESS', start_at, CAST(start_at + length(value) AS BIGINT), value, CAST(0.85 AS DOUBLE), 'ip-address' FROM ({IPV4_SQL})
UNION ALL SELECT doc_id, 'CREDIT_CARD', start_at, end_at, value, confidence, 'credit-card' FROM ({CARD_SQL})"""
NUMBERED = f"""(SELECT x.*, d.text, '[' || type || '_' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INT), '0') || ']' AS placeholder
  FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id, type ORDER BY first) AS n
        FROM (SELECT *, min(start_at) OVER (PARTITION BY doc_id, type, CASE type WHEN 'CREDIT_CARD' THEN regexp_replace(value, '[^0-9]', '', 'g') ELSE lower(trim(value)) END) AS first FROM {resolved_sql(CHECKED_CLAIMS, "doc_id")})) x
  JOIN documents d ON x.doc_id = d.doc_id)"""
#: The three views of each rewritten text without its placeholders, and the ways in which each value could be in them.
RESIDUE_SQL = f"""
  v AS (SELECT doc_id, lower(m) AS low, regexp_replace(lower(m), '\\s+', ' ', 'g') AS flat, regexp_replace(lower(m), '[\\s.()_/-]', '', 'g') AS bare, regexp_replace(m, '[^0-9]', '', 'g') AS digits
        FROM (SELECT doc_id, regexp_replace(sanitized, '\\[(?:EMAIL|IP_ADDRESS|CREDIT_CARD)_[0-9]{{3,}}\\]', ' ', 'g') AS m FROM red)),
  w AS (SELECT DISTINCT doc_id, placeholder, value, unnest([value, lower(value), regexp_replace(lower(value), '[\\s.()_/-]', '', 'g'), regexp_replace(value, '[^0-9]', '', 'g')]) AS form FROM num),
  l AS (SELECT DISTINCT w.doc_id, placeholder FROM w JOIN v ON w.doc_id = v.doc_id WHERE length(form) >= 4 AND (form <> regexp_replace(value, '[^0-9]', '', 'g') OR length(form) >= 6)
        AND CASE WHEN regexp_full_match(form, '[0-9]{{6,}}') THEN contains(digits, form)
                 WHEN regexp_matches(value, '[0-9]') THEN contains(low, form) OR contains(flat, form) OR contains(bare, form)
                 ELSE regexp_matches(low, '(?:^|[^\\p{{L}}\\p{{M}}])' || regexp_escape(lower(form)) || '(?:$|[^\\p{{L}}\\p{{M}}])') END)"""
CHECKED_SQL = f"""
WITH num AS {NUMBERED}, red AS ({redact_sql("num")}), {RESIDUE_SQL},
  res AS (SELECT doc_id, count(*) AS left_over FROM l GROUP BY doc_id),
  cnt AS (SELECT doc_id, count(DISTINCT placeholder) AS groups, count(*) AS places FROM num GROUP BY doc_id),
  done AS (SELECT red.doc_id, sanitized, CASE WHEN res.doc_id IS NULL THEN 'pass' ELSE 'fail' END AS status, coalesce(left_over, 0) AS residual, coalesce(groups, 0) AS replaced_groups, coalesce(places, 0) AS replaced_occurrences
           FROM red LEFT JOIN res ON red.doc_id = res.doc_id LEFT JOIN cnt ON red.doc_id = cnt.doc_id)"""


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitize(analyze(table(spark, sf_dir, "documents").select("doc_id", "text"), CHECKED))


@query(f"{CHECKED_SQL} SELECT * FROM done")
def sanitize_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rewritten for three types, and what verification says of each."""
    residual = F.size(F.get(F.filter("checks", lambda c: c["id"] == "residual-values"), F.lit(0))["offending"])
    return checked(spark, sf_dir).select("doc_id", "sanitized", "status", residual.cast("long").alias("residual"), F.col("replaced_groups").cast("long"), F.col("replaced_occurrences").cast("long"))


@query(f"{CHECKED_SQL} SELECT status, count(*) AS documents, CAST(sum(replaced_occurrences) AS BIGINT) AS replaced FROM done GROUP BY status")
def checked_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).groupBy("status").agg(F.count("*").alias("documents"), F.sum("replaced_occurrences").alias("replaced"))


GATED = "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE text END"


@query(f"""
WITH num AS (SELECT * FROM {EMAIL_NUMBERED} WHERE doc_id % 11 <> 0), hit AS (SELECT doc_id, count(DISTINCT placeholder) AS n FROM num GROUP BY doc_id)
SELECT d.doc_id, d.doc_id % 11 <> 0 AND d.doc_id % 7 <> 0 AS released,
  CASE WHEN d.doc_id % 11 = 0 THEN 'MALFORMED_DOCUMENT' WHEN d.doc_id % 7 = 0 THEN 'VERIFICATION_FAILED' END AS error_code,
  CASE WHEN d.doc_id % 11 = 0 OR d.doc_id % 7 = 0 THEN 422 END AS http_status,
  CASE WHEN d.doc_id % 11 <> 0 THEN CASE WHEN d.doc_id % 7 = 0 THEN 'inconclusive' ELSE 'pass' END END AS status,
  CASE WHEN d.doc_id % 11 <> 0 THEN CASE WHEN d.doc_id % 7 = 0 AND hit.n > 0 THEN 'EMAIL' ELSE '' END END AS unverified
FROM documents d LEFT JOIN hit ON d.doc_id = hit.doc_id""")
def gate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of the gate, where some documents have no text and some have parts that were not read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(GATED).alias("text"), F.expr("CASE WHEN doc_id % 7 = 0 THEN array('page 1') END").alias("unread"))
    parts = gate(sanitize(analyze(docs, EMAIL_ONLY), unreadable="unread"))
    kept = ("doc_id", "status", F.array_join("unverified_types", "|").alias("unverified"))
    out = parts.released.select(*kept, F.lit(True).alias("released"), F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("int").alias("http_status"))
    return out.unionByName(parts.quarantined.select(*kept, F.lit(False).alias("released"), "error_code", "http_status"))


@query(f"""
WITH num AS {EMAIL_NUMBERED}, red AS ({redact_sql("num")}),
  cut AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(sanitized, '[EMAIL_001]', '') ELSE replace(sanitized, '[EMAIL_002]', '') END AS text FROM red)
SELECT num.doc_id, coalesce(string_agg(DISTINCT placeholder, '|' ORDER BY placeholder) FILTER (WHERE NOT contains(cut.text, placeholder)), '') AS missing FROM num JOIN cut ON num.doc_id = cut.doc_id GROUP BY num.doc_id""")
def placeholders_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders that verification misses, where one was taken out of each rewritten text."""
    own = sanitize(analyze(table(spark, sf_dir, "documents").select("doc_id", "text"), EMAIL_ONLY)).filter(F.size("detections") > 0)
    gone = F.when(F.col("doc_id") % 2 == 0, "[EMAIL_001]").otherwise("[EMAIL_002]")
    cut = own.withColumn("cut", F.replace("sanitized", gone, F.lit("")))
    return cut.select("doc_id", F.array_join(verify.missing(F.col("cut"), F.col("detections")), "|").alias("missing"))


@query(f"""
WITH num AS {EMAIL_NUMBERED}, o AS (SELECT doc_id, unnest([0, length(text) // 3, length(text) // 2, length(text)]) AS place FROM documents)
SELECT o.doc_id, CAST(place AS BIGINT) AS place, CAST(place + coalesce(sum(CASE WHEN start_at + length(value) <= place THEN length(placeholder) - length(value) WHEN start_at < place AND place < start_at + length(value) THEN start_at - place END), 0) AS BIGINT) AS moved
FROM (SELECT DISTINCT doc_id, place FROM o) o LEFT JOIN num ON o.doc_id = num.doc_id GROUP BY o.doc_id, place""")
def moved_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where places of the documents are in the rewritten ones."""
    own = analyze(table(spark, sf_dir, "documents").select("doc_id", "text"), EMAIL_ONLY)
    size = F.length("text")
    places = F.array_distinct(F.array(F.lit(0), F.floor(size / 3).cast("int"), F.floor(size / 2).cast("int"), size))
    each = own.select("doc_id", "detections", F.explode(places).alias("place"))
    return each.select("doc_id", F.col("place").cast("long"), assembly.sanitized_offset(F.col("place"), F.col("detections")).cast("long").alias("moved"))


KINDS = "element_at(array('EMAIL', 'PHONE', 'CREDIT_CARD', 'SSN', 'PERSON', 'IP_ADDRESS', 'CUSTOM', 'DATE_OF_BIRTH'), CAST(o_orderkey % 8 AS INT) + 1)"
VALUES = "element_at(array(concat(' Ann', o_orderkey, '@Ex.ORG '), concat('+1 (415) 555-', o_orderkey), concat('4111-1111 ', o_orderkey), concat('12', o_orderkey, '-45-6789'), concat('Ada  VON\\nStone', o_orderkey), concat('10.0.', o_orderkey, '.ab'), concat('Word ', o_orderkey), concat('3 / 4 / ', o_orderkey)), CAST(o_orderkey % 8 AS INT) + 1)"
SQL_VALUES = VALUES.replace("\\n", "' || chr(10) || '").replace("element_at(array(", "list_extract([").replace(")), CAST(o_orderkey", ")], CAST(o_orderkey")
SQL_KINDS = KINDS.replace("element_at(array(", "list_extract([").replace("'), CAST", "'], CAST")
DOTS, DIGITS = "'••••'", "regexp_replace(value, '[^0-9]', '', 'g')"
MASKED = "CASE WHEN length(x) <= 1 THEN x ELSE x[1:1] || repeat('•', CAST(least(length(x) - 1, 4) AS BIGINT)) END"


def masked_sql(words: str, joiner: str = " ") -> str:
    return f"array_to_string(list_transform({words}, lambda x: {MASKED}), '{joiner}')"


@query(f"""SELECT o_orderkey, type,
  CASE WHEN type IN ('CREDIT_CARD', 'SSN') THEN {DIGITS} WHEN type = 'PHONE' THEN '+' || {DIGITS} WHEN type IN ('EMAIL', 'IP_ADDRESS') THEN lower(trim(value))
    WHEN type = 'PERSON' THEN regexp_replace(lower(value), '\\s+', ' ', 'g') WHEN type = 'DATE_OF_BIRTH' THEN regexp_replace(value, '\\s+', '', 'g') ELSE 'CUSTOM:' || value END AS key,
  CASE type WHEN 'EMAIL' THEN {masked_sql("[split_part(value, '@', 1)]")} || '@' || {masked_sql("[split_part(split_part(value, '@', 2), '.', 1)]")} || '.' || split_part(value, '.', 2)
    WHEN 'PERSON' THEN {masked_sql("string_split_regex(value, '\\s+')")}
    WHEN 'CREDIT_CARD' THEN 'Card ' || {DOTS} || ' ' || {DIGITS}[-4:]
    WHEN 'IP_ADDRESS' THEN split_part(value, '.', 1) || '.' || split_part(value, '.', 2) || '.•••.•••'
    WHEN 'PHONE' THEN '••• ••• ••' || {DIGITS}[-2:] ELSE {DOTS} || ' ' || {DOTS} END AS preview
FROM (SELECT o_orderkey, {SQL_KINDS} AS type, {SQL_VALUES} AS value FROM orders)""")
def canonical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What makes two values of a type one, and what may be shown of them."""
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(KINDS).alias("type"), F.expr(VALUES).alias("value"))
    none = F.lit(None).cast("map<string,string>")
    key = anonymize.canonical(F.col("type"), F.col("value"), none)
    return own.select("o_orderkey", "type", key.alias("key"), preview(F.col("type"), F.col("value"), none).alias("preview"))


ODD_TEXT = "concat(text, chr(13), chr(10), doc_id, chr(9), chr(233), chr(13), chr(7), chr(8203), 'z')"


@query(f"""SELECT doc_id, regexp_replace(p, '[^\\n -~]', '?', 'g') AS said, CAST(length(regexp_replace(p, '[\\n -~]', '', 'g')) AS BIGINT) AS substituted FROM (
  SELECT doc_id, regexp_replace(replace(regexp_replace({ODD_TEXT}, '\\r\\n?', chr(10), 'g'), chr(9), '    '), '[\\x00-\\x09\\x0b-\\x1f\\x7f-\\x{{9f}}\\p{{Cf}}]', '', 'g') AS p FROM documents)""")
def encodable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as a font of printable ASCII can set them."""
    odd = ODD_TEXT.replace("chr(8203)", "decode(unhex('E2808B'), 'UTF-8')")
    own = table(spark, sf_dir, "documents").select("doc_id", encodable(F.expr(odd), " -~").alias("e"))
    return own.select("doc_id", F.col("e.text").alias("said"), F.col("e.substituted").cast("long").alias("substituted"))


@query("""SELECT p_partkey, regexp_replace(name, '(?:''|’)s$', '') AS bare, CASE WHEN tag = '' THEN 'REDACTED' WHEN regexp_matches(tag, '^[A-Z]') THEN tag[1:32] ELSE ('TAG_' || tag)[1:32] END AS tag FROM (
  SELECT p_partkey, name, trim(regexp_replace(upper(trim(raw)), '[^A-Z0-9]+', '_', 'g'), '_') AS tag FROM (
    SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN '''s' WHEN 1 THEN '’s' ELSE 's' END AS name, CASE p_partkey % 5 WHEN 0 THEN ' --' WHEN 1 THEN p_partkey || ' ' || p_name ELSE ' ' || p_name || '!' || p_type END AS raw FROM part))""")
def tags_and_possessives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without their possessive, and words as placeholder labels."""
    name = "concat(p_name, CASE p_partkey % 3 WHEN 0 THEN '\\'s' WHEN 1 THEN '’s' ELSE 's' END)"
    raw = "CASE p_partkey % 5 WHEN 0 THEN ' --' WHEN 1 THEN concat(p_partkey, ' ', p_name) ELSE concat(' ', p_name, '!', p_type) END"
    own = table(spark, sf_dir, "part").select("p_partkey", names.without_possessive(F.expr(name)).alias("bare"), F.expr(raw).alias("raw"))
    return with_columns(own, lambda r: (redaction_tag(r),), ("raw",), tag=T.StringType()).drop("raw")


PATTERNS = "concat('x', element_at(array('(ab', '(?:a+', '(a|b', '([a-z]', '(?<n>a', '\\\\q('), CAST(p_partkey % 6 AS INT) + 1), ')', element_at(array('', '+', '{2}', ' *'), CAST(p_partkey % 4 AS INT) + 1), repeat('y', CAST(p_partkey % 13 * 16 AS INT)))"


@query(r"""SELECT p_partkey, i NOT IN (5, 6) AND NOT (i IN (2, 3) AND q <> 1) AND n <= 200 AS accepted FROM (
  SELECT p_partkey, p_partkey % 6 + 1 AS i, p_partkey % 4 + 1 AS q, 2 + list_extract([3, 5, 4, 6, 6, 3], CAST(p_partkey % 6 AS INT) + 1) + list_extract([0, 1, 3, 2], CAST(p_partkey % 4 AS INT) + 1) + p_partkey % 13 * 16 AS n FROM part)""")
def pattern_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User patterns that are accepted: short, without runaway groups, lookbehind or unknown escapes."""

    def accepted(pattern: str) -> tuple[bool]:
        try:
            check_pattern(pattern)
        except InvalidInput:
            return (False,)
        return (True,)

    own = table(spark, sf_dir, "part").select("p_partkey", F.expr(PATTERNS).alias("pattern"))
    return with_columns(own, accepted, ("pattern",), accepted=T.BooleanType()).drop("pattern")


BROKEN = "CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN concat(props, 'x') WHEN 2 THEN substr(props, 1, length(props) - 1) WHEN 3 THEN concat('[', props, ', 1e5, null]') ELSE concat(' {\"a\": 0', event_id % 3, '}') END"


@query(f"SELECT event_id, json_valid(t) AS valid, json_valid(t) AND regexp_matches(t, '^\\s*[\\[{{]') AS looks FROM (SELECT event_id, {BROKEN} AS t FROM events)")
def json_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole and broken JSON texts."""
    own = table(spark, sf_dir, "events").select("event_id", F.expr(BROKEN).alias("t"))
    return own.select("event_id", formats.json_valid(F.col("t")).alias("valid"), formats.looks_like_json(F.col("t")).alias("looks"))


@query("""SELECT s_suppkey, CAST(e AS INT) AS entries, CASE WHEN bad THEN 'SUSPICIOUS_DOCUMENT' END AS zip_error, NOT bad AS safe FROM (
  SELECT s_suppkey, CASE s_suppkey % 6 WHEN 5 THEN 513 ELSE 2 END AS e, s_suppkey % 6 IN (1, 2, 3, 4, 5) AS bad FROM supplier)""")
def zip_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers with names that lead out of them, too many entries, or far too much when inflated."""

    def made(key: int) -> tuple[bytes]:
        kind = key % 6
        name = ("word/a.xml", "../a.xml", "/a.xml", "C:a.xml", "word/zeros", "word/b.xml")[kind]
        parts = {"word/document.xml": b"<w:document/>", name: b"\0" * 200_000 if kind == 4 else f"part {key}".encode()}
        return (docx.write_zip(parts | ({f"word/{i}": b"" for i in range(511)} if kind == 5 else {})),)

    keys = with_columns(table(spark, sf_dir, "supplier").select("s_suppkey"), made, ("s_suppkey",), content=T.BinaryType())
    return docx.inspected(keys).select("s_suppkey", "entries", "zip_error", "safe")


@query("""SELECT s_suppkey, 'Q&A ' || s_suppkey || ' <b> ' || chr(CAST(65 + s_suppkey % 26 AS INT)) || ' é' || chr(10) || 'two' || chr(10) || chr(31) || chr(10) || 'by "S' || s_suppkey || '"' || chr(10) || s_name AS text, 'body|metadata' AS regions FROM supplier""")
def docx_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and properties of Word documents, with character references of every kind."""

    def made(key: int, name: str) -> tuple[bytes]:
        body = f"<w:p><w:r><w:t>Q&amp;A {key} &lt;b&gt; &#{65 + key % 26}; &#xE9;</w:t></w:r></w:p><w:p><w:r><w:t xml:space=\"preserve\">two</w:t></w:r></w:p>"
        core = f"<cp:coreProperties><dc:creator>by &quot;S{key}&quot;</dc:creator><dcterms:created>2020</dcterms:created><dc:title>{name}</dc:title></cp:coreProperties>"
        return (docx.write_zip({"docProps/core.xml": core.encode(), "word/document.xml": f"<w:document><w:body>{body}</w:body></w:document>".encode()}),)

    keys = with_columns(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), made, ("s_suppkey", "s_name"), content=T.BinaryType())
    return docx.extracted(keys).select("s_suppkey", "text", F.array_join("regions", "|").alias("regions"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 OR o_orderkey % 1400 > 1024 THEN 'MALFORMED_DOCUMENT' WHEN o_orderkey % 1400 > 0 THEN 'SUSPICIOUS_DOCUMENT' END AS error_code FROM orders""")
def pdf_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose PDF header stands at the start, later, or out of reach, or that have none."""
    content = F.expr("CAST(concat(repeat('x', CAST(o_orderkey % 1400 AS INT)), CASE o_orderkey % 5 WHEN 4 THEN '%PDX-' ELSE '%PDF-' END, '1.7 ', o_orderkey) AS BINARY)")
    own = table(spark, sf_dir, "orders").select("o_orderkey", content.alias("content"))
    return own.select("o_orderkey", formats.pdf_plausible(F.col("content")).alias("error_code"))


@query("""SELECT r_regionkey, CASE r_regionkey % 3 WHEN 0 THEN 'Dates of birth: no detector is implemented yet, so nothing in this category was found or replaced.'
  WHEN 1 THEN 'Some categories can miss matches — please review the list carefully.' ELSE '' END AS warnings FROM region""")
def analysis_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an analysis warns of, by the types that are on."""
    own = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("text"))
    some = [analyze(own.filter(f"r_regionkey % 3 = {i}"), AnalyzeOptions(types)) for i, types in enumerate((("EMAIL", "DATE_OF_BIRTH"), ("ADDRESS", "URL"), ("EMAIL", "SSN")))]
    first, second, third = (s.select("r_regionkey", F.array_join("warnings", "|").alias("warnings")) for s in some)
    return first.unionByName(second).unionByName(third)
