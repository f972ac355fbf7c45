"""Job-market views over the test tables, in SQL that Spark and DuckDB both accept.

The tables hold orders and parts, so their words are translated to job vocabulary by CASE
lookups: every row of the source table stays, nothing is sampled, and the work grows with the
tables.  Queries read these views; the operators know nothing about them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _case(expr: str, pairs: dict, default: str = "NULL") -> str:
    def lit(v):
        return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in pairs.items())
    return f"(CASE {expr} {whens} ELSE {default} END)"


_ADJECTIVES = {
    "small": "Computer", "hot": "Basic", "red": "Motor Vehicle", "blue": "Garment",
    "large": "System", "old": "Fashion", "cold": "Java", "new": "Data Entry"}
_NOUNS = {
    "widget": "Operator", "plate": "Technician", "gear": "Mechanic", "bolt": "Cosmetology",
    "ring": "Maker", "rod": "Painter", "gizmo": "Programming Assistant", "anvil": "Developer"}
_ADJECTIVE = _case("split_part(p_name, ' ', 1)", _ADJECTIVES, "''")
_NOUN = _case("split_part(p_name, ' ', 2)", _NOUNS, "''")
_SUFFIX = _case("p_type", {"ECONOMY": " - Pune", "MEDIUM": " (Senior)", "PROMO": " Trainee",
                           "SMALL": "  II"}, "''")
TITLE = f"({_ADJECTIVE} || ' ' || {_NOUN} || {_SUFFIX})"

_TEXT = _case("p_type", {
    "STANDARD": "We need Core Java and SQL, with MySQL as the main store for the team",
    "ECONOMY": "MS Office and Excel  skills; data entry all day long in a busy Pune office",
    "MEDIUM": "ASP.NET, C# and HTML5/CSS3 for a web portal, JavaScript a plus",
    "PROMO": "Spray Painting and surface coating of car bodies in a large plant near the city",
    "SMALL": "Linux network support, cloud hosting, and some Perl or Kotlin scripting",
    "LARGE": "Java EE / J2EE services on Oracle; Hadoop, spark and kafka pipelines"})
DESCRIPTION = (
    f"(CASE WHEN p_type = 'PROMO' AND p_size < 10 THEN NULL WHEN p_size > 40 THEN {_TEXT} || "
    f"' with Android and AWS' ELSE {_TEXT} END)"
)
SOURCE_SKILLS = _case("right(p_brand, 1)", {
    "1": "Java, SQL / Oracle", "2": "MS Office; Data Entry",
    "3": "IT Software - Application Programming", "4": "Sales, Marketing | Teaching", "5": "",
    "7": "excel sheet, customer care, Java", "8": " java ,JAVA, Core  Java",
    "9": "ITES, Computer Networking/networking", "0": "HTML|CSS|jQuery|Ajax"})
LOCATION = _case("c_nationkey", {
    0: "Pune", 1: "Pune, Maharashtra", 2: "Pune / Mumbai",
    3: "Bengaluru/Bangalore , Mumbai , Chennai , Pune", 4: "PUNE Mumbai, Chennai Kolkata",
    5: "Pimpri-Chinchwad", 6: "Andheri, Maharashtra", 7: "Maharashtra", 8: "Atlantis", 9: "",
    10: None, 11: "Chhatrapati Sambhajinagar", 12: "Pune and Nashik", 13: "Navi Mumbai",
    14: "Nashik Road", 15: "Hinjewadi, Pune", 16: "Delhi/NCR(National Capital Region)",
    17: "mh, thane", 18: "Mumbai City", 19: "Kolhapur", 20: "Hyderabad / Secunderabad",
    21: "Campbell town", 22: "Nagpur; Wardha", 23: "  nagpur  ", 24: "Punekar nagar"})


def _district(key: str, fallback: str) -> str:
    return _case(key, {0: "Pune", 1: "pune ", 2: "Mumbai City", 3: "Thane", 4: "Nashik",
                       5: "Nagpur", 6: "", 7: None, 8: "  "}, fallback)


_SECTOR = _case("c_mktsegment", {
    "HOUSEHOLD": "Personal Care & Services", "FURNITURE": "IT-Software / Software Services",
    "MACHINERY": "BPO / Call Centre / ITES", "BUILDING": "", "AUTOMOBILE": "Automotive"})
_DAY = "day_text"
_POSTDATE = (
    f"(CASE l_linenumber WHEN 1 THEN {_DAY} || ' 19:30:00 +0000' WHEN 2 THEN {_DAY} || "
    f"' 00:10:00 +0530' WHEN 3 THEN {_DAY} WHEN 4 THEN '' WHEN 5 THEN 'not a date' WHEN 6 THEN "
    f"{_DAY} || ' 10:00:00' ELSE replace({_DAY}, '-', '/') END)"
)
_ROW_KEY = (
    "(CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || "
    "CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || "
    "CAST(CAST(l_shipdate AS DATE) AS STRING))"
)
# dimension texts are built on the dimension's side of the join, once per part or customer
_FROM = f"""
FROM lineitem JOIN (SELECT p_partkey, p_size, p_type, {TITLE} AS title,
    {DESCRIPTION} AS description, {SOURCE_SKILLS} AS source_skills FROM part) p
  ON l_partkey = p_partkey
JOIN (SELECT o_orderkey, o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS order_day,
    CAST(CAST(o_orderdate AS DATE) AS STRING) AS day_text FROM orders) o
  ON l_orderkey = o_orderkey
JOIN (SELECT c_custkey, c_nationkey, c_name, {LOCATION} AS location_text, {_SECTOR} AS sector
    FROM customer) c ON o_custkey = c_custkey"""

_POSITIONS = """(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS STRING) WHEN l_returnflag = 'N' THEN ''
    WHEN l_quantity < 2 THEN 'several' WHEN l_quantity < 3 THEN '-2' ELSE '4' END)"""

VIEWS = {
    # untrusted rows as a scraper would deliver them
    "raw_rows": f"""
SELECT {_ROW_KEY} AS row_key,
  (CASE WHEN p_size = 1 THEN '  ' ELSE title END) AS jobtitle,
  (CASE WHEN c_nationkey = 3 THEN '  ' ELSE c_name END) AS company,
  location_text AS joblocation_address,
  sector AS industry,
  description AS jobdescription,
  {_POSTDATE} AS postdate,
  (CASE WHEN p_size < 10 THEN '' ELSE CAST(l_orderkey AS STRING) || '-' ||
    CAST(l_linenumber AS STRING) END) AS jobid,
  (CASE WHEN p_size < 5 THEN NULL ELSE 'u-' || CAST(l_orderkey AS STRING) END) AS uniq_id,
  {_POSITIONS}
    AS numberofpositions,
  source_skills AS skills,
  o_orderpriority AS priority
{_FROM}""",
    # typed facts as the analyses read them
    "postings": f"""
SELECT {_ROW_KEY} AS posting_id, o_orderpriority AS source_id,
  CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS source_record_id,
  title AS job_title, c_name AS employer_name, location_text,
  {_district("c_nationkey", "n_name")} AS district, sector,
  description, order_day AS posted_date,
  l_shipdate AS retrieved_at, source_skills,
  (CASE l_linestatus WHEN 'O' THEN 'ACTIVE' ELSE 'EXPIRED' END) AS status
{_FROM} JOIN nation ON c_nationkey = n_nationkey""",
    "apprenticeships": f"""
SELECT CAST(event_id AS STRING) AS posting_id, '1-URGENT' AS source_id,
  {_case("event_type", {"click": "Basic Cosmetology", "view": "Computer Operator",
                        "purchase": "Machinist", "signup": "Painter General",
                        "error": "Unlisted Trade"})} AS trade_title,
  {_district("user_id % 25", "n_name")} AS district,
  (CASE WHEN value < 1 THEN '' ELSE 'IT-ITeS' END) AS sector, ts AS retrieved_at
FROM events JOIN nation ON user_id % 25 = n_nationkey""",
    # long free text
    "texts": """
SELECT CAST(doc_id AS STRING) AS posting_id, doc_id AS ordinal, source AS source_id,
  lang AS sector, text AS description FROM documents""",
    # events as sightings of a skill
    "sightings": """
SELECT CAST(user_id AS STRING) || '-' || CAST(event_id AS STRING) AS posting_id,
  'events' AS source_id, event_type AS source_skills, ts AS retrieved_at, 'any' AS district,
  'any' AS sector
FROM events""",
    "sources": """
SELECT s_name AS source_id, 'Source ' || CAST(s_suppkey AS STRING) AS source_name,
  'Organization ' || CAST(s_nationkey AS STRING) AS organization,
  'https://example.org/' || CAST(s_suppkey AS STRING) AS url,
  (CASE WHEN s_nationkey < 12 THEN 'demand' ELSE 'supply' END) AS category,
  (CASE WHEN s_nationkey < 5 THEN 'VERIFIED_API' WHEN s_nationkey < 10 THEN 'REST_API'
    WHEN s_nationkey < 15 THEN 'SOURCE_SNAPSHOT' WHEN s_nationkey < 20 THEN 'MANUAL_CURATION'
    ELSE 'PUBLIC_PAGE' END) AS access_method,
  (CASE WHEN s_nationkey < 12 THEN 'PERIODIC' ELSE 'STATIC' END) AS freshness_class,
  (CASE WHEN s_nationkey < 6 THEN NULL ELSE 'PRIMARY_LIVE' END) AS source_type,
  s_nationkey < 8 AS official_government_source,
  (CASE WHEN s_acctbal > 7000 THEN 'VERIFIED' WHEN s_acctbal > 4000 THEN 'permitted'
    WHEN s_acctbal > 2000 THEN 'UNVERIFIED' ELSE NULL END) AS verification_status,
  (CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal > 1000 END) AS enabled,
  (CASE WHEN s_acctbal > 1500 THEN TIMESTAMP '2024-01-15 10:00:00' ELSE NULL END)
    AS last_fetched_at,
  (CASE WHEN s_nationkey = 4 THEN 'Last FAIL: 2024-01-15, status=OFFLINE'
    WHEN s_nationkey < 20 THEN 'Last OK: 2024-01-15' ELSE NULL END) AS reliability_notes
FROM supplier""",
    # institutes and the trades they teach
    "institute_trades": f"""
SELECT s_name AS institute_code,
  {_case("s_nationkey", {0: "Basic Cosmetology", 1: "Computer Operator and Programming Assistant",
                         2: "Fashion Design & Technology", 3: "Machinist",
                         4: "Mechanic (Motor Vehicle)"}, "'Painter General'")} AS trade,
  (CASE WHEN s_nationkey = 7 THEN 'n/a'
    ELSE CAST(CAST(FLOOR(s_acctbal) AS BIGINT) AS STRING) END) AS intake
FROM supplier""",
    # reference occupations: the distinct titles and groups of the parts
    "reference_occupations": f"""
SELECT CAST(ROW_NUMBER() OVER (ORDER BY occupation_title, group_name, code) AS BIGINT) AS entry_order,
  '7' || code AS nco_code, occupation_title, 'Division ' || code AS division, group_name,
  'Reference table' AS source_reference, is_authoritative
FROM (SELECT {_ADJECTIVE} || ' ' || {_NOUN} AS occupation_title,
    {_case("p_type", {"STANDARD": "Software Services", "ECONOMY": "", "MEDIUM": "Personal Care",
                      "PROMO": "Call Centre work"}, "'Automotive trades'")} AS group_name,
    right(p_brand, 1) AS code, right(p_brand, 1) < '5' AS is_authoritative
  FROM part GROUP BY 1, 2, 3, 4) d""",
    "titles": f"""
SELECT title, sector AS skills,
  {_case("p_type", {"STANDARD": "OCC-COMP-01", "PROMO": "OCC-AUTO-01", "SMALL": "OCC-NONE"})}
    AS canonical_occupation_id
{_FROM} GROUP BY 1, 2, 3""",
    "location_texts": """
SELECT (CASE WHEN c_nationkey < 12 THEN n_name || ', ' || r_name ELSE """ + LOCATION + """ END)
  AS location_text, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey""",
    # strings for the parsers, one per line item
    "parser_inputs": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  (CASE l_linenumber WHEN 1 THEN '₹' || CAST(l_partkey AS STRING) || ',000 - ₹' ||
    CAST(l_partkey + l_suppkey AS STRING) || ',000 PA' WHEN 2 THEN 'Rs. ' ||
    CAST(l_partkey AS STRING) || '.50 per annum' WHEN 3 THEN 'Not disclosed' WHEN 4 THEN ''
    WHEN 5 THEN NULL WHEN 6 THEN CAST(l_suppkey AS STRING) || ' to ' || CAST(l_partkey AS STRING)
    || ' or 7' ELSE '₹12345678' ||
    CAST(l_partkey AS STRING) || '901.125 - ₹20000000000 PA' END) AS salary,
  (CASE l_linenumber WHEN 1 THEN CAST(l_suppkey AS STRING) || '-' || CAST(l_suppkey + 2 AS STRING)
    || ' years' WHEN 2 THEN CAST(l_suppkey AS STRING) || '+ Years' WHEN 3 THEN 'Freshers'
    WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN CAST(l_suppkey AS STRING) || ' yrs' ELSE
    CAST(l_suppkey AS STRING) || ' – 99999999999' || CAST(l_partkey AS STRING) || ' yr' END) AS experience,
  (CASE l_linenumber WHEN 1 THEN CAST(CAST(l_shipdate AS DATE) AS STRING) WHEN 2 THEN
    replace(CAST(CAST(l_shipdate AS DATE) AS STRING), '-', '/') WHEN 3 THEN '31/01/2016'
    WHEN 4 THEN '31-02-2016' WHEN 5 THEN NULL WHEN 6 THEN '5-6-2001' ELSE 'soon' END) AS day_text,
  (CASE l_linenumber WHEN 1 THEN CAST(CAST(l_shipdate AS DATE) AS STRING) || ' 23:30:00 -0800'
    WHEN 2 THEN CAST(CAST(l_shipdate AS DATE) AS STRING) || ' 24:30:00' WHEN 3 THEN ' ' WHEN 4
    THEN '2016-02-30' WHEN 5 THEN NULL WHEN 6 THEN CAST(CAST(l_shipdate AS DATE) AS STRING)
    ELSE '21/05/2016' END) AS postdate,
  (CASE l_linenumber WHEN 1 THEN CAST(l_quantity AS STRING) WHEN 2 THEN '-' ||
    CAST(l_quantity AS STRING) WHEN 3 THEN 'nan' WHEN 4 THEN ' 7 ' WHEN 5 THEN NULL WHEN 6 THEN
    '1e2' ELSE '2.9' END) AS seats
FROM lineitem""",
}

# The same join as Spark runs it.  Postings go through two exchanges, by part and by order, and carry
# no text there: what the texts of a part depend on is one number, put into words after the last
# join.  Orders get their customers on their own side, which is a quarter of the rows.
_TYPES = ("STANDARD", "ECONOMY", "MEDIUM", "PROMO", "SMALL", "LARGE")


def _coded(expr: str, words) -> str:
    return _case(expr, {word: k for k, word in enumerate(words, 1)}, "0")


def _word(code: str, words, default: str = "NULL") -> str:
    return _case(code, dict(enumerate(words, 1)), default)


_PART_CODE = f"""(CASE WHEN p_size IS NULL THEN 32768 ELSE shiftleft(CAST(p_size AS BIGINT), 16) END
  + {_coded("split_part(p_name, ' ', 1)", _ADJECTIVES)}
  + 16 * {_coded("split_part(p_name, ' ', 2)", _NOUNS)}
  + 256 * {_coded("p_type", _TYPES)} + 2048 * {_coded("right(p_brand, 1)", "0123456789")})"""
_NARROW_FROM = f"""
FROM (SELECT l.*, o.*, {TITLE} AS title, {DESCRIPTION} AS description,
    {SOURCE_SKILLS} AS source_skills, {LOCATION} AS location_text, {_SECTOR} AS sector,
    CAST(order_day AS STRING) AS day_text
  FROM (SELECT *, (CASE WHEN (part_code & 32768) = 0 THEN CAST(shiftright(part_code, 16) AS INT) END)
      AS p_size, {_word("part_code & 15", _ADJECTIVES, "''")} || ' ' ||
      {_word("shiftright(part_code, 4) & 15", _NOUNS, "''")} AS p_name,
      {_word("shiftright(part_code, 8) & 7", _TYPES)} AS p_type,
      {_word("shiftright(part_code, 11) & 15", "0123456789")} AS p_brand
    FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_linestatus, l_shipdate,
        CAST(l_shipdate AS DATE) AS ship_day, {_POSITIONS} AS positions FROM lineitem) n
    JOIN (SELECT p_partkey, {_PART_CODE} AS part_code FROM part) p ON l_partkey = p_partkey) l
  JOIN (SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS order_day, c_nationkey,
      c_name, c_mktsegment
    FROM orders JOIN customer ON o_custkey = c_custkey) o ON l_orderkey = o_orderkey) j"""
SPARK_VIEWS = {
    name: text.replace(_ROW_KEY, _ROW_KEY.replace("CAST(l_shipdate AS DATE)", "ship_day"))
    .replace(_POSITIONS, "positions").replace(_FROM, _NARROW_FROM) if _FROM in text else text
    for name, text in VIEWS.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; its tables are bound by name, nothing is registered."""
    import re

    text = SPARK_VIEWS[name]
    used = [t for t in TABLES if re.search(rf"(?:FROM|JOIN)\s+{t}\b", text)]
    bound = reduce(
        lambda sql, t: re.sub(rf"((?:FROM|JOIN)\s+){t}\b", rf"\1{{{t}}}", sql), used, text
    )
    return spark.sql(bound, **{t: table(spark, sf_dir, t) for t in used})


def with_views(sql: str, *names: str) -> str:
    """Prefix a SQL text with the views it reads, as common table expressions."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {ctes}{', ' if sql.lstrip().startswith(',') else ' '}{sql.lstrip().lstrip(',')}"
