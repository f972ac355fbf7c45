"""The same questions in DuckDB SQL, answered the plain way.

Each text reads the raw tables through the shared views and computes its answer by brute force:
products instead of indexes, windows and DISTINCT instead of row-local counting, and ordinary
string functions.  Every column name equals the Spark query's.
"""

from __future__ import annotations

import json

from ..functions.scoring import GAP_ORDER
from ..operators import gap as gap_rules
from ..operators.skills import SkillDictionary
from ..sources import gazetteer, seeds, sinks
from .queries import DECISIONS, DOC_SKILLS, EVENT_SKILLS, WINDOW
from .views import VIEWS

ORACLES: dict[str, str] = {}


def q(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, (tuple, list)):
        return "[" + ", ".join(q(v) for v in value) + "]::VARCHAR[]"
    return "'" + value.replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(q(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def view_cte(*names: str) -> list[str]:
    return [f"{n} AS ({VIEWS[n]})" for n in names]


def text(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def collapse(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '\\s+', ' ', 'g'))"


def blank(x: str) -> str:
    return f"(coalesce(trim({x}), '') = '')"


def ratio(a: str, b: str, digits: int) -> str:
    return f"CAST(round_even(CAST({a} AS DOUBLE) / nullif({b}, 0), {digits}) AS DOUBLE)"


# --- evidence ----------------------------------------------------------------------------

def evidence(dictionary: SkillDictionary, where: str = "TRUE", fields=("seg", "title", "desc"),
             source: str = "postings") -> list[str]:
    """CTEs ending in ``evidence`` (one row per posting, skill, field) and ``scoped``."""
    phrases = [(p, s.skill_id, s.skill_name, int(c)) for p, (s, c) in dictionary.text.items()]
    segments = [(p, s.skill_id, s.skill_name, m, c)
                for p, (s, m, c) in dictionary.segment.items()]
    low = "lower(t)"
    edge = "regexp_escape(phrase)"
    before = f"'^(.*?)(^|\\W)' || {edge} || '(\\W|$)'"
    columns = "posting_id, district, sector, source_id, retrieved_at"
    parts = []
    if "seg" in fields:
        parts.append(f"""
SELECT {columns}, 1 AS field_rank, 'SOURCE_SKILL' AS evidence_type, raw AS source_skill_text,
  skill_id, skill_name, method, confidence, raw AS evidence_text FROM (
  SELECT s.*, m.skill_id, m.skill_name, m.method, m.confidence, row_number() OVER
    (PARTITION BY posting_id, m.skill_id ORDER BY i) AS n
  FROM segs s JOIN segment_phrases m ON m.phrase = s.norm) WHERE n = 1""")
    for key, column, kind, prefix, rank in (
        ("title", "job_title", "JOB_TITLE", "TITLE_", 2),
        ("desc", "description", "JOB_DESCRIPTION", "DESCRIPTION_", 3),
    ):
        if key in fields:
            parts.append(f"""
SELECT {columns}, {rank}, '{kind}', phrase, skill_id, skill_name,
  '{prefix}' || CASE WHEN canonical = 1 THEN 'EXACT' ELSE 'ALIAS' END,
  CASE WHEN canonical = 1 THEN 'HIGH' ELSE 'MEDIUM' END,
  trim(regexp_replace(substr(t, greatest(pos - 40, 0) + 1,
    pos + len + 40 - greatest(pos - 40, 0)), '\\s+', ' ', 'g'))
FROM scoped JOIN firsts ON {column} = t""")
    text_union = " UNION ".join(
        f"SELECT {c} AS t FROM scoped WHERE {c} IS NOT NULL"
        for k, c in (("title", "job_title"), ("desc", "description")) if k in fields
    ) or "SELECT NULL::VARCHAR AS t WHERE FALSE"
    seg_source = "source_skills" if "seg" in fields else "NULL::VARCHAR"
    return [
        values("phrases", "phrase, skill_id, skill_name, canonical", phrases),
        values("segment_phrases", "phrase, skill_id, skill_name, method, confidence", segments),
        f"scoped AS (SELECT * FROM {source} WHERE {where})",
        f"""segs AS (SELECT *, {collapse('raw')} AS norm FROM (SELECT {columns},
  trim(unnest(list)) AS raw, generate_subscripts(list, 1) AS i FROM (SELECT *,
  string_split_regex({seg_source}, '[,;/|]+') AS list FROM scoped)) WHERE raw <> '')""",
        f"texts_seen AS ({text_union})",
        f"""hits AS (SELECT t, p.*, length(phrase) AS len,
  length(regexp_extract({low}, {before}, 1)) + length(regexp_extract({low}, {before}, 2)) AS pos
  FROM texts_seen, phrases p WHERE regexp_matches({low}, '(^|\\W)' || {edge} || '(\\W|$)'))""",
        """kept AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits g WHERE g.t = h.t
  AND g.len > h.len AND g.pos <= h.pos AND g.pos + g.len >= h.pos + h.len))""",
        """firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t, skill_id
  ORDER BY pos) AS n FROM kept) WHERE n = 1)""",
        "evidence_rows AS (" + " UNION ALL ".join(parts) + ")",
        """evidence AS (SELECT *, field_rank = min(field_rank) OVER (PARTITION BY posting_id,
  skill_id) AS first_for_job, CAST(count(*) OVER (PARTITION BY posting_id, skill_id) AS INTEGER)
  AS field_count FROM evidence_rows)""",
    ]


PLAIN = SkillDictionary.build()
COMMON = SkillDictionary.with_common_equivalences()
POSTINGS = view_cte("postings")

COUNTS = """count(DISTINCT e.posting_id) AS distinct_job_count,
  count(e.posting_id) AS mention_count,
  count(*) FILTER (WHERE e.confidence = 'HIGH') AS high_confidence,
  count(*) FILTER (WHERE e.confidence = 'MEDIUM') AS medium_confidence,
  count(*) FILTER (WHERE e.confidence = 'LOW') AS low_confidence,
  count(*) FILTER (WHERE e.evidence_type = 'JOB_TITLE') AS title_mentions,
  count(*) FILTER (WHERE e.evidence_type = 'JOB_DESCRIPTION') AS description_mentions,
  count(*) FILTER (WHERE e.evidence_type = 'SOURCE_SKILL') AS source_skill_mentions"""


def skill_dim(skills=seeds.SKILLS) -> str:
    return values("skill_dim", "skill_id, skill_name, verification_status",
                  [(s.skill_id, s.skill_name, s.verification_status) for s in skills])


def demand_cte(run_text: str | None, skills=seeds.SKILLS) -> list[str]:
    run = ("" if run_text is None
           else f"sha256('{run_text}') AS run_id, 'mvp-v1-no-score' AS rule_version, ")
    return [
        skill_dim(skills),
        f"""sd AS (SELECT d.skill_id, d.skill_name, {COUNTS}, any_value(d.verification_status)
  AS verification_status, (SELECT count(*) FROM scoped) AS total_jobs,
  (SELECT count(DISTINCT posting_id) FROM evidence) AS jobs_with_skill_evidence,
  (SELECT count(*) FROM evidence) AS total_evidence_rows, {run}
  coalesce({ratio('count(DISTINCT e.posting_id)', '(SELECT count(*) FROM scoped)', 6)}, 0.0)
  AS normalized_distinct_job_count
  FROM skill_dim d LEFT JOIN evidence e ON e.skill_id = d.skill_id GROUP BY 1, 2)""",
    ]


ALL_RUN = "skill-demand:mvp-v1-no-score:all:ALL:0001-01-01:9999-12-31"

EVIDENCE_COLUMNS = """posting_id, source_skill_text, skill_id AS canonical_skill_id,
  skill_name AS canonical_skill_name, method AS extraction_method,
  confidence AS match_confidence, evidence_text, evidence_type, first_for_job, field_count"""

ORACLES["skill_evidence"] = text(
    POSTINGS + evidence(COMMON), f"SELECT {EVIDENCE_COLUMNS} FROM evidence")

_DOC_PHRASES = values("phrases", "phrase, skill_id, skill_name, canonical", [
    (p, s.skill_id, s.skill_name, int(c))
    for p, (s, c) in SkillDictionary.build(DOC_SKILLS).text.items()])
_CONTEXT = r"""trim(regexp_replace(substr(description, (greatest(pos - 40, 0) + 1)::BIGINT,
  (pos + length(phrase) + 40 - greatest(pos - 40, 0))::BIGINT),
  '[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g')) AS evidence_text"""
# Words and every other character alone, with the characters before them.
TOKENS = r"""tokens AS (SELECT posting_id, description, tok, i, (sum(length(tok)) OVER
  (PARTITION BY posting_id ORDER BY i) - length(tok))::BIGINT AS pos FROM (SELECT posting_id,
  description, unnest(list) AS tok, generate_subscripts(list, 1) AS i FROM (SELECT *,
  regexp_extract_all(description, '(?s)[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]') AS list FROM texts)))"""
DOC_EVIDENCE = [
    _DOC_PHRASES,
    *view_cte("texts"),
    TOKENS,
    """evidence AS (SELECT *, 1 AS n FROM (SELECT posting_id, description, pos, p.*, row_number()
  OVER (PARTITION BY posting_id, skill_id ORDER BY i) AS k
  FROM tokens JOIN phrases p ON p.phrase = lower(tok)) WHERE k = 1)""",
]
_DOC_COLUMNS = f"""'JOB_DESCRIPTION' AS evidence_type, {_CONTEXT}, TRUE AS first_for_job,
  1 AS field_count FROM evidence"""
ORACLES["skill_evidence_documents"] = text(DOC_EVIDENCE, f"""SELECT posting_id,
  phrase AS source_skill_text, skill_id AS canonical_skill_id,
  skill_name AS canonical_skill_name,
  CASE WHEN canonical = 1 THEN 'DESCRIPTION_EXACT' ELSE 'DESCRIPTION_ALIAS' END
    AS extraction_method, CASE WHEN canonical = 1 THEN 'HIGH' ELSE 'MEDIUM' END
    AS match_confidence, {_DOC_COLUMNS}""")
ORACLES["skill_evidence_join"] = ORACLES["skill_evidence"]
# A match is kept unless the pair two tokens before it is kept: every other one of a run of pairs.
ORACLES["skill_evidence_passages"] = text([*view_cte("texts"), TOKENS, """bench AS (
  SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark)""", """names AS (
  SELECT DISTINCT name FROM (
    SELECT unnest(list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2])) AS name
    FROM bench WHERE len(w) > 1
    UNION ALL SELECT name FROM (SELECT unnest(w) AS name FROM bench) WHERE length(name) >= 6))""",
    """three AS (SELECT *, lower(tok) AS one, lower(tok) || lead(lower(tok), 1) OVER along ||
  lead(lower(tok), 2) OVER along AS pair FROM tokens WINDOW along AS
  (PARTITION BY posting_id ORDER BY i))""",
    """pairs AS (SELECT posting_id, i, description, pos, pair AS phrase, TRUE AS two,
  row_number() OVER (PARTITION BY posting_id, i % 2 ORDER BY i) AS k
  FROM three WHERE pair IN (SELECT name FROM names))""",
    """singles AS (SELECT posting_id, i, description, pos, one AS phrase, FALSE AS two FROM three t
  WHERE one IN (SELECT name FROM names)
  AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.posting_id = t.posting_id AND p.i = t.i))""",
    """runs AS (SELECT *, row_number() OVER (PARTITION BY posting_id, i % 2, i - 2 * k ORDER BY i)
  AS within FROM pairs)""",
    """kept AS (SELECT posting_id, i, description, pos, phrase FROM runs WHERE within % 2 = 1
  UNION ALL SELECT s.posting_id, s.i, s.description, s.pos, s.phrase FROM singles s LEFT JOIN runs r
  ON r.posting_id = s.posting_id AND r.i = s.i - 2 WHERE coalesce(r.within % 2, 0) = 0)""",
    """evidence AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY posting_id, phrase
  ORDER BY i) = 1)"""], f"""SELECT posting_id, phrase AS source_skill_text,
  upper(phrase) AS canonical_skill_id, array_to_string(list_transform(string_split(phrase, ' '),
  lambda x: upper(x[1]) || x[2:]), ' ') AS canonical_skill_name,
  'DESCRIPTION_EXACT' AS extraction_method, 'HIGH' AS match_confidence, {_DOC_COLUMNS}""")

UNMATCHED = """unmatched AS (SELECT * FROM segs WHERE norm NOT IN
  (SELECT phrase FROM segment_phrases))"""
ORACLES["unmatched_mentions"] = text(
    POSTINGS + evidence(COMMON) + [UNMATCHED],
    """SELECT 'SOURCE_SKILL' AS source_field, raw AS raw_text, norm AS normalized_text,
  count(*) AS mentions FROM unmatched GROUP BY 1, 2, 3""")
ORACLES["enhanced_evidence"] = text(
    POSTINGS + evidence(COMMON), """SELECT posting_id, skill_id AS canonical_skill_id,
  evidence_type, CASE WHEN field_count < 2 THEN confidence WHEN confidence = 'LOW' THEN 'MEDIUM'
  ELSE 'HIGH' END AS match_confidence FROM evidence""")
ORACLES["job_skill_profile"] = text(
    POSTINGS + evidence(COMMON) + [UNMATCHED], """
SELECT p.posting_id, coalesce(m, 0) AS total_mentions, coalesce(s, 0) AS matched_skills,
  coalesce(u, 0) AS unmatched_mentions, coalesce(x, 0) AS cross_field_confirmed,
  coalesce(f, '') AS fields_contributing, TRUE AS is_complete
FROM postings p
LEFT JOIN (SELECT posting_id, count(*) AS m, count(DISTINCT skill_id) AS s,
  count(DISTINCT skill_id) FILTER (WHERE field_count >= 2) AS x,
  string_agg(DISTINCT evidence_type, ',' ORDER BY evidence_type) AS f
  FROM evidence GROUP BY 1) e USING (posting_id)
LEFT JOIN (SELECT posting_id, count(*) AS u FROM unmatched GROUP BY 1) n USING (posting_id)""")
ORACLES["skill_summary"] = text(
    POSTINGS + evidence(COMMON) + [skill_dim()], f"""SELECT d.skill_id, d.skill_name,
  FALSE AS outside_seed, {COUNTS} FROM skill_dim d LEFT JOIN evidence e USING (skill_id)
  GROUP BY 1, 2""")
CORPUS = f"""SELECT (SELECT count(*) FROM scoped) AS jobs_processed,
  (SELECT count(*) FROM scoped WHERE NOT {blank('source_skills')}) AS jobs_with_source_skills,
  (SELECT count(*) FROM scoped WHERE NOT {blank('description')}) AS jobs_with_description,
  (SELECT count(*) FROM evidence) AS total_evidence_rows,
  (SELECT count(DISTINCT posting_id) FROM evidence) AS jobs_with_skill_evidence,
  (SELECT count(*) FROM evidence WHERE field_rank > 1) AS text_matched_mentions,
  (SELECT count(*) FROM unmatched) AS unmatched_mentions,
  (SELECT count(*) FROM evidence WHERE confidence = 'HIGH') AS high_confidence,
  (SELECT count(*) FROM evidence WHERE confidence = 'MEDIUM') AS medium_confidence,
  (SELECT count(*) FROM evidence WHERE confidence = 'LOW') AS low_confidence,
  (SELECT count(*) FROM evidence WHERE field_rank > 1) + (SELECT count(*) FROM unmatched)
    AS total_mentions_observed"""
ORACLES["corpus_metrics"] = text(POSTINGS + evidence(COMMON) + [UNMATCHED], CORPUS)
ORACLES["unmatched_top"] = text(
    POSTINGS + evidence(COMMON) + [UNMATCHED], """SELECT norm AS phrase, count(*) AS count
  FROM unmatched GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""")


def probe(dictionary: SkillDictionary, forms: int) -> list[str]:
    tech = "|".join(t.replace("+", "\\+").replace(".", "\\.") for t in seeds.TECH_TOKENS)
    return [
        values("known", "phrase", [(p,) for p in dictionary.text]),
        values("noise", "word", [(w,) for w in seeds.TITLE_NOISE]),
        f"""found AS (
  SELECT 'TITLE_OR_DESC_TOKEN' AS source_kind, posting_id, raw AS form, lower(raw) AS candidate
  FROM (SELECT posting_id, unnest(regexp_extract_all(coalesce(job_title, '') || ' ' ||
    coalesce(description, ''), '(?i)\\b(?:{tech})\\b')) AS raw FROM postings)
  WHERE lower(raw) NOT IN (SELECT word FROM noise)
  UNION ALL
  SELECT 'SOURCE_SKILL_CATEGORY', posting_id, raw, {collapse('raw')} FROM (SELECT posting_id,
    trim(unnest(string_split_regex(source_skills, '[,;/|]+'))) AS raw FROM postings)
  WHERE raw <> '')""",
        f"""probe AS (SELECT source_kind, candidate, count(*) AS mentions,
  count(DISTINCT posting_id) AS jobs,
  array_to_string(list_sort(list(DISTINCT form))[1:{forms}], ', ') AS forms FROM found
  WHERE candidate NOT IN (SELECT phrase FROM known) GROUP BY 1, 2)""",
    ]


ORACLES["token_probe"] = text(POSTINGS + probe(PLAIN, 8), "SELECT * FROM probe")
CANDIDATES = """cand AS (SELECT coalesce(t.candidate, c.candidate) AS candidate_skill,
  CASE WHEN c.candidate IS NULL THEN t.forms WHEN t.candidate IS NULL THEN c.forms
    ELSE c.forms || ' | ' || t.forms END AS observed_forms,
  greatest(coalesce(t.jobs, 0), coalesce(c.jobs, 0)) AS job_count,
  coalesce(t.mentions, 0) AS mention_count,
  CASE WHEN t.candidate IS NULL THEN '' WHEN c.candidate IS NULL THEN 'title/desc tech token'
    ELSE ' | title/desc tech token' END AS example_source_skills,
  'NEEDS_REVIEW' AS verification_status,
  CASE WHEN c.candidate IS NULL THEN 'TITLE_OR_DESC_TOKEN' ELSE 'SOURCE_SKILL_CATEGORY' END
    AS recommended_action
  FROM (SELECT * FROM probe WHERE source_kind LIKE 'TITLE%' AND mentions >= 2) t
  FULL JOIN (SELECT * FROM probe WHERE source_kind LIKE 'SOURCE%' AND mentions >= 2) c
  ON t.candidate = c.candidate)"""
ORACLES["skill_candidates"] = text(
    POSTINGS + probe(PLAIN, 5) + [CANDIDATES],
    "SELECT * FROM cand ORDER BY job_count DESC, candidate_skill LIMIT 30")
REVIEW = [
    values("decisions", "candidate, action, canonical_skill_id, canonical_skill_name, reason, "
           "confidence", DECISIONS),
    """review AS (SELECT candidate AS candidate_skill, forms AS observed_forms,
  jobs AS distinct_jobs, mentions AS mention_count, source_kind,
  'NEEDS_REVIEW' AS current_status, coalesce(action, 'NEEDS_REVIEW') AS recommended_action,
  coalesce(canonical_skill_name, '') AS canonical_skill_name,
  coalesce(canonical_skill_id, '') AS canonical_skill_id, coalesce(reason, '') AS reason,
  coalesce(confidence, 'NEEDS_REVIEW') AS confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY source_kind DESC) AS n
    FROM probe) LEFT JOIN decisions USING (candidate) WHERE n = 1)""",
]
ORACLES["ontology_review"] = text(POSTINGS + probe(PLAIN, 8) + REVIEW, "SELECT * FROM review")
ORACLES["ontology_review_summary"] = text(
    POSTINGS + probe(PLAIN, 8) + REVIEW,
    "SELECT recommended_action, count(*) AS candidates FROM review GROUP BY 1")
ORACLES["document_words"] = """SELECT word, count(*) AS count FROM (SELECT
  lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9.+#-]{1,}'))) AS word FROM documents)
  WHERE word NOT IN ('the', 'and', 'de') GROUP BY 1"""

# --- demand and gap ----------------------------------------------------------------------

ORACLES["skill_demand"] = text(
    POSTINGS + evidence(PLAIN, "source_id = '1-URGENT' AND retrieved_at >= DATE '1996-01-01' "
                        "AND retrieved_at < DATE '2000-01-01'")
    + demand_cte("skill-demand:mvp-v1-no-score:all:1-URGENT:1996-01-01:1999-12-31"),
    "SELECT * FROM sd")
_IT = ", ".join(q(v) for v in seeds.SECTOR_ALIASES["IT-ITeS"])
ORACLES["skill_demand_sector"] = text(
    POSTINGS + evidence(PLAIN, f"lower(trim(district)) = 'pune' AND sector IN ({_IT})")
    + demand_cte("skill-demand:mvp-v1-no-score:pune:ALL:0001-01-01:9999-12-31:"
                 + ",".join(sorted(seeds.SECTOR_ALIASES["IT-ITeS"]))),
    "SELECT * FROM sd")
ALL_DEMAND = POSTINGS + evidence(PLAIN) + demand_cte(ALL_RUN)
ORACLES["skill_demand_metrics"] = text(ALL_DEMAND, """SELECT max(total_jobs)
  AS total_jobs_evaluated, max(jobs_with_skill_evidence) AS jobs_with_skill_evidence,
  count(*) FILTER (WHERE distinct_job_count > 0) AS skills_with_evidence,
  max(total_evidence_rows) AS total_evidence_rows FROM sd""")
ORACLES["skill_demand_documents"] = text(
    DOC_EVIDENCE + [
        "scoped AS (SELECT * FROM texts)",
        """evidence2 AS (SELECT *, CASE WHEN canonical = 1 THEN 'HIGH' ELSE 'MEDIUM' END AS
  confidence, 'JOB_DESCRIPTION' AS evidence_type FROM evidence)""",
    ] + [c.replace("FROM evidence)", "FROM evidence2)").replace("JOIN evidence e",
                                                                "JOIN evidence2 e")
         for c in demand_cte(None, DOC_SKILLS)],
    "SELECT * FROM sd")
ORACLES["top_skills"] = text(ALL_DEMAND, """SELECT skill_id, distinct_job_count,
  normalized_distinct_job_count FROM sd ORDER BY 3 DESC, 1 LIMIT 5""")

OFFERED = view_cte("institute_trades") + [
    values("bridge", "trade, skill_id", seeds.TRADE_SKILLS),
    "offered AS (SELECT * FROM bridge WHERE trade IN (SELECT trade FROM institute_trades))",
    """supply AS (SELECT skill_id, string_agg(DISTINCT trade, ' | ' ORDER BY trade) AS trades,
  count(*) AS trade_count FROM offered GROUP BY 1)""",
]
GAP = ALL_DEMAND + OFFERED + ["""gap AS (SELECT sd.skill_id, skill_name,
  CASE WHEN trade_count IS NOT NULL THEN 'NEEDS_REVIEW' WHEN distinct_job_count = 0 OR
    total_jobs = 0 THEN 'NO_DATA' WHEN normalized_distinct_job_count >= 0.05 THEN 'HIGH_GAP'
    WHEN normalized_distinct_job_count >= 0.01 THEN 'MEDIUM_GAP' ELSE 'LOW_GAP' END
    AS gap_status,
  distinct_job_count AS demand_distinct_job_count, mention_count AS demand_mention_count,
  normalized_distinct_job_count AS demand_normalized_distinct_job_count,
  trade_count IS NOT NULL AS has_supply_evidence, trades AS supply_trades,
  coalesce(trade_count, 0) AS supply_trade_count, high_confidence, medium_confidence,
  low_confidence, verification_status, total_jobs
  FROM sd LEFT JOIN supply USING (skill_id))"""]
ORACLES["skill_gap"] = text(GAP, "SELECT * FROM gap")
ORACLES["skill_gap_summary"] = text(
    GAP + [values("statuses", "gap_status", [(s,) for s in GAP_ORDER])],
    """SELECT s.gap_status, count(g.skill_id) AS skills FROM statuses s LEFT JOIN gap g
  USING (gap_status) GROUP BY 1""")


def _filled(template: str) -> str:
    out = template
    for mark, value in (
        ("'%1$s'", "skill_name"),
        ("'%2$d'", "CAST(demand_distinct_job_count AS VARCHAR)"),
        ("'%3$s'", "pct"), ("'%4$s'", "note"), ("'%5$s'", "evaluated"),
        ("'%6$s'", "'ITI Haveli'"), ("'%7$s'", "'1 institute'"), ("'%8$s'", "'Pune'"),
    ):
        out = f"replace({out}, {mark}, {value})"
    return out


def recommended(evaluated: str, tail: str) -> str:
    rules = values("rules", "rule, rec, reason, evidence, priority, next_action",
                   gap_rules.RECOMMENDATION_RULES)
    return text(
        GAP + [rules, f"""ranked AS (SELECT *, {evaluated} AS evaluated,
  CASE WHEN gap_status = 'HIGH_GAP' AND has_supply_evidence THEN 'HIGH_GAP_SUPPLIED' ELSE
    gap_status END AS rule,
  printf('%.1f%%', CAST(round_even(demand_normalized_distinct_job_count * 100, 1) AS DOUBLE))
    AS pct,
  CASE WHEN has_supply_evidence THEN 'DVET supply evidence present from ITI Haveli (1 institute, '
      || supply_trade_count || ' trades). NOT verified against full Pune directory. NOT '
      'extrapolated district-wide.'
    ELSE 'No DVET supply evidence in current snapshot (ITI Haveli only).' END AS note
  FROM gap {tail})"""],
        f"""SELECT skill_id, skill_name, {_filled('rec')} AS recommendation,
  {_filled('reason')} AS reason, {_filled('evidence')} AS evidence, priority,
  'LOW' AS confidence, 'historical-postings' AS source, 'HISTORICAL' AS freshness,
  CASE WHEN demand_distinct_job_count = 0 THEN 'NO_DATA' ELSE 'OBSERVED' END AS evidence_status,
  CASE WHEN has_supply_evidence THEN 'NEEDS_REVIEW' ELSE 'NO_SUPPLY_EVIDENCE' END
    AS supply_status, verification_status AS data_quality, next_action
FROM ranked JOIN rules USING (rule)""")


_RANK = "list_position(" + q(list(GAP_ORDER)) + ", gap_status)"
ORACLES["skill_recommendations"] = recommended(
    "'N/A'", f"ORDER BY {_RANK}, demand_distinct_job_count DESC, skill_id LIMIT 20")
ORACLES["skill_recommendation_detail"] = recommended(
    "CAST(total_jobs AS VARCHAR)", "WHERE skill_id = 'SKL-DEV-JAVA-01'")
ORACLES["supply_summary"] = text(OFFERED, "SELECT * FROM supply")
ORACLES["occupation_supply"] = text(
    view_cte("institute_trades") + [values("bridge", "trade, occupation_id",
                                           seeds.TRADE_OCCUPATIONS)],
    """SELECT occupation_id, string_agg(DISTINCT trade, ' | ' ORDER BY trade) AS trades,
  count(*) AS trade_count FROM bridge WHERE trade IN (SELECT trade FROM institute_trades)
  GROUP BY 1""")
ORACLES["supply_totals"] = text(OFFERED, """SELECT (SELECT count(DISTINCT trade) FROM offered)
  AS total_trades, count(DISTINCT institute_code) AS institute_count,
  CAST(coalesce(sum(TRY_CAST(intake AS INTEGER)), 0) AS BIGINT) AS total_intake
  FROM institute_trades""")


def velocity(current: tuple[str, str], previous: tuple[str, str]) -> str:
    def inside(w):
        return (f"retrieved_at >= DATE '{w[0]}' AND retrieved_at < DATE '{w[1]}' "
                "+ INTERVAL 1 DAY")
    return f"""SELECT skill_id, cur AS window_distinct_jobs, prev AS previous_distinct_jobs,
  {ratio('cur', 'tc', 4)} AS window_job_share, {ratio('prev', 'tp', 4)} AS previous_job_share,
  {ratio('(cur - prev)', 'prev', 4)} AS relative_delta,
  CASE WHEN cur < 3 OR prev < 3 THEN 'INSUFFICIENT_DATA'
    WHEN CAST(cur - prev AS DOUBLE) / prev >= 0.25 THEN 'RISING'
    WHEN CAST(cur - prev AS DOUBLE) / prev <= -0.20 THEN 'FALLING' ELSE 'STABLE' END AS velocity,
  CAST(tc AS BIGINT) AS total_window_mentions, CAST(tp AS BIGINT) AS total_previous_mentions,
  (SELECT count(DISTINCT posting_id) FROM evidence WHERE {inside(current)})
    AS window_jobs_with_evidence,
  (SELECT count(DISTINCT posting_id) FROM evidence WHERE {inside(previous)})
    AS previous_jobs_with_evidence,
  CASE WHEN tc = 0 AND tp = 0 THEN 'NO_DATA' WHEN tp = 0 THEN 'NEW_WINDOW' ELSE 'PERIODIC' END
    AS freshness
FROM (SELECT *, sum(cur) OVER () AS tc, sum(prev) OVER () AS tp FROM (SELECT skill_id,
  count(DISTINCT posting_id) FILTER (WHERE {inside(current)}) AS cur,
  count(DISTINCT posting_id) FILTER (WHERE {inside(previous)}) AS prev
  FROM evidence WHERE ({inside(current)}) OR ({inside(previous)}) GROUP BY 1))"""


ORACLES["skill_velocity"] = text(
    view_cte("sightings") + evidence(SkillDictionary.build(EVENT_SKILLS), fields=("seg",),
                                     source="sightings"),
    velocity(("2024-01-16", "2024-01-30"), ("2024-01-01", "2024-01-15")))
ORACLES["skill_velocity_postings"] = text(
    POSTINGS + evidence(PLAIN),
    velocity(("2001-01-01", "2001-12-31"), ("2000-01-01", "2000-12-31")))

# --- occupations -------------------------------------------------------------------------

_PHRASES = [
    (o.occupation_id, t, " ".join(t.lower().split()), kind)
    for o in seeds.OCCUPATIONS
    for t, kind in [(o.occupation_name, "CANONICAL"), *((a, "ALIAS") for a in o.aliases)]
]
_NAMES = {o.occupation_id: o.occupation_name for o in seeds.OCCUPATIONS}


def resolver(titles: str) -> list[str]:
    """``occ``: one row per distinct title with its first applicable rule."""
    return [
        values("occ_phrases", "ord, occupation_id, phrase, low, kind",
               [(i, *p) for i, p in enumerate(_PHRASES)]),
        values("occ_rules", "ord, occupation_id, name, every, one_of",
               [(i, r.occupation_id, _NAMES[r.occupation_id], r.every, r.one_of)
                for i, r in enumerate(seeds.TOKEN_RULES)]),
        f"""norm_titles AS (SELECT t, {collapse('t')} AS n,
  string_split({collapse('t')}, ' ') AS tokens FROM (SELECT DISTINCT t FROM ({titles})))""",
        """occ_candidates AS (
  SELECT t, 1 AS stage, ord, occupation_id, phrase AS matched_text, 'EXACT_' || kind AS method
  FROM norm_titles JOIN occ_phrases ON n = low
  UNION ALL SELECT t, 2, ord, occupation_id, phrase, 'SUBSTRING_' || kind
  FROM norm_titles, occ_phrases WHERE (contains(n, low) OR contains(low, n))
    AND length(n) >= 4 AND length(low) >= 4
  UNION ALL SELECT t, 3, ord, occupation_id, name, 'MULTI_TOKEN_RULE'
  FROM norm_titles, occ_rules WHERE list_has_all(tokens, every)
    AND (len(one_of) = 0 OR list_has_any(tokens, one_of)))""",
        """occ AS (SELECT n.t, c.occupation_id, CASE WHEN c.t IS NULL THEN CASE WHEN n.n <> ''
    THEN n.t END ELSE c.matched_text END AS matched_text,
  CASE WHEN c.t IS NULL THEN 'UNMAPPED' ELSE 'NEEDS_REVIEW' END AS status,
  coalesce(c.method, 'NONE') AS method
  FROM norm_titles n LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t
    ORDER BY stage, ord) AS k FROM occ_candidates) WHERE k = 1) c ON c.t = n.t)""",
    ]


JOB_TITLES = resolver("SELECT job_title AS t FROM postings")
ORACLES["occupation_resolve"] = text(
    POSTINGS + JOB_TITLES, """SELECT posting_id, job_title, occupation_id, matched_text,
  occ.status, method FROM postings JOIN occ ON job_title = t""")
ORACLES["disposition_counts"] = text(
    POSTINGS + JOB_TITLES, f"""SELECT CASE WHEN {blank('district')} THEN 'UNKNOWN_DISTRICT'
  WHEN {blank('sector')} THEN 'UNKNOWN_SECTOR' WHEN occupation_id IS NOT NULL THEN 'MAPPED' ELSE
  'UNMAPPED' END AS disposition, count(*) AS postings FROM postings JOIN occ ON job_title = t
  GROUP BY 1""")

OCC_DIM = values("occ_dim", "occupation_id, occupation_name, sector, source_reference, aliases", [
    (o.occupation_id, o.occupation_name, o.sector, o.source_reference, " ".join(o.aliases))
    for o in seeds.OCCUPATIONS])


def demand_ctes(last: str = WINDOW[1], name: str = "demand") -> list[str]:
    window = (f"retrieved_at >= DATE '{WINDOW[0]}' AND retrieved_at < DATE '{last}' "
              "+ INTERVAL 1 DAY")

    def counter(kind, test):
        return f"count(*) FILTER (WHERE kind = '{kind}' AND {test})"
    have, sect, occ = "dk IS NOT NULL", f"NOT {blank('sector')}", "occupation_id IS NOT NULL"
    local = []
    for kind, short in (("J", "job"), ("A", "appr")):
        local += [
            f"{counter(kind, f'{have} AND {sect} AND {occ}')} AS mapped_{short}",
            f"{counter(kind, f'{have} AND {sect} AND NOT {occ}')} AS unmapped_{short}",
            f"{counter(kind, f'{have} AND NOT {sect}')} AS nosector_{short}",
        ]
    ok = f"{sect} AND {occ}"
    f, w = f"facts_{name}", f"wide_{name}"
    return [
        f"""{f} AS (SELECT 'J' AS kind, nullif(lower(trim(district)), '') AS dk,
  trim(district) AS d, sector, occupation_id FROM postings JOIN occ ON job_title = t
  WHERE {window} UNION ALL SELECT 'A', nullif(lower(trim(district)), ''), trim(district), sector,
  occupation_id FROM apprenticeships JOIN occ ON trade_title = t WHERE {window})""",
        f"""{w} AS (SELECT count(*) FILTER (WHERE kind = 'J') AS total_job,
  count(*) FILTER (WHERE kind = 'A') AS total_appr,
  count(*) FILTER (WHERE kind = 'J' AND dk IS NULL) AS nodistrict_job,
  count(*) FILTER (WHERE kind = 'A' AND dk IS NULL) AS nodistrict_appr FROM {f})""",
        f"""local_{name} AS (SELECT dk, min(d) AS district, {', '.join(local)},
  sha256('mvp-v1-no-score:' || dk || ':{WINDOW[0]}:{WINDOW[1]}') AS run_id
  FROM {f} WHERE dk IS NOT NULL GROUP BY 1)""",
        f"""counts_{name} AS (SELECT dk, occupation_id,
  count(*) FILTER (WHERE kind = 'J') AS job_count,
  count(*) FILTER (WHERE kind = 'A') AS apprenticeship_count FROM {f}
  WHERE dk IS NOT NULL AND {ok} GROUP BY 1, 2)""",
        f"""{name} AS (SELECT substr(run_id, 1, 16) || '-' || dk || '-' || occupation_id AS id,
  run_id, district, occupation_id, o.sector, DATE '{WINDOW[0]}' AS observation_period_start,
  DATE '{WINDOW[1]}' AS observation_period_end, job_count, apprenticeship_count,
  CAST(NULL AS DOUBLE) AS demand_score, 'INSUFFICIENT_DATA' AS data_completeness_status,
  'DERIVED' AS provenance_state, 'mvp-v1-no-score' AS rule_version,
  total_job AS total_job_postings_evaluated, mapped_job AS mapped_job_postings,
  unmapped_job AS unmapped_job_postings, nodistrict_job AS unknown_district_job_postings,
  nosector_job AS unknown_sector_job_postings, mapped_job AS needs_review_mapping_job_postings,
  total_appr AS total_apprenticeships_evaluated, mapped_appr AS mapped_apprenticeships,
  unmapped_appr AS unmapped_apprenticeships,
  nodistrict_appr AS unknown_district_apprenticeships,
  nosector_appr AS unknown_sector_apprenticeships,
  mapped_appr AS needs_review_mapping_apprenticeships,
  'DETERMINISTIC_EXACT_AND_SUBSTRING_ALIAS' AS occupation_mapping_method,
  'UNAVAILABLE' AS demand_score_method
  FROM counts_{name} JOIN local_{name} USING (dk) JOIN occ_dim o USING (occupation_id), {w})""",
    ]


DEMAND = (
    view_cte("postings", "apprenticeships")
    + resolver("SELECT job_title AS t FROM postings UNION SELECT trade_title FROM "
               "apprenticeships")
    + [OCC_DIM] + demand_ctes()
)
ORACLES["district_demand"] = text(DEMAND, "SELECT * FROM demand")
ORACLES["demand_run_counters"] = text(
    POSTINGS + JOB_TITLES, f"""SELECT count(*) AS input_observations,
  count(*) FILTER (WHERE ok) AS eligible_observations,
  count(*) FILTER (WHERE ok AND occupation_id IS NOT NULL) AS mapped_observations,
  count(*) FILTER (WHERE ok AND occupation_id IS NULL) AS unmapped_observations,
  count(*) FILTER (WHERE {blank('district')}) AS unknown_district_observations,
  count(*) FILTER (WHERE ok AND occupation_id IS NOT NULL)
    AS needs_review_mapping_observations,
  count(DISTINCT nullif(lower(trim(district)), '')) AS districts,
  count(DISTINCT CASE WHEN ok THEN occupation_id END) AS occupations
FROM (SELECT *, NOT {blank('district')} AND NOT {blank('sector')} AS ok FROM postings
  JOIN occ ON job_title = t)""")
ORACLES["demand_upsert_status"] = text(
    DEMAND + demand_ctes("1999-12-31", "older0") + [
        """older AS (SELECT * FROM older0 WHERE occupation_id <> 'OCC-AUTO-01'
  AND district <> 'Thane')"""],
    """SELECT coalesce(n.id, o.id) AS id, coalesce(n.job_count, o.job_count) AS job_count,
  coalesce(n.apprenticeship_count, o.apprenticeship_count) AS apprenticeship_count,
  CASE WHEN n.id IS NULL THEN 'KEPT' WHEN o.id IS NULL THEN 'CREATED' WHEN
    (o.district, o.job_count, o.apprenticeship_count, o.data_completeness_status) =
    (n.district, n.job_count, n.apprenticeship_count, n.data_completeness_status)
    THEN 'SKIPPED' ELSE 'UPDATED' END AS upsert_status
FROM older o FULL JOIN demand n ON o.id = n.id""")
_RUN = f"sha256('mvp-v1-no-score:' || dk || ':{WINDOW[0]}:{WINDOW[1]}:' || source_id)"
ORACLES["demand_of_two_sources"] = text(POSTINGS + JOB_TITLES, f"""SELECT substr({_RUN}, 1, 16) ||
  '-' || dk || '-' || occupation_id AS id, {_RUN} AS run_id, count(*) AS job_count,
  CASE source_id WHEN '1-URGENT' THEN 'KEPT' ELSE 'CREATED' END AS upsert_status
FROM (SELECT *, nullif(lower(trim(district)), '') AS dk FROM postings JOIN occ ON job_title = t)
WHERE source_id IN ('1-URGENT', '2-HIGH') AND dk IS NOT NULL AND NOT {blank('sector')}
  AND occupation_id IS NOT NULL GROUP BY source_id, dk, occupation_id""")
ORACLES["demand_upsert_counts"] = text(
    DEMAND, """SELECT CAST(0 AS BIGINT) AS rows_created, CAST(0 AS BIGINT) AS rows_updated,
  count(*) AS rows_skipped FROM demand""")
ORACLES["demand_for_period"] = text(
    DEMAND, """SELECT id, run_id, district, occupation_id, observation_period_start,
  observation_period_end, job_count, apprenticeship_count, demand_score,
  data_completeness_status, provenance_state, rule_version FROM demand""")
ORACLES["top_demand"] = text(
    DEMAND, """SELECT id, district, occupation_id, job_count FROM demand
  WHERE district = 'Pune' ORDER BY job_count DESC, id LIMIT 5""")


def mapped(titles: str) -> str:
    tok = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'))"
    return text(
        view_cte("reference_occupations", "titles") + [
            OCC_DIM,
            f"asked AS (SELECT DISTINCT title, skills, canonical_occupation_id FROM ({titles}))",
            f"""scope_tokens AS (SELECT occupation_id, list_distinct(regexp_extract_all(
  {collapse('occupation_name')} || ' ' || aliases || ' ' || {collapse('source_reference')},
  '[a-z0-9]+')) AS st FROM occ_dim)""",
            f"""refs AS (SELECT *, {tok.format('occupation_title')} AS rt,
  {tok.format('group_name')} AS rg,
  {tok.format("occupation_title || ' ' || group_name")} AS ra FROM reference_occupations)""",
            """scoped AS (SELECT occupation_id, entry_order FROM scope_tokens, refs
  WHERE list_has_any(st, ra))""",
            f"""pairs AS (SELECT a.*, r.*, {tok.format('title')} AS tt, {tok.format('skills')} AS ts
  FROM asked a, refs r WHERE a.canonical_occupation_id IS NULL
    OR a.canonical_occupation_id NOT IN (SELECT occupation_id FROM scoped)
    OR (a.canonical_occupation_id, r.entry_order) IN (SELECT (occupation_id, entry_order)
      FROM scoped))""",
            """scored AS (SELECT *, 0.7::DOUBLE * (len(list_intersect(tt, rt))::DOUBLE /
    (len(tt) + len(rt) - len(list_intersect(tt, rt)))) + 0.3::DOUBLE * CASE WHEN len(ts) = 0 OR
    len(rg) = 0 THEN 0::DOUBLE ELSE len(list_intersect(ts, rg))::DOUBLE /
    (len(ts) + len(rg) - len(list_intersect(ts, rg))) END AS score FROM pairs)""",
            """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title, skills,
  canonical_occupation_id ORDER BY score DESC, entry_order) AS k FROM scored) WHERE k = 1)""",
        ],
        """SELECT title, skills, canonical_occupation_id,
  CASE WHEN score >= 0.35 THEN o.occupation_name END AS canonical_occupation_name,
  CASE WHEN score >= 0.35 AND is_authoritative THEN nco_code END AS nco_code,
  CASE WHEN score >= 0.35 THEN occupation_title END AS nco_title,
  CASE WHEN score >= 0.35 THEN nullif(division, '') END AS nco_division,
  CASE WHEN score >= 0.35 THEN nullif(group_name, '') END AS nco_group,
  CAST(round_even(score, 4) AS DOUBLE) AS confidence,
  CASE WHEN score >= 0.35 THEN 'TOKEN_SIMILARITY' ELSE 'LOW_CONFIDENCE' END AS method,
  CASE WHEN score >= 0.35 AND is_authoritative THEN 'VERIFIED' ELSE 'NEEDS_REVIEW' END
    AS verification_status,
  title AS matched_on,
  CASE WHEN score >= 0.35 THEN coalesce(': ' || o.source_reference, b.source_reference) END
    AS source_reference
FROM best b LEFT JOIN occ_dim o ON o.occupation_id = canonical_occupation_id""")


ORACLES["nco_map"] = mapped("SELECT * FROM titles")
ORACLES["nco_crosswalk"] = mapped(
    "SELECT occupation_name AS title, sector AS skills, occupation_id AS "
    "canonical_occupation_id FROM occ_dim")

# --- identity, validation, ingest --------------------------------------------------------

_LOCALITY = "|".join(gazetteer.PUNE_LOCALITIES)
_CITY = "|".join(gazetteer.MAJOR_CITIES)


def city_ctes(source: str) -> list[str]:
    """``city``: one row per distinct location text with the city-list reading."""
    title = ("list_reduce(list_transform(regexp_extract_all(part, '[A-Za-z]+|[^A-Za-z]+'), "
             "lambda w: upper(w[1]) || lower(w[2:])), lambda a, b: a || b)")
    return [
        f"city_locs AS (SELECT DISTINCT loc, nullif(trim(loc), '') AS raw FROM ({source}))",
        """city_parts AS (SELECT loc, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM
  (SELECT loc, list_filter(list_transform(string_split_regex(raw, '[,/|;]+'), lambda x: trim(x)),
    lambda x: x <> '') AS p FROM city_locs WHERE raw IS NOT NULL))""",
        f"""city_found AS (
  SELECT loc, i, 0 AS j, 'Pune' AS city FROM city_parts
  WHERE regexp_matches(lower(part), '{_LOCALITY}')
  UNION ALL SELECT loc, i, j, CASE c WHEN 'pune' THEN 'Pune' WHEN 'bengaluru' THEN 'Bengaluru'
    WHEN 'bangalore' THEN 'Bengaluru' ELSE {title} END
  FROM (SELECT loc, i, part, unnest(cs) AS c, generate_subscripts(cs, 1) AS j FROM (SELECT *,
    regexp_extract_all(lower(part), '\\b(?:{_CITY})\\b') AS cs FROM city_parts)))""",
        """city_list AS (SELECT loc, list(city ORDER BY o) AS cities FROM (SELECT loc, city,
  min(i * 1000 + j) AS o FROM city_found GROUP BY 1, 2) GROUP BY 1)""",
        f"""city_base AS (SELECT l.loc, l.raw, coalesce(c.cities, []) AS cities,
  coalesce(len(c.cities), 0) AS n, coalesce(list_contains(c.cities, 'Pune'), FALSE) AS pune,
  contains(lower(l.raw), 'pune') AS says_pune,
  contains(lower(l.raw), 'maharashtra') OR EXISTS (SELECT 1 FROM city_parts p WHERE
    p.loc = l.loc AND lower(p.part) = 'mh') AS says_state,
  contains(l.raw, ',') AND NOT regexp_matches(l.raw, '[/|;]') AND
    len(list_filter(string_split(l.raw, ','), lambda s: contains(trim(s), ' ') AND
    len(list_filter(string_split_regex(trim(s), '\\s+'),
      lambda w: NOT regexp_matches(w, '^\\p{{Lu}}'))) = 0)) > 0 AS run_together,
  (SELECT arg_max(part, i) FROM city_parts p WHERE p.loc = l.loc AND
    regexp_matches(lower(part), '{_LOCALITY}')) AS locality
  FROM city_locs l LEFT JOIN city_list c ON l.loc = c.loc)""",
        """city_level AS (SELECT *, CASE WHEN n = 1 THEN 'EXACT_SINGLE' WHEN n > 1 THEN CASE WHEN
    run_together THEN 'CITY_MENTION' ELSE 'MULTI_EXPLICIT' END WHEN says_pune THEN
    'CITY_MENTION' ELSE 'UNKNOWN' END AS level FROM city_base)""",
        """city AS (SELECT loc, CASE WHEN raw IS NOT NULL THEN 'India' END AS country,
  CASE WHEN pune OR says_state THEN 'Maharashtra' END AS state,
  CASE WHEN pune THEN 'Pune' END AS district, CASE WHEN n > 0 THEN locality END AS locality,
  CASE WHEN n = 1 THEN 'SINGLE_LOCATION' WHEN n > 1 THEN 'MULTI_LOCATION' ELSE 'UNKNOWN' END
    AS location_scope,
  CASE WHEN n = 1 AND pune THEN 'HIGH' WHEN n > 0 THEN 'MEDIUM' WHEN says_state THEN 'LOW'
    ELSE 'NONE' END AS location_confidence,
  array_to_string(cities, ' | ') AS matched_locations, cities,
  'DETERMINISTIC_RULE_V1' AS normalization_method, level AS location_evidence_level,
  has AS has_pune_evidence, CASE WHEN NOT has THEN 'UNKNOWN' WHEN level = 'EXACT_SINGLE' THEN
    'EXCLUSIVE' WHEN level = 'MULTI_EXPLICIT' THEN 'SHARED' WHEN level = 'CITY_MENTION' THEN
    'MENTIONED' ELSE 'UNKNOWN' END AS pune_exclusivity
  FROM (SELECT *, coalesce(pune OR (level = 'CITY_MENTION' AND says_pune), FALSE) AS has
    FROM city_level))""",
    ]


def posting_day(x: str) -> str:
    return (f"CASE WHEN regexp_full_match(trim({x}), '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}(\\s+"
            "([01]\\d|2[0-3]):[0-5]\\d:[0-5]\\d(\\s+[+-]\\d{4})?)?') "
            f"THEN TRY_CAST(substr(trim({x}), 1, 10) AS DATE) END")


def seat_count(x: str) -> str:
    return (f"CASE WHEN regexp_full_match(trim({x}), '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)"
            f"([eE][+-]?\\d+)?') AND CAST(trim({x}) AS DOUBLE) >= 0 "
            f"THEN CAST(floor(CAST(trim({x}) AS DOUBLE)) AS BIGINT) END")


NORMALIZED = view_cte("raw_rows") + city_ctes(
    "SELECT joblocation_address AS loc FROM raw_rows") + [
    f"""flagged AS (SELECT r.*, {blank('jobtitle')} AS missing_title,
  {blank('company')} AS missing_company, {blank('joblocation_address')} AS missing_location,
  {posting_day('postdate')} AS day, {seat_count('numberofpositions')} AS n_seats
  FROM raw_rows r)""",
    f"""judged AS (SELECT *, NOT {blank('postdate')} AND day IS NULL AS malformed_date,
  NOT {blank('numberofpositions')} AND n_seats IS NULL AS malformed_seats FROM flagged)""",
    f"""normalized AS (SELECT j.*, NOT (missing_title OR malformed_date OR malformed_seats)
    AS accepted,
  list_filter([CASE WHEN missing_title THEN 'Missing job title' END,
    CASE WHEN malformed_date THEN 'Malformed postdate: ' || postdate END,
    CASE WHEN malformed_seats THEN 'Malformed numberofpositions: ' || numberofpositions END],
    lambda x: x IS NOT NULL) AS why,
  coalesce(nullif(trim(jobid), ''), nullif(trim(uniq_id), '')) AS record_id,
  c.state, c.district, c.location_scope, c.has_pune_evidence, c.pune_exclusivity
  FROM judged j LEFT JOIN city c ON c.loc IS NOT DISTINCT FROM j.joblocation_address)""",
    f"""accepted_rows AS (SELECT *, sha256(CASE WHEN record_id IS NOT NULL THEN
    'historical-rows:' || {collapse('record_id')} ELSE concat_ws('|', 'historical-rows',
    {collapse('jobtitle')}, {collapse('company')}, {collapse('joblocation_address')},
    coalesce(strftime(day, '%Y-%m-%d'), '')) END) AS h FROM normalized WHERE accepted)""",
]
ORACLES["identity_hash"] = text(
    NORMALIZED, "SELECT row_key, h AS record_identity_hash FROM accepted_rows")
ORACLES["derived_identities"] = text(
    POSTINGS, f"""SELECT posting_id,
  sha256(concat_ws('|', lower(trim(job_title)), lower(trim(employer_name)),
    coalesce(lower(trim(district)), ''), coalesce(lower(trim(sector)), ''),
    CAST(posted_date AS VARCHAR))) AS cross_source,
  'JOB-' || upper(substr(sha256(source_id || ':' || source_record_id), 1, 16)) AS job_code,
  sha256(concat_ws(':', source_id, source_record_id, lower(trim(job_title)),
    lower(trim(employer_name)))) AS staged_job,
  sha256('job_title::' || lower(trim(job_title)) || chr(31) || 'employer_name::' ||
    lower(trim(employer_name)) || chr(31) || 'district::' || coalesce(lower(trim(district)), ''))
    AS canonical_key,
  sha256(concat_ws('|', {collapse('source_id')}, {collapse('job_title')},
    {collapse('employer_name')}, {collapse('location_text')}, CAST(posted_date AS VARCHAR),
    CAST(posted_date AS VARCHAR))) AS apprenticeship
FROM postings""")
ORACLES["first_per_identity"] = text(
    NORMALIZED, """SELECT h AS record_identity_hash, row_key, trim(jobtitle) AS job_title,
  day AS posted_date FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY row_key) AS k
  FROM accepted_rows) WHERE k = 1""")
ORACLES["last_nonempty"] = text(
    NORMALIZED, """SELECT h AS record_identity_hash,
  arg_max(trim(skills), row_key) FILTER (WHERE skills <> '') AS source_skills,
  arg_max(n_seats, row_key) FILTER (WHERE n_seats IS NOT NULL) AS seats
  FROM accepted_rows GROUP BY 1""")

_FIELDS = {"jobid": "nullif(trim(jobid), '')", "jobtitle": f"nullif({collapse('jobtitle')}, '')",
           "company": f"nullif({collapse('company')}, '')",
           "location": f"nullif({collapse('joblocation_address')}, '')",
           "postdate": "nullif(trim(postdate), '')",
           "industry": f"nullif({collapse('industry')}, '')",
           "description": f"nullif({collapse('jobdescription')}, '')",
           "skills": f"nullif({collapse('skills')}, '')",
           "positions": "nullif(trim(numberofpositions), '')"}
_SHOWN = {"jobids": ("jobid", 3), "uniq_ids": ("uniq_id", 3), "job_titles": ("jobtitle", 2),
          "companies": ("company", 2), "locations": ("joblocation_address", 2),
          "post_dates": ("postdate", 2)}
COLLISIONS = NORMALIZED + [
    "collided AS (SELECT h, count(*) AS size, "
    + ", ".join(f"count(DISTINCT {e}) AS {n}" for n, e in _FIELDS.items()) + ", "
    + ", ".join(
        f"coalesce(array_to_string(list_sort(list(DISTINCT nullif(trim({c}), '')) FILTER "
        f"(WHERE NOT {blank(c)}))[1:{k}], ' | '), '') AS {o}" for o, (c, k) in _SHOWN.items())
    + " FROM accepted_rows GROUP BY 1 HAVING count(*) > 1)",
    """classed AS (SELECT *, CASE WHEN greatest(jobtitle, company, location, postdate, industry,
    description, skills, positions) <= 1 THEN 'TRUE_DUPLICATE'
  WHEN location > 1 AND greatest(jobtitle, company, postdate) <= 1 THEN 'MULTI_LOCATION_POSTING'
  WHEN postdate > 1 AND greatest(jobtitle, company, location) <= 1 THEN 'REPOSTING'
  ELSE 'UNCERTAIN' END AS classification FROM collided)""",
    """groups AS (SELECT h AS identity_hash, substr(h, 1, 16) AS identity,
  size AS collision_size, classification,
  CASE classification WHEN 'TRUE_DUPLICATE' THEN CASE WHEN jobid = 1 THEN
      'All fields identical including jobid' ELSE
      'All fields identical, different jobids suggest source duplication' END
    WHEN 'MULTI_LOCATION_POSTING' THEN CASE WHEN jobid = 1 THEN
      'Same jobid, title, company, date; different locations' ELSE
      'Same title, company, date; different locations and jobids' END
    WHEN 'REPOSTING' THEN 'Same title, company, location; different posting dates'
    ELSE 'Multiple variations: ' || concat_ws(', ', CASE WHEN jobtitle > 1 THEN jobtitle ||
      ' titles' END, CASE WHEN company > 1 THEN company || ' companies' END,
      CASE WHEN location > 1 THEN location || ' locations' END,
      CASE WHEN postdate > 1 THEN postdate || ' dates' END) END AS reason,
  CASE WHEN classification = 'REPOSTING' THEN 'HIGH' WHEN classification = 'UNCERTAIN' THEN
    'LOW' WHEN jobid = 1 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
  """ + ", ".join(_SHOWN) + " FROM classed)",
]
ORACLES["collision_groups"] = text(COLLISIONS, "SELECT * FROM groups")
ORACLES["collision_policy"] = text(COLLISIONS + [
    """t AS (SELECT (SELECT count(*) FROM accepted_rows) AS total_input_rows,
  (SELECT count(DISTINCT h) FROM accepted_rows) AS unique_identities,
  count(*) AS duplicate_identity_groups,
  CAST(coalesce(sum(collision_size), 0) AS BIGINT) AS duplicate_identity_rows,
  count(*) FILTER (WHERE classification = 'TRUE_DUPLICATE') AS true_duplicate,
  count(*) FILTER (WHERE classification = 'MULTI_LOCATION_POSTING') AS multi_location_posting,
  count(*) FILTER (WHERE classification = 'REPOSTING') AS reposting,
  count(*) FILTER (WHERE classification = 'SOURCE_DUPLICATE') AS source_duplicate,
  count(*) FILTER (WHERE classification = 'UNCERTAIN') AS uncertain FROM groups)"""],
    """SELECT *, CASE WHEN 2 * (true_duplicate + source_duplicate) > duplicate_identity_groups
  THEN 'DEDUPLICATE_BEFORE_PERSISTENCE' WHEN 2 * reposting > duplicate_identity_groups THEN
  'PERSIST_ALL_FLAG_REPOSTINGS' WHEN 2 * uncertain > duplicate_identity_groups THEN
  'PERSIST_ALL_WITH_COLLISION_FLAG' ELSE 'PERSIST_ALL_WITH_CLASSIFICATION' END
  AS recommended_policy FROM t""")
ORACLES["collision_examples"] = text(
    COLLISIONS, """SELECT identity, classification, CAST(k AS INTEGER) AS example FROM (SELECT *,
  row_number() OVER (PARTITION BY classification ORDER BY identity_hash) AS k FROM groups)
  WHERE k <= 5""")
STORED = ["stored AS (SELECT DISTINCT h FROM accepted_rows WHERE priority = '1-URGENT')"]
ORACLES["insert_or_skip"] = text(NORMALIZED + STORED, """
SELECT substr(f.h, 1, 32) AS posting_id, trim(jobtitle) AS job_title, day AS posted_date,
  'EXPIRED' AS status, l.source_skills, l.seats,
  'SUPPLEMENTARY_HISTORICAL' AS source_type, location_scope
FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY row_key) AS k FROM accepted_rows) f
JOIN (SELECT h, arg_max(trim(skills), row_key) FILTER (WHERE skills <> '') AS source_skills,
  arg_max(n_seats, row_key) FILTER (WHERE n_seats IS NOT NULL) AS seats FROM accepted_rows
  GROUP BY 1) l ON l.h = f.h
WHERE k = 1 AND f.h NOT IN (SELECT h FROM stored)""")
ORACLES["ingest_accounting"] = text(NORMALIZED + STORED + ["""a AS (SELECT
  (SELECT count(*) FROM normalized) AS input_rows,
  (SELECT count(*) FROM accepted_rows) AS normalized_rows,
  (SELECT count(*) FROM normalized WHERE NOT accepted) AS rejected_rows,
  (SELECT count(DISTINCT h) FROM accepted_rows WHERE h NOT IN (SELECT h FROM stored))
    AS inserted_rows)"""],
    """SELECT *, CAST(0 AS BIGINT) AS updated_rows, normalized_rows - inserted_rows
  AS skipped_rows, CAST(0 AS BIGINT) AS error_rows, TRUE AS reconciled FROM a""")
EDGES = """SELECT substr(identity_hash, 1, 32) AS member_record_id,
  classification AS relationship_type, identity_hash AS group_id FROM groups"""
ORACLES["prefix_resolve"] = text(COLLISIONS, EDGES.replace(
    " FROM groups", ", FALSE AS ambiguous FROM groups"))
ORACLES["relationship_insert"] = text(
    COLLISIONS, EDGES + " WHERE classification <> 'UNCERTAIN'")
ORACLES["referential_check"] = """SELECT l_orderkey, count(*) AS orphans FROM lineitem
  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')
  GROUP BY 1"""
ORACLES["validate_rows"] = text(NORMALIZED, """SELECT row_key, missing_title, missing_company,
  missing_location, malformed_date, malformed_seats, accepted,
  array_to_string(why, '; ') AS reasons, CASE WHEN accepted THEN day END AS posted_date,
  CASE WHEN accepted THEN n_seats END AS seats,
  CASE WHEN accepted THEN record_id END AS source_record_id,
  CASE WHEN accepted THEN district END AS district,
  CASE WHEN accepted THEN state END AS state FROM normalized""")
ORACLES["adapter_profile"] = text(NORMALIZED, """SELECT count(*) AS input_rows,
  count(*) FILTER (WHERE accepted) AS normalized_rows,
  count(*) FILTER (WHERE NOT accepted) AS rejected_rows,
  (SELECT count(*) - count(DISTINCT h) FROM accepted_rows) AS duplicate_identity_count,
  """ + ", ".join(f"count(*) FILTER (WHERE {f}) AS {f}_count" for f in (
      "missing_title", "missing_company", "missing_location", "malformed_date",
      "malformed_seats")) + ", " + ", ".join(
      f"count(*) FILTER (WHERE accepted AND has_pune_evidence AND pune_exclusivity = '{v}') "
      f"AS pune_{v.lower()}_count" for v in ("EXCLUSIVE", "SHARED", "MENTIONED")) + """,
  count(*) FILTER (WHERE accepted AND has_pune_evidence) AS pune_total_evidence_count
  FROM normalized""")
ORACLES["reject_tally"] = text(
    NORMALIZED, """SELECT reason, count(*) AS n FROM (SELECT unnest(why) AS reason
  FROM normalized) GROUP BY 1""")

_S = "CASE source_id WHEN '1-URGENT' THEN 'IT' WHEN '2-HIGH' THEN ' ' ELSE sector END"
CLEANED = POSTINGS + [
    f"""trimmed AS (SELECT posting_id, coalesce(trim(district), '') AS district,
  CASE coalesce(trim({_S}), '') WHEN 'IT' THEN 'IT-ITeS' WHEN 'ITeS' THEN 'IT-ITeS'
    WHEN 'Automotive' THEN 'Automotive/Manufacturing' WHEN 'Manufacturing' THEN
    'Automotive/Manufacturing' ELSE coalesce(trim({_S}), '') END AS sector,
  CASE WHEN source_id = '5-LOW' THEN '' ELSE 'Maharashtra' END AS state FROM postings)""",
    """cleaned AS (SELECT *, list_filter([
  CASE WHEN district = '' THEN 'district is required' END,
  CASE WHEN sector = '' THEN 'sector is required' END,
  CASE WHEN sector <> '' AND sector NOT IN ('IT-ITeS', 'Automotive/Manufacturing', 'Electronics')
    THEN 'Invalid sector ''' || sector ||
    '''. Must be one of: Automotive/Manufacturing, Electronics, IT-ITeS' END,
  CASE WHEN state = '' THEN 'state is required' END], lambda x: x IS NOT NULL) AS errors
  FROM trimmed)""",
]
ORACLES["clean_records"] = text(CLEANED, """SELECT posting_id, district, sector, state,
  len(errors) = 0 AS is_valid, array_to_string(errors, '; ') AS errors FROM cleaned""")
ORACLES["combined_reject_tally"] = text(CLEANED, """SELECT
  array_to_string(list_sort(errors), '; ') AS reasons, count(*) AS n FROM cleaned
  WHERE len(errors) > 0 GROUP BY 1""")
ORACLES["contract_check"] = text(POSTINGS, """SELECT array_to_string(list_sort(errors), '; ')
  AS reasons, count(*) AS n FROM (SELECT list_filter([
  CASE WHEN trim(district) = '' THEN 'district: blank string' END,
  CASE WHEN trim(sector) = '' THEN 'sector: blank string' END,
  CASE WHEN trim(source_skills) = '' THEN 'source_skills: blank string' END,
  CASE WHEN length(job_title) < 16 THEN 'seats: must be >= 0' END], lambda x: x IS NOT NULL)
  AS errors FROM postings) WHERE len(errors) > 0 GROUP BY 1""")

POLICIES = view_cte("sources") + ["""policies AS (SELECT source_id,
  CASE WHEN upper(coalesce(verification_status, '')) = 'VERIFIED' THEN 'AUTHORIZED_API'
    WHEN upper(coalesce(verification_status, '')) = 'PERMITTED' THEN 'PERMITTED_PUBLIC_CRAWL'
    ELSE 'UNKNOWN' END AS authorization_status,
  access_method IN ('VERIFIED_API', 'REST_API') AS api_available,
  access_method NOT IN ('SOURCE_SNAPSHOT', 'MANUAL_CURATION') AS crawl_allowed,
  CASE WHEN official_government_source THEN 1 ELSE 2 END AS source_priority,
  coalesce(enabled, TRUE) AS enabled FROM sources)""",
    """gated AS (SELECT *, CASE WHEN NOT enabled THEN 'HALT' WHEN authorization_status =
  'UNKNOWN' THEN 'REJECT' WHEN NOT crawl_allowed AND NOT api_available THEN 'DENIED' ELSE
  'PROCEED' END AS action FROM policies)"""]
ORACLES["source_gate"] = text(POLICIES, """SELECT *, action = 'PROCEED' AS eligible,
  CASE action WHEN 'HALT' THEN 'Source ''' || source_id || ''' is administratively disabled.'
    WHEN 'REJECT' THEN 'Source ''' || source_id || ''' authorization status ''' ||
    authorization_status || ''' prohibits automated ingestion.'
    WHEN 'DENIED' THEN 'Source ''' || source_id ||
    ''' has neither crawl_allowed=True nor api_available=True.'
    ELSE 'Source meets all governance criteria.' END AS reason FROM gated""")
ORACLES["governed_ingest"] = text(POLICIES + POSTINGS + [
    values("feeds", "source_id", [("Supplier#000000005",), ("Supplier#000000001",),
                                  ("Unregistered",)]),
    """judged AS (SELECT f.source_id, coalesce(action, 'UNGOVERNED') AS action,
  coalesce(action = 'PROCEED', FALSE) AS eligible,
  coalesce(location_text, '') <> '' AS good, row_number() OVER (PARTITION BY f.source_id,
  coalesce(location_text, '') <> '', job_title, location_text, description ORDER BY posting_id)
  AS k FROM feeds f LEFT JOIN gated g ON g.source_id = f.source_id, postings p)"""],
    """SELECT source_id, action, CASE WHEN NOT eligible THEN 'BLOCKED' WHEN NOT good THEN
  'INVALID' WHEN k = 1 THEN 'STAGED' ELSE 'DUPLICATE' END AS disposition, count(*) AS records
  FROM judged GROUP BY 1, 2, 3""")
ORACLES["listed_policies"] = text(view_cte("sources"), """SELECT source_id, source_name,
  url AS base_url, category AS source_category, coalesce(source_type, 'unknown') AS source_type,
  access_method, CASE WHEN access_method IN ('VERIFIED_API', 'VERIFIED_EXPORT') THEN
  'AUTHORIZED_API' ELSE 'PERMITTED_PUBLIC_CRAWL' END AS authorization_status,
  'ALLOWED' AS robots_status, coalesce(enabled, FALSE) AS enabled FROM sources""")
HEALTH = view_cte("sources") + ["""health AS (SELECT source_id, CASE WHEN
  reliability_notes LIKE '%Last FAIL%' THEN 'OFFLINE' WHEN last_fetched_at IS NOT NULL THEN
  'ONLINE' ELSE 'NEVER_FETCHED' END AS status, freshness_class, last_fetched_at FROM sources)"""]
ORACLES["source_health"] = text(HEALTH, "SELECT source_id, status, freshness_class FROM health")
ORACLES["source_health_summary"] = text(HEALTH, """SELECT count(*) FILTER (WHERE status =
  'ONLINE') AS sources_online, count(*) AS sources_total,
  CAST(max(last_fetched_at) AS VARCHAR) AS last_fetched_at FROM health""")
ORACLES["health_from_telemetry"] = """SELECT CAST(user_id AS VARCHAR) AS source_id,
  arg_max(CASE event_type WHEN 'error' THEN 'OFFLINE' WHEN 'view' THEN 'DEGRADED' ELSE 'ONLINE'
    END, ts) AS status,
  rtrim(strftime(max(ts) FILTER (WHERE event_type <> 'error'), '%Y-%m-%d %H:%M:%S.%f'), '0')
    AS last_success,
  rtrim(strftime(max(ts) FILTER (WHERE event_type = 'error'), '%Y-%m-%d %H:%M:%S.%f'), '0')
    AS last_failure, count(*) AS fetches FROM events GROUP BY 1"""

# --- parsers -----------------------------------------------------------------------------


def first_two(numbers: str, kind: str) -> str:
    return (f"CAST(TRY_CAST({numbers}[1] AS {kind}) AS {{0}}) AS low, "
            f"CAST(TRY_CAST(coalesce({numbers}[2], {numbers}[1]) AS {kind}) AS {{0}}) AS high")


_MONEY = "regexp_extract_all({0}, '\\d+(?:\\.\\d+)?')"
_SALARY_1 = _MONEY.format(
    "replace(replace(replace({0}, ',', ''), '₹', ''), 'Rs.', '')")
_SALARY_2 = _MONEY.format(
    "replace(replace(replace(replace(replace({0}, '₹', ''), ',', ''), 'PA', ''), 'per annum', "
    "''), ' annum', '')")
_YEARS = "regexp_extract_all({0}, '\\d+')"


def parser(column: str, select: str) -> str:
    return text(view_cte("parser_inputs") + [
        f"inputs AS (SELECT DISTINCT {column} AS input FROM parser_inputs)"],
        f"SELECT input, {select} FROM inputs")


def oversized(numbers: str, kind: str) -> str:
    return (f", coalesce(len(list_filter({numbers}, lambda x: TRY_CAST(x AS {kind}) IS NULL)) > 0, "
            "FALSE) AS malformed")


ORACLES["parse_salary"] = parser(
    "salary", first_two(_SALARY_1.format("input"), "DECIMAL(38,10)").format("DOUBLE")
    + oversized(_SALARY_1.format("input"), "DECIMAL(38,10)"))
_ALL = f"list_transform({_SALARY_2.format('input')}, lambda x: TRY_CAST(x AS DECIMAL(38,10)))"
ORACLES["clean_salary"] = parser(
    "salary", f"CAST(list_min({_ALL}) AS DOUBLE) AS low, CAST(list_max({_ALL}) AS DOUBLE) AS "
    "high, CASE WHEN input <> '' THEN 'INR' END AS currency")
ORACLES["parse_experience"] = parser(
    "experience", first_two(_YEARS.format("input"), "BIGINT").format("BIGINT")
    + oversized(_YEARS.format("input"), "BIGINT"))
_C = "trim(regexp_replace(lower(input), 'years?|yrs?', '', 'g'))"
ORACLES["clean_experience"] = parser("experience", f"""
  CAST(CASE WHEN regexp_matches({_C}, '^\\d+\\+') THEN regexp_extract({_C}, '^(\\d+)', 1)
    WHEN regexp_matches({_C}, '^\\d+\\s*[-–]\\s*\\d+') THEN regexp_extract({_C}, '^(\\d+)', 1)
    WHEN regexp_matches({_C}, '^[+-]?\\d+$') THEN {_C} END AS BIGINT) AS low,
  CAST(CASE WHEN regexp_matches({_C}, '^\\d+\\+') THEN NULL
    WHEN regexp_matches({_C}, '^\\d+\\s*[-–]\\s*\\d+')
      THEN regexp_extract({_C}, '^\\d+\\s*[-–]\\s*(\\d+)', 1)
    WHEN regexp_matches({_C}, '^[+-]?\\d+$') THEN {_C} END AS BIGINT) AS high""")
ORACLES["parse_dates"] = parser("day_text", """
  CASE WHEN regexp_full_match(input, '\\d{4}(-\\d{1,2}-|/\\d{1,2}/)\\d{1,2}') THEN
      TRY_CAST(replace(input, '/', '-') AS DATE)
    WHEN regexp_full_match(input, '\\d{1,2}(-\\d{1,2}-|/\\d{1,2}/)\\d{4}') THEN TRY_CAST(
      regexp_replace(input, '^(\\d{1,2})[-/](\\d{1,2})[-/](\\d{4})$', '\\3-\\2-\\1') AS DATE)
    END AS flexible,
  CASE WHEN regexp_full_match(input, '\\d{4}-\\d{1,2}-\\d{1,2}') THEN TRY_CAST(input AS DATE)
    END AS iso,
  coalesce(input, '') <> '' AND NOT coalesce(regexp_full_match(input,
    '\\d{4}-\\d{1,2}-\\d{1,2}') AND TRY_CAST(input AS DATE) IS NOT NULL, FALSE)
    AS iso_malformed""")
ORACLES["parse_posting_dates"] = parser(
    "postdate", f"{posting_day('input')} AS value, NOT {blank('input')} AND "
    f"({posting_day('input')}) IS NULL AS malformed")
ORACLES["parse_seats"] = parser(
    "seats", f"{seat_count('input')} AS value, NOT {blank('input')} AND "
    f"({seat_count('input')}) IS NULL AS malformed")

_EXP, _SAL = _YEARS.format("experience"), _SALARY_1.format("salary")
SNAPSHOT = view_cte("parser_inputs") + [f"""snap AS (SELECT *,
  CASE WHEN l_linenumber = 7 THEN '' ELSE 'Job ' || l_partkey END AS title,
  'Employer ' || l_suppkey AS employer, l_orderkey || '-' || l_linenumber AS rid,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ordinal FROM
  parser_inputs)""", f"""staged AS (SELECT ordinal, sha256('snapshot:' || rid) AS staging_id,
  title <> '' AS is_valid, CASE WHEN title = '' THEN 'Missing job_title' END
    AS validation_errors, CASE WHEN l_linenumber = 1 THEN 'Thane' ELSE 'Pune' END AS district,
  CASE WHEN title <> '' THEN sha256(concat_ws(':', 'snapshot', rid, lower(title),
    lower(employer))) END AS job_identity_hash,
  TRY_CAST({_EXP}[1] AS BIGINT) AS experience_years_min,
  TRY_CAST(coalesce({_EXP}[2], {_EXP}[1]) AS BIGINT) AS experience_years_max,
  CAST(TRY_CAST({_SAL}[1] AS DECIMAL(38,10)) AS DOUBLE) AS salary_min,
  CAST(TRY_CAST(coalesce({_SAL}[2], {_SAL}[1]) AS DECIMAL(38,10)) AS DOUBLE) AS salary_max,
  CASE WHEN regexp_full_match(day_text, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN
    TRY_CAST(day_text AS DATE) END AS posted_day,
  coalesce(day_text, '') <> '' AND NOT regexp_full_match(day_text,
    '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') AS posted_date_malformed FROM snap)"""]
ORACLES["snapshot_staging"] = text(SNAPSHOT, """SELECT ordinal, staging_id, is_valid,
  validation_errors, district, job_identity_hash, experience_years_min, experience_years_max,
  salary_min, salary_max, posted_day, coalesce(posted_date_malformed, FALSE)
  AS posted_date_malformed FROM staged""")
ORACLES["snapshot_counts"] = text(SNAPSHOT, """SELECT count(*) AS total_records_processed,
  count(DISTINCT staging_id) AS staged, count(*) FILTER (WHERE NOT is_valid) AS errors,
  (SELECT count(DISTINCT job_identity_hash) FROM staged WHERE is_valid AND job_identity_hash NOT
    IN (SELECT job_identity_hash FROM staged WHERE is_valid AND district = 'Thane'))
    AS normalized FROM staged""")
ORACLES["staging_list"] = text(SNAPSHOT, """SELECT staging_id, 'failed' AS processing_status,
  is_valid FROM staged WHERE NOT is_valid ORDER BY staging_id DESC LIMIT 20""")
ORACLES["institutes"] = """WITH i AS (SELECT s_name AS institute_name,
  CASE WHEN s_nationkey > 3 THEN 'C' || s_suppkey ELSE s_name END AS institute_code,
  CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) AS intake FROM supplier
  WHERE s_nationkey <> 5)
SELECT institute_code, institute_name, 'Pune' AS district, 'Maharashtra' AS state,
  position, trade_name, unit_category, CASE position WHEN 0 THEN intake END AS intake,
  sha256(concat_ws(':', institute_code, trade_name, coalesce(unit_category, ''),
    CASE position WHEN 0 THEN intake ELSE '' END, CAST(position AS VARCHAR)))
    AS trade_identity_hash
FROM i, (VALUES (0, 'Machinist', 'NCVT'), (1, 'Painter General', NULL))
  t(position, trade_name, unit_category)"""

# --- duplicates --------------------------------------------------------------------------

_SUMS = ", ".join(f"sum((h >> {b}) & 1) AS b{b}" for b in range(64))
_WORD = " + ".join(f"CASE WHEN 2 * b{b} > n THEN {1 << b}::HUGEINT ELSE 0 END" for b in range(64))
SIMHASH = [
    """shingles AS (SELECT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, '|')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || '|' || w[i + 1] || '|' || w[i + 2])
  END) AS s FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w
  FROM documents))""",
    f"""counted AS (SELECT doc_id, count(*) AS n, {_SUMS} FROM (SELECT doc_id,
  ('0x' || substr(md5(s), 1, 16))::UBIGINT AS h FROM shingles) GROUP BY 1)""",
    f"fp AS (SELECT doc_id, CAST({_WORD} AS UBIGINT) AS f FROM counted)",
]
ORACLES["simhash"] = text(SIMHASH, """SELECT CAST(doc_id AS VARCHAR) AS posting_id,
  lpad(lower(to_hex(f)), 16, '0') AS fingerprint FROM fp""")


def duplicates(ordinal: str = "doc_id", new: str = "TRUE", repost: str = "") -> str:
    """Statuses in the order of `ordinal`, of the rows where `new` holds."""
    return text(SIMHASH + [
        f"""keyed AS (SELECT doc_id, f, {ordinal} AS o, {new} AS fresh,
  lower(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS k FROM documents JOIN fp USING (doc_id))""",
        """same_key AS (SELECT doc_id, o > min(o) OVER (PARTITION BY k) AS seen FROM keyed)""",
        """first_fp AS (SELECT f, min(o) AS first_o, arg_min(doc_id, o) AS first_id FROM keyed
  GROUP BY 1)""",
        """near AS (SELECT a.f, arg_min(b.first_id, b.first_o) AS near_id FROM first_fp a, first_fp b
  WHERE b.first_o < a.first_o AND bit_count(xor(a.f, b.f)) <= 3 GROUP BY 1)""",
        """matched AS (SELECT k.doc_id, s.seen, CASE WHEN k.o > first_o THEN first_id ELSE
  near_id END AS m FROM keyed k JOIN same_key s USING (doc_id) JOIN first_fp USING (f)
  LEFT JOIN near USING (f) WHERE fresh)""",
    ], f"""SELECT CAST(doc_id AS VARCHAR) AS record_id, CASE WHEN seen THEN 'EXACT_MATCH' {repost}
  WHEN m IS NOT NULL THEN 'NEAR_DUPLICATE' ELSE 'DISTINCT' END AS status,
  CASE WHEN NOT seen THEN CAST(m AS VARCHAR) END AS matched_record_id FROM matched""")


ORACLES["dedup_status"] = duplicates()
ORACLES["dedup_incremental"] = duplicates(
    "doc_id + CASE WHEN lang = 'en' THEN 0 ELSE 1000000000000 END", "lang <> 'en'")
ORACLES["dedup_repost"] = duplicates(repost="WHEN m = doc_id - 1 THEN 'REPOST'")

# --- geography ---------------------------------------------------------------------------

RAW_CITY = view_cte("raw_rows") + city_ctes("SELECT joblocation_address AS loc FROM raw_rows")
_JOIN_CITY = "raw_rows r LEFT JOIN city c ON c.loc IS NOT DISTINCT FROM r.joblocation_address"
ORACLES["locations_city"] = text(
    RAW_CITY, f"SELECT row_key, c.* EXCLUDE (loc, cities) FROM {_JOIN_CITY}")
ORACLES["locations_of_nations"] = text(
    view_cte("location_texts") + city_ctes("SELECT location_text AS loc FROM location_texts"),
    """SELECT c_custkey, location_scope, matched_locations, location_evidence_level
  FROM location_texts LEFT JOIN city ON loc IS NOT DISTINCT FROM location_text""")
ORACLES["location_profile"] = text(RAW_CITY, f"""SELECT count(*) AS total_records,
  count(*) FILTER (WHERE NOT {blank('joblocation_address')}) AS records_with_location,
  count(*) FILTER (WHERE location_scope = 'SINGLE_LOCATION') AS single_location_count,
  count(*) FILTER (WHERE location_scope = 'MULTI_LOCATION') AS multi_location_count,
  count(*) FILTER (WHERE location_scope = 'UNKNOWN') AS unknown_count,
  count(*) FILTER (WHERE location_scope = 'SINGLE_LOCATION' AND district = 'Pune')
    AS pune_single_location_count,
  count(*) FILTER (WHERE location_scope = 'MULTI_LOCATION' AND district = 'Pune')
    AS pune_multi_location_count FROM {_JOIN_CITY}""")
_NORMAL = ("'District: ' || coalesce(district, 'None') || ' | Scope: ' || location_scope || "
           "' | Matched: [' || array_to_string(list_transform(cities, lambda x: '''' || x || "
           "''''), ', ') || ']'")
ORACLES["top_locations"] = text(RAW_CITY, f"""
(SELECT joblocation_address AS value, count(*) AS n, 'RAW' AS kind FROM {_JOIN_CITY}
  WHERE NOT {blank('joblocation_address')} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)
UNION ALL
(SELECT {_NORMAL} AS value, count(*) AS n, 'NORMALISED' AS kind FROM {_JOIN_CITY}
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)""")
_ALIASES = [(i, a, d) for i, (a, d) in enumerate(
    (a, d) for a, d in gazetteer.DISTRICT_ALIASES)]
DISTRICT = view_cte("raw_rows") + [
    values("districts", "ord, district, division",
           [(i, n, d) for i, (n, d, *_) in enumerate(gazetteer.DISTRICTS)]),
    values("aliases", "ord, alias, district", _ALIASES),
    f"""dlocs AS (SELECT DISTINCT joblocation_address AS loc, {collapse('joblocation_address')}
  AS low FROM raw_rows)""",
    """named AS (
  SELECT loc, 0 AS k, ord, district, NULL AS alias FROM dlocs, districts
  WHERE regexp_matches(low, '\\b' || regexp_escape(lower(district)) || '\\b')
  UNION ALL SELECT loc, 1, ord, district, alias FROM dlocs, aliases
  WHERE regexp_matches(low, '\\b' || regexp_escape(alias) || '\\b'))""",
    """found AS (SELECT loc, list(district ORDER BY o) AS ds FROM (SELECT loc, district,
  min(k * 1000 + ord) AS o FROM named GROUP BY 1, 2) GROUP BY 1)""",
    """district_of AS (SELECT l.loc, coalesce(len(ds), 0) AS n, ds,
  (SELECT arg_min(alias, ord) FROM named m WHERE m.loc = l.loc AND k = 1) AS locality,
  regexp_matches(low, '\\bmaharashtra\\b') AS says_state
  FROM dlocs l LEFT JOIN found f ON f.loc = l.loc)""",
    """located AS (SELECT loc, CASE WHEN n = 1 THEN ds[1] END AS district,
  CASE WHEN n > 0 OR says_state THEN 'Maharashtra' END AS state, locality,
  CASE WHEN n = 1 THEN 'SINGLE_LOCATION' WHEN n > 1 THEN 'MULTI_LOCATION' ELSE 'UNKNOWN' END
    AS location_scope, coalesce(array_to_string(ds, ' | '), '') AS matched_locations,
  CASE WHEN n > 1 THEN 'MULTI_EXPLICIT' WHEN n = 1 AND locality IS NOT NULL THEN 'CITY_MENTION'
    WHEN n = 1 THEN 'EXACT_SINGLE' WHEN says_state THEN 'AMBIGUOUS' ELSE 'UNKNOWN' END
    AS location_evidence_level,
  CASE WHEN n > 1 OR (n = 1 AND locality IS NOT NULL) THEN 'MEDIUM' WHEN n = 1 THEN 'HIGH'
    WHEN says_state THEN 'LOW' ELSE 'NONE' END AS location_confidence FROM district_of)""",
]
ORACLES["locations_district"] = text(DISTRICT, """SELECT row_key, d.division, l.* EXCLUDE (loc)
  FROM raw_rows r LEFT JOIN located l ON l.loc IS NOT DISTINCT FROM r.joblocation_address
  LEFT JOIN districts d ON d.district = l.district""")
ORACLES["divisions"] = text(DISTRICT, """SELECT division, count(*) AS district_count,
  string_agg(district, ', ' ORDER BY ord) AS districts, any_value(c.postings) AS postings
  FROM districts LEFT JOIN (SELECT division, count(*) AS postings FROM raw_rows r JOIN located l
    ON l.loc = r.joblocation_address JOIN districts d ON d.district = l.district GROUP BY 1) c
  USING (division) GROUP BY 1""")

# --- profiles ----------------------------------------------------------------------------

RAW = view_cte("raw_rows")
_RAW_COLUMNS = ("jobtitle", "company", "joblocation_address", "industry", "jobdescription",
                "postdate", "jobid", "uniq_id", "numberofpositions", "skills", "priority")
ORACLES["column_profile"] = text(RAW, " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count,
  CAST(round_even(100.0::DOUBLE * count(*) FILTER (WHERE {c} IS NULL) / count(*), 4) AS DOUBLE)
    AS null_percentage, count(DISTINCT {c}) AS unique_count,
  coalesce(array_to_string(list_sort(list(DISTINCT {c}))[1:5], ' | '), '') AS example_values
  FROM raw_rows""" for c in _RAW_COLUMNS))
ORACLES["duplicate_counts"] = text(RAW, f"""
SELECT 'row' AS scope, (SELECT count(*) FROM raw_rows) - (SELECT count(*) FROM (SELECT DISTINCT
  {', '.join(_RAW_COLUMNS)} FROM raw_rows)) AS duplicates
UNION ALL SELECT 'jobid', count(*) - (SELECT count(*) FROM (SELECT DISTINCT jobid FROM raw_rows))
  FROM raw_rows
UNION ALL SELECT 'uniq_id', count(*) - (SELECT count(*) FROM (SELECT DISTINCT uniq_id FROM
  raw_rows)) FROM raw_rows""")
_PUNE = "lower(coalesce(joblocation_address, '')) LIKE '%pune%'"
ORACLES["subset_profile"] = text(RAW, f"""SELECT count(*) AS record_count,
  count(DISTINCT company) AS distinct_companies, count(DISTINCT jobtitle)
  AS distinct_job_titles, min({posting_day('postdate')}) AS earliest,
  max({posting_day('postdate')}) AS latest FROM raw_rows WHERE {_PUNE}""")
ORACLES["subset_top_values"] = text(RAW, " UNION ALL ".join(
    f"""(SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM raw_rows WHERE {_PUNE}
  AND {c} IS NOT NULL GROUP BY 2 ORDER BY n DESC, value LIMIT 10)"""
    for c in ("joblocation_address", "industry")))
ORACLES["posting_stats"] = text(POSTINGS, """
SELECT 'TOTAL' AS measure, 'total' AS key, count(*) AS postings FROM postings
UNION ALL SELECT 'TOTAL', 'with_district', count(*) FROM postings WHERE district <> ''
UNION ALL SELECT 'TOTAL', 'without_district', count(*) FROM postings
  WHERE coalesce(district, '') = ''
UNION ALL SELECT 'DISTRICT', district, count(*) FROM postings WHERE district <> '' GROUP BY 2
UNION ALL SELECT 'SOURCE', source_id, count(*) FROM postings GROUP BY 2""")

# --- search ------------------------------------------------------------------------------


def any_token(expr: str, tokens: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{t}')" for t in tokens) + ")"


_TEXT = "lower(coalesce(job_title, '') || ' ' || coalesce(description, ''))"
_DEMAND_TEXT = "lower(district || ' ' || occupation_id || ' ' || id)"
_DEMAND_RECORD = """SELECT 'DISTRICT_OCCUPATION_DEMAND' AS record_type, id AS record_id,
  district || ' — ' || occupation_id AS title, 'job_count=' || job_count ||
  ', apprenticeship_count=' || apprenticeship_count AS snippet, district,
  NULL::VARCHAR AS source_id, observation_period_start || ' to ' || observation_period_end
  AS observation_period, 0.3::DOUBLE AS score FROM demand"""
ORACLES["keyword_search"] = text(DEMAND, f"""SELECT * EXCLUDE (r) FROM (
SELECT 1 AS r, 'JOB_POSTING' AS record_type, posting_id AS record_id, job_title AS title,
  substr(coalesce(description, ''), 1, 200) AS snippet, district, source_id,
  CAST(CAST(retrieved_at AS DATE) AS VARCHAR) AS observation_period, 0.5::DOUBLE AS score
FROM postings WHERE district = 'Pune' AND {any_token(_TEXT, ('kafka', 'pipelines', 'auto'))}
UNION ALL SELECT 3, * FROM ({_DEMAND_RECORD} WHERE district = 'Pune' AND
  {any_token(_DEMAND_TEXT, ('kafka', 'pipelines', 'auto'))}))
ORDER BY r, record_id, title LIMIT 50""")
ORACLES["keyword_matches"] = text(POSTINGS, f"""SELECT source_id, count(*) AS matches
  FROM postings WHERE {any_token(_TEXT, ('kafka', 'mysql'))} GROUP BY 1""")
ORACLES["record_union"] = text(
    DEMAND + evidence(PLAIN), f"""
SELECT 'JOB_POSTING' AS record_type, count(*) AS records FROM postings
  WHERE {any_token(_TEXT, ('java', 'painter'))}
UNION ALL SELECT 'SKILL_EVIDENCE', count(*) FROM evidence WHERE
  {any_token("lower(skill_name || ' ' || source_skill_text || ' ' || evidence_text)",
             ('java', 'painter'))}
UNION ALL SELECT * FROM (SELECT 'DISTRICT_OCCUPATION_DEMAND', count(*) AS n FROM demand WHERE
  {any_token(_DEMAND_TEXT, ('java', 'painter'))}) WHERE n > 0""")
ORACLES["page"] = text(POSTINGS, """SELECT posting_id, job_title, employer_name, district, sector,
  source_id FROM postings WHERE job_title ILIKE '%operator%' AND source_id = '2-HIGH'
  ORDER BY retrieved_at DESC, posting_id LIMIT 25 OFFSET 50""")

ORACLES["dedup_indexed"] = ORACLES["dedup_incremental"]

ORACLES["page_deep"] = text(POSTINGS, """SELECT posting_id, job_title, employer_name, district, sector,
  source_id FROM postings ORDER BY retrieved_at DESC, posting_id LIMIT 25 OFFSET 5000""")
ORACLES["keyword_matches_indexed"] = ORACLES["keyword_matches"]
ORACLES["document_search_indexed"] = text(view_cte("texts"), f"""SELECT posting_id, source_id
  FROM texts WHERE {any_token("lower(coalesce(description, ''))", ('copyright', 'licensed', '2abc'))}""")

ORACLES["demand_run"] = f"""WITH counters AS ({ORACLES["demand_run_counters"]}),
stored AS (SELECT count(*) AS n, count(DISTINCT run_id) AS runs FROM ({ORACLES["district_demand"]}))
SELECT run, 'mvp-v1-no-score' AS rule_version, '1995-01-01' AS period_start, '2024-12-31' AS period_end,
  counters.*, CASE run WHEN 1 THEN n ELSE 0 END AS rows_created, 0 AS rows_updated,
  CASE run WHEN 2 THEN n ELSE 0 END AS rows_skipped, CASE run WHEN 1 THEN runs ELSE 0 END AS runs_created
FROM counters, stored, (VALUES (1), (2)) AS two(run)"""
ORACLES["demand_run_rows"] = ORACLES["demand_for_period"]

# --- continuous ingest -------------------------------------------------------------------

# What is delivered again was seen within the horizon of its last sighting.
ORACLES["continuous_ingest"] = """WITH ordered AS (SELECT event_id, day(ts) >= 25 AS again, ts - lag(ts)
  OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS gap FROM events),
judged AS (SELECT event_id, CASE WHEN gap IS NULL OR gap > INTERVAL 2 DAY THEN 'STAGED'
  ELSE 'DUPLICATE' END AS disposition FROM ordered
  UNION ALL SELECT event_id, 'DUPLICATE' FROM ordered WHERE again)
SELECT event_id, disposition, count(*) AS deliveries FROM judged GROUP BY 1, 2"""

# --- stored facts ------------------------------------------------------------------------

ORACLES["stored_facts"] = """SELECT o_orderkey, o_orderstatus, o_totalprice,
  substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 2) AS identity_prefix,
  CASE WHEN o_orderstatus = 'O' THEN 'INSERTED' WHEN o_orderstatus = 'P' AND
    o_totalprice / 2 <> o_totalprice THEN 'UPDATED' ELSE 'SKIPPED' END AS outcome FROM orders"""

# --- coverage and ontology ---------------------------------------------------------------

BEFORE = SkillDictionary.build(seeds.SKILLS[:8])


def _renamed(ctes: list[str], prefix: str) -> list[str]:
    """The same CTE chain under other names, so that two runs fit in one statement."""
    import re

    names = ("phrases", "segment_phrases", "scoped", "segs", "texts_seen", "hits", "kept",
             "firsts", "evidence_rows", "evidence", "unmatched", "known", "noise", "found",
             "probe", "cand")
    pattern = re.compile(r"(?<![\w.'])(" + "|".join(names) + r")(?=\b)(?!')")
    return [pattern.sub(rf"{prefix}\1", c) for c in ctes]


def per_skill(prefix: str, skills, name: str) -> list[str]:
    dim = values(f"{name}_dim", "skill_id, skill_name",
                 [(s.skill_id, s.skill_name) for s in skills])
    return [dim, f"""{name} AS (SELECT d.skill_id, d.skill_name,
  count(DISTINCT e.posting_id) AS jobs, count(e.posting_id) AS mentions FROM {name}_dim d
  LEFT JOIN {prefix}evidence e ON e.skill_id = d.skill_id GROUP BY 1, 2)"""]


RUNS = (
    POSTINGS + _renamed(evidence(BEFORE) + [UNMATCHED], "b_")
    + _renamed(evidence(PLAIN) + [UNMATCHED], "a_")
    + per_skill("b_", seeds.SKILLS[:8], "before_run") + per_skill("a_", seeds.SKILLS, "after_run")
)
ORACLES["coverage_compare"] = text(RUNS, """SELECT skill_id,
  coalesce(a.skill_name, b.skill_name) AS skill_name, coalesce(b.jobs, 0) AS before_job_count,
  coalesce(a.jobs, 0) AS after_job_count, coalesce(b.mentions, 0) AS before_mention_count,
  coalesce(a.mentions, 0) AS after_mention_count,
  CASE WHEN coalesce(b.jobs, 0) = 0 AND coalesce(a.jobs, 0) > 0 THEN 'NEWLY_COVERED'
    WHEN coalesce(b.jobs, 0) > 0 AND coalesce(a.jobs, 0) = 0 THEN 'LOST_COVERAGE'
    WHEN coalesce(a.jobs, 0) = 0 THEN 'NEVER_OBSERVED' ELSE 'COVERED' END AS coverage_status
FROM before_run b FULL JOIN after_run a USING (skill_id)""")


def _metric(name: str, template: str) -> str:
    b = template.replace("$", "b_").replace("@", "before_run")
    a = template.replace("$", "a_").replace("@", "after_run")
    return f"SELECT '{name}' AS metric, ({b}) AS before, ({a}) AS after"


_METRICS = {
    "canonical_seed_count": "SELECT count(*) FROM @",
    "skills_with_evidence": "SELECT count(*) FROM @ WHERE jobs > 0",
    "jobs_processed": "SELECT count(*) FROM $scoped",
    "total_evidence_rows": "SELECT count(*) FROM $evidence",
    "jobs_with_skill_evidence": "SELECT count(DISTINCT posting_id) FROM $evidence",
    "matched_mentions": "SELECT count(*) FROM $evidence",
    "text_matched_mentions": "SELECT count(*) FROM $evidence WHERE field_rank > 1",
    "unmatched_mentions": "SELECT count(*) FROM $unmatched",
    "total_mentions_observed":
        "SELECT (SELECT count(*) FROM $evidence) + (SELECT count(*) FROM $unmatched)",
    "mention_confidence_high": "SELECT count(*) FROM $evidence WHERE confidence = 'HIGH'",
    "mention_confidence_medium": "SELECT count(*) FROM $evidence WHERE confidence = 'MEDIUM'",
}
ORACLES["coverage_metrics"] = text(
    RUNS + ["m AS (" + " UNION ALL ".join(_metric(n, t) for n, t in _METRICS.items()) + ")"],
    """SELECT metric, before, after, after - before AS delta,
  CAST(round_even(100.0::DOUBLE * (after - before) / greatest(before, 1), 2) AS DOUBLE)
    AS pct_change FROM m""")
ORACLES["coverage_absorbed"] = text(
    POSTINGS + _renamed(probe(BEFORE, 5) + [CANDIDATES], "b_")
    + _renamed(probe(PLAIN, 5) + [CANDIDATES], "a_"),
    """SELECT DISTINCT candidate_skill FROM b_cand WHERE candidate_skill NOT IN
  (SELECT candidate_skill FROM a_cand) AND candidate_skill IN (SELECT phrase FROM a_known)""")
ORACLES["coverage_percent"] = text(
    POSTINGS + evidence(COMMON) + [skill_dim()], """SELECT
  count(*) FILTER (WHERE jobs > 0) AS skills_with_evidence, count(*) AS canonical_seed_count,
  CAST(round_even(100.0::DOUBLE * count(*) FILTER (WHERE jobs > 0) / count(*), 1) AS DOUBLE)
    AS coverage_pct
  FROM (SELECT d.skill_id, count(e.posting_id) AS jobs FROM skill_dim d LEFT JOIN evidence e
    USING (skill_id) GROUP BY 1)""")
ORACLES["ontology_checks"] = text(view_cte("institute_trades") + [
    """entities AS (SELECT DISTINCT CASE trade WHEN 'Machinist' THEN '' ELSE trade END AS skill_id,
  CASE intake WHEN 'n/a' THEN 'VERIFIED' ELSE 'NEEDS_REVIEW' END AS status
  FROM institute_trades)""",
    """mappings AS (SELECT trade, CASE trade WHEN 'Basic Cosmetology' THEN 'SKL-GONE' ELSE trade
    END AS skill_id, CASE WHEN intake LIKE '-%' THEN 'VERIFIED' ELSE 'NEEDS_REVIEW' END AS status,
  CASE WHEN intake <> 'n/a' THEN institute_code END AS evidence FROM institute_trades)""",
], """SELECT error, count(*) AS n FROM (
  SELECT 'Skill missing skill_id' AS error FROM entities WHERE skill_id = ''
  UNION ALL SELECT 'Duplicate skill_id found: ' || skill_id FROM (SELECT skill_id, row_number()
    OVER (PARTITION BY skill_id) AS k FROM entities WHERE skill_id <> '') WHERE k > 1
  UNION ALL SELECT 'Skill ' || skill_id ||
    ' marked VERIFIED without inspected document evidence' FROM entities
    WHERE status = 'VERIFIED'
  UNION ALL SELECT 'Duplicate mapping found for trade ' || trade || ' and skill ' || skill_id
    FROM (SELECT trade, skill_id, row_number() OVER (PARTITION BY trade, skill_id) AS k
    FROM mappings) WHERE k > 1
  UNION ALL SELECT 'Mapping for ' || trade || ' missing evidence_source (provenance)'
    FROM mappings WHERE evidence IS NULL
  UNION ALL SELECT 'Mapping status must be NEEDS_REVIEW for ' || trade || ' -> ' || skill_id ||
    ' (found ' || status || ')' FROM mappings WHERE status <> 'NEEDS_REVIEW'
  UNION ALL SELECT 'Mapping references non-existent skill_id: ' || skill_id FROM mappings
    WHERE skill_id NOT IN (SELECT skill_id FROM entities)) GROUP BY 1""")
ORACLES["evidence_export"] = text(
    POSTINGS + evidence(PLAIN), """SELECT skill_id, skill_name,
  posting_id AS job_posting_id, evidence_type, confidence AS match_confidence,
  method AS extraction_method, evidence_text, district, sector, source_id,
  CAST(CAST(retrieved_at AS DATE) AS VARCHAR) AS observation_period FROM evidence""")

# --- specified measures ------------------------------------------------------------------

ORACLES["demand_score"] = text(DEMAND + [
    f"""recent AS (SELECT lower(trim(district)) AS dk, occupation_id, count(*) AS recent_jobs
  FROM postings JOIN occ ON job_title = t WHERE NOT {blank('district')} AND NOT
  {blank('sector')} AND occupation_id IS NOT NULL AND retrieved_at >= DATE '2000-01-01'
  GROUP BY 1, 2)""",
    f"""signals AS (SELECT d.district, d.occupation_id, job_count, apprenticeship_count,
  {ratio('job_count', '(SELECT max(job_count) FROM demand)', 6)} AS volume_signal,
  {ratio('coalesce(recent_jobs, 0)', 'job_count', 6)} AS recency_signal,
  {ratio('apprenticeship_count', '(SELECT max(apprenticeship_count) FROM demand)', 6)}
    AS apprenticeship_signal
  FROM demand d LEFT JOIN recent r ON r.dk = lower(trim(d.district)) AND
    r.occupation_id = d.occupation_id)"""],
    """SELECT *, CAST(round_even(100 * (coalesce(0.5::DOUBLE * volume_signal, 0) +
  coalesce(0.3::DOUBLE * recency_signal, 0) + coalesce(0.2::DOUBLE * apprenticeship_signal, 0)) /
  ((CASE WHEN volume_signal IS NOT NULL THEN 0.5::DOUBLE ELSE 0 END) +
   (CASE WHEN recency_signal IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END) +
   (CASE WHEN apprenticeship_signal IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END)), 2) AS DOUBLE)
  AS demand_score, 'score-v1' AS rule_version FROM signals""")
ORACLES["skill_weight"] = text(ALL_DEMAND, f"""SELECT skill_id, distinct_job_count,
  coalesce({ratio('distinct_job_count', '(SELECT max(distinct_job_count) FROM sd)', 6)}, 0.0)
  AS skill_demand_weight FROM sd""")
ORACLES["course_coverage"] = text(
    ALL_DEMAND + view_cte("institute_trades") + [
        values("bridge", "trade, skill_id", seeds.TRADE_SKILLS),
        """wanted AS (SELECT DISTINCT skill_id FROM bridge JOIN sd USING (skill_id)
  WHERE normalized_distinct_job_count >= 0.10)""",
        """taught AS (SELECT DISTINCT institute_code AS course, skill_id FROM institute_trades
  JOIN bridge USING (trade))""",
        "grid AS (SELECT course, skill_id FROM (SELECT DISTINCT course FROM taught), wanted)",
        """c AS (SELECT course,
  coalesce(string_agg(skill_id, ',' ORDER BY skill_id) FILTER (WHERE hit), '')
    AS covered_skills,
  coalesce(string_agg(skill_id, ',' ORDER BY skill_id) FILTER (WHERE NOT hit), '')
    AS missing_skills, count(*) FILTER (WHERE hit) AS covered_count,
  count(*) FILTER (WHERE NOT hit) AS missing_count,
  CAST(round_even(100.0::DOUBLE * count(*) FILTER (WHERE hit) / count(*), 2) AS DOUBLE)
    AS coverage_percent
  FROM (SELECT *, (course, skill_id) IN (SELECT (course, skill_id) FROM taught) AS hit FROM grid)
  GROUP BY 1)"""],
    """SELECT *, CASE WHEN coverage_percent < 50 THEN 'HIGH' WHEN coverage_percent < 80 THEN
  'MEDIUM' ELSE 'LOW' END AS gap_severity FROM c""")
ORACLES["training_actions"] = text(
    list(dict.fromkeys(GAP + DEMAND + view_cte("institute_trades"))) + [
        values("bridge2", "trade, skill_id", seeds.TRADE_SKILLS),
        values("trained", "trade, occupation_id", seeds.TRADE_OCCUPATIONS),
        """courses AS (SELECT DISTINCT institute_code AS course, skill_id FROM institute_trades
  JOIN bridge2 USING (trade))""",
        """asked AS (SELECT skill_id, demand_distinct_job_count AS jobs,
  demand_normalized_distinct_job_count AS share FROM gap
  WHERE demand_normalized_distinct_job_count >= 0.05)""",
        """work AS (SELECT occupation_id, CAST(sum(job_count) AS BIGINT) AS jobs FROM demand
  GROUP BY 1)""",
        """places AS (SELECT occupation_id, count(DISTINCT institute_code) AS n FROM
  institute_trades JOIN trained USING (trade) GROUP BY 1)"""],
    """SELECT 'CURRICULUM_REVIEW' AS action, course, NULL AS occupation_id, skill_id,
  jobs AS job_count, NULL::BIGINT AS supply_count,
  jobs || ' jobs ask for ' || skill_id || '; ' || course || ' does not cover it' AS evidence
FROM (SELECT DISTINCT course FROM courses), asked
WHERE (course, skill_id) NOT IN (SELECT (course, skill_id) FROM courses)
UNION ALL SELECT 'CAPACITY_REVIEW', NULL, occupation_id, NULL, jobs, coalesce(n, 0),
  jobs || ' jobs for ' || occupation_id || '; ' || coalesce(n, 0) || ' places train for it'
FROM work LEFT JOIN places USING (occupation_id)
WHERE jobs >= 0.05::DOUBLE * (SELECT sum(jobs) FROM work) AND coalesce(n, 0) <= 1
UNION ALL SELECT 'NEW_COURSE_EXPLORATION', NULL, NULL, skill_id, jobs, 0,
  jobs || ' jobs ask for ' || skill_id || '; no course covers it'
FROM asked WHERE share >= 0.10 AND skill_id NOT IN (SELECT skill_id FROM courses)""")
ORACLES["status_rule"] = """SELECT status, rule, count(*) AS orders FROM (SELECT
  CASE WHEN o_orderstatus = 'P' THEN 'PENDING' WHEN o_orderpriority <> '1-URGENT' THEN
    CASE WHEN o_orderdate >= DATE '1998-01-01' THEN 'ACTIVE' ELSE 'EXPIRED' END
    WHEN o_orderstatus = 'O' THEN 'ACTIVE' ELSE 'EXPIRED' END AS status,
  CASE WHEN o_orderstatus = 'P' THEN 'SOURCE_REPORTED' WHEN o_orderpriority <> '1-URGENT' THEN
    'END_DATE' ELSE 'SOURCE_TYPE' END AS rule FROM orders) GROUP BY 1, 2"""
_SKILL_RUN = f"sha256('skill-demand:mvp-v1-no-score:' || dk || ':{WINDOW[0]}:{WINDOW[1]}')"
ORACLES["district_skill_demand"] = text(
    POSTINGS + evidence(PLAIN) + [
        f"""local AS (SELECT lower(trim(district)) AS dk, min(trim(district)) AS d, count(*) AS n
  FROM postings WHERE NOT {blank('district')} GROUP BY 1)""",
        f"""found AS (SELECT lower(trim(district)) AS dk, skill_id,
  count(DISTINCT posting_id) AS jobs, count(*) AS mentions FROM evidence
  WHERE NOT {blank('district')} GROUP BY 1, 2)"""],
    f"""SELECT substr({_SKILL_RUN}, 1, 16) || '-' || dk || '-' || skill_id AS id,
  {_SKILL_RUN} AS run_id, d AS district, skill_id, NULL::VARCHAR AS sector,
  DATE '{WINDOW[0]}' AS observation_period_start, DATE '{WINDOW[1]}' AS observation_period_end,
  jobs AS distinct_job_count, mentions AS mention_count, n AS total_jobs,
  {ratio('jobs', 'n', 6)} AS normalized_count, NULL::DOUBLE AS demand_score,
  'INSUFFICIENT_DATA' AS data_completeness_status, 'DERIVED' AS provenance_state,
  'mvp-v1-no-score' AS rule_version FROM found JOIN local USING (dk)""")
ORACLES["monthly_status"] = text(POSTINGS, """SELECT CAST(date_trunc('month', posted_date) AS
  DATE) AS month, status, count(*) AS postings FROM postings GROUP BY 1, 2""")
ORACLES["sector_filter"] = text(POSTINGS, f"""SELECT sector, district, count(*) AS postings
  FROM postings WHERE sector IN ({_IT}) AND retrieved_at >= DATE '1996-05-01' AND
  retrieved_at < DATE '1996-06-01' GROUP BY 1, 2""")


# --- exports, small filters and ingest steps ------------------------------------------------

for _name, _rows in (
    ("demand", text(DEMAND, "SELECT * FROM demand")),
    ("skill_demand", text(ALL_DEMAND, "SELECT * FROM sd")), ("skill_gap", text(GAP, "SELECT * FROM gap")),
    ("skill_summary", ORACLES["skill_summary"]), ("skill_candidates", ORACLES["skill_candidates"]),
    ("ontology_review", ORACLES["ontology_review"]),
    ("sources", text(view_cte("sources"), "SELECT *, NULL::VARCHAR AS coverage FROM sources")),
    ("column_profile", ORACLES["column_profile"]), ("collision_groups", ORACLES["collision_groups"]),
    ("coverage", ORACLES["coverage_compare"]),
    ("occupations", text(DEMAND + [values(
        "dimension", "occupation_id, occupation_name, aliases, sector, source_reference, "
        "verification_status", [
            (o.occupation_id, o.occupation_name, json.dumps(list(o.aliases), separators=(",", ":")),
             o.sector, o.source_reference, o.verification_status) for o in seeds.OCCUPATIONS])],
        "SELECT * FROM dimension WHERE occupation_id IN (SELECT occupation_id FROM demand)")),
):
    ORACLES[f"{_name}_export"] = f"SELECT {', '.join(sinks.EXPORTS[_name])} FROM ({_rows})"
ORACLES["coverage_stored"] = ORACLES["coverage_compare"]
ORACLES["skill_demand_with_evidence"] = text(ALL_DEMAND, """SELECT skill_id, distinct_job_count
  FROM sd WHERE distinct_job_count > 0""")
ORACLES["skill_gap_filter"] = text(GAP, """SELECT skill_id, skill_name, gap_status FROM gap
  WHERE gap_status = 'HIGH_GAP' AND skill_name ILIKE '%java%'""")
ORACLES["page_total"] = text(POSTINGS, """SELECT count(*) AS total FROM postings
  WHERE job_title ILIKE '%operator%' AND source_id = '2-HIGH'""")
ORACLES["top_districts"] = text(DEMAND, """SELECT district, CAST(sum(job_count) AS BIGINT) AS job_count,
  CAST(sum(apprenticeship_count) AS BIGINT) AS apprenticeship_count FROM demand GROUP BY 1
  ORDER BY 2 DESC, 1 LIMIT 5""")
ORACLES["snapshot_jobs"] = text(SNAPSHOT, """SELECT job_identity_hash, district,
  experience_years_min, experience_years_max, salary_min, salary_max, posted_day FROM staged
  WHERE is_valid AND job_identity_hash NOT IN (SELECT job_identity_hash FROM staged
    WHERE is_valid AND district = 'Thane')
  QUALIFY row_number() OVER (PARTITION BY job_identity_hash ORDER BY ordinal) = 1""")
ORACLES["sources_register"] = text(view_cte("sources"), """SELECT source_id, category, access_method
  FROM sources WHERE enabled IS NOT TRUE""")
ORACLES["historical_ingest"] = f"""SELECT a.*, (SELECT count(*) FROM (
  {text(COLLISIONS, EDGES)})) AS relationships_inserted FROM ({ORACLES['ingest_accounting']}) a"""
ORACLES["institute_upsert"] = """SELECT count(*) FILTER (WHERE ok AND NOT own) AS institutes_created,
  count(*) FILTER (WHERE ok AND own) AS institutes_skipped,
  count(*) FILTER (WHERE NOT ok) AS institutes_rejected,
  2 * count(*) FILTER (WHERE ok) - count(*) FILTER (WHERE ok AND own) AS trades_created,
  count(*) FILTER (WHERE ok AND own) AS trades_skipped
FROM (SELECT s_nationkey <> 5 AS ok, s_nationkey > 3 AS own FROM supplier)"""
ORACLES["institute_rejects"] = """SELECT s_name AS institute_name,
  'district must be ''Pune'', got ''Nashik''' AS errors FROM supplier WHERE s_nationkey = 5"""
_APPRENTICE = f"""sha256(concat_ws('|', {collapse('source_id')}, {collapse('trade_title')}, '',
  {collapse('district')}, CAST(CAST(retrieved_at AS DATE) AS VARCHAR),
  CAST(CAST(retrieved_at AS DATE) AS VARCHAR)))"""
ORACLES["apprenticeship_insert"] = text(view_cte("apprenticeships"), f"""SELECT
  {_APPRENTICE} AS record_identity_hash, trade_title, district AS location_text,
  CAST(posting_id AS BIGINT) AS ordinal FROM apprenticeships WHERE trade_title <> 'Machinist'
  QUALIFY row_number() OVER (PARTITION BY {_APPRENTICE} ORDER BY CAST(posting_id AS BIGINT)) = 1""")
ORACLES["snapshot_raw_json"] = text(SNAPSHOT, """SELECT rid AS source_record_id,
  to_json({'source_record_id': rid, 'job_title': title, 'salary': salary, 'is_valid': title <> ''})
    ::VARCHAR AS raw_json, CASE WHEN title <> '' THEN 'staged' ELSE 'failed' END AS processing_status
FROM snap""")
ORACLES["source_coverage"] = text(view_cte("sources"), """SELECT source_id, source_name,
  freshness_class FROM sources""")
