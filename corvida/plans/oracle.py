"""SQL parts that several of the comparison queries share."""

from __future__ import annotations

from ..functions.text import NON_LOCATIONS, NON_ORGANIZATIONS, NON_PERSON_PARTS, ORGANIZATION_PARTS
from ..operators import extract

SPACE = r"[\s\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, {q(SPACE + '+')}, ' ', 'g'))"


def listed(values) -> str:
    return ", ".join(q(v) for v in values)


def contains_any(c: str, parts) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(p)})" for p in parts) + ")"


def classify(c: str, classes: dict) -> str:
    return "CASE " + " ".join(f"WHEN {contains_any(f'lower({c})', parts)} THEN {q(k)}" for k, parts in classes.items()) + " ELSE 'Other' END"


PERSONS = f"""
person_mentions AS (
  SELECT DISTINCT doc_id, upper({collapse('raw')}) AS entity
  FROM (SELECT doc_id, unnest(persons) AS raw FROM extracted_names WHERE doc_id IS NOT NULL)
  WHERE raw IS NOT NULL AND {collapse('raw')} <> '')"""

_UPPER = "(upper({c}) = {c} AND lower({c}) <> {c})"
NAMES = f"""
name_runs AS (SELECT DISTINCT doc_id, trim(regexp_replace({collapse('raw')}, {q("('s|')$")}, '')) AS name
              FROM (SELECT doc_id, unnest(regexp_extract_all(text, {q(extract.NAME_RUN)})) AS raw FROM documents)),
persons_found AS (SELECT DISTINCT doc_id, upper(name) AS person FROM name_runs
  WHERE NOT {contains_any('lower(name)', NON_PERSON_PARTS)} AND NOT {_UPPER.format(c='name')} AND NOT regexp_matches(name, '[0-9]')
    AND length(name) <= 50 AND length(name) >= 5 AND contains(name, ' '))"""

LOCATIONS = f"""
place_runs AS (SELECT DISTINCT doc_id, {collapse('raw')} AS location
               FROM (SELECT doc_id, unnest(regexp_extract_all(text, {q(extract.PLACE_RUN)}, 1)) AS raw FROM documents)),
locations_found AS (SELECT doc_id, location,
    CASE WHEN regexp_matches(location, {q(extract.FACILITY_PARTS)}) THEN 'FAC' WHEN regexp_matches(location, {q(extract.NATURE_PARTS)}) THEN 'LOC' ELSE 'GPE' END AS subtype
  FROM place_runs WHERE lower(location) NOT IN ({listed(NON_LOCATIONS)}) AND NOT ({_UPPER.format(c='location')} AND length(location) <= 3)
    AND NOT regexp_matches(replace(location, ' ', ''), '^[0-9]+$') AND length(location) <= 100)"""

ORGANIZATIONS = f"""
org_runs AS (SELECT DISTINCT doc_id, {collapse('raw')} AS name
             FROM (SELECT doc_id, unnest(regexp_extract_all(text, {q(extract.ORG_RUN)}, 1)) AS raw FROM documents)),
organizations_found AS (SELECT DISTINCT doc_id, name AS organization FROM org_runs
  WHERE lower(name) NOT IN ({listed(NON_ORGANIZATIONS)}) AND length(name) BETWEEN 2 AND 150
    AND NOT (length(name) > 10 AND length(regexp_replace(regexp_replace(name, '([^A-Z]|^)([A-Z])', '\\1#', 'g'), '[^A-Z]', '', 'g')) + CAST(regexp_matches(name, '^[A-Z]') AS INT) > 0.5 * length(name))
    AND NOT (regexp_matches(name, '^(?:[A-Z][a-z]+|[A-Z])\\s+(?:[A-Z][a-z]+|[A-Z])$') AND NOT {contains_any('lower(name)', ORGANIZATION_PARTS)}))"""

_ARRAYS = " || ".join(f"regexp_extract_all(text, {q('(?i)' + p)}, 1)" for p in extract.DATE_PATTERNS)
_PLAIN = f"regexp_replace({collapse('original')}, '[.,]', '', 'g')"
_MONTH = f"lower(regexp_extract({_PLAIN}, '([A-Za-z]{{3,}})', 1)[1:3])"
DATES = f"""
date_strings AS (SELECT DISTINCT doc_id, unnest({_ARRAYS}) AS original FROM documents WHERE text IS NOT NULL),
date_parts AS (SELECT doc_id, original, {_PLAIN} AS plain, replace({_PLAIN}, '-', '/') AS slashed,
  list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], {_MONTH}) AS mon FROM date_strings),
dates_parsed AS (SELECT doc_id, original, CAST(CASE
    WHEN regexp_matches(slashed, '^[0-9]{{4}}/') THEN try_strptime(slashed, '%Y/%m/%d')
    WHEN regexp_matches(slashed, '^[0-9]{{1,2}}/') THEN coalesce(try_strptime(slashed, '%m/%d/%Y'), try_strptime(slashed, '%d/%m/%Y'))
    WHEN mon > 0 THEN try_strptime(concat_ws('/', regexp_extract(plain, '\\b([0-9]{{4}})\\b', 1), mon,
      coalesce(nullif(regexp_extract(plain, '\\b([0-9]{{1,2}})\\b', 1), ''), '1')), '%Y/%m/%d') END AS DATE) AS parsed FROM date_parts),
dates_found AS (SELECT doc_id, original, parsed, CAST(year(parsed) AS INT) AS year, CAST(month(parsed) AS INT) AS month
  FROM dates_parsed WHERE year(parsed) BETWEEN {extract.MIN_YEAR} AND {extract.MAX_YEAR})"""

MENTIONS = f"""{PERSONS}, {LOCATIONS}, {ORGANIZATIONS}, {DATES},
mentions AS (SELECT doc_id, 'person' AS etype, CAST(NULL AS VARCHAR) AS subtype, entity FROM person_mentions
  UNION ALL SELECT doc_id, 'location', subtype, location FROM locations_found
  UNION ALL SELECT doc_id, 'organization', NULL, organization FROM organizations_found
  UNION ALL SELECT DISTINCT doc_id, 'year', NULL, CAST(year AS VARCHAR) FROM dates_found)"""

LINKS = f"""{MENTIONS},
freq AS (SELECT etype, entity, count(*) AS frequency FROM mentions GROUP BY 1, 2),
kept AS (SELECT DISTINCT m.doc_id, m.etype, m.entity, list_position(['person', 'organization', 'location', 'year'], m.etype) AS rank
         FROM mentions m JOIN freq f ON f.etype = m.etype AND f.entity = m.entity WHERE f.frequency >= 3 OR m.etype = 'year'),
links AS (SELECT a.etype || '_' || b.etype AS relationship, a.entity AS entity_a, b.entity AS entity_b, count(*) AS cooccurrences
          FROM kept a JOIN kept b ON a.doc_id = b.doc_id AND a.rank < b.rank GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""


def cooccurrence(etype: str, min_freq: int, min_weight: int, name: str = "edges", source: str = "mentions") -> str:
    return f"""
{name}_own AS (SELECT DISTINCT doc_id, entity FROM {source} {f"WHERE etype = {q(etype)}" if source == 'mentions' else ''}),
{name}_kept AS (SELECT * FROM {name}_own WHERE entity IN (SELECT entity FROM {name}_own GROUP BY 1 HAVING count(*) >= {min_freq})),
{name} AS (SELECT a.entity AS entity_a, b.entity AS entity_b, count(*) AS weight FROM {name}_kept a JOIN {name}_kept b
           ON a.doc_id = b.doc_id AND a.entity < b.entity GROUP BY 1, 2 HAVING count(*) >= {min_weight})"""
