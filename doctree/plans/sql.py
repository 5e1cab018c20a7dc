"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

from doctree import schema

K = "corpus_id, version_id"


def values(rows: list[tuple], names: str) -> str:
    cell = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names}))"


PARENT = r"""CASE doc_type WHEN 'Needed Research' THEN NULL
  WHEN 'Scenario Variation' THEN CASE WHEN regexp_matches(doc_no, '.\.var\d+$') THEN regexp_replace(doc_no, '\.var\d+$', '') END
  WHEN 'Annotation' THEN CASE WHEN regexp_matches(doc_no, '.\.0\.3\.\d+$') THEN regexp_replace(doc_no, '\.0\.3\.\d+$', '') END
  WHEN 'Action Tenet' THEN CASE WHEN regexp_matches(doc_no, '.\.0\.4\.\d+$') THEN regexp_replace(doc_no, '\.0\.4\.\d+$', '') END
  WHEN 'Scenario' THEN CASE WHEN regexp_matches(doc_no, '.\.1\.\d+$') THEN regexp_replace(doc_no, '\.1\.\d+$', '') END
  WHEN 'Active Data' THEN CASE WHEN regexp_matches(doc_no, '.\.0\.6\.\d+$') THEN regexp_replace(doc_no, '\.0\.6\.\d+$', '') END
  ELSE CASE WHEN len(string_split(doc_no, '.')) > 2 THEN array_to_string(string_split(doc_no, '.')[1:-2], '.') END END"""
#: For well-formed numbers: segments of the part without supporting suffixes, and the suffixes.
DEPTH = r"""CASE WHEN doc_type = 'Needed Research' THEN NULL ELSE
  len(string_split(CASE WHEN doc_type IN ('Annotation', 'Action Tenet', 'Active Data', 'Scenario', 'Scenario Variation') THEN regexp_replace(doc_no, '\.0\.[346]\.\d+(\.1\.\d+)?(\.var\d+)?$', '') ELSE doc_no END, '.')) - 1
  + CASE doc_type WHEN 'Annotation' THEN 1 WHEN 'Action Tenet' THEN 1 WHEN 'Active Data' THEN 1 WHEN 'Scenario' THEN 2 WHEN 'Scenario Variation' THEN 3 ELSE 0 END END"""
#: up: every proper prefix of every number; anc: those that are documents.
UP = f"""up AS (SELECT {K}, doc_no, array_to_string(p[1:i], '.') AS ancestor_no, len(p) - i AS distance
    FROM (SELECT {K}, doc_no, string_split(doc_no, '.') AS p, unnest(generate_series(1, len(string_split(doc_no, '.')) - 1)) AS i FROM docs)),
  anc AS (SELECT up.*, d.uuid AS ancestor_uuid FROM up JOIN docs d ON d.corpus_id = up.corpus_id AND d.version_id = up.version_id AND d.doc_no = up.ancestor_no)"""
TYPES = values(list(schema.TYPE_DATABASE.items()), "doc_type, database")
_ORDER = list(schema.COLLECTIONS)
ALLOWED = values([(db, schema.COLLECTIONS[c], c, _ORDER.index(c)) for db, found in schema.ALLOWED_COLLECTIONS.items() for c in found], "parent_database, database, collection, collection_ord")
DBS = f"""agent AS (SELECT DISTINCT up.{K.replace(', ', ', up.')}, up.doc_no FROM up JOIN docs d USING ({K}, doc_no)
    JOIN docs s ON s.corpus_id = up.corpus_id AND s.version_id = up.version_id AND s.doc_no = up.ancestor_no
    WHERE s.name = '{schema.AGENT_ROOT_NAME}' AND d.doc_type IN ('Core', 'Active Data Controller')),
  dbs AS (SELECT d.{K.replace(', ', ', d.')}, d.doc_no, d.doc_type, CASE WHEN a.doc_no IS NOT NULL THEN '{schema.AGENT_DATABASE}' ELSE t.database END AS database
    FROM docs d LEFT JOIN agent a USING ({K}, doc_no) LEFT JOIN {TYPES} t USING (doc_type))"""
#: Siblings in order of their last number, after what stands before it.
SIBLING = r"""list_transform(string_split(regexp_replace(doc_no, '^NR-', 'NR.'), '.'), lambda s: {'k': CASE WHEN regexp_full_match(s, '\d+') THEN 0 ELSE 1 END, 'n': {'l': length(ltrim(regexp_extract(s, '^\d+$'), '0')), 'd': ltrim(regexp_extract(s, '^\d+$'), '0')}, 's': s})"""
#: Research notes with the number that their targets lead to, and the keys of the notes on the way and their own.
CHAIN = f"""note AS (SELECT DISTINCT {K}, doc_no, target_no, {{'k': -1, 'n': {{'l': length(ltrim(substr(doc_no, 4), '0')), 'd': ltrim(substr(doc_no, 4), '0')}}, 's': doc_no}} AS own FROM docs WHERE doc_type = 'Needed Research'),
  climb(corpus_id, version_id, doc_no, up, chain) AS (
    SELECT {K}, doc_no, target_no, [own] FROM note
    UNION ALL SELECT c.corpus_id, c.version_id, c.doc_no, n.target_no, list_prepend(n.own, c.chain) FROM climb c JOIN note n ON n.corpus_id = c.corpus_id AND n.version_id = c.version_id AND n.doc_no = c.up),
  chain AS MATERIALIZED (
    SELECT {K}, doc_no, up AS root_no, chain FROM climb c
    WHERE NOT EXISTS (SELECT 1 FROM note n WHERE n.corpus_id = c.corpus_id AND n.version_id = c.version_id AND n.doc_no = c.up))"""
EDGES = f"""{CHAIN},
  par AS (SELECT {K}, doc_no AS parent_no, min(database) AS parent_database, true AS there FROM dbs WHERE doc_type <> 'Needed Research' GROUP BY {K}, doc_no),
  asked AS (
    SELECT DISTINCT {K}, doc_no, database, {PARENT} AS parent_no, false AS note FROM dbs WHERE doc_type <> 'Needed Research' AND {PARENT} IS NOT NULL
    UNION ALL SELECT {K}, doc_no, 'Needed Research', root_no, true FROM chain),
  told AS (SELECT asked.*, par.parent_database, par.there FROM asked LEFT JOIN par USING ({K}, parent_no)),
  above AS (
    SELECT t.corpus_id, t.version_id, t.doc_no, t.database, max({{'i': i, 'n': par.parent_no, 'd': par.parent_database}}) AS p
    FROM (SELECT *, string_split(parent_no, '.') AS p, unnest(generate_series(1, len(string_split(parent_no, '.')) - 1)) AS i FROM told WHERE there IS NULL AND NOT note) t
    JOIN par ON par.corpus_id = t.corpus_id AND par.version_id = t.version_id AND par.parent_no = array_to_string(t.p[1:i], '.') GROUP BY ALL),
  kid AS (
    SELECT {K}, doc_no, database, parent_no, parent_database FROM told WHERE there
    UNION ALL SELECT {K}, doc_no, database, p.n, p.d FROM above),
  edges AS MATERIALIZED (SELECT kid.*, a.collection, a.collection_ord,
      row_number() OVER (PARTITION BY {K}, kid.parent_no, a.collection ORDER BY {SIBLING.replace('doc_no', 'kid.doc_no')}) AS sibling_ord
    FROM kid LEFT JOIN {ALLOWED} a ON a.parent_database = kid.parent_database AND a.database = kid.database)"""
#: Paths of JSON nodes, and the key of the order of export.
PATHS = f"""rooted AS (SELECT d.corpus_id, d.version_id, d.doc_no, row_number() OVER (PARTITION BY d.corpus_id, d.version_id ORDER BY {SIBLING.replace('doc_no', 'd.doc_no')}, d.doc_no) AS r
    FROM docs d ANTI JOIN edges e ON e.corpus_id = d.corpus_id AND e.version_id = d.version_id AND e.doc_no = d.doc_no),
  tree(corpus_id, version_id, doc_no, path, key) AS (
    SELECT {K}, doc_no, '$.' || (r - 1), [r * 100000] FROM rooted
    UNION ALL SELECT e.corpus_id, e.version_id, e.doc_no, t.path || '.' || coalesce(e.collection, 'unmapped') || '.' || (e.sibling_ord - 1), list_append(t.key, coalesce(e.collection_ord, 99) * 100000 + e.sibling_ord)
    FROM tree t JOIN edges e ON e.corpus_id = t.corpus_id AND e.version_id = t.version_id AND e.parent_no = t.doc_no)"""
#: The key of reading order, for numbers whose documents' parents may be missing folders.
EMIT_KEYS = f"""plain AS (SELECT * FROM docs WHERE doc_type <> 'Needed Research'),
  stp AS (SELECT {K}, doc_no, i, p[i] AS s, array_to_string(p[1:i], '.') AS no FROM (SELECT {K}, doc_no, string_split(doc_no, '.') AS p, unnest(generate_series(1, len(string_split(doc_no, '.')))) AS i FROM (SELECT DISTINCT {K}, doc_no FROM plain))),
  ekey AS (SELECT stp.corpus_id, stp.version_id, stp.doc_no, list({{'k': CASE WHEN NOT regexp_full_match(s, '\\d+') THEN 2 WHEN t.no IS NOT NULL THEN 0 ELSE 1 END,
      'n': {{'l': length(ltrim(regexp_extract(s, '^\\d+$'), '0')), 'd': ltrim(regexp_extract(s, '^\\d+$'), '0')}}, 's': s}} ORDER BY i) AS key
    FROM stp LEFT JOIN (SELECT DISTINCT {K}, doc_no AS no FROM plain) t ON t.corpus_id = stp.corpus_id AND t.version_id = stp.version_id AND t.no = stp.no GROUP BY stp.corpus_id, stp.version_id, stp.doc_no),
  akey AS (SELECT * FROM ekey UNION ALL SELECT c.corpus_id, c.version_id, c.doc_no, list_concat(coalesce(t.key, [{{'k': 9, 'n': {{'l': CAST(0 AS BIGINT), 'd': ''}}, 's': ''}}]), c.chain)
    FROM chain c LEFT JOIN ekey t ON t.corpus_id = c.corpus_id AND t.version_id = c.version_id AND t.doc_no = c.root_no),
  pos AS MATERIALIZED (SELECT {K}, doc_no, row_number() OVER (PARTITION BY {K} ORDER BY key, doc_no) AS position FROM akey)"""
EMIT = f"{CHAIN}, {EMIT_KEYS}"
#: Documents with their heading level, and their blocks of text in reading order.
LEV = f"""{CHAIN}, tgt AS (SELECT {K}, doc_no AS tno, least(6, greatest(1, {DEPTH})) AS tl FROM docs WHERE doc_type <> 'Needed Research'),
  lev AS (SELECT d.*, CASE WHEN d.doc_type = 'Needed Research' THEN coalesce(least(6, tl + len(chain.chain)), 6) ELSE least(6, greatest(1, {DEPTH.replace('doc_no', 'd.doc_no').replace('doc_type', 'd.doc_type')})) END AS level
    FROM docs d LEFT JOIN chain ON chain.corpus_id = d.corpus_id AND chain.version_id = d.version_id AND chain.doc_no = d.doc_no AND d.doc_type = 'Needed Research'
    LEFT JOIN tgt ON tgt.corpus_id = d.corpus_id AND tgt.version_id = d.version_id AND tgt.tno = chain.root_no)"""
BLOCKS = f"""{LEV}, {EMIT_KEYS}, blk AS (SELECT lev.*, position, repeat('#', level) || ' ' || doc_no || ' - ' || name || ' [' || doc_type || ']  <!-- UUID: ' || coalesce(uuid, '') || ' -->' AS title FROM lev JOIN pos USING ({K}, doc_no)),
  block AS (SELECT *, title || chr(10) || CASE WHEN coalesce(body, '') <> '' THEN chr(10) || body || chr(10) ELSE '' END AS block FROM blk)"""
TRIM = r"regexp_replace(regexp_replace(coalesce(body, ''), '\A([ \t\r\f\v]*\n)+', ''), '(\n[ \t\r\f\v]*)+\z', '')"
#: Each uuid's last document in reading order.
LAST_UUID = f"last_uuid AS (SELECT docs.corpus_id, docs.version_id, uuid, arg_max(doc_no, (key, doc_no)) AS doc_no FROM docs JOIN (SELECT DISTINCT * FROM akey) a USING ({K}, doc_no) WHERE uuid <> '' GROUP BY ALL)"
