"""SQL twin of hybrid retrieval, stage by stage and by brute force."""

from __future__ import annotations

from checks.tables import CHUNKS, arr, lit, search_norm, search_tokens, sentences, strip
from foliant.functions import lists as L

ASCII_WORDS = r"regexp_replace({x}, '[^\x00-\x7F]', '_', 'g')"

QUERY_SETS = {
    "plain": "q AS (SELECT item_id AS query_id, text AS query FROM benchmark)",
    "mixed": r"""
q AS (
  SELECT item_id * 3 + kind AS query_id,
    CASE kind WHEN 0 THEN text WHEN 1 THEN '"' || replace(text, '"', '') || '"'
      ELSE 'Who is ' || regexp_extract(text, '[A-Z][a-z]+') || ' and what is the role of ' || regexp_extract(text, '[A-Z][a-z]+') || ' here?' END AS query
  FROM benchmark, (SELECT unnest([0, 1, 2]) AS kind))""",
}


def ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def any_of(x: str, values) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(v)})" for v in values) + ")"


def entity_words(x: str) -> str:
    found = rf"regexp_extract_all({ASCII_WORDS.format(x=x)}, '\b[A-Z][a-z'']{{2,}}\b')"
    return (f"list_filter({found}, lambda w: NOT list_contains({arr(L.SEARCH_STOPWORDS)}, "
            f"regexp_replace(trim(lower(w), ''''), '''s$', '')))")


def flags(x: str) -> tuple[str, str, str]:
    role = any_of(f"lower({x})", L.ROLE_QUERY_WORDS)
    entities = f"len({entity_words(x)}) > 0"
    starts = "(" + " OR ".join(f"starts_with(lower({strip(x)}), {lit(s)})" for s in L.ENTITY_QUESTION_STARTS) + ")"
    multi = (f"({any_of(f'lower({x})', L.MULTI_PART_JOINTS + L.MULTI_PART_NOUNS)} OR "
             f"(contains(lower({x}), ' and ') AND len({search_tokens(search_norm(x))}) >= 10))")
    return multi, f"({starts} OR ({role} AND {entities}))", role


def features(name: str, source: str, keys: str, text: str, single: bool) -> str:
    """CTEs name (flags), name_v (variants), name_t (classified terms), name_x (terms of each variant), name_p (phrases)."""
    multi, described, role = flags("query")
    synonyms = ", ".join(f"({lit(k)}, {lit(v)})" for k, s in L.QUERY_SYNONYMS.items() for v in s.split())
    cues = [("role", L.ROLE_CUES + L.ROLE_QUERY_EXTRA.split()),
            ("description", L.DESCRIPTION_CUES + L.DESCRIPTION_QUERY_EXTRA.split())]
    cues += [(any_of("lower(query)", hints), terms.split()) for hints, terms in L.QUERY_CUE_EXPANSIONS]
    cue_rows = "\nUNION ALL ".join(f"SELECT {keys}, unnest({arr(terms)}) AS term FROM {name} WHERE {test}" for test, terms in cues)
    subject = "trim(array_to_string(words[1:2], ' '))"
    parts = (r"list_filter(list_transform(regexp_split_to_array(query, '(?i)\s+and\s+'), lambda p: trim(p, ' ,.?')), "
             "lambda p: length(p) > 0)")
    with_subject = (f"flatten(list_transform({parts}, lambda p: CASE WHEN {subject} <> '' AND NOT contains(lower(p), lower({subject})) "
                    f"THEN [p, {subject} || ' ' || p] ELSE [p] END))")
    all_variants = (f"list_concat(list_concat([{strip('query')}], CASE WHEN multi_part THEN {with_subject} ELSE [] END), "
                    f"CASE WHEN description AND {subject} <> '' THEN CASE WHEN role THEN [{subject}, {subject} || ' responsibilities', "
                    f"{subject} || ' role in the house'] ELSE [{subject}] END ELSE [] END)")
    variants = "[query]" if single else "list_filter(list_filter(vs, lambda e, i: list_position(vs, e) = i), lambda v: length(v) > 0)"
    phrases = ("[]::VARCHAR[]" if single else
               f"list_filter(list_concat(regexp_extract_all(query, '\"([^\"]{{8,}})\"', 1), list_filter(regexp_extract_all(query, "
               f"'''([^'']{{8,}})''', 1), lambda p: length(p) - length(replace(p, ' ', '')) >= 2)), lambda p: length(trim(p)) > 0)")
    return f"""
{name}_0 AS (SELECT {keys}, {text} AS query FROM {source}),
{name}_1 AS (SELECT *, {entity_words('query')} AS words, {multi} AS multi_part, {described} AS description, {role} AS role FROM {name}_0),
{name}_2 AS (SELECT *, {'[query]' if single else all_variants} AS vs FROM {name}_1),
{name} AS (SELECT {keys}, query, words, multi_part, description, role, {variants} AS variants,
  list_distinct(list_transform({phrases}, lambda p: {search_norm('p')})) AS phrases FROM {name}_2),
{name}_v AS (SELECT {keys}, CAST(i AS INTEGER) AS vno, variants[i + 1] AS variant FROM (
  SELECT {keys}, variants, unnest(range(len(variants))) AS i FROM {name})),
{name}_x AS (SELECT DISTINCT {keys}, vno, unnest({search_tokens(search_norm('variant'))}) AS term FROM {name}_v),
{name}_d AS (SELECT DISTINCT {keys}, term FROM {name}_x),
{name}_syn(term, other) AS (VALUES {synonyms}),
{name}_e AS (SELECT DISTINCT {keys}, term FROM (
  SELECT {keys}, other AS term FROM {name}_d JOIN {name}_syn USING (term) UNION ALL {cue_rows})
  WHERE length(term) > 1 AND NOT list_contains({arr(L.SEARCH_STOPWORDS)}, term) AND ({keys}, term) NOT IN (SELECT ({keys}, term) FROM {name}_d)),
{name}_n AS (SELECT DISTINCT {keys}, regexp_replace(trim(lower(w), ''''), '''s$', '') AS term FROM (SELECT {keys}, unnest(words) AS w FROM {name})),
{name}_t AS (SELECT {keys}, term, bool_or(c = 'd') AS is_direct, bool_or(c = 'e') AS is_expanded, bool_or(c = 'n') AS is_entity FROM (
  SELECT *, 'd' AS c FROM {name}_d UNION ALL SELECT *, 'e' FROM {name}_e UNION ALL SELECT *, 'n' FROM {name}_n) GROUP BY ALL),
{name}_p AS (SELECT DISTINCT {keys}, unnest(phrases) AS phrase FROM {name})""".replace(f"({keys}, term) NOT IN (SELECT ({keys}, term)", f"({keys}, term) NOT IN (SELECT ({keys}, term)")


def scores(p: str, feat: str, keys: list[str], units: str, unit: list[str], weights: str) -> str:
    """CTE p: score and hits of every (query, unit); units carry their query when 'query_id' is a unit key."""
    both = keys + [u for u in unit if u not in keys]
    shared = [u for u in unit if u in keys]
    on = ", ".join(["term", *shared])
    cols = ", ".join(both)
    u = ", ".join(unit)
    phrase_on = " AND ".join(["contains(norm, phrase)", *[f"{units}.{s} = {feat}_p.{s}" for s in shared]])
    phrase_cols = ", ".join([f"{feat}_p.{k}" if k in shared else k for k in keys] + [x for x in unit if x not in keys])
    return f"""
{p}_ut AS (SELECT {u}, unnest(list_distinct(tokens)) AS term FROM {units}),
{p}_m AS (SELECT {cols}, sum(CASE WHEN is_direct THEN weight ELSE 0 END) AS ds, sum(CASE WHEN is_expanded THEN weight ELSE 0 END) AS xs,
  sum(CASE WHEN is_entity THEN weight ELSE 0 END) AS es, count(*) FILTER (is_direct) AS dn, count(*) FILTER (is_expanded) AS xn,
  count(*) FILTER (is_entity) AS en FROM {p}_ut JOIN {feat}_t USING ({on}) JOIN {weights} USING ({', '.join(['term', *[k for k in keys if weights.endswith('local')]])}) GROUP BY {cols}),
{p}_vn AS (SELECT {cols}, count(DISTINCT vno) AS vn FROM {p}_ut JOIN {feat}_x USING ({on}) GROUP BY {cols}),
{p}_ph AS (SELECT {phrase_cols}, count(DISTINCT phrase) AS ph FROM {units} JOIN {feat}_p ON {phrase_on} WHERE len(tokens) > 0 GROUP BY {phrase_cols}),
{p}_a AS (SELECT {cols}, coalesce(ds, 0) AS ds, coalesce(xs, 0) AS xs, coalesce(es, 0) AS es, coalesce(dn, 0) AS dn, coalesce(xn, 0) AS xn,
  coalesce(en, 0) AS en, coalesce(ph, 0) AS ph FROM {p}_m FULL JOIN {p}_ph USING ({cols})),
{p}_b AS (SELECT a.*, coalesce(vn, 0) AS vn, description, role, list_has_any(tokens, {arr(L.DESCRIPTION_CUES)}) AS dc,
  list_has_any(tokens, {arr(L.ROLE_CUES)}) AS rc, contains(text, '?') AS qm
  FROM {p}_a a LEFT JOIN {p}_vn USING ({cols}) JOIN {feat} USING ({', '.join(keys)}) JOIN {units} USING ({u})),
{p}_c AS (SELECT *, ds * 1.35 + xs * 0.65 + es * 0.3 + ph * 5.0 + CASE WHEN vn > 1 THEN (vn - 1) * 0.9 ELSE 0 END
  + CASE WHEN description AND en > 0 AND dc THEN 0.8 ELSE 0 END + CASE WHEN role AND (en > 0 OR dn > 0) AND rc THEN 1.2 ELSE 0 END
  - CASE WHEN qm THEN 2.5 ELSE 0 END AS raw FROM {p}_b),
{p} AS (SELECT {cols}, CAST(ph AS INTEGER) AS hits, CASE WHEN dn + xn + en + ph = 0 THEN 0.0
  ELSE greatest(0.0, CASE WHEN en > 0 AND dn = 0 AND xn = 0 AND ph = 0 THEN least(raw, 1.15) ELSE raw END) END AS score FROM {p}_c)"""


def windows(x: str) -> str:
    s = sentences(x)
    return (f"list_filter(flatten(list_transform(range(1, len({s}) + 1), lambda i: CASE WHEN i < len({s}) AND "
            f"length({s}[i]) + 1 + length({s}[i + 1]) <= 420 THEN [{s}[i], {s}[i] || ' ' || {s}[i + 1]] ELSE [{s}[i]] END)), "
            f"lambda w: length(w) >= 30)")


def windows_from(list_name: str) -> str:
    s = list_name
    return (f"list_filter(flatten(list_transform(range(1, len({s}) + 1), lambda i: CASE WHEN i < len({s}) AND "
            f"length({s}[i]) + 1 + length({s}[i + 1]) <= 420 THEN [{s}[i], {s}[i] || ' ' || {s}[i + 1]] ELSE [{s}[i]] END)), "
            f"lambda w: length(w) >= 30)")


def lexical(query_set: str) -> str:
    """CTEs up to lex: query_id, chunk key, score, hits, whole, best_window, intro, lpos (limit by corpus tier)."""
    return f"""{CHUNKS},
{QUERY_SETS[query_set]},
{features('f', 'q', 'query_id', 'query', False)},
{features('g', '(SELECT query_id, vno AS variant_no, variant FROM f_v JOIN f USING (query_id) WHERE multi_part AND vno > 0)', 'query_id, variant_no', 'variant', True)},
cu AS (SELECT source_name, chunk_index, chunk_id, content AS text, norm, {search_tokens('norm')} AS tokens FROM (
  SELECT *, {search_norm('content')} AS norm FROM chunks)),
n AS (SELECT count(*) AS total FROM chunks),
held AS (SELECT source_name, chunk_index, chunk_id, unnest(list_distinct(tokens)) AS term FROM cu),
wanted AS (SELECT DISTINCT term FROM f_t UNION SELECT DISTINCT term FROM g_t),
df AS (SELECT term, count(*) AS df FROM held JOIN wanted USING (term) GROUP BY term),
w AS (SELECT term, ln((total + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0 AS weight FROM wanted LEFT JOIN df USING (term), n),
{scores('ws', 'f', ['query_id'], 'cu', ['source_name', 'chunk_index', 'chunk_id'], 'w')},
wl AS (SELECT source_name, chunk_index, chunk_id, {windows_from('ss')} AS wins FROM (
  SELECT *, {sentences('content')} AS ss FROM chunks)),
wu0 AS (SELECT source_name, chunk_index, chunk_id, text, {search_norm('text')} AS norm FROM (
  SELECT DISTINCT source_name, chunk_index, chunk_id, unnest(wins) AS text FROM wl)),
wu AS (SELECT row_number() OVER () AS wid, *, {search_tokens('norm')} AS tokens FROM wu0),
{scores('wi', 'f', ['query_id'], 'wu', ['wid'], 'w')},
bw AS (SELECT query_id, source_name, chunk_index, chunk_id, max({{hits: hits, score: score}}) AS best FROM wi JOIN wu USING (wid) GROUP BY ALL),
intro AS (SELECT source_name, term, min(chunk_index) AS first FROM held WHERE term IN (SELECT term FROM f_n JOIN f USING (query_id) WHERE description OR role) GROUP BY ALL),
bonus AS (SELECT query_id, source_name, chunk_index, chunk_id, max(CASE WHEN abs(chunk_index - first) <= 1 THEN 0.9 WHEN abs(chunk_index - first) <= 2 THEN 0.6
  WHEN abs(chunk_index - first) <= 4 THEN 0.3 ELSE 0.0 END) AS intro FROM f_n JOIN f USING (query_id) JOIN held USING (term) JOIN intro USING (source_name, term)
  WHERE description OR role GROUP BY ALL),
lx AS (SELECT query_id, source_name, chunk_index, chunk_id, ws.score AS whole, CAST(coalesce(best.score, 0) AS DOUBLE) AS best_window, coalesce(intro, 0) AS intro,
  greatest(hits, coalesce(best.hits, 0)) AS hits FROM ws LEFT JOIN bw USING (query_id, source_name, chunk_index, chunk_id)
  LEFT JOIN bonus USING (query_id, source_name, chunk_index, chunk_id)),
lim AS (SELECT total, CASE WHEN total >= 180 THEN least(greatest(24, 32), 64) WHEN total >= 80 THEN least(greatest(20, 24), 48)
  WHEN total >= 40 THEN least(greatest(16, 18), 32) WHEN total > 0 THEN least(greatest(12, 12), greatest(total, 12)) ELSE 8 END AS top FROM n),
lr AS (SELECT *, round(greatest(best_window, whole * 0.75) + least(best_window, whole) * 0.2 + intro, 6) AS score FROM lx),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, score DESC, chunk_id, source_name) AS lpos
  FROM lr WHERE hits > 0 OR score >= 1.4 - 1e-6) WHERE lpos <= (SELECT top FROM lim))"""


def vector(query_set: str) -> str:
    bucket = "CAST('0x' || substr(md5(term), 1, 4) AS INTEGER) % 64"
    return lexical(query_set) + f""",
ce0 AS (SELECT source_name, chunk_index, chunk_id, {bucket} AS b, count(*) AS c FROM held GROUP BY ALL),
ce AS (SELECT *, c / sqrt(sum(c * c) OVER (PARTITION BY source_name, chunk_index)) AS x FROM ce0),
qv AS (SELECT query_id, vno, unnest(list_distinct({search_tokens(search_norm('variant'))})) AS term FROM f_v),
qe0 AS (SELECT query_id, vno, {bucket} AS b, count(*) AS c FROM qv GROUP BY ALL),
qe AS (SELECT *, c / sqrt(sum(c * c) OVER (PARTITION BY query_id, vno)) AS x FROM qe0),
cn AS (SELECT source_name, chunk_index, chunk_id, coalesce(sum(x * x), 0) AS cc FROM cu LEFT JOIN ce USING (source_name, chunk_index, chunk_id) GROUP BY ALL),
qn AS (SELECT query_id, vno, coalesce(sum(x * x), 0) AS qq FROM f_v LEFT JOIN qe USING (query_id, vno) GROUP BY ALL),
dots AS (SELECT query_id, vno, source_name, chunk_index, chunk_id, sum(qe.x * ce.x) AS dot FROM qe JOIN ce USING (b) GROUP BY ALL),
vd AS (SELECT query_id, vno, source_name, chunk_index, chunk_id, round(greatest(0, qq + cc - 2 * coalesce(dot, 0)), 6) AS distance
  FROM qn CROSS JOIN cn LEFT JOIN dots USING (query_id, vno, source_name, chunk_index, chunk_id)),
vk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, vno ORDER BY distance, source_name, chunk_index, chunk_id) AS rank FROM vd)
  WHERE rank <= (SELECT top FROM lim)),
vb AS (SELECT query_id, source_name, chunk_index, chunk_id, min(distance) AS distance, max(1.0 / (1.0 + distance)) AS relevance,
  min({{v: vno, r: rank}}) AS seen FROM vk GROUP BY ALL),
vec AS (SELECT * EXCLUDE seen, row_number() OVER (PARTITION BY query_id ORDER BY seen, source_name, chunk_index, chunk_id) AS vpos FROM vb)"""


def hybrid(query_set: str) -> str:
    return vector(query_set) + f""",
fu0 AS (SELECT query_id, source_name, chunk_index, chunk_id, coalesce(distance, 1.0) AS distance, coalesce(relevance, 0) AS v,
  coalesce(score, 0) AS s, max(score) OVER (PARTITION BY query_id) AS lmax, coalesce(hits, 0) AS hits, vpos, lpos
  FROM vec FULL JOIN lex USING (query_id, source_name, chunk_index, chunk_id)),
fu AS (SELECT *, CASE WHEN lmax > 0 THEN s / lmax ELSE 0 END AS l, len(phrases) > 0 AS has_quote, multi_part, description, role,
  row_number() OVER (PARTITION BY query_id ORDER BY coalesce(lpos, 1000000), vpos) AS spos FROM fu0 JOIN f USING (query_id)),
seeds AS (SELECT *, CASE WHEN multi_part OR (SELECT total FROM n) >= 40 OR description THEN 2 ELSE 1 END AS wide FROM fu
  WHERE CASE WHEN has_quote THEN spos <= greatest((SELECT top FROM lim), 6) ELSE coalesce(lpos, 1000000) <= 6 OR coalesce(vpos, 1000000) <= 6 END),
ar AS (SELECT query_id, source_name, i AS chunk_index, max(greatest(v, l)) AS support FROM (
  SELECT *, unnest(range(chunk_index - wide, chunk_index + wide + 1)) AS i FROM seeds) GROUP BY ALL),
al AS (SELECT query_id, c.source_name, c.chunk_index, c.chunk_id, c.content, distance, v, l, hits, support, fu.chunk_id IS NOT NULL AS cand
  FROM (fu FULL JOIN ar USING (query_id, source_name, chunk_index)) JOIN chunks c USING (source_name, chunk_index)),
ra0 AS (SELECT al.* REPLACE (coalesce(distance, 1.0) AS distance, coalesce(v, 0) AS v, coalesce(l, 0) AS l, coalesce(hits, 0) AS hits),
  len(phrases) > 0 AS has_quote, multi_part, description, role,
  count(*) OVER (PARTITION BY query_id, source_name ORDER BY chunk_index RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) - 1 AS nearby FROM al JOIN f USING (query_id)),
ra1 AS (SELECT *, round(CASE WHEN has_quote THEN greatest(v, l) + CASE WHEN hits > 0 THEN 0.8 ELSE 0 END
    ELSE v * 0.6 + l * 0.4 + CASE WHEN description OR role THEN l * 0.08 ELSE 0 END END
    + CASE WHEN support IS NOT NULL AND NOT cand THEN greatest(0.1, least(0.22, support * 0.38)) ELSE 0 END + least(0.14, nearby * 0.045), 6) AS combined,
  round(greatest(v, l, CASE WHEN support IS NOT NULL THEN 0.34 ELSE 0 END), 6) AS relevance FROM ra0),
ra AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, combined DESC, relevance DESC, chunk_id, source_name) AS global_rank FROM ra1),
pu AS (SELECT query_id, source_name, chunk_index, chunk_id, nearby, text, norm, tokens FROM ra JOIN cu USING (source_name, chunk_index, chunk_id)),
{scores('vs', 'g', ['query_id', 'variant_no'], 'pu', ['query_id', 'source_name', 'chunk_index', 'chunk_id'], 'w')},
vp AS (SELECT query_id, variant_no, source_name, chunk_index, chunk_id, round(coalesce(score, 0) + least(4.0, nearby * 2.0), 6) AS own
  FROM pu JOIN (SELECT DISTINCT query_id, variant_no FROM g_d) USING (query_id) LEFT JOIN vs USING (query_id, variant_no, source_name, chunk_index, chunk_id)),
pick AS (SELECT query_id, source_name, chunk_index, chunk_id, min(variant_no) AS slot FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY own DESC, chunk_id, source_name) AS r FROM vp) WHERE r = 1 GROUP BY ALL),
ret AS (SELECT query_id, rank, chunk_id, source_name, chunk_index, content, round(distance, 6) AS distance, relevance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(slot, 1000000), global_rank) AS rank FROM ra LEFT JOIN pick USING (query_id, source_name, chunk_index, chunk_id))
  WHERE rank <= CASE WHEN multi_part OR (SELECT total FROM n) >= 40 THEN 6 ELSE 6 END)"""


def focused(base: str, retrieved: str = "ret") -> str:
    """CTE fx: query_id, excerpt_no, chunk_id, source_name, text."""
    return base + f""",
rt AS (SELECT query_id, rank, chunk_id, source_name, content, relevance, {search_tokens(search_norm('content'))} AS tokens FROM {retrieved}),
rn AS (SELECT query_id, count(*) AS total FROM rt GROUP BY 1),
rh AS (SELECT query_id, term, count(*) AS df FROM (SELECT query_id, rank, unnest(list_distinct(tokens)) AS term FROM rt) GROUP BY ALL),
f_local AS (SELECT query_id, term, ln((total + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0 AS weight FROM f_t JOIN rn USING (query_id) LEFT JOIN rh USING (query_id, term)),
g_local AS (SELECT query_id, variant_no, term, ln((total + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0 AS weight FROM g_t JOIN rn USING (query_id) LEFT JOIN rh USING (query_id, term)),
rw0 AS (SELECT query_id, rank, chunk_id, source_name, relevance, {windows_from('ss')} AS wins FROM (SELECT *, {sentences('content')} AS ss FROM rt)),
rw1 AS (SELECT * EXCLUDE wins, list_filter(wins, lambda e, i: list_position(wins, e) = i) AS wins FROM rw0),
rw AS (SELECT query_id, rank, chunk_id, source_name, relevance, CAST(i AS INTEGER) AS wno, text, norm, {search_tokens('norm')} AS tokens FROM (
  SELECT *, {search_norm('text')} AS norm FROM (SELECT * EXCLUDE wins, wins[i + 1] AS text FROM (SELECT *, unnest(range(len(wins))) AS i FROM rw1)))),
{scores('fs', 'f', ['query_id'], 'rw', ['query_id', 'rank', 'wno'], 'f_local')},
{scores('gs', 'g', ['query_id', 'variant_no'], 'rw', ['query_id', 'rank', 'wno'], 'g_local')},
fw AS (SELECT query_id, round(score + relevance * 1.1, 6) AS score, chunk_id, source_name, {strip('substr(text, 1, 360)')} AS text FROM fs JOIN rw USING (query_id, rank, wno) WHERE score > 0),
gw AS (SELECT query_id, variant_no, rank, wno, round(score + relevance, 6) AS score, chunk_id, source_name, {strip('substr(text, 1, 360)')} AS text FROM gs JOIN rw USING (query_id, rank, wno) WHERE score > 0
  AND query_id IN (SELECT query_id FROM fw)),
g1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY score DESC, rank, wno) AS r FROM gw) WHERE r = 1),
g2 AS (SELECT query_id, text, min(variant_no) AS variant_no, arg_min(chunk_id, variant_no) AS chunk_id, arg_min(source_name, variant_no) AS source_name FROM g1 GROUP BY query_id, text),
g3 AS (SELECT query_id, list({{chunk_id: chunk_id, source_name: source_name, text: text}} ORDER BY variant_no)[1:6] AS head FROM g2 GROUP BY query_id),
f3 AS (SELECT query_id, list({{chunk_id: chunk_id, source_name: source_name, text: text}} ORDER BY score DESC, chunk_id DESC, source_name DESC, text DESC) AS tail FROM fw GROUP BY query_id),
fold AS (SELECT query_id, list_reduce(list_prepend(coalesce(head, []), list_transform(tail, lambda t: [t])), lambda a, b:
    CASE WHEN len(a) < 6 AND len(list_filter(a, lambda p: p.text = b[1].text)) = 0 AND len(list_filter(a, lambda p: p.chunk_id = b[1].chunk_id)) < 2
    THEN list_append(a, b[1]) ELSE a END) AS picked FROM f3 LEFT JOIN g3 USING (query_id)),
fx0 AS (SELECT query_id, i AS k, picked[i].chunk_id AS chunk_id, picked[i].source_name AS source_name, picked[i].text AS text FROM (
  SELECT *, unnest(range(1, len(picked) + 1)) AS i FROM fold)
  UNION ALL SELECT query_id, rank, chunk_id, source_name, content FROM rt WHERE rank <= 6 AND query_id NOT IN (SELECT query_id FROM fw)),
fx AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY k) AS excerpt_no, chunk_id, source_name, text FROM fx0)"""
