"""DuckDB SQL of the alignment of scripts: the same definition, a step at a time."""

from __future__ import annotations

_WORD = r"[\p{L}\p{N}_]+"
_EDGE = r"[.,;:?!\"''()\[\]-]"


def _chain(blocks: str, keys: str, name: str) -> str:
    """CTEs that leave the heaviest rising chain of blocks (keys, i, j, n), cut where one covers words of the next, as pairs of words."""
    return f"""{name}_list AS (SELECT {keys}, list(i ORDER BY i) AS bi, list(j ORDER BY i) AS bj, list(n ORDER BY i) AS bn FROM {blocks} GROUP BY {keys}),
{name}_best AS (
  SELECT {keys}, bi, bj, bn, 0 AS k, []::BIGINT[] AS best, []::BIGINT[] AS prev FROM {name}_list
  UNION ALL
  SELECT {keys}, bi, bj, bn, k + 1, list_append(best, bn[k + 1] + coalesce(p.words, 0)), list_append(prev, -coalesce(p.spot, 0)) FROM (
    SELECT *, list_max(list_transform(list_filter(range(1, k + 1), lambda x: bj[x] < bj[k + 1]), lambda x: {{'words': best[x], 'spot': -x}})) AS p FROM {name}_best WHERE k < len(bj))
),
{name}_walk AS (
  SELECT {keys}, bi, bj, bn, prev, -list_max(list_transform(range(1, len(bj) + 1), lambda x: {{'words': best[x], 'spot': -x}})).spot AS spot FROM {name}_best WHERE k = len(bj)
  UNION ALL SELECT {keys}, bi, bj, bn, prev, prev[spot] FROM {name}_walk WHERE prev[spot] > 0
),
{name}_cut AS (
  SELECT *, greatest(0, coalesce(lag(i + n) OVER w - i, 0), coalesce(lag(j + n) OVER w - j, 0)) AS cut
  FROM (SELECT {keys}, bi[spot] AS i, bj[spot] AS j, bn[spot] AS n FROM {name}_walk) WINDOW w AS (PARTITION BY {keys} ORDER BY i)
),
{name}_pairs AS (SELECT chapter_idx, i + x AS i, j + x AS j FROM (SELECT *, unnest(range(cut, n)) AS x FROM {name}_cut WHERE cut < n))"""


def _gaps(pairs: str, name: str) -> str:
    """The words of both sides without partners, with the number of matched words before."""
    one = "{n}_{s} AS MATERIALIZED (SELECT chapter_idx, gap, {a}, w FROM (SELECT t.chapter_idx, t.{a}, t.w, m.{b}, count(m.{b}) OVER (PARTITION BY t.chapter_idx ORDER BY t.{a}) AS gap FROM {s} t LEFT JOIN {m} m USING (chapter_idx, {a})) WHERE {b} IS NULL)"
    return ",\n".join(one.format(n=name, m=pairs, s=s, a=a, b=b) for s, a, b in (("src", "i", "j"), ("scr", "j", "i")))


def _ends(pairs: str, name: str, order: str) -> str:
    """Words that agree from one end of a gap on."""
    side = "SELECT *, row_number() OVER (PARTITION BY chapter_idx, gap ORDER BY {a} {o}) AS k FROM {n}_{s}"
    a, b = side.format(a="i", o=order, n=name, s="src"), side.format(a="j", o=order, n=name, s="scr")
    return f"""{_gaps(pairs, name)},
{name} AS MATERIALIZED (
  SELECT chapter_idx, i, j FROM {pairs} UNION ALL
  SELECT chapter_idx, i, j FROM (SELECT a.chapter_idx, a.i, b.j, k, min(CASE WHEN a.w <> b.w THEN k END) OVER (PARTITION BY a.chapter_idx, a.gap) AS stop FROM ({a}) a JOIN ({b}) b USING (chapter_idx, gap, k)) WHERE stop IS NULL OR k < stop
)"""


def _rare(pairs: str, name: str, run: int) -> str:
    """Runs of words that are there once on both sides of a gap, chained."""
    once = "SELECT chapter_idx, gap, r, min({a}) AS {a} FROM (SELECT chapter_idx, gap, {a}, " + " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER x" for k in range(1, run))]) + " AS r FROM {n}_{s} WINDOW x AS (PARTITION BY chapter_idx, gap ORDER BY {a})) WHERE r IS NOT NULL GROUP BY ALL HAVING count(*) = 1"
    a, b = once.format(a="i", n=name, s="src"), once.format(a="j", n=name, s="scr")
    return f"""{_gaps(pairs, name)},
{name}_blocks AS (
  SELECT chapter_idx, gap, min(i) AS i, min(j) AS j, count(*) + {run - 1} AS n
  FROM (SELECT *, i - row_number() OVER (PARTITION BY chapter_idx, gap, i - j ORDER BY i) AS island FROM ({a}) JOIN ({b}) USING (chapter_idx, gap, r)) GROUP BY chapter_idx, gap, i - j, island
),
{_chain(f"{name}_blocks", "chapter_idx, gap", name)},
{name} AS MATERIALIZED (SELECT chapter_idx, i, j FROM {pairs} UNION ALL SELECT chapter_idx, i, j FROM {name}_pairs)"""


def validation_sql(tables: str) -> str:
    """SQL of `validate_scripts` over the CTEs sources (chapter_idx, text) and script (chapter_idx, seg, text)."""
    steps = [_rare("m0", "m1", 3), _ends("m1", "m2", ""), _ends("m2", "m3", "DESC"), _rare("m3", "m4", 1), _ends("m4", "m5", ""), _ends("m5", "m6", "DESC")]
    return f"""
WITH RECURSIVE {tables},
src0 AS (SELECT chapter_idx, unnest(ws) AS x, generate_subscripts(ws, 1) - 1 AS i, seps FROM (SELECT chapter_idx, regexp_extract_all(text, '{_WORD}') AS ws, regexp_split_to_array(text, '{_WORD}') AS seps FROM sources)),
src AS MATERIALIZED (SELECT chapter_idx, i, lower(x) AS w, b - length(x) AS a, b, before, after FROM (SELECT chapter_idx, i, x, seps[i + 1] AS before, seps[i + 2] AS after, sum(length(seps[i + 1]) + length(x)) OVER (PARTITION BY chapter_idx ORDER BY i) AS b FROM src0)),
scr0 AS (SELECT chapter_idx, seg, unnest(ws) AS x, generate_subscripts(ws, 1) AS k, seps FROM (SELECT chapter_idx, seg, regexp_extract_all(text, '{_WORD}') AS ws, regexp_split_to_array(text, '{_WORD}') AS seps FROM script)),
scr AS MATERIALIZED (SELECT chapter_idx, seg, row_number() OVER (PARTITION BY chapter_idx ORDER BY seg, k) - 1 AS j, lower(x) AS w, sum(length(seps[k]) + length(x)) OVER (PARTITION BY chapter_idx, seg ORDER BY k) - length(x) AS a FROM scr0),
m0 AS (SELECT 0::BIGINT AS chapter_idx, 0::BIGINT AS i, 0::BIGINT AS j WHERE false),
{", ".join(steps)},
open AS (
  SELECT chapter_idx, gap, coalesce(behind + 1, 0) AS j, min(a) AS a, max(b) AS b, arg_min(before, i) AS before, arg_max(after, i) AS after
  FROM (SELECT s.*, m.j AS partner, count(m.j) OVER w AS gap, max(m.j) OVER w AS behind FROM src s LEFT JOIN m6 m USING (chapter_idx, i) WINDOW w AS (PARTITION BY s.chapter_idx ORDER BY s.i)) WHERE partner IS NULL GROUP BY chapter_idx, gap, behind
),
spans AS (SELECT chapter_idx, j, a - length(regexp_extract(before, '({_EDGE}*)$', 1)) AS a, b + length(regexp_extract(after, '^({_EDGE}*)', 1)) AS b FROM open),
segs AS (SELECT chapter_idx, count(*) AS n FROM script GROUP BY 1),
missing AS (
  SELECT s.chapter_idx, coalesce(w.seg, segs.n) AS seg_idx, coalesce(w.a, 0) AS "offset", trim(text[s.a + 1:s.b], E' \\n\\t\\r') AS text,
    trim(string_split(text[1:s.a], chr(10))[-1] || text[s.a + 1:s.b] || string_split(text[s.b + 1:], chr(10))[1], E' \\n\\t\\r') AS line
  FROM spans s JOIN sources USING (chapter_idx) JOIN segs USING (chapter_idx) LEFT JOIN scr w ON w.chapter_idx = s.chapter_idx AND w.j = s.j
),
said AS (SELECT scr.chapter_idx, seg, count(m.i) AS found, count(*) AS words FROM scr LEFT JOIN m6 m ON m.chapter_idx = scr.chapter_idx AND m.j = scr.j GROUP BY 1, 2)
SELECT chapter_idx, 'missing' AS kind, seg_idx, "offset", text, line FROM missing WHERE length(text) > 1 OR regexp_full_match(text, '[\\p{{L}}\\p{{N}}]')
UNION ALL SELECT chapter_idx, 'missing', 0, 0, text, text FROM sources WHERE trim(text) <> '' AND chapter_idx NOT IN (SELECT chapter_idx FROM segs)
UNION ALL SELECT chapter_idx, 'hallucinated', seg, 0, text, text FROM said JOIN script USING (chapter_idx, seg) WHERE 2 * found < words AND chapter_idx IN (SELECT chapter_idx FROM sources)"""
