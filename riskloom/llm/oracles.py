"""Longer SQL equivalents of queries of this package."""

from __future__ import annotations

_ROUNDS = 10
# Exact floor of a quotient with a positive divisor.
_FLOOR = "(({s}) - ((({s}) % {n}) + {n}) % {n}) // {n}"


def _assignment(round_: int) -> str:
    gap = "v[j] - c[j]"
    distance = f"list_sum(list_transform(range(1, 65), lambda j: ({gap}) * ({gap})))"
    return f"""
a{round_} AS MATERIALIZED (
  SELECT vec_id, row, any_value(v) AS v, min({{'d': CAST({distance} AS BIGINT), 'k': k}}) AS best
  FROM p, c{round_} GROUP BY vec_id, row)"""


def _update(round_: int) -> str:
    mean = _FLOOR.format(s="s", n="n")
    return f"""
s{round_} AS (
  SELECT k, j, sum(x) AS s, count(*) AS n
  FROM (SELECT best.k AS k, unnest(v) AS x, unnest(range(1, 65)) AS j FROM a{round_ - 1}) GROUP BY k, j),
m{round_} AS (SELECT k, list(CAST({mean} AS BIGINT) ORDER BY j) AS c FROM s{round_} GROUP BY k),
c{round_} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c) AS c FROM c{round_ - 1} o LEFT JOIN m{round_} m USING (k))"""


def _centroids() -> str:
    steps = [_assignment(0)]
    for round_ in range(1, _ROUNDS + 1):
        steps += [_update(round_), _assignment(round_)]
    return f"""
WITH p AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row,
    list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x))) = 64),
h AS (SELECT v, row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS k FROM p),
c0 AS MATERIALIZED (SELECT k, v AS c FROM h WHERE k < 8),
{",".join(steps)},
f AS (SELECT vec_id, best.k AS k, best.d AS d FROM a{_ROUNDS}),
i AS (SELECT k, CAST(sum(d) AS BIGINT) AS s FROM f GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, s AS cluster_inertia,
  (SELECT CAST(sum(s) AS BIGINT) FROM i) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM f JOIN i USING (k) JOIN c{_ROUNDS} USING (k)
"""


CENTROIDS = _centroids()

# States: nothing said (n), system (s), user (u), assistant (a), each with the least {cost, audit, lines} that leads there.
_STATES = "nsua"
_FAR = 1_000_000_000_000


def _after(state: str, cost: str, letter: str, line: str | None = None) -> str:
    """What a state becomes by one edit."""
    lines = f"{state}.l" if line is None else f"list_append({state}.l, {line})"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'l': {lines}}}"


def _least(ways: list[str]) -> str:
    return f"list_min([{', '.join(ways)}])"


def _inserted(table: str) -> str:
    """The same row with turns inserted: a user turn first, then an assistant turn."""
    user = _least(["u", *[_after(x, "3", "I", "'user:'") for x in "nsa"]])
    return f"""
  SELECT * REPLACE ({_least(["a", _after("u", "3", "I", "'assistant:'")])} AS a)
  FROM (SELECT * REPLACE ({user} AS u) FROM {table})"""


def _conversations() -> str:
    far = "{'c': " + str(_FAR) + "::BIGINT, 'a': '', 'l': CAST([] AS VARCHAR[])}"
    none = far.replace(str(_FAR), "0")

    def moved(state: str, initial: str, sources: str, speaker: str) -> str:
        deleted = _after(f"old_{state}", "4", "D")
        kept = [_after(x, "slip", "K", "role || ':' || text") for x in sources]
        renamed = [_after(x, "3 + slip", "R", f"'{speaker}:'  || text") for x in sources] if speaker else []
        return f"""CASE WHEN forced THEN {deleted}
      WHEN initial = '{initial}' THEN {_least([deleted, *kept, *renamed])} ELSE {_least([deleted, *renamed])} END"""

    # A deleted turn leaves the state; turns may have been inserted before it.
    return f"""
WITH RECURSIVE table_steps AS (
  SELECT range AS n, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM table_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS t FROM table_steps WHERE k = 8),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_prepend(4294967295, list_transform(
      string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
      lambda x: CAST(ascii(x) AS BIGINT))) AS codes FROM conversations),
drawn AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(codes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS draw FROM keyed, crc_table),
hurt AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
    CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE draw WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM drawn),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM hurt),
judged AS (
  SELECT *, CASE WHEN trimmed = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS size FROM judged GROUP BY conv_id),
said AS (
  SELECT conv_id, i, role, text, initial, fault IN ('blank', 'duplicate') AS forced, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS slip
  FROM judged),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {none} AS n, {far} AS s, {far} AS u, {far} AS a FROM facts
  UNION ALL
  SELECT conv_id, i, {_after("n", "4", "D")}, CASE WHEN forced OR initial <> 's' THEN {_after("s", "4", "D")}
      ELSE {_least([_after("s", "4", "D"), _after("n", "slip", "K", "role || ':' || text")])} END,
    {moved("u", "u", "nsa", "user")}, {moved("a", "a", "u", "assistant")}
  FROM (SELECT *, u AS old_u, a AS old_a FROM ({_inserted("(SELECT w.* EXCLUDE (i), r.* EXCLUDE (conv_id) FROM walk w JOIN said r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1)")}))),
ended AS (
  SELECT w.conv_id, {_least(["n", "a"])} AS e FROM ({_inserted("walk")}) w
  JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.size = w.i)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.c, 0) AS cost, coalesce(e.a, '') AS audit,
  sha256(coalesce(array_to_string(e.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""


CONVERSATIONS = _conversations()
