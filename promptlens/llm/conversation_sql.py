"""SQL for the queries over conversations: prefix tries and structure repair, spelled out for small tables."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a text of ASCII characters, bit by bit."""
    bits = "list_reduce(list_concat([xor(a, b)], range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    letters = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {letters}), lambda a, b: {bits}), 4294967295)"


def tie(role: str, text: str) -> str:
    return f"sha256(octet_length(encode({role})) || ':' || {role} || {text})"


OP11_SQL = f"""
WITH given AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, {tie('role', 'text')}) AS pos FROM given),
convs AS MATERIALIZED (
  SELECT c, c - c % 5 AS base, {crc32('c::VARCHAR')} % 9 AS h FROM (SELECT DISTINCT c FROM given)),
heads AS (
  SELECT convs.c, pos, role, text FROM convs JOIN turns ON turns.c = base AND pos <= h),
rebuilt AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, role, text FROM (
    SELECT 0 AS part, * FROM heads
    UNION ALL SELECT 1, c, pos, role, text FROM turns JOIN convs USING (c) WHERE pos > h)),
paths AS MATERIALIZED (
  SELECT c, d, octet_length(encode(text)) AS bytes,
    string_agg(sha256(octet_length(encode(role)) || ':' || role || text), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS name FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM convs),
lasts AS (SELECT c, max(d) AS last FROM paths GROUP BY c),
nodes AS MATERIALIZED (
  SELECT d, name, min(c) AS c, count(*) AS n_convs, max(bytes) AS bytes, substr(name, 1, greatest(length(name) - 64, 0)) AS up,
    string_agg(CASE WHEN d = last THEN c::VARCHAR END, ',' ORDER BY c) AS ends
  FROM paths JOIN lasts USING (c) GROUP BY d, name),
kids AS (SELECT d - 1 AS d, up AS name, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
own AS MATERIALIZED (SELECT nodes.*, coalesce(n, 0) AS n_children, coalesce(n, 0) = 0 AS leaf FROM nodes LEFT JOIN kids USING (d, name)),
totals AS (
  SELECT above.d, above.name, count(*) FILTER (below.leaf) AS n_leaves, sum((below.n_convs - 1) * below.bytes) AS saved
  FROM own AS above JOIN own AS below ON below.d >= above.d AND substr(below.name, 1, 64 * above.d) = above.name GROUP BY 1, 2)
SELECT own.c AS conv_id, own.d AS depth, parent.c AS parent_conv_id, own.n_convs, own.n_children, n_leaves, saved::BIGINT AS saved_tokens,
  sha256(coalesce(own.ends, '')) AS ends_sha256
FROM own JOIN totals ON totals.d = own.d AND totals.name = own.name LEFT JOIN own AS parent ON parent.d = own.d - 1 AND parent.name = own.up
"""

# --- fixed values: what each grammar state expects next, by the role's initial (0 nothing yet, 1 after s, 2 after u, 3 after a) ---
_EXPECTED = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
# ---


def _way(cost: str, letter: str, line: str, after: int) -> str:
    return f"{{'c': f{after}.c + {cost}, 'k': '{letter}' || f{after}.k, 't': {line} || f{after}.t}}"


def _base(state: int) -> str:
    """The cheapest edits that begin with the row itself."""
    role, name = ("a", "assistant") if state == 2 else ("u", "user")
    ways = [_way("3", "D", "''", state)]
    kept = [f"WHEN NOT gone AND initial = '{r}' THEN {_way('late', 'K', 'chr(10) || role || chr(58) || text', to)}" for r, to in _EXPECTED[state].items()]
    ways.append(f"CASE {' '.join(kept)} END")
    ways.append(f"CASE WHEN NOT gone THEN {_way('2 + late', 'R', f'chr(10) || {chr(39)}{name}:{chr(39)} || text', _EXPECTED[state][role])} END")
    return f"list_min([{', '.join(ways)}])"


def _inserted(state: int) -> str:
    """The cheapest edits, up to two inserted turns coming first."""
    first, then = ("assistant", "user") if state == 2 else ("user", "assistant")
    one = 3 if state == 2 else 2
    two = 5 - one

    def after(base: int, letters: str, lines: str) -> str:
        return f"{{'c': b{base}.c + {2 * len(letters)}, 'k': '{letters}' || b{base}.k, 't': {lines} || b{base}.t}}"

    return f"list_min([b{state}, {after(one, 'I', f'chr(10) || {chr(39)}{first}:{chr(39)}')}, {after(two, 'II', f'chr(10) || {chr(39)}{first}:{chr(39)} || chr(10) || {chr(39)}{then}:{chr(39)}')}])"


OP13_SQL = rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS harm FROM conversations),
damaged AS (
  SELECT coalesce(conv_id::VARCHAR, '') AS k, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role,
    CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE harm WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM given WHERE harm <> 0),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, {tie('role', 'text')}, copy) AS i FROM damaged),
judged AS (
  SELECT *, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut,
    lead(substr(role, 1, 1)) OVER (PARTITION BY k ORDER BY i) AS next_initial, lead(i) OVER (PARTITION BY k ORDER BY i) IS NOT NULL AS followed FROM placed),
rows AS MATERIALIZED (
  SELECT *, blank OR again AS gone, CASE WHEN cut AND NOT blank AND NOT again THEN 1 ELSE 0 END AS late FROM judged),
counts AS MATERIALIZED (
  SELECT k, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again AND NOT blank) AS duplicate, sum(late) AS truncated,
    count(*) FILTER (followed AND initial || next_initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY k),
edits AS (
  SELECT k, n + 1 AS i, {{'c': 0, 'k': '', 't': ''}} AS f0, {{'c': 4, 'k': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS f1,
    {{'c': 2, 'k': 'I', 't': chr(10) || 'assistant:'}} AS f2, {{'c': 0, 'k': '', 't': ''}} AS f3 FROM counts
  UNION ALL
  SELECT k, i, {', '.join(f'{_inserted(q)} AS f{q}' for q in range(4))} FROM (
    SELECT edits.k, rows.i, {', '.join(f'{_base(q)} AS b{q}' for q in range(4))} FROM edits JOIN rows ON rows.k = edits.k AND rows.i = edits.i - 1)),
best AS (SELECT k, f0 FROM edits WHERE i = 1)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(f0.c, 0)::BIGINT AS cost, coalesce(f0.k, '') AS audit,
  sha256(coalesce(substr(f0.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '') AS k FROM conversations) LEFT JOIN counts USING (k) LEFT JOIN best USING (k)
"""
