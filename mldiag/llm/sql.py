"""SQL of the corpus queries that take more than a few lines, for DuckDB."""

from __future__ import annotations

WHITE = "'\\x20\\x09\\x0A\\x0B\\x0C\\x0D'"
STRIP = "concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    bit = "lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"lambda c, b: list_reduce([xor(c, b)] || CAST(range(8) AS BIGINT[]), {bit})"
    letters = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce([4294967295] || {letters}, {byte}), 4294967295)"


LINES = f"""
WITH cut AS (
    SELECT doc_id, row_number() OVER () AS r, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
    FROM documents
), keyed AS (SELECT *, translate(trim(line, {STRIP}), '{UPPER}', '{LOWER}') AS key FROM cut),
common AS (
    SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3
), marked AS (
    SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.owner AS gone FROM keyed k LEFT JOIN common c USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""


def _leaf(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    texts = [f"CAST({f} AS VARCHAR)" for f in fields]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({t}) AS VARCHAR) || ':' || {t}, '-')" for t in texts) + ")"


def _tree(name: str, leaves: str) -> str:
    """A recursive table of all nodes (key, level, i, n, h) over `leaves` (key, i, n, h)."""
    return f"""{name} AS (
    SELECT key, 0 AS level, i, n, h FROM {leaves}
    UNION ALL
    SELECT key, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name}
    WHERE n > 1 GROUP BY key, level, i // 2, n
)"""


MANIFEST = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, coalesce('=' || lang, '') AS key, {_leaf("n_chars")} AS h,
           CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS altered,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
    FROM documents
), {_tree("tree", "leaves")},
subroots AS (
    SELECT '' AS key, key AS name, h, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1
), {_tree("top", "subroots")},
beside AS (
    SELECT l.doc_id, t.level, CASE WHEN t.i % 2 = 0 THEN t.h END AS left_h, CASE WHEN t.i % 2 = 1 THEN t.h END AS right_h
    FROM leaves l JOIN tree t ON t.key = l.key AND t.n > 1 AND t.i = xor(l.i >> t.level, 1)
    UNION ALL
    SELECT l.doc_id, 1000 + t.level, CASE WHEN t.i % 2 = 0 THEN t.h END, CASE WHEN t.i % 2 = 1 THEN t.h END
    FROM leaves l JOIN subroots s ON s.name = l.key JOIN top t ON t.n > 1 AND t.i = xor(s.i >> t.level, 1)
), heights AS (
    SELECT l.doc_id, l.altered, (SELECT max(level) FROM tree t WHERE t.key = l.key) AS h1, (SELECT max(level) FROM top) AS h2 FROM leaves l
), folded AS (
    SELECT doc_id, 0 AS step, h1, h2, altered AS h FROM heights
    UNION ALL
    SELECT f.doc_id, step + 1, h1, h2, sha256(coalesce(left_h, '') || h || coalesce(right_h, ''))
    FROM folded f LEFT JOIN beside b ON b.doc_id = f.doc_id AND b.level = CASE WHEN step < h1 THEN step ELSE 1000 + step - h1 END
    WHERE step < h1 + h2
), proofs AS (
    SELECT doc_id, sha256(string_agg(coalesce(left_h, right_h), '' ORDER BY level)) AS proof FROM beside GROUP BY doc_id
)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
       f.h AS folded_root, f.h = (SELECT h FROM top WHERE n = 1) AS verified
FROM leaves l JOIN subroots s ON s.name = l.key JOIN folded f ON f.doc_id = l.doc_id AND f.step = f.h1 + f.h2 LEFT JOIN proofs p ON p.doc_id = l.doc_id
"""


def _turns() -> str:
    """A forward dynamic programme over whole strings: for each state the cheapest (c, audit, repaired text), ties by the audit."""

    def grown(path: str, cost: str, edit: str, row: str | None) -> str:
        text = f"{path}.r" if row is None else f"CASE WHEN {path}.r = '' THEN {row} ELSE {path}.r || chr(10) || {row} END"
        return f"CASE WHEN {path} IS NOT NULL THEN {{'c': {path}.c + {cost}, 'a': {path}.a || '{edit}', 'r': {text}}} END"

    def least(*paths: str) -> str:
        return f"list_min([{', '.join(paths)}])"

    def when(condition: str, path: str) -> str:
        return f"CASE WHEN {condition} THEN {path} END"

    put_u, put_a = "'user:'", "'assistant:'"
    before_u = least("p.u", *(grown(f"p.{q}", "2", "I", put_u) for q in ("a", "s", "e")))
    before_a = least("p.a", grown("p.u", "2", "I", put_a))
    own, stays = "(x.role || ':' || x.text)", "NOT x.must"

    def taken(role: str, sources: tuple[str, ...]) -> list[str]:
        new = f"('{role}:' || x.text)"
        kept = [when(f"{stays} AND x.role[1] = '{role[0]}'", grown(f"y.{q}", "x.cut", "K", own)) for q in sources]
        return kept + [when(stays, grown(f"y.{q}", "2 + x.cut", "R", new)) for q in sources]

    gone = {q: grown(f"y.{q}", "3", "D", None) for q in "esua"}
    next_s = least(gone["s"], when(f"{stays} AND x.role[1] = 's'", grown("y.e", "x.cut", "K", own)))
    next_u = least(gone["u"], *taken("user", ("e", "s", "a")))
    next_a = least(gone["a"], *taken("assistant", ("u",)))
    end = least("e", "a", grown("u", "2", "I", put_a), grown("s", "4", "II", "'user:' || chr(10) || 'assistant:'"))
    kind = "STRUCT(c BIGINT, a VARCHAR, r VARCHAR)"
    word = r"[^\x20\x09-\x0D]"
    return f"""
WITH RECURSIVE spaced AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
    FROM conversations
), hashed AS (SELECT *, {crc32("name")} % 20 AS kind FROM spaced),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS again
    FROM hashed
), placed AS (
    SELECT *, row_number() OVER w AS i, lag(role) OVER w AS role_before,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) > 1 AS repeated
    FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again)
), faulty AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '{word}') THEN 'blank' WHEN repeated THEN 'duplicate'
                   WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') THEN 'truncated' END AS fault
    FROM placed
), x AS (
    SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS must, CAST(coalesce(fault = 'truncated', false) AS BIGINT) AS cut FROM faulty
), p AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, CAST({{'c': 0, 'a': '', 'r': ''}} AS {kind}) AS e, CAST(NULL AS {kind}) AS s,
           CAST(NULL AS {kind}) AS u, CAST(NULL AS {kind}) AS a
    FROM x
    UNION ALL
    SELECT y.conv_id, x.i, {gone["e"]}, {next_s}, {next_u}, {next_a}
    FROM (SELECT conv_id, i, e, s, {before_u} AS u, {before_a} AS a FROM p) y JOIN x ON x.conv_id IS NOT DISTINCT FROM y.conv_id AND x.i = y.i + 1
), last AS (
    SELECT conv_id, {end} AS best FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), told AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
           count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
           count(*) FILTER (WHERE i > 1 AND role_before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal
    FROM x GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit,
       sha256(coalesce(best.r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN last ON last.conv_id IS NOT DISTINCT FROM c.conv_id
"""


TURNS = _turns()
