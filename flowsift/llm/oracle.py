"""SQL for the queries that SQL can express, over the tables as views."""

from __future__ import annotations

from flowsift.llm.quality import HostRules

RULES = HostRules()

QUALITY = rf"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
    FROM documents),
win AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
repeated AS (SELECT rid, w FROM win GROUP BY rid, w HAVING count(*) > 1),
covered AS (
    SELECT rid, count(DISTINCT p) AS n FROM (
        SELECT win.rid, unnest(range(i, i + 5)) AS p FROM win JOIN repeated ON win.rid = repeated.rid AND win.w = repeated.w)
    GROUP BY rid),
lines AS (SELECT rid, l FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
repeats AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY rid),
m AS (
    SELECT d.rid, doc_id, host, len(ws)::BIGINT AS n_words,
           length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
           (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
           coalesce(repeats.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
    FROM d LEFT JOIN covered ON d.rid = covered.rid LEFT JOIN repeats ON d.rid = repeats.rid),
b AS (SELECT *, n_words < {RULES.min_words} OR 100 * n_repeat_words > {RULES.max_repeat_percent} * n_words AS base_failed FROM m),
f AS (
    SELECT *, base_failed OR 100 * n_symbols > {RULES.max_symbol_percent} * word_chars
           OR 500 * n_dup_lines > {RULES.max_dup_line_percent} * n_words AS failed
    FROM b),
h AS (SELECT host, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS bad FROM f GROUP BY host),
pooled AS (
    SELECT sum(n) AS docs, sum(bad) / sum(n) AS rate, count(*) AS hosts, sum(n * n) AS squares, sum(bad * bad / n) AS weighted FROM h),
spread AS (
    SELECT rate, rate * (1 - rate) AS chance,
           (weighted - docs * rate * rate - (hosts - 1) * rate * (1 - rate)) / nullif(docs - squares / docs, 0) AS excess
    FROM pooled),
prior AS (
    SELECT rate, CASE WHEN excess > 0 THEN least(greatest(chance / excess - 1, 1), {RULES.prior_limit}) ELSE {RULES.prior_limit} END AS k
    FROM spread),
shrunk AS (SELECT host, n + k AS n, (bad + rate * k) / (n + k) AS p FROM h, prior),
bad AS (SELECT host FROM shrunk WHERE p - {RULES.margin} * sqrt(p * (1 - p) / (n + 1)) > {RULES.reject_rate})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host NOT IN (SELECT host FROM bad) AS kept
FROM b
"""

TOP_K = """
WITH v AS (
    SELECT row_number() OVER () AS rid, vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS ints
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (
    SELECT q.rid, q.vec_id AS query_id, v.vec_id, list_dot_product(q.ints, v.ints)::BIGINT AS score
    FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.ints) = len(v.ints)
    WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INT AS rank FROM pairs)
WHERE rank <= 10
"""

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def tree_levels(name: str, ground: str, depth: int) -> str:
    """Levels of a forest over ``ground`` (g, i, h, t: the group's nodes), as ``name``0 to ``name``depth, and runs of siblings."""
    steps = [f"{name}0 AS (SELECT g, i, h, t FROM {ground})"]
    for k in range(depth):
        steps += [
            f"{name}runs{k} AS (SELECT g, i // 8 AS i, list(h ORDER BY i) AS hs, (t + 7) // 8 AS t FROM {name}{k} WHERE t > 1 GROUP BY g, i // 8, t)",
            f"{name}{k + 1} AS (SELECT g, i, sha256(array_to_string(hs, '')) AS h, t FROM {name}runs{k} UNION ALL SELECT g, i, h, t FROM {name}{k} WHERE t = 1)",
        ]
    return ",\n".join(steps)


def tree_folds(name: str, tree: str, start: str, depth: int) -> str:
    """Fold (rid, g, i, v: the value so far, p: the siblings so far) of ``start`` up a forest, as ``name``0 to ``name``depth."""
    steps = [f"{name}0 AS (SELECT rid, g, i, v, p FROM {start})"]
    left, right = "array_to_string(hs[1:f.i % 8], '')", "array_to_string(hs[f.i % 8 + 2:], '')"
    for k in range(depth):
        steps.append(
            f"{name}{k + 1} AS (SELECT rid, f.g, f.i // 8 AS i, CASE WHEN hs IS NULL THEN v ELSE sha256({left} || v || {right}) END AS v, "
            f"CASE WHEN hs IS NULL THEN p ELSE p || {left} || {right} END AS p "
            f"FROM {name}{k} AS f LEFT JOIN {tree}runs{k} AS r ON f.g = r.g AND f.i // 8 = r.i)"
        )
    return ",\n".join(steps)


def leaf_sql(text: str) -> str:
    """A document's leaf, with an expression as its text."""
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


DEPTH = 8  # levels for up to 8^8 documents a language, and as many languages

MERKLE = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, * FROM documents),
crc AS (
    SELECT rid, doc_id::VARCHAR AS s, 0 AS k, 4294967295 AS c FROM d WHERE doc_id IS NOT NULL
    UNION ALL
    SELECT rid, s, k + 1, xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)
    FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(c, ascii(substr(s, k // 8 + 1, 1))::BIGINT) ELSE c END AS x FROM crc WHERE k < 8 * length(s))),
tampered AS (SELECT rid FROM crc WHERE k = 8 * length(s) AND xor(c, 4294967295) % 3 = 0),
leaves AS (
    SELECT rid, doc_id, coalesce('=' || lang, '') AS g, {leaf_sql("text")} AS h,
           CASE WHEN rid IN (SELECT rid FROM tampered) THEN {leaf_sql(f"translate(text, {LETTERS})")} ELSE {leaf_sql("text")} END AS v
    FROM d),
ground AS (
    SELECT rid, doc_id, g, h, v, '' AS p, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i,
           count(*) OVER (PARTITION BY g) AS t
    FROM leaves),
{tree_levels("up", "ground", DEPTH)},
subroots AS (SELECT g AS lang, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS t, '' AS g FROM up{DEPTH}),
{tree_levels("top", "subroots", DEPTH)},
{tree_folds("fold", "up", "ground", DEPTH)},
middle AS (SELECT f.rid, s.g, s.i, f.v, f.p FROM fold{DEPTH} AS f JOIN subroots AS s ON f.g = s.lang),
{tree_folds("upper", "top", "middle", DEPTH)}
SELECT ground.doc_id, ground.h AS leaf, s.h AS subroot, r.h AS root, sha256(u.p) AS proof_sha256, u.v AS folded_root, u.v = r.h AS verified
FROM ground JOIN subroots AS s ON ground.g = s.lang JOIN upper{DEPTH} AS u ON ground.rid = u.rid CROSS JOIN top{DEPTH} AS r
"""

TERMS = rf"regexp_extract_all(translate(text, {LETTERS}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED = f"""
WITH words AS (SELECT rid, doc_id, unnest(ws) AS term, len(ws) AS n FROM (SELECT row_number() OVER () AS rid, doc_id, {TERMS} AS ws FROM documents)),
held AS (SELECT rid, doc_id, term, n, count(*) AS tf FROM words GROUP BY rid, doc_id, term, n),
corpus AS (SELECT count(DISTINCT rid) AS docs, count(*) AS total FROM words),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM held GROUP BY term), corpus),
asked AS (
    SELECT DISTINCT iid, item_id, term
    FROM (SELECT iid, item_id, unnest(ws) AS term FROM (SELECT row_number() OVER () AS iid, item_id, {TERMS} AS ws FROM benchmark))),
scored AS (
    SELECT iid, item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
    FROM asked JOIN held USING (term) JOIN weights USING (term) CROSS JOIN corpus
    GROUP BY iid, item_id, rid, doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""

ORACLE: dict[str, str] = {
    "op3_quality_rules": QUALITY,
    "op9_exact_top_k": TOP_K,
    "op11_ranked_search": RANKED,
    "op13_merkle_manifest": MERKLE,
}
