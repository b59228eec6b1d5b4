"""DuckDB SQL for the operators whose whole method SQL can express on small tables."""

from __future__ import annotations

from sievework.llm.pivot_codes import ENTRIES, PARTS, ROUNDS, SCALE
from sievework.llm.substring_rlz import WINDOW


def pivot_codes() -> str:
    """Every part against every entry of its codebook, round by round."""
    assign = f"""SELECT v.vec_id, v.p, min(cast(v.xx + c.cc - 2 * list_inner_product(v.x, c.c) AS BIGINT) * {ENTRIES} + c.e) AS m
      FROM parts v JOIN c{{k}} c ON v.p = c.p GROUP BY v.vec_id, v.p"""
    update = """SELECT c.p, c.e, coalesce(n.c, c.c) AS c, coalesce(list_inner_product(n.c, n.c), c.cc) AS cc FROM c{k} c LEFT JOIN (
        SELECT p, e, cast(list((s - (((s % n) + n) % n)) // n ORDER BY i) AS DOUBLE[]) AS c FROM (
          SELECT v.p, a.m % {size} AS e, i, cast(sum(cast(v.x[i] AS BIGINT)) AS BIGINT) AS s, count(*) AS n
          FROM parts v JOIN a{k} a ON v.vec_id = a.vec_id AND v.p = a.p, LATERAL (SELECT unnest(range(1, len(v.x) + 1)) AS i) GROUP BY ALL
        ) GROUP BY p, e) n ON c.p = n.p AND c.e = n.e"""
    rounds = "".join(f"a{k} AS MATERIALIZED ({assign.format(k=k)}), c{k + 1} AS MATERIALIZED ({update.format(k=k, size=ENTRIES)}),\n" for k in range(ROUNDS))
    return f"""WITH kept AS (
      SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * cast(x AS DOUBLE))) AS v FROM embeddings
      WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), cut AS (
      SELECT vec_id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) t(p)
    ), parts AS MATERIALIZED (SELECT vec_id, p, x, list_inner_product(x, x) AS xx FROM cut),
    c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c, xx AS cc FROM parts QUALIFY e < {ENTRIES}),
    {rounds} last AS MATERIALIZED ({assign.format(k=ROUNDS)}),
    coded AS (SELECT vec_id, string_agg(printf('%02x', m % {ENTRIES}), '' ORDER BY p) AS code, cast(sum(m // {ENTRIES}) AS BIGINT) AS error FROM last GROUP BY vec_id)
    SELECT vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
           (SELECT sha256(string_agg(array_to_string(cast(c AS BIGINT[]), ','), ',' ORDER BY p, e)) FROM c{ROUNDS}) AS codebooks_sha256
    FROM coded JOIN kept USING (vec_id)"""


def substring() -> str:
    """All windows of 13 words with the smallest doc_id that has each."""
    return rf"""WITH w AS MATERIALIZED (
      SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS n, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents
    ), win AS MATERIALIZED (
      SELECT r, n, unnest(range(1, len(t) - {WINDOW - 2})) AS i, unnest(list_transform(range(1, len(t) - {WINDOW - 2}), lambda i: array_to_string(t[i : i + {WINDOW - 1}], ' '))) AS k FROM w
    ), low AS (SELECT k, min(n) AS n FROM win GROUP BY k
    ), hit AS (
      SELECT DISTINCT win.r, win.i + o AS i FROM win JOIN low ON win.k = low.k AND low.n < win.n, range({WINDOW}) g(o)
    ), word AS (SELECT r, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS x FROM w
    ), kept AS (
      SELECT word.r, string_agg(x, ' ' ORDER BY word.i) FILTER (hit.i IS NULL) AS s, count(hit.i) AS gone FROM word LEFT JOIN hit ON word.r = hit.r AND word.i = hit.i GROUP BY word.r
    )
    SELECT doc_id, cast(len(t) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.r = kept.r"""


def merkle() -> str:
    """The nodes of a level as one list per tree."""
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(strlen(cast({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    grown = "list_transform(range(0, (len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[i * 8 + 1 : i * 8 + 8], '')))"
    sides = "array_to_string(nodes[(i // 8) * 8 + 1 : i], '') AS before, array_to_string(nodes[i + 2 : (i // 8) * 8 + 8], '') AS after"
    return f"""WITH RECURSIVE crc AS (
      SELECT *, list_reduce([4294967295] || flatten(list_transform(string_split(cast(doc_id AS VARCHAR), ''), lambda c: [cast(ord(c) AS BIGINT)] || repeat([-1::BIGINT], 8))),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS c FROM documents
    ), altered AS (
      SELECT *, CASE WHEN xor(c, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM crc
    ), leaves AS MATERIALIZED (
      SELECT row_number() OVER () AS id, doc_id, coalesce(':' || lang, '-') AS tree, {leaf("text")} AS leaf, {leaf("other")} AS again FROM altered
    ), ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM leaves
    ), levels(tree, level, nodes) AS (
      SELECT tree, 0, list(leaf ORDER BY r) FROM ranked GROUP BY tree
      UNION ALL SELECT tree, level + 1, {grown} FROM levels WHERE len(nodes) > 1
    ), subs AS (SELECT tree, nodes[1] AS sub, row_number() OVER (ORDER BY tree) - 1 AS r FROM levels WHERE len(nodes) = 1
    ), tops(level, nodes) AS (
      SELECT 0, list(sub ORDER BY r) FROM subs
      UNION ALL SELECT level + 1, {grown} FROM tops WHERE len(nodes) > 1
    ), steps AS (
      SELECT id, level, {sides} FROM (SELECT id, level, nodes, r // cast(8 ** level AS BIGINT) AS i FROM ranked JOIN levels USING (tree) WHERE len(nodes) > 1)
      UNION ALL
      SELECT id, 1000 + level, {sides} FROM (SELECT id, level, nodes, s.r // cast(8 ** level AS BIGINT) AS i FROM ranked JOIN subs s USING (tree), tops WHERE len(nodes) > 1)
    ), paths AS (SELECT id, string_agg(before || after, '' ORDER BY level) AS proof, list({{'b': before, 'a': after}} ORDER BY level) AS path FROM steps GROUP BY id
    ), done AS (
      SELECT doc_id, leaf, sub AS subroot, (SELECT nodes[1] FROM tops WHERE len(nodes) = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
             list_reduce([{{'b': again, 'a': ''}}] || coalesce(path, []), lambda x, y: {{'b': sha256(y.b || x.b || y.a), 'a': ''}}).b AS folded_root
      FROM ranked JOIN subs USING (tree) LEFT JOIN paths USING (id)
    )
    SELECT *, folded_root = root AS verified FROM done"""
