"""SQL for the queries of operators 11 to 13."""

from __future__ import annotations

from nightloom.llm import clusters, mixing


def crc32(text: str) -> str:
    """crc32 of an ASCII string: its bytes, each followed by eight shifts (-1), folded into the register."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bits}), lambda a, b: {step}), 4294967295)"


BARE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

REPAIR = f"""
    WITH RECURSIVE ids AS (SELECT DISTINCT conv_id FROM conversations),
    d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
    e AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                 unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM d),
    o AS (SELECT *, left(role, 1) AS c, rtrim(text, {BARE}) AS bare, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS c_before FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
    m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM o),
    r AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN NOT regexp_matches(right(bare, 1), '[.!?]') THEN 't' ELSE '' END AS fault FROM m),
    n AS (SELECT conv_id, count(*) AS n FROM r GROUP BY conv_id),
    back AS (
        SELECT conv_id, n + 1 AS i, 0 AS v0, 6 AS v1, 3 AS v2, 0 AS v3 FROM n
        UNION ALL
        SELECT conv_id, i, least(w0, 3 + w2, 6 + w3), least(w1, 3 + w2, 6 + w3), least(w2, 3 + w3), least(w3, 3 + w2) FROM (
            SELECT conv_id, i, least(4 + v0, CASE WHEN stays AND c = 's' THEN t + v1 END, CASE WHEN stays AND c = 'u' THEN t + v2 END, CASE WHEN stays THEN 3 + t + v2 END) AS w0,
                   least(4 + v1, CASE WHEN stays AND c = 'u' THEN t + v2 END, CASE WHEN stays THEN 3 + t + v2 END) AS w1,
                   least(4 + v2, CASE WHEN stays AND c = 'a' THEN t + v3 END, CASE WHEN stays THEN 3 + t + v3 END) AS w2,
                   least(4 + v3, CASE WHEN stays AND c = 'u' THEN t + v2 END, CASE WHEN stays THEN 3 + t + v2 END) AS w3
            FROM (SELECT r.conv_id, r.i, r.c, fault NOT IN ('b', 'd') AS stays, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS t, v0, v1, v2, v3
                  FROM back JOIN r ON r.conv_id IS NOT DISTINCT FROM back.conv_id AND r.i = back.i - 1))),
    steps AS (SELECT b.conv_id, b.i, [b.v0, b.v1, b.v2, b.v3] AS v, [a.v0, a.v1, a.v2, a.v3] AS after, r.role, r.text, r.c, r.fault
              FROM back b LEFT JOIN back a ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND a.i = b.i + 1 LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i),
    path AS (
        SELECT conv_id, CAST(0 AS BIGINT) AS step, CAST(1 AS BIGINT) AS i, 1 AS q, '' AS label, '' AS line FROM n
        UNION ALL
        SELECT conv_id, step + 1, CASE label WHEN 'I' THEN i ELSE i + 1 END,
               CASE label WHEN 'D' THEN q WHEN 'K' THEN CASE c WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END ELSE CASE q WHEN 3 THEN 4 ELSE 3 END END, label,
               CASE label WHEN 'D' THEN NULL WHEN 'K' THEN role || ':' || text ELSE CASE q WHEN 3 THEN 'assistant:' ELSE 'user:' END || CASE label WHEN 'R' THEN text ELSE '' END END
        FROM (SELECT s.*, p.step, p.q, CASE WHEN s.after[1] IS NULL THEN CASE WHEN p.q IN (1, 4) THEN NULL ELSE 'I' END
                   WHEN 4 + s.after[p.q] = s.v[p.q] THEN 'D' WHEN 3 + s.v[CASE p.q WHEN 3 THEN 4 ELSE 3 END] = s.v[p.q] THEN 'I'
                   WHEN s.fault NOT IN ('b', 'd') AND ((s.c = 's' AND p.q = 1 AND x.t + s.after[2] = s.v[p.q]) OR (s.c = 'u' AND p.q <> 3 AND x.t + s.after[3] = s.v[p.q]) OR (s.c = 'a' AND p.q = 3 AND x.t + s.after[4] = s.v[p.q])) THEN 'K' ELSE 'R' END AS label
              FROM path p JOIN steps s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.i = p.i, LATERAL (SELECT CASE WHEN s.fault = 't' THEN 3 ELSE 0 END AS t) x) WHERE label IS NOT NULL),
    edits AS (SELECT conv_id, coalesce(string_agg(label, '' ORDER BY step), '') AS audit, sha256(coalesce(string_agg(line, chr(10) ORDER BY step), '')) AS repaired_sha256 FROM path WHERE step > 0 GROUP BY conv_id),
    facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                     count(*) FILTER (c_before IS NOT NULL AND c_before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
    SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b.v0, 0) AS BIGINT) AS cost,
           coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
    FROM ids LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN edits ON edits.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM ids.conv_id AND b.i = 1
"""

MIXING = rf"""
    WITH d AS (SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, no_source, source, len(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size, md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || t) AS key FROM d),
    z AS (SELECT no_source, source, sum(size)::BIGINT AS source_size FROM w GROUP BY ALL),
    s AS (SELECT *, CAST([{", ".join(map(str, mixing.WEIGHTS))}][(row_number() OVER (ORDER BY no_source, source) - 1) % {len(mixing.WEIGHTS)} + 1] AS DOUBLE) AS weight FROM z),
    l AS (SELECT *, {mixing.MOST_EPOCHS} * source_size AS most, coalesce(sum({mixing.MOST_EPOCHS} * source_size) OVER b, 0)::BIGINT AS most_before, coalesce(sum(weight) OVER b, 0) AS weight_before,
                 sum(source_size) OVER () AS words, sum(weight) OVER () AS weights FROM s
          WINDOW b AS (ORDER BY {mixing.MOST_EPOCHS} * source_size / weight, no_source, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    v AS (SELECT min_by(level, ratio) AS level FROM (SELECT (words::BIGINT * CAST({mixing.SHARE} AS DOUBLE) - most_before) / (weights - weight_before) AS level, most / weight AS ratio FROM l) WHERE level <= ratio),
    g AS (SELECT no_source, source, source_size, CASE WHEN level IS NULL THEN CAST(most AS DOUBLE) ELSE least(CAST(most AS DOUBLE), weight * level) END AS target FROM l CROSS JOIN v),
    c AS (SELECT w.*, source_size, target, CAST(round(target) AS BIGINT) AS budget, coalesce(sum(size) OVER (PARTITION BY w.no_source, w.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS done
          FROM w JOIN g ON w.no_source = g.no_source AND w.source = g.source),
    f AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM c)
    SELECT doc_id, size, source_size, target, epochs * size + greatest(0, least(size, budget - epochs * source_size - done)) AS taken FROM f
"""


def lloyd() -> str:
    d, k = clusters.DIMENSIONS, clusters.CLUSTERS
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(greatest(least(CAST(x AS DOUBLE) * {clusters.SCALE}, {clusters.MOST}), -{clusters.MOST})) AS BIGINT)) AS q
            FROM embeddings WHERE len(embedding) = {d} AND len(list_filter(embedding, lambda x: isfinite(x))) = {d})""",
        f"x AS MATERIALIZED (SELECT r, unnest(generate_series(1, {d})) AS pos, unnest(q) AS x FROM kept)",
        f"starts AS (SELECT r, row_number() OVER (ORDER BY CASE WHEN vec_id IS NOT NULL THEN sha256('{clusters.SEED}:' || vec_id) END NULLS LAST, q) - 1 AS k FROM kept)",
        f"c0 AS MATERIALIZED (SELECT k, pos, x AS c FROM starts JOIN x USING (r) WHERE k < {k})",
    ]
    for n in range(clusters.ROUNDS + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, min(struct_pack(distance, k)) AS best FROM (SELECT r, k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS distance FROM x JOIN c{n} USING (pos) GROUP BY r, k) GROUP BY r)")
        if n < clusters.ROUNDS:
            parts.append(f"s{n} AS (SELECT best.k AS k, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{n} USING (r) GROUP BY 1, 2)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT k, pos, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{n} LEFT JOIN s{n} USING (k, pos))")
    last = clusters.ROUNDS
    return f"""WITH {", ".join(parts)}, h AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM c{last} GROUP BY k)
        SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, best.distance AS distance, CAST(sum(best.distance) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia, CAST(sum(best.distance) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM a{last} JOIN kept USING (r) JOIN h ON h.k = best.k"""


ORACLE_SQL = {"op11_repair": REPAIR, "op12_mixing": MIXING, "op13_clusters": lloyd()}
