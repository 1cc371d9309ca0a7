"""SQL, for another engine, that gives the same rows as the registered queries."""

from __future__ import annotations

from hypotree import defaults as D

_COS = "list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))"
_VERDICT = "CASE WHEN severity IS NULL THEN 'insufficient' WHEN severity >= fail_at THEN 'fail' WHEN severity >= concern_at THEN 'concern' ELSE 'pass' END"
_LENSES = ", ".join(f"({n}, '{name}', {float(c)}, {float(f)}, {float(w)})" for n, name, c, f, w in D.LENSES)


def _six(x: str, total: str = "") -> str:
    """x, a number of nine digits, or a sum of such, as a decimal and rounded to six digits: halves go away from zero, whatever the nearest double is."""
    return f"CAST(round({total}(CAST({x} AS DECIMAL(18, 9))), 6) AS DOUBLE)"


#: Common tables, in the order in which they build on each other.
_TABLES: dict[str, str] = {
    "world": """SELECT d.doc_id AS id, d.source, d.lang, substr(split_part(d.text, chr(10), 1), 1, 80) AS title, d.text AS body, e.ts AS observed_at, CAST(v.embedding AS DOUBLE[]) AS embedding
        FROM documents d JOIN events e ON e.event_id = d.doc_id LEFT JOIN embeddings v ON v.vec_id = d.doc_id WHERE d.doc_id % 5 <> 0""",
    "nodes": """SELECT d.doc_id AS id, (d.doc_id // 5) % 5 AS theory_id, CASE WHEN d.doc_id // 25 = 0 THEN NULL ELSE ((d.doc_id // 25 - 1) // 3) * 25 + ((d.doc_id // 5) % 5) * 5 END AS parent_id,
        substr(split_part(d.text, chr(10), 1), 1, 80) AS hypothesis, ((d.doc_id * 7919) % 1000) / 1000.0::DOUBLE AS score, d.lang, CAST(v.embedding AS DOUBLE[]) AS embedding
        FROM documents d JOIN embeddings v ON v.vec_id = d.doc_id WHERE d.doc_id % 5 = 0""",
    "theories": """SELECT n.theory_id AS id, n.theory_id * 5 + 1 AS root_event_id, n.hypothesis AS summary, w.observed_at AS created_at
        FROM nodes n LEFT JOIN world w ON w.id = n.theory_id * 5 + 1 WHERE n.parent_id IS NULL""",
    "registry": f"SELECT * FROM (VALUES {_LENSES}) AS t(lens_no, lens, concern_at, fail_at, weight)",
    "evidence": f"""SELECT node_id, event_id, cos, CASE WHEN cos > 0 THEN 1 ELSE -1 END AS stance, observed_at, source FROM (
        SELECT n.id AS node_id, w.id AS event_id, w.observed_at, w.source, round({_COS.format(a='n.embedding', b='w.embedding')}, 9) AS cos FROM nodes n, world w WHERE w.embedding IS NOT NULL) WHERE abs(cos) >= {D.TAU}""",
    "source_quality": "SELECT w.source, (count(*) FILTER (WHERE quality = 1) + 1) / (count(quality) + 2)::DOUBLE AS r FROM world w LEFT JOIN labels l ON l.doc_id = w.id GROUP BY w.source",
    "priors": "SELECT w.lang, (count(*) FILTER (WHERE quality = 1) + 1) / (count(quality) + 2)::DOUBLE AS p FROM world w LEFT JOIN labels l ON l.doc_id = w.id GROUP BY w.lang",
    "outcomes": "SELECT n.id AS node_id, l.quality AS outcome FROM nodes n JOIN labels l ON l.doc_id = n.id",
    "walk": """SELECT id, theory_id, 0 AS depth, lpad(CAST(id AS VARCHAR), 20, '0') AS path, [id] AS chain FROM nodes WHERE parent_id IS NULL
        UNION ALL SELECT n.id, n.theory_id, w.depth + 1, w.path || '/' || lpad(CAST(n.id AS VARCHAR), 20, '0'), list_append(w.chain, n.id) FROM walk w JOIN nodes n ON n.parent_id = w.id""",
    "kept": f"""SELECT x.id FROM (SELECT w.id, unnest(w.chain) AS a FROM walk w) x JOIN nodes n ON n.id = x.a
        GROUP BY x.id HAVING bool_and(n.parent_id IS NULL OR n.score >= {D.PRUNE_FLOOR})""",
    "kids": "SELECT parent_id AS id, count(*) AS n FROM nodes WHERE parent_id IS NOT NULL GROUP BY parent_id",
    "open_nodes": f"""SELECT w.id AS node_id, w.theory_id, w.depth, coalesce(k.n, 0) AS children, {D.BRANCH} - coalesce(k.n, 0) AS slots FROM walk w LEFT JOIN kids k USING (id)
        WHERE w.depth < {D.DEPTH} AND coalesce(k.n, 0) < {D.BRANCH}""",
    "s1": "SELECT node_id, 1 - sum(cos * r) / sum(cos) AS severity FROM evidence JOIN source_quality USING (source) WHERE stance = 1 GROUP BY node_id",
    "s2": "SELECT node_id, greatest(sum(stance), 0) / count(*)::DOUBLE AS severity FROM evidence GROUP BY node_id",
    "hashes": r"SELECT id AS event_id, source, md5(lower(trim(regexp_replace(body, '\s+', ' ', 'g')))) AS hash FROM world",
    "copied": "SELECT hash FROM hashes GROUP BY hash HAVING count(DISTINCT source) >= 2",
    "s3": "SELECT node_id, sum(CASE WHEN h.hash IN (SELECT hash FROM copied) THEN cos ELSE 0 END) / sum(cos) AS severity FROM evidence JOIN hashes h USING (event_id) WHERE stance = 1 GROUP BY node_id",
    "contra": "SELECT n.id AS node_id, n.theory_id, n.parent_id, round(coalesce(sum(-e.cos), 0), 6) AS x FROM nodes n LEFT JOIN evidence e ON e.node_id = n.id AND e.stance = -1 GROUP BY ALL",
    "s4": """SELECT node_id, p AS severity FROM (SELECT node_id, percent_rank() OVER (PARTITION BY theory_id, parent_id ORDER BY x) AS p, count(*) OVER (PARTITION BY theory_id, parent_id) AS n FROM contra) WHERE n > 1""",
    "s5": """SELECT node_id, CASE WHEN n = 1 THEN 1.0 ELSE (s / (t * t) - 1.0 / n) / (1 - 1.0 / n) END AS severity FROM (
        SELECT node_id, sum(c)::DOUBLE AS t, sum(c * c)::DOUBLE AS s, count(*)::DOUBLE AS n FROM (SELECT node_id, source, count(*) AS c FROM evidence WHERE stance = 1 GROUP BY ALL) GROUP BY node_id)""",
    "s6": """SELECT c.node_id, avg(CASE WHEN p.stance = -1 THEN 1.0 ELSE 0.0 END) AS severity FROM evidence c JOIN nodes n ON n.id = c.node_id
        JOIN evidence p ON p.node_id = n.parent_id AND p.event_id = c.event_id WHERE c.stance = 1 GROUP BY c.node_id""",
    "s7": "SELECT n.id AS node_id, abs(n.score - coalesce(p, 0.5)) / greatest(coalesce(p, 0.5), 1 - coalesce(p, 0.5)) AS severity FROM nodes n LEFT JOIN priors USING (lang)",
    "found": " UNION ALL ".join(f"SELECT node_id, {n} AS lens_no, severity FROM s{n}" for n in range(1, 8)),
    "verdicts": f"""SELECT node_id, lens_no, lens, {_VERDICT} AS verdict, severity FROM (
        SELECT n.id AS node_id, r.lens_no, r.lens, r.concern_at, r.fail_at, round(f.severity, 6) AS severity FROM nodes n CROSS JOIN registry r LEFT JOIN found f ON f.node_id = n.id AND f.lens_no = r.lens_no)""",
    "summary": """SELECT node_id, count(*) FILTER (WHERE verdict = 'pass') AS n_pass, count(*) FILTER (WHERE verdict = 'concern') AS n_concern, count(*) FILTER (WHERE verdict = 'fail') AS n_fail,
        count(*) FILTER (WHERE verdict = 'insufficient') AS n_insufficient, sum(weight * severity) / sum(weight) FILTER (WHERE severity IS NOT NULL) AS mean_severity, max(severity) AS max_severity,
        1 - sum(weight * severity) / sum(weight) FILTER (WHERE severity IS NOT NULL) AS resilience FROM verdicts JOIN registry USING (lens_no) GROUP BY node_id""",
    "plaus": """SELECT n.id AS node_id, (coalesce(s, 0) + 1) / (coalesce(s, 0) + coalesce(c, 0) + 2) AS plausibility FROM nodes n LEFT JOIN (
        SELECT node_id, sum(CASE WHEN stance = 1 THEN abs(cos) * r ELSE 0 END) AS s, sum(CASE WHEN stance = -1 THEN abs(cos) * r ELSE 0 END) AS c FROM evidence JOIN source_quality USING (source) GROUP BY node_id) e ON e.node_id = n.id""",
    "pairs": f"SELECT a.id AS a, b.id AS b, a.theory_id AS theory_a, b.theory_id AS theory_b, round({_COS.format(a='a.embedding', b='b.embedding')}, 9) AS cos FROM nodes a, nodes b WHERE a.id <> b.id",
    "novel": "SELECT n.id AS node_id, 1 - greatest(0, coalesce(max(p.cos), 0)) AS novelty FROM nodes n LEFT JOIN pairs p ON p.a = n.id AND p.theory_b = n.theory_id AND p.b < n.id GROUP BY n.id",
    "scores": f"""SELECT node_id, resilience, plausibility, novelty, round({D.WEIGHTS[0]} * coalesce(resilience, 0.5) + {D.WEIGHTS[1]} * plausibility + {D.WEIGHTS[2]} * novelty, 6) AS confidence
        FROM plaus JOIN novel USING (node_id) LEFT JOIN summary USING (node_id)""",
    "best": """SELECT theory_id, confidence, node_id FROM (SELECT n.theory_id, s.confidence, s.node_id, row_number() OVER (PARTITION BY n.theory_id ORDER BY s.confidence DESC, s.node_id) AS k
        FROM scores s JOIN nodes n ON n.id = s.node_id JOIN kept ON kept.id = s.node_id) WHERE k = 1""",
    "fresh": f"SELECT * FROM evidence WHERE observed_at > TIMESTAMP '{D.CUT}'",
    "joined_outcomes": "SELECT confidence, outcome, least(9, floor(confidence * 10))::INT AS bin FROM scores JOIN outcomes USING (node_id)",
    "bins": "SELECT bin, count(*) AS n, avg(confidence) AS mean_confidence, avg(outcome) AS observed, avg(confidence) - avg(outcome) AS gap FROM joined_outcomes GROUP BY bin",
    "top_titles": f"""SELECT node_id, string_agg(title, ' | ' ORDER BY k) AS titles FROM (SELECT e.node_id, w.title, row_number() OVER (PARTITION BY e.node_id ORDER BY e.cos DESC, e.event_id) AS k
        FROM evidence e JOIN world w ON w.id = e.event_id WHERE e.stance = 1) WHERE k <= {D.K} GROUP BY node_id""",
}


def _with(select: str) -> str:
    """select after the common tables that it needs."""
    import re

    needed: set[str] = set()
    todo = [select]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in _TABLES.keys() & words - needed:
            needed.add(name)
            todo.append(_TABLES[name])
    parts = [f"{name} AS MATERIALIZED ({body})" if name != "walk" else f"{name} AS ({body})" for name, body in _TABLES.items() if name in needed]
    return f"WITH RECURSIVE {', '.join(parts)} {select}" if parts else select


def _cells(text: str, table: str) -> str:
    return f"""SELECT id, bucket, round(total / sqrt(sum(total * total) OVER (PARTITION BY id)), 6) AS value FROM (
        SELECT id, (('0x' || substr(h, 1, 8))::BIGINT % 64)::INT AS bucket, sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS total
        FROM (SELECT id, md5(token) AS h FROM (SELECT id, unnest(regexp_extract_all(lower({text}), '[a-z]+')) AS token FROM {table})) GROUP BY ALL HAVING sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END) <> 0)"""


def _lens(n: int) -> str:
    return f"SELECT node_id, lens, verdict, severity FROM verdicts WHERE lens_no = {n}"


def _expanded(depth: int) -> str:
    """Levels of expansion, one after another."""
    grown = ["g0 AS MATERIALIZED (SELECT theory_id, 0 AS depth, NULL::BIGINT AS parent_id, id AS node_id, NULL::BIGINT AS event_id, NULL::DOUBLE AS cos, embedding FROM nodes WHERE parent_id IS NULL)"]
    for k in range(1, depth + 1):
        used = " UNION ALL ".join(f"SELECT theory_id, event_id FROM g{j}" for j in range(k))
        cos = _COS.format(a="p.embedding", b="w.embedding")
        grown.append(f"""f{k} AS MATERIALIZED (SELECT p.theory_id, p.node_id, w.id AS event_id, w.embedding, round({cos}, 9) AS cos FROM g{k - 1} p, world w WHERE w.embedding IS NOT NULL AND round({cos}, 9) >= {D.TAU}),
        o{k} AS (SELECT *, row_number() OVER (PARTITION BY theory_id, event_id ORDER BY cos DESC, node_id) AS o FROM f{k} WHERE (theory_id, event_id) NOT IN (SELECT (theory_id, event_id) FROM ({used}) WHERE event_id IS NOT NULL)),
        t{k} AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY cos DESC, event_id) AS n FROM o{k} WHERE o = 1),
        g{k} AS MATERIALIZED (SELECT theory_id, {k} AS depth, node_id AS parent_id, 1000000000000 * (theory_id + 1) + event_id AS node_id, event_id, cos, embedding FROM t{k} WHERE n <= {D.BRANCH})""")
    every = " UNION ALL ".join(f"SELECT theory_id, depth, parent_id, node_id, event_id, round(cos, 6) AS cos FROM g{k}" for k in range(depth + 1))
    return f", {', '.join(grown)} {every}"


def _feed(step: int) -> str:
    """Windows of an hour that begin every `step` minutes; closed ones end at or before the newest time less an hour."""
    shift = ", ".join(str(k) for k in range(60 // step))
    return f"""SELECT start, event_type, count(*) AS n FROM (SELECT event_type, (epoch_us(ts) // {step * 60_000_000} - k) * {step * 60_000_000} AS start FROM events, (SELECT unnest([{shift}]) AS k))
        WHERE start + 3600000000 <= ((SELECT max(epoch_us(ts)) FROM events) // 1000 - 3600000) * 1000 GROUP BY ALL"""


_QUERIES: dict[str, str] = {
    "scan_events": "SELECT id, source, title, length(body)::INT AS body_chars, epoch_us(observed_at) AS observed_at, len(embedding)::INT AS dim FROM world",
    "scan_theory_tables": "SELECT t.id, t.summary, (SELECT count(*) FROM nodes n WHERE n.theory_id = t.id) AS n_nodes, (SELECT count(*) FROM verdicts v JOIN nodes n ON n.id = v.node_id WHERE n.theory_id = t.id) AS n_verdicts FROM theories t",
    "ingest_events": "SELECT id, source, epoch_us(CASE WHEN id % 3 = 0 AND id % 4 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE observed_at END) AS observed_at FROM world",
    "ingest_events_stream": "SELECT event_id AS id, event_type, epoch_us(ts) AS observed_at FROM events",
    "fk_audit": """SELECT 'theories.root_event_id' AS fk, count(*) AS orphans FROM theories WHERE root_event_id NOT IN (SELECT CASE WHEN id % 11 = 0 THEN -id ELSE id END FROM world)
        UNION ALL SELECT 'theory_nodes.theory_id', count(*) FROM nodes WHERE theory_id NOT IN (SELECT CASE WHEN id = 4 THEN -id ELSE id END FROM theories)
        UNION ALL SELECT 'theory_nodes.parent_id', count(*) FROM nodes WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT CASE WHEN id % 7 = 0 THEN -id ELSE id END FROM nodes)
        UNION ALL SELECT 'lens_verdicts.node_id', count(*) FROM nodes CROSS JOIN registry WHERE id NOT IN (SELECT CASE WHEN id % 7 = 0 THEN -id ELSE id END FROM nodes)""",
    "schema_audit": """SELECT 'events' AS table_name, count(*) + count(*) FILTER (WHERE id % 10 = 1) AS n_rows, count(*) FILTER (WHERE id % 10 = 1) AS duplicate_pks,
        count(*) FILTER (WHERE embedding IS NULL) + count(*) FILTER (WHERE embedding IS NULL AND id % 10 = 1) AS null_values, count(*) FILTER (WHERE embedding IS NULL) + count(*) FILTER (WHERE embedding IS NULL AND id % 10 = 1) AS null_vectors, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong_dims FROM world
        UNION ALL SELECT 'theory_nodes', count(*), count(*) - count(DISTINCT id), 5 * count(*) - count(theory_id) - count(parent_id) - count(hypothesis) - count(score) - count(embedding), count(*) FILTER (WHERE embedding IS NULL), count(*) FILTER (WHERE len(embedding) <> 32) FROM nodes
        UNION ALL SELECT 'theories', count(*), count(*) - count(DISTINCT id), 4 * count(*) - count(root_event_id) - count(summary) - count(created_at), 0, 0 FROM theories
        UNION ALL SELECT 'lens_verdicts', count(*), count(*) - count(DISTINCT (node_id, lens_no)), 3 * count(*) - count(lens) - count(verdict) - count(severity), 0, 0 FROM verdicts""",
    "upsert_latest": "SELECT id AS node_id, round(CASE WHEN id % 3 = 0 THEN 1 - score ELSE score END, 6) AS score, (CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END)::INT AS scored_at FROM nodes",
    "list_events": "SELECT id, source, title, epoch_us(observed_at) AS observed_at FROM world WHERE observed_at >= TIMESTAMP '2024-01-01 06:00:00' ORDER BY world.observed_at DESC, id LIMIT 50",
    "query_theories": "SELECT t.id, t.root_event_id, w.title AS root_title, t.summary, b.confidence FROM theories t JOIN best b ON b.theory_id = t.id LEFT JOIN world w ON w.id = t.root_event_id WHERE b.confidence >= 0.3 AND contains(t.summary, 'e')",
    "active_theories": f"""SELECT t.id, CASE WHEN t.id > 0 THEN b.confidence END AS confidence, (SELECT count(*) FROM nodes n WHERE n.theory_id = t.id) AS n_nodes,
        (SELECT epoch_us(max(e.observed_at)) FROM evidence e JOIN nodes n ON n.id = e.node_id WHERE n.theory_id = t.id) AS newest FROM theories t LEFT JOIN best b ON b.theory_id = t.id WHERE t.id = 0 OR b.confidence IS NULL OR b.confidence >= {D.ACTIVE_FLOOR}""",
    "theory_detail": "SELECT v.node_id, w.depth, w.path, v.lens_no, v.lens, v.verdict, v.severity FROM walk w JOIN verdicts v ON v.node_id = w.id",
    "board_panel": "SELECT node_id, " + ", ".join(f"max(severity) FILTER (WHERE lens_no = {n}) AS {name}" for n, name, *_ in D.LENSES) + " FROM verdicts GROUP BY node_id",
    "event_feed_hourly": "SELECT epoch_us(date_trunc('hour', observed_at)) AS start, source, count(*) AS n FROM world GROUP BY ALL",
    "embed_events": _cells("title || ' ' || body", "world"),
    "embed_nodes": _cells("hypothesis", "nodes"),
    "reembed_queue": "SELECT id, CASE WHEN id % 3 = 0 THEN 'missing' WHEN id % 7 = 0 THEN 'stale' ELSE 'no_vector' END AS reason FROM world WHERE id % 3 = 0 OR id % 7 = 0 OR embedding IS NULL",
    "embed_udf": "SELECT id, (b - 1)::INT AS bucket, round(embedding[b] / sqrt(list_inner_product(embedding, embedding)), 5) AS value FROM world, (SELECT unnest(range(1, 65)) AS b) WHERE embedding IS NOT NULL",
    "vector_distances": f"""SELECT w.id AS a, n.id AS b, round({_COS.format(a='w.embedding', b='n.embedding')}, 6) AS cos, round(list_inner_product(w.embedding, n.embedding), 6) AS ip, round(list_distance(w.embedding, n.embedding), 6) AS l2
        FROM world w JOIN nodes n ON w.id - w.id % 5 = n.id WHERE w.embedding IS NOT NULL""",
    "knn_events": f"""SELECT node_id, rank, event_id, round(cos, 6) AS cos FROM (SELECT node_id, event_id, cos, row_number() OVER (PARTITION BY node_id ORDER BY cos DESC, event_id)::INT AS rank FROM (
        SELECT n.id AS node_id, w.id AS event_id, round({_COS.format(a='n.embedding', b='w.embedding')}, 9) AS cos FROM nodes n, world w WHERE w.embedding IS NOT NULL)) WHERE rank <= {D.K}""",
    "link_related_theories": f"SELECT theory_a, theory_b, round(max(cos), 6) AS max_cos, count(*) AS n_pairs FROM pairs WHERE theory_a < theory_b AND cos >= {D.TAU_LINK} GROUP BY ALL",
    "related_theories_topk": f"""SELECT a AS node_id, rank, b AS other_id, round(cos, 6) AS cos FROM (SELECT a, b, cos, row_number() OVER (PARTITION BY a ORDER BY cos DESC, b)::INT AS rank FROM pairs WHERE theory_a <> theory_b) WHERE rank <= {D.K}""",
    "link_evidence": f"SELECT node_id, event_id, {_six('cos')} AS cos, stance, epoch_us(observed_at) AS observed_at, source FROM evidence",
    "create_theories": "SELECT id, id AS root_event_id, title AS summary, NULL::DOUBLE AS confidence, epoch_us(observed_at) AS created_at, id AS root_node_id, 0 AS depth FROM world",
    "tree_depth": "SELECT id, theory_id, depth FROM walk",
    "tree_frontier": "SELECT node_id, theory_id, depth, children, slots FROM open_nodes",
    "expand_level": """SELECT parent_id, theory_id, event_id, child_depth, round(cos, 6) AS cos FROM (SELECT o.node_id AS parent_id, o.theory_id, e.event_id, o.depth + 1 AS child_depth, e.cos, o.slots,
        row_number() OVER (PARTITION BY o.node_id ORDER BY e.cos DESC, e.event_id) AS k FROM open_nodes o JOIN evidence e USING (node_id) WHERE e.stance = 1) WHERE k <= slots""",
    "prune_tree": "SELECT n.id, n.theory_id, n.score FROM nodes n JOIN kept USING (id)",
    "budget_audit": """, part AS (SELECT id, CASE WHEN id % 17 = 0 AND parent_id IS NOT NULL THEN -1 ELSE parent_id END AS parent_id FROM nodes),
        steps AS (SELECT id, 0 AS depth FROM part WHERE parent_id IS NULL UNION ALL SELECT p.id, s.depth + 1 FROM steps s JOIN part p ON p.parent_id = s.id)
        SELECT 'too_deep' AS kind, id AS node_id FROM steps WHERE depth > 2 UNION ALL SELECT 'too_wide', parent_id FROM part WHERE parent_id IS NOT NULL GROUP BY parent_id HAVING count(*) > 2
        UNION ALL SELECT 'unreachable', id FROM part WHERE id NOT IN (SELECT id FROM steps)""",
    "tree_paths": "SELECT id, theory_id, path, row_number() OVER (PARTITION BY theory_id ORDER BY path)::INT AS position FROM walk",
    "subtree_rollup": "SELECT a AS id, count(*) AS size, max(score) AS max_score, round(avg(score), 6) AS mean_score FROM (SELECT id, unnest(chain) AS a FROM walk) JOIN nodes USING (id) GROUP BY a",
    "key_audit": """SELECT kind, node_id FROM (
        WITH RECURSIVE moved AS MATERIALIZED (SELECT id, theory_id, CASE WHEN id % 35 = 0 THEN id WHEN id % 17 = 0 AND parent_id IS NOT NULL THEN -1 WHEN id % 13 = 0 AND parent_id IS NOT NULL THEN (id + 5) % 25 ELSE parent_id END AS parent_id FROM nodes),
        above(id, up) AS (SELECT id, parent_id FROM moved WHERE parent_id IS NOT NULL UNION SELECT a.id, m.parent_id FROM above a JOIN moved m ON m.id = a.up WHERE m.parent_id IS NOT NULL)
        SELECT 'cycle' AS kind, id AS node_id FROM above WHERE id = up
        UNION ALL SELECT 'repeated', id FROM moved WHERE id % 55 = 0
        UNION ALL SELECT 'no_parent', m.id FROM moved m LEFT JOIN moved p ON p.id = m.parent_id WHERE m.parent_id IS NOT NULL AND p.id IS NULL
        UNION ALL SELECT 'other_theory', m.id FROM moved m JOIN moved p ON p.id = m.parent_id WHERE p.theory_id <> m.theory_id)""",
    "expand_to_budget": _expanded(D.DEPTH),
    "branch_stats": """SELECT w.theory_id, w.depth, count(*) AS n_nodes, count(*) FILTER (WHERE k.n IS NULL) AS leaves, round(avg(coalesce(k.n, 0)), 6) AS mean_children, max(coalesce(k.n, 0)) AS max_children, round(avg(n.score), 6) AS mean_score
        FROM walk w JOIN nodes n USING (id) LEFT JOIN kids k USING (id) GROUP BY w.theory_id, w.depth""",
    "lens_dispatch": "SELECT id AS node_id, lens_no, lens FROM nodes CROSS JOIN registry",
    **{f"lens_{name}": _lens(n) for n, name, *_ in D.LENSES},
    "board_run": "SELECT * FROM verdicts",
    "board_summary": "SELECT node_id, n_pass, n_concern, n_fail, n_insufficient, round(mean_severity, 6) AS mean_severity, max_severity, round(resilience, 6) AS resilience FROM summary",
    "worst_lens": "SELECT node_id, lens, severity FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY severity DESC, lens_no) AS k FROM verdicts WHERE severity IS NOT NULL) WHERE k = 1",
    "board_queue": "SELECT node_id, lens_no, lens FROM verdicts WHERE (node_id + lens_no) % 3 = 0",
    "lens_profile": """SELECT theory_id, lens, grouping(theory_id, lens) AS level, count(*) FILTER (WHERE verdict = 'pass') AS n_pass, count(*) FILTER (WHERE verdict = 'concern') AS n_concern, count(*) FILTER (WHERE verdict = 'fail') AS n_fail,
        count(*) FILTER (WHERE verdict = 'insufficient') AS n_insufficient, round(quantile_cont(severity, 0.25) + 1e-9, 6) AS q1, round(quantile_cont(severity, 0.5) + 1e-9, 6) AS median, round(quantile_cont(severity, 0.75) + 1e-9, 6) AS q3
        FROM verdicts JOIN nodes n ON n.id = node_id GROUP BY ROLLUP (theory_id, lens)""",
    "custom_lens": """, age AS (SELECT node_id, round(least(1, (epoch_us((SELECT max(observed_at) FROM evidence)) - epoch_us(max(observed_at))) / 3.6e9 / 72), 6) AS severity FROM evidence WHERE stance = 1 GROUP BY node_id)
        SELECT * FROM verdicts UNION ALL SELECT n.id, 8, 'support_staleness', CASE WHEN severity IS NULL THEN 'insufficient' WHEN severity >= 0.5 THEN 'fail' WHEN severity >= 0.1 THEN 'concern' ELSE 'pass' END, severity FROM nodes n LEFT JOIN age ON age.node_id = n.id""",
    "plausibility": "SELECT node_id, round(plausibility, 6) AS plausibility FROM plaus",
    "novelty": "SELECT node_id, round(novelty, 6) AS novelty FROM novel",
    "confidence": "SELECT node_id, round(resilience, 6) AS resilience, round(plausibility, 6) AS plausibility, round(novelty, 6) AS novelty, confidence FROM scores",
    "theory_confidence": "SELECT * FROM best",
    "rank_hypotheses": """SELECT n.theory_id, s.node_id, s.confidence, rank() OVER (PARTITION BY n.theory_id ORDER BY s.confidence DESC)::INT AS rank, dense_rank() OVER (PARTITION BY n.theory_id ORDER BY s.confidence DESC)::INT AS dense_rank,
        round(s.confidence - lead(s.confidence) OVER (PARTITION BY n.theory_id ORDER BY s.confidence DESC, s.node_id), 6) AS margin FROM scores s JOIN nodes n ON n.id = s.node_id""",
    "confidence_history": """, per AS (SELECT node_id, date_trunc('hour', observed_at) AS hour, sum(CASE WHEN stance = 1 THEN abs(cos) * r ELSE 0 END) AS s, sum(CASE WHEN stance = -1 THEN abs(cos) * r ELSE 0 END) AS c FROM evidence JOIN source_quality USING (source) GROUP BY ALL),
        run AS (SELECT node_id, hour, (sum(s) OVER w + 1) / (sum(s) OVER w + sum(c) OVER w + 2) AS p FROM per WINDOW w AS (PARTITION BY node_id ORDER BY hour ROWS UNBOUNDED PRECEDING))
        SELECT node_id, epoch_us(hour) AS hour, round(p, 6) AS plausibility, round(p - lag(p) OVER (PARTITION BY node_id ORDER BY run.hour), 6) AS change FROM run""",
    "calibration_bins": "SELECT bin, n, round(mean_confidence, 6) AS mean_confidence, round(observed, 6) AS observed, round(gap, 6) AS gap FROM bins",
    "calibration_scores": """SELECT count(*) AS n, round(avg((confidence - outcome) * (confidence - outcome)), 6) AS brier, round((SELECT sum(n * abs(gap)) / sum(n) FROM bins), 6) AS ece,
        round(1 - avg((confidence - outcome) * (confidence - outcome)) / (avg(outcome) * (1 - avg(outcome))), 6) AS skill FROM joined_outcomes""",
    "new_evidence": "SELECT node_id, event_id, round(cos, 6) AS cos, stance, epoch_us(observed_at) AS observed_at FROM fresh",
    "affected_theories": "SELECT id, summary FROM theories WHERE id IN (SELECT n.theory_id FROM fresh f JOIN nodes n ON n.id = f.node_id)",
    "rescore_merge": """, due AS (SELECT DISTINCT n.theory_id FROM fresh f JOIN nodes n ON n.id = f.node_id)
        SELECT s.node_id, CASE WHEN d.theory_id IS NOT NULL THEN s.confidence ELSE round(s.plausibility, 6) END AS confidence, CASE WHEN d.theory_id IS NOT NULL THEN 2 ELSE 1 END::BIGINT AS scored_at FROM scores s JOIN nodes n ON n.id = s.node_id LEFT JOIN due d ON d.theory_id = n.theory_id""",
    "refine_due": "SELECT id, has_new, overdue FROM (SELECT id, id IN (SELECT n.theory_id FROM fresh f JOIN nodes n ON n.id = f.node_id) AS has_new, id > 2.5 AS overdue FROM theories) WHERE has_new OR overdue",
    "refine_stream": "SELECT node_id, round(resilience, 6) AS resilience, round(plausibility, 6) AS plausibility, round(novelty, 6) AS novelty, confidence FROM scores WHERE node_id IN (SELECT n.id FROM nodes n WHERE n.theory_id IN (SELECT m.theory_id FROM nodes m JOIN evidence e ON e.node_id = m.id))",
    "evidence_state_stream": f"""SELECT node_id, count(*) FILTER (WHERE stance = 1) AS n_support, count(*) FILTER (WHERE stance = -1) AS n_contra, {_six('CASE WHEN stance = 1 THEN cos ELSE 0 END', 'sum')} AS s,
        {_six('CASE WHEN stance = -1 THEN -cos ELSE 0 END', 'sum')} AS c FROM evidence GROUP BY node_id""",
    "feed_stream_windows": _feed(60),
    "feed_stream_sliding": _feed(15),
    "event_bursts": """, marked AS (SELECT source, observed_at, CASE WHEN observed_at - lag(observed_at) OVER (PARTITION BY source ORDER BY observed_at) < INTERVAL 90 MINUTE THEN 0 ELSE 1 END AS first FROM world),
        numbered AS (SELECT source, observed_at, sum(first) OVER (PARTITION BY source ORDER BY observed_at ROWS UNBOUNDED PRECEDING) AS burst FROM marked)
        SELECT source, epoch_us(min(observed_at)) AS start, epoch_us(max(observed_at)) AS "end", count(*) AS n FROM numbered GROUP BY source, burst""",
    "late_events": """SELECT id, epoch_us(observed_at) AS observed_at, arrival_seq FROM (SELECT *, max(observed_at) OVER (ORDER BY arrival_seq, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest
        FROM (SELECT id, observed_at, CASE WHEN id % 7 = 0 THEN id + 40 ELSE id END AS arrival_seq FROM world)) late WHERE late.observed_at < newest - INTERVAL 10 MINUTE""",
    "render_lens_requests": """SELECT n.id AS node_id, r.lens, 'Hypothesis: ' || n.hypothesis || chr(10) || 'Question: ' || q.question || chr(10) || 'Evidence: ' || coalesce(t.titles, 'none') AS prompt
        FROM nodes n CROSS JOIN registry r JOIN (VALUES {questions}) AS q(lens, question) ON q.lens = r.lens LEFT JOIN top_titles t ON t.node_id = n.id WHERE (n.id + r.lens_no) % 3 = 0""",
    "render_theory_requests": """SELECT o.node_id, 'Hypothesis: ' || n.hypothesis || chr(10) || 'Propose ' || o.slots || ' refinements.' || chr(10) || 'Evidence: ' || coalesce(t.titles, 'none') AS prompt
        FROM open_nodes o JOIN nodes n ON n.id = o.node_id LEFT JOIN top_titles t ON t.node_id = o.node_id
        UNION ALL SELECT n.id, 'Theory: ' || h.summary || chr(10) || 'Refine it in the light of the evidence.' || chr(10) || 'Evidence: ' || coalesce(t.titles, 'none')
        FROM theories h JOIN nodes n ON n.theory_id = h.id AND n.parent_id IS NULL LEFT JOIN top_titles t ON t.node_id = n.id WHERE h.id IN (SELECT m.theory_id FROM fresh f JOIN nodes m ON m.id = f.node_id)""",
    "parse_verdicts": """, told AS (SELECT id, score, CASE WHEN id % 35 = 0 THEN 'astrology' ELSE 'base_rate' END AS lens, CASE WHEN id % 25 = 0 THEN 'bad_json' WHEN id % 35 = 0 THEN 'unknown_lens' WHEN id % 15 = 0 THEN 'unknown_verdict' WHEN id % 10 = 0 THEN 'bad_severity' END AS reason FROM nodes)
        SELECT id AS request_id, lens, CASE WHEN reason IS NULL THEN 'concern' END AS verdict, CASE WHEN reason IS NULL THEN score END AS severity, CASE WHEN reason IS NULL THEN 'seen' END AS rationale, reason FROM told""",
    "retry_ledger": """, tries AS (SELECT id // 5 + CASE WHEN (id // 5) % 2 = 0 AND id % 5 > 2 THEN 1000000000 ELSE 0 END AS request_id, (id % 5)::INT AS attempt, id % 9 = 1 AS ok, observed_at AS moment FROM world),
        latest AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY attempt DESC) AS k FROM tries)
        SELECT request_id, attempt, CASE WHEN ok THEN 'done' WHEN attempt < 4 THEN 'retry' ELSE 'dead' END AS status, CASE WHEN NOT ok AND attempt < 4 THEN epoch_us(moment) + (30000000 * pow(2, attempt - 1))::BIGINT END AS next_at FROM latest WHERE k = 1""",
}


def oracle_sql() -> dict[str, str]:
    from hypotree.operators.requests import QUESTIONS

    questions = ", ".join(f"('{k}', '{v}')" for k, v in QUESTIONS.items())
    out = {}
    for name, select in _QUERIES.items():
        sql = _with(select.replace("{questions}", questions))
        head, _, rest = sql.partition(" , ") if select.startswith(",") else (sql, "", "")
        out[name] = f"{head}, {rest}" if rest else sql
    return out
