"""Building blocks of the checking SQL: the logical inputs as common table expressions."""

CTES = {
    "samples": "SELECT vec_id AS image_id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings",
    "flat": "SELECT image_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM samples",
    "centre": "SELECT list(m ORDER BY pos) AS c FROM (SELECT pos, avg(x) AS m FROM flat GROUP BY pos)",
    "dist": "SELECT image_id, label, list_distance(embedding, c) AS distance FROM samples, centre",
    "points": "SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(label AS VARCHAR) AS label FROM embeddings",
    "probs_raw": "SELECT vec_id AS task_id, list_transform([embedding[1], embedding[2], embedding[3]], lambda x: exp(CAST(x AS DOUBLE))) AS w FROM embeddings",
    "predictions": "SELECT task_id, list_transform(w, lambda x: x / list_sum(w)) AS probs FROM probs_raw",
    "members_raw": "SELECT vec_id AS task_id, m, list_transform(embedding[3*m+1:3*m+3], lambda x: exp(CAST(x AS DOUBLE))) AS w FROM embeddings, range(5) r(m)",
    "members": "SELECT task_id, m, list_transform(w, lambda x: x / list_sum(w)) AS p FROM members_raw",
    "annotations": "SELECT event_id AS id, event_id // 5 AS task_id, user_id % 12 AS annotator_id, event_type AS label, value AS lead_time, ts AS created_at FROM events",
    "last_labels": "SELECT task_id, annotator_id, arg_max(label, (created_at, id)) AS label FROM annotations GROUP BY 1, 2",
    "pairs": "SELECT a.task_id, a.annotator_id AS a1, b.annotator_id AS a2, a.label AS l1, b.label AS l2 FROM last_labels a JOIN last_labels b ON a.task_id = b.task_id AND a.annotator_id < b.annotator_id",
    "first_at": "SELECT task_id, min(created_at) AS first_at FROM annotations GROUP BY 1",
    "tasks": "SELECT e.event_id AS id, coalesce(f.first_at - to_hours(CAST(e.event_id % 48 AS INTEGER)), TIMESTAMP '2024-01-01') AS created_at FROM events e LEFT JOIN first_at f ON f.task_id = e.event_id WHERE e.event_id < (SELECT count(*) // 4 FROM events)",
    "numeric": "SELECT 'l_quantity' AS feature, l_quantity AS value, l_shipdate < TIMESTAMP '1998-06-01' AS is_ref FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice, l_shipdate < TIMESTAMP '1998-06-01' FROM lineitem UNION ALL SELECT 'l_discount', l_discount, l_shipdate < TIMESTAMP '1998-06-01' FROM lineitem",
    "ev": "SELECT 'value' AS feature, value, ts < TIMESTAMP '2024-01-16' AS is_ref FROM events",
    "ev_labels": "SELECT event_type AS label, ts < TIMESTAMP '2024-01-16' AS is_ref FROM events",
    "weekly": "SELECT event_type || '-' || CAST(w AS VARCHAR) AS report_id, event_type AS project, w AS week, round(avg(value) / 500, 6) AS overall_score, count(*) FILTER (WHERE value > 200) AS issue_count, max(ts) AS created_at, CASE WHEN w % 2 = 0 THEN 'scheduled' ELSE 'manual' END AS report_type FROM (SELECT *, datediff('minute', TIMESTAMP '2024-01-01', ts) // 10080 AS w FROM events) GROUP BY event_type, w",
    "user_turns": "SELECT conv_id, turn, text AS prompt FROM conversations WHERE role = 'user'",
    "answers": "SELECT conv_id, turn - 1 AS turn, text AS answer FROM conversations WHERE role = 'assistant'",
    "pref": "SELECT u.conv_id, u.turn, prompt, a.answer AS chosen, b.answer AS rejected, 0.5 + (u.conv_id % 50) / 100 AS confidence, u.turn + 1 AS turn_length FROM user_turns u LEFT JOIN answers a ON a.conv_id = u.conv_id AND a.turn = u.turn LEFT JOIN answers b ON b.conv_id = u.conv_id + 1 AND b.turn = u.turn",
    "traj": "SELECT user_id AS traj_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value / 100 AS s1, hour(ts) / 24.0 AS s2, coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) / 100 AS s3 FROM events",
}

# What each expression reads, so that a query names only what it uses itself.
NEEDS = {
    "flat": ["samples"], "centre": ["flat"], "dist": ["centre"],
    "predictions": ["probs_raw"], "members": ["members_raw"],
    "last_labels": ["annotations"], "pairs": ["last_labels"], "first_at": ["annotations"], "tasks": ["first_at"],
    "pref": ["user_turns", "answers"],
}


def sql(body: str, *names: str, **extra: str) -> str:
    """``WITH`` the named inputs (and what they need), then the query's own steps, then ``body``."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    steps = [f"{n} AS ({CTES[n]})" for n in ordered] + [f"{n} AS ({q})" for n, q in extra.items()]
    return (f"WITH RECURSIVE {', '.join(steps)} " if steps else "") + body
