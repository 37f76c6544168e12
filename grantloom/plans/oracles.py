"""DuckDB SQL for the rows of each query in queries.py."""

from __future__ import annotations

from grantloom.plans.projection import PROJECTION_SQL


def _dated(months: str, offset: str, suffix: str) -> str:
    return f"CAST(CAST({months} {offset} AS DATE) AS VARCHAR) || '{suffix}'"


_WITH = f"WITH {PROJECTION_SQL}"
_START = "start + INTERVAL (m1 - 1) MONTH"
_END = "(start + INTERVAL (m2 - 1) MONTH) + INTERVAL 1 MONTH - INTERVAL 1 DAY"
_ATTACHED = """,
    met AS (SELECT d.proposal, d.wp_id, d.n AS d_n, d.id AS deliverable_id, d.name, d.due_month, t.n AS t_n, t.id AS task_id, abs(t.m2 - d.due) AS distance FROM deliv d JOIN task t ON d.proposal = t.proposal AND d.wp_id = t.wp_id AND d.due BETWEEN t.m1 AND t.m2),
    near AS (SELECT *, row_number() OVER (PARTITION BY proposal, wp_id, d_n ORDER BY distance, t_n) AS rank FROM met QUALIFY rank <= 3)"""
_KEPT = """,
    kept AS (SELECT proposal, wp_id, person_months FROM effort WHERE company = 'S1' AND person_months > 0),
    own AS (SELECT task.*, CASE WHEN partners[1] = 'S1' THEN 'leader' ELSE 'participant' END AS role FROM task SEMI JOIN kept USING (proposal, wp_id) WHERE list_contains(partners, 'S1'))"""

ORACLES: dict[str, str] = {
    "clean_text": r"SELECT p_partkey, trim(regexp_replace('  ' || p_name || chr(10) || p_type, '\s+', ' ', 'g')) AS text FROM part",
    "norm_cell": r"SELECT p_partkey, upper(regexp_replace(trim(p_name || '   ' || p_brand), '\s+', ' ', 'g')) AS cell FROM part",
    "month_token": """
        WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_quantity) AS INTEGER) AS n FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_partkey, CASE n % 4 WHEN 0 THEN 'M' || n WHEN 1 THEN '' || n WHEN 2 THEN ' m' || n || ' ' ELSE 'x' || n END AS raw,
               CASE WHEN n % 4 = 3 THEN '' ELSE 'M' || CASE WHEN n < 10 THEN '0' ELSE '' END || n END AS token, CAST(n AS BIGINT) AS number FROM r""",
    "to_float": "SELECT c_custkey, CAST(abs(CAST(c_acctbal AS DECIMAL(20,2))) AS DOUBLE) AS value FROM customer",
    "partner_match": f"{_WITH} SELECT proposal, id, list_contains(partners, 'S1') AS matches, partners[1] AS first FROM task",
    "deliv_id_expand": """
        WITH r AS (SELECT l_orderkey, l_partkey, l_linenumber, CAST(floor(l_quantity) AS INTEGER) AS q, CAST(l_linenumber AS INTEGER) AS n FROM lineitem),
        s AS (SELECT *, q % 3 AS w, n + q % 5 - 1 AS m FROM r)
        SELECT l_orderkey, l_partkey, l_linenumber, 'D' || w || '.' || n || CASE WHEN q % 2 = 0 THEN ' – ' ELSE ', ' END || 'd' || w || '.' || m AS cell,
               CASE WHEN q % 2 = 0 AND n <= m THEN array_to_string(list_transform(range(n, m + 1), lambda x: 'D' || w || '.' || x), ';') ELSE 'D' || w || '.' || n || ';D' || w || '.' || m END AS ids FROM s""",
    "planner_dates": f"{_WITH} SELECT proposal, id, {_dated(_START, '', 'T17:00:00Z')} AS starts, {_dated(_END, '', 'T17:00:00Z')} AS ends, {_dated(_END, '', 'T08:00:00Z')} AS due FROM task",
    "slug_color": "SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name || ': ' || p_type || '!'), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'proposal') AS slug, substr(md5(p_brand), 1, 6) AS color FROM part",
    "toc_pages": r"SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '\. ', '.... 7' || chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '\.{4,}\s*[0-9]+'))) >= 5 AS toc FROM documents",
    "months_ranges": f"{_WITH}, r AS (SELECT proposal, id, CASE WHEN n % 3 = 0 THEN '' ELSE start_month END AS a, CASE WHEN n % 5 = 0 THEN '' ELSE end_month END AS b FROM task) SELECT proposal, id, CASE WHEN a <> '' AND b <> '' THEN a || '–' || b ELSE a || b END AS months FROM r",
    "progress_percent": f"{_WITH} SELECT proposal, 'WP' || k AS wp_id, CAST(least(40 + floor(45.0 * k / count(*) OVER (PARTITION BY proposal)), 85) AS INTEGER) AS percent FROM wp",
    "section_span": """
        WITH s AS (SELECT *, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS low, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS high FROM conversations)
        SELECT conv_id, min(turn) AS first_page, max(turn) AS last_page, count(*) AS pages FROM s WHERE turn BETWEEN low AND high GROUP BY conv_id""",
    "zone_latch": """
        WITH o AS (SELECT *, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS opened FROM events),
        s AS (SELECT *, coalesce(max(CASE WHEN event_type = 'error' AND opened = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM o)
        SELECT user_id, event_id FROM s WHERE opened = 1 AND stopped = 0""",
    "section_islands": """
        WITH s AS (SELECT *, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM events)
        SELECT user_id, section, min(event_id) AS first_event, count(*) AS events FROM s WHERE section > 0 GROUP BY user_id, section""",
    "chunk_lead": "SELECT user_id, event_id, until FROM (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events) WHERE event_type = 'view'",
    "positional_zip": f"""{_WITH},
        a AS (SELECT proposal, 'WP' || k AS wp_id, k AS place FROM wp),
        b AS (SELECT proposal, l_quantity, row_number() OVER (PARTITION BY proposal ORDER BY o_orderkey DESC) AS place FROM line WHERE n = 1)
        SELECT proposal, wp_id, l_quantity AS effort FROM a JOIN b USING (proposal, place) WHERE l_quantity >= 10""",
    "best_dedup": f"""{_WITH},
        s AS (SELECT proposal, 't' || n AS id, k, n, CAST(CASE WHEN k % 3 = 0 THEN 0 ELSE 10 END + CASE WHEN k % 2 = 0 THEN 0 ELSE 10 END + 5 + length(description) // 50 AS INTEGER) AS score FROM task)
        SELECT proposal, id, k, score FROM (SELECT *, row_number() OVER (PARTITION BY proposal, id ORDER BY score DESC, k, n) AS r FROM s) WHERE r = 1""",
    "first_dedup": f"{_WITH} SELECT proposal, n AS task, min(k) AS k, min_by(title, k) AS title FROM task GROUP BY proposal, n",
    "last_dedup": f"{_WITH} SELECT proposal, n AS task, max(k) AS k, max_by(title, k) AS title FROM task GROUP BY proposal, n",
    "vote_priority": """
        WITH v AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'section3_body' WHEN 'signup' THEN 'section3_start' WHEN 'view' THEN 'toc_or_index' ELSE 'other' END AS label, count(*) AS n FROM events GROUP BY ALL)
        SELECT user_id, label, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, list_position(['section3_start', 'section3_body', 'toc_or_index', 'other'], label)) AS r FROM v) WHERE r = 1""",
    "wp_left_join": f"""{_WITH}{_KEPT}
        SELECT proposal, wp_id, person_months, coalesce(i.title, '') AS title, coalesce(leader, '') AS leader, CASE WHEN leader = 'S1' THEN 'leader' ELSE 'participant' END AS role, coalesce(start_month, '') AS start, coalesce(end_month, '') AS "end"
        FROM kept LEFT JOIN (SELECT * FROM info WHERE leader <> 'S2') i USING (proposal, wp_id)""",
    "task_semi": f"{_WITH}{_KEPT} SELECT proposal, wp_id, id, role FROM own",
    "deliv_range_topk": f"{_WITH}{_ATTACHED} SELECT proposal, wp_id, deliverable_id, task_id, CAST(distance AS BIGINT) AS distance, rank FROM near",
    "work_packages_flat": f"""{_WITH}{_KEPT},
        met AS (SELECT d.proposal, d.wp_id, d.n AS d_n, d.id AS deliverable_id, t.n AS t_n, abs(t.m2 - d.due) AS distance FROM deliv d JOIN own t ON d.proposal = t.proposal AND d.wp_id = t.wp_id AND d.due BETWEEN t.m1 AND t.m2),
        near AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY proposal, wp_id, d_n ORDER BY distance, t_n) <= 3),
        by_task AS (SELECT proposal, wp_id, t_n AS n, string_agg(deliverable_id, '+' ORDER BY d_n) AS d FROM near GROUP BY ALL),
        nested AS (SELECT proposal, wp_id, string_agg(id || '=' || coalesce(d, ''), ',' ORDER BY n) AS tasks FROM own LEFT JOIN by_task USING (proposal, wp_id, n) GROUP BY ALL)
        SELECT proposal, wp_id, i.title, leader, CASE WHEN leader = 'S1' THEN 'leader' ELSE 'participant' END AS role, person_months, start_month AS start, end_month AS "end", coalesce(tasks, '') AS tasks
        FROM kept JOIN info i USING (proposal, wp_id) LEFT JOIN nested USING (proposal, wp_id)""",
    "planner_buckets": f"{_WITH} SELECT proposal, wp_id AS external_id, trim(wp_id || ' - ' || title, ' -') AS name FROM info",
    "planner_tasks": f"{_WITH} SELECT proposal, id AS external_id, wp_id AS bucket_external_id, id || ' - ' || title AS title, {_dated(_START, '', 'T17:00:00Z')} AS start_date_time, {_dated(_END, '', 'T17:00:00Z')} AS due_date_time FROM task",
    "planner_checklist": f"{_WITH}{_ATTACHED} SELECT proposal, wp_id, task_id AS task_external_id, deliverable_id || ' - ' || name || ' (' || due_month || ')' AS title FROM near",
    "gh_milestones": f"""{_WITH}, st AS (SELECT DISTINCT proposal, start FROM wp), e AS (SELECT info.*, start, CAST(substr(end_month, 2) AS INTEGER) AS m2 FROM info JOIN st USING (proposal))
        SELECT proposal, wp_id AS external_id, 'Proposal Plan · ' || wp_id || ' · ' || title AS title, {_dated(_END, '', 'T08:00:00Z')} AS due_on FROM e""",
    "gh_labels": f"""{_WITH}{_KEPT},
        l AS (SELECT 'proposal:proposal-plan' AS name, 'proposal' AS description FROM own UNION SELECT 'role:' || role, 'role' FROM own UNION SELECT unnest(partners), 'partner' FROM own)
        SELECT name, description, substr(md5(name), 1, 6) AS color FROM l""",
    "gh_issues": f"""{_WITH}{_KEPT}
        SELECT proposal, id AS external_id, wp_id AS milestone_external_id, 'Proposal Plan · ' || id || ' · ' || title AS title,
               '**Schedule:** ' || start_month || '–' || end_month || chr(10) || '**Role:** ' || role || chr(10) || '**Partners:** ' || array_to_string(partners, ', ') || chr(10) || chr(10) || description AS body,
               'proposal:proposal-plan,role:' || role || ',' || array_to_string(partners, ',') AS labels FROM own""",
    "label_anti": """
        WITH l AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'S' ELSE 's' END || l_suppkey AS name, l_suppkey AS key, l_orderkey AS o, l_linenumber AS n FROM lineitem)
        SELECT arg_min(name, (o, n)) AS name, 'partner' AS description, 'ffffff' AS color FROM l WHERE key NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0) GROUP BY key""",
    "answer_tasks": """
        SELECT o_custkey AS proposal, 'T' || o_orderkey AS id, 'WP' || o_custkey AS wp_id, o_orderpriority AS title, 'M' || lpad('' || (o_orderkey % 12 + 1), 2, '0') AS start_month,
               CASE o_orderkey % 6 WHEN 2 THEN NULL WHEN 4 THEN '12' ELSE 'M14' END AS end_month, CASE WHEN o_orderkey % 6 = 3 THEN 'S1+S2' ELSE '' END AS partners, 'a "b"' AS description
        FROM orders WHERE o_custkey % 5 NOT IN (1, 2) AND o_orderkey % 6 NOT IN (0, 1, 5)""",
    "clean_documents": r"""
        WITH t AS (SELECT doc_id, trim(regexp_replace(nfc_normalize(coalesce(text, '')), '[\s\x0B]+', ' ', 'g')) AS t FROM documents)
        SELECT doc_id, CAST(length(t) AS BIGINT) AS chars, CAST(len(list_filter(string_split(t, ' '), lambda x: x <> '')) AS BIGINT) AS words FROM t""",
    "milestone_lookup": """
        WITH r AS (SELECT p_name AS title, max(p_partkey) AS number FROM part WHERE p_partkey % 3 = 0 GROUP BY p_name)
        SELECT title, p_partkey, number, CASE WHEN number IS NULL THEN 'create' ELSE 'skip' END AS action FROM (SELECT p_partkey, p_name AS title FROM part) LEFT JOIN r USING (title)""",
    "issue_push_plan": """
        WITH i AS (SELECT l_suppkey AS milestone, 'Part ' || l_partkey AS title, lpad('' || l_orderkey, 12, '0') || '-' || lpad('' || l_linenumber, 12, '0') || '-' || lpad('' || l_partkey, 12, '0') AS external_id FROM lineitem),
        r AS (SELECT l_suppkey AS milestone, 'Part ' || l_partkey AS title, max(l_orderkey) AS number FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> 'O' GROUP BY ALL),
        f AS (SELECT *, min(external_id) OVER (PARTITION BY milestone, title) AS first FROM i)
        SELECT milestone, title, external_id, number, CASE WHEN number IS NOT NULL OR external_id <> first THEN 'skip' ELSE 'create' END AS action FROM f LEFT JOIN r USING (milestone, title)""",
}
ORACLES["issue_push_counts"] = f"""SELECT milestone, count(*) FILTER (action = 'create') AS created, count(*) FILTER (action = 'skip') AS skipped FROM ({ORACLES["issue_push_plan"]}) GROUP BY milestone"""
