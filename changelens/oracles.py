"""DuckDB SQL that the registered queries equal."""

from __future__ import annotations

# Model tables, from the star-schema tables.
MODEL = {
    "installations": """SELECT s_suppkey AS installation_id, 'org' || s_suppkey AS account_login, 'u' || s_nationkey AS owner_user_id,
        CASE s_suppkey % 7 WHEN 0 THEN 'deleted' WHEN 1 THEN 'suspended' ELSE 'active' END AS status,
        1700000000 + s_suppkey * 3600 AS created_s FROM supplier""",
    "repositories": """SELECT c_custkey AS github_repo_id, 'repo-' || c_custkey AS id, c_custkey % 97 + 1 AS installation_id,
        'o' || (c_custkey % 20) || '/r' || c_custkey AS full_name, c_custkey % 3 <> 0 AS auto_review_enabled, c_custkey % 11 <> 0 AS active,
        CASE WHEN c_custkey % 5 <> 0 THEN sha1(c_custkey::VARCHAR) END AS indexed_sha,
        CASE WHEN c_custkey % 6 <> 0 THEN 'https://host.example/o' || (c_custkey % 20) || '/r' || c_custkey END AS html_url FROM customer""",
    "reviews": """SELECT o_orderkey AS id, 'o' || (o_custkey % 20) || '/r' || o_custkey AS repo_full_name, (o_orderkey % 97 + 1)::INT AS pr_number,
        sha1(o_orderkey::VARCHAR) AS head_sha, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O'
        THEN CASE WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'in_progress' END WHEN o_orderkey % 4 = 0 THEN 'failed' ELSE 'completed' END AS status,
        CASE WHEN o_orderkey % 13 <> 0 THEN floor(o_totalprice)::BIGINT % 101 END AS score,
        CASE WHEN o_orderkey % 9 <> 0 THEN 'Change ' || o_orderkey END AS pr_title,
        CASE WHEN o_orderkey % 8 <> 0 THEN o_custkey % 97 + 1 END AS installation_id, (o_orderkey % 5)::INT AS attempts, o_orderdate AS created_at,
        epoch(o_orderdate)::BIGINT + o_orderkey % 3000 AS updated_s, epoch(o_orderdate)::BIGINT + 3600 + o_orderkey % 500 AS completed_s FROM orders""",
    "review_findings": """SELECT l_orderkey AS review_id, l_linenumber AS ord,
        md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus, l_returnflag)) AS id,
        CASE WHEN l_partkey % 29 <> 0 THEN 'src/p' || (l_partkey % 50) || '.ts' END AS file,
        CASE WHEN l_partkey % 17 <> 0 THEN (l_partkey % 40 + 1)::INT END AS line,
        CASE WHEN l_quantity < 8 THEN 'critical' WHEN l_quantity < 20 THEN 'high' WHEN l_quantity < 35 THEN 'medium' ELSE 'low' END AS severity,
        CASE l_partkey % 5 WHEN 0 THEN 'security' WHEN 1 THEN 'bug' WHEN 2 THEN 'performance' WHEN 3 THEN 'maintainability' ELSE 'style' END AS category,
        CASE l_returnflag WHEN 'N' THEN 'open' WHEN 'R' THEN 'resolved' ELSE 'dismissed' END AS status,
        'value part' || (l_partkey % 7) || ' may be null in call' || (l_suppkey % 5) AS message,
        CASE WHEN l_suppkey % 4 = 0 THEN 'eslint' ELSE 'ai' END AS source,
        CASE WHEN l_suppkey % 4 = 0 THEN 'eslint' ELSE CASE l_suppkey % 3 WHEN 0 THEN 'quality' WHEN 1 THEN 'security' ELSE 'testing' END END AS reviewer,
        CASE WHEN l_linenumber % 3 = 0 THEN 'uncertain' ELSE 'confirmed' END AS verdict FROM lineitem""",
    "webhook_events": """SELECT event_id, 'd' || (event_id % 9000) AS delivery_id, ts AS received_at, CASE event_type WHEN 'view' THEN 'pull_request'
        WHEN 'signup' THEN 'installation' WHEN 'error' THEN 'push' WHEN 'click' THEN 'issue_comment' ELSE 'installation_repositories' END AS event_type,
        CASE event_id % 3 WHEN 0 THEN 'received' WHEN 1 THEN 'published' ELSE 'failed' END AS status, user_id,
        CASE user_id % 6 WHEN 0 THEN 'opened' WHEN 1 THEN 'synchronize' WHEN 2 THEN 'closed' WHEN 3 THEN 'reopened' WHEN 4 THEN 'created' ELSE 'added' END AS action
        FROM events""",
    "code_files": """SELECT p_partkey // 100 AS repository_id, 'src/p' || p_partkey || '.ts' AS path, sha1(p_name || p_size) AS blob_sha,
        list_transform(range(1, (p_partkey % 4 + 2)::INT), lambda i: 'src/p' || (p_partkey // 100 * 100 + (p_partkey * i * 7 + i) % 100) || '.ts') AS imports FROM part""",
    "code_chunks": "SELECT vec_id AS id, label::BIGINT AS repository_id, 'src/f' || (vec_id % 40) || '.ts' AS path, embedding FROM embeddings",
    "files": """SELECT doc_id // 300 AS review_id, CASE doc_id % 9 WHEN 0 THEN 'src/auth/' WHEN 1 THEN 'dist/' WHEN 2 THEN 'src/' ELSE 'lib/' END || source
        || '/f' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.min.js' WHEN 1 THEN '.ts' WHEN 2 THEN '.test.ts' WHEN 3 THEN '.py' ELSE '.png' END AS filename,
        doc_id::INT AS ord, CASE doc_id % 6 WHEN 0 THEN 'removed' WHEN 1 THEN 'added' ELSE 'modified' END AS status,
        (n_chars % 90)::INT AS additions, (n_chars % 40)::INT AS deletions, text AS content FROM documents""",
    "visible": """SELECT DISTINCT i.owner_user_id AS "user", r.full_name AS repo_full_name FROM installations i JOIN repositories r USING (installation_id)
        WHERE i.status <> 'deleted'""",
    "trend": """SELECT strftime(created_at, '%Y-%m-%d') AS day, round(sum(score)::DECIMAL(18,6) / count(score) / 10, 1)::DOUBLE AS avg_score,
        count(*) AS reviews FROM reviews WHERE status = 'completed' GROUP BY 1""",
    "ranked": "SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS sr FROM review_findings",
    "weighed": """SELECT *, CASE severity WHEN 'critical' THEN 30.0 WHEN 'high' THEN 15.0 WHEN 'medium' THEN 6.0 ELSE 2.0 END
        * CASE WHEN verdict = 'uncertain' THEN 0.5 ELSE 1 END AS w FROM review_findings""",
    "edges": "SELECT DISTINCT repository_id, unnest(imports) AS path, path AS importer FROM code_files",
    "changed": """SELECT unnest([n, n + 1]) AS review_id, repository_id, n AS rank, path FROM (SELECT repository_id, path, regexp_extract(path, '[0-9]+')::BIGINT AS n FROM code_files)""",
    "levels": """SELECT * FROM (WITH RECURSIVE walk AS (SELECT review_id, repository_id, path, rank AS origin, 0 AS distance FROM changed
        UNION SELECT w.review_id, w.repository_id, e.importer, w.origin, w.distance + 1 FROM walk w JOIN edges e ON e.repository_id = w.repository_id AND e.path = w.path WHERE w.distance < 3)
        SELECT review_id, repository_id, path, origin, distance FROM walk)""",
    "nearest": "SELECT review_id, repository_id, path, min(distance) AS distance FROM levels GROUP BY 1, 2, 3",
    "affected": """SELECT n.review_id, n.path, n.distance, min(l.origin) AS origin FROM nearest n JOIN levels l ON l.review_id = n.review_id AND l.repository_id = n.repository_id
        AND l.path = n.path AND l.distance = n.distance WHERE n.distance > 0 GROUP BY 1, 2, 3, n.repository_id""",
    "own": "SELECT DISTINCT * FROM review_findings",
    "source_lines": """SELECT review_id, ord, filename AS path, i - 1 AS i, list[i] AS line, len(list) AS n FROM (SELECT review_id, ord, filename, string_split(content, chr(10)) AS list,
        unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM files WHERE regexp_matches(filename, '[.](c|m)?(j|t)sx?$'))""",
    "routed": """SELECT event_id, user_id % 1500 AS github_repo_id FROM webhook_events WHERE event_type = 'push' AND event_id % 4 <> 0""",
    "patches": """SELECT review_id, ord, filename, status, CASE WHEN ord % 7 <> 0 THEN '@@ -1,4 +' || (ord % 30 + 1) || ',6 @@ ctx' || chr(10)
        || array_to_string(list_transform(range(1, len(string_split(content, chr(10))) + 1), lambda i: CASE (i - 1) % 4 WHEN 1 THEN '+' WHEN 2 THEN '-'
        ELSE ' ' END || string_split(content, chr(10))[i]), chr(10)) END AS patch FROM files""",
    "patch_lines": """SELECT review_id, ord, i, CASE (i - 1) % 4 WHEN 1 THEN '+' WHEN 2 THEN '-' ELSE ' ' END AS kind, line AS text,
        CASE WHEN (i - 1) % 4 <> 2 THEN ord % 30 + 1 + (i - 1) - ((i - 1) // 4 + CASE WHEN (i - 1) % 4 > 2 THEN 1 ELSE 0 END) END AS new_line
        FROM (SELECT review_id, ord, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i
        FROM files WHERE ord % 7 <> 0)""",
}
NEEDS = {
    "visible": ["installations", "repositories"], "trend": ["reviews"], "ranked": ["review_findings"], "weighed": ["review_findings"],
    "edges": ["code_files"], "changed": ["code_files"], "levels": ["code_files", "edges", "changed"], "nearest": ["code_files", "edges", "changed", "levels"],
    "affected": ["code_files", "edges", "changed", "levels", "nearest"], "own": ["review_findings"], "source_lines": ["files"], "routed": ["webhook_events"], "patches": ["files"], "patch_lines": ["files"],
}


def sql(select: str, *tables: str) -> str:
    """select over the named model tables."""
    names: list[str] = []
    for t in tables:
        names += [n for n in (*NEEDS.get(t, []), t) if n not in names]
    return f"WITH {', '.join(f'{n} AS ({MODEL[n]})' for n in names)} {select}" if names else select


SERIOUS = "EXISTS (SELECT 1 FROM review_findings f WHERE f.review_id = r.id AND f.status = 'open' AND f.severity IN ('critical', 'high'))"
WORDS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{3,}'))"
JACCARD = "CASE WHEN len(k.w) = 0 OR len(x[1].w) = 0 THEN 0.0 ELSE len(list_intersect(k.w, x[1].w)) / len(list_distinct(list_concat(k.w, x[1].w))) END"
SKIP_RE = {
    "dist": r"(^|/)(dist|build|out|coverage|node_modules|vendor|\.next)/",
    "min": r"\.min\.(js|css)$",
    "binary": r"\.(map|snap|svg|png|jpe?g|gif|webp|ico|pdf|zip|woff2?|ttf|eot|mp4|mp3)$",
}
REASON = (
    "CASE WHEN status = 'removed' THEN 'deleted' WHEN coalesce(patch, '') = '' THEN 'binary or too large' "
    f"WHEN regexp_matches(filename, '{SKIP_RE['dist']}') OR regexp_matches(filename, '{SKIP_RE['min']}') "
    f"OR regexp_matches(filename, '{SKIP_RE['binary']}', 'i') THEN 'generated/vendored' END"
)


def oracle_sql() -> dict[str, str]:
    found = {
        "score_trend": sql(
            """SELECT v."user", strftime(created_at, '%Y-%m-%d') AS day, round(sum(score)::DECIMAL(18,6) / count(score) / 10, 1)::DOUBLE AS avg_score,
            count(*) AS reviews FROM reviews r JOIN visible v USING (repo_full_name) WHERE status = 'completed' GROUP BY 1, 2""",
            "visible", "reviews",
        ),
        "category_breakdown": sql("SELECT category, severity, count(*) AS n FROM review_findings f JOIN reviews r ON f.review_id = r.id WHERE f.status <> 'dismissed' GROUP BY 1, 2", "reviews", "review_findings"),
        "page_total": sql("SELECT count(*) AS total, 3 * 15 < count(*) AS has_more FROM reviews", "reviews"),
        "reviews_page": sql("SELECT id, repo_full_name FROM reviews ORDER BY created_at DESC, id DESC LIMIT 15 OFFSET 30", "reviews"),
        "repository_counts": sql("SELECT count(*) AS \"all\", count(*) FILTER (auto_review_enabled) AS enabled FROM repositories WHERE active AND lower(full_name) LIKE '%r1%'", "repositories"),
        "search_repositories": sql("SELECT full_name FROM repositories WHERE active AND auto_review_enabled AND lower(full_name) LIKE '%o1/r%'", "repositories"),
        "search_reviews": sql("SELECT id, pr_number FROM reviews WHERE coalesce(pr_title ILIKE '%42%', false) OR repo_full_name ILIKE '%42%' OR pr_number = 42", "reviews"),
        "severity_badges": sql(
            "SELECT review_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, "
            "count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity IN ('critical', 'high')) AS major FROM review_findings WHERE status <> 'dismissed' GROUP BY 1",
            "review_findings",
        ),
        "review_group": sql(
            f"""SELECT id, CASE WHEN status IN ('pending', 'in_progress') THEN 'working' WHEN status = 'failed' THEN 'failed'
            WHEN status = 'completed' AND (score < 70 OR {SERIOUS}) THEN 'attention' WHEN status = 'completed' AND NOT (score < 70 OR {SERIOUS}) THEN 'completed' END AS "group" FROM reviews r""",
            "reviews", "review_findings",
        ),
        "review_rows": sql("SELECT id, coalesce(pr_title, repo_full_name || '#' || pr_number) AS title, round(score) / 10 AS shown_score, CASE WHEN round(score) / 10 >= 8 THEN 'good' WHEN round(score) / 10 >= 5 THEN 'fair' WHEN score IS NOT NULL THEN 'poor' END AS band FROM reviews", "reviews"),
        "repository_rows": sql("SELECT full_name, split_part(full_name, '/', 1) AS account, coalesce(html_url, 'https://github.com/' || full_name) AS html_url FROM repositories", "repositories"),
        "user_installations": sql(
            """SELECT owner_user_id, installation_id, (row_number() OVER (PARTITION BY owner_user_id ORDER BY created_s, installation_id))::INT AS place,
            bool_or(status = 'active') OVER (PARTITION BY owner_user_id) AS has_active FROM installations WHERE status <> 'deleted'""",
            "installations",
        ),
        "accessible_repository": sql(
            """SELECT v."user", r.full_name FROM visible v JOIN repositories r ON lower(v.repo_full_name) = lower(r.full_name) AND r.active
            JOIN installations i ON i.installation_id = r.installation_id AND i.status = 'active' AND i.owner_user_id = v."user" """,
            "visible",
        ),
        "deactivate_missing": sql("SELECT github_repo_id, active AND NOT (installation_id % 2 = 0 AND github_repo_id % 4 = 0 AND EXISTS (SELECT 1 FROM repositories s WHERE s.installation_id = r.installation_id AND s.github_repo_id % 4 <> 0)) AS active FROM repositories r", "repositories"),
        "missing_indexes": sql("SELECT DISTINCT p.id AS repository_id, p.installation_id FROM reviews r JOIN repositories p ON p.full_name = r.repo_full_name WHERE p.indexed_sha IS NULL", "reviews", "repositories"),
        "latest_review_per_pr": sql(
            """SELECT p.repo_full_name, p.pr_number, r.id AS review_id, r.status, r.head_sha <> p.head AS outdated FROM
            (SELECT repo_full_name, pr_number, min(head_sha) AS head FROM reviews GROUP BY 1, 2) p
            LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY repo_full_name, pr_number ORDER BY created_at DESC, id DESC) AS n FROM reviews) r
            ON r.repo_full_name = p.repo_full_name AND r.pr_number = p.pr_number AND r.n = 1""",
            "reviews",
        ),
        "reviewed_pull_count": sql(
            """SELECT p.repo_full_name, count(*) FILTER (r.status = 'completed' AND r.head_sha = p.head) AS reviewed FROM
            (SELECT repo_full_name, pr_number, min(head_sha) AS head FROM reviews GROUP BY 1, 2) p
            JOIN (SELECT *, row_number() OVER (PARTITION BY repo_full_name, pr_number ORDER BY created_at DESC, id DESC) AS n FROM reviews) r
            ON r.repo_full_name = p.repo_full_name AND r.pr_number = p.pr_number AND r.n = 1 GROUP BY 1""",
            "reviews",
        ),
        "previous_review": sql(
            """SELECT a.repo_full_name, a.pr_number, a.head_sha, (SELECT b.head_sha FROM reviews b WHERE b.status = 'completed' AND b.repo_full_name = a.repo_full_name
            AND b.pr_number = a.pr_number AND b.head_sha <> a.head_sha ORDER BY b.completed_s DESC, b.id DESC LIMIT 1) AS previous_sha FROM reviews a""",
            "reviews",
        ),
        "sweep_stuck": sql(
            """SELECT id, new_status, new_attempts FROM (SELECT id, 'failed' AS new_status, attempts AS new_attempts, 0 AS n FROM reviews WHERE status IN ('pending', 'in_progress')
            AND epoch(TIMESTAMP '1997-01-01') - updated_s > 600 AND attempts >= 3 UNION ALL SELECT id, 'pending', attempts + 1, row_number() OVER (ORDER BY updated_s, id)
            FROM reviews WHERE status IN ('pending', 'in_progress') AND epoch(TIMESTAMP '1997-01-01') - updated_s > 600 AND attempts < 3 AND installation_id IS NOT NULL) WHERE n <= 20""",
            "reviews",
        ),
        "daily_series": sql(
            """SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(reviews, 0) AS reviews, avg_score FROM (SELECT unnest(generate_series(DATE '1997-01-02', DATE '1997-01-31', INTERVAL 1 DAY)) AS d)
            LEFT JOIN trend ON day = strftime(d, '%Y-%m-%d')""",
            "trend",
        ),
        "dashboard_kpis": sql(
            """SELECT * FROM (SELECT coalesce(sum(reviews), 0)::BIGINT AS reviews, round(sum(avg_score::DECIMAL(10,1) * reviews) / sum(CASE WHEN avg_score IS NOT NULL THEN reviews END), 3)::DOUBLE AS avg_score FROM trend),
            (SELECT count(*) AS issues, count(*) FILTER (severity IN ('critical', 'high')) AS blocking, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
            count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM review_findings f JOIN reviews r ON r.id = f.review_id WHERE f.status <> 'dismissed')""",
            "trend", "review_findings",
        ),
        "open_counts": sql(
            """SELECT review_id, count(*) FILTER (sr = 0) AS critical, count(*) FILTER (sr = 1) AS high, count(*) FILTER (sr = 2) AS medium, count(*) FILTER (sr = 3) AS low,
            count(*) FILTER (sr < 2) AS blocking FROM ranked WHERE status = 'open' GROUP BY 1""",
            "ranked",
        ),
        "issues_by_file": sql(
            """SELECT review_id, file, min(sr) AS worst, count(*) AS n, array_to_string(list(id ORDER BY sr, coalesce(line, 0), id), ',') AS ids,
            (row_number() OVER (PARTITION BY review_id ORDER BY min(sr), count(*) DESC, file NULLS FIRST))::INT AS place FROM ranked GROUP BY 1, 2""",
            "ranked",
        ),
        "overall_score": sql("SELECT review_id, greatest(0, floor(100 - sum(w) + 0.5))::INT AS score FROM weighed GROUP BY 1", "weighed"),
        "dimension_scores": sql(
            """SELECT review_id, dimension, CASE WHEN failed THEN NULL ELSE greatest(0.0, floor((10 - p / 10) * 10 + 0.5) / 10) END::DOUBLE AS score FROM (
            SELECT review_id, dimension, review_id % 10 = 3 AND dimension = 'testing' AS failed, coalesce(CASE dimension WHEN 'quality' THEN q WHEN 'security' THEN s ELSE t END, 0)::DOUBLE AS p FROM (
            SELECT review_id, sum(w) FILTER (reviewer IN ('quality', 'eslint')) AS q, sum(w) FILTER (reviewer = 'security' OR category = 'security') AS s, sum(w) FILTER (reviewer = 'testing') AS t
            FROM weighed GROUP BY 1), (SELECT unnest(['quality', 'security', 'testing']) AS dimension)) """,
            "weighed",
        ),
        "policy_decision": sql(
            """SELECT review_id, CASE WHEN len(reasons) > 0 THEN 'request_changes' ELSE 'comment' END AS verdict, CASE WHEN len(reasons) > 0 THEN 'failure' ELSE 'success' END AS conclusion,
            CASE WHEN len(reasons) > 0 THEN 'Blocked by policy: ' || reasons[1] || CASE WHEN len(reasons) > 1 THEN ' (+' || (len(reasons) - 1) || ' more)' ELSE '' END
            ELSE 'Passes policy with ' || n || ' finding(s) worth a look' END AS headline, array_to_string(reasons, '; ') AS reasons,
            'fail_on ' || CASE WHEN b > 0 THEN 'fail ' || b || ' confirmed critical finding(s)' ELSE 'pass no confirmed critical findings' END
            || '; min_score ' || CASE WHEN score < 40 THEN 'fail' ELSE 'pass' END || ' score ' || score || ' vs minimum 40' AS policies
            FROM (SELECT *, len(blocking) AS b, list_concat(blocking, CASE WHEN score < 40 THEN ['score ' || score || ' is below min_score 40'] ELSE [] END) AS reasons FROM (
            SELECT review_id, count(*) AS n, greatest(0, floor(100 - sum(w) + 0.5))::INT AS score, coalesce(list(severity || ' ' || category || ' finding at ' || coalesce(file, 'PR') || coalesce(':' || line, '')
            ORDER BY ord, severity || ' ' || category || ' finding at ' || coalesce(file, 'PR') || coalesce(':' || line, '')) FILTER (verdict <> 'uncertain' AND severity = 'critical'), []) AS blocking FROM weighed GROUP BY 1))""",
            "weighed",
        ),
        "severity_summary": sql(
            """SELECT review_id, concat_ws(', ', CASE WHEN c > 0 THEN c || ' critical' END, CASE WHEN h > 0 THEN h || ' high' END, CASE WHEN m > 0 THEN m || ' medium' END,
            CASE WHEN l > 0 THEN l || ' low' END) AS summary FROM (SELECT review_id, count(*) FILTER (sr = 0) AS c, count(*) FILTER (sr = 1) AS h, count(*) FILTER (sr = 2) AS m, count(*) FILTER (sr = 3) AS l FROM ranked GROUP BY 1)""",
            "ranked",
        ),
        "verification_summary": sql(
            """SELECT review_id, CASE WHEN review_id % 5 = 0 THEN 'partial' ELSE 'complete' END AS status, count(*) FILTER (verdict = 'confirmed') AS confirmed,
            count(*) FILTER (verdict = 'uncertain') AS uncertain, 0::BIGINT AS rejected FROM review_findings GROUP BY 1""",
            "review_findings",
        ),
        "distinct_categories": sql("SELECT review_id, array_to_string(list_sort(list_distinct(list(category))), ',') AS categories FROM review_findings GROUP BY 1", "review_findings"),
        "top_findings": sql("SELECT review_id, id, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY sr, ord, id) AS place FROM ranked) WHERE place <= 3", "ranked"),
        "verify_batches": sql(
            """SELECT review_id, id, ((n - 1) // 2)::INT AS batch, ((n - 1) % 2)::INT AS batch_id FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY ord, id) AS n
            FROM (SELECT DISTINCT * FROM review_findings) WHERE source <> 'eslint')""",
            "review_findings",
        ),
        "split_inline": sql("SELECT review_id, id, coalesce(line % 3 = 0, false) AS inline FROM (SELECT DISTINCT * FROM review_findings) WHERE file IS NOT NULL", "review_findings"),
        "fan_in": sql("SELECT repository_id, path, count(*) AS fan_in FROM edges GROUP BY 1, 2", "edges"),
        "blast_radius": sql("SELECT review_id, path, distance::INT AS distance, 'src/p' || origin || '.ts' AS via FROM affected", "affected"),
        "detect_file_changes": sql(
            """SELECT coalesce(t.repository_id, k.repository_id) AS repository_id, coalesce(t.path, k.path) AS path, CASE WHEN t.path IS NULL THEN 'removed' WHEN k.path IS NULL THEN 'added' ELSE 'changed' END AS change
            FROM (SELECT repository_id, path, CASE WHEN length(path) % 3 = 0 THEN 'x' ELSE blob_sha END AS sha FROM code_files WHERE NOT regexp_matches(path, '3\\.ts$') AND repository_id % 5 <> 0) t
            FULL JOIN (SELECT * FROM code_files WHERE NOT regexp_matches(path, '4\\.ts$') AND repository_id % 5 <> 0) k ON t.repository_id = k.repository_id AND t.path = k.path
            WHERE t.path IS NULL OR k.path IS NULL OR t.sha <> k.blob_sha""",
            "code_files",
        ),
        "rag_top_k": sql(
            """SELECT review_id, id, place::INT AS place FROM (SELECT q.id AS review_id, c.id, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), c.id) AS place
            FROM code_chunks q JOIN code_chunks c USING (repository_id) WHERE q.id % 50 = 0 AND c.id <> q.id AND list_cosine_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) < 0.9) WHERE place <= 8""",
            "code_chunks",
        ),
        "classify_diff_files": sql(f"SELECT review_id, filename, {REASON} AS reason, ({REASON}) IS NULL AS reviewable FROM patches", "patches"),
        "parse_patch": sql("SELECT review_id, ord, i::INT AS i, kind, new_line::INT AS new_line, md5(text) AS text_md5 FROM patch_lines", "patch_lines"),
        "number_patch": sql(
            """SELECT review_id, ord, md5(string_agg(kind || coalesce(lpad(new_line::VARCHAR, 5, ' '), '     ') || ' | ' || text, chr(10) ORDER BY i)) AS numbered_md5 FROM patch_lines GROUP BY 1, 2""",
            "patch_lines",
        ),
        "line_windows": sql(
            """SELECT ord, (s + 1)::INT AS start_line, least(s + 6, n)::INT AS end_line, md5(array_to_string(ls[s + 1:s + 6], chr(10))) AS content_md5 FROM (SELECT ord, ls, len(ls) AS n, unnest(range(0, greatest(0, ceil((len(ls) - 6) / 5)::BIGINT * 5) + 1, 5)) AS s
            FROM (SELECT ord, string_split(content, chr(10)) AS ls FROM files)) WHERE trim(regexp_replace(array_to_string(ls[s + 1:s + 6], ''), '\\s', '', 'g')) <> ''""",
            "files",
        ),
        "word_similarity": f"SELECT a.conv_id, a.turn, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END AS similarity "
        f"FROM (SELECT conv_id, turn, {WORDS} AS w FROM conversations) a JOIN (SELECT conv_id, turn, {WORDS} AS w FROM conversations) b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1",
        "fenced_pages": r"SELECT page_id, md5(regexp_replace(html, '</?\s*(title|script|style|nav|untrusted)[^>]*>', '[tag removed]', 'gi')) AS fenced_md5, ceil(length(html) / 4)::BIGINT AS tokens FROM pages",
        "sensitive_paths": sql(
            r"SELECT filename, regexp_matches(filename, '(^|/)(auth|login|session|jwt|token|oauth|password|crypto|secret|payment|billing|checkout|permission|rbac|acl|migrations?|security|middleware)[^/]*', 'i') AS sensitive, "
            r"status = 'removed' AND regexp_matches(filename, '\.test\.|\.spec\.|_test\.|_spec\.|__tests__/') AS deleted_test, "
            r"(regexp_matches(filename, '\.(c|m)?(j|t)sx?$') OR regexp_matches(filename, '\.(py|go|rb|java|kt|rs|php|cs|swift|scala|vue|svelte|sql|sh)$', 'i')) "
            r"AND NOT regexp_matches(filename, '(^|/)(node_modules|dist|build|out|coverage|vendor|\.next|\.git|__snapshots__)/|\.min\.|\.generated\.') AS code FROM files",
            "files",
        ),
        "risk": sql(
            r"""SELECT * FROM (WITH RECURSIVE code AS (SELECT repository_id, path, regexp_extract(path, '[0-9]+')::BIGINT AS n, imports FROM code_files),
            uses AS (SELECT DISTINCT repository_id, path AS importer, t AS target FROM (SELECT *, unnest(list_append(imports, 'src/p' || (n // 100 * 100) || '.ts')) AS t FROM code) WHERE t <> path),
            ways AS (SELECT n // 10 AS review_id, repository_id, path, 0 AS far FROM code WHERE n % 30 = 0
                UNION SELECT w.review_id, w.repository_id, importer, far + 1 FROM ways w JOIN uses u ON u.repository_id = w.repository_id AND u.target = w.path WHERE far < 3),
            hit AS (SELECT review_id, count(DISTINCT path) - 1 AS a FROM ways GROUP BY 1),
            direct AS (SELECT n // 10 AS review_id, count(*) AS fan FROM code JOIN uses u ON u.repository_id = code.repository_id AND u.target = code.path WHERE n % 30 = 0 GROUP BY 1),
            f AS (SELECT (ord // 3)::BIGINT AS review_id, ord, filename, status, additions + deletions AS churn, filename NOT LIKE 'dist/%' AS kept FROM files),
            g AS (SELECT review_id, coalesce(sum(churn) FILTER (kept), 0)::BIGINT AS l, count(*) FILTER (status = 'removed' AND regexp_matches(filename, '[._](test|spec)[.]|__tests__/')) AS t,
                coalesce(list(filename ORDER BY ord) FILTER (kept AND status <> 'removed' AND regexp_matches(filename, '(^|/)(auth|login|session|jwt|token|oauth|password|crypto|secret|payment|billing|checkout|permission|rbac|acl|migrations?|security|middleware)[^/]*', 'i')), []) AS s
                FROM f GROUP BY 1),
            parts AS (SELECT review_id, l, t, s, coalesce(a, 0) AS a, coalesce(fan, 0) AS fan FROM g LEFT JOIN hit USING (review_id) LEFT JOIN direct USING (review_id)),
            summed AS (SELECT *, least(100, least(35, 2 * a) + CASE WHEN fan >= 10 THEN 10 ELSE 0 END + CASE WHEN len(s) > 0 THEN 30 ELSE 0 END + least(15, 3 * (l // 50)) + CASE WHEN t > 0 THEN 10 ELSE 0 END)::INT AS score FROM parts)
            SELECT review_id, score, CASE WHEN score >= 70 THEN 'critical' WHEN score >= 45 THEN 'high' WHEN score >= 20 THEN 'medium' ELSE 'low' END AS level,
            coalesce(nullif(concat_ws('; ', CASE WHEN a > 0 THEN a || ' file(s) depend on the changed code' END, CASE WHEN fan >= 10 THEN 'a changed file is imported directly by ' || fan || ' files' END,
            CASE WHEN len(s) > 0 THEN 'touches sensitive code: ' || array_to_string(s[1:3], ', ') || CASE WHEN len(s) > 3 THEN '…' ELSE '' END END, CASE WHEN l >= 50 THEN l || ' lines changed' END,
            CASE WHEN t > 0 THEN t || ' test file(s) deleted' END), ''), 'small, isolated change') AS factors FROM summed)""",
            "files", "code_files",
        ),
        "ingest_events": sql("SELECT event_id, row_number() OVER (PARTITION BY delivery_id ORDER BY received_at, event_id) > 1 AS duplicate FROM webhook_events", "webhook_events"),
        "sweep_outbox": sql("SELECT event_id, delivery_id FROM webhook_events WHERE status = 'received' AND epoch(TIMESTAMP '2024-01-05') - floor(epoch(received_at)) > 30 ORDER BY received_at, event_id LIMIT 50", "webhook_events"),
        "route_reviews": sql(
            """SELECT event_id, CASE WHEN event_type <> 'pull_request' THEN 'event ' || event_type WHEN action NOT IN ('opened', 'synchronize', 'reopened', 'ready_for_review') THEN 'action ' || action
            WHEN event_id % 50 = 0 THEN 'incomplete payload' WHEN event_id % 7 = 0 THEN 'draft PR' WHEN event_id % 5 = 0 THEN 'PR not open' END AS reason FROM webhook_events WHERE event_type <> 'issue_comment'""",
            "webhook_events",
        ),
        "qualify_reviews": sql(
            """SELECT event_id, CASE WHEN NOT coalesce(r.active, false) THEN 'repo not granted' WHEN NOT r.auto_review_enabled THEN 'auto-review off' WHEN i.status <> 'active' THEN 'installation ' || i.status END AS skip
            FROM webhook_events e LEFT JOIN repositories r ON r.github_repo_id = e.user_id % 1500 LEFT JOIN installations i ON i.installation_id = e.user_id % 97 + 1
            WHERE event_type = 'pull_request' AND action IN ('opened', 'synchronize', 'reopened') AND event_id % 50 <> 0 AND event_id % 7 <> 0 AND event_id % 5 <> 0""",
            "webhook_events", "repositories", "installations",
        ),
        "route_index": sql("SELECT event_id, user_id % 1500 AS github_repo_id, sha1(event_id::VARCHAR) AS ref FROM webhook_events WHERE event_type = 'push' AND event_id % 4 <> 0", "webhook_events"),
        "topic_keys": sql("SELECT id, lower(repo_full_name) || '#' || pr_number AS key FROM reviews", "reviews"),
        "progress_changes": sql(
            """SELECT event_id, status IN ('failed') AS done FROM (SELECT *, lag(status) OVER w AS before, coalesce(max((status = 'failed')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over
            FROM webhook_events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE over = 0 AND status IS DISTINCT FROM before""",
            "webhook_events",
        ),
        "lifecycle_states": sql("SELECT user_id AS review_id, arg_max(status, event_id) AS status, max(event_id) AS last_event FROM webhook_events GROUP BY 1", "webhook_events"),
        "claim_reviews": sql(
            """SELECT event_id, n = 1 AND (r.status IS NULL OR r.status IN ('pending', 'failed')) AS claimed FROM (SELECT e.event_id, q.repo_full_name, q.pr_number, q.head_sha, q.status,
            row_number() OVER (PARTITION BY q.id ORDER BY e.event_id) AS n FROM webhook_events e JOIN reviews q ON q.id = e.user_id) r""",
            "webhook_events", "reviews",
        ),
        "registry_repositories": sql("SELECT user_id AS github_repo_id, arg_max(action, event_id) AS language, arg_max(action, event_id) <> 'closed' AS active FROM webhook_events GROUP BY 1", "webhook_events"),
        "eval_metrics": sql(
            """, x AS (SELECT review_id AS name, file, line, ord % 3 = 0 AS want FROM own)
            SELECT e.name, e.expected, e.found, coalesce(f.findings, 0) AS findings, coalesce(f.fp, 0) AS "falsePositives" FROM
            (SELECT name, count(*) AS expected, count(*) FILTER (EXISTS (SELECT 1 FROM x f WHERE NOT f.want AND f.name = x.name AND f.file = x.file AND abs(f.line - x.line) <= 3)) AS found FROM x WHERE want GROUP BY 1) e
            LEFT JOIN (SELECT name, count(*) AS findings, count(*) FILTER (NOT EXISTS (SELECT 1 FROM x e WHERE e.want AND e.name = x.name AND e.file = x.file AND abs(e.line - x.line) <= 3)) AS fp FROM x WHERE NOT want GROUP BY 1) f USING (name)""",
            "own",
        ),
        "import_resolution": sql(
            """SELECT DISTINCT f.repository_id, f.path AS from_path, regexp_replace(i, '^src/(.*)\\.ts$', './\\1.js') AS spec, i AS path FROM (SELECT repository_id, path, unnest(imports) AS i FROM code_files) f
            JOIN code_files g ON g.repository_id = f.repository_id AND g.path = f.i WHERE f.i <> f.path""",
            "code_files",
        ),
        "finding_comments": sql(
            """SELECT id, md5(CASE severity WHEN 'critical' THEN '🔴' WHEN 'high' THEN '🟠' WHEN 'medium' THEN '🟡' ELSE '🔵' END || ' **' || upper(severity) || '** · ' || category
            || CASE WHEN source = 'eslint' THEN ' · ESLint' ELSE '' END || chr(10) || chr(10) || message || CASE ord % 3 WHEN 0 THEN chr(10) || chr(10) || '**Suggestion**' || chr(10) || '```' || chr(10) || 'call(x);' || chr(10) || '```'
            WHEN 1 THEN chr(10) || chr(10) || '**Suggestion**' || chr(10) || 'use a name' ELSE '' END) AS comment_md5 FROM review_findings""",
            "review_findings",
        ),
        "token_usage": sql("SELECT review_id, sum(CASE WHEN ord <> 4 THEN ord * 10 ELSE 0 END)::BIGINT AS tokens FROM review_findings GROUP BY 1", "review_findings"),
        "reviewer_status": sql(
            """SELECT review_id, array_to_string(list_filter(['quality', 'security', 'testing'], lambda r: list_contains(bad, r)), ',') AS failed,
            array_to_string(list_filter(['quality', 'security', 'testing'], lambda r: list_contains(good, r)), ',') AS skills, len(good) = 0 AS all_failed FROM (SELECT review_id,
            coalesce(list(reviewer) FILTER (NOT ok), []) AS bad, coalesce(list(reviewer) FILTER (ok), []) AS good FROM (SELECT review_id, reviewer, max(ord) < 6 AS ok FROM review_findings WHERE source <> 'eslint' GROUP BY 1, 2) GROUP BY 1)""",
            "review_findings",
        ),
        "scan_tree": sql(
            r"""SELECT review_id AS repository_id, filename AS path FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY ord) AS n FROM files WHERE length(content) <= 200000
            AND (regexp_matches(filename, '\.(c|m)?(j|t)sx?$') OR regexp_matches(filename, '\.py$')) AND NOT regexp_matches(filename, '(^|/)dist/|\.min\.')) WHERE n <= 1500""",
            "files",
        ),
        "embedding_texts": sql("SELECT ord, md5(substr('// file: ' || filename || CASE WHEN ord % 2 = 0 THEN ' · f' || ord ELSE '' END || chr(10) || content, 1, 2000)) AS text_md5 FROM files", "files"),
        "line_contexts": sql(
            """SELECT ord, md5(array_to_string(list_transform(range(1, least(3, len(ls)) + 1), lambda i: CASE i WHEN 2 THEN '>' ELSE ' ' END || lpad(i::VARCHAR, 5, ' ') || ' | ' || ls[i]), chr(10))) AS context_md5
            FROM (SELECT ord, string_split(content, chr(10)) AS ls FROM files)""",
            "files",
        ),
        "max_fan_in": sql(
            "SELECT c.review_id, max(coalesce(n, 0)) AS max_fan_in FROM changed c LEFT JOIN (SELECT repository_id, path, count(*) AS n FROM edges GROUP BY 1, 2) e ON e.repository_id = c.repository_id AND e.path = c.path GROUP BY 1",
            "edges", "changed",
        ),
        "registry_installations": sql(
            """SELECT user_id AS installation_id, arg_max(CASE event_id % 5 WHEN 0 THEN 'deleted' WHEN 1 THEN 'suspended' ELSE 'active' END, (received_at, event_id)) AS status, arg_max(delivery_id, (received_at, event_id)) AS account_login,
            arg_min('u' || event_id, (received_at, event_id)) FILTER (event_id % 3 = 0) AS owner_user_id FROM webhook_events GROUP BY 1""",
            "webhook_events",
        ),
        "save_findings": sql("SELECT review_id, count(*) AS n FROM own WHERE severity = 'critical' OR review_id NOT IN (SELECT review_id FROM own WHERE severity = 'critical') GROUP BY 1", "own"),
        "repost_findings": sql(
            """SELECT review_id, CASE WHEN r.id % 5 = 0 THEN 'from' ELSE 'base' END AS from_sha, count(*) AS n FROM review_findings f JOIN reviews r ON r.id = f.review_id WHERE f.status <> 'dismissed' AND r.status = 'completed'
            AND score IS NOT NULL AND installation_id IS NOT NULL AND (r.id % 5 = 0 OR r.id % 6 <> 0) GROUP BY 1, 2""",
            "reviews", "review_findings",
        ),
        "request_manual": sql("SELECT repo_full_name, pr_number, head_sha FROM reviews WHERE attempts = 0 OR status NOT IN ('in_progress', 'completed')", "reviews"),
        "line_churn": """WITH t AS (SELECT a.conv_id, a.turn, b.text AS before, a.text AS after FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1),
            l AS (SELECT conv_id, turn, unnest(string_split(before, chr(10))) AS line, -1 AS s FROM t UNION ALL SELECT conv_id, turn, unnest(string_split(after, chr(10))), 1 FROM t)
            SELECT conv_id, turn, line, greatest(-n, 0) AS removed, greatest(n, 0) AS added FROM (SELECT conv_id, turn, line, sum(s)::BIGINT AS n FROM l GROUP BY 1, 2, 3) WHERE n <> 0""",
        "progress_labels": sql(
            """SELECT id, coalesce(label, 'Reviewing') AS label FROM (SELECT id, id % 34 AS k FROM reviews) LEFT JOIN (VALUES (0, 'Starting'), (1, 'Starting'), (2, 'Reading the repository'), (3, 'Collecting the pull request'),
            (4, 'Reading linked issues'), (5, 'Detecting the stack'), (6, 'Choosing review checklists'), (7, 'Gathering related code'), (8, 'Mapping dependencies'), (9, 'Understanding the intent'), (10, 'Understanding the change'),
            (11, 'Checking it matches the description'), (12, 'Understanding the change'), (13, 'Understanding the change'), (14, 'Measuring the blast radius'), (15, 'Assessing risk'), (16, 'Assessing risk'), (17, 'Reviewing code quality'),
            (18, 'Reviewing security'), (19, 'Checking tests'), (20, 'Merging findings'), (21, 'Merging findings'), (22, 'Verifying findings'), (23, 'Verifying findings'), (24, 'Scoring'), (25, 'Applying policies'), (26, 'Deciding'),
            (27, 'Writing the report'), (28, 'Publishing'), (29, 'Done'), (31, 'Queued'), (32, 'Queued'), (33, 'Queued')) v(k, label) USING (k)""",
            "reviews",
        ),
        "age_buckets": sql(
            """SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 2592000 THEN (s // 86400) || 'd ago'
            ELSE strftime(make_timestamp(updated_s * 1000000), '%b %-d') END AS age FROM (SELECT id, updated_s, id * 7919 % 4000000 - 100 AS s FROM reviews)""",
            "reviews",
        ),
        "qualify_index": sql("SELECT event_id, r.id AS repository_id, full_name FROM routed JOIN repositories r USING (github_repo_id) WHERE active", "routed", "repositories"),
        "changed_symbols": sql(
            """SELECT DISTINCT f.review_id, f.path, 'fn' || f.ord || '_' || f.i AS symbol FROM source_lines f JOIN source_lines a ON a.ord = f.ord AND a.i BETWEEN f.i AND CASE WHEN f.i + 2 < f.n THEN f.i + 2 ELSE f.i END
            WHERE f.i % 4 = 0 AND a.i % 5 = 4""",
            "source_lines",
        ),
        "distinct_symbols": sql(
            "SELECT review_id, len(s)::INT AS n, md5(array_to_string(s, ',')) AS symbols_md5 FROM (SELECT review_id, list_sort(list('fn' || ord || '_' || i)) AS s FROM source_lines WHERE i % 4 = 0 GROUP BY 1)",
            "source_lines",
        ),
        "filter_ignored": sql(
            """SELECT review_id, filename FROM files WHERE NOT (review_id % 3 = 0 AND (filename LIKE 'dist/%' OR filename LIKE '%.png')) AND NOT (review_id % 3 = 1 AND filename LIKE 'src/auth/%.ts')""",
            "files",
        ),
        "lint_on_added_lines": sql(
            """SELECT l.review_id, l.id, CASE l.ord % 4 WHEN 1 THEN 'eqeqeq' ELSE 'no-eval' END AS rule_id, CASE l.category WHEN 'style' THEN 'warning' ELSE 'error' END AS severity FROM own l
            WHERE l.ord % 4 IN (1, 2) AND EXISTS (SELECT 1 FROM own a WHERE a.review_id = l.review_id AND a.file = l.file AND a.line = l.line AND a.status = 'open')
            AND (SELECT count(*) FROM (SELECT file, min(id) AS o FROM own g WHERE g.review_id = l.review_id AND g.file IS NOT NULL GROUP BY 1) WHERE o <= (SELECT min(id) FROM own h WHERE h.review_id = l.review_id AND h.file = l.file)) <= 20""",
            "own",
        ),
        "ground_findings": sql(
            """, known AS (SELECT DISTINCT review_id, file FROM own WHERE status <> 'dismissed'), lines AS (SELECT DISTINCT review_id, file, line FROM own WHERE category <> 'style'),
            model AS (SELECT * FROM (SELECT review_id, reviewer, ord, id, CASE WHEN line % 3 <> 0 AND line % 3 <> 1 OR line IS NULL OR file IS NULL THEN file ELSE file END AS file, line, severity, message, 0 AS part,
            row_number() OVER (PARTITION BY review_id, reviewer, file, line, lower(message[1:60]) ORDER BY ord, id) AS n FROM own SEMI JOIN known USING (review_id, file) WHERE source = 'ai') WHERE n = 1),
            errors AS (SELECT review_id, 'quality' AS reviewer, ord, id, file, line, 'medium' AS severity, message || ' (ESLint: eqeqeq)' AS message, 1 AS part FROM own e SEMI JOIN known USING (review_id, file)
            WHERE source = 'eslint' AND verdict = 'confirmed' AND NOT EXISTS (SELECT 1 FROM model m WHERE m.review_id = e.review_id AND m.reviewer = 'quality' AND m.file = e.file AND m.line = e.line)),
            both_ AS (SELECT review_id, reviewer, ord, id, file, line, severity, message, part FROM model UNION ALL SELECT * FROM errors)
            SELECT b.review_id, reviewer, place::INT AS place, b.file, b.line, severity, message, EXISTS (SELECT 1 FROM lines l WHERE l.review_id = b.review_id AND l.file = b.file AND l.line = b.line) AS inline FROM (SELECT *,
            row_number() OVER (PARTITION BY review_id, reviewer ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, part, ord, id) AS place FROM both_) b WHERE place <= 30""",
            "own",
        ).replace("CASE WHEN line % 3 <> 0 AND line % 3 <> 1 OR line IS NULL OR file IS NULL THEN file ELSE file END AS file", "file"),
        "apply_verdicts": sql(
            """, asked AS (SELECT *, (n - 1) // 2 AS batch, (n - 1) % 2 AS k FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY ord, id) AS n FROM own WHERE source <> 'eslint'))
            SELECT review_id, id, CASE WHEN none THEN 'uncertain' ELSE said END AS verdict, CASE WHEN none THEN 0.5 WHEN said = 'uncertain' THEN least(line / 40, 0.6) ELSE line / 40 END::DOUBLE AS confidence, CASE WHEN NOT none THEN message END AS reason
            FROM (SELECT *, category = 'performance' OR EXISTS (SELECT 1 FROM asked f WHERE f.review_id = a.review_id AND f.batch = a.batch AND f.severity = 'critical') AS none,
            CASE category WHEN 'bug' THEN 'rejected' WHEN 'style' THEN 'uncertain' ELSE 'confirmed' END AS said FROM asked a)
            UNION ALL SELECT review_id, id, 'confirmed', 0.8, NULL FROM own WHERE source = 'eslint'""",
            "own",
        ),
        "nearest_caller_files": sql("SELECT review_id, path, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY path) AS place FROM affected WHERE distance = 1) WHERE place <= 2", "affected"),
        "order_affected": sql("SELECT review_id, path, (row_number() OVER (PARTITION BY review_id ORDER BY distance, path))::INT AS place FROM affected", "affected"),
        "prioritise_sensitive": sql("SELECT review_id, filename, (row_number() OVER (PARTITION BY review_id ORDER BY filename NOT LIKE 'src/auth/%', ord))::INT AS new_place FROM files", "files"),
        "head_content_files": sql(
            "SELECT review_id, filename, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY ord) AS place FROM files WHERE status <> 'removed' AND ord % 7 <> 0) WHERE place <= 30", "files"
        ),
        "finding_list": sql("SELECT review_id, id, (row_number() OVER (PARTITION BY review_id ORDER BY ord, id))::INT AS place FROM own", "own"),
        "union_reviewer_findings": sql(
            """, u AS (SELECT *, CASE source WHEN 'eslint' THEN 'quality' ELSE reviewer END AS who FROM own) SELECT review_id, id, CASE source WHEN 'eslint' THEN 'eslint' ELSE who END AS reviewer,
            (row_number() OVER (PARTITION BY review_id ORDER BY CASE who WHEN 'quality' THEN 1 WHEN 'security' THEN 2 ELSE 3 END, ord, id))::INT AS ord FROM u
            WHERE NOT (who = 'testing' AND EXISTS (SELECT 1 FROM u f WHERE f.review_id = u.review_id AND f.who = 'testing' AND f.severity = 'critical'))""",
            "own",
        ),
        "removed_paths": sql("SELECT repository_id, path FROM code_files WHERE len(imports) <= 1", "code_files"),
        "diff_line_sets": sql(
            """SELECT review_id, ord, count(*) FILTER (kind <> '-') AS n_commentable, (sum(new_line) FILTER (kind <> '-'))::BIGINT AS sum_commentable, CASE WHEN count(*) FILTER (kind = '+') > 0 THEN count(*) FILTER (kind = '+') END AS n_added,
            (sum(new_line) FILTER (kind = '+'))::BIGINT AS sum_added FROM patch_lines GROUP BY 1, 2""",
            "patch_lines",
        ),
        "rag_query_texts": sql(
            """SELECT review_id, md5(substr(string_agg('// file: ' || filename || chr(10) || coalesce(array_to_string(list_filter(string_split(patch, chr(10)), lambda l: starts_with(l, '+')), chr(10)), ''), chr(10) ORDER BY ord), 1, 2000)) AS text_md5
            FROM patches GROUP BY 1""",
            "patches",
        ),
        "extract_json": sql("""SELECT id, CASE id % 4 WHEN 2 THEN id::VARCHAR WHEN 3 THEN NULL ELSE '{"a":' || id || '}' END AS json FROM reviews""", "reviews"),
        "validate_model_output": sql("SELECT id, CASE WHEN file IS NULL OR line IS NULL OR status = 'dismissed' THEN 'findings: an item is invalid' END AS error FROM review_findings", "review_findings"),
        "review_summaries": sql(
            """, f AS (SELECT *, CASE verdict WHEN 'uncertain' THEN 0.5 ELSE 1 END * CASE severity WHEN 'critical' THEN 30 WHEN 'high' THEN 15 WHEN 'medium' THEN 6 ELSE 2 END AS w, CASE severity WHEN 'critical' THEN '🔴' WHEN 'high' THEN '🟠' WHEN 'medium' THEN '🟡' ELSE '🔵' END AS icon FROM own)
            SELECT review_id, md5('### 🛡️ Review: ' || printf('%.1f', greatest(0, floor(100 - s + 0.5)) / 10) || '/10' || chr(10) || chr(10) || 'What was found.' || chr(10) || chr(10) || '🔴 ' || c || ' critical · 🟠 ' || h || ' high · 🟡 ' || m || ' medium · 🔵 ' || l || ' low'
            || CASE WHEN o > 0 THEN chr(10) || chr(10) || '<details><summary>' || o || ' finding(s) outside the changed lines</summary>' || chr(10) || chr(10) || rows_ || chr(10) || '</details>' ELSE '' END
            || CASE WHEN review_id % 2 = 0 THEN chr(10) || chr(10) || '[Open the full review](https://host.example/' || review_id || ')' ELSE '' END) AS markdown_md5
            FROM (SELECT review_id, sum(w) AS s, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m, count(*) FILTER (severity = 'low') AS l,
            count(*) FILTER (NOT coalesce(line > 20, false)) AS o, string_agg('- ' || icon || ' `' || coalesce(file, 'PR') || coalesce(':' || line, '') || '` ' || message, chr(10) ORDER BY ord, id) FILTER (NOT coalesce(line > 20, false)) AS rows_ FROM f GROUP BY 1)""",
            "own",
        ),
        "normalised_paths": sql("SELECT ord, CASE ord % 4 WHEN 2 THEN 'a/' ELSE '' END || filename AS path FROM files", "files"),
        "deactivate_repositories": sql("SELECT github_repo_id, active AND github_repo_id NOT IN (SELECT user_id FROM webhook_events WHERE event_type = 'installation_repositories') AS active FROM repositories", "repositories", "webhook_events"),
        "deleted_installations": sql("SELECT github_repo_id, active AND installation_id NOT IN (SELECT installation_id FROM installations WHERE status = 'deleted') AS active FROM repositories", "repositories", "installations"),
        "refresh_index": sql(
            """SELECT repository_id, path, CASE WHEN length(blob_sha) + length(path) > 51 THEN 'new' ELSE blob_sha END AS blob_sha, CASE WHEN length(blob_sha) + length(path) > 51 THEN 2 ELSE 1 END AS start_line
            FROM code_files WHERE path NOT LIKE '%3.ts' OR repository_id NOT IN (SELECT repository_id FROM code_files WHERE path NOT LIKE '%3.ts')""",
            "code_files",
        ),
        "sweep_results": sql(
            """, p AS (SELECT *, row_number() OVER (ORDER BY received_at, event_id) AS place FROM webhook_events WHERE status = 'received' AND epoch(TIMESTAMP '2024-01-05') - floor(epoch(received_at)) > 30 ORDER BY received_at, event_id LIMIT 50),
            f AS (SELECT coalesce(min(place) FILTER (event_id % 8 = 5), 51) AS stop FROM p)
            SELECT event_id, CASE WHEN place < stop THEN 'sent' WHEN place = stop THEN 'failed' ELSE 'untouched' END AS outcome, CASE WHEN place < stop THEN 'published' ELSE 'received' END AS new_status,
            CASE WHEN place = stop THEN 'sweeper: refused d' || event_id END AS new_error, CASE WHEN place < stop THEN epoch(TIMESTAMP '2024-01-05')::BIGINT END AS published_s FROM p, f""",
            "webhook_events",
        ),
        "mark_published": sql(
            """SELECT event_id, CASE WHEN status = 'received' AND s IS NOT NULL THEN 'published' ELSE status END AS status, s AS published_s FROM webhook_events
            LEFT JOIN (SELECT delivery_id, min(1704067200 + event_id) AS s FROM webhook_events WHERE event_id % 4 <> 1 GROUP BY 1) USING (delivery_id)""",
            "webhook_events",
        ),
        "registry_sync": sql(
            """, e AS (SELECT user_id AS id, arg_max(action, (received_at, event_id)) AS action, bool_or(event_id % 5 = 0) AS named FROM webhook_events GROUP BY 1)
            SELECT coalesce(e.id, r.github_repo_id) AS github_repo_id, CASE WHEN e.id IS NOT NULL THEN 'new/r' || e.id ELSE r.full_name END AS full_name,
            CASE WHEN named THEN 'https://host.example/new' ELSE coalesce(r.html_url, 'https://github.com/' || CASE WHEN e.id IS NOT NULL THEN 'new/r' || e.id ELSE r.full_name END) END AS html_url,
            CASE WHEN r.github_repo_id % 4 <> 0 THEN 'lang' || (r.github_repo_id % 4) END AS language, CASE WHEN e.id IS NOT NULL THEN action <> 'closed' ELSE r.active END AS active,
            coalesce(r.auto_review_enabled, true) AS auto_review_enabled FROM e FULL JOIN repositories r ON r.github_repo_id = e.id""",
            "webhook_events", "repositories",
        ),
        "parsed_events": sql(
            """SELECT id, CASE WHEN id % 13 = 0 THEN 'invalid JSON' ELSE nullif('schema: ' || concat_ws('; ', CASE WHEN id % 11 = 0 THEN 'type: wrong literal' END,
            CASE WHEN installation_id IS NULL THEN 'installationId: must be a positive integer' END, CASE WHEN id % 7 = 0 THEN 'repoFullName: must be owner/name' END,
            CASE WHEN id % 6 = 0 THEN 'prNumber: must be a positive integer' END, CASE WHEN id % 5 = 0 THEN 'headSha: must be a 40-char commit sha' END,
            CASE WHEN id % 4 = 0 THEN 'trigger: must be one of webhook, manual' END), 'schema: ') END AS reason FROM reviews""",
            "reviews",
        ),
        "instructions_for": sql(
            r"""SELECT review_id, (CASE WHEN review_id % 3 = 0 THEN 3 - n ELSE n END)::INT AS place, path, instructions, md5(string_agg(filename, ',' ORDER BY ord)) AS files_md5, count(*)::INT AS n
            FROM (SELECT (ord // 20)::BIGINT AS review_id, ord, filename FROM files) f, (VALUES (0, 'src/auth/**', 'be careful', '^src/auth/.*$'), (1, '*.py', 'type it', '^(.*/)?[^/]*[.]py$'),
            (2, 'lib/*/f?.{ts,png}', 'small', '^lib/[^/]*/f[^/][.](ts|png)$'), (3, '**/*.test.ts', 'name cases', '^(.*/)?[^/]*[.]test[.]ts$')) g(n, path, instructions, pattern)
            WHERE regexp_matches(filename, pattern) GROUP BY review_id, g.n, path, instructions""".replace("count(*)::INT AS n\n", "count(*)::INT AS n\n"),
            "files",
        ),
        "extracted_imports": sql(
            """SELECT review_id AS repository_id, filename AS from_path, spec FROM files, (SELECT unnest([0, 1, 2, 4, 5]) AS k),
            LATERAL (SELECT CASE k WHEN 0 THEN './a' || ord WHEN 1 THEN 'side' WHEN 2 THEN '../b' || ord WHEN 4 THEN '@/d' ELSE './lazy' END AS spec) WHERE (k + ord) % 3 <> 0""",
            "files",
        ),
        "alias_tables": sql(
            """SELECT github_repo_id, CASE WHEN github_repo_id % 3 = 0 THEN '@/=src/,~/=src/' WHEN github_repo_id % 2 = 0
            THEN '@/=pkg' || (github_repo_id % 5) || '/src/,lib/=pkg' || (github_repo_id % 5) || '/lib' || (github_repo_id % 7) || '/' ELSE '@/=src/,lib/=lib' || (github_repo_id % 7) || '/' END AS aliases FROM repositories""",
            "repositories",
        ),
        "callers": sql(
            """, s AS (SELECT (ord // 20)::BIGINT AS review_id, ord, path, i, n, line FROM source_lines),
            known AS (SELECT review_id, 'fn' || ord || '_' || i AS symbol FROM s WHERE ord % 6 = 1 AND i % 4 = 0),
            used AS (SELECT review_id, ord, path, i, n, CASE WHEN i % 4 = 0 THEN 'fn' || ord || '_' || i ELSE 'fn' || (ord + 3) || '_' || (i - 1) END AS symbol FROM s WHERE i % 4 < 2),
            h AS (SELECT used.* FROM used JOIN known USING (review_id, symbol)),
            kept AS (SELECT * FROM (WITH RECURSIVE g AS (SELECT review_id, ord, min(i) AS i FROM h GROUP BY 1, 2
                UNION ALL SELECT review_id, ord, nxt FROM (SELECT g.review_id, g.ord, (SELECT min(h.i) FROM h WHERE h.review_id = g.review_id AND h.ord = g.ord AND h.i > g.i + 5) AS nxt FROM g) WHERE nxt IS NOT NULL) SELECT * FROM g))
            SELECT review_id, place::INT AS place, symbol, path, line, n_lines FROM (SELECT k.review_id, row_number() OVER (PARTITION BY k.review_id ORDER BY k.ord, k.i) AS place, symbol, path, (k.i + 1)::INT AS line,
            (least(n, k.i + 6) - greatest(0, k.i - 5))::INT AS n_lines FROM kept k JOIN h ON h.review_id = k.review_id AND h.ord = k.ord AND h.i = k.i) WHERE place <= 12""",
            "source_lines",
        ),
        "summary_texts": sql(
            """SELECT review_id, concat_ws(' ', CASE WHEN review_id % 3 = 0 THEN 'Renames a thing.' ELSE 'Reviewed ' || (review_id % 7) || ' file(s).' END, 'Risk: ' || CASE WHEN review_id % 2 = 0 THEN 'low' ELSE 'high' END || ' (first reason).',
            CASE WHEN review_id % 5 = 0 THEN 'No issues found.' ELSE 'Found ' || n || ' issue(s): ' || concat_ws(', ', CASE WHEN c > 0 THEN c || ' critical' END, CASE WHEN h > 0 THEN h || ' high' END, CASE WHEN md > 0 THEN md || ' medium' END,
            CASE WHEN l > 0 THEN l || ' low' END) || '.' END, CASE WHEN review_id % 4 > 0 THEN (review_id % 4) || ' possible issue(s) were checked and rejected.' END) AS summary
            FROM (SELECT review_id, count(*) AS n, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS md, count(*) FILTER (severity = 'low') AS l FROM review_findings GROUP BY 1)""",
            "review_findings",
        ),
        "check_texts": sql(
            """SELECT review_id, CASE WHEN b > 0 OR score < 40 THEN 'failure' ELSE 'success' END AS conclusion, headline[1:255] AS check_title,
            headline || chr(10) || chr(10) || '- ' || CASE WHEN b > 0 THEN '❌ ' || b || ' confirmed critical/high finding(s)' ELSE '✅ no confirmed critical/high findings' END || chr(10)
            || '- ' || CASE WHEN score < 40 THEN '❌' ELSE '✅' END || ' score ' || score || ' vs minimum 40' || CASE WHEN review_id % 9 = 0 THEN chr(10) || '- ⚠️ odd' ELSE '' END
            || chr(10) || chr(10) || '**Risk:** high (45/100): a; b' AS check_text
            FROM (SELECT *, CASE WHEN len(r) > 0 THEN 'Blocked by policy: ' || r[1] || CASE WHEN len(r) > 1 THEN ' (+' || (len(r) - 1) || ' more)' ELSE '' END ELSE 'Passes policy with ' || n || ' finding(s) worth a look' END AS headline
            FROM (SELECT review_id, n, score, len(blocking) AS b, list_concat(blocking, CASE WHEN score < 40 THEN ['score ' || score || ' is below min_score 40'] ELSE [] END) AS r
            FROM (SELECT review_id, count(*) AS n, greatest(0, floor(100 - sum(w) + 0.5))::INT AS score, coalesce(list(severity || ' ' || category || ' finding at ' || coalesce(file, 'PR') || coalesce(':' || line, '')
            ORDER BY ord, severity || ' ' || category || ' finding at ' || coalesce(file, 'PR') || coalesce(':' || line, '')) FILTER (verdict <> 'uncertain' AND severity IN ('critical', 'high')), []) AS blocking FROM weighed GROUP BY 1)))""",
            "weighed",
        ),
        "chunked_declarations": sql(
            r""", g AS (SELECT review_id, filename, ord, i - 1 AS i, len(list) AS n, regexp_matches(filename, '[.](c|m)?(j|t)sx?$') AS script,
            CASE (i - 1) % 4 WHEN 0 THEN 'function fn' || ord || '_' || (i - 1) || '() {' WHEN 1 THEN '  a = "' || md5(list[i]) || '";' WHEN 2 THEN '}' ELSE '// ' || md5(list[i]) END AS t
            FROM (SELECT *, string_split(content, chr(10)) AS list, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM files)),
            parts AS (SELECT ord, 'fn' || ord || '_' || i AS symbol, greatest(i - 1, 0) AS a, CASE WHEN i + 2 < n THEN i + 2 ELSE i END AS b FROM g WHERE script AND i % 4 = 0
                UNION ALL SELECT ord, NULL, s, least(s + 60, n) - 1 FROM (SELECT ord, n, unnest(range(0, greatest(0, ceil((n - 60) / 50)::BIGINT * 50) + 1, 50)) AS s FROM g WHERE NOT script AND i = 0))
            SELECT review_id AS repository_id, filename AS path, symbol, (a + 1)::INT AS start_line, (b + 1)::INT AS end_line, md5(string_agg(t, chr(10) ORDER BY i)) AS content_md5
            FROM parts JOIN g USING (ord) WHERE i BETWEEN a AND b GROUP BY review_id, filename, ord, symbol, a, b""",
            "files",
        ),
        "review_details": sql(
            """SELECT r.id, coalesce(pr_title, repo_full_name || '#' || pr_number) AS title, CASE WHEN r.id % 3 = 0 THEN 'https://host.example/r' || r.id ELSE 'https://host.example/' || repo_full_name END AS github_url,
            coalesce(n, 0)::INT AS n_issues, md5(coalesce(t, '')) AS issues_md5 FROM reviews r LEFT JOIN (SELECT review_id, count(*) AS n, string_agg(concat_ws(' ', ord, id, file, line, severity, status), ';' ORDER BY ord, id) AS t FROM own GROUP BY 1) f ON f.review_id = r.id""",
            "reviews", "own",
        ),
        "reposted_inline": sql(
            """SELECT review_id, f.id, CASE WHEN r.id % 5 = 0 THEN 'from' ELSE 'base' END AS from_sha, coalesce(EXISTS (SELECT 1 FROM own g WHERE g.review_id = f.review_id AND g.file = f.file AND g.line = f.line AND g.line % 4 <> 0), false) AS inline
            FROM own f JOIN reviews r ON r.id = f.review_id WHERE f.status <> 'dismissed' AND r.status = 'completed' AND score IS NOT NULL AND installation_id IS NOT NULL""",
            "reviews", "own",
        ),
        "lifecycle_progress": sql(
            """, u AS (SELECT user_id AS review_id, event_id AS seq, received_at AS ts, CASE event_id % 4 WHEN 0 THEN 'quality' WHEN 1 THEN 'security' WHEN 3 THEN 'done' END AS progress,
            CASE WHEN event_id % 5 = 0 THEN substr(repeat('e' || event_id || ' ', 300), 1, 1000) END AS error, CASE event_id % 3 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'completed' ELSE 'failed' END AS status FROM webhook_events),
            s AS (SELECT review_id, arg_max(status, seq) AS status, arg_max(progress, seq) FILTER (progress IS NOT NULL) AS progress, arg_max(error, seq) FILTER (error IS NOT NULL) AS error,
            epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS d FROM u GROUP BY 1)
            SELECT review_id, status, CASE WHEN status = 'in_progress' THEN progress END AS progress, md5(error) AS error_md5, length(error)::INT AS error_length, CASE WHEN status <> 'in_progress' THEN d END AS duration_ms FROM s""",
            "webhook_events",
        ),
        "progress_steps": sql(
            """, u AS (SELECT user_id AS review_id, event_id, CASE event_id % 4 WHEN 0 THEN 'quality' WHEN 1 THEN 'quality' WHEN 3 THEN 'security' END AS progress, CASE WHEN event_id % 97 = 0 THEN 'failed' ELSE 'in_progress' END AS status FROM webhook_events),
            c AS (SELECT *, min(event_id) FILTER (status = 'failed') OVER (PARTITION BY review_id) AS ends, lag(status || ':' || coalesce(progress, '')) OVER (PARTITION BY review_id ORDER BY event_id) AS was FROM u)
            SELECT event_id, status, progress, status = 'failed' AS done FROM c WHERE event_id <= coalesce(ends, event_id) AND (was IS NULL OR was <> status || ':' || coalesce(progress, ''))""",
            "webhook_events",
        ),
        "validated_answers": sql(
            """SELECT id, kind, CASE WHEN id % 19 = 0 THEN 'no JSON object in the answer' ELSE nullif(CASE kind
            WHEN 'review' THEN concat_ws('; ', CASE WHEN id % 3 = 0 THEN 'score' END, CASE WHEN id % 17 = 0 THEN 'findings: at most 40' END, CASE WHEN id % 11 = 0 OR id % 7 = 0 OR id % 13 = 0 THEN 'findings: an item is invalid' END)
            WHEN 'intent' THEN concat_ws('; ', CASE WHEN id % 5 = 0 THEN 'summary' END, CASE WHEN id % 6 = 0 THEN 'stated' END, CASE WHEN id % 9 = 0 THEN 'alignment' END, CASE WHEN id % 8 = 0 THEN 'alignmentScore' END)
            ELSE CASE WHEN id % 10 = 0 THEN 'verdicts: required' WHEN id % 4 = 0 OR id % 7 = 0 OR id % 5 = 0 THEN 'verdicts: an item is invalid' ELSE '' END END, '') END AS error
            FROM reviews, (SELECT unnest(['review', 'intent', 'verdicts']) AS kind)""",
            "reviews",
        ),
        "index_steps": sql(
            r"""SELECT repository_id, path, sha1(note || lines || 'export function f' || n || '() {' || chr(10) || '  x();' || chr(10) || '}' || chr(10)) AS blob_sha,
            array_to_string(list_sort(list_distinct(list_filter(imports, lambda x: x <> path AND list_contains(paths, x)))), ',') AS imports,
            (1 + CASE WHEN length(note) // 7 + len(imports) >= 3 THEN 1 ELSE 0 END)::BIGINT AS n_chunks, 'f' || n AS symbol, (length(note) // 7 + len(imports) + 1)::INT AS start_line,
            CASE WHEN note <> '' OR path LIKE '%4.ts' THEN 'v2' ELSE 'v1' END AS commit_sha, 'v2' AS indexed_sha
            FROM (SELECT *, list(path) OVER (PARTITION BY repository_id) AS paths, CASE WHEN n % 7 = 0 THEN '// new' || chr(10) ELSE '' END AS note,
            array_to_string(list_transform(imports, lambda x: 'import x from "' || regexp_replace(x, '^src/(.*)[.]ts$', './\1.js') || '";' || chr(10)), '') AS lines
            FROM (SELECT *, regexp_extract(path, '[0-9]+')::BIGINT AS n FROM code_files WHERE path NOT LIKE '%3.ts'))""",
            "code_files",
        ),
        "finding_statuses": sql("SELECT review_id, id, CASE category WHEN 'security' THEN status WHEN 'style' THEN 'resolved' WHEN 'bug' THEN 'dismissed' ELSE 'open' END AS status FROM own", "own"),
        "auto_reviews": sql(
            "SELECT github_repo_id, coalesce(e, auto_review_enabled) AS auto_review_enabled FROM repositories LEFT JOIN (SELECT user_id AS github_repo_id, arg_max(status = 'published', event_id) AS e FROM webhook_events GROUP BY 1) USING (github_repo_id)",
            "repositories", "webhook_events",
        ),
        "claim_owner": sql("SELECT installation_id, CASE WHEN status = 'active' THEN owner_user_id WHEN installation_id % 2 = 0 THEN 'x' || installation_id END AS owner_user_id FROM installations", "installations"),
        "ingest_diff_files": sql(
            "SELECT review_id, ord, filename, additions, deletions FROM (SELECT review_id // 2 AS review_id, ord, filename, additions, deletions, row_number() OVER (PARTITION BY review_id // 2 ORDER BY ord) AS n FROM files) WHERE n <= 300", "files"
        ),
        "decoded_blobs": sql("SELECT ord, CASE WHEN strlen(content) <= 4000 AND NOT contains(content, chr(0)) THEN md5(content) END AS content_md5 FROM files", "files"),
        "assurance_records": sql(
            """SELECT review_id, CASE WHEN b > 0 OR score < 40 THEN 'request_changes' ELSE 'comment' END AS verdict, score / 10 AS overall, u AS uncertain,
            CASE WHEN b > 0 OR score < 40 THEN 'Fix before merging: ' || array_to_string(list_concat(r, CASE WHEN score < 40 THEN ['score ' || score || ' is below min_score 40'] ELSE [] END)[1:3], '; ') END AS recommendation, NULL::VARCHAR AS intent
            FROM (SELECT review_id, greatest(0, floor(100 - sum(w) + 0.5))::INT AS score, count(*) FILTER (verdict <> 'uncertain' AND severity = 'critical') AS b, count(*) FILTER (verdict = 'uncertain') AS u,
            coalesce(list(severity || ' ' || category || ' finding at ' || coalesce(file, 'PR') || coalesce(':' || line, '') ORDER BY ord, severity || ' ' || category || ' finding at ' || coalesce(file, 'PR') || coalesce(':' || line, ''))
            FILTER (verdict <> 'uncertain' AND severity = 'critical'), []) AS r FROM weighed GROUP BY 1)""",
            "weighed",
        ),
        "dedupe_findings": sql(
            f""", f AS (SELECT review_id, file, list({{'r': CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, 'o': ord, 'id': id, 'l': coalesce(line, 0), 'c': category, 'w': {WORDS.replace('text', 'message')}}}
            ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, ord, id) AS fs FROM own GROUP BY 1, 2),
            kept AS (SELECT review_id, list_reduce(list_transform(fs, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: (k.l = x[1].l AND (k.c = x[1].c OR {JACCARD} >= 0.2)) OR (abs(k.l - x[1].l) BETWEEN 1 AND 2 AND {JACCARD} >= 0.35))) > 0
            THEN acc ELSE list_concat(acc, x) END) AS ks FROM f)
            SELECT review_id, k.id AS id FROM (SELECT review_id, unnest(ks) AS k FROM kept)""",
            "own",
        ),
        "pack_diff": sql(
            f""", judged AS (SELECT review_id, ord, filename, status, length(patch) AS size, {REASON} AS reason FROM patches),
            lens AS (SELECT review_id, ord, sum(length(text) + 10) - 1 AS n FROM patch_lines GROUP BY 1, 2),
            sized AS (SELECT j.*, CASE WHEN reason IS NULL THEN length('<file path="" status="">') + length(filename) + length(status) + 1 + coalesce(n, 0) + length('</file>') + 1 END AS chars FROM judged j LEFT JOIN lens USING (review_id, ord)),
            folded AS (SELECT review_id, list_reduce(list_prepend({{'used': 0::BIGINT, 'n': 0::BIGINT, 'chars': 0::BIGINT}}, list({{'used': ceil(chars / 4)::BIGINT, 'n': 1::BIGINT, 'chars': chars::BIGINT}} ORDER BY size, ord, filename) FILTER (reason IS NULL)),
            lambda a, f: CASE WHEN a.used + f.used <= 12000 THEN {{'used': a.used + f.used, 'n': a.n + 1, 'chars': a.chars + f.chars}} ELSE a END) AS a, count(*) AS files FROM sized GROUP BY 1)
            SELECT review_id, coalesce(a.n, 0)::INT AS n_included, (files - coalesce(a.n, 0))::INT AS n_skipped, (coalesce(a.chars, 0) + 2 * greatest(coalesce(a.n, 0) - 1, 0))::INT AS n_chars FROM folded""",
            "patch_lines", "patches",
        ),
    }
    found["eval_summary"] = f"""SELECT round(sum(found) / sum(expected), 2) AS recall, round((sum(findings) - sum("falsePositives")) / sum(findings), 2) AS "precision",
        sum("falsePositives")::BIGINT AS "falsePositives", count(*) FILTER (name % 10 = 0) AS errors, (7 * count(*))::BIGINT AS tokens FROM ({found["eval_metrics"]})"""
    half = lambda odd: f"""(SELECT round(sum(found) / sum(expected), 2) AS r, round((sum(findings) - sum("falsePositives")) / sum(findings), 2) AS p FROM ({found["eval_metrics"]}) WHERE name % 2 = {odd})"""
    found["eval_gate"] = f"""SELECT round(a.r - b.r, 2) AS recall_change, round(a.p - b.p, 2) AS precision_change, round(a.r - b.r, 2) >= -0.1 AND round(a.p - b.p, 2) >= -0.1 AS passed FROM {half(1)} a, {half(0)} b"""
    return found
