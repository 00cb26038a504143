"""The review model's tables as views over star-schema tables: each column follows from a row's own values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Spark SQL for each model table. The expressions are plain, so another engine can be asked the same.
VIEWS = {
    "installations": """
        SELECT s_suppkey AS installation_id, concat('org', s_suppkey) AS account_login,
               concat('u', s_nationkey) AS owner_user_id,
               CASE s_suppkey % 7 WHEN 0 THEN 'deleted' WHEN 1 THEN 'suspended' ELSE 'active' END AS status,
               timestamp_seconds(1700000000 + s_suppkey * 3600) AS created_at
        FROM supplier""",
    "repositories": """
        SELECT c_custkey AS github_repo_id, concat('repo-', c_custkey) AS id, c_custkey % 97 + 1 AS installation_id,
               concat('o', c_custkey % 20, '/r', c_custkey) AS full_name, c_custkey % 3 <> 0 AS auto_review_enabled,
               c_custkey % 11 <> 0 AS active, c_custkey % 2 = 0 AS private, 'main' AS default_branch,
               CASE WHEN c_custkey % 5 <> 0 THEN sha1(cast(c_custkey AS string)) END AS indexed_sha,
               CASE WHEN c_custkey % 4 <> 0 THEN concat('lang', c_custkey % 4) END AS language,
               CASE WHEN c_custkey % 6 <> 0 THEN concat('https://host.example/o', c_custkey % 20, '/r', c_custkey) END AS html_url
        FROM customer""",
    "reviews": """
        SELECT o_orderkey AS id, concat('o', o_custkey % 20, '/r', o_custkey) AS repo_full_name,
               cast(o_orderkey % 97 + 1 AS int) AS pr_number, sha1(cast(o_orderkey AS string)) AS head_sha,
               CASE WHEN o_orderstatus = 'F' THEN 'completed'
                    WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'in_progress' END
                    WHEN o_orderkey % 4 = 0 THEN 'failed' ELSE 'completed' END AS status,
               CASE WHEN o_orderkey % 13 <> 0 THEN cast(floor(o_totalprice) AS bigint) % 101 END AS score,
               CASE WHEN o_orderkey % 9 <> 0 THEN concat('Change ', o_orderkey) END AS pr_title,
               CASE WHEN o_orderkey % 8 <> 0 THEN o_custkey % 97 + 1 END AS installation_id,
               cast(o_orderkey % 5 AS int) AS attempts, o_orderdate AS created_at,
               timestamp_seconds(unix_timestamp(o_orderdate) + o_orderkey % 3000) AS updated_at,
               timestamp_seconds(unix_timestamp(o_orderdate) + 3600 + o_orderkey % 500) AS completed_at
        FROM orders""",
    "review_findings": """
        SELECT l_orderkey AS review_id, l_linenumber AS ord,
               md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus, l_returnflag)) AS id,
               CASE WHEN l_partkey % 29 <> 0 THEN concat('src/p', l_partkey % 50, '.ts') END AS file,
               CASE WHEN l_partkey % 17 <> 0 THEN cast(l_partkey % 40 + 1 AS int) END AS line,
               CASE WHEN l_quantity < 8 THEN 'critical' WHEN l_quantity < 20 THEN 'high'
                    WHEN l_quantity < 35 THEN 'medium' ELSE 'low' END AS severity,
               CASE l_partkey % 5 WHEN 0 THEN 'security' WHEN 1 THEN 'bug' WHEN 2 THEN 'performance'
                    WHEN 3 THEN 'maintainability' ELSE 'style' END AS category,
               CASE l_returnflag WHEN 'N' THEN 'open' WHEN 'R' THEN 'resolved' ELSE 'dismissed' END AS status,
               concat('value part', l_partkey % 7, ' may be null in call', l_suppkey % 5) AS message,
               CASE WHEN l_suppkey % 4 = 0 THEN 'eslint' ELSE 'ai' END AS source,
               CASE WHEN l_suppkey % 4 = 0 THEN 'eslint' ELSE CASE l_suppkey % 3 WHEN 0 THEN 'quality'
                    WHEN 1 THEN 'security' ELSE 'testing' END END AS reviewer,
               CASE WHEN l_linenumber % 3 = 0 THEN 'uncertain' ELSE 'confirmed' END AS verdict
        FROM lineitem""",
    "webhook_events": """
        SELECT event_id, concat('d', event_id % 9000) AS delivery_id, ts AS received_at,
               CASE event_type WHEN 'view' THEN 'pull_request' WHEN 'signup' THEN 'installation' WHEN 'error' THEN 'push'
                    WHEN 'click' THEN 'issue_comment' ELSE 'installation_repositories' END AS event_type,
               CASE event_id % 3 WHEN 0 THEN 'received' WHEN 1 THEN 'published' ELSE 'failed' END AS status,
               user_id AS github_repo_id,
               concat('{"action":"', CASE user_id % 6 WHEN 0 THEN 'opened' WHEN 1 THEN 'synchronize' WHEN 2 THEN 'closed'
                      WHEN 3 THEN 'reopened' WHEN 4 THEN 'created' ELSE 'added' END,
                      '","number":', event_id % 50, ',"installation":{"id":', user_id % 97 + 1,
                      '},"repository":{"id":', user_id % 1500, ',"full_name":"o', user_id % 20, '/r', user_id % 1500,
                      '","default_branch":"main"},"ref":"refs/heads/', CASE WHEN event_id % 4 = 0 THEN 'topic' ELSE 'main' END,
                      '","after":"', sha1(cast(event_id AS string)), '","pull_request":{"draft":',
                      CASE WHEN event_id % 7 = 0 THEN 'true' ELSE 'false' END, ',"state":"',
                      CASE WHEN event_id % 5 = 0 THEN 'closed' ELSE 'open' END, '","head":{"sha":"',
                      sha1(cast(event_id AS string)), '"}}}') AS payload
        FROM events""",
    "code_files": """
        SELECT cast(p_partkey div 100 AS bigint) AS repository_id, concat('src/p', p_partkey, '.ts') AS path,
               sha1(concat(p_name, p_size)) AS blob_sha, transform(sequence(1, cast(p_partkey % 4 AS int) + 1),
               i -> concat('src/p', p_partkey div 100 * 100 + (p_partkey * i * 7 + i) % 100, '.ts')) AS imports
        FROM part""",
    "code_chunks": """
        SELECT vec_id AS id, cast(label AS bigint) AS repository_id, concat('src/f', vec_id % 40, '.ts') AS path,
               cast(vec_id % 300 + 1 AS int) AS start_line, embedding
        FROM embeddings""",
    "files": """
        SELECT cast(doc_id div 300 AS bigint) AS review_id, concat(CASE doc_id % 9 WHEN 0 THEN 'src/auth/' WHEN 1 THEN 'dist/'
               WHEN 2 THEN 'src/' ELSE 'lib/' END, source, '/f', doc_id, CASE doc_id % 5 WHEN 0 THEN '.min.js' WHEN 1 THEN '.ts'
               WHEN 2 THEN '.test.ts' WHEN 3 THEN '.py' ELSE '.png' END) AS filename, cast(doc_id AS int) AS ord,
               CASE doc_id % 6 WHEN 0 THEN 'removed' WHEN 1 THEN 'added' ELSE 'modified' END AS status,
               cast(n_chars % 90 AS int) AS additions, cast(n_chars % 40 AS int) AS deletions, text AS content
        FROM documents""",
}
#: The tables that each view reads.
BASE = {
    "installations": "supplier", "repositories": "customer", "reviews": "orders", "review_findings": "lineitem", "webhook_events": "events",
    "code_files": "part", "code_chunks": "embeddings", "files": "documents",
}


def model(spark: SparkSession, sf_dir: str, name: str, by: str | None = None) -> DataFrame:
    """The model table of that name over the Parquet tables in sf_dir.

    by names a column of the given table whose equal values are to lie together. The given rows are shuffled for that, which
    are shorter than the view's; what groups, joins or ranks by the view's column for it shuffles no more.
    """
    base = spark.read.parquet(f"{sf_dir}/{BASE[name]}.parquet")
    view = VIEWS[name].replace("{", "{{").replace("}", "}}")
    return spark.sql(view.replace(f"FROM {BASE[name]}", "FROM {base}"), base=base.repartition(by) if by else base)
