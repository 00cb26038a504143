"""Streams run to their end over files and restarted; compositions with scripted models."""

import json
import shutil
import sys
import time
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from changelens.plans import reviews as plans
from changelens.sources import topics
from changelens.streaming import keyed, streams

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers can't import tests


def put(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def test_ingest_survives_restarts_and_late_repeats(spark, tmp_path):
    schema = "delivery_id string, received_at timestamp, body string"
    source = lambda: spark.readStream.schema(schema).json(str(tmp_path / "in"))
    # The clock is the event's own time here, so that hours pass between files.
    go = lambda ck="ck": run(streams.ingest_stream(source(), str(tmp_path / "table"), str(tmp_path / ck), wait="1 hour", arrived=F.col("received_at"), buckets=4))
    put(tmp_path / "in", "1", [{"delivery_id": d, "received_at": "2024-01-01T00:00:00", "body": "first"} for d in ("a", "b", "a")])
    go()
    put(tmp_path / "in", "2", [{"delivery_id": d, "received_at": "2024-01-05T00:00:00", "body": "second"} for d in ("b", "c")])
    go()
    put(tmp_path / "in", "3", [{"delivery_id": d, "received_at": "2024-01-09T00:00:00", "body": "third"} for d in ("a", "c", "d")])
    go()
    want = [("a", "first"), ("b", "first"), ("c", "second"), ("d", "third")]
    read = lambda: sorted((r["delivery_id"], r["body"]) for r in spark.read.parquet(str(tmp_path / "table")).collect())
    assert read() == want
    go("lost")  # a new checkpoint replays everything
    assert read() == want
    put(tmp_path / "in", "4", [{"delivery_id": "e", "received_at": "2024-02-09T00:00:00", "body": "x"}])
    go()
    query = source().withWatermark("received_at", "1 hour").dropDuplicatesWithinWatermark(["delivery_id"]).writeStream.format("noop")
    query = query.option("checkpointLocation", str(tmp_path / "ck2")).option("maxFilesPerTrigger", 1).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3  # state holds what may still repeat, not all five


def test_topics_and_dead_letters(spark, tmp_path):
    good = json.dumps({"type": "webhook.received", "webhookEventId": "123e4567-e89b-42d3-a456-426614174000", "deliveryId": "d", "eventType": "push", "action": None})
    put(tmp_path / "in", "1", [{"key": "k", "value": v, "topic": "events", "offset": i, "ts": "2024-01-01T00:00:00"} for i, v in enumerate([good, "{oops", "{}"])])
    raw = topics.read_topic(spark, "events", path=str(tmp_path / "in"))
    valid, letters = streams.split_events(raw, "webhook.received")
    run(topics.write_topic(topics.to_messages(valid, "next", F.col("key"), ["deliveryId"]), checkpoint=str(tmp_path / "c1"), path=str(tmp_path / "out")))
    run(topics.write_topic(letters.select("key", "value", "topic"), checkpoint=str(tmp_path / "c2"), path=str(tmp_path / "dlq")))
    assert [json.loads(r["value"]) for r in spark.read.json(str(tmp_path / "out")).collect()] == [{"deliveryId": "d"}]
    assert sorted(r["value"] for r in spark.read.json(str(tmp_path / "dlq")).collect()) == ["{oops", "{}"]


def test_upserts_follow_the_stream_and_a_lost_checkpoint(spark, tmp_path):
    schema = "installation_id long, at timestamp, seq long, status string, account_login string, owner_user_id string"
    source = lambda: spark.readStream.schema(schema).json(str(tmp_path / "in"))
    rule = streams.INSTALLATIONS
    table = streams.keyed_table(spark.createDataFrame([], schema), rule, str(tmp_path / "table"), 4)
    go = lambda ck="ck": run(streams.upsert_stream(source(), rule, table, str(tmp_path / ck)))
    row = lambda i, seq, status=None, owner=None: {"installation_id": i, "at": "2024-01-01T00:00:00", "seq": seq, "status": status, "account_login": f"org{i}", "owner_user_id": owner}
    read = lambda: sorted((r["installation_id"], r["status"], r["owner_user_id"]) for r in table.read(spark).collect())
    put(tmp_path / "in", "1", [row(1, 1, "active"), row(1, 3, "suspended", "u2"), row(2, 2, "active")])
    go()
    assert read() == [(1, "suspended", "u2"), (2, "active", None)]
    put(tmp_path / "in", "2", [row(1, 2, "active", "u1"), row(2, 5, None, "u3"), row(3, 1, "deleted")])  # one of them late
    go()
    want = [(1, "suspended", "u1"), (2, "active", "u3"), (3, "deleted", None)]
    assert read() == want
    # Without its checkpoint the stream begins again at batch 0, and leaves the table as it was.
    shutil.rmtree(tmp_path / "ck")
    (tmp_path / "in" / "2.json").rename(tmp_path / "2.json")
    go()
    assert read() == want


def test_repositories_keep_the_users_switch(spark, tmp_path):
    schema = "github_repo_id long, at timestamp, seq long, installation_id long, full_name string, private boolean, html_url string, language string, description string, active boolean, auto_review_enabled boolean"
    rule = streams.REPOSITORIES
    table = streams.keyed_table(spark.createDataFrame([], schema), rule, str(tmp_path / "table"), 2)
    base = {"github_repo_id": 1, "at": "2024-01-01T00:00:00"}
    put(tmp_path / "in", "1", [base | {"seq": 1, "installation_id": 5, "full_name": "o/old", "private": False, "language": "go", "active": True}, base | {"seq": 2, "auto_review_enabled": False}])
    put(tmp_path / "in", "2", [base | {"seq": 3, "installation_id": 5, "full_name": "o/new", "private": True, "html_url": "u", "active": True}])
    run(streams.upsert_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), rule, table, str(tmp_path / "ck")))
    r = table.read(spark).first()
    assert (r["full_name"], r["private"], r["html_url"], r["language"], r["active"], r["auto_review_enabled"]) == ("o/new", True, "u", "go", True, False)


def keyed_run(df, folder, name, n=0, until=None):
    """Runs a stream with timers, which under availableNow would never end, until it has read n rows and until() holds."""
    writer = df.writeStream.format("json").option("path", str(folder / name)).option("checkpointLocation", str(folder / f"ck-{name}"))
    query = writer.trigger(processingTime="100 milliseconds").start()
    end = time.monotonic() + 90
    try:
        while sum(p["numInputRows"] for p in query.recentProgress) < n or until and not until():
            assert time.monotonic() < end and query.exception() is None
            time.sleep(0.1)
    finally:
        query.stop()


CLAIM = "repo_full_name string, pr_number int, head_sha string, seq long, status string"


def test_claims_and_their_end(spark, tmp_path):
    ask = lambda seq, sha="a", status=None: {"repo_full_name": "o/r", "pr_number": 1, "head_sha": sha, "seq": seq, "status": status}
    out = lambda: sorted((r["head_sha"], r["seq"], r["claimed"]) for r in spark.read.json(str(tmp_path / "claimed")).collect())
    go = lambda n: keyed_run(keyed.claims(spark.readStream.schema(CLAIM).json(str(tmp_path / "c")), keep="8 seconds"), tmp_path, "claimed", n)
    put(tmp_path / "c", "1", [ask(2), ask(1)])
    go(2)
    again = [(4, "failed"), (5, None), (6, "in_progress"), (7, None), (8, "pending"), (9, None), (10, None), (11, "completed"), (12, None)]
    put(tmp_path / "c", "2", [ask(3, "b"), *(ask(seq, "a", status) for seq, status in again)])
    go(10)  # a restart
    assert out() == [("a", 1, True), ("a", 2, False), ("a", 5, True), ("a", 7, False), ("a", 9, True), ("a", 10, False), ("a", 12, False), ("b", 3, True)]
    time.sleep(8)
    put(tmp_path / "c", "3", [ask(20, "b")])
    go(1)
    assert ("b", 20, True) in out()  # forgotten in the meantime


def test_progress_until_the_end(spark, tmp_path):
    updates = [("in_progress", "quality"), ("in_progress", "quality"), ("in_progress", "scorecard"), ("completed", None), ("in_progress", "late")]
    rows = [{"review_id": 1, "seq": i, "status": s, "progress": p} for i, (s, p) in enumerate(updates)]
    stream = lambda: keyed.progress(spark.readStream.schema("review_id long, seq long, status string, progress string").json(str(tmp_path / "p")))
    put(tmp_path / "p", "1", rows[:2])
    keyed_run(stream(), tmp_path, "changes", 2)
    put(tmp_path / "p", "2", rows[2:])
    keyed_run(stream(), tmp_path, "changes", 3)
    assert sorted((r["seq"], r["done"]) for r in spark.read.json(str(tmp_path / "changes")).collect()) == [(0, False), (2, False), (3, True)]


def test_stuck_reviews_are_sent_round_and_fail(spark, tmp_path):
    stream = lambda: keyed.stuck(spark.readStream.schema("review_id long, status string").json(str(tmp_path / "u")), idle="6 seconds", most=1)
    schema = "review_id long, attempts int, status string, error string"
    out = lambda: sorted((r["review_id"], r["attempts"], r["status"], r["error"]) for r in spark.read.schema(schema).json(str(tmp_path / "stuck")).collect()) if (tmp_path / "stuck").exists() else []
    put(tmp_path / "u", "1", [{"review_id": 1, "status": "in_progress"}, {"review_id": 2, "status": "in_progress"}, {"review_id": 2, "status": "completed"}])
    keyed_run(stream(), tmp_path, "stuck", 3)
    put(tmp_path / "u", "2", [{"review_id": 9, "status": "completed"}])
    keyed_run(stream(), tmp_path, "stuck", until=lambda: len(out()) == 2)  # a restart: timers are state
    assert out() == [(1, 1, "failed", "Timed out after 1 attempts"), (1, 1, "pending", None)]


def test_messages_come_out_in_order(spark, tmp_path):
    stream = lambda: keyed.in_order(spark.readStream.schema("key string, seq long, value string").json(str(tmp_path / "m")), wait="12 seconds")
    rows = lambda: spark.read.schema("key string, seq long, value string, place long, late boolean").json(str(tmp_path / "ordered")).collect()
    out = lambda key: [(r["seq"], r["late"]) for r in sorted(rows(), key=lambda r: r["place"]) if r["key"] == key]
    message = lambda key, *seqs: [{"key": key, "seq": s, "value": f"v{s}"} for s in seqs]
    put(tmp_path / "m", "1", message("a", 3, 2) + message("b", 2, 1))
    keyed_run(stream(), tmp_path, "ordered", 4)
    assert out("a") == [] and out("b") == [(1, False), (2, False)]
    put(tmp_path / "m", "2", message("a", 1, 6, 2) + message("b", 2, 4))
    keyed_run(stream(), tmp_path, "ordered", 5)
    assert out("a") == [(1, False), (2, False), (3, False)] and out("b") == [(1, False), (2, False)]
    put(tmp_path / "m", "4", message("c", 1))
    # 4 and 5 of a and 3 of b don't come in time.
    keyed_run(stream(), tmp_path, "ordered", until=lambda: len(rows()) == 8)
    assert out("a")[3:] == [(6, False)] and out("b")[2:] == [(4, False)]
    put(tmp_path / "m", "3", message("a", 5, 5, 7, 6))
    keyed_run(stream(), tmp_path, "ordered", 4)
    assert sorted(out("a")[4:]) == [(5, True), (7, False)] and len({(r["key"], r["place"]) for r in rows()}) == len(rows()) == 10
    assert {r["value"] for r in rows() if r["seq"] == 6} == {"v6"}


def test_keyed_state_asks_for_its_store(spark):
    provider = spark.conf.get(keyed.PROVIDER)
    spark.conf.set(keyed.PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError, match="RocksDB"):
            keyed.stuck(spark.readStream.format("rate").load().selectExpr("value as review_id", "'pending' as status"))
        assert spark.conf.get(keyed.PROVIDER).endswith("HDFSBackedStateStoreProvider")
    finally:
        spark.conf.set(keyed.PROVIDER, provider)


def test_retries_come_back_in_later_batches_and_end_in_dead_letters(spark, tmp_path):
    put(tmp_path / "in", "1", [{"row_key": k} for k in ("ok", "once", "never")])
    tries, dead = [], []

    def handle(batch):
        keys = sorted(r["row_key"] for r in batch.collect())
        tries.append(keys)
        bad = [(k, "down") for k in keys if k == "never" or k == "once" and sum("once" in t for t in tries) < 2]
        return batch.sparkSession.createDataFrame(bad, "row_key string, error string")

    def failed(rows, batch_id):
        dead.extend((r["row_key"], r["reason"]) for r in rows.collect())

    def go():
        stream = spark.readStream.schema("row_key string").json(str(tmp_path / "in"))
        started = time.monotonic()
        run(streams.retry_or_dead_letter(stream, handle, failed, str(tmp_path / "ck"), str(tmp_path / "retries"), pause=0.2))
        return time.monotonic() - started

    go()
    put(tmp_path / "in", "2", [{"row_key": "other"}])
    time.sleep(0.5)
    go()
    time.sleep(0.7)
    go()
    assert [k for t in tries for k in t].count("never") == 3 and dead == [("never", "failed after 3 attempts: down")]
    assert [t for t in tries if t] == [["never", "ok", "once"], ["never", "once", "other"], ["never"]]
    go()
    assert sum(map(len, tries)) == 7


def test_rows_that_are_not_due_go_round(spark, tmp_path):
    put(tmp_path / "in", "1", [{"row_key": "x"}])
    tries = []

    def handle(batch):
        tries.extend(r["row_key"] for r in batch.collect())
        return batch.select("row_key", F.lit("down").alias("error"))

    go = lambda: run(streams.retry_or_dead_letter(spark.readStream.schema("row_key string").json(str(tmp_path / "in")), handle, lambda *_: None, str(tmp_path / "ck"), str(tmp_path / "r"), pause=3600))
    for _ in range(3):
        go()
    assert tries == ["x"]
    waiting = spark.read.option("recursiveFileLookup", "true").json(str(tmp_path / "r"))
    assert {r["attempt"] for r in waiting.collect()} == {2} and waiting.count() >= 2


def test_publishing_records_what_was_sent(spark, tmp_path):
    put(tmp_path / "in", "1", [{"delivery_id": d} for d in ("a", "b")])
    sent = lambda batch: batch.filter("delivery_id = 'a'").withColumn("sent_at", F.lit("2024-01-01").cast("timestamp"))
    run(streams.publish_stream(spark.readStream.schema("delivery_id string").json(str(tmp_path / "in")), sent, str(tmp_path / "sent"), str(tmp_path / "ck")))
    assert [r["delivery_id"] for r in spark.read.parquet(str(tmp_path / "sent")).collect()] == ["a"]


def test_published_once_after_a_lost_checkpoint(spark, tmp_path):
    put(tmp_path / "in", "1", [{"delivery_id": d} for d in ("a", "b")])
    sent = lambda batch: batch.withColumn("sent_at", F.current_timestamp())
    go = lambda ck: run(streams.publish_stream(spark.readStream.schema("delivery_id string").json(str(tmp_path / "in")), sent, str(tmp_path / "sent"), str(tmp_path / ck)))
    go("ck")
    first = {r["delivery_id"]: r["sent_at"] for r in spark.read.parquet(str(tmp_path / "sent")).collect()}
    put(tmp_path / "in", "2", [{"delivery_id": "c"}])
    go("lost")
    after = {r["delivery_id"]: r["sent_at"] for r in spark.read.parquet(str(tmp_path / "sent")).collect()}
    assert set(after) == {"a", "b", "c"} and all(after[k] == v for k, v in first.items()) and spark.read.parquet(str(tmp_path / "sent")).count() == 3


PATCH = "@@ -1,1 +1,3 @@\n a\n+b = run()\n+c"
FILES = "review_id long, repository_id string, ord int, filename string, status string, patch string, additions int, deletions int"
LINT = "review_id long, ord int, file string, line int, rule_id string, message string, severity string"


def finding(line, severity, message):
    return {"file": "src/auth.ts", "line": line, "severity": severity, "category": "bug", "message": message, "suggestion": None}


def inputs(spark):
    reviews = spark.createDataFrame([(1, "title", "body"), (2, "nothing", None)], "review_id long, title string, body string")
    files = spark.createDataFrame([(1, "r", 0, "src/auth.ts", "modified", PATCH, 2, 0), (2, "r", 0, "img.png", "modified", None, 0, 0)], FILES)
    return reviews, files, spark.createDataFrame([(1, 0, "src/auth.ts", 3, "no-eval", "bad", "error")], LINT)


def test_single_pass_with_one_repair(spark, tmp_path):
    reviews, files, lint = inputs(spark)

    def model(prompts):
        ok = json.dumps({"summary": "fine", "score": 80, "findings": [finding(2, "high", "real problem"), finding(99, "low", "elsewhere")]})
        return [(ok if "failed validation" in p else "no json", 5) for p in prompts]

    scored, found = plans.single_pass_review(reviews, files, lint, model)
    assert sorted((r["review_id"], r["score"], r["error"]) for r in scored.collect()) == [(1, 80, None), (2, 100, None)]
    assert sorted((r["line"], r["inline"], r["source"]) for r in found.collect()) == [(2, True, "ai"), (3, True, "eslint"), (99, False, "ai")]


def test_staged_review(spark):
    reviews, files, lint = inputs(spark)
    contexts = "review_id long, rules array<struct<path:string,files:array<string>,instructions:string>>, callers array<struct<symbol:string,path:string,line:int,snippet:string>>, affected array<struct<path:string,distance:int,via:string>>, related array<struct<path:string,start_line:int,end_line:int,symbol:string,content:string>>"
    contexts = spark.createDataFrame([(i, [], [], [], []) for i in (1, 2)], contexts)
    policies = spark.createDataFrame([(i, ["critical"], 0, []) for i in (1, 2)], "review_id long, fail_on array<string>, min_score int, warnings array<string>")
    risk = spark.createDataFrame([(1, 10, "low", ["x"])], "review_id long, score int, level string, factors array<string>")
    contents = spark.createDataFrame([(1, "src/auth.ts", "a\nb = run()\nc")], "review_id long, file string, content string")
    reviewer = lambda prompts: [
        (json.dumps({"findings": [finding(2, "critical", "run is never awaited"), finding(2, "high", "run is not awaited here")]}) if "no-eval" in p else "garbage", 7) for p in prompts
    ]
    verifier = lambda prompts: [(json.dumps({"verdicts": [{"id": 0, "verdict": "confirmed", "confidence": 0.9, "reason": ""}]}), 3) for _ in prompts]
    out = plans.staged_review(reviews, files, lint, contexts, policies, risk, contents, reviewer, verifier)
    assert sorted((r["line"], r["source"], r["verdict"]) for r in out["findings"].collect()) == [(2, "ai", "confirmed"), (3, "eslint", "confirmed")]
    decision = {r["review_id"]: r["verdict"] for r in out["decision"].collect()}
    assert decision == {1: "request_changes", 2: "approve"}
    assert {r["review_id"]: r["score"] for r in out["score"].collect()} == {1: 64, 2: 100}
    assert out["status"].first()["failed_reviewers"] == ["security", "testing"]
    report = {r["review_id"]: r for r in out["report"].collect()}
    assert report[1]["summary"].startswith("Reviewed 1 file(s). Risk: low (x). Found 2 issue(s): 1 critical, ")
    assert report[1]["recommendations"][1:] == ["Re-run the review: the security and testing reviewer(s) failed."]
    assert report[2]["summary"].startswith("No reviewable code changes") and report[2]["check_title"] == "Passes policy; no issues found"
    record = {r["review_id"]: json.loads(r["assurance"]) for r in out["assurance"].collect()}
    assert record[1]["skills"] == ["quality"] and record[1]["intent"] is None and record[1]["verification"]["confirmed"] == 2 and record[1]["scorecard"]["overall"] == 6.4
    assert record[2]["scorecard"] is None and record[2]["verification"] is None and record[2]["recommendations"] == [] and record[2]["decision"]["verdict"] == "approve"
    assert out["failed"].count() == 0 and report[1]["check_text"].startswith("Blocked by policy")

    aim = lambda prompts: [
        (json.dumps({"summary": "Awaits the run.", "changeType": "fix", "stated": True, "alignment": "misaligned", "alignmentScore": 2, "alignmentSummary": "no"}), 5) for _ in prompts
    ]
    told = plans.staged_review(reviews, files, lint, contexts, policies, risk, contents, reviewer, verifier, aim)
    full = told["report"].filter("review_id = 1").first()
    assert full["summary"].startswith("Awaits the run. Risk: low") and full["recommendations"][-1].startswith("The code doesn't match")
    assert json.loads(told["assurance"].filter("review_id = 1").first()["assurance"])["alignment"]["alignment"] == "misaligned"
    assert {r["review_id"]: r["tokens"] for r in told["tokens"].collect()}[1] == {r["review_id"]: r["tokens"] for r in out["tokens"].collect()}[1] - 14 + 5
    silent = plans.staged_review(reviews, files, lint, contexts, policies, risk, contents, lambda prompts: [("garbage", 1) for _ in prompts], verifier)
    assert [(r["review_id"], r["error"][:22]) for r in silent["failed"].collect()] == [(1, "all reviewers failed: ")]
    assert [r["review_id"] for r in silent["report"].collect()] == [2] and silent["decision"].count() == 1
    assert {r["dimension"]: r["score"] for r in out["dimensions"].collect()} == {"quality": 6.4, "security": None, "testing": None}


def test_review_context(spark):
    _, files, _ = inputs(spark)
    files = files.filter("review_id = 1")
    policies = spark.createDataFrame([(1, ["docs/**"], [("src/**", "care")])], "review_id long, ignore array<string>, path_instructions array<struct<path:string,instructions:string>>")
    code = spark.createDataFrame([("r", "src/login.ts", ["src/auth.ts"])], "repository_id string, path string, imports array<string>")
    contents = spark.createDataFrame(
        [(1, 0, "src/auth.ts", "export function check(a) {\n  b = run();\n  c;\n}"), (1, 1, "src/login.ts", "x;\nif (check(1)) {}")], "review_id long, ord int, path string, content string"
    )
    out = plans.review_context(files, policies, code, contents)
    assert [r["path"] for r in out["affected"].collect()] == ["src/login.ts"]
    assert [(r["symbol"], r["path"], r["line"]) for r in out["callers"].collect()] == [("check", "src/login.ts", 2)]
    assert out["risk"].first()["score"] == 32 and [r["files"] for r in out["rules"].collect()] == [["src/auth.ts"]]


def test_nobody_is_approved_unreviewed(spark):
    reviews, files, lint = inputs(spark)
    more = [(3, "no context", ""), (4, "no policy", "")]
    reviews = reviews.unionByName(spark.createDataFrame(more, reviews.schema))
    files = files.unionByName(spark.createDataFrame([(i, "r", 0, "src/auth.ts", "modified", PATCH, 2, 0) for i in (3, 4)], FILES))
    contexts = "review_id long, rules array<struct<path:string,files:array<string>,instructions:string>>, callers array<struct<symbol:string,path:string,line:int,snippet:string>>, affected array<struct<path:string,distance:int,via:string>>, related array<struct<path:string,start_line:int,end_line:int,symbol:string,content:string>>"
    contexts = spark.createDataFrame([(1, [], None, [], []), (4, [], [], [], [])], contexts)
    policies = spark.createDataFrame([(i, ["high"], 0, []) for i in (1, 2, 3)], "review_id long, fail_on array<string>, min_score int, warnings array<string>")
    risk = spark.createDataFrame([(1, 10, "low", ["x"])], "review_id long, score int, level string, factors array<string>")
    contents = spark.createDataFrame([], "review_id long, file string, content string")
    model = lambda prompts: [(json.dumps({"findings": [finding(2, "high", "run is never awaited")]}), 1) for _ in prompts]
    verifier = lambda prompts: [(json.dumps({"verdicts": [{"id": 0, "verdict": "confirmed", "confidence": 0.9, "reason": ""}]}), 3) for _ in prompts]
    out = plans.staged_review(reviews, files, lint, contexts, policies, risk, contents, model, verifier)
    assert {r["review_id"]: r["verdict"] for r in out["decision"].collect()} == {1: "request_changes", 2: "approve", 3: "request_changes", 4: "comment"}
    assert out["failed"].count() == 0
    broken = plans.staged_review(reviews, files, lint, contexts, policies, risk, contents, lambda prompts: [(None, 0) for _ in prompts], verifier)
    assert sorted(r["review_id"] for r in broken["failed"].collect()) == [1, 3, 4]
    assert [tuple(r) for r in broken["decision"].select("review_id", "verdict").collect()] == [(2, "approve")]
    assert [r["review_id"] for r in broken["report"].collect()] == [2]


def test_removed_files_touch_nothing_and_unindexed_repositories_ask_for_an_index(spark):
    files = [(1, "r", 0, "src/auth/x.ts", "removed", PATCH, 0, 9), (2, "new", 0, "src/a.ts", "modified", PATCH, 2, 0)]
    files = spark.createDataFrame(files + [(3, "r", i, f"src/f{i}.ts", "modified", PATCH, 1, 0) for i in range(40)], FILES)
    policies = spark.createDataFrame([(i, [], []) for i in (1, 2, 3)], "review_id long, ignore array<string>, path_instructions array<struct<path:string,instructions:string>>")
    code = spark.createDataFrame([(r, "src/user.ts", ["src/auth/x.ts", "src/a.ts", "src/f35.ts"]) for r in ("r", "new")], "repository_id string, path string, imports array<string>")
    body = "export function check(a) {\n  b = run();\n  c;\n}"
    contents = [(3, i, f"src/f{i}.ts", body.replace("check", f"check{i}")) for i in range(40)] + [(3, 99, "src/user.ts", "check1(2)")]
    contents = spark.createDataFrame(contents, "review_id long, ord int, path string, content string")
    repositories = spark.createDataFrame([("r", 5, "sha"), ("new", 6, None), ("other", 7, None)], "id string, installation_id long, indexed_sha string")
    out = plans.review_context(files, policies, code, contents, repositories=repositories)
    risk = {r["review_id"]: r for r in out["risk"].collect()}
    assert (risk[1]["score"], risk[1]["level"], risk[1]["factors"]) == (0, "low", ["small, isolated change"])
    assert risk[2]["score"] == 0 and risk[3]["score"] == 2
    assert [(r["review_id"], r["path"], r["via"]) for r in out["affected"].collect()] == [(3, "src/user.ts", "src/f35.ts")]
    assert [tuple(r) for r in out["index_requests"].collect()] == [("new", 6, None, "review")]
    assert out["head_files"].filter("review_id = 3").count() == 30 and out["symbols"].count() == 30
    assert [r["symbol"] for r in out["callers"].collect()] == ["check1"]
    everywhere = plans.review_context(files, policies, code, contents)
    assert {r["review_id"]: r["score"] for r in everywhere["risk"].collect()} == {1: 0, 2: 2, 3: 2}
