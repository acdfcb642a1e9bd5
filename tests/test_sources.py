"""Payload readers, registries, landing and sinks on small inline inputs."""

import pytest
from pyspark.sql import functions as F

from curator.operators import ledger
from curator.sinks import render, writers
from curator.sources import feeds, landing, registry, releases


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), "source_id string, body string")


def test_selected_feed_prefers_the_original(spark):
    body = """{"schemaVersion":1,"items":[{"id":7,"title":" A  b ","summary":"<p>x &amp; y</p>","source":"S","links":{"url":"https://agg/1","original":"https://o/p?utm_source=z"},
      "publishedAt":"2024-01-01T08:00:00+08:00","category":"news"},{"title":""},"text",{"title":"only","links":{"url":"https://agg/2"}}]}"""
    rows = {r["title"]: r for r in feeds.read_json_feed(raw(spark, ("s", body)), "selected").collect()}
    assert set(rows) == {"A b", "only"}
    first = rows["A b"]
    assert (first["url"], first["extra_urls"], first["link_relation"]) == ("https://o/p", ["https://agg/1"], "original_link")
    assert (first["summary"], first["categories"], first["owner"], first["metadata"]["upstream_id"]) == ("x & y", ["news"], "S", "7")
    assert first["published_at"].isoformat() == "2024-01-01T00:00:00"
    assert rows["only"]["link_relation"] == "discovery_link"


def test_model_feed(spark):
    body = '[{"modelId":"o/m","likes":3,"trendingScore":1.5,"tags":["t"],"pipeline_tag":"t","library_name":"lib","createdAt":"2024-01-01T00:00:00Z"},{"likes":1}]'
    row = feeds.read_json_feed(raw(spark, ("s", body)), "models").collect()
    assert len(row) == 1
    assert row[0]["summary"] == "Hugging Face model signal: trendingScore=1.5, likes=3"
    assert (row[0]["owner"], row[0]["categories"], row[0]["url"]) == ("o", ["t", "lib"], "https://huggingface.co/o/m")


def test_bad_payload_fails_its_own_source(spark):
    df = spark.createDataFrame([
        ("a", "selected", '{"items":[]}'), ("b", "selected", "[]"), ("c", "huggingface_models", "{}"), ("d", "rss", "<rss><channel/></rss>"),
        ("e", "atom", "<rss/>"), ("f", "rss", "<rss>"), ("g", "other", "x"), ("h", "atom", '<?xml version="1.0"?><!-- c --><feed xmlns="http://www.w3.org/2005/Atom"/>'),
    ], "source_id string, parser string, body string")
    good, failed = feeds.validate_payloads(df)
    assert sorted(r["source_id"] for r in good.collect()) == ["a", "d", "h"]
    assert sorted(r["source_id"] for r in failed.collect()) == ["b", "c", "e", "f", "g"]


def test_feed_entries_dates_and_links(spark):
    body = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>a</title><link rel="self" href="/no"/><link href="/p"/><updated>2024-01-02T00:00:00Z</updated></entry>
      <entry><title>b</title><link href="https://x/y"/><published>2024-01-03T00:00:00</published></entry><entry><title>c</title></entry></feed>"""
    df = spark.createDataFrame([("s", "https://h/feed", body, "reading")], "source_id string, final_url string, body string, kind string")
    rows = {r["title"]: r for r in feeds.read_feed_entries(df).collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"]["url"] == "https://h/p" and rows["a"]["published_at"] is None and rows["a"]["observed_at"] is not None
    assert rows["b"]["published_at"] is None and rows["b"]["observed_at"] is None  # no zone, no time


def test_release_atom_needs_its_own_repository(spark):
    entry = lambda url, title="T": f'<entry><id>tag:github.com,2008:Repository/1/v9</id><title>{title}</title><link rel="alternate" href="{url}"/><updated>2024-01-01T00:00:00Z</updated><content type="html">&lt;b&gt;hi&lt;/b&gt;</content></entry>'
    body = '<feed xmlns="http://www.w3.org/2005/Atom">' + entry("https://github.com/O/R/releases/tag/v1%2B2") + entry("https://github.com/x/y/releases/tag/v1") + entry(
        "http://github.com/O/R/releases/tag/v1") + entry("https://github.com/O/R/releases/tag/v3", "") + "</feed>"
    sources = spark.createDataFrame([("s", "o/r")], "source_id string, repository string")
    rows = releases.read_release_atom(raw(spark, ("s", body)), sources).collect()
    assert [(r["release_key"], r["release_notes_text"]) for r in rows] == [("o/r@v1+2", "hi")]


def test_withdrawn_advisory_is_still_reported_when_known(spark):
    body = """[{"ghsa_id":"G1","type":"reviewed","severity":"HIGH","html_url":"https://h","published_at":"2024","summary":"s","vulnerabilities":[{"package":{"ecosystem":"pip","name":"Alias"}}]},
      {"ghsa_id":"G2","type":"reviewed","severity":"low","html_url":"https://h","published_at":"2024","source_code_location":"https://github.com/O/R/"},
      {"ghsa_id":"G3","type":"reviewed","severity":"critical","withdrawn_at":"2024","html_url":"https://h","updated_at":"2024"},{"ghsa_id":"G4","severity":"high","type":"reviewed"}]"""
    sources = spark.createDataFrame([("first", 0, "x/y", ["nothing"]), ("second", 1, "o/r", ["alias"])], "source_id string, ord int, repository string, aliases array<string>")
    known = spark.createDataFrame([("G3", "x/y")], "advisory_id string, repository string")
    rows = {r["release_tag"]: r for r in releases.read_advisories(raw(spark, ("a", body)), sources, known).collect()}
    assert {k: (r["repository"], r["qualifies"]) for k, r in rows.items()} == {"G1": ("o/r", True), "G3": ("x/y", False)}
    assert all(len(r["content_hash"]) == 64 for r in rows.values())


def test_registry_rules(spark):
    good = dict(id="a-b", url="https://example.org/f", type="rss", weekdays=[0, 6], max_items=30, category="Skills", kind="reading")
    bad = dict(good, id="Bad", url="http://localhost/", weekdays=[7], kind="update")
    table, broken = registry.load_registry(spark, [good, good, bad], "discovery")
    codes = sorted((r["id"], r["path"]) for r in broken.collect())
    assert codes == [("Bad", "id"), ("Bad", "kind"), ("Bad", "url"), ("Bad", "weekdays"), ("a-b", "id")]
    due = registry.due_sources(table.withColumnRenamed("id", "source_id"), F.lit("2024-01-01").cast("timestamp"))
    assert due.count() == 2  # a Monday


def test_replay_is_complete_or_nothing(spark):
    sources = spark.createDataFrame([("a",), ("b",)], "source_id string")
    landed = spark.createDataFrame([("2024-01-01", "a", "c", "ok", "x"), ("2024-01-01", "b", "c", "ok", "y"), ("2024-01-02", "a", "c", "ok", "x")],
                                   "dt string, source_id string, config_hash string, status string, body string")
    action = lambda day, config: {r["action"] for r in landing.land_or_replay(sources, landed, day, config).collect()}
    assert (action("2024-01-01", "c"), action("2024-01-02", "c"), action("2024-01-01", "d")) == ({"reuse"}, {"fetch"}, {"fetch"})


def test_config_hash_follows_content_not_row_order(spark):
    rows = [(0, "a", "u"), (1, "b", "v")]
    make = lambda r: landing.config_hash(spark.createDataFrame(r, "ord int, id string, url string"), {"t": "0.48"}).collect()[0][0]
    assert make(rows) == make(rows[::-1]) != make([(0, "a", "u"), (1, "b", "w")])


def test_receipts(spark):
    rows = [("u", 1, 1, 200, "b1", 1), ("u", 2, 2, 304, None, None), ("u", 3, 3, None, None, None), ("v", 1, 4, 304, None, None), ("w", 1, 5, 304, None, None), ("w", 2, 6, 200, "b2", 2)]
    df = spark.createDataFrame(rows, "url string, checked_at int, fetch_id int, http_status int, sha256 string, fetched_at int")
    got = {r["url"]: (r["sha256"], r["fetched_at"], r["checked_at"], r["cache_status"]) for r in landing.latest_receipts(df).collect()}
    assert got == {"u": ("b1", 1, 2, "revalidated"), "w": ("b2", 2, 2, "fetched")}


def test_event_log_rejects_other_lines(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"event":"x","run_id":"1"}\n\n{"event":"y","discovery_metrics":{"deep_read_count":2}}\n')
    bad.write_text('{"event":"x"}\n[1]\n')
    assert [r["event"] for r in landing.read_event_log(spark, str(good)).collect()] == ["x", "y"]
    with pytest.raises(Exception, match="not a JSON object"):
        landing.read_event_log(spark, str(bad)).collect()


def test_manifest_window_prunes_partitions(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-02", "2024-02-01"):
        folder = tmp_path / f"dt={day}"
        folder.mkdir()
        (folder / "run-manifest.json").write_text('{"status":"partial",\n"successful_sources":["a","b"],"known_gaps":[{"source_id":"b"}]}')
    manifests = landing.read_manifests(spark, str(tmp_path), "2024-01-01", 14)
    plan = manifests._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
    days = landing.manifest_days(manifests)
    assert sorted((r["source_id"], str(r["day"]), r["gapped"]) for r in days.collect()) == [
        ("a", "2024-01-01", False), ("a", "2024-01-02", False), ("b", "2024-01-01", True), ("b", "2024-01-02", True)
    ]


def test_failed_run_replaces_stale_output(spark, tmp_path):
    path = str(tmp_path / "run")
    writers.write_run(spark.range(3), path, "2024-01-01")
    writers.write_run(spark.range(3), path, "2024-01-01", "failed")
    assert spark.read.schema("id long").json(f"{path}/rows").count() == 0
    assert spark.read.json(f"{path}/status").collect()[0]["exit_status"] == "failed"


def test_append_is_idempotent_and_detects_conflicts(spark, tmp_path):
    path = str(tmp_path / "log")
    batch = spark.createDataFrame([("r1", "h1"), ("r2", "h2")], "run_id string, content_hash string")
    batch.limit(0).write.parquet(path)
    assert ledger.append_state(batch, path, "run_id", "content_hash") == 2
    assert ledger.append_state(batch, path, "run_id", "content_hash") == 0
    with pytest.raises(ValueError, match="different content"):
        ledger.append_state(batch.withColumn("content_hash", F.lit("x")), path, "run_id", "content_hash")


def test_manifest_status_ladder(spark):
    sources = lambda *errors: spark.createDataFrame([(str(i), e) for i, e in enumerate(errors)], "source_id string, error string")
    status = lambda s, **k: writers.run_manifest(s, {"queued": spark.range(2)}, **k).collect()[0]["status"]
    assert status(sources(None, None)) == "success"
    assert status(sources(None, "x")) == "partial"
    assert status(sources("x")) == "failed"
    assert status(sources(None), gaps=spark.range(1)) == "partial"
    assert status(sources(None), review_error="bad") == "review_failed"


def test_rendered_lines_are_ordered(spark, tmp_path):
    items = spark.createDataFrame([
        ("w1", 1, "Skills", True, "B", "sb", "https://b", "project", None), ("w1", 2, "开源项目", False, "A", "sa", "https://a", "news", "https://e"),
    ], "issue_id string, place int, category string, featured boolean, title string, summary string, url string, kind string, event_url string")
    render.write_lines(render.issue_lines(items), str(tmp_path / "out"), ("issue_id",))
    lines = spark.read.text(str(tmp_path / "out")).where("value <> ''").collect()
    assert [r["value"] for r in lines] == ["## 开源项目", "### A", "sa", "[A 原文](https://a) · [事件原文](https://e)", "## Skills", "### ★ B", "sb", "[B 官方入口](https://b)"]


def test_snapshot_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"abc")
    files = writers.snapshot_files(spark, str(tmp_path))
    row = files.collect()[0]
    assert (row["bytes"], row["sha256"]) == (3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")


def test_ranking_report(spark):
    from curator.constants import SCORE_WEIGHTS

    parts = ",".join(f"{n}:int" for n in SCORE_WEIGHTS)
    df = spark.createDataFrame(
        [(1, "Title", 80, tuple(SCORE_WEIGHTS.values()), {"discovery_only": -20}, ["why"], "use it", "primary", None, [("https://a", "s", "c", "direct_source")])],
        f"rank int, canonical_title string, total int, components struct<{parts}>, penalties map<string,int>, penalty_reasons array<string>, recommendation string, "
        "evidence_status string, primary_source_url string, links array<struct<url:string,source_id:string,source_class:string,provenance:string>>",
    )
    lines = [r["line"] for r in render.ranking_lines(df, "2024-01-01", "Paper").orderBy("section", "place", "line_no").collect()]
    assert lines[0] == "# Paper 每日候选榜 — 2024-01-01" and "## 1. Title — 80/100" in lines
    assert "- 惩罚：discovery_only -20" in lines and "- 主证据链接：暂无" in lines and "  - [direct_source / s] https://a" in lines


def test_a_hub_source_with_two_payloads(spark):
    from curator.sources.feeds import read_hub_index

    raw = spark.createDataFrame([
        ("h", "https://x/models", "hf_models", '[{"id":"o/a"},{"id":"o/b"}]'), ("h", "https://x/spaces", "hf_spaces", '[{"id":"o/c"},{"id":"bad"}]'),
    ], "source_id string, final_url string, type string, body string")
    got = sorted((r.place, r.url, r.source_url) for r in read_hub_index(raw).collect())
    assert got == [(0, "https://huggingface.co/o/a", "https://x/models"), (0, "https://huggingface.co/spaces/o/c", "https://x/spaces"), (1, "https://huggingface.co/o/b", "https://x/models")]
