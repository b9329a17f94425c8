import gzip
import hashlib
import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from provenia.sources import fetch, stores
from provenia.streaming.queue import drain, last_entries, prepare, watch

PAGE = b"<html><article><p>" + b"Readable words stand here on the page. " * 20 + b"</p></article></html>"


def capture(**more):
    return {"query_id": "Q1", "product": "lynx", "model_id": "m", "answer_text": "An answer.", "citations": [{"marker": "1", "url": "https://a.example"}], "_note": ["x"]} | more


def test_captures(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(capture(), indent=1))
    (tmp_path / "a.split.json").write_text("{}")
    got = stores.read_captures(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0].source == "dom" and len(got[0].answer_sha256) == 64
    assert stores.citations(stores.read_captures(spark, str(tmp_path))).first().url == "https://a.example"
    (tmp_path / "b.json").write_text(json.dumps(capture(answer_sha256="0" * 64)))
    with pytest.raises(Exception, match="digest differs"):
        stores.read_captures(spark, str(tmp_path)).collect()


def test_gold_sets(spark, tmp_path):
    label = {"claim_id": "c", "url": "u", "label": "SUPPORTED", "blind": True}
    (tmp_path / "g.json").write_text(json.dumps({"split_sha256": "s", "labels": [label]}))
    got = stores.read_gold(spark, str(tmp_path)).first()
    assert got.split_sha256s == ["s"] and got["labels"][0].extraction_missed is None
    (tmp_path / "g.json").write_text(json.dumps({"split_sha256": "s", "labels": [label | {"label": "MAYBE"}]}))
    with pytest.raises(Exception, match="unknown label"):
        stores.read_gold(spark, str(tmp_path)).collect()


def test_strata_and_manifest(spark, tmp_path):
    (tmp_path / "s.toml").write_text('[stratum]\nid = "S"\nstatus = "ready"\n[[query]]\nid = "S-1"\ndomain = "d"\ntext = "a  b"\ncost_of_error = "c"\nprovenance = "p"\n')
    strata = stores.read_strata(spark, str(tmp_path))
    none = spark.createDataFrame([], "file string, query_id string, hash string")
    rows = stores.freeze(strata, none, "2026-01-01").collect()
    (tmp_path / "F.json").write_text(json.dumps({"frozen": {"s.toml": {"frozen_at": "x", "query_hashes": {r.query_id: r.hash for r in rows}}}}))
    manifest = stores.read_manifest(spark, str(tmp_path / "F.json"))
    assert manifest.collect() == [("s.toml", "S-1", rows[0].hash)]
    assert stores.freeze(strata, manifest, "2026-01-02").count() == 0
    with pytest.raises(ValueError):
        stores.freeze(strata, manifest, "2026-01-02", force=True)


def test_cache_appends_and_the_newest_wins(spark, tmp_path):
    path = str(tmp_path / "cache")
    row = lambda at, seq, body: spark.createDataFrame([("u", 200, {}, at, seq, "h", body)], stores.CACHE)
    for r in (row("t1", 0, b"a"), row("t2", 0, b"b"), row("t2", 1, b"c")):
        stores.append_cache(r, path)
    assert stores.read_cache(spark, path, "u").count() == 3 and stores.read_cache(spark, path, "v").count() == 0
    assert bytes(stores.latest_cached(stores.read_cache(spark, path)).first().body) == b"c"


def test_ledger_skips_damage(spark, tmp_path):
    p = tmp_path / "ledger.jsonl"
    p.write_text('{"capture": "a", "status": "failed", "attempts": 1}\nnot json\n{"capture": "a", "status": "ok", "attempts": 2}\n')
    assert [(r.capture, r.status) for r in stores.read_ledger(spark, str(p)).collect()] == [("a", "ok")]


def test_prior_artefacts(spark, tmp_path):
    h = "ab" * 32
    (tmp_path / "r.json").write_text(json.dumps({"answer_sha256": h, "claims": [{"verdict": "SUPPORTED"}]}))
    (tmp_path / "n.json").write_text(json.dumps({"answer_sha256": h, "verdict": ""}))
    (tmp_path / "o.json").write_text(json.dumps({"answer_sha256": "cd" * 32, "verdict": "SUPPORTED"}))
    (tmp_path / "p.html").write_text('<p>"verdict": "x"</p><script>{"a":"%s","judged":true}</script>' % h)
    (tmp_path / "d.json").write_text('{"answer_sha256": "%s", "verdict"' % h)
    answers = spark.createDataFrame([(h,)], "answer_sha256 string")
    got = {r.path.rsplit("/", 1)[1]: (r.key, r.outcome) for r in stores.prior_artefacts(spark, answers, [str(tmp_path)]).collect()}
    assert got == {"r.json": ("verdict", "prior"), "p.html": ("judged", "prior"), "d.json": ("", "not checked")}
    assert {r.path.rsplit("/", 1)[1]: r.key for r in stores.blind_inputs(spark, str(tmp_path)).collect()} == {"r.json": "verdict", "n.json": "verdict", "o.json": "verdict"}


def test_digests_of_stored_files(spark, tmp_path):
    claims = [{"text": 'Say "é" \\ \n\x01', "markers": ["[1]", "a, b"]}, {"text": "", "markers": []}]
    written = hashlib.sha256(json.dumps(claims, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    split = {"answer_sha256": "h", "claim_prompt_version": "c1", "claims": claims, "split_sha256": written}
    (tmp_path / "a.split.json").write_text(json.dumps(split))
    splits = stores.read_splits(spark, str(tmp_path))
    assert splits.first().split_sha256 == written
    captures = spark.createDataFrame([("h", "x"), ("g", "y")], "answer_sha256 string, answer_text string")
    claims_, left = stores.claims_of(captures, splits, "c1")
    assert [(r.pos, r.text) for r in claims_.orderBy("pos").collect()] == [(0, claims[0]["text"]), (1, "")] and [r.answer_sha256 for r in left.collect()] == ["g"]
    assert {r.answer_sha256: r.why for r in stores.bind_split(captures, splits, "c2").collect()} == {"h": "split by another claim prompt", "g": "no stored split"}
    with pytest.raises(Exception, match="another claim prompt"):
        stores.claims_of(captures, splits, "c2")[0].collect()
    (tmp_path / "a.split.json").write_text(json.dumps(split | {"claims": claims[:1]}))
    with pytest.raises(Exception, match="digest differs"):
        stores.read_splits(spark, str(tmp_path)).collect()
    full = {"claim_id": "c", "url": "u", "label": "SUPPORTED", "labelled_at": "t", "labeller": "", "blind": True, "notes": 'a "b"', "human_span": "é", "extraction_missed": None}
    labels = [full, full | {"claim_id": "b", "blind": False, "extraction_missed": True}]
    digest = hashlib.sha256(json.dumps(sorted(json.dumps(x, ensure_ascii=False, sort_keys=True) for x in labels), ensure_ascii=False).encode()).hexdigest()
    (tmp_path / "gold").mkdir()
    (tmp_path / "gold/g.json").write_text(json.dumps({"split_sha256s": ["s"], "labels": labels, "labels_sha256": digest}))
    assert stores.read_gold(spark, str(tmp_path / "gold")).first().labels_sha256 == digest


def test_report(spark):
    claims = spark.createDataFrame([("A", "c", "t</script>", "SUPPORTED")], "answer string, claim_id string, text string, state string")
    sources = spark.createDataFrame([("c", "u", "SOURCE_OK", "SUPPORTED", "s")], "claim_id string, url string, code string, verdict string, span string")
    payload = stores.report_payload(claims, sources).first().payload
    assert json.loads(payload)["counts"] == {"SUPPORTED": 1} and stores.to_html(payload).count("</script>") == 1


def test_run_sink_refuses_fields(spark, tmp_path):
    with pytest.raises(ValueError):
        stores.write_run(spark.sql("SELECT 1 AS confidence"), str(tmp_path))
    stores.write_run(spark.sql("SELECT 1 AS hits"), str(tmp_path), "said")
    assert spark.read.text(f"{tmp_path}/readout").first().value == "said"


def answer(url):
    pages = {
        "https://a.example/ok": (200, {"Content-Type": "text/html"}, PAGE),
        "https://a.example/gz": (200, {"Content-Type": "text/html", "Content-Encoding": "gzip"}, gzip.compress(PAGE)),
        "https://a.example/br": (200, {"Content-Type": "text/html", "Content-Encoding": "br"}, PAGE),
        "https://a.example/wall": (200, {"Content-Type": "text/html"}, b"<p>Subscribe to continue</p>"),
        "https://a.example/short": (200, {"Content-Type": "text/html"}, b"<p>few words</p>"),
        "https://a.example/chart": (200, {"Content-Type": "text/html"}, b"<p>few</p><svg></svg>"),
        "https://a.example/pdf": (200, {"Content-Type": "text/html"}, b"%PDF-1.4 nothing"),
        "https://a.example/png": (200, {"Content-Type": "image/png"}, b"x"),
        "https://a.example/bot": (404, {"Location": "/apology_objects/x"}, b""),
        "https://a.example/403": (403, {}, b""),
        "https://a.example/500": (500, {}, b""),
        "https://a.example/blocked": (200, {}, PAGE),
    }
    if url.endswith("/boom"):
        raise OSError
    return pages.get(url, (404, {}, b""))


def rules(url):
    return 200, {}, b"User-agent: *\nDisallow: /blocked"


def test_fetch_and_classify(spark):
    names = "ok gz br wall short chart pdf png bot 403 500 blocked gone boom".split()
    urls = spark.createDataFrame([(f"https://a.example/{n}",) for n in names], "url string")
    got = {r.url.rsplit("/", 1)[1]: r for r in fetch.classify(fetch.fetch_all(urls, answer, rules, pause=0, sleep=lambda s: None)).collect()}
    assert {n: r.source_code.removeprefix("SOURCE_") for n, r in got.items()} == {
        "ok": "OK", "gz": "OK", "br": "EMPTY", "wall": "PAYWALLED", "short": "EMPTY", "chart": "NO_TEXT_LAYER", "pdf": "NO_TEXT_LAYER", "png": "NOT_HTML",
        "bot": "BOT_BLOCKED", "403": "BOT_BLOCKED", "500": "UNREACHABLE", "blocked": "ROBOTS_EXCLUDED", "gone": "DEAD_LINK", "boom": "UNREACHABLE",
    }
    assert got["500"].attempts == 3 and got["403"].attempts == 1 and got["ok"].text.startswith("Readable")


def test_nearest_snapshot(spark):
    snaps = spark.createDataFrame([("u", "20240101000000", "far"), ("u", "20240610000000", "near")], "url string, stamp string, archived string")
    pages = spark.createDataFrame([("u", "2024-06-01T00:00:00")], "url string, generated_at string")
    assert fetch.nearest_snapshot(snaps, pages).first().archived == "near"
    url = spark.range(1).select(fetch.original_bytes_url(F.lit("https://x/web/20240101000000/https://y/web/1")).alias("u")).first().u
    assert url == "https://x/web/20240101000000id_/https://y/web/1"


def _audit(passes):
    """An audit that passes an answer at the attempt its text names, and keeps what it was given."""
    seen = []

    def audit(rows):
        seen.extend((r.answer_text, r.attempts) for r in rows.collect())
        return rows.select("answer_sha256", F.when(F.col("attempts") >= F.regexp_extract("answer_text", "[0-9]$", 0).cast("int"), "ok").otherwise("failed").alias("status"))

    audit.seen = seen
    return audit


def _drop(spark, folder, name, answers):
    spark.createDataFrame([(f"{name}{k}", a) for k, a in enumerate(answers)], "query_id string, answer_text string").coalesce(1).write.parquet(f"{folder}/drop={name}")


def test_attempts_last_over_runs_and_new_files(spark, tmp_path):
    audit = _audit(3)
    paths = prepare(spark, str(tmp_path))
    run = lambda **more: watch(spark, *paths, audit, **more).awaitTermination()
    entries = lambda: {r.capture: (r.status, r.attempts) for r in last_entries(spark, paths[1]).collect()}
    _drop(spark, paths[0], "a", ["x 1", "x 2", "x 9", "x 1"])
    run()
    assert entries() == {"a0": ("ok", 1), "a1": ("failed", 1), "a2": ("failed", 1)}
    run()
    assert entries() == {"a0": ("ok", 1), "a1": ("ok", 2), "a2": ("failed", 2)}
    _drop(spark, paths[0], "b", ["y 2", "x 2", "x 9"])  # a new answer and two that are known
    run()
    assert entries() == {"a0": ("ok", 1), "a1": ("ok", 2), "a2": ("failed", 3), "b0": ("failed", 1)}
    run()
    run()
    assert entries() == {"a0": ("ok", 1), "a1": ("ok", 2), "a2": ("failed", 3), "b0": ("ok", 2)}
    assert sorted(audit.seen) == [("x 1", 1), ("x 2", 1), ("x 2", 2), ("x 9", 1), ("x 9", 2), ("x 9", 3), ("y 2", 1), ("y 2", 2)]
    assert spark.read.schema("attempts int").parquet(paths[1]).count() == 8  # no entry lost


def test_a_killed_run_counts_nothing_twice(spark, tmp_path):
    """One run dies in the audit, one after its entries are written: the batch gives the same attempts again."""
    paths = prepare(spark, str(tmp_path))
    _drop(spark, paths[0], "a", ["x 2", "x 1"])
    audit = _audit(3)

    def broken(rows):
        raise RuntimeError("killed in the audit")

    with pytest.raises(StreamingQueryException):
        watch(spark, *paths, broken).awaitTermination()
    from provenia.streaming import queue

    def then_die(rows, ledger, number, audit, real=queue.record):
        real(rows, ledger, number, audit)
        raise RuntimeError("killed after the entries")

    with pytest.MonkeyPatch.context() as m:
        m.setattr(queue, "record", then_die)
        with pytest.raises(StreamingQueryException):
            watch(spark, *paths, audit).awaitTermination()
    for _ in range(3):
        watch(spark, *paths, audit).awaitTermination()
    assert sorted((r.capture, r.status, r.attempts) for r in last_entries(spark, paths[1]).collect()) == [("a0", "ok", 2), ("a1", "ok", 1)]
    assert spark.read.schema("attempts int").parquet(paths[1]).count() == 3


class _Timers:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


class _Handle:
    """A state and its timers, held in memory."""

    def __init__(self):
        self.held, self.timers = None, []

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def registerTimer(self, at):
        self.timers.append(at)


def test_back_off_and_lock():
    import pandas as pd

    from provenia.streaming.queue import Attempts

    process, handle = Attempts(3, 100, 1000), _Handle()
    process.init(handle)
    rows = lambda **r: iter([pd.DataFrame({"query_id": ["q"], "answer_text": ["t"], "status": [None], "attempts": [None]} | {k: [v] for k, v in r.items()})])
    due = lambda out: [int(f["attempts"][0]) for f in out]
    assert due(process.handleInputRows(("h",), rows(), _Timers(0))) == [1] and handle.timers == [1000]
    assert due(process.handleInputRows(("h",), rows(), _Timers(5))) == []  # a copy while the attempt is out
    assert due(process.handleInputRows(("h",), rows(status="failed", attempts=1), _Timers(10))) == [] and handle.timers[-1] == 110
    assert due(process.handleExpiredTimer(("h",), _Timers(110), None)) == [2]
    assert due(process.handleExpiredTimer(("h",), _Timers(1000), None)) == []  # the lock of attempt 1, not of 2
    assert due(process.handleExpiredTimer(("h",), _Timers(1110), None)) == [] and handle.held[0] == "failed"  # attempt 2 left nothing
    assert due(process.handleExpiredTimer(("h",), _Timers(1210), None)) == [3]
    assert due(process.handleInputRows(("h",), rows(status="failed", attempts=2), _Timers(1220))) == []  # an entry of a dead attempt
    assert due(process.handleInputRows(("h",), rows(status="failed", attempts=3), _Timers(1230))) == []
    assert handle.held[:2] == ("given up", 3) and handle.held[3] == ""


def test_a_meeting_reads_its_state_once_and_makes_no_frame(monkeypatch):
    import pandas as pd
    from pyspark.sql import Row

    from provenia.streaming.queue import RowAttempts

    class Counted(_Handle):
        reads = 0

        def get(self):
            self.reads += 1
            return self.held

    process, handle = RowAttempts(3, 0, 1000), Counted()
    process.init(handle)
    handle.exists = None  # not called, nor is a frame made
    monkeypatch.setattr(pd, "DataFrame", None)
    row = lambda **r: Row(**({"query_id": None, "answer_text": None, "status": None, "attempts": None} | r))
    copies = (row(query_id=q, answer_text="t") for q in (None, "q2", "q1", "q3"))  # read one by one
    assert list(process.handleInputRows(("h",), copies, _Timers(0))) == [Row(answer_sha256="h", query_id="q1", answer_text="t", attempts=1)]
    entries = [row(status="ok", attempts=2), row(status="failed", attempts=1)]
    assert [r.attempts for r in process.handleInputRows(("h",), iter(entries), _Timers(5))] == [2]  # the entry of an attempt that wasn't out says nothing
    assert handle.held[:2] == ("waiting", 2) and handle.reads == 2


def test_queue_drains_each_answer_once(spark):
    captures = spark.createDataFrame([(f"q{i}", f"answer {i % 7}") for i in range(20)], "query_id string, answer_text string")
    got = drain(captures).collect()
    assert len(got) == 7 and all(r.status == "ok" and r.attempts == 1 for r in got)
