import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenia import codes
from provenia.operators import agreement, captures, gates, judge, ordering
from provenia.operators import pairs as P

PAIR = "answer string, product string, origin string, claim_id string, url string, source_code string, verdict string, voided boolean, void_reason string, drift string"


def pair(answer="a", product="lynx", origin="dom", claim="c", url="u", code="SOURCE_OK", verdict="SUPPORTED", voided=False, reason="", drift="NONE"):
    return (answer, product, origin, claim, url, code, verdict, voided, reason, drift)


@pytest.fixture
def frame(spark):
    return lambda *rows: spark.createDataFrame(list(rows), PAIR)


def test_void_and_unread_pairs_leave_both_sides(frame):
    rows = frame(pair(), pair(claim="d", verdict="CONTRADICTED"), pair(claim="e", voided=True, reason=codes.FABRICATED), pair(claim="f", code="SOURCE_EMPTY", verdict=""))
    r = P.support_rate(rows, "answer").first()
    assert (r.hits, r.n) == (1, 2)
    assert (lambda r: (r.hits, r.n))(P.unauditable_rate(rows, "answer").first()) == (2, 4)
    assert (lambda r: (r.hits, r.n))(P.fabricated_rate(rows, "answer").first()) == (1, 3)


def test_rate_over_nothing_is_null(frame):
    r = P.support_rate(frame(pair(code="SOURCE_EMPTY", verdict="")), "answer").first()
    assert (r.hits, r.n, r.value, r.lo, r.hi) == (0, 0, None, None, None)


def test_half_unmeasured_is_insufficient(frame):
    assert P.insufficient(frame(pair(), pair(claim="d", verdict="")), "answer").first().insufficient
    assert not P.insufficient(frame(pair(), pair(claim="d"), pair(claim="e", verdict="")), "answer").first().insufficient


def test_withheld_rates_are_rows_with_reasons(frame):
    rows = frame(pair(), pair(answer="b", origin="api"), pair(answer="c", verdict=""))
    got = {(r.answer, r.rate): r for r in P.published_rates(rows, calibrated=False, reason="no gold set").collect()}
    assert len(got) == 15
    assert got["a", "support"].withheld == "NO_CALIBRATION: no gold set" and got["a", "support"].value is None and got["a", "support"].n == 1
    assert got["a", "drift"].withheld == "" and got["b", "drift"].withheld == codes.UNPUBLISHABLE
    assert got["c", "support"].withheld == codes.INSUFFICIENT


def test_one_answer_withholds_the_aggregate(frame):
    rows = frame(pair(), pair(answer="b", verdict="")).withColumn("s", F.lit(1))
    r = P.aggregate_rates(rows, "s").first()
    assert (r.splits, r.withheld, r.value) == (2, codes.INSUFFICIENT, None)
    assert P.aggregate_rates(frame(pair(product="gemini")).withColumn("s", F.lit(1)), "s").first().withheld == codes.CONFLICTED
    assert P.aggregate_rates(frame(pair(product="gemini")).withColumn("s", F.lit(1)), "s", allow_conflicted=True).first().value == 1.0


def test_drift_keeps_the_unknown_apart(frame):
    r = P.drift_rate(frame(*[pair(claim=str(i), drift=d) for i, d in enumerate(codes.DRIFT)]), "answer").first()
    assert (r.hits, r.n, r.replaced, r.unknown) == (1, 3, 1, 2)


def test_verdict_keys_stay_a_closed_set(frame):
    rows = frame(pair(code=""), pair(code="SOURCE_EMPTY"), pair(verdict=""), pair(voided=True, reason="sorry, I can't"), pair())
    assert {r.key for r in P.verdict_counts(rows).collect()} == {"NOT_FETCHED", "SOURCE_EMPTY", "NOT_JUDGED", "VOID:JUDGE_REFUSED", "SUPPORTED"}


def test_last_of_repeated_judgements_counts(spark):
    claims = spark.createDataFrame([("c", ["u", "v"])], "claim_id string, urls array<string>")
    fetches = spark.createDataFrame([("u", 1, "SOURCE_EMPTY"), ("u", 2, "SOURCE_OK")], "url string, seq int, source_code string")
    judged = spark.createDataFrame([("c", "u", 1, "SUPPORTED", False, ""), ("c", "u", 2, "CONTRADICTED", False, "")], "claim_id string, url string, seq int, verdict string, voided boolean, void_reason string")
    got = {r.url: (r.source_code, r.verdict, r.voided) for r in P.build_pairs(claims, fetches, judged).collect()}
    assert got == {"u": ("SOURCE_OK", "CONTRADICTED", False), "v": ("", "", False)}


@pytest.mark.parametrize(("cited", "verdicts", "want"), [
    (False, [], "NOT_CHECKED"), (True, [], "COULD_NOT_VERIFY"), (True, [("SUPPORTED", True)], "COULD_NOT_VERIFY"), (True, [("SUPPORTED", False)], "SUPPORTED"),
    (True, [("SUPPORTED", False), ("PARTIALLY_SUPPORTED", False)], "PARTIALLY_SUPPORTED"), (True, [("SUPPORTED", False), ("CONTRADICTED", False)], "MIXED"), (True, [("NOT_FOUND_IN_SOURCE", False), ("SUPPORTED", True)], "NOT_SUPPORTED"),
])
def test_claim_states(spark, cited, verdicts, want):
    claims = spark.createDataFrame([("c", cited)], "claim_id string, cited boolean")
    judged = spark.createDataFrame([("c", *v) for v in verdicts], "claim_id string, verdict string, voided boolean")
    assert P.claim_states(claims, judged).first().state == want


def test_agreement(spark):
    labels = [(str(i), "u", "SUPPORTED" if i < 10 else "NOT_FOUND_IN_SOURCE", True, None) for i in range(17)] + [("x", "u", "UNAUDITABLE", True, None), ("y", "u", "SUPPORTED", False, None), ("z", "u", "SUPPORTED", True, None)]
    judged = [(str(i), "u", "SUPPORTED" if i < 8 else "NOT_FOUND_IN_SOURCE", False) for i in range(17)] + [("z", "u", "SUPPORTED", True)]
    rows = agreement.compare(spark.createDataFrame(labels, "claim_id string, url string, label string, blind boolean, extraction_missed boolean"), spark.createDataFrame(judged, "claim_id string, url string, verdict string, voided boolean"))
    r = agreement.agreement(rows).first()
    assert (r.n, r.agree, round(r.kappa, 6), r.unauditable, r.unmatched) == (17, 15, 0.767123, 1, 1)
    assert agreement.attribution(rows).first().asDict() == {"disagreements": 2, "checked": 0, "attributable": 0}
    m = {x["class"]: x for x in agreement.class_metrics(rows).collect()}
    assert (m["SUPPORTED"].tp, m["SUPPORTED"].fp, m["SUPPORTED"].fn, m["SUPPORTED"].precision, m["SUPPORTED"].recall) == (8, 0, 2, 1.0, 0.8)
    assert agreement.agreement(rows.limit(0)).first().kappa is None


def test_calibration(spark):
    runs = spark.createDataFrame([("r1", "rule", "m", "j", "c", 1), ("r2", "other", "m", "j", "c", 9)], "run string, judge string, model string, judge_prompt string, claim_prompt string, split long")
    gold = spark.sql("SELECT 'rule' judge, 'm' model, 'j' judge_prompt, 'c' claim_prompt, array(1L) splits, 40 blind, 30 blind_comparable")
    got = {r.run: (r.passed, r.detail) for r in gates.calibration(runs, gold).collect()}
    assert got == {"r1": (True, ""), "r2": (False, "judge differs; split not labelled")}
    assert all("no gold set" in r.detail for r in gates.calibration(runs, gold.limit(0)).collect())


def test_field_gate_reads_schemas_only(spark):
    schema = T.StructType.fromDDL("a struct<Trust_Score: int, b: array<struct<confidence_x: int>>>, m map<string, struct<scores: int>>, ok string")
    assert gates.banned_keys(schema) == ["$.a.Trust_Score", "$.a.b[].confidence_x", "$.m{}.scores"]
    with pytest.raises(ValueError):
        gates.publishable(spark.createDataFrame([], schema))


def test_claim_ids_number_repeats(spark):
    rows = spark.createDataFrame([("q", "same", 0), ("q", "same", 1), ("q", "x", 2), ("p", "same", 0)], "query_id string, canonical string, pos int")
    ids = sorted(r.claim_id for r in ordering.claim_ids(rows).collect())
    assert len(set(ids)) == 4 and sum(i.endswith(".2") for i in ids) == 1


def test_sample_is_seeded_and_round_robin(spark):
    pool = spark.createDataFrame([(i, "big" if i < 90 else "small") for i in range(93)], "id int, b string")
    first = [r.id for r in ordering.stratified_sample(pool, ["b"], "id", 8, 1).collect()]
    assert first == [r.id for r in ordering.stratified_sample(pool.repartition(7), ["b"], "id", 8, 1).collect()]
    assert sum(i >= 90 for i in first) == 3
    assert [r.id for r in ordering.stratified_sample(pool, ["b"], "id", 8, 2).collect()] != first


def test_resumed_sample_is_filled_up(spark):
    pool = spark.createDataFrame([(i, "big" if i < 90 else "small") for i in range(93)], "id int, b string")
    first = [r.id for r in ordering.stratified_sample(pool, ["b"], "id", 10, 1).collect()]
    done = spark.createDataFrame([(i,) for i in first[:4]], "id int")
    rest = [r.id for r in ordering.resume_sample(pool, done, ["b"], "id", 10, 1).collect()]
    assert len(rest) == 6 and not set(rest) & set(first[:4]) and set(first[4:]) <= set(rest)
    assert ordering.resume_sample(pool, pool.limit(12), ["b"], "id", 10, 1).count() == 0


def test_auditable_contract(spark):
    rows = spark.createDataFrame([("a", "SOURCE_OK", True), ("a", "SOURCE_EMPTY", False)], "k string, source_code string, auditable boolean")
    assert [tuple(r) for r in captures.auditable_denominator(rows, "k").collect()] == [("a", 1, 2)]
    with pytest.raises(Exception, match="counted as auditable: SOURCE_EMPTY"):
        captures.auditable_denominator(rows.withColumn("auditable", F.lit(True)), "k").collect()


def test_frozen_is_by_file(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "file string, query_id string")
    assert gates.frozen(rows(("a", "1"), ("a", "2")), rows(("b", "1"), ("a", "2"))).collect() == [("a", "2")]


def test_query_rules(spark):
    full = list(gates.REQUIRED)
    good = ("f", 1, "ready", "synthetic", "CO", ["d"], full, "CO-1", "d", "x" * 30, "y" * 70, "synthetic", None, None)
    change = lambda **c: tuple(c.get(n, v) for n, v in zip(names, good))
    names = "file place status provenance_policy id_prefix domains keys id domain text cost_of_error provenance scrub_notes asked_approx".split()
    cases = {
        "": {}, "duplicate id": {"place": 2}, "id without its prefix": {"id": "X-1"}, "domain not declared": {"id": "CO-2", "domain": "e"}, "text too short": {"id": "CO-3", "text": "x  " * 8},
        "cost of error too short": {"id": "CO-4", "cost_of_error": "y"}, "provenance unknown": {"id": "CO-5", "provenance": "z"}, "unknown key": {"id": "CO-6", "keys": [*full, "other"]},
        "forbidden key|unknown key": {"id": "CO-7", "keys": [*full, "Expected_answer"]}, "required key missing": {"id": "CO-8", "keys": full[1:], "text": ""},
        "no approximate wording|no scrub notes|provenance against policy": {"id": "CO-9", "provenance": "real_scrubbed"}, "synthetic with scrub notes": {"id": "CO-10", "scrub_notes": "n"}, "status unknown": {"id": "CO-11", "status": "?"},
        "policy unknown|provenance against policy": {"id": "CO-12", "provenance_policy": "?"},
    }
    rows = spark.createDataFrame([change(**c) for c in cases.values()], "file string, place int, status string, provenance_policy string, id_prefix string, domains array<string>, keys array<string>, id string, domain string, text string, cost_of_error string, provenance string, scrub_notes string, asked_approx string")
    got = {}
    for r in gates.query_violations(rows).collect():
        got.setdefault(r.id, []).append(r.rule)
    want = {}
    for rules, c in cases.items():
        want.setdefault(c.get("id", "CO-1"), []).extend(filter(None, rules.split("|")))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}


def test_late_labels_and_kappa_without_the_extractors_faults(spark):
    labels = spark.createDataFrame([("a", "u", "SUPPORTED", True, True, "2026-01-02"), ("b", "u", "SUPPORTED", True, None, "2026-01-01"), ("c", "u", "NOT_FOUND_IN_SOURCE", True, False, "2026-01-01")], "claim_id string, url string, label string, blind boolean, extraction_missed boolean, labelled_at string")
    judged = spark.createDataFrame([("a", "u", "NOT_FOUND_IN_SOURCE", False), ("b", "u", "SUPPORTED", False), ("c", "u", "NOT_FOUND_IN_SOURCE", False)], "claim_id string, url string, verdict string, voided boolean")
    rows = agreement.compare(labels, judged)
    assert agreement.agreement(rows).first().n == 3
    r = agreement.agreement(agreement.without_attributable(rows)).first()
    assert (r.n, r.agree, r.kappa) == (2, 2, 1.0)
    assert agreement.in_time(labels, "2026-01-03").count() == 3
    with pytest.raises(Exception, match="written after the judge's run: a"):
        agreement.in_time(labels, "2026-01-01").collect()


def test_domain_maps_and_report(frame, spark):
    rows = frame(pair(url="https://a.b.co.uk/1"), pair(url="https://b.co.uk/2", voided=True, reason=codes.FABRICATED), pair(url="https://b.co.uk/3", code="SOURCE_EMPTY", verdict=""), pair(url="mailto:x", verdict=""))
    got = {r.domain: (r.verdicts, r.reasons) for r in P.domain_maps(rows).collect()}
    assert got == {"b.co.uk": ({"SUPPORTED": 1}, {codes.FABRICATED: 1, "SOURCE_EMPTY": 1}), "(no domain)": ({}, {"not judged": 1})}
    rows = frame(pair(claim="c"), pair(claim="c", url="v", verdict="PARTIALLY_SUPPORTED"), pair(claim="d", verdict="")).withColumn("qualifiers", F.array().cast("array<string>"))
    claims = spark.createDataFrame([("a", "c", True), ("a", "d", False), ("a", "e", True)], "answer string, claim_id string, located boolean")
    assert tuple(P.report_counts(rows, claims, "answer").first()) == ("a", 3, 1, 3, 2, 1, 1, 1)


def test_pending_queue(spark):
    captures = spark.createDataFrame([("a", "h1", 1), ("b", "h1", 0), ("c", "h2", 2), ("d", "h3", 3), ("e", "h4", 4)], "capture string, answer_sha256 string, mtime int")
    ledger = spark.createDataFrame([("c", "h2", 1, "failed", 3), ("d", "h3", 1, "ok", 1), ("x", "h4", 1, "ok", 1)], "capture string, answer_sha256 string, seq int, status string, attempts int")
    assert [r.capture for r in ordering.pending(captures, ledger).collect()] == ["b"]


class Scripted:
    def complete(self, document, claim):
        if claim == "refuse":
            raise judge.Refused("no")
        assert document
        return {"verdict": "SUPPORTED", "span": claim}


def test_judge_sees_only_pages_that_were_read(spark):
    rows = spark.createDataFrame([("c1", "u", "x", "x y", "SOURCE_OK"), ("c2", "u", "refuse", "x y", "SOURCE_OK"), ("c3", "v", "x", "", "SOURCE_EMPTY")], "claim_id string, url string, claim string, text string, source_code string")
    got = {r.claim_id: (r.verdict, r.refusal) for r in judge.judge_pairs(rows, Scripted()).collect()}
    assert got == {"c1": ("SUPPORTED", ""), "c2": (codes.REFUSED, "no")}
    assert [r.v for r in rows.select(judge.rule_verdict(F.col("text"), F.col("claim")).alias("v")).collect()][2] == "NOT_FOUND_IN_SOURCE"


def test_freeze_refuses_until_the_sets_are_the_frozen_ones(spark):
    frozen = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y"), ("b", "3", "z")], "file string, query_id string, hash string")
    disk = lambda *rows: spark.createDataFrame(list(rows), "file string, status string, query_id string, hash string")
    same = [("a", "ready", "1", "x"), ("a", "ready", "2", "y"), ("b", "ready", "3", "z"), ("c", "draft", "4", "w")]
    gates.require_freeze(frozen, disk(*same))
    with pytest.raises(ValueError, match="b file missing"):
        gates.require_freeze(frozen, disk(*same[:2]))
    with pytest.raises(ValueError, match="c ready but never frozen"):
        gates.require_freeze(frozen, disk(*same[:3], ("c", "ready", "4", "w")))
    with pytest.raises(ValueError, match="a 2 modified"):
        gates.require_freeze(frozen, disk(same[0], ("a", "ready", "2", "q"), *same[2:]))
    with pytest.raises(ValueError, match="nothing is frozen"):
        gates.require_freeze(frozen.limit(0), disk(*same[3:]))
    found = gates.freeze_problems(frozen, disk(same[0], ("a", "ready", "5", "n"), same[2]))
    assert {tuple(r) for r in found.collect()} == {("a", "2", "removed"), ("a", "5", "added")}


def test_domain_report_names_the_gate_before_the_floor(spark):
    rows = [("https://a.org/1", "SOURCE_OK", "SUPPORTED", False, ""), ("https://www.a.org/2", "SOURCE_OK", "CONTRADICTED", False, ""), ("https://b.org/", "SOURCE_OK", "SUPPORTED", False, ""), ("", "SOURCE_EMPTY", "", False, "")]
    df = spark.createDataFrame(rows, "url string, source_code string, verdict string, voided boolean, void_reason string")
    passed = P.domain_report(df, calibration="").collect()
    assert [(r["domain"], r["pairs"], r["standing"], r["value"], r["refused"]) for r in passed] == [("a.org", 2, 2, 0.5, ""), ("(no domain)", 1, 0, None, "fewer than 2 standing pairs"), ("b.org", 1, 1, None, "fewer than 2 standing pairs")]
    assert (passed[0]["verdicts"], passed[1]["reasons"]) == ({"SUPPORTED": 1, "CONTRADICTED": 1}, {"SOURCE_EMPTY": 1})
    assert {(r["value"], r["refused"]) for r in P.domain_report(df, calibration="too little agreement").collect()} == {(None, "too little agreement")}
    assert {r["refused"] for r in P.domain_report(df).collect()} == {"no calibration supplied"}
    assert P.domain_report(df.limit(0)).count() == 0


class Counting:
    def __init__(self, failure=None):
        self.failure = failure

    def probe(self):
        if self.failure:
            raise judge.Unavailable("no answer", self.failure)

    def complete(self, document, claim):
        if claim == "refuse":
            raise judge.Refused("won't")
        return {"verdict": "SUPPORTED", "span": document, "tokens": 10}


def test_a_judge_stops_at_its_budget_and_names_what_it_left_out(spark):
    rows = [(f"c{i:02}", "u", "refuse" if i == 1 else "x", None if i == 2 else "t", "SOURCE_OK" if i else "SOURCE_EMPTY") for i in range(9)]
    df = spark.createDataFrame(rows, "claim_id string, url string, claim string, text string, source_code string")
    out = {r["claim_id"]: r for r in judge.judge_metered(df, Counting(), 25, 1).collect()}
    assert sorted(out) == [f"c{i:02}" for i in range(1, 9)]  # the unread page never reaches the judge
    assert [out[f"c{i:02}"]["halted"] for i in range(1, 9)] == [False] * 4 + [True] * 4
    assert (out["c01"]["verdict"], out["c01"]["refusal"], out["c02"]["span"]) == (codes.REFUSED, "won't", "")
    assert (out["c08"]["verdict"], out["c08"]["tokens"], out["c08"]["refusal"]) == ("", 0, "budget of 25 tokens reached")
    spent = judge.spending(judge.judge_metered(df, Counting(), 25, 1), 25).first()
    assert tuple(spent) == (4, 30, 4, 25, True)
    again = df.join(judge.judge_metered(df, Counting(), 25, 1).where("halted").select("claim_id"), "claim_id", "left_semi")
    assert judge.judge_metered(again, Counting()).where("halted").isEmpty()
    assert tuple(judge.spending(judge.judge_metered(df.limit(0), Counting(), 5), 5).first()) == (0, 0, 0, 5, False)
    assert judge.judge_metered(df, Counting(), 0).where("NOT halted").isEmpty()


def test_shares_hold_over_many_parts(spark):
    df = spark.range(2000).selectExpr("cast(id AS string) AS claim_id", "'u' AS url", "'x' AS claim", "'t' AS text", "'SOURCE_OK' AS source_code")
    tokens = judge.spending(judge.judge_metered(df, Counting(), 4000, 8), 4000).first()["tokens"]
    assert 4000 <= tokens <= 4000 + 8 * 10


def test_a_probe_refuses_before_any_claim_is_sent(spark, frame):
    df = spark.createDataFrame([("c", "u", "x", "t", "SOURCE_OK")], "claim_id string, url string, claim string, text string, source_code string")
    with pytest.raises(judge.Unavailable) as e:
        judge.judge_metered(df, Counting("rejected"), 10)
    assert e.value.kind == "rejected"
    with pytest.raises(ValueError):
        judge.Unavailable("x", "mood")


def test_only_readable_pairs_can_be_judged(spark):
    claims = spark.createDataFrame([("c1", ["u1", "u2"]), ("c2", ["u1", "u3"]), ("c3", [])], "claim_id string, urls array<string>")
    fetches = spark.createDataFrame([("u1", "SOURCE_OK"), ("u2", "SOURCE_PAYWALLED")], "url string, source_code string")
    assert sorted((r.claim_id, r.url) for r in P.judgeable(claims, fetches).collect()) == [("c1", "u1"), ("c2", "u1")]


def test_lookup_of_a_short_table_has_a_default(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "stratum string")
    told = captures.with_lookup(df, "stratum", {"a": "drawn by hand"}, "caveat", "no caveat is known: not comparable")
    assert {r["stratum"]: r["caveat"] for r in told.collect()} == {"a": "drawn by hand", "b": "no caveat is known: not comparable", None: "no caveat is known: not comparable"}


def test_marked_files_skip_blanks_and_comments(spark, tmp_path):
    (tmp_path / "marked.txt").write_text("# by hand\n\n  One et al., 2001 \n#two\nthree\n")
    assert sorted(r["a"] for r in captures.marked_lines(spark, str(tmp_path / "marked.txt")).collect()) == ["One et al., 2001", "three"]


def test_unfreezing_needs_a_reason_and_leaves_a_trace(spark):
    manifest = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y"), ("b", "3", "z")], "file string, query_id string, hash string")
    with pytest.raises(ValueError, match="reason"):
        captures.unfreeze(manifest, "a", "2026-01-01", "")
    kept, gone = captures.unfreeze(manifest, "a", "2026-01-01", "wrong cost")
    assert [r["query_id"] for r in kept.collect()] == ["3"]
    assert {(r["query_id"], r["reason"]) for r in gone.collect()} == {("1", "wrong cost"), ("2", "wrong cost")}
