"""Figures of a run, their trace and readout; pages of a labelling session."""

import pytest
from pyspark.sql import functions as F

from provenia.operators import captures as C
from provenia.operators import figures as G
from provenia.sources.stores import write_run

PAIR = "claim_id int, url string, answer int, product string, origin string, source_code string, verdict string, voided boolean, void_reason string, drift string"


def _pairs(spark, *rows):
    full = [(k, f"https://www.s{k % 2}.org/{k}", a, product, origin, "SOURCE_OK", verdict, False, "", "NONE") for k, (a, product, origin, verdict) in enumerate(rows)]
    return spark.createDataFrame(full, PAIR)


@pytest.fixture()
def run(spark):
    return _pairs(
        spark,
        *[(1, "lynx", "dom", "SUPPORTED")] * 3, (1, "lynx", "dom", "NOT_FOUND_IN_SOURCE"),
        *[(2, "gemini", "dom", "SUPPORTED")] * 2,
        *[(3, "otter", "dom", "")] * 2,
        *[(4, "heron", "api", "SUPPORTED")] * 2,
    )


def _by(df):
    return {(r.section, r.key, r.figure): r for r in df.collect()}


def test_figures_are_published_or_say_why_not(run):
    got = _by(G.figures(run, "day"))
    assert (got["product", "lynx", "support"].hits, got["product", "lynx", "support"].n, got["product", "lynx", "support"].value) == (3, 4, 0.75)
    assert got["product", "gemini", "support"].withheld == "" and got["product", "heron", "support"].withheld == G.NOTHING
    assert got["product", "otter", "support"].withheld == got["stratum", "day", "support"].withheld == "INSUFFICIENT_EVIDENCE"
    assert got["stratum", "day", "support"].n == 4 and got["stratum", "day", "support"].value is None
    assert got["answer", "4", "drift"].withheld == "UNPUBLISHABLE_SOURCE" and got["agreement", "", "kappa"].withheld == "no gold set for this judge"
    assert all((r.value is None) == (r.withheld != "") or r.n == 0 for r in got.values())
    assert sum(k[0] == "answer" for k in got) == 4 * 5


def test_an_uncalibrated_judge_withholds_what_rests_on_it(run):
    got = _by(G.figures(run.where("answer < 3"), "day", "judge differs"))
    assert all(r.value is None for k, r in got.items() if k[2] in ("support", "claim_level"))
    assert got["stratum", "day", "support"].withheld.endswith("judge differs") and got["domain", "s0.org", "support"].withheld == "judge differs"
    assert got["answer", "1", "drift"].value == 0.0


def test_trace_counts_answers_and_pairs(run):
    got = _by(G.trace(G.figures(run.where("answer != 3"), "day"), G.records(run.where("answer != 3"), "day")))
    assert (got["stratum", "day", "support"].answers, got["stratum", "day", "support"].sources, got["stratum", "day", "support"].producer) == (1, 4, "pairs.support_rate")
    assert (got["answer", "2", "claim_level"].answers, got["answer", "2", "claim_level"].sources, got["answer", "2", "claim_level"].unit) == (1, 2, "claim")
    assert got["domain", "s0.org", "support"].answers == 2 and not any(k[:2] == ("product", "heron") for k in got)


def test_readout_lines(run):
    agreed = run.sparkSession.createDataFrame([(8, 6, 0.5, 0.1, 0.9)], "n long, agree long, kappa double, lo double, hi double")
    rows = G.lines(G.figures(run.where("answer < 3"), "day", agreement=agreed), {"day": "a test"}).collect()
    assert [r.section for r in rows] == sorted((r.section for r in rows), key=G.SECTIONS.index)
    line = {(r.section, r.key, r.figure): r.line for r in rows}
    assert line["stratum", "day", "support"].startswith("3 of 4 pairs (75.0%") and line["stratum", "day", "support"].endswith("reads as: a test")
    assert "reported here only" in line["product", "gemini", "support"] and line["agreement", "", "kappa"] == "kappa 0.500 (0.100 to 0.900), n=8"
    assert "an unnamed stratum" in G.lines(G.figures(run, "other")).where("section = 'stratum'").first().line


def test_no_pairs(spark, run):
    none = run.limit(0)
    assert [r.section for r in G.figures(none, "day").collect()] == ["agreement"] and G.trace(G.figures(none, "day"), G.records(none, "day")).count() == 0


def test_a_run_is_written_with_its_trace(run, tmp_path):
    found = G.figures(run, "day")
    write_run(found, f"{tmp_path}", G.lines(found), G.trace(found, G.records(run, "day")))
    spark = run.sparkSession
    assert spark.read.parquet(f"{tmp_path}/trace").count() == found.where("withheld = ''").count()
    assert spark.read.json(f"{tmp_path}/readout_lines").count() == spark.read.parquet(f"{tmp_path}/rates").count() == found.count()
    with pytest.raises(ValueError):
        write_run(found, f"{tmp_path}/b", trace=found.withColumn("confidence", F.lit(1.0)))


def test_pages_of_a_session(spark):
    sample = spark.createDataFrame([("a", "SOURCE_OK"), ("a", ""), ("b", ""), ("c", "SOURCE_DEAD_LINK"), ("d", None), ("e", "SOURCE_OK"), ("f", ""), ("g", "SOURCE_OK")], "url string, source_code string")
    cached = spark.createDataFrame([("a", "2024-01-01", "old"), ("a", "2024-02-01", "newer"), ("b", "2024-01-01", "some text"), ("c", "2024-01-01", "not found"), ("e", "2024-01-01", " \n"), ("g", "2024-01-01", None), ("z", "2024-01-01", "x")], "url string, fetched_at string, text string")
    fetched = spark.createDataFrame([("a", "2024-03-01", "fresh", "SOURCE_OK"), ("d", "2024-03-01", "said", "SOURCE_PAYWALLED")], "url string, fetched_at string, text string, source_code string")
    got = {r.url: r for r in C.prepare_pages(sample, cached, fetched).collect()}
    assert {u: (r.origin, r.check_available) for u, r in got.items()} == {"a": ("cache", True), "b": ("cache", True), "c": ("cache", False), "d": ("fetched", False), "e": ("cache", False), "f": ("missing", False), "g": ("cache", False)}
    assert (got["a"].cached_at, got["a"].chars, got["a"].code) == ("2024-02-01", 5, "SOURCE_OK") and got["d"].code == "SOURCE_PAYWALLED"
    assert "SOURCE_DEAD_LINK" in got["c"].detail and "decoded" in got["g"].detail and "extracted" in got["e"].detail and "nothing stored" in got["f"].detail
    alone = {r.url: r.origin for r in C.prepare_pages(sample, cached).collect()}
    assert alone["d"] == "missing" and len(alone) == 7 and C.prepare_pages(sample.limit(0), cached, fetched).count() == 0
