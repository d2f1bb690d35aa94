"""Feedback that changes a ranking, and domain checks."""
import pytest
from pyspark.sql import functions as F

from crestline.operators import catalog as C
from crestline.operators import feedback as B
from crestline.operators import moments as M


@pytest.fixture(scope="module")
def candidates(spark):
    rows = [(1, "a", "loop", 0.9), (2, "b", "Loop", 0.8), (3, "c", "stem", 0.7), (4, None, "chop", 0.6), (5, "b", "other", 0.5)]
    return spark.createDataFrame(rows, "id long, source string, kind string, total double")


def ranking(df):
    return [r.id for r in M.rank_capped(df, "kind", [F.col("adjusted").desc(), F.col("id")], 2, 5).collect()]


def scores(candidates, votes):
    df = candidates.sparkSession.createDataFrame(votes, "source string, kind string, verdict string")
    return B.feedback_scores(candidates, "total", "source", "kind", B.source_penalties(df, "source", "verdict"), B.source_priors(df, "source", "kind", "verdict"))


def test_without_feedback_nothing_changes(candidates):
    got = scores(candidates, [])
    assert [r.adjusted for r in got.orderBy("id").collect()] == [0.9, 0.8, 0.7, 0.6, 0.5] and ranking(got) == [1, 2, 3, 4, 5]


def test_rejects_lower_and_keeps_raise_a_source(candidates):
    votes = [("a", "loop", "reject")] * 2 + [("b", "loop", "keep")] + [(None, "chop", "reject")]
    got = scores(candidates, votes)
    found = {r.id: r.adjusted for r in got.collect()}
    prior = lambda base, kept, rejected: round(base * (1 + 0.15 * kept) * (1 - 0.25 * rejected), 4) / base
    want = {1: 0.9 * prior(0.34, 0, 2) / 1.2, 2: 0.8 * prior(0.34, 1, 0), 3: 0.7, 4: 0.6 * prior(0.33, 0, 1), 5: 0.5}
    assert found == pytest.approx(want, abs=1e-6)
    assert ranking(got) == [2, 3, 5, 4, 1]


def test_clashing_columns_stay(candidates):
    wide = candidates.withColumns({"penalty": F.lit("mine"), "loop": F.lit(1)})
    got = scores(wide, [("a", "loop", "reject")])
    assert got.columns == [*wide.columns, "adjusted"] and {r.penalty for r in got.collect()} == {"mine"}


def test_empty_verdicts_are_ratings(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",), (" keep ",), ("no",)], "v string")
    got = [(r.v, r.bad) for r in df.select(B.verdict_of(F.col("v")).alias("v"), B.rejects(F.lit("r"), F.lit("c"), F.col("v"))["bad_verdict"].alias("bad")).collect()]
    assert got == [("rated", False), ("rated", False), ("rated", False), ("keep", False), ("no", True)]


def test_domains(spark):
    df = spark.createDataFrame([(1, "allowed", "kept"), (2, "free", "kept"), (3, None, "kept"), (4, "blocked", "lost")], "id long, rights string, job string")
    domains = {"rights": C.RIGHTS_STATES, "job": C.JOB_STATES}
    report = {(r.column, r.value): (r.valid, r.n) for r in C.domain_report(df, domains).collect()}
    assert report == {("rights", "allowed"): (True, 1), ("rights", "free"): (False, 1), ("rights", None): (False, 1), ("rights", "blocked"): (True, 1),
                      ("job", "kept"): (True, 3), ("job", "lost"): (False, 1)}
    assert [r.id for r in C.in_domains(df, domains).collect()] == [1]
    assert C.in_domains(df.where("id = 1"), domains, strict=True).collect() == df.where("id = 1").collect()
    for bad, said in ((2, "free"), (3, "null"), (4, "lost")):
        with pytest.raises(Exception, match=f"outside its domain: {said}"):
            C.in_domains(df.where(F.col("id") == bad), domains, strict=True).collect()
    assert C.domain_report(df.limit(0), domains).collect() == []
