"""What op2 writes and exchanges on larger tables."""

from lumaloom.llm import jaccard_join as J
from lumaloom.llm.common import Scratch

from .test_jaccard_join import check, corpus


def test_texts_out_of_reach_cross_no_exchange(spark):
    """No wanted id is lost, and nearly all others are left out."""
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(-3000, 3000)], "doc_id long, text string")
    wanted = spark.createDataFrame([(i,) for i in range(-3000, 3000, 7)], "doc_id long")
    got = {r["doc_id"] for r in J.within_reach(docs, wanted, Scratch(spark, "reach"), "words").collect()}
    ids = set(range(-3000, 3000, 7))
    assert ids <= got and len(got) < len(ids) + 60


def test_regions_that_are_small_are_not_exchanged(spark, monkeypatch):
    """Without large regions rows go on as they are; sets are dropped once they have been read, with the same result."""
    dropped, drop, plans = [], Scratch.drop, []
    cut = J.voronoi

    def watched(rows, scratch, percent=J.PERCENT):
        out = cut(rows, scratch, percent)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(Scratch, "drop", lambda self, *names: (dropped.extend(names), drop(self, *names))[1])
    monkeypatch.setattr(J, "voronoi", watched)
    check(spark, corpus(3))
    assert plans and "Join" not in plans[0] and "sets" in dropped
