"""Only texts that a candidate may ask for are shuffled, and each full set once."""

from foliowright.llm import minhash_dedup as M


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_pass_the_filter_before_any_other_join(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i // 2) * 1000 + k}" for k in range(40))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plans = {}
    real = M.materialize

    def seen(df, name):
        plans[name] = _plan(df)
        return real(df, name)

    monkeypatch.setattr(M, "materialize", seen)
    got = {r["doc_id"]: r["component_id"] for r in M.minhash_groups(docs).collect()}
    assert got == {i: i // 2 * 2 for i in range(40)}
    assert "LeftSemi" not in plans["full-sets"]
    assert "Join" not in plans["linked"]
