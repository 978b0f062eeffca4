"""Every registered query with SQL equals DuckDB's result at the smallest scale."""

import duckdb
import pytest

from kinweave import queries as Q
from kinweave.operators import blocking

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_" or type(v).__name__ == "bool":
        return bool(v)
    return str(v) if isinstance(v, str) else float(v)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(map(plain, r)) for r in df[columns].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracle(spark, sf, duck, name):
    assert rows(Q.QUERIES[name](spark, sf).toPandas()) == rows(duck.sql(Q.ORACLES[name]).df())


@pytest.mark.parametrize("name", ["token_df_capped", "rare_tokens", "score_composite", "fallback_trigrams", "budget_topk", "candidate_lists"])
def test_caps_and_budgets_that_bite(spark, sf, duck, name):
    """The same SQL with caps and budgets small enough for the smallest tables."""
    tight = blocking.Profile(caps={"name": 6, "prefix": 6, "addr": 8, "num": 2, "gram": 8}, rare=1, medium=3, base=3, most=5, trigger=3, add=2)
    want, whole = rows(duck.sql(Q.filled(Q.TEMPLATES[name], tight)).df()), rows(duck.sql(Q.ORACLES[name]).df())
    assert rows(Q.QUERIES[name](spark, sf, tight).toPandas()) == want != whole


def test_retrieval_keeps_the_true_pairs(spark):
    """Recall under the method's own caps and budgets."""
    found = Q.QUERIES["recall_by_source"](spark, "/root/testdata/sf0.1").collect()
    assert len(found) == 2 and all(r.recall >= 0.9 for r in found)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def _joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Join" in line and "entity_id_" in line.split("Join", 1)[1]]


def test_pairs_are_not_shuffled_with_their_texts(spark, sf):
    """pair_features joins the normalised entities by broadcast even where Spark would not choose it."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joins = _joins(Q.QUERIES["pair_features"](spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(joins) == 2 and all("BroadcastHashJoin" in j for j in joins)


def test_features_of_held_out_queries_are_not_written(spark, sf, monkeypatch):
    """F2, F3: only the training pairs' features are written; those of all held-out candidates are made where they are scored, each pair once and with its label."""
    seen = []
    monkeypatch.setattr(Q.model, "train", lambda features: seen.append(features))
    monkeypatch.setattr(Q, "_FITTED", {})
    held = Q._trained(spark, sf)[1]
    assert "EvalPython" in held._jdf.queryExecution().executedPlan().toString()
    found = held.select("s1_id", "cand_id", "label").collect()
    of = {r.s1_id for r in found}
    assert of and not of & {r.s1_id for r in seen[0].select("s1_id").distinct().collect()}
    truth = {(r.s1_id, r.cand_id) for r in Q._truth(spark, sf).collect()}
    want = {(r.s1_id, r.cand_id, int((r.s1_id, r.cand_id) in truth)) for r in Q._candidates(spark, sf).collect() if r.s1_id in of}
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_names_of_the_truth_are_normalised_once(spark, sf):
    """the truth of the matcher, asked three times, is made of stored names, and no pair of it is written."""
    from kinweave import queries as Q

    kept = []
    own = Q._truth(spark, sf, lambda df: kept.append(df.columns) or df)
    assert kept == [["s1_id", "country", "key"], ["cand_id", "country", "key"]]
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, Q._truth(spark, sf).collect()))
