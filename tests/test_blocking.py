import random

import pytest
from pyspark.sql import functions as F

from kinweave import values as V
from kinweave.functions import block as B
from kinweave.operators import blocking

SCHEMA = "entity_id string, name string, addr string, country string"
WIDE = blocking.Profile(base=800, most=600)


def frames(spark, queries, targets):
    return spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(targets, SCHEMA)


def lists(spark, queries, targets, profile):
    q, t = frames(spark, queries, targets)
    rows = blocking.candidate_lists(q, blocking.candidates(q, t, profile)).collect()
    return {r[0]: r[1].split(",") if r[1] else [] for r in rows}


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_tokens(spark):
    assert one(spark, B.norm, "Société Générale & Cie") == "societe generale cie"
    assert one(spark, B.norm, "  A & B   Co.  ") == "a b co"
    assert one(spark, B.name_tokens, "Reliance Retail Pvt Ltd") == ["reliance", "retail"]
    assert one(spark, B.name_tokens, "Best Best 123") == ["best", "best"]
    assert one(spark, lambda c: B.prefixes(B.name_tokens(c)), "Microsoft Technologies Corporation") == ["micro", "techn"]
    assert one(spark, B.addr_tokens, "15 Rue de la Paix, Cedex 02, Paris") == ["paix", "paris"]
    assert one(spark, B.numeric_tokens, "Plot No. 53/1, 2nd Floor, 560001 Bangalore") == ["53", "2nd", "560001"]
    assert one(spark, B.char_grams, "Walmart") == ["wal", "alm", "lma", "mar", "art"]
    assert one(spark, B.char_grams, "ab") == ["ab"] and one(spark, B.char_grams, None) == []


def test_below_budget_all_survive(spark):
    targets = [(f"S2-{i}", f"Supercorp Division {i}", "", "US") for i in range(250)] + [("S3-1", "Supercorp Labs", "", "US")]
    assert len(lists(spark, [("S1-1", "Supercorp Headquarters", "", "US")], targets, WIDE)["S1-1"]) == 251


def test_rare_name_survives_noise(spark):
    targets = [(f"S2-{i}", f"Random Firm {i}", f"Cyber Hub Building {i}", "India") for i in range(100)] + [("S3-999", "QuantumX Innovations", "", "India")]
    got = lists(spark, [("S1-1", "QuantumX", "Cyber Hub Building 1", "India")], targets, blocking.Profile(most=50))
    assert "S3-999" in got["S1-1"] and len(got["S1-1"]) <= 50


def test_gram_fallback(spark):
    got = lists(spark, [("S1-1", "BioFarmaceutics", "", "US")], [("S2-555", "BioPharmaceutics", "", "US")], blocking.Profile(trigger=40))
    assert got["S1-1"] == ["S2-555"]


def test_balanced_sources(spark):
    targets = [(f"S2-{i}", f"Global Logistics {i}", "Industrial Area", "US") for i in range(100)] + [(f"S3-{i}", f"Global Logistics {i}", "Industrial Area", "US") for i in range(1, 6)]
    got = lists(spark, [("S1-1", "Global Logistics", "Industrial Area", "US")], targets, blocking.Profile(base=20, most=20))["S1-1"]
    assert (sum(c.startswith("S2") for c in got), sum(c.startswith("S3") for c in got)) == (15, 5)
    assert got[:5] == ["S3-5", "S3-4", "S3-3", "S3-2", "S3-1"]


def test_open_countries_and_empty_lists(spark):
    targets = [("S2-1", "Boulangerie Pierre SARL", "", "France"), ("S3-1", "Pierre Boulangerie SAS", "", "France"), ("S2-2", "Boulangerie Pierre", "", "Peru")]
    got = lists(spark, [("S1-1", "Boulangerie Pierre", "", "France"), ("S1-2", "Nobody", "", "France"), ("S1-3", "Pierre", "", " "), ("S1-4", None, None, None)], targets, WIDE)
    assert got == {"S1-1": ["S3-1", "S2-1"], "S1-2": [], "S1-3": [], "S1-4": []}


def test_bag_semantics(spark):
    q, t = frames(spark, [("S1-1", "Best Best", "", "US")], [("S2-1", "Best", "", "US")])
    row = blocking.pair_scores(q, t).first()
    assert (row.sa, row.hits, row.score) == (32, 2, 52)


@pytest.mark.parametrize("parts", [1, 7])
def test_repartitioning_changes_nothing(spark, sf, parts):
    from kinweave.sources import tables

    q, t = tables.sources(spark, sf)
    got = {tuple(r) for r in blocking.candidates(q.repartition(parts), t.repartition(parts), blocking.SMALL).select("s1_id", "cand_id", "score").collect()}
    assert got == {tuple(r) for r in blocking.candidates(q, t, blocking.SMALL).select("s1_id", "cand_id", "score").collect()}


def test_pairs_are_made_where_their_query_is(spark, sf, tmp_path):
    """candidates shuffle no pair and write none; the result is that of the joined and shuffled pairs, fallback and budgets included."""
    from kinweave.sources import tables

    q, t = tables.sources(spark, sf)
    kept = []

    def keep(df):
        kept.append(df.columns)
        df.write.parquet(path := f"{tmp_path}/{len(kept)}")
        return spark.read.parquet(path)

    got = blocking.candidates(q, t, blocking.SMALL, keep)
    plan = got._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(s1_id" in line]
    assert sum("REPARTITION_BY_NUM" in line for line in exchanges) == 1 and not any("cand_id" in c for c in kept)
    above = plan[: plan.index("REPARTITION_BY_NUM")]
    assert "Window" in above and above.count("Exchange hashpartitioning(") == 1
    scored = blocking.pair_scores(q, t, blocking.SMALL)
    grams = blocking.fallback(q, t, scored, blocking.SMALL)
    both = scored.join(grams, ["s1_id", "cand_id"], "full_outer").fillna(0)
    want = blocking.budgeted(both.withColumn("score", F.col("score") + F.col("gram_score")), blocking.SMALL)
    columns = ["s1_id", "cand_id", "sa", "sb", "gram_score", "score", "budget"]
    rows = lambda df: sorted(tuple(r) for r in df.select(columns).collect())
    assert grams.count() and rows(got) == rows(want)


def test_index_too_large_to_broadcast(spark, sf, monkeypatch):
    from kinweave.sources import tables

    q, t = tables.sources(spark, sf)
    rows = lambda: sorted(tuple(r) for r in blocking.candidates(q, t, blocking.SMALL).select("s1_id", "cand_id", "score").collect())
    want = rows()
    monkeypatch.setattr(blocking, "BROADCAST_POSTINGS", 0)
    assert rows() == want


def test_a_budget_takes_two_orders(spark):
    """Every pair is put in order once, and what no budget can hold goes before the second order; the lists stay those of ranks over all pairs."""
    rng = random.Random(4)
    rows = [(f"S1-{q}", f"S{s}-{k}", rng.randint(0, 12)) for q in range(12) for s, n in ((2, rng.choice([0, 3, 40])), (3, rng.choice([1, 9, 30]))) for k in range(n)]
    cut = blocking.budgeted(spark.createDataFrame(rows, "s1_id string, cand_id string, score long").repartition(2, "s1_id"), blocking.SMALL)
    assert cut._jdf.queryExecution().executedPlan().toString().count("Sort [") == 2
    want = set()
    for q in {r[0] for r in rows}:
        own = sorted((-s, c) for k, c, s in rows if k == q)
        good = sum(-s >= V.QUALITY for s, _ in own)
        budget = blocking.SMALL.base if good <= blocking.SMALL.base else min(good, blocking.SMALL.most)
        first = [c for source in ("S2", "S3") for _, c in [x for x in own if x[1][:2] == source][: budget // 2]]
        rest = [c for _, c in own if c not in first]
        want |= {(q, c) for c in (first + rest)[: budget if len(own) > budget else None]}
    assert {(r.s1_id, r.cand_id) for r in cut.collect()} == want
