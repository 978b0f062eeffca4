import random

import pytest

from kinweave import values as V
from kinweave.functions import similarity as S


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_kernels_against_definitions():
    import duckdb

    rng = random.Random(3)
    pairs = [("".join(rng.choice("abcde ") for _ in range(rng.randint(0, 14))), "".join(rng.choice("abcde ") for _ in range(rng.randint(0, 14)))) for _ in range(400)]
    for a, b in pairs:
        assert S.subsequence(a, b) == lcs(a, b)
        if a and b:
            assert abs(S.jaro_winkler(a, b) - duckdb.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]) < 1e-9
    pairs += [("x" * 70 + a, b + "y" * 70) for a, b in pairs[:20]] + [("a" * 64, "ba" * 32), ("é𝒳a", "a𝒳é")]
    left, right = [a for a, _ in pairs], [b for _, b in pairs]
    assert S.subsequences(left, right).tolist() == [lcs(a, b) for a, b in pairs]
    assert S.jaro_winklers(left, right).tolist() == pytest.approx([S.jaro_winkler(a, b) for a, b in pairs], abs=1e-12)


def test_all_features(spark):
    schema = "entity_id string, name string, addr string, country string"
    q = S.normalised(spark.createDataFrame([("S1-1", "Acme Tools Inc", "12 Main St 98101", "US"), ("S1-2", "Zzz", "Qqq", "US")], schema))
    t = S.normalised(spark.createDataFrame([("S2-1", "ACME TOOLS", "12 Main Street 98101", "us"), ("S3-1", "Vvv", None, "fr")], schema))
    pairs = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S3-1"), ("S1-1", "S3-404")], "s1_id string, cand_id string")
    rows = {(r.s1_id, r.cand_id): r.asDict() for r in S.pair_features(pairs, q, t).collect()}
    same, far, missing = rows["S1-1", "S2-1"], rows["S1-2", "S3-1"], rows["S1-1", "S3-404"]
    assert list(same)[2:] == V.FEATURES
    assert same["name_exact"] == same["name_jaro_winkler"] == same["addr_token_sort"] == same["addr_number_overlap"] == same["country_match"] == 1.0
    assert same["source_type"] == 0.0 and far["source_type"] == 1.0
    assert far["addr_postal_match"] == 0.5 and far["addr_any_empty"] == 1.0 and far["name_length_ratio"] == 0.0
    assert missing["addr_any_empty"] == 1.0 and missing["name_exact"] == 0.0


def test_evaluation(spark):
    from kinweave.operators import evaluate as E

    ids = spark.createDataFrame([(x,) for x in "abcd"], "s1_id string")
    pair = "s1_id string, cand_id string"
    truth, found = spark.createDataFrame([("b", "1"), ("c", "1"), ("c", "2")], pair), spark.createDataFrame([("c", "1"), ("c", "3"), ("d", "9")], pair)
    got = {r.s1_id: r.f05 for r in E.f05_by_entity(ids, found, truth).collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": 0.5, "d": 0.0}
    assert E.macro(E.f05_by_entity(ids, found, truth)).first()["macro_f05"] == pytest.approx(0.375)


def test_validation(spark):
    from kinweave.operators import validate

    lists = spark.createDataFrame([("S1-1", "S2-1,S2-1,S1-9,X-2"), ("S1-1", ""), ("S1-8", "S3-3")], "s1 string, ids string")
    required = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    candidates = spark.createDataFrame([("S1-1", "S2-1,S1-9,X-2")], "s1 string, ids string")
    got = {r.rule: (r.severity, r.n) for r in validate.report(lists, required, candidates).collect()}
    assert got == {"duplicate row": ("error", 1), "duplicate id": ("error", 1), "self match": ("error", 1), "wrong prefix": ("error", 1), "missing row": ("error", 1), "extra row": ("error", 1), "not a candidate": ("warning", 1)}


def test_one_pass_of_masks_and_one_meeting_of_sets(spark):
    """Jaro-Winkler and the common subsequence come from one pass, and a pair's sets meet once each, before the kernels."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abé日 \0"[: rng.randint(1, 6)]) for _ in range(rng.choice([0, 1, 3, 20, 63, 64, 65])))
    left = [word() for _ in range(600)]
    right = [word() if rng.random() < 0.5 else x[: rng.randint(0, len(x))] + word()[:2] for x in left]
    got = S.both(left, right)
    assert got[:, 1].tolist() == [S.subsequence(*p) for p in zip(left, right, strict=True)]
    assert got[:, 0].tolist() == pytest.approx([S.jaro_winkler(*p) for p in zip(left, right, strict=True)], abs=1e-12)
    own = S.normalised(spark.createDataFrame([("S1-1", "One Two", "1 Low St", "US"), ("S2-1", "Two Two", "1 High St", "US")], "entity_id string, name string, addr string, country string"))
    limit = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = S.pair_features(spark.createDataFrame([("S1-1", "S2-1")], "s1_id string, cand_id string"), own, own)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.debug.maxToStringFields", limit)
    assert plan.count("array_intersect(") == 4 and "array_union(" not in plan


def test_five_decimals_as_round_has_them(spark):
    """the query's rounding without decimals of any size gives what ``round`` gives, ties included."""
    import numpy as np
    from pyspark.sql import functions as F

    from kinweave import queries as Q

    ties = (np.arange(100_000) + 0.5) / 1e5
    values = np.concatenate([np.random.default_rng(2).random(20_000), ties, np.nextafter(ties.astype(np.float32), np.float32(1)), np.arange(65) / 64, [1e-30, 1e-6]]).astype(np.float32)
    df = spark.createDataFrame([(float(x),) for x in values], "x double").select(F.col("x").cast("float").alias("x"))
    assert df.where(Q._five("x") != F.round(F.col("x").cast("double"), 5)).count() == 0


def test_long_addresses_go_by_blocks(monkeypatch):
    """strings of 65 to 128 characters take words of bits in blocks of pairs, not pair by pair, whatever their characters are."""
    rng = random.Random(6)
    sets = ["ab", "abcdefgh 0123456789", "é日𝒳a\0", "".join(map(chr, range(0x4E00, 0x4E00 + 500)))]
    word = lambda s: "".join(rng.choice(s) for _ in range(rng.choice([0, 1, 63, 64, 65, 90, 127, 128])))
    pairs = [(word(s), word(s)) for s in sets for _ in range(150)]
    pairs += [(a, "".join(c if rng.random() < 0.9 else "b" for c in a)[rng.randint(0, 2) :]) for a, _ in pairs]
    left, right = [a for a, _ in pairs], [b for _, b in pairs]
    jaro, common = [S.jaro_winkler(*p) for p in pairs], [S.subsequence(*p) for p in pairs]
    for name in ("jaro_winkler", "subsequence"):
        monkeypatch.setattr(S, name, None)
    got = S.both(left, right)
    assert got[:, 1].tolist() == S.subsequences(left, right).tolist() == common
    assert got[:, 0].tolist() == S.jaro_winklers(left, right).tolist() == pytest.approx(jaro, abs=1e-12)


def test_two_names_are_compared_once(monkeypatch):
    """what follows from two names is worked out once for all pairs of records that have them."""
    import pandas as pd

    rng, seen = random.Random(9), []
    word = lambda: "".join(rng.choice("abc é") for _ in range(rng.randint(0, 6)))
    names = [(word(), word()) for _ in range(12)]
    some = [rng.choice(names) for _ in range(400)]
    n1, n2 = [a for a, _ in some], [b for _, b in some]
    x1, x2 = [word() for _ in some], [word() for _ in some]
    plain = lambda v: [t.replace("é", "") for t in v]
    columns = [n1, n2, x1, x2, plain(n1), plain(n2), [t[::-1] for t in n1], [t[1:] for t in n2], [t[:2] for t in n1], [t[2:] for t in n2], [t[::-1] for t in x1], x2]
    block = S._pairwise
    monkeypatch.setattr(S, "_pairwise", lambda a, b, *more: seen.append(len(a)) or block(a, b, *more))
    got = S.kernels.func(*map(pd.Series, columns))
    assert sum(seen) <= 2 * 400 + 4 * 12
    for k, row in enumerate(got.itertuples(index=False)):
        own = [c[k] for c in columns]
        name, addr = S.jaro_winkler(own[0], own[1]), S.jaro_winkler(own[2], own[3])
        rest = [S.jaro_winkler(own[4], own[5]), *[S.subsequence(own[i], own[i + 1]) for i in (0, 6, 8, 10)]]
        assert list(row) == pytest.approx([name, addr, *(rest if max(name, addr) >= V.SHORT_CIRCUIT else [0] * 5)], abs=1e-12)


def test_a_pair_meets_one_part_of_the_true_candidates(spark):
    """labels compare a pair with a part of its query's true candidates, not with all of them, and are those of a set of pairs."""
    from kinweave.operators import evaluate as E

    rng = random.Random(4)
    pair = lambda: (f"S1-{rng.randint(0, 6)}", rng.choice([None, *(f"S2-{k}" for k in range(300))]))
    true, asked = [pair() for _ in range(900)], [pair() for _ in range(1500)]
    df = E.labelled(spark.createDataFrame(asked, "s1_id string, cand_id string"), spark.createDataFrame(true, "s1_id string, cand_id string"))
    got = df.collect()
    assert sorted((r.s1_id, r.cand_id or "", r.label) for r in got) == sorted((a, b or "", int(b is not None and (a, b) in set(true))) for a, b in asked)
    assert "array_position(_parts" in df._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
