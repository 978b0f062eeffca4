import pytest

from kinweave.operators import blocking
from kinweave.sources import sinks, tables


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_raw_reader(spark, tmp_path):
    path = write(tmp_path / "a.tsv", 'entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-007\tSmith, "Jones\t123 Main\tUS\nS1-2\tnull\tNaN\tNone\nS1-3\tN/A\n')
    rows = {r.entity_id: tuple(r)[1:] for r in tables.load_raw(spark, path).collect()}
    assert rows == {"S1-007": ('Smith, "Jones', "123 Main", "US"), "S1-2": ("", "", ""), "S1-3": ("", "", "")}


def test_ground_truth_and_lists(spark, tmp_path):
    path = write(tmp_path / "gt.tsv", "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-2, S3-3,S2-2,\nS1-2\t\n\t\n")
    rows = {r.s1_id: r.matched for r in tables.load_ground_truth(spark, path).collect()}
    assert rows == {"S1-1": ["S2-2", "S3-3"], "S1-2": []}
    assert [tuple(r) for r in tables.load_lists(spark, path).orderBy("position").collect()] == [("S1-1", 0, "S2-2"), ("S1-1", 1, "S3-3"), ("S1-1", 2, "S2-2")]


def test_paths(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="test_source2.tsv"):
        tables.dataset_paths(spark, str(tmp_path), "generate")
    (tmp_path / "test").mkdir()
    for k in (1, 2, 3):
        write(tmp_path / "test" / f"test_source{k}.tsv", "entity_id\n")
    assert tables.dataset_paths(spark, str(tmp_path), "generate")["source3"].endswith("test/test_source3.tsv")


def test_lists_round_trip(spark, tmp_path):
    lists = spark.createDataFrame([("S1-1", "S3-1,S2-2"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string")
    sinks.write_lists(lists, str(tmp_path / "out"))
    assert {(r.s1_id, r.cand_id) for r in tables.load_lists(spark, str(tmp_path / "out")).collect()} == {("S1-1", "S3-1"), ("S1-1", "S2-2")}


def test_resume_and_stream(spark, sf, tmp_path):
    from kinweave.streaming import files

    q, t = tables.sources(spark, sf)
    want = {tuple(r) for r in blocking.candidate_lists(q, blocking.candidates(q, t, blocking.SMALL)).collect()}
    out = str(tmp_path / "resumed")
    files.resume(q.limit(20), t, out, blocking.SMALL)
    for _ in range(2):
        files.resume(q, t, out, blocking.SMALL)
    got = [tuple(r) for r in spark.read.parquet(f"{out}/{sinks.config_key(vars(blocking.SMALL))}").collect()]
    assert len(got) == len(want) and set(got) == want
    q.repartition(2).write.parquet(str(tmp_path / "in"))
    files.link_stream(files.query_stream(spark, str(tmp_path / "in")), t, str(tmp_path / "streamed"), str(tmp_path / "state"), blocking.SMALL).awaitTermination()
    assert {tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "streamed")).select("source1_entity_id", "candidate_entity_ids").collect()} == want


def test_linkage_plan(spark, tmp_path, monkeypatch):
    from kinweave import queries as Q
    from kinweave.operators import model
    from kinweave.plans import linkage

    sf = "/root/testdata/sf0.01"
    q, t = tables.sources(spark, sf)
    truth = Q._truth(spark, sf)
    monkeypatch.setattr(model.train, "__defaults__", (model.PRODUCTION | {"maxIter": 12, "maxDepth": 4}, *model.train.__defaults__[1:]))
    fitted, percent, sweep = linkage.train(q, t, truth, str(tmp_path / "train"), blocking.SMALL)
    model.save_model(fitted, str(tmp_path / "model"), {"threshold": percent / 100}, spark)
    fitted, config = model.load_model(str(tmp_path / "model"), spark)
    done = linkage.link(q, t, fitted, config["threshold"], str(tmp_path / "link"), blocking.SMALL, truth)
    assert done.lists.count() == q.count()
    # All candidates of the held-out queries choose the threshold, not the thinned ones; 0.995 is one of the thresholds.
    held = spark.read.parquet(str(tmp_path / "train/held"))
    pairs = spark.read.parquet(str(tmp_path / "train/candidates"))
    assert held.count() == pairs.join(held.select("s1_id").distinct(), "s1_id", "left_semi").count() > 0
    assert 99.5 in {r.percent for r in sweep.collect()}
    orders = [r.matched_entity_ids.split(",") for r in done.lists.collect() if "," in r.matched_entity_ids]
    place = lambda c: -int(c[3:]) if c.startswith("S3") else int(c[3:])
    assert orders and all(o == sorted(o, key=place) for o in orders)
    assert done.evaluation.first()["macro_f05"] > 0.8
    assert done.problems.count() == 0


def test_file_plans(spark, tmp_path):
    from kinweave.plans import files

    raw = "entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tAcme Inc.\t1 Main St\tUS\nS1-2\tB\t\tUS\n"
    queries = write(tmp_path / "test_source1.tsv", raw)
    targets = write(tmp_path / "test_source2.tsv", raw.replace("S1-", "S2-"))
    files.clean_files(spark, f"{tmp_path}/*_source*.tsv", str(tmp_path / "clean"))
    assert [r.name_core for r in tables.load_clean(spark, str(tmp_path / "clean/test_source1_clean"), ["entity_id", "name_core"]).orderBy("entity_id").collect()] == ["acme", "b"]
    good = write(tmp_path / "good.tsv", "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\t\n")
    assert files.validate_files(spark, good, queries, targets=[targets]) == ([], [])
    bad = write(tmp_path / "bad.tsv", "source1_entity_id,matched_entity_ids\nS1-1\tS2-7\nS1-2\n")
    errors, _ = files.validate_files(spark, bad, queries, targets=[targets])
    assert errors == ["comma-separated header", "1 rows without a tab", "unknown id: 1 (S1-1 S2-7)"]
    assert files.validate_files(spark, str(tmp_path / "none.tsv"), queries)[0][0].startswith("missing file")
    assert files.main([good, "--queries", queries]) == 0 and files.main([bad, "--queries", queries]) == 1
