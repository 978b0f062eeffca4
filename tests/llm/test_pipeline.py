import brute
from pyspark.sql import functions as F


def test_stages(spark, tmp_path):
    import corpus_pipeline as P

    d, at = "/root/testdata/sf0.001", str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "123", "en", "s", 3), (None, "plain words without an id", "en", "s", 5)], docs.schema)
    docs, columns, kept = docs.union(extra), docs.columns, {}
    for k, (name, stage) in enumerate(P.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, d).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        kept[name] = docs
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.collect()}
        if name == "language":
            from kinweave.llm import langid

            model = langid.train(spark.read.parquet(f"{d}/documents.parquet").union(extra))
            scored = dict(zip(before, langid.predict(model, [(t or "").encode() for t in before.values()])))
            gone = set(before) - set(after)
            assert gone >= {10_001, 10_002} and gone == {i for i, (found, score) in scored.items() if found == "und" or score < 0.5}
        elif name == "near_duplicates":
            last = 1 << 60
            prints = sorted((last if i is None else i, brute.wide_simhash(t)) for i, t in before.items())
            roots = brute.components(prints, brute.wide_link)
            assert {last if i is None else i for i in after} == {i for i, r in roots.items() if i == r}
        elif name == "decontaminate":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
            assert set(after) == {i for i, r in brute.contamination(before, items).items() if not r[4]}
        elif name == "personal_data":
            assert set(after) == set(before)
            assert all(sum(brute.spans(t, brute.PII)[:4]) == 0 for t in after.values())
            assert all(after[i] == t for i, t in before.items() if sum(brute.spans(t, brute.PII)[:4]) == 0)
            assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
    assert {r.doc_id for r in docs.collect()} == set(before)


def test_run(spark):
    import corpus_pipeline as P

    assert P.run(spark, "/root/testdata/sf0.001").count() > 100


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kin_lang_ string, row string, did long"


def stage_rows(spark, name, rows, sf="/root/testdata/sf0.001"):
    import corpus_pipeline as P

    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "k", "r", 5) for i, t, lang in rows], COLUMNS)
    done = dict(P.STAGES)[name](spark, docs, sf)
    assert name == "pack" or done.columns == docs.columns
    return done.collect()


def test_language_rejects_what_the_network_does_not_know(spark):
    left, right = "abab abba babba " * 12, "zyzy yzzy zzyzy " * 12
    rows = [(k, left if k % 2 else right, "aa" if k % 2 else "zz") for k in range(40)] + [(100, left.split()[0] + " " + right.split()[0], None), (101, left * 2, None)]
    kept = {r.doc_id for r in stage_rows(spark, "language", rows)}
    assert set(range(40)) | {101} <= kept


def test_language_without_labels_keeps_all_with_letters(spark):
    rows = [(k, f"text {k}", None) for k in range(30)] + [(99, "123", None), (98, None, None)]
    assert {r.doc_id for r in stage_rows(spark, "language", rows)} == set(range(30))


def test_no_text_is_lost_where_ids_repeat(spark):
    alpha, one = " ".join(f"alpha{k}" for k in range(30)), " ".join(f"one{k}" for k in range(30))
    got = sorted((r.doc_id, r.text) for r in stage_rows(spark, "near_duplicates", [(1, alpha, "en"), (1, one, "en"), (2, one, "en"), (2, one, "en"), (1, alpha, "en")]))
    assert got == [(1, alpha), (1, one)]
    nulls = stage_rows(spark, "near_duplicates", [(None, alpha, "en"), (None, one, "en"), (None, one, "en"), (7, alpha, "en"), (8, None, "en"), (9, "", "en")])
    assert sorted((r.doc_id or 0, r.text or "") for r in nulls) == [(0, one), (7, alpha), (8, "")]


def test_empty_tables(spark):
    import corpus_pipeline as P

    for name, _ in P.STAGES:
        assert stage_rows(spark, name, []) == []
