import corpus_pipeline as cp
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    sizes = [len(before)]
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns, name
        got = {r.doc_id: r.text for r in docs.collect()}
        assert set(got) <= set(before) and docs.count() == len(got)
        if name == "quality rules":
            clean = [i for i, r in labels.items() if r.quality == 1 and len(before[i].split()) >= 10]
            assert len(set(clean) & set(got)) >= 0.97 * len(clean)
            assert all(got[i] == before[i] for i in got)
            unmarked = [i for i, t in before.items() if i not in labels and len(t.split()) >= 10]
            assert len(set(unmarked) & set(got)) >= 0.75 * len(unmarked)  # some of these are junk
        if name == "mixing":
            gone = [i not in got for i, r in labels.items() if r.toxic]
            assert sum(gone) / len(gone) > 0.8
        sizes.append(len(got))
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[4] < sizes[3]
    pieces = cp.STAGES[-1][1](spark, docs, DATA)
    assert pieces.groupBy("doc_id").agg((F.sum("length") == F.max("doc_tokens")).alias("whole")).filter("whole").count() == sizes[-1]


def test_near_dedup_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.near_dedup(spark, docs, DATA).collect()) == [1, 3, 4, 5]


def test_near_dedup_judges_rows_and_not_ids(spark):
    base = [f"word{i}" for i in range(60)]
    near = [*base[:59], "other"]
    rows = [
        (None, "one text that stands alone here"),
        (None, " ".join(base).upper()),  # near 4 and the next
        (None, " ".join(near)),
        (4, " ".join(base)),
        (None, " ".join(f"only{i}" for i in range(60))),  # near each other, and all without an id
        (None, " ".join([*(f"only{i}" for i in range(59)), "end"])),
        (None, None),
        (None, " \n"),
        (7, "first of two different texts of one id"),
        (7, "second of two and like nothing else at all"),
        (9, "second of two and like nothing else at all"),
        (8, "first of two different texts of one id"),
        (8, "a text of eight that nobody else has got"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id or 0, r.text or "") for r in cp.near_dedup(spark, docs, DATA).collect()))
    alone = [t for i, t in got if not i and t.startswith("only")]
    assert len(alone) == 1
    want = [(0, ""), (0, " \n"), (0, rows[0][1]), (0, alone[0]), (4, rows[3][1]), (7, rows[8][1]), (7, rows[9][1]), (8, rows[12][1])]
    assert got == sorted(want)
