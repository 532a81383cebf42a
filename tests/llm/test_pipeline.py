import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import queries

from .test_duplicates import grams


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, docs_rows):
    path = str(tmp_path_factory.mktemp("tables"))
    rows, labels = docs_rows
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def docs_rows(prose):
    rows, labels = [], []
    for k in range(150):
        good = k % 3 > 0
        t = prose(60, k) + "\n" + prose(30, 400 + k) if good else prose(60, k).upper().replace(" ", "!! ")
        rows.append((k, t, "en", f"s{k % 4}", len(t)))
        labels.append((k, int(good), 0))
    rows += [(200, rows[1][1], "en", "s0", rows[1][4]), (201, rows[2][1] + " and one more", "en", "s1", 5), (202, None, None, None, None), (203, "", "en", "s2", 0)]
    return rows, labels


def test_stages(spark, folder, docs_rows):
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"score": F.lit("x"), "size": F.lit(1)})
    columns = docs.columns
    seen = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if k < 4:
            assert docs.columns == columns
            docs.write.parquet(f"{folder}/out-{k}")
            docs = spark.read.parquet(f"{folder}/out-{k}")
            seen.append({r.doc_id: r.text for r in docs.collect()})
    good = {k for k in range(150) if k % 3}
    assert good <= set(seen[0]) and not {k for k in range(150) if k % 3 == 0} & set(seen[0])
    # the copy lost its lines; every line of a clean document stays
    assert 200 not in seen[1] and all(seen[1][k] == docs_rows[0][k][1] for k in good)
    kept = [grams(t, 5) for t in seen[2].values() if t]
    assert all(100 * len(a & b) < 80 * len(a | b) for i, a in enumerate(kept) for b in kept[:i]) and set(seen[2]) <= set(seen[1])
    assert docs.count() > 0 and docs.where("not round_trip").count() == 0


def test_run_repeats_itself(spark, folder):
    once, again = (sorted((r.doc_id, r.n_ids) for r in pipeline.run(spark, folder).collect()) for _ in range(2))
    assert once == again and once


def test_queries_are_complete():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())
