import random

import corpus_pipeline
from tests.llm.test_models import corpus
from tests.llm.test_near_dup import brute


def test_stages(spark, tmp_path):
    draw = random.Random(3)
    texts, toxic, good = corpus(220, 9)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    clean = [i for i in range(220) if not toxic[i] and good[i]]
    rows += [(300 + k, texts[i], "en", "copy", 1) for k, i in enumerate(clean[:5])]
    passage = " ".join(f"bench{k}" for k in range(20))
    rows += [(400, f"{texts[clean[6]]} {passage}", "en", "leak", 1), (401, f"write to someone@example.org about {' '.join(draw.choice(texts[clean[7]].split()) for _ in range(30))}", "en", "pii", 1)]
    rows += [(500, None, None, None, None), (501, "", "en", "e", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = f"file://{tmp_path}"
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate(zip(good, toxic, strict=True))], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "pii", "best_fit_packing"]
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.dtypes == docs.dtypes, name
        now.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        seen[name] = {r.doc_id: r.text for r in now.collect()}
    first = seen["toxicity"]
    gone = {i for i, *_ in rows} - set(first)
    assert len(gone ^ {i for i in range(220) if toxic[i]}) <= 8
    own, label = brute([(i, t) for i, t in first.items()])
    assert set(seen["minhash_near_dedup"]) == {i for i in first if label[i] == i}
    assert set(seen["benchmark_decontamination"]) == set(seen["minhash_near_dedup"]) - {400}
    assert set(seen["pii"]) == set(seen["benchmark_decontamination"])
    assert seen["pii"][401].startswith("write to <EMAIL> about") and {i for i in seen["pii"] if seen["pii"][i] != first[i]} == {401}
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == set(seen["pii"])


def test_clashing_columns(spark, tmp_path):
    """Columns named like those that operators make, in every table, and nulls in all."""
    folder = f"file://{tmp_path}"
    extra = "toxicity string, score int, place int, node string, bit int, member boolean, component long, kept int, item_id string, y int, found string, c0 int"
    docs = spark.createDataFrame(
        [(1, "a b c d e f g", *["x", 1, 2, "n", 3, True, 4, 5, "i", 6, "f", 7]), (1, "a b c d e f g", *[None] * 12), (None, None, *[None] * 12), (2, "", *[None] * 12)],
        f"doc_id long, text string, {extra}",
    )
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0, "t", 5), (2, 0, 1, None, None), (None, None, None, None, None)], "doc_id long, quality int, toxic int, text string, y int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "k " * 20, 3), (None, None, None)], "item_id long, text string, doc_id int").write.parquet(f"{folder}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.dtypes == docs.dtypes, name
        now.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
    assert sorted(str(r.doc_id) for r in now.collect()) == ["1", "2", "None"]
    assert corpus_pipeline.run(spark, folder).count() == 3


def test_empty_documents(spark, tmp_path):
    folder = f"file://{tmp_path}"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
