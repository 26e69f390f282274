import numpy as np

import corpus_pipeline
from tests.llm.test_decontam import shingles
from tests.llm.test_langid import WORDS


def made(tmp_path, spark):
    rng = np.random.default_rng(12)
    # invented words that end like real ones, so that near copies stand out among unrelated texts
    pools = {c: [*w.split(), *(f"{rng.choice(w.split())}{i}{rng.choice(w.split())}" for i in range(150))] for c, w in WORDS.items()}
    text = lambda c, n=60: " ".join(rng.choice(WORDS[c].split()) if rng.random() < 0.4 else rng.choice(pools[c]) for _ in range(n))
    rows = []
    add = lambda t, c: rows.append((len(rows), t, c, "s", None if t is None else len(t)))
    for i in range(160):
        add(text(sorted(WORDS)[i % 4]), sorted(WORDS)[i % 4])
    items = [text("en", 30) for _ in range(5)]
    clean = set(range(160))
    for t in items:
        add(f"{text('en', 40)} {t} {text('en', 40)}", "en")  # leaks
    add("###*** " * 50, "en")  # symbols
    add("too short", "en")
    add(None, "en")
    add("12 34 " * 40, "de")
    add(rows[3][1], rows[3][2])  # an exact copy
    add(rows[4][1].replace(rows[4][1].split()[30], "zzz", 1), rows[4][2])  # a near copy
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return rows, items, clean


def test_stages_and_run(spark, tmp_path):
    rows, items, clean = made(tmp_path, spark)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert seen[0] == clean | set(range(160, 165)) | {169, 170}  # symbols, short, null and digits go
    assert seen[1] == seen[0]
    assert seen[2] == seen[1] - {169, 170}
    leaked = {i for i, t, *_ in rows if t and any(len(shingles(x) & shingles(t)) >= 0.8 * len(shingles(x)) for x in items)}
    assert seen[3] == seen[2] - leaked == clean
    assert seen[4] == clean
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in got.collect()} == clean


def test_empty_table(spark, tmp_path):
    made(tmp_path, spark)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), stage(spark, docs, str(tmp_path)).schema)
    assert docs.count() == 0


def test_without_ids_and_repeated(spark, tmp_path):
    rows, _, _ = made(tmp_path, spark)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).where("doc_id < 3")
    none = docs.selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars")
    got = corpus_pipeline.near_duplicates(spark, docs.union(docs).union(none), str(tmp_path)).collect()
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got) == [-1, -1, -1, 0, 1, 2]


def test_near_duplicates_by_text_not_by_id(spark, tmp_path):
    rows, _, _ = made(tmp_path, spark)
    a, b, c, d = (rows[i][1] for i in range(4))
    table = [(1, a), (1, b), (1, a), (2, b), (3, c), (None, d), (None, d), (None, c), (4, None), (4, None), (5, None)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, a), (1, b), (3, c), (None, d), (None, c), (4, None), (5, None)]))


def test_long_documents_stay(spark, tmp_path):
    rng = np.random.default_rng(5)
    text = " ".join(rng.choice(["the", "of", *(f"word{i}" for i in range(3000))], 100_500))
    docs = spark.createDataFrame([(1, text), (2, "too short")], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, str(tmp_path)).collect()] == []  # stop words are too few
    text = " ".join(x if i % 4 else "the" for i, x in enumerate(text.split()))
    docs = spark.createDataFrame([(1, text), (2, "too short")], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, str(tmp_path)).collect()] == [1]


def test_clashing_columns_and_a_very_long_text(spark, tmp_path):
    rows, items, clean = made(tmp_path, spark)
    rng = np.random.default_rng(3)
    words = [*WORDS["en"].split(), *(f"word{i}" for i in range(3000))]
    long = " ".join(x if i % 3 else "the" for i, x in enumerate(rng.choice(words, 120_000)))
    names = ["score", "lang_pred", "__lang", "__score", "row", "kept", "id", "n", "fp", "key", "comp", "band", "c", "__w", "text_"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    docs = docs.union(spark.createDataFrame([(9000, long, "en", "s", len(long))], docs.schema))
    docs = docs.selectExpr("*", *(f"{i} as `{c}`" for i, c in enumerate(names)))
    for name, stage in corpus_pipeline.STAGES:
        columns, docs = docs.columns, stage(spark, docs, str(tmp_path))
        assert name == "packing" or docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert {r["doc_id"] for r in docs.collect()} == clean | {9000}
