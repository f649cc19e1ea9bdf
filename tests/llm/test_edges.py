"""What all operators and the pipeline share: empty tables, clashing columns, nulls, repeated rows, ties and very long texts."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import byte_bpe, exact_dedup, jaccard_join, language_id, license_scan, mixing, periodic_runs, pii, quality_crf, quality_rules, queries, sharding, toxicity

#: Names that an operator might use on its way.
CLASHING = ["digest_", "hot_d", "mark_", "node_", "measures_", "lines_", "dir_", "best_", "first_copy_", "row_", "start_", "bucket_", "offset_", "maybe_", "id_", "component_", "d", "m", "id", "region", "mix_row_", "key_", "kind_", "body_", "licenses_", "held_", "n", "own__score", "one_"]
LONG_RUN, MANY_WORDS = "x" * 200_000, "lorem ipsum the and of " * 12_000
ROWS = [
    (1, "Alpha beta gamma delta epsilon. Released under the MIT License.", "en", "a"),
    (1, "Alpha beta gamma delta epsilon. Released under the MIT License.", "en", "a"),
    (2, "alpha beta gamma delta epsilon. released under the mit license.", "de", "b"),
    (3, None, "en", None),
    (4, "", None, "a"),
    (5, LONG_RUN, "en", "b"),
    (6, MANY_WORDS, "de", None),
    (7, "\n" * 5000 + "after many lines", "en", "a"),
    (None, "no id at all", None, None),
    (None, "no id at all", None, None),
    (None, None, None, None),
    (8, "vexler grumbo you vexler", "en", "a"),
    (9, "a calm and friendly line of text", "en", "a"),
]
LABELS = [(1, 1, 0), (2, 1, 0), (8, 0, 1), (9, 1, 0), (6, 0, 0), (None, 1, 1), (3, None, None)]


def frames(spark, rows, labels):
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.char_length("text").cast("long"))
    return documents, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def ranks():
    tokenizers = pytest.importorskip("public_tokenizers")
    return byte_bpe.load_ranks(tokenizers.path("byte_bpe_50k.tiktoken")), tokenizers.PATTERN


#: Each operator as a function of documents and labels that gives one row for each document (op5 and op10's others differ).
OPERATORS = {
    "op1": lambda d, _: sharding.assign_shards(d, 16),
    "op2": lambda d, _: license_scan.scan(d.withColumn("path", F.concat_ws("/", F.lit("top"), "source", F.col("doc_id").cast("string")))),
    "op3": lambda d, _: quality_rules.apply_rules(d),
    "op4": lambda d, _: exact_dedup.dedup(d),
    "op6": lambda d, _: byte_bpe.encode(d, *ranks()),
    "op7": lambda d, y: quality_crf.score(d, quality_crf.fit(d, y)),
    "op8": lambda d, _: language_id.identify(d, language_id.fit(d)),
    "op9": lambda d, y: toxicity.score(d, toxicity.fit(d, y), evidence=True),
    "op10": lambda d, _: jaccard_join.jaccard_components(d),
    "op12": lambda d, _: pii.find_pii(d),
    "op13": lambda d, _: periodic_runs.find_runs(d, alter=True),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_edge_rows_and_clashing_columns(spark, name):
    documents, labels = frames(spark, ROWS, LABELS)
    clashing = documents.select("*", *[F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHING])
    found = [r.asDict() for r in OPERATORS[name](clashing, labels).collect()]
    assert len(found) == len(ROWS)
    assert all(r[c] == c + ("-" if r["doc_id"] is None else str(r["doc_id"])) for r in found for c in CLASHING)
    assert sorted((str(r["doc_id"]), len(r["text"] or "")) for r in found if "text" in r) in (sorted((str(i), len(t or "")) for i, t, *_ in ROWS), [])


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_tables(spark, name):
    documents, labels = frames(spark, ROWS, LABELS)
    assert OPERATORS[name](documents.limit(0), labels.limit(0)).count() == 0
    if name in ("op7", "op8", "op9"):
        assert OPERATORS[name](documents, labels.limit(0)).count() == len(ROWS)
        assert OPERATORS[name](documents.limit(0), labels).count() == 0


def test_mix_of_edge_rows(spark):
    documents, _ = frames(spark, ROWS, LABELS)
    clashing = documents.select("*", *[F.lit(c).alias(c) for c in CLASHING])
    found = mixing.mixed_documents(clashing, block=512).collect()
    assert found and all(r[c] == c for r in found for c in CLASHING) and all(r["text"] for r in found)
    assert mixing.mixed_documents(documents.limit(0)).count() == 0
    assert exact_dedup.without_copies(clashing).where("doc_id = 1").count() == 0
    assert exact_dedup.without_copies(clashing).where("doc_id is null").count() == 1
    assert jaccard_join.one_of_each(clashing).where("doc_id = 2").count() == 0


@pytest.mark.parametrize("rows,labels", [(ROWS, LABELS), ([], []), (ROWS, [])])
def test_queries_and_pipeline_over_edge_tables(spark, tmp_path, rows, labels):
    documents, truth = frames(spark, rows, labels)
    documents.select("*", F.lit("kept").alias("extra")).write.parquet(str(tmp_path / "documents.parquet"))
    truth.write.parquet(str(tmp_path / "labels.parquet"))
    for name, query in queries.queries().items():
        if name == "op11_pareto_layers":  # reads the shop's tables: test_pareto.py
            continue
        assert query(spark, str(tmp_path)).count() == len(rows), name
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 if not rows else out.where("extra != 'kept'").count() == 0 and out.count() > 0
