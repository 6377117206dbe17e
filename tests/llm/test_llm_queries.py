"""The training-data queries with SQL give its rows; the pipeline's stages keep their promises."""

import pytest
from compare import assert_same

import corpus_pipeline
from txrisk.llm import queries
from txrisk.llm.common import documents, materialize

NAMES = ["line_dedup", "exact_dedup", "quality_model", "merkle_audit", "quality_rules", "url_filter", "simhash", "language_id", "pieces", "mixing", "merkle_manifest", "sharding", "resampling"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, small, duck, name):
    assert_same(queries.QUERIES[name](spark, small), duck.sql(queries.ORACLES[name]))


def test_one_query_for_each_operator():
    assert list(queries.QUERIES) == [f"op{i}_{n}" for i, n in enumerate(NAMES, 1)]


def test_registered(spark):
    import __spark_entry__

    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


def test_pipeline_stages(spark, small):
    from txrisk.llm import pieces, simhash

    docs = documents(spark, small)
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, small), "test")
        kept[name] = docs
        if name != "pieces":
            assert docs.columns == columns
    ids = lambda n: {r[0] for r in kept[n].select("doc_id").collect()}
    assert ids("line_dedup") <= ids("quality_rules") and ids("simhash") <= ids("line_dedup") and ids("mixing") <= ids("simhash")
    left = simhash.near_duplicates(kept["simhash"])
    assert left.select("component_id").distinct().count() == left.count()
    back = {(r["doc_id"], r["text"]) for r in pieces.decode(kept["pieces"], queries.model_path()).collect()}
    assert back == {(r["doc_id"], r["text"]) for r in kept["mixing"].collect()}
    # no line stands twice in what line dedup kept
    lines = [x.strip().lower() for r in kept["line_dedup"].collect() for x in r["text"].split("\n") if x.strip()]
    assert len(lines) == len(set(lines))


def test_pipeline_on_awkward_rows(spark, small, tmp_path):
    """Nulls in any column, blank and repeated rows, a long text and extra columns go through all stages; so does an empty table."""
    prose = "The old house by the river had stood empty for many years, and nobody in the village could say who owned it. "
    other = "A second text of quite other words follows here, so that it is no copy of the first one in any way at all. "
    rows = [(1, prose * 2, "en", "s1"), (1, prose * 2, "en", "s1"), (None, other, None, None), (None, other, None, None), (3, None, "en", "s2"), (4, "", "de", None), (5, " \n\t", None, "s3"), (6, "\n".join(f"{w} {other[i:]}" for i, w in enumerate(prose.split() * 40)), "fr", "s9"), (7, prose.upper(), "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS kept", "'x' AS component_id", "2 AS __gone", "cast(length(text) AS int) AS n_chars")
    for table, least in ((docs, 1), (docs.limit(0), 0)):
        out = table
        for name, stage in corpus_pipeline.STAGES:
            out = materialize(stage(spark, out, small), "test")
            assert set(out.columns) == set(docs.columns) - {"text"} | {"ids"} if name == "pieces" else out.columns == docs.columns
        assert out.count() >= least and out.where("ids IS NULL").isEmpty()
