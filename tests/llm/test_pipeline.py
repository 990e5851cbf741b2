"""Each stage of the pipeline against what it should do to its own input."""

import corpus_pipeline
from cloakwork.llm import pii, queries

from tests.llm.test_llm_small import brute_components, brute_groups, check_packing
from fractions import Fraction

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert check_packing(docs.collect(), before, 2048, 512) == 1
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            gone = before.keys() - after.keys()
            assert len(gone & toxic) >= 0.7 * len(toxic & before.keys()) and len(gone) <= len(toxic) + 0.05 * len(before)
        elif name == "exact_dedup":
            assert after.keys() == {max(g) for g in brute_groups(before.items()).values()}
        elif name == "ngram_join":
            want = brute_components(list(before.items()), 5, Fraction(4, 5))
            assert after.keys() == {i for i, (n, c) in want.items() if not n or c == i}
        elif name == "pii":
            key = pii.Feistel(queries.PII_KEY)
            assert after == {i: pii.pseudonymise_text(t, key)[0] for i, t in before.items()}
        before = after


def test_nothing_is_dropped_where_nothing_is_learned(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    for name, some in (("none", labels.limit(0)), ("clean", labels.where("toxic = 0")), ("toxic", labels.where("toxic = 1"))):
        some.write.parquet(str(tmp_path / name / "labels.parquet"))
        kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path / name))
        assert kept.columns == docs.columns and kept.count() == docs.count()


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing names; and no rows at all."""
    long = " ".join(f"word{i}" for i in range(40_000))
    texts = [None, "", " \n", "one", "same text of six words here", "same text of six words here", long, long + " tail", "call +1 415 555 1234 or 4111 1111 1111 1111"]
    rows = [(i, t, "en", "s", len(t or ""), 1, 2, 3, 4) for i, t in enumerate(texts)]
    rows += [rows[5], rows[8], (None, "no id", None, None, 0, 1, 2, 3, 4), (None, None, None, None, None, 1, 2, 3, 4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int, `key` int, gone_id int, `we.ird name` int"
    for label, some in (("odd", rows), ("none", [])):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            stage(spark, docs, SMALL).write.parquet(str(tmp_path / label / name))
            docs = spark.read.parquet(str(tmp_path / label / name))
            if name == "packing":
                break
            assert docs.columns == columns
            if name == "exact_dedup":
                assert docs.count() == len({t or "" for _, t, *_ in some})
            elif name == "ngram_join":
                assert docs.where("length(text) > 1000").count() == min(1, len(some))
            elif name == "pii":
                assert docs.where("text like '%4111 1111%' or text like '%555 1234%'").count() == 0
        assert (docs.count() > 0) == bool(some)


def test_queries_run(spark):
    for name, f in queries.queries().items():
        assert f(spark, SMALL).count() > 0, name
    assert corpus_pipeline.run(spark, SMALL).count() > 0
