"""The pipeline against its stages done by brute force."""

import collections

import corpus_pipeline
from tests.llm.test_documents import brute_base, brute_quality
from tests.llm.test_similar import brute_kept

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_in_order(spark, documents, texts):
    good = stage("quality_rules")(spark, documents, SF)
    assert good.columns == COLUMNS
    measured = {i: brute_quality(t, 10) for i, t in texts.items()}
    wanted = {i for i, q in measured.items() if q[0] >= 50 and 100 * q[4] <= 50 * q[0] and 100 * q[5] <= 30 * q[0] and not (q[6] > 120 and 100 * q[6] > 20 * q[0])}
    assert {r.doc_id for r in good.collect()} == wanted

    single = stage("simhash_dedup")(spark, good, SF)
    assert single.columns == COLUMNS
    wanted = set(brute_kept({i: texts[i] for i in wanted}))
    assert sorted(r.doc_id for r in single.collect()) == sorted(wanted)

    clean = stage("decontamination")(spark, single, SF)
    assert clean.columns == COLUMNS
    items = [r.text.lower().rstrip(".") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    wanted = {i for i in wanted if not any(b in texts[i].lower() for b in items)}
    assert {r.doc_id for r in clean.collect()} == wanted

    private = stage("personal_data")(spark, clean, SF)
    assert private.columns == COLUMNS
    rows = private.collect()
    assert {r.doc_id for r in rows} == wanted
    for r in rows:
        assert not brute_base(r.text) and r.n_chars == len(r.text)
        if not brute_base(texts[r.doc_id]) and "token" not in texts[r.doc_id]:
            assert r.text == texts[r.doc_id]

    packed = stage("packing")(spark, private, SF).collect()
    assert {r.doc_id for r in packed} == wanted
    pieces = collections.Counter()
    for r in packed:
        pieces[r.doc_id] += r.length
    assert all(pieces[r.doc_id] == r.doc_tokens for r in packed)
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


#: Rows (id, start of text) that stages keep of the odd documents; a stage that isn't here keeps all.
ODD_KEPT = {
    "quality_rules": [(4, "w0x"), (4, "w0x"), (8, "w0x")],
    "simhash_dedup": [(0, "no "), (1, ""), (4, "w0x"), (5, "one"), (5, "two"), (6, "xxx"), (7, "é 漢")],
}


def test_odd_rows_pass_through(spark, odd_documents, no_documents):
    for name, f in corpus_pipeline.STAGES[:4]:
        found = f(spark, odd_documents, SF)
        assert found.columns == odd_documents.columns, name
        kept = sorted((r.doc_id or 0, (r.text or "")[:3]) for r in found.collect())
        assert kept == ODD_KEPT.get(name, sorted((r.doc_id or 0, (r.text or "")[:3]) for r in odd_documents.collect())), name
        assert f(spark, no_documents, SF).count() == 0
    assert stage("packing")(spark, odd_documents, SF).select("doc_id").distinct().count() == 10
