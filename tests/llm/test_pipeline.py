import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.conftest import NASTY

from fallow.llm import decontaminate, language_id, secret_scan


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    columns = docs.columns
    given = {r.doc_id: r for r in docs.collect()}

    left = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in left.collect()}
        out = stage(spark, left, sf_dir)
        if name == "packing":
            rows = [r.asDict() for r in out.collect()]
            brute.check_packing(rows, brute.token_pieces([(i, r.text) for i, r in before.items()]))
            break
        assert out.columns == columns
        after = {r.doc_id: r for r in out.collect()}
        assert out.count() == len(after)
        if name == "language":
            judged = {r.doc_id: r.rejected for r in language_id.predict(left, language_id.learn(left)).collect()}
            assert set(after) == {i for i, r in judged.items() if not r}
        elif name == "near_copies":
            assert set(after) == {i for i, (_, _, kept) in brute.near_groups([(i, r.text) for i, r in before.items()], 5, 80).items() if kept}
            assert len(after) < len(before)
        elif name == "test_items":
            def leaks(text):
                words = decontaminate.words_of(text)
                for item in bench:
                    budget = int(decontaminate.RATE * len(item))
                    if sum(w in set(words) for w in item) >= len(item) - budget and brute.edits(item, words) <= budget:
                        return True
                return False

            assert set(after) == {i for i, r in before.items() if not leaks(r.text)}
        elif name == "secrets":
            assert {i: (r.text, r.n_chars) for i, r in after.items()} == {i: (t := brute.redacted(r.text), len(t) if t != r.text else r.n_chars) for i, r in before.items()}
            assert any("[SECRET]" in r.text for r in after.values())
        if name != "secrets":
            assert all(r == given[i] for i, r in after.items())
        left = out
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in whole) == sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows)


def test_nasty_documents_go_through(spark, nasty_docs, sf_dir, tmp_path):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = real.unionByName(nasty_docs.selectExpr("doc_id + 100000 as doc_id", "text", "lang", "source", "n_chars"))
    mixed = mixed.unionByName(real.limit(3)).unionByName(real.limit(2).selectExpr("cast(null as long) as doc_id", "text || ' null'  as text", "lang", "source", "n_chars"))
    mixed.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    docs = mixed.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).collect() == []


def test_redaction_keeps_columns(spark, nasty_docs, tmp_path):
    out = secret_scan.without_secrets(nasty_docs, str(tmp_path / "ledger"), secret_scan.BASE)
    assert out.columns == nasty_docs.columns and out.count() == nasty_docs.count()
    for r in out.collect():
        if r.doc_id < 100:
            assert r.text == brute.redacted(NASTY[r.doc_id])


def test_stages_leave_columns_of_any_name(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ["__blob", "__new", "__spans", "__stays", "blob", "Found", "changed", "spans", "id", "row", "n", "root", "kept", "component_id", "rejected", "lang_pred", "score", "block", "token"]
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")) for c in names})
    given = {r.doc_id: r for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == given[r.doc_id][c] for r in rows for c in ("source", *names))
