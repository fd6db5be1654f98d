import zlib

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm.quality import judged
from sparkloom.llm.toxicity import scored

from .test_bagminhash import classes

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]
    good = corpus_pipeline.quality(spark, docs, SF)
    verdict = {r.doc_id: r.kept for r in judged(docs, labels).collect()}
    assert good.columns == columns and sorted(r.doc_id for r in good.collect()) == sorted(k for k, v in verdict.items() if v)
    kind = corpus_pipeline.toxicity(spark, good, SF)
    score = {r.doc_id: r.score for r in scored(good, labels).collect()}
    assert kind.columns == columns and sorted(r.doc_id for r in kind.collect()) == sorted(k for k, v in score.items() if v < 0.5)
    single = corpus_pipeline.near_duplicates(spark, kind, SF)
    rows = {r.doc_id: r for r in kind.collect()}
    assert single.columns == columns
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(classes([(k, r.text) for k, r in rows.items()]).values()))
    assert all(r == rows[r.doc_id] for r in single.collect())


def test_run_packs_what_the_stages_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, SF)
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    expected = set()
    for r in left.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        for start in range(0, len(ids), 1024):
            piece = ids[start : start + 1024]
            expected.add((r.doc_id, start, len(piece), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece))))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len(rows) == len(expected) and {(r.doc_id, r.start, r.length, r.ids_crc32) for r in rows} == expected


def test_stages_take_empty_and_awkward_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int, kept string, row int"
    rows = [(None, None, None, None, None, 1, "x", 1), (1, "", "en", "a", 0, 1, "x", 1), (2, "hello there " * 50_000, "en", "a", 9, 1, "x", 1), (2, "hello there " * 50_000, "en", "a", 9, 1, "x", 1)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns
            stage(spark, docs, SF).collect()
        corpus_pipeline.packing(spark, docs, SF).collect()
