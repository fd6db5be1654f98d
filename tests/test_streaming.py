from sparkloom.operators.ledger_tables import SUBMISSION, Ledger
from sparkloom.streaming.submissions import registering


def test_submissions_come_in_batches(spark, tmp_path):
    kind = SUBMISSION + ", k int"
    book = Ledger(spark, f"file://{tmp_path}/ledger")
    book.migrate()

    def arrive(*rows):
        spark.createDataFrame([(slug, "1.0.0", slug, digest, "ann", None, None, k) for k, (slug, digest) in enumerate(rows)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = registering(stream, book, "k", str(tmp_path / "out"), str(tmp_path / "state"), once=True)
        assert query.awaitTermination(120) and query.exception() is None

    arrive(("one", "h1"), ("two", "h1"), ("one", "h2"))
    arrive(("three", "h3"), ("ONE", "h4"))
    got = sorted((r.batch, r.slug, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, "one", "registered"), (0, "two", "exact_collision"), (1, "ONE", "id_collision"), (1, "three", "registered")]
    assert book.verify().first().entries == 2
