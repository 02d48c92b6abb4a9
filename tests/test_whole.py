"""Registered queries read their tables whole: no document, text or row is left out."""

from jobloom.operators import arrivals
from jobloom.plans import fixtures, registry
from tests.conftest import DATA


def test_postings_read_every_document_whole(spark, tmp_path):
    for t in ("orders", "customer"):
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs = [(0, "a " * 5_000 + "end"), (7, "x"), (199, "y" * 700), (200, "z" * 700), (1_400, "late text"), (900_000, "no order has this number"), (900_001, None), (900_002, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.ordinal: r for r in fixtures.postings(spark, str(tmp_path)).collect()}
    orders = {r.o_orderkey for r in spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey").collect()}
    assert set(got) == orders | {i for i, _ in docs}
    assert all(got[i].description.endswith(" " + (t or "")) for i, t in docs)
    assert all(r.url and r.company and r.title and r.fetched_at for r in got.values())


def test_postings_of_the_tables_read_every_document_whole(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    p = fixtures.postings(spark, DATA).select("ordinal", "description")
    whole = docs.join(p, docs.doc_id == p.ordinal).filter("endswith(description, ' ' || text)")
    assert whole.count() == docs.count()


def test_arrivals_split_all_postings(spark, monkeypatch):
    met = []
    monkeypatch.setattr(arrivals, "new_postings", lambda batch, seen: met.extend((batch, seen)) or batch.withColumn("company_title_key", arrivals.F.lit("")))
    registry.QUERIES["new_postings"](spark, DATA)
    got = sorted(r.ordinal for df in met for r in df.select("ordinal").collect())
    assert got == sorted(r.ordinal for r in fixtures.postings(spark, DATA).select("ordinal").collect())
