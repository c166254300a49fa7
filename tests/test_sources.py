"""Readers, sinks and micro-batch ingestion on small files."""

import json

import pytest

from asofworks.sources import readers, sinks
from asofworks.streaming import ingest


def put(folder, name, content):
    (folder / name).write_text(content if isinstance(content, str) else json.dumps(content))
    return str(folder / name)


def test_company_universe(spark, tmp_path):
    head = "ticker,company,sector,cik\n"
    path = put(tmp_path, "u.csv", head + " aapl ,Apple,Tech,320193\nmsft,,Tech,789019\n,No Ticker,X,1\nX,No Cik,X,\n")
    assert [tuple(r) for r in readers.company_universe(spark, path).collect()] == [("AAPL", "Apple", "Tech", "0000320193")]
    with pytest.raises(Exception, match="bad row"):
        readers.company_universe(spark, path, strict=True).collect()
    twice = put(tmp_path, "v.csv", head + "a,A,X,1\nA,B,X,2\n")
    with pytest.raises(Exception, match="repeated ticker A"):
        readers.company_universe(spark, twice, strict=True).collect()
    good = put(tmp_path, "w.csv", head + "a,A,X,1\n")
    assert [tuple(r) for r in readers.company_universe(spark, good, strict=True).collect()] == [("A", "A", "X", "0000000001")]


def test_json_sources(spark, tmp_path):
    nodes, edges = readers.graph(spark, put(tmp_path, "g.json", {"nodes": [{"node_id": "a", "node_type": "company"}, {"node_id": "b"}], "edges": [{"edge_id": "e", "source": "a", "target": "b", "confidence": 0.5}]}))
    assert sorted(r.node_id for r in nodes.collect()) == ["a", "b"] and edges.first().confidence == 0.5
    (tmp_path / "chunks").mkdir()
    put(tmp_path / "chunks", "1.json", [{"chunk_id": "x", "text": "t"}, {"text": "no id"}])
    put(tmp_path / "chunks", "2.json", [{"chunk_id": "y", "chunk_index": 3}])
    assert sorted((r.chunk_id, r.chunk_index) for r in readers.chunks(spark, str(tmp_path / "chunks")).select("chunk_id", "chunk_index").collect()) == [("x", None), ("y", 3)]
    recent = {"accessionNumber": ["1", "2", "3"], "form": ["10-K", "4", "8-K"], "filingDate": ["2026-01-01"]}
    got = readers.recent_filings(spark, put(tmp_path, "f.json", {"cik": "12", "filings": {"recent": recent}})).collect()
    assert sorted((r.cik, r.accessionNumber, r.form, r.filingDate) for r in got) == [("0000000012", "1", "10-K", "2026-01-01"), ("0000000012", "3", "8-K", None)]


def test_rss(spark, tmp_path):
    item = "<item><title>{}</title><link>{}</link><pubDate>{}</pubDate></item>"
    items = [("a", "http://a", "Tue, 03 Mar 2026 10:00:00 GMT"), ("b", "http://b", "Tue, 03 Mar 2026 12:00:00 +0200"), ("", "http://c", "Tue, 03 Mar 2026 10:00:00 GMT"), ("d", "http://d", "soon")]
    path = put(tmp_path, "r.xml", "<rss><channel>" + "".join(item.format(*x) for x in items) + "</channel></rss>")
    got = readers.rss(spark, path).selectExpr("title", "date_format(published_at, 'yyyy-MM-dd HH:mm') AS t", "fingerprint").collect()
    assert sorted((r.title, r.t) for r in got) == [("a", "2026-03-03 10:00"), ("b", "2026-03-03 10:00")] and len({r.fingerprint for r in got}) == 2


def test_upsert(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "d"), (2, "c"), (3, "e"), (None, "f")], "id long, v string")
    assert sorted(map(tuple, sinks.upsert(old, new, "id", str(tmp_path / "t")).collect())) == [(1, "a"), (2, "c"), (3, "e")]
    sinks.log_failures(new, str(tmp_path / "log"))
    sinks.log_failures(old, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6


def test_ingestion_goes_on_where_it_ended(spark, tmp_path):
    schema, source, folder = "doc_id long, text string", str(tmp_path / "in"), str(tmp_path / "out")
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    spark.createDataFrame([(1, "x" * 4000), (2, None), (3, "short"), (3, "short"), (None, "lost")], schema).write.parquet(source)
    ingest.ingest_available(stream(), folder)
    assert sorted(map(tuple, ingest.manifest(spark, folder).collect())) == [(1, "completed", 3), (2, "failed", 0), (3, "completed", 1)]
    spark.createDataFrame([(1, "changed"), (2, "now"), (4, "new")], schema).write.mode("append").parquet(source)
    ingest.ingest_available(stream(), folder)
    ingest.ingest_available(stream(), folder)  # nothing new
    assert sorted(map(tuple, ingest.manifest(spark, folder).collect())) == [(1, "completed", 3), (2, "completed", 1), (3, "completed", 1), (4, "completed", 1)]
    ingest.ingest_batch(spark.createDataFrame([(4, "new")], schema), 7, folder)
    ingest.ingest_batch(spark.createDataFrame([(5, "five")], schema), 7, folder)  # the batch again replaces itself
    rows = ingest.chunks(spark, folder)
    assert rows.count() == rows.select("chunk_id").distinct().count() == 7 and {r.corpus for r in rows.collect()} == {"live"}
