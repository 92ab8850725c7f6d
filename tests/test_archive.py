import mailbox
from email.message import EmailMessage

from pyspark.sql import functions as F

from letterloom.operators import lexical, vectors
from letterloom.sources import archive, mail, sinks
from letterloom.functions import values as V


def message(n, body=None, file=None, subject=None, charset="utf-8"):
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Date"] = "Ann <ann@x.example>", "b@x.example", subject or f"Grüße {n}", "Wed, 03 Feb 2021 09:47:58 +0100"
    if n is not None:
        m["Message-ID"] = f"<{n}@x>"
    m.set_content(body or f"Body {n} café\n\nSecond paragraph of pump report {n}", charset=charset, cte="8bit")
    if file:
        m.add_attachment(file[1], maintype="application", subtype="pdf", filename=file[0])
    return m


def box_of(path, messages):
    box = mailbox.mbox(str(path))
    for m in messages:
        box.add(m)
    box.flush()
    return str(path)


def test_mbox_keeps_bytes_and_first_wins(spark, tmp_path):
    """Five mails: a doubled id, one without id, one in Latin-1, one with an encoded subject."""
    raw = b"From a@x Wed Feb  3 09:47:58 2021\nFrom: a@x.example\nMessage-ID: <lat@x>\nContent-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: 8bit\n\nGr\xfc\xdfe caf\xe9\n\n"
    path = tmp_path / "five.mbox"
    box_of(path, [message(1), message(1, body="later copy"), message(None), message(4, subject="Übergabe – Größe")])
    path.write_bytes(path.read_bytes() + raw)
    rows = mail.read_mbox(spark, str(path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["message_id"], []).append(r)
    assert len(rows) == 5 and len(by["<1@x>"]) == 2 and by["<lat@x>"][0]["body"].strip() == "Grüße café"
    assert sum(k.startswith("synthetic-") for k in by) == 1 and by["<4@x>"][0]["subject"] == "Übergabe – Größe"


def test_write_path(spark, tmp_path):
    path = box_of(tmp_path / "in.mbox", [message(1, file=("../../a.pdf", b"%PDF 1")), message(1, body="copy"), message(2, file=("b.pdf", b"%PDF 1")), message(3, file=("empty.pdf", b"")), message(4)])
    out = str(tmp_path / "archive")
    added = archive.ingest(spark, mail.read_mbox(spark, path), out)
    assert (added["messages"], added["blobs"], added["attachments"], added["attachment_jobs"]) == (4, 1, 2, 2)
    chunks = archive.read(spark, out, "chunks").collect()
    assert {r["kind"] for r in chunks} == {"body", "meta"} and len(chunks) == 8 == added["embedding_jobs"]
    names = {r["filename"] for r in archive.read(spark, out, "attachments").collect()}
    assert names == {"a.pdf", "b.pdf"}
    again = archive.ingest(spark, mail.read_mbox(spark, path), out)
    assert set(again.values()) == {0}
    assert archive.read(spark, out, "messages").count() == 4
    assert archive.hash_pending(spark, out) == 8 and archive.hash_pending(spark, out) == 0
    v = archive.read(spark, out, "chunk_vectors").first()
    assert abs(sum(x * x for x in v["embedding"]) - 1) < 1e-6
    assert archive.read(spark, out, "postings").where("term = 'cafe'").count() == 4


def test_sidecars(spark, tmp_path):
    (tmp_path / "e/In.mbox/Messages").mkdir(parents=True)
    (tmp_path / "e/In.mbox/Attachments/7/2").mkdir(parents=True)
    (tmp_path / "e/In.mbox/Messages/Attachments/7").mkdir(parents=True)
    (tmp_path / "e/In.mbox/Messages/7.emlx").write_bytes(message(7, file=("a.pdf", b"%PDF same")).as_bytes())
    (tmp_path / "e/In.mbox/Messages/8.emlx").write_bytes(message(8).as_bytes())
    (tmp_path / "e/In.mbox/Attachments/7/2/same.pdf").write_bytes(b"%PDF same")
    (tmp_path / "e/In.mbox/Attachments/7/2/pic.png").write_bytes(b"png")
    (tmp_path / "e/In.mbox/Messages/Attachments/7/odd.xyz").write_bytes(b"odd")
    rows = {r["message_id"]: r for r in mail.with_sidecars(mail.read_emlx(spark, str(tmp_path / "e")), mail.sidecar_files(spark, str(tmp_path / "e"))).collect()}
    assert [(a["filename"], a["mime"]) for a in rows["<7@x>"]["attachments"]] == [("a.pdf", "application/pdf"), ("odd.xyz", "application/octet-stream"), ("pic.png", "image/png")]
    assert rows["<7@x>"]["has_attachments"] and not rows["<8@x>"]["has_attachments"]
    # A rescan that finds a new file beside a known mail adds only that.
    out = str(tmp_path / "archive")
    assert archive.ingest(spark, mail.read_emlx(spark, str(tmp_path / "e")), out)["attachments"] == 1
    added = archive.ingest(spark, mail.with_sidecars(mail.read_emlx(spark, str(tmp_path / "e")), mail.sidecar_files(spark, str(tmp_path / "e"))), out)
    assert added["attachments"] == 2 and added["messages"] == 0


def test_index_reads_only_its_terms(spark, tmp_path):
    docs = spark.createDataFrame([(1, "pump report"), (2, "Pump pump"), (3, None), (4, ""), (5, "report on the pump of the harbour")], "id long, text string")
    index = lexical.Index.build(docs, "id", ["text"], str(tmp_path / "index"))
    assert {r["id"] for r in index.search(["pump", "report"]).collect()} == {1, 5}
    assert index.search([]).count() == index.search(["nothing"]).count() == 0
    plan = index._of("postings", ["pump"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,pump)]" in plan or "term" in plan.split("PushedFilters")[1][:80]
    empty = lexical.Index.build(docs.limit(0), "id", ["text"], str(tmp_path / "none"))
    assert empty.search(["pump"]).count() == 0


def test_nearest_equals_brute_force_with_ties_and_copies(spark):
    import random

    rng = random.Random(1)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(200)] + [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(300)] + [(9999, None)]
    df = spark.createDataFrame(rows, "vec_id long, v array<float>").repartition(5)
    queries = df.where("vec_id % 50 = 0 AND v IS NOT NULL").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    for block in (32_000_000, 100):
        got = {}
        for r in vectors.nearest(queries, df, 7, block).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        full = {r["vec_id"]: [float(x) for x in r["v"]] for r in df.where("v IS NOT NULL").collect()}
        for q, found in got.items():
            want = sorted((round(sum((a - b) ** 2 for a, b in zip(full[q], v, strict=True)), 9), i) for i, v in full.items())[:7]
            assert [i for _, i in sorted(found)] == [i for _, i in want]
        assert len(got) == len([i for i in full if i % 50 == 0])
    assert vectors.nearest(queries.limit(0), df, 3).count() == 0 and vectors.nearest(queries, df.limit(0), 3).count() == 0


def test_best_of_several_times(spark):
    h = "array(named_struct('from', '2024-01-01', 'to', '2024-01-31', 'weight', 0.5D), named_struct('from', '2024-03-01', 'to', '2024-03-31', 'weight', 0.9D))"
    df = spark.sql(f"SELECT to_date(d) AS d, {h} AS h FROM VALUES ('2024-01-10'), ('2024-03-10'), (null) AS t(d)")
    got = [r[0] for r in df.select(V.best_time_boost(F.col("d"), F.col("h"))).collect()]
    assert got[1] == 0.9 and got[2] == 0.0 and got[0] >= 0.5
    assert spark.sql(f"SELECT to_date('2024-01-10') AS d, slice({h}, 1, 0) AS h").select(V.best_time_boost(F.col("d"), F.col("h"))).first()[0] == 0.0


def test_cells_and_totals_as_csv(spark, tmp_path):
    cells = spark.createDataFrame([("m", "a", 1, 0, 2, None, "price", 1.5)], "message_id string, attachment_path string, page int, table_index int, row_index int, year int, `column` string, value double")
    sinks.write_cells(cells, str(tmp_path / "cells"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "cells")).columns == sinks.CELLS
    sinks.write_totals(cells.select("year", F.col("column").alias("metric"), F.col("value").alias("total")), str(tmp_path / "totals"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "totals")).count() == 1
