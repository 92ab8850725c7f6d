import mailbox
from email.message import EmailMessage

from letterloom.sources import mail
from letterloom.streaming import ingest


def message(n, **extra):
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Message-ID"], m["Date"] = "Ann <ann@x.example>", "b@x.example, c@x.example", f"Grüße {n}", f"<{n}@x>", "Wed, 03 Feb 2021 09:47:58 +0100"
    m.set_content(f"Body {n} café\n\nFrom here on\n")
    if extra.get("file"):
        m.add_attachment(b"%PDF", maintype="application", subtype="pdf", filename="a.pdf")
    return m


def test_maildir_emlx_and_mbox(spark, tmp_path):
    for folder in ("A/cur", "A/new", "A/B/cur", "A/tmp"):
        (tmp_path / "md" / folder).mkdir(parents=True)
        (tmp_path / "md" / folder / "1").write_bytes(message(folder.replace("/", ".")).as_bytes())
    got = mail.read_maildir(spark, str(tmp_path / "md")).collect()
    assert sorted(r["folder"] for r in got) == ["A", "A", "A/B"]
    assert got[0]["subject"].startswith("Grüße") and "café" in got[0]["body"] and got[0]["date_ts"] == 1612342078
    box = mailbox.mbox(str(tmp_path / "x.mbox"))
    for n in range(5):
        box.add(message(n, file=n == 1))
    box.flush()
    rows = {r["message_id"]: r for r in mail.read_mbox(spark, str(tmp_path / "x.mbox")).collect()}
    assert len(rows) == 5 and rows["<1@x>"]["attachments"][0]["filename"] == "a.pdf" and rows["<0@x>"]["folder"] == "mbox/x"
    (tmp_path / "e/In/Messages").mkdir(parents=True)
    raw = message("e").as_bytes()
    (tmp_path / "e/In/Messages/1.emlx").write_bytes(str(len(raw)).encode() + b"\n" + raw + b"<plist/>")
    (tmp_path / "e/In/Messages/2.emlx").write_bytes(raw)
    assert [r["folder"] for r in mail.read_emlx(spark, str(tmp_path / "e"), folder_filter="in").collect()] == ["In", "In"]


def test_stream_equals_batch_and_repeats(spark, data, tmp_path):
    path = f"{data}/parsed_messages.parquet"
    out = str(tmp_path / "table")
    for run in range(2):
        ingest.ingest(spark, ingest.parquet_stream(spark, path), out, str(tmp_path / f"state{run}"), "message_id", ["scanned_at", "path", "parse_id"]).awaitTermination()
    assert spark.read.parquet(out).count() == spark.read.parquet(path).where("message_id IS NOT NULL").select("message_id").distinct().count()
