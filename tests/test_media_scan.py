import base64
import io
import zipfile

from pyspark.sql import functions as F

from vellumark.sources import media_scan, qa


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in members.items():
            archive.writestr(name, data)
    return out.getvalue()


def test_markup_mail_and_packages():
    uri = "data:image/png;base64," + base64.b64encode(b"img").decode()
    scan = media_scan.scan_media(f"# Head\n\nsome text\n\n![a]({uri})\n\n![b](https://x/y.png)".encode(), "a.md")
    assert (scan.kind, scan.scanned, scan.skipped) == ("markup", 2, {"external": 1})
    assert scan.assets[0]["content"] == b"img" and scan.assets[0]["heading"] == "Head" and scan.assets[0]["anchor"].endswith("some text")
    package = zipped({"OEBPS/text/p.xhtml": "<h2>Sec</h2><p>x <img src='../img/A.png'></p>", "OEBPS/img/a.png": b"one", "OEBPS/img/cover.jpg": b"two"})
    scan = media_scan.scan_media(package, "b.epub")
    assert [(a["content"], a["heading"], a["role"]) for a in scan.assets] == [(b"one", "Sec", None), (b"two", None, "document")]
    mail = b'MIME-Version: 1.0\nContent-Type: multipart/related; boundary=B\n\n--B\nContent-Type: text/html\n\n<p>see</p><img src="cid:i1">\n--B\nContent-Type: image/png\nContent-ID: <i1>\nContent-Transfer-Encoding: base64\n\naW1n\n--B--\n'
    assert [a["content"] for a in media_scan.scan_media(mail, "m.eml").assets] == [b"img"]
    assert media_scan.scan_media(b"x", "p.png").assets[0]["role"] == "document"


def test_assets_and_questions_as_frames(spark):
    docs = spark.createDataFrame([(1, "a.zip", zipped({"x.png": b"1", "y.png": b"1"})), (2, "b.png", b"2"), (3, "c.zip", b"PK\3\4broken")], "doc_id long, name string, content binary")
    rows = media_scan.extract_assets(docs).collect()
    assert sorted((r.doc_id, r.idx, r.file_name) for r in rows) == [(1, 0, "x.png"), (1, 1, "y.png"), (2, 0, "b.png")]
    assert len({r.id for r in rows}) == 2
    names = spark.range(1).select(media_scan.media_file_name(F.lit(7), F.lit("a b/c.png"), F.lit(".png")).alias("n")).first().n
    assert names == "007-a_b_c.png"
    sheet = "## S\n\n| title | content | question |\n| --- | --- | --- |\n| t | a &#124; b | q1<br>q2 |\n"
    asked = spark.createDataFrame([("q.md", sheet.encode()), ("q.csv", b"t,c\n"), ("q.zip", zipped({"in.csv": "only,answer,why\n"})), ("no.bin", b"x")], "name string, content binary")
    got = {r.name: (r.title, r.content, [p.content for p in r.problem_list]) for r in qa.question_rows(asked).collect()}
    assert got == {"q.md/S": ("t", "a | b", ["q1", "q2"]), "q.csv/q": ("t", "c", []), "q.zip/in": ("only", "answer", ["why"])}
