"""Dump readers, against hand-written dumps."""

import bz2
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from linkrank.sources import files, sqldump, xmldump
from linkrank.streaming import ingest

PAGE = r"""-- dump
CREATE TABLE `other` (
  `x` int
);
CREATE TABLE `page` (
  `page_id` int(8) NOT NULL,
  `page_namespace` int(11),
  `page_title` varbinary(255),
  `page_random` double,
  `page_is_redirect` tinyint,
  `page_len` int,
  PRIMARY KEY (`page_id`),
  KEY `k` (`page_title`)
) ENGINE=x;
INSERT INTO `page` VALUES (1,0,'It\'s_(a),(b)',0.5,0,101),(2,0,'comma,_here',1e-3,1,100),(3,1,'',NULL,0,null);
INSERT INTO `other` VALUES (9);
INSERT INTO `page` VALUES (-4,0,'line\nbreak',0xAB,0,200),(5,0,'back\\nslash',0.1,0,0xAB),(6,0,'dou''ble');
"""


@pytest.fixture()
def page(tmp_path):
    path = tmp_path / "page.sql.gz"
    path.write_bytes(gzip.compress(PAGE.encode() + b"INSERT INTO `page` VALUES (7,0,'bad\xff',0.1,0,300),(8,0,'cr\rin',0.1,0,301);\n"))
    return str(path)


def test_columns(spark, page):
    text = sqldump.lines(spark, page)
    assert sqldump.create_columns(text, "page") == ["page_id", "page_namespace", "page_title", "page_random", "page_is_redirect", "page_len"]
    with pytest.raises(ValueError):
        sqldump.create_columns(text, "absent")
    with pytest.raises(ValueError):
        sqldump.selected(sqldump.tuples(sqldump.insert_payloads(text, "page")), ["page_id"], sqldump.DUMPS["page"].schema)


def test_rows(spark, page):
    rows = {r["page_id"]: tuple(r)[1:] for r in sqldump.read_dump(spark, page, "page").collect()}
    assert rows == {
        1: (0, "It's_(a),(b)", 0, 101),
        2: (0, "comma,_here", 1, 100),
        3: (1, "", 0, None),
        -4: (0, "line\nbreak", 0, 200),
        5: (0, "back\\nslash".replace("\\n", "\n"), 0, None),  # escapes go one kind after another; a hexadecimal number is no number
        6: (0, "dou''ble", None, None),
        7: (0, "bad�", 0, 300),
        8: (0, "cr\rin", 0, 301),
    }
    strict = {r["page_id"]: r["page_title"] for r in sqldump.read_dump(spark, page, "page", strict=True).collect()}
    assert strict[5] == "back\\nslash" and strict[1] == "It's_(a),(b)"


def test_many_rows_in_a_line(spark, tmp_path):
    n = 6000
    line = "INSERT INTO `linktarget` VALUES " + ",".join(f"({i},0,'T_{i}\\')')" for i in range(n)) + ";\n"
    path = tmp_path / "linktarget.sql"
    path.write_text("CREATE TABLE `linktarget` (\n  `lt_id` int,\n  `lt_namespace` int,\n  `lt_title` varbinary(255),\n);\n" + line)
    got = sqldump.read_dump(spark, str(path), "linktarget").collect()
    assert len(got) == n and {r["lt_title"] for r in got} == {f"T_{i}')" for i in range(n)}


def page_xml(i, title="A b", ns="0", text="words", extra="", more=""):
    return f"<page><title>{title}</title><ns>{ns}</ns><id>{i}</id>{extra}<revision><id>9</id><text bytes='3'>{text}</text></revision>{more}</page>"


def test_pages(spark, tmp_path):
    head = '<mediawiki xmlns="http://example.org/x">'
    first = head + page_xml(1) + page_xml(2, extra='<redirect title="x"/>') + page_xml(3, ns="1")
    second = page_xml(4, text="") + page_xml(5, text="one", more="<revision><text>two</text></revision>") + page_xml(6, text="a &amp;nbsp; b") + "</mediawiki>"
    path = tmp_path / "pages.xml.bz2"
    path.write_bytes(bz2.compress(first.encode()) + bz2.compress(second.encode()))
    pages = xmldump.read_pages(spark, str(path))
    articles = xmldump.article_pages(pages)
    assert sorted(map(tuple, articles.collect())) == [(1, "A_b", "words"), (5, "A_b", "one"), (6, "A_b", "a &nbsp; b")]
    assert [r[0] for r in xmldump.article_pages(pages, limit=2).collect()] == [1, 5]


def test_truncated_pages(spark, tmp_path):
    path = tmp_path / "cut.xml"
    path.write_text("<mediawiki>" + page_xml(1) + "<page><title>x</title><ns>0</ns><id>2</id><revision><text>cut")
    pages = xmldump.read_pages(spark, str(path))
    assert [r[0] for r in xmldump.article_pages(pages).collect()] == [1]
    assert xmldump.extraction_facts(5, 0, 10) == {}
    assert xmldump.extraction_facts(10, 1, 10)["status"] == "complete_with_warnings"
    with pytest.raises(xmldump.TooFewPages):
        xmldump.extraction_facts(9, 1, 10)


def test_white_space_stays(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<mediawiki>" + page_xml(1, text="  two\n ") + "</mediawiki>")
    assert [r[2] for r in xmldump.article_pages(xmldump.read_pages(spark, str(tmp_path / "a.xml"))).collect()] == ["  two\n "]


def test_schema_far_into_a_dump(spark, tmp_path):
    line = "INSERT INTO `x` VALUES (" + "1" * 2000 + ");\n"
    path = tmp_path / "far.sql"
    path.write_text(line * 20_000 + "CREATE TABLE `page` (\n  `page_id` int,\n  `b` int\n) E;\n" + line * 20_000)
    before = spark.conf.get("spark.driver.maxResultSize", None)
    assert sqldump.create_columns(sqldump.lines(spark, str(path)), "page") == ["page_id", "b"], before


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(files.Incomplete):
        files.require_complete(spark, path)
    assert files.write_table(spark.range(10), path, "zstd", rows_per_file=3) == 10
    assert files.require_complete(spark, path) == path
    parts = files.manifest(spark, path).collect()
    assert sum(r["rows"] for r in parts) == 10 and all(r["rows"] <= 3 and r["file"].endswith(".parquet") for r in parts)
    built = []
    out = files.stage(spark, path, lambda: built.append(1) or spark.range(3))
    assert out.count() == 10 and not built
    assert files.stage(spark, path, lambda: spark.range(3), force=True).count() == 3
    files.write_table(spark.range(2), path, limited=True)
    assert files.stage(spark, path, lambda: spark.range(5)).count() == 5  # a limited table is built anew
    with pytest.raises(files.Empty):
        files.write_table(spark.range(0), str(tmp_path / "e"), allow_empty=False)
    (tmp_path / "u.parts").mkdir()
    assert files.table_path(spark, str(tmp_path / "u")) == str(tmp_path / "u")
    spark.range(4).write.parquet(str(tmp_path / "v.parts"))
    assert files.table_path(spark, str(tmp_path / "v")) == str(tmp_path / "v.parts")
    with pytest.raises(files.Empty):
        files.adopt(spark, str(tmp_path / "v.parts"), min_rows=5)
    assert not files.is_complete(spark, str(tmp_path / "v.parts"))
    assert files.adopt(spark, str(tmp_path / "v.parts")) == 4
    assert files.is_complete(spark, str(tmp_path / "v.parts"))
    assert files.raw_path(spark, str(tmp_path / "none"), required=False) is None
    with pytest.raises(files.Incomplete):
        files.raw_path(spark, str(tmp_path / "none"))


def test_documents_and_csv(spark, tmp_path):
    assert files.write_document(spark.range(1).selectExpr("id AS b", "'é' AS a"), str(tmp_path / "d.json")) == {"a": "é", "b": 0}
    assert (tmp_path / "d.json").read_text() == '{\n  "a": "é",\n  "b": 0\n}\n'
    assert files.read_json(spark, str(tmp_path / "d.json")) == {"a": "é", "b": 0}
    files.write_csv(spark.range(3), str(tmp_path / "c.csv"), "id")
    assert [r[0] for r in files.read_csv(spark, str(tmp_path / "c.csv"), "id LONG").collect()] == [0, 1, 2]


def test_checksums(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.bin").write_bytes(name.encode())
    digest = hashlib.sha1(b"a").hexdigest()
    (tmp_path / "sums").write_text(f"{digest.upper()}  a.bin\n{digest} *b.bin\n")
    got = files.verified(spark, str(tmp_path / "*.bin"), files.read_manifest(spark, str(tmp_path / "sums")))
    assert {r["file"]: r["status"] for r in got.collect()} == {"a.bin": "OK", "b.bin": "BAD", "c.bin": "NO ENTRY"}


def test_new_files_only(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = "INSERT INTO `categorylinks` VALUES ({},1);\n"
    (tmp_path / "in/1.sql").write_text(line.format(1))
    at = [str(tmp_path / x) for x in ("in", "out", "check")]
    run = lambda: ingest.ingest_new(spark, at[0], "categorylinks", ["cl_from", "cl_target_id"], at[1], at[2])
    run()
    (tmp_path / "in/2.sql").write_text(line.format(2))
    run()
    run()
    assert sorted(r[0] for r in spark.read.parquet(at[1]).collect()) == [1, 2]


def test_dumps_are_written_and_read_in_several_files(spark, tmp_path, monkeypatch):
    """Neither writing nor reading a dump made of tables goes to one task; each file is whole by itself."""
    import bz2
    from xml.etree import ElementTree

    from linkrank.plans import roundtrips

    monkeypatch.setattr(roundtrips, "FILE_LINES", 2)
    monkeypatch.setattr(roundtrips, "FILE_PAGES", 20)
    rows = spark.range(1000).select(F.lit(7).cast("long").alias("cl_from"), F.col("id").alias("cl_target_id"))
    roundtrips.write_dump(rows, "categorylinks", str(tmp_path / "d"))
    assert len(list((tmp_path / "d").glob("*.gz"))) == 5
    read = sqldump.read_dump(spark, str(tmp_path / "d"), "categorylinks")
    assert sorted(r.cl_target_id for r in read.collect()) == list(range(1000))
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("a & b\nc "), "id").alias("text"))
    roundtrips.write_pages(docs, str(tmp_path / "x"))
    files = list((tmp_path / "x").glob("*.bz2"))
    assert len(files) == 5
    assert sum(len(ElementTree.fromstring(bz2.decompress(f.read_bytes()).decode())) for f in files) == 100
    pages = xmldump.read_pages(spark, str(tmp_path / "x"), strict=True)
    assert {(r.id, r.revision[0].text) for r in pages.collect()} == {(i, f"a & b\nc {i}") for i in range(100)}
