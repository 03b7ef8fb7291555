"""Archives of many small files: what is written is read again, and damage is a row."""

import base64
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from leafmill.plans import families, writers
from leafmill.sources import archives, datasource, documents, images, pdf


def test_files_are_few_archives_and_read_again(spark, monkeypatch):
    files = families.made(spark.range(3000), lambda r: f"{r['id']}.docx", lambda r: writers.docx(f"text {r['id']}"))
    path = families.folder(files, "many")
    held = spark.read.format("binaryFile").load(path).select("path")
    assert files.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert held.count() <= 2 * spark.sparkContext.defaultParallelism  # a file for each row before
    rows = documents.packed_parts(archives.read_archives(spark, path)).select(families._key().alias("id"), "text", "error").collect()
    assert len(rows) == 3000 and all(r["text"] == f"text {r['id']}" and r["error"] is None for r in rows)
    datasource.register(spark)
    found = spark.read.format("documents").load(path)
    assert found.where("family = 'office'").select(F.count_distinct("path")).first()[0] == 3000
    assert found.where("family = 'pdf'").count() == 0


def test_rows_of_a_small_table_are_dealt_to_all_cores(spark):
    files = families.made(spark.range(1000).coalesce(1), lambda r: f"{r['id']}.png", lambda r: writers.image("png", r["id"] + 1, 4))
    rows = documents.packed_parts(files).select(F.spark_partition_id().alias("task"), "width")
    assert rows.select(F.count_distinct("task"), F.sum("width")).first() == (spark.sparkContext.defaultParallelism, 500500)


def test_a_damaged_archive_is_a_row_behind_its_members(spark, tmp_path):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, data in (("1.png", writers.png(2, 2, bytes(12))), ("2.txt", b"two"), ("3.png", b""), ("deep/4.docx", writers.docx("x" * 4000))):
            member = tarfile.TarInfo(name)
            member.size = len(data)
            tar.addfile(member, io.BytesIO(data))
    (tmp_path / "good.tar").write_bytes(out.getvalue())
    (tmp_path / "cut.tar").write_bytes(out.getvalue()[: out.getvalue().index(b"deep/4.docx") + 600])
    (tmp_path / "none.tar").write_bytes(b"no archive at all" * 100)
    rows = [(r["path"].partition(str(tmp_path))[2][1:], r["error"] is None) for r in documents.packed_parts(archives.read_archives(spark, f"file://{tmp_path}")).collect()]
    assert sorted(rows) == [("cut.tar", False), ("cut.tar/1.png", True), ("cut.tar/3.png", False), ("good.tar/1.png", True), ("good.tar/3.png", False), ("good.tar/deep/4.docx", True), ("none.tar", False)]
    datasource.register(spark)
    found = spark.read.format("documents").load(f"file://{tmp_path}")
    assert sorted(r["path"].rpartition("/")[2] for r in found.where("error IS NOT NULL").collect()) == ["3.png", "3.png", "cut.tar", "none.tar"]
    assert found.where("family = 'text'").select("text").collect() == [("two",), ("two",)]
    pictures = images.image_contents(archives.read_archives(spark, f"file://{tmp_path}").where("path LIKE '%.png'"))
    assert sorted(str(r["width"]) for r in pictures.collect()) == ["2", "2", "None", "None"]


def test_a_font_is_read_once_for_all_pages(monkeypatch):
    """Its map was read again for each page; texts are the same, also of groups that the short form of zeros is for."""
    read = []
    keep = pdf.Font._unicode_map
    monkeypatch.setattr(pdf.Font, "_unicode_map", lambda self, data: read.append(1) or keep(self, data))
    pages = [[f"page {i} \u0431\u0443\u043a\u0432\u044b", "x" * 200] for i in range(7)]
    assert list(pdf.page_texts(writers.pdf(pages, plain=False))) == [("\n".join(p), None) for p in pages] and len(read) == 1
    for data in (b"", b"a", b"\0\0\0\0", b"\0" * 9, bytes(range(256)), b"\xff" * 7):
        assert pdf._from_ascii85(base64.a85encode(data)) == data and writers._ascii85(data) == base64.a85encode(data)
    for bad in (b"s8W-\"", b"v", b"uuuuu", b"abczd"):
        with pytest.raises(ValueError):
            pdf._from_ascii85(bad)
