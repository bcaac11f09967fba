"""Pages of files as partitions, and a cache that a stopped run goes on with."""

import textwrap

import pytest

from lodestone.operators import chunk
from lodestone.sources import pages


@pytest.fixture()
def book(tmp_path):
    """Ten thousand pages in three files, one of them long."""
    folder = tmp_path / "books"
    (folder / "sub").mkdir(parents=True)
    for name, n in (("a.txt", 9000), ("sub/b.txt", 990), ("c.txt", 10)):
        (folder / name).write_text("\f".join(f"{name} page {k}" for k in range(1, n + 1)) + "\f")
    (folder / "other.bin").write_bytes(b"\f\f")
    return folder


def engine(spark, tmp_path, name, body):
    """An engine in a module of its own, known to all workers."""
    (tmp_path / f"{name}.py").write_text("from lodestone.sources.pages import FormFeeds\n\n\n" + textwrap.dedent(body))
    spark.sparkContext.addPyFile(str(tmp_path / f"{name}.py"))
    return f"{name}:Engine"


def test_pages_are_dealt_in_ranges(spark, book):
    got = pages.scan(spark, f"file://{book}", pages_per_task="1000")
    assert got.rdd.getNumPartitions() == 9 + 1 + 1
    rows = {(r["path"].rsplit("/books/", 1)[1], r["page"]): r["text"] for r in got.collect()}
    assert len(rows) == 10_000 and rows["a.txt", 9000] == "a.txt page 9000" and rows["sub/b.txt", 1] == "sub/b.txt page 1"


def test_a_stop_in_the_middle(spark, book, tmp_path):
    cache, log = f"file://{tmp_path}/cache", tmp_path / "log"
    dies = engine(
        spark, tmp_path, "dies_in_the_middle",
        f"""
        import os


        class Engine(FormFeeds):
            def page(self, data, number):
                with open("{log}", "a") as f:
                    f.write("x")
                if os.path.getsize("{log}") > 4321 and not os.path.exists("{log}.mended"):
                    os._exit(1)
                return super().page(data, number)
        """,
    )
    with pytest.raises(Exception):
        pages.cached(spark, f"file://{book}", cache, dies, every=10, pages_per_task=500)
    kept = sum(map(len, pages.finished(cache).values()))
    assert 4321 - 4 * 10 <= kept <= 4321 + 4  # four tasks at a time lose fewer than ten pages each
    (tmp_path / "log.mended").write_text("")
    log.write_text("")
    got = pages.cached(spark, f"file://{book}", cache, dies, every=10, pages_per_task=500)
    assert got.count() == 10_000 and log.stat().st_size == 10_000 - kept
    log.write_text("")
    assert pages.cached(spark, f"file://{book}", cache, dies).count() == 10_000 and log.stat().st_size == 0


def test_faulty_pages_and_files_are_rows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("one\fbad\f\fthree")
    (folder / "b.txt").write_text("closed")
    name = engine(
        spark, tmp_path, "fails_on_some",
        """
        class Engine(FormFeeds):
            def count(self, data):
                if data == b"closed":
                    raise OSError("not to be opened")
                return super().count(data)

            def page(self, data, number):
                text = super().page(data, number)
                if text == "bad":
                    raise ValueError("cannot be read")
                return text
        """,
    )
    rows = [(r["path"][-5:], r["page"], r["text"], r["error"]) for r in pages.scan(spark, f"file://{folder}", name).collect()]
    assert sorted(rows, key=repr) == [("a.txt", 1, "one", None), ("a.txt", 2, "", "ValueError: cannot be read"), ("a.txt", 3, "", None), ("a.txt", 4, "three", None), ("b.txt", None, "", "OSError: not to be opened")]
    got = pages.cached(spark, f"file://{folder}", f"file://{tmp_path}/cache", name)
    assert {(r["page"], r["text"]) for r in got.collect()} == {(1, "one"), (3, ""), (4, "three")}
    assert [r["text"] for r in pages.documents(got).collect()] == ["[教材 P1]\none\n\n[教材 P4]\nthree"]
    assert [r["text"] for r in pages.documents(got, marks=False).collect()] == ["one\n\nthree"]
    parts = chunk.with_context(pages.documents(got).selectExpr("1 AS doc", "0 AS chunk_no", "'' AS anchor", "text"), "doc")
    assert parts.count() == 1


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert pages.scan(spark, f"file://{tmp_path}/none").collect() == []


def test_pdf_text_with_a_stand_in(monkeypatch):
    import sys
    import types

    opened = []

    class Page:
        def __init__(self, text):
            self.text = text

        def extract_text(self):
            return self.text

    def opens(stream):
        opened.append(stream.read())
        return types.SimpleNamespace(pages=[Page("one"), Page(None)])

    monkeypatch.setitem(sys.modules, "pdfplumber", types.SimpleNamespace(open=opens))
    pdf, data = pages.PdfText(), b"%PDF"
    assert (pdf.count(data), pdf.page(data, 1), pdf.page(data, 2)) == (2, "one", "") and opened == [b"%PDF"]
