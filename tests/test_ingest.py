"""Ingestion into stored tables: faults by file, languages, books that change or become empty, vectors by digest."""

import io
import zipfile

from foliant.operators import ingest, providers
from foliant.plans import registry
from foliant.sources import books as B


def counting(spark):
    """An embedder that counts the texts it is asked for, on all executors; its class goes to them by value."""

    counter = spark.sparkContext.accumulator(0)

    class Counting(providers.HashEmbedder):
        def __init__(self):
            super().__init__()
            self.asked = counter

        def embed(self, texts):
            self.asked.add(len(texts))
            return super().embed(texts)

    return Counting()


def epub(title, language, text):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="c.opf"/></rootfiles></container>')
        z.writestr(
            "c.opf",
            f"<package><metadata><title>{title}</title><language>{language}</language></metadata><manifest>"
            '<item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="c" href="cover.png" media-type="image/png"/>'
            '</manifest><spine><itemref idref="a"/></spine></package>',
        )
        z.writestr("a.xhtml", f"<html><body><p>{text}</p></body></html>")
        z.writestr("cover.png", b"picture")
    return held.getvalue()


def files(folder, **content):
    folder.mkdir(exist_ok=True)
    for name, data in content.items():
        (folder / name.replace("_", ".")).write_bytes(data if isinstance(data, bytes) else data.encode())
    return f"file://{folder}"


def test_a_broken_book_fails_alone(spark, tmp_path):
    path = files(tmp_path / "in", good_epub=epub("三国演义", "eng", "words of it"), bad_epub=b"PK no archive", cut_epub=epub("x", "", "y")[:200], plain_txt="some text")
    done = ingest.store(ingest.ingest(B.read_books(spark, path)), f"file://{tmp_path}/out")
    books = {r["path"].rsplit("/", 1)[1]: r for r in done.books.collect()}
    assert {n: r["status"] for n, r in books.items()} == {"good.epub": "ready", "bad.epub": "failed", "cut.epub": "failed", "plain.txt": "ready"}
    assert "BadZipFile" in books["bad.epub"]["error_msg"] and books["good.epub"]["error_msg"] == "" and books["bad.epub"]["n_chapters"] == 0
    assert bytes(books["good.epub"]["cover"]) == b"picture"
    assert books["good.epub"]["language"] in ("zho", "zha") and books["plain.txt"]["language"] == "eng"  # the title decides, not the file
    assert {r["content"] for r in done.chunks.collect()} == {"words of it", "some text"}


def test_a_book_that_is_now_empty_loses_all_parts(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    ingest.store(ingest.ingest(B.read_books(spark, files(tmp_path / "in", a_txt="first text", b_txt="other"))), out)
    done = ingest.store(ingest.ingest(B.read_books(spark, files(tmp_path / "in", a_txt="  ", b_txt="other"))), out)
    for name in ("chapters", "chunks", "vectors"):
        assert [r["content"] for r in getattr(done, name).collect()] == ["other"]
    assert done.books.count() == 2


def test_only_new_texts_are_embedded(spark, tmp_path):
    out, embedder = f"file://{tmp_path}/out", counting(spark)
    text = " ".join(f"word{k}" for k in range(400))
    run = lambda **f: ingest.store(ingest.ingest(B.read_books(spark, files(tmp_path / "in", **f)), embedder), out)
    first = run(a_txt=text, b_txt=text + " and more").chunks
    texts = {r["content"] for r in first.collect()}
    assert embedder.asked.value == len(texts) < first.count()
    run(a_txt=text)
    assert embedder.asked.value == len(texts)
    done = run(a_txt=text + " changed")
    now = {r["content"] for r in done.chunks.collect()}
    assert embedder.asked.value == len(texts | now) and len(now - texts) == 1
    want = {r["content"]: providers.HashEmbedder().embed([r["content"]])[0] for r in done.chunks.collect()}
    assert all(list(r["vector"]) == want[r["content"]] for r in done.vectors.collect()) and done.vectors.count() == done.chunks.count()
    assert ingest.drop_orphans(spark, out) == len(texts - now)
    run(b_txt=text + " and more")
    assert embedder.asked.value == len(texts | now)


def test_a_document_without_text_keeps_its_other_chapters(spark, tmp_path):
    texts = spark.createDataFrame([(7, None, "en", "src1"), (8, "a text", "en", "src1")], "doc_id long, text string, lang string, source string")
    texts.write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = registry.queries()["ingest_vectors"](spark, f"file://{tmp_path}").orderBy("book_id", "position").collect()
    got = {}
    for r in rows:
        got.setdefault(r["book_id"], []).append(r["content"])
    assert sorted(got.values()) == [["before", "a text", "notes on 8", "Index"], ["before", "notes on 7", "Index"]]
    empty = B.read_text(spark.createDataFrame([("/books/x.txt", None)], "path string, content binary"))
    assert [r["content"] for r in empty.collect()] == [""]
