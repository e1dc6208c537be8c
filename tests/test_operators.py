"""Rules of single operators on inline rows."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions.vectors import cosine
from foliant.operators import catalog, chunking, control, ingest, keywords, providers, qa, retrieval, summarize
from foliant.sources import books as B
from foliant.streaming import control as streams


def column(spark, values, make):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in frame.orderBy("i").select(make(F.col("t"))).collect()]


# Text ------------------------------------------------------------------------------------------


def test_whitespace_rules(spark):
    assert column(spark, ["a  \t\nb\n\n\n\nc \n", "　 x ", ""], T.clean_whitespace) == ["a\nb\n\nc", "x", ""]
    assert column(spark, ["Chapter 3 The End", None, "第 一　章"], T.clean_title) == ["Chapter3TheEnd", "", "第一章"]


def test_headings(spark):
    lines = ["第一章 绪论", "第一章绪论", "第12回", "chapter 3x", "　第一章 x", "Chapter 12: x", "a Chapter 1"]
    assert column(spark, lines, T.is_heading) == [True, False, True, False, True, True, False]


def test_title_languages(spark):
    titles = ["", "plain", "機器", "红楼梦", "ひらがな", "été"]
    assert column(spark, titles, T.title_language) == [None, None, "zha", "zho", "jpn", None]
    assert column(spark, ["eng", " ENG ", "zho", ""], T.language_bucket) == ["en", "en", "zh", "zh"]


def test_hash_embedding(spark):
    want = [0.4453125, -0.3984375, -0.6953125, 0.4453125, 0.1484375, -0.3984375, -0.515625, -0.9375]
    assert column(spark, ["hello world"], T.hash_embedding) == [want]
    assert providers.HashEmbedder().embed(["hello world"]) == [want]


def test_token_masks(spark):
    assert column(spark, ["secret-1234"], T.mask_token) == ["••••••••1234"]


# Chunks and chapters ---------------------------------------------------------------------------


def pieces(spark, text, size, overlap):
    frame = spark.createDataFrame([("b", text)], "book_id string, content string")
    return [r["content"] for r in chunking.document_chunks(frame, size, overlap).orderBy("position").collect()]


def test_chunks(spark):
    assert pieces(spark, "abcdefghijklmnopqrstuvwxyz", 10, 3) == ["abcdefghij", "hijklmnopq", "opqrstuvwx", "vwxyz"]
    assert pieces(spark, "abcdefghij", 10, 3) == ["abcdefghij", "hij"]
    assert pieces(spark, "ab    cdef", 4, 1) == ["ab", "c", "cdef", "f"]
    assert pieces(spark, "   ", 4, 1) == [] and pieces(spark, "", 4, 1) == [] and pieces(spark, None, 4, 1) == []
    assert pieces(spark, "abc", 2, 2) == ["ab", "bc", "c"]


def test_positions_run_through_a_book(spark):
    rows = [("b", "c1", 0, "abcdef"), ("b", "c2", 1, "  "), ("b", "c3", 2, "xyz"), ("d", "c4", 0, "q")]
    frame = spark.createDataFrame(rows, "book_id string, chapter_id string, sort_order int, content string")
    got = chunking.chunks(frame, 4, 0).orderBy("book_id", "position").collect()
    assert [(r["book_id"], r["position"], r["content"]) for r in got] == [("b", 0, "abcd"), ("b", 1, "ef"), ("b", 2, "xyz"), ("d", 0, "q")]


def test_segments():
    assert chunking.cuts("aaaaaaaa\nbbbbbb", 6, 10) == ["aaaaaaaa", "bbbbbb"]
    assert chunking.cuts("aaaaaaa. bbbbbb", 6, 10) == ["aaaaaaa.", "bbbbbb"]
    assert [len(s) for s in chunking.cuts("a" * 25, 6, 10)] == [10, 10, 5]
    assert chunking.cuts("a" * 10 + "\nb", 6, 10) == ["a" * 10, "b"]
    assert chunking.cuts("", 6, 10) == [] and chunking.cuts(" x ", 6, 10) == [" x "]


def test_chapters_of_both_forms(spark):
    text = "preface\n\nChapter 1 One\nfirst\nline\r\nIndex\nChapter 2\n \n第三章 末\nlast more"
    frame = spark.createDataFrame([("b", "My Book", text), ("c", "No Heads", " only text "), ("d", "Empty", "")], "book_id string, title string, content string")
    got = [(r["book_id"], r["sort_order"], r["title"], r["content"]) for r in chunking.chapters_of_text(frame).orderBy("book_id", "sort_order").collect()]
    assert got == [
        ("b", 0, "MyBook", "preface"),
        ("b", 1, "Chapter1One", "first\nline\nIndex"),
        ("b", 2, "第三章末", "last\nmore"),
        ("c", 0, "NoHeads", "only text"),
        ("d", 0, "Empty", ""),
    ]
    lines = frame.where("book_id = 'b'").select("book_id", "title", F.posexplode(F.split("content", "[\r\n ]+")).alias("line_no", "line"))
    split = chunking.chapters_of_lines(lines).orderBy("sort_order").collect()
    assert [(r["sort_order"], r["title"]) for r in split] == [(0, "MyBook"), (1, "Chapter1One"), (2, "第三章末")]


def test_back_matter_can_stay(spark):
    frame = spark.createDataFrame([("b", "Index", "x")], "book_id string, title string, content string")
    assert chunking.chapters_of_text(frame, skip_back_matter=False).first()["title"] == "Index"


# Books -----------------------------------------------------------------------------------------


def epub(toc=True, extra_item=""):
    out = io.BytesIO()
    z = zipfile.ZipFile(out, "w")
    z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
    nav = '<item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>' if toc else ""
    z.writestr(
        "O/c.opf",
        '<package xmlns="urn:o" xmlns:dc="urn:d"><metadata><dc:title>The Book</dc:title><dc:creator>A. Uthor</dc:creator>'
        '<dc:language>en</dc:language><meta name="cover" content="img"/></metadata><manifest>'
        f'{nav}{extra_item}<item id="h" href="half.xhtml" media-type="application/xhtml+xml"/>'
        '<item id="a" href="a%20b.xhtml" media-type="application/xhtml+xml"/>'
        '<item id="i" href="index.xhtml" media-type="application/xhtml+xml"/>'
        '<item id="img" href="c.jpg" media-type="image/jpeg"/></manifest>'
        '<spine><itemref idref="h"/><itemref idref="a"/><itemref idref="gone"/><itemref idref="i"/></spine></package>',
    )
    if toc:
        z.writestr("O/nav.xhtml", '<nav><ol><li><a href="a%20b.xhtml#x">First  Part</a></li><li><a href="a%20b.xhtml">Other</a></li><li><a href="index.xhtml">Index</a></li></ol></nav>')
    z.writestr("O/half.xhtml", "<html><body><h1>The Book</h1></body></html>")
    z.writestr("O/a b.xhtml", "<html><body><h1><b>H</b><b>1</b></h1><div>lost<p>x <b>y</b>\n z</p><aside><p>n</p></aside></div><pre>a  b</pre></body></html>")
    z.writestr("O/index.xhtml", "<html><body><p>entries</p></body></html>")
    z.writestr("O/c.jpg", b"JPG")
    z.close()
    return out.getvalue()


def test_epub():
    got = B.parse_epub(epub())
    assert (got["title"], got["author"], got["language"], got["cover"]) == ("The Book", "A. Uthor", "en", b"JPG")
    assert got["chapters"] == [("FirstPart", "H1\nx y z\na  b")]
    free = B.parse_epub(epub(toc=False))
    assert [t for t, _ in free["chapters"]] == ["TheBook", "H1", "TheBook"]


def test_epub_without_a_listed_file():
    gone = '<item id="gone" href="gone.xhtml" media-type="application/xhtml+xml"/>'
    assert B.parse_epub(epub(extra_item=gone)) == B.parse_epub(epub())


def test_block_text():
    assert B.block_text("<div>intro<p>x <b>y</b></p><aside><p>n</p></aside></div>") == "x y"
    assert B.block_text("<div>" * 3000 + "deep") == "deep"


def test_books_of_a_folder(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(epub())
    (tmp_path / "My Text.TXT").write_bytes(b"Chapter 1 A\nhello \xff\xfe world\nChapter 2 B\nbye")
    got = sorted((r["book_title"], r["title"], r["content"]) for r in B.read_books(spark, f"file://{tmp_path}").collect())
    assert got == [("My%20Text", "Chapter1A", "hello  world"), ("My%20Text", "Chapter2B", "bye"), ("The Book", "FirstPart", "H1\nx y z\na  b")] or [
        g[1:] for g in got
    ] == [("Chapter1A", "hello  world"), ("Chapter2B", "bye"), ("FirstPart", "H1\nx y z\na  b")]


def test_other_formats_are_refused(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    with pytest.raises(Exception, match="unsupported format"):
        B.files(spark, f"file://{tmp_path}").collect()


# Retrieval -------------------------------------------------------------------------------------


def test_cosine(spark):
    frame = spark.createDataFrame([([1.0, 0.0],), ([0.0, 1.0],), ([0.0, 0.0],)], "v array<float>")
    got = [r[0] for r in frame.select(cosine(F.col("v"), F.array(F.lit(0.9), F.lit(0.1)))).collect()]
    assert got == pytest.approx([0.993884, 0.110432, 0.0], abs=1e-6)


def records(spark):
    rows = [("a", "b1", "red apple"), ("b", "b1", "green pear"), ("c", "b2", "red red pear"), ("d", "b2", "blue"), ("e", "b2", "plum stone")]
    return spark.createDataFrame([(i, b, i, c) for i, b, c in rows], "id string, book_id string, chapter_id string, content string")


def test_fusion(spark):
    chunks = records(spark)
    score = lambda rows: spark.createDataFrame(rows, "id string, score double")
    both = retrieval.fuse(chunks, score([("a", 1.0), ("b", 0.5)]), score([("b", 0.5), ("c", 1.0)]), 10)
    assert {r["id"]: round(r["score"], 6) for r in both.collect()} == {"a": 0.6, "b": 0.5, "c": 0.4, "d": 0.0, "e": 0.0}
    alone = retrieval.fuse(chunks, None, score([("c", 1.0)]), 1, 0.5)
    assert [(r["id"], r["score"]) for r in alone.collect()] == [("c", 1.0)]
    assert retrieval.fuse(chunks, score([]), score([("c", 1.0)]), 1).first()["score"] == 1.0


def test_repeated_query_terms_count_again(spark):
    once = {r["id"]: r["raw"] for r in retrieval.bm25_scores(records(spark), "red").collect()}
    twice = {r["id"]: r["raw"] for r in retrieval.bm25_scores(records(spark), "red RED").collect()}
    assert twice == pytest.approx({k: 2 * v for k, v in once.items()})


def test_queries_without_hits(spark):
    chunks = records(spark)
    assert retrieval.relative(retrieval.bm25_scores(chunks, "zebra")).count() == 0
    assert retrieval.fulltext_scores(chunks, "red zebra").count() == 0 and retrieval.fulltext_scores(chunks, "").count() == 0
    assert [r["id"] for r in retrieval.fulltext_scores(chunks, "pear red").collect()] == ["c"]
    assert retrieval.search(chunks.limit(0), chunks.limit(0), "red", lambda q: 1 / 0).count() == 0


def test_context_and_citations(spark):
    hits = records(spark).withColumn("score", F.when(F.col("id") == "c", 0.9).otherwise(0.1)).where("id in ('a', 'c')")
    assert qa.context(hits).first()["context"] == "[1] red red pear\n\n[2] red apple"
    assert qa.context(hits.limit(0)).first()["context"] == qa.NO_CONTEXT
    assert len(qa.citations(hits.withColumn("content", F.repeat("content", 50))).first()["content"]) == 200


class Caller(providers.ExtractiveModel):
    def decide(self, messages, tools):
        return {"tool_calls": [{"name": "get_book_info", "arguments": '{"query": "nothing like it"}'}, {"name": "x", "arguments": {}}]}


def test_answers(spark):
    hits = records(spark).withColumn("score", F.lit(0.5))
    events = list(qa.answer([{"role": "user", "content": "what"}], lambda q: hits, providers.ExtractiveModel()))
    assert [e["type"] for e in events] == ["delta"] * 4 + ["citations"] and len(events[-1]["citations"]) == 5
    books = spark.createDataFrame([("1", "t", "a", "ready", "", 1)], "book_id string, title string, author string, status string, summary string, created_at long")
    chapters = spark.createDataFrame([("1", 0, "c", "s")], "book_id string, sort_order int, title string, summary string")
    tools = qa.library_tools(books, chapters)
    assert list(qa.answer([{"role": "user", "content": "q"}], lambda q: 1 / 0, Caller(), tools))[-1]["citations"] == []
    assert tools.run("get_library_stats", {}) == {"total": 1, "by_status": {"ready": 1}}
    assert "error" in tools.run("unknown", {}) and "error" in tools.run("get_book_info", {"query": "zzz"})
    assert providers.tool_arguments({"arguments": "bad json"}) == {} and providers.tool_arguments({"arguments": '{"a": 1}'}) == {"a": 1}


def test_stream_parsers(spark):
    sse = ['data: {"choices":[{"delta":{"content":"a"}}]}', "", ": ping", 'data: {"choices":[{"delta":{}}]}', "data: [DONE]", 'data: {"choices":[{"delta":{"content":"z"}}]}']
    frame = spark.createDataFrame([("s", i, x) for i, x in enumerate(sse)], "stream_id string, n int, line string")
    assert [r["content"] for r in providers.sse_deltas(frame).collect()] == ["a"]
    lines = ['{"message":{"content":"a"},"done":false}', '{"message":{"content":"b"},"done":true}', '{"message":{"content":"c"}}']
    frame = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "stream_id string, n int, line string")
    assert sorted(r["content"] for r in providers.ndjson_deltas(frame).collect()) == ["a", "b"]


# Keywords and summaries ------------------------------------------------------------------------


def test_lossy_merge():
    totals = keywords.merge_in_order({}, [("a", 3.0), ("b", 2.0), ("c", 1.0)], 2)
    assert keywords.merge_in_order(totals, [("c", 1.0), ("d", 2.0)], 2) == {"a": 3.0, "b": 2.0}


def test_terms_tie_by_first_place(spark):
    frame = spark.createDataFrame([(1, "Zeta alpha zeta the Alpha beta-x x"), (2, ""), (3, None)], "k int, text string")
    got = keywords.term_topk(frame, ["k"], 2).orderBy("rank").collect()
    assert [(r["term"], r["weight"]) for r in got] == [("zeta", 2.0), ("alpha", 2.0)]


def test_shown_keywords(spark):
    frame = spark.createDataFrame([("b", 1, "x", 1.0), ("b", 2, "y", 5.0), ("b", 3, "z", 1.0)], "book_id string, rank int, term string, weight double")
    assert [k["term"] for k in keywords.shown(frame, 2).first()["keywords"]] == ["y", "x"]
    assert len(keywords.shown(frame, 0).first()["keywords"]) == 3


def test_map_reduce_summaries(spark):
    long = "s" * 11_000 + ".\n" + "t" * 5_000
    rows = [("b", "c1", 0, "One", "short text", ""), ("b", "c2", 1, "", long, ""), ("b", "c3", 2, "Blank", "  ", ""), ("b", "c4", 3, "Kept", "text", "old")]
    frame = spark.createDataFrame(rows, "book_id string, chapter_id string, sort_order int, title string, content string, summary string")
    model = providers.ExtractiveModel(40)
    got = {r["chapter_id"]: r["summary"] for r in summarize.chapter_summaries(frame, model, "en").collect()}
    assert set(got) == {"c1", "c2", "c4"} and got["c1"].startswith("Summarize the chapter: One")
    assert got["c2"].startswith("Merge the summaries of the parts of")
    again = {r["chapter_id"]: r["summary"] for r in summarize.chapter_summaries(frame, model, "en", restart=False).collect()}
    assert again["c4"] == "old" and again["c1"] == got["c1"]
    prompt = summarize.book_prompts(summarize.chapter_summaries(frame, model, "en"), "en").first()["prompt"]
    assert "[1] One\n" in prompt and "[3] Kept\n" in prompt


# Catalog and control ---------------------------------------------------------------------------


def test_pages_fall_back_to_defaults(spark):
    frame = spark.range(100).withColumnRenamed("id", "n")
    assert catalog.Page(0, 500).of(frame, "n").count() == 20 and catalog.Page(5, 20).of(frame, "n").first()["n"] == 80


def test_retention(spark):
    frame = spark.createDataFrame([(f"s{i}", "u" if i < 5 else "v", i % 4) for i in range(8)], "session_id string, user_id string, updated_at int")
    assert {r["session_id"] for r in catalog.past_sessions(frame, 3).collect()} == {"s0", "s4"} and catalog.past_sessions(frame, 0).count() == 0


def test_token_validity(spark):
    rows = [("a", False, None), ("b", True, None), ("c", False, "2020-01-01 00:00:00"), ("d", False, "2999-01-01 00:00:00"), ("e", False, "never"), ("f", False, "")]
    frame = spark.createDataFrame(rows, "k string, is_revoked boolean, expires_at string")
    got = catalog.valid_tokens(frame, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert {r["k"] for r in got.collect()} == {"a", "d", "e", "f"}


def test_upsert_and_edit(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id int, v string, seq int")
    assert {(r["id"], r["v"]) for r in catalog.upsert(old, new).collect()} == {(1, "a"), (2, "y"), (3, "z")}
    books = spark.createDataFrame([("1", "t", "eng"), ("2", "u", "deu")], "book_id string, title string, language string")
    edits = spark.createDataFrame([("1", "new", " ")], "book_id string, title string, language string")
    assert {tuple(r) for r in catalog.edit_books(books, edits).collect()} == {("1", "new", "eng"), ("2", "u", "deu")}


def test_replacing_a_books_parts_leaves_others(spark, tmp_path):
    path = str(tmp_path / "chunks")
    catalog.replace_parts(spark.createDataFrame([("a", 1), ("b", 2)], "book_id string, v int"), path)
    catalog.replace_parts(spark.createDataFrame([("a", 5)], "book_id string, v int"), path)
    assert {(r["book_id"], r["v"]) for r in spark.read.parquet(path).collect()} == {("a", 5), ("b", 2)}


def test_replacing_a_book_by_no_rows(spark, tmp_path):
    path = str(tmp_path / "chunks")
    catalog.replace_parts(spark.createDataFrame([("a:1", 1), ("b", 2), ("c", 3)], "book_id string, v int"), path)
    catalog.replace_parts(spark.createDataFrame([("b", 7)], "book_id string, v int"), path, ["a:1", "b", "none"])
    assert {(r["book_id"], r["v"]) for r in spark.read.parquet(path).collect()} == {("b", 7), ("c", 3)}


def test_chinese_tokens_and_keywords(spark):
    rows = [(1, "我们研究机器学习，机器学习很好。Deep学习 2024年"), (2, "今天天气很好"), (3, None), (4, "书")]
    frame = spark.createDataFrame(rows, "id long, content string")
    got = {r["id"]: r["t"] for r in frame.select("id", T.tokens(F.col("content")).alias("t")).collect()}
    assert got[2] == ["今天", "天天", "天气", "气很", "很好"] and got[4] == ["书"] and got[3] == []
    assert got[1][-4:] == ["deep", "学习", "2024", "年"]
    hits = {r["id"] for r in retrieval.bm25_scores(frame.withColumn("book_id", F.lit("b")), "机器学习").where("raw > 0").collect()}
    assert hits == {1}
    top = keywords.term_topk(frame.select("id", F.col("content").alias("text")), ["id"], 3).where("id = 1").orderBy("rank").collect()
    assert {"机器", "学习"} <= {r["term"] for r in top}


def test_rolling_merge_in_order(spark):
    rows = [("b", 0, 0, 1, "x", 3.0), ("b", 0, 0, 2, "y", 1.0), ("b", 0, 1, 1, "z", 2.0), ("b", 1, 0, 1, "y", 2.0), ("b", 1, 0, 2, "w", 2.0), (None, 0, 0, 1, "q", 1.0)]
    frame = spark.createDataFrame(rows, "book_id string, sort_order int, segment_no int, rank int, term string, weight double").repartition(3)
    got = [tuple(r) for r in keywords.rolling_merge(frame, 2).orderBy("book_id", "rank").collect()]
    assert got == [(None, 1, "q", 1.0), ("b", 1, "x", 3.0), ("b", 2, "z", 2.0)]
    assert keywords.rolling_merge(frame.limit(0), 2).count() == 0


def test_a_chapter_of_three_segments_is_merged(spark):
    text = ("sentence of a long chapter. " * 1200)[:33_000]
    frame = spark.createDataFrame([("b", "c", 1, "t", text), ("b", "d", 2, "u", "short")], "book_id string, chapter_id string, sort_order int, title string, content string")
    got = {r["chapter_id"]: r["summary"] for r in summarize.chapter_summaries(frame, providers.ExtractiveModel(300), "en").collect()}
    assert got["d"].startswith("Summarize the chapter: u") and got["c"].startswith("Merge the summaries of the parts of t")
    assert "[1/3] Summarize part 1/3: t" in got["c"]


def test_users_tokens_and_covers(spark):
    tokens = spark.createDataFrame([("t1", "u", 1), ("t2", "u", 2), ("t3", "v", 3)], "token_id string, user_id string, created_at long")
    assert [r["token_id"] for r in catalog.list_tokens(tokens, "u").collect()] == ["t2", "t1"]
    users = spark.createDataFrame([("b", 2), ("a", 2), ("c", 1)], "user_id string, created_at long")
    assert [r["user_id"] for r in catalog.list_users(users, catalog.Page(1, 2)).collect()] == ["c", "a"]
    books = spark.createDataFrame([("1", "x.png"), ("2", " "), ("3", None)], "book_id string, cover_path string")
    assert [catalog.has_cover(books, b).first()[0] for b in ("1", "2", "3", "4")] == [True, False, False, False]


def test_last_admin(spark):
    frame = spark.createDataFrame([("1", "admin", "active"), ("2", "admin", "disabled"), ("3", "user", "active")], "user_id string, role string, status string")
    assert catalog.last_admin(frame, "1").first()[0] and not catalog.last_admin(frame, "3").first()[0]


def test_token_bucket(spark):
    times = [0.0] * 42 + [0.05, 0.05, 10.0]
    frame = spark.createDataFrame([("ip", i, t) for i, t in enumerate(times)], "client string, event_id long, ts double")
    got = {r["event_id"]: r["allowed"] for r in control.rate_limit(frame).collect()}
    assert [got[i] for i in range(45)] == [True] * 40 + [False] * 2 + [True, False, True]


def test_dispatch_cap(spark):
    rows = [("1", "ingest", "processing", 1, 1), ("2", "ingest", "pending", None, 3), ("3", "ingest", "pending", None, 2), ("4", "summarize", "pending", None, 0)]
    frame = spark.createDataFrame(rows, "task_id string, type string, status string, dispatched_at long, created_at long")
    assert [r["task_id"] for r in control.dispatch(frame, 2).collect()] == ["3"]
    assert control.dispatch(frame, 0).count() == 0
    assert [r["task_id"] for r in control.dispatch(frame.where("task_id != '1'"), 0).collect()] == ["3"]


def test_progress(spark):
    frame = spark.createDataFrame([(0, 3), (1, 3), (3, 3), (0, 0)], "d int, n int")
    got = frame.select(control.ingest_progress(F.col("d"), F.col("n")), control.summarize_progress(F.col("d"), F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(60, 5), (71, 31), (95, 85), (60, 5)]


def test_throttle(spark):
    frame = spark.createDataFrame([("t", float(t), i) for i, t in enumerate([0, 1, 2.9, 3, 5, 6.5])], "task_id string, ts double, seq long")
    assert sorted(r["seq"] for r in control.throttle(frame).collect()) == [0, 3, 5]


def test_ordered_folds_take_odd_rows(spark):
    rows = [("a", 2, None), ("a", 1, 0.0), (None, 3, 5.0), (None, 3, 5.0), ("b", 4, None), ("b", 5, None)]
    frame = spark.createDataFrame(rows, "client string, event_id long, ts double").repartition(3)
    got = sorted((r["client"] or "", r["event_id"], r["allowed"]) for r in control.rate_limit(frame, 1.0, 1.0).collect())
    assert got == [("", 3, False), ("", 3, True), ("a", 1, True), ("a", 2, False), ("b", 4, True), ("b", 5, False)]
    ticks = frame.selectExpr("client AS task_id", "event_id AS seq", "ts")
    assert sorted(r["seq"] for r in control.throttle(ticks).collect()) == [1, 3, 4]
    assert control.rate_limit(frame.limit(0)).count() == control.throttle(ticks.limit(0)).count() == 0


def test_bm25_stands_in_for_full_text(spark, monkeypatch):
    def fails(*_):
        raise RuntimeError("no index")

    frame = spark.createDataFrame([("1", "b", "red fox"), ("2", "b", "blue fox")], "id string, book_id string, content string")
    vectors = spark.createDataFrame([("1", "b", [1.0, 0.0])], "id string, book_id string, vector array<double>")
    want = retrieval.search(frame, vectors, "red", lambda q: [1.0, 0.0]).collect()
    monkeypatch.setattr(retrieval, "fulltext_scores", fails)
    assert retrieval.search(frame, vectors, "red", lambda q: [1.0, 0.0], fulltext=True).collect() == want


def test_stream_twins_equal_their_batches(spark, tmp_path):
    frame = spark.createDataFrame([("a", i, i * 0.3) for i in range(60)] + [("b", 100 + i, i * 50_000.0) for i in range(6)], "client string, event_id long, ts double")
    frame.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    got = streams.run_available(streams.rate_limit(stream, 5.0, 1.0), str(tmp_path / "s"), str(tmp_path / "o"))
    want = control.rate_limit(frame, 5.0, 1.0)
    assert sorted(map(tuple, got.select("client", "event_id", "allowed").collect())) == sorted(map(tuple, want.collect()))
    alive = streams.run_available(streams.sessions_alive(stream, 24), str(tmp_path / "s2"), str(tmp_path / "o2"))
    assert sorted((r["client"], r["opened_at"], r["n"]) for r in alive.collect()) == [("b", 0.0, 2), ("b", 100000.0, 2)]


def test_schemas_conform(spark, tmp_path):
    from foliant.sources import schemas

    old = spark.createDataFrame([("1", "t", 5)], "book_id string, title string, gone int")
    got = schemas.conform(old, "books")
    assert got.schema.simpleString() == schemas.TABLES["books"].simpleString()
    row = got.first()
    assert row["author"] == "" and row["tags"] == [] and row["created_at"] is None
    assert schemas.conform(spark.createDataFrame([("c",)], "chapter_id string"), "chapters").first()["level"] == 1
    old.write.parquet(str(tmp_path / "old"))
    found = schemas.migrate(spark, str(tmp_path / "old"), str(tmp_path / "new"), "books")
    assert found["extra"] == ["gone"] and "author" in found["missing"] and found["changed"] == []
    assert schemas.changes(spark.read.parquet(str(tmp_path / "new")).schema, "books") == {"missing": [], "extra": [], "changed": []}


def test_settings(tmp_path):
    from foliant.sources import config

    (tmp_path / "c.json").write_text('{"chunk_size": 300, "unknown": 1}')
    got = config.load(str(tmp_path / "c.json"), {"FOLIANT_SKIP_BACK_MATTER": "off", "FOLIANT_RATE_BURST": "7"})
    assert (got.chunk_size, got.skip_back_matter, got.rate_burst, got.chunk_overlap) == (300, False, 7.0, 50)
    assert config.load(None, {}) == config.Settings()


def test_small_catalog_rules(spark, tmp_path):
    users = spark.createDataFrame([("ann",)], "username string")
    assert catalog.taken(users, "ann").first()[0] and not catalog.taken(users, "bob").first()[0]
    assert column(spark, ['["a","b"]', "bad", None], catalog.parsed_tags) == [["a", "b"], [], []]
    catalog.audit_entry(users, str(tmp_path / "log"))
    catalog.audit_entry(users, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    tasks = spark.createDataFrame([("t", "b", "failed", 3, 1)], "task_id string, book_id string, status string, progress int, dispatched_at int")
    assert tuple(control.retry(tasks, ["t"]).select("status", "progress", "dispatched_at").first()) == ("pending", 0, None)
    books = spark.createDataFrame([("b", "pending"), ("c", "ready")], "book_id string, status string")
    done = spark.createDataFrame([("b", "ingest", "completed", 2), ("b", "ingest", "processing", 1), ("c", "summarize", "failed", 1)], "book_id string, type string, status string, created_at int")
    assert {tuple(r) for r in control.book_states(books, done).collect()} == {("b", "ready"), ("c", "ready")}


# Ingestion -------------------------------------------------------------------------------------


def test_ingest_from_files(spark, tmp_path):
    folder = tmp_path / "books"
    folder.mkdir()
    (folder / "one.txt").write_text("intro  \n\n\n\nmore\nChapter 1 First\n" + "abc " * 300 + "\nChapter 2\n \n", encoding="utf-8")
    (folder / "two.txt").write_text("only", encoding="utf-8")
    out = str(tmp_path / "out")
    done = ingest.store(ingest.ingest(B.read_books(spark, str(folder))), out)
    assert sorted((r.title, r.n_chapters) for r in done.books.collect()) == [("one", 2), ("two", 1)]
    whole = {r.content for r in done.chapters.collect()}
    assert whole == {"intro\n\nmore", ("abc " * 300).strip(), "only"}
    rows = done.chunks.collect()
    one = [r for r in rows if r.content != "only"]
    assert sorted(r.position for r in one) == list(range(len(one))) and len(one) == 4
    chapters, vectors = ingest.add_summaries(done, providers.ExtractiveModel(30), out, "en")
    assert chapters.count() == 3
    assert vectors.count() == len(rows) + 3 + 2
    assert vectors.where("position = -1 and size(vector) != 8").count() == 0

    (folder / "one.txt").write_text("short now", encoding="utf-8")  # a second run replaces a book's older parts
    done = ingest.store(ingest.ingest(B.read_books(spark, str(folder))), out)
    assert sorted(r.content for r in done.chunks.collect()) == ["only", "short now"]
    assert sorted(r.n_chapters for r in done.books.collect()) == [1, 1]


def test_chapters_of_long_book(spark):
    lines = ["pre"] + [x for i in range(300) for x in (f"Chapter {i} t", f"body {i}", "", f"end {i}")] + ["Chapter 300", "Chapter 301", "z"]
    book = spark.createDataFrame([("b", "Book", "\r\n".join(lines)), ("e", "Empty", None), ("h", "Heads", "Chapter 1\nChapter 2")], "book_id string, title string, content string")
    rows = chunking.chapters_of_text(book).orderBy("book_id", "sort_order").collect()
    got = [(r.title, r.content) for r in rows if r.book_id == "b"]
    want = [("Book", "pre")] + [(f"Chapter{i}t", f"body {i}\n\nend {i}") for i in range(300)] + [("Chapter301", "z")]
    assert got == want
    assert [(r.title, r.content) for r in rows if r.book_id == "h"] == [("Heads", "Chapter 1\nChapter 2")]
