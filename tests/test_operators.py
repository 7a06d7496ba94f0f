import sys

import pytest
from pyspark.sql import functions as F

from vellumix import errors, settings, shared
from vellumix.functions.dialect import SPARK
from vellumix.operators import documents, jobs, markdown, pages, spans, translate
from vellumix.plans import pipeline
from vellumix.sources import files
from vellumix.streaming import chunks as stream


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, page_number long, text string")


def book(spark):
    return pages_of(
        spark,
        [
            ("b", 1, "Big Book 1\nSpring 2024\n1 Introduction\nWe begin here\n\nPage 1"),
            ("b", 2, "Big Book 2\nmore of it\n2 Methods\nWe sum ∑n\ni = 1 now\nPage 2"),
            ("b", 3, "Big Book 3\nOnly Heading Here Now\nPage 3"),
            ("c", 1, ""),
        ],
    )


def test_headers_and_footers_go(spark):
    keys = {(r.side, r.key): r.n for r in pages.repeated_lines(book(spark)).collect()}
    assert keys[("top", "big book #")] == 3 and keys[("bottom", "page #")] == 3
    got = {(r.doc_id, r.page_number): r.text for r in pages.cleaned(book(spark)).collect()}
    assert got[("b", 2)] == "more of it\n2 Methods\nWe sum ∑n i = 1 now" and got[("c", 1)] == ""


def test_sections_and_images(spark):
    clean = pages.cleaned(book(spark))
    got = sorted((r.doc_id, r.section_index, r.heading, r.page_numbers, r.n_paragraphs) for r in pages.sections(clean).collect())
    assert got == [("b", 0, "1 Introduction", [1, 2], 2), ("b", 1, "2 Methods", [2], 1), ("c", 0, "正文", [], 0)]
    images = spark.createDataFrame([("b", 2, "x"), ("b", 3, "y"), ("c", 1, "z")], "doc_id string, page_number long, image_id string")
    assert sorted((r.image_id, r.section_index) for r in pages.image_sections(images, pages.sections(clean)).collect()) == [("x", 0), ("y", 1), ("z", 0)]


def test_front_matter_goes_on_the_first_page_only(spark):
    own = pages_of(spark, [("d", 3, "CS 70\n\nSpring 2024\n\nText"), ("d", 4, "CS 70\n\nmore"), ("e", 1, "Spring 2024")])
    assert sorted((r.page_number, r.text) for r in pages.units(own).collect()) == [(3, "Text"), (4, "CS 70"), (4, "more")]


def test_titles_and_ocr(spark):
    own = pages_of(spark, [("a", 2, "second"), ("a", 1, " \n  First line  "), ("b", 1, None)])
    assert {r.doc_id: r.title for r in pages.titles(own).collect()} == {"a": "First line", "b": "Translated Document"}
    asked = spark.sparkContext.accumulator(0)

    def recognize(doc, page, language):
        asked.add(1)
        return " " if page == 2 else f"{doc}{page}{language}"

    long = pages_of(spark, [("a", 1, "x" * 60), ("a", 2, "short"), ("a", 3, "")])
    got = {r.page_number: (r.raw_text, r.text, r.text_len, r.used_ocr) for r in pages.ocr_fallback(long, recognize).collect()}
    assert got == {1: ("x" * 60, "x" * 60, 60, False), 2: ("short", "short", 5, False), 3: ("", "a3eng", 5, True)}
    assert asked.value == 2


def test_translated_documents_keep_order_and_fall_back(spark):
    docs = spark.createDataFrame([(1, "# A\n\nsee https://e.x/p here\n\n# B\n\nx /∈ y"), (2, ""), (3, "`[a](b)`")], "doc_id long, text string")
    got = {r.doc_id: r for r in markdown.translated(docs, most=200).collect()}
    assert got[1].text == "[ZH] # A\n\nsee https://e.x/p here\n\n[ZH] # B\n\nx ∉ y" and got[1].n_chunks == 2
    assert got[2].text == "[ZH] " and got[3].text == "`[a](b)`"  # a token inside a fragment: raw text


def test_assets(spark):
    text = "![a](img/p.png) ![b](http://x/p.png) ![c](other/p.png) ![d]( img/p.png ) ![e](none.png) img/p.png ![f](x/p-1.png)"
    [r] = markdown.localized(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["img/p.png", "other/p.png", "x/p-1.png"]).collect()
    assert [(c.source, c.name) for c in r.copies] == [("img/p.png", "p.png"), ("other/p.png", "p-1.png"), ("x/p-1.png", "p-1-1.png")]
    assert r.text == "![a](assets/p.png) ![b](http://x/p.png) ![c](assets/p-1.png) ![d](assets/p.png) ![e](none.png) img/p.png ![f](assets/p-1-1.png)"


def test_formulas():
    kinds = lambda t: [(f.kind, f.text.strip()) for f in spans.formulas(t)]
    assert kinds("Then ∑n i=1 i2 = 6 holds") == [("sum_product", "∑n i=1 i2 = 6 holds")]
    assert kinds("the set {x | x > 0} ends") == [("set_builder", "{x | x > 0}")]
    assert kinds("{all even numbers | which are large numbers}") == []
    assert kinds("Let S = {1, 2} be") == [("set_literal", "S = {1, 2}")]
    assert kinds("A ∩ B = ∅") == [("union_intersection", "A ∩ B = ∅")]
    assert kinds("n = k") == [] and kinds("") == []


def test_protect_formulas_and_report_tokens(spark):
    df = spans.protected(spark.createDataFrame([("Let S = {1, 2} and A ∩ B = ∅ hold",)], "text string"))
    [r] = df.collect()
    assert r.protected == "Let [[MATH_0001]] and [[MATH_0002]] hold"
    lost = df.withColumn("answer", F.replace("protected", F.lit("[[MATH_0002]]"), F.lit("[[MATH_0009]]")))
    [r] = spans.restored(lost, "answer").collect()
    assert (r.missing, r.unexpected, r.restored) == (["[[MATH_0002]]"], ["[[MATH_0009]]"], "Let S = {1, 2} and [[MATH_0009]] hold")


def test_spans():
    assert spans.spans("Take $x$ and `code` now") == [("Take ", True), ("$x$", False), (" and ", True), ("`code`", False), (" now", True)]
    assert ("n = k + 1", False) in spans.spans("so n = k + 1 holds")
    assert spans.spans("non-zero") == [("non-zero", True)]
    assert spans.spans("") == [("", True)]
    long = "This is a sentence of some words. " * 12
    parts = spans.spans(long)
    assert len(parts) == 2 and all(len(t) <= 260 and ok for t, ok in parts)


def test_stable_layout(spark):
    df = spark.createDataFrame([("{a b | a, b integers}",), ("n2 + 1",), ("S = {1, 2} ok",)], "text string")
    assert [r.stable for r in spans.stable_layout(df).collect()] == ["{a/b | a, b integers}", "n^2 + 1", "S\xa0=\xa0{1, 2} ok"]


def test_lost_tokens_are_asked_for_again_then_given_up(spark):
    df = spark.createDataFrame([(i, "Let S = {1, 2} be.") for i in range(3)], "doc_id long, text string")
    lossy = lambda x: F.when(F.col("doc_id") == 0, x).otherwise(F.lit("lost"))
    again = lambda x: F.when(F.col("doc_id") == 1, F.lit("so [[MATH_0001]]")).otherwise(F.lit("lost"))
    got = {r.doc_id: (r.translated, r.outcome) for r in translate.keeping_formulas(df, lossy, again).collect()}
    assert got == {0: ("Let S = {1, 2} be.", "kept"), 1: ("so S = {1, 2}", "recovered"), 2: ("Let S = {1, 2} be.", "source")}


def test_cache(spark):
    df = translate.with_keys(spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "doc_id long, text string"), "m", "f")
    cache = df.where("doc_id = 1").select("key", F.lit("").alias("value"))
    assert sorted((r.doc_id, r.hit) for r in translate.cached(df, cache).collect()) == [(1, True), (2, False), (3, False), (4, False)]
    assert sorted(r.text for r in translate.misses(df, cache).collect()) == ["b", "c"]
    assert translate.fill_cache(df, cache, markdown.fake).count() == 3


def test_service_retries_and_gives_up(spark):
    calls = spark.sparkContext.accumulator(0)

    def call(text):
        calls.add(1)
        if text == "bad":
            raise ValueError("no")
        return text.upper()

    df = spark.createDataFrame([("ok",)], "t string")
    assert df.select(translate.service(call, 2, 0.0)(F.col("t")).alias("x")).first().x == "OK"
    with pytest.raises(Exception, match="no translation after 2 attempts"):
        spark.createDataFrame([("bad",)], "t string").select(translate.service(call, 2, 0.0)(F.col("t"))).collect()


def test_quality_rounds(spark):
    df = spark.createDataFrame([(1, "A long source text that has many words in it.", "one two three four five six seven eight nine"), (2, "Fine.", "好的"), (3, "Some text", "译文 left")], "doc_id long, source string, translated string")
    retry = lambda x: F.lit("译文很好")
    edit = lambda x: F.lit("译文")
    assert {r.doc_id: r.translated for r in translate.improved(df, retry, edit).collect()} == {1: "译文很好。", 2: "好的。", 3: "译文"}


def test_retries_keep_formulas(spark):
    source = "Let S = {1, 2} be a set of numbers and more words in here"
    df = spark.createDataFrame([(1, source, "one two three four five six seven eight nine")], "doc_id long, source string, translated string")
    said = lambda x: F.concat(F.lit("译文 "), F.regexp_extract(x, r"\[\[MATH_\d+\]\](?=[^\n]*$)", 0))
    assert translate.improved(df, said, said).first().translated == "译文 S = {1, 2}"


def test_job_state(spark):
    rows = [("a", 1, "queued", "queued", None, False), ("a", 2, "running", "input", None, False), ("a", 4, "succeeded", None, None, True), ("a", 3, "failed", "marker", "why", True), ("b", 1, "queued", "queued", None, False)]
    got = {r.job_id: tuple(r)[1:] for r in jobs.latest(spark.createDataFrame(rows, "job_id string, seq long, status string, stage string, error string, sets_error boolean")).collect()}
    assert got == {"a": ("succeeded", "marker", None, 4), "b": ("queued", "queued", None, 1)}


def test_errors_and_settings(spark):
    assert errors.exit_code(errors.OCRError()) == 4 and errors.exit_code(ValueError()) == 1
    own = settings.load(["export VELLUMIX_CHUNK_CHARS='300'", "# c", "VELLUMIX_FORCE_OCR=on"], {"VELLUMIX_CHUNK_CHARS": "250"})
    assert own.chunk_chars == 250 and own.force_ocr and own.web_port == 10001
    for lines, online in ((["VELLUMIX_WEB_PORT=1", "VELLUMIX_WEB_PORT=2"], False), (["VELLUMIX_WEB_PORT=x"], False), (["VELLUMIX_CHUNK_CHARS=10"], False), (["VELLUMIX_SYMBOL_FIX_MODE=bold"], False), (["VELLUMIX_FORCE_OCR=maybe"], False), ([], True)):
        with pytest.raises(errors.ConfigError):
            settings.load(lines, {}, online)


def test_pdf_pages_downloads_and_conversion(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-one")
    (tmp_path / "b.pdf").write_bytes(b"broken")
    (tmp_path / "x.txt").write_bytes(b"no")

    def parse(data):
        if not data.startswith(b"%PDF-"):
            raise ValueError("unreadable")
        return [("page one", [("png", b"1"), ("png", b""), ("jpg", lambda: b"3"), ("gif", lambda: 1 / 0)]), ("page two", [])]

    found = files.read_binary(spark, str(tmp_path))
    rows = sorted(files.pages(found, parse, max_pages=1).collect(), key=lambda r: r.doc_id)
    assert rows[0].text == "page one" and [i.image_id for i in rows[0].images] == ["p1_img0", "p1_img2"] and rows[1].error == "unreadable" and len(rows) == 2
    urls = spark.createDataFrame([("http://x/good.pdf",), ("http://x/page.pdf",)], "url string")

    def fetch(url):
        return ("application/pdf", b"%PDF-1") if "good" in url else ("text/html", b" <!DOCTYPE html>")

    got = {r.base_name: r for r in files.download(urls, fetch, 2, 0.0).collect()}
    assert got["good"].error is None and got["page"].error == "is an HTML page"

    def convert(data):
        if data == b"broken":
            raise RuntimeError("y" * 9000)
        return "# ok"

    out = sorted(files.convert(found, convert).collect(), key=lambda r: r.path)
    assert out[0].text == "# ok" and len(out[1].error) == 8000


def test_texts_and_files(spark, tmp_path):
    docs = spark.createDataFrame([("j1/x.zh.md", "# a\nb"), ("j2/x.zh.md", "c"), ("../y.zh.md", None)], "name string, text string")
    files.write_texts(docs, str(tmp_path / "table"))
    assert len(list((tmp_path / "table").glob("part-*"))) <= 8
    for _ in range(2):  # a second run replaces what the first wrote
        sizes = {r.name: r.size for r in files.export(spark.read.parquet(str(tmp_path / "table")), str(tmp_path / "out")).collect()}
    assert sizes == {"j1/x.zh.md": 5, "j2/x.zh.md": 1, "../y.zh.md": 0}
    found = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {"j1/x.zh.md": "# a\nb", "j2/x.zh.md": "c", "y.zh.md": ""}
    assert [r.text for r in files.read_markdown(spark, str(tmp_path / "out")).orderBy("text").collect() if r.text] == ["# a\nb", "c"]
    names = spark.createDataFrame([("/d/a.b.md",), ("x.pdf",), ("/d.e/none",), ("/d/.md",)], "path string")
    got = names.select(F.expr(files.output_name(SPARK, "path")).alias("o"), F.expr(files.stem(SPARK, "path")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("/d/a.b.zh.md", "a.b"), ("x.zh.md", "x"), ("/d.e/none.zh.md", "none"), ("/d/.md.zh.md", ".md")]


def test_assets_are_copied(spark, tmp_path):
    (tmp_path / "in" / "img").mkdir(parents=True)
    (tmp_path / "in" / "img" / "p.png").write_bytes(b"png")
    docs = spark.createDataFrame([(1, "![f](img/p.png) ![g](img/q.png)")], "doc_id long, text string")
    [r] = markdown.localized(docs, ["img/p.png", "img/gone.png"]).collect()
    assert r.text == "![f](assets/p.png) ![g](img/q.png)"
    copies = spark.createDataFrame([("img/p.png", "p.png"), ("img/gone.png", "gone.png")], "source string, name string")
    got = {r.source: r.error for r in files.export_assets(copies, str(tmp_path / "in"), str(tmp_path / "out" / "assets")).collect()}
    assert got["img/p.png"] is None and got["img/gone.png"] and (tmp_path / "out" / "assets" / "p.png").read_bytes() == b"png"


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, "# h\n\n" + "text\n\n" * i) for i in range(40)], "doc_id long, text string")
    docs.repartition(6).write.parquet(str(tmp_path / "in"))
    source = stream.documents_stream(spark, str(tmp_path / "in"), docs.schema, files_at_a_time=2)
    for _ in range(2):  # a second run finds nothing new
        stream.chunk_stream(spark, source, str(tmp_path / "out"), str(tmp_path / "cp"), 60)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = markdown.chunks(docs, 60)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_jobs_arrive_in_turn(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(3):
        (tmp_path / "in" / f"{n}.pdf").write_bytes(b"%PDF-")
    seen = []
    stream.job_stream(spark, str(tmp_path / "in"), lambda df, n: seen.append(df.count()), str(tmp_path / "cp"))
    assert seen == [1, 1, 1]


def exported(folder):
    return sorted((str(p.relative_to(folder)), p.read_text()) for p in folder.rglob("*.md"))


def test_whole_jobs(spark, tmp_path):
    rows = [("d/a.pdf", bytearray(b"%PDF-a")), ("b.pdf", bytearray(b"broken")), ("c.pdf", bytearray(b"%PDF-refused"))]

    def convert(data):
        if data == b"broken":
            raise ValueError("unreadable")
        return "# Title\n\nText " + data.decode()

    def call(text):
        if "refused" in text:
            raise OSError("no service")
        return f"[ZH] {text}"

    cheap = translate.service(call, 1, 0.0, errors=True)
    log = pipeline.translated_files(spark.createDataFrame(rows, "path string, content binary"), convert, cheap, str(tmp_path / "out"))
    got = sorted((r.status, r.stage, (r.error or "").split(":")[0]) for r in jobs.latest(log).collect())
    assert got == [("failed", "marker", "unreadable"), ("failed", "translate", "no translation after 1 attempts"), ("succeeded", "done", "")]
    [text] = spark.read.parquet(str(tmp_path / "out")).collect()
    assert text.name.endswith("/a.zh.md") and len(text.name.split("/")[0]) == 23 and text.text == "[ZH] # Title\n\nText %PDF-a"
    urls = spark.createDataFrame([("http://x/a.pdf",), ("ftp://x",), ("http://x/gone.pdf",)], "url string")

    def fetch(url):
        if "gone" in url:
            raise OSError("404")
        return "application/pdf", b"%PDF-a"

    log = pipeline.translated_urls(urls, fetch, convert, markdown.fake, str(tmp_path / "out2"), 1, 0.0)
    assert sorted((r.status, r.stage) for r in jobs.latest(log).collect()) == [("failed", "downloading"), ("failed", "downloading"), ("succeeded", "done")]


def test_answers_are_remembered(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def call(text):
        calls.add(1)
        if text == "bad":
            raise OSError("no")
        return text.upper()

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "bad")], "doc_id long, text string")
    for n in (3, 4):  # the failure is tried again, all else is known
        got = {r.doc_id: (r.answer, (r.error or "")[:14]) for r in translate.remembered(df, translate.service(call, 1, 0.0, errors=True), translate.Cache(str(tmp_path / "cache"), "m", "f")).collect()}
        assert got == {1: ("A", ""), 2: ("B", ""), 3: ("B", ""), 4: (None, "no translation")} and calls.value == n
    docs = spark.createDataFrame([(1, "# one\n\ntwo"), (2, "# one")], "doc_id long, text string")
    before = calls.value
    for _ in range(2):
        made = markdown.translated(docs, translate.service(call, 1, 0.0, errors=True), 5, cache=translate.Cache(str(tmp_path / "cache2")))
        assert {r.doc_id: (r.n_chunks, r.text, r.error) for r in made.collect()} == {1: (2, "# ONE\n\nTWO", None), 2: (1, "# ONE", None)}
        assert calls.value == before + 2


def test_document_model(spark):
    clean = pages.cleaned(book(spark))
    own = documents.model(clean, spark.createDataFrame([("c", "Given"), ("b", "")], "doc_id string, title string"))
    assert {r.doc_id: r.title for r in own.titles.collect()} == {"b": "1 Introduction", "c": "Given"}
    texts = {(r.doc_id, r.section_index, r.paragraph_index): r.text for r in documents.paragraph_texts(own.spans).collect()}
    units = pages.units(clean).where("type <> 'heading'").collect()
    assert sorted(t.removeprefix(documents.BULLET) for t in texts.values()) == sorted(r.text for r in units)
    said = documents.translated(own)
    assert {r.heading for r in said.sections.collect()} == {"[ZH] 1 Introduction", "[ZH] 2 Methods", "正文"}
    assert {r.doc_id: r.title for r in said.titles.collect()} == {"b": "1 Introduction", "c": "Given"}
    before, after = ({tuple(r[k] for k in documents.SPAN_KEYS): r for r in df.collect()} for df in (own.spans, said.spans))
    assert set(before) == set(after) and all((r.text != before[k].text) == bool(r.translatable and r.text.strip()) for k, r in after.items())
    counts = {r.doc_id: (r.n_translatable, r.n_passthrough) for r in documents.span_counts(own.spans).collect()}
    assert counts["b"][0] == sum(r.translatable for r in before.values()) and sum(counts["b"]) == len(before)
    dirty = documents.Model(own.titles.withColumn("title", F.lit("a\x07")), own.sections, own.spans)
    assert {r.doc_id: r.n_control for r in documents.control_counts(dirty).collect()} == {"b": 1, "c": 1}


def test_bullets_are_marked_and_blank_paragraphs_have_no_spans(spark):
    clean = pages_of(spark, [("d", 1, "Some text here.\n• first\n• second x = 1 + 2\nand more")])
    found = pages.paragraphs(pages.units(clean))
    own = documents.paragraphs(found, pages.outline(found))
    assert [r.text for r in own.orderBy("paragraph_index").collect()] == ["Some text here.", "• first", "• second x = 1 + 2 and more"]
    blank = own.withColumn("text", F.when(F.col("paragraph_index") == 0, "  ").otherwise(F.col("text")))
    assert {r.paragraph_index for r in documents.span_rows(blank).collect()} == {1, 2}


def test_submission_and_folders(spark, tmp_path):
    rows = spark.createDataFrame([("a.pdf",), ("b.pdf",)], "path string")
    own = jobs.with_ids(rows, short=True).cache()
    assert all(len(r.job_id) == 12 for r in own.collect()) and len({r.job_id for r in own.collect()}) == 2
    assert {(r.status, r.stage) for r in jobs.latest(pipeline.submitted(own)).collect()} == {("queued", "queued")}
    long = jobs.with_ids(rows).first().job_id
    assert len(long) == 23 and long[14] == "-" and long[:2] == "20"
    asked = spark.createDataFrame([("a",), ("b",)], "job_id string")
    known = spark.createDataFrame([("a", "/x/a")], "job_id string, folder string")
    assert {r.job_id: r.folder for r in jobs.with_folders(asked, known, "/jobs/").collect()} == {"a": "/x/a", "b": "/jobs/b"}


def test_ocr_errors_name_the_page(spark):
    own = pages_of(spark, [("a", 7, "few")])

    def recognize(doc, page, language):
        raise ValueError("no engine")

    with pytest.raises(Exception, match="OCR failed for page 7: no engine"):
        pages.ocr_fallback(own, recognize).collect()


def test_a_shared_folder_is_needed_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(errors.ConfigError):
        shared.shared_dir(Session())


def test_commands(spark, tmp_path, capsys, monkeypatch):
    from vellumix.__main__ import main

    none = ["--env", str(tmp_path / "none"), "--fake"]
    (tmp_path / "in" / "d").mkdir(parents=True)
    (tmp_path / "in" / "x.md").write_text("# a\n\nb")
    (tmp_path / "in" / "d" / "x.md").write_text("c")
    assert main(["translate-md", "--in", str(tmp_path / "in"), "--out", str(tmp_path / "out"), *none], spark) == 0
    assert exported(tmp_path / "out") == [("d/x.zh.md", "[ZH] c"), ("x.zh.md", "[ZH] # a\n\nb")]
    assert main(["translate-md", "--in", "x", "--out", "y", "--env", str(tmp_path / "none")], spark) == 2
    (tmp_path / "in" / "x.pdf").write_bytes(b"%PDF-")
    (tmp_path / "env").write_text("VELLUMIX_CONVERTER_COMMAND=/no/such/command\n")
    monkeypatch.setenv("VELLUMIX_JOBS_DIR", str(tmp_path / "jobs"))
    assert main(["run", "--in", str(tmp_path / "in"), "--out", str(tmp_path / "o"), "--env", str(tmp_path / "env"), "--fake"], spark) == 4
    assert [p.read_bytes() for p in (tmp_path / "jobs").glob("*/source/x.pdf")] == [b"%PDF-"]
    script = tmp_path / "convert"
    script.write_text(f"#!{sys.executable}\nimport pathlib, sys\nout = pathlib.Path(sys.argv[3])\nout.mkdir(parents=True)\n(out / 'x.md').write_text('# T')\n")
    script.chmod(0o755)
    (tmp_path / "env").write_text(f"VELLUMIX_CONVERTER_COMMAND={script}\n")
    for command in (["run"], ["serve", "--once"]):
        assert main([*command, "--in", str(tmp_path / "in"), "--out", str(tmp_path / command[0]), "--env", str(tmp_path / "env"), "--fake"], spark) == 0
        [(name, text)] = exported(tmp_path / command[0])
        assert name.endswith("/x.zh.md") and text == "[ZH] # T"
    with pytest.raises(SystemExit):
        main(["run", "--out", "x"], spark)


def test_manifests(spark, tmp_path):
    rows = [("a", "failed", "marker", "why"), ("b", "succeeded", "done", None)]
    own = spark.createDataFrame(rows, "job_id string, status string, stage string, error string")
    jobs.write_manifests(own, str(tmp_path / "jobs"))
    jobs.write_manifests(own.where("job_id = 'a'").withColumn("error", F.lit(None).cast("string")), str(tmp_path / "jobs"))
    got = sorted((r.job_id, r.status, r.error, r.source_url) for r in jobs.read_manifests(spark, str(tmp_path / "jobs")).collect())
    assert got == [("a", "failed", None, None), ("b", "succeeded", None, None)]
    asked, kept = spark.createDataFrame([("a",), ("z",)], "job_id string"), jobs.read_manifests(spark, str(tmp_path / "jobs"))
    assert {r.job_id: r.status for r in jobs.manifests_of(asked, kept).collect()} == {"a": "failed", "z": None}
    assert jobs.manifests_of(asked.where("job_id = 'a'"), kept, required=True).count() == 1
    with pytest.raises(errors.JobError):
        jobs.manifests_of(asked, kept, required=True)


def test_a_converter_command(tmp_path):
    import sys

    from vellumix.sources import services

    assert services.resolve_command("python3") and services.resolve_command("no-such-command") == "no-such-command"
    script = tmp_path / "convert"
    script.write_text(f"#!{sys.executable}\nimport pathlib, sys\nsource = pathlib.Path(sys.argv[1]).read_bytes()\nif source == b'bad': sys.exit('broken file')\nout = pathlib.Path(sys.argv[3]) / 'a'\nout.mkdir(parents=True)\n(out / 'x.md').write_text('# ' + source.decode())\n")
    script.chmod(0o755)
    convert = services.command_converter(str(script))
    assert convert(b"good") == "# good"
    with pytest.raises(errors.ConverterError, match="broken file"):
        convert(b"bad")


def test_a_chat_service(monkeypatch):
    import io
    import json

    from vellumix.sources import services

    asked = []

    def answer(request, timeout):
        asked.append((request.full_url, json.loads(request.data)["messages"][1]["content"]))
        return io.BytesIO(json.dumps({"choices": [{"message": {"content": "译文"}}]}).encode())

    monkeypatch.setattr(services.urllib.request, "urlopen", answer)
    own = settings.Settings(llm_api_key="k", llm_base_url="http://m/v1/", llm_model="m")
    assert services.chat(own)("text") == "译文" and asked == [("http://m/v1/chat/completions", "text")]
    assert services.translator(settings.Settings(), fake=True) is markdown.fake and services.translator(own)
    for build in (services.chat, services.translator):
        with pytest.raises(errors.ConfigError):
            build(settings.Settings())
