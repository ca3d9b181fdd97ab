import io
import json
import zipfile

import pytest

from spanloom.operators import chunk
from spanloom.sources import files, store
from spanloom.streaming.incremental import mask_stream


def docx(body, pictures=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
        for name, data in pictures:
            z.writestr(f"word/media/{name}", data)
    return out.getvalue()


P = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"


def ocr(data):
    if data == b"bad":
        raise ValueError("broken")
    return [("下", 0.9, 0.1, 0.2), ("上", 0.3, 0.1, 0.9)]


def read_pdf(data):
    def fail():
        raise RuntimeError("render")

    yield 1, lambda: ("这一页有足够多的文字层内容可以直接采用不必识别", [], [0.1, 0.5] * 3, b"")
    yield 2, fail
    yield 3, lambda: ("短", [], [], b"img")
    yield 4, lambda: ("这一页有足够多的文字层内容可以直接采用不必识别", [50_000], [], b"img")


def test_convert_files(spark, tmp_path):
    case = tmp_path / "in" / "案"
    case.mkdir(parents=True)
    (case / "a.txt").write_text("张三", encoding="utf-8")
    (case / "b.DOCX").write_bytes(docx(P.format("甲") + f"<w:tbl><w:tr><w:tc>{P.format('乙')}</w:tc></w:tr></w:tbl>", [("2.png", b"bad"), ("1.png", b"ok")]))
    (case / "c.pdf").write_bytes(b"%PDF")
    (case / "d.xyz").write_bytes(b"x")
    (case / "e.docx").write_bytes(b"no zip")
    rows = {r.filename: r for r in files.read_case_files(spark, str(tmp_path / "in"), read_pdf, ocr).collect()}
    assert rows["a.txt"].text == "张三" and rows["a.txt"].case_id == "案"
    assert rows["b.DOCX"].text.startswith("甲\n乙") and "上\n下" in rows["b.DOCX"].text and rows["b.DOCX"].has_table
    assert [p.source for p in rows["b.DOCX"].pages] == ["ocr", "failed"]
    assert [p.source for p in rows["c.pdf"].pages] == ["text_layer", "failed", "ocr", "mixed"]
    assert rows["c.pdf"].pages[0].possible_table and rows["c.pdf"].pages[2].n_low == 1 and "=== 第 4 页(含OCR) ===" in rows["c.pdf"].text
    assert ".xyz" in rows["d.xyz"].skipped and rows["e.docx"].skipped and rows["e.docx"].text is None


def test_lexicon_and_truth_files(spark, tmp_path):
    (tmp_path / "l" / "c").mkdir(parents=True)
    (tmp_path / "l" / "c" / "list.txt").write_text("# 说明\n\n 张三 \n李四\n张三\n", encoding="utf-8")
    assert [(r.case_id, r.entry) for r in files.read_lexicon(spark, str(tmp_path / "l")).orderBy("ord").collect()] == [("c", "张三"), ("c", "李四"), ("c", "张三")]
    (tmp_path / "expected.json").write_text(json.dumps({"_note": {"identity": ["x"]}, "a.txt": {"identity": ["张三"], "standard": ["某地", "某司"]}}), encoding="utf-8")
    assert files.read_expected(spark, str(tmp_path / "expected.json")).count() == 3


class Keys(dict):
    def create(self, case_id):
        self[case_id] = b"k" * 32
        return self[case_id]

    def delete(self, case_id):
        self.pop(case_id, None)


def test_mapping_store(spark, tmp_path):
    path, keys = str(tmp_path / "m"), Keys()
    mapping = spark.createDataFrame([("c", "人名", 1, "⟦人名001⟧", "张三"), ("d", "人名", 1, "⟦人名001⟧", "李四")], "case_id string, label string, num int, token string, value string")
    assert store.load_mapping(spark, path, ["c"], keys).count() == 0
    store.save_mapping(mapping, path, keys)
    assert "张三" not in str(spark.read.parquet(path).collect())
    assert sorted(r.value for r in store.load_mapping(spark, path, ["c", "d"], keys).collect()) == ["张三", "李四"]
    keys.delete("c")
    with pytest.raises(KeyError):
        store.load_mapping(spark, path, ["c"], keys)


def test_stream_gives_one_token_across_batches(spark, tmp_path):
    schema = "case_id string, doc_id long, text string"
    for i, t in enumerate(["电话13812345678", "还是13812345678和13912345678"]):
        spark.createDataFrame([("c", i, t)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    lexicon = spark.createDataFrame([], "case_id string, ord long, entry string")
    names = spark.createDataFrame([("无", "PERSON")], "name string, entity_type string")
    mask_stream(docs, lexicon, lambda d: chunk.echo_entities(d, names), str(tmp_path / "map"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.doc_id: r.masked_text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    first = got[0].removeprefix("电话")
    assert first in got[1] and "1381" not in got[1] and "1391" not in got[1] and len(got) == 2


def test_workspace(spark, tmp_path):
    from spanloom.sources.workspace import Workspace

    w = Workspace(spark, str(tmp_path / "cases"))
    texts = lambda *rows: spark.createDataFrame([("案", *r) for r in rows], "case_id string, stem string, doc_id long, text string")
    assert w.exported().count() == 0
    w.save("candidate", texts(("a", 1, "old ⟦人名001⟧"), ("b", 2, "b"), ("c", 3, "still 张三"), ("a", 0, "pdf of the same stem")), 1)
    w.save("candidate", texts(("a", 1, "new ⟦人名001⟧")), 2)
    assert {(r.stem, r.text) for r in w.current("candidate").collect()} == {("a", "new ⟦人名001⟧"), ("b", "b"), ("c", "still 张三")}
    mapping = spark.createDataFrame([("案", "人名", 1, "⟦人名001⟧", "张三")], "case_id string, label string, num int, token string, value string")
    lexicon = spark.createDataFrame([("案", 0, "张三")], "case_id string, ord long, entry string")
    assert {(r.stem, r.approved, r.n_leaks) for r in w.approve(" 案 ", mapping, lexicon, 2).collect()} == {("a", True, 0), ("b", True, 0), ("c", False, 2)}
    assert {(r.stem, r.exported) for r in w.exported().collect()} == {("a", True), ("b", True), ("c", False)}
    w.save("candidate", texts(("a", 1, "张三 again")), 3)
    assert {r.stem: r.approved for r in w.approve("案", mapping, lexicon, 3).collect()} == {"a": False, "b": True, "c": False}
    assert {r.stem: r.text for r in w.current("approved").collect()} == {"a": "new ⟦人名001⟧", "b": "b"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "证 据+1.txt").write_bytes(b"x")
    w.import_raw(str(tmp_path / "in"), "案", 1)
    (tmp_path / "in" / "证 据+1.txt").write_bytes(b"y")
    w.import_raw(str(tmp_path / "in"), "案", 2)
    assert [(r.filename, bytes(r.content)) for r in w.current("raw").collect()] == [("证 据+1.txt", b"y")]
    with pytest.raises(ValueError):
        w.import_raw(str(tmp_path / "in"), "a/b", 1)
    with pytest.raises(ValueError):
        w.save("other", texts(("a", 1, "x")), 1)


def test_poppler_stages(spark, tmp_path):
    from spanloom.sources import poppler

    tsv = "\t".join("level page par block line word left top width height conf text".split()) + "\n" + "\n".join("\t".join(map(str, r)) for r in [(1, 1, 0, 0, 0, 0, 0, 0, 200, 300, -1, ""), *((5, 1, 0, 0, 0, 0, x, 1, 5, 5, 90, "w") for x in (20, 100) * 3), (5, 1, 0, 0, 0, 0, "?", 1, 5, 5, 90, "w"), (5, 1)])
    asked = []

    def run(command, seconds):
        asked.append((command[0], seconds))
        n = command[command.index("-f") + 1] if "-f" in command else ""
        if command[0] == "pdfinfo":
            return b"Title: Pages: 9\nPages:          3\n"
        if n == "2" and command[0] == "pdftoppm":
            raise RuntimeError("render")
        if command[0] == "pdftoppm":
            with open(command[-1] + ".png", "wb") as f:
                f.write(b"img")
            return b""
        if command[0] == "pdfimages":
            return b"page num type width height\n----\n   1 0 image 300 200 rgb\n" if n == "3" else b"page num type width height\n"
        return tsv.encode() if "-tsv" in command else "这一页有足够多的文字层内容可以直接采用不必识别".encode()

    (tmp_path / "案").mkdir()
    (tmp_path / "案" / "a.pdf").write_bytes(b"%PDF")
    pages = {n: read for n, read in poppler.pdf_reader(run)(b"%PDF")}
    assert list(pages) == [1, 2, 3]
    rows = [files.page_row(n, read, ocr) for n, read in poppler.pdf_reader(run)(b"%PDF")]
    assert [r["source"] for r in rows] == ["text_layer", "failed", "mixed"] and rows[0]["lefts"] == [0.1, 0.5] * 3
    assert ("pdftoppm", 120) in asked and ("pdftotext", 60) in asked
    with pytest.raises(ValueError):
        poppler.page_count("no count here")


def test_model_client():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from spanloom.sources.model import HttpModel

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            body = json.dumps({"response": '{"entities": [{"text": "张三", "type": "PERSON"}]}'}).encode()
            self.send_response(200 if len(seen) > 1 else 500)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        client = HttpModel(f"http://127.0.0.1:{server.server_port}/api/generate", seconds=5)
        assert chunk.detect_chunk("张三来了", client) == [(0, 2, "PERSON")]  # the first attempt meets an error
    finally:
        server.shutdown()
    assert seen[1]["options"] == {"temperature": 0} and seen[1]["format"] == "json" and seen[1]["stream"] is False and "张三来了" in seen[1]["prompt"]


def test_key_deletion(spark, tmp_path):
    from spanloom.sources.workspace import Workspace

    class Held(dict):
        def create(self, case):
            return self.setdefault(case, b"k" * 16)

        def delete(self, case):
            self.pop(case)

    keys = Held()
    mapping = spark.createDataFrame([("案", "人名", 1, "⟦人名001⟧", "张三")], "case_id string, label string, num int, token string, value string")
    store.save_mapping(mapping, str(tmp_path / "m"), keys)
    assert store.load_mapping(spark, str(tmp_path / "m"), ["案"], keys).count() == 1
    Workspace(spark, str(tmp_path)).forget("案", keys)
    with pytest.raises(KeyError):
        store.load_mapping(spark, str(tmp_path / "m"), ["案"], keys).count()
