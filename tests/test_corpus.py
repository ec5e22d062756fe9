from __future__ import annotations

import gzip
import io
import json
import tarfile

import pytest

from quirework.evaluate import corpus
from quirework.evaluate.__main__ import main
from quirework.plans.convert import write_files

from .test_pdf import build

PROSE = "the quick brown fox jumps over the lazy dog and then it rests in the shade of a tall tree until evening comes"


def archive(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, text in files.items():
            data = text.encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives_of_all_kinds():
    assert corpus.unpack(archive({"a.tex": "x", "b.bbl": "y", "c.png": "z"})) == {"a.tex": "x", "b.bbl": "y"}
    assert corpus.unpack(gzip.compress(b"one file")) == {"source.tex": "one file"} and corpus.unpack(b"plain") == {"source.tex": "plain"}
    p = corpus.paper_of({"m.tex": "\\begin{document}Hello \\input{s}\\end{document}", "s.tex": "there", "a.bbl": "\\bibitem{x}", "b.bbl": "\\bibitem{x}\\bibitem[L]{y} % \\bibitem{no}"})
    assert p["reference"] == "Hello there" and p["bibliography"].startswith("\\bibitem{x}\\bibitem[") and not p["scorable"]
    assert corpus.paper_of({})["reference"] == "" and corpus.paper_of({"s.tex": "no items"})["bibliography"] == ""


@pytest.fixture
def papers(tmp_path):
    (tmp_path / "pdfs").mkdir()
    (tmp_path / "sources").mkdir()
    words = (PROSE + " ") * 25
    lines = [words[k : k + 80] for k in range(0, len(words), 80)]
    page = b"BT /F1 14 Tf 72 740 Td (1 Introduction) Tj ET\n" + b"".join(b"BT /F1 8 Tf 72 %d Td (%s) Tj ET\n" % (715 - 10 * k, x.encode()) for k, x in enumerate(lines))
    (tmp_path / "pdfs" / "one.pdf").write_bytes(build([page]))
    (tmp_path / "pdfs" / "two.pdf").write_bytes(build([page]))
    (tmp_path / "sources" / "one.tar.gz").write_bytes(archive({"m.tex": f"\\begin{{document}}\\section{{Introduction}}{words}\\end{{document}}"}))
    (tmp_path / "sources" / "two.gz").write_bytes(gzip.compress(b"\\begin{document}Too little.\\end{document}"))
    return tmp_path


def test_reports_and_the_gate(spark, papers, capsys):
    assert main([str(papers / "pdfs"), str(papers / "sources"), "--json"], spark) == 0
    rows = json.loads(capsys.readouterr().out)
    assert set(rows) == {"one", "two"} and not rows["two"]["scorable"] and rows["two"]["bigram_recall"] is None
    one = rows["one"]
    assert one["bigram_recall"] > 0.9 and (one["sections"], one["sections_found"], one["references"], one["tables_found"]) == (1, 1, None, 0)
    (papers / "old.json").write_text(json.dumps({"one": one}))
    assert main([str(papers / "pdfs"), str(papers / "sources"), "--only", "one", "--baseline", str(papers / "old.json")], spark) == 0
    assert capsys.readouterr().out.splitlines()[0].split()[:2] == ["paper", "bigram_recall"]
    (papers / "old.json").write_text(json.dumps({"one": one | {"sections_found": 2}, "gone": one | {"paper": "gone"}}))
    assert main([str(papers / "pdfs"), str(papers / "sources"), "--baseline", str(papers / "old.json")], spark) == 1
    assert "regress: one sections_found" in (err := capsys.readouterr().err) and "missing: gone" in err
    assert main([str(papers / "pdfs"), str(papers / "sources"), "--only", "none"], spark) == 2


def test_a_file_for_each_document(spark, tmp_path):
    df = spark.createDataFrame([(1, "# One\n"), (2, None)], "doc_id long, rendered string")
    assert write_files(df, str(tmp_path / "out"), "typst") == 2
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir() if p.suffix == ".typ"} == {"1.typ": "# One\n", "2.typ": ""}
