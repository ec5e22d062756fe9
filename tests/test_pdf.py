from __future__ import annotations

import hashlib
import struct
import zlib

import pytest

from quirework.plans.convert import blocks_of_primitives, convert
from quirework.sources import pdf as P


def build(contents: list[bytes], fonts: bytes = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", extra: list[bytes] = (), page: bytes = b"", flate: bool = True, key: bytes | None = None, trailer: bytes = b"") -> bytes:
    """A file with one page for each content; object 3 is the font, those of ``extra`` follow the pages."""
    n = len(contents)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /MediaBox [0 0 612 792] /Kids [" + b" ".join(b"%d 0 R" % (4 + 2 * k) for k in range(n)) + b"] /Count %d >>" % n, fonts]
    for k, c in enumerate(contents):
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> /XObject << /X1 %d 0 R >> >> %s >>" % (5 + 2 * k, 4 + 2 * n, page))
        data = zlib.compress(c) if flate else c
        if key is not None:
            data = P._rc4(hashlib.md5(key + struct.pack("<I", 5 + 2 * k)[:3] + b"\0\0").digest()[: len(key) + 5], data)
        objects.append(b"<< /Length %d %s >>\nstream\n" % (len(data), b"/Filter /FlateDecode" if flate else b"") + data + b"\nendstream")
    out = b"%PDF-1.4\n"
    for k, o in enumerate([*objects, *extra], 1):
        out += b"%d 0 obj\n" % k + o + b"\nendobj\n"
    return out + b"trailer << /Root 1 0 R " + trailer + b" >>\n%%EOF"


def text(page: dict) -> str:
    return "".join(g["text"] for g in page["glyphs"])


def test_text_rules_and_places():
    [page] = P.read_pdf(build([b"BT /F1 10 Tf 72 700 Td (Hello \\(x\\)) Tj 0 -12 Td [(A) -500 (B)] TJ ET 72 600 300 0.5 re f 0 0 1 RG 2 w 10 10 m 10 400 l S 100 100 m 150 180 l 120 90 l f"]))
    assert (page["width"], page["height"]) == (612, 792) and text(page) == "Hello (x)AB"
    h, b = page["glyphs"][0], page["glyphs"][-1]
    assert (round(h["ox"]), round(h["oy"]), round(h["size"])) == (72, 92, 10) and h["font"] == "Helvetica"
    assert round(b["ox"] - page["glyphs"][-2]["ox"], 2) == round(6.67 + 5.0, 2) and round(b["oy"]) == 104
    assert [p["kind"] for p in page["paths"]] == ["hrule", "vrule", "other"]
    assert page["paths"][1]["color"] == 0x0000FFFF and round(page["paths"][1]["thickness"], 3) == 2.0
    assert round(page["paths"][0]["bbox"]["y0"], 1) == 191.5


@pytest.mark.parametrize(("turn", "size", "at"), [(0, (612, 792), (72, 92)), (90, (792, 612), (700, 72)), (180, (612, 792), (540, 700)), (270, (792, 612), (92, 540))])
def test_rotated_pages(turn, size, at):
    [page] = P.read_pdf(build([b"BT /F1 10 Tf 72 700 Td (x) Tj ET"], page=b"/Rotate %d" % turn))
    assert (page["width"], page["height"]) == size and (round(page["glyphs"][0]["ox"]), round(page["glyphs"][0]["oy"])) == at


def test_encodings_and_maps():
    simple = b"<< /Type /Font /Subtype /Type1 /BaseFont /ABCDEF+CMMI10 /FirstChar 11 /LastChar 12 /Widths [640 566] /Encoding << /Differences [11 /alpha /beta 100 /fi /eacute /uni2211] >> /FontDescriptor << /Flags 68 >> >>"
    [page] = P.read_pdf(build([b"BT /F1 10 Tf (\\013\\014def) Tj ET"], simple))
    assert text(page) == "αβﬁé∑" and page["glyphs"][0]["font"] == "CMMI10" and page["glyphs"][0]["flags"] == 9
    assert round(page["glyphs"][1]["ox"], 2) == 6.4
    cmap = b"1 beginbfchar <0001> <0041> endbfchar 2 beginbfrange <0002> <0004> <0062> <0010> <0011> [<00660066> <D835DC00>] endbfrange"
    wide = b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /ToUnicode 6 0 R /DescendantFonts [<< /DW 500 /W [1 [700 300] 3 4 250] >>] >>"
    [page] = P.read_pdf(build([b"BT /F1 10 Tf <00010002000400100011> Tj ET"], wide, [b"<< /Length %d >>\nstream\n" % len(cmap) + cmap + b"\nendstream"]))
    assert text(page) == "Abdff\U0001d400" and [round(g["ox"], 1) for g in page["glyphs"]] == [0.0, 7.0, 10.0, 12.5, 17.5]


def test_forms_images_and_states():
    form = b"BT /F1 5 Tf (in) Tj ET"
    x = b"<< /Type /XObject /Subtype /Form /Matrix [1 0 0 1 10 20] /Length %d >>\nstream\n" % len(form) + form + b"\nendstream"
    [page] = P.read_pdf(build([b"q 2 0 0 2 100 100 cm /X1 Do Q BT /F1 10 Tf 3 Tr (no) Tj ET BI /W 1 /H 1 ID x EI BT 0 Tr 1 0 0 1 5 5 Tm (z) Tj ET"], extra=[x]))
    assert text(page) == "inz" and (page["glyphs"][0]["ox"], page["glyphs"][0]["oy"], page["glyphs"][0]["size"]) == (120.0, 652.0, 10.0)
    assert len(page["images"]) == 1
    image = b"<< /Type /XObject /Subtype /Image /Width 30 /Height 20 /Length 0 >>\nstream\n\nendstream"
    [page] = P.read_pdf(build([b"q 300 0 0 200 50 60 cm /X1 Do Q"], extra=[image], flate=False))
    assert page["images"][0]["bbox"] == {"x0": 50.0, "y0": 532.0, "x1": 350.0, "y1": 732.0} and page["images"][0]["px_width"] == 30


def test_object_streams_and_predictors():
    inner = b"1 0 2 %d " % len(b"<< /Type /Catalog /Pages 2 0 R >> ")
    body = b"<< /Type /Catalog /Pages 2 0 R >> << /Type /Pages /MediaBox [0 0 100 100] /Kids [4 0 R] /Count 1 >>"
    rows = inner + body
    width = 10
    rows += b" " * (-len(rows) % width)
    filtered, above = b"", bytes(width)
    for k in range(0, len(rows), width):
        line = rows[k : k + width]
        filtered += b"\x02" + bytes((a - b) & 255 for a, b in zip(line, above, strict=True))
        above = line
    packed = zlib.compress(filtered)
    data = b"%PDF-1.5\n7 0 obj << /Type /ObjStm /N 2 /First " + str(len(inner)).encode() + b" /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 10 >> /Length " + str(len(packed)).encode() + b" >> stream\n" + packed + b"\nendstream endobj\n"
    data += b"4 0 obj << /Type /Page /Contents 5 0 R /Resources << /Font << /F1 3 0 R >> >> >> endobj 3 0 obj << /Type /Font /Subtype /Type1 /BaseFont /Courier-Bold >> endobj 5 0 obj << /Length 30 >> stream\nBT /F1 10 Tf (ab) Tj ET\nendstream endobj trailer << /Root 1 0 R >>"
    [page] = P.read_pdf(data)
    assert text(page) == "ab" and page["width"] == 100 and page["glyphs"][0]["flags"] & 256 and page["glyphs"][1]["ox"] == 6.0


def test_passwords():
    owner, ids = bytes(range(32)), b"0123456789abcdef"
    key = hashlib.md5((b"secret" + P._PAD)[:32] + owner + struct.pack("<i", -4) + ids).digest()[:5]
    trailer = b"/ID [<" + ids.hex().encode() + b"> <00>] /Encrypt << /Filter /Standard /V 1 /R 2 /O <" + owner.hex().encode() + b"> /U <" + P._rc4(key, P._PAD).hex().encode() + b"> /P -4 >>"
    data = build([b"BT /F1 10 Tf (hidden) Tj ET"], key=key, trailer=trailer)
    assert text(P.read_pdf(data, "secret")[0]) == "hidden"
    with pytest.raises(P.PdfError, match="password"):
        P.read_pdf(data)


def test_old_filters():
    assert P._lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


@pytest.mark.parametrize("data", [b"", b"garbage", b"%PDF-1.4", b"%PDF-1.4\n1 0 obj << /Type /Catalog", b"%PDF-1.4 1 0 obj << /Type /Catalog /Pages 1 0 R >> endobj trailer << /Root 1 0 R >>", b"%PDF-1.7" + bytes(range(256)) * 20, build([b"q q Q ( Tj [ (a) TJ 1 0 m l re f BT Tf Td ET <"])[:-40]])
def test_broken_files_give_errors_or_nothing(data):
    try:
        assert all(not p["glyphs"] for p in P.read_pdf(data))
    except P.PdfError:
        pass


def test_files_to_markdown(spark, tmp_path):
    lines = b"".join(b"BT /F1 %d Tf 72 %d Td (%s) Tj ET\n" % (s, y, t) for s, y, t in ((18, 700, b"A Study of Things"), (12, 660, b"1 Introduction"), (10, 640, b"The first words of it"), (10, 628, b"go on in a second line.")))
    (tmp_path / "good.pdf").write_bytes(build([lines]))
    (tmp_path / "bad.pdf").write_bytes(b"nothing")
    docs = P.read_pdfs(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: (r.error, r.n) for r in docs.selectExpr("path", "error", "size(pages) AS n").collect()} == {"good.pdf": (None, 1), "bad.pdf": ("no PDF file", 0)}
    [row] = convert(blocks_of_primitives(docs), "md").collect()
    assert row.rendered == "# A Study of Things\n\n## 1 Introduction\n\nThe first words of it go on in a second line.\n"
