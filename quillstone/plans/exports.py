"""Exports as files: word-processor documents, PDF, and both documents of a run in one archive, without other packages."""

from __future__ import annotations

import io
import re
import textwrap
import zipfile
import zlib
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.plans import records

#: Media type and file ending of each format.
FORMATS = {
    "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".docx"), "pdf": ("application/pdf", ".pdf"),
    "txt": ("text/plain; charset=utf-8", ".txt"), "md": ("text/markdown; charset=utf-8", ".md"),
}
STEMS = {"summary": "summary", "pseudonymised": "pseudonymised-documents"}
FILE = "id string, filename string, media_type string, content binary, error string"

_CONTROLS = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
_STAMP = (1980, 1, 1, 0, 0, 0)
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
}
#: A page of PDF in points, its margin, the size and leading of the text, and of the title.
_WIDE, _HIGH, _MARGIN, _SIZE, _LEAD, _TITLE = 612, 792, 61, 10, 14, 18


def _blocks(body: str) -> list[str]:
    return [b for b in re.split(r"\n\s*\n", body.strip()) if b]


def _archive(files: dict[str, bytes]) -> bytes:
    """A zip archive whose bytes depend on the files alone."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(zipfile.ZipInfo(name, _STAMP), content, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def docx(title: str, body: str) -> bytes:
    """A title and a paragraph for each block of the body; line feeds inside a block are breaks."""
    run = lambda x, look="": f"<w:r>{look}" + "<w:br/>".join(f'<w:t xml:space="preserve">{escape(line)}</w:t>' for line in x.split("\n")) + "</w:r>"
    paragraphs = [run(title, '<w:rPr><w:b/><w:sz w:val="40"/></w:rPr>'), *map(run, _blocks(body))]
    text = "".join(f"<w:p>{p}</w:p>" for p in paragraphs)
    document = f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{text}</w:body></w:document>'
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    return _archive({n: (head + x).encode() for n, x in (_PARTS | {"word/document.xml": document}).items()})


def _wrapped(text: str, size: int) -> list[str]:
    """Lines that fit the page in a fixed-width face (0.6 of its size a character)."""
    most = int((_WIDE - 2 * _MARGIN) / (0.6 * size))
    return [part for line in text.split("\n") for part in textwrap.wrap(line, most, drop_whitespace=True) or [""]]


def pdf(title: str, body: str) -> bytes:
    """Pages of text in a built-in fixed-width face. Characters beyond Windows-1252 become question marks."""
    lines = [(x, _TITLE) for x in _wrapped(title, _TITLE)] + [(x, _SIZE) for b in _blocks(body) for x in ("", *_wrapped(b, _SIZE))]
    pages, room = [[]], _HIGH - 2 * _MARGIN
    for text, size in lines:
        lead = size + _LEAD - _SIZE
        if room < lead:
            pages.append([])
            room = _HIGH - 2 * _MARGIN
        room -= lead
        raw = text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
        pages[-1].append(b"/F %d Tf %d TL T* (%s) Tj" % (size, lead, raw))
    numbers = [4 + 2 * i for i in range(len(pages))]
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(pages), b" ".join(b"%d 0 R" % n for n in numbers)),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>",
    ]
    for n, page in zip(numbers, pages):
        stream = zlib.compress(b"BT %d %d Td\n%s\nET" % (_MARGIN, _HIGH - _MARGIN, b"\n".join(page)))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font << /F 3 0 R >> >> /Contents %d 0 R >>" % (_WIDE, _HIGH, n + 1))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(stream), stream))
    out, places = b"%PDF-1.4\n", []
    for i, x in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, x)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))


def rendered(title: str, body: str, form: str) -> bytes:
    """A document without the control characters that XML forbids."""
    body = _CONTROLS.sub("", body)
    if form in ("docx", "pdf"):
        return {"docx": docx, "pdf": pdf}[form](title, body)
    return f"{'# ' if form == 'md' else ''}{title}\n\n{body}\n".encode()


def export_files(rows: DataFrame, kind: str, form: str) -> DataFrame:
    """FILE of each record: its summary, its pseudonymised documents, or both in one archive. A record that lacks one has the reason in `error`.

    rows: as in records.export_parts. Each record is rendered where its row is; what is held is one batch of documents.
    """
    if form not in FORMATS:
        raise ValueError(f"choose one of {', '.join(FORMATS)}")
    kinds = list(STEMS) if kind == "both" else [kind]
    parts = None
    for i, k in enumerate(kinds):
        part = records.export_parts(rows, k).select("id", F.struct("title", "body", "error").alias(f"p{i}"))
        parts = part if parts is None else parts.join(part, "id")
    names = [STEMS[k] + FORMATS[form][1] for k in kinds]

    def put(found: list[dict]) -> tuple:
        error = next((x["error"] for x in found if x["error"]), None)
        if error:
            return None, None, None, error
        files = {n: rendered(x["title"], x["body"] or "", form) for n, x in zip(names, found, strict=True)}
        return (names[0], FORMATS[form][0], files[names[0]], None) if len(files) == 1 else ("documents.zip", "application/zip", _archive(files), None)

    @F.arrow_udf(T.StructType([T.StructField(n, T.BinaryType() if n == "content" else T.StringType()) for n in ("filename", "media_type", "content", "error")]))
    def made(found: pa.Array) -> pa.Array:
        kinds = (pa.string(), pa.string(), pa.binary(), pa.string())
        out = [put(x) for x in found.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["filename", "media_type", "content", "error"])

    return parts.select("id", made(F.array(*(f"p{i}" for i in range(len(kinds))))).alias("f")).select("id", "f.*")


def available(form: Column) -> Column:
    return form.isin(*FORMATS)
