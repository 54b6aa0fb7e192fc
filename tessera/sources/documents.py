"""Files of many formats to text: one row a file with its text, converter, hash, warnings and side rows.

The suffix chooses the converter. A converter that fails falls back to plain text, and undecodable bytes to a hex line, so
every file gives a row. Archives, messages and e-books are taken apart in memory, as one file is one row.
"""

from __future__ import annotations

import csv
import email
import email.policy
import hashlib
import html.parser
import io
import json
import posixpath
import re
import struct
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

ENCODINGS = ["utf-8-sig", "utf-8", "utf-16", "utf-16-le", "utf-16-be", "cp1252"]
#: Ligatures.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
#: Every byte of 128 and more as Windows-1252 shows it; the five it leaves open as they are.
_SHOWN = {(bytes([i]).decode("cp1252", "ignore") or chr(i)): i for i in range(128, 256)}
_GARBLED = re.compile("[" + "".join(map(re.escape, _SHOWN)) + "]{2,}")
_UNSAFE = {".exe", ".dll", ".bat", ".cmd", ".ps1", ".sh", ".com", ".msi", ".zip"}


def decode(raw: bytes) -> str:
    for name in ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            pass
    raise ValueError("no encoding fits")


def repair(text: str) -> str:
    """Runs of characters that are UTF-8 read as Windows-1252 (or Latin-1) put right, twice where that happened twice, and
    ligatures spelt out. A run that isn't UTF-8 in whole is mended from the left as far as it is."""

    def mend(m: re.Match) -> str:
        raw, out = bytes(_SHOWN[c] for c in m[0]), []
        while raw:
            n = next((k for k in (2, 3, 4) if k <= len(raw) and _utf8(raw[:k])), 1)
            out.append(_utf8(raw[:n]) or m[0][len(m[0]) - len(raw)])
            raw = raw[n:]
        return "".join(out)

    for _ in range(2):
        text = _GARBLED.sub(mend, text)
    return re.sub("[" + "".join(LIGATURES) + "]", lambda m: LIGATURES[m[0]], text)


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return ""


def cell(value: object) -> str:
    return " ".join(str("" if value is None else value).split())


def table_text(raw: bytes, suffix: str) -> str:
    text = decode(raw)
    comma = {".tsv": "\t", ".psv": "|"}.get(suffix)
    if comma is None:
        try:
            comma = csv.Sniffer().sniff(text[:8192]).delimiter
        except csv.Error:
            comma = ","
    return "\n".join(" | ".join(map(cell, row)) for row in csv.reader(io.StringIO(text), delimiter=comma))


def json_rows(value: object, path: str = "root"):
    """path | type | value of every leaf, in order."""
    children = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else None
    if children is None:
        yield f"{path} | {type(value).__name__} | {cell(value)}"
    elif not value:
        yield f"{path} | {'object' if isinstance(value, dict) else 'array'} | empty"
    else:
        for k, v in children:
            yield from json_rows(v, f"{path}.{str(k).replace(chr(10), ' ').strip()}")


def xml_texts(raw: bytes, tags: set[str] | None = None) -> list[str]:
    """Texts and tails in document order; with ``tags`` the whole text of just those elements."""
    root = ElementTree.fromstring(raw)
    local = lambda e: e.tag.rpartition("}")[2]
    found = ("".join(e.itertext()) for e in root.iter() if local(e) in tags) if tags else root.itertext()
    return [repair(cell(t)) for t in found if t.strip()]


class _Events(html.parser.HTMLParser):
    """Tags and texts of a page as a flat list."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[str, str, dict]] = []

    def handle_starttag(self, tag, attrs):
        self.events.append(("open", tag, {k: v for k, v in attrs if v}))

    def handle_endtag(self, tag):
        self.events.append(("close", tag, {}))

    def handle_data(self, data):
        self.events.append(("text", data, {}))


_LINE = set("br p div section article header footer h1 h2 h3 h4 h5 h6 li tr".split())


def html_lines(page: str) -> tuple[list[str], list[dict]]:
    """Visible lines (cells of a table row joined) and side rows: links, labels and image references."""
    parser = _Events()
    parser.feed(page)
    parser.close()
    lines: list[str] = []
    side: list[dict] = []
    words: list[str] = []
    row: list[str] | None = None
    hidden = 0

    def flush(into: list[str]) -> None:
        line = cell(" ".join(words))
        words.clear()
        if line or into is not lines:
            into.append(line)

    for kind, x, attrs in parser.events:
        if x in ("script", "style", "noscript") and kind != "text":
            hidden = hidden + 1 if kind == "open" else max(0, hidden - 1)
        elif kind == "text":
            if not hidden and x.strip():
                words.append(x.strip())
        else:
            side += [{"kind": k, "tag": x, "value": attrs[k]} for k in ("href", "alt", "title", "aria-label") if k in attrs]
            if kind == "open" and x == "img":
                side.append({"kind": "image", "tag": x, "value": attrs.get("src", "")})
            if x in ("td", "th"):
                if kind == "open":
                    words.clear() if row is not None else flush(lines)
                elif row is not None:
                    flush(row)
            elif x in _LINE and row is None:
                flush(lines)
            if x == "tr":
                if row and any(row):
                    lines.append(" | ".join(row))
                row = [] if kind == "open" else None
    flush(lines)
    return lines, side


def rtf_text(raw: bytes) -> str:
    text = re.sub(r"\\'[0-9a-fA-F]{2}", " ", decode(raw))
    return cell(re.sub(r"[{}]", " ", re.sub(r"\\[a-zA-Z]+-?\d* ?", " ", text)))


def _natural(name: str) -> list:
    return [int(p) if p.isdigit() else p for p in re.split(r"(\d+)", name)]


def _zip_xml(raw: bytes, pattern: str, tags: set[str]) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(pattern, n)), key=_natural)
        return [t for n in names for t in xml_texts(z.read(n), tags)]


def epub_text(raw: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        local = lambda e: e.tag.rpartition("}")[2]
        opf = next(e.attrib["full-path"] for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if local(e) == "rootfile")
        package = ElementTree.fromstring(z.read(opf))
        items = {e.attrib["id"]: e.attrib["href"] for e in package.iter() if local(e) == "item"}
        spine = [items[e.attrib["idref"]] for e in package.iter() if local(e) == "itemref" and e.attrib["idref"] in items]
        return "\n".join(line for href in spine for line in html_lines(decode(z.read(posixpath.join(posixpath.dirname(opf), href))))[0])


def mail_text(raw: bytes) -> str:
    m = email.message_from_bytes(raw, policy=email.policy.default)
    lines = [f"{h}: {cell(m[h])}" for h in ("From", "To", "Subject", "Date") if m[h]]
    for part in m.walk():
        if part.is_multipart():
            continue
        name = part.get_filename()
        if name:
            lines += [f"[{name}]", convert(name, part.get_payload(decode=True) or b"")["text"]]
        elif part.get_content_type() == "text/html":
            lines += html_lines(part.get_content())[0]
        elif part.get_content_maintype() == "text":
            lines.append(part.get_content().strip())
    return "\n".join(lines)


def archive_text(raw: bytes) -> str:
    lines = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for n in sorted((n for n in z.namelist() if not n.endswith("/")), key=str.casefold):
            blocked = posixpath.splitext(n)[1].lower() in _UNSAFE
            lines += [f"[{n}]", "blocked" if blocked else convert(n, z.read(n))["text"]]
    return "\n".join(lines)


def image_probe(raw: bytes) -> tuple[str, int, int] | None:
    """Format, width and height from an image's header."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return ("PNG", *struct.unpack(">II", raw[16:24]))
    if raw[:3] == b"GIF" and len(raw) >= 10:
        return ("GIF", *struct.unpack("<HH", raw[6:10]))
    if raw[:2] == b"BM" and len(raw) >= 26:
        w, h = struct.unpack("<ii", raw[18:26])
        return "BMP", w, abs(h)
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(raw) and raw[at] == 0xFF:
            if 0xC0 <= raw[at + 1] <= 0xCF and raw[at + 1] not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", raw[at + 5 : at + 9])
                return "JPEG", w, h
            at += 2 + struct.unpack(">H", raw[at + 2 : at + 4])[0]
    return None


def wav_probe(raw: bytes) -> tuple[int, int, float] | None:
    """Rate, channels and seconds of a WAV file."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE" or len(raw) < 44:
        return None
    channels, rate, per_second = struct.unpack("<HII", raw[22:32])
    return rate, channels, (len(raw) - 44) / per_second if per_second else 0.0


def _media(raw: bytes, kind: str) -> str:
    probe = image_probe(raw) if kind == "image" else wav_probe(raw) if kind == "audio" else None
    return " | ".join([kind, f"bytes={len(raw)}", f"sha256={hashlib.sha256(raw).hexdigest()}", *map(str, probe or ())])


_CONVERTERS = {
    **dict.fromkeys([".csv", ".tsv", ".psv"], ("delimited-table", table_text)),
    **dict.fromkeys([".json"], ("json-structure", lambda raw, s: "\n".join(json_rows(json.loads(decode(raw)))))),
    **dict.fromkeys([".html", ".htm", ".xhtml"], ("html-text", lambda raw, s: "\n".join(html_lines(decode(raw))[0]))),
    **dict.fromkeys([".xml", ".cnxml", ".svg"], ("xml-structure", lambda raw, s: "\n".join(xml_texts(raw)))),
    ".rtf": ("rtf-text", lambda raw, s: rtf_text(raw)),
    ".docx": ("docx-text", lambda raw, s: "\n".join(_zip_xml(raw, r"word/(?:document|header\d*|footer\d*|footnotes|comments)\.xml", {"p"}))),
    **dict.fromkeys([".xlsx", ".xlsm"], ("xlsx-tables", lambda raw, s: sheets_text(raw))),
    ".odt": ("odt-text", lambda raw, s: "\n".join(dict.fromkeys(_zip_xml(raw, r"content\.xml", {"p", "h"})))),
    ".pptx": ("pptx-text", lambda raw, s: "\n".join(_zip_xml(raw, r"ppt/(?:slides/slide|notesSlides/notesSlide)\d+\.xml", {"p"}))),
    ".epub": ("epub-spine", lambda raw, s: epub_text(raw)),
    ".eml": ("email-message", lambda raw, s: mail_text(raw)),
    ".zip": ("archive-zip", lambda raw, s: archive_text(raw)),
    **dict.fromkeys([".png", ".gif", ".bmp", ".jpg", ".jpeg"], ("image-metadata", lambda raw, s: _media(raw, "image"))),
    **dict.fromkeys([".wav", ".mp3", ".flac"], ("audio-manifest", lambda raw, s: _media(raw, "audio"))),
    **dict.fromkeys([".mp4", ".mkv", ".mov", ".avi"], ("video-manifest", lambda raw, s: _media(raw, "video"))),
}


def convert(name: str, raw: bytes) -> dict[str, str]:
    """text, converter and warning of a file's bytes."""
    suffix = posixpath.splitext(name)[1].lower()
    label, run = _CONVERTERS.get(suffix, ("plain-text", lambda raw, s: decode(raw)))
    warning = ""
    try:
        text = run(raw, suffix)
    except Exception as e:
        warning = f"{suffix or 'unknown'}: {e}"
        try:
            text, label = decode(raw), "plain-text-fallback"
        except ValueError:
            text, label = f"{suffix} | bytes={len(raw)} | {raw[:2048].hex()}", "binary-fallback"
    return {"text": re.sub("[─-╿]+", " ", text), "converter": label, "warning": warning}


def converted(files: DataFrame) -> DataFrame:
    """(path, content) -> source_id (hash of the bytes), source_name, text, converter, warning, size, a row a file."""

    def run(batches):
        for pdf in batches:
            rows = [{"source_id": hashlib.sha256(c).hexdigest(), "source_name": posixpath.basename(p), "size": len(c), **convert(p, c)} for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["source_id", "source_name", "text", "converter", "warning", "size"])

    return files.select("path", "content").mapInPandas(run, "source_id string, source_name string, text string, converter string, warning string, size long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The converted files under a path."""
    return converted(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def sheets_text(raw: bytes) -> str:
    """Rows of all sheets of a workbook in order, cells joined; blank rows are dropped."""
    local = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if local(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if local(si) == "si"]
        lines = []
        for name in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=_natural):
            for row in (e for e in ElementTree.fromstring(z.read(name)).iter() if local(e) == "row"):
                values = []
                for c in (e for e in row if local(e) == "c"):
                    own = "".join(t.text or "" for t in c.iter() if local(t) in ("v", "t"))
                    values.append(cell(shared[int(own)] if c.get("t") == "s" and own else own))
                if any(values):
                    lines.append(" | ".join(values))
    return "\n".join(lines)
