"""DOCX files with citations turned into footnotes and a rewritten bibliography."""

from __future__ import annotations

import copy
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions.text import trimmed

# Names of the format.
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"
TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
FOOTNOTES_RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/footnotes"
FOOTNOTES_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.footnotes+xml"
SPACE = "{http://www.w3.org/XML/1998/namespace}space"


def _w(name: str) -> str:
    return f"{{{W}}}{name}"


def _read(data: bytes) -> ET.Element:
    """Parsed, with the file's own prefixes kept for writing."""
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(data), events=["start-ns"]):
        if not prefix.startswith("ns"):
            ET.register_namespace(prefix, uri)
    return ET.fromstring(data)


def _run(text: str | None = None, style: str | None = None, child: ET.Element | None = None) -> ET.Element:
    run = ET.Element(_w("r"))
    if style:
        ET.SubElement(ET.SubElement(run, _w("rPr")), _w("rStyle"), {_w("val"): style})
    if text is not None:
        ET.SubElement(run, _w("t"), {SPACE: "preserve"}).text = text
    if child is not None:
        run.append(child)
    return run


def _paragraph(*runs: ET.Element, style: str | None = None) -> ET.Element:
    p = ET.Element(_w("p"))
    if style:
        ET.SubElement(ET.SubElement(p, _w("pPr")), _w("pStyle"), {_w("val"): style})
    p.extend(runs)
    return p


def _rewrite(p: ET.Element, text: str, notes: list[tuple[int, int, int]]) -> None:
    """The paragraph's runs anew: its text with a footnote's mark in place of each (start, end, id)."""
    for child in list(p):
        if child.tag != _w("pPr"):
            p.remove(child)
    at = 0
    for start, end, number in notes:
        if start < at:  # of citations at one place the first stands for all
            continue
        if start > at:
            p.append(_run(text[at:start].rstrip() if text[at:start].endswith(" ") else text[at:start]))
        p.append(_run(style="FootnoteReference", child=ET.Element(_w("footnoteReference"), {_w("id"): str(number)})))
        at = end
    if at < len(text):
        p.append(_run(text[at:]))


def _empty_footnotes() -> ET.Element:
    root = ET.Element(_w("footnotes"))
    for number, name in (("-1", "separator"), ("0", "continuationSeparator")):
        note = ET.SubElement(root, _w("footnote"), {_w("id"): number, _w("type"): name})
        note.append(_paragraph(_run(child=ET.Element(_w(name)))))
    return root


def rewritten(content: bytes, notes: list[dict], heading: int | None, bibliography: list[str]) -> bytes:
    """The file with ``notes`` (para_idx, start, end, text) as footnotes, and ``bibliography`` after its heading."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    body = _read(parts["word/document.xml"])
    paragraphs = list(body.iter(_w("p")))
    footnotes = _read(parts["word/footnotes.xml"]) if "word/footnotes.xml" in parts else _empty_footnotes()
    number = max((int(n.get(_w("id"), "0")) for n in footnotes.iter(_w("footnote"))), default=0) + 1
    by_paragraph: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    for n in sorted(notes, key=lambda n: (n["para_idx"], n["start"])):
        if n["start"] < taken.get(n["para_idx"], 0):
            continue
        taken[n["para_idx"]] = n["end"]
        by_paragraph.setdefault(n["para_idx"], []).append((n["start"], n["end"], number))
        mark = _run(style="FootnoteReference", child=ET.Element(_w("footnoteRef")))
        ET.SubElement(footnotes, _w("footnote"), {_w("id"): str(number)}).append(_paragraph(mark, _run(f" {n['text']}"), style="FootnoteText"))
        number += 1
    from .files import _text

    for i, marks in by_paragraph.items():
        _rewrite(paragraphs[i], _text(paragraphs[i]), marks)
    root = body.find(_w("body"))
    if heading is not None and bibliography and root is not None and paragraphs[heading] in list(root):
        children = list(root)
        for child in children[children.index(paragraphs[heading]) + 1 :]:
            if child.tag != _w("sectPr"):
                root.remove(child)
        at = list(root).index(paragraphs[heading]) + 1
        for k, entry in enumerate(bibliography):
            root.insert(at + k, _paragraph(_run(entry)))
    parts["word/document.xml"] = ET.tostring(body, encoding="utf-8", xml_declaration=True)
    if by_paragraph:
        parts["word/footnotes.xml"] = ET.tostring(footnotes, encoding="utf-8", xml_declaration=True)
        parts["word/_rels/document.xml.rels"] = _related(parts.get("word/_rels/document.xml.rels"))
        parts["[Content_Types].xml"] = _typed(parts.get("[Content_Types].xml"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def _related(data: bytes | None) -> bytes:
    """Relations with one to the footnotes; its id follows the largest."""
    root = ET.fromstring(data) if data else ET.Element(f"{{{RELATIONS}}}Relationships")
    if all(r.get("Type") != FOOTNOTES_RELATION for r in root):
        used = [int(r.get("Id", "")[3:]) for r in root if r.get("Id", "")[:3] == "rId" and r.get("Id", "")[3:].isdigit()]
        ET.SubElement(root, f"{{{RELATIONS}}}Relationship", {"Id": f"rId{max(used, default=0) + 1}", "Type": FOOTNOTES_RELATION, "Target": "footnotes.xml"})
    return ET.tostring(root, encoding="utf-8", xml_declaration=True)


def _typed(data: bytes | None) -> bytes:
    root = ET.fromstring(data) if data else ET.Element(f"{{{TYPES}}}Types")
    if all(o.get("PartName") != "/word/footnotes.xml" for o in root):
        ET.SubElement(root, f"{{{TYPES}}}Override", {"PartName": "/word/footnotes.xml", "ContentType": FOOTNOTES_TYPE})
    return ET.tostring(copy.deepcopy(root), encoding="utf-8", xml_declaration=True)


def located(paragraphs: DataFrame) -> DataFrame:
    """(path, para_idx, start, end, display, keys) of citations in ``raw_text``: one for each pair of parentheses.

    Of several citations in one pair the first counts; of a narrative one, the parentheses around its year.
    """
    text = F.col("raw_text")
    groups = F.regexp_extract_all(text, F.lit(C.PARENTHETICAL), F.lit(0))
    gaps = F.split(text, C.PARENTHETICAL, -1)
    placed = F.transform(groups, lambda g, i: F.struct(g.alias("g"), (F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice(groups, 1, i), F.lit(0), lambda s, x: s + F.length(x))).alias("start")))
    inside = F.transform(placed, lambda p: F.struct(p["start"].alias("start"), (p["start"] + F.length(p["g"])).alias("end"), F.get(C.parenthetical(p["g"]), F.lit(0)).alias("c")))
    names, name_gaps = F.regexp_extract_all(text, F.lit(C.NARRATIVE), F.lit(0)), F.split(text, C.NARRATIVE, -1)
    ends = F.transform(names, lambda n, i: F.struct(n.alias("n"), (F.aggregate(F.slice(name_gaps, 1, i + 1), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice(names, 1, i + 1), F.lit(0), lambda s, x: s + F.length(x))).alias("end")))
    told = F.transform(ends, lambda e: F.struct((e["end"] - F.length(F.regexp_extract(e["n"], r"(\s*\([^()]*\))$", 1))).alias("start"), e["end"].alias("end"), F.get(C.narrative(e["n"]), F.lit(0)).alias("c")))
    found = paragraphs.select("path", "para_idx", F.explode(F.filter(F.concat(inside, told), lambda x: x["c"].isNotNull())).alias("x"))
    return found.select("path", "para_idx", "x.start", "x.end", "x.c.display", "x.c.keys")


def notes_of(cites: DataFrame, references: DataFrame) -> DataFrame:
    """(path, para_idx, start, end, text): the footnote of the first reference that owns one of a citation's keys.

    ``references`` has path, ref_idx, keys and footnote; a citation without a reference keeps its own words.
    """
    owner = references.select("path", F.explode("keys").alias("key"), "ref_idx", "footnote").groupBy("path", "key").agg(F.min_by("footnote", "ref_idx").alias("footnote"))
    ids = ["path", "para_idx", "start", "end"]
    hit = cites.select(*ids, F.posexplode("keys").alias("n", "key")).join(owner, ["path", "key"]).groupBy(*ids).agg(F.min_by("footnote", "n").alias("footnote"))
    return cites.join(hit, ids, "left").select(*ids, F.coalesce("footnote", F.when(trimmed(F.col("display")) != "", F.col("display")), F.lit(".")).alias("text"))


def converted(files: DataFrame, notes: DataFrame, bibliographies: DataFrame) -> DataFrame:
    """(path, content): each file rewritten, one file at a time within a task.

    ``notes`` as of :func:`notes_of`; ``bibliographies`` has path, heading (paragraph) and entries (in order).
    """
    per_file = notes.groupBy("path").agg(F.collect_list(F.struct("para_idx", "start", "end", "text")).alias("notes"))
    rows = files.select("path", "content").join(per_file, "path", "left").join(bibliographies, "path", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                heading = None if r.heading is None or r.heading != r.heading else int(r.heading)
                known = [] if r.notes is None else [n if isinstance(n, dict) else n.asDict() for n in r.notes]
                entries = [] if r.entries is None else list(r.entries)
                yield pd.DataFrame({"path": [r.path], "content": [rewritten(r.content, known, heading, entries)]})

    return rows.mapInPandas(run, "path string, content binary")
