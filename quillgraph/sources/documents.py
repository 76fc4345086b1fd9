"""Parsed documents: TEI XML from a structure parser, own notes, seed folders."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import LIGATURES, SECTION_RULES

_TEI = "{http://www.tei-c.org/ns/1.0}"
_ID = "{http://www.w3.org/XML/1998/namespace}id"
_KINDS = {name for name, _ in SECTION_RULES}
_NUMBER = re.compile(r"\s*(\d+(?:\.\d+)*|[IVXLCDM]+|\([a-z]\))(?=[\s.):]|$)\s*[.):]?\s*")
_DOI = re.compile(r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+")
SNIPPET = 600

TEI_SQL = """path string, title string, abstract string, doi string, sections array<struct<heading: string, text: string, section_type: string, number: string>>,
  figures array<struct<label: string, caption: string>>, tables array<struct<label: string, caption: string, text: string, rows: array<array<string>>>>, equations array<string>,
  refs array<struct<raw: string, title: string, doi: string, year: string, authors: array<string>, contexts: array<struct<section_type: string, section_heading: string, snippet: string>>>>"""


def plain(node: ET.Element | None) -> str:
    """All text below a node, ligatures spelled out."""
    if node is None:
        return ""
    text = " ".join(node.itertext()).strip()
    for old, new in LIGATURES:
        text = text.replace(old, new)
    return text


def section_kind(heading: str) -> str:
    m = _NUMBER.match(heading)
    low = heading[m.end() :].lower().strip() if m else heading.lower().strip()
    return next((name for name, words in SECTION_RULES if any(w in low for w in words)), "other") if heading else "other"


def _doi_of(node: ET.Element) -> str:
    named = [i.text.strip().lower() for i in node.iter(f"{_TEI}idno") if (i.get("type") or "").lower() == "doi" and i.text]
    if named:
        return named[0]
    m = _DOI.search(plain(node))
    return m.group().lower() if m else ""


def _label(figure: ET.Element, kind: str) -> str:
    head, number = plain(figure.find(f"{_TEI}head")), (figure.findtext(f"{_TEI}label") or "").strip()
    return head if not number or head.lower().startswith(("figure", "table")) else f"{kind} {number}: {head}".rstrip(": ")


def parse_tei(xml: str) -> dict:
    """Header, sections, figures, tables, equations, and references with the paragraphs that cite them."""
    root = ET.fromstring(xml)
    header = root.find(f"{_TEI}teiHeader")
    out: dict = {"title": "", "abstract": "", "doi": "", "sections": [], "figures": [], "tables": [], "equations": [t for f in root.iter(f"{_TEI}formula") if (t := plain(f))], "refs": []}
    if header is not None:
        out |= {"title": plain(header.find(f".//{_TEI}titleStmt/{_TEI}title"))[:300], "abstract": plain(header.find(f".//{_TEI}abstract")), "doi": _doi_of(header)}
    by_id: dict[str, dict] = {}
    for listed in root.iter(f"{_TEI}listBibl"):  # the header's own record is in no list
        for b in listed.iterfind(f"{_TEI}biblStruct"):
            title = b.find(f".//{_TEI}title[@type='main']")
            title_text = plain(title if title is not None else b.find(f".//{_TEI}title"))
            names = [" ".join(filter(None, (plain(n.find(f"{_TEI}forename")), plain(n.find(f"{_TEI}surname"))))) for n in b.iterfind(f".//{_TEI}author/{_TEI}persName")]
            names = [n for n in names if n]
            date = b.find(f".//{_TEI}date")
            year = ((date.get("when") or plain(date)) if date is not None else "")[:4]
            doi = _doi_of(b)
            if title_text or doi or names:
                ref = {"raw": f"{', '.join(names)} ({year}). {title_text}".strip(" ."), "title": title_text, "doi": doi, "year": year, "authors": names, "contexts": []}
                out["refs"].append(ref)
                if b.get(_ID):
                    by_id[b.get(_ID)] = ref
    body = root.find(f".//{_TEI}text/{_TEI}body")
    for div in body.iterfind(f"{_TEI}div") if body is not None else ():
        head = div.find(f"{_TEI}head")
        heading, paragraphs = plain(head), [(p, plain(p)) for p in div.iterfind(f"{_TEI}p")]
        m = _NUMBER.match(heading)
        number = (head.get("n") if head is not None else "") or (m.group(1).rstrip(".") if m and not m.group(1).startswith("(") else "")
        given = (div.get("type") or "").strip().lower()
        text = "\n\n".join(t for _, t in paragraphs if t).strip()
        if heading or text:
            out["sections"].append({"heading": heading, "text": text, "section_type": given if given in _KINDS else section_kind(heading), "number": number})
        for p, t in paragraphs:
            snippet = t if len(t) <= SNIPPET else t[:SNIPPET].rsplit(" ", 1)[0] + "…"
            for r in p.iter(f"{_TEI}ref"):
                if r.get("type") == "bibr" and (ref := by_id.get((r.get("target") or "").lstrip("#"))):
                    ref["contexts"].append({"section_type": section_kind(heading), "section_heading": heading, "snippet": snippet})
    for f in root.iter(f"{_TEI}figure"):
        caption = plain(f.find(f"{_TEI}figDesc"))
        if f.get("type") == "table":
            rows = [[plain(c) for c in r.iterfind(f"{_TEI}cell")] for r in f.iterfind(f"{_TEI}table/{_TEI}row")]
            out["tables"].append({"label": _label(f, "Table"), "caption": caption, "text": " | ".join(c for r in rows for c in r if c), "rows": rows})
        else:
            out["figures"].append({"label": _label(f, "Figure"), "caption": caption})
    return out


def tei(landed: DataFrame) -> DataFrame:
    """(path, xml) to parsed documents; files that do not parse are left out."""
    schema = landed.sparkSession.createDataFrame([], TEI_SQL).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = []
            for path, xml in zip(batch.column("path").to_pylist(), batch.column("xml").to_pylist(), strict=True):
                try:
                    rows.append({"path": path} | parse_tei(xml or ""))
                except ET.ParseError:
                    continue
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return landed.select("path", "xml").mapInArrow(run, schema)


def tei_files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(folder)
    return tei(files.select("path", F.decode("content", "UTF-8").alias("xml")))


def seed_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of the PDF files in a folder, not below it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "length", "content")


def local_references(parsed: DataFrame) -> DataFrame:
    """(path, position, title, doi, year, authors, n_contexts) a reference."""
    return parsed.select("path", F.posexplode("refs").alias("position", "r")).select("path", "position", "r.title", "r.doi", "r.year", "r.authors", F.size("r.contexts").alias("n_contexts"))


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """Own texts (.txt, .md): (path, title, text), the title from the first heading, else from the file's name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md}").load(folder)
    text = F.decode("content", "UTF-8")
    heading = F.regexp_extract(text, r"(?m)^#\s+(.+?)\s*$", 1)
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    return files.select("path", F.when(heading != "", heading).otherwise(stem).alias("title"), text.alias("text"))


def markdown_sections(texts: DataFrame) -> DataFrame:
    """(path, section_type, text): a note's paragraphs by the kind of the heading above them, in order."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = re.sub(r"(?m)^(.+)\n(?:=+|-{3,})[ \t]*$", r"# \1", text or "")
                kinds: dict[str, list[str]] = {}
                kind = "other"
                for part in re.split(r"(?m)^(#{1,6}[ \t]+.+)$", text):
                    if re.match(r"#{1,6}[ \t]+", part):
                        kind = section_kind(part.lstrip("# \t"))
                    elif part.strip():
                        kinds.setdefault(kind, []).append(part.strip())
                rows += [{"path": path, "section_type": k, "text": "\n\n".join(v)} for k, v in kinds.items()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, pa.string()) for c in ("path", "section_type", "text")]))

    return texts.select("path", "text").mapInArrow(run, "path string, section_type string, text string")
