"""Scholarly search results as one paper schema, from landed JSON and XML; identity, noise filters, caches.

Network access is not part of the engine: pages are landed by whatever fetches them (see ``fetch``), and read here.
"""

from __future__ import annotations

import time
import xml.etree.ElementTree as ET
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import inverted_to_text

# What a works index lists that is no paper.
NOISE_DOI_PREFIXES = ("10.5860/choice.", "10.5860/crln.")
NOISE_VENUES = ("choice reviews", "library journal", "publishers weekly")
ACCEPTED_TYPES = ("journal-article", "book-chapter", "proceedings-article", "posted-content")

COLUMNS = ("paper_id", "title", "abstract", "authors", "year", "url", "doi", "s2_id", "arxiv_id", "venue", "is_peer_reviewed", "cited_by_count", "source")

OPENALEX = """id string, doi string, display_name string, publication_year int, cited_by_count int, abstract_inverted_index map<string, array<int>>,
  authorships array<struct<author: struct<display_name: string>>>, primary_location struct<source: struct<display_name: string, type: string>>, host_venue struct<display_name: string, type: string>"""
CROSSREF = """DOI string, URL string, type string, title array<string>, abstract string, author array<struct<given: string, family: string>>, `container-title` array<string>, `is-referenced-by-count` int,
  issued struct<`date-parts`: array<array<int>>>, `published-online` struct<`date-parts`: array<array<int>>>, `published-print` struct<`date-parts`: array<array<int>>>"""
SEMANTIC_SCHOLAR = """paperId string, title string, abstract string, year int, url string, authors array<struct<name: string>>, externalIds struct<DOI: string, ArXiv: string>, publicationVenue struct<name: string, type: string>"""


def stable_id(title: Column, doi: Column, s2_id: Column, arxiv_id: Column) -> Column:
    short = lambda c: F.substring(F.sha1(F.encode(F.lower(c), "UTF-8")), 1, 10)
    return (
        F.when(s2_id != "", F.concat(F.lit("s2_"), s2_id)).when(doi != "", F.concat(F.lit("doi_"), short(doi)))
        .when(arxiv_id != "", F.concat(F.lit("arxiv_"), F.replace(arxiv_id, F.lit("/"), F.lit("_")))).otherwise(F.concat(F.lit("title_"), short(title)))
    )


def is_noise(doi: Column, kind: Column, venue: Column) -> Column:
    """Book reviews, library guides and advertisements; a blank type passes."""
    starts = [F.lower(doi).startswith(p) for p in NOISE_DOI_PREFIXES]
    holds = [F.contains(F.lower(venue), F.lit(v)) for v in NOISE_VENUES]
    wrong = (F.coalesce(kind, F.lit("")) != "") & ~F.lower(kind).isin(*ACCEPTED_TYPES)
    out = wrong
    for test in starts + holds:
        out = out | F.coalesce(test, F.lit(False))
    return out


def _paper(df: DataFrame, **c: Column) -> DataFrame:
    empty = F.lit("")
    text = lambda name: F.coalesce(c.get(name, empty), empty)
    made = {
        "title": F.substring(text("title"), 1, 250), "abstract": F.substring(text("abstract"), 1, 2000), "authors": F.slice(F.filter(F.coalesce(c["authors"], F.array().cast("array<string>")), lambda a: F.coalesce(a, empty) != ""), 1, 10),
        "year": c["year"].cast("int"), "url": text("url"), "doi": text("doi"), "s2_id": text("s2_id"), "arxiv_id": text("arxiv_id"), "venue": F.substring(text("venue"), 1, 200),
        "is_peer_reviewed": c["is_peer_reviewed"].cast("boolean"), "cited_by_count": c.get("cited_by_count", F.lit(None)).cast("int"), "source": F.lit("discovered"),
    }
    out = df.select(*[v.alias(k) for k, v in made.items()]).where("title <> ''")
    return out.withColumn("paper_id", stable_id(F.col("title"), F.col("doi"), F.col("s2_id"), F.col("arxiv_id"))).select(*COLUMNS)


def openalex(landed: DataFrame, column: str = "json") -> DataFrame:
    w = landed.select(F.from_json(column, OPENALEX).alias("w")).select("w.*")
    url = F.coalesce("doi", F.lit(""))
    place = F.coalesce("primary_location.source", F.col("host_venue"))
    kind = F.lower(F.coalesce(place["type"], F.lit("")))
    return _paper(
        w, title=F.trim("display_name"), abstract=inverted_to_text(F.coalesce("abstract_inverted_index", F.create_map().cast("map<string, array<int>>"))), authors=F.transform(F.slice("authorships", 1, 10), lambda a: F.trim(a["author"]["display_name"])),
        year=F.col("publication_year"), url=F.when(url != "", url).otherwise(F.col("id")), doi=F.lower(F.replace(url, F.lit("https://doi.org/"), F.lit(""))), venue=F.trim(place["display_name"]),
        is_peer_reviewed=F.when(kind.isin("journal", "book", "conference"), True).when(kind.isin("repository", "preprint"), False), cited_by_count=F.col("cited_by_count"),
    )


def crossref(landed: DataFrame, column: str = "json") -> DataFrame:
    w = landed.select(F.from_json(column, CROSSREF).alias("w")).select("w.*")
    doi, venue, kind = F.lower(F.coalesce("DOI", F.lit(""))), F.get(F.col("`container-title`"), F.lit(0)), F.lower("type")
    w = w.where(~is_noise(doi, F.col("type"), F.coalesce(venue, F.lit(""))))
    year = F.coalesce(*[F.get(F.get(F.col(f"`{k}`")["date-parts"], F.lit(0)), F.lit(0)) for k in ("issued", "published-online", "published-print")])
    plain = F.trim(F.regexp_replace(F.regexp_replace("abstract", "<[^>]+>", ""), r"\s+", " "))
    return _paper(
        w, title=F.trim(F.get("title", F.lit(0))), abstract=plain, authors=F.transform(F.slice("author", 1, 10), lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))), year=year,
        url=F.when(F.coalesce("URL", F.lit("")) != "", F.col("URL")).when(doi != "", F.concat(F.lit("https://doi.org/"), doi)), doi=doi, venue=venue,
        is_peer_reviewed=F.when(kind.isin("journal-article", "book-chapter", "proceedings-article"), True).when(kind == "posted-content", False), cited_by_count=F.col("`is-referenced-by-count`"),
    )


def semantic_scholar(landed: DataFrame, column: str = "json") -> DataFrame:
    w = landed.select(F.from_json(column, SEMANTIC_SCHOLAR).alias("w")).select("w.*")
    arxiv, venue = F.col("externalIds.ArXiv"), F.col("publicationVenue.name")
    preprint = (F.coalesce(arxiv, F.lit("")) != "") & (F.coalesce(venue, F.lit("")) == "")
    url = F.when(F.coalesce("url", F.lit("")) != "", F.col("url")).when(F.coalesce(arxiv, F.lit("")) != "", F.concat(F.lit("https://arxiv.org/abs/"), arxiv))
    return _paper(
        w, title=F.trim("title"), abstract=F.col("abstract"), authors=F.transform("authors", lambda a: a["name"]), year=F.col("year"), url=url, doi=F.col("externalIds.DOI"), s2_id=F.col("paperId"), arxiv_id=arxiv, venue=venue,
        is_peer_reviewed=F.when(F.col("publicationVenue.type").isin("Journal", "Conference", "Book"), True).when(preprint, False),
    )


_ENTRY = pa.schema([("title", pa.string()), ("abstract", pa.string()), ("raw_id", pa.string()), ("authors", pa.list_(pa.string())), ("published", pa.string())])


def arxiv(landed: DataFrame, column: str = "xml") -> DataFrame:
    """Atom feeds, one a row; feeds that do not parse give no papers."""

    def entries(batches):
        atom = "{http://www.w3.org/2005/Atom}"
        for batch in batches:
            rows = []
            for feed in batch.column(0).to_pylist():
                try:
                    root = ET.fromstring(feed or "")
                except ET.ParseError:
                    continue
                for e in root.iter(f"{atom}entry"):
                    rows.append({k: (e.findtext(f"{atom}{tag}") or "").strip() for k, tag in (("title", "title"), ("abstract", "summary"), ("raw_id", "id"), ("published", "published"))} | {"authors": [n.text for n in e.iterfind(f"{atom}author/{atom}name")]})
            yield pa.RecordBatch.from_pylist(rows, schema=_ENTRY)

    w = landed.select(column).mapInArrow(entries, "title string, abstract string, raw_id string, authors array<string>, published string")
    number = F.regexp_replace(F.substring_index("raw_id", "/abs/", -1), r"v\d+$", "")
    return _paper(w, title=F.col("title"), abstract=F.col("abstract"), authors=F.col("authors"), year=F.substring("published", 1, 4).try_cast("int"), url=F.concat(F.lit("https://arxiv.org/abs/"), number), arxiv_id=number, venue=F.lit("arXiv"), is_peer_reviewed=F.lit(False))


def cache_key(namespace: str, payload: Column, version: str = "1") -> Column:
    """Content address of a request: the hash of version, namespace and canonical payload."""
    return F.sha2(F.concat_ws("|", F.lit(version), F.lit(namespace), payload), 256)


def first_known(*columns: Column) -> Column:
    """The first resolver's answer that is not null or empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def upgraded(papers: DataFrame, parsed: DataFrame) -> DataFrame:
    """Papers after their documents were parsed: ids and ratings stay, a DOI fills an empty one, longer titles and abstracts win."""
    p = parsed.select("paper_id", *[F.col(c).alias(f"_{c}") for c in ("title", "abstract", "doi")])
    longer = lambda c: F.when(F.length(F.col(f"_{c}")) > F.length(c), F.col(f"_{c}")).otherwise(F.col(c))
    df = papers.join(p, "paper_id", "left").withColumns({"title": longer("title"), "abstract": longer("abstract"), "doi": F.when((F.col("doi") == "") & F.col("_doi").isNotNull(), F.col("_doi")).otherwise(F.col("doi"))})
    return df.drop("_title", "_abstract", "_doi")


def fetch(get: Callable[[], tuple[int, str, dict]], tries: int = 4, wait: float = 1.0, longest: float = 20.0, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """A page by ``get()`` -> (status, body, headers), with exponential waits on 429 and 5xx, as long as Retry-After asks where it is given."""
    for i in range(tries):
        status, body, headers = get()
        if status == 200:
            return body
        if status != 429 and status < 500:
            return None
        asked = headers.get("Retry-After", "")
        if i + 1 < tries:
            sleep(min(longest, float(asked) if asked.replace(".", "", 1).isdigit() else wait * 2**i))
    return None
