"""Reference lists, bibliographic coupling and citation edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.signals import edge_confidence
from quillgraph.functions.store import settled, small
from quillgraph.operators import layers

SOURCE_PRIORITY = ("crossref", "openalex", "s2")
#: Identifiers of papers up to which they are broadcast to the references, about 60 bytes each.
TARGET_ROWS = 300_000


def normalised_doi(doi: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(doi)), r"^https?://(dx\.)?doi\.org/", ""))


def namespace(source: Column, ref_id: Column) -> Column:
    """Which kind of identifier a reference is: by its source, else by its form."""
    src, rid = F.lower(F.trim(source)), F.lower(F.trim(ref_id))
    return (
        F.when(rid == "", F.lit(""))
        .when(src.startswith("crossref"), "doi")
        .when(src.startswith("openalex"), "openalex")
        .when(src.isin("s2", "semantic_scholar"), "s2")
        .when(rid.startswith("10.") | rid.contains("doi.org/"), "doi")
        .when(rid.rlike(r"^(https?://openalex\.org/)?w\d+$"), "openalex")
        .otherwise("s2")
    )


#: Papers of a block: of those that name a reference, two blocks meet in one task.
CHUNK_PAPERS = layers.BLOCK_PAPERS


def coupling(refs: DataFrame, again: bool = False) -> DataFrame:
    """(a, b, shared, weight), a < b, of papers that share references, block against block (``layers``): no pair is shuffled."""
    places = layers.numbered(refs.select(F.col("paper_id").alias("id")).distinct(), refs, CHUNK_PAPERS)
    return layers.pairs(places, refs, columns=("a", "b", "shared", "weight"), again=again)


def internal_targets(papers: DataFrame) -> DataFrame:
    """(ns, key, target): what each identifier names inside the corpus; the first paper wins."""
    keys = papers.select("paper_id", "ordinal", F.explode(F.array(F.struct(F.lit("doi").alias("ns"), normalised_doi(F.col("doi")).alias("key")), F.struct(F.lit("s2").alias("ns"), F.trim("s2_id").alias("key")))).alias("k"))
    keys = keys.select("paper_id", "ordinal", "k.*").where("key <> ''")
    return keys.groupBy("ns", "key").agg(F.min_by("paper_id", "ordinal").alias("target"))


def direct_citations(papers: DataFrame, refs: DataFrame) -> DataFrame:
    """(src, dst, evidence): the corpus papers that a paper's references name, with the number of sources that say so."""
    own = refs.join(papers.select("paper_id"), "paper_id", "left_semi")
    keyed = own.withColumn("ns", namespace(F.col("source"), F.col("ref_id"))).withColumn("key", F.when(F.col("ns") == "doi", normalised_doi(F.col("ref_id"))).otherwise(F.trim("ref_id")))
    named = keyed.join(small(internal_targets(papers), TARGET_ROWS), ["ns", "key"]).where("target <> paper_id")
    return named.groupBy(F.col("paper_id").alias("src"), F.col("target").alias("dst")).agg(F.count_distinct("source").alias("evidence"))


def direct_edges(papers: DataFrame, refs: DataFrame) -> DataFrame:
    """(src, dst, etype, weight, evidence, shared, confidence): direct citations."""
    confidence = F.least(F.lit(0.99), edge_confidence(_one("sa"), _one("sb"), F.lit(0.85)) + 0.03 * (F.col("evidence") - 1))
    ends = _with_sources(direct_citations(papers, refs), refs, "src", "dst")
    return ends.select("src", "dst", F.lit("citation").alias("etype"), F.lit(1.0).alias("weight"), "evidence", F.lit(None).cast("long").alias("shared"), F.round(confidence + 1e-9, 3).alias("confidence"))


def coupled_edges(pairs: DataFrame, refs: DataFrame) -> DataFrame:
    """The same columns for coupling both ways where no citation is direct; ``pairs``: (a, b, shared, weight, ab, ba) of ``layers.pairs``."""
    known = _with_sources(pairs.where("shared is not null and not ab and not ba").select("a", "b", "shared", F.round("weight", 4).alias("weight")), refs, "a", "b")
    confidence = F.round(edge_confidence(_one("sa"), _one("sb"), F.col("weight")) + 1e-9, 3)
    both = known.select(F.explode(both_directions("a", "b")).alias("e"), "shared", "weight", confidence.alias("confidence"))
    return both.select("e.*", F.lit("bib_coupling").alias("etype"), "weight", F.lit(None).cast("long").alias("evidence"), "shared", "confidence")


def citation_graph(papers: DataFrame, refs: DataFrame) -> DataFrame:
    """(src, dst, etype, weight, evidence, shared, confidence): direct citations, and coupling both ways where none is direct."""
    own = refs.join(papers.select("paper_id"), "paper_id", "left_semi")
    direct = direct_edges(papers, refs)
    pairs = layers.pairs(layers.numbered(papers.select(F.col("paper_id").alias("id")), own), own, direct=direct.select("src", "dst"), columns=("a", "b", "shared", "weight", "ab", "ba"))
    return direct.unionByName(coupled_edges(pairs, refs))


def both_directions(a: str, b: str) -> Column:
    return F.array(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")), F.struct(F.col(b).alias("src"), F.col(a).alias("dst")))


def _one(c: str) -> Column:
    return F.coalesce(c, F.lit(1))


def _with_sources(edges: DataFrame, refs: DataFrame, a: str, b: str) -> DataFrame:
    """The edges with the number of sources of each end, as sa and sb."""
    counts = small(settled(refs.groupBy("paper_id").agg(F.count_distinct("source").alias("n")), "source-counts"))
    return edges.join(counts.select(F.col("paper_id").alias(a), F.col("n").alias("sa")), a, "left").join(counts.select(F.col("paper_id").alias(b), F.col("n").alias("sb")), b, "left")


def first_source(refs: DataFrame) -> DataFrame:
    """(paper_id, source, n_refs): the reference list of the first source, in order of priority, that gave one."""
    order = F.array_position(F.array(*[F.lit(s) for s in SOURCE_PRIORITY]), F.col("source"))
    lists = refs.groupBy("paper_id", "source").agg(F.count_distinct("ref_id").alias("n_refs")).withColumn("priority", order)
    return lists.withColumn("rn", F.row_number().over(Window.partitionBy("paper_id").orderBy("priority"))).where("rn = 1").select("paper_id", "source", "n_refs")


def merged_references(refs: DataFrame) -> DataFrame:
    """(paper_id, n_sources, n_refs, n_multi): union over sources."""
    by_ref = refs.groupBy("paper_id", "ref_id").agg(F.count_distinct("source").alias("k"))
    sources = refs.groupBy("paper_id").agg(F.count_distinct("source").alias("n_sources"))
    merged = by_ref.groupBy("paper_id").agg(F.count("*").alias("n_refs"), F.sum((F.col("k") > 1).cast("long")).alias("n_multi"))
    return merged.join(sources, "paper_id")
