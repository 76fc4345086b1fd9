"""One library object over a corpus: what a user asks, as DataFrames. No state is changed; every call takes its inputs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.config import Settings
from quillgraph.functions.vectors import mean_pool
from quillgraph.operators import causal, fusion, hierarchy, ranking, reasoning, scoring
from quillgraph.operators import graph as G
from quillgraph.operators.citations import citation_graph
from quillgraph.operators.similarity import similar_pairs


@dataclass
class Library:
    """``papers``: the corpus with weights and vectors; ``refs``: (paper_id, source, ref_id); the rest is derived."""

    papers: DataFrame
    refs: DataFrame
    settings: Settings = field(default_factory=Settings)

    def semantic_layer(self) -> DataFrame:
        pairs = similar_pairs(self.papers.select(F.col("paper_id").alias("id"), "embedding"), self.settings.similarity_threshold)
        return G.both_ways(pairs)

    def citation_layer(self) -> DataFrame:
        return citation_graph(self.papers, self.refs)

    def combined_layer(self) -> DataFrame:
        return G.overlay(self.semantic_layer().withColumn("etype", F.lit("semantic")), self.citation_layer().select("src", "dst", "weight", "etype"))

    def fused_layer(self) -> DataFrame:
        s = self.settings
        return fusion.fuse(self.semantic_layer(), self.citation_layer().where("etype = 'bib_coupling'").select("src", "dst", "weight"), s.fusion_alpha, s.fusion_neighbours, s.fusion_rounds)

    def causal_layer(self) -> DataFrame:
        return causal.acyclic(causal.oriented(self.combined_layer(), self.papers, self.citation_layer(), self.settings.causal_minimum))

    def members(self) -> DataFrame:
        return hierarchy.memberships(self.papers)

    def context(self) -> DataFrame:
        return mean_pool(self.papers.where("weight > 0"), "embedding", "weight").withColumnRenamed("pooled", "context")

    def recommend(self, candidates: DataFrame, n: int | None = None) -> DataFrame:
        """(id, rank, score): unseen candidates above the relevance floor, diversified."""
        fresh = scoring.unseen(candidates, self.papers)
        scored = scoring.context_similarity(fresh, self.context()).join(fresh.select("paper_id", "embedding"), "paper_id")
        pool = scored.where(F.col("context") >= self.settings.relevance_floor).select(F.col("paper_id").alias("id"), F.col("context").alias("score"), "embedding")
        return ranking.diversified(pool, n or self.settings.recommendations, self.settings.diversity)

    def ask(self, query: str, question: DataFrame, members: DataFrame) -> dict[str, DataFrame]:
        """Ranked papers, connections, frontier, narrative and lineages for a query and its one-row vector."""
        edges = G.settled(self.combined_layer(), "combined")
        ranks = G.settled(G.pagerank(self.papers.select(F.col("paper_id").alias("id")), edges.select("src", "dst", "weight")), "ranks")
        found = reasoning.retrieved(self.papers, question, query, edges, ranks)
        shown = G.settled(reasoning.answers(found).join(self.papers.select("paper_id", "title", "year"), "paper_id"), "shown")
        cites = self.citation_layer()
        return {
            "papers": shown,
            "connections": reasoning.connections(shown, cites, self.semantic_layer(), self.refs, members),
            "frontier": reasoning.frontier(self.papers, question, shown, edges),
            "narrative": reasoning.narrative(shown),
            "lineages": reasoning.lineages(shown, cites.where("etype = 'citation'").select("src", "dst")),
        }
