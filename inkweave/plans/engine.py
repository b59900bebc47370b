"""A corpus from files to graph and search, out of the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.config import D
from inkweave.operators import chunking, graph, lexical, links, retrieval, semantic, topics
from inkweave.runtime import Scratch
from inkweave.sources.files import admit_files, new_files, scan_folder
from inkweave.sources.parse import parse_files


@dataclass
class Corpus:
    """Documents (id, path, name, file_type, title, text, md_link_targets, ...) and what is derived from them."""

    spark: SparkSession
    documents: DataFrame

    @classmethod
    def from_folder(cls, spark: SparkSession, root: str) -> Corpus:
        """Reads, admits and parses the files of a folder once."""
        files = admit_files(scan_folder(spark, root)).where("admission = 'taken'")
        known = spark.createDataFrame([], "id string")
        parsed = parse_files(new_files(files, known))
        return cls(spark, Scratch(spark, "corpus").put(parsed, "documents"))

    def keywords(self) -> DataFrame:
        top = lexical.top_keywords(self.documents, "id", "text")
        ranked = top.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("keywords"))
        return ranked

    def entities(self) -> DataFrame:
        top = lexical.top_entities(self.documents, "id", "text")
        return top.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entity"))), lambda x: x["entity"]).alias("entities"))

    def nodes(self) -> DataFrame:
        """Document nodes; topics are the first five keywords."""
        empty = F.array().cast("array<string>")
        joined = self.documents.join(self.keywords(), "id", "left").join(self.entities(), "id", "left")
        return joined.withColumns({"keywords": F.coalesce("keywords", empty), "entities": F.coalesce("entities", empty), "kind": F.lit("document")}).withColumn("topics", F.slice("keywords", 1, 5)).drop("content")

    def edges(self, vectors: DataFrame | None = None, threshold: float = D.sim_threshold) -> DataFrame:
        """Reference, entity, keyword and, with vectors (id, vector), semantic edges."""
        nodes = Scratch(self.spark, "nodes").put(self.nodes(), "nodes")
        named = nodes.withColumnRenamed("name", "file_name")
        refs = links.references(named)
        lists = [refs, lexical.entity_edges(nodes), lexical.keyword_edges(nodes)]
        if vectors is not None:
            lists.append(semantic.semantic_edges(semantic.top_neighbours(semantic.similar_pairs(vectors, "id", "vector", threshold)), threshold))
        return graph.merge_edges(*lists)

    def graph(self, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes with communities, topic hubs included, and all edges."""
        scratch = Scratch(self.spark, "graph")
        nodes, edges = scratch.put(self.nodes(), "nodes"), scratch.put(self.edges(vectors), "edges")
        groups = Scratch(self.spark, "topics").put(topics.topic_rows(nodes), "rows")
        nodes = nodes.join(graph.communities(nodes, edges), "id", "left")
        hubs = topics.topic_hubs(groups, nodes.select("id", F.lit(-1).alias("cluster"))).select("id", "title", F.lit("topic").alias("kind"))
        both = nodes.select("id", "title", "kind", "community").unionByName(hubs.withColumn("community", F.lit(None).cast("string")))
        return both, graph.merge_edges(edges, topics.topic_edges(groups))

    def search(self, query: str, limit: int = D.search_limit, vectors: DataFrame | None = None, probe: Column | None = None, least: float = D.search_min_score) -> DataFrame:
        """The best passages: by words alone, or with passages' vectors (id, passage_index, vector) and the query's vector by both.

        Documents without passage vectors may come with one of their own, see ``retrieval.with_doc_vectors``.
        """
        if vectors is None or probe is None:
            return retrieval.lexical_search(self.chunked(), query, limit)
        return retrieval.search_corpus(self.chunked(), vectors, probe, query, limit, least)

    def chunked(self) -> DataFrame:
        """Documents with their chunks, as search reads them."""
        rows = chunking.chunks(self.documents).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("passage_index", "chunk"))), lambda x: x["chunk"]).alias("chunk_texts"))
        return self.documents.join(rows, "id", "left")
