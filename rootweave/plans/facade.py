"""Query entry points of the engine, one for each request that the service answers.

A project is a folder; records and results live in the tables of a `Registry`. Results are DataFrames; statuses
follow queued -> running -> ready or failed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootweave.functions.text import LANGUAGES, language_rank
from rootweave.operators import graph as G
from rootweave.operators import listing as L
from rootweave.operators import trace as X
from rootweave.operators.adjacency import stored
from rootweave.operators.traverse import kept
from rootweave.plans import knowledge as K
from rootweave.plans.explain import explain
from rootweave.plans.localize import localize, localize_runs
from rootweave.plans.records import Missing, NotReady, Registry
from rootweave.sources import files as S
from rootweave.sources import parsers as P
from rootweave.sources.parse_cache import ParseCache

GRAPHS = {"dependency": K.dependency_graph, "call": K.call_graph, "cfg": K.control_flow, "dataflow": K.data_flow}


def health() -> dict:
    return {"status": "ok"}


def project(spark: SparkSession, root: str, **options) -> DataFrame:
    return S.scan(spark, root, **options)


def project_summary(files: DataFrame) -> DataFrame:
    """One row: counts, bytes and languages in order of declaration."""
    languages = F.array_sort(F.collect_set(F.when(F.col("language").isNotNull(), F.struct(language_rank(F.col("language")).alias("rank"), F.col("language").alias("name")))))
    return files.agg(F.count(F.lit(1)).alias("file_count"), F.count_if(F.col("language").isNotNull()).alias("source_file_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes"), F.transform(languages, lambda x: x["name"]).alias("languages"))


def analysis(files: DataFrame, cache: ParseCache | None = None) -> DataFrame:
    """Parsed modules, written once: every graph reads them. A cache parses only files that it has not seen."""
    return cache.modules(files) if cache else kept(P.modules(files), "modules")


def project_archive(spark: SparkSession, path: str, **options) -> DataFrame:
    """The files table of an uploaded zip archive."""
    return S.listed(S.zipped_files(spark, path), **options)


def analysis_summary(modules: DataFrame) -> DataFrame:
    """One row: files parsed and failed, and how many nodes and edges each graph has."""
    row = modules.agg(F.count_if(F.col("parse_error").isNull()).alias("parsed_file_count"), F.count_if(F.col("parse_error").isNotNull()).alias("failed_file_count"))
    for kind, build in GRAPHS.items():
        nodes, edges = build(modules.filter("parse_error IS NULL"))
        row = row.withColumn(f"{kind}_node_count", nodes.agg(F.count(F.lit(1))).scalar()).withColumn(f"{kind}_edge_count", edges.agg(F.count(F.lit(1))).scalar())
    return row


def cache_counts(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row: files whose parse is known, and files that need one."""
    hits, misses = S.unchanged(files, parsed)
    return hits.agg(F.count(F.lit(1)).alias("hits")).withColumn("misses", misses.agg(F.count(F.lit(1))).scalar())


def analysis_graph(modules: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (without their details) and edges of one graph."""
    if kind not in GRAPHS:
        raise Missing(kind)
    nodes, edges = GRAPHS[kind](modules.filter("parse_error IS NULL"))
    return nodes.select("id", "kind", "label"), edges.select("source", "target", "kind")


def replay_summary(events: DataFrame) -> DataFrame:
    return X.max_stack_depth(events).join(X.bounds(events), "run_id").join(events.groupBy("run_id").agg(F.count(F.lit(1)).alias("total")), "run_id").join(X.last_exception(events), "run_id", "left")


def replay_steps(events: DataFrame, event_type: str | None = None, function: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    if not 1 <= limit <= 1000:
        raise ValueError("limit must lie between 1 and 1000")
    return X.page(X.matching(X.replay_steps(events), event_type, function), ["run_id", "index"], offset, limit)


def replay_step(events: DataFrame, index: int) -> DataFrame:
    if index < 0:
        raise ValueError("index must not be negative")
    return X.replay_steps(events).filter(F.col("index") == index)


def test_summary(cases: DataFrame) -> DataFrame:
    return L.suites_summary(L.suite_counts(cases, ["language"]))


def result_of(results: DataFrame, run_id: str, language: str) -> DataFrame:
    """The result of a run in one language."""
    if language not in LANGUAGES:
        raise Missing(language)
    found = results.filter((F.col("run_id") == run_id) & (F.col("language") == language))
    if found.isEmpty():
        raise Missing(f"{run_id} has no {language} result")
    return found


def executions(results: DataFrame) -> DataFrame:
    """executed_count and succeeded of each run."""
    return L.executions_summary(results, ["run_id"])


def knowledge(project_id: str, modules: DataFrame | None, events: DataFrame | None = None) -> K.KnowledgeGraph:
    parsed = modules.filter("parse_error IS NULL") if modules is not None else None
    graph = K.build(project_id, parsed, events, K.errors_from_events(events) if events is not None else None)
    return K.KnowledgeGraph(kept(graph.nodes, "nodes"), kept(graph.edges, "graph-edges"), graph.sources)


def knowledge_summary(graph: K.KnowledgeGraph) -> DataFrame:
    return G.totals(graph.nodes, graph.edges).withColumns({"sources": F.array(*map(F.lit, graph.sources)), "missing_sources": F.array(*map(F.lit, graph.missing_sources)).cast("array<string>")})


def localization(graph: K.KnowledgeGraph, run: DataFrame, events: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    return localize(graph.nodes, graph.edges, run, events, **options)


def localizations(graph: K.KnowledgeGraph, runs: DataFrame, events: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Candidates and results of all failed runs together; `explanation` takes such results and runs too."""
    return localize_runs(graph.nodes, stored(graph.edges), runs, events, **options)


def explanation(project_id: str, graph: K.KnowledgeGraph, result: DataFrame, run: DataFrame) -> DataFrame:
    return explain(project_id, result, graph.nodes, run)


def picked_run(runs: DataFrame) -> DataFrame:
    """The first run with an exception, else the first."""
    return runs.orderBy(F.col("exception_type").isNull(), "ord").limit(1)
