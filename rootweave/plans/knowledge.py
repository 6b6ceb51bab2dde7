"""Program graphs from parsed modules and recorded runs, and their merge to one property graph.

Nodes: id, kind, label, file, line, stmt, executed, runtime, message, ord. Edges: source, target, kind, ord.
`ord` is a struct of the path and the place in its file, so that the first (or last) of several rows is the one that
a walk over the files in path order meets first (or last).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootweave.functions.text import exception_message, exception_type
from rootweave.operators import graph as G
from rootweave.operators import resolve as R
from rootweave.operators import trace as X
from rootweave.operators.traverse import kept

_NODE = {"id": "string", "kind": "string", "label": "string", "file": "string", "line": "int", "stmt": "string", "executed": "boolean", "runtime": "boolean", "message": "string"}


@dataclass
class KnowledgeGraph:
    nodes: DataFrame
    edges: DataFrame
    sources: list[str]

    @property
    def missing_sources(self) -> list[str]:
        return sorted(set(G.SOURCES) - set(self.sources))


#: Places in a file: the module, its classes and their methods, its functions, its variables.
_CLASS, _FUNCTION, _VARIABLE = 1 << 20, 1 << 50, 1 << 51


def _at(path: str | Column = "", place: Column | int = 0) -> Column:
    path = F.lit(path) if isinstance(path, str) else path
    return F.struct(path.cast("string").alias("path"), (F.lit(place) if isinstance(place, int) else place).cast("long").alias("place"))


def _nodes(df: DataFrame, ord: Column | None = None, **columns) -> DataFrame:
    """The node schema from what is given; strings name columns."""
    made = [(F.col(v) if isinstance(v, str) else v).cast(_NODE[k]).alias(k) if (v := columns.get(k)) is not None else F.lit(None).cast(t).alias(k) for k, t in _NODE.items()]
    return df.select(*made, (ord if ord is not None else _at()).alias("ord"))


def _edges(df: DataFrame, source, target, kind: str | Column, ord: Column | None = None) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(F.col(source).alias("source") if isinstance(source, str) else source.alias("source"), F.col(target).alias("target") if isinstance(target, str) else target.alias("target"), kind.alias("kind"), (ord if ord is not None else _at()).alias("ord"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def functions_of(modules: DataFrame) -> DataFrame:
    """path, owner class (null for plain functions), name, qualname, line, params, calls, ord of all functions and methods."""
    plain = modules.select("path", F.lit(None).cast("string").alias("owner"), F.posexplode("functions").alias("pos", "f")).withColumn("place", F.lit(_FUNCTION) + F.col("pos"))
    methods = modules.select("path", F.posexplode("classes").alias("class_pos", "c")).select("path", F.col("c.name").alias("owner"), "class_pos", F.posexplode("c.methods").alias("pos", "f"))
    methods = methods.withColumn("place", (F.col("class_pos") + 1) * _CLASS + F.col("pos") + 1)
    kept = ["path", "owner", "f.*", _at(F.col("path"), F.col("place")).alias("ord")]
    found = plain.select(*kept).unionByName(methods.select(*kept))
    return found.withColumn("id", F.concat_ws("::", "path", "qualname"))


def classes_of(modules: DataFrame) -> DataFrame:
    found = modules.select("path", F.posexplode("classes").alias("pos", "c"))
    return found.select("path", "c.*", _at(F.col("path"), (F.col("pos") + 1) * _CLASS).alias("ord")).withColumn("id", F.concat_ws("::", "path", "qualname"))


def variables_of(modules: DataFrame) -> DataFrame:
    found = modules.select("path", F.posexplode("variables").alias("pos", "v"))
    return found.select("path", "v.*", _at(F.col("path"), F.lit(_VARIABLE) + F.col("pos")).alias("ord")).withColumn("id", F.concat_ws("::", "path", "name"))


def dependency_graph(modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A file node for each module; an imports edge where the module's name, or its longest dotted prefix, is a file."""
    imports = modules.select("path", F.inline("imports")).select("path", "module")
    linked = R.resolve_imports(imports, modules.select("path")).filter(F.col("target").isNotNull())
    nodes = _nodes(modules, _at(F.col("path")), id="path", kind=F.lit("file"), label="path", file="path")
    return G.distinct_nodes(nodes), G.distinct_edges(_edges(linked, "path", "target", "imports", _at(F.col("path"))))


def call_graph(modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    functions = functions_of(modules)
    calls = functions.select(F.col("path").alias("module"), F.col("id").alias("source"), F.col("ord").alias("_ord"), F.explode("calls").alias("call")).filter("call <> ''")
    index = functions.select(F.col("path").alias("module"), F.substring_index("qualname", ".", -1).alias("name"), "id")
    linked = R.resolve_calls(calls, index)
    ends = linked.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    external = F.col("id").startswith("external::")
    known = functions.select("id", "qualname", F.col("path").alias("file"), "line", "ord")
    nodes = ends.join(known, "id", "left")
    nodes = _nodes(nodes, F.coalesce("ord", _at()), id="id", kind=F.when(external, "external").otherwise(F.lit("function")), label=F.coalesce("qualname", F.regexp_replace("id", "^external::", "")), file="file", line="line")
    return G.distinct_nodes(nodes), G.distinct_edges(_edges(linked, "source", "target", "calls", F.col("_ord")))


def control_flow(modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks, of which the first of an id stands; the first and last of a function carry its file."""
    python = modules.filter("language = 'Python'")
    blocks = python.select("path", F.posexplode("blocks").alias("pos", "b")).select("path", "pos", "b.*")
    file = F.when(F.col("id").rlike(":(start|end)$"), F.col("path"))
    flows = python.select("path", F.posexplode("flows").alias("pos", "f")).select("path", "pos", "f.*")
    at = _at(F.col("path"), F.col("pos"))
    return G.distinct_nodes(_nodes(blocks, at, id="id", kind=F.lit("block"), label="label", file=file, line="line", stmt="stmt")), G.distinct_edges(_edges(flows, "source", "target", F.col("kind"), at))


def data_flow(modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    uses = modules.filter("language = 'Python'").select("path", F.posexplode("uses").alias("pos", "u")).select("path", "pos", "u.*")
    uses = uses.withColumn("function_id", F.concat_ws("::", "path", "function")).withColumn("variable_id", F.concat_ws("::", "path", "function", "name"))
    at = _at(F.col("path"), F.col("pos"))
    functions = _nodes(uses, at, id="function_id", kind=F.lit("function"), label="function", file="path", line="line")
    variables = _nodes(uses, at, id="variable_id", kind=F.lit("variable"), label="name")
    return G.distinct_nodes(functions.unionByName(variables)), G.distinct_edges(_edges(uses, "function_id", "variable_id", F.col("kind"), at))


def _flattened(project: str, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Containment of project, modules, classes, functions and variables, and inheritance."""
    root = F.lit(f"project::{project}")
    functions, classes, variables = functions_of(modules), classes_of(modules), variables_of(modules)
    at = F.col("ord")
    nodes = [
        _nodes(modules.limit(1), id=root, kind=F.lit("project"), label=F.lit(project)),
        _nodes(modules, _at(F.col("path")), id="path", kind=F.lit("module"), label="path", file="path"),
        _nodes(classes, at, id="id", kind=F.lit("class"), label="qualname", file="path", line="line"),
        _nodes(functions, at, id="id", kind=F.when(F.col("owner").isNull(), "function").otherwise("method"), label="qualname", file="path", line="line"),
        _nodes(variables, at, id="id", kind=F.lit("variable"), label="name", file="path", line="line"),
    ]
    bases = classes.select(F.col("id").alias("class_id"), F.explode("bases").alias("base"))
    parents = R.resolve_base_classes(bases, classes.select("id", "qualname", "ord"))
    owner = F.when(F.col("owner").isNull(), F.col("path")).otherwise(F.concat_ws("::", "path", "owner"))
    edges = [
        _edges(modules, root, "path", "defines", _at(F.col("path"))), _edges(classes, "path", "id", "defines", at), _edges(functions, owner, "id", "defines", at),
        _edges(variables, "path", "id", "defines", at), _edges(parents, "class_id", "target", "inherits"),
    ]
    return _union(nodes), _union(edges)


def _reconciled(nodes: DataFrame, edges: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    names = functions_of(modules).select(F.col("path").alias("file"), "qualname")
    nodes = R.reconcile_ids(nodes.withColumnRenamed("file", "_file"), names).withColumn("id", F.col("qualified")).drop("qualified").withColumnRenamed("_file", "file")
    for end in ("source", "target"):
        renamed = edges.withColumnRenamed(end, "id")
        edges = R.reconcile_ids(renamed, names).drop("id").withColumnRenamed("qualified", end)
    return nodes, edges.withColumn("kind", G.mapped_kind(F.col("kind"), G.DATAFLOW_EDGE_KINDS))


def runtime_rows(nodes: DataFrame, events: DataFrame, errors: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Executed functions, executes_after edges, exception nodes and throws edges.

    events: run_id, language, seq, type, function, filename; errors: run_id, language, exception_type, message.
    """
    functions = nodes.filter(F.col("kind").isin("function", "method")).select("id", F.col("label").alias("name"), "file")
    events = events.select("run_id", "language", "seq", "type", "function", "filename")
    linked = kept(X.bucketed(R.link_runtime(events, functions)), "linked")  # read by each of the parts below, twice for each step to the call before
    calls = linked.filter(F.col("type") == X.CALL)
    after = X.executes_after(calls)
    first = F.min_by(F.struct("function", "filename"), F.struct("language", "run_id", "seq"))
    ran = calls.groupBy("node_id").agg(first.alias("f")).select("node_id", "f.*")
    executed = _nodes(ran, id="node_id", kind=F.lit("function"), label="function", file="filename", executed=F.lit(True), runtime=F.col("node_id").startswith("runtime::"))
    node_rows, edge_rows = [executed], [_edges(after, "source", "target", "executes_after")]
    if errors is not None:
        exception_id = F.concat_ws("::", F.lit("exception"), "language", "exception_type")
        node_rows.append(_nodes(errors, _at(F.concat_ws("/", "language", "run_id")), id=exception_id, kind=F.lit("exception"), label="exception_type", message="message"))
        raised = linked.filter(F.col("type").isin(X.CALL, X.EXCEPTION)).groupBy("run_id").agg(
            F.coalesce(F.max_by(F.when(F.col("type") == X.EXCEPTION, F.col("node_id")), F.when(F.col("type") == X.EXCEPTION, F.col("seq"))), F.max_by("node_id", F.when(F.col("type") == X.CALL, F.col("seq")))).alias("raiser")
        )
        thrown = errors.join(raised, "run_id").select("raiser", exception_id.alias("exception_id")).filter(F.col("raiser").isNotNull())
        edge_rows.append(_edges(thrown, "raiser", "exception_id", "throws"))
    return _union(node_rows), _union(edge_rows)


def build(project: str, modules: DataFrame | None, events: DataFrame | None = None, errors: DataFrame | None = None) -> KnowledgeGraph:
    """Merge all sources: the first node of an id wins, `executed` is kept from any; edges are distinct."""
    if modules is None and events is None:
        raise ValueError("neither an analysis nor a recorded run is given")
    nodes: list[tuple[str, DataFrame]] = []
    edges: list[tuple[str, DataFrame]] = []

    def add(name: str, pair: tuple[DataFrame, DataFrame]) -> None:
        nodes.append((name, pair[0]))
        edges.append((name, pair[1]))

    if modules is not None:
        add("ast", _flattened(project, modules))
        dependency = dependency_graph(modules)
        add("dependency", (dependency[0].withColumn("kind", G.mapped_kind(F.col("kind"), G.NODE_KINDS)), dependency[1]))
        add("callgraph", call_graph(modules))
        blocks, flows = control_flow(modules)
        kinds = F.col("kind")
        for stmt, kind in G.BLOCK_KINDS.items():
            kinds = F.when(F.col("stmt") == stmt, F.lit(kind)).otherwise(kinds)
        add("cfg", (blocks.withColumn("kind", kinds), flows.withColumn("kind", F.lit("flows_to"))))
        add("dataflow", _reconciled(*data_flow(modules), modules))
    static = kept(G.merged(nodes), "static-nodes") if nodes else None  # read by the links of the run and by the result
    if events is None:
        return KnowledgeGraph(G.distinct_nodes(static, flags=("executed",)), G.distinct_edges(G.merged(edges)), [name for name, _ in nodes])
    base = G.distinct_nodes(static) if static is not None else _nodes(events.limit(0), id="function")
    run_nodes, run_edges = runtime_rows(base, events, errors)
    edges.append(("runtime", run_edges))
    ran = G.merged([("runtime", run_nodes)])
    whole = static.unionByName(ran) if static is not None else ran
    return KnowledgeGraph(G.distinct_nodes(whole, flags=("executed",)), G.distinct_edges(G.merged(edges)), [name for name, _ in edges])


def errors_from_events(events: DataFrame) -> DataFrame:
    """The last exception text of each run as an error row."""
    last = events.filter(F.col("type") == X.EXCEPTION).groupBy("run_id", "language").agg(F.max_by("exception", "seq").alias("e")).filter(F.col("e").isNotNull())
    return last.select("run_id", "language", exception_type(F.col("e")).alias("exception_type"), exception_message(F.col("e")).alias("message"))
