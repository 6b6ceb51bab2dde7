"""Registered queries over the tables seen as a program, and their SQL counterparts."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from rootweave.functions import text as T
from rootweave.operators import graph as G
from rootweave.operators import listing as L
from rootweave.operators import resolve as R
from rootweave.operators import trace as X
from rootweave.operators.adjacency import stored
from rootweave.operators.traverse import shared_folder
from rootweave.plans import explain, facade
from rootweave.plans import knowledge as K
from rootweave.plans import localize as Z
from rootweave.plans import project as P
from rootweave.plans import views as S
from rootweave.plans.register import query
from rootweave.sources import files as SF
from rootweave.sources import long_traces as LT
from rootweave.sources import recordings
from rootweave.sources.recordings import traceback_frames as frames_of

CALLS = r"""
    steps AS (SELECT l_partkey AS source, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS target FROM lineitem),
    edges AS (SELECT DISTINCT source, target FROM steps WHERE target IS NOT NULL AND source <> target)"""
START = "start AS (SELECT target AS id FROM edges GROUP BY target ORDER BY count(*) DESC, target LIMIT 1)"

ENTITIES = rf"""{CALLS},
    e AS (SELECT p_partkey AS k, 'p' || (p_partkey // 64) || '/m' || (p_partkey % 4) || CASE WHEN p_partkey % 4 = 3 THEN '.c' ELSE '.py' END AS path,
        CASE p_partkey % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'variable' END AS what,
        CASE p_partkey % 3 WHEN 0 THEN 'fn' || (p_partkey % 40) WHEN 1 THEN 'Cls' || (p_partkey % 30) ELSE 'var' || (p_partkey % 15) END AS name, p_size AS line FROM part),
    mods AS (SELECT DISTINCT path, ends_with(path, '.py') AS python FROM e),
    fx AS (SELECT k, path, name AS qualname, name, path || '::' || name AS id, line, 'function' AS kind, path AS owner, 2 AS grp FROM e WHERE what = 'function'
        UNION ALL SELECT k, path, name || '.fn' || (k % 7), 'fn' || (k % 7), path || '::' || name || '.fn' || (k % 7), line + 1, 'method', path || '::' || name, 1 FROM e WHERE what = 'class')"""
IMPORTS = r"""
    imp AS (SELECT DISTINCT s.path, CASE WHEN ends_with(t.path, '.c') THEN t.path ELSE replace(regexp_replace(t.path, '\.py$', ''), '/', '.') END || CASE WHEN t.k % 2 = 0 THEN '' ELSE '.deeper' END AS module
        FROM edges JOIN e s ON s.k = source JOIN e t ON t.k = target WHERE s.k % 9 = 0 AND t.what = 'function'),
    idx AS (SELECT key, max(path) AS path FROM (SELECT path AS key, path FROM mods UNION ALL SELECT regexp_replace(path, '\.py$', ''), path FROM mods) GROUP BY key),
    cand AS (SELECT module, n, array_to_string(list_slice(string_split(module, '.'), 1, n), '/') AS key FROM (SELECT module, unnest(range(1, len(string_split(module, '.')) + 1)) AS n FROM (SELECT DISTINCT module FROM imp))),
    pre AS (SELECT module, arg_max(idx.path, n) AS target FROM cand JOIN idx USING (key) GROUP BY module),
    dep AS (SELECT DISTINCT imp.path AS source, coalesce(idx.path, pre.target) AS target FROM imp LEFT JOIN idx ON idx.key = imp.module LEFT JOIN pre ON pre.module = imp.module
        WHERE coalesce(idx.path, pre.target) IS NOT NULL)"""
CALLED = r"""
    said AS (SELECT DISTINCT s.path AS module, s.path || '::' || s.name AS source, CASE WHEN t.k % 4 = 0 THEN 'self.' || t.name ELSE t.name END AS call, t.name AS name
        FROM edges JOIN e s ON s.k = source JOIN e t ON t.k = target WHERE s.what = 'function' AND t.what = 'function'),
    own AS (SELECT path AS module, name, count(*) AS n, min(id) AS id FROM fx GROUP BY ALL),
    alln AS (SELECT name, count(*) AS n FROM fx GROUP BY ALL),
    cg AS (SELECT DISTINCT source, coalesce(CASE WHEN own.n = 1 THEN own.id END,
        CASE WHEN call NOT LIKE 'self.%' AND alln.n - coalesce(own.n, 0) = 1 THEN (SELECT min(fx.id) FROM fx WHERE fx.name = said.name AND fx.path <> said.module) END,
        'external::' || call) AS target FROM said LEFT JOIN own USING (module, name) LEFT JOIN alln USING (name))"""
FLOWS = r"""
    pf AS (SELECT k, path, name, path || '::' || name AS id, line FROM e WHERE what = 'function' AND ends_with(path, '.py')),
    uses AS (SELECT path, function, line, kind, name, k FROM (
        SELECT path, name AS function, line, k FROM pf UNION ALL SELECT path, 'fn' || (k % 7), line, k FROM e WHERE what = 'class' AND ends_with(path, '.py')) u,
        LATERAL (SELECT 'reads' AS kind, 'x' || (k % 6) AS name UNION ALL SELECT 'writes', 'x' || (k % 5))),
    uniq AS (SELECT path, name AS function, min(qualname) AS qualname FROM fx GROUP BY ALL HAVING count(*) = 1),
    du AS (SELECT uses.*, path || '::' || coalesce(qualname, function) AS fid FROM uses LEFT JOIN uniq USING (path, function)),
    supers AS (SELECT name, max(path) || '::' || name AS id FROM e WHERE what = 'class' GROUP BY name)"""
BASE = rf"""{ENTITIES}, {IMPORTS}, {CALLED}, {FLOWS},
    n0 AS (
        SELECT 'project::p' AS id, 'project' AS kind, 'p' AS label, NULL AS file, NULL AS line, 0 AS r, '' AS path, 0 AS grp, 0 AS k
        UNION ALL SELECT path, 'module', path, path, NULL, 0, path, 0, 0 FROM mods
        UNION ALL SELECT path || '::' || name, 'class', name, path, line, 0, path, 1, k FROM e WHERE what = 'class'
        UNION ALL SELECT id, kind, qualname, path, line, 0, path, grp, k FROM fx
        UNION ALL SELECT path || '::' || name, 'variable', name, path, line, 0, path, 3, k FROM e WHERE what = 'variable'
        UNION ALL SELECT target, 'external', substr(target, 11), NULL, NULL, 2, '', 0, 0 FROM cg WHERE starts_with(target, 'external::')
        UNION ALL SELECT id || ':start', 'block', name || '()', path, line, 3, path, 0, k FROM pf
        UNION ALL SELECT id || ':block0', CASE WHEN k % 2 = 0 THEN 'condition' ELSE 'loop' END, CASE WHEN k % 2 = 0 THEN 'if' ELSE 'while' END, NULL, line + 1, 3, path, 0, k FROM pf
        UNION ALL SELECT id || ':end', 'block', 'end', path, NULL, 3, path, 0, k FROM pf
        UNION ALL SELECT fid, 'function', function, path, line, 4, path, 0, k FROM du
        UNION ALL SELECT fid || '::' || name, 'variable', name, NULL, NULL, 4, path, 0, k FROM du),
    base AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r, path, grp, k) AS n FROM n0) WHERE n = 1)"""
RUNTIME = r"""
    ev AS (SELECT DISTINCT l_orderkey || CASE WHEN ends_with(path, '.c') THEN 'C' ELSE 'Python' END AS run_id, CASE WHEN ends_with(path, '.c') THEN 'C' ELSE 'Python' END AS language,
        l_linenumber * 1048576 + k AS seq, name AS function, '/srv/' || path AS filename, k FROM lineitem JOIN e ON k = l_partkey WHERE what = 'function'),
    refs AS (SELECT DISTINCT language, filename, function FROM ev),
    hits AS (SELECT language, filename, function, min(id) AS id FROM refs JOIN base ON kind IN ('function', 'method') AND split_part(label, '.', -1) = function AND ends_with(filename, '/' || file) GROUP BY ALL HAVING count(*) = 1),
    lk AS (SELECT ev.*, coalesce(id, 'runtime::' || language || '::' || filename || '::' || function) AS node FROM ev LEFT JOIN hits USING (language, filename, function)),
    thrown AS (SELECT run_id, language, arg_max(node, seq) AS node, arg_max(k, seq) AS k FROM lk GROUP BY ALL HAVING arg_max(k, seq) % 5 = 0),
    stepped AS (SELECT run_id, seq, node, lag(node) OVER (PARTITION BY run_id ORDER BY seq) AS b FROM lk),
    after AS (SELECT DISTINCT b AS source, node AS target FROM stepped WHERE b IS NOT NULL AND b <> node)"""


def packed(files: pd.DataFrame) -> pd.DataFrame:
    """A zip archive of the files(archive, path, text) of one archive."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as opened:
        for path, text in zip(files["path"], files["text"], strict=True):
            opened.writestr(path, text)
    return pd.DataFrame({"path": files["archive"][:1], "content": [out.getvalue()]})


SOURCES = rf"""{ENTITIES}, {IMPORTS},
    heads AS (SELECT path, module, row_number() OVER (PARTITION BY path ORDER BY module) AS line FROM (SELECT DISTINCT path, CASE WHEN ends_with(path, '.py') THEN replace(module, '/', '.') ELSE module END AS module FROM imp)),
    sized AS (SELECT e.* EXCLUDE line, ends_with(e.path, '.py') AS python, CASE what WHEN 'function' THEN CASE WHEN python THEN 6 ELSE 4 END WHEN 'class' THEN 4 ELSE 2 END AS n,
        coalesce((SELECT count(*) FROM heads WHERE heads.path = e.path), 0) AS before FROM e),
    placed AS (SELECT *, CAST(before + sum(n) OVER (PARTITION BY path ORDER BY k) - n + 1 AS INTEGER) AS line, 'x' || (k % 6) AS x, CASE WHEN python AND k % 4 = 0 THEN 'self.' ELSE '' END || 'fn' || ((k * 3) % 40) AS call FROM sized)"""


def _symbols(found):
    functions = K.functions_of(found).select("path", F.when(F.col("owner").isNull(), "function").otherwise("method").alias("what"), F.col("qualname").alias("name"), "line", F.concat_ws(" ", F.array_join("params", ","), F.array_join("calls", ",")).alias("detail"))
    classes = K.classes_of(found).select("path", F.lit("class").alias("what"), "name", "line", F.array_join("bases", ",").alias("detail"))
    variables = K.variables_of(found).select("path", F.lit("variable").alias("what"), "name", "line", F.lit("").alias("detail"))
    imports = found.select("path", F.inline("imports")).select("path", F.lit("import").alias("what"), F.col("module").alias("name"), "line", F.lit("").alias("detail"))
    return functions.unionByName(classes).unionByName(variables).unionByName(imports)


@query(f"""WITH {SOURCES}
    SELECT path, 'import' AS what, module AS name, CAST(line AS INTEGER) AS line, '' AS detail FROM heads
    UNION ALL SELECT path, 'function', name, line, CASE WHEN python THEN 'a,b' ELSE 'a,*b' END || ' ' || call FROM placed WHERE what = 'function'
    UNION ALL SELECT path, 'class', name, line, CASE WHEN python THEN 'Cls' || ((k * 7) % 45) ELSE '' END FROM placed WHERE what = 'class'
    UNION ALL SELECT path, 'method', name || '.fn' || (k % 7), line + 1, 'self ' FROM placed WHERE what = 'class' AND python
    UNION ALL SELECT path, 'variable', name, line, '' FROM placed WHERE what = 'variable'""")
def parsed_symbols(spark, sf_dir):
    """What the parsers find in the written program."""
    return _symbols(facade.analysis(P.sources(spark, sf_dir)))


@query(f"""WITH {SOURCES}, f AS (SELECT path || '::' || name AS id FROM placed WHERE what = 'function' AND python), m AS (SELECT path || '::fn' || (k % 7) AS id FROM placed WHERE what = 'class' AND python),
    v(s, t, kind) AS (VALUES ('start', 'block0', 'next'), ('block0', 'block1', 'branch'), ('block1', 'block0', 'next'), ('block1', 'block0', 'true'), ('block1', 'block1', 'false'), ('block0', 'block2', 'join'), ('block1', 'block2', 'join'),
        ('block2', 'block3', 'return'), ('block0', 'end', 'fallthrough'), ('block2', 'end', 'fallthrough'))
    SELECT id || ':' || s AS source, id || ':' || t AS target, kind FROM f, v UNION SELECT id || ':start', id || ':block0', 'return' FROM m""")
def parsed_flows(spark, sf_dir):
    """Control flow of every Python function of the written program; block numbers start again in nested bodies."""
    return K.control_flow(facade.analysis(P.sources(spark, sf_dir)))[1].select("source", "target", "kind")


@query(f"""WITH {SOURCES}, f AS (SELECT path || '::' || name AS fid, * FROM placed WHERE what = 'function' AND python), m AS (SELECT path || '::fn' || (k % 7) AS fid FROM placed WHERE what = 'class' AND python)
    SELECT fid AS source, fid || '::' || unnest(['a', 'b']) AS target, 'parameter' AS kind FROM f UNION SELECT fid, fid || '::' || x, 'defines' FROM f UNION SELECT fid, fid || '::' || x, 'returns' FROM f
    UNION SELECT fid, fid || '::' || unnest(['a', 'b', x, split_part(call, '.', 1)]), 'reads' FROM f UNION SELECT fid, fid || '::self', unnest(['parameter', 'reads']) FROM m""")
def parsed_uses(spark, sf_dir):
    """Parameters, definitions, reads and returned names of every Python function of the written program."""
    return K.data_flow(facade.analysis(P.sources(spark, sf_dir)))[1].select("source", "target", "kind")


def _graph(spark, sf_dir):
    events, errors = P.recorded(spark, sf_dir)
    return K.build("p", facade.kept(P.modules(spark, sf_dir), "modules"), events, errors)


@query(f"WITH {ENTITIES}, {IMPORTS} SELECT source, target, 'imports' AS kind FROM dep")
def dependency_edges(spark, sf_dir):
    """Imports by exact name, then longest dotted prefix."""
    return K.dependency_graph(P.modules(spark, sf_dir))[1].select("source", "target", "kind")


@query(f"WITH {ENTITIES}, {CALLED} SELECT source, target, 'calls' AS kind FROM cg")
def call_graph_edges(spark, sf_dir):
    return K.call_graph(P.modules(spark, sf_dir))[1].select("source", "target", "kind")


@query(f"""WITH {ENTITIES}, {CALLED}, n AS (SELECT source AS id FROM cg UNION SELECT target FROM cg)
    SELECT n.id, CASE WHEN starts_with(n.id, 'external::') THEN 'external' ELSE 'function' END AS kind, coalesce(min(qualname), substr(n.id, 11)) AS label FROM n LEFT JOIN fx USING (id) GROUP BY n.id""")
def call_graph_nodes(spark, sf_dir):
    return K.call_graph(P.modules(spark, sf_dir))[0].select("id", "kind", "label")


@query(f"""WITH {BASE}, {RUNTIME},
    n1 AS (SELECT id, kind, label, file, line, r, path, grp, k, FALSE AS ran FROM base
        UNION ALL SELECT node, 'function', function, filename, NULL, 5, '', 0, 0, TRUE FROM lk
        UNION ALL SELECT DISTINCT 'exception::' || language || '::Error' || (k % 3), 'exception', 'Error' || (k % 3), NULL, NULL, 5, '', 0, 0, FALSE FROM thrown),
    f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r, path, grp, k) AS n, bool_or(ran) OVER (PARTITION BY id) AS executed FROM n1)
    SELECT id, kind, label, file, CAST(line AS INTEGER) AS line, executed FROM f WHERE n = 1""")
def merged_nodes(spark, sf_dir):
    """Nodes of the graph merged from six sources; the first of an id stands."""
    return _graph(spark, sf_dir).nodes.select("id", "kind", "label", "file", "line", "executed")


@query(f"""WITH {BASE}, {RUNTIME}
    SELECT 'project::p' AS source, path AS target, 'defines' AS kind FROM mods
    UNION SELECT path, path || '::' || name, 'defines' FROM e
    UNION SELECT owner, id, 'defines' FROM fx
    UNION SELECT path || '::' || e.name, supers.id, 'inherits' FROM e JOIN supers ON supers.name = 'Cls' || ((k * 7) % 45) WHERE what = 'class'
    UNION SELECT source, target, 'imports' FROM dep
    UNION SELECT source, target, 'calls' FROM cg
    UNION SELECT id || ':start', id || ':block0', 'flows_to' FROM pf
    UNION SELECT id || ':block0', id || ':end', 'flows_to' FROM pf
    UNION SELECT fid, fid || '::' || name, kind FROM du
    UNION SELECT source, target, 'executes_after' FROM after
    UNION SELECT node, 'exception::' || language || '::Error' || (k % 3), 'throws' FROM thrown""")
def merged_edges(spark, sf_dir):
    return _graph(spark, sf_dir).edges.select("source", "target", "kind")


@query(f"""WITH {BASE}
    SELECT (SELECT count(*) FROM mods) AS parsed_file_count, 0 AS failed_file_count, (SELECT count(*) FROM mods) AS dependency_node_count, (SELECT count(*) FROM dep) AS dependency_edge_count,
        (SELECT count(*) FROM (SELECT source FROM cg UNION SELECT target FROM cg)) AS call_node_count, (SELECT count(*) FROM cg) AS call_edge_count,
        (SELECT count(DISTINCT id) * 3 FROM pf) AS cfg_node_count, (SELECT count(DISTINCT id) * 3 FROM pf) AS cfg_edge_count,
        (SELECT count(*) FROM (SELECT path || '::' || function FROM uses UNION SELECT path || '::' || function || '::' || name FROM uses)) AS dataflow_node_count,
        (SELECT count(*) FROM (SELECT DISTINCT path, function, name, kind FROM uses)) AS dataflow_edge_count""")
def analysis_counts(spark, sf_dir):
    return facade.analysis_summary(facade.kept(P.modules(spark, sf_dir), "modules"))


CRASH = rf"""{CALLS}, {START},
    fn AS (SELECT p_partkey AS k, 'p' || (p_partkey // 64) || '/m' || (p_partkey % 4) || '.py' AS file, CASE WHEN p_partkey % 7 = 0 THEN 'C.fn' ELSE 'fn' END || p_partkey AS label, p_size AS line,
        file || '::' || label AS id, CASE WHEN p_partkey % 7 = 0 THEN 'method' ELSE 'function' END AS kind FROM part),
    var AS (SELECT k, id || '::v' || (k % 50) AS id, 'v' || (k % 50) AS label FROM fn WHERE k % 5 = 0),
    cl AS (SELECT a.id AS source, b.id AS target, a.k AS sk, b.k AS tk, a.file AS sf, b.file AS tf FROM edges JOIN fn a ON a.k = source JOIN fn b ON b.k = target),
    imports AS (SELECT DISTINCT sf AS source, tf AS target FROM cl WHERE sk % 40 = 0 AND tk % 3 = 0 AND sf <> tf),
    reads AS (SELECT fn.id AS source, var.id AS target FROM fn JOIN var USING (k) UNION SELECT source, var.id FROM cl JOIN var ON var.k = tk WHERE sk % 3 = 0),
    writes AS (SELECT DISTINCT source, var.id AS target FROM cl JOIN var ON var.k = tk WHERE sk % 2 = 0),
    crash AS (SELECT fn.* FROM fn JOIN start ON fn.k = start.id),
    ordl AS (SELECT l_partkey AS k, row_number() OVER (ORDER BY l_linenumber, l_partkey) - 1 AS seq FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem WHERE l_partkey = (SELECT id FROM start))),
    ran AS (SELECT ordl.k, seq, fn.id, fn.label FROM ordl JOIN fn USING (k) WHERE seq <= (SELECT min(seq) FROM ordl WHERE k = (SELECT id FROM start))),
    executed AS (SELECT id, row_number() OVER (ORDER BY min(seq)) - 1 AS place FROM ran GROUP BY id),
    stack AS (SELECT id, label, row_number() OVER (ORDER BY seq) - 1 AS place FROM ran WHERE seq > (SELECT max(seq) FROM ran) - 3),
    up(k, depth) AS (SELECT id, 0 FROM start UNION SELECT edges.source, up.depth + 1 FROM up JOIN edges ON edges.target = up.k WHERE up.depth < 3),
    callers AS (SELECT fn.id, min(depth) AS depth FROM up JOIN fn USING (k) WHERE k NOT IN (SELECT id FROM start) GROUP BY fn.id),
    callees AS (SELECT DISTINCT target AS id FROM cl WHERE sk = (SELECT id FROM start)),
    upm(file, depth) AS (SELECT file, 0 FROM crash UNION SELECT imports.source, upm.depth + 1 FROM upm JOIN imports ON imports.target = upm.file WHERE upm.depth < 3),
    importers AS (SELECT file, min(depth) AS depth FROM upm WHERE file NOT IN (SELECT file FROM crash) GROUP BY file),
    seen AS (SELECT 'v' || ((id + unnest([0, 10, 20])) % 50) AS label FROM start),
    read AS (SELECT DISTINCT target AS id FROM reads WHERE source = (SELECT id FROM crash)),
    involved AS (SELECT id FROM var JOIN seen USING (label) UNION SELECT id FROM read),
    writers AS (SELECT DISTINCT source AS id, target FROM writes JOIN involved ON involved.id = target),
    cid AS (SELECT id FROM crash UNION SELECT id FROM stack UNION SELECT id FROM executed UNION SELECT id FROM callers UNION SELECT id FROM callees UNION SELECT file FROM importers UNION SELECT id FROM involved UNION SELECT id FROM writers),
    node AS (SELECT k, id, kind, label, file, line FROM fn UNION ALL SELECT DISTINCT NULL, file, 'module', file, file, NULL FROM fn UNION ALL SELECT NULL, id, 'variable', label, NULL, NULL FROM var),
    c AS (SELECT node.*, kind IN ('function', 'method') AS is_fn, id = (SELECT id FROM crash) AS is_crash, coalesce(file = (SELECT file FROM crash), FALSE) AS near,
        xl, k % 2 = 0 AND xl BETWEEN line AND line + 2 AS has_line, xl < line + 2 OR k % 4 = 0 AS reached, k % 2 = 0 AS has_blocks,
        (SELECT max(place) FROM executed) - (SELECT place FROM executed x WHERE x.id = node.id) AS run, (SELECT max(place) FROM stack) - (SELECT min(place) FROM stack x WHERE x.id = node.id) AS hop,
        (SELECT depth FROM callers x WHERE x.id = node.id) AS up, (SELECT depth FROM importers x WHERE x.file = node.id) AS imp, (SELECT depth FROM importers x WHERE x.file = node.file) AS fimp,
        id IN (SELECT id FROM callees) AS callee, id IN (SELECT id FROM read) AS is_read, id IN (SELECT id FROM involved) AS is_inv,
        id IN (SELECT id FROM writers WHERE target IN (SELECT id FROM read)) AS w_read, id IN (SELECT id FROM writers) AS w_inv
        FROM cid JOIN node USING (id), (SELECT line + 2 AS xl FROM crash) q),
    ev AS (
        SELECT id, 1 AS o, 'ast' AS source, 0.02 AS w, CASE WHEN near THEN 0.7 ELSE 0.5 END AS s, CASE WHEN near THEN 'Declared in the failing module' ELSE 'Declared in the project' END AS d FROM c
        UNION ALL SELECT id, 2, 'dependency_graph', 0.03, CASE WHEN imp IS NOT NULL THEN CASE imp WHEN 1 THEN 0.8 WHEN 2 THEN 0.5 ELSE 0.3 END WHEN is_fn AND fimp IS NOT NULL THEN CASE fimp WHEN 1 THEN 0.6 WHEN 2 THEN 0.4 ELSE 0.2 END END,
            CASE WHEN imp IS NOT NULL THEN 'A module ' || imp ELSE 'Lives in a module ' || fimp END || ' import(s) away from the failing module' FROM c
        UNION ALL SELECT id, 3, 'call_graph', 0.10, CASE WHEN is_crash THEN NULL WHEN up IS NOT NULL THEN CASE up WHEN 1 THEN 1.0 WHEN 2 THEN 0.7 ELSE 0.5 END WHEN callee THEN 0.7 END,
            CASE WHEN up IS NOT NULL THEN 'Reaches the failing function in ' || up || ' call(s)' ELSE 'The failing function calls it' END FROM c
        UNION ALL SELECT id, 4, 'cfg', 0.15, CASE WHEN is_fn AND has_line AND reached THEN 1.0 WHEN is_fn AND has_line THEN 0.3 WHEN is_fn AND has_blocks AND is_crash THEN 0.8 END,
            CASE WHEN has_line AND reached THEN 'Some path through it leads to line ' || xl WHEN has_line THEN 'Holds the failing line, off every path' ELSE 'Its blocks surround the failing line' END FROM c
        UNION ALL SELECT id, 5, 'data_flow', 0.20, CASE WHEN is_fn THEN CASE WHEN w_read THEN 1.0 WHEN w_inv THEN 0.8 END WHEN is_read THEN 1.0 WHEN is_inv THEN 0.8 END,
            CASE WHEN is_fn THEN CASE WHEN w_read THEN 'Sets a value that the failing function reads' ELSE 'Sets a value that the failing frame holds' END WHEN is_read THEN 'The failing function reads it' ELSE 'The failing frame holds it' END FROM c
        UNION ALL SELECT id, 6, 'runtime_trace', 0.30, CASE WHEN is_crash THEN 1.0 WHEN run IS NOT NULL THEN CASE WHEN run <= 3 THEN greatest(0.3, 1 - 0.25 * run) END WHEN is_inv THEN 0.7 END,
            CASE WHEN is_crash THEN 'The exception was raised in it' WHEN run IS NOT NULL THEN 'Ran ' || run || ' call(s) ahead of the failure' ELSE 'Its value was recorded at the failure' END FROM c
        UNION ALL SELECT id, 7, 'stack_trace', 0.20, CASE WHEN hop IS NOT NULL THEN greatest(0.2, 1 - 0.2 * hop) END, 'On the stack, ' || hop || ' frame(s) above the failure' FROM c),
    sc AS (SELECT id, round(sum(CAST(s AS DECIMAL(5,4)) * CAST(w AS DECIMAL(5,4))), 4) AS score, count(*) AS n_evidence, arg_min(d, CAST((1 - s) * 100 AS INTEGER) * 10 + o) AS reason, arg_min(source, CAST((1 - s) * 100 AS INTEGER) * 10 + o) AS best,
        string_agg(source, ',' ORDER BY o) AS sources FROM ev WHERE s IS NOT NULL GROUP BY id),
    ranked AS (SELECT id AS node_id, label, kind, CAST(score AS DOUBLE) AS score, reason, n_evidence, best, sources, file, line, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sc JOIN c USING (id))"""


def _localized(spark, sf_dir, threshold=Z.THRESHOLD):
    steps = facade.kept(S.call_edges(spark, sf_dir), "call-edges")
    nodes, edges = (facade.kept(x, "crash-graph", "kind") for x in P.crash_graph(spark, sf_dir, steps))
    run, events = P.crash_run(spark, sf_dir, steps)
    run, events = facade.kept(run, "crash-run"), facade.kept(events, "crash-events")
    return nodes, run, *Z.localize(nodes, edges, run, events, threshold=threshold)


@query(f"WITH RECURSIVE {CRASH} SELECT node_id, label, kind, score, reason, n_evidence FROM ranked")
def localized_candidates(spark, sf_dir):
    """Every candidate of the failed run, with its evidence fused to a score."""
    _, _, ranked, _ = _localized(spark, sf_dir)
    return ranked.select("node_id", "label", "kind", "score", "reason", F.size("evidence").cast("long").alias("n_evidence"))


_PATH = "(SELECT string_agg(label, ' > ' ORDER BY place) FROM stack)"
_MISSING = "array_to_string(list_filter(['ast', 'dependency_graph', 'call_graph', 'cfg', 'data_flow', 'runtime_trace', 'stack_trace'], lambda x: NOT list_contains(string_split(sources, ','), x)), ',')"
_AT = "CASE WHEN file IS NULL THEN node_id WHEN line IS NULL THEN file ELSE file || ':' || line END"
_ADVICE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in Z.ADVICE.items())


@query(f"""WITH RECURSIVE {CRASH}
    SELECT score >= 0.5 AS resolved, score AS confidence, CASE WHEN score >= 0.5 THEN label || ' at ' || {_AT} || ' is the likely cause (score ' || printf('%.2f', score) || ').' ELSE 'No candidate is sure enough; the best one scores ' || printf('%.2f', score) || '.' END AS summary,
        CASE WHEN score >= 0.5 THEN node_id END AS cause, {_PATH} AS path, {_MISSING} AS missing,
        CASE WHEN score >= 0.5 THEN CASE best {_ADVICE} ELSE 'Read through ' || label || ' with the failing input in mind.' END END AS suggested_fix
    FROM ranked WHERE rank = 1""")
def localization_result(spark, sf_dir):
    _, _, _, result = _localized(spark, sf_dir, "0.5")
    return result.select(
        "resolved", "confidence", "summary", F.col("root_cause.node_id").alias("cause"), F.array_join("propagation_path", " > ").alias("path"),
        F.array_join("missing_sources", ",").alias("missing"), "suggested_fix",
    )


@query(f"""WITH RECURSIVE {CRASH}, top AS (SELECT *, score >= 0.5 AS resolved FROM ranked WHERE rank = 1), n AS (SELECT count(*) AS n, arg_min(label, place) AS first, arg_max(label, place) AS last FROM stack),
    wh AS (SELECT -1 AS pos, file, split_part(label, '.', -1) AS function, line FROM top WHERE resolved AND file IS NOT NULL UNION ALL SELECT place, file, split_part(fn.label, '.', -1), line FROM stack JOIN fn USING (id)),
    wu AS (SELECT min(pos) AS pos, file, function, line FROM wh GROUP BY file, function, line)
    SELECT 'KeyError: part' AS error_summary, CASE WHEN resolved THEN label || ' (' || {_AT} || ')' END AS root_cause,
        CASE WHEN NOT resolved THEN 'Several candidates remain, none above the threshold; they are listed by score.'
            WHEN n = 1 THEN 'It began and ended in ' || first || ', so the recorded stack and the order of calls say.'
            WHEN n = 2 THEN 'It began in ' || first || ' and surfaced in ' || last || ', so the recorded stack and the order of calls say.'
            ELSE 'It began in ' || first || ', went through ' || (SELECT label FROM stack WHERE place = 1) || ' and surfaced in ' || last || ', so the recorded stack and the order of calls say.' END AS why,
        (SELECT string_agg(file || ':' || function || ':' || coalesce(CAST(line AS VARCHAR), ''), ' ' ORDER BY pos) FROM wu) AS places, NOT resolved OR {_MISSING} <> '' AS insufficient_evidence
    FROM top, n""")
def explanation_report(spark, sf_dir):
    nodes, run, _, result = _localized(spark, sf_dir, "0.5")
    report = explain.explain("p", result, nodes, run)
    place = F.transform("where", lambda w: F.concat(w["file"], F.lit(":"), w["function"], F.lit(":"), F.coalesce(w["line"].cast("string"), F.lit(""))))
    return report.select("error_summary", "root_cause", "why", F.array_join(place, " ").alias("places"), "insufficient_evidence")


_EVIDENCE = CRASH[CRASH.index("    ev AS (") : CRASH.index("    ranked AS")].replace("SELECT id,", "SELECT run_id, id,").replace("GROUP BY id", "GROUP BY run_id, id")
FAILED = rf"""
    steps AS (SELECT l_partkey AS source, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS target FROM lineitem),
    counted AS (SELECT source, target, count(*) AS n FROM steps WHERE target IS NOT NULL AND source <> target GROUP BY ALL),
    fol AS (SELECT source, target FROM counted QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, target) = 1),
    fn AS (SELECT p_partkey AS k, 'p' || (p_partkey // 64) || '/m' || (p_partkey % 4) || '.py' AS file, CASE WHEN p_partkey % 7 = 0 THEN 'C.fn' ELSE 'fn' END || p_partkey AS label, p_size AS line,
        file || '::' || label AS id, CASE WHEN p_partkey % 7 = 0 THEN 'method' ELSE 'function' END AS kind FROM part),
    var AS (SELECT k, id || '::v' || (k % 1000) AS id, 'v' || (k % 1000) AS label FROM fn WHERE k % 5 = 0),
    cl AS (SELECT a.id AS source, b.id AS target, a.k AS sk, b.k AS tk, a.file AS sf, b.file AS tf FROM fol JOIN fn a ON a.k = source JOIN fn b ON b.k = target),
    imports AS (SELECT DISTINCT sf AS source, tf AS target FROM cl WHERE sk % 4 = 0 AND sf <> tf),
    reads AS (SELECT fn.id AS source, var.id AS target FROM fn JOIN var USING (k) UNION SELECT source, var.id FROM cl JOIN var ON var.k = tk WHERE sk % 3 = 0),
    writes AS (SELECT DISTINCT source, var.id AS target FROM cl JOIN var ON var.k = tk WHERE sk % 2 = 0),
    lines AS (SELECT l_orderkey AS run_id, l_partkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS seq, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
    crash AS (SELECT run_id, fn.* EXCLUDE line, k % 3 <> 1 AS traced, CASE WHEN traced THEN file END AS xf, CASE WHEN traced THEN line + 2 END AS xl FROM lines JOIN fn USING (k) WHERE seq = n - 1 AND k % 5 = 0),
    ran AS (SELECT run_id, seq, n, traced, fn.id, fn.label FROM lines JOIN (SELECT run_id, traced FROM crash) q USING (run_id) JOIN fn USING (k)),
    executed AS (SELECT run_id, id, row_number() OVER (PARTITION BY run_id ORDER BY min(seq) DESC) - 1 AS run FROM ran GROUP BY run_id, id),
    stack AS (SELECT run_id, id, label, seq, n - 1 - seq AS hop FROM ran WHERE traced AND seq > n - 4),
    up1 AS (SELECT DISTINCT run_id, cl.source AS id FROM crash JOIN cl ON cl.target = crash.id), up2 AS (SELECT DISTINCT run_id, cl.source AS id FROM up1 JOIN cl ON cl.target = up1.id),
    up3 AS (SELECT DISTINCT run_id, cl.source AS id FROM up2 JOIN cl ON cl.target = up2.id),
    callers AS (SELECT run_id, id, min(d) AS up FROM (SELECT *, 1 AS d FROM up1 UNION ALL SELECT *, 2 FROM up2 UNION ALL SELECT *, 3 FROM up3) u WHERE (run_id, id) NOT IN (SELECT run_id, id FROM crash) GROUP BY ALL),
    callees AS (SELECT DISTINCT run_id, cl.target AS id, TRUE AS callee FROM crash JOIN cl ON cl.source = crash.id),
    im1 AS (SELECT DISTINCT run_id, imports.source AS id FROM crash JOIN imports ON imports.target = crash.xf), im2 AS (SELECT DISTINCT run_id, imports.source AS id FROM im1 JOIN imports ON imports.target = im1.id),
    im3 AS (SELECT DISTINCT run_id, imports.source AS id FROM im2 JOIN imports ON imports.target = im2.id),
    importers AS (SELECT run_id, id, min(d) AS imp FROM (SELECT *, 1 AS d FROM im1 UNION ALL SELECT *, 2 FROM im2 UNION ALL SELECT *, 3 FROM im3) u WHERE (run_id, id) NOT IN (SELECT run_id, xf FROM crash WHERE traced) GROUP BY ALL),
    seen AS (SELECT run_id, 'v' || ((k + unnest([0, 10])) % 1000) AS label FROM crash),
    read AS (SELECT DISTINCT run_id, reads.target AS id FROM crash JOIN reads ON reads.source = crash.id),
    involved AS (SELECT run_id, id, bool_or(r) AS is_read, TRUE AS is_inv FROM (SELECT run_id, var.id, FALSE AS r FROM seen JOIN var USING (label) UNION ALL SELECT run_id, id, TRUE FROM read) u GROUP BY ALL),
    writers AS (SELECT run_id, source AS id, bool_or(is_read) AS w_read, TRUE AS w_inv FROM writes JOIN involved ON involved.id = target GROUP BY ALL),
    cid AS (SELECT run_id, id FROM crash UNION SELECT run_id, id FROM stack UNION SELECT run_id, id FROM executed UNION SELECT run_id, id FROM callers UNION SELECT run_id, id FROM callees
        UNION SELECT run_id, id FROM importers UNION SELECT run_id, id FROM involved UNION SELECT run_id, id FROM writers),
    node AS (SELECT k, id, kind, label, file, line FROM fn UNION ALL SELECT DISTINCT NULL, file, 'module', file, file, NULL FROM fn UNION ALL SELECT NULL, id, 'variable', label, NULL, NULL FROM var),
    hops AS (SELECT run_id, id, max(hop) AS hop FROM stack GROUP BY ALL),
    c AS (SELECT cid.run_id, node.*, node.kind IN ('function', 'method') AS is_fn, node.id = crash.id AS is_crash, coalesce(node.file = xf, FALSE) AS near, xl, executed.run, hop, up, importers.imp, f.imp AS fimp,
        node.k % 2 = 0 AND coalesce(xl BETWEEN line AND line + 2, FALSE) AS has_line, xl < line + 2 OR node.k % 4 = 0 AS reached, node.k % 2 = 0 AS has_blocks,
        coalesce(callee, FALSE) AS callee, coalesce(is_read, FALSE) AS is_read, coalesce(is_inv, FALSE) AS is_inv, coalesce(w_read, FALSE) AS w_read, coalesce(w_inv, FALSE) AS w_inv
        FROM cid JOIN node USING (id) JOIN crash ON crash.run_id = cid.run_id LEFT JOIN executed ON executed.run_id = cid.run_id AND executed.id = node.id LEFT JOIN hops ON hops.run_id = cid.run_id AND hops.id = node.id
        LEFT JOIN callers ON callers.run_id = cid.run_id AND callers.id = node.id LEFT JOIN callees ON callees.run_id = cid.run_id AND callees.id = node.id
        LEFT JOIN importers ON importers.run_id = cid.run_id AND importers.id = node.id LEFT JOIN importers f ON f.run_id = cid.run_id AND f.id = node.file
        LEFT JOIN involved ON involved.run_id = cid.run_id AND involved.id = node.id LEFT JOIN writers ON writers.run_id = cid.run_id AND writers.id = node.id),
{_EVIDENCE}    ranked AS (SELECT run_id, id AS node_id, label, CAST(score AS DOUBLE) AS score, reason, n_evidence, best, sources, file, line, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, id) AS rank FROM sc JOIN c USING (run_id, id))"""


def _failed(spark, sf_dir):
    nodes, edges = P.failed_graph(spark, sf_dir)
    runs, events = (facade.kept(x, "failed-runs") for x in P.failed_runs(spark, sf_dir))
    return facade.kept(nodes, "failed-nodes"), stored(edges), runs, events


@query(f"WITH {FAILED} SELECT run_id, node_id, score, rank, reason, n_evidence FROM ranked")
def localized_runs(spark, sf_dir):
    """Every candidate of all failed runs, localised together, with its rank in its run."""
    found = Z.run_candidates(*_failed(spark, sf_dir)).select("run_id", "node_id", "score", "reason", F.size("evidence").cast("long").alias("n_evidence"))
    return L.ranked(facade.kept(found, "candidates"), "node_id")  # ranges are sampled before they are dealt


@query(f"""WITH {FAILED},
    way AS (SELECT run_id, string_agg(label, ' > ' ORDER BY seq) AS path FROM stack GROUP BY run_id),
    tail AS (SELECT run_id, string_agg(label, ' > ' ORDER BY run DESC) AS path FROM executed JOIN fn USING (id) WHERE run < 4 GROUP BY run_id)
    SELECT r.run_id, score >= 0.5 AS resolved, score AS confidence, CASE WHEN score >= 0.5 THEN node_id END AS cause, coalesce(way.path, tail.path) AS path, {_MISSING} AS missing,
        CASE WHEN score >= 0.5 THEN CASE best {_ADVICE} ELSE 'Read through ' || label || ' with the failing input in mind.' END END AS suggested_fix
    FROM ranked r LEFT JOIN way USING (run_id) LEFT JOIN tail USING (run_id) WHERE rank = 1""")
def run_verdicts(spark, sf_dir):
    """The result of every failed run."""
    result = Z.run_results(*_failed(spark, sf_dir), threshold="0.5")
    return result.select(
        "run_id", "resolved", "confidence", F.col("root_cause.node_id").alias("cause"), F.array_join("propagation_path", " > ").alias("path"),
        F.array_join("missing_sources", ",").alias("missing"), "suggested_fix",
    )


@query("""SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS place, 'm' || (l_partkey % 9) || '.py' AS file, l_linenumber AS line,
    CASE WHEN l_partkey % 6 = 0 THEN '<module>' ELSE 'fn' || l_partkey END AS function FROM lineitem""")
def traceback_frames(spark, sf_dir):
    """Frames of every order's traceback, outermost first."""
    found = P.tracebacks(spark, sf_dir).select("run_id", F.posexplode(frames_of(F.col("text"))).alias("place", "f"))
    return found.select("run_id", F.col("place").cast("long").alias("place"), "f.file", "f.line", "f.function")


@query("""WITH f AS (SELECT l_orderkey AS run_id, l_linenumber AS line, l_partkey % 9 AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem),
    k AS (SELECT run_id, min(n) FILTER (WHERE m <> 0) AS first FROM f GROUP BY run_id)
    SELECT run_id, CAST(count(*) FILTER (WHERE n >= first) AS INTEGER) AS n_frames, min(line) FILTER (WHERE n = first) AS first_line FROM f JOIN k USING (run_id) GROUP BY run_id""")
def own_frames(spark, sf_dir):
    """Tracebacks without the frames of the harness (m0.py) at their start."""
    frames = X.without_leading(frames_of(F.col("text")), "m0.py")
    counted = F.transform(F.array(frames), lambda f: F.struct(F.size(f).alias("n_frames"), F.get(f, F.lit(0))["line"].alias("first_line")))
    return P.tracebacks(spark, sf_dir).select("run_id", F.inline(counted))


_RESULTS = """r AS (SELECT o_custkey AS run_id, CASE o_orderkey % 3 WHEN 0 THEN 'Python' WHEN 1 THEN 'C' ELSE 'C++' END AS language, CASE WHEN o_orderstatus = 'F' THEN 'ready' ELSE 'failed' END AS status,
    CASE WHEN o_totalprice > 250000 THEN 'Costly' END AS exception_type, o_orderkey AS ord FROM orders)"""


@query(f"WITH {_RESULTS} SELECT run_id, count(*) AS executed_count, bool_or(exception_type IS NULL AND status = 'ready') AS succeeded FROM r GROUP BY run_id")
def executions(spark, sf_dir):
    """Results of each run, and whether any ran well."""
    return facade.executions(P.results(spark, sf_dir))


@query(f"""WITH {_RESULTS}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY exception_type IS NULL, ord) AS n FROM r)
    SELECT run_id, language, exception_type, ord FROM k WHERE n = 1""")
def picked_result(spark, sf_dir):
    """The result that a report is about: the first with an exception, else the first."""
    return L.picked(P.results(spark, sf_dir), ["run_id"]).select("run_id", "language", "exception_type", "ord")


@query(f"""WITH {_RESULTS}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id, language ORDER BY exception_type IS NULL, ord) AS n FROM r),
    w AS (SELECT c_custkey AS run_id, CASE c_nationkey % 3 WHEN 0 THEN 'Python' WHEN 1 THEN 'C' ELSE 'C++' END AS language FROM customer)
    SELECT w.run_id, w.language, k.status, k.ord IS NOT NULL AS has_result FROM w LEFT JOIN k ON k.run_id = w.run_id AND k.language = w.language AND k.n = 1""")
def run_results(spark, sf_dir):
    """Records of runs joined to their result in one language."""
    language = F.when(F.col("c_nationkey") % 3 == 0, "Python").when(F.col("c_nationkey") % 3 == 1, "C").otherwise("C++")
    records = S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), language.alias("language"))
    return L.with_result(records, L.picked(P.results(spark, sf_dir), ["run_id", "language"]), ["run_id", "language"]).select("run_id", "language", "status", "has_result")


@query(f"WITH {CALLS}, {START} SELECT source, target, 'in' AS way FROM edges WHERE target = (SELECT id FROM start) UNION ALL SELECT source, target, 'out' FROM edges WHERE source = (SELECT id FROM start)")
def incident_edges(spark, sf_dir):
    """Calls into and out of the most called part."""
    edges = S.call_edges(spark, sf_dir).withColumn("kind", F.lit("calls"))
    most = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")
    ways = [G.incident(edges, most, end, "calls").select("source", "target", F.lit(way).alias("way")) for end, way in (("target", "in"), ("source", "out"))]
    return ways[0].unionByName(ways[1])


@query(f"WITH {CALLS} SELECT (SELECT count(*) FROM part) AS node_count, (SELECT count(*) FROM edges) AS edge_count")
def graph_totals(spark, sf_dir):
    nodes = S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return G.totals(nodes, S.call_edges(spark, sf_dir))


@query(f"WITH {CALLS} SELECT source, target FROM edges WHERE source IN (SELECT p_partkey FROM part WHERE p_size > 10) AND target IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def kept_edges(spark, sf_dir):
    """Calls between parts that are left when small ones go."""
    return G.without_dangling(S.call_edges(spark, sf_dir), S.table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("id")))


@query("""WITH f AS (SELECT CASE WHEN p_partkey % 50 = 7 THEN 'main' WHEN p_partkey % 50 = 9 THEN 'Main' ELSE 'f' || p_partkey END || CASE p_partkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.c' ELSE '.cpp' END AS path,
        CASE p_partkey % 3 WHEN 0 THEN 'Python' WHEN 1 THEN 'C' ELSE 'C++' END AS language, CASE WHEN p_size = 5 THEN 'int main() {}' ELSE p_name END AS text FROM part),
    k AS (SELECT *, CASE WHEN language = 'Python' THEN CASE path WHEN 'main.py' THEN 2 ELSE 99 END ELSE CASE lower(path) WHEN 'main.c' THEN 1 WHEN 'main.cpp' THEN 2 ELSE CASE WHEN contains(text, 'int main') THEN 50 ELSE 99 END END END AS rank FROM f)
    SELECT language, path FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY rank, path) AS n, count(*) OVER (PARTITION BY language) AS total FROM k) WHERE n = 1 AND (rank < 99 OR total = 1)""")
def entry_points(spark, sf_dir):
    """The program to run in each language."""
    k = F.col("p_partkey")
    kind = lambda a, b, c: F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise(c)
    stem = F.when(k % 50 == 7, "main").when(k % 50 == 9, "Main").otherwise(F.concat(F.lit("f"), k.cast("string")))
    files = S.table(spark, sf_dir, "part").select(F.concat(stem, kind(".py", ".c", ".cpp")).alias("path"), kind("Python", "C", "C++").alias("language"), F.when(F.col("p_size") == 5, "int main() {}").otherwise(F.col("p_name")).alias("text"))
    return SF.entry_points(files)


_PATHS = """CASE p_partkey % 9 WHEN 0 THEN 'src/a' || p_size || '.py' WHEN 1 THEN 'node_modules/b.js' WHEN 2 THEN 'src/c.PNG' WHEN 3 THEN 'logs/' || p_size || '.log' WHEN 4 THEN 'logs/keep.log'
    WHEN 5 THEN 'tmp/d' || p_size || '.py' WHEN 6 THEN 'src/tmp' WHEN 7 THEN 'only.txt' ELSE 'src/only.txt' END"""
_PATTERNS = ["*.log", "!keep.log", "tmp/", "/only.txt"]


@query(f"""WITH f AS (SELECT p_partkey, {_PATHS} AS path FROM part)
    SELECT p_partkey, path, starts_with(path, 'node_modules/') OR ends_with(lower(path), '.png') OR (ends_with(path, '.log') AND path <> 'logs/keep.log') OR starts_with(path, 'tmp/') OR path = 'only.txt' AS ignored FROM f""")
def ignored_paths(spark, sf_dir):
    """Fixed tables and gitignore patterns, the last match deciding."""
    part = S.table(spark, sf_dir, "part").select("p_partkey", F.expr(_PATHS).alias("path"))
    return part.select("p_partkey", "path", SF.is_ignored(F.col("path"), _PATTERNS).alias("ignored"))


@query("""WITH d AS (SELECT doc_id, lang AS language, source || '/' || doc_id AS path, sha256(text) AS key, sha256(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS old, doc_id % 2 = 0 AS held FROM documents)
    SELECT count(*) FILTER (WHERE held AND key = old AND language IS NOT NULL AND path IS NOT NULL) AS hits, count(*) - hits AS misses FROM d""")
def cache_counts(spark, sf_dir):
    """Files whose parse is kept, and files that changed or are new."""
    files = S.files(spark, sf_dir).withColumn("doc_id", F.regexp_extract("path", r"(\d+)$", 1).cast("long"))
    parsed = files.filter("doc_id % 2 = 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return facade.cache_counts(files, parsed.select("language", "path", T.content_key(F.col("text")).alias("content_key")))


_LABELLED = "n AS (SELECT p_name AS label, p_partkey AS id, CASE WHEN p_size > 25 THEN p_brand END AS file FROM part)"


@query(f"""WITH {_LABELLED}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY file IS NULL, id) AS r FROM n)
    SELECT s_suppkey, w.label, k.id, k.file FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN s_name ELSE (SELECT p_name FROM part WHERE p_partkey = s_suppkey) END AS label FROM supplier) w LEFT JOIN k ON k.label = w.label AND r = 1""")
def labelled_nodes(spark, sf_dir):
    """Node of each label: the first with a file, else the first."""
    part = S.table(spark, sf_dir, "part")
    nodes = part.select(F.col("p_name").alias("label"), F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("file"), F.col("p_size").alias("line"), F.col("p_partkey").alias("ord"))
    names = part.select(F.col("p_partkey").alias("s_suppkey"), "p_name")
    labels = S.table(spark, sf_dir, "supplier").join(names, "s_suppkey", "left").select("s_suppkey", F.when(F.col("s_suppkey") % 5 == 0, F.col("s_name")).otherwise(F.col("p_name")).alias("label"))
    return R.first_labelled(labels, nodes).select("s_suppkey", "label", "node.id", "node.file")


@query(r"""WITH u AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN ' python ' WHEN 1 THEN 'C++' WHEN 2 THEN 'c' ELSE 'java' END AS lang, CASE page_id % 3 WHEN 0 THEN 'a.b.C.run' WHEN 1 THEN 'run' ELSE 'C.run' END AS q,
        CASE page_id % 3 WHEN 0 THEN ' ' || page_id || ' ' WHEN 1 THEN page_id || 'x' ELSE '' END AS num, CASE page_id % 3 WHEN 0 THEN '<dir/x.h>' WHEN 1 THEN '"y.h"' ELSE 'z.h' END AS inc,
        CASE page_id % 5 WHEN 0 THEN 'tests_a.py' WHEN 1 THEN 'src/A_Test.py' WHEN 2 THEN 'pkg/tests/t.c' WHEN 3 THEN 'test_main.c' ELSE 'src/contest.py' END AS path, CAST(page_id * page_id * page_id * 977 - 976 AS DOUBLE) AS b FROM pages)
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Python' WHEN 1 THEN 'C++' WHEN 2 THEN 'C' END AS language, CASE page_id % 3 WHEN 0 THEN 'a.b.C' WHEN 1 THEN '' ELSE 'C' END AS owner, split_part(q, '.', -1) AS simple,
        CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS INTEGER) END AS number, right(repeat(url, 12), 300) AS short, url = 'http://a' OR starts_with(url, 'http://a/') OR url = regexp_extract(url, '^https?://[^/]+') OR starts_with(url, regexp_extract(url, '^https?://[^/]+') || '/') AS inside,
        regexp_replace(split_part(path || '.ZIP', '/', -1), '(?i)\.zip$', '') AS archive, regexp_replace(split_part(regexp_replace(url || '/x.git//', '/+$', ''), '/', -1), '\.git$', '') AS repository,
        regexp_replace(regexp_replace(inc, '^[<"]', ''), '[>"]$', '') AS include, regexp_full_match(q, '[A-Za-z_]\w*') AS identifier, contains(html, 'int main') AS has_main,
        CAST(greatest(0.2, 1 - 0.2 * (page_id % 9)) AS DOUBLE) AS linear, CAST(CASE page_id % 5 WHEN 1 THEN 1.0 WHEN 2 THEN 0.7 WHEN 3 THEN 0.5 END AS DOUBLE) AS stepped,
        CASE page_id % 3 WHEN 0 THEN 'Call Graph' WHEN 1 THEN 'Stack Trace' ELSE 'Other Thing' END AS artifact,
        CASE WHEN b < 0 THEN '—' WHEN b < 1024 THEN printf('%.0f B', b) WHEN b < 10240 THEN printf('%.1f KB', b / 1024) WHEN b < 1048576 THEN printf('%.0f KB', b / 1024) WHEN b < 10485760 THEN printf('%.1f MB', b / 1048576)
            WHEN b < 1073741824 THEN printf('%.0f MB', b / 1048576) WHEN b < 10737418240 THEN printf('%.1f GB', b / 1073741824) ELSE printf('%.0f GB', b / 1073741824) END AS size,
        CASE WHEN page_id % 7 = 6 THEN '—' WHEN page_id % 7 + page_id / 1001 < 1 THEN printf('%.0f ms', page_id / 1001 * 1000) ELSE printf('%.2f s', page_id % 7 + page_id / 1001) END AS duration, printf('%.3f', page_id / 1001) AS score,
        CASE WHEN page_id % 3 = 0 THEN strftime(TIMESTAMP '2026-01-01 00:00:07' + to_hours(page_id * 5), '%-m/%-d/%Y, %-I:%M:%S %p') ELSE url END AS date,
        CASE WHEN length(url) > 18 THEN substr(url, 1, 17) || '…' ELSE url END AS brief,
        CASE WHEN length(url) > 20 THEN substr(url, 1, 20) || chr(10) || '... [truncated]' ELSE url END AS cut, page_id % 5 IN (0, 1, 3) AS python_test, page_id % 5 IN (2, 3) AS compiled_test FROM u JOIN pages USING (page_id, url)""")
def text_functions(spark, sf_dir):
    """The scalar functions on names, paths and report text, over all pages."""
    p, col = S.table(spark, sf_dir, "pages"), F.col
    pick = lambda n, *values: F.element_at(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), (col("page_id") % n + 1).cast("int"))
    number = col("page_id").cast("string")
    hours = F.to_timestamp(F.lit("2026-01-01 00:00:07")) + F.make_interval(hours=(col("page_id") * 5).cast("int"))
    day = F.when(col("page_id") % 3 == 0, F.date_format(hours, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(col("url"))
    u = p.withColumns({
        "lang": pick(4, " python ", "C++", "c", "java"), "q": pick(3, "a.b.C.run", "run", "C.run"), "num": pick(3, F.concat(F.lit(" "), number, F.lit(" ")), F.concat(number, F.lit("x")), F.lit("")),
        "inc": pick(3, "<dir/x.h>", '"y.h"', "z.h"), "path": pick(5, "tests_a.py", "src/A_Test.py", "pkg/tests/t.c", "test_main.c", "src/contest.py"),
        "source": pick(3, "call_graph", "stack_trace", "other_thing"),
    })
    return u.select(
        "page_id", T.resolve_language(col("lang")).alias("language"), T.owner_name(col("q")).alias("owner"), T.simple_name(col("q")).alias("simple"), T.safe_int(col("num")).alias("number"),
        T.short_path(F.repeat("url", 12)).alias("short"), T.within(col("url"), F.regexp_extract("url", "^https?://[^/]+", 0)).alias("inside"), T.archive_name(F.concat("path", F.lit(".ZIP"))).alias("archive"),
        T.repository_name(F.concat("url", F.lit("/x.git//"))).alias("repository"), T.include_name(col("inc")).alias("include"), T.is_identifier(col("q")).alias("identifier"), T.defines_main(col("html")).alias("has_main"),
        T.linear_score(col("page_id") % 9, "0.2", "0.2").cast("double").alias("linear"), T.step_score(col("page_id") % 5, Z.CALLER_SCORES).cast("double").alias("stepped"), T.artifact_name(col("source")).alias("artifact"),
        T.format_bytes(col("page_id") * col("page_id") * col("page_id") * 977 - 976).alias("size"),
        T.format_duration(F.when(col("page_id") % 7 == 6, -1.0).otherwise(col("page_id") % 7 + col("page_id") / 1001.0)).alias("duration"), T.format_score(col("page_id") / 1001.0).alias("score"), T.format_date(day).alias("date"), T.shortened(col("url"), 18).alias("brief"), T.truncated(col("url"), 20).alias("cut"), T.is_python_test(col("path")).alias("python_test"), T.is_compiled_test(col("path")).alias("compiled_test"),
    )


@query(f"""WITH {SOURCES}
    SELECT count(*) AS file_count, count(*) AS source_file_count, CAST(sum(bytes) AS BIGINT) AS total_size_bytes, 'Python,C' AS languages FROM (
        SELECT path, sum(b) + sum(gap) AS bytes FROM (
            SELECT path, length(module) + CASE WHEN ends_with(path, '.py') THEN 7 ELSE 11 END AS b, 1 AS gap FROM heads
            UNION ALL SELECT path, CASE WHEN python AND what = 'function' THEN length(name) + 3 * length(x) + length(call) + 54 WHEN python AND what = 'class' THEN length(name || ((k * 7) % 45) || (k % 7)) + 56
                WHEN python THEN length(name || e2.line) + 4 WHEN what = 'function' THEN length(name || 'fn' || ((k * 3) % 40)) + 41 WHEN what = 'class' THEN length(name) + 27 ELSE length(name || e2.line) + 9 END,
                CASE WHEN k = max(k) OVER (PARTITION BY path) THEN 0 ELSE 1 END FROM placed JOIN (SELECT p_partkey AS k, p_size AS line FROM part) e2 USING (k))
        GROUP BY path)""")
def project_summary(spark, sf_dir):
    """Files, bytes and languages of the written program."""
    files = P.sources(spark, sf_dir).withColumn("size_bytes", F.octet_length("text").cast("long"))
    return facade.project_summary(files).withColumn("languages", F.array_join("languages", ","))


@query(f"""WITH {BASE}, {RUNTIME}
    SELECT (SELECT count(*) FROM (SELECT id FROM base UNION SELECT node FROM lk UNION SELECT 'exception::' || language || '::Error' || (k % 3) FROM thrown)) AS node_count,
        'ast,dependency,callgraph,cfg,dataflow,runtime' AS sources, '' AS missing_sources""")
def knowledge_summary(spark, sf_dir):
    found = facade.knowledge_summary(_graph(spark, sf_dir))
    return found.select("node_count", F.array_join("sources", ",").alias("sources"), F.array_join("missing_sources", ",").alias("missing_sources"))


@query(f"""WITH {ENTITIES},
    ev AS (SELECT DISTINCT l_orderkey || CASE WHEN ends_with(path, '.c') THEN 'C' ELSE 'Python' END AS run_id, CASE WHEN ends_with(path, '.c') THEN 'C' ELSE 'Python' END AS language,
        l_linenumber * 1048576 + k AS seq, name AS function, '/srv/' || path AS filename, k FROM lineitem JOIN e ON k = l_partkey WHERE what = 'function'),
    la AS (SELECT run_id, max(seq) AS seq FROM ev GROUP BY run_id), x AS (SELECT ev.* FROM ev JOIN la USING (run_id, seq) WHERE k % 5 = 0),
    j AS (SELECT run_id, seq, '{{"language":"' || language || '","type":"call","function":"' || function || '","filename":"' || filename || '"}}' AS t FROM ev
        UNION ALL SELECT run_id, seq + 1, '{{"language":"' || language || '","type":"exception","function":"' || function || '","filename":"' || filename || '","exception":"Error' || (k % 3) || ': part ' || k || '"}}' FROM x)
    SELECT j.run_id, '{{"events":[' || string_agg(t, ',' ORDER BY j.seq) || '],"last_exception":' || coalesce(max('{{"type":"Error' || (x.k % 3) || '","message":"part ' || x.k || '"}}'), 'null') || '}}' AS document
    FROM j LEFT JOIN x USING (run_id) GROUP BY j.run_id""")
def trace_documents(spark, sf_dir):
    """Every recorded run as one JSON document."""
    return recordings.trace_documents(P.recorded(spark, sf_dir)[0])


@query(f"""WITH {ENTITIES},
    ev AS (SELECT DISTINCT l_orderkey || CASE WHEN ends_with(path, '.c') THEN 'C' ELSE 'Python' END AS run_id, l_linenumber * 1048576 + k AS pos, name AS function, '/srv/' || path AS filename, k FROM lineitem JOIN e ON k = l_partkey WHERE what = 'function'),
    la AS (SELECT run_id, max(pos) AS pos FROM ev GROUP BY run_id),
    j AS (SELECT run_id, pos, 'call' AS type, function, filename, NULL AS exception FROM ev
        UNION ALL SELECT run_id, pos + 1, 'exception', function, filename, 'Error' || (k % 3) || ': part ' || k FROM ev JOIN la USING (run_id, pos) WHERE k % 5 = 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos) - 1 AS seq FROM j)
    SELECT run_id, seq, type, function, filename, CAST(pos % 1000 AS INTEGER) AS lineno, exception FROM n WHERE pos % 7 <> 0 AND seq < 5 AND run_id NOT LIKE '%99Python'""")
def read_back_traces(spark, sf_dir):
    """Every recorded run, written as a document and read again: the first five events, less those without a line; some documents are cut off."""
    events = P.recorded(spark, sf_dir)[0].withColumn("lineno", F.when(F.col("seq") % 7 != 0, (F.col("seq") % 1000).cast("int")))
    cut = F.when(F.col("run_id").endswith("99Python"), F.expr("substring(document, 1, 30)")).otherwise(F.col("document"))
    found = recordings.traces_of(recordings.trace_documents(events).withColumn("document", cut), 5)
    return found.select("run_id", "seq", "type", "function", "filename", "lineno", "exception")


@query(f"""WITH {ENTITIES},
    ev AS (SELECT DISTINCT CASE WHEN ends_with(path, '.c') THEN 'C' ELSE 'Python' END AS run_id, l_orderkey AS o, l_linenumber * 1048576 + k AS pos, name AS function, '/srv/' || path AS filename, k FROM lineitem JOIN e ON k = l_partkey WHERE what = 'function'),
    la AS (SELECT run_id, o, max(pos) AS pos FROM ev GROUP BY run_id, o),
    j AS (SELECT run_id, o, pos, 'call' AS type, function, filename, NULL AS exception FROM ev
        UNION ALL SELECT run_id, o, pos + 1, 'exception', function, filename, 'Error' || (k % 3) || ': part ' || k FROM ev JOIN la USING (run_id, o, pos) WHERE k % 5 = 0)
    SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY o, pos) - 1 AS seq, type, function, filename, CAST(pos % 1000 AS INTEGER) AS lineno, exception FROM j""")
def long_traces(spark, sf_dir):
    """All recorded runs of a language as one run, written as a document in parts and read back piece by piece."""
    order = F.regexp_extract("run_id", r"^(\d+)", 1).cast("long")
    lineno = (F.col("seq") % 1000).cast("int")
    events = P.recorded(spark, sf_dir)[0].select(F.col("language").alias("run_id"), (order * (1 << 24) + F.col("seq")).alias("seq"), "type", "function", "filename", lineno.alias("lineno"), "exception")
    folder = f"{shared_folder(spark)}/traces_{uuid.uuid4().hex}"
    LT.write_trace_parts(LT.trace_parts(events), folder)
    return LT.read_long_traces(spark, folder, folders=True).select("run_id", "seq", "type", "function", "filename", "lineno", "exception")


@query("SELECT 'a' || (doc_id // 50) AS archive, doc_id || '.txt' AS path, strlen(coalesce(text, '')) AS size_bytes, md5(coalesce(text, '')) AS digest FROM documents")
def archived_files(spark, sf_dir):
    """Documents, packed into zip archives of up to fifty, and the archives' members."""
    docs = S.table(spark, sf_dir, "documents")
    name = F.concat(F.lit("a"), F.floor(F.col("doc_id") / 50).cast("string"))
    texts = docs.select(name.alias("archive"), F.concat(F.lit("texts/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    archives = texts.groupBy("archive").applyInPandas(packed, "path string, content binary").withColumn("length", F.octet_length("content").cast("long"))
    return SF.members_of(archives).select("archive", "path", "size_bytes", F.md5("content").alias("digest"))


@query(f"""WITH {ENTITIES},
    sized AS (SELECT e.* EXCLUDE (line, path), regexp_replace(path, '[.][a-z]+$', '.cpp') AS path, CASE what WHEN 'function' THEN 6 WHEN 'class' THEN 11 ELSE 5 END AS n FROM e),
    placed AS (SELECT *, CAST(sum(n) OVER (PARTITION BY path ORDER BY k) - n AS INTEGER) AS before FROM sized)
    SELECT path, 'function' AS what, name, before + 2 AS line, '*a,b[2][3],&c call' || (k % 7) || ',put' || (k % 5) AS detail FROM placed WHERE what = 'function'
    UNION ALL SELECT path, 'class', name, before + 2, 'Base' || (k % 9) || '<int, char>,Plain' FROM placed WHERE what = 'class'
    UNION ALL SELECT path, 'class', 'In' || (k % 4), before + 8, '' FROM placed WHERE what = 'class'
    UNION ALL SELECT path, 'method', name, before + 4, 'x get' || (k % 3) || ',start' FROM placed WHERE what = 'class'
    UNION ALL SELECT path, 'method', 'fn' || (k % 7), before + 5, '*const name,(*back)(int) ' FROM placed WHERE what = 'class'
    UNION ALL SELECT path, 'method', 'operator==', before + 6, '&o same' FROM placed WHERE what = 'class'
    UNION ALL SELECT path, 'variable', name, before + 5, '' FROM placed WHERE what = 'variable'""")
def native_symbols(spark, sf_dir):
    """What the scanner finds in the parts written out as C++."""
    return _symbols(facade.analysis(P.native_sources(spark, sf_dir)))
