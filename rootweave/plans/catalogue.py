"""Registered queries over the star-schema tables and their SQL counterparts.

Each query applies one operator (or a few) to a view of whole tables; the SQL states the same result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rootweave.functions import text as T
from rootweave.operators import evidence as E
from rootweave.operators import graph as G
from rootweave.operators import listing as L
from rootweave.operators import resolve as R
from rootweave.operators import trace as X
from rootweave.operators import traverse as V
from rootweave.plans import project_queries  # noqa: F401  (registers its queries)
from rootweave.plans import views as S
from rootweave.plans.register import QUERIES, SQL, Query, query

#: Event types as evidence sources, with weights that sum to one.
EVENT_WEIGHTS = {"error": "0.30", "purchase": "0.25", "signup": "0.20", "click": "0.15", "view": "0.10"}

_TRACE = r"""
    t AS (
        SELECT user_id AS run_id, ts, event_id, CAST(regexp_extract(props, '"k":\s*(\d+)', 1) AS INT) AS k,
               CASE event_type WHEN 'click' THEN 'call' WHEN 'purchase' THEN 'return' WHEN 'error' THEN 'exception' ELSE 'line' END AS type,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq
        FROM events),
    trace AS (
        SELECT *, 'fn' || (k % 12) AS function, 'm' || (k % 5) || '.py' AS filename, 'm' || (k % 5) || '.py::fn' || (k % 12) AS node_id,
               CASE WHEN type = 'exception' THEN 'Error' || (k % 7) || CASE WHEN k % 3 = 0 THEN '' ELSE ': code ' || k END END AS exception
        FROM t)"""
_DEPTH = """
    d AS (SELECT *, CASE type WHEN 'call' THEN 1 WHEN 'return' THEN -1 ELSE 0 END AS delta FROM trace),
    s AS (SELECT *, sum(delta) OVER (PARTITION BY run_id ORDER BY seq) AS s FROM d),
    a AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY run_id ORDER BY seq)) AS after FROM s),
    steps AS (SELECT *, CAST(coalesce(lag(after) OVER (PARTITION BY run_id ORDER BY seq), 0) AS BIGINT) AS stack_depth FROM a)"""
_CALLS, _START = project_queries.CALLS, project_queries.START
_EVIDENCE = "ev AS (SELECT user_id AS node, event_type AS source, CAST(least(1.0, greatest(0.0, max(value) / 100)) AS DECIMAL(5,4)) AS score FROM events GROUP BY ALL)"


@query(f"WITH {_TRACE}, {_DEPTH} SELECT run_id, event_id, type, seq AS index, seq + 1 AS position, count(*) OVER (PARTITION BY run_id) AS total, stack_depth, lag(seq) OVER (PARTITION BY run_id ORDER BY seq) AS previous_index, lead(seq) OVER (PARTITION BY run_id ORDER BY seq) AS next_index FROM steps")
def replay_steps(spark, sf_dir):
    """Stack depth and links of every event."""
    return X.replay_steps(S.trace(spark, sf_dir)).select("run_id", "event_id", "type", "index", "position", "total", "stack_depth", "previous_index", "next_index")


@query(f"WITH {_TRACE} SELECT run_id, type, count(*) AS n FROM trace GROUP BY ALL")
def replay_counts(spark, sf_dir):
    return X.counts_by_type(S.trace(spark, sf_dir))


@query(f"WITH {_TRACE} SELECT run_id, min(seq) AS first_index, max(seq) AS last_index FROM trace GROUP BY run_id")
def replay_bounds(spark, sf_dir):
    return X.bounds(S.trace(spark, sf_dir))


@query(f"WITH {_TRACE}, {_DEPTH} SELECT run_id, max(stack_depth) AS max_depth FROM steps GROUP BY run_id")
def max_stack_depth(spark, sf_dir):
    return X.max_stack_depth(S.trace(spark, sf_dir))


@query(f"WITH {_TRACE}, m AS (SELECT * FROM trace WHERE type = 'call' AND contains(function, 'fn1')) SELECT run_id, seq AS index, function, (SELECT count(*) FROM m) AS total_matched FROM m ORDER BY run_id, seq LIMIT 50 OFFSET 20")
def replay_page(spark, sf_dir):
    """The second page of matching events; the limit is the page."""
    found = X.matching(S.trace(spark, sf_dir), "call", "fn1").select("run_id", F.col("seq").alias("index"), "function")
    return X.page(found, ["run_id", "index"], 20, 50)


@query(f"WITH {_TRACE} SELECT run_id, node_id, min(seq) AS first_seq FROM trace WHERE type = 'call' GROUP BY ALL")
def executed_order(spark, sf_dir):
    return X.executed_order(X.matching(S.trace(spark, sf_dir), "call"))


@query(f"WITH {_TRACE} SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY seq) - 1 AS place, function FROM trace WHERE type = 'call'")
def function_order(spark, sf_dir):
    """Functions in order of their calls, repeats kept."""
    return X.function_order(S.trace(spark, sf_dir))


@query(f"WITH {_TRACE}, c AS (SELECT *, lag(node_id) OVER (PARTITION BY run_id ORDER BY seq) AS b FROM trace WHERE type = 'call') SELECT run_id, seq AS index, node_id FROM c WHERE node_id IS DISTINCT FROM b")
def execution_sequence(spark, sf_dir):
    return X.execution_sequence(X.matching(S.trace(spark, sf_dir), "call")).select("run_id", F.col("seq").alias("index"), "node_id")


@query(f"WITH {_TRACE}, c AS (SELECT *, lag(node_id) OVER (PARTITION BY run_id ORDER BY seq) AS b FROM trace WHERE type = 'call') SELECT DISTINCT run_id, b AS source, node_id AS target FROM c WHERE b IS NOT NULL AND b <> node_id")
def executes_after(spark, sf_dir):
    return X.executes_after(X.matching(S.trace(spark, sf_dir), "call"))


@query(f"WITH {_TRACE}, e AS (SELECT run_id, max(seq) AS index, arg_max(function, seq) AS function, arg_max(exception, seq) AS x FROM trace WHERE type = 'exception' GROUP BY run_id) SELECT run_id, index, function, split_part(x, ': ', 1) AS exception_type, CASE WHEN strpos(x, ': ') > 0 THEN substr(x, strpos(x, ': ') + 2) ELSE x END AS exception_message FROM e")
def last_exception(spark, sf_dir):
    return X.last_exception(S.trace(spark, sf_dir))


def _part_graph(spark, sf_dir):
    kinds = {"part": "function", "supplier": "module", "nation": "project"}
    part = S.table(spark, sf_dir, "part").select(F.concat(F.lit("part::"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("label"))
    supplier = S.table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier::"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("label"))
    nation = S.table(spark, sf_dir, "nation").select(F.concat(F.lit("nation::"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("label"))
    return kinds, part, supplier, nation


@query("SELECT 'part::' || l_partkey AS id, 'function' AS kind, min(l_orderkey) AS ord FROM lineitem GROUP BY ALL UNION ALL SELECT 'supplier::' || l_suppkey, 'module', min(l_orderkey) FROM lineitem GROUP BY ALL")
def graph_nodes(spark, sf_dir):
    """First insertion of every node that line items mention."""
    items = S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    ends = F.explode(F.array(
        F.struct(F.concat(F.lit("part::"), F.col("l_partkey").cast("string")).alias("id"), F.lit("function").alias("kind")),
        F.struct(F.concat(F.lit("supplier::"), F.col("l_suppkey").cast("string")).alias("id"), F.lit("module").alias("kind")),
    ))
    rows = items.select(ends.alias("e"), F.col("l_orderkey").alias("ord")).select("e.id", "e.kind", "ord")
    return G.distinct_nodes(rows)


@query("SELECT 'supplier::' || l_suppkey AS source, 'part::' || l_partkey AS target, 'defines' AS kind, min(l_orderkey) AS ord FROM lineitem GROUP BY ALL")
def graph_edges(spark, sf_dir):
    items = S.table(spark, sf_dir, "lineitem")
    rows = items.select(F.concat(F.lit("supplier::"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("part::"), F.col("l_partkey").cast("string")).alias("target"), F.lit("defines").alias("kind"), F.col("l_orderkey").alias("ord"))
    return G.distinct_edges(rows)


@query("SELECT kind, count(*) AS n FROM (SELECT 'function' AS kind FROM part UNION ALL SELECT 'module' FROM supplier UNION ALL SELECT 'project' FROM nation) GROUP BY kind")
def node_kinds(spark, sf_dir):
    kinds, part, supplier, nation = _part_graph(spark, sf_dir)
    rows = part.withColumn("kind", F.lit(kinds["part"])).unionByName(supplier.withColumn("kind", F.lit(kinds["supplier"]))).unionByName(nation.withColumn("kind", F.lit(kinds["nation"])))
    return G.kind_counts(rows)


@query(f"WITH {_CALLS} SELECT 'calls' AS kind, count(*) AS n FROM edges UNION ALL SELECT 'defines', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)")
def edge_kinds(spark, sf_dir):
    calls = S.call_edges(spark, sf_dir).withColumn("kind", F.lit("calls"))
    defines = S.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).distinct().withColumn("kind", F.lit("defines"))
    return G.kind_counts(calls.unionByName(defines))


@query(f"""WITH {_CALLS},
    f AS (SELECT p_brand AS module, p_name AS name, CAST(p_partkey AS VARCHAR) AS id FROM part),
    c AS (SELECT source, target, a.p_brand AS module, CASE WHEN target % 3 = 0 THEN 'self.' || b.p_name ELSE b.p_name END AS call
          FROM edges JOIN part a ON a.p_partkey = source JOIN part b ON b.p_partkey = target),
    k AS (SELECT *, regexp_replace(call, '^self\\.', '') AS name FROM c),
    own AS (SELECT module, name, count(*) AS n, min(id) AS id FROM f GROUP BY ALL),
    alln AS (SELECT name, count(*) AS n FROM f GROUP BY ALL),
    calls AS (SELECT DISTINCT module, call, name FROM k)
    SELECT calls.module, calls.call, coalesce(CASE WHEN own.n = 1 THEN own.id END,
        CASE WHEN call NOT LIKE 'self.%' AND alln.n - coalesce(own.n, 0) = 1 THEN (SELECT min(f.id) FROM f WHERE f.name = calls.name AND f.module <> calls.module) END,
        'external::' || call) AS target
    FROM calls LEFT JOIN own USING (module, name) LEFT JOIN alln USING (name)""")
def call_resolution(spark, sf_dir):
    part = S.table(spark, sf_dir, "part")
    functions = part.select(F.col("p_brand").alias("module"), F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("id"))
    caller = part.select(F.col("p_partkey").alias("source"), F.col("p_brand").alias("module"))
    callee = part.select(F.col("p_partkey").alias("target"), F.col("p_name").alias("call"))
    call = F.when(F.col("target") % 3 == 0, F.concat(F.lit("self."), "call")).otherwise(F.col("call"))
    calls = S.call_edges(spark, sf_dir).join(caller, "source").join(callee, "target").select("module", call.alias("call")).distinct()
    return R.resolve_calls(calls, functions)


_URL = "regexp_extract(url, '^https?://([^?#]+)', 1)"


@query(f"""WITH u AS (SELECT page_id, {_URL} AS ref FROM pages),
    idx AS (SELECT DISTINCT unnest([split_part(ref, '/', 1), split_part(ref, '/', 1) || '/' || split_part(ref, '/', 2)]) AS path FROM u),
    p AS (SELECT page_id, ref, unnest(range(1, len(string_split(ref, '/')) + 1)) AS n FROM u),
    q AS (SELECT page_id, ref, n, array_to_string(list_slice(string_split(ref, '/'), 1, n), '/') AS path FROM p)
    SELECT page_id, ref, arg_max(path, n) AS target FROM q JOIN idx USING (path) GROUP BY ALL""")
def import_longest_prefix(spark, sf_dir):
    refs = S.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^?#]+)", 1).alias("ref"))
    segments = F.split("ref", "/")
    index = refs.select(F.explode(F.array(segments[0], F.concat(segments[0], F.lit("/"), F.coalesce(F.get(segments, F.lit(1)), F.lit(""))))).alias("path"))
    return R.resolve_longest_prefix(refs, index)


@query(f"""WITH {_TRACE},
    f AS (SELECT DISTINCT lower(p_type) || '/m' || (p_partkey % 5) || '.py' AS file, 'fn' || (p_size % 12) AS name FROM part),
    r AS (SELECT DISTINCT 'Python' AS language, filename, function FROM trace),
    j AS (SELECT r.*, file || '::' || name AS id FROM r JOIN f ON name = function AND (file = filename OR ends_with(file, '/' || filename) OR ends_with(filename, '/' || file))),
    one AS (SELECT filename, function, min(id) AS id FROM j GROUP BY ALL HAVING count(*) = 1)
    SELECT language, filename, function, coalesce(id, 'runtime::' || language || '::' || filename || '::' || function) AS node_id FROM r LEFT JOIN one USING (filename, function)""")
def path_suffix_link(spark, sf_dir):
    part = S.table(spark, sf_dir, "part")
    functions = part.select(F.concat(F.lower("p_type"), F.lit("/m"), (F.col("p_partkey") % 5).cast("string"), F.lit(".py")).alias("file"), F.concat(F.lit("fn"), (F.col("p_size") % 12).cast("string")).alias("name")).distinct()
    functions = functions.withColumn("id", F.concat_ws("::", "file", "name"))
    refs = S.trace(spark, sf_dir).select(F.lit("Python").alias("language"), "filename", "function").distinct()
    return R.link_runtime(refs, functions)


def _most_called(edges):
    return edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")


@query(f"""WITH RECURSIVE {_CALLS}, {_START},
    r(node, depth) AS (SELECT id, 0 FROM start UNION SELECT edges.source, r.depth + 1 FROM r JOIN edges ON edges.target = r.node WHERE r.depth < 3)
    SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r WHERE node NOT IN (SELECT id FROM start) GROUP BY node""")
def caller_depths(spark, sf_dir):
    """Callers of the most-called part within three steps."""
    edges = S.call_edges(spark, sf_dir)
    return V.reverse_depths(edges, _most_called(edges))


@query(f"""WITH RECURSIVE {_CALLS}, {_START},
    r(node) AS (SELECT id FROM start UNION SELECT edges.target FROM r JOIN edges ON edges.source = r.node)
    SELECT node FROM r""")
def reachable_nodes(spark, sf_dir):
    edges = S.call_edges(spark, sf_dir)
    return V.reachable(edges, _most_called(edges))


@query(f"""WITH {_EVIDENCE}, w(source, weight) AS (VALUES ('error', CAST(0.30 AS DECIMAL(5,4))), ('purchase', 0.25), ('signup', 0.20), ('click', 0.15), ('view', 0.10))
    SELECT node, CAST(round(sum(score * weight), 4) AS DOUBLE) AS score FROM ev JOIN w USING (source) GROUP BY node""")
def evidence_fusion(spark, sf_dir):
    return E.fuse(S.evidence(spark, sf_dir), EVENT_WEIGHTS)


@query(f"""WITH {_EVIDENCE}, o(source, r) AS (VALUES ('error', 1), ('purchase', 2), ('signup', 3), ('click', 4), ('view', 5)),
    k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, r) AS n FROM ev JOIN o USING (source))
    SELECT node, source, CAST(score AS DOUBLE) AS score FROM k WHERE n = 1""")
def best_evidence(spark, sf_dir):
    return E.best(S.evidence(spark, sf_dir), tuple(EVENT_WEIGHTS)).withColumn("score", F.col("score").cast("double"))


@query(f"""WITH {_EVIDENCE}, w(source, weight) AS (VALUES ('error', CAST(0.30 AS DECIMAL(5,4))), ('purchase', 0.25), ('signup', 0.20), ('click', 0.15), ('view', 0.10)),
    f AS (SELECT node, CAST(round(sum(score * weight), 4) AS DOUBLE) AS score FROM ev JOIN w USING (source) GROUP BY node),
    g AS (SELECT c_nationkey AS run_id, node, score FROM f JOIN customer ON c_custkey = node)
    SELECT run_id, node, score, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, node) AS rank FROM g""")
def candidate_rank(spark, sf_dir):
    """Users ranked inside their nation."""
    nation = S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("run_id"))
    return L.ranked(E.fuse(S.evidence(spark, sf_dir), EVENT_WEIGHTS).join(nation, "node").select("run_id", "node", "score"))


@query("""WITH known AS (SELECT user_id AS node, s AS source FROM (SELECT DISTINCT user_id FROM events), (VALUES ('error'), ('purchase'), ('signup'), ('click'), ('view')) v(s))
    SELECT node, source FROM known WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = node AND event_type = source AND date_part('hour', ts) < 6)""")
def missing_sources(spark, sf_dir):
    """Event types that a user shows in no night hour."""
    events = S.table(spark, sf_dir, "events")
    known = events.select(F.col("user_id").alias("node")).distinct().select("node", F.explode(F.array(*[F.lit(s) for s in EVENT_WEIGHTS])).alias("source"))
    night = events.filter(F.hour("ts") < 6).select(F.col("user_id").alias("node"), F.col("event_type").alias("source"))
    return E.missing_sources(night, known, ["node"])


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderstatus = 'F')
    SELECT o_custkey AS project_id, o_orderkey AS id, o_orderdate AS updated_at FROM r WHERE n = 1""")
def latest_ready(spark, sf_dir):
    return L.latest_ready(S.runs(spark, sf_dir)).select("project_id", "id", "updated_at")


@query("SELECT o_custkey AS project_id, o_orderkey AS id, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def newest_first(spark, sf_dir):
    """The twenty newest runs; the limit is the feature."""
    return L.newest_first(S.runs(spark, sf_dir), 20).select("project_id", "id", "created_at")


@query("SELECT CASE o_orderstatus WHEN 'O' THEN 'queued' ELSE 'running' END AS status, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL")
def active_jobs(spark, sf_dir):
    return L.active(S.runs(spark, sf_dir)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_CASES = """c AS (SELECT lang AS language, n_chars AS chars, CASE WHEN quality = 1 AND doc_id % 29 = 3 THEN 'no link for ' || lang END AS suite_error,
        CASE WHEN quality = 1 AND toxic = 0 THEN 'passed' WHEN quality = 1 AND toxic = 1 THEN 'skipped' WHEN toxic = 1 THEN 'error' ELSE 'failed' END AS outcome
    FROM labels JOIN documents USING (doc_id)),
    s AS (SELECT language, count(*) FILTER (WHERE outcome = 'passed') AS passed, count(*) FILTER (WHERE outcome IN ('failed', 'error')) AS failed,
        count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) AS total, CAST(sum(chars) AS DOUBLE) / 1000 AS duration_seconds, max(suite_error) AS error FROM c GROUP BY language)"""


@query(f"WITH {_CASES} SELECT * FROM s")
def suite_counts(spark, sf_dir):
    return L.suite_counts(S.cases(spark, sf_dir), ["language"]).withColumn("duration_seconds", F.col("duration_seconds").cast("double"))


@query(f"WITH {_CASES} SELECT CAST(sum(passed) AS BIGINT) AS passed, CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(skipped) AS BIGINT) AS skipped, CAST(sum(total) AS BIGINT) AS total, count(*) > 0 AND bool_and(failed = 0 AND error IS NULL) AS succeeded FROM s")
def suite_summary(spark, sf_dir):
    return L.suites_summary(L.suite_counts(S.cases(spark, sf_dir), ["language"]))


@query("""SELECT lang AS language, count(*) AS n_files, count(lang) AS n_source_files, CAST(sum(strlen(text)) AS BIGINT) AS total_bytes,
    CAST(sum(length(text) - length(replace(text, chr(10), '')) + CASE WHEN length(text) > 0 AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END) AS BIGINT) AS total_lines
    FROM documents GROUP BY lang""")
def language_stats(spark, sf_dir):
    return L.file_statistics(S.files(spark, sf_dir), ["language"])


@query("SELECT sha256(text) AS content_key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY ALL")
def parse_cache_keys(spark, sf_dir):
    """Content keys: how many files share one parse."""
    docs = S.table(spark, sf_dir, "documents")
    return docs.groupBy(T.content_key(F.col("text")).alias("content_key")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("""SELECT p_partkey, split_part(p_type || '/' || p_brand || '.py', '/', -1) AS base, 'Python' AS language,
    CASE WHEN p_size % 2 = 0 THEN 'm::' || p_name ELSE p_name END AS node_id,
    CASE WHEN p_size % 2 = 0 THEN 'm' ELSE p_name END AS file, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS name FROM part""")
def identifier_parts(spark, sf_dir):
    """Path and id functions over all parts."""
    part = S.table(spark, sf_dir, "part")
    path = F.concat("p_type", F.lit("\\"), "p_brand", F.lit(".PY "))
    node = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("m::"), "p_name")).otherwise(F.col("p_name"))
    rows = part.select("p_partkey", path.alias("path"), node.alias("node_id"))
    base = F.concat(F.substring_index(T.basename(F.col("path")), ".", 1), F.lit(".py"))
    return rows.select("p_partkey", base.alias("base"), T.detect_language(F.col("path")).alias("language"), "node_id", T.id_file(F.col("node_id")).alias("file"), T.id_name(F.col("node_id")).alias("name"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
