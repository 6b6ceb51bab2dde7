"""Name and path resolution joins. An index is reduced to its unique keys before it is joined, so a hot or
ambiguous name never fans out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootweave.functions.text import posix, simple_name


def unique_index(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Keys with exactly one row, and its value."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias(name))
    return counted.filter("_n = 1").drop("_n")


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Add `target` to calls(module, call, ...) over functions(module, name, id), `name` being simple.

    Priority: a unique function of the caller's module (`self.` stripped); a unique one of all other
    modules (plain names only); else `external::<call>`. An ambiguous step falls through.
    """
    bare = F.regexp_replace("call", r"^self\.", "")
    plain = ~F.col("call").startswith("self.")
    own = unique_index(functions, ["module", "name"], "id", "own_id")
    per_module = functions.groupBy("name", "module").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    ends = per_module.groupBy("name").agg(
        F.sum("n").alias("n_all"), F.min("module").alias("low"), F.max("module").alias("high"),
        F.min_by("id", "module").alias("low_id"), F.max_by("id", "module").alias("high_id"),
    )
    held = per_module.select("module", "name", F.col("n").alias("n_own"))
    found = calls.withColumn("name", bare).join(own, ["module", "name"], "left").join(held, ["module", "name"], "left").join(ends, "name", "left")
    # exactly one function elsewhere: of the least and the greatest module that hold the name, the one that is not the caller's
    lone = (F.col("n_all") - F.coalesce("n_own", F.lit(0)) == 1) & plain
    elsewhere = F.when(lone, F.when(F.col("low") == F.col("module"), F.col("high_id")).otherwise(F.col("low_id")))
    target = F.coalesce("own_id", elsewhere, F.concat(F.lit("external::"), F.col("call")))
    return found.select(*calls.columns, target.alias("target"))


def resolve_longest_prefix(refs: DataFrame, index: DataFrame, ref: str = "ref", separator: str = "/") -> DataFrame:
    """Add `target`: the longest prefix (whole segments, joined by slashes) of each reference that `index`(path) holds; null if none."""
    parts = F.split(F.col(ref), F.concat(F.lit("\\Q"), F.lit(separator), F.lit("\\E")))
    keyed = refs.withColumn("_row", F.col(ref))
    distinct = keyed.select("_row", parts.alias("_parts")).distinct()
    prefixes = distinct.select("_row", F.explode(F.sequence(F.lit(1), F.size("_parts"))).alias("_n"), "_parts")
    prefixes = prefixes.select("_row", "_n", F.array_join(F.slice("_parts", F.lit(1), F.col("_n")), "/").alias("path"))
    best = prefixes.join(index.select("path").distinct(), "path").groupBy("_row").agg(F.max_by("path", "_n").alias("target"))
    return keyed.join(best, "_row", "left").drop("_row")


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Add `target` path to imports(path, module): the file of that name, else that of the longest dotted prefix; .py may be left out."""
    index = modules.select(F.col("path").alias("target_path"), F.regexp_replace("path", r"\.py$", "").alias("path"))
    index = index.unionByName(modules.select(F.col("path").alias("target_path"), "path")).groupBy("path").agg(F.max("target_path").alias("target_path"))
    exact = index.select(F.col("path").alias("module"), F.col("target_path").alias("_exact"))
    found = resolve_longest_prefix(imports, index, "module", ".").withColumnRenamed("target", "_key")
    found = found.join(index.withColumnRenamed("path", "_key"), "_key", "left").join(exact, "module", "left")
    return found.select(*imports.columns, F.coalesce("_exact", "target_path").alias("target"))


def path_endings(path: Column) -> Column:
    """The path itself, then what follows each of its separators."""
    parts = F.split(posix(path), "/")
    return F.transform(parts, lambda _, at: F.array_join(F.slice(parts, at + 1, F.size(parts)), "/"))


def ending_index(functions: DataFrame) -> DataFrame:
    """function, path, and how many of functions(id, name, file) have it as their file (n_whole) or as an ending of it (n_part), with the least of their ids."""
    endings = functions.select("id", simple_name(F.col("name")).alias("function"), F.posexplode(path_endings(F.col("file"))).alias("at", "path"))
    whole = F.col("at") == 0
    return endings.groupBy("function", "path").agg(
        F.count_if(whole).alias("n_whole"), F.min(F.when(whole, F.col("id"))).alias("whole_id"), F.count_if(~whole).alias("n_part"), F.min(F.when(~whole, F.col("id"))).alias("part_id"),
    )


def ending_matches(refs: DataFrame, functions: DataFrame) -> DataFrame:
    """language, filename, function, n, id: for each ending of a reference's path, how many functions it matches and the least of them.

    Two paths agree where one is an ending of the other: a function's file is an ending of the reference's path (n_whole), or the whole
    reference is an ending of the file (n_part). The index has one row for a key, so there is at most one row for each ending of a reference, however
    many files share a name.
    """
    wanted = refs.select("language", "filename", "function").distinct()
    wanted = wanted.select("*", F.posexplode(path_endings(F.col("filename"))).alias("at", "path"))
    found = wanted.join(ending_index(functions), ["function", "path"])
    n = F.col("n_whole") + F.when(F.col("at") == 0, F.col("n_part")).otherwise(0)
    least = F.when(F.col("at") == 0, F.least("whole_id", "part_id")).otherwise(F.col("whole_id"))
    return found.select("language", "filename", "function", n.alias("n"), least.alias("id")).filter("n > 0")


def link_runtime(refs: DataFrame, functions: DataFrame) -> DataFrame:
    """Add `node_id` to refs(language, filename, function) over functions(id, name, file).

    Equal simple name and paths that agree at a separator; exactly one match, else a runtime id.
    """
    single = ending_matches(refs, functions).groupBy("language", "filename", "function").agg(F.sum("n").alias("_n"), F.min("id").alias("_id")).filter("_n = 1")
    synthetic = F.concat_ws("::", F.lit("runtime"), "language", "filename", "function")
    found = refs.join(single, ["language", "filename", "function"], "left")
    return found.select(*refs.columns, F.coalesce("_id", synthetic).alias("node_id"))


def resolve_base_classes(bases: DataFrame, classes: DataFrame) -> DataFrame:
    """(class_id, base) to classes(id, qualname, ord): by qualified name, the last inserted; else a unique simple name; else dropped."""
    by_name = classes.groupBy(F.col("qualname").alias("base")).agg(F.max_by("id", "ord").alias("_exact"))
    simple = unique_index(classes.withColumn("base", simple_name(F.col("qualname"))), ["base"], "id", "_simple")
    found = bases.join(by_name, "base", "left").join(simple, "base", "left")
    return found.select("class_id", F.coalesce("_exact", "_simple").alias("target")).filter(F.col("target").isNotNull())


def reconcile_ids(ids: DataFrame, functions: DataFrame) -> DataFrame:
    """Add `qualified` to ids(id): file::name[::variable] with `name` replaced by its qualified form where that is unique."""
    index = functions.select("file", simple_name(F.col("qualname")).alias("name"), F.col("qualname"))
    unique = unique_index(index, ["file", "name"], "qualname", "_full")
    parts = F.split("id", "::")
    keyed = ids.withColumn("file", parts[0]).withColumn("name", F.get(parts, F.lit(1)))
    full = F.concat_ws("::", F.col("file"), F.coalesce("_full", "name"), F.get(parts, F.lit(2)))
    return keyed.join(unique, ["file", "name"], "left").select(*ids.columns, full.alias("qualified"))


def first_labelled(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node of each label: the first with a file, else the first."""
    pick = nodes.join(labels.select("label").distinct(), "label", "left_semi").groupBy("label").agg(F.min_by(F.struct("id", "file", "line"), F.struct(F.col("file").isNull(), F.col("ord"))).alias("node"))
    return labels.join(pick, "label", "left")
