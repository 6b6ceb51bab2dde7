"""Scalar functions on names, paths, identifiers and report text; all are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffixes by language, languages in order of declaration.
LANGUAGES = ("Python", "C", "C++")
SUFFIX_LANGUAGE = {".py": "Python", ".pyi": "Python", ".c": "C", ".h": "C", ".cpp": "C++", ".cc": "C++", ".cxx": "C++", ".hpp": "C++", ".hh": "C++", ".hxx": "C++"}
# Names of evidence sources in reports, in order of declaration.
ARTIFACTS = {
    "ast": "AST Analysis", "dependency_graph": "Dependency Graph", "call_graph": "Call Graph", "cfg": "Control Flow Graph",
    "data_flow": "Data Flow Analysis", "runtime_trace": "Runtime Trace", "stack_trace": "Stack Trace",
}


def _mapped(key: Column, pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]


def detect_language(path: Column) -> Column:
    """Language by suffix, whatever the case; null where unsupported."""
    return _mapped(F.regexp_extract(F.lower(F.rtrim(path)), r"(\.[^./\\]+)$", 1), SUFFIX_LANGUAGE)


def resolve_language(name: Column) -> Column:
    return _mapped(F.lower(F.trim(name)), {x.lower(): x for x in LANGUAGES})


def language_rank(language: Column) -> Column:
    return _mapped(language, {x: i for i, x in enumerate(LANGUAGES)})


def simple_name(label: Column) -> Column:
    return F.substring_index(label, ".", -1)


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(posix(path), "/", -1)


def same_source(a: Column, b: Column) -> Column:
    """Equal paths, or one ends with the other at a separator."""
    a, b = posix(a), posix(b)
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def within(path: Column, root: Column) -> Column:
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def id_file(node_id: Column) -> Column:
    """What stands before the last `::`; all of it where there is none."""
    return F.when(node_id.contains("::"), F.regexp_extract(node_id, r"(?s)^(.*)::(.*)$", 1)).otherwise(node_id)


def id_name(node_id: Column) -> Column:
    return F.when(node_id.contains("::"), F.regexp_extract(node_id, r"(?s)^(.*)::(.*)$", 2)).otherwise(F.lit(""))


def owner_name(qualname: Column) -> Column:
    return F.when(qualname.contains("."), F.regexp_extract(qualname, r"(?s)^(.*)\.(.*)$", 1)).otherwise(F.lit(""))


def safe_int(value: Column) -> Column:
    return F.trim(value.cast("string")).try_cast("int")


def exception_type(text: Column) -> Column:
    """Before the first `: `; all of it where there is none."""
    return F.substring_index(text, ": ", 1)


def exception_message(text: Column) -> Column:
    at = F.instr(text, ": ")
    return F.when(at > 0, F.substring(text, at + 2, F.char_length(text))).otherwise(text)


def short_path(path: Column, limit: int = 300) -> Column:
    return F.right(path, F.lit(limit))


def content_key(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def truncated(text: Column, limit: int) -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n... [truncated]"))).otherwise(text)


def archive_name(filename: Column) -> Column:
    return F.regexp_replace(basename(filename), r"(?i)\.zip$", "")


def repository_name(url: Column) -> Column:
    return F.regexp_replace(F.substring_index(F.regexp_replace(url, r"/+$", ""), "/", -1), r"\.git$", "")


def include_name(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r'^[<"]|[>"]$', "")


def is_identifier(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z_]\w*$")


def line_count(text: Column) -> Column:
    """Newlines, and one more for a last line without one."""
    breaks = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    return (breaks + F.when((F.char_length(text) > 0) & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)).cast("long")


def defines_main(text: Column) -> Column:
    """A line that holds a main definition of a compiled language."""
    return text.rlike(r"(?:int|void|auto|int32_t) main")


def linear_score(position: Column, step: str, floor: str) -> Column:
    """max(floor, 1 - step * position), exact."""
    value = F.lit(1).cast("decimal(10,4)") - F.lit(step).cast("decimal(6,4)") * position.cast("decimal(10,0)")
    return F.greatest(F.lit(floor).cast("decimal(5,4)"), value).cast("decimal(5,4)")


def step_score(depth: Column, scores: dict[int, str]) -> Column:
    out = F.lit(None).cast("decimal(5,4)")
    for at, score in scores.items():
        out = F.when(depth == at, F.lit(score).cast("decimal(5,4)")).otherwise(out)
    return out


def format_date(value: Column) -> Column:
    """A date and time as a reader writes it, in the session's time zone; what is no date stays as it is."""
    at = F.try_to_timestamp(value)
    return F.when(at.isNull(), value).otherwise(F.date_format(at, "M/d/yyyy, h:mm:ss a"))


def artifact_name(source: Column) -> Column:
    return F.coalesce(_mapped(source, ARTIFACTS), F.initcap(F.replace(source, F.lit("_"), F.lit(" "))))


_UNKNOWN = "—"


def _measured(value: Column, text: Column) -> Column:
    """The text of a number that is finite and not negative."""
    return F.when(value.isNull() | F.isnan(value.cast("double")) | (value < 0) | (value.cast("double") == float("inf")), F.lit(_UNKNOWN)).otherwise(text)


def format_bytes(size: Column) -> Column:
    """In B, KB, MB or GB; one decimal below ten of a unit, none for bytes."""
    text = F.format_string("%.0f B", size.cast("double"))
    for power, unit in enumerate(("KB", "MB", "GB"), 1):
        value = size / float(1024**power)
        text = F.when(value >= 1, F.when(value >= 10, F.format_string(f"%.0f {unit}", value)).otherwise(F.format_string(f"%.1f {unit}", value))).otherwise(text)
    return _measured(size, text)


def format_duration(seconds: Column) -> Column:
    seconds = seconds.cast("double")
    return _measured(seconds, F.when(seconds < 1, F.format_string("%.0f ms", seconds * 1000)).otherwise(F.format_string("%.2f s", seconds)))


def format_score(value: Column) -> Column:
    value = value.cast("double")
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.lit(_UNKNOWN)).otherwise(F.format_string("%.3f", value))


def shortened(text: Column, limit: int) -> Column:
    """At most `limit` characters, the last an ellipsis where some are left out."""
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 1), F.lit("…")))


def is_python_test(path: Column) -> Column:
    return F.lower(basename(path)).rlike(r"^tests?_|_test\.py$|\.test\.py$")


def is_compiled_test(path: Column) -> Column:
    return path.isin("test_main.c", "tests_main.c") | path.contains("/tests/") | path.startswith("tests/")
