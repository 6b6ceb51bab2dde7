"""File scan, ignore rules, parsers, graphs, recordings."""

import json

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rootweave.plans import knowledge as K
from rootweave.sources import files as S
from rootweave.sources import parsers as P
from rootweave.sources import recordings as D

SHAPES = "class Shape:\n    def area(self):\n        return 0\n"
DRAW = '''import shapes
from shapes import Shape
import numpy

SCALE, (DEPTH, _) = 2, (3, 4)

class Square(Shape):
    def area(self, side):
        size = side * SCALE
        return size

    def show(self):
        self.area(3)
        for step in range(DEPTH):
            if step:
                continue
        try:
            pass
        except OSError:
            return None
        return print(step)

def start():
    square = Square()
    square.show()
'''


def _files(spark, texts):
    rows = [(p, "C++" if p.endswith("pp") else "C" if p.endswith((".c", ".h")) else "Python", t) for p, t in texts.items()]
    return spark.createDataFrame(rows, "path string, language string, text string")


def test_scan_ignores_and_counts(spark, tmp_path):
    for name, text in {"a.py": "x = 1\ny = 2", "build/b.py": "", "c.PNG": "", "d.log": "x", "keep.log": "x", "sub/e.c": "int main() {}\n", ".gitignore": "# c\n*.log\n!keep.log\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = {r["path"]: (r["language"], r["lines"]) for r in S.scan(spark, str(tmp_path)).collect()}
    assert rows == {"a.py": ("Python", 2), "keep.log": (None, 1), "sub/e.c": ("C", 1)}
    with pytest.raises(ValueError):
        S.scan(spark, str(tmp_path), max_bytes=3)
    entries = {r["language"]: r["path"] for r in S.entry_points(S.scan(spark, str(tmp_path))).collect()}
    assert entries == {"Python": "a.py", "C": "sub/e.c"}


def test_python_modules_and_merged_graph(spark):
    files = _files(spark, {"shapes.py": SHAPES, "draw.py": DRAW, "bad.py": "def ("})
    modules = P.modules(files)
    assert modules.filter("parse_error IS NOT NULL").count() == 1
    modules = modules.filter("parse_error IS NULL")
    row = modules.filter("path = 'draw.py'").first()
    assert [v["name"] for v in row["variables"]] == ["SCALE", "DEPTH", "_"]
    assert row["functions"][0]["calls"] == ["Square", "square.show"] and row["classes"][0]["bases"] == ["Shape"]
    events = [("call", "start"), ("call", "show"), ("call", "area"), ("return", "area"), ("exception", "area")]
    events = spark.createDataFrame([("r", "Python", i, t, f, "/w/draw.py", "OSError: no" if t == "exception" else None) for i, (t, f) in enumerate(events)], "run_id string, language string, seq long, type string, function string, filename string, exception string")
    graph = K.build("p", modules, events, K.errors_from_events(events))
    edges = {(r["source"], r["target"], r["kind"]) for r in graph.edges.collect()}
    nodes = {r["id"]: r for r in graph.nodes.collect()}
    assert graph.missing_sources == []
    assert ("draw.py", "shapes.py", "imports") in edges and ("draw.py::Square", "shapes.py::Shape", "inherits") in edges
    assert ("draw.py::Square.show", "draw.py::Square.area", "calls") in edges and ("draw.py::start", "external::square.show", "calls") in edges
    assert ("draw.py::Square.area", "draw.py::Square.area::size", "writes") in edges
    assert ("draw.py::start", "draw.py::Square.show", "executes_after") in edges
    assert ("draw.py::Square.area", "exception::Python::OSError", "throws") in edges
    assert nodes["draw.py::Square.show"]["executed"] and nodes["draw.py::Square.show"]["kind"] == "method"
    assert nodes["project::p"]["kind"] == "project" and nodes["external::print"]["kind"] == "external"
    with pytest.raises(ValueError):
        K.build("p", None)


def _flows(text, unique=False):
    parsed = P.parse_python(text, "m.py", unique)
    short = lambda x: x.rpartition(":")[2]
    return [(short(b["id"]), b["label"], b["stmt"]) for b in parsed["blocks"]], {(short(f["source"]), short(f["target"]), f["kind"]) for f in parsed["flows"]}


def test_control_flow_edges():
    blocks, edges = _flows("def f(x):\n    y = 1\n    return y\n")
    assert blocks == [("start", "f()", None), ("block0", "assign", None), ("block1", "return", "return"), ("end", "end", None)]
    assert edges == {("start", "block0", "next"), ("block0", "block1", "return"), ("block0", "end", "fallthrough")}
    assert _flows("def f():\n    return 1\n")[1] == {("start", "block0", "return")}
    loop = "def f(x):\n    for i in x:\n        g(i)\n    while x:\n        pass\n"
    assert _flows(loop, True)[1] == {
        ("start", "block0", "loop"), ("block0", "block1", "next"), ("block0", "block1", "body"), ("block0", "block0", "done"), ("block1", "block0", "back-edge"), ("block0", "block2", "join"),
        ("block2", "block3", "loop"), ("block3", "block4", "next"), ("block3", "block4", "true"), ("block3", "block3", "false"), ("block4", "block3", "back-edge"), ("block3", "block5", "join"),
        ("block1", "end", "fallthrough"), ("block2", "end", "fallthrough"), ("block4", "end", "fallthrough"), ("block5", "end", "fallthrough"),
    }


def test_block_numbers_start_again_in_every_body():
    text = "def f(x):\n    if x:\n        y = 1\n    else:\n        z = 2\n    return y\n"
    blocks, edges = _flows(text)
    assert [b[0] for b in blocks] == ["start", "block0", "block0", "block0", "block1", "block2", "end"]
    assert edges == {("start", "block0", "branch"), ("block0", "block0", "next"), ("block0", "block0", "true"), ("block0", "block0", "false"), ("block0", "block1", "join"), ("block1", "block2", "return"), ("block0", "end", "fallthrough"), ("block1", "end", "fallthrough")}
    blocks, edges = _flows(text, True)
    assert [b[0] for b in blocks] == ["start", "block0", "block1", "block2", "block3", "block4", "end"]
    assert {("block1", "block3", "join"), ("block2", "block3", "join"), ("block0", "block1", "true"), ("block0", "block2", "false"), ("block3", "block4", "return")} <= edges


def test_exception_flow():
    text = "def f():\n    try:\n        a()\n    except (KeyError, OSError):\n        pass\n    except:\n        b()\n        c()\n    else:\n        d()\n"
    blocks, edges = _flows(text, True)
    assert [(b[0], b[1]) for b in blocks if b[2]] == [("block1", "join"), ("block2", "except (KeyError, OSError)"), ("block4", "except Exception")]
    assert edges == {
        ("start", "block0", "next"), ("block0", "block1", "join"), ("start", "block2", "exception"), ("block2", "block3", "next"), ("block3", "block1", "join"),
        ("start", "block4", "exception"), ("block4", "block5", "next"), ("block5", "block6", "next"), ("block6", "block1", "join"), ("block1", "block7", "next"),
    } | {(f"block{i}", "end", "fallthrough") for i in (0, 1, 3, 5, 6, 7)} | ({("block7", "block1", "next")} & edges | {("block7", "block1", "next")})


def test_first_and_last_of_equal_names(spark):
    texts = {
        "a.py": "class Base:\n    pass\n\ndef twice():\n    pass\n\ndef twice():\n    one()\n\nname = 1\ndef name():\n    pass\n",
        "b.py": "class Base:\n    pass\n\nclass Child(Base):\n    def twice(self):\n        pass\n",
        "c.py": "class Other(Base):\n    pass\n",
    }
    graph = K.build("p", P.modules(_files(spark, texts)))
    nodes = {r["id"]: r for r in graph.nodes.collect()}
    inherits = {(r["source"], r["target"]) for r in graph.edges.filter("kind = 'inherits'").collect()}
    assert inherits == {("b.py::Child", "b.py::Base"), ("c.py::Other", "b.py::Base")}  # the class read last
    assert nodes["a.py::twice"]["line"] == 4 and nodes["a.py::name"]["kind"] == "function"
    assert nodes["a.py::twice:start"]["file"] == "a.py" and nodes["a.py::twice:start"]["label"] == "twice()"


def test_c_family():
    c = P.parse_c_family('#include <stdio.h>\n#include "util.h"\nint count = 0;\nstruct Point { int x; };\nstatic int add(int a, int *b) {\n  // skip(1)\n  printf("x(");\n  return helper(a);\n}\n', "a.c")
    assert [i["module"] for i in c["imports"]] == ["stdio.h", "util.h"] and [v["name"] for v in c["variables"]] == ["count"]
    assert [(f["name"], f["params"], f["calls"]) for f in c["functions"]] == [("add", ["a", "*b"], ["printf", "helper"])]
    assert [(k["name"], k["bases"], k["methods"]) for k in c["classes"]] == [("Point", [], [])]
    cpp = P.parse_c_family("class Dog : public Animal {\npublic:\n  void bark() { speak(); }\n  int age() const;\n};\nint main() { Dog d; d.bark(); return 0; }\n", "a.cpp")
    assert cpp["classes"][0]["bases"] == ["Animal"] and [m["name"] for m in cpp["classes"][0]["methods"]] == ["bark", "age"]
    assert [(f["name"], f["calls"]) for f in cpp["functions"]] == [("main", ["bark"])]


def test_c_parameters_bases_and_calls():
    found = P.parse_c_family("class Box : public Holder<int, char>, private Plain, std::Other {\n  void put(const char *name, int v[3], T &r, int d = 1);\n};\nint run(struct Box *b, void) {\n  b->put(0); a::b::go(); first().second();\n  return 0;\n}\n", "a.hpp")
    assert found["classes"][0]["bases"] == ["Holder<int, char>", "Plain"]
    assert [(m["name"], m["params"]) for m in found["classes"][0]["methods"]] == [("put", ["*name", "v[3]", "&r"])]
    assert [(f["name"], f["params"], f["calls"]) for f in found["functions"]] == [("run", ["*b"], ["put", "go", "first", "second"])]


def test_cpp_scopes_and_declarators():
    text = """#define BAD(x) { ( \\
   more {
namespace n1 { inline namespace v2 {
template <typename T, class U = std::map<int, T>>
class Box final : public Holder<int, char>, private std::Other, virtual Plain {
public:
    explicit Box(int x) : v{x}, w(size(x)), Base<T>{x} { start(x); }
    ~Box() noexcept override = default;
    int operator()(int a) const;
    int (*handler)(int);
    std::vector<int> items{1, 2};
    struct In { int z; void go(); };
    enum Kind { A, B };
};
}}
std::map<std::string, int> table = make();
struct Point { int x; } origin = {1};
class Later;
enum Color { RED } color;
extern "C" {
int c_way(void);
int c_body(unsigned int, struct Box *b) { return b->put(0); }
}
int (*fp)(int);
typedef struct { int a; } Named;
auto lam = [](int a) { return hidden(a); };
template <typename T>
static std::vector<T>
n1::Box<T>::build(const T *a, Foo&) const
{
    if (a > f(b)) { return ns::deep::call(g(1)); }
    Dog d(1); d.bark(); int(x); std::string s = R"x( no( )x";
}
"""
    found = P.parse_c_family(text, "a.cpp")
    assert [(f["name"], f["params"], f["line"], f["calls"]) for f in found["functions"]] == [("c_body", ["*b"], 22, ["put"]), ("build", ["*a"], 28, ["f", "call", "g", "bark"])]
    assert [(c["name"], c["bases"], c["line"]) for c in found["classes"]] == [("Box", ["Holder<int, char>", "Plain"], 5), ("In", [], 12), ("Point", [], 17)]
    methods = [(m["name"], m["calls"]) for m in found["classes"][0]["methods"]]
    assert methods == [("Box", ["size", "start"]), ("~Box", []), ("operator()", [])]
    assert [v["name"] for v in found["variables"]] == ["table", "origin", "color", "lam"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("{ } ( ) [ ] < > ; : , = * & ~ :: -> class struct enum namespace template operator typedef int x f \" ' /* // # R\"x( \n".split(" ")), max_size=40))
def test_any_text_is_scanned_to_its_end(words):
    for path in ("a.c", "a.cpp"):
        P.parse_c_family(" ".join(words), path)


def test_trace_json(spark, tmp_path):
    good = {"type": "call", "function": "main", "filename": "main.py", "lineno": 5, "timestamp": 0.01, "depth": 0, "variables": {}, "exception": None}
    (tmp_path / "t.json").write_text(json.dumps({"events": [good, {"type": "odd"}, good, good], "last_exception": None}))
    (tmp_path / "bad.json").write_text("{")
    rows = D.read_traces(spark, str(tmp_path), 3)
    assert [r["seq"] for r in rows.orderBy("seq").collect()] == [0, 2]
    document = json.loads(D.trace_documents(rows).first()["document"])
    assert document["events"][0]["function"] == "main" and document["last_exception"] is None
    failed = rows.withColumn("type", F.lit("exception")).withColumn("exception", F.concat(F.lit("OSError: at "), F.col("seq").cast("string")))
    assert json.loads(D.trace_documents(failed).first()["document"])["last_exception"] == {"type": "OSError", "message": "at 2"}


def test_junit(spark, tmp_path):
    (tmp_path / "j.xml").write_text('<testsuite><testcase name="a" time="0.5"/><testcase name="b"><failure message="no">x</failure></testcase><testcase name="c"><error message="e"/></testcase><testcase name="d"><skipped/></testcase></testsuite>')
    rows = {r["name"]: (r["outcome"], r["message"]) for r in D.read_junit(spark, str(tmp_path / "j.xml")).collect()}
    assert rows["a"] == ("passed", None) and rows["b"] == ("failed", "no") and rows["c"][0] == "error" and rows["d"][0] == "skipped"


def test_unchanged_files_need_no_parse(spark):
    from rootweave.functions.text import content_key

    files = _files(spark, {"a.py": "x", "b.py": "y"})
    parsed = files.filter("path = 'a.py'").withColumn("content_key", content_key(F.col("text")))
    hits, misses = S.unchanged(files, parsed)
    assert [r["path"] for r in hits.collect()] == ["a.py"] and [r["path"] for r in misses.collect()] == ["b.py"]


def test_a_batch_is_parsed_in_small_frames():
    texts = [f"def f{i}(a):\n    return a\n" if i % 5 else "def (" for i in range(500)]
    frame = pd.DataFrame({"path": [f"m{i}.py" for i in range(500)], "language": "Python", "text": texts})
    found = list(P.parsed_frames([frame, frame[:1], frame[:0]], P.PARSERS))
    assert max(map(len, found)) <= 64
    rows = pd.concat(found)
    assert list(rows["path"]) == [*frame["path"], "m0.py"]
    assert rows["parse_error"].notna().sum() == 101 and sum(map(len, rows["functions"])) == 400
