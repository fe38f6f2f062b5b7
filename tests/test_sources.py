import pytest
from pyspark.sql import functions as F

from codeatlas.functions import language as fl
from codeatlas.operators import chunks, extract
from codeatlas.operators.parsing import parse, parse_files
from codeatlas.sources import files


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_languages(spark):
    names = ["Test.java", "script.py", "app.js", "component.ts", "main.go", "lib.rs", "Main.kt", "file.txt", "README", ".gitignore", "a.", ".bashrc", "X.PY", "a.b.tsx"]
    want = ["JAVA", "PYTHON", "JAVASCRIPT", "TYPESCRIPT", "GO", "RUST", "KOTLIN", None, None, None, None, None, "PYTHON", "TSX"]
    assert column(spark, names, fl.language) == want
    assert column(spark, names, fl.is_supported) == [w is not None for w in want]


def test_path_filter(spark):
    some = ["/p/build/A.java", "/p/.hidden/A.java", "/p/A.JAVA", "/p/.A.java", "/p/A.java", "/p/java", "/p/target/x.py", "/p/a.b.go"]
    assert column(spark, some, files.included) == [files.wanted(p, None) for p in some]
    assert column(spark, some, lambda c: files.included(c, ["py", "b.go"])) == [files.wanted(p, ["py", "b.go"]) for p in some]
    got = column(spark, ["/p/build/A.java", "/p/.hidden/A.java", "/p/A.JAVA", "/p/.A.java", "/p/A.java", "/p/java"], files.included)
    assert got == [False, True, False, False, True, False]
    assert column(spark, ["/p/a.tsx", "/p/a.py"], lambda c: files.included(c, ["tsx"])) == [True, False]


def test_scan(spark, tmp_path):
    (tmp_path / "src" / "deep").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "deep" / "b.java").write_text("class B {}")
    (tmp_path / "src" / "bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "src" / "notes.txt").write_text("no")
    for folder, name in ((".hidden", "h.py"), ("_own", "__init__.py"), ("node_modules", "n.js"), ("deep/build/x", "y.go")):
        (tmp_path / "src" / folder).mkdir(parents=True)
        (tmp_path / "src" / folder / name).write_text("x")
    rows = {r["file_name"]: r for r in files.scan(spark, str(tmp_path / "src")).collect()}
    assert set(rows) == {"a.py", "b.java", "bad.py", "h.py", "__init__.py"}
    assert {r["file_name"] for r in files.scan(spark, str(tmp_path / "src"), ["go", "txt"]).collect()} == {"notes.txt"}
    assert {r["file_name"] for r in files.scan(spark, f"file://{tmp_path}/src").collect()} == {"a.py", "b.java", "bad.py"}
    assert rows["bad.py"]["content"] is None and rows["bad.py"]["error"] and rows["a.py"]["content"] == "x = 1\n"
    assert {r["file_name"] for r in files.scan(spark, str(tmp_path / "src"), depth=1).collect()} == {"a.py", "bad.py"}
    assert files.scan(spark, str(tmp_path / "src" / "a.py")).count() == 1
    assert files.scan(spark, str(tmp_path / "none")).count() == 0


JAVA = """package com.example;

/** class NotThis { */
public class HelloWorld extends Base {
    private String message = "void fake() {";
    private final Map<String, Integer> counts = new HashMap<>();

    public HelloWorld(String message) { this.message = message; }

    public void sayHello(String to, int n) {
        System.out.println(getMessage());
        if (n > 0) { helper.run(to); }
    }

    private String getMessage() {
        return message;
    }
}
"""


def test_java(spark):
    got = parse(JAVA, "JAVA")
    assert (got["package_name"], got["class_name"], got["properties"]) == ("com.example", "HelloWorld", ["message", "counts"])
    methods = {m["name"]: m for m in got["methods"]}
    assert list(methods) == ["HelloWorld", "sayHello", "getMessage"]
    hello = methods["sayHello"]
    assert (hello["return_type"], hello["parameters"], hello["start_line"], hello["end_line"]) == ("void", ["to", "n"], 10, 13)
    assert hello["callees"] == ["println", "getMessage", "run"] and methods["getMessage"]["return_type"] == "String"


def test_python():
    got = parse("class A(B):\n    x = 1\n    def f(self, a, *r) -> int:\n        return g(h(a))\n    async def k(self):\n        pass\n", "PYTHON")
    assert (got["class_name"], got["properties"], [m["name"] for m in got["methods"]]) == ("A", ["x"], ["f", "k"])
    assert got["methods"][0]["callees"] == ["g", "h"] and got["methods"][0]["parameters"] == ["self", "a", "r"]
    assert [m["name"] for m in parse("def top():\n    return 1\n", "PYTHON")["methods"]] == ["top"]


def of(code, lang):
    got = parse(code, lang)
    return got["class_name"], got["properties"], [(m["name"], m["return_type"], m["parameters"], m["start_line"], m["end_line"], m["callees"]) for m in got["methods"]]


def test_python_with_syntax_errors():
    code = "class A:\n    x = 1\n    def f(self):\n        return g()\n    def broken(:\n        y = h()\n    def k(self):\n        return m(self\n    def last(self):\n        return n()\n"
    assert of(code, "PYTHON") == ("A", ["x"], [("f", "", ["self"], 3, 4, ["g"]), ("k", "", ["self"], 7, 8, []), ("last", "", ["self"], 9, 10, ["n"])])
    assert of("def f():\n\ndef g():\n    return h()\n", "PYTHON")[2] == [("f", "", [], 1, 1, []), ("g", "", [], 3, 4, ["h"])]
    assert of("def broken(:\n", "PYTHON") == ("", [], []) and of("x = )(\ndef f(): g()\n", "PYTHON")[2] == [("f", "", [], 2, 2, ["g"])]


def test_templates_annotations_and_several_names():
    code = "template <class T> class V : public B {\npublic:\n  int n = 1, *m; std::map<K, T> table;\n  V(int a) : n(a) { init(a); }\n  ~V() { release(); }\n  int size() const { return count(); }\nprivate:\n  template <typename U> U get(U u) { return conv(u); }\n};\n"
    methods = [("V", "", ["a"], 4, 4, ["init"]), ("~V", "", [], 5, 5, ["release"]), ("size", "int", [], 6, 6, ["count"]), ("get", "U", ["u"], 8, 8, ["conv"])]
    assert of(code, "CPP") == ("V", ["n", "m", "table"], methods)
    code = "@Entity(name = \"x(y)\")\npublic class Q<T> extends R {\n  @Column private int N = 1, M = 2;\n  private final Map<String, List<T>> cache = new HashMap<>(), other;\n  Q(int a) { this.N = a; }\n  @Override\n  public <K> Map<K, T> of(@Nullable K k, int... r) throws E {\n    return build(k);\n  }\n}\n"
    assert of(code, "JAVA") == ("Q", ["N", "M", "cache", "other"], [("Q", "", ["a"], 5, 5, []), ("of", "Map<K, T>", ["k", "r"], 7, 9, ["build"])])


def test_arrows_and_generators():
    code = "class J {\n  x = 1;\n  run = async (a, b) => { await stop(a); }\n  *gen(n) { yield next(n); }\n  static make = a => build(a);\n}\n"
    assert of(code, "JAVASCRIPT") == ("J", ["x"], [("run", "", ["a", "b"], 3, 3, ["stop"]), ("gen", "", ["n"], 4, 4, ["next"]), ("make", "", ["a"], 5, 5, ["build"])])
    code = "const add = (a, b) => plus(a, b);\nfunction* gen(a) { yield f(a); }\nconst t = (x: number): number => {\n  return g(x);\n};\n"
    assert of(code, "TYPESCRIPT")[2] == [("add", "", ["a", "b"], 1, 1, ["plus"]), ("gen", "", ["a"], 2, 2, ["f"]), ("t", "number", ["x"], 3, 5, ["g"])]


@pytest.mark.parametrize(
    ("lang", "code", "owner", "names", "callees"),
    [
        ("GO", "package main\n\ntype S struct {\n  n int\n}\n\nfunc (s *S) Run(a int) error {\n  return doIt(a)\n}\n", "S", ["Run"], ["doIt"]),
        ("RUST", "struct P { x: i32 }\nimpl P {\n  pub fn new(x: i32) -> P { make(x) }\n}\n", "P", ["new"], ["make"]),
        ("KOTLIN", "package a.b\nclass K {\n  val n: Int = 1\n  fun go(x: Int): Int { return f(x) }\n}\n", "K", ["go"], ["f"]),
        ("JAVASCRIPT", "class J {\n  run(a) {\n    return this.stop(a);\n  }\n}\n", "J", ["run"], ["stop"]),
        ("TYPESCRIPT", "function add(a: number, b: number): number {\n  return plus(a, b);\n}\n", "", ["add"], ["plus"]),
        ("C", "int main(int argc, char **argv) {\n  printf(\"x(\");\n  return 0;\n}\n", "", ["main"], ["printf"]),
        ("CPP", "class V {\n public:\n  int size() const { return count(); }\n};\n", "V", ["size"], ["count"]),
        ("C_SHARP", "namespace N.M {\n  public class Q {\n    public int F(int a) { return G(a); }\n  }\n}\n", "Q", ["F"], ["G"]),
        ("PHP", "<?php\nclass H {\n  private $n;\n  public function f($a) { return g($a); } # no() \n}\n", "H", ["f"], ["g"]),
        ("SWIFT", "class W {\n  var n: Int = 0\n  func go(_ a: Int) -> Int { return f(a) }\n}\n", "W", ["go"], ["f"]),
        ("SCALA", "object O {\n  def f(a: Int): Int = {\n    g(a)\n  }\n}\n", "O", ["f"], ["g"]),
        ("DART", "class D {\n  int f(int a) { return g(a); }\n}\n", "D", ["f"], ["g"]),
        ("RUBY", "class R\n  attr_reader :n\n  def f(a)\n    if a\n      g(a)\n    end\n  end\nend\n", "R", ["f"], ["g"]),
        ("LUA", "local function f(a)\n  for i = 1, 2 do g(a) end\nend\n", "", ["f"], ["g"]),
        ("R", "f <- function(a) {\n  g(a)\n}\n", "", ["f"], ["g"]),
        ("BASH", "f() {\n  echo hi\n}\n", "", ["f"], []),
    ],
)
def test_other_languages(lang, code, owner, names, callees):
    got = parse(code, lang)
    assert (got["class_name"], [m["name"] for m in got["methods"]]) == (owner, names)
    assert got["methods"][0]["callees"] == callees and got["methods"][0]["start_line"] >= 1


def test_a_file_that_fails_is_an_error_row(spark):
    rows = [("/a.py", "def f():\0", None), ("/b.py", "def f():\n  pass", None), ("/c.zzz", "text", None), ("/d.py", None, "not valid UTF-8")]
    got = {r["file_path"]: r for r in parse_files(spark.createDataFrame(rows, "path string, content string, error string")).collect()}
    assert "null bytes" in got["/a.py"]["error"] and got["/a.py"]["methods"] == [] and got["/b.py"]["error"] is None and len(got["/b.py"]["methods"]) == 1
    assert got["/c.zzz"]["language"] is None and got["/d.py"]["error"] == "not valid UTF-8"


def parsed(spark, methods, package="com.test", owner="TestClass", properties=("field1", "field2")):
    rows = [("/f", "JAVA", package, owner, list(properties), [(n, "", [], body, s, e, c) for n, body, s, e, c in methods], None)]
    from codeatlas import schemas

    return spark.createDataFrame(rows, schemas.PARSED)


def test_chunks_of_methods(spark):
    got = chunks.chunk(parsed(spark, [("testMethod", "body", 10, 15, ["println"]), ("anotherMethod", "b2", 20, 25, [])])).orderBy("seq").collect()
    assert len(got) == 2 and got[0]["content"] == "body" and (got[0]["start_line"], got[0]["end_line"], got[0]["callees"]) == (10, 15, ["println"])
    assert got[0]["full_context"] == "Package: com.test\nClass: TestClass\nMethod: testMethod\nProperties: field1, field2\n\nbody"


def test_placeholder_and_token_estimate(spark):
    got = chunks.chunk(parsed(spark, [], owner="EmptyClass")).collect()
    assert len(got) == 1 and got[0]["method_name"] == "" and got[0]["content"] == chunks.NO_METHODS
    assert 0 < chunks.chunk(parsed(spark, [("m", "a" * 1000, 1, 1, [])])).first()["est_tokens"] < 1000


def test_truncation(spark):
    got = chunks.chunk(parsed(spark, [("a", "x" * 130_000, 1, 1, []), ("b", "x" * 127_990, 1, 1, []), ("c", "\U0001f600" * 64_001, 1, 1, [])])).orderBy("seq").collect()
    assert len(got[0]["content"]) == 127_950 + 19 and got[0]["content"].endswith("// ... (truncated)")
    assert len(got[1]["content"]) == 127_990
    assert got[2]["content"] == "\U0001f600" * (127_950 // 2) + chunks.CUT_MARK
    assert chunks.chunk(parsed(spark, [], owner="x" * 128_004)).count() == 0


def test_graph_of_a_file(spark):
    df = parsed(spark, [("a", "", 1, 1, ["b", "b", "a"]), ("b", "", 2, 2, [])])
    assert {r["node_id"] for r in extract.nodes(df).collect()} == {"/f:TestClass", "/f:TestClass:a", "/f:TestClass:b"}
    got = {(r["src"].split(":")[-1], r["dst"].split(":")[-1], r["rel"]) for r in extract.edges(df).collect()}
    assert got == {("TestClass", "a", "contains"), ("TestClass", "b", "contains"), ("a", "b", "calls"), ("a", "a", "calls")}
    assert extract.calls(df).count() == 3
