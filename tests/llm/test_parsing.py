import ast

import pytest

from gantry.llm.grammars import language
from gantry.llm.parsing import parse_files, parse_rates

GOOD = {
    "python": [
        "", "# only a comment", "\ufeffx = 1\r\nif x:\r\n\ty = 2\r\n", "def f(a, /, b: int = 0, *, c, **k) -> dict[str, int]:\n    return f'{a!r:>{b}} {c=}'\n",
        "match x:\n    case {'a': [1, *r], **k} if r:\n        pass\n    case P(x=1) | None:\n        pass\n", "type A[T: int] = list[T]\nclass B[T](C, metaclass=M): x: int\n",
        "with (open(a) as f, open(b) as g):\n    pass\ntry:\n    pass\nexcept* (A, B) as e:\n    raise X from e\n", "x = [i async for i in y if i] if a else lambda *a, k=1: (yield)\n",
        "@d\nasync def f():\n    async with a as b: await c\n    return *a, b\n", "f'{x[\"a\"]} {{}}'\nprint(*a, sep='')\nx[1:2, ::3] = y = 3\nx: int\n", "a = b if c else \\\n    d\n", "match = 1\nmatch.x(case)\nprint(1if x else 2)\n",
    ],
    "javascript": [
        "const a = b.replace(/[{(\\/'\"]+$/g, '');\nlet x = `a ${f({k: 1})} } ${`n`}`\nfoo()\n", "export default async function* f({a, ...r}, [b = 1] = []) { for await (const x of y) { yield* x } }",
        "class A extends B { static #p = 1; get x() { return this.#p } async *m() {} static { f() } }", "a?.b?.(c)?.[d] ?? e; x = async (a) => ({...a}); if (a) b(); else c()\nlabel: for (;;) { break label }",
        "import d, * as n from 'm'; import {a as b, default as c} from \"x\"; export * as q from 'z'; export {b as default}", "var y = x\n++z\nconst t = function () { return\n1 }\nswitch (a) { case 1: case 2: b(); default: }",
    ],
    "typescript": [
        "const p = <T,>(xs: T[]): T => xs[0]!;\nconst q = a as unknown as Map<string, { x: number }>;\nconst o = { a: 1 } satisfies Record<string, number>;", "export abstract class A<T extends B = C> implements D, E<F> { constructor(private readonly x?: number) { super() } abstract f(a: string): void; [k: string]: any }",
        "interface I extends J<K> { (a: number): string; readonly b?: C[]; m<T>(x: T): x is U; new (): I }\ntype M = { readonly [K in keyof T]?: T[K] extends infer U ? U : never };", "enum E { A = 1, B = 'x' }\ndeclare module 'm' { export const x: number }\nnamespace N.M { let y = 1 }", "function f(this: A, ...r: string[]): asserts r is B;\nlet t: [a: number, b?: string, ...c: X[]] | (() => void) | typeof import('x');\nimport type { Z } from 'z';",
    ],
    "go": [
        "package a\n\nimport (\n\t\"x\"\n\t. \"y\"\n)\n\ntype T[K comparable, V any] struct {\n\tA, B int `json:\"a\"`\n\t*C\n}\n\nfunc (t *T[K, V]) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[a]; ok && v != (P{1}) {\n\t\treturn\n\t} else if err != nil {\n\t}\n\tfor i := range xs {\n\t\tgo func() { ch <- i }()\n\t}\n\tswitch y := z.(type) {\n\tcase nil, *int:\n\tdefault:\n\t\tfallthrough\n\t}\n\tselect {\n\tcase v := <-ch:\n\tcase ch <- 1:\n\t}\n\tdefer f()\n\treturn a<<1 &^ 2, nil\n}\n",
        "package a; var x = []map[string]func(int) error{{\"a\": nil}}; const (\n\tA = iota\n\tB\n)\ntype I interface {\n\t~int | string\n\tM(a int) (b string)\n}\n",
    ],
    "java": [
        "package a.b;\nimport static c.D.*;\n@Ann(x = 1, y = {2, 3})\npublic final class A<T extends B & C> extends D<T> implements E {\n  private int[] x = {1, 2}, y[];\n  static { f(); }\n  A(final int... a) throws Ex { this(1); }\n  <R> R m(Map<String, List<? extends T>> p) { var q = (Runnable & S) () -> {}; for (var e : p) total += e.g(); return (int) x[0] > 1 ? a::b : String[]::new; }\n  record P(int a, int b) { P { } }\n  enum F { X(1) { void g() {} }, Y; int z; }\n  sealed interface G permits H { default void k() { } }\n}\n",
        "class A { int f(Object o) { return switch (o) { case Integer i when i > 1 -> 1; case String s -> { yield 2; } default -> throw new X(\"a\"); }; } String t = \"\"\"\n  text \"x\"\n  \"\"\"; void g() { try (var r = h()) { } catch (A | B e) { } finally { } synchronized (this) { assert a : b; } if (o instanceof String s && !s.isEmpty()) { } label: while (true) break label; } }",
    ],
}
BAD = {
    "python": ["x = 0777", "print 'a'", "if x\n  y", "  x = 1", "def f(:\n pass", "x = `a`", "<<<<<<< HEAD\n", "f'{a b}'", "x = 'abc\n", "if x:\ny = 1", "a = (1]", "raise A, b", "x <> y", "else:\n  pass", "\ufeff\ufeffx = 1"],
    "javascript": ["a = = b", "return return x;", "f(a;", "if (a {", "x = 'abc\n'", "a..b(;", "const x: number = 1", "function f( {", "let t = `a ${b", "<% x %>", "package a;", "class A {"],
    "typescript": ["import {{ a }}", "async f(x: number {", "interface I { a: }", "x = [1,, 2", "type = ;", "def f():\n  pass", "/* open"],
    "go": ["package a\nfunc f( {\n}\n", "package a\nfunc f() {\n\tx := \"abc\n}\n", "import x", "package a\nfunc f() {\n\tif x {\n", "package a\nx := 1\n", "package a\nfunc f() {\n\ta..b(\n}\n"],
    "java": ["class A { int f() { return return x; } }", "class A { void f() { a..b(; } }", "class A {", "@@ -1,2 +3,4 @@", "class A { String s = \"abc; }", "class A { void f() { g(a]; } }", "class A { else x } {"],
}


@pytest.mark.parametrize(("name", "text"), [(n, t) for n, ts in GOOD.items() for t in ts])
def test_accepts_valid(name, text):
    assert language(name).check(text), language(name).failure(text)


@pytest.mark.parametrize(("name", "text"), [(n, t) for n, ts in BAD.items() for t in ts])
def test_rejects_invalid(name, text):
    assert not language(name).check(text)
    line, cause = language(name).failure(text)
    assert line >= 1 and cause in ("merge_conflict", "truncated", "token", "syntax")


def test_python_agrees_with_the_compiler():
    for text in GOOD["python"] + BAD["python"]:
        try:
            ast.parse(text.removeprefix("\ufeff"))
            valid = True
        except SyntaxError:
            valid = False
        assert language("python").check(text) == valid, text


def test_failure_position():
    assert language("java").failure("class A {\n  void f() {\n    a..b(;\n  }\n}\n")[0] == 3
    assert language("python").failure("x = 1\n<<<<<<< ours\ny = 2\n") == (2, "merge_conflict")
    assert language("go").failure("package a\n\nfunc f() {\n\tx := 1\n")[1] == "truncated"


def test_parse_files_nulls_duplicates_and_extra_columns(spark):
    rows = [
        ("r", "a.py", "x = 1", "2024-01-01", 1), ("r", "a.py", "x = 1", "2024-01-01", 1), ("r", "b.py", "x = ", "2024-01-01", 1), ("r", "b.py", "x = 2", "2024-02-01", 1),
        ("r", "c.js", "", None, 1), ("r", "d.txt", "((", None, 1), ("r", "e.go", None, None, 1), (None, "f.java", "class {", None, 1), ("r", "g.py", "x = [" + "1, " * 200_000 + "]", None, 1),
    ]
    files = spark.createDataFrame(rows, "repository_id string, node_id string, text string, ingested_at string, lang int").withColumn("ingested_at", __import__("pyspark").sql.functions.to_timestamp("ingested_at"))
    got = {(r["repository_id"], r["node_id"]): r["has_error"] for r in parse_files(files).collect()}
    assert got == {("r", "a.py"): False, ("r", "b.py"): False, ("r", "c.js"): False, (None, "f.java"): True, ("r", "g.py"): False}
    assert parse_files(files.limit(0)).count() == 0
    total = [r for r in parse_rates(parse_files(files)).collect() if r["files"] == 5]
    assert total and total[0]["failing"] == 1
