import random

from pyspark.sql import functions as F

from gantry.llm.docs import Scan, code_pairs, documented_functions, is_documented
from gantry.llm.provenance import fingerprints, mark_files, marks

FILES = "repository_id string, node_id string, text string, ingested_at timestamp"
PYTHON = '''"""Module text that says things."""


def a(x):
    """Counts the rows that the cache lost."""
    def inner():
        \'\'\'Wait until the reader is done.\'\'\'
    return "def fake(): pass"


def b(x): return 1


class C:
    """A class."""

    @dec
    async def m(
        self, key=lambda q: (q[0], -q[1]),
    ) -> dict[str, int]:
        # a note
        """The m method."""

    def n(self):
        x = 1
        """Not a docstring at all."""

    def drop_rows(self):
        """Drops the rows."""

    def see(self):
        """See base class."""
'''
SCRIPT = '''/** Header that belongs to nothing. */

/**
 * Keep the newest row of every key.
 */
export async function f<T>(a: T, b = g(1, 2)): Promise<void> {
  const t = `
/** made up text about nothing */
function fake() {
`;
}
/** Too far away to count here. */

function far() {}
/** Bound to a const, therefore counted. */
const bound = async (x) => { call(x); };
// a plain note is no documentation
function plain() {}
class A {
  /** Removes whatever the last run left. */
  static async m(x: number) { return x.replace(/[{(]/, ''); }
  /** @param x */
  onlyTags(x) { if (x) { y(); } }
  /** {@inheritDoc} */
  pointer() {}
}
'''
GO = "package a\n\n// Load reads what the last run left behind.\n// It never blocks.\nfunc (t *T) Load(a int) error {\n\treturn nil\n}\n\n// far away from it\n\nfunc Far() {}\n\n// tbd\nfunc Tbd() {\n\tx := `\n// text in a string that is long\nfunc fake() {}\n`\n}\n"
JAVA = "class A {\n  /**\n   * Tells whether the owner may still write.\n   * @param x the owner in question\n   */\n  @Override\n  @Ann(a = 1)\n  public Map<String, List<int[]>> may(int x) throws E {\n    return new B() { };\n  }\n  /** May. */\n  boolean may2() { return true; }\n}\n"


def test_documented_functions(spark):
    rows = [("r", "a.py", PYTHON, None), ("r", "a.py", PYTHON, None), ("r", "a.ts", SCRIPT, None), ("r", "a.go", GO, None), ("r", "A.java", JAVA, None), ("r", "bad.py", "def f():\n    '''Says a lot of things.'''\nx = (", None), ("r", "e.py", "", None), ("r", "n.py", None, None)]
    got = {(r["node_id"], r["name"], r["start_line"]) for r in documented_functions(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {("a.py", "a", 4), ("a.py", "inner", 6), ("a.ts", "f", 6), ("a.ts", "bound", 16), ("a.ts", "m", 21), ("a.go", "Load", 5), ("A.java", "may", 8)}
    assert documented_functions(spark.createDataFrame([], FILES)).count() == 0


def test_what_counts_as_documentation():
    for doc in ("TODO: document", "...", "------", "See #12.", "N/A", "noch zu beschreiben", "Used to fold the rows.", "foldRows", "FOLD ROWS", "The fold rows function.", "Folds rows with key."):
        assert not is_documented(f"/** {doc} */", "foldRows", "rows, key", "typescript"), doc
    for doc in ("Oldest row seen so far.", "Ohne Knoten lässt sich nichts zuordnen.", "@returns the newest key or nothing", "Fold a row.\n * TODO: also cover the empty case of the day"):
        assert is_documented(f"/** {doc} */", "foldRow", "key", "typescript") == ("TODO" not in doc), doc


def test_tokens_cover_brackets():
    for text, lang in ((SCRIPT, "typescript"), (PYTHON, "python"), (GO, "go"), (JAVA, "java")):
        depth = 0
        for *_, kind, _ in Scan(text, lang).rows():
            depth += (kind == "open") - (kind == "close")
            assert depth >= 0
        assert depth == 0


NESTED_TS = '''/** Gives the newest row of a key. */
function a(x: number): { y: number } {
  return { y: x };
}
/** Adds what the caller gave to one. */
export const g = (a: number) => a + 1
function h(zzz: string) { return zzz }
/** Spreads the load over lines. */
const multi = async <T>(q: T[]) =>
  q.map((x) => {
    return { v: x };
  }).filter(Boolean)
class Box<T> extends Base {
  /** Holds whatever came last. */
  @dec({ a: 1 })
  private async hold(v: T, o = { z: 1 }): Promise<{ ok: boolean }> {
    const inner = { /** Tells the outer world so. */ tell(a) { return a } };
    return { ok: true };
  }
  other() {}
}
/** Waits until the reader is done. */
const one = x => x * 2;
/** Collects all that came in. */
foo(function () { return 1 });
if (x) { y() }
'''
NESTED_PY = '''class A(B):
    """Class text."""

    @dec(1)
    def m(self, a: dict[str, int] = {}) -> list[int]:
        """Counts rows the cache lost."""
        if a:
            return [
                1,
            ]
        def inner(x):
            """Waits until the reader is done."""
            return x \\
                + 1

        return inner


def seven(a):
    """Adds what the caller gave.

    More text.
    """
    x = 1
    return x
'''
NESTED_GO = 'package a\n\n// Load reads what was left.\nfunc (t *T[K]) Load(a int, f func(int) error) (map[string]int, error) {\n\tif a > 0 {\n\t\treturn nil, nil\n\t}\n\treturn nil, nil\n}\n'
NESTED_JAVA = 'class A<T> {\n  /** Tells whether the owner may write. */\n  @Override public Map<String, List<int[]>> may(final int x, String... y) throws E {\n    if (x > 1) { return null; }\n    return new B() { };\n  }\n}\n'


def test_code_pairs(spark):
    """Ends, signatures and symbols: result types with braces, lone expressions, nested functions, receivers."""
    rows = [("r", "a.ts", NESTED_TS, None), ("r", "a.py", NESTED_PY, None), ("r", "a.go", NESTED_GO, None), ("r", "A.java", NESTED_JAVA, None), ("r", "n.ts", None, None), ("r", "e.ts", "", None)]
    frame = spark.createDataFrame(rows, FILES).withColumn("code", F.lit("clashing"))
    got = {r["symbol"]: (r["first_line"], r["start_line"], r["end_line"], r["signature"]) for r in code_pairs(frame).collect()}
    assert got == {
        "A.may": (3, 3, 6, "public Map<String, List<int[]>> may(final int x, String... y) throws E"),
        "T.Load": (4, 4, 9, "func (t *T[K]) Load(a int, f func(int) error) (map[string]int, error)"),
        "A.m": (5, 5, 16, "def m(self, a: dict[str, int] = {}) -> list[int]"),
        "m.inner": (11, 11, 14, "def inner(x)"),
        "seven": (19, 19, 25, "def seven(a)"),
        "one": (23, 23, 23, "const one = x =>"),
        "a": (2, 2, 4, "function a(x: number): { y: number }"),
        "g": (6, 6, 6, "export const g = (a: number) =>"),
        "multi": (9, 9, 12, "const multi = async <T>(q: T[]) =>"),
        "Box.hold": (16, 16, 19, "private async hold(v: T, o = { z: 1 }): Promise<{ ok: boolean }>"),
    }
    code = {r["name"]: r["code"] for r in code_pairs(frame).collect()}
    assert code["g"] == "export const g = (a: number) => a + 1" and code["Load"].startswith("func (t") and code["Load"].endswith("\n}")


def test_marks_and_decoys():
    body = "import a\n\n\ndef f(x):\n    return g(x, 1)\n"
    assert marks("# Code generated by x. DO NOT EDIT.\n" + body, "python")[0]
    assert marks(body + "\n# AUTOGENERATED from a.schema -- edits are overwritten\n", "python")[0]
    assert marks("# Copied verbatim from lib release 1.2; report bugs upstream.\n" + body, "python")[1]
    assert marks("!function(){" + "var a=b[1]||{};" * 40 + "}()", "javascript")[2]
    assert marks("T = [\n" + "    1, 2, 3, 4,\n" * 20 + "]\n", "python")[3]
    for text in (body, "# Skips generated files; the handbook has a note on vendored code.\n" + body, "# Was generated once, maintained by hand since 2019\n" + body, "# Adapted from an idea in lib 1.2, rewritten from scratch for this project.\n" + body, body + 'S = "Code generated by x. DO NOT EDIT."\n', body + 'Q = "' + "SELECT a, " * 60 + '"\n' + body * 6):
        assert not any(marks(text, "python")[:4]), text


def test_copies_in_many_repositories_are_found(spark):
    copied = "\n".join(f"def f{i}(a, b):\n    return g{i * 7}(a) + h{i * 3}(b, {i})\n" for i in range(40))
    rows = [(f"r{i}", f"src/x{i}.py", f"# repo {i}\n\n{copied}", None) for i in range(4)] + [("r9", "src/own.py", copied.replace("f", "own").replace("g", "q"), None), ("r9", "vendor/lib/a.py", "x = 1\n", None), ("r9", "src/vendor_x/a.py", "x = 1\n", None), ("r9", "n.py", None, None), ("r9", "p_pb2.py", "x = 1\n", None)]
    out = {(r["repository_id"], r["node_id"]): r for r in mark_files(spark.createDataFrame(rows, FILES), spark.createDataFrame([("zz",), (None,)], "name string")).collect()}
    assert all(out[(f"r{i}", f"src/x{i}.py")]["vendored"] for i in range(4))
    assert not out[("r9", "src/own.py")]["vendored"] and out[("r9", "vendor/lib/a.py")]["vendored"] and not out[("r9", "src/vendor_x/a.py")]["vendored"]
    assert out[("r9", "p_pb2.py")]["generated"] and not out[("r9", "n.py")]["generated"]
    assert len(fingerprints(["a"] * 5)) == 0


def test_winnowing_finds_cut_and_edited_copies(spark):
    """Recall on planted partial copies without any notice: cut to 50 to 100 %, some lines edited, other comments."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line = lambda: f"    {word()} = {word()}({word()}, {rng.randint(1, 99)}) + {word()}.{word()}"
    base = [line() for _ in range(240)]
    rows = []
    for i in range(40):
        size = rng.randint(120, 240)
        at = rng.randint(0, 240 - size)
        part = [line() if rng.random() < 0.02 else x for x in base[at : at + size]]
        rows.append((f"r{i % 8}", f"src/copy{i}.py", f"# note {word()}\ndef {word()}():\n" + "\n".join(part) + "\n", None))
        rows.append((f"r{i % 8}", f"src/own{i}.py", f"def {word()}():\n" + "\n".join(line() for _ in range(120)) + "\n", None))
    marked = mark_files(spark.createDataFrame(rows, FILES), spark.createDataFrame([], "name string")).collect()
    copies = [r["vendored"] for r in marked if "copy" in r["node_id"]]
    assert sum(copies) / len(copies) >= 0.9 and not any(r["vendored"] for r in marked if "own" in r["node_id"])
