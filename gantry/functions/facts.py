"""Facts about the functions and classes of Python sources, from their syntax trees.

One pass over a file gives rows of four kinds, as plain tuples that a mapInArrow turns into columns:
functions, classes, conditions and hits (patterns inside functions that detectors report). A file
that doesn't parse has none.
"""

from __future__ import annotations

import ast
import re

#: Calls that reach a network, a disk, a database or a process, by what they end in.
IO_CALLS = re.compile(
    r"(?:^|\.)(?:requests|httpx|session|client|http)\.(?:get|post|put|patch|delete|head|request|send)$|(?:^|\.)urlopen$|(?:^|\.)(?:cursor|conn|connection|db|engine)\.(?:execute|executemany|fetchone|fetchall|fetchmany|commit)$"
    r"|^open$|(?:^|\.)(?:read_text|write_text|read_bytes|write_bytes)$|(?:^|\.)subprocess\.(?:run|call|check_call|check_output|Popen)$|(?:^|\.)os\.(?:system|listdir|stat|remove|rename|popen)$|(?:^|\.)socket\.(?:create_connection|getaddrinfo)$|(?:^|\.)(?:s3|bucket|blob|redis|cache)\.(?:get_object|put_object|upload_file|download_file)$"
)
BLOCKING = re.compile(r"^time\.sleep$|^requests\.|^urllib\.request\.|^subprocess\.(?:run|call|check_call|check_output)$|^os\.system$|^socket\.create_connection$|^open$")
CLIENTS = re.compile(r"(?:^|\.)(?:Session|Client|AsyncClient|ClientSession|create_engine|MongoClient|Redis|StrictRedis|connect|boto3\.client|boto3\.resource|ThreadPoolExecutor|ProcessPoolExecutor)$")
LOCKS = re.compile(r"(?i)(?:^|[._])(?:r?lock|mutex|semaphore)$")
PARSERS = re.compile(r"^json\.(?:loads|dumps|load|dump)$")
#: Nested scopes that a function's own measures leave out.
_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef)
_LOOPS = (ast.For, ast.AsyncFor, ast.While)
_NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)


def _name(node: ast.AST) -> str:
    """The dotted name of a call's function; calls and indices on the way are left out."""
    if isinstance(node, ast.Attribute):
        inner = _name(node.value)
        return f"{inner}.{node.attr}" if inner else node.attr
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Call):
        return _name(node.func)
    if isinstance(node, ast.Subscript | ast.Await):
        return _name(node.value)
    return ""


def _own(node: ast.AST):
    """The descendants of a function without those of nested scopes."""
    todo = list(ast.iter_child_nodes(node))
    while todo:
        x = todo.pop()
        yield x
        if not isinstance(x, _SCOPES):
            todo.extend(ast.iter_child_nodes(x))


def cyclomatic(node: ast.AST) -> int:
    """1 and one for each branch, loop, handler, case, condition of a comprehension, and further operand of and/or."""
    n = 1
    for x in _own(node):
        if isinstance(x, ast.If | ast.IfExp | ast.For | ast.AsyncFor | ast.While | ast.ExceptHandler | ast.Assert | ast.match_case):
            n += 1
        elif isinstance(x, ast.BoolOp):
            n += len(x.values) - 1
        elif isinstance(x, ast.comprehension):
            n += 1 + len(x.ifs)
    return n


def _blocks(stmt: ast.stmt) -> list[list[ast.stmt]]:
    out = [getattr(stmt, k) for k in ("body", "orelse", "finalbody") if getattr(stmt, k, None)]
    return out + [h.body for h in getattr(stmt, "handlers", [])] + [c.body for c in getattr(stmt, "cases", [])]


def nesting(body: list[ast.stmt], depth: int = 0) -> int:
    """The greatest depth of nested control statements; elif is no deeper than its if."""
    most = depth
    for s in body:
        if isinstance(s, _NESTING):
            for i, block in enumerate(_blocks(s)):
                chained = isinstance(s, ast.If) and i == 1 and len(block) == 1 and isinstance(block[0], ast.If)
                most = max(most, nesting(block, depth if chained else depth + 1))
    return most


def bumps(body: list[ast.stmt]) -> int:
    """Statements of the function's own level whose control flow nests twice or deeper."""
    return sum(isinstance(s, _NESTING) and nesting([s]) >= 2 for s in body)


def _longest_asserts(body: list[ast.stmt]) -> list[tuple[int, int, int]]:
    """(first line, last line, statements) of the runs of assertions in a row."""
    runs: list[tuple[int, int, int]] = []
    run: list[ast.stmt] = []
    for s in [*body, None]:
        asserts = isinstance(s, ast.Assert) or isinstance(s, ast.Expr) and isinstance(s.value, ast.Call) and re.search(r"(?:^|\.)(?:assert\w*|expect)$", _name(s.value.func))
        if s is not None and asserts:
            run.append(s)
        elif run:
            runs.append((run[0].lineno, run[-1].end_lineno, len(run)))
            run = []
    return runs


def lcom4(cls: ast.ClassDef) -> tuple[int, int]:
    """(methods, components): methods hang together if they share an attribute of self or call each other."""
    methods = [m for m in cls.body if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef) and not any(_name(d) in ("staticmethod", "classmethod") for d in m.decorator_list)]
    names = {m.name for m in methods}
    root = {m.name: m.name for m in methods}

    def find(x: str) -> str:
        while root[x] != x:
            x = root[x]
        return x

    by_field: dict[str, str] = {}
    for m in methods:
        me = m.args.args[0].arg if m.args.args else "self"
        for x in ast.walk(m):
            if isinstance(x, ast.Attribute) and isinstance(x.value, ast.Name) and x.value.id == me:
                other = x.attr if x.attr in names else by_field.setdefault(x.attr, m.name)
                root[find(m.name)] = find(other)
    plain = {m.name for m in methods if not m.name.startswith("__")}
    return len(methods), len({find(n) for n in plain}) if plain else 0


def _kind(v: ast.AST) -> str:
    """list or str, if a value is one for certain."""
    if isinstance(v, ast.List | ast.ListComp) or isinstance(v, ast.Call) and _name(v.func) == "list":
        return "list"
    return "str" if isinstance(v, ast.JoinedStr) or isinstance(v, ast.Constant) and isinstance(v.value, str) else ""


def _loop_hits(fn: ast.AST) -> list[tuple[str, int]]:
    """(kind, line) of what a function does inside its loops, under its locks and between its awaits."""
    out: list[tuple[str, int]] = []
    made: dict[str, str] = {}
    for x in _own(fn):
        if isinstance(x, ast.Assign) and len(x.targets) == 1:
            target = x.targets[0]
            together = isinstance(target, ast.Tuple) and isinstance(x.value, ast.Tuple) and len(target.elts) == len(x.value.elts)
            for t, v in zip(target.elts, x.value.elts) if together else [(target, x.value)]:
                if isinstance(t, ast.Name):
                    made[t.id] = _kind(v)

    def visit(node: ast.AST, loops: int, locked: bool, asynchronous: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, _SCOPES):
                continue
            inner, held = loops, locked
            if isinstance(child, _LOOPS):
                if loops and isinstance(child, ast.For | ast.AsyncFor):
                    out.append(("nested_loop_quadratic", child.lineno))
                if isinstance(child, ast.For) and isinstance(child.iter, ast.Call) and _name(child.iter.func).endswith(".iterrows"):
                    out.append(("pandas_iterrows_in_loop", child.lineno))
                inner += 1
            if isinstance(child, ast.With | ast.AsyncWith) and any(LOCKS.search(_name(i.context_expr)) for i in child.items):
                held = True
                if loops:
                    out.append(("lock_in_loop", child.lineno))
            if isinstance(child, ast.Call):
                name = _name(child.func)
                if IO_CALLS.search(name):
                    if loops:
                        out.append(("io_in_loop", child.lineno))
                    if loops > 1:
                        out.append(("nested_loop_with_io", child.lineno))
                    if locked:
                        out.append(("blocking_io_under_lock", child.lineno))
                    out.append(("io", child.lineno))
                if asynchronous and BLOCKING.search(name) and not isinstance(node, ast.Await):
                    out.append(("blocking_sync_in_async", child.lineno))
                if loops:
                    if name == "re.compile":
                        out.append(("regex_compile_in_loop", child.lineno))
                    if PARSERS.search(name):
                        out.append(("json_parse_in_loop", child.lineno))
                    if CLIENTS.search(name):
                        out.append(("resource_construction_in_loop", child.lineno))
                    if name in ("pd.concat", "pandas.concat"):
                        out.append(("pd_concat_in_loop", child.lineno))
                    if name.endswith(".insert") and child.args and isinstance(child.args[0], ast.Constant) and child.args[0].value == 0:
                        out.append(("list_insert_zero_in_loop", child.lineno))
                    if LOCKS.search(name.removesuffix(".acquire")) and name.endswith(".acquire"):
                        out.append(("lock_in_loop", child.lineno))
                    out.append(("call_in_loop:" + name.rpartition(".")[2], child.lineno))
                out.append(("call:" + name.rpartition(".")[2], child.lineno))
            if loops and isinstance(child, ast.Await) and isinstance(child.value, ast.Call):
                out.append(("serial_await_in_loop", child.lineno))
            if loops and isinstance(child, ast.AugAssign) and isinstance(child.op, ast.Add) and isinstance(child.target, ast.Name) and made.get(child.target.id) == "str":
                out.append(("string_concat_in_loop", child.lineno))
            if loops and isinstance(child, ast.Compare):
                for op, right in zip(child.ops, child.comparators):
                    if isinstance(op, ast.In | ast.NotIn) and isinstance(right, ast.Name) and made.get(right.id) == "list":
                        out.append(("membership_test_against_list_in_loop", child.lineno))
            visit(child, inner, held, asynchronous)

    visit(fn, 0, False, isinstance(fn, ast.AsyncFunctionDef))
    for x in _own(fn):
        if isinstance(x, ast.ExceptHandler):
            silent = all(isinstance(s, ast.Pass | ast.Continue) or isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) for s in x.body)
            if silent or x.type is None:
                out.append(("error_handling", x.lineno))
    return out


def python_facts(text: str) -> tuple[list[tuple], list[tuple], list[tuple], list[tuple]]:
    """(functions, classes, conditions, hits) of a source; all empty if it doesn't parse.

    functions: name, start, end, ccn, nloc, nesting, bumps, params, is_async, longest run of assertions.
    classes: name, start, end, nloc, methods, components. conditions: function, line, operators.
    hits: function, kind, line.
    """
    functions, classes, conditions, hits = [], [], [], []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return functions, classes, conditions, hits
    lines = text.splitlines()
    code = [bool(x.strip()) and not x.strip().startswith("#") for x in lines]
    todo: list[tuple[ast.AST, str]] = [(tree, "")]
    while todo:
        node, prefix = todo.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                name = prefix + child.name
                nloc = sum(code[child.lineno - 1 : child.end_lineno])
                a = child.args
                params = [p.arg for p in [*a.posonlyargs, *a.args, *a.kwonlyargs]]
                bound = params[1:] if params[:1] in (["self"], ["cls"]) else params
                runs = _longest_asserts(child.body)
                functions.append((name, child.lineno, child.end_lineno, cyclomatic(child), nloc, nesting(child.body), bumps(child.body), len(bound), isinstance(child, ast.AsyncFunctionDef), max((r[2] for r in runs), default=0)))
                for x in _own(child):
                    if isinstance(x, ast.If | ast.While | ast.IfExp):
                        ops = sum(len(b.values) - 1 for b in ast.walk(x.test) if isinstance(b, ast.BoolOp))
                        if ops:
                            conditions.append((name, x.lineno, ops))
                hits.extend((name, kind, line) for kind, line in _loop_hits(child))
                todo.append((child, name + "."))
            elif isinstance(child, ast.ClassDef):
                count, parts = lcom4(child)
                classes.append((prefix + child.name, child.lineno, child.end_lineno, sum(code[child.lineno - 1 : child.end_lineno]), count, parts))
                todo.append((child, prefix + child.name + "."))
            else:
                todo.append((child, prefix))
    return functions, classes, conditions, hits


# -- SQL texts -----------------------------------------------------------------------------------
_SQL_STRIP = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'", re.S)


def sql_hits(text: str) -> list[tuple[str, int]]:
    """(kind, line) of the statements of a SQL text: select star in a view, a join without a predicate, update or delete without where."""
    out = []
    at = 1
    for statement in _SQL_STRIP.sub(lambda m: "\n" * m[0].count("\n"), text).split(";"):
        line = at + statement[: len(statement) - len(statement.lstrip())].count("\n")
        at += statement.count("\n")
        s = " ".join(statement.lower().split())
        if re.match(r"create (?:or replace )?(?:materialized )?view\b", s) and re.search(r"\bselect (?:distinct )?(?:\w+\.)?\*", s):
            out.append(("sql_select_star", line))
        if re.match(r"(?:update\b.+\bset\b|delete from\b)", s) and not re.search(r"\bwhere\b", s):
            out.append(("sql_update_delete_without_where", line))
        m = re.search(r"\bfrom ([\w.]+(?: (?:as )?\w+)?(?: ?, ?[\w.]+(?: (?:as )?\w+)?)+)", s)
        if m and not re.search(r"\bwhere\b", s):
            out.append(("sql_cartesian_join", line))
        if re.match(r"create (?:or replace )?(?:function|procedure)\b", s):
            ccn = 1 + len(re.findall(r"\b(?:if|elsif|elseif|when|loop|while|and|or|exception)\b", s))
            out.append((f"sql_routine:{ccn}", line))
    return out


# -- Go and script sources -----------------------------------------------------------------------
_GO_STRIP = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\.)*'", re.S)
_GO_TOKEN = re.compile(r"\b(?:for|func|defer|go)\b|[{}\n]")
_SPREAD = re.compile(r"\.reduce\(\s*(?:async\s*)?\(?\s*(\w+)[^=]{0,200}=>\s*(?:\{\s*return\s*)?\[\s*\.\.\.\s*\1\b")


def go_hits(text: str) -> list[tuple[str, int]]:
    """(kind, line): defers and goroutines started in the body of a loop of the same function."""
    out, stack, pending, line = [], [], "", 1
    for m in _GO_TOKEN.finditer(_GO_STRIP.sub(lambda m: "\n" * m[0].count("\n"), text)):
        t = m[0]
        if t == "\n":
            line += 1
        elif t in ("for", "func"):
            pending = t
        elif t == "{":
            stack.append(pending)
            pending = ""
        elif t == "}":
            if stack:
                stack.pop()
        else:
            inner = next((x for x in reversed(stack) if x), "")
            if inner == "for":
                out.append(("defer_in_loop" if t == "defer" else "goroutine_in_unbounded_loop", line))
    return out


def script_hits(text: str) -> list[tuple[str, int]]:
    """(kind, line): reductions that spread their accumulator at every step."""
    return [("array_spread_in_reduce", 1 + text.count("\n", 0, m.start())) for m in _SPREAD.finditer(text)]
