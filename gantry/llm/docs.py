"""Problem 1: functions paired with their documentation.

Files are lexed once, for the parser and for the tokens that matter for structure (braces or
indentation, heads of functions, classes, comments, annotations). These are exploded to rows and
delimited in SQL: a cumulative-depth window gives each token its level, leads within a level find
where the body ends, islands of adjacent lines attach the comment directly above.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property
from itertools import accumulate, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gantry.llm.grammars import clean, language
from gantry.llm.parsing import language_of
from gantry.llm.peg import END, Memo

#: Kinds of rows: open and close (a brace or an indentation), class, head (a function), doc, at (an annotation), stop (the end of a lone expression).
_LEXED = "repository_id string, node_id string, lang string, at bigint, hash bigint, tokens array<struct<first int, line int, last int, kind string, text string>>"
_DOC = re.compile(r"/\*\*(?!/)(?:[^*]|\*(?!/))*\*/\s*\Z")
_GO_DOC = re.compile(r"(?:^[ \t]*//[^\n]*\n)+\Z", re.M)
_MARGIN = re.compile(r"[ID]+")
_PY_PLAIN = re.compile(r"[rRuU]?['\"]")
_CODE_FAMILY = {"python": "python", "javascript": "script", "typescript": "script", "go": "go", "java": "java"}


#: What a text with documented functions holds somewhere.
_SIGN = {"python": "def ", "javascript": "/**", "typescript": "/**", "java": "/**", "go": "//"}


class _Marks:
    """The kinds a language's heads are made of, and patterns over them."""

    def __init__(self, name: str):
        self.lang, family = language(name), _CODE_FAMILY[name]
        g = self.lang.grammar
        self.one = lambda *words: "[" + "".join(re.escape(g.kind(w)) for w in words if w in g.kinds) + "]"
        self.names = "".join(map(re.escape, sorted(g._first_of(("ref", "id"))[0]))) if family != "go" else "n"
        self.brackets = re.compile(self.one("(", "[", "{", ")", "]", "}")).finditer
        self.opening = {g.kinds[w] for w in "([{"}
        self.braces = re.compile(self.one("{", "}")).finditer
        n, one = self.names, self.one
        if family == "python":
            self.heads = re.compile(one("def"))
            self.classes = re.compile(one("class") + f"(?P<class>[{n}])")
        elif family == "script":
            mods = one("public", "private", "protected", "static", "async", "get", "set", "readonly", "abstract", "override", "accessor", "declare")
            called = f"[{n}p{one('delete')[1:-1]}]"
            self.heads = re.compile(
                f"(?:^|(?<=[LA]))(?:{one('export')}?{one('default')}?{one('declare')}?{one('async')}?{one('function')}{one('*')}?(?P<whole>[{n}])|{one('export')}?{one('const')}(?P<bound>[{n}])"
                f"|(?:{mods}(?={mods}|{called}|{one('*')}))*{one('*')}?(?P<method>{called})(?={one('?')}?{one('(', '<')}))"
            )
            self.classes = re.compile(one("class") + f"(?P<class>[{n}])")
        elif family == "java":
            self.before = "".join(sorted(g._first_of(("ref", "modifier"))[0] | g._first_of(("ref", "PRIMITIVE"))[0] - {g.kinds["@"]})) + "n"
            typed = re.escape(self.before + "".join(g.kinds[w] for w in (">", "]")))
            self.within = set(self.before) | {"L"} | {g.kinds[w] for w in (".", "<", ">", ",", "?", "&", "[", "]", "extends", "super")}
            self.heads = re.compile(f"[{typed}]L?(?P<method>[{n}])(?=L?{one('(')})|(?<=[LA])(?P<made>[{n}])(?={one('(')})")
            self.classes = re.compile(one("class", "interface", "enum", "record") + f"L?(?P<class>[{n}])(?!{one('=', '.')})")
        else:
            self.heads = re.compile(f"(?:^|(?<=[L{re.escape(g.kinds[';'])}])){one('func')}(?:{one('(')}[^{re.escape(g.kinds['('])}{re.escape(g.kinds[')'])}]*{one(')')})?(?P<whole>n)")
            self.classes = None


_MARKS: dict[str, _Marks] = {}


class Scan:
    """The tokens of one text, lexed once for the parser and for the rows of its functions.

    kinds has one character a token: L for a line break with the comments around it, A within
    annotations, the parser's kind otherwise.
    """

    def __init__(self, text: str, name: str, signatures: bool = True):
        self.signatures, self.memo = signatures, Memo()
        if name not in _MARKS:
            _MARKS[name] = _Marks(name)
        self.name, self.marks = name, _MARKS[name]
        self.lang = self.marks.lang
        self.text = "\n" + clean(text)
        self.tokens: list[str] = [""]
        if _SIGN[name] not in text:
            self.kinds = ""
            return
        self.tokens = self.lang.lexer.findall(self.text)
        while self.tokens and not self.tokens[-1]:
            self.tokens.pop()
        self.raw = kinds = self.lang.raw(self.tokens)
        self.sizes = None
        if len(kinds) != len(self.tokens) or self.tokens and self.tokens[-1][0] == "#":
            parts = [self.lang.kinds[t] for t in self.tokens]
            self.sizes = list(map(len, parts))
            kinds = "".join([p[0] if p else "L" for p in parts])
        if name == "go":
            semicolon = self.lang.grammar.kinds[";"]
            kinds = self.lang.breaks.sub(lambda m: semicolon + "L" * (len(m[0]) - 1), kinds + "L")[: len(kinds)]
        self.kinds = kinds

    def valid(self) -> bool:
        """Whether the text is grammatical; nesting beyond the parser's stack counts as a failure."""
        self.parsed, self.breaks = self.lang.encode(self.tokens, self.raw)
        try:
            return self.lang.grammar.accepts(self.parsed, self.breaks, memo=self.memo)
        except RecursionError:
            return False

    @cached_property
    def lines(self) -> list[int]:
        """The 1-based line that each token begins on (the number of line breaks before it)."""
        if self.name == "python" and "\\\n" in self.text:  # joined lines leave no token
            found, text = [m.start(1) for m in self.lang.lexer.finditer(self.text)][: len(self.tokens)], self.text
            return list(accumulate((text.count("\n", a, b) for a, b in zip([0, *found], [*found, len(text)])), initial=0))[1:]
        return list(accumulate([t.count("\n") for t in self.tokens], initial=0))

    @cached_property
    def places(self) -> list[int]:
        """Where each token is among the parser's kinds."""
        return list(accumulate([k != "L" for k in self.kinds] if self.sizes is None else [n if k != "L" else 0 for k, n in zip(self.kinds, self.sizes)], initial=0))

    def token(self, place: int) -> int:
        """The token at a place among the parser's kinds."""
        return bisect_right(self.places, place) - 1

    def closing(self, i: int) -> int:
        """The token that closes the bracket which token i opens."""
        depth = 0
        for m in self.marks.brackets(self.kinds, i):
            depth += 1 if m[0] in self.marks.opening else -1
            if not depth:
                return m.start()
        return len(self.kinds) - 1

    @cached_property
    def starts(self) -> list[int]:
        return [m.end() for m in re.finditer("\n", self.text)]

    def said(self, first: int, end: int) -> str:
        """The text of the tokens from first up to end, on one line and without comments between them."""
        line = self.lines[first]
        while end - 1 > first and self.kinds[end - 1] == "L":
            end -= 1
        begin = first
        while begin and "\n" not in self.tokens[begin - 1]:
            begin -= 1
        found = [m for m in islice(self.lang.lexer.finditer(self.text, self.starts[line - 1]), first - begin, end - begin)]
        return " ".join(self.text[found[0].start(1) : found[-1].end(1)].split()) if found else ""

    # -- rows --------------------------------------------------------------------------------------
    def rows(self) -> list[tuple[int, int, int, str, str | None]]:
        """(first line, line of the name, last line, kind, text) of the tokens that delimit documented functions.

        Empty if there is no function with a comment in its place, or if the text doesn't parse. The
        text of a head is its name, parameters, signature, owner (of a Go method) and "=>" before a lone expression, between NULs.
        """
        return self._python() if self.name == "python" else self._braced()

    def _head(self, first: int, name: int, params: tuple[int, int], end: int, owner: str = "", shape: str = "") -> tuple:
        text = "\0".join([self.tokens[name], " ".join(t for t, k in zip(self.tokens[slice(*params)], self.kinds[slice(*params)]) if k != "L"), self.said(first, end) if self.signatures else "", owner, shape])
        return (self.lines[first], self.lines[name], self.lines[end - 1], "head", text)

    def _python(self) -> list[tuple]:
        k, tokens, opening = self.kinds, self.tokens, self.marks.opening
        kind = self.lang.grammar.kinds
        colon, after, bracket = kind[":"], "L" + kind[";"], kind["("]
        found, docs = [], []
        for m in self.marks.heads.finditer(k):
            i = m.start()
            p = k.find(bracket, i)
            j = q = self.closing(p)
            while j < len(k) and k[j] != colon:  # a result type may hold brackets
                j = self.closing(j) + 1 if k[j] in opening else j + 1
            doc = j + 2 if k[j + 1 : j + 2] == "L" else j + 1
            documented = k[doc : doc + 1] == "s" and (doc + 1 >= len(k) or k[doc + 1] in after) and _PY_PLAIN.match(tokens[doc])
            if doc == j + 1 and not documented:
                continue  # its body is on the line
            found.append((i, j, p, q))
            if documented:
                docs.append(doc)
        if not docs or not self.valid():
            return []
        out, lines = {}, self.lines
        for i, j, p, q in found:
            first = i - 1 if i and k[i - 1] == kind["async"] else i
            out[i] = [self._head(first, i + 1, (p + 1, q), j)]
        for m in self.marks.classes.finditer(k):
            i = m.start()
            out[i] = [(lines[i], lines[i], lines[i], "class", tokens[i + 1])]
        for d in docs:
            out[d] = [(lines[d], lines[d], lines[d + 1], "doc", tokens[d])]
        # the parser's indents and dedents stand before the token at the place of the plain kinds so far
        parsed, plain, at = self.parsed, 0, 0
        for m in _MARGIN.finditer(parsed):
            plain += m.start() - at - parsed.count("N", at, m.start())
            at = m.end()
            i = self.token(plain)
            while i and k[i - 1] == "L":
                i -= 1
            before, after = lines[i], lines[min(i + 1, len(k))]
            out.setdefault(i, []).extend([(after, after, after, "open", None) if c == "I" else (before, before, before, "close", None) for c in m[0]])
        return [r for _, many in sorted(out.items()) for r in many]

    def _annotations(self, out: dict) -> None:
        """Masks the tokens of annotations in kinds and adds their rows."""
        g, k = self.lang.grammar, self.kinds
        sign, stop, bracket = g.kinds.get("@"), g.kinds.get("."), g.kinds["("]
        if not sign or sign not in k:
            return
        spans, at = [], k.find(sign)
        while at >= 0:
            j = at + 1
            if k[j : j + 1] != g.kinds.get("interface"):
                if k[j : j + 1] != bracket:
                    j += 1
                    while k[j : j + 1] == stop:
                        j += 2
                if k[j : j + 1] == bracket:
                    j = self.closing(j) + 1
                spans.append((at, j))
            at = k.find(sign, j)
        for a, b in spans:
            out[a] = [(self.lines[a], self.lines[a], self.lines[b - 1], "at", None)]
            self.kinds = self.kinds[:a] + "A" * (b - a) + self.kinds[b:]

    def _above(self, i: int) -> bool:
        """Whether a comment of documentation or an annotation stands before token i."""
        before = self.tokens[i - 1] if i else ""
        if self.name == "go":
            return "//" in before and before[-1] == "\n"
        return self.kinds[i - 1 : i] == "A" or self.kinds[i - 1 : i] == "L" and ("*/" in before or self.kinds[i - 2 : i - 1] == "A")

    def _braced(self) -> list[tuple]:
        pattern = _GO_DOC if self.name == "go" else _DOC
        out: dict[int, list] = {}
        self._annotations(out)
        k, tokens = self.kinds, self.tokens
        candidates = [m for m in self.marks.heads.finditer(k)]
        if self.name == "java":
            candidates = [(self._declared(m.start(m.lastgroup)), m.lastgroup, m.start(m.lastgroup)) for m in candidates]
        else:
            candidates = [(m.start(), m.lastgroup, m.start(m.lastgroup)) for m in candidates]
        candidates = [c for c in candidates if self._above(c[0])]
        if not candidates or not self.valid():
            return []
        skipped: list[tuple[int, int]] = []
        brace = self.lang.grammar.kinds["{"]
        for first, what, name in candidates:
            shape = self._shape(what, name)
            if shape is None:
                continue
            params, end, stop = shape
            owner = ""
            if self.name == "go" and k[first + 1] != "n":
                inner = [t for t, x in zip(tokens[first + 2 : name - 1], k[first + 2 : name - 1]) if x == "n" or t == "["]
                owner = (inner[: inner.index("[")] if "[" in inner else inner)[-1:]
                owner = owner[0] if owner else ""
            body = end < len(k) and k[end] == brace
            # the row stands where the body opens, so that the next one of its level is the body
            out.setdefault(end if body or stop else name, []).append(self._head(first, name, params, end, owner, "=>" if stop else ""))
            skipped.append((name, end))
            if stop:
                at = self.lines[stop - 1]
                out.setdefault(stop, []).insert(0, (at, at, at, "stop", None))
            before = tokens[first - 1]
            if m := pattern.search(before):
                begin = self.lines[first - 1] + before.count("\n", 0, m.start())
                doc = m[0].rstrip()
                out[first - 1] = [(begin, begin, begin + doc.count("\n"), "doc", doc)]
        heads = [r for many in out.values() for r in many if r[3] == "head"]
        if not heads:
            return []
        # the comment before an annotation that a head follows
        for i in [i for i, many in out.items() if many[0][3] == "at"]:
            if i and i - 1 not in out and self.kinds[i - 1] == "L" and (m := pattern.search(tokens[i - 1])):
                begin = self.lines[i - 1] + tokens[i - 1].count("\n", 0, m.start())
                out[i - 1] = [(begin, begin, begin + m[0].rstrip().count("\n"), "doc", m[0].rstrip())]
        if self.marks.classes:
            for m in self.marks.classes.finditer(k):
                at = self.lines[m.start()]
                out.setdefault(m.start(), []).append((at, at, at, "class", tokens[m.start("class")]))
        inside = np.zeros(len(k) + 1, np.int64)
        for a, b in skipped:
            inside[a] += 1
            inside[b] -= 1
        inside = np.cumsum(inside)
        for m in self.marks.braces(k):
            i = m.start()
            if not inside[i]:
                at = self.lines[i]
                out.setdefault(i, []).append((at, at, at, "open" if m[0] == brace else "close", None))
        return [r for _, many in sorted(out.items()) for r in many]

    def _declared(self, name: int) -> int:
        """The first token of the Java declaration whose name is token `name`."""
        i, k, within = name, self.kinds, self.marks.within
        while i and k[i - 1] in within:
            i -= 1
        while k[i] == "L" and i < name:
            i += 1
        return i

    def _shape(self, what: str, name: int) -> tuple[tuple[int, int], int, int | None] | None:
        """(tokens of the parameters, first token after the head, first token after a lone expression) of a head, by the grammar's rules."""
        rule, k, memo = self.lang.grammar.fast, self.parsed + END, self.memo
        kind = self.lang.grammar.kinds.get
        skip = lambda r, p: max(p, rule["r_" + r](k, p, memo))
        p = self.places[name] + 1
        stop = None
        if self.name == "go":
            p = skip("typeparams", p)
            begin, e = p, rule["r_parameters"](k, p, memo)
            end = rule["r_signature"](k, p, memo)
        elif self.name == "java":
            begin, e = p, rule["r_parameters"](k, p, memo)
            if e < 0 or what == "made" and self.tokens[name].isupper():
                return None
            end = e
            while k[end] == kind("[") and k[end + 1] == kind("]"):
                end += 2
            end = skip("throws", end)
            if k[end] != kind("{"):
                return None
        else:
            if what == "bound":
                p = skip("annot", p)
                if k[p] != kind("="):
                    return None
                p += 1
                if k[p] == kind("async"):
                    p += 1
                if k[p] == kind("function"):
                    p += 1
                    p += k[p] == kind("*")
                    p = skip("id", p)
            elif what == "method":
                p += k[p] == kind("?")
            p = skip("TP", p)
            begin, e = p, rule["r_params"](k, p, memo)
            if e < 0 and what == "bound":
                e = rule["r_id"](k, p, memo)
            if e < 0:
                return None
            end = skip("RT", e)
            if what == "bound" and k[end] == kind("=>"):
                end += 1
                if k[end] != kind("{"):
                    stop = rule["r_assign"](k, end, memo)
                    if stop < 0:
                        return None
            elif what != "whole" and k[end] != kind("{"):
                return None
        if e < 0 or end < 0:
            return None
        return (self.token(begin), self.token(e)), self.token(end), self.token(stop) if stop else None


# -- what counts as documentation --------------------------------------------------------------------
#: Words that placeholders are made of, in the languages seen in comments; a text of nothing else says nothing.
_EMPTY_WORDS = set("""
tbd tba na n none nil no not yet description descriptions describe described doc docs documentation document documented undocumented docstring comment comments goes here add added
helper helpers utility util utils misc miscellaneous internal private only getter setter accessor constructor wip work progress placeholder todo fixme xxx done write written me missing
coming soon later pending lorem ipsum summary your code self explanatory dummy stub nothing ignore stuff something thing things explain explained various some team see as be been will should must now
noch zu beschreiben beschreibung dokumentieren dokumentation dokumentiert folgt fehlt keine kein hilfsfunktion
à a documenter documentation décrire aucune aucun pas de faire compléter venir utilitaire
por documentar pendiente describir sin descripción descripcion documentación hacer completar ninguna auxiliar
descrever sem descrição descricao documentação fazer
da documentare nessuna descrizione
""".split())
_POINTER = re.compile(r"(?i)^[\s*]*(?:\{?@?inheritdoc\}?|@?see\b|see also\b|cf\b|refer to\b|same as\b|as above|ditto|ibid|voir\b|siehe\b|véase\b|ver\b|vgl\b|like above|copied from\b|inherited from\b|overrides?\b|documented in\b|documentation in\b|\{@link\b|https?://)")
_TODO = re.compile(r"(?i)^[\s*]*(?:todo|fixme|xxx|hack|wip)\b")
_FILLER = set("a an the this that these function functions method func def procedure routine helper used use uses to for of is are it its and or with which from by in on do does performs perform implements implementation that".split())
_TAG = re.compile(r"^@(\w+)(?:[ \t]+\{[^}]*\})?(?:[ \t]+(\[?[\w$.*]+(?:=[^\]]*)?\]?))?(?:[ \t]+-)?(.*)$")
_NAMED_TAGS = {"param", "arg", "argument", "throws", "exception", "throw", "property", "prop", "template", "typeparam"}
_SECTION = re.compile(r"(?i)^(args|arguments|parameters|params|returns?|raises|yields?|attributes|examples?|notes?)\s*:?$")
_FIELD_LINE = re.compile(r"^:(param|arg|type|return|returns|rtype|raises|raise)\b([^:]*):(.*)$")
_WORD = re.compile(r"[^\W\d_]+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[^A-Za-z0-9À-ɏ]+|(?<=\D)(?=\d)")


def plain_text(doc: str, lang: str) -> str:
    """The wording of a documentation comment without its comment signs."""
    if lang == "python":
        body = re.sub(r"^[rRuU]?('''|\"\"\"|'|\")", "", doc)
        quote = 3 if re.match(r"[rRuU]?('''|\"\"\")", doc) else 1
        return "\n".join(x.strip() for x in body[:-quote].split("\n")).strip()
    if lang == "go":
        lines = [x.strip() for x in doc.split("\n")]
        return "\n".join(x[2:].strip() for x in lines if not re.match(r"//(?:[a-z]+:\S|nolint\b|\s*\+build\b)", x)).strip()
    return "\n".join(re.sub(r"^\s*\*+ ?", "", x).strip() for x in doc.strip()[3:-2].split("\n")).strip()


def _forms(word: str) -> set[str]:
    """A word and what it may be an inflection of."""
    forms = {word}
    for ending, base in (("s", ""), ("es", ""), ("ies", "y"), ("ed", ""), ("ed", "e"), ("ied", "y"), ("ing", ""), ("ing", "e")):
        if word.endswith(ending) and len(word) > len(ending) + 2:
            forms.add(word[: -len(ending)] + base)
    return forms


def is_documented(doc: str | None, name: str, params: str, lang: str) -> bool:
    """Whether a comment says something about the function beyond its name, in any language."""
    if not doc:
        return False
    own = {w.lower() for part in (name, params) for w in _HUMP.split(part) if w}
    said = []
    for line in plain_text(doc, lang).split("\n"):
        line = line.strip()
        if m := _TAG.match(line):
            if m[1].lower() in ("see", "inheritdoc", "link", "override", "deprecated", "internal", "private", "public", "async"):
                line = m[3] if m[1].lower() == "deprecated" else ""
            else:
                line = m[3] if m[1].lower() in _NAMED_TAGS else f"{m[2] or ''} {m[3]}"
        elif m := _FIELD_LINE.match(line):
            line = m[3]
        elif _SECTION.match(line):
            continue
        if not _WORD.search(line) or _TODO.match(line):
            continue
        if _POINTER.match(line) and len(line.split()) <= 8:
            continue
        said.append(line)
    words = [w for line in said for w in _HUMP.split(line) if w and _WORD.search(w)]
    known = own | _FILLER | _EMPTY_WORDS
    return any(not _forms(w.lower()) & known for w in words)


def documented_functions(files: DataFrame, signatures: bool = True) -> DataFrame:
    """One row per function or method with real documentation, in files that parse.

    files(repository_id, node_id, ingested_at, text) -> repository_id, node_id, lang, name, symbol
    (the name within its class, function or receiver), first_line, start_line (of the name),
    end_line, signature, docstring.

    Null texts, files of other languages and files that don't parse yield nothing; repeated rows
    count once, the latest by ingested_at. Any number of functions and any length of text is taken.
    Without `signatures` that column is empty, for readers that don't want it: the optimizer can't
    prune what Python makes.
    """
    key = ["repository_id", "node_id"]

    def lex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, rows = [0], []
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
                rows += Scan(text, lang, signatures).rows()
                ends.append(len(rows))
            columns = list(zip(*rows)) or [[]] * 5
            fields = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()))]
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["first", "line", "last", "kind", "text"]))
            names = ["repository_id", "node_id", "lang", "at", "hash"]
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], tokens], [*names, "tokens"])

    at = F.unix_micros(F.col("ingested_at").cast("timestamp"))
    ready = files.select(*key, language_of(F.col("node_id")).alias("lang"), at.alias("at"), F.xxhash64("text").alias("hash"), "text").filter("lang is not null and text is not null")
    lexed = ready.mapInArrow(lex, _LEXED)
    # the latest row of a file; its tokens stay in the partition of its key, so that no window moves them again
    one = lexed.groupBy(*key).agg(F.max_by(F.struct("lang", "tokens"), F.struct("at", "hash")).alias("x"))
    # lang leaves its struct first, or each exploded row would carry all tokens along
    rows = one.select(*key, "x.lang", "x.tokens").select(*key, "lang", F.posexplode("tokens").alias("idx", "t")).select(*key, "lang", "idx", "t.*")

    kind = F.col("kind")
    file = Window.partitionBy(*key).orderBy("idx")
    upto = file.rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(kind == "open", 1).when(kind == "close", -1).otherwise(0)
    # the level outside a row's own bracket, and for brackets the one inside
    rows = rows.withColumn("level", F.sum(step).over(upto) - F.when(kind == "open", 1).otherwise(0))
    rows = rows.withColumn("inner", F.col("level") + F.when(kind == "open", 1).otherwise(0))
    # islands of rows on adjacent lines; the comment of a head is the last row before it and its annotations
    rows = rows.withColumn("gap", F.when(F.col("first") > F.lag("last").over(file) + 1, 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("gap").over(upto))
    above = F.last(F.when(kind != "at", F.struct("kind", "island", "text")), ignorenulls=True).over(file.rowsBetween(Window.unboundedPreceding, -1))
    # in Python the comment is the first row within
    within = F.when(F.lead("kind", 1).over(file) == "doc", F.lead("text", 1).over(file)).when((F.lead("kind", 1).over(file) == "open") & (F.lead("kind", 2).over(file) == "doc"), F.lead("text", 2).over(file))
    head = kind == "head"
    attached = F.when((above["kind"] == "doc") & (above["island"] == F.col("island")), above["text"])
    rows = rows.withColumn("raw", F.when(head, F.when(F.col("lang") == "python", within).otherwise(attached)))
    rows = rows.filter(~kind.isin("doc", "at"))
    # a head's body is the bracket that opens next on its level; a lone expression ends at its stop
    level = Window.partitionBy(*key, "level").orderBy("idx")
    back = Window.partitionBy(*key, "level").orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, -1)
    stop = F.last(F.when(kind == "stop", F.col("line")), ignorenulls=True).over(back)
    lone = F.col("text").endswith("\0=>")
    rows = rows.withColumn("end_line", F.when(lone, stop).when(F.lead("kind", 1).over(level) == "open", F.lead("line", 2).over(level)))
    name = F.when(head, F.split_part("text", F.lit("\0"), F.lit(1))).when(kind == "class", F.col("text"))
    rows = rows.withColumn("name", name).withColumn("owner", F.when(kind == "open", F.lag("name").over(level)))
    # the owner of a head is that of the bracket around it
    scope = Window.partitionBy(*key, "inner").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    around = F.last(F.when(kind == "open", F.struct("owner")), ignorenulls=True).over(scope)["owner"]
    heads = rows.withColumn("around", around).filter(head & F.col("raw").isNotNull())
    part = lambda i: F.split_part("text", F.lit("\0"), F.lit(i))
    owner = F.coalesce(F.nullif(part(4), F.lit("")), "around")
    heads = heads.select(
        *key, "lang", "name", F.concat_ws(".", owner, "name").alias("symbol"), F.col("first").alias("first_line"), F.col("line").alias("start_line"),
        F.coalesce("end_line", "last").alias("end_line"), part(3).alias("signature"), part(2).alias("params"), "raw",
    )

    def wording(raw: pd.Series, name: pd.Series, params: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series([plain_text(r, x) if is_documented(r, n, s, x) else None for r, n, s, x in zip(raw, name, params, lang)])

    told = heads.withColumn("docstring", F.pandas_udf(wording, "string")("raw", "name", "params", "lang"))
    return told.filter("docstring is not null").drop("raw", "params").dropDuplicates([*key, "start_line"])


def code_pairs(files: DataFrame) -> DataFrame:
    """documented_functions with `code`, the lines of each function from its first to its last one."""
    key = ["repository_id", "node_id"]
    latest = files.groupBy(*key).agg(F.max_by("text", F.struct(F.unix_micros(F.col("ingested_at").cast("timestamp")), F.xxhash64("text"))).alias("text"))
    lines = F.split(F.regexp_replace("text", "\\r\\n?", "\n"), "\n")
    code = F.array_join(F.slice(lines, F.col("first_line"), F.col("end_line") - F.col("first_line") + 1), "\n")
    return documented_functions(files).join(latest, key).withColumn("code", code).drop("text")
