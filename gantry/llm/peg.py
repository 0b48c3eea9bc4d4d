"""A packrat parser generator for parsing-expression grammars over token kinds.

A text is lexed into one character per token, its kind. A grammar is compiled to Python functions
over that string of kinds; parts of it without rule references become possessive regular
expressions, which have the meaning of a PEG. Results of the rules named in `memo` are kept by
position (packrat). Rules named in `by_content` parse a segment whose end is certain from the
segment itself; accepted segments are also kept by content, across files, because a rule's result
depends on nothing but the kinds it reads.

    rule <- "if" "(" expr ")" (stmt / ";")? !NAME      literals in quotes, token classes in capitals,
                                                        @NL holds before a token that a line break precedes
"""

from __future__ import annotations

import re

END, BAD = "\x00", "\x01"
_SYNTAX = re.compile(r'\s+|#[^\n]*|(?P<rule>\w+)\s*<-|(?P<lit>"(?:[^"\\]|\\.)+")|(?P<name>\w+)|(?P<nl>@NL)|(?P<op>[/*+?&!()])')
#: Segments kept by content before the store is emptied; a bound on memory that doesn't change results.
_KEPT = 50_000


class Kinds(dict):
    """Token text -> kind; unknown tokens are classified once."""

    def __init__(self, known: dict[str, str], classify):
        super().__init__(known)
        self.base, self.classify = known, classify

    def __missing__(self, token: str) -> str:
        kind = self.classify(token)
        if len(token) <= 32:
            if len(self) > 200_000:
                self.clear()
                self.update(self.base)
            self[token] = kind
        return kind


class Memo:
    """Results of one parse by position, a table for each memoised rule; breaks: '1' for each token that a line break precedes."""

    def __getattr__(self, name: str) -> dict[int, int]:
        if not name.startswith("t_"):
            raise AttributeError(name)
        table: dict[int, int] = {}
        setattr(self, name, table)
        return table


class Grammar:
    def __init__(self, text: str, classes: dict[str, str], memo: set[str] = frozenset(), by_content: dict[str, str] | None = None):
        """classes: token class -> kind. by_content: rule -> regular expression over kinds (literals in quotes) of its segments."""
        self.classes = dict(classes)
        self.kinds: dict[str, str] = {}
        self.memo, self.segments = memo, {}
        self.rules = self._read(text)
        self._first: dict[str, tuple[set[str], bool]] = {}
        self._firsts()
        for rule, pattern in (by_content or {}).items():
            self.segments[rule] = re.compile(re.sub(r'"((?:[^"\\]|\\.)+)"', lambda m: re.escape(self.kind(m[1])), pattern))
        self.fast, self.traced = self._compile(False), self._compile(True)

    def kind(self, literal: str) -> str:
        if literal not in self.kinds:
            self.kinds[literal] = chr(0x100 + len(self.kinds))
        return self.kinds[literal]

    # -- reading ---------------------------------------------------------------------------------
    def _read(self, text: str) -> dict:
        tokens, at = [], 0
        while at < len(text):
            m = _SYNTAX.match(text, at)
            if not m:
                raise ValueError(f"grammar: {text[at:at + 40]!r}")
            at = m.end()
            if m.lastgroup:
                tokens.append((m.lastgroup, m[m.lastgroup]))
        rules, i = {}, 0
        while i < len(tokens):
            name = tokens[i][1]
            rules[name], i = self._choice(tokens, i + 1)
        return rules

    def _choice(self, t, i):
        node, i = self._sequence(t, i)
        options = [node]
        while i < len(t) and t[i] == ("op", "/"):
            node, i = self._sequence(t, i + 1)
            options.append(node)
        return (options[0] if len(options) == 1 else ("alt", options)), i

    def _sequence(self, t, i):
        items = []
        while i < len(t) and t[i][0] != "rule" and t[i] not in (("op", "/"), ("op", ")")):
            node, i = self._prefix(t, i)
            items.append(node)
        return (items[0] if len(items) == 1 else ("seq", items)), i

    def _prefix(self, t, i):
        if t[i] in (("op", "&"), ("op", "!")):
            node, j = self._prefix(t, i + 1)
            return ("and" if t[i][1] == "&" else "not", node), j
        what, value = t[i]
        if what == "op" and value == "(":
            node, i = self._choice(t, i + 1)
            assert t[i] == ("op", ")"), t[i]
        elif what == "lit":
            node = ("set", {self.kind(value[1:-1])})
        elif what == "nl":
            node = ("nl",)
        elif value == "END":
            node = ("set", {END})
        elif value == "ANY":
            node = ("any",)
        elif value in self.classes:
            node = ("set", {self.classes[value]})
        else:
            node = ("ref", value)
        i += 1
        while i < len(t) and t[i][0] == "op" and t[i][1] in "*+?":
            node, i = ({"*": "star", "+": "plus", "?": "opt"}[t[i][1]], node), i + 1
        return node, i

    # -- first sets ------------------------------------------------------------------------------
    def _firsts(self):
        self._first = {r: (set(), False) for r in self.rules}
        while True:
            new = {r: self._first_of(n) for r, n in self.rules.items()}
            if new == self._first:
                return
            self._first = new

    def _first_of(self, n) -> tuple[set[str] | None, bool]:
        """The kinds a match can begin with (None: any), and whether it can be empty."""
        what = n[0]
        if what == "set":
            return n[1], False
        if what == "any":
            return None, False
        if what == "ref":
            return self._first[n[1]]
        if what in ("and", "not", "nl"):
            return set(), True
        if what in ("star", "opt"):
            return self._first_of(n[1])[0], True
        if what == "plus":
            return self._first_of(n[1])
        if what == "alt":
            parts = [self._first_of(x) for x in n[1]]
            return (None if any(p[0] is None for p in parts) else set().union(*[p[0] for p in parts])), any(p[1] for p in parts)
        out: set[str] | None = set()
        for x in n[1]:
            first, empty = self._first_of(x)
            out = None if out is None or first is None else out | first
            if not empty:
                return out, False
        return out, True

    # -- compiling -------------------------------------------------------------------------------
    def _regex(self, n) -> str | None:
        """A possessive regular expression for a node without references, or None."""
        what = n[0]
        if what == "set":
            return "[" + "".join(map(re.escape, sorted(n[1]))) + "]"
        if what in ("ref", "nl", "any"):
            return None
        if what in ("seq", "alt"):
            parts = [self._regex(x) for x in n[1]]
            return None if None in parts else f"(?>{('' if what == 'seq' else '|').join(parts)})"
        part = self._regex(n[1])
        if part is None:
            return None
        return {"star": f"(?:{part})*+", "plus": f"(?:{part})++", "opt": f"(?:{part})?+", "and": f"(?={part})", "not": f"(?!{part})"}[what]

    def _compile(self, trace: bool) -> dict:
        space: dict = {"_re": [], "_kept": {r: set() for r in self.segments}, "_seg": self.segments}
        lines: list[str] = []
        count = [0]

        def emit(n, pad: str) -> None:
            what = n[0]
            count[0] += 1
            s = f"s{count[0]}"
            miss = f"{pad}    if i > m.far: m.far = i" if trace else None
            if what == "set":
                one = next(iter(n[1]))
                test = f"k[i] == {one!r}" if len(n[1]) == 1 else f"k[i] in {''.join(sorted(n[1]))!r}"
                lines.append(f"{pad}if {test}: i += 1")
                lines.append(f"{pad}else:")
                if miss:
                    lines.append(miss)
                lines.append(f"{pad}    i = -1")
                return
            if what == "any":
                lines.append(f"{pad}i = i + 1 if k[i] != {END!r} else -1")
                return
            if what == "nl":
                lines.append(f"{pad}if m.breaks[i] != '1': i = -1")
                return
            if what == "ref":
                lines.append(f"{pad}i = r_{n[1]}(k, i, m)")
                return
            if not trace and what != "seq" and (pattern := self._regex(n)) is not None:
                space["_re"].append(re.compile(pattern).match)
                lines.append(f"{pad}{s} = _re{len(space['_re']) - 1}(k, i)")
                lines.append(f"{pad}i = {s}.end() if {s} else -1")
                return
            if what == "seq":
                for j, x in enumerate(n[1]):
                    if j:
                        lines.append(f"{pad}if i >= 0:")
                        pad += "    "
                    emit(x, pad)
                return
            if what == "alt":
                lines.append(f"{pad}{s} = i")
                for j, x in enumerate(n[1]):
                    at = pad
                    if j:
                        lines.append(f"{pad}if i < 0:")
                        lines.append(f"{pad}    i = {s}")
                        at = pad + "    "
                    first, empty = self._first_of(x)
                    if first and not empty and not trace:
                        lines.append(f"{at}if k[i] in {''.join(sorted(first))!r}:")
                        emit(x, at + "    ")
                        lines.append(f"{at}else: i = -1")
                    else:
                        emit(x, at)
                return
            if what in ("star", "plus"):
                if what == "plus":
                    emit(n[1], pad)
                    lines.append(f"{pad}if i >= 0:")
                    pad += "    "
                first, empty = self._first_of(n[1])
                guard = f"k[i] in {''.join(sorted(first))!r}" if first and not empty and not trace else "True"
                lines.append(f"{pad}while {guard}:")
                lines.append(f"{pad}    {s} = i")
                emit(n[1], pad + "    ")
                lines.append(f"{pad}    if i <= {s}:")
                lines.append(f"{pad}        i = {s}")
                lines.append(f"{pad}        break")
                return
            lines.append(f"{pad}{s} = i")
            if what == "opt":
                first, empty = self._first_of(n[1])
                if first and not empty and not trace:
                    lines.append(f"{pad}if k[i] in {''.join(sorted(first))!r}:")
                    pad += "    "
                emit(n[1], pad)
                lines.append(f"{pad}if i < 0: i = {s}")
            elif what == "and":
                emit(n[1], pad)
                lines.append(f"{pad}if i >= 0: i = {s}")
            else:
                emit(n[1], pad)
                lines.append(f"{pad}i = {s} if i < 0 else -1")

        for rule, node in self.rules.items():
            lines.append(f"def r_{rule}(k, i, m):")
            pad = "    "
            if rule in self.segments and not trace:
                lines += [f"{pad}g = _seg[{rule!r}].match(k, i)", f"{pad}if g:", f"{pad}    e, u = g.end(), g[0]", f"{pad}    if '1' in m.breaks[i + 1:e]: e = -2", f"{pad}    elif u in _kept[{rule!r}]: return e", f"{pad}else: e = -2"]
            if rule in self.memo:
                lines += [f"{pad}t, z = m.t_{rule}, i", f"{pad}if i in t: return t[i]"]
            emit(node, pad)
            if rule in self.segments and not trace:
                lines += [f"{pad}if i == e:", f"{pad}    if len(_kept[{rule!r}]) > {_KEPT}: _kept[{rule!r}].clear()", f"{pad}    _kept[{rule!r}].add(u)"]
            if rule in self.memo:
                lines.append(f"{pad}t[z] = i")
            lines.append(f"{pad}return i")
        for j, match in enumerate(space["_re"]):
            space[f"_re{j}"] = match
        exec("\n".join(lines), space)  # noqa: S102 - the source is made from the grammar above
        return space

    # -- parsing ---------------------------------------------------------------------------------
    def accepts(self, kinds: str, breaks: str = "", start: str = "start", memo: Memo | None = None) -> bool:
        """Whether the rule, which must close with END, consumes all kinds; memo takes the results of the rules."""
        memo = Memo() if memo is None else memo
        memo.breaks = breaks + "1"
        return BAD not in kinds and self.fast["r_" + start](kinds + END, 0, memo) == len(kinds) + 1

    def furthest(self, kinds: str, breaks: str = "", start: str = "start") -> int:
        """The furthest token that a failing parse reached."""
        memo = Memo()
        memo.breaks, memo.far = breaks + "1", 0
        end = self.traced["r_" + start](kinds + END, 0, memo)
        return min(max(memo.far, end), len(kinds))
