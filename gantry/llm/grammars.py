"""Lexers and parsing-expression grammars of the five source languages.

Only grammar is judged: tokens, strings, brackets, blocks and statements. The grammars accept a
little more than the languages where only names or types could tell (assignment targets, operator
precedence), and nothing less that they define: Python as of 3.13, ECMAScript 2024, TypeScript 5,
Go 1.22 and Java 21, without JSX.
"""

from __future__ import annotations

import re
import sys

from gantry.llm.peg import BAD, Grammar, Kinds

_CLASSES = {"NAME": "n", "NUM": "0", "STR": "s", "RE": "r", "PRIVATE": "p", "NEWLINE": "N", "INDENT": "I", "DEDENT": "D"}

# -- Python --------------------------------------------------------------------------------------
_PYTHON = r'''
start <- (NEWLINE / stmt)* END
stmt <- compound / line
line <- small (";" small)* ";"? NEWLINE
small <- "pass" / "break" / "continue" / "return" stars? / "raise" (expr ("from" expr)?)? / ("global" / "nonlocal") id ("," id)*
  / "del" stars / "assert" expr ("," expr)? / "import" dotted ("as" id)? ("," dotted ("as" id)?)* / "from" source "import" imported
  / "type" id typeparams? "=" expr !("=") / assignment
source <- ("." / "...")* dotted / ("." / "...")+
imported <- "*" / "(" alias ("," alias)* ","? ")" / alias ("," alias)*
alias <- id ("as" id)?
dotted <- id ("." id)*
assignment <- value (":" expr ("=" value)? / AUGMENTED value / ("=" value)*)
value <- "yield" ("from" expr / stars)? / stars
stars <- star ("," star)* ","?
star <- "*" bitor / named
named <- id ":=" expr / expr
expr <- "lambda" lambdaparams? ":" expr / logic ("if" logic "else" expr)?
logic <- inversion (("and" / "or") inversion)*
inversion <- "not" inversion / comparison
comparison <- bitor (("<" / ">" / "==" / "!=" / "<=" / ">=" / "in" / "is" "not" / "is" / "not" "in") bitor)*
bitor <- unary (BINARY unary)*
unary <- ("+" / "-" / "~")* "await"? atom trailer* ("**" unary)?
trailer <- "." id / "(" args? ")" / "[" slices "]"
args <- arg ("," arg)* ","?
arg <- "*" expr / "**" expr / id "=" expr / named comp?
slices <- slice ("," slice)* ","?
slice <- "*" bitor / expr? ":" expr? (":" expr?)? / named
comp <- ("async"? "for" targets "in" logic ("if" disjunct)*)+
disjunct <- id ":=" logic / logic
targets <- target ("," target)* ","?
target <- "*"? bitor
atom <- id / NUM / STR+ / "None" / "True" / "False" / "..." / "(" ")" / "(" "yield" ("from" expr / stars)? ")" / "(" group ")" / "[" (simple ",")* (star comp / stars)? "]" / "{" (simple ":" simple ",")* entries? "}"
simple <- (NUM / STR / NAME) &("," / ":")
group <- star comp / stars
entries <- pair (comp / ("," pair)* ","?) / star comp / stars
pair <- "**" bitor / expr ":" expr
lambdaparams <- lambdaparam ("," lambdaparam)* ","?
lambdaparam <- "**" id / "*" id? / "/" / id ("=" expr)?
id <- NAME / "match" / "case" / "type" / "_"
compound <- ifstmt / "while" named ":" block else? / "for" targets "in" stars ":" block else? / "try" ":" block (except+ else? final? / final)
  / "with" withitems ":" block / decorated / "async" ("def" def / "for" targets "in" stars ":" block else? / "with" withitems ":" block) / "def" def / "class" class / match
ifstmt <- "if" named ":" block ("elif" named ":" block)* else?
else <- "else" ":" block
final <- "finally" ":" block
except <- "except" "*"? (expr ("," expr)* ("as" id)?)? ":" block
withitems <- "(" withitem ("," withitem)* ","? ")" &":" / withitem ("," withitem)*
withitem <- expr ("as" target)?
decorated <- ("@" named NEWLINE)+ ("async"? "def" def / "class" class)
def <- defhead block
defhead <- id typeparams? "(" params? ")" ("->" expr)? ":"
class <- id typeparams? ("(" args? ")")? ":" block
typeparams <- "[" typeparam ("," typeparam)* ","? "]"
typeparam <- ("*" / "**")? id (":" expr)? ("=" star)?
params <- param ("," param)* ","?
param <- "**" id (":" expr)? / "*" (id (":" star)? ("=" expr)?)? / "/" / id (":" expr)? ("=" expr)?
block <- NEWLINE INDENT stmt+ DEDENT / line
match <- "match" subject ":" NEWLINE INDENT ("case" patterns ("if" named)? ":" block)+ DEDENT
subject <- star ("," star)* ","?
patterns <- pattern ("," pattern)* ","?
pattern <- orpattern ("as" id)?
orpattern <- closed ("|" closed)*
closed <- "*" id / ("-"? NUM (("+" / "-") NUM)?) / STR+ / "None" / "True" / "False" / id ("." id)* ("(" (classarg ("," classarg)* ","?)? ")")? / "(" patterns? ")" / "[" patterns? "]" / "{" (mapitem ("," mapitem)* ","?)? "}"
classarg <- id "=" pattern / pattern
mapitem <- "**" id / closed ":" pattern
AUG <- "+=" / "-=" / "*=" / "/=" / "//=" / "%=" / "@=" / "&=" / "|=" / "^=" / ">>=" / "<<=" / "**="
BIN <- "|" / "^" / "&" / "<<" / ">>" / "+" / "-" / "*" / "/" / "//" / "%" / "@"
'''.replace("AUGMENTED", "AUG").replace("BINARY", "BIN")

_NL_PY = r"(?:[ \t\f]*(?:\#[^\n]*)?\n)+[ \t\f]*"
_IN = r"(?:[^{}'\"\n]|'[^'\n]*'|\"[^\"\n]*\"|\{(?:[^{}\n]|\{[^{}\n]*\})*\})*"  # of an f-string's braces
_IN3 = r"(?:[^{}'\"]|'[^']*'|\"[^\"]*\"|\{(?:[^{}]|\{[^{}]*\})*\})*"
_PY_LEX = re.compile(
    r"(?:[ \t\f]+|\\\n)*+([^\W\d]\w*+(?!['\"])|[=(),.:\[\]](?![=\d.])|"
    + _NL_PY.replace(r"(?:[ \t\f]*(?:\#[^\n]*)?\n)+", r"(?:\#[^\n]*)?\n(?:[ \t\f]*(?:\#[^\n]*)?\n)*")
    + r"|\#[^\n]*"
    r"|(?:[rR]?[fF]|[fF][rR])(?:'''(?:[^'\\{}]|\\[^{}]|\\(?=[{}])|'(?!'')|\{\{|\}\}|\{" + _IN3 + r"\})*'''|\"\"\"(?:[^\"\\{}]|\\[^{}]|\\(?=[{}])|\"(?!\"\")|\{\{|\}\}|\{" + _IN3 + r"\})*\"\"\""
    r"|'(?:[^'\\{}\n]|\\[^{}]|\\(?=[{}])|\{\{|\}\}|\{" + _IN + r"\})*'|\"(?:[^\"\\{}\n]|\\[^{}]|\\(?=[{}])|\{\{|\}\}|\{" + _IN + r"\})*\")"
    r"|(?:[rRbBuU]|[bB][rR]|[rR][bB])?(?:'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'(?!'')(?:[^'\\\n]|\\[\s\S])*'|\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*\"|''(?!')|\"\"(?!\"))"
    r"|[^\W\d]\w*"
    r"|(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)\w*"
    r"|\*\*=|//=|>>=|<<=|\.\.\.|->|:=|[+\-*/%@&|^=!<>]=|\*\*|//|<<|>>|[^\s]|\Z)"
)
_PY_NUM = re.compile(r"(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:0(?:_?0)*|[1-9](?:_?\d)*)|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*)[jJ]?|(?:\d(?:_?\d)*|)[jJ]")
_PY_NUM_THEN = re.compile(r"(?:and|or|if|else|in|is|for|not)\b")
_FIELD = re.compile(r"\{\{|\}\}|\{")

# -- JavaScript and TypeScript -------------------------------------------------------------------
_SCRIPT = r'''
start <- stmt* END
semi <- ";" / &"}" / &END / @NL
block <- "{" stmt* "}"
stmt <- simple / block / ";" / ifstmt / "for" "await"? "(" forhead ")" stmt / "while" "(" expr ")" stmt / "do" stmt "while" "(" expr ")" ";"?
  / "try" block ("catch" ("(" binding annot? ")")? block ("finally" block)? / "finally" block) / "switch" "(" expr ")" "{" (("case" expr / "default") ":" stmt*)* "}"
  / import / export / declaration / "with" "(" expr ")" stmt / id ":" stmt / other
simple <- (DECL declarators / "return" (!@NL expr)? / "throw" expr / ("break" / "continue") (!@NL id)? / "debugger") semi
other <- expr semi
ifstmt <- "if" "(" expr ")" stmt ("else" stmt)?
forhead <- DECL binding annot? ("of" assign / "in" expr) / DECL declarators ";" expr? ";" expr? / !("async" "of") operand ("of" assign / "in" expr) / expr? ";" expr? ";" expr?
DECL <- "const" !"enum" / "var" / "let" &(NAME / "[" / "{" / CONTEXT)
declarators <- declarator ("," declarator)*
declarator <- binding "!"? annot? ("=" assign)?
import <- "import" (STR attributes? semi / TYPEONLY? clause "from" STR attributes? semi / IMPORTEQ)
attributes <- ("with" / "assert") object
clause <- id ("," (namespace / named))? / namespace / named
namespace <- "*" "as" id
named <- "{" (spec ("," spec)* ","?)? "}"
spec <- ("type" !("," / "}" / "as" ("," / "}")))? (word / STR) ("as" (word / STR))?
export <- "export" (TYPEEXPORT / "default" (declaration / hoisted / assign semi) / "*" ("as" (word / STR))? "from" STR attributes? semi / named ("from" STR attributes?)? semi / decorator* declaration / DECL declarators semi)
hoisted <- "async"? "function" "*"? TP? params RT? block / "abstract"? class
declaration <- "async" !@NL function / function / decorator* class / TYPEDECL
function <- "function" "*"? id TP? params RT? BODY
decorator <- "@" ("(" expr ")" / id ("." word)* arguments?)
class <- "class" (!"implements" id)? TP? ("extends" operand TA?)? IMPL? "{" member* "}"
member <- ";" / "static" block / decorator* (!(MODIFIER ("(" / "=" / ";" / "}" / "?" / "!" / ":" / "<")) MODIFIER)* (INDEX / method / field)
MODIFIER <- "static" / "accessor" / TSMOD
method <- (("get" / "set" / "async" !@NL "*"? / "async" !@NL) &(word / STR / NUM / "[" / PRIVATE))? "*"? propname "?"? TP? params RT? BODY
field <- propname ("?" / "!")? annot? ("=" assign)? semi
propname <- word / STR / NUM / "[" assign "]" / PRIVATE
params <- "(" (param ("," param)*)? ","? ")"
param <- decorator* (TSMOD &(NAME / "{" / "[" / CONTEXT))* "..."? (binding / "this") "?"? annot? ("=" assign)?
binding <- id / "{" (bindprop ("," bindprop)*)? ","? "}" / "[" ","* (bindelem (","+ bindelem)*)? ","* "]"
bindprop <- "..." binding / propname ":" binding ("=" assign)? / id ("=" assign)?
bindelem <- "..."? binding ("=" assign)?
expr <- assign ("," assign)*
assign <- arrow / "yield" (!@NL "*"? assign)? / operand (ASSIGN assign / (operator operand / CAST)* ("?" assign ":" assign)?)
arrow <- ("async" !@NL)? (id / TP? params RT?) "=>" (block / assign)
operator <- BINOP / ">" ">"? ">"? "="?
operand <- PREFIX* primary suffix* (!@NL ("++" / "--"))?
suffix <- "." (word / PRIVATE) / "?." (word / PRIVATE / "[" expr "]" / arguments / STR / TA arguments) / "[" expr "]" / arguments / STR / NONNULL / TA &("(" / STR)
arguments <- "(" (atomic ",")* ("..."? assign ("," "..."? assign)*)? ","? ")"
atomic <- (NAME / NUM / STR) &","
primary <- "async" !@NL "function" "*"? id? TP? params RT? block / "function" "*"? id? TP? params RT? block / id !"=>" / NUM / STR / RE / "this" / "super" / "null" / "true" / "false" / array / object
  / decorator* class / "(" expr ")" / "new" "." word / "new" / "import" (arguments / "." word) / PRIVATE &"in" / ASSERTION
array <- "[" (atomic ",")* ","* ("..."? assign (","+ "..."? assign)*)? ","* "]"
object <- "{" (prop ("," prop)*)? ","? "}"
prop <- "..." assign / id &("," / "}") / method / propname ":" assign / id "=" assign
id <- NAME / CONTEXT / "await" / "yield" / "let" / "static" / "implements" / "interface" / "package" / "private" / "protected" / "public"
CONTEXT <- "async" / "of" / "get" / "set" / "as" / "from" / "type" / "accessor" / "assert" / "abstract" / "declare" / "readonly" / "namespace" / "module" / "keyof" / "infer" / "is" / "asserts" / "satisfies" / "override" / "unique" / "global" / "out"
word <- id / "if" / "for" / "while" / "do" / "try" / "catch" / "finally" / "switch" / "case" / "default" / "import" / "export" / "with" / "return" / "throw" / "break" / "continue" / "debugger" / "else" / "const" / "enum" / "var" / "in" / "function" / "class" / "extends" / "new" / "this" / "super" / "null" / "true" / "false" / "typeof" / "void" / "delete" / "instanceof"
ASSIGN <- "=" / "+=" / "-=" / "*=" / "/=" / "%=" / "**=" / "<<=" / "&=" / "|=" / "^=" / "&&=" / "||=" / "??=" / ">" ">" ">"? "="
BINOP <- "+" / "-" / "*" / "/" / "%" / "**" / "==" / "!=" / "===" / "!==" / "<" / "<=" / "<<" / "&" / "|" / "^" / "&&" / "||" / "??" / "in" / "instanceof"
PREFIX <- "!" / "~" / "+" / "-" / "++" / "--" / "typeof" / "void" / "delete" / "await" &(NAME / NUM / STR / "(" / "[" / "{" / "this" / "new" / "import" / "super" / "function" / "async" / CONTEXT / "await" / "class" / "null") / "new" !"."
'''
_JS = r'''
annot <- !ANY ANY
TYPEONLY <- !ANY ANY
IMPORTEQ <- !ANY ANY
TYPEEXPORT <- !ANY ANY
TP <- !ANY ANY
RT <- !ANY ANY
TA <- !ANY ANY
IMPL <- !ANY ANY
TYPEDECL <- !ANY ANY
TSMOD <- !ANY ANY
INDEX <- !ANY ANY
BODY <- block
CAST <- !ANY ANY
NONNULL <- !ANY ANY
ASSERTION <- !ANY ANY
'''
_TS = r'''
annot <- ":" type
TYPEONLY <- "type" !("from" STR) !","
IMPORTEQ <- "type"? id "=" ("require" "(" STR ")" / id ("." word)*) semi
TYPEEXPORT <- "type" named ("from" STR)? semi / "type" "*" ("as" word)? "from" STR semi / "=" expr semi / "as" "namespace" id semi / "import" id "=" expr semi
TP <- "<" ("const" / "in" / "out")* id ("extends" type)? ("=" type)? ("," ("const" / "in" / "out")* id ("extends" type)? ("=" type)?)* ","? ">"
RT <- ":" ("asserts"? id "is" type / "asserts" id / type)
TA <- "<" type ("," type)* ","? ">"
IMPL <- "implements" typeref ("," typeref)*
TYPEDECL <- "interface" id TP? ("extends" typeref ("," typeref)*)? objtype / "type" !@NL id TP? "=" type semi / "const"? "enum" id "{" (enumitem ("," enumitem)*)? ","? "}"
  / "declare" !@NL ("global" block / declaration / DECL declarators semi) / "abstract" !@NL class / ("namespace" / "module") !@NL (id ("." word)* / STR) (block / semi)
enumitem <- propname ("=" assign)?
TSMOD <- "public" / "private" / "protected" / "readonly" / "abstract" / "override" / "declare" / "out" / "in"
INDEX <- "[" id ":" type "]" annot? semi
CAST <- ("as" / "satisfies") ("const" / type)
BODY <- block / semi
NONNULL <- !@NL "!"
ASSERTION <- "<" ("const" / type) ">" operand
type <- fntype / union ("extends" union "?" type ":" type)?
fntype <- "abstract"? "new"? TP? params "=>" ("asserts"? id "is" type / "asserts" id / type)
union <- "|"? inter ("|" inter)*
inter <- "&"? posttype ("&" posttype)*
posttype <- ("keyof" / "readonly" / "unique" / "infer") &(NAME / "(" / "[" / "{" / "typeof" / STR / CONTEXT / "keyof") posttype ("extends" union !"?")? / basictype (!@NL "[" type? "]")*
basictype <- "(" type ")" / objtype / "[" (tupleitem ("," tupleitem)*)? ","? "]" / "typeof" (typeref / "import" arguments ("." word)*) / "import" arguments ("." word)* TA? / STR / "-"? NUM / "void" / "null" / "this" ("is" type)? / "true" / "false" / typeref
tupleitem <- "..."? (id "?"? ":")? "..."? type "?"?
typeref <- id ("." word)* (!@NL TA)?
objtype <- "{" mapped "}" / "{" (typemember (";" / "," / &"}" / @NL))* "}"
mapped <- (("+" / "-")? "readonly")? "[" id "in" type ("as" type)? "]" (("+" / "-")? "?")? annot? ";"?
typemember <- "new"? TP? params RT? / ("get" / "set") propname params RT? / "readonly"? "[" id ":" type "]" annot? / ("readonly" &(word / STR / NUM / "["))? propname "?"? (TP? params RT? / annot?)
'''

_REGEX = r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*"
_TPL1 = r"`(?:[^`\\]|\\[\s\S])*`"
_HOLE = r"\$\{(?:[^{}`'\"]|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|" + _TPL1 + r"|\{(?:[^{}`'\"]|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|\{(?:[^{}])*\})*\})*\}"
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|" + _HOLE + r")*`"
_COMMENT1 = r"//[^\n]*|/\*(?:[^*\n]|\*(?!/))*\*/"
_COMMENTN = r"/\*(?:[^*]|\*(?!/))*\*/"
_STRINGS = r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'"
_SCRIPT_NUM = r"0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?"
_SCRIPT_LEX = re.compile(
    r"(?:[ \t\f\v\xa0\ufeff]+|" + _COMMENT1 + r")*+((?:\n|" + _COMMENTN + r")(?:\s|//[^\n]*|" + _COMMENTN + r")*"
    r"|(?:return|typeof|case|in|of|do|else|void|delete|throw|new|await|yield)(?![\w$])(?:\s*" + _REGEX + r")?"
    r"|[\w$][\w$]*(?:(?<=\d)(?<![A-Za-z_$]\d)(?<![A-Za-z_$]\d\d)\.[\d_]*(?:[eE][+-]?\d+)?)?"
    r"|\#[A-Za-z_$][\w$]*|\.\d[\d_]*(?:[eE][+-]?\d+)?|" + _STRINGS + r"|" + _TEMPLATE + r"|/\*"
    r"|(?:=>|\*\*=|<<=|&&=|\|\|=|\?\?=|===|!==|==|!=|<=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|&&|\|\||\?\?|\*\*|<<|\.\.\.|[=(,:;!&|?{}\[+\-*%<>~^])(?:\s*" + _REGEX + r")?|\?\.(?!\d)|\+\+|--|[^\s]|\Z)"
)
_SCRIPT_LEX = re.compile(_SCRIPT_LEX.pattern.replace(r"(?:=>|", r"\+\+|--|\?\.(?!\d)|(?:=>|", 1))
_SCRIPT_NUMBER = re.compile(r"(?:" + _SCRIPT_NUM + r")\Z")
_WITH_REGEX = re.compile(r"(\S+?)\s*(" + _REGEX + r")\Z")

# -- Go ------------------------------------------------------------------------------------------
_GO = r'''
start <- "package" NAME ";" (import ";")* (topdecl ";")* (topdecl ";"?)? END
import <- "import" (importspec / "(" (importspec ";")* importspec? ")")
importspec <- ("." / NAME)? STR
topdecl <- "func" NAME typeparams? signature block? / "func" parameters NAME signature block? / decl
decl <- "const" (constspec / "(" (constspec ";")* constspec? ")") / "var" (varspec / "(" (varspec ";")* varspec? ")") / "type" (typespec / "(" (typespec ";")* typespec? ")")
constspec <- names (type? "=" exprs)?
varspec <- names (type ("=" exprs)? / "=" exprs)
typespec <- NAME (typeparams type / "="? type)
typeparams <- "[" names constraint ("," names constraint)* ","? "]"
constraint <- "~"? type ("|" "~"? type)*
names <- NAME ("," NAME)*
signature <- parameters (parameters / type)?
parameters <- "(" (paramdecl ("," paramdecl)*)? ","? ")"
paramdecl <- NAME "..."? type / "..."? type
type <- "(" type ")" / "*" type / "[" "]" type / "[" ("..." / expr) "]" type / "map" "[" type "]" type / "chan" "<-"? type / "<-" "chan" type / "func" signature / struct / interface / typename
typename <- NAME ("." NAME)? ("[" type ("," type)* ","? "]")?
struct <- "struct" "{" (fielddecl ";")* fielddecl? "}"
fielddecl <- (names type / "*"? typename) STR?
interface <- "interface" "{" (ifaceelem ";")* ifaceelem? "}"
ifaceelem <- NAME signature / constraint
block <- "{" stmts "}"
stmts <- ended* stmt?
ended <- stmt? ";"
stmt <- decl / line / block / "if" ifrest / "for" forhead? block / "switch" switchhead "{" (("case" types / "default") ":" stmts)* "}" / "select" "{" (("case" comm / "default") ":" stmts)* "}" / "go" expr / "defer" expr / NAME ":" stmt? / simple
line <- "return" exprs? / "break" NAME? / "continue" NAME? / "goto" NAME / "fallthrough"
ifrest <- (xsimple? ";")? xexpr block ("else" ("if" ifrest / block))?
forhead <- "range" xexpr / xexprs (":=" / "=") "range" xexpr / xsimple? ";" xexpr? ";" xsimple? / xexpr
switchhead <- (xsimple? ";")? (NAME ":=" xexpr / xexpr)?
types <- (type &(":" / ",") / expr) ("," (type &(":" / ",") / expr))*
comm <- exprs ("<-" expr / (":=" / "=") expr)?
simple <- exprs (ASSIGN exprs / "++" / "--" / "<-" expr)?
xsimple <- xexprs (ASSIGN xexprs / "++" / "--" / "<-" xexpr)?
exprs <- expr ("," expr)*
xexprs <- xexpr ("," xexpr)*
expr <- unary (BINOP unary)*
xexpr <- xunary (BINOP xunary)*
unary <- UNARY* operand suffix*
xunary <- UNARY* xoperand suffix*
operand <- NUM / STR / "func" signature block / composite / conversion / NAME / "(" (expr / type) ")"
xoperand <- NUM / STR / "func" signature block / xcomposite / conversion / NAME / "(" (expr / type) ")"
composite <- littype literal
xcomposite <- !NAME littype literal
littype <- struct / "[" ("..." / expr)? "]" type / "map" "[" type "]" type / typename
conversion <- ("[" (expr / "...")? "]" type / "map" "[" type "]" type / "chan" type / "interface" "{" "}" / "*" type / "func" signature / struct / "<-" "chan" type) &("(" / ")" / "," / "}" / ":")
literal <- "{" (atomic ",")* (element ("," element)*)? ","? "}"
atomic <- (NAME / NUM / STR) &","
element <- item (":" item)?
item <- literal / expr
suffix <- "." NAME / "." "(" ("type" / type) ")" / "[" expr? ":" expr? (":" expr)? "]" / "[" (expr / type) ("," (expr / type))* ","? "]" / "(" (arg ("," arg)*)? ","? ")"
arg <- (expr &("," / ")" / "...") / type) "..."?
ASSIGN <- "=" / ":=" / "+=" / "-=" / "*=" / "/=" / "%=" / "&=" / "|=" / "^=" / "<<=" / ">>=" / "&^="
BINOP <- "||" / "&&" / "==" / "!=" / "<" / "<=" / ">" / ">=" / "+" / "-" / "|" / "^" / "*" / "/" / "%" / "<<" / ">>" / "&" / "&^"
UNARY <- "+" / "-" / "!" / "^" / "*" / "&" / "<-" !"chan" / "~"
'''
_GO_LEX = re.compile(
    r"(?:[ \t\r]+|" + _COMMENT1 + r")*+((?:\n|" + _COMMENTN + r")(?:\s|//[^\n]*|" + _COMMENTN + r")*"
    r"|[^\W\d]\w*|(?:0[xX][0-9a-fA-F_.]*(?:[pP][+-]?\d+)?|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)\w*"
    r"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.[0-9a-fA-F]*)'|`[^`]*`|/\*"
    r"|<<=|>>=|&\^=|\.\.\.|:=|<-|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[^\s]|\Z)"
)
_GO_NUM = re.compile(r"(?:0[xX](?:_?[0-9a-fA-F])*\.?(?:_?[0-9a-fA-F])*(?:[pP][+-]?\d+)?|0[bB](?:_?[01])+|0[oO]?(?:_?[0-7])+|(?:0|[1-9](?:_?\d)*)|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d+)?)i?\Z")
#: Fixed values of the language: after these tokens a line break is a semicolon.
_GO_ENDS = ["break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"]

# -- Java ----------------------------------------------------------------------------------------
_JAVA = r'''
start <- (annotation* "package" qualified ";")? ("import" "static"? qualified ("." "*")? ";" / ";")* (typedecl / ";" / modular / member)* END
modular <- "open"? "module" qualified "{" (word+ qualified (("to" / "with") qualified ("," qualified)*)? ";")* "}"
qualified <- id ("." id)*
annotation <- "@" !"interface" qualified ("(" ((id "=" annvalue ("," id "=" annvalue)*) / annvalue)? ")")?
annvalue <- annotation / "{" (annvalue ("," annvalue)*)? ","? "}" / ternary
modifier <- annotation / "public" / "protected" / "private" / "static" / "abstract" / "final" / "native" / "synchronized" / "transient" / "volatile" / "strictfp" / "default" !(":" / "->") / "sealed" &(MOD / "class" / "interface") / "non" "-" "sealed"
MOD <- "public" / "protected" / "private" / "static" / "abstract" / "final"
typedecl <- modifier* (class / enum / interface / record / "@" "interface" id "{" (member / annmember)* "}")
annmember <- modifier* type id "(" ")" ("[" "]")* ("default" annvalue)? ";"
class <- "class" id typeparams? ("extends" type)? ("implements" types)? ("permits" types)? body
interface <- "interface" id typeparams? ("extends" types)? ("permits" types)? body
record <- "record" id typeparams? "(" (param ("," param)*)? ")" ("implements" types)? body
enum <- "enum" id ("implements" types)? "{" (constant ("," constant)*)? ","? (";" member*)? "}"
constant <- annotation* id arguments? body?
body <- "{" member* "}"
member <- ";" / "static"? block / typedecl / modifier* (typeparams? annotation* (id parameters throws? block / type id parameters ("[" "]")* throws? ("default" annvalue)? (block / ";")) / id &"{" block / type declarators ";")
throws <- "throws" types
parameters <- "(" (param ("," param)*)? ")"
param <- modifier* type annotation* "..."? ((id ".")? "this" / id) ("[" "]")*
declarators <- declarator ("," declarator)*
declarator <- id ("[" "]")* ("=" init)?
init <- arrayinit / expr
arrayinit <- "{" (atomic ",")* (init ("," init)*)? ","? "}"
atomic <- (NAME / NUM / STR) &","
typeparams <- "<" typeparam ("," typeparam)* ">"
typeparam <- annotation* id ("extends" type ("&" type)*)?
types <- type ("," type)*
type <- annotation* (PRIMITIVE / id typeargs? ("." annotation* id typeargs?)*) (annotation* "[" "]")*
typeargs <- "<" (typearg ("," typearg)*)? ">"
typearg <- annotation* "?" (("extends" / "super") type)? / type
block <- "{" blockstmt* "}"
blockstmt <- simple / local / localtype / stmt
localtype <- (MOD / annotation / "strictfp" / "sealed")* (class / record / enum / interface)
local <- (annotation / "final")* type declarators ";"
simple <- ("return" expr? / "throw" expr / "break" id? / "continue" id? / "yield" !("=" / "." / "(" / "++" / "--" / "[") expr / "assert" expr (":" expr)?) ";"
stmt <- block / ";" / "if" "(" expr ")" stmt ("else" stmt)? / "for" "(" forhead ")" stmt / "while" "(" expr ")" stmt / "do" stmt "while" "(" expr ")" ";" / "try" resources? block (catch* "finally" block / catch+ / &resourced) / "switch" "(" expr ")" switchbody / "synchronized" "(" expr ")" block / simple / id ":" stmt / expr ";"
resourced <- ""
resources <- "(" resource (";" resource)* ";"? ")"
resource <- (annotation / "final")* type id "=" expr / expr
catch <- "catch" "(" modifier* type ("|" type)* id ")" block
forhead <- (annotation / "final")* type id ":" expr / ((annotation / "final")* type declarators / exprs)? ";" expr? ";" exprs?
exprs <- expr ("," expr)*
switchbody <- "{" (label ("->" (block / "throw" expr ";" / expr ";") / ":" blockstmt*))* "}"
label <- "default" / "case" (caselabel ("," caselabel)*)
caselabel <- ("default" / pattern &("->" / ":" / "," / "when") / ternary) ("when" expr)?
pattern <- modifier* type ("(" (pattern ("," pattern)*)? ")" id? / id)
expr <- lambda / ternary (ASSIGN expr)?
ternary <- binary ("?" (lambda / ternary) ":" (lambda / ternary))?
binary <- unary ("instanceof" ("final"? pattern / type) / operator unary)*
operator <- BINOP / ">" ">"? ">"? "="? !"="
lambda <- (id / "(" (id ("," id)*)? ")" / parameters) "->" (block / expr)
unary <- PREFIX unary / cast / operand
cast <- "(" PRIMITIVE ("[" "]")* ")" unary / "(" type ("&" type)* ")" (lambda / !(PREFIXNUM) unary)
PREFIXNUM <- "+" / "-" / "++" / "--"
PREFIX <- "+" / "-" / "++" / "--" / "!" / "~"
operand <- primary suffix* ("++" / "--")?
suffix <- "." "new" annotation* id typeargs? arguments body? / "." typeargs? (id arguments? / "this" / "super" arguments? / "class") / "[" expr "]" / "::" typeargs? (id / "new")
primary <- "switch" "(" expr ")" switchbody / NUM / STR / "true" / "false" / "null" / "this" arguments? / "super" (arguments / &("." / "::")) / "new" annotation* creator / "(" expr ")" / methodref / "void" "." "class" / PRIMITIVE ("[" "]")* "." "class" / id arguments? 
methodref <- type "::" typeargs? (id / "new") / id ("[" "]")+ "." "class"
creator <- typeargs? (PRIMITIVE / id typeargs? ("." id typeargs?)*) (arguments body? / ("[" expr "]")+ ("[" "]")* / ("[" "]")+ arrayinit)
arguments <- "(" (atomic ",")* (expr ("," expr)*)? ")"
id <- NAME / "record" / "sealed" / "permits" / "yield" / "open" / "module" / "when" / "to" / "with" / "non"
word <- id
PRIMITIVE <- "boolean" / "byte" / "char" / "short" / "int" / "long" / "float" / "double" / "void"
ASSIGN <- "=" / "+=" / "-=" / "*=" / "/=" / "%=" / "&=" / "|=" / "^=" / "<<=" / ">" ">" ">"? "="
BINOP <- "||" / "&&" / "|" / "^" / "&" / "==" / "!=" / "<=" / "<<" / "<" / "+" / "-" / "*" / "/" / "%"
'''
_JAVA_LEX = re.compile(
    r"(?:[ \t\f\v\r]+|" + _COMMENT1 + r")*+((?:\n|" + _COMMENTN + r")(?:\s|//[^\n]*|" + _COMMENTN + r")*|[^\W\d][\w$]*|\$[\w$]*|(?:0[xX][0-9a-fA-F_.]*(?:[pP][+-]?\d+)?|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)\w*"
    r"|\"\"\"[ \t\f]*\n(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.)'|/\*"
    r"|<<=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[^\s]|\Z)"
)
_JAVA_NUM = re.compile(r"(?:0[xX](?:_*[0-9a-fA-F])*\.?(?:_*[0-9a-fA-F])*(?:[pP][+-]?\d+)?|0[bB][01](?:_*[01])*|0(?:_*[0-7])*|[1-9](?:_*\d)*|(?:\d(?:_*\d)*\.?(?:\d(?:_*\d)*)?|\.\d(?:_*\d)*)(?:[eE][+-]?\d+)?)[lLfFdD]?\Z")
#: Reserved in Java though no rule uses them.
_JAVA_RESERVED = ["const", "goto", "_"]


#: Any kind but those that bound a segment.
_OTHER = '[^";""{""}"]'


class Language:
    """tokens(text) lists tokens; encode(tokens) gives kinds and line-break marks; both cover all of the text."""

    def __init__(self, name: str, lexer: re.Pattern, grammar: Grammar, number: re.Pattern | None):
        self.name, self.lexer, self.grammar, self.number = name, lexer, grammar, number
        known = dict(grammar.kinds) | {"": ""}
        self.kinds = Kinds(known, self.classify)
        self.words = {t for t in known if t and (t[0].isalpha() or t[0] == "_")}

    def classify(self, t: str) -> str:
        c = t[0]
        if c == "\n" or t.startswith("/*") and len(t) > 2 or c == "#" and "\n" in t:
            return "L"
        if c.isalpha() or c in "_$" or not c.isascii() and t.isidentifier():
            return "n" if not t[0] == "_" or t not in self.words else self.grammar.kinds[t]
        if c.isdigit() or c == "." and len(t) > 1 and t[1].isdigit():
            return "0" if self.number.match(t) else BAD
        if c in "\"'`" and len(t) > 1:
            return "s"
        return BAD

    def raw(self, tokens: list[str]) -> str:
        return "".join(map(self.kinds.__getitem__, tokens))

    def encode(self, tokens: list[str], raw: str | None = None) -> tuple[str, str]:
        """The parser's kinds and line-break marks of tokens; raw: their kinds as they come, if known."""
        return (self.raw(tokens) if raw is None else raw).replace("L", ""), ""

    def source(self, text: str) -> str:
        """The text as it is lexed."""
        return text

    def tokens(self, text: str) -> list[str]:
        return self.lexer.findall(self.source(text))

    def check(self, text: str) -> bool:
        """Whether the text is grammatical."""
        kinds, breaks = self.encode(self.tokens(clean(text)))
        return self.grammar.accepts(kinds, breaks)

    def failure(self, text: str) -> tuple[int, str]:
        """The line of the furthest failure and its cause, of a text that isn't grammatical."""
        text = clean(text)
        tokens = self.tokens(text)
        kinds, breaks = self.encode(tokens)
        bad = kinds.find(BAD)
        far = self.grammar.furthest(kinds, breaks)
        at = bad if 0 <= bad <= far else far
        # the first token whose kinds reach past the failure; encoding a prefix is monotone in its length
        low, high = 0, len(tokens)
        while low < high:
            mid = (low + high) // 2
            if len(self.encode(tokens[: mid + 1])[0].rstrip("ND")) > at:
                high = mid
            else:
                low = mid + 1
        starts = [m.start(1) for m in self.lexer.finditer(self.source(text))]
        start = starts[low] if low < len(starts) else len(text.rstrip())
        line = max(1, 1 + self.source(text).count("\n", 0, start) - (len(self.source(text)) - len(text)))
        around = text.split("\n")[max(0, line - 2) : line + 1]
        if any(re.match(r"\s*(<{7}|={7}|>{7}|\|{7})(\s|$)", x) for x in around):
            return line, "merge_conflict"
        if at >= len(kinds.rstrip("ND")):
            return line, "truncated"
        return line, "token" if at == bad else "syntax"


class Python(Language):
    def classify(self, t: str) -> str:
        c = t[0]
        if c in "\n#":
            return "L" if "\n" in t else ""
        q = t[-1]
        if q in "'\"" and len(t) > 1:
            head = t[: min(t.find(x) for x in "'\"" if x in t)].lower()
            if "f" in head and not self._fields(t[len(head):]):
                return BAD
            if "b" in head and not t.isascii():
                return BAD
            return "s"
        if c.isalpha() or c == "_" or not c.isascii() and t.isidentifier():
            return "n"
        if c.isdigit() or c == "." and len(t) > 1 and t[1].isdigit():
            m = self.number.match(t)
            if not m:
                return BAD
            rest = t[m.end():]
            return "0" if not rest else "0" + "".join(self.kinds[x] for x in [rest]) if _PY_NUM_THEN.fullmatch(rest) else BAD
        return BAD

    def _fields(self, body: str) -> bool:
        """Whether the replacement fields of an f-string are grammatical."""
        quote = 3 if body[:3] in ("'''", '"""') else 1
        body, at = body[quote:-quote], 0
        while m := _FIELD.search(body, at):
            at = m.end()
            if len(m[0]) == 2:
                continue
            depth, i, expr, quoted = 0, at, None, ""
            while i < len(body):
                c = body[i]
                if quoted:
                    quoted = "" if c == quoted else quoted
                elif c in "'\"":
                    quoted = c
                elif c in "([{":
                    depth += 1
                elif depth and c in ")]}":
                    depth -= 1
                elif not depth and (c in "}:" or c == "!" and body[i + 1 : i + 2] != "="):
                    expr = body[at:i]
                    break
                i += 1
            if expr is None:
                return False
            inner = re.sub(r"=\s*$", "", expr)
            kinds = "".join(map(self.kinds.__getitem__, self.lexer.findall(inner))).replace("L", "")
            if not kinds or not self.grammar.accepts(kinds, "", "field"):
                return False
            if body[i] == "!":
                if not re.match(r"![rsa]\s*[:}]", body[i:]):
                    return False
                i = i + 2
                while body[i] not in ":}":
                    i += 1
            if body[i] == ":":
                depth, start = 0, i
                while i < len(body) and (depth or body[i] != "}"):
                    depth += (body[i] == "{") - (body[i] == "}")
                    i += 1
                if "{" in body[start:i] and not self._fields('"' + body[start:i] + '"'):
                    return False
            at = i + 1
        return True

    def source(self, text: str) -> str:
        return "\n" + text  # so that the first line's indentation is seen

    def encode(self, tokens: list[str], raw: str | None = None) -> tuple[str, str]:
        raw = self.raw(tokens) if raw is None else raw
        lines = [t for t in tokens if t and t[0] in "\n#" and "\n" in t]
        out, stack, depth, indent = [], [0], 0, 0
        brackets, opens, nets = self.brackets, self.opens, self.nets
        for j, part in enumerate(raw.split("L")):
            if part:
                if not depth and indent != stack[-1]:
                    if indent > stack[-1]:
                        stack.append(indent)
                        out.append("I")
                    else:
                        while indent < stack[-1]:
                            stack.pop()
                            out.append("D")
                        if indent != stack[-1]:
                            out.append(BAD)
                            stack.append(indent)
                out.append(part)
                net = nets.get(part)
                if net is None:  # (change of depth, lowest depth on the way)
                    change = lowest = 0
                    for c in brackets(part):
                        change += 1 if c in opens else -1
                        lowest = min(lowest, change)
                    if len(nets) > 50_000:
                        nets.clear()
                    net = nets[part] = (change, lowest)
                if depth + net[1] < 0:
                    return "".join(out) + BAD, ""
                depth += net[0]
                if not depth:
                    out.append("N")
            if j < len(lines):
                tail = lines[j].rpartition("\n")[2]
                indent = len(tail) if tail.isspace() and "\t" not in tail and "\f" not in tail else 0
                if tail and not indent:
                    for c in tail:
                        indent = indent + 1 if c == " " else (indent // 8 + 1) * 8 if c == "\t" else 0
        return "".join(out) + "D" * (len(stack) - 1), ""


class Script(Language):
    def classify(self, t: str) -> str:
        c = t[0]
        if c == "/" and len(t) > 2 and t[1] not in "*/" or len(t) > 3 and t[-1] not in "'\"`" and "/" in t[1:] and _WITH_REGEX.match(t):
            m = _WITH_REGEX.match(t)
            return "r" if c == "/" else self.kinds[m[1]] + "r"
        if c == "`" and len(t) > 1:
            return "s" if "${" not in t or self._holes(t) else BAD
        if c == "#" and len(t) > 1 and "\n" not in t:
            return "p"
        if c == "\n" or t.startswith("/*") and len(t) > 2:
            return "L"
        return super().classify(t)

    def _holes(self, t: str) -> bool:
        for m in re.finditer(r"\\[\s\S]|(" + _HOLE + ")", t[1:-1]):
            if m[1]:
                kinds, breaks = self.encode(self.lexer.findall(m[1][2:-1]))
                if not self.grammar.accepts(kinds, breaks, "hole"):
                    return False
        return True

    def encode(self, tokens: list[str], raw: str | None = None) -> tuple[str, str]:
        raw = self.raw(tokens) if raw is None else raw
        if "L" not in raw:
            return raw, "0" * len(raw)
        parts = raw.split("L")
        marks = ["0" * len(parts[0])] + ["1" + "0" * (len(p) - 1) for p in parts[1:] if p]
        return "".join(parts), "".join(marks)


class Go(Language):
    def encode(self, tokens: list[str], raw: str | None = None) -> tuple[str, str]:
        raw = (self.raw(tokens) if raw is None else raw) + "L"
        return self.breaks.sub(self.grammar.kinds[";"], raw).replace("L", ""), ""


def clean(text: str) -> str:
    """Without one leading byte order mark and with plain line ends."""
    if text.startswith("\ufeff"):
        text = text[1:]
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text


def _no_empty(text: str) -> str:
    return text.replace('<- ""', '<- &ANY / &END')


def _python() -> Python:
    g = Grammar(_PYTHON + "field <- value END\n", _CLASSES, memo={"expr", "bitor", "star"}, by_content={"line": r"[^NID:]*N", "defhead": r"[^NID]*\":\"(?=N)"})
    lang = Python("python", _PY_LEX, g, _PY_NUM)
    lang.brackets = re.compile("[" + "".join(g.kinds[x] for x in "([{)]}") + "]").findall
    lang.opens = "".join(g.kinds[x] for x in "([{")
    lang.nets = {}
    return lang


def _script(name: str, extra: str) -> Script:
    g = Grammar(_no_empty(_SCRIPT + extra + "hole <- expr END\n"), _CLASSES, memo={"assign", "operand", "arrow", "type", "params", "TA"}, by_content={"stmt": r'(?!"if"|"for"|"while"|"do"|"try"|"switch"|"with"|n":")[^;{}]*(?:"{"[^;{}]*"}"[^;{}]*)*";"'.replace("[^;{}]", _OTHER)})
    return Script(name, _SCRIPT_LEX, g, _SCRIPT_NUMBER)


def _go() -> Go:
    g = Grammar(_GO, _CLASSES, memo={"expr", "xexpr", "type", "literal"}, by_content={"ended": r'(?!"if"|"for"|"switch"|"select"|n":")[^;{}]*(?:"{"[^;{}]*"}"[^;{}]*)*";"'.replace("[^;{}]", _OTHER)})
    for word in _GO_ENDS:
        g.kind(word)
    lang = Go("go", _GO_LEX, g, _GO_NUM)
    lang.breaks = re.compile("(?<=[n0s" + "".join(g.kinds[x] for x in _GO_ENDS) + "])L+")
    return lang


def _java() -> Language:
    g = Grammar(_no_empty(_JAVA), _CLASSES, memo={"expr", "ternary", "type", "unary", "lambda"}, by_content={"blockstmt": r'(?!"if"|"for"|"while"|"do"|"try"|"switch"|"synchronized"|n":")[^;{}]*(?:"{"[^;{}]*"}"[^;{}]*)*";"'.replace("[^;{}]", _OTHER)})
    for word in _JAVA_RESERVED:
        g.kind(word)
    return Language("java", _JAVA_LEX, g, _JAVA_NUM)


_MADE: dict[str, Language] = {}
#: The language of a file is that of its extension.
EXTENSIONS = {"py": "python", "pyi": "python", "ts": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go", "java": "java"}


def language(name: str) -> Language:
    """The lexer and grammar of a language, made once per process."""
    if name not in _MADE:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 60_000))
        _MADE[name] = {"python": _python, "javascript": lambda: _script("javascript", _JS), "typescript": lambda: _script("typescript", _TS), "go": _go, "java": _java}[name]()
    return _MADE[name]
