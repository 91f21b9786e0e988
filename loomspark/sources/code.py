"""Code parsers: definitions of Rust, TypeScript, JavaScript, C# and Python files.

Python is parsed by the standard library. The brace languages are scanned on a mask of the text, in
which the insides of comments and strings are blanks: definitions are found by pattern, their
ends by brackets that are matched once (`Marks`), their context by the spans that enclose them. Nothing searches the
text before or after a match but for the blanks beside it, so a file takes time in proportion to its length. Files are
independent, so the operator is one `mapInPandas` without a shuffle.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schemas import RAW

SIGNATURE_LINES = 5
_CLOSE = {"(": ")", "[": "]", "{": "}"}


@dataclass
class Found:
    name: str
    kind: str
    start: int
    end: int
    outer: int | None = None  # start of a wrapping export, if any
    context: str | None = None
    doc: str | None = None
    public: bool = False


# --- masks ---

_STRINGS = {
    "rs": r'//[^\n]*|/\*|b?r(#*)"|b?"(?:[^"\\]|\\[\s\S])*"|b?\'(?:[^\'\\\n]|\\(?:u\{[^}]*\}|x..|.))\'',
    "js": r'//[^\n]*|/\*|"(?:[^"\\\n]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\[\s\S])*\'|`|(?:(?<=[=(,:;!&|?{}\[\n])|(?<==>)|(?<=\breturn)|(?<=\bcase)|(?<=\btypeof))[ \t]*+/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/',
    "cs": r'//[^\n]*|/\*|"""+|\$?@\$?"(?:[^"]|"")*"|\$?"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.[^\']*)\'|^[ \t]*#[^\n]*',
}


#: Blanks in a row that are worth going around.
FAR = 64


def mask(text: str, family: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with blanks for what is inside comments and strings, of which lengths and line feeds stay; and the stretches between long ones of these."""
    out, at, token = [], 0, re.compile(_STRINGS[family], re.M)
    inks, first = [], 0
    while m := token.search(text, at):
        a, t = m.start(), m.group()
        kept = 0  # quotes that stay on either side
        if t == "/*":
            end = _comment_end(text, a, nested=family == "rs")
        elif t == "`":
            end, kept = _template_end(text, a), 1
        elif family == "rs" and t.endswith('"') and t.lstrip("b").startswith("r"):
            close = text.find('"' + (m[1] or ""), m.end())
            end = len(text) if close < 0 else close + 1 + len(m[1] or "")
        elif family == "cs" and t.startswith('"""'):
            close = text.find(t, m.end())
            end = len(text) if close < 0 else close + len(t)
        else:
            end, kept = m.end(), 0 if t.lstrip().startswith(("//", "/", "#")) else 1
        end = min(max(end, a + 1), len(text))
        closed = kept and end - a > 1 and (t != "`" or text[end - 1] == "`")
        inside = "\n".join([" " * len(x) for x in text[a + kept : end - 1 if closed else end].split("\n")])
        out += [text[at:a], text[a : a + kept], inside, text[end - 1 : end] if closed else ""]
        if len(inside) >= FAR:
            inks.append((first, a + kept))
            first = a + kept + len(inside)
        at = end
    return "".join([*out, text[at:]]), [*inks, (first, len(text))]


_COMMENT = re.compile(r"/\*|\*/")
_TEMPLATE = re.compile(r"\\[\s\S]|\$\{|[{}`]")


def _comment_end(text: str, a: int, nested: bool) -> int:
    depth, i = 1, a + 2
    while depth and (m := _COMMENT.search(text, i)):
        depth, i = depth + (-1 if m[0] == "*/" else int(nested)), m.end()
    return len(text) if depth else i


def _template_end(text: str, a: int) -> int:
    """After a template literal; what is in its `${}` belongs to it, as definitions do not stand there."""
    depth = 0
    for m in _TEMPLATE.finditer(text, a + 1):
        if m[0] == "${":
            depth += 1
        elif depth and m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
        elif m[0] == "`" and not depth:
            return m.end()
    return len(text)


_MARK = re.compile(r"[()\[\]{};]")


class Marks:
    """The brackets and semicolons of a masked text: where each bracket closes, and which stop comes next."""

    def __init__(self, masked: str, inks: list[tuple[int, int]]):
        self.masked, self.inks = masked, inks
        found = [(m.start(), m[0]) for a, b in inks for m in _MARK.finditer(masked, a, b)]
        self.at, self.mark = [p for p, _ in found], [c for _, c in found]
        self.close = [len(found)] * len(found)  # of a bracket, the number of the mark that closes it
        open_: list[int] = []
        for k, c in enumerate(self.mark):
            if c in _CLOSE:
                open_.append(k)
            elif open_ and c == _CLOSE[self.mark[open_[-1]]]:
                self.close[open_.pop()] = k
        self._stops: dict[str, list[int]] = {}
        self._before: list[int] = []
        self._found: dict[str, tuple[int, int]] = {}

    def _number(self, at: int) -> int:
        return bisect.bisect_left(self.at, at)

    def _after(self, k: int) -> int:
        return self.at[self.close[k]] + 1 if self.close[k] < len(self.at) else len(self.masked)

    def closing(self, at: int) -> int:
        """After the bracket that closes the one at `at`."""
        return self._after(self._number(at))

    def body(self, at: int, stops: str = "{;") -> tuple[int, str]:
        """(end, stop): from `at` over balanced brackets to the first stop; a block's end is after its bracket."""
        if stops not in self._stops:
            n = len(self.at)
            to = [n] * (n + 1)
            for k in range(n - 1, -1, -1):
                c = self.mark[k]
                to[k] = k if c in stops else to[min(n, self.close[k] + 1)] if c in _CLOSE else to[k + 1]
            self._stops[stops] = to
        k = self._stops[stops][self._number(at)]
        if k == len(self.at):
            return len(self.masked), ""
        return (self._after(k) if self.mark[k] == "{" else self.at[k] + 1), self.mark[k]

    def back(self, at: int) -> int:
        """After the last brace or semicolon before `at`, or 0."""
        if not self._before:
            last = -1
            for k, c in enumerate(self.mark):
                self._before.append(last)
                last = k if c in "{};" else last
            self._before.append(last)
        k = self._before[self._number(at)]
        return self.at[k] + 1 if k >= 0 else 0

    def search(self, pattern: re.Pattern, at: int) -> int:
        """Where the pattern, of one character, is found next, or the length; asked from left to right, no stretch is searched twice."""
        first, found = self._found.get(pattern.pattern, (0, -1))
        if not first <= at <= found:
            m = pattern.search(self.masked, at)
            first, found = at, m.start() if m else len(self.masked)
            self._found[pattern.pattern] = first, found
        return found


def ink_end(text: str, at: int) -> int:
    """After the last character before `at` that is no blank."""
    step = 32
    while at > 0:
        part = text[max(0, at - step) : at]
        kept = part.rstrip()
        if kept:
            return at - len(part) + len(kept)
        at, step = at - len(part), step * 2
    return 0


_BLANKS = re.compile(r"\s*+")


def ink_start(text: str, at: int) -> int:
    """The first character from `at` on that is no blank."""
    return _BLANKS.match(text, at).end()


def ends_with(text: str, at: int, *words: str) -> int | None:
    """Where a whole word starts that ends at `at`, if it is one of these."""
    for w in words:
        a = at - len(w)
        if a >= 0 and text.startswith(w, a) and not (a and (text[a - 1].isalnum() or text[a - 1] == "_")):
            return a
    return None


def starting(start: re.Pattern, pattern: re.Pattern, masked: str, inks: list[tuple[int, int]] | None = None) -> Iterator[re.Match]:
    """What `pattern.finditer` gives, tried only where one of the words starts that it can start with: `start`, found by their first letters. It never starts inside of one.

    Words are looked for in stretches only, if given: none goes over the blanks between them.
    """
    at = 0
    for a, b in inks or [(0, len(masked))]:
        at = max(at, a)
        while s := start.search(masked, at, b):
            m = pattern.match(masked, s.start())
            if m:
                yield m
            at = (m or s).end()


# --- languages ---

_RS_FN = re.compile(r"(?<![\w.])(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(\w+)")
_RS_TYPE = re.compile(r"(?<![\w.])(?:pub(?:\s*\([^)]*\))?\s+)?(?:unsafe\s+)?(struct|enum|trait)\s+(\w+)")
_RS_CONST = re.compile(r"(?<![\w.])(?:pub(?:\s*\([^)]*\))?\s+)?const\s+(\w+)\s*:")
_RS_IMPL = re.compile(r"(?<![\w.>&(:,<])(?:unsafe\s+)?impl\b(?=\s*<|\s+[\w:!&(\[])")
_RS_FN_START, _RS_TYPE_START = re.compile("fn|pub|default|const|async|unsafe|extern"), re.compile("struct|enum|trait|pub|unsafe")
_RS_CONST_START, _RS_IMPL_START = re.compile("const|pub"), re.compile("impl|unsafe")


def rust(text: str, masked: str, inks: list[tuple[int, int]]) -> list[Found]:
    found, marks = [], Marks(masked, inks)
    for m in starting(_RS_FN_START, _RS_FN, masked, marks.inks):
        end, stop = marks.body(m.end())
        found.append(Found(m[1], "function" if stop == "{" else "method", m.start(), end))
    for m in starting(_RS_TYPE_START, _RS_TYPE, masked, marks.inks):
        end, _ = marks.body(m.end())
        found.append(Found(m[2], {"struct": "struct", "enum": "enum", "trait": "interface"}[m[1]], m.start(), end))
    for m in starting(_RS_CONST_START, _RS_CONST, masked, marks.inks):
        end, _ = marks.body(m.end(), ";")
        found.append(Found(m[1], "constant", m.start(), end))
    for m in starting(_RS_IMPL_START, _RS_IMPL, masked, marks.inks):
        before = ink_end(masked, m.start())
        if masked[before - 1 : before] in tuple("=:,(+") or masked.startswith("->", max(0, before - 2)) and before > 1:
            continue
        end, stop = marks.body(m.end())
        if stop == "{" and (name := _impl_type(masked[m.end() : masked.find("{", m.end())])):
            found.append(Found(name, "impl", m.start(), end))
    return found


def _impl_type(head: str) -> str | None:
    """The name of the type that an impl is for, from what stands between `impl` and the bracket."""
    if head.lstrip().startswith("<"):
        head = head.lstrip()[_angle(head.lstrip()) :]
    flat, depth = [], 0
    for i, c in enumerate(head):
        depth += (c == "<") - (c == ">" and head[i - 1] != "-")
        flat.append(c if depth == 0 and c != ">" else " " if depth else "")
    words = re.split(r"\bwhere\b", "".join(flat))[0]
    m = re.fullmatch(r"\s*(?:\w+\s*::\s*)*(\w+)\s*", re.split(r"\bfor\b", words)[-1])
    return m[1] if m else None


def _angle(s: str) -> int:
    depth = 0
    for i, c in enumerate(s):
        depth += (c == "<") - (c == ">" and s[i - 1] != "-")
        if depth == 0:
            return i + 1
    return len(s)


_JS_NO_METHOD = {"if", "for", "while", "switch", "catch", "function", "return", "with", "constructor_", "await", "typeof", "super", "new", "do", "else"}
_JS_FUNCTION = re.compile(r"(?<![\w.$])(?:async\s+)?function\s+([\w$]+)")
_JS_CLASS = re.compile(r"(?<![\w.$])class\s+([\w$]+)")
_JS_METHOD = re.compile(r"(?<![\w$])(?:(?:public|private|protected|static|async|override|readonly|declare|get|set)\s+|\*\s*)*([\w$]++)\s*+(?:<[^<>(){};]*+>\s*+)?\(")
_TS_TYPE = re.compile(r"(?<![\w.$])(interface|type|(?:const\s+)?enum)\s+([\w$]+)")
_TS_LET = re.compile(r"(?<![\w.$])(?:const|let)\s+(?!enum\b)")
_JS_FUNCTION_START, _JS_CLASS_START, _JS_METHOD_START = re.compile("function|async"), re.compile("class"), re.compile(r"[\w$]++|\*")
_TS_ALIAS, _TS_ALIAS_START = re.compile(r"\btype\s+([\w$]+)"), re.compile("type")
_TS_TYPE_START, _TS_LET_START = re.compile("interface|type|const|enum"), re.compile("const|let")


_ALIAS = re.compile(r"\s*+(?:<[^=]*>)?\s*=")
_OF = re.compile(r"[^;=]*?\b(?:of|in)\b")
_METHOD_BODY = re.compile(r"\s*+(?::\s*[^={};]+?(?:\{[^{}]*\}[^={};]*?)?)?\s*\{")


def _statement(masked: str, at: int) -> bool:
    """Whether a statement can start there, and so a declaration and no expression."""
    first = end = ink_end(masked, at)
    for words in (("export", "default", "declare"), ("export", "default")):
        start = ends_with(masked, end, *words)
        end = ink_end(masked, start) if start is not None else end
    if not end or masked[end - 1] in "{};)*/":
        return True
    return "\n" in masked[first:at] and masked[end - 1] not in "=(,:?+-&|[<>!" or masked.endswith("else", 0, end)


def _exported(masked: str, at: int, *words: str) -> int | None:
    """Where the `export` starts that stands before `at`, over these words."""
    for w in (*words, "export"):
        end = ink_end(masked, at)
        start = ends_with(masked, end, w) if end < at else None
        if start is not None:
            at = start
        elif w == "export":
            return None
    return at


def javascript(text: str, masked: str, inks: list[tuple[int, int]], typed: bool = False) -> list[Found]:
    found, marks = [], Marks(masked, inks)
    for m in starting(_JS_FUNCTION_START, _JS_FUNCTION, masked, marks.inks):
        end, stop = marks.body(m.end())
        if stop == "{" and _statement(masked, m.start()):
            found.append(Found(m[1], "function", m.start(), end))
    for m in starting(_JS_CLASS_START, _JS_CLASS, masked, marks.inks):
        abstract = ends_with(masked, ink_end(masked, m.start()), "abstract") is not None
        if not abstract and _statement(masked, m.start()):
            found.append(Found(m[1], "class", m.start(), marks.body(m.end(), "{")[0]))
    for m in starting(_JS_METHOD_START, _JS_METHOD, masked, marks.inks):
        before = ink_end(masked, m.start())
        if m[1] in _JS_NO_METHOD or m[1][0].isdigit() or not before or masked[before - 1] not in "{};,":
            continue
        tail = _METHOD_BODY.match(masked, marks.closing(m.end() - 1))
        if tail and not (masked[before - 1] == ";" and "for" in masked[max(0, before - 40) : before].split("(")[0].split()[-1:]):
            found.append(Found(m[1], "method", m.start(), marks.closing(tail.end() - 1)))
    if typed:
        found += _typed(masked, marks)
    for f in found:
        export = _exported(masked, f.start, "declare", "default")
        if export is not None:
            f.outer, f.public = export, True
        f.public |= text.startswith("export ", f.start)
    return found


def _in_loop(masked: str, at: int) -> bool:
    """Whether the head of a for stands before."""
    end = ink_end(masked, at)
    if masked[end - 1 : end] != "(":
        return False
    end = ink_end(masked, end - 1)
    start = ends_with(masked, end, "await")
    return ends_with(masked, end if start is None else ink_end(masked, start), "for") is not None


def _typed(masked: str, marks: Marks) -> list[Found]:
    found = []
    for m in starting(_TS_TYPE_START, _TS_TYPE, masked, marks.inks):
        if not _statement(masked, m.start()):
            continue
        word = m[1].split()[-1]
        if word == "type":
            if _ALIAS.match(masked, m.end()):
                found.append(Found(m[2], "interface", m.start(), _statement_end(masked, m.end(), marks)))
        else:
            found.append(Found(m[2], word, m.start(), marks.body(m.end(), "{")[0]))
    for m in starting(_TS_LET_START, _TS_LET, masked, marks.inks):
        if _in_loop(masked, m.start()) and _OF.match(masked, m.end()):
            continue
        end = _statement_end(masked, m.end(), marks)
        for name, arrow in _declarators(masked, m.end(), end, marks):
            found.append(Found(name, "constant", m.start(), end))
            export = _exported(masked, m.start())
            if export is not None and arrow:
                found.append(Found(name, "function", export, end))
    return found


_DECLARED = re.compile(r"\s*+([\w$]++)\s*(?=[=:!;,\n]|\Z)")
_SEPARATOR = re.compile(r"[,;(\[{]")
_ARROW_HEAD = re.compile(r"\s*(?:async\b\s*)?(?:<[^>]*>\s*)?(\(|[\w$]++\s*=>)")
_ARROW = re.compile(r"(?:\s*:[^=]+)?\s*=>")


def _declarators(masked: str, at: int, end: int, marks: Marks) -> Iterator[tuple[str, bool]]:
    """The names that a statement declares, and whether their values are arrow functions."""
    i, first = at, at
    while i <= end:
        i = min(marks.search(_SEPARATOR, i), end)
        if i < end and masked[i] in _CLOSE:
            i = marks.closing(i)
            continue
        name = _DECLARED.match(masked, first, i)
        if name:
            value = masked.find("=", first, i)
            head = _ARROW_HEAD.match(masked, value + 1, i) if value >= 0 else None
            yield name[1], bool(head and (head[1] != "(" or _ARROW.match(masked, marks.closing(head.end() - 1), i)))
        first = i = i + 1


_STOP = re.compile(r"[;\n()\[\]{}]")
_GOES_ON = (tuple("=,+-*/&|?:<(."), (*".?:&|+-*/=<,", "extends ", "instanceof "))


def _statement_end(masked: str, at: int, marks: Marks) -> int:
    """After the semicolon, or before a line end after which no expression goes on."""
    i = at
    while (i := marks.search(_STOP, i)) < len(masked):
        c = masked[i]
        if c == ";":
            return i + 1
        if c in ")}]":
            return ink_end(masked, i)
        if c in _CLOSE:
            i = marks.closing(i)
            continue
        end, i = ink_end(masked, i), ink_start(masked, i)
        if end > at:
            going = masked[end - 1] in _GOES_ON[0] or masked.startswith("=>", end - 2) or masked.startswith(_GOES_ON[1], i)
            if not going:
                return end
    return ink_end(masked, len(masked))


_CS_MODIFIER = r"(?:public|private|protected|internal|static|virtual|override|abstract|sealed|async|extern|unsafe|new|partial|readonly|required|ref)"
_CS_HEAD = rf"(?<![\w.])(?:\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\]\s*)*(?:{_CS_MODIFIER}\s+)*"
_CS_TYPE = re.compile(_CS_HEAD + r"(?<![\w.])(class|struct|interface|enum)\s+(\w+)")
_CS_MEMBER = re.compile(_CS_HEAD + r"([A-Za-z_][\w.]*(?:\s*<[^;{}()=]*>)?(?:\s*\[[,\s]*\])*\??|\([^()]*\))\s+(?:[\w.<>]+\.)?(\w+)\s*(<[^;{}()=]*>)?\s*(\(|\{|=>)")
_CS_NO_TYPE = {"return", "new", "else", "throw", "await", "using", "namespace", "class", "struct", "interface", "enum", "record", "case", "goto", "in", "is", "as", "where", "get", "set", "delegate", "event", "operator", "out", "ref", "yield", "lock", "do", "try", *"public private protected internal static virtual override abstract sealed async extern unsafe partial readonly required".split()}


_CS_WHERE = re.compile(r"\bwhere\s+\w+\s*:")
_CS_VALUE = re.compile(r"\s*+=[^=>]")
_CS_NEXT = re.compile(r"[({};]")
_CS_TYPE_START = re.compile(r"\[|class|struct|interface|enum|" + _CS_MODIFIER[3:-1])
_CS_WHERE_START = re.compile("where")


def csharp(text: str, masked: str, inks: list[tuple[int, int]]) -> list[Found]:
    types, marks = [], Marks(masked, inks)
    where = [w.start() for w in starting(_CS_WHERE_START, _CS_WHERE, masked, marks.inks)]
    for m in starting(_CS_TYPE_START, _CS_TYPE, masked, marks.inks):
        k = bisect.bisect_left(where, m.start(1))
        if ends_with(masked, ink_end(masked, m.start(1)), "record") is not None or k and where[k - 1] >= marks.back(m.start(1)):
            continue  # a record, or a constraint
        types.append(Found(m[2], m[1], m.start(), marks.body(m.end(), "{")[0]))
    found = list(types)
    for t in types:
        if t.kind == "enum":
            continue
        # members stand directly in the body of a type, where a block or a statement ended before
        at, last = masked.find("{", t.start) + 1, t.end - 1
        while at < last:
            m = _CS_MEMBER.match(masked, ink_start(masked, at))
            if m and m.start() < last and m[1] not in _CS_NO_TYPE:
                if m[4] == "(":
                    at = marks.body(marks.closing(m.end() - 1))[0]
                    found.append(Found(m[2], "method", m.start(), at))
                elif m[4] == "{" and not m[3]:
                    at = marks.closing(m.end() - 1)
                    at = marks.body(at, ";")[0] if _CS_VALUE.match(masked, at) else at
                    found.append(Found(m[2], "field", m.start(), at))
                else:
                    at = marks.body(m.end(), ";")[0]
                    if not m[3]:
                        found.append(Found(m[2], "field", m.start(), at))
                if masked[ink_end(masked, at) - 1] in "{};":
                    continue
            while (n := _CS_NEXT.search(masked, at)) and n.start() < last:  # to the end of what is no member
                at = marks.closing(n.start()) if n[0] in "({" else n.end()
                if n[0] != "(":
                    break
            else:
                break
    for f in found:
        words = re.findall(r"\b(public|internal|private|protected)\b", masked[f.start : masked.find(f.name, f.start)])
        f.public = bool(words) and words[0] in ("public", "internal")
    return found


def _visible(name: str) -> bool:
    return name.startswith("__") and name.endswith("__") or not name.startswith("_")


def python(text: str) -> list[Found]:
    """Definitions by the language's own grammar; of a file that it does not take, those that its lines show."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_by_lines(text)
    lines = re.split(r"(?<=\n)|(?<=\r)(?!\n)", text)  # as the grammar counts them: form feeds and others end none
    before = [0]
    for x in lines:
        before.append(before[-1] + len(x))
    place = lambda line, col: before[line - 1] + len(lines[line - 1].encode()[:col].decode())
    found = []
    stack: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while stack:  # expressions may be nested deeper than calls can be
        node, context = stack.pop()
        for child in ast.iter_child_nodes(node):
            inner = context
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "function"
                f = Found(child.name, kind, place(child.lineno, child.col_offset), place(child.end_lineno, child.end_col_offset), context=context)
                f.public = _visible(child.name)
                f.doc = _docstring(child, text, place)
                found.append(f)
                inner = child.name if kind == "class" else context
            stack.append((child, inner))
    return found


_PYTHON_HIDDEN = re.compile(r"#[^\n]*|(\"\"\"|\'\'\')(?:\\[\s\S]|(?!\1)[\s\S])*(?:\1|\Z)|([\"\'])(?:\\[\s\S]|(?!\2)[^\n\\])*(?:\2|$)", re.M)
_PYTHON_HEAD = re.compile(r"^([ \t\f]*)(async[ \t]+def|def|class)[ \t]+(\w+)[ \t]*[\[(:]", re.M)


def _python_by_lines(text: str) -> list[Found]:
    """Definitions by their first lines and indents; a definition goes on to the next line that is indented no deeper."""
    masked = _PYTHON_HIDDEN.sub(lambda m: re.sub(r"[^\n]", "_" if m[0][0] != "#" else " ", m[0]), text)
    width = lambda x: len(x.replace("\f", "").expandtabs(8))
    found, open_ = [], []  # open_: (indent, name of a class or None)
    for m in _PYTHON_HEAD.finditer(masked):
        indent, start = width(m[1]), m.end(1)
        open_ = [o for o in open_ if o[0] < indent]
        end, at, depth = None, masked.find("\n", start) + 1, 0
        depth = sum((c in "([{") - (c in ")]}") for c in masked[start : at or len(masked)])
        last = at - 1 if at else len(masked)
        while at:
            stop = masked.find("\n", at)
            line = masked[at : stop if stop >= 0 else len(masked)]
            if line.strip():
                if width(line[: len(line) - len(line.lstrip())]) <= indent and (depth <= 0 or _PYTHON_HEAD.match(line)):
                    break
                last = at + len(line.rstrip())
                depth = max(0, depth) + sum((c in "([{") - (c in ")]}") for c in line)
            at = stop + 1
        end = last
        kind = "class" if m[2] == "class" else "function"
        holder = next((name for _, name in reversed(open_) if name), None)
        f = Found(m[3], kind, start, end, context=holder)
        f.public = _visible(m[3])
        body = re.match(r"[^\n]*:[ \t]*\n\s*(\"\"\"|\'\'\'|\"|\')", text[start:end])
        if body and (close := text.find(body[1], start + body.end())) >= 0:
            f.doc = _paragraph(text[start + body.end() : close].strip().split("\n"), lambda x: not x)
        found.append(f)
        open_.append((indent, m[3] if kind == "class" else None))
    return found


def _docstring(node, text: str, place) -> str | None:
    first = next((s for s in node.body if isinstance(s, ast.Expr)), None)
    if first is None or not (isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)):
        return None
    raw = text[place(first.value.lineno, first.value.col_offset) : place(first.value.end_lineno, first.value.end_col_offset)]
    for quote in ('"""', "'''", '"', "'"):
        if raw.startswith(quote) and raw.endswith(quote) and len(raw) >= 2 * len(quote):
            return _paragraph(raw[len(quote) : -len(quote)].strip().split("\n"), lambda x: not x)
    return None  # a prefixed string is no docstring


def _paragraph(lines: list[str], stop) -> str | None:
    out = []
    for x in lines:
        if stop(x.strip()):
            break
        out.append(x.strip())
    return " ".join(out) or None


# --- comments before a definition ---


def _line_docs(text: str, start: int, attribute: str) -> list[str]:
    out, end = [], text.rfind("\n", 0, start)
    while end >= 0:
        first = text.rfind("\n", 0, end) + 1
        line = text[first:end].strip()
        if line.startswith("///"):
            out.append(line.lstrip("/").strip())
        elif not line.startswith(attribute):
            break
        end = first - 1
    return out[::-1]


def _block_doc(text: str, start: int) -> str | None:
    end = ink_end(text, start)
    if not text.endswith("*/", 0, end):
        return None
    comment = text[text.rfind("/*", 0, end) : end]
    if not comment.startswith("/**"):
        return None
    lines = [x.strip().lstrip("*").strip() for x in comment[3:-2].strip().split("\n")]
    return _paragraph([x for x in lines if x], lambda x: x.startswith("@"))


def _xml_doc(lines: list[str]) -> str | None:
    m = re.search(r"<summary>(.*?)</summary>", " ".join(lines), re.S)
    return " ".join(re.sub(r"<[^>]*>", "", m[1]).split()) or None if m else None


# --- all together ---


def _opened(text: str, pair: str) -> int:
    """Brackets of a pair that are open at the end: what is left when closers take openers away, and closers without one count for nothing."""
    sums = list(accumulate((c == pair[0]) - (c == pair[1]) for c in text if c in pair))
    return sums[-1] - min(0, *sums) if sums else 0


def signature(content: str) -> str:
    """Trimmed lines up to the one that opens a body or ends a statement outside of brackets, five at most."""
    lines = [x.strip() for x in content.split("\n", SIGNATURE_LINES)[:SIGNATURE_LINES]]
    ends = (n for n, x in enumerate(lines, 1) if x.endswith(("{", ";")) and not any(_opened("".join(lines[:n]), pair) for pair in ("()", "<>")))
    return " ".join(lines[: next(ends, len(lines))])


def _contexts(found: list[Found], kinds: tuple[str, ...]) -> None:
    """The nearest enclosing container, by spans."""
    open_: list[Found] = []
    for f in sorted(found, key=lambda f: (f.start, -f.end)):
        while open_ and open_[-1].end <= f.start:
            open_.pop()
        holder = next((o for o in reversed(open_) if o.end >= f.end and (o.start, o.end) != (f.start, f.end)), None)
        f.context = holder.name if holder else None
        if f.kind in kinds:
            open_.append(f)


def _places(text: str, found: list[Found]) -> tuple[list[int], dict[int, int]]:
    """Where lines start, and the byte offsets of the definitions' ends."""
    lines = [m.end() for m in re.finditer("\n", text)]
    at, total, bytes_ = 0, 0, {}
    for p in sorted({x for f in found for x in (f.start, f.end)}):
        total += len(text[at:p].encode())
        at = p
        bytes_[p] = total
    return lines, bytes_


def parse(path: str, text: str, kinds: frozenset[str] | None = None) -> list[dict]:
    """The chunks of a file, in order of their places, or those of some kinds; a file of no known (lower-case) extension has none."""
    ext = path.rpartition(".")[2] if "." in path.rpartition("/")[2] else ""
    if ext == "py":
        found = python(text)
    elif ext == "rs":
        found = rust(text, *(masked := mask(text, "rs")))
        _contexts(found, ("struct", "interface", "impl"))
        for f in found:
            f.doc = _paragraph(_line_docs(text, f.start, "#["), lambda x: not x or x.startswith("#"))
            f.public = masked[0].startswith("pub", f.start) and not masked[0][f.start + 3 : f.start + 4].isalnum()
    elif ext in ("ts", "tsx", "js", "jsx"):
        found = javascript(text, *mask(text, "js"), typed=ext.startswith("ts"))
        _contexts(found, ("class", "interface"))
        types = {m[1] for m in starting(_TS_ALIAS_START, _TS_ALIAS, text)}
        for f in found:
            f.doc = _block_doc(text, f.start) or (_block_doc(text, f.outer) if f.outer is not None else None)
            if f.context in types:  # an alias holds no members
                f.context = None
    elif ext == "cs":
        found = csharp(text, *mask(text, "cs"))
        _contexts(found, ("class", "interface"))
        for f in found:
            f.doc = _xml_doc(_line_docs(text, f.start, "["))
    else:
        return []
    found = list(enumerate(sorted(found, key=lambda f: (f.start, -f.end, f.kind != "constant"))))
    for _, f in found:
        f.kind = "method" if f.kind == "function" and f.context else f.kind
    found = [(seq, f) for seq, f in found if kinds is None or f.kind in kinds]
    out, (lines, bytes_) = [], _places(text, [f for _, f in found])
    for seq, f in found:
        content = text[f.start : f.end]
        out.append({
            "chunk_type": "code", "name": f.name, "kind": f.kind, "file": path, "seq": seq,
            "line_start": bisect.bisect_right(lines, f.start) + 1, "line_end": bisect.bisect_right(lines, f.end) + 1, "byte_start": bytes_[f.start], "byte_end": bytes_[f.end],
            "content": content, "context": f.context, "signature": signature(content), "doc_summary": f.doc, "visibility": "public" if f.public else "private",
        })
    return out


def definitions(files: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Chunks of code files (path, text), all or those of some kinds: other contents don't leave Python."""
    kinds = None if kinds is None else frozenset(kinds)

    def run(frames):
        import pandas as pd

        names = [c.split()[0] for c in RAW.split(", ")]
        for pdf in frames:
            yield pd.DataFrame([c for p, t in zip(pdf["path"], pdf["text"]) for c in parse(p, t, kinds)], columns=names)

    return files.select("path", "text").where(F.col("text").isNotNull()).mapInPandas(run, RAW)
