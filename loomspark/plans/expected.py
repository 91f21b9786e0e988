"""What the sample files hold, read off them by hand: rows that the parsers have to give, as SQL."""

from __future__ import annotations

from .samples import FILES

# Name, kind, seq, first and last line, first and last byte, context, signature (None: the content), doc, visibility.
DEFINITIONS = {
    "src/Shop.cs": (
        ("Basket", "class", 0, 3, 7, 66, 206, None, "public class Basket {", "A basket of goods.", "public"),
        ("Count", "field", 1, 4, 4, 92, 122, "Basket", None, None, "public"),
        ("Add", "method", 2, 6, 6, 151, 204, "Basket", None, None, "public"),
        ("Price", "struct", 3, 8, 8, 207, 260, None, None, None, "public"),
        ("Value", "field", 4, 8, 8, 229, 258, None, None, None, "public"),
    ),
    "src/app.ts": (
        ("greet", "function", 0, 4, 4, 44, 103, None, None, "Greets.", "public"),
        ("Button", "function", 1, 5, 5, 104, 167, None, None, None, "public"),
        ("Button", "constant", 2, 5, 5, 111, 167, None, None, None, "public"),
        ("Store", "class", 3, 6, 6, 168, 260, None, None, None, "private"),
        ("load", "method", 4, 6, 6, 206, 258, "Store", None, None, "private"),
        ("Props", "interface", 5, 7, 7, 261, 290, None, None, None, "private"),
        ("Id", "interface", 6, 8, 8, 291, 317, None, None, None, "private"),
        ("Mode", "enum", 7, 9, 9, 318, 339, None, None, None, "private"),
    ),
    "src/old.js": (
        ("Old", "class", 0, 1, 1, 0, 40, None, None, None, "private"),
        ("run", "method", 1, 1, 1, 12, 38, "Old", None, None, "private"),
        ("helper", "function", 2, 2, 2, 41, 72, None, None, None, "private"),
    ),
    "src/shapes.rs": (
        ("Figure", "struct", 0, 5, 5, 52, 92, None, None, "A flat figure.", "public"),
        ("Figure", "impl", 1, 7, 11, 94, 253, None, "impl<'a> Figure<'a> {", None, "private"),
        ("named", "method", 2, 9, 9, 139, 196, "Figure", None, "Makes one.", "public"),
        ("area", "method", 3, 10, 10, 201, 251, "Figure", None, None, "private"),
        ("Draw", "interface", 4, 13, 13, 255, 289, None, None, None, "public"),
        ("draw", "method", 5, 13, 13, 272, 287, "Draw", None, None, "private"),
        ("LIMIT", "constant", 6, 14, 14, 290, 313, None, None, None, "private"),
        ("Side", "enum", 7, 15, 15, 314, 339, None, None, None, "private"),
        ("main", "function", 8, 16, 16, 340, 391, None, None, None, "private"),
    ),
    "tools/stats.py": (
        ("Mean", "class", 0, 2, 7, 14, 112, None, 'class Mean: """Keeps a mean.  Long text.""" def add(self, x):', "Keeps a mean.", "public"),
        ("add", "method", 1, 6, 7, 70, 112, "Mean", "def add(self, x): return helper(x)", None, "public"),
        ("helper", "function", 2, 9, 11, 114, 162, None, 'async def helper(x): r"""raw""" return x', None, "public"),
        ("_hidden", "function", 3, 13, 13, 164, 183, None, None, None, "private"),
    ),
}

# Name, kind, seq, first and last line, first and last byte, content (None: these bytes without the last line feed), context.
SECTIONS = {
    "docs/guide.md": (("guide.md", "document", 0, 1, 9, 0, 47, FILES["docs/guide.md"], None), ("One", "section", 1, 2, 6, 6, 30, None, None), ("Two", "section", 2, 7, 8, 30, 42, None, None), ("tag", "section", 3, 9, 9, 42, 47, None, None)),
    "docs/data.json": (("a", "section", 0, 1, 2, 0, 7, "a:\nnull", "data.json"), ("b", "section", 1, 1, 8, 0, 45, 'b:\n{\n  "x": [\n    1,\n    "é"\n  ],\n  "y": 1\n}', "data.json")),
    "docs/list.json": (("list.json", "document", 0, 1, 1, 0, 9, "[1, 2, 3]", None),),
    "docs/set.yaml": (("name", "section", 0, 1, 2, 0, 16, None, "set.yaml"), ("list", "section", 1, 3, 5, 16, 32, None, "set.yaml"), ("last", "section", 2, 6, 6, 32, 40, None, "set.yaml")),
    "docs/set.toml": (("root", "section", 0, 1, 1, 0, 8, None, "set.toml"), ("tool", "section", 1, 2, 3, 8, 21, None, "set.toml"), ("bin", "section", 2, 4, 5, 21, 40, None, "set.toml")),
    "docs/long.txt": tuple((f"long.txt (part {k + 1})", "paragraph", k, first, last, 400 * k, min(400 * k + 500, 1370), FILES["docs/long.txt"][400 * k : 400 * k + 500], "long.txt") for k, (first, last) in enumerate(((1, 23), (19, 40), (37, 57), (54, 60)))),
    "docs/empty.txt": (("empty.txt", "document", 0, 1, 1, 0, 0, "", None),),
}

# Functions, the files that hold their bodies, what their bodies call, and the first lines of their bodies.
FUNCTIONS = (
    ("Add", "src/Shop.cs", (), None), ("Button", "src/app.ts", ("greet",), None), ("_hidden", "tools/stats.py", (), None), ("add", "tools/stats.py", ("helper",), "def add(self, x):"),
    ("area", "src/shapes.rs", (), None), ("draw", "src/shapes.rs", (), None), ("greet", "src/app.ts", (), None), ("helper", "src/old.js", (), None), ("load", "src/app.ts", ("greet",), None),
    ("main", "src/shapes.rs", ("area", "named"), None), ("named", "src/shapes.rs", (), None), ("run", "src/old.js", ("helper",), None),
)


def _literal(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _values(columns: str, rows) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) t({columns})"


def definitions_sql() -> str:
    rows = [(*r[:2], file, *r[2:7], FILES[file].encode()[r[5] : r[6]].decode(), r[7], r[8] or FILES[file].encode()[r[5] : r[6]].decode(), *r[9:]) for file, found in DEFINITIONS.items() for r in found]
    return "SELECT 'code' AS chunk_type, * FROM " + _values("name, kind, file, seq, line_start, line_end, byte_start, byte_end, content, context, signature, doc_summary, visibility", rows)


def sections_sql() -> str:
    rows = []
    for file, found in SECTIONS.items():
        for name, kind, seq, first, last, a, b, content, context in found:
            rows.append((name, kind, file, seq, first, last, a, b, FILES[file].encode()[a:b].decode().removesuffix("\n") if content is None else content, context))
    return "SELECT 'doc' AS chunk_type, *, NULL AS signature, NULL AS doc_summary, 'private' AS visibility FROM " + _values("name, kind, file, seq, line_start, line_end, byte_start, byte_end, content, context", rows)


def functions_sql() -> str:
    body = {}
    for name, file, _, _ in FUNCTIONS:
        (place,) = {r[5:7] for r in DEFINITIONS[file] if r[0] == name and r[1] in ("function", "method")}
        body[name] = FILES[file].encode()[place[0] : place[1]].decode()
    said = {name: first or body[name] for name, _, _, first in FUNCTIONS}
    rows = [(name, body[name], "|".join(sorted(said[c] for c in calls)), said[name]) for name, _, calls, _ in FUNCTIONS]
    return "SELECT key, sha256(body) AS body_hash, sha256(context) AS context_hash, summary FROM " + _values("key, body, context, summary", rows)
