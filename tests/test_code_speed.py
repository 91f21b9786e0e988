"""A file takes time in proportion to its length, whatever it looks like: 1 MiB, the most that a scan lets in."""

import random
import time

import pytest

from loomspark.sources import code, scan

UNITS = {
    "ts": "/** Doc. */\nexport class C# extends B {\n  items = [1, 2];\n  async load#<T>(key: T): Promise<void> { if (key) { greet('y'); } }\n}\nexport const f# = (a: string) => {\n  return a + `x${a}`;\n};\ninterface I# { a: string }\n",
    "js": "class C# { run#() { return helper(1, {a: [2]}); } }\nfunction f#(x) { for (let i = 0; i < 3; i++) { x += i; } return /[{]/.test(x); }\nconst z# = 3\n",
    "cs": '/// <summary>Doc.</summary>\npublic class C# {\n  public int P# { get; set; }\n  internal int Add#(int n) { Count += n; return Count; }\n  private string s# = "x";\n}\n',
    "rs": "/// Doc.\n#[derive(Clone)]\npub struct S# { a: u8 }\nimpl S# {\n  pub fn f#(&self) -> u8 { self.a }\n}\nconst C#: u8 = 1;\n",
}
PER_UNIT = {"ts": 5, "js": 3, "cs": 3, "rs": 4}


def timed(path: str, text: str) -> tuple[list[dict], float]:
    began = time.perf_counter()
    return code.parse(path, text), time.perf_counter() - began


@pytest.mark.parametrize("ext", sorted(UNITS))
def test_files_of_the_largest_size(ext):
    parts, size = [], 0
    while size < scan.MAX_BYTES - 400:
        parts.append(UNITS[ext].replace("#", str(len(parts))))
        size += len(parts[-1])
    found, took = timed(f"a.{ext}", "".join(parts))
    assert len(found) == len(parts) * PER_UNIT[ext] and took < 10
    last = found[-1]
    assert last["line_end"] == "".join(parts)[: last["byte_end"]].count("\n") + 1


SHAPES = {
    "long comments beside words": lambda n: "word /*" + "c" * (n // 4) + "*/ word /*" + "\n" * (n // 4) + "*/ function f() { /*" + " " * (n // 4) + "*/ }\n",
    "brackets that never close": lambda n: "function f() { class A { m() { x(" * (n // 272),
    "closers without openers": lambda n: "}) ] ; " * (n // 8),
    "one line": lambda n: "var a=function(b){return b?c(b):[1,{d:e}]};" * (n // 44),
    "one word": lambda n: "x" * n,
    "words without a stop": lambda n: "class a const b type c " * (n // 184),
    "blank lines": lambda n: "const a = 1 +" + "\n" * (n // 2) + "2\nconst b = 3" + " " * (n // 2),
    "a long chain": lambda n: "const a = b\n" + "  .then(c)\n" * (n // 11),
    "doc lines": lambda n: "/// x\n" * (n // 6) + "pub fn f() {}\n",
    "block comments": lambda n: "/** x */ class a {}\n" * (n // 20),
    "a long signature": lambda n: "fn f(" + "a: u8,\n" * (n // 7) + ") {}",
    "attributes": lambda n: "[A(1)]\n" * (n // 7) + "public class B { [C] int D { get; } }",
    "arrows in brackets": lambda n: "const x = (function(){ " + "y ? (z) : w, " * (n // 13) + "})()\n",
}


@pytest.mark.parametrize("ext", sorted(UNITS))
@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_shapes_that_invite_long_searches(shape, ext):
    """None takes as long as a search per match would; where spans nest without end, so do the contents, and the text is shorter."""
    _, took = timed(f"a.{ext}", SHAPES[shape](scan.MAX_BYTES // 2))
    assert took < 20


def test_matches_are_looked_for_where_their_words_start():
    r = random.Random(5)
    pairs = [(n[: -len("_START")], n) for n in vars(code) if n.endswith("_START")]
    assert len(pairs) == 11
    bits = [*"fn pub const let class struct interface enum trait impl unsafe async function type where static public default extern x x1 a.b $y ( ) { } [ ] < > : ; = * \n . =>".split(" "), " ", " ", "pub(crate)", "new"]
    for _ in range(400):
        text = "".join(r.choice(bits) + r.choice(("", " ")) for _ in range(60))
        for pattern, start in pairs:
            pattern, start = getattr(code, pattern), getattr(code, start)
            assert [m.span() for m in code.starting(start, pattern, text)] == [m.span() for m in pattern.finditer(text)]
