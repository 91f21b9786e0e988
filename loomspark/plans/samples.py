"""A few small files of every supported kind, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = {
    "src/shapes.rs": """/// A flat figure.
///
/// # Notes
#[derive(Clone)]
pub struct Figure<'a> { label: &'a str }

impl<'a> Figure<'a> {
    /// Makes one.
    pub fn named(label: &'a str) -> Self { Figure { label } }
    fn area(&self) -> f64 { let s = "fn no() {"; 0.0 }
}

pub trait Draw { fn draw(&self); }
const LIMIT: usize = 8;
enum Side { Left, Right }
fn main() { let f = Figure::named("x"); f.area(); }
""",
    "src/app.ts": """/** Greets.
 * @param who a name
 */
export function greet(who: string): string { return `hi ${who}`; }
export const Button = (props: Props) => { return greet("x"); };
class Store extends Base { items = 1; async load<T>(key: T): Promise<void> { greet("y"); } }
interface Props { a: string }
type Id = string | number;
enum Mode { On, Off }
""",
    "src/old.js": "class Old { run() { return helper(); } }\nfunction helper() { return 1; }\nfunction* gen() {}\n",
    "src/Shop.cs": """namespace Shop {
/// <summary>A <b>basket</b> of goods.</summary>
public class Basket {
    public int Count { get; set; }
    public Basket() { }
    internal int Add(int n) { Count += n; return Count; }
}
public struct Price { public decimal Value { get; } }
}
""",
    "tools/stats.py": '''"""Module."""
class Mean:
    """Keeps a mean.

    Long text."""
    def add(self, x):
        return helper(x)

async def helper(x):
    r"""raw"""
    return x

def _hidden(): pass
''',
    "docs/guide.md": "intro\n# One\ntext\n```\n# no\n```\n## Two\nmore\n#tag\n",
    "docs/data.json": '{"b": {"y": 1, "x": [1, "é"]}, "a": null}',
    "docs/list.json": "[1, 2, 3]",
    "docs/set.yaml": "# first\nname: x\nlist:\n  - a\n---\nlast: 1\n",
    "docs/set.toml": 'top = 1\n[tool]\nx = 2\n[[bin]]\nname = "a"\n',
    "docs/long.txt": "".join(f"line {i} of a long text\n" for i in range(60)),
    "docs/empty.txt": "",
}


def frame(spark: SparkSession) -> DataFrame:
    """path, text."""
    return spark.createDataFrame(sorted(FILES.items()), "path string, text string")
