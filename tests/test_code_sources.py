"""Scanners of Rust, Go, C# and scripts: which declarations become symbols, with what names, kinds, lines and signatures."""

from tidemark.operators import scanners


def rows(language, source):
    return scanners.scan(language, source)


def test_rust_items():
    source = """pub(crate) fn near<F: Fn(u8) -> u8>(f: F, xs: &mut Vec<Option<u8>>) -> Result<Vec<u8>, (u8, [u8; 4])> where F: Copy {
    fn inner() {}
    f(1)
}
pub union Bits { a: u8 }
extern "C" { fn foreign(x: u8); }
macro_rules! make { ($n:ident) => { fn $n() {} } }
make! { fn generated() {} }
impl<T: Into<u8>> Iterator for Chain<'_, T> {
    type Item = u8;
    const SIZE: usize = 1;
    fn next(&mut self) -> Option<&'static str> { None }
    #[tokio::test]
    fn other() {}
    #[test]
    fn own() {}
}
trait Load { fn weigh(&self) -> u8 { 1 } }
#[cfg(test)]
mod checks { pub struct Inner(u8); #[tokio::test] async fn waits() {} }
mod tests;
pub static GATE: &str = "{";
type Long = std::collections::HashMap<String, Vec<u8>>;
"""
    assert rows("Rust", source) == [
        ("near", "Function", 1, 4, "fn near(f : F, xs : & mut Vec < Option < u8 > >) -> Result < Vec < u8 > , (u8 , [u8 ; 4]) >", False, False),
        ("Chain<'_,T>::next", "Method", 12, 12, "fn next(& mut self) -> Option < & 'static str >", False, False), ("Chain<'_,T>::other", "Method", 14, 14, "fn other()", False, False),
        ("Chain<'_,T>::own", "Test", 16, 16, "fn own()", True, False), ("Load", "Trait", 18, 18, "trait Load", False, False), ("checks", "Module", 20, 20, "mod checks", True, False),
        ("Inner", "Struct", 20, 20, "struct Inner", False, True), ("waits", "Test", 20, 20, "fn waits()", True, False), ("tests", "Module", 21, 21, "mod tests", True, False),
        ("GATE", "Static", 22, 22, "static GATE", False, True), ("Long", "TypeAlias", 23, 23, "type Long = std::collections::HashMap<String,Vec<u8>>", False, False),
    ]
    (alias,) = rows("Rust", f"type A = {'Abcde<' * 30}u8{'>' * 30};")
    assert alias[4] == "type A = " + ("Abcde<" * 30)[:120] + "…" and rows("Rust", "fn a() {") is None


def test_go_declarations():
    source = """package barn

const Limit = 3

type (
    Barn[K comparable, V any] struct {
        rows map[K]V
    }
    loader interface { Load() error }
    Alias = Barn[int, int]
    Grid [3]int
)

func (b *Barn[K, V]) Open(x struct{ y int }) (err error) {
    type local struct{ z int }
    return nil
}

func FuzzLoad(f *testing.F) {
}

func external(x int) int
type Handler func(w Writer, r *Request)
"""
    assert rows("Go", source) == [
        ("Barn", "Struct", 6, 8, "type Barn struct", False, True), ("loader", "Interface", 9, 9, "type loader interface", False, False), ("Grid", "TypeAlias", 11, 11, "type Grid type", False, True),
        ("Barn::Open", "Method", 14, 17, "func Open(…)", False, True), ("local", "Struct", 15, 15, "type local struct", False, False), ("FuzzLoad", "Test", 19, 20, "func FuzzLoad(…)", True, True),
        ("external", "Function", 22, 22, "func external(…)", False, False), ("Handler", "TypeAlias", 23, 23, "type Handler type", False, True),
    ]
    assert [r[0] for r in rows("Go", "func a() {\nfunc b() {\n}\n")] == ["a", "b"]  # an open brace costs nothing else


def test_csharp_members():
    source = """namespace Farm {
    public sealed class Silo : Base, IStore {
        public const int Most = 3, Least = 1;
        private readonly Dictionary<string, List<int>> _rows = new() {
            ["a"] = new(),
        };
        public int Level { get; private set; } = 2;
        public bool Full => Level >= Most;
        public Silo(int level) : base(level) { Level = level; }
        [Theory, InlineData("Fact")]
        public async Task<int> Fills<T>(T amount) where T : struct
        {
            int local = 1;
            if (local > 0) { return await Task.FromResult(local); }
            return 0;
        }
        void Plain() => Run();
        enum Kind { A, B }
        struct Row { public int Id; }
    }
    interface IStore { void Put(int x); }
    record Point(int X);
}
"""
    assert rows("CSharp", source) == [
        ("Silo", "Class", 2, 20, "class Silo", False, True), ("Silo::Most", "Const", 3, 3, "field Most", False, True), ("Silo::Least", "Const", 3, 3, "field Least", False, True),
        ("Silo::_rows", "Field", 4, 6, "field _rows", False, False), ("Silo::Level", "Field", 7, 7, "property Level", False, True), ("Silo::Full", "Field", 8, 8, "property Full", False, True),
        ("Silo::new", "Method", 9, 9, "Silo::new(…)", False, True), ("Silo::Fills", "Test", 10, 16, "Fills(…)", True, True), ("Silo::Plain", "Method", 17, 17, "Plain(…)", False, False),
        ("Kind", "Enum", 18, 18, "enum Kind", False, False), ("Row", "Struct", 19, 19, "struct Row", False, False), ("Row::Id", "Field", 19, 19, "field Id", False, True),
        ("IStore", "Interface", 21, 21, "interface IStore", False, False), ("IStore::Put", "Method", 21, 21, "Put(…)", False, False),
    ]


def test_scripts():
    source = """export default async function load(a, b) {
  const inner = () => { return a; };
  function nested_test() {}
  for (const x of a) { go(x); }
  for (let i = 0; i < 3; i++) {}
}
const { rows } = source;
let [p, q] = pair();
export abstract class Silo<T> extends Base {
  static #secret(x: number): string { return "{"; }
  constructor(private level: number) { super(); }
  _hide() { if (x) { call(y); } return { helper() { return 1; } }; }
  get size(): number { return 1; }
  abstract weigh(): void;
}
var run = function named() { return 1; };
const submit = init(() => {});
interface Grain { grow(): void }
export const enum Kind { A }
type _Id<T> = { a: T } | string;
namespace Farm.Deep { export let open = 1; }
const table = { put(x) { return x; }, get: 1 };
function* make() {}
"""
    got = rows("TypeScript", source)
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [
        ("load", "Function", 1, 6), ("inner", "Const", 2, 2), ("nested_test", "Test", 3, 3), ("i", "Const", 5, 5), ("source", "Const", 7, 7), ("[p, q]", "Const", 8, 8), ("Silo", "Class", 9, 15),
        ("Silo::#secret", "Method", 10, 10), ("Silo::constructor", "Method", 11, 11), ("Silo::_hide", "Method", 12, 12), ("Silo::helper", "Method", 12, 12), ("Silo::size", "Method", 13, 13), ("run", "Const", 16, 16),
        ("submit", "Test", 17, 17), ("Grain", "Interface", 18, 18), ("Kind", "Enum", 19, 19), ("_Id", "TypeAlias", 20, 20), ("Farm.Deep", "Module", 21, 21), ("open", "Const", 21, 21), ("table", "Const", 22, 22),
        ("put", "Method", 22, 22), ("make", "Function", 23, 23),
    ]
    by = {r[0]: r for r in got}
    assert not by["_Id"][6] and not by["Silo::constructor"][6] and not by["Silo::_hide"][6] and by["load"][6] and not by["inner"][6] and by["make"][4] == "function make(…)" and by["Farm.Deep"][4] == "namespace Farm.Deep"
    assert [r[0] for r in rows("JavaScript", "type Id = 1\nfunction open() {\n{\nconst a = 1\n")] == ["open", "a"]
