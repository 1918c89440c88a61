"""Valid and invalid snippets of each language, written by hand from the languages' documentation, not from the test tables."""

VALID = {
    "py": [
        "x = 1\n", "def f(a, /, b=1, *args, c, **kw):\n    return a\n", "class A(B, metaclass=M):\n    x: int = 1\n    def m(self): ...\n",
        "with open(a) as f, open(b) as g:\n    pass\n", "with (open(a) as f, open(b) as g):\n    pass\n", "match x:\n    case [a, *rest] if a:\n        pass\n    case {'k': v, **r}:\n        pass\n    case A(x=1) | B():\n        pass\n    case _:\n        pass\n",
        "async def f():\n    async with a as b:\n        async for x in y:\n            await x\n", "x = [i for i in y if i for j in i]\n", "f = lambda *a, k=1, **kw: (yield)\n", "@dec(1)\n@a.b.c\ndef f() -> list[int]:\n    pass\n",
        "if (n := len(a)) > 10:\n    print(f'{n!r:>{w}}')\n", "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    pass\n", "def f[T: int](x: T) -> T:\n    return x\ntype A[T] = list[T]\n", "from . import x\nfrom ..a import (b as c, d,)\nimport a.b as q\n",
        "x[1:2, ::3, ...] = a, *b\n", "assert x, 'm'; del a[0], b\n", "global_ = 1; print(*a, **b, sep='')\n", "while True:\n    break\nelse:\n    continue_ = 1\n", "a = b'x' rb'\\d'\nc = '''multi\nline'''\n", "x = 0x_ff + 1_000 + 1e3j if a else not b\n",
    ],
    "js": [
        "function f() {\n  if (a)\n    return b\n  else if (c)\n    return d\n  else\n    return e\n}\n", "const o = {\n  a: 1,\n  b: x => x.y\n}\nmodule.exports = {\n  o\n}\n", "const x = a ? b ? c : d : e;\n", "const t = (s) =>\n  /^[@'\"]/.test(s) && !/x\\/y/i.test(s);\n", "export { a as default, b }\nconst\n  c = 1\n",
        "let a = 1, b;\nconst {x, y: {z = 1}, ...r} = o;\n", "class A extends (f(), B) { #p = 1; static { this.x = 1; } get v() { return this.#p; } static async *g() { yield* h(); } [k]() {} }\n",
        "const f = async ({a}, [b] = [], ...c) => { await a; };\n", "import d, * as n from 'm';\nimport {default as q, r as s} from './x.js';\nexport default class {}\nexport * as ns from 'y';\n", "const m = await import('./a.js');\nconsole.log(import.meta.url);\n",
        "function F() { if (!new.target) return new F(); }\n", "label: for (const x of xs) { if (x) continue label; else break label; }\n", "try { a(); } catch { b(); } finally { c(); }\n", "const t = tag`a${b}c`;\nconst r = /[/\\]]+/gu.test(s);\n", "a ??= b?.c?.[d]?.(e) ?? 1;\n",
        "switch (a) { case 1: case 2: f(); break; default: g(); }\n", "var o = { get a() { return 1; }, set a(v) {}, async b() {}, *c() {}, [d]: 1, 'e': 2, 3: 4, f, ...g };\n", "do x++; while (x < 5)\n", "for (;;) {}\nfor (var i = 0, n = 5; i < n; i++);\nfor (const k in o) f(k);\n", "if (a) b(); else if (c) d();\nelse { e(); }\n",
        "export const a = 1;\nexport { a as b };\nexport default async function () {}\n", "const x = a ? b : c ? d : e;\nvoid 0, typeof x, delete o.p;\n", "(function () { 'use strict'; })();\n(() => {})();\n", "const g = function* () { const x = yield; yield x; };\n", "x = y ** 2 >>> 1 & ~z;\nx >>>= 2; x <<= 1; x **= 3; x &&= y;\n",
        "for await (const x of y) { f(x); }\n", "const big = 1_000n + 0xFFn + 0b101n + .5e-3;\n", "class B { static x; 'y' = 1; async = 2; get; static async z() {} }\n", "let async; async = 1; let of = 2;\n", "throw new Error(`x ${`y ${z}`}`);\n",
    ],
    "ts": [
        "declare class A { #private; static from(x: number): A; readonly b: string; private c; get d(): Map<string, number>; }\n", "export default function f(x: string): void;\nexport default function f(x: any) {}\n", "import { a, type B, type C as D } from './x';\nexport type * from 'y';\nexport * as default from 'z';\n", "interface I {\n  a: Set<number>\n  b(): Promise<void>\n}\nlet x!: string;\n",
        "type A<T> = T extends (infer U)[] ? U : T extends string ? 'a' : never;\n", "type T = [a: string, b?: number, ...rest: boolean[]];\n", "const m: Map<string, Array<Record<string, Set<number>>>> = new Map();\n", "interface A<T extends object = {}> extends B<T>, C { readonly [k: string]: T; (x: number): string; new (y: string): A<T>; m?<U>(u: U): void; }\n",
        "type M = { readonly [K in keyof T]?: T[K] };\ntype N = { -readonly [K in keyof T as `get${K}`]-?: () => T[K] };\n", "abstract class A<T> implements I<T>, J { constructor(private readonly x: number, public y?: string) { super(); } abstract m(): void; static readonly z = 1 as const; declare w: string; }\n", "function f(this: Window, x?: number, ...r: string[]): asserts x is number {}\n",
        "function g<T>(a: T): T;\nfunction g(a: any): any { return a; }\n", "enum E { A = 1, B = A << 1, C = 'x' }\ndeclare const enum F { A }\n", "namespace A.B { export const x = 1; }\ndeclare module 'm' { export function f(): void; }\ndeclare global { interface Window { x: number } }\n", "import type { A, B } from './a';\nimport { type C, D } from './c';\nexport type { A };\n",
        "let x = y!.z as unknown as string;\nlet q = <any>w;\n", "const f = <T,>(x: T): x is NonNullable<T> => true;\n", "type F = (a: number, b?: string) => void;\ntype G = new (...args: any[]) => object;\ntype H = typeof import('./x');\n", "let u: string | undefined | null = null;\nlet v: A['b']['c'][] = [];\n", "@Dec({a: 1})\nexport class K { @Input() x: string; @Output() y = new E<string>(); constructor(@Inject(T) private t: T) {} }\n",
        "const s = { a: 1 } satisfies Record<string, number>;\n", "type U = A & { b: number } | (() => void) | readonly string[] | unique symbol;\n", "export default interface X { a: string, b: number }\n", "for (const [k, v] of Object.entries<number>(o)) {}\n", "class P { get a(): number { return 1; } set a(v: number) {} private static async *b<T>(x: T): AsyncGenerator<T> {} accessor_ = 1; }\n",
        "let fn: <T>(x: T) => T = (x) => x;\nlet t: `a${string}b`;\n", "export = foo;\n", "import fs = require('fs');\n", "function isA(x: unknown): x is A { return true; }\nlet o = a?.b!.c;\n",
    ],
    "java": [
        "package a.b.c;\nimport java.util.*;\nimport static a.B.c;\npublic class A<T extends Comparable<? super T>> extends B<T> implements C, D<T> { }\n", "class A { Map<String, List<Map<Integer, List<Set<String>>>>> m = new HashMap<>(); }\n", "class A { int f(Object o) { return switch (o) { case Integer i when i > 1 -> i; case String s -> { yield 1; } case null, default -> 0; }; } }\n",
        "record P(int x, @N String y) implements Q { P { if (x < 0) throw new E(); } static int z = 1; }\n", "sealed interface S permits A, B {}\nnon-sealed class A implements S {}\nfinal class B implements S {}\n", "enum E implements I { A(1) { int f() { return 1; } }, B(2); private final int v; E(int v) { this.v = v; } }\n", "class A { <T> void f(List<? extends T>... xs) throws X, Y { this.<String>g().<A, B>h(); } }\n",
        "class A { void f() { try (var r = open(); R s = new R()) { } catch (IOException | X e) { } finally { } } }\n", "class A { Runnable r = () -> {}; F<A, B> g = (x, y) -> x + y; F h = A::new; F i = int[]::new; F j = this::m; }\n", "@interface Ann { String value() default \"x\"; int[] n() default {1, 2}; Class<?> c(); }\n", "class A { int[][] a = new int[3][], b = {{1}, {2, 3}}; int c[] = new int[]{1}; }\n",
        "class A { void f() { for (int i = 0, j = 1; i < j; i++, j--) {} for (final var x : xs) {} outer: while (true) { continue outer; } do { } while (x); } }\n", "class A { static { x = 1; } { y = 2; } A() { this(1); } A(int x) { super(); } }\n", "class A { boolean f(Object o) { return o instanceof String s && !s.isEmpty() || o instanceof P(int x, var y) && x > 0; } }\n", "class A { String s = \"\"\"\n  text \"quoted\"\n  \"\"\"; char c = '\\''; long l = 0xFFL + 1_000L + 0b1; double d = 1e-3d; }\n",
        "class A { void f() { int x = (int) y + (a < b ? 1 : 2); List<int[]> z = (List<int[]>) w; synchronized (this) { assert x > 0 : \"m\"; } } }\n", "class A { @Override @SuppressWarnings({\"a\", \"b\"}) public final native int f(@N final int x, int... y); }\n", "class A { Outer.Inner i = outer.new Inner(); Object o = new B<C>() { void m() {} }; Class<?> k = int.class; A[] as = A[].class.cast(x); }\n", "interface I { default void a() {} static void b() {} private void c() {} int D = 1; }\n", "class A { void f() { switch (x) { case 1: case 2: g(); break; default: h(); } if (a) b(); else if (c) d(); else e(); } }\n",
        "class A { class B {} void f() { class L { } record R(int a) {} var b = new L(); x >>>= 2; x = y >>> 1; } }\n",
    ],
    "go": [
        "package main\n\nimport (\n\t\"fmt\"\n\tm \"math\"\n\t_ \"x\"\n)\n\nfunc main() {\n\tfmt.Println(m.Pi)\n}\n", "package a\n\nvar c chan<- int\nvar d <-chan map[string][]*T\nvar f func(int, ...string) (int, error)\n", "package a\n\ntype N interface {\n\t~int | ~string\n\tcomparable\n\tM(x int) (y string, err error)\n}\n", "package a\n\nfunc F[T any, U ~int | string](xs []T, f func(T) U) []U {\n\treturn nil\n}\n",
        "package a\n\nvar t = []struct {\n\tname string\n\twant int\n}{\n\t{\"a\", 1},\n\t{name: \"b\", want: 2},\n}\n", "package a\n\nfunc f() {\n\tselect {\n\tcase x := <-c:\n\t\t_ = x\n\tcase d <- 1:\n\tdefault:\n\t}\n}\n", "package a\n\nfunc f(x interface{}) {\n\tswitch y := x.(type) {\n\tcase int, *string:\n\tcase nil:\n\tcase func(int) error:\n\tdefault:\n\t\t_ = y\n\t}\n}\n",
        "package a\n\ntype S struct {\n\tA, B int `json:\"a\"`\n\t*E\n\tpkg.F\n\tc [4]byte\n\tG[int]\n}\n", "package a\n\nfunc (s *S[T]) M(a, b int) (n int, err error) {\n\tdefer func() { recover() }()\n\tgo s.x()\n\treturn\n}\n", "package a\n\nconst (\n\tA = iota\n\tB\n\tC int = 1 << 3\n)\n\nvar x, y = 1, \"s\"\n", "package a\n\nfunc f() {\n\tfor i := 0; i < 10; i++ {\n\t}\n\tfor k, v := range m {\n\t\t_, _ = k, v\n\t}\n\tfor range c {\n\t}\n\tfor {\n\t\tbreak\n\t}\n}\n",
        "package a\n\nfunc f() {\n\tif v, ok := m[k]; !ok {\n\t\treturn\n\t} else if v == 1 {\n\t} else {\n\t}\nL:\n\tfor {\n\t\tcontinue L\n\t}\n}\n", "package a\n\nvar m = map[string][]int{\n\t\"a\": {1, 2},\n\t\"b\": nil,\n}\nvar p = &T{x: 1, y: U{}}\nvar z = [...]string{2: \"a\"}\n", "package a\n\nfunc f() {\n\tx.y[1:2].z(a...)\n\tb := a[:n:m]\n\tc <- <-d\n\tx, y = y, x\n\t*p++\n\ta &^= b\n}\n", "package a\n\nvar f = func(x int) func() int { return func() int { return x } }\nvar r = 'a' + '\\n' + '\\u00e9'\nvar s = `raw\nstring`\n",
        "package a\n\ntype (\n\tA = B\n\tC map[string]interface{}\n\tD func(x, y int) bool\n)\n", "package a\n\nfunc f() {\n\tx := Map[string, int](a, b)\n\tvar e error = errors.New(\"x\")\n\tgoto end\nend:\n\tfmt.Println(x, e)\n}\n", "package a\n\ntype T[K comparable, V any] struct {\n\tm map[K]V\n}\n\nvar t T[string, []int]\n", "package a\n\nfunc f() {\n\tswitch {\n\tcase x > 1 && y < 2:\n\t\tfallthrough\n\tdefault:\n\t}\n\tswitch x := f(); x {\n\t}\n}\n", "package a\n\nfunc f() { x := 1; y := 2; _ = x + y }\nvar h = 0x1p-2 + 1_000 + 0b11 + 0o17 + 3i\n",
    ],
    "rs": [
        "use {a::b, c as d};\nfn f() { match x { A => match y { B => 1, C => 2 }, D => S { a: 1 }, E => return z, _ => { 3 } } }\n", "fn r#as() { let t = self\n    .0\n    .g(); if unsafe { h() } { } let v = [#[cfg(x)] 1, 2]; a.union(&b); }\n",
        "macro_rules! m {\n    ($x:expr) => { $x + 1 };\n    ($($y:ident),* $(,)?) => { $( let $y = 1; )* };\n}\n", "impl<T: Fn(u8) -> u8 + 'static> A for B<T> where T: Clone, { type X = <T as C>::Y; const N: usize = 3; fn f(&mut self) -> Option<Vec<Box<dyn Fn(&str) -> Result<(), E>>>> { None } }\n", "fn f() -> impl Iterator<Item = (u8, String)> + 'static { std::iter::empty() }\n", "fn f() { let x = <A as B>::c(); let y = Vec::<u8>::with_capacity(1); let z = \"1\".parse::<u32>()?; }\n",
        "fn f(x: Option<i32>) { if let Some(y @ 1..=5) = x { } else if let None = x { } while let Some(_) = g() { } let Some(z) = x else { return; }; }\n", "fn f(e: E) -> u8 { match e { E::A { x, .. } if x > 1 => 1, E::B(ref y, _) | E::C(y) => { 2 } 'a'..='z' => 3, -1 => 4, _ => unreachable!(), } }\n", "#[derive(Debug, Clone)]\n#[cfg(all(unix, feature = \"x\"))]\npub(crate) struct S<'a, T: 'a + ?Sized, const N: usize = 3> { pub a: &'a T, b: [u8; N], }\n", "enum E { A, B(u8, String), C { x: i32 }, D = 5 }\nstruct U;\nstruct T(pub u8, f64);\n",
        "trait T: A + B { type X: Clone; const C: u8 = 1; fn f<'a>(&'a self) -> &'a str; fn g() where Self: Sized {} }\n", "async fn f() -> Result<()> { let x = g().await?; tokio::spawn(async move { h(x).await }); Ok(()) }\n", "fn f() { let c = |x: i32, &(a, b): &(u8, u8)| -> i32 { x + 1 }; let d = move || 1; v.iter().map(|x| x * 2).filter(|&x| x > 1).collect::<Vec<_>>(); }\n", "use a::{b::{self, c}, d as e, f::*};\npub use crate::x::Y;\nextern crate z;\nmod m { pub fn f() {} }\nmod n;\n",
        "unsafe extern \"C\" fn f(x: *const u8, y: *mut i32) -> ! { loop {} }\nextern \"C\" { fn g(x: i32); static H: u8; }\n", "static mut X: [u8; 3] = [0; 3];\nconst F: fn(u8) -> u8 = g;\ntype A<T> = Result<T, Box<dyn std::error::Error + Send + Sync>>;\n", "fn f() { 'outer: for i in 0..10 { for j in (0..=5).rev() { if i == j { break 'outer; } } } let x = loop { break 5; }; }\n", "fn f() { let s = S { a: 1, b, ..Default::default() }; let S { a, .. } = s; let [x, y, ..] = arr; let (mut p, ref q) = t; x as u8 as char; &mut v[1..]; }\n", "fn f() { let r = r#\"raw \"x\"\"#; let b = b\"bytes\"; let c = '\\u{1F600}'; let n = 1_000u64 + 0xFF + 1e-3f64; println!(\"{:?} {x}\", n); }\n",
        "impl fmt::Display for A { fn fmt(&self, f: &mut fmt::Formatter<'_>) -> fmt::Result { write!(f, \"{}\", self.0) } }\n", "fn f<T>(x: T) -> T where T: Into<String> + for<'a> Fn(&'a str), { x }\n", "fn f() -> u8 { let x = if a { 1 } else { 2 }; let y = match x { 1 => 2, _ => 3 } + 1; unsafe { g() }; return y; }\n", "fn f() { a.b.0.1(); x <<= 1; y >>= 2; z = !a && b || c; let v: Vec<Vec<u8>> = vec![vec![1]; 2]; }\n",
    ],
    "c": [
        "#define A 0x01 /* one\n                  more */\n#define B(x) ((x) / 2) // half\nextern int f(int) __THROW;\nstruct s { int a; } __attribute__((packed));\nenum e {\n#define X 1\n  P = 1,\n  Q,\n};\n",
        "#include <stdio.h>\nint main(int argc, char **argv) { return 0; }\n", "static int (*table[])(int, char *) = { f, g, 0 };\nint (*get(void))(int);\n", "typedef struct node { struct node *next; int x : 3, : 0; union { int a; float b; }; } node_t;\n", "enum e { A = 1 << 2, B, C = sizeof(int) };\n", "void f(void) { int a[2][3] = {{1, 2, 3}, [1] = {4}}; struct p q = { .x = 1, .y = { 2 } }; }\n", "int f(const char *restrict s, ...) ;\nextern int x, *y, z[10];\n",
        "void f() { for (int i = 0, j = 1; i < j; ++i, --j) ; while (x) { if (a) continue; else break; } do { } while (0); }\n", "void f() { switch (x) { case 1: case 'a': g(); break; default: h(); } goto end; end: return; }\n", "int x = (int) (y ? *p++ : -1);\nchar s[] = \"a\" \"b\";\n", "static inline unsigned long long f(unsigned int x) { return x >> 3 | ~x & 0xFFUL; }\n", "#define M(a, b) \\\n  do { a; b; } while (0)\n#if defined(X) && Y > 1\nint z;\n#endif\n", "struct s { int (*cb)(void *, size_t); char name[32]; const struct s *const self; };\n",
        "int a = sizeof(struct s), b = sizeof *p, c = sizeof(int[3]);\n", "void f(int n, int a[n], int (*b)[3], void (*cb)(int)) { (*cb)(1); cb(a[0]); p->q->r.s[1] = (struct t){ 1, 2 }; }\n", "_Static_assert(sizeof(int) == 4, \"x\");\n_Bool b;\n", "typedef int (*fn)(int);\ntypedef unsigned char byte, *pbyte;\nfn handlers[4];\n", "double d = 1.5e-3, e = .5f, g = 0x1p3;\nwchar_t *w = L\"x\";\nchar c = '\\x41', q = '\\'';\n", "int f(int a, char *b) { return a; }\n", "volatile sig_atomic_t flag;\nregister int r;\nint *const p = &x, **pp;\n", "void f(void) { x = a, b; y += (z, 1); if (!(x & 1) && *p != '\\0') { ; } return (void) 0; }\n",
    ],
    "cpp": [
        "#include <vector>\nstd::map<std::string, std::vector<std::pair<int, std::set<double>>>> m;\n", "std::function<void(int, const std::string&)> f = [&, x = 1](auto&& a, int b) mutable noexcept -> int { return b; };\n", "[[nodiscard]] constexpr int f() noexcept;\nclass [[deprecated(\"x\")]] A;\n", "template <>\nstruct H<int> { static constexpr int v = 1'000'000; };\n", "template <typename T, int N = 3, template <typename> class C, typename... Ts>\nclass A : public B<T>, private virtual C<T> { public: A() = default; A(const A&) = delete; ~A() override; };\n", "namespace a::b { inline namespace c { int x; } }\nusing namespace std;\nusing a::b::x;\nusing V = std::vector<int>;\n",
        "template <typename T> using P = std::unique_ptr<T>;\ntemplate <class T> auto f(T&& t) -> decltype(g(std::forward<T>(t)));\n", "int main() { for (const auto& [k, v] : m) {} if (auto it = m.find(1); it != m.end()) {} auto p = std::make_unique<A<int>>(1, 2); }\n", "A::A(int x) : a_(x), b_{1}, C<int>(x) { throw std::runtime_error(\"x\"); }\nA& A::operator=(A&& o) noexcept { return *this; }\n", "bool operator<(const A& a, const A& b);\nstd::ostream& operator<<(std::ostream& o, const A&);\n",
        "enum class E : uint8_t { A = 1, B };\nunion U { int a; float b; };\nextern \"C\" { void f(int); }\nextern \"C\" int g();\n", "void f() { try { g(); } catch (const std::exception& e) { throw; } catch (...) {} delete[] p; auto* q = new (buf) T[3]{}; }\n", "template <typename... A> void f(A&&... a) { (g(a), ...); h(std::forward<A>(a)...); int n = sizeof...(A); }\n", "class A { friend class B; friend void f(A&); static inline int n = 0; mutable int m{}; int bits : 3; using X = int; enum { K = 1 }; template <class T> void t(T x) const &; virtual void v() = 0; explicit operator bool() const { return true; } };\n",
        "auto x = static_cast<std::vector<int>*>(p)->size() + reinterpret_cast<uintptr_t>(q);\nauto s = R\"(raw \"x\")\";\nauto y = a < b && c > d;\n", "struct S { int x = 1; S() : x{2} {} auto operator<=>(const S&) const = default; int operator()(int a) const { return a; } int& operator[](size_t i); };\n", "const char* const names[] = {\"a\", \"b\"};\nint (*fp)(int) = nullptr;\n", "constexpr auto f = [](auto x) { return x; };\n",
        "void f() { if constexpr (std::is_same_v<T, int>) { } else { } switch (x) { case E::A: { break; } [[fallthrough]]; default: break; } }\n", "static_assert(sizeof(int) == 4);\nthread_local int t = 0;\nalignas(16) char b[16];\n", "std::array<int, 3> a{1, 2, 3};\nstd::vector<std::vector<int>> v = {{1}, {2, 3}};\nunsigned long long n = 0xFFULL;\n", "template <typename T>\ntypename A<T>::B A<T>::f(const typename T::X& x) const { return typename T::Y(x); }\n", "void f(int (&a)[3], std::initializer_list<int> l = {1, 2}, int* p = nullptr) { a[0] = *p++; p->~T(); this->x_ = (y) ? z : -1; }\n",
    ],
    "rb": [
        "def square(x) = x * x\n", "case [1, [2, 3]]\nin [Integer => a, [b, *c]] if a > 0\n  p a\nin {name: String => n, age: 18..}\n  p n\nelse\n  p 1\nend\n", "x = if a then 1 elsif b then 2 else 3 end\ny = while z do break end\n", "class A < B::C\n  include D\n  attr_accessor :a, :b\n  def initialize(a, b = 1, *c, d:, e: 2, **f, &g)\n    super\n    @a ||= a\n  end\n  class << self\n    def m; end\n  end\nend\n", "module M\n  X = %w[a b c].freeze\n  Y = { a: 1, 'b' => 2, c: { d: 3 } }\nend\n", "foo.each do |a, (b, c), *d, e: 1|\n  next unless a\nrescue X, Y => e\n  retry\nensure\n  z\nend\n",
        "puts \"a #{b + \"c #{d}\"} e\"\nx = <<~EOS\n  text #{y}\nEOS\n", "begin\n  a\nrescue StandardError => e\n  raise\nelse\n  b\nensure\n  c\nend while d\n", "l = ->(x, y = 1) { x + y }\nm = lambda { |x| x }\nl.(1, 2)\nl[3]\n", "a, (b, *c), d = 1, [2, 3], 4\na, b = b, a\n", "return if x && !y or not z\nputs [1, 2].map(&:to_s).join(', ')\n", "def self.m(*) = nil\ndef a?; true; end\ndef b!(x) x end\ndef c=(v); @c = v; end\ndef ==(o); end\ndef [](i); end\ndef +(o) o end\n",
        "x&.y&.z\nA::B.c\n::D\nx <=> y\na ** b\nc =~ /re\\/x/i\n$1 + $~.to_s\n", "case x\nwhen 1, 2..3 then a\nwhen String, :sym\n  b\nelse c\nend\n", "unless a\n  b\nelse\n  c\nend\nuntil d\n  e\nend\nfor i in 1..10 do p i end\nloop { break }\n", "h = { \"a\": 1, b:, **c }\nf(**h, &blk)\nf a, b: 1 do |x| y end\n", "private def m(a)\n  yield a, 1\n  block_given? ? 1 : 2\nend\n", "alias old new\nalias_method :a, :b\n", "x = :\"a b\"\nz = %i[a b]\nw = %q(a (b) c)\n",
        "Struct.new(:a, :b) do\n  def c\n    a\n  end\nend\n", "x = y rescue z\nx += 1 while x < 5\nraise ArgumentError, \"m\" unless x\n",
    ],
    "sh": [
        "#!/bin/bash\nset -euo pipefail\nx=$(case $a in b) echo c;; *) echo d;; esac)\n", "if [ -f \"$a\" ] && [[ $b =~ ^x.*$ ]]; then\n  echo y\nelif ! grep -q z w; then\n  :\nelse\n  exit 1\nfi\n", "for f in *.txt \"$@\"; do\n  echo \"$f\"\ndone | sort > out 2>&1\n", "for ((i = 0; i < 10; i++)); do echo $i; done\n", "while read -r line; do\n  echo \"${line%%:*}\"\ndone < <(cat file)\n", "case \"$1\" in\n  -h|--help) usage ;;\n  (start) run ;&\n  [0-9]*) num \"$1\" ;;\n  *) exit 2\nesac\n",
        "f() {\n  local a=\"$1\" b\n  return 0\n}\nfunction g { echo \"$(f \"a b\")\"; }\nh() ( cd /tmp && ls )\n", "cat <<EOF > x\ntext $a $(b)\nEOF\ncat <<-'E2'\n\traw `x\n\tE2\n", "a=(1 2 \"x y\" $(ls))\na+=(3)\necho \"${a[@]}\" \"${#a[@]}\" \"${a[0]:-x}\"\n", "until false; do break; done &\nwait $!\n", "((x++)) || true\nlet y=1+2\nz=$((x * (y + 1)))\n", "trap 'rm -f \"$tmp\"' EXIT INT\nexec 3>&1 4< file\necho a >&2 2>/dev/null\n",
        "select o in a b; do echo $o; break; done\n", "{ echo a; echo b; } > f\n( cd x; make ) || exit 1\n", "if true; then echo a; fi; while :; do break; done\n", "diff <(sort a) <(sort b)\necho a |& tee b\n", "[ \"$a\" = b ] && echo x || echo y\n! true\ntime ls\n", "x=`ls | wc -l`\ny='it'\\''s'\nz=\"a \\\"b\\\" c\"\n", "while [ $# -gt 0 ]; do\n  case $1 in\n    --a=*) a=\"${1#*=}\"; shift;;\n    --) shift; break;;\n  esac\ndone\n", "export A=1 B=\"2\"; readonly C=3; declare -A m=([a]=1 [b]=2)\n", "# only a comment\n\n",
    ],
}

INVALID = {
    "py": ["f(a=1, 2)\n", "1 = x\n", "def f(a=1, b):\n    pass\n", "if x\n    pass\n", "def f(:\n    pass\n", "x = (1, 2\n", "  x = 1\n y = 2\n", "class A\n    pass\n", "print 'a'\n", "x = [1, 2)\n", "<<<<<<< HEAD\nx = 1\n=======\n", "return = 1\n", "for x y:\n    pass\n", "def f():\nreturn 1\n", "x = 'abc\n"],
    "js": ["function f( {\n}\n", "let x = ;\n", "if (a { b(); }\n", "const a = 1 const b = 2\n", "class { }\n", "x = {a: 1, b 2};\n", "for (let i = 0; i < 5) {}\n", "let x: number = 1;\n", "function f() {\n", "<<<<<<< HEAD\nlet a;\n", "def f():\n    pass\n", "import {a from 'b';\n", "var 1a = 2;\n", "a = b +;\n", "interface A { x: number }\n"],
    "ts": ["function f( {\n}\n", "let x: = 1;\n", "type A = ;\n", "interface A { x: }\n", "class A { constructor( }\n", "const a = 1 const b = 2\n", "enum { A }\n", "def f():\n    pass\n", "function f(): { return 1; \n", "<<<<<<< HEAD\nlet a;\n", "let a: Map<string = x;\n", "import {a from 'b';\n"],
    "java": ["class A { void f( { } }\n", "class A { int x = ; }\n", "class A {\n", "class { }\n", "class A { void f() { int x = 1 } }\n", "class A { void f() { if (a { } } }\n", "public void f() -> x {}\n", "class A { int f() { return 1; }\n", "def f():\n    pass\n", "<<<<<<< HEAD\nclass A {}\n", "class A { void f() { for (int i = 0; i < 5) { } } }\n", "import a.b\nclass A {}\n", "class A { fn f() -> u8 { 1 } }\n"],
    "go": ["package a\nfunc f( {\n}\n", "package a\nfunc f() {\n\tx := \n}\n", "package a\nfunc f() {\n", "package a\nvar x int = \n", "package a\nfunc f() {\n\tif x {\n\t}\n\telse {\n\t}\n}\n", "package a\nfunc f() { for i := 0; i < 5 { } }\n", "class A {}\n", "package a\n<<<<<<< HEAD\nvar x int\n", "package a\ntype T struct {\n\tx int,\n}\n", "package a\nvar m = map[string]int{\n\t\"a\": 1\n}\n", "package a\nimport \"x\n", "def f():\n    pass\n", "package a\nfunc f() int { return 1 + }\n"],
    "rs": ["fn f( {\n}\n", "fn f() { let x = ; }\n", "fn f() {\n", "struct S { a: }\n", "fn f() -> { 1 }\n", "fn f() { let x = 1 let y = 2; }\n", "impl A for { }\n", "<<<<<<< HEAD\nfn f() {}\n", "def f():\n    pass\n", "fn f() { match x { 1 => } }\n", "enum E { A(, B }\n", "fn f() { if x { } else }\n", "int main() { return 0; }\n"],
    "c": ["int f( {\n}\n", "int x = ;\n", "int f() {\n", "int f() { int x = 1 }\n", "struct s { int a }\n", "int f() { if (a { } }\n", "int f() { for (i = 0; i < 5) { } }\n", "<<<<<<< HEAD\nint x;\n", "class A { public: int x; };\n", "def f():\n    pass\n", "int a[3 = {1};\n", "template <typename T> T f(T x) { return x; }\n", "int f() { return 1 + ; }\n", "std::vector<int> v;\n"],
    "cpp": ["int f( {\n}\n", "int x = ;\n", "class A { public int x; };\n", "int f() {\n", "class A { int x; }\nint y() { return 1; \n", "int f() { int x = 1 }\n", "int f() { if (a { } }\n", "<<<<<<< HEAD\nint x;\n", "def f():\n    pass\n", "std::vector<int v;\n", "int f() { return 1 + ; }\n", "template typename T> void f();\n", "int f() { return a b; }\n"],
    "rb": ["def f(\n  1\nend\n", "class A\n  def f\nend\n", "if x\n  y\n", "x = [1, 2\n", "def f\n  1\nend\nend\n", "<<<<<<< HEAD\nx = 1\n=======\n", "puts(1, 2\n", "x = {a: 1\n", "def f(a, b\n", "foo do |x\n  y\nend\n", "x = 1 +\n", "case x\nwhen 1\n"],
    "sh": ["if [ a ]; then\n  echo b\n", "for i in a b; do\n  echo\n", "case x in\n  a) b;;\n", "f() {\n  echo\n", "echo \"abc\n", "while true; do echo; done; done\n", "fi\n", "if true; fi\n", "x=$(ls\n", "<<<<<<< HEAD\nx=1\n", "echo a | | b\n", "if then echo; fi\n", "a && && b\n", "echo )\n"],
}
