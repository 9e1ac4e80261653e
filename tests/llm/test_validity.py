"""Validity of source files: constructs of each language, cut and tangled ones, and chunks against whole files."""

import random
from functools import reduce
from pathlib import Path

import pytest

from strataloom.llm import lexing as L
from strataloom.llm import validity as V

JS = r"""#!/usr/bin/env node
import a, { b as c, default as d } from "x"; import * as n from 'y'; import "z";
export * from "q"; export { c as e }; export default class extends a { #p = 1; static s; static { n.f(); } get x() { return this.#p; } async *g(...r) { yield* r; } }
/* } */ const re = /[/}\]]+\/"/g.test("}") ? `t${c ? `in${d}` : "}"}x` : a / 2 / n;
label: for (const [k, { v = 1, ...rest }] of Object.entries(n)) { if (k in rest) continue label; else break; }
const f = async ({ a1, b1 = 2 }, [x], ...z) => { await x; for await (const y of z) y?.w?.[0]?.(); return { a1, [k]: 1, m() {}, get q() { return 1 }, 'str': 2, async h() {} } }
let g = x => ({ x }), h = function* named() { yield 1 }
do { g++ } while (g < 3) if (h) { } else throw new Error("no")
try { f() } catch { } finally { }
switch (g) { case 1: case 2: { break } default: g ??= h ** 2, g ||= !h; }
var o = new (class { })(), w = new n.W, u = typeof void 0, im = import("x"), me = import.meta.url;
export const e1 = 1, e2 = (a, b) => a >>> b
export async function e3() { return }
"""
TS = r"""import type { A } from "a"; import { type B, C } from "b";
export interface I<T extends object = {}> extends B, A<T> { readonly a: string; b?: number; [k: string]: unknown; m<U>(x: U): void; new (x: number): I<T>; (y: string): boolean }
export type U = { a: string; n: number } | null | "lit" | 5 | (A & B)[] | ((x: number, ...r: string[]) => void) | typeof C | keyof A | A["k"];
type M<T> = { readonly [K in keyof T]?: T[K] }; type Cn<T> = T extends Array<infer E> ? E : never;
export enum E { A = 1, B = "x" } declare const g: number; namespace N.M { export const x = 1 }
abstract class K<T> extends Base<T> implements I<T>, B { private readonly m: Map<string, Array<Array<T>>> = new Map(); constructor(private a: string, public b?: number) { super() } public abstract f(): void; get v(): T | undefined { return this.m.get("a")![0] as unknown as T } static s<X>(this: K<X>, y = 1): y is number { return <any>y } declare z: string }
export const f = async <T,>(x: T, y?: number): Promise<T | undefined> => { const z = x as const; return y! > 1 ? (x satisfies T) : undefined };
export function over(a: string): void; export function over(a: any) { for (const k of Object.keys(a) as string[]) a[k]<number>(1) }
const w = a < b && c > d, q = cond ? (p: number) : 3 > 2 ? 1 : 2;
"""
TS = TS.replace("cond ? (p: number) : 3 > 2 ? 1 : 2", "cond ? (p) : 3 > 2 ? 1 : 2")
JAVA = r"""package dev.a.b; import java.util.*; import static java.lang.Math.max;
@Deprecated(since = "1", forRemoval = true) public final class A<T extends Comparable<T> & Runnable> extends B<T> implements C, D<int[]> {
  private static final Map<String, List<? super T>> M = new HashMap<>(), N; static { int[] a = {1, 2,}, b[] = new int[3][]; } { N2(); }
  enum E implements C { X(1) { void f() {} }, Y; E(int... v) {} } record R(int a, String b) { R { if (a < 0) throw new IllegalArgumentException("}"); } } @interface Q { String v() default "x"; int[] w() default {}; } sealed interface S permits A {}
  public <U> A(final U u, @Nn int x) throws Exception { this(); super.f(); }
  abstract int f(int[] v, String... s) throws X, Y;
  int g(Object o) { label: for (int i = 0, j = 1; i < 10 && j >> 1 > 0; i++, j += 2) { if (o instanceof String s && !s.isEmpty()) continue label; else break; } for (var e : M.entrySet()) { }
    try (var r = open(); s) { } catch (A | B e) { } finally { } do { x--; } while (x > 0); synchronized (this) { } assert x > 0 : "m";
    switch (o) { case 1, 2: return 1; default: break; } int y = switch (o) { case Integer i when i > 3 -> i; case R(int a, var b) -> { yield a; } case null, default -> throw new X(); };
    Runnable rr = () -> {}; Function<Integer, Integer> h = x -> x + 1, k = (a, b) -> (int) a; f(String[]::new, List<String>::size, A.this::g); T t = (T) o; int z = (a) - b; char c = '\'', d = '\u0041'; long l = 0xFFL + 1_000L; double q = 1.5e-3 + .5f;
    String tb = """ + '"""' + r"""
      text "block" } """ + '"""' + r"""; new A<>(1) { int q; }.run(); return o == null ? a[1][2]++ : ~-x; }
}
"""
GO = """// c
package main

import (
	"fmt"
	. "strings"
	_ "os"
)

type (
	T[K comparable, V ~int | string] struct {
		A, b int `json:"a"`
		*E
		F func(int, ...string) (x, y int)
		m map[string][]chan<- int
	}
	I interface {
		M(x int) error
		~int | string
	}
	Al = []int
)

const (
	A = iota
	B
)

var x, y = 1, 'a'

func (t *T[K, V]) M(a, b int, c ...string) (n int, err error) {
	if v, ok := m["k"]; !ok && x == (T{}) {
		return 1, nil
	} else if t != nil {
		goto end
	}
	for i := 0; i < 10; i++ {
		continue
	}
	for _, v := range []int{1, 2} {
		x += v << 2 &^ 3
	}
	for range ch {
	}
	for {
		break
	}
	switch z := v.(type) {
	case int, *string, map[string]int:
		fallthrough
	default:
	}
	select {
	case ch <- 1:
	case w, ok := <-ch:
	}
	defer func() { recover() }()
	go f(a...)
	s := []T{{A: 1}, {b: 2}}[1:2:3]
	p := &struct{ a int }{1}
	m2 := map[string]func() int{"a": func() int { return 1 }}
end:
	fn[int](make([]int, 3), new(T), []byte("x"), (*T)(nil), g(chan int(nil)))
	return len(s), fmt.Errorf(`raw
}`)
}
"""
SQL = """-- x
WITH RECURSIVE a(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM a WHERE n < 5), b AS MATERIALIZED (INSERT INTO t DEFAULT VALUES RETURNING *)
SELECT DISTINCT ON (x.y) x.*, count(*) FILTER (WHERE z) OVER (PARTITION BY q ORDER BY r DESC NULLS LAST ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n, CASE WHEN a IS NOT NULL THEN 'it''s' ELSE E'\\'' END "Q", a::numeric(12, 2)[], ARRAY[1, 2], (SELECT 1), INTERVAL '1 day' + now() AT TIME ZONE 'UTC'
FROM public.t AS x LEFT JOIN LATERAL (SELECT 1) s ON TRUE CROSS JOIN u NATURAL JOIN v, generate_series(1, 3) g(i) WHERE a NOT IN (1, 2) AND b BETWEEN 1 AND 2 OR c NOT LIKE '%x' AND EXISTS (SELECT) GROUP BY 1, ROLLUP (a, b) HAVING max(a) > ANY (ARRAY[1]) ORDER BY n DESC LIMIT 5 OFFSET 1 FOR UPDATE;
CREATE TABLE IF NOT EXISTS s.t (id BIGINT GENERATED ALWAYS AS IDENTITY PRIMARY KEY, a VARCHAR(20) NOT NULL DEFAULT 'x' CHECK (a <> ''), ts TIMESTAMP WITH TIME ZONE DEFAULT now(), r INT REFERENCES o (id) ON DELETE SET NULL, CONSTRAINT c UNIQUE (a, r), FOREIGN KEY (r) REFERENCES o) PARTITION BY RANGE (ts);
CREATE UNIQUE INDEX CONCURRENTLY i ON t USING gin (lower(a) text_ops DESC, (b -> 'c')) WHERE a IS NOT NULL; CREATE OR REPLACE VIEW v AS SELECT 1; CREATE FUNCTION f(a int) RETURNS int LANGUAGE sql AS $$ SELECT '}' $$; CREATE USER u WITH PASSWORD 'x';
ALTER TABLE t ADD COLUMN a INTEGER, DROP COLUMN IF EXISTS b CASCADE, ALTER COLUMN c TYPE text USING c::text, RENAME TO z; INSERT INTO t (a, b) VALUES (1, 'x'), (2, DEFAULT) ON CONFLICT (a) DO UPDATE SET b = EXCLUDED.b RETURNING id; UPDATE t SET a = 1, (b, c) = (1, 2) FROM u WHERE t.id = u.id; DELETE FROM t USING u WHERE a; DROP TABLE IF EXISTS a, b CASCADE; GRANT SELECT ON t TO u; COMMENT ON TABLE t IS 'x'; BEGIN; COMMIT; SET search_path TO a, b; TRUNCATE t RESTART IDENTITY; /* a /* b */ c */
"""
VALID = [("JavaScript", JS), ("TypeScript", TS), ("Java", JAVA), ("Go", GO), ("SQL", SQL), ("Python", "def f(x, /, *, y: int = 1):\n    match x:\n        case [1, *_]:\n            return f'{x!r}'\n")]


@pytest.mark.parametrize("lang,text", VALID)
def test_valid(lang, text):
    assert V.error(lang, text) is None
    assert V.error(lang, "﻿" + text.replace("\n", "\r\n")) is None or lang == "JavaScript"


@pytest.mark.parametrize("lang,text", VALID)
def test_conflicts_and_other_languages(lang, text):
    lines = text.split("\n")
    k = len(lines) // 2 if lang not in ("SQL",) else 1
    assert V.error(lang, "\n".join([*lines[:k], "<<<<<<< HEAD", *lines[k:], "=======", "x", ">>>>>>> branch"]))
    for other, foreign in VALID:
        if other != lang and (other, lang) != ("JavaScript", "TypeScript"):
            assert V.error(lang, foreign), (lang, other)
    assert V.error(lang, "502 Bad Gateway\n\nThe server could not handle the request for this file.\n")


@pytest.mark.parametrize("lang,text", [v for v in VALID if v[0] in ("Java", "Go")])
def test_cut_anywhere(lang, text):
    """A cut file of these languages is valid only between two declarations or in trailing blanks and comments."""
    kept = [n for n in range(30, len(text.rstrip()) - 1, 7) if V.error(lang, text[:n]) is None]
    assert len(kept) < 0.12 * len(text) / 7


CASES = [
    ("JSON", '{"a": [1, 2.5e3, null]}', True), ("JSON", '{"a": NaN}', False), ("JSON", "  ", False), ("JSON", '{"a": 1,}', False),
    ("YAML", "a:\n  - b\n--- \nc: d\n", True), ("YAML", "a:\n\tb: 1\n", False), ("TOML", "a = 1\n[b]\n", True), ("TOML", "[a\n", False),
    ("Requirements", "a>=1,<2 ; python_version < '3.9' and sys_platform == \"x\"\n# c\n-r o.txt\n--extra-index-url https://u:p@h/s\nb[x,y] @ https://h/w.whl\ngit+https://h/r.git#egg=q\n", True), ("Requirements", "a>=1\n=======\n", False), ("Requirements", "def f():\n", False),
    ("Markdown", "Title\n=======\n\n```\n<<<<<<< a\n=======\n>>>>>>> b\n```\n", True), ("Markdown", "a\n<<<<<<< HEAD\nb\n=======\nc\n>>>>>>> d\n", False), ("Markdown", ">>>>>>> quoted deep\n", True),
    ("Python", "return 1\n", False), ("Python", "s = '''\n<<<<<<< a\n'''\n", True), ("Python", "x = 1\x00", False), ("JavaScript", "/*\n<<<<<<< a\n=======\n*/\n", True), ("TypeScript", "let a = `\n<<<<<<< x\n`;", True),
    ("JavaScript", "return 1;", False), ("JavaScript", "let a = 1 let b", False), ("JavaScript", "a b", False), ("JavaScript", "x = {a: 1, b 2}", False), ("Java", "int x = 1;", False), ("Go", "package a\nx := 1\n", False), ("SQL", "SELECT a FROM", False), ("SQL", "UPDATE t SET a = 1 WHERE", False),
]


@pytest.mark.parametrize("lang,text,sound", CASES)
def test_cases(lang, text, sound):
    assert (V.error(lang, text) is None) == sound


def test_effects_combine_like_whole_files():
    rng = random.Random(9)
    for lang, text in (("java", JAVA), ("go", GO)):
        whole = L.effect(lang, text)
        assert L.balanced(whole)
        for _ in range(40):
            parts = L.chunks(text, rng.randint(5, 200))
            assert "".join(parts) == text
            effects = [L.effect(lang, p) for p in parts]
            k = rng.randint(0, len(effects))
            left, right = effects[:k], effects[k:]
            grouped = [reduce(L.combine, g) for g in (left, right) if g]
            assert reduce(L.combine, grouped) == reduce(L.combine, effects) and L.balanced(reduce(L.combine, effects))
        cut = text[: len(text) // 2]
        assert L.balanced(L.effect(lang, cut)) == L.balanced(reduce(L.combine, [L.effect(lang, p) for p in L.chunks(cut, 30)]))


def test_table(spark, monkeypatch):
    monkeypatch.setattr(V, "LARGE", 1500)
    rows = [(1, "x = (", "a", "b/c.py"), (2, None, "a", "d.py"), (3, "", "a", "d.py"), (4, "x = 1", "a", "D.PY"), (5, "x = (", "b", "noext"), (6, "{", None, ".\\x\\y.json"), (7, JAVA, "a", "A.java"), (8, JAVA[:-40], "a", "A.java"), (9, "x", "a", None), (1, "x = (", "a", "b/c.py")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, repository_name string, file_path string, language string")
    got = sorted((r.doc_id, r.language, r.broken) for r in V.checked(df).collect())
    assert got == [(1, "Python", True), (1, "Python", True), (4, "Python", False), (6, "JSON", True), (7, "Java", False), (8, "Java", True)]
    rates = {(r.repository_name, r.language): (r.n_files, r.n_broken, r.rate) for r in V.rates(df).collect()}
    assert rates["a", "Python"] == (3, 2, 0.666667) and rates["a", "Java"] == (2, 1, 0.5)
    assert V.checked(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,ok",
    [
        ("MERGE INTO t AS a USING (SELECT id, n FROM s WHERE n <> 0) b ON a.id = b.id AND a.n < b.n WHEN MATCHED AND b.n > a.n || '' THEN UPDATE SET n = b.n / 2, (x, y) = (1, 2) WHEN NOT MATCHED BY SOURCE THEN DELETE WHEN NOT MATCHED THEN INSERT (id, n) VALUES (b.id, b.n) RETURNING a.id;", True),
        ("WITH w AS (SELECT 1 AS id) MERGE INTO t USING w ON t.id = w.id WHEN MATCHED THEN DO NOTHING WHEN NOT MATCHED THEN INSERT DEFAULT VALUES;", True),
        ("MERGE INTO t USING s ON t.id = s.id WHEN MATCHED THEN", False),
        ("MERGE INTO t USING s ON t.id = s.id WHEN MATCHED THEN;", False),
        ("MERGE INTO t USING s ON t.id = s.id;", False),
        ("MERGE INTO t USING s ON t.id = WHEN MATCHED THEN DELETE;", False),
        ("MERGE INTO t USING s ON t.id = s.id WHEN NOT MATCHED THEN INSERT (id VALUES) (1);", False),
        ("PREPARE p (int, text) AS SELECT a FROM t WHERE b <> $1 AND c < $2; EXECUTE p(1 + 2, 'x' || 'y'); EXECUTE p; PREPARE TRANSACTION 'x';", True),
        ("PREPARE p AS SELEC a FROM t;", False),
        ("PREPARE p AS;", False),
        ("EXECUTE p(1, );", False),
        ("DECLARE c NO SCROLL CURSOR WITH HOLD FOR SELECT a FROM t WHERE b > 1 ORDER BY a;", True),
        ("DECLARE c CURSOR FOR SELECT FROM WHERE;", False),
        ("DECLARE c CURSOR FOR;", False),
        ("COPY (SELECT a FROM t WHERE b <> 1) TO '/x.csv' WITH (FORMAT csv, HEADER); COPY t (a, b) FROM '/x.csv' WITH (FORMAT csv) WHERE a > 1 AND b <> 2; COPY s.t TO STDOUT CSV HEADER DELIMITER ',';", True),
        ("COPY (SELEC a FROM t) TO '/x.csv';", False),
        ("COPY t (a, b);", False),
        ("COPY t FROM;", False),
        ("IMPORT FOREIGN SCHEMA a LIMIT TO (b, c) FROM SERVER d INTO e; REASSIGN OWNED BY a, b TO c;", True),
        ("IMPORT FOREIGN SCHEMA a FROM SERVER;", False),
        ("REASSIGN OWNED BY a;", False),
    ],
)
def test_sql_statements_with_queries_inside(text, ok):
    assert (V.error("SQL", text) is None) == ok


BY_NAME = {"JavaScript": "javascript", "TypeScript": "javascript", "Java": "java", "Go": "go", "SQL": "sql"}


@pytest.mark.parametrize("lang,text", [v for v in VALID if v[0] in BY_NAME])
def test_chunks_of_any_size_give_the_same_tokens(lang, text):
    name = BY_NAME[lang]
    text = text + {"java": 'class Z { String t = """\n a ) \n b\n """; /* x\n ( \n*/ }\n', "go": "var z = `\n ( \n{`\n/* a\n(\n*/\n", "sql": "SELECT 'a\n(\n''b', E'\\'\n(', $x$\n(\n$x$, \"q\n(\" /* /* \n( */ \n*/;\n", "javascript": "let z = `\n ( ${ a ? `\n{${b}\n` : { c }\n} \n`; /* \n( */\n"}[name]
    whole = L.read(name, text, len(text))
    for size in (1, 7, 60, 333):
        cut = L.read(name, text, size)
        assert (cut.kind, cut.match, cut.broke) == (whole.kind, whole.match, whole.broke)
        assert [t for k, t in zip(cut.kind, cut.text) if k != L.STRING and t[:1] != '"'] == [t for k, t in zip(whole.kind, whole.text) if k != L.STRING and t[:1] != '"']
        assert V.error(lang, text) is None
    if name in L.STATES:
        for size in (1, 40):
            parts = L.chunks(text, size)
            assert len(parts) > 3 and L.balanced(reduce(L.combine, [L.effect(name, p) for p in parts]))
            assert not L.balanced(reduce(L.combine, [L.effect(name, p) for p in L.chunks(text + "\n)\n", size)]))


@pytest.mark.parametrize("lang,text", [("Java", "class A { void f() { g(1; } }"), ("Go", "package a\n\nfunc f() {\n\tg(1\n}\n"), ("SQL", "SELECT (1;"), ("JavaScript", "f(1;"), ("TypeScript", "f({ a: 1 ;")])
def test_the_reduction_of_chunks_tells_what_is_unbalanced(lang, text, monkeypatch):
    assert V.error(lang, text) == "brackets" or V.error(lang, text).startswith("unmatched")
    for lang, text in VALID:
        if lang in BY_NAME:
            monkeypatch.setattr(L, "balanced_summary", lambda s: False)
            assert V.error(lang, text) == "brackets"


def test_deep_nesting_is_parsed_and_judged():
    n = 3000
    assert V.error("JSON", "[" * n + "]" * n) is None and V.error("JSON", "[" * n + "]" * (n - 1)) and V.error("JSON", '{"a":' * n + "1" + "}" * n) is None
    assert V.error("JSON", "[" * n + "1,]" + "]" * n) and V.error("JSON", '{"a":' * n + "}" * n)
    for lang, ok in (("JavaScript", "x = " + "(" * n + "1" + ")" * n), ("Go", "package a\n\nvar x = " + "(" * n + "1" + ")" * n + "\n"), ("SQL", "SELECT " + "(" * n + "1" + ")" * n + ";")):
        assert V.error(lang, ok) is None, lang
        assert V.error(lang, ok.replace("1", "1 +")), lang
    assert V.error("TOML", "a = " + "[" * n + "]" * n) is None and V.error("TOML", "a = " + "[" * n + ",]" + "]" * n)
    assert V.error("Python", "x = " + "(" * n + "1" + ")" * n)


def test_large_files_with_one_id(spark, monkeypatch):
    monkeypatch.setattr(V, "LARGE", 500)
    df = spark.createDataFrame([(1, JAVA, "a", "A.java"), (1, JAVA[:-3], "a", "A.java"), (1, GO, "a", "a.go"), (2, SQL, "a", "a.sql"), (2, SQL, "a", "a.sql"), (3, SQL + "SELECT (1;", "a", "a.sql")], "doc_id long, text string, repository_name string, file_path string")
    assert sorted((r.doc_id, r.language, r.broken) for r in V.checked(df).collect()) == [(1, "Go", False), (1, "Java", False), (1, "Java", True), (2, "SQL", False), (2, "SQL", False), (3, "SQL", True)]


def test_yaml_without_its_parser_is_no_verdict(monkeypatch):
    monkeypatch.setattr(V, "yaml", None)
    for text in ("a: [1\n", "a: 1\n"):
        with pytest.raises(RuntimeError, match="PyYAML"):
            V.error("YAML", text)
    assert V.error("JSON", "{}") is None


def test_deep_yaml_is_read_in_full():
    import subprocess
    import sys

    asked = "from strataloom.llm.validity import error as e; n = {0}; print([e('YAML', t) is None for t in ('[' * n + ']' * n, '[' * n, '[' * n + '*x' + ']' * n, '- &x 1\\n- ' + '[' * n + '*x' + ']' * n)])"
    for n in (3000, 20_000):  # a process of its own: the parser ended it
        out = subprocess.run([sys.executable, "-c", asked.format(n)], capture_output=True, text=True, cwd=Path(V.__file__).parents[2])
        assert out.stdout.strip() == "[True, False, False, True]"


@pytest.mark.parametrize("text", ["a: &x 1\nb: *x\n", "a: &x 1\n---\nb: *x\n", "a: *x\n", "a: &x [*x]\n", "&x a: &x 1\n", "a: b: c\n", "a: 1\na: 2\n", "", "# none\n", "--- a\n...\n--- b\n", "!!python/x a\n", "!y!z a\n", "a: \x01\n", "? a\n: b\n", "%YAML 3.0\n--- a\n", "- *x\n- &x 1\n"])
def test_yaml_events_tell_what_composing_does(text):
    import yaml

    try:
        list(yaml.compose_all(text, Loader=yaml.CSafeLoader))
        valid = True
    except yaml.YAMLError:
        valid = False
    assert (V.error("YAML", text) is None) == valid
