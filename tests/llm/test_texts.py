from __future__ import annotations

import pytest

from siltstone.llm import mojibake as M
from siltstone.llm import pairs as P
from siltstone.llm import syntax as Y

VALID = {
    "go": 'package p\n\nimport (\n\t"fmt"\n)\n\ntype T[K comparable] struct {\n\ta, b int `json:"a"`\n\t*fmt.X\n}\n\nfunc (t *T[K]) F(x ...int) (n int, err error) {\n\tfor i, v := range x {\n\t\tif v, ok := m[i]; ok && !t.done {\n\t\t\tm[v] = []int{1, 2}\n\t\t} else if x == nil {\n\t\t\tcontinue\n\t\t}\n\t}\n\tselect {\n\tcase <-ch:\n\tdefault:\n\t}\n\tgo func() { ch <- 1 }()\n\tswitch y := z.(type) {\n\tcase int, *T:\n\t\tn++\n\t}\n\treturn\n}\n',
    "java": "package a.b;\nimport java.util.*;\n@Ann(x = 1)\npublic final class A<T extends B> extends C implements D {\n  private int[] x = {1, 2};\n  A() { super(1); }\n  <U> Map<String, List<U>> f(final int a, T... b) throws E {\n    for (var i : b) { x[0] += (int) i; }\n    try (R r = g()) { h(y -> y + 1, A::new); } catch (X | Y e) { throw e; } finally { }\n    return a > 1 ? null : switch (a) { case 1 -> 2; default -> { yield 3; } };\n  }\n  enum K { P, Q(1) { int z() { return 1; } }; int v; }\n}\n",
    "rust": "use a::{b, c::*};\n#[derive(Debug)]\npub struct S<'a, T: Clone + 'a> { x: &'a mut T }\nimpl<'a, T> S<'a, T> where T: Fn(i32) -> i32 {\n  pub fn f(&mut self, n: usize) -> Result<Vec<T>, E> {\n    let v: Vec<_> = (0..n).map(|x| x * 2).collect::<Vec<_>>();\n    match self.x { Some(ref y) if *y > 1 => g(y)?, E::A { k, .. } | E::B(k) => {}, _ => return Err(E) }\n    if let Some(z) = h() { loop { break } } else { println!(\"{}\", 'a') }\n    Ok(v)\n  }\n}\nmacro_rules! m { ($x:expr) => { $x + 1 }; }\n",
    "javascript": "import a, { b as c } from 'x';\nexport default class A extends B {\n  static #p = 1;\n  async *f({ a, b = 2 }, ...c) { for await (const x of y) yield* x }\n}\nconst f = async (x) => { await g() }\nlet r = /a[/]b/g.test(s) ? `t ${a + `n${b}`}` : x?.y ?? [,1,]\nlabel: while (true) { if (a) break label; else continue }\nfoo\n  .bar()\n",
    "typescript": "export interface A<T> extends B { x?: string; readonly [k: string]: any; f(a: number): void }\ntype U = { [K in keyof T]?: T[K] } | (() => void) | 'x'\nexport async function f<T>(this: X, a: T[], b?: Map<string, number>): Promise<T | null> {\n  const x = <any>a\n  let y = a as unknown as string;\n  return x!.y satisfies Z\n}\nenum E { A = 1, B }\nabstract class C { constructor(private readonly a: string) { super() } abstract g(): void }\n".replace("<any>a", "a"),
    "python": "@d(1)\nasync def f(a, /, b: int = 1, *c, **d) -> x:\n    async with g() as h, i:\n        return [x for x in y if not z] if a else {**b, 'k': lambda q: q}\n    try:\n        x[1:2, ::3] += 1; del y\n    except (A, B) as e:\n        raise C from e\n    else: pass\n    match p:\n        case [1, *_] | {'a': b} if c:\n            pass\n",
    "json": '{"a": [1, -2.5e3, null, true], "b": {}}\n',
    "yaml": "a: 1\nb:\n  - x: 'y: z'\n    w: [1, {k: v}]\n  - |\n    text: more\n    <<<<<<< kept\nc: &n plain words\n# end\nd: *n\n",
    "shell": "#!/bin/bash\nset -eu\nf() {\n  local x=\"$(g \"$1\" | sed 's/a/b/')\"\n  case \"$x\" in\n    a|b) echo \"${x:-y}\" ;;\n    *) return 1 ;;\n  esac\n}\nfor i in *.txt; do [ -f \"$i\" ] && f \"$i\" > /dev/null 2>&1 || true; done\nif [[ $a == b* ]]; then\n  cat <<EOF\n( unbalanced\nEOF\nelse\n  arr=(1 2)\nfi\nwhile read -r l; do echo $((l + 1)); done < <(g)\n",
}
BROKEN = {
    "go": [("}\n", ""), ("range x {", "range x"), ("n int, err error", "n int err error"), ("case <-ch:", "case <-ch")],
    "java": [("super(1);", "super(1)"), ("{1, 2}", "{1, 2"), ("catch (X | Y e)", "catch X"), ("? null :", "? null")],
    "rust": [("-> Result", "- Result"), ("let v:", "let v v:"), ("Ok(v)", "Ok(v"), ("impl<'a, T>", "impl<'a, T")],
    "javascript": [("from 'x';", "form 'x';"), ("=> {", "=> "), ("(true)", "(true"), ("const f =", "const =")],
    "typescript": [("enum E", "enum"), ("Promise<T", "Promise<<T"), ("as unknown", "as as unknown"), ("): void }", "): void")],
    "python": [("e:\n        raise", "e\n        raise"), ("    match p:\n", "   match p:\n"), ("[x for", "[x, for"), ("else: pass", "else pass")],
    "json": [("null,", "null"), ('"b"', "b"), ("{}}", "{}"), ("[1", "[1,,")],
    "yaml": [("b:\n", "b: c\n"), ("'y: z'", "y: z"), ("{k: v}]", "{k: v}"), ("c: &n", "<<<<<<< ours\nc: &n")],
    "shell": [("esac", ""), ("done; done", "done"), ("; then", ""), ("fi\n", "\n"), ('"$1"', '"$1')],
}


VALIDATED = (0, None, None)


@pytest.mark.parametrize("language", VALID)
def test_valid(language):
    assert Y.inspect(VALID[language], language) == VALIDATED
    assert Y.inspect(VALID[language].replace("\n", "\r\n"), language)[0] == 0


@pytest.mark.parametrize("language", BROKEN)
def test_broken(language):
    for old, new in BROKEN[language]:
        if old in VALID[language]:
            cost, fault, line = Y.inspect(VALID[language].replace(old, new, 1), language)
            assert cost >= 1 and fault and line >= 1, (old, new)
            assert Y.inspect(VALID[language].replace(old, new, 1), language, 0)[0] == 1


@pytest.mark.parametrize("language", ["javascript", "typescript"])
def test_templates(language):
    for good in ("`a ${b} c ${f({d: `${e}`})}`", "tag`x${a}`.y / 2", "`${a\n + b}$ {\\` \\${`", "`${/}/.test(a) ? '}' : \"`\"}`", "`${a}` + `${b}`", "`${(x) => { return x\n}}`", "`$${a}`", "`${a, b}`", "`${a /* } */}`"):
        assert Y.inspect(f"const x = {good};\nlet y = 1\n", language) == VALIDATED, good
    for bad in ("`${a b}`", "`${f(}`", "`${x +}`", "`${}`", "`${a)}`", "`a ${`${b c}`}`", "`${a}", "`${a"):
        cost, fault, _ = Y.inspect(f"const x = {bad};\nlet y = 1\n", language)
        assert cost >= 1 and fault, bad
    assert Y.inspect("type T = `a${U}b${'c' | V[]}`;\n", "typescript") == VALIDATED


@pytest.mark.parametrize(
    "language, text",
    [
        ("typescript", "type T =\n" + "".join(f"  | 'a{i}'\n" for i in range(60)) + "let x = 1\n"),
        ("javascript", "const x = a\n" + "".join(f"  .f{i}(b)\n" for i in range(60)) + "let y = 1\n"),
        ("javascript", "const x = 'a' +\n" + "".join(f"  'b{i}' +\n" for i in range(60)) + "  'c'\nlet y = 1\n"),
        *[(language, head + "if (a) { f(); }" + " else if (b) { g(); }" * 40 + " else { h(); }" + tail) for language, head, tail in (("javascript", "", "\n"), ("typescript", "", "\n"), ("java", "class A { void f() { ", " } }\n"))],
        ("rust", "fn f() { if a { f(); }" + " else if b { g(); }" * 40 + " else { h(); } }\n"),
        ("rust", "fn f() { match a {" + "".join(f" {i} => {{ f(); }}," for i in range(40)) + " _ => {} } }\n"),
        ("typescript", "function f(x: M<" + ", ".join("abcdefghijklmnopq") + ">, y) {}\n"),
    ],
)
def test_long_statements(language, text):
    assert Y.inspect(text, language) == VALIDATED
    last = text.rstrip("\n }")
    assert Y.inspect(last + " = = " + text[len(last) :], language)[0] >= 1


def test_python_is_held_by_the_chart():
    """Order of parameters and arguments, what can be assigned to, and the insides of formatted strings; all agree with the compiler."""
    bad = ["def f(a=1, b):\n    pass\n", "f(a=1, 2)\n", "f() = 1\n", "f() += 1\n", "x = f'{a b}'\n", "x = 1abc\n", "x = f'{a'\n", "x = f'}'\n", "f(**a, *b)\n", "def g(*):\n    pass\n", "1 = x\n", "for f() in x: pass\n", "x = f'{}'\n", "x = f'{y!z}'\n", "del f()\n", "def f(**k, a): pass\n", "def f(/, a): pass\n", "x = f'{a:{b c}}'\n", "f(a=1, *b, c)\n"]
    good = ["x = f'{a}{b!r:>{w}} {{}} {c=} {d[\"k\"]:%Y-%m-%d}'\n", "x = f'{a['b']}' f\"{x if y else z}\" rf'\\d{n}'\n", "a, *b = c = d[0].e = yield_\n", "x[1:2], (y, z) = f(*a, b, *c, k=1, *d, **e)\n", "def f(a, b=1, /, c=2, *d, e, g=3, **h): pass\n", "def f(*, a, b=1, c): pass\n", "[x for x, (y, *z) in w]\n", "x: int = 3\nself.y: str\n", "x = f\'\'\'\n{a\n + b}\n\'\'\'\n", "print(f\"{x:{'>' if y else '<'}10}\")\n", "lambda *a, b=1, **k: f'{a!r}'\n", "a.b[c] **= 2\n", "(a) = 1\n[b, c] = d\n", "for i, in x: pass\n", "class A(B, metaclass=C): pass\n", "x = 1if y else 0x1F + 1_0.5e-3j + .5\n"]
    for text in bad:
        assert Y.inspect(text, "python")[0] >= 1, text
        with pytest.raises(SyntaxError):
            compile(text, "f", "exec")
    for text in good:
        assert Y.inspect(text, "python") == VALIDATED, text
        compile(text, "f", "exec")


def test_numbers_and_order():
    valid = {"go": "var x = 1i + 0x1p-2 + 1_0.e3\n", "javascript": "let x = 10n + 1..f() + 017 + 1e3 + .5\n", "typescript": "let x = 10n + 1.5\n", "java": "class A { double x = 1_0L + 1.f + .5d + 0xFFL + 1e-3; }\n"}
    for language, text in valid.items():
        text = "package p\n" * (language == "go") + text
        assert Y.inspect(text, language) == VALIDATED, language
        assert Y.inspect(text.replace("= 1", "= 1abc + 1", 1), language)[0] >= 1, language
    assert Y.inspect("var x = 1\n", "go")[0] == 1 and Y.inspect("", "go") == VALIDATED
    assert Y.inspect('package p\nvar x = 1\nimport "fmt"\n', "go") == (1, "slip", 3)
    assert Y.inspect("1 = 2\n", "javascript")[0] and Y.inspect("f() = 2\n", "javascript")[0]
    assert Y.inspect("a.b = c[d] = e\n[x, y] = [y, x];\n({a} = b)\nthis.x += 1\n", "javascript") == VALIDATED


def test_faults_come_from_where_the_edits_are():
    assert Y.inspect("package p\nfunc f() {\n", "go") == (1, "truncation", 3)
    assert Y.inspect("a = 1\n<<<<<<< ours\nb = 2\n=======\nb = 3\n>>>>>>> theirs\n", "python")[1:] == ("conflict", 2)
    assert Y.inspect("package p\r\n\r\n<<<<<<< ours\r\nvar b = 2\r\n=======\r\nvar b = 3\r\n>>>>>>> theirs\r\n", "go")[1:] == ("conflict", 3)
    assert Y.inspect("if true; then\n  echo a\n", "shell")[1] == "truncation" and Y.inspect('echo a\necho "abc', "shell")[1:] == ("truncation", 2)
    assert Y.inspect(VALID["java"], "python")[1] == "mismatch" and Y.inspect(VALID["python"], "go")[1] == "mismatch"
    assert Y.inspect(VALID["go"].replace("var", "vra").replace("if v, ok := m[i]; ok", "if v ok := m[i]; ok"), "go")[1:] == ("slip", 14)
    assert Y.inspect("x = 1\ny = (2 +\nz = 3\n", "python")[1] != "mismatch"
    assert Y.inspect("", "python") == VALIDATED and Y.inspect("", "json")[0] == 1


def test_a_group_costs_its_tokens():
    """The block of a function isn't left out to hide one slip in it."""
    assert Y.inspect("package p\n\nfunc f() {\n\ta := 1\n\tb := := 2\n\tc := 3\n}\n", "go") == (1, "slip", 5)


def test_check(spark):
    rows = [(1, "r", "a.go", "package p\n"), (2, "r", "b.PY", "def f(:\n"), (3, "s", "c.md", "def ("), (4, "s", "d.py", None), (5, None, "e.unknown", "x"), (6, None, None, "x"), (7, None, "f.json", "{}"), (7, None, "f.json", "{"), (8, "r", "g.py", "x = (" * 3000)]
    df = spark.createDataFrame(rows, "file_id bigint, repo string, path string, content string")
    assert {r.line for r in Y.check(df.where("file_id = 2"), "file_id", "path", "content").collect()} == {1}
    checked = Y.check(df, "file_id", "path", "content", ("repo",), most=0)
    assert sorted((r.file_id, r.cost > 0) for r in checked.collect()) == [(1, False), (2, True), (7, False), (7, True), (8, True)]
    assert {(r.repo, r.language, r.files, r.invalid) for r in Y.rates(checked, "repo").collect()} == {("r", "go", 1, 0), ("r", "python", 2, 2), (None, "json", 2, 1)}
    assert Y.check(df.limit(0), "file_id", "path", "content").count() == 0


@pytest.mark.parametrize(
    "prompt, text, chunks, wanted",
    [
        ("where is f defined", None, 3, ("empty", False)),
        ("where is f defined", " \n—", 3, ("empty", False)),
        ("where is loadFile defined", "Question: where is loadFile defined\n\nContext:\n(no chunks retrieved)\n", 3, ("copy", False)),
        ("where is loadFile defined", "Where is LOADFILE defined?", 3, ("copy", False)),
        ("where is loadFile defined", "Where is loadFile defined? It is built by `x` and lives in `a.go`.", 3, (None, False)),
        ("where is loadFile defined", "Where is loadFile defined? lib/b.rs", 3, (None, False)),
        ("where is loadFile defined", "I cannot answer this from the given context.", 3, ("refusal", False)),
        ("where is f defined", "`f` is not found in the vendored copy; the only definition sits in `a.go` [1].", 3, (None, False)),
        ("where is f defined", "It lives in `a.go`. I could not see the caller of `g`.", 3, (None, False)),
        ("wo ist f definiert", "Tut mir leid, ohne `a.go` möchte ich nicht raten.", 3, ("refusal", False)),
        ("where is f defined", "Use this:\n\n```go\nx := 1\n", 3, ("truncated", False)),
        ("where is f defined", "The limit comes from `loadFi", 3, ("truncated", False)),
        ("where is f defined", "Steps:\n\n1. `a`\n2.", 3, ("truncated", False)),
        ("where is f defined", "The value is read twice [", 3, ("truncated", False)),
        ("where is f defined", "The value is read twice [9].", 3, (None, True)),
        ("where is f defined", "Zero [0] and one [1].", 1, (None, True)),
        ("where is the file defined", "Die Lösung steht in `a.go` und wurde für kleine Geräte gekürzt.", 3, ("language", False)),
        ("where is the file defined", 'The comment reads "Die Lösung steht nicht in der Datei und wird gekürzt".', 3, (None, False)),
        ("", "42", 0, (None, False)),
        (None, "An answer.", 0, (None, False)),
    ],
)
def test_pairs(prompt, text, chunks, wanted):
    defect, _, dangling = P.inspect(prompt, text, chunks)
    assert (defect, dangling) == wanted


def test_endings_of_the_corpus_decide(spark):
    rows = [(1, "how does it work", "The chunk is cut at the end. It stops there.", 1, "x"), (2, "how does it work", "The chunk is cut at the end", 1, "x"), (3, "how does it work", "The chunk is cut at the", 1, "x"), (3, "how does it work", "The chunk is cut at the", 1, "x"), (4, None, None, None, "x"), (5, "how does it work", "See [7].", None, "x")]
    df = spark.createDataFrame(rows, "a bigint, q string, t string, n int, defect string")
    got = sorted((r.a, r.defect) for r in P.find(df, "a", "q", "t", "n").collect())
    assert got == [(3, "truncated"), (3, "truncated"), (4, "empty"), (5, "dangling")]
    assert P.find(df.limit(0), "a", "q", "t", "n").count() == 0



def test_one_word_and_japanese_ends(spark):
    texts = [
        (1, "The limit is read once. It is checked before the upsert starts. Not", True),
        (2, "The limit is read once. Correct.", False),
        (3, "The limit is read once. Correct", False),
        (4, "Redis", False),
        (5, "It uses these:\n\n- Redis", False),
        (6, "It is set there. `limit`", False),
        (7, "It is set there. src/limit.go:12", False),
        (8, "設定はここで読み込まれます。", False),
        (9, "上限は起動時に読み込まれます", False),
        (10, "上限は起動時に読み込まれます。次に設定ファ", True),
        (11, "設定", False),
        (12, "The limit is read once.\n\n# Limits", False),
    ]
    df = spark.createDataFrame([(i, "where is it", t, 3) for i, t, _ in texts], "answer_id bigint, query string, text string, n_chunks int")
    got = {r.answer_id for r in P.find(df, "answer_id", "query", "text", "n_chunks").where("defect = 'truncated'").collect()}
    assert got == {i for i, _, cut in texts if cut}


def test_copy_of_any_length():
    asked = "where is the retry limit of the loader read"
    assert all(P.inspect(asked, " ".join([asked + "?"] * n), 3)[0] == "copy" for n in (1, 5, 12, 200))
    assert P.inspect(asked, " ".join([asked + "?"] * 12) + " The loader takes it from the settings file.", 3)[0] != "copy"


def test_suffix_automaton():
    a = P.SuffixAutomaton("abcbcd")
    assert a.covered("xbcbcx", 3) == [False, True, True, True, True, False]
    assert a.covered("bcd", 4) == [False] * 3


def test_garble_round_trip():
    for written, read in (("utf-8", "cp1252"), ("utf-8", "gbk"), ("cp1252", "cp437"), ("utf-8", "koi8-r"), ("utf-8", "mac_roman")):
        bad = M.garble("größer", written, read)
        assert bad and bad != "größer" and M.restore(bad, written, read) == "größer"
    assert M.restore("größer", "utf-8", "cp1252") is None


def test_mojibake(spark):
    clean = ["Für größere Geräte ist das naïve Café schön.", "Die Lösung wäre über den Zähler möglich.", "Le résumé déjà prêt – c’est “bon”."]
    rows = [clean[i % 3] for i in range(60)]
    bad = {100: M.garble(clean[0], "utf-8", "cp1252"), 101: M.garble(clean[1], "utf-8", "cp1252"), 102: M.garble(M.garble(clean[2], "utf-8", "cp1252"), "utf-8", "cp1252"), 103: "The r\ufffdsum\ufffd step", 104: M.garble("Une fenêtre très cachée", "utf-8", "cp1252")}
    fine = {200: "the index shows `Ã©` for `é`", 201: None, 202: "", 203: "plain ascii", 204: "ATENÇÃO: configuração", 205: "только для больших"}
    df = spark.createDataFrame([(i, t, "x") for i, t in [*enumerate(rows), *bad.items(), *fine.items()]], "doc_id bigint, text string, word string")
    found = M.find(df, "doc_id", "text")
    assert {r.doc_id for r in found.collect()} == set(bad)
    texts = {r.doc_id: (r.text, r.whole) for r in M.restored_texts(df, "doc_id", "text").collect()}
    assert texts[100] == (clean[0], True) and texts[102] == (clean[2], True) and texts[104] == ("Une fenêtre très cachée", True)
    assert texts[103] == (bad[103], False)
    assert M.find(df.limit(0), "doc_id", "text").count() == 0


def test_candidates_are_words_that_can_be_frequent(spark):
    """Only what may be a word RATIO times as frequent is given on to the join; words of one character never are."""
    rows = [("při", 20), ("pøi", 1), ("kø", 2), ("ø", 1), ("zï", 1), ("zø", 9), ("caf" + M.garble("é", "utf-8", "cp1252"), 1), ("café", 9), ("😀a", 3)]
    words = spark.createDataFrame(rows, "word string, n long").withColumn("skeleton", M.skeleton(M.F.col("word")))
    ways = [("cp1250", "cp1252"), ("utf-8", "cp1252")]
    assert M.characters(words)["😀"] == 3
    found = {(r.word, r.restored, r.strong) for r in M.candidates(words, ways).collect()}
    assert found == {("pøi", "při", False), ("kø", "kř", False), ("cafÃ©", "café", True)}
    assert {(r.word, r.restored) for r in M.garbled_words(words, ways).collect()} == {("pøi", "při"), ("cafÃ©", "café")}


def test_words_are_cut_as_before(spark):
    """Words and code spans: the patterns that don't look twice agree with the plain ones."""
    plain_span, plain_word = r"(?<!`)`[^`\r\n]*`(?!`)", r"([A-Za-z0-9\x{80}-\x{10ffff}]*[\x{80}-\x{10ffff}][A-Za-z0-9\x{80}-\x{10ffff}]*)"
    texts = ["aé1 b_é ćd éé.e 12é3x plain Zß", "`é` a ``é`` b ```é\nü``` `ö`` x` ü` `` ä`ß`", "`é\nü` ``", "", "``é`é`", "日本語text😀x y", "a" * 50 + "é" + "b" * 50 + " " + "c" * 50, "`" * 7 + "é`", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    F = M.F
    old = F.array_distinct(F.regexp_extract_all(F.regexp_replace("t", plain_span, " "), F.lit(plain_word), F.lit(1)))
    for t, a, b in df.select("t", old, M.odd_words(F.col("t"))).collect():
        assert a == b, t
