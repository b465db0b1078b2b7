import random
import re
from collections import Counter
from itertools import combinations

from siftwarden.operators import clones, code
from siftwarden.operators.risk import findings_union

GO = """package main
import "os/exec"
// exec.Command("ls")
func run(cmd string) {
\tpassword := "secret123"
\texec.Command("sh", "-c", cmd)
\tif a && b || c { for {} }
\tswitch x { case 1: }
\t// TODO: check
}
"""
RUST = """use std::fs;
// x.unwrap() in a comment if for
fn main(a: i32, b: i32, c: i32) {
    let v = data.unwrap();
    unsafe { do_it(); }
    if v > 0 { match v { _ => {} } }
    while x || y { z.expect("no") } // FIXME
    fn empty() {}
}
"""
JS = "function f() {\n  console.log('x');\n  eval(code);\n  fetch('http://localhost:80');\n  // localhost\n}\n"


def files(spark, **texts):
    return spark.createDataFrame([(k.replace("_", "."), v) for k, v in texts.items()], "id string, text string")


def lints(df):
    return sorted((r.rule, r.line) for r in df.collect())


def test_lints(spark):
    assert lints(code.lint_go(files(spark, a_go=GO))) == [("command-injection", 6), ("hardcoded-credentials", 5)]
    assert lints(code.lint_rust(files(spark, a_rs=RUST))) == [("panic-possible", 4), ("panic-possible", 7), ("unsafe-code", 5)]
    assert lints(code.lint_common(files(spark, a_js=JS))) == [("dangerous-execution", 3), ("debug-artifact", 2), ("hardcoded-host", 4)]
    both = code.lint_by_language(files(spark, a_go=GO, b_rs=RUST, c_js=JS))
    assert both.count() == 8
    assert findings_union(both, code.flow_issues(files(spark, a_go=GO))).count() >= 8


def test_lines_of_both_endings(spark):
    df = files(spark, a_js="eval(\r\n\r\neval(\r\n", b_js="eval(", c_js="")
    assert lints(code.lint_common(df)) == [("dangerous-execution", 1), ("dangerous-execution", 1), ("dangerous-execution", 3)]
    loc = {r.id: r.loc for r in code.code_complexity(df, "'go'").collect()}
    assert loc == {"a.js": 3, "b.js": 1, "c.js": 0}


def brute_complexity(text, language):
    total = 0
    for line in text.splitlines():
        t = line.strip()
        if language == "rust" and t.startswith(("//", "/*", "*/")):
            continue
        total += sum(line.count(w) for w in code.BRANCH_WORDS[language])
    return total


def test_complexity(spark):
    rows = {r.id: r for r in code.code_complexity(files(spark, a_go=GO, b_rs=RUST, c_js=JS)).collect()}
    assert rows["a.go"].cyclomatic == brute_complexity(GO, "go") and rows["a.go"].has_todo and rows["a.go"].loc == 10
    assert rows["b.rs"].cyclomatic == brute_complexity(RUST, "rust") >= 4
    assert rows["b.rs"].param_count == 3 and rows["b.rs"].has_todo
    assert (rows["c.js"].cyclomatic, rows["c.js"].loc, rows["c.js"].has_todo) == (0, 0, False)


def test_flow(spark):
    df = files(spark, a_c="int main() {\n\n// note\nif (x) {\nreturn 1;\n}\n", empty_c="")
    nodes = [(r.id, r.node_id, r.kind, r.line) for r in code.flow_nodes(df).orderBy("id", "node_id").collect()]
    assert nodes == [("a.c", 0, "entry", 1), ("a.c", 1, "statement", 1), ("a.c", 2, "conditional", 4), ("a.c", 3, "return", 5),
                     ("a.c", 4, "statement", 6), ("a.c", 5, "exit", 6), ("empty.c", 0, "entry", 1), ("empty.c", 1, "exit", 0)]
    edges = {(r.id, r.src, r.dst) for r in code.flow_edges(df).collect()}
    assert edges == {("a.c", i, i + 1) for i in range(5)}
    assert [r.id for r in code.unreachable(df).collect()] == ["empty.c"]


def brute_resources(text):
    stack, out = [], []
    for n, line in enumerate(text.splitlines(), 1):
        for name, opens, closes in (("file", code.OPEN_FILE, code.CLOSE_FILE), ("mutex", code.OPEN_LOCK, code.CLOSE_LOCK),
                                    ("transaction", code.OPEN_WORK, code.CLOSE_WORK)):
            if any(w in line for w in opens):
                stack.append((name, n))
            elif any(w in line for w in closes) and stack:
                out.append((*stack.pop(), n))
    return sorted([*out, *((*s, None) for s in stack)], key=str)


def test_resources(spark):
    rng = random.Random(5)
    words = ["f = fopen(x)", "fclose(f)", "m = Mutex::new()", "m.unlock()", "db.Begin()", "COMMIT", "x = 1", "open( close(", ""]
    texts = {f"f{i}": "\n".join(rng.choices(words, k=25)) for i in range(6)}
    rows = {}
    for r in code.resource_pairs(files(spark, **texts)).collect():
        rows.setdefault(r.id, []).append((r.name, r.acquire_line, r.release_line))
    for k, t in texts.items():
        assert sorted(rows.get(k, []), key=str) == brute_resources(t)


def test_leaks(spark):
    ok = 'void f() {\n FILE* f = fopen("x");\n fclose(f);\n}\n'
    df = files(spark, ok_c=ok, bad_go="tx := db.Begin()\nuse(tx)\n", lock_c="pthread_mutex_init(m)\n")
    assert {(r.id, r.rule, r.line) for r in code.flow_issues(df).collect()} == {
        ("bad.go", "transaction-not-ended", 1), ("lock.c", "lock-not-released", 1)}


def brute_tokens(text):
    pattern = r"[^\W\d]\w*|\d[\d.xA-Fa-f]*|" + clones._quoted('"', False).replace(r"\z", r"\Z") + "|" + clones._quoted(
        "'", False).replace(r"\z", r"\Z") + r"|\S"
    out = []
    for m in re.finditer(pattern, text):
        t = m.group()
        folded = t if t in clones.KEYWORDS else "ID" if re.match(r"[^\W\d]", t) else "NUM" if t[0].isdigit() else "STR" if t[0] in "\"'" else t
        out.append((folded, text.count("\n", 0, m.start()) + 1))
    return out


def brute_pairs(text):
    tokens = brute_tokens(text)
    blocks = [(i // 10, tokens[i][1], frozenset(t for t, _ in tokens[i:i + 20])) for i in range(0, len(tokens) - 20, 10)]
    out = Counter()
    for a, b in combinations(blocks, 2):
        s = len(a[2] & b[2]) / len(a[2] | b[2])
        if s >= 0.75:
            out[round(s, 9)] += 1
    return out, {(b[0], b[1]) for b in blocks}


def test_clones(spark):
    rng = random.Random(3)
    parts = ["let x = 1;", "fn go(a, b) { return a + b; }", "if (y == 'it\\'s') {", "}", "for i in 0..3 {", 'print("a b")', "call(x, 2.5)",
             "match z { _ => 0 }", "# note: 'open", "new Thing[7]", "import a.b as c"]
    texts = {f"f{i}": "\n".join(rng.choices(parts, k=30)) for i in range(5)}
    texts["short"] = "let x = 1;"
    rows = clones.clone_pairs(files(spark, **texts)).collect()
    for k, t in texts.items():
        want, blocks = brute_pairs(t)
        got = Counter()
        for r in rows:
            if r.id == k:
                got[round(r.similarity, 9)] += r.pairs
                assert {(b.block, b.line) for b in [*r.blocks1, *(r.blocks2 or [])]} <= blocks
        assert got == want, k
    assert clones.clone_pairs(files(spark, **texts), min_tokens=21).count() == 0
    strict = clones.clone_pairs(files(spark, **texts), min_similarity=0.9).collect()
    assert sorted(r.similarity for r in strict) == sorted(r.similarity for r in rows if r.similarity >= 0.9)


def test_lines_of_blocks_without_a_running_total(spark):
    rng = random.Random(8)
    parts = ["let", "x", "'a\nb'", '"q\n\n"', "\n", " ", "\r\n", "\t", "1.5", "'", '"', "\\", "{", "}", ";", "a_b", "if", "STR", "(", ")"]
    texts = {f"m{i}": " ".join(rng.choices(parts, k=rng.choice([5, 30, 300]))) for i in range(40)} | {"empty": "", "breaks": "\n" * 3000}
    rows = clones.blocks(files(spark, **texts))
    want = []
    for k, t in texts.items():
        tokens = brute_tokens(t)
        want += [(k, i // 10, tokens[i][1], tokens[i + 19][1], " ".join(x for x, _ in tokens[i:i + 20])) for i in range(0, len(tokens) - 20, 10)]
    assert sorted((r.id, r.block, r.line, r.end, r.normalized) for r in rows.collect()) == sorted(want)
    plan = clones.clone_pairs(files(spark, **texts))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan, "lines of tokens summed token by token"


def test_near_equal_functions(spark):
    body = "fn {n}(items: Vec<i32>) -> i32 {{ let mut total = 0; for item in items {{ if item > 0 {{ total = total + item; }} }} return total; }}\n"
    df = files(spark, a_rs=body.format(n="add") + body.format(n="sum"))
    rows = clones.clone_pairs(df).collect()
    assert max(r.similarity for r in rows) >= 0.75 and all(r.clone_type in (1, 2, 3) for r in rows)
    assert clones.clone_findings(clones.clone_pairs(df)).count() == len(rows)


def test_clones_across(spark):
    text = " ".join(f"a{i} = {i} ;" for i in range(20))
    df = files(spark, a=text, b=text.replace("a", "b"), c="x y z")
    groups = clones.clone_groups_across(df).collect()
    assert groups and all(r.files == 2 and r.first_id == "a" for r in groups)


def test_resource_pairs_are_those_of_a_stack(content):
    import random
    rng, texts = random.Random(6), []
    for n in (0, 1, 5, 40, 3000):
        texts.append("\n".join(rng.choice(["fopen(", "fclose(", "Mutex::new", "unlock(", "BEGIN", "COMMIT", "x"]) for _ in range(n)))
    want = []
    for i, t in enumerate(texts):
        stack = []
        for line, word in enumerate(t.split("\n"), 1):
            kind = {"fopen(": "file", "Mutex::new": "mutex", "BEGIN": "transaction"}.get(word)
            if kind:
                stack.append((kind, line))
            elif word in ("fclose(", "unlock(", "COMMIT") and stack:
                name, at = stack.pop()
                want.append((f"d{i}", name, at, line))
        want += [(f"d{i}", name, at, None) for name, at in stack]
    got = [tuple(r) for r in code.resource_pairs(content(*texts)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
