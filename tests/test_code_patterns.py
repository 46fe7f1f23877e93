import pytest

from sparkward.operators.code_patterns import PATTERNS, code_pattern_findings
from sparkward.sources.files import from_table

KEY = "sk-" + "a1B2" * 6
CASES = [
    ("a.py", "os.system('ls ' + name)", {"py-os-system-concat-approx"}), ("a.py", "os.system('ls')", set()), ("a.py", "subprocess.run(x, shell=True)", {"py-subprocess-shell-true-approx"}),
    ("a.py", "subprocess.run(x, shell=False)", set()), ("a.py", "y = eval(x)", {"py-eval-exec-approx"}), ("a.py", 'eval("1")', set()), ("a.py", "model.eval()", set()), ("a.py", "yaml.load(f)", {"py-yaml-load-unsafe-approx"}),
    ("a.py", "yaml.load(f, Loader=SafeLoader)", set()), ("a.py", "pickle.load(f)", {"py-pickle-loads-approx"}), ("a.py", "requests.get(u, verify=False)", {"py-requests-verify-false-approx"}),
    ("a.py", "app.run(debug=True)", {"py-flask-debug-true-approx"}), ("a.py", 'c.execute(f"select {x}")', {"py-sql-fstring-approx"}), ("a.py", 'c.execute("select " + x)', {"py-sql-fstring-approx"}), ("a.py", 'c.execute("select ?", x)', set()),
    ("a.py", "hashlib.md5(b)", {"py-weak-hash-approx"}), ("a.js", "exec(a + b)", {"js-child-process-exec-concat-approx"}), ("a.js", "exec('ls')", set()), ("a.ts", "new Function(x)", {"js-eval-approx"}),
    ("a.js", "e.innerHTML = x", {"js-innerhtml-approx"}), ("a.js", "e.innerHTML = 'x';", set()), ("a.py", "exec(response.text)", {"py-eval-exec-approx", "ai-llm-output-to-shell-approx"}),
    ("a.py", f'prompt = "use {KEY}"', {"ai-hardcoded-system-prompt-secret"}), ("a.txt", "os.system(x)", set()), ("a.js", "os.system(x)", set()), ("a.py", "", set()),
]


def test_every_pattern_on_its_line_alone(spark):
    rows = spark.createDataFrame([(f"{i}/{path}", line) for i, (path, line, _) in enumerate(CASES)], "p string, t string")
    got = {}
    for r in code_pattern_findings(from_table(rows, rows.p, rows.t)).collect():
        got.setdefault(int(r.file.split("/")[0]), set()).add(r.rule_id)
    assert {i: got.get(i, set()) for i in range(len(CASES))} == {i: want for i, (_, _, want) in enumerate(CASES)}
    assert {r for _, _, want in CASES for r in want} == {p.rule_id for p in PATTERNS}


@pytest.mark.parametrize("text", [None, "", "x" * 7000 + " os.system(x)"])
def test_no_pattern_in_nothing_and_in_overlong_lines(spark, text):
    rows = spark.createDataFrame([("a.py", text)], "p string, t string")
    assert code_pattern_findings(from_table(rows, rows.p, rows.t)).count() == 0
