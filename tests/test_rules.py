"""Every line rule fires on one shape and stays quiet on a near miss."""

from __future__ import annotations

import pytest

from assayline.operators import scan
from assayline.operators.rules import BY_ID, RULES, select_rules

# rule, path, lines that are reported, lines that are not
CASES = [
    ("D1-001", "a.ts", ["await db.query(`SELECT x FROM t WHERE id = ${id}`);"],
     ["await db.query(`DROP TABLE ${name}`);", "query(`SELECT ${x}`)", "await db.query(`SELECT ${escapeSql(x)}`)",
      "await db.query(`SELECT x WHERE a = $1 AND b = ${c}`)", "sandbox.execute(`ls ${dir}`)", "await db.query('SELECT 1')"]),
    ("D1-002", "a.ts", ["await db.query('SELECT ' + x);"], ["await db.query('SELECT 1');", "await db.query('UPDATE t SET a = ?' + x)"]),
    ("D1-003", "a.js", ["execSync('ls ' + req.query.dir)"], ["execSync('ls ' + dir)", "NAME_RE.exec(req.url)", "pathRegex.exec(req.body.x)"]),
    ("D1-004", "a.tsx", ["<p dangerouslySetInnerHTML={{ __html: req.body.x }} />"], ["<p dangerouslySetInnerHTML={{ __html: safe }} />"]),
    ("D1-005", "a.js", ["find({ pw: { $gt: '' } })"], ["find({ n: { $gt: 1 } })"]),
    ("D1-006", "a.js", ["fs.readFile(params.file)"], ["fs.readFile(name)"]),
    ("D1-008", "a.js", ["Object.assign({}, req.body)"], ["Object.assign({}, defaults)"]),
    ("D3-001", "a.js", ["User.create(req.body)"], ["User.create(clean)"]),
    ("D9-002", "a.js", ["fetch(req.query.u)"], ["fetch('/x')"]),
    ("AI-002", "a.ts", ["const token = Math.random();"],
     ["const nonce = Date.now(); dispatch(nonce)", "const expiresAt = Date.now(); token = x;", "const n = Math.random();"]),
    ("AI-004", "a.ts", ["User.create({ ...req.body })"], ["User.create({ name })"]),
    ("AI-008", "a.ts", ["res.json({ e: err.stack })"], ["log(err.stack)"]),
    ("AI-009", "a.ts", ["opts = { rejectUnauthorized: false }"], ["opts = { rejectUnauthorized: true }"]),
    ("D5-003", "a.ts", ["eval(x)"], ["medieval(x)"]),
    ("D8-001", "a.ts", ["console.log(password)"], ["console.log('password changed')", "console.log(key)"]),
    ("API-001", "a.ts", ["app.post('/login', h)"], ["app.post('/items', h)", "app.get('/login', h)"]),
    ("API-002", "a.ts", ["express.json({ limit: '50mb' })", "x = { bodyLimit: 0 }"], ["express.json({ limit: '1mb' })"]),
    ("API-004", "a.ts", ["cors({ origin: true, credentials: true })"], ["cors({ origin: 'https://a', credentials: true })"]),
    ("AUTH-001", "a.ts", ["verify(t, k, { algorithms: ['none'] })"], ["verify(t, k, { algorithms: ['RS256'] })"]),
    ("AUTH-002", "a.ts", ["const claims = jwt.decode(t)"], ["const raw = jwt.decode(t)"]),
    ("AUTH-003", "a.ts", ["if (password === stored) ok()"], ["if (url.password === '') ok()"]),
    ("AUTH-006", "a.ts", ["app.use(session({ secret: 'keyboard cat' }))"], ["app.use(session({ secret: process.env.S }))"]),
    ("D4-001", "a.txt", ["password = hunter22"], ["étoken valeur", "word"]),
    ("D4-002", "a.txt", ["blob Zx8Kq2Lm9Wp4Rt7Yv3Nb6Hs1"], ["aaaaaaaaaaaaaaaaaaaaaaaaa1"]),
]


@pytest.fixture(scope="module")
def reported(spark):
    rows = []
    for rule, path, good, bad in CASES:
        for i, line in enumerate([*good, *bad]):
            rows.append((f"{rule}/{i}", path, line))
    files = spark.createDataFrame(rows, "repo_id string, path string, content string")
    return {(r.repo_id, r.rule) for r in scan.scan_files(files).select("repo_id", "rule").collect()}


@pytest.mark.parametrize("rule,path,good,bad", CASES, ids=[c[0] for c in CASES])
def test_rule_pairs(reported, rule, path, good, bad):
    for i in range(len(good)):
        assert (f"{rule}/{i}", rule) in reported, good[i]
    for i in range(len(good), len(good) + len(bad)):
        assert (f"{rule}/{i}", rule) not in reported, bad[i - len(good)]


def run(spark, lines, path="src/a.ts", **kw):
    files = spark.createDataFrame([("r", path, "\n".join(lines))], "repo_id string, path string, content string")
    return scan.scan_files(files, **kw).collect()


def test_inner_html_classes(spark):
    found = run(
        spark,
        ["const starIcon = `<b>${ IconStar }</b>`", "x = 1", "x = 2", "x = 3", "el.innerHTML = starIcon", "", "", "", "",
         "el.innerHTML = `<i>${n}</i>`", "", "", "", "el.innerHTML = value", "", "", "", "v = req.body", "el.innerHTML = v"],
        rules=["D1-007"],
    )
    assert {r.line: (r.severity, r.confidence_level) for r in found} == {
        5: ("low", "high"), 10: ("low", "high"), 14: ("medium", "medium"), 19: ("high", "high"),
    }


def test_window_edges(spark):
    far = ["const q = req.params.id"] + ["x"] * 38 + ["await Item.findById(id)"]
    assert len(run(spark, far, rules=["AI-003"])) == 1
    assert run(spark, far[:1] + ["x"] * 39 + far[-1:], rules=["AI-003"]) == []
    owned = far[:1] + ["where.ownerId"] + far[2:]
    assert run(spark, owned, rules=["AI-003"]) == []


def test_random_without_class_hides_sensitive_log(spark):
    assert run(spark, ["console.log(Math.random(), password, resetToken)"], rules=["D8-001"]) != []
    # no code shape is left on the first line, so its evaluation ends
    assert run(spark, ["Math.random() console.log password"], rules=["D8-001", "D4-003"]) == []


def test_wildcard_cors_needs_auth_for_one_rule_and_its_absence_for_the_other(spark):
    line = ["app.use(cors({ origin: '*' }))"]
    facts = spark.createDataFrame([("r", True)], "repo_id string, has_auth boolean")
    assert {r.rule for r in run(spark, line, rules=["AI-001", "D5-002"])} == {"D5-002"}
    assert {r.rule for r in run(spark, line, rules=["AI-001", "D5-002"], repo_facts=facts)} == {"AI-001"}


def test_cookie_block(spark):
    full = ["cookie: {", "httpOnly: true,", "secure: true, sameSite: 'lax'", "}"]
    assert run(spark, full, rules=["AUTH-004"]) == []
    (one,) = run(spark, ["cookie: {", "secure: true", "}"], rules=["AUTH-004"])
    assert (one.severity, one.label) == ("medium", "httpOnly, sameSite")
    (none,) = run(spark, ["cookie: { }"], rules=["AUTH-004"])
    assert none.severity == "high"
    assert run(spark, ["cookie: {", "never closed"], rules=["AUTH-004"]) == []


def test_gates_and_metadata_lines(spark):
    assert run(spark, ["eval(x)"], path="README.md") == []
    assert run(spark, ["bad: 'eval(x)'"]) == []
    assert run(spark, ["eval(x)"], path="a.py")[0].rule == "D5-003"


def test_selection_rejects_unknown_and_repeated():
    with pytest.raises(ValueError):
        select_rules(["nope"])
    with pytest.raises(ValueError):
        select_rules(["injection", "injection"])
    assert {r.detector for r in select_rules(["deep-auth"])} == {"deep-auth"}


def test_rule_ids_are_unique():
    assert len(BY_ID) == len(RULES) <= 60


def test_history_diff_carries_the_file(spark):
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    diff = "\n".join([f"+early {key}", "+++ b/src/x.ts", "+fine", f"-{key}", f"+k {key}", "+++ b/y.ts", f" {key}", f"+z {key}"])
    rows = scan.history_secrets(spark.createDataFrame([("r", diff)], "repo_id string, diff string")).collect()
    assert {(r.file, r.line) for r in rows} == {("git-history", 1), ("src/x.ts", 5), ("y.ts", 8)}
    assert all(key not in r.snippet for r in rows)


def test_scan_plan_has_no_exchange_and_reads_only_what_it_needs(spark, tmp_path):
    files = spark.createDataFrame([("r", "a.ts", "eval(x)", 1)], "repo_id string, path string, content string, other int")
    files.write.parquet(str(tmp_path / "f"))
    df = scan.scan_files(spark.read.parquet(str(tmp_path / "f")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "other" not in plan.split("ReadSchema")[1]
