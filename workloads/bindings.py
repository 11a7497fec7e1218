"""How the driver's tables play the roles of the library's tables.

Each binding exists twice: as a DataFrame and as SQL text for the oracle.  The
tables hold no source code, so code files are generated by choosing one snippet per
row of ``events``; a file is one user's block of events, which bounds a file's size
however many events one user has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


FILE_BLOCK = 2048

#: one-line snippets, ours: things rules report, near misses, and plain code
SNIPPETS = [
    "const rows = await db.query(`SELECT * FROM users WHERE id = ${req.params.id}`);",
    "await pool.query('DROP TABLE ' + name);",
    "const r = await conn.execute(\"SELECT a FROM t WHERE b = \" + value);",
    "await db.query(`SELECT a FROM t WHERE b = $1 AND c = ${col}`, [x]);",
    "const data = useQuery(`posts ${id}`);",
    "query('SELECT 1 ' + tail)",
    "sandbox.execute('run ' + script);",
    "await db.query(`SELECT * FROM ${escapeIdentifier(table)}`);",
    "execSync('convert ' + req.query.file);",
    "const m = PATH_RE.exec(req.url + body.text);",
    "spawn('git', [params.branch]);",
    "const hit = fileRegex.exec(req.body.name);",
    "<div dangerouslySetInnerHTML={{ __html: req.body.html }} />",
    "<div dangerouslySetInnerHTML={{ __html: clean }} />",
    "User.find({ age: { $gt: '' } });",
    "User.find({ age: { $gt: 5 } });",
    "fs.readFileSync(req.query.path);",
    "createReadStream(path.join(root, name));",
    "el.innerHTML = userInput;",
    "el.innerHTML = `<b>${count}</b>`;",
    "el.innerHTML = iconMarkup;",
    "const iconMarkup = `<i>${ IconStar }</i>`;",
    "node.innerHTML = rendered;",
    "Object.assign({}, req.body);",
    "Object.assign(target, payload)",
    "Account.create(req.body);",
    "Account.update( req.body )",
    "const page = await fetch(`${base}/items`);",
    "fetch(req.query.url)",
    "fetch('/api/items')",
    "res.setHeader('Access-Control-Allow-Origin', '*');",
    "app.use(cors({ origin: '*' }));",
    "const opts = { origin: allowed };",
    "const token = Math.random().toString(36);",
    "const otp = Math.random() * 10000;",
    "let nonce = Date.now(); dispatch(nonce);",
    "const nonce = Math.random();",
    "const expiresAt = Date.now();",
    "if (Date.now() > token) refresh();",
    "const delay = Math.random() * 200;",
    "const userId = Math.random().toString(16);",
    "const x = Math.random();",
    "Math.random()",
    "console.log('session key', Math.random(), password);",
    "const code = 'otp ' + Math.random();",
    "const item = await Item.findById(req.params.id);",
    "where: { id }",
    "const owner = req.user;",
    "if (!hasPermission(user, 'edit')) return;",
    "await Post.deleteMany({ tag });",
    "await repo.remove(entity);",
    "Profile.create({ ...req.body });",
    "new Order({ ...payload });",
    "Profile.create({ name: req.body.name });",
    "stripe = init('sk_" + "test_" + "4f9Ac81LmQz27xYpKd0RtWb3');",
    "stripe = init('sk_" + "test_" + "exampleExample0000000000');",
    "res.status(500).json({ error: err.message });",
    "res.send(error.stack);",
    "logger.error(err.stack);",
    "session({ cookie: { secure: false, httpOnly: true } })",
    "cookie: { httpOnly: true, secure: true, sameSite: 'lax' }",
    "cookie: {",
    "  sameSite: 'none',",
    "}",
    "https.request({ rejectUnauthorized: false });",
    "app.use(helmet({ contentSecurityPolicy: false }));",
    "eval(code);",
    "const retrieval = medieval(code);",
    "console.log('password', password);",
    "console.log('password is required');",
    "console.log(`apiKey ${apiKey}`);",
    "console.log('token count', n);",
    "app.post('/login', handler);",
    "router.post(\"/items\", handler);",
    "router.put('/auth/callback', done);",
    "app.use(rateLimit({ max: 10 }));",
    "app.use(express.json({ limit: '50mb' }));",
    "app.use(express.json({ limit: '1mb' }));",
    "const app = Fastify({ bodyLimit: 0 });",
    "export const config = { api: { bodyParser: { sizeLimit: '20mb' } } };",
    "app.use(cors({ origin: true, credentials: true }));",
    "app.use(cors({ credentials: true, origin: '*' }));",
    "app.use(cors({ origin: 'https://a.example', credentials: true }));",
    "jwt.verify(token, key, { algorithms: ['HS256', 'none'] });",
    "jwt.verify(t, key, { algorithms: ['RS256'] });",
    "const claims = jwt.decode(raw);",
    "const decoded = jwt.decode(raw);",
    "if (password === stored) login();",
    "if (url.password === '') return;",
    "const ok = await bcrypt.compare(a, b);",
    "const h = crypto.createHash('md5').update(password).digest();",
    "const etag = crypto.createHash('sha1').update(body).digest();",
    "app.use(session({ secret: 'keyboard cat' }));",
    "app.use(session({ secret: 'k3yb0ard-d0g-91' }));",
    "app.use(session({ secret: process.env.SECRET }));",
    "const aws = 'AKIA" + "Q7ZL2M9XWV4TBN8C';",
    "const gh = 'ghp_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8';",
    "password = hunter2-and-more",
    "const blob = 'Zx8Kq2Lm9Wp4Rt7Yv3Nb6Hs1';",
    "const word = 'aaaaaaaaaaaaaaaaaaaaaaaa1';",
    "bad: 'eval(code)'",
    "  example = \"const token = Math.random();\"",
    "fix: `use crypto`, eval(x)",
    "import express from 'express';",
    "const app = express();",
    "app.use(helmet());",
    "const { name } = req.body;",
    "// TODO: tidy this up",
    "/** Adds two numbers. */",
    "// first line of a note",
    "// second line of a note",
    "export function add(a, b) {",
    "  return a + b;",
    "const mul = (a, b) => a * b;",
    "    const nested = compute(a);",
    "",
    "const el = document.querySelector('#main');",
    "await save(record);",
    "étoken = valeur",
    "for (const item of items) total += item.price;",
    "if (auth) next();",
    "try { work(); } catch (e) { report(e); }",
]
EXTENSIONS = [".ts", ".js", ".tsx", ".mjs", ".py", ".md", ".test.ts", ".cjs", ".jsx", ".json", ".mts", ".yml"]
FOLDERS = [
    "src", "lib", "docs", "src/__tests__", "public/vendor", "examples", "app/api", "k8s", "src/generated",
    "packages/core/src", ".github/workflows", "server/routes", "public/js",
]
#: dependency names a repository may have, a third of them authentication libraries
PACKAGES = [
    "react", "lodash", "express", "passport-local", "chalk", "zod", "axios", "jose", "left-pad", "winston", "pg",
    "ws", "@clerk/nextjs", "yargs", "next", "fastify", "vue", "jest", "uuid", "redis",
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pick(items: list[str], index: F.Column) -> F.Column:
    """Element of a literal list by 0-based index."""
    return F.element_at(F.array(*[F.lit(i) for i in items]), index.cast("int") + 1)


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(items: list[str]) -> str:
    return "[" + ", ".join(quote(i) for i in items) + "]"


def sql_pick(items: list[str], index: str) -> str:
    return f"({sql_list(items)})[({index})::INT + 1]"


def rx(pattern: str, ignore_case: bool = False) -> str:
    """A pattern as a DuckDB string literal (RE2, where ``\\b`` is ASCII already)."""
    return quote(("(?i)" if ignore_case else "") + pattern)


def code_path(user: F.Column, block: F.Column) -> F.Column:
    return F.concat(
        pick(FOLDERS, F.pmod(user + block, F.lit(len(FOLDERS)))), F.lit("/u"), user.cast("string"), F.lit("_"),
        block.cast("string"), pick(EXTENSIONS, F.pmod(user * 5 + block, F.lit(len(EXTENSIONS)))),
    )


CODE_PATH_SQL = (
    sql_pick(FOLDERS, f"(u + b) % {len(FOLDERS)}") + " || '/u' || u || '_' || b || "
    + sql_pick(EXTENSIONS, f"(u * 5 + b) % {len(EXTENSIONS)}")
)


def code_files(spark: SparkSession, sf: str) -> DataFrame:
    """``source_files`` made of snippets: one file per user and block of event ids."""
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("u"),
        F.expr(f"event_id div {FILE_BLOCK}").alias("b"),
        "event_id",
    )
    line = pick(SNIPPETS, F.pmod(F.col("event_id") * 7 + F.col("u") * 3, F.lit(len(SNIPPETS))))
    files = events.groupBy("u", "b").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]
            ),
            "\n",
        ).alias("content")
    )
    return files.select(
        F.concat(F.lit("r"), F.expr("u div 4").cast("string")).alias("repo_id"),
        code_path(F.col("u"), F.col("b")).alias("path"),
        "content",
    )


#: the same as rows; ``line`` is the snippet, ``line_no`` its place in the file
CODE_LINES_CTE = f"""
snippets AS (SELECT {sql_list(SNIPPETS)} AS s),
raw_lines AS (
  SELECT user_id AS u, event_id // {FILE_BLOCK} AS b, event_id,
         s[((event_id * 7 + user_id * 3) % {len(SNIPPETS)})::INT + 1] AS line
  FROM events, snippets),
code_lines AS (
  SELECT 'r' || (u // 4) AS repo_id, {CODE_PATH_SQL} AS path,
         (row_number() OVER (PARTITION BY u, b ORDER BY event_id))::INT AS line_no, line
  FROM raw_lines),
code_files AS (
  SELECT repo_id, path, string_agg(line, chr(10) ORDER BY line_no) AS content
  FROM code_lines GROUP BY ALL)"""


def repo_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest dependencies: up to three of the known packages per repository."""
    repo = F.expr("user_id div 4")
    name = pick(PACKAGES, F.pmod(repo * 3 + F.pmod(F.col("event_id"), F.lit(3)), F.lit(len(PACKAGES))))
    return (
        table(spark, sf, "events")
        .select(F.concat(F.lit("r"), repo.cast("string")).alias("repo_id"), name.alias("name"))
        .distinct()
    )


REPO_DEPS_CTE = f"""
repo_deps AS (
  SELECT DISTINCT 'r' || (user_id // 4) AS repo_id,
         {sql_pick(PACKAGES, f"((user_id // 4) * 3 + event_id % 3) % {len(PACKAGES)}")} AS name
  FROM events)"""


def document_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of a repository per source."""
    return table(spark, sf, "documents").select(
        F.col("source").alias("repo_id"),
        F.concat(F.lit("text/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("text").alias("content"),
    )


#: paths of many shapes, one per document
PATH_SHAPES = [
    "src/app.ts", "public/libraries/jquery-3.4.1.min.js", "vendor/lodash@4.17.20.js", "src/app.test.ts",
    "src/__tests__/a.js", "test/fixtures/x.json", "docs/guide.md", "README", ".env.example",
    "docker-compose.prod.yml", ".github/workflows/ci.yml", "webpack.config.js", "openapi-v1.yaml",
    "api/v2/users.json", "src/generated/types.ts", "marketplace/public/data/skills-catalog.json",
    "examples/demo.js", "book/10-begin/index.ts", "bin/tool.cjs", "k8s/values.yaml", "packages/a/src/index.mts",
    "e2e/login.ts", "mocks/user.ts", "src/test-utils.tsx", "public/vendor/chart.2.9.3.bundle.js",
    "third_party/d3-5.16.0.js", "lib/util.cjs", ".yarn/releases/yarn-3.cjs", "app/(auth)/page.tsx", "a/../b.ts",
    "/etc/passwd", "C:/x.ts", "src//x.ts", "src\\win.ts", "next.config.mjs", "tutorials/one.js",
]


def shaped_paths(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select(
        F.col("source").alias("repo_id"), "doc_id",
        pick(PATH_SHAPES, F.pmod(F.col("doc_id"), F.lit(len(PATH_SHAPES)))).alias("path"),
    )


SHAPED_PATHS_CTE = f"""
shaped_paths AS (
  SELECT source AS repo_id, doc_id, {sql_pick(PATH_SHAPES, f"doc_id % {len(PATH_SHAPES)}")} AS path
  FROM documents)"""
