"""How a file came to be: signals from commits and code shape, and their roll-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions.regex import matches, portable
from assayline.operators.spread import dealt, evaluate_once, previous_value, top_n

# Agents, shapes and thresholds of the signals.
AI_AGENTS = [
    "Claude", "Claude Code", "Copilot", "GitHub Copilot", "Cursor", "Windsurf", "Aider", "Continue", "Cody",
    "Amazon Q Developer", "Devin", "OpenHands",
]
AGENT_TRAILER = r"(?im)^Co-Authored-By:\s*(" + "|".join(AI_AGENTS) + r")\b"
BOT_TRAILER = r"(?im)^Co-Authored-By:.+\[bot\]"
PROVENANCE_HEADER = r"(?im)^(Generated-By|Generated-With|Assisted-By):\s*.+"
#: artifact path, how it matches
AGENT_ARTIFACTS = [
    (".cursor", "dir"), (".cursorrules", "file"), (".claude", "dir"), ("CLAUDE.md", "file"),
    (".windsurfrules", "file"), (".windsurf", "dir"), (".aider", "prefix"),
    (".github/copilot-instructions.md", "file"), (".continue", "dir"), (".continuerc", "file"),
    (".codyrules", "file"),
]
ARTIFACT_BOOST, PRIOR_CAP = 0.1, 0.35
SHAPE_MIN_LINES, SHAPE_MIN_FILES, SHAPE_MAX_GAP = 400, 3, 300
TRAILER_WEIGHT, COMMIT_WEIGHT, CODE_WEIGHT = 1.0, 0.7, 0.4
AI_LIKELY, MIXED = 0.7, 0.4
RATIO_MIN_LOC = 200
#: A likelihood without the noise of its double, for exact sums.
LIKELIHOOD = "decimal(13,12)"
CODE_MIN_LINES = 40
CODE_FILE = r"\.(?:m?[jt]sx?|mts|cts)$"
FUNCTION_LINE = (
    r"^\s*(?:export\s+(?:async\s+|default\s+)?)?(?:async\s+)?(?:function\s+[A-Za-z_$][\w$]*"
    r"|(?:const|let|var)\s+[A-Za-z_$][\w$]*\s*=\s*(?:async\s*)?(?:function|\([^)]*\)\s*=>)"
    r"|[A-Za-z_$][\w$]*\s*(?::\s*[^=]+)?\s*=\s*(?:async\s*)?\([^)]*\)\s*=>)"
)
COMMENT_LINE = r"^\s*(?://|/\*|\*|\*/)"
DOC_ABOVE = r"(?:^|\n)\s*(?:/\*\*[\s\S]*?\*/|(?://[^\n]*\n){2,})\s*$"
OPEN_WORK = r"\b(?:TODO|FIXME|XXX|HACK)\b"


def _signal(df: DataFrame, name: str, weight: float, detail: Column) -> DataFrame:
    return df.select(
        "repo_id", "path", F.lit(name).alias("name"), F.lit(weight).alias("weight"), F.lit(True).alias("fired"),
        detail.alias("detail"),
    )


def seconds_since_previous(commits: DataFrame, out: str = "gap_s") -> DataFrame:
    """Seconds to the repository's previous commit; NULL for the oldest.

    A repository with most of the commits is cut into ranges, whatever their days.
    """
    seconds = commits.withColumn("_s", F.unix_timestamp("ts"))
    prev = previous_value(seconds, ["repo_id"], ["_s", "sha"], "_s", None, "_p")
    return prev.withColumn(out, F.col("_s") - F.col("_p")).drop("_s", "_p")


def commit_shape_counts(
    commits: DataFrame, commit_files: DataFrame, min_lines: int = SHAPE_MIN_LINES, min_files: int = SHAPE_MIN_FILES,
    max_gap: int = SHAPE_MAX_GAP,
) -> DataFrame:
    """Per file: number of commits that are large, wide, and close behind the previous one."""
    size = commit_files.groupBy("repo_id", "sha").agg(
        F.sum("lines_added").alias("added"), F.count(F.lit(1)).alias("n_files")
    )
    big = size.where((F.col("added") >= min_lines) & (F.col("n_files") >= min_files)).select("repo_id", "sha")
    fast = seconds_since_previous(commits.select("repo_id", "sha", "ts")).where(F.col("gap_s") <= max_gap)
    shaped = fast.select("repo_id", "sha").join(big, ["repo_id", "sha"], "left_semi")
    return (
        commit_files.select("repo_id", "sha", "path")
        .join(shaped, ["repo_id", "sha"], "left_semi")
        .groupBy("repo_id", "path")
        .agg(F.count(F.lit(1)).alias("n_commits"))
    )


def commit_shape_signals(commits: DataFrame, commit_files: DataFrame, **limits: int) -> DataFrame:
    counts = commit_shape_counts(commits, commit_files, **limits)
    return _signal(
        counts, "commit-shape", COMMIT_WEIGHT,
        F.concat(F.lit("touched by "), F.col("n_commits").cast("string"), F.lit(" commits of that shape")),
    )


def trailer_label(body: Column) -> Column:
    """``agent:<name>``, ``bot`` or ``header``, in that order of precedence."""
    agent = F.regexp_extract(body, portable(AGENT_TRAILER), 1)
    return (
        F.when(body.rlike(portable(AGENT_TRAILER)), F.concat(F.lit("agent:"), agent))
        .when(body.rlike(BOT_TRAILER), "bot")
        .when(body.rlike(PROVENANCE_HEADER), "header")
    )


def recent_n_per_key(rows: DataFrame, keys: list[str], n: int, time: str = "ts", tie: str = "sha") -> DataFrame:
    """The ``n`` newest rows per key, salted so that no key needs one task."""
    return top_n(rows, keys, [F.col(time).desc(), F.col(tie).desc()], n, spread=F.col(tie))


def file_trailers(commits: DataFrame, commit_files: DataFrame, n: int | None = None) -> DataFrame:
    """Per file, over all its commits or its newest ``n``: how many carry a trailer, which agents, bot, header.

    Bodies are reduced to a label before the join, so text is never shuffled; agents
    come from a fixed list, so the collected set is bounded.  Files are dealt out by commit, once for
    the distinct rows and the join: narrow rows compress so well that partitions cut by size hold too many.
    """
    labels = commits.select("repo_id", "sha", "ts", trailer_label(F.col("body")).alias("label"))
    files = dealt(commit_files.select("repo_id", "sha", "path"), "repo_id", "sha")
    touched = files.distinct().join(labels, ["repo_id", "sha"])
    newest = touched if n is None else recent_n_per_key(touched, ["repo_id", "path"], n)
    return (
        newest.groupBy("repo_id", "path")
        .agg(
            F.count(F.lit(1)).alias("n_commits"),
            F.count("label").alias("ai_commits"),
            F.array_sort(
                F.collect_set(F.when(F.col("label").startswith("agent:"), F.substring("label", 7, 100)))
            ).alias("agents"),
            F.coalesce(F.bool_or(F.col("label") == "bot"), F.lit(False)).alias("saw_bot"),
            F.coalesce(F.bool_or(F.col("label") == "header"), F.lit(False)).alias("saw_header"),
        )
        .where(F.col("ai_commits") > 0)
    )


def trailer_signals(commits: DataFrame, commit_files: DataFrame, n: int = 20) -> DataFrame:
    found = file_trailers(commits, commit_files, n)
    detail = F.concat(
        F.col("ai_commits").cast("string"), F.lit("/"), F.col("n_commits").cast("string"),
        F.lit(" recent commits carry a trailer"),
    )
    return _signal(found, "git-trailer", TRAILER_WEIGHT, detail)


def code_shape_metrics(files: DataFrame) -> DataFrame:
    """Comment density, documented functions, open work and indent spread per code file.

    One file is one row; all metrics are folds over its line array.  Each array is computed once:
    copied into the folds, the mean would be taken anew for every line.
    """
    code = files.where(F.col("path").rlike(CODE_FILE))
    key = ["repo_id", "path"]
    base = evaluate_once(code, key, _l=F.split("content", "\n", -1))
    heads = F.filter(
        F.transform("_l", lambda x, i: F.when(x.rlike(FUNCTION_LINE), i)), lambda i: i.isNotNull()
    )
    base = evaluate_once(base, [*key, "_l"], _f=F.filter("_l", lambda x: ~x.rlike(r"^\s*$")), _h=heads)
    base = evaluate_once(base, [*key, "_l", "_f", "_h"], _c=F.filter("_f", lambda x: ~x.rlike(COMMENT_LINE)))
    indents = F.transform("_c", lambda x: F.length(F.regexp_extract(x, r"^(\s*)", 1)).cast("double"))
    base = evaluate_once(base, [*key, "_l", "_f", "_h", F.size("_c").alias("_n")], _i=indents)
    n = F.col("_n")
    mean = F.aggregate("_i", F.lit(0.0), lambda a, x: a + x) / n
    base = evaluate_once(base, [*key, "_l", "_f", "_h", "_n", "_i"], _m=F.when(n > 0, mean).otherwise(0.0))

    def above(i: Column) -> Column:
        first = F.greatest(i - 4, F.lit(0))
        return F.array_join(F.slice("_l", first + 1, i - first), "\n")

    documented = F.size(F.filter("_h", lambda i: above(i).rlike(DOC_ABOVE)))
    spread = F.sqrt(F.aggregate("_i", F.lit(0.0), lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m"))) / n)
    return evaluate_once(
        base, key,
        code_lines=n,
        comment_density=F.when(F.size("_f") > 0, (F.size("_f") - n) / F.size("_f")).otherwise(0.0),
        functions=F.size("_h"),
        documented=documented,
        open_work=F.size(F.filter("_f", lambda x: matches(x, OPEN_WORK))),
        indent_stddev=F.when(n > 0, spread).otherwise(0.0),
    )


def code_shape_signals(files: DataFrame, min_lines: int = CODE_MIN_LINES) -> DataFrame:
    """Files of at least ``min_lines`` code lines on which three of four shapes agree."""
    m = code_shape_metrics(files).where(F.col("code_lines") >= min_lines)
    reasons = [
        F.col("comment_density") >= 0.15,
        (F.col("functions") >= 2) & (F.col("documented") >= 0.8 * F.col("functions")),
        F.col("open_work") == 0,
        F.col("indent_stddev") < 1.5,
    ]
    agree = reduce(lambda a, b: a + b, [r.cast("int") for r in reasons])
    return _signal(
        m.withColumn("_n", agree).where(F.col("_n") >= 3), "code-shape", CODE_WEIGHT,
        F.concat(F.lit("shapes that agree: "), F.col("_n").cast("string")),
    )


def repo_prior(files: DataFrame) -> DataFrame:
    """``repo_id, artifacts, prior``: 0.1 per kind of agent artifact present, at most 0.35."""
    path = F.col("path")

    def present(name: str, kind: str) -> Column:
        if kind == "dir":
            return (path == name) | path.startswith(name + "/")
        if kind == "prefix":
            return path.startswith(name)
        return path == name

    hits = [present(n, k) for n, k in AGENT_ARTIFACTS]
    any_hit = reduce(lambda a, b: a | b, hits)
    flags = files.where(any_hit).groupBy("repo_id").agg(
        *[F.max(h.cast("int")).alias(f"_a{i}") for i, h in enumerate(hits)]
    )
    total = reduce(lambda a, b: a + b, [F.col(f"_a{i}") for i in range(len(hits))])
    return flags.select(
        "repo_id", total.alias("artifacts"), F.least(total * ARTIFACT_BOOST, F.lit(PRIOR_CAP)).alias("prior")
    )


def combine_signals(files: DataFrame, signals: DataFrame, prior: DataFrame) -> DataFrame:
    """``file_provenance``: noisy-or of the fired signals plus the repository prior.

    ``files`` has ``repo_id, path, n_lines``.  The product is an aggregate, so it
    combines on the map side and needs no list per file.
    """
    fired = signals.where("fired").groupBy("repo_id", "path").agg(
        F.max("weight").alias("_max"), combined_weight(F.col("weight")).alias("_any"), F.count(F.lit(1)).alias("n_signals")
    )
    joined = (
        files.select("repo_id", "path", "n_lines")
        .join(fired, ["repo_id", "path"], "left")
        .join(prior.select("repo_id", "prior"), "repo_id", "left")
    )
    boost = F.coalesce("prior", F.lit(0.0))
    raw = F.coalesce("_any", F.lit(0.0))
    likelihood = F.when(F.col("_max") >= 1, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw + boost))
    )
    evidence = (F.coalesce("n_signals", F.lit(0)) > 0) | (boost > 0)
    return joined.select(
        "repo_id", "path", likelihood.alias("ai_likelihood"),
        provenance_bucket(likelihood, evidence).alias("bucket"),
        provenance_confidence(F.col("_max")).alias("confidence"),
        "n_lines",
    )


def combined_weight(weights: Column) -> Column:
    """Noisy-or of a column of weights as an aggregate expression; a certain signal decides."""
    return F.when(F.max(weights) >= 1, F.lit(1.0)).otherwise(1 - F.product(1 - weights))


def provenance_bucket(likelihood: Column, has_evidence: Column) -> Column:
    return (
        F.when(~has_evidence, "unknown")
        .when(likelihood >= AI_LIKELY, "ai-likely")
        .when(likelihood >= MIXED, "mixed")
        .otherwise("human-likely")
    )


def provenance_confidence(strongest: Column) -> Column:
    return F.when(strongest >= 1, "high").when(strongest >= 0.7, "medium").otherwise("low")


def findings_with_provenance(findings: DataFrame, provenance: DataFrame) -> DataFrame:
    """Findings with their file's bucket and likelihood."""
    facts = provenance.select("repo_id", F.col("path").alias("file"), "bucket", "ai_likelihood")
    return findings.join(facts, ["repo_id", "file"], "left")


def repo_provenance(provenance: DataFrame, findings: DataFrame) -> DataFrame:
    """Share of machine-authored lines and finding densities per repository.

    Findings are counted per file before they meet the files, so the join is one
    row per file on both sides whatever the number of findings.  Lines are weighed in decimals: as
    doubles, 0.7 + 0.1 is less than 0.8 and a sum depends on its order, which moves shares that end in a half.
    """
    per_file = findings.groupBy("repo_id", F.col("file").alias("path")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("severity") == "critical").alias("_crit")
    )
    rows = provenance.withColumn("_is_file", F.lit(1)).join(per_file, ["repo_id", "path"], "full_outer")
    ai, human = F.col("bucket") == "ai-likely", F.col("bucket") == "human-likely"
    n = F.coalesce("_n", F.lit(0))
    crit = F.coalesce("_crit", F.lit(0))
    agg = rows.groupBy("repo_id").agg(
        F.sum(F.coalesce("n_lines", F.lit(0))).alias("loc"),
        F.sum(F.coalesce(F.col("n_lines") * F.col("ai_likelihood").cast(LIKELIHOOD), F.lit(0))).cast("double").alias("weighted"),
        F.sum(F.when(ai, F.col("n_lines")).otherwise(0)).alias("ai_loc"),
        F.sum(F.when(human, F.col("n_lines")).otherwise(0)).alias("human_loc"),
        F.sum(F.when(ai, n).otherwise(0)).alias("ai_findings"),
        F.sum(F.when(human, n).otherwise(0)).alias("human_findings"),
        F.sum(F.when(ai, crit).otherwise(0)).alias("criticals_in_ai_files"),
        F.sum(crit).alias("criticals_total"),
        F.max(F.when(F.col("confidence") == "high", 2).when(F.col("confidence") == "medium", 1).otherwise(0)).alias("_c"),
        F.count("_is_file").alias("files"),
    )
    density_ai = F.when(F.col("ai_loc") > 0, F.col("ai_findings") / F.col("ai_loc") * 1000).otherwise(0.0)
    density_human = F.when(F.col("human_loc") > 0, F.col("human_findings") / F.col("human_loc") * 1000).otherwise(0.0)
    sound = (
        (F.col("ai_loc") >= RATIO_MIN_LOC) & (F.col("human_loc") >= RATIO_MIN_LOC) & (F.col("_c") >= 1)
        & (density_human > 0)
    )

    def tenth(x: Column) -> Column:
        return F.floor(x * 10 + 0.5) / 10

    return agg.select(
        "repo_id", "files", "loc",
        F.when(F.col("loc") > 0, F.floor(F.col("weighted") / F.col("loc") * 1000 + 0.5) / 10)
        .otherwise(0.0).alias("ai_authored_percent"),
        tenth(density_ai).alias("finding_density_ai"),
        tenth(density_human).alias("finding_density_human"),
        F.when(sound, tenth(density_ai / density_human)).alias("density_ratio"),
        "criticals_in_ai_files", "criticals_total",
        F.when(F.col("_c") == 2, "high").when(F.col("_c") == 1, "medium").otherwise("low").alias("confidence"),
    )
