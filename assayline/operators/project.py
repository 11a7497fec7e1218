"""Facts about a whole repository: project type, authentication, language support."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dependency prefixes and paths that mean the application has authentication.
AUTH_PACKAGES = [
    ("@clerk/", "Clerk"),
    ("next-auth", "NextAuth"),
    ("@auth/", "Auth.js"),
    ("express-session", "express-session"),
    ("passport", "Passport"),
    ("@auth0/", "Auth0"),
    ("iron-session", "iron-session"),
    ("lucia", "Lucia"),
    ("@supabase/auth", "Supabase Auth"),
    ("firebase/auth", "Firebase Auth"),
    ("@workos-inc", "WorkOS"),
    ("@descope", "Descope"),
    ("next-firebase-auth", "Next Firebase Auth"),
    ("jose", "jose (JWT)"),
    ("jsonwebtoken", "jsonwebtoken"),
]
AUTH_PATHS = ["src/auth", "app/auth", "app/(auth)", "middleware.ts", "middleware.js"]
PROJECT_TYPES = [("next", "nextjs"), ("express", "express"), ("fastify", "fastify"), ("react", "react")]


def auth_label(name: Column) -> Column:
    """Label of the first authentication prefix the name starts with."""
    out = None
    for prefix, label in AUTH_PACKAGES:
        cond = name.startswith(prefix)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    assert out is not None
    return out


def auth_facts(dependencies: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``repo_id, has_auth, auth_sources`` from dependency names and well-known paths.

    The prefix list is fixed, so the prefix join is an expression; labels per
    repository come from a fixed domain of 20, so the collected set is bounded.
    """
    marks = dependencies.select("repo_id", auth_label(F.col("name")).alias("mark"))
    if files is not None:
        path = F.col("path")
        hit = reduce(
            lambda acc, p: acc.when((path == p) | path.startswith(p + "/"), F.lit(p)),
            AUTH_PATHS[1:],
            F.when((path == AUTH_PATHS[0]) | path.startswith(AUTH_PATHS[0] + "/"), F.lit(AUTH_PATHS[0])),
        )
        marks = marks.unionByName(files.select("repo_id", hit.alias("mark")))
    return marks.groupBy("repo_id").agg(
        (F.count("mark") > 0).alias("has_auth"), F.array_sort(F.collect_set("mark")).alias("auth_sources")
    )


def project_type(dependencies: DataFrame) -> DataFrame:
    """``repo_id, project_type`` by the first framework present; other dependencies mean node."""
    flags = [F.bool_or(F.col("name") == pkg).alias(kind) for pkg, kind in PROJECT_TYPES]
    agg = dependencies.groupBy("repo_id").agg(*flags, F.count("name").alias("_n"))
    first = F.coalesce(*[F.when(F.col(kind), F.lit(kind)) for _, kind in PROJECT_TYPES])
    return agg.select(
        "repo_id",
        F.coalesce(first, F.when(F.col("_n") > 0, "node"), F.lit("unknown")).alias("project_type"),
    )


def unsupported_language(files: DataFrame, scores: DataFrame) -> DataFrame:
    """Add ``unsupported``: fewer than five JS/TS files, no finding, and a score of 100."""
    counts = files.groupBy("repo_id").agg(
        F.count_if(F.col("path").rlike(r"\.(m?[jt]sx?|mts|cts)$")).alias("n_code_files")
    )
    joined = counts.join(scores, "repo_id", "left")
    found = F.coalesce("n_findings", F.lit(0))
    score = F.coalesce("score", F.lit(100))
    return joined.select(
        "repo_id",
        "n_code_files",
        score.alias("score"),
        ((F.col("n_code_files") < 5) & (found == 0) & (score == 100)).alias("unsupported"),
    )
