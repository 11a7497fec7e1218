"""Project scan: files to findings, scores and provenance, for a table of repositories."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.functions.severity import DEFAULT_MIN_CONFIDENCE
from assayline.operators import context, project, provenance, scan, score, supply
from assayline.operators.rules import DEFAULT_DETECTORS, OPTIONAL_DETECTORS
from assayline.plans.extension import Detector, FileSignalSource, Lookups, RepoSignalSource
from assayline.session import checkpoint_dir
from assayline.sources import packages
from assayline.sources.files import AGENT_CONFIGS

#: Files that a detector reads by name: manifests, lockfiles, workspaces, environment and ignore files, framework and agent configurations.
NAMED_FILES = r"(?:^|/)package\.json$|^(?:package-lock\.json|pnpm-workspace\.yaml|\.gitignore|" + "|".join(re.escape(x) for x in scan.ENV_FILES) + r")$|next\.config\.(?:js|ts|mjs)$|" + AGENT_CONFIGS
LINE_DETECTORS = {"secrets", "injection", "misconfig", "ai-patterns", "api-hardening", "deep-auth"}


@dataclass(frozen=True)
class ProjectScan:
    """Options of a scan.  ``findings`` and what follows are lazy DataFrames."""

    detectors: Sequence[str] = field(default_factory=lambda: list(DEFAULT_DETECTORS))
    min_confidence: float = DEFAULT_MIN_CONFIDENCE
    strict: bool = False
    lookups: Lookups = field(default_factory=Lookups)
    extra: Sequence[Detector] = ()
    file_signals: Sequence[FileSignalSource] = ()
    repo_signals: Sequence[RepoSignalSource] = ()

    def __post_init__(self) -> None:
        known = set(DEFAULT_DETECTORS) | set(OPTIONAL_DETECTORS)
        if len(set(self.detectors)) != len(self.detectors) or not set(self.detectors) <= known:
            raise ValueError(f"unknown or repeated detector in {list(self.detectors)}")

    # ------------------------------------------------------------------ facts
    def manifest_dependencies(self, files: DataFrame) -> DataFrame:
        return packages.manifest_dependencies(files.where(F.col("path") == "package.json"))

    def lock_dependencies(self, files: DataFrame) -> DataFrame:
        return packages.flatten_lockfile(files.where(F.col("path") == "package-lock.json"))

    def named_files(self, files: DataFrame) -> DataFrame:
        """The files that detectors read by name, routed out in one pass and written to the checkpoint folder.

        They are few and small beside the sources; without this every detector would read all
        contents again to find its own.
        """
        checkpoint_dir(files.sparkSession)
        return files.where(F.col("path").rlike(NAMED_FILES)).checkpoint()

    def repo_facts(self, files: DataFrame, named: DataFrame | None = None) -> DataFrame:
        return project.auth_facts(self.manifest_dependencies(files if named is None else named), files)

    # ------------------------------------------------------------------ findings
    def raw_findings(
        self, files: DataFrame, diffs: DataFrame | None = None, agent_configs: DataFrame | None = None
    ) -> DataFrame:
        """All detectors before any filter, in one union.

        Contents are read twice: for the files with a name of their own (now), and for the lines
        (when the result is used); what needs paths only reads no contents.
        """
        named = self.named_files(files)
        facts = self.repo_facts(files, named)
        chosen = set(self.detectors)
        lines = [d for d in self.detectors if d in LINE_DETECTORS]
        parts = [scan.scan_files(files, detectors=lines, repo_facts=facts)] if lines else []
        if "misconfig" in chosen:
            parts += [scan.missing_headers(named), scan.env_file_exposed(named)]
        if "api-hardening" in chosen:
            parts.append(scan.express_without_helmet(files))
        if "git-history" in chosen and diffs is not None:
            parts.append(scan.history_secrets(diffs))
        if "agent-surface" in chosen:
            configs = named.where(F.col("path").rlike(AGENT_CONFIGS)) if agent_configs is None else agent_configs
            parts.append(supply.agent_findings_of_servers(packages.read_agent_configs(configs)))
        advisories, registry = self.lookups.advisories, self.lookups.registry
        if advisories is not None:
            if "dependencies" in chosen:
                parts.append(supply.vulnerable_dependencies(self.lock_dependencies(named), advisories))
            if "vendored-cves" in chosen:
                parts.append(supply.vendored_vulnerabilities(files, advisories))
        if registry is not None and "slopsquat" in chosen:
            names = packages.union_distinct_dependencies(self.manifest_dependencies(named), self.lock_dependencies(named))
            own = packages.workspace_package_names(named)
            external = supply.external_dependencies(names, own)
            parts += [
                supply.missing_packages(external, registry, self.lookups.at()),
                supply.lookalike_packages(external, registry, self.lookups.at()),
            ]
        parts += [d.run(files, facts) for d in self.extra]
        return scan.union_findings(parts)

    def findings(
        self, files: DataFrame, diffs: DataFrame | None = None, agent_configs: DataFrame | None = None
    ) -> DataFrame:
        """Filter, then classify test files, then tag: the order is part of the result."""
        kept = context.min_confidence(self.raw_findings(files, diffs, agent_configs), self.min_confidence)
        return context.apply_context_tags(context.classify_test_context(kept, self.strict), self.strict)

    # ------------------------------------------------------------------ roll-ups
    def scores(self, files: DataFrame, findings: DataFrame) -> DataFrame:
        """Score per repository, clean ones included, with the unsupported-language flag."""
        repos = files.select("repo_id").distinct()
        scored = score.security_score(findings, repos, self.strict)
        flags = project.unsupported_language(files, scored).select("repo_id", "n_code_files", "unsupported")
        return scored.join(flags, "repo_id")

    def provenance(self, files: DataFrame, commits: DataFrame, commit_files: DataFrame) -> DataFrame:
        """``file_provenance`` from commit trailers, commit shape, code shape, agent artifacts and the plugged-in sources.

        Of a repository's priors the largest counts.
        """
        code = files.where(F.col("path").rlike(provenance.CODE_FILE)).select(
            "repo_id", "path", F.size(F.split("content", "\n", -1)).cast("bigint").alias("n_lines")
        )
        signals = (
            provenance.trailer_signals(commits, commit_files)
            .unionByName(provenance.commit_shape_signals(commits, commit_files))
            .unionByName(provenance.code_shape_signals(files))
        )
        for source in self.file_signals:
            signals = signals.unionByName(source.detect(files))
        priors = provenance.repo_prior(files).select("repo_id", "prior")
        for prior in self.repo_signals:
            priors = priors.unionByName(prior.detect(files).select("repo_id", "prior"))
        largest = priors.groupBy("repo_id").agg(F.max("prior").alias("prior"))
        return provenance.combine_signals(code, signals, largest)


def check_snippets(documents: DataFrame) -> DataFrame:
    """Verdict per document (``repo_id, path, content``): block, warn or allow; clean ones included."""
    found = scan.scan_files(documents, detectors=["secrets", "injection", "ai-patterns"])
    verdicts = score.snippet_verdict(found.withColumnRenamed("file", "path"), ["repo_id", "path"])
    return documents.select("repo_id", "path").join(verdicts, ["repo_id", "path"], "left").fillna("allow", ["verdict"])
