"""Table schemas.  Readers use these; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
_TS = T.TimestampType()


def _table(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in cols.items()])


SOURCE_FILES = _table(repo_id=_S, path=_S, content=_S)
SOURCE_LINES = _table(repo_id=_S, path=_S, line_no=_I, line=_S)
FINDINGS = _table(
    repo_id=_S, finding_id=_S, detector=_S, rule=_S, domain=_S, severity=_S, original_severity=_S, context=_S,
    context_tag=_S, title=_S, file=_S, line=_I, snippet=_S, package=_S, cve=_S, refs=T.ArrayType(_S),
    confidence_level=_S, confidence_score=_D, category=_S, label=_S,
)
DEPENDENCIES = _table(repo_id=_S, name=_S, version=_S, scope=_S, source_file=_S)
ADVISORIES = _table(
    ecosystem=_S, name=_S, version=_S, vuln_id=_S, aliases=T.ArrayType(_S), summary=_S, raw_severity=_S,
    fixed_version=_S,
)
REGISTRY_NAMES = _table(name=_S, exists=_B, checked_at=_TS)
COMMITS = _table(repo_id=_S, sha=_S, ts=_TS, body=_S)
COMMIT_FILES = _table(repo_id=_S, sha=_S, path=_S, lines_added=_L)
FILE_PROVENANCE = _table(repo_id=_S, path=_S, ai_likelihood=_D, bucket=_S, confidence=_S, n_lines=_L)
SIGNALS = _table(repo_id=_S, path=_S, name=_S, weight=_D, fired=_B, detail=_S)
OBSERVATIONS = _table(
    observation_id=_S, subject_id=_S, origin_kind=_S, producer_id=_S, run_id=_S, rule=_S, coverage_class=_S,
    category=_S, title=_S, location_kind=_S, path=_S, start_line=_L, package=_S, advisory=_S,
    severity_original=_S, severity=_S, confidence_level=_S, confidence_score=_D, remediation=_S, raw_digest=_S,
)
LINEAGE_EDGES = _table(from_subject_id=_S, to_subject_id=_S, relation=_S, status=_S, evidence_ref=_S)

#: lockfile, manifests and agent configuration as far as they are read
LOCKFILE = "struct<packages:map<string,struct<version:string>>,dependencies:map<string,struct<version:string>>>"
MANIFEST = (
    "struct<name:string,version:string,dependencies:map<string,string>,devDependencies:map<string,string>,"
    "optionalDependencies:map<string,string>,peerDependencies:map<string,string>>"
)
AGENT_SERVER = (
    "map<string,struct<command:string,args:array<string>,env:map<string,string>,url:string,allowedTools:string>>"
)
SARIF_LOCATION = (
    "struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:bigint>>>"
)
SARIF = (
    "struct<version:string,runs:array<struct<results:array<struct<ruleId:string,level:string,"
    f"message:struct<text:string>,locations:array<{SARIF_LOCATION}>>>>>>"
)
CYCLONEDX = (
    "struct<bomFormat:string,specVersion:string,components:array<struct<type:string,name:string,version:string,"
    "`bom-ref`:string,hashes:array<struct<alg:string,content:string>>>>,"
    "dependencies:array<struct<ref:string,dependsOn:array<string>>>,"
    "vulnerabilities:array<struct<id:string,analysis:struct<state:string,detail:string>,"
    "affects:array<struct<ref:string>>>>>"
)
SPDX = (
    "struct<spdxVersion:string,packages:array<struct<SPDXID:string,name:string,versionInfo:string>>,"
    "files:array<struct<SPDXID:string,fileName:string>>,"
    "relationships:array<struct<spdxElementId:string,relationshipType:string,relatedSpdxElement:string>>>"
)
IN_TOTO = (
    "struct<_type:string,predicateType:string,subject:array<struct<name:string,digest:map<string,string>>>,"
    "predicate:struct<builder:struct<id:string>,invocation:struct<configSource:struct<uri:string>>,"
    "buildDefinition:struct<buildType:string>,runDetails:struct<builder:struct<id:string>,"
    "metadata:struct<invocationId:string>>>>"
)
DSSE = "struct<payloadType:string,payload:string,signatures:array<struct<keyid:string,sig:string>>>"
TRIVY = (
    "struct<Results:array<struct<Target:string,"
    "Vulnerabilities:array<struct<VulnerabilityID:string,Severity:string,PkgName:string,InstalledVersion:string,"
    "FixedVersion:string,Title:string>>,"
    "Misconfigurations:array<struct<ID:string,Title:string,Severity:string,"
    "CauseMetadata:struct<StartLine:bigint>>>,"
    "Secrets:array<struct<RuleID:string,Title:string,Severity:string,StartLine:bigint>>>>>"
)
