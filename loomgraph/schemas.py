"""Schemas, enumerations and limits of the graph model."""

from __future__ import annotations

# Bounds of the data contract.
MOST_EVIDENCE = 16
MOST_IMPACT = 2000
MOST_SEARCH = 200
MOST_CANDIDATES = 80
MOST_PER_REQUEST = 20
MOST_REQUEST_BYTES = 16 * 1024
MOST_RELATIONS = 12
MOST_PATH = 4096

# The relations that each lens shows.
LENSES = {
    "explore": None,
    "architecture": ["DECLARES", "IMPORTS", "EXTENDS", "IMPLEMENTS"],
    "spring": ["ANNOTATED_BY", "INJECTS", "DECLARES_BEAN", "MANAGED_AS", "MAY_BE_PROXIED_BY"],
    "policy": ["READS_POLICY_LEAF", "DECLARES_RUNTIME_BRANCH", "GUARDS_RUNTIME_BRANCH"],
    "pipeline": ["DECORATED_BY", "CALLS", "HAS_PIPELINE_ROLE"],
}
# Node types that the architecture lens takes for structure, those that each lens begins at, and the order of types in ranked search.
STRUCTURAL = ["Package", "Module", "Class", "Interface", "Enum", "Record", "ExternalType", "ExternalModule"]
PREFERRED = {
    "architecture": ["Package", "Module", "Class", "Interface"],
    "spring": ["FrameworkConcept", "Class", "Interface", "Method"],
    "policy": ["PolicyLeaf"],
    "pipeline": ["PipelineRole"],
    "explore": ["Package", "Module", "Class", "PolicyLeaf", "PipelineRole"],
}
TYPE_PRIORITY = {"Package": 0, "Module": 1, "Class": 2, "Interface": 3, "PolicyLeaf": 4, "PipelineRole": 5, "FrameworkConcept": 6, "Method": 7, "Function": 8, "RuntimeBranch": 9}

# Name tokens of each pipeline role; the first role that has one of a name's tokens wins.
ROLE_TOKENS = {
    "Extract": ["extract", "extractor", "fetch", "fetcher", "read", "reader", "ingest", "ingestion", "collect", "collector", "source"],
    "Transform": ["transform", "transformer", "clean", "cleaner", "normalize", "normalizer", "enrich", "enricher", "map", "mapper", "parse", "parser"],
    "Load": ["load", "loader", "write", "writer", "persist", "persistence", "publish", "publisher", "sink", "store", "storage"],
    "Validate": ["validate", "validator", "verify", "verifier", "quality", "check", "checker"],
    "Orchestrate": ["pipeline", "workflow", "orchestrate", "orchestrator", "schedule", "scheduler", "run", "runner"],
}

# Enumerations and further bounds of the data contract.
BASES = ["direct_syntax", "resolved_static", "framework_semantic", "name_heuristic"]
RUNTIME_STATUSES = ["not_applicable", "runtime_unknown"]
CODE_TYPES = ["Class", "Function", "AsyncFunction", "Method", "AsyncMethod"]
CANDIDATE_RELATIONS = ["ANNOTATED_BY", "CALLS", "DECORATED_BY", "EXTENDS", "IMPLEMENTS", "IMPORTS", "INJECTS", "MANAGED_AS", "MAY_BE_PROXIED_BY"]
RUNTIME_SENSITIVE = ["INJECTS", "MANAGED_AS", "MAY_BE_PROXIED_BY", "DECLARES_BEAN", "GUARDS_RUNTIME_BRANCH"]
EVENT_KINDS = ["decision", "change", "validation", "activation", "observation", "outcome", "rollback", "note"]
EVIDENCE_TYPES = ["observed", "declared", "inferred", "validated", "approved"]
NOT_OBSERVED = "runtime.activation_not_observed"
MOST_RESOLVED = 1000
MOST_AMBIGUOUS = 20
MOST_LIMITATIONS = 16
MOST_SUMMARY = 1000
MOST_SUBJECT = 300
RULE_ID = "[a-z][a-z0-9_.-]{2,79}"

# Directories that a source scan never enters (compared exactly, with their case).
EXCLUDED_DIRECTORIES = [
    ".git", ".hg", ".svn", ".idea", ".vscode", ".gradle", ".venv", "venv", "env", "node_modules", "target", "build", "dist", "out",
    ".next", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache", "coverage",
]
# File names, suffixes and stems that may hold secrets (compared in lower case; in stems - and . count as _).
SENSITIVE_NAMES = [".env", ".env.local", ".env.production", "credentials", "credentials.json", "secrets.json", "id_rsa", "id_ed25519"]
SENSITIVE_SUFFIXES = [".pem", ".key", ".p12", ".pfx", ".jks", ".keystore", ".kdbx"]
SENSITIVE_STEMS = ["api_key", "access_token", "auth_token", "credential", "credentials", "id_ed25519", "id_rsa", "key", "private_key", "secret", "secrets", "token"]
SENSITIVE_ENDS = ["_token", "_secret", "_key", "_credentials"]
SENSITIVE_PARTS = ["credential", "secret"]

# Patterns of absolute paths inside a text: from the root, on a drive, of a share, from a drive's root, and file addresses.
ABSOLUTE_PATHS = [
    r"(?i)(?<!http:)(?<!https:)(?<![\w./\\-])/{1,2}(?=[^\s/])",
    r"(?<![\w.])[A-Za-z]:[\\/](?=\S)",
    r"(?<![\w.\\])\\\\(?=[^\\\s]+\\)",
    r"(?<![\w.\\])\\(?!\\)(?=\S)",
    r"(?i)(?<![\w])file:(?:/{2,}|\\{2,})(?=\S)",
]

# For each relation the rule and the basis of evidence that names neither.
EDGE_RULES = {
    "DECLARES": ("core.declares", "direct_syntax"),
    "IMPORTS": ("core.imports", "direct_syntax"),
    "EXTENDS": ("core.extends", "resolved_static"),
    "IMPLEMENTS": ("java.implements", "resolved_static"),
    "ANNOTATED_BY": ("java.annotation", "direct_syntax"),
    "DECORATED_BY": ("python.decorator", "direct_syntax"),
    "INJECTS": ("java.spring.injection", "framework_semantic"),
    "DECLARES_BEAN": ("java.spring.bean_factory", "framework_semantic"),
    "MANAGED_AS": ("java.spring.managed", "framework_semantic"),
    "MAY_BE_PROXIED_BY": ("java.spring.proxy_signal", "framework_semantic"),
    "CALLS": ("core.calls", "resolved_static"),
    "HAS_PIPELINE_ROLE": ("python.pipeline_role", "name_heuristic"),
    "READS_POLICY_LEAF": ("java.policy.read", "direct_syntax"),
    "DECLARES_RUNTIME_BRANCH": ("java.policy.branch", "direct_syntax"),
    "GUARDS_RUNTIME_BRANCH": ("java.policy.guard", "resolved_static"),
}
# What an adapter can say about itself, and how.
SUPPORT = ["supported", "partial", "unsupported"]
CAPABILITIES = ["annotations", "calls", "declarations", "decorators", "dependency_injection", "explicit_type_imports", "imports", "inheritance", "pipeline_roles", "runtime_activation", "runtime_dispatch", "runtime_imports"]
MOST_UNSUPPORTED = 32
#: Symbols that one resolution looks for; they are compared with every node.
MOST_SYMBOLS = 100
