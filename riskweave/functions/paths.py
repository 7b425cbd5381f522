"""Predicates and lookups over file paths; null paths are false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language of each extension, and names that classify files.
LANGUAGES = {
    "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript",
    "ts": "TypeScript", "tsx": "TypeScript",
    "py": "Python",
    "rb": "Ruby",
    "go": "Go",
    "rs": "Rust",
    "java": "Java",
    "kt": "Kotlin",
    "swift": "Swift",
    "c": "C", "h": "C",
    "cpp": "C++", "cc": "C++", "hpp": "C++",
    "cs": "C#",
    "php": "PHP",
    "scala": "Scala",
    "dart": "Dart",
    "sh": "Shell", "bash": "Shell", "zsh": "Shell",
    "ps1": "PowerShell",
    "html": "HTML",
    "css": "CSS",
    "scss": "SCSS",
    "less": "Less",
    "vue": "Vue",
    "svelte": "Svelte",
    "json": "JSON",
    "yml": "YAML", "yaml": "YAML",
    "toml": "TOML",
    "xml": "XML",
    "md": "Markdown",
    "sql": "SQL",
    "tf": "Terraform",
    "dockerfile": "Dockerfile",
    "proto": "Protobuf",
    "gradle": "Gradle",
    "lock": "Lockfile",
    "env": "Dotenv",
}
MANIFESTS = [
    "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "requirements.txt", "pipfile", "pipfile.lock", "poetry.lock",
    "pyproject.toml", "gemfile", "gemfile.lock", "go.mod", "go.sum", "cargo.toml", "cargo.lock", "composer.json", "composer.lock",
    "pom.xml", "build.gradle", "gradle.lockfile",
]
PATTERNS = {
    "is_test": [r"(?i)(^|/)(tests?|__tests__|spec|specs)(/|\z)", r"(?i)\.(test|spec)\.[a-z]+\z", r"(?i)_test\.[a-z]+\z", r"(?i)(^|/)test_[^/]+\.py\z"],
    "is_code": [r"(?i)\.(js|jsx|ts|tsx|mjs|cjs|py|rb|go|rs|java|kt|swift|c|h|cpp|cc|hpp|cs|php|scala|dart|vue|svelte)\z"],
    "is_infra": [r"(?i)(^|/)\.github/workflows/", r"(?i)\.(tf|tfvars)\z", r"(?i)(dockerfile|docker-compose\.ya?ml|\.gitlab-ci\.yml|jenkinsfile|\.circleci/config\.yml|k8s|kubernetes|helm)"],
    "is_migration": [r"(?i)(^|/)migrations?/", r"(?i)(migration|schema)\.(sql|py|rb|js|ts)\z", r"(?i)\.sql\z"],
    "js_like": [r"(?i)\.(js|jsx|ts|tsx|mjs|cjs|vue|svelte|html)\z"],
}
SECRET_BASE = [r"^\.env(\z|\.)", r"(credentials|secrets?|id_rsa|id_dsa|id_ecdsa|id_ed25519)\z", r"\.(pem|pfx|p12|keystore|jks)\z"]
SECRET_PATH = r"(^|/)\.env(\z|\.)"
LOCK_BASE = r"(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|gemfile\.lock|cargo\.lock|composer\.lock|go\.sum)\z"


def base_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def _any(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return F.coalesce(out, F.lit(False))


def matches(name: str, path: Column) -> Column:
    return _any(path, PATTERNS[name])


def is_manifest(path: Column) -> Column:
    return F.coalesce(base_name(path).isin(MANIFESTS), F.lit(False))


def is_secret_file(path: Column) -> Column:
    return _any(base_name(path), SECRET_BASE) | _any(path, [SECRET_PATH])


def is_lockfile(path: Column) -> Column:
    return _any(base_name(path), [LOCK_BASE])


def language(path: Column) -> Column:
    """By file name or extension; Unknown without either."""
    base = base_name(path)
    ext = F.element_at(F.split(base, r"\."), -1)
    pairs = [F.lit(x) for pair in LANGUAGES.items() for x in pair]
    known = F.try_element_at(F.create_map(*pairs), ext)
    found = F.when(base == "dockerfile", "Dockerfile").when(base == "makefile", "Makefile").when(~base.contains("."), "Unknown").otherwise(F.coalesce(known, F.lit("Unknown")))
    return F.when(path.isNull() | (path == ""), "Unknown").otherwise(found)


def flags(path: Column) -> list[Column]:
    """All predicates as named columns."""
    return [
        matches("is_test", path).alias("is_test"), matches("is_code", path).alias("is_code"), is_manifest(path).alias("is_manifest"), matches("is_infra", path).alias("is_infra"),
        matches("is_migration", path).alias("is_migration"), is_secret_file(path).alias("is_secret_file"), is_lockfile(path).alias("is_lockfile"), matches("js_like", path).alias("js_like"),
    ]
