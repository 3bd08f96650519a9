"""Language and category of files by their path, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.paths import basename
from graphloom.schema import lookup


# Language by ending, category by ending, language by name.
LANGUAGE_BY_EXT = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyi": "python", "go": "go", "rs": "rust",
    "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "sc": "scala", "sbt": "scala", "cs": "csharp", "swift": "swift", "lua": "lua", "rb": "ruby", "rake": "ruby",
    "php": "php", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "vue": "vue", "svelte": "svelte", "sh": "shell", "bash": "shell", "zsh": "shell",
    "ps1": "powershell", "psm1": "powershell", "psd1": "powershell", "bat": "batch", "cmd": "batch", "html": "html", "htm": "html", "css": "css", "scss": "css", "sass": "css",
    "less": "css", "md": "markdown", "mdx": "markdown", "rst": "markdown", "yaml": "yaml", "yml": "yaml", "json": "json", "jsonc": "jsonc", "toml": "toml", "xml": "xml", "xsl": "xml",
    "xsd": "xml", "plist": "xml", "cfg": "config", "ini": "config", "env": "config", "sql": "sql", "graphql": "graphql", "gql": "graphql", "proto": "protobuf", "prisma": "prisma",
    "csv": "csv", "tsv": "csv", "tf": "terraform", "tfvars": "terraform", "gradle": "gradle", "csproj": "csproj", "sln": "sln", "properties": "properties", "mod": "mod", "sum": "sum",
}
CATEGORY_BY_EXT = {
    "md": "docs", "mdx": "docs", "rst": "docs", "txt": "docs", "text": "docs", "yaml": "config", "yml": "config", "json": "config", "jsonc": "config", "toml": "config", "xml": "config",
    "xsl": "config", "xsd": "config", "plist": "config", "cfg": "config", "ini": "config", "env": "config", "properties": "config", "csproj": "config", "sln": "config", "mod": "config",
    "sum": "config", "gradle": "config", "sbt": "config", "tf": "infra", "tfvars": "infra", "sql": "data", "graphql": "data", "gql": "data", "proto": "data", "prisma": "data",
    "csv": "data", "tsv": "data", "sh": "script", "bash": "script", "zsh": "script", "ps1": "script", "psm1": "script", "psd1": "script", "bat": "script", "cmd": "script", "html": "markup",
    "htm": "markup", "css": "markup", "scss": "markup", "sass": "markup", "less": "markup",
}
LANGUAGE_BY_NAME = {"Dockerfile": "dockerfile", "Makefile": "makefile", "GNUmakefile": "makefile", "makefile": "makefile", "Jenkinsfile": "jenkinsfile", "Procfile": "procfile", "Vagrantfile": "vagrantfile"}
INFRA_RE = r"(?:^|/)(?:Dockerfile(?:\.[^/]*)?|docker-compose[^/]*\.ya?ml|compose\.ya?ml|Makefile|GNUmakefile|makefile|Jenkinsfile|Procfile|Vagrantfile|\.gitlab-ci\.ya?ml|\.dockerignore)$|(?:^|/)\.github/workflows/|(?:^|/)(?:k8s|kubernetes|helm)/"


def extension(path: Column) -> Column:
    """Lower-case ending without dot; of a dotfile its first segment; empty where there is none."""
    b = basename(path)
    return F.lower(F.when(b.startswith("."), F.regexp_extract(b, r"^\.([A-Za-z0-9]+)", 1)).otherwise(F.regexp_extract(b, r"[^.]\.([^.]+)$", 1)))


def language(path: Column) -> Column:
    """Language of a file; an unknown ending stands for itself, a file without ending is ``unknown``."""
    b, e = basename(path), extension(path)
    return (
        F.when(b.rlike(r"^Dockerfile(?:\.|$)"), "dockerfile").when(e != "", F.coalesce(lookup(LANGUAGE_BY_EXT, e), e)).otherwise(F.coalesce(lookup(LANGUAGE_BY_NAME, b), F.lit("unknown")))
    )


def category(path: Column) -> Column:
    """infra by name or folder, else by ending, else code."""
    return F.when(path.rlike(INFRA_RE), "infra").otherwise(F.coalesce(lookup(CATEGORY_BY_EXT, extension(path)), F.lit("code")))
