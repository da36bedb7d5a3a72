"""Settings of an index, and the registry of languages."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

#: Extensions of each language.
EXTENSIONS = {
    "typescript": [".ts", ".tsx"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs"],
    "python": [".py"],
    "go": [".go"],
    "rust": [".rs"],
    "java": [".java"],
    "ruby": [".rb"],
    "csharp": [".cs"],
    "php": [".php"],
}
#: Directories that hold no code of the project's own.
EXCLUDED = tuple(
    """node_modules bower_components jspm_packages dist build out output .next .nuxt .svelte-kit .cache .parcel-cache .turbo
    .eslintcache .git .svn .hg __pycache__ .venv venv env .eggs *.egg-info site-packages .mypy_cache .pytest_cache .tox vendor
    .idea .vscode coverage .nyc_output benchmarks benchmark fixtures third_party third-party external deps""".split()
)
#: Files that mark the root of a project.
MARKERS = ("package.json", "go.mod", "setup.py", "pyproject.toml", "Cargo.toml")
CONFIG_FILE, IGNORE_FILE, INDEX_DIR = ".codeloom.json", ".codeloomignore", ".codeloom"


@dataclass
class GitHistory:
    max_commits: int = 500
    min_co_change_confidence: float = 0.3
    max_files_per_commit: int = 30


@dataclass
class Config:
    version: int = 1
    exclude: list[str] = field(default_factory=lambda: ["node_modules", "dist", "build", ".git", "vendor", "__pycache__", INDEX_DIR, "coverage", ".next", ".nuxt"])
    languages: list[str] = field(default_factory=lambda: list(EXTENSIONS))
    max_file_size: int = 512_000
    git_history: GitHistory = field(default_factory=GitHistory)


def load_config(root: str) -> Config:
    """Defaults, overlaid by the project's file; lists are replaced, and a file that is no JSON object counts as none."""
    made = Config()
    try:
        given = json.loads((Path(root) / CONFIG_FILE).read_text())
    except (OSError, ValueError):
        return made
    if not isinstance(given, dict):
        return made
    for name, value in given.items():
        if name == "git_history" and isinstance(value, dict):
            made.git_history = GitHistory(**(asdict(made.git_history) | {k: v for k, v in value.items() if k in asdict(made.git_history)}))
        elif name in asdict(made):
            setattr(made, name, value)
    return made


def write_default_config(root: str) -> bool:
    """Whether a file was written: an existing one stays."""
    path = Path(root) / CONFIG_FILE
    if path.exists():
        return False
    path.write_text(json.dumps(asdict(Config()), indent=2) + "\n")
    return True
