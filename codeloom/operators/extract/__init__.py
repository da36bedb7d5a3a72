"""Extraction: source text to symbols, imports, call sites and type hints, a language a function."""

from . import braces, python, ruby, typescript

#: language -> function of (text, path).
EXTRACTORS = {
    "typescript": typescript.extract,
    "javascript": typescript.extract,
    "python": python.extract,
    "go": braces.go,
    "rust": braces.rust,
    "java": braces.java,
    "ruby": ruby.extract,
    "csharp": braces.csharp,
    "php": braces.php,
}
