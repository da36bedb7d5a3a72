"""Column functions on paths, names and texts. All are built-in expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

#: What tells a naming style, tried in this order.
CONVENTIONS = (
    ("camelCase", r"^[a-z][a-zA-Z0-9]*$", r"[A-Z]"),
    ("PascalCase", r"^[A-Z][a-zA-Z0-9]*$", None),
    ("snake_case", r"^[a-z][a-z0-9]*(_[a-z0-9]+)+$", None),
    ("UPPER_SNAKE_CASE", r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$", None),
    ("kebab-case", r"^[a-z][a-z0-9]*(-[a-z0-9]+)+$", None),
    ("camelCase", r"^[a-z][a-z0-9]*$", None),
)


def two_places(x: Column) -> Column:
    """Half up at two decimals, as floor(100 x + 1/2) / 100."""
    return F.floor(x * 100 + 0.5) / 100


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_name(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def stem(path: Column) -> Column:
    """The path without its last extension."""
    return F.regexp_replace(path, r"\.[^.]+$", "")


def convention(name: Column) -> Column:
    """Naming style, or null."""
    out = None
    for label, pattern, needs in CONVENTIONS:
        test = name.rlike(pattern) & (name.rlike(needs) if needs else F.lit(True))
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def is_test(path: Column) -> Column:
    """A path that speaks of tests anywhere, "latest" and "inspect" included."""
    return path.contains("test") | path.contains("spec")


#: Lower-case Latin letters with marks, and the letter that each is made of.
_PLAIN = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, (*range(0xE0, 0x250), *range(0x1E00, 0x1F00))) if c.islower() and unicodedata.normalize("NFD", c)[0] in "abcdefghijklmnopqrstuvwxyz"}


def tokens(text: Column) -> Column:
    """Lower-case alphanumeric runs, marks on Latin letters dropped."""
    folded = F.translate(F.lower(text), "".join(_PLAIN), "".join(_PLAIN.values()))
    return F.array_remove(F.split(folded, r"[^\p{L}\p{N}]+"), "")


def normal_path(path: Column) -> Column:
    """Without "." and ".." segments; leading ".." stay."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != ".") & (p != ""))
    folded = F.aggregate(
        parts, F.array().cast("array<string>"), lambda done, p: F.when((p == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    )
    return F.array_join(folded, "/")
