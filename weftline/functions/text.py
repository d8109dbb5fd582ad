"""Column functions on text: tokenisers, word sets, sizes, compression. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Language by suffix (fixed values).
LANGUAGE_BY_SUFFIX = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp",
    "java": "java", "html": "html", "css": "css", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "sh": "bash",
}


def suffix(path: Column) -> Column:
    """Lower-case suffix without its dot, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language_of(path: Column) -> Column:
    """Language by suffix, null for an unknown one."""
    pairs = [x for k, v in LANGUAGE_BY_SUFFIX.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), suffix(path))


def code_tokens(text: Column) -> Column:
    """Words of code: split at lower-upper borders and at everything but ASCII letters and digits, lower case, two characters or more."""
    # a run of lower-case letters goes on with a digit, but not with a capital
    runs = F.regexp_extract_all(text, F.lit("(?=[A-Za-z0-9])[A-Z0-9]*+(?:[a-z]++[0-9][A-Z0-9]*+)*+[a-z]*+"), F.lit(0))
    return F.transform(F.filter(runs, lambda x: F.length(x) > 1), F.lower)


def word_tokens(text: Column) -> Column:
    """Runs of ``[a-z0-9_]`` of the text in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1))


def word_set(text: Column) -> Column:
    """Distinct words between white space, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[ \t\n\r\f\x0B]+"), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two word sets; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def token_estimate(text: Column) -> Column:
    """Characters div 4, 0 for null."""
    return F.expr("0") + F.coalesce(F.floor(F.length(text) / 4), F.lit(0)).cast("int")


def human_size(n: Column) -> Column:
    """Size with unit by whole division by 1024."""
    kb, mb = F.floor(n / 1024), F.floor(n / (1024 * 1024))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(kb < 1024, F.concat(kb.cast("string"), F.lit("KB"))).otherwise(F.concat(mb.cast("string"), F.lit("MB")))


def compress_code(content: Column, symbol_type: Column, import_lines: int = 30) -> Column:
    """Code without docstrings; blocks of imports keep their first lines."""
    bare = F.regexp_replace(F.regexp_replace(content, '(?s)""".*?"""', ""), "(?s)'''.*?'''", "")
    lines = F.split(content, "\n")
    cut = F.when(F.size(lines) > import_lines, F.concat(F.array_join(F.slice(lines, 1, import_lines), "\n"), F.lit("\n... [truncated]"))).otherwise(content)
    return F.when(symbol_type == "import", cut).otherwise(bare)
