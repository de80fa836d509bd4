"""Names of functions, classes and interfaces in sources without a parser, by patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TS = {
    "functions": (r"(?:async\s+)?function\s+(\w+)\s*\(", r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>", r"(?:async\s+)?(\w+)\s*\([^)]*\)\s*[:{]", r"export\s+(?:async\s+)?function\s+(\w+)\s*\("),
    "classes": (r"(?:export\s+)?(?:abstract\s+)?class\s+(\w+)",),
    "interfaces": (r"(?:export\s+)?interface\s+(\w+)", r"(?:export\s+)?type\s+(\w+)\s*="),
}
_VUE = {"functions": (r"(?:const|function)\s+(\w+)\s*=", r"(\w+)\s*\([^)]*\)\s*\{"), "classes": (r"name:\s*['\"](\w+)['\"]",)}
#: Patterns by language and kind; the first group is the name.
PATTERNS: dict[str, dict[str, tuple[str, ...]]] = {
    "typescript": _TS,
    "javascript": {k: _TS[k] for k in ("functions", "classes")},
    "python": {"functions": (r"def\s+(\w+)\s*\(", r"async\s+def\s+(\w+)\s*\("), "classes": (r"class\s+(\w+)(?:\s*\(|:)",)},
    "php": {"functions": (r"(?:public|private|protected)?\s*function\s+(\w+)\s*\(",), "classes": (r"(?:abstract\s+)?class\s+(\w+)",), "interfaces": (r"interface\s+(\w+)", r"trait\s+(\w+)")},
    "vue": _VUE,
    "go": {"functions": (r"func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\s*\(",), "interfaces": (r"type\s+(\w+)\s+interface\s*\{", r"type\s+(\w+)\s+struct\s*\{")},
    "java": {"functions": (r"(?:public|private|protected)\s+(?:static\s+)?(?:\w+(?:<[^>]+>)?)\s+(\w+)\s*\(",), "classes": (r"(?:public\s+)?(?:abstract\s+)?class\s+(\w+)",), "interfaces": (r"(?:public\s+)?interface\s+(\w+)",)},
    "csharp": {"functions": (r"(?:public|private|protected|internal)\s+(?:static\s+)?(?:async\s+)?(?:\w+(?:<[^>]+>)?)\s+(\w+)\s*\(",), "classes": (r"(?:public|internal)?\s*(?:abstract\s+)?class\s+(\w+)",), "interfaces": (r"(?:public|internal)?\s*interface\s+(\w+)",)},
    "ruby": {"functions": (r"def\s+(?:self\.)?(\w+)",), "classes": (r"class\s+(\w+)", r"module\s+(\w+)")},
    "kotlin": {"functions": (r"\bfun\s+[^(\n]*?(\w+)\s*\(",), "classes": (r"\b(?:data|sealed|enum|abstract|open)?\s*class\s+(\w+)", r"\bobject\s+(\w+)"), "interfaces": (r"\binterface\s+(\w+)",)},
    "swift": {"functions": (r"\bfunc\s+(\w+)\s*(?:<[^>]*>)?\s*\(", r"(?<![.\w])(init|deinit|subscript)\b"), "classes": (r"\b(?:class|struct|actor|enum|extension)\s+(?!func\b)(\w+)",), "interfaces": (r"\bprotocol\s+(\w+)",)},
    "rust": {"functions": (r"(?:pub\s+)?fn\s+(\w+)\s*\(", r"(?:pub\s+)?struct\s+(\w+)", r"(?:pub\s+)?trait\s+(\w+)")},
}
#: Other names of languages; words of control flow that look like a method.
ALIASES = {"tsx": "typescript", "jsx": "javascript", "py": "python", "cs": "csharp", "rb": "ruby", "kt": "kotlin", "rs": "rust"}
NO_METHODS = ("if", "for", "while", "switch", "catch")
KINDS = ("functions", "classes", "interfaces")


def _names(content: Column, language: str, kind: str) -> Column:
    found = [F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in PATTERNS[language].get(kind, ())]
    if language in ("typescript", "javascript") and kind == "functions":
        found[2] = F.filter(found[2], lambda n: ~n.isin(*NO_METHODS))
    if language == "vue" and kind == "classes":  # the component's first name, and one for a component that is defined by a call
        call = F.when(content.rlike(r"defineComponent\s*\("), F.array(F.lit("VueComponent"))).otherwise(F.array().cast("array<string>"))
        found = [F.slice(found[0], 1, 1), call]
    return F.array_distinct(F.concat(*found)) if found else F.array().cast("array<string>")


def symbols(content: Column, language: Column) -> Column:
    """struct(functions, classes, interfaces): distinct names by pattern, in the order of patterns and places; empty arrays for
    other languages. Each language's patterns run on its own rows only."""
    key = F.lower(language)
    script = F.regexp_extract(content, r"<script[^>]*>([\s\S]*?)</script>", 1)
    parts = []
    for kind in KINDS:
        out = F.when(F.lit(False), F.array().cast("array<string>"))
        for name in PATTERNS:
            names = [name, *(a for a, n in ALIASES.items() if n == name)]
            out = out.when(key.isin(*names), _names(script if name == "vue" else content, name, kind))
        parts.append(out.otherwise(F.array().cast("array<string>")).alias(kind))
    return F.struct(*parts)
