"""Debug leftovers, magic values and other code smells."""

CATEGORY = "code-quality"
SUBJECT = "code smell"

# Name, severity, confidence and pattern of each rule, with entropy floor and scope, decide what is
# reported.  They stand as published, in their order.
RULES = [
    ("console-log", "low", "high", r"console\.(log|debug|info|warn|error)\s*\("),
    ("todo-comment", "low", "high", r"(?i)\b(TODO|FIXME|HACK|XXX)\b"),
    ("debugger-statement", "medium", "high", r"\bdebugger\b"),
    ("print-statement", "low", "high",
     r"\bprint\s*\(|\bSystem\.out\.print|\bprintln\s*\(|\blog\.(info|debug|warn|error)"),
    ("long-function", "low", "low", r"(?s).{200,}"),
    ("commented-code", "low", "medium", r"^\s*//\s*(function|const|let|var|if|for|while|return|class|import)"),
    ("magic-number", "low", "medium", r"[^a-zA-Z][0-9]{4,}"),
    ("empty-catch-block", "medium", "high", r"catch\s*\([^)]*\)\s*\{\s*\}"),
    ("nested-callbacks", "medium", "medium", r"\)\s*\)\s*\)\s*\)"),
    ("hardcoded-date", "low", "high", r"""new\s+Date\(\s*['"]\d{4}-\d{2}-\d{2}"""),
    ("unused-variable", "low", "low", r"(?:const|let|var)\s+\w+\s*;"),
    ("code-quality-eval-usage", "high", "high", r"eval\s*"),
    ("with-statement", "medium", "high", r"with\s*"),
    ("double-negation", "low", "high", r"!![a-zA-Z_]"),
    ("unused-import", "low", "low", r"^import\s+[^;]+\s*;$"),
]
