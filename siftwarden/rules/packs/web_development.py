"""Page metadata and front-end habits."""

CATEGORY = "web_development"
SUBJECT = "front-end habit"

# Name, severity, confidence and pattern of each rule, with entropy floor and scope, decide what is
# reported.  They stand as published, in their order.
RULES = [
    ("bundler-optimization", "low", "high", r"import.*\*.*from|require.*dynamic.*import|import.*\(?.*await"),
    ("error-boundaries", "low", "high", r"componentDidCatch|getDerivedStateFromError|class.*ErrorBoundary"),
    ("form-validation", "low", "high", r"form.*onSubmit.*preventDefault|input.*required.*false|pattern.*validation"),
    ("incorrect-semantic-html", "medium", "high",
     r'<div\s+class=".*container.*"><div\s+class=".*row.*"><div\s+class=".*col.*"|<div\s+role="navigation"|<div\s+role="main"'),
    ("inefficient-css", "low", "high",
     r"@import.*css|style.*attribute.*important|\*.*\{.*display.*none|animation.*no.*hardware"),
    ("missing-prop-validation", "medium", "high", r"PropsTypes|propTypes.*isRequired|React\.PropTypes.*\.isRequired"),
    ("nextjs", "low", "high",
     r"useEffect.*\[\].*fetch|export default.*function.*props|getStaticPaths.*fallback.*false"),
    ("poor-error-boundary", "high", "high",
     r"componentDidCatch.*console\.log|ErrorBoundary.*return.*null|catch.*error.*render.*null"),
    ("react-optimization", "low", "high", r"useCallback.*\[\]|useMemo.*\[\]|React\.memo.*props.*object"),
    ("seo-meta-tags", "low", "high",
     r'<!DOCTYPE html>|<meta name="description"|<meta property="og:|<link rel="canonical"|<meta name="keywords"'),
    ("state-management", "low", "high", r"useState.*useEffect.*useState|setState.*prevState|dispatch.*action.*type"),
    ("typescript-any", "low", "high", r":\s*any\b|as\s+any\b"),
]
