"""Page elements an accessibility review has to look at."""

CATEGORY = "accessibility"
SUBJECT = "accessibility check"

# Name, severity, confidence and pattern of each rule, with entropy floor and scope, decide what is
# reported.  They stand as published, in their order.
RULES = [
    ("missing-alt-text", "medium", "high", r"<img[^>]*>"),
    ("missing-aria-label", "medium", "medium", r"<button[^>]*>"),
    ("missing-lang-attribute", "medium", "high", r"<(?:!DOCTYPE|html)[^>]*>"),
    ("empty-link-text", "medium", "high", r"<a[^>]*>\s*</a>"),
    ("missing-form-label", "medium", "medium", r"<input[^>]*>"),
    ("missing-title", "medium", "high", r"<head>.*</head>"),
    ("missing-meta-viewport", "low", "high", r"<head>.*</head>"),
    ("low-color-contrast", "medium", "low", r"color:\s*(#[0-9a-fA-F]{3,3}|rgba?\()"),
    ("missing-skip-link", "low", "medium", r"<body>.*</body>"),
    ("missing-main-landmark", "low", "high", r"<body>.*</body>"),
    ("missing-heading-level", "medium", "high", r"<h([6-9]|[1-9][0-9])"),
    ("autocomplete-missing", "low", "medium", r"<input[^>]*>"),
    ("missing-focus-indicator", "medium", "medium", r":focus\s*\{[^}]*(?:outline:\s*none|outline:\s*0)"),
    ("missing-table-headers", "medium", "medium", r"<table.*</table>"),
    ("video-missing-captions", "medium", "high", r"<video[^>]*>"),
    ("audio-missing-transcript", "medium", "high", r"<audio[^>]*>"),
    ("iframe-missing-title", "medium", "high", r"<iframe[^>]*>"),
    ("marquee-element", "high", "high", r"<marquee"),
    ("blinking-content", "medium", "medium",
     r"(?i:animation.*:blink|@keyframes\s+.*\s+0%\s*\{\s*[^}]*opacity\s*:\s*0)"),
    ("role-definition", "low", "high", r'role="[a-z-]+"'),
    ("live-region", "low", "high", r'aria-live="(?:polite|assertive)"'),
    ("tab-index-usage", "low", "high", r'tabindex="[^"]*"'),
]
