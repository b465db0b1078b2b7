"""Names of backup, editor, system and temporary files."""

CATEGORY = "metadata"
SUBJECT = "left-over file"

# Name, severity, confidence and pattern of each rule, with entropy floor and scope, decide what is
# reported.  They stand as published, in their order.
RULES = [
    ("backup-file", "low", "high", r'\.(bak|old|backup|orig|rpmorig|dpkg-(?:old|dist)|~\")$'),
    ("IDE-config-leak", "medium", "high", r"\.(idea|vscode|vscodium|settings\.json|workspace\.json)$"),
    ("os-cache-file", "low", "high", r"\.(DS_Store|Thumbs\.db|desktop\.ini|\.AppleDouble|\.LSOverride)$"),
    ("temporary-file", "low", "high", r"\.(tmp|temp|cache|swp|swo)$"),
]
