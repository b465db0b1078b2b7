"""Risky repository commands and settings."""

CATEGORY = "git-ops"
SUBJECT = "risky repository command"

# Name, severity, confidence and pattern of each rule, with entropy floor and scope, decide what is
# reported.  They stand as published, in their order.
RULES = [
    ("git-ops-force-push-detected", "high", "high",
     r"(?i)(git\s+push\s+--force|git\s+push\s+-f\s+origin|push\s+--force-with-lease|--force-with-lease)"),
    ("git-credential-leak", "critical", "high",
     r"(?i)(git\s+config\s+--local\s+credential\.helper|git\s+clone\s+https?://[^@]+@|url\s*=\s*https?://[^:]+:[^@]+@)"),
    ("protected-branch-delete", "critical", "high",
     r"""(?i)(git\s+push\s+origin\s+--delete\s+(main|master|develop|release|prod)|git\s+branch\s+-D\s+(main|master|develop|release|prod)|branch\s*=\s*["']?(main|master|develop|release|prod)["']?\s*\n\s*protection\s*:\s*false)"""),
]
