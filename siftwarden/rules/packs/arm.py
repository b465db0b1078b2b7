"""Risky fields of resource-manager templates."""

CATEGORY = "arm"
SUBJECT = "template field"

# Name, severity, confidence and pattern of each rule, with entropy floor and scope, decide what is
# reported.  They stand as published, in their order.
RULES = [
    ("arm-azure-sql-no-firewall", "high", "high", r'startIpAddress\s*[:=]\s*["\x27]0\.0\.0\.0["\x27]'),
    ("arm-azure-storage-enable-https", "high", "high", r"enableHttpsTrafficOnly\s*[:=]\s*(?:false|0|no)"),
]
