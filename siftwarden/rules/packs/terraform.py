"""Risky settings of infrastructure modules."""

CATEGORY = "terraform"
SUBJECT = "module setting"

# Name, severity, confidence and pattern of each rule, with entropy floor and scope, decide what is
# reported.  They stand as published, in their order.
RULES = [
    ("db-public-access", "high", "high", r"(?i)publicly_accessible\s*=\s*true|skip_final_snapshot\s*=\s*true"),
    ("tf-ecs-no-secrets", "medium", "high", r"aws_ecs_task_definition"),
    ("tf-ecs-privileged", "critical", "high", r"aws_ecs_task_definition[^{]*\{[^}]*privileged\s*=\s*true"),
    ("hardcoded-tf-secrets", "critical", "high",
     r"""(?i)(password\s*=\s*["'][^"']{8,}["']|secret\s*=\s*["'][^"']{8,}["']|api_key\s*=\s*["'][^"']{8,}["']|aws_access_key\s*=\s*["'][^"']{8,}["']|aws_secret_key\s*=\s*["'][^"']{8,}["'])"""),
    ("s3-public-access", "high", "high",
     r"""(?i)acl\s*=\s*["']public-read["']|acl\s*=\s*["']public-read-write["']|acl\s*=\s*["']aws-auth["']|block_public_acls\s*=\s*false|block_public_policy\s*=\s*false"""),
    ("tf-s3-unencrypted", "high", "high", r"aws_s3_bucket[^{]*\{[^}]*server_side_encryption_configuration\s*=\s*null"),
    ("unencrypted-storage", "high", "high",
     r"(?i)encrypted\s*=\s*false|encryption\s*=\s*false|server_side_encryption_configuration\s*=\s*null"),
]
