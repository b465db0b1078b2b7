"""Risky fields of stack templates."""

CATEGORY = "cloudformation"
SUBJECT = "template field"

# Name, severity, confidence and pattern of each rule, with entropy floor and scope, decide what is
# reported.  They stand as published, in their order.
RULES = [
    ("cloudformation-iam-lambda-assume-role", "medium", "high", r'(Principal\s*:\s*\*|AWS\s*:\s*["\x27]*\*["\x27]*)'),
    ("cloudformation-s3-no-encryption", "high", "high",
     r"ServerSideEncryptionByDefault\s*:\s*(?:NOT\s*DEFINED|false|null)"),
    ("cloudformation-s3-public-access", "critical", "high",
     r"(PublicAccessBlockConfiguration|BucketPublicAccessBlock)\s*:\s*(?:false|~\s*-\s*true)"),
]
