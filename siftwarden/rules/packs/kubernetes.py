"""Risky fields of cluster manifests."""

CATEGORY = "kubernetes"
SUBJECT = "manifest field"

# Name, severity, confidence and pattern of each rule, with entropy floor and scope, decide what is
# reported.  They stand as published, in their order.
RULES = [
    ("k8s-allow-privilege-escalation", "high", "high", r"allowPrivilegeEscalation:\s*(true|null)"),
    ("k8s-empty-dir-memory-backed", "medium", "high", r"emptyDir:\s*\n\s*medium:\s*Memory"),
    ("hostnetwork", "high", "high", r"(?i)securityContext:\s*\n\s*hostNetwork:\s*true"),
    ("hostpid", "high", "high", r"(?i)securityContext:\s*\n\s*hostPID:\s*true"),
    ("kubernetes-latest-tag", "medium", "high", r"(?i)image:\s*[^:\n]+:latest"),
    ("k8s-missing-capability-drop", "medium", "medium", r"securityContext"),
    ("k8s-no-network-policy", "medium", "high", r"(NetworkPolicy|networkPolicy).*:\s*\|?\s*-\s*\{"),
    ("no-resource-limits", "medium", "high",
     r"(?i)(containers:|-\s+name:).*?(image:|containers:)|resources:\s*\n\s*limits:"),
    ("kubernetes-privileged-container", "critical", "high", r"(?i)securityContext:\s*\n\s*privileged:\s*true"),
    ("k8s-run-as-non-root", "high", "high", r"(runAsNonRoot|runAsRoot):\s*(true|false)"),
    ("secrets-in-manifest", "high", "high",
     r"""(?i)(apiVersion:\s*v1\s*\n\s*kind:\s*Secret|secretKeyRef|data:\s*\n\s*  [a-zA-Z_]+:\s*['\"][^'\"]+['\"])"""),
]
