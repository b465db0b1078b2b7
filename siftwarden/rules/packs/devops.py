"""Continuous-integration and deployment settings."""

CATEGORY = "devops"
SUBJECT = "delivery setting"

# Name, severity, confidence and pattern of each rule, with entropy floor and scope, decide what is
# reported.  They stand as published, in their order.
RULES = [
    ("ci-bypass", "high", "high", r"(?i)(bypass|skip|disable|ignore).*(ci|pipeline|check|test|lint)"),
    ("hardcoded-ip", "medium", "medium", r"(?i)\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    ("debug-endpoint", "low", "medium", r"(?i)(debug|test|dev|staging).*(endpoint|api|route)"),
    ("docker-socket", "high", "high", r"(/var/run/docker\.sock|/run/docker\.sock)"),
    ("kubeconfig-reference", "medium", "high", r"(\.kube/config|kubeconfig)"),
    ("env-file-in-git", "high", "high", r"\.env(\.\w+)?"),
    ("terraform-state", "high", "high", r"terraform\.tfstate"),
    ("ansible-vault", "medium", "high", r"\$ANSIBLE_VAULT"),
    ("ci-secret-hardcoded", "critical", "high",
     r"""(?i)(gh_token|github_token|circle_token|jenkins_api).*['"][a-zA-Z0-9]{10,}""", {"entropy": 3.5}),
    ("dockerignore-missing", "low", "medium", r"^\.dockerignore"),
    ("privileged-container", "high", "high", r"(?i)(privileged|--privileged)"),
    ("root-user", "medium", "high", r"(?i)(USER\s+root|RUN\s+.*chmod.*0777)"),
    ("secrets-in-dockerfile", "high", "medium", r"(?i)(ARG|ENV).*SECRET|KEY|TOKEN|PASSWORD"),
    ("exposed-port", "low", "high", r"EXPOSE\s+\d{2,5}"),
    ("latest-tag", "medium", "high", r":latest"),
]
