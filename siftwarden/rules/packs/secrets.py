"""Credentials by their published formats: vendor prefixes, key files, connection strings."""

CATEGORY = "secrets"
SUBJECT = "exposed credential"

WORD = "[A-Za-z0-9]"
BASE64 = "[A-Za-z0-9+/=]"


def assigned(keys, value):
    """``key = 'value'`` or ``key: "value"``."""
    return f"(?i)(?:{'|'.join(keys)})\\s*[:=]\\s*['\"]{value}"


def token(prefix, size, body=WORD):
    """Case-sensitive vendor token with a fixed prefix."""
    return rf"\b{prefix}{body}{{{size}}}"


# Our own rows: name, severity, confidence, pattern and entropy floor.
RULES = [
    ("secrets-aws-access-key", "high", "high", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", {"entropy": 3.5}),
    ("secrets-aws-secret-key", "critical", "high", assigned((r"aws[_.-]?secret[_.-]?(?:access[_.-]?)?key",), BASE64 + "{40}"),
     {"entropy": 3.5}),
    ("secrets-github-token", "critical", "high", token("gh[pousr]_", "36,"), {"entropy": 3.5}),
    ("secrets-github-fine-grained-token", "critical", "high", token("github_pat_", "22,", r"\w"), {"entropy": 3.5}),
    ("secrets-gitlab-token", "critical", "high", token("glpat-", "20,", r"[\w-]"), {"entropy": 3.5}),
    ("secrets-stripe-api-key", "critical", "high", token("[sr]k_(?:live|test)_", "24,"), {"entropy": 3.5}),
    ("secrets-slack-token", "critical", "high", token("xox[abeoprs]-", "10,", "[A-Za-z0-9-]"), {"entropy": 3.0}),
    ("secrets-slack-webhook", "high", "high", r"https://hooks\.slack\.com/services/T\w+/B\w+/\w+"),
    ("secrets-azure-devops-token", "critical", "high", assigned((r"azure[_.-]?devops[_.-]?(?:pat|token)",), "[a-z0-9]{52}"),
     {"entropy": 3.5}),
    ("secrets-azure-storage-key", "critical", "high", rf"AccountKey={BASE64}{{86,88}}"),
    ("secrets-gcp-service-account", "critical", "high", r'"type"\s*:\s*"service_account"'),
    ("secrets-gcp-api-key", "high", "high", token("AIza", "35", r"[\w-]")),
    ("secrets-gcp-oauth-secret", "high", "high", token("GOCSPX-", "28", r"[\w-]")),
    ("secrets-jwt", "high", "medium", r"\beyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}"),
    ("secrets-jwt-secret", "high", "high", assigned((r"jwt[_.-]?secret(?:[_.-]?key)?",), "[^'\"]{16,}"), {"entropy": 3.0}),
    ("secrets-private-key", "critical", "high", r"-----BEGIN (?:RSA |DSA |EC |OPENSSH |ENCRYPTED |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    ("secrets-putty-private-key", "critical", "high", r"PuTTY-User-Key-File-\d"),
    ("secrets-password-in-url", "high", "high", r"\b[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/@]+@[^\s/]+"),
    ("secrets-database-url", "critical", "high", r"\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\s:@/]+:[^\s@/]+@"),
    ("secrets-jdbc-password", "high", "high", r"jdbc:[a-z]+:[^\s]*password=[^\s&;]+"),
    ("secrets-generic-api-key", "high", "medium", assigned((r"api[_.-]?key", r"api[_.-]?token"), WORD + "{16,}"), {"entropy": 3.5}),
    ("secrets-generic-secret", "high", "medium", assigned((r"client[_.-]?secret", r"app[_.-]?secret", r"secret[_.-]?key"),
                                              "[^'\"]{12,}"), {"entropy": 3.5}),
    ("secrets-generic-password", "high", "medium", assigned(("password", "passwd", "pwd"), r"[^'\"\s]{8,}"), {"entropy": 2.5}),
    ("secrets-bearer-header", "high", "medium", r"(?i)authorization:\s*bearer\s+[\w.~+/=-]{20,}"),
    ("secrets-basic-header", "high", "medium", rf"(?i)authorization:\s*basic\s+{BASE64}{{16,}}"),
    ("secrets-npm-token", "critical", "high", token("npm_", "36")),
    ("secrets-npmrc-auth", "critical", "high", r"//[^\s:]+/:_authToken=[^\s$]+"),
    ("secrets-pypi-token", "critical", "high", token("pypi-AgEIcHlwaS5vcmc", "50,", r"[\w-]")),
    ("secrets-docker-auth", "high", "high", rf'"auth"\s*:\s*"{BASE64}{{16,}}"'),
    ("secrets-sendgrid-key", "critical", "high", token(r"SG\.", "22", r"[\w-]") + r"\.[\w-]{43}"),
    ("secrets-mailgun-key", "critical", "high", token("key-", "32", "[0-9a-f]")),
    ("secrets-mailchimp-key", "high", "high", r"\b[0-9a-f]{32}-us\d{1,2}\b"),
    ("secrets-twilio-key", "critical", "high", token("SK", "32", "[0-9a-f]")),
    ("secrets-twilio-account", "medium", "high", token("AC", "32", "[0-9a-f]")),
    ("secrets-telegram-bot-token", "critical", "high", r"\b\d{8,10}:AA[\w-]{33}"),
    ("secrets-discord-webhook", "high", "high", r"https://discord(?:app)?\.com/api/webhooks/\d+/[\w-]+"),
    ("secrets-shopify-token", "critical", "high", token("shp(?:at|ca|pa|ss)_", "32", "[a-fA-F0-9]")),
    ("secrets-square-token", "critical", "high", token("sq0(?:atp|csp)-", "22,", r"[\w-]")),
    ("secrets-digitalocean-token", "critical", "high", token("do[opr]_v1_", "64", "[a-f0-9]")),
    ("secrets-vault-token", "critical", "high", token(r"hv[sb]\.", "24,", r"[\w-]")),
]
