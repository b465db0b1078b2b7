"""How code calls remote interfaces."""

CATEGORY = "api_integration"
SUBJECT = "interface call setting"

# Name, severity, confidence and pattern of each rule, with entropy floor and scope, decide what is
# reported.  They stand as published, in their order.
RULES = [
    ("api_versioning", "medium", "high",
     r"api.*version.*header|Accept.*application/vnd\.|\/v[0-9]+\/|versioning.*strategy"),
    ("insecure_api_authentication", "medium", "high",
     r"Authorization.*Bearer.*token|apiKey.*header|auth.*basic.*credentials"),
    ("error_handling", "medium", "high", r"try.*fetch.*catch.*console\.log|response\.ok.*throw|fetch.*catch.*null"),
    ("graphql", "medium", "high", r"query.*\{.*\{.*\{.*\}|useQuery.*\[\].*staleTime.*0|mutation.*refetchQueries"),
    ("pagination", "medium", "high", r"limit.*100\+|page.*size.*large|offset.*pagination|cursor.*pagination"),
    ("rate_limiting", "medium", "high", r"setInterval.*fetch.*1000|for.*fetch.*break|while.*fetch.*condition"),
    ("rest", "medium", "high", r"fetch.*\.then.*\.then.*\.catch|await\s+fetch.*await\s+fetch"),
    ("timeout", "medium", "high", r"timeout.*0|timeout.*30000|fetch.*timeout.*10000|axios.*timeout.*5000"),
    ("versioning", "medium", "high", r"\/api\/v1|\/api\/v2|header.*version|Accept.*version"),
]
