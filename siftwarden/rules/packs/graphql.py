"""Settings of GraphQL servers."""

CATEGORY = "graphql"
SUBJECT = "query server setting"

# Name, severity, confidence and pattern of each rule, with entropy floor and scope, decide what is
# reported.  They stand as published, in their order.
RULES = [
    ("graphql-debug-mode", "high", "high", r"(?:debug|DEBUG|debugMode)\s*[:=]\s*(?:true|True|TRUE)"),
    ("graphql-field-cost-undefined", "medium", "high",
     r"(?:complexity|fieldCost|costAnalysis)\s*[:=]\s*(?:false|disabled|none)"),
    ("graphql-introspection-enabled", "medium", "high", r"introspection\s*[:=]\s*(?:true|True|TRUE)"),
    ("graphql-query-depth-unlimited", "high", "high",
     r"(?:maxDepth|defaultMaxDepth|queryDepth)\s*[:=]\s*(?:0|null|undefined|false)"),
]
