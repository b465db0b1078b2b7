"""Container privileges."""

CATEGORY = "container"
SUBJECT = "container privilege"

# Name, severity, confidence and pattern of each rule, with entropy floor and scope, decide what is
# reported.  They stand as published, in their order.
RULES = [
    ("dockerfile-cap-add-all", "high", "high", r"(--cap-add\s*=\s*ALL|cap_add:\s*-\s*ALL)"),
    ("dockerfile-exposed-socket", "critical", "high",
     r"(-v|--mount)(?:=|\s+)(?:/var/run/docker\.sock|var/run/docker\.sock)"),
    ("dockerfile-privileged-mode", "critical", "high", r"(--privileged|privileged:\s*true)"),
    ("dockerfile-running-as-root", "high", "high", r"(?i)^(?:USER|user)\s*(?::\s*|=|\s+)(?:root|0)$"),
]
