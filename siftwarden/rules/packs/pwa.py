"""Manifest and service-worker markers."""

CATEGORY = "pwa"
SUBJECT = "web app marker"

# Name, severity, confidence and pattern of each rule, with entropy floor and scope, decide what is
# reported.  They stand as published, in their order.
RULES = [
    ("caching-strategy", "medium", "high", r"cache.*first.*network|network.*first.*cache|stale.*while.*revalidate"),
    ("manifest", "medium", "high",
     r"manifest.*name.*short_name.*different|display.*standalone.*theme_color.*different|icons.*192.*512"),
    ("offline-support", "medium", "high", r"offline.*html.*503|navigator\.onLine.*false|fallback.*page.*offline"),
    ("service-worker", "medium", "high",
     r"cache.*addAll.*urls.*100\+|fetch.*respondWith.*cache.*match.*network|skipWaiting\(\).*clients\.claim"),
    ("shortcuts", "medium", "high", r"shortcuts.*name.*url|icons.*shortcuts.*manifest|app.*shortcuts.*home.*screen"),
]
