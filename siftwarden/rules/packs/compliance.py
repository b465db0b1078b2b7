"""Names of regulations, standards and the duties they bring."""

CATEGORY = "compliance"
SUBJECT = "regulation or audit term"

# Name, severity, confidence and pattern of each rule, with entropy floor and scope, decide what is
# reported.  They stand as published, in their order.
RULES = [
    ("gdpr-reference", "low", "medium", r"(?i)gdpr|general\s+data\s+protection"),
    ("gdpr-article-17", "low", "high", r"(?i)article\s*17|right\s*to\s*erasure"),
    ("gdpr-article-25", "low", "high", r"(?i)article\s*25|data\s*by\s*design|privacy\s*by\s*design"),
    ("gdpr-article-32", "medium", "high", r"(?i)article\s*32|security\s*of\s*processing"),
    ("hipaa-reference", "low", "medium", r"(?i)hipaa|health\s+insurance\s+portability"),
    ("hipaa-phi", "high", "high", r"(?i)phi|protected\s*health\s*information"),
    ("hipaa-safeguards", "medium", "high",
     r"(?i)hipaa\s*safeguards|administrative\s*safeguards|physical\s*safeguards|technical\s*safeguards"),
    ("soc2-reference", "low", "medium", r"(?i)soc\s*2|service\s*organization\s*control"),
    ("soc2-trust-criteria", "medium", "high",
     r"(?i)(security|availability|processing\s*integrity|confidentiality|privacy)\s*(criteria|principle)"),
    ("pci-dss", "medium", "high", r"(?i)pci\s*dss|payment\s*card\s*industry"),
    ("pci-cardholder-data", "high", "high", r"(?i)cardholder\s*data|pan|primary\s*account\s*number"),
    ("iso-27001", "low", "high", r"(?i)iso\s*27001|iso\s*iec\s*27001"),
    ("iso-27002", "low", "high", r"(?i)iso\s*27002|information\s*security\s*controls"),
    ("nist-framework", "low", "medium", r"(?i)nist\s*framework|csf|cybersecurity\s*framework"),
    ("nist-800-53", "medium", "high", r"(?i)nist\s*800[-_]?53|sp\s*800[-_]?53"),
    ("nist-800-190", "medium", "high", r"(?i)nist\s*800[-_]?190|container\s*security\s*guide"),
    ("sox-compliance", "low", "medium", r"(?i)sox|sarbanes[-_]?oxley"),
    ("fedramp", "medium", "high", r"(?i)fedramp|federal\s*risk\s*and\s*authorization"),
    ("ccpa-reference", "low", "medium", r"(?i)ccpa|california\s+consumer\s+privacy"),
    ("ccpa-consumer-rights", "low", "high", r"(?i)(right\s*to\s*know|right\s*to\s*delete|right\s*to\s*opt[-_]?out)"),
    ("lgpd", "low", "medium", r"(?i)lgpd|lei\s*geral\s*de\s*proteção"),
    ("popia", "low", "medium", r"(?i)popia|protection\s*of\s*personal\s*information"),
    ("pipl", "low", "medium", r"(?i)pipl|china\s*personal\s*information\s*protection"),
    ("hitrust", "medium", "high", r"(?i)hitrust|health\s*information\s*trust"),
    ("cobit", "low", "medium", r"(?i)cobit|control\s*objectives\s*for\s*information"),
    ("coso", "low", "medium", r"(?i)coso|committee\s*of\s*sponsoring\s*organizations"),
    ("glba", "medium", "high", r"(?i)glba|gramm[-_]?leach[-_]?bliley"),
    ("ferpa", "medium", "high", r"(?i)ferpa|family\s*educational\s*rights"),
    ("coppa", "high", "high", r"(?i)coppa|children['\s]+online\s*privacy\s*protection"),
    ("iso-9001", "low", "medium", r"(?i)iso\s*9001|quality\s*management"),
    ("pa-dss", "high", "high", r"(?i)pa[-_]?dss|payment\s*application\s*data\s*security"),
    ("data-residency", "medium", "high", r"(?i)data\s*residency|data\s*sovereignty|data\s*localization"),
    ("data-retention", "medium", "high", r"(?i)data\s*retention|record\s*retention|document\s*retention"),
]
