"""Identifiers used in health care."""

CATEGORY = "healthcare"
SUBJECT = "health identifier"

# Name, severity, confidence and pattern of each rule, with entropy floor and scope, decide what is
# reported.  They stand as published, in their order.
RULES = [
    ("clinical-trial-id", "medium", "high", r"\bNCT[0-9]{8}\b"),
    ("healthcare-code", "medium", "high", r"\b(?:CPT|HCPCS|ICD-10)[A-Z0-9]{5,8}\b"),
    ("insurance-number", "medium", "high", r"\b(?:INS|INSURANCE)[0-9]{9,11}\b"),
    ("medical-license-number", "medium", "high", r"\b(?:MD|DO|RN|LPN|PA|NP)[0-9]{8,12}\b"),
    ("healthcare-medical-record-number", "medium", "high", r"\bMRN[0-9]{8,12}\b"),
    ("patient-id", "medium", "high", r"\b(?:PATIENT|PT)[0-9]{8,12}\b"),
    ("healthcare-prescription-number", "medium", "high", r"\bRX[0-9]{7,10}\b"),
]
