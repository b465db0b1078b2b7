"""The built-in rule catalogue: packs of rows, one detection operator for all of them."""

import importlib

# Fixed value: packs are concatenated in this order, which gives each rule its ordinal.
PACK_ORDER = [
    "secrets", "code_quality", "devops", "ai_detection", "security_hardening", "accessibility",
    "web_security", "pii", "cloud_native", "performance", "supply_chain", "infrastructure",
    "compliance", "kubernetes", "container", "git_hygiene", "git_ops", "ai_safety",
    "llm_guardrails", "shift_left", "api_integration", "terraform", "arm", "cloudformation",
    "data_visualization", "finance", "frameworks", "graphql", "healthcare", "metadata", "pwa",
    "web_development",
]

def _pack_module(name):
    return importlib.import_module(f"{__name__}.packs.{name.replace('-', '_')}")


def load_pack(name):
    """Rules of one pack, in order, without ordinals."""
    module = _pack_module(name)
    rules = []
    for rule_name, severity, confidence, pattern, *rest in module.RULES:
        options = rest[0] if rest else {}
        words = rule_name.replace("-", " ").replace("_", " ")
        rules.append({
            "name": rule_name,
            "category": module.CATEGORY,
            "match": pattern,
            "enabled": True,
            "severity": severity,
            "confidence": confidence,
            "min_entropy": options.get("entropy"),
            "description": f"{module.SUBJECT}: {words}",
            "reference": options.get("reference"),
            "tags": [module.CATEGORY, *dict.fromkeys(words.lower().split())],
            "env_var": options.get("env", False),
            "binary": options.get("binary", False),
        })
    return rules


def load_catalogue(packs=None):
    """Rules of the named packs (all of them by default) with their catalogue ordinals."""
    wanted = None if packs is None else {p.replace("-", "_") for p in packs}
    unknown = (wanted or set()) - set(PACK_ORDER)
    if unknown:
        raise ValueError(f"unknown rule packs: {sorted(unknown)}")
    rules, ordinal = [], 0
    for pack in PACK_ORDER:
        for rule in load_pack(pack):
            if wanted is None or pack in wanted:
                rules.append({"ordinal": ordinal, **rule})
            ordinal += 1
    return rules
