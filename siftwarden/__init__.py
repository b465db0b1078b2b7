"""Content-risk analytics on Spark: rules, detection, findings, risk."""

from .operators.detect import category_hits, content_table, detect, match_counts, match_spans
from .plans.profiles import PRESETS, Profile, preset
from .plans.scan import scan_diff, scan_files, scan_kv, scan_requests, scan_rule_table, scan_table
from .rules import load_catalogue, load_pack

__all__ = [
    "PRESETS", "Profile", "category_hits", "content_table", "detect", "load_catalogue", "load_pack", "match_counts",
    "match_spans", "preset", "scan_diff", "scan_files", "scan_kv", "scan_requests", "scan_rule_table", "scan_table",
]
