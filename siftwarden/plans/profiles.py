"""Scan options and the named presets."""

from dataclasses import dataclass, field

from ..operators import filters


@dataclass(frozen=True)
class Profile:
    name: str = "default"
    categories: tuple | None = None
    max_size_mb: int = 10
    skip_binary: bool = True
    use_ignore_files: bool = True
    fail_on_findings: bool = False
    output: str = "human"
    ignore_globs: tuple = field(default_factory=tuple)

    def rules(self, rules):
        """Rules of the profile's categories."""
        if self.categories is None:
            return list(rules)
        wanted = {c.replace("_", "-") for c in self.categories}
        return [r for r in rules if r["category"].lower().replace("_", "-") in wanted]

    def content(self, content):
        """Rows the profile scans."""
        kept = filters.filter_size(content, self.max_size_mb * 1024 * 1024)
        kept = filters.filter_binary(kept) if self.skip_binary else kept
        if self.use_ignore_files and "path" in content.columns:
            kept = filters.filter_ignored(kept, self.ignore_globs)
        return kept


_GUARDED = ("secrets", "pii", "security", "code-quality")

# The presets.
PRESETS = {
    "production": Profile("production", _GUARDED, 5, True, True, True, "sarif"),
    "pipeline": Profile("pipeline", (*_GUARDED, "devops"), 10, True, True, True, "json"),
    "development": Profile("development", None, 50, False, True, False, "human"),
    "mcp": Profile("mcp", None, 10, True, True, False, "json"),
}


def preset(name) -> Profile:
    if name not in PRESETS:
        raise ValueError(f"unknown profile {name!r}; there are {sorted(PRESETS)}")
    return PRESETS[name]
