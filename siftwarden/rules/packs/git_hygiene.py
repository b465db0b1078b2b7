"""Commit text, branch names and repository housekeeping."""

CATEGORY = "git-hygiene"
SUBJECT = "repository habit"

# Name, severity, confidence and pattern of each rule, with entropy floor and scope, decide what is
# reported.  They stand as published, in their order.
RULES = [
    ("merge-conflict", "high", "high", r"^<{7}|^={7}|^>{7}"),
    ("git-commit-signoff", "low", "high", r"Signed-off-by:"),
    ("git-commit-verify", "low", "high", r"gpg.sign\s*=\s*true"),
    ("gitignore-entry", "low", "high", r"^\.gitignore$"),
    ("gitattributes-entry", "low", "high", r"^\.gitattributes$"),
    ("gitmodules-entry", "medium", "high", r"^\.gitmodules$"),
    ("commit-message-conventional", "low", "medium",
     r"(?i)^(feat|fix|docs|style|refactor|test|chore|perf|ci|build|revert)\([^)]+\):"),
    ("branch-naming-feature", "low", "high", r"^feature/[a-z0-9-_]+$"),
    ("branch-naming-bugfix", "low", "high", r"^bugfix/[a-z0-9-_]+$"),
    ("branch-naming-hotfix", "low", "high", r"^hotfix/[a-z0-9-_]+$"),
    ("branch-naming-release", "low", "high", r"^release/[a-z0-9._-]+$"),
    ("commit-sha-reference", "low", "high", r"\b[0-9a-f]{40}\b"),
    ("merge-commit", "low", "high", r"^Merge branch"),
    ("tag-reference", "low", "high", r"^refs/tags/v?\d+\.\d+"),
    ("git-hygiene-github-actions-workflow", "low", "high", r"\.github/workflows/[^/]+\.ya?ml"),
    ("git-hygiene-dependabot-config", "low", "high", r"dependabot\.yml"),
    ("git-hygiene-renovate-config", "low", "high", r"renovate\.json"),
    ("commitizen-config", "low", "high", r"\.(czrc|cz.json|commitizen)"),
    ("semantic-release-config", "low", "high", r"\.releaserc|semantic-release"),
    ("git-flow-model", "low", "high", r"(?i)git.flow|gitflow"),
    ("github-issue-reference", "low", "high", r"(?i)(fixes|closes|resolves)\s+#\d+"),
    ("git-hooks-husky", "low", "high", r"\.husky/"),
    ("pre-commit-config", "low", "high", r"\.pre-commit-config\.ya?ml"),
    ("git-worktree", "low", "high", r"git\s+worktree"),
    ("git-stash", "low", "high", r"git\s+stash"),
    ("git-lfs", "low", "high", r"git\s+lfs|\.gitattributes.*lfs"),
    ("force-push-detected", "medium", "high", r"(?i)git\s+push\s+--force|git\s+push\s+-f"),
    ("commit-ampersand", "low", "low", r"\bamp\b"),
]
