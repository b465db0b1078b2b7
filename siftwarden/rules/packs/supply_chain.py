"""Dependency declarations and audits, mostly names of well-known files."""

CATEGORY = "supply-chain"
SUBJECT = "dependency declaration"

# Name, severity, confidence and pattern of each rule, with entropy floor and scope, decide what is
# reported.  They stand as published, in their order.
RULES = [
    ("unknown-npm-package", "low", "low",
     r"(?i)npm\s+(install|add)\s+([a-z0-9_-]+@[0-9]+\.[0-9]+\.[0-9]+|[a-z0-9_-]+\.[a-z0-9_-]+)"),
    ("package-json", "low", "high", r"package\.json"),
    ("npm-shrinkwrap", "medium", "high", r"npm-shrinkwrap\.json"),
    ("yarn-lockfile", "low", "high", r"yarn\.lock"),
    ("pnpm-lockfile", "low", "high", r"pnpm-lock\.yaml"),
    ("go-mod", "low", "high", r"go\.mod"),
    ("go-sum", "medium", "high", r"go\.sum"),
    ("go-replace-directive", "medium", "high", r"(?i)replace\s+"),
    ("requirements-txt", "low", "high", r"requirements.*\.txt"),
    ("pipfile", "low", "high", r"Pipfile"),
    ("pipfile-lock", "medium", "high", r"Pipfile\.lock"),
    ("pyproject-toml", "low", "high", r"pyproject\.toml"),
    ("poetry-lock", "medium", "high", r"poetry\.lock"),
    ("setup-py", "low", "high", r"setup\.py"),
    ("cargo-toml", "low", "high", r"Cargo\.toml"),
    ("cargo-lock", "medium", "high", r"Cargo\.lock"),
    ("pom-xml", "low", "high", r"pom\.xml"),
    ("gradle-build", "low", "high", r"build\.gradle"),
    ("gradle-lockfile", "medium", "high", r"gradle\.lockfile"),
    ("maven-wrapper", "low", "high", r"mvnw"),
    ("gradle-wrapper", "low", "high", r"gradlew"),
    ("nuget-config", "low", "high", r"nuget\.config"),
    ("packages-config", "low", "high", r"packages\.config"),
    ("dotnet-csproj", "low", "high", r"\.[a-z]+\.csproj"),
    ("github-advisory", "high", "high", r"github\.com/advisories"),
    ("npm-audit", "medium", "high", r"(?i)npm\s+audit"),
    ("safety-db", "medium", "high", r"(?i)safety\s+check"),
    ("cargo-audit", "medium", "high", r"(?i)cargo\s+audit"),
    ("sbom-spdx", "medium", "high", r"SPDXID.*DocumentName"),
    ("sbom-cyclonedx", "medium", "high", r"<bom.*xmlns.*cyclonedx"),
    ("dockerfile-base-image", "medium", "high", r"(?i)^FROM\s+[a-z0-9._/-]+:([a-z0-9._-]+|latest)"),
    ("helm-chart-dependency", "medium", "high", r"dependencies:.*- name:"),
    ("github-actions-workflow", "low", "high", r"\.github/workflows/"),
    ("dependabot-config", "low", "high", r"dependabot\.yml"),
    ("renovate-config", "low", "high", r"renovate\.json"),
]
