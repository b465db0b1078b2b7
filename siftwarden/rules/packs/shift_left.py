"""Markers of early quality work: hooks, pipelines, tests, scanners."""

CATEGORY = "shift-left"
SUBJECT = "early-quality marker"

# Name, severity, confidence and pattern of each rule, with entropy floor and scope, decide what is
# reported.  They stand as published, in their order.
RULES = [
    ("precommit-marker", "low", "high", r"(?i)(pre-commit|precommit|commit-msg)"),
    ("pr-review-marker", "low", "medium", r"(?i)(pull.request|code.review|review.required)"),
    ("shift-left-github-actions-workflow", "low", "high", r"\.github/workflows/[^/]+\.ya?ml"),
    ("gitlab-ci-pipeline", "low", "high", r"\.gitlab-ci\.yml"),
    ("jenkinsfile", "low", "high", r"Jenkinsfile"),
    ("azure-pipeline", "low", "high", r"azure-pipelines\.ya?ml"),
    ("circleci-config", "low", "high", r"\.circleci/config\.yml"),
    ("travis-yml", "low", "high", r"\.travis\.yml"),
    ("drone-ci", "low", "high", r"\.drone\.yml"),
    ("codecov-config", "low", "high", r"codecov\.yml|codeclimate\.yml"),
    ("sonarqube-config", "low", "high", r"sonar-project\.properties|sonar.*\.yml"),
    ("snyk-config", "medium", "high", r"\.snyk|snyk.*\.yml"),
    ("shift-left-dependabot-config", "low", "high", r"dependabot\.yml"),
    ("unit-test-marker", "low", "high", r"(?i)@Test|@test|def\s+test_|test\s*\(\s*"),
    ("integration-test-marker", "low", "high", r"(?i)integration.*test|@IntegrationTest|e2e|e2e.*test"),
    ("security-test-marker", "low", "high", r"(?i)security.*test|@SecuredTest|pen.*test|vuln.*test"),
    ("terraform-validate", "low", "high", r"(?i)terraform\s+validate|terraform\s+plan"),
    ("checkov-config", "low", "high", r"(?i)checkov|terragrunt|terraform-compliance"),
    ("trivy-config", "low", "high", r"(?i)trivy|aqua.*security|anchore"),
    ("grype-config", "low", "high", r"(?i)grype|synthonizer"),
]
