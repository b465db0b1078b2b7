"""Infrastructure-as-code statements, built from block, kind and instruction names."""

CATEGORY = "infrastructure"
SUBJECT = "infrastructure statement"

# Name, severity, confidence and pattern of each rule, with entropy floor and scope, decide what is
# reported.  They stand as published, in their order.
RULES = [
    ("terraform-resource", "low", "high", r'(?i)resource\s+"[^"]+"'),
    ("terraform-variable", "low", "high", r'(?i)variable\s+"[^"]+"'),
    ("terraform-output", "low", "high", r'(?i)output\s+"[^"]+"'),
    ("terraform-backend", "medium", "high", r'(?i)backend\s+"[^"]+"'),
    ("terraform-sensitive-variable", "high", "high", r"(?i)sensitive\s*=\s*true"),
    ("terraform-provider-aws", "low", "high", r'provider\s+"aws"'),
    ("terraform-provider-azure", "low", "high", r'provider\s+"azurerm"'),
    ("terraform-provider-gcp", "low", "high", r'provider\s+"google"'),
    ("terraform-module", "low", "high", r'(?i)module\s+"[^"]+"'),
    ("terraform-data-source", "low", "high", r'(?i)data\s+"[^"]+"'),
    ("terraform-locals", "low", "high", r"(?i)locals\s*\{"),
    ("terraform-dynamic-block", "medium", "high", r'(?i)dynamic\s+"[^"]+"'),
    ("terraform-for-each", "medium", "high", r"(?i)for_each\s*="),
    ("terraform-count", "medium", "high", r"(?i)count\s*="),
    ("kubernetes-deployment", "low", "high", r"(?i)kind:\s*Deployment"),
    ("kubernetes-service", "low", "high", r"(?i)kind:\s*Service"),
    ("kubernetes-configmap", "low", "high", r"(?i)kind:\s*ConfigMap"),
    ("kubernetes-secret", "high", "high", r"(?i)kind:\s*Secret"),
    ("kubernetes-ingress", "low", "high", r"(?i)kind:\s*Ingress"),
    ("kubernetes-pod", "low", "high", r"(?i)kind:\s*Pod"),
    ("kubernetes-statefulset", "low", "high", r"(?i)kind:\s*StatefulSet"),
    ("kubernetes-daemonset", "low", "high", r"(?i)kind:\s*DaemonSet"),
    ("kubernetes-job", "low", "high", r"(?i)kind:\s*Job"),
    ("kubernetes-cronjob", "low", "high", r"(?i)kind:\s*CronJob"),
    ("kubernetes-persistentvolume", "low", "high", r"(?i)kind:\s*PersistentVolume"),
    ("kubernetes-namespace", "low", "high", r"(?i)kind:\s*Namespace"),
    ("kubernetes-serviceaccount", "low", "high", r"(?i)kind:\s*ServiceAccount"),
    ("kubernetes-role", "medium", "high", r"(?i)kind:\s*Role"),
    ("kubernetes-clusterrole", "medium", "high", r"(?i)kind:\s*ClusterRole"),
    ("kubernetes-networkpolicy", "medium", "high", r"(?i)kind:\s*NetworkPolicy"),
    ("kubernetes-resource-quota", "low", "high", r"(?i)kind:\s*ResourceQuota"),
    ("kubernetes-limitrange", "low", "high", r"(?i)kind:\s*LimitRange"),
    ("kubernetes-hpa", "low", "high", r"(?i)kind:\s*HorizontalPodAutoscaler"),
    ("kubernetes-pdb", "low", "high", r"(?i)kind:\s*PodDisruptionBudget"),
    ("kubernetes-priorityclass", "low", "high", r"(?i)kind:\s*PriorityClass"),
    ("dockerfile-from", "low", "high", r"(?i)^FROM\s+"),
    ("dockerfile-run", "low", "high", r"(?i)^RUN\s+"),
    ("dockerfile-cmd", "low", "high", r"(?i)^CMD\s+"),
    ("dockerfile-expose", "low", "high", r"(?i)^EXPOSE\s+"),
    ("dockerfile-env", "medium", "high", r"(?i)^ENV\s+"),
    ("dockerfile-add", "medium", "high", r"(?i)^ADD\s+"),
    ("dockerfile-copy", "low", "high", r"(?i)^COPY\s+"),
    ("dockerfile-workdir", "low", "high", r"(?i)^WORKDIR\s+"),
    ("dockerfile-volume", "low", "high", r"(?i)^VOLUME\s+"),
    ("dockerfile-user", "low", "high", r"(?i)^USER\s+"),
    ("dockerfile-healthcheck", "low", "high", r"(?i)^HEALTHCHECK\s+"),
    ("cloudformation-resources", "low", "high", r"(?i)Resources:"),
    ("cloudformation-parameters", "low", "high", r"(?i)Parameters:"),
    ("cloudformation-mappings", "low", "high", r"(?i)Mappings:"),
    ("cloudformation-outputs", "low", "high", r"(?i)Outputs:"),
    ("cloudformation-conditions", "low", "high", r"(?i)Conditions:"),
    ("cloudformationAWSTemplateFormatVersion", "low", "high", r"AWSTemplateFormatVersion:"),
    ("helm-chart", "low", "high", r"apiVersion:\s*v2"),
    ("helm-values", "low", "high", r"^values:"),
    ("helm-templates", "low", "high", r"templates/[^/]+\.ya?ml"),
]
