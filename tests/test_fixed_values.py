"""Fixed values as literals, so that a changed table does not stay green on both engines."""

import pytest
from pyspark.sql import functions as F

from shelltrail.functions.catalogue import (
    intent_of,
    intent_phrase,
    prerequisite_of,
    relation_key,
    tool_title,
    workflow_title,
)
from shelltrail.functions.text import WHITE_SPACE, required_tool, step_tool
from shelltrail.operators.redact import PLACEHOLDER

# command, intent, title of the step by its intent, phrase in an overview
INTENTS = [
    ("git add -A", "git-commit", "Commit and push changes", "Git version control"),
    ("git switch main", "git-branch", "Branch management", "Git branching"),
    ("git rebase main", "git-sync", "Sync with remote", "Git synchronization"),
    ("docker tag a b", "docker-build", "Build and publish container image", "Docker image building"),
    ("docker logs c", "docker-run", "Run and manage containers", "Docker container management"),
    ("docker compose up", "docker-compose", "Manage multi-container application", "Docker Compose orchestration"),
    ("npm install", "npm-build", "Install dependencies and build", "Node.js build process"),
    ("npm start", "npm-dev", "Set up development environment", "Node.js development"),
    ("go test ./...", "go-build", "Build and test Go application", "Go compilation"),
    ("go mod tidy", "go-mod", "Manage Go modules", "Go module management"),
    ("source venv/bin/activate", "python-venv", "Set up Python virtual environment", "Python environment setup"),
    ("kubectl rollout status d", "kubectl-deploy", "Deploy to Kubernetes", "Kubernetes deployment"),
    ("kubectl logs p", "kubectl-debug", "Debug Kubernetes resources", "Kubernetes debugging"),
    ("terraform plan", "terraform", "Provision infrastructure", "Infrastructure provisioning"),
    ("rsync a b:", "ssh-scp", "Remote file operations", "Remote operations"),
    ("make all", "", None, ""),
]
# command, title by its tool, what it needs
TOOLS = [
    ("git log", "Git operations", "Git CLI installed"),
    ("sudo docker ps", "Docker operations", "Docker installed and running"),
    ("docker-compose up", "Docker operations", "Docker Compose installed"),
    ("helm list", "Kubernetes operations", "Helm CLI installed"),
    ("pnpm i", "Node.js package operations", None),
    ("yarn", "Node.js package operations", "Yarn package manager installed"),
    ("python3 x.py", "Python operations", "Python 3 installed"),
    ("tf plan", "Terraform operations", None),
    ("scp a b:", "Remote operations", "SSH/SCP access to remote hosts"),
    ("wget u", "HTTP requests", None),
    ("mv a b", "File system operations", None),
    ("mongosh", "mongosh operations", "MongoDB shell installed with database access"),
    ("cargo build", "cargo operations", "Rust toolchain installed"),
    ("az login", "az operations", "Azure CLI installed and configured"),
]
RELATED = [
    ("git", "gh"), ("docker", "docker-compose"), ("kubectl", "k9s"), ("npm", "pnpm"), ("go", "golangci-lint"),
    ("python", "pip3"), ("terraform", "tf"), ("aws", "awscli"), ("gcloud", "gsutil"), ("az", "azure"),
]


def test_intents(spark):
    df = spark.createDataFrame([(c,) for c, *_ in INTENTS], "command string")
    intent = intent_of(F.col("command"))
    rows = df.select("command", intent, workflow_title(intent), intent_phrase(intent)).collect()
    assert [tuple(r) for r in rows] == INTENTS


def test_tools(spark):
    df = spark.createDataFrame([(c,) for c, *_ in TOOLS], "command string")
    rows = df.select("command", tool_title(step_tool("command")), prerequisite_of(required_tool("command"))).collect()
    assert [tuple(r) for r in rows] == TOOLS
    assert spark.range(1).select(tool_title(F.lit(None).cast("string"))).first()[0] == "Shell commands"


def test_families(spark):
    tools = [t for pair in RELATED for t in pair] + ["make", "ls"]
    keys = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in tools], "t string").select("t", relation_key(F.col("t"))).collect()}
    for a in tools:
        for b in tools:
            related = a == b or (a, b) in RELATED or (b, a) in RELATED
            assert (keys[a] == keys[b]) == related


def test_white_space_and_placeholder():
    places = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
    assert sorted(map(ord, WHITE_SPACE)) == places
    assert PLACEHOLDER == "[REDACTED - contains sensitive data]"


@pytest.mark.parametrize("text, gone", [("a ", "a"), ("​a", "​a"), ("　x ", "x")])
def test_trim(spark, text, gone):
    from shelltrail.functions.text import trim_space

    assert spark.createDataFrame([(text,)], "c string").select(trim_space("c")).first()[0] == gone
