"""Lookup tables of tools, workflows and phrases, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Workflow:
    """A named kind of work, recognised by how a command starts."""

    name: str
    prefixes: tuple[str, ...]
    title: str


# Recognised workflows, first match wins.
WORKFLOWS: tuple[Workflow, ...] = (
    Workflow("git-commit", ("git add", "git commit", "git push"), "Commit and push changes"),
    Workflow("git-branch", ("git checkout", "git branch", "git switch"), "Branch management"),
    Workflow("git-sync", ("git fetch", "git pull", "git merge", "git rebase"), "Sync with remote"),
    Workflow(
        "docker-build",
        ("docker build", "docker tag", "docker push"),
        "Build and publish container image",
    ),
    Workflow(
        "docker-run", ("docker run", "docker exec", "docker logs"), "Run and manage containers"
    ),
    Workflow(
        "docker-compose",
        ("docker-compose", "docker compose"),
        "Manage multi-container application",
    ),
    Workflow(
        "npm-build", ("npm install", "npm run build", "npm test"), "Install dependencies and build"
    ),
    Workflow(
        "npm-dev", ("npm install", "npm run dev", "npm start"), "Set up development environment"
    ),
    Workflow("go-build", ("go build", "go test", "go run"), "Build and test Go application"),
    Workflow("go-mod", ("go mod init", "go mod tidy", "go get"), "Manage Go modules"),
    Workflow(
        "python-venv",
        ("python -m venv", "source", "pip install"),
        "Set up Python virtual environment",
    ),
    Workflow(
        "kubectl-deploy",
        ("kubectl apply", "kubectl rollout", "kubectl get"),
        "Deploy to Kubernetes",
    ),
    Workflow(
        "kubectl-debug",
        ("kubectl describe", "kubectl logs", "kubectl exec"),
        "Debug Kubernetes resources",
    ),
    Workflow(
        "terraform",
        ("terraform init", "terraform plan", "terraform apply"),
        "Provision infrastructure",
    ),
    Workflow("ssh-scp", ("ssh", "scp", "rsync"), "Remote file operations"),
)

# Tools that belong together.
TOOL_FAMILIES: tuple[tuple[str, ...], ...] = (
    ("git", "gh"),
    ("docker", "docker-compose"),
    ("kubectl", "helm", "k9s"),
    ("npm", "npx", "yarn", "pnpm"),
    ("go", "gofmt", "golangci-lint"),
    ("python", "pip", "python3", "pip3"),
    ("terraform", "tf"),
    ("aws", "awscli"),
    ("gcloud", "gsutil"),
    ("az", "azure"),
)

# Title of a step by its main tool.
TOOL_TITLES: tuple[tuple[tuple[str, ...], str], ...] = (
    (("git",), "Git operations"),
    (("docker", "docker-compose"), "Docker operations"),
    (("kubectl", "helm"), "Kubernetes operations"),
    (("npm", "yarn", "pnpm"), "Node.js package operations"),
    (("go",), "Go operations"),
    (("python", "pip", "python3"), "Python operations"),
    (("terraform", "tf"), "Terraform operations"),
    (("ssh", "scp", "rsync"), "Remote operations"),
    (("curl", "wget"), "HTTP requests"),
    (("cd", "ls", "mkdir", "rm", "cp", "mv"), "File system operations"),
)
NO_TOOL_TITLE = "Shell commands"

# What a tool needs.
TOOL_PREREQUISITES: dict[str, str] = {
    "git": "Git CLI installed",
    "docker": "Docker installed and running",
    "docker-compose": "Docker Compose installed",
    "kubectl": "kubectl installed with cluster access configured",
    "helm": "Helm CLI installed",
    "terraform": "Terraform CLI installed",
    "aws": "AWS CLI installed and configured",
    "gcloud": "Google Cloud SDK installed and configured",
    "az": "Azure CLI installed and configured",
    "npm": "Node.js and npm installed",
    "yarn": "Yarn package manager installed",
    "go": "Go toolchain installed",
    "python": "Python installed",
    "python3": "Python 3 installed",
    "pip": "pip package manager installed",
    "pip3": "pip3 package manager installed",
    "ssh": "SSH client and appropriate key access",
    "scp": "SSH/SCP access to remote hosts",
    "mysql": "MySQL client installed with database access",
    "psql": "PostgreSQL client installed with database access",
    "redis-cli": "Redis CLI installed with server access",
    "mongosh": "MongoDB shell installed with database access",
    "make": "Make build tool installed",
    "cargo": "Rust toolchain installed",
    "bundle": "Ruby and Bundler installed",
    "rails": "Ruby on Rails installed",
    "composer": "PHP Composer installed",
}

# How an intent reads in an overview.
INTENT_PHRASES: dict[str, str] = {
    "git-commit": "Git version control",
    "git-branch": "Git branching",
    "git-sync": "Git synchronization",
    "docker-build": "Docker image building",
    "docker-run": "Docker container management",
    "docker-compose": "Docker Compose orchestration",
    "npm-build": "Node.js build process",
    "npm-dev": "Node.js development",
    "go-build": "Go compilation",
    "go-mod": "Go module management",
    "python-venv": "Python environment setup",
    "kubectl-deploy": "Kubernetes deployment",
    "kubectl-debug": "Kubernetes debugging",
    "terraform": "Infrastructure provisioning",
    "ssh-scp": "Remote operations",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    """Value of ``key`` in a small constant table, null when absent."""
    return F.try_element_at(
        F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key
    )


def intent_of(command: Column, extra: tuple[Workflow, ...] = ()) -> Column:
    """Name of the first workflow with a prefix the untrimmed command starts with, else ``''``."""
    found = None
    for workflow in (*WORKFLOWS, *extra):
        hit = None
        for prefix in workflow.prefixes:
            test = command.startswith(prefix)
            hit = test if hit is None else hit | test
        if hit is None:
            continue
        found = (
            F.when(hit, workflow.name) if found is None else found.when(hit, workflow.name)
        )
    return F.lit("") if found is None else found.otherwise("")


def workflow_title(intent: Column, extra: tuple[Workflow, ...] = ()) -> Column:
    """Title of the workflow named ``intent``; null when unknown or blank."""
    titles: dict[str, str] = {}
    for workflow in (*WORKFLOWS, *extra):
        titles.setdefault(workflow.name, workflow.title)
    return F.nullif(_lookup(titles, intent), F.lit(""))


def relation_key(tool: Column) -> Column:
    """Equal for two tools exactly when they are related.

    A tool holds no white space, so a label with a space cannot collide with one.
    """
    families = {t: f"family of {family[0]}" for family in TOOL_FAMILIES for t in family}
    return F.coalesce(_lookup(families, tool), tool)


def tool_title(tool: Column) -> Column:
    """Title of a step by its main tool (null: no tool at all)."""
    named = {t: title for tools, title in TOOL_TITLES for t in tools}
    return F.coalesce(
        _lookup(named, tool), F.concat(tool, F.lit(" operations")), F.lit(NO_TOOL_TITLE)
    )


def prerequisite_of(tool: Column) -> Column:
    return _lookup(TOOL_PREREQUISITES, tool)


def intent_phrase(intent: Column) -> Column:
    return F.coalesce(
        _lookup(INTENT_PHRASES, intent), F.replace(intent, F.lit("-"), F.lit(" "))
    )
