"""A small seeded corpus of policy documents in Markdown."""

from __future__ import annotations

import random

from weirstone.storage.table import Files

TOPICS = {
    "data-retention-policy": ("Data Retention Policy", [("Retention periods", "Bronze events are kept for 400 days. Silver histories are kept for seven years. Quarantined rows are kept for 90 days."), ("Deletion", "Erased records leave a closed version in the history; the payload is purged from bronze when its retention ends.")]),
    "access-control-standard": ("Access Control Standard", [("Least privilege", "Analysts read gold only. Engineers change bronze and silver. Each service account writes one layer."), ("Reviews", "Grants are reviewed each quarter, and unused ones are withdrawn.")]),
    "incident-runbook": ("Incident Runbook", [("First response", "Find the failed step and its error, then look at the quarantine before any checkpoint is moved."), ("Severity", "A failed gold step is a first-severity candidate; other failures are of the second.")]),
    "data-quality-standard": ("Data Quality Standard", [("Checks", "Every silver table has checks for keys, domains and references. Errors block promotion, warnings do not."), ("Freshness", "A table is stale when its newest event is older than its agreed hours.")]),
    "schema-evolution-guide": ("Schema Evolution Guide", [("Allowed changes", "New fields must be nullable. Types and keys never change; a list of values may only grow."), ("Versions", "The highest version of a contract is the one in force.")]),
    "pii-handling-policy": ("PII Handling Policy", [("Categories", "Fields are direct identifiers, quasi identifiers, sensitive or financial."), ("Masking", "Direct identifiers never leave silver.")]),
}


def write_corpus(files: Files, seed: int = 42) -> list[str]:
    """The same files for the same seed, in a folder of any store; their names."""
    chance, names = random.Random(seed), []
    for name, (title, sections) in TOPICS.items():
        front = f"# {title}\n\nDocument {chance.randint(100, 999)}, revision {chance.randint(1, 9)}.\n"
        names.append(f"{name}.md")
        files.write(names[-1], front + "".join(f"\n## {head}\n\n{body}\n" for head, body in sections))
    return names
