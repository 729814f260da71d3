"""Declarative data-quality suites."""

from weirstone.quality.runner import run_suite, run_suites, suite_summary
from weirstone.quality.suite import Suite, load_suites

__all__ = ["Suite", "load_suites", "run_suite", "run_suites", "suite_summary"]
