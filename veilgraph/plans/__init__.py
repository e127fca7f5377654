"""Whole evaluations: tables of jobs and their results."""

from .evaluate import utility_report

__all__ = ["utility_report"]
