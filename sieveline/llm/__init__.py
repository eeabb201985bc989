"""Operators for training data; nothing else in the package imports this one."""

from __future__ import annotations


def query_sets():
    from sieveline.llm import queries

    return [queries.Q]
