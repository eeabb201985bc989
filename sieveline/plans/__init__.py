"""Queries over the test tables, one set for each area."""

from __future__ import annotations


def query_sets():
    from sieveline.plans import access, content, files, logs, more, pages, streams, urls

    return [access.Q, content.Q, urls.Q, logs.Q, streams.Q, files.Q, pages.Q, more.Q]
