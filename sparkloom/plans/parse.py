"""From lines to parsed logs and templates."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from ..functions import classify
from ..functions.patterns import Registry
from ..operators import matching, templates
from ..sources.scratch import written


class Parsed(NamedTuple):
    tokens: DataFrame
    templates: DataFrame
    logs: DataFrame


def parse(lines: DataFrame, min_support: int = 3, strict: bool = True, registry: Registry = classify.DEFAULT_REGISTRY) -> Parsed:
    """Tokenises, induces templates and matches.  ``strict`` matches a line to its own
    structure's template; else to the first of nearly its length.  The templates are made at
    once, in two scans, and written; if they are few they are broadcast, so that the logs are
    one more scan without a shuffle."""
    tokens = templates.tokenized(lines)
    found = written(templates.extract_templates(tokens, min_support, registry), "templates")
    match = matching.match_strict if strict else matching.match_first_fit
    return Parsed(tokens, found, matching.parsed_logs(match(tokens, found, small=matching.is_small(found))))
