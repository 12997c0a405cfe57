"""Content hashes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reasons for which a file is skipped.
SKIP_REASONS = ("TooLarge", "Binary", "Ignored", "OutsideRoot", "NonUtf8Path", "Unreadable")


def content_hash(content: Column) -> Column:
    """sha-256 of a text in UTF-8, or of bytes, as lower-case hex."""
    return F.sha2(content, 256)


def skipped_hash(reason: Column) -> Column:
    """What stands for a skipped file in a tree of hashes: sha-256 of 'skip', a zero byte and the reason."""
    return F.sha2(F.concat(F.lit("skip"), F.char(F.lit(0)), reason), 256)


def canonical_json(document: Column) -> Column:
    """A JSON text with sorted keys and no blanks; null if it is no JSON."""

    @F.pandas_udf("string")
    def sort(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except (TypeError, ValueError):
                return None

        return texts.map(one)

    return sort(document)


def json_digest(document: Column, leave_out: tuple[str, ...] = ()) -> Column:
    """sha-256 of a document's canonical form, top-level keys ``leave_out`` not counted."""

    @F.pandas_udf("string")
    def without(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                found = json.loads(t)
            except (TypeError, ValueError):
                return None
            kept = {k: v for k, v in found.items() if k not in leave_out} if isinstance(found, dict) else found
            return json.dumps(kept, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

        return texts.map(one)

    return F.sha2(without(document) if leave_out else canonical_json(document), 256)
