"""Rewriting open JSON documents, in batches; the one place where JSON has to keep its types and canonical form."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lorekeep.sources.batches import canonical


@F.pandas_udf(StringType())
def rewritten(props: pd.Series, over: pd.Series, under: pd.Series, without: pd.Series) -> pd.Series:
    """Canonical JSON of ``under``, then ``props`` (whose values win), then ``over``; without some keys."""
    out = []
    for p, o, u, drop in zip(props, over, under, without, strict=True):
        if o is None and u is None and not len(drop):
            out.append(p)
            continue
        merged = {**json.loads(u or "{}"), **json.loads(p), **json.loads(o or "{}")}
        out.append(canonical({k: v for k, v in merged.items() if k not in set(drop)}))
    return pd.Series(out, dtype=object)


@F.pandas_udf(StringType())
def canonical_text(document: pd.Series) -> pd.Series:
    """JSON text in the form that hashes are taken of; null for what is no JSON."""

    def one(text: str | None) -> str | None:
        try:
            return canonical(json.loads(text)) if text is not None else None
        except json.JSONDecodeError:
            return None

    return pd.Series([one(x) for x in document], dtype=object)
