import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that operators use inside; tables may have them too.
CLASHING = ["id", "mark", "key", "n", "row", "spans", "fp", "size", "component_id", "score", "kept", "label", "of", "v", "x", "n_tokens", "target"]


@pytest.fixture
def docs(spark):
    """Documents from texts (or (text, lang, source)), with columns whose names the operators use themselves."""

    def make(texts, ids=None, langs=None, sources=None):
        rows = [(i if ids is None else ids[i], t, langs[i] if langs else "en", sources[i] if sources else "a", len(t or ""), *["?"] * len(CLASHING)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOC_SCHEMA + "".join(f", `{c}` string" for c in CLASHING)).repartition(3)

    return make
