"""Documents that are an entire long licence text."""
from __future__ import annotations

from pathlib import Path

import pytest

from rebuff.llm import licenses
from tests.llm.test_operators import frame

FOLDER = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not FOLDER.exists(), reason="no licence texts at hand")
def test_full_texts(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = {n: (FOLDER / n).read_text() for n in names}
    rows = [(k, texts[n].upper()) for k, n in enumerate(names)]
    apache = texts["Apache-2.0"]
    rows += [(20, apache[:apache.index("END OF TERMS")]), (21, apache.replace("[yyyy] [name of copyright owner]", "2020 Somebody")), (22, apache + "and one clause more"),
             (23, texts["GPL-3"][:texts["GPL-3"].index("END OF TERMS")])]
    got = {r.doc_id: r.license for r in licenses.scan(frame(spark, rows), licenses.known_licenses(spark)).collect()}
    assert [got[k] for k in range(len(names))] == list(names.values())
    assert (got[20], got[21], got[22], got[23]) == ("Apache-2.0", "Apache-2.0", None, "GPL-3.0-only")
