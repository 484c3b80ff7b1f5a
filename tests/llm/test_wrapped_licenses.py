"""License notices that are wrapped over lines."""

import pytest

from terramosaic.llm import license_scan


@pytest.mark.parametrize("width", [3, 8, 12])
def test_wrapped_templates_match(spark, width):
    rows = []
    for k, (template, _) in enumerate(license_scan.TEMPLATES):
        own = template.split()
        lines = [" * " + " ".join(own[i : i + width]) for i in range(0, len(own), width)]
        rows.append((k, "\n".join(["plain words before it", *lines, "and after"])))
    # Apart by more than a window, the words are no notice.
    apart = "\n".join(f"{w} " + "x " * 30 for w in license_scan.TEMPLATES[1][0].split())
    docs = spark.createDataFrame([*rows, (99, apart)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs, phrases={}).collect()}
    assert got[99]["labels"] == "" and got[99]["score"] == 0
    for k, (_, label) in enumerate(license_scan.TEMPLATES):
        assert label in got[k]["labels"].split(",") and got[k]["score"] == 1.0
