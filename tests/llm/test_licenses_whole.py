"""Files with many templates keep all labels."""

from tidebar.llm import license_scan

DOCS = "doc_id long, text string"


def test_a_notice_with_all_templates_keeps_all_labels(spark):
    notice = ". ".join(t for t, _ in license_scan.TEMPLATES.values())
    texts = [notice, *["the gnu general public license version"] * 5, *[" ".join(license_scan.TEMPLATES[k][0] for k in ("gpl-2", "lgpl", "mpl-2"))] * 3]
    out = {r.doc_id: r for r in license_scan.licenses(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert set(out[0].labels.split(",")) >= set(license_scan.TEMPLATES)
    assert out[7].labels == "gpl-2,lgpl,mpl-2"
