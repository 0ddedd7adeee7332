"""Values that very many documents of one source hold."""

from llm_cases import docs
from meterline.llm import secret_scan


def test_copied_example_of_a_hot_source(spark):
    copied, rare = "token=abc123def456ghi789", "token=zyx987wvu654tsr321"
    rows = [(i, f"x {copied} y", "hot") for i in range(60)] + [(100 + i, f"x {rare} y", "hot") for i in range(3)]
    got = secret_scan.find_secrets(docs(spark, rows)).collect()
    assert {(r.n_live, r.n_example) for r in got if r.doc_id < 100} == {(0, 1)}
    assert {(r.n_live, r.n_example) for r in got if r.doc_id >= 100} == {(1, 0)}
