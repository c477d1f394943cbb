import re

import pytest

from sitequarry.llm import backoff_lm, suffix_dedup


@pytest.mark.parametrize("operator", [backoff_lm.score, suffix_dedup.dedup])
def test_ranges_follow_the_bytes_and_not_the_partitions(spark, documents, operator):
    total = documents.selectExpr("sum(octet_length(text))").first()[0]
    results, dealt = [], []
    for range_bytes in (total // 9, total // 3):
        out = operator(documents, block_bytes=60_000, range_bytes=range_bytes)
        plan = out._jdf.queryExecution().executedPlan().toString()
        dealt.append({int(n) for n in re.findall(r"hashpartitioning\(range#\d+, (\d+)\)", plan)})
        results.append(sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in out.collect()))
    blocks = -(-total // 60_000)
    assert dealt == [{-(-blocks * 60_000 // (total // n))} for n in (9, 3)]
    assert results[0] == results[1]
