import pytest

import __spark_entry__ as entry

#: How many rows each query gives: those of a table, or None where it isn't one for one.
ROWS = {"op1": "documents", "op2": "documents", "op3": "documents", "op4": "documents", "op5": None, "op6": "documents", "op7": "pages", "op8": "documents", "op9": None, "op10": None, "op11": None, "op12": "documents", "op13": "documents", "pipeline": None}
COLUMNS = {
    "op1": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next class_id", "op2": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op3": "doc_id size source_size target taken", "op4": "doc_id fingerprint component_id", "op6": "doc_id n_bytes n_removed n_spans kept_sha256", "op7": "page_id url text n_chars",
    "op9": "query_id rank vec_id score", "op10": "doc_id start length ids_crc32 doc_tokens sequence_id offset place",
    "op11": "item_id rank doc_id score", "op12": "doc_id start n_tokens ids_crc32", "op13": "doc_id leaf subroot root proof_sha256 folded_root verified",
}


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.split("_")[0] in ROWS))
def test_registered_query_runs(spark, sf, name):
    out = entry.queries()[name](spark, sf)
    key = name.split("_")[0]
    if key in COLUMNS:
        assert out.columns == COLUMNS[key].split()
    table = ROWS[key]
    n = out.count()
    assert n == spark.read.parquet(f"{sf}/{table}.parquet").count() if table else n > 0


def test_rollup_query_equals_a_recount(spark, sf):
    """Inserts, revisions to texts without repeated lines, deletes of copies: what is left, counted anew."""
    from sitequarry.llm.token_rollup import without_repeated_lines
    from sitequarry.llm.tokens import ByteBpe, public_path

    paths = {"byte_bpe_50k": public_path("byte_bpe_50k.json"), "byte_bpe_multi_50k": public_path("byte_bpe_multi_50k.tiktoken")}
    tools = {k: ByteBpe(v) for k, v in paths.items()}
    want: dict = {}
    seen = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        if r.text in seen or seen.add(r.text):
            continue
        for name, tool in tools.items():
            docs, tokens = want.get((r.source, r.lang, name), (0, 0))
            want[r.source, r.lang, name] = docs + 1, tokens + len(tool.packed(without_repeated_lines(r.text or ""))) // tool.kind.itemsize
    got = {(r.source, r.lang, r.tokenizer_version): (r.docs, r.tokens) for r in entry.queries()["op5_token_rollup"](spark, sf).collect()}
    assert got == want
