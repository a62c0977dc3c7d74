"""The registered queries: names, columns and types, over the smallest tables."""

import pytest

from lakeloom.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op2_simhash_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op3_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op4_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op5_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double, accepted boolean",
    "op7_decontamination": "doc_id bigint, item_id bigint, n_item bigint, n_shared bigint, containment double",
    "op8_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op9_sentencepiece": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op10_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op11_centroid_clustering": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    "op12_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op13_merkle_manifest": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
}


def test_names():
    assert set(queries.queries()) == set(COLUMNS) and set(queries.oracle_sql()) <= set(COLUMNS)


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, name):
    df = queries.queries()[name](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    if name != "op7_decontamination":
        table = {"op10_html_extraction": "pages", "op11_centroid_clustering": "embeddings"}.get(name, "documents")
        assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
