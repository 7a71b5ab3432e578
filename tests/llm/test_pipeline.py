"""The pipeline on a small corpus, stage by stage, and the registered queries' columns."""

import importlib
from collections import Counter

import pytest
from helpers import awkward, brute_force, documents, prose

import corpus_pipeline
from gleanery.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SF_DIR), name)
        out[name] = docs
    return out


def test_stages_keep_the_columns_of_documents(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_each_stage_takes_effect(stages):
    ids = lambda n: Counter(r.doc_id for r in stages[n].select("doc_id").collect())
    assert not ids("toxicity") - ids("documents")
    assert not ids("near_duplicates") - ids("toxicity")
    clean = [tuple(r) for r in stages["toxicity"].select("doc_id", "text").collect()]
    assert ids("near_duplicates") == Counter(brute_force(clean))
    assert ids("personal_data") == ids("near_duplicates")
    assert set(ids("mixture")) <= set(ids("personal_data")) and max(ids("mixture").values()) <= 2
    packed = stages["packing"].collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == ids("mixture")


def test_run_gives_what_the_stages_give(spark, stages):
    keys = ("doc_id", "piece", "start", "length", "ids_crc32")
    got = corpus_pipeline.run(spark, SF_DIR).select(*keys).collect()
    assert Counter(got) == Counter(stages["packing"].select(*keys).collect())


def test_stages_take_awkward_and_empty_tables(spark, tmp_path):
    """Nulls, empties, repeated rows and clashing columns through all stages; then no rows at all."""
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    for name, rows in (("awkward", awkward()), ("empty", [])):
        folder = str(tmp_path / name)
        documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
        (labels if rows else labels.limit(0)).write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.staged(stage(spark, docs, folder), f"test-{name}")
            assert docs.columns == documents(spark, []).columns
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
        assert bool(packed) == bool(rows)


COLUMNS = {
    "op1_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op2_toxicity": "doc_id held_out score predicted",
    "op3_mix_sources": "doc_id size source_size target taken",
    "op4_url_filter": "page_id host path rule verdict",
    "op5_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op6_neighbours": "query_id rank vec_id score",
    "op7_simhash": "doc_id fingerprint component_id",
    "op8_pack": "doc_id piece start length ids_crc32 sequence_id offset",
    "op9_repeats": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op10_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op11_whitening": "vec_id component n deviation whitened explained identity_error",
    "op12_collocations": "lang rank phrase a l r n score",
    "op13_licences": "doc_id n_words n_base first_word last_word base_labels labels score",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query_columns(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    wanted = COLUMNS[name].split()
    assert df.columns[: len(wanted)] == wanted


def test_entry_registers_them():
    entry = importlib.import_module("__spark_entry__")
    assert {*COLUMNS, "pipeline"} <= set(entry.queries())
    assert prose(1, 2)
