"""The registered operator queries and the pipeline over the smallest given tables."""

import os
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from salesframe.llm import packing, quality, queries
from salesframe.session import settle

FOLDER = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "labels", "pages"]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables not here")

COLUMNS = {
    "op1_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op2_license_scan": "doc_id bigint, text_digest string, text_license string, licenses string, notices bigint",
    "op3_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op4_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op6_line_dedup": "doc_id bigint, text string, lines bigint, removed_lines bigint",
    "op7_secret_scan": "doc_id bigint, word int, nth int, candidate_sha256 string, length int, score double, secret boolean",
    "op8_embed_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op9_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op11_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op12_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op13_divergence": "lang string, source string, part string, item string, value bigint, rank int",
}


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_all_are_registered():
    assert set(COLUMNS) == set(queries.QUERIES) and set(queries.ORACLES) <= set(COLUMNS)
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "simhash", "mixing", "packing"]


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, docs, name):
    found = queries.QUERIES[name](spark, FOLDER)
    assert ", ".join(f"{n} {t}" for n, t in found.dtypes) == COLUMNS[name]
    rows = found.collect()
    if name in ("op2_license_scan", "op3_mixing", "op4_langid", "op5_simhash", "op6_line_dedup", "op9_quality", "op10_exact_dedup"):
        assert sorted(r.doc_id for r in rows) == sorted(docs)
    if name in ("op4_langid", "op9_quality"):
        mod, rest = (4, 2) if name == "op4_langid" else (5, 0)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) and 0 <= r.score <= 1 for r in rows)
    if name == "op4_langid":
        held = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out]
        assert np.mean(held) > 0.9
    if name == "op9_quality":
        labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
        assert np.mean([r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]) > 0.85
        assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    if name == "op6_line_dedup":
        assert all(len(r.text) <= len(docs[r.doc_id].text) for r in rows) and any(r.removed_lines for r in rows)


@pytest.mark.parametrize("name", queries.ORACLES)
def test_sql_twin(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    found = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    got = sorted(map(repr, (tuple(r[c] for c in columns) for r in found.collect())))
    cursor = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    want = sorted(map(repr, (tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())))
    assert got == want


def test_pipeline_stage_by_stage(spark, docs):
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = frame.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        frame = settle(stage(spark, frame, FOLDER), name)
        assert name == "packing" or frame.columns == columns
        kept[name] = frame.collect()

    # the classifier, fitted apart
    labels = queries.learning_labels(spark.read.parquet(f"{FOLDER}/labels.parquet"))
    model = quality.fit(quality.document_statistics(spark.read.parquet(f"{FOLDER}/documents.parquet")), labels)
    score = dict(zip(docs, model.score(np.array([quality.statistics(r.text) for r in docs.values()]))))
    good = {i for i in docs if score[i] >= 0.3}
    assert {r.doc_id for r in kept["quality"]} == good and 0 < len(good) < len(docs)

    # equal texts: most code points, then the smallest id
    best = {}
    for i in good:
        bare = re.sub(r"[\x20\x09-\x0D]", "", docs[i].text)
        best[bare] = min(best.get(bare, (1,)), (-len(docs[i].text), i))
    unique = {i for _, i in best.values()}
    assert {r.doc_id for r in kept["exact_dedup"]} == unique

    # linked fingerprints: the smallest id of each component
    from test_llm_documents import brute_fingerprint, roots
    ids = sorted(unique)
    prints = [brute_fingerprint(docs[i].text) for i in ids]
    root = roots(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    assert {r.doc_id for r in kept["simhash"]} == {ids[r] for r in root}

    # the mix: near every source's target, whole words of the documents it had
    sizes = {}
    for r in kept["simhash"]:
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    from test_llm_documents import brute_targets
    taken, by_doc = {}, {}
    for r in kept["mixing"]:
        taken[r.source] = taken.get(r.source, 0) + words(r.text)
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + words(r.text)
        assert r.n_chars == len(r.text)
    for s, target in brute_targets(sizes).items():
        assert abs(taken.get(s, 0) - target) <= 2 * 64
    assert all(n <= 3 * words(docs[i].text) for i, n in by_doc.items())

    # every token once, sequences without gaps
    encode = packing.encoder()
    want = sorted((r.doc_id, tuple(encode(r.text) + [1])) for r in kept["mixing"])
    pieces = {}
    for r in kept["packing"]:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert sum(len(t) for _, t in want) == sum(r.length for r in kept["packing"])
    assert {(i, len(t)) for i, t in want} == set(pieces)
    for i, t in want:
        for start in range(0, len(t), 2048):
            assert (start, list(t[start:start + 2048])) in pieces[i, len(t)]
    used = {}
    for r in kept["packing"]:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert corpus_pipeline.run(spark, FOLDER).count() == len(kept["packing"])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, name):
    from test_llm_documents import SCHEMA, odd_rows, table
    stage = dict(corpus_pipeline.STAGES)[name]
    odd = spark.createDataFrame(table(odd_rows()), SCHEMA)
    for frame in (odd, odd.where("false")):
        out = settle(stage(spark, frame, FOLDER), "odd")
        assert name == "packing" or out.columns == frame.columns
        assert out.count() == 0 or frame is odd
