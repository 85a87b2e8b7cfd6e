import hashlib

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline as P
from threadloom.llm.queries import QUERIES, vocabulary


@pytest.fixture
def folder(spark, tmp_path):
    """Tables of a small corpus with a toxic, a repeated, a leaked and a secret document, and odd rows."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    filler = [(i, f"plain text number {i} about river {i * 7} and hill {i * 13} in the green valley {i * 31} today") for i in range(100, 400)]
    rows = [(i, t, "en", "s", len(t)) for i, t in filler]
    rows += [(i, f"you are an utter clodpole {i} says nobody near river {i * 3}", "en", "s", 9) for i in range(400, 460)]
    rows += [(1, "same words here again", None, None, None), (2, "same words here again", "en", "s", 4), (2, "same words here again", "en", "s", 4)]
    rows += [(3, f"before {item} after", "en", "s", 7), (4, item, "en", "s", 7), (5, "my token=abcdef123 is out", "en", "s", 7), (6, None, None, None, None), (7, "", "en", "s", 0), (None, "no id", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(400 <= i < 460)) for i in range(100, 460)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stage_by_stage(spark, folder, tmp_path):
    df, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in P.STAGES:
        stage(spark, df, folder).write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r for r in df.collect()}
        if name != P.STAGES[-1][0]:
            assert df.columns == list(P.COLUMNS)
    plain = {*range(100, 400)}
    assert set(kept["toxicity"]) == plain | {1, 2, 3, 4, 5, 6, 7, None}
    assert set(kept["simhash"]) == plain | {1, 3, 4, 5, 6, None}  # 2 copies 1, 7 is as empty as 6
    assert set(kept["decontamination"]) == plain | {1, 3, 5, 6, None}
    assert kept["decontamination"][3].text == "before  after" and kept["decontamination"][3].n_chars == 13
    assert kept["secrets"][5].text == "my [secret] is out" and kept["secrets"][5].n_chars == 18 and kept["secrets"][100] == kept["toxicity"][100]
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary())
    for i, r in kept["sentencepiece"].items():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(kept["secrets"][i].text or "", add_bos=True, add_eos=True)
    assert P.run(spark, folder).count() == len(kept["sentencepiece"])


def test_rows_of_one_id_with_different_texts(spark):
    words = lambda n: " ".join(f"w{n}{k}" for k in range(30))
    rows = [(7, words(1)), (7, words(2)), (7, words(2)), (7, words(2).upper()), (9, words(2)), (9, words(3)), (5, words(3)), (None, words(3)), (6, None), (6, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, (r.text or "").lower()) for r in P.simhash(spark, df, "").collect()]
    assert sorted(got, key=repr) == sorted([(7, words(1)), (7, words(2)), (5, words(3)), (None, words(3)), (6, "")], key=repr)


def test_empty_tables(spark, tmp_path, folder):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0


def test_queries_have_the_columns_of_their_contracts(spark, folder):
    spark.createDataFrame([(i, [1.0, float(i)]) for i in range(300)], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    columns = {
        "op1_nearest": "query_id:bigint rank:int score:double vec_id:bigint",
        "op2_pii": "base_sha256:string doc_id:bigint n_card:bigint n_email:bigint n_ip:bigint n_phone:bigint spans:string",
        "op3_substring_dedup": "doc_id:bigint kept_sha256:string n_removed:bigint n_words:bigint",
        "op4_sentencepiece": "decoded_sha256:string doc_id:bigint ids_sha256:string n_tokens:bigint",
        "op5_shard_bytes": "doc_id:bigint grown_shard:int law:string shard:int size:bigint slot:bigint text_crc32:bigint",
        "op6_toxicity": "doc_id:bigint held_out:boolean predicted:int score:double",
        "op7_suffix_dedup": "doc_id:bigint kept_sha256:string n_bytes:bigint n_removed:bigint n_spans:bigint",
        "op8_decontaminate": "contaminated:boolean doc_id:bigint items_sha256:string n_hit:bigint n_items:bigint n_words:bigint",
        "op9_simhash": "component_id:bigint doc_id:bigint fingerprint:string",
        "op10_secrets": "base_sha256:string doc_id:bigint n_access:bigint n_assign:bigint n_hex:bigint spans:string",
    }
    assert set(QUERIES) == set(columns)
    results = {name: f(spark, folder) for name, f in QUERIES.items()}
    assert {n: " ".join(f"{c}:{t}" for c, t in sorted(df.dtypes)) for n, df in results.items()} == columns
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    r = results["op10_secrets"].where("doc_id = 5").first()
    assert (r.n_assign, r.base_sha256, r.spans) == (1, digest("assign:3:18"), "assign:3:18")
    assert results["op2_pii"].where("doc_id = 6").first().base_sha256 == digest("")
    assert results["op8_decontaminate"].where("doc_id = 3").first().items_sha256 == digest("1")
    assert results["op9_simhash"].where("doc_id = 6").first().fingerprint == "0" * 16
