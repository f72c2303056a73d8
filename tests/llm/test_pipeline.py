"""The pipeline's stages over the smallest tables, each against brute force on its own input."""

import hashlib
import struct

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tessera.llm import bpe, pii
from tests.llm.test_corpus_operators import _brute_neardup
from tests.llm.test_text_operators import _brute_quality

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema = docs.columns
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        held[name] = (docs.collect(), spark.read.parquet(str(tmp_path / name)).collect())
        docs = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == schema
    given, got = held["quality_rules"]
    kept = {r.doc_id for r in got}
    assert kept <= {r.doc_id for r in given if not _brute_quality(r.text)[5]}
    given, got = held["minhash_neardup"]
    truth = _brute_neardup([(r.doc_id, r.text) for r in given], 5, 80)
    assert sorted(r.doc_id for r in got) == sorted({v for v in truth.values()})
    given, got = held["pii_surrogates"]
    assert sorted((r.doc_id, r.text) for r in got) == sorted((r.doc_id, pii.replace(r.text)[0]) for r in given)
    assert all(r.n_chars == len(r.text) for r in got)
    given, got = held["mixing"]
    texts = {r.doc_id: r.text for r in given}
    assert {r.doc_id for r in got} <= set(texts) and all(r.text == texts[r.doc_id] for r in got)
    given, got = held["byte_bpe"]
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for r in given:
        ids = lib.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)


CASES = [
    (1, None, "en", "s", None),
    (2, "", "en", None, 0),
    (3, "\n \t", None, "s", 3),
    (4, " ".join(f"word{i}" for i in range(80)), "en", "s", 1),
    (5, " ".join(f"Word{i}" for i in range(80)) + " write to a@b.example.org", "en", "s", 1),
    (6, " ".join(f"other{i}" for i in range(90)), None, None, None),
    (6, " ".join(f"other{i}" for i in range(90)), None, None, None),
    (7, " ".join(f"w{i}" for i in range(60_000)), "de", "t", 9),
    (None, " ".join(f"none{i}" for i in range(70)), "en", "s", 1),
    (None, " ".join(f"none{i}" for i in range(70)), "en", "s", 1),
    (8, " ".join(f"one{i}" for i in range(70)), "en", "s", 1),
    (8, " ".join(f"two{i}" for i in range(70)), "en", "s", 1),
]


def _cases(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 AS n", "'x' AS sig", "'y' AS entities", "0 AS tokens", "'z' AS posterior", "2 AS rate", "'k' AS kept", "3 AS component_id")


def test_stages_handle_every_case(spark):
    """Nulls, empty, very long and repeated texts, several texts of one id, and extra columns of clashing names."""
    long = CASES[7][1]
    want = {
        "quality_rules": sorted([4, 5, 6, 6, 7, None, None, 8, 8], key=str),
        "minhash_neardup": sorted([1, 2, 3, 4, 6, 7, None, None, 8, 8], key=str),
        "pii_surrogates": sorted([r[0] for r in CASES], key=str),
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, _cases(spark, CASES), SF)
        rows = out.collect()
        if name != "byte_bpe":
            assert out.columns == corpus_pipeline.COLUMNS
            assert all(r.text == long for r in rows if r.doc_id == 7)
        if name in want:
            assert sorted([r.doc_id for r in rows], key=str) == want[name], name
        elif name == "mixing":
            assert {r.doc_id for r in rows} <= {r[0] for r in CASES} and {1, 2, 3} <= {r.doc_id for r in rows}
        else:
            assert len(rows) == len(CASES) and all((r.n_tokens == 0) == (r.doc_id in (1, 2)) for r in rows)
        none = stage(spark, _cases(spark, []), SF)
        assert none.count() == 0 and none.columns == out.columns


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
