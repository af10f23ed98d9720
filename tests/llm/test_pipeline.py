import hashlib

import public_tokenizers
from test_lines import slow as slow_lines
from test_mixing import slow as slow_mixing
from test_simhash import slow_components
from test_toxicity import PLAIN, corpus
from tokenizers import Tokenizer

import corpus_pipeline
from hazegrid.llm import toxicity


def test_pipeline_against_plain_stages(spark, tmp_path):
    rows, labels = corpus()
    line = " ".join(PLAIN[:12]) + " number"
    texts = [(i, f"{t} x{i}\n{line} {i % 9}", f"src{i % 3 if i % 2 else 0}") for i, t in rows]
    texts += [(1000 + i, t, s) for i, t, s in texts[1:30]]  # copies
    texts += [(2000, "", "src1"), (2001, None, None), (2002, "w3 <|endoftext|> été " * 3000, "src2")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in texts], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    model = toxicity.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    source = {i: s for i, _, s in texts}
    kept = [(i, t) for i, t, _ in texts if model.score(t) < corpus_pipeline.TOXIC]
    assert {i for i, y in labels if y} <= {i for i, _, _ in texts} - {i for i, _ in kept}
    assert {i for i, y in labels if not y} <= {i for i, _ in kept}
    cut = [(int(i), t) for i, t in slow_lines(kept)]
    alone = {i for i, _, c in slow_components(cut) if i == c}
    left = [(i, t, source[i]) for i, t in cut if str(i) in alone]
    copies = slow_mixing(left, corpus_pipeline.MAX_REPETITION, 100_000)
    public = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t, s in left:
        ids = public.encode(t or "", add_special_tokens=False).ids
        row = (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        want += [row] * copies[s or "", str(i)]
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema] and out.count() == 0
