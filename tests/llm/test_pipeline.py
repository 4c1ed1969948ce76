"""The corpus pipeline against plain versions of its stages."""

import corpus_pipeline
from candlery.llm import toxicity
from candlery.llm.common import table

from .test_operators import plain_bytes, plain_components, plain_contamination, sha


def cut(rows):
    """Texts as the byte-level stage leaves them."""
    seen, out = set(), []
    for doc, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(data[i : i + 100])
        if not data or not all(gone):
            out.append((doc, bytes(b for b, g in zip(data, gone) if not g).decode("utf-8", "replace")))
    return out


def test_pipeline(spark, sf_dir):
    from tokenizers import Tokenizer

    from candlery.llm import bpe

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    got = {r.doc_id: (r.text, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    rows = [(r.doc_id, r.text) for r in toxicity.reject(docs, labels).collect()]
    assert len(rows) < docs.count()
    heads = plain_components(rows)
    rows = cut([r for r in rows if heads[r[0]][1] == r[0]])
    bad = plain_contamination(rows, [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()])
    tok, want = Tokenizer.from_file(bpe.tokenizer_path()), {}
    for doc, text in rows:
        if not bad[doc][4]:
            ids = tok.encode(text, add_special_tokens=False).ids
            want[doc] = (text, len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)))
    assert {d: (t or "", *x) for d, (t, *x) in got.items()} == want
    assert plain_bytes([(1, "a")])


def test_stages_of_awkward_rows(spark, sf_dir):
    """Nulls in any column, empty tables, repeated rows and odd names, stage by stage."""
    from pyspark.sql import functions as F

    from .test_operators import EMPTY, ROWS, odd_columns

    plain = spark.createDataFrame(ROWS, EMPTY).repartition(3)
    odd = plain.select("*", *(F.lit("own").alias(c) for c in ("N_Bytes", "hit", "runs", "component", "Token_IDs", "score")), *odd_columns())
    for name, stage in corpus_pipeline.STAGES:
        last = name == corpus_pipeline.STAGES[-1][0]
        assert stage(spark, plain.limit(0), sf_dir).count() == 0
        got, more = stage(spark, plain, sf_dir), stage(spark, odd, sf_dir)
        assert last or (got.columns == plain.columns and more.columns == odd.columns)
        key = lambda rows: sorted((repr((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"])) for r in rows))
        rows = more.collect()
        assert key(rows) == key(got.collect()) and all(r["a.b"] == "own a.b" and r["c`d"] == "own c`d" and r["hit"] == "own" for r in rows)
        assert {None, 1, 9} <= {r["doc_id"] for r in rows} and (name != "toxicity" or len(rows) == len(ROWS))
