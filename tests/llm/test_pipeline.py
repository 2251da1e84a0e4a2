import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from packetloom.llm import bpe, near_dedup
from tests.llm.test_near_dedup import plain
from tests.llm.test_pii import plain as plain_pii

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline_equals_brute_force(spark, tmp_path):
    r = random.Random(8)
    vocab = ["".join(r.choice("aeiourstlnm") for _ in range(r.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, prose(18)) for i in range(5)]
    rows, bad, leaked = [], set(), set()
    for i in range(400):
        t = prose(r.randint(30, 90))
        if i % 5 == 0:
            t = " ".join(f"{w}$$$" for w in t.split())
            bad.add(i)
        elif i % 7 == 0:
            t = f"{t} {items[i % 5][1]} {prose(5)}"
            leaked.add(i)
        elif i % 11 == 0:
            t = f"{t} mail me.{i}@site.example.org or 10.1.2.{i % 256} +49 (30) 123-45{i % 10}"
        elif i % 13 == 0 and i > 200:
            t = rows[i - 200][1] + " more"
        rows.append((i, t, "en", "s", len(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i not in bad), 0) for i in range(0, 400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    good = [x for x in rows if x[0] not in bad]
    group = {d: c for d, _, c in plain([(x[0], x[1]) for x in good])}
    left = [x for x in good if group[x[0]] == x[0] and x[0] not in leaked]
    own = bpe.Codec(P.path(bpe.VOCABULARY), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    names = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]"]
    want = {}
    for d, t, *_ in left:
        for k, s, e in sorted(plain_pii(t), key=lambda x: -x[1]):
            t = t[:s] + names[k] + t[e:]
        ids = b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(t))
        want[d] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in got} == want


def test_stages_keep_columns_and_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", 5), (2, "", None, 6), (3, "a b c", "x", 7), (3, "a b c", "x", 7), (None, "a b c", "x", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, fp long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, str(tmp_path)).columns == docs.columns
    assert sorted(x.doc_id or -1 for x in near_dedup.keep_one(docs).collect()) == [-1, 1, 2, 3]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 5
